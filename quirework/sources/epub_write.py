"""Writing packaged books: one archive per row, the same bytes for the same book."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable, Iterator
from itertools import chain, groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import escape_html
from .epub import CONTAINER, CONTAINER_NS, CSS, DC_NS, MIMETYPE, NCX, OPF_NS, PACKAGE, XHTML, XHTML_NS

STAMP = (1980, 1, 1, 0, 0, 0)
PIECE = 1 << 20
BOOK = "title string, language string, identifier string, chapters array<struct<name: string, title: string, body: string>>, images array<struct<name: string, media_type: string, data: binary>>"


def stylesheet(body_size: float = 1.0, heading_sizes: tuple[float, ...] = (1.6, 1.4, 1.2, 1.1, 1.0, 1.0), indent: float = 1.2) -> str:
    """The book's style; neighbouring heading levels of one size share a rule."""
    rules = [f"body {{ font-size: {body_size:g}em; line-height: 1.4; }}", f"p {{ margin: 0; text-indent: {indent:g}em; }}"]
    level = 1
    while level <= len(heading_sizes):
        last = level
        while last < len(heading_sizes) and heading_sizes[last] == heading_sizes[level - 1]:
            last += 1
        rules.append(f"{', '.join(f'h{k}' for k in range(level, last + 1))} {{ font-size: {heading_sizes[level - 1]:g}em; page-break-after: avoid; }}")
        level = last + 1
    return "\n".join([*rules, "img { max-width: 100%; }", ".page-break { page-break-after: always; }", ""])


def _page(title: str, body: str | Iterable[str], language: str, style: bool = True) -> Iterator[bytes]:
    """A document in pieces of about ``PIECE`` characters; a body may come as lines, which are not held."""
    link = '<link rel="stylesheet" type="text/css" href="style.css"/>' if style else ""
    head = f'<?xml version="1.0" encoding="utf-8"?>\n<html xmlns="{XHTML_NS}" xmlns:epub="http://www.idpf.org/2007/ops" lang="{language}"><head><title>{title}</title>{link}</head><body>'
    held, n = [head], 0
    for line in (body,) if isinstance(body, str) else body:
        held.append(line)
        n += len(line)
        if n >= PIECE:
            yield ("\n".join(held) + "\n").encode()
            held, n = [], 0
    yield "\n".join([*held, "</body></html>"]).encode()


def archive(title: str, language: str, identifier: str, chapters: list[dict], images: list[dict], css: str) -> bytes:
    """The packaged book. Titles and bodies (or their lines) are XHTML already; a book needs a chapter."""
    items = [("nav", "nav.xhtml", XHTML, ' properties="nav"'), ("ncx", "toc.ncx", NCX, ""), ("style", "style.css", CSS, "")]
    items += [(f"c{k}", c["name"], XHTML, "") for k, c in enumerate(chapters)] + [(f"i{k}", f"images/{i['name']}", i["media_type"], "") for k, i in enumerate(images)]
    listed = "".join(f'<item id="{i}" href="{h}" media-type="{m}"{p}/>' for i, h, m, p in items)
    spine = "".join(f'<itemref idref="c{k}"/>' for k in range(len(chapters)))
    points = "".join(f'<navPoint id="n{k}" playOrder="{k + 1}"><navLabel><text>{c["title"]}</text></navLabel><content src="{c["name"]}"/></navPoint>' for k, c in enumerate(chapters))
    links = "".join(f'<li><a href="{c["name"]}">{c["title"]}</a></li>' for c in chapters)
    package = f'<?xml version="1.0" encoding="utf-8"?>\n<package xmlns="{OPF_NS}" version="3.0" unique-identifier="id"><metadata xmlns:dc="{DC_NS}"><dc:identifier id="id">{identifier}</dc:identifier><dc:title>{title}</dc:title><dc:language>{language}</dc:language></metadata><manifest>{listed}</manifest><spine toc="ncx"><itemref idref="nav" linear="no"/>{spine}</spine></package>'
    parts = [
        (CONTAINER, f'<?xml version="1.0"?><container version="1.0" xmlns="{CONTAINER_NS}"><rootfiles><rootfile full-path="EPUB/content.opf" media-type="{PACKAGE}"/></rootfiles></container>'.encode()),
        ("EPUB/content.opf", package.encode()),
        ("EPUB/nav.xhtml", b"".join(_page(title, f'<nav epub:type="toc"><ol>{links}</ol></nav>', language))),
        ("EPUB/toc.ncx", f'<?xml version="1.0"?><ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1"><head/><docTitle><text>{title}</text></docTitle><navMap>{points}</navMap></ncx>'.encode()),
        ("EPUB/style.css", css.encode()),
        *[(f"EPUB/{c['name']}", _page(c["title"], c["body"], language)) for c in chapters],
        *[(f"EPUB/images/{i['name']}", bytes(i["data"])) for i in images],
    ]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(zipfile.ZipInfo("mimetype", STAMP), MIMETYPE, zipfile.ZIP_STORED)
        for name, data in parts:
            info = zipfile.ZipInfo(name, STAMP)
            info.compress_type = zipfile.ZIP_DEFLATED
            with z.open(info, "w") as entry:
                for piece in (data,) if isinstance(data, bytes) else data:
                    entry.write(piece)
    return out.getvalue()


def build(books: DataFrame, css: str | None = None) -> DataFrame:
    """(doc_id, epub) of rows (doc_id, title, language, identifier, chapters, images); titles are escaped here."""
    css = css or stylesheet()

    @F.pandas_udf("binary")
    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([archive(r.title, r.language, r.identifier, [dict(c) for c in r.chapters], [dict(i) for i in (r.images if r.images is not None else [])], css) for r in b.itertuples()])

    def safe(c: str | Column) -> Column:
        return escape_html(F.col(c) if isinstance(c, str) else c)

    chapters = F.transform("chapters", lambda c: F.struct(c["name"].alias("name"), escape_html(c["title"]).alias("title"), c["body"].alias("body")))
    return books.select("doc_id", packed(F.struct(safe("title").alias("title"), safe("language").alias("language"), safe("identifier").alias("identifier"), chapters.alias("chapters"), F.col("images"))).alias("epub"))


def build_from_blocks(blocks: DataFrame, chapter: str, images: DataFrame, css: str | None = None) -> DataFrame:
    """(doc_id, epub) of books of one chapter, named ``chapter``, from its blocks, a line each.

    A book's blocks pass in order and are packed as they come, so a task holds one archive and its
    images, never the text. ``blocks``: doc_id, block_index, xhtml, title, language, identifier
    (escaped here); ``images``: doc_id, image (name, media_type, data).
    """
    css = css or stylesheet()
    safe = lambda c: escape_html(F.col(c)).alias(c)
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    texts = blocks.select("doc_id", F.lit(1).alias("part"), F.col("block_index").cast("bigint").alias("idx"), F.lit("").alias("name"), "xhtml", safe("title"), safe("language"), safe("identifier"), none("media_type", "string"), none("data", "binary"))
    files = images.join(blocks.select(F.col("doc_id").alias("bd")), F.col("doc_id") == F.col("bd"), "left_semi")
    files = files.select("doc_id", F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("idx"), F.col("image.name").alias("name"), none("xhtml", "string"), none("title", "string"), none("language", "string"), none("identifier", "string"), "image.media_type", "image.data")
    rows = texts.unionByName(files).repartition("doc_id").sortWithinPartitions("doc_id", "part", "idx", "name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (r for b in batches for r in b.to_pylist())
        for doc, book in groupby(stream, key=lambda r: r["doc_id"]):
            pictures: list[dict] = []
            for r in book:
                if r["part"]:
                    break
                pictures.append(r)
            body = (x["xhtml"] for x in chain([r], book) if x["xhtml"] is not None)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc], pa.string()), "epub": pa.array([archive(r["title"], r["language"], r["identifier"], [{"name": chapter, "title": r["title"], "body": body}], pictures, css)], pa.binary())})

    return rows.mapInArrow(run, "doc_id string, epub binary")
