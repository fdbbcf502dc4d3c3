"""Packaged books as tables: archives exploded to one row per fact, ready for relational rules.

A fact row is (artifact, kind, seq, location, name, value, target, media_type, flag). Kinds: entry,
mimetype, problem (value is the code of what could not be read), version, meta, item, manifest,
spine, itemref, document, ref (img, stylesheet, a), page_break, css, css_ref, nav, nav_link, ncx,
ncx_point. Facts of a layer that cannot be read are missing, and a problem says why.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.files import candidates, resolve

SCHEMA = "artifact string, kind string, seq int, location string, name string, value string, target string, media_type string, flag boolean"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
# Names that the formats prescribe.
CONTAINER, CONTAINER_NS = "META-INF/container.xml", "urn:oasis:names:tc:opendocument:xmlns:container"
OPF_NS, DC_NS, XHTML_NS, EPUB_NS = "http://www.idpf.org/2007/opf", "http://purl.org/dc/elements/1.1/", "http://www.w3.org/1999/xhtml", "http://www.idpf.org/2007/ops"
PACKAGE, XHTML, CSS, NCX = "application/oebps-package+xml", "application/xhtml+xml", "text/css", "application/x-dtbncx+xml"
MIMETYPE = b"application/epub+zip"


def _split(tag: object) -> tuple[str, str]:
    """Namespace and local name of a tag."""
    if not isinstance(tag, str):
        return "", ""
    ns, _, local = tag.rpartition("}")
    return ns.lstrip("{"), local


def _text(e: ElementTree.Element) -> str:
    return "".join(e.itertext()).strip()


class _Reader:
    def __init__(self, artifact: str, data: bytes):
        self.artifact, self.data = artifact, data
        self.facts: list[tuple] = []

    def add(self, kind: str, seq: int = 0, location: str = "", name: str | None = None, value: str | None = None, target: str | None = None, media_type: str | None = None, flag: bool | None = None) -> None:
        self.facts.append((self.artifact, kind, seq, location, name, value, target, media_type, flag))

    def problem(self, code: str, location: str) -> None:
        self.add("problem", len(self.facts), location, value=code)

    def xml(self, path: str, code: str) -> ElementTree.Element | None:
        try:
            return ElementTree.fromstring(self.files[path])
        except ElementTree.ParseError:
            self.problem(code, path)
            return None

    def find(self, base: str, reference: str) -> str | None:
        path = resolve(base.rpartition("/")[0], reference)
        return next((p for p in candidates(path) if p in self.files), None) if path else None

    def read(self) -> list[tuple]:
        try:
            with zipfile.ZipFile(io.BytesIO(self.data)) as z:
                infos = z.infolist()
                self.files = {i.filename: z.read(i.filename) for i in infos if not i.is_dir()}
        except (zipfile.BadZipFile, OSError, RuntimeError, NotImplementedError, EOFError):
            self.problem("invalid_archive", "")
            return self.facts
        for k, i in enumerate(infos):
            self.add("entry", k, i.filename, name=i.filename, flag=i.compress_type != zipfile.ZIP_STORED)
        if "mimetype" in self.files:
            self.add("mimetype", 0, "mimetype", flag=self.files["mimetype"] == MIMETYPE)
        path = self._container()
        if path:
            self._package(path)
        return self.facts

    def _container(self) -> str | None:
        if CONTAINER not in self.files:
            return self.problem("missing_container", CONTAINER)
        root = self.xml(CONTAINER, "invalid_container")
        if root is None:
            return None
        files = root.find(f"{{{CONTAINER_NS}}}rootfiles") if _split(root.tag) == (CONTAINER_NS, "container") else None
        if files is None:
            return self.problem("invalid_container", CONTAINER)
        found, missing = [], 0
        for f in files.findall(f"{{{CONTAINER_NS}}}rootfile"):
            full, kind = (f.get("full-path") or "").strip(), (f.get("media-type") or "").strip()
            if not full or "?" in full or "#" in full or resolve("", full) is None:
                self.problem("invalid_container", CONTAINER)
            elif kind != PACKAGE:
                self.problem("unexpected_rootfile_media_type", CONTAINER)
            elif self.find("", full) is None:
                missing += 1
            else:
                found.append(self.find("", full))
        if not found:
            return self.problem("missing_package_document" if missing else "invalid_container", CONTAINER)
        return found[0]

    def _package(self, path: str) -> None:
        root = self.xml(path, "invalid_package_document")
        if root is None:
            return
        if _split(root.tag) != (OPF_NS, "package"):
            return self.problem("invalid_package_document", path)
        self.add("version", 0, path, value=(root.get("version") or "").strip())
        meta = root.find(f"{{{OPF_NS}}}metadata")
        self.add("metadata", 0, path, name=(root.get("unique-identifier") or "").strip(), flag=meta is not None)
        for k, e in enumerate(meta if meta is not None else ()):
            ns, local = _split(e.tag)
            if ns == DC_NS and _text(e):
                self.add("meta", k, path, name=local, value=_text(e), target=e.get("id"))
        manifest, items = root.find(f"{{{OPF_NS}}}manifest"), []
        self.add("manifest", 0, path, flag=manifest is not None)
        for k, e in enumerate(manifest if manifest is not None else ()):
            if _split(e.tag)[1] != "item":
                self.problem("invalid_manifest", path)
                continue
            href, kind = (e.get("href") or "").strip(), (e.get("media-type") or "").strip()
            target = self.find(path, href) if href else None
            inside = bool(href) and resolve(path, href) is not None  # from the file's own path: one level up is let pass
            self.add("item", k, path, (e.get("id") or "").strip(), href, target, kind, inside)
            if "nav" in (e.get("properties") or "").split():
                self.add("nav_item", k, path, (e.get("id") or "").strip(), target=target, media_type=kind)
            items.append((target, kind))
        spine = root.find(f"{{{OPF_NS}}}spine")
        self.add("spine", 0, path, name=(spine.get("toc") or "").strip() if spine is not None else "", flag=spine is not None)
        for k, e in enumerate(spine if spine is not None else ()):
            if _split(e.tag)[1] != "itemref":
                self.problem("invalid_spine", path)
            else:
                self.add("itemref", k, path, (e.get("idref") or "").strip())
        for target, kind in items:
            if target and kind == XHTML:
                self._document(target)
            elif target and kind == CSS:
                self._css(target, self.files[target])
            elif target and kind == NCX:
                self._ncx(target)

    def _document(self, path: str) -> None:
        root = self.xml(path, "invalid_xhtml")
        if root is None:
            return
        ns, local = _split(root.tag)
        body = root.find(f"{{{ns}}}body" if ns else "body")
        if local != "html" or ns not in (XHTML_NS, "") or body is None:
            return self.problem("invalid_xhtml", path)
        self.add("document", 0, path, media_type=XHTML)
        for k, e in enumerate(root.iter()):
            local = _split(e.tag)[1]
            if local == "img":
                self._ref("img", k, path, e.get("src"))
            elif local == "link" and "stylesheet" in (e.get("rel") or "").split():
                self._ref("stylesheet", k, path, e.get("href"))
            elif local == "a":
                self._ref("a", k, path, e.get("href"))
            elif local == "style" and _text(e):
                self._css(path, _text(e).encode(), inline=True)
            if "page-break" in (e.get("class") or "").split():
                empty = local == "div" and not _text(e) and not len(e)
                self.add("page_break", k, path, name=local, flag=empty)
        self._nav(root, path)

    def _ref(self, name: str, seq: int, path: str, raw: str | None) -> None:
        value = (raw or "").strip()
        external = bool(value) and not value.startswith("#") and resolve(path.rpartition("/")[0], value) is None and bool(re.match(r"[A-Za-z][A-Za-z0-9+.-]*:|//", value))
        self.add("ref", seq, path, name, value, self.find(path, value) if value else None, flag=external)

    def _css(self, path: str, data: bytes, inline: bool = False) -> None:
        try:
            text = data.decode("utf-8")
        except UnicodeDecodeError:
            return self.problem("invalid_stylesheet", path)
        if not text.strip():
            return self.problem("invalid_stylesheet", path)
        self.add("css", 0, path, value=text, flag=inline)

    def _nav(self, root: ElementTree.Element, path: str) -> None:
        navs = [e for e in root.iter() if _split(e.tag)[1] == "nav"]
        toc = next((e for e in navs if "toc" in (e.get(f"{{{EPUB_NS}}}type") or "").split()), None)
        self.add("nav", len(navs), path, flag=toc is not None and any(_split(c.tag)[1] == "ol" for c in toc), name="toc" if toc is not None else None)
        for k, e in enumerate(toc.iter() if toc is not None else ()):
            if _split(e.tag)[1] == "a":
                href = (e.get("href") or "").strip()
                self.add("nav_link", k, path, value=href, target=self.find(path, href) if href else None)

    def _ncx(self, path: str) -> None:
        root = self.xml(path, "invalid_navigation")
        if root is None:
            return
        nav_map = next((e for e in root.iter() if _split(e.tag)[1] == "navMap"), None)
        points = [e for e in nav_map.iter() if _split(e.tag)[1] == "navPoint"] if nav_map is not None else []
        if _split(root.tag)[1] != "ncx" or not points:
            return self.problem("invalid_navigation", path)
        for k, e in enumerate(points):
            content = next((c for c in e if _split(c.tag)[1] == "content"), None)
            src = (content.get("src") or "").strip() if content is not None else ""
            self.add("ncx_point", k, path, value=src, target=self.find(path, src) if src else None)


def facts(archives: DataFrame, artifact: Column, content: Column) -> DataFrame:
    """The facts of every archive; one that is null or unreadable gives a problem."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, data in zip(frame["artifact"], frame["content"], strict=True):
                yield pd.DataFrame(_Reader(name, bytes(data or b"")).read(), columns=COLUMNS)

    return archives.select(artifact.cast("string").alias("artifact"), content.alias("content")).mapInPandas(run, SCHEMA)
