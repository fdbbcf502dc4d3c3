"""Queries over the library's operators, each with SQL that gives the same rows where SQL can.

Books are the documents of one source, pages are documents (numbered by id), lines are as in
``sources.adapters``. Where the tables hold nothing of a kind (rectangles of images, columns,
chapter headings), small literal rows stand in, the same in both.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers, text as tx
from ..functions.files import chapter_name, css_references, extension_of, mime
from ..operators import analysis, assemble, chapters, compare, cover, epub_validate, furniture, headings, images, page_numbers, paragraphs, reading_order
from ..session import stored, table
from ..sources import adapters, epub
from ..streaming import pages as streaming
from . import convert


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.text_lines(table(spark, sf_dir, "documents"), book=F.col("source"), page=F.col("doc_id"), text=F.col("text"))


def _paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).withColumn("para_idx", F.col("line_order")).withColumn("line_count", F.lit(1))
    return rows.withColumn("norm_text", tx.normalized("text"))


def _literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _values(rows: list[tuple], schema: str) -> str:
    """The same literal rows in SQL."""

    def one(v: object) -> str:
        return "NULL" if v is None else f"'{v.replace(chr(39), chr(39) * 2)}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(v)

    names = ", ".join(c.split()[0] for c in schema.split(", "))
    return "(VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + f") AS v({names})"


LINES_SQL = r"""
raw AS (SELECT source AS doc_id, doc_id AS page_number, string_split(text, chr(10)) AS a FROM documents),
numbered AS (SELECT doc_id, page_number, len(a) * 24.0::DOUBLE AS page_height, generate_subscripts(a, 1) - 1 AS line_order, unnest(a) AS line FROM raw),
lines AS (
  SELECT doc_id, page_number, page_height, line_order, trim(regexp_replace(line, '\s+', ' ', 'g')) AS text,
         line_order * 24.0::DOUBLE AS y0, line_order * 24.0::DOUBLE + 12.0 AS y1
  FROM numbered WHERE trim(regexp_replace(line, '\s+', ' ', 'g')) <> ''),
occ AS (
  SELECT *, replace(lower(text), 'ß', 'ss') AS norm_text, length(text) AS n_chars,
         CASE WHEN y0 / page_height <= 0.15 THEN 'header' WHEN y1 / page_height >= 0.85 THEN 'footer' END AS region,
         CASE WHEN y0 / page_height <= 0.15 THEN y0 / page_height ELSE y1 / page_height END AS position
  FROM lines),
groups AS (
  SELECT doc_id, norm_text, region, count(DISTINCT page_number) AS n_pages, count(*) AS n_occurrences, max(position) - min(position) AS spread,
         median(n_chars) AS median_chars, arg_min(text, page_number * 100000 + line_order) AS text, min(page_number) AS first_page
  FROM occ WHERE region IS NOT NULL GROUP BY ALL),
passed AS (
  SELECT *, CASE WHEN median_chars <= 60 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS isolation,
         norm_text SIMILAR TO '[0-9]{1,3}|page\s+[0-9]{1,5}|page\s+[0-9]{1,5}\s+of\s+[0-9]{1,6}|[0-9]{1,5}\s*/\s*[0-9]{1,6}|-+\s*[0-9]{1,5}\s*-+' AS numbered
  FROM groups WHERE n_pages >= 3 AND spread <= 0.03 AND median_chars <= 160),
scored AS (
  SELECT *, round(0.45::DOUBLE * least(n_pages / 5.0::DOUBLE, 1.0) + 0.30::DOUBLE * greatest(0.0, 1.0 - least(spread / 0.03::DOUBLE, 1.0)) + 0.15::DOUBLE * isolation + 0.10::DOUBLE * CASE WHEN numbered THEN 1 ELSE 0 END, 4) AS confidence
  FROM passed),
furniture AS (SELECT * FROM scored WHERE confidence >= 0.5)
"""


def furniture_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = furniture.exact_groups(furniture.occurrences(_paragraphs(spark, sf_dir)))
    return found.select("doc_id", "region", "text", "first_page", "n_pages", "n_occurrences", "confidence", F.concat_ws(",", "reasons").alias("reasons"))


def furniture_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = furniture.detect(_paragraphs(spark, sf_dir))
    return found.select("doc_id", "region", "sequence", "text", "n_pages", "confidence")


def furniture_removed_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = furniture.without_furniture(_paragraphs(spark, sf_dir))
    return kept.groupBy("doc_id", "page_number").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("text")).alias("n_chars"))


FORMS = ["page 3 of 250", "Page 12", "4 / 10", "- 7 -", "42", "1234", "page", "12/3456", "--9--", "page 1 of", "x 3"]
FORMS_SCHEMA = "text string"


def page_number_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _literal(spark, [(x,) for x in FORMS], FORMS_SCHEMA).unionByName(_lines(spark, sf_dir).select("text").where(F.length("text") <= 24))
    norm = F.lower(tx.collapse(F.col("text")))
    return rows.select("text", numbers.page_template(norm).alias("template"), numbers.page_value(norm).alias("value")).distinct()


NUMBERED = [(d, p, i, t, y) for d in ("a", "b", "c") for p in range(1, 6) for i, t, y in (
    (0, {"a": f"{p}", "b": f"page {p} of 5", "c": f"{(p * 3) % 5}"}[d], 780.0), (1, "Running title", 20.0), (2, f"body text {p}", 400.0))]
NUMBERED_SCHEMA = "doc_id string, page_number bigint, para_idx int, text string, y0 double"


def _numbered(spark: SparkSession) -> DataFrame:
    rows = _literal(spark, NUMBERED, NUMBERED_SCHEMA)
    return rows.withColumns({"norm_text": F.lower("text"), "line_count": F.lit(1), "x0": F.lit(72.0), "x1": F.lit(140.0), "y1": F.col("y0") + 16.0, "page_width": F.lit(595.0), "page_height": F.lit(842.0)})


def page_number_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_numbers.detect(_numbered(spark)).select("doc_id", "page_number", "text", "value", "location", "removed", "confidence", F.concat_ws(",", "reasons").alias("reasons"))


def furniture_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return furniture.detect(_numbered(spark)).where("sequence").select("doc_id", F.col("key").alias("template"), "region", "n_pages", "confidence")


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", tx.clean_ocr(tx.nfc("text")).alias("clean"))


def ocr_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    # every second line end becomes a blank line
    text = F.regexp_replace("text", "\n([^\n]*)\n", "\n$1\n\n")
    return paragraphs.ocr_paragraphs(table(spark, sf_dir, "conversations"), text, ["conv_id", "turn"])


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.pages(_lines(spark, sf_dir))


def page_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("doc_id", "page_number", "char_count", "line_count", "all_in_bands", "has_meaningful_text", "classification")


def doc_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.documents(_pages(spark, sf_dir)).select("doc_id", "page_count", "text_page_count", "image_page_count", F.round("text_density", 6).alias("text_density"), "document_type", "type_by_pages")


RECTS = [("a", 1, 0.0, 0.0, 300.0, 400.0), ("a", 1, 100.0, 100.0, 595.0, 842.0), ("a", 2, 0.0, 0.0, 595.0, 842.0), ("b", 1, 50.0, 50.0, 40.0, 80.0), ("b", 2, 0.0, 0.0, 100.0, 100.0)]
RECTS_SCHEMA = "doc_id string, page_number bigint, x0 double, y0 double, x1 double, y1 double"


def image_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _literal(spark, RECTS, RECTS_SCHEMA).withColumn("page_width", F.lit(595.0)).withColumn("page_height", F.lit(842.0))
    return analysis.image_shares(rows).select("doc_id", "page_number", "image_count", F.round("image_area_ratio", 9).alias("image_area_ratio"))


BLOCKS = [("p", pg, k, *b) for pg, page in enumerate([
    [(72.0, 100.0, 280.0, 140.0), (320.0, 102.0, 530.0, 142.0), (72.0, 150.0, 280.0, 190.0), (320.0, 152.0, 530.0, 192.0), (72.0, 40.0, 530.0, 80.0)],
    [(72.0, 100.0, 200.0, 120.0), (210.0, 104.0, 300.0, 124.0), (72.0, 130.0, 300.0, 150.0)],
    [(72.0, 60.0, 520.0, 90.0), (72.0, 100.0, 520.0, 130.0)],
], 1) for k, b in enumerate(page)]
BLOCKS_SCHEMA = "doc_id string, page_number bigint, block_order int, x0 double, y0 double, x1 double, y1 double"


def row_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_order.rows(_literal(spark, BLOCKS, BLOCKS_SCHEMA)).select("doc_id", "page_number", "block_order", "row_index")


def page_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_order.order_blocks(_literal(spark, BLOCKS, BLOCKS_SCHEMA))


def column_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reading_order.order_blocks(_literal(spark, BLOCKS, BLOCKS_SCHEMA))
    return rows.groupBy("doc_id", "page_number", "column_index").agg(F.count(F.lit(1)).alias("n_blocks"), F.min("block_order").alias("first_block")).drop("column_index")


def _html_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.html_lines(table(spark, sf_dir, "pages")).withColumn("para_idx", F.col("line_order")).withColumn("line_count", F.lit(1))
    return rows.withColumn("spans", F.array(F.struct("font_name", "font_size", "font_flags", (F.col("y1") - F.col("y0")).alias("height"))))


def _styled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents, the first of each page larger and bold."""
    first = F.col("line_order") == 0
    rows = _lines(spark, sf_dir).withColumns({"para_idx": F.col("line_order"), "line_count": F.lit(1), "font_size": F.when(first, 18.0).otherwise(12.0), "font_name": F.when(first, "Times-Bold").otherwise("Times"), "font_flags": F.when(first, 16).otherwise(0)})
    return rows.withColumn("spans", F.array(F.struct("font_name", "font_size", "font_flags", F.lit(12.0).alias("height"))))


def heading_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headings.classify(_styled(spark, sf_dir)).select("doc_id", "page_number", "para_idx", F.round("score", 6).alias("score"), F.concat_ws(",", "reasons").alias("reasons"), "is_heading")


def html_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headings.classify(_html_paragraphs(spark, sf_dir)).groupBy("doc_id").agg(F.count_if("is_heading").alias("n_headings"), F.count(F.lit(1)).alias("n_paragraphs"))


TITLES = ["Chapter 1", "Chapter IV", "CHAPTER Twelve", "Part 2: The Road", "Chapter I: Title", "Partial results", "XIV", "one hundred and two", "twenty-one", "7", "Contents", "Epilogue", "chapter 12 - end", "mix", "Part One"]
TITLE_WANTED = [("Chapter 1", "chapter", "1", "arabic", 1), ("Chapter IV", "chapter", "IV", "roman", 4), ("CHAPTER Twelve", "chapter", "Twelve", "word", 12), ("Part 2: The Road", "part", "2", "arabic", 2),
                ("Chapter I: Title", "chapter", None, None, None), ("Partial results", "part", None, None, None), ("XIV", None, "xiv", "roman", 14), ("one hundred and two", None, "one hundred and two", "word", 102),
                ("twenty-one", None, "twenty-one", "word", 21), ("7", None, "7", "arabic", 7), ("Contents", None, None, None, None), ("Epilogue", None, None, None, None), ("chapter 12 - end", "chapter", "12", "arabic", 12),
                ("mix", None, "mix", "roman", 1009), ("Part One", "part", "One", "word", 1)]


def _headings(spark: SparkSession) -> DataFrame:
    rows = [("t", 2 * k, k + 1, t, 18.0, True, False) for k, t in enumerate(TITLES)] + [("n", 3 * k, k + 1, t, 20.0, False, True) for k, t in enumerate(["I", "II", "III", "The Sea", "The Shore"])]
    return _literal(spark, rows, "doc_id string, element_index int, page_number int, text string, font_size double, is_bold boolean, is_centred boolean").withColumn("norm_text", F.lower("text"))


def chapter_number_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chapters.parsed(_headings(spark).where("doc_id = 't'")).select("text", "keyword", "number", "number_type", "number_value")


def chapters_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chapters.detect(_headings(spark)).select("doc_id", "order", "text", "number", "number_type", F.concat_ws(",", "reasons").alias("reasons"))


def chapters_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = headings.classify(_html_paragraphs(spark, sf_dir)).where("is_heading")
    rows = found.withColumns({"element_index": F.col("page_number") * (1 << 31) + F.col("para_idx"), "norm_text": tx.normalized("text"), "font_size": F.col("median_size"), "is_bold": F.col("bold"), "is_centred": F.col("centred")})
    return chapters.toc(chapters.detect(rows)).select("doc_id", "title", "order", "page_number", "level")


def _cover_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents of each source as pages, with image areas from their ids."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("d"), F.col("source").alias("doc_id"), "text", F.lit(1).alias("image_count"), ((F.col("doc_id") * 7) % 11 / 10.0).alias("image_area_ratio"), F.lit(595.0).alias("page_width"), F.lit(842.0).alias("page_height"))
    return cover.signals(rows)


def cover_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of each book's first pages against the medians of all its pages; a limit per book goes before the shuffle."""
    found = _cover_signals(spark, sf_dir)
    numbered = found.withColumn("page_number", F.row_number().over(Window.partitionBy("doc_id").orderBy("d")))
    return cover.score(numbered, cover.page_medians(found))


def cover_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover.decide(cover_scores(spark, sf_dir))


def _assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of documents as image payloads of their source's book."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page_number"), F.lit(1).alias("xref"), F.encode("text", "UTF-8").alias("data"), F.lit("png").alias("ext"))


def dedup_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.assets(_assets(spark, sf_dir)).select("doc_id", "sha256", "asset_number", "first_page", "n_uses", "media_type", "n_bytes")


def merge_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents and one image on every third page, as a book's blocks."""
    found = _styled(spark, sf_dir).withColumn("is_heading", F.col("line_order") == 0)
    pictures = table(spark, sf_dir, "documents").where("doc_id % 3 = 0").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page_number"), F.lit(0).alias("placement_order"), F.lit(24.0).alias("y0"), F.sha2("text", 256).alias("sha256"))
    rows = assemble.blocks(assemble.elements(found, pictures), found.select("doc_id", "page_number").distinct())
    return compare.block_counts(rows).join(rows.groupBy("doc_id").agg(F.sum(F.when(F.col("kind") == "image", F.col("block_index")).otherwise(0)).alias("image_places")), "doc_id")


def route_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.element_at(F.array(F.lit("TEXT"), F.lit("SCANNED"), F.lit("MIXED")), (F.col("doc_id") % 3 + 1).cast("int")).alias("classification"))
    routed = analysis.route(docs, F.col("text"), lambda p: p.withColumn("ocr_text", F.concat(F.lit("OCR-TEXT-FOR-PAGE-"), F.col("doc_id").cast("string"))))
    return routed.select("doc_id", "classification", F.length("native_text").alias("native_chars"), "ocr_text")


def book_xhtml(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).withColumn("kind", F.when(F.col("line_order") == 0, "heading").otherwise("paragraph"))
    html = assemble.block_xhtml(F.col("kind"), F.col("text"), F.lit(2), F.lit(None).cast("string"), F.lit(""))
    rows = rows.select("doc_id", F.col("page_number").alias("chapter_index"), F.col("line_order").alias("block_index"), html.alias("xhtml"))
    return assemble.chapter_bodies(rows).select("doc_id", "name", F.md5("body").alias("body_md5"), F.length("body").alias("n_chars"))


NAMES = [(1, "png", "89504E470D0A1A0A00"), (12, "", "FFD8FFE000"), (103, "JPEG", "00"), (7, "xyz", "474946383961"), (2, "", "00")]
NAMES_SCHEMA = "number int, ext string, head string"


def resource_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _literal(spark, NAMES, NAMES_SCHEMA).withColumn("media_type", mime(F.col("ext"), F.unhex("head")))
    return rows.select("number", "media_type", F.concat(F.format_string("image-%03d.", "number"), extension_of(F.col("media_type"))).alias("image"), chapter_name(F.col("number")).alias("chapter"))


META = [("a", "Given", "", ""), ("b", "", "", "fr"), ("c", "  ", None, "de"), ("d", "  kept as it is ", "\t", "\u00a0")]
META_SCHEMA = "doc_id string, title string, author string, language string"
FOUND = [("a", "Found", "Ann", "en"), ("b", "From file", "  ", "en"), ("c", "", "Bo", "en"), ("d", "unused", " Cy ", "\n")]


def metadata_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.metadata(_literal(spark, META, META_SCHEMA), _literal(spark, FOUND, META_SCHEMA), ("title", "author", "language"))


def _books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(convert.books(convert.reconstruct(_lines(spark, sf_dir))))


def epub_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = stored(epub.facts(_books(spark, sf_dir), F.col("doc_id"), F.col("epub")))
    return epub_validate.verdicts(facts, epub_validate.issues(facts))


def epub_refs_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of packaged books damaged by their number: cut short, or empty."""
    books = _books(spark, sf_dir)
    hurt = books.select("doc_id", F.expr("CASE WHEN length(doc_id) % 2 = 0 THEN substring(epub, 1, 100) ELSE CAST('' AS BINARY) END").alias("epub"))
    facts = stored(epub.facts(hurt, F.col("doc_id"), F.col("epub")))
    return epub_validate.issues(facts).select("artifact", "layer", "code", "severity")


CSS = [("a", "p { background: url('x.png') } @import \"b.css\"; i { background: url(x.png) url(data:abc) }"), ("b", "p {}")]


def css_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _literal(spark, CSS, "name string, css string").select("name", F.concat_ws(",", css_references(F.col("css"))).alias("refs"))


OBSERVED = [("f", "pages", "6"), ("f", "title", "A Novel"), ("f", "text", "one two three"), ("f", "extra", "1"), ("g", "valid", "True"), ("g", "size", "12")]
EXPECTED = [("f", "pages", "exact", "6"), ("f", "title", "contains", "Novel"), ("f", "text", "ordered_sequence", "one|three"), ("g", "valid", "boolean", "true"), ("g", "size", "minimum", "20"), ("g", "lost", "maximum", "3")]


def quality_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.evaluate(_literal(spark, OBSERVED, "fixture string, metric string, value string"), _literal(spark, EXPECTED, "fixture string, metric string, type string, wanted string")).select("fixture", "metric", "outcome")


SAMPLES = [("a", 1.0), ("a", 2.0), ("a", 1.5), ("b", 4.0), ("b", 3.0), ("b", 9.0)]
BASELINE = [("a", 1.4), ("b", 2.0)]


def perf_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.timings(_literal(spark, SAMPLES, "fixture string, seconds double"), _literal(spark, BASELINE, "fixture string, seconds double"))


def stream_pages_batch_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page analysis of documents read as a stream of files; the same rows as ``page_analysis``."""
    base = stored(spark.range(0)).inputFiles()  # sees to the shared folder
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get() if base is not None else tempfile.gettempdir()
    source = f"{folder}/stream-in-{spark.sparkContext.startTime}-{id(base)}"
    table(spark, sf_dir, "documents").write.mode("overwrite").parquet(source)
    schema = table(spark, sf_dir, "documents").schema
    stream = streaming.page_stream(spark, source, schema)

    def analyse(batch: DataFrame) -> DataFrame:
        lines = adapters.text_lines(batch, book=F.col("source"), page=F.col("doc_id"), text=F.col("text"))
        return analysis.pages(lines).select("doc_id", "page_number", "char_count", "line_count", "all_in_bands", "has_meaningful_text", "classification")

    query = streaming.run_batches(stream, analyse, f"{source}-out", f"{source}-state")
    query.awaitTermination()
    return spark.read.parquet(f"{source}-out").drop("batch")


QUERIES = {f.__name__: f for f in (
    furniture_exact, furniture_all, furniture_removed_body, page_number_forms, page_number_sequences, furniture_sequences, clean_text, ocr_paragraphs, page_analysis, doc_classify,
    image_coverage, row_grouping, page_order, column_components, heading_score, html_headings, chapter_number_parse, chapters_detect, chapters_of_pages, cover_scores, cover_decide,
    dedup_assets, merge_elements, route_pages, book_xhtml, resource_names, metadata_resolve, epub_valid, epub_refs_issues, css_refs, quality_compare, perf_compare, stream_pages_batch_eq,
)}
