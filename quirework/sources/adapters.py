"""Line tables from inputs without geometry: plain text, web pages, JSON manifests.

The canonical line row is (doc_id, page_number, block_order, line_order, text, x0, y0, x1, y1,
page_width, page_height, font_name, font_size, font_flags), one row per line of text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import collapse, is_blank

LINE_STEP, LINE_HEIGHT, LEFT, CHAR_WIDTH, PAGE_WIDTH = 24.0, 12.0, 72.0, 6.0, 612.0


def text_lines(texts: DataFrame, *, book: Column, page: Column, text: Column) -> DataFrame:
    """Each text is a page of a book; line i of n stands at y = 24 i on a page 24 n high.

    Page numbers are given, so no shuffle is needed; blank lines take their place on the page but
    give no row.
    """
    rows = texts.select(book.cast("string").alias("doc_id"), page.cast("bigint").alias("page_number"), F.split(text, "\n").alias("all"))
    rows = rows.select("doc_id", "page_number", (F.size("all") * F.lit(LINE_STEP)).alias("page_height"), F.posexplode("all").alias("line_order", "text"))
    y0 = F.col("line_order") * F.lit(LINE_STEP)
    return rows.where(~is_blank(F.col("text"))).select(
        "doc_id", "page_number", F.col("line_order").alias("block_order"), "line_order", collapse(F.col("text")).alias("text"),
        F.lit(LEFT).alias("x0"), y0.alias("y0"), (F.lit(LEFT) + F.length(collapse(F.col("text"))) * CHAR_WIDTH).alias("x1"), (y0 + LINE_HEIGHT).alias("y1"),
        F.lit(PAGE_WIDTH).alias("page_width"), "page_height", F.lit("Helvetica").alias("font_name"), F.lit(12.0).alias("font_size"), F.lit(0).alias("font_flags"),
    )


HTML_PART = r"(?is)<(h[1-6]|p|li|footer)\b[^>]*>(.*?)(?=</\1\s*>|<(?:h[1-6]|p|li|footer|/article|/ul|/ol|/body|/footer)\b)"
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&#x27;": "'", "&amp;": "&"}


def html_lines(pages: DataFrame, *, html: str = "html", url: str = "url", page_id: str = "page_id") -> DataFrame:
    """Headings, paragraphs, items and footers of web pages as lines of a book named by host.

    Headings are 24 point bold, the rest 12 point. Scripts, styles and comments are left out first;
    an unclosed element ends where the next begins.
    """
    body = F.regexp_replace(F.col(html), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", "")
    parts = F.zip_with(F.regexp_extract_all(body, F.lit(HTML_PART), F.lit(1)), F.regexp_extract_all(body, F.lit(HTML_PART), F.lit(2)), lambda t, x: F.struct(F.lower(t).alias("tag"), x.alias("text")))
    rows = pages.select(F.regexp_extract(url, r"^[a-z]+://([^/:?#]+)", 1).alias("doc_id"), F.col(page_id).alias("page_number"), F.posexplode(parts).alias("line_order", "part"))
    text = F.regexp_replace(F.col("part.text"), r"(?s)<[^>]*>", " ")
    for entity, char in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    head = F.col("part.tag").startswith("h")
    size = F.when(head, 24.0).otherwise(12.0)
    rows = rows.withColumn("text", collapse(text)).where(F.length("text") > 0)
    y0 = F.col("line_order") * F.lit(2 * LINE_STEP)
    return rows.select(
        "doc_id", "page_number", F.col("line_order").alias("block_order"), "line_order", F.col("part.tag").alias("tag"), "text",
        F.lit(LEFT).alias("x0"), y0.alias("y0"), (F.lit(LEFT) + F.length("text") * CHAR_WIDTH).alias("x1"), (y0 + size).alias("y1"),
        F.lit(PAGE_WIDTH).alias("page_width"), F.lit(792.0).alias("page_height"),
        F.when(head, "Helvetica-Bold").otherwise("Helvetica").alias("font_name"), size.alias("font_size"), F.when(head, 16).otherwise(0).alias("font_flags"),
    )


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a corpus manifest, one row each."""
    return spark.read.json(path, multiLine=True).select(F.explode("documents").alias("d")).select("d.*")
