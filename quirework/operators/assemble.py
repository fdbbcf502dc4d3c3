"""From paragraphs and images to a book's blocks, and from blocks to XHTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.files import chapter_name, image_name
from ..functions.text import escape_html, first_filled, is_blank


def elements(paragraphs: DataFrame, images: DataFrame) -> DataFrame:
    """Paragraphs and placed images of each page, by height on the page, text before images at one height.

    Recognised paragraphs have no height and come last. ``paragraphs``: doc_id, page_number,
    para_idx, text, y0, is_heading; ``images``: doc_id, page_number, placement_order, y0, sha256.
    """
    texts = paragraphs.select(
        "doc_id", "page_number", F.coalesce(F.col("y0"), F.lit(float("inf"))).alias("top"), F.lit(0).alias("after_text"), F.col("para_idx").cast("bigint").alias("idx"),
        F.when(F.col("is_heading"), "heading").otherwise("paragraph").alias("kind"), "text", F.lit(None).cast("string").alias("sha256"),
    )
    pictures = images.select("doc_id", "page_number", F.col("y0").alias("top"), F.lit(1).alias("after_text"), F.col("placement_order").cast("bigint").alias("idx"), F.lit("image").alias("kind"), F.lit(None).cast("string").alias("text"), "sha256")
    return texts.unionByName(pictures)


def blocks(page_elements: DataFrame, pages: DataFrame) -> DataFrame:
    """A book's blocks in order: a page break before every page but the first, then the page's elements; blank text gives none."""
    first = pages.groupBy("doc_id").agg(F.min("page_number").alias("first_page")).withColumnRenamed("doc_id", "fd")
    breaks = pages.join(first, F.col("doc_id") == F.col("fd")).where("page_number > first_page").select(
        "doc_id", "page_number", F.lit(float("-inf")).alias("top"), F.lit(-1).alias("after_text"), F.lit(0).cast("bigint").alias("idx"), F.lit("page_break").alias("kind"),
        F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("sha256"),
    )
    kept = page_elements.where((F.col("kind") == "image") | ~is_blank(F.col("text"))).unionByName(breaks)
    order = Window.partitionBy("doc_id").orderBy("page_number", "top", "after_text", "idx")
    return kept.select("doc_id", (F.row_number().over(order) - 1).alias("block_index"), "kind", "text", F.when(F.col("kind") == "heading", 1).alias("level"), "page_number", "sha256")


def block_xhtml(kind: Column, text: Column, level: Column, image: Column, alt: Column) -> Column:
    n = F.least(F.greatest(F.coalesce(level, F.lit(1)), F.lit(1)), F.lit(6)).cast("string")
    body = escape_html(F.coalesce(text, F.lit("")))
    return (
        F.when(kind == "heading", F.concat(F.lit("<h"), n, F.lit(">"), body, F.lit("</h"), n, F.lit(">")))
        .when(kind == "page_break", F.lit('<div class="page-break"></div>'))
        .when(kind == "image", F.concat(F.lit('<img src="images/'), image, F.lit('" alt="'), escape_html(F.coalesce(alt, F.lit(""))), F.lit('"/>')))
        .otherwise(F.concat(F.lit("<p>"), body, F.lit("</p>")))
    )


def chapter_bodies(rendered: DataFrame) -> DataFrame:
    """(doc_id, chapter_index, name, body): the blocks' ``xhtml`` of a chapter, a line each."""
    g = rendered.groupBy("doc_id", "chapter_index").agg(F.sort_array(F.collect_list(F.struct("block_index", "xhtml"))).alias("all"))
    return g.select("doc_id", "chapter_index", chapter_name(F.col("chapter_index")).alias("name"), F.concat_ws("\n", F.transform("all", lambda x: x.xhtml)).alias("body"))


def image_resources(image_blocks: DataFrame) -> DataFrame:
    """The resource name of each image block: one name for each asset."""
    return image_blocks.withColumn("name", image_name(F.col("asset_number"), F.col("chapter_index"), F.col("block_index"), F.col("media_type")))


def metadata(explicit: DataFrame, found: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Each field as given, else as found in the file, else empty; blank values count as missing, others stay as they are."""
    f = found.select(F.col("doc_id").alias("fd"), *[F.col(c).alias(f"found_{c}") for c in fields])
    rows = explicit.join(f, F.col("doc_id") == F.col("fd"), "left")
    filled = lambda c: F.when(~is_blank(F.col(c)), F.col(c))
    return rows.select("doc_id", *[first_filled(filled(c), filled(f"found_{c}")).alias(c) for c in fields])


def package_metadata(meta: DataFrame) -> DataFrame:
    """What the package says where the book says nothing."""
    title = first_filled(F.col("title"), F.lit("Untitled Book"))
    return meta.select("doc_id", title.alias("title"), first_filled(F.col("language"), F.lit("en")).alias("language"), first_filled(F.col("identifier"), F.col("title"), F.lit("book")).alias("identifier"))
