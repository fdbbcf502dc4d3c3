"""From line tables to books: the whole reconstruction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalized
from ..operators import assemble, furniture, headings, images as image_ops, paragraphs, reading_order
from ..session import stored
from ..sources import epub_write


def reconstruct(lines: DataFrame) -> DataFrame:
    """Classified paragraphs without furniture, of all documents.

    Doubled lines go, blocks are ordered, lines are folded into paragraphs, then headings are told
    and running headers and footers leave. Printed page numbers stay unless
    ``page_numbers.without_page_numbers`` is asked.
    """
    lines = reading_order.doubled_lines(lines)
    blocks = lines.groupBy("doc_id", "page_number", "block_order").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    order = reading_order.order_blocks(blocks).withColumnsRenamed({"doc_id": "od", "page_number": "op", "block_order": "ob"})
    ordered = lines.join(order, (F.col("doc_id") == F.col("od")) & (F.col("page_number") == F.col("op")) & (F.col("block_order") == F.col("ob")))
    keep = ["doc_id", "page_number", "para_idx", "text", "norm_text", "line_count", "x0", "y0", "x1", "y1", "page_width", "page_height", "is_heading", "score", "reasons"]
    # read several times below: written once
    found = stored(headings.classify(paragraphs.native_paragraphs(ordered)).withColumn("norm_text", normalized("text")).select(*keep))
    return stored(furniture.without_furniture(found))


def books(found: DataFrame, images: DataFrame | None = None, title: Column | None = None) -> DataFrame:
    """Packaged books of reconstructed paragraphs: one chapter each, as blocks in page order."""
    spark = found.sparkSession
    if images is None:
        images = spark.createDataFrame([], "doc_id string, page_number bigint, xref int, data binary, ext string, x0 double, y0 double, x1 double, y1 double")
    placed, assets = image_ops.placements(images), image_ops.assets(images)
    elements = assemble.elements(found, placed)
    rows = assemble.blocks(elements, found.select("doc_id", "page_number").distinct())
    named = assets.select(F.col("doc_id").alias("ad"), F.col("sha256").alias("ah"), "asset_number", "media_type")
    rows = rows.join(named, (F.col("doc_id") == F.col("ad")) & (F.col("sha256") == F.col("ah")), "left").withColumn("chapter_index", F.lit(1))
    rows = assemble.image_resources(rows)
    alt = F.format_string("image-%03d p%d", "asset_number", "page_number")
    rows = rows.withColumn("xhtml", assemble.block_xhtml(F.col("kind"), F.col("text"), F.col("level"), F.col("name"), alt))
    title = title if title is not None else F.col("doc_id")
    payload = images.groupBy("doc_id", F.sha2("data", 256).alias("h")).agg(F.min("data").alias("data")).withColumnRenamed("doc_id", "pd")
    files = assets.join(payload, (F.col("doc_id") == F.col("pd")) & (F.col("sha256") == F.col("h")))
    files = files.select("doc_id", F.struct(assemble.image_name(F.col("asset_number"), F.lit(1), F.lit(0), F.col("media_type")).alias("name"), "media_type", "data").alias("image"))
    texts = rows.select("doc_id", "block_index", "xhtml", title.alias("title"), F.lit("en").alias("language"), F.col("doc_id").alias("identifier"))
    return epub_write.build_from_blocks(texts, "chapter-01.xhtml", files)
