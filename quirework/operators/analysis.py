"""Page and document classes, image coverage, and which way each page is read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import non_ws_count, positive

MEANINGFUL_CHARS, BAND, IMAGE_SHARE, TEXT_FROM, MIXED_ABOVE = 24, 0.15, 0.5, 0.8, 0.2


def page_class(meaningful: Column, image_share: Column) -> Column:
    return F.when(meaningful & (image_share < IMAGE_SHARE), "TEXT").when(meaningful, "MIXED").otherwise("SCANNED")


def image_shares(images: DataFrame) -> DataFrame:
    """(doc_id, page_number, image_count, image_area_ratio) from placed rectangles; overlaps count twice, the sum at most 1."""
    area = positive(F.col("page_width")) * positive(F.col("page_height"))
    one = F.greatest(F.lit(0.0), F.col("x1") - F.col("x0")) * F.greatest(F.lit(0.0), F.col("y1") - F.col("y0"))
    g = images.groupBy("doc_id", "page_number").agg(F.count(F.lit(1)).alias("image_count"), F.sum(one).alias("covered"), F.max(area).alias("area"))
    return g.select("doc_id", "page_number", "image_count", F.coalesce(F.least(F.lit(1.0), F.try_divide("covered", "area")), F.lit(0.0)).alias("image_area_ratio"))


def pages(lines: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """One row per page: longest line, whether its text is meaningful, images, class.

    Meaningful text has a line of 24 characters (not counting whitespace) and isn't all in the
    bands at the top and bottom. ``images`` is a result of ``image_shares``; pages in it without
    lines count too.
    """
    n = non_ws_count(F.col("text"))
    middle, height = (F.col("y0") + F.col("y1")) / 2, positive(F.col("page_height"))
    edge = (middle <= BAND * height) | (middle >= (1.0 - BAND) * height)
    g = lines.groupBy("doc_id", "page_number").agg(
        F.max(n).alias("char_count"), F.count(F.lit(1)).alias("line_count"), F.coalesce(F.bool_and(edge), F.lit(False)).alias("all_in_bands")
    )
    if images is not None:
        g = g.join(images, ["doc_id", "page_number"], "full_outer").na.fill(0, ["char_count", "line_count", "image_count", "image_area_ratio"]).na.fill(False, ["all_in_bands"])
    else:
        g = g.withColumn("image_count", F.lit(0).cast("bigint")).withColumn("image_area_ratio", F.lit(0.0))
    g = g.withColumn("has_meaningful_text", (F.col("char_count") >= MEANINGFUL_CHARS) & ~F.col("all_in_bands"))
    return g.withColumn("classification", page_class(F.col("has_meaningful_text"), F.col("image_area_ratio")))


def documents(page_rows: DataFrame) -> DataFrame:
    """One row per document: page counts, mean longest line, class by the share of meaningful pages."""
    g = page_rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("page_count"), F.count_if("has_meaningful_text").alias("text_page_count"),
        F.count_if(F.col("image_count") > 0).alias("image_page_count"), F.avg("char_count").alias("text_density"),
        F.min("classification").alias("least"), F.max("classification").alias("most"),
    )
    share = F.col("text_page_count") / F.col("page_count")
    kind = F.when(share >= TEXT_FROM, "TEXT").when(share > MIXED_ABOVE, "MIXED").otherwise("SCANNED")
    by_set = F.when(F.col("least") == F.col("most"), F.col("least")).otherwise("MIXED")
    return g.select("doc_id", "page_count", "text_page_count", "image_page_count", "text_density", kind.alias("document_type"), by_set.alias("type_by_pages"))


def route(page_rows: DataFrame, native: Column, recognise) -> DataFrame:
    """Native text for TEXT, recognised text for SCANNED, both for MIXED; never merged, null where not asked for.

    ``recognise(df)`` adds ``ocr_text``; it only gets the pages that need it, because a Python
    function under a condition would run for all rows.
    """
    text = page_rows.where("classification = 'TEXT'").withColumn("native_text", native).withColumn("ocr_text", F.lit(None).cast("string"))
    other = recognise(page_rows.where("classification <> 'TEXT'")).withColumn("native_text", F.when(F.col("classification") == "MIXED", native))
    return text.unionByName(other)
