"""Image assets and where they are placed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.files import mime


def assets(images: DataFrame) -> DataFrame:
    """One row per document and distinct payload: sha256, number in order of first use (from 1), type, uses.

    Payloads are compared by digest before anything moves, so bytes are shuffled for no copy.
    """
    rows = images.select("doc_id", "page_number", "xref", F.sha2("data", 256).alias("sha256"), F.octet_length("data").alias("n_bytes"), mime(F.col("ext"), F.col("data")).alias("media_type"))
    g = rows.groupBy("doc_id", "sha256").agg(F.min(F.struct("page_number", "xref")).alias("first"), F.count(F.lit(1)).alias("n_uses"), F.min("media_type").alias("media_type"), F.max("n_bytes").alias("n_bytes"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("first", "sha256"))
    return g.select("doc_id", "sha256", number.alias("asset_number"), F.col("first.page_number").alias("first_page"), "n_uses", "media_type", "n_bytes")


def placements(images: DataFrame) -> DataFrame:
    """Placed images in page order, by rectangle, with their asset's digest."""
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_number", "y0", "x0", "y1", "x1", "xref"))
    return images.select("doc_id", "page_number", "xref", F.sha2("data", 256).alias("sha256"), "x0", "y0", "x1", "y1", (order - 1).alias("placement_order"))
