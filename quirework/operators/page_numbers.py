"""Printed page numbers at a page's edge: which there are, and which can be removed.

Explicit forms ("page 3", "3 / 10", "- 3 -") always go; bare numbers go only as a sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .furniture import TOLERANCE, occurrences

MIN_SEQUENCE_PAGES = 2
PLACE = ["doc_id", "region"]


def candidates(paragraphs: DataFrame) -> DataFrame:
    """Page-number-like paragraphs at an edge; headings (``is_heading``, if there) are none."""
    rows = paragraphs.where("NOT is_heading") if "is_heading" in paragraphs.columns else paragraphs
    return occurrences(rows).where("region IS NOT NULL AND template IS NOT NULL")


def detect(paragraphs: DataFrame) -> DataFrame:
    """Every candidate with ``removed``, ``confidence`` and ``reasons``.

    Bare numbers at one edge are a sequence when the first of each page, on two pages or more, are
    not all one number, go in one direction, and stay within the tolerance of one height.
    """
    found = candidates(paragraphs)
    by_page = Window.partitionBy("doc_id", "region", "page_number").orderBy("para_idx")
    bare = found.where("template = 'n'").withColumn("rank", F.row_number().over(by_page)).where("rank = 1")
    bare = bare.withColumn("before", F.lag("value").over(Window.partitionBy(*PLACE).orderBy("page_number")))
    runs = bare.groupBy(*PLACE).agg(
        F.count(F.lit(1)).alias("pages"), F.count_distinct("value").alias("values"), (F.max("position") - F.min("position")).alias("spread"),
        F.bool_and(F.coalesce(F.col("value") >= F.col("before"), F.lit(True))).alias("up"), F.bool_and(F.coalesce(F.col("value") <= F.col("before"), F.lit(True))).alias("down"),
    )
    runs = runs.where((F.col("pages") >= MIN_SEQUENCE_PAGES) & (F.col("values") >= MIN_SEQUENCE_PAGES) & (F.col("up") | F.col("down")) & (F.col("spread") <= TOLERANCE))
    in_run = bare.join(runs.select(F.col("doc_id").alias("rd"), F.col("region").alias("rr")), (F.col("doc_id") == F.col("rd")) & (F.col("region") == F.col("rr")), "left_semi")
    in_run = in_run.select(F.col("doc_id").alias("sd"), F.col("page_number").alias("sp"), F.col("para_idx").alias("si"))
    rows = found.join(in_run, (F.col("doc_id") == F.col("sd")) & (F.col("page_number") == F.col("sp")) & (F.col("para_idx") == F.col("si")), "left")
    explicit, sequence = F.col("template") != "n", F.col("sd").isNotNull()
    form = (
        F.when(F.col("template") == "page n", "page_n").when(F.col("template").startswith("page n of"), "page_n_of_total")
        .when(F.col("template").startswith("n /"), "n_over_total").when(F.col("template") == "- n -", "dashed_n").otherwise("bare_number")
    )
    place = F.concat(F.lit("position_in_"), F.col("region"), F.lit("_region"))
    named = F.concat(F.lit("form:"), form)
    reasons = (
        F.when(explicit, F.array(F.lit("page_number_pattern"), place, named, F.lit("explicit_page_number_form")))
        .when(sequence, F.array(F.lit("page_number_pattern"), place, F.lit("bare_number_sequence"), F.lit("positional_consistency")))
        .otherwise(F.array(F.lit("page_number_pattern"), place, named, F.lit("insufficient_sequence_evidence")))
    )
    return rows.select(
        "doc_id", "page_number", "para_idx", "text", "value", F.col("region").alias("location"), "template", (explicit | sequence).alias("removed"),
        F.when(explicit, 1.0).when(sequence, 0.9).otherwise(0.5).alias("confidence"), reasons.alias("reasons"), F.round("position", 6).alias("edge"),
    )


def without_page_numbers(paragraphs: DataFrame) -> DataFrame:
    gone = detect(paragraphs).where("removed").select(F.col("doc_id").alias("nd"), F.col("page_number").alias("np"), F.col("para_idx").alias("ni"))
    return paragraphs.join(gone, (F.col("doc_id") == F.col("nd")) & (F.col("page_number") == F.col("np")) & (F.col("para_idx") == F.col("ni")), "left_anti")
