"""Running headers and footers: text or page numbers that repeat near a page's edge.

Input rows are paragraphs: doc_id, page_number, para_idx, text, norm_text, line_count, x0, y0, x1, y1,
page_width, page_height. Each document's groups are aggregates over (document, text, region), so a
document of any length is combined before the shuffle and no document has to fit in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import page_template, page_value
from ..functions.text import clamp01, positive, valid_box
from ..session import stored

MIN_PAGES, EDGE, TOLERANCE, SATURATION = 3, 0.15, 0.03, 5
SHORT_CHARS, MAX_CHARS, MIN_CONFIDENCE = 60, 160, 0.5
GROUP = ["doc_id", "key", "region"]


def occurrences(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs with a box on pages with dimensions, and where on the page they are; ``region`` is null inside."""
    width, height = positive(F.col("page_width")), positive(F.col("page_height"))
    ok = width.isNotNull() & height.isNotNull() & valid_box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    rows = paragraphs.where(ok).withColumn("top", clamp01(F.col("y0") / height)).withColumn("bottom", clamp01(F.col("y1") / height))
    region = F.when(F.col("top") <= EDGE, "header").when(F.col("bottom") >= 1.0 - EDGE, "footer")
    return rows.select(
        "doc_id", "page_number", "para_idx", "text", "norm_text", "line_count", F.length("text").alias("n_chars"), region.alias("region"),
        F.when(region == "header", F.col("top")).otherwise(F.col("bottom")).alias("position"),
        clamp01((F.col("x0") + F.col("x1")) / (2.0 * width)).alias("x_center"),
        page_template(F.col("norm_text")).alias("template"), page_value(F.col("norm_text")).alias("value"),
    )


def confidence(pages: Column, spread: Column, isolation: Column, numbered: Column) -> Column:
    """Repetition and steadiness weigh most; alone on its line, short, and a page number a little."""
    repeated = F.least(pages / F.lit(float(SATURATION)), F.lit(1.0))
    steady = F.greatest(F.lit(0.0), F.lit(1.0) - F.least(spread / F.lit(TOLERANCE), F.lit(1.0)))
    return F.round(F.lit(0.45) * repeated + F.lit(0.30) * steady + F.lit(0.15) * isolation + F.lit(0.10) * numbered, 4)


def _groups(rows: DataFrame, sequence: bool) -> DataFrame:
    """Groups of (document, key, region) that pass the gates, with confidence and reasons."""
    g = rows.groupBy(*GROUP).agg(
        F.count_distinct("page_number").alias("n_pages"),
        F.count(F.lit(1)).alias("n_occurrences"),
        (F.max("position") - F.min("position")).alias("spread"),
        F.percentile("n_chars", 0.5).alias("median_chars"),
        F.bool_and(F.col("line_count") == 1).alias("single"),
        F.min(F.struct("page_number", "para_idx", "text")).alias("first"),
        F.percentile("position", 0.5).alias("position"),
        F.percentile("x_center", 0.5).alias("x_center"),
        F.bool_or(F.col("template").isNotNull()).alias("numbered"),
    )
    short = F.col("median_chars") <= SHORT_CHARS
    isolation = F.when(F.col("single") & short, 1.0).when(F.col("single") | short, 0.5).otherwise(0.0)
    g = g.where((F.col("n_pages") >= MIN_PAGES) & (F.col("spread") <= TOLERANCE) & (F.col("median_chars") <= MAX_CHARS))
    g = g.withColumn("confidence", confidence(F.col("n_pages"), F.col("spread"), isolation, F.col("numbered").cast("double")))
    reasons = F.array_compact(
        F.array(
            F.lit("repeated_across_pages"), F.concat(F.lit("position_in_"), F.col("region"), F.lit("_region")), F.lit("positional_consistency"),
            F.when(F.col("numbered"), "page_number_pattern"), F.when(F.lit(sequence), "page_number_sequence"), F.when(short, "short_text"), F.when(F.col("single"), "single_line"),
        )
    )
    return g.where(F.col("confidence") >= MIN_CONFIDENCE).select(
        *GROUP, F.lit(sequence).alias("sequence"), F.col("first.text").alias("text"), F.col("first.page_number").alias("first_page"), "n_pages", "n_occurrences", "position", "x_center", "confidence", reasons.alias("reasons")
    )


def exact_groups(found: DataFrame) -> DataFrame:
    return _groups(found.where("region IS NOT NULL").withColumn("key", F.col("norm_text")), False)


def members(found: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """The paragraphs of groups; groups are few, so the join is small on that side."""
    g = groups.select(F.col("doc_id").alias("gd"), F.col("key").alias("gk"), F.col("region").alias("gr"))
    return found.join(g, (F.col("doc_id") == F.col("gd")) & (F.col(key) == F.col("gk")) & (F.col("region") == F.col("gr")), "left_semi")


def sequence_groups(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Page numbers that change from page to page, in one direction, and aren't claimed as exact text."""
    g = exact.select(F.col("doc_id").alias("gd"), F.col("key").alias("gk"), F.col("region").alias("gr"))
    claimed = (F.col("doc_id") == F.col("gd")) & (F.col("norm_text") == F.col("gk")) & (F.col("region") == F.col("gr"))
    rows = found.where("region IS NOT NULL AND template IS NOT NULL").join(g, claimed, "left_anti").withColumn("key", F.col("template"))
    before = F.lag("value").over(Window.partitionBy(*GROUP).orderBy("page_number", "para_idx"))
    steps = rows.withColumn("before", before).groupBy(*GROUP).agg(
        F.bool_and(F.coalesce(F.col("value") >= F.col("before"), F.lit(True))).alias("up"), F.bool_and(F.coalesce(F.col("value") <= F.col("before"), F.lit(True))).alias("down"), (F.max("value") - F.min("value")).alias("range")
    )
    steady = steps.where("(up OR down) AND range >= 1")
    kept = rows.join(steady.select(*[F.col(c).alias(f"s_{c}") for c in GROUP]), (F.col("doc_id") == F.col("s_doc_id")) & (F.col("key") == F.col("s_key")) & (F.col("region") == F.col("s_region")), "left_semi")
    return _groups(kept, True)


def _edges(paragraphs: DataFrame) -> DataFrame:
    """Occurrences near the edges, written once, as they are read several times: what is inside a page is never normalised."""
    return stored(occurrences(paragraphs).where("region IS NOT NULL"))


def detect(paragraphs: DataFrame) -> DataFrame:
    """All headers and footers of all documents: exact texts and page-number sequences."""
    found = _edges(paragraphs)
    exact = exact_groups(found)
    return exact.unionByName(sequence_groups(found, exact))


def furniture_members(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, page_number, para_idx) of the paragraphs that are furniture."""
    found = _edges(paragraphs)
    exact = exact_groups(found)
    both = members(found, exact, "norm_text").unionByName(members(found, sequence_groups(found, exact), "template"))
    return both.select("doc_id", "page_number", "para_idx").distinct()


def without_furniture(paragraphs: DataFrame) -> DataFrame:
    keys = ["doc_id", "page_number", "para_idx"]
    gone = furniture_members(paragraphs).withColumnsRenamed({k: f"f_{k}" for k in keys})
    match = F.lit(True)
    for k in keys:
        match = match & (F.col(k) == F.col(f"f_{k}"))
    return paragraphs.join(gone, match, "left_anti")
