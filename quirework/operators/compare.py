"""Comparing observations with expectations, and timings with a baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def evaluate(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """Every (fixture, metric) of either side with its outcome.

    ``observed``: fixture, metric, value (text). ``expected``: fixture, metric, type, wanted
    (text; for an ordered sequence its members joined by "|"). Types: exact, minimum, maximum,
    boolean, contains, excludes, ordered_sequence. What one side lacks is ``missing``.
    """
    o = observed.select("fixture", "metric", "value")
    both = o.join(expected.select("fixture", "metric", "type", "wanted"), ["fixture", "metric"], "full_outer")
    number, goal = F.col("value").try_cast("double"), F.col("wanted").try_cast("double")
    rest = F.aggregate(
        F.split("wanted", r"\|"), F.col("value"),
        lambda left, part: F.when(F.instr(left, part) > 0, F.substr(left, F.instr(left, part) + F.length(part))),
    )
    met = (
        F.when(F.col("type").isin("exact", "boolean"), F.lower("value") == F.lower("wanted"))
        .when(F.col("type") == "minimum", number >= goal)
        .when(F.col("type") == "maximum", number <= goal)
        .when(F.col("type") == "contains", F.contains("value", "wanted"))
        .when(F.col("type") == "excludes", ~F.contains("value", "wanted"))
        .when(F.col("type") == "ordered_sequence", rest.isNotNull())
    )
    outcome = F.when(F.col("value").isNull(), "missing_observation").when(F.col("type").isNull(), "missing_expectation").when(F.coalesce(met, F.lit(False)), "pass").otherwise("fail")
    return both.select("fixture", "metric", "value", "type", "wanted", outcome.alias("outcome"))


def timings(samples: DataFrame, baseline: DataFrame, tolerance: float = 0.25) -> DataFrame:
    """Median, least and most seconds of each fixture against ``baseline`` (fixture, seconds): FAIL beyond the tolerance."""
    g = samples.groupBy("fixture").agg(F.percentile("seconds", 0.5).alias("median_s"), F.min("seconds").alias("min_s"), F.max("seconds").alias("max_s"))
    b = baseline.select(F.col("fixture").alias("bf"), F.col("seconds").alias("baseline_s"))
    rows = g.join(b, F.col("fixture") == F.col("bf"))
    return rows.select("fixture", "median_s", "min_s", "max_s", "baseline_s", F.when(F.col("median_s") > F.col("baseline_s") * (1 + tolerance), "FAIL").otherwise("PASS").alias("outcome"))


def block_counts(blocks: DataFrame) -> DataFrame:
    """Blocks of each document by kind."""
    return blocks.groupBy("doc_id").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("paragraph", "heading", "image", "page_break")])


def same_members(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that only one side has."""
    return left.exceptAll(right).withColumn("only_in", F.lit("left")).unionByName(right.exceptAll(left).withColumn("only_in", F.lit("right")))
