"""Headings by many small signals: size, weight, family, place, space around, length.

Input rows are paragraphs with ``spans`` (font_name, font_size, font_flags, height of each). Page
baselines are windows over the page; the score is one projection that adds in a fixed order, because
sums of doubles decide at the threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import valid_box

LARGE_RATIO, STRONG_RATIO, EDGE, CENTRED_SHARE, CENTRED_BY = 1.25, 1.5, 72.0, 0.6, 4.0
SPACE_MIN, SPACE_BY_LINE, SPACE_BY_GAP = 18.0, 1.75, 1.25
VERY_SHORT, SHORT, LONG, MIN_SIGNALS, MIN_SCORE = 30, 80, 180, 2, 2.5
PAGE = ["doc_id", "page_number"]


def _flag(s: Column, bit: int) -> Column:
    return s.font_flags.bitwiseAND(F.lit(bit)) != 0


def _median(values: Column) -> Column:
    """The middle of an array, or the mean of the two; null for an empty one."""
    v, n = F.sort_array(values), F.size(values)
    return F.when(n > 0, (F.get(v, F.floor((n - 1) / 2).cast("int")) + F.get(v, F.floor(n / 2).cast("int"))) / 2)


def _modal(names: Column) -> Column:
    """The most frequent of an array; of those, the one that comes first."""
    counted = F.transform(F.array_distinct(names), lambda x: F.struct(F.size(F.filter(names, lambda y: y == x)).alias("n"), (-F.array_position(names, x)).alias("at"), x.alias("name")))
    return F.array_max(counted)["name"]


def metrics(paragraphs: DataFrame) -> DataFrame:
    sizes = F.filter(F.transform("spans", lambda s: s.font_size), lambda x: x > 0)
    families = F.filter(F.transform("spans", lambda s: s.font_name), lambda x: x.isNotNull() & (x != ""))
    heavy = lambda s: F.lower(F.coalesce(s.font_name, F.lit(""))).rlike("bold|black|heavy")
    slanted = lambda s: F.lower(F.coalesce(s.font_name, F.lit(""))).rlike("italic|oblique")
    boxed = valid_box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    width, right = F.col("x1") - F.col("x0"), F.col("page_width") - F.col("x1")
    return paragraphs.withColumns(
        {
            "boxed": boxed,
            "median_size": _median(sizes), "max_size": F.array_max(sizes), "families": families, "family": _modal(families),
            "bold_flag": F.exists("spans", lambda s: _flag(s, 16)), "bold": F.exists("spans", lambda s: _flag(s, 16) & heavy(s)),
            "italic": F.exists("spans", lambda s: _flag(s, 2) | slanted(s)), "n_chars": F.length("text"),
            "centred": boxed & (F.col("page_width") > 0) & (width <= CENTRED_SHARE * F.col("page_width")) & (F.abs(F.col("x0") - right) <= CENTRED_BY),
            "near_edge": boxed & ((F.col("y0") < EDGE) | (F.col("page_height") - F.col("y1") < EDGE)),
        }
    )


def classify(paragraphs: DataFrame) -> DataFrame:
    """``score``, ``reasons`` and ``is_heading`` for every paragraph (and the columns they come from)."""
    order = Window.partitionBy(*PAGE).orderBy("para_idx")
    page = Window.partitionBy(*PAGE)
    p = metrics(paragraphs)
    bottom = F.when(F.col("boxed"), F.col("y1"))
    p = p.withColumn("last_bottom", F.last(bottom, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    p = p.withColumn("gap", F.when(F.col("boxed") & (F.col("y0") > F.col("last_bottom")), F.col("y0") - F.col("last_bottom")))
    heights = F.flatten(F.collect_list(F.transform("spans", lambda s: s.height)).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    families = F.flatten(F.collect_list("families").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    p = p.withColumns(
        {
            "base_size": F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY median_size) OVER (PARTITION BY doc_id, page_number)"),
            "base_family": _modal(families),
            "line_height": F.coalesce(_median(F.filter(heights, lambda h: h > 0)), F.lit(1.0)),
            "median_gap": F.percentile("gap", 0.5).over(page),
            "above": F.when(F.col("boxed") & F.lag("boxed").over(order), F.greatest(F.lit(0.0), F.col("y0") - F.lag("y1").over(order))),
            "below": F.when(F.col("boxed") & F.lead("boxed").over(order), F.greatest(F.lit(0.0), F.lead("y0").over(order) - F.col("y1"))),
        }
    )
    space = F.greatest(F.lit(SPACE_MIN), F.lit(SPACE_BY_LINE) * F.col("line_height"), F.coalesce(F.lit(SPACE_BY_GAP) * F.col("median_gap"), F.lit(0.0)))
    ratio = F.try_divide("median_size", "base_size")
    before, after = (F.coalesce(F.col(c) >= space, F.lit(False)) for c in ("above", "below"))
    big = F.coalesce(ratio >= LARGE_RATIO, F.lit(False))
    alone = (before & after) | ((before | after) & (F.col("centred") | F.col("bold") | big))
    short = F.col("n_chars") <= SHORT
    # in the order in which they are added
    signals = [
        (F.coalesce(ratio >= STRONG_RATIO, F.lit(False)), 1.5, "font_size_strongly_above_body_baseline"),
        (big & (ratio < STRONG_RATIO), 1.0, "font_size_above_body_baseline"),
        (F.coalesce(F.try_divide("max_size", "median_size") >= STRONG_RATIO, F.lit(False)), 0.5, "mixed_font_size_contrast"),
        (F.col("bold"), 1.0, "bold_typography"),
        (F.col("bold_flag") & ~F.col("bold"), 0.45, "bold_font_flag"),
        (F.col("italic"), 0.35, "italic_typography"),
        (F.coalesce(F.col("family") != F.col("base_family"), F.lit(False)), 0.45, "font_family_change"),
        (F.col("centred"), 0.65, "centered_alignment"),
        (before, 0.75, "large_spacing_before"),
        (after, 0.75, "large_spacing_after"),
        (alone, 0.5, "isolated_paragraph"),
        (F.col("n_chars") <= VERY_SHORT, 0.25, "very_short_paragraph"),
        (short & (F.col("n_chars") > VERY_SHORT), 0.25, "short_paragraph"),
        ((F.col("line_count") > 1) & short & (F.col("centred") | F.col("bold") | before | after), 0.25, "multi_line_heading_shape"),
        (F.col("near_edge"), 0.2, "page_edge_proximity"),
        (F.col("n_chars") > LONG, -1.0, "long_paragraph"),
    ]
    score = F.lit(0.0)
    for on, points, _ in signals:
        score = score + F.when(on, F.lit(points)).otherwise(0.0)
    reasons = F.array_compact(F.array(*[F.when(on, name) for on, _, name in signals]))
    p = p.withColumn("reasons", reasons).withColumn("score", score)
    none = F.size("reasons") == 0
    p = p.withColumn("is_heading", (F.size("reasons") >= MIN_SIGNALS) & (F.col("score") >= MIN_SCORE))
    p = p.withColumn("score", F.when(none, F.lit(-0.5)).otherwise(F.col("score")))
    return p.withColumn("reasons", F.when(none, F.array(F.lit("body_like_typography"))).otherwise(F.col("reasons")))
