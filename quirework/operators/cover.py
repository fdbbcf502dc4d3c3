"""Choosing a cover page among the first pages of a book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import non_ws_count, split_lines, strip

WINDOW, MIN_IMAGE, FULL_IMAGE, UNTEXTED_IMAGE = 5, 0.5, 0.9, 0.75
TITLE_CHARS, TITLE_LINES, STANDOUT, BODY_CHARS, BODY_LINES = 120, 6, 0.5, 400, 12
CONFIDENT, MARGIN = 55.0, 12.0
# Points for the page's place, and words that mark front matter.
PLACE_POINTS = {1: 30.0, 2: 12.0, 3: 8.0, 4: 6.0, 5: 4.0}
FRONT_MATTER_MARKS = ("copyright", "all rights reserved", "isbn", "library of congress", "first published", "printed in", "no part of this publication")
CONTENTS = r"(?i)^(?:table\s+of\s+)?contents\b[\s.:]*$"
CONTENTS_ENTRY = r"(?i)^\S.*?[\s.\u00b7\u2024\u2026]+(?:\d{1,4}|[ivxlcdm]{1,7})$"


def signals(pages: DataFrame) -> DataFrame:
    """What tells about each page's ``text``: characters, lines, contents-like, front matter, title-like."""
    lines = F.filter(F.transform(split_lines(F.coalesce(F.col("text"), F.lit(""))), strip), lambda x: F.length(x) > 0)
    entries = F.size(F.filter("text_lines", lambda x: x.rlike(CONTENTS_ENTRY)))
    many = (F.size("text_lines") >= 5) & (entries >= 4) & (entries * 2 >= F.size("text_lines"))
    marked = F.lit(False)
    for mark in FRONT_MATTER_MARKS:
        marked = marked | F.lower(F.coalesce(F.col("text"), F.lit(""))).contains(mark)
    p = pages.withColumn("text_lines", lines).withColumn("n_chars", non_ws_count(F.coalesce(F.col("text"), F.lit("")))).withColumn("n_lines", F.size("text_lines"))
    contents = F.coalesce(F.get("text_lines", F.lit(0)).rlike(CONTENTS), F.lit(False)) | many
    p = p.withColumns({"toc_like": contents, "front_matter": marked, "portrait": F.coalesce(F.col("page_height") > F.col("page_width"), F.lit(False))})
    title = F.col("n_chars").between(1, TITLE_CHARS) & (F.col("n_lines") <= TITLE_LINES)
    return p.withColumn("title_like", title).drop("text_lines")


def score(page_signals: DataFrame, medians: DataFrame) -> DataFrame:
    """``reason`` of rejection or a score for the first pages; ``medians`` is (doc_id, median_chars) over all pages."""
    p = page_signals.where(F.col("page_number") <= WINDOW).join(medians, "doc_id")
    ratio, n = F.col("image_area_ratio"), F.col("n_chars")
    rejected = (
        F.when((n == 0) & (F.col("image_count") == 0), "blank")
        .when((F.col("image_count") == 0) | (ratio < MIN_IMAGE), "not_image_dominated")
        .when((n == 0) & (F.col("median_chars") <= 0), "book_without_text")
        .when((n == 0) & (ratio < UNTEXTED_IMAGE), "untexted_small_image")
        .when(F.col("toc_like"), "toc_like")
        .when(F.col("front_matter"), "front_matter")
        .when((n >= BODY_CHARS) | (F.col("n_lines") >= BODY_LINES), "body_text")
        .when(n > TITLE_CHARS, "too_much_text")
        .when((n > 0) & (F.col("median_chars") > 0) & (n > STANDOUT * F.col("median_chars")), "not_sparse_for_the_book")
    )
    place = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in PLACE_POINTS.items() for x in pair]), F.col("page_number").cast("int")), F.lit(0.0))
    image = F.lit(40.0) * F.least(F.lit(1.0), ratio / F.lit(FULL_IMAGE))
    points = F.round(image + place + F.when(F.col("title_like"), 15.0).otherwise(0.0) + F.when(F.col("portrait"), 5.0).otherwise(0.0), 1)
    points = F.when(rejected.isNull(), points).otherwise(0.0)
    p = p.withColumn("rejected", rejected).withColumn("score", points)
    return p.select("doc_id", "page_number", "rejected", "score", (F.col("rejected").isNull() & (F.col("score") >= CONFIDENT)).alias("eligible"))


def decide(candidates: DataFrame) -> DataFrame:
    """The cover page of each document, null where none is eligible or the best leads the next by too little."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("eligible"), F.desc("score"), "page_number")
    ranked = candidates.withColumn("rank", F.row_number().over(order)).withColumn("next", F.lead(F.when(F.col("eligible"), F.col("score"))).over(order)).where("rank = 1")
    close = F.coalesce(F.col("score") - F.col("next") < MARGIN, F.lit(False))
    chosen = F.col("eligible") & ~close
    return ranked.select(
        "doc_id", F.when(chosen, F.col("page_number")).alias("cover_page"), F.when(F.col("eligible"), F.col("score")).otherwise(0.0).alias("score"),
        F.when(chosen, "selected").when(F.col("eligible"), "ambiguous").otherwise("none_eligible").alias("decision"),
    )


def page_medians(page_signals: DataFrame) -> DataFrame:
    return page_signals.groupBy("doc_id").agg(F.percentile("n_chars", 0.5).alias("median_chars"))


def with_explicit(decisions: DataFrame, explicit: Column) -> DataFrame:
    """An explicit cover always wins over a detected page."""
    return decisions.withColumn("cover_source", F.when(explicit.isNotNull(), "EXPLICIT").when(F.col("cover_page").isNotNull(), "DETECTED").otherwise("NONE"))
