"""Chapters among headings, and the table of contents.

Input rows are headings: doc_id, element_index (position among the document's elements),
page_number, text, norm_text, font_size (median), is_bold, is_centred.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import chapter_keyword, chapter_number, is_front_matter, number_of

MIN_HEADINGS, MAX_SIZE_RATIO, TIGHT_SIZES = 2, 1.2, 0.15


def parsed(headings: DataFrame) -> DataFrame:
    """Keyword and number of each heading; without a keyword, only a heading that is all number has one."""
    norm = F.col("norm_text")
    keyword = chapter_keyword(norm)
    found = F.when(keyword.isNotNull(), chapter_number(F.col("text"), norm)).otherwise(number_of(norm))
    rows = headings.withColumn("keyword", keyword).withColumn("found", found).withColumn("front_matter", is_front_matter(norm))
    return rows.select("*", F.col("found.number").alias("number"), F.col("found.type").alias("number_type"), F.col("found.value").alias("number_value")).drop("found")


def detect(headings: DataFrame) -> DataFrame:
    """Chapters in order, with the reasons: keyword and number, a rising sequence of bare numbers, or alike titles.

    Front matter is never a chapter. A sequence is of one type of number, two or more, never
    falling and rising at least once. Alike titles are all other headings of a document, if there
    are two or more, of nearly one size, in one style, and no two next to each other.
    """
    rows = parsed(headings).withColumn("explicit", F.coalesce(~F.col("front_matter") & F.col("keyword").isNotNull() & F.col("number_value").isNotNull(), F.lit(False)))
    candidate = ~F.col("front_matter") & F.col("keyword").isNull() & F.col("number_value").isNotNull()
    kind = Window.partitionBy("doc_id", "number_type")
    numbers = rows.where(candidate).withColumn("before", F.lag("number_value").over(kind.orderBy("element_index")))
    runs = numbers.groupBy("doc_id", "number_type").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(F.coalesce(F.col("number_value") >= F.col("before"), F.lit(True))).alias("never_falls"), F.bool_or(F.coalesce(F.col("number_value") > F.col("before"), F.lit(False))).alias("rises")
    )
    runs = runs.where((F.col("n") >= MIN_HEADINGS) & F.col("never_falls") & F.col("rises")).select(F.col("doc_id").alias("rd"), F.col("number_type").alias("rt"))
    rows = rows.join(runs, (F.col("doc_id") == F.col("rd")) & (F.col("number_type") == F.col("rt")) & candidate, "left").withColumn("sequence", F.col("rd").isNotNull()).drop("rd", "rt")
    title = ~F.col("explicit") & ~F.col("sequence") & ~F.col("front_matter") & F.col("keyword").isNull() & F.col("number").isNull()
    titles = rows.where(title).withColumn("before", F.lag("element_index").over(Window.partitionBy("doc_id").orderBy("element_index")))
    alike = titles.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("font_size").alias("least"), F.max("font_size").alias("most"), F.bool_and("is_bold").alias("bold"), F.bool_and("is_centred").alias("centred"),
        F.bool_or(F.coalesce(F.col("element_index") == F.col("before") + 1, F.lit(False))).alias("adjacent"),
    )
    tight = (F.col("most") - F.col("least")) / F.col("least") <= TIGHT_SIZES
    alike = alike.where((F.col("n") >= MIN_HEADINGS) & (F.col("most") / F.col("least") <= MAX_SIZE_RATIO) & (F.col("bold") | F.col("centred") | tight) & ~F.col("adjacent"))
    rows = rows.join(alike.select(F.col("doc_id").alias("td")), (F.col("doc_id") == F.col("td")) & title, "left").withColumn("title_only", F.col("td").isNotNull()).drop("td")
    typed = F.when(F.col("number_type").isNotNull(), F.concat(F.lit("number_"), F.col("number_type")))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("explicit"), "explicit_chapter_pattern"), F.when(F.col("explicit"), F.concat(F.lit("keyword_"), F.col("keyword"))), F.when(F.col("explicit"), typed),
            F.when(F.col("sequence"), "number_sequence"), F.when(F.col("sequence"), typed), F.when(F.col("title_only"), "title_only_structural"),
        )
    )
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("element_index"))
    chosen = rows.where("explicit OR sequence OR title_only")
    return chosen.select("doc_id", order.alias("order"), "element_index", "text", "number", "number_type", "page_number", reasons.alias("reasons"))


def toc(chapters: DataFrame) -> DataFrame:
    return chapters.select("doc_id", F.col("text").alias("title"), "order", "page_number", F.lit(1).alias("level"), F.lit(None).cast("string").alias("identifier"))
