"""Paragraphs: of recognised text by blank lines, of laid-out lines by geometry."""

from __future__ import annotations

from collections.abc import Iterator
from statistics import median

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import is_blank, join_lines, split_lines

GAP_SHARE, ALIGNED, INDENT, HANGING, EDGE, SHORT, CENTRED_SHARE = 0.6, 2.0, 12.0, 36.0, 72.0, 8, 0.6


def ocr_paragraphs(pages: DataFrame, text: Column, keys: list[str]) -> DataFrame:
    """(keys..., para_idx, text) of recognised texts: runs of lines that aren't blank, joined.

    All inside one row: no shuffle. A text that is null or blank has no paragraph.
    """
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("open"))

    def step(s: Column, line: Column) -> Column:
        blank = is_blank(line)
        return F.struct(
            F.when(blank & (F.size(s.open) > 0), F.array_append(s.done, s.open)).otherwise(s.done).alias("done"),
            F.when(blank, F.array().cast("array<string>")).otherwise(F.array_append(s.open, line)).alias("open"),
        )

    runs = F.aggregate(split_lines(F.coalesce(text, F.lit(""))), start, step, lambda s: F.when(F.size(s.open) > 0, F.array_append(s.done, s.open)).otherwise(s.done))
    joined = F.filter(F.transform(runs, join_lines), lambda t: ~is_blank(t))
    return pages.select(*keys, F.posexplode(joined).alias("para_idx", "text"))


def _centred(x: dict, width: float) -> bool:
    return x["x1"] - x["x0"] < CENTRED_SHARE * width and abs(x["x0"] - (width - x["x1"])) <= 2 * ALIGNED


def _continues(lines: list[dict], x: dict, gap_limit: float, width: float, height: float, run: bool) -> bool:
    gap = max(0.0, x["y0"] - lines[-1]["y1"])
    centred = _centred(x, width)
    alone = centred or gap > gap_limit or x["y0"] < EDGE or height - x["y1"] < EDGE
    if len(x["text"].strip()) <= SHORT and alone or gap > gap_limit or centred != run:
        return False
    margin, first = median(b["x0"] for b in lines), lines[0]["x0"]
    back = first - margin >= INDENT and abs(x["x0"] - margin) <= ALIGNED
    return not (x["x0"] - margin >= INDENT or back or x["x0"] - first > HANGING)


def page_paragraphs(lines: list[dict], width: float, height: float) -> list[list[dict]]:
    """The lines of one page, in reading order, in paragraphs.

    A line goes on while nothing speaks against it: a gap over 0.6 of the median line height, an
    isolated short line, a change between centred and plain lines, or an indent against the margin
    (the median) or the first line of the paragraph so far.
    """
    out: list[list[dict]] = []
    limit = GAP_SHARE * (median(x["y1"] - x["y0"] for x in lines) if lines else 1.0)
    run = False
    for x in lines:
        if out and _continues(out[-1], x, limit, width, height, run):
            out[-1].append(x)
            run = run or _centred(x, width)
        else:
            out.append([x])
            run = _centred(x, width)
    return out


@F.pandas_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
def _split(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for lines, widths, heights in batches:
        out = []
        for page, width, height in zip(lines, widths, heights, strict=True):
            numbered = [dict(x, at=k) for k, x in enumerate(page)]
            out.append([[x["at"] for x in p] for p in page_paragraphs(numbered, width, height)])
        yield pd.Series(out)


def native_paragraphs(lines: DataFrame) -> DataFrame:
    """Paragraphs of laid-out lines: doc_id, page_number, para_idx, text, line_count, box, fonts, page size.

    ``lines`` has page_order (of its block), line_order, text, box, page_width, page_height and
    font columns. A page's lines are one row for the Arrow function that splits them.
    """
    row = F.struct("page_order", "line_order", "text", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")], "font_name", F.col("font_size").cast("double").alias("font_size"), "font_flags")
    pages = lines.groupBy("doc_id", "page_number").agg(F.sort_array(F.collect_list(row)).alias("all"), F.max("page_width").cast("double").alias("page_width"), F.max("page_height").cast("double").alias("page_height"))
    slim = F.transform("all", lambda x: F.struct(x.text.alias("text"), x.x0.alias("x0"), x.y0.alias("y0"), x.x1.alias("x1"), x.y1.alias("y1")))
    found = pages.select("*", F.posexplode(_split(slim, "page_width", "page_height")).alias("para_idx", "at"))
    own = F.transform("at", lambda i: F.get("all", i))
    found = found.withColumn("own", own)
    pick = lambda f: F.transform("own", f)
    return found.select(
        "doc_id", "page_number", "para_idx", join_lines(pick(lambda x: x.text)).alias("text"), F.size("own").alias("line_count"),
        F.array_min(pick(lambda x: x.x0)).alias("x0"), F.array_min(pick(lambda x: x.y0)).alias("y0"), F.array_max(pick(lambda x: x.x1)).alias("x1"), F.array_max(pick(lambda x: x.y1)).alias("y1"),
        pick(lambda x: F.struct(x.font_name.alias("font_name"), x.font_size.alias("font_size"), x.font_flags.alias("font_flags"), (x.y1 - x.y0).alias("height"))).alias("spans"),
        "page_width", "page_height",
    )
