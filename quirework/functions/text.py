"""Text rules as Column expressions: whitespace as Python sees it, cleanup, joining, escaping.

Spark's own trim and ``\\s`` know ASCII only; ``WS`` is the class of all characters for which
Python's ``str.isspace`` is true.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WS = r"[\s\x1c-\x1f\x85\p{Z}]"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def sub(c: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(to))


def lstrip(c: Column) -> Column:
    return sub(c, rf"\A{WS}+", "")


def rstrip(c: Column) -> Column:
    return sub(c, rf"{WS}+\z", "")


def strip(c: Column) -> Column:
    return lstrip(rstrip(c))


def collapse(c: Column) -> Column:
    """Runs of whitespace become one space; none at the ends."""
    return F.trim(sub(c, f"{WS}+", " "))


def non_ws_count(c: Column) -> Column:
    return F.length(sub(c, WS, ""))


def is_blank(c: Column) -> Column:
    return F.coalesce(F.length(strip(c)), F.lit(0)) == 0


@F.pandas_udf(T.StringType())
def nfc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Unicode normalisation form C; not among Spark's functions."""
    for s in batches:
        yield s.str.normalize("NFC")


@F.pandas_udf(T.StringType())
def normalized(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """NFKC, whitespace runs as one space, casefolded: the key by which repeated texts are compared."""
    for s in batches:
        yield s.str.normalize("NFKC").map(lambda x: None if x is None else " ".join(x.split()).casefold())


def clean_ocr(c: Column) -> Column:
    """Cleanup of recognised text (after ``nfc``): line ends, controls, trailing blanks, at most two blank lines in a row."""
    c = sub(c, "\r\n?", "\n")
    c = sub(c, r"[\p{Cc}&&[^\n\t]]", "")
    c = sub(c, r"[ \t]+(?=\n|\z)", "")
    c = sub(c, rf"(?<=\n|\A)(?:(?!\n){WS})+(?=\n|\z)", "")
    c = sub(c, r"\n{4,}", "\n\n\n")
    return strip(c)


def split_lines(c: Column) -> Column:
    """Lines as ``str.splitlines`` gives them: no empty last one."""
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(F.split(sub(c, rf"(?:{LINE_BREAK})\z", ""), LINE_BREAK))


def join_lines(lines: Column) -> Column:
    """One paragraph's text from its lines: single spaces, and words that a line-end hyphen broke made whole.

    A hyphen is a break when a letter stands before it, the next line starts in lower case, and
    the joined word has no hyphen between letters, anywhere in either line.
    """
    start = F.struct(F.lit("").alias("done"), F.lit(None).cast("string").alias("last"))

    def step(state: Column, line: Column) -> Column:
        last, ahead = rstrip(state.last), lstrip(line)
        whole = F.concat(sub(last, r"-+\z", ""), ahead)
        broken = last.rlike(r"[A-Za-z]-\z") & ahead.rlike(r"\A\p{IsLowercase}") & ~whole.rlike("[A-Za-z]-[A-Za-z]")
        first = state.last.isNull()
        return F.struct(
            F.when(first, F.lit("")).when(broken, F.concat(state.done, sub(last, r"-+\z", ""))).otherwise(F.concat(state.done, state.last, F.lit(" "))).alias("done"),
            F.when(first, sub(line, r"\A {1,4}", "")).when(broken, ahead).otherwise(line).alias("last"),
        )

    return F.aggregate(lines, start, step, lambda s: collapse(F.concat(s.done, F.coalesce(s.last, F.lit("")))))


def escape_html(c: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def blank_to_empty(c: Column) -> Column:
    """A metadata value, or the empty string where it is null or blank."""
    return F.when(is_blank(c), F.lit("")).otherwise(c)


def first_filled(*values: Column) -> Column:
    """The first value that is not null or empty, else the empty string."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(""))


def finite(c: Column) -> Column:
    """NaN and infinities become null."""
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def positive(c: Column) -> Column:
    c = finite(c)
    return F.when(c > 0, c)


def clamp01(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def valid_box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    ok = F.lit(True)
    for c in (x0, y0, x1, y1):
        ok = ok & finite(c).isNotNull()
    return F.coalesce(ok & (x1 >= x0) & (y1 >= y0), F.lit(False))
