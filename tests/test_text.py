"""Text and number rules against plain statements of them."""

from __future__ import annotations

import random
import re
import unicodedata

from pyspark.sql import functions as F

from quirework.functions import numbers
from quirework.functions import text as tx

CHARS = list("aB-  \t\n\r1x.\u00e9") + ["\u00a0", "\u2003", "\u2028", "\x85", "\x0c", "\x00", "\x1c"]


def _random_texts(n: int, size: int, seed: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice(CHARS) for _ in range(r.randrange(size))) for _ in range(n)]


def _clean(text: str) -> str:
    text = unicodedata.normalize("NFC", text).replace("\r\n", "\n").replace("\r", "\n")
    text = "".join(c for c in text if c in "\n\t" or unicodedata.category(c) != "Cc")
    out, blanks = [], 0
    for line in (x.rstrip(" \t") for x in text.split("\n")):
        blanks = blanks + 1 if not line.strip() else 0
        if blanks <= 2:
            out.append(line if line.strip() else "")
    return "\n".join(out).strip()


def test_whitespace_functions_equal_python(spark):
    texts = _random_texts(2000, 12, 1)
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select(
        "t", tx.strip(F.col("t")).alias("s"), tx.collapse(F.col("t")).alias("c"), tx.non_ws_count(F.col("t")).alias("n"), tx.split_lines(F.col("t")).alias("l")
    )
    for r in rows.collect():
        assert r.s == r.t.strip()
        assert r.c == " ".join(r.t.split())
        assert r.n == sum(not c.isspace() for c in r.t)
        assert r.l == r.t.splitlines()


def test_cleanup_equals_its_rule(spark):
    texts = _random_texts(3000, 30, 2)
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select("t", tx.clean_ocr(tx.nfc("t")).alias("c"))
    for r in rows.collect():
        assert r.c == _clean(r.t), repr(r.t)


def _join(lines: list[str]) -> str:
    done, last = "", None
    for line in lines:
        if last is None:
            last = re.sub(r"^ {1,4}", "", line)
            continue
        up, low = last.rstrip(), line.lstrip()
        if re.search(r"[A-Za-z]-$", up) and low[:1].islower() and not re.search("[A-Za-z]-[A-Za-z]", up.rstrip("-") + low):
            done, last = done + up.rstrip("-"), low
        else:
            done, last = done + last + " ", line
    return " ".join((done + (last or "")).split())


def test_joining_equals_its_rule(spark):
    r = random.Random(3)
    pieces = ["ex-", "ample", "Word", " in-", "a-b", "  x", "y -", "-", "é", "Z-", "end- "]
    lists = [[r.choice(pieces) for _ in range(r.randrange(6))] for _ in range(2000)]
    for row in spark.createDataFrame([(x,) for x in lists], "l array<string>").select("l", tx.join_lines(F.col("l")).alias("j")).collect():
        assert row.j == _join(row.l), row.l


def test_escape_covers_quotes(spark):
    row = spark.createDataFrame([("<a href=\"x\">'&'</a>",)], "t string").select(tx.escape_html(F.col("t")).alias("e")).first()
    assert row.e == "&lt;a href=&quot;x&quot;&gt;&#x27;&amp;&#x27;&lt;/a&gt;"


def _written(text: str) -> int | None:
    total = current = 0
    words = text.lower().split()
    for w in words:
        v = numbers.NUMBER_WORDS.get(w)
        if w == "and":
            continue
        if v is None:
            if "-" not in w:
                return None
            current += sum(numbers.NUMBER_WORDS.get(p, 0) for p in w.split("-"))
        elif v < 100:
            current += v
        else:
            current = (current or 1) * v
            if v >= 1000:
                total, current = total + current, 0
    return (total + current or None) if words else None


def test_written_and_roman_numbers(spark):
    r = random.Random(4)
    words = [*numbers.NUMBER_WORDS, "and", "twenty-one", "zz", "ninety-nine"]
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(1, 6))) for _ in range(1000)] + ["", "IV", "mix", "XLII", "MMXXIV", "IIII", "xiv"]
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select("t", numbers.written_value(F.col("t")).alias("w"), numbers.roman_value(F.col("t")).alias("r"))
    roman = {"IV": 4, "mix": 1009, "XLII": 42, "MMXXIV": 2024, "xiv": 14, "": 0}
    for row in rows.collect():
        assert row.w == _written(row.t), row.t
        assert row.r == roman.get(row.t), row.t
