"""Numbers in running text: page-number forms, Roman and written numerals, chapter headings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, strip, sub

# The forms of a page number in normalised text, tried in this order.
PAGE_FORMS = (
    (r"^page\s+(\d{1,5})\s+of\s+(\d{1,6})$", "page n of "),
    (r"^page\s+(\d{1,5})$", "page n"),
    (r"^(\d{1,5})\s*/\s*(\d{1,6})$", "n / "),
    (r"^-+\s*(\d{1,5})\s*-+$", "- n -"),
    (r"^(\d{1,3})$", "n"),
)

# Words that stand for numbers.
NUMBER_WORDS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
    "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19,
    "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90,
    "hundred": 100, "thousand": 1000,
}

# Titles of front and back matter, normalised.
FRONT_MATTER = (
    "contents", "table of contents", "preface", "foreword", "introduction", "acknowledgements", "acknowledgments",
    "bibliography", "references", "appendix", "appendices", "index", "about the author", "colophon",
)

# Roman numerals up to 3999; the empty string is one (0).
ROMAN = r"^M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"
ROMAN_VALUES = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}


def page_template(norm: Column) -> Column:
    """The form of a page number with its fixed total, such as ``page n of 250``; null for other text."""
    out = F.lit(None).cast("string")
    for pattern, form in reversed(PAGE_FORMS):
        tail = F.regexp_extract(norm, f"(?U){pattern}", 2) if form.endswith(" ") else F.lit("")
        out = F.when(norm.rlike(f"(?U){pattern}"), F.concat(F.lit(form), tail)).otherwise(out)
    return out


def page_value(norm: Column) -> Column:
    out = F.lit(None).cast("int")
    for pattern, _ in reversed(PAGE_FORMS):
        out = F.when(norm.rlike(f"(?U){pattern}"), F.regexp_extract(norm, f"(?U){pattern}", 1).try_cast("int")).otherwise(out)
    return out


def roman_value(text: Column) -> Column:
    """The value of a Roman numeral in either case, 0 for the empty string, null for other text."""
    letters = F.filter(F.split(F.reverse(F.upper(text)), ""), lambda c: c != "")
    values = F.create_map(*[F.lit(x) for pair in ROMAN_VALUES.items() for x in pair])

    def step(state: Column, letter: Column) -> Column:
        v = F.element_at(values, letter)
        return F.struct((state.total + F.when(v < state.top, -v).otherwise(v)).alias("total"), F.greatest(state.top, v).alias("top"))

    total = F.aggregate(letters, F.struct(F.lit(0).alias("total"), F.lit(0).alias("top")), step, lambda s: s.total)
    return F.when(text.rlike("(?i)" + ROMAN), total)


def written_value(text: Column) -> Column:
    """The value of a number in words ("one hundred and two", "twenty-one"); null for other text and for zero.

    A larger unit multiplies what stands before it (one, if nothing does); a thousand closes a
    group. A hyphenated word adds its parts; parts that aren't numbers add nothing.
    """
    known = F.create_map(*[F.lit(x) for pair in NUMBER_WORDS.items() for x in pair])
    units = F.filter(F.split(sub(F.lower(text), f"{WS}+", " "), " "), lambda w: w != "")

    def step(state: Column, word: Column) -> Column:
        v = F.element_at(known, word)
        unit = F.when(state.current == 0, v).otherwise(state.current * v)
        parts = F.aggregate(F.split(word, "-"), F.lit(0), lambda s, p: s + F.coalesce(F.element_at(known, p), F.lit(0)))
        hyphen = word.contains("-")
        skip = word == "and"
        return F.struct(
            (state.total + F.when(~skip & (v >= 1000), unit).otherwise(0)).alias("total"),
            F.when(skip, state.current).when(v >= 1000, 0).when(v >= 100, unit).when(v.isNotNull(), state.current + v).when(hyphen, state.current + parts).otherwise(state.current).alias("current"),
            (state.ok & (skip | v.isNotNull() | hyphen)).alias("ok"),
        )

    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("current"), F.lit(True).alias("ok"))
    total = F.aggregate(units, start, step, lambda s: F.when(s.ok & (s.total + s.current > 0), s.total + s.current))
    return F.when(F.size(units) > 0, total)


def number_of(text: Column) -> Column:
    """struct(number, type, value) of a text that is a number: Arabic, else Roman, else in words; null otherwise."""
    arabic = F.when(text.rlike(r"(?U)^\d+$"), text.try_cast("int"))
    roman, word = roman_value(text), written_value(text)
    kind = F.when(arabic.isNotNull(), "arabic").when(roman.isNotNull(), "roman").when(word.isNotNull(), "word")
    return F.when(kind.isNotNull(), F.struct(text.alias("number"), kind.alias("type"), F.coalesce(arabic, roman, word).alias("value")))


CHAPTER = rf"(?i)^(chapter|part){WS}*[.:-]?{WS}*(.+)$"


def chapter_keyword(norm: Column) -> Column:
    """``chapter`` or ``part`` where the normalised text starts with it (no word boundary: "partial" does)."""
    return F.nullif(F.lower(F.regexp_extract(norm, CHAPTER, 1)), F.lit(""))


def chapter_number(text: Column, norm: Column) -> Column:
    """The number of a chapter heading: the whole remainder, else digits or a whole numeral it starts with, else its first word."""
    rest = strip(F.coalesce(F.nullif(F.regexp_extract(text, CHAPTER, 2), F.lit("")), F.regexp_extract(norm, CHAPTER, 2)))
    digits = F.regexp_extract(rest, r"(?U)^\d+", 0)
    first = F.element_at(F.split(sub(rest, f"{WS}+", " "), " "), 1)
    known = F.lower(first).isin(*NUMBER_WORDS)
    found = F.coalesce(
        number_of(rest),
        F.when(digits != "", F.struct(digits.alias("number"), F.lit("arabic").alias("type"), digits.try_cast("int").alias("value"))),
        F.when(known, F.struct(first.alias("number"), F.lit("word").alias("type"), written_value(first).alias("value"))),
    )
    return F.when(chapter_keyword(norm).isNotNull() & (rest != ""), found)


def is_front_matter(norm: Column) -> Column:
    return norm.isin(*FRONT_MATTER)
