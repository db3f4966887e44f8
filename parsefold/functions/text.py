"""Scalar functions on text, as column expressions. Lengths and offsets count code points."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from parsefold.functions import fixed_values as v


#: White space for Java: what is printable ASCII is told by one comparison, before the ranges.
SPACE = f"[[^!-~]&&{v.S}]"


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def has_one_of(text: Column, *marks: str) -> Column:
    """Whether any of the marks is in the text: bytes are compared, which costs far less than
    a pattern, so it goes before one that can't match or change anything without them."""
    return reduce(Column.__or__, [F.contains(text, F.lit(m)) for m in marks])


def trim(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.btrim(text, F.lit(v.SPACES))


def trim_start(text: Column) -> Column:
    return F.ltrim(text, F.lit(v.SPACES))


def clean(text: Column) -> Column:
    """Line ends unified, NULs dropped, runs of blanks and of empty lines shortened, trimmed."""
    out = text
    for pattern, by, marks in ((r"\r\n?", "\n", ("\r",)), (r"\x{00}", "", ("\0",)), (r"[\t ]+", " ", ("\t", "  ")), (r"\n{3,}", "\n\n", ("\n\n\n",))):
        out = let(out, lambda x: F.when(~has_one_of(x, *marks), x).otherwise(F.regexp_replace(x, pattern, by)))
    return trim(out)


def word_count(text: Column) -> Column:
    """Words between white space; an empty text counts as one, as a split does."""
    return F.size(F.split(trim(text), f"{SPACE}+", -1))


def squash(text: Column) -> Column:
    """White space to single blanks, none before punctuation, trimmed."""

    def squashed(x: Column) -> Column:
        # After the first, all white space is single blanks.
        out = F.regexp_replace(x, f"{SPACE}+", " ")
        return F.regexp_replace(out, " ([,.;:!?])", "$1")

    # Nothing to do in a text of printable ASCII whose blanks stand alone before a word.
    return trim(let(text, lambda x: F.when(~x.rlike(r"[^ -~]| [ ,.;:!?]"), x).otherwise(squashed(x))))


def has_letter_or_digit(text: Column) -> Column:
    return text.rlike(r"[\p{L}\p{N}]")


def is_reference_heading(line: Column) -> Column:
    return line.rlike(v.REFERENCE_HEADING)


def is_next_section(line: Column) -> Column:
    return line.rlike(v.NEXT_SECTION)


def is_reference_entry(line: Column) -> Column:
    return line.rlike(v.ENTRY_MARK) & trim(line).rlike(v.ENTRY_START)


def is_author_year(text: Column) -> Column:
    return trim(text).rlike(v.AUTHOR_YEAR)


def has_broken_map(text: Column) -> Column:
    """Characters that betray a broken character map: controls, U+FFFD, private use."""
    return text.rlike(v.BROKEN)


def file_stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]+\z", "")


def extension(name: Column) -> Column:
    """After the last dot, in lower case; a name without a dot is its own extension."""
    return F.lower(F.element_at(F.split(name, r"\.", -1), -1))


def preview(text: Column) -> Column:
    return F.substring(text, 1, v.PREVIEW_CHARACTERS)


def title_or_default(name: Column) -> Column:
    return F.when(F.coalesce(trim(name), F.lit("")) == "", v.DEFAULT_TITLE).otherwise(trim(name))


def rate_label(rate: Column) -> Column:
    """Two decimals, without a second one that is zero."""
    return F.regexp_replace(F.format_number(rate, 2), r"0\z", "")


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)
