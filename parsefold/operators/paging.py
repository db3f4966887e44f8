"""Pages and passages. Each cut depends on the one before: pages are cut by a fold over
blocks of a text, passages by an Arrow function; everything after them is expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parsefold.functions import fixed_values as v
from parsefold.functions.shipping import ship
from parsefold.functions.text import clean, let, trim, trim_start, word_count

# ECMAScript white space, which differs from Python's.
_SPACE = v.SPACES
_GAP = re.compile(f"\n[{_SPACE}]*\n")
_SENTENCE_END = re.compile(f"[.!?。！？](?=[{_SPACE}]|\\Z)")
PASSAGES = T.ArrayType(T.StructType([T.StructField("page", T.IntegerType()), T.StructField("paragraph", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType())]))


def paginate_text(cleaned: str) -> list[str]:
    """Pages of a cleaned text: cut at the last blank line that begins within a page's
    length, else at the last blank, either only past half a page, else at the length."""
    pages, at, end = [], 0, len(cleaned)
    while end - at > v.PAGE_CHARACTERS:
        cut = cleaned.rfind("\n\n", at, at + v.PAGE_CHARACTERS + 2) - at
        if cut < v.PAGE_FLOOR:
            cut = cleaned.rfind(" ", at, at + v.PAGE_CHARACTERS + 1) - at
        if cut < v.PAGE_FLOOR:
            cut = v.PAGE_CHARACTERS
        pages.append(cleaned[at : at + cut].strip(_SPACE))
        at += cut
        while at < end and cleaned[at] in _SPACE:
            at += 1
    if at < end:
        pages.append(cleaned[at:])
    return pages


def _chunks(text: str, offset: int):
    """(start, end, text) of the passages of one paragraph whose line feeds are blanks."""
    at, stop = 0, len(text)
    while at < stop and text[at] in _SPACE:
        at += 1
    while stop > at and text[stop - 1] in _SPACE:
        stop -= 1
    while at < stop:
        end = stop
        if stop - at > v.PASSAGE_CHARACTERS:
            window = text[at : at + v.PASSAGE_CHARACTERS]
            last = -1
            for m in _SENTENCE_END.finditer(window):
                last = m.start()
            cut = last + 1 if last > v.SENTENCE_FLOOR else window.rfind(" ")
            end = at + (cut if cut >= 1 else v.PASSAGE_CHARACTERS)
        chunk = text[at:end].rstrip(_SPACE)
        yield offset + at, offset + at + len(chunk), chunk
        at = end
        while at < stop and text[at] in _SPACE:
            at += 1


def split_page(cleaned: str) -> list[tuple[int, int, int, str]]:
    """(paragraph, start, end, text) of the passages of a cleaned page."""
    out, at = [], 0
    ends = [(m.start(), m.end()) for m in _GAP.finditer(cleaned)] + [(len(cleaned), len(cleaned))]
    for paragraph, (stop, after) in enumerate(ends):
        out += [(paragraph, *chunk) for chunk in _chunks(cleaned[at:stop].replace("\n", " "), at)]
        at = after
    return out


#: Characters that are Python's own strings at a time; a batch of rows may hold far more.
SLICE = 1 << 20
_PAGES = pa.list_(pa.string())
_PASSAGES = pa.list_(pa.struct([("page", pa.int32()), ("paragraph", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())]))


def _by_slices(parts: Iterator[pa.Array], made: Callable, length: Callable, kind: pa.DataType) -> Iterator[pa.Array]:
    """made(x) for each row, in arrays of as many rows as hold about SLICE characters."""
    for part in parts:
        rows, held = [], 0
        for scalar in part:
            x = scalar.as_py()
            rows.append(None if x is None else made(x))
            held += 0 if x is None else length(x)
            if held >= SLICE:
                yield pa.array(rows, kind)
                rows, held = [], 0
        if rows:
            yield pa.array(rows, kind)
        del part, rows
        pa.default_memory_pool().release_unused()


def _passages(pages: list[str | None]) -> list[tuple]:
    return [(n, *passage) for n, page in enumerate(pages) for passage in split_page(page or "")]


@F.arrow_udf(PASSAGES)
def _split(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
    yield from _by_slices(pages, _passages, lambda some: sum(map(len, filter(None, some))), _PASSAGES)


# Declared so that the optimiser keeps one evaluation: a filter on passages or what follows
# from them would else be pushed below with a copy of the function, and every copy has a
# Python worker of its own.
_split = _split.asNondeterministic()

#: Characters of a text that are cut into pages at a time: what is left is copied for each page.
PAGE_BLOCK = 20_000


def _first_page(text: Column) -> Column:
    """How many characters of a text of more than a page's length its first page takes."""

    def last(mark: str) -> Column:
        held = F.substring(text, 1, v.PAGE_CHARACTERS + len(mark))
        return let(held, lambda w: F.char_length(w) - F.char_length(F.substring_index(w, mark, -1)) - len(mark))

    near = lambda mark, other: let(last(mark), lambda n: F.when(n >= v.PAGE_FLOOR, n).otherwise(other))
    return near("\n\n", near(" ", F.lit(v.PAGE_CHARACTERS)))


def _cut_pages(a: Column, most: int) -> Column:
    """Pages cut off a struct<rest, pages> for as long as more than `most` characters are left."""

    def one(a: Column, _: Column) -> Column:
        cut = let(_first_page(a["rest"]), lambda n: F.struct(trim_start(F.substr(a["rest"], n + 1)).alias("rest"), F.concat(a["pages"], F.array(trim(F.substr(a["rest"], F.lit(1), n)))).alias("pages")))
        return F.when(F.char_length(a["rest"]) > most, cut).otherwise(a)

    steps = F.sequence(F.lit(0), F.floor(F.char_length(a["rest"]) / v.PAGE_FLOOR))
    return F.aggregate(steps, a, one)


def _pages(cleaned: Column) -> Column:
    """The pages of paginate_text. A text comes in blocks: a page is cut while what is held
    shows where it ends and that more follows, the rest waits for the next block."""

    def add(a: Column, block: Column) -> Column:
        held = F.struct(trim_start(F.concat(a["rest"], block)).alias("rest"), F.array().cast("array<string>").alias("pages"))
        own = let(held, lambda h: _cut_pages(h, v.PAGE_CHARACTERS + 2))
        return let(own, lambda o: F.struct(o["rest"].alias("rest"), F.concat(a["pages"], F.array(o["pages"])).alias("pages")))

    def end(a: Column) -> Column:
        own = let(F.struct(a["rest"].alias("rest"), F.array().cast("array<string>").alias("pages")), lambda h: _cut_pages(h, v.PAGE_CHARACTERS))
        return let(own, lambda o: F.concat(F.flatten(a["pages"]), o["pages"], F.when(o["rest"] != "", F.array(o["rest"])).otherwise(F.array().cast("array<string>"))))

    many = F.regexp_extract_all(cleaned, F.lit(f"(?s).{{1,{PAGE_BLOCK}}}+"), 0)
    blocks = F.when(F.char_length(cleaned) <= PAGE_BLOCK, F.array(cleaned)).otherwise(many)
    none = F.struct(F.lit("").alias("rest"), F.array().cast("array<array<string>>").alias("pages"))
    return F.when(cleaned == "", F.array().cast("array<string>")).when(F.char_length(cleaned) <= v.PAGE_CHARACTERS, F.array(cleaned)).when(cleaned.isNotNull(), F.aggregate(blocks, none, add, end))


def paginate(text: Column) -> Column:
    """array of pages of at most 5000 characters."""
    return let(clean(text), _pages)


def split_passages(pages: Column) -> Column:
    """array<struct<page, paragraph, start, end, text>> of passages of at most 240
    characters, with half-open offsets into the cleaned pages."""
    ship()
    return _split(F.transform(pages, clean))


def make_documents(rows: DataFrame, pages: str = "pages") -> DataFrame:
    """rows with cleaned `pages`, `passages`, `words` and `error` (null, or why there is
    no document; then passages is null). Blank pages keep their number."""
    ship(rows.sparkSession)
    cleaned = rows.withColumn(pages, F.transform(F.coalesce(F.col(pages), F.array().cast("array<string>")), lambda p: clean(F.coalesce(p, F.lit("")))))
    joined = F.array_join(pages, "\n\n")
    error = F.when(trim(joined) == "", v.NO_TEXT).when(F.char_length(joined) > v.MAX_CHARACTERS, v.TOO_MANY_CHARACTERS)
    marked = cleaned.withColumn("error", error).withColumn("words", F.when(F.col("error").isNull(), word_count(joined)))
    return marked.withColumn("passages", _split(F.when(F.col("error").isNull(), F.col(pages))))
