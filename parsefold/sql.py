"""The library in SQL: temporary functions and table functions of a session.

    register(spark)
    SELECT d.doc_id, p.* FROM (SELECT doc_id, clean_text(text) AS text FROM docs) d, LATERAL pages_of(d.text) p
    SELECT * FROM passages_of(TABLE(SELECT doc_id, page, text FROM pages))
    SELECT * FROM speak(TABLE(SELECT doc_id, source_index, page, text, cut_start, cut_end, fill FROM cuts))

Table functions over tables say themselves how their rows are partitioned and ordered: a
document's rows meet in one task, in order, and are folded as they come.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from parsefold.functions import fixed_values as v
from parsefold.functions.shipping import ship
from parsefold.operators.paging import paginate_text, split_page

_SPACES = re.compile(f"[{v.SPACES}]+")
_LOOSE = re.compile(f"[{v.SPACES}]+([,.;:!?])")


def _keyed(table: AnalyzeArgument, columns: tuple[str, ...], fields: list[tuple[str, T.DataType]], order: tuple[str, ...], takes: str) -> AnalyzeResult:
    """The result's columns after the first column of the table, which is the key."""
    if not table.isTable or tuple(f.name for f in table.dataType.fields)[1:] != columns:
        raise ValueError(f"takes a table of a key, {takes}")
    key = table.dataType.fields[0]
    schema = T.StructType([key, *[T.StructField(n, t) for n, t in fields]])
    return AnalyzeResult(schema, partitionBy=[PartitioningColumn(key.name)], orderBy=[OrderingColumn(o) for o in order])


class PagesOf:
    """Pages of one cleaned text; none of a null or empty one."""

    def eval(self, text: str) -> Iterator[tuple]:
        yield from enumerate(paginate_text(text) if text else ())


class PassagesOf:
    """Passages of cleaned pages (key, page, text), numbered over the document."""

    def __init__(self):
        self.n = 0

    @staticmethod
    def analyze(pages: AnalyzeArgument) -> AnalyzeResult:
        number = T.IntegerType()
        fields = [("source_index", number), ("page", number), ("paragraph", number), ("start", number), ("end", number), ("text", T.StringType())]
        return _keyed(pages, ("page", "text"), fields, ("page",), "page and text")

    def eval(self, row: Row) -> Iterator[tuple]:
        for paragraph, start, end, text in split_page(row["text"] or ""):
            yield row[0], self.n, row["page"], paragraph, start, end, text
            self.n += 1


class Speak:
    """What is left of passages without their cuts: rows (key, source_index, page, text,
    cut_start, cut_end, fill), one for each cut, or one without, in order of passages, the
    last cut first. Cuts are offsets into the passage; what they take gives way to `fill`."""

    def __init__(self):
        self.queued, self.key, self.at, self.page, self.text, self.cuts = 0, None, None, None, "", 0

    @staticmethod
    def analyze(cuts: AnalyzeArgument) -> AnalyzeResult:
        number = T.IntegerType()
        fields = [("queue_index", number), ("source_index", number), ("page", number), ("text", T.StringType())]
        columns = ("source_index", "page", "text", "cut_start", "cut_end", "fill")
        found = _keyed(cuts, columns, fields, ("source_index",), ", ".join(columns))
        found.orderBy.append(OrderingColumn("cut_start", ascending=False))
        return found

    def _said(self) -> Iterator[tuple]:
        if self.at is None:
            return
        text = _LOOSE.sub(r"\1", _SPACES.sub(" ", self.text)).strip(v.SPACES)
        if text and (not self.cuts or any(unicodedata.category(c)[0] in "LN" for c in text)):
            yield self.key, self.queued, self.at, self.page, text
            self.queued += 1

    def eval(self, row: Row) -> Iterator[tuple]:
        if row["source_index"] != self.at:
            yield from self._said()
            self.key, self.at, self.page, self.text, self.cuts = row[0], row["source_index"], row["page"], row["text"], 0
        if row["cut_start"] is not None:
            self.text = self.text[: max(row["cut_start"], 0)] + row["fill"] + self.text[row["cut_end"] :]
            self.cuts += 1

    def terminate(self) -> Iterator[tuple]:
        yield from self._said()


#: Temporary SQL functions, as expressions over their arguments.
FUNCTIONS = {
    "clean_text": ("t STRING", r"btrim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\\r\\n?', '\n'), '\\x{00}', ''), '[\\t ]+', ' '), '\\n{3,}', '\n\n'), {spaces})"),
    "omission_fill": ("reason STRING", "CASE WHEN reason = {formatting} THEN '' ELSE ' ' END"),
}


def register(spark: SparkSession) -> None:
    """Make clean_text, omission_fill, pages_of, passages_of and speak known to a session."""
    ship(spark)
    quoted = {"spaces": "'" + v.SPACES.replace("\\", "\\\\") + "'", "formatting": f"'{v.FORMATTING_MARKER}'"}
    for name, (arguments, body) in FUNCTIONS.items():
        for word, text in quoted.items():
            body = body.replace("{" + word + "}", text)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS STRING RETURN {body}")
    spark.udtf.register("pages_of", udtf(PagesOf, returnType="page int, text string"))
    spark.udtf.register("passages_of", udtf(PassagesOf))
    spark.udtf.register("speak", udtf(Speak))
