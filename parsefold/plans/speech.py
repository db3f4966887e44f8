"""From passages and omissions to what is read aloud: the queue, its map to passages,
counts of what is skipped, and words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parsefold.functions import fixed_values as v
from parsefold.functions.arrays import exploded, fresh
from parsefold.functions.text import SPACE, has_letter_or_digit, let, squash


def active(omissions: Column, enabled: Column, restored: Column) -> Column:
    """Omissions that stand: none if filtering is off, else those not restored."""
    restored = F.coalesce(restored, F.array().cast("array<string>"))
    kept = let(restored, lambda ids: F.filter(omissions, lambda o: ~F.array_contains(ids, o["id"])))
    return F.when(enabled, kept).otherwise(F.slice(omissions, 1, 0))


def spoken(passage: Column, spans: Column) -> Column:
    """A passage without its spans, from right to left: a blank for each, nothing for a
    formatting mark. Null if nothing worth reading is left."""
    near = F.filter(spans, lambda o: (o["page"] == passage["page"]) & (o["start"] < passage["end"]) & (o["end"] > passage["start"]))

    def cut(text: Column, o: Column) -> Column:
        start = F.greatest(o["start"] - passage["start"], F.lit(0))
        end = F.least(o["end"] - passage["start"], F.char_length(text))
        fill = F.when(o["reason"] == v.FORMATTING_MARKER, "").otherwise(" ")
        return F.concat(F.substr(text, F.lit(1), start), fill, F.substr(text, end + 1, F.greatest(F.char_length(text) - end, F.lit(0))))

    def said(found: Column) -> Column:
        text = squash(F.aggregate(F.reverse(found), passage["text"], cut))
        return let(text, lambda t: F.when((t != "") & ((F.size(found) == 0) | has_letter_or_digit(t)), t))

    return let(near, said)


def speech_queue(passages: Column, spans: Column) -> Column:
    """array<struct<queue_index, source_index, page, text>>: what is left of each passage,
    numbered from 0; source_index is its place among all passages."""
    last = F.coalesce(F.array_max(F.transform(passages, lambda p: p["page"])), F.lit(-1))
    pages = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    by_page = F.transform(pages, lambda n: F.filter(spans, lambda o: o["page"] == n))
    said = let(by_page, lambda own: F.transform(passages, lambda p, i: F.struct(i.alias("source_index"), p["page"].alias("page"), spoken(p, F.get(own, p["page"])).alias("text"))))
    left = F.filter(said, lambda s: s["text"].isNotNull())
    return let(left, lambda x: F.transform(x, lambda s, i: F.struct(i.alias("queue_index"), s["source_index"].alias("source_index"), s["page"].alias("page"), s["text"].alias("text"))))


def queue_words(queue: Column) -> Column:
    return F.aggregate(queue, F.lit(0), lambda a, q: a + F.size(F.split(q["text"], f"{SPACE}+", -1)))


def speech_plan(documents: DataFrame, enabled: Column | bool = True, restored: Column | None = None) -> DataFrame:
    """documents(passages, omissions, ...) with queue, skipped (omissions that stand, also
    those that touch no passage) and spoken_words."""
    restored = F.lit(None).cast("array<string>") if restored is None else restored
    on = F.lit(enabled) if isinstance(enabled, bool) else enabled
    held = fresh(documents, "__active")
    stood = documents.withColumn(held, active(F.col("omissions"), on, restored))
    planned = stood.withColumn("queue", let(F.col(held), lambda a: speech_queue(F.col("passages"), a)))
    return planned.withColumn("skipped", F.size(held)).withColumn("spoken_words", queue_words(F.col("queue"))).drop(held)


def queue_rows(planned: DataFrame, key: str = "doc_id") -> DataFrame:
    return exploded(planned, F.col("queue"), key)


def overlapping(passages: DataFrame, omissions: DataFrame, key: str = "doc_id") -> DataFrame:
    """The same overlap for tables already laid out in rows: each passage with each
    omission it shares characters with, or with none (a left join on key and page with
    the interval condition as its residue)."""
    p, o = passages.alias("p"), omissions.alias("o")
    on = (F.col(f"p.{key}") == F.col(f"o.{key}")) & (F.col("p.page") == F.col("o.page")) & (F.col("o.start") < F.col("p.end")) & (F.col("o.end") > F.col("p.start"))
    return p.join(o, on, "left").select("p.*", F.col("o.start").alias("cut_start"), F.col("o.end").alias("cut_end"), F.col("o.reason").alias("reason"))
