"""Decisions about decoded PDF pages: joining text runs, choosing a source, warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parsefold.functions import fixed_values as v
from parsefold.functions.arrays import scan
from parsefold.functions.text import clean, has_broken_map, let, trim

ITEM = "struct<str:string,x:double,y:double,width:double,height:double,dir:string,has_eol:boolean>"


def join_items(items: Column) -> Column:
    """The text of positioned runs in order; runs without a string are passed over. A line
    feed or a blank goes between two runs by the gap between them, unless what is there
    already ends in white space or the run begins with it."""

    def between(r: Column, last: Column, end: Column) -> Column:
        loose = last.isNotNull() & ~end.rlike(v.S) & ~F.substring(r["str"], 1, 1).rlike(v.S)
        down = F.abs(r["y"] - last["y"]) > F.greatest(F.lit(2.0), last["height"] * 0.4)
        apart = (r["dir"] == "rtl") | (r["x"] - (last["x"] + last["width"]) > F.greatest(F.lit(0.5), last["height"] * 0.08))
        return F.coalesce(F.when(~loose, "").when(down, "\n").when(apart, " ").otherwise(""), F.lit(""))

    def own_end(r: Column) -> Column:
        return F.when(F.coalesce(r["has_eol"], F.lit(False)), "\n").otherwise(F.substring(r["str"], -1, 1))

    def joined(runs: Column) -> Column:
        # The last character after each run is its own, or, after an empty one, what stood
        # before it or came between: only then does one run depend on all before it.
        def end(so_far: Column, x: Column) -> Column:
            return F.coalesce(*[F.when(e != "", e) for e in (own_end(x["r"]), between(x["r"], x["last"], so_far))], so_far)

        pairs = F.transform(runs, lambda r, i: F.struct(r.alias("r"), F.get(runs, i - 1).alias("last")))
        ends = F.when(F.exists(runs, lambda r: own_end(r) == ""), scan(pairs, F.lit(""), end, "string")).otherwise(F.transform(runs, own_end))

        def piece(r: Column, i: Column, e: Column) -> Column:
            return F.concat(between(r, F.get(runs, i - 1), F.get(e, i - 1)), r["str"], F.when(F.coalesce(r["has_eol"], F.lit(False)), "\n").otherwise(""))

        return let(ends, lambda e: F.array_join(F.transform(runs, lambda r, i: piece(r, i, e)), ""))

    return let(F.filter(items, lambda r: r["str"].isNotNull()), joined)


def needs_optical(mode: Column, embedded: Column, embedded_error: Column) -> Column:
    """Whether a page must be recognised optically: only such rows go to a recogniser."""
    sound = embedded_error.isNull() & ~has_broken_map(embedded) & (F.char_length(F.regexp_replace(embedded, v.S, "")) >= v.SPARSE_CHARACTERS)
    return (mode == "optical") | ~F.coalesce(sound, F.lit(False))


def choose_source(mode: Column, embedded: Column, embedded_error: Column, optical: Column, optical_error: Column) -> Column:
    """struct<text, source, note, error> of a page. Errors are null where there is none; a
    page with an error has no text."""
    failed, broken = optical_error.isNotNull(), has_broken_map(F.coalesce(embedded, F.lit("")))
    none = F.lit(None).cast("string")

    def result(text: Column, source: str | None, note: str | None = None, error: Column = none) -> Column:
        return F.struct(text.alias("text"), F.lit(source).alias("source"), F.lit(note).alias("note"), error.alias("error"))

    refused = result(none, None, None, optical_error)
    shorter = F.char_length(trim(optical)) < F.char_length(trim(embedded))
    return (
        F.when(mode == "optical", F.when(failed, refused).otherwise(result(optical, "optical")))
        .when(embedded_error.isNotNull(), F.when(failed, refused).otherwise(result(optical, "optical", v.NOTE_NOT_DECODED)))
        .when(~needs_optical(mode, embedded, embedded_error), result(embedded, "embedded"))
        .when(broken, F.when(failed, refused).otherwise(result(optical, "optical", v.NOTE_INVALID_MAP)))
        .when(failed, F.when(trim(embedded) != "", result(embedded, "embedded", v.NOTE_OPTICAL_FAILED)).otherwise(refused))
        .when(shorter, result(embedded, "embedded"))
        .otherwise(result(optical, "optical"))
    )


def kind_label(mode: Column, optical_pages: Column) -> Column:
    return F.when(mode == "optical", v.KIND_OPTICAL).when(optical_pages > 0, v.KIND_AUTOMATIC).otherwise(v.KIND_EMBEDDED)


def read_pages(pages: DataFrame) -> DataFrame:
    """pages(doc_id, page from 0, mode, embedded, embedded_error, optical, optical_error,
    confidence) with text (cleaned), source, note, error and running characters."""
    chosen = pages.withColumn("r", choose_source(*[F.col(c) for c in ("mode", "embedded", "embedded_error", "optical", "optical_error")]))
    out = chosen.select("doc_id", "page", "mode", "confidence", clean(F.col("r.text")).alias("text"), "r.source", "r.note", "r.error")
    so_far = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("running", F.sum(F.coalesce(F.char_length("text"), F.lit(0))).over(so_far))


def pdf_documents(read: DataFrame) -> DataFrame:
    """One row for each document of read_pages: pages in order, kind, warnings (what was
    read optically first, then page by page: low confidence, note, no text), error. A
    provider that meets a password gives a page with the error PasswordException."""
    page = (F.col("page") + 1).cast("string")
    many = F.col("n") > 1
    optical = F.col("source") == "optical"
    low = F.when(optical & (F.col("confidence") < v.LOW_CONFIDENCE) & (trim(F.col("text")) != ""), F.concat(F.lit(v.WARN_LOW), F.when(many, F.concat(F.lit(v.WARN_LOW_PAGE), page)).otherwise(""), F.lit(v.WARN_LOW_END)))
    note = F.when(F.col("note").isNotNull(), F.concat(F.lit("Page "), page, F.lit(": "), F.col("note")))
    blank = F.when(F.col("text") == "", F.format_string(v.WARN_BLANK, page))
    counted = read.withColumn("n", F.count("*").over(Window.partitionBy("doc_id")))
    said = counted.withColumn("said", F.filter(F.array(low, note, blank), lambda x: x.isNotNull()))
    by_doc = said.groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("page", "text", "said"))).alias("p"),
        F.count("*").alias("n"),
        F.sum(optical.cast("int")).alias("optical_pages"),
        F.max("mode").alias("mode"),
        F.min_by("error", F.when(F.col("error").isNotNull(), F.col("page"))).alias("page_error"),
        F.max("running").alias("characters"),
    )
    summary = F.when(F.col("optical_pages") > 0, F.format_string(v.WARN_OPTICAL, F.col("optical_pages"), F.col("n")))
    warnings = F.concat(F.filter(F.array(summary), lambda x: x.isNotNull()), F.flatten(F.transform("p", lambda x: x["said"])))
    error = F.when(F.col("n") > v.MAX_PDF_PAGES, v.TOO_MANY_PAGES).when(F.col("page_error") == v.PASSWORD_EXCEPTION, v.PASSWORD_PROTECTED).when(F.col("page_error").isNotNull(), F.col("page_error")).when(F.col("characters") > v.MAX_CHARACTERS, v.TOO_MANY_CHARACTERS)
    return by_doc.select("doc_id", kind_label(F.col("mode"), F.col("optical_pages")).alias("kind"), F.transform("p", lambda x: F.coalesce(x["text"], F.lit(""))).alias("pages"), warnings.alias("warnings"), error.alias("error"))


def render_scale(width: Column, height: Column) -> Column:
    """How much a page is enlarged for recognition: 300 dots an inch, within 3600 a side."""
    return F.least(F.lit(v.RENDER_DPI / v.RENDER_POINTS), v.RENDER_PIXELS / F.greatest(width, height))
