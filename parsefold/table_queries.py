"""Queries of the operators that keep tables, folders and state: files written from the
documents and taken in again, libraries updated in place, streamed sessions, as-of joins,
JSON rows, totals over grouping sets. Each writes into the shared folder what it then reads."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parsefold import sql
from parsefold.functions import fixed_values as v
from parsefold.operators import clutter, paging
from parsefold.operators.asof import as_of
from parsefold.plans import views
from parsefold.queries import _LOG, _PLAYER_PARTS, CITATIONS_SQL, LINES_SQL, PAGES_SQL, PAGINATE_SQL, PASSAGES_SQL, PLAN_SQL, _at_start, _sql_string, _trim, documents, exploded, log, made, query, read, resolved
from parsefold.sources import intake, library, text_files
from parsefold.sources.json_rows import NO_ROW, NOT_JSON, NOT_OBJECT, checked_json
from parsefold.sources.shared import new_path
from parsefold.streaming import sessions

# ---------------------------------------------------------------- folders of files

#: Twenty documents make a book; its name has an ending by number.
_ENDINGS = [".txt", ".MD", ".exe", ".docx", ".log", ".pdf"]
BOOKS_SQL = f"""books AS (
  SELECT CAST(floor(doc_id / 20) AS BIGINT) AS book, string_agg(text, chr(10) || chr(10) ORDER BY doc_id) AS text, arg_min(source, doc_id) AS source FROM documents GROUP BY 1
)"""


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book, text, source)."""
    rows = read(spark, sf_dir, "documents").withColumn("book", F.floor(F.col("doc_id") / 20).cast("long"))
    parts = F.sort_array(F.collect_list(F.struct("doc_id", "text", "source")))
    own = rows.groupBy("book").agg(parts.alias("x"))
    return own.select("book", F.array_join(F.transform("x", lambda p: p["text"]), "\n\n").alias("text"), F.col("x")[0]["source"].alias("source"))


def _folder(spark: SparkSession, name: str) -> str:
    path = new_path(spark, name)
    os.makedirs(text_files.local_path(path))
    return path


_ENDING_SQL = "CASE CAST(book % 6 AS INT) " + " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(_ENDINGS)) + " END"


@query(
    f"""WITH {BOOKS_SQL}, files AS (
  SELECT book AS doc_id, 'book ' || book || {_ENDING_SQL} AS name, CASE WHEN book % 12 = 0 THEN text || ' And more.' ELSE text END AS text FROM books
), p AS ({PAGINATE_SQL.replace("FROM documents", "FROM files")}), paged AS (
  SELECT doc_id, CAST(count(*) AS INT) AS pages, string_agg(text, chr(10) || chr(10) ORDER BY page) AS whole FROM p GROUP BY doc_id
), judged AS (
  SELECT f.*, pages, whole, CASE CAST(doc_id % 6 AS INT) WHEN 2 THEN {_sql_string(v.UNSUPPORTED)} WHEN 3 THEN 'This Word file could not be opened: File is not a zip file' WHEN 5 THEN 'No pdf reader is configured.'
    ELSE CASE WHEN {_trim("text")} = '' THEN {_sql_string(v.NO_TEXT)} WHEN length(whole) > 1000000 THEN {_sql_string(v.TOO_MANY_CHARACTERS)} END END AS error
  FROM files f LEFT JOIN paged USING (doc_id)
)
SELECT name, CAST(1 + doc_id % 2 AS BIGINT) AS run, error, CASE WHEN error IS NULL AND doc_id % 12 <> 0 THEN pages END AS pages, CASE WHEN error IS NULL AND doc_id % 12 <> 0 THEN sha256(whole) END AS sha FROM judged
UNION ALL SELECT name, 2, error, CASE WHEN error IS NULL THEN pages END, CASE WHEN error IS NULL THEN sha256(whole) END FROM judged WHERE doc_id % 12 = 0"""
)
def s11_m4_take_in(spark, sf_dir):
    """Every other book is a file in a folder that is taken in; then the others join them,
    and some are written again, longer: the second run reads those alone."""
    folder, path = _folder(spark, "folder"), new_path(spark, "intake")
    ending = F.element_at(F.array(*map(F.lit, _ENDINGS)), (F.col("book") % 6 + 1).cast("int"))
    files = books(spark, sf_dir).select("book", F.concat(F.lit("book "), F.col("book").cast("string"), ending).alias("file_name"), "text")
    text_files.write_files(files.where("book % 2 = 0"), folder)
    intake.take_in(spark, folder, path)
    later = files.where("book % 2 = 1 OR book % 12 = 0").withColumn("text", F.when(F.col("book") % 12 == 0, F.concat("text", F.lit(" And more."))).otherwise(F.col("text")))
    text_files.write_files(later, folder, overwrite=True)
    intake.take_in(spark, folder, path)
    noted = intake.ledger(spark, path).select("path", "run", "error")
    last = noted.groupBy("path").agg(F.max("run").alias("run"), F.lit(True).alias("last"))
    found = intake.documents(spark, path).select("path", F.size("pages").alias("pages"), F.sha2(F.array_join("pages", "\n\n"), 256).alias("sha"), F.lit(True).alias("last"))
    rows = noted.join(last, ["path", "run"], "left").join(found, ["path", "last"], "left")
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("name"), "run", "error", "pages", "sha")


@query(
    f"""WITH {BOOKS_SQL}, files AS (SELECT book AS doc_id, source || CASE WHEN book % 7 = 3 THEN ' (2)' ELSE '' END AS stem, text FROM books),
p AS ({PAGINATE_SQL.replace("FROM documents", "FROM files")}), paged AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY page) AS text FROM p GROUP BY doc_id),
named AS (SELECT doc_id, stem, row_number() OVER (PARTITION BY stem ORDER BY doc_id) AS n FROM files)
SELECT stem || CASE WHEN n > 1 OR regexp_matches(stem, ' \\(\\d+\\)$') THEN ' (' || n || ')' ELSE '' END || '.txt' AS file_name, octet_length(encode(coalesce(text, ''))) AS length, sha256(coalesce(text, '')) AS sha
FROM named LEFT JOIN paged USING (doc_id)"""
)
def k1_text_files(spark, sf_dir):
    """Books whose names clash by the hundred, as files, and the folder read back."""
    name = F.concat("source", F.when(F.col("book") % 7 == 3, " (2)").otherwise(""), F.lit(".pdf"))
    docs = books(spark, sf_dir).select("book", name.alias("name"), paging.paginate(F.col("text")).alias("pages"))
    folder = _folder(spark, "texts")
    text_files.save_texts(docs, folder, "book")
    files = spark.read.format("binaryFile").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "length", F.sha2("content", 256).alias("sha"))


# ---------------------------------------------------------------- a library


_JOINED = "string_agg(text, chr(10) || chr(10) ORDER BY page)"
_WORDS = f"CAST(len(regexp_split_to_array({_trim('whole')}, {_sql_string(v.S + '+')})) AS INT)"


@query(
    f"""WITH p AS ({PAGINATE_SQL}), changed AS (
  SELECT doc_id, page, CASE WHEN doc_id % 10 = 3 AND page = 0 THEN 'Edited ' || lang ELSE p.text END AS text, source, CASE WHEN doc_id % 10 = 3 THEN 2 ELSE 1 END AS version
  FROM p JOIN documents USING (doc_id) WHERE doc_id % 20 <> 4 AND doc_id % 50 <> 7
  UNION ALL SELECT doc_id, 0, 'Again ' || lang, 'read again', 3 FROM documents WHERE doc_id % 20 = 4
  UNION ALL SELECT doc_id + 1000000000, 0, 'New ' || lang, 'new', 4 FROM documents WHERE doc_id % 25 = 0
)
SELECT doc_id, name, pages, {_WORDS} AS words, sha256(whole) AS sha, version
FROM (SELECT doc_id, any_value(source) AS name, CAST(count(*) AS INT) AS pages, {_JOINED} AS whole, CAST(any_value(version) AS BIGINT) AS version FROM changed GROUP BY doc_id)"""
)
def s12_q12_q15_library(spark, sf_dir):
    """A library of all documents in which pages are edited, documents read again (some
    fail), others added (some are there already) and taken out; each update writes the
    buckets it touches."""
    rows = read(spark, sf_dir, "documents")
    kept = ["doc_id", "name", "pages", "warnings", "words", "error"]

    def as_documents(df: DataFrame, name, pages) -> DataFrame:
        return paging.make_documents(df.select("doc_id", name.alias("name"), pages.alias("pages"), F.array().cast("array<string>").alias("warnings"))).select(*kept)

    path, one = new_path(spark, "library"), lambda word: F.array(F.concat(F.lit(word), "lang"))
    library.create(as_documents(rows, F.col("source"), paging.paginate(F.col("text"))).where("error IS NULL"), path)
    edited = rows.where("doc_id % 10 = 3")
    library.edit_pages(spark, path, edited.select("doc_id", F.lit(0).alias("page"), F.concat(F.lit("Edited "), "lang").alias("text")).unionByName(edited.select("doc_id", F.lit(99_999).alias("page"), F.lit("x").alias("text"))))
    again = as_documents(rows.where("doc_id % 10 = 4"), F.lit("read again"), one("Again ")).withColumn("error", F.when(F.col("doc_id") % 20 == 14, "failed"))
    library.reread(spark, path, again)
    more = rows.where("doc_id % 25 = 0")
    library.append(spark, path, as_documents(more.withColumn("doc_id", F.col("doc_id") + 1_000_000_000).unionByName(more), F.lit("new"), one("New ")))
    library.remove(spark, path, rows.where("doc_id % 50 = 7").select("doc_id"))
    found = library.read_library(spark, path)
    return found.select("doc_id", "name", F.size("pages").alias("pages"), "words", F.sha2(F.array_join("pages", "\n\n"), 256).alias("sha"), "version")


_AFTER = """SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN upper(text) ELSE text END AS text, CASE WHEN doc_id % 15 = 3 THEN NULL ELSE lang END AS lang, source FROM documents WHERE doc_id % 50 <> 7
UNION ALL SELECT doc_id + 1000000000, text, lang, source FROM documents WHERE doc_id % 25 = 0"""


@query(
    f"""WITH a AS ({_AFTER})
SELECT doc_id, CASE WHEN d.doc_id IS NULL THEN 'inserted' WHEN a.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS change,
  CASE WHEN d.doc_id IS NOT NULL AND a.doc_id IS NOT NULL THEN concat_ws(',', CASE WHEN d.text IS DISTINCT FROM a.text THEN 'text' END, CASE WHEN d.lang IS DISTINCT FROM a.lang THEN 'lang' END) END AS columns
FROM documents d FULL JOIN a USING (doc_id) WHERE d.doc_id IS NULL OR a.doc_id IS NULL OR d.text IS DISTINCT FROM a.text OR d.lang IS DISTINCT FROM a.lang"""
)
def q12_change_feed(spark, sf_dir):
    before = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    before.createOrReplaceTempView("parsefold_documents")
    after = spark.sql(_AFTER.replace("FROM documents", "FROM parsefold_documents"))
    return library.changes(before, after).withColumn("columns", F.array_join("columns", ","))


_EDITED_PAGES = PAGES_SQL + ", edited AS (SELECT doc_id, page, CASE WHEN doc_id % 10 = 3 AND page = 0 THEN 'Gulls[8] and kelp [9; 31].' ELSE text END AS text FROM pages)"
_CITED = 'SELECT doc_id, page, CAST(start AS INT) AS start, CAST(start + length(text) AS INT) AS "end", text, reason FROM citations'
_BEFORE_EDIT = f"WITH {PAGES_SQL}, {CITATIONS_SQL} {_CITED}"
_AFTER_EDIT = f"WITH {_EDITED_PAGES}, {CITATIONS_SQL.replace('FROM pages', 'FROM edited')} {_CITED}"


@query(f"SELECT *, 'removed' AS change FROM (({_BEFORE_EDIT}) EXCEPT ALL ({_AFTER_EDIT})) UNION ALL SELECT *, 'inserted' FROM (({_AFTER_EDIT}) EXCEPT ALL ({_BEFORE_EDIT}))")
def q12_omission_changes(spark, sf_dir):
    before = documents(spark, sf_dir)
    pages = F.transform("pages", lambda p, i: F.when((F.col("doc_id") % 10 == 3) & (i == 0), "Gulls[8] and kelp [9; 31].").otherwise(p))
    spans = lambda df: exploded(paging.make_documents(df), clutter.raw_spans(F.col("pages"), ("citation",)), "doc_id")
    return library.span_changes(spans(before), spans(before.withColumn("pages", pages)))


# ---------------------------------------------------------------- sessions


@query(f"""WITH logs AS ({_LOG}), called AS (SELECT * FROM logs WHERE command IN ('end', 'error')), told AS (SELECT * FROM logs WHERE command NOT IN ('end', 'error'))
SELECT c.session_key, c.seq, c.command, t.seq AS last_seq, t.command AS last_command, t.number AS last_number FROM called c ASOF LEFT JOIN told t ON c.session_key = t.session_key AND c.seq >= t.seq""")
def m2_last_command(spark, sf_dir):
    """Each callback with the last command of its session before it."""
    rows, back = log(spark, sf_dir), F.col("command").isin("end", "error")
    return as_of(rows.where(back).select("session_key", "seq", "command"), rows.where(~back).select("session_key", "seq", "command", "number"), "session_key", "seq")


IDLE, DELAY = "2 days", "1 hour"
_TIMED = _LOG.replace("AS epoch FROM events", "AS epoch, ts FROM events")
_SESSIONS_SQL = f"""WITH RECURSIVE timed AS ({_TIMED}), parted AS (
  SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY session_key ORDER BY seq) AS part
  FROM (SELECT *, coalesce(epoch_ms(ts) - epoch_ms(lag(ts) OVER (PARTITION BY session_key ORDER BY seq)) > 172800000, false) AS gap FROM timed)
), logs AS (SELECT session_key || '/' || part AS session_key, seq, command, number, text, epoch FROM parted), {_PLAYER_PARTS}, ends AS (
  SELECT session_key || '/' || part AS session_key, seq, last, part < max(part) OVER (PARTITION BY session_key) AS followed
  FROM (SELECT session_key, part, max(seq) AS seq, max(epoch_ms(ts)) AS last FROM parted GROUP BY session_key, part)
), stands AS (SELECT session_key, arg_max("index", n) AS "index", arg_max(epoch, n) AS epoch FROM run GROUP BY session_key)
SELECT split_part(session_key, '/', 1) AS session_key, seq, 0 AS step, "index", status, epoch, said, message FROM run WHERE emits
UNION ALL SELECT split_part(session_key, '/', 1), e.seq, -1, s."index", 'expired', s.epoch, NULL, NULL
FROM ends e JOIN stands s USING (session_key) WHERE followed OR last + 172800000 + 1 <= (SELECT max(epoch_ms(ts)) FROM timed) - 3600000"""


@query(_SESSIONS_SQL)
def m1_m2_sessions(spark, sf_dir):
    """The events' log as a stream in two runs that share their state: the second plays what
    came after the first had ended."""
    read(spark, sf_dir, "events").createOrReplaceTempView("parsefold_events")
    rows = spark.sql(_TIMED.replace("FROM events", "FROM parsefold_events")).withColumn("ts", F.col("ts").cast("timestamp"))
    base = new_path(spark, "sessions")
    half = rows.agg(F.expr("percentile_approx(seq, 0.5)")).first()[0] or 0
    for part in (F.col("seq") < half, F.col("seq") >= half):
        rows.where(part).write.mode("append").parquet(f"{base}/log")
        stream = spark.readStream.schema(rows.schema).parquet(f"{base}/log")
        sessions.run_available(sessions.play_sessions(stream, IDLE, DELAY), f"{base}/played", f"{base}/state")
    return spark.read.parquet(f"{base}/played")


# ---------------------------------------------------------------- JSON rows

SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("kind", T.StringType(), False),
        T.StructField("body", T.StructType([T.StructField("text", T.StringType(), False), T.StructField("lang", T.StringType()), T.StructField("size", T.LongType())]), False),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("value", T.DoubleType()),
    ]
)


def _json_texts(struct, json, tags: str) -> str:
    """JSON of all documents and events in either engine, some of it broken by number:
    struct writes pairs as a struct, json a struct as text, tags is a list of two texts."""
    body = struct(("text", "text"), ("lang", "CASE WHEN doc_id % 7 = 2 THEN NULL ELSE lang END"), ("size", "n_chars"))
    whole = json(struct(("id", "doc_id"), ("kind", "'document'"), ("body", body), ("tags", tags)))
    loud = json(struct(("id", "source"), ("kind", "'document'"), ("body", struct(("text", "text"), ("lang", "lang"), ("size", "source"), ("mood", "doc_id")))))
    flat = json(struct(("id", "doc_id"), ("body", "lang"), ("more", "1")))
    bare = json(struct(("id", "doc_id"), ("kind", "'document'"), ("body", struct(("lang", "lang")))))
    event = lambda value: json(struct(("id", "event_id"), ("kind", "event_type"), ("body", struct(("text", "event_type"))), ("value", value)))
    return f"""SELECT 'd' || doc_id AS row_id, CASE CAST(doc_id % 11 AS INT) WHEN 1 THEN substr({whole}, 1, length({whole}) - 1) WHEN 2 THEN '[' || {whole} || ']' WHEN 3 THEN {loud}
    WHEN 4 THEN {flat} WHEN 5 THEN CASE WHEN doc_id % 2 = 0 THEN '' ELSE NULL END WHEN 6 THEN {bare} ELSE {whole} END AS json FROM documents
  UNION ALL SELECT 'e' || event_id, CASE CAST(event_id % 13 AS INT) WHEN 5 THEN '"' || event_type || '"' WHEN 6 THEN {event("event_type")} ELSE {event("value")} END FROM events"""


_DUCK = (lambda *pairs: "{" + ", ".join(f"'{k}': {x}" for k, x in pairs) + "}", lambda x: f"CAST(to_json({x}) AS VARCHAR)", "[source, lang]")
_SPARK = (lambda *pairs: "named_struct(" + ", ".join(f"'{k}', {x}" for k, x in pairs) + ")", lambda x: f"to_json({x}, map('ignoreNullFields', 'false'))", "array(source, lang)")
_J = "json_extract(json, '$.{}')"
JSON_SQL = f"""WITH texts AS ({_json_texts(*_DUCK)}), typed AS (
  SELECT row_id, json, coalesce(json_valid(json), false) AS valid, CASE WHEN json_valid(json) THEN json_type(json) = 'OBJECT' ELSE false END AS obj FROM texts
), fields AS (
  SELECT row_id, json, valid, obj, CASE WHEN obj THEN json_type(json, '$.id') END AS ti, CASE WHEN obj THEN json_type(json, '$.kind') END AS tk, CASE WHEN obj THEN json_type(json, '$.body') END AS tb,
    CASE WHEN obj THEN json_type(json, '$.body.text') END AS tt, CASE WHEN obj THEN json_type(json, '$.body.lang') END AS tl, CASE WHEN obj THEN json_type(json, '$.body.size') END AS ts, CASE WHEN obj THEN json_type(json, '$.tags') END AS tg, CASE WHEN obj THEN json_type(json, '$.value') END AS tv FROM typed
), judged AS (
  SELECT *, concat_ws('; ',
    CASE WHEN tb <> 'NULL' AND tb <> 'OBJECT' THEN 'body: not an object' END, CASE WHEN tb IS NULL OR tb = 'NULL' THEN 'body: missing' END,
    CASE WHEN ti NOT IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'NULL') THEN 'id: not bigint' END, CASE WHEN ti IS NULL OR ti = 'NULL' THEN 'id: missing' END,
    CASE WHEN tk IS NULL OR tk = 'NULL' THEN 'kind: missing' END,
    CASE WHEN tb = 'OBJECT' AND (tt IS NULL OR tt = 'NULL') THEN 'body.text: missing' END,
    CASE WHEN ts NOT IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'NULL') THEN 'body.size: not bigint' END,
    CASE WHEN tv NOT IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'NULL') THEN 'value: not double' END) AS wrong FROM fields
)
SELECT row_id, CASE WHEN json IS NULL THEN '{NO_ROW}' WHEN NOT valid THEN '{NOT_JSON}' WHEN NOT obj THEN '{NOT_OBJECT}' WHEN wrong <> '' THEN wrong END AS error,
  CASE WHEN ti IN ('BIGINT', 'UBIGINT') THEN CAST({_J.format("id")} AS BIGINT) END AS id, json_extract_string(json, CASE WHEN tk = 'VARCHAR' THEN '$.kind' END) AS kind,
  CASE WHEN tt = 'VARCHAR' THEN sha256(json_extract_string(json, '$.body.text')) END AS text, CASE WHEN tl = 'VARCHAR' THEN json_extract_string(json, '$.body.lang') END AS lang,
  CASE WHEN ts IN ('BIGINT', 'UBIGINT') THEN CAST({_J.format("body.size")} AS BIGINT) END AS size, CASE WHEN tg = 'ARRAY' THEN array_to_string(CAST({_J.format("tags")} AS VARCHAR[]), ',') END AS tags,
  CASE WHEN tv IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN CAST({_J.format("value")} AS DOUBLE) END AS value,
  CASE WHEN NOT obj THEN '' ELSE array_to_string(list_sort(list_concat(list_filter(json_keys(json), lambda k: k NOT IN ('id', 'kind', 'body', 'tags', 'value')),
    list_transform(list_filter(coalesce(CASE WHEN tb = 'OBJECT' THEN json_keys(json, '$.body') END, []), lambda k: k NOT IN ('text', 'lang', 'size')), lambda k: 'body.' || k))), ',') END AS unknown
FROM judged"""


@query(JSON_SQL)
def a1_json_rows(spark, sf_dir):
    """What programs send, as JSON: a row or an error for each document and event."""
    for name in ("documents", "events"):
        read(spark, sf_dir, name).createOrReplaceTempView(f"parsefold_{name}")
    sql = _json_texts(*_SPARK).replace("FROM documents", "FROM parsefold_documents").replace("FROM events", "FROM parsefold_events")
    found = checked_json(spark.sql(sql), "json", SCHEMA)
    return found.select("row_id", F.col("json_error").alias("error"), "id", "kind", F.sha2("body_text", 256).alias("text"), F.col("body_lang").alias("lang"), F.col("body_size").alias("size"), F.array_join("tags", ",").alias("tags"), "value", F.array_join("json_unknown", ",").alias("unknown"))


# ---------------------------------------------------------------- totals


@query(
    f"""WITH {LINES_SQL}, latched AS (SELECT *, false AS listed FROM lines), {CITATIONS_SQL}, spans AS (
  SELECT doc_id, text, reason FROM citations UNION ALL SELECT doc_id, text, reason FROM ({_at_start(v.NUMBERED_LABEL, v.PARAGRAPH_LABEL, 2)})
)
SELECT lang, source, reason, grouping(lang, source, reason) AS level, count(*) AS omissions, CAST(sum(length(text)) AS BIGINT) AS characters, count(DISTINCT doc_id) AS documents
FROM spans JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((lang, source, reason), (lang, reason), (source), ())""".replace("SELECT doc_id, text, reason FROM citations", "SELECT doc_id, c.text, reason FROM citations c").replace("sum(length(text))", "sum(length(spans.text))")
)
def q2_omission_totals(spark, sf_dir):
    docs = made(spark, sf_dir).select("doc_id", "lang", "source", "pages")
    spans = exploded(docs, clutter.raw_spans(F.col("pages"), ("numbered", "citation")), "doc_id", "lang", "source")
    return views.omission_totals(spans, [("lang", "source", "reason"), ("lang", "reason"), ("source",), ()])


_PLAIN_PAGES = f"pages AS ({PAGINATE_SQL})"


@query(f"WITH {PASSAGES_SQL.replace(PAGES_SQL, _PLAIN_PAGES)} SELECT source, count(DISTINCT doc_id) AS documents, count(p.text) AS passages, true AS words_close, true AS median_close FROM documents LEFT JOIN (SELECT doc_id, text FROM passages) p USING (doc_id) GROUP BY source")
def q18_reading_sketches(spark, sf_dir):
    """Sketches of two halves of the documents, stored, merged, and held against exact
    answers: the estimates are within their stated bounds."""
    docs = paging.make_documents(read(spark, sf_dir, "documents").select("doc_id", "source", paging.paginate(F.col("text")).alias("pages"))).select("doc_id", "source", "passages")
    path = new_path(spark, "sketches")
    for half in (0, 1):
        views.reading_sketches(docs.where(F.col("doc_id") % 2 == half)).write.mode("append").parquet(path)
    merged = views.merged_sketches(spark.read.parquet(path))
    middle = merged.withColumn("median", F.when(F.kll_sketch_get_n_bigint("lengths") > 0, F.kll_sketch_get_quantile_bigint("lengths", F.lit(0.5))))
    rows = docs.select("source", F.explode_outer(F.transform("passages", lambda p: p["text"])).alias("text"))
    words = rows.select("source", F.explode_outer(F.split("text", rf"{v.S}+")).alias("word")).distinct().groupBy("source").agg(F.count("word").alias("distinct"))
    ranked = rows.join(middle.select("source", "median"), "source").groupBy("source").agg(F.count("text").alias("passages"), *[F.count_if(x).alias(n) for n, x in (("below", F.char_length("text") < F.col("median")), ("upto", F.char_length("text") <= F.col("median")))])
    both = middle.join(words, "source").join(ranked, "source")
    close = F.abs(F.hll_sketch_estimate("words") - F.col("distinct")) <= views.DISTINCT_ERROR * F.col("distinct")
    half_way = (F.col("below") <= (0.5 + views.RANK_ERROR) * F.col("passages")) & (F.col("upto") >= (0.5 - views.RANK_ERROR) * F.col("passages"))
    return both.select("source", "documents", F.kll_sketch_get_n_bigint("lengths").alias("passages"), close.alias("words_close"), half_way.alias("median_close"))


@query(f"WITH {PLAN_SQL} SELECT doc_id, queue_index, source_index, page, text FROM queue")
def v3_v8_in_sql(spark, sf_dir):
    """The speech queue as a plan in SQL: pages, passages and speech by table functions,
    omissions by an interval join."""
    sql.register(spark)
    resolved(spark, sf_dir).createOrReplaceTempView("parsefold_reading")
    return spark.sql(
        """WITH pages AS (SELECT doc_id, page, text FROM parsefold_reading LATERAL VIEW posexplode(pages) AS page, text),
        passages AS (SELECT * FROM passages_of(TABLE(SELECT doc_id, page, text FROM pages))),
        standing AS (SELECT doc_id, o.* FROM parsefold_reading LATERAL VIEW explode(omissions) AS o WHERE doc_id % 5 <> 0 AND NOT (doc_id % 5 = 1 AND o.reason = 'Paragraph label')),
        cuts AS (
          SELECT p.doc_id, p.source_index, p.page, p.text, IF(o.start IS NULL, NULL, greatest(o.start - p.start, 0)) AS cut_start, least(o.end - p.start, char_length(p.text)) AS cut_end, omission_fill(o.reason) AS fill
          FROM passages p LEFT JOIN standing o ON p.doc_id = o.doc_id AND p.page = o.page AND o.start < p.end AND o.end > p.start
        )
        SELECT doc_id, queue_index, source_index, page, text FROM speak(TABLE(SELECT doc_id, source_index, page, text, cut_start, cut_end, fill FROM cuts))"""
    )
