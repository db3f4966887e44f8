"""The queries an application asks of documents, plans and players."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parsefold.functions import fixed_values as v
from parsefold.functions.arrays import exploded, fresh
from parsefold.functions.text import let, trim
from parsefold.operators.paging import make_documents


def selected(documents: DataFrame, wanted, fallback: DataFrame, key: str = "doc_id") -> DataFrame:
    """The document asked for, or the fallback where there is none."""
    n = fresh(documents, "__n")
    ranked = documents.where(F.col(key) == wanted).withColumn(n, F.lit(0)).unionByName(fallback.withColumn(n, F.lit(1)))
    return ranked.orderBy(n).limit(1).drop(n)


def on_page(rows: DataFrame, page) -> DataFrame:
    return rows.where(F.col("page") == page)


def passages_on_page(documents: DataFrame, page, key: str = "doc_id") -> DataFrame:
    """Passages of one page with their place among all passages of the document."""
    return documents.select(key, F.posexplode("passages").alias("source_index", "p")).where(F.col("p.page") == page).select(key, "source_index", "p.*")


def paragraph_groups(passages: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, page, group, paragraph, first, last): runs of passages of one paragraph."""
    w = Window.partitionBy(key, "page").orderBy("source_index")
    changed = F.coalesce((F.col("paragraph") != F.lag("paragraph").over(w)).cast("int"), F.lit(1))
    c = fresh(passages, "__c")
    marked = passages.withColumn(c, changed).withColumn("group", F.sum(c).over(w) - 1)
    return marked.groupBy(key, "page", "group").agg(F.min("paragraph").alias("paragraph"), F.min("source_index").alias("first"), F.max("source_index").alias("last"))


def percent_read(status: Column, index: Column, length: Column) -> Column:
    return F.when(status == "ended", 100).otherwise(F.floor(index / F.greatest(length, F.lit(1)) * 100 + 0.5).cast("int"))


def minutes(words: Column, length: Column, speed: Column) -> Column:
    """Reading time, at least a minute; none without a queue."""
    return F.when(length == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(words / (v.WORDS_PER_MINUTE * speed))).cast("int"))


def speeds() -> Column:
    return F.transform(F.sequence(F.lit(2), F.lit(8)), lambda n: n * F.lit(0.25).cast("double"))


def first_of_page(queue: Column, page) -> Column:
    """The first queue index of a page, -1 if it has none."""
    return F.coalesce(F.get(F.filter(queue, lambda q: q["page"] == page), F.lit(0))["queue_index"], F.lit(-1))


def queue_of_passage(queue: Column, source_index) -> Column:
    return F.get(F.filter(queue, lambda q: q["source_index"] == source_index), F.lit(0))["queue_index"]


def current_passage(queue: Column, index: Column) -> Column:
    return F.coalesce(F.get(queue, index)["source_index"], F.lit(-1))


def library(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    pages = F.size("pages")
    return documents.select(key, "name", "kind", pages.alias("pages"), F.concat(pages.cast("string"), F.when(pages == 1, " page").otherwise(" pages")).alias("label"))


def omission_totals(omissions: DataFrame, sets: list[tuple[str, ...]], key: str = "doc_id") -> DataFrame:
    """Totals of omission rows over several groupings at once: the columns grouped by (null
    where a grouping does not use them), `level` (grouping ids: a bit for each column, set
    where it is not used, the first the highest), omissions, characters and documents. Rows
    are counted before they are shuffled; documents are told apart by an aggregate by key.
    Without omissions there are no rows, not even for an empty grouping."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    grouped = omissions.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns])
    return grouped.agg(
        F.grouping_id().cast("long").alias("level"),
        F.count("*").alias("omissions"),
        F.coalesce(F.sum(F.char_length("text")), F.lit(0)).cast("long").alias("characters"),
        F.count_distinct(key).alias("documents"),
    )


#: Bits of a sketch's registers, and entries of a quantile sketch: with these an estimate is
#: within DISTINCT_ERROR of the number of distinct words, and a quantile's rank within
#: RANK_ERROR, in all but rare cases.
DISTINCT_BITS, QUANTILE_ENTRIES = 14, 400
DISTINCT_ERROR, RANK_ERROR = 0.03, 0.015


def reading_sketches(documents: DataFrame, by: str = "source", key: str = "doc_id") -> DataFrame:
    """(by, words, lengths, documents): for each group a sketch of the distinct words of its
    passages and one of their lengths in characters, as binary columns that are stored and
    merged with those of other runs. Words are runs of what is not white space, told apart
    by case. A group of any size is summed up task by task; a group without passages has
    empty sketches."""
    text = F.transform("passages", lambda p: p["text"])
    rows = documents.select(by, key, F.explode_outer(text).alias("text"))
    words = rows.select(by, F.explode_outer(F.split("text", rf"{v.S}+")).alias("word"))
    one = words.groupBy(by).agg(F.hll_sketch_agg("word", DISTINCT_BITS).alias("words"))
    other = rows.groupBy(by).agg(F.kll_sketch_agg_bigint(F.char_length("text").cast("long"), QUANTILE_ENTRIES).alias("lengths"), F.count_distinct(key).alias("documents"))
    return one.join(other.withColumnRenamed(by, "__by"), F.col(by).eqNullSafe(F.col("__by"))).drop("__by")


def merged_sketches(stored: DataFrame, by: str = "source") -> DataFrame:
    """The sketches of several runs, whose documents are different ones, as one a group."""
    return stored.groupBy(by).agg(F.hll_union_agg("words").alias("words"), F.kll_merge_agg_bigint("lengths").alias("lengths"), F.sum("documents").alias("documents"))


def skipped_passages(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each passage, and whether the queue passes it over. What the queue lacks is found by
    hashing, and both parts are put in order again: no passage is looked up in the queue."""

    def marked(ids: Column) -> Column:
        every = F.when(F.size("passages") > 0, F.sequence(F.lit(0), F.size("passages") - 1)).otherwise(F.array().cast("array<int>"))
        told = lambda some, skipped: F.transform(some, lambda i: F.struct(i.alias("source_index"), F.lit(skipped).alias("skipped")))
        return F.sort_array(F.concat(told(ids, False), told(F.array_except(every, ids), True)))

    inside = let(F.transform("queue", lambda q: q["source_index"]), marked)
    shown = F.transform(inside, lambda x: F.struct(x["source_index"].alias("source_index"), F.get("passages", x["source_index"])["page"].alias("page"), x["skipped"].alias("skipped")))
    return exploded(documents, shown, key)


def edit_page(documents: DataFrame, key_value, page, text: Column, key: str = "doc_id") -> DataFrame:
    """The document with one page replaced and all that follows from its pages made anew;
    id, name and warnings stay."""
    pages = F.transform("pages", lambda p, i: F.when(i == page, text).otherwise(p))
    edited = make_documents(documents.where(F.col(key) == key_value).drop("passages", "words", "error").withColumn("pages", pages))
    return documents.where(F.col(key) != key_value).unionByName(edited.select(*documents.columns))


def restore(restored: DataFrame, ids: DataFrame, read: bool = True) -> DataFrame:
    """The set of (doc_id, omission_id) with some added (read) or taken away."""
    return restored.unionByName(ids).distinct() if read else restored.join(ids, ["doc_id", "omission_id"], "left_anti")


def restored_sets(restored: DataFrame) -> DataFrame:
    return restored.groupBy("doc_id").agg(F.collect_set("omission_id").alias("restored"))


def append(documents: DataFrame, more: DataFrame) -> DataFrame:
    return documents.unionByName(more, allowMissingColumns=True)


def status_label(length: Column, status: Column) -> Column:
    return F.when(length == 0, "No readable passages").when(status == "playing", "Reading").when(status == "paused", "Paused").when(status == "ended", "Finished").otherwise("Ready")


def resolve_voice(voices: DataFrame, chosen: str | None) -> DataFrame:
    """The voice to use, or no row: 'system' is the device's own; an id is that voice or
    none; without a choice, the first whose trimmed name is the preferred one."""
    if chosen == "system":
        return voices.limit(0)
    wanted = F.col("voice_uri") == chosen if chosen is not None else F.lower(trim(F.col("name"))) == v.PREFERRED_VOICE.lower()
    return voices.where(wanted).orderBy("ord").limit(1)


def voice_menu(voices: DataFrame) -> DataFrame:
    """The device's own voice first, then all others in order."""
    own = voices.sparkSession.range(1).select(F.lit(-1).alias("ord"), F.lit("system").alias("value"), F.lit("Device default").alias("label"))
    return own.unionByName(voices.select("ord", F.col("voice_uri").alias("value"), F.concat("name", F.lit(" ("), "lang", F.lit(")")).alias("label")))


def unique_errors(errors: DataFrame) -> DataFrame:
    """(message, value): each message once, in order of first place, with its last value."""
    by = errors.groupBy("message").agg(F.min("ord").alias("ord"), F.max_by("value", "ord").alias("value"))
    return by.select("ord", "message", "value")


def shown_series(items: DataFrame, item: str = "item") -> DataFrame:
    """The items of a chart that have a label at all: those of type 'none' are dropped."""
    return items.where(F.coalesce(F.try_element_at(F.col(item), F.lit("type")) != "none", F.lit(True)))


def series_key(item: Column, name_key: str | None = None) -> Column:
    """What an item (a map of its fields) is looked up by: the name key asked for, its name,
    its data key, or 'value'."""
    fields = [F.try_element_at(item, F.lit(n)) for n in ("name", "dataKey")]
    return F.coalesce(F.lit(name_key).cast("string"), *fields, F.lit("value"))


def series_label(config: Column, key: Column, item: Column, payload: Column) -> Column:
    """The label of a chart series: the item's field of that key, or else its payload's,
    names an entry of config; where there is none, the key itself does."""
    named = F.coalesce(F.try_element_at(item, key), F.try_element_at(payload, key), key)
    return F.coalesce(F.try_element_at(config, named), F.try_element_at(config, key))
