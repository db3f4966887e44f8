"""A training corpus from raw documents: quality, toxicity, near-duplicates, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parsefold.llm import packing, quality, simhash, toxicity
from parsefold.llm.common import fresh, table

TOXIC_AT = 0.5

#: No SQL: classifiers are trained and fingerprints joined. Tests hold each stage against a
#: plain version of its decision: scores row by row, all pairs of fingerprints, the library.
ORACLE_SQL = None


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _where(docs: DataFrame, score, keep: Callable) -> DataFrame:
    name = fresh(docs, "__score")
    return docs.withColumn(name, score).where(keep(F.col(name))).drop(name)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts: a score of quality.KEEP_AT or more.
    Null texts count as empty; repeated rows and rows without id are judged by their text,
    long texts whole; an empty table stays empty. Columns are kept as they are."""
    net = quality.fit(docs, _labels(spark, sf_dir))
    return _where(docs, quality.scorer(docs, net), lambda s: s >= quality.KEEP_AT)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models do not reject: a score under TOXIC_AT. Null texts
    count as empty; repeated rows and rows without id are judged by their text, long texts
    whole; an empty table stays empty. Columns are kept as they are."""
    model = toxicity.fit(docs, _labels(spark, sf_dir))
    return _where(docs, toxicity.scorer(docs, model), lambda s: s < TOXIC_AT)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near-duplicates. Texts
    that are null, empty or blank are equal, so one of them stays; of rows that repeat an id
    one stays; rows without id go where their group has another. An empty table stays
    empty. Columns are kept as they are."""
    return simhash.deduplicate(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of the documents left, with its sequence and place. A null text is one
    piece of one token, repeated rows are pieces of their own, and a very long text is cut
    into as many as it needs; an empty table gives no piece."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_good),
    ("toxicity", drop_toxic),
    ("simhash near-dedup", one_of_each),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
