"""What the training-data operators share: the shared folder, shipping of this
package to executors, and vectorised views of a batch of texts."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parsefold.functions.arrays import fresh  # noqa: F401  for the operators
from parsefold.functions.shipping import ship  # noqa: F401

#: The characters that separate words, fixed by the word pattern [^\x20\x09-\x0D]+.
SPACES = " \t\n\x0b\x0c\r"


def session() -> SparkSession:
    active = SparkSession.getActiveSession()
    if active is None:
        raise RuntimeError("no active SparkSession")
    return active


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir, or, where that is
    unset on one machine (tests), a temporary one that is set as checkpoint folder. A
    cluster without the setting is refused."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named is None:
        named = getattr(sc, "_parsefold_shared", None)
        if named is None and sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if named is None:
            named = tempfile.mkdtemp(prefix="parsefold-")
            sc._parsefold_shared = named
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/parsefold/{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, lost
    executors cost nothing, and the reader knows the size, so that Spark decides
    by its own threshold whether a join may broadcast it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key with more than a 1/HOT of a table's rows, and more than LEAST, is split in joins.
HOT, LEAST, SALTS = 512, 64, 64


def join_to_one(many: DataFrame, one: DataFrame, key: str, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """many joined with one, which has at most one row for each key (a column of both). The
    rows of a hot key are dealt to SALTS tasks, each of which gets that key's one row; no
    table has more than HOT hot keys. counts(key, count), where it is known already, says
    how many rows of many a key has; keys left out are not hot."""
    counts = many.groupBy(key).count() if counts is None else counts
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    hot = [r[0] for r in counts.where((F.col("count") * HOT > total) & (F.col("count") > LEAST)).select(key).collect()]
    if not hot:
        return many.join(one, key, how)
    salt = fresh(many, "__salt")
    is_hot = F.col(key).isin(hot)
    row = F.xxhash64(*many.columns)
    dealt = many.withColumn(salt, F.when(is_hot, F.pmod(row, F.lit(SALTS)).cast("int")).otherwise(0))
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(one.withColumn(salt, F.explode(copies)), [key, salt], how).drop(salt)


def clean(spark: SparkSession) -> None:
    """Have the driver collect plans that nothing refers to any more: Spark then deletes
    their shuffle files on the executors' disks, which it would else keep for long."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def utf8(text: Column) -> Column:
    """The bytes of a text; null counts as empty."""
    return F.coalesce(text.cast("string"), F.lit("")).cast("binary")


def pinned(df: DataFrame, value: Column, name: str) -> DataFrame:
    """df with value as a column that is evaluated where it stands: Spark does not take a
    Python function out of a projection once its argument has grown a lambda."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def crc_fold(key: Column, folds: int = 5) -> Column:
    """crc32 of the key written as text, mod folds."""
    return F.crc32(key.cast("string").cast("binary")) % F.lit(folds)


def flat(parts: Iterable[list]) -> list:
    out: list = []
    for p in parts:
        out += p
    return out


def offsets(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def segment_sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i + 1]], zero where that is empty."""
    total = np.zeros(len(values) + 1, dtype=np.float64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def segment_max(values: np.ndarray, bounds: np.ndarray, empty: float) -> np.ndarray:
    out = np.full(len(bounds) - 1, empty, dtype=np.float64)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        out[full] = np.maximum.reduceat(values, bounds[full])
    return out


class Words:
    """The words of a batch of texts: one id for each token, each distinct word
    once. Splitting is on ASCII white space, so that a word is a run of
    [^\\x20\\x09-\\x0D]."""

    def __init__(self, texts: list[bytes]):
        split = [t.split() for t in texts]
        self.bounds = offsets(np.fromiter(map(len, split), np.int64, len(split)))
        tokens = flat(split)
        self.distinct = list(dict.fromkeys(tokens))
        number = dict(zip(self.distinct, range(len(self.distinct))))
        self.ids = np.fromiter(map(number.__getitem__, tokens), np.int64, len(tokens))

    def characters(self) -> tuple[np.ndarray, np.ndarray]:
        """Code points of the distinct words, each between a space and a space, and
        the bounds of each."""
        joined = b" " + b"  ".join(self.distinct) + b" " if self.distinct else b""
        points = np.frombuffer(joined.decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        spaces = np.flatnonzero(points == 32)
        starts, ends = spaces[0::2], spaces[1::2] + 1
        return points, np.concatenate([starts, ends[-1:]]).astype(np.int64) if len(ends) else np.zeros(1, np.int64)


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return freed memory to the system: workers outlive the stages they serve."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= MIX1
    x ^= x >> np.uint64(27)
    x *= MIX2
    x ^= x >> np.uint64(31)
    return x


def slices(texts: pa.Array, rows: int = 256) -> Iterator[list[bytes]]:
    """The values of an array as lists of some rows: never all of them at once."""
    for at in range(0, len(texts), rows):
        yield texts.slice(at, rows).to_pylist()


def batches(texts: Iterator[list[bytes]], most: int = 1 << 20) -> Iterator[list[bytes]]:
    """Cut lists of texts into lists of about `most` bytes; a longer text stands alone."""
    for some in texts:
        at, held = 0, 0
        for i, t in enumerate(some):
            if held and held + len(t) > most:
                yield some[at:i]
                at, held = i, 0
            held += len(t)
        if at < len(some):
            yield some[at:]
    give_back()
