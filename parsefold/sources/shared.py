"""The folder that all executors and the driver see."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or, where that is unset on one machine (tests), a temporary
    folder. A cluster without the setting is refused."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named is None:
        named = getattr(sc, "_parsefold_shared", None)
        if named is None and sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if named is None:
            named = sc._parsefold_shared = tempfile.mkdtemp(prefix="parsefold-")
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/parsefold/{name}-{uuid.uuid4().hex}"


def clean(spark: SparkSession) -> None:
    """Have the driver collect plans that nothing refers to any more: Spark then deletes
    their shuffle files on the executors' disks, which it would else keep for long."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
