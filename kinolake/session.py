"""Session settings that the engine expects."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: UTC makes wall-clock arithmetic equal to naive timestamps; AQE coalesces partitions and splits skewed joins at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.files.ignoreCorruptFiles": "false",
}


def session(master: str | None = None, app: str = "kinolake", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder below the one that driver and executors share (spark.checkpoint.dir; unset, a folder of this machine on a local master only)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="kinolake-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root}/kinolake-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to a shared folder and reads it back: what hangs on partitions is then decided once, whatever is run again."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Scheduler pools of a front end (STM07): answers to the user first, then predictions and training, then eager extraction.
POOLS = ("user", "background", "chore")


@contextmanager
def pool(spark: SparkSession, name: str) -> Iterator[None]:
    """Jobs of this thread run in the named FAIR pool (spark.scheduler.mode=FAIR)."""
    if name not in POOLS:
        raise ValueError(f"no pool {name}")
    before = spark.sparkContext.getLocalProperty("spark.scheduler.pool")
    spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
    try:
        yield
    finally:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", before)
