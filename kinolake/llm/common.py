"""Shared helpers: the shared work folder, written intermediate tables, word hashing, connected components."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word everywhere in this subpackage: a run without the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: A Python worker forgets its word cache beyond so many entries, so its memory stays bounded.
CACHE_WORDS = 300_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def importable(spark: SparkSession) -> None:
    """Python workers get this package's parent folder on their path, as the driver has it."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    path = env.get("PYTHONPATH", "")
    if root not in path.split(":"):
        env["PYTHONPATH"] = f"{path}:{root}".strip(":")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a folder of our own on a master of one machine, as in
    tests; on a cluster an error, as no machine's own folder would do."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="kinolake-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/kinolake-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, survives lost executors. With free, shuffle files of finished stages go."""
    spark, schema = df.sparkSession, df.schema
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    del df  # with its plan
    if free:
        release(spark)
    return spark.read.schema(schema).parquet(path)


def bucketed(df: DataFrame, name: str, by: str) -> DataFrame:
    """Writes df to the shared folder in as many buckets of column `by` as there are shuffle partitions and reads it back, so that grouping by it moves
    nothing. Buckets need a table's name while they are written; it leaves the catalogue at once, the files stay."""
    spark, table_name = df.sparkSession, f"kinolake_{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(partitions(spark), by).option("compression", "zstd").option("path", scratch(spark, name)).saveAsTable(table_name)
    out = spark.table(table_name).select("*")
    spark.sql(f"DROP TABLE {table_name}")
    return out


def appended(df: DataFrame, table_name: str, path: str, by: str) -> DataFrame:
    """Adds df to the table of that name at path, in the shared folder, bucketed as in bucketed, and reads all of it, so that grouping all that was
    added by `by` moves nothing (a union of bucketed tables would). Shuffle files of finished stages go; the caller drops the table, the files stay."""
    spark, n = df.sparkSession, partitions(df.sparkSession)
    df.repartition(n, by).write.mode("append").bucketBy(n, by).option("compression", "zstd").option("path", path).saveAsTable(table_name)
    del df
    release(spark)
    return spark.table(table_name).select("*")


def bucketed_pair(df: DataFrame, name: str, by: str) -> tuple[DataFrame, DataFrame, str]:
    """As bucketed, for rows of which those with true in column `brief` are needed only for a while: (the lasting rows in buckets, the brief
    rows, the brief rows' folder). Each kind has a folder of its own."""
    spark = df.sparkSession
    path = scratch(spark, name)
    table_name, n = f"kinolake_{name}_{uuid.uuid4().hex}", partitions(spark)
    df.write.partitionBy("brief").bucketBy(n, by).option("compression", "zstd").option("path", path).saveAsTable(table_name)
    spark.sql(f"DROP TABLE {table_name}")
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name != "brief")
    spark.sql(f"CREATE TABLE {table_name} ({columns}) USING parquet CLUSTERED BY ({by}) INTO {n} BUCKETS LOCATION '{path}/brief=false'")
    lasting = spark.table(table_name).select("*")
    spark.sql(f"DROP TABLE {table_name}")
    return lasting, spark.read.schema(df.schema).parquet(path).where("brief").drop("brief"), f"{path}/brief=true"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of our own in the shared folder that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Spark removes a finished stage's shuffle files when the driver collects its garbage, which may be hours later; this asks for it after
    stages whose shuffles are large. The first collection clears what holds the plan, the second finds the shuffles unreachable."""
    for pause in (0.4, 0.4):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(pause)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def ascii_lowered(text: Column) -> Column:
    """As ascii_lower; quick for texts of ASCII alone, as F.translate looks each character up."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(ascii_lower(text))


def text_of(docs: DataFrame, column: str = "text") -> Column:
    return F.coalesce(docs[column].cast("string"), F.lit(""))


def byte_texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The column's texts in UTF-8; null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


class WordHashes(dict):
    """Lower-cased word (bytes) to a 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that sums of products spread over all bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k word hashes (k at most 8)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h += words[j : j + n] * _ODD[j]
    return mix64(h)


def shingles(text: bytes, cache: WordHashes, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the k-word runs of a text; of the whole text with fewer words; empty without words."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    return np.unique(window_hashes(h, min(k, len(words))) + np.uint64(len(words) if len(words) < k else 0))


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of (a, b) links as (node, root), root the smallest node; only nodes with a link.

    Rounds of contraction: every node points to that of its neighbours and itself which comes first in the order of a hash, a new one each round, links
    move to the nodes pointed at, loops and repeats go. On random orders the nodes with links left fall by a constant factor a round,
    whatever the shape and the numbering, so the number of rounds grows with the logarithm of the nodes. Nodes and links stay distributed; each round is
    written to the shared folder. At the end the smallest node of each component is its root.
    """
    spark = edges.sparkSession
    links = stored(edges.select("a", "b").where("a <> b").distinct(), name)
    steps: list[DataFrame] = []
    while not links.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(len(steps))).alias("h"), c.alias("node"))  # noqa: E731, B023
        both = links.union(links.select("b", "a")).select(F.col("a").alias("node"), rank(F.col("b")).alias("other"))
        point = both.groupBy("node").agg(F.min("other").alias("other"))
        point = stored(point.select("node", F.least("other", rank(F.col("node")))["node"].alias("to")), name)
        hop = point.select(F.col("node").alias("to"), F.col("to").alias("to2"))
        point = stored(point.join(hop, "to", "left").select("node", F.coalesce("to2", "to").alias("to")), name)
        steps.append(point)
        pa_, pb = point.toDF("a", "ra"), point.toDF("b", "rb")
        links = stored(links.join(pa_, "a").join(pb, "b").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).where("a <> b").distinct(), name)
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    out = steps[-1].toDF("node", "end")
    for point in reversed(steps[:-1]):
        nxt = out.toDF("to", "end")
        out = point.join(nxt, "to", "left").select("node", F.coalesce("end", "to").alias("end"))
    out = stored(out, name)
    return out.join(out.groupBy("end").agg(F.min("node").alias("root")), "end").select("node", "root")
