"""Feature tables: scans, clip joins, concatenation of features, pooling and materialisation."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.intervals import interval_join


def scan(features: DataFrame, vids: list[int] | DataFrame | None = None) -> DataFrame:
    """SRC01: all rows, or those of a list (pushed to the scan) or a table of vids."""
    if vids is None:
        return features
    if isinstance(vids, DataFrame):
        return features.join(vids.select("vid").distinct(), "vid", "left_semi")
    return features.where(F.col("vid").isin(vids))


def for_clips(features: DataFrame, clips: DataFrame, overlap: str = "full", bucket: float | None = None) -> DataFrame:
    """JN05: feature rows inside (FULL) or touching (PARTIAL) some clip, each once."""
    return interval_join(features, clips.select("vid", "start_time", "end_time"), overlap, "left_semi", bucket)


def nearest(base: DataFrame, overlay: DataFrame, bucket: float | None = None) -> DataFrame:
    """JN06, one step: for each base row the overlay row inside it whose start lies nearest to the middle (as a part of the base's length), vectors
    concatenated; base rows without one go. Ties: earlier start, then smaller id. A base row of no length keeps its first overlay row.

    Ranking moves ids only; the winners' vectors are joined at the end. With bucket (seconds), a video's windows are spread over time buckets."""
    narrow = lambda df: df.select("fid", "vid", "start_time", "end_time")
    inner = interval_join(narrow(overlay), narrow(base), "full", "inner", bucket)
    met = inner.select(F.col("r_fid").alias("fid"), F.col("r_start_time").alias("start_time"), F.col("r_end_time").alias("end_time"), F.col("fid").alias("o_fid"), F.col("start_time").alias("o_start"))
    off = F.abs(0.5 - F.try_divide(F.col("o_start") - F.col("start_time"), F.col("end_time") - F.col("start_time")))
    best = met.withColumn("_off", off).withColumn("_n", F.row_number().over(Window.partitionBy("fid").orderBy(F.col("_off").asc_nulls_last(), "o_start", "o_fid"))).where("_n = 1")
    left = base.join(best.select("fid", "o_fid"), "fid")
    right = overlay.select(F.col("fid").alias("o_fid"), F.col("feature").alias("_other"))
    return left.join(right, "o_fid").withColumn("feature", V.concat(F.col("feature"), F.col("_other"))).drop("_other")


def concatenated(features: list[DataFrame], bucket: float | None = None) -> DataFrame:
    """JN06: features of several extractors, the first giving rows and windows."""
    return reduce(lambda a, b: nearest(a, b, bucket).drop("o_fid"), features)


def strided(features: DataFrame, odd: bool = True) -> DataFrame:
    """WN03: every second row of a video by start, from the first (odd) or second."""
    n = F.row_number().over(Window.partitionBy("vid").orderBy("start_time", "fid"))
    return features.withColumn("_n", n).where(F.col("_n") % 2 == (1 if odd else 0)).drop("_n")


def pooled(features: DataFrame, length: int, how: str = "max") -> DataFrame:
    """AG15, AG18: rows of a video in order of start, each `length` of them pooled place by place (max or mean). Whole vectors are aggregated: a task sends one
    for each group. Rows without a vector count as places in the order, but aren't pooled; vectors of a group have one length."""
    n = F.row_number().over(Window.partitionBy("vid").orderBy("start_time", "fid")) - 1
    rows = features.select("vid", F.floor(n / length).alias("part"), "start_time", "end_time", _vector(F.col("feature")).alias("_x")).where("_x is not null")
    f = Summarizer.max if how == "max" else Summarizer.mean
    out = rows.groupBy("vid", "part").agg(F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), f(F.col("_x")).alias("_x"))
    return out.withColumn("feature", vector_to_array("_x")).drop("_x")


def _vector(x: Column) -> Column:
    return F.when(x.isNotNull(), array_to_vector(V.doubles(F.coalesce(x, F.array().cast("array<float>")))))


def pyramid_pooled(features: DataFrame, levels: int = 4) -> DataFrame:
    """AG16: for each of the 2 ** l windows of every level of a video's series: sum, counts of rises and falls over two steps by more than .01, and
    maximum, for each place of the vector."""
    w = Window.partitionBy("vid").orderBy("start_time", "fid")
    rows = features.select("vid", (F.row_number().over(w) - 1).alias("t"), F.count("*").over(Window.partitionBy("vid")).alias("n"), V.doubles(F.col("feature")).alias("x"), V.doubles(F.lag("feature", 2).over(w)).alias("before"))
    spans = [(level, k) for level in range(levels) for k in range(2**level)]
    at = lambda frac: F.floor((F.col("n") - 1) * F.lit(frac + 0.000001) + 0.5)
    bounds = F.array(*[F.struct(F.lit(lv).alias("level"), F.lit(k).alias("k"), at(k / 2**lv).alias("lo"), at((k + 1) / 2**lv).alias("hi")) for lv, k in spans])
    mine = F.filter(bounds, lambda b: (F.col("t") >= b["lo"]) & (F.col("t") <= b["hi"]))
    part = rows.select("vid", "t", "x", "before", F.explode(mine).alias("b")).select("vid", "b.level", "b.k", F.posexplode(F.arrays_zip("x", F.coalesce("before", F.array().cast("array<double>")).alias("before"))).alias("i", "v"))
    rise = F.col("v.x") - F.col("v.before")
    return part.groupBy("vid", "level", "k", "i").agg(F.sum("v.x").alias("sum"), F.sum(F.when(rise > 0.01, 1).otherwise(0)).alias("rises"), F.sum(F.when(rise < -0.01, 1).otherwise(0)).alias("falls"), F.max("v.x").alias("max"))


def vids_with_all(tables: dict[str, DataFrame]) -> DataFrame:
    """ST01: videos that have rows of every feature."""
    return reduce(lambda a, b: a.intersect(b), [t.select("vid").distinct() for t in tables.values()])


def missing(requested: DataFrame, stored: DataFrame, in_progress: DataFrame | None = None) -> DataFrame:
    """VX08, ST02, ST05: requested vids that are neither stored nor on the way."""
    out = requested.select("vid").distinct().join(stored.select("vid"), "vid", "left_anti")
    return out if in_progress is None else out.join(in_progress.select("vid"), "vid", "left_anti")


def materialised(requested: DataFrame, stored: DataFrame, extract, only_stored: bool = False) -> DataFrame:
    """VX08: stored rows of the requested videos, and those that `extract` makes (a function from a table of vids to feature rows) for the missing ones."""
    have = scan(stored, requested)
    return have if only_stored else have.unionByName(extract(missing(requested, stored)))


def eager_sample(requested: DataFrame, stored: DataFrame, n: int = 10, seed: int = 0, in_progress: DataFrame | None = None) -> DataFrame:
    """STM03: the videos that idle time goes to next: n of those without features, by a seeded hash of vid; whoever calls it when nothing waits
    extracts them with `materialised`."""
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("vid").cast("string")))
    return missing(requested, stored, in_progress).orderBy(place, "vid").limit(n)
