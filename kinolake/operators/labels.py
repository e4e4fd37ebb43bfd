"""Label joins, label statistics, and changes of annotations as new tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.intervals import interval_join, seconds_after, shared

KEY = ["vid", "start_time", "end_time"]


def label_join(clips: DataFrame, videos: DataFrame, annotations: DataFrame, overlap: str = "full", ignore: list[str] | None = None, bucket: float | None = None) -> DataFrame:
    """JN01, JN02: clips of known videos with their composite labels; 'none' where no annotation meets the clip.

    With ignore, those labels are left out and clips without another label go. Only clip keys and labels are grouped; other columns of clips
    come back by the row's key, so vectors aren't shuffled for the aggregation: pass them through `with_columns_of` if needed."""
    known = clips.join(videos.select("vid"), "vid", "left_semi")
    notes = annotations.select("vid", "start_time", "end_time", "label")
    if ignore:
        notes = notes.where(~F.col("label").isin(ignore))
    met = interval_join(known, notes, overlap, "inner" if ignore else "left", bucket)
    return met.groupBy(*clips.columns).agg(L.joined(F.collect_set("r_label")).alias("labels"))


def with_columns_of(labeled: DataFrame, features: DataFrame) -> DataFrame:
    """The label join's rows with their vectors."""
    return labeled.join(features.select("fid", "feature"), "fid")


def on_wall_clock(labeled: DataFrame, videos: DataFrame) -> DataFrame:
    """Clip times as timestamps of the recording; videos without a start vanish."""
    v = videos.where("vstart is not null").select("vid", "vstart")
    return labeled.join(v, "vid").withColumns({"start_time": seconds_after(F.col("vstart"), F.col("start_time")), "end_time": seconds_after(F.col("vstart"), F.col("end_time"))}).drop("vstart")


def labels_within(clips: DataFrame, annotations: DataFrame, bucket: float | None = None) -> DataFrame:
    """JN04: one row for each annotation that touches a clip, cut to it."""
    met = interval_join(clips.select(*KEY), annotations.select(*KEY, "label"), "partial", "inner", bucket)
    start, end = shared(F.col("start_time"), F.col("end_time"), F.col("r_start_time"), F.col("r_end_time"))
    return met.select("vid", start.alias("start_time"), end.alias("end_time"), F.col("r_label").alias("label"))


def label_counts(features: DataFrame, annotations: DataFrame, overlap: str = "full", bucket: float | None = None) -> DataFrame:
    """AG01: distinct feature rows of each label."""
    met = interval_join(features.select("fid", *KEY), annotations.select(*KEY, "label"), overlap, "inner", bucket)
    return met.groupBy(F.col("r_label").alias("label")).agg(F.countDistinct("fid").alias("n"))


def label_counts_two(features: DataFrame, overlay: DataFrame, annotations: DataFrame, bucket: float | None = None) -> DataFrame:
    """AG02: distinct feature rows of each label that hold a row of a second feature (FULL)."""
    held = interval_join(overlay.select(*KEY), features.select("fid", *KEY), "full", "inner", bucket).select(F.col("r_fid").alias("fid"))
    return label_counts(features.join(held, "fid", "left_semi"), annotations, "full", bucket)


def label_seconds(annotations: DataFrame) -> DataFrame:
    """AG03: total seconds of each label, times as decimals."""
    d = lambda c: F.col(c).cast("decimal(18,3)")
    return annotations.groupBy("label").agg(F.sum(d("end_time") - d("start_time")).cast("double").alias("seconds"))


def coalesced(annotations: DataFrame) -> DataFrame:
    """DML05 for a whole table: annotations of one (vid, label) that touch become one; islands of touching intervals."""
    w = Window.partitionBy("vid", "label").orderBy("start_time", "end_time")
    reach = F.max("end_time").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = annotations.withColumn("_new", F.when(reach.isNull() | (F.col("start_time") > reach), 1).otherwise(0))
    island = fresh.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy("vid", "label", "_island").agg(F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time")).drop("_island")


def label_added(annotations: DataFrame, vid: int, start: float, end: float, label: str, now: Column) -> DataFrame:
    """DML05 for one label: it and the same video's equal labels that it touches become one row; an existing row changes nothing."""
    same = (F.col("vid") == vid) & (F.col("label") == label)
    exact = same & (F.col("start_time") == start) & (F.col("end_time") == end)
    near = same & (F.col("start_time") <= end) & (F.lit(start) <= F.col("end_time"))
    state = annotations.agg(F.max(F.when(exact, 1)).alias("exact"), F.min(F.when(near, F.col("start_time"))).alias("s"), F.max(F.when(near, F.col("end_time"))).alias("e"), F.max("aid").alias("top"))
    new = state.where("exact is null").select((F.coalesce("top", F.lit(0)) + 1).alias("aid"), F.lit(vid).cast("bigint").alias("vid"), F.least(F.coalesce("s", F.lit(start)), F.lit(start)).alias("start_time"), F.greatest(F.coalesce("e", F.lit(end)), F.lit(end)).alias("end_time"), F.lit(label).alias("label"), now.alias("label_time"))
    dup = F.broadcast(state.select("exact"))  # one row
    rest = annotations.crossJoin(dup).where(~near | F.col("exact").isNotNull()).drop("exact")
    return rest.unionByName(new.select(*annotations.columns))


def labels_removed(annotations: DataFrame, keys: DataFrame) -> DataFrame:
    """DML06: without the rows of exactly these (vid, start_time, end_time, label)."""
    return annotations.join(keys, [*KEY, "label"], "left_anti")


def relabelled(annotations: DataFrame, changes: DataFrame) -> DataFrame:
    """DML07: (vid, start_time, end_time, label) to new_label; where that row exists already, the old one just goes."""
    both = annotations.join(changes, [*KEY, "label"], "left")
    named = both.withColumn("_old", F.col("new_label").isNull()).withColumn("label", F.coalesce("new_label", "label")).drop("new_label")
    first = F.row_number().over(Window.partitionBy(*KEY, "label").orderBy(F.desc("_old"), "aid"))
    return named.withColumn("_n", first).where("_n = 1").select(*annotations.columns)


def labels_updated(annotations: DataFrame, changes: DataFrame) -> DataFrame:
    """DML08: rows of changes (aid and any new values) replace values by aid; nothing is coalesced."""
    new = changes.select("aid", *[F.col(c).alias(f"_{c}") for c in changes.columns if c != "aid"])
    out = annotations.join(new, "aid", "left")
    return out.select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if f"_{c}" in new.columns else F.col(c) for c in annotations.columns])


def labels_deleted(annotations: DataFrame, aids: DataFrame) -> DataFrame:
    return annotations.join(aids, "aid", "left_anti")


def labels_from_csv(lines: DataFrame, videos: DataFrame, schema: str = "path string, start double, end double, label string") -> DataFrame:
    """SRC04, DML09: bulk labels from CSV lines (column `value`), by path; all or nothing: a line that doesn't parse stops the job."""
    parsed = lines.select(F.from_csv("value", schema, {"mode": "FAILFAST"}).alias("x")).select("x.*")
    return parsed.join(videos.select(F.col("vpath").alias("path"), "vid"), "path").select("vid", F.col("start").alias("start_time"), F.col("end").alias("end_time"), "label")


def classes_kept(labeled: DataFrame, least: int) -> DataFrame:
    """FLT12: composites without the labels that occur in fewer than `least` rows; rows left without a label go."""
    single = labeled.where(F.col("labels") != L.NONE).select("fid", F.explode(L.pieces(F.col("labels"))).alias("label"))
    often = single.groupBy("label").count().where(F.col("count") >= least).select("label")
    return single.join(often, "label", "left_semi").groupBy("fid").agg(L.joined(F.collect_set("label")).alias("labels"))
