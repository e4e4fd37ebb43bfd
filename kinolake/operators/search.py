"""Searches, filters and pages over videos, labels, models and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.intervals import interval_join, rounded, touches


def search_videos(videos: DataFrame, annotations: DataFrame, predictions: DataFrame, date_range: tuple | None = None, labels: list[str] | None = None, predicted: list[str] | None = None, confidence: float = 0.0, mid: int | None = None) -> DataFrame:
    """FLT09: videos that start in the range (closed), have any of the labels and any of the predicted labels above the confidence; whole videos as clips."""
    out = videos
    if date_range:
        out = out.where(F.col("vstart").between(*[F.lit(d).cast("timestamp") for d in date_range]))
    if labels:
        out = out.join(annotations.where(F.col("label").isin(labels)).select("vid"), "vid", "left_semi")
    if predicted:
        hit = predictions.where(F.col("label").isin(predicted) & (F.col("probability") > confidence) & (F.col("mid") == mid))
        out = out.join(hit.select("vid"), "vid", "left_semi")
    return whole_videos(out)


def whole_videos(videos: DataFrame) -> DataFrame:
    """FLT03: each video as the clip from 0 to its duration."""
    return videos.select("vid", "vstart", F.lit(0).alias("clip_start"), F.col("vduration").alias("clip_end"))


def video_paths(videos: DataFrame, vids: list[int] | None = None, thumbnails: bool = False) -> DataFrame:
    """FLT01: paths of the listed videos, of all without a list."""
    out = videos.where(F.col("vid").isin(vids)) if vids else videos
    return out.select("vid", "vpath", *(["thumbpath"] if thumbnails else []))


def labels_of(annotations: DataFrame, vids: list[int] | None = None, before=None, ignore: list[str] | None = None) -> DataFrame:
    """FLT02."""
    out = annotations
    if vids:
        out = out.where(F.col("vid").isin(vids))
    if before is not None:
        out = out.where(F.col("label_time") < F.lit(before).cast("timestamp"))
    if ignore:
        out = out.where(~F.col("label").isin(ignore))
    return out


def latest_model(models: DataFrame, feature_name: str | None = None, ignore: list[str] | None = None, include: list[str] | None = None) -> DataFrame:
    """FLT04, TK01: the newest model of a feature that has none of the ignored and all of the included labels."""
    out = models if feature_name is None else models.where(F.col("feature_name") == feature_name)
    if ignore:
        out = out.where(~F.arrays_overlap("labels", F.array(*map(F.lit, ignore))))
    if include:
        out = out.where(F.size(F.array_except(F.array(*map(F.lit, include)), "labels")) == 0)
    return out.orderBy(F.desc("creation_time"), F.desc("mid")).limit(1)


def in_window(rows: DataFrame, start: float, end: float) -> DataFrame:
    """FLT06: rows that touch the window."""
    return rows.where(touches(F.col("start_time"), F.col("end_time"), F.lit(start), F.lit(end)))


def page(rows: DataFrame, first: int, last: int) -> DataFrame:
    """FLT10: rows first (inclusive) to last (exclusive) in vid order, with the number of all rows."""
    total = F.broadcast(rows.agg(F.count("*").alias("total")))
    taken = rows.orderBy("vid").offset(first).limit(last - first)
    return taken.crossJoin(total)


def adjacent(videos: DataFrame, vids: list[int], at_once: int = 64) -> DataFrame:
    """JN16: videos recorded right before, at and right after the given ones, by start (videos without one last), then vid. One pass of maxima and minima over
    the videos for each `at_once` of the given ones: nothing is sorted or shuffled but a row a task."""
    place = F.struct(F.col("vstart").isNull().alias("none"), F.col("vstart").alias("at"), F.col("vid").alias("vid"))
    given = [r["vid"] for r in videos.where(F.col("vid").isin(vids)).select("vid").distinct().collect()]  # of the list
    found = set(given)
    for i in range(0, len(given), at_once):
        some = given[i : i + at_once]
        own = {r["vid"]: r for r in videos.where(F.col("vid").isin(some)).groupBy("vid").agg(F.min(place).alias("p")).collect()}
        sides = []
        for n, v in enumerate(some):
            p = own[v]["p"]
            here = F.struct(F.lit(p["none"]).alias("none"), F.lit(p["at"]).cast(videos.schema["vstart"].dataType).alias("at"), F.lit(v).cast(videos.schema["vid"].dataType).alias("vid"))
            sides += [F.max(F.when(place < here, place))["vid"].alias(f"b{n}"), F.min(F.when(place > here, place))["vid"].alias(f"a{n}")]
        found |= {v for v in videos.agg(*sides).first() if v is not None}
    return videos.where(F.col("vid").isin(sorted(found))).select("vid").distinct()


def physical_clip(videos: DataFrame, vid: int, start: float, end: float) -> DataFrame:
    """FN19: what a stretch of recording time around a clip shows. Without a start time: the clip, kept inside its video. Else the parts of all videos that
    run (to their duration in whole seconds) during that time, in milliseconds."""
    one = F.broadcast(videos.where(F.col("vid") == vid).select(F.col("vid").alias("o_vid"), F.col("vstart").alias("o_start"), F.col("vduration").alias("o_duration")))
    both = videos.crossJoin(one)  # one row
    alone = both.where("o_start is null and vid = o_vid").select("vid", F.greatest(F.lit(0.0), F.lit(float(start))).alias("start_time"), F.least(F.col("o_duration"), F.lit(float(end))).alias("end_time"))
    micros = lambda c: F.unix_micros(F.col(c))
    lo, hi = micros("o_start") + int(start * 1e6), micros("o_start") + int(end * 1e6)
    stop = micros("vstart") + rounded(F.col("vduration")) * 1_000_000
    ms = lambda c: F.floor(c / 1000) / F.lit(1000.0)
    spanning = both.where(F.col("o_start").isNotNull() & F.col("vstart").isNotNull()).where((micros("vstart") <= hi) & (stop > lo))
    parts = spanning.select("vid", ms(F.greatest(lo - micros("vstart"), F.lit(0))).alias("start_time"), ms(F.least(hi, stop) - micros("vstart")).alias("end_time"))
    return alone.unionByName(parts)


def predictions_pivoted(predictions: DataFrame, mid: int) -> DataFrame:
    """AG06: one row a clip with its predictions as sorted (label, probability) pairs; a repeated label keeps its largest probability."""
    one = predictions.where(F.col("mid") == mid).groupBy("vid", "start_time", "end_time", "label").agg(F.max("probability").alias("probability"))
    return one.groupBy("vid", "start_time", "end_time").agg(F.array_sort(F.collect_list(F.struct("label", "probability"))).alias("predictions"))


def predictions_json(pivoted: DataFrame) -> DataFrame:
    return pivoted.withColumn("predictions", F.to_json(F.map_from_entries("predictions")))


def predictions_for_clips(clips: DataFrame, predictions: DataFrame, bucket: float | None = None) -> DataFrame:
    """JN14: each clip with the predicted windows of its video that overlap it (STRICT), nested in order; clips without any keep an empty list. With
    bucket (seconds), a video's windows are spread over time buckets, met once, without a row for a clip that meets none."""
    key = ["vid", "start_time", "end_time"]
    p = F.struct(F.col("r_start_time").alias("start_time"), F.col("r_end_time").alias("end_time"), F.col("r_label").alias("label"), F.col("r_probability").alias("probability"))
    rows = predictions.select(*key, "label", "probability")
    if bucket is None:
        met = interval_join(clips.select(*key), rows, "strict", "left")
        return met.groupBy(*key).agg(F.array_sort(F.collect_list(F.when(F.col("r_start_time").isNotNull(), p))).alias("predictions"))
    met = interval_join(clips.select(*key), rows, "strict", "inner", bucket)
    none = clips.select(*key, F.lit(None).cast(met.select(p.alias("p")).schema["p"].dataType).alias("p"))
    return met.select(*key, p.alias("p")).unionByName(none).groupBy(*key).agg(F.array_sort(F.collect_list("p")).alias("predictions"))


def context_pruned(explored: DataFrame) -> DataFrame:
    """FLT11: (vid, context: array of clips): only context clips of the explored clip's own video."""
    return explored.withColumn("context", F.filter("context", lambda c: c["vid"] == F.col("vid")))
