"""Interval predicates and arithmetic on (start, end) columns, and the bucketed interval join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def inside(start: Column, end: Column, outer_start: Column, outer_end: Column) -> Column:
    """FULL: the interval lies in the outer one; closed."""
    return (start >= outer_start) & (end <= outer_end)


def touches(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """PARTIAL: the intervals share at least a point; closed."""
    return (start <= other_end) & (other_start <= end)


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """STRICT: an end of the first lies strictly inside the second or the other way round, or one contains the other; touching alone isn't enough."""
    within = lambda x, s, e: (s < x) & (x < e)
    return within(s1, s2, e2) | within(e1, s2, e2) | within(s2, s1, e1) | within(e2, s1, e1) | inside(s1, e1, s2, e2) | inside(s2, e2, s1, e1)


PREDICATES = {"full": inside, "partial": touches, "strict": overlaps}


def interval_join(left: DataFrame, right: DataFrame, overlap: str = "full", how: str = "inner", bucket: float | None = None) -> DataFrame:
    """Joins rows of one vid whose (start_time, end_time) meet; right's columns other than vid get the prefix r_.

    Without bucket, an equi-join on vid with the range as residual. With bucket (seconds), vid and time bucket are the key, so a video
    with very many intervals is spread over many keys; a pair that shares several buckets is kept in the first of them only. how: 'inner', 'left' or 'left_semi'.
    Rows that lack their vid or a time meet nothing. Whether a row meets anything depends on its vid and times alone, so the semi and left forms go by those: repeated rows stay, and no row needs a number.
    """
    r = right.select(*[F.col(c).alias("r_vid" if c == "vid" else f"r_{c}") for c in right.columns])
    times = (left["start_time"], left["end_time"], r["r_start_time"], r["r_end_time"])
    cond = (left["vid"] == r["r_vid"]) & PREDICATES[overlap](*times)
    if overlap == "strict":  # whose alternatives could hold without one of the times
        cond = reduce(lambda a, b: a & b.isNotNull(), times, cond)
    if bucket is None:
        out = left.join(r, cond, how)
        return out if how == "left_semi" else out.drop("r_vid")
    cell = lambda c: F.floor(c / bucket)
    spread = lambda df, s, e, name: df.withColumn(name, F.explode(F.sequence(cell(F.col(s)), cell(F.col(e)))))
    key = ["vid", "start_time", "end_time"]
    own = left.select(*key).distinct() if how == "left_semi" else left
    a, b = spread(own, "start_time", "end_time", "_cell"), spread(r, "r_start_time", "r_end_time", "_r_cell")
    first = F.col("_cell") == F.greatest(cell(F.col("start_time")), cell(F.col("r_start_time")))
    on = (F.col("vid") == F.col("r_vid")) & (F.col("_cell") == F.col("_r_cell")) & first & PREDICATES[overlap](F.col("start_time"), F.col("end_time"), F.col("r_start_time"), F.col("r_end_time"))
    if how == "left_semi":
        return left.join(a.join(b, on, "left_semi").select(*key), key, "left_semi").select(*left.columns)
    met = a.join(b, on).drop("_cell", "_r_cell", "r_vid")
    if how == "inner":
        return met
    hit = spread(left.select(*key).distinct(), "start_time", "end_time", "_cell").join(b, on, "left_semi").select(*key)
    return met.unionByName(left.join(hit, key, "left_anti"), allowMissingColumns=True)


def shared(s1: Column, e1: Column, s2: Column, e2: Column) -> tuple[Column, Column]:
    """The intersection of two intervals that touch."""
    return F.greatest(s1, s2), F.least(e1, e2)


def expanded(start: Column, end: Column, t: float) -> tuple[Column, Column]:
    """The interval widened around its centre to length t; never shrunk (FN18)."""
    grow = F.greatest(F.lit(0.0), (F.lit(float(t)) - (end - start)) / 2)
    return start - grow, end + grow


def rounded(x: Column) -> Column:
    """Double to bigint, halves to even (FN01)."""
    return F.rint(x).cast("bigint")


def splits(videos: DataFrame, t: float) -> DataFrame:
    """FN17: clips [i t, i t + t] for i below vduration / t rounded half to even; none for shorter videos."""
    n = rounded(F.col("vduration") / F.lit(float(t)))
    rows = videos.withColumn("_n", n).where("_n > 0")
    rows = rows.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)))
    start = F.col("_i") * F.lit(float(t))
    return rows.withColumn("start_time", start).withColumn("end_time", start + F.lit(float(t))).drop("_n", "_i")


def windows(n_frames: Column, fps: Column, sequence_length: int, stride: int, step: int) -> Column:
    """FN16: array of (start, end) seconds of frame windows, starts every `step` frames, as long as the end lies before the last frame."""
    span = stride * sequence_length
    last = n_frames - span - 1  # the last start whose end is below n_frames
    starts = F.when(last >= 0, F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"), F.lit(step).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    return F.transform(starts, lambda s: F.struct((s / fps).alias("start"), ((s + span) / fps).alias("end")))


def seconds_after(ts: Column, seconds: Column) -> Column:
    """Wall-clock time of a place in a video, to the microsecond, halves to even (FN05)."""
    return F.timestamp_micros(F.unix_micros(ts) + rounded(seconds * F.lit(1e6)))


def aligned(subclips: Column, start: Column, end: Column) -> Column:
    """FN20, strict: the smallest growth of a clip that covers some feature window; (start, end).

    A clip behind the last window starts with it. Else, of the windows that the clip touches, that which adds least time;
    without one, the nearer of the window before (by its start) and the window after (by its end)."""
    last = F.element_at(subclips, -1)
    touched = F.filter(subclips, lambda w: (w["end"] >= start) & (w["start"] <= end))
    before = F.filter(subclips, lambda w: w["end"] < start)
    after = F.filter(subclips, lambda w: w["start"] > end)
    grown = F.transform(touched, lambda w, i: F.struct(((F.greatest(end, w["end"]) - F.least(start, w["start"])) - (end - start)).alias("cost"), i.alias("i"), F.least(start, w["start"]).alias("start"), F.greatest(end, w["end"]).alias("end")))
    best = F.array_min(grown)
    far = F.lit(float("inf"))
    to_prev = F.when(F.size(before) > 0, start - F.try_element_at(before, F.lit(-1))["start"]).otherwise(far)
    to_next = F.when(F.size(after) > 0, F.try_element_at(after, F.lit(1))["end"] - end).otherwise(far)
    gap = F.when(to_prev <= to_next, F.struct(F.try_element_at(before, F.lit(-1))["start"].alias("start"), end.alias("end"))).otherwise(F.struct(start.alias("start"), F.try_element_at(after, F.lit(1))["end"].alias("end")))
    return (
        F.when(F.size(subclips) == 0, F.struct(start.alias("start"), end.alias("end")))
        .when(start > last["end"], F.struct(last["start"].alias("start"), end.alias("end")))
        .when(F.size(touched) > 0, F.struct(best["start"].alias("start"), best["end"].alias("end")))
        .otherwise(gap)
    )


def slack(clip: Column, seconds: float = 0.01) -> Column:
    """The aligned clip pushed out a little, not below 0, so that rounding can't lose a window."""
    return F.struct(F.greatest(F.lit(0.0), clip["start"] - seconds).alias("start"), (clip["end"] + seconds).alias("end"))
