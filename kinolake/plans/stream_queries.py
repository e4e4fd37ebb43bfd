"""Queries of Structured Streaming: the given tables arrive in phases, and what is left at the end has SQL over the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.intervals import interval_join
from ..operators import models as M
from ..session import shared_folder, stored
from ..sources.fixtures import Relations
from ..streaming import labels as ST
from .registry import query
from .video_queries import ISLANDS

LOW = ["vid", "start_time", "end_time"]
#: Phases of arrival: windows by their start in ten-day steps, labels by the day of the month.
PHASES = 3
WINDOW_PHASE = "least(floor(start_time / 864000)::int, 2)"
LABEL_PHASE = "least((day(label_time) - 1) // 10, 2)"


def window_phase():
    return F.least(F.floor(F.col("start_time") / 864000), F.lit(2))


def label_phase():
    return F.least(F.floor((F.dayofmonth("label_time") - 1) / 10), F.lit(2))


def folders(t: Relations, *names: str) -> list[str]:
    """Paths of new shared folders."""
    return [shared_folder(t.spark, name) for name in names]


@query("stm06_coalesced_stream", "vm ann", ISLANDS)
def _(t):
    arrivals, out, state = folders(t, "labels", "intervals", "checkpoint")
    ST.arriving(stored(t.ann, "ann"), label_phase(), PHASES, arrivals, lambda stream: ST.appended(ST.coalescing(stream), out, state, mode="update"))
    return ST.current_intervals(t.spark.read.schema(ST.OUT).parquet(out))


@query("stm01_features_appended", "feat", f"select row_number() over (order by {WINDOW_PHASE}, vid, start_time, end_time) as fid, vid, start_time, end_time from feat")
def _(t):
    arrivals, out, state = folders(t, "windows", "features", "checkpoint")
    ST.arriving(stored(t.feat.drop("fid"), "feat"), window_phase(), PHASES, arrivals, lambda stream: ST.features_appended(stream, out, state))
    return t.spark.read.parquet(out).select("fid", *LOW)


# windows of the first phase arrive a second time in the last one
@query("stm02_predictions_appended", "feat", """select vid, start_time, end_time, unnest(['a', 'b']) as label,
    unnest([round(exp(feature[1]::double * 2 - feature[2]::double) / (exp(feature[1]::double * 2 - feature[2]::double) + exp(feature[2]::double * 3)), 6),
      round(exp(feature[2]::double * 3) / (exp(feature[1]::double * 2 - feature[2]::double) + exp(feature[2]::double * 3)), 6)]) as probability from feat""")
def _(t):
    arrivals, out, state = folders(t, "windows", "predictions", "checkpoint")
    once = t.feat.withColumn("phase", window_phase())
    twice = once.unionByName(once.where("phase = 0").withColumn("phase", F.lit(2).cast("bigint")))
    run = lambda rows: M.linear_scores(rows, {"a": [2.0, -1.0], "b": [0.0, 3.0]})
    ST.arriving(stored(twice, "feat"), F.col("phase"), PHASES, arrivals, lambda stream: ST.predictions_appended(stream, run, out, state))
    return t.spark.read.parquet(out).select(*LOW, "label", F.round("probability", 6).alias("probability"))


# an event asks for the feature of its type, for its user's video; those of windows that lie in an annotation of the type are done
DONE = "select distinct f.vid, a.label as feature_name from feat f join ann a on f.vid = a.vid and f.start_time >= a.start_time and f.end_time <= a.end_time"


@query("stm04_requests_in_flight", "vm ann feat", f"select vid, label as feature_name from ann except ({DONE})")
def _(t):
    arrivals, out, state = folders(t, "requests", "extractions", "checkpoint")
    met = interval_join(t.feat.select(*LOW), t.ann.select(*LOW, "label"), "full", "inner", bucket=7200.0)
    done = stored(met.select("vid", F.col("r_label").alias("feature_name")).distinct(), "done")
    asked = stored(t.ann.select("vid", F.col("label").alias("feature_name"), "label_time"), "asked")
    ST.arriving(asked, label_phase(), PHASES, arrivals, lambda stream: ST.appended(ST.requested(stream, done), out, state))
    return t.spark.read.parquet(out).select("vid", "feature_name")


@query("stm05_trained_on_labels", "vm ann feat", f"""with p as (select unnest([0, 1, 2]) as phase), l as (select p.phase, a.* from p join ann a on {LABEL_PHASE} <= p.phase),
    n as (select phase, max(label_time) as newest from l group by phase)
    select (l.phase + 1)::int as mid, 'r3d' as feature_name, epoch_us(max(n.newest)) as creation_us, list_sort(list(distinct l.label)) as labels, count(distinct f.fid) as ntrain
    from l join n on l.phase = n.phase join feat f on f.vid = l.vid and f.start_time >= l.start_time and f.end_time <= l.end_time group by l.phase""")
def _(t):
    arrivals, out, state = folders(t, "labels", "trained", "checkpoint")

    def train(labels):
        rows = stored(M.training_set(t.feat, t.vm, labels), "training")
        model, classes = M.fit_linear(rows, max_iter=5)
        M.save_model(model, classes, shared_folder(t.spark, "model"))
        return rows.agg(F.array(*map(F.lit, classes)).alias("labels"), F.count("*").alias("ntrain"))

    ST.arriving(stored(t.ann, "ann"), label_phase(), PHASES, arrivals, lambda stream: ST.trained_on_labels(stream, out, state, "r3d", train))
    return t.spark.read.parquet(f"{out}/models").select("mid", "feature_name", F.unix_micros("creation_time").alias("creation_us"), "labels", "ntrain")
