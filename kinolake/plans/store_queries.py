"""Queries of stored tables, folders and the store's calls (SRC03, SRC06, DML12, DML15, SNK06, BD08, ML11, EX16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bandit as B
from ..operators import explore as E
from ..operators import models as M
from ..operators import search as SE
from ..operators import store as ST
from ..session import shared_folder
from ..sources import videos as VS
from .registry import query

LOW = ["vid", "start_time", "end_time"]


@query("src03_readable", "feat", "select fid, vid, start_time, end_time from feat")
def _(t):
    path = shared_folder(t.spark, "features")
    t.feat.drop("feature").write.parquet(path)
    t.vm.select("vpath").write.mode("append").text(path)  # files that aren't Parquet
    return VS.readable(t.spark, path, "fid long, vid long, start_time double, end_time double")


def media(t) -> str:
    """A folder with a file for each video, a line for each of its annotations: start and label."""
    path = shared_folder(t.spark, "media")
    lines = t.ann.select("vid", F.concat_ws(" ", F.format_string("%020.6f", "start_time"), "label").alias("line"))
    VS.text_files(lines, path)
    return path


def lines_of(content):
    return F.split(F.rtrim(content.cast("string"), F.lit("\n")), "\n")


def vid_of(path):
    return F.regexp_extract(path, "vid=([0-9]+)", 1).cast("bigint")


@query("src06_folder_videos", "vm ann", "select vid, count(*)::double as vduration from ann group by vid")
def _(t):
    videos = VS.from_folder(t.spark, media(t), "/thumbs", lambda path, content: F.size(lines_of(content)).cast("double"), "*.txt")
    return videos.select(vid_of(F.col("vpath")).alias("vid"), "vduration")


@query("dml15_ingested", "vm ann", """select vid, 0.0::double as start_time, count(*)::double as end_time, min_by(label, (round(start_time, 6), label)) as label
    from ann group by vid having min_by(label, (round(start_time, 6), label)) <> 'view'""")
def _(t):
    first = lambda path, content: F.nullif(F.element_at(F.split(F.element_at(lines_of(content), 1), " "), -1), F.lit("view"))
    _, labels = VS.ingested(t.spark, media(t), "/thumbs", duration=lambda path, content: F.size(lines_of(content)).cast("double"), label=first, pattern="*.txt")
    return labels.select(vid_of(F.col("vpath")).alias("vid"), "start_time", "end_time", "label")


@query("snk06_saved_results", "scores", "select feature_name, t, y from scores union all select feature_name, 0, max(y) from scores group by feature_name")
def _(t):
    path = shared_folder(t.spark, "results")
    M.saved_results(t.scores, path)
    M.saved_results(t.scores.groupBy("feature_name").agg(F.lit(0).cast("bigint").alias("t"), F.max("y").alias("y")), path)
    return t.spark.read.schema(t.scores.schema).parquet(path)


@query("dml12_reset", "vm ann pred models", """select 'video_metadata' as tab, count(*) as n, sum(vid)::bigint as vids from vm union all select tab, 0, null from (values ('annotations'), ('models'), ('predictions')) as x(tab)""")
def _(t):
    rows = {"video_metadata": t.vm, "annotations": t.ann, "models": t.models, "predictions": t.pred}
    out = None
    for name, table in ST.reset(rows).items():
        vids = F.sum("vid") if "vid" in table.columns else F.lit(None).cast("bigint")
        one = table.agg(F.lit(name).alias("tab"), F.count("*").alias("n"), vids.alias("vids"))
        out = one if out is None else out.unionByName(one)
    return out


# a session a video: a round has as many clips as the video has clicks; labelling takes the time since the event before, training three hours for each unit of an error's value
@query("bd08_train_starts", "vm ann", """with b as (select vid, count(*) filter (where label = 'click') as budget from ann group by vid),
    u as (select vid, median(s) as u from (select vid, start_time - lag(start_time) over (partition by vid order by start_time, aid) as s from ann) group by vid),
    m as (select vid, median(30 * (end_time - start_time)) as m from ann where label = 'error' group by vid)
    select b.vid, case when coalesce(u, 0) <= 0 or m is null then 1 when ceil(m / u) < budget then ceil(m / u)::bigint else -1 end as train_start from b left join u using (vid) left join m using (vid)""")
def _(t):
    from pyspark.sql import Window

    budgets = t.ann.groupBy("vid").agg(F.count_if(F.col("label") == "click").alias("budget"))
    gap = F.col("start_time") - F.lag("start_time").over(Window.partitionBy("vid").orderBy("start_time", "aid"))
    model = t.ann.where("label = 'error'").select("vid", (30 * (F.col("end_time") - F.col("start_time"))).alias("seconds"))
    return B.train_starts(budgets, t.ann.select("vid", gap.alias("seconds")), model, ["vid"])


# predictions of the newest model are there for videos with a long error; all other videos get them
@query("ml11_predictions_of_all", "vm ann feat pred models", """with s as (select distinct vid from ann where label = 'error' and end_time - start_time > 72000),
    m as (select mid from models order by creation_time desc limit 1)
    select mid, vid, label, count(*) as n from (select distinct vid, start_time, end_time, label, probability from pred where vid in (select vid from s)) cross join m group by all
    union all select mid, vid, label, count(*) from feat cross join m cross join (values ('a'), ('b')) as x(label) where vid not in (select vid from s) group by all""")
def _(t):
    mid = SE.latest_model(t.models).first()["mid"]
    long = t.ann.where("label = 'error' and end_time - start_time > 72000").select("vid").distinct()
    there = t.pred.join(long, "vid", "left_semi").select(F.lit(mid).alias("mid"), *LOW, "label", "probability").distinct()
    run = lambda rows: M.linear_scores(rows, {"a": [2.0, -1.0], "b": [0.0, 3.0]}, mid).drop("fid")
    return M.predictions_of_all(t.feat, there, mid, run).groupBy("mid", "vid", "label").agg(F.count("*").alias("n"))


# clicks become views, errors of less than an hour go, and a label is added
@query("ex16_store_session", "vm ann", """with r as (select aid, vid, start_time, end_time, case when label = 'click' then 'view' else label end as label, label = 'click' as moved from ann),
    u as (select * from r qualify row_number() over (partition by vid, start_time, end_time, label order by moved, aid) = 1),
    k as (select * from u where not (label = 'error' and end_time - start_time < 3600)),
    near as (select * from k where vid = 3 and label = 'view' and start_time <= 500000 and end_time >= 1000),
    a as (select vid, start_time, end_time, label from k where aid not in (select aid from near)
      union all select 3, least(1000, min(start_time)), greatest(500000, max(end_time)), 'view' from near)
    select vid, label, count(*) as n, round(sum(end_time - start_time), 3) as seconds from a group by vid, label""")
def _(t):
    s = E.Store(t.vm, t.ann, {"r3d": t.feat}, t.models, t.pred)
    key = [*LOW, "label"]
    s.relabel(t.ann.where("label = 'click'").select(*key, F.lit("view").alias("new_label")).distinct())
    s.remove_labels(t.ann.where("label = 'error' and end_time - start_time < 3600").select(*key))
    s.add_label(3, 1000.0, 500000.0, "view", now="2024-02-01")
    return s.labels().groupBy("vid", "label").agg(F.count("*").alias("n"), F.round(F.sum(F.col("end_time") - F.col("start_time")), 3).alias("seconds"))


@query("ex16_added_videos", "vm", "select vid, vpath from (select max(vid) over () + row_number() over (order by concat('/new/', vid, '.mp4')) as vid, concat('/new/', vid, '.mp4') as vpath from vm)")
def _(t):
    s = E.Store(t.vm, t.ann, {"r3d": t.feat}, t.models, t.pred)
    new = t.vm.select(F.format_string("/new/%d.mp4", "vid").alias("vpath"), "vstart", "vduration", "thumbpath")
    return s.add_videos(new.unionByName(t.vm.drop("vid"))).join(s.videos, "vid").select("vid", "vpath")
