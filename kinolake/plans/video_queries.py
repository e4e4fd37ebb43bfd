"""Queries over videos, labels, features and predictions, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import intervals as I
from ..functions import labels as L
from ..functions import vectors as V
from ..operators import features as FE
from ..operators import labels as LB
from ..operators import search as SE
from ..operators import store as ST
from ..sources import videos as VS
from ..sources.fixtures import LABELS
from .registry import query

FULL = "f.start_time >= a.start_time and f.end_time <= a.end_time"
PART = "f.start_time <= a.end_time and a.start_time <= f.end_time"
LOW = ["vid", "start_time", "end_time"]


def slim(t):
    return t.feat.drop("feature")


# --- scans, sources, sinks ---


@query("src01_scan_vids", "feat", "select fid, vid, start_time, end_time, feature[1]::double as x from feat where vid in (1, 3, 5, 8)")
def _(t):
    return FE.scan(t.feat, [1, 3, 5, 8]).select("fid", *LOW, F.element_at("feature", 1).cast("double").alias("x"))


@query("src02_feature_names", "feat", "select 'r3d' as feature_name union select 'clip'")
def _(t):
    both = t.feat.select(F.lit("r3d").alias("feature_name")).union(t.feat2.select(F.lit("clip"))).union(t.feat.select(F.lit("tmp")))
    return both.where("feature_name <> 'tmp'").distinct()


@query("src04_labels_csv", "vm ann", "select v.vid, round(a.start_time, 3) as start_time, round(a.end_time, 3) as end_time, a.label from ann a join vm v on a.vid = v.vid where a.label <> 'view'")
def _(t):
    text = lambda c: F.round(c, 3).cast("string")
    lines = t.ann.where("label <> 'view'").join(t.vm.select("vid", "vpath"), "vid").select(F.concat_ws(",", "vpath", text("start_time"), text("end_time"), "label").alias("value"))
    return LB.labels_from_csv(lines, t.vm)


@query("src05_videos_csv", "vm", "select vpath, epoch_us(vstart) as vstart, vduration, concat('/t/', vid, '.jpg') as thumbpath from vm")
def _(t):
    lines = t.vm.select(F.concat_ws(",", "vpath", F.date_format("vstart", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.col("vduration").cast("string")).alias("value"))
    return VS.from_csv_lines(lines, "/t").withColumn("vstart", F.unix_micros("vstart"))


@query("src07_vids_of_paths", "vm", "select vid from vm where vpath in ('/videos/1.mp4', '/videos/4.mp4', '/videos/x.mp4')")
def _(t):
    return VS.vids_of_paths(t.vm, t.spark.createDataFrame([("/videos/1.mp4",), ("/videos/4.mp4",), ("/videos/x.mp4",)], "vpath string"))


@query("src13_pruned_store", "vm ann", "select 'video_metadata' as tab, count(*) as n from vm where vid % 3 = 0 union all select 'annotations', count(*) from ann where vid % 3 = 0")
def _(t):
    kept = ST.pruned({"video_metadata": t.vm, "annotations": t.ann}, t.vm.where("vid % 3 = 0").select("vpath"))
    one = lambda name: kept[name].agg(F.lit(name).alias("tab"), F.count("*").alias("n"))
    return one("video_metadata").union(one("annotations"))


@query("src14_split_vids", "vm", "select vid from vm where vid % 5 in (1, 2)")
def _(t):
    split = t.vm.groupBy((F.col("vid") % 5).alias("m")).agg(F.collect_list("vid").alias("vids"))
    table = split.select(F.lit("d").alias("name"), F.lit("random").alias("split_type"), F.lit(0).alias("split_idx"), F.when(F.col("m").isin(1, 2), "train").otherwise("test").alias("split"), "vids")
    return VS.split_vids(table, "d", "random", 0, "train")


@query("src15_clip_paths", "vm ann", "select aid, concat('/data/', vid, '_', lpad(trunc(start_time)::bigint::varchar, 6, '0'), '_', lpad(trunc(end_time)::bigint::varchar, 6, '0'), '.mp4') as path from ann where end_time < 999999")
def _(t):
    return t.ann.where("end_time < 999999").select("aid", VS.clip_path("/data", F.col("vid"), F.col("start_time"), F.col("end_time")).alias("path"))


@query("snk01_features_appended", "feat", "select fid, vid, start_time from feat union all select (select max(fid) from feat) + row_number() over (order by vid, start_time), vid, start_time + 86400000 from (select distinct vid, start_time from feat where vid % 7 = 0 and fid % 2 = 0)")
def _(t):
    from pyspark.sql import Window

    first = F.row_number().over(Window.partitionBy("vid", "start_time").orderBy("fid"))
    new = t.feat.where("vid % 7 = 0 and fid % 2 = 0").withColumn("_n", first).where("_n = 1").drop("_n", "fid")
    new = new.withColumns({"start_time": F.col("start_time") + 86400000, "end_time": F.col("end_time") + 86400000})
    return ST.features_added(t.feat, new).select("fid", "vid", "start_time")


@query("snk02_dense_ids", "vm", "select vpath, 100 + row_number() over (order by vpath) as id from vm")
def _(t):
    return ST.numbered(t.vm.select("vpath"), "id", 100, ["vpath"])


@query("snk03_features_of_labels", "vm ann feat", "select fid from feat where vid in (select vid from ann where label = 'signup')")
def _(t):
    return FE.scan(t.feat, t.ann.where("label = 'signup'")).select("fid")


@query("snk04_distinct_rows", "vm ann", "select distinct vid, label from ann")
def _(t):
    return t.ann.select("vid", "label").dropDuplicates()


@query("snk05_coalesced_shards", "feat", "select count(*) as n, max(fid) + 1 as next_fid from feat")
def _(t):
    whole, nxt = ST.coalesced_features([slim(t).where("fid % 3 = 0"), slim(t).where("fid % 3 <> 0")])
    return whole.agg(F.count("*").alias("n"), F.lit(nxt).cast("bigint").alias("next_fid"))


@query("snk07_json_rows", "vm", "select concat('{\"vid\":', vid, ',\"thumbpath\":\"', thumbpath, '\"}') as json from vm")
def _(t):
    return VS.as_json(t.vm.select("vid", "thumbpath"))


# --- changes ---


@query("dml02_videos_added", "vm", "select vid, vpath from vm union all select (select max(vid) from vm) + row_number() over (order by p), p from (select distinct concat('/new/', vid % 4, '.mp4') as p from vm)")
def _(t):
    new = t.vm.select(F.format_string("/new/%d.mp4", F.col("vid") % 4).alias("vpath")).union(t.vm.select("vpath"))
    return ST.videos_added(t.vm, new).select("vid", "vpath")


@query("dml03_video_added", "vm", "select vid, vpath from vm union all select max(vid) + 1, '/one.mp4' from vm")
def _(t):
    return ST.videos_added(t.vm, t.spark.createDataFrame([("/one.mp4",)], "vpath string")).select("vid", "vpath")


@query("dml04_thumbnail_updated", "vm", "select vid, case when vid = 2 then '/n.jpg' else thumbpath end as thumbpath from vm")
def _(t):
    return ST.thumbnail_updated(t.vm, 2, "/n.jpg").select("vid", "thumbpath")


ISLANDS = """select vid, label, min(start_time) as start_time, max(end_time) as end_time from (
  select *, sum(fresh) over (partition by vid, label order by start_time, end_time rows unbounded preceding) as island from (
    select *, case when start_time <= max(end_time) over (partition by vid, label order by start_time, end_time rows between unbounded preceding and 1 preceding) then 0 else 1 end as fresh from ann))
  group by vid, label, island"""


@query("dml05_labels_coalesced", "vm ann", ISLANDS)
def _(t):
    return LB.coalesced(t.ann)


@query("dml05_label_added", "vm ann", """with near as (select * from ann where vid = 3 and label = 'view' and start_time <= 500000 and end_time >= 1000)
    select vid, start_time, end_time, label from ann where aid not in (select aid from near)
    union all select 3, least(1000, min(start_time)), greatest(500000, max(end_time)), 'view' from near""")
def _(t):
    return LB.label_added(t.ann, 3, 1000.0, 500000.0, "view", F.lit("2024-02-01").cast("timestamp")).select(*LOW, "label")


@query("dml06_labels_removed", "vm ann", "select aid from ann where not (vid % 2 = 0 and label = 'click')")
def _(t):
    return LB.labels_removed(t.ann, t.ann.where("vid % 2 = 0 and label = 'click'").select(*LOW, "label")).select("aid")


@query("dml07_relabelled", "vm ann", "select aid, case when label = 'error' then 'view' else label end as label from ann")
def _(t):
    changes = t.ann.where("label = 'error'").select(*LOW, "label", F.lit("view").alias("new_label"))
    return LB.relabelled(t.ann, changes).select("aid", "label")


@query("dml08_labels_updated", "vm ann", "select aid, case when aid % 10 = 0 then 'purchase' else label end as label, start_time, case when aid % 10 = 0 then end_time + 5 else end_time end as end_time from ann where aid % 10 <> 3")
def _(t):
    changes = t.ann.where("aid % 10 = 0").select("aid", F.lit("purchase").alias("label"), (F.col("end_time") + 5).alias("end_time"))
    gone = t.ann.where("aid % 10 = 3").select("aid")
    return LB.labels_deleted(LB.labels_updated(t.ann, changes), gone).select("aid", "label", "start_time", "end_time")


@query("dml10_model_added", "models", "select mid, feature_name from models union all select max(mid) + 1, 'new' from models")
def _(t):
    return ST.model_added(t.models, t.spark.createDataFrame([("new",)], "feature_name string")).select("mid", "feature_name")


@query("dml11_predictions_added", "pred", "select distinct mid, vid, start_time, end_time, label, probability from pred union select distinct 2, vid, start_time, end_time, 'x', 0.5::double from pred where vid % 2 = 0")
def _(t):
    sets = t.pred.where("vid % 2 = 0").select(*LOW).distinct().withColumn("predictions", F.create_map(F.lit("x"), F.lit(0.5)))
    return ST.predictions_added(t.pred, sets, 2)


@query("dml13_subset_by_labels", "vm ann", "select v.vid, (select count(*) from ann a where a.vid = v.vid) as n from vm v where vid in (select vid from ann where label = 'purchase' and aid % 50 = 0)")
def _(t):
    videos, notes = ST.subset_by_labels(t.vm, t.ann.withColumn("label", F.when(F.col("aid") % 50 == 0, F.col("label")).otherwise("other")), ["purchase"])
    return videos.join(notes.groupBy("vid").agg(F.count("*").alias("n")), "vid").select("vid", "n")


@query("dml14_upserted", "vm", "select vid, case when vid % 2 = 0 then 'new' else thumbpath end as thumbpath from vm union all select -1, 'new'")
def _(t):
    rows = t.vm.where("vid % 2 = 0").select("vid").union(t.spark.createDataFrame([(-1,)], "vid bigint")).withColumn("thumbpath", F.lit("new"))
    return ST.upserted(t.vm.select("vid", "thumbpath"), rows, ["vid"])


@query("dml14_insert_if_absent", "vm", "select vid, thumbpath from vm union all select -1, 'new'")
def _(t):
    rows = t.vm.where("vid % 2 = 0").select("vid").union(t.spark.createDataFrame([(-1,)], "vid bigint")).withColumn("thumbpath", F.lit("new"))
    return ST.upserted(t.vm.select("vid", "thumbpath"), rows, ["vid"], update=False)


# --- filters ---


@query("flt01_video_paths", "vm", "select vid, vpath, thumbpath from vm where vid in (0, 2, 9)")
def _(t):
    return SE.video_paths(t.vm, [0, 2, 9], thumbnails=True)


@query("flt02_labels_filtered", "vm ann", "select aid from ann where vid in (1, 2, 3, 4) and label_time < timestamp '2024-01-20 00:00:00' and label not in ('view')")
def _(t):
    return SE.labels_of(t.ann, [1, 2, 3, 4], "2024-01-20 00:00:00", ["view"]).select("aid")


@query("flt03_whole_videos", "vm", "select vid, 0 as clip_start, vduration as clip_end from vm")
def _(t):
    return SE.whole_videos(t.vm).select("vid", "clip_start", "clip_end")


@query("flt04_latest_model", "models", "select mid from models where feature_name = 'r3d' and not list_has_any(labels, ['view']) and list_has_all(labels, ['purchase']) order by creation_time desc limit 1")
def _(t):
    return SE.latest_model(t.models, "r3d", ["view"], ["purchase"]).select("mid")


@query("flt05_model_by_id", "models", "select mid, feature_name, f1_threshold, ntrain::bigint as ntrain from models where mid = 4")
def _(t):
    return t.models.where("mid = 4").select("mid", "feature_name", "f1_threshold", F.col("ntrain").cast("bigint").alias("ntrain"))


@query("flt06_feature_window", "feat", "select fid from feat where start_time <= 400000 and end_time >= 360000")
def _(t):
    return SE.in_window(slim(t), 360000.0, 400000.0).select("fid")


@query("flt07_unlabeled_features", "labeled", "select fid from labeled where labels = 'none'")
def _(t):
    return LB.label_join(slim(t), t.vm, t.ann).where("labels = 'none'").select("fid")


@query("flt08_composite_ignored", "labeled", "select fid, labels from labeled where labels not in ('click', 'view')")
def _(t):
    return LB.label_join(slim(t), t.vm, t.ann).where(~F.col("labels").isin("click", "view")).select("fid", "labels")


SEARCH = """select v.vid, epoch_us(v.vstart) as vstart, 0 as clip_start, v.vduration as clip_end from vm v
where v.vstart >= timestamp '2024-01-01 00:00:00' and v.vstart <= timestamp '2024-01-05 00:00:00'
  and v.vid in (select vid from ann where label in ('click', 'view'))
  and v.vid in (select vid from pred where label in ('error') and probability > 0.4 and mid = 1)"""


@query("flt09_search_videos", "vm ann pred", SEARCH)
def search(t):
    out = SE.search_videos(t.vm, t.ann, t.pred, ("2024-01-01 00:00:00", "2024-01-05 00:00:00"), ["click", "view"], ["error"], 0.4, 1)
    return out.withColumn("vstart", F.unix_micros("vstart"))


@query("flt10_page", "vm", "select vid, (select count(*) from vm) as total from vm order by vid limit 7 offset 3")
def _(t):
    return SE.page(t.vm.select("vid"), 3, 10)


@query("flt11_context_pruned", "feat", "select fid, len(list_filter([vid, vid + 1, vid], lambda x: x = vid))::int as n from feat")
def _(t):
    ctx = slim(t).withColumn("context", F.array(*[F.struct((F.col("vid") + d).alias("vid")) for d in (0, 1, 0)]))
    return SE.context_pruned(ctx).select("fid", F.size("context").alias("n"))


@query("flt12_rare_classes_dropped", "labeled", """with s as (select fid, unnest(string_split(labels, '_')) as label from labeled where labels <> 'none'),
    often as (select label from s group by label having count(*) >= 60) select fid, string_agg(distinct label, '_' order by label) as labels from s where label in (select label from often) group by fid""")
def _(t):
    return LB.classes_kept(LB.label_join(slim(t), t.vm, t.ann), 60)


@query("flt13_flattened", "feat", "select fid, list_concat(feature, feature)[65]::double as x, len(list_concat(feature, feature))::int as n from feat")
def _(t):
    both = F.flatten(F.array("feature", "feature"))
    return t.feat.select("fid", F.element_at(both, 65).cast("double").alias("x"), F.size(both).alias("n"))


# --- joins ---


@query("jn01_label_join_full", "labeled", "select fid, vid, start_time, end_time, labels from labeled")
def _(t):
    return LB.label_join(slim(t), t.vm, t.ann, "full")


@query("jn01_label_join_partial", "vm ann feat", f"select f.fid, coalesce(string_agg(distinct a.label, '_' order by a.label), 'none') as labels from feat f join vm v on f.vid = v.vid left join ann a on f.vid = a.vid and {PART} group by f.fid")
def _(t):
    return LB.label_join(slim(t), t.vm, t.ann, "partial").select("fid", "labels")


@query("jn01_label_join_bucketed", "vm ann feat", f"select f.fid, coalesce(string_agg(distinct a.label, '_' order by a.label), 'none') as labels from feat f join vm v on f.vid = v.vid left join ann a on f.vid = a.vid and {PART} group by f.fid")
def _(t):
    return LB.label_join(slim(t), t.vm, t.ann, "partial", bucket=7200.0).select("fid", "labels")


@query("jn01_wall_clock", "vm labeled", "select l.fid, epoch_us(v.vstart) + (l.start_time * 1000000)::bigint as start_us, labels from labeled l join vm v on l.vid = v.vid")
def _(t):
    return LB.on_wall_clock(LB.label_join(slim(t), t.vm, t.ann), t.vm).select("fid", F.unix_micros("start_time").alias("start_us"), "labels")


@query("jn02_label_join_ignore", "vm ann feat", f"select f.fid, string_agg(distinct a.label, '_' order by a.label) as labels from feat f join vm v on f.vid = v.vid join ann a on f.vid = a.vid and {FULL} where a.label not in ('view', 'click') group by f.fid")
def _(t):
    return LB.label_join(slim(t), t.vm, t.ann, "full", ["view", "click"]).select("fid", "labels")


@query("jn03_clip_labels", "vm ann", """with c as (select vid, i * 3600::double as start_time, i * 3600::double + 3600 as end_time from vm, (select unnest(range(20)) as i))
    select f.vid, f.start_time, coalesce(string_agg(distinct a.label, '_' order by a.label), 'none') as labels from c f left join ann a on f.vid = a.vid and """ + PART + " group by f.vid, f.start_time, f.end_time")
def _(t):
    clips = t.vm.select("vid", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("i")).select("vid", (F.col("i") * 3600.0).alias("start_time"), (F.col("i") * 3600.0 + 3600).alias("end_time"))
    return LB.label_join(clips, t.vm, t.ann, "partial").select("vid", "start_time", "labels")


@query("jn04_labels_within_clips", "vm ann feat", f"select f.vid, greatest(f.start_time, a.start_time) as start_time, least(f.end_time, a.end_time) as end_time, a.label from feat f join ann a on f.vid = a.vid and {PART}")
def _(t):
    return LB.labels_within(slim(t), t.ann)


@query("jn05_features_in_clips_full", "vm ann feat", f"select fid from feat f where exists (select 1 from ann a where f.vid = a.vid and a.label = 'purchase' and {FULL})")
def _(t):
    return FE.for_clips(slim(t), t.ann.where("label = 'purchase'"), "full").select("fid")


@query("jn05_features_in_clips_partial", "vm ann feat", f"select fid from feat f where exists (select 1 from ann a where f.vid = a.vid and a.label = 'purchase' and {PART})")
def _(t):
    return FE.for_clips(slim(t), t.ann.where("label = 'purchase'"), "partial", bucket=7200.0).select("fid")


NEAREST = """select b.fid, o.fid as o_fid, b.feature as f1, o.feature as f2 from feat b join feat2 o on b.vid = o.vid and o.start_time >= b.start_time and o.end_time <= b.end_time
    qualify row_number() over (partition by b.fid order by abs(0.5 - (o.start_time - b.start_time) / (b.end_time - b.start_time)), o.start_time, o.fid) = 1"""


@query("jn06_nearest_features", "feat feat2", f"select fid, o_fid, f1[1]::double as first, f2[64]::double as last, (len(f1) + len(f2))::int as n from ({NEAREST})")
def _(t):
    return FE.nearest(t.feat, t.feat2).select("fid", "o_fid", F.element_at("feature", 1).alias("first"), F.element_at("feature", -1).alias("last"), F.size("feature").alias("n"))


@query("jn06_nearest_bucketed", "feat feat2", f"select fid, o_fid, (len(f1) + len(f2))::int as n from ({NEAREST})")
def _(t):
    return FE.nearest(t.feat, t.feat2, 3600.0).select("fid", "o_fid", F.size("feature").alias("n"))


@query("jn06_three_features", "feat feat2", f"select fid, (3 * 64)::int as n from ({NEAREST})")
def _(t):
    return FE.concatenated([t.feat, t.feat2, t.feat2]).select("fid", F.size("feature").alias("n"))


@query("jn07_labeled_features", "labeled", "select fid, labels from labeled where labels <> 'none'")
def _(t):
    return LB.label_join(slim(t), t.vm, t.ann).where("labels <> 'none'").select("fid", "labels")


@query("jn08_clips_labels_features", "labeled feat", "select f.fid, l.labels, f.feature[2]::double as x from labeled l join feat f on f.vid = l.vid and f.start_time = l.start_time and f.end_time = l.end_time where l.fid = f.fid")
def _(t):
    return LB.with_columns_of(LB.label_join(slim(t), t.vm, t.ann), t.feat).select("fid", "labels", F.element_at("feature", 2).cast("double").alias("x"))


@query("jn10_predictions_features", "pred feat", "select f.fid, p.label, p.probability from pred p join feat f on f.vid = p.vid and f.start_time = p.start_time and f.end_time = p.end_time where p.label in ('click', 'view')")
def _(t):
    return t.pred.where("label in ('click', 'view')").join(slim(t), LOW).select("fid", "label", "probability")


@query("jn11_vids_with_label", "vm ann", "select vid from vm where vid in (select vid from ann where label in ('signup', 'error'))")
def _(t):
    return t.vm.join(t.ann.where(F.col("label").isin("signup", "error")).select("vid"), "vid", "left_semi").select("vid")


@query("jn12_vids_without_label", "vm ann", "select vid from vm where vid not in (select vid from ann where label = 'error' and end_time - start_time > 72000)")
def _(t):
    return t.vm.join(t.ann.where("label = 'error' and end_time - start_time > 72000").select("vid"), "vid", "left_anti").select("vid")


@query("jn13_time_span", "vm", "select vid, (epoch_us(v.vstart) - epoch_us(p.t0)) // 1000 / 1000.0::double as since from vm v cross join (select min(vstart) as t0 from vm) p")
def _(t):
    p = F.broadcast(t.vm.agg(F.min("vstart").alias("t0")))
    return t.vm.crossJoin(p).select("vid", (F.timestamp_diff("MILLISECOND", "t0", "vstart") / F.lit(1000.0)).alias("since"))


STRICT = "(a.start_time < f.start_time and f.start_time < a.end_time) or (a.start_time < f.end_time and f.end_time < a.end_time) or (f.start_time < a.start_time and a.start_time < f.end_time) or (f.start_time < a.end_time and a.end_time < f.end_time) or (f.start_time >= a.start_time and f.end_time <= a.end_time) or (a.start_time >= f.start_time and a.end_time <= f.end_time)"


@query("jn14_predictions_for_clips", "vm ann pred", f"select f.aid, count(a.vid) as n, coalesce(sum(a.probability), 0) as p from ann f left join pred a on f.vid = a.vid and ({STRICT}) group by f.aid")
def _(t):
    own = SE.predictions_for_clips(t.ann.select(*LOW).distinct(), t.pred)
    return t.ann.join(own, LOW).select("aid", F.size("predictions").cast("bigint").alias("n"), F.aggregate("predictions", F.lit(0.0), lambda a, p: a + p["probability"]).alias("p"))


@query("jn14_predictions_bucketed", "vm ann pred", f"select f.aid, count(a.vid) as n from ann f left join pred a on f.vid = a.vid and ({STRICT}) group by f.aid")
def _(t):
    own = SE.predictions_for_clips(t.ann.select(*LOW).distinct(), t.pred, 3600.0)
    return t.ann.select("aid", *LOW).join(own, LOW).select("aid", F.size("predictions").cast("bigint").alias("n"))


@query("jn15_paths_of_label", "vm ann", "select distinct a.label, v.vpath from vm v join ann a on v.vid = a.vid where a.label in ('signup', 'purchase')")
def _(t):
    return t.vm.join(t.ann.where(F.col("label").isin("signup", "purchase")), "vid").select("label", "vpath").distinct()


@query("jn16_adjacent_videos", "vm", "with r as (select vid, row_number() over (order by vstart nulls last, vid) as n from vm) select vid from r where n in (select n + d from r, (values (-1), (0), (1)) as x(d) where vid in (3, 7))")
def _(t):
    return SE.adjacent(t.vm, [3, 7])


# --- aggregates ---


@query("ag01_label_counts_full", "vm ann feat", f"select a.label, count(distinct f.fid) as n from feat f join ann a on f.vid = a.vid and {FULL} group by a.label")
def _(t):
    return LB.label_counts(t.feat, t.ann)


@query("ag01_label_counts_partial", "vm ann feat", f"select a.label, count(distinct f.fid) as n from feat f join ann a on f.vid = a.vid and {PART} group by a.label")
def _(t):
    return LB.label_counts(t.feat, t.ann, "partial")


@query("ag02_label_counts_two", "vm ann feat feat2", f"select a.label, count(distinct f.fid) as n from feat f join ann a on f.vid = a.vid and {FULL} where exists (select 1 from feat2 o where o.vid = f.vid and o.start_time >= f.start_time and o.end_time <= f.end_time) group by a.label")
def _(t):
    return LB.label_counts_two(slim(t), t.feat2, t.ann)


@query("ag02_label_counts_two_bucketed", "vm ann feat feat2", f"select a.label, count(distinct f.fid) as n from feat f join ann a on f.vid = a.vid and {FULL} where exists (select 1 from feat2 o where o.vid = f.vid and o.start_time >= f.start_time and o.end_time <= f.end_time) group by a.label")
def _(t):
    return LB.label_counts_two(slim(t), t.feat2, t.ann, 3600.0)


@query("ag03_label_seconds", "vm ann", "select label, sum(end_time::decimal(18,3) - start_time::decimal(18,3))::double as seconds from ann group by label")
def _(t):
    return LB.label_seconds(t.ann)


@query("ag04_distinct_labels", "vm ann", "select distinct label from ann")
def _(t):
    return t.ann.select("label").distinct()


@query("ag05_labels_of_videos", "vm ann", "select vid, string_agg(distinct label, '_' order by label) as labels from ann group by vid")
def _(t):
    return t.ann.groupBy("vid").agg(L.joined(F.collect_set("label")).alias("labels"))


@query("ag06_predictions_pivoted", "pred", "select vid, start_time, count(distinct label)::int as n, max(probability) filter (where label = 'click') as click from pred group by vid, start_time, end_time")
def _(t):
    one = SE.predictions_pivoted(t.pred, 1)
    return one.select("vid", "start_time", F.size("predictions").alias("n"), F.filter("predictions", lambda p: p["label"] == "click")[0]["probability"].alias("click"))


@query("ag06_predictions_json", "pred", "with p as (select vid, start_time, label, max(floor(probability * 10)::int) as p from pred group by vid, start_time, end_time, label) select vid, start_time, concat('{', string_agg(concat('\"', label, '\":', p), ',' order by label), '}') as predictions from p group by vid, start_time")
def _(t):
    p = t.pred.withColumn("probability", F.floor(F.col("probability") * 10).cast("int"))
    return SE.predictions_json(SE.predictions_pivoted(p, 1)).select("vid", "start_time", "predictions")


@query("ag07_vids_with_predictions", "pred", "select distinct vid from pred where mid = 1")
def _(t):
    return t.pred.where("mid = 1").select("vid").distinct()


@query("ag11_group_by_all", "vm ann", "select vid, label from ann group by all")
def _(t):
    return t.ann.select("vid", "label").dropDuplicates()


@query("ag15_video_means", "feat", "select vid, i::int as i, round(avg(x), 6) as x from (select vid, unnest(range(64)) as i, unnest(feature)::double as x from feat) group by vid, i")
def _(t):
    return FE.pooled(t.feat, 1 << 30, "mean").select("vid", F.posexplode("feature").alias("i", "x")).select("vid", "i", F.round("x", 6).alias("x"))


POT = """with r as (select vid, row_number() over w - 1 as t, count(*) over (partition by vid) as n, feature[1]::double as x, lag(feature[1]::double, 2) over w as b from feat window w as (partition by vid order by start_time, fid)),
    win as (select lv as level, k, k / pow(2, lv) as lo, (k + 1) / pow(2, lv) as hi from (select unnest(range(4)) as lv) a, (select unnest(range(8)) as k) b where k < pow(2, lv))
    select vid, level::int as level, k::int as k, round(sum(x), 6) as sum, sum(case when x - b > 0.01 then 1 else 0 end)::bigint as rises, sum(case when x - b < -0.01 then 1 else 0 end)::bigint as falls, max(x) as max
    from r join win on t between floor((n - 1) * (lo + 0.000001) + 0.5) and floor((n - 1) * (hi + 0.000001) + 0.5) group by vid, level, k"""


@query("ag16_pyramid_pooled", "feat", POT)
def _(t):
    one = t.feat.withColumn("feature", F.slice("feature", 1, 1))
    return FE.pyramid_pooled(one).select("vid", "level", "k", F.round("sum", 6).alias("sum"), "rises", "falls", "max")


@query("ag18_max_pooled", "feat", "select vid, g as part, min(start_time) as start_time, max(x1) as x1, max(x2) as x2 from (select vid, start_time, feature[1]::double as x1, feature[64]::double as x2, ((row_number() over (partition by vid order by start_time, fid) - 1) // 4)::bigint as g from feat) group by vid, g")
def _(t):
    return FE.pooled(t.feat, 4).select("vid", "part", "start_time", F.element_at("feature", 1).alias("x1"), F.element_at("feature", 64).alias("x2"))


# --- windows, sets ---


@query("wn02_video_order", "vm", "select vid, row_number() over (order by vstart nulls last, vid) as n from vm")
def _(t):
    return ST.numbered(t.vm.select("vid", "vstart"), "n", 0, ["vstart", "vid"]).select("vid", "n")


@query("wn03_strided_odd", "feat", "select fid from (select fid, row_number() over (partition by vid order by start_time, fid) as n from feat) where n % 2 = 1")
def _(t):
    return FE.strided(slim(t)).select("fid")


@query("wn03_strided_even", "feat", "select fid from (select fid, row_number() over (partition by vid order by start_time, fid) as n from feat) where n % 2 = 0")
def _(t):
    return FE.strided(slim(t), odd=False).select("fid")


@query("st01_vids_with_all", "vm ann feat", "select vid from feat intersect select vid from ann where label = 'signup'")
def _(t):
    return FE.vids_with_all({"a": t.feat, "b": t.ann.where("label = 'signup'")})


@query("st02_vids_without_features", "vm feat", "select vid from vm where vid not in (select vid from feat where feature[1] > 0.25)")
def _(t):
    return FE.missing(t.vm, t.feat.where(F.element_at("feature", 1) > F.lit(0.25).cast("float")))


@query("st03_unlabeled_vids", "vm ann feat", "select vid from feat except select vid from ann where end_time - start_time > 80000")
def _(t):
    return t.feat.select("vid").subtract(t.ann.where("end_time - start_time > 80000").select("vid"))


@query("st04_new_vids", "vm", "select vid from vm where vid % 3 <> 0")
def _(t):
    return ST.new_vids(t.vm.where("vid % 3 = 0"), t.vm)


@query("st05_vids_to_predict", "vm pred", "select vid from vm where vid not in (select vid from pred where probability > 0.7) and vid % 10 <> 1")
def _(t):
    return FE.missing(t.vm, t.pred.where("probability > 0.7"), t.vm.where("vid % 10 = 1"))


@query("st06_all_predictions", "pred", "select mid, vid, label, count(*) as n from (select * from pred union all select 2, vid, start_time, end_time, label, probability from pred where vid % 2 = 0) group by all")
def _(t):
    fresh = t.pred.where("vid % 2 = 0").withColumn("mid", F.lit(2))
    return t.pred.unionByName(fresh).groupBy("mid", "vid", "label").agg(F.count("*").alias("n"))


@query("st07_label_union", "models", "select mid, list_sort(list_filter(list_distinct(list_concat(labels, ['x'])), lambda l: l <> 'click'))::varchar as labels from models")
def _(t):
    u = F.array_sort(F.array_except(F.array_union("labels", F.array(F.lit("x"))), F.array(F.lit("click"))))
    return t.models.select("mid", F.concat(F.lit("["), F.array_join(u, ", "), F.lit("]")).alias("labels"))


@query("st08_whitelisted_minus", "vm ann", "select distinct vid from ann where label in ('click', 'signup') and vid not in (select vid from ann where label = 'error' and end_time - start_time > 60000)")
def _(t):
    out = t.ann.where(F.col("label").isin("click", "signup")).join(t.ann.where("label = 'error' and end_time - start_time > 60000").select("vid"), "vid", "left_anti")
    return out.select("vid").distinct()


# --- functions ---


@query("fn01_rounded", "vm", "select vid, (vduration / 3600)::bigint as hours, (vid + 0.5::double)::bigint as half from vm")
def _(t):
    return t.vm.select("vid", I.rounded(F.col("vduration") / 3600).alias("hours"), I.rounded(F.col("vid") + F.lit(0.5)).alias("half"))


@query("fn05_wall_clock", "vm ann", "select a.aid, epoch_us(v.vstart) + (a.end_time * 1e6)::bigint as us from ann a join vm v on a.vid = v.vid")
def _(t):
    return t.ann.join(t.vm, "vid").select("aid", F.unix_micros(I.seconds_after(F.col("vstart"), F.col("end_time"))).alias("us"))


@query("fn14_name_numbers", "", "select event_id, case event_id % 3 when 0 then (c % 60)::double end as fps, case event_id % 3 when 0 then (c % 7)::double end as stride, case event_id % 3 when 1 then (c % 9)::double end as pool from (select event_id, round(value * 100)::bigint as c from events)")
def _(t):
    text = lambda n: (F.col("c") % n).cast("string")
    name = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("r3d_"), text(60), F.lit("fps_"), text(7), F.lit("fstride"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("clip_"), text(9), F.lit("x4maxpool"))).otherwise(F.col("event_type"))
    names = t.cents.select("event_id", name.alias("name"))
    n = lambda p: L.name_number(F.col("name"), p)
    return names.select("event_id", n(r"(\d+)fps").alias("fps"), n(r"(\d+)fstride").alias("stride"), n(r"(\d+)x\d+maxpool").alias("pool"))


@query("fn15_strides", "vm", "select vid, ceil(29.97::double / (case when vid % 5 = 0 then 1 else vid % 5 end))::bigint as by_fps, ceil(vduration / 64)::bigint as per_video from vm")
def _(t):
    none = F.lit(None).cast("double")
    return t.vm.select("vid", L.stride(F.lit(29.97), none, (F.col("vid") % 5).cast("double"), none, none).alias("by_fps"), L.stride(none, F.col("vduration"), none, F.lit(64.0), none).alias("per_video"))


@query("fn16_frame_windows", "vm", "select vid, s / 30.0::double as start, (s + 64) / 30.0::double as end from (select vid, unnest(range(0, greatest(0, vid * 10 - 64), 32)) as s from vm)")
def _(t):
    # spread by number: the few rows of videos would be one task, which then makes all their windows
    videos = t.vm.select("vid").repartition(4 * t.spark.sparkContext.defaultParallelism, "vid")
    w = videos.select("vid", F.explode(I.windows(F.col("vid") * 10, F.lit(30.0), 16, 4, 32)).alias("w"))
    return w.select("vid", "w.start", "w.end")


@query("fn17_clip_splits", "vm", "select vid, i * 86400.0::double as start_time, (i + 1) * 86400.0::double as end_time from (select vid, unnest(range((vduration / 86400)::bigint)) as i from vm)")
def _(t):
    return I.splits(t.vm, 86400.0).select(*LOW)


@query("fn18_expanded", "vm ann", "select aid, start_time - greatest(0, (900 - (end_time - start_time)) / 2) as s, end_time + greatest(0, (900 - (end_time - start_time)) / 2) as e from ann")
def _(t):
    s, e = I.expanded(F.col("start_time"), F.col("end_time"), 900)
    return t.ann.select("aid", s.alias("s"), e.alias("e"))


@query("fn19_physical_clips", "vm", """with o as (select epoch_us(vstart) + 5000000 as lo, epoch_us(vstart) + 905000000 as hi from vm where vid = 4),
    v as (select vid, epoch_us(vstart) as a, epoch_us(vstart) + vduration::bigint * 1000000 as b from vm)
    select vid, floor(greatest(lo - a, 0) / 1000) / 1000.0::double as start_time, floor((least(hi, b) - a) / 1000) / 1000.0::double as end_time from v, o where a <= hi and b > lo""")
def _(t):
    return SE.physical_clip(t.vm, 4, 5.0, 905.0)


@query("fn21_unique_class", "", "select event_id, x.class from events join (values (0, 'bedded'), (1, 'bedded_chewing'), (2, 'snow'), (3, 'grooming'), (4, null)) as x(k, class) on event_id % 5 = k")
def _(t):
    known = F.get(F.array(*map(F.lit, ("bedded", "chewing_bedded", "chewing_snow", "bedded_grooming_travel"))), (F.col("event_id") % 5).cast("int"))
    return t.events.select("event_id", L.unique_class(F.coalesce(known, F.concat("event_type", F.lit("_b")))).alias("class"))


@query("fn23_chi_square", "feat feat2", """with p as (select a.fid, list_transform(a.feature, lambda x: abs(x::double)) as x, list_transform(b.feature, lambda x: abs(x::double)) as y from feat a join feat b on a.fid + 1 = b.fid)
    select fid, round(list_sum(list_transform(list_zip(x, y), lambda z: case when z[1] + z[2] <> 0 then pow(z[1] - z[2], 2) / (z[1] + z[2]) else 0 end)) / 2, 6) as d from p""")
def _(t):
    a = t.feat.select("fid", F.transform(V.doubles(F.col("feature")), F.abs).alias("x"))
    b = t.feat.select((F.col("fid") - 1).alias("fid"), F.transform(V.doubles(F.col("feature")), F.abs).alias("y"))
    return a.join(b, "fid").select("fid", F.round(V.chi_square(F.col("x"), F.col("y")), 6).alias("d"))


@query("fn24_softmax_l1", "feat", "select fid, round(exp(feature[1]::double) / list_sum(list_transform(feature, lambda x: exp(x::double))), 6) as p, round(feature[1]::double / list_sum(list_transform(feature, lambda x: abs(x::double))), 6) as l1 from feat")
def _(t):
    return t.feat.select("fid", F.round(F.element_at(V.softmax(F.col("feature")), 1), 6).alias("p"), F.round(F.element_at(V.normalised(F.col("feature"), 1), 1), 6).alias("l1"))


@query("fn25_distances", "feat", "select a.fid, round(list_distance(a.feature::double[], b.feature::double[]), 6) as d from feat a cross join (select feature from feat where fid = 0) b")
def _(t):
    one = F.broadcast(t.feat.where("fid = 0").select(F.col("feature").alias("centre")))
    return t.feat.crossJoin(one).select("fid", F.round(V.distance(F.col("feature"), F.col("centre")), 6).alias("d"))


@query("vx08_missing_features", "vm ann feat", "select distinct vid from ann where label = 'signup' and vid not in (select vid from feat where fid % 4 = 0)")
def _(t):
    return FE.missing(t.ann.where("label = 'signup'"), t.feat.where("fid % 4 = 0"))


@query("ml02_binarised", "labeled", f"select fid, {', '.join(f'''(list_contains(string_split(labels, '_'), '{x}'))::int as c_{x}''' for x in LABELS)} from labeled")
def _(t):
    rows = LB.label_join(slim(t), t.vm, t.ann).withColumn("b", L.binarised(F.col("labels"), list(LABELS)))
    return rows.select("fid", *[F.element_at("b", i).alias(f"c_{x}") for i, x in enumerate(sorted(LABELS), 1)])
