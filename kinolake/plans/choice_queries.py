"""Queries that choose clips and features, train and judge models, propagate labels and read logs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import intervals as I
from ..functions import labels as L
from ..functions import vectors as V
from ..operators import bandit as B
from ..operators import cluster as C
from ..operators import discriminant as D
from ..operators import labels as LB
from ..operators import models as M
from ..operators import propagate as P
from ..operators import search as SE
from ..operators import select as SL
from ..sources import logs as LG
from .registry import query

LOW = ["vid", "start_time", "end_time"]


def slim(t):
    return t.feat.drop("feature")


def labeled(t):
    return LB.label_join(slim(t), t.vm, t.ann)


# --- choosing clips ---

SPLITS = "select vid, vstart, i * 86400.0::double as start_time, (i + 1) * 86400.0::double as end_time from (select vid, vstart, unnest(range((vduration / 86400)::bigint)) as i from vm)"
HOUR = "select vid, i * 3600.0::double as start_time, (i + 1) * 3600.0::double as end_time from (select vid, unnest(range((vduration / 3600)::bigint)) as i from vm)"


@query("ex01_random_candidates", "vm ann", f"with c as ({HOUR}) select vid, start_time from c where not exists (select 1 from ann a where a.vid = c.vid and c.start_time >= a.start_time and c.end_time <= a.end_time)")
def _(t):
    return SL.unlabeled_splits(t.vm, t.ann, 3600.0, "full").select("vid", "start_time")


@query("ex01_random_clips", "vm ann", f"with c as ({SPLITS}) select vid, start_time, end_time from c where not exists (select 1 from ann a where a.vid = c.vid and c.start_time >= a.start_time and c.end_time <= a.end_time) order by md5(concat('0:', vid, ':', start_time::bigint)), vid, start_time limit 20")
def _(t):
    return SL.random_clips(t.vm, t.ann, 20, seed=0, t=86400.0)


@query("ex02_temporal_clips", "vm ann", f"with c as ({SPLITS}) select vid, start_time, end_time from c where vid not in (select vid from ann where label = 'error' and end_time - start_time > 72000) order by vstart nulls last, start_time, vid limit 15")
def _(t):
    return SL.temporal_clips(t.vm, t.ann.where("label = 'error' and end_time - start_time > 72000"), 15, 86400.0).select(*LOW)


@query("ex04_coreset_step", "feat", """with s as (select feature from feat where fid in (0, 7, 30))
    select f.fid, round(min(list_distance(f.feature::double[], s.feature::double[])), 6) as min_dist from feat f cross join s group by f.fid""")
def _(t):
    return SL.farthest(t.feat, t.feat.where("fid in (0, 7, 30)")).select("fid", F.round("min_dist", 6).alias("min_dist"))


@query("ex04_coreset")
def _(t):
    return SL.coreset(t.feat, 6, t.feat.where("fid = 0")).select("fid", *LOW)


@query("ex03_cluster_medoids")
def _(t):
    return SL.cluster_medoids(t.feat, labeled(t).where("labels <> 'none'").select("fid"), 5)


@query("ex03_k_medoids")
def _(t):
    own, _, _ = C.k_medoids(t.feat, 8)
    return own.groupBy("cluster").agg(F.count("*").alias("size"), F.min_by("fid", F.struct("distance", "fid")).alias("medoid"))


@query("ex06_average_linkage")
def _(t):
    return C.average_linkage(t.feat).select("fid", "cluster")


@query("ml16_medoid_budget")
def _(t):
    return C.medoid_budget(t.feat, 30, seconds=7200.0).select("fid", *LOW)


@query("tk04_medoids", "clustered labeled", """with d as (select *, list_distance(feature::double[], (select feature::double[] from feat where fid = 0)) as distance, count(*) over (partition by cluster) as size from clustered),
    m as (select * from d qualify row_number() over (partition by cluster order by distance, fid) = 1)
    select fid, cluster, size from m where fid not in (select fid from labeled where labels <> 'none')""")
def _(t):
    centre = F.broadcast(t.feat.where("fid = 0").select(F.col("feature").alias("centre")))
    rows = t.clustered.crossJoin(centre).withColumn("distance", V.distance(F.col("feature"), F.col("centre")))
    return SL.medoids(rows, labeled(t).where("labels <> 'none'")).select("fid", "cluster", "size")


MARGIN = "select vid, start_time, end_time, 1 + list_sort(list(probability), 'desc')[2] - list_sort(list(probability), 'desc')[1] as u from (select distinct vid, start_time, end_time, label, probability from pred qualify row_number() over (partition by vid, start_time, end_time, label order by probability desc) = 1) group by all"


@query("tk06_margins", "pred", f"select vid, start_time, round(u, 9) as uncertainty from ({MARGIN})")
def _(t):
    return SL.margin_ranked(SE.predictions_pivoted(t.pred, 1)).select("vid", "start_time", F.round("uncertainty", 9).alias("uncertainty"))


@query("ex06_cluster_margin", "clustered pred", f"""with u as (select c.fid, c.cluster, m.u from clustered c join ({MARGIN}) m on c.vid = m.vid and c.start_time = m.start_time order by m.u desc, c.fid limit 50),
    r as (select *, count(*) over (partition by cluster) as size, row_number() over (partition by cluster order by md5(concat('0:', fid)), fid) as turn from u)
    select fid, cluster, size, turn from r order by turn, size, cluster limit 5""")
def _(t):
    m = SL.margin_ranked(SE.predictions_pivoted(t.pred, 1)).select("vid", "start_time", "uncertainty")
    rows = t.clustered.join(m, ["vid", "start_time"]).select("fid", "cluster", "uncertainty")
    return SL.cluster_margin(rows, 5).select("fid", "cluster", "size", F.col("turn").cast("bigint").alias("turn"))


@query("ex07_label_uncertainty", "pred", "select vid, start_time, round(abs(0.2::double - probability), 9) as rank_value from pred where label = 'click' order by abs(0.2::double - probability), vid, start_time, end_time limit 40")
def _(t):
    return SL.by_label(t.pred, "click", positives=9, negatives=4, n_labels=5).limit(40).select("vid", "start_time", F.round("rank_value", 9).alias("rank_value"))


@query("ex07_certain_first", "pred", "select vid, start_time, round(abs(1.0::double - probability), 9) as rank_value from pred where label = 'view' order by abs(1.0::double - probability), vid, start_time, end_time limit 40")
def _(t):
    return SL.by_label(t.pred, "view", positives=2, negatives=40, n_labels=5).limit(40).select("vid", "start_time", F.round("rank_value", 9).alias("rank_value"))


@query("ex07_clips_apart")
def _(t):
    got = SL.apart(SL.by_label(t.pred, "click", 9, 4, 5), 10, 7200.0)
    return t.spark.createDataFrame(got, "vid bigint, start_time double, end_time double")


@query("ex09_label_seconds", "vm ann", "select label, ceil(sum(end_time - start_time))::bigint as seconds from ann group by label")
def _(t):
    return t.ann.groupBy("label").agg(F.ceil(F.sum(F.col("end_time") - F.col("start_time"))).alias("seconds"))


@query("ex11_uniformity")
def _(t):
    seconds = {r["label"]: float(r["seconds"]) for r in LB.label_seconds(t.ann).collect()}  # one row a label
    return t.spark.createDataFrame([("binom", SL.binomial_uniform(seconds, 0.001, 2.0)), ("cvm", SL.cvm_uniform(seconds)), ("aks", SL.ad_uniform(seconds))], "test string, uniform boolean")


@query("ex12_tester_names", "", """select event_id, case event_id % 3 when 0 then 'cvm' when 1 then 'binom' else 'aks' end as kind, case when event_id % 3 = 2 then 0.001::double else ('0.0' || (c % 9 + 1)::varchar)::double end as pval,
    case when event_id % 3 = 1 then ((c % 5 + 1)::varchar || '.5')::double end as m from (select event_id, round(value * 100)::bigint as c from events)""")
def _(t):
    pval, m = (F.col("c") % 9 + 1).cast("string"), (F.col("c") % 5 + 1).cast("string")
    name = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("cvm_pval0.0"), pval)).when(F.col("event_id") % 3 == 1, F.concat(F.lit("binom_pval0.0"), pval, F.lit("_m"), m, F.lit(".5"))).otherwise(F.col("event_type"))
    return t.cents.select("event_id", L.tester(name).alias("t")).select("event_id", "t.kind", "t.pval", "t.m")


ZIPF = """with l as (select label, row_number() over (order by md5(concat('5:', label)), label) - 1 as i from (select distinct label from ann)),
    r as (select a.label, a.vid, l.i, count(*) over (partition by a.label) as n, row_number() over (partition by a.label order by md5(concat('5:', a.label, ':', a.vid)), a.vid) as r from (select distinct label, vid from ann) a join l on a.label = l.label)
    select label, vid from r where r <= ceil({} * n)"""


@query("ex17_zipf_sample", "vm ann", ZIPF.format("1 / pow(i + 1, 2)"))
def _(t):
    return SL.zipf_sample(t.ann.select("label", "vid"), 2)


@query("ex17_exponential_sample", "vm ann", ZIPF.format("exp(-0.5 * i)"))
def _(t):
    return SL.zipf_sample(t.ann.select("label", "vid"), 0.5, "exp")


# --- choosing features ---

EWMA = "with recursive e as (select feature_name, t, y, y as l from scores where t = 1 union all select s.feature_name, s.t, s.y, (1 - 2 / 6.0::double) * e.l + 2 / 6.0::double * s.y from e join scores s on s.feature_name = e.feature_name and s.t = e.t + 1)"


@query("bd03_moving_average", "scores", "select feature_name, t, round(coalesce(avg(y) over (partition by feature_name order by t rows between 4 preceding and 1 preceding), y), 9) as l from scores")
def _(t):
    return B.moving_average(t.scores, 4).select("feature_name", "t", F.round("l", 9).alias("l"))


@query("bd04_ewma", "scores", f"{EWMA} select feature_name, t, round(l, 9) as l from e")
def _(t):
    return B.ewma(t.scores, 5).select("feature_name", F.col("t").cast("bigint").alias("t"), F.round("l", 9).alias("l"))


@query("bd05_cost_normalised", "scores", """with recursive c as (select feature_name, case when feature_name = 'fview' then 1.0::double else 1 - (length(feature_name) / 5.0::double) / 2.0::double * 0.1 end as k from (select distinct feature_name from scores)),
    e as (select s.feature_name, t, greatest(k * y, 0) as l, k from scores s join c on s.feature_name = c.feature_name where t = 1
      union all select s.feature_name, s.t, greatest(e.k * ((1 - 2 / 6.0::double) * e.l + 2 / 6.0::double * s.y), 0), e.k from e join scores s on s.feature_name = e.feature_name and s.t = e.t + 1)
    select feature_name, t, round(l, 9) as l from e""")
def _(t):
    costs = t.scores.select("feature_name").distinct().withColumn("cost", F.length("feature_name").cast("double"))
    return B.cost_normalised(t.scores, costs, 5, 0.1).select("feature_name", F.col("t").cast("bigint").alias("t"), F.round("l", 9).alias("l"))


#: The place of BD02: the nearest at least four steps back whose value isn't larger than the last; null if none.
BACK = "(list_filter(list_reverse(range(1, 9)), lambda i: l[i] <= l[12]))[1]"


@query("bd02_growth", "scores", f"""with z as (select feature_name, list(y order by t) as l from scores group by feature_name), i as (select *, {BACK} as i from z)
    select feature_name, round(case when i is null then l[12] / 11 else (l[12] - l[i]) / (12 - i) end, 9) as w from i""")
def _(t):
    series = t.scores.groupBy("feature_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "y"))), lambda x: x["y"]).alias("l"))
    return series.select("feature_name", F.round(B.growth(F.col("l"), 4), 9).alias("w"))


@query("bd01_survivors", "scores", f"""with z as (select feature_name, list(y order by t) as l from scores group by feature_name), i as (select *, {BACK} as i from z),
    u as (select feature_name, l[12] as l, least(l[12] + case when i is null then l[12] / 11 else (l[12] - l[i]) / (12 - i) end * 2, 1) as u from i)
    select feature_name, round(u, 9) as u from u where feature_name = (select feature_name from u order by l desc, feature_name limit 1) or u > (select max(l) from u)""")
def _(t):
    state = B.bounds(t.scores.withColumn("l", F.col("y")), c=4, horizon=14)
    return B.survivors(state).select("feature_name", F.round("u", 9).alias("u"))


@query("bd06_best_feature", "scores", "select feature_name, y as score from scores where t = 12 order by y desc, feature_name desc limit 1")
def _(t):
    return B.best(t.scores)


# --- models ---

TRUTH = "select p.vid, p.start_time, p.end_time, p.label, p.probability, list_contains(string_split(l.labels, '_'), p.label)::int as y from pred p join (select distinct vid, start_time, end_time, labels from labeled where labels <> 'none') l on p.vid = l.vid and p.start_time = l.start_time and p.end_time = l.end_time"


def scored(t):
    return M.truth(t.pred, labeled(t))


@query("ml01_training_set", "vm ann feat", """select f.fid, string_agg(distinct a.label, '_' order by a.label) as labels from feat f join ann a on f.vid = a.vid and f.start_time >= a.start_time and f.end_time <= a.end_time
    where a.label <> 'view' group by f.fid""")
def _(t):
    return M.training_set(t.feat, t.vm, t.ann, ["view"]).select("fid", "labels")


@query("ml03_soft_targets", "labeled", "select label, round(sum(w), 6) as weight from (select unnest(string_split(labels, '_')) as label, 1.0::double / len(string_split(labels, '_')) as w from labeled where labels <> 'none') group by label")
def _(t):
    return M.soft_targets(labeled(t).where("labels <> 'none'")).groupBy("label").agg(F.round(F.sum("weight"), 6).alias("weight"))


COUNTS = "sum((probability >= th and y = 1)::int) as tp, sum((probability >= th and y = 0)::int) as fp, sum((probability < th and y = 1)::int) as fn, sum((probability < th and y = 0)::int) as tn"


@query("ml06_f1_threshold", "pred labeled", f"""with s as ({TRUTH}), c as (select label, th, {COUNTS} from s cross join (select unnest([0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5]::double[]) as th) group by label, th),
    f as (select th, avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)) as f1 from c group by th) select th as threshold, round(f1, 9) as f1 from f order by f1 desc, th limit 1""")
def _(t):
    return M.best_threshold(scored(t)).select("threshold", F.round("f1", 9).alias("f1"))


@query("ml07_f1_by_class", "pred labeled", f"with s as ({TRUTH}), c as (select label, {COUNTS.replace('th', '0.25')} from s group by label) select label, tp::bigint as tp, fp::bigint as fp, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) as f1, round((tp + tn) / (tp + fp + fn + tn), 9) as accuracy from c")
def _(t):
    return M.f1_scores(M.counts_at(scored(t), (0.25,))).select("label", "tp", "fp", F.round("f1", 9).alias("f1"), F.round("accuracy", 9).alias("accuracy"))


AP = "select label, sum(p * tp / seen) / nullif(sum(p), 0) as ap from (select *, sum(p) over w as tp, sum(n) over w as seen from (select label, probability, sum(y) as p, count(*) as n from s group by label, probability) window w as (partition by label order by probability desc)) group by label"


@query("ml07_average_precision", "pred labeled", f"with s as ({TRUTH}) select label, round(ap, 9) as average_precision from ({AP})")
def _(t):
    return M.average_precision(scored(t)).select("label", F.round("average_precision", 9).alias("average_precision"))


@query("ml07_metrics", "pred labeled", f"""with s as ({TRUTH}), c as (select label, {COUNTS.replace('th', '0.25')} from s group by label), m as (select sum(tp) as tp, sum(fp) as fp, sum(fn) as fn, sum(tn) as tn from c)
    select round((select avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)) from c), 9) as f1_macro, round((select avg((tp + tn) / (tp + fp + fn + tn)) from c), 9) as accuracy_macro,
    round(2 * tp / (2 * tp + fp + fn), 9) as f1_micro, round((tp + tn) / (tp + fp + fn + tn), 9) as accuracy_micro, round((select avg(ap) from ({AP})), 9) as map from m""")
def _(t):
    m = M.metrics(scored(t), 0.25)
    return m.select(*[F.round(c, 9).alias(c) for c in m.columns])


@query("ml07_top2_accuracy", "pred labeled", f"""with s as ({TRUTH}), r as (select *, row_number() over (partition by vid, start_time, end_time order by probability desc, label) as r from s),
    e as (select min_by(r, label) filter (where y = 1) as r from r group by vid, start_time, end_time having max(y) = 1) select round(avg((r <= 2)::int), 9) as accuracy from e""")
def _(t):
    return M.top_k_accuracy(scored(t), 2).select(F.round("accuracy", 9).alias("accuracy"))


@query("ml09_fixed_weights", "feat", "select fid, round(exp(feature[1]::double * 2 - feature[2]::double) / (exp(feature[1]::double * 2 - feature[2]::double) + exp(feature[2]::double * 3)), 6) as p from feat")
def _(t):
    p = M.linear_scores(t.feat, {"a": [2.0, -1.0], "b": [0.0, 3.0]})
    return p.where("label = 'a'").select("fid", F.round("probability", 6).alias("p"))


@query("ml09_cached_and_fresh", "feat pred", """select mid, label, count(*) as n from (select distinct 1 as mid, vid, start_time, end_time, label, probability from pred where vid % 2 = 0) group by all
    union all select 1, 'fresh', count(*) from feat where vid % 2 = 1""")
def _(t):
    fresh = lambda rows: rows.select(F.lit(1).alias("mid"), *LOW, F.lit("fresh").alias("label"), F.lit(0.5).alias("probability"))
    stored = t.pred.where("vid % 2 = 0").dropDuplicates()
    return M.predicted(t.feat, stored, 1, fresh).groupBy("mid", "label").agg(F.count("*").alias("n"))


@query("ml13_truth", "pred labeled", f"select label, sum(y)::bigint as y, count(*) as n from ({TRUTH}) group by label")
def _(t):
    return scored(t).groupBy("label").agg(F.sum("y").alias("y"), F.count("*").alias("n"))


@query("ag09_by_video", "pred labeled", f"select vid, label, max(y) as y, max(probability) as probability from ({TRUTH}) group by vid, label")
def _(t):
    return M.by_video(scored(t))


@query("ag08_fold_medians", "scores", "select round(median(y), 9) as y from scores where t = 12")
def _(t):
    return M.medians(t.scores.where("t = 12").select("y")).select(F.round("y", 9).alias("y"))


@query("ml08_cross_validated")
def _(t):
    rows = LB.with_columns_of(LB.label_join(slim(t), t.vm, t.ann), t.feat).where("labels <> 'none'")
    out = M.cross_validated(rows, 2)
    return out if out is not None else t.spark.range(0).select(F.lit(0.0).alias("f1_macro"))


@query("ml03_trained_model")
def _(t):
    rows = LB.with_columns_of(LB.label_join(slim(t), t.vm, t.ann), t.feat).where("labels <> 'none'")
    model, classes = M.fit_linear(rows, max_iter=20)
    return M.infer(model, classes, t.feat, 7)


# --- labelling ---

CLUSTERED = "select c.*, case when l.labels <> 'none' then string_split(l.labels, '_')[1] end as hard_label, list_distance(c.feature::double[], (select feature::double[] from feat where fid = 0)) as distance from clustered c join labeled l on c.fid = l.fid"


def marked(t):
    centre = F.broadcast(t.feat.where("fid = 0").select(F.col("feature").alias("centre")))
    rows = t.clustered.crossJoin(centre).withColumn("distance", V.distance(F.col("feature"), F.col("centre")))
    own = labeled(t).select("fid", F.when(F.col("labels") != "none", F.element_at(L.pieces(F.col("labels")), 1)).alias("hard_label"))
    return rows.join(own, "fid").drop("centre")


@query("ag13_cluster_stats", "clustered labeled", f"select cluster, count(*) as size, sum((hard_label is null)::int)::bigint as unlabeled, count(distinct hard_label) as labels, round(quantile_cont(distance, 0.75), 6) as far from ({CLUSTERED}) group by cluster")
def _(t):
    return P.cluster_stats(marked(t)).withColumn("far", F.round("far", 6))


@query("lb04_largest_cluster", "clustered labeled", f"select cluster from ({CLUSTERED}) group by cluster having sum((hard_label is null)::int) > 0 order by count(*) desc, cluster limit 1")
def _(t):
    return P.ranked_cluster(P.cluster_stats(marked(t)), "size")


@query("lb04_widest_cluster", "clustered labeled", f"select cluster from ({CLUSTERED}) group by cluster having sum((hard_label is null)::int) > 0 order by quantile_cont(distance, 0.75) desc, cluster limit 1")
def _(t):
    return P.ranked_cluster(P.cluster_stats(marked(t)), "far")


@query("lb05_centre_elements", "clustered labeled", f"select cluster, min_by(fid, (distance, fid)) as centre, max_by(fid, (distance, -fid)) as outside from ({CLUSTERED}) where hard_label is null group by cluster")
def _(t):
    return P.centre_element(marked(t), outside=True)


@query("lb05_far_pairs")
def _(t):
    return P.far_pair(marked(t))


@query("lb06_propagated", "clustered labeled", f"""with c as ({CLUSTERED}), v as (select cluster, hard_label, count(*) as n from c where hard_label is not null group by all),
    m as (select cluster, min_by(hard_label, (-n, hard_label)) as mode from v group by cluster) select fid, coalesce(hard_label, mode) as label from c left join m on c.cluster = m.cluster""")
def _(t):
    return P.propagated(marked(t)).select("fid", "label")


@query("lb02_least_certain", "pred", "select vid, start_time, round(max(probability), 9) as top from pred group by vid, start_time, end_time order by max(probability), vid, start_time, end_time limit 25")
def _(t):
    return P.least_certain(t.pred, 25).select("vid", "start_time", F.round("top", 9).alias("top"))


@query("lb11_oracle_labels", "vm ann feat", "select f.vid, greatest(f.start_time, a.start_time) as start_time, least(f.end_time, a.end_time) as end_time, a.label from feat f join ann a on f.vid = a.vid and f.start_time <= a.end_time and a.start_time <= f.end_time")
def _(t):
    return LB.labels_within(slim(t), t.ann)


@query("ml15_augmented", "vm ann", """with m as (select vid, start_time, label from ann where aid % 5 = 0), r as (select aid as fid, vid, start_time from ann)
    select r.fid, m.label, round(max(exp(-pow(r.start_time - m.start_time, 2) / (2.0 * 1800 * 1800))), 6) as weight from r join m on r.vid = m.vid and abs(r.start_time - m.start_time) <= 3600 group by r.fid, m.label""")
def _(t):
    rows = t.ann.select(F.col("aid").alias("fid"), "vid", "start_time", "label")
    return P.augmented(t.ann.where("aid % 5 = 0").select("vid", "start_time", "label"), rows, seconds=3600.0, scale=1800.0).withColumn("weight", F.round("weight", 6))


@query("ag14_augmentation_quality", "vm ann", """with m as (select vid, start_time, label from ann where aid % 5 = 0), r as (select aid as fid, vid, start_time, label from ann),
    g as (select distinct r.fid, m.label from r join m on r.vid = m.vid and abs(r.start_time - m.start_time) <= 3600),
    d as (select coalesce(g.fid, x.fid) as fid, (x.fid is not null)::int - (g.fid is not null)::int as d from (select * from r where fid in (select fid from g)) x full join g on g.fid = x.fid and g.label = x.label),
    p as (select fid, sum(d) as d, max((d <> 0)::int) as wrong from d group by fid)
    select count(*) as n_augmented, sum(1 - wrong)::bigint as n_correct, sum(wrong)::bigint as n_incorrect, round(avg(d), 9) as avg_row_delta from p""")
def _(t):
    rows = t.ann.select(F.col("aid").alias("fid"), "vid", "start_time", "label")
    got = P.augmented(t.ann.where("aid % 5 = 0").select("vid", "start_time", "label"), rows, seconds=3600.0, how="center")
    totals, _ = P.augmentation_quality(got, rows.select("fid", "label"))
    return totals.withColumn("avg_row_delta", F.round("avg_row_delta", 9))


@query("wn06_temporal_sample", "vm ann", """with r as (select aid, vid % 7 as p, row_number() over (partition by vid % 7 order by aid) as n from ann)
    select aid from r where n <= ceil(ceil(0.01 * (select count(*) from ann)) / (select count(distinct vid % 7) from ann))""")
def _(t):
    return P.temporal_sample(t.ann, 0.01, F.col("vid") % 7, "aid").select("aid")


@query("ml16_labeling_budget", "vm ann", "select aid from ann order by label_time, aid limit (select ceil(0.02 * count(*))::bigint from ann)")
def _(t):
    return P.temporal_sample(t.ann.withColumn("at", F.struct("label_time", "aid")), 0.02, F.lit(0), "at").select("aid")


# --- logs ---


@query("src08_piped_lines", "", "select event_type as label, event_id::int as step, case when event_id % 5 > 0 then concat(c // 100, '.', lpad((c % 100)::varchar, 2, '0'))::double end as ap from (select *, round(value * 100)::bigint as c from events)")
def _(t):
    amount = F.when(F.col("event_id") % 5 > 0, F.format_string("%d.%02d", F.expr("c div 100"), F.col("c") % 100)).otherwise("")
    return LG.piped(t.cents.select(F.concat_ws("|", "event_type", F.col("event_id").cast("string"), amount).alias("value")), "label string, step int, ap double")


STEPPED = r"""with s as (select *, last_value(nullif(regexp_extract(line, '^\*\*\* Step (\d+)', 1), '')::int ignore nulls) over (partition by file order by line_no rows between unbounded preceding and current row) as step,
    coalesce(max((line like 'Args%')::int) over b, 0) = 1 as past_setup,
    coalesce(last_value(case when contains(line, '*** Evaluating labels') then 1 when contains(line, '*** Performance') then 0 end ignore nulls) over b, 0) = 1 as in_eval
    from loglines window b as (partition by file order by line_no rows between unbounded preceding and 1 preceding)),
    p as (select * from s where in_eval and step is not null and contains(line, '*** Performance {'))"""


def grabbed(pattern, kind="double", when="true"):
    return f"max(case when {when} then nullif(regexp_extract(line, '{pattern}', 1), '')::{kind} end)"


@query("src09_step_values", "loglines", STEPPED + f""" select file, step, {grabbed('explore took ([0-9.]+) seconds')} as explore_seconds, {grabbed("explore [(]feature .''(.*)''.[)]", 'varchar')} as feature, {grabbed('Training set size ([0-9]+)', 'int', 'in_eval')} as training_size,
    {grabbed('split pred [(]len=([0-9]+)[)]', 'int', 'in_eval')} as eval_size, {grabbed('multilabel_threshold=([0-9.]+);', when='in_eval')} as f1_threshold, {grabbed('best on split=([0-9.]+)', when='in_eval')} as best_threshold from s where step is not null group by file, step""")
def _(t):
    return LG.step_values(t.loglines)


def scored_key(key):
    return f"replace(regexp_extract(line, '{key}.: ([0-9.]+|nan)', 1), 'nan', '-1')::double"


@query("src09_label_precisions", "loglines", STEPPED + " union all ".join(f" select file, step, '{x}' as label, {scored_key(f'pred_avgprecision_{x}')} as ap from p" for x in ("bedded", "chewing")))
def _(t):
    return LG.label_precisions(t.loglines)


@query("src09_label_f1", "loglines", STEPPED + f" select file, step, 'bedded' as label, {scored_key('pred_ml_f1_score_bedded')} as f1 from p")
def _(t):
    return LG.label_f1(t.loglines)


@query("src09_aggregates", "loglines", STEPPED + f" select file, step, max({scored_key('pred_mAP')}) as map, max({scored_key('pred_ml_f1_score_macro')}) as f1_macro from p group by file, step")
def _(t):
    return LG.aggregate_results(t.loglines)


@query("src09_label_totals", "loglines", STEPPED + r""", y as (select *, row_number() over (partition by file, step order by line_no) as k from s where in_eval and step is not null and contains(line, 'y_train (len=')),
    z as (select file, step, unnest(['bedded', 'chewing', 'snow']) as label, line from y where k = 1), n as (select file, step, label, regexp_extract(line, concat(label, '., ([0-9]+)'), 1)::int as n from z) select * from n where n > 0""")
def _(t):
    return LG.label_totals(t.loglines)


@query("src09_setup_values", "loglines", STEPPED + r""" select file, split_part(line, '=', 1) as key, replace(substr(line, strpos(line, '=') + 1), '"', '') as value from s where not past_setup and contains(line, '=') and not contains(line, '===') and not line like 'Args%'
    union all select file, k, regexp_extract(line, concat('--', k, '., .([0-9]+)'), 1) from (select *, unnest(['k', 'nsteps']) as k from s where line like 'Args%')""")
def _(t):
    return LG.setup_values(t.loglines)


@query("src10_latencies", "", """with m as (select user_id, event_id, concat(event_id, '.', lpad((round(value * 100)::bigint % 100)::varchar, 2, '0'))::double as sec, event_type as kind from events where event_type in ('click', 'view')),
    p as (select *, lag(kind) over w as before, lag(sec) over w as since from m window w as (partition by user_id order by event_id)) select user_id::varchar as file, event_id::bigint as line_no, sec - since as seconds from p where kind = 'view' and before = 'click'""")
def _(t):
    at = F.format_string("%d.%02d", F.col("event_id").cast("bigint"), F.col("c") % 100)
    what = F.when(F.col("event_type") == "click", "begin explore").when(F.col("event_type") == "view", "end explore").otherwise("note")
    rows = t.cents.select(F.col("user_id").cast("string").alias("file"), F.col("event_id").cast("bigint").alias("line_no"), F.concat_ws(" ", at, what).alias("line"))
    return LG.durations(rows, "begin explore", "end explore")


RESULTS = "select file, " + ", ".join(f"regexp_extract(line, '{k}: ([^|}}]*?) *[|}}]', 1){cast} as {name}" for k, name, cast in (("dataset_name", "dataset", ""), ("feature_name", "feature", ""), ("nworkers", "nworkers", "::int"), ("npipe", "npipe", "::int"), ("vidtime", "vidtime", "::double"))) + " from loglines where line like 'Results: {%'"


@query("src11_throughput", "loglines", RESULTS)
def _(t):
    return LG.throughput(t.loglines)


@query("ag10_feature_costs", "loglines", f"select feature, round(avg(vidtime), 6) as cost from ({RESULTS}) where dataset = 'deer' and nworkers = 4 and npipe = 2 group by feature")
def _(t):
    return LG.feature_costs(LG.throughput(t.loglines), "deer").select("feature", F.round("cost", 6).alias("cost"))


@query("ag12_done_experiments", "vm ann", "select label, max(vid) as last, count(distinct vid) as done from ann group by label")
def _(t):
    return t.ann.groupBy("label").agg(F.max("vid").alias("last"), F.countDistinct("vid").alias("done"))


@query("src12_bandit_series", "", """select user_id::varchar as file, event_id::bigint as line_no, event_type as feature, [c % 50 / 64.0::double, c % 7 / 64.0::double] as y_k, [1000000.0::double, c % 9 / 64.0::double] as w_k, [1.0::double, 0.5] as u_k, [c % 5 / 64.0::double] as l_k
    from (select *, round(value * 100)::bigint as c from events) where event_id % 2 = 0""")
def _(t):
    part = lambda n: (F.col("c") % n / F.lit(64.0)).cast("string")
    line = F.concat(F.lit("  "), F.col("event_type"), F.lit(": y_k=["), part(50), F.lit(", "), part(7), F.lit("], w_k=[1000000.0, "), part(9), F.lit("], u_k=[1, 0.5], l_k=["), part(5), F.lit("]"))
    rows = t.cents.select(F.col("user_id").cast("string").alias("file"), F.col("event_id").cast("bigint").alias("line_no"), F.when(F.col("event_id") % 2 == 0, line).otherwise("After step 2").alias("line"))
    return LG.bandit_series(rows)


@query("dml16_fixed_up", "", "select event_id, event_type as condition, case when event_id % 3 = 0 then 'exact' else event_type end as oracle from events")
def _(t):
    condition = F.concat(F.when(F.col("event_id") % 2 == 0, "suspend").otherwise(""), "event_type")
    return LG.fixed_up(t.events.select("event_id", condition.alias("condition"), F.when(F.col("event_id") % 3 > 0, F.col("event_type")).alias("oracle")))


ALIGN = [(0.1, 1.5), (0.75, 2.25), (1.5, 3.0), (2.25, 3.75), (3.0, 7.0)]


@query("fn20_aligned", "", """with r as (select event_id, round(value * 100)::bigint % 800 / 100.0::double - 0.5 as s, round(value * 100)::bigint % 800 / 100.0::double - 0.5 + event_id % 30 / 10.0::double as e from events),
    w as (select * from (values (0, 0.1::double, 1.5::double), (1, 0.75, 2.25), (2, 1.5, 3.0), (3, 2.25, 3.75), (4, 3.0, 7.0)) as x(i, ws, we)),
    t as (select event_id, min(row(greatest(e, we) - least(s, ws) - (e - s), i, least(s, ws), greatest(e, we))) as best from r join w on we >= s and ws <= e group by event_id)
    select r.event_id, case when s > 7.0 then 3.0 when best is not null then best[3] else s end as start, case when s > 7.0 or best is null and e >= 0.1 then e when best is not null then best[4] else 1.5 end as "end" from r left join t on r.event_id = t.event_id""")
def _(t):
    sub = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ALIGN])
    s = F.col("c") % 800 / F.lit(100.0) - 0.5
    rows = t.cents.select("event_id", s.alias("s"), (s + F.col("event_id") % 30 / F.lit(10.0)).alias("e"))
    return rows.select("event_id", I.aligned(sub, F.col("s"), F.col("e")).alias("c")).select("event_id", "c.start", "c.end")


@query("vx04_extractor_names", "", "select event_id, case event_id % 6 when 0 then 'clip' when 1 then 'r3d' when 2 then 'i3d' when 3 then 'mvit' when 4 then 'pot' end as extractor from events")
def _(t):
    prefix = F.element_at(F.array(*map(F.lit, ("clip_", "r3d_18_", "i3d", "mvit_", "pot_", "x_clip"))), (F.col("event_id") % 6 + 1).cast("int"))
    return t.events.select("event_id", L.extractor(F.concat(prefix, "event_type")).alias("extractor"))



# --- the façade and extraction ---


def store(t):
    from ..operators.explore import Store

    return Store(t.vm, t.ann, {"r3d": t.feat}, t.models.where("mid = 1"), t.pred)


@query("ex05_cluster_coreset")
def _(t):
    return store(t).explore("clustercoreset", 3, 60.0, "r3d", step=1)


@query("ex06_explored_margin")
def _(t):
    return store(t).explore("clustermargin", 3, 60.0, "r3d", step=20)


@query("ex09_random_if_uniform")
def _(t):
    return store(t).explore("randomifuniform", 3, 60.0, "r3d")


@query("ex14_explored_uncertainty")
def _(t):
    return store(t).explore("uncertainty", 3, 60.0, "r3d", label="click")


@query("ex15_watched", "vm pred", "select v.vid, v.vpath, count(p.vid)::int as n from vm v left join pred p on p.vid = v.vid and p.start_time < v.vduration where v.vid in (2, 4, 6) group by all")
def _(t):
    return store(t).watch([2, 4, 6], 1).select("vid", "vpath", F.size("predictions").alias("n"))


@query("ag19_progress", "vm feat", "select 'r3d' as feature, (select count(distinct vid) from feat) as done, (select count(*) from vm) as total")
def _(t):
    return t.spark.createDataFrame([(k, *v) for k, v in store(t).progress().items()], "feature string, done bigint, total bigint")


@query("ag17_bag_of_words", "feat", """with b as (select fid::int as word, feature::double[] as centre from feat where fid in (0, 3, 6)),
    n as (select f.vid, min_by(b.word, (list_distance(f.feature::double[], b.centre), b.word)) as word from feat f cross join b group by f.vid, f.fid)
    select vid, count(*) filter (where word = 0) as w0, count(*) filter (where word = 3) as w3, count(*) filter (where word = 6) as w6 from n group by vid""")
def _(t):
    from ..operators.extract import bag_of_words

    book = t.feat.where("fid in (0, 3, 6)").select(F.col("fid").cast("int").alias("word"), V.doubles(F.col("feature")).alias("centre"))
    h = bag_of_words(t.feat, book)
    return h.select("vid", *[F.element_at("histogram", i).cast("bigint").alias(f"w{w}") for i, w in ((1, 0), (2, 3), (3, 6))])


@query("fn26_percentiles_ranks", "feat", """select fid, round(quantile_cont(x, 0.25), 6) as q1, round(quantile_cont(x, 0.5), 6) as q2, max(x) as top, sum((x < f1)::int)::int as rank1
    from (select fid, unnest(feature)::double as x, feature[1]::double as f1 from feat) group by fid""")
def _(t):
    from ..operators.extract import grid_ranks, spread

    x = V.doubles(F.col("feature"))
    return t.feat.select("fid", spread(x).alias("p"), F.element_at(grid_ranks(x), 1).alias("rank1")).select("fid", F.round(F.col("p")[1], 6).alias("q1"), F.round(F.col("p")[2], 6).alias("q2"), F.col("p")[4].alias("top"), "rank1")


@query("vx05_extracted", "feat", "select fid as vid, 0.0::double as start_time, round(feature[1]::double, 5) as x from feat")
def _(t):
    import numpy as np

    from ..operators.extract import extracted

    files = t.feat.select(F.col("fid").alias("vid"), F.encode(F.format_string("%.9f", F.element_at("feature", 1).cast("double")), "UTF-8").alias("content"))
    got = extracted(files, lambda content: [(0.0, 1.0, np.array([float(content.decode())]))])
    return got.select("vid", "start_time", F.round(F.element_at("feature", 1).cast("double"), 5).alias("x"))


@query("lb07_reclustered")
def _(t):
    return P.reclustered(t.clustered, 0, 3, 100).groupBy("cluster").agg(F.count("*").alias("n"))


@query("ml05_tuned_threshold")
def _(t):
    rows = LB.with_columns_of(labeled(t), t.feat).where("labels <> 'none'")
    _, classes, threshold = M.fit_tuned(rows, max_iter=10)
    return t.spark.createDataFrame([(c, threshold) for c in classes], "label string, threshold double")


@query("ml12_needs_training")
def _(t):
    made = [(stale, M.needs_training(t.models, t.ann, "r3d", allow_stale=stale)) for stale in (True, False)]
    return t.spark.createDataFrame(made, "allow_stale boolean, train boolean")


@query("flt14_missing_thumbnails", "vm", "select vid from vm where vid % 3 <> 1")
def _(t):
    from ..sources.videos import missing_thumbnails

    return missing_thumbnails(t.vm, t.vm.where("vid % 3 = 1").select(F.col("thumbpath").alias("path"))).select("vid")


@query("jn09_temporal_join", "vm labeled", """select f.vid, f.start_time from labeled f join vm v on f.vid = v.vid where labels = 'none' order by v.vstart, f.start_time, f.vid, f.fid limit 30""")
def _(t):
    free = labeled(t).where("labels = 'none'").join(t.vm.select("vid", "vstart"), "vid")
    return free.orderBy("vstart", "start_time", "vid", "fid").limit(30).select("vid", "start_time")


@query("fn04_milliseconds", "vm", "select vid, (epoch_us(vstart + to_seconds(vduration::bigint)) - epoch_us(vstart)) // 1000 / 1000.0::double as s from vm")
def _(t):
    end = F.timestamp_micros(F.unix_micros("vstart") + I.rounded(F.col("vduration")) * 1_000_000)
    return t.vm.select("vid", (F.timestamp_diff("MILLISECOND", F.col("vstart"), end) / F.lit(1000.0)).alias("s"))


@query("fn08_list_concat_null", "feat", "select fid, len(list_concat(feature, case when fid % 2 = 0 then feature end))::int as n from feat")
def _(t):
    return t.feat.select("fid", F.size(V.concat(F.col("feature"), F.when(F.col("fid") % 2 == 0, F.col("feature")))).alias("n"))


@query("fn27_gaussian_weights", "", "select event_id, round(exp(-d * d / 50.0::double), 9) as w from (select event_id, round(value * 100)::bigint % 150 / 10.0::double as d from events)")
def _(t):
    return t.cents.select("event_id", F.round(V.gaussian_weight(F.col("c") % 150 / F.lit(10.0)), 9).alias("w"))


@query("fn10_features_of_name", "", "select event_id from events where event_id % 5 < 2")
def _(t):
    name = F.element_at(F.array(F.lit("R3D_18"), F.lit("r3d_18"), F.lit("r3d_34"), F.col("event_type"), F.lit(None).cast("string")), (F.col("event_id") % 5 + 1).cast("int"))
    return t.events.where(L.named(name, "R3d_18")).select("event_id")


@query("stm03_eager_sample", "vm feat", "select vid from vm where vid not in (select vid from feat where fid % 4 = 0) order by md5(concat('3:', vid::varchar)), vid limit 10")
def _(t):
    from ..operators.features import eager_sample

    return eager_sample(t.vm, t.feat.where("fid % 4 = 0"), 10, seed=3)


@query("ml16_random_stretches", "vm ann", """with c as (select aid, vid, floor(start_time / 3600)::bigint as cell from ann), s as (select vid, cell, count(*) as n from c group by all),
    r as (select *, coalesce(sum(n) over (order by md5(concat('0:', vid::varchar, ':', cell::varchar)), vid, cell rows between unbounded preceding and 1 preceding), 0) as before from s)
    select aid from c join r on c.vid = r.vid and c.cell = r.cell where before < 200""")
def _(t):
    return P.random_stretches(t.ann, 200, 3600.0).select("aid")


# --- elimination step by step ---

#: Bounds around the mean value of each event type by step, narrower with every step; experiments are groups of users.
BOUNDED = """select experiment, feature_name, list(round(y - {0} / (t + 1), 6) order by t) as l, list(round(y + {0} / (t + 1), 6) order by t) as u
    from (select user_id % 20 as experiment, event_type as feature_name, event_id % 12 as t, round(avg(value), 6) as y from events group by all) group by experiment, feature_name"""


def bounded(t, width):
    y = t.events.groupBy((F.col("user_id") % 20).alias("experiment"), F.col("event_type").alias("feature_name"), (F.col("event_id") % 12).alias("t")).agg(F.round(F.avg("value"), 6).alias("y"))
    rows = y.select("experiment", "feature_name", F.struct("t", F.round(F.col("y") - width / (F.col("t") + 1), 6).alias("l"), F.round(F.col("y") + width / (F.col("t") + 1), 6).alias("u")).alias("b"))
    return rows.groupBy("experiment", "feature_name").agg(F.array_sort(F.collect_list("b")).alias("b")).select("experiment", "feature_name", F.transform("b", lambda b: b["l"]).alias("l"), F.transform("b", lambda b: b["u"]).alias("u"))


@query("bd07_elimination_steps", "", f"""with recursive s as ({BOUNDED.format('120.0::double')}),
    e as (select experiment, map_from_entries(list((feature_name, l))) as lo, map_from_entries(list((feature_name, u))) as hi, list_sort(list(feature_name)) as f, len(min_by(l, feature_name)) as n from s group by experiment),
    r as (select experiment, 2 as i, f as start, list_filter(f, lambda g: len(list_filter(f, lambda h: h <> g and lo[h][3] >= hi[g][3])) = 0) as rest from e where n > 2
      union all select r.experiment, r.i + 1, r.rest, list_filter(r.rest, lambda g: len(list_filter(r.rest, lambda h: h <> g and e.lo[h][r.i + 2] >= e.hi[g][r.i + 2])) = 0) from r join e on e.experiment = r.experiment where r.i + 1 < e.n and len(r.start) <> 1),
    z as (select *, row_number() over (partition by experiment order by i desc) as last from r)
    select experiment, unnest(list_filter(start, lambda g: not list_contains(rest, g))) as feature_name, i as step from r
    union all select z.experiment, unnest(start), (n + 1)::int from z join e on e.experiment = z.experiment where last = 1""")
def _(t):
    return B.eliminations(bounded(t, 120.0), ["experiment"])


@query("bd07_eliminated_at_end", "", f"""with recursive s as ({BOUNDED.format('60.0::double')}),
    c as (select experiment, feature_name as f, l[:12 - (ascii(feature_name) + experiment) % 2] as l, u[:12 - (ascii(feature_name) + experiment) % 2] as u from s),
    m as (select *, len(l) as n, max(len(l)) over (partition by experiment) as m from c),
    e as (select experiment, map_from_entries(list((f, l[-1]))) as lo, map_from_entries(list((f, u[-1]))) as hi, list_sort(list(f) filter (where n = m)) as f, max(m) as m from m group by experiment),
    r as (select experiment, 1 as k, f as kept from e union all
      select r.experiment, k + 1, case when list_contains(kept, e.f[k]) then list_filter(kept, lambda g: g = e.f[k] or not e.lo[e.f[k]] >= e.hi[g]) else kept end from r join e on e.experiment = r.experiment where k <= len(e.f)),
    z as (select r.experiment, kept from r join e on e.experiment = r.experiment where k = len(e.f) + 1 and len(kept) = 1)
    select m.experiment, m.f as feature_name, (case when list_contains(kept, m.f) then m + 1 else n end)::int as step from m join z on z.experiment = m.experiment""")
def _(t):
    cut = F.lit(12) - (F.ascii("feature_name") + F.col("experiment")) % 2
    rows = bounded(t, 60.0).select("experiment", "feature_name", F.slice("l", F.lit(1), cut.cast("int")).alias("l"), F.slice("u", F.lit(1), cut.cast("int")).alias("u"))
    return B.eliminated(rows, ["experiment"])


# --- discriminants, mixtures, label cleaning ---

TOPS = "select f.fid, f.cluster, l.hard_label, p.top, p.predicted from clustered f join (select vid, start_time, max(probability) as top, min_by(label, (-probability, label)) as predicted from (select distinct vid, start_time, end_time, label, probability from pred qualify row_number() over (partition by vid, start_time, end_time, label order by probability desc) = 1) group by vid, start_time) p on f.vid = p.vid and f.start_time = p.start_time join (select fid, case when labels <> 'none' then string_split(labels, '_')[1] end as hard_label from labeled) l on f.fid = l.fid"


def hard(t):
    """fid with the first label of its window, null without one."""
    return labeled(t).select("fid", F.when(F.col("labels") != "none", F.element_at(L.pieces(F.col("labels")), 1)).alias("hard_label"))


def tops(t):
    best = SE.predictions_pivoted(t.pred, 1).select("vid", "start_time", F.element_at(F.array_sort(F.transform("predictions", lambda p: F.struct((-p["probability"]).alias("p"), p["label"].alias("label")))), 1).alias("b"))
    return t.clustered.select("fid", "vid", "start_time", "cluster").join(best.select("vid", "start_time", (-F.col("b.p")).alias("top"), F.col("b.label").alias("predicted")), ["vid", "start_time"]).join(hard(t), "fid")


@query("lb04_wrong_cluster", "clustered pred labeled", f"select cluster from ({TOPS}) group by cluster having count(hard_label) > 0 and count(hard_label) < count(*) order by sum((hard_label <> predicted)::int) desc, cluster limit 1")
def _(t):
    return D.wrong_cluster(tops(t))


@query("lb04_doubtful_cluster", "clustered pred labeled", f"select cluster from ({TOPS}) group by cluster having count(hard_label) < count(*) order by avg(top), cluster limit 1")
def _(t):
    return D.doubtful_cluster(tops(t))


@query("lb05_doubtful_elements", "clustered pred labeled", f"select cluster, min_by(fid, (top, fid)) as fid from ({TOPS}) where hard_label is null group by cluster")
def _(t):
    return D.doubtful_element(tops(t))


LEARNED = "select f.fid, feature[1]::double as x, feature[2]::double as y, case when labels <> 'none' then string_split(labels, '_')[1] end as label from feat f join labeled l on f.fid = l.fid"


def learned(t):
    """Two places of each vector with the window's first label."""
    return t.feat.select("fid", F.slice("feature", 1, 2).alias("feature")).join(hard(t).withColumnRenamed("hard_label", "label"), "fid")


@query("lb02_quadratic", "feat labeled", f"""with r as ({LEARNED}),
    m as (select label, count(*) as n, avg(x) as mx, avg(y) as my, 0.9 * var_samp(x) + 0.1 as a, 0.9 * covar_samp(x, y) as b, 0.9 * var_samp(y) + 0.1 as c from r where label is not null group by label),
    s as (select fid, m.label, -0.5 * ((c * pow(x - mx, 2) - 2 * b * (x - mx) * (y - my) + a * pow(y - my, 2)) / (a * c - b * b) + ln(a * c - b * b)) + ln(n / sum(n) over (partition by fid)) as s from r cross join m)
    select fid, label, round(exp(s) / sum(exp(s)) over (partition by fid), 6) as probability from s""")
def _(t):
    rows = learned(t)
    model = D.Quadratic.fit(rows, 0.1)
    out = D.probabilities(rows, model).select("fid", F.explode(F.arrays_zip(F.array(*map(F.lit, model.classes)).alias("label"), "probabilities")).alias("p"))
    return out.select("fid", "p.label", F.round("p.probabilities", 6).alias("probability"))


@query("lb04_linear", "feat labeled", f"""with r as ({LEARNED}), k as (select * from r where label is not null),
    m as (select label, count(*) as n, avg(x) as mx, avg(y) as my from k group by label),
    w as (select sum(pow(x - mx, 2)) / d as a, sum((x - mx) * (y - my)) / d as b, sum(pow(y - my, 2)) / d as c from k join m on k.label = m.label, (select (sum(n) - count(*))::double as d from m) group by d),
    s as (select fid, m.label, (c * x * mx - b * (x * my + y * mx) + a * y * my - 0.5 * (c * mx * mx - 2 * b * mx * my + a * my * my)) / (a * c - b * b) + ln(n / sum(n) over (partition by fid)) as s from r cross join m cross join w)
    select fid, label, round(exp(s) / sum(exp(s)) over (partition by fid), 6) as probability from s""")
def _(t):
    rows = learned(t)
    model = D.Linear.fit(rows, tolerance=1e-9)
    out = D.probabilities(rows, model).select("fid", F.explode(F.arrays_zip(F.array(*map(F.lit, model.classes)).alias("label"), "probabilities")).alias("p"))
    return out.select("fid", "p.label", F.round("p.probabilities", 6).alias("probability"))


CLEANED = f"""with c as (select f.*, p.p from ({CLUSTERED}) f join (select vid, start_time, max(case when label = 'click' then probability end) as p from pred group by vid, start_time) p on f.vid = p.vid and f.start_time = p.start_time),
    b as (select *, coalesce(hard_label, case when fid % 3 = 0 then 'click' when fid % 3 = 1 then 'view' end) as label from c),
    a as (select cluster, avg(p) as p, count(hard_label) as hard from b group by cluster), v as (select cluster, label, count(*) as n from b group by cluster, label),
    m as (select cluster, label as mode from v qualify row_number() over (partition by cluster order by n desc, label is not null, label) = 1),
    k as (select a.cluster, case when p >= 1 - p then 'click' else 'other' end as class from a join m on a.cluster = m.cluster where greatest(p, 1 - p) >= 0.797 and (hard = 0 or case when p >= 1 - p then 'click' else 'other' end is distinct from mode))
    select fid, case when hard_label is null and class is not null then class else label end as label from b left join k on b.cluster = k.cluster"""


@query("lb08_cleaned", "clustered labeled pred", CLEANED)
def _(t):
    p = t.pred.where("label = 'click'").groupBy("vid", "start_time").agg(F.max("probability").alias("p"))
    rows = marked(t).join(p, ["vid", "start_time"]).withColumn("label", F.coalesce("hard_label", F.when(F.col("fid") % 3 == 0, "click").when(F.col("fid") % 3 == 1, "view")))
    out, _ = D.cleaned(rows.select("fid", "cluster", "hard_label", "label", F.array("p", 1 - F.col("p")).alias("probabilities")), ["click", "other"], least=0.797)
    return out.select("fid", "label")


@query("lb04_mixture")
def _(t):
    own = D.mixture(t.feat, 4, dims=3, rounds=20).join(hard(t), "fid")
    return D.mixed_labels(own).select("fid", "cluster", F.round("top", 6).alias("top"), "label", F.round("weight", 6).alias("weight"))


@query("lb08_discriminant_round")
def _(t):
    rows = t.clustered.select("fid", "feature", "cluster").join(hard(t), "fid").withColumn("label", F.lit(None).cast("string"))
    out, _ = D.discriminant_round(rows, 100)
    return out.select("fid", "cluster", "label")


@query("ml04_network")
def _(t):
    from ..operators import network as N

    rows = LB.with_columns_of(labeled(t), t.feat).where("labels <> 'none'")
    return N.infer_network(N.fit_network(rows, rounds=5), t.feat, 9)
