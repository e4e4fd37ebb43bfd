"""Queries of labelling strategies and what is labelled next (ML15, ML16, LB02, LB04), of frames (VX06) and of a chooser by chance (EX10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extract as X
from ..operators import propagate as P
from ..operators import strategies as S
from .choice_queries import CLUSTERED, TOPS, labeled, marked, store, tops
from .registry import query

# strata are composite labels of windows
QUOTAS = """q as (select *, size * c // n as low, size * c % n as rest from (select labels, count(*) as c, sum(count(*)) over () as n, ceil(0.07::double * sum(count(*)) over ())::bigint as size from labeled group by labels)),
    k as (select labels, low + (row_number() over (order by rest desc, labels) <= size - sum(low) over ())::int as quota from q)"""


@query("ml15_random_strata", "labeled", f"""with {QUOTAS}, r as (select fid, labels, row_number() over (partition by labels order by md5(concat('3:', fid)), fid) as place from labeled)
    select r.fid from r join k on r.labels = k.labels where place <= quota""")
def _(t):
    return S.random_budget(labeled(t), 0.07, "labels", seed=3)


# fewer rows to take than strata, as each row is one: no strata, in tables of any size
@query("ml15_random_few", "labeled", """select fid from labeled order by md5(concat('0:', fid)), fid limit (select ceil(0.002::double * count(*))::bigint from labeled)""")
def _(t):
    return S.random_budget(labeled(t), 0.002, "fid")


@query("ml16_random_budget", "feat", "select fid from feat order by md5(concat('5:', fid)), fid limit (select ceil(0.13::double * count(*))::bigint from feat)")
def _(t):
    return S.labelled_by("random", t.feat, 0.13, seed=5)


@query("ml16_temporal_consecutive", "feat", "select fid from feat order by start_time, fid limit (select ceil(0.13::double * count(*))::bigint from feat)")
def _(t):
    return S.labelled_by("temporalconsecutive", t.feat, 0.13)


# a coreset of 20 rows that holds the ten a budget of ten took
@query("ml16_grown_coreset")
def _(t):
    n = t.feat.count()
    first = S.grown_coreset(t.feat, 10 / n, seed=2)
    return S.grown_coreset(t.feat, 20 / n, first, seed=2)


# users in groups of ten labelled a window for each event of theirs, by a strategy for each type; experiments with a purchase of more than 200 are done
PROGRESS = """select user_id % 10 as experiment, event_type as strategy, list(event_id * 13 % (select count(*) from feat)) as fids from events group by all"""


@query("ml15_label_reader", "labeled", f"""with p as ({PROGRESS}), d as (select distinct user_id % 10 as experiment, event_type as strategy from events where value > 200),
    u as (select distinct experiment, strategy, unnest(fids) as fid from p)
    select u.experiment, u.strategy, l.labels, count(*) as n from u join labeled l on u.fid = l.fid where (u.experiment, u.strategy) not in (select (experiment, strategy) from d) group by all""")
def _(t):
    key = ("experiment", "strategy")
    n = F.broadcast(t.feat.agg(F.count("*").alias("_n")))  # one row
    own = t.events.crossJoin(n).select((F.col("user_id") % 10).alias("experiment"), F.col("event_type").alias("strategy"), (F.col("event_id") * 13 % F.col("_n")).alias("fid"), "value")
    progress = own.groupBy(*key).agg(F.collect_list("fid").alias("fids"))
    left = S.experiments_left(progress, own.where("value > 200"), key)
    return S.read_labels(left, labeled(t), key).groupBy(*key, "labels").agg(F.count("*").alias("n"))


# a file of places for each user: three times the hundredths of its events' values
@query("ml15_indexed_samples", "feat", """with i as (select distinct concat('u', user_id) as file, round(value * 100)::bigint * 3 as place from events),
    k as (select nlabels, max(file) as file from (select file, count(*) as nlabels from i group by file) group by nlabels), p as (select fid, row_number() over (order by fid) - 1 as place from feat)
    select k.nlabels, round(k.nlabels / (select count(*) from feat), 2) as budget, p.fid from k join i on k.file = i.file join p on p.place = i.place""")
def _(t):
    indices = t.cents.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file"), (F.col("c") * 3).alias("place"))
    return S.indexed_samples(indices, t.feat)


@query("lb02_next_uncertain", "clustered pred labeled", f"select fid from ({TOPS}) where hard_label is null order by top, fid limit 1")
def _(t):
    rows = tops(t)
    return S.next_element(rows, "uncertainty", rows, least=0.0)


@query("lb02_next_coreset", "clustered labeled", f"""with c as ({CLUSTERED}) select u.fid from c u join c l on u.hard_label is null and l.hard_label is not null
    group by u.fid order by min(list_distance(u.feature::double[], l.feature::double[])) desc, u.fid limit 1""")
def _(t):
    return S.next_element(marked(t), "coreset", least=0.0)


# while no more than half is labelled, by chance; the seed moves on with what is labelled
@query("lb02_next_by_chance", "clustered labeled", f"""with c as ({CLUSTERED}) select fid from c where hard_label is null
    order by md5(concat((select count(hard_label) + 4 from c), ':', fid)), fid limit 1""")
def _(t):
    return S.next_element(marked(t), "coreset", seed=4, least=1.0)


@query("lb04_disputed_cluster", "clustered labeled", f"""select cluster from ({CLUSTERED}) group by cluster having count(hard_label) < count(*)
    order by count(distinct hard_label) = 0 desc, case when count(distinct hard_label) = 0 then count(*) else count(distinct hard_label) end desc, cluster limit 1""")
def _(t):
    return P.ranked_cluster(P.cluster_stats(marked(t)), "labels")


# windows as frames: numbered by fid, with the vector as pixels
@query("vx06_sampled_frames", "feat", "select vid, fid as frame_no from (select *, row_number() over (partition by vid order by fid) - 1 as n from feat) where n % 4 = 0")
def _(t):
    return X.sampled(t.feat.select("vid", F.col("fid").alias("frame_no")), 4)


@query("vx06_middle_frames", "feat", "select vid, fid as frame_no from (select *, row_number() over (partition by vid order by fid) - 1 as n from feat) where n % 4 = 2")
def _(t):
    return X.sampled(t.feat.select("vid", F.col("fid").alias("frame_no")), 4, first=False)


@query("vx06_median_frames", "feat", """select vid, list(x order by i) as pixels from (select vid, i, round(median(x), 9) as x
    from (select vid, unnest(feature)::double as x, generate_subscripts(feature, 1) as i from feat) group by vid, i) group by vid""")
def _(t):
    frames = X.median_frame(t.feat.select("vid", F.col("feature").alias("pixels")))
    return frames.select("vid", F.transform("pixels", lambda x: F.round(x, 9)).alias("pixels"))


@query("ex10_random_if_uniform_margin")
def _(t):
    return store(t).explore("randomifuniformcm_cvm_pval0.001", 3, 60.0, "r3d", step=20)
