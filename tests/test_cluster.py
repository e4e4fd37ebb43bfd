"""Average linkage and medoids against brute force."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinolake.operators import cluster as C
from kinolake.operators import explore as EX
from kinolake.operators import select as SL

SCHEMA = "fid long, vid long, start_time double, end_time double, feature array<float>"


def points(n, seed=1, blobs=7, dims=3):
    rng = random.Random(seed)
    centres = [[rng.uniform(-9, 9) for _ in range(dims)] for _ in range(blobs)]
    return [(3 * i, i % 4, float(i), i + 1.0, [c + rng.gauss(0, 1) for c in centres[i % blobs]]) for i in range(n)]


def linkage(vectors, k):
    """Average linkage by looking at all pairs of clusters before every merge."""
    d = [[math.dist(a, b) for b in vectors] for a in vectors]
    groups = [[i] for i in range(len(vectors))]
    while len(groups) > k:
        a, b = min(itertools.combinations(range(len(groups)), 2), key=lambda p: sum(d[i][j] for i in groups[p[0]] for j in groups[p[1]]) / (len(groups[p[0]]) * len(groups[p[1]])))
        groups[a] += groups.pop(b)
    return {frozenset(g) for g in groups}


def parts(labels):
    out = {}
    for i, c in enumerate(labels):
        out.setdefault(c, set()).add(i)
    return {frozenset(g) for g in out.values()}


@pytest.mark.parametrize("k", [1, 4, 12, 60])
def test_local_linkage_against_brute_force(spark, k):
    x = np.array([p[4] for p in points(60)])
    assert parts(C.cut(C.dendrogram(x, spark), 60, k)) == linkage(x.tolist(), k)


def test_distributed_rounds_give_the_same_tree(spark):
    x = np.array([p[4] for p in points(500, seed=2, blobs=20)])
    local, spread = C.dendrogram(x, spark), C.dendrogram(x, spark, small=40)
    heights = lambda m: np.sort([h for _, _, h in m])
    assert np.allclose(heights(local), heights(spread), rtol=1e-12)
    for k in (1, 9, 50, 300):
        assert parts(C.cut(local, 500, k)) == parts(C.cut(spread, 500, k))
    assert parts(C.cut(spread, 500, 480)) == linkage_fast(x, 480)


def linkage_fast(x, k):
    """Brute force with a matrix of sums."""
    s = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    groups = [{i} for i in range(len(x))]
    size = np.ones(len(x))
    while len(groups) > k:
        m = s / np.outer(size, size)
        np.fill_diagonal(m, np.inf)
        a, b = sorted(np.unravel_index(m.argmin(), m.shape))
        groups[a] |= groups.pop(b)
        s[a] += s[b]
        s[:, a] += s[:, b]
        s = np.delete(np.delete(s, b, 0), b, 1)
        size[a] += size[b]
        size = np.delete(size, b)
    return {frozenset(map(int, g)) for g in groups}


def test_500_points_equal_brute_force(spark):
    rows = points(500, seed=4, blobs=30)
    got = C.average_linkage(spark.createDataFrame(rows, SCHEMA), small=64).select("fid", "cluster").collect()
    x = np.array([np.float32(p[4]) for p in rows], np.float64)
    assert len({r["cluster"] for r in got}) == 50
    at = {r["fid"]: r["cluster"] for r in got}
    assert parts([at[p[0]] for p in rows]) == linkage_fast(x, 50)


def test_ties_and_equal_points(spark):
    same = np.zeros((30, 2))
    merges = C.dendrogram(same, spark, small=4)
    assert len(merges) == 29 and {h for _, _, h in merges} == {0.0}
    grid = np.array([[i, j] for i in range(6) for j in range(6)], float)
    for small in (4, 1024):
        assert len(parts(C.cut(C.dendrogram(grid, spark, small=small), 36, 5))) == 5


def test_beyond_the_sample_rows_go_to_the_nearest_mean(spark):
    rows = points(400, seed=6, blobs=5)
    got = {r["fid"]: r["cluster"] for r in C.average_linkage(spark.createDataFrame(rows, SCHEMA), average=80, most=200).collect()}
    x = np.array([np.float32(p[4]) for p in rows], np.float64)
    chosen = sorted(sorted(range(400), key=lambda i: hashlib.md5(f"0:{3 * i}".encode()).hexdigest())[:200])
    label = C.cut(C.dendrogram(x[chosen], spark), 200, 5)
    means = np.array([x[np.array(chosen)[label == c]].mean(axis=0) for c in range(5)])
    assert got == {3 * i: int(((means - x[i]) ** 2).sum(axis=1).argmin()) for i in range(400)}


@pytest.mark.parametrize("rows", [[], [(1, 1, 0.0, 1.0, [1.0, 2.0])], [(1, 1, 0.0, 1.0, None), (2, 1, 0.0, 1.0, [0.0]), (3, 1, 0.0, 1.0, [0.0])]])
def test_few_rows(spark, rows):
    got = C.average_linkage(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [r["cluster"] for r in got] == [0 for r in rows if r[4] is not None]


def alternated(x, start):
    """Medoids by turns, with whole matrices."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    at = list(start)
    while True:
        own = d[:, at].argmin(axis=1)
        new = []
        for c, m in enumerate(at):
            members = np.flatnonzero(own == c)
            cost = d[np.ix_(members, members)].sum(axis=1)
            best = members[cost.argmin()]
            new.append(best if cost.min() < d[members, m].sum() * (1 - 1e-12) else m)
        if new == at:
            return at, d[np.arange(len(x)), np.array(at)[own]].sum()
        at = new


@pytest.mark.parametrize("block", [2048, 9])
def test_medoids_against_brute_force(spark, block):
    rows = points(120, seed=3)
    df = spark.createDataFrame(rows, SCHEMA)
    x = np.array([np.float32(p[4]) for p in rows], np.float64)
    start = [5, 6, 40, 77]
    own, fids, cost = C.k_medoids(df, 4, block=block, start=[(3 * i, x[i].tolist()) for i in start])
    want, least = alternated(x, start)
    assert fids == [3 * i for i in want] and cost == pytest.approx(least, rel=1e-9)
    assert own.count() == 120 and own.where(F.col("distance") == 0).count() == 4


def test_first_medoids_find_the_blobs(spark):
    rng = random.Random(5)
    rows = [(i, 0, float(i), i + 1.0, [100.0 * (i % 6) + rng.random(), rng.random()]) for i in range(180)]
    own, fids, cost = C.k_medoids(spark.createDataFrame(rows, SCHEMA), 6, seed=2)
    assert sorted(f % 6 for f in fids) == list(range(6)) and cost < 180
    assert {r["n"] for r in own.groupBy("cluster").agg(F.count("*").alias("n")).collect()} == {30}


def test_more_medoids_than_places(spark):
    rows = [(i, 0, float(i), i + 1.0, [float(i % 2)]) for i in range(6)]
    _, fids, cost = C.k_medoids(spark.createDataFrame(rows, SCHEMA), 4)
    assert len(set(fids)) == 4 and cost == 0
    assert C.k_medoids(spark.createDataFrame([], SCHEMA), 4)[1] == []


def test_a_budget_of_stretches(spark):
    rng = random.Random(7)
    rows = [(i, i // 60, float(i % 60), i % 60 + 1.0, [rng.gauss(0, 1), rng.gauss(0, 1)]) for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = C.medoid_budget(df, 60, seconds=6.0)
    n = got.count()
    assert abs(n - 60) <= 6 and got.select("fid").distinct().count() == n
    _, fids, _ = C.k_medoids(df, 3)
    want = {r[0] for r in rows for m in fids if r[1] == m // 60 and r[2] >= m % 60 and r[3] <= m % 60 + 6.0}
    assert {r["fid"] for r in C.medoid_stretches(df, 3, 6.0).collect()} == want


def test_small_budgets(spark):
    df = spark.createDataFrame(points(20), SCHEMA)
    assert C.medoid_budget(df, 1, seconds=1.0).count() == 1
    assert abs(C.medoid_budget(df, 5, seconds=1.0).count() - 5) <= 1


def test_cluster_explorer_takes_medoids(spark):
    rows = points(90, seed=8, blobs=3)
    df = spark.createDataFrame(rows, SCHEMA)
    _, fids, _ = C.k_medoids(df, 3)
    none = df.select("fid").limit(0)
    assert {r["fid"] for r in SL.cluster_medoids(df, none, 3, most_rows=90).collect()} == set(fids)
    left = {r["fid"] for r in SL.cluster_medoids(df, df.where(F.col("fid").isin(fids)).select("fid"), 3, most_rows=90).collect()}
    assert len(left) == 3 and not left & set(fids)
    assert SL.cluster_medoids(df, none, 3, most_rows=89).count() == 3


def test_explorer_makes_a_tenth_as_many_clusters(spark):
    rows = points(200, seed=9)
    assert EX.clusters(spark.createDataFrame(rows, SCHEMA)).select("cluster").distinct().count() == 20


def test_sums_computed_from_points_give_the_same_tree(spark):
    """No matrix of the whole sample is stored; a blob of 300 points is cut into pieces."""
    x = np.array([p[4] for p in points(300, seed=3, blobs=1)] + [p[4] for p in points(300, seed=5, blobs=60)] + [[5.0, 5.0, 5.0]] * 3)
    local = C.dendrogram(x, spark)
    spread = C.dendrogram(x, spark, small=60)
    assert np.allclose(np.sort([h for _, _, h in local]), np.sort([h for _, _, h in spread]), rtol=1e-10, atol=1e-12)
    for k in (1, 9, 60, 400, 603):
        assert parts(C.cut(spread, 603, k)) == parts(C.cut(local, 603, k))
    assert parts(C.cut(C.dendrogram(x, spark, small=60, clusters=200), 603, 200)) == parts(C.cut(local, 603, 200))
    assert not C.dendrogram(x, spark, small=60, clusters=700)


def test_distances_by_products_are_exact_for_close_and_far_points():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(300, 16)), 1e6 + 1e-3 * rng.normal(size=(50, 16))])
    x = np.concatenate([x, x[:40], x[:20] + 1e-9])
    assert np.allclose(C.distances(x, x), C.differences(x, x), rtol=1e-12, atol=0)
    best, d = C.nearest_row(x, x)
    assert (best[350:390] == np.arange(40)).all() and not d[350:390].any()


def test_medoids_of_copies_count_all_of_them(spark):
    """Equal vectors are one row of the pairs, which counts as many times."""
    rows = [(i, 0, 0.0, 1.0, [float(v), 0.0], 0) for i, v in enumerate([5, 5, 5, 5, 1, 2, 2, 9])]
    df = spark.createDataFrame(rows, SCHEMA.replace("array<float>", "array<double>") + ", cluster int")
    for block in (2, 100):
        assert [(r["fid"], r["cost"]) for r in C.better_medoids(df, block).collect()] == [(0, 14.0)]


def linkage_of_copies(x, w, k):
    """Brute force with a matrix of sums, each point counting as many times as w says."""
    s = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) * np.outer(w, w)
    groups, size = [{i} for i in range(len(x))], w.astype(float)
    while len(groups) > k:
        m = s / np.outer(size, size)
        np.fill_diagonal(m, np.inf)
        a, b = sorted(np.unravel_index(m.argmin(), m.shape))
        groups[a] |= groups.pop(b)
        s[a] += s[b]
        s[:, a] += s[:, b]
        size[a] += size[b]
        s, size = np.delete(np.delete(s, b, 0), b, 1), np.delete(size, b)
    return {frozenset(map(int, g)) for g in groups}


def copied_rows(spark, n, times):
    """n vectors, the i-th times(i) times; (features, vectors, times)."""
    x = np.array([np.float32(p[4]) for p in points(n, seed=10, blobs=12)], np.float64)
    w = np.array([times(i) for i in range(n)])
    shape = spark.createDataFrame([(i, int(t), v.tolist()) for i, (t, v) in enumerate(zip(w, x, strict=True))], "i long, t int, feature array<float>")
    rows = shape.withColumn("k", F.explode(F.sequence(F.lit(1), "t")))
    return rows.select((F.col("k") * 1000 + F.col("i")).alias("fid"), F.lit(0).cast("long").alias("vid"), F.lit(0.0).alias("start_time"), F.lit(1.0).alias("end_time"), "feature"), x, w


def test_more_than_50_000_rows_are_all_linked(spark):
    """Beyond 50,000 rows the linkage was that of a sample, and the other rows went to the nearest mean."""
    df, x, w = copied_rows(spark, 300, lambda i: 150 + i % 67)
    got = C.average_linkage(df, average=1000).groupBy((F.col("fid") % 1000).alias("i")).agg(F.count_distinct("cluster").alias("n"), F.first("cluster").alias("cluster"), F.count("*").alias("rows")).orderBy("i").collect()
    assert sum(r["rows"] for r in got) == w.sum() > 50_000 and {r["n"] for r in got} == {1}
    assert parts([r["cluster"] for r in got]) == linkage_of_copies(x, w, w.sum() // 1000)


@pytest.mark.parametrize("sent", [0, 1 << 20])
def test_rounds_over_small_blocks_equal_brute_force(spark, monkeypatch, sent):
    """Weights differ, clusters are cut into pieces, blocks meet by pairs of partitions or are sent."""
    monkeypatch.setattr(C, "SENT", sent)
    df, x, w = copied_rows(spark, 90, lambda i: 1 + i % 3)
    got = {r["fid"] % 1000: r["cluster"] for r in C.average_linkage(df, average=18, small=2, block=6).collect()}
    assert parts([got[i] for i in range(90)]) == linkage_of_copies(x, w, 10)


def test_more_clusters_than_vectors(spark):
    df, x, w = copied_rows(spark, 4, lambda i: 10)
    got = C.average_linkage(df, average=5).collect()
    assert len(got) == 40 and {r["cluster"] for r in got} == set(range(8))
    assert all(len({r["fid"] % 1000 for r in got if r["cluster"] == c}) == 1 for c in range(8))


@pytest.mark.parametrize("name", ["clustermargin", "randomifuniformcm_cvm_pval0.001"])
def test_margin_explorers_link_more_than_50_000_rows(spark, monkeypatch, name):
    """Beyond 50,000 rows both took turns over clusters of a sample."""
    every = EX.clusters
    monkeypatch.setattr(EX, "clusters", lambda rows, **kw: every(rows, 1000, **kw))
    df, x, w = copied_rows(spark, 300, lambda i: 150 + i % 67)
    low = "vid long, start_time double, end_time double"
    videos = spark.sql("select vid, '' as vpath, timestamp'2024-01-01' as vstart, 9e4D as vduration, '' as thumbpath from values (0L), (9L) as t(vid)")
    ann = spark.createDataFrame([(1, 9, 0.0, 5000.0, "a"), (2, 9, 0.0, 2.0, "b"), (3, 9, 0.0, 1.0, "c")], f"aid long, {low}, label string").withColumn("label_time", F.lit("2024-01-01").cast("timestamp"))
    models = spark.sql("select 1 as mid, 'r3d' as feature_name, timestamp'2024-01-01' as creation_time, array('a', 'b') as labels, 0.5D as f1_threshold, 9 as ntrain")
    pred = spark.createDataFrame([(1, 0, 0.0, 1.0, "a", 0.6), (1, 0, 0.0, 1.0, "b", 0.4)], f"mid int, {low}, label string, probability double")
    picked = EX.named_explorer(name)(EX.Store(videos, ann, {"r3d": df}, models, pred), 30, 60.0, "r3d", None, 20, 0)
    groups = sorted(linkage_of_copies(x, w, w.sum() // 1000), key=min)
    rows = [(1000 + i, c, 0.8) for c, g in enumerate(groups) for i in g]
    want = SL.cluster_margin(spark.createDataFrame(rows, "fid long, cluster int, uncertainty double"), 30)
    assert sorted(r["fid"] for r in picked.select("fid").collect()) == sorted(r["fid"] for r in want.select("fid").collect())
