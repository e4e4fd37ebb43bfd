"""Operators that SQL can't express, against brute force on small tables."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinolake import schemas
from kinolake.functions.intervals import interval_join
from kinolake.operators import features as FE
from kinolake.operators import models as M
from kinolake.operators import propagate as P
from kinolake.operators import select as SL
from kinolake.operators import store as ST
from kinolake.sources import videos as VI
from kinolake.streaming import labels as STR

SPAN = "vid long, start_time double, end_time double"


def spans(rng, n, vids=4, repeat=True):
    rows = []
    for _ in range(n):
        s = rng.uniform(0, 100)
        rows.append((rng.randrange(vids) if rng.random() > 0.05 else None, s if rng.random() > 0.05 else None, s + rng.choice([0.0, 1.0, 7.5, 40.0])))
    return rows + rows[: n // 4] if repeat else rows


@pytest.mark.parametrize("overlap", ["full", "partial", "strict"])
def test_bucketed_joins_equal_plain_ones(spark, overlap):
    """Rows that repeat, without a vid or without times stay as often as in the plain form."""
    rng = random.Random(5)
    left, right = spark.createDataFrame(spans(rng, 60), SPAN), spark.createDataFrame(spans(rng, 60), SPAN)
    for how in ("inner", "left", "left_semi"):
        plain = sorted(map(repr, interval_join(left, right, overlap, how).collect()))
        for bucket in (3.0, 1000.0):
            got = interval_join(left, right, overlap, how, bucket)
            assert sorted(map(repr, got.collect())) == plain, (how, bucket)


def test_dense_ids_are_the_same_in_every_use(spark):
    """Both uses see one numbering, with adaptive plans and ties."""
    rows = spark.range(3000).select((F.rand() * 50).cast("int").alias("x"), F.rand().alias("y"))
    out = ST.numbered(rows, "n", 0, ["x"])
    one, two = out.collect(), out.filter("n % 2 = 0").union(out.filter("n % 2 = 1")).collect()
    assert sorted(r["n"] for r in one) == sorted(r["n"] for r in two) == list(range(1, 3001))
    assert {(r["n"], r["y"]) for r in one} == {(r["n"], r["y"]) for r in two}
    assert [r["x"] for r in sorted(one, key=lambda r: r["n"])] == sorted(r["x"] for r in one)
    assert ST.numbered(rows.limit(0), "n", 0, ["x"]).count() == 0


def points(rng, n, dims=2, blobs=((0.0, 0.0),)):
    return [(i, i % 3, float(i), i + 1.0, [c + rng.gauss(0, 1) for c in blobs[i % len(blobs)]][:dims]) for i in range(n)]


def dist(a, b):
    return math.dist(a, b)


def test_coreset_is_greedy_k_centre(spark):
    rows = points(random.Random(1), 40)
    f = spark.createDataFrame(rows, schemas.FEATURES)
    vec = {r[0]: [float(np.float32(x)) for x in r[4]] for r in rows}
    got = {r["fid"] for r in SL.coreset(f, 5, f.where("fid in (3, 7)")).collect()}
    taken, want = [3, 7], set()
    for _ in range(5):
        best = max((i for i in vec if i not in taken), key=lambda i: (min(dist(vec[i], vec[t]) for t in taken), -i))
        taken.append(best)
        want.add(best)
    assert got == want


def test_medoids_lie_nearest_to_the_centres(spark):
    blobs = ((0.0, 0.0), (100.0, 0.0), (0.0, 100.0))
    rows = [r for r in points(random.Random(2), 36, blobs=blobs) if r[0] % 3 or r[0] < 24]
    f = spark.createDataFrame(rows, schemas.FEATURES)
    got = [r["fid"] for r in SL.cluster_medoids(f, f.limit(0), 3).collect()]
    groups = {b: [r for r in rows if r[0] % 3 == b] for b in range(3)}
    want = {}
    for b, own in groups.items():
        centre = np.mean([r[4] for r in own], axis=0)
        want[b] = min(own, key=lambda r: dist(r[4], centre))[0]
    assert set(got) == set(want.values())
    assert [len(groups[g % 3]) for g in got] == sorted((len(g) for g in groups.values()), reverse=True)


def test_clips_apart_as_a_greedy_loop(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(3), s, s + rng.choice([1.0, 5.0]), rng.random()) for s in (rng.uniform(0, 200) for _ in range(120))]
    ranked = spark.createDataFrame(rows, SPAN + ", rank_value double")
    for at_once in (7, 4096):
        got = SL.apart(ranked, 12, 20.0, at_once=at_once)
        taken = []
        for v, s, e, _ in sorted(rows, key=lambda r: (r[3], r[0], r[1], r[2])):
            grow = max(0.0, (20.0 - (e - s)) / 2)
            a, b = s - grow, e + grow
            if all(v != w or not (c < a < d or c < b < d or (a <= c and d <= b)) for w, c, d, _ in taken) and len(taken) < 12:
                taken.append((v, a, b, (v, s, e)))
        assert got == [t[3] for t in taken]


def test_far_pairs(spark):
    rng = random.Random(4)
    for dims in (1, 3):
        rows = [(i, i % 4, None if i % 5 else "x", [rng.uniform(-9, 9) for _ in range(dims)]) for i in range(80)]
        df = spark.createDataFrame(rows, "fid long, cluster int, hard_label string, feature array<double>").withColumn("distance", F.sqrt(F.aggregate("feature", F.lit(0.0), lambda a, x: a + x * x)))
        free = {r[0]: r for r in rows if r[2] is None}
        for r in P.far_pair(df).collect():
            own = [x[3] for x in free.values() if x[1] == r["cluster"]]
            most = max(dist(a, b) for a, b in itertools.combinations(own, 2))
            assert math.isclose(r["apart"], dist(free[r["one"]][3], free[r["other"]][3]), rel_tol=1e-9)
            assert r["apart"] >= (most if dims == 1 else most / 2) - 1e-9


def test_reclustering_splits_one_cluster_only(spark):
    rng = random.Random(6)
    rows = [(i, 1 if i < 10 else 0, None, [50.0 * (i % 2) + rng.random(), rng.random()]) for i in range(40)]
    df = spark.createDataFrame(rows, "fid long, cluster int, hard_label string, feature array<double>")
    got = {r["fid"]: r["cluster"] for r in P.reclustered(df, 0, 2, 7, dims=2).collect()}
    assert all(got[i] == 1 for i in range(10)) and set(got.values()) == {1, 7, 8}
    assert len({got[i] for i in range(10, 40, 2)}) == len({got[i] for i in range(11, 40, 2)}) == 1 and got[10] != got[11]


def test_random_stretches_are_whole_and_fill_the_budget(spark):
    rows = spark.range(400).selectExpr("id as aid", "id % 5 as vid", "double(id) as start_time")
    got = P.random_stretches(rows, 60, 30.0).collect()
    cells = {(r["vid"], r["start_time"] // 30) for r in got}
    assert len(got) == sum(((i % 5), i // 30) in cells for i in range(400))
    assert 60 <= len(got) < 60 + 6


def test_anderson_darling_is_standardised_over_permutations():
    """Under the null hypothesis, and without ties, for which the variance holds, its mean is 0 and its deviation 1; unlike samples are far out."""
    rng = np.random.default_rng(7)
    pool, values = np.arange(90), []
    for _ in range(1500):
        rng.shuffle(pool)
        values.append(SL.ad_statistic(np.bincount(pool[:50], minlength=90).tolist(), np.bincount(pool[50:], minlength=90).tolist()))
    assert abs(np.mean(values)) < 0.12 and abs(np.std(values) - 1) < 0.15
    share = np.mean([SL.ad_pvalue(v) <= 0.05 for v in values])
    assert 0.02 < share < 0.09
    assert SL.ad_uniform({"a": 50.0, "b": 52.0, "c": 47.0}) and not SL.ad_uniform({"a": 400.0, "b": 3.0, "c": 2.0})
    assert SL.ad_uniform({"a": 9.0}) and SL.ad_uniform({})
    assert SL.binomial_uniform({"a": 5.0, "b": 5.0}, 0.001, 2.0) and not SL.binomial_uniform({"a": 500.0, "b": 0.01}, 0.001, 2.0)
    for counts in ({"a": 50.0, "b": 52.0, "c": 46.2}, {"a": 1.0, "b": 7.0}):
        ranks = [(i + 1) / len(counts) for i, c in enumerate(counts.values()) for _ in range(math.ceil(c))]
        n = len(ranks)
        assert math.isclose(SL.cvm_statistic(counts), 1 / (12 * n) + sum(((2 * r - 1) / (2 * n) - u) ** 2 for r, u in enumerate(ranks, 1)))
    assert SL.cvm_uniform({"a": 3.0, "b": 3.0}) and not SL.cvm_uniform({"a": 4000.0, "b": 3.0, "c": 2.0})


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(8)
    rows = [(i, i % 12, float(i), i + 1.0, "ab"[i % 2], [2.0 * (i % 2) + rng.gauss(0, 1), rng.gauss(0, 1)]) for i in range(120)]
    return spark.createDataFrame(rows, f"fid long, {SPAN}, labels string, feature array<double>").cache()


def mean_f1(scored, threshold):
    out = []
    for label in {r["label"] for r in scored}:
        own = [r for r in scored if r["label"] == label]
        tp = sum(r["probability"] >= threshold and r["y"] for r in own)
        wrong = sum((r["probability"] >= threshold) != bool(r["y"]) for r in own)
        out.append(2 * tp / (2 * tp + wrong) if tp or wrong else 0.0)
    return sum(out) / len(out)


def test_tuned_threshold_is_the_best_on_held_out_videos(judged):
    model, classes, threshold = M.fit_tuned(judged, max_iter=5)
    test = M.folds(judged, 5).where("fold = 0").drop("fold")
    scored = M.truth(M.infer(model, classes, test.drop("labels"), 0), test).collect()
    assert threshold == max(M.THRESHOLDS, key=lambda t: (round(mean_f1(scored, t), 12), -t))


def test_folds_keep_videos_together_and_medians_are_taken(judged, spark):
    fold = {}
    for r in M.folds(judged, 3).collect():
        fold.setdefault(r["vid"], set()).add(r["fold"])
    assert all(len(x) == 1 for x in fold.values()) and set.union(*fold.values()) == {0, 1, 2}
    assert M.medians(spark.createDataFrame([(1.0, 5.0), (3.0, 4.0), (2.0, 9.0)], "a double, b double")).first() == (2.0, 5.0)
    three = judged.withColumn("labels", F.expr("concat('c', fid % 4)"))
    row = M.cross_validated(three, 3).first()
    assert all(0 <= row[c] <= 1 for c in row.asDict()) and M.cross_validated(judged, 3) is None


def test_when_a_model_has_to_be_trained(spark):
    times = ["2024-01-01", "2024-01-03"]
    ann = spark.createDataFrame([(i, times[i % 2]) for i in range(20)], "aid long, t string").select("aid", F.to_timestamp("t").alias("label_time"))
    model = lambda when: spark.createDataFrame([("r3d", when)], "feature_name string, t string").select("feature_name", F.to_timestamp("t").alias("creation_time"))
    for when, feature, stale, want in (("2024-01-02", "r3d", True, False), ("2024-01-02", "r3d", False, True), ("2024-01-04", "r3d", False, False), ("2024-01-04", "clip", True, True)):
        assert M.needs_training(model(when), ann, feature, allow_stale=stale) == want
    assert not M.needs_training(model("2024-01-02"), ann.limit(3), "clip")


def test_other_classifiers_and_saved_models(judged, tmp_path):
    for fit in (lambda rows: M.fit_mlp(rows, hidden=(4,), max_iter=30), M.fit_cross_validated):
        model, classes = fit(judged)
        scored = M.truth(M.infer(model, classes, judged.drop("labels"), 0), judged).collect()
        assert classes == ["a", "b"] and len(scored) == 240 and mean_f1(scored, 0.5) > 0.6
    M.save_model(model, classes, str(tmp_path / "m"))
    saved, own = M.evaluated(judged, str(tmp_path / "m")).first(), M.metrics(M.truth(M.infer(model, classes, judged.drop("labels"), 0), judged)).first()
    assert saved.asDict() == pytest.approx(own.asDict())


def test_predictions_are_made_for_videos_without_any(judged, spark):
    stored = spark.createDataFrame([(1, 0, 0.0, 1.0, "a", 0.5), (1, 0, 900.0, 901.0, "a", 0.5), (2, 1, 1.0, 2.0, "a", 0.5)], f"mid int, {SPAN}, label string, probability double")
    run = lambda rows: rows.select(F.lit(1).alias("mid"), "vid", "start_time", "end_time", F.lit("a").alias("label"), F.lit(0.1).alias("probability"))
    got = M.predictions_of_all(judged, stored, 1, run).collect()
    assert sum(r["vid"] == 0 for r in got) == 1 and {r["vid"] for r in got} == set(range(12)) and len(got) == 111


def test_labels_that_arrive_trigger_training_once(spark, tmp_path):
    spark.range(5).selectExpr("id as aid").write.parquet(str(tmp_path / "in"))
    seen = []
    for _ in range(2):
        stream = spark.readStream.schema("aid long").parquet(str(tmp_path / "in"))
        STR.on_labels(stream, lambda batch, i: seen.append((i, batch.count())), str(tmp_path / "cp")).awaitTermination()
    assert seen == [(0, 5)]


def test_a_folder_with_callables(spark, tmp_path):
    for name in ("x_cat.mp4", "y.mp4", "z_dog.mp4", "note.txt"):
        (tmp_path / name).write_bytes(b"12345")
    label = lambda path, content: F.nullif(F.regexp_extract(path, r"_(\w+)\.mp4$", 1), F.lit(""))
    videos, labels = VI.ingested(spark, str(tmp_path), "/thumbs", duration=lambda path, content: F.length(content).cast("double"), label=label)
    assert videos.count() == 3 and {r["vduration"] for r in videos.collect()} == {5.0}
    assert sorted((r["vpath"].rsplit("/", 1)[1], r["start_time"], r["end_time"], r["label"]) for r in labels.collect()) == [("x_cat.mp4", 0.0, 5.0, "cat"), ("z_dog.mp4", 0.0, 5.0, "dog")]


def test_eager_sample_leaves_out_what_is_there_or_on_its_way(spark):
    vids = lambda *x: spark.createDataFrame([(i,) for i in x], "vid long")
    got = [r["vid"] for r in FE.eager_sample(vids(*range(30)), vids(*range(10)), 5, in_progress=vids(*range(10, 20))).collect()]
    assert len(got) == 5 and set(got) <= set(range(20, 30)) and FE.eager_sample(vids(1), vids(1)).count() == 0
