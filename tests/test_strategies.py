"""Labelling strategies (ML15, ML16), the next element (LB02) and metrics against brute force, and their edges."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from kinolake.operators import bandit as B
from kinolake.operators import models as M
from kinolake.operators import propagate as P
from kinolake.operators import store as ST
from kinolake.operators import strategies as S

ROWS = "fid long, vid long, start_time double, end_time double, feature array<double>, labels string"


def table(spark, n=90, seed=1, labels=("a", "b", None)):
    rng = np.random.default_rng(seed)
    own = [(i, i % 4, float(rng.integers(40)), 50.0, rng.random(3).tolist(), labels[int(rng.integers(10)) % len(labels)]) for i in range(n)]
    return own, spark.createDataFrame(own, ROWS)


def fids(df):
    return sorted(r["fid"] for r in df.select("fid").collect())


def by_hash(seed, rows):
    return sorted(rows, key=lambda f: (hashlib.md5(f"{seed}:{f}".encode()).hexdigest(), f))


def quotas(groups, share):
    """Largest remainders, ties by name with null first."""
    n, count = len(groups), Counter(groups)
    size = math.ceil(share * n)
    if len(count) > size:
        return None
    out = {g: size * c // n for g, c in count.items()}
    rest = sorted(count, key=lambda g: (-(size * count[g] % n), g is not None, g or ""))
    for g in rest[: size - sum(out.values())]:
        out[g] += 1
    return out


@pytest.mark.parametrize("share", [0.01, 0.1, 0.37, 1.0])
def test_random_budget_takes_each_stratum_its_share(spark, share):
    own, df = table(spark)
    want, q = [], quotas([r[5] for r in own], share)
    for g in set(r[5] for r in own):
        want += by_hash(7, [r[0] for r in own if r[5] == g])[: q[g]] if q else []
    want = want or by_hash(7, [r[0] for r in own])[: math.ceil(share * len(own))]
    assert fids(S.random_budget(df, share, "labels", seed=7)) == sorted(want)


def test_random_budget_of_one_stratum_that_holds_most_rows(spark):
    df = spark.range(5000).selectExpr("id as fid", "if(id < 4900, 'hot', cast(id as string)) as labels")
    got = S.random_budget(df, 0.5, "labels").join(df, "fid").groupBy("labels").count().collect()
    count = {r["labels"]: r["count"] for r in got}
    assert sum(count.values()) == 2500 and count["hot"] == 2450


def test_budgets_of_an_empty_table_are_empty(spark):
    empty = spark.createDataFrame([], ROWS)
    assert fids(S.random_budget(empty, 0.5, "labels")) == fids(S.random_budget(empty, 0.5)) == fids(S.earliest(empty, 0.5)) == []
    assert fids(S.next_element(empty.selectExpr("*", "labels as hard_label"), "coreset")) == []
    assert S.indexed_samples(spark.createDataFrame([("f", 0)], "file string, place long"), empty).count() == 0
    assert P.temporal_sample(empty, 0.5, empty["vid"], "start_time").count() == 0


def test_earliest_rows_with_ties_and_nulls(spark):
    df = spark.createDataFrame([(3, 1.0), (1, 1.0), (2, None), (4, 0.5), (5, 9.0)], "fid long, start_time double")
    assert fids(S.labelled_by("temporalconsecutive", df, 0.6)) == [1, 2, 4]
    assert fids(S.earliest(df, 0.0)) == []


def test_places_in_groups_are_a_window_without_its_task(spark):
    rows = [(i, (i * i) % 3 if i % 7 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "fid long, g long")
    got = {r["fid"]: r["_place"] for r in ST.placed_in(df, df["g"], ["fid"]).collect()}
    seen = defaultdict(int)
    for fid, g in rows:
        seen[g] += 1
        assert got[fid] == seen[g]


def test_grown_coreset_is_greedy_and_keeps_what_it_had(spark):
    own, df = table(spark, 60)
    x = np.array([r[4] for r in own])
    chosen = by_hash(0, range(60))[:1]
    least = np.linalg.norm(x - x[chosen[0]], axis=1)
    steps = {}
    while len(chosen) < 24:
        steps[len(chosen)] = sorted(chosen)
        far = int(np.argmax(least))
        chosen.append(far)
        least = np.minimum(least, np.linalg.norm(x - x[far], axis=1))
    small = S.grown_coreset(df, 0.1)
    assert fids(small) == steps[6]
    assert fids(S.grown_coreset(df, 0.2, small)) == steps[12]
    assert fids(S.grown_coreset(df, 0.05, small)) == steps[6]  # a smaller budget takes nothing away


@pytest.mark.parametrize("name", ["fullysupervised", "random", "random30sec", "temporalconsecutive", "kmedoids", "greedycoresets"])
def test_named_labellers_keep_to_their_budget(spark, name):
    _, df = table(spark, 40)
    got = fids(S.labelled_by(name, df, 0.2))
    assert len(set(got)) == len(got)
    assert len(got) == (40 if name == "fullysupervised" else 8) or name == "random30sec" and len(got) >= 8


def test_an_unknown_labeller(spark):
    with pytest.raises(ValueError, match="oracle"):
        S.labelled_by("oracle", spark.range(1), 0.5)


def test_stored_labels_of_experiments(spark):
    _, df = table(spark, 10)
    progress = spark.createDataFrame([(0.1, 1, [3, 3, 4, 99, None]), (0.1, 2, None), (0.1, 3, []), (0.2, 1, [5])], "budget double, experiment int, fids array<long>")
    got = sorted((r["budget"], r["experiment"], r["fid"]) for r in S.read_labels(progress, df).collect())
    assert got == [(0.1, 1, 3), (0.1, 1, 4), (0.2, 1, 5)]
    done = spark.createDataFrame([(0.1, 1), (0.1, 1)], "budget double, experiment int")
    assert S.experiments_left(progress, done).count() == 3
    with pytest.raises(ValueError, match="several batches"):
        S.read_labels(progress.union(progress), df)


def test_samples_given_as_places(spark):
    df = spark.createDataFrame([(10, 5.0), (20, 1.0), (30, 3.0), (40, 2.0)], "fid long, start_time double")
    indices = spark.createDataFrame([("a", 0), ("a", 0), ("b", 3), ("c", 1), ("c", 2), ("d", 0), ("d", 77), ("d", 78)], "file string, place long")
    got = sorted(tuple(r) for r in S.indexed_samples(indices, df, "start_time", "fid").collect())
    # places by time: 20 40 30 10; of the files with one place b counts
    assert got == [(1, 0.25, 10), (2, 0.5, 30), (2, 0.5, 40), (3, 0.75, 20)]


def test_next_element_by_each_way(spark):
    own, df = table(spark, 50)
    free = [r[0] for r in own if r[5] is None]
    rows = df.withColumnRenamed("labels", "hard_label")
    n = 50 - len(free)
    assert fids(S.next_element(rows, "random", seed=3)) == by_hash(3 + n, free)[:1]
    assert fids(S.next_element(rows, "uncertainty", seed=3, least=1.0)) == by_hash(3 + n, free)[:1]
    tops = spark.createDataFrame([(r[0], abs(r[0] - 25) / 50) for r in own], "fid long, top double")
    assert fids(S.next_element(rows, "uncertainty", tops)) == [min(free, key=lambda f: (abs(f - 25), f))]
    x = np.array([r[4] for r in own])
    far = max(free, key=lambda f: (min(np.linalg.norm(x[f] - x[r[0]]) for r in own if r[5] is not None), -f))
    assert fids(S.next_element(rows, "coreset")) == [far]
    assert fids(S.next_element(rows.where("hard_label is not null"), "coreset")) == []
    with pytest.raises(ValueError, match="oracle"):
        S.next_element(rows, "oracle")


def test_metrics_from_one_pass_equal_their_definition(spark):
    rng = np.random.default_rng(4)
    rows = [(i, 0.0, 1.0, c, float(rng.integers(6)) / 5, int(rng.random() < (0.0 if c == "c" else 0.4))) for i in range(60) for c in "abc"]
    df = spark.createDataFrame(rows, "vid long, start_time double, end_time double, label string, probability double, y int")
    f1, acc, ap, tot = [], [], [], Counter()
    for c in "abc":
        own = [(p, y) for _, _, _, label, p, y in rows if label == c]
        k = Counter((p >= 0.4, y) for p, y in own)
        tp, fp, fn, tn = k[True, 1], k[True, 0], k[False, 1], k[False, 0]
        tot.update(tp=tp, fp=fp, fn=fn, tn=tn)
        f1.append(2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0)
        acc.append((tp + tn) / len(own))
        if any(y for _, y in own):
            area = sum(sum(y for p, y in own if p == q) * sum(y for p, y in own if p >= q) / sum(p >= q for p, _ in own) for q in set(p for p, _ in own))
            ap.append(area / sum(y for _, y in own))
    got = M.metrics(df, 0.4).first().asDict()
    want = {"f1_macro": np.mean(f1), "accuracy_macro": np.mean(acc), "f1_micro": 2 * tot["tp"] / (2 * tot["tp"] + tot["fp"] + tot["fn"]), "accuracy_micro": (tot["tp"] + tot["tn"]) / 180, "map": np.mean(ap)}
    assert got == pytest.approx(want)
    none = M.metrics(df.limit(0), 0.4).first()
    assert none["map"] is None and none["f1_micro"] == 0.0


def test_train_starts_without_times_and_beyond_the_round(spark):
    budgets = spark.createDataFrame([(1, 10), (2, 10), (3, 10), (4, 10), (5, 10)], "s long, budget long")
    user = spark.createDataFrame([(1, 2.0), (1, 4.0), (1, None), (2, 1.0), (3, 0.0), (5, 3.0)], "s long, seconds double")
    model = spark.createDataFrame([(1, 7.0), (2, 100.0), (3, 5.0), (4, 5.0), (5, None)], "s long, seconds double")
    got = {r["s"]: r["train_start"] for r in B.train_starts(budgets, user, model, ["s"]).collect()}
    assert got == {1: 3, 2: -1, 3: 1, 4: 1, 5: 1}
