"""Discriminants, mixtures and label cleaning against dense formulas."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinolake.operators import discriminant as D
from kinolake.operators import propagate as P

SCHEMA = "fid long, cluster int, label string, feature array<double>"


def sample(n=240, dims=5, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 2, (3, dims))
    mixes = [np.eye(dims) * (k + 1) + 0.3 * rng.normal(0, 1, (dims, dims)) for k in range(3)]
    at = rng.integers(0, 3, n)
    x = np.array([centres[k] + mixes[k] @ rng.normal(0, 1, dims) for k in at])
    return x, at


@pytest.fixture(scope="module")
def rows(spark):
    x, at = sample()
    made = [(i, i % 6, "abc"[k], v.tolist()) for i, (v, k) in enumerate(zip(x, at, strict=True))]
    return spark.createDataFrame(made + [(900, 0, None, x[0].tolist()), (901, 0, "a", None)], SCHEMA).repartition(3), x, at


def test_linear_projection_equals_a_dense_solution(rows):
    df, x, at = rows
    model = D.Linear.fit(df)
    n = np.bincount(at)
    means = np.array([x[at == k].mean(axis=0) for k in range(3)])
    within = sum((x[at == k] - means[k]).T @ (x[at == k] - means[k]) for k in range(3)) / (len(x) - 3)
    centre = x.mean(axis=0)
    between = sum(n[k] * np.outer(means[k] - centre, means[k] - centre) for k in range(3)) / 2
    # the generalised eigenproblem between v = lambda within v, with v' within v = 1
    chol = np.linalg.inv(np.linalg.cholesky(within))
    values, axes = np.linalg.eigh(chol @ between @ chol.T)
    want = ((x - centre) @ (chol.T @ axes[:, ::-1][:, :2]))
    got = {r["fid"]: r["feature"] for r in D.projected(df.where("fid < 900"), model).collect()}
    got = np.array([got[i] for i in range(len(x))])
    assert got.shape == (240, 2)
    for c in range(2):
        assert min(np.abs(got[:, c] - want[:, c]).max(), np.abs(got[:, c] + want[:, c]).max()) < 1e-6
    assert model.classes == ["a", "b", "c"] and np.allclose(model.centre, centre)


def test_linear_probabilities_equal_the_formula(rows):
    df, x, at = rows
    means = np.array([x[at == k].mean(axis=0) for k in range(3)])
    within = sum((x[at == k] - means[k]).T @ (x[at == k] - means[k]) for k in range(3)) / (len(x) - 3)
    inverse = np.linalg.inv(within)
    scores = x @ inverse @ means.T - 0.5 * np.einsum("ki,ij,kj->k", means, inverse, means) + np.log(np.bincount(at) / len(at))
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    want = e / e.sum(axis=1, keepdims=True)
    got = {r["fid"]: r for r in D.probabilities(df, D.Linear.fit(df)).collect()}
    assert got[901]["probabilities"] is None and got[901]["predicted"] is None
    for i in range(240):
        # the projection drops nothing that tells classes apart, so this is exact
        assert np.allclose(got[i]["probabilities"], want[i], atol=1e-9)
        assert got[i]["predicted"] == "abc"[int(want[i].argmax())] and got[i]["top"] == pytest.approx(want[i].max())


@pytest.mark.parametrize("shrinkage", [0.0, 0.3])
def test_quadratic_probabilities_equal_the_formula(rows, shrinkage):
    df, x, at = rows
    scores = []
    for k in range(3):
        own = x[at == k]
        cov = (1 - shrinkage) * np.cov(own.T) + shrinkage * np.eye(5)
        d = x - own.mean(axis=0)
        scores.append(-0.5 * (np.einsum("ni,ij,nj->n", d, np.linalg.inv(cov), d) + np.linalg.slogdet(cov)[1]) + np.log(len(own) / len(x)))
    s = np.array(scores).T
    e = np.exp(s - s.max(axis=1, keepdims=True))
    want = e / e.sum(axis=1, keepdims=True)
    got = {r["fid"]: r["probabilities"] for r in D.probabilities(df.where("fid < 900"), D.Quadratic.fit(df, shrinkage)).collect()}
    assert np.allclose([got[i] for i in range(240)], want, atol=1e-9)


def test_classes_that_cannot_be_told_apart(spark):
    one = spark.createDataFrame([(1, 0, "a", [1.0]), (2, 0, "a", [2.0])], SCHEMA)
    with pytest.raises(ValueError):
        D.Linear.fit(one)
    with pytest.raises(ValueError):
        D.Linear.fit(one.limit(0))
    flat = spark.createDataFrame([(i, 0, "ab"[i % 2], [float(i), 1.0]) for i in range(8)], SCHEMA)
    with pytest.raises(ValueError):
        D.Quadratic.fit(flat)
    assert D.Quadratic.fit(flat, 0.1).classes == ["a", "b"]
    assert np.isfinite(D.Linear.fit(flat).coefficients).all()


def test_rankers_and_chooser(spark):
    made = [(0, 0, "a", "b", 0.9), (1, 0, None, "a", 0.6), (2, 1, "a", "b", 0.8), (3, 1, "b", "a", 0.9), (4, 1, None, "a", 0.95), (5, 2, "a", "b", 0.5), (6, 2, "a", "b", 0.5), (7, 2, "a", "b", 0.5), (8, 3, None, "a", 0.7), (9, 3, None, "b", 0.7)]
    df = spark.createDataFrame(made, "fid long, cluster int, hard_label string, predicted string, top double")
    assert D.wrong_cluster(df).first()[0] == 1  # cluster 2 has more wrong rows but none to label
    assert D.doubtful_cluster(df).first()[0] == 3
    assert {r["cluster"]: r["fid"] for r in D.doubtful_element(df).collect()} == {0: 1, 1: 4, 3: 8}
    assert D.wrong_cluster(df.where("cluster in (2, 3)")).first()[0] is None


def test_cleaning_changes_exactly_the_planted_errors(spark):
    rng = random.Random(2)
    made, want = [], {}
    for c in range(12):
        true = "ab"[c % 2]
        planted = c in (3, 6)  # believed to be the other class throughout, with a confident classifier
        unsure = c == 7  # wrong too, but the classifier isn't sure
        for i in range(10):
            fid = c * 10 + i
            wrong = "ab"[1 - c % 2]
            believed = wrong if planted or unsure else true
            hard = true if i == 0 else None
            p = 0.6 if unsure else 0.995 + rng.random() / 1000
            made.append((fid, c, hard, hard or believed, [p, 1 - p] if true == "a" else [1 - p, p]))
            want[fid] = true if planted else hard or believed
    df = spark.createDataFrame(made, "fid long, cluster int, hard_label string, label string, probabilities array<double>")
    out, asked = D.cleaned(df, ["a", "b"])
    assert {r["fid"]: r["label"] for r in out.collect()} == want and asked.count() == 0 and out.columns == df.columns
    changed = [r[0] for r in made if r[3] != want[r[0]]]
    assert len(changed) == 18
    same, asked = D.cleaned(df, ["a", "b"], ask=1.0)
    assert {r["cluster"] for r in asked.collect()} == {3, 6}
    assert {r["fid"]: r["label"] for r in same.collect()} == {r[0]: r[3] for r in made}


def test_clusters_that_nobody_labeled_are_looked_at(spark):
    made = [(i, i // 3, None, "a" if i < 3 else None, [0.999, 0.001]) for i in range(9)]
    df = spark.createDataFrame(made, "fid long, cluster int, hard_label string, label string, probabilities array<double>")
    out, asked = D.cleaned(df, ["a", "b"])
    assert {r["label"] for r in out.collect()} == {"a"} and asked.count() == 0
    assert {r["cluster"] for r in D.cleaned(df, ["a", "b"], ask=1.0)[1].collect()} == {0, 1, 2}


def test_mixture_responsibilities(spark):
    rng = random.Random(3)
    made = [(i, [10.0 * (i % 3) + rng.gauss(0, 1), rng.gauss(0, 1) + 5 * (i % 3)], "abc"[i % 3] if i < 9 else None) for i in range(300)]
    df = spark.createDataFrame(made, "fid long, feature array<double>, hard_label string")
    own = D.mixture(df, 3, seed=4).cache()
    got = own.collect()
    assert all(abs(sum(r["responsibilities"]) - 1) < 1e-9 and r["top"] == max(r["responsibilities"]) for r in got)
    labels = {r["fid"]: (r["label"], r["weight"]) for r in D.mixed_labels(own).collect()}
    assert all(labels[i][0] == "abc"[i % 3] for i in range(300)) and all(labels[i][1] == 1.0 for i in range(9))
    assert all(0.5 < w <= 1.0 for _, w in labels.values())
    # the cluster of least median certainty among those with rows to label
    medians = {c: np.median([r["top"] for r in got if r["cluster"] == c]) for c in {r["cluster"] for r in got}}
    assert P.uncertain_cluster(own).first()[0] == min(medians, key=lambda c: (medians[c], c))


def test_mixed_labels_against_brute_force(spark):
    rng = random.Random(9)
    made = []
    for i in range(40):
        r = [rng.random() for _ in range(3)]
        made.append((i, rng.choice(["a", "b", None, None]), [x / sum(r) for x in r]))
    df = spark.createDataFrame(made, "fid long, hard_label string, responsibilities array<double>")
    got = {r["fid"]: (r["label"], r["weight"]) for r in D.mixed_labels(df).collect()}
    votes = [{y: sum(r[c] for _, h, r in made if h == y) for y in "ab"} for c in range(3)]
    for fid, hard, r in made:
        w = {y: sum(r[c] * votes[c][y] / sum(votes[c].values()) for c in range(3)) for y in "ab"}
        best = hard or max(w, key=w.get)
        assert got[fid][0] == best and got[fid][1] == pytest.approx(1.0 if hard else w[best] / sum(w.values()))
    none = D.mixed_labels(df.withColumn("hard_label", F.lit(None).cast("string")))
    assert {r["label"] for r in none.collect()} == {None}


def test_labels_after_clusters_changed(spark):
    made = [(0, 0, "a", "a"), (1, 0, None, "b"), (2, 1, None, "c"), (3, 1, None, "c"), (4, 1, None, "b"), (5, 2, None, None), (6, 3, "b", "b"), (7, 3, "a", "a"), (8, 3, None, None)]
    df = spark.createDataFrame(made, "fid long, cluster int, hard_label string, label string")
    got = {r["fid"]: r["label"] for r in D.repropagated(df).collect()}
    assert got == {0: "a", 1: "a", 2: "c", 3: "c", 4: "c", 5: None, 6: "b", 7: "a", 8: "a"}


def test_a_round_of_a_coordinator(spark):
    x, at = sample(200, 6, seed=5)
    made = [(i, i % 4, "abc"[k] if i < 60 else None, None, v.tolist(), 0.0, "kept") for i, (v, k) in enumerate(zip(x * 3, at, strict=True))]
    df = spark.createDataFrame(made, "fid long, cluster int, hard_label string, label string, feature array<double>, distance double, more string")
    out, model = D.discriminant_round(df, 20)
    got = out.collect()
    assert model.classes == ["a", "b", "c"] and len(got) == 200 and len({r["cluster"] for r in got}) <= 10
    assert all(r["label"] == r["hard_label"] for r in got if r["hard_label"]) and all(r["more"] == "kept" and r["distance"] >= 0 for r in got)
    right = np.mean([r["label"] == "abc"[at[r["fid"]]] for r in got])
    assert right > 0.6  # clusters of the raw numbers, i % 4, would give about a third
    few, none = D.discriminant_round(df.withColumn("hard_label", F.when(F.col("fid") == 0, F.col("hard_label"))), 20)
    assert none is None and {(r["fid"], r["cluster"]) for r in few.collect()} == {(i, i % 4) for i in range(200)}
