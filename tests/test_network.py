"""The rectified network: gradients, an XOR table, seeds."""

import random

import numpy as np
import pytest

from kinolake.operators import models as M
from kinolake.operators import network as N

SCHEMA = "vid long, start_time double, end_time double, feature array<float>, labels string"


@pytest.fixture(scope="module")
def xor(spark):
    rng = random.Random(1)
    rows = []
    for i in range(600):
        a, b = rng.choice([-1, 1]), rng.choice([-1, 1])
        rows.append((i % 9, float(i), i + 1.0, [a + rng.gauss(0, 0.25), b + rng.gauss(0, 0.25)], "same" if a == b else "other"))
    return spark.createDataFrame(rows, SCHEMA)


def right(df, scored):
    best = {}
    for r in scored.collect():
        key = (r["vid"], r["start_time"])
        best[key] = max(best.get(key, (0, "")), (r["probability"], r["label"]))
    return np.mean([best[r["vid"], r["start_time"]][1] == r["labels"] for r in df.collect()])


def test_gradients_equal_differences():
    rng = np.random.default_rng(2)
    w = {"w1": rng.normal(size=(3, 5)), "b1": rng.normal(size=5), "w2": rng.normal(size=(5, 4)), "b2": rng.normal(size=4)}
    x, y, share = rng.normal(size=(7, 3)), rng.integers(0, 4, 7), rng.random(7)

    def loss():
        return -(np.log(N.forward(w, x)[1][np.arange(7), y]) * share).sum() / share.sum()

    got = N.gradients(w, x, y, share)
    for k in w:
        for at in np.ndindex(w[k].shape):
            old, e = w[k][at], 1e-6
            w[k][at] = old + e
            up = loss()
            w[k][at] = old - e
            down = loss()
            w[k][at] = old
            assert got[k][at] == pytest.approx((up - down) / (2 * e), abs=1e-6)


def test_it_learns_what_a_linear_model_cannot(xor):
    model = N.fit_network(xor, hidden=8, rounds=15, seed=3)
    own = right(xor, N.infer_network(model, xor, 1))
    linear, classes = M.fit_linear(xor)
    assert own > 0.95 and own > right(xor, M.infer(linear, classes, xor, 1)) + 0.2


def test_seeds_repeat_and_models_can_be_kept(xor):
    one, two, other = (N.fit_network(xor, hidden=4, rounds=2, seed=s, parts=3) for s in (5, 5, 6))
    assert all(np.array_equal(one.weights[k], two.weights[k]) for k in N.NAMES)
    assert not np.array_equal(one.weights["w1"], other.weights["w1"])
    x = np.random.default_rng(1).normal(size=(4, 2))
    assert np.array_equal(N.Network.from_json(one.to_json()).probabilities(x), one.probabilities(x))


def test_shared_labels_and_odd_rows(spark):
    rows = [(0, float(i), i + 1.0, [float(i % 2), 7.0], "a_b" if i % 2 else "c") for i in range(60)] + [(0, 99.0, 100.0, None, "a")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert N.fit_network(df, rounds=1).weights["w1"].shape == (2, 2)
    model = N.fit_network(df, hidden=12, rounds=30, batch=4, parts=2)
    assert model.classes == ["a", "b", "c"]
    p = {(r["start_time"], r["label"]): r["probability"] for r in N.infer_network(model, df, 4).collect()}
    assert len(p) == 180 and p[1.0, "a"] == pytest.approx(p[1.0, "b"], abs=0.1) and p[0.0, "c"] > 0.8
    with pytest.raises(ValueError):
        N.fit_network(df.limit(0))


def test_hidden_sizes():
    assert N.hidden_size(64, 5) == 42 and N.hidden_size(3, 5) == 3
