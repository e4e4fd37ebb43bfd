"""Operators whose plan was made to spread: equal to plain forms, also where they have to work in parts."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinolake.operators import explore as EX
from kinolake.operators import features as FE
from kinolake.operators import search as SE
from kinolake.operators import select as SL

SPAN = "vid long, start_time double, end_time double"


def greedy(rows, k, t):
    taken = []
    for v, s, e, _ in sorted(set(rows), key=lambda r: (r[3], r[0], r[1], r[2])):
        grow = max(0.0, (t - (e - s)) / 2)
        a, b = s - grow, e + grow
        if len(taken) < k and all(v != w or not (c < a < d or c < b < d or (a <= c and d <= b) or round(s, 3) == round(x, 3)) for w, c, d, x, _ in taken):
            taken.append((v, a, b, s, e))
    return [(v, s, e) for v, _, _, s, e in taken]


def test_windows_apart_in_a_chain_that_settles_one_by_one(spark):
    # ranked along time, every window waits for the one before it
    rows = [(1, 5.0 * i, 5.0 * i + 1, float(i)) for i in range(60)] + [(2, 100.0, 101.0, 30.5), (2, 100.0, 120.0, 30.7)]
    df = spark.createDataFrame(rows, SPAN + ", rank_value double")
    assert SL.apart(df, 8, 12.0) == greedy(rows, 8, 12.0)
    assert SL.apart(df, 20, 12.0, at_once=25) == greedy(rows, 20, 12.0)
    assert SL.apart(df.where("start_time < 60"), 100, 12.0) == greedy([r for r in rows if r[1] < 60], 100, 12.0)


@pytest.mark.parametrize("t", [0.0, 3.0, 50.0])
def test_windows_apart_with_ties_and_repeats(spark, t):
    rng = random.Random(int(t) + 1)
    rows = [(rng.randrange(2), s, s + rng.choice([0.0, 1.0, 30.0]), rng.randrange(9) / 8) for s in (float(rng.randrange(90)) for _ in range(80))]
    rows += rows[:9]
    df = spark.createDataFrame(rows + [(None, 1.0, 2.0, 0.0), (1, None, 2.0, 0.0)], SPAN + ", rank_value double")
    for at_once, bucket in ((4096, None), (9, 7.0)):
        assert SL.apart(df, 10, t, at_once=at_once, bucket=bucket) == greedy(rows, 10, t)
    assert SL.apart(df.limit(0), 3, t) == []


def test_nearest_chosen_in_blocks(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 1, (150, 4)) + 30 * rng.integers(0, 3, (150, 1)), np.zeros((30, 4))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "fid long, feature array<double>")
    some = df.where("fid % 3 = 0 or fid > 160")
    at = np.array([i for i in range(len(x)) if i % 3 == 0 or i > 160])
    want = np.sqrt(((x[:, None] - x[at][None]) ** 2).sum(-1)).min(axis=1)
    for pivots in (1, 5, 200):
        got = {r["fid"]: r["min_dist"] for r in SL.nearest_chosen(df, some, "min_dist", pivots=pivots, block=16).collect()}
        assert np.allclose([got[i] for i in range(len(x))], want) and len(got) == len(x)
    assert {r["fid"]: round(r["min_dist"], 9) for r in SL.farthest(df, some, block=8).collect()} == {r["fid"]: round(r["min_dist"], 9) for r in SL.farthest(df, some).collect()}


def test_coreset_is_the_greedy_one(spark):
    rng = random.Random(6)
    rows = [(i, [rng.random(), rng.random()]) for i in range(80)]
    df = spark.createDataFrame(rows, "fid long, feature array<double>")
    got = {r["fid"] for r in SL.coreset(df, 11, df.where("fid < 3"), stored_every=4).collect()}
    taken = [0, 1, 2]
    for _ in range(11):
        taken.append(max((i for i in range(80) if i not in taken), key=lambda i: (min(math.dist(rows[i][1], rows[j][1]) for j in taken), -i)))
    assert got == set(taken[3:])


def test_neighbours_in_time(spark):
    rng = random.Random(2)
    rows = [(v, None if rng.random() < 0.2 else f"2024-01-{rng.randrange(1, 9):02d}") for v in range(40)]
    df = spark.createDataFrame(rows, "vid long, d string").select("vid", F.to_timestamp("d").alias("vstart"))
    order = [v for v, _ in sorted(rows, key=lambda r: (r[1] is None, r[1] or "", r[0]))]
    for asked in ([], [3], [order[0], order[-1], 77], list(range(0, 40, 3))):
        want = {order[j] for i, v in enumerate(order) if v in asked for j in (i - 1, i, i + 1) if 0 <= j < 40}
        for at_once in (2, 64):
            got = [r["vid"] for r in SE.adjacent(df, asked, at_once).collect()]
            assert sorted(got) == sorted(want)


def test_neighbours_need_no_window(spark, capsys):
    SE.adjacent(spark.range(5).selectExpr("id as vid", "timestamp_seconds(id) as vstart"), [2]).explain()
    assert "Window" not in capsys.readouterr().out


def test_pooling_sends_a_vector_a_group(spark):
    rows = [(i, i % 2, float(i), i + 1.0, None if i == 6 else [float(-i), float(i * i % 7), 1.0]) for i in range(20)]
    df = spark.createDataFrame(rows, "fid long, vid long, start_time double, end_time double, feature array<float>")
    for how, f in (("max", np.max), ("mean", np.mean)):
        got = {(r["vid"], r["part"]): r for r in FE.pooled(df, 3, how).collect()}
        for v in (0, 1):
            own = [r for r in rows if r[1] == v]
            for g in range(4):
                part = [r for r in own[3 * g : 3 * g + 3] if r[4]]
                r = got[v, g]
                assert np.allclose(r["feature"], f([p[4] for p in part], axis=0)) and (r["start_time"], r["end_time"]) == (part[0][2], part[-1][3])
        assert len(got) == 8


def test_pyramids_against_loops(spark):
    rng = random.Random(3)
    rows = [(i, i % 3, float(i), i + 1.0, [rng.gauss(0, 1), -1.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "fid long, vid long, start_time double, end_time double, feature array<double>")
    got = {(r["vid"], r["level"], r["k"], r["i"]): r for r in FE.pyramid_pooled(df, 3).collect()}
    n = 0
    for v in range(3):
        x = np.array([r[4] for r in rows if r[1] == v])
        for level in range(3):
            for k in range(2**level):
                lo, hi = (int((len(x) - 1) * (j / 2**level + 0.000001) + 0.5) for j in (k, k + 1))
                for i in range(2):
                    r, own = got[v, level, k, i], x[lo : hi + 1, i]
                    d = [x[t, i] - x[t - 2, i] for t in range(max(lo, 2), min(hi, len(x) - 1) + 1)]
                    assert (r["rises"], r["falls"]) == (sum(y > 0.01 for y in d), sum(y < -0.01 for y in d))
                    assert r["sum"] == pytest.approx(own.sum()) and r["max"] == own.max()
                    n += 1
    assert len(got) == n


def test_explorers_take_the_test_that_their_name_asks_for(monkeypatch):
    seen = []
    monkeypatch.setattr(SL, "cvm_uniform", lambda s, p: seen.append(("cvm", p)) or True)
    monkeypatch.setattr(SL, "binomial_uniform", lambda s, p, m: seen.append(("binom", p, m)) or True)
    monkeypatch.setattr(SL, "ad_uniform", lambda s, p, seed: seen.append(("aks", p)) or True)
    for name in ("cvm_pval0.05", "binom_pval0.01_m2.5", "aks", "random_pval.2"):
        assert SL.uniform({"a": 1.0}, name)
    assert seen == [("cvm", 0.05), ("binom", 0.01, 2.5), ("aks", 0.001), ("aks", 0.2)]
    assert EX.named_explorer("random") is EX.EXPLORERS["random"] and callable(EX.named_explorer("randomifuniformcm_binom_pval0.01_m2"))
    for name in ("nothing", "randomifuniform_", "coreset_cvm"):
        with pytest.raises(ValueError):
            EX.named_explorer(name)
