"""Elimination step by step against a plain loop."""

import random

from kinolake.operators import bandit as B

SCHEMA = "experiment int, feature_name string, l array<double>, u array<double>"


def by_steps(info):
    """(feature, step) as a loop over steps and pairs."""
    names = sorted(info)
    n = len(info[names[0]][0])
    left, out, at_start = set(names), [], []
    for i in range(2, n):
        at_start = sorted(left)
        for f in at_start:
            for g in at_start:
                if f != g and g in left and info[f][0][i] >= info[g][1][i]:
                    left.remove(g)
                    out.append((g, i))
        if len(at_start) == 1:
            break
    return sorted(out + ([(f, n + 1) for f in at_start] if n > 2 else []))


def at_end(info):
    longest = max(len(x) for x, _ in info.values())
    out = [(f, len(info[f][0])) for f in info if len(info[f][0]) < longest]
    left = {f for f in info if len(info[f][0]) == longest}
    order = sorted(left)
    for f in order:
        for g in order:
            if f in left and g in left and f != g and info[f][0][-1] >= info[g][1][-1]:
                left.remove(g)
                out.append((g, longest))
    return sorted(out + [(next(iter(left)), longest + 1)]) if len(left) == 1 else []


def made(rng, n, steps, ragged=False):
    info = {}
    for f in range(n):
        k = steps - rng.randrange(3) if ragged and f else steps
        mid = [rng.random() for _ in range(k)]
        wide = [0.6 / (i + 1) for i in range(k)]
        info[f"f{f}"] = ([round(m - w, 2) for m, w in zip(mid, wide, strict=True)], [round(m + w, 2) for m, w in zip(mid, wide, strict=True)])
    return info


def run(spark, f, infos):
    rows = [(e, name, low, high) for e, info in enumerate(infos) for name, (low, high) in info.items()]
    got = {}
    for r in f(spark.createDataFrame(rows, SCHEMA), ["experiment"]).collect():
        got.setdefault(r["experiment"], []).append((r["feature_name"], r["step"]))
    return {e: sorted(x) for e, x in got.items()}


def test_full_series(spark):
    rng = random.Random(1)
    infos = [made(rng, rng.randrange(1, 6), rng.randrange(1, 9)) for _ in range(80)]
    want = {e: by_steps(i) for e, i in enumerate(infos) if by_steps(i)}
    assert run(spark, B.eliminations, infos) == want
    assert any(s < 9 for x in want.values() for _, s in x)


def test_two_that_remove_each_other_both_go(spark):
    info = {"a": ([0.0, 0.0, 0.5, 0.5], [1.0, 1.0, 0.5, 0.5]), "b": ([0.0, 0.0, 0.5, 0.5], [1.0, 1.0, 0.5, 0.5])}
    assert run(spark, B.eliminations, [info])[0] == by_steps(info) == [("a", 2), ("b", 2)]


def test_series_that_ended(spark):
    rng = random.Random(4)
    infos = [made(rng, rng.randrange(1, 6), rng.randrange(4, 9), ragged=True) for _ in range(80)]
    want = {e: at_end(i) for e, i in enumerate(infos) if at_end(i)}
    assert run(spark, B.eliminated, infos) == want
    assert 0 < len(want) < 80
