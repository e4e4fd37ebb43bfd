import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from kinolake.llm import suffix_tree as S


def reference(rows, order, least, gain_least, prior):
    """The same model with dictionaries."""
    seqs = [(i, ("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")).encode().split() + [None]) for i, t in rows]
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    c = Counter(w for i, s in seqs if not out(i) for w in s)
    n, v = sum(c.values()), len(c)
    base = lambda w: (c[w] + 0.1) / (n + 0.1 * (v + 1))
    model = {}

    def context(s, t, k):
        return None if t - k < -1 else tuple(s[t - j] if t >= j else None for j in range(1, k + 1))

    def prob(s, t, k_most):
        p = base(s[t])
        for k in range(1, k_most + 1):
            if (q := context(s, t, k)) is None:
                break
            if (k, q) in model:
                counts, held, spare = model[k, q]
                p = ((counts[s[t]] if counts[s[t]] >= 2 else 0) + spare * p) / (held + spare)
        return p

    for k in range(1, order + 1):
        counts = defaultdict(Counter)
        for i, s in seqs:
            for t in range(len(s)):
                if not out(i) and (q := context(s, t, k)) is not None:
                    counts[q][s[t]] += 1
        new = {}
        for q, cn in counts.items():
            many = {w: x for w, x in cn.items() if x >= 2}
            if sum(cn.values()) < least or not many:
                continue
            held, spare, gain = sum(many.values()), len(cn) - len(many) + prior, 0.0
            back = list(reversed(q))
            for w, x in cn.items():
                parent = prob([*back, w], len(back), k - 1) if k > 1 else base(w)
                parent = 2 ** (-min(255, max(0, round(-4 * math.log2(parent)))) / 4)
                gain += x * math.log((many.get(w, 0) + spare * parent) / (held + spare) / parent)
            if gain >= gain_least * len(many):
                new[k, q] = (cn, held, spare)
        model.update(new)
    return [(i, out(i), len(s), sum(c[w] > 0 for w in s), n, sum(math.log10(base(w)) for w in s), sum(math.log10(prob(s, t, order)) for t in range(len(s)))) for i, s in seqs], len(model)


def test_as_reference_model(documents):
    random.seed(2)
    phrases = ["the cat sat on the mat", "a dog ran", "of the people by the people", "É x y z"]
    rows = [(i, " ".join(random.choice(phrases) if random.random() < 0.8 else f"W{random.randrange(40)}" for _ in range(random.randint(0, 25)))) for i in range(400)]
    rows += [(7, "the cat"), (7, "the cat"), (None, "the cat sat"), (1000, None), (1001, "")]
    for order in (0, 1, 2, 3):
        want, states = reference(rows, order, S.MIN_CONTEXT, S.GAIN, S.PRIOR)
        assert states > 0 or order == 0
        got = sorted((tuple(r) for r in S.score_texts(documents(rows), order).collect()), key=repr)
        assert len(got) == len(want)
        key = lambda r: (repr(r[:5]), round(r[5], 6))
        for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
            assert g[:5] == w[:5]
            assert math.isclose(g[5], w[5], rel_tol=1e-9, abs_tol=1e-9) and math.isclose(g[6], w[6], rel_tol=1e-9, abs_tol=1e-9)
    held = [r for r in got if r[1] and r[2] > 5]
    assert sum(r[6] for r in held) > sum(r[5] for r in held)


def test_empty_table(documents):
    assert S.score_texts(documents([])).count() == 0


def test_rare_contexts_live_in_a_large_corpus(documents):
    """A context seen MIN_CONTEXT times is a state however many tokens there are, here 20 million."""
    trains = [i for i in range(100) if zlib.crc32(str(i).encode()) % 10]
    rare, large = trains[: S.MIN_CONTEXT], trains[S.MIN_CONTEXT : S.MIN_CONTEXT + 20]
    rows = [(i, "p q") for i in rare] + [(i, "x " * 1_000_000) for i in large]
    got = {r["doc_id"]: r for r in S.score_texts(documents(rows), 1).where("n_tokens = 3").collect()}
    n, docs = 20_000_000 + 20 + 3 * S.MIN_CONTEXT, 20 + S.MIN_CONTEXT
    base = lambda c: (c + S.ALPHA) / (n + S.ALPHA * 5)
    after = lambda count, held, c: (count + S.PRIOR * base(c)) / (held + S.PRIOR)
    want = math.log10(after(16, docs, 16)) + math.log10(after(16, 16, 16)) + math.log10(after(16, 16, docs))
    assert len(got) == S.MIN_CONTEXT
    for r in got.values():
        assert r["train_tokens"] == n and math.isclose(r["score"], want, rel_tol=1e-9)


def test_narrow_counts():
    counts = np.array([0, 1, 254, 255, 256, 1 << 40, 3])
    assert S._widened(S._narrow(counts)).tolist() == counts.tolist()
    assert S._widened(S._narrow(counts[:0])).tolist() == []


@pytest.mark.parametrize("width", [3, 20, 62])
def test_order_is_the_stable_one_whether_or_not_it_fits_a_number(width):
    rng = np.random.default_rng(width)
    for size in (0, 1, 500):
        high, low = rng.integers(0, 9, size), rng.integers(0, 1 << width, size).astype(np.uint64)
        low[: size // 2] = low[size // 2 : size // 2 * 2]  # ties
        assert S._order(high, low).tolist() == np.lexsort((low, high)).tolist()


def test_no_table_stays_in_the_catalogue(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a c")], "doc_id long, text string")
    assert S.score_texts(docs).count() == 2
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("kinolake")]
