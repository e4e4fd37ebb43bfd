import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from kinolake.llm import exact_dedup as X


@given(st.lists(st.integers(0, 2**64 - 1), max_size=80, unique=True))
@settings(max_examples=100, deadline=None)
def test_golomb_round_trip(values):
    v = np.sort(np.array(values, np.uint64))
    r, code = X.golomb_encode(v)
    assert X.golomb_decode(r, code, len(v)).tolist() == v.tolist()


def test_golomb_is_near_the_information_bound():
    v = np.unique(np.random.default_rng(0).integers(0, 2**63, 10_000).astype(np.uint64))
    _, code = X.golomb_encode(v)
    assert 8 * len(code) / len(v) < np.log2(2**63 / len(v)) + 2.1


def test_as_brute_force(documents):
    rows = [(1, "Abc"), (2, "aBC"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "abc "), (8, "x" * 100_000), (9, "X" * 100_000), (9, "X" * 100_000), (None, "abc"), (None, "alone"), (10, "solo")]
    got = X.exact_dedup(documents(rows)).collect()
    norm = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    want = []
    for i, t in rows:
        g = groups[norm(t)]
        keep = max((x for x in g if x is not None), default=None)
        want.append((i, keep, len(g), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)


def test_empty_table(documents):
    assert X.exact_dedup(documents([])).count() == 0


def test_small_blocks_and_several_owners_find_every_repeat(documents):
    """Copies inside blocks, across blocks and with hashes at the owners' borders."""
    rows = [(i, f"text {i % 37}" if i % 3 else f"own {i}") for i in range(200)]
    df = documents(rows)
    want = sorted(map(repr, X.exact_dedup(df).collect()))
    for size, owners in ((1, 3), (7, 64), (1000, 1)):
        assert sorted(map(repr, X.exact_dedup(df, size, owners).collect())) == want
    sizes = {r["doc_id"]: r["group_size"] for r in X.exact_dedup(df, 7, 5).collect()}
    texts = dict(rows)
    assert sizes == {i: sum(t == u for u in texts.values()) for i, t in rows}
    for owners in (1, 3, 7, 64, 1000):
        for o in range(owners):
            first = X._first(o, owners)
            assert X._owner(np.array([first]), owners)[0] == o and (not o or X._owner(np.array([first - np.uint64(1)]), owners)[0] == o - 1)
