import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from kinolake.llm import ngram_join as N


@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=50))
@settings(max_examples=100, deadline=None)
def test_squeeze_round_trip(values):
    v = np.sort(np.array(values, np.uint64))
    assert N._expand(N._squeeze(v)).tolist() == v.tolist()


def sets_of(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split(" ")
    w = [x for x in w if x]
    return {" ".join(w)} if 0 < len(w) < 5 else {" ".join(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    sets = [sets_of(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if inter and 100 * inter >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc, len(sets[i]), min(ids, default=None) if sets[i] else doc))
    return sorted(map(repr, out))


def got(documents, rows):
    return sorted(repr(tuple(r)) for r in N.ngram_join(documents(rows)).collect())


def test_edges(documents):
    rows = [(5, "a b c"), (3, "A B  c"), (9, None), (2, ""), (4, "   "), (None, "a b c"), (7, "one two three four five six"), (7, "one two three four five six"), (None, "nobody else has this text"), (1, "a b c d")]
    assert got(documents, rows) == brute(rows)
    assert N.ngram_join(documents([])).count() == 0


def test_random_near_copies_as_brute_force(documents, monkeypatch):
    # small classes make frequent tokens, combinations and several rounds of leaders
    monkeypatch.setattr(N, "FREQUENT", 3)
    monkeypatch.setattr(N, "PAIRED", 40)
    monkeypatch.setattr(N, "LEADERS", 2)
    monkeypatch.setattr(N, "MORE", 2)
    random.seed(11)
    vocab = [f"w{i}" for i in range(400)]
    bases = [[random.choice(vocab) for _ in range(random.randint(5, 90))] for _ in range(12)]
    rows = []
    for i in range(260):
        w = list(random.choice(bases))
        for _ in range(random.choice([0, 0, 1, 1, 2, 3, 4])):
            k = random.randrange(len(w))
            w[k : k + random.randint(0, 1)] = [random.choice(vocab)]
        if random.random() < 0.2:
            w += random.choice(bases)[:30]
        rows.append((i * 7 % 263, " ".join(w)))
    assert got(documents, rows) == brute(rows)
