import hashlib
import random

import numpy as np

from kinolake.llm import suffix_dedup as S


def brute(rows):
    texts = [(_id, (t or "").encode()) for _id, t in rows]
    key = lambda i: float("inf") if i is None else i
    least = {}
    for i, b in texts:
        for k in range(len(b) - 49):
            w = b[k : k + 50]
            least[w] = min(least.get(w, float("inf")), key(i))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if least[b[k : k + 50]] < key(i):
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(map(repr, out))


def got(documents, rows):
    return sorted(repr(tuple(r)) for r in S.suffix_dedup(documents(rows)).collect())


def words(n, alphabet="abcdefghijklmnoé "):
    return "".join(random.choice(alphabet) for _ in range(n))


def test_as_brute_force(documents, monkeypatch):
    random.seed(4)
    common, line = words(180), words(52)
    rows = [(i, words(random.randint(0, 200)) + random.choice(["", common, line, common[20:120], line + line]) + words(random.randint(0, 120))) for i in range(120)]
    rows += [(500, rows[3][1]), (501, rows[3][1]), (3, rows[3][1]), (None, rows[3][1]), (502, None), (503, ""), (504, "x" * 49), (505, "x" * 50), (506, "x" * 500), (507, "ab" * 300), (508, "b" + "ab" * 100)]
    want = brute(rows)
    assert got(documents, rows) == want
    # hot anchors, merges in small steps
    monkeypatch.setattr(S, "HOT", 3)
    assert got(documents, rows) == want
    monkeypatch.setattr(S, "HOT", 10**6)
    monkeypatch.setattr(S, "MERGE", 5)
    assert got(documents, rows) == want


def test_kept_bytes_and_empty_table(documents):
    random.seed(5)
    shared = words(80, "abcdefgh")
    rows = {r["doc_id"]: bytes(r["kept"]) for r in S.suffix_dedup(documents([(1, "A" + shared + "B"), (2, "C" + shared + "D")]), with_bytes=True).collect()}
    assert rows == {1: b"A" + shared.encode() + b"B", 2: b"CD"}
    assert S.suffix_dedup(documents([])).count() == 0


def test_merge_of_transforms_sorts_all_suffixes():
    random.seed(6)
    strings = [words(random.randint(50, 74), "ab").encode() for _ in range(40)] + [b"x" * 60, b"x" * 74, b"ab" * 30]
    docs, shard = np.arange(len(strings))[::-1].copy(), np.arange(len(strings)) % 4
    found = S.merged_least(strings, docs, shard)
    for i, s in enumerate(strings):
        for o in range(len(s) - 49):
            assert found[i, o] == min(int(docs[j]) for j, t in enumerate(strings) if s[o : o + 50] in t)
