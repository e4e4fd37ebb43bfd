import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from kinolake.llm import periodic_runs as P


def split(text):
    """Words between ASCII white space only."""
    return [w.decode() for w in (text or "").encode().split()]


def brute(words):
    """All maximal stretches by period, the smallest period of each."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = j
    return sorted((s, k, q) for (s, k), q in found.items())


def stuttered(doc_id, text):
    words = split(text)
    if doc_id is None or not words or zlib.crc32(str(doc_id).encode()) % 10:
        return words
    g, n = zlib.crc32(str(doc_id).encode()) // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def row(doc_id, text):
    words = stuttered(doc_id, text)
    runs = brute(words)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(kept))


def texts():
    rnd = random.Random(11)
    made = [None, "", "  \t", "a", "a a a a a", "a a a a a a", "A a A a A a A a A a", "x " + "a b " * 4 + "a y", "a b c " * 4, "é ü é ü é ü é ü\x0bé ü", "a " * 40 + "b " + "a " * 40, "a\xa0b " * 6]
    for k in range(150):
        letters = "ab" if k % 3 else "abcdef"
        made.append(" ".join(rnd.choice(letters) for _ in range(rnd.randrange(60))))
    for _ in range(40):
        piece = [rnd.choice("abcd") for _ in range(rnd.randrange(1, 9))]
        made.append(" ".join([rnd.choice("xyz") for _ in range(rnd.randrange(9))] + piece * rnd.randrange(3, 7) + piece[: rnd.randrange(3)] + [rnd.choice("abcd") for _ in range(rnd.randrange(9))]))
    return made


def test_runs_against_brute_force():
    for text in texts():
        words = split(text)
        ((runs, left),) = P.found_in([(text or "").encode()])
        assert [tuple(r) for r in runs.tolist()] == brute(words), text


def test_texts_named_together_do_not_meet(monkeypatch):
    monkeypatch.setattr(P, "CHUNK", 7)
    own = [t or "" for t in texts()]
    for text, (runs, left) in zip(own, P.found_in([t.encode() for t in own]), strict=True):
        assert [tuple(r) for r in runs.tolist()] == brute(split(text)), text


def test_query_against_brute_force(spark, documents):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "b b b b b b b"), (7, "a a"), (7, "a a"), (-3, "q q q q q q q")]
    got = sorted(map(tuple, P.op11_periodic_runs(documents(rows)).collect()), key=str)
    want = sorted((row(*r) for r in rows), key=str)
    assert got == want
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 10


def test_general_results(documents):
    (got,) = P.periodic_runs(documents([(1, "go a b a b a b a b on on on on on on now")])).collect()
    assert [tuple(r) for r in got["runs"]] == [(1, 8, 2), (9, 6, 1)] and tuple(got["longest"]) == (9, 6, 1)
    assert got["collapsed"] == "go a b on now"


def test_empty_table(spark, documents):
    assert P.op11_periodic_runs(documents([])).count() == 0


@pytest.mark.parametrize("unit", [1, 7, 250])
def test_a_long_text_of_one_run(unit):
    words = [f"w{i % unit}" for i in range(200_000)]
    ((runs, left),) = P.found_in([" ".join(words).encode()])
    assert runs.tolist() == [[0, 200_000, unit]] and left.split() == [w.encode() for w in words[:unit]]


def test_nothing_is_shuffled(documents, capsys):
    P.op11_periodic_runs(documents([(1, "a")])).explain()
    assert "Exchange" not in capsys.readouterr().out


def test_stuttered_text_keeps_its_length(documents):
    df = documents([(i, " ".join(f"w{j}" for j in range(i))) for i in range(120)])
    for doc_id, text in df.select("doc_id", P.stuttered(df).alias("t")).where(F.col("doc_id") > 0).collect():
        assert text.split() == stuttered(doc_id, " ".join(f"w{j}" for j in range(doc_id)))
