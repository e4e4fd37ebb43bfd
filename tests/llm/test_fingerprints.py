import hashlib
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from kinolake.llm import fingerprints as O

SIGN = 1 << 63


def chain(values):
    """Spark's xxhash64 of several values: each one's hash is the next one's seed."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v, seed=h)
    return h


def number(*values):
    return chain([v.to_bytes(k, "little", signed=True) for v, k in values])


def model(text):
    """The fingerprint by another way: dictionaries instead of sorted arrays."""
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
    if not words:
        return ""
    least = {}
    for i in range(max(1, len(words) - 4)):
        h = chain(words[i : i + 5]) >> 1
        b = h >> O.REST
        least[b] = min(least.get(b, h), h)
    signed = lambda h: h - (1 << 64) if h >= SIGN else h
    out = 0
    for i in range(O.BINS):
        at = i
        if i not in least:
            probes = (number((i, 4), (r, 4)) % O.BINS for r in range(O.PROBES))
            at = next((p for p in probes if p in least), None)
            if at is None:
                at = min(least, key=lambda b: signed(number((i, 4), (b, 8))))
        out = out << O.BITS | least[at] % (1 << O.BITS)
    return f"{out:0{O.BINS * O.BITS // 4}x}"


def near(one, other):
    if not one or not other:
        return float(one == other)
    same = sum(a == b for a, b in zip(one, other, strict=True)) / O.BINS
    return max(0.0, (same - 1 / 16) / (1 - 1 / 16))


def made():
    rnd = random.Random(6)
    texts = [None, "", " \n", "One", "one", "a b c d", "a b c d e", "A B c d é", "x" * 5000]
    texts += [" ".join(rnd.choice(["the", "Sea", "of", "ßtorm", "日本", "is", "wide"]) for _ in range(rnd.randrange(1, 90))) for _ in range(40)]
    texts.append(" ".join(f"w{rnd.randrange(10**6)}" for _ in range(9000)))
    return texts


def test_fingerprints_against_another_model(documents):
    texts = made()
    df = O.fingerprints(documents(list(enumerate(texts))))
    got = {r[0]: r[1] for r in df.select("doc_id", O.as_hex(F.col("fingerprint"))).collect()}
    assert got == {i: model(t) for i, t in enumerate(texts)}


def want(rows):
    keyed = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), xxhash.xxh64_intdigest((r[1] or "").encode(), seed=42) ^ SIGN, (r[1] or "").encode()))
    out = []
    for k, (doc_id, text) in enumerate(keyed):
        text, nxt = text or "", keyed[(k + 1) % len(keyed)][1] or ""
        cut = len(text) // 2
        edited = text[: len(text) - cut] + nxt[:cut]
        a, b, c = model(text), model(edited), model(nxt)
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, round(near(a, b), 9), round(near(a, c), 9)))
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [1, 2, 60])
def test_query_against_brute_force(documents, n):
    texts = made()
    rows = [(i * 37 % 1009 - 300, texts[i % len(texts)]) for i in range(n)]
    if n > 2:
        rows += [(None, "last of all"), (None, None), (5, "twice"), (5, "twice"), (5, "thrice")]
    got = [(*r[:5], round(r[5], 9), round(r[6], 9)) for r in O.op13_fingerprints(documents(rows)).collect()]
    assert sorted(got, key=str) == want(rows)


def test_likeness_is_close_to_jaccard(documents):
    rnd = random.Random(1)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(3000)]
    pairs = []
    for share in (0.0, 0.2, 0.5, 0.8, 0.95, 1.0):
        other = base[: int(share * 3000)] + [f"v{rnd.randrange(10**6)}" for _ in range(3000 - int(share * 3000))]
        pairs.append((base, other))
    rows = [(k, " ".join(w)) for k, w in enumerate(x for p in pairs for x in p)]
    got = {r["doc_id"]: r["fingerprint"] for r in O.fingerprints(documents(rows)).collect()}
    spark = documents([]).sparkSession
    df = spark.createDataFrame([(k, got[2 * k], got[2 * k + 1]) for k in range(len(pairs))], "k int, a array<bigint>, b array<bigint>")
    sets = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    for k, est in df.select("k", O.likeness(F.col("a"), F.col("b"))).collect():
        a, b = map(sets, pairs[k])
        assert abs(est - len(a & b) / len(a | b)) < 0.08


def test_small_sets_are_estimated_without_bias(documents):
    """Texts of few shingles live from densification alone: over many of them the mean error is near nothing."""
    rnd = random.Random(8)
    rows, truth = [], []
    for k in range(150):
        a = [f"w{rnd.randrange(10**6)}" for _ in range(20)]
        b = a[:13] + [f"v{rnd.randrange(10**6)}" for _ in range(7)]
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
        truth.append(9 / 23)
    got = {r["doc_id"]: r["fingerprint"] for r in O.fingerprints(documents(rows)).collect()}
    df = documents([]).sparkSession.createDataFrame([(got[2 * k], got[2 * k + 1]) for k in range(150)], "a array<bigint>, b array<bigint>")
    est = [r[0] for r in df.select(O.likeness(F.col("a"), F.col("b"))).collect()]
    assert abs(sum(est) / 150 - 9 / 23) < 0.04


def test_no_python_in_the_plan(documents, capsys):
    O.op13_fingerprints(documents([(1, "a"), (2, "b")])).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_empty_table(documents):
    assert O.op13_fingerprints(documents([])).count() == 0
