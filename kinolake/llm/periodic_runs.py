"""Periodic run detection by Karp-Miller-Rosenberg naming.

A run is a stretch of consecutive words with smallest period q, at least max(LEAST, TIMES * q) words long, that no neighbouring word extends keeping
period q. Words are numbered per text; level k then names all stretches of 2 ** k words by sorting pairs of level k - 1 names, exactly and
without hashes. A name that occurs once in its text stays unique at every further level, so only repeated ones are sorted again and naming ends at the
first level without any. How far two places agree (forwards and backwards) is read off the names by descending levels.

Candidates are pairs (i, i + q) for i on the grid of multiples of q. In a run of at least 4 q words, words q apart agree at 3 q places or more running
(5 for q = 1), so some grid place has 4 agreeing places from it on: only grid places whose 4-word names agree are extended. The
stretch found is maximal for q. A stretch whose smallest period is a divisor of q is found with that divisor too (it has 4 q words, Fine and Wilf), so
of equal stretches the smallest q is the period. n words have about n ln(n / 4) candidates, taken in blocks of CHUNK.

All work is inside texts: rows are mapped where they lie, nothing is shuffled. Memory grows with a batch of texts (WORDS words) or one longer text:
about 60 bytes a word, and 4 a word and level.

Edges: null and empty texts have no words; a null doc_id is treated like any other row; repeated rows each give their row; ties of the longest exponent
go to the smallest start, then period. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, byte_texts, text_of

LEAST = 6
TIMES = 4
#: Words that are named together.
WORDS = 200_000
#: Candidate pairs that are looked at together.
CHUNK = 1_000_000
#: Runs of 4 words are level 2; a run's candidates agree on one.
SEED = 2


def names(words: np.ndarray, text: np.ndarray) -> list[np.ndarray]:
    """Names by level: two places have equal names at level k if their texts are the same and so are the 2 ** k words from them on, all inside the text. A place
    without an equal one has a negative name of its own. words: numbers of words; text: the number of each word's text, ascending."""
    n = len(words)
    own = -1 - np.arange(n, dtype=np.int64)
    end = np.searchsorted(text, text, side="right")
    name = own.copy()
    live = np.arange(n)
    key = text.astype(np.int64) * (int(words.max(initial=0)) + 1) + words
    levels: list[np.ndarray] = []
    while True:
        _, which, count = np.unique(key, return_inverse=True, return_counts=True)
        often = count[which] > 1
        live, which = live[often], which[often]
        name = own.copy()
        name[live] = which
        if not len(live):
            return levels
        levels.append(name)
        # a stretch of twice the length repeats only where both halves do
        half = 1 << (len(levels) - 1)
        live = live[live + 2 * half <= end[live]]
        live = live[name[live + half] >= 0]
        key = name[live] * (n + 1) + name[live + half]


def forwards(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Words that agree from places i and j on (i < j)."""
    n, i, j = len(levels[0]), i.copy(), j.copy()
    start = i.copy()
    for k in range(len(levels) - 1, -1, -1):
        inside = np.minimum(j, n - 1)
        step = (levels[k][np.minimum(i, n - 1)] == levels[k][inside]) & (j < n)
        i += step << k
        j += step << k
    return i - start


def backwards(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Words that agree before places i and j (i < j)."""
    i, j = i.copy(), j.copy()
    start = i.copy()
    for k in range(len(levels) - 1, -1, -1):
        a, b = i - (1 << k), j - (1 << k)
        step = (levels[k][np.maximum(a, 0)] == levels[k][np.maximum(b, 0)]) & (a >= 0)
        i -= step << k
        j -= step << k
    return start - i


def grid(lo: int, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, periods) of the candidates of a text of n words from place lo on, in blocks of about CHUNK, small periods first."""
    q = 1
    while q <= n // TIMES:
        # periods q to r - 1 have about n / q places each
        r = min(n // TIMES + 1, q + max(1, CHUNK * q // n))
        periods = np.arange(q, r)
        each = -(-(n - periods) // periods)
        period = np.repeat(periods, each)
        nth = np.arange(len(period)) - np.repeat(np.cumsum(each) - each, each)
        yield lo + nth * period, period
        q = r


def runs_of(levels: list[np.ndarray], lo: int, n: int) -> np.ndarray:
    """The runs (start, length, period) of the text of n words at place lo, by start, then period; starts count from the text's first word."""
    found = np.empty((0, 3), np.int64)
    if n < LEAST or len(levels) <= SEED or not (levels[SEED][lo : lo + n] >= 0).any():
        return found
    seeds = levels[SEED]
    for i, q in grid(lo, n):
        same = (seeds[i] >= 0) & (seeds[i] == seeds[i + q])
        i, q = i[same], q[same]
        start = i - backwards(levels, i, i + q)
        length = i + q + forwards(levels, i, i + q) - start
        enough = length >= np.maximum(LEAST, TIMES * q)
        found = np.concatenate([found, np.stack([start[enough] - lo, length[enough], q[enough]], axis=1)])
        found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
        first = np.ones(len(found), bool)
        first[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
        found = found[first]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def longest(runs: np.ndarray) -> tuple[int, int, int] | None:
    """The run of greatest exponent (length by period), of equals that of the smallest start, then period."""
    if not len(runs):
        return None
    ratio = runs[:, 1] / runs[:, 2]
    near = runs[ratio >= ratio.max() * (1 - 1e-9)]
    return tuple(max(near.tolist(), key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])))


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which words stay: all but those that lie in some run after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:n]) == 0


def found_in(texts: list[bytes]) -> Iterator[tuple[np.ndarray, bytes]]:
    """Of each text its runs and what stays of it, words joined by single blanks."""
    number: dict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    split = [t.split() for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    words = np.fromiter((number[w] for own in split for w in own), np.int64, int(sizes.sum()))
    levels = names(words, np.repeat(np.arange(len(texts)), sizes))
    lo = 0
    for own, n in zip(split, sizes.tolist(), strict=True):
        runs = runs_of(levels, lo, n)
        left = own if not len(runs) else [own[i] for i in np.flatnonzero(kept_words(n, runs)).tolist()]
        yield runs, b" ".join(left)
        lo += n


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = byte_texts(batch.column("text"))
        at = 0
        while at < len(texts):
            # about 6 bytes a word; one longer text is a block of its own
            to, size = at + 1, len(texts[at])
            while to < len(texts) and size + len(texts[to]) <= 6 * WORDS:
                size += len(texts[to])
                to += 1
            rows = [(runs, longest(runs), left) for runs, left in found_in(texts[at:to])]
            flat = np.concatenate([r for r, _, _ in rows])
            ends = np.concatenate([[0], np.cumsum([len(r) for r, _, _ in rows])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], fields=list(RUN)))
            best = pa.array([None if b is None else dict(zip(("start", "length", "period"), b, strict=True)) for _, b, _ in rows], RUN)
            left = pa.array([x for _, _, x in rows], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, to - at), lists, best, left], ["doc_id", "runs", "longest", "collapsed"])
            at = to


def periodic_runs(docs: DataFrame, text: Column | None = None) -> DataFrame:
    """One row per document: doc_id, runs (all of them by start, then period), longest (the one of greatest exponent, null without runs), collapsed (the words
    that no run repeats, joined by single blanks). `text` in place of the column of that name."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), (text_of(docs) if text is None else text).alias("text"))
    run = "struct<start:bigint,length:bigint,period:bigint>"
    return rows.mapInArrow(_batches, f"doc_id bigint, runs array<{run}>, longest {run}, collapsed string")


def stuttered(docs: DataFrame) -> Column:
    """The texts with planted periods: with h the crc32 of the decimal doc_id and g = h div 10, every text with h mod 10 = 0 repeats, from word a = g mod n
    on, its 1 + (n - a) div (3 + g mod 8) words from there, to its old length. A null doc_id has no h: its text stays."""
    h = F.crc32(docs["doc_id"].cast("string").cast("binary"))
    g = F.floor(h / 10)

    def planted(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + (i - a) % p).cast("int")))), " ")

    # a one-element array evaluates the words once
    words = F.array(F.regexp_extract_all(text_of(docs), F.lit(WORD), F.lit(0)))
    changed = F.transform(words, lambda w: F.when(F.size(w) > 0, planted(w)).otherwise(""))[0]
    return F.when(h % 10 == 0, changed).otherwise(text_of(docs))


def op11_periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256."""
    found = periodic_runs(docs, stuttered(docs))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    milli = F.call_function("div", F.col("longest.length") * 1000, F.col("longest.period"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "longest.start", "longest.length", "longest.period", milli.alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
