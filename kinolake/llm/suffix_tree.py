"""Language-model scoring with a probabilistic suffix tree over words.

States are contexts of up to ORDER words before a word (a document's first word follows an end). A context is a candidate if
training saw it MIN_CONTEXT times, at every size of the corpus, and is retained if a divergence test says so: the log likelihood that its own
next-word distribution gains over its parent's (the context without its oldest word) on the words seen after it is at least GAIN
nats for each next word it stores. Distributions are smoothed by their parents: next words seen twice or
more are stored, the mass of those seen once (and PRIOR more) goes to the parent; the root is the base unigram
model. A text is scored by the longest retained suffix at each word.

Texts become runs of word numbers once, written to the shared folder and bucketed by run, as the answers are, so later passes move none of them; a
run's words themselves are kept apart and deleted once their owners' numbers are written. The owners number
them, frequent words first; a candidate context of more words gets the number that the owner of its last pair gives it. For each order, runs send their
distinct (context, next word) pairs, counted and packed, to the context's owner and get aligned
counts and numbers back; contexts and next words go as steps between ascending numbers. What is exchanged grows with the corpus and nothing of it goes to the driver but
two totals. A hot context is one entry a run and next word.

Words are lower-cased (A-Z) runs without ASCII white space; every text ends in an end token. Training: documents with crc32(doc_id as text)
mod 10 not 0 (a null doc_id counts as the text ''). Null text is empty (its end alone is scored); repeated rows each count and are each
scored; extra columns change nothing; an empty table gives an empty result; without training rows all scores are those of an empty model (0).
Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, appended, bucketed_pair, byte_texts, mix64, partitions, remove, scratch

ORDER = 3
MIN_CONTEXT = 16
GAIN = 2.0
PRIOR = 4
ALPHA = 0.1
RUN_TOKENS = 2_400_000
END = np.uint64(0x8D12E5A7C34F96B1)

_RUN = pa.schema([("brief", pa.bool_()), ("run", pa.int64()), ("docs", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("lens", pa.list_(pa.int32())), ("ids", pa.binary()), ("last", pa.int32()), ("words", pa.binary()), ("counts", pa.binary())])
_RUN_SQL = "brief boolean, run bigint, docs array<bigint>, held array<boolean>, lens array<int>, ids binary, last int, words binary, counts binary"
_SENT = pa.schema([("bucket", pa.int32()), ("run", pa.int64()), ("contexts", pa.binary()), ("sizes", pa.binary()), ("next", pa.binary()), ("counts", pa.binary()), ("parents", pa.binary())])
_SENT_SQL = "bucket int, run bigint, contexts binary, sizes binary, next binary, counts binary, parents binary"
_BACK = pa.schema([("run", pa.int64()), ("order", pa.int32()), ("bucket", pa.int32()), ("totals", pa.binary()), ("stored", pa.binary()), ("spare", pa.binary()), ("states", pa.binary()), ("n", pa.int64()), ("v", pa.int64())])
_BACK_SQL = "run bigint, order int, bucket int, totals binary, stored binary, spare binary, states binary, n bigint, v bigint"


def _owner(h: np.ndarray, buckets: int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int32)


def _cuts(bucket: np.ndarray) -> list[tuple[int, int]]:
    at = np.flatnonzero(np.diff(bucket)) + 1
    return list(zip([0, *at], [*at, len(bucket)], strict=True)) if len(bucket) else []


def _packed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _unpacked(code: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(code)


def _planes(numbers: np.ndarray, n: int = 6) -> bytes:
    """The n lower bytes of each number, plane by plane, packed."""
    return _packed(numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T.tobytes())


def _from_planes(code: bytes, n: int = 6) -> np.ndarray:
    low = np.frombuffer(_unpacked(code), np.uint8)
    wide = np.zeros((len(low) // n, 8), np.uint8)
    wide[:, :n] = low.reshape(n, -1).T
    return wide.view("<u8").ravel()


def _steps(numbers: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Differences of numbers that ascend in each group; a group's first number (at the places `first`) stays."""
    out = np.diff(numbers, prepend=np.uint64(0))
    out[first] = numbers[first]
    return out


def _from_steps(steps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    sums = np.cumsum(steps, dtype=np.uint64)
    first = np.cumsum(sizes, dtype=np.int64) - sizes
    return sums - np.repeat(sums[first] - steps[first], sizes)


def _narrow(counts: np.ndarray) -> bytes:
    """Counts in one byte each, how many there are before them; from 255 on, in eight bytes behind them; packed."""
    counts = counts.astype("<i8")
    return _packed(len(counts).to_bytes(8, "little") + np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].tobytes())


def _widened(code: bytes) -> np.ndarray:
    code = _unpacked(code)
    n = int.from_bytes(code[:8], "little")
    counts = np.frombuffer(code, np.uint8, n, 8).astype(np.int64)
    counts[counts == 255] = np.frombuffer(code[8 + n :], "<i8")
    return counts


def _order(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The order by high, then low, then place; all three are sorted as one number where they fit in 64 bits."""
    n, m = len(low).bit_length(), int(low.max(initial=0)).bit_length()
    if int(high.max(initial=0)).bit_length() + m + n > 64:
        return np.lexsort((low, high))
    both = high.astype(np.uint64)  # in place from here on, as runs are large
    both <<= np.uint64(m)
    both |= low.astype(np.uint64)
    both <<= np.uint64(n)
    both |= np.arange(len(low), dtype=np.uint64)
    both.sort()
    both &= np.uint64((1 << n) - 1)
    return both.view(np.int64)


def _runs(docs: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """(runs by word number, their words with counts in training, the folder of the words)."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, part, nth = WordHashes(), TaskContext.get().partitionId(), 0
        ids, held, parts, total = [], [], [], 0

        def rows() -> pa.RecordBatch:
            every = np.concatenate(parts)
            words, at = np.unique(every, return_inverse=True)
            lens, run = [len(p) for p in parts], (part << 24) + nth
            counts = np.bincount(at[~np.repeat(np.array(held, bool), lens)], minlength=len(words)).astype("<u4")
            texts = (False, run, ids, held, lens, at.astype("<u4").tobytes(), int(np.searchsorted(words, END)), None, None)
            return _table([texts, (True, run, None, None, None, None, None, words.astype("<u8").tobytes(), counts.tobytes())], _RUN).to_batches()[0]

        for batch in batches:
            for doc_id, out, text in zip(batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), byte_texts(batch.column("text")), strict=True):
                words = text.lower().split()
                h = np.empty(len(words) + 1, np.uint64)
                h[:-1] = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
                h[-1] = END
                ids.append(doc_id)
                held.append(out)
                parts.append(h)
                total += len(h)
                if total >= RUN_TOKENS:
                    yield rows()
                    nth, ids, held, parts, total = nth + 1, [], [], [], 0
        if ids:
            yield rows()

    key = F.coalesce(docs["doc_id"].cast("string"), F.lit("")).cast("binary")
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), (F.crc32(key) % 10 == 0).alias("held_out"), docs["text"].cast("string").alias("text"))
    return bucketed_pair(docs.mapInArrow(runs, _RUN_SQL), "runs", "run")


class _Tokens:
    """A run's tokens with what the owners have answered so far."""

    def __init__(self, run: dict, answers: list[dict], n: int, v: int, buckets: int):
        self.buckets = buckets
        self.ids = np.frombuffer(run["ids"], "<u4").astype(np.int64)
        self.lens = np.array(run["lens"], np.int64)
        self.train = ~np.repeat(np.array(run["held"], bool), self.lens)
        self.first = np.cumsum(self.lens) - self.lens
        by = sorted(answers, key=lambda a: (a["order"], a["bucket"]))
        self.answers = [[a for a in by if a["order"] == k] for k in range(max((a["order"] for a in by), default=-1) + 1)]
        if self.answers:
            self.c = np.concatenate([_widened(a["totals"]) for a in self.answers[0]])
            self.numbers = np.concatenate([_from_planes(a["states"]) for a in self.answers[0]])
            self.end = run["last"]
            self.base = ((self.c + ALPHA) / (n + ALPHA * (v + 1)))[self.ids]
            self.known = (self.c > 0)[self.ids]

    def climb(self, orders: int, meet=None) -> np.ndarray:
        """Follows the tree through the answered orders and returns each token's probability. With meet, the order `orders` isn't
        answered yet: meet(probabilities, tokens, pair of each, first token of each pair, context number of each pair, context, word) is called."""
        p, rank = self.base, np.empty(len(self.numbers), np.uint64)
        rank[np.argsort(self.numbers)] = np.arange(len(self.numbers), dtype=np.uint64)
        rank, bits = rank[self.ids], np.uint64(len(self.numbers).bit_length())
        # names: numbers of the contexts of this order; which: each token's place among them, if live
        names, which = self.numbers, np.empty(len(self.ids), np.int64)
        which[1:] = self.ids[:-1]
        which[self.first] = self.end  # an end stands before a document
        live = (self.c >= MIN_CONTEXT)[which]  # a context of one word is alive by that word's count
        for k in range(1, orders + 1):
            rows = np.flatnonzero(live)
            if not len(rows):
                break
            by = _order(_owner(mix64(names), self.buckets), names)
            place = np.empty(len(by), np.uint64)
            place[by] = np.arange(len(by), dtype=np.uint64)
            rows = rows[_order(place[which[rows]], rank[rows])]
            key = (place[which[rows]] << bits) | rank[rows]
            new = np.concatenate(([True], key[1:] != key[:-1]))
            pair, at = np.cumsum(new) - 1, np.flatnonzero(new)
            context = key[at] >> bits
            group = np.cumsum(np.concatenate(([True], context[1:] != context[:-1]))) - 1
            if meet and k == orders:
                meet(p, rows, pair, at, group, names[by[context.astype(np.int64)]], self.numbers[self.ids[rows[at]]])
                break
            totals, held, spare = (np.concatenate([_widened(a[name]) for a in self.answers[k]]) for name in ("totals", "stored", "spare"))
            use = (spare > 0)[group][pair]
            g, t, own = group[pair][use], np.where(totals >= 2, totals, 0)[pair][use], rows[use]
            p = p.copy()
            p[own] = (t + spare[g] * p[own]) / (held[g] + spare[g])
            # the next order's context at a token is the pair that ends right before it: alive if that was seen often enough
            often, nth = totals >= MIN_CONTEXT, np.zeros(len(self.ids), np.int64)
            nth[rows] = np.where(often, np.cumsum(often), 0)[pair]
            live, which = np.zeros(len(self.ids), bool), np.zeros(len(self.ids), np.int64)
            which[1:] = nth[:-1] - 1
            live[1:] = nth[:-1] > 0
            live[self.first] = False
            names = np.concatenate([np.cumsum(_from_planes(a["states"]), dtype=np.uint64) * np.uint64(self.buckets) + np.uint64(a["bucket"]) for a in self.answers[k]])
        return p


def _send(n: int, v: int, order: int, buckets: int):
    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:  # the owners' totals, which belong to no run
            return _SENT.empty_table()
        (run,) = left.to_pylist()
        tokens = _Tokens(run, right.to_pylist(), n, v, buckets)
        out = []

        def meet(p, rows, pair, at, group, contexts, words) -> None:
            counts = np.bincount(pair, weights=tokens.train[rows], minlength=len(at)).astype("<u4")
            parents = np.clip(np.rint(-4 * np.log2(p[rows][at])), 0, 255).astype(np.uint8)
            owner = _owner(mix64(contexts), buckets)
            for a, b in _cuts(owner):
                first = np.flatnonzero(np.concatenate(([True], group[a + 1 : b] != group[a : b - 1])))
                sizes = np.diff(np.append(first, b - a))
                out.append((int(owner[a]), run["run"], _planes(np.diff(contexts[a:b][first], prepend=np.uint64(0))), _narrow(sizes), _planes(_steps(words[a:b], first)), _narrow(counts[a:b]), _packed(parents[a:b].tobytes())))

        tokens.climb(order, meet)
        return _table(out, _SENT)

    return send


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    if not rows:
        return schema.empty_table()
    return pa.table([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _count_words(buckets: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in batch.to_pylist():
                words, counts = np.frombuffer(run["words"], "<u8"), np.frombuffer(run["counts"], "<u4")
                rows = [(int(_owner(words[a : a + 1], buckets)[0]), run["run"], words[a:b].tobytes(), b"", b"", _narrow(counts[a:b]), b"") for a, b in _cuts(_owner(words, buckets))]
                yield from _table(rows, _SENT).to_batches()

    return send


def _own_words(buckets: int):
    """Counts words, numbers them (an owner's most frequent word first, owners in turn) and answers each run with totals and numbers of its words."""

    def own(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        bucket = rows[0]["bucket"]
        words = [np.frombuffer(r["contexts"], "<u8") for r in rows]
        every, at = np.unique(np.concatenate(words), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate([_widened(r["counts"]) for r in rows]), minlength=len(every)).astype(np.int64)
        number = np.empty(len(every), np.uint64)
        number[np.argsort(-total, kind="stable")] = np.arange(len(every), dtype=np.uint64) * np.uint64(buckets) + np.uint64(bucket)
        ends = np.cumsum([len(w) for w in words])
        out = [(r["run"], 0, bucket, _narrow(total[at[e - len(w) : e]]), b"", b"", _planes(number[at[e - len(w) : e]]), None, None) for r, w, e in zip(rows, words, ends, strict=True)]
        return _table([*out, (None, 0, bucket, b"", b"", b"", b"", int(total.sum()), int((total > 0).sum()))], _BACK)

    return own


def _own_contexts(order: int):
    """Counts pairs, tests contexts, and answers each run: totals of its pairs, 0 where neither its context nor the next order uses them;
    stored and spare mass of its contexts, 0 if not retained; numbers of the pairs that are candidates of the next order, as steps."""

    def own(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        ctx = [np.cumsum(_from_planes(r["contexts"]), dtype=np.uint64) for r in rows]
        sizes = [_widened(r["sizes"]) for r in rows]
        names, which = np.unique(np.concatenate(ctx), return_inverse=True)
        group = np.repeat(which, np.concatenate(sizes))
        nxt = np.concatenate([_from_steps(_from_planes(r["next"]), s) for r, s in zip(rows, sizes, strict=True)])
        counts = np.concatenate([_widened(r["counts"]) for r in rows])
        parents = np.concatenate([np.frombuffer(_unpacked(r["parents"]), np.uint8) for r in rows])
        sort = _order(group, nxt)
        g, x = group[sort], nxt[sort]
        new = np.concatenate(([True], (g[1:] != g[:-1]) | (x[1:] != x[:-1])))
        first = np.flatnonzero(new)
        total = np.add.reduceat(counts[sort], first)
        g, parent = g[first], np.exp2(parents[sort][first].astype(np.float64) / -4.0)
        many = total >= 2
        held = np.bincount(g, weights=np.where(many, total, 0), minlength=len(names))
        once = np.bincount(g, weights=total == 1, minlength=len(names))
        spare = once + PRIOR
        own_p = (np.where(many, total, 0) + spare[g] * parent) / (held[g] + spare[g])
        gain = np.bincount(g, weights=total * np.log(own_p / parent), minlength=len(names))
        n_stored = np.bincount(g, weights=many, minlength=len(names))
        keep = (held + once >= MIN_CONTEXT) & (n_stored > 0) & (gain >= GAIN * n_stored)
        held, spare = np.where(keep, held, 0), np.where(keep, spare, 0)
        total = np.where((total >= MIN_CONTEXT) | (many & keep[g]), total, 0)
        nth = np.cumsum(total >= MIN_CONTEXT) - 1
        place = np.empty(len(group), np.int64)
        place[sort] = np.cumsum(new) - 1
        out, pe, ce = [], 0, 0
        for r, c, s in zip(rows, ctx, sizes, strict=True):
            mine, own_c = place[pe : pe + int(s.sum())], which[ce : ce + len(c)]
            pe, ce = pe + len(mine), ce + len(c)
            states = nth[mine[total[mine] >= MIN_CONTEXT]].astype(np.uint64)
            out.append((r["run"], order, r["bucket"], _narrow(total[mine]), _narrow(held[own_c]), _narrow(spare[own_c]), _planes(np.diff(states, prepend=np.uint64(0))), None, None))
        return _table(out, _BACK)

    return own


_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
_SCORES_SQL = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _score(n: int, v: int, orders: int, buckets: int):
    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _SCORES.empty_table()
        (run,) = left.to_pylist()
        tokens = _Tokens(run, right.to_pylist(), n, v, buckets)
        p = tokens.climb(orders)
        per = lambda x: np.add.reduceat(x, tokens.first)
        return pa.table([pa.array(run["docs"], pa.int64()), pa.array(run["held"], pa.bool_()), pa.array(tokens.lens), pa.array(per(tokens.known.astype(np.int64))), pa.array(np.full(len(tokens.lens), n, np.int64)), pa.array(per(np.log10(tokens.base))), pa.array(per(np.log10(p)))], schema=_SCORES)

    return score


def score_texts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    buckets = 2 * partitions(spark)
    runs, counted, folder = _runs(docs)
    name, path = f"kinolake_answers_{uuid.uuid4().hex}", scratch(spark, "answers")
    answered = lambda df, owner: appended(df.groupBy("bucket").applyInArrow(owner, _BACK_SQL), name, path, "run")
    try:
        answers = answered(counted.mapInArrow(_count_words(buckets), _SENT_SQL), _own_words(buckets))
        remove(spark, folder)
        n, v = answers.where("run is null").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
        for k in range(1, order + 1):
            sent = runs.groupBy("run").cogroup(answers.groupBy("run")).applyInArrow(_send(int(n), int(v), k, buckets), _SENT_SQL)
            answers = answered(sent, _own_contexts(k))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return runs.groupBy("run").cogroup(answers.groupBy("run")).applyInArrow(_score(int(n), int(v), order, buckets), _SCORES_SQL)
