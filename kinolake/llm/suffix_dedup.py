"""Removal of repeated byte strings by merged Burrows-Wheeler transforms.

Every byte covered by a string of LENGTH bytes that also starts in a document with a smaller doc_id goes.

1. Texts become runs once, written to the shared folder and bucketed by run, so later passes move none of them. Each string of LENGTH bytes has
   anchors: its GRAM-byte grams of the smallest hash. The content alone determines them, so equal strings have equal anchors.
2. Runs send their distinct anchor hashes to owners and learn which occur in more than one document. Only around those can
   strings repeat; an anchor in a third of all documents is one entry a run. Anchors in HOT documents of one run, or in HOT runs, are
   hot: their strings are settled one by one, each a hash that its own owner compares, so no task gathers a hot anchor's surroundings.
3. Around any other repeated anchor, a run takes the segment of all strings that have it (under 2 * LENGTH bytes), collapses equal segments to the
   smallest doc_id, and sends their hashes to the anchor's owner, which answers whether an equal segment is in a smaller document, and whether the
   anchor has several segments. Only of those are the bytes sent, each once, by the run of its smallest document. They are a shard for each run: its
   suffixes are sorted and its Burrows-Wheeler transform taken; the shards' transforms are merged by interleave refinement: the interleave starts as
   the shards in a row, and each round deals its positions by the character before them, keeping order, which sorts the suffixes by one more
   character (Holt and McMillan). Positions whose blocks split in round k have a common prefix of k - 1; after LENGTH rounds the blocks are the
   repeated intervals of LCP >= LENGTH. No suffix of the union is compared again. The smallest doc_id in an interval decides.
4. Runs get one bit for each string of each such segment, and cut the covered bytes.

Null text is empty. A null doc_id counts as larger than all others, so it never causes a removal; rows of one doc_id cause none in each
other. Matches never cross documents; extra columns change nothing; an empty table gives an empty result. Anchors, and segments inside a
run or owner, are told apart by 64-bit hashes; strings in the merge by their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, byte_texts, mix64, partitions, stored

LENGTH = 50
GRAM = 26
WINDOWS = LENGTH - GRAM + 1
RUN_BYTES = 6_000_000
HOT = 64
#: Segments merged at once; anchors are never cut apart.
MERGE = 20_000
_NULL = np.iinfo(np.int64).max
_ALL, _SEVERAL = 1, 2
_EVERY = np.uint32((1 << WINDOWS) - 1)
_R = np.uint64(0x9E3779B97F4A7C15)
_R_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[int, np.ndarray] = {}

_RUN_SQL = "run bigint, docs array<bigint>, lens array<bigint>, text binary, anchors binary, low binary, high binary"
_SENT = pa.schema([("bucket", pa.int32()), ("run", pa.int64()), ("hashes", pa.binary()), ("marks", pa.binary()), ("lens", pa.binary()), ("bytes", pa.binary()), ("docs", pa.binary())])
_SENT_SQL = "bucket int, run bigint, hashes binary, marks binary, lens binary, bytes binary, docs binary"
_BACK = pa.schema([("run", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("answer", pa.binary())])
_BACK_SQL = "run bigint, kind int, bucket int, answer binary"


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    if not rows:
        return schema.empty_table()
    return pa.table([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _owner(h: np.ndarray, buckets: int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int32)


def _cuts(bucket: np.ndarray) -> list[tuple[int, int]]:
    at = np.flatnonzero(np.diff(bucket)) + 1
    return list(zip([0, *at], [*at, len(bucket)], strict=True)) if len(bucket) else []


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0, base ** 1, ... modulo 2 ** 64; kept for the next run."""
    if len(_POWERS.get(int(base), ())) < n:
        row = np.full(max(n, RUN_BYTES * 5 // 4), base, np.uint64)
        row[0] = 1
        _POWERS[int(base)] = np.cumprod(row, dtype=np.uint64)
    return _POWERS[int(base)][:n]


def _sliding(x: np.ndarray, k: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) over each k consecutive values."""
    done, out = 1, x
    while done < k:
        step = min(done, k - done)
        out = best(out[: len(out) - step], out[step:])
        done += step
    return out


def anchors(text: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, low, high): where the anchors are, and that the strings starting at place - low to place - high have each."""
    none = np.empty(0, np.int64), np.empty(0, np.uint8), np.empty(0, np.uint8)
    if len(text) < LENGTH:
        return none
    # sums of bytes times R ** -place; a gram's difference of two, times R ** place, is a hash of its bytes alone
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(text * _powers(_R_INVERSE, len(text)), dtype=np.uint64)))
    h = (sums[GRAM:] - sums[:-GRAM]) * _powers(_R, len(text))[: len(text) - GRAM + 1]
    h = np.maximum(mix64(h), np.uint64(1))
    least = _sliding(h, WINDOWS, np.minimum)  # of the string that starts here
    ends = np.cumsum(lens)
    inside = np.arange(len(least)) + LENGTH <= np.repeat(ends, lens)[: len(least)]
    least[~inside] = 0
    padded = np.concatenate((np.zeros(WINDOWS - 1, np.uint64), least, np.zeros(WINDOWS - 1, np.uint64)))
    most = _sliding(padded, WINDOWS, np.maximum)  # over the strings that hold this gram
    places = np.flatnonzero(h == most[: len(h)])
    own = h[places]
    low, high = np.zeros(len(places), np.uint8), np.full(len(places), 255, np.uint8)
    for o in range(WINDOWS):
        has = padded[places + (WINDOWS - 1 - o)] == own
        low[has] = o
        high[has & (high == 255)] = o
    return places, low, high


def _runs(docs: DataFrame) -> DataFrame:
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth, ids, texts, total = TaskContext.get().partitionId(), 0, [], [], 0

        def row() -> pa.RecordBatch:
            whole, lens = b"".join(texts), [len(t) for t in texts]
            text = np.frombuffer(whole, np.uint8)
            places, low, high = anchors(text, np.array(lens, np.int64))
            marks = np.zeros(len(text), np.uint8)
            marks[places] = 1
            one = lambda v, kind: pa.array([v], kind)
            return pa.record_batch({"run": one((part << 24) + nth, pa.int64()), "docs": one(ids, pa.list_(pa.int64())), "lens": one(lens, pa.list_(pa.int64())), "text": one(whole, pa.binary()), "anchors": one(np.packbits(marks).tobytes(), pa.binary()), "low": one(low.tobytes(), pa.binary()), "high": one(high.tobytes(), pa.binary())})

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), byte_texts(batch.column("text")), strict=True):
                ids.append(doc_id)
                texts.append(text)
                total += len(text)
                if total >= RUN_BYTES:
                    yield row()
                    nth, ids, texts, total = nth + 1, [], [], 0
        if ids:
            yield row()

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return bucketed(rows.mapInArrow(runs, _RUN_SQL), "bytes", "run")


class _Run:
    def __init__(self, row: dict):
        self.name, self.text = row["run"], np.frombuffer(row["text"], np.uint8)
        self.lens = np.array(row["lens"], np.int64)
        self.docs = np.array([_NULL if d is None else d for d in row["docs"]], np.int64)
        self.ids = row["docs"]
        self.places = np.flatnonzero(np.unpackbits(np.frombuffer(row["anchors"], np.uint8)))[: len(row["low"])]
        self.low, self.high = np.frombuffer(row["low"], np.uint8).astype(np.int64), np.frombuffer(row["high"], np.uint8).astype(np.int64)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.text * _powers(_R_INVERSE, len(self.text)), dtype=np.uint64)))
        self.hashes = self.hash(self.places, GRAM)
        self.doc_of = np.searchsorted(np.cumsum(self.lens), self.places, "right")

    def hash(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """Hashes of the bytes at start alone."""
        return mix64((self.sums[start + size] - self.sums[start]) * _powers(_R, len(self.text) + 1)[start])

    def distinct(self, hot: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sorted distinct hashes, whether one occurs in more than one document, whether in `hot` or more)."""
        if not len(self.hashes):
            return self.hashes, np.empty(0, bool), np.empty(0, bool)
        order = np.lexsort((self.doc_of, self.hashes))
        h, d = self.hashes[order], self.doc_of[order]
        new = np.concatenate(([True], h[1:] != h[:-1]))
        first = np.flatnonzero(new)
        docs = np.add.reduceat((new | np.concatenate(([True], d[1:] != d[:-1]))).astype(np.int64), first)
        ids = self.docs[d]
        return h[first], np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first), docs >= hot

    def windows(self, hot: np.ndarray):
        """Strings of hot anchors: (starts, distinct string of each, hashes of the distinct ones in order, smallest doc_id of each)."""
        use = np.flatnonzero(np.isin(self.hashes, hot))
        counts = self.low[use] - self.high[use] + 1
        first = np.cumsum(counts) - counts
        starts = np.unique(np.repeat(self.places[use] - self.low[use], counts) + np.arange(counts.sum()) - np.repeat(first, counts))
        if not len(starts):
            return starts, starts, np.empty(0, np.uint64), starts
        h = self.hash(starts, LENGTH)
        docs = self.docs[np.searchsorted(np.cumsum(self.lens), starts, "right")]
        names, which = np.unique(h, return_inverse=True)
        least = np.full(len(names), _NULL, np.int64)
        np.minimum.at(least, which, docs)
        return starts, which, names, least

    def segments(self, repeated: np.ndarray):
        """(anchors, segment of each, segments' anchor hash, content hash, start, length, smallest doc_id), segments in the order of anchor hash, then content."""
        use = np.flatnonzero(np.isin(self.hashes, repeated))
        start = self.places[use] - self.low[use]
        size = self.low[use] - self.high[use] + LENGTH
        content = self.hash(start, size) ^ (size * 256 + self.low[use]).astype(np.uint64)
        order = np.lexsort((content, self.hashes[use]))
        use, start, size, content = use[order], start[order], size[order], content[order]
        h = self.hashes[use]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (content[1:] != content[:-1]))) if len(use) else np.empty(0, bool)
        first = np.flatnonzero(new)
        least = np.minimum.reduceat(self.docs[self.doc_of[use]], first) if len(use) else np.empty(0, np.int64)
        return use, np.cumsum(new) - 1, h[first], content[first], start[first], size[first], least


def _send_anchors(buckets: int, hot: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                h, several, many = _Run(row).distinct(hot)
                bucket = _owner(h, buckets)
                yield from _table([(int(bucket[a]), row["run"], h[a:b].astype("<u8").tobytes(), np.packbits(several[a:b]).tobytes(), b"", np.packbits(many[a:b]).tobytes(), b"") for a, b in _cuts(bucket)], _SENT).to_batches()

    return send


def _own_anchors(hot: int):
    def own(t: pa.Table) -> pa.Table:
        """Answers of kind 0: the run's repeated anchors that aren't hot; of kind 2: its hot ones."""
        rows = t.to_pylist()
        h = [np.frombuffer(r["hashes"], "<u8") for r in rows]
        bits = lambda name: np.concatenate([np.unpackbits(np.frombuffer(r[name], np.uint8))[: len(x)] for r, x in zip(rows, h, strict=True)]).astype(bool)
        names, which, runs = np.unique(np.concatenate(h), return_inverse=True, return_counts=True)
        several, many = np.zeros(len(names), bool), runs >= hot
        several[which[bits("marks")]] = True
        many[which[bits("bytes")]] = True
        repeated = (runs > 1) | several
        kind = np.where(repeated & many, 2, np.where(repeated, 0, -1))[which]
        ends = np.cumsum([len(x) for x in h])
        return _table([(r["run"], k, r["bucket"], x[kind[e - len(x) : e] == k].tobytes()) for r, x, e in zip(rows, h, ends, strict=True) for k in (0, 2)], _BACK)

    return own


def _send_segments(buckets: int):
    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        (row,) = left.to_pylist()
        run, out = _Run(row), []
        _, _, h, content, _, _, least = run.segments(_answers(right, 0))
        _, _, names, firsts = run.windows(_answers(right, 2))
        for keys, more, docs in ((h, content, least), (names, None, firsts)):
            bucket = _owner(keys, buckets)
            for a, b in _cuts(bucket):
                out.append((int(bucket[a]), row["run"], keys[a:b].astype("<u8").tobytes(), b"" if more is None else more[a:b].astype("<u8").tobytes(), b"", b"", docs[a:b].astype("<i8").tobytes()))
        return _table(out, _SENT)

    return send


def _send_bytes(buckets: int):
    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        (row,) = left.to_pylist()
        run, out = _Run(row), []
        _, _, h, _, start, size, least = run.segments(_answers(right, 0))
        wanted = np.flatnonzero(_answers(right, 1) == _SEVERAL)
        h, start, size, least = h[wanted], start[wanted], size[wanted], least[wanted]
        bucket, whole = _owner(h, buckets), run.text.tobytes()
        for a, b in _cuts(bucket):
            text = b"".join([whole[s : s + n] for s, n in zip(start[a:b].tolist(), size[a:b].tolist(), strict=True)])
            out.append((int(bucket[a]), row["run"], h[a:b].astype("<u8").tobytes(), b"", size[a:b].astype(np.uint8).tobytes(), text, least[a:b].astype("<i8").tobytes()))
        return _table(out, _SENT)

    return send


def _answers(t: pa.Table, kind: int) -> np.ndarray:
    rows = sorted((r for r in t.select(["kind", "bucket", "answer"]).to_pylist() if r["kind"] == kind), key=lambda r: r["bucket"])
    form = {0: "<u8", 1: "u1", 2: "<u8", 3: "u1", 4: "<u4"}[kind]
    return np.concatenate([np.frombuffer(r["answer"], form) for r in rows]) if rows else np.empty(0, form)


def shard_bwt(strings: list[bytes], first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, transform): suffix numbers count on from first[i] for string i, its end included; the transform has the character before each,
    as byte + 1 (UTF-8 has no byte 255), 0 where a string begins."""
    lens = np.array([len(s) for s in strings], np.int64)
    width = int(lens.max())
    flat = np.frombuffer(b"".join(strings), np.uint8) + np.uint8(1)
    base = np.cumsum(lens) - lens
    which = np.repeat(np.arange(len(strings)), lens)
    offset = np.arange(len(flat)) - base[which]
    padded = np.concatenate((flat, np.zeros(width, np.uint8)))
    suffix = np.lib.stride_tricks.sliding_window_view(padded, width)[: len(flat)].copy()
    suffix[np.arange(width) >= (lens[which] - offset)[:, None]] = 0
    order = np.argsort(suffix.view(f"S{width}").ravel(), kind="stable")
    ends = np.arange(len(strings))
    which, offset = np.concatenate((ends, which[order])), np.concatenate((lens, offset[order]))
    before = np.where(offset > 0, flat[np.maximum(base[which] + offset - 1, 0)], 0).astype(np.uint8)
    return first[which] + offset, before


def merge_bwts(shards: list[tuple[np.ndarray, np.ndarray]], total: int, rounds: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Repeated intervals of the union: (suffixes, block of each), those that share their first `rounds` characters with another.

    The interleave starts as the shards in a row. A round deals its places by the character before them, keeping order: that is the order of the
    suffixes one character longer. Places alone in their block are settled, and so is what lies before them: they leave."""
    place = np.concatenate([s for s, _ in shards])
    before = np.empty(total, np.uint8)
    before[place] = np.concatenate([b for _, b in shards])
    block = np.zeros(len(place), np.int64)
    for _ in range(rounds):
        c = before[place]
        rest = np.flatnonzero(c)
        order = rest[np.argsort(c[rest], kind="stable")]
        c, place, block = c[order], place[order] - 1, block[order]
        if not len(place):
            break
        new = np.concatenate(([True], (c[1:] != c[:-1]) | (block[1:] != block[:-1])))
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(place)))
        several = np.repeat(size > 1, size)
        place, block = place[several], (np.cumsum(new) - 1)[several]
    return place, block


def merged_least(strings: list[bytes], docs: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """For each string and each of its places (WINDOWS columns), the smallest document that holds its next LENGTH bytes."""
    least = np.repeat(docs[:, None], WINDOWS, axis=1)
    lens = np.array([len(s) + 1 for s in strings], np.int64)
    first = np.cumsum(lens) - lens
    parts = []
    for s in np.unique(shard):
        own = np.flatnonzero(shard == s)
        parts.append(shard_bwt([strings[i] for i in own.tolist()], first[own]))
    place, block = merge_bwts(parts, int(lens.sum()))
    if len(place):
        which = np.searchsorted(first, place, "right") - 1
        start = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
        least[which, place - first[which]] = np.repeat(np.minimum.reduceat(docs[which], start), np.diff(np.append(start, len(place))))
    return least


def _split(values: np.ndarray, rows: list[dict], kind: int) -> list[tuple]:
    """One answer for each row, as long as its docs."""
    ends = np.cumsum([len(r["docs"]) // 8 for r in rows])
    return [(r["run"], kind, r["bucket"], values[e - len(r["docs"]) // 8 : e].tobytes()) for r, e in zip(rows, ends, strict=True)]


def _own_segments(t: pa.Table) -> pa.Table:
    """Answers of kind 1: for each segment of a run, _ALL if an equal one is in a smaller document, else _SEVERAL if its anchor has several segments, else
    0; of kind 3: for each string of a hot anchor, 1 if it starts in a smaller document elsewhere."""
    every, out = t.to_pylist(), []
    for kind in (1, 3):
        rows = [r for r in every if bool(r["marks"]) == (kind == 1)]
        if not rows:
            continue
        h = np.concatenate([np.frombuffer(r["hashes"], "<u8") for r in rows])
        docs = np.concatenate([np.frombuffer(r["docs"], "<i8") for r in rows])
        content = np.concatenate([np.frombuffer(r["marks"], "<u8") for r in rows]) if kind == 1 else h
        order = np.lexsort((docs, content, h))
        hs, cs = h[order], content[order]
        new_h = np.concatenate(([True], hs[1:] != hs[:-1]))
        new = new_h | np.concatenate(([True], cs[1:] != cs[:-1]))
        least = docs[order][np.flatnonzero(new)][np.cumsum(new) - 1]
        answer = np.where(least < docs[order], _ALL, 0)
        if kind == 1:
            group = np.cumsum(new_h) - 1
            answer = np.where((answer == 0) & (np.bincount(group, weights=new)[group] > 1), _SEVERAL, answer)
        back = np.empty(len(h), np.uint8)
        back[order] = answer
        out += _split(back, rows, kind)
    return _table(out, _BACK)


def _own_bytes(merge: int):
    def own(t: pa.Table) -> pa.Table:
        """Answers of kind 4: for each segment, which of its strings start in a smaller document."""
        rows = t.to_pylist()
        h = np.concatenate([np.frombuffer(r["hashes"], "<u8") for r in rows])
        size = np.concatenate([np.frombuffer(r["lens"], np.uint8) for r in rows]).astype(np.int64)
        docs = np.concatenate([np.frombuffer(r["docs"], "<i8") for r in rows])
        run = np.repeat(np.arange(len(rows)), [len(r["lens"]) for r in rows])
        text = b"".join(r["bytes"] for r in rows)
        start = np.cumsum(size) - size
        order = np.argsort(h, kind="stable")
        mask, bits, at = np.zeros(len(h), np.uint32), np.arange(WINDOWS, dtype=np.uint32), 0
        while at < len(order):
            to = min(len(order), at + merge)
            while to < len(order) and h[order[to]] == h[order[to - 1]]:
                to += 1
            mine = order[at:to]
            strings = [text[s : s + n] for s, n in zip(start[mine].tolist(), size[mine].tolist(), strict=True)]
            found = merged_least(strings, docs[mine], run[mine])
            mask[mine] = ((found < docs[mine][:, None]).astype(np.uint32) << bits).sum(axis=1, dtype=np.uint32)
            at = to
        return _table(_split(mask.astype("<u4"), rows, 4), _BACK)

    return own


_OUT_SQL = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"


def _cut(with_bytes: bool):
    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        (row,) = left.to_pylist()
        run = _Run(row)
        use, which, _, _, _, _, least = run.segments(_answers(right, 0))
        verdict = _answers(right, 1)
        mask = np.where(verdict == _ALL, _EVERY, np.uint32(0))
        mask[verdict == _SEVERAL] = _answers(right, 4)
        n = len(run.text)
        step = np.zeros(n + 1, np.int32)
        if len(use):
            # a document with a larger doc_id than its segment's smallest has every string of it from before
            later = run.docs[run.doc_of[use]] > least[which]
            bits = np.where(later, _EVERY, mask[which])
            low, span = run.low[use], run.low[use] - run.high[use]
            for o in range(WINDOWS):
                hit = ((bits >> np.uint32(o)) & np.uint32(1)).astype(bool) & (o <= span)
                at = run.places[use][hit] - low[hit] + o
                np.add.at(step, at, 1)
                np.add.at(step, at + LENGTH, -1)
        starts, string, _, least = run.windows(_answers(right, 2))
        if len(starts):
            docs = run.docs[np.searchsorted(np.cumsum(run.lens), starts, "right")]
            at = starts[(docs > least[string]) | _answers(right, 3).astype(bool)[string]]
            np.add.at(step, at, 1)
            np.add.at(step, at + LENGTH, -1)
        gone = np.cumsum(step[:n]) > 0
        ends = np.cumsum(run.lens)
        out = []
        for doc_id, a, b in zip(run.ids, (ends - run.lens).tolist(), ends.tolist(), strict=True):
            g = gone[a:b]
            removed = int(g.sum())
            kept = run.text[a:b] if not removed else run.text[a:b][~g]
            spans = int((g[1:] & ~g[:-1]).sum() + g[0]) if removed else 0
            out.append((doc_id, b - a, removed, spans, hashlib.sha256(kept.tobytes()).hexdigest(), kept.tobytes() if with_bytes else None))
        kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
        return pa.table([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _OUT_SQL.split(", ")])

    return cut


def suffix_dedup(docs: DataFrame, with_bytes: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with_bytes the kept bytes."""
    buckets = 2 * partitions(docs.sparkSession)
    runs = _runs(docs)
    hot = stored(runs.mapInArrow(_send_anchors(buckets, HOT), _SENT_SQL).groupBy("bucket").applyInArrow(_own_anchors(HOT), _BACK_SQL), "anchors", free=True)
    answers = hot
    for send, own, name in ((_send_segments, _own_segments, "segments"), (_send_bytes, _own_bytes(MERGE), "masks")):
        sent = runs.groupBy("run").cogroup(answers.groupBy("run")).applyInArrow(send(buckets), _SENT_SQL)
        dealt = sent.repartition(partitions(docs.sparkSession), "bucket")  # small rows with much work: not to be put together
        answers = answers.union(stored(dealt.groupBy("bucket").applyInArrow(own, _BACK_SQL), name, free=True))
    out = runs.groupBy("run").cogroup(answers.groupBy("run")).applyInArrow(_cut(with_bytes), _OUT_SQL)
    return out if with_bytes else out.drop("kept")
