"""Benchmark decontamination by templates.

Words become template tokens: numbers, names (capitalised inside a sentence) and units give way to typed placeholders, other words
lose case and outer punctuation. Windows of WINDOW tokens, hashed together with which of their placeholders hold equal values,
are hash-joined with the benchmark's windows. Windows with under LITERALS plain words say too little as templates; all windows are joined
by their exact words (case and outer punctuation apart) too, so verbatim copies match whatever they are made of. An item's first word may
be a name inside a document: its first window stands for both.
For each item and shift (place in the document minus place in the item) the slots must be consistent: over all windows of that shift, each value
of the item goes with one value of the document and the other way round, so re-parameterised questions match and chance does not.
A document is contaminated by an item if its consistent windows cover SPAN tokens running, or all windows of a shorter item; with
templates alone, windows run over those of the item that have LITERALS plain words.

An item of fewer than WINDOW words, but `shortest` at least, is one window by itself and matches by its exact words. The parameter's default, WINDOW, leaves
such items out; the registered query and the pipeline take SHORTEST, as items of one or two words stand in too many clean texts.

The benchmark's windows are collected and sent to the executors, sorted, only while there are at most BROADCAST_WINDOWS of them (templates and exact words
apart), about 64 MB; a worker keeps them for all its tasks. Beyond that the documents' windows are shuffled to them, where AQE splits hot ones. Null
texts and texts or items too short match nothing; texts of any length are whole, and repetitive ones take no more memory than others (HITS); repeated rows get equal
rows; null item_ids are dropped; null doc_ids are kept; extra columns are ignored; empty tables give no match.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StructField, StructType

from .common import CACHE_WORDS, byte_texts, stored, text_of, window_hashes

WINDOW = 8
LITERALS = 4
SPAN = 13
SHORTEST = 3
#: Bytes of one window with its places and slots, and how many make 64 MB.
WINDOW_BYTES = 96
BROADCAST_WINDOWS = 64_000_000 // WINDOW_BYTES
#: Pairs of a text's and items' windows, and windows of a text, that are held together.
HITS = 100_000
#: Units of measure taken as one type each. Those that are common words or letters too count as units only behind a number.
UNITS = frozenset("mm cm m km in ft yd mi mg g kg t lb oz ml l s sec min h hr hrs ms kb mb gb tb w kw v a hz khz mhz ghz kmh mph usd eur gbp percent % $ € £ °c °f".split())
AMBIGUOUS = frozenset("a in m h s t g l v w".split())
NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/-]*(%|[a-zµ°]{1,3})?", re.I)
_KIND, _END = np.uint64(3), np.uint64(4)
_AMBIGUOUS = np.uint64(8)
_PLAIN = np.uint64(0xFFFFFFFFFFFFFFF0)
_PLACES = np.array([0, 0x1F83D9ABFB41BD68, 0x5BE0CD19137E2178, 0x3C6EF372FE94F828], np.uint64)
_EXACT = np.uint64(0x5851F42D4C957F2D)
_PAIRS = [(a, b) for b in range(WINDOW) for a in range(b)]


class TemplateWords(dict):
    """Word (bytes) to the hash of its plain form; lowest bits: 0 plain, 1 number, 2 unit, 3 capitalised; bit 2: ends a sentence; bit 3: a unit
    only behind a number."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        text = word.decode("utf-8", "replace")
        core = text.strip(".,;:!?\"'()[]{}«»“”„…*#&")
        low = core.lower()
        h = xxhash.xxh3_64_intdigest((low or text).encode()) & ~15
        kind = 1 if NUMBER.fullmatch(core) else 2 if low in UNITS else 3 if core[:1].isupper() and not core.isupper() else 0
        self[word] = h = h | kind | (8 if low in AMBIGUOUS else 0) | (4 if text[-1] in ".!?:" or text.rstrip("\"')»”")[-1:] in (".", "!", "?", ":") else 0)
        return h


def template(text: bytes, cache: TemplateWords, first_name: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, slots, words): template tokens, the value's hash where a token is a placeholder, else 0, and the hashes of the plain forms.
    With first_name, a capitalised first word is a name."""
    words = text.split()
    x = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    kind = x & _KIND
    name = kind == 3
    if len(x):
        name[0] &= first_name
        name[1:] &= (x[:-1] & _END) == 0
        unit = (x & _AMBIGUOUS) > 0
        unit[1:] &= kind[:-1] != 1
        kind = np.where(((kind == 3) & ~name) | ((kind == 2) & unit), np.uint64(0), kind)
    plain = x & _PLAIN
    return np.where(kind > 0, _PLACES[kind], plain), np.where(kind > 0, plain | np.uint64(1), np.uint64(0)), plain


def windows(tokens: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, usable) of all windows; a hash holds the tokens and which of their slots have equal values."""
    h = window_hashes(tokens, WINDOW)
    n = len(h)
    if not n:
        return h, np.empty(0, bool)
    held = np.concatenate(([0], np.cumsum(slots > 0)))
    filled = held[WINDOW:] - held[:-WINDOW]
    some = np.flatnonzero(filled >= 2)
    if len(some):
        v = slots[some[:, None] + np.arange(WINDOW)]
        equal = np.zeros(len(some), np.uint64)
        for bit, (a, b) in enumerate(_PAIRS):
            equal |= ((v[:, a] > 0) & (v[:, a] == v[:, b])).astype(np.uint64) << np.uint64(bit)
        h[some] ^= equal * np.uint64(0x9E3779B97F4A7C15)
    return h, filled <= WINDOW - LITERALS


def exact_windows(words: np.ndarray, size: int = WINDOW) -> np.ndarray:
    return window_hashes(words, size) ^ (_EXACT + np.uint64(WINDOW - size))


def item_windows(text: bytes, cache: TemplateWords, shortest: int = WINDOW) -> tuple[np.ndarray, ...]:
    """(hashes, places, ranks, slots, usable windows, words of a window): an item's windows as templates, the first one also with its first word as a name, and by
    their exact words. Ranks count the usable windows; -1 for exact words."""
    tokens, slots, words = template(text, cache)
    if shortest <= len(words) < WINDOW:
        zero = np.zeros(1, np.int64)
        return exact_windows(words, len(words)), zero, zero - 1, np.zeros((1, WINDOW), np.uint64), 0, len(words)
    h, usable = windows(tokens, slots)
    at, every = np.flatnonzero(usable), np.arange(len(h))
    named = template(b" ".join(text.split()[:WINDOW]), cache, first_name=True) if len(h) and usable[0] else None
    h0, usable0 = windows(*named[:2]) if named and named[1][0] != slots[0] else (h[:0], usable[:0])
    again = np.zeros(int(usable0.sum()), np.int64)
    values = slots[every[:, None] + np.arange(WINDOW)]
    first = named[1][None] if len(again) else values[:0]
    return (
        np.concatenate((h[at], h0[usable0], exact_windows(words))), np.concatenate((at, again, every)), np.concatenate((np.arange(len(at)), again, np.full(len(h), -1))),
        np.concatenate((values[at], first, values)), len(at), WINDOW,
    )


def consistent(item_slots: np.ndarray, doc_slots: np.ndarray) -> bool:
    """Whether the values, paired by place, go one to one."""
    both = item_slots > 0
    a, b = item_slots[both], doc_slots[both]
    pairs = len(set(zip(a.tolist(), b.tolist(), strict=True)))
    return pairs == len(set(a.tolist())) == len(set(b.tolist()))


def longest_run(places: list[int]) -> int:
    best = run = 0
    last = None
    for p in sorted(set(places)):
        run = run + 1 if last is not None and p == last + 1 else 1
        best, last = max(best, run), p
    return best


def matched(n_item_windows: int, places: list[int]) -> bool:
    return longest_run(places) >= min(SPAN - WINDOW + 1, n_item_windows)


def judge(hits: list[tuple]) -> list[int]:
    """Items that contaminate a document, from its hits (item, windows of the item, usable ones, place in item, rank, place in document, item's slots,
    document's slots). Where all hits together aren't consistent, those of the templates or of the exact words may be."""
    by: dict[tuple, list] = {}
    for hit in hits:
        by.setdefault((hit[0], hit[5] - hit[3]), []).append(hit)
    out = set()
    for (item, _), group in by.items():
        if item in out:
            continue
        same = [g for g in group if g[4] < 0]
        like = [g for g in group if g[4] >= 0]
        n, usable = group[0][1:3]
        tries = [(group, n, 3), (like, usable, 4), (same, n, 3)] if same and like else [(like, usable, 4)] if like else [(same, n, 3)]
        if any(matched(most, [g[k] for g in some]) and _one_to_one(some) for some, most, k in tries):
            out.add(item)
    return sorted(out)


def _one_to_one(group: list[tuple]) -> bool:
    own = np.concatenate([np.asarray(g[6], np.uint64) for g in group])
    return consistent(own, np.concatenate([np.asarray(g[6] if g[4] < 0 else g[7], np.uint64) for g in group]))


_LISTS = pa.list_(pa.int64())
_VERDICT = [StructField("contaminated", BooleanType()), StructField("item_ids", ArrayType(LongType()))]


def _item_rows(items: DataFrame, shortest: int) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = TemplateWords()
        for batch in batches:
            for item, text in zip(batch.column("item_id").to_pylist(), byte_texts(batch.column("text")), strict=True):
                h, at, rank, slots, usable, size = item_windows(text, cache, shortest)
                if len(h):
                    same = lambda x: pa.array(np.full(len(h), x), pa.int32())  # noqa: E731, B023
                    yield pa.record_batch({"h": pa.array(h.view(np.int64)), "item_id": pa.array([item] * len(h), pa.int64()), "n": same(at.max() + 1), "usable": same(usable), "size": same(size), "at": pa.array(at, pa.int32()), "rank": pa.array(rank, pa.int32()), "slots": pa.array(list(slots.view(np.int64)), _LISTS)})

    return items.mapInArrow(rows, "h bigint, item_id bigint, n int, usable int, size int, at int, rank int, slots array<bigint>")


def _document_rows(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """Windows as templates with their slots, and by their exact words without, those of shorter sizes too."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = TemplateWords()
        for batch in batches:
            for doc, key, text in zip(batch.column("doc_id").to_pylist(), batch.column("key").to_pylist(), byte_texts(batch.column("text")), strict=True):
                tokens, slots, words = template(text, cache)
                h, usable = windows(tokens, slots)
                at = np.flatnonzero(usable)
                same = [exact_windows(words, k) for k in (*sizes, WINDOW)]
                hashes, places = np.concatenate((h[at], *same)), np.concatenate((at, *(np.arange(len(x)) for x in same)))
                for a in range(0, len(hashes), HITS):
                    n = min(HITS, len(hashes) - a)
                    # exact words, behind the templates, have no slots
                    own = slots.view(np.int64)[at[a : a + n, None] + np.arange(WINDOW)]
                    ends = np.minimum(np.arange(n + 1), len(own)).astype(np.int32) * WINDOW
                    values = pa.ListArray.from_arrays(pa.array(ends), pa.array(own.ravel()))
                    yield pa.record_batch({"h": pa.array(hashes[a : a + n].view(np.int64)), "doc_id": pa.array([doc] * n, pa.int64()), "key": pa.array([key] * n, pa.int64()), "doc_at": pa.array(places[a : a + n], pa.int32()), "doc_slots": values})

    return docs.mapInArrow(rows, "h bigint, doc_id bigint, key bigint, doc_at int, doc_slots array<bigint>")


class Items:
    """The benchmark's windows as arrays sorted by hash, with a bitmap in front."""

    def __init__(self, sizes: list[int], h: np.ndarray, *columns: np.ndarray):
        self.sizes, self.h = sizes, h
        self.item, self.n, self.usable, self.at, self.rank, self.slots = columns
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(self.h >> np.uint64(42)).astype(np.int64)] = True

    def contaminants(self, text: bytes, cache: TemplateWords) -> list[int]:
        """Items that contaminate a text (judge). Its windows that some item has are taken in order of their places, as many at a time as make HITS pairs with
        items' windows; an item's pairs of one shift are judged once no later place can add to them, and an item that was found is left alone."""
        tokens, slots, words = template(text, cache)
        if not len(words) or not len(self.h):
            return []
        h, usable = windows(tokens, slots)
        met = [self._met(h, usable)] + [self._met(exact_windows(words, k), True) for k in (*self.sizes, WINDOW)]
        if not any(len(x[0]) for x in met):
            return []
        place, lo, hi = (np.concatenate(x) for x in zip(*met, strict=True))
        order = np.argsort(place, kind="stable")
        place, lo, hi = place[order], lo[order], hi[order]
        ends = np.cumsum(hi - lo)
        found: set[int] = set()
        window, at = np.empty(0, np.int64), np.empty(0, np.int64)
        done = 0
        while done < len(place):
            to = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + HITS, "right")))
            each = hi[done:to] - lo[done:to]
            new = np.repeat(lo[done:to], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            window, at = np.concatenate((window, new)), np.concatenate((at, np.repeat(place[done:to], each)))
            done = to
            if found:
                free = ~np.isin(self.item[window], np.array(sorted(found)))
                window, at = window[free], at[free]
            shift = at - self.at[window]
            ready = np.ones(len(at), bool) if done == len(place) else shift + self.n[window] <= place[done]
            found |= self._judged(window[ready], at[ready], shift[ready], slots)
            window, at = window[~ready], at[~ready]
        return sorted(found)

    def _met(self, h: np.ndarray, usable: np.ndarray | bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, first and end of the items' windows with the same hash) of a text's windows that items have."""
        at = np.flatnonzero(self.seen[(h >> np.uint64(42)).astype(np.int64)] & usable)
        lo, hi = np.searchsorted(self.h, h[at], "left"), np.searchsorted(self.h, h[at], "right")
        return at[hi > lo], lo[hi > lo], hi[hi > lo]

    def _judged(self, window: np.ndarray, at: np.ndarray, shift: np.ndarray, slots: np.ndarray) -> set[int]:
        """Items found among whole groups of one item and shift."""
        found: set[int] = set()
        if not len(window):
            return found
        order = np.lexsort((shift, self.item[window]))
        window, at, shift = window[order], at[order], shift[order]
        item = self.item[window]
        cut = np.flatnonzero((item[1:] != item[:-1]) | (shift[1:] != shift[:-1])) + 1
        starts, stops = np.concatenate(([0], cut)), np.concatenate((cut, [len(item)]))
        # fewer windows than the shortest run that counts can't match
        least = np.minimum(SPAN - WINDOW + 1, np.minimum(self.n[window[starts]], np.maximum(1, self.usable[window[starts]])))
        for a, b in zip(starts[stops - starts >= least], stops[stops - starts >= least], strict=True):
            if int(item[a]) not in found:
                found.update(judge([(int(item[k]), int(self.n[w]), int(self.usable[w]), int(self.at[w]), int(self.rank[w]), int(p), self.slots[w], slots[p : p + WINDOW]) for k, w, p in zip(range(a, b), window[a:b], at[a:b], strict=True)]))
        return found


#: A worker's sorted items, under the name of the run that sent them.
_ITEMS: dict[str, Items] = {}


def decontaminate(docs: DataFrame, benchmark: DataFrame, broadcast_windows: int = BROADCAST_WINDOWS, shortest: int = WINDOW, carry: bool = False) -> DataFrame:
    """One row per document: doc_id, contaminated, item_ids (sorted); with carry, all columns of docs and then contaminated and item_ids."""
    items = benchmark.where(benchmark["item_id"].isNotNull()).select(benchmark["item_id"].cast("long").alias("item_id"), text_of(benchmark).alias("text"))
    ref = stored(_item_rows(items, shortest), "windows")
    sizes = sorted(r["size"] for r in ref.where(F.col("size") < WINDOW).select("size").distinct().collect())  # fewer than WINDOW numbers
    rows = docs if carry else docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    out = _by_broadcast(rows, ref, sizes) if ref.count() <= broadcast_windows else _by_shuffle(rows, ref, sizes)
    return out if carry else out.select("doc_id", "contaminated", "item_ids")


def _by_broadcast(rows: DataFrame, ref: DataFrame, sizes: list[int]) -> DataFrame:
    got = ref.toArrow().combine_chunks()
    lists = got["slots"].chunk(0) if got["slots"].num_chunks else pa.array([], _LISTS)
    slots = lists.flatten().to_numpy().reshape(-1, WINDOW).view(np.uint64)
    h = got["h"].to_numpy().view(np.uint64)
    order, run = np.argsort(h, kind="stable"), uuid.uuid4().hex
    sent = rows.sparkSession.sparkContext.broadcast((sizes, h[order], *(got[c].to_numpy()[order] for c in ("item_id", "n", "usable", "at", "rank")), slots[order]))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if run not in _ITEMS:
            _ITEMS.clear()
            _ITEMS[run] = Items(*sent.value)
        ref_items, cache = _ITEMS[run], TemplateWords()
        for batch in batches:
            found = [ref_items.contaminants(text, cache) for text in byte_texts(batch.column("text"))]
            yield pa.record_batch({n: batch.column(n) for n in batch.schema.names} | {"contaminated": pa.array([bool(x) for x in found], pa.bool_()), "item_ids": pa.array(found, _LISTS)})

    return rows.mapInArrow(check, StructType([*rows.schema.fields, *_VERDICT]))


def _by_shuffle(rows: DataFrame, ref: DataFrame, sizes: list[int]) -> DataFrame:
    keyed = rows.withColumn("_key", F.xxhash64("doc_id", "text"))
    narrow = keyed.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("_key").alias("key"), F.col("text").cast("string").alias("text"))
    hits = _document_rows(narrow, sizes).join(ref, "h").dropDuplicates(["doc_id", "key", "doc_at", "item_id", "at", "rank"]).withColumn("shift", F.col("doc_at") - F.col("at"))

    def verdict(t: pa.Table) -> pa.Table:
        x = t.to_pylist()
        good = judge([(r["item_id"], r["n"], r["usable"], r["at"], r["rank"], r["doc_at"], np.array(r["slots"], np.int64).view(np.uint64), np.array(r["doc_slots"] or [], np.int64).view(np.uint64)) for r in x])
        return pa.table({"key": pa.array([x[0]["key"]] * len(good), pa.int64()), "item_id": pa.array(good, pa.int64())})

    # one group is one item at one shift of one document: at most twice as many windows as the item has
    pairs = hits.groupBy("doc_id", "key", "item_id", "shift").applyInArrow(verdict, "key bigint, item_id bigint").distinct()
    found = pairs.groupBy(F.col("key").alias("_key")).agg(F.array_sort(F.collect_set("item_id")).alias("_items"))
    out = keyed.join(found, "_key", "left")
    return out.select(*rows.columns, F.col("_items").isNotNull().alias("contaminated"), F.coalesce("_items", F.array().cast("array<bigint>")).alias("item_ids"))
