"""Token-ID output in Simple-8b words.

Texts are encoded with a public tokenizer file, each document closed by an end id, and written in ascending
doc_id order as blocks of whole documents. A block row holds its documents' ids, their id counts (the
per-block offsets are their running sums), the 64-bit words and the escapes. A word is a 4-bit selector and 60 bits of
payload: selectors 0 to 13 pack 60, 30, ... 1 ids of equal width; 15 is an escape, its payload the place of a value of over 60
bits in the escape list. Words decode without a loop over ids: the selectors alone give every word's place.

Null text is the empty text (only the end id). Null doc_ids come first; rows of one doc_id are ordered by text hash. Repeated rows
are all written; extra columns are ignored; an empty table gives an empty file. Documents are never cut: a block closes
after BLOCK_IDS ids at the end of a document.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import byte_texts, mix64, partitions, scratch, text_of

END_ID = 2
BLOCK_IDS = 65536
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
COUNTS = tuple(60 // b for b in WIDTHS)
ESCAPE = 15
_PER_WORD = np.array([*COUNTS, 0, 1], np.int64)
#: Bits of each 16-bit value, at least one.
_BITS = np.maximum(1, np.frexp(np.arange(1 << 16, dtype=np.float64))[1]).astype(np.uint8)
#: Encoded pieces kept.
CACHE = 1_500_000


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """uint64 values as (words, escapes), both little-endian: each word takes as many values as fit."""
    v = np.ascontiguousarray(values, np.uint64)
    n = len(v)
    if not n:
        return b"", b""
    wide = v >= np.uint64(1 << 60)
    escapes = v[wide]
    small = np.where(wide, np.uint64(0), v)
    if n and small.max() < len(_BITS):
        bits = _BITS[small.astype(np.uint16)]
    else:
        bits = np.clip(np.frexp(small.astype(np.float64))[1], 1, 60).astype(np.uint8)  # rounding up of large values can only widen
    bits[wide] = 61
    choice = np.where(wide, np.uint8(ESCAPE), np.uint8(len(WIDTHS) - 1))
    have, widest = 1, bits  # of each place, the widest of so many values from it on
    for k in range(len(WIDTHS) - 2, -1, -1):
        per = COUNTS[k]
        if per > n:
            break
        while have < per:
            step = min(have, per - have)
            widest = np.maximum(widest[: len(widest) - step], widest[step:])
            have += step
        fits = widest <= WIDTHS[k]
        if not fits.any():  # nor will more values in fewer bits
            break
        choice[: len(fits)][fits] = k
    steps = _PER_WORD.astype(np.uint8)[choice].tobytes()
    at, starts = 0, []
    while at < n:
        starts.append(at)
        at += steps[at]
    s = np.array(starts)
    sel = choice[s].astype(np.int8)
    words = sel.astype(np.uint64) << np.uint64(60)
    for k in np.unique(sel):
        rows = np.flatnonzero(sel == k)
        if k == ESCAPE:
            words[rows] |= np.arange(len(rows), dtype=np.uint64)
            continue
        shifts = (np.arange(COUNTS[k]) * WIDTHS[k]).astype(np.uint64)
        words[rows] |= np.bitwise_or.reduce(v[s[rows][:, None] + np.arange(COUNTS[k])] << shifts, axis=1)
    return words.astype("<u8").tobytes(), escapes.astype("<u8").tobytes()


def unpack(words: bytes, escapes: bytes) -> np.ndarray:
    w = np.frombuffer(words, "<u8")
    sel = (w >> np.uint64(60)).astype(np.int8)
    per = _PER_WORD[sel]
    at = np.concatenate(([0], np.cumsum(per)))
    out = np.empty(at[-1], np.uint64)
    for k in np.unique(sel):
        rows = np.flatnonzero(sel == k)
        if k == ESCAPE:
            out[at[rows]] = np.frombuffer(escapes, "<u8")[(w[rows] & np.uint64((1 << 60) - 1)).astype(np.int64)]
            continue
        shifts = (np.arange(COUNTS[k]) * WIDTHS[k]).astype(np.uint64)
        mask = np.uint64((1 << WIDTHS[k]) - 1)
        out[at[rows][:, None] + np.arange(COUNTS[k])] = (w[rows][:, None] >> shifts) & mask
    return out


#: ASCII punctuation that never joins with a letter before or behind it (an apostrophe may).
_MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Letters below this (Latin, Greek, Cyrillic, Armenian) are the same letters to every Unicode version; those below _MARKED are composed as they stand.
_OLD_LETTERS, _MARKED = "\u0590", "\u0300"
#: Of each byte: 0 ASCII white space, 1 a lower-case ASCII letter, 2 one of _MARKS, 3 anything else.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[list(b"\x20\t\n\x0b\x0c\r")] = 0
_CLASS[list(b"abcdefghijklmnopqrstuvwxyz")] = 1
_CLASS[list(_MARKS)] = 2
#: Masks of the first 0 to 8 bytes of a little-endian word.
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_TABLE_BITS = 22
#: Texts encoded together, and the largest slice of a longer one, in bytes.
TOGETHER = 4_000_000


def byte_letters() -> dict[int, str]:
    """Byte-level BPE writes each byte as a letter: itself if printable in Latin-1, else the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def pieces(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the parts that the tokenizer never joins: runs without ASCII white space, cut between letters a-z and _MARKS."""
    kind = np.concatenate((np.zeros(1, np.uint8), _CLASS[text], np.zeros(1, np.uint8)))
    left, right = kind[:-1], kind[1:]
    cut = (left ^ right) == 3  # a letter and a mark, or white space and anything else
    cut &= (left > 0) & (right > 0)
    starts = np.flatnonzero(((left == 0) & (right > 0)) | cut)
    ends = np.flatnonzero(((left > 0) & (right == 0)) | cut)
    return starts, ends


def piece_hashes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the pieces, eight bytes at a time."""
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(text) + 1,), "<u8", padded, strides=(1,))
    n = ends - starts
    h = mix64((n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (eight[starts] & _FIRST[np.minimum(n, 8)]))
    for k in range(8, 64, 8):
        more = np.flatnonzero(n > k)
        if not len(more):
            break
        h[more] = mix64(h[more] * np.uint64(0xC2B2AE3D27D4EB4F) + (eight[starts[more] + k] & _FIRST[np.minimum(n[more] - k, 8)]))
    for i in np.flatnonzero(n > 64).tolist():
        h[i] = xxhash.xxh3_64_intdigest(text[starts[i] : ends[i]].tobytes())
    return np.maximum(h, np.uint64(1))


class Encoder:
    """Ids of texts. Each piece is encoded once by the tokenizer and kept under its hash in a table of arrays, which starts anew beyond CACHE pieces.
    The tokenizer lower-cases, so A-Z are lowered first; a text that may hold a special token is encoded as it stands. Plain lower-case pieces go straight to
    the tokenizer's BPE model."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize, self.letters = self.tokenizer.model.tokenize, byte_letters()
        self.clear()

    def clear(self) -> None:
        self.keys, self.entry = np.zeros(1 << _TABLE_BITS, np.uint64), np.zeros(1 << _TABLE_BITS, np.int32)
        self.first, self.ids, self.size = np.zeros(1, np.int64), np.empty(1 << 16, np.uint32), 0

    def piece(self, key: bytes) -> list[int]:
        if key.isalpha() and key.islower():  # of bytes: ASCII letters only
            return [t.id for t in self.tokenize(key.decode())]
        text = key.decode("utf-8", "replace")
        top = max(text)
        if text.isalpha() and top < _OLD_LETTERS and text == text.lower() and (top < _MARKED or is_normalized("NFC", text)):
            return [t.id for t in self.tokenize(key.decode("latin-1").translate(self.letters))]
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def find(self, h: np.ndarray) -> np.ndarray:
        """The entry of each hash, -1 where it has none."""
        out, todo, at = np.full(len(h), -1, np.int64), np.arange(len(h)), (h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)
        while len(todo):
            held = self.keys[at]
            hit = held == h[todo]
            out[todo[hit]] = self.entry[at[hit]]
            on = ~hit & (held > 0)
            todo, at = todo[on], (at[on] + 1) & (len(self.keys) - 1)
        return out

    def add(self, h: np.ndarray, new: list[list[int]]) -> None:
        """Keeps new distinct hashes with their ids."""
        counts = np.fromiter(map(len, new), np.int64, len(new))
        ids = np.fromiter(chain.from_iterable(new), np.uint32, int(counts.sum()))
        if self.size + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids[: self.size], np.empty(max(self.size, len(ids)) + len(ids), np.uint32)))
        self.ids[self.size : self.size + len(ids)] = ids
        names = len(self.first) - 1 + np.arange(len(new))
        self.first = np.concatenate((self.first, self.size + np.cumsum(counts)))
        self.size += len(ids)
        todo, at = np.arange(len(h)), (h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)
        while len(todo):
            free = self.keys[at] == 0
            self.keys[at[free]] = h[todo[free]]
            own = self.keys[at] == h[todo]  # of several for one place, one has it
            self.entry[at[own]] = names[todo[own]]
            todo, at = todo[~own], (at[~own] + 1) & (len(self.keys) - 1)

    def slice(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first id of each piece, and of their end; where the pieces start) of lower-cased text."""
        t = np.frombuffer(text, np.uint8)
        starts, ends = pieces(t)
        h = piece_hashes(t, starts, ends)
        if len(self.first) > CACHE or self.size > 8 * CACHE:
            self.clear()
        found = self.find(h)
        missed = np.flatnonzero(found < 0)
        if len(missed):
            names, one, which = np.unique(h[missed], return_index=True, return_inverse=True)
            one, known = missed[one], len(self.first) - 1
            self.add(names, [self.piece(text[a:b]) for a, b in zip(starts[one].tolist(), ends[one].tolist(), strict=True)])
            found[missed] = known + which
        first = self.first[found]
        counts = self.first[found + 1] - first
        at = np.concatenate((np.zeros(1, np.int64), np.cumsum(counts)))
        return self.ids[np.repeat(first - at[:-1], counts) + np.arange(at[-1])], at, starts

    def __call__(self, text: bytes) -> bytes:
        """The ids of one text as little-endian uint32 bytes."""
        return self.many([text])[0].astype("<u4").tobytes()

    def many(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each)."""
        out, counts, k = [np.empty(0, np.uint32)], [], 0
        while k < len(texts):
            if b"<|" in texts[k]:
                ids = self.tokenizer.encode(texts[k].decode("utf-8", "replace"), add_special_tokens=False).ids
                out.append(np.array(ids, np.uint32))
                counts.append(np.array([len(ids)]))
                k += 1
                continue
            if len(texts[k]) > TOGETHER:
                parts = [self.slice(x)[0] for x in slices(texts[k].lower())]
                out += parts
                counts.append(np.array([sum(map(len, parts))]))
                k += 1
                continue
            to, size = k, 0
            while to < len(texts) and size + len(texts[to]) <= TOGETHER and b"<|" not in texts[to]:
                size += len(texts[to]) + 1
                to += 1
            to = max(to, k + 1)
            ids, at, starts = self.slice(b" ".join(texts[k:to]).lower())
            ends = np.cumsum([len(x) + 1 for x in texts[k:to]])
            out.append(ids)
            counts.append(np.diff(at[np.searchsorted(starts, ends)], prepend=0))
            k = to
        return np.concatenate(out), np.concatenate(counts) if counts else np.empty(0, np.int64)


def slices(text: bytes) -> Iterator[bytes]:
    """A text in parts of about TOGETHER bytes, cut behind white space; a longer run without any stays whole."""
    at = 0
    while at < len(text):
        to = at + TOGETHER
        if to < len(text):
            to = max(text.rfind(b" ", at, to), text.rfind(b"\n", at, to)) + 1 or min((x for x in (text.find(b" ", to), text.find(b"\n", to)) if x >= 0), default=len(text))
        yield text[at:to]
        at = to


_ENCODERS: dict[str, Encoder] = {}


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Writes the blocks of all documents under path, files and rows in ascending doc_id order."""
    file = tokenizer or vocabulary()
    schema = "part int, block int, doc_ids array<bigint>, counts array<bigint>, words binary, escapes binary"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if file not in _ENCODERS:
            _ENCODERS[file] = Encoder(file)
        encoder = _ENCODERS[file]
        part, block, held, ids, counts, size = TaskContext.get().partitionId(), 0, [], [], [], 0

        def row() -> pa.RecordBatch:
            words, escapes = pack(np.concatenate(held).astype(np.uint64))
            return pa.record_batch({"part": pa.array([part], pa.int32()), "block": pa.array([block], pa.int32()), "doc_ids": pa.array([ids], pa.list_(pa.int64())), "counts": pa.array([counts], pa.list_(pa.int64())), "words": pa.array([words], pa.binary()), "escapes": pa.array([escapes], pa.binary())})

        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            encoded, n = encoder.many(byte_texts(batch.column("text")))
            ends = np.cumsum(n + 1)
            every = np.full(len(encoded) + len(n), end_id, np.uint32)
            inside = np.ones(len(every), bool)
            inside[ends - 1] = False
            every[inside] = encoded
            at = doc = 0
            while doc < len(names):
                # up to the document that fills the block
                to = min(len(names), int(np.searchsorted(ends, ends[doc - 1] * (doc > 0) + block_ids - size)) + 1)
                held.append(every[at : ends[to - 1]])
                ids += names[doc:to]
                counts += (n[doc:to] + 1).tolist()
                size += len(held[-1])
                at, doc = int(ends[to - 1]), to
                if size >= block_ids:
                    yield row()
                    block, held, ids, counts, size = block + 1, [], [], [], 0
        if ids:
            yield row()

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    ordered = rows.repartitionByRange(partitions(docs.sparkSession), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ordered.mapInArrow(encode, schema).write.option("compression", "zstd").parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32, and with_ids the ids (little-endian uint32 bytes)."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                ids = unpack(x["words"], x["escapes"]).astype("<u4")
                ends = np.cumsum(x["counts"])
                starts = ends - np.array(x["counts"])
                n = len(ends)
                each = [ids[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
                out = {"part": pa.array([x["part"]] * n, pa.int32()), "block": pa.array([x["block"]] * n, pa.int32()), "doc_id": pa.array(x["doc_ids"], pa.int64()), "at": pa.array(starts, pa.int64()), "n_tokens": pa.array(x["counts"], pa.int64()), "ids_crc32": pa.array(map(zlib.crc32, each), pa.int64())}
                yield pa.record_batch(out | ({"ids": pa.array(each, pa.binary())} if with_ids else {}))

    blocks = spark.read.schema("part int, block int, doc_ids array<bigint>, counts array<bigint>, words binary, escapes binary").parquet(path)
    sizes = blocks.select("part", "block", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n")).select("part", earlier(Window.orderBy("part")).alias("base"))
    offsets = sizes.select("part", "block", earlier(Window.partitionBy("part").orderBy("block")).alias("inside")).join(parts, "part").select("part", "block", (F.col("base") + F.col("inside")).alias("offset"))
    docs = blocks.mapInArrow(decode, "part int, block int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint" + (", ids binary" if with_ids else ""))
    return docs.join(offsets, ["part", "block"]).select("doc_id", (F.col("offset") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def token_output(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes all documents to the shared folder and reads the files back: doc_id, start, n_tokens, ids_crc32."""
    path = scratch(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer)
    return read_tokens(docs.sparkSession, path, with_ids=False)
