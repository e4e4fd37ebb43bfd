"""Exact deduplication by an exchange of Golomb-coded fingerprints.

Where documents are stored, tasks put up to BLOCK_PRINTS of their 64-bit fingerprints into a block, sorted and distinct, and note those that
repeat inside it. Only codes are shuffled: each block sends each owner of a range of fingerprints one Golomb-Rice coded run (unary quotients
first, remainders behind, so decoding has no loop over values). The owner decodes the runs, finds the fingerprints held by more than one
block, and answers each block with a bitmap. Blocks are bucketed by their names, so they meet the answers without being moved. Only suspects
(fingerprints of the bitmap, or repeated inside a block) have their texts grouped, by the text itself, which verifies them byte by byte.
There are as many owners as shuffle partitions, but no more than hold OWNER_PRINTS each (LEAST_OWNERS at least), which bounds the number of runs.

Equal means identical after lower-casing A-Z. Null text counts as empty, texts of any length are whole. The row with the largest
doc_id stays; null doc_ids stay only if their whole group has none; repeated rows of the largest
doc_id all stay. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, bucketed, partitions, stored, text_of

BLOCK_PRINTS = 1_000_000
OWNER_PRINTS, LEAST_OWNERS = 4_000_000, 64


def golomb_encode(values: np.ndarray) -> tuple[int, bytes]:
    """Sorted distinct uint64 values as (Rice parameter, code): of all differences the quotients as so many zeros and a one, then the r low bits of each."""
    if not len(values):
        return 0, b""
    delta = np.diff(values, prepend=np.uint64(0)).astype(np.uint64)
    mean = max(1, int(values[-1]) // len(values))
    r = max(0, mean.bit_length() - 1)
    unary = np.zeros(int((delta >> np.uint64(r)).sum()) + len(values), np.uint8)
    unary[np.cumsum((delta >> np.uint64(r)).astype(np.int64) + 1) - 1] = 1
    low = np.unpackbits(delta.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, 64 - r :]
    return r, np.packbits(np.concatenate((unary, low.ravel()))).tobytes()


def golomb_decode(r: int, code: bytes, n: int) -> np.ndarray:
    if not n:
        return np.empty(0, np.uint64)
    bits = np.unpackbits(np.frombuffer(code, np.uint8))
    ones = np.flatnonzero(bits[: len(bits) - n * r])[:n]  # the n-th one ends the quotients, before any remainder
    low = np.zeros((n, 64), np.uint8)
    low[:, 64 - r :] = bits[ones[-1] + 1 : ones[-1] + 1 + n * r].reshape(n, r)
    remainder = np.packbits(low, axis=1).view(">u8").ravel().astype(np.uint64)
    quotient = np.diff(ones, prepend=-1).astype(np.uint64) - np.uint64(1)
    return np.cumsum((quotient << np.uint64(r)) | remainder, dtype=np.uint64)


def _owner(fp: np.ndarray, owners: int) -> np.ndarray:
    return ((fp >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)


def _first(owner: int, owners: int) -> np.uint64:
    """The smallest fingerprint of an owner."""
    return np.uint64(-(-(owner << 32) // owners) << 32)


def blocks(prints: DataFrame, size: int = BLOCK_PRINTS) -> DataFrame:
    """(block, prints: sorted distinct fp as little-endian uint64, repeated: a bitmap of those that repeat inside the block) of (fp long), bucketed by block."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth, held, n = TaskContext.get().partitionId(), 0, [], 0

        def row() -> pa.RecordBatch:
            own, times = np.unique(np.concatenate(held), return_counts=True)
            return pa.record_batch({"block": pa.array([(part << 24) + nth], pa.int64()), "prints": pa.array([own.astype("<u8").tobytes()], pa.binary()), "repeated": pa.array([np.packbits(times > 1).tobytes()], pa.binary())})

        for batch in batches:
            held.append(batch.column("fp").to_numpy().view(np.uint64))
            n += len(held[-1])
            if n >= size:
                yield row()
                nth, held, n = nth + 1, [], 0
        if n:
            yield row()

    return bucketed(prints.select("fp").mapInArrow(fill, "block bigint, prints binary, repeated binary"), "blocks", "block")


def suspects(held: DataFrame, owners: int | None = None) -> DataFrame:
    """Of blocks: the distinct fp that occur in more than one row."""
    if owners is None:
        (total,) = held.agg(F.coalesce(F.sum(F.octet_length("prints")), F.lit(0))).first()
        owners = max(1, min(partitions(held.sparkSession), max(LEAST_OWNERS, total // 8 // OWNER_PRINTS)))

    def cuts(own: np.ndarray) -> np.ndarray:
        return np.searchsorted(_owner(own, owners), np.arange(owners + 1))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, code in zip(batch.column("block").to_pylist(), batch.column("prints").to_pylist(), strict=True):
                own = np.frombuffer(code, "<u8")
                at = cuts(own)
                rows = [(block, o, b - a, *golomb_encode(own[a:b] - _first(o, owners))) for o, (a, b) in enumerate(zip(at, at[1:], strict=False)) if b > a]
                kinds = {"block": pa.int64(), "owner": pa.int32(), "n": pa.int64(), "r": pa.int32(), "code": pa.binary()}
                yield pa.record_batch({k: pa.array(v, kind) for (k, kind), v in zip(kinds.items(), zip(*rows, strict=True), strict=True)})

    def answer(t: pa.Table) -> pa.Table:
        runs = [golomb_decode(*x) for x in zip(t["r"].to_pylist(), t["code"].to_pylist(), t["n"].to_pylist(), strict=True)]
        every = np.sort(np.concatenate(runs))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        maps = [np.packbits(np.isin(run, twice, assume_unique=True)).tobytes() for run in runs]
        return pa.table({"block": t["block"], "owner": t["owner"], "bitmap": pa.array(maps, pa.binary())})

    def mark(left: pa.Table, right: pa.Table) -> pa.Table:
        own = np.frombuffer(left["prints"][0].as_py(), "<u8")
        shared = np.unpackbits(np.frombuffer(left["repeated"][0].as_py(), np.uint8))[: len(own)].astype(bool)
        at = cuts(own)
        for o, bitmap in zip(right["owner"].to_pylist(), right["bitmap"].to_pylist(), strict=True):
            a, b = at[o], at[o + 1]
            shared[a:b] |= np.unpackbits(np.frombuffer(bitmap, np.uint8))[: b - a].astype(bool)
        return pa.table({"fp": pa.array(own[shared].view(np.int64), pa.int64())})

    runs = held.select("block", "prints").mapInArrow(send, "block bigint, owner int, n long, r int, code binary")
    maps = runs.groupBy("owner").applyInArrow(answer, "block bigint, owner int, bitmap binary")
    return held.groupBy("block").cogroup(maps.groupBy("block")).applyInArrow(mark, "fp long").distinct()


def exact_dedup(docs: DataFrame, block_prints: int = BLOCK_PRINTS, owners: int | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    norm = ascii_lower(text_of(docs))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), norm.alias("norm")).select("doc_id", "norm", F.xxhash64("norm").alias("fp"))
    base = stored(rows.select("doc_id", "fp", F.sha2("norm", 256).alias("text_sha256")), "prints")
    hot = stored(suspects(blocks(base, block_prints), owners), "suspects")
    verified = rows.join(hot, "fp", "left_semi").groupBy("fp", "norm").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    classes = verified.select("fp", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size", F.lit(True).alias("hit"))
    out = base.join(classes, ["fp", "text_sha256"], "left")
    keep = F.when(F.col("hit"), F.col("keep_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


ORACLE = """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id is not distinct from max(doc_id) over w as kept, sha256(norm) as text_sha256
from (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as norm from documents)
window w as (partition by norm)
"""
