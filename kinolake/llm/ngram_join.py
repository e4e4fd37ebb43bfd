"""N-gram Jaccard join: token-combination prefixes, then verification, then components.

A document's set holds the hashes of its distinct five-word shingles. Equal sets are one class from the
start: a class is named by a hash of its set and every task posts a class once, so a group of copies, however large, costs
as much as one document.

1. Shingles are dealt by hash in packed runs, counted, and those of two or more classes go back to their classes.
   Shingles are ordered rare first: by class count up to FREQUENT, then by hash; all beyond FREQUENT form the frequent class.
   One that occurs FREQUENT times within one run is frequent for certain and goes straight to its classes, so no
   frequent shingle gathers its postings in one task.
2. Two sets that link share a token of their prefixes, n - ceil(t n) + 1 tokens long, and two of prefixes longer by
   one. Rare tokens are keys by themselves. Frequent ones of sets of up to PAIRED shingles are keys in
   combinations of two of the extended prefix; those of sets of at least t * PAIRED are keys by themselves, so any two linkable sets
   have a common form. Sets of unshared shingles only have no key.
3. Rounds: of each key, a leader (then LEADERS of them, then MORE times as many each round) is paired with the other members that aren't in its component
   yet and whose sizes allow a link; pairs are verified by their whole intersections; components are joined; a leader has
   then met every member and leaves the key; a key whose rest is one component is done. Pairs stay linear in a key's members each round,
   and no link between components can be missed: a key ends only when no two of its members' components differ.

Null or wordless text: empty set, linked with nothing, component_id its own doc_id. With fewer than five words the whole
sequence is the one shingle. Rows with a null doc_id are kept; a component's id is its smallest non-null doc_id. Repeated rows, ties and
extra columns change nothing; an empty table gives an empty result. Shingles and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHashes, byte_texts, components, partitions, shingles, stored

PERCENT = 75
FREQUENT = 32  # at most 255
PAIRED = 64
LEADERS, MORE = 32, 8
#: Postings and documents of one packed run.
RUN_POSTINGS, RUN_DOCS = 1_500_000, 60_000
_EMPTY = np.empty(0, np.uint64)

_RUN = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("tokens", pa.binary()), ("sets", pa.binary()), ("names", pa.binary()), ("sizes", pa.binary()), ("docs", pa.list_(pa.int64())), ("counts", pa.binary())])
_RUN_SQL = "bucket int, kind int, tokens binary, sets binary, names binary, sizes binary, docs array<bigint>, counts binary"
#: Kinds of packed runs: documents; postings to count; tokens frequent for certain; postings of such tokens; counted postings.
_DOCS, _COUNT, _CERTAIN, _DIRECT, _SHARED = range(5)


def _squeeze(values: np.ndarray) -> bytes:
    """Sorted uint64 values as differences, byte plane by byte plane, as many planes as needed."""
    delta = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    delta[0] = 0
    width = max(1, -(-int(delta.max()).bit_length() // 8))
    return bytes([width]) + values[:1].astype("<u8").tobytes() + delta.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _expand(code: bytes) -> np.ndarray:
    width = code[0]
    planes = np.frombuffer(code, np.uint8, offset=9).reshape(width, -1)
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, :width] = planes.T
    delta = wide.view("<u8").ravel()
    return np.cumsum(delta, dtype=np.uint64) + np.frombuffer(code, "<u8", count=1, offset=1)[0]


def _bucket(token: np.ndarray, n: int) -> np.ndarray:
    return (((token >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int32)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), _RUN, strict=True)], schema=_RUN)


def _name(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes())


def _pack_by(bucket: np.ndarray, kind: int, tokens: np.ndarray, at: np.ndarray, names: np.ndarray, sizes: np.ndarray) -> Iterator[tuple]:
    """Rows of a run whose postings are sorted by bucket, then token."""
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(bucket)], strict=True):
        own, place = np.unique(at[a:b], return_inverse=True)
        yield int(bucket[a]), kind, _squeeze(tokens[a:b]), place.astype("<u2").tobytes(), names[own].tobytes(), sizes[own].astype("<u4").tobytes(), None, None


def _post(buckets: int, frequent: int):
    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, seen = WordHashes(), set()
        held: list[np.ndarray] = []
        names: list[int] = []
        total = 0

        def run() -> Iterator[pa.RecordBatch]:
            sizes = np.array([len(s) for s in held], np.int64)
            tokens, at = np.concatenate(held), np.repeat(np.arange(len(held)), sizes)
            order = np.argsort(tokens, kind="stable")
            tokens, at, named = tokens[order], at[order], np.array(names, np.uint64)
            first = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
            often = np.diff(np.append(first, len(tokens))) >= frequent
            direct = np.repeat(often, np.diff(np.append(first, len(tokens))))
            if often.any():
                certain = tokens[first[often]]
                where = _bucket(certain, buckets)
                cuts = np.flatnonzero(np.diff(where)) + 1
                yield _batch([(int(where[a]), _CERTAIN, _squeeze(certain[a:b]), b"", b"", b"", None, None) for a, b in zip([0, *cuts], [*cuts, len(where)], strict=True)])
                home = (named[at[direct]] % np.uint64(buckets)).astype(np.int32)
                o = np.lexsort((tokens[direct], home))
                yield _batch(list(_pack_by(home[o], _DIRECT, tokens[direct][o], at[direct][o], named, sizes)))
            rest = ~direct
            if rest.any():
                yield _batch(list(_pack_by(_bucket(tokens[rest], buckets), _COUNT, tokens[rest], at[rest], named, sizes)))

        for batch in batches:
            ids, who, sizes = batch.column("doc_id").to_pylist(), [], []
            for text in byte_texts(batch.column("text")):
                s = shingles(text, cache)
                who.append(_name(s) if len(s) else 0)
                sizes.append(len(s))
                if not len(s) or who[-1] in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(who[-1])
                held.append(s)
                names.append(who[-1])
                total += len(s)
                if total >= RUN_POSTINGS or len(held) >= RUN_DOCS:
                    yield from run()
                    held, names, total = [], [], 0
            if ids:
                yield _batch([((who[0] + len(ids)) % buckets, _DOCS, None, None, np.array(who, np.uint64).tobytes(), np.array(sizes, "<u4").tobytes(), ids, None)])
        if held:
            yield from run()

    return post


def _unpack(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, names, sizes) of packed postings."""
    if not rows:
        return _EMPTY, _EMPTY, np.empty(0, np.int64)
    place = [np.frombuffer(r["sets"], "<u2") for r in rows]
    tokens = np.concatenate([_expand(r["tokens"]) for r in rows])
    names = np.concatenate([np.frombuffer(r["names"], "<u8")[p] for r, p in zip(rows, place, strict=True)])
    sizes = np.concatenate([np.frombuffer(r["sizes"], "<u4")[p] for r, p in zip(rows, place, strict=True)])
    return tokens, names, sizes.astype(np.int64)


def _count(buckets: int, frequent: int):
    """Per bucket of tokens: shared postings, packed by the home of their class, with the count where it is below FREQUENT."""

    def count(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        tokens, names, sizes = _unpack([r for r in rows if r["kind"] == _COUNT])
        sure = [_expand(r["tokens"]) for r in rows if r["kind"] == _CERTAIN]
        out = [(r["bucket"], r["kind"], r["tokens"], r["sets"], r["names"], r["sizes"], r["docs"], None) for r in rows if r["kind"] in (_DOCS, _DIRECT)]
        if len(tokens):
            order = np.lexsort((names, tokens))
            tokens, names, sizes = tokens[order], names[order], sizes[order]
            fresh = np.concatenate(([True], (tokens[1:] != tokens[:-1]) | (names[1:] != names[:-1])))
            tokens, names, sizes = tokens[fresh], names[fresh], sizes[fresh]
            first = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
            times = np.diff(np.append(first, len(tokens)))
            df = np.minimum(times, frequent)
            if sure:
                df[np.isin(tokens[first], np.concatenate(sure))] = frequent
            df = np.repeat(df, times)
            shared = df > 1
            tokens, names, sizes, df = tokens[shared], names[shared], sizes[shared], df[shared]
            home = (names % np.uint64(buckets)).astype(np.int32)
            order = np.lexsort((tokens, home))
            tokens, names, sizes, df, home = tokens[order], names[order], sizes[order], df[order].astype(np.uint8), home[order]
            cuts = np.flatnonzero(np.diff(home)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(home)], strict=True) if len(home) else ():
                own, place = np.unique(names[a:b], return_inverse=True)
                size = np.zeros(len(own), np.int64)
                size[place] = sizes[a:b]
                for lo in range(0, len(own), 65536):  # places are two bytes
                    inside = (place >= lo) & (place < lo + 65536)
                    out.append((int(home[a]), _SHARED, _squeeze(tokens[a:b][inside]), (place[inside] - lo).astype("<u2").tobytes(), own[lo : lo + 65536].tobytes(), size[lo : lo + 65536].astype("<u4").tobytes(), None, df[a:b][inside].tobytes()))
        return pa.Table.from_batches([_batch(out)] if out else [], schema=_RUN)

    return count


_SET = pa.schema([("doc_id", pa.int64()), ("name", pa.int64()), ("n", pa.int32()), ("own", pa.int32()), ("rare", pa.int32()), ("tokens", pa.list_(pa.int64()))])
_SET_SQL = "doc_id bigint, name bigint, n int, own int, rare int, tokens array<bigint>"


def _prefix(n: np.ndarray, percent: int) -> np.ndarray:
    return n - -(-(percent * n) // 100) + 1


def _gather(percent: int, frequent: int):
    """Per home bucket: the documents, and of each class whose prefix reaches shared tokens those tokens, rare first."""

    def gather(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        out = []
        for r in rows:
            if r["kind"] == _DOCS:
                k = len(r["docs"])
                out.append(pa.RecordBatch.from_arrays([pa.array(r["docs"], pa.int64()), pa.array(np.frombuffer(r["names"], "<u8").view(np.int64)), pa.array(np.frombuffer(r["sizes"], "<u4").astype(np.int32)), *[pa.nulls(k, f.type) for f in list(_SET)[3:]]], schema=_SET))
        posts = [r for r in rows if r["kind"] != _DOCS]
        if posts:
            df = np.concatenate([np.full(len(r["sets"]) // 2, frequent, np.int64) if r["kind"] == _DIRECT else np.frombuffer(r["counts"], np.uint8).astype(np.int64) for r in posts])
            tokens, names, sizes = _unpack(posts)
            order = np.lexsort((tokens, df, names))
            tokens, names, sizes, df = tokens[order], names[order], sizes[order], df[order]
            fresh = np.concatenate(([True], (tokens[1:] != tokens[:-1]) | (names[1:] != names[:-1])))
            tokens, names, sizes, df = tokens[fresh], names[fresh], sizes[fresh], df[fresh]
            start = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1])))
            stop = np.append(start[1:], len(names))
            n, shared = sizes[start], stop - start
            rare = np.add.reduceat((df < frequent).astype(np.int64), start)
            keep = np.flatnonzero(_prefix(n, percent) + 1 > n - shared)  # the extended prefix reaches a shared token
            if len(keep):
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(shared[keep]))), pa.int32()), pa.array(np.concatenate([tokens[a:b] for a, b in zip(start[keep], stop[keep], strict=True)]).view(np.int64)))
                out.append(pa.RecordBatch.from_arrays([pa.nulls(len(keep), pa.int64()), pa.array(names[start[keep]].view(np.int64)), pa.array(n[keep], pa.int32()), pa.array((n - shared)[keep], pa.int32()), pa.array(rare[keep], pa.int32()), lists], schema=_SET))
        return pa.Table.from_batches(out, schema=_SET)

    return gather


def sets(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(documents: doc_id, name, n; candidates: name, n, own (unshared shingles), rare (shared ones below FREQUENT), tokens)."""
    buckets = partitions(docs.sparkSession)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    posted = rows.mapInArrow(_post(buckets, FREQUENT), _RUN_SQL)
    counted = posted.groupBy("bucket").applyInArrow(_count(buckets, FREQUENT), _RUN_SQL)
    both = stored(counted.groupBy("bucket").applyInArrow(_gather(percent, FREQUENT), _SET_SQL), "sets", free=True)
    return both.where("tokens is null").select("doc_id", "name", "n"), both.where("tokens is not null").drop("doc_id")


def keys(candidates: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(name, n, shared, key, left): rare prefix tokens, frequent ones, and combinations of two frequent ones of the extended prefix."""
    n, own, rare = F.col("n"), F.col("own"), F.col("rare")
    prefix = n - F.ceil(F.lit(percent) * n / 100).cast("int") + 1
    base = candidates.select("*", (prefix - own).alias("reach"))
    size, none = F.size("tokens"), F.array().cast("array<struct<key:bigint,left:int>>")
    # left: shared tokens from the key's place on, which bound an overlap that begins there
    at = lambda tokens, first: F.transform(tokens, lambda x, i: F.struct(x.alias("key"), (size - first - i).alias("left")))
    singles = at(F.slice("tokens", F.lit(1), F.greatest(F.lit(0), F.least(rare, F.col("reach")))), F.lit(0))
    frequent = at(F.slice("tokens", rare + 1, F.greatest(F.lit(0), F.col("reach") - rare)), rare)
    frequent = F.when(n * 100 >= percent * PAIRED, frequent).otherwise(none)
    wide = F.slice("tokens", rare + 1, F.greatest(F.lit(0), F.col("reach") + 1 - rare))
    after = lambda i: F.slice(wide, i + 2, F.greatest(F.lit(0), F.size(wide) - i - 1))
    pairs = F.flatten(F.transform(wide, lambda x, i: F.transform(after(i), lambda y: F.struct(F.xxhash64(x, y).alias("key"), (size - rare - i).alias("left")))))
    pairs = F.when(n <= PAIRED, pairs).otherwise(none)
    return base.select("name", "n", size.alias("shared"), F.explode(F.concat(singles, frequent, pairs)).alias("k")).select("name", "n", "shared", "k.key", "k.left")


def _verified(pairs: DataFrame, candidates: DataFrame, percent: int) -> DataFrame:
    """The (a, b) that link; a is the leader, which the second join meets, where Spark can split it."""
    x = candidates.select(F.col("name").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    y = candidates.select(F.col("name").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    both = F.size(F.array_intersect("ta", "tb"))
    return pairs.join(x, "b").join(y, "a").where(100 * both >= percent * (F.col("na") + F.col("nb") - both)).select("a", "b")


def links(candidates: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, root): components of classes."""
    spark = candidates.sparkSession
    # a leader should be central: the fewer of its shingles are its own, the more it may have in common with others
    held = keys(candidates, percent).withColumns({"comp": F.col("name"), "odd": F.floor(1000 * (F.col("n") - F.col("shared")) / F.col("n"))})
    several = held.groupBy("key").agg(F.count("*").alias("m"), F.min(F.struct("odd", "name"))["name"].alias("leader")).where("m > 1")
    held = stored(held.join(several, "key"), "keys")
    edges, roots = None, None
    # sizes that differ too much can't link; a pair that links does so by the key of its first common token, behind which both have tokens enough
    can = (F.lit(100) * F.least("n", "ln") >= F.lit(percent) * F.greatest("n", "ln")) & ((100 + percent) * F.least("left", "ll") >= F.lit(percent) * (F.col("n") + F.col("ln")))
    led = [F.col("key"), F.col("name").alias("a"), F.col("n").alias("ln"), F.col("left").alias("ll"), F.col("comp").alias("lc")]
    leaders = 1
    while not held.isEmpty():
        if leaders == 1:
            lead = held.where("name = leader").select(*led)
        else:
            order = F.row_number().over(Window.partitionBy("key").orderBy("odd", "name"))
            lead = held.select(*led, order.alias("nth")).where(F.col("nth") <= leaders).drop("nth")
        met = held.join(lead, "key").where((F.col("name") != F.col("a")) & (F.col("comp") != F.col("lc")) & can)
        pairs = met.select(F.least("a", "name").alias("a"), F.greatest("a", "name").alias("b")).distinct()
        new = _verified(pairs, candidates, percent)
        edges = stored(new if edges is None else edges.union(new), "links")
        roots = stored(components(edges), "roots")
        rest = held.join(lead.select("key", F.col("a").alias("name")), ["key", "name"], "left_anti").select("key", "name", "n", "left", "odd")
        rest = rest.join(roots.withColumnRenamed("node", "name"), "name", "left").select("key", "name", "n", "left", "odd", F.coalesce("root", "name").alias("comp"))
        rest = stored(rest, "rest")
        open_ = rest.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
        held = stored(rest.join(open_, "key", "left_semi"), "open")
        leaders = LEADERS if leaders == 1 else leaders * MORE
    return roots if roots is not None else spark.createDataFrame([], "node bigint, root bigint")


def ngram_join(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    every, candidates = sets(docs, percent)
    roots = links(candidates, percent)
    classes = every.where("n > 0").groupBy("name").agg(F.min("doc_id").alias("least"))
    named = classes.join(roots.withColumnRenamed("node", "name"), "name", "left").select("name", F.coalesce("root", "name").alias("root"), "least")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    found = named.join(least, "root").select("name", "component_id")
    out = every.join(found, "name", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


ORACLE = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sh as (
  select distinct doc_id, s from (
    select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
      else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) end) as s from words)),
n as (select doc_id, count(*) as n from sh group by doc_id),
pairs as (select a.doc_id as x, b.doc_id as y, count(*) as c from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by all),
link as (select x, y from pairs join n p on p.doc_id = x join n q on q.doc_id = y where 100 * c >= 75 * (p.n + q.n - c)),
both_ways as (select x, y from link union all select y, x from link),
reach as (select doc_id as node, doc_id as seen from documents union select r.node, b.y from reach r join both_ways b on r.seen = b.x)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, r.c as component_id
from documents d left join n on n.doc_id = d.doc_id join (select node, min(seen) as c from reach group by node) r on r.node = d.doc_id
"""
