"""Clusters of feature rows (fid, feature) for the explorers and labelers: average linkage and medoids.

Distances are Euclidean. What the driver holds is bounded by parameters: the matrix of the last clusters of average linkage (`small`), and the medoids asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import shared_folder, stored
from .store import numbered

# --- average linkage ---


def vectors_of(column: pd.Series) -> np.ndarray:
    """A matrix of the column's vectors."""
    return np.array([np.asarray(x, np.float64) for x in column]).reshape(len(column), -1)


def differences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of a to all of b from differences, in blocks of rows."""
    out = np.empty((len(a), len(b)))
    step = max(1, 4_000_000 // max(1, b.size))
    for i in range(0, len(a), step):
        d = a[i : i + step, None, :] - b[None, :, :]
        out[i : i + step] = np.sqrt(np.einsum("ijk,ijk->ij", d, d))
    return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of a to all of b by products of matrices, in tiles. Where little is left of the norms, and so of the digits (close or
    infinite points), they are taken from differences."""
    out = np.empty((len(a), len(b)))
    own, other = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    for i in range(0, len(a), 128):
        for j in range(0, len(b), 2048):
            one, two = a[i : i + 128], b[j : j + 2048]
            with np.errstate(invalid="ignore", over="ignore"):
                square = (-2.0 * one) @ two.T
                square += own[i : i + 128, None]
                square += other[j : j + 2048]
                if not square.min() >= 0.01 * (own[i : i + 128].max() + other[j : j + 2048].max()):
                    x, y = np.nonzero(~(square >= 0.01 * (own[i : i + 128, None] + other[j : j + 2048])))
                    for k in range(0, len(x), 20_000):
                        d = one[x[k : k + 20_000]] - two[y[k : k + 20_000]]
                        square[x[k : k + 20_000], y[k : k + 20_000]] = np.einsum("ij,ij->i", d, d)
                np.sqrt(square, out=out[i : i + 128, j : j + 2048])
    return out


def nearest_row(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of a the nearest of b, the first of equals, and its distance, both from differences where others are as close but for rounding."""
    d = distances(a, b)
    best = d.argmin(axis=1)
    close = d <= d[np.arange(len(d)), best][:, None] * (1 + 1e-12)
    for i in np.flatnonzero(close.sum(axis=1) > 1):
        at = np.flatnonzero(close[i])
        best[i] = at[differences(a[i : i + 1], b[at])[0].argmin()]
    gap = a - b[best]
    return best, np.sqrt(np.einsum("ij,ij->i", gap, gap))


#: Clusters of tables meet in blocks of about so many points; a larger cluster is cut into so large pieces.
BLOCK = 1024
#: Points of changed clusters are sent to all tasks up to so many values of their vectors; more meet the others by pairs of partitions.
SENT = 1 << 20
#: Steps in which heights of merges are counted, in one doubling of height.
STEPS = 4096


def _by_size(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Columns of points, in clusters of these sizes, added to columns of clusters."""
    starts = np.cumsum(sizes) - sizes
    if (np.diff(sizes) < 0).any():
        return np.add.reduceat(rows, starts, axis=1)
    out = np.empty((len(rows), len(sizes)))
    for size in np.unique(sizes):
        first, end = np.searchsorted(sizes, size), np.searchsorted(sizes, size, "right")
        block = rows[:, starts[first] : starts[end - 1] + size]
        if size > 16:
            out[:, first:end] = np.add.reduceat(block, np.arange(0, block.shape[1], size), axis=1)
        else:
            out[:, first:end] = sum(block[:, k::size] for k in range(size))
    return out


class _Block:
    """Points of a block, cluster by cluster: `node` names the clusters, `count` has their points here, `total` their weights and `cut` whether others hold points of them, too."""

    def __init__(self, c, m, w, total, x, block: int):
        self.node, self.first, self.count = np.unique(np.asarray(c), return_index=True, return_counts=True)
        turn = np.argsort(self.first)
        self.node, self.first, self.count = self.node[turn], self.first[turn], self.count[turn]
        self.total, self.cut, self.w = np.asarray(total)[self.first], np.asarray(m)[self.first] > block, np.asarray(w)
        self.x = np.asarray(x, np.float64).reshape(len(self.w), -1)

    def sums(self, other: _Block) -> np.ndarray:
        """Weighted sums of distances of its clusters (rows) to those of another block."""
        out = np.zeros((len(self.node), len(other.node)))
        of = np.repeat(np.arange(len(self.node)), self.count)
        even, evenly = (self.w == self.w[0]).all(), (other.w == other.w[0]).all()
        for i in range(0, len(self.w), 128):
            part = distances(self.x[i : i + 128], other.x)
            if not evenly:
                part *= other.w
            if len(other.node) < len(other.w):
                part = _by_size(part, other.count)
            if not even:
                part *= self.w[i : i + 128, None]
            own = of[i : i + 128]
            first = np.flatnonzero(np.diff(own, prepend=-1))
            out[own[0] : own[-1] + 1] += part if len(first) == len(part) else np.add.reduceat(part, first, axis=0)
        scale = (self.w[0] if even else 1.0) * (other.w[0] if evenly else 1.0)
        return out if scale == 1.0 else np.multiply(out, scale, out=out)


def _turn(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number of each pair of clusters, whichever comes first: it decides among equal distances, so that many of those are mutual."""
    low, high = np.minimum(a, b).astype(np.uint64), np.maximum(a, b).astype(np.uint64)
    h = low * np.uint64(0x9E3779B97F4A7C15) ^ (high + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(1)).astype(np.int64)


def _nearest_in(left: _Block, right: _Block, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(near, height, turn) of each cluster on the left: the nearest whole one on the right, without one an infinite height."""
    mean = sums if (right.total == right.total[0]).all() else sums / right.total
    mean = mean.copy() if mean is sums and (left.cut.any() or right.cut.any() or len(np.intersect1d(left.node, right.node))) else mean
    if mean is not sums:
        mean[left.cut] = np.inf
        mean[:, right.cut] = np.inf
        _, i, j = np.intersect1d(left.node, right.node, return_indices=True)
        mean[i, j] = np.inf
    best = mean.argmin(axis=1)
    least = mean[np.arange(len(mean)), best]
    if np.isnan(least).any():
        return _nearest_in(left, right, np.where(np.isnan(sums), np.inf, sums))
    if np.count_nonzero(mean == least[:, None]) > len(mean):
        for i in np.flatnonzero(((mean == least[:, None]).sum(axis=1) > 1) & np.isfinite(least)):
            at = np.flatnonzero(mean[i] == least[i])
            best[i] = at[_turn(left.node[i], right.node[at]).argmin()]
    height = np.where(np.isfinite(least), sums[np.arange(len(sums)), best] / (left.total * right.total[best]), np.inf)
    return right.node[best], height, _turn(left.node, right.node[best])


def _met(left: DataFrame, right: DataFrame, sent: bool) -> DataFrame:
    """All pairs of blocks, in columns of the left (l_) and the right (r_)."""
    flat = lambda df, p: df.select(F.col("block").alias(f"{p}_b"), *[F.col(f"s.{n}").alias(f"{p}_{n}") for n in ("c", "m", "w", "total")], F.flatten("s.x").alias(f"{p}_x"))
    one, two = flat(left, "l"), flat(right, "r")
    return two.crossJoin(F.broadcast(one)) if sent else one.hint("shuffle_replicate_nl").crossJoin(two)


def _nearest(left: DataFrame, right: DataFrame, sent: bool, cut: bool, block: int) -> DataFrame:
    """(c, near, height) of the clusters in the blocks on the left: the nearest other cluster on the right by mean distance. Of each pair of blocks only the nearest
    leave the task, and sums for clusters cut into pieces (cut: there are any)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple] = {}

        def let_go() -> pd.DataFrame:
            out = pd.concat([pd.DataFrame({"c": c, "near": n, "height": h, "turn": t})[np.isfinite(h)] for c, n, h, t in held.values()])
            held.clear()
            return out.assign(part=0.0, both=0.0)

        for b in batches:
            for r in b.itertuples(index=False):
                one, two = (_Block(*(getattr(r, f"{p}_{n}") for n in ("c", "m", "w", "total", "x")), block) for p in "lr")
                sums = one.sums(two)
                near, height, turn = _nearest_in(one, two, sums)
                if r.l_b in held:
                    _, n, h, t = held[r.l_b]
                    worse = (height > h) | ((height == h) & (turn > t))
                    near, height, turn = np.where(worse, n, near), np.where(worse, h, height), np.where(worse, t, turn)
                held[r.l_b] = (one.node, near, height, turn)
                if len(held) > 64:
                    yield let_go()
                for i in np.flatnonzero(one.cut) if not two.cut.any() else range(len(one.node)):
                    at = np.flatnonzero((two.cut | one.cut[i]) & (two.node != one.node[i]))
                    if len(at):
                        yield pd.DataFrame({"c": one.node[i], "near": two.node[at], "height": np.inf, "turn": _turn(one.node[i], two.node[at]), "part": sums[i, at], "both": one.total[i] * two.total[at]})
        if held:
            yield let_go()

    out = _met(left, right, sent).mapInPandas(run, "c long, near long, height double, turn long, part double, both double")
    if cut:
        out = stored(out, "linkage")  # distances aren't computed for each of the two
        pieces = out.where("both > 0").groupBy("c", "near", "turn").agg((F.sum("part") / F.first("both")).alias("height"))
        out = out.where("both = 0").select("c", "near", "height", "turn").unionByName(pieces)
    return out.groupBy("c").agg(F.min(F.struct("height", "turn", "near")).alias("n")).select("c", "n.near", "n.height")


def _blocks(points: DataFrame, many: int, block: int, tasks: int) -> DataFrame:
    """(block, s): points (c, m, pid, w, total, stale, x) in about `many` blocks, a cluster in one of them unless it is cut into pieces; the small clusters of a block first."""
    pieces = F.pmod(F.xxhash64("pid"), F.ceil(F.col("m") / block))
    key = F.when(F.col("m") <= block, F.pmod(F.xxhash64("c"), F.lit(many))).otherwise(F.lit(many) + F.pmod(F.xxhash64("c", pieces), F.lit(1 << 40)))
    dealt = points.withColumn("block", key).repartition(max(1, min(many, tasks)), "block")
    return dealt.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("m", "c", "pid", "w", "total", "stale", "x"))).alias("s"))


def _step(height: Column) -> Column:
    """The step in which a height is counted; a larger one is never in a lower step."""
    return F.coalesce(F.floor(F.log2(height) * STEPS), F.lit(-(1 << 40))).cast("long")


def _fate(state: DataFrame) -> DataFrame:
    """What becomes of the clusters (c, near, height, low, total, m) of a round: (c, into, low, total, m) of the cluster that it belongs to now, whether it `merges` (it and its nearest are
    each other's nearest), whether its nearest is to be looked for (`stale`), and the step of its height."""
    other = state.select(F.col("c").alias("near"), F.col("near").alias("_near"), F.col("height").alias("_height"), F.col("low").alias("_low"), F.col("total").alias("_total"), F.col("m").alias("_m"))
    both = state.join(other, "near", "left").withColumn("merges", F.coalesce(F.col("_near") == F.col("c"), F.lit(False)))
    gone = both.where("merges").select(F.col("c").alias("near"), F.lit(True).alias("_gone"))
    new = lambda merged, name: F.when(F.col("merges"), merged).otherwise(F.col(name)).alias(name)
    low = F.greatest(F.least("height", "_height"), "low", "_low")
    out = both.join(gone, "near", "left").withColumn("into", F.when(F.col("merges"), F.least("c", "near")).otherwise(F.col("c")))
    out = out.select("c", "into", "near", "height", "merges", (F.col("merges") | F.col("_gone").isNotNull()).alias("stale"), new(low, "low"), new(F.col("total") + F.col("_total"), "total"), new(F.col("m") + F.col("_m"), "m"))
    return out.withColumn("step", _step(F.when(F.col("merges"), F.col("low")).otherwise(F.col("height"))))


def _finished(blocks: DataFrame, state: pd.DataFrame, block: int) -> list[tuple[int, int, int, float]]:
    """Merges (turn, a, b, height) of the last few clusters (c, low, total, by c), from the matrix of their sums of distances, which is changed in place."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                one, two = (_Block(*(getattr(r, f"{p}_{n}") for n in ("c", "m", "w", "total", "x")), block) for p in "lr")
                yield pd.DataFrame({"a": [one.node.astype(np.int64).tobytes()], "b": [two.node.astype(np.int64).tobytes()], "sums": [one.sums(two).tobytes()]})

    name, low, sizes = state["c"].to_numpy(), state["low"].to_numpy().copy(), state["total"].to_numpy(np.float64).copy()
    sums = np.zeros((len(name), len(name)))
    for r in _met(blocks, blocks, False).where("l_b <= r_b").mapInPandas(run, "a binary, b binary, sums binary").toLocalIterator(prefetchPartitions=True):
        a, b = (np.searchsorted(name, np.frombuffer(x, np.int64)) for x in (r["a"], r["b"]))
        part = np.frombuffer(r["sums"]).reshape(len(a), -1)
        sums[np.ix_(a, b)] += part
        if not np.array_equal(a, b):
            sums[np.ix_(b, a)] += part.T
    np.fill_diagonal(sums, np.inf)
    own = np.arange(len(name))
    near, height, left, merges, turn = np.zeros(len(name), np.int64), np.full(len(name), np.inf), np.ones(len(name), bool), [], 0
    stale = own
    while left.sum() > 1:
        for i in range(0, len(stale), 256):
            mean = sums[stale[i : i + 256]] / (sizes[stale[i : i + 256], None] * sizes)
            near[stale[i : i + 256]] = at = mean.argmin(axis=1)
            height[stale[i : i + 256]] = mean[np.arange(len(at)), at]
        pairs = own[left & (near[near] == own) & (own < near)]
        if not len(pairs):  # equal distances, or rounding: then the closest cluster and its nearest
            i = np.flatnonzero(left)[height[left].argmin()]
            pairs = np.array([min(i, near[i])])
            near[pairs] = max(i, near[i])
        gone = np.zeros(len(name), bool)
        for a, b in zip(pairs, near[pairs], strict=True):
            low[a] = max(height[a], low[a], low[b])
            merges.append((turn, int(name[a]), int(name[b]), float(low[a])))
            sums[a] += sums[b]
            sums[:, a] += sums[:, b]
            sums[b], sums[:, b], sums[a, a] = np.inf, np.inf, np.inf
            sizes[a] += sizes[b]
            left[b], gone[a], gone[b] = False, True, True
        stale = np.flatnonzero(left & (gone | gone[near]))
        turn += 1
    return merges


def merges_of(points: DataFrame, n: int, need: int, small: int = 4096, block: int = BLOCK) -> DataFrame:
    """(turn, a, b, height): at least the `need` lowest merges of average linkage of n points (pid, w: its weight, x: the vector), all different; `b`, a pid, names a cluster that
    from then on belongs to that of `a`. A merge is no lower than those it stands on, and of equal height comes in a later turn.

    In rounds all pairs of reciprocal nearest neighbours merge, which this linkage allows in any order. A merge brings nothing nearer to another cluster, so a round looks anew only at merged clusters and those
    whose nearest one merged; once there are enough merges, clusters whose nearest is farther than the last one needed can't matter any more and leave. All tables are
    Spark's: clusters and their points are stored a round, distances are computed from the points, block by block, and not kept. The driver holds counts of heights, and finishes the last
    `small` clusters by their matrix (8 small ** 2 bytes)."""
    spark = points.sparkSession
    at = shared_folder(spark, "linkage")
    tasks = max(4 * spark.sparkContext.defaultParallelism, n // (64 * block))
    many = lambda count: max(1, -(-count // block))
    schema = "turn int, a long, b long, height double"

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{at}/{name}")
        return spark.read.schema(df.schema).parquet(f"{at}/{name}")

    blocks = kept(_blocks(points.select("pid", "w", "x", F.col("pid").alias("c"), F.lit(1).cast("long").alias("m"), F.col("w").alias("total"), F.lit(True).alias("stale")), many(n), block, tasks), "blocks-0")
    if n <= small:
        state = points.select(F.col("pid").alias("c"), F.lit(0.0).alias("low"), F.col("w").alias("total")).toPandas().sort_values("c")
        return spark.createDataFrame(_finished(blocks, state, block), schema)
    dims = len(points.select("x").first()[0])
    clusters = points.select(F.col("pid").alias("c"), F.lit(0.0).alias("low"), F.col("w").alias("total"), F.lit(1).cast("long").alias("m"))
    state = kept(clusters.join(_nearest(blocks, blocks, n * dims <= SENT, False, block), "c"), "state-0")
    counts: dict[int, int] = {}
    turns, last = [], []

    def found() -> DataFrame:
        """The merges of the rounds so far."""
        made = [spark.read.parquet(*turns).where("merges and c > into").select("turn", F.col("into").alias("a"), F.col("c").alias("b"), F.col("low").alias("height"))] if turns else []
        made += [spark.createDataFrame(last, schema)] if last or not made else []
        return reduce(DataFrame.unionByName, made)

    for turn in count(1):
        fate = kept(_fate(state).withColumn("turn", F.lit(turn)), f"fate-{turn}")
        seen = fate.where("c = into").groupBy("step", "merges").agg(F.count("*").alias("n"), F.sum("m").alias("m"), F.sum(F.when(F.col("stale"), F.col("m"))).alias("stale"), F.max("m").alias("most"), F.min("height").alias("height")).toPandas()
        if not seen["merges"].any():  # equal distances, or rounding: then the closest cluster and its nearest
            first = state.orderBy("height", "c").first()
            if first is None:
                return found()
            pair = state.where(F.col("c") == first["near"]).first()
            turn_to = F.when(F.col("c") == first["near"], F.lit(first["c"])).otherwise(F.col("near"))
            state = state.where(F.col("c") != first["c"]) if pair is None else state.withColumn("near", turn_to)
            continue
        turns.append(f"{at}/fate-{turn}")
        for r in seen[seen["merges"]].itertuples():
            counts[r.step] = counts.get(r.step, 0) + r.n
        top = _step_of(counts, need)
        alive = seen if top is None else seen[seen["step"] <= top]
        if top is not None:
            least, height = alive["step"].min(), alive["height"].min()
            lower = sum(v for k, v in counts.items() if k < least)
            if not len(alive) or lower >= need or sum(v for k, v in counts.items() if k <= least) >= need and found().where(F.col("height") <= float(height)).count() >= need:
                return found()
        fate = fate if top is None else fate.where(F.col("step") <= top)
        moved = blocks.select(F.inline("s")).select("pid", "w", "x", "c").join(fate.select("c", "into", "m", "total", "stale"), "c").drop("c").withColumnRenamed("into", "c")
        blocks = kept(_blocks(moved, many(int(alive["m"].sum())), block, tasks), f"blocks-{turn}")
        left = fate.where("c = into").select("c", "near", "height", "low", "total", "m", "stale")
        if alive["n"].sum() <= small:
            last = [(turn + 1 + t, a, b, h) for t, a, b, h in _finished(blocks, left.select("c", "low", "total").toPandas().sort_values("c"), block)]
            return found()
        stale = int(alive["stale"].sum())
        fresh = _blocks(blocks.select(F.inline("s")).where("stale"), many(stale), block, tasks)
        found_now = _nearest(fresh, blocks, stale * dims <= SENT, bool(alive["most"].max() > block), block).select("c", F.col("near").alias("_near"), F.col("height").alias("_height"))
        both = left.join(found_now, "c", "left").withColumn("near", F.when(F.col("stale"), F.col("_near")).otherwise(F.col("near"))).withColumn("height", F.when(F.col("stale"), F.col("_height")).otherwise(F.col("height")))
        near_enough = F.col("near").isNotNull() if top is None else F.col("near").isNotNull() & (_step(F.col("height")) <= top)
        state = kept(both.where(near_enough).select("c", "near", "height", "low", "total", "m"), f"state-{turn}")
    raise AssertionError


def _step_of(counts: dict[int, int], need: int) -> int | None:
    """The step of the need-th lowest merge; None while there are fewer."""
    so_far = 0
    for step in sorted(counts):
        so_far += counts[step]
        if so_far >= need:
            return step
    return None

def dendrogram(points: np.ndarray, session, small: int = 1024, clusters: int = 1) -> list[tuple[int, int, float]]:
    """The merges (a row of each part, the height) of average linkage of a bounded matrix of points that leave `clusters` clusters, and maybe more of them."""
    _, first, of, same = np.unique(points, axis=0, return_index=True, return_inverse=True, return_counts=True)
    own = first[of.reshape(-1)]
    need = len(points) - max(1, clusters)
    merges = [(int(own[i]), int(i), 0.0) for i in np.flatnonzero(own != np.arange(len(points)))] if need > 0 else []
    if need > len(merges):
        rows = session.createDataFrame([(int(i), float(w), points[i].tolist()) for i, w in zip(first, same, strict=True)], "pid long, w double, x array<double>")
        merges += [(r["a"], r["b"], r["height"]) for r in merges_of(rows, len(first), need - len(merges), small).orderBy("turn", "a").collect()]
    return merges


def cut(merges: list[tuple[int, int, float]], n: int, k: int) -> np.ndarray:
    """The cluster (0 to k - 1, by first row) of each of n rows when the lowest merges leave k clusters. A merge is never lower than those below it."""
    root = np.arange(n)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    order = sorted(range(len(merges)), key=lambda i: (merges[i][2], i))
    for i in order[: max(0, n - max(1, k))]:
        a, b = find(merges[i][0]), find(merges[i][1])
        root[max(a, b)] = min(a, b)
    return np.unique([find(i) for i in range(n)], return_inverse=True)[1]


def _roots(merges: DataFrame, need: int) -> DataFrame:
    """(c, root): the cluster that the `need` lowest merges bring each merged cluster to, by links of links."""
    taken = merges if merges.count() <= need else numbered(merges, "_n", 0, ["height", "turn", "a"]).where(F.col("_n") <= need)
    up = stored(taken.select(F.col("b").alias("c"), F.col("a").alias("root")), "linkage")
    while True:
        over = up.select(F.col("c").alias("root"), F.col("root").alias("_over"))
        if up.join(over, "root", "left_semi").isEmpty():
            return up
        up = stored(up.join(over, "root", "left").select("c", F.coalesce("_over", "root").alias("root")), "linkage")


def average_linkage(features: DataFrame, average: int = 10, most: int | None = None, seed: int = 0, small: int = 4096, block: int = BLOCK) -> DataFrame:
    """EX06: features with their cluster, of count // average (1 at least) clusters by average linkage of all rows; clusters are numbered by their first row in the order of fid.

    Equal vectors are one point that weighs as many: they merge first. If there are more clusters to make than different vectors, the copies that come first join the first row of their
    vector. Only whoever asks for it (`most`) gets the linkage of so many rows in the order of a seeded hash, all rows then going to the cluster whose mean vector is nearest (the
    first of equals). Rows without a vector are left out."""
    known = features.where(F.col("feature").isNotNull())
    if most is not None and known.count() > most:
        return _of_sample(known, average, most, seed, small)
    rows = numbered(known, "_row", 0, ["fid", F.xxhash64("feature")])
    total = rows.count()
    if not total:
        return known.withColumn("cluster", F.lit(0))
    k = max(1, total // average)
    points = stored(rows.groupBy("feature").agg(F.min("_row").alias("pid"), F.count("*").cast("double").alias("w")), "linkage")
    n = points.count()
    if n > k:
        up = _roots(merges_of(points.select("pid", "w", F.col("feature").alias("x")), n, n - k, small, block), n - k)
        to = points.join(up, points["pid"] == up["c"], "left").select("feature", F.coalesce("root", "pid").alias("_root"))
        own = rows.select("_row", "feature").join(to, "feature").select("_row", "_root")
    else:
        copies = rows.select("_row", "feature").join(points.select("feature", "pid"), "feature").where("_row != pid").select("_row", "pid")
        joined = numbered(copies, "_n", 0, ["_row"]).where(F.col("_n") <= total - k).select("_row", F.col("pid").alias("_root"))
        own = rows.select("_row").join(joined, "_row", "left").select("_row", F.coalesce("_root", "_row").alias("_root"))
    own = stored(own, "linkage")
    names = numbered(own.groupBy("_root").agg(F.min("_row").alias("_first")), "_name", -1, ["_first"]).select("_root", F.col("_name").cast("int").alias("cluster"))
    return rows.join(own.join(names, "_root").select("_row", "cluster"), "_row").select(*features.columns, "cluster")


def _of_sample(known: DataFrame, average: int, most: int, seed: int, small: int) -> DataFrame:
    """The clusters of `most` rows, and all rows by the nearest mean; as many clusters as the sample allows."""
    chosen = known.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("fid").cast("string"))), "fid").limit(most)
    sample = chosen.select("fid", V.doubles(F.col("feature")).alias("feature")).toPandas().sort_values("fid", kind="stable")  # bounded by most
    points = vectors_of(sample["feature"])
    k = max(1, known.count() // average)
    label = cut(dendrogram(points, known.sparkSession, small, k), len(points), k)
    means = np.zeros((label.max() + 1, points.shape[1]))
    np.add.at(means, label, points)
    means /= np.bincount(label)[:, None]
    return assigned(known, means)


def assigned(features: DataFrame, centres: np.ndarray, distance: str | None = None) -> DataFrame:
    """features with the number of the nearest centre, the first of equals, and its distance in a column of that name."""
    shared = features.sparkSession.sparkContext.broadcast(centres)
    names = [f.name for f in features.schema]

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            step = min(1024, max(16, 4_000_000 // len(shared.value)))
            for i in range(0, len(b), step):
                part = b.iloc[i : i + step]
                best, d = nearest_row(vectors_of(part["feature"]), shared.value)
                out = part.assign(cluster=best.astype(np.int32))
                yield out.assign(**{distance: d}) if distance else out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in features.schema if f.name in names)
    return features.mapInPandas(near, schema + ", cluster int" + (f", `{distance}` double" if distance else ""))


# --- medoids ---


def first_medoids(rows: DataFrame, k: int, seed: int = 0, rounds: int = 4) -> list[tuple[int, list[float]]]:
    """k rows (fid, vector) that lie far apart, as k-means|| finds them: each round takes rows with a chance of 2 k times their share of the
    squared distances to those taken, by a seeded hash of fid; of the rows taken (about 2 k rounds), each weighted by the rows nearest to it,
    k are chosen at the driver, each time the one with the largest weighted squared distance."""
    spark = rows.sparkSession
    start = rows.orderBy(F.xxhash64(F.lit(seed), "fid"), "fid").limit(1).collect()
    taken = [(r["fid"], list(r["feature"])) for r in start]
    if not taken:
        return []
    chance = lambda step: F.pmod(F.xxhash64(F.lit(seed), F.lit(step), "fid"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    for step in range(rounds):
        near = assigned(rows, np.array([v for _, v in taken]), "apart").withColumn("_d", F.col("apart") * F.col("apart"))
        total = near.agg(F.sum("_d")).first()[0] or 0.0
        if total <= 0:
            break
        more = near.where(chance(step) < 2.0 * k * F.col("_d") / F.lit(float(total))).select("fid", "feature").collect()
        have = {fid for fid, _ in taken}
        taken += [(r["fid"], list(r["feature"])) for r in sorted(more, key=lambda r: r["fid"]) if r["fid"] not in have]
    if len(taken) < k:  # fewer places than medoids: any other rows
        have = spark.createDataFrame([(f,) for f, _ in taken], "fid bigint")
        rest = rows.join(F.broadcast(have), "fid", "left_anti").orderBy(F.xxhash64(F.lit(seed), "fid"), "fid").limit(k - len(taken)).collect()
        return taken + [(r["fid"], list(r["feature"])) for r in rest]
    points = np.array([v for _, v in taken])
    near = assigned(rows, points).groupBy("cluster").count().toPandas()
    weight = np.zeros(len(points))
    weight[near["cluster"]] = near["count"]
    picked = [0]
    least = distances(points, points[:1])[:, 0]
    while len(picked) < k:
        gain = weight * least * least
        gain[picked] = -1.0
        picked.append(int(gain.argmax()))
        least = np.minimum(least, distances(points, points[picked[-1:]])[:, 0])
    return [taken[i] for i in picked]


def better_medoids(clustered: DataFrame, block: int = 2048) -> DataFrame:
    """(cluster, fid, feature, cost) of each cluster's medoid: the row with the least sum of distances to the cluster's rows, of equals the smallest fid.

    A cluster's rows are dealt into blocks of about `block`; every pair of blocks is one group, which adds the distances of each row to the rows of the other
    block, so neither a large cluster nor its distances meet in one task: a row is sent once a block of its cluster. Rows with equal vectors are one that counts for all."""
    several = stored(clustered.groupBy("cluster", "feature").agg(F.min("fid").alias("fid"), F.count("*").alias("_n")), "medoids")
    sizes = several.groupBy("cluster").agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks"))
    rows = several.join(sizes, "cluster").withColumn("_b", F.pmod(F.xxhash64("fid"), F.col("_blocks")).cast("int"))
    both = rows.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).select("cluster", "fid", "feature", "_n", "_b", F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j"))

    def sums(group: pd.DataFrame) -> pd.DataFrame:
        one = group["_b"].to_numpy() == group["_i"].iloc[0]
        x, i, j = vectors_of(group["feature"]), group["_i"].iloc[0], group["_j"].iloc[0]
        cost, n = np.zeros(len(group)), group["_n"].to_numpy(np.float64)
        if i == j:
            cost = distances(x, x) @ n
        else:
            d = distances(x[one], x[~one])
            cost[one], cost[~one] = d @ n[~one], n[one] @ d
        return pd.DataFrame({"cluster": group["cluster"], "fid": group["fid"], "part": cost})

    parts = both.groupBy("cluster", "_i", "_j").applyInPandas(sums, "cluster int, fid long, part double")
    cost = parts.groupBy("cluster", "fid").agg(F.sum("part").alias("cost"))
    best = cost.groupBy("cluster").agg(F.min(F.struct("cost", "fid")).alias("_m")).select("cluster", "_m.cost", "_m.fid")
    return best.join(several.select("fid", "feature"), "fid").select("cluster", "fid", "feature", "cost")


def k_medoids(features: DataFrame, k: int, seed: int = 0, rounds: int = 50, block: int = 2048, start: list[tuple[int, list[float]]] | None = None) -> tuple[DataFrame, list[int], float]:
    """EX03, ML16: (features with cluster and distance to its medoid, the medoids' fids by cluster, the sum of distances), by turns: every row goes to the
    nearest medoid, every cluster takes its best one, until no sum gets less. fids are unique. The driver holds k vectors."""
    rows = stored(features.where(F.col("feature").isNotNull()).withColumn("feature", V.doubles(F.col("feature"))), "medoids")
    at = start or first_medoids(rows.select("fid", "feature"), k, seed)
    if not at:
        return rows.withColumn("cluster", F.lit(0)).withColumn("distance", F.lit(0.0)), [], 0.0
    out = assigned(rows, np.array([v for _, v in at]), "distance")
    for _ in range(rounds):
        now = stored(out.select("fid", "feature", "cluster", "distance"), "medoids")
        old = {r["cluster"]: r["c"] for r in now.groupBy("cluster").agg(F.sum("distance").alias("c")).collect()}
        found = {r["cluster"]: r for r in better_medoids(now, block).collect()}  # k rows
        better = {c: r for c, r in found.items() if r["cost"] < old[c] * (1 - 1e-12)}
        if not better:
            break
        at = [(better[c]["fid"], list(better[c]["feature"])) if c in better else m for c, m in enumerate(at)]
        out = assigned(rows, np.array([v for _, v in at]), "distance")
    out = stored(out, "medoids")
    return out, [f for f, _ in at], out.agg(F.sum("distance")).first()[0]


def medoid_stretches(features: DataFrame, k: int, seconds: float, seed: int = 0) -> DataFrame:
    """The k medoids, and all rows of their videos that lie inside the `seconds` from a medoid's start on."""
    _, fids, _ = k_medoids(features, k, seed)
    chosen = features.join(F.broadcast(features.sparkSession.createDataFrame([(f,) for f in fids], "fid bigint")), "fid", "left_semi")
    at = chosen.select(F.col("vid").alias("_v"), F.col("start_time").alias("_s"), F.col("fid").alias("_f"))  # a row a medoid
    inside = (F.col("vid") == F.col("_v")) & (F.col("start_time") >= F.col("_s")) & (F.col("end_time") <= F.col("_s") + F.lit(float(seconds)))
    return features.join(F.broadcast(at), inside | (F.col("fid") == F.col("_f")), "left_semi")


def medoid_budget(features: DataFrame, budget: int, seconds: float = 30.0, seed: int = 0) -> DataFrame:
    """ML16, kmedoids30sec: the stretches of as many medoids as come nearest to `budget` rows, found by halving between 1 and budget; of equally near
    numbers the first tried."""
    low, high, best = 1, budget, None
    while low <= high or best is None:
        k = low + (high - low) // 2
        got = stored(medoid_stretches(features, k, seconds, seed), "stretches")
        n = got.count()
        if best is None or abs(n - budget) < best[0]:
            best = (abs(n - budget), got)
        if n == budget:
            break
        low, high = (low, k - 1) if n > budget else (k + 1, high)
    return best[1]
