"""Which rows to label for a budget (ML15, ML16) and which element next (LB02).

Budgets are shares of the rows, taken as ceil(share * rows). Chance is a seeded hash of fid, so a choice is the same on every run. Empty tables give no rows. Fids are taken to be distinct:
a repeated one takes a place of the budget each time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import cluster as C
from . import propagate as P
from . import select as SL
from .store import numbered, placed_in

#: What an experiment of stored labels is known by.
EXPERIMENT = ("budget", "experiment")


def size_of(rows: DataFrame, share: float) -> DataFrame:
    """One row: _n, the rows, and _size, the budget."""
    return rows.agg(F.count("*").alias("_n")).withColumn("_size", F.ceil(F.lit(float(share)) * F.col("_n")))


def quotas(rows: DataFrame, share: float, stratum: Column | None = None) -> DataFrame:
    """ML15: how many rows a random budget takes of each stratum (_g, a row each; null is one): shares rounded down, then one more by falling remainder (ties: smallest stratum)
    until the budget is reached. More strata than rows to take, or none given, are one stratum (_g null)."""
    size = F.broadcast(size_of(rows, share))
    if stratum is None:
        return size.select(F.lit(None).cast("string").alias("_g"), F.col("_size").alias("_quota"))
    counts = rows.groupBy(stratum.cast("string").alias("_g")).agg(F.count("*").alias("_c"))
    groups = F.broadcast(counts.agg(F.count("*").alias("_groups")))
    each = counts.crossJoin(size).crossJoin(groups).where("_groups <= _size")
    each = each.withColumns({"_floor": F.expr("_size * _c div _n"), "_rest": F.expr("_size * _c % _n")})
    # a row a stratum, of which there are no more than the budget has rows
    left = F.col("_size") - F.sum("_floor").over(Window.partitionBy())
    turn = F.row_number().over(Window.orderBy(F.desc("_rest"), F.col("_g").asc_nulls_first()))
    shared = each.withColumns({"_left": left, "_turn": turn}).select("_g", (F.col("_floor") + (F.col("_turn") <= F.col("_left")).cast("long")).alias("_quota"))
    whole = size.crossJoin(groups).where("_groups > _size").select(F.lit(None).cast("string").alias("_g"), F.col("_size").alias("_quota"))
    return shared.unionByName(whole)


def random_budget(rows: DataFrame, share: float, stratum: str | None = None, seed: int = 0) -> DataFrame:
    """ML15 (randomsample), ML16 (random): (fid) of a random budget, of each stratum its share. A stratum's rows are ranged over partitions, so one that holds most of
    them isn't one task."""
    keys = rows.select("fid", (F.col(stratum).cast("string") if stratum else F.lit(None).cast("string")).alias("_s"))
    want = quotas(keys, share, F.col("_s") if stratum else None)
    strata = want.agg(F.max(F.col("_g").isNotNull()).alias("_many"))  # one row: whether strata count
    own = keys.crossJoin(F.broadcast(strata)).select("fid", F.when(F.coalesce("_many", F.lit(False)), F.col("_s")).alias("_g"))
    placed = placed_in(own.withColumn("_h", SL.shuffled(seed, "fid")), F.col("_g"), ["_h", "fid"])
    return placed.join(want, placed["_g"].eqNullSafe(want["_g"])).where("_place <= _quota").select("fid")


def earliest(rows: DataFrame, share: float, *order: str) -> DataFrame:
    """ML16 (temporalconsecutive): (fid) of the budget's first rows in order (start_time, fid unless given); rows with null come first."""
    order = order or ("start_time", "fid")
    placed = numbered(rows.select(*dict.fromkeys(["fid", *order])), "_place", 0, list(order))
    return placed.crossJoin(F.broadcast(size_of(rows, share))).where("_place <= _size").select("fid")


def grown_coreset(rows: DataFrame, share: float, before: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """ML16 (greedycoresets): (fid) of a coreset of the budget's size; it holds what an earlier, smaller budget took (`before`, fids)."""
    size = size_of(rows, share).first()["_size"]
    if before is None or before.isEmpty():
        return SL.coreset(rows, size, seed=seed).select("fid")
    own = rows.join(before.select("fid"), "fid", "left_semi")
    more = size - own.count()
    return own.select("fid") if more <= 0 else own.select("fid").unionByName(SL.coreset(rows, more, own, seed).select("fid"))


def medoid_rows(rows: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """ML16 (kmedoids): (fid) of as many medoids as the budget has rows."""
    own, _, _ = C.k_medoids(rows, size_of(rows, share).first()["_size"], seed)
    return own.groupBy("cluster").agg(F.min_by("fid", F.struct("distance", "fid")).alias("fid")).select("fid")


#: Labellers by name: (rows with fid, vid, start_time, end_time, feature; share; seed) to fids.
LABELERS: dict[str, Callable[[DataFrame, float, int], DataFrame]] = {
    "fullysupervised": lambda rows, share, seed: rows.select("fid"),
    "random": lambda rows, share, seed: random_budget(rows, share, seed=seed),
    "random30sec": lambda rows, share, seed: P.random_stretches(rows, size_of(rows, share).first()["_size"], 30.0, seed).select("fid"),
    "temporalconsecutive": lambda rows, share, seed: earliest(rows, share),
    "kmedoids": medoid_rows,
    "kmedoids30sec": lambda rows, share, seed: C.medoid_budget(rows, size_of(rows, share).first()["_size"], 30.0, seed).select("fid"),
    "greedycoresets": lambda rows, share, seed: grown_coreset(rows, share, seed=seed),
}


def labelled_by(name: str, rows: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """ML15, ML16: (fid) of the rows that the labeller of this name would label."""
    if name not in LABELERS:
        raise ValueError(f"no labeller {name}")
    return LABELERS[name](rows, share, seed)


def experiments_left(progress: DataFrame, done: DataFrame, key: tuple[str, ...] = EXPERIMENT) -> DataFrame:
    """ML15 (label reader): stored labels of experiments that have no results yet."""
    return progress.join(done.select(*key).distinct(), list(key), "left_anti")


def read_labels(progress: DataFrame, rows: DataFrame, key: tuple[str, ...] = EXPERIMENT) -> DataFrame:
    """ML15 (label reader): of each experiment (key) the rows whose fid is among its labelled ones (`fids`, an array), all experiments in one join: (*key, *rows). A fid that
    is listed twice counts once, one that no row has is left out; null and empty lists give nothing. An experiment has one batch of labels: several raise."""
    several = progress.groupBy(*key).count().where("count > 1").limit(1).collect()
    if several:
        raise ValueError(f"an experiment with several batches of labels: {several[0].asDict()}")
    fids = progress.select(*key, F.explode(F.array_distinct("fids")).alias("fid"))
    return fids.join(rows, "fid").select(*key, *rows.columns)


def indexed_samples(indices: DataFrame, rows: DataFrame, *order: str) -> DataFrame:
    """ML15 (lancet): samples given as places of rows (`file`, `place` from 0, rows in order, by fid unless given). A repeated place counts once. Of files with as many different
    places the last by name counts: (nlabels, budget, fid), budget the share of all rows to two places. Places beyond the rows give nothing, though they count in nlabels."""
    own = indices.select("file", F.col("place").cast("long").alias("place")).distinct()
    kept = own.groupBy("file").agg(F.count("*").alias("nlabels")).groupBy("nlabels").agg(F.max("file").alias("file"))
    placed = numbered(rows.select(*dict.fromkeys(["fid", *order])), "_place", -1, list(order) or ["fid"]).select("fid", F.col("_place").alias("place"))
    total = F.broadcast(rows.agg(F.count("*").alias("_n")))
    got = own.join(kept, "file").join(placed, "place").crossJoin(total)
    return got.select("nlabels", F.round(F.col("nlabels") / F.col("_n"), 2).alias("budget"), "fid")


def next_element(rows: DataFrame, how: str, predictions: DataFrame | None = None, seed: int = 0, least: float = 0.01) -> DataFrame:
    """LB02: (fid) of the element to label next, by chance until more than `least` of the rows have a hard_label. Then `random` is still chance, `uncertainty` the unlabelled one
    with the least largest probability (predictions: fid, top; of whatever model), `coreset` the one farthest from all labelled ones. Ties go to the smallest fid; no row without
    unlabelled ones, or, for `uncertainty`, without predictions of them."""
    if how not in ("random", "uncertainty", "coreset"):
        raise ValueError(f"no way to choose the next element: {how}")
    n, labelled = rows.agg(F.count("*"), F.count("hard_label")).first()
    free = rows.where("hard_label is null")
    if how == "random" or labelled <= least * n:
        return free.select("fid", SL.shuffled(seed + labelled, "fid").alias("_h")).orderBy("_h", "fid").limit(1).select("fid")
    if how == "uncertainty":
        return free.select("fid").join(predictions.select("fid", "top"), "fid").orderBy("top", "fid").limit(1).select("fid")
    far = SL.farthest_rows(free.select("fid", "feature"), rows.where("hard_label is not null").select("fid", "feature"))
    return far.orderBy(F.desc("min_dist"), "fid").limit(1).select("fid")
