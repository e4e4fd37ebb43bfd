"""Offline labelling: ranking clusters, choosing elements, propagating labels, and augmenting labels around labeled moments.

Rows are (fid, cluster, hard_label), hard_label null where nobody has labeled the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from .store import placed_in


def cluster_stats(rows: DataFrame, distance: str = "distance") -> DataFrame:
    """AG13: size, unlabeled rows, different labels and 75th percentile of the distance of each cluster."""
    return rows.groupBy("cluster").agg(F.count("*").alias("size"), F.sum(F.col("hard_label").isNull().cast("int")).alias("unlabeled"), F.countDistinct("hard_label").alias("labels"), F.percentile(distance, 0.75).alias("far"))


def ranked_cluster(stats: DataFrame, by: str) -> DataFrame:
    """LB04: the cluster to look at next among those with unlabeled rows: the largest (`size`), widest (`far`), or most in disagreement (`labels`: a cluster
    without any label first, the largest of them; else the one with most labels, an unlabeled row counting as one)."""
    open_ = stats.where("unlabeled > 0")
    if by == "labels":
        key = F.struct((F.col("labels") == 0).cast("int"), F.when(F.col("labels") == 0, F.col("size")).otherwise(F.col("labels")), -F.col("cluster"))
    else:
        key = F.struct(F.col(by), -F.col("cluster"))
    return open_.agg(F.max_by("cluster", key).alias("cluster"))


def uncertain_cluster(rows: DataFrame) -> DataFrame:
    """LB04: the cluster with unlabeled rows whose median largest probability (column `top`) is least."""
    open_ = rows.groupBy("cluster").agg(F.median("top").alias("m"), F.sum(F.col("hard_label").isNull().cast("int")).alias("u")).where("u > 0")
    return open_.agg(F.min_by("cluster", F.struct("m", "cluster")).alias("cluster"))


def centre_element(rows: DataFrame, outside: bool = False) -> DataFrame:
    """LB05: of each cluster the unlabeled row nearest to the centre, and with outside also the farthest."""
    free = rows.where("hard_label is null")
    picks = [F.min_by("fid", F.struct("distance", "fid")).alias("centre")]
    if outside:
        picks.append(F.max_by("fid", F.struct(F.col("distance"), -F.col("fid"))).alias("outside"))
    return free.groupBy("cluster").agg(*picks)


def far_pair(rows: DataFrame, seeds: int = 2) -> DataFrame:
    """LB05: two far rows of each cluster without comparing all pairs: the row farthest from the centre, then the row farthest from that, repeated `seeds`
    times; exact in one dimension and never less than half of the largest distance."""
    at = rows.where("hard_label is null").groupBy("cluster").agg(F.max_by(F.struct("fid", "feature"), F.struct(F.col("distance"), -F.col("fid"))).alias("_a"))
    for _ in range(seeds):
        d = V.distance(F.col("feature"), F.col("_a.feature"))
        both = rows.where("hard_label is null").join(at, "cluster")
        at = both.groupBy("cluster").agg(F.max_by(F.struct("fid", "feature"), F.struct(d, -F.col("fid"))).alias("_b"), F.first("_a.fid").alias("_f"), F.max(d).alias("_d")).select("cluster", F.col("_b").alias("_a"), F.col("_f"), F.col("_d"))
    return at.select("cluster", F.col("_f").alias("one"), F.col("_a.fid").alias("other"), F.col("_d").alias("apart"))


def propagated(rows: DataFrame, soft: Column | None = None) -> DataFrame:
    """LB06: a labeled row keeps its label, another takes its cluster's most frequent one (smallest of equals), else its soft label."""
    votes = rows.where("hard_label is not null").groupBy("cluster", "hard_label").count()
    mode = votes.groupBy("cluster").agg(F.min_by("hard_label", F.struct(-F.col("count"), F.col("hard_label"))).alias("_mode"))
    out = rows.join(mode, "cluster", "left")
    return out.withColumn("label", F.coalesce("hard_label", "_mode", soft if soft is not None else F.lit(None).cast("string"))).drop("_mode")


def augmented(labeled: DataFrame, rows: DataFrame, seconds: float = 15.0, how: str = "gaussian", scale: float = 5.0, bucket: float | None = None) -> DataFrame:
    """ML15: rows of a video that start within `seconds` of a labeled moment get its label (or their own with how='exact'), weighted 1 or by a normal density;
    of several moments the largest weight a label counts. labeled and rows: (fid, vid, start_time, label)."""
    width = bucket or seconds
    cell = lambda c: F.floor(c / width)
    near = labeled.select("vid", F.col("start_time").alias("c_start"), F.col("label").alias("c_label")).withColumn("_cell", F.explode(F.sequence(cell(F.col("c_start") - seconds), cell(F.col("c_start") + seconds))))
    both = rows.withColumn("_cell", cell(F.col("start_time"))).join(near, ["vid", "_cell"]).where(F.abs(F.col("start_time") - F.col("c_start")) <= seconds)
    label = F.col("label") if how == "exact" else F.col("c_label")
    weight = V.gaussian_weight(F.abs(F.col("start_time") - F.col("c_start")), scale) if how == "gaussian" else F.lit(1.0)
    return both.select("fid", label.alias("label"), weight.alias("weight")).groupBy("fid", "label").agg(F.max("weight").alias("weight"))


def augmentation_quality(augmented_rows: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """AG14: (totals, by class) of truth minus weight over augmented rows. rows: (fid, label), the truth."""
    fids = augmented_rows.select("fid").distinct()
    real = rows.join(fids, "fid", "left_semi").select("fid", "label", F.lit(1.0).alias("y"))
    delta = real.join(augmented_rows, ["fid", "label"], "full_outer").select("fid", "label", (F.coalesce("y", F.lit(0.0)) - F.coalesce("weight", F.lit(0.0))).alias("d"))
    per_row = delta.groupBy("fid").agg(F.sum("d").alias("d"), F.max((F.col("d") != 0).cast("int")).alias("wrong"))
    totals = per_row.agg(F.count("*").alias("n_augmented"), F.sum(1 - F.col("wrong")).alias("n_correct"), F.sum("wrong").alias("n_incorrect"), F.avg("d").alias("avg_row_delta"))
    wrong = delta.join(per_row.where("wrong = 1").select("fid"), "fid", "left_semi")
    n = F.broadcast(per_row.agg(F.sum("wrong").alias("_n")))
    by_class = wrong.groupBy("label").agg(F.sum("d").alias("sum"), F.sum(F.greatest("d", F.lit(0.0))).alias("positive"), F.sum(F.least("d", F.lit(0.0))).alias("negative")).crossJoin(n).select("label", (F.col("sum") / F.col("_n")).alias("avg_delta"), "positive", "negative")
    return totals, by_class


def temporal_sample(rows: DataFrame, share: float, prefix: Column, order: str) -> DataFrame:
    """WN06: of each prefix group the first ceil(ceil(share n) / groups) rows in sort order; the last row of several equal ones is by chance of their places. Null is no group of its
    own in the number of groups. A group's rows lie in many partitions, so one that holds most rows isn't one task."""
    sized = rows.agg(F.ceil(F.lit(share) * F.count("*")).alias("_size"), F.countDistinct(prefix).alias("_groups"))
    placed = placed_in(rows, prefix, [order]).crossJoin(F.broadcast(sized))  # one row
    return placed.where(F.col("_place") <= F.ceil(F.col("_size") / F.col("_groups"))).select(*rows.columns)


def least_certain(predictions: DataFrame, k: int) -> DataFrame:
    """LB02: the k windows whose largest probability is smallest."""
    top = predictions.groupBy("vid", "start_time", "end_time").agg(F.max("probability").alias("top"))
    return top.orderBy("top", "vid", "start_time", "end_time").limit(k)


def random_stretches(rows: DataFrame, budget: int, seconds: float = 30.0, seed: int = 0) -> DataFrame:
    """ML16, random30sec: whole stretches of `seconds` of a video, by a seeded hash, until they hold at least `budget` rows. Only counts of
    stretches are ranked."""
    cells = rows.withColumn("_cell", F.floor(F.col("start_time") / seconds))
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("vid").cast("string"), F.col("_cell").cast("string")))
    sizes = cells.groupBy("vid", "_cell").agg(F.count("*").alias("_n")).withColumn("_place", place)
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_place", "vid", "_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a stretch holds a row at least, so the first `budget` of them are enough
    taken = sizes.orderBy("_place", "vid", "_cell").limit(budget).withColumn("_before", before).where(F.col("_before") < budget)
    return cells.join(taken.select("vid", "_cell"), ["vid", "_cell"], "left_semi").drop("_cell")


def reclustered(rows: DataFrame, cluster: int, parts: int, next_id: int, dims: int = 8, seed: int = 0) -> DataFrame:
    """LB07, LB08: one cluster's rows split by KMeans on their principal components; new clusters are numbered from next_id."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA

    from .models import vectorised

    own = vectorised(rows.where(F.col("cluster") == cluster))
    flat = PCA(k=dims, inputCol="x", outputCol="z").fit(own).transform(own)
    split = KMeans(featuresCol="z", predictionCol="_c", k=parts, seed=seed).fit(flat).transform(flat)
    new = split.withColumn("cluster", (F.col("_c") + next_id).cast(rows.schema["cluster"].dataType)).select(*rows.columns)
    return rows.where(F.col("cluster") != cluster).unionByName(new)
