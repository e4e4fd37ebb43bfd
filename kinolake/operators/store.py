"""Videos, models, predictions and features as stored tables: changes return the new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored


def numbered(rows: DataFrame, id_column: str, start: Column | int, order: list) -> DataFrame:
    """SNK02: dense ids from start + 1 in the given order. Rows are ranged over partitions, sorted, and stored with their partition and place in it, so that
    retries and different uses see the same ones; only the partitions' counts (a row each) pass one task."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(ranged.withColumn("_m", F.monotonically_increasing_id()), "ids")
    part, place = F.shiftright("_m", 33), F.col("_m") % F.lit(1 << 33)
    counts = placed.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(counts.select("_p", before.alias("_before")))  # a row each partition
    first = start if isinstance(start, Column) else F.lit(start)
    return placed.withColumn("_p", part).join(offsets, "_p").withColumn(id_column, (first + F.col("_before") + place + 1).cast("bigint")).drop("_p", "_m", "_before")


def placed_in(rows: DataFrame, group: Column, order: list) -> DataFrame:
    """rows with `_g`, their group, and `_place`, their place in it from 1 in the given order. Rows are numbered over all groups first, so no group is one task; null is a group."""
    ids = numbered(rows.withColumn("_g", group), "_id", 0, ["_g", *order])
    firsts = ids.groupBy(F.col("_g").alias("_of")).agg(F.min("_id").alias("_first"))  # a row a group
    return ids.join(firsts, F.col("_g").eqNullSafe(F.col("_of"))).withColumn("_place", F.col("_id") - F.col("_first") + 1).drop("_id", "_of", "_first")


def top(table: DataFrame, id_column: str) -> DataFrame:
    """One row: the largest id, 0 without any."""
    return table.agg(F.coalesce(F.max(id_column), F.lit(0)).alias("_top"))


def videos_added(videos: DataFrame, new: DataFrame) -> DataFrame:
    """DML02: videos and those of new whose path isn't there yet, with ids after the largest, by path."""
    fresh = new.dropDuplicates(["vpath"]).join(videos.select("vpath"), "vpath", "left_anti")
    ids = fresh.crossJoin(F.broadcast(top(videos, "vid")))
    rows = numbered(ids, "vid", F.col("_top"), ["vpath"]).drop("_top")
    return videos.unionByName(rows, allowMissingColumns=True)


def new_vids(before: DataFrame, after: DataFrame) -> DataFrame:
    """ST04."""
    return after.select("vid").join(before.select("vid"), "vid", "left_anti")


def thumbnail_updated(videos: DataFrame, vid: int, path: str) -> DataFrame:
    """DML04."""
    return videos.withColumn("thumbpath", F.when(F.col("vid") == vid, F.lit(path)).otherwise(F.col("thumbpath")))


def model_added(models: DataFrame, row: DataFrame) -> DataFrame:
    """DML10."""
    next_id = F.broadcast(top(models, "mid"))
    return models.unionByName(row.crossJoin(next_id).withColumn("mid", (F.col("_top") + 1).cast(models.schema["mid"].dataType)).drop("_top"), allowMissingColumns=True)


def predictions_added(predictions: DataFrame, sets: DataFrame, mid: int) -> DataFrame:
    """DML11: sets has (vid, start_time, end_time, predictions map<string,double>); rows that are there already are left out."""
    tall = sets.select(F.lit(mid).alias("mid"), "vid", "start_time", "end_time", F.explode("predictions").alias("label", "probability"))
    return predictions.unionByName(tall).dropDuplicates()


def features_numbered(features: DataFrame, new: DataFrame) -> DataFrame:
    """SNK01: the rows of new with ids after the largest of features, by (vid, start_time, end_time)."""
    ids = new.crossJoin(F.broadcast(top(features, "fid")))
    return numbered(ids, "fid", F.col("_top"), ["vid", "start_time", "end_time"]).drop("_top")


def features_added(features: DataFrame, new: DataFrame) -> DataFrame:
    """SNK01: features and the rows of new with their ids."""
    return features.unionByName(features_numbered(features, new))


def write_features(features: DataFrame, path: str, feature_name: str, max_rows: int = 50_000) -> None:
    """Appends to the feature's folder, files of up to max_rows rows."""
    features.write.mode("append").option("maxRecordsPerFile", max_rows).parquet(f"{path}/feature_name={feature_name}")


def coalesced_features(parts: list[DataFrame]) -> tuple[DataFrame, int]:
    """SNK05: the union of shards and the next free id."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, int(out.agg(F.coalesce(F.max("fid"), F.lit(-1))).first()[0]) + 1


def subset_by_labels(videos: DataFrame, annotations: DataFrame, labels: list[str]) -> tuple[DataFrame, DataFrame]:
    """DML13: videos that have one of the labels, and all annotations of those videos."""
    vids = annotations.where(F.col("label").isin(labels)).select("vid").distinct()
    return videos.join(vids, "vid", "left_semi"), annotations.join(vids, "vid", "left_semi")


def upserted(table: DataFrame, rows: DataFrame, key: list[str], update: bool = True) -> DataFrame:
    """DML14: rows by key, new values winning with update, old ones without; equal keys within rows: one of them."""
    both = table.withColumn("_new", F.lit(0)).unionByName(rows.dropDuplicates(key).withColumn("_new", F.lit(1)))
    order = F.desc("_new") if update else F.asc("_new")
    return both.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where("_n = 1").drop("_n", "_new")


def pruned(tables: dict[str, DataFrame], paths: DataFrame) -> dict[str, DataFrame]:
    """SRC13: the store for the videos of these paths only."""
    kept = tables["video_metadata"].join(paths, "vpath", "left_semi")
    return {name: kept if name == "video_metadata" else t.join(kept.select("vid"), "vid", "left_semi") if "vid" in t.columns else t for name, t in tables.items()}


def reset(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """DML12: annotations, models and predictions emptied."""
    return {name: t.limit(0) if name in ("annotations", "models", "predictions") else t for name, t in tables.items()}
