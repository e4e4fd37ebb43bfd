"""Streams of labels, features and predictions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import labels as LB
from ..operators import models as M
from ..operators import store as ST

OUT = "vid long, label string, start_time double, end_time double"


SPANS = ["vid", "label", "start_time", "end_time"]
#: A group's state: its keys, how many intervals each has, and the intervals in that order.
STATE = "vids array<long>, labels array<string>, counts array<int>, starts array<double>, ends array<double>"


def _merge(spans: pd.DataFrame) -> pd.DataFrame:
    """The disjoint intervals of each (vid, label), keys together; intervals that touch are one, and one without a start stays alone."""
    key = spans.groupby(["vid", "label"], dropna=False, sort=False).ngroup().to_numpy()
    order = np.lexsort((spans["end_time"], spans["start_time"], key))
    spans, key = spans.iloc[order], key[order]
    ends = spans["end_time"].fillna(-np.inf)
    reach = ends.groupby(key).cummax().to_numpy()
    opens = np.ones(len(spans), bool)
    opens[1:] = (key[1:] != key[:-1]) | ~(spans["start_time"].to_numpy()[1:] <= reach[:-1])
    out = spans[opens].reset_index(drop=True)
    if len(out):
        out["end_time"] = np.maximum.reduceat(ends.to_numpy(), np.flatnonzero(opens))
    return out.replace({"end_time": {-np.inf: np.nan}})


def _spans(state: tuple) -> pd.DataFrame:
    vids, labels, counts, starts, ends = state
    each = np.repeat(np.arange(len(counts)), np.array(counts, int))
    return pd.DataFrame({"vid": pd.array(list(vids), "Int64").take(each), "label": pd.Series(list(labels), dtype=object).take(each).array, "start_time": np.array(starts, float), "end_time": np.array(ends, float)})


def _state(spans: pd.DataFrame) -> tuple:
    each = spans.groupby(["vid", "label"], dropna=False, sort=False).size().reset_index(name="n")
    plain = lambda c: [None if pd.isna(x) else x for x in each[c].tolist()]
    return plain("vid"), plain("label"), each["n"].tolist(), spans["start_time"].tolist(), spans["end_time"].tolist()


def coalescing(labels: DataFrame, shards: int = 1024) -> DataFrame:
    """STM06: a stream of (vid, label, start_time, end_time); the state of a (vid, label) is its disjoint intervals, and each batch emits those that
    grew or are new. The last emission that covers a moment is current; over all input the state equals the batch form.

    A group costs milliseconds, whatever it holds, so the (vid, label) are dealt by hash over `shards` groups, which are merged whole. A batch writes anew the states of
    the groups it has rows of. A checkpoint is bound to its number of shards."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = _spans(state.get if state.exists else ([], [], [], [], []))
        spans = before
        for pdf in batches:
            spans = _merge(pd.concat([spans, pdf[SPANS].astype({"vid": "Int64"})], ignore_index=True))
        state.update(_state(spans))
        both = spans.merge(before.drop_duplicates(), "left", SPANS, indicator=True)
        yield both.loc[both["_merge"] == "left_only", SPANS]

    shard = F.pmod(F.xxhash64("vid", "label"), F.lit(shards))
    return labels.withColumn("_shard", shard).groupBy("_shard").applyInPandasWithState(step, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def appended(stream: DataFrame, path: str, checkpoint: str, partition: str | None = None, mode: str = "append") -> StreamingQuery:
    """STM01, STM02: feature or prediction rows appended batch by batch; a batch that is run again overwrites its own folder only. `mode` is the stream's output mode."""

    def write(batch: DataFrame, batch_id: int) -> None:
        out = batch.write.mode("overwrite")
        (out.partitionBy(partition) if partition else out).parquet(f"{path}/batch={batch_id}")

    return _each(stream, write, checkpoint, mode)


def on_labels(stream: DataFrame, retrain: Callable[[DataFrame, int], None], checkpoint: str):
    """STM05: each batch of new labels triggers `retrain`; the checkpoint keeps a batch from being taken twice (STM04)."""
    return _each(stream, retrain, checkpoint)


def arriving(rows: DataFrame, phase: Column, phases: int, folder: str, start: Callable[[DataFrame], StreamingQuery]) -> None:
    """A table as it would arrive: the rows of phase 0, 1, ... are appended to a folder that a stream reads, and the query that `start` makes of the stream is started
    after each and goes on from its checkpoint. A phase without rows arrives too; rows whose phase is null or outside never do."""
    spark = rows.sparkSession
    for i in range(phases):
        rows.where(phase == i).write.mode("append").parquet(folder)
        start(spark.readStream.schema(rows.schema).parquet(folder)).awaitTermination()


def before(like: DataFrame, path: str, batch_id: int) -> DataFrame:
    """The rows that earlier batches than this one appended to the path; what this batch wrote before it was run again isn't among them."""
    try:
        return like.sparkSession.read.parquet(path).where(F.col("batch") < batch_id).select(*like.columns)
    except AnalysisException:  # nothing has been written yet
        return like.limit(0)


def _each(stream: DataFrame, take: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    return stream.writeStream.outputMode(mode).foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def features_appended(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """STM01: feature rows (vid, start_time, end_time and others) appended batch by batch with dense fids after the largest of earlier batches, in a batch by (vid, start_time,
    end_time). A batch that is run again overwrites its own folder and gives the same fids; rows that agree in all three may swap theirs."""

    def write(batch: DataFrame, batch_id: int) -> None:
        old = before(batch.withColumn("fid", F.lit(0).cast("bigint")), path, batch_id)
        ST.features_numbered(old, batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return _each(stream, write, checkpoint)


def predictions_appended(stream: DataFrame, run: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """STM02: feature windows as they arrive; `run` (feature rows to prediction rows) predicts those of a batch that no earlier batch predicted, and the rows are appended.
    Windows are told apart by (vid, start_time, end_time); equal ones of one batch are all predicted."""
    key = ["vid", "start_time", "end_time"]

    def write(batch: DataFrame, batch_id: int) -> None:
        old = before(batch.select(*key), path, batch_id).distinct()
        run(batch.join(old, key, "left_anti")).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return _each(stream, write, checkpoint)


def requested(requests: DataFrame, done: DataFrame, key: tuple[str, ...] = ("vid", "feature_name")) -> DataFrame:
    """STM04: of a stream of requests, those that neither are done (a table) nor were asked for earlier in the stream: each key once. The state is a row a key, which is bounded
    by the videos times the features, so there is no watermark."""
    return requests.select(*key).join(done.select(*key).distinct(), list(key), "left_anti").dropDuplicates(list(key))


def trained_on_labels(stream: DataFrame, path: str, checkpoint: str, feature_name: str, train: Callable[[DataFrame], DataFrame], allow_stale: bool = False, least_labels: int = 15) -> StreamingQuery:
    """STM05: labels (with label_time) are appended to path/labels batch by batch; where the rule of ML12 asks for a model after a batch, `train` (all labels so far, to one row of
    labels and ntrain) makes one, and a row (mid, feature_name, creation_time, labels, ntrain) is appended to path/models. Its creation_time is that of its newest label,
    so that a batch run again gives the same row."""
    models = stream.sparkSession.createDataFrame([], "mid int, feature_name string, creation_time timestamp, labels array<string>, ntrain long")

    def take(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/labels/batch={batch_id}")
        so_far = before(batch, f"{path}/labels", batch_id + 1)
        known = before(models, f"{path}/models", batch_id)
        if M.needs_training(known, so_far, feature_name, allow_stale, least_labels):
            newest = so_far.agg(F.max("label_time").alias("creation_time"))
            row = train(so_far).crossJoin(newest).crossJoin(ST.top(known, "mid"))  # one row each
            row = row.select((F.col("_top") + 1).cast("int").alias("mid"), F.lit(feature_name).alias("feature_name"), "creation_time", "labels", F.col("ntrain").cast("long"))
            row.write.mode("overwrite").parquet(f"{path}/models/batch={batch_id}")

    return _each(stream, take, checkpoint)


def current_intervals(emitted: DataFrame) -> DataFrame:
    """STM06: the intervals of a (vid, label) after all batches, from everything that `coalescing` has emitted: an emitted interval lies in the last one that grew from it."""
    return LB.coalesced(emitted)
