"""Streams of features, predictions, requests and labels: batches that are run again, empty batches, and rows that repeat."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from kinolake.streaming import labels as ST

WINDOWS = "vid long, start_time double, end_time double, phase int"


@pytest.fixture
def folder(tmp_path):
    return lambda name: str(tmp_path / name)


def again(checkpoint: str) -> None:
    """Forgets that the last batch was done, so that it runs again."""
    done = sorted((f for f in os.listdir(f"{checkpoint}/commits") if f.isdigit()), key=int)
    for f in (done[-1], f".{done[-1]}.crc"):
        if os.path.exists(f"{checkpoint}/commits/{f}"):
            os.remove(f"{checkpoint}/commits/{f}")


def windows(spark):
    # phase 1 has nothing; a window of phase 2 repeats one of phase 0
    rows = [(2, 0.0, 1.0, 0), (1, 5.0, 6.0, 0), (1, 0.0, 1.0, 2), (2, 0.0, 1.0, 2), (3, 0.0, 1.0, 2), (9, 0.0, 1.0, None), (9, 0.0, 1.0, 7)]
    return spark.createDataFrame(rows, WINDOWS)


def test_features_get_dense_ids_once(spark, folder):
    start = lambda stream: ST.features_appended(stream.drop("phase"), folder("out"), folder("check"))
    ST.arriving(windows(spark), F.col("phase"), 3, folder("in"), start)
    read = lambda: sorted((r["fid"], r["vid"], r["start_time"]) for r in spark.read.parquet(folder("out")).collect())
    want = [(1, 1, 5.0), (2, 2, 0.0), (3, 1, 0.0), (4, 2, 0.0), (5, 3, 0.0)]
    assert read() == want
    again(folder("check"))
    start(spark.readStream.schema(WINDOWS).parquet(folder("in"))).awaitTermination()
    assert read() == want


def test_windows_are_predicted_once(spark, folder):
    run = lambda rows: rows.select("vid", "start_time", "end_time", F.lit("a").alias("label"), F.lit(0.5).alias("probability"))
    start = lambda stream: ST.predictions_appended(stream, run, folder("out"), folder("check"))
    ST.arriving(windows(spark), F.col("phase"), 3, folder("in"), start)
    read = lambda: sorted((r["vid"], r["start_time"]) for r in spark.read.parquet(folder("out")).collect())
    want = [(1, 0.0), (1, 5.0), (2, 0.0), (3, 0.0)]
    assert read() == want
    again(folder("check"))
    start(spark.readStream.schema(WINDOWS).parquet(folder("in"))).awaitTermination()
    assert read() == want


def test_requests_are_extracted_once(spark, folder):
    rows = [(1, "r3d", 0), (1, "r3d", 0), (2, "r3d", 0), (1, "r3d", 1), (1, "clip", 1), (3, "clip", 1)]
    done = spark.createDataFrame([(2, "r3d"), (3, "clip"), (3, "clip")], "vid long, feature_name string")
    asked = spark.createDataFrame(rows, "vid long, feature_name string, phase int")
    ST.arriving(asked, F.col("phase"), 2, folder("in"), lambda stream: ST.appended(ST.requested(stream, done), folder("out"), folder("check")))
    assert sorted((r["vid"], r["feature_name"]) for r in spark.read.parquet(folder("out")).collect()) == [(1, "clip"), (1, "r3d")]


def test_models_are_trained_when_the_rule_asks(spark, folder):
    at = lambda day: datetime.datetime(2024, 1, day)
    # two labels are too few, two more ask for a model, the older one of the last phase doesn't
    rows = [("a", at(2), 0), ("b", at(3), 0), ("a", at(4), 1), ("a", at(5), 1), ("c", at(1), 2), ("b", at(9), 3)]
    labels = spark.createDataFrame(rows, "label string, label_time timestamp, phase int")
    train = lambda rows: rows.agg(F.array_sort(F.collect_set("label")).alias("labels"), F.count("*").alias("ntrain"))
    start = lambda stream: ST.trained_on_labels(stream, folder("out"), folder("check"), "r3d", train, least_labels=3)
    ST.arriving(labels, F.col("phase"), 4, folder("in"), start)
    read = lambda: sorted((r["mid"], r["creation_time"], r["labels"], r["ntrain"]) for r in spark.read.parquet(folder("out") + "/models").collect())
    want = [(1, at(5), ["a", "b"], 4), (2, at(9), ["a", "b", "c"], 6)]
    assert read() == want
    again(folder("check"))
    start(spark.readStream.schema(labels.schema).parquet(folder("in"))).awaitTermination()
    assert read() == want


def spans_of(rows):
    """Disjoint intervals by (vid, label), by plain Python; an interval that touches one is part of it."""
    out = {}
    for v, x, s, e in sorted(rows, key=lambda r: (r[0] or -1, r[1] or "", r[2], r[3])):
        own = out.setdefault((v, x), [])
        if own and s <= own[-1][1]:
            own[-1] = (own[-1][0], max(own[-1][1], e))
        else:
            own.append((s, e))
    return {(v, x, s, e) for (v, x), own in out.items() for s, e in own}


def test_very_many_short_states_are_merged_together(spark, folder):
    """A Python call for each of 8,000 (vid, label) took some 6 ms in each batch; emitted is what grew or is new."""
    rng = random.Random(3)
    schema = "vid long, label string, start_time double, end_time double, phase int"
    key = lambda i: (i // 2 if i else None, (None, "a", "b")[i % 3])
    rows = [(*key(i), s := float(rng.randrange(40)), s + rng.randrange(6), p) for i in range(8000) for p in range(2) for _ in range(rng.randrange(3))]
    states = []

    def start(stream):
        out = ST.appended(ST.coalescing(stream.drop("phase")), folder("out"), folder("check"), mode="update")
        states.append(out)
        return out

    ST.arriving(spark.createDataFrame(rows, schema), F.col("phase"), 2, folder("in"), start)
    assert max(o["numRowsTotal"] for q in states for p in q.recentProgress for o in p["stateOperators"]) <= 1024
    got = [tuple(r) for r in spark.read.schema(f"{ST.OUT}, batch int").parquet(folder("out")).select("batch", "vid", "label", "start_time", "end_time").collect()]
    first, last = spans_of([r[:4] for r in rows if r[4] == 0]), spans_of([r[:4] for r in rows])
    assert {r[1:] for r in got if r[0] == 0} == first and {r[1:] for r in got if r[0] > 0} == last - first and len(got) == len(first) + len(last - first)


def test_intervals_without_a_time_are_kept():
    import pandas as pd

    nan = float("nan")
    rows = pd.DataFrame({"vid": pd.array([1] * 6, "Int64"), "label": ["a"] * 6, "start_time": [0.0, 1.0, 2.0, nan, 50.0, 60.0], "end_time": [10.0, nan, 3.0, 99.0, nan, 61.0]})
    got = ST._merge(rows)
    assert str(got[["start_time", "end_time"]].values.tolist()) == str([[0.0, 10.0], [50.0, nan], [60.0, 61.0], [nan, 99.0]])
    assert str(ST._merge(ST._spans(ST._state(got))).values.tolist()) == str(got.values.tolist())
