"""Edges that the derived relations don't have: golden alignments, touching intervals, empty lists, ties, streams."""

import math
import random

import pytest
from pyspark.sql import functions as F

from kinolake import schemas
from kinolake.functions import intervals as I
from kinolake.functions import labels as L
from kinolake.functions import vectors as V
from kinolake.operators import bandit as B
from kinolake.operators import features as FE
from kinolake.operators import labels as LB
from kinolake.operators import models as M
from kinolake.operators import search as SE
from kinolake.operators import select as SL
from kinolake.operators import store as ST
from kinolake.sources import videos as VS

SUBCLIPS = [(0.1, 1.5), (0.75, 2.25), (1.5, 3.0), (2.25, 3.75), (3.0, 7.0)]
GOLDEN = [
    (0.1, 1.5, 0.1, 1.5), (0.1, 1.6, 0.1, 1.6), (0, 1.5, 0, 1.5), (0, 1.7, 0, 1.7), (3, 7, 3, 7), (2.9, 7, 2.9, 7), (1.5, 3, 1.5, 3), (1.5, 3.1, 1.5, 3.1),
    (1.4, 3, 1.4, 3), (1.4, 3.8, 1.4, 3.8), (-2, -1, -2, 1.5), (7.1, 7.2, 3, 7.2), (0.5, 1.6, 0.1, 1.6), (0, 1.4, 0, 1.5), (0.1, 0.2, 0.1, 1.5), (1, 1.5, 0.1, 1.5),
    (3.1, 7.1, 3, 7.1), (2.7, 5, 2.25, 5), (5, 8, 3, 8), (1, 1.5, 0.1, 1.5), (1.6, 2.3, 1.5, 3),
]


def test_alignment_golden_vectors(spark):
    sub = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in SUBCLIPS])
    rows = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b, _, _) in enumerate(GOLDEN)], "i int, s double, e double")
    got = {r["i"]: (r["c"]["start"], r["c"]["end"]) for r in rows.select("i", I.aligned(sub, F.col("s"), F.col("e")).alias("c")).collect()}
    assert [got[i] for i in range(len(GOLDEN))] == [(float(c), float(d)) for _, _, c, d in GOLDEN]
    none = F.array().cast("array<struct<start:double,end:double>>")
    assert rows.limit(1).select(I.aligned(none, F.col("s"), F.col("e")).alias("c")).first()["c"]["start"] == 0.1
    assert rows.limit(1).select(I.slack(I.aligned(sub, F.lit(0.0), F.lit(1.5))).alias("c")).first()["c"]["start"] == 0.0


def test_predicates_on_touching_and_empty_intervals(spark):
    pairs = [((0, 5), (5, 10)), ((0, 5), (1, 2)), ((3, 3), (3, 3)), ((0, 5), (6, 7)), ((0, 5), (4, 9))]
    df = spark.createDataFrame([(float(a), float(b), float(c), float(d)) for (a, b), (c, d) in pairs], "a double, b double, c double, d double")
    cols = [F.col(x) for x in "abcd"]
    got = df.select(I.touches(*cols), I.overlaps(*cols), I.inside(*cols)).collect()
    assert [tuple(r) for r in got] == [(True, False, False), (True, True, False), (True, True, True), (False, False, False), (True, True, False)]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
@pytest.mark.parametrize("overlap", ["full", "partial", "strict"])
def test_bucketed_join_equals_plain_join(spark, how, overlap):
    random.seed(1)
    rows = lambda n: [(i, random.randrange(3), s := random.uniform(-50, 50), s + random.choice([0, 1, 7, 40])) for i in range(n)]  # noqa: E731, F841
    schema = "id int, vid int, start_time double, end_time double"
    a, b = spark.createDataFrame(rows(80), schema), spark.createDataFrame(rows(60), schema)
    plain = I.interval_join(a, b, overlap, how)
    spread = I.interval_join(a, b, overlap, how, bucket=10.0).select(*plain.columns)
    key = lambda df: sorted(map(repr, map(tuple, df.collect())))
    assert key(plain) == key(spread)


def test_coalescing_is_idempotent_and_joins_touching_intervals(spark):
    rows = [(1, 1, 0.0, 5.0, "a"), (2, 1, 5.0, 10.0, "a"), (3, 1, 11.0, 12.0, "a"), (4, 1, 2.0, 3.0, "a"), (5, 1, 0.0, 20.0, "b"), (6, 2, 0.0, 1.0, "a")]
    ann = spark.createDataFrame([(*r, None) for r in rows], schemas.ANNOTATIONS)
    once = LB.coalesced(ann)
    key = lambda df: sorted(map(tuple, df.select("vid", "label", "start_time", "end_time").collect()))
    assert key(once) == [(1, "a", 0.0, 10.0), (1, "a", 11.0, 12.0), (1, "b", 0.0, 20.0), (2, "a", 0.0, 1.0)]
    assert key(LB.coalesced(once)) == key(once)
    step = ann.limit(0)
    now = F.lit("2024-01-01").cast("timestamp")
    for _, vid, s, e, label in rows:
        step = LB.label_added(step, vid, s, e, label, now)
    assert key(step) == key(once)
    assert LB.label_added(ann, 1, 0.0, 5.0, "a", now).count() == ann.count()


def test_clip_splits_round_half_to_even(spark):
    v = spark.createDataFrame([(1, 0.3), (2, 2.5), (3, 3.5), (4, None)], "vid bigint, vduration double")
    assert sorted((r["vid"], r["start_time"]) for r in I.splits(v, 1.0).collect()) == [(2, 0.0), (2, 1.0), (3, 0.0), (3, 1.0), (3, 2.0), (3, 3.0)]


def test_labels_composite(spark):
    df = spark.createDataFrame([([None, "b", "a", "a"],), ([],), (["x"],)], "l array<string>")
    assert [r[0] for r in df.select(L.joined(F.col("l"))).collect()] == ["a_b", "none", "x"]
    assert L.feature_name(["a", "b"]) == "a+b" and L.feature_names("a+b") == ["a", "b"]
    with pytest.raises(ValueError):
        L.feature_name(["a+b"])


def test_nearest_keeps_base_without_length_and_breaks_ties(spark):
    rows = lambda x: spark.createDataFrame([(*r, [1.0, float(r[0])]) for r in x], schemas.FEATURES)
    base = rows([(1, 1, 0.0, 10.0), (2, 1, 5.0, 5.0), (3, 9, 0.0, 1.0)])
    over = rows([(10, 1, 4.0, 6.0), (11, 1, 6.0, 8.0), (12, 1, 5.0, 5.0), (13, 1, 5.0, 5.0)])
    assert sorted((r["fid"], r["o_fid"], len(r["feature"])) for r in FE.nearest(base, over).collect()) == [(1, 12, 4), (2, 12, 4)]


def test_empty_vectors_and_null_concat(spark):
    df = spark.createDataFrame([([1.0, 2.0], None), (None, None), ([0.0, 0.0], [3.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(V.concat(F.col("a"), F.col("b"))).collect()] == [[1.0, 2.0], None, [0.0, 0.0, 3.0]]
    assert df.select(V.normalised(F.col("a"))).collect()[2][0] == [0.0, 0.0]
    assert abs(df.select(V.gaussian_weight(F.lit(10.0))).first()[0] - 0.135335) < 1e-6


def test_search_without_hits_is_empty(spark):
    videos = spark.createDataFrame([(1, "/a", None, 5.0, "/t")], schemas.VIDEOS)
    ann, pred = spark.createDataFrame([], schemas.ANNOTATIONS), spark.createDataFrame([], schemas.PREDICTIONS)
    assert SE.search_videos(videos, ann, pred).count() == 1
    assert SE.search_videos(videos, ann, pred, ("2024-01-01", "2025-01-01")).count() == 0
    assert SE.search_videos(videos, ann, pred, predicted=["x"], mid=1).count() == 0
    assert [tuple(r) for r in SE.physical_clip(videos, 1, -3.0, 9.0).collect()] == [(1, 0.0, 5.0)]


def test_dense_ids_over_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(7)
    rows = ST.numbered(df, "n", 10, ["x"]).orderBy("x").collect()
    assert [r["n"] for r in rows] == list(range(11, 1011))


def test_coreset_radii_never_grow(spark):
    random.seed(3)
    f = spark.createDataFrame([(i, 1, 0.0, 1.0, [random.random(), random.random()]) for i in range(60)], schemas.FEATURES)
    radii = []
    for k in (1, 3, 6):
        chosen = SL.coreset(f, k, f.where("fid = 0")) if k > 1 else f.where("fid = 0")
        start = chosen.unionByName(f.where("fid = 0")).dropDuplicates(["fid"])
        radii.append(SL.farthest(f, start).agg(F.max("min_dist")).first()[0])
    assert radii == sorted(radii, reverse=True)


def test_bandit_never_removes_all_and_growth(spark):
    same = spark.createDataFrame([(f, t, 0.5) for f in "abc" for t in range(1, 6)], "feature_name string, t int, l double")
    assert B.survivors(B.bounds(same, 3, 5)).count() == 1
    l = spark.createDataFrame([([0.1, 0.2, 0.5, 0.4],), ([0.0, 0.0, 0.0],), ([0.3],), ([0.5, 0.4, 0.3],)], "l array<double>")  # noqa: E741
    got = [r[0] for r in l.select(B.growth(F.col("l"), 1)).collect()]
    assert math.isclose(got[0], (0.4 - 0.2) / 2) and got[1:3] == [1e6, 1e6] and math.isclose(got[3], 0.3 / 2)


def test_average_precision_with_ties(spark):
    rows = [("a", 0.9, 1), ("a", 0.5, 0), ("a", 0.5, 1), ("a", 0.1, 1), ("b", 0.3, 0)]
    got = {r["label"]: r["average_precision"] for r in M.average_precision(spark.createDataFrame(rows, "label string, probability double, y int")).collect()}
    assert math.isclose(got["a"], (1 + 2 / 3 + 3 / 4) / 3) and got["b"] is None


def test_uniformity():
    assert SL.binomial_uniform({"a": 100.0}, 0.001, 2.0) and SL.cvm_uniform({"a": 3.0})
    assert SL.binomial_uniform({"a": 10.0, "b": 10.0}, 0.001, 2.0)
    assert not SL.binomial_uniform({"a": 10.0, "b": 0.1}, 0.001, 2.0)
    assert SL.cvm_uniform({"a": 50.0, "b": 50.0, "c": 50.0}) is not None
    assert not SL.cvm_uniform({"a": 1000.0, "b": 1.0, "c": 1.0})


def test_corrupt_files_are_skipped_and_names_listed(spark, tmp_path):
    f = spark.createDataFrame([(1, 1, 0.0, 1.0, [1.0])], schemas.FEATURES)
    for name in ("r3d", "clip", "tmp"):
        ST.write_features(f, str(tmp_path / "s"), name)
    assert {r[0] for r in VS.feature_folders(spark, str(tmp_path / "s")).collect()} == {"r3d", "clip"}
    (tmp_path / "s/feature_name=r3d/bad.parquet").write_bytes(b"not parquet")
    assert VS.readable(spark, str(tmp_path / "s/feature_name=r3d"), schemas.FEATURES).count() == 1


def test_folder_source(spark, tmp_path):
    (tmp_path / "v/x").mkdir(parents=True)
    (tmp_path / "v/x/a.mp4").write_bytes(b"1")
    (tmp_path / "v/b.txt").write_bytes(b"1")
    (row,) = VS.from_folder(spark, str(tmp_path / "v"), "/t").collect()
    assert row["vpath"].endswith("/v/x/a.mp4") and row["thumbpath"] == "/t/a.jpg" and row["vstart"] is None


def test_stream_of_labels_equals_batch(spark, tmp_path):
    from kinolake.streaming import labels as SL_

    random.seed(7)
    rows = [(random.randrange(3), s := float(random.randrange(60)), s + random.randrange(8), random.choice("ab")) for _ in range(60)]  # noqa: F841
    schema = "vid bigint, start_time double, end_time double, label string"
    for i in range(3):
        spark.createDataFrame(rows[i * 20 : i * 20 + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = SL_.coalescing(stream).writeStream.outputMode("update").format("memory").queryName("spans").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    ann = spark.createDataFrame([(i, v, s, e, x, None) for i, (v, s, e, x) in enumerate(rows)], schemas.ANNOTATIONS)
    want = {tuple(r) for r in LB.coalesced(ann).select("vid", "label", "start_time", "end_time").collect()}
    emitted = {tuple(r) for r in spark.table("spans").collect()}
    assert want <= emitted
    out = SL_.appended(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c2"))
    out.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 60
