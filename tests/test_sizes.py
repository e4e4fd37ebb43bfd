"""What failed, or took too long, on larger tables."""

import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kinolake.functions import vectors as V
from kinolake.operators import discriminant as D
from kinolake.operators import models as M
from kinolake.operators import search as SE
from kinolake.operators import select as SL
from kinolake.plans import all_oracles, all_queries
from kinolake.sources import videos as VS

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n", [4, 50, 9_999, 10_001, 40_000])
@pytest.mark.parametrize("power", [1, 2])
def test_harmonic_sums(n, power):
    assert np.isclose(SL.harmonic(n, power), float((1 / np.arange(1, n + 1) ** float(power)).sum()), rtol=1e-13)


def test_uniformity_of_very_many_seconds():
    """10 ** 11 seconds of labels: a sum over all ranks would need 800 GB."""
    assert SL.ad_uniform({x: 2e10 for x in "abcde"}) and not SL.ad_uniform({"a": 9e10, "b": 1e9, "c": 1e9})


def test_random_few_equals_its_sql_with_more_rows_than_strata(spark, tmp_path):
    spark.range(7000).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0)).cast("array<float>").alias("embedding")).write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.read.parquet(f"{DATA}/events.parquet").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    for t in ("embeddings", "events"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got = {r["fid"] for r in all_queries()["ml15_random_few"](spark, str(tmp_path)).collect()}
    assert got == {f for (f,) in con.sql(all_oracles()["ml15_random_few"]).fetchall()} and len(got) == 42


def test_softmax_and_norms_of_long_vectors(spark):
    """Sums and maxima are taken once a row, not once a place."""
    x = np.random.default_rng(1).normal(size=(20, 2000))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(20, None), (21, [0.0, 0.0])], "i long, v array<double>")
    start = time.monotonic()
    got = df.select("i", V.softmax(F.col("v")).alias("s"), V.normalised(F.col("v"), 1).alias("n"), V.normalised(F.col("v")).alias("m")).orderBy("i").collect()
    assert time.monotonic() - start < 30
    e = np.exp(x)
    for r, a, s in zip(got, x, e, strict=False):
        assert np.allclose(r["s"], s / s.sum()) and np.allclose(r["n"], a / np.abs(a).sum()) and np.allclose(r["m"], a / np.linalg.norm(a))
    assert got[20][1:] == (None, None, None) and got[21][1:] == ([0.5, 0.5], [0.0, 0.0], [0.0, 0.0])


def far_table(spark, n=900):
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(n // 3, 8)), 3, axis=0)  # each vector three times
    return x, spark.createDataFrame([(i, 0, 0.0, 1.0, v.tolist()) for i, v in enumerate(x)], "fid long, vid long, start_time double, end_time double, feature array<double>")


def test_far_rows_leave_most_rows_out_and_none_of_the_farthest(spark):
    x, df = far_table(spark)
    inside = [i for i in range(900) if i % 9 < 6]
    outside = sorted(set(range(900)) - set(inside))
    want = {i: float(np.sqrt(((x[i] - x[inside]) ** 2).sum(-1)).min()) for i in outside}
    left, below = SL.far_rows(df.where("fid % 9 >= 6"), df.where("fid % 9 < 6"), k=5, part=16, at_once=12)
    got = {r["fid"]: r["min_dist"] for r in left.collect()}
    assert 5 <= len(got) < 150 and all(np.isclose(want[i], d) for i, d in got.items())
    assert all(i in got for i in outside if want[i] >= below) and sum(d >= below for d in want.values()) >= 5


def test_coreset_from_many_rows_is_greedy(spark):
    x, df = far_table(spark)
    chosen, want = [i for i in range(900) if i % 9 < 6], []
    for _ in range(7):
        d = np.sqrt(((x[:, None] - x[None, chosen + want]) ** 2).sum(-1)).min(axis=1)
        d[chosen + want] = -1
        want.append(int(np.flatnonzero(np.isclose(d, d.max(), rtol=1e-12))[0]))
    got = SL.coreset(df, 7, df.where("fid % 9 < 6"), block=16, ahead=4)
    assert sorted(r["fid"] for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_very_many_files_are_written_in_few_folders(spark, tmp_path, scheme):
    """Spark's writer took some 50 ms a file, and a task of the listing a file."""
    rows = spark.range(9000).select((F.col("id") % 3000).alias("vid"), F.concat(F.lit("ä "), F.lpad(F.col("id").cast("string"), 5, "0")).alias("line"))
    start = time.monotonic()
    VS.text_files(rows.unionByName(spark.createDataFrame([(7, ""), (None, "x"), (-1, None)], "vid long, line string")), f"{scheme}{tmp_path}/a b")
    assert time.monotonic() - start < 20
    folders = list((tmp_path / "a b").iterdir())
    got = {f.name: f.read_bytes().decode() for d in folders for f in d.iterdir()}
    want = {f"vid={i}.txt": "".join(f"ä {i + k:05}\n" for k in (0, 3000, 6000)) for i in range(3000)}
    want["vid=7.txt"] = "\n" + want["vid=7.txt"]
    assert len(folders) <= VS.FOLDERS and got == want | {"vid=__HIVE_DEFAULT_PARTITION__.txt": "x\n", "vid=-1.txt": "\n"}


@pytest.mark.parametrize("overlap", ["full", "partial", "strict"])
def test_unlabeled_clips_of_one_video_with_very_many(spark, overlap):
    """Clips and annotations of a video met one by one in one task: 20,000 by 20,000 took more than a minute. An annotation of no label's name is one, too."""
    rng = np.random.default_rng(5)
    starts = np.concatenate([rng.integers(0, 70_000, 19_000) / 4.0, rng.uniform(0, 17_000, 1000)])
    ends = starts + np.concatenate([rng.integers(0, 14, 19_000) / 4.0, rng.uniform(0, 9, 1000)])
    ann = spark.createDataFrame([(1, float(s), float(e), "a") for s, e in zip(starts, ends, strict=True)] + [(1, 18_000.0, 18_009.0, None), (1, 19_990.0, 1e15, "b"), (3, 0.0, 9e9, "a"), (1, None, 5.0, "a")], "vid long, start_time double, end_time double, label string")
    videos = spark.createDataFrame([(1, 20_000.4), (1, 7.0), (2, 2.0), (None, 1.0), (3, None)], "vid long, vduration double")
    start = time.monotonic()
    got = sorted((r["vid"] or 0, r["start_time"], r["end_time"]) for r in SL.unlabeled_splits(videos, ann, 1.0, overlap).collect())
    assert time.monotonic() - start < 30
    s, e = np.append(starts, [18_000.0, 19_990.0]), np.append(ends, [18_009.0, 1e15])

    def free(c):
        d = c + 1.0
        if overlap == "full":
            hit = (c >= s) & (d <= e)
        elif overlap == "partial":
            hit = (c <= e) & (s <= d)
        else:
            hit = ((s < c) & (c < e)) | ((s < d) & (d < e)) | ((c < s) & (s < d)) | ((c < e) & (e < d)) | ((c >= s) & (d <= e)) | ((s >= c) & (e <= d))
        return not hit.any()

    assert got == [(0, 0.0, 1.0)] + [(1, c, c + 1.0) for c in map(float, range(20_000)) if free(c)] + [(2, 0.0, 1.0), (2, 1.0, 2.0)]


def test_bucketed_predictions_spread_each_clip_once(spark):
    """Clips were spread over their time buckets, and shuffled, a second time to find those that meet nothing."""
    low = "vid long, start_time double, end_time double"
    clips = spark.createDataFrame([(1, 0.0, 9.0), (1, 0.0, 9.0), (1, 20.0, 21.0), (2, 0.0, 99.0), (None, 0.0, 1.0), (1, None, 3.0)], low)
    pred = spark.createDataFrame([(1, 8.0, 12.0, "b", 0.5), (1, 8.0, 12.0, "a", None), (1, 3.0, 4.0, None, 0.1), (1, 9.0, 9.5, "a", 0.3), (2, 99.0, 100.0, "a", 0.2)], f"{low}, label string, probability double")
    plans, got = [], []
    for bucket in (None, 2.0):
        df = SE.predictions_for_clips(clips, pred, bucket)
        got.append(sorted(str(r) for r in df.collect()))
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
    assert got[0] == got[1] and len(got[0]) == 5 and sum("predictions=[]" in x for x in got[0]) == 4
    assert plans[1].count("Generate explode") == 2


def test_cross_validation_makes_its_rows_once(spark):
    """Each pass of training and scoring made the labelled rows again."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(len(b))
            yield b

    rng = np.random.default_rng(6)
    rows = [(i, i % 40, float(i), i + 1.0, "abcd"[i % 40 % 4], (rng.normal(size=3) + i % 4).tolist()) for i in range(200)]
    schema = "fid long, vid long, start_time double, end_time double, labels string, feature array<double>"
    row = M.cross_validated(spark.createDataFrame(rows, schema).mapInPandas(counted, schema), 2).first()
    assert row["f1_macro"] > 0.3 and made.value <= 2 * len(rows)


def test_a_discriminant_round_makes_its_rows_once(spark):
    """Each step of the fit and of the clustering made the labelled rows again."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(len(b))
            yield b

    rng = np.random.default_rng(7)
    rows = [(i, i % 5, "ab"[i % 2] if i % 3 else None, None, (rng.normal(size=4) + 3 * (i % 2)).tolist()) for i in range(200)]
    schema = "fid long, cluster long, hard_label string, label string, feature array<double>"
    out, model = D.discriminant_round(spark.createDataFrame(rows, schema).mapInPandas(counted, schema), 50)
    got = {r["fid"]: r["label"] for r in out.collect()}
    assert model is not None and len(got) == 200 and all(got[i] == h for i, _, h, _, _ in rows if h) and made.value == 200


def test_frame_windows_are_made_by_many_tasks(spark):
    """The few rows of videos were brought into one task, which made and wrote all windows."""
    got = all_queries()["fn16_frame_windows"](spark, "/root/testdata/sf0.01")
    assert got.groupBy(F.spark_partition_id()).count().count() > 8
