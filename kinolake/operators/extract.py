"""From frames to vectors: extraction by a user's function, and the vector forms of frame statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V

EXTRACTED = "vid bigint, start_time double, end_time double, feature array<float>"


def extracted(files: DataFrame, extract: Callable[[bytes], Iterator[tuple[float, float, np.ndarray]]]) -> DataFrame:
    """VX05: files (vid, content) through a function from a video's bytes to (start, end, vector) windows; one file at a time is held."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for vid, content in zip(pdf["vid"], pdf["content"], strict=True):
                rows = [(vid, s, e, np.asarray(v, np.float32)) for s, e, v in extract(content)]
                yield pd.DataFrame(rows, columns=["vid", "start_time", "end_time", "feature"])

    return files.select("vid", "content").mapInPandas(run, EXTRACTED)


def bag_of_words(features: DataFrame, centroids: DataFrame) -> DataFrame:
    """AG17: per video how many of its vectors are nearest to each centroid (word, centre); words that none is nearest to count 0. The centroids are as many
    as the vocabulary has words."""
    book = centroids.agg(F.array_sort(F.collect_list(F.struct("word", "centre"))).alias("book"))
    near = F.array_min(F.transform("book", lambda b: F.struct(V.distance(F.col("feature"), b["centre"]).alias("d"), b["word"].alias("word"))))["word"]
    rows = features.crossJoin(F.broadcast(book)).select("vid", near.alias("word"), F.transform("book", lambda b: b["word"]).alias("words"))
    counts = rows.groupBy("vid", "word").agg(F.count("*").alias("n"), F.first("words").alias("words"))
    per = counts.groupBy("vid").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("m"), F.first("words").alias("words"))
    return per.select("vid", F.transform("words", lambda w: F.coalesce(F.try_element_at("m", w), F.lit(0))).alias("histogram"))


def codebook(features: DataFrame, words: int, seed: int = 0) -> DataFrame:
    """The centroids of a bag of words, by KMeans."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = features.select(array_to_vector(V.doubles(F.col("feature"))).alias("x"))
    model = KMeans(featuresCol="x", k=words, seed=seed).fit(rows)
    return features.sparkSession.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(model.clusterCenters())], "word int, centre array<double>")


def spread(values: Column) -> Column:
    """FN26: minimum, quartiles and maximum of a vector, as percentiles with linear interpolation."""
    s = F.array_sort(V.doubles(values))

    def at(q: float) -> Column:
        place = (F.size(s) - 1) * F.lit(q)
        lo = F.floor(place).cast("int")
        a, b = F.element_at(s, lo + 1), F.element_at(s, F.least(lo + 2, F.size(s)))
        return a + (b - a) * (place - lo)

    return F.array(*map(at, (0.0, 0.25, 0.5, 0.75, 1.0)))


def grid_ranks(cells: Column) -> Column:
    """FN26: rank (from 0) of each cell of a grid by its value, equal cells in their order."""
    pairs = F.transform(cells, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    order = F.transform(F.array_sort(pairs), lambda p: p["i"])
    return F.transform(cells, lambda _, i: F.array_position(order, i).cast("int") - 1)


def spectrum(signal: Column, size: int) -> Column:
    """FN26: magnitudes of the first `size` discrete Fourier coefficients of a short vector."""
    x, n = V.doubles(signal), F.size(signal)

    def part(k: Column, fn) -> Column:
        terms = F.transform(x, lambda v, t: v * fn(F.lit(2 * np.pi) * k * t / n))
        return F.aggregate(terms, F.lit(0.0), lambda a, v: a + v)

    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.sqrt(F.pow(part(k, F.cos), F.lit(2)) + F.pow(part(k, F.sin), F.lit(2))))


def sampled(frames: DataFrame, stride: int, first: bool = True) -> DataFrame:
    """VX06: every `stride`-th frame of a video (vid, frame_no), from the first one or the middle of each stretch."""
    n = F.row_number().over(Window.partitionBy("vid").orderBy("frame_no")) - 1
    return frames.withColumn("_n", n).where(F.col("_n") % stride == (0 if first else stride // 2)).drop("_n")


def median_frame(frames: DataFrame) -> DataFrame:
    """VX06: per video the median of each pixel over its frames (vid, pixels array)."""
    each = frames.select("vid", F.posexplode(V.doubles(F.col("pixels"))).alias("i", "x")).groupBy("vid", "i").agg(F.median("x").alias("x"))
    return each.groupBy("vid").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("pixels"))
