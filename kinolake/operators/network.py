"""ML04: a network of one hidden layer of rectified linear units over feature rows, trained by averaging.

Each round sends the weights (bounded by the layers' sizes) to the rows' partitions; a partition walks through its rows once in mini-batches of a seeded order,
following the gradients of the weighted cross entropy by Adam from those weights, and returns its weights; their average, weighted by rows,
starts the next round. The driver holds one set of weights; a partition holds its rows' vectors.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import stored
from .cluster import vectors_of
from .discriminant import softmax
from .models import soft_targets

NAMES = ("w1", "b1", "w2", "b2")


def hidden_size(places: int, classes: int) -> int:
    """Two thirds of the vector's places, if that is more than the classes; else as many as places."""
    return 2 * places // 3 if 2 * places / 3 > classes else places


def forward(weights: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hidden values, probabilities) of a matrix of rows."""
    hidden = np.maximum(x @ weights["w1"] + weights["b1"], 0.0)
    return hidden, softmax(hidden @ weights["w2"] + weights["b2"])


def gradients(weights: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, share: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean cross entropy, rows weighted by share; y: numbers of classes."""
    hidden, p = forward(weights, x)
    p[np.arange(len(y)), y] -= 1.0
    p *= (share / share.sum())[:, None]
    back = (p @ weights["w2"].T) * (hidden > 0)
    return {"w1": x.T @ back, "b1": back.sum(axis=0), "w2": hidden.T @ p, "b2": p.sum(axis=0)}


@dataclass
class Network:
    classes: list[str]
    centre: np.ndarray
    spread: np.ndarray
    weights: dict[str, np.ndarray]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return forward(self.weights, (x - self.centre) / self.spread)[1]

    def to_json(self) -> str:
        return json.dumps({"classes": self.classes, "centre": self.centre.tolist(), "spread": self.spread.tolist(), "weights": {k: v.tolist() for k, v in self.weights.items()}})

    @classmethod
    def from_json(cls, text: str) -> Network:
        d = json.loads(text)
        return cls(d["classes"], np.array(d["centre"]), np.array(d["spread"]), {k: np.array(v) for k, v in d["weights"].items()})


def fit_network(labeled: DataFrame, hidden: int | None = None, rounds: int = 20, rate: float = 0.02, batch: int = 64, seed: int = 0, parts: int | None = None) -> Network:
    """A network for the labels of rows (feature, labels): a row with several labels counts as one of each, weighted by their share. Vectors are standardised. Rows are dealt to
    `parts` partitions (those of the session unless given) by a hash of all they hold and stored, so equal seeds, rows and parts give equal networks."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    rows = soft_targets(labeled.where(F.col("feature").isNotNull())).select("label", "weight", V.doubles(F.col("feature")).alias("feature"))
    spark = rows.sparkSession
    classes = [r["label"] for r in rows.select("label").distinct().orderBy("label").collect()]  # a row a class
    if not classes:
        raise ValueError("no labeled rows")
    number = {c: i for i, c in enumerate(classes)}
    x = array_to_vector("feature")
    stats = rows.agg(vector_to_array(Summarizer.mean(x)).alias("m"), vector_to_array(Summarizer.std(x)).alias("s")).first()
    centre, spread = np.array(stats["m"]), np.array(stats["s"])
    spread[spread == 0] = 1.0
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.xxhash64(F.lit(seed), "label", "weight", "feature")
    dealt = stored(rows.withColumn("_o", order).repartition(n, "_o").sortWithinPartitions("_o", "label", "feature"), "network")
    rng = np.random.default_rng(seed)
    size = hidden or hidden_size(len(centre), len(classes))
    weights = {
        "w1": rng.normal(0, np.sqrt(2 / len(centre)), (len(centre), size)), "b1": np.zeros(size),
        "w2": rng.normal(0, np.sqrt(1 / size), (size, len(classes))), "b2": np.zeros(len(classes)),
    }
    for k in range(rounds):
        weights = _averaged(dealt, weights, number, centre, spread, rate / (1 + 2 * k / rounds), batch, seed + k)
    return Network(classes, centre, spread, weights)


def _averaged(rows: DataFrame, start: dict[str, np.ndarray], number: dict[str, int], centre: np.ndarray, spread: np.ndarray, rate: float, batch: int, seed: int) -> dict[str, np.ndarray]:
    """One round: every partition's weights after one walk through its rows, averaged by rows."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, count = {k: v.copy() for k, v in start.items()}, 0
        first, second = {k: np.zeros_like(v) for k, v in start.items()}, {k: np.zeros_like(v) for k, v in start.items()}
        steps = 0
        for b in batches:  # an Arrow batch at a time, in its own order
            x = (vectors_of(b["feature"]) - centre) / spread
            y, share = b["label"].map(number).to_numpy(), b["weight"].to_numpy()
            mixed = np.random.default_rng(seed).permutation(len(b))
            for i in range(0, len(b), batch):
                at = mixed[i : i + batch]
                steps += 1
                for k, g in gradients(weights, x[at], y[at], share[at]).items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    weights[k] -= rate * (first[k] / (1 - 0.9**steps)) / (np.sqrt(second[k] / (1 - 0.999**steps)) + 1e-8)
            count += len(b)
        if count:
            yield pd.DataFrame({"n": [count], **{k: [weights[k].ravel()] for k in NAMES}})

    got = rows.mapInPandas(walk, "n long, " + ", ".join(f"{k} array<double>" for k in NAMES)).collect()  # a set of weights a partition
    # in an order of their own, as sums of floats hang on it
    got.sort(key=lambda r: (r["n"], r["w1"][:1], r["b2"]))
    total = sum(r["n"] for r in got)
    return {k: sum(r["n"] / total * np.array(r[k]) for r in got).reshape(start[k].shape) for k in NAMES}


def infer_network(model: Network, features: DataFrame, mid: int) -> DataFrame:
    """ML09: one row for each window and class: (mid, vid, start_time, end_time, label, probability). Rows without a vector have none."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p = model.probabilities(vectors_of(b["feature"]))
            yield b.drop(columns="feature").assign(p=list(p))

    rows = features.where(F.col("feature").isNotNull()).select("vid", "start_time", "end_time", V.doubles(F.col("feature")).alias("feature"))
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("vid", "start_time", "end_time"))
    pairs = F.arrays_zip(F.array(*map(F.lit, model.classes)).alias("label"), F.col("p").alias("probability"))
    out = rows.mapInPandas(run, f"{kinds}, p array<double>").select(F.lit(mid).alias("mid"), "vid", "start_time", "end_time", F.explode(pairs).alias("q"))
    return out.select("mid", "vid", "start_time", "end_time", "q.label", "q.probability")
