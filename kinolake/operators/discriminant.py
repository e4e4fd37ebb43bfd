"""Discriminant analysis and mixtures over feature rows, and label cleaning with them.

Fitting adds sums in Spark (a row a class, and a row a place of the scatter matrices) and solves matrices of the vectors' length at the driver: K classes and d
places make K d numbers for the linear, K d ** 2 for the quadratic form, whatever the rows. Scoring maps rows where they lie.
Labels are in a column `label`; rows without label or vector aren't learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import stored
from .cluster import vectors_of


def class_sums(rows: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(classes in order, rows of each, mean vector of each)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    known = _known(rows).withColumn("_x", array_to_vector("feature"))
    got = known.groupBy("label").agg(F.count("*").alias("n"), vector_to_array(Summarizer.mean(F.col("_x"))).alias("mean")).orderBy("label").collect()  # a row a class
    if not got:
        raise ValueError("no labeled rows")
    return [r["label"] for r in got], np.array([r["n"] for r in got], float), np.array([r["mean"] for r in got])


def _known(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("label").isNotNull() & F.col("feature").isNotNull()).select("label", V.doubles(F.col("feature")).alias("feature"))


def scatter(rows: DataFrame, classes: list[str], means: np.ndarray, by_class: bool) -> np.ndarray:
    """Sums of outer products of the rows' differences from their class means: one matrix, or one a class. A partition adds its own rows first and sends a row
    a place of the matrix; those of a place are added in one group, of as many rows as there are partitions."""
    number = {c: i for i, c in enumerate(classes)}
    kinds, dims = (len(classes) if by_class else 1), means.shape[1]

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((kinds, dims, dims))
        for b in batches:
            at = b["label"].map(number).to_numpy()
            x = vectors_of(b["feature"]) - means[at]
            for k in range(kinds):
                part = x[at == k] if by_class else x
                total[k] += part.T @ part
        flat = total.reshape(kinds * dims, dims)
        yield pd.DataFrame({"place": np.arange(len(flat)), "sums": list(flat)})

    def added(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"place": [key[0]], "sums": [np.stack(group["sums"].to_numpy()).sum(axis=0)]})

    parts = _known(rows).mapInPandas(own, "place long, sums array<double>").groupBy("place").applyInPandas(added, "place long, sums array<double>")
    out = np.zeros((kinds * dims, dims))
    for r in parts.collect():  # kinds * dims rows of dims numbers
        out[r["place"]] = r["sums"]
    return out.reshape(kinds, dims, dims)


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Linear:
    """LB04, LB05, LB08: linear discriminant analysis."""

    classes: list[str]
    priors: np.ndarray
    centre: np.ndarray
    scalings: np.ndarray
    coefficients: np.ndarray
    intercepts: np.ndarray

    @classmethod
    def fit(cls, rows: DataFrame, tolerance: float = 1e-4) -> Linear:
        """Within-class scatter, standardised by place, is whitened by its eigenvectors; in the whitened space the class means' principal directions are the
        projections, the strongest first. Directions of less than tolerance (as a share of the strongest) are left out, as are places that never vary."""
        classes, n, means = class_sums(rows)
        if len(classes) < 2:
            raise ValueError("at least two classes")
        total = n.sum()
        priors = n / total
        centre = priors @ means
        within = scatter(rows, classes, means, False)[0]
        spread = np.sqrt(np.diag(within) / total)
        spread[spread == 0] = 1.0
        values, turn = np.linalg.eigh(within / np.outer(spread, spread) / max(1.0, total - len(classes)))
        size = np.sqrt(np.maximum(values, 0))[::-1]
        used = size > tolerance
        white = (turn[:, ::-1] / spread[:, None])[:, used] / size[used]
        between = np.sqrt(total * priors / (len(classes) - 1))[:, None] * ((means - centre) @ white)
        _, strength, axes = np.linalg.svd(between, full_matrices=False)
        scalings = white @ axes.T[:, : int((strength > tolerance * strength[0]).sum())]
        flat = (means - centre) @ scalings
        coefficients = flat @ scalings.T
        intercepts = np.log(priors) - 0.5 * (flat**2).sum(axis=1) - coefficients @ centre
        return cls(classes, priors, centre, scalings, coefficients, intercepts)

    def project(self, x: np.ndarray, components: int | None = None) -> np.ndarray:
        return (x - self.centre) @ self.scalings[:, : components or min(len(self.classes) - 1, self.scalings.shape[1])]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return softmax(x @ self.coefficients.T + self.intercepts)


@dataclass
class Quadratic:
    """LB02, LB08: quadratic discriminant analysis, covariances shrunk towards the identity by `shrinkage`."""

    classes: list[str]
    priors: np.ndarray
    means: np.ndarray
    turns: np.ndarray
    variances: np.ndarray

    @classmethod
    def fit(cls, rows: DataFrame, shrinkage: float = 0.0) -> Quadratic:
        classes, n, means = class_sums(rows)
        if (n < 2).any():
            raise ValueError("at least two rows a class")
        values, turns = np.linalg.eigh(scatter(rows, classes, means, True) / (n - 1)[:, None, None])
        variances = (1 - shrinkage) * np.maximum(values, 0) + shrinkage
        if (variances <= 1e-12 * variances.max(axis=1, keepdims=True)).any():
            raise ValueError("a class has no spread in some direction: use shrinkage")
        return cls(classes, n / n.sum(), means, turns, variances)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Log-densities with priors, but for the constant: -(distance + log-determinant) / 2."""
        out = np.empty((len(x), len(self.classes)))
        for k, (mean, turn, variance) in enumerate(zip(self.means, self.turns, self.variances, strict=True)):
            z = (x - mean) @ turn
            out[:, k] = -0.5 * ((z * z / variance).sum(axis=1) + np.log(variance).sum()) + np.log(self.priors[k])
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return softmax(self.scores(x))


def _mapped(rows: DataFrame, column: str, f) -> DataFrame:
    """rows with a column of vectors f(matrix of features); null where the feature is."""

    def run(batches):
        for x in batches:
            known = x.notna().to_numpy()
            made = iter(f(vectors_of(x[known])) if known.any() else ())
            yield pd.Series([next(made) if k else None for k in known], dtype=object)

    udf = F.pandas_udf(run, "array<double>", F.PandasUDFType.SCALAR_ITER)
    return rows.withColumn(column, udf(V.doubles(F.col("feature"))))


def probabilities(rows: DataFrame, model: Linear | Quadratic) -> DataFrame:
    """rows with `probabilities` (in the order of model.classes), `top` (the largest) and `predicted` (its class, the first of equals)."""
    out = _mapped(rows, "probabilities", model.probabilities)
    top = F.array_max("probabilities")
    return out.withColumn("top", top).withColumn("predicted", F.get(F.array(*map(F.lit, model.classes)), F.array_position("probabilities", top).cast("int") - 1))


def projected(rows: DataFrame, model: Linear, components: int | None = None) -> DataFrame:
    """rows with `feature` in the discriminant's projection: at most one place less than classes."""
    return _mapped(rows, "feature", lambda x: model.project(x, components))


def transformed(rows: DataFrame, model: Linear, principal: int = 2) -> DataFrame:
    """LB08: rows with `feature` as principal components of all rows followed by the discriminant's projection."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    flat = rows.withColumn("_x", array_to_vector(V.doubles(F.col("feature"))))
    flat = PCA(k=principal, inputCol="_x", outputCol="_z").fit(flat).transform(flat).withColumn("_z", vector_to_array("_z")).drop("_x")
    return projected(flat, model).withColumn("feature", F.concat("_z", "feature")).drop("_z")


def wrong_cluster(rows: DataFrame) -> DataFrame:
    """LB04: of the clusters with rows without hard_label that of most labeled rows with another `predicted` (smallest of equals); null if none of
    them has a labeled row. rows: (cluster, hard_label, predicted)."""
    wrong = F.sum((F.col("hard_label") != F.col("predicted")).cast("int"))
    open_ = rows.groupBy("cluster").agg(F.count("hard_label").alias("_n"), F.count("*").alias("_all"), wrong.alias("_wrong")).where("_n > 0 and _n < _all")
    return open_.agg(F.max_by("cluster", F.struct("_wrong", -F.col("cluster"))).alias("cluster"))


def doubtful_cluster(rows: DataFrame) -> DataFrame:
    """LB04: the cluster with rows without hard_label whose mean `top` is least (smallest of equals)."""
    open_ = rows.groupBy("cluster").agg(F.avg("top").alias("_m"), F.sum(F.col("hard_label").isNull().cast("int")).alias("_u")).where("_u > 0")
    return open_.agg(F.min_by("cluster", F.struct("_m", "cluster")).alias("cluster"))


def doubtful_element(rows: DataFrame) -> DataFrame:
    """LB05: of each cluster the row without hard_label of least `top` (smallest fid of equals)."""
    return rows.where("hard_label is null").groupBy("cluster").agg(F.min_by("fid", F.struct("top", "fid")).alias("fid"))


def cleaned(rows: DataFrame, classes: list[str], least: float = 0.99, ask: float = 0.0, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """LB08: (rows with `label` corrected, the clusters to ask a user about).

    rows: (fid, cluster, hard_label, label, probabilities); label is what is believed of each row, null for nothing. A cluster whose mean probabilities
    have a class of at least `least` is looked at if that class isn't its most frequent label (no label counts as one; the first of equals, none first) or nobody
    labeled any of its rows: with chance `ask` (a seeded hash of the cluster) it is to be asked about, else its rows without hard_label get the class."""
    mean = F.array(*[F.avg(F.get("probabilities", F.lit(i))) for i in range(len(classes))])
    per = rows.groupBy("cluster").agg(mean.alias("_p"), F.count("hard_label").alias("_hard"))
    top = F.array_max("_p")
    per = per.where(top >= least).withColumn("_class", F.get(F.array(*map(F.lit, classes)), F.array_position("_p", top).cast("int") - 1))
    votes = rows.groupBy("cluster", "label").agg(F.count("*").alias("_n"))
    mode = votes.groupBy("cluster").agg(F.min(F.struct(-F.col("_n"), F.col("label").isNotNull().alias("_some"), "label"))["label"].alias("_mode"))
    differ = per.join(mode, "cluster").where(~F.col("_class").eqNullSafe(F.col("_mode")) | (F.col("_hard") == 0))
    draw = F.pmod(F.xxhash64(F.lit(seed), "cluster"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    marked = differ.select("cluster", "_class", (draw < ask).alias("_ask"))
    out = rows.join(marked.where(~F.col("_ask")).drop("_ask"), "cluster", "left")
    out = out.withColumn("label", F.when(F.col("hard_label").isNull() & F.col("_class").isNotNull(), F.col("_class")).otherwise(F.col("label"))).drop("_class")
    return out.select(*rows.columns), marked.where("_ask").select("cluster")


def mixture(features: DataFrame, k: int, dims: int | None = None, seed: int = 0, rounds: int = 100) -> DataFrame:
    """LB04: features with the responsibilities of k Gaussians (`responsibilities`, summing to 1), `cluster` (that of the largest), `top` (how large it is) and
    `distance` to that component's mean. With dims, on so many principal components, as full covariances of long vectors need many rows."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = features.withColumn("_x", array_to_vector(V.doubles(F.col("feature"))))
    if dims:
        rows = PCA(k=dims, inputCol="_x", outputCol="_z").fit(rows).transform(rows).drop("_x").withColumnRenamed("_z", "_x")
    model = GaussianMixture(featuresCol="_x", predictionCol="cluster", probabilityCol="_p", k=k, seed=seed, maxIter=rounds).fit(rows)
    means = F.array(*[F.array(*[F.lit(float(v)) for v in g.mean]) for g in model.gaussians])
    out = model.transform(rows).withColumn("responsibilities", vector_to_array("_p"))
    return out.withColumn("top", F.array_max("responsibilities")).withColumn("distance", V.distance(vector_to_array("_x"), F.get(means, F.col("cluster")))).drop("_x", "_p")


def mixed_labels(rows: DataFrame) -> DataFrame:
    """LB06 for soft clusters: rows (fid, hard_label, responsibilities) with `label` and its `weight`. A component's labels weigh what its labeled rows' responsibilities add
    up to; a row takes the label of largest weight over its components, by its responsibilities; weights are shares of all labels' weights. A hard
    label stays, with weight 1; without any labeled row in reach the label is null. Labels and components are few: a row a pair is broadcast."""
    parts = F.posexplode("responsibilities").alias("_c", "_r")
    votes = rows.where("hard_label is not null").select("hard_label", parts).groupBy("_c", "hard_label").agg(F.sum("_r").alias("_w"))
    shares = votes.withColumn("_all", F.expr("sum(_w) over (partition by _c)")).where("_all > 0").select("_c", F.col("hard_label").alias("_label"), (F.col("_w") / F.col("_all")).alias("_share"))
    own = rows.where("hard_label is null").select("fid", parts).join(F.broadcast(shares), "_c").groupBy("fid", "_label").agg(F.sum(F.col("_r") * F.col("_share")).alias("_w"))
    total = own.groupBy("fid").agg(F.min(F.struct(-F.col("_w"), F.col("_label")))["_label"].alias("_label"), (F.max("_w") / F.sum("_w")).alias("_w"))
    out = rows.join(total, "fid", "left")
    hard = F.col("hard_label").isNotNull()
    return out.withColumn("label", F.coalesce("hard_label", "_label")).withColumn("weight", F.when(hard, 1.0).otherwise(F.col("_w"))).drop("_label", "_w")


def repropagated(rows: DataFrame) -> DataFrame:
    """LB06 after clusters changed: a hard label stays; another row takes its cluster's most frequent hard label, without one the most frequent earlier `label`,
    without one its own. Of equals the smallest. rows: (fid, cluster, hard_label, label)."""

    def mode(column: str, name: str) -> DataFrame:
        votes = rows.where(F.col(column).isNotNull()).groupBy("cluster", F.col(column).alias("_v")).agg(F.count("*").alias("_n"))
        return votes.groupBy("cluster").agg(F.min(F.struct(-F.col("_n"), F.col("_v")))["_v"].alias(name))

    out = rows.join(mode("hard_label", "_hard"), "cluster", "left").join(mode("label", "_soft"), "cluster", "left")
    return out.withColumn("label", F.coalesce("hard_label", "_hard", "_soft", "label")).select(*rows.columns)


def discriminant_round(rows: DataFrame, expected: int, principal: int = 2, least: float = 0.01, seed: int = 0) -> tuple[DataFrame, Linear | None]:
    """LB08, one round of a discriminant coordinator: rows (fid, feature, cluster, hard_label, label, ...) with clusters, distances and labels anew, and the model. While
    fewer than `least` of the rows have hard labels, or one class, clusters stay and only labels are propagated. Else the discriminant of the hard labels is fitted, all rows
    are clustered by KMeans on its projection with the principal components (count / expected clusters), and labels propagated in the new clusters.
    The rows and their projection are stored, as each step reads them again."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = stored(rows, "round")
    n, hard, kinds = rows.agg(F.count("*"), F.count("hard_label"), F.countDistinct("hard_label")).first()
    if not n or hard / n < least or kinds < 2:
        return repropagated(rows), None
    model = Linear.fit(rows.drop("label").withColumnRenamed("hard_label", "label"))
    flat = stored(transformed(rows.select("fid", "feature"), model, principal), "projected").select("fid", array_to_vector("feature").alias("_x"))
    fitted = KMeans(featuresCol="_x", predictionCol="_c", k=max(2, -(-n // expected)), seed=seed).fit(flat)
    centres = features_of_centres(rows, fitted.clusterCenters())
    own = fitted.transform(flat).join(F.broadcast(centres), "_c").select("fid", F.col("_c").cast(rows.schema["cluster"].dataType).alias("cluster"), V.distance(vector_to_array("_x"), F.col("_centre")).alias("distance"))
    kept = [c for c in rows.columns if c not in ("cluster", "distance")]
    return repropagated(rows.select(*kept).join(own, "fid")), model


def features_of_centres(rows: DataFrame, centres: list) -> DataFrame:
    """(_c, _centre): a row a cluster."""
    return rows.sparkSession.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(centres)], "_c int, _centre array<double>")

