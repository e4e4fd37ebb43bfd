"""Training sets, classifiers over feature vectors, predictions and their quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import vectors as V
from ..session import stored
from .features import for_clips
from .labels import label_join, with_columns_of

THRESHOLDS = (0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5)


def training_set(features: DataFrame, videos: DataFrame, annotations: DataFrame, ignore: list[str] | None = None, overlap: str = "full") -> DataFrame:
    """ML01: feature rows inside (or touching) some used annotation, with their labels."""
    used = annotations.where(~F.col("label").isin(ignore)) if ignore else annotations
    rows = for_clips(features.drop("feature"), used, overlap)
    return with_columns_of(label_join(rows, videos, annotations, overlap, ignore), features)


def soft_targets(labeled: DataFrame) -> DataFrame:
    """ML03: one row a label, weighted by one over the number of labels: the soft-target objective as weighted single labels."""
    own = L.pieces(F.col("labels"))
    return labeled.withColumn("label", F.explode(own)).withColumn("weight", 1.0 / F.size(own))


def fit_linear(labeled: DataFrame, max_iter: int = 50, reg: float = 1e-3):
    """ML03, ML14: multinomial logistic regression on standardised vectors; returns a fitted pipeline and its classes in order."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, StringIndexer

    rows = vectorised(soft_targets(labeled))
    stages = [StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc"), StandardScaler(inputCol="x", outputCol="z", withMean=True), LogisticRegression(featuresCol="z", labelCol="y", weightCol="weight", family="multinomial", maxIter=max_iter, regParam=reg, probabilityCol="p")]
    model = Pipeline(stages=stages).fit(rows)
    return model, list(model.stages[0].labels)


def fit_mlp(labeled: DataFrame, hidden: tuple[int, ...] = (64, 32), max_iter: int = 50, seed: int = 0):
    """ML04: multilayer perceptron (sigmoid layers) on the first label of each row."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.feature import StringIndexer

    rows = vectorised(labeled.withColumn("label", F.element_at(L.pieces(F.col("labels")), 1)))
    size = len(rows.select("feature").first()[0])
    index = StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc").fit(rows)
    net = MultilayerPerceptronClassifier(featuresCol="x", labelCol="y", probabilityCol="p", layers=[size, *hidden, len(index.labels)], maxIter=max_iter, seed=seed)
    return Pipeline(stages=[index, net]).fit(rows), list(index.labels)


def vectorised(df: DataFrame) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.withColumn("x", array_to_vector(V.doubles(F.col("feature"))))


def infer(model, classes: list[str], features: DataFrame, mid: int) -> DataFrame:
    """ML09: one row for each window and class."""
    from pyspark.ml.functions import vector_to_array

    stages = [s for s in model.stages if type(s).__name__ != "StringIndexerModel"]
    rows = vectorised(features)
    for s in stages:
        rows = s.transform(rows)
    pairs = F.arrays_zip(F.array(*map(F.lit, classes)).alias("label"), vector_to_array("p").alias("probability"))
    return rows.select(F.lit(mid).alias("mid"), "vid", "start_time", "end_time", F.explode(pairs).alias("q")).select("mid", "vid", "start_time", "end_time", "q.label", "q.probability")


def predicted(features: DataFrame, stored: DataFrame, mid: int, run) -> DataFrame:
    """ML09, ML11: stored predictions of videos that have them, fresh ones (run: a function of feature rows) for the other videos, together."""
    own = stored.where(F.col("mid") == mid)
    keys = features.select("vid", "start_time", "end_time").distinct()
    cached = own.join(keys, ["vid", "start_time", "end_time"], "left_semi")
    fresh = run(features.join(own.select("vid").distinct(), "vid", "left_anti"))
    return cached.unionByName(fresh)


def linear_scores(features: DataFrame, weights: dict[str, list[float]], mid: int = 1) -> DataFrame:
    """Softmax of fixed linear scores; a model given by its weights."""
    dot = lambda w: F.aggregate(F.zip_with(V.doubles(F.slice("feature", 1, len(w))), F.array(*map(F.lit, w)), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    p = V.softmax(F.array(*[dot(w) for w in weights.values()]))
    pairs = F.arrays_zip(F.array(*map(F.lit, weights)).alias("label"), p.alias("probability"))
    return features.select(F.lit(mid).alias("mid"), "fid", "vid", "start_time", "end_time", F.explode(pairs).alias("q")).select("mid", "fid", "vid", "start_time", "end_time", "q.label", "q.probability")


def truth(predictions: DataFrame, labeled: DataFrame, ignore: list[str] | None = None) -> DataFrame:
    """ML13: (vid, start_time, end_time, label, probability, y) of labeled windows, y 1 where the label is one of the window's."""
    known = labeled.where(F.col("labels") != L.NONE)
    if ignore:
        known = known.where(~F.col("labels").isin(ignore))
    both = predictions.join(known.select("vid", "start_time", "end_time", "labels").distinct(), ["vid", "start_time", "end_time"])
    return both.select("vid", "start_time", "end_time", "label", "probability", F.array_contains(L.pieces(F.col("labels")), F.col("label")).cast("int").alias("y"))


def by_video(scored: DataFrame) -> DataFrame:
    """AG09: per video and class the largest truth and probability."""
    return scored.groupBy("vid", "label").agg(F.max("y").alias("y"), F.max("probability").alias("probability"))


def counts_at(scored: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """True and false positives and negatives of each class at each threshold (a prediction at the threshold counts as positive)."""
    t = F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")
    rows = scored.select("label", "y", "probability", t)
    hit = F.col("probability") >= F.col("threshold")
    n = lambda c: F.sum(c.cast("int"))
    return rows.groupBy("label", "threshold").agg(n(hit & (F.col("y") == 1)).alias("tp"), n(hit & (F.col("y") == 0)).alias("fp"), n(~hit & (F.col("y") == 1)).alias("fn"), n(~hit & (F.col("y") == 0)).alias("tn"))


def f1_scores(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and accuracy; a ratio of nothing is 0."""
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return counts.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn), "accuracy": ratio(tp + tn, tp + fp + fn + tn)})


def best_threshold(scored: DataFrame) -> DataFrame:
    """ML06: the threshold of the largest mean F1 over classes (the smallest of equals); .5 with a single class."""
    f1 = f1_scores(counts_at(scored, THRESHOLDS)).groupBy("threshold").agg(F.avg("f1").alias("f1"), F.count("*").alias("classes"))
    pick = f1.agg(F.max_by("threshold", F.struct("f1", -F.col("threshold"))).alias("threshold"), F.max("f1").alias("f1"), F.max("classes").alias("classes"))
    return pick.select(F.when(F.col("classes") == 1, F.lit(0.5)).otherwise(F.col("threshold")).alias("threshold"), "f1")


def running(scored: DataFrame) -> DataFrame:
    """Per class and distinct probability p positives of n rows, and with all that are more probable `tp` of `seen`. Classes are few and rows many, so the running
    counts are taken over distinct probabilities, summed first."""
    ties = scored.groupBy("label", "probability").agg(F.sum("y").alias("p"), F.count("*").alias("n"))
    w = Window.partitionBy("label").orderBy(F.desc("probability")).rowsBetween(Window.unboundedPreceding, 0)
    return ties.withColumn("tp", F.sum("p").over(w)).withColumn("seen", F.sum("n").over(w))


def average_precision(scored: DataFrame) -> DataFrame:
    """ML07: per class the sum of precision times the step of recall over falling probabilities, equal probabilities together; null without a positive."""
    return running(scored).groupBy("label").agg(_precision())


def _precision() -> Column:
    return F.try_divide(F.sum(F.col("p") * F.col("tp") / F.col("seen")), F.sum("p")).alias("average_precision")


def metrics(scored: DataFrame, threshold: float = 0.4) -> DataFrame:
    """ML07: one row: macro and micro F1 and accuracy at the threshold, and mAP over classes that have positives. The rows are scored once: all of it comes from the counts by
    class and probability."""
    hit, pos, neg = F.col("probability") >= threshold, F.col("p"), F.col("n") - F.col("p")
    n = lambda c, x: F.sum(F.when(c, x).otherwise(0))
    per = f1_scores(running(scored).groupBy("label").agg(n(hit, pos).alias("_tp"), n(hit, neg).alias("_fp"), n(~hit, pos).alias("_fn"), n(~hit, neg).alias("_tn"), _precision()).withColumnsRenamed({f"_{c}": c for c in ("tp", "fp", "fn", "tn")}))
    means = [F.avg("f1").alias("f1_macro"), F.avg("accuracy").alias("accuracy_macro"), F.avg("average_precision").alias("map")]
    one = f1_scores(per.agg(*means, *[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")]))
    return one.select("f1_macro", "accuracy_macro", F.col("f1").alias("f1_micro"), F.col("accuracy").alias("accuracy_micro"), "map")


def top_k_accuracy(scored: DataFrame, k: int) -> DataFrame:
    """ML07: share of windows whose first true class (by name) is among their k most probable ones."""
    w = Window.partitionBy("vid", "start_time", "end_time")
    ranked = scored.withColumn("_r", F.row_number().over(w.orderBy(F.desc("probability"), "label")))
    each = ranked.groupBy("vid", "start_time", "end_time").agg(F.min(F.when(F.col("y") == 1, F.struct("label", "_r")))["_r"].alias("_r"), F.max("y").alias("_y")).where("_y = 1")
    return each.agg(F.avg((F.col("_r") <= k).cast("double")).alias("accuracy"))


def folds(labeled: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """ML08: rows with a fold; a video's rows stay together. Videos are dealt over the folds in the order of their labels' counts, so that folds get like shares."""
    sizes = labeled.groupBy("vid").agg(F.max("labels").alias("_l"), F.count("*").alias("_n"))
    turn = F.row_number().over(Window.partitionBy("_l").orderBy(F.desc("_n"), F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("vid").cast("string")))))
    dealt = sizes.withColumn("fold", (turn + F.abs(F.xxhash64("_l")) % n) % n)
    return labeled.join(dealt.select("vid", "fold"), "vid")


def evaluable(labeled: DataFrame, n_splits: int) -> bool:
    """ML08: whether there are more classes and more rows than folds."""
    classes, rows = labeled.agg(F.countDistinct("labels"), F.count("*")).first()
    return classes > n_splits and rows > n_splits


def cross_validated(labeled: DataFrame, n_splits: int = 3, threshold: float = 0.4) -> DataFrame | None:
    """ML08, AG08: medians of the metrics over folds; None if they can't be taken. The rows with their folds are stored, as training and scoring read them many times."""
    rows, out = stored(folds(labeled, n_splits), "folds"), None
    if not evaluable(rows, n_splits):
        return None
    for k in range(n_splits):
        train, test = rows.where(F.col("fold") != k), rows.where(F.col("fold") == k)
        model, classes = fit_linear(train)
        scored = truth(infer(model, classes, test.drop("labels", "fold"), 0), test)
        one = metrics(scored, threshold)
        out = one if out is None else out.unionByName(one)
    return medians(out)


def medians(results: DataFrame) -> DataFrame:
    """AG08."""
    return results.agg(*[F.median(c).alias(c) for c in results.columns])


def fit_tuned(labeled: DataFrame, holdout: float = 0.2, seed: int = 0, least_rows: int = 10, **kw):
    """ML05: a classifier and the threshold of the best mean F1 on held-out videos' rows (on all rows if there are few); returns (model, classes, threshold)."""
    share = max(2, round(1 / holdout))
    parts = folds(labeled, share, seed)
    train, test = parts.where("fold <> 0").drop("fold"), parts.where("fold = 0").drop("fold")
    if labeled.limit(least_rows).count() < least_rows or test.isEmpty() or train.select("labels").distinct().count() < 2:
        train = test = labeled
    model, classes = fit_linear(train, **kw)
    scored = truth(infer(model, classes, test.drop("labels"), 0), test)
    return model, classes, float(best_threshold(scored).first()["threshold"])


def fit_cross_validated(labeled: DataFrame, grid: tuple[float, ...] = (1e-3, 1e-2, 1e-1), n_folds: int = 3, seed: int = 0):
    """ML14: a logistic regression on standardised vectors whose regularisation cross-validation chooses."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.feature import StandardScaler, StringIndexer
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    rows = vectorised(labeled.withColumn("label", F.element_at(L.pieces(F.col("labels")), 1)))
    lr = LogisticRegression(featuresCol="z", labelCol="y", family="multinomial", maxIter=30, probabilityCol="p")
    pipe = Pipeline(stages=[StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc"), StandardScaler(inputCol="x", outputCol="z", withMean=True), lr])
    judge = MulticlassClassificationEvaluator(labelCol="y", metricName="f1")
    best = CrossValidator(estimator=pipe, estimatorParamMaps=ParamGridBuilder().addGrid(lr.regParam, list(grid)).build(), evaluator=judge, numFolds=n_folds, seed=seed).fit(rows).bestModel
    return best, list(best.stages[0].labels)


def needs_training(models: DataFrame, annotations: DataFrame, feature_name: str, allow_stale: bool = True, least_labels: int = 15) -> bool:
    """ML12: whether a model has to be trained: there are labels enough, and no model of the feature yet, or newer labels than its and stale ones don't do."""
    n, newest = annotations.agg(F.count("*"), F.max("label_time")).first()
    made = models.where(F.col("feature_name") == feature_name).agg(F.max("creation_time")).first()[0]
    return n >= least_labels and (made is None or (not allow_stale and newest is not None and newest > made))


def predictions_of_all(features: DataFrame, stored: DataFrame, mid: int, run) -> DataFrame:
    """ML10, ML11: predictions of every video, made for those without any: one job, whatever their number."""
    return predicted(features, stored, mid, run)


def saved_results(results: DataFrame, path: str) -> None:
    """SNK06: results appended as Parquet."""
    results.write.mode("append").parquet(path)


def save_model(model, classes: list[str], path: str) -> None:
    """A fitted pipeline and its classes in order."""
    model.write().overwrite().save(f"{path}/model")
    SparkSession.active().createDataFrame(list(enumerate(classes)), "i int, label string").coalesce(1).write.mode("overwrite").parquet(f"{path}/classes")


def evaluated(labeled: DataFrame, path: str, threshold: float = 0.4) -> DataFrame:
    """ML17: the metrics of a saved model on labeled rows with vectors."""
    from pyspark.ml import PipelineModel

    classes = [r["label"] for r in labeled.sparkSession.read.parquet(f"{path}/classes").orderBy("i").collect()]  # one row a class
    return metrics(truth(infer(PipelineModel.load(f"{path}/model"), classes, labeled.drop("labels"), 0), labeled), threshold)
