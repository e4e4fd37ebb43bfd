"""Choosing a feature by a rising bandit: series of scores by feature_name and t, in columns y, then l, w and u."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIG = 1e6


def _series(scores: DataFrame) -> DataFrame:
    return scores.groupBy("feature_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "y"))), lambda x: x["y"]).alias("y"))


def _unrolled(rows: DataFrame, *names: str) -> DataFrame:
    return rows.select("feature_name", F.posexplode(F.arrays_zip(*names)).alias("_i", "_v")).select("feature_name", (F.col("_i") + 1).alias("t"), *[F.col(f"_v.{n}").alias(n) for n in names])


def moving_average(scores: DataFrame, window: int) -> DataFrame:
    """BD03: mean of up to `window` earlier scores, the present one left out; the first score is its own."""
    w = Window.partitionBy("feature_name").orderBy("t")
    return scores.withColumn("l", F.coalesce(F.avg("y").over(w.rowsBetween(-window, -1)), F.col("y")))


def _ewma(y: Column, alpha: float, factor: Column | None = None) -> Column:
    """Running averages; with factor each is multiplied by it (not below 0) before the next builds on it."""
    adjust = (lambda v: v) if factor is None else (lambda v: F.greatest(factor * v, F.lit(0.0)))
    first = F.array(adjust(F.element_at(y, 1)))
    rest = F.slice(y, F.lit(2), F.greatest(F.lit(0), F.size(y) - 1))
    return F.aggregate(rest, first, lambda acc, v: F.concat(acc, F.array(adjust((1 - alpha) * F.element_at(acc, -1) + alpha * v))))


def ewma(scores: DataFrame, window: int) -> DataFrame:
    """BD04: l_1 = y_1, l_t = (1 - a) l_(t-1) + a y_t with a = 2 / (window + 1)."""
    return _unrolled(_series(scores).withColumn("l", _ewma(F.col("y"), 2.0 / (window + 1))), "y", "l")


def cost_normalised(scores: DataFrame, costs: DataFrame, window: int, weight: float) -> DataFrame:
    """BD05: as BD04, but features that cost more than the cheapest lose (cost / cheapest) / 2 * weight of each average."""
    cheapest = F.broadcast(costs.agg(F.min("cost").alias("_least")))  # one row
    rel = costs.crossJoin(cheapest).select("feature_name", (F.col("cost") / F.col("_least")).alias("_c"))
    rows = _series(scores).join(rel, "feature_name")
    factor = F.when(F.col("_c") > 1, 1 - F.col("_c") / 2 * weight).otherwise(F.lit(1.0))
    plain, cut = _ewma(F.col("y"), 2.0 / (window + 1)), _ewma(F.col("y"), 2.0 / (window + 1), factor)
    return _unrolled(rows.withColumn("l", F.when(F.col("_c") > 1, cut).otherwise(plain)), "y", "l")


def growth(l: Column, c: int) -> Column:  # noqa: E741
    """BD02: growth a step of the last value over that `c` steps before, or over the nearest earlier one that isn't larger (0 at the start if none);
    1e6 while the series is too short, or if both are 0."""
    n = F.size(l)
    last = F.element_at(l, -1)
    places = F.sequence(n - c, F.lit(1), F.lit(-1))
    fit = F.filter(places, lambda i: F.element_at(l, i.cast("int")) <= last)
    at = F.coalesce(F.try_element_at(fit, F.lit(1)), F.lit(0))
    base = F.when(at > 0, F.try_element_at(l, F.greatest(at, F.lit(1)))).otherwise(F.lit(0.0))
    span = F.when(at > 0, n - at).otherwise(n - 1)
    rate = F.try_divide(last - base, span)
    return F.when(n - c < 1, F.lit(BIG)).when((base == 0) & (last == 0), F.lit(BIG)).when(rate >= 0, rate).otherwise(F.lit(BIG))


def bounds(lower: DataFrame, c: int, horizon: int) -> DataFrame:
    """BD01: the latest l, w and u of each feature: u = min(l + w (T - t), 1), T - t at least 1."""
    series = lower.groupBy("feature_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "l"))), lambda x: x["l"]).alias("_l"), F.max("t").alias("t"))
    out = series.select("feature_name", "t", F.element_at("_l", -1).alias("l"), growth(F.col("_l"), c).alias("w"))
    return out.withColumn("u", F.least(F.col("l") + F.col("w") * F.greatest(F.lit(horizon) - F.col("t"), F.lit(1)), F.lit(1.0)))


def survivors(state: DataFrame) -> DataFrame:
    """BD01: candidates left after a step: one goes if another's lower bound reaches its upper bound. Features are few, one row each. Of equals that
    would remove each other the first by name stays, so some candidate always does."""
    top = state.orderBy(F.desc("l"), "feature_name").limit(1).select(F.col("l").alias("_top"), F.col("feature_name").alias("_best"))
    kept = state.crossJoin(F.broadcast(top)).where((F.col("t") <= 2) | (F.col("feature_name") == F.col("_best")) | (F.col("_top") < F.col("u")))
    return kept.drop("_top", "_best")


def best(results: DataFrame) -> DataFrame:
    """BD06: the feature of the largest latest test mAP."""
    latest = results.groupBy("feature_name").agg(F.max_by("y", "t").alias("score"))
    return latest.agg(F.max_by("feature_name", F.struct("score", "feature_name")).alias("feature_name"), F.max("score").alias("score"))


def cutoff(budget: int, model_seconds: float, user_seconds: float) -> int:
    """BD08: labels after which training has to start to be ready in time."""
    return budget - -(-int(model_seconds * 1000) // max(1, int(user_seconds * 1000)))


def train_starts(budgets: DataFrame, user: DataFrame, model: DataFrame, keys: list[str]) -> DataFrame:
    """BD08 for sessions (keys): how many clips are still to be labelled when training starts. budgets has the clips of a round (`budget`), user and model a row a time taken
    (`seconds`). ceil(median model time / median label time) clips before the end; -1 if that is the whole round or more, so training uses the last round's labels;
    1 where no time is known yet, or labels take none."""
    mid = lambda rows, name: rows.groupBy(*keys).agg(F.median("seconds").alias(name))
    both = budgets.join(mid(user, "_u"), keys, "left").join(mid(model, "_m"), keys, "left")
    n = F.ceil(F.col("_m") / F.col("_u"))
    start = F.when(F.coalesce(F.col("_u"), F.lit(0.0)) <= 0, 1).when(F.col("_m").isNull(), 1).when(n < F.col("budget"), n).otherwise(-1)
    return both.select(*keys, start.cast("bigint").alias("train_start"))


def eliminations(series: DataFrame, keys: list[str]) -> DataFrame:
    """BD07: when each feature of an experiment (keys) goes, (*keys, feature_name, step), from full series of lower and upper bounds: rows
    (*keys, feature_name, l, u), l and u arrays over steps counted from 0.

    From step 2 on, a feature goes if the lower bound of another one that was left at the step's start reaches its upper bound; the fold ends at a step that
    starts with one feature. Features left at the start of the last step looked at have a further row at the number of steps + 1, even if that step removes them. Series have the
    length of that of the first feature by name; experiments of at most two steps have no rows. One row an experiment is folded, its features are few."""
    both = series.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("feature_name", F.struct("l", "u")))).alias("_b"), F.sort_array(F.collect_list("feature_name")).alias("_f"))
    bound = lambda f, which, i: F.get(F.element_at("_b", f)[which], i)
    n = F.size(F.element_at("_b", F.get("_f", F.lit(0)))["l"])

    def step(state: Column, i: Column) -> Column:
        left = state["left"]
        gone = F.filter(left, lambda f: F.exists(left, lambda g: (g != f) & (bound(g, "l", i) >= bound(f, "u", i))))
        log = F.concat(state["log"], F.transform(gone, lambda f: F.struct(f.alias("feature_name"), i.alias("step"))))
        new = F.struct(F.array_except(left, gone).alias("left"), left.alias("start"), log.alias("log"), (F.size(left) == 1).alias("done"))
        return F.when(state["done"], state).otherwise(new)

    rows = both.where(n > 2).withColumn("_n", n)
    empty = F.array().cast("array<struct<feature_name:string,step:int>>")
    start = F.struct(F.col("_f").alias("left"), F.col("_f").alias("start"), empty.alias("log"), F.lit(False).alias("done"))
    end = rows.withColumn("_s", F.aggregate(F.sequence(F.lit(2), F.col("_n") - 1), start, step))
    last = F.transform(F.col("_s.start"), lambda f: F.struct(f.alias("feature_name"), (F.col("_n") + 1).alias("step")))
    return end.select(*keys, F.explode(F.concat("_s.log", last)).alias("_e")).select(*keys, "_e.feature_name", "_e.step")


def eliminated(series: DataFrame, keys: list[str]) -> DataFrame:
    """BD07 for series that end where their feature went: features with fewer steps than the longest series went at their length; among the others, by name,
    each that is still left removes those whose last upper bound its last lower bound reaches. If one feature is left, it has a row at the longest length + 1; an
    experiment that doesn't come down to one has no rows. rows: (*keys, feature_name, l, u)."""
    sized = series.withColumn("_n", F.size("l"))
    both = sized.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("feature_name", F.col("_n").alias("n"), F.element_at("l", -1).alias("l"), F.element_at("u", -1).alias("u")))).alias("_f"), F.max("_n").alias("_m"))
    long = F.filter("_f", lambda f: f["n"] == F.col("_m"))

    def turn(left: Column, f: Column) -> Column:
        # a candidate that was removed earlier removes nobody
        inside = F.exists(left, lambda g: g["feature_name"] == f["feature_name"])
        return F.when(inside, F.filter(left, lambda g: (g["feature_name"] == f["feature_name"]) | ~(f["l"] >= g["u"]))).otherwise(left)

    rows = both.withColumn("_long", long).withColumn("_left", F.aggregate("_long", F.col("_long"), turn)).where(F.size("_left") == 1)
    winner = F.get("_left", F.lit(0))["feature_name"]
    step = F.when(F.col("f.feature_name") == F.col("_winner"), F.col("_m") + 1).otherwise(F.col("f.n"))
    return rows.select(*keys, "_m", winner.alias("_winner"), F.explode("_f").alias("f")).select(*keys, "f.feature_name", step.alias("step"))
