"""Experiment logs as tables. Lines come as (file, line_no, line); the step of a line is that of the last step header before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines(spark, path: str) -> DataFrame:
    """Lines of text files with their order: files are read whole, one row each, so a log's lines stay together."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("at", "line"))
    return whole.select("file", (F.col("at") + 1).alias("line_no"), "line")


def _grab(pattern: str, column: str = "line") -> Column:
    return F.nullif(F.regexp_extract(column, pattern, 1), F.lit(""))


def stepped(log: DataFrame) -> DataFrame:
    """SRC09: lines with their step (null before the first), whether the arguments were read, and whether an evaluation is open."""
    w = Window.partitionBy("file").orderBy("line_no")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    step = F.last(_grab(r"^\*\*\* Step (\d+)").cast("int"), ignorenulls=True).over(upto)
    opened = F.when(F.col("line").contains("*** Evaluating labels"), 1).when(F.col("line").contains("*** Performance"), 0)
    return log.withColumns({"step": step, "past_setup": F.coalesce(F.max(F.col("line").startswith("Args").cast("int")).over(before), F.lit(0)) == 1, "in_eval": F.coalesce(F.last(opened, ignorenulls=True).over(before), F.lit(0)) == 1})


def setup_values(log: DataFrame) -> DataFrame:
    """key=value lines before the arguments, quotes dropped, and the arguments' own options with one value."""
    s = stepped(log)
    plain = s.where(~F.col("past_setup") & F.col("line").contains("=") & ~F.col("line").contains("===") & ~F.col("line").startswith("Args"))
    plain = plain.select("file", F.substring_index("line", "=", 1).alias("key"), F.regexp_replace(F.expr("substring(line, instr(line, '=') + 1)"), '"', "").alias("value"))
    args = F.from_json(F.translate(F.regexp_replace("line", r"^Args: ", ""), "'", '"'), "array<string>")
    given = s.where(F.col("line").startswith("Args")).select("file", F.posexplode(args).alias("i", "v"), args.alias("all"))
    value = F.try_element_at("all", F.col("i") + 2)
    given = given.where(F.col("v").startswith("--") & value.isNotNull() & ~value.startswith("--"))
    return plain.unionByName(given.select("file", F.expr("replace(substring(v, 3), '-', '')").alias("key"), value.alias("value")))


def _performance(log: DataFrame) -> DataFrame:
    """(file, step, key, value) of performance lines inside evaluations; nan is -1."""
    s = stepped(log).where("in_eval and step is not null").where(F.col("line").contains("*** Performance {"))
    text = F.regexp_replace(F.translate(F.regexp_replace(F.regexp_replace("line", r"^.*\*\*\* Performance ", ""), "person's", "persons"), "'", '"'), r"\bnan\b", "-1")
    return s.select("file", "step", F.explode(F.from_json(text, "map<string,double>")).alias("key", "value"))


def label_precisions(log: DataFrame) -> DataFrame:
    """Average precision of each label and step."""
    p = _performance(log).withColumn("label", _grab(r"^[^_]*_avgprecision_(.*)$", "key"))
    return p.where("label is not null").select("file", "step", "label", F.col("value").alias("ap"))


def label_f1(log: DataFrame) -> DataFrame:
    p = _performance(log).withColumn("label", _grab(r"^pred_ml_f1_score_(.*)$", "key"))
    return p.where("label is not null and label not like '%macro%' and label not like '%micro%'").select("file", "step", "label", F.col("value").alias("f1"))


def aggregate_results(log: DataFrame) -> DataFrame:
    """mAP and macro F1 of each step."""
    p = _performance(log)
    pick = lambda k: F.max(F.when(F.col("key") == k, F.col("value")))
    return p.groupBy("file", "step").agg(pick("pred_mAP").alias("map"), pick("pred_ml_f1_score_macro").alias("f1_macro"))


def label_totals(log: DataFrame) -> DataFrame:
    """Training labels of each step, from the first such line of an evaluation; labels without any are left out."""
    s = stepped(log).where("in_eval and step is not null").where(F.col("line").contains("y_train (len="))
    first = s.withColumn("_n", F.row_number().over(Window.partitionBy("file", "step").orderBy("line_no"))).where("_n = 1")
    text = F.translate(F.regexp_extract("line", r"y_train[^\[]*(\[.*\])", 1), "()'", '[]"')
    pairs = F.from_json(text, "array<array<string>>")
    return first.select("file", "step", F.explode(pairs).alias("p")).select("file", "step", F.col("p")[0].alias("label"), F.col("p")[1].cast("int").alias("n")).where("n > 0")


def step_values(log: DataFrame) -> DataFrame:
    """One row a step: seconds that explore took, feature, training size, evaluated rows, thresholds."""
    s = stepped(log).where("step is not null")
    inside = lambda pattern: F.last(F.when(F.col("in_eval"), _grab(pattern)), ignorenulls=True)
    return s.groupBy("file", "step").agg(
        F.max(_grab(r"explore took ([\d.]+) seconds").cast("double")).alias("explore_seconds"),
        F.max(_grab(r"multifeature explore: explore \(feature \['(.*)'\]")).alias("feature"),
        F.max(F.when(F.col("in_eval"), _grab(r"Training set size (\d+)").cast("int"))).alias("training_size"),
        F.max(F.when(F.col("in_eval"), _grab(r"Results for split pred \(len=(\d+)\)").cast("int"))).alias("eval_size"),
        F.max(F.when(F.col("in_eval"), _grab(r"multilabel_threshold=([\d.]+);").cast("double"))).alias("f1_threshold"),
        F.max(F.when(F.col("in_eval"), _grab(r"best on split=([\d.]+)").cast("double"))).alias("best_threshold"),
    )


def durations(log: DataFrame, begin: str, end: str, time: str = r"^(\d+(?:\.\d+)?) ") -> DataFrame:
    """SRC10: seconds between a line that matches `begin` and the next that matches `end`, lines starting with a time in seconds."""
    w = Window.partitionBy("file").orderBy("line_no")
    marks = log.withColumn("_at", _grab(time).cast("double")).withColumn("_kind", F.when(F.col("line").rlike(begin), "b").when(F.col("line").rlike(end), "e")).where("_kind is not null")
    paired = marks.withColumn("_prev", F.lag("_kind").over(w)).withColumn("_from", F.lag("_at").over(w))
    return paired.where("_kind = 'e' and _prev = 'b'").select("file", "line_no", (F.col("_at") - F.col("_from")).alias("seconds"))


def throughput(log: DataFrame) -> DataFrame:
    """SRC11: fields of result lines."""
    r = log.where(F.col("line").startswith("Results: {"))
    field = lambda k: _grab(rf"{k}: ([^|}}]*?) *[|}}]")
    return r.select("file", field("dataset_name").alias("dataset"), field("feature_name").alias("feature"), field("nworkers").cast("int").alias("nworkers"), field("npipe").cast("int").alias("npipe"), field("vidtime").cast("double").alias("vidtime"))


def feature_costs(results: DataFrame, dataset: str, nworkers: int = 4, npipe: int = 2) -> DataFrame:
    """AG10: mean seconds of each feature."""
    return results.where((F.col("dataset") == dataset) & (F.col("nworkers") == nworkers) & (F.col("npipe") == npipe)).groupBy("feature").agg(F.avg("vidtime").alias("cost"))


def bandit_series(log: DataFrame) -> DataFrame:
    """SRC12: the candidates' series printed before pruning: feature, y_k, w_k, u_k, l_k."""
    array = lambda k: F.from_json(F.regexp_extract("line", rf"{k}=(\[[^\]]*\])", 1), "array<double>").alias(k)
    return log.where(F.col("line").rlike(r"y_k=\[")).select("file", "line_no", F.trim(F.regexp_extract("line", r"([^ ]+): y_k=", 1)).alias("feature"), *map(array, ("y_k", "w_k", "u_k", "l_k")))


def piped(rows: DataFrame, schema: str) -> DataFrame:
    """SRC08: lines (column `value`) of a headerless file with | between fields."""
    return rows.select(F.from_csv("value", schema, {"sep": "|"}).alias("x")).select("x.*")


def fixed_up(experiments: DataFrame) -> DataFrame:
    """DML16: 'suspend' dropped from conditions, a missing oracle is exact."""
    return experiments.withColumns({"condition": F.expr("replace(condition, 'suspend', '')"), "oracle": F.coalesce("oracle", F.lit("exact"))})
