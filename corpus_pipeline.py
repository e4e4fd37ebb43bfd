"""The corpus pipeline: language ID, near-duplicates, decontamination, mixing, token output.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents.

Rows with null or repeated doc_ids are kept like any others: the first and third stage decide row by row, the second tells rows apart by their place, the fourth by a hash of doc_id,
source and text. Reruns give equal rows. Empty tables give empty results. Extra columns may have any name.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinolake.llm.common import importable, partitions, scratch, stored, table
from kinolake.llm.decontaminate import SHORTEST, decontaminate
from kinolake.llm.language_id import language_id
from kinolake.llm.mixing import placed_rounds, row_key
from kinolake.llm.ngram_join import ngram_join
from kinolake.llm.token_output import token_output

#: A text whose language scores less than this, or that has none, is rejected.
LEAST_SCORE = 0.5


def packed(docs: DataFrame, *kept: str) -> tuple[DataFrame, list[Column]]:
    """(the kept columns under their names and all others in a struct `rest`, what selects the columns of docs from it again). Extra columns of any name, and any type,
    go through a stage in there, so none can clash with its own."""
    own = {c: docs[f"`{c}`"] for c in docs.columns}
    rest = [c for c in docs.columns if c not in kept]
    fields = [own[c].alias(f"c{i}") for i, c in enumerate(rest)] or [F.lit(0).alias("c0")]
    back = [F.col(c) if c in kept else F.col("rest")[f"c{rest.index(c)}"].alias(c) for c in docs.columns]
    return docs.select(*[own[c] for c in kept], F.struct(*fields).alias("rest")), back


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language with a score of LEAST_SCORE or more. Null texts have none. Extra columns of any name go through."""
    importable(spark)
    rows, back = packed(docs, "doc_id", "lang", "text")
    return language_id(rows, carry=True).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*back)


def numbered(docs: DataFrame) -> DataFrame:
    """docs (packed) with a number `row` of its own for each row: for rows of files the number of the file and the place in it, else stored with the rows."""
    spark = docs.sparkSession
    try:
        placed = docs.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
    except AnalysisException:  # not read from files
        return stored(docs.withColumn("row", F.monotonically_increasing_id()), "rows")
    files = sorted(r["file"] for r in placed.select("file").distinct().collect())  # names of files
    names = spark.createDataFrame([(f, i) for i, f in enumerate(files)] or [("", 0)], "file string, number bigint")
    return placed.join(F.broadcast(names), "file").select(*docs.columns, (F.shiftleft("number", 40) + F.col("place")).alias("row"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of the n-gram Jaccard join, the document with the smallest doc_id (nulls last), of several such rows the first by a hash of source and text, then by its
    place. Rows without words link with nothing and stay. Extra columns of any name and type go through."""
    importable(spark)
    rows, back = packed(docs, "doc_id", "source", "text")
    rows = numbered(rows)
    found = stored(ngram_join(rows.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "component_id"), "groups")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("source", "text").alias("hash"), "row")
    first = found.join(rows.select("row", order.alias("at")), "row").groupBy("component_id").agg(F.min("at")["row"].alias("row"))
    return rows.join(first.select("row"), "row", "left_semi").select(*back)


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Extra columns of any name go through."""
    importable(spark)
    rows, back = packed(docs, "doc_id", "text")
    return decontaminate(rows, table(spark, sf_dir, "benchmark"), shortest=SHORTEST, carry=True).where(~F.col("contaminated")).select(*back)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in the order of its schedule: a document once for each round in which its source's schedule takes it; where the schedule
    ends inside a document, the words taken, joined by single blanks. Documents that it never reaches go. Rows are dealt and sorted by slot. Extra columns of any name go through."""
    taken = placed_rounds(docs).select(F.col("tie").alias("key"), F.col("size").alias("size"), F.explode(F.array(*(F.struct(F.col(f"words{k}").alias("words"), F.col(f"slot{k}").alias("slot")) for k in (0, 1)))).alias("r"))
    taken = taken.select("key", "size", "r.words", "r.slot").where("words > 0")
    # rows equal in doc_id, source and text share a key; their rounds all take the text from the first of them
    known = [c for c in ("doc_id", "source", "text", "n_chars") if c in docs.columns]
    rows, back = packed(docs, *known)
    keyed = rows.withColumn("key", row_key(rows))
    numbers = [F.col("n_chars")] if "n_chars" in known else []
    one = keyed.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy(*numbers, F.to_json("rest")))).where("nth = 1").drop("nth")
    both = one.join(taken, "key")
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), F.col("words").cast("int")), " ")
    cut = both.withColumn("text", F.when(F.col("words") < F.col("size"), part).otherwise(F.col("text")))
    if numbers:
        cut = cut.withColumn("n_chars", F.when(F.col("words") < F.col("size"), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return cut.repartitionByRange(partitions(spark), "slot", "key").sortWithinPartitions("slot", "key").select(*back)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files of the mix, as read back: doc_id, start, n_tokens, ids_crc32."""
    importable(spark)
    return token_output(docs)


STAGES = [
    ("language_id", identify),
    ("ngram_join", near_duplicates),
    ("decontaminate", clean_of_benchmarks),
    ("mixing", mixed),
    ("token_output", tokens),
]

#: Language ID and token ids can't be expressed in SQL; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
