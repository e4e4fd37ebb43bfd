"""Video sources and sinks: metadata from CSV lines or folders, split files, and Parquet stores."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Subfolders that `text_files` deals files over.
FOLDERS = 64


def thumb_path(path: Column, folder: str) -> Column:
    """A video's thumbnail: its file name with .jpg in the folder."""
    return F.concat(F.lit(folder.rstrip("/") + "/"), F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", ""), F.lit(".jpg"))


def from_csv_lines(lines: DataFrame, thumbs: str) -> DataFrame:
    """SRC05: path,start,duration lines (column `value`)."""
    rows = lines.select(F.from_csv("value", "path string, start timestamp, duration double", {"mode": "FAILFAST"}).alias("x")).select("x.*")
    return rows.select(F.col("path").alias("vpath"), F.col("start").alias("vstart"), F.col("duration").alias("vduration"), thumb_path(F.col("path"), thumbs).alias("thumbpath"))


def from_csv(spark: SparkSession, path: str, thumbs: str) -> DataFrame:
    rows = spark.read.schema("path string, start timestamp, duration double").csv(path, header=True)
    return rows.select(F.col("path").alias("vpath"), F.col("start").alias("vstart"), F.col("duration").alias("vduration"), thumb_path(F.col("path"), thumbs).alias("thumbpath"))


def from_folder(spark: SparkSession, folder: str, thumbs: str, duration=None, pattern: str = "*.mp4") -> DataFrame:
    """SRC06: files of a tree, without start times; `duration` maps (path, content) columns to seconds, else null. Contents are read only if it is given."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    path = F.regexp_replace("path", "^file:", "")
    seconds = duration(F.col("path"), F.col("content")) if duration else F.lit(None).cast("double")
    return files.select(path.alias("vpath"), F.lit(None).cast("timestamp").alias("vstart"), seconds.alias("vduration"), thumb_path(path, thumbs).alias("thumbpath"))


def ingested(spark: SparkSession, folder: str, thumbs: str, vstart=None, duration=None, label=None, pattern: str = "*.mp4") -> tuple[DataFrame, DataFrame]:
    """DML15: (videos, labels) of a tree of files. The callables map (path, content) columns to a start time, a duration, and a label of the whole
    video; files without a label give none. Contents are read only where a callable asks for them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    path = F.regexp_replace("path", "^file:", "")
    of = lambda f, kind: (f(path, F.col("content")) if f else F.lit(None)).cast(kind)
    rows = files.select(path.alias("vpath"), of(vstart, "timestamp").alias("vstart"), of(duration, "double").alias("vduration"), thumb_path(path, thumbs).alias("thumbpath"), of(label, "string").alias("label"))
    return rows.drop("label"), rows.where("label is not null").select("vpath", F.lit(0.0).alias("start_time"), F.col("vduration").alias("end_time"), "label")


def readable(spark: SparkSession, path: str, schema) -> DataFrame:
    """SRC03: a Parquet folder without its unreadable files; nothing is deleted."""
    return spark.read.schema(schema).option("ignoreCorruptFiles", True).parquet(path)


def feature_folders(spark: SparkSession, root: str) -> DataFrame:
    """SRC02: names of stored features, from the partition folders."""
    return spark.read.parquet(root).select("feature_name").where("feature_name <> 'tmp'").distinct()


def vids_of_paths(videos: DataFrame, paths: DataFrame) -> DataFrame:
    """SRC07."""
    return videos.join(paths, "vpath", "left_semi").select("vid")


def split_vids(splits: DataFrame, name: str, split_type: str, idx: int, split: str) -> DataFrame:
    """SRC14."""
    one = splits.where((F.col("name") == name) & (F.col("split_type") == split_type) & (F.col("split_idx") == idx) & (F.col("split") == split))
    return one.select(F.explode("vids").alias("vid"))


def clip_path(base: str, vid: Column, start: Column, end: Column) -> Column:
    """SRC15: a dataset's clip file from its annotation."""
    return F.format_string(base.rstrip("/") + "/%s_%06d_%06d.mp4", vid.cast("string"), start.cast("int"), end.cast("int"))


def text_files(rows: DataFrame, folder: str) -> None:
    """A file vid=<vid>.txt for each vid with its lines in order; rows: (vid, line). In the machines' own file system the tasks write the files themselves, dealt by hash over
    subfolders: without native libraries Spark's writer starts a process for the rights of each file there, and files are listed by a task a folder. A file
    gets its name when it is whole, so a task may run again. Elsewhere Spark writes a folder for each vid."""
    at = urlsplit(folder)
    if at.scheme not in ("", "file"):
        return rows.repartition("vid").sortWithinPartitions("vid", "line").write.partitionBy("vid").text(folder)
    root = unquote(at.path) if at.scheme else folder

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, out, n = None, None, 0

        def close() -> None:
            if out:
                out.close()
                os.replace(out.name, f"{os.path.dirname(out.name)}/{name}.txt")

        for b in batches:
            for part, of, line in zip(b["part"], b["name"], b["line"], strict=True):
                if of != name:
                    close()
                    name, n = of, n + 1
                    os.makedirs(f"{root}/part={part}", exist_ok=True)
                    out = open(f"{root}/part={part}/.{name}.{uuid.uuid4().hex}", "w", encoding="utf-8", newline="")  # noqa: SIM115
                out.write(line + "\n")
        close()
        yield pd.DataFrame({"n": [n]})

    os.makedirs(root)
    name = F.concat(F.lit("vid="), F.coalesce(F.col("vid").cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")))
    named = rows.select(F.pmod(F.xxhash64("vid"), F.lit(FOLDERS)).alias("part"), name.alias("name"), F.coalesce("line", F.lit("")).alias("line"))
    named.repartition("name").sortWithinPartitions("name", "line").mapInPandas(write, "n long").agg(F.sum("n")).collect()  # a row


def export_csv(rows: DataFrame, path: str) -> None:
    """SNK04."""
    rows.dropDuplicates().write.mode("overwrite").option("header", True).csv(path)


def as_json(rows: DataFrame) -> DataFrame:
    """SNK07: rows as JSON, decimals as numbers, times as text."""
    cast = lambda f: F.col(f.name).cast("double") if f.dataType.typeName() == "decimal" else F.col(f.name).cast("string") if f.dataType.typeName().startswith("timestamp") else F.col(f.name)
    return rows.select(F.to_json(F.struct(*[cast(f).alias(f.name) for f in rows.schema])).alias("json"))


def missing_thumbnails(videos: DataFrame, files: DataFrame) -> DataFrame:
    """FLT14: videos whose thumbnail isn't among the files (column `path`)."""
    return videos.join(files.select(F.col("path").alias("thumbpath")), "thumbpath", "left_anti")
