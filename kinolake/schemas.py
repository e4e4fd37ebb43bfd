"""The tables of the engine as Spark schemas (DML01). Times inside a video are seconds, labels of one row an array."""

from __future__ import annotations

from pyspark.sql import types as T

SECONDS = T.DecimalType(18, 3)


_TYPES = {"bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "float": T.FloatType(), "string": T.StringType(), "timestamp": T.TimestampType()}


def _type(name: str) -> T.DataType:
    return T.ArrayType(_type(name[6:-1])) if name.startswith("array<") else _TYPES[name]


def _struct(fields: str) -> T.StructType:
    """From 'name type, ...', without a session."""
    return T.StructType([T.StructField(name, _type(kind)) for name, kind in (f.split(" ") for f in fields.split(", "))])


VIDEOS = _struct("vid bigint, vpath string, vstart timestamp, vduration double, thumbpath string")
ANNOTATIONS = _struct("aid bigint, vid bigint, start_time double, end_time double, label string, label_time timestamp")
SPLITS = _struct("name string, split_type string, split_idx bigint, split string, vids array<bigint>")
FEATURES = _struct("fid bigint, vid bigint, start_time double, end_time double, feature array<float>")
MODELS = _struct("mid bigint, model_type string, feature_name string, creation_time timestamp, batch_size int, epochs int, learningrate double, ntrain bigint, labels array<string>, model_path string, labels_path string, f1_threshold double")
PREDICTIONS = _struct("mid bigint, vid bigint, start_time double, end_time double, label string, probability double")
LABEL_PROGRESS = _struct("dataset string, feature string, split_type string, split_idx bigint, strategy string, budget double, experiment bigint, iteration bigint, fids array<bigint>")
LABEL_CSV = _struct("path string, start double, end double, label string")
VIDEO_CSV = _struct("path string, start timestamp, duration double")

#: Stored tables by name; a reset (DML12) writes the last three empty.
TABLES = {"video_metadata": VIDEOS, "dataset_splits": SPLITS, "annotations": ANNOTATIONS, "models": MODELS, "predictions": PREDICTIONS}
