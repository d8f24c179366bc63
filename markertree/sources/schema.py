"""Canonical tables. Feature names are data, never schema, in the long form."""

from __future__ import annotations

from pyspark.sql import types as T

LONG = T.StructType([
    T.StructField("batch", T.StringType()),
    T.StructField("cell_id", T.StringType()),
    T.StructField("feature", T.StringType()),
    T.StructField("value", T.DoubleType()),
])

FEATURES = T.StructType([
    T.StructField("feature", T.StringType()),
    T.StructField("feature_type", T.StringType()),
])

LABELS = T.StructType([
    T.StructField("cell_id", T.StringType()),
    T.StructField("label", T.StringType()),
])

TRIPLETS = T.StructType([
    T.StructField("view", T.StringType()),
    T.StructField("row", T.LongType()),
    T.StructField("col", T.LongType()),
    T.StructField("value", T.DoubleType()),
])

NODES = T.StructType([
    T.StructField("batch", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("depth", T.IntegerType()),
    T.StructField("key", T.ArrayType(T.StringType())),
    T.StructField("status", T.StringType()),
    T.StructField("stop", T.StringType()),
    T.StructField("n", T.LongType()),
    T.StructField("weight", T.DoubleType()),
    T.StructField("ll", T.DoubleType()),
    T.StructField("bic", T.DoubleType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("dominant", T.StringType()),
    T.StructField("n_left", T.LongType()),
    T.StructField("n_right", T.LongType()),
    T.StructField("mean_left", T.ArrayType(T.DoubleType())),
    T.StructField("mean_right", T.ArrayType(T.DoubleType())),
    T.StructField("rule", T.StringType()),
    T.StructField("scores", T.MapType(T.StringType(), T.DoubleType())),
])
