"""Sources: delimited marker tables, sparse triplets, batches from files, count detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markertree.sources.schema import LABELS, TRIPLETS


def header_of(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    """Column names of a delimited file, from its first line only."""
    line = spark.read.text(path).limit(1).collect()
    return line[0][0].split(sep) if line else []


def read_marker_table(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Cell x marker file: first column is the cell id, the header names the markers.

    The schema is declared from the header, so no inference pass runs over the data.
    """
    names = header_of(spark, path, sep)
    markers = deduplicated(names[1:])
    schema = T.StructType(
        [T.StructField("cell_id", T.StringType())] + [T.StructField(m, T.DoubleType()) for m in markers]
    )
    return spark.read.csv(path, sep=sep, header=True, schema=schema, enforceSchema=True)


def read_transposed_table(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Feature x cell file as a long table; the long form is its own transpose."""
    names = header_of(spark, path, sep)
    cells = names[1:]
    schema = T.StructType(
        [T.StructField("feature", T.StringType())] + [T.StructField(c, T.DoubleType()) for c in cells]
    )
    wide = spark.read.csv(path, sep=sep, header=True, schema=schema, enforceSchema=True)
    return to_long(wide, ["feature"], cells, name="cell_id").select("cell_id", "feature", "value")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Headerless id,label file."""
    return spark.read.schema(LABELS).csv(path)


def read_views(spark: SparkSession, path: str, only_complete_rows: bool = False) -> DataFrame:
    """Sparse multi-view triplets; optionally only rows active in every view."""
    table = spark.read.schema(TRIPLETS).parquet(path)
    return complete_rows(table) if only_complete_rows else table


def complete_rows(triplets: DataFrame, view: str = "view", row: str = "row") -> DataFrame:
    """Keep rows that have a non-zero entry in every view."""
    active = triplets.filter(F.col("value") != 0).select(row, view).distinct()
    views = active.agg(F.countDistinct(view).alias("_views"))
    keep = active.groupBy(row).agg(F.count(F.lit(1)).alias("_n")).join(views, F.col("_n") == F.col("_views"))
    return triplets.join(keep.select(row), row, "left_semi")


def read_batches(spark: SparkSession, paths: list[str] | str, pattern: str = r"([^/]+)\.[^./]+$",
                 fmt: str = "parquet", **options) -> DataFrame:
    """Many files at once; the batch tag is taken from the file name."""
    df = spark.read.format(fmt).options(**options).load(paths)
    return df.withColumn("batch", F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))


def to_long(wide: DataFrame, ids: list[str], markers: list[str], name: str = "feature",
            value: str = "value") -> DataFrame:
    typed = wide.select(*ids, *[F.col(f"`{m}`").cast("double").alias(m) for m in markers])
    return typed.unpivot(ids, markers, name, value)


def to_wide(long: DataFrame, ids: list[str], features: list[str]) -> DataFrame:
    """Pivot with a declared feature list (no extra distinct pass)."""
    return long.groupBy(*ids).pivot("feature", features).agg(F.first("value"))


def split_by_type(long: DataFrame, features: DataFrame, feature_type: str) -> DataFrame:
    """Rows of one modality; the feature dimension decides, the optimizer sizes the join."""
    wanted = features.filter(F.col("feature_type") == feature_type).select("feature")
    return long.join(wanted, "feature", "left_semi")


def deduplicated(names: list[str]) -> list[str]:
    """Header names made unique with -1, -2, … suffixes (a file header, not data)."""
    seen: dict[str, int] = {}
    out = []
    for name in names:
        n = seen.get(name, 0)
        seen[name] = n + 1
        out.append(name if n == 0 else f"{name}-{n}")
    return out


def unique_feature_names(features: DataFrame, name: str = "feature", order: str = "ordinal") -> DataFrame:
    """Same rule on a feature dimension table: repeated names get their occurrence number."""
    nth = F.row_number().over(Window.partitionBy(name).orderBy(order)) - 1
    return features.withColumn("_nth", nth).withColumn(
        "unique_name",
        F.when(F.col("_nth") == 0, F.col(name)).otherwise(F.concat_ws("-", F.col(name), F.col("_nth").cast("string"))),
    ).drop("_nth")


def looks_raw(long: DataFrame, by: list[str]) -> DataFrame:
    """Per group: true when every value is a whole number, that is, counts not yet normalised."""
    return long.groupBy(*by).agg(
        F.bool_and(F.col("value") == F.rint("value")).alias("is_raw"),
        F.count(F.lit(1)).alias("n_values"),
    )
