"""The given star-schema tables in canonical form: marker tables, count matrices, embeddings."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markertree.session import materialize, spread

MARKERS = ["qty", "price", "disc", "tax"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense marker table with batches, one row per order line."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_returnflag").alias("batch"),
        F.concat_ws(
            "-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
            F.round(F.col("l_extendedprice") * 100).cast("bigint"), F.date_format("l_shipdate", "yyyyMMdd"),
        ).alias("cell_id"),
        F.col("l_quantity").alias("qty"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("disc"),
        F.col("l_tax").alias("tax"),
    )


def line_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_cells(spark, sf_dir).unpivot(["batch", "cell_id"], MARKERS, "feature", "value")


def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count matrix: cell = user, feature = event type."""
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("user_id").cast("string").alias("cell_id"), F.col("event_type").alias("feature"))
        .agg(F.count(F.lit(1)).cast("double").alias("value"))
    )


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse wide matrix: cell = document, feature = lower-cased letter run, batch = source."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("batch"), F.col("doc_id").cast("string").alias("cell_id"), "text")
    # texts move once, to their cell; their many more entries are counted, summed and normalised there. The number is given, as
    # adaptive execution would join partitions by the size of the texts, not of their entries
    words = docs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "cell_id").select(
        "batch", "cell_id", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("feature"),
    ).filter(F.col("feature") != "")
    return words.groupBy("batch", "cell_id", "feature").agg(F.count(F.lit(1)).cast("double").alias("value"))


def embedding_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as double arrays."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id"), F.col("label"), F.col("embedding").cast("array<double>").alias("x")
    )


LETTERS = ["e", "a", "n", "o"]
ACCENTS = "éèêàçñáíóúüöäß"
DOC_MARKERS = [f"share_{c}" for c in LETTERS] + ["share_accent", "log_chars"]


def document_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense marker table with real modes: letter shares of whole texts, three batches, language as truth."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")).withColumn("text", F.lower("text"))
    n = F.length("text")
    share = lambda count: count / F.greatest(n, F.lit(1))
    letter = lambda c: n - F.length(F.replace("text", F.lit(c), F.lit("")))
    return docs.select(
        F.concat(F.lit("b"), (F.col("doc_id") % 3).cast("string")).alias("batch"),
        F.col("doc_id").cast("string").alias("cell_id"), "lang",
        *[share(letter(c)).alias(f"share_{c}") for c in LETTERS],
        share(F.regexp_count("text", F.lit(f"[{ACCENTS}]"))).alias("share_accent"), F.log1p(n).alias("log_chars"),
    )


def document_expression(spark: SparkSession, sf_dir: str, min_cells: int = 10) -> DataFrame:
    """Depth-normalised log token counts over tokens seen in at least ``min_cells`` documents, batched like the markers.

    Texts are cut into tokens once: the counts are stored, for the choice of tokens, the depths and the values to read.
    """
    from markertree.operators.normalize import log_transform, scale_to_depth
    from markertree.operators.qc import features_in_cells

    tokens = features_in_cells(materialize(token_counts(spark, sf_dir).drop("batch")), min_cells)
    logged = log_transform(scale_to_depth(tokens))
    return logged.select(
        F.concat(F.lit("b"), (F.col("cell_id").cast("bigint") % 3).cast("string")).alias("batch"), "cell_id", "feature", "value")


def packed_documents(spark: SparkSession, sf_dir: str, top: int = 300) -> tuple[DataFrame, list[str]]:
    """Documents as packed rows over their most variable tokens (a top-n feature selection)."""
    from markertree.operators.features import variable_features
    from markertree.operators.linear import feature_index, pack_rows

    long = materialize(document_expression(spark, sf_dir))
    cells = document_markers(spark, sf_dir).select("batch", "cell_id", "lang")
    chosen = feature_index(variable_features(long, cells, top=top, min_disp=None).select("feature"))
    return pack_rows(long.select("cell_id", "feature", "value"), cells, chosen), chosen
