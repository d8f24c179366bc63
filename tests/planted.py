"""Planted data from ranges and hashes; never stored."""

from pyspark.sql import functions as F

from markertree.functions.stats import hashed_normal


def four_types(spark, n=12000, partitions=4):
    """Markers a, b, c: a splits first, then b inside a-high and c inside a-low. Truth 0..3."""
    t = F.pmod(F.xxhash64("id"), F.lit(10))
    d = spark.range(0, n, 1, partitions).withColumn("truth", F.when(t < 3, 0).when(t < 5, 1).when(t < 8, 2).otherwise(3))
    level = lambda cond: F.when(cond, 3.0).otherwise(-3.0)
    return d.select(
        F.col("id").cast("string").alias("cell_id"), "truth",
        (level(F.col("truth") >= 2) + hashed_normal(1, "id")).alias("a"),
        (level(F.col("truth") == 3) + hashed_normal(2, "id")).alias("b"),
        (level(F.col("truth") == 1) + hashed_normal(3, "id")).alias("c"))


def three_batches(spark, n=4500):
    """Two binary programs in markers m1, m2 and in genes; batch b2 lacks m1."""
    d = spark.range(0, n, 1, 4).withColumn("batch", F.concat(F.lit("b"), (F.col("id") % 3).cast("string"))).withColumn(
        "t", F.pmod(F.xxhash64("id"), F.lit(4)).cast("int"))
    hi, hi2 = F.col("t") >= 2, F.col("t") % 2 == 1
    key = F.col("id").cast("string").alias("cell_id")
    cells = d.select(
        "batch", key, "t",
        F.when(F.col("batch") != "b2", F.when(hi, 3.0).otherwise(-3.0) + hashed_normal(1, "id")).alias("m1"),
        (F.when(hi2, 3.0).otherwise(-3.0) + hashed_normal(2, "id")).alias("m2"), hashed_normal(3, "id").alias("m3"))
    g = d.select("batch", key, "t", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("g"))
    base = F.when((F.col("g") < 10) & hi, 1.5).when((F.col("g") >= 10) & (F.col("g") < 20) & hi2, 1.5).otherwise(0.5)
    value = F.greatest(base + hashed_normal(5, "cell_id", "g") * 0.7, F.lit(0.0))
    long = g.select("batch", "cell_id", F.concat(F.lit("g"), F.col("g").cast("string")).alias("feature"), value.alias("value")).filter("value > 0")
    return cells, long
