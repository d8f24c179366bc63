"""Streams of cells scored against a frozen tree, and leaf counts over event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markertree.operators.linear import sparse_dot
from markertree.plans.consensus import ConsensusTree, descend
from markertree.plans.tree import Tree


def read_cells(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def score_cells(cells: DataFrame, tree: Tree, column: str = "path") -> DataFrame:
    """Leaf path of each arriving cell. Stateless: the same expression as in batch."""
    return tree.assign(cells, column)


def score_projection(cells: DataFrame, weights: list[float], low: float, high: float, idx: str = "idx", val: str = "val") -> DataFrame:
    """Project packed expression rows on a stored direction and cut; features travel inside the row, so no state is needed."""
    scored = cells.withColumn("h", sparse_dot(idx, val, weights))
    return scored.withColumn("side", F.when(F.col("h") < low, "L").when(F.col("h") > high, "R"))


def frozen_model(tree: ConsensusTree) -> Tree:
    """The stored directions as a tree of its own, for batches that the stored tree has not met: each is cut midway between its centres."""
    frozen = Tree()
    for path in sorted(tree.weights, key=lambda p: (len(p), p)):
        if path in frozen.nodes:  # below a node without a direction nothing can be placed
            m = tree.weights[path]
            ids = sorted(m["w"])
            middle = (m["m0"] + m["m1"]) / 2
            frozen.split(path, {"kind": "projection", "idx": ids, "w": [m["w"][i] for i in ids], "cuts": [middle, middle]})
    return frozen


def score_stored(cells: DataFrame, tree: ConsensusTree) -> DataFrame:
    """Leaf of each arriving packed cell (batch, idx, val, markers) under a stored tree: project, cut, descend.

    Stateless, as features travel inside the row: a stream gives what the batch gives, in whatever order its files arrive. Adds ``path``
    and ``stuck`` (between the cuts of its node, where it stays). Unmet and null batches follow ``frozen_model``.
    """
    return descend(cells, tree.batches, default=frozen_model(tree))


def leaf_counts(scored: DataFrame, time: str, leaf: str, window: str = "1 day", late: str = "1 hour", by: list[str] = ()) -> DataFrame:
    """Cells per window and leaf; the watermark lets closed windows leave the state."""
    scored = scored.withColumn(time, F.col(time).cast("timestamp"))
    stream = scored.withWatermark(time, late) if scored.isStreaming else scored
    return stream.groupBy(F.window(time, window), *by, leaf).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("window.start").alias("window_start"), *by, leaf, "n")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Drain what has arrived into a parquet table and stop.

    Of an aggregate with a watermark only closed windows are written, each once: those that end at or before the latest time seen less the
    allowed lateness. Open ones stay in the state under ``checkpoint``, from which the next call goes on.
    """
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).option(
        "path", path).trigger(availableNow=True).start()
    query.awaitTermination()


def run_updates(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Drain an aggregating stream: every micro-batch appends the groups it changed, tagged with its number."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch_number", F.lit(number)).write.mode("append").parquet(path)

    query = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(
        availableNow=True).foreachBatch(write).start()
    query.awaitTermination()


def latest_counts(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Current value of every group from the tagged updates."""
    return updates.groupBy(*keys).agg(F.max_by("n", "batch_number").alias("n"))
