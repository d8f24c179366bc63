"""Small helpers shared by the operators: clean columns, batches of texts, crc32 folds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_SPLIT = r"[\x20\x09-\x0D]+"
"""White space that ends a word."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, a null text read as empty; other columns, whatever their names, stay behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def fold(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % modulus


def chunks(batches: Iterator[pa.RecordBatch], limit: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches by bytes of text, so that a task's memory is one long text or ``limit`` bytes.

    The column ``text`` must be there. A single text above the limit passes as a batch of its own. Arrow's freed memory goes
    back to the system at the end, as the worker lives on.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(sizes):
            yield batch.slice(start)
        del batch
    pa.default_memory_pool().release_unused()


def filter_by_text(docs: DataFrame, judge: Callable[[], Callable[[list[str]], np.ndarray]]) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text passes; null texts are judged as empty.

    ``judge`` is called once in each task and returns the function that marks a list of texts.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = judge()
        for batch in chunks(batches, 1 << 20):
            yield batch.filter(pa.array(passes([t or "" for t in batch.column("text").to_pylist()]), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
