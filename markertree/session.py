"""Session helpers: local session for tests, and shared-folder materialisation."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("markertree")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("MARKERTREE_DRIVER_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder for written intermediates: the cluster's ``spark.checkpoint.dir``.

    Only a local master, where driver and executors share one disk, may fall
    back to a temporary folder when the setting is absent.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    folder = tempfile.mkdtemp(prefix="markertree-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage by writing ``df`` to the shared folder and reading it back.

    A written parquet table survives the loss of executors, keeps column pruning
    and gives the optimizer real sizes.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/markertree-{uuid.uuid4().hex}"
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._stored_at = path
    return stored


def discard(df: DataFrame) -> None:
    """Delete the folder behind a table that ``materialize`` returned, once nothing reads it any more."""
    path = getattr(df, "_stored_at", None)
    if path:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)


def sized(df: DataFrame) -> DataFrame:
    """Store a table of group statistics so that joins against it are planned from its real size.

    An unfinished aggregate has no size when the plan is made, so a join with it shuffles the large side first.
    Read back from the shared folder, it is broadcast when it is under ``spark.sql.autoBroadcastJoinThreshold``
    and merge-joined (with skew splitting) when it is not.
    """
    return materialize(df)


# What a task may hold of a table that it looks rows up in, as measured: short rows, so rows and stored bytes are both bounded.
LOOKUP_ROWS = 4_000_000
LOOKUP_BYTES = 64 << 20


def lookup(df: DataFrame) -> DataFrame:
    """Store a table of one short row a cell or feature for joins with a table of entries.

    It is sent to the tasks while it is measured to be small, above the session's threshold too, so that the many more entries need
    not be shuffled and sorted for it. A larger one is joined as any other table.
    """
    from pyspark.sql import functions as F

    stored = materialize(df)
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(stored._stored_at)
    if folder.getFileSystem(conf).getContentSummary(folder).getLength() > LOOKUP_BYTES or stored.count() > LOOKUP_ROWS:
        return stored
    return F.broadcast(stored)


def spread(df: DataFrame) -> DataFrame:
    """Spread an input that has fewer splits than the cluster has cores; larger inputs pass untouched.

    Meant for narrow scans before costly row work (one big file with a single row group, say).
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


# A table may be broadcast with a hint only when its row count is bounded by
# construction (nodes, components, selected features), never by hope.
BROADCAST_ROW_LIMIT = 200_000


def bounded_rows(df: DataFrame, limit: int = BROADCAST_ROW_LIMIT) -> list:
    """Collect a table that is small by construction, and fail loudly if it is not.

    A plain collect runs all its tasks side by side; ``spark.driver.maxResultSize`` guards the driver.
    """
    rows = df.collect()
    if len(rows) > limit:
        raise ValueError(f"table expected to hold at most {limit} rows has {len(rows)}")
    return rows


def attach_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate to every row, as a scalar subquery (no join)."""
    from pyspark.sql import functions as F

    packed = one.select(F.struct(*one.columns).alias("_row")).scalar()
    with_row = df.withColumn("_row", packed)
    return with_row.select(*df.columns, *[F.col(f"_row.{c}").alias(c) for c in one.columns])
