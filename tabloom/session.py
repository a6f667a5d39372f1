"""Session helpers: building a local session for tests/bench and finding the
shared checkpoint folder.

Library code never creates its own session; it receives one.  The only
session-level state the library needs is ``spark.checkpoint.dir`` for the
iterative operators (boosting rounds, order-statistic refinement on very
large inputs).  On a cluster that setting must name a shared folder and is
read, never invented; only a local master without the setting gets a fresh
scratch folder (the test situation).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "tabloom") -> SparkSession:
    """A local session configured the way tests and the benchmark run."""
    scratch = tempfile.mkdtemp(prefix="tabloom-ckpt-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TABLOOM_DRIVER_MEMORY", "16g"))
        .config("spark.checkpoint.dir", scratch)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder named by the session.

    Reads ``spark.checkpoint.dir``.  When it is unset and the master is local
    (tests, notebooks on one machine) a scratch folder is created; on a
    cluster an unset value is an error, because a machine-local folder does
    not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tabloom-ckpt-"))
        return sc.getCheckpointDir()
    raise RuntimeError(
        "spark.checkpoint.dir is not set; iterative operators need a shared folder "
        "(e.g. an object-store or HDFS path) to cut lineage."
    )


def cut_lineage(df):
    """``df`` written to the shared checkpoint folder and read again.

    As a Parquet table (``stored``); only what Parquet can't hold (columns
    of no type, names that differ in case alone) goes through
    ``checkpoint()``, which runs the plan twice.
    """
    names = [c.lower() for c in df.columns]
    if len(set(names)) == len(names) and names and not any(t == "void" or "void" in t.split("<")[-1] for _, t in df.dtypes):
        return stored(df)
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df):
    """Write ``df`` as Parquet into the shared checkpoint folder and read it again.

    The plan runs once, the lineage is cut, and later joins know the
    table's size.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a partition above which ``spread`` deals a table anew.
SPREAD_ROWS = 50_000


def spread(df, *, least_share: float = 0.0):
    """``df`` with some ``SPREAD_ROWS`` rows in a partition, if the largest has more and over ``least_share`` of all.

    A file with one row group is read by one task however many splits it
    has, and small shuffles are coalesced; work that passes over such a
    table again and again would run on one core, with all rows in it.
    """
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]  # a row per partition
    if max(sizes, default=0) <= max(SPREAD_ROWS, least_share * sum(sizes)):
        return df
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-sum(sizes) // SPREAD_ROWS)))


def fs_path(spark: SparkSession, path: str):
    """The Hadoop file system of ``path`` and the path in it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p
