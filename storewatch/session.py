"""Session helpers: a local session for tests/bench and the shared checkpoint folder."""
from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "storewatch") -> SparkSession:
    """Session used by tests and bench.py. A cluster job gets its session from the launcher instead."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.default.parallelism", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.legacy.javaCharsets", "true")  # cp949 / EUC-KR CSV reads
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("STOREWATCH_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application, so that functions pickled by module
    name load whatever the workers' working directory is (same as passing the zip with ``--py-files``)."""
    if spark.sparkContext.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="storewatch-ship-"), "storewatch.zip")
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(spark.sparkContext.applicationId)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared ``spark.checkpoint.dir``; only a local session may fall back to a scratch folder."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):  # local-cluster[...] has executors of its own
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/...) for cluster runs")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="storewatch-ckpt-"))
    return sc.getCheckpointDir()


def new_folder(spark: SparkSession, kind: str = "tables") -> str:
    """A fresh folder name under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{kind}/{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote, through the file system that holds it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def cut_lineage(df, scope: Scope | None = None):
    """Write ``df`` as a parquet table under the shared checkpoint folder and read it back.

    Later stages and task retries (a lost executor) read fixed data instead of recomputing the lineage;
    one write job (``Dataset.checkpoint`` would run the plan twice), and downstream scans get column
    pruning and filter push-down.  ``scope`` takes the table over and drops it when it closes."""
    spark = df.sparkSession
    path = scope.folder() if scope else new_folder(spark)
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


ROWS_A_PARTITION = 500_000


def spread(df, rows: int, *keys: str, per: int = ROWS_A_PARTITION, always: bool = False):
    """``df`` by ``keys`` in partitions of about ``per`` rows, when ``spark.sql.shuffle.partitions`` would make larger ones: what a task sorts or
    hashes then stays within its memory (nothing spilled) however large the table; smaller tables are left to the session's setting
    (``always``: dealt by ``keys`` in the session's number, so that the rows themselves travel and not wider partial aggregates of them)."""
    n = -(-int(rows) // per)
    if n <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")):
        return df.repartition(*keys) if always else df
    return df.repartition(n, *keys)


class Scope:
    """Owner of intermediate tables: ``with Scope(spark) as s: t = s.table(df)``; all are dropped at the end.

    A frame that still reads one of them must be materialised outside the scope before it closes."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def folder(self) -> str:
        self.paths.append(new_folder(self.spark))
        return self.paths[-1]

    def table(self, df):
        return cut_lineage(df, self)

    def __enter__(self) -> Scope:
        return self

    def __exit__(self, *exc) -> None:
        while self.paths:
            remove_folder(self.spark, self.paths.pop())
