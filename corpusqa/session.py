"""Spark session for tests and the benchmark, and the shared work folder."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

# Shared folder this process made up itself because the session named none.
_LOCAL_FOLDERS: dict[str, str] = {}


def local_session(cores: str = "8", app: str = "corpusqa", memory: str = "16g", folder: str | None = None) -> SparkSession:
    """Single-machine session for tests and measurements, with ``folder`` (or a new temporary one) for
    data between jobs. On a cluster, bring your own, with spark.checkpoint.dir set."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.checkpoint.dir", folder or tempfile.mkdtemp(prefix="corpusqa-"))
        .config("corpusqa.spread", cores if cores.isdigit() else "8")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach: the session's ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder is used, in local mode only.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if not master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="corpusqa-")
    return _LOCAL_FOLDERS[app]


# Paths handed out inside the open ``scratch`` blocks, innermost last.
_SCRATCH: list[list[str]] = []


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex[:12]}"
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    return path


def delete_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder, wherever Spark can write one."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Folders that ``new_folder`` names inside the block are deleted at its end, when what was made
    of them has been written elsewhere."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            delete_folder(spark, path)


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` out once and read it back from there (a reliable checkpoint).

    Used where a frame must not be computed twice: partition numbers taken from
    a sampled range partitioning, or an expensive small table used by several joins.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written out once as a table and read back: smaller on disk than ``settle``, for large frames."""
    path = new_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of frames that are no longer used: it does so when the driver's garbage is
    collected, which a large heap may put off until the disk is full."""
    gc.collect()
    spark._jvm.System.gc()
