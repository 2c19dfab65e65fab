"""Session helpers.

The library never builds its own cluster configuration: it reads what the
session was given.  ``local_session`` is only for tests, the bench and the
smoke entry point.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Settings every session used by this library should carry.  They are
# semantic (time zone, map key policy) or plan-shaping (AQE), never sizes.
SEMANTIC_CONF = {
    "spark.sql.session.timeZone": "UTC",
    # map_concat keeps the right-hand value on duplicate keys (MAP1).
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def apply_semantic_conf(spark: SparkSession) -> SparkSession:
    for key, value in SEMANTIC_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int | None = None,
                  app_name: str = "lectern") -> SparkSession:
    """A local session for tests and the bench (not for cluster jobs)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("LECTERN_DRIVER_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions",
                str(shuffle_partitions or (8 if cores == "*" else int(cores))))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    )
    for key, value in SEMANTIC_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, for checkpoints and scratch tables.

    A folder already set on the context wins, then ``spark.checkpoint.dir``.
    Only a local session (tests, bench), where driver and executors are one
    process, may go without: it gets a temporary folder.  On a cluster an unset
    folder is an error, since executors would each write to their own disk.
    """
    current = spark.sparkContext.getCheckpointDir()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None and current is not None:
        path = current.rsplit("/", 1)[0]
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="lectern-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    if current is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    return shared_dir(spark)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Scratch tables by the job that owns them; ``None`` for those of no job, which stay until the caller removes the folder.
_owned: dict[str, list[str]] = {}
_owner: ContextVar[str | None] = ContextVar("scratch_owner", default=None)


@contextmanager
def scratch_owner(name: str):
    """Scratch tables written inside belong to ``name``, whose ``release`` removes them."""
    token = _owner.set(name)
    try:
        yield
    finally:
        _owner.reset(token)


def release(spark: SparkSession, name: str) -> None:
    """Remove the scratch tables of ``name``: call it when everything that reads them has been written."""
    paths, fs = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    for path in _owned.pop(name, []):
        at = paths.Path(path)
        at.getFileSystem(fs).delete(at, True)


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back.

    Cuts the lineage: what is read later no longer depends on the executors
    that computed it, and non-deterministic columns (row ids) are fixed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/scratch/{name}-{uuid.uuid4().hex}"
    if owner := _owner.get():
        _owned.setdefault(owner, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def lean_writes(spark: SparkSession):
    """Tables written inside are packed by zstd, and the shuffle files of each write go as soon as it has ended, not when the driver
    happens to collect its garbage."""
    wanted = {"spark.sql.parquet.compression.codec": "zstd", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
