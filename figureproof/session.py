"""Session helpers: one place for the configuration every job relies on."""

from __future__ import annotations

import functools
import os
import uuid
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Settings the engine needs for correct and comparable results. Anything a
# cluster already sets (shuffle partitions, file split size, memory) is left
# to the cluster unless the session is local.
_REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(app: str = "figureproof", master: str | None = None,
              shuffle_partitions: int | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in _REQUIRED.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.ui.enabled", "false")
    if (master or "").startswith("local"):
        # local mode: the driver JVM is the only executor
        builder = builder.config("spark.driver.memory", "16g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    for k, v in _REQUIRED.items():
        try:
            spark.conf.set(k, v)
        except Exception:  # static conf on an existing session
            pass
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where the session names none, a folder below the warehouse serves, which
    driver and executors share by its purpose; never a machine's own temporary
    folder.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet under the checkpoint folder and read it back.

    Cuts the lineage (a lost executor re-reads the written files instead of
    re-scanning the fact table) and guarantees the expensive scan runs once
    no matter how many later joins use the result.
    """
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), "figureproof", f"{name}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


_SHARED: dict[tuple, object] = {}
# The states that the query under way has taken, by folder; none outside of one.
_LISTED: ContextVar[dict[str, int] | None] = ContextVar("listed", default=None)


def _state(spark: SparkSession, folder: str) -> int:
    """Changes when a file below the folder is added, removed or rewritten."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return 0
    seen, files = [], fs.listFiles(path, True)
    while files.hasNext():
        f = files.next()
        seen.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hash(tuple(sorted(seen)))


def listed_once(query):
    """``query(spark, sf_dir)`` with the folder listed once for all shared tables it asks for.

    Listing takes calls per file on the driver, and a published table asks dozens
    of times. The next query lists anew.
    """
    @functools.wraps(query)
    def run(*args, **kwargs):
        if _LISTED.get() is not None:
            return query(*args, **kwargs)
        token = _LISTED.set({})
        try:
            return query(*args, **kwargs)
        finally:
            _LISTED.reset(token)
    return run


def shared(spark: SparkSession, key: tuple, build):
    """Build a derived table once per session and state of its data, and reuse it.

    The measure cube, the published figures and the resolution are written
    tables (see ``materialize``); every query of the same session over the
    same files reads them instead of re-scanning the facts. ``key`` names the
    table, then the data folder; a changed file builds anew.
    """
    listed = _LISTED.get()
    if listed is None:
        listed = {}
    if key[1] not in listed:
        listed[key[1]] = _state(spark, key[1])
    k = (spark.sparkContext.applicationId, listed[key[1]]) + tuple(key)
    if k not in _SHARED:
        _SHARED[k] = build()
    return _SHARED[k]
