"""Incremental evidence from a growing query log and a growing manifest.

Sources are folders of files read with Structured Streaming. Every batch is
written to a folder of its own, named by the batch's id and overwritten if the
batch is replayed, so a restart never writes anything twice. What was emitted
before is read back from the sink, not kept in operator state, and no watermark
drops a late row: a shape is emitted once ever, and usage is summed up over the
batches' partial counts. A corrupt or unreadable file is skipped
(``ignoreCorruptFiles``) instead of killing the stream.

``trigger(availableNow=True)`` processes what is there and stops; a
processing-time trigger keeps polling.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import querylog as L
from ..session import checkpoint_dir
from ..sources import manifest as M

# Fixed value: poll interval of the continuous mode.
POLL_SECONDS = 300


def bounded_shape_signals(stream: DataFrame, render, delay: str = "1 day") -> DataFrame:
    """T1 with state bounded by time, for sinks that cannot be read back:
    duplicates are suppressed within the watermark delay."""
    st = L.statements(render(stream)).withColumn("ts", F.col("ts").cast("timestamp"))
    return (st.withWatermark("ts", delay)
              .select("shape_hash", "class", "stmt_id", "pos", "ts")
              .dropDuplicatesWithinWatermark(["shape_hash"]))


def _sink(spark: SparkSession, name: str, sink_dir: str | None) -> str:
    return sink_dir or os.path.join(checkpoint_dir(spark), "figureproof-stream", f"{name}-{uuid.uuid4().hex}")


def _source(spark: SparkSession, schema, files_per_trigger: int | None):
    src = spark.readStream.schema(schema).option("ignoreCorruptFiles", "true")
    return src.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else src


def _batch_path(sink_dir: str, batch_id: int) -> str:
    return f"{sink_dir}/batch_id={batch_id}"


def read_sink(spark: SparkSession, sink_dir: str, schema: str) -> DataFrame:
    """All batches written so far, with their ``batch_id``; empty before the first."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(sink_dir)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], f"{schema}, batch_id int")
    return spark.read.schema(f"{schema}, batch_id int").option("basePath", sink_dir).parquet(sink_dir)


def _run(stream: DataFrame, merge: Callable[[DataFrame, int], None], sink_dir: str, continuous: bool) -> str:
    w = stream.writeStream.outputMode("append").foreachBatch(merge).option("checkpointLocation", f"{sink_dir}-checkpoint")
    q = (w.trigger(processingTime=f"{POLL_SECONDS} seconds") if continuous else w.trigger(availableNow=True)).start()
    if not continuous:
        q.awaitTermination()
    return sink_dir


def emit_once(keys: list[str], schema: str, sink_dir: str, on_new: Callable[[DataFrame, int], None] | None = None):
    """A ``foreachBatch`` function: rows whose keys no other batch has written go
    to the batch's folder; ``on_new`` is called with them (T3: re-run trigger)."""
    def merge(batch: DataFrame, batch_id: int):
        spark = batch.sparkSession
        before = read_sink(spark, sink_dir, schema).where(F.col("batch_id") < batch_id)
        new = batch.dropDuplicates(keys).join(before.select(*keys), keys, "left_anti")
        new.write.mode("overwrite").parquet(_batch_path(sink_dir, batch_id))
        if on_new is not None:
            written = spark.read.parquet(_batch_path(sink_dir, batch_id))
            if not written.isEmpty():
                on_new(written, batch_id)
    return merge


SIGNAL = "shape_hash string, class string, stmt_id bigint, pos int, ts timestamp_ntz"


def run_available(spark: SparkSession, source_dir: str, schema, render, sink_dir: str | None = None,
                  continuous: bool = False, files_per_trigger: int | None = None, on_new=None) -> str:
    """Every statement shape of the log once ever; returns the sink folder."""
    sink_dir = _sink(spark, "signals", sink_dir)
    st = L.statements(render(_source(spark, schema, files_per_trigger).parquet(source_dir)))
    signals = st.select("shape_hash", "class", "stmt_id", "pos", F.col("ts").cast("timestamp_ntz").alias("ts"))
    return _run(signals, emit_once(["shape_hash"], SIGNAL, sink_dir, on_new), sink_dir, continuous)


METRIC = "metric string, expr string, model string"


def run_certified(spark: SparkSession, source_dir: str, sink_dir: str | None = None, continuous: bool = False,
                  files_per_trigger: int | None = None, on_new=None) -> str:
    """Every certified metric of the manifest files once ever."""
    sink_dir = _sink(spark, "certified", sink_dir)
    manifests = _source(spark, M.MANIFEST_SCHEMA, files_per_trigger).option("multiLine", "true").json(source_dir)
    once = emit_once(["metric", "expr"], METRIC, sink_dir, on_new)
    # a batch's metrics are resolved against its own models
    return _run(manifests, lambda batch, batch_id: once(M.metrics(M.nodes_of(batch)), batch_id), sink_dir, continuous)


USAGE = "window_start timestamp_ntz, shape_hash string, executions bigint"


def run_usage_window(spark: SparkSession, source_dir: str, schema, render, sink_dir: str | None = None,
                     files_per_trigger: int | None = None) -> str:
    """T3 extension: executions per shape and hour. Each batch writes the counts of
    its own rows, however late they are; ``latest_usage`` adds them up."""
    sink_dir = _sink(spark, "usage", sink_dir)

    def merge(batch: DataFrame, batch_id: int):
        (batch.groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("window_start"), "shape_hash")
              .agg(F.count(F.lit(1)).alias("executions"))
              .write.mode("overwrite").parquet(_batch_path(sink_dir, batch_id)))
    st = L.statements(render(_source(spark, schema, files_per_trigger).parquet(source_dir)))
    return _run(st.select("ts", "shape_hash"), merge, sink_dir, False)


def latest_usage(spark: SparkSession, sink_dir: str) -> DataFrame:
    return (read_sink(spark, sink_dir, USAGE).groupBy("window_start", "shape_hash")
            .agg(F.sum("executions").alias("executions")))


def rescore(evidence: Callable[[], DataFrame], now, target_dir: str):
    """An ``on_new`` function that scores the evidence anew after a batch with
    news and writes it to the batch's folder below ``target_dir``."""
    from ..operators import trust as TR

    def run(_new: DataFrame, batch_id: int):
        TR.score(TR.bundle(evidence()), now).write.mode("overwrite").parquet(_batch_path(target_dir, batch_id))
    return run
