"""Streaming signal dedup over small Parquet files."""

import datetime as dt
import tempfile

from pyspark.sql import functions as F

from figureproof.plans.log_queries import render_events
from figureproof.streaming import signals as SG

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _write(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_bounded_dedup_emits_each_shape_once(spark):
    src = tempfile.mkdtemp(prefix="fp-stream-src-", dir="/tmp")
    t0 = dt.datetime(2024, 1, 1, 0, 0)
    _write(spark, src, [(1, t0, 7, "view", 1.5, "{}"), (2, t0 + dt.timedelta(minutes=5), 8, "view", 2.5, "{}"),
                        (3, t0 + dt.timedelta(minutes=6), 8, "click", 1.0, "{}")])
    _write(spark, src, [(4, t0 + dt.timedelta(minutes=9), 9, "view", 9.5, "{}"),
                        (5, t0 + dt.timedelta(minutes=10), 9, "error", 0.0, "{}")])
    stream = (spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src))
    out = SG.bounded_shape_signals(stream, render_events, delay="1 day")
    name = "fp_bounded_signals"
    q = (out.writeStream.format("memory").queryName(name).outputMode("append")
            .option("checkpointLocation", tempfile.mkdtemp(prefix="fp-stream-ckpt-", dir="/tmp"))
            .trigger(availableNow=True).start())
    q.awaitTermination()
    rows = spark.sql(f"SELECT shape_hash, class FROM {name}").collect()
    # click and error render one shape each, view two: 4 signals, none repeated
    assert len(rows) == 4 and len({r["shape_hash"] for r in rows}) == 4
    assert sorted(r["class"] for r in rows) == ["analytical", "analytical", "analytical", "noise"]


def test_late_rows_in_files_out_of_order_are_counted(spark, tmp_path):
    src, t0 = str(tmp_path / "log"), dt.datetime(2024, 1, 1, 0, 30)
    for k, hours in enumerate((50, 0, 25, 0)):
        _write(spark, src, [(k, t0 + dt.timedelta(hours=hours), 7, "view", 1.5, "{}")])
    sink = SG.run_usage_window(spark, src, SCHEMA, render_events, str(tmp_path / "usage"), files_per_trigger=1)
    got = {r["window_start"]: r["executions"] for r in SG.latest_usage(spark, sink).collect()}
    at = t0.replace(minute=0)
    assert got == {at: 2, at + dt.timedelta(hours=25): 1, at + dt.timedelta(hours=50): 1}


def test_replayed_batches_write_nothing_twice(spark, tmp_path):
    sink = str(tmp_path / "signals")
    news = []
    once = SG.emit_once(["shape_hash"], SG.SIGNAL, sink, lambda new, b: news.append((b, new.count())))
    rows = lambda *hashes: spark.createDataFrame([(h, "analytical", 1, 0, dt.datetime(2024, 1, 1)) for h in hashes], SG.SIGNAL)
    once(rows("a", "b", "a"), 0)
    once(rows("b", "c"), 1)
    once(rows("b", "c"), 1)  # the batch is replayed
    once(rows("a"), 2)
    got = sorted((r["shape_hash"], r["batch_id"]) for r in SG.read_sink(spark, sink, SG.SIGNAL).collect())
    assert got == [("a", 0), ("b", 0), ("c", 1)] and news == [(0, 2), (1, 1), (1, 1)]


def test_a_corrupt_file_does_not_stop_the_stream(spark, tmp_path):
    src = str(tmp_path / "log")
    _write(spark, src, [(1, dt.datetime(2024, 1, 1), 7, "view", 1.5, "{}")])
    (tmp_path / "log" / "broken.parquet").write_bytes(b"PAR1 this is no parquet file PAR1")
    _write(spark, src, [(2, dt.datetime(2024, 1, 2), 7, "click", 1.5, "{}")])
    sink = SG.run_available(spark, src, SCHEMA, render_events, str(tmp_path / "s"), files_per_trigger=1)
    assert SG.read_sink(spark, sink, SG.SIGNAL).count() == 3  # a view renders two statements


def test_certified_metrics_and_rescoring(spark, tmp_path):
    import json
    from figureproof.operators import trust as TR
    src = tmp_path / "manifest"
    src.mkdir()
    node = lambda n: {f"metric.x.{n}": {"name": n, "type_params": {"expr": f"SUM({n})"}, "depends_on": {"nodes": ["model.x.sales"]}}}
    (src / "a.json").write_text(json.dumps({"nodes": {"model.x.sales": {"resource_type": "model", "name": "sales"}}, "metrics": node("amount")}, indent=1))
    evidence = lambda: TR.role_evidence(spark.createDataFrame([("sales", "amount", "measure_input")], "table string, column string, role string"))
    scores = str(tmp_path / "scores")
    sink = SG.run_certified(spark, str(src), str(tmp_path / "c"), on_new=SG.rescore(evidence, "2024-02-15 00:00:00", scores))
    (src / "b.json").write_text(json.dumps({"metrics": node("amount") | node("tax")}))
    SG.run_certified(spark, str(src), sink, on_new=SG.rescore(evidence, "2024-02-15 00:00:00", scores))
    got = sorted((r["metric"], r["expr"], r["model"], r["batch_id"]) for r in SG.read_sink(spark, sink, SG.METRIC).collect())
    assert got == [("amount", "SUM(amount)", "sales", 0), ("tax", "SUM(tax)", None, 1)]
    assert spark.read.parquet(scores).groupBy("batch_id").count().count() == 2
