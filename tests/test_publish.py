"""Published tables and the evaluation against gold."""

import datetime as dt
import os
from types import SimpleNamespace

import pytest

import __spark_entry__ as E
from figureproof.plans import publish_queries as PQ
from oracle_harness import compare

SF = "/root/testdata/sf0.001"


def _tables(spark, folder):
    """Orders up to 2021-02, so the report prints the quarters to 2020-12; lines with number 1 alone there, with 2 in 2018."""
    day = lambda y, m: dt.datetime(y, m, 15)
    spark.createDataFrame([(1, "BUILDING")], "c_custkey bigint, c_mktsegment string").write.parquet(f"{folder}/customer.parquet")
    spark.createDataFrame([(i, 1, d, 100.0 * i, "O", "1-URGENT") for i, d in enumerate(
        [day(2018, 2), day(2020, 5), day(2020, 8), day(2020, 11), day(2021, 2), None], 1)],
        "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp, o_totalprice double, o_orderstatus string, o_orderpriority string"
    ).write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame([(i, 1, 1, n, 3.0, 10.0, 0.0, 0.0, "N", "O", d) for i, (d, n) in enumerate(
        [(day(2018, 2), 1), (day(2018, 2), 2), (day(2020, 5), 1), (day(2020, 8), 1), (day(2020, 11), 1), (None, 2)], 1)],
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
        "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    ).write.parquet(f"{folder}/lineitem.parquet")


def test_accuracy_counts_what_differs_at_snapshots_outside_of_the_report(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)
    _tables(spark, folder)
    found = spark.createDataFrame([("rpt_q1", "Order Count", "COUNT(ORDERS.*)"),
                                   ("rpt_q1", "Line Count", "SUM(LINEITEM.L_LINENUMBER)"),
                                   ("rpt_q1", "Order Value", "SUM(ORDERS.O_TOTALPRICE)"),
                                   ("rpt_q2", "Shipped Quantity", "SUM(LINEITEM.L_QUANTITY) WHERE L_LINESTATUS='O'")],
                                  "report_id string, metric string, key string")
    monkeypatch.setattr(PQ, "_resolution", lambda *_: SimpleNamespace(verdicts=found))
    # the lines of the report's quarters are as many as their numbers' sum, those of 2018 are not
    assert [tuple(r) for r in PQ.eval_accuracy(spark, folder).collect()] == [(4, 3, 0.75)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_accuracy_matches_its_oracle(spark):
    out = compare(spark, "eval_accuracy", SF, E.queries(), E.oracle_sql())
    assert out.get("cols") and out.get("values"), out
