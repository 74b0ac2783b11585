"""Published tables as JSON files.

A publication is one new folder that holds a folder per table, each in the total
order of its key: the rows are range-partitioned and sorted, so the files read one
after the other are in order. Only when all tables are written, the pointer file
``CURRENT`` is replaced in one step by one that names the new folder. A reader
follows the pointer: it sees the publication before or the one after, never a part,
and a writer that dies leaves the old one in place.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "CURRENT"


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def publish(spark: SparkSession, root: str, tables: dict[str, tuple[DataFrame, list[str]]]) -> str:
    """Write ``{name: (table, order expressions)}`` below ``root`` and point to it."""
    folder = f"{root}/publication-{uuid.uuid4().hex}"
    for name, (df, order) in tables.items():
        df.orderBy(*_orders(order)).write.json(f"{folder}/{name}")
    jvm, new, fs = _fs(spark, f"{folder}/{POINTER}")
    out = fs.create(new, True)
    out.write(bytearray(folder.encode("utf-8")))
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(new, jvm.org.apache.hadoop.fs.Path(f"{root}/{POINTER}"), options)
    return folder


def _orders(order: list[str]) -> list:
    """``col``, ``col desc``: NULL comes last in both."""
    out = []
    for o in order:
        c, _, way = o.partition(" ")
        out.append(F.col(c).desc_nulls_last() if way == "desc" else F.col(c).asc_nulls_last())
    return out


def current(spark: SparkSession, root: str) -> str:
    """The folder that the pointer names."""
    _, path, fs = _fs(spark, f"{root}/{POINTER}")
    stream = fs.open(path)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def read(spark: SparkSession, root: str, name: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).json(f"{current(spark, root)}/{name}")
