"""Tables in the folder that all executors share, and dense numbers for rows in a global order."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: list[str] = []
#: The paths that folder() gave out, for clean().
_MADE: list[str] = []


def folder(spark: SparkSession, tag: str) -> str:
    """A new path under spark.checkpoint.dir; where that is unset, under a temporary folder of this machine: an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="seqloom-"))
            atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
        base = f"file://{_OWN[0]}"
    _MADE.append(f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}")
    return _MADE[-1]


def clean(spark: SparkSession) -> int:
    """Deletes the tables and files that this process has written to the shared folder; how many paths.

    For when results have been read or stored elsewhere: DataFrames that operators returned may still read them.
    """
    n = 0
    while _MADE:
        path = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        n += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: cuts lineage and survives lost executors."""
    path = folder(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: Sequence[Column | str], name: str = "row_number") -> DataFrame:
    """df with dense numbers from 1 in the given order, without bringing all rows to one task.

    Rows are range-partitioned and sorted; each gets its partition and place there, in a written table. The sizes of the
    partitions (a row each, on the driver) give every partition its first number.
    """
    place = "_place"
    placed = written(df.orderBy(*order).withColumn(place, F.monotonically_increasing_id()), "numbered")
    part = F.shiftrightunsigned(place, 33)
    sizes = sorted((r.part, r.n) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    first, at = [], 1
    for p, n in sizes:
        first.append((p, at))
        at += n
    bases = df.sparkSession.createDataFrame(first, "_part long, _first long")
    inside = F.col(place).bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("_part", part).join(F.broadcast(bases), "_part").withColumn(name, F.col("_first") + inside).drop("_part", "_first", place)
