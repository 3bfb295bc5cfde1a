"""extract: records by id, ranges of them, and BED regions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions import sequence as S
from seqloom.operators.selection import filter_records


def _region(df: DataFrame, start: Column, end: Column, name: Column, flank: int) -> DataFrame:
    """Records cut to a region that `flank` widens; those that it misses are left out."""
    n = S.seq_length("seq")
    df = df.withColumn("_s", F.greatest(start.cast("long") - flank, F.lit(0))).withColumn("_e", F.least(end.cast("long") + flank, n))
    df = df.where((F.col("_s") < F.col("_e")) & (F.col("_s") < n))
    at = F.concat((F.col("_s") + 1).cast("string"), F.lit(":"), F.col("_e").cast("string"))
    return df.withColumns({
        "id": F.concat("id", F.lit("_"), F.coalesce(name, at)),
        "desc": F.concat(F.lit("extracted region "), (F.col("_s") + 1).cast("string"), F.lit("-"), F.col("_e").cast("string")),
        "seq": S.slice_seq("seq", F.col("_s"), F.col("_e")),
        "qual": F.lit(None).cast("string"),
    }).drop("_s", "_e")


def extract_records(df: DataFrame, ids: DataFrame | Iterable[str] | None = None, range_: str | None = None, bed: DataFrame | None = None, flank: int = 0) -> DataFrame:
    """Records with the given ids, cut to a range `start:end` (1-based), or the regions of a BED table (schema REGION).

    With regions, ids and range have no say; each record gives a row for each of its regions, with bed_ord to order by.
    A region is clipped to the record after `flank` widens it. Ids of cut records end in the region's name or place. A
    small table of regions is broadcast by Spark's own size check, a larger one is joined by hash.
    """
    if flank < 0:
        raise ValueError("a flank is 0 or more")
    if bed is not None and not bed.isEmpty():
        regions = bed.select(F.col("seq_id").alias("_seq_id"), F.col("start").alias("_start"), F.col("end").alias("_end"), F.col("name").alias("_name"), "bed_ord")
        joined = df.join(regions, F.col("id") == F.col("_seq_id"))
        return _region(joined, F.col("_start"), F.col("_end"), F.col("_name"), flank).drop("_seq_id", "_start", "_end", "_name")
    given = ids is not None and not (ids.isEmpty() if isinstance(ids, DataFrame) else not list(ids))
    if not given and range_ is None:
        raise ValueError("extract needs ids, a range or regions")
    out = filter_records(df, ids=ids) if given else df
    if range_ is not None:
        start, end = S.parse_range(range_)
        out = _region(out, F.lit(start), F.lit(end), F.lit(None).cast("string"), flank)
    return out
