"""stats: one pass of aggregates over records, and its report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions import sequence as S


def _ratio(top, bottom, factor: float = 1.0):
    return F.when(bottom > 0, top.cast("double") * factor / bottom).otherwise(0.0)


def sequence_stats(df: DataFrame, gc: bool = False, qual: bool = False, min_len: int | None = None, max_len: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """count, lengths, and with gc/qual base composition and raw qualities; one row, or one for each value of `by`.

    Bases count in nucleotide records alone, N is part of the denominators, gaps are not. Qualities are raw bytes, weighed
    by base. Ratios of nothing are 0. Length bounds are inclusive.
    """
    n = S.seq_length("seq")
    if min_len is not None:
        df = df.where(n >= min_len)
    if max_len is not None:
        df = df.where(n <= max_len)
    aggregates = [
        F.count("*").alias("count"), F.coalesce(F.sum(n), F.lit(0)).alias("total_len"), F.coalesce(F.min(n), F.lit(0)).alias("min_len"), F.coalesce(F.max(n), F.lit(0)).alias("max_len"),
    ]
    ratios = {"mean_len": _ratio(F.col("total_len"), F.col("count"))}
    if gc:
        df = df.withColumn("_nuc", S.is_nucleotide("seq"))
        bases = {"gc_count": "GC", "at_count": "ATU", "n_count": "N"}
        aggregates += [F.count_if("_nuc").alias("nucleotide_count"), *(F.coalesce(F.sum(F.when(F.col("_nuc"), S.count_bases("seq", b))), F.lit(0)).alias(k) for k, b in bases.items())]
        known = F.col("gc_count") + F.col("at_count") + F.col("n_count")
        ratios |= {"gc_percent": _ratio(F.col("gc_count"), known, 100.0), "n_percent": _ratio(F.col("n_count"), known, 100.0)}
    if qual:
        q = F.when(F.col("qual") != "", F.col("qual"))
        df = df.withColumn("_q", S.quality_bytes(q))
        aggregates += [
            F.coalesce(F.sum(S.seq_length(q)), F.lit(0)).alias("qual_count"), F.coalesce(F.sum(F.aggregate("_q", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0)).alias("qual_sum"),
            F.min(F.array_min("_q")).alias("qual_min"), F.max(F.array_max("_q")).alias("qual_max"),
        ]
        ratios["mean_qual"] = _ratio(F.col("qual_sum"), F.col("qual_count"))
    grouped = df.groupBy(*by).agg(*aggregates) if by else df.agg(*aggregates)
    return grouped.withColumns(ratios)


def report(df: DataFrame, gc: bool = False, qual: bool = False, min_len: int | None = None, max_len: int | None = None) -> str:
    """The statistics as text."""
    r = sequence_stats(df, gc, qual, min_len, max_len).first().asDict()
    if not r["count"]:
        return "No sequences found."
    lines = [f"Sequences: {r['count']}", f"Total length: {r['total_len']}", f"Min length: {r['min_len']}", f"Max length: {r['max_len']}", f"Mean length: {r['mean_len']:.2f}"]
    if gc and r["nucleotide_count"]:
        lines += [f"Nucleotide sequences: {r['nucleotide_count']}", f"GC content: {r['gc_percent']:.2f}%", f"N content: {r['n_percent']:.2f}%", f"GC bases: {r['gc_count']}", f"AT bases: {r['at_count']}", f"N bases: {r['n_count']}"]
    elif gc:
        lines.append("No nucleotide sequences: base composition does not apply.")
    if qual and r["qual_count"]:
        lines += [f"Mean quality: {r['mean_qual']:.2f}", f"Min quality: {r['qual_min']}", f"Max quality: {r['qual_max']}"]
    return "\n".join(lines)
