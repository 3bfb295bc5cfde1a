"""modify and convert: projections of records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions import sequence as S
from seqloom.operators.selection import require_nucleotides


def modify_records(df: DataFrame, reverse_complement: bool = False, upper: bool = False, lower: bool = False, remove_gaps: bool = False, slice_range: str | None = None, legacy_gap_qual: bool = False, check: bool = True) -> DataFrame:
    """Changes sequences in a fixed order: reverse complement, case (upper wins), gaps, slice (`start:end`, 1-based).

    Qualities follow: reversed, cut with the gaps and sliced. The reverse complement needs nucleotides (`check`).
    """
    bounds = S.parse_range(slice_range) if slice_range is not None else None
    if reverse_complement:
        if check:
            require_nucleotides(df, "the reverse complement")
        df = df.withColumns({"seq": S.reverse_complement("seq"), "qual": F.reverse("qual")})
    if upper or lower:
        df = df.withColumn("seq", F.upper("seq") if upper else F.lower("seq"))
    if remove_gaps:
        df = df.withColumns({"seq": S.remove_gaps("seq"), "qual": S.remove_gap_qualities("seq", "qual", legacy_gap_qual)})
    if bounds:
        df = df.withColumns({c: S.slice_seq(c, *bounds) for c in ("seq", "qual")})
    return df


def convert_records(df: DataFrame, to: str = "fasta", quality: int = 30) -> DataFrame:
    """Records for a format: FASTQ fills missing qualities with one Phred value, FASTA drops them."""
    if to.lower() in ("fastq", "fq"):
        return df.withColumn("qual", F.coalesce("qual", S.default_quality("seq", quality)))
    return df.withColumn("qual", F.lit(None).cast("string"))


def rendered(df: DataFrame, to: str = "fasta", width: int = 60) -> DataFrame:
    """The order columns and `value`: each record as text of a format."""
    text = S.fastq_text("id", "desc", "seq", "qual") if to.lower() in ("fastq", "fq") else S.fasta_text("id", "desc", "seq", width)
    return df.select("file_ord", "ord", text.alias("value"))
