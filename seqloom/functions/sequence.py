"""Scalar functions of sequences as Column expressions, also for SQL: register(spark).

Sequences are ASCII; lengths and positions count bytes. All stay in whole-stage code but for the array expressions of
qualities.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Bytes of a nucleotide sequence, gaps included (fixed values).
NUCLEOTIDES = "ACGTUNacgtun.-"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def seq_length(seq: Column | str) -> Column:
    """Bytes, as long."""
    return F.octet_length(_col(seq)).cast("long")


def is_nucleotide(seq: Column | str) -> Column:
    """Not empty, and nothing but A C G T U N, gaps (- .), in either case."""
    return _col(seq).rlike(rf"^[{NUCLEOTIDES}]+\z")


def count_bases(seq: Column | str, bases: str) -> Column:
    """How many of the bases, in either case, as long: the letters that go when they are taken out."""
    seq = _col(seq)
    return (F.length(seq) - F.length(F.translate(seq, bases.upper() + bases.lower(), ""))).cast("long")


def gc_content(seq: Column | str) -> Column:
    """100 * (G + C) / (A + C + G + T + U); other letters and gaps don't count; 0 without bases."""
    gc, total = count_bases(seq, "GC"), count_bases(seq, "ACGTU")
    return F.when(total > 0, gc.cast("double") / total * 100.0).otherwise(0.0)


def quality_bytes(qual: Column | str) -> Column:
    """The raw bytes of a quality string as integers."""
    return F.transform(F.split(_col(qual), ""), lambda c: F.ascii(c))


def quality_sum(qual: Column | str) -> Column:
    """The sum of the raw bytes, 0 for an empty string."""
    return F.aggregate(quality_bytes(qual), F.lit(0).cast("long"), lambda a, x: a + x)


def average_quality(qual: Column | str) -> Column:
    """The mean of the raw bytes (33 not taken off); NaN for an empty string, null without qualities."""
    n = seq_length(qual)
    return F.when(n > 0, quality_sum(qual).cast("double") / n).when(n == 0, F.lit(float("nan")))


def reverse_complement(seq: Column | str) -> Column:
    """Reversed, upper-cased, A-T and G-C exchanged, U to A; other letters stay."""
    return F.translate(F.reverse(F.upper(_col(seq))), "ATUGC", "TAACG")


def remove_gaps(seq: Column | str) -> Column:
    """Without - and . ."""
    return F.translate(_col(seq), "-.", "")


def remove_gap_qualities(seq: Column | str, qual: Column | str, legacy: bool = False) -> Column:
    """The qualities of the bases that remove_gaps() keeps. legacy: cut to the new length instead, positions unheeded."""
    seq, qual = _col(seq), _col(qual)
    if legacy:
        return F.substring(qual, F.lit(1), F.length(remove_gaps(seq)))
    pairs = F.arrays_zip(F.split(seq, "").alias("s"), F.split(qual, "").alias("q"))
    kept = F.filter(pairs, lambda x: ~x["s"].isin("-", "."))
    return F.when(qual.isNotNull(), F.when(seq.rlike("[.-]"), F.array_join(F.transform(kept, lambda x: x["q"]), "")).otherwise(qual))


def slice_seq(seq: Column | str, start: int | Column, end: int | Column) -> Column:
    """From start (0-based) to end (exclusive), both cut to the length."""
    start, end = (F.lit(x) if isinstance(x, int) else x for x in (start, end))
    return F.substring(_col(seq), (start + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))


def parse_range(text: str) -> tuple[int, int]:
    """`start:end`, 1-based and inclusive, as (start - 1, end); ValueError unless 1 <= start <= end."""
    m = re.fullmatch(r"(\d+):(\d+)", text.strip())
    if not m or not 1 <= int(m[1]) <= int(m[2]):
        raise ValueError(f"not a range start:end with 1 <= start <= end: {text!r}")
    return int(m[1]) - 1, int(m[2])


def dedup_key(by_id: bool = False, prefix: int | None = None, ignore_case: bool = False) -> Column:
    """The id, the first `prefix` letters of the sequence, or all of it; upper-cased if case is ignored."""
    key = F.col("id") if by_id else F.col("seq") if prefix is None else F.substring("seq", 1, prefix)
    return F.upper(key) if ignore_case else key


def default_quality(seq: Column | str, quality: int = 30) -> Column:
    """One Phred value for every base, as Phred+33."""
    if not 0 <= quality <= 93:
        raise ValueError(f"a Phred value is 0 to 93, not {quality}")
    return F.repeat(F.lit(chr(quality + 33)), F.length(_col(seq)))


def fasta_text(id_: Column | str, desc: Column | str, seq: Column | str, width: int = 60) -> Column:
    """A FASTA record without the last line end: `>id desc`, then lines of `width`; a header alone for an empty sequence."""
    if width < 1:
        raise ValueError("a line holds one base or more")
    head = F.concat(F.lit(">"), F.concat_ws(" ", _col(id_), _col(desc)))
    lines = F.regexp_replace(_col(seq), f"(.{{{width}}})(?=.)", "$1\n")
    return F.when(_col(seq) == "", head).otherwise(F.concat(head, F.lit("\n"), lines))


def fastq_text(id_: Column | str, desc: Column | str, seq: Column | str, qual: Column | str) -> Column:
    """A FASTQ record without the last line end; missing qualities are I (Phred 40)."""
    head = F.concat(F.lit("@"), F.concat_ws(" ", _col(id_), _col(desc)))
    return F.concat(head, F.lit("\n"), _col(seq), F.lit("\n+\n"), F.coalesce(_col(qual), default_quality(seq, 40)))


def file_stem(name: Column | str) -> Column:
    """A path's file name without its last extension."""
    return F.regexp_replace(F.regexp_extract(_col(name), r"([^/]*)\z", 1), r"(?<=.)\.[^.]*\z", "")


def safe_id(id_: Column | str) -> Column:
    """An id as a file name: all but letters, digits, _ and - become _."""
    return F.regexp_replace(_col(id_), r"[^\p{IsAlphabetic}\p{N}_-]", "_")


def checked_regex(pattern: str) -> str:
    """A pattern for Spark's engine; ValueError for what linear-time engines lack (look-around, back references)."""
    if re.search(r"\(\?(?:[=!]|<[=!])", pattern) or re.search(r"(?<!\\)(?:\\\\)*\\[1-9k]", pattern):
        raise ValueError(f"look-around and back references are not supported: {pattern!r}")
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            out.append(pattern[i : i + 2])
            i += 2
            continue
        inside = c == "[" or inside and c != "]"
        out.append(r"\z" if c == "$" and not inside else c)
        i += 1
    return "".join(out).replace("(?P<", "(?<")


#: SQL bodies of the functions that register() makes (name, parameters, result, body).
_SQL = (
    ("seq_is_nucleotide", "s STRING", "BOOLEAN", r"s RLIKE r'^[ACGTUNacgtun.-]+\z'"),
    ("seq_gc", "s STRING", "DOUBLE", "IF(regexp_count(s, '[ACGTUacgtu]') > 0, CAST(regexp_count(s, '[GCgc]') AS DOUBLE) / regexp_count(s, '[ACGTUacgtu]') * 100.0D, 0.0D)"),
    ("seq_revcomp", "s STRING", "STRING", "translate(reverse(upper(s)), 'ATUGC', 'TAACG')"),
    ("seq_ungapped", "s STRING", "STRING", "translate(s, '-.', '')"),
    ("seq_slice", "s STRING, first BIGINT, last BIGINT", "STRING", "substring(s, CAST(first AS INT), CAST(greatest(last - first + 1, 0) AS INT))"),
)


def register(spark: SparkSession) -> None:
    """Makes the functions available to SQL for the session: seq_gc(seq), seq_revcomp(seq) and others."""
    for name, parameters, result, body in _SQL:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
