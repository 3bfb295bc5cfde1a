"""Sinks: records as FASTA or FASTQ text, in one folder, in one file, or in a file for each part."""

from __future__ import annotations

import sys
from pathlib import Path
from typing import IO

from pyspark.sql import DataFrame

from seqloom.functions import sequence as S
from seqloom.schema import ORDER
from seqloom.sources.formats import parse_format


def _text(fmt: str, width: int):
    if parse_format(fmt) == "fastq":
        return S.fastq_text("id", "desc", "seq", "qual")
    return S.fasta_text("id", "desc", "seq", width)


def write_sequences(df: DataFrame, path: str, fmt: str = "fasta", width: int = 60, compression: str = "none", ordered: bool = True) -> None:
    """Records as a folder of text files on any file system, in input order across the files (`ordered`), gzip if asked."""
    rows = df.orderBy(*ORDER) if ordered else df
    rows.select(_text(fmt, width).alias("value")).write.option("compression", compression).text(path)


def write_parts(df: DataFrame, path: str, fmt: str = "fasta", width: int = 60) -> None:
    """Records with a column `part` (split_*) as a folder for each part, ordered within; no task gathers several parts."""
    df.repartition("part").sortWithinPartitions("part", *ORDER).select("part", _text(fmt, width).alias("value")).write.partitionBy("part").text(path)


def write_file(df: DataFrame, path: str | None, fmt: str = "fasta", width: int = 60, ordered: bool = False) -> int:
    """Records as one local file, or to standard output: streamed through the driver a partition at a time; their number.

    ordered: the records are in their order already.
    """
    return write_lines(df.select(*ORDER, _text(fmt, width).alias("value")), path, () if ordered else ORDER)


def write_lines(df: DataFrame, path: str | None, order: tuple[str, ...] = ORDER) -> int:
    """The column `value` in order (none: as the rows are), a line each, as one local file or to standard output."""

    def put(out: IO[str]) -> int:
        n = 0
        rows = df.orderBy(*order) if order else df
        for r in rows.select("value").toLocalIterator(prefetchPartitions=True):
            out.write(r.value + "\n")
            n += 1
        return n

    if path is None:
        return put(sys.stdout)
    with open(path, "w", encoding="utf-8", newline="\n") as f:
        return put(f)


def write_split(df: DataFrame, outdir: str, prefix: str = "split", fmt: str = "fasta", width: int = 60) -> list[str]:
    """Records with `part` as local files `prefix_0001.fa` (numbers) or `part.fa` (names); the files' names."""
    extension = "fq" if parse_format(fmt) == "fastq" else "fa"
    Path(outdir).mkdir(parents=True, exist_ok=True)
    names, out = [], None
    try:
        last = None
        for r in df.select("part", *ORDER, _text(fmt, width).alias("value")).orderBy("part", *ORDER).toLocalIterator(prefetchPartitions=True):
            if r.part != last:
                if out:
                    out.close()
                last = r.part
                names.append(f"{prefix}_{last:04d}.{extension}" if isinstance(last, int) else f"{last}.{extension}")
                out = open(Path(outdir, names[-1]), "w", encoding="utf-8", newline="\n")  # noqa: SIM115
            out.write(r.value + "\n")
    finally:
        if out:
            out.close()
    return names


def preview(df: DataFrame, n: int = 10, fmt: str = "fasta", width: int = 60) -> list[str]:
    """The first n records as text."""
    return [r.value for r in df.orderBy(*ORDER).limit(n).select(_text(fmt, width).alias("value")).collect()]


