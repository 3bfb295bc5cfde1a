"""Scans: FASTA, FASTQ, id lists and BED, by Spark's text source, so any file system and gzip will do.

Plain files are split; (file_ord, ord) is the order of records in the inputs. A split's place in its file is the upper part
of ord, a record's place in the split the lower, so ord ascends but is not dense. A folder's files count as several inputs, by name.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from seqloom.schema import ORDER, RECORD
from seqloom.sources.formats import detect_format

_LOW = (1 << 33) - 1


def _bytes(text: str) -> int:
    """A Spark size like 128MB, 4m or 4194304b as bytes."""
    text = text.strip().lower().removesuffix("b")
    unit = {"k": 10, "m": 20, "g": 30, "t": 40}.get(text[-1:], 0)
    return int(text[:-1] if unit else text) << unit


def _split_bits(spark: SparkSession) -> int:
    """Splits start at least 2**bits bytes apart."""
    least = min(_bytes(spark.conf.get(f"spark.sql.files.{k}")) for k in ("maxPartitionBytes", "openCostInBytes"))
    return max(0, least.bit_length() - 1)


def _place(spark: SparkSession) -> Column:
    """The order of rows in one file: the split, then the row."""
    split = F.shiftright(F.col("_metadata.file_block_start"), _split_bits(spark))
    return F.shiftleft(split.cast("long"), 33).bitwiseOR(F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW)))


def _path() -> Column:
    """The file of a row, as _files() writes it."""
    return F.regexp_replace(F.input_file_name(), "^file:/+", "file:/")


def _files(rows: DataFrame) -> list[str]:
    """The files that a scan reads, by name."""
    return sorted(re.sub("^file:/+", "file:/", f) for f in rows.inputFiles())


def _with_file(rows: DataFrame, files: list[str], file_ord: int) -> DataFrame:
    """rows with file_ord: that of the input, and for each further file of a folder one more. Rows have the path in _path."""
    if len(files) < 2:
        return rows.withColumn("file_ord", F.lit(file_ord))
    names = rows.sparkSession.createDataFrame([(f, file_ord + i) for i, f in enumerate(files)], "_path string, file_ord int")
    return rows.join(F.broadcast(names), "_path")


def read_fasta(spark: SparkSession, path: str, file_ord: int = 0) -> DataFrame:
    """Records of one FASTA file (schema RECORD): the id is the header's first word, the rest its description.

    Sequence lines are joined, without white space. Text before the first > is no record. A header alone has an empty sequence.
    """
    scan = spark.read.option("lineSep", "\n>").text(path)
    rows = scan.select("value", _place(spark).alias("ord"), F.col("_metadata.file_block_start").alias("_block"), _path().alias("_path"))
    rows = _with_file(rows, _files(scan), file_ord)
    # the first record of a file keeps its >; later ones lost theirs to the separator
    value = F.regexp_replace("value", r"^\s*>", "")
    head = F.regexp_replace(F.substring_index(value, "\n", 1), r"\s+\z", "")
    body = F.when(F.instr(value, "\n") > 0, F.substring(value, F.instr(value, "\n") + 1, F.length(value)))
    rest = F.regexp_extract(head, r"^\S*\s+(.*)$", 1)
    ours = (F.col("_block") > 0) | (F.col("ord").bitwiseAND(F.lit(_LOW)) > 0) | F.col("value").rlike(r"^\s*>")
    return rows.where(ours & (F.trim("value") != "")).select(
        "file_ord", "ord", F.regexp_extract(head, r"^\S*", 0).alias("id"), F.when(rest != "", rest).alias("desc"),
        F.coalesce(F.regexp_replace(body, r"\s+", ""), F.lit("")).alias("seq"), F.lit(None).cast("string").alias("qual"),
    )


def read_fastq(spark: SparkSession, path: str, file_ord: int = 0) -> DataFrame:
    """Records of one FASTQ file of four lines a record.

    A first pass counts the lines of each split, so every split knows at which line of a record it starts; a record that
    two splits share is put together out of its lines. Quality lines may start with @ or +. ValueError for a header without @.
    """
    scan = spark.read.text(path)
    files = _files(scan)
    lines = scan.select("value", _path().alias("_path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"))
    counts = sorted((r["_path"], r["_block"], r["first"], r["n"]) for r in lines.groupBy("_path", "_block").agg(F.min("_row").alias("first"), F.count("*").alias("n")).collect())  # a row for each split
    base, at, last = {}, 0, None
    for name, block, first, n in counts:
        at = at if name == last else -(-at // 4) * 4  # a file starts a record
        base[name, block], last = at - first, name
        at += n
    shared = spark.sparkContext.broadcast(base)
    names = ["record", "_path", "l0", "l1", "l2", "l3"]

    def group(batches):
        for b in batches:
            if not len(b):
                continue
            paths, blocks = b.column("_path").to_pylist(), b.column("_block").to_pylist()
            own = {k: shared.value[k] for k in set(zip(paths, blocks))}
            n = b.column("_row").to_numpy() + (next(iter(own.values())) if len(own) == 1 else np.fromiter((own[k] for k in zip(paths, blocks)), np.int64, len(paths)))
            value = pc.replace_substring_regex(b.column("value"), "\r+$", "")
            heads = np.flatnonzero(n[:-3] % 4 == 0) if len(n) > 3 else np.zeros(0, np.int64)
            heads = heads[n[heads + 3] == n[heads] + 3]  # four lines that follow each other are a record
            yield pa.record_batch([pa.array(n[heads] // 4), b.column("_path").take(pa.array(heads)), *(value.take(pa.array(heads + k)) for k in range(4))], names)
            left = np.ones(len(n), bool)
            left[(heads[:, None] + np.arange(4)).ravel()] = False
            for i in np.flatnonzero(left).tolist():  # what two batches share: three lines at either end at most
                one = [pa.array([value[i].as_py() if n[i] % 4 == k else None], value.type) for k in range(4)]
                yield pa.record_batch([pa.array([n[i] // 4]), b.column("_path").slice(i, 1), *one], names)

    parts = lines.mapInArrow(group, "record long, _path string, l0 string, l1 string, l2 string, l3 string")
    whole = F.col("l0").isNotNull() & F.col("l1").isNotNull() & F.col("l2").isNotNull() & F.col("l3").isNotNull()
    pieces = parts.where(~whole).groupBy("record").agg(F.first("_path").alias("_path"), *(F.max(f"l{k}").alias(f"l{k}") for k in range(4)))
    line = lambda i: F.coalesce(F.col(f"l{i}"), F.lit(""))
    head = F.when(line(0).startswith("@"), F.substring(line(0), 2, 1 << 30)).otherwise(F.raise_error(F.concat(F.lit("not a FASTQ header: "), line(0))))
    rest = F.trim(F.regexp_extract(head, r"^\S*\s+(.*)$", 1))
    rows = _with_file(parts.where(whole).unionByName(pieces), files, file_ord).where((line(0) != "") | (line(1) != ""))
    return rows.select("file_ord", F.col("record").alias("ord"), F.regexp_extract(head, r"^\S*", 0).alias("id"), F.when(rest != "", rest).alias("desc"), line(1).alias("seq"), line(3).alias("qual"))


def read_sequences(spark: SparkSession, paths: str | Sequence[str], fmt: str | None = None) -> DataFrame:
    """Records of one or more files in argument order; each file's format is given or follows its name."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        return spark.createDataFrame([], RECORD)
    parts, at = [], 0
    for p in paths:
        parts.append((read_fastq if detect_format(p, fmt) == "fastq" else read_fasta)(spark, p, at))
        at += max(1, len(spark.read.text(p).inputFiles())) if len(paths) > 1 else 1
    return reduce(DataFrame.unionByName, parts)


def record_iter(df: DataFrame) -> Iterator[Row]:
    """Records one after the other in input order; the driver holds a partition at a time."""
    return df.orderBy(*ORDER).toLocalIterator(prefetchPartitions=True)


def parse_records(spark: SparkSession, path: str, fmt: str | None = None) -> list[Row]:
    """All records of a small file as a list."""
    return list(record_iter(read_sequences(spark, path, fmt)))


def read_ids(spark: SparkSession, path: str | None = None, ids: Iterable[str] = ()) -> DataFrame:
    """The distinct ids of a file (one a line, trimmed, blanks dropped) and of a list."""
    out = spark.createDataFrame([(i,) for i in ids], "id string")
    if path:
        out = out.union(spark.read.text(path).select(F.trim(F.regexp_replace("value", r"\s", " ")).alias("id")))
    return out.where("id <> ''").distinct()


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """BED regions (schema REGION): lines of three fields or more but comments; bounds that are no numbers are an error."""
    rows = spark.read.text(path).select(F.regexp_replace("value", r"\r\z", "").alias("value"), _place(spark).alias("bed_ord"))
    fields = F.split("value", "\t")
    bound = lambda i: F.expr(f"CAST(trim(split(value, '\t')[{i}]) AS BIGINT)") if spark.conf.get("spark.sql.ansi.enabled") == "true" else F.coalesce(fields[i].cast("long"), F.raise_error(F.concat(F.lit("not a BED line: "), F.col("value"))))
    return rows.where(~F.col("value").startswith("#") & (F.trim("value") != "") & (F.size(fields) >= 3)).select("bed_ord", fields[0].alias("seq_id"), bound(1).alias("start"), bound(2).alias("end"), F.when(F.size(fields) > 3, F.get(fields, F.lit(3))).alias("name"))
