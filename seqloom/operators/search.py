"""search: exact, approximate and regular-expression motifs on one or both strands."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions import sequence as S
from seqloom.schema import HIT

_COMPLEMENT = str.maketrans("ATUGC", "TAACG")
_NUCLEOTIDE = re.compile(rf"[{S.NUCLEOTIDES}]+")
#: Bytes of sequences that one pass of the kernel holds; a longer sequence is read in overlapping slices.
CHUNK = 1 << 20


def reverse_complement(pattern: str) -> str:
    """The reverse complement of a pattern."""
    return pattern.upper()[::-1].translate(_COMPLEMENT)


def both_strands(pattern: str, regex: bool = False) -> bool:
    """Whether a pattern is looked for on the reverse strand: literal nucleotides are."""
    return not regex and bool(_NUCLEOTIDE.fullmatch(pattern))


def count_hits(df: DataFrame, pattern: str) -> DataFrame:
    """Records with `forward` and `reverse`: how often the pattern occurs, overlaps included, in either case.

    One expression of Spark's own: a look-ahead finds every start. reverse is 0 for records or patterns that are no nucleotides.
    """
    if not pattern:
        raise ValueError("a pattern has one letter or more")

    def count(p: str):
        return F.regexp_count(F.upper("seq"), F.lit(f"(?={re.escape(p.upper())})")).cast("long")

    reverse = F.when(S.is_nucleotide("seq"), count(reverse_complement(pattern))).otherwise(0) if both_strands(pattern) else F.lit(0)
    return df.withColumn("forward", count(pattern)).withColumn("reverse", reverse.cast("long"))


def _upper(x: np.ndarray) -> np.ndarray:
    return np.where((x >= 97) & (x <= 122), x - 32, x)


def _starts(upper: np.ndarray, ends: np.ndarray, pattern: bytes, mismatches: int) -> np.ndarray:
    """Positions where the pattern fits with at most so many mismatches and stays inside its sequence. ends: for each position, that of its sequence."""
    k = len(pattern)
    if len(upper) < k:
        return np.zeros(0, np.int64)
    p = np.frombuffer(pattern, np.uint8)
    if mismatches == 0:
        at = np.flatnonzero(upper[: len(upper) - k + 1] == p[0])
        for j in range(1, k):
            at = at[upper[at + j] == p[j]]
    else:
        wrong = np.zeros(len(upper) - k + 1, np.int32)
        for j in range(k):
            wrong += upper[j : len(upper) - k + 1 + j] != p[j]
        at = np.flatnonzero(wrong <= mismatches)
    return at[at + k <= ends[at]]


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)), offs - offs[0]


_SCHEMA = pa.schema([("file_ord", pa.int32()), ("ord", pa.int64()), ("id", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("matched", pa.string()), ("strand", pa.string())])


def _literal_hits(b: pa.RecordBatch, patterns: list[tuple[str, bytes, bool]], mismatches: int) -> Iterator[pa.RecordBatch]:
    """Hits of the records of a batch; a pattern: strand, letters, whether only nucleotide records count."""
    raw, offs = _texts(b.column("seq"))
    k, letters_ok = len(patterns[0][1]), np.zeros(256, bool)
    letters_ok[np.frombuffer(S.NUCLEOTIDES.encode(), np.uint8)] = True
    most = max(1, min(CHUNK, (1 << 30) // k))  # the matched texts of a pass stay under two gigabytes
    first = 0
    while first < len(b):
        last = max(first + 1, int(np.searchsorted(offs, offs[first] + most, "right")) - 1)
        lo, hi = int(offs[first]), int(offs[last])
        if hi - lo > most:  # one long sequence: slices overlap by the pattern's length less one
            whole = not patterns[-1][2] or all(letters_ok[raw[i : min(i + most, hi)]].all() for i in range(lo, hi, most))
            kept = [p for p in patterns if whole or not p[2]]
            for i in range(lo, hi, most):
                at, strands, matched = _slice_hits(raw[i : min(i + most + k - 1, hi)], kept, mismatches, most)
                begin, index = at + (i - lo), pa.array(np.full(len(at), first))
                text = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer((np.arange(len(at) + 1) * k).astype(np.int32).tobytes()), pa.py_buffer(matched.tobytes())])
                names = pa.array([p[0] for p in kept]).take(pa.array(strands))
                yield pa.record_batch([b.column("file_ord").take(index), b.column("ord").take(index), b.column("id").take(index), pa.array(begin), pa.array(begin + k), text, names], schema=_SCHEMA)
            first = last
            continue
        own, edge = raw[lo:hi], offs[first : last + 1] - lo
        row = np.repeat(np.arange(last - first), np.diff(edge))
        upper, ends = _upper(own), edge[1:][row]
        allowed = letters_ok[own]
        bad = np.zeros(last - first, np.int64)
        np.add.at(bad, row[~allowed], 1)
        rows, starts, strands = [], [], []
        for n, (strand, letters, nucleotides) in enumerate(patterns):
            at = _starts(upper, ends, letters, mismatches)
            r = row[at]
            if nucleotides:
                at, r = at[bad[r] == 0], r[bad[r] == 0]
            rows.append(r)
            starts.append(at)
            strands.append(np.full(len(at), n))
        r, at, strand = (np.concatenate(x) for x in (rows, starts, strands))
        order = np.lexsort((at, strand, r))
        r, at, strand = r[order], at[order], strand[order]
        matched = own[at[:, None] + np.arange(k)] if len(at) else np.zeros((0, k), np.uint8)
        begin = at - edge[r]
        index = pa.array(first + r)
        text = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer((np.arange(len(at) + 1) * k).astype(np.int32).tobytes()), pa.py_buffer(matched.tobytes())])
        names = pa.array([p[0] for p in patterns]).take(pa.array(strand))
        yield pa.record_batch([b.column("file_ord").take(index), b.column("ord").take(index), b.column("id").take(index), pa.array(begin), pa.array(begin + k), text, names], schema=_SCHEMA)
        first = last


def _slice_hits(own: np.ndarray, patterns: list[tuple[str, bytes, bool]], mismatches: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, patterns, texts) of the hits that start in the first `most` letters of a part of one sequence."""
    upper, ends = _upper(own), np.full(len(own), len(own))
    found = [_starts(upper, ends, letters, mismatches) for _, letters, _ in patterns]
    found = [at[at < most] for at in found]
    at = np.concatenate(found)
    matched = own[at[:, None] + np.arange(len(patterns[0][1]))] if len(at) else np.zeros((0, len(patterns[0][1])), np.uint8)
    return at, np.repeat(np.arange(len(found)), [len(x) for x in found]), matched


def find_hits(df: DataFrame, pattern: str, mismatches: int = 0, regex: bool = False, ordered: bool = False) -> DataFrame:
    """A row for each hit (schema HIT): start and end are 0-based on the forward strand, matched is the record's own text.

    A literal pattern is found in either case, overlaps included, with at most `mismatches` letters changed; if pattern and
    record are nucleotides its reverse complement is found too (strand -, so a palindrome gives both). A regular expression
    is matched as typed against the upper-cased sequence, leftmost and without overlaps, on the forward strand; ValueError
    for one that Python can't read.
    Records shorter than the pattern have no hits. ordered: input order, + before -, ascending starts.
    """
    if not pattern:
        raise ValueError("a pattern has one letter or more")
    if mismatches < 0:
        raise ValueError("mismatches are 0 or more")
    records = df.select("file_ord", F.col("ord").cast("long"), "id", "seq")
    if regex:
        text = S.checked_regex(pattern).replace(r"\z", r"\Z").replace("(?<", "(?P<")
        try:
            re.compile(text)
        except re.error as e:
            raise ValueError(f"not a regular expression here: {pattern!r}: {e}") from None

        def run(batches):
            compiled = re.compile(text)
            for b in batches:
                rows = []
                for f, o, i, s in zip(*(c.to_pylist() for c in b.columns)):
                    rows += [(f, o, i, m.start(), m.end(), m[0], "+") for m in compiled.finditer((s or "").upper())]
                cols = list(zip(*rows)) or [()] * len(_SCHEMA)
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, _SCHEMA)], schema=_SCHEMA)
    else:
        patterns = [("+", pattern.upper().encode(), False)]
        if both_strands(pattern):
            patterns.append(("-", reverse_complement(pattern).encode(), True))

        def run(batches):
            for b in batches:
                yield from _literal_hits(b, patterns, mismatches)

    hits = records.mapInArrow(run, HIT)
    return hits.orderBy("file_ord", "ord", "strand", "start") if ordered else hits


def hit_lines(hits: DataFrame, bed: bool = False, strand: bool = False) -> DataFrame:
    """The order columns of hits and `value`: `id:first-last`, text and strand, or BED lines (six columns with `strand`)."""
    if not bed:
        place = F.concat("id", F.lit(":"), (F.col("start") + 1).cast("string"), F.lit("-"), F.col("end").cast("string"))
        columns = [place, F.col("matched"), F.col("strand")]
    else:
        columns = [F.col("id"), F.col("start").cast("string"), F.col("end").cast("string"), F.col("matched"), *([F.lit("0"), F.col("strand")] if strand else [])]
    return hits.select("file_ord", "ord", "strand", "start", F.concat_ws("\t", *columns).alias("value"))
