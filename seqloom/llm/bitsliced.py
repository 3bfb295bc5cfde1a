"""Exact top-k by inner product over a bit-sliced index.

Vectors of integers are kept in blocks. A block, a row of the written index, holds each attribute's upper bits as bitmaps over its
rows, a bitmap for each bit. A query's weighted sum of attributes is made by bitmap arithmetic alone: the slices of attribute d go in at every
set bit of the query's weight, slices of one weight are added three to two (full adders over whole bitmaps). The k best rows
are then found from the most significant slice of the sum downward. The bits that were left out give a bound on the error,
and the rows within that bound of the k-th best are resolved by the whole integers. Blocks of queries meet blocks of the
index pair by pair, each pair a row of one distributed join, whose tasks return k rows a query at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.shared import written

BLOCK, KEPT_BITS, QUERIES = 8192, 7, 256
#: Pairs of blocks in one Arrow batch: a pair takes some two megabytes.
PAIRS_AT_ONCE = 8


def quantised(embedding: pa.Array, scale: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their components floor(scale * x) as long); shorter vectors, also empty ones, end in zeros.

    A component of 2**62 or more raises OverflowError: scores of it would not be longs.
    """
    rows = [None if v is None or None in v else np.asarray(v, np.float64) for v in embedding.to_pylist()]
    keep = [i for i, v in enumerate(rows) if v is not None and np.isfinite(v).all()]
    wide = max((len(rows[i]) for i in keep), default=0)
    out = np.zeros((len(keep), wide), np.int64)
    for at, i in enumerate(keep):
        v = np.floor(scale * rows[i])
        if len(v) and np.abs(v).max() >= 2.0**62:
            raise OverflowError(f"a component of {np.abs(rows[i]).max()} is too large for integers of 64 bits")
        out[at, : len(v)] = v
    return np.array(keep, np.int64), out


def scores(values: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows of integers with q, as longs; OverflowError if one is none."""
    if values.size and float(np.abs(q).astype(np.float64).sum()) * float(np.abs(values).max()) >= 2.0**62:
        exact = values.astype(object) @ q.astype(object)
        if any(not -(1 << 63) <= x < 1 << 63 for x in exact):
            raise OverflowError("an inner product is too large for an integer of 64 bits")
        return exact.astype(np.int64)
    return values.astype(np.int64) @ q


def added(columns: dict[int, list[np.ndarray]]) -> list[np.ndarray]:
    """The sum of bitmap numbers as slices from the least significant: columns[w] holds bitmaps (rows of arrays) of weight 2**w."""
    out, w = [], 0
    while columns:
        parts = columns.pop(w, None)
        if not parts:
            out.append(None)
            w += 1
            continue
        x = np.concatenate(parts)
        while len(x) > 1:
            if len(x) == 2:
                carry, x = x[:1] & x[1:], x[:1] ^ x[1:]
            else:
                n = len(x) // 3
                a, b, c = x[:n], x[n : 2 * n], x[2 * n : 3 * n]
                half = a ^ b
                carry = (a & b) | (half & c)
                x = np.concatenate([half ^ c, x[3 * n :]])
            columns.setdefault(w + 1, []).append(carry)
        out.append(x[0])
        w += 1
    return out


class Block:
    """Slices of the vectors of one block: attribute d's value is low[d] + u, and `kept` upper bits of u are stored."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, kept: int = KEPT_BITS):
        self.ids, self.values, self.n = ids, values, len(ids)
        self.low = values.min(axis=0)
        u = values - self.low
        width = max(1, int(u.max(initial=0)).bit_length())
        self.kept = min(kept, width)
        self.shift = width - self.kept
        u >>= self.shift
        padded = -(-self.n // 64) * 64
        bits = np.zeros((values.shape[1], self.kept, padded), bool)
        for i in range(self.kept):
            bits[:, i, : self.n] = (u >> i & 1).T.astype(bool)
        self.slices = np.packbits(bits, axis=2, bitorder="little").view(np.uint64)
        rows = np.zeros(padded, bool)
        rows[: self.n] = True
        self.rows = np.packbits(rows, bitorder="little").view(np.uint64)

    def stored(self) -> dict:
        """The index row of the block."""
        small = next(t for t in (np.int16, np.int32, np.int64) if not self.values.size or (np.iinfo(t).min <= self.values.min() and self.values.max() <= np.iinfo(t).max))
        return {"ids": self.ids.tobytes(), "low": self.low.tobytes(), "kept": self.kept, "shift": self.shift, "slices": self.slices.tobytes(), "vectors": self.values.astype(small).tobytes(), "width": np.dtype(small).itemsize}

    @staticmethod
    def of(row: dict) -> Block:
        """The block of an index row, without slicing again."""
        b = Block.__new__(Block)
        b.ids, b.low, b.kept, b.shift = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["low"], np.int64), row["kept"], row["shift"]
        b.n = len(b.ids)
        words = -(-b.n // 64)
        b.slices = np.frombuffer(row["slices"], np.uint64).reshape(len(b.low), b.kept, words)
        b.values = np.frombuffer(row["vectors"], f"<i{row['width']}").reshape(b.n, len(b.low))
        rows = np.zeros(64 * words, bool)
        rows[: b.n] = True
        b.rows = np.packbits(rows, bitorder="little").view(np.uint64)
        return b

    def _marked(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little")[: self.n])

    def top(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows but the query's own, ties to smaller ids."""
        dims = min(len(q), len(self.low))
        q = q[:dims]
        weight, columns = np.abs(q), {}
        for d in np.flatnonzero(weight).tolist():
            own = ~self.slices[d] & self.rows if q[d] < 0 else self.slices[d]
            for j in range(int(weight[d]).bit_length()):
                if weight[d] >> j & 1:
                    for i in range(self.kept):
                        columns.setdefault(i + j, []).append(own[i : i + 1])
        total = added(columns)
        total = [np.zeros_like(self.rows) if x is None else x for x in total]
        alive = self.rows.copy()
        for r in np.flatnonzero(self.ids == query_id).tolist():
            alive[r >> 6] &= ~np.uint64(1 << (r & 63))
        if int(np.bitwise_count(alive).sum()) > k:
            # the k-th best sum is at least `floor`
            above, tied, floor = np.zeros_like(alive), alive, 0
            for w in range(len(total) - 1, -1, -1):
                more = above | tied & total[w]
                n = int(np.bitwise_count(more).sum())
                if n >= k:
                    floor |= 1 << w
                    if n == k:
                        break
                    tied = tied & total[w]
                else:
                    above, tied = more, tied & ~total[w]
            # what was left out adds or takes at most this much, in units of the stored bits
            slack = sum(weight.tolist()) * ((1 << self.shift) - 1)
            least = max(0, floor - (slack >> self.shift) - (slack & ((1 << self.shift) - 1) > 0))
            greater, equal = np.zeros_like(alive), alive
            for w in range(max(len(total), least.bit_length()) - 1, -1, -1):
                s = total[w] if w < len(total) else np.zeros_like(alive)
                if least >> w & 1:
                    equal = equal & s
                else:
                    greater, equal = greater | equal & s, equal & ~s
            alive = greater | equal
        rows = self._marked(alive)
        score = scores(self.values[rows][:, :dims], q)
        order = np.lexsort((self.ids[rows], -score))[:k]
        return self.ids[rows][order], score[order]


def _blocks(rows: DataFrame, scale: int, block: int, row, schema: str, tag: str) -> tuple[DataFrame, int]:
    """(a written table with a row for each `block` vectors, made by row(ids, values), and its number from 0; how many there are)."""

    def run(batches):
        ids, values, part, n = [], [], TaskContext.get().partitionId(), 0

        def flush(last):
            nonlocal n
            while sum(map(len, ids)) >= (1 if last else block):
                wide = max(v.shape[1] for v in values)
                i, v = np.concatenate(ids), np.concatenate([np.pad(v, ((0, 0), (0, wide - v.shape[1]))) for v in values])
                ids[:], values[:] = [i[block:]], [v[block:]]
                yield pa.RecordBatch.from_pylist([{"part": part, "at": n, **row(i[:block], v[:block])}], layout)
                n += 1

        for b in batches:
            keep, v = quantised(b.column("embedding"), scale)
            ids.append(b.column("vec_id").to_numpy(zero_copy_only=False)[keep].astype(np.int64))
            values.append(v)
            yield from flush(False)
        if ids:
            yield from flush(True)

    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    schema = f"part int, at int, {schema}"
    layout = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")])
    table = written(rows.mapInArrow(run, schema), tag)
    first, at = [], 0
    for r in sorted(table.groupBy("part").agg(F.count("*").alias("n")).collect()):  # a row for each partition
        first.append((r.part, at))
        at += r.n
    bases = table.sparkSession.createDataFrame(first, "part int, first int")
    return table.join(F.broadcast(bases), "part").withColumn("number", F.col("first") + F.col("at")).drop("part", "at", "first"), at


def build_index(vectors: DataFrame, scale: int = 256, block: int = BLOCK, kept: int = KEPT_BITS) -> tuple[DataFrame, int]:
    """The written index and its number of blocks: up to `block` vectors (vec_id, embedding) each, as slices, ids and integers."""
    rows = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    return _blocks(rows, scale, block, lambda i, v: Block(i, v, kept).stored(), "ids binary, low binary, kept int, shift int, slices binary, vectors binary, width int", "bitsliced")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, block: int = BLOCK, kept: int = KEPT_BITS, at_once: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best vectors, all if there are fewer.

    vectors and queries: vec_id and embedding, other columns are ignored. Scores are inner products of floor(scale * x);
    ties go to the smaller vec_id; a query's own id is no candidate. Vectors that are null or hold a null or non-finite
    component take no part, nor do rows without vec_id. A shorter vector ends in zeros, an empty one is all zeros. A repeated
    id is a candidate each time, and one query, by its least vector. What is no long raises OverflowError. Blocks of at_once
    queries meet each block of the index in one job.
    """
    spark = vectors.sparkSession
    index, n = build_index(vectors, scale, block, kept)
    once = queries.where("vec_id is not null").groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(F.col("embedding").cast("array<double>")).alias("embedding"))
    asked, m = _blocks(once, scale, at_once, lambda i, v: {"queries": i.tobytes(), "weights": v.tobytes()}, "queries binary, weights binary", "queries")
    schema = "query_id long, vec_id long, score long"

    def run(batches):
        last, held = None, None
        for b in batches:
            for row in b.to_pylist():
                if row["number"] != last:
                    last, held = row["number"], Block.of(row)
                ids = np.frombuffer(row["queries"], np.int64)
                weights = np.frombuffer(row["weights"], np.int64).reshape(len(ids), -1)
                found = [(np.full(len(i), q), i, s) for q, v in zip(ids.tolist(), weights) for i, s in [held.top(q, v, k)]]
                yield pa.record_batch([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*found)], ["query_id", "vec_id", "score"])

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, str(PAIRS_AT_ONCE))  # holds for what is written here
    try:
        left = index.withColumn("ask", F.explode(F.sequence(F.lit(0), F.lit(max(0, m - 1)))))
        right = asked.withColumnRenamed("number", "ask").withColumn("number", F.explode(F.sequence(F.lit(0), F.lit(max(0, n - 1)))))
        found = written(left.join(right, ["number", "ask"]).mapInArrow(run, schema), "topk")
    finally:
        spark.conf.set(name, was)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
