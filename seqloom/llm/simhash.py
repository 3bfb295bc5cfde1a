"""SimHash near-duplicates with pigeonring filtering.

Fingerprints are cut into a ring of SEGMENTS segments. If two differ in `most` bits or fewer, then from some segment on the
differences of the first l segments stay within l/SEGMENTS of `most`, for every l. With 4 bits and 5 segments that is 0 bits
in the first segment, 1 in two, 2 in three and so on. So fingerprints meet under the first two segments of each chain, one
of them with a bit of the second segment changed. Of what met under a chain, linked() keeps what stays within the chain's
budgets segment by segment; the last budget is the whole ring's, so what is left has the full distance checked too.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.shared import chunks, text_buffer, words, written

SEGMENTS, MOST_BITS = 5, 4
#: A bucket with more fingerprints than this is compared in pairs of blocks, dealt to tasks.
BLOCK = 50_000

# Fixed values of XXH64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _rotated(x: np.ndarray, n: int) -> np.ndarray:
    return x << np.uint64(n) | x >> np.uint64(64 - n)


def _round(acc, lane: np.ndarray) -> np.ndarray:
    return _rotated(acc + lane * _P2, 31) * _P1


def _xxh64(buf: np.ndarray, at: np.ndarray, size: int, seed: int) -> np.ndarray:
    """XXH64 of the byte ranges of one size that start at `at`; buf has eight spare bytes."""
    wide, half = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,)), np.ndarray((len(buf) - 3,), "<u4", buf, strides=(1,))
    done = 0
    with np.errstate(over="ignore"):
        s = np.uint64(seed)
        if size >= 32:
            v = [np.full(len(at), x, np.uint64) for x in (s + _P1 + _P2, s + _P2, s, s - _P1)]
            while size - done >= 32:
                v = [_round(x, wide[at + (done + 8 * i)]) for i, x in enumerate(v)]
                done += 32
            h = _rotated(v[0], 1) + _rotated(v[1], 7) + _rotated(v[2], 12) + _rotated(v[3], 18)
            for x in v:
                h = (h ^ _round(np.uint64(0), x)) * _P1 + _P4
        else:
            h = np.full(len(at), s + _P5, np.uint64)
        h += np.uint64(size)
        while size - done >= 8:
            h = _rotated(h ^ _round(np.uint64(0), wide[at + done]), 27) * _P1 + _P4
            done += 8
        if size - done >= 4:
            h = _rotated(h ^ half[at + done].astype(np.uint64) * _P1, 23) * _P2 + _P3
            done += 4
        while done < size:
            h = _rotated(h ^ buf[at + done].astype(np.uint64) * _P5, 11) * _P1
            done += 1
        h = (h ^ h >> np.uint64(33)) * _P2
        h = (h ^ h >> np.uint64(29)) * _P3
        return h ^ h >> np.uint64(32)


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many byte ranges, range size by range size."""
    size = ends - starts
    order = np.argsort(np.minimum(size, 65535).astype(np.uint16), kind="stable")
    kinds, first = np.unique(size[order], return_index=True)
    if len(kinds) > 1 and np.any(np.diff(size[order]) < 0):  # sizes of 64 KiB and more came in one class
        order = np.argsort(size, kind="stable")
        kinds, first = np.unique(size[order], return_index=True)
    out = np.empty(len(size), np.uint64)
    for n, i, j in zip(kinds.tolist(), first.tolist(), [*first[1:].tolist(), len(size)]):
        own = order[i:j]
        if n > 512 or len(own) < 4:
            raw = buf.data
            out[own] = [xxhash.xxh64_intdigest(raw[a : a + n], seed) for a in starts[own].tolist()]
        else:
            out[own] = _xxh64(buf, starts[own], n, seed)
    return out


def fingerprints_of(buf: np.ndarray, offs: np.ndarray, shingle: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """The SimHash of each text (A-Z lower-cased, word shingles joined by one space, repeats counted; 0 without words), and
    how many shingles it has."""
    low = buf.copy()
    upper = (low >= 65) & (low <= 90)
    low[upper] += 32
    starts, ends, heads = words(low, offs)
    size = ends - starts
    edge = np.concatenate([[0], np.cumsum(size + 1)])
    joined = np.full(int(edge[-1]) + 8, 32, np.uint8)
    put = np.ones(int(edge[-1]), bool)
    put[edge[1:] - 1] = False
    ink = np.zeros(int(offs[-1]) + 1, np.int8)
    ink[starts] += 1
    ink[ends] -= 1
    joined[: len(put)][put] = low[: int(offs[-1])][np.cumsum(ink[:-1], dtype=np.int8).astype(bool)]
    n = np.diff(heads)
    count = np.where(n > 0, np.maximum(n - shingle + 1, 1), 0)
    base = np.cumsum(count) - count
    first = np.repeat(heads[:-1] - base, count) + np.arange(count.sum())
    last = np.minimum(first + shingle, np.repeat(heads[1:], count))
    h = hashes(joined, edge[first], edge[last] - 1, seed)
    return majority(h, count), count


def majority(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The fingerprint of each run of `count` hashes: a bit is set if more than half of them have it; 0 for none."""
    base = np.cumsum(count) - count
    # sums of each bit: groups of 255 rows in bytes, then the groups of a text
    groups = -(-count // 255)
    of = np.repeat(base - 255 * (np.cumsum(groups) - groups), groups) + 255 * np.arange(groups.sum())
    out = np.zeros(len(count), np.uint64)
    if len(h):
        bits = np.unpackbits(np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        part = np.add.reduceat(bits, of, axis=0, dtype=np.uint8)
        some = np.flatnonzero(count)
        total = np.add.reduceat(part, (np.cumsum(groups) - groups)[some], axis=0, dtype=np.int64)
        out[some] = np.packbits(2 * total > count[some, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, shingle: int = 5, seed: int = 42) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) and shingles (their number) of every row of docs (doc_id, text)."""

    def run(batches):
        for b in batches:
            buf, offs = text_buffer(b.column("text"))
            out = [fingerprints_of(buf[offs[i] : offs[j] + 8], offs[i : j + 1] - offs[i], shingle, seed) for i, j in chunks(offs, 1 << 19)]
            fp, n = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.record_batch([b.column("doc_id"), pa.array(fp.view(np.int64)), pa.array(n.astype(np.int64))], ["doc_id", "fp", "shingles"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long, shingles long")


def ring(segments: int = SEGMENTS) -> list[tuple[int, int]]:
    """(shift, bits) of each segment of 64 bits."""
    edges = [64 * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _chain_keys(fp: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, row, whether it is the fingerprint's own) for each chain: its first two segments, also with a 0 bit of the second set.

    Two that differ in one bit of the second segment meet under the key of the one that has it.
    """
    parts = ring(segments)
    keys, rows, own = [], [], []
    everyone = np.arange(len(fp))
    for i in range(segments):
        (a, n), (b, m) = parts[i], parts[(i + 1) % segments]
        lead = fp >> np.uint64(a) & np.uint64((1 << n) - 1)
        follow = fp >> np.uint64(b) & np.uint64((1 << m) - 1)
        key = np.uint64(i << 32) | lead << np.uint64(16) | follow
        keys.append(key)
        rows.append(everyone)
        own.append(np.ones(len(fp), bool))
        for j in range(m):
            clear = np.flatnonzero(follow >> np.uint64(j) & np.uint64(1) == 0)
            keys.append(key[clear] | np.uint64(1 << j))
            rows.append(clear)
            own.append(np.zeros(len(clear), bool))
    return np.concatenate(keys), np.concatenate(rows), np.concatenate(own)


def linked(a: np.ndarray, b: np.ndarray, most: int = MOST_BITS, segments: int = SEGMENTS, chains: Iterable[int] | None = None) -> np.ndarray:
    """a x b: whether some chain (of those from the segments `chains`; None: from any) stays within all its budgets.

    The budget of l segments is l * most // segments, so that of the whole ring is `most`: the full distance.
    """
    x, parts = a[:, None] ^ b[None, :], ring(segments)
    out = np.zeros(x.shape, bool)
    for chain in range(segments) if chains is None else chains:
        mask, left = 0, None
        for length in range(1, segments + 1):
            shift, bits = parts[(chain + length - 1) % segments]
            mask |= (1 << bits) - 1 << shift
            if left is None and length < min(2, segments):
                continue  # two segments at once: most pairs go there
            if left is None:
                left = np.nonzero(np.bitwise_count(x & np.uint64(mask)) <= min(length * most // segments, most))
                if length == 2:
                    first = np.uint64((1 << parts[chain][1]) - 1 << parts[chain][0])
                    keep = np.bitwise_count(x[left] & first) <= most // segments
                    left = left[0][keep], left[1][keep]
            else:
                keep = np.bitwise_count(x[left] & np.uint64(mask)) <= length * most // segments
                left = left[0][keep], left[1][keep]
            if not len(left[0]):
                break
        out[left] = True
    return out


def alike(a: np.ndarray, b: np.ndarray, m: np.ndarray, n: np.ndarray, most: int, similarity: float | None, segments: int = SEGMENTS, chains: Iterable[int] | None = None) -> np.ndarray:
    """a x b: whether fingerprints of texts with m and n shingles link: linked(), and sizes that allow the similarity.

    Sets of m < n shingles are alike to m / n at most, different ones of n shingles to (n - 1) / (n + 1). So short texts,
    whose fingerprints say little, link if they are equal, and none links to an empty one.
    """
    ok = linked(a, b, most, segments, chains)
    if similarity is not None and ok.any():
        low, high = np.minimum(m[:, None], n[None, :]), np.maximum(m[:, None], n[None, :])
        ok &= low >= similarity * high
        ok &= (a[:, None] == b[None, :]) | (low < high) | (low - 1 >= similarity * (low + 1))
    return ok


def forest(fp: np.ndarray, node: np.ndarray, most: int = MOST_BITS, shingles: np.ndarray | None = None, similarity: float | None = None, segments: int = SEGMENTS, chains: Iterable[int] | None = None) -> list[tuple[int, int]]:
    """Links (node, one found before it) that span the components of all links among these fingerprints.

    Breadth first from the smallest node: each fingerprint is compared with those that no component has yet, a block at a time.
    """
    order = np.argsort(node, kind="stable")
    fp, node = fp[order], node[order]
    n = np.zeros(len(fp), np.int64) if shingles is None else shingles[order]
    left, out = np.arange(len(fp)), []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            block, front = front[:64], front[64:]
            parent = np.full(len(left), -1)
            for i in range(0, len(left), 8192):
                part = left[i : i + 8192]
                ok = alike(fp[block], fp[part], n[block], n[part], most, similarity, segments, chains)
                parent[i : i + 8192] = np.where(ok.any(axis=0), block[ok.argmax(axis=0)], -1)
            hit = parent >= 0
            if hit.any():
                out += [(x, y) for x, y in zip(node[left[hit]].tolist(), node[parent[hit]].tolist()) if x != y]
                front, left = np.concatenate([front, left[hit]]), left[~hit]
    return out


def links(nodes: DataFrame, most: int = MOST_BITS, segments: int = SEGMENTS, block: int = BLOCK, similarity: float | None = None) -> DataFrame:
    """Links (a, b) of nodes (node, fp, shingles) that are alike(); they join exactly what all such links would join.

    A bucket, that of one chain's first two segments, gives a spanning forest, not all its pairs. Buckets over `block` are dealt as
    pairs of blocks.
    """
    if 2 * most // segments > 1 or most // segments > 0:
        raise ValueError("chains of two segments need 2 * most < 2 * segments and most < segments")

    def deal(batches):
        for b in batches:
            fp, node, n = b.column("fp").to_numpy().view(np.uint64), b.column("node").to_numpy(), b.column("shingles").to_numpy()
            for i in range(0, len(fp), 20_000):
                key, row, own = _chain_keys(fp[i : i + 20_000], segments)
                yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(own), pa.array(fp[i + row].view(np.int64)), pa.array(node[i + row]), pa.array(n[i + row])], ["key", "own", "fp", "node", "shingles"])

    dealt = nodes.select("fp", "node", "shingles").mapInArrow(deal, "key long, own boolean, fp long, node long, shingles long")
    # a bucket with over `block` rows, own or borrowed from buckets a bit away, has or borrows block / 14 of some one bucket's
    own = nodes.select("fp").mapInArrow(_own_keys(segments), "key long").groupBy("key").agg(F.count("*").alias("n"))
    heavy = own.where(F.col("n") > block // 14).mapInArrow(_lent(segments), "key long, n long")
    large = written(heavy.groupBy("key").agg((F.sum("n") + block).alias("n")), "simhash-large")
    dealt = dealt.withColumn("i", F.lit(0)).withColumn("j", F.lit(0))
    if not large.isEmpty():
        blocks = F.ceil(2 * F.col("n") / block).cast("int")
        mine = F.pmod(F.xxhash64("fp"), blocks).cast("int")
        each = F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.struct(F.least(o, mine).alias("i"), F.greatest(o, mine).alias("j")))
        dealt = dealt.drop("i", "j").join(large, "key", "left").withColumn("pair", F.explode(F.when(F.col("n").isNotNull(), each).otherwise(F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))))).select("key", "own", "fp", "node", "shingles", "pair.i", "pair.j")
    order = ["key", "i", "j"]
    dealt = dealt.repartition(*order).sortWithinPartitions(*order).select(*order, "own", "fp", "node", "shingles")

    def join(batches):
        rest = None
        for b in batches:
            t = pa.Table.from_batches([*([rest] if rest is not None else []), b]).combine_chunks()
            cols = [t.column(x).to_numpy() for x in ("key", "i", "j")]
            new = np.ones(len(t), bool)
            if len(t):
                new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
            heads = np.flatnonzero(new)
            cut = int(heads[-1]) if len(heads) else 0  # the last group may go on
            yield from _forests(t.slice(0, cut), heads[:-1], most, similarity, segments)
            rest = t.slice(cut).combine_chunks().to_batches()[0] if cut < len(t) else None
        if rest is not None:
            yield from _forests(pa.Table.from_batches([rest]), np.zeros(1, np.int64), most, similarity, segments)

    return dealt.mapInArrow(join, "a long, b long").distinct()


def _own_keys(segments: int):
    def run(batches):
        for b in batches:
            key, _, own = _chain_keys(b.column("fp").to_numpy().view(np.uint64), segments)
            yield pa.record_batch([pa.array(key[own].view(np.int64))], ["key"])

    return run


def _lent(segments: int):
    """For mapInArrow, rows (key, n): the same, and n for each bucket that borrows from this one."""
    parts = ring(segments)

    def run(batches):
        for b in batches:
            key, n = b.column("key").to_numpy(), b.column("n").to_numpy()
            keys, counts = [key], [n]
            for j in range(max(m for _, m in parts)):
                wide = np.array([parts[(i + 1) % segments][1] for i in range(segments)])[key >> 32]
                clear = (j < wide) & (key >> j & 1 == 0)
                keys.append(key[clear] | 1 << j)
                counts.append(n[clear])
            yield pa.record_batch([pa.array(np.concatenate(keys)), pa.array(np.concatenate(counts))], ["key", "n"])

    return run


def _forests(t: pa.Table, heads: np.ndarray, most: int, similarity: float | None, segments: int) -> Iterator[pa.RecordBatch]:
    if not len(t):
        return
    own, fp, node, n = (t.column(x).to_numpy() for x in ("own", "fp", "node", "shingles"))
    fp, ends, out = fp.view(np.uint64), np.append(heads[1:], len(t)), []
    worth = np.flatnonzero((ends - heads > 1) & np.logical_or.reduceat(own, heads))
    for i, j in zip(heads[worth].tolist(), ends[worth].tolist()):
        _, once = np.unique(node[i:j], return_index=True)
        out += forest(fp[i:j][once], node[i:j][once], most, n[i:j][once], similarity, segments, [int(t.column("key")[i].as_py()) >> 32])
    a, b = zip(*out) if out else ((), ())
    yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) for each node of edges (a, b), a != b: alternating large and small stars.

    Each round is written to the shared folder; rounds end when the edges stay the same. Stars shrink by grouped minima and
    joins on written tables, whose hot keys Spark splits, so a component's hub is no task of its own.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")

    def stamp(df: DataFrame):
        r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        return r.n, r.h

    was = stamp(edges)
    while was[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")), "stars")
        # large star: neighbours above a node go to its least neighbour (or itself)
        above = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
        edges = written(above.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "edges")
        # small star: a node and its neighbours below go to the least of them
        least = written(edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "stars")
        moved = edges.join(least.where("n > 1"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(moved.union(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        now = stamp(edges)
        if now == was:
            break
        was = now
    top = edges.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(top)


def near_duplicates(docs: DataFrame, shingle: int = 5, most: int = MOST_BITS, segments: int = SEGMENTS, seed: int = 42, block: int = BLOCK, similarity: float | None = None) -> DataFrame:
    """doc_id, fp (signed) and component_id (the smallest doc_id reachable by links) of every row of docs (doc_id, text).

    Documents link if their fingerprints differ in `most` bits or fewer and, with a similarity, if the numbers of their
    shingles allow it (alike()). Equal ones are one node, so copies cost one row each. A null or empty text has fingerprint 0 and links like any other. A row without doc_id gets the component
    of rows with its fingerprint, null if none has an id. Rows that repeat a doc_id get a component each by their texts.
    """
    found = fingerprints(docs, shingle, seed)
    found = written(found if similarity is not None else found.withColumn("shingles", F.lit(0).cast("long")), "fingerprints")
    nodes = written(found.where("doc_id is not null").groupBy("fp", "shingles").agg(F.min("doc_id").alias("node")), "nodes")
    grouped = components(links(nodes, most, segments, block, similarity))
    known = written(nodes.join(grouped, "node", "left").select("fp", "shingles", F.coalesce("component", "node").alias("component_id")), "components")
    return found.join(known, ["fp", "shingles"], "left").select("doc_id", "fp", "component_id")


def hexadecimal(fp: Column) -> Column:
    """A signed long as 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
