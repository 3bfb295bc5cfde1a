"""Near duplicates by the exact Jaccard similarity of word shingles: SimHash first, prefix filtering for the rest.

Fingerprints of sets that are alike differ in few bits, mostly; so the pigeonring of simhash.links() finds most copies with
few changes, but a similarity of 0.8 alone may mean ten bits and more. What it can't reach, prefix filtering finds: shingles
have one order for all texts. If two sets of n and m shingles have a similarity of t or more, they share t / (1 + t) * (n + m)
shingles or more, so the first n - ceil(t * n) + 1 of one and the like of the other have one in common; at the first that
they share, enough shingles must be left in both. So sets meet under the shingles of their prefixes, and no pair of the
similarity is lost, whatever the order is. It only decides how many meet: shingles that a sample of texts has often
come last. Each candidate, of either way, is decided by its whole sets.

First each set is compared with one that it met, the least; copies of one text are joined by that. Pairs that are not joined
then must also pass a second fingerprint, which holds a bit for each class of shingles: whether the set has an odd number of
them. Each shingle that only one of two sets has flips one bit, so sets that differ in d shingles differ in d bits or fewer:
no pair of the similarity is lost here either. For TURNS turns each set is compared with the one nearest to it by that, as
long as that joins any; then all pairs of different components that are left are compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.shared import BROADCAST_BYTES, chunks, mixed, packed5, text_buffer, unpacked5, word_hashes, words, written
from seqloom.llm.simhash import components, links, majority

#: Texts whose shingles are counted for the order, and the count from which one comes late.
COUNTED, OFTEN = 4000, 3
#: A group of more sets than this is first compared with its LEADERS, then in those pairs that no link has joined yet.
LARGE, LEADERS = 2, 1
#: A group under a shingle that more sets seem to have is dealt in parts of about that many, whose leaders meet again; rows of a
#: group that are compared at once.
PART, BLOCK = 4096, 2000
#: Turns in which each set is compared with its nearest one alone.
TURNS = 3
#: Sets that are compared with one set in one task.
HUB = 256
#: The most bits of a set's fingerprint of odd classes; it has as many as shingles, rounded up to a power of two.
MOST_CLASSES = 1 << 16
#: Bytes of links (two numbers each) up to which the driver finds their components; beyond it Spark does.
FEW_LINKS = 4 << 20
#: Prefix rows that a task holds before it sends them on.
HELD = 1_000_000
_M1, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x94D049BB133111EB)
_SLACK = 1e-9
#: Sizes are sent as logarithms to this base, places as so many parts of the size; both are read with that much slack.
_BASE, _PARTS = 1.0005, 250


def shingle_sets(buf: np.ndarray, offs: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, edges): the ascending distinct hashes of each text's word shingles (A-Z lower-cased); a shorter text is one."""
    low = buf.copy()
    low[(low >= 65) & (low <= 90)] += 32
    starts, ends, heads = words(low, offs)
    h = word_hashes(low, starts, ends)
    n = np.diff(heads)
    count = np.where(n > 0, np.maximum(n - shingle + 1, 1), 0)
    first = np.repeat(heads[:-1] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    width = np.repeat(np.minimum(n, shingle), count)
    g = np.zeros(len(first), np.uint64)
    for j in range(shingle if len(h) else 0):
        g = np.where(width > j, mixed((g ^ h[np.minimum(first + j, len(h) - 1)]) * _M1 + _M3), g)
    doc = np.repeat(np.arange(len(n)), count)
    g = g[np.lexsort((g, doc))]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    return g[new], np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=len(n)))])


def odd_classes(g: np.ndarray, edges: np.ndarray) -> list[bytes]:
    """For each set a bit for each class of shingles, those equal in their lower bits: whether it has an odd number of them."""
    n = np.diff(edges)
    wide = np.minimum(MOST_CLASSES, 1 << np.maximum(6, np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64)))
    base = np.cumsum(wide) - wide
    at = np.repeat(base, n) + (g & np.repeat(wide - 1, n).astype(np.uint64)).astype(np.int64)
    raw = np.packbits(np.bincount(at, minlength=int(wide.sum())).astype(np.uint8) & 1, bitorder="little").tobytes()
    return [raw[a : a + m] for a, m in zip((base // 8).tolist(), (wide // 8).tolist())]


def _folded(raw: list[bytes], words: int) -> np.ndarray:
    """Fingerprints of odd classes as rows of `words` 64-bit words: the halves of wider ones are added, bit by bit."""
    out = np.zeros((len(raw), words), np.uint64)
    for i, x in enumerate(raw):
        v = np.frombuffer(x, np.uint64)
        if len(v) >= words:
            out[i] = np.bitwise_xor.reduce(v.reshape(-1, words), axis=0)
    return out


def _sets(batches, shingle: int, once: bool = True) -> Iterator[tuple]:
    """(first row, batch, hashes, edges, nodes, rows to use) of chunks of batches (doc_id, text); a node is a hash of a set.

    With once, only the first row of a task with a set is to be used.
    """
    seen: set = set()
    for b in batches:
        buf, offs = text_buffer(b.column("text"))
        for i, j in chunks(offs):
            g, edges = shingle_sets(buf[offs[i] : offs[j] + 8], offs[i : j + 1] - offs[i], shingle)
            raw, cut = g.tobytes(), (8 * edges).tolist()
            nodes = [xxhash.xxh3_64_intdigest(raw[x:y]) for x, y in zip(cut, cut[1:])]
            use = np.ones(len(nodes), bool)
            if once:
                for k, node in enumerate(nodes):
                    use[k] = node not in seen
                    seen.add(node)
            yield i, b, g, edges, np.array(nodes, np.uint64), use


def _prefixes(g: np.ndarray, edges: np.ndarray, often: np.ndarray, times: np.ndarray, similarity: float) -> tuple[np.ndarray, ...]:
    """(shingle, set, place, how often it was counted) of each set's prefix: by how often a shingle was counted, then by its hash."""
    n = np.diff(edges)
    of = np.repeat(np.arange(len(n)), n)
    late = np.zeros(len(g), np.int64)
    if len(often):
        at = np.minimum(np.searchsorted(often, g), len(often) - 1)
        late = np.where(often[at] == g, times[at], 0)
    order = np.lexsort((g, late, of))
    place = np.arange(len(g)) - np.repeat(edges[:-1], n)
    kept = place < np.repeat(n - np.ceil(similarity * n - _SLACK) + 1, n)
    return g[order][kept], of[kept], place[kept], late[order][kept]


def _possible(x, y, i, j, similarity: float):
    """Whether sets whose sizes are sent as x and y, with the first common shingle at the parts i and j, can have the similarity."""
    n, m = _BASE ** np.asarray(x, np.float64), _BASE ** np.asarray(y, np.float64)
    most = _BASE * (1 + _SLACK)
    left = np.minimum(n * most * (1 - np.asarray(i) / _PARTS), m * most * (1 - np.asarray(j) / _PARTS))
    return (np.minimum(n, m) * most >= similarity * np.maximum(n, m)) & (left >= similarity / (1 + similarity) * (n + m) * (1 - _SLACK))


_ROW = np.dtype([("node", "<u8"), ("size", "<u2"), ("place", "u1")])
#: Rows under a frequent shingle also hold that shingle: they are dealt by another hash.
_LATE = np.dtype([*_ROW.descr, ("token", "<u8")])


def _dealt(docs: DataFrame, shingle: int, similarity: float, order, share: int, bits: int, part: int) -> DataFrame:
    """(bucket, late, part) of the prefixes of all sets: blocks of rows by the top bits of the shingle, 16 bytes a row.

    One of `share` texts was counted. A shingle that by that over `part` sets have is dealt by a hash of the set as well.
    """

    def run(batches):
        held, size = {False: [], True: []}, 0

        def send():
            for late, own in held.items():
                if not own:
                    continue
                token, rows = (np.concatenate(x) for x in zip(*own))
                at = np.argsort(token, kind="stable")
                token, rows = token[at], rows[at]
                bucket = token >> np.uint64(64 - bits)
                heads = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(token) else np.zeros(0, np.int64)
                rest = token >> np.uint64(24 - bits) & np.uint64((1 << 40) - 1)
                parts = [packed5(rest[i:j]) + rows[i:j].tobytes() for i, j in zip(heads.tolist(), np.append(heads[1:], len(token)).tolist())]
                yield pa.record_batch([pa.array(bucket[heads].astype(np.int64)), pa.array(np.full(len(heads), late)), pa.array(parts, pa.binary())], ["bucket", "late", "part"])

        for _, _, g, edges, nodes, use in _sets(batches, shingle):
            n = np.diff(edges)
            g, n, nodes = g[np.repeat(use, n)], n[use], nodes[use]
            token, of, place, times = _prefixes(g, np.concatenate([[0], np.cumsum(n)]), *order.value, similarity)
            parts = times * share // part + 1
            late = parts > 1
            rows = np.zeros(len(token), _LATE)
            rows["node"], rows["token"] = nodes[of], token
            rows["size"] = np.floor(np.log(n[of]) / math.log(_BASE))
            rows["place"] = place * _PARTS // n[of]
            held[False].append((token[~late], rows[~late][list(_ROW.names)].astype(_ROW)))
            held[True].append((mixed(token ^ mixed(nodes[of] % parts.astype(np.uint64) + np.uint64(1)))[late], rows[late]))
            size += len(token)
            if size >= HELD:
                yield from send()
                held, size = {False: [], True: []}, 0
        yield from send()

    return docs.mapInArrow(run, "bucket long, late boolean, part binary").repartition("bucket").sortWithinPartitions("bucket", "late")


def _met(token: np.ndarray, rows: np.ndarray, similarity: float, large: int, leaders: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows sorted by token, each node once in a group: pairs (a, b) of nodes of small groups and with the leaders of large
    ones, which are their first; whether each row is of a group of two or more."""
    heads = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
    m = np.diff(np.append(heads, len(token)))
    of = np.repeat(np.arange(len(heads)), m)
    many = m[of] > large
    x, y = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d in range(1, min(large, int(m.max(initial=0)))):
        i = np.flatnonzero((of[d:] == of[:-d]) & ~many[d:])
        x.append(i)
        y.append(i + d)
    own = np.flatnonzero(many)
    for k in range(leaders):
        x.append(heads[of[own]] + k)
        y.append(own)
    x, y = np.concatenate(x), np.concatenate(y)
    ok = (x != y) & _possible(rows["size"][x], rows["size"][y], rows["place"][x], rows["place"][y], similarity)
    a, b = rows["node"][x[ok]], rows["node"][y[ok]]
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    return pairs[0], pairs[1], m[of] > 1


_FOUND = "kind int, a long, b long, token long, size long, place long"


def _found(kind: int, a: np.ndarray, b: np.ndarray | None = None, token: np.ndarray | None = None, rows: np.ndarray | None = None) -> pa.RecordBatch:
    none = pa.nulls(len(a), pa.int64())
    cols = [none] * 3 if rows is None else [pa.array(token.view(np.int64)), pa.array(rows["size"].astype(np.int64)), pa.array(rows["place"].astype(np.int64))]
    second = none if b is None else pa.array(b.view(np.int64))
    return pa.record_batch([pa.array(np.full(len(a), kind, np.int32)), pa.array(a.view(np.int64)), second, *cols], [x.split()[0] for x in _FOUND.split(", ")])


def _groups(similarity: float, large: int, leaders: int, bits: int):
    """For mapInArrow, rows of _dealt(). Kind 0: pairs (a, b). Kind 1: the rows of groups and of frequent shingles. Kind 2: the
    first rows of what a frequent shingle was dealt to, which meet again."""

    def found(bucket, late, parts):
        kind = _LATE if late else _ROW
        n = [len(p) // (5 + kind.itemsize) for p in parts]
        token = np.concatenate([unpacked5(p[: 5 * k], k) for p, k in zip(parts, n)])
        rows = np.concatenate([np.frombuffer(p, kind, k, 5 * k) for p, k in zip(parts, n)])
        token = np.uint64(bucket) << np.uint64(64 - bits) | token << np.uint64(24 - bits)
        own = np.lexsort((rows["node"], token))
        token, rows = token[own], rows[own]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (rows["node"][1:] != rows["node"][:-1])  # copies in other tasks
        token, rows = token[new], rows[new]
        a, b, group = _met(token, rows, similarity, large, leaders)
        yield _found(0, a, b)
        if late:
            yield _found(1, rows["node"].copy(), None, rows["token"].copy(), rows)
            first = np.ones(len(token), bool)
            first[1:] = token[1:] != token[:-1]
            yield _found(2, rows["node"][first], None, rows["token"][first], rows[first])
        elif group.any():
            yield _found(1, rows["node"][group], None, token[group], rows[group])

    def run(batches):
        of, parts = None, []
        for b in batches:
            for bucket, late, part in zip(b.column("bucket").to_pylist(), b.column("late").to_pylist(), b.column("part").to_pylist()):
                if (bucket, late) != of and parts:
                    yield from found(*of, parts)
                    parts = []
                of = bucket, late
                parts.append(part)
        if parts:
            yield from found(*of, parts)

    return run


def _whole_groups(batches, keys: list[str]) -> Iterator[pa.Table]:
    """Batches sorted by keys as tables that hold the rows of each key whole."""
    rest = []
    for b in batches:
        if not len(b):
            continue
        cols = [b.column(k).to_numpy() for k in keys]
        head = int(np.argmax(np.logical_and.reduce([c == c[-1] for c in cols])))
        if head or (rest and any(rest[-1].column(k)[-1].as_py() != c[0].item() for k, c in zip(keys, cols))):
            yield pa.Table.from_batches([*rest, b.slice(0, head)]).combine_chunks()
            rest = []
        rest.append(b.slice(head))
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks()


def _again(similarity: float, large: int, leaders: int):
    """For mapInArrow, rows (token, node, size, place) sorted by token and node: the pairs of _met()."""

    def run(batches):
        for t in _whole_groups(batches, ["token"]):
            token, node, size, place = (t.column(x).to_numpy() for x in ("token", "node", "size", "place"))
            rows = np.zeros(len(t), _ROW)
            rows["node"], rows["size"], rows["place"] = node.view(np.uint64), size, place
            a, b, _ = _met(token, rows, similarity, large, leaders)
            yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return run


def _unjoined(similarity: float, nearest: bool):
    """For mapInArrow, rows (token, i, j, mine, node, size, place, component, odd) sorted by token, i, j: the pairs (a, b) of two
    components that can have the similarity; if i and j differ, those of a row of block i and one of block j. With `nearest`, for
    each a that has any the b with the smallest share d of the differences allowed."""

    def run(batches):
        for t in _whole_groups(batches, ["token", "i", "j"]):
            token, bi, bj, mine, node, size, place, of = (t.column(x).to_numpy() for x in ("token", "i", "j", "mine", "node", "size", "place", "component"))
            odd = t.column("odd").to_pylist()
            wide = np.array([len(x) // 8 for x in odd])
            most = _BASE ** (size + 1.0) * (1 - similarity) / (1 + similarity) * (1 + _SLACK)  # a set's share of the differences allowed
            heads = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])]))
            for h, e in zip(heads.tolist(), [*heads[1:].tolist(), len(token)]):
                if (of[h:e] == of[h]).all():
                    continue
                left = h + np.flatnonzero(mine[h:e] == bi[h]) if bi[h] != bj[h] else np.arange(h, e)
                right = h + np.flatnonzero(mine[h:e] == bj[h]) if bi[h] != bj[h] else left
                best, partner = np.full(e - h, np.inf), np.zeros(e - h, np.int64)
                folded = {int(w): _folded(odd[h:e], int(w)) for w in np.unique(wide[h:e])}
                for i in range(0, len(left), 256):
                    x, y = left[i : i + 256][:, None], right[None, :]
                    p, q = np.nonzero((of[x] != of[y]) & (node[x] < node[y]) & _possible(size[x], size[y], place[x], place[y], similarity))
                    if bi[h] != bj[h]:
                        r, s = np.nonzero((of[x] != of[y]) & (node[x] > node[y]) & _possible(size[x], size[y], place[x], place[y], similarity))
                        p, q = np.concatenate([p, r]), np.concatenate([q, s])
                    p, q = x[p, 0], y[0, q]
                    ratio = np.full(len(p), np.inf)
                    for w, rows in folded.items():  # compared at the width of the narrower
                        own = np.flatnonzero(np.minimum(wide[p], wide[q]) == w)
                        for k in range(0, len(own), 1 << 15):
                            some = own[k : k + (1 << 15)]
                            ratio[some] = np.bitwise_count(rows[p[some] - h] ^ rows[q[some] - h]).sum(axis=1, dtype=np.int64) / (most[p[some]] + most[q[some]])
                    keep = ratio <= 1
                    if nearest:
                        a, b, d = np.concatenate([p[keep], q[keep]]) - h, np.concatenate([q[keep], p[keep]]), np.tile(ratio[keep], 2)
                        order = np.lexsort((node[b], d, a))
                        own, first = np.unique(a[order], return_index=True)
                        first = order[first]
                        less = (d[first] < best[own]) | ((d[first] == best[own]) & (node[b[first]] < partner[own]))
                        best[own[less]], partner[own[less]] = d[first][less], node[b[first]][less]
                    elif keep.any():
                        a, b = node[p[keep]], node[q[keep]]
                        yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.nulls(len(a), pa.float64())], ["a", "b", "d"])
                if nearest and (some := np.flatnonzero(best <= 1)).size:
                    yield pa.record_batch([pa.array(node[h + some]), pa.array(partner[some]), pa.array(best[some])], ["a", "b", "d"])

    return run


def _dealt_pairs(a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """(node, hub, part, role), sorted by node: where the texts of the pairs (a, b) go, as _alike() says; a and b differ."""
    hub, of, n = np.unique(a, return_inverse=True, return_counts=True)
    share = -(-n // HUB)
    part = (mixed(b.view(np.uint64)) % share[of].astype(np.uint64)).astype(np.int64)
    whole = np.arange(share.sum()) - np.repeat(np.cumsum(share) - share, share)
    hub = np.repeat(hub, share)
    node, hub, part = np.concatenate([b, hub]), np.concatenate([a, hub]), np.concatenate([part, whole])
    order = np.argsort(node, kind="stable")
    return [node[order], hub[order], part[order].astype(np.int32), (np.arange(len(node)) < len(a))[order].astype(np.int32)]


def _components(edges: DataFrame) -> DataFrame:
    """simhash.components(). Few edges are joined here: each round there is several jobs, and each of these takes memory of the
    driver, which holds far less for the edges themselves."""
    spark = edges.sparkSession
    if edges.count() * 16 > FEW_LINKS:
        return components(edges)
    t = edges.select("a", "b").toArrow()
    a, b = (t.column(x).to_numpy() for x in ("a", "b"))
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    at, top = at.reshape(2, -1), np.arange(len(node))
    while True:
        x, y = top[at[0]], top[at[1]]
        if (x == y).all():
            break
        np.minimum.at(top, np.maximum(x, y), np.minimum(x, y))
        while (top[top] != top).any():
            top = top[top]
    return spark.createDataFrame(pa.table({"node": node, "component": node[top]}), "node long, component long")


def _sent(pairs: DataFrame) -> DataFrame:
    """_dealt_pairs() of written pairs by Spark, written."""
    share = F.ceil(F.col("n") / HUB).cast("int")
    hubs = pairs.groupBy("a").agg(F.count("*").alias("n")).select("a", share.alias("n"))
    members = pairs.join(hubs, "a").select(F.col("b").alias("node"), F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), "n").cast("int").alias("part"), F.lit(1).alias("role"))
    whole = hubs.select(F.col("a").alias("node"), F.col("a").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("part"), F.lit(0).alias("role"))
    return written(whole.union(members), "jaccard-sent")


def _alike(docs: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of the written pairs (a, b) of nodes whose sets have the similarity.

    The text of each b goes to the task of its a, HUB at most, that of a once to each of these. Where it goes is broadcast while
    that has at most BROADCAST_BYTES, else joined.
    """
    known = None
    few = pairs.count() * 48 <= BROADCAST_BYTES
    if few:
        t = pairs.toArrow()
        known = docs.sparkSession.sparkContext.broadcast(_dealt_pairs(*(t.column(x).to_numpy() for x in ("a", "b"))))
    else:
        sent = _sent(pairs)

    def texts(batches):
        codec = pa.Codec("zstd", 1)
        for i, b, _, _, nodes, use in _sets(batches, shingle):
            own, rows = nodes.view(np.int64), np.flatnonzero(use)
            at = [None] * 3
            if known is not None:
                first, last = (np.searchsorted(known.value[0], own[rows], side) for side in ("left", "right"))
                rows, first, n = rows[last > first], first[last > first], (last - first)[last > first]
                place = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
                at = [pa.array(x[place]) for x in known.value[1:]]
            text = b.column("text")
            raw = [text[i + k].as_py() or "" for k in rows.tolist()]
            raw = [x.encode() for x in raw]
            body, size = pa.array([codec.compress(x, asbytes=True) for x in raw], pa.binary()), pa.array([len(x) for x in raw], pa.int64())
            if known is not None:
                again = pa.array(np.repeat(np.arange(len(rows)), n))
                yield pa.record_batch([pa.array(own[rows]).take(again), size.take(again), body.take(again), *at], ["node", "bytes", "body", "hub", "part", "role"])
            else:
                yield pa.record_batch([pa.array(own[rows]), size, body], ["node", "bytes", "body"])

    def decide(batches):
        codec = pa.Codec("zstd", 1)
        of, hub, last = None, None, None
        for b in batches:
            role, node, size = b.column("role").to_numpy(), b.column("node").to_numpy(), b.column("bytes").to_numpy()
            key = list(zip(b.column("hub").to_pylist(), b.column("part").to_pylist()))
            at, out = 0, []
            while at < len(b):
                to = at + max(1, int(np.searchsorted(np.cumsum(size[at:]), 1 << 20, "right")))
                raw = [codec.decompress(x.as_buffer(), decompressed_size=n, asbytes=True) if n else b"" for n, x in zip(size[at:to].tolist(), b.column("body")[at:to])]
                offs = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
                g, edges = shingle_sets(np.frombuffer(b"".join([*raw, bytes(8)]), np.uint8), offs, shingle)
                for k in range(at, min(to, len(b))):
                    own = g[edges[k - at] : edges[k - at + 1]]
                    if role[k] == 0:
                        of, hub, last = key[k], own, None
                    elif of == key[k] and node[k] != last:  # else a copy in another task
                        last = node[k]
                        found = np.minimum(np.searchsorted(hub, own), max(0, len(hub) - 1))
                        common = int((hub[found] == own).sum()) if len(hub) else 0
                        if common >= similarity * (len(own) + len(hub) - common) - _SLACK:
                            out.append((key[k][0], int(node[k])))
                at = to
            a, c = zip(*out) if out else ((), ())
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(c, pa.int64())], ["a", "b"])

    if few:
        dealt = docs.mapInArrow(texts, "node long, bytes long, body binary, hub long, part int, role int")
    else:
        kept = docs.mapInArrow(texts, "node long, bytes long, body binary").groupBy("node").agg(F.first("bytes").alias("bytes"), F.first("body").alias("body"))
        dealt = kept.join(sent, "node")
    dealt = dealt.repartition("hub", "part").sortWithinPartitions("hub", "part", "role", "node").select("node", "bytes", "body", "hub", "part", "role")
    out = written(dealt.mapInArrow(decide, "a long, b long"), "jaccard-links")
    if few:
        known.destroy()
    return out


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, counted: int = COUNTED, large: int = LARGE, leaders: int = LEADERS, block: int = BLOCK, part: int = PART) -> DataFrame:
    """doc_id and component_id (the smallest doc_id reachable by links) of every row of docs (doc_id, text).

    Texts link if the sets of their shingles have the Jaccard similarity or more, those without words with each other. Equal
    sets are one node. A row without doc_id gets the component of rows with its set, null if none has an id. An empty table
    gives no rows; other columns are ignored; rows that repeat a doc_id get a component each by their texts.
    """
    if not 0 < similarity <= 1 or leaders > large:
        raise ValueError("a similarity is above 0 and at most 1, and leaders are no more than a large group")
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    bits = min(24, (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))).bit_length())

    def named(batches):
        for i, b, g, edges, nodes, _ in _sets(batches, shingle, once=False):
            n = np.diff(edges)
            odd = pa.array(odd_classes(g, edges), pa.binary())
            yield pa.record_batch([b.column("doc_id").slice(i, len(nodes)), pa.array(nodes.view(np.int64)), pa.array(majority(g, n).view(np.int64)), pa.array(n), odd], ["doc_id", "node", "fp", "shingles", "odd"])

    found = written(docs.mapInArrow(named, "doc_id long, node long, fp long, shingles long, odd binary"), "jaccard-nodes")
    # the columns but the id are the same for a node
    nodes = written(found.groupBy("node").agg(F.first("fp").alias("fp"), F.first("shingles").alias("shingles"), F.min("doc_id").alias("first")), "jaccard-nodes")
    close = links(nodes, similarity=similarity).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    share = max(1, found.count() // counted)

    def sample(batches):
        for _, _, g, _, _, _ in _sets(batches, shingle):
            yield pa.record_batch([pa.array(g.view(np.int64))], ["token"])

    some = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("order")), F.lit(share)) == 0)
    times = some.mapInArrow(sample, "token long").groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN).toArrow()
    often = times.column("token").to_numpy().view(np.uint64)
    order = np.argsort(often)
    order = spark.sparkContext.broadcast((often[order], times.column("n").to_numpy()[order]))

    met = written(_dealt(docs, shingle, similarity, order, share, bits, part).mapInArrow(_groups(similarity, large, leaders, bits), _FOUND), "jaccard-met")
    again = met.where("kind = 2").select("token", F.col("a").alias("node"), "size", "place").repartition("token").sortWithinPartitions("token", "node")
    order.destroy()
    pairs = met.where("kind = 0").select("a", "b").union(again.mapInArrow(_again(similarity, large, leaders), "a long, b long")).union(close)
    pairs = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    joined = _alike(docs, written(pairs, "jaccard-pairs"), shingle, similarity)
    grouped = written(_components(joined), "jaccard-groups")

    def small(df: DataFrame) -> DataFrame:
        """A written table of two or three numbers a row, to be broadcast if its size allows."""
        return F.broadcast(df) if df.count() * 64 <= BROADCAST_BYTES else df

    alive, turn, final = None, 0, False
    while True:
        rest = met.where("kind = 1").select("token", F.col("a").alias("node"), "size", "place")
        if alive is not None:  # the others have no partner in another component
            rest = rest.join(small(alive), "node", "left_semi")
        rest = rest.join(small(grouped), "node", "left").withColumn("component", F.coalesce("component", "node"))
        open_ = rest.groupBy("token").agg(F.count("*").alias("n"), F.min("component").alias("x"), F.max("component").alias("y"))
        open_ = written(open_.where("x < y").select("token", F.ceil(F.col("n") / block).cast("int").alias("n")), "jaccard-open")
        rest = written(rest.join(small(open_), "token"), "jaccard-rest")
        if rest.isEmpty():
            break
        odd = found.join(small(written(rest.select("node").distinct(), "jaccard-open")), "node", "left_semi").groupBy("node").agg(F.min("odd").alias("odd"))
        rows = rest.join(odd, "node").withColumn("mine", F.pmod(F.xxhash64("node"), "n").cast("int"))
        each = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda o: F.struct(F.least(o, "mine").alias("i"), F.greatest(o, "mine").alias("j")))
        rows = rows.withColumn("pair", F.explode(each)).select("token", "pair.i", "pair.j", "mine", "node", "size", "place", "component", "odd")
        pairs = rows.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j").mapInArrow(_unjoined(similarity, not final), "a long, b long, d double")
        if not final:
            pairs = pairs.groupBy("a").agg(F.min(F.struct("d", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
            pairs = written(pairs, "jaccard-nearest")
            alive = pairs.select(F.col("a").alias("node"))
            pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        pairs = written(pairs.select("a", "b").distinct(), "jaccard-pairs")
        if pairs.isEmpty():
            break
        more = _alike(docs, pairs, shingle, similarity)
        none = more.isEmpty()
        if not none:
            joined = joined.union(more)
            grouped = written(_components(joined), "jaccard-groups")
        if final:
            break
        turn += 1
        final = none or turn == TURNS
    nodes = written(nodes.select("node", "first").join(grouped, "node", "left").withColumn("component", F.coalesce("component", "node")), "jaccard-components")
    least = nodes.groupBy("component").agg(F.min("first").alias("component_id"))
    known = written(nodes.join(least, "component").select("node", "component_id"), "jaccard-components")
    return found.select("doc_id", "node").join(known, "node", "left").select("doc_id", "component_id")
