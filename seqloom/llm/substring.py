"""Substring deduplication by suffix automata over routed reference shards.

A window is `window` consecutive words. A word goes if a window over it also starts in a document with a smaller id.
Broadcasting automata of the whole corpus to every document would cost the square of the corpus, so the reference is cut
into shards by content and each stretch of a document meets the one shard that can match it:

1. The key of a window is the smallest hash of its GRAM-word grams (a minimizer): equal windows have equal keys. A stretch is
   a run of windows with one key. For each key a first pass finds whether two documents have it, and whether all its
   stretches have the same words. Bitmaps of bounded size tell every task; they are filters and lose no key.
2. Stretches of keys whose stretches differ go, as words, to the key's shard. It takes them by ascending document, asks the
   suffix automaton of the earlier documents for matching statistics, and then adds the stretch to the automaton. Where all
   stretches of a key are equal, matching statistics would only say so again: their hashes alone (128 bits: key and words)
   go out, and the smallest document is found by a grouped minimum. So do, window by window, those of keys in more than
   FREQUENT documents, so that no shard grows with the corpus.
3. A document gets the answers for the stretches that it was the first to hold; its other marked stretches are copies.
   What they cover is cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from seqloom.llm.shared import chunks, mixed, packed5, text_buffer, unpacked5, word_hashes, words, written

WINDOW, GRAM = 13, 5
#: A key in more documents than this is dealt window by window.
FREQUENT = 500
#: The largest bitmap: 2**27 bits, 16 MB; there are three. A fuller one lets more stretches through and never loses one.
MOST_BITS = 27
#: Keys that a task of the first pass holds before it sends them on.
HELD_KEYS = 2_000_000

_C = np.uint64(0xD6E8FEB86659FD93)
_POWERS = np.ones(1, np.uint64)
_INVERSES = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of _C and of its inverse, modulo 2**64."""
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        both = []
        for c in (int(_C), pow(int(_C), -1, 1 << 64)):
            p = np.full(max(n, 1 << 18), c, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _POWERS, _INVERSES = both
    return _POWERS[:n], _INVERSES[:n]


def _sids(key: np.ndarray, content: np.ndarray) -> np.ndarray:
    return mixed(content ^ mixed(key))


class Stretches:
    """Words and keyed stretches of the texts of one chunk.

    A stretch is `first` to `last` (exclusive), indexes of windows, which are those of their first words; `doc` is the row
    in the chunk and `sid` a hash of key and words.
    """

    def __init__(self, buf: np.ndarray, offs: np.ndarray, window: int = WINDOW):
        self.buf, self.offs, self.window = buf, offs, window
        self.starts, self.ends, self.heads = words(buf, offs)
        n, gram = len(self.starts), min(GRAM, window)
        h = word_hashes(buf, self.starts, self.ends)
        p, q = _powers(n + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * p[:n])])
        self.inverse = q
        if n < window:
            self.key, self.first, self.last, self.doc = np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
            return
        g = self.run_hashes(np.arange(n - gram + 1), gram)
        wide = window - gram + 1  # grams of a window
        least, have = g, 1
        while have < wide:
            step = min(have, wide - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        rows = np.repeat(np.arange(len(offs) - 1), np.diff(self.heads))
        at = np.flatnonzero(rows[: n - window + 1] == rows[window - 1 :])
        k, d = least[at], rows[at]
        new = np.ones(len(at), bool)
        new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1]) | (at[1:] != at[:-1] + 1)
        i = np.flatnonzero(new)
        self.key, self.first, self.doc = k[i], at[i], d[i]
        self.last = at[np.append(i[1:], len(at)) - 1] + 1 if len(at) else at

    def run_hashes(self, first: np.ndarray, size) -> np.ndarray:
        """Hashes of the word runs of a size that start at each index."""
        return mixed((self.sums[first + size] - self.sums[first]) * self.inverse[first] + np.uint64(1) * np.asarray(size, np.uint64))

    def chosen(self, marks: Marks) -> tuple[np.ndarray, ...]:
        """(key, content, first, last, doc, whether words go) of what is dealt: marked stretches, those of hot keys window by window."""
        shared = marks.shared.has(self.key)
        hot = shared & marks.hot.has(self.key)
        mixed_key = shared & ~hot & marks.mixed.has(self.key)
        cold = np.flatnonzero(shared & ~hot)
        hot = np.flatnonzero(hot)
        n = (self.last - self.first)[hot]
        single = np.repeat(self.first[hot] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        first = np.concatenate([self.first[cold], single]).astype(np.int64)
        last = np.concatenate([self.last[cold], single + 1]).astype(np.int64)
        doc = np.concatenate([self.doc[cold], np.repeat(self.doc[hot], n)]).astype(np.int64)
        key = np.concatenate([self.key[cold], np.repeat(self.key[hot], n)])
        by_words = np.concatenate([mixed_key[cold], np.zeros(len(single), bool)])
        return key, self.run_hashes(first, last - first + self.window - 1), first, last, doc, by_words

    def joined(self) -> tuple[bytes, np.ndarray]:
        """The words with one space after each, and where each word starts there."""
        n = int(self.offs[-1])
        size = self.ends - self.starts
        at = np.concatenate([[0], np.cumsum(size + 1)])
        out = np.full(int(at[-1]), 32, np.uint8)
        ink = np.zeros(n + 1, np.int8)
        ink[self.starts] += 1
        ink[self.ends] -= 1
        ink = np.cumsum(ink[:n], dtype=np.int8).astype(bool) if n else ink[:0].astype(bool)
        put = np.ones(len(out), bool)
        put[at[1:] - 1] = False
        # a word that follows another text's last word at once has no gap between them: both end and start there
        out[put] = self.buf[:n][ink]
        return out.tobytes(), at


class Bitmap:
    """A set of hashes as the bits at their top bits: no false negatives."""

    def __init__(self, bits: int, packed: np.ndarray):
        self.bits, self.packed = bits, packed

    def has(self, h: np.ndarray) -> np.ndarray:
        at = h >> np.uint64(64 - self.bits)
        return self.packed[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1

    @staticmethod
    def size(n: int, most_bits: int) -> int:
        """Its bits for n hashes, as a power of two: 16 to 32 for each, 2**most_bits at most."""
        return max(12, min(most_bits, (16 * n).bit_length()))


class Marks:
    """Bitmaps of the keys that two documents have, of those whose stretches differ, and of those in many documents."""

    KINDS = ("shared", "mixed", "hot")

    def __init__(self, shared: Bitmap, mixed: Bitmap, hot: Bitmap):
        self.shared, self.mixed, self.hot = shared, mixed, hot

    @staticmethod
    def of(marked: DataFrame, most_bits: int, buckets: int) -> Marks:
        """The bitmaps of a written table (bucket, key, kind); kind 1 also counts as shared, kind 2 as both others.

        A bucket's keys share their top bits, so it fills a part of a bitmap of its own: the driver gets those parts, 2**most_bits
        bits at most for each bitmap.
        """
        n = {r.kind: r.n for r in marked.groupBy("kind").agg(F.count("*").alias("n")).collect()}
        counts = [sum(n.values()), n.get(1, 0) + n.get(2, 0), n.get(2, 0)]
        top = buckets.bit_length() - 1
        bits = [max(Bitmap.size(c, most_bits), top + 3) for c in counts]

        def fill(batches):
            of, parts = None, []

            def row():
                which = range(len(bits))
                at = [of << m - top >> 3 for m in bits]
                return pa.record_batch([pa.array(which, pa.int32()), pa.array(at, pa.int64()), pa.array([np.packbits(x, bitorder="little").tobytes() for x in parts], pa.binary())], ["which", "at", "part"])

            for b in batches:
                key, kind = b.column("key").to_numpy().view(np.uint64), b.column("kind").to_numpy()
                bucket = key >> np.uint64(64 - top)
                for own in np.split(np.arange(len(key)), np.flatnonzero(bucket[1:] != bucket[:-1]) + 1):
                    if not len(own):
                        continue
                    if of != int(bucket[own[0]]):
                        if parts:
                            yield row()
                        of, parts = int(bucket[own[0]]), [np.zeros(1 << m - top, np.uint8) for m in bits]
                    for i, m in enumerate(bits):
                        k = key[own][kind[own] >= i] >> np.uint64(64 - m)
                        parts[i][(k & np.uint64((1 << m - top) - 1)).astype(np.int64)] = 1
            if parts:
                yield row()

        maps = [np.zeros(1 << m - 3, np.uint8) for m in bits]
        if sum(counts):
            for r in marked.select("key", "kind").mapInArrow(fill, "which int, at long, part binary").toLocalIterator():
                raw = np.frombuffer(r.part, np.uint8)
                maps[r.which][r.at : r.at + len(raw)] |= raw
        return Marks(*(Bitmap(m, x) for m, x in zip(bits, maps)))


def _stretches(buf: np.ndarray, offs: np.ndarray, window: int, most: int = 1 << 20) -> Iterator[tuple[Stretches, int, int]]:
    for i, j in chunks(offs, most):
        o = offs[i : j + 1]
        yield Stretches(buf[o[0] : o[-1] + 8], o - o[0], window), i, j


class SuffixAutomaton:
    """A suffix automaton of word sequences, which grows by whole sequences."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.size = [-1], [0]

    def add(self, sequence) -> None:
        nxt, link, size, last = self.next, self.link, self.size, 0
        for w in sequence:
            if (q := nxt[last].get(w)) is not None and size[q] == size[last] + 1:
                last = q
                continue
            if q is not None:
                last = self._clone(last, q, w)
                continue
            new = len(nxt)
            nxt.append({})
            link.append(0)
            size.append(size[last] + 1)
            p = last
            while p >= 0 and w not in nxt[p]:
                nxt[p][w] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][w]
                link[new] = q if size[q] == size[p] + 1 else self._clone(p, q, w)
            last = new

    def _clone(self, p: int, q: int, w) -> int:
        """Splits state q: the sequences that p and w make get a state of their own."""
        nxt, link, size = self.next, self.link, self.size
        new = len(nxt)
        nxt.append(nxt[q].copy())
        link.append(link[q])
        size.append(size[p] + 1)
        link[q] = new
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = new
            p = link[p]
        return new

    def statistics(self, sequence) -> list[int]:
        """For each word the length of the longest suffix up to it that the automaton holds."""
        nxt, link, size, v, n, out = self.next, self.link, self.size, 0, 0, []
        for w in sequence:
            while v and w not in nxt[v]:
                v = link[v]
                n = size[v]
            if (q := nxt[v].get(w)) is not None:
                v, n = q, n + 1
            else:
                n = 0
            out.append(n)
        return out


def _judge_shard(rows: list[tuple[int, int, bytes]], window: int) -> Iterator[tuple[int, int, bytes]]:
    """(document, sid, a byte for each window: 1 if an earlier document holds it) of each stretch's first document.

    rows: (document, sid, words) of one key by ascending document; a later document with the same words has copies alone.
    """
    first: dict[bytes, tuple[int, int]] = {}
    for doc, sid, text in rows:
        first.setdefault(text, (doc, sid))
    automaton, waiting, of = SuffixAutomaton(), [], None
    for text, (doc, sid) in first.items():
        if doc != of:
            for w in waiting:
                automaton.add(w)
            waiting, of = [], doc
        sequence = text.split(b" ")
        held = bytes(n >= window for n in automaton.statistics(sequence)[window - 1 :])
        waiting.append(sequence)
        yield doc, sid, held if any(held) else b""


def _summed(key: np.ndarray, low: np.ndarray, high: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """(key, least hash, greatest hash, sum of n) of each key, ascending."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    if not len(heads):
        return key, low, high, n
    return key[heads], np.minimum.reduceat(low[order], heads), np.maximum.reduceat(high[order], heads), np.add.reduceat(n[order], heads)


def _marks(ids: DataFrame, window: int, most_bits: int, frequent: int) -> Marks:
    """The marks of the keys of all texts (doc_id, text).

    What is shuffled are blocks of keys by their top bits: five more bytes of the key, five of a hash of the stretch, and how
    many rows have it (127 at most a block; the top bit says that a task already saw different stretches). Keys that are
    equal in those bytes count as one, which marks more, never less; two different stretches whose five bytes are equal
    count as equal, once in 10**12 keys, and then their common windows are only found where the stretches are equal.
    """
    buckets = 1 << min(24, (4 * int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))).bit_length())
    bits = buckets.bit_length() - 1
    lower = np.uint64((1 << 40) - 1)

    def keys(batches):
        held, size = [], 0

        def send():
            key, low, high, n = _summed(*(np.concatenate(x) for x in zip(*held)))
            code = (np.minimum(n, 127) | np.where(low != high, 128, 0)).astype(np.uint8)
            bucket = key >> np.uint64(64 - bits)
            heads = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            ends = np.append(heads[1:], len(key)).tolist()
            rest = key >> np.uint64(24 - bits) & lower
            parts = [packed5(rest[i:j]) + packed5(low[i:j]) + code[i:j].tobytes() for i, j in zip(heads.tolist(), ends)]
            return pa.record_batch([pa.array(bucket[heads].astype(np.int64)), pa.array(parts, pa.binary())], ["bucket", "part"])

        for b in batches:
            for s, _, _ in _stretches(*text_buffer(b.column("text")), window):
                order = np.lexsort((s.doc, s.key))
                k, d = s.key[order], s.doc[order]
                h = (s.run_hashes(s.first, s.last - s.first + window - 1) & lower)[order]
                once = np.ones(len(k), np.int64)
                once[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
                held.append(_summed(k, h, h, once))
                size += len(held[-1][0])
                if size >= HELD_KEYS:
                    yield send()
                    held, size = [], 0
        if size:
            yield send()

    def mark(batches):
        of, parts = None, []

        def kinds():
            n = [len(x) // 11 for x in parts]
            key = np.concatenate([unpacked5(x[: 5 * m], m) for x, m in zip(parts, n)])
            h = np.concatenate([unpacked5(x[5 * m : 10 * m], m) for x, m in zip(parts, n)])
            code = np.concatenate([np.frombuffer(x, np.uint8)[10 * m :] for x, m in zip(parts, n)]).astype(np.int64)
            unlike = code >= 128
            key, low, high, n = _summed(key, np.where(unlike, np.uint64(0), h), np.where(unlike, lower, h), code & 127)
            some = n > 1
            kind = np.where(low != high, np.where(n > frequent, 2, 1), 0)[some].astype(np.int32)
            key = np.uint64(of) << np.uint64(64 - bits) | key[some] << np.uint64(24 - bits)
            return pa.record_batch([pa.array(key.view(np.int64)), pa.array(kind)], ["key", "kind"])

        for b in batches:
            for bucket, part in zip(b.column("bucket").to_pylist(), b.column("part").to_pylist()):
                if bucket != of and parts:
                    yield kinds()
                    parts = []
                of = bucket
                parts.append(part)
        if parts:
            yield kinds()

    dealt = ids.mapInArrow(keys, "bucket long, part binary").repartition("bucket").sortWithinPartitions("bucket")
    return Marks.of(written(dealt.mapInArrow(mark, "key long, kind int"), "substring-keys"), most_bits, buckets)


def _answers(ids: DataFrame, marks, window: int) -> DataFrame:
    """Written answers (doc_id, sid, held): a row for the first document of each dealt stretch.

    Words are dealt by key. What the hash decides is dealt by sid, which with the content names 128 bits; a task sends the
    smallest document for each, so no shard gets more of them than tasks.
    """

    def deal(batches):
        held, size = [], 0

        def send():
            sid, content, doc = (np.concatenate(x) for x in zip(*held))
            own = np.lexsort((doc, content, sid))
            sid, content, doc = sid[own], content[own], doc[own]
            new = np.ones(len(sid), bool)
            new[1:] = (sid[1:] != sid[:-1]) | (content[1:] != content[:-1])
            return row(sid[new], content[new], doc[new], pa.nulls(int(new.sum()), pa.binary()))

        def row(shard, content, doc, text):
            return pa.record_batch([pa.array(shard.view(np.int64)), pa.array(content.view(np.int64)), pa.array(doc), text], ["shard", "content", "doc_id", "words"])

        for b in batches:
            ids = b.column("doc_id").to_numpy()
            for s, i, _ in _stretches(*text_buffer(b.column("text")), window):
                key, content, first, last, doc, by_words = s.chosen(marks.value)
                doc = ids[i + doc]
                rest = ~by_words
                held.append((_sids(key[rest], content[rest]), content[rest], doc[rest]))
                size += int(rest.sum())
                if size >= HELD_KEYS // 2:
                    yield send()
                    held, size = [], 0
                own = np.flatnonzero(by_words)
                if len(own):
                    own = own[np.lexsort((doc[own], content[own], key[own]))]
                    new = np.ones(len(own), bool)
                    new[1:] = (key[own[1:]] != key[own[:-1]]) | (content[own[1:]] != content[own[:-1]])
                    own = own[new]  # of equal ones the smallest document
                    joined, at = s.joined()
                    texts = [joined[x:y] for x, y in zip(at[first[own]].tolist(), (at[last[own] + window - 1] - 1).tolist())]
                    yield row(key[own], content[own], doc[own], pa.array(texts, pa.binary()))
        if size:
            yield send()

    def judge(batches):
        group, of, was, done = [], None, None, set()

        def answer(found):
            cols = list(zip(*found)) or [(), (), ()]
            return pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], ["doc_id", "sid", "held"])

        for b in batches:
            by_words = b.column("words").is_valid().to_numpy(zero_copy_only=False)
            shard, content, doc = (b.column(x).to_numpy() for x in ("shard", "content", "doc_id"))
            rest = np.flatnonzero(~by_words)
            if len(rest):
                own = rest[np.lexsort((doc[rest], content[rest], shard[rest]))]
                new = np.ones(len(own), bool)
                new[1:] = (shard[own[1:]] != shard[own[:-1]]) | (content[own[1:]] != content[own[:-1]])
                own = own[new]
                own = own[[int(x) != was or int(c) not in done for x, c in zip(shard[own], content[own])]] if shard[rest[0]] == was else own
                last = int(shard[rest[-1]])  # this shard may go on
                done = {int(c) for c in content[rest[shard[rest] == last]]} | (done if last == was else set())
                was = last
                yield pa.record_batch([pa.array(doc[own]), pa.array(shard[own]), pa.nulls(len(own), pa.binary())], ["doc_id", "sid", "held"])
            t, found = b.filter(pa.array(by_words)), []
            own = np.flatnonzero(by_words)
            sids = _sids(shard[own].view(np.uint64), content[own].view(np.uint64)).view(np.int64)
            for k, sid, d, text in zip(shard[own].tolist(), sids.tolist(), doc[own].tolist(), t.column("words").to_pylist()):
                if k != of:
                    found += _judge_shard(group, window)
                    group, of = [], k
                group.append((d, sid, text))
            if found:
                yield answer(found)
        if group:
            yield answer(list(_judge_shard(group, window)))

    dealt = ids.mapInArrow(deal, "shard long, content long, doc_id long, words binary").repartition("shard").sortWithinPartitions("shard", "doc_id")
    return written(dealt.mapInArrow(judge, "doc_id long, sid long, held binary"), "substring-answers")


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<first:int,last:int>>, kept string"


def repeated_spans(docs: DataFrame, window: int = WINDOW, most_bits: int = MOST_BITS, frequent: int = FREQUENT, texts: bool = True, carry: Sequence[str] = ()) -> DataFrame:
    """Finds and cuts out the words that windows of earlier documents cover; a row for each document (doc_id, text).

    n_words and n_removed; kept_sha256 of the kept words, joined by one space; spans: the removed stretches as word indexes,
    first and last (exclusive); kept (null unless `texts`): the text without them, untouched where nothing is removed.
    Windows are judged on the input. A null text has no words. A row without doc_id loses nothing and takes from none.
    Rows that repeat a doc_id are one document: they take nothing from each other. Other columns are ignored, but for those
    in `carry`, which come back in the struct `carried`.
    """
    spark = docs.sparkSession
    ids = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null")
    marks = spark.sparkContext.broadcast(_marks(ids, window, most_bits, frequent))
    answers = _answers(ids, marks, window)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.struct(*[docs[c] for c in carry] or [F.lit(0).alias("none")]).alias("carried"))
    kind = rows.schema["carried"].dataType
    rows = rows.withColumn("place", F.coalesce("doc_id", F.monotonically_increasing_id()))  # a row without an id needs no answers
    packed = StructType([*StructType.fromDDL("place long, kind int, doc_id long, size long, body binary"), StructField("carried", kind)])

    def pack(batches):
        codec = pa.Codec("zstd", 1)
        for b in batches:
            raw = b.column("text").cast(pa.binary())
            size = [-1 if x is None else len(x) for x in raw.to_pylist()]
            body = [None if n < 0 else codec.compress(x.as_buffer(), asbytes=True) for n, x in zip(size, raw)]
            yield pa.record_batch([b.column("place"), pa.array(np.ones(len(b), np.int32)), b.column("doc_id"), pa.array(size, pa.int64()), pa.array(body, pa.binary()), b.column("carried")], packed.names)

    answers = answers.select(F.col("doc_id").alias("place"), F.lit(0).alias("kind"), "doc_id", F.col("sid").alias("size"), F.col("held").alias("body"), F.lit(None).cast(kind).alias("carried"))
    both = answers.unionByName(rows.mapInArrow(pack, packed)).repartition("place").sortWithinPartitions("place", "kind", F.col("doc_id").asc_nulls_last()).drop("place")
    span = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("spans", span), ("kept", pa.string())])

    def cut(batches):
        codec, known = pa.Codec("zstd", 1), {}
        for b in batches:
            kinds = b.column("kind").to_numpy()
            a = b.filter(pa.array(kinds == 0))
            for doc, sid, held in zip(a.column("doc_id").to_pylist(), a.column("size").to_pylist(), a.column("body").to_pylist()):
                known.setdefault(doc, {})[sid] = held or b""
            t = b.filter(pa.array(kinds == 1))
            ids, size = t.column("doc_id").to_pylist(), t.column("size").to_numpy()
            at = 0
            while at < len(ids):  # texts are unpacked a megabyte at a time
                to = at + max(1, int(np.searchsorted(np.cumsum(np.maximum(size[at:], 0)), 1 << 20, "right")))
                raw = [b"" if n < 0 else codec.decompress(x.as_buffer(), decompressed_size=n, asbytes=True) for n, x in zip(size[at:to].tolist(), t.column("body")[at:to])]
                offs = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
                s = Stretches(np.frombuffer(b"".join([*raw, bytes(8)]), np.uint8), offs, window)
                out = _cut(s, ids[at:to], marks.value, known, [None if n < 0 else x for n, x in zip(size[at:to].tolist(), raw)] if texts else None)
                found = pa.RecordBatch.from_pylist(out, schema)
                yield pa.record_batch([*found.columns, t.column("carried").slice(at, to - at)], [*schema.names, "carried"])
                at = to
            if len(b):
                last = b.column("doc_id")[-1].as_py()
                known = {last: known[last]} if last in known else {}

    out = both.mapInArrow(cut, StructType([*StructType.fromDDL(RESULT), StructField("carried", kind)]))
    return out if carry else out.drop("carried")


def _cut(s: Stretches, ids: list, marks: Marks, known: dict, texts: list | None) -> list[dict]:
    key, content, first, last, doc, _ = s.chosen(marks)
    sid = _sids(key, content)
    order = np.argsort(doc, kind="stable")
    bounds = np.searchsorted(doc[order], np.arange(len(ids) + 1)).tolist()
    sid, first, last = sid.view(np.int64)[order].tolist(), first[order].tolist(), last[order].tolist()
    joined, at = s.joined()
    out, heads = [], s.heads.tolist()
    for r, doc_id in enumerate(ids):
        lo, hi = heads[r], heads[r + 1]
        spans: list[list[int]] = []
        if doc_id is not None and bounds[r] < bounds[r + 1]:
            mine, edge = known.get(doc_id, {}), np.zeros(hi - lo + 1, np.int32)
            for x, f, e in zip(sid[bounds[r] : bounds[r + 1]], first[bounds[r] : bounds[r + 1]], last[bounds[r] : bounds[r + 1]]):
                held = mine.get(x)
                if held is None:  # another document was the first to hold it
                    edge[f - lo] += 1
                    edge[e - lo + s.window - 1] -= 1
                else:
                    for i, one in enumerate(held):
                        if one:
                            edge[f + i - lo] += 1
                            edge[f + i - lo + s.window] -= 1
            gone = np.flatnonzero(np.diff(np.cumsum(edge[:-1]) > 0, prepend=False, append=False))
            spans = gone.reshape(-1, 2).tolist()
        raw = texts[r] if texts is not None else None
        if spans:
            kept, start, cut, from_ = [], lo, [], 0
            base = int(s.offs[r])
            for a, e in [*spans, [hi - lo, hi - lo]]:
                if start < lo + a:
                    kept.append(joined[at[start] : at[lo + a] - 1])
                if raw is not None:
                    to = s.starts[lo + a] - base if lo + a < hi else len(raw)
                    cut.append(raw[from_:to])
                    from_ = s.starts[lo + e] - base if lo + e < hi else len(raw)
                start = lo + e
            kept, raw = b" ".join(kept), b"".join(cut) if raw is not None else None
        else:
            kept = joined[at[lo] : max(at[lo], at[hi] - 1)]
        out.append({"doc_id": doc_id, "n_words": hi - lo, "n_removed": sum(e - a for a, e in spans), "kept_sha256": hashlib.sha256(kept).hexdigest(), "spans": [{"first": a, "last": e} for a, e in spans], "kept": None if raw is None else raw.decode()})
    return out
