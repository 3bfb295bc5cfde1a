"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores.

White space is part of the pieces: a space is shown by the marker U+2581, and a text gets one in front. A piece has the
marker at its start only, so the best path of a text is that of its segments (a run of markers and what follows up to the
next): equal segments of a batch are solved once. All trie walks of a batch go on at the same time, and so do the paths of
all its segments, one start position after the other.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.shared import chunks, text_buffer, word_hashes

MARK = "▁"
#: The score of an unknown character is this much under the lowest piece's.
UNKNOWN_PENALTY = 10.0


class Pieces(NamedTuple):
    """Pieces by id: text (None for control, unknown and byte pieces), log scores, and the ids of bytes and the unknown piece."""

    texts: list[str | None]
    scores: np.ndarray
    byte_ids: np.ndarray  # 256, or empty without byte fallback
    unknown: int


def load_pieces(path: str, zipf: bool = True) -> Pieces:
    """The pieces of a SentencePiece model file.

    zipf: the log scores follow Zipf's law over the order of the file's scores, log(1 / rank) less the log of its sum. That
    suits files of merged pairs, whose scores are ranks. Else the file's scores hold.
    """
    from sentencepiece import SentencePieceProcessor

    m = SentencePieceProcessor(model_file=path)
    n = m.get_piece_size()
    plain = [not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i)) for i in range(n)]
    scores = np.array([m.get_score(i) for i in range(n)], np.float32)
    if zipf:
        order = sorted((i for i in range(n) if plain[i]), key=lambda i: (-scores[i], i))
        total = math.log(sum(1 / r for r in range(1, len(order) + 1)))
        scores = np.zeros(n, np.float32)
        scores[order] = [-math.log(r) - total for r in range(1, len(order) + 1)]
    named = {m.id_to_piece(i): i for i in range(n) if m.is_byte(i)}
    byte_ids = np.array([named[f"<0x{b:02X}>"] for b in range(256)] if len(named) == 256 else [], np.int64)
    return Pieces([m.id_to_piece(i) if plain[i] else None for i in range(n)], scores, byte_ids, m.unk_id())


class DoubleArray:
    """A trie of byte strings in two arrays: from node s, byte c leads to t = base[s] + c + 1 if check[t] is s."""

    def __init__(self, keys: dict[bytes, int]):
        size = 1 << 12
        self.base, self.check, self.value = (np.full(size, x, np.int32) for x in (0, -1, -1))
        self.check[0] = 0
        items, low = sorted(keys.items()), 1
        todo = [(0, 0, len(items), 0)]
        while todo:
            node, lo, hi, depth = todo.pop()
            if lo < hi and len(items[lo][0]) == depth:
                self.value[node] = items[lo][1]
                lo += 1
            heads = [lo] if lo < hi else []
            heads += [i for i in range(lo + 1, hi) if items[i][0][depth] != items[i - 1][0][depth]]
            if not heads:
                continue
            codes = np.array([items[i][0][depth] + 1 for i in heads])
            at = low
            while True:
                self._room(at + 1024)
                spots = at + np.flatnonzero(self.check[at : at + 256] < 0)
                spots = spots[spots > codes[0]] - codes[0]
                fits = (self.check[spots[:, None] + codes] < 0).all(axis=1)
                if fits.any():
                    b = int(spots[fits.argmax()])
                    break
                at += 256
            if at > low and (self.check[low : low + 256] < 0).sum() < 16:
                low += 256
            self.base[node] = b
            self.check[b + codes] = node
            for c, i, j in zip(codes.tolist(), heads, [*heads[1:], hi]):
                todo.append((b + c, i, j, depth + 1))
        self._room(int(self.base.max()) + 600)

    def _room(self, size: int) -> None:
        if size > len(self.base):
            for name, fill in (("base", 0), ("check", -1), ("value", -1)):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.full(max(size, 2 * len(old)) - len(old), fill, np.int32)]))

    def matches(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the start, length, value) of every key at every start, none beyond its end."""
        node, which, length, found = np.zeros(len(starts), np.int64), np.arange(len(starts)), 0, []
        while len(which):
            inside = starts[which] + length < ends[which]
            which, node = which[inside], node[inside]
            if not len(which):
                break
            to = self.base[node] + buf[starts[which] + length].astype(np.int64) + 1
            ok = self.check[to] == node
            which, node = which[ok], to[ok]
            length += 1
            has = self.value[node] >= 0
            found.append((which[has], np.full(int(has.sum()), length), self.value[node[has]].astype(np.int64)))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


class Unigram:
    """Encodes and decodes by pieces."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        plain = {t.replace(MARK, " ").encode(): i for i, t in enumerate(pieces.texts) if t}
        if any(b" " in t.lstrip(b" ") for t in plain):
            raise ValueError("a piece holds the marker behind its start")
        self.trie = DoubleArray(plain)
        self.unknown_score = np.float32(min((float(pieces.scores[i]) for i in plain.values()), default=0.0) - UNKNOWN_PENALTY)
        self.raw = [t.replace(MARK, " ").encode() if t else b"" for t in pieces.texts]
        for b, i in enumerate(pieces.byte_ids.tolist()):
            self.raw[i] = bytes([b])
        if not len(pieces.byte_ids):
            self.raw[pieces.unknown] = " ⁇ ".encode()

    def _solved(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all segments one after the other, how many each has): the best path of each byte range."""
        size = ends - starts
        head = np.cumsum(size + 1) - (size + 1)  # a segment's positions, its end included
        total = int((size + 1).sum())
        # character starts of all segments
        seg = np.repeat(np.arange(len(size)), size)
        offset = np.arange(len(seg)) - np.repeat(np.cumsum(size) - size, size)
        byte = buf[starts[seg] + offset]
        first = (byte & 0xC0) != 0x80
        seg, offset, byte = seg[first], offset[first], byte[first]
        at = starts[seg] + offset
        wide = np.where(byte < 0x80, 1, np.where(byte < 0xE0, 2, np.where(byte < 0xF0, 3, 4)))
        which, length, piece = self.trie.matches(buf, at, ends[seg])
        single = np.zeros(len(at), bool)
        single[which[length == wide[which]]] = True
        alone = np.flatnonzero(~single)
        which = np.concatenate([which, alone])
        length = np.concatenate([length, wide[alone]])
        score = np.concatenate([self.pieces.scores[piece], np.full(len(alone), self.unknown_score, np.float32)])
        piece = np.concatenate([piece, np.full(len(alone), -1)])
        order = np.argsort(offset[which], kind="stable")
        which, length, piece, score = which[order], length[order], piece[order], score[order]
        begin = head[seg[which]] + offset[which]
        best, back, by = np.full(total, -np.inf, np.float32), np.zeros(total, np.int64), np.full(total, -1)
        best[head] = 0
        step = offset[which]
        bounds = np.flatnonzero(np.diff(step, prepend=-1))
        for i, j in zip(bounds.tolist(), [*bounds[1:].tolist(), len(step)]):
            b, e = begin[i:j], begin[i:j] + length[i:j]
            value = best[b] + score[i:j]
            better = value > best[e]
            e = e[better]
            best[e], back[e], by[e] = value[better], b[better], piece[i:j][better]
        # from the ends back, all segments at once; an unknown character gives its bytes
        pos, live, parts = head + size, np.arange(len(size)), []
        while len(live):
            go = pos > head[live]
            live, pos = live[go], pos[go]
            parts.append((live, back[pos], pos, by[pos]))
            pos = back[pos]
        seg, b, e, ids = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 4
        order = np.lexsort((b, seg))
        seg, b, e, ids = seg[order], b[order], e[order], ids[order]
        if (ids < 0).any():
            if len(self.pieces.byte_ids):
                n = np.where(ids < 0, e - b, 1)
                inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                seg, b, ids = (np.repeat(x, n) for x in (seg, b, ids))
                raw = self.pieces.byte_ids[buf[np.minimum(starts[seg] + b - head[seg] + inner, len(buf) - 1)]]
                ids = np.where(ids < 0, raw, ids)
            else:
                ids = np.where(ids < 0, self.pieces.unknown, ids)
        return ids, np.bincount(seg, minlength=len(size))

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, how many each has) of texts that follow each other."""
        n = np.diff(offs)
        some = n > 0
        to = offs + np.concatenate([[0], np.cumsum(some)])
        text = np.full(int(to[-1]) + 8, 32, np.uint8)
        body = np.ones(int(to[-1]), bool)
        body[to[:-1][some]] = False
        text[: len(body)][body] = buf[: int(offs[-1])]
        space = text[: int(to[-1])] == 32
        first = space.copy()
        first[1:] &= ~space[:-1]
        first[to[:-1][some]] = True
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], int(to[-1]))[: len(starts)]
        _, one, of = np.unique(word_hashes(text, starts, ends), return_index=True, return_inverse=True)
        ids, counts = self._solved(text, starts[one], ends[one])
        heads = np.cumsum(counts) - counts
        m = counts[of]
        out = ids[np.repeat(heads[of] - (np.cumsum(m) - m), m) + np.arange(m.sum())]
        per_text = np.add.reduceat(np.append(m, 0), np.searchsorted(starts, to[:-1])) * some if len(n) else n
        return out, per_text.astype(np.int64)

    def decode(self, ids) -> str:
        """The text of ids: pieces and bytes joined, markers as spaces, less the one in front; broken bytes become U+FFFD."""
        raw = b"".join([self.raw[i] for i in ids])
        return raw.removeprefix(b" ").decode("utf-8", "replace")


def _marked(batch_text: pa.Array) -> pa.Array:
    """A text's own markers count as spaces, as in the library."""
    import pyarrow.compute as pc

    return pc.replace_substring(batch_text, MARK, " ")


def encode(docs: DataFrame, model_path: str, zipf: bool = True) -> DataFrame:
    """doc_id and ids of every row of docs (doc_id, text): the best path of the whole text by the model's pieces.

    A null or empty text has no ids. Other columns are ignored; repeated rows are encoded each.
    """
    return _run(docs, model_path, zipf, "doc_id long, ids array<int>", lambda model, b, ids, counts: pa.record_batch([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"]))


def decode(encoded: DataFrame, model_path: str, zipf: bool = True) -> DataFrame:
    """encoded with the column `text` that its ids stand for; null ids have a null text."""
    shared = encoded.sparkSession.sparkContext.broadcast(Unigram(load_pieces(model_path, zipf)))

    @F.arrow_udf("string")
    def text(ids: pa.Array) -> pa.Array:
        return pa.array([None if x is None else shared.value.decode(x) for x in ids.to_pylist()], pa.string())

    return encoded.withColumn("text", text("ids"))


def _run(docs: DataFrame, model_path: str, zipf: bool, schema: str, made) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(Unigram(load_pieces(model_path, zipf)))  # as large as the model file

    def run(batches):
        model = shared.value
        for b in batches:
            buf, offs = text_buffer(_marked(b.column("text")))
            for i, j in chunks(offs, 1 << 19):
                yield made(model, b.slice(i, j - i), *model.encode(buf[offs[i] : offs[j] + 8], offs[i : j + 1] - offs[i]))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


DIGEST = "doc_id long, n_ids long, n_byte_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean"


def digests(docs: DataFrame, model_path: str, zipf: bool = True) -> DataFrame:
    """Encodes every whole text and decodes its ids again: counts, the CRC-32 of the little-endian 32-bit ids, the SHA-256 of
    the decoded text, and whether that is the text (its markers being spaces). Null and empty texts have no ids."""

    def made(model: Unigram, b, ids: np.ndarray, counts: np.ndarray):
        fallback = np.zeros(len(model.raw), bool)
        fallback[model.pieces.byte_ids] = True
        edge = np.concatenate([[0], np.cumsum(counts)])
        used, rows = fallback[ids], ids.tolist()
        texts = [model.decode(rows[i:j]) for i, j in zip(edge[:-1].tolist(), edge[1:].tolist())]
        small = ids.astype("<u4").tobytes()
        crc = [zlib.crc32(small[4 * i : 4 * j]) for i, j in zip(edge[:-1].tolist(), edge[1:].tolist())]
        sums = np.concatenate([[0], np.cumsum(used)])[edge]
        own = [(x or "").replace(MARK, " ") for x in b.column("text").to_pylist()]
        return pa.record_batch(
            [b.column("doc_id"), pa.array(counts), pa.array(np.diff(sums)), pa.array(crc, pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()), pa.array([x == t for x, t in zip(own, texts)], pa.bool_())],
            [x.split()[0] for x in DIGEST.split(", ")],
        )

    return _run(docs, model_path, zipf, DIGEST, made)
