"""Packing: documents are concatenated and cut into sequences of a fixed length.

Two passes. The first tokenises each document once and writes ids, the partition and the tokens before the document in
that partition. The totals of the partitions (one row each) give every partition its global offset by a prefix sum on the
driver. The second pass needs no shuffle: a document's global offset is its partition's plus its own, and the cuts fall at
the multiples of the sequence length. A boundary record (partition, global offset, the sequence that is open there and the
tokens it already has) is all that a partition needs to know of the ones before it; boundaries() gives these records.
"""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.shared import written

#: The pattern that splits a text before the merges of byte-level BPE (a fixed value of that public vocabulary).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Longer runs of blanks or of other characters go to the library: the rank encoder's pattern can't take a million of them.
LONGEST_RUN = 50_000

TOKENS = "doc_id long, part int, prefix long, doc_tokens long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


_RUNS = re.compile(r"\s+|\S+")
_LOADED: dict[str, BpeTokenizer] = {}


class BpeTokenizer:
    """Byte-level BPE by a tokenizer file of the `tokenizers` library: the same ids, by the ranks that its vocabulary implies.

    Plain texts go through the rank encoder, which is several times faster; a text that holds a special token's string or a
    run of over LONGEST_RUN characters without a change between blanks and others goes through the `tokenizers` library itself.
    """

    def __init__(self, path: str):
        import tiktoken

        spec = json.load(open(path, encoding="utf-8"))
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}
        special = {t["content"] for t in spec.get("added_tokens", ())}
        ranks = {bytes(letters[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
        self.path, self.special, self.library = path, special, None
        self.ranked = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    @staticmethod
    def of(path: str) -> BpeTokenizer:
        """The tokenizer of a file, loaded once in a process."""
        if path not in _LOADED:
            _LOADED[path] = BpeTokenizer(path)
        return _LOADED[path]

    def ids(self, text: str) -> bytes:
        """Ids as bytes of little-endian 32-bit integers."""
        if any(x in text for x in self.special) or (len(text) > LONGEST_RUN and any(m.end() - m.start() > LONGEST_RUN for m in _RUNS.finditer(text))):
            if self.library is None:
                os.environ["TOKENIZERS_PARALLELISM"] = "false"
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_file(self.path)
            return np.asarray(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.asarray(self.ranked(text), "<u4").tobytes()


def tokenized(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Each document's ids and its place in its partition, written to the shared folder. A null text has only end_id."""
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches):
        tokenizer, part, before = BpeTokenizer.of(tokenizer_path), TaskContext.get().partitionId(), 0
        for b in batches:
            ids = [(tokenizer.ids(x) if x else b"") + end for x in b.column("text").to_pylist()]
            n = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
            prefix = before + np.cumsum(n) - n
            before += int(n.sum())
            kept = [np.frombuffer(x, "<u4") for x in ids]
            kept = [x.astype("<u2").tobytes() if x.max() < 65536 else x.tobytes() for x in kept]
            yield pa.record_batch([b.column("doc_id"), pa.array(np.full(len(n), part, np.int32)), pa.array(prefix), pa.array(n), pa.array(kept, pa.binary())], ["doc_id", "part", "prefix", "doc_tokens", "ids"])

    return written(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, TOKENS), "tokens")


def boundaries(tokens: DataFrame, length: int = 2048) -> list[tuple[int, int, int, int]]:
    """(partition, global offset, open sequence, tokens that it already has) of each partition of tokenized(): a row for each
    on the driver, by prefix sums of their totals."""
    out, at = [], 0
    for r in sorted(tokens.groupBy("part").agg(F.sum("doc_tokens").alias("n")).collect()):
        out.append((r.part, at, at // length, at % length))
        at += r.n
    return out


def pack(docs: DataFrame, tokenizer_path: str, length: int = 2048, end_id: int = 1) -> DataFrame:
    """Packs every document into sequences of at most `length` tokens; one row for each piece of a document.

    docs: doc_id and text, other columns are ignored. The documents' ids, each with end_id after it, follow each other and
    are cut at the multiples of `length`, so only the last sequence of all can be short. A piece has: start (ids of its
    document before it), length, ids_crc32 (of its little-endian 32-bit ids), doc_tokens, sequence_id and offset there.
    A null or empty text is one piece of length 1; a null doc_id stays null; repeated rows are packed each; an empty
    table gives no rows. The order is that of partitions and rows as read, fixed by the written token table.
    """
    tokens = tokenized(docs, tokenizer_path, end_id)
    shared = docs.sparkSession.sparkContext.broadcast({part: at for part, at, _, _ in boundaries(tokens, length)})

    def run(batches):
        base = shared.value
        for b in batches:
            n = b.column("doc_tokens").to_numpy()
            if not len(n):
                continue
            at = b.column("prefix").to_numpy() + np.fromiter((base[p] for p in b.column("part").to_pylist()), np.int64, len(n))
            pieces = (at + n - 1) // length - at // length + 1
            row = np.repeat(np.arange(len(n)), pieces)
            k = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            low = np.maximum(at[row], (at[row] // length + k) * length)
            high = np.minimum(at[row] + n[row], (at[row] // length + k + 1) * length)
            start, size = low - at[row], high - low
            ids = [np.frombuffer(x, "<u2" if len(x) == 2 * m else "<u4").astype("<u4").tobytes() for x, m in zip(b.column("ids").to_pylist(), n.tolist())]
            crc = [zlib.crc32(ids[r][4 * s : 4 * (s + m)]) for r, s, m in zip(row.tolist(), start.tolist(), size.tolist())]
            yield pa.record_batch(
                [b.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(size), pa.array(crc, pa.int64()), pa.array(n[row]), pa.array(low // length), pa.array(low % length)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return tokens.mapInArrow(run, PIECES)
