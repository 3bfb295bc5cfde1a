"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs, in numpy.

A word's input is the vector of the word itself, if the labelled sample holds it often enough, and the mean vector of its
four-byte character grams. Two recurrent passes read a window of words, attention weighs their states, a logistic unit
gives the window's score. A text's score is that of its highest window; overlapping windows cover every word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.shared import chunks, text_buffer, word_hashes, words, written

WINDOW, STRIDE, STATE, PART = 32, 24, 8, 6
#: Words that a sample's documents hold less often have no vector of their own.
LEAST_DOCUMENTS, GRAM_BITS = 4, 15
#: The labelled sample: at most so many documents of each label, those with the smallest hashes of doc_id.
SAMPLE = {1: 1500, 0: 3000}
#: The most bytes of the sample's texts: of each label, documents go in by that order until its share of them is full.
SAMPLE_BYTES = 48 << 20
#: Windows of a document that train the network in an epoch, its most suspicious ones: of label 0; of label 1 in the first
#: epoch, and after it, when the network tells which window makes the document toxic. A share of other windows of label 0
#: comes on top, drawn anew each epoch. Scores take all windows.
TRAINED_WINDOWS, OTHER_WINDOWS = {0: (2, 2), 1: (2, 1)}, 1 / 3

_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[i for i in range(33, 127) if not chr(i).isalnum()]] = True


class Vocabulary:
    """Words of texts as unique hashes, and the grams of each unique word."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        low = buf.copy()
        low[(low >= 65) & (low <= 90)] += 32
        starts, ends, self.heads = words(low, offs)
        for _ in range(2):  # punctuation around a word
            starts = starts + ((ends - starts > 1) & _PUNCTUATION[low[starts]])
            ends = ends - ((ends - starts > 1) & _PUNCTUATION[low[ends - 1]])
        hashes = np.concatenate([word_hashes(low, starts[i : i + 100_000], ends[i : i + 100_000]) for i in range(0, max(1, len(starts)), 100_000)])
        self.hashes, first, self.word = np.unique(hashes, return_index=True, return_inverse=True)
        self.word = self.word.astype(np.int32)
        s, e = starts[first], ends[first]
        size = e - s + 2  # with a mark on either side
        at = np.concatenate([[0], np.cumsum(size)])
        marked = np.full(int(at[-1]) + 8, 62, np.uint8)
        marked[at[:-1]] = 60
        inner = np.repeat(s - at[:-1] - 1, size) + np.arange(at[-1])
        body = np.ones(int(at[-1]), bool)
        body[at[:-1]], body[at[1:] - 1] = False, False
        marked[: len(body)][body] = low[inner[body]]
        n = np.maximum(size - 3, 1)
        self.gram_heads = np.cumsum(n) - n
        pos = np.repeat(at[:-1] - self.gram_heads, n) + np.arange(n.sum())
        four = np.ndarray((len(marked) - 3,), "<u4", marked, strides=(1,))[pos].astype(np.uint64)
        self.grams = (four * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - GRAM_BITS)).astype(np.int64)
        self.gram_counts = n


def windows_of(heads: np.ndarray, size: int = WINDOW, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, words) of the overlapping windows of each text; a text without words has one empty window."""
    n = np.diff(heads)
    count = np.maximum(1, -(-np.maximum(n - size, 0) // stride) + 1)
    text = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    first = np.minimum(k * stride, np.maximum(n - size, 0)[text])
    return text, heads[:-1][text] + first, np.minimum(n[text], size)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters and passes. Word inputs have PART numbers from the word and PART from its grams."""

    NAMES = ("word", "gram", "Wf", "Uf", "bf", "Wb", "Ub", "bb", "A", "a", "w", "b")

    def __init__(self, known: np.ndarray, word: np.ndarray, gram: np.ndarray, seed: int = 7):
        r = np.random.default_rng(seed)
        d, h = 2 * PART, STATE
        self.known = known  # sorted hashes of the words with a vector; the vector before the first is that of other words
        p = {"word": word, "gram": gram}
        for x in "fb":
            p |= {f"W{x}": r.normal(0, d**-0.5, (d, 3 * h)), f"U{x}": r.normal(0, h**-0.5, (h, 3 * h)), f"b{x}": np.zeros(3 * h)}
        p |= {"A": r.normal(0, 0.3, (2 * h, h)), "a": r.normal(0, 0.3, h), "w": r.normal(0, 0.3, 2 * h), "b": np.zeros(1)}
        self.p = {k: v.astype(np.float32) for k, v in p.items()}
        self.shift = np.float32(0)

    def inputs(self, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
        """(row of the word table, input vector) of each unique word."""
        at = np.searchsorted(self.known, v.hashes)
        hit = (at < len(self.known)) & (self.known[np.minimum(at, len(self.known) - 1)] == v.hashes) if len(self.known) else np.zeros(len(at), bool)
        row = np.where(hit, at + 1, 0)
        mean = np.add.reduceat(self.p["gram"][v.grams], v.gram_heads, axis=0) / v.gram_counts[:, None] if len(v.hashes) else np.zeros((0, PART), np.float32)
        return row, np.concatenate([self.p["word"][row], mean], axis=1).astype(np.float32)

    def _read(self, x: np.ndarray, mask: np.ndarray, way: str, keep: bool):
        """States (time, batch, STATE) of one direction; x holds the projected inputs (time, batch, 3 * STATE)."""
        u, h, n = self.p[f"U{way}"], np.zeros((x.shape[1], STATE), x.dtype), STATE
        out, trace = np.zeros((*x.shape[:2], STATE), x.dtype), []
        for t in range(len(x)) if way == "f" else range(len(x) - 1, -1, -1):
            g = h @ u
            zr = _sigmoid(x[t, :, : 2 * n] + g[:, : 2 * n])
            z, r = zr[:, :n], zr[:, n:]
            c = np.tanh(x[t, :, 2 * n :] + r * g[:, 2 * n :])
            new = h + mask[t][:, None] * (1 - z) * (c - h)
            if keep:
                trace.append((t, h, z, r, c, g[:, 2 * n :]))
            h = new
            out[t] = h
        return out, trace

    def forward(self, vectors: np.ndarray, index: np.ndarray, mask: np.ndarray, keep: bool = False, projected=None):
        """Logits of windows: index (time, batch) into vectors, mask 1 where there is a word."""
        p = self.p
        both, traces = [], {}
        for way in "fb":
            table = vectors @ p[f"W{way}"] + p[f"b{way}"] if projected is None else projected[way]
            s, traces[way] = self._read(table[index], mask, way, keep)
            both.append(s)
        s = np.concatenate(both, axis=2)
        e = np.tanh(s @ p["A"])
        score = e @ p["a"] - 30 * (1 - mask)
        alpha = np.exp(score - score.max(axis=0))
        alpha *= mask
        alpha /= np.maximum(alpha.sum(axis=0), 1e-9)
        pooled = np.einsum("tb,tbh->bh", alpha, s)
        logit = pooled @ p["w"] + p["b"][0]
        return (logit, (s, e, alpha, pooled, traces)) if keep else logit

    def gradients(self, vectors: np.ndarray, index: np.ndarray, mask: np.ndarray, label: np.ndarray, weight: np.ndarray):
        """(loss, gradients of the parameters, gradient of vectors) of the weighted logistic loss."""
        p, g = self.p, {}
        logit, (s, e, alpha, pooled, traces) = self.forward(vectors, index, mask, True)
        prob = _sigmoid(logit)
        d = (prob - label) * weight / len(label)
        g["w"], g["b"] = pooled.T @ d, np.array([d.sum()], np.float32)
        dp = d[:, None] * p["w"]
        ds = alpha[..., None] * dp
        da = np.einsum("tbh,bh->tb", s, dp)
        dscore = alpha * (da - (alpha * da).sum(axis=0))
        g["a"] = np.einsum("tbh,tb->h", e, dscore)
        de = dscore[..., None] * p["a"] * (1 - e * e)
        g["A"] = np.einsum("tbh,tbk->hk", s, de)
        ds = ds + de @ p["A"].T
        dv = np.zeros_like(vectors)
        n, used = STATE, mask > 0
        for way, part in (("f", ds[..., :n]), ("b", ds[..., n:])):
            u, dh = p[f"U{way}"], np.zeros((index.shape[1], n), vectors.dtype)
            du, dx = np.zeros_like(u), np.zeros((*index.shape, 3 * n), vectors.dtype)
            for t, h, z, r, c, gc in reversed(traces[way]):
                m = mask[t][:, None]
                dn = dh + part[t]
                dc = dn * m * (1 - z) * (1 - c * c)
                dz = -dn * m * (c - h) * z * (1 - z)
                dr = dc * gc * r * (1 - r)
                dx[t] = np.concatenate([dz, dr, dc], axis=1)
                dg = np.concatenate([dz, dr, dc * r], axis=1)
                du += h.T @ dg
                dh = dn * (1 - m * (1 - z)) + dg @ u.T
            flat = dx[used]
            g[f"U{way}"], g[f"b{way}"] = du, flat.sum(axis=0)
            g[f"W{way}"] = vectors[index[used]].T @ flat
            np.add.at(dv, index[used], flat @ p[f"W{way}"].T)
        loss = -(weight * (label * np.log(prob + 1e-7) + (1 - label) * np.log(1 - prob + 1e-7))).mean()
        return loss, g, dv

    def scores(self, buf: np.ndarray, offs: np.ndarray, at_once: int = 4096) -> np.ndarray:
        """The score of each text."""
        v = Vocabulary(buf, offs)
        _, vectors = self.inputs(v)
        vectors = np.concatenate([vectors, np.zeros((1, 2 * PART), np.float32)])
        projected = {way: vectors @ self.p[f"W{way}"] + self.p[f"b{way}"] for way in "fb"}
        text, first, size = windows_of(v.heads)
        out = np.full(len(offs) - 1, -np.inf, np.float32)
        for i in range(0, len(text), at_once):
            index, mask = _filled(v.word, first[i : i + at_once], size[i : i + at_once], len(v.hashes))
            np.maximum.at(out, text[i : i + at_once], self.forward(vectors, index, mask, projected=projected))
        return _sigmoid(out.astype(np.float64) + self.shift)


def _filled(word: np.ndarray, first: np.ndarray, size: np.ndarray, empty: int) -> tuple[np.ndarray, np.ndarray]:
    """(index, mask) of windows, time first; `empty` stands for no word."""
    steps = np.arange(max(1, int(size.max(initial=1))))
    mask = steps[:, None] < size
    index = np.where(mask, word[np.minimum(first + steps[:, None], max(0, len(word) - 1))], empty) if len(word) else np.full(mask.shape, empty)
    return index, mask.astype(np.float32)


def _log_odds(one: np.ndarray, n: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Log odds of label 1, shrunk for few documents, of items that n documents hold, `one` of them with label 1."""
    odds = np.log((one + 0.5) / (label.sum() + 1)) - np.log((n - one + 0.5) / (len(label) - label.sum() + 1))
    return odds * n / (n + 4)


def _document_counts(v: Vocabulary, label: np.ndarray, at_once: int = 128) -> tuple[np.ndarray, ...]:
    """(documents, those with label 1) of each unique word, then of each gram; a few documents at a time."""
    out = [np.zeros(len(v.hashes)), np.zeros(len(v.hashes)), np.zeros(1 << GRAM_BITS), np.zeros(1 << GRAM_BITS)]
    for a in range(0, len(label), at_once):
        b = min(a + at_once, len(label))
        doc = np.repeat(np.arange(a, b), np.diff(v.heads[a : b + 1]))
        pairs = np.unique(v.word[v.heads[a] : v.heads[b]].astype(np.int64) * len(label) + doc)
        u, d = pairs // len(label), pairs % len(label)
        n = v.gram_counts[u]
        row = np.repeat(np.arange(len(u)), n)
        gram = v.grams[v.gram_heads[u][row] + np.arange(len(row)) - (np.cumsum(n) - n)[row]]
        pairs = np.unique(gram * len(label) + d[row])
        for i, x, y in ((0, u, d), (2, pairs // len(label), pairs % len(label))):
            np.add.at(out[i], x, 1)
            np.add.at(out[i + 1], x, label[y])
    return tuple(out)


def train(texts: list[str | None], labels: list[int], share: float, epochs: int = 3, least_steps: int = 240, seed: int = 7) -> Network:
    """A network for the texts' labels. share: that of label 1 among all labelled documents, which the scores keep to.

    The vectors' first number starts as the shrunk log odds of the word or gram. Each document trains its most suspicious
    windows (by those odds first, by the network from the second epoch on), TRAINED_WINDOWS of them, and some random ones.
    Training ends after `epochs` rounds and least_steps steps. Texts of one label alone give
    a network that scores 0 or 1 as that label says.
    """
    label = np.asarray(labels, np.float32)
    r = np.random.default_rng(seed)
    v = Vocabulary(*text_buffer(pa.array(texts, pa.string())))
    n, one, gram_n, gram_one = _document_counts(v, label)
    odds = _log_odds(one, n, label)
    often = np.flatnonzero(n >= LEAST_DOCUMENTS)
    word = r.normal(0, 0.1, (len(often) + 1, PART))
    word[0, 0], word[1:, 0] = 0, odds[often]
    gram = r.normal(0, 0.1, (1 << GRAM_BITS, PART))
    gram[:, 0] = _log_odds(gram_one, gram_n, label)
    net = Network(v.hashes[often], word, gram, seed)
    ones = float(label.sum())
    if not 0 < ones < len(label):
        net.p["w"][:] = 0
        net.p["b"][0] = 20 if ones else -20
        return net
    text, first, size = windows_of(v.heads)
    per_word = np.maximum(np.append(odds, 0), 0).astype(np.float32)
    index, mask = _filled(v.word, first, size, len(v.hashes))
    rank = np.concatenate([(per_word[index[:, i : i + 1024]] * mask[:, i : i + 1024]).sum(axis=0) for i in range(0, len(text), 1024)])
    state = {k: (np.zeros_like(x), np.zeros_like(x)) for k, x in net.p.items()}
    step = epoch = 0
    while epoch < epochs or step < least_steps:
        if epoch:
            vectors = np.concatenate([net.inputs(v)[1], np.zeros((1, 2 * PART), np.float32)])
            projected = {way: vectors @ net.p[f"W{way}"] + net.p[f"b{way}"] for way in "fb"}
            rank = np.concatenate([net.forward(vectors, index[:, i : i + 1024], mask[:, i : i + 1024], projected=projected) for i in range(0, len(text), 1024)])
            del vectors, projected
        order = np.lexsort((-rank, text))
        place = np.arange(len(text)) - np.searchsorted(text[order], text[order])
        most = np.array([TRAINED_WINDOWS[y][epoch > 0] for y in (0, 1)])
        chosen = order[place < most[(label[text[order]] > 0).astype(int)]]
        spare = r.permutation(np.flatnonzero(label[text] == 0))[: int(len(chosen) * OTHER_WINDOWS)]
        chosen = r.permutation(np.concatenate([chosen, spare]))
        for i in range(0, len(chosen), 128):
            own = chosen[i : i + 128]
            used, at = np.unique(np.append(index[:, own], len(v.hashes)), return_inverse=True)
            at = at[:-1].reshape(index.shape[0], len(own))
            row, vectors = _some(net, v, used)
            _, g, dv = net.gradients(vectors, at, mask[:, own], label[text[own]], np.ones(len(own), np.float32))
            dv = dv[:-1] if used[-1] == len(v.hashes) else dv
            g["word"] = np.zeros_like(net.p["word"])
            np.add.at(g["word"], row, dv[:, :PART])
            g["gram"] = np.zeros_like(net.p["gram"])
            counts = v.gram_counts[used[:-1]]
            rep = np.repeat(np.arange(len(counts)), counts)
            inside = np.arange(len(rep)) - np.repeat(np.cumsum(counts) - counts, counts)
            np.add.at(g["gram"], v.grams[v.gram_heads[used[:-1]][rep] + inside], (dv[:, PART:] / counts[:, None])[rep])
            step += 1
            rate = 0.01 * min(1, step / 20)
            for k, x in net.p.items():
                m, s = state[k]
                m += 0.1 * (g[k] - m)
                s += 0.01 * (g[k] * g[k] - s)
                x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
        epoch += 1
    trained = ones / len(label)
    share = min(max(share, 1e-4), 1 - 1e-4)
    net.shift = np.float32(np.log(share / (1 - share)) - np.log(trained / (1 - trained)))
    return net


def _some(net: Network, v: Vocabulary, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """inputs() of some unique words; the last of `used` stands for no word."""
    used = used[:-1]
    at = np.searchsorted(net.known, v.hashes[used])
    hit = (at < len(net.known)) & (net.known[np.minimum(at, max(0, len(net.known) - 1))] == v.hashes[used]) if len(net.known) else np.zeros(len(used), bool)
    row, counts = np.where(hit, at + 1, 0), v.gram_counts[used]
    heads = np.cumsum(counts) - counts
    rep = np.repeat(np.arange(len(used)), counts)
    mean = np.add.reduceat(net.p["gram"][v.grams[v.gram_heads[used][rep] + np.arange(len(rep)) - heads[rep]]], heads, axis=0) / counts[:, None] if len(used) else np.zeros((0, PART), np.float32)
    vectors = np.concatenate([net.p["word"][row], mean], axis=1)
    return row, np.concatenate([vectors, np.zeros((1, 2 * PART), np.float32)]).astype(np.float32)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is 1 modulo 3."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, sample: dict[int, int] = SAMPLE, column: str = "toxic", sample_bytes: int = SAMPLE_BYTES) -> Network:
    """Trains on labelled rows (doc_id, `column`) that are not held out: at most sample[label] documents of each label, and as many
    as sample_bytes hold. They come by the hashes of their ids, whole.

    Rows with a null id or label teach nothing; an id with several rows teaches its least text alone.
    """
    known = labels.select(F.col("doc_id").cast("long"), F.col(column).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for y, most in sorted(sample.items()):
        part = known.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = part if chosen is None else chosen.union(part)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id")
    rows = written(rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")), "sample")  # sum(sample) documents at most
    # the running bytes of each label: over as many rows
    before = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id"))
    share = F.element_at(F.create_map(*[F.lit(x) for y, n in sample.items() for x in (y, sample_bytes * n // max(1, sum(sample.values())))]), F.col("label"))
    rows = rows.withColumn("_bytes", before).where(F.col("_bytes") <= share).drop("_bytes").collect()
    rows.sort(key=lambda r: (r.doc_id, r.text or ""))
    total, texts, known = sum(counts.values()), [r.text for r in rows], [r.label for r in rows]
    del rows
    return train(texts, known, counts.get(1, 0) / total if total else 0.0)


def scorer(docs: DataFrame, net: Network):
    """A function of a text column: the score of the whole text; null like empty."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @F.arrow_udf("double")
    def toxic_score(text: pa.Array) -> pa.Array:
        buf, offs = text_buffer(text)
        parts = [shared.value.scores(buf[offs[i] : offs[j] + 8], offs[i : j + 1] - offs[i]) for i, j in chunks(offs, 1 << 19)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return toxic_score


def with_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: dict[int, int] = SAMPLE) -> DataFrame:
    """docs with score (0 to 1, higher: toxic likelier) and predicted (1 if score >= threshold, else 0).

    All columns of docs stay; a score or predicted column of docs is replaced. Every row gets a score, from its text alone:
    a null or empty text that of a window without words. Without usable labels every score is near 0.
    """
    score = scorer(docs, fit(docs, labels, sample))
    out = docs.withColumn("score", score(F.col("text").cast("string")))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
