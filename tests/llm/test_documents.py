"""Operators on documents against brute force."""

import hashlib
import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.llm import gif, jaccard, packing, queries, simhash, substring, toxicity


def texts_of(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


# ---- substring deduplication


def check_substrings(df, docs, **options):
    got = {r.doc_id: r for r in substring.repeated_spans(df, **options).collect()}
    want = brute.kept_words(docs)
    assert set(got) == set(docs)
    for i, (w, kept) in want.items():
        r = got[i]
        assert (r.n_words, r.n_removed) == (len(w), len(w) - len(kept)), i
        assert r.kept_sha256 == hashlib.sha256(b" ".join(kept)).hexdigest(), i
        assert sum(s.last - s.first for s in r.spans) == r.n_removed
        if r.kept is not None:
            assert brute.words(r.kept) == kept and (r.n_removed or r.kept == docs[i])


def test_substring_query(spark, sf):
    docs = texts_of(spark, sf)
    got = {r.doc_id: r for r in queries.op2_substring_dedup(spark, sf).collect()}
    for i, (w, kept) in brute.kept_words(docs).items():
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())


@pytest.mark.parametrize("options", [{}, {"frequent": 2}, {"most_bits": 12, "frequent": 1}])
def test_substring_random(documents, odd, options):
    r = random.Random(5)
    parts = [" ".join(r.choice("abcde") * r.randint(1, 2) for _ in range(r.randint(5, 60))) for _ in range(12)]
    texts = [*odd, *odd, *("  ".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(60))]
    check_substrings(documents(texts).repartition(5), dict(enumerate(texts)), **options)


def test_substring_ids(spark, documents):
    text = " ".join(map(str, range(30)))
    rows = substring.repeated_spans(documents([text, text, text, "x " + text], [None, 4, 4, 5]), carry=["lang", "key"]).collect()
    assert sorted(r.n_removed for r in rows) == [0, 0, 0, 30]  # no id; one document twice; a copy
    assert rows[0].carried.lang == "en" and rows[0].carried.key == 1
    assert substring.repeated_spans(documents([])).count() == 0


def test_suffix_automaton():
    r = random.Random(1)
    for _ in range(100):
        held = [[r.choice("abc") for _ in range(r.randint(1, 12))] for _ in range(4)]
        automaton = substring.SuffixAutomaton()
        for h in held:
            automaton.add(h)
        q = [r.choice("abc") for _ in range(15)]
        want = [max((n for n in range(1, i + 2) if any(q[i + 1 - n : i + 1] == h[k : k + n] for h in held for k in range(len(h)))), default=0) for i in range(15)]
        assert automaton.statistics(q) == want


# ---- SimHash


def test_xxh64_and_fingerprints(odd):
    import pyarrow as pa
    import xxhash

    from seqloom.llm.shared import text_buffer

    raw = np.frombuffer(random.Random(2).randbytes(3000) + b"\0" * 8, np.uint8)
    ends = np.arange(0, 2000, 7)
    starts = ends // 3
    got = simhash.hashes(raw, np.repeat(starts, 4), np.repeat(ends, 4))
    assert got[::4].tolist() == [xxhash.xxh64_intdigest(raw[a:b].tobytes(), seed=42) for a, b in zip(starts, ends)]
    buf, offs = text_buffer(pa.array(odd, pa.string()))
    for size in (4, 5):
        fp, n = simhash.fingerprints_of(buf, offs, size)
        assert fp.tolist() == [brute.simhash(t, size) for t in odd] and n.tolist() == [brute.shingles(t, size) for t in odd]


def test_simhash_query(spark, sf):
    fps = {i: brute.simhash(t, 4) for i, t in texts_of(spark, sf).items()}
    want = brute.components(fps, 4)
    rows = queries.op5_simhash_dedup(spark, sf).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{fps[i]:016x}", want[i]) for i in fps} and len(rows) == len(fps)


@pytest.mark.parametrize(("most", "segments", "block"), [(4, 5, 50_000), (4, 5, 6), (7, 8, 10)])
def test_links_give_components(spark, most, segments, block):
    r = random.Random(3)
    centres = [r.getrandbits(64) for _ in range(12)] + [0]
    fps = set(centres)
    for c in centres:
        for _ in range(15):
            for b in r.sample(range(64), r.randint(1, 6)):
                c ^= 1 << b
            fps.add(c)
    fps = dict(enumerate(sorted(fps)))
    df = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in fps.items()], "node long, fp long").withColumn("shingles", F.lit(0).cast("long")).repartition(3)
    found = {r.node: r.component for r in simhash.components(simhash.links(df, most, segments, block)).collect()}
    want = brute.components(fps, most)
    assert {i: found.get(i, i) for i in fps} == want


def test_short_texts_link_only_to_copies(documents):
    texts = ["", "a b c d e f", "a b c d e g", "a b c d e f", None, " ".join(map(str, range(40))), " ".join(map(str, range(41))), " ".join(map(str, range(60)))]
    rows = {r.doc_id: r.component_id for r in simhash.near_duplicates(documents(texts), most=32, segments=33, similarity=0.8).collect()}
    assert [rows[i] for i in range(5)] == [0, 1, 2, 1, 0] and rows[7] == 7
    assert simhash.alike(np.array([1], np.uint64), np.array([3], np.uint64), np.array([9]), np.array([9]), 4, 0.8).all()
    assert not simhash.alike(np.array([1], np.uint64), np.array([3], np.uint64), np.array([8]), np.array([8]), 4, 0.8).any()


def test_pigeonring_keeps_all_close_pairs():
    r = np.random.default_rng(4)
    a = r.integers(0, 1 << 63, 300).astype(np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for k in r.choice(64, i % 8, replace=False):
            b[i] ^= np.uint64(1) << np.uint64(k)
    close = np.bitwise_count(a[:, None] ^ b[None, :])
    assert (simhash.linked(a, b) == (close <= 4)).all()
    assert (simhash.linked(a, b, 7, 8) == (close <= 7)).all()


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (100, 101), (7, 7)], "a long, b long")
    found = {r.node: r.component for r in simhash.components(edges).collect()}
    assert {found[i] for i in range(61)} == {0} and found[101] == 100
    assert simhash.components(edges.where("false")).count() == 0


def test_simhash_odd(documents, odd):
    texts = [*odd, *odd, None]
    rows = simhash.near_duplicates(documents(texts, [*range(len(texts) - 1), None])).collect()
    assert len(rows) == len(texts)
    fps = {i: brute.simhash(t, 5) for i, t in enumerate(texts[:-1])}
    want = brute.components(fps, 4)
    assert all(r.component_id == want[0 if r.doc_id is None else r.doc_id] for r in rows)
    assert simhash.near_duplicates(documents([])).count() == 0


# ---- exact near duplicates


def jaccard_groups(docs, similarity):
    sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, min(1, len(w))))) for i, w in ((i, brute.WORD.findall(brute.low(t))) for i, t in docs.items())}
    top = {}
    for i in sorted(sets):
        hit = {top[j] for j in top if sets[i] == sets[j] or len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9 > 0}
        top[i] = min(hit, default=i)
        top.update((j, top[i]) for j in top if top[j] in hit)
    return top


@pytest.mark.parametrize("options", [{}, {"large": 2, "leaders": 1}, {"similarity": 0.6, "counted": 10, "large": 3, "leaders": 2}])
def test_jaccard_groups_are_exact(documents, odd, options):
    r = random.Random(6)
    bases = [[str(r.randint(0, 3000)) for _ in range(r.randint(20, 150))] for _ in range(8)]
    texts = [*odd, *odd]
    for _ in range(150):
        w = list(r.choice(bases))
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = r.choice("xyz")
        texts.append(" ".join(w).upper() + " " * r.randint(0, 2))
    docs = dict(enumerate(texts))
    got = {x.doc_id: x.component_id for x in jaccard.near_duplicates(documents(texts).repartition(5), **options).collect()}
    assert got == jaccard_groups(docs, options.get("similarity", 0.8))
    assert jaccard.near_duplicates(documents([])).count() == 0


# ---- GIF


def plain_lzw(stream, least):
    """A textbook decoder, bit by bit."""
    bits = "".join(f"{b:08b}"[::-1] for b in stream)
    clear, end, at, out = 1 << least, (1 << least) + 1, 0, b""
    width, table, last = least + 1, {i: bytes([i]) for i in range(clear)}, None
    free = end + 1
    while at + width <= len(bits):
        c = int(bits[at : at + width][::-1], 2)
        at += width
        if c == clear:
            width, table, last, free = least + 1, {i: bytes([i]) for i in range(clear)}, None, end + 1
            continue
        if c == end:
            break
        e = table[c] if c in table else last + last[:1]
        out += e
        if last is not None and free < 4096:
            table[free] = last + e[:1]
            free += 1
            if free == 1 << width and width < 12:
                width += 1
        last = e
    return out


@pytest.mark.parametrize("least", [2, 4, 8])
def test_lzw(least):
    r = np.random.default_rng(least)
    for n in (0, 1, 2, 300, 5000, 30_000):
        for data in (r.integers(0, 1 << least, n).astype(np.uint8).tobytes(), bytes(n), bytes(i % 3 for i in range(n))):
            stream = gif.lzw_encode(data, least)
            assert plain_lzw(stream, least) == data and gif.lzw_decode(stream, least, n) == data


def test_gif_rules():
    red_green = bytes([255, 0, 0, 0, 255, 0])
    a, b = np.zeros((2, 3), np.uint8), np.array([[1, 0]], np.uint8)
    for disposal, after in ((1, [0, 255, 0]), (2, [0, 0, 0]), (3, [255, 0, 0])):
        data = gif.encode([(0, 0, a, 5, 1, None), (1, 1, b, 7, disposal, 0), (0, 0, a[:1], 9, 0, None)], 3, 2, red_green)
        w, h, frames = gif.decode(data)
        assert (w, h, len(frames)) == (3, 2, 3) and [f.delay_ms for f in frames] == [50, 70, 90]
        assert frames[1].canvas[1, 1].tolist() == [0, 255, 0, 255]
        assert frames[1].canvas[1, 2].tolist() == [255, 0, 0, 255]  # transparent there
        assert frames[2].canvas[1, 1, :3].tolist() == after
        assert gif.histogram(frames[0].canvas, 2).tolist() == [0, 0, 0, 0, 6, 0, 0, 0]
    with pytest.raises(ValueError):
        gif.decode(b"PNG")


def test_gif_table(spark):
    good = gif.store(bytes(range(256)) * 300)
    df = spark.createDataFrame([("a", bytearray(good)), ("b", None), ("c", bytearray(b"x"))], "name string, content binary")
    rows = gif.gif_frames(df, "name", "content").orderBy("name", "frame").collect()
    assert [(r.name, r.frame, r.at_ms) for r in rows] == [("a", 0, 0), ("a", 1, 40), ("b", None, None), ("c", None, None)]


def test_gif_query(spark, sf, documents, odd):
    for df, docs in ((queries.op7_gif_media(spark, sf), texts_of(spark, sf)), (gif.text_media(documents(odd)), dict(enumerate(odd)))):
        rows = df.collect()
        assert len(rows) == len(docs)
        for r in rows:
            data = (docs[r.doc_id] or "").encode()
            payload = data + b"\0" * (-len(data) % 64 or 64 * (not data))
            assert (r.n_bytes, r.payload_bytes) == (len(data), len(payload))
            assert (r.payload_sha256, r.tail_crc32) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
            assert sum(map(int, r.feature.split(","))) == len(payload)


# ---- packing


def check_packing(rows, docs, tokenizer, length=2048):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x in docs.items()}
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
    for i, own in ids.items():
        at = 0
        for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(own) and r.ids_crc32 == brute.crc(own[at : at + r.length])
            at += r.length
        assert at == len(own)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s, parts in by.items():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at == length or s == max(by)


def test_packing_query(spark, sf, tokenizer):
    check_packing(queries.op10_packing(spark, sf).collect(), texts_of(spark, sf), tokenizer)


def test_packing_odd(documents, odd, tokenizer):
    texts = [*odd, "a <|endoftext|> b"]
    check_packing(packing.pack(documents(texts).repartition(3), tokenizer, length=64).collect(), dict(enumerate(texts)), tokenizer, 64)
    assert packing.pack(documents([]), tokenizer).count() == 0
    assert [r.length for r in packing.pack(documents([None], [None]), tokenizer).collect()] == [1]


# ---- toxicity


def test_gradients():
    r = np.random.default_rng(0)
    net = toxicity.Network(np.zeros(0, np.uint64), np.zeros((1, toxicity.PART)), np.zeros((4, toxicity.PART)))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    vectors, index, mask = r.normal(size=(9, 2 * toxicity.PART)), r.integers(0, 8, (5, 3)), np.ones((5, 3))
    mask[3:, 1] = 0
    arguments = (index, mask, np.array([1, 0, 1.0]), np.ones(3))
    _, g, dv = net.gradients(vectors, *arguments)
    for x, d in [(net.p[k].reshape(-1), g[k].reshape(-1)) for k in g] + [(vectors.reshape(-1), dv.reshape(-1))]:
        for i in (0, len(x) // 2):
            x[i] += 1e-4
            up = net.gradients(vectors, *arguments)[0]
            x[i] -= 2e-4
            down = net.gradients(vectors, *arguments)[0]
            x[i] += 1e-4
            assert abs((up - down) / 2e-4 - d[i]) < 2e-5


def test_windows_cover_all_words():
    for n in (0, 1, 31, 32, 33, 56, 57, 500):
        _, first, size = toxicity.windows_of(np.array([0, n, n + 3]))
        own = [(f, s) for f, s in zip(first, size) if f < max(n, 1) and f + s <= n]
        assert {k for f, s in own for k in range(f, f + s)} == set(range(n))


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op8_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    ones, zeros = ([r.score for r in rows if r.toxic == y] for y in (1, 0))
    auc = np.mean([(a > b) + (a == b) / 2 for a in ones for b in zeros])
    assert auc > 0.85
    assert sum(r.predicted for r in rows if not r.toxic) <= 2 and sum(r.predicted for r in rows if r.toxic) >= 0.6 * len(ones)


def test_toxicity_odd(spark, documents, odd):
    labels = spark.createDataFrame([(0, 1), (1, None), (None, 1), (2, 0), (3, 1)], "doc_id long, toxic int")
    rows = toxicity.with_scores(documents(odd), labels).collect()
    assert len(rows) == len(odd) and all(0 <= r.score <= 1 for r in rows) and rows[0].key == 1
    assert rows[0].score == rows[1].score == rows[2].score
    none = toxicity.with_scores(documents(odd), labels.where("false")).collect()
    assert all(r.score < 0.01 for r in none)
    assert toxicity.with_scores(documents([]), labels).count() == 0


def test_held_out_rule(spark):
    rows = spark.range(50).withColumn("h", toxicity.held_out(F.col("id"))).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in rows)
