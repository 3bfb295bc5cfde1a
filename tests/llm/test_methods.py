"""The dealt methods decide, and whole results are those of plain versions."""

import collections
import hashlib
import math
import random
import re
import struct

import brute
import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from test_documents import jaccard_groups, plain_lzw, texts_of

from seqloom.llm import bitsliced, gif, html_extract, packing, queries, sentencepieces, simhash, substring, toxicity, url_filter, warc
from seqloom.llm.shared import text_buffer

# ---- SentencePiece: ids of whole texts


def test_piece_ids_of_whole_texts(spark, sf):
    pieces = sentencepieces.load_pieces(queries.tokenizer_path("piece_bpe_32k.model"))
    table = {t.replace("▁", " ").encode(): i for i, t in enumerate(pieces.texts) if t}
    longest = max(map(len, table))
    unknown = np.float32(min(float(pieces.scores[i]) for i in table.values()) - 10)
    known = {}

    def solved(raw):
        best, back = [np.float32(0)] + [np.float32(-np.inf)] * len(raw), [None] * (len(raw) + 1)
        for a in range(len(raw)):
            if raw[a] & 0xC0 == 0x80:
                continue
            wide = next((k for k in range(1, 4) if a + k == len(raw) or raw[a + k] & 0xC0 != 0x80), 4)
            steps = [(n, table[raw[a : a + n]]) for n in range(1, min(longest, len(raw) - a) + 1) if raw[a : a + n] in table]
            if wide not in [n for n, _ in steps]:
                steps.append((wide, None))
            for n, i in steps:
                value = np.float32(best[a] + (unknown if i is None else pieces.scores[i]))
                if value > best[a + n]:
                    best[a + n], back[a + n] = value, (a, i)
        out, at = [], len(raw)
        while at:
            a, i = back[at]
            out.append([i] if i is not None else [int(pieces.byte_ids[b]) for b in raw[a:at]])
            at = a
        return [x for part in out[::-1] for x in part]

    bytes_ = set(pieces.byte_ids.tolist())
    texts = texts_of(spark, sf)
    for r in queries.op3_sentencepieces(spark, sf).collect():
        ids = []
        for part in re.findall(r" +[^ ]*", " " + texts[r.doc_id]) if texts[r.doc_id] else []:
            if part not in known:
                known[part] = solved(part.encode())
            ids += known[part]
        assert (r.n_ids, r.n_byte_ids, r.ids_crc32) == (len(ids), sum(i in bytes_ for i in ids), brute.crc(ids)), r.doc_id


# ---- HTML: layouts by hand; the template decides


def story(r, k, n=3):
    return [" ".join(r.choices("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split(), k=25)) + f" {k}" for _ in range(n)]


#: Layouts of a host: {h} is the page's title, {p} its paragraphs, {x} words that vary from page to page. The main text is
#: the title, if it is in the main part, and the paragraphs.
LAYOUTS = {
    "article": ("<nav><a href=/>{x}</a></nav><article><h1>{h}</h1>{p}</article><footer>{x}</footer>", True),
    "main": ("<header><h1>Site</h1></header><main><h2>{h}</h2>{p}</main><div>{x}</div>", True),
    "plain divs": ("<div>{x}</div><div><h1>{h}</h1>{p}</div><div>{x}</div>", True),
    "classes that say nothing": ("<div class=a1><a href=/>{x}</a></div><div class=b2><h1>{h}</h1>{p}</div><div class=c3>{x}</div>", True),
    "nested wrappers": ("<div id=w><div class=t>{x}</div><div class=c><div class=d><h1>{h}</h1>{p}</div></div><div class=z>{x}</div></div>", True),
    "constant notice inside": ("<div>{x}</div><div><p>This site says so on every page</p><h1>{h}</h1>{p}</div>", True),
    "constant end": ("<article><h1>{h}</h1>{p}<p>Follow us everywhere</p></article>", True),
    "share buttons": ("<article><h1>{h}</h1>{p}<div class=share-buttons>{x}</div></article>", True),
    "comment list": ("<article><h1>{h}</h1>{p}<section id=comments><p>{x}</p></section></article>", True),
    "advert inside": ("<article><h1>{h}</h1><div class='ad slot'>{x}</div>{p}</article>", True),
    "aside": ("<article><h1>{h}</h1><aside>{x}</aside>{p}</article>", True),
    "form": ("<article><h1>{h}</h1>{p}<form><label>{x}</label><input></form></article>", True),
    "script and style": ("<article><h1>{h}</h1><script>var a='{x}</p>'</script><style>p{{}}</style>{p}</article>", True),
    "role": ("<div role=navigation>{x}</div><div role=main><h1>{h}</h1>{p}</div><div role=contentinfo>{x}</div>", True),
    "old markup": ("<center>{x}</center><div><h1>{h}</h1>{p}</div><hr>", True),
    "title beside": ("<body><h1>{h}</h1><div class=body>{p}</div><div class=more>{x}</div></body>", True),
    "subject named like boilerplate": ("<article><h1>{h}</h1><div class=social-history>{p}</div></article>", True),
    "board": ("<div class=notice-board><h1>{h}</h1>{p}</div><div>{x}</div>", True),
    "related links": ("<article><h1>{h}</h1>{p}<div class=related><a href=/>{x}</a></div></article>", True),
    "cookie banner first": ("<div class=cookie-banner>{x}</div><section><h1>{h}</h1>{p}</section>", True),
}


@pytest.fixture(scope="module")
def layouts(spark):
    r, rows, want = random.Random(9), [], {}
    for i, (name, (html, _)) in enumerate(LAYOUTS.items()):
        for k in range(7):
            page_id, p = 100 * i + k, story(r, k)
            title = f"Title {k} of {name}"
            rows.append((page_id, f"http://host{i}.org/{k}", "<html><head><title>{h}</title></head><body>".format(h=title) + html.format(h=title, p="".join(f"<p>{x}</p>" for x in p), x=" ".join(r.choices("one two three four five six".split(), k=4)) + f" {k}") + "</body></html>"))
            want[page_id] = "\n\n".join([title, *p])
    return spark.createDataFrame(rows, "page_id long, url string, html string"), want


def test_layouts(layouts):
    pages, want = layouts
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    assert [list(LAYOUTS)[i // 100] for i in want if got[i] != want[i]] == []


def test_without_the_template_the_text_differs(layouts):
    pages, want = layouts
    alone = {r.page_id: r.text for r in html_extract.extract(pages, least_pages=100).collect()}
    unlike = {list(LAYOUTS)[i // 100] for i in want if alone[i] != want[i]}
    assert {"plain divs", "classes that say nothing", "nested wrappers", "constant notice inside", "constant end", "title beside", "board"} <= unlike


def test_texts_in_the_middle_of_long_runs(spark):
    """What most pages have is template wherever it stands in a run, however many texts the runs have and however pages are dealt."""
    rows, want = [], {}
    for k in range(12):
        p = [f"paragraph {i} of page {k}" for i in range(90)]
        shared = ["This notice stands on every page"] + ["This one on most pages"] * (k % 12 < 7)
        rows.append((k, f"http://a.org/{k}", "<article>" + "".join(f"<p>{x}</p>" for x in [*p[:30], *shared, *p[30:]]) + "</article>"))
        want[k] = "\n\n".join(p)
    # single texts first, then runs
    for k in range(20, 32):
        p = [f"paragraph {i} of page {k}" for i in range(1 if k < 26 else 3)]
        rows.append((k, f"http://b.org/{k}", "<article>" + "".join(f"<p>{x}</p>" for x in (["Only a notice"] if k in (20, 21, 22) else [*p, *["Only a notice"] * (k >= 26)])) + "</article>"))
        want[k] = "" if k in (20, 21, 22) else "\n\n".join(p)
    for parts in (1, 5):
        pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)
        got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
        assert [k for k in want if got[k] != want[k]] == []


def test_unlike_nodes_of_a_long_run_are_folded_whole():
    html = "<ul>" + "".join(f"<li><i class=c{i}>x</i><i class=d{i}>x</i></li>" for i in range(2000)) + "<li><code>the last</code></li></ul>"
    nodes = [x for t in html_extract._preorder(html_extract.template_of(html_extract.parse(html))) for x in t.nodes]
    assert len(nodes) == len({id(x) for x in nodes}) and sum(x.tag == "i" for x in nodes) == 4000 and sum(x.tag == "code" for x in nodes) == 1


def test_frequent_nodes_stay_in_a_template_of_any_size():
    t = html_extract.template_of(html_extract.parse("<div>" + "".join(f"<p class=c{i}>x</p>" for i in range(50)) + "</div>"))
    assert len(html_extract._preorder(html_extract.unpacked(html_extract.packed(t, 30, rare=0)))) == 102


@pytest.mark.parametrize("html", ["<div>" * 5000 + "x" + "</div>" * 5000, "<a " * 350_000, "<a \"" * 250_000 + ">", "<p><select>" + "<b>" * 30_000 + "<hr>" * 30_000, "<ul>" + "".join(f"<li><i class=c{i}>x</i>" for i in range(10_000))])
def test_odd_pages_take_seconds(html):
    import time

    t = time.process_time()
    page = html_extract.parse(html)
    html_extract.article(page)
    a, b = html_extract.template_of(page), html_extract.template_of(html_extract.parse(html.replace("c1", "d1") + "<b>x</b>"))
    host = html_extract.Wrapper(html_extract.unpacked(html_extract.packed(html_extract.merge(a, b))), 9, 5)
    host.applied(page)
    assert time.process_time() - t < 30


def test_template_bytes():
    t = html_extract.template_of(html_extract.parse("<div class=a><p>x<b>y</b></p><p>z</p></div><ul><li>1<li>2</ul>"))
    flat = lambda x: [(n.label, n.tag, n.text, n.pages, n.words, n.zone, len(n.kids)) for n in html_extract._preorder(x)]
    assert flat(html_extract.unpacked(html_extract.packed(t))) == flat(t)
    assert len(html_extract._preorder(html_extract.unpacked(html_extract.packed(t, 3)))) <= 3


def test_rare_nodes_leave_their_words_in_a_large_template():
    """Each page's article has a class of its own: what holds them all is the main part, also if the template is large."""
    pages = [html_extract.parse(f"<div class=a><div class=u{k}><p>{f'w{k} ' * 40}</p><a>{f'l{k} ' * 5}</a></div></div><div class=b>{f'x{k} ' * 9}</div>") for k in range(20)]
    parts = []
    for i in (0, 10):
        t = html_extract.template_of(pages[i])
        for x in pages[i + 1 : i + 10]:
            t = html_extract.merge(t, html_extract.template_of(x))
        parts.append(t)
    for rare in (0, 2):  # none goes, all that are in two pages or fewer go
        one, two = (html_extract.unpacked(html_extract.packed(x, 10 if rare else 10**6, rare)) for x in parts)
        whole = html_extract.unpacked(html_extract.packed(html_extract.merge(one, two), 10 if rare else 10**6, rare))
        parts = [html_extract.unpacked(html_extract.packed(x)) for x in parts]
        host = html_extract.Wrapper(whole, 20, 5)
        assert host.main.label == "div.a" and sum(x.words for x in html_extract._preorder(whole) if x.label == "#") == 20 * 54
        assert any("u3" in x.label for x in html_extract._preorder(whole)) == (not rare)
        page = pages[3]
        roots, constant, gone = host.applied(page)
        assert html_extract.article(page, constant, roots, gone).startswith("w3 w3") and "x3" not in html_extract.article(page, constant, roots, gone)


# ---- SimHash and near duplicates


def test_chains_decide(monkeypatch):
    fp = np.array([0b1011, 0b1010, 0b1000, 31 << 40], np.uint64)
    node = np.arange(4)
    assert sorted(simhash.forest(fp, node)) == [(1, 0), (2, 0)]
    calls = []
    monkeypatch.setattr(simhash, "linked", lambda a, b, *rest: calls.append(len(a)) or np.zeros((len(a), len(b)), bool))
    assert simhash.forest(fp, node) == [] and calls


def test_a_chain_has_budgets():
    a = np.zeros(1, np.uint64)
    one = np.uint64(1)
    parts = simhash.ring()
    spread = np.array([sum(one << np.uint64(s) for s, _ in parts[:4])], np.uint64)  # four bits, one in each of four segments
    assert [bool(simhash.linked(a, spread, chains=[c])[0, 0]) for c in range(5)] == [False, False, False, False, True]
    assert not simhash.linked(a, np.array([0b11111], np.uint64)).any()


def test_near_copies_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = jaccard_groups({r.doc_id: r.text for r in docs.collect()}, 0.8)
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert kept == {i for i, top in want.items() if i == top} and len(kept) < len(want)


# ---- substring deduplication


def test_words_decide_where_hashes_are_equal():
    words = lambda a, n=15: " ".join(f"{a}{i}" for i in range(n)).encode()
    rows = [(1, 7, words("a")), (2, 7, words("b")), (3, 7, words("a")), (4, 7, words("a", 20))]  # one sid for all
    got = list(substring._judge_shard(rows, 13))
    assert [(d, h) for d, _, h in got] == [(1, b""), (2, b""), (4, bytes([1, 1, 1, 0, 0, 0, 0, 0]))]


def test_every_path_of_a_key(documents):
    r = random.Random(11)
    hot = " ".join(f"h{i}" for i in range(16))
    texts = [f"{' '.join(r.choices('abcdefgh', k=r.randint(0, 20)))} {hot} {' '.join(r.choices('abcdefgh', k=r.randint(0, 20)))}" for _ in range(60)] + [hot] * 5
    docs = dict(enumerate(texts))
    for frequent in (1, 10, 1000):
        got = {x.doc_id: (x.n_removed, x.kept) for x in substring.repeated_spans(documents(texts).repartition(7), frequent=frequent).collect()}
        for i, (w, kept) in brute.kept_words(docs).items():
            assert got[i][0] == len(w) - len(kept) and brute.words(got[i][1]) == kept


# ---- GIF: the stored file by another decoder


def plain_gif(data):
    """Samples of all frames, row by row: no interlacing, no transparency, one grey palette."""
    assert data[:6] == b"GIF89a"
    flags, at, out = data[10], 13, b""
    palette = data[at : at + (3 << (flags & 7) + 1)]
    assert palette == bytes(x for i in range(256) for x in (i, i, i))
    at += len(palette)
    while data[at] != 0x3B:
        if data[at] == 0x21:
            at += 2
        else:
            left, top, w, h, bits = struct.unpack_from("<HHHHB", data, at + 1)
            assert (left, top, w, bits) == (0, 0, 64, 0)
            least, at, stream = data[at + 10], at + 11, b""
            while data[at]:
                stream += data[at + 1 : at + 1 + data[at]]
                at += 1 + data[at]
            at += 1
            px = plain_lzw(stream, least)
            assert len(px) == w * h
            out += px
            continue
        while data[at]:
            at += 1 + data[at]
        at += 1
    return out


def test_media_by_another_decoder(spark, sf):
    texts = texts_of(spark, sf)
    for r in queries.op7_gif_media(spark, sf).collect():
        data = (texts[r.doc_id] or "").encode()
        payload = data + b"\0" * (-len(data) % 64 or 64 * (not data))
        media = gif.store(payload)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        assert plain_gif(media) == payload
        counts = collections.Counter(b >> 4 for b in payload)
        assert r.feature == ",".join(str(counts[i]) for i in range(16))


# ---- toxicity: one window after the other


def test_scores_by_a_plain_pass():
    r = random.Random(12)
    texts = [" ".join(r.choices("good fine nice day sun road tree vile hate rot".split(), k=r.randint(1, 90))) for _ in range(80)]
    net = toxicity.train(texts, [int("vile" in t) for t in texts], 0.3, epochs=1, least_steps=20)
    some = [*texts[:6], "", "unseen Words! here"]
    buf, offs = text_buffer(pa.array(some))
    got = net.scores(buf, offs)
    p = {k: v.astype(float) for k, v in net.p.items()}
    sigmoid = lambda x: 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))

    def read(way, vectors):
        n, h, out = toxicity.STATE, np.zeros(toxicity.STATE), []
        for x in vectors if way == "f" else vectors[::-1]:
            a, g = x @ p[f"W{way}"] + p[f"b{way}"], h @ p[f"U{way}"]
            z = np.array([sigmoid(v) for v in a[:n] + g[:n]])
            c = np.tanh(a[2 * n :] + np.array([sigmoid(v) for v in a[n : 2 * n] + g[n : 2 * n]]) * g[2 * n :])
            h = z * h + (1 - z) * c
            out.append(h)
        return out if way == "f" else out[::-1]

    for text, score in zip(some, got.tolist()):
        v = toxicity.Vocabulary(*text_buffer(pa.array([text])))
        rows, vectors = [], []
        for u in v.word.tolist():
            at = int(np.searchsorted(net.known, v.hashes[u]))
            row = at + 1 if at < len(net.known) and net.known[at] == v.hashes[u] else 0
            grams = v.grams[v.gram_heads[u] : v.gram_heads[u] + v.gram_counts[u]]
            rows.append(row)
            vectors.append(np.concatenate([p["word"][row], p["gram"][grams].mean(axis=0)]))
        logits = []
        starts = sorted({min(s, max(0, len(vectors) - toxicity.WINDOW)) for s in range(0, max(1, len(vectors)), toxicity.STRIDE)})
        for s in starts:
            own = vectors[s : s + toxicity.WINDOW]
            if not own:
                logits.append(float(p["b"][0]))
                continue
            states = np.concatenate([read("f", own), read("b", own)], axis=1)
            e = np.tanh(states @ p["A"]) @ p["a"]
            weight = np.exp(e - e.max())
            logits.append(float((weight / weight.sum()) @ states @ p["w"] + p["b"][0]))
        assert abs(sigmoid(max(logits) + float(net.shift)) - score) < 1e-4


def test_sample_is_bounded_by_bytes(spark, documents, monkeypatch):
    texts = [("toxic words here " if i % 2 else "kind words there ") * 50 for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    twice = documents(texts).union(documents(texts))  # each id has two rows
    monkeypatch.setattr(toxicity, "train", lambda texts, labels, share: (len(texts), sum(labels)))
    assert [toxicity.fit(twice, labels, {1: 10, 0: 10}, sample_bytes=most) for most in (0, 3000, 1 << 20)] == [(0, 0), (2, 1), (20, 10)]


# ---- top-k


def test_stored_blocks_are_the_blocks():
    r = np.random.default_rng(3)
    for values in (r.integers(-300, 300, (200, 5)), np.zeros((70, 0), np.int64), r.integers(-(1 << 40), 1 << 40, (65, 3)), np.full((3, 2), 7)):
        a = bitsliced.Block(np.arange(len(values)), values.astype(np.int64))
        b = bitsliced.Block.of(a.stored())
        assert (a.slices == b.slices).all() and (a.values == b.values).all() and (a.rows == b.rows).all() and (a.shift, a.kept) == (b.shift, b.kept)
        q = values[0].astype(np.int64) // 10**6
        assert [x.tolist() for x in a.top(0, q, 4)] == [x.tolist() for x in b.top(0, q, 4)]


def test_topk_empty_vectors_and_repeated_queries(spark):
    df = spark.createDataFrame([(0, []), (1, []), (2, [1.0, 2.0]), (3, [-1.0])], "vec_id long, embedding array<float>")
    got = sorted(map(tuple, bitsliced.top_k(df, df.union(df), k=2).collect()))
    assert got == [(0, 1, 1, 0), (0, 2, 2, 0), (1, 1, 0, 0), (1, 2, 2, 0), (2, 1, 0, 0), (2, 2, 1, 0), (3, 1, 0, 0), (3, 2, 1, 0)]


def test_topk_says_what_is_no_long():
    ok, big = pa.array([[1e15, 1.0]], pa.list_(pa.float64())), pa.array([[1e30]], pa.list_(pa.float64()))
    keep, v = bitsliced.quantised(ok)
    assert v.tolist() == [[256 * 10**15, 256]]
    with pytest.raises(OverflowError):
        bitsliced.quantised(big)
    with pytest.raises(OverflowError):
        bitsliced.scores(v, v[0])
    assert bitsliced.scores(np.array([[1 << 61, -(1 << 61)]]), np.array([3, 3])).tolist() == [0]


# ---- packing


def test_long_runs_are_packed(documents, tokenizer):
    from tokenizers import Tokenizer

    texts = ["a" + " " * 2_000_000 + "b", "\n" * 2_000_000, "x" * 2_000_000]
    t = Tokenizer.from_file(tokenizer)
    want = {i: [*t.encode(x, add_special_tokens=False).ids, 1] for i, x in enumerate(texts)}
    rows = packing.pack(documents(texts), tokenizer).collect()
    for i, ids in want.items():
        for r in (r for r in rows if r.doc_id == i):
            assert r.doc_tokens == len(ids) and r.ids_crc32 == brute.crc(ids[r.start : r.start + r.length])
    assert sum(r.length for r in rows) == sum(map(len, want.values()))


def test_boundary_records(documents, tokenizer):
    tokens = packing.tokenized(documents(["one two three"] * 40).repartition(4), tokenizer)
    parts = packing.boundaries(tokens, 16)
    assert parts[0][1:] == (0, 0, 0) and all(at == 16 * s + have for _, at, s, have in parts)
    sizes = {r.part: r.n for r in tokens.groupBy("part").agg({"doc_tokens": "sum"}).withColumnRenamed("sum(doc_tokens)", "n").collect()}
    assert [b[1] - a[1] for a, b in zip(parts, parts[1:])] == [sizes[a[0]] for a in parts[:-1]]


# ---- URL filter and WARC


def test_cascade_in_parts(spark):
    hosts = [f"h{i}.example{i % 7}.net" for i in range(400)]
    listed = [*hosts[::9], "example3.net", "net.absent", hosts[0], None]
    df = spark.createDataFrame([(i, f"http://{h}/x", None) for i, h in enumerate(hosts)], "page_id long, url string, html string")
    want = {i for i, h in enumerate(hosts) if h in listed or h.endswith(".example3.net")}
    for most in (1 << 20, 64, 16):
        got = url_filter.judge_urls(df, (), spark.createDataFrame([(x,) for x in listed], "key string"), most_bytes=most).collect()
        assert {r.page_id for r in got if r.verdict == "block"} == want and len(got) == len(hosts)


def test_archives_are_cut_by_bytes(spark, tmp_path):
    sizes = [10] * 50 + [5000] * 20 + [60_000] * 6 + [300_000] * 3
    df = spark.createDataFrame([(i, f"http://a.org/{i}", chr(97 + i % 26) * n + str(i)) for i, n in enumerate(sizes)], "page_id long, url string, html string").coalesce(1)
    path = str(tmp_path / "w")
    warc.write_archives(warc.with_revisits(df), path, file_bytes=100_000, classes=(8000, 90_000))
    files = [f.stat().st_size for f in (tmp_path / "w").glob("part-*")]
    assert all(n <= 100_000 or n < 303_000 for n in files) and sum(n > 100_000 for n in files) == 3
    rows = warc.merged_index(warc.read_archives(spark, path)).collect()
    assert {r.page_id: r.payload_bytes for r in rows} == {i: len(str(i)) + n for i, n in enumerate(sizes)}


def test_wide_join_gives_the_same_revisits(spark, monkeypatch):
    rows = [(i, f"http://a.org/{i}", ("same text " * 20) if i % 3 else f"own {i} " * 30) for i in range(30)] + [(50, None, None), (51, None, None), (52, "u", "short"), (53, "u", "short")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    few = sorted((r.page_id, r.record_type, r.refers_to) for r in warc.with_revisits(df).collect())
    monkeypatch.setattr(warc, "BROADCAST_BYTES", 0)
    assert few == sorted((r.page_id, r.record_type, r.refers_to) for r in warc.with_revisits(df).collect())
    assert sum(k == "revisit" for _, k, _ in few) == 19


# ---- beyond the bounds of broadcasts the results are the same


def test_near_duplicates_by_joins(documents, odd, monkeypatch):
    from seqloom.llm import jaccard

    r = random.Random(13)
    bases = [[str(r.randint(0, 2000)) for _ in range(r.randint(15, 90))] for _ in range(5)]
    texts = list(odd[:6])
    for _ in range(80):
        w = list(r.choice(bases))
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = r.choice("xyz")
        texts.append(" ".join(w))
    monkeypatch.setattr(jaccard, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(jaccard, "HUB", 3)
    got = {x.doc_id: x.component_id for x in jaccard.near_duplicates(documents(texts).repartition(4), block=4, part=5).collect()}
    assert got == jaccard_groups(dict(enumerate(texts)), 0.8)


def test_odd_classes_bound_the_differences():
    from seqloom.llm import jaccard

    r = np.random.default_rng(2)
    a = r.integers(0, 1 << 63, 500).astype(np.uint64)
    for n in (0, 1, 7, 60, 300):
        b = np.concatenate([a[n:], r.integers(0, 1 << 63, n // 2).astype(np.uint64)])
        x, y = jaccard.odd_classes(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        words = min(len(x), len(y)) // 8
        differ = int(np.bitwise_count(jaccard._folded([x], words) ^ jaccard._folded([y], words)).sum())
        assert differ <= n + n // 2 and (differ > 0) == (n > 0)


# ---- the pipeline by its contract


def test_stages_by_the_contract(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.toxicity(spark, docs, sf).cache()
    want = jaccard_groups({r.doc_id: r.text for r in kept.collect()}, corpus_pipeline.SIMILARITY)
    kept = corpus_pipeline.near_dedup(spark, kept, sf).cache()
    rows = {r.doc_id: r for r in kept.collect()}
    assert kept.columns == docs.columns and set(rows) == {i for i, top in want.items() if i == top}

    want = brute.kept_words({i: r.text for i, r in rows.items()})
    kept = corpus_pipeline.substring_dedup(spark, kept, sf).cache()
    got = {r.doc_id: r for r in kept.collect()}
    assert kept.columns == docs.columns and set(got) == set(rows)
    for i, r in got.items():
        cut = len(want[i][0]) > len(want[i][1])
        assert brute.words(r.text) == want[i][1] and r.lang == rows[i].lang and (cut or r == rows[i])
        assert r.n_chars == (len(r.text) if cut else rows[i].n_chars)

    packed = corpus_pipeline.packing(spark, kept, sf).collect()
    whole = corpus_pipeline.run(spark, sf).collect()
    # cuts depend on the order of partitions; documents and their tokens don't
    tokens = lambda pieces: {(r.doc_id, r.doc_tokens) for r in pieces}
    assert {r.doc_id for r in packed} == set(got) and tokens(whole) == tokens(packed)
    assert sum(r.length for r in whole) == sum(r.length for r in packed)


def test_few_links_are_joined_without_rounds_of_jobs(spark, monkeypatch):
    """The jobs of the near-duplicate stage, which take the driver's memory: under 60; by both ways the same groups."""
    from seqloom.llm import jaccard

    r = np.random.default_rng(8)
    base = [" ".join(r.choice([f"w{i}" for i in range(900)], 80)) for _ in range(40)]
    texts = [" ".join(x.split()[:k]) for x in base for k in (80, 77, 74, 71, 68, 65)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    jobs = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    before = jobs()
    got = {x.doc_id: x.component_id for x in jaccard.near_duplicates(docs).collect()}
    took = jobs() - before
    assert got == jaccard_groups(dict(enumerate(texts)), 0.8) and len(set(got.values())) == 40
    assert took < 60, took

    ends = r.integers(-400, 400, (2, 700))
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in ends.T if a != b], "a long, b long")
    few = sorted(jaccard._components(edges).collect())
    monkeypatch.setattr(jaccard, "FEW_LINKS", 0)
    assert few == sorted(jaccard._components(edges).collect())
