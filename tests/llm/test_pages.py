"""Operators on pages, vectors and pieces."""

import hashlib
import random

import numpy as np
import pytest

from seqloom.llm import bitsliced, html_extract, queries, sentencepieces, url_filter, warc

RULES = queries.URL_RULES


def pages(spark, *rows):
    return spark.createDataFrame([(i, *r, "x", 1) for i, r in enumerate(rows)], "page_id long, url string, html string, host string, rule int")


# ---- URL filter


def test_url_rules(spark):
    urls = ["http://A.B.org/x?y", "https://www.example.org/es/1", "http://example.org/en/12", "http://example.org", "https://x.com/fr/#t", "http://com/de/", "http://notorg/", "ftp://spam-farm.example.com", "no url", None, "http://m.adult-x.example.net/a", "http://adult-x.example.net.de/a"]
    rows = {r.url: r for r in url_filter.judge_urls(pages(spark, *((u, None) for u in urls)), RULES).collect()}
    got = [(rows[u].host, rows[u].path, rows[u].rule, rows[u].verdict) for u in urls]
    assert got == [
        ("a.b.org", "/x", "org/", "allow"), ("www.example.org", "/es/1", "example.org/es/", "block"), ("example.org", "/en/12", "example.org/en/1", "block"), ("example.org", "", None, "allow"),
        ("x.com", "/fr/", "com/fr/", "allow"), ("com", "/de/", "com/de/", "block"), ("notorg", "/", None, "allow"), ("spam-farm.example.com", "", None, "block"),
        ("", "", None, "allow"), ("", "", None, "allow"), ("m.adult-x.example.net", "/a", None, "block"), ("adult-x.example.net.de", "/a", None, "allow"),
    ]
    assert url_filter.judge_urls(pages(spark), RULES).count() == 0


def test_cascade_is_exact(spark):
    keys = [f"host{i}.example" for i in range(3000)]
    listed = keys[::7] + ["absent.example"]
    cascade = url_filter.build_cascade(spark.createDataFrame([(k,) for k in [*keys, *keys[:50], None]], "key string"), listed)
    assert (cascade.listed(keys) == np.isin(keys, listed)).all() and len(cascade.levels) > 1
    assert cascade.size() < 3000


def test_filter_without_room_for_a_cascade(spark):
    df = pages(spark, *((f"http://h{i}.example.net/", None) for i in range(40)))
    small, join = (sorted((r.page_id, r.verdict) for r in url_filter.judge_urls(df, (), ["h3.example.net", "h5.example.net"], n).collect()) for n in (1 << 20, 1))
    assert small == join and sum(v == "block" for _, v in small) == 2


# ---- HTML


def text(html):
    return html_extract.article(html_extract.parse(html))


@pytest.mark.parametrize(("html", "want"), [
    ("", ""), ("plain &amp; text", "plain & text"), ("<p>a\n  b<br>c<p>d", "a b c\n\nd"), ("<p>x<b>y</b>z", "xyz"),
    ("<nav>menu</nav><article><h1>T</h1><p>One</p><aside>no</aside><form>no</form></article><footer>no</footer>", "T\n\nOne"),
    ("<header><h1>Site</h1></header><main><p>A</p></main><div>out</div>", "A"),
    ("<div class='content'><p>A</p></div><div class=cookie-banner>no</div><div id=comments><p>no</p></div>", "A"),
    ("<article>A<div class='comment-list'>no</div><script>if (a<b) x('</p>')</script></article><article class='comment'>no</article>", "A"),
    ("<p>caf&eacute; &#8364;&#x20AC; &lt;b&gt;</p><!-- c <p>no</p> --><style>p{}</style>", "café €€ <b>"),
    ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a\n\nb\n\nc\n\nd"), ("<p>cut <b>off", "cut off"), ("<div hidden>no</div><p>a</p>", "a"), ("a < b <3", "a < b <3"),
    ("<div class='page has-sidebar ads-free'><article>A</article></div>", "A"), ("<div class='page sidebar'><article>A</article></div>", "A"),
])
def test_article(html, want):
    assert text(html) == want


def test_wrapper_induction(spark):
    html = "<body><div><p>Every page says this</p></div><div><p>story {0} one</p><p>story {0} two</p></div><div><p>And this too</p></div></body>"
    df = pages(spark, *((f"http://h.org/{i}", html.format(i)) for i in range(8)), ("http://other.org/", html.format(9)), (None, None), ("http://h.org/x", ""))
    for most in (1 << 20, 0):
        rows = {r.page_id: r.text for r in html_extract.extract(df, most_bytes=most).collect()}
        assert [rows[i] for i in range(8)] == [f"story {i} one\n\nstory {i} two" for i in range(8)]
        assert rows[8] == "Every page says this\n\nstory 9 one\n\nstory 9 two\n\nAnd this too"  # one page teaches nothing
        assert rows[9] == rows[10] == "" and len(rows) == 11
    assert html_extract.extract(df.where("false")).count() == 0


@pytest.mark.parametrize("parts", [1, 8])
def test_copies_of_a_page_are_no_template(spark, parts):
    html = "<body><h1>Title</h1><div><p>Only story</p></div></body>"
    df = pages(spark, *((f"http://h.org/{i}", html) for i in range(40)), ("http://h.org/other", html.replace("story", "tale"))).repartition(parts)
    assert html_extract.host_templates(df).first().pages == 2
    rows = html_extract.extract(df).collect()
    assert len(rows) == 41 and all(r.text == f"Title\n\nOnly {'story' if r.page_id < 40 else 'tale'}" for r in rows)


def test_templates_merge_in_any_order():
    a, b, c = (html_extract.template_of(html_extract.parse(x)) for x in ("<div><p>k</p><i>1</i></div>", "<div><p>k</p><b>x</b><i>2</i></div>", "<div><p>k</p></div>"))
    for t in (html_extract.merge(html_extract.merge(a, b), c),):
        div = t.kids[0]
        assert [k.label for k in div.kids] == ["p", "b", "i"] and div.kids[0].kids[0].text == "k" and div.kids[2].kids[0].text is None and div.pages == 3


def test_html_query(spark, sf):
    rows = queries.op4_html_extraction(spark, sf).collect()
    html = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert len(rows) == len(html)
    for r in rows:
        assert r.n_chars == len(r.text) and r.text and "<" not in r.text.replace("<<", "")
        assert r.text == text(html[r.page_id]) or len(r.text) < len(text(html[r.page_id]))


# ---- WARC


def test_loser_tree():
    r = random.Random(1)
    for k in range(9):
        runs = [sorted((r.randint(0, 30), i, j) for j in range(r.randint(0, 20))) for i in range(k)]
        assert list(warc.LoserTree([list(x) for x in runs])) == sorted(x for run in runs for x in run)


def test_warc(spark, tmp_path):
    big = "é" * 60
    df = pages(spark, ("http://B.org/z", big), ("http://a.org/", "small"), ("http://a.org/", big), (None, None), ("x y\r\nz://q/w", "small"), ("http://a.org/", "WARC/1.1\r\n\r\n" * 20))
    df = df.union(df.where("page_id = 2"))
    rows = warc.capture_histories(df).collect()
    assert len(rows) == 7
    for r in rows:
        payload = [big, "small", big, "", "small", "WARC/1.1\r\n\r\n" * 20][r.page_id].encode()
        assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 0) if r.page_id == 2 else ("response", None))
    assert [(r.url_key, r.capture_ts) for r in rows] == sorted((r.url_key, r.capture_ts) for r in rows)
    assert warc.capture_histories(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        list(warc.records(b"WARC/1.1\r\nContent-Length: 90\r\n\r\nshort"))


def test_archives_are_plain_warc(spark, tmp_path):
    warc.write_archives(warc.with_revisits(pages(spark, ("http://a.org/", "x\ny"))), str(tmp_path / "w"))
    data = next((tmp_path / "w").glob("part-*.txt")).read_bytes()
    (_, size, head, block), = warc.records(data)
    assert size == len(data) and head["warc-target-uri"] == "http://a.org/" and block.endswith(b"\r\n\r\nx\ny")


# ---- top-k


def brute_top(vectors, query, k):
    q = vectors[query]
    return sorted(((-int(np.dot(q, v)), i) for i, v in vectors.items() if i != query))[:k]


@pytest.mark.parametrize("kept", [2, 7, 20])
def test_topk_blocks(kept):
    r = np.random.default_rng(kept)
    values = np.floor(256 * r.normal(size=(300, 12)) / 3).astype(np.int64)
    values[5] = values[6] = values[7]
    values[9] = 0
    ids = r.permutation(300).astype(np.int64)
    block = bitsliced.Block(ids, values, kept)
    table = dict(zip(ids.tolist(), values))
    for row in (0, 5, 9, 17):
        i, s = block.top(int(ids[row]), values[row], 5)
        assert [(-a, b) for a, b in zip(s.tolist(), i.tolist())] == brute_top(table, int(ids[row]), 5)


def test_topk_odd(spark):
    rows = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [-1.0, 2.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (None, [1.0, 1.0]), (7, [1.0, 0.5]), (8, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in bitsliced.top_k(df, df.where("vec_id in (0, 3, 8)"), block=2, at_once=1).orderBy("query_id", "rank").collect()]
    one = 256 * 256 + 128 * 128
    assert got == [(0, 1, 1, one), (0, 2, 7, one), (0, 3, 2, 0), (0, 4, 8, 0), *((8, n, i, 0) for n, i in enumerate((0, 1, 2, 7), 1))]
    assert bitsliced.top_k(df.where("false"), df.where("false")).count() == 0


# ---- SentencePiece


def test_double_array():
    r = random.Random(2)
    keys = {bytes(r.choices(range(256), k=r.randint(1, 6))): i for i, _ in enumerate(range(400))}
    trie = sentencepieces.DoubleArray(keys)
    text = np.frombuffer(b"".join(keys) + b"\0" * 8, np.uint8)
    n = len(text) - 8
    which, length, value = trie.matches(text, np.arange(n), np.full(n, n))
    raw = text.tobytes()[:n]
    assert set(zip(which.tolist(), length.tolist(), value.tolist())) == {(i, len(k), v) for k, v in keys.items() for i in range(n) if raw.startswith(k, i)}


@pytest.fixture(scope="module")
def model():
    path = queries.tokenizer_path("piece_bpe_32k.model")
    return path, sentencepieces.Unigram(sentencepieces.load_pieces(path))


def library(path, pieces):
    """The library with the same pieces and scores as a unigram model."""
    from sentencepiece import SentencePieceProcessor
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(open(path, "rb").read())
    m.trainer_spec.model_type = 1
    for p, s in zip(m.pieces, pieces.scores):
        p.score = float(s)
    return SentencePieceProcessor(model_proto=m.SerializeToString())


def test_pieces_match_the_library(spark, sf, model):
    import pyarrow as pa

    from seqloom.llm.shared import text_buffer

    path, unigram = model
    lib = library(path, unigram.pieces)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    # by word, as sums over long texts are rounded to single precision there
    words = sorted({w for t in texts for w in t.split(" ")}) + ["", " ", "  a  b ", "\n\n x\ty", "日本語 テスト 😀😀 x", "é" * 90, "\x00\x7f~`|", "𝔘𝔫𝔦 ok"]
    ids, counts = unigram.encode(*text_buffer(pa.array(words)))
    edge = np.concatenate([[0], np.cumsum(counts)])
    for i, w in enumerate(words):
        own = ids[edge[i] : edge[i + 1]].tolist()
        assert own == lib.encode(w), w
        assert unigram.decode(own) == w


def test_pieces_round_trip(spark, documents, odd, model):
    path, _ = model
    df = documents([*odd, "▁mark ▁▁"])
    rows = sentencepieces.decode(sentencepieces.encode(df, path), path).orderBy("doc_id").collect()
    assert [r.text for r in rows] == [*((t or "") for t in odd), " mark   "]
    assert rows[0].ids == [] and all(r.round_trip for r in sentencepieces.digests(df, path).collect())
    assert sentencepieces.encode(documents([]), path).count() == 0


def test_pieces_query(spark, sf):
    rows = queries.op3_sentencepieces(spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(texts) and all(r.round_trip and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in rows)
