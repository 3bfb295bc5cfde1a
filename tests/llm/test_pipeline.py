"""The pipeline, stage by stage, against brute force."""

import brute
import corpus_pipeline

from seqloom.llm import toxicity


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "substring_dedup", "packing"]

    scores = {r.doc_id: r.score for r in toxicity.with_scores(docs, labels).collect()}
    kept = corpus_pipeline.toxicity(spark, docs, sf).cache()
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, s in scores.items() if s < 0.7}

    texts = {r.doc_id: r.text for r in kept.collect()}
    groups = brute.components({i: brute.simhash(t, 5) for i, t in texts.items()}, corpus_pipeline.NEAR_BITS, {i: brute.shingles(t, 5) for i, t in texts.items()}, corpus_pipeline.SIMILARITY)
    kept = corpus_pipeline.near_dedup(spark, kept, sf).cache()
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, top in groups.items() if i == top}

    rows = {r.doc_id: r for r in kept.collect()}
    want = brute.kept_words({i: r.text for i, r in rows.items()})
    kept = corpus_pipeline.substring_dedup(spark, kept, sf).cache()
    got = {r.doc_id: r for r in kept.collect()}
    assert kept.columns == docs.columns and set(got) == set(rows)
    for i, r in got.items():
        assert brute.words(r.text) == want[i][1] and r.lang == rows[i].lang
        assert len(want[i][0]) > len(want[i][1]) or r == rows[i]
        assert r.n_chars == (len(r.text) if len(want[i][0]) > len(want[i][1]) else rows[i].n_chars)

    packed = corpus_pipeline.packing(spark, kept, sf).collect()
    assert {r.doc_id for r in packed} == set(got)
    whole = corpus_pipeline.run(spark, sf).collect()
    # cuts depend on the order of partitions; documents and their tokens don't
    tokens = lambda pieces: {(r.doc_id, r.doc_tokens) for r in pieces}
    assert tokens(whole) == tokens(packed)
    assert sum(r.length for r in whole) == sum(r.length for r in packed)


def test_similar_documents_far_apart_in_bits_go(spark, documents):
    base = [f"w{i}" for i in range(244)]
    texts = [" ".join(base)]
    for k in range(40):  # two words changed: a similarity of 0.92 to the first
        texts.append(" ".join(f"x{k}" if i in (60 + k, 180 + k // 2) else w for i, w in enumerate(base)))
    bits = [(brute.simhash(texts[0], 5) ^ brute.simhash(t, 5)).bit_count() for t in texts]
    assert max(bits) > corpus_pipeline.NEAR_BITS
    one = bits.index(max(bits))
    kept = corpus_pipeline.near_dedup(spark, documents([texts[0], texts[one], "another text of its own"]), "")
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2]
