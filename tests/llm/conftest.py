import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

#: Texts that every operator on documents must take: null, empty, blank, one word, odd letters, long runs, and a very long one.
ODD = [None, "", "  \n\t ", "one", "Ünïcode 😀 words\x0bhere\x0c", "\x00\x01 \x7f", "same same same " * 40, "a" * 70_000, "long words here again and on " * 5_000, "a" + " " * 1_000_000 + "b" + "\n" * 100_000 + "c" * 300_000]


@pytest.fixture(scope="session")
def documents(spark):
    """Makes documents of texts (ids 0, 1 ...) with columns whose names operators might use themselves."""

    def make(texts, ids=None):
        ids = range(len(texts)) if ids is None else ids
        rows = [(i, t, "en", "src", 1, 2, "x", None) for i, t in zip(ids, texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, key int, sid int, fp string, `node` string")

    return make


@pytest.fixture(scope="session")
def odd():
    return ODD


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
