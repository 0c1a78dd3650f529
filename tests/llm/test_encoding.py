"""Encoding: against the public library, and the cases of the docstring."""

import base64
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphmill.llm import encoding as E

pytestmark = pytest.mark.skipif(not os.path.exists(os.path.join(E.TOKENIZERS, E.VOCABULARY)), reason="no vocabulary files")


@pytest.fixture(scope="module")
def ours():
    return E.Encoder(os.path.join(E.TOKENIZERS, E.VOCABULARY))


@pytest.fixture(scope="module")
def theirs():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(os.path.join(E.TOKENIZERS, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


TEXTS = ["Hello world", "  two  spaces \n\n\ttabs ", "don't we'll I'M", "<|endoftext|> is text", "naïve café 123abc 12,345.67", "日本語テキスト", "🚀🇩🇪 👩‍👩‍👧", "a" * 5000, "ab" * 2000 + " " * 500, "\x00\x1c\x85\xa0\u2028\ufeff", "е́ ﬁ ½ ²"]


@pytest.mark.parametrize("text", TEXTS)
def test_equals_library(ours, theirs, text):
    assert ours.encode(text) == theirs(text)
    assert ours.count(text) == len(theirs(text))


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_random_texts(text):
    tiktoken = pytest.importorskip("tiktoken")
    path = os.path.join(E.TOKENIZERS, E.VOCABULARY)
    encoder = E.encoder(path)
    ranks = encoder.ranks
    reference = test_random_texts.__dict__.setdefault("ref", tiktoken.Encoding("t", pat_str=E.PATTERN, mergeable_ranks=ranks, special_tokens={}))
    got = encoder.encode(text)
    assert got == reference.encode_ordinary(text)
    back = {v: k for k, v in ranks.items()}
    assert b"".join(back[i] for i in got).decode() == text


def test_merge_order():
    ranks = {bytes([b]): b for b in b"abc"} | {b"ab": 300, b"bc": 200, b"abc": 400}
    assert E.merge_piece(b"abc", ranks) == [ord("a"), 200] or E.merge_piece(b"abc", ranks) == [400]
    assert E.merge_piece(b"", ranks) == [] and E.merge_piece(b"a", ranks) == [97]
    assert E.merge_piece(b"aabb", ranks) == [97, 300, 98]


def test_cache_is_bounded(tmp_path):
    lines = b"".join(base64.b64encode(bytes([i])) + f" {i}\n".encode() for i in range(256))
    (tmp_path / "v").write_bytes(lines)
    e = E.Encoder(str(tmp_path / "v"), keep=5)
    assert e.encode(" ".join(str(i) for i in range(50))) and len(e) <= 5


def test_tables(spark, theirs):
    rows = [(1, None, "x"), (2, "", "x"), (3, "a b", "x"), (3, "a b", "y"), (4, "word " * 50_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = E.encode_texts(df).collect()
    by = {(r["doc_id"], len(r["ids"])) for r in got}
    assert len(got) == 5 and (1, 0) in by and (2, 0) in by and (3, 2) in by
    assert [r["ids"] for r in got if r["doc_id"] == 4] == [theirs("word " * 50_000)]
    counts = {r["doc_id"]: r["n_tokens"] for r in E.count_tokens(df).collect()}
    assert counts[1] == 0 and counts[3] == 2
    assert E.encode_texts(df.limit(0)).count() == 0
