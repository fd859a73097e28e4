import base64
import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skyloom.llm import lexicon as L
from skyloom.llm import tokenizer as T

tiktoken = pytest.importorskip("tiktoken")
pytestmark = pytest.mark.skipif(not os.path.exists(T.VOCABULARY), reason="no vocabulary file")


@pytest.fixture(scope="module")
def reference():
    with open(T.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.binary(min_size=1, max_size=6), st.lists(st.integers(0, 50256), max_size=4), max_size=60), st.lists(st.binary(max_size=7), max_size=30))
def test_lexicon_is_exact(tmp_path_factory, words, others):
    at = tmp_path_factory.mktemp("lex") / "x.lex"
    at.write_bytes(L.to_bytes(L.build(words)))
    lex = L.Lexicon(str(at))
    asked = [*words, *others]
    for w, p in zip(asked, lex.places(asked).tolist()):
        assert (lex.of(p) if p >= 0 else None) == words.get(w)
    assert sorted(lex.places(list(words)).tolist()) == list(range(len(words)))


def test_lexicon_shares_suffixes():
    stems = [b"walk", b"talk", b"bark"]
    parts = L.build({s + e: [1] for s in stems for e in (b"", b"s", b"ed", b"ing")})
    # w and t lead to one path, whose last letters and endings those of b share
    assert len(parts["final"]) == 11


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_merge_equals_reference(reference, text):
    rank = T.ranks(T.VOCABULARY)
    assert [i for w in T.words(text) for i in T.merge(w.encode(), rank)] == reference.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 20_000, " " * 5_000, "xyzzy" * 3_000, "é" * 999, "<|endoftext|>", "I'll don't 12345\n\n  x", "🤷🏻‍♀️" * 200, "\r\n \t"])
def test_long_and_odd_texts(reference, text):
    rank = T.ranks(T.VOCABULARY)
    assert [i for w in T.words(text) for i in T.merge(w.encode(), rank)] == reference.encode_ordinary(text)


def test_corpus(spark, data, reference):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    want = {r["doc_id"]: reference.encode_ordinary(r["text"]) if r["text"] else [] for r in docs.select("doc_id", "text").collect()}
    got = {r["doc_id"]: list(r["ids"]) for r in T.encode(docs, "doc_id").collect()}
    assert got == want
    assert {r["doc_id"]: r["n_tokens"] for r in T.token_counts(docs, "doc_id").collect()} == {k: len(v) for k, v in want.items()}


def test_edge_cases(spark, reference):
    rows = [(1, "", "a"), (1, None, "b"), (None, "hello hello", "c"), (2, "x" * 10_000 + " end", "d"), (3, "<|endoftext|>", "e"), (3, "<|endoftext|>", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(((r["doc_id"], list(r["ids"])) for r in T.encode(df, "doc_id").collect()), key=repr)
    assert got == sorted(((k, reference.encode_ordinary(t) if t else []) for k, t, _ in rows), key=repr)
    for k, ids in got:
        if ids:
            assert T.decode(ids) in {t for _, t, _ in rows}
    assert T.encode(df.limit(0), "doc_id").count() == 0


def test_lexicon_of_a_corpus_is_read_by_workers(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    uri = T.build_lexicon(docs, most=50)
    lex = L.Lexicon(uri.replace("file://", ""))
    assert len(lex) == 50 and len(np.unique(lex.places([b" the", b" is"]))) == 2
    small = T.encode(docs, "doc_id", lexicon_uri=uri).collect()
    assert {r["doc_id"]: r["ids"] for r in small} == {r["doc_id"]: r["ids"] for r in T.encode(docs, "doc_id").collect()}
