import hashlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from keelson.llm import bpe, queries

PATH = public_tokenizers.path("word_bpe_49k.json")
KNOWN, THEIRS = bpe.Vocabulary(PATH), Tokenizer.from_file(PATH)
ODD = [
    "It's <|endoftext|> don't  ÀÉ ﬁ ǅ İSTANBUL ΣΑΣ é é  x\x1cy 12 3½ ''s \U0001f600",
    "a<|endoftext|><|startoftext|>b <|ENDOFTEXT|> <|endoftext|",
    "x" * 3000 + "\t\r\nabc" * 50,
    "́a ́",
    "Straße,. ÇA!? naïve; ß×÷ÿ",
    "'S 's'tQ 'LL",
    "",
    " ",
    "\n\n",
]


def ids_of(text):
    return np.frombuffer(KNOWN.encode(text), "<u4").tolist()


@pytest.mark.parametrize("text", ODD)
def test_odd_texts_as_the_library(text):
    ids = THEIRS.encode(text, add_special_tokens=False).ids
    assert ids_of(text) == ids and bpe.decode(np.array(ids, int), bpe.tokens_of(PATH)) == THEIRS.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("abcdeéÀ '.,\n19<|>"), st.characters(codec="utf-8")), max_size=60))
def test_any_text_as_the_library(text):
    assert ids_of(text) == THEIRS.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 255), min_size=1, max_size=300))
def test_scan_and_queue_agree(symbols):
    assert bpe.scan_merge(list(symbols), KNOWN.ranks, KNOWN.made) == bpe.queue_merge(list(symbols), KNOWN.ranks, KNOWN.made)
    runs = [k % 3 for k in symbols]  # overlapping equal pairs
    ranks, made = {a << bpe.WIDE | b: 3 * a + b for a in range(3) for b in range(3)}, [k + 3 for k in range(9)]
    assert bpe.scan_merge(list(runs), ranks, made) == bpe.queue_merge(list(runs), ranks, made)


def test_caches_that_start_anew(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 2000)
    small = bpe.Vocabulary(PATH)
    text = " ".join(f"word{k % 7} Other{k} naïf" for k in range(300))
    assert small.encode(text) == KNOWN.encode(text) and small.held <= 2000


def test_query_against_the_library(spark):
    got = {r["doc_id"]: r for r in queries.op13_bpe(spark, "/root/testdata/sf0.001").collect()}
    rows = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()
    assert len(got) == len(rows)
    for i, text in rows:
        ids = THEIRS.encode(text or "", add_special_tokens=False).ids
        back = THEIRS.decode(ids, skip_special_tokens=False)
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest()


def test_edges(spark):
    rows = [(1, None, 5), (2, "", 5), (3, "Same text", 5), (3, "Same text", 5), (None, "no id", 5), (6, "word " * 60_000, 5), (7, "w" * 200_000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = bpe.bpe_report(docs, PATH).collect()
    by_id = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) and by_id[1]["n_tokens"] == by_id[2]["n_tokens"] == 0 and by_id[6]["n_tokens"] == 60_000
    assert by_id[7]["n_tokens"] == len(THEIRS.encode("w" * 200_000, add_special_tokens=False).ids)
    assert bpe.bpe_report(docs.limit(0), PATH).collect() == []
    back = bpe.decode_ids(spark.createDataFrame([(1, None), (2, []), (3, [518, None, 10**6, -1])], "n long, ids array<int>"), PATH)
    assert [r["decoded"] for r in back.orderBy("n").collect()] == ["", "", "the</w>"] and back.columns == ["n", "decoded"]
    odd = docs.where("doc_id < 7")
    one, two = bpe.encode_texts(odd, PATH, decoded=True), bpe.decode_ids(bpe.encode_texts(odd, PATH), PATH)
    assert sorted(map(tuple, one.select("doc_id", "decoded").collect())) == sorted(map(tuple, two.select("doc_id", "decoded").collect()))
