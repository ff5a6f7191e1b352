"""Encoding and decoding against the library itself."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from vellum.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LIB = Tokenizer.from_file(PATH)


def want(text):
    ids = LIB.encode(text or "", add_special_tokens=False).ids
    raw = np.asarray(ids, dtype="<u4").tobytes()
    return len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(LIB.decode(ids, skip_special_tokens=False).encode()).hexdigest()


CASES = [
    None, "", "   \n", "Hello, WORLD! don't", "naïve café é  x y", "<|endoftext|> a<|startoftext|>b",
    "a" * 5000, "ab" * 6000 + " tail", "x" * 4097 + "1" * 4100 + "é" * 3000, "日本語" * 2000 + "!?" * 1500,
    "\x1c\x1fa\x85b", "İstanbul ΑΣ ß", "she'll've " * 50, "Ab" * 3000 + "<|endoftext|>", "lo" * 2100 + "'s" * 900,
]


def test_against_library(spark):
    rows = [(k, t) for k, t in enumerate(CASES)] + [(0, None), (6, CASES[6])]
    got = bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()
    assert sorted(map(tuple, got)) == sorted((k, *want(t)) for k, t in rows)


def test_empty_table(spark):
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string, n_tokens int"), PATH).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcdeéthings'1!", min_size=1, max_size=300), st.integers(3, 40))
def test_tree_is_exact(text, leaf):
    tool = bpe.word_bpe(PATH)
    before, bpe.LEAF = bpe.LEAF, leaf
    try:
        assert np.frombuffer(tool.tree(text.encode()), "<u4").tolist() == LIB.encode(text, add_special_tokens=False).ids
    finally:
        bpe.LEAF = before


@pytest.mark.parametrize("text", ["the quick brown fox", "o" * 4500 + "x"])
def test_round_trip(text):
    tool = bpe.word_bpe(PATH)
    ids = next(tool.ids_of_batch([text]))
    assert tool.decode(ids).decode().replace("</w> ", " ").removesuffix("</w>").replace("</w>", " ").replace(" ", "") == text.replace(" ", "")


def test_repeated_long_rows_in_several_tasks(spark):
    rows = [(1, "x7q" * 2000)] * 4 + [(2, "x7q" * 2000), (None, "x7q" * 2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert sorted(map(tuple, bpe.encode(docs, PATH).collect()), key=str) == sorted(((k, *want(t)) for k, t in rows), key=str)
