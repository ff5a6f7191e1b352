"""Windows of texts against a loop: line ends, characters beyond two bytes, blanks at the edges of a window."""

import random

import pytest

from vellum.operators import retrieval


def windows(text, size, overlap, least):
    text = (text or "").strip()
    if len(text) < least:
        return []
    step, out, at = size - overlap, [], 0
    while True:
        out.append(text[at : at + size].strip())
        if at + size >= len(text):
            return [w for w in out if len(w) >= least]
        at += step


@pytest.mark.parametrize("size, overlap, least", [(20, 5, 3), (20, 10, 1), (7, 0, 2)])
def test_chunks(spark, size, overlap, least):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab \n\tü𝒳") for _ in range(n)) for n in [*range(45), 200, 997]] + [None, " ", "a" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {}
    for r in retrieval.chunks(df, "i", "t", size, overlap, least).orderBy("i", "chunk").collect():
        got.setdefault(r.i, []).append(r.chunk_text)
    assert {i: got.get(i, []) for i in range(len(texts))} == {i: windows(t, size, overlap, least) for i, t in enumerate(texts)}


def test_wide_overlap_is_refused(spark):
    with pytest.raises(ValueError):
        retrieval.chunks(spark.createDataFrame([(1, "a")], "i int, t string"), "i", "t", 10, 6, 1)
