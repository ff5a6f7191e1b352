"""Packing: pieces, plan and places."""

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from vellum.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, texts, size):
    lib = Tokenizer.from_file(PATH)
    want = []
    for k, t in texts:
        ids = lib.encode(t or "", add_special_tokens=False).ids + [0]
        for n, c in enumerate(range(0, len(ids), size)):
            part = np.asarray(ids[c : c + size], dtype="<u4")
            want.append((k, n, c, len(part), zlib.crc32(part.tobytes())))
    assert sorted(tuple(r)[:5] for r in rows) == sorted(want)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= size
    return len(bins), sum(w[3] for w in want)


def test_pack(spark):
    rng = random.Random(5)
    texts = [(k, " ".join(rng.choice(["the", "of", "seventeen", "qzx"]) for _ in range(rng.randrange(60)))) for k in range(300)]
    texts += [(900, None), (901, ""), (902, "word " * 500), (3, texts[3][1]), (3, texts[3][1])]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumnRenamed("nothing", "length")
    n, total = check(packing.pack(docs, PATH, 64).collect(), texts, 64)
    assert n <= -(-total // 64) + 2


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string, length int"), PATH).count() == 0


def test_two_replace_the_smallest():
    # greedy fills 6 + 3 and leaves a gap of 1; 2 + 2 in place of 3 close it
    left = np.zeros(11, dtype=np.int64)
    left[[6, 3]] = 1
    left[2] = 2
    assert packing._filling(left, 10) == {6: 1, 2: 2}


def test_plan_places_all():
    rng = random.Random(2)
    counts = {}
    for _ in range(20000):
        k = min(2048, int(rng.lognormvariate(5.5, 1.2)) + 1)
        counts[k] = counts.get(k, 0) + 1
    p = packing.plan(counts)
    assert p.groupby("length")["n"].sum().to_dict() == counts
    total = sum(k * n for k, n in counts.items())
    assert (p["sequence"] + p["n"]).max() <= -(-total // 2048) + 1
