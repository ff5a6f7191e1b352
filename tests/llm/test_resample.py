"""Importance resampling against a plain loop."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

from vellum.llm import resample


def features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return w, [zlib.crc32(f.encode()) % 10000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]


def brute(rows, target):
    of = [features(t) for _, t in rows]
    s, t = Counter(), Counter()
    for _, f in of:
        s.update(f)
    for x in target:
        t.update(features(x)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    out, fit = [], []
    for (d, _), (w, f) in zip(rows, of):
        gain = [math.floor(1000 * math.log((t[b] + 1) * (n_s + 10000) / ((s[b] + 1) * (n_t + 10000)))) for b in f]
        weight = sum(gain) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{d}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([d, len(f), weight, score, None])
        if len(w) >= 20:
            fit.append(out[-1])
    for rank, row in enumerate(sorted(fit, key=lambda r: (-r[3], r[0]))[: len(fit) * 25 // 100], 1):
        row[4] = rank
    return sorted(map(tuple, out), key=str)


def rows_of(n):
    rng = random.Random(11)
    words = [f"{a}{b}" for a in ("ka", "lo", "Été", "x1", "Mü", "日本") for b in ("", "n", "ri", "-z", "'s")]
    return [(k * 7 % 5003, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 60)))) for k in range(n)]


def test_against_loop(spark):
    rows = rows_of(500) + [(6000, None), (6001, ""), (6002, "!!"), (6003, "kan " * 3000)]
    target = ["lo lo-z kan", "x1ri x1ri Ka", None]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = resample.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"))
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows, target)


def test_ties_and_repeated_rows_have_places_of_their_own(spark):
    rows = [(1, "a b " * 20)] * 9 + [(2, "c " * 30)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = resample.resample(docs, docs.filter("doc_id = 2").select("text"))
    assert sorted(r["rank"] for r in got.collect() if r["rank"]) == [1, 2, 3]
    assert got.count() == 12


def test_edges(spark):
    schema = "doc_id long, text string, rank int, score string, row int, weight int, n_words int"
    target = spark.createDataFrame([], "text string")
    assert resample.resample(spark.createDataFrame([], schema), target).count() == 0
    docs = spark.createDataFrame([(None, "w " * 40, 1, "x", 2, 3, 4)] * 4, schema)
    got = resample.resample(docs, target).collect()
    assert sorted(r["rank"] or 0 for r in got) == [0, 0, 0, 1] and {r["n_features"] for r in got} == {79}
