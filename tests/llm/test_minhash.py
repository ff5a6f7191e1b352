"""MinHash near-duplicates against all pairs of sets."""

import random

import numpy as np

from vellum.llm import minhash


def brute(rows, percent=85):
    def shingles(t):
        w = bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()).split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def top(k):
        while label[k] != k:
            k = label[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                label[top(i)] = top(j)
    least = {}
    for k, (d, _) in enumerate(rows):
        least[top(k)] = min(least.get(top(k), d), d)
    return sorted((d, len(sets[k]), least[top(k)], d == least[top(k)]) for k, (d, _) in enumerate(rows))


def corpus():
    rng = random.Random(3)
    words = [f"w{k}" for k in range(4000)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    rows, hot = [], text(400)

    def add(w):
        rows.append((len(rows) * 3 % 1009, " ".join(w)))

    def changed(w, n):
        w = list(w)
        for _ in range(n):
            w[rng.randrange(len(w))] = rng.choice(words)
        return w

    for _ in range(60):  # one hot group of near copies
        add(changed(hot, rng.randrange(7)))
    for _ in range(40):  # a template: pairs around and below the bound
        add(changed(hot, rng.randrange(8, 30)))
    for _ in range(30):
        base = text(rng.randrange(5, 300))
        for _ in range(rng.randrange(1, 4)):
            add(changed(base, rng.randrange(0, 1 + len(base) // 60)))
    for k in range(12):  # a chain, each like the next only
        add(hot[2 * k : 2 * k + 200] + [f"end{k // 6}"])
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "a b"), (2004, "A  B"), (2005, "a b c d e"), (2006, "A b c d\te"), (2003, "a b")]
    rows.append((2007, " ".join(hot).upper()))
    return rows


def test_components_are_those_of_all_pairs(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(map(tuple, minhash.near_duplicates(docs).collect()))
    assert got == brute(rows)


def test_lists_over_several_components_are_searched_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, minhash.near_duplicates(docs).collect())) == brute(rows)


def test_edges(spark):
    schema = "doc_id long, text string, component_id int, id string, term long, size int, kept string, u int, v int"
    none = spark.createDataFrame([], schema)
    assert minhash.near_duplicates(none).columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert minhash.near_duplicates(none).count() == 0
    long = "lorem ipsum dolor sit amet " * 60_000
    rows = [(None, "one two three four five"), (5, "one two three four five"), (None, "six"), (None, None), (9, long), (8, long + "end")]
    docs = spark.createDataFrame([(*r, *[None] * 7) for r in rows], schema)
    got = sorted(map(tuple, minhash.near_duplicates(docs).collect()), key=str)
    # 9 has 5 shingles, 8 has 6 of which 5 are common: 83 of 100
    assert got == sorted([(None, 1, 5, False), (5, 1, 5, True), (None, 1, None, True), (None, 0, None, True), (9, 5, 9, True), (8, 6, 8, True)], key=str)


def test_signatures_agree_as_often_as_sets_overlap():
    rng = np.random.default_rng(5)
    shared = rng.integers(0, 2**64, 850, np.uint64)
    agree = []
    for _ in range(200):
        a, b = (np.concatenate([shared, rng.integers(0, 2**64, 75, np.uint64)]) for _ in range(2))
        x, y = minhash.signatures([a, b])
        agree.append((x == y).sum())
    assert abs(np.mean(agree) / minhash.COORDINATES - 0.85) < 0.03
    assert min(agree) >= minhash.MATCHES
