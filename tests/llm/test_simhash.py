"""SimHash links and groups against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from vellum.llm import bpe, components, scratch, simhash


def brute_print(text, words=3):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall("[^\x20\x09-\x0d]+", lowered)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(ids, link):
    parent = {i: i for i in ids}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and link(a, b):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {i: top(i) for i in ids}


def test_near_duplicates(spark):
    rng = random.Random(3)
    vocab = ["Ab", "the", "é", "x1", "of", "ZZ", "qu"]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(0, 30))) for _ in range(60)]
    texts = [(k, t) for k, t in enumerate(base)]
    for k in range(60, 160):
        w = rng.choice(base).split()
        if w:
            w[rng.randrange(len(w))] = rng.choice(vocab)
        texts.append((k, " \t".join(w)))
    texts += [(200, None), (201, ""), (202, "\n"), (203, "One"), (204, "one"), (5, base[5])]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = simhash.near_duplicates(docs.selectExpr("*", "1 AS fp", "2 AS root")).collect()
    prints = {k: brute_print(t) for k, t in texts}
    want = brute_groups(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    assert sorted(map(tuple, got)) == sorted((k, f"{prints[k]:016x}", want[k]) for k, _ in texts)


def test_dense_lists(spark):
    """Thousands of fingerprints within a few bits of each other make one long list."""
    rng = np.random.default_rng(1)
    base = np.int64(0x1234567890ABCDEF)
    flips = {int(base)}
    while len(flips) < 400:
        a = list(flips)[int(rng.integers(len(flips)))]
        for b in rng.integers(0, 16, int(rng.integers(1, 5))):
            a ^= 1 << int(b)
        flips.add(a)
    ids = sorted(flips)
    link = simhash.links(spark.createDataFrame([(i,) for i in ids], "fp long"), 2)
    root = {r.node: r.root for r in components.roots(link).collect()}
    want = brute_groups(ids, lambda a, b: (a ^ b).bit_count() <= 2)
    assert {i: root.get(i, i) for i in ids} == want


def test_components_of_a_chain(spark):
    n = 300
    link = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (5, 5)], "u long, v long")
    got = {r.node: r.root for r in components.roots(link).collect()}
    assert got == {i: 0 for i in range(1, n + 1)} | {1001: 1000}


@pytest.mark.parametrize("edits, together", [(1, True), (40, False)])
def test_similar_groups(spark, edits, together):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    a = [word() for _ in range(150)]
    b = list(a)
    for k in rng.sample(range(150), edits):
        b[k] = word()
    others = [(10 + k, " ".join(word() for _ in range(120))) for k in range(20)]
    docs = spark.createDataFrame([(3, " ".join(a)), (4, " ".join(b)), (5, " ".join(a)), *others, (50, None), (51, "")], "doc_id long, text string")
    kept = {r.doc_id for r in simhash.one_of_each(docs).collect()}
    assert (4 not in kept) == together
    assert 3 in kept and 5 not in kept and {k for k, _ in others} <= kept and 50 in kept and 51 not in kept


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, component_id int")
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.one_of_each(docs).count() == 0


def test_one_row_of_each_group(spark):
    """Also where rows have no id, or repeat one."""
    rng = random.Random(4)
    a, b, c, d, e = (" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60)) for _ in range(5))
    near = " ".join(b.split()[1:])
    rows = [(None, a), (None, a), (5, a), (6, a), (None, b), (None, near), (None, b), (7, c), (7, c), (8, a), (8, d), (9, e), (None, None), (None, ""), (12, c)]
    docs = spark.createDataFrame([(k, t, n) for n, (k, t) in enumerate(rows)], "doc_id long, text string, n int")
    got = [(r.doc_id, r.text or "") for r in simhash.one_of_each(docs).collect()]
    ided = sorted((k, t) for k, t in got if k is not None)
    assert ided == sorted([(5, a), (7, c), (8, d), (9, e)])
    assert len(got) == 6 and {t for k, t in got if k is None} in ({b, ""}, {near, ""})


def templated(families, own, pairs, words=150, seed=5):
    """``families`` texts of one template with ``own`` words of their own, and ``pairs`` planted ones, each with a second text that has two words changed."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    template = [word() for _ in range(words - own)]
    texts = [template + [word() for _ in range(own)] for _ in range(families + pairs)]
    for a in texts[families : families + pairs]:
        b = list(a)
        b[-1] = b[-own] = word()
        texts.append(b)
    return [(k, " ".join(t)) for k, t in enumerate(texts)]


def test_pairs_among_a_template(spark):
    """Pairs of similarity above 0.8 are all found among thousands of texts that share a template (0.6 alike)."""
    n, pairs = 2000, 100
    docs = spark.createDataFrame(templated(n, 36, pairs), "doc_id long, text string")
    group = {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()}
    assert group == {k: k for k in range(n + pairs)} | {n + pairs + k: n + k for k in range(pairs)}


@pytest.mark.parametrize("own", [19, 12])
def test_groups_against_brute_force(spark, own):
    """One family whose pairs lie below the bound, or on both sides of it."""
    rng = random.Random(own)
    docs = templated(300, own, 0)
    docs = [(k, t if own == 19 else " ".join(t.split()[rng.randrange(20) :])) for k, t in docs]
    sets = {k: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for k, t in docs}
    want = brute_groups(sorted(sets), lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    got = simhash.similar_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert own != 19 or len(set(want.values())) == 300


def test_a_family_of_near_copies_is_not_tried_in_all_pairs(spark, monkeypatch):
    """Edits leave a part of all pairs similar: so many are tried as joins the family, and its components are those of all pairs."""
    rng, n = random.Random(4), 400
    base = [f"w{k}" for k in range(300)]
    texts = []
    for k in range(n):
        own = list(base)
        for at in rng.sample(range(300), rng.randrange(1, 7)):
            own[at] = f"x{k}y{at}"
        texts.append(" ".join(own))
    tried, verified = [], simhash.verified

    def counted(pairs, *rest):
        tried.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(simhash, "verified", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()}
    sets = [set(zip(*(t.split()[i:] for i in range(5)))) for t in texts]
    root = list(range(n))
    similar = 0
    for a in range(n):
        for b in range(a + 1, n):
            both = len(sets[a] & sets[b])
            if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                similar += 1
                x, y = sorted((root[a], root[b]))
                root = [x if r == y else r for r in root]
    assert got == dict(enumerate(root))
    assert similar > 50 * n and sum(tried) < similar


def test_sets_are_made_of_few_texts_at_a_time(spark, monkeypatch):
    """Batches are cut into small parts, and what other operators keep in a worker is given back first."""
    cleared = []
    monkeypatch.setattr(scratch, "HELD", [lambda: cleared.append(1)])
    batch = pa.RecordBatch.from_pydict({"text": [f"t{k}" for k in range(2 * simhash.TEXTS_AT_ONCE + 1)]})
    parts = list(simhash._few(iter([batch])))
    assert [p.num_rows for p in parts] == [simhash.TEXTS_AT_ONCE, simhash.TEXTS_AT_ONCE, 1] and cleared == [1]
    assert pa.Table.from_batches(parts).to_pylist() == batch.to_pylist()
    assert bpe.HELD == [bpe.word_bpe.cache_clear]
