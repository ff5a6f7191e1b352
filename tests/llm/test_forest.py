"""The forest against brute force."""

import numpy as np
import pyarrow as pa
import pytest

from vellum.llm import forest


def brute(rows, k):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.setdefault(i, []).append(np.array(v))
    out = {}
    for q in sorted(i for i in good if i % 100 == 0):
        a = good[q][0]
        near = []
        for i, vs in good.items():
            same = [v for v in vs if len(v) == len(a)]
            if i != q and same:
                near.append((min(float(np.sqrt(((v - a) ** 2).sum())) for v in same), i))
        out[q] = sorted(near)[:k]
    return out


def test_recall_and_ranks(spark):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((3000, 16))
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS block", "2 AS score")
    got = {}
    for r in forest.nearest(docs).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute(rows, 10)
    hits = 0
    for q, near in want.items():
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, 11))
        assert [(s, i) for _, i, s in mine] == sorted((s, i) for _, i, s in mine)
        for _, i, s in mine:
            assert abs(s - np.sqrt(((v[i] - v[q]) ** 2).sum())) < 1e-12
        hits += len({i for _, i, _ in mine} & {i for _, i in near})
    assert hits >= 0.9 * 10 * len(want)


def test_copies_ties_and_bad_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.0]) for i in range(0, 40)] + [(100, [1.0, 0.0]), (101, [0.0, 1.0]), (5, [1.0, 0.0])]
    rows += [(200, None), (300, [0.0, 0.0]), (400, [nan, 1.0]), (500, [inf, 1.0]), (600, [None, 1.0]), (700, []), (None, [1.0, 1.0])]
    rows += [(800, [1.0, 2.0, 3.0]), (801, [1.0, 2.0, 4.0])]
    got = sorted(map(tuple, forest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()))
    want = sorted((q, n + 1, i, s) for q, near in brute(rows, 10).items() for n, (s, i) in enumerate(near))
    assert got == want


def recalled(v, k=10):
    """Share of the true neighbours that one block finds, and the fewest rows of a query."""
    table = pa.table({"vec_id": pa.array(range(len(v)), pa.int64()), "vector": pa.array(v.tolist(), pa.list_(pa.float64()))})
    got = {}
    for r in forest.search_block(table, table, k).to_pylist():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in range(len(v)):
        d = np.sqrt(((v - v[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        hits += len(got[q] & set(np.argsort(d, kind="stable")[:k].tolist()))
    return hits / (k * len(v)), min(map(len, got.values()))


@pytest.mark.parametrize("n", [120, 300, 500, 900])
def test_recall_of_small_blocks(n):
    share, fewest = recalled(np.random.default_rng(n).standard_normal((n, 64)))
    assert share >= 0.9 and fewest == 10


@pytest.mark.parametrize("n", [540, 1026])
def test_recall_in_tight_groups(n):
    """Groups of nine: a query needs neighbours from beyond its group."""
    rng = np.random.default_rng(2)
    v = np.repeat(rng.standard_normal((n // 9, 64)), 9, axis=0)
    share, fewest = recalled(v + 0.01 * rng.standard_normal(v.shape))
    assert share >= 0.9 and fewest == 10


def test_empty(spark):
    assert forest.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
