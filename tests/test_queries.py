"""Every query that has SQL, against DuckDB on the smallest tables; and the ones that have none."""

import difflib
import os
import random
import re

import duckdb
import pytest

from pyspark.sql import functions as F

from vellum.functions import gates, identity, text
from vellum.operators import dedup, linkage, retrieval, store
from vellum.plans import catalogue, flagship
from vellum.sources.session import ensure_checkpoint_dir

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return f"{x:.6g}"
    if isinstance(x, list | tuple):
        return str([plain(y) for y in x])
    return str(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(plain(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    want = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_entry(spark):
    assert flagship.coverage_report(spark, SF).count() > 0


def test_seq_ratio(spark):
    pairs = [("abcd", "bcde"), ("", ""), (None, "x"), ("Rhythm perception", "Rhythm and perception")]
    got = spark.createDataFrame(pairs, "a string, b string").select(linkage.seq_ratio("a", "b").alias("r")).collect()
    assert [r.r for r in got] == [difflib.SequenceMatcher(None, a or "", b or "").ratio() for a, b in pairs]


def test_strict_insert_and_guard(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    with pytest.raises(ValueError):
        store.upsert(old, spark.createDataFrame([(2, "c")], "id long, v string"), "id", replace=False)
    new = spark.createDataFrame([(1, "a"), (2, "c")], "id long, v string")
    target = spark.createDataFrame([(2,)], "id long")
    assert store.guarded(old, new, target, "id") is new
    with pytest.raises(ValueError):
        store.guarded(old, new, spark.createDataFrame([(1,)], "id long"), "id")
    assert store.delete(old, old.limit(0), "id")[1].count() == 0 and store.delete(old, None, "id")[1].count() == 2
    assert [r.errors for r in store.valid(spark.createDataFrame([(None, " ")], "id string, t string"), "id", "t").collect()] == [["missing_id", "missing_title"]]


def test_groups_of_a_chain(spark):
    ensure_checkpoint_dir(spark)
    pairs = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(90, 91)], "a long, b long")
    assert {r.node: r.label for r in dedup.connected(pairs, "a", "b").collect()} == {i: 0 for i in range(41)} | {90: 90, 91: 90}


@pytest.mark.parametrize("n, size, overlap, least, want", [(79, 1400, 180, 80, 0), (80, 1400, 180, 80, 1), (1400, 1400, 180, 80, 1), (1401, 1400, 180, 80, 2), (2620, 1400, 180, 80, 2), (2621, 1400, 180, 80, 3), (12000, 1400, 180, 80, 10), (119, 1600, 200, 120, 0), (1601, 1600, 200, 120, 2), (5000, 1600, 200, 120, 4)])
def test_chunk_counts(spark, n, size, overlap, least, want):
    docs = spark.createDataFrame([(1, "x" * n)], "id long, t string")
    assert retrieval.chunks(docs, "id", "t", size, overlap, least).count() == want


def test_contained_short_items(spark):
    items = spark.createDataFrame([(1, "one two"), (2, "a b c d e f g h"), (3, "zz")], "i long, it string")
    docs = spark.createDataFrame([(7, "see one two and a b c d e f g h."), (8, "a b c d e f g")], "d long, dt string")
    assert {(r.i, r.d) for r in linkage.contained(items, docs, "i", "it", "d", "dt").collect()} == {(1, 7), (2, 7)}


def test_path_rules(spark):
    names = ["plain_name", "CON", "x" * 120, "a:b", " lead", "run_20240101123", "long/" * 60]
    got = {r.name: r.p for r in spark.createDataFrame([(n,) for n in names], "name string").select("name", gates.path_problems(F.col("name"), F.col("name"), text.file_name(F.col("name"))).alias("p")).collect()}
    assert got["plain_name"] == [] and "windows_reserved_name" in got["CON"] and got["x" * 120] == ["stem_too_long"]
    assert got["a:b"] == ["illegal_or_non_normalized_chars"] and "trailing_space_or_dot" in got[" lead"]
    assert "timestamp_suffix_chain" in got["run_20240101123"] and "full_path_too_long" in got["long/" * 60]


def test_neighbours_of_ranges(spark):
    ensure_checkpoint_dir(spark)
    words = [("a" * (k % 7) + str(k % 3), k) for k in range(300)]
    got = linkage.following(spark.createDataFrame(words, "w string, k long").repartition(6), ["w", "k"]).collect()
    order = sorted(words)
    assert {(r.w, r.k): r.next and tuple(r.next) for r in got} == dict(zip(order, [*order[1:], None]))
    assert linkage.following(spark.createDataFrame([], "w string, k long"), ["w", "k"]).count() == 0


def test_shared_tokens_take_the_first_partner(spark):
    rows = [(1, "red green blue"), (2, "green red"), (3, "red"), (4, "blue green"), (5, None), (6, "red blue"), (7, "red green blue black")]
    df = spark.createDataFrame(rows, "i long, t string")
    got = {r.l_id: (r.r_id, r.shared) for r in linkage.shared_tokens(df, df, "i", "i", "t", "t").collect()}
    assert got == {1: (2, 2), 2: (1, 2), 4: (1, 2), 6: (1, 2), 7: (1, 3)}


def _same(a, b):
    """The verdict on two records, step by step."""
    ratio = lambda x, y: difflib.SequenceMatcher(None, x, y).ratio() if x and y else 0.0
    cut = lambda t: len(t) < 40 or not (t.strip()[-1].isalnum() or t.strip()[-1] in ".?!") or bool(re.search(identity.CUT_TITLE, t.strip()))
    if a["doi"] and a["doi"] == b["doi"]:
        return True
    t, x = ratio(a["key"], b["key"]), ratio(a["abstract"], b["abstract"])
    if not cut(a["title"]) and not cut(b["title"]) and t < 0.95:
        return False
    sizes = len(a["abstract"]), len(b["abstract"])
    if min(sizes) >= 100:
        if x < (0.92 if cut(a["title"]) and cut(b["title"]) else 0.85):
            return False
        if x >= 0.92 and min(sizes) >= 200:
            return True
    if a["key"] and a["key"] == b["key"] or t >= 0.92:
        return True
    if a["file"] and a["file"] == b["file"] and (t >= 0.5 or not a["key"] or not b["key"]):
        return True
    n = len(os.path.commonprefix([a["id"], b["id"]]))
    return n >= 50 and len(a["id"]) - n <= 4 and len(b["id"]) - n <= 4 and bool(a["key"] and a["key"] == b["key"] or a["file"] and a["file"] == b["file"])


def test_likely_duplicates(spark):
    long_id, words = "x" * 52, "the timing of rhythm in the human brain and its response to music"
    records = [
        dict(id=i, doi=d, title=t, key=t.lower().strip(), abstract=a, file=f)
        for i, d, t, a, f in [
            ("a1", "10.1/a", words, "", ""), ("a2", "10.1/a", "other", "", ""), (long_id + "_1", "", words, "y" * 250, "f"), (long_id + "_2", "", words + " or", "y" * 248 + "zz", "f"),
            ("b1", "", words[:50], "p q " * 60, "g"), ("b2", "", words + " x", "r s t " * 60, "g"), ("c", "", "", "", "f"), ("d", "", "short", "", "h"), ("e", "", "short", "k" * 150, "h"),
        ]
    ]
    kind = "struct<id:string,doi:string,title:string,key:string,abstract:string,file:string>"
    pairs = [(x, y) for x in records for y in records]
    df = spark.createDataFrame(pairs, f"a {kind}, b {kind}").withColumns(
        {"t": linkage.seq_ratio("a.key", "b.key"), "x": linkage.seq_ratio("a.abstract", "b.abstract")}
    )
    known = lambda f, r: F.when((F.col(f"a.{f}") != "") & (F.col(f"b.{f}") != ""), F.col(r)).otherwise(0.0)
    same = identity.likely_duplicates(F.col("a"), F.col("b"), known("key", "t"), known("abstract", "x"), text.common_prefix(F.col("a.id"), F.col("b.id")))
    got = {(r.p, r.q): r.s for r in df.select(F.col("a.id").alias("p"), F.col("b.id").alias("q"), same.alias("s")).collect()}
    assert got == {(x["id"], y["id"]): _same(x, y) for x, y in pairs} and set(got.values()) == {True, False}


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
def test_neighbouring_duplicates(spark):
    found = catalogue.queries()["c_24"](spark, SF).collect()
    assert len(found) == spark.read.parquet(f"{SF}/documents.parquet").count() - 1
    assert any(r.duplicate for r in found) and not all(r.duplicate for r in found)


def test_ratios_are_compared_only_where_they_may_reach(spark, monkeypatch):
    """Pairs that letters or common subsequences keep below the bound are told without a comparison; the rest is exact."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randrange(0, 400)))
    texts = [word() for _ in range(40)]
    pairs = [(x, y) for x in texts for y in (x, x[: len(x) // 2] + word(), x[:-3] + "q", word(), "")]
    compared = []
    real = linkage.difflib.SequenceMatcher
    monkeypatch.setattr(linkage.difflib, "SequenceMatcher", lambda *a, **k: compared.append(1) or real(*a, **k))
    for x, y in pairs:
        exact = real(None, x, y, autojunk=True).ratio()
        for least in (0.5, 0.85, 0.95):
            got = linkage._reaching(x, y, least)
            assert got == exact if exact >= least else got < least
    assert 0 < len(compared) < 1.5 * len(pairs)
    df = spark.createDataFrame([("abc", "abd", 0.6), ("abc", "xyz", 0.6), ("abc", "abc", None)], "a string, b string, least double")
    assert [r.s for r in df.select(linkage.seq_ratio_from("a", "b", "least").alias("s")).collect()] == [2 / 3, 0.0, 0.0]
