"""Queries against their SQL on rows that the supplied tables lack."""

import datetime as dt

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from vellum.plans import catalogue

AT = dt.datetime(2024, 1, 15)
EVENTS = [
    (1, AT, 1), (2, AT + dt.timedelta(milliseconds=500), 2), (3, AT + dt.timedelta(seconds=1, milliseconds=500), 2), (4, AT + dt.timedelta(microseconds=1), 3),
    (5, AT + dt.timedelta(seconds=2, milliseconds=500), 4), (6, dt.datetime(2024, 2, 1), 5), (7, dt.datetime(2024, 3, 1, 0, 0, 0, 1), 6), (8, AT - dt.timedelta(microseconds=1), 7),
]
#: A document of one word has no second one, so its journal ends with a blank.
DOCUMENTS = [(1, "Word", "en", "src1"), (2, "Two words, more of them here", "fr", "src2"), (3, "", "de", "src3"), (4, "Élement èréç les ouê", "en", "src4"), (5, "lement onward", "es", "src5")]
PAGES = [(0, "http://a.b/1", "<title>Two words, more</title>"), (1, "http://a.b/2", "<title></title>"), (2, "http://a.b/x", "<title>É</title>"), (40, "http://a.b/4", "none")]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    con = duckdb.connect()
    tables = {
        "events": {"event_id": [e for e, _, _ in EVENTS], "ts": pa.array([t for _, t, _ in EVENTS], pa.timestamp("us")), "user_id": [u for _, _, u in EVENTS]},
        "documents": dict(zip(("doc_id", "text", "lang", "source"), zip(*DOCUMENTS))) | {"n_chars": [len(d[1]) for d in DOCUMENTS]},
        "labels": {"doc_id": [1, 2, 4], "quality": [1, 1, 0], "toxic": [0, 1, 0]},
        "pages": dict(zip(("page_id", "url", "html"), zip(*PAGES))),
    }
    for name, columns in tables.items():
        pq.write_table(pa.table({k: v if isinstance(v, pa.Array) else list(v) for k, v in columns.items()}), folder / f"{name}.parquet")
        con.sql(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ["d_01", "d_04", "prj_01", "prj_01_full", "prj_02_full", "prj_04_full", "prj_05_full", "snk_07_full", "jn_09", "w_08"])
def test_odd_rows(spark, odd, name):
    folder, con = odd
    got = catalogue.queries()[name](spark, folder)
    want = con.sql(catalogue.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(str, map(tuple, got.select(*want.columns).collect()))) == sorted(map(str, want.fetchall()))


@pytest.mark.parametrize("name", ["jn_09", "w_08"])
def test_many_children(spark, tmp_path, name):
    """A parent of over a hundred children, and pages by which any of the rules hold."""
    con = duckdb.connect()
    heads = ["Two words of the same start", "Word apart from others", "Doc and words of none", "Twofold the same start of it", "Els o a oc"]
    documents = [(k, heads[k % 5] + f"\nline {k}", ["en", "fr"][k % 2], f"src{k % 8}", 40 + k % 3) for k in range(40)]
    pages = [(k, f"http://a.b/{k % 50}", f"<title>{heads[0] if k < 150 else heads[k % 5]}</title>" + "x" * (k % 4)) for k in range(260)]
    for table, columns, rows in (("documents", ("doc_id", "text", "lang", "source", "n_chars"), documents), ("pages", ("page_id", "url", "html"), pages)):
        pq.write_table(pa.table(dict(zip(columns, map(list, zip(*rows))))), tmp_path / f"{table}.parquet")
        con.sql(f"create view {table} as select * from '{tmp_path}/{table}.parquet'")
    got = catalogue.queries()[name](spark, str(tmp_path))
    want = con.sql(catalogue.oracle_sql()[name])
    rows = sorted(map(str, map(tuple, got.select(*want.columns).collect())))
    assert rows == sorted(map(str, want.fetchall()))
    assert name == "jn_09" or max(got.groupBy("parent").count().toPandas()["count"]) > 100
