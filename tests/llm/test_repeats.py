"""Removal of repeated passages against brute force."""

import hashlib
import random
import zlib

import pytest
import xxhash

from vellum.llm import repeats


def brute(rows, least=100):
    seen, out = {}, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for i in range(len(raw) - least + 1):
            w = raw[i : i + least]
            if seen.setdefault(w, (doc, i)) != (doc, i):
                for k in range(i, i + least):
                    gone[k] = True
        spans = sum(1 for k in range(len(raw)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((doc, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9)))
    passages = [" ".join(word() for _ in range(n)) for n in (18, 25, 40, 120)]
    phrase = " ".join(word() for _ in range(14))[:80]
    rows = []
    for k in range(60):
        parts = [" ".join(word() for _ in range(rng.randrange(3, 60)))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice([*passages, phrase]), " ".join(word() for _ in range(rng.randrange(0, 20)))]
        rows.append((k * 3, " ".join(parts)))
    for k in range(12):
        text = rng.choice(rows)[1]
        at = rng.randrange(len(text))
        rows.append((1000 + k, text[:at] + rng.choice(["", "x", " changed "]) + text[at + 1 :]))
    rows += [(2000, rows[4][1]), (2001, rows[4][1]), (2002, "ab" * 900), (2003, "c" * 5000), (2004, "z" + "ab" * 300 + "q"), (2005, None), (2006, ""), (2007, "x" * 99)]
    rows += [(2008, "abc" * 400), (2009, passages[3] + passages[3]), (2010, "no" + passages[3][5:] + passages[3][:110])]
    return rows


@pytest.mark.parametrize("seed, most_runs", [(1, 8192), (2, 8192), (3, 3)])
def test_removed(spark, monkeypatch, seed, most_runs):
    monkeypatch.setattr(repeats, "MOST_RUNS", most_runs)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS place", "2 AS anchor").repartition(5)
    assert sorted(map(tuple, repeats.removed(docs).collect())) == sorted(brute(rows))


def test_hot_anchors_are_only_dealt_out(spark, monkeypatch):
    rows = corpus(4)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    named = repeats._named(docs, "doc_id", "text")
    every = [r.anchor for r in repeats.run_rows(named, []).filter("kind = 'first'").select("anchor").distinct().limit(400).collect()]
    monkeypatch.setattr(repeats, "hot_anchors", lambda named: every)
    assert sorted(map(tuple, repeats.removed(docs).collect())) == sorted(brute(rows))


def test_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", 150)
    monkeypatch.setattr(repeats, "SORTED_AT_ONCE", 1000)
    rows = corpus(5)
    for k, t in rows:
        covered = [int(s) for _, _, at, n in repeats.runs(__import__("numpy").frombuffer((t or "").encode(), "uint8")) for a, m in zip(at, n) for s in range(a, a + m)]
        assert covered == list(range(max(0, len((t or "").encode()) - 99)))


def test_maximal_repeats_have_all_occurrences():
    a = bytes(range(65, 91)) * 6
    parts = [b"1" + a[:130], b"2" + a[:130] + b"x", b"3" + a[:110] + b"y"]
    array = repeats.SuffixArray(parts)
    found = {(n, tuple(sorted(int(s - array.begins[array.owner[s]]) * 1000 + int(array.owner[s]) for s in at))) for n, lo, hi in array.maximal_repeats() for at in [array.order[lo:hi]]}
    assert (130, (1000, 1001)) in found
    assert any(n == 110 and len(at) >= 3 and {1000, 1001, 1002} <= set(at) for n, at in found)


def test_edge_tables(spark):
    assert repeats.removed(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    text = "".join(chr(97 + k % 26) + str(k) for k in range(200))
    got = repeats.removed(spark.createDataFrame([(1, text), (1, text), (None, text), (2, text)], "doc_id long, text string")).collect()
    removed = sorted((r.doc_id is not None, r.doc_id or 0, r.n_removed) for r in got)
    assert removed == [(False, 0, 0), (True, 1, len(text)), (True, 1, len(text)), (True, 2, len(text))]


@pytest.mark.parametrize("id_", [None, 5])
def test_rows_of_one_or_no_id(spark, id_):
    passage = "".join(chr(97 + k % 26) + str(k) for k in range(60))
    texts = [f"{k} own start {k * 7919} {passage} {k * k} end" for k in range(40)]
    docs = spark.createDataFrame([(id_, t) for t in texts] + [(id_, texts[3]), (id_, None)], "doc_id long, text string").repartition(4)
    hashed = xxhash.xxh64 if id_ is None else None
    order = sorted(texts, key=lambda t: hashed(t.encode(), seed=42).intdigest() & 0x7FFFFFFFFFFFFFFF if hashed else zlib.crc32(t.encode()))
    want = [r[1:] for r in brute(list(enumerate(order)))]
    want += [r for r in want if r[3] == want[order.index(texts[3])][3]] + [brute([(0, "")])[0][1:]]
    got = repeats.removed(docs).collect()
    assert {r.doc_id for r in got} == {id_}
    assert sorted(tuple(r)[1:] for r in got) == sorted(want)


def test_without_repeats(spark):
    text = "".join(chr(97 + k % 26) + str(k) for k in range(200))
    docs = spark.createDataFrame([(1, text, "a"), (2, "start " + text + " end é", "b"), (3, None, "c")], "doc_id long, text string, spans string")
    got = {r.doc_id: (r.text, r.spans) for r in repeats.without_repeats(docs).collect()}
    assert got == {1: (text, "a"), 2: ("start  end é", "b"), 3: (None, "c")}


def test_lone_runs_that_repeat_themselves(spark):
    """A text of one run whose strings repeat within it: no other run has its anchor."""
    rng = random.Random(8)
    rows = [(k, chr(97 + k) * (99 + 12 * k)) for k in range(14)] + [(20, "=" * 411), (21, "no start " + "-+" * 60), (22, "\0" * 130 + "x"), (23, "xyz\0" * 40)]
    for k in range(30, 70):
        unit = "".join(rng.choice("abcdefgh \0é") for _ in range(rng.randrange(1, 75)))
        rows.append((k, "".join(rng.choice("pqrst") for _ in range(rng.randrange(40))) + unit * (1 + rng.randrange(100, 260) // len(unit))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, repeats.removed(docs).collect())) == sorted(brute(rows))
