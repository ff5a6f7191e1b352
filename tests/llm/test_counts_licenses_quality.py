"""Token rollups, licence scan and quality rules."""

import random
import re

import public_tokenizers
import pytest

from vellum.llm import licenses, quality, scratch, token_counts

SCHEMA = "doc_id long, text string, source string, lang string"


def totals(store):
    return sorted(map(str, (tuple(r) for r in store.totals().collect())))


def test_rollup(spark):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    tool = token_counts.encoder(path, pattern)
    store = token_counts.Rollup(spark, f"{scratch.shared_dir(spark)}/rollup")
    count = lambda rows: token_counts.counted(spark.createDataFrame(rows, SCHEMA + ", docs int"), path, pattern, "v1")
    live = {}

    def want():
        sums = {}
        for text, source, lang in live.values():
            g = sums.setdefault((source, lang, "v1"), [0, 0, 0])
            g[0] += 1
            g[1] += len(tool.encode_ordinary(text or ""))
            g[2] += len(text or "")
        return sorted(str((*k, *v)) for k, v in sums.items())

    first = [(1, "one two", "a", "en", 1), (2, None, "a", "en", 1), (3, "", None, None, 1), (4, "x" * 3000, "b", "fr", 1), (None, "n", "b", "fr", 1), (4, "x" * 3000, "b", "fr", 1)]
    assert store.commit("b1", count(first))
    live.update({r[0]: r[1:4] for r in first})
    assert totals(store) == want()
    assert not store.commit("b1", count(first)) and totals(store) == want()
    second = [(1, "one two three", "a", "de", 1), (9, "new", "c", "es", 1)]
    gone = spark.createDataFrame([(4,), (77,), (4,)], "doc_id long")
    assert store.commit("b2", count(second), gone)
    live.update({r[0]: r[1:4] for r in second})
    del live[4]
    assert totals(store) == want()
    assert not store.commit("b2", count(second), gone)
    store.commit("b3", None, spark.createDataFrame([(1,), (None,)], "doc_id long"))
    del live[1], live[None]
    assert totals(store) == want()
    store.commit("b4")
    assert totals(store) == want()


def test_license_scan(spark):
    mit = licenses.LICENCES["MIT"]
    rows = [
        (1, mit), (2, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace(" ", "\n ")), (3, mit + " more"), (4, None), (5, ""),
        (6, mit.replace("sublicense", "sub-licence").replace("License", "Licence")), (7, "(c) 1999 X\n# copyright 2001 Y"), (None, licenses.LICENCES["0BSD"]), (1, mit),
    ]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'z' AS license_id")).collect()
    assert sorted((str(r.doc_id), r.license_id or "") for r in got) == sorted(
        [("1", "MIT"), ("2", "MIT"), ("3", ""), ("4", ""), ("5", ""), ("6", "MIT"), ("7", ""), ("None", "0BSD"), ("1", "MIT")]
    )
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_usual_forms_of_licenses(spark):
    text = licenses.LICENCES
    mit, bsd = text["MIT"].removeprefix("MIT License\n\n"), text["BSD-3-Clause"]
    bullets = bsd.replace(" 1. ", "\n\n* ").replace(" 2. ", "\n\n* ").replace(" 3. ", "\n\n* ")
    cases = {
        "MIT": [mit, "The MIT License (MIT)\n\nCopyright (c) 2015 X\n\n" + mit, "MIT License\n\nCopyright Jane Doe, 2020\n\n" + mit, "# MIT License\n" + mit.replace(". ", ".\n")],
        "BSD-3-Clause": ["BSD 3-Clause License\n\nCopyright (c) 2017, X\nAll rights reserved.\n\n" + bsd, bullets, "Copyright (c) 2017, X. All rights reserved.\n" + bullets, bsd.replace(" 2. ", "\n  2) ")],
        "ISC": ["ISC License (ISC)\nCopyright 2004 X\n" + text["ISC"].removeprefix("ISC License\n\n")],
        "Zlib": ["zlib License\n\n(C) 1999 X\n" + text["Zlib"]],
        "Notice-GPL-3.0": [text["Notice-GPL-3.0"] + "\n"],
        None: ["MIT License", "All rights reserved.", mit.replace("hereby", "not"), "The MIT License (MIT) is what " + mit],
    }
    rows = [(k, t, name) for k, (name, t) in enumerate((n, t) for n, ts in cases.items() for t in ts)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, name string"))
    assert {r.doc_id: r.license_id for r in got.collect()} == {k: name for k, _, name in rows}


def test_very_long_text_has_no_license(spark):
    long = licenses.LICENCES["MIT"] + " word" * 300_000
    assert [r.license_id for r in licenses.scan(spark.createDataFrame([(1, long)], "doc_id long, text string")).collect()] == [None]


def brute_measures(text):
    t = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", t)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("seed", [1, 2])
def test_quality_measures(spark, seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "A", "é𝒳", "x|", "##", "Und", "\x1c", "\xa0"])
    texts = ["".join(word() + rng.choice([" ", "  ", "\n", "\t\r", "\x0b"]) for _ in range(rng.randrange(90))) for _ in range(60)]
    texts += [None, "", " \n ", "a", "a b", "a b c", "a b c a b c", "x x x x", "a\n\na\n a\na"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'old' AS kept", "0 AS m")
    got = quality.assessed(docs).orderBy("doc_id").collect()
    for r, t in zip(got, texts):
        n, chars, symbols, dup, repeat = brute_measures(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n)
    assert {r.doc_id for r in got if r.kept} == {r.doc_id for r in quality.keep_good(docs).collect()}


def test_quality_verdicts(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    prose = lambda n: " ".join(rng.choice(["the", "of", word(), word()]) for _ in range(n))
    texts = [prose(80), prose(200).upper(), " | ".join(word() for _ in range(100)), prose(30), "same " * 100, (prose(12) + "\n") * 20]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.kept for r in quality.assessed(docs).orderBy("doc_id").collect()] == [True, False, False, False, False, False]


def test_registered_counts_after_all_batches(spark, tmp_path):
    """The registered query's totals after its deletions and revisions, some of which stay in force."""
    import public_tokenizers
    import tiktoken  # noqa: F401

    from vellum.llm import q_text, token_counts

    rows = [(k, f"text number {k} " * (k % 4), ["en", "de", None][k % 3], f"s{k % 2}") for k in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    labels = {k: (k // 3 % 2, int(k % 5 == 0)) for k in range(0, 40, 3)}
    spark.createDataFrame([(k, *v) for k, v in labels.items()], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    tool = token_counts.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    want = {}
    for k, text, lang, source in rows:
        quality, toxic = labels.get(k, (1, 0))
        if toxic:
            continue
        lang = lang if quality else None
        n = want.setdefault((source, lang), [0, 0, 0])
        for at, more in enumerate((1, len(tool.encode_ordinary(text)), len(text))):
            n[at] += more
    got = {(r.source, r.lang): [r.n_docs, r.n_tokens, r.n_chars] for r in q_text.op4_token_counts(spark, str(tmp_path)).collect()}
    assert got == want
