"""Ladders over titles, identities and contents, case by case; the queries are held against SQL in test_queries."""

from pyspark.sql import functions as F

from vellum.functions import contents, titles

TITLES = {
    None: "empty",
    " \n ": "empty",
    "Untitled": "junk_literal",
    "Rhythm": None,
    "Tic": "too_short",
    "PII: 123 456": "pii_prefix",
    "S0301-0511(05)00012": "pii_value",
    "10.1016/j.x.2005": "doi_only",
    "doi:10.1016/j.x and more": "doi_only",
    "ISSN 0301-0511": "issn_only",
    "(c) 2005 Some press": "copyright_line",
    "Volume 12 of all": "issue_metadata",
    "Psychophysiology 42, 3": "journal_header_only",
    "Psychophysiology of sleep": None,
    "Psychophysiology: a view": None,
    "NOTES ON THE NUMBER S0301-0511(05)00012 OF ALL": "pii_caps_header",
    "Notes on unknown  PII and a long list of other matters": "unknown_pii_title",
    "Notes on a long list of other matters of all kinds pii s12": "pii_derived_title",
    "A pii of this": "pii_token_in_title",
    "A pii of this symposium": None,
    "Author (ed.) and others": "author_line_not_title",
    "The new old Journal of sleep": "journal_header_not_title",
    "Report.pdf of the year": "filename_extension_artifact",
    "Some notes 12": "trailing_numeric_fragment",
    "Some notes on the state of sleep 12": None,
    "Le chant de": "dangling_title_fragment",
    "A long and proper title of a study": None,
    "x" * 100_000: None,
}


def test_title_problem(spark):
    df = spark.createDataFrame(list(enumerate(TITLES)), "i int, t string").select("i", titles.title_problem(F.col("t")).alias("p"))
    got = {r.i: r.p for r in df.collect()}
    assert {t: got[i] for i, t in enumerate(TITLES)} == TITLES


def test_titles_of_names_and_ids(spark):
    names = ["Smith - Sleep and its phases-2005-Brain.pdf", "Smith-Sleep and its phases_20050101.pdf", "short.pdf", None, "Sleep_and_its_phases.pdf"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(titles.name_title(F.col("n")).alias("t"))
    assert [r.t for r in df.collect()] == ["Sleep and its phases", "Sleep and its phases", None, None, "Sleep and its phases"]
    ids = ["Smith_sleep_and_its_phases_b", "Smith_PII", "Smith_sleep_of_all_pii", "nothing", None, "Smith_few"]
    df = spark.createDataFrame([(n,) for n in ids], "n string").select(titles.id_title(F.col("n")).alias("t"))
    assert [r.t for r in df.collect()] == ["sleep and its phases", None, None, None, None, None]


def test_surest_candidate(spark):
    rows = [("Sleep and its phases", "SLEEP AND ITS PHASES", "A study of dreams", "untitled"), ("", None, "untitled", "untitled"), ("A study of dreams", "Sleep and its phases", "Sleep and its phases", None)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string")
    best = titles.surest(titles.candidates(("one", F.col("a"), 0.5), ("two", F.col("b"), 0.7), ("three", F.col("c"), 0.7), ("four", F.col("d"), 0.9)))
    got = df.select(best.alias("x"), titles.identity_status(best, F.lit("")).alias("s")).collect()
    # of two equally sure ones the one whose title came first, whatever its case
    assert [(r.x.title, r.x.source) if r.x else None for r in got] == [("SLEEP AND ITS PHASES", "two"), None, ("Sleep and its phases", "two")]
    assert [r.s for r in got] == ["high_confidence", "insufficient_identity", "high_confidence"]


def test_contents_of_a_book(spark):
    text = "Preface\r\n\n Table of\tcontents\n1. Sleep\nDreams .... 12\ndreams .... 12\nfew\nIntroduction\nIndex\n3: never\nChapter IV: The night\nPart 2 The day\n12 Rhythms of life\n12 few"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "contents"), (5, "Index\ncontents a\nIndex\n1. x")], "i int, t string")
    r = {x.i: x for x in df.select("i", contents.lines(F.col("t")).alias("l")).select("i", contents.table_of_contents(F.col("l")).alias("t"), contents.chapters(F.col("l")).alias("h")).collect()}
    assert (r[1].t.found, r[1].t.line, r[1].t.entries) == (True, 1, ["1. sleep", "dreams .... 12", "introduction"])
    assert [(h.line, h.heading) for h in r[1].h] == [(9, "Chapter IV: The night"), (10, "Part 2 The day"), (11, "12 Rhythms of life")]
    assert all((r[i].t.found, r[i].t.line, r[i].t.entries, r[i].h) == (False, None, [], []) for i in (2, 3))
    assert [(r[i].t.line, r[i].t.entries) for i in (4, 5)] == [(0, []), (1, [])]


def test_title_page(spark):
    page = "Sl eep and\nits pha ses\nEdited by many, ISBN 1, 1999\n" + "more\n" * 10
    rows = [("Sleep and its phases", "1999", "10.1/x"), ("phases of Sleep", "", None), ("Sleep of giants", "1999", None), (None, None, None), ("Edited by many", None, None)]
    df = spark.createDataFrame(rows, "title string, year string, doi string")
    s = contents.title_page(contents.lines(F.lit(page)), F.col("title"), F.col("year"), F.col("doi"), F.lit(False))
    got = [(r.s.score, r.s.how, r.s.blocker) for r in df.select(s.alias("s")).collect()]
    assert got == [(12 + 8 + 4 + 4 + 2, "compact", None), (24, "fragments", None), (16, None, "title_not_confirmed"), (12, None, "missing_title"), (24, "line", None)]


def test_what_a_ladder_names_often_is_made_once(spark):
    """Title pages and choices among titles hold each dear step once, however often rules name it."""
    df = spark.createDataFrame([("Sleep", "x", "y")], "t string, a string, b string")
    plan = lambda made: df.select(made.alias("s"))._jdf.queryExecution().analyzed().toString()
    page = plan(contents.title_page(contents.lines(F.col("a")), F.col("t"), F.col("b"), F.col("b"), F.lit(False)))
    assert page.count("array_join(") == 2 and page.count("t#") == plan(F.col("t")).count("t#")
    found = titles.candidates(("one", F.col("a"), 0.5), ("two", titles.name_title(F.col("b")), 0.7))
    assert plan(titles.surest(found)).count("a#") == plan(F.col("a")).count("a#")
