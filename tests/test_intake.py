"""Duplicates of staged files among owned, staged and held ones, against loops; classes and recovery case by case."""

from pyspark.sql import functions as F

from vellum.functions import files
from vellum.operators import intake


def test_duplicates_and_owners(spark):
    owned = [("b/2", "d1"), ("a/1", "d1"), ("c/3", "d2"), ("x/9", None), ("a/0", "d1")]
    staged = [(i, "hot") for i in range(60)] + [(60, "d1"), (61, "d2"), (62, None), (63, None), (64, "alone")]
    o = intake.owners(spark.createDataFrame(owned, "path string, digest string"), spark.createDataFrame([("a/0",), ("c/3",)], "path string"), "digest", "path")
    r = {x.key: x for x in intake.duplicates(spark.createDataFrame(staged, "key int, digest string"), o, "digest").collect()}
    assert len(r) == len(staged)
    for key, digest in staged:
        left = [p for p, d in owned if d == digest and d is not None and p not in ("a/0", "c/3")]
        twins = sum(1 for k, d in staged if d == digest and d is not None and k != key)
        assert (r[key].owner, r[key].twins, r[key].duplicate) == (min(left, default=None), twins, bool(left) or twins > 0)
    empty = spark.createDataFrame([], "key int, digest string")
    assert intake.duplicates(empty, o, "digest").count() == 0


def test_pending_twin(spark):
    held = [(3, "d1", "A.pdf"), (2, "d9", "a.PDF"), (5, None, ""), (1, "d1", "z.pdf")] + [(100 + i, "d1", "hot.pdf") for i in range(50)]
    new = [(10, "d1", "q.pdf"), (11, "dx", "a.pdf"), (12, None, ""), (13, None, None), (14, "d9", "Z.pdf"), (15, None, "HOT.pdf")]
    columns = "key int, digest string, name string"
    got = intake.pending_twin(spark.createDataFrame(new, columns), spark.createDataFrame(held, columns), "key", "digest", "name")
    want = {}
    for key, digest, name in new:
        hits = [k for k, d, n in held if (digest is not None and d == digest) or (n.strip() and name is not None and n.lower() == name.lower())]
        want[key] = min(hits, default=None)
    assert {r.key: r.pending for r in got.collect()} == want and got.count() == len(new)


def test_classes_and_recovery(spark):
    base = dict(kind="pdf", name="a.pdf", size=9000, duplicate=False, child=False, state="readable", non_ratable=False, valid=True, pages=3, junk=0, useful=0, hinted=False, text=900, recoverable=False, entries=0, owner="", twins=0, title="")
    cases = [
        (dict(size=0), "TRUE_CORRUPT_UNUSABLE", None),
        (dict(duplicate=True, twins=1), "CONFIRMED_DUPLICATE", "DELETE_DUPLICATE"),
        (dict(state="corrupt"), "TRUE_CORRUPT_UNUSABLE", "DELETE_JUNK"),
        (dict(child=True), "VALID_PDF_CHILD_DOCUMENT", "CHILD_DOCUMENT_TO_PENDING_PARENT"),
        (dict(child=True, title="A study of sleep"), "VALID_PDF_CHILD_DOCUMENT", "RECOVERED_RESEARCH_PAPER_MOVE_TO_STAGING"),
        (dict(child=True, title="Supplement of a study"), "VALID_PDF_CHILD_DOCUMENT", "CHILD_DOCUMENT_TO_PENDING_PARENT"),
        (dict(non_ratable=True, title="A handbook"), "VALID_PDF_NON_RATABLE_REFERENCE", "RECOVERED_NON_RATABLE_REFERENCE_MOVE_TO_STAGING"),
        ({}, "VALID_PDF_STANDALONE_RESEARCH", None),
        (dict(pages=0, size=700, text=10), "MODEL_RECOVERY_REQUIRED", "DELETE_JUNK"),
        (dict(pages=0, size=700, valid=False), "MODEL_RECOVERY_REQUIRED", "TECHNICAL_FAILURE_UNRECOVERABLE"),
        (dict(kind="html", state="mismatch", junk=2), "HTML_OR_TEXT_JUNK", "DELETE_JUNK"),
        (dict(kind="html", state="mismatch", hinted=True), "HTML_OR_TEXT_REFERENCE", "RECOVERED_RESEARCH_PAPER_MOVE_TO_STAGING"),
        (dict(kind="zip", state="mismatch", name="a.DOCX"), "VALID_NONPDF_REFERENCE", "RECOVERED_RESEARCH_PAPER_MOVE_TO_STAGING"),
        (dict(kind="zip", state="mismatch", name="a.zip"), "MODEL_RECOVERY_REQUIRED", "CHILD_DOCUMENT_TO_PENDING_PARENT"),
        (dict(kind="unknown", state="mismatch", name="x.csv"), "VALID_NONPDF_REFERENCE", "RECOVERED_RESEARCH_PAPER_MOVE_TO_STAGING"),
        (dict(kind="unknown", state="mismatch", name="none", size=63), "TRUE_CORRUPT_UNUSABLE", "DELETE_JUNK"),
    ]
    rows = [(i, *{**base, **c}.values()) for i, (c, _, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, ["i", *base]).withColumn("owner", F.expr("nullif(owner, '')"))
    facts = {k: F.col(k) for k in base}
    from vellum.functions.identity import disposition

    df = df.withColumn("class", files.supplement_class(facts)).withColumn("r", files.recovery(facts, F.col("class"), disposition(F.col("class"))))
    assert [(r["class"], r.r.decision) for r in df.orderBy("i").collect()] == [(a, b) for _, a, b in cases]
