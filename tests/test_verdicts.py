"""Verdicts of odd shapes; the queries are held against SQL in test_queries."""

import copy
import json

from pyspark.sql import functions as F

from vellum.functions import verdicts

GOOD = {
    "schema_version": "v2_compact",
    "classification": {n: [] for n in verdicts.LISTS}
    | {"rating": " Moderate", "rating_justification": "w" * 2600, "design_type_detected": None, "era_judgment": "", "confidence": "HIGH", "key_strengths": list(range(30)), "evidence_bullets": [{"section": " a " * 40, "claim": "b", "support": "Odd"}] * 20},
    "tags": {},
    "notes_and_flags": None,
}


def changed(**parts):
    out = copy.deepcopy(GOOD)
    for k, v in parts.items():
        (out if k in out else out["classification"])[k] = v
    return json.dumps(out)


def without(name):
    out = copy.deepcopy(GOOD)
    out["classification"].pop(name)
    return json.dumps(out)


CASES = [
    (json.dumps(GOOD), None),
    (None, "not_an_object"),
    ("", "not_an_object"),
    ("null", "not_an_object"),
    ("[1]", "not_an_object"),
    ("{}", "schema_version"),
    ('{"schema_version": "v2_compact"}', "missing_top:classification,notes_and_flags,tags"),
    (changed(classification=None), "classification"),
    (without("era_judgment"), "missing_classification:era_judgment"),
    (changed(rating=None), "rating:"),
    (changed(rating="junk"), None),
    (changed(rating_justification=3), "rating_justification"),
    (changed(rating_justification=" "), "rating_justification"),
    (changed(confidence=1), "confidence"),
    (changed(key_weaknesses={}), "not_a_list:key_weaknesses"),
    (changed(key_weaknesses=None), "not_a_list:key_weaknesses"),
    (changed(evidence_bullets=None), "evidence_bullets"),
    (changed(evidence_bullets=[]), "evidence_bullets"),
    (changed(evidence_bullets=[None]), "evidence_bullet"),
    (changed(evidence_bullets=[{"section": "a"}]), "evidence_bullet"),
    (changed(tags=[]), "tags"),
]


def test_compact(spark):
    df = spark.createDataFrame([(i, j) for i, (j, _) in enumerate(CASES)], "i int, j string")
    got = df.select("i", verdicts.compact(F.try_parse_json("j")).alias("x")).select("i", "x.error", "x.verdict.rating", "x.verdict.rating_justification", F.size("x.verdict.key_strengths").alias("n"), "x.verdict.evidence_bullets").orderBy("i").collect()
    assert [r.error for r in got] == [e for _, e in CASES]
    first = got[0]
    assert (first.rating, len(first.rating_justification), first.rating_justification[-4:], first.n, len(first.evidence_bullets)) == ("adequate", 2500, "w...", 10, 12)
    assert (len(first.evidence_bullets[0].section), first.evidence_bullets[0].support) == (80, "neutral")
    assert got[10].rating == "flawed" and got[1].rating is None


def test_filled(spark):
    rows = [(0, None), (1, '{"rating": "weak", "key_strengths": ["a", 1], "key_weaknesses": "b"}'), (2, '{"classification": {"rating": null, "era_judgment": "old"}, "rating": "weak", "tags": {}}')]
    got = spark.createDataFrame(rows, "i int, j string").select(verdicts.filled(F.try_parse_json("j")).alias("f")).select("f.rating", "f.era_judgment", F.size("f.key_strengths").alias("s"), F.size("f.key_weaknesses").alias("w"), "f.tagged").collect()
    assert [tuple(r) for r in got] == [("adequate", "not_assessed", 0, 0, False), ("weak", "not_assessed", 2, 0, False), ("adequate", "old", 0, 0, True)]
