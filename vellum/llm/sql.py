"""SQL twins (DuckDB) of the queries that SQL can express."""

from __future__ import annotations

from vellum.llm import licenses, quality

_STOPS = ", ".join(f"'{w}'" for w in sorted({w for ws in quality.STOP_WORDS.values() for w in ws.split()}))

OP1 = rf"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM split)),
twice AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n
  FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
measured AS (
  SELECT s.doc_id, len(w)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>!]', '', 'g')))::BIGINT AS n_marks,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(w, lambda x: lower(x) IN ({_STOPS}))) AS n_stop,
         len(list_filter(w, lambda x: length(x) > 2 AND x = upper(x) AND x <> lower(x))) AS n_capital
  FROM split s LEFT JOIN covered c ON s.doc_id = c.doc_id),
based AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         greatest(n_words, 1) AS nw, greatest(n_lines, 1) AS nl
  FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars / nw BETWEEN 2 AND 14 AND n_marks / nw <= 0.2 AND n_stop / nw >= 0.05
       AND n_dup_lines / nl <= 0.5 AND n_repeat_words / nw <= 0.5 AND n_capital / nw <= 0.6 AS kept
FROM based
"""

OP3 = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (
  SELECT *, octet_length(b)::BIGINT AS payload_bytes, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN first_id END AS refers_to
FROM f
"""



def _canonical(text: str) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    out = f"translate(coalesce({text}, ''), '{licenses.UPPER}', '{licenses.LOWER}')"
    for old, new in licenses.SPELLINGS:
        out = f"replace({out}, {quoted(old)}, {quoted(new)})"
    out = f"regexp_replace({out}, {quoted(licenses.COPYRIGHT_LINE)}, chr(10), 'g')"
    out = f"regexp_replace({out}, {quoted(licenses.CLAUSE)}, ' \\2', 'g')"
    return f"regexp_replace(trim(regexp_replace({out}, {quoted(licenses.NO_TEXT)}, ' ', 'g')), {quoted(licenses.HEADING)}, '\\1 ')"


_KNOWN = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in sorted(licenses.LICENCES.items()))
OP5 = f"""
WITH known AS (
  SELECT sha256(form) AS s, min(license_id) AS license_id
  FROM (SELECT license_id, {_canonical("t")} AS form FROM (VALUES {_KNOWN}) v(license_id, t)) WHERE form <> '' GROUP BY 1),
docs AS (SELECT doc_id, sha256({_canonical("text")}) AS canonical_sha256 FROM documents)
SELECT doc_id, canonical_sha256, license_id FROM docs LEFT JOIN known ON canonical_sha256 = s
"""

ORACLE = {
    "op5_license_scan": OP5,
    "op3_warc_round_trip": OP3,
    "op1_quality_rules": OP1,
}
