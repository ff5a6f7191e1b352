"""JSON of unknown shape: leaves with their paths, tag lists, and scored years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.text import let
from vellum.sources.session import ensure_checkpoint_dir


def leaves(rows: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """id, path (``a.b[0].c``), key (the last part of the path) and leaf, of every string in a JSON text.

    A level at a time: containers are exploded, leaves set aside, until no container is
    left, so rounds are as many as the deepest text has levels. Text that is no JSON, and
    null, give no rows; numbers, booleans and nulls are no leaves; rows that repeat an id
    give their leaves each.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    kind = F.schema_of_variant("v")
    level = rows.select(F.col(id_col).alias("id"), F.lit("").alias("path"), F.try_parse_json(json_col).alias("v")).filter("v IS NOT NULL")
    out = None
    while True:
        level = level.withColumn("kind", kind)
        found = level.filter("kind = 'STRING'").select("id", "path", F.variant_get("v", "$", "string").alias("leaf"))
        out = found if out is None else out.unionByName(found)
        inner = level.filter(F.col("kind").startswith("OBJECT") | F.col("kind").startswith("ARRAY"))
        level = _children(inner).checkpoint()
        if level.isEmpty():
            return out.select("id", "path", F.substring_index("path", ".", -1).alias("key"), "leaf")


def _children(level: DataFrame) -> DataFrame:
    """One level down."""
    exploded = level.lateralJoin(level.sparkSession.tvf.variant_explode(F.col("v").outer()).select("pos", "key", F.col("value").alias("child")))
    step = F.when(F.col("key").isNull(), F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).when(F.col("path") == "", F.col("key")).otherwise(F.concat("path", F.lit("."), "key"))
    return exploded.select("id", step.alias("path"), F.col("child").alias("v"))


def file_references(found: DataFrame) -> DataFrame:
    """The leaves that name a file: a telling path, and a value that looks like a file, a path or a digest."""
    low = F.lower("leaf")
    telling = F.col("path").rlike("(?i)(file|path|pdf|filename|renamed|source|supplement|sha|hash)")
    looks = F.contains(low, F.lit(".pdf")) | F.contains("leaf", F.lit("/")) | F.contains("leaf", F.lit("\\")) | F.trim(low).rlike("^[a-f0-9]{32,128}$")
    named = ~F.col("key").isin("reason", "basename", "source_pdf_reconciled_at") & ~F.contains("path", F.lit("source_pdf_reconciliation"))
    return found.filter(telling & looks & named)


def tags(value: Column) -> Column:
    """A tag list whatever its shape: a JSON list of strings and lists, JSON lists within strings, lists by commas.

    Null and blank text have no tags; text that is no JSON list is one tag.
    """
    none = F.array().cast("array<string>")
    is_list = lambda v: F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False))
    items = lambda v: F.coalesce(v.cast("array<variant>"), F.array().cast("array<variant>"))
    texts = lambda v: F.transform(items(v), lambda x: F.coalesce(x.cast("string"), F.lit("None")))
    by_comma = lambda s: F.transform(F.split(s, ","), lambda p: F.trim(F.trim(p), F.lit('"')))

    def of_text(s: Column) -> Column:
        listed = F.try_parse_json(s)
        odd = s.startswith("[") | (F.contains(s, F.lit(",")) & F.contains(s, F.lit("[")))
        return F.when(odd & is_list(listed), texts(listed)).when(odd & F.contains(s, F.lit(",")), by_comma(s)).otherwise(F.array(s))

    def of_item(x: Column) -> Column:
        kind = F.schema_of_variant(x)
        return F.when(kind == "STRING", of_text(x.cast("string"))).when(kind.startswith("ARRAY"), texts(x)).otherwise(none)

    whole = F.try_parse_json(value)
    return F.when(F.coalesce(value, F.lit("")) == "", none).when(is_list(whole), F.flatten(F.transform(items(whole), of_item))).otherwise(F.array(value))


# Words near which a year tells of a publication.
NEAR_YEARS = ("copyright", "©", "published", "springer", "guilford", "isbn", "doi")


def years(text: Column, most: int = 8, reach: int = 80, first: int = 80_000) -> Column:
    """The years of a text by score, then the later first: 3 for a year near telling words, 1 for any other.

    The text is cut at its years; of each the characters within reach on both sides are looked at.
    Each step is made once a text, and the places of the years by one running sum.
    """
    head = F.translate(F.substring(F.coalesce(text, F.lit("")), 1, first), "\x01", " ")
    pieces = lambda h: F.split(F.regexp_replace(h, r"\b(?:19|20)\d{2}\b", "\x01$0"), "\x01")

    def places(p: Column) -> Column:
        start = F.struct(F.length(F.get(p, F.lit(0))).alias("at"), F.array().cast("array<struct<year:string,at:int>>").alias("seen"))
        year = lambda a, x: F.struct(F.substring(x, 1, 4).alias("year"), a["at"].alias("at"))
        step = lambda a, x: F.struct((a["at"] + F.length(x)).alias("at"), F.array_append(a["seen"], year(a, x)).alias("seen"))
        return F.aggregate(F.slice(p, F.lit(2), F.size(p) - 1), start, step, lambda a: a["seen"])

    def near(h: Column, at: Column) -> Column:
        def told(window: Column) -> Column:
            hit = F.lit(False)
            for word in NEAR_YEARS:
                hit = hit | F.contains(window, F.lit(word))
            return F.when(hit, 3).otherwise(1)

        return let(F.lower(F.substring(h, F.greatest(at - reach, F.lit(0)) + 1, F.least(at, F.lit(reach)) + 4 + reach)), told)

    def ranked(points: Column) -> Column:
        distinct = F.array_distinct(F.transform(points, lambda s: s["year"]))
        total = lambda y: F.aggregate(F.filter(points, lambda s: s["year"] == y), F.lit(0), lambda n, s: n + s["n"])
        return F.sort_array(F.transform(distinct, lambda y: F.struct(total(y).alias("score"), y.alias("year"))), asc=False)

    points = lambda h: F.transform(let(pieces(h), places), lambda s: F.struct(s["year"].alias("year"), near(h, s["at"]).alias("n")))
    best = let(head, lambda h: let(points(h), ranked))
    return F.transform(F.slice(best, F.lit(1), F.lit(most)), lambda s: s["year"])
