"""Chunks, and search over rows and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.text import let, strip


def chunks(rows: DataFrame, id_col: str, text_col: str, size: int, overlap: int, least: int) -> DataFrame:
    """id, chunk (numbered after short ones are dropped) and its text: windows of ``size`` that overlap.

    A text is trimmed once and cut once into steps, so the work grows with its length, not with the square;
    windows that overlap by more than a step would need more than two steps each and are refused.
    """
    step = size - overlap
    if not 0 <= overlap <= step:
        raise ValueError("windows may overlap by half their size at most")

    def windows(text: Column) -> Column:
        n = F.length(text)
        count = F.when(n <= size, 1).otherwise(F.ceil((n - size) / step) + 1)
        cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))

        def joined(pieces: Column) -> Column:
            rest = lambda k: F.substring(F.coalesce(F.get(pieces, k + 1), F.lit("")), 1, overlap)
            return F.transform(F.slice(pieces, F.lit(1), count.cast("int")), lambda x, k: strip(F.concat(x, rest(k))))

        whole = F.filter(let(cut, joined), lambda x: F.length(x) >= least)
        return F.when(n >= least, whole).otherwise(F.array().cast("array<string>"))

    return rows.select(id_col, F.posexplode(let(strip(F.col(text_col)), windows)).alias("chunk", "chunk_text"))


def chunk_estimate(length: Column, size: int, overlap: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.greatest(F.lit(0), length - overlap) / (size - overlap)))


def structured_search(rows: DataFrame, needle: str, columns: list[str], order: str, top_k: int, equal: dict | None = None, after: Column | None = None) -> DataFrame:
    """Rows with ``needle`` in any of ``columns``, cut to four times ``top_k`` before the late filter, then to ``top_k``."""
    found = F.lit(False)
    for c in columns:
        found = found | F.contains(F.lower(c), F.lit(needle.lower()))
    rows = rows.filter(found)
    for c, v in (equal or {}).items():
        rows = rows.filter(F.lower(F.coalesce(c, F.lit(""))) == v.lower())
    first = rows.orderBy(order).limit(min(max(4 * top_k, 1), 250))
    return (first.filter(after) if after is not None else first).orderBy(order).limit(top_k)


def haystack_search(rows: DataFrame, needle: str, title: str, authors: str, others: list[str], top_k: int) -> DataFrame:
    """Rows with ``needle`` anywhere, titles weighing 3 (others 1) and authors 2 more."""
    n = F.lit(needle.lower())
    everything = F.lower(F.concat_ws(" ", title, authors, *others))
    score = F.when(F.contains(F.lower(title), n), 3).otherwise(1) + F.when(F.contains(F.lower(authors), n), 2).otherwise(0)
    return rows.filter(F.contains(everything, n)).withColumn("score", score).orderBy(F.desc("score"), title).limit(top_k)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x)


def vector_search(rows: DataFrame, query: DataFrame, id_col: str, vector: str, paper: Column, width: int, top_k: int) -> DataFrame:
    """The best chunk of each paper among the ``width`` nearest; score = 1 - squared distance.

    ``query`` is one row, which is what is broadcast.
    """
    q = F.broadcast(query.limit(1).select(F.col(vector).cast("array<double>").alias("__q")))
    scored = rows.crossJoin(q).select(
        F.col(id_col), paper.alias("paper"), squared_distance(F.col(vector).cast("array<double>"), F.col("__q")).alias("d2")
    )
    near = scored.orderBy("d2", id_col).limit(width)
    best = Window.partitionBy("paper").orderBy("d2", id_col)
    first = near.withColumn("rn", F.row_number().over(best)).filter("rn = 1").drop("rn")
    return first.orderBy("d2", id_col).limit(top_k).withColumn("score", 1 - F.col("d2"))
