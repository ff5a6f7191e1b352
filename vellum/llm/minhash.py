"""MinHash near-duplicates through an inverted join of signature coordinates.

Each document's set of shingles has a signature of ``COORDINATES`` least hashes.
A coordinate with its value is a term, and a document is posted under its terms.
Two sets of the similarity agree in fewer than ``MATCHES`` coordinates with a
chance below 1e-8, so pairs with that many collisions are what is looked for:

* prefix: terms have one order, the rarer first. Two signatures with ``MATCHES``
  common terms share one of the first ``COORDINATES - MATCHES + 1`` of each, so
  only these are posted. Terms that one document alone has come first and need
  no list, and a document that shares fewer than ``MATCHES`` terms has no partner.
* skip: the lists are merged only as far as the first collision of a pair; the
  collisions of its other coordinates are counted on the two signatures.

Lists are not walked in pairs. Every entry is held against the list's pivot, the entry
whose terms are the most frequent ones, as those of a text are from which others were
made; the pairs found are confirmed on the full sets and make components, and the lists
that still hold several are held against a pivot outside their largest one. What then is
left of a list is the entries outside its largest component: these are held against all
entries of other components, in blocks of bounded size that Spark deals out, so no list
is one task and no link between components is lost. A parity sketch of each set, which
never overstates how much two sets differ, keeps pairs below the bound from being confirmed.

Defined cases: null and wordless texts have an empty set and stay alone; a text
with fewer words than a shingle is one shingle; rows with equal sets are one
class and rows that repeat an id are one document; rows without an id name no
component, and are kept only where their whole group has none; an empty table
gives an empty table; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.components import roots
from vellum.llm.scratch import keep
from vellum.llm.simhash import EDGE, Sets, _keyed, _set_id, _whole_lists, grouped, shingle_hashes

COORDINATES = 64
MATCHES = 36  # of two sets 0.85 alike, 7.5e-9 have fewer
PERCENT = 85
ROUNDS = 2  # of pivots; what is left after them is searched in full
BLOCK = 1024
SKETCH = 16  # words of 64 bits
SHINGLES_AT_ONCE = 1 << 18

_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The terms of each nonempty set, a row of ``COORDINATES`` longs; the low bits of a term are its coordinate."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), COORDINATES), np.uint64)
    for k in range(COORDINATES):
        z = (flat ^ np.uint64((0x9E3779B97F4A7C15 * (k + 1)) & (2**64 - 1))) * _A
        z ^= z >> np.uint64(29)
        z *= _B
        z ^= z >> np.uint64(32)
        out[:, k] = np.minimum.reduceat(z, starts) & np.uint64(2**64 - COORDINATES) | np.uint64(k)
    return out.view(np.int64)


def _slices(sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Bounds of stretches of sets with a bounded number of shingles, one set at least."""
    at, held = 0, 0
    for k, s in enumerate(sets):
        if k > at and held + len(s) > SHINGLES_AT_ONCE:
            yield at, k
            at, held = k, 0
        held += len(s)
    if at < len(sets):
        yield at, len(sets)


def marked(texts: DataFrame, words: int) -> DataFrame:
    """Of each row its number, ``id`` and size of its shingle set, and its signature (``terms``; none for an empty set).

    ``sketch`` tells for each of ``64 * SKETCH`` slots whether an odd number of shingles falls into it.
    """
    id_type = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), words)) for t in batch.column("text")]
            ids = np.array([_set_id(s) for s in sets], np.uint64).view(np.int64)
            full = [s for s in sets if len(s)]
            made = [signatures(full[a:b]).ravel() for a, b in _slices(full)]
            flat = np.concatenate([np.empty(0, np.int64), *made])
            ends = np.cumsum([0, *(COORDINATES * bool(len(s)) for s in sets)]).astype(np.int32)
            slots = [np.bincount((s & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1 for s in sets]
            sketch = np.packbits(np.array(slots, np.uint8).reshape(len(sets), -1), axis=1, bitorder="little").view(np.int64).ravel()
            at = pa.array(np.arange(0, len(sketch) + 1, SKETCH, dtype=np.int32))
            columns = [
                pa.array(np.arange(row, row + len(sets))), batch.column("doc_id"), batch.column("text_key"), pa.array(ids),
                pa.array([len(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.ListArray.from_arrays(at, pa.array(sketch)),
            ]
            row += len(sets)
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "text_key", "id", "size", "terms", "sketch"])

    return texts.mapInArrow(run, f"row long, doc_id {id_type}, text_key long, id long, size long, terms array<long>, sketch array<long>")


def postings(first: DataFrame) -> DataFrame:
    """term, id and fame (how often the terms of the id occur) of the prefixes of the signatures that share ``MATCHES`` terms with others."""
    each = first.select("id", F.explode("terms").alias("term"))
    shared = keep(each.groupBy("term").agg(F.count("*").alias("n")).filter("n > 1"), "shared_terms")
    ordered = each.join(shared, "term").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "term"))).alias("t"))
    prefix = F.slice("t", F.lit(1), F.size("t") - F.lit(MATCHES - 1))
    fame = F.aggregate("t", F.lit(0).cast("long"), lambda n, x: n + x["n"])
    return ordered.filter(F.size("t") >= MATCHES).select("id", fame.alias("fame"), F.explode(prefix).alias("p")).select(F.col("p.term").alias("term"), "id", "fame")


def agreeing(pairs: DataFrame, first: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose sketches allow the similarity and whose signatures agree in ``MATCHES`` coordinates."""
    kept = ("size", "terms", "sketch")
    a, b = (first.select(F.col("id").alias(k), *[F.col(x).alias(f"{x}_{k}") for x in kept]) for k in "uv")
    both = F.col("size_u") + F.col("size_v")
    differ = F.aggregate(F.zip_with("sketch_u", "sketch_v", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    most = both - 2 * F.ceil(both * percent / (100 + percent) - EDGE)
    fits = (F.least("size_u", "size_v") * 100 >= F.greatest("size_u", "size_v") * percent) & (differ <= most)
    met = pairs.join(a, "u").join(b, "v").filter(fits)
    return met.filter(F.size(F.array_intersect("terms_u", "terms_v")) >= MATCHES).select("u", "v")


def confirmed(pairs: DataFrame, sets: Sets, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets have the similarity."""
    held = sets.of(pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct())
    a, b = (held.select(F.col("id").alias(k), F.col("hashes").alias(f"h{k}")) for k in "uv")
    common = F.size(F.array_intersect("hu", "hv"))
    similar = common * 100 >= (F.size("hu") + F.size("hv") - common) * percent
    return keep(pairs.join(a, "u").join(b, "v").filter(similar).select("u", "v"), "confirmed")


def _open_lists(posts: DataFrame, link: DataFrame | None) -> DataFrame:
    """The entries of lists over several components, with their label; ``main`` is the label of most entries of a list,
    ``pivot`` the entry of most fame outside it (of the whole list, while nothing is linked) and ``pivot_label`` its label."""
    if link is None:
        lists = posts.groupBy("term").agg(F.count("*").alias("n"), F.max_by("id", F.struct("fame", "id")).alias("pivot")).filter("n > 1")
        return posts.withColumn("label", F.col("id")).join(lists.select("term", "pivot", F.col("pivot").alias("pivot_label")), "term")
    named = posts.join(roots(link).select(F.col("node").alias("id"), "root"), "id", "left")
    entries = keep(named.select("term", "id", "fame", F.coalesce("root", "id").alias("label")), "labelled")
    famous = F.max_by(F.struct("id", "label"), F.struct("fame", "id")).alias("famous")
    counts = entries.groupBy("term", "label").agg(F.count("*").alias("n"), famous, F.max(F.struct("fame", "id")).alias("top"))
    main = counts.groupBy("term").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"), F.count("*").alias("labels"))
    main = main.filter("labels > 1").drop("labels")
    outside = counts.join(main, "term").filter("label <> main").groupBy("term", "main", "all", "most").agg(F.max_by("famous", "top").alias("famous"))
    several = outside.select(
        "term", "main", F.col("famous.id").alias("pivot"), F.col("famous.label").alias("pivot_label"),
        F.ceil(F.col("all") / BLOCK).cast("int").alias("blocks"), F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int").alias("probe_blocks"),
    )
    return entries.join(several, "term")


def pivot_pairs(posts: DataFrame, link: DataFrame | None) -> DataFrame:
    """Each entry of an open list with the list's pivot, if they have different labels."""
    met = _open_lists(posts, link).filter("label <> pivot_label")
    return met.select(F.least("id", "pivot").alias("u"), F.greatest("id", "pivot").alias("v")).distinct()


def other_pairs(posts: DataFrame, link: DataFrame, first: DataFrame, percent: int) -> DataFrame:
    """The pairs of one list and different components whose sizes and signatures allow the similarity."""
    open_ = keep(_open_lists(posts, link), "open_lists")
    probe = F.col("label") != F.col("main")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    within = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    kept = ["term", "id", "label"]
    members = open_.select(*kept, F.lit(False).alias("probe"), within("blocks").alias("i"), spread("probe_blocks").alias("j"))
    probes = open_.filter(probe).select(*kept, F.lit(True).alias("probe"), spread("blocks").alias("i"), within("probe_blocks").alias("j"))
    # one key per (list, block of members, block of probes)
    dealt = members.unionByName(probes).withColumn("key", F.xxhash64("term", "i", "j")).join(first.select("id", "size", "terms", "sketch"), "id")
    ordered = dealt.select("key", "id", "label", "probe", "size", "terms", "sketch").repartition("key").sortWithinPartitions("key", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_lists(batches):
            key, ids, label, probe, size = (table.column(k).to_numpy() for k in range(5))
            terms = table.column("terms").combine_chunks().flatten().to_numpy().reshape(len(ids), COORDINATES)
            sketch = table.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(ids), SKETCH)
            head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])).tolist()
            u, v = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for a, b in zip(head, [*head[1:], len(key)]):
                at = np.arange(a, b)
                other = at[~probe[a:b]]
                for p in at[probe[a:b]].tolist():
                    near = other[(label[other] != label[p]) & (100 * np.minimum(size[other], size[p]) >= percent * np.maximum(size[other], size[p]))]
                    both = size[near] + size[p]
                    differ = np.bitwise_count(sketch[near] ^ sketch[p]).sum(1, dtype=np.int64)
                    near = near[differ <= both - 2 * np.ceil(both * percent / (100 + percent) - EDGE)]
                    near = near[(terms[near] == terms[p]).sum(1) >= MATCHES]
                    u.append(np.minimum(ids[near], ids[p]))
                    v.append(np.maximum(ids[near], ids[p]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], names=["u", "v"])

    return ordered.mapInArrow(run, "u long, v long").distinct()


def links(first: DataFrame, sets: Sets, percent: int) -> DataFrame:
    """Links (u, v) between ids of ``first`` (one marked row of each) whose components are those of all similar pairs."""
    posts, link, tried = keep(postings(first), "posts"), None, None
    for _ in range(ROUNDS):
        pairs = pivot_pairs(posts, link)
        new = keep(agreeing(pairs if tried is None else pairs.join(tried, ["u", "v"], "left_anti"), first, percent), "pivot_pairs")
        found = confirmed(new, sets, percent)
        tried, link = (new, found) if tried is None else (tried.union(new), link.union(found))
    rest = other_pairs(posts, link, first, percent).join(tried, ["u", "v"], "left_anti")
    return link.union(confirmed(keep(rest, "other_pairs"), sets, percent))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable) and kept, one row per row of ``docs``."""
    texts = _keyed(docs, id_col, text_col)
    rows = keep(marked(texts, words), "signatures")
    one = keep(rows.filter("size > 0").groupBy("id").agg(F.min("row").alias("row")).select("row"), "first")
    first = keep(rows.join(one, "row", "left_semi"), "first_rows")
    link = links(first, Sets(texts, first, words), percent)
    full = grouped(rows.filter("size > 0").select("doc_id", F.col("id").alias("fp"), "size"), link)
    alone = rows.filter("size = 0").select("doc_id", "size", F.col("doc_id").alias("component_id"))
    both = full.select("doc_id", "size", "component_id").unionByName(alone)
    return both.select("doc_id", F.col("size").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
