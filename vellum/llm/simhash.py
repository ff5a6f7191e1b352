"""SimHash near-duplicates through a byte-position inverted index.

A fingerprint's bytes, each with its position, are its index terms. Two
fingerprints of eight bytes that differ in at most ``d`` bits share at least
``8 - d`` positional bytes, the guaranteed minimum. Postings are therefore kept
by the terms of that many positions together, one list per choice of
positions: every pair on a list has reached the minimum, none that has reached
it is missed, and lists stay short. The shared bytes of a pair are tallied and
the pair is verified bit by bit. Equal fingerprints are one entry, so a list
holds at most ``256 ** d`` entries; a long list is searched by flipping the few
bits in which its members can differ instead of pair by pair.

For a similarity bound instead of a bit bound (:func:`similar_links`) the sets
of shingles themselves are joined, and no pair is lost: shingles have one
order, the rarer first as far as a sample tells, and two sets of a Jaccard
similarity must share one of their first few. Lists are kept by these; a pair
stays a candidate if the places of the shared shingle leave room for enough
common ones. Long lists are held against their head first; then all their pairs
that are not linked yet are tried, block by block, against a sketch that never
overstates how much two sets differ. Each candidate is verified on its shingles.

Defined cases: null and empty texts have the zero fingerprint and are linked
like any other; a text with fewer words than a shingle is one shingle; ties of
the half count as zero bits; rows that repeat fall into one group, one result
row for each; null ids take part without naming a component; an empty table
gives an empty table; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from vellum.llm.components import roots
from vellum.llm.scratch import keep, unburden

SEED = 42
SHORT_LIST = 24
STRIDE = 1 << 15


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each shingle of the lower-cased words, repeats included."""
    norm = b" ".join((text or "").encode().lower().split())
    if not norm:
        return np.empty(0, np.uint64)
    gaps = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
    starts = np.concatenate([[0], gaps + 1]).tolist()
    ends = np.concatenate([gaps, [len(norm)]]).tolist()
    spans = zip(starts, ends[words - 1 :]) if len(starts) >= words else [(0, len(norm))]
    return np.array([xxh64_intdigest(norm[a:b], SEED) for a, b in spans], np.uint64)


def _mixed(h: np.ndarray, nth: int) -> np.ndarray:
    """The ``nth`` independent hash that follows from a hash; the 0th is itself."""
    if nth == 0:
        return h
    z = h + np.uint64((0x9E3779B97F4A7C15 * nth) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprint(hashes: np.ndarray, width: int = 1) -> np.ndarray:
    """``width`` 64-bit words; a bit is 1 if more than half of the hashes have it."""
    ones = np.zeros(64 * width, np.int64)
    for at in range(0, len(hashes), STRIDE):
        part = hashes[at : at + STRIDE]
        for k in range(width):
            bits = np.unpackbits(_mixed(part, k).view(np.uint8), bitorder="little").reshape(-1, 64)
            ones[64 * k : 64 * k + 64] += bits.sum(0, dtype=np.int32)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)


def fingerprints(docs: DataFrame, words: int, width: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``fp``, the fingerprint (an array of longs if ``width`` is over 1)."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = named.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            prints = [fingerprint(shingle_hashes(t.as_py(), words), width) for t in texts]
            if width == 1:
                column = pa.array(np.concatenate(prints) if prints else [], pa.int64())
            else:
                column = pa.array([p.tolist() for p in prints], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), column], names=["doc_id", "fp"])

    return named.mapInArrow(run, f"doc_id {id_type}, fp {'long' if width == 1 else 'array<long>'}")


# -- a bound on differing bits


def _choices(bits: int) -> list[tuple[int, ...]]:
    """The positions left out of each posting key."""
    return list(combinations(range(8), bits))


def _mask(left_out: tuple[int, ...]) -> int:
    """All bytes but those left out, as a signed long."""
    value = sum(0xFF << (8 * p) for p in range(8) if p not in left_out)
    return value - (1 << 64) if value >= 1 << 63 else value


def postings(prints: DataFrame, bits: int) -> DataFrame:
    """choice, terms (the positional bytes kept by the choice) and fp."""
    keys = [F.struct(F.lit(c).alias("choice"), F.col("fp").bitwiseAND(F.lit(_mask(p))).alias("terms")) for c, p in enumerate(_choices(bits))]
    return prints.select(F.explode(F.array(*keys)).alias("k"), "fp").select("k.choice", "k.terms", "fp")


def _pairs(choice: np.ndarray, terms: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs on the posting lists; rows of a list are neighbours."""
    new = np.flatnonzero(np.concatenate([[True], (choice[1:] != choice[:-1]) | (terms[1:] != terms[:-1])]))
    sizes = np.diff(np.concatenate([new, [len(fp)]]))
    end = np.repeat(new + sizes, sizes)
    size = np.repeat(sizes, sizes)
    out_a, out_b = [], []
    short = np.flatnonzero((size > 1) & (size <= SHORT_LIST))
    for step in range(1, int(size[short].max(initial=1))):
        i = short[short + step < end[short]]
        a, b = fp[i], fp[i + step]
        x = (a ^ b).view(np.uint8).reshape(-1, 8)
        shared = (x == 0).sum(1)  # the tally of positional bytes
        found = (shared >= 8 - bits) & (np.bitwise_count(a ^ b) <= bits)
        out_a.append(a[found])
        out_b.append(b[found])
    for at, n in zip(new[sizes > SHORT_LIST].tolist(), sizes[sizes > SHORT_LIST].tolist()):
        a, b = _flips(np.sort(fp[at : at + n]), _choices(bits)[int(choice[at])], bits)
        out_a.append(a)
        out_b.append(b)
    empty = np.empty(0, np.uint64)
    return np.concatenate([empty, *out_a]), np.concatenate([empty, *out_b])


def _flips(fp: np.ndarray, left_out: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A star of links per component of a sorted long list, whose members differ in the bytes left out only."""
    at = [8 * p + k for p in left_out for k in range(8)]
    label = np.arange(len(fp))
    edges = []
    for n in range(1, bits + 1):
        for flip in combinations(at, n):
            other = fp ^ np.uint64(sum(1 << f for f in flip))
            to = np.searchsorted(fp, other)
            hit = np.flatnonzero((to < len(fp)) & (fp[np.minimum(to, len(fp) - 1)] == other))
            hit = hit[to[hit] < hit]
            edges.append((hit, to[hit]))
    u, v = (np.concatenate([e[k] for e in edges]) for k in (0, 1))
    while True:
        before = label.copy()
        np.minimum.at(label, u, label[v])
        np.minimum.at(label, v, label[u])
        label = label[label]
        if (label == before).all():
            break
    far = np.flatnonzero(label != np.arange(len(fp)))
    return fp[far], fp[label[far]]


def links(prints: DataFrame, bits: int) -> DataFrame:
    """Links (u, v) whose components are those of all pairs of distinct ``fp`` within ``bits`` bits."""
    ordered = postings(prints, bits).repartition("choice", "terms").sortWithinPartitions("choice", "terms")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)]

        def made(columns):
            a, b = _pairs(*columns, bits)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["u", "v"])

        for batch in batches:
            columns = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)]
            columns[2] = columns[2].view(np.uint64)
            held = [np.concatenate(x) for x in zip(held, columns)]
            same = (held[0] == held[0][-1]) & (held[1] == held[1][-1]) if len(held[0]) else np.empty(0, bool)
            cut = len(same) - int(same.sum())  # the last list may go on in the next batch
            if cut:
                yield made([x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if len(held[0]):
            yield made(held)

    return ordered.mapInArrow(run, "u long, v long").distinct()


def grouped(prints: DataFrame, link: DataFrame) -> DataFrame:
    """doc_id, fp and ``component_id`` (smallest id reachable) from fingerprints and links between them."""
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    root = keep(roots(link), "roots")
    named = classes.join(root, classes["fp"] == root["node"], "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "first_id"
    )
    named = keep(named, "classes")
    linked = root.select(F.col("root")).distinct()
    least = named.join(linked, "root", "left_semi").groupBy("root").agg(F.min("first_id").alias("component"))
    by_print = named.join(least, "root", "left").select("fp", F.coalesce("component", "first_id").alias("component_id"))
    return prints.join(by_print, "fp")


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id under a bound on differing bits."""
    prints = keep(fingerprints(docs, words, 1, id_col, text_col), "prints")
    distinct = prints.select("fp").distinct()
    found = grouped(prints, links(distinct, bits))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# -- a bound on similarity


SHORT = 32
SAMPLE = 1 << 15
COMMON = 1 << 18
SKETCH = 16
ROUNDS = 3
TEXTS_AT_ONCE = 512
EDGE = 1e-9  # rounding must not lose a pair


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and ``text_key``, by which texts are found again."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("text_key", F.xxhash64("text"))


def _set_id(hashes: np.ndarray) -> int:
    return xxh64_intdigest(hashes.tobytes(), SEED)


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few texts, so that what is made of a part is small on both sides of the worker."""
    unburden()
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
            yield batch.slice(at, TEXTS_AT_ONCE)


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """``id``, a hash of all distinct shingles of a text, and ``hashes``, the shingles, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            sets = [np.unique(shingle_hashes(t.as_py(), words)) for t in batch.column("text")]
            ids = np.array([_set_id(s) for s in sets], np.uint64).view(np.int64)
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64)
            hashes = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays([pa.array(ids), hashes], names=["id", "hashes"])

    return texts.select("text").mapInArrow(run, "id long, hashes array<long>")


def common_shingles(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles of a sample of the texts, ascending, and their counts; only the order of shingles hangs on them."""
    one_in = max(1, texts.count() // SAMPLE)
    sample = shingle_sets(texts.filter(F.pmod("text_key", F.lit(one_in)) == 0), words)
    counted = sample.select(F.explode("hashes").alias("h")).groupBy("h").agg(F.count("*").alias("n")).filter("n > 2")
    top = counted.orderBy(F.desc("n"), "h").limit(COMMON).toArrow()
    h, n = (top.column(k).to_numpy() for k in range(2))
    order = np.argsort(h)
    return h[order], n[order]


def marked(texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """Of each row its number, ``id`` and size of its shingle set, its sketch, and ``keys``: the set's
    rarest shingles, the rarest first, so many that two similar sets must share one.

    ``sketch`` has for each of ``64 * SKETCH`` slots whether an odd number of the set's shingles
    falls into it: two sets differ in at least as many shingles as their sketches do in bits.
    """
    common, counts = common_shingles(texts, words)
    id_type = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in _few(batches):
            ids, sizes, keys, sketch = [], [], [], []
            for t in batch.column("text"):
                own = np.unique(shingle_hashes(t.as_py(), words))
                ids.append(_set_id(own))
                sizes.append(len(own))
                odd = np.bincount((own & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
                sketch.append(np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64))
                flat = own.view(np.int64)
                rank = np.zeros(len(flat), np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, flat), len(common) - 1)
                    rank = np.where(common[at] == flat, counts[at], 0)
                least = int(np.ceil(similarity * len(flat) - EDGE))
                keys.append(flat[np.lexsort((flat, rank))][: len(flat) - least + 1])
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *keys])))
            columns = [pa.array(np.arange(row, row + len(ids))), batch.column("doc_id"), batch.column("text_key")]
            columns += [pa.array(np.array(ids, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), lists]
            ends = pa.array(np.arange(0, SKETCH * len(ids) + 1, SKETCH, dtype=np.int32))
            columns.append(pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.empty(0, np.int64), *sketch]))))
            row += len(ids)
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "text_key", "id", "size", "keys", "sketch"])

    return texts.mapInArrow(run, f"row long, doc_id {id_type}, text_key long, id long, size int, keys array<long>, sketch array<long>")


def prefix_lists(first: DataFrame) -> DataFrame:
    """key, id, size and place of the keys of each set, from one row of each."""
    return first.select(F.posexplode("keys").alias("place", "key"), "id", "size").select("key", "id", "size", "place")


class Sets:
    """The shingle sets of marked texts, made again for the few that are asked for."""

    def __init__(self, texts: DataFrame, first: DataFrame, words: int):
        self.texts, self.first, self.words = texts, first, words

    def of(self, wanted: DataFrame) -> DataFrame:
        """id and hashes of the ids ``wanted`` (a column ``id``)."""
        rows = self.first.join(wanted, "id", "left_semi").select(F.col("doc_id").alias("d"), F.col("text_key").alias("t"))
        rows = keep(rows, "wanted")  # now Spark knows its size, and sends it to the texts if it is small
        found = self.texts.join(rows, (F.col("text_key") == F.col("t")) & F.col("doc_id").eqNullSafe(F.col("d")), "left_semi")
        return shingle_sets(found, self.words).groupBy("id").agg(F.first("hashes").alias("hashes"))


def _enough(size_a, size_b, similarity: float) -> np.ndarray:
    """Shared shingles that sets of these sizes need at least."""
    return np.ceil(similarity / (1 + similarity) * (size_a + size_b) - EDGE)


def _possible(size_a, place_a, size_b, place_b, similarity: float) -> np.ndarray:
    """Whether sets whose first common shingle has these places can be similar."""
    return np.minimum(size_a - place_a, size_b - place_b) >= _enough(size_a, size_b, similarity)


def _whole_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole lists from rows in the order of their key, the first column."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        keys = batch.column(0)
        if keys[0].as_py() == keys[-1].as_py() == held.column(0)[0].as_py():
            continue
        keys = held.column(0).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        yield held.slice(0, cut)
        held = held.slice(cut)
    if held is not None:
        yield held


def _pair_rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distinct pairs, the smaller id first."""
    return np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)


def first_pairs(lists: DataFrame, similarity: float) -> DataFrame:
    """All possible pairs of short lists, each entry of a long list with its head, and the long lists' entries (``long``)."""
    ordered = lists.repartition("key").sortWithinPartitions("key", "id")
    names = ["long", "u", "v", "size", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_lists(batches):
            key, ids, size, place = (c.to_numpy() for c in table.columns)
            fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])])  # copies are one entry
            key, ids, size, place = key[fresh], ids[fresh], size[fresh].astype(np.int64), place[fresh].astype(np.int64)
            head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            n = np.diff(np.concatenate([head, [len(key)]]))
            end, count, first = np.repeat(head + n, n), np.repeat(n, n), np.repeat(head, n)
            found = [(np.flatnonzero(count > SHORT), first[count > SHORT])]
            short = np.flatnonzero((count > 1) & (count <= SHORT))
            for step in range(1, int(count[short].max(initial=1))):
                i = short[short + step < end[short]]
                found.append((i, i + step))
            i, j = (np.concatenate(x) for x in zip(*found))
            good = (i != j) & _possible(size[i], place[i], size[j], place[j], similarity)
            u, v = _pair_rows(ids[i[good]], ids[j[good]])
            none = np.zeros(len(u), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (none != 0, u, v, none, none)], names=names)
            far = count > SHORT
            columns = (np.ones(int(far.sum()), bool), key[far], ids[far], size[far].astype(np.int32), place[far].astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return ordered.mapInArrow(run, "long boolean, u long, v long, size int, place int")


def _across(ids, size, place, label, sketch, similarity: float, rows: int = 64) -> Iterator[np.ndarray]:
    """The pairs of one list with different labels that can be similar, by blocks of rows."""
    for at in range(0, len(ids), rows):
        i, j = np.nonzero(label[at : at + rows, None] != label[None, at:])
        i, j = i + at, j + at
        good = (i < j) & _possible(size[i], place[i], size[j], place[j], similarity)
        i, j = i[good], j[good]
        for part in range(0, len(i), 1 << 17):
            a, b = i[part : part + (1 << 17)], j[part : part + (1 << 17)]
            differ = np.bitwise_count(sketch[a] ^ sketch[b]).sum(1, dtype=np.int64)
            good = differ <= size[a] + size[b] - 2 * _enough(size[a], size[b], similarity)
            yield _pair_rows(ids[a[good]], ids[b[good]])


def _joining(ids, size, place, label, sketch, similarity: float, turn: int) -> Iterator[np.ndarray]:
    """Possible pairs of one list, fewer than its labels, that would join all labels that any possible pairs could.

    A walk over the entries, in an order of each ``turn``'s own: each takes in all possible partners
    that are not reached yet, and with them the others of their label.
    """
    order = np.argsort(_mixed(ids.view(np.uint64), turn + 1))
    left = order[::-1].tolist()
    label = np.unique(label, return_inverse=True)[1]
    by_label = np.argsort(label, kind="stable")
    ends = np.cumsum(np.bincount(label))
    open_ = np.ones(len(ids), bool)
    while left:
        start = left.pop()
        if not open_[start]:
            continue
        walk = by_label[ends[label[start] - 1] if label[start] else 0 : ends[label[start]]].tolist()
        open_[walk] = False
        rest = order[open_[order]]
        while walk and len(rest):
            i = walk.pop()
            j = rest[_possible(size[i], place[i], size[rest], place[rest], similarity)]
            differ = np.bitwise_count(sketch[j] ^ sketch[i]).sum(1, dtype=np.int64)
            j = j[differ <= size[i] + size[j] - 2 * _enough(size[i], size[j], similarity)]
            if not len(j):
                continue
            j = j[np.unique(label[j], return_index=True)[1]]
            yield _pair_rows(np.full(len(j), ids[i]), ids[j])
            for k in label[j].tolist():
                own = by_label[ends[k - 1] if k else 0 : ends[k]]
                open_[own] = False
                walk += own.tolist()
            rest = rest[open_[rest]]


def joining_pairs(entries: DataFrame, similarity: float, turn: int) -> DataFrame:
    """Of the possible pairs of the long lists whose labels differ, so many as could join their labels: fewer than entries."""
    return _of_lists(entries, lambda *columns: _joining(*columns, similarity, turn))


def other_pairs(entries: DataFrame, similarity: float) -> DataFrame:
    """The possible pairs of the long lists (key, id, size, place, label, sketch) whose labels differ."""
    return _of_lists(entries, lambda *columns: _across(*columns, similarity))


def _of_lists(entries: DataFrame, pairs: Callable[..., Iterator[np.ndarray]]) -> DataFrame:
    ordered = entries.select("key", "id", "size", "place", "label", "sketch").repartition("key").sortWithinPartitions("key", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_lists(batches):
            key, ids, size, place, label = (table.column(k).to_numpy() for k in range(5))
            size, place = size.astype(np.int64), place.astype(np.int64)
            head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])).tolist()
            for a, b in zip(head, [*head[1:], len(key)]):
                if (label[a:b] == label[a]).all():
                    continue
                rows = table.column("sketch").slice(a, b - a).combine_chunks()
                sketch = rows.flatten().to_numpy().view(np.uint64).reshape(b - a, -1)
                for u, v in pairs(ids[a:b], size[a:b], place[a:b], label[a:b], sketch):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return ordered.mapInArrow(run, "u long, v long")


def verified(pairs: DataFrame, first: DataFrame, sets: Sets, similarity: float) -> DataFrame:
    """The pairs (u, v) whose sets have the similarity: those that sizes and sketches leave possible, counted on the shingles."""
    small = first.select("id", "size", "sketch")
    a, b = (small.select(F.col("id").alias(k), F.col("size").alias(f"size_{k}"), F.col("sketch").alias(f"sketch_{k}")) for k in "uv")
    differ = F.expr("aggregate(zip_with(sketch_u, sketch_v, (x, y) -> bit_count(x ^ y)), 0, (n, x) -> n + x)")
    both = F.col("size_u") + F.col("size_v")
    most = both - 2 * F.ceil(F.lit(similarity / (1 + similarity)) * both - EDGE)
    pairs = keep(pairs.select("u", "v").distinct().join(a, "u").join(b, "v").filter(differ <= most).select("u", "v"), "pairs")
    held = sets.of(pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct())
    a, b = (held.select(F.col("id").alias(k), F.col("hashes").alias(f"h{k}")) for k in "uv")
    both = F.size(F.array_intersect("hu", "hv"))
    similar = both + EDGE >= F.lit(similarity) * (F.size("hu") + F.size("hv") - both)
    return keep(pairs.join(a, "u").join(b, "v").filter(similar).select("u", "v"), "verified")


def similar_links(first: DataFrame, sets: Sets, similarity: float) -> DataFrame:
    """Links (u, v) between ids of ``first`` (one marked row of each) whose components are those of all similar pairs."""
    found = keep(first_pairs(prefix_lists(first), similarity), "lists")
    link = verified(found.filter("NOT long"), first, sets, similarity)
    entries = found.filter("long").selectExpr("u AS key", "v AS id", "size", "place")
    if entries.isEmpty():
        return link
    drawn = first.join(entries.select("id").distinct(), "id", "left_semi").select("id", "sketch")

    def labelled() -> DataFrame:
        labels = drawn.join(roots(link).select(F.col("node").alias("id"), "root"), "id", "left")
        labels = keep(labels.select("id", "sketch", F.coalesce("root", "id").alias("label")), "labels")
        return entries.join(labels, "id")

    for turn in range(ROUNDS):
        more = verified(joining_pairs(labelled(), similarity, turn), first, sets, similarity)
        if more.isEmpty():
            break
        link = link.union(more)
    return link.union(verified(other_pairs(labelled(), similarity), first, sets, similarity))


def _linked(docs: DataFrame, words: int, similarity: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The marked rows of the documents, and links between their sets."""
    texts = _keyed(docs, id_col, text_col)
    rows = keep(marked(texts, words, similarity), "marked")
    one = keep(rows.groupBy("id").agg(F.min("row").alias("row")).select("row"), "first")
    first = keep(rows.join(one, "row", "left_semi"), "first_rows")
    return rows, similar_links(first, Sets(texts, first, words), similarity)


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and component_id under a bound on the Jaccard similarity of the shingle sets; equal sets are one class."""
    rows, link = _linked(docs, words, similarity, id_col, text_col)
    return grouped(rows.select("doc_id", F.col("id").alias("fp")), link).select("doc_id", "component_id")


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group of near-duplicates, with its own columns: that of the smallest id, or of none where no row has one.

    Rows that repeat an id are told apart by their texts, as are rows without one; of
    rows that repeat both id and text one stays.
    """
    rows, link = _linked(docs, words, similarity, "doc_id", "text")
    root = keep(roots(link), "roots")
    kinds = rows.groupBy("doc_id", "text_key").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    named = kinds.join(root, kinds["id"] == root["node"], "left").select(F.coalesce("root", "id").alias("group"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key").alias("kind"), "n")
    named = keep(named, "kinds")
    first = named.groupBy("group").agg(F.min("kind").alias("first"))
    of = lambda kinds: kinds.select(F.col("kind.doc_id").alias("__doc_id"), F.col("kind.text_key").alias("__key"))
    lost = of(named.join(first, "group").filter("kind <> first"))
    again = of(named.filter("n > 1"))
    key = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    same = (key == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__doc_id"))
    left = docs.join(lost, same, "left_anti")
    if again.isEmpty():
        return left
    one = left.join(again, same, "left_semi").withColumn("__key", key).dropDuplicates(["doc_id", "__key"]).drop("__key")
    return left.join(again, same, "left_anti").unionByName(one)
