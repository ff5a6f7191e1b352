"""Exact removal of repeated passages through enhanced suffix arrays.

Every string of ``LEAST`` bytes has an anchor, the smallest hash of the
``GRAM``-byte strings in it, which depends on its content alone. Equal strings
have equal anchors, so neighbouring starts with one anchor (a run) are dealt out
by it, first as hashes:

1. Runs whose whole bytes repeat need no suffix array: all but the first are
   repeats. What a batch already repeats is settled there, before the shuffle.
2. The distinct runs of an anchor that has several meet with their bytes, and so
   does a lone run that holds its anchor twice, as it may repeat itself. Their
   suffixes are sorted, neighbours' common prefixes found, and a stack scan over
   those walks the tree of common-prefix intervals. An interval whose
   occurrences follow different bytes cannot be extended to the left: it is a
   maximal repeat, passed on with all its occurrences.
3. An anchor with more than ``MOST_RUNS`` distinct runs is dealt out anew by the
   hash of each whole string of ``LEAST`` bytes, where all equals meet anyway.

A byte is removed if some maximal repeat of at least ``LEAST`` bytes covers it in
another occurrence than its first by (document, start), which is the same as
being covered by a ``LEAST``-byte string that also starts earlier.

Anchors that hold much of a sample of the runs are dealt out by run as well as by
anchor and count as having several; that changes where work is done, never what
is found. Runs and strings count as equal if their 64-bit hashes and anchors are.

Defined cases: a null text is empty and an empty one has no bytes; rows with one
id and one text are one document and each gets its result; rows with one id and
different texts are different documents, in the order of a 32-bit checksum of
the text, which also tells them apart; a row with a null id is a document of its
own text, stands before all ids from 0 on and meets others under its text's hash;
an empty table gives an empty table; other
columns of the input are not read by :func:`removed` and are kept by
:func:`without_repeats`.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.scratch import drop, keep, keep_by

LEAST = 100
GRAM = 32
BLOCK = 1 << 16
LONGEST_RUN = 156
MOST_RUNS = 8192
SORTED_AT_ONCE = 1 << 20
SALTS = 64
NO_ID = -(1 << 63)
START_BITS = 31  # no text of Spark is longer
U = np.uint64
FACTOR = 0x5851F42D4C957F2D


def _powers(base: int) -> np.ndarray:
    """base ** k, modulo 2 ** 64."""
    factors = np.full(BLOCK + 2 * LEAST, base, U)
    factors[0] = 1
    return np.cumprod(factors)


POWER, INVERSE = _powers(FACTOR), _powers(pow(FACTOR, -1, 2**64))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each place on."""
    x = data.astype(U)
    for n in (1, 2, 4):
        x = x[:-n] | (x[n:] << U(8 * n))
    x = x * U(0x9E3779B97F4A7C15)
    x ^= x >> U(32)
    ends = len(x) - 24
    h = x[:ends] * U(0xBF58476D1CE4E5B9)
    for k, c in ((8, 0x94D049BB133111EB), (16, 0xD6E8FEB86659FD93), (24, 0xFF51AFD7ED558CCD)):
        h += x[k : k + ends] * U(c)
    h ^= h >> U(29)
    h *= U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(32))


def sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    m, n = h, 1
    while 2 * n <= width:
        m, n = np.minimum(m[:-n], m[n:]), 2 * n
    rest = width - n
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def runs(data: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """anchor, hash of the run's bytes, start and number of starts of each run, block by block."""
    return (found[:4] for found in told_runs(data))


def told_runs(data: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """As :func:`runs`, and whether a run may repeat itself."""
    for at in range(0, len(data) - LEAST + 1, BLOCK):
        h = gram_hashes(data[at : at + BLOCK + LEAST - 1])
        m = sliding_least(h, LEAST - GRAM + 1)
        start = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
        n = np.diff(np.concatenate([start, [len(m)]]))
        if n.max() > LONGEST_RUN:
            cuts = -(-n // LONGEST_RUN)
            nth = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            start, n = np.repeat(start, cuts) + nth * LONGEST_RUN, np.repeat(n, cuts) - nth * LONGEST_RUN
            n = np.minimum(n, LONGEST_RUN)
        total = np.concatenate([np.zeros(1, U), np.cumsum(h * POWER[: len(h)])])
        end = start + n + (LEAST - GRAM)
        yield m[start], (total[end] - total[start]) * INVERSE[start], start + at, n, _twice(h, m, start, end)


def _twice(h: np.ndarray, m: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether the grams from ``start`` to ``end`` of each run hold its anchor twice; a run that repeats a string does.

    A gram is an anchor if it is the least of some window, so the greatest least of all windows over it.
    All windows of a run hold its anchor, so no other anchor stands between two of them.
    """
    width = LEAST - GRAM + 1
    edge = np.zeros(width - 1, U)
    places = np.flatnonzero(h == ~sliding_least(~np.concatenate([edge, m, edge]), width))
    same = np.flatnonzero(h[places[1:]] == h[places[:-1]])
    if not len(same):
        return np.zeros(len(start), bool)
    return np.searchsorted(places[same + 1], end) > np.searchsorted(places[same], start)


def tagged(raw: bytes) -> int:
    """What stands above the start in ``place``, so that texts with one id stay apart."""
    return zlib.crc32(raw) << START_BITS


def _raw(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")


def _key(id_col: str, text_col: str) -> Column:
    """The id; where it is null, a negative number made of the text, so that such rows share no key."""
    own = F.xxhash64(_raw(text_col)).bitwiseOR(F.lit(NO_ID))
    return F.coalesce(F.col(id_col).cast("long"), own)


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(_key(id_col, text_col).alias("doc_id"), F.col(id_col).isNull().alias("no_id"), _raw(text_col).alias("raw"))


RUNS = "doc_id long, place long, n int, anchor long, bytes_hash long, salt int, twice boolean, kind string"
_RUN_NAMES = ["doc_id", "place", "n", "anchor", "bytes_hash", "salt", "twice", "kind"]


def run_rows(named: DataFrame, hot: list[int]) -> DataFrame:
    """The runs of all texts; those that an earlier row of the batch has are of kind ``copy``."""
    hot_sorted = np.sort(np.array(hot, np.int64).view(U))

    def made(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        anchor, bytes_hash, place, n, twice, doc = (np.concatenate([f[k] for f in found]) for k in range(6))
        order = np.lexsort((place, doc, bytes_hash, anchor))
        a, b, d, p = anchor[order], bytes_hash[order], doc[order], place[order]
        same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
        head = np.flatnonzero(np.concatenate([[True], ~same]))
        head = np.repeat(head, np.diff(np.concatenate([head, [len(a)]])))
        copy = (d != d[head]) | (p != p[head])
        salt = np.zeros(len(a), np.int32)
        if len(hot_sorted):
            at = np.minimum(np.searchsorted(hot_sorted, a), len(hot_sorted) - 1)
            is_hot = hot_sorted[at] == a
            salt[is_hot] = 1 + (b[is_hot] % U(SALTS)).astype(np.int32)
        kind = pa.DictionaryArray.from_arrays(pa.array(copy.astype(np.int8)), pa.array(["first", "copy"])).cast(pa.string())
        arrays = [d, p, n[order].astype(np.int32), np.where(copy, U(0), a).view(np.int64), np.where(copy, U(0), b).view(np.int64), salt, twice[order]]
        return pa.RecordBatch.from_arrays([*map(pa.array, arrays), kind], names=_RUN_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for batch in batches:
            for doc, raw in zip(batch.column("doc_id").to_pylist(), batch.column("raw")):
                text = raw.as_py()
                tag = tagged(text)
                for a, b, start, n, twice in told_runs(np.frombuffer(text, np.uint8)) if len(text) >= LEAST else ():
                    found.append((a, b, start + tag, n, twice, np.full(len(a), doc, np.int64)))
                    held += len(a)
                    if held > 400_000:
                        yield made(found)
                        found, held = [], 0
        if found:
            yield made(found)

    return named.mapInArrow(run, RUNS)


def hot_anchors(named: DataFrame, one_in: int = 64, share: float = 0.0005) -> list[int]:
    """Anchors with at least ``share`` of the runs of a sample: at most 1 / ``share`` of them."""
    sample = named.filter(F.pmod(F.xxhash64("doc_id"), F.lit(one_in)) == 0)
    counts = run_rows(sample, []).filter("kind = 'first'").groupBy("anchor").count()
    rows = counts.filter("count >= 16").orderBy(F.desc("count"), "anchor").limit(int(1 / share)).collect()
    total = sum(r["count"] for r in rows)
    return [r["anchor"] for r in rows if r["count"] >= max(16, share * total)]


def settled(first: DataFrame) -> DataFrame:
    """Runs that are repeats whole (``copy``), and the first ones of anchors with several distinct runs or of runs that may repeat themselves (``several``)."""
    dealt = first.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", "bytes_hash", "doc_id", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the anchor, salt, hash, document and place of the newest first, and its run
        owed = False  # that first is not passed on yet: it is the only one of its anchor so far

        def made(columns, kinds):
            doc, place, n, anchor = columns
            names = ["doc_id", "place", "n", "anchor", "kind"]
            return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(place), pa.array(n), pa.array(anchor), pa.array(kinds, pa.string())], names=names)

        for batch in batches:
            get = lambda name: batch.column(name).to_numpy(zero_copy_only=False)
            doc, place, n, anchor, hashed, salt, twice = map(get, ("doc_id", "place", "n", "anchor", "bytes_hash", "salt", "twice"))
            if last is not None:
                join = lambda x, v: np.concatenate([np.array([v], x.dtype), x])
                doc, place, n, anchor, hashed, salt, twice = (join(x, v) for x, v in zip((doc, place, n, anchor, hashed, salt, twice), last))
            size = len(doc)
            if not size:
                continue
            new_anchor = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (salt[1:] != salt[:-1])])
            new_run = new_anchor | np.concatenate([[True], hashed[1:] != hashed[:-1]])
            head = np.maximum.accumulate(np.where(new_run, np.arange(size), 0))
            copy = ~new_run & ((doc != doc[head]) | (place != place[head]))
            group = np.cumsum(new_anchor) - 1
            several = (np.bincount(group, weights=new_run)[group] > 1) | (salt > 0) | twice
            passed = new_run & several
            if last is not None and not owed:
                passed[0] = False
                # its anchor had several before, so all of them are passed on
                passed |= new_run & (group == 0)
                passed[0] = False
            out = np.flatnonzero(copy | passed)
            if len(out):
                kinds = np.where(copy[out], "copy", "several")
                yield made([x[out] for x in (doc, place, n, anchor)], kinds)
            h = head[-1]
            was_passed = bool(passed[h]) or (h == 0 and last is not None and not owed)
            last, owed = tuple(x[h] for x in (doc, place, n, anchor, hashed, salt, twice)), not was_passed

    return dealt.mapInArrow(run, "doc_id long, place long, n int, anchor long, kind string")


def run_bytes(named: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` runs (doc_id, place, n, anchor, crowded) with their bytes."""
    lists = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("place", "n", "anchor", "crowded")).alias("runs"))
    schema = "doc_id long, place long, n int, anchor long, crowded boolean, bytes binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, raw, found in zip(*(batch.column(c) for c in ("doc_id", "raw", "runs"))):
                doc, raw, found = doc.as_py(), raw.as_py(), found.as_py()
                tag = tagged(raw)
                for r in found:
                    at = r["place"] - tag
                    if 0 <= at < 1 << START_BITS:
                        out.append((doc, r["place"], r["n"], r["anchor"], r["crowded"], raw[at : at + r["n"] + LEAST - 1]))
                if len(out) > 20_000:
                    yield _batch(out, schema)
                    out = []
            if out:
                yield _batch(out, schema)

    return named.join(lists, "doc_id").mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[f for f, _ in fields])


# -- suffix arrays

#: Ranks are known for prefixes of 8 bytes and of twice each of these, enough for a run's bytes.
LEVELS = (8, 16, 32, 64, 128)
assert 2 * LEVELS[-1] > LONGEST_RUN + LEAST - 1


class SuffixArray:
    """The suffixes of at least ``LEAST`` bytes of some byte strings, sorted, with common prefixes.

    A suffix ends with its string. ``text`` has the strings one after another.
    """

    def __init__(self, parts: list[bytes]):
        sizes = np.array([len(p) for p in parts])
        self.begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.owner = np.repeat(np.arange(len(parts)), sizes)
        self.text = np.frombuffer(b"".join(parts), np.uint8)
        size = len(self.text)
        self.left = sizes[self.owner] - (np.arange(size) - self.begins[self.owner])  # bytes to the string's end
        padded = np.concatenate([self.text, np.zeros(8, np.uint8)]).astype(U)
        word = np.zeros(size, U)
        for k in range(8):  # big-endian, zero beyond the end
            word |= np.where(self.left > k, padded[k : k + size], U(0)) << U(56 - 8 * k)
        self.word = word
        rank = np.unique(word, return_inverse=True)[1].astype(np.int64)
        if (self.text == 0).any():  # what ends stands before what goes on with zeros
            rank = np.unique(rank * 9 + np.minimum(self.left, 8), return_inverse=True)[1].astype(np.int64)
        self.ranks = [rank + 1]
        for n in LEVELS:
            low = self.ranks[-1]
            far = np.zeros(size, np.int64)
            inside = np.flatnonzero(self.left > n)
            far[inside] = low[inside + n]
            self.ranks.append(np.unique(low * (size + 2) + far, return_inverse=True)[1].astype(np.int64) + 1)
        starts = np.flatnonzero(self.left >= LEAST)
        self.order = starts[np.argsort(self.ranks[-1][starts], kind="stable")]
        self.common = self._common(self.order[:-1], self.order[1:])

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at ``a`` and ``b``."""
        most = np.minimum(self.left[a], self.left[b])
        got = np.zeros(len(a), np.int64)
        for level in range(len(LEVELS), -1, -1):
            n = 8 << level
            at = np.flatnonzero(most - got >= n)
            same = at[self.ranks[level][a[at] + got[at]] == self.ranks[level][b[at] + got[at]]]
            got[same] += n
        at = np.flatnonzero(most > got)
        x = self.word[a[at] + got[at]] ^ self.word[b[at] + got[at]]
        high = np.where(x == 0, 8, 0)
        for k in range(8):
            high = np.where((x >> U(56 - 8 * k) == 0), k + 1, high)
        got[at] += high
        return np.minimum(got, most)

    def before(self) -> np.ndarray:
        """The byte before each sorted suffix; what begins a string differs from all others."""
        first = self.order == self.begins[self.owner[self.order]]
        return np.where(first, 256 + self.order, self.text[np.maximum(self.order - 1, 0)])

    def maximal_repeats(self) -> Iterator[tuple[int, int, int]]:
        """(length, first, end) of each repeat that no byte extends on either side.

        Its occurrences are all suffixes in ``order[first:end]``. Inner intervals come first.

        The scan keeps a stack of open intervals (common prefix, first suffix,
        the byte before all of its suffixes or None if they differ).
        """
        prefix = np.concatenate([self.common, [0]])
        before = self.before()
        linked = prefix >= LEAST
        bounds = np.flatnonzero(np.diff(np.concatenate([[False], linked, [False]]).astype(np.int8)))
        for lo, hi in zip(bounds[::2].tolist(), bounds[1::2].tolist()):
            bytes_before = before[lo : hi + 1]
            if (bytes_before == bytes_before[0]).all():
                continue  # all extend to the left, and so does every interval within
            common = prefix[lo:hi].tolist()
            preceding = bytes_before.tolist()
            stack: list[list] = []
            for k, length in enumerate([*common, 0]):
                begin, byte = k, preceding[k]
                while stack and stack[-1][0] > length:
                    closed, begin, own = stack.pop()
                    byte = own if own == byte else None
                    if byte is None:
                        yield closed, lo + begin, lo + k + 1
                if stack and stack[-1][0] == length:
                    stack[-1][2] = byte if byte == stack[-1][2] else None
                elif length:
                    stack.append([length, begin, byte])


def _placed(rows: list[tuple[int, int, bytes]]) -> tuple[SuffixArray, np.ndarray, np.ndarray]:
    """The suffix array of some runs' bytes (doc_id, place, bytes) and each byte's document and place."""
    array = SuffixArray([r[2] for r in rows])
    doc = np.array([r[0] for r in rows], np.int64)[array.owner]
    place = np.array([r[1] for r in rows], np.int64)[array.owner] + np.arange(len(array.text)) - array.begins[array.owner]
    return array, doc, place


OCCURRENCES = "repeat long, length int, doc_id long, place long"


def _occurrences(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    """All occurrences of the maximal repeats."""
    array, doc, place = _placed(rows)
    out = []
    for length, first, end in array.maximal_repeats():
        at = array.order[first:end]
        mark = zlib.crc32(array.text[at[0] : at[0] + length].tobytes()) << 16 | length
        out += [(mark, length, d, p) for d, p in zip(doc[at].tolist(), place[at].tolist())]
    return _batch(out, OCCURRENCES)


SPANS = "doc_id long, place long, length int"


def _later(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    """Spans that the maximal repeats cover in another occurrence than their first.

    An occurrence that is not a repeat's first needs no look at the outer
    repeats that hold it too: they are shorter. So each repeat hands on its first alone.
    """
    array, doc, place = _placed(rows)
    age = np.empty(len(array.order), np.int64)
    age[np.lexsort((place[array.order], doc[array.order]))] = np.arange(len(array.order))
    open_ = np.ones(len(array.order), bool)
    edges = np.zeros(len(array.text) + 1, np.int32)
    for length, first, end in array.maximal_repeats():
        at = first + np.flatnonzero(open_[first:end])
        if len(at) < 2:
            continue
        keep_one = at[age[at].argmin()]
        open_[at] = False
        open_[keep_one] = True
        starts = array.order[at[at != keep_one]]
        edges[starts] += 1  # starts differ within a repeat, and so do ends
        edges[starts + length] -= 1
    covered = np.concatenate([[False], np.cumsum(edges[:-1]) > 0, [False]])
    begins = np.zeros(len(covered), bool)
    begins[1 + array.begins] = True  # spans end where their string ends
    on = np.flatnonzero(covered & (~np.roll(covered, 1) | begins))
    off = np.flatnonzero(~covered & np.roll(covered, 1) | covered & begins & np.roll(covered, 1))
    on, off = on - 1, off - 1
    columns = [doc[on], place[on], (off - on).astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc_id", "place", "length"])


def _by_anchor(found: DataFrame, made, schema: str) -> DataFrame:
    """``made`` of the runs of some anchors at a time; one anchor's runs meet in one place."""
    columns = ["anchor", "doc_id", "place", "bytes"]
    dealt = found.select(columns).repartition("anchor").sortWithinPartitions("anchor", "doc_id", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            for anchor, *row in zip(*(batch.column(c).to_pylist() for c in columns)):
                if size > SORTED_AT_ONCE and anchor != last:
                    yield made(held)
                    held, size = [], 0
                if anchor == last and held and row[:2] == held[-1][:2]:
                    continue  # a repeated row of the table
                held.append(row)
                size += len(row[2])
                last = anchor
        if held:
            yield made(held)

    return dealt.mapInArrow(run, schema)


def maximal_repeats(found: DataFrame) -> DataFrame:
    """repeat, length, doc_id, place: all occurrences of all maximal repeats among runs with bytes."""
    return _by_anchor(found, _occurrences, OCCURRENCES)


def later_occurrences(found: DataFrame) -> DataFrame:
    """The spans to remove among runs with bytes."""
    return _by_anchor(found, _later, SPANS)


def whole_strings(found: DataFrame) -> DataFrame:
    """The repeats of anchors with very many runs: each string of LEAST bytes, dealt out by its hash."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = LEAST - GRAM + 1

        def made(found):
            columns = [np.concatenate(c) for c in zip(*found)]
            return pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=["string", "doc_id", "place"])

        found = []
        for batch in batches:
            for doc, place, n, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "place", "n", "bytes"))):
                h = gram_hashes(np.frombuffer(raw, np.uint8))
                total = np.concatenate([np.zeros(1, U), np.cumsum(h * POWER[: len(h)])])
                at = np.arange(n)
                key = (total[at + width] - total[at]) * INVERSE[at]
                found.append((key.view(np.int64), np.full(n, doc, np.int64), at + place))
                if len(found) == 1000:
                    yield made(found)
                    found = []
        if found:
            yield made(found)

    strings = found.mapInArrow(spread, "string long, doc_id long, place long")
    here = F.struct("doc_id", "place")
    first = strings.groupBy("string").agg(F.min(here).alias("head"), F.count("*").alias("times")).filter("times > 1")
    later = strings.join(first, "string").filter(here != F.col("head"))
    return later.select("doc_id", "place", F.lit(LEAST).alias("length"))


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans (doc_id, place, length) that together are all bytes to remove."""
    named = _named(docs, id_col, text_col)
    hot = hot_anchors(named)
    path, rows = keep_by(run_rows(named, hot), "runs", "kind")
    done = keep(settled(rows.filter("kind = 'first'")), "settled")
    drop(docs.sparkSession, f"{path}/kind=first")
    several = done.filter("kind = 'several'").drop("kind")
    crowded = several.groupBy("anchor").count().filter(F.col("count") > MOST_RUNS).select("anchor")
    marked = several.join(crowded.withColumn("crowded", F.lit(True)), "anchor", "left")
    texts = keep(run_bytes(named, marked), "run_bytes")
    span = (F.col("n") + LEAST - 1).alias("length")
    spans = [
        keep(later_occurrences(texts.filter("crowded IS NULL")), "repeats"),
        keep(whole_strings(texts.filter("crowded")), "strings"),
        done.filter("kind = 'copy'").select("doc_id", "place", span),
        rows.filter("kind = 'copy'").select("doc_id", "place", span),
    ]
    return spans[0].unionByName(spans[1]).unionByName(spans[2]).unionByName(spans[3])


def _kept(raw: bytes, spans: list) -> tuple[bytes, int, int]:
    """What is left of a text, the bytes removed, and the maximal removed stretches."""
    tag = tagged(raw)
    own = [(p - tag, p - tag + n) for p, n in spans if 0 <= p - tag < 1 << START_BITS]
    if not own:
        return raw, 0, 0
    edges = np.zeros(len(raw) + 1, np.int32)
    ends = np.array(own)
    np.add.at(edges, ends[:, 0], 1)
    np.add.at(edges, np.minimum(ends[:, 1], len(raw)), -1)
    out = np.cumsum(edges[:-1]) > 0
    stretches = int(out[0]) + int((out[1:] & ~out[:-1]).sum())
    return np.frombuffer(raw, np.uint8)[~out].tobytes(), int(out.sum()), stretches


def _by_document(spans: DataFrame) -> DataFrame:
    return spans.groupBy("doc_id").agg(F.collect_list(F.struct("place", "length")).alias("spans"))


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    named = _named(docs, id_col, text_col)
    spans = _by_document(repeated(docs, id_col, text_col))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, no_id, raw, own in zip(*(batch.column(c) for c in ("doc_id", "no_id", "raw", "spans"))):
                raw, doc = raw.as_py(), None if no_id.as_py() else doc.as_py()
                kept, n, stretches = _kept(raw, _pairs(own))
                out.append((doc, len(raw), n, stretches, hashlib.sha256(kept).hexdigest()))
            yield _batch(out, schema)

    return named.join(spans, "doc_id", "left").mapInArrow(run, schema)


def _pairs(own: pa.Scalar) -> list[tuple[int, int]]:
    return [(s["place"], s["length"]) for s in own.as_py() or ()]


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeats cut out of the text; bytes that no longer form a character are dropped."""
    spans = _by_document(repeated(docs, id_col, text_col)).withColumnsRenamed({"doc_id": "__doc", "spans": "__spans"})

    @F.pandas_udf("string")
    def cut(text, own):
        import pandas as pd

        out = []
        for t, spans in zip(text, own):
            if t is None or spans is None:
                out.append(t)
            else:
                out.append(_kept(t.encode(), [(s["place"], s["length"]) for s in spans])[0].decode("utf-8", "ignore"))
        return pd.Series(out, dtype=object)

    joined = docs.join(spans, _key(id_col, text_col) == F.col("__doc"), "left")
    return joined.withColumn(text_col, cut(F.col(text_col), F.col("__spans"))).select(*docs.columns)
