"""Alignment of two tokenizers' tokens by the byte offsets where both end one.

Both texts of a document are the same bytes: a space and the text. Neither
tokenizer joins anything across a space or line end that follows other than white
space, so texts are cut there into units, and a unit always ends a token on both
sides. Distinct units are encoded once, and a two-pointer merge of their cumulative
token ends gives groups and links; a text's alignment is that of its units in order.

Texts go through in blocks of bounded size. A block sends each pair of ids once,
with the number of its documents that link them, so pairs are summed up before
they are shuffled. Spark groups them to corpus counts, joins these and the
largest count of each first-side id back to the blocks' pairs, and each block's
documents are then priced against the block's own pairs.

Defined cases: null and empty texts, and texts whose tokens do not give the bytes
back, have no tokens: zeros and an empty digest; each row is a document of its
own, rows that repeat an id count each; ids of any type that survives a cast to
text and back, null included, come back as they were; ties for the largest count
all count as best; an empty table gives an empty table; other columns of the
input are not read. A group's links grow with the product of its two sides'
distinct ids, so memory follows the longest stretch without a common end.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vellum.llm.scratch import keep

CHARS_AT_ONCE = 1 << 23
UNITS_AT_ONCE = 2048
WIDE = 4096

#: A unit ends where a space or line end follows other than white space.
_UNITS = re.compile(r"\s*\S+(?:[^\S \n]\s*\S*)*|\s+")
#: Units that may stand one behind the other in one call: cut on both sides, and nothing in them that pieces write otherwise.
_PLAIN = re.compile(r"[ \n][^\x00▁]*[^\s\x00▁]")
_LEAD = " a"


class Units(NamedTuple):
    """The alignments of distinct units, in their order."""

    text: list[str | None]  # None where a side does not give the bytes back
    sizes: np.ndarray  # a row of n_a, n_b, n_groups and n_links each
    start: np.ndarray  # of each unit's stretch of pairs
    n_pairs: np.ndarray
    pairs: np.ndarray  # distinct within the unit, the first side's id in the high half
    times: np.ndarray


class Merged(NamedTuple):
    """The groups of two token sequences over the same bytes, and the group of each token."""

    ends: np.ndarray
    of_a: np.ndarray
    of_b: np.ndarray


_NONE = np.empty(0, np.int64)


def merged(ends_a: np.ndarray, ends_b: np.ndarray) -> Merged:
    """A merge of two ascending lists of token ends: a group ends where both lists have an end.

    A token goes to the first such end that it reaches; one without bytes stays with those before it.
    """
    at = np.searchsorted(ends_b, ends_a)
    both = ends_a[(at < len(ends_b)) & (ends_b[np.minimum(at, len(ends_b) - 1)] == ends_a)] if len(ends_b) else _NONE
    ends = both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else _NONE
    return Merged(ends, np.searchsorted(ends, ends_a), np.searchsorted(ends, ends_b))


def _letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones stand for themselves."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


class Aligner:
    """Two tokenizer files, A byte-level BPE (tokenizers) and B pieces with byte fallback (sentencepiece)."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        with open(path_a, encoding="utf-8") as f:
            config = json.load(f)
        config["truncation"] = config["padding"] = None
        self.a = Tokenizer.from_str(json.dumps(config))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte = _letters()
        entries = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size(with_added_tokens=True))]
        self.bytes_a = [bytes(byte[c] for c in e) if all(c in byte for c in e) else e.encode() for e in entries]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        crossing = re.compile(rb"[^ \n\t\r\x0b\x0c][ \n]|\n.")
        if any(crossing.search(p) for p in self.bytes_b):
            raise ValueError(f"{path_b}: pieces go across spaces, so texts cannot be cut into units")
        self.len_a, self.len_b = (np.array([len(x) for x in v], np.int64) for v in (self.bytes_a, self.bytes_b))
        self.names = [str(i) for i in range(max(len(entries), len(pieces)))]
        self.lead = self.b.encode("\n")
        self.space = self.lead[:1]

    def _encode_b(self, units: list[str]) -> list[list[int]]:
        """A unit with a space in front is what the library makes of the rest; others stand behind a line end."""
        found = self.b.encode([u[1:] if u[0] == " " else "\n" + u for u in units], num_threads=1)
        return [self.space if u == " " else ids if u[0] == " " else ids[len(self.lead) :] for u, ids in zip(units, found)]

    def _same(self, raw: bytes, a: list[int], b: list[int]) -> bool:
        return b"".join(map(self.bytes_a.__getitem__, a)) == raw and b"".join(map(self.bytes_b.__getitem__, b)) == raw

    def _encoded(self, units: list[str]) -> Iterator[tuple[list[int], int, list[int], list[int]]]:
        """Stretches of units: their numbers, the bytes before them that do not count, and the ids of both sides; units that do not fit are left out."""
        apart = []
        plain = [k for k, u in enumerate(units) if _PLAIN.fullmatch(u)]
        rest = set(range(len(units))).difference(plain)
        for k in range(0, len(plain), UNITS_AT_ONCE):
            part = plain[k : k + UNITS_AT_ONCE]
            text = _LEAD + "".join([units[n] for n in part])
            a, b = self.a.encode(text, add_special_tokens=False).ids, self.b.encode(text[1:], num_threads=1)
            if self._same(text.encode(), a, b):
                yield part, len(_LEAD), a, b
            else:
                apart += part
        apart += sorted(rest)
        for k in range(0, len(apart), UNITS_AT_ONCE):
            part = apart[k : k + UNITS_AT_ONCE]
            alone = [units[n] for n in part]
            of_a = self.a.encode_batch_fast(alone, add_special_tokens=False)
            for n, e, b in zip(part, of_a, self._encode_b(alone)):
                if self._same(units[n].encode(), e.ids, b):
                    yield [n], 0, e.ids, b

    def units(self, units: list[str]) -> Units:
        """The alignments of distinct units."""
        text: list[str | None] = [None] * len(units)
        sizes = np.zeros((len(units), 4), np.int64)
        keys, times = [_NONE], [_NONE]
        width_a, width_b = len(self.bytes_a), len(self.bytes_b)
        for numbers, skip, a, b in self._encoded(units):
            a, b = np.array(a, np.int64), np.array(b, np.int64)
            ends_a, ends_b = np.cumsum(self.len_a[a]) - skip, np.cumsum(self.len_b[b]) - skip
            a, ends_a, b, ends_b = a[ends_a > 0], ends_a[ends_a > 0], b[ends_b > 0], ends_b[ends_b > 0]
            g = merged(ends_a, ends_b)
            bounds = np.cumsum([len(units[n].encode()) for n in numbers])
            unit = np.searchsorted(bounds, g.ends)  # of each group
            n_a, n_b = np.bincount(g.of_a, minlength=len(g.ends)), np.bincount(g.of_b, minlength=len(g.ends))
            a0, b0 = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
            at = np.array(numbers)
            for k, n in enumerate((n_a, n_b, np.ones(len(unit), np.int64), n_a * n_b)):
                sizes[at, k] = np.bincount(unit, n, len(numbers)).astype(np.int64)
            names_a, names_b = ([self.names[i] for i in ids] for ids in (a.tolist(), b.tolist()))
            of_group = [
                f"{names_a[x]}|{names_b[y]}" if m == n == 1 else f"{','.join(names_a[x : x + m])}|{','.join(names_b[y : y + n])}"
                for x, m, y, n in zip(a0.tolist(), n_a.tolist(), b0.tolist(), n_b.tolist())
            ]
            to = np.searchsorted(unit, np.arange(len(numbers) + 1)).tolist()
            for n, x, y in zip(numbers, to, to[1:]):
                text[n] = ";".join(of_group[x:y])
            links = n_a * n_b
            small = np.flatnonzero(links <= WIDE)
            of = np.repeat(small, links[small])
            nth = np.arange(len(of)) - np.repeat(np.cumsum(links[small]) - links[small], links[small])
            keys.append((at[unit[of]] * width_a + a[a0[of] + nth // n_b[of]]) * width_b + b[b0[of] + nth % n_b[of]])
            times.append(np.ones(len(of), np.int64))
            for k in np.flatnonzero(links > WIDE).tolist():  # long stretches without a common end: by distinct ids
                (of_a, m), (of_b, n) = (np.unique(x, return_counts=True) for x in (a[a0[k] : a0[k] + n_a[k]], b[b0[k] : b0[k] + n_b[k]]))
                keys.append(((at[unit[k]] * width_a + of_a[:, None]) * width_b + of_b).ravel())
                times.append((m[:, None] * n).ravel())
        key, where = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(where, np.concatenate(times), len(key)).astype(np.int64)
        owner = key // (width_a * width_b)
        pair = (key // width_b % width_a) << 32 | key % width_b
        n_pairs = np.bincount(owner, minlength=len(units))
        return Units(text, sizes, np.cumsum(n_pairs) - n_pairs, n_pairs, pair, total)


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    """The tokenizers of this Python worker, whose cache lives from task to task."""
    return Aligner(path_a, path_b)


class Block(NamedTuple):
    """Aligned texts: a frame with a row for each, the block's distinct pairs, and the documents that link each."""

    docs: pd.DataFrame
    pairs: np.ndarray
    held: np.ndarray


def _spread(at: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of the stretches ``at``, one after the other."""
    n = size[at]
    return np.repeat(start[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def block(tool: Aligner, texts: list[str | None]) -> Block:
    numbers: dict[str, int] = {}
    codes = []
    for t in texts:
        own = _UNITS.findall(" " + t) if t else []
        codes.append(np.array([numbers.setdefault(u, len(numbers)) for u in own], np.int64))
    units = tool.units(list(numbers))
    strings, n_units = units.text, max(1, len(units.text))
    lost = np.array([x is None for x in strings], bool)
    codes = [c[:0] if lost[c].any() else c for c in codes]
    start, size, times = units.start, units.n_pairs, units.times
    pairs, code = np.unique(units.pairs, return_inverse=True)
    # (text, unit) with its times, then (text, pair) with its times
    doc = np.repeat(np.arange(len(texts)), [len(c) for c in codes])
    both, seen = np.unique(doc * n_units + np.concatenate([_NONE, *codes]), return_counts=True)
    doc, unit = both // n_units, both % n_units
    place = _spread(unit, start, size)
    link, at = np.unique(np.repeat(doc, size[unit]) * max(1, len(pairs)) + code[place], return_inverse=True)
    total = np.bincount(at, np.repeat(seen, size[unit]) * times[place], len(link)).astype(np.uint32)
    doc, pair = link // max(1, len(pairs)), (link % max(1, len(pairs))).astype(np.uint32)
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    sums = np.array([units.sizes[c].sum(0) for c in codes], np.int64).reshape(-1, 4)
    frame = pd.DataFrame(
        {
            **{name: sums[:, k] for k, name in enumerate(("n_a", "n_b", "n_groups", "n_links"))},
            "groups_sha256": [hashlib.sha256(";".join([strings[k] for k in c.tolist()]).encode()).hexdigest() if len(c) else "" for c in codes],
            "codes": [pair[a:b].tobytes() for a, b in zip(bounds, bounds[1:])],
            "times": [total[a:b].tobytes() for a, b in zip(bounds, bounds[1:])],
        }
    )
    held = np.bincount(pair, minlength=len(pairs))
    return Block(frame, pairs, held)


_DOC = "id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes binary, times binary"


def blocks(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str) -> DataFrame:
    """Rows of documents (``pairs`` is null) and one row of each block (``pairs``, ``held``)."""
    named = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool, number = aligner(path_a, path_b), TaskContext.get().partitionId() << 32
        for frame in frames:
            lengths = frame["text"].str.len().fillna(0).cumsum().to_numpy()
            at = 0
            while at < len(frame):
                before = lengths[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(lengths, before + CHARS_AT_ONCE, side="right")))
                part = frame.iloc[at:to]
                made = block(tool, part["text"].tolist())
                yield made.docs.assign(block=number, id=part["id"].to_numpy(), pairs=None, held=None)
                one = {"block": number, "pairs": [made.pairs], "held": [made.held]}
                yield pd.DataFrame(one | dict.fromkeys(("id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "times")))
                number, at = number + 1, to

    return named.mapInPandas(run, f"block long, {_DOC}, pairs array<long>, held array<long>")


def _priced(docs: DataFrame, valued: DataFrame) -> DataFrame:
    """Each document with ``n_best`` and ``count_sum``, block by block."""
    kept = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def price(own: pa.Table, known: pa.Table) -> pa.Table:
        code = known.column("code").to_numpy()
        count, best = np.zeros((2, int(code.max(initial=-1)) + 1), np.int64)
        count[code], best[code] = known.column("count").to_numpy(), known.column("best").to_numpy().astype(np.int64)
        n_best, total = [], []
        for codes, times in zip(own.column("codes"), own.column("times")):
            of, n = (np.frombuffer(x.as_buffer(), np.uint32) for x in (codes, times))
            n = n.astype(np.int64)
            n_best.append(int((best[of] * n).sum()))
            total.append(int((count[of] * n).sum()))
        return own.select(kept).append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(total, pa.int64()))

    out = "id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return docs.groupBy("block").cogroup(valued.groupBy("of_block")).applyInArrow(price, out)


def pair_counts(made: DataFrame) -> DataFrame:
    """pair, its ``count`` of documents and ``best``, whether no pair of the same first id has more."""
    each = made.filter("pairs IS NOT NULL").select(F.explode(F.arrays_zip("pairs", "held")).alias("p"))
    counts = each.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.held").alias("count")).withColumn("a", F.shiftright("pair", 32))
    counts = keep(counts, "pair_counts")
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    return counts.join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256."""
    made = keep(blocks(docs, path_a, path_b, id_col, text_col), "aligned")
    each = made.filter("pairs IS NOT NULL").select("block", F.posexplode("pairs").alias("code", "pair"))
    valued = each.join(pair_counts(made), "pair").select(F.col("block").alias("of_block"), "code", "count", "best")
    found = _priced(made.filter("pairs IS NULL").drop("pairs", "held"), valued)
    id_type = docs.select(id_col).schema[0].dataType
    return found.select(F.col("id").cast(id_type).alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
