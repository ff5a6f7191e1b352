"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A text is its lower-cased words and an end, the empty word. A word is coded in
steps: a row of binary decisions down a Huffman tree to its leaf, and its share
of that leaf. A leaf is one of the most frequent words, or a class of words of
the head of the training vocabulary, or the escape to all other words; classes
come from what the documents of a word have in common (sums of random vectors
of their words). After the escape a word has its share of the known words, or
is new and spelled, letter by letter, by decisions of the same kind.

Each decision is predicted from several contexts hashed with the tree node: the
kind of text so far, the last two leaves, the last word. Training counts the
outcomes of every context over all training texts; nothing is learnt from a part
of them. The first weights are fixed (``START``). Scoring mixes the predictions in the logistic domain by weights that a gate
picks by how often the hashed contexts were seen, then averages with an
adaptive table of what such predictions came to. Both start alike for every
text and are refined after each block of its words, so a text's score depends
on nothing but what was gathered.

What is gathered grows with the input: the vocabulary with its counts, a
distributed table that texts meet by a join, and the slots of context tables,
which follow the number of training tokens up to ``1 << MOST_BITS``. What a
worker holds is bounded by parameters: the ``HEAD`` most frequent words and
those tables. As the head holds all frequent words, no word of the join is hot.
A text longer than ``CHARS_AT_ONCE`` is scored piece by piece, its state
carried on.

Defined cases: null text counts as empty, which is the end alone; a null id
counts as the empty text in the split; without training texts nothing is known
and all words are spelled; rows that repeat are scored (and, if they train,
counted) as often as they occur; ties of frequency go to the smaller word; an
empty table gives an empty table; other columns of the input are not read.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.scratch import keep

FOLDS, HELD_OUT = 7, 2
HEAD = 1 << 18
LEAST_SEEN = 2
LEAF_WORDS, CLASSES, KINDS = 64, 64, 8
DIMS = 4
LEAST_BITS, MOST_BITS = 16, 22
LETTER_BITS = 20
SLOTS_PER_ROW = 1 << 14
BLOCK = 64
WORDS_AT_ONCE = 25_000
CHARS_AT_ONCE = 1 << 20
GATES, BUCKETS, PRIOR = 16, 24, 30.0
#: First weights of a decision's contexts, fixed and refined in each text, and those of letters by how often five letters were seen.
START = (0.6, 0.4, 0.35)
LETTERS = np.array([[0.2, 0.8, 0.0], [0.1, 0.6, 0.4], [0.1, 0.4, 0.7], [0.0, 0.2, 0.9]], np.float32)
LN10 = math.log(10)
U = np.uint64


def split_column(doc_id) -> F.Column:
    """Whether a document is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


# -- words


@dataclass
class Piece:
    """Texts, or a piece of one long text, as word codes: ends are words of the empty string."""

    words: pa.Array  # distinct words
    codes: np.ndarray
    sizes: np.ndarray  # words of each text, its end counted
    rows: list[int]  # places of the texts in their batch
    first: bool = True
    last: bool = True


def _cut(text: str) -> Iterator[str]:
    """Pieces of a text, cut at white space."""
    at = 0
    while len(text) - at > CHARS_AT_ONCE:
        to = at + CHARS_AT_ONCE
        while to < len(text) and text[to] not in " \t\n\x0b\x0c\r":
            to += 1
        yield text[at:to]
        at = to
    yield text[at:]


def _coded(texts: list[str], rows: list[int], first: bool = True, last: bool = True) -> Piece:
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.large_string())))
    found = lists.flatten().dictionary_encode()
    words, codes = found.dictionary, found.indices.to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    blank = pc.index(words, pa.scalar("", words.type)).as_py()  # what stands before leading white space
    if blank >= 0:
        inside = codes != blank
        codes, owner = codes[inside], owner[inside]
    else:
        words, blank = pa.concat_arrays([words, pa.array([""], words.type)]), len(words)
    sizes = np.bincount(owner, minlength=len(texts))
    if last:
        whole = np.full(len(codes) + len(texts), blank, np.int64)
        whole[np.arange(len(codes)) + owner] = codes
        codes, sizes = whole, sizes + 1
    return Piece(words, codes, sizes, rows, first, last)


def coded(texts: list[str | None], times: int = 1) -> Iterator[Piece]:
    """All texts of a batch, in pieces of bounded size (``times`` as large where many texts share a piece)."""
    part, rows, size = [], [], 0
    for k, t in enumerate(texts):
        t = t or ""
        if part and size + len(t) > times * CHARS_AT_ONCE:
            yield _coded(part, rows)
            part, rows, size = [], [], 0
        if len(t) > CHARS_AT_ONCE:
            cuts = list(_cut(t))
            for n, c in enumerate(cuts):
                yield _coded([c], [k], n == 0, n == len(cuts) - 1)
        else:
            part.append(t)
            rows.append(k)
            size += len(t)
    if part:
        yield _coded(part, rows)


def _mix(key: np.ndarray) -> np.ndarray:
    key = (key ^ (key >> U(29))) * U(0xBF58476D1CE4E5B9)
    key = (key ^ (key >> U(32))) * U(0x94D049BB133111EB)
    return key ^ (key >> U(31))


def _plain(values: pa.Array) -> list[str]:
    """As ``to_pylist``, in an eighth of its time."""
    return values.to_numpy(zero_copy_only=False).tolist()


def _word_keys(words: list[str]) -> np.ndarray:
    return _mix(np.fromiter(map(zlib.crc32, map(str.encode, words)), U, len(words)) + U(1))


# -- vocabulary

SUMS = [f"s{k}" for k in range(DIMS)]


def vocabulary(train: DataFrame) -> DataFrame:
    """word, c (its count over all training texts) and the sums of its texts' vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in coded(batch.column("text").to_pylist(), 4):
                keys = _word_keys(_plain(p.words))
                text = np.repeat(np.arange(len(p.sizes)), p.sizes)
                columns = [np.bincount(p.codes, minlength=len(keys))]
                drawn = [((keys >> U(8 * k)) & U(0xFF)).astype(np.int64) * 2 - 255 for k in range(DIMS)]
                sums = np.stack([np.bincount(text, d[p.codes], len(p.sizes)) for d in drawn])
                unit = np.round(127 * sums / np.maximum(1, np.sqrt((sums * sums).sum(0))))
                columns += [np.bincount(p.codes, u[text], len(keys)).astype(np.int64) for u in unit]
                seen = np.flatnonzero(columns[0])
                yield pa.RecordBatch.from_arrays(
                    [p.words.take(pa.array(seen)).cast(pa.string()), *(pa.array(c[seen], pa.int64()) for c in columns)], names=["word", "c", *SUMS]
                )

    schema = "word string, c long, " + ", ".join(f"{s} long" for s in SUMS)
    return train.select("text").mapInArrow(run, schema).groupBy("word").agg(*[F.sum(c).alias(c) for c in ["c", *SUMS]])


class Tree:
    """A Huffman code: of each symbol the nodes and sides from its leaf to the root, one after another."""

    def __init__(self, counts: np.ndarray):
        n = len(counts)
        parent, side = np.zeros(2 * n, np.int64), np.zeros(2 * n, np.int8)
        heap = [(int(c), k) for k, c in enumerate(counts)]
        heapq.heapify(heap)
        top = n
        while len(heap) > 1:
            (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
            parent[x] = parent[y] = top
            side[y] = 1
            heapq.heappush(heap, (a + b, top))
            top += 1
        nodes, bits = [], []
        self.depth = np.zeros(n, np.int64)
        for leaf in range(n):
            at = leaf
            while at != top - 1:
                nodes.append(parent[at] - n)
                bits.append(side[at])
                self.depth[leaf] += 1
                at = parent[at]
        self.start = np.cumsum(self.depth) - self.depth
        self.nodes, self.bits = np.array(nodes, np.int64), np.array(bits, np.int8)

    def steps(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each decision: which symbol it belongs to, its node and its outcome."""
        depth = self.depth[symbols]
        owner = np.repeat(np.arange(len(symbols)), depth)
        place = np.arange(len(owner)) + np.repeat(self.start[symbols] - (np.cumsum(depth) - depth), depth)
        return owner, self.nodes.take(place), self.bits.take(place)


def _grouped(points: np.ndarray, weights: np.ndarray, groups: int, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """k-means from points spread evenly over their order: each point's group, and the centres."""
    centres = points[np.linspace(0, len(points) - 1, min(groups, len(points))).astype(int)].copy()
    for _ in range(rounds):
        group = np.argmin((centres**2).sum(1) - 2 * points @ centres.T, axis=1)
        total = np.bincount(group, weights, len(centres))
        for k in range(points.shape[1]):
            sums = np.bincount(group, weights * points[:, k], len(centres))
            centres[:, k] = np.where(total > 0, sums / np.maximum(total, 1e-9), centres[:, k])
    return group, centres


class Lexicon:
    """The head of the vocabulary, most frequent first, and what the driver derives from it."""

    def __init__(self, head: pa.Array, counts: np.ndarray, sums: np.ndarray, total: int, distinct: int, single: int, double: int):
        self.head, self.counts = head, counts
        self.tokens, self.scale = total, math.log10(total + distinct + 1)
        self.bits = min(MOST_BITS, max(LEAST_BITS, (total // 8).bit_length()))
        rest, rest_words = total - int(counts.sum()), distinct - len(counts)
        self.discount = (single + 1) / (single + 2 * double + 2)  # of a count, given to words not seen
        new = max(0.5, self.discount * rest_words)
        self.rest_mass = rest + new
        self.new_share = math.log10(new / self.rest_mass)
        mean = sums / np.maximum(1, counts)[:, None]
        frequent = min(LEAF_WORDS, len(counts))
        classes = np.arange(len(counts), dtype=np.int64)
        size = frequent
        if len(counts) > frequent:
            group, _ = _grouped(mean[frequent:], np.sqrt(counts[frequent:]), CLASSES)
            _, group = np.unique(group, return_inverse=True)
            classes[frequent:] = frequent + group
            size += int(group.max()) + 1
        self.escape = size
        self.leaf = np.concatenate([classes, [size]])
        mass = np.bincount(self.leaf, np.concatenate([counts, [max(1, rest)]]), size + 1)
        self.share = np.concatenate([np.log(counts / mass[classes]), [0.0]])
        self.tree = Tree(mass.astype(np.int64))
        self.nodes = max(1, size)
        lean = np.zeros((size + 1, DIMS))
        for k in range(DIMS if len(counts) else 0):
            lean[:-1, k] = np.bincount(classes, sums[:, k], size) / mass[:-1]
        self.lean = np.round(lean * 16).astype(np.int64)
        if len(counts):
            known = self.lean[:-1] / np.maximum(1, np.sqrt((self.lean[:-1] ** 2).sum(1)))[:, None]
            _, kinds = _grouped(known, mass[:-1], KINDS)
        else:
            kinds = np.zeros((1, DIMS))
        self.kinds = kinds / np.maximum(1e-9, np.sqrt((kinds**2).sum(1)))[:, None]
        self.base = np.concatenate([np.log10(counts + 1.0) - self.scale, [0.0]])

    @property
    def slots(self) -> tuple[int, ...]:
        return (3 * KINDS + 1) * self.nodes, 1 << self.bits, 1 << self.bits

    @cached_property
    def places(self) -> dict[str, int]:
        """The place of each word of the head, made once a worker."""
        return {w: k for k, w in enumerate(_plain(self.head))}

    def numbers(self, words: pa.Array) -> np.ndarray:
        """The place in the head of each word, or the head's length."""
        return np.fromiter(map(self.places.get, _plain(words), repeat(len(self.head))), np.int64, len(words))


@dataclass
class Past:
    """What a long text's next piece needs to know."""

    words: int = 0
    leaves: tuple[int, int] = (0, 0)
    word: int = 0
    lean: np.ndarray = field(default_factory=lambda: np.zeros(DIMS, np.int64))


class Steps:
    """The words of a piece with their contexts, from which decisions are made."""

    def __init__(self, lex: Lexicon, piece: Piece, numbers: np.ndarray, keys: np.ndarray, past: Past):
        number = numbers[piece.codes]
        self.leaf = lex.leaf[number]
        self.sizes = piece.sizes
        start = np.cumsum(piece.sizes) - piece.sizes
        nth = np.arange(len(number)) - np.repeat(start, piece.sizes) + past.words
        key = keys[piece.codes]
        one = np.concatenate([[past.leaves[0]], self.leaf[:-1] + 1])
        one[nth == 0] = 0
        two = np.concatenate([[past.leaves[1]], one[:-1]])
        two[nth == 0] = 0
        word = np.concatenate([[U(past.word)], key[:-1]])
        word[nth == 0] = 0
        lean = np.cumsum(lex.lean[self.leaf], axis=0)
        before = np.concatenate([np.zeros((1, DIMS), np.int64), lean[:-1]])
        before = before - np.repeat(before[start[piece.sizes > 0]], piece.sizes[piece.sizes > 0], axis=0) + past.lean
        kind = np.argmax(before @ lex.kinds.T, axis=1)
        age = (nth > 3).astype(np.int64) + (nth > 15)
        self.state = np.where(nth > 0, 1 + 3 * kind + age, 0)
        two_leaves = one * (len(lex.tree.depth) + 1) + two
        self.a = _mix(two_leaves.astype(U) + U(0x51ED2701))
        self.b = _mix(word + kind.astype(U) * U(0x9E3779B97F4A7C15) + U(0x3C6EF372))
        self.nth = nth
        if len(number):
            self.past = Past(int(nth[-1]) + 1, (int(self.leaf[-1]) + 1, int(one[-1])), int(key[-1]), before[-1] + lex.lean[self.leaf[-1]])
        else:
            self.past = past

    def decisions(self, lex: Lexicon, chosen) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Of the words at ``chosen``: each decision's word (a place in ``chosen``), outcome and slots."""
        owner, node, bit = lex.tree.steps(self.leaf[chosen])
        key = node.astype(U) * U(0xD6E8FEB86659FD93)
        down = U(64 - lex.bits)
        hashed = [((of[chosen].take(owner) ^ key) * U(by)) >> down for of, by in ((self.a, 0x94D049BB133111EB), (self.b, 0xBF58476D1CE4E5B9))]
        return owner, bit, [(self.state[chosen] * lex.nodes).take(owner) + node, *(h.view(np.int64) for h in hashed)]


class Speller:
    """Decisions of letters, each predicted from one, three and five earlier ones."""

    bits = LETTER_BITS

    def __init__(self):
        self.tree = Tree(np.where(np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyz ")), 50, 1))
        self.slots = (1 << 16, 1 << self.bits, 1 << self.bits)

    def decisions(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Of all letters of the words and a space behind each: word, outcome and slots."""
        raw = np.frombuffer("".join(f"{w} " for w in words).encode(), np.uint8)
        sizes = np.fromiter((len(w.encode()) + 1 for w in words), np.int64, len(words))
        owner = np.repeat(np.arange(len(words)), sizes)
        inside = np.arange(len(raw)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        letters = raw.astype(U) + U(1)
        b = [np.where(inside >= k, np.concatenate([np.zeros(k, U), letters])[: len(raw)], U(0)) for k in range(1, 6)]
        three = _mix(b[0] + (b[1] << U(9)) + (b[2] << U(18)))
        five = _mix(three + b[3] + (b[4] << U(9)) + U(77))
        step, node, bit = self.tree.steps(raw.astype(np.int64))
        key, down = node.astype(U) * U(0xD6E8FEB86659FD93), U(64 - self.bits)
        hashed = [(((x[step] ^ key) * U(0x94D049BB133111EB)) >> down).astype(np.int64) for x in (three, five)]
        return owner[step], bit, [(b[0].astype(np.int64)[step] & 0xFF) << 8 | node, *hashed]


# -- counts


def packed(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    """A context's prediction in the logistic domain, and in the last two bits how often it was seen."""
    seen = np.digitize(zero + one, [1, 8, 64])
    stretch = np.log((one + 0.4) / (zero + 0.4))
    return ((np.clip(np.round(stretch * 512), -8191, 8191).astype(np.int64) << 2) | seen).astype(np.int16)


def context_tables(rows: DataFrame, slots: tuple[int, ...], decisions: Callable[[list], Iterator[tuple[np.ndarray, list[np.ndarray]]]], name: str) -> list[np.ndarray]:
    """Packed predictions by slot; ``decisions`` gives outcomes and slots of the values of ``rows``' only column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.zeros(2 * n, np.uint32) for n in slots]
        for batch in batches:
            for bit, places in decisions(_plain(batch.column(0))):
                for table, slot in zip(tables, places, strict=True):
                    np.add.at(table, 2 * slot + bit, np.uint32(1))
        for k, table in enumerate(tables):
            found = []
            for c in range(0, len(table), 2 * SLOTS_PER_ROW):
                at = np.flatnonzero(table[c : c + 2 * SLOTS_PER_ROW])
                if len(at):
                    found.append((k, c, at.astype(np.uint16).tobytes(), table[c + at].tobytes()))
            if found:
                nth, slot, at, n = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nth, pa.int32()), pa.array(slot, pa.int64()), pa.array(at, pa.binary()), pa.array(n, pa.binary())], names=["nth", "slot", "at", "n"]
                )

    def add(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * SLOTS_PER_ROW, np.float64)
        for batch in group:
            for at, n in zip(batch.column("at"), batch.column("n")):
                total[np.frombuffer(at.as_py(), np.uint16)] += np.frombuffer(n.as_py(), np.uint32)
            head = batch.slice(0, 1)
        values = pa.array([packed(total[0::2], total[1::2]).tobytes()], pa.binary())
        yield pa.RecordBatch.from_arrays([head.column("nth"), head.column("slot"), values], names=["nth", "slot", "packed"])

    touched = rows.mapInArrow(run, "nth int, slot long, at binary, n binary")
    summed = touched.groupBy("nth", "slot").applyInArrow(add, "nth int, slot long, packed binary")
    tables = [np.full(n, packed(np.zeros(1), np.zeros(1))[0], np.int16) for n in slots]
    for r in keep(summed, name).toLocalIterator():  # two bytes a slot
        at, values = r["slot"] // 2, np.frombuffer(r["packed"], np.int16)
        room = min(len(values), slots[r["nth"]] - at)
        tables[r["nth"]][at : at + room] = values[:room]
    return tables


# -- mixing


def _inputs(tables: list[np.ndarray], slots: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Each context's prediction, and how often the hashed ones (all but the first) were seen."""
    found = [t.take(s) for t, s in zip(tables, slots, strict=True)]
    return [(f >> 2) * np.float32(1 / 512) for f in found], [f & 3 for f in found[1:]]


class Weights:
    """Weights of each gate and the adaptive table of each text, refined as texts go by."""

    def __init__(self, weights: np.ndarray | None = None, came: np.ndarray | None = None):
        self.weights = np.tile(np.array(START, np.float32)[:, None], (1, GATES)) if weights is None else weights
        self.came = 1 / (1 + np.exp(-(np.arange(BUCKETS) - BUCKETS / 2 + 0.5))) if came is None else came

    def spread(self, texts: int) -> None:
        """Room for texts of their own."""
        self.w = np.tile(self.weights, (1, texts))
        self.ones, self.both = np.tile(self.came * PRIOR, texts), np.full(texts * BUCKETS, PRIOR)

    def block(self, text: np.ndarray, bit: np.ndarray, inputs: list[np.ndarray], seen: list[np.ndarray], rate: float = 0.3) -> np.ndarray:
        """The natural log probability of each decision; then learn from them."""
        row = text * GATES + (seen[0] << 2 | seen[1])
        mixed = sum(w.take(row) * x for w, x in zip(self.w, inputs))
        np.clip(mixed, -11, 11, out=mixed)
        p = 1 / (1 + np.exp(-mixed))
        cell = text * BUCKETS + (mixed + np.float32(BUCKETS / 2)).astype(np.int64)  # from 1 to BUCKETS - 1
        final = np.float32(0.7) * p + (np.float32(0.3) * (self.ones / self.both).astype(np.float32)).take(cell)
        y = bit > 0
        error, weight = y - p, p * (1 - p)
        for w, x in zip(self.w, inputs):  # a damped Newton step of each weight
            pull = weight * x
            w += (rate * np.bincount(row, error * x, len(w)) / (np.bincount(row, pull * x, len(w)) + 40)).astype(np.float32)
        zero, one = np.bincount(2 * cell + bit, minlength=2 * len(self.ones)).reshape(-1, 2).T
        self.ones += one
        self.both += zero + one
        return np.log(np.where(y, final, 1 - final))


def _runs(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Texts of like length, bounded in words together; a longer text stands alone."""
    group, size = [], 0
    for k in np.argsort(sizes, kind="stable").tolist():
        if group and size + sizes[k] > WORDS_AT_ONCE:
            yield np.array(group)
            group, size = [], 0
        group.append(k)
        size += int(sizes[k])
    if group:
        yield np.array(group)


class Scorer:
    """Scores the pieces of a task's texts, in order."""

    def __init__(self, lex: Lexicon, tables: list[np.ndarray], weights: Weights):
        self.lex, self.tables, self.weights = lex, tables, weights
        self.past = Past()

    def score(self, piece: Piece, numbers: np.ndarray) -> np.ndarray:
        """Natural log probability of each text of the piece, but for what follows an escape."""
        lex = self.lex
        if piece.first:
            self.past = Past()
        steps = Steps(lex, piece, numbers, _word_keys(_plain(piece.words)), self.past)
        total = np.bincount(np.repeat(np.arange(len(piece.sizes)), piece.sizes), lex.share[numbers[piece.codes]], len(piece.sizes))
        start = np.cumsum(piece.sizes) - piece.sizes
        for group in _runs(piece.sizes):
            n = piece.sizes[group]
            place = np.arange(int(n.sum())) + np.repeat(start[group] - (np.cumsum(n) - n), n)
            text = np.repeat(np.arange(len(group)), n)
            if piece.first:
                self.weights.spread(len(group))
            order = np.argsort(steps.nth[place] // BLOCK, kind="stable")
            place, text = place[order], text[order]
            block = steps.nth[place] // BLOCK
            bounds = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            for a, b in zip(bounds, bounds[1:]):
                owner, bit, slots = steps.decisions(lex, place[a:b])
                inputs, seen = _inputs(self.tables, slots)
                of = text[a:b][owner]
                total[group] += np.bincount(of, self.weights.block(of, bit, inputs, seen), len(group))
        self.past = steps.past
        return total


def spelled(tool: Speller, tables: list[np.ndarray], words: list[str]) -> np.ndarray:
    """Natural log probability of each word's letters."""
    out = np.zeros(len(words))
    for at in range(0, len(words), 4096):
        owner, bit, slots = tool.decisions(words[at : at + 4096])
        inputs, seen = _inputs(tables, slots)
        w = LETTERS[seen[1]]
        mixed = np.clip(sum(w[:, k] * x for k, x in enumerate(inputs)), -11, 11)
        out[at : at + 4096] = np.bincount(owner, -np.log1p(np.exp(np.where(bit > 0, -mixed, mixed))), min(4096, len(words) - at))
    return out


# -- scores


ROWS = "row long, doc_id {}, held_out boolean, n_bytes long, n_tokens long, n_known long, base_score double, score double, rest array<struct<word:string,times:long>>"
_REST = pa.list_(pa.struct([("word", pa.string()), ("times", pa.int64())]))


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), split_column(F.col(id_col)).alias("held_out"))
    sc = docs.sparkSession.sparkContext
    train = named.filter("NOT held_out")
    counted = keep(vocabulary(train), "vocabulary")
    n, v, single, double = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    top = counted.filter(F.col("c") >= LEAST_SEEN).orderBy(F.desc("c"), "word").limit(HEAD).toArrow().combine_chunks()  # HEAD rows at most
    column = lambda c: top.column(c).combine_chunks() if top.num_rows else pa.array([], top.schema.field(c).type)
    sums = np.stack([column(s).to_numpy() for s in SUMS], axis=1).astype(np.float64).reshape(-1, DIMS)
    lex = sc.broadcast(Lexicon(column("word"), column("c").to_numpy().astype(np.int64), sums, n, v, single, double))

    def of_texts(values: list) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
        past = Past()
        for piece in coded(values):
            steps = Steps(lex.value, piece, lex.value.numbers(piece.words), _word_keys(_plain(piece.words)), Past() if piece.first else past)
            past = steps.past
            for a in range(0, len(piece.codes), WORDS_AT_ONCE):
                _, bit, slots = steps.decisions(lex.value, np.arange(a, min(a + WORDS_AT_ONCE, len(piece.codes))))
                yield bit, slots

    speller = Speller()

    def of_words(values: list) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
        for a in range(0, len(values), 4096):
            _, bit, slots = speller.decisions(values[a : a + 4096])
            yield bit, slots

    tables = sc.broadcast(context_tables(train.select("text"), lex.value.slots, of_texts, "contexts"))
    letters = sc.broadcast(context_tables(counted.filter("c = 1").select("word"), speller.slots, of_words, "letters"))
    id_type = named.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = lex.value
        scorer = Scorer(tool, tables.value, Weights())
        none, row = len(tool.head), TaskContext.get().partitionId() << 40
        for batch in batches:
            size = batch.num_rows
            score, base = np.zeros(size), np.zeros(size)
            tokens, known = np.zeros(size, np.int64), np.zeros(size, np.int64)
            of, rest, times = [], [], []
            for piece in coded(batch.column("text").to_pylist()):
                rows = np.array(piece.rows)
                numbers = tool.numbers(piece.words)
                score[rows] += scorer.score(piece, numbers)
                text = np.repeat(np.arange(len(rows)), piece.sizes)
                number = numbers[piece.codes]
                base[rows] += np.bincount(text, tool.base[number], len(rows))
                tokens[rows] += piece.sizes
                known[rows] += np.bincount(text, number < none, len(rows)).astype(np.int64)
                beyond = number == none
                both, count = np.unique(text[beyond] * len(piece.words) + piece.codes[beyond], return_counts=True)
                of.append(rows[both // len(piece.words)])
                rest.append(piece.words.take(pa.array(both % len(piece.words))).cast(pa.string()))
                times.append(count)
            offsets = np.searchsorted(np.concatenate(of), np.arange(size + 1)) if of else np.zeros(size + 1, np.int64)
            pairs = pa.StructArray.from_arrays(
                [pa.concat_arrays(rest) if rest else pa.array([], pa.string()), pa.array(np.concatenate(times) if times else [], pa.int64())], names=["word", "times"]
            )
            arrays = [
                pa.array(np.arange(row, row + size), pa.int64()), batch.column("doc_id"), batch.column("held_out"),
                pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64()), pa.array(tokens), pa.array(known), pa.array(base), pa.array(score / LN10),
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs),
            ]
            row += size
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "doc_id", "held_out", "n_bytes", "n_tokens", "n_known", "base_score", "score", "rest"])

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of words beyond the head: what they add to known words, base and score."""
        tool = lex.value
        for batch in batches:
            found = pc.fill_null(batch.column("c"), 0).to_numpy()
            times = batch.column("times").to_numpy()
            new = np.flatnonzero(found == 0)
            own = np.log10(np.maximum(found - tool.discount, 1e-3) / tool.rest_mass)
            words = batch.column("word").take(pa.array(new)).dictionary_encode()
            letter = spelled(speller, letters.value, _plain(words.dictionary)) / LN10
            own[new] = tool.new_share + letter[words.indices.to_numpy()]
            base = np.log10(found + 1.0) - tool.scale
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(np.where(found > 0, times, 0)), pa.array(times * base), pa.array(times * own)], names=["row", "known", "base", "own"]
            )

    rows = keep(named.mapInArrow(run, ROWS.format(id_type)), "scores")
    rest = rows.select("row", F.explode("rest").alias("r")).select("row", "r.word", "r.times")
    each = rest.join(counted.select(F.col("word").alias("w"), "c"), F.col("word") == F.col("w"), "left").select("row", "word", "times", "c")
    priced = each.mapInArrow(price, "row long, known long, base double, own double")
    sums = priced.groupBy("row").agg(*[F.sum(c).alias(c) for c in ("known", "base", "own")])
    score = F.col("score") + F.coalesce("own", F.lit(0.0))
    bits = F.when(F.col("n_bytes") > 0, -score * F.lit(math.log2(10)) / F.col("n_bytes"))
    return rows.drop("rest").join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), (F.col("base_score") + F.coalesce("base", F.lit(0.0))).alias("base_score"),
        score.alias("score"), bits.alias("bits_per_byte"),
    )
