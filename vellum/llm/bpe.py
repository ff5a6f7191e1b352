"""BPE encoding and decoding with a public word-end tokenizer.

Text is cut at ASCII white space, across which this tokenizer never merges, so
each distinct run of other characters of a batch is encoded once, and words are
remembered by the worker.
A run without a cut that is longer than ``LONG_RUN`` bytes goes the long way:
its pre-tokens are halved down to leaves, the leaves are encoded apart (as
separate rows in :func:`encode`), and neighbours are concatenated in a tree,
re-encoding a window around each join that doubles until its first token is the
left side's and its last token the right side's. A token sequence is the
encoding of its text as soon as each adjacent pair is, so agreement at both
edges makes the concatenation exact.

Defined cases: null text counts as empty; an empty text has no ids and decodes
to the empty text; rows that repeat give equal results, one for each row; an
empty table gives an empty table; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vellum.llm.scratch import HELD, keep

LONG_RUN = 4096
LEAF = 1024
CACHE_WORDS = 250_000
CACHED_BYTES = 64
CHARS_AT_ONCE = 1 << 23
RUNS_AT_ONCE = 1 << 18

#: Letters of Latin-1, then marks of ASCII: at most two pre-tokens, whatever the letters' case.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _slices(texts: list[str | None]) -> Iterator[list[str]]:
    """The texts in order, bounded in characters together; null is empty."""
    part, size = [], 0
    for t in texts:
        t = t or ""
        if part and size + len(t) > CHARS_AT_ONCE:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


class WordBpe:
    """One tokenizer file with a bounded cache of encoded runs."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        config["truncation"] = config["padding"] = None
        self.tokenizer = Tokenizer.from_str(json.dumps(config))
        self.words: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.tokens = [(self.tokenizer.id_to_token(i) or "").encode() for i in range(size)]
        self.suffix = config["model"]["end_of_word_suffix"]
        self.ends_word = np.array([t.endswith(self.suffix.encode()) for t in self.tokens])
        self.marks = [t["content"].encode() for t in config["added_tokens"]]
        bare = {"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None}
        bare |= {"pre_tokenizer": None, "post_processor": None, "decoder": None}
        self.inner = Tokenizer.from_str(json.dumps(bare | {"model": config["model"] | {"end_of_word_suffix": None}}))
        self.last = Tokenizer.from_str(json.dumps(bare | {"model": config["model"]}))

    # -- ordinary runs

    def _encode_new(self, runs: list[str]) -> Iterator[bytes]:
        for e in self.tokenizer.encode_batch_fast(runs, add_special_tokens=False):
            yield np.asarray(e.ids, dtype="<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        """Encode words that are one pre-token each, many to a call: a word ends with a token that ends words."""
        for k in range(0, len(words), 512):
            part = words[k : k + 512]
            (e,) = self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)
            ids = np.array(e.ids, dtype="<u4")
            ends = (np.flatnonzero(self.ends_word[ids]) + 1).tolist()
            raw = ids.tobytes()
            self.words.update(zip(part, (raw[4 * a : 4 * b] for a, b in zip([0, *ends], ends)), strict=True))

    def _known(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words; what two fillings of the cache have not used is forgotten."""
        if len(self.words) > CACHE_WORDS:
            self.before, self.words = self.words, {}
        now, before = self.words, self.before
        new = []
        for w in words:
            if w not in now:
                if w in before:
                    now[w] = before[w]
                elif w:
                    new.append(w)
        self._learn(new)
        return [now[w] if w else b"" for w in words]

    def _of_runs(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of distinct runs: the ids of all units, the units' starts and sizes, and each run's two units.

        Most runs are letters and then marks, which are two pre-tokens at most; those are
        encoded by word, so that capitals and marks cost nothing anew. Others are units of
        their own, and long ones go the long way.
        """
        stem = pc.ascii_rtrim(runs, characters=_MARKS)
        plain = pc.and_(pc.match_substring_regex(stem, f"^[{_LETTERS}]*$"), pc.less_equal(pc.binary_length(runs), CACHED_BYTES))
        words = pc.utf8_lower(stem.filter(plain)).dictionary_encode()
        marks = pc.replace_substring_regex(runs.filter(plain), f"^[{_LETTERS}]*", "").dictionary_encode()
        other = runs.filter(pc.invert(plain)).to_pylist()
        short = [r for r in other if len(r.encode()) <= LONG_RUN]
        apart = dict(zip(short, self._encode_new(short), strict=True))
        units = [b"", *self._known(words.dictionary.to_pylist()), *self._known(marks.dictionary.to_pylist())]
        beyond = len(units)
        units += [apart[r] if r in apart else self.tree(r.encode()) for r in other]
        is_plain = plain.to_numpy(zero_copy_only=False)
        first, second = np.zeros(len(runs), np.int64), np.zeros(len(runs), np.int64)
        first[is_plain] = words.indices.to_numpy() + 1
        second[is_plain] = marks.indices.to_numpy() + 1 + len(words.dictionary)
        first[~is_plain] = np.arange(len(other)) + beyond
        sizes = np.fromiter(map(len, units), np.int64, len(units)) // 4
        return np.frombuffer(b"".join(units), "<u4"), np.cumsum(sizes) - sizes, sizes, first, second

    def ids_of_batch(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        for part in _slices(texts):
            lists = pc.ascii_split_whitespace(pa.array(part, pa.large_string()))
            bounds = lists.offsets.to_numpy()
            runs = lists.flatten().dictionary_encode()
            if not len(runs):
                yield from (b"" for _ in part)
                continue
            ids, start, size, first, second = self._of_runs(runs.dictionary)
            code = runs.indices.to_numpy()
            ends = np.concatenate([[0], np.cumsum((size[first] + size[second])[code])])[bounds - bounds[0]]
            at = 0
            while at < len(part):  # as many texts at once as have RUNS_AT_ONCE runs, one at least
                to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + RUNS_AT_ONCE, side="right")) - 1)
                here = code[bounds[at] - bounds[0] : bounds[to] - bounds[0]]
                unit = np.stack([first[here], second[here]], axis=1).ravel()
                n = size[unit]
                place = np.repeat(start[unit] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                raw = ids[place].tobytes()
                for k in range(at, to):
                    yield raw[4 * int(ends[k] - ends[at]) : 4 * int(ends[k + 1] - ends[at])]
                at = to

    def decode(self, ids: bytes) -> bytes:
        """As the library decodes, special tokens included: tokens joined by a space."""
        return b" ".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))

    # -- long runs

    def pre_tokens(self, run: bytes) -> list[str]:
        """The pre-tokens of a run, in the tokenizer's byte letters."""
        text = self.tokenizer.normalizer.normalize_str(run.decode())
        return [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def leaf(self, piece: str, ends: bool) -> np.ndarray:
        """The encoding of a piece of a pre-token; ``ends``: it is the pre-token's last."""
        model = self.last if ends else self.inner
        return np.asarray(model.encode(piece, add_special_tokens=False).ids, dtype="<u4")

    def letters(self, ids: np.ndarray) -> str:
        text = "".join(self.tokens[i].decode() for i in ids.tolist())
        return text.removesuffix(self.suffix)

    def join(self, left: np.ndarray, right: np.ndarray, ends: bool) -> np.ndarray:
        """The encoding of two neighbouring pieces from their own encodings."""
        if not len(left) or not len(right):
            return np.concatenate([left, right])
        reach = 2
        while True:
            a, b = max(0, len(left) - reach), min(len(right), reach)
            whole_left, whole_right = a == 0, b == len(right)
            window = self.leaf(self.letters(left[a:]) + self.letters(right[:b]), ends and whole_right)
            agrees = len(window) > 1 and (whole_left or window[0] == left[a]) and (whole_right or window[-1] == right[b - 1])
            if agrees or (whole_left and whole_right):
                return np.concatenate([left[:a], window, right[b:]])
            reach *= 2

    def concatenate(self, parts: list[np.ndarray]) -> np.ndarray:
        """Join the leaves of one pre-token, in order, as a balanced tree."""
        level = list(parts)
        while len(level) > 1:
            pairs = range(0, len(level) - 1, 2)
            last = len(level) - 2 if len(level) % 2 == 0 else None
            joined = [self.join(level[i], level[i + 1], i == last) for i in pairs]
            level = joined + level[2 * len(joined) :]
        return level[0] if level else np.empty(0, dtype="<u4")

    def leaves(self, run: bytes) -> list[tuple[int, str, bool]]:
        """(pre-token number, piece, whether it ends the pre-token) of a long run."""
        out = []
        for n, token in enumerate(self.pre_tokens(run)):
            cuts = range(0, len(token), LEAF)
            out += [(n, token[c : c + LEAF], c + LEAF >= len(token)) for c in cuts]
        return out

    def tree(self, run: bytes) -> bytes:
        """A long run within one task."""
        if any(m in run for m in self.marks):
            return next(self._encode_new([run.decode()]))
        by_token: dict[int, list[np.ndarray]] = {}
        for n, piece, ends in self.leaves(run):
            by_token.setdefault(n, []).append(self.leaf(piece, ends))
        return b"".join(self.concatenate(parts).tobytes() for _, parts in sorted(by_token.items()))


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    """The tokenizer of this Python worker, whose cache lives from task to task."""
    return WordBpe(path)


HELD.append(word_bpe.cache_clear)


def digest(ids: bytes, bpe: WordBpe) -> tuple[int, str, str]:
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()


_LONG = re.compile(rb"[^ \t\n\x0b\x0c\r]{%d,}" % (LONG_RUN + 1))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of the whole text.

    A text with a long unsplit run becomes one row per stretch or leaf; those
    rows are dealt out, encoded apart, and joined again by text.
    """
    named = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    id_type = named.schema["doc_id"].dataType.simpleString()
    first = f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string, parts array<struct<part:int,token:int,leaf:int,ends:boolean,ids:binary,piece:string>>, row long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        schema = None
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = batch.column("text").to_pylist()
            rows: list = [None] * len(texts)
            plain = []
            for k, t in enumerate(texts):
                raw = t.encode()
                if len(raw) > LONG_RUN and (_LONG.search(raw)) and not any(m in raw for m in bpe.marks):
                    rows[k] = (None, None, None, _parts(bpe, raw), row + k)
                else:
                    plain.append(k)
            for k, ids in zip(plain, bpe.ids_of_batch([texts[k] for k in plain])):
                rows[k] = (*digest(ids, bpe), None, None)
            columns = list(zip(*rows)) if rows else [[]] * 5
            row += len(texts)
            schema = schema or _schema(batch.schema.field("doc_id").type)
            arrays = [batch.column("doc_id")] + [pa.array(c, type=f.type) for c, f in zip(columns, list(schema)[1:])]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    done = keep(named.mapInArrow(run, first), "bpe_rows")
    plain = done.filter("parts IS NULL").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    return plain.unionByName(_joined(done.filter("parts IS NOT NULL"), path, id_type))


def _parts(bpe: WordBpe, raw: bytes) -> list[dict]:
    """A text's runs: stretches of ordinary ones with their ids, and the leaves of long ones."""
    out, at = [], 0
    blank = {"part": 0, "token": 0, "leaf": 0, "ends": True, "ids": None, "piece": None}
    for m in _LONG.finditer(raw):
        if before := raw[at : m.start()].strip():
            out.append(blank | {"part": len(out), "ids": next(bpe.ids_of_batch([before.decode()]))})
        number = len(out)
        for k, (token, piece, ends) in enumerate(bpe.leaves(m.group())):
            out.append(blank | {"part": number, "token": token, "leaf": k, "ends": ends, "piece": piece})
        at = m.end()
    if rest := raw[at:].strip():
        out.append(blank | {"part": len(out), "ids": next(bpe.ids_of_batch([rest.decode()]))})
    return out


def _schema(id_type: pa.DataType) -> pa.Schema:
    part = pa.struct(
        [("part", pa.int32()), ("token", pa.int32()), ("leaf", pa.int32()), ("ends", pa.bool_()), ("ids", pa.binary()), ("piece", pa.string())]
    )
    return pa.schema(
        [("doc_id", id_type), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("parts", pa.list_(part)), ("row", pa.int64())]
    )


def _joined(long: DataFrame, path: str, id_type: str) -> DataFrame:
    """Encode the leaves of long runs apart, then join each text's parts."""
    leaves = long.select("doc_id", "row", F.explode("parts").alias("p")).select("doc_id", "row", "p.*")
    dealt = leaves.repartition("row", "part", "token", "leaf")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for batch in batches:
            rows = batch.select(["ids", "piece", "ends"]).to_pylist()
            ids = [r["ids"] if r["piece"] is None else bpe.leaf(r["piece"], r["ends"]).tobytes() for r in rows]
            kept = batch.select(["doc_id", "row", "part", "token", "leaf"])
            yield kept.append_column("ids", pa.array(ids, type=pa.binary()))

    def whole(group: pa.Table) -> pa.Table:
        bpe = word_bpe(path)
        rows = sorted(group.select(["part", "token", "leaf", "ids"]).to_pylist(), key=lambda r: (r["part"], r["leaf"]))
        tokens: dict[tuple[int, int], list[np.ndarray]] = {}
        for r in rows:
            tokens.setdefault((r["part"], r["token"]), []).append(np.frombuffer(r["ids"], dtype="<u4"))
        ids = b"".join(bpe.concatenate(parts).tobytes() for parts in tokens.values())
        n, sha, text = digest(ids, bpe)
        return pa.table(
            {"doc_id": group.column("doc_id").combine_chunks()[:1], "n_tokens": pa.array([n], pa.int64()), "ids_sha256": [sha], "decoded_sha256": [text]}
        )

    encoded = dealt.mapInArrow(each, f"doc_id {id_type}, row long, part int, token int, leaf int, ids binary")
    return encoded.groupBy("row").applyInArrow(
        whole, f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
