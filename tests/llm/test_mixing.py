"""Language-model scores: the base against brute force, the model against what a probability must be."""

import collections
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from vellum.llm import mixing


def corpus():
    rng = random.Random(6)
    vocab = ["The", "of", "a", "stone", "Éa", "x,y", "run"]
    rows = [(k, " ".join(rng.choice(vocab + [f"rare{rng.randrange(400)}"]) for _ in range(rng.randrange(60)))) for k in range(150)]
    return rows + [(500, None), (501, ""), (502, "\x1c the\n"), (None, "of stone"), (7, rows[7][1])]


def brute(rows):
    words = lambda t: re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]
    held = lambda k: zlib.crc32(("" if k is None else str(k)).encode()) % 7 == 2
    c = collections.Counter(w for k, t in rows if not held(k) for w in words(t))
    n, v = sum(c.values()), len(c)
    return [(k, held(k), len(words(t)), sum(c[w] > 0 for w in words(t)), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words(t))) for k, t in rows]


@pytest.mark.parametrize("head", [1 << 18, 4])
def test_base_and_split(spark, monkeypatch, head):
    monkeypatch.setattr(mixing, "HEAD", head)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS word", "2 AS score")
    got = mixing.scored(docs.repartition(3)).collect()
    again = {(r.doc_id, r.n_tokens): r.score for r in mixing.scored(docs.repartition(5)).collect()}
    key = lambda r: (r[0] is not None, r[0] or 0)
    for r, w in zip(sorted(got, key=key), sorted(brute(rows), key=key)):
        assert tuple(r)[:5] == w[:5]
        assert abs(r.base_score - w[5]) < 1e-6
        assert r.score < 0 and abs(again[(r.doc_id, r.n_tokens)] - r.score) < 1e-6


def lexicon(rng, words=40):
    head = pa.array(["", *(f"w{k}" for k in range(words - 1))])
    counts = np.sort(rng.integers(2, 90, words))[::-1].copy()
    return mixing.Lexicon(head, counts, rng.integers(-99, 99, (words, mixing.DIMS)).astype(float) * counts[:, None], int(counts.sum()) + 30, words + 20, 12, 5)


def random_tables(rng, slots):
    return [mixing.packed(rng.integers(0, 9, n).astype(float), rng.integers(0, 9, n).astype(float)) for n in slots]


def test_probabilities_sum_to_one(monkeypatch):
    """Over all words of the head and the escape, the probabilities of a first word are one."""
    monkeypatch.setattr(mixing, "LEAF_WORDS", 8)
    monkeypatch.setattr(mixing, "CLASSES", 5)
    rng = np.random.default_rng(1)
    lex = lexicon(rng)
    scorer = mixing.Scorer(lex, random_tables(rng, lex.slots), mixing.Weights())
    words = [*lex.head.to_pylist(), "beyond"]
    pieces = [mixing.Piece(pa.array([w]), np.array([0]), np.array([1]), [0]) for w in words]
    assert abs(sum(math.exp(scorer.score(p, lex.numbers(p.words))[0]) for p in pieces) - 1) < 1e-5
    tool = mixing.Speller()
    tables = random_tables(rng, tool.slots)
    whole = mixing.spelled(tool, tables, ["ab", "abc", "x"])
    assert np.allclose(whole, [mixing.spelled(tool, tables, [w])[0] for w in ("ab", "abc", "x")])


def test_scores_equal_a_plain_loop(monkeypatch):
    """Decision after decision, with weights and table of the text's own, moved after each block."""
    monkeypatch.setattr(mixing, "LEAF_WORDS", 8)
    monkeypatch.setattr(mixing, "CLASSES", 5)
    rng = np.random.default_rng(3)
    lex = lexicon(rng)
    tables = random_tables(rng, lex.slots)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 60, n)) for n in (0, 3, 70, 200, 64, 500)]
    (piece,) = mixing.coded(texts)
    got = mixing.Scorer(lex, tables, mixing.Weights()).score(piece, lex.numbers(piece.words))
    logistic = lambda x: 1 / (1 + math.exp(-x))
    for text, score in zip(texts, got):
        (own,) = mixing.coded([text])
        numbers = lex.numbers(own.words)
        steps = mixing.Steps(lex, own, numbers, mixing._word_keys(own.words.to_pylist()), mixing.Past())
        weights = {g: list(mixing.START) for g in range(mixing.GATES)}
        came = {c: [30 * logistic(c - mixing.BUCKETS / 2 + 0.5), 30.0] for c in range(mixing.BUCKETS)}
        total, pending = 0.0, []
        for k, code in enumerate(own.codes.tolist()):
            total += lex.share[numbers[code]]
            _, bits, slots = steps.decisions(lex, np.array([k]))
            for bit, *at in zip(bits.tolist(), *(s.tolist() for s in slots)):
                x = [(int(t[a]) >> 2) / 512 for t, a in zip(tables, at)]
                gate = 4 * (int(tables[1][at[1]]) & 3) + (int(tables[2][at[2]]) & 3)
                mixed = min(11.0, max(-11.0, sum(w * v for w, v in zip(weights[gate], x))))
                cell = int(min(mixing.BUCKETS - 1, max(0, mixed + mixing.BUCKETS / 2)))
                final = 0.7 * logistic(mixed) + 0.3 * came[cell][0] / came[cell][1]
                total += math.log(final if bit else 1 - final)
                pending.append((gate, cell, bit, x, logistic(mixed)))
            if (k + 1) % mixing.BLOCK == 0:
                for g in weights:
                    mine = [e for e in pending if e[0] == g]
                    for n in range(3):
                        pull = sum((e[2] - e[4]) * e[3][n] for e in mine)
                        weights[g][n] += 0.3 * pull / (sum(e[4] * (1 - e[4]) * e[3][n] ** 2 for e in mine) + 40)
                for _, cell, bit, _, _ in pending:
                    came[cell][0] += bit
                    came[cell][1] += 1
                pending = []
        assert abs(total - score) < 1e-3 * max(1, abs(total))


def test_long_texts_are_scored_in_pieces(monkeypatch):
    rng = np.random.default_rng(5)
    lex = lexicon(rng)
    tables = random_tables(rng, lex.slots)
    text = "\n " + " ".join(f"w{k}" for k in rng.integers(0, 60, 3000))

    def score(most):
        monkeypatch.setattr(mixing, "CHARS_AT_ONCE", most)
        scorer = mixing.Scorer(lex, tables, mixing.Weights())
        parts = list(mixing.coded([text]))
        return len(parts), sum(int(p.sizes.sum()) for p in parts), sum(scorer.score(p, lex.numbers(p.words))[0] for p in parts)

    one, many = score(1 << 22), score(900)
    assert one[0] == 1 and many[0] > 5 and one[1] == many[1] == 3001 and abs(one[2] - many[2]) < 0.01 * abs(one[2])


def test_learns_what_repeats(spark):
    """Held-out texts of known phrases gain on the base score."""
    rng = random.Random(8)
    phrases = [" ".join("".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(8)) for _ in range(30)]
    rows = [(k, " ".join(rng.choice(phrases) for _ in range(12))) for k in range(300)]
    got = [r for r in mixing.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.held_out]
    assert len(got) > 20 and sum(r.score for r in got) > 0.5 * sum(r.base_score for r in got)


def test_no_training_texts(spark):
    got = mixing.scored(spark.createDataFrame([(k, "some words") for k in range(40) if zlib.crc32(str(k).encode()) % 7 == 2], "doc_id long, text string")).collect()
    assert got and all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 and r.score < 0 for r in got)
    assert mixing.scored(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_every_training_text_is_counted(spark, monkeypatch):
    """Contexts are counted over all training texts; none is set apart for the weights."""
    given, real = {}, mixing.context_tables
    monkeypatch.setattr(mixing, "context_tables", lambda rows, slots, decisions, name: given.update({name: rows.count()}) or real(rows, slots, decisions, name))
    rows = [(k, f"some words of text {k}") for k in range(300)]
    assert mixing.scored(spark.createDataFrame(rows, "doc_id long, text string")).count() == 300
    assert given["contexts"] == sum(zlib.crc32(str(k).encode()) % 7 != 2 for k, _ in rows)


def test_the_head_is_read_once_a_worker():
    """Looking up a piece's words takes time by the piece, not by the head, after the first time."""
    head = pa.array([f"w{k}" for k in range(200_000)], pa.string())
    lex = mixing.Lexicon(head, np.arange(200_000, 0, -1) + 1, np.ones((200_000, mixing.DIMS)), 1 << 35, 200_100, 12, 5)
    piece = pa.array(["w0", "", "w199999", "beyond", "w7"], pa.large_string())
    began = time.perf_counter()
    assert lex.numbers(piece).tolist() == [0, 200_000, 199_999, 200_000, 7]
    first = time.perf_counter() - began
    began = time.perf_counter()
    for _ in range(50):
        lex.numbers(piece)
    assert time.perf_counter() - began < 10 * first


def test_plain_values():
    assert mixing._plain(pa.array(["", None, "\u00e9a"])) == ["", None, "\u00e9a"] and mixing._plain(pa.array([], pa.large_string())) == []
