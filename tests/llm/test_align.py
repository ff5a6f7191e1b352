"""Alignment of two tokenizers against the libraries on whole texts and a plain count."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from vellum.llm import align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LIB_A, LIB_B = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
LIB_A.encode_special_tokens = True


def byte_letters():
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = {}, 0
    for b in range(256):
        if b in keep:
            table[chr(b)] = b
        else:
            table[chr(256 + extra)] = b
            extra += 1
    return table


LETTERS = byte_letters()


def grouped(text):
    if not text:
        return []
    a = LIB_A.encode(" " + text, add_special_tokens=False).ids
    b = LIB_B.encode(text)
    raw_a = [bytes(LETTERS[c] for c in LIB_A.id_to_token(i)) for i in a]
    raw_b = [bytes([int(LIB_B.id_to_piece(i)[3:5], 16)]) if LIB_B.is_byte(i) else LIB_B.id_to_piece(i).replace("▁", " ").encode() for i in b]
    whole = (" " + text).encode()
    if b"".join(raw_a) != whole or b"".join(raw_b) != whole:
        return []
    ends = lambda raw: [sum(map(len, raw[: k + 1])) for k in range(len(raw))]
    ends_a, ends_b = ends(raw_a), ends(raw_b)
    out, a0, b0 = [], 0, 0
    for e in sorted(set(ends_a) & set(ends_b)):
        a1, b1 = ends_a.index(e) + 1, ends_b.index(e) + 1
        out.append((a[a0:a1], b[b0:b1]))
        a0, b0 = a1, b1
    return out


def brute(rows):
    of = [grouped(t) for _, t in rows]
    links = [[(x, y) for a, b in g for x in a for y in b] for g in of]
    count = Counter(p for own in links for p in set(own))
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for (d, _), g, own in zip(rows, of, links):
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
        out.append((
            d, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(own), sum(count[p] == best[p[0]] for p in own),
            sum(count[p] for p in own), hashlib.sha256(text.encode()).hexdigest() if g else "",
        ))
    return sorted(out, key=str)


CASES = [
    None, "", " ", "\n", "Hello, world!\n\nNew  line\tTab", " leading", "trailing  \n ", "a\x1cb \x1c c!\x1c d", "x y 　 z w", "<|endoftext|> <s> </s> <unk>",
    "don't we'll 12345 3.14", "日本語のテキスト 中文", "emoji 😀👩‍👩‍👧 end", "if (x) {\r\n  y();\r\n}", "\r\n\r\n x \r y", "a▁b", "ünïcödé ΑΣ", "\x00\x01 \x7f", "x" * 3000 + " " + "ab1" * 700,
    "\t\t \n\t x\n \ny", "tail\t", "é\n\n\n  b", "﻿bom", "fi ﬁ ①",
]


def test_against_libraries(spark):
    rng = random.Random(2)
    alphabet = [" ", " ", "\n", "\t", "\r", "a", "the", "Ing", "é", ".", "'s", "1", " ", "{", "日", "\x1d"]
    cases = CASES + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(400)]
    rows = list(enumerate(cases)) + [(4, CASES[4]), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, align.align(docs, A, B).collect()), key=str) == brute(rows)


def test_blocks_and_caches_do_not_matter(spark, monkeypatch):
    monkeypatch.setattr(align, "CHARS_AT_ONCE", 40)
    monkeypatch.setattr(align, "UNITS_AT_ONCE", 3)
    monkeypatch.setattr(align, "WIDE", 1)
    rows = [(2**60 + k, f"the cat number {k % 7} sat on mats") for k in range(40)] + [(None, "the cat")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, align.align(docs, A, B).collect()), key=str) == brute(rows)


def test_edges(spark):
    schema = "doc_id long, text string, block int, pair int, codes string, id int"
    assert align.align(spark.createDataFrame([], schema), A, B).count() == 0
    rows = [(1, None), (2, ""), (3, "▁")]
    got = align.align(spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], schema), A, B).collect()
    assert sorted(map(tuple, got)) == [(k, 0, 0, 0, 0, 0, 0, "") for k in (1, 2, 3)]
