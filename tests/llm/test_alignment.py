"""Lockstep alignment against byte spans compared one by one, with the libraries' own token ids."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from cryolog.llm import op13_alignment as op
from cryolog.llm.queries import vocabulary

A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, part int, pairs string, n string"
MARKS = ["'s", "'S", " ", "  ", "\n", "\t", " ", " ", "a", "É", "1", "²", "漢", "<|endoftext|>", "<s>", "</s>", "<unk>", "_", "!!", "\x00", "\x85", "﻿", "é", "😀", "　", "▁", "ﬁ", "the ", "Straße "]


def plain(texts: dict[int, str | None]) -> dict[int, tuple]:
    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=B)
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    found, counts = {}, Counter()
    for i, text in texts.items():
        want = (" " + text).encode() if text else b""
        sides = []
        if text:
            ids = first.encode(" " + text, add_special_tokens=False).ids
            sides.append([(x, bytes(byte_of[c] for c in first.id_to_token(x))) for x in ids])
            pieces = [(x, second.id_to_piece(x)) for x in second.encode(text)]
            sides.append([(x, bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()) for x, p in pieces])
        if not text or any(b"".join(b for _, b in s) != want for s in sides):
            found[i] = ([], [], [], [])
            continue
        spans = []
        for s in sides:
            at, out = 0, []
            for x, b in s:
                out.append((x, at, at + len(b)))
                at += len(b)
            spans.append(out)
        links = [(x, y) for x, s, e in spans[0] for y, t, f in spans[1] if s < f and t < e]
        cuts = sorted({e for *_, e in spans[0]} & {f for *_, f in spans[1]})
        groups, low = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(x) for x, s, e in side if low <= s and e <= c) for side in spans))
            low = c
        counts.update(set(links))
        found[i] = (spans[0], spans[1], links, groups)
    most: dict = {}
    for (x, _), n in counts.items():
        most[x] = max(most.get(x, 0), n)
    digest = lambda g: hashlib.sha256(";".join(g).encode()).hexdigest() if g else ""
    return {i: (len(a), len(b), len(g), len(k), sum(counts[p] == most[p[0]] for p in k), sum(counts[p] for p in k), digest(g)) for i, (a, b, k, g) in found.items()}


def texts() -> list[str | None]:
    r = random.Random(3)
    words = ["the", "of", "tokenization", "Ouéaieux", "naïve", "it's", "42nd", "x" * 30, "漢字", "😀"]
    odd = ["".join(r.choice(MARKS) for _ in range(r.randint(1, 14))) for _ in range(300)]
    prose = [" ".join(r.choice(words) for _ in range(r.randint(1, 60))) for _ in range(40)]
    return [None, "", " ", "\n", "  two", "end ", "same text", "same text", *odd, *prose]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(7 * i - 9, t, 1, "x", "y") for i, t in enumerate(texts())], SCHEMA).repartition(3)


def got(df):
    return {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()}


@pytest.mark.parametrize("small", [False, True])
def test_against_spans(docs, monkeypatch, small):
    if small:  # many lanes, chunks and parts
        monkeypatch.setattr(op, "LANE_TOKENS", 3)
        monkeypatch.setattr(op, "CHUNK_BYTES", 50)
        monkeypatch.setattr(op, "PART_BYTES", 1000)
    want = plain({7 * i - 9: t for i, t in enumerate(texts())})
    found = got(op.report(docs, A, B))
    assert found == want and sum(x[2] > 0 for x in want.values()) > 200


def test_lanes_give_what_one_lane_gives():
    r = random.Random(11)
    text = " ".join(r.choice(["the", "antidisestablishment", "Éanon", "a,b;c", "\n"]) for _ in range(3000))
    whole = op.align([text, "", text[:900]], op.tokens(A), op.tokens(B))
    was, op.LANE_TOKENS = op.LANE_TOKENS, 1 << 30
    try:
        alone = [op.align([t], op.tokens(A), op.tokens(B))[0] for t in (text, "", text[:900])]
    finally:
        op.LANE_TOKENS = was
    assert all((x == y).all() for one, two in zip(whole, alone, strict=True) for x, y in zip(one, two, strict=True))


def test_groups_and_counts(docs):
    rows = {r.doc_id: r for r in op.groups(docs, A, B).collect()}
    first, second = op.tokens(A), op.tokens(B)
    for i, text in ((7 * k - 9, t) for k, t in enumerate(texts())):
        r = rows[i]
        for a0, a1, b0, b1 in zip(r.groups_a, r.groups_a[1:], r.groups_b, r.groups_b[1:]):
            assert b"".join(first.token_bytes[x] for x in r.a[a0:a1]) == b"".join(second.token_bytes[x] for x in r.b[b0:b1])
        assert b"".join(first.token_bytes[x] for x in r.a) == (" " + text).encode() if r.a else r.groups_a == [0]
    counts = op.pair_counts(docs, A, B).collect()
    assert len({(r.a, r.b) for r in counts}) == len(counts) and {r.a for r in counts} == {r.a for r in counts if r.best}


def test_repeated_rows_null_ids_and_none(spark):
    rows = spark.createDataFrame([(None, "a b", 1, "", ""), (1, "a b", 1, "", ""), (1, "a b", 1, "", "")], SCHEMA)
    assert {(r.n_links, r.count_sum) for r in op.report(rows, A, B).collect()} == {(2, 6)} and op.report(rows, A, B).count() == 3
    assert op.report(rows.where("false"), A, B).count() == 0
