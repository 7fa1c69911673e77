"""The corpus pipeline: every stage on awkward rows, and the whole run against plain versions."""

from __future__ import annotations

import random
import re
import sys
import zlib
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import plain  # noqa: E402

import corpus_pipeline  # noqa: E402
from cryolog.llm import common, op10_toxicity  # noqa: E402
from cryolog.llm.queries import vocabulary  # noqa: E402
from cryolog.llm.tokens import encoder  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents() -> tuple[list[tuple], list[tuple], list[tuple]]:
    r = random.Random(17)
    words = ["".join(r.choice("abcdefghié") for _ in range(r.randint(3, 8))) for _ in range(900)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows, labels = [], []
    for i in range(120):
        toxic = i % 4 == 0
        body = prose(r.randint(30, 160)).split(" ")
        if toxic:
            for _ in range(8):
                body.insert(r.randrange(len(body)), r.choice(["vilefool", "nastything", "grimhate"]))
        rows.append((i, " ".join(body)))
        labels.append((i, 1, int(toxic)))
    base, passage, item, other = prose(200), prose(70), prose(40), prose(40)
    rows += [(200, base), (201, base), (202, base.replace(base.split(" ")[50], "changed")), (203, prose(60) + " " + passage + " " + prose(30)), (204, prose(20) + "\n" + passage), (205, prose(100) + " " + item), (206, other)]
    rows += [(207, None), (208, ""), (209, " \n "), (210, "one"), (210, "one"), (211, prose(9000)), (None, prose(40)), (None, prose(50)), (-(2**63), prose(45))]
    return [(i, t, "en" if i else None, None if t is None else "s", len(t or "")) for i, t in rows], labels, [("b1", item), ("b2", None), ("b3", "too short"), ("b4", other)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    docs, labels, bench = documents()
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stage_on_empty_tables_and_clashing_columns(spark, folder, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    none = spark.createDataFrame([], SCHEMA)
    out = stage(spark, none, folder)
    assert out.count() == 0
    odd = [(1, None, None, None, None, "x", 1, "y"), (1, None, None, None, None, "x", 1, "y"), (None, "", "en", "s", 0, "x", 2, "y"), (2, "some words here", "en", "s", 15, "x", 3, "y"), (2, "other words there", "en", "s", 17, "x", 3, "y")]
    clash = spark.createDataFrame(odd, SCHEMA + ", _id string, _row int, pieces string")
    kept = stage(spark, clash, folder)
    if name == "packing":
        assert kept.count() == len(odd)
    else:
        assert kept.columns == clash.columns and kept.count() == (4 if name == "near_copies" else 5)


def cut_repeats(texts: list[bytes], length: int) -> list[str]:
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        out.append(bytes(b for b, g in zip(t, gone, strict=True) if not g).decode(errors="ignore"))
    return out


def test_run_against_plain_versions(spark, folder):
    docs, _, bench = documents()
    model = op10_toxicity.train(*(common.read(spark, folder, t) for t in ("documents", "labels")))
    kept = [d for d in docs if model.score((d[1] or "").encode()) < 0.3]
    assert 60 < len(kept) < len(docs) - 20
    sets = {k: plain.shingles(d[1] or "", 5) for k, d in enumerate(kept)}
    root = plain.components(sets, 80)
    groups: dict[int, list[int]] = {}
    for k in range(len(kept)):
        groups.setdefault(root[k], []).append(k)
    firsts = [min(g, key=lambda k: (kept[k][0] is None, kept[k][0] or 0)) for g in groups.values()]
    empty: set = set()  # rows without a word are linked with nothing, but equal rows are one
    kept = [kept[k] for k in sorted(firsts) if sets[k] or (kept[k][:2] not in empty and not empty.add(kept[k][:2]))]
    cut = cut_repeats([(d[1] or "").encode() for d in kept], 200)
    kept = [(d[0], None if d[1] is None else t) for d, t in zip(kept, cut, strict=True)]
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").lower())
    windows = {tuple(w[i : i + min(13, len(w))]) for _, t in bench if t for w in [words(t)] for i in range(len(w) - min(13, len(w)) + 1)}

    def clean(text: str | None) -> bool:
        w = words(text)
        hit = {j for n in {len(x) for x in windows} for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for j in range(i, i + n)}
        return not hit or 20 * len(hit) < len(w)

    kept = [d for d in kept if clean(d[1])]
    assert {205, 206}.isdisjoint({d[0] for d in kept}) and {201, 202}.isdisjoint({d[0] for d in kept})
    coder = encoder(vocabulary("word_bpe_49k.json"), False)
    want = sorted(((d[0], coder.whole(d[1] or "") + b"\2\0\0\0") for d in kept), key=str)
    pieces: dict = {}
    for r in corpus_pipeline.run(spark, folder).collect():
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length, r.ids_crc32))
    assert sum(n for v in pieces.values() for _, n, _ in v) == sum(len(x) // 4 for _, x in want)
    for i, ids in want:
        for start, length, crc in sorted(pieces[i, len(ids) // 4]):
            if i is not None:
                assert zlib.crc32(ids[4 * start : 4 * (start + length)]) == crc
