"""Operators against plain versions, on small documents with nulls, empty, long and repeated texts and clashing columns."""

from __future__ import annotations

import random
import re
import sys
import zlib
from collections import Counter
from html.parser import HTMLParser
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import plain  # noqa: E402

from cryolog.llm import common, op1_suffix_dedup, op2_decontaminate, op3_quality, op4_sharding, op5_jaccard, op6_sstable, op7_wrappers, op8_licences, op9_packing, op10_toxicity, tokens  # noqa: E402
from cryolog.llm.queries import vocabulary  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, _row string, shard int"


def texts() -> list[str | None]:
    r = random.Random(7)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(2, 6))) for _ in range(300)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    base = prose(220)
    near = base.split(" ")
    near[100] = "changed"
    shared = prose(90)
    out = [base, base, " ".join(near), prose(30) + " " + shared + " " + prose(40), prose(25) + "\n" + shared, "ab " * 900, "x" * 1500, None, "", " \n ", "One", "one", prose(3000), prose(12)]
    return out + [prose(r.randint(1, 150)) for _ in range(40)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or ""), "x", "y", 1) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_repeats(docs, empty):
    want = plain.repeats([(t or "").encode() for t in texts()], 400)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op1_suffix_dedup.report(docs).collect()}
    assert [got[i] for i in range(len(want))] == want
    assert op1_suffix_dedup.report(empty).count() == 0


def test_repeats_keep_columns_and_repeated_rows(docs):
    out = op1_suffix_dedup.remove_repeats(docs)
    assert out.schema.names == docs.schema.names and out.count() == docs.count()
    twice = docs.where("doc_id = 3").unionByName(docs.where("doc_id = 3"))
    assert [r.n_removed == r.n_bytes for r in op1_suffix_dedup.report(twice).collect()] == [True, True]


def test_repeats_by_trees_and_by_counts_agree(docs, monkeypatch):
    for length, gram in ((400, 200), (200, 100)):
        want = plain.repeats([(t or "").encode() for t in texts()], length)
        for most in (50_000, 2):  # with 2, most grams have too many contexts for a tree
            monkeypatch.setattr(op1_suffix_dedup, "MOST", most)
            got = {r.doc_id: r for r in op1_suffix_dedup.report(docs, length, gram).collect()}
            assert [(got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) for i in range(len(want))] == want
            assert all(got[i].n_shared_anchors > 0 for i, w in enumerate(want) if w[1])


def test_repeats_of_null_and_least_ids(spark):
    rows = [(None, "a" * 401), (-(2**63), "b" * 300), (None, None), (-(2**63), ""), (3, "c" * 10)]
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed) for r in op1_suffix_dedup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(None, 401, 401), (-(2**63), 300, 0), (None, 0, 0), (-(2**63), 0, 0), (3, 10, 0)], key=str)


def test_repeat_groups_have_all_occurrences(docs, empty, monkeypatch):
    raw = [(t or "").encode() for t in texts()]
    covered = lambda rows: {(r.doc_id, k) for r in rows for k in range(r.start, r.start + r.n_bytes)}
    want = plain.repeats(raw, 200)
    for most in (50_000, 2):
        monkeypatch.setattr(op1_suffix_dedup, "MOST", most)
        rows = op1_suffix_dedup.repeat_groups(docs, 200, 100).collect()
        groups: dict[int, list] = {}
        for r in rows:
            groups.setdefault(r.repeat, []).append(r)
        for g in groups.values():
            strings = {raw[r.doc_id][r.start : r.start + r.n_bytes] for r in g}
            assert len(g) > 1 and len(strings) == 1
            (string,) = strings
            if len(string) < 290:  # the reach of an anchor clips longer ones
                assert len(g) <= sum(t[i:].startswith(string) for t in raw for i in range(len(t)))
        assert len(covered(rows)) == sum(w[1] for w in want)
    assert op1_suffix_dedup.repeat_groups(empty).count() == 0


def test_maximal_repeats_against_all_substrings():
    r = random.Random(3)
    for _ in range(40):
        pairs = list({("".join(r.choice("ab") for _ in range(r.randint(0, 4))), "".join(r.choice("ab") for _ in range(r.randint(1, 4)))) for _ in range(r.randint(1, 7))})
        want = set()
        for a in range(5):
            for b in range(1, 5):
                by: dict = {}
                for i, (x, y) in enumerate(pairs):
                    if len(x) >= a and len(y) >= b:
                        by.setdefault((x[:a], y[:b]), []).append(i)
                for m in by.values():
                    longer = lambda k, n: {pairs[i][k][n : n + 1] or str(i) for i in m}  # noqa: B023, E731
                    if len(m) > 1 and a + b >= 3 and len(longer(0, a)) > 1 and len(longer(1, b)) > 1:
                        want.add((a, b, tuple(m)))
        tree = op1_suffix_dedup.Contexts([x.encode() for x, _ in pairs], [y.encode() for _, y in pairs], [1] * len(pairs))
        assert {(a, b, tuple(sorted(m))) for a, b, m in tree.maximal_repeats(3)} == want


def test_decontamination(spark, docs, empty):
    t = texts()
    bench = spark.createDataFrame([(1, " ".join(t[0].split()[20:60])), (2, "ONE"), (3, None), (4, t[12][500:900])], "item_id long, text string")
    got = {r.doc_id: r for r in op2_decontaminate.hits(docs, bench).collect()}
    words = [re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or "")) for x in t]
    windows = [(i, tuple(w[k : k + min(13, len(w))])) for i, x in bench.collect() for w in [re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (x or "").lower())] for k in range(len(w) - min(13, len(w)) + 1) if w]
    for i, w in enumerate(words):
        hit, items = set(), set()
        for item, x in windows:
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit.update(range(k, k + len(x)))
                    items.add(item)
        assert (got[i].n_words, got[i].n_hit, got[i].n_items) == (len(w), len(hit), len(items))
    left = {r.doc_id for r in op2_decontaminate.drop_contaminated(docs, bench).collect()}
    assert left == {i for i in got if not got[i].contaminated}
    assert op2_decontaminate.hits(empty, bench).count() == 0 and op2_decontaminate.hits(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_decontamination_in_blocks(spark, docs, monkeypatch):
    bench = spark.createDataFrame([(i, " ".join((texts()[0] or "").split()[i : i + 20])) for i in range(30)], "item_id long, text string")
    whole = sorted(op2_decontaminate.hits(docs, bench).collect())
    monkeypatch.setattr(op2_decontaminate, "BLOCK_WINDOWS", 50)
    assert sorted(op2_decontaminate.hits(docs, bench).collect()) == whole


def test_filters_in_blocks(spark, monkeypatch):
    words = [f"w{i}" for i in range(420)]
    items = [(str(i), " ".join(words[a : a + 13])) for i, a in enumerate((10, 200, 16, 300))]
    clean = " ".join(f"v{i}" for i in range(300)) + " " + items[0][1]
    rows = [(1, " ".join(words), "x", "y", [0]), (2, clean, "x", "y", [1]), (2, clean, "x", "y", [1]), (3, None, "x", "y", None), (None, "", "x", "y", [])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row string, _doc string, spans array<int>")
    bench = spark.createDataFrame(items, "item_id string, text string").coalesce(1)
    cut = " ".join(w for i, w in enumerate(words) if not any(a <= i < b for a, b in ((10, 29), (200, 213), (300, 313))))
    for size in (op2_decontaminate.BLOCK_WINDOWS, 2):
        monkeypatch.setattr(op2_decontaminate, "BLOCK_WINDOWS", size)
        left = op2_decontaminate.drop_contaminated(docs, bench)
        assert left.schema == docs.schema and sorted(map(tuple, left.collect()), key=str) == sorted(rows[1:], key=str)
        got = op2_decontaminate.remove_spans(docs, bench).collect()
        assert len(got) == len(rows) and next(r.text for r in got if r.doc_id == 1).split() == cut.split()


def plain_quality(text: str | None) -> tuple[int, int, int, int, int]:
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    again = {j for i, g in enumerate(grams) if n[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again)


def test_quality_counts(spark, docs, empty):
    long = "ab cd ef gh " * 2000 + " ".join(f"w{i % 3000}" for i in range(6000)) + "\n#\n#\n \n#"
    more = spark.createDataFrame([(100, long, None, None), (100, long, None, None), (None, "a\x1cb c\n\n", "en", None)], "doc_id long, text string, lang string, source string")
    rows = op3_quality.judge(docs.unionByName(more, allowMissingColumns=True)).collect()
    assert len(rows) == len(texts()) + 3
    for r in rows:
        text = long if r.doc_id == 100 else "a\x1cb c\n\n" if r.doc_id is None else texts()[r.doc_id]
        want = plain_quality(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and (not r.kept or not r.base_failed)
    assert op3_quality.judge(empty).count() == 0


def test_quality_thresholds_follow_each_group(spark):
    """Symbols that are usual in one source are not in another; a source of few texts follows its language."""
    word = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    rows = [(i, word(i) + " #" * 40, "en", "code") for i in range(300)] + [(300 + i, word(i), "en", "news") for i in range(1600)]
    rows += [(2000, word(1) + " #" * 40, "en", "news"), (2001, word(2) + " #" * 40, "en", "small"), (2002, word(3), "en", "small")]
    got = {r.doc_id: r.kept for r in op3_quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i in range(1900)) and not got[2000] and not got[2001] and got[2002]


def test_sharding(docs, empty):
    rows = op4_sharding.assign(docs.unionByName(docs)).collect()
    by: dict[int, list[int]] = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and len(by) == 16
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    hot = op4_sharding.assign(docs.crossJoin(docs.sparkSession.range(20)).withColumn("text", common.F.lit("same"))).collect()
    assert len(hot) == 20 * len(texts()) and op4_sharding.assign(empty).count() == 0


def test_sharding_of_copies_alone(spark):
    def split(n: int, copies: str) -> int:
        docs = spark.range(n).selectExpr("id doc_id", f"concat('text ', {copies}) text")
        rows = op4_sharding.assign(docs).collect()
        by = [sorted(r.slot for r in rows if r.shard == s) for s in range(16)]
        assert len(rows) == n and all(v == list(range(len(v))) for v in by) and {len(v) for v in by} <= {n // 16, -(-n // 16)}
        return len({(r.text_crc32, r.shard) for r in rows}) - len({r.text_crc32 for r in rows})

    assert split(3200, "id div 2") <= 15  # every text twice and none alone: all but the last forest of shards come together
    assert split(1500, "if(id < 400, 0, id div 3)") <= 40  # a group larger than four shards among groups of three


def test_sharding_of_nulls_ties_and_repeated_rows(spark):
    rows = [(None, None), (None, None), (None, ""), (7, "é" * 3), (7, "é" * 3), (8, "é" * 3), (-(2**63), "x")] + [(i, f"text {i % 9}") for i in range(60)]
    got = op4_sharding.assign(spark.createDataFrame([(*r, "a", 1) for r in rows], "doc_id long, text string, grp string, slot int")).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want and {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    by = Counter(r.shard for r in got)
    assert set(by) <= set(range(16)) and max(by.values()) - min(by.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in by.items())


def test_propagation_against_plain_moves(spark):
    """No move makes a new cell or changes a shard's rows, and groups end as whole as a plain exchange leaves them."""
    r = random.Random(8)
    start: Counter = Counter()
    for g in range(40):
        for _ in range(r.randint(2, 9)):
            start[g, r.randrange(4)] += 1
    loads = [sum(n for (_, s), n in start.items() if s == k) for k in range(4)]
    cells = spark.createDataFrame([(g, s, n) for (g, s), n in start.items()], "grp long, shard int, n long")
    got = {(x.grp, x.shard): x.n for x in op4_sharding.propagate(cells, [n + 2 for n in loads]).collect()}
    total = lambda c, k: sum(n for (g, _), n in c.items() if g == k)
    assert set(got) <= set(start) and all(total(got, g) == total(start, g) for g in range(40))
    assert all(sum(n for (_, s), n in got.items() if s == k) <= loads[k] + 2 for k in range(4))
    plain_cells, cut = dict(start), lambda c: sum(1 for g in range(40) for _ in [x for x in c if x[0] == g][1:])
    moved = True
    while moved:  # swap whole cells of equal size while that leaves fewer cells
        moved = False
        for (g, a), n in list(plain_cells.items()):
            for (h, b), m in list(plain_cells.items()):
                if g != h and a != b and n == m and (g, b) in plain_cells and (h, a) in plain_cells and (g, a) in plain_cells and (h, b) in plain_cells:
                    for x in ((g, a), (h, b)):
                        del plain_cells[x]
                    plain_cells[g, b] += n
                    plain_cells[h, a] += m
                    moved = True
    assert cut(got) <= cut(plain_cells) < cut(dict(start))


def test_grants_keep_counts():
    asked = [[0, 5, 0, 0], [0, 0, 3, 0], [4, 2, 0, 0], [7, 0, 0, 0]]
    got = op4_sharding.granted(asked, [2, 0, 0, 0])
    gain = [sum(row[s] for row in got) - sum(got[s]) for s in range(4)]
    assert all(g <= r for g, r in zip(gain, [2, 0, 0, 0])) and sum(map(sum, got)) == 2 * 2 + 3 * 1 + 2


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80), (2, 50)])
def test_jaccard(docs, empty, k, percent):
    want = plain.components({i: plain.shingles(t or "", k) for i, t in enumerate(texts())}, percent)
    assert {r.doc_id: r.component_id for r in op5_jaccard.link_components(docs, k, percent).collect()} == want
    kept = op5_jaccard.drop_near_copies(docs, k, percent)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values())) and kept.columns == docs.columns
    assert op5_jaccard.link_components(empty, k, percent).count() == 0


def test_near_copies_of_null_and_shared_ids(spark):
    prose = {x: " ".join(f"{x}{i}" for i in range(40)) for x in "abcdefg"}
    near = prose["a"].replace("a39", "other")
    rows = [(None, prose["a"]), (None, prose["b"]), (None, near), (5, prose["c"]), (5, prose["d"]), (5, ""), (None, None), (None, "")]
    rows += [(None, prose["e"]), (9, prose["e"]), (8, prose["e"]), (7, prose["f"]), (7, prose["f"] + " more"), (6, prose["g"]), (6, prose["g"])]
    kept = [tuple(r) for r in op5_jaccard.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()]
    of = lambda *some: sorted((r for r in kept if r[1] in some), key=str)
    assert len(of(prose["a"], near)) == 1 and of(prose["b"]) == [(None, prose["b"])]
    assert of(prose["c"], prose["d"]) == [(5, prose["c"]), (5, prose["d"])] and of("") == [(5, ""), (None, "")]
    assert (None, None) in kept and of(prose["e"]) == [(8, prose["e"])]
    assert len(of(prose["f"], prose["f"] + " more")) == 1 and of(prose["g"]) == [(6, prose["g"])] and len(kept) == 10


def test_least_id_is_an_id_of_its_own(spark):
    rows = [(None, "one two three four"), (-(2**63), "one two three four"), (-(2**63), "five six seven"), (None, None), (None, "")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in op5_jaccard.link_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()), key=str)
    assert got == sorted([(None, 2, -(2**63)), (-(2**63), 2, -(2**63)), (-(2**63), 1, -(2**63)), (None, 0, None), (None, 0, None)], key=str)


def test_shards_round_trip(docs, empty):
    coder = op6_sstable.encoder(vocabulary("byte_bpe_50k.json"), True)
    manifest = op6_sstable.write_shards(docs, vocabulary("byte_bpe_50k.json"), 2)
    start = 0
    for r in sorted(op6_sstable.read_shards(manifest).collect()):
        ids = coder.whole(texts()[r.doc_id] or "") + b"\2\0\0\0"
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4
    shards = [op6_sstable.open_shard(r.path) for r in manifest.collect()]
    assert all(sum(len(s.get(op6_sstable.key_of(i))) for s in shards) == 1 for i in range(len(texts())))
    assert all(not s.get(op6_sstable.key_of(i)) for s in shards for i in (-5, 10**9))
    assert op6_sstable.read_shards(op6_sstable.write_shards(empty, vocabulary("byte_bpe_50k.json"), 2)).count() == 0


def test_pages(spark):
    page = lambda t, a: f"<html><head><title>x</title></head><body><nav><li>menu</nav><div class='ad'>{a}</div><article><h1>{t}</h1><p>a&amp;b  {t}<br><p>more {t}</article><div id=comments>no</div><footer>f</footer>"
    rows = [(i, "http://a.b/x", page(f"t{i}", i)) for i in range(6)] + [(7, None, None), (8, "odd", "plain <b>text"), (9, "http://c.d/", "<body><p>one<p>two")]
    out = {r.page_id: (r.text, r.n_chars) for r in op7_wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[3] == ("t3\na&b t3\nmore t3", 18 - 1) and out[7] == ("", 0) and out[8][0] == "plain text" and out[9][0] == "one\ntwo"


def article_of(page: str) -> str:
    """Blocks of the article by the standard library's parser, for well-formed pages."""
    out: list[list[str]] = []

    class Parser(HTMLParser):
        depth = 0

        def handle_starttag(self, tag, attrs):
            self.depth += tag == "article"
            if tag in ("h1", "p", "article"):
                out.append([])

        def handle_endtag(self, tag):
            self.depth -= tag == "article"

        def handle_data(self, data):
            if self.depth:
                out[-1].append(data)

    Parser(convert_charrefs=True).feed(page)
    return "\n".join(t for t in (" ".join("".join(x).split()) for x in out) if t)


def test_pages_against_plain_parser(spark):
    pages = common.read(spark, "/root/testdata/sf0.001", "pages")
    want = {r.page_id: article_of(r.html or "") for r in pages.collect()}
    got = {r.page_id: r for r in op7_wrappers.main_text(pages).collect()}
    assert {i: r.text for i, r in got.items()} == want and all(r.n_chars == len(r.text) for r in got.values())


def test_pages_without_telling_names(spark):
    """Only what differs from page to page tells the text from the menu, the notice and the imprint."""

    def page(i: int) -> str:
        some = f"<div class=xc>now and then {i}</div>" if i % 2 else ""
        body = "".join(f"<p>paragraph {i} {k} of some length, as texts have</p>" for k in range(1 + i % 3))
        return f"<html><body><div class=xa><a href=a>Home</a> <a href=b>About {i}</a></div><div class=xb><h2>title {i}</h2><div class=xd>Always the same line.</div>{body}</div>{some}<div class=xe>All rights kept</div></body></html>"

    want = lambda i: "\n".join([f"title {i}"] + [f"paragraph {i} {k} of some length, as texts have" for k in range(1 + i % 3)])
    schema = "page_id long, url string, html string, host string, text string, rules string, wrapper string"
    rows = [(i, f"http://x.y/{i}", page(i), "", "", "", "") for i in range(40)]
    rows += [(100 + i, "https://copies.org/a", page(7), "", "", "", "") for i in range(12)]
    out = op7_wrappers.main_text(spark.createDataFrame(rows + rows[:3], schema).repartition(5))
    got = {r.page_id: r.text for r in out.collect()}
    assert out.count() == len(rows) + 3 and all(got[i] == want(i) for i in range(40))
    assert op7_wrappers.extract(page(1), None) != want(1)  # without the wrapper
    assert {want(7) in got[100 + i] or got[100 + i].startswith("title 7") for i in range(12)} == {True}  # copies alone have no constants
    assert op7_wrappers.main_text(spark.createDataFrame([], schema)).count() == 0


def test_wrapper_is_a_union_free_expression():
    a = op7_wrappers.Wrapper.of("<ul><li>1<li>2</ul><p>x</p>")
    b = op7_wrappers.Wrapper.of("<ul><li>1<li>2<li>3</ul><div>d</div><p>y</p>")
    c = op7_wrappers.Wrapper.of("<ul><li>1</ul><p>x</p>")
    assert a.align(b).align(c).pattern() == "<ul><li>#</>+</><p>#</><div>=</>?"


def test_wrappers_do_not_depend_on_order(monkeypatch):
    monkeypatch.setattr(op7_wrappers, "MOST_NAMES", 6)
    r = random.Random(5)
    pages = ["<body>" + "".join(f"<div class={'abcdefgh'[r.randrange(8)] * r.randint(1, 2)}><p>{r.choice(['same', str(i)])}</div>" for _ in range(r.randint(1, 9))) for i in range(30)]

    def rules(order: list[str], parts: int) -> dict:
        merged = []
        for k in range(parts):
            held = None
            for p in order[k::parts]:
                new = op7_wrappers.Wrapper.of(p)
                held = new if held is None else held.align(new)
            merged.append(op7_wrappers.Wrapper.loads(held.dumps()))
        held = merged[0]
        for w in merged[1:]:
            held = held.align(w)
        return {k: sorted(v) if isinstance(v, list) else v for k, v in held.rules().items()}

    want = rules(pages, 1)
    assert want["by_tag"]
    for parts in (1, 3, 7):
        assert rules(r.sample(pages, len(pages)), parts) == want


def test_pages_of_many_nodes(spark):
    """Pages of 2000 blocks of 500 kinds, and one of 300 000 characters, keep all their text."""
    page = lambda i: "<div class=top>same line</div><div class=t>" + "".join(f"<section class=k{chr(97 + k % 20)}{chr(97 + k // 20 % 25)}><p>{i} {k}</p></section>" for k in range(2000)) + "</div>"
    rows = [(i, "http://a.b", page(i)) for i in range(7)] + [(9, "http://l.o", "<article>" + "<p>long text</p>" * 20_000 + "</article>")]
    got = {r.page_id: r.text for r in op7_wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == "\n".join(f"{i} {k}" for k in range(2000)) for i in range(7)) and got[9] == "\n".join(["long text"] * 20_000)


def test_licences(spark):
    rows = [(1, "/a/LICENSE", "Released under the MIT License."), (2, "/a/b/c.py", "code"), (3, "/a/b/d.py", "Licensed under the Apache License, Version 2.0.\ncode"), (4, "/z/e.py", None), (5, None, "")]
    out = {r.doc_id: (r.licence, r.origin) for r in op8_licences.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert out == {1: ("MIT", "own"), 2: ("Apache-2.0", "inherited"), 3: ("Apache-2.0", "own"), 4: (None, "none"), 5: (None, "none")}


def test_licences_against_plain_cosines(spark):
    templates = [(k, t) for k, ts in op8_licences.TEMPLATES.items() for t in ts]
    words = lambda t: [w for w in re.split(r"[^a-z0-9.]+|\.(?=[^0-9]|$)", t.lower()) if w]
    lines = [t for _, t in templates] + ["Released under the terms of the MIT License, see below", "Redistribution of water is permitted", "All rights reserved by the author of this program", "Permission to leave", "licensed", "free software"]
    files = [(i, f"/p{i % 3}/q{i % 2}/{'LICENSE.txt' if i == 7 else i}", "\n".join(["first", "second", lines[i % len(lines)], "", "more words", lines[i * 7 % len(lines)]]), "x", 1.0) for i in range(60)]
    files += [(100, "/p1/q0/z/deep", None, "x", 1.0), (101, None, "", "x", 1.0), (102, "/p9/none", "no word of it", "x", 1.0), (0, *files[0][1:]), (103, "/l/COPYING", "\n".join(["a", "b", "c", "d", lines[0]]), "x", 1.0), (104, "/l/m/n", "z", "x", 1.0)]
    candidates = {x for f in files for x in (f[2] or "").split("\n") if any(re.search(rf"\b{w}", x.lower()) for _, t in templates for w in re.findall("[a-z]{6,}", t.lower()))}
    df = Counter(w for x in candidates for w in set(words(x)))
    idf = lambda w: max(np.log((len(candidates) + 1) / (df[w] + 0.5)), 0.05)
    vector = lambda t: {w: n * idf(w) for w, n in Counter(words(t)).items()}
    norm = lambda v: np.sqrt(sum(x * x for x in v.values()))

    def best(line: str) -> tuple | None:
        v, found = vector(line), []
        for name, t in templates:
            u = vector(t)
            cosine = round(sum(x * u.get(w, 0) for w, x in v.items()) / (norm(u) * norm(v)), 6)
            if cosine >= 0.5:
                found.append((-cosine, name))
        return min(found, default=None)

    of_line = {x: best(x) for x in candidates}
    own, speaks = {}, {}
    for k, (_, path, text, *_) in enumerate(files):
        at = [(i, of_line[x.strip()]) for i, x in enumerate(x for x in (text or "").split("\n") if x.strip()) if of_line.get(x.strip())]
        own[k] = min((m for _, m in at), default=None)
        for i, m in at:
            if i < 3 or re.search(r"(?i)(^|/)(license|copying)", path.rsplit("/", 1)[1]):
                d = path.rsplit("/", 1)[0]
                speaks[d] = min(speaks.get(d, (9,)), (*m, path))
    want = []
    for k, (i, path, *_) in enumerate(files):
        d, near = (path or "/").rsplit("/", 1)[0], None
        steps = d.split("/")
        for n in range(len(steps), 0, -1):
            near = near or ("/".join(steps[:n]), speaks["/".join(steps[:n])]) if "/".join(steps[:n]) in speaks else near
        want.append((i, own[k][1] if own[k] else near[1][1] if near else None, "own" if own[k] else "inherited" if near else "none", None if own[k] or not near else near[0]))
    got = op8_licences.scan(spark.createDataFrame(files, "doc_id long, path string, text string, licence string, cosine double"))
    assert sorted(((r.doc_id, r.licence, r.origin, r.from_dir) for r in got.collect()), key=str) == sorted(want, key=str)
    assert {x[2] for x in want} == {"own", "inherited", "none"} and op8_licences.scan(got.select("doc_id", "path", "licence", common.F.lit("").alias("text")).limit(0)).count() == 0


def test_licences_in_long_lines(spark):
    filler = lambda n, end: "".join(f"word{i} goes on{end} " for i in range(n))
    mit, gpl = op8_licences.TEMPLATES["MIT"][1], op8_licences.TEMPLATES["GPL-3.0"][1]
    notices = {1: filler(300, "") + mit[:-1] + " " + filler(300, ""), 2: filler(300, ".") + "Licensed under CC BY 4.0. " + filler(300, "."), 3: filler(300, ",") + gpl, 4: filler(400, ""), 5: mit, 6: ("x" * 3000 + " ") * 2 + "licence"}
    files = [(i, f"/{i}/a", t) for i, t in notices.items()] + [(7, "/1/b/c", "none of its own")]
    got = {r.doc_id: (r.licence, r.origin) for r in op8_licences.scan(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    own = {1: "MIT", 2: "CC-BY-4.0", 3: "GPL-3.0", 5: "MIT"}
    assert got == {i: (own[i], "own") if i in own else (None, "none") for i in notices} | {7: ("MIT", "inherited")}


def test_licences_meet_templates_without_a_join(spark):
    lines = spark.createDataFrame([(t,) for ts in op8_licences.TEMPLATES.values() for t in ts], "line string")
    found = op8_licences.line_licences(lines, *op8_licences.idf_of(lines))
    assert found.count() == lines.count() and found.where("cosine > 0.999").count() == lines.count()
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2  # norms and lines


def test_licences_of_lines_without_a_long_word(spark):
    texts = ["under CC BY 4.0", "_Licensed under CC BY 4.0._", "by the way", "code", "Licensed under CC BY 4.0. " * 100]
    out = op8_licences.scan(spark.createDataFrame([(i, f"/{i}/a", t) for i, t in enumerate(texts)], "doc_id long, path string, text string"))
    got = {r.doc_id: (r.licence, r.cosine) for r in out.collect()}
    assert [got[i][0] for i in range(5)] == ["CC-BY-4.0", "CC-BY-4.0", None, None, "CC-BY-4.0"]
    assert got[0][1] >= op8_licences.MIN_COSINE and got[1][1] > 0.99


def test_packing(docs, empty):
    coder, pieces = op9_packing.encoder(vocabulary("word_bpe_49k.json"), False), {}
    rows = op9_packing.pack(docs, vocabulary("word_bpe_49k.json"), window=64).collect()
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(texts()):
        ids, at = coder.whole(t or "") + b"\2\0\0\0", 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and zlib.crc32(ids[4 * at : 4 * (at + r.length)]) == r.ids_crc32
            at += r.length
        assert at == len(ids) // 4
    windows: dict[int, int] = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == windows.get(r.sequence_id, 0)
        windows[r.sequence_id] = r.offset + r.length
    assert sum(n < 64 for n in windows.values()) <= 1 and max(windows.values()) == 64
    assert op9_packing.pack(empty, vocabulary("word_bpe_49k.json")).count() == 0


def test_packing_asks_for_more_neighbours():
    docs = [np.array([i % 2 * 4 + j for j in range(4)] * 2 + [8 + i, 8 + i], np.uint32) for i in range(200)]
    first = next(op9_packing.windows(docs, np.ones(300), 10.0, 1000))
    assert {i for i, _, _ in first} == set(range(0, 200, 2))


def test_packing_against_plain_bm25():
    r = random.Random(2)
    docs = [np.array([r.randrange(60) for _ in range(r.randint(1, 90))], np.uint32) for _ in range(120)]
    idf = np.array([r.uniform(0.1, 5) for _ in range(60)])
    mean, window = 40.0, 100
    got = list(op9_packing.windows(docs, idf, mean, window))
    used, cut, done = set(), None, [0] * len(docs)
    for pieces in got:
        seed = pieces[0][0]
        assert seed == (cut if cut is not None else min(i for i in range(len(docs)) if i not in used))
        used.add(seed)
        scores = {}
        for i in set(range(len(docs))) - used:
            tf = {t: docs[i].tolist().count(t) for t in set(docs[seed].tolist()) & set(docs[i].tolist())}
            scores[i] = sum(idf[t] * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(docs[i]) / mean)) for t, n in tf.items())
        for i, _, _ in pieces[1:]:
            assert scores.pop(i) >= max(scores.values(), default=0) - 1e-4
            used.add(i)
        for i, start, length in pieces:
            assert start == done[i]
            done[i] += length
        cut = pieces[-1][0] if done[pieces[-1][0]] < len(docs[pieces[-1][0]]) else None
    assert done == [len(d) for d in docs] and [sum(p[2] for p in x) for x in got[:-1]] == [window] * (len(got) - 1)


def test_packing_routes_near_copies_together():
    r = random.Random(4)
    idf = np.array([r.uniform(0.1, 9) for _ in range(5000)])
    docs = [np.array([r.randrange(5000) for _ in range(300)], np.uint32) for _ in range(300)]
    near = [np.concatenate([d[:-3], [7, 8, 9]]).astype(np.uint32) for d in docs]
    place = [op9_packing.route(d, idf, 300.0) for d in docs]
    assert sum(op9_packing.route(d, idf, 300.0) == p for d, p in zip(near, place)) > 240 and len(set(place)) == 300


def test_packing_of_repeated_rows_and_many_shards(spark, docs):
    twice = docs.unionByName(docs).unionByName(docs.where("doc_id = 7").withColumn("doc_id", common.F.lit(None).cast("long")))
    rows = op9_packing.pack(twice, vocabulary("word_bpe_49k.json"), window=64, shard_bytes=3000).collect()
    total = sum(r.length for r in rows)
    assert total == sum(r.doc_tokens for r in rows if r.start == 0) and len([r for r in rows if r.doc_id is None]) == 1
    ends = {}
    for r in rows:
        ends.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in ends.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 64
    assert len({r.sequence_id >> 32 for r in rows}) > 5


def test_token_ids_are_the_library_s():
    r, letters = random.Random(1), "abZéßÿžİı \n\t\r\x0b\x1c\xa0'’…€.,!#$0129²ªµ<|>_-\x00\x7fsntrevmld 日"
    odd = ["".join(r.choice(letters) for _ in range(r.randint(0, 14))) for _ in range(3000)] + ["<|endoftext|>", "a <|startoftext|>b", "it's we'll I'M 'S", "  x  "]
    for name, spaces in (("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)):
        coder = op9_packing.encoder(vocabulary(name), spaces)
        assert all(coder.encode(t) == coder.whole(t) for t in odd + [t or "" for t in texts()])


def test_token_ids_of_many_texts_look_up_a_word_once(monkeypatch):
    r, letters = random.Random(2), "abZéßÿžİı \n\t\r\x0b\x1c\xa0'’…€.,!#$0129²ªµ<|>_-\x00\x7fsntrevmld 日"
    odd = ["".join(r.choice(letters) for _ in range(r.randint(0, 14))) for _ in range(3000)] + ["<|endoftext|>", "it's we'll I'M 'S", "a. 's. b7 'll", "  x  ", ""]
    coder = tokens.TextEncoder(vocabulary("word_bpe_49k.json"), spaces=False)
    same = lambda found: all(a.tobytes() == coder.whole(t) for a, t in zip(coder.encode_all(found), found, strict=True))
    assert same([]) and same([""]) and same(odd) and same([t or "" for t in texts()])
    monkeypatch.setattr(tokens, "_TOGETHER", 40)  # texts longer than a group, and many groups
    assert same(odd)
    monkeypatch.undo()
    cut, coder.cut = coder.cut, lambda t: asked.append(t) or cut(t)
    asked = []
    assert same(["x-y and x-y, x-y"] * 1000) and asked == ["x-y", "x-y,"]


def test_toxicity_learns_and_holds_out(spark):
    docs, labels = (common.read(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    model = op10_toxicity.train(docs, labels)
    rows = op10_toxicity.scores(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.9
    caught, toxic = sum(r.predicted * r.toxic for r in rows), sum(r.toxic for r in rows)
    assert caught >= 0.6 * toxic and sum(r.predicted * (1 - r.toxic) for r in rows) <= 0.02 * len(rows)
    assert op10_toxicity.train(docs, labels.limit(0)).score(b"any") < 0.01


def plain_buckets(text: str | None) -> set[int]:
    folded = " " + " ".join("".join(" " if c <= " " or c == "\x7f" else c.lower() if "A" <= c <= "Z" else c for c in text or "").split(" ")) + " "
    folded = re.sub(" +", " ", folded)
    out = set()
    for n in (4, 5, 6):
        for i in range(len(folded) - n + 1):
            h = 0
            for c in folded[i : i + n]:
                h = (h * 0xD6E8FEB86659FD93 + ord(c) + 1) % 2**64
            out.add((h + n) * 0x9E3779B97F4A7C15 % 2**64 >> 44)
    return out


def test_toxicity_against_plain_training(spark):
    r = random.Random(6)
    word = lambda some: "".join(r.choice(some) for _ in range(r.randint(3, 6)))
    rows = []
    for i in range(160):
        bad = i % 3 == 0
        body = [word("abcdé") for _ in range(12)] + [r.choice(["vïle", "NASTY\tthing", "grim 日本語"]) if bad and r.random() < 0.9 else word("xyz")]
        r.shuffle(body)
        rows.append((i, " ".join(body), int(bad)))
    rows += [(200, None, 0), (201, "", 0), (202, " \n", 1)]
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t, _ in rows] + [(None, None, 1, "y"), (0, rows[0][1], 5, "x")], "doc_id long, text string, score int, toxic string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(3, 0), (None, 1), (1, None), (2, 7)], "doc_id long, toxic int")
    model = op10_toxicity.train(docs, labels)
    # the rows it may learn from: labelled, not held out; document 0 is there twice
    known = [(plain_buckets(t), y) for i, t, y in [*rows, rows[0]] if zlib.crc32(str(i).encode()) % 4 != 2]
    known += [(plain_buckets(None), 1)] * 0
    n = Counter(y for _, y in known)
    pos, neg = Counter(b for s, y in known if y for b in s), Counter(b for s, y in known if not y for b in s)
    ratio = {}
    for b in set(pos) | set(neg):
        both = (pos[b] + neg[b]) / (n[0] + n[1])
        if abs(pos[b] / n[1] - neg[b] / n[0]) / np.sqrt(both * (1.0000001 - both) * (1 / n[0] + 1 / n[1])) >= 4:
            ratio[b] = np.log(((pos[b] + 1) / (n[1] + 2)) / ((neg[b] + 1) / (n[0] + 2)))
    assert ratio and set(np.flatnonzero(model.weights)) == set(ratio)
    # the weights are where the penalised likelihood is flat
    score = lambda s: 1 / (1 + np.exp(-(model.intercept + sum(float(model.weights[b]) for b in s if b in ratio))))
    for b, x in ratio.items():
        slope = sum((y - score(s)) * x for s, y in known if b in s) - float(model.weights[b]) / x
        assert abs(slope) < 1e-2
    assert abs(sum(y - score(s) for s, y in known)) < 1e-2
    for g in op10_toxicity.scores(docs, model).collect():
        text = next((t for i, t, _ in rows if i == g.doc_id), None)
        assert g.score == pytest.approx(score(plain_buckets(text)), abs=1e-5) and g.predicted == (g.score >= 0.3)
        assert g.held_out == (zlib.crc32(("" if g.doc_id is None else str(g.doc_id)).encode()) % 4 == 2)
    left = op10_toxicity.drop_toxic(docs, model)
    assert left.columns == docs.columns and sum(1 for _ in left.collect()) == sum(g.score < 0.3 for g in op10_toxicity.scores(docs, model).collect())
    assert op10_toxicity.drop_toxic(docs, op10_toxicity.train(docs, labels.where("doc_id IN (0, 1)"))).count() == docs.count()  # too few to learn from
    assert op10_toxicity.scores(docs.limit(0), model).count() == 0


def test_a_line_meets_its_norm_in_one_row(spark):
    lines = spark.createDataFrame([(t,) for ts in op8_licences.TEMPLATES.values() for t in ts], "line string")
    idf, other = op8_licences.idf_of(lines)
    plan = op8_licences.line_licences(lines, idf, other)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("inline(dots") < plan.rindex("Join Inner, (_line")  # its templates come apart behind the join


def test_a_word_of_many_templates_is_one_row_of_their_join(spark):
    lines = spark.createDataFrame([(f"this x{i} work of the software license",) for i in range(20)], "line string")
    idf, other = op8_licences.idf_of(lines)
    left, rows = [op8_licences.line_licences(lines, idf, other)._jdf.queryExecution().optimizedPlan()], []
    while left:
        node = left.pop()
        left += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Join" and "Inner, (word" in node.toString().split("\n")[0]:
            rows.append(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, node).count())
    assert rows == [20 * 6]  # all words but x


def test_window_minima_are_leftmost_and_keep_short_positions():
    h = np.random.default_rng(3).integers(0, 9, 300).astype(np.uint64)
    minima = op1_suffix_dedup.WindowMinima(h)
    for width in (1, 7, 81, 200):
        at = minima.of(width)
        assert at.dtype == np.int32 and at.tolist() == [i + int(np.argmin(h[i : i + width])) for i in range(len(h) - width + 1)]


def test_large_sets_that_share_little_are_no_candidates(spark):
    rng, rule = np.random.default_rng(5), op5_jaccard.Rule(80)
    sizes = [60, 900, 5000, 5000, 5400, 20_000]
    for n in sizes:
        s = np.sort(rng.integers(0, 2**64, n, dtype=np.uint64))
        whole = np.bincount((s >> np.uint64(57)).astype(int), minlength=128)
        got = op5_jaccard.folded([op5_jaccard.sketch(s, rule.ranges(n))], 128)[0]
        assert n / rule.ranges(n) <= 8 and (got <= whole).all() and got.sum() > 0.9 * n
    common_, words = " ".join(f"c{i}" for i in range(12)), lambda k: " ".join(f"w{k}x{i}" for i in range(6000))
    texts = [f"{words(k)} {common_}" for k in range(6)] + [f"{words(0)} {common_} end", f"{words(1)} z {common_}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = op5_jaccard._sets(docs, 5, 80).select("doc_id", "cls", common.F.col("n_shingles").alias("n"), "sketch").collect()
    lists = spark.createDataFrame([(7, r.cls, r.n, r.sketch) for r in rows], "sig long, cls long, n long, sketch binary")
    of = {r.cls: r.doc_id for r in rows}
    assert {frozenset((of[t.a], of[t.b])) for t in op5_jaccard._ties(lists, 80).collect()} == {frozenset((0, 6)), frozenset((1, 7))}
    found = {r.doc_id: r.component_id for r in op5_jaccard.link_components(docs).collect()}
    assert found == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 0, 7: 1}


def test_licences_within_lines_of_any_length(spark):
    mit, filler = "Released under the MIT License.", lambda n, end: "".join(f"Word{i} goes on{end} " for i in range(n))
    texts = {i: filler(n, ".") + mit + " " + filler(n, ".") for i, n in enumerate((4, 10, 30, 60, 200))} | {9: filler(30, ".")}
    texts[7] = filler(10, ".") + "By. Mit. " + filler(10, ".")
    texts[8] = filler(30, "") + op8_licences.TEMPLATES["GPL-3.0"][1][:-1] + " " + filler(30, "")  # no sentence of its own
    out = op8_licences.scan(spark.createDataFrame([(i, f"/{i}/a", t) for i, t in texts.items()], "doc_id long, path string, text string"))
    assert {r.doc_id: r.licence for r in out.collect()} == dict.fromkeys(range(5), "MIT") | {7: None, 8: "GPL-3.0", 9: None}
