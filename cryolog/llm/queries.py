"""The queries of this subpackage: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import read


def vocabulary(name: str) -> str:
    """Place of a public tokenizer file, the same on every machine of the cluster."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import op1_suffix_dedup as op

    return op.report(read(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import op2_decontaminate as op

    return op.hits(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import op3_quality as op

    return op.judge(read(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import op4_sharding as op

    return op.assign(read(spark, sf_dir, "documents"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import op5_jaccard as op

    return op.link_components(read(spark, sf_dir, "documents"), k=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op6_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import op6_sstable as op

    manifest = op.write_shards(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=2)
    return op.read_shards(manifest)


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import op7_wrappers as op

    return op.main_text(read(spark, sf_dir, "pages"))


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import op8_licences as op

    return op.scan(read(spark, sf_dir, "documents").withColumn("path", op.tree_path()))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import op9_packing as op

    return op.pack(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import op10_toxicity as op

    docs = read(spark, sf_dir, "documents")
    return op.scores(docs, op.train(docs, read(spark, sf_dir, "labels")))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import op11_whitening as op

    return op.report(read(spark, sf_dir, "embeddings"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import op12_fingerprints as op

    return op.compare_edited(read(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import op13_alignment as op

    return op.report(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and k[2:3].isdigit() and callable(f)}
    return found


OP2_SQL = """
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x{00}-\\x{2F}\\x{3A}-\\x{60}\\x{7B}-\\x{7F}]+') AS w FROM documents),
item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x{00}-\\x{2F}\\x{3A}-\\x{60}\\x{7B}-\\x{7F}]+') AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS s
  FROM item_words, LATERAL (SELECT unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM item_windows),
doc_windows AS (
  SELECT doc_id, size, i, array_to_string(list_slice(w, i, i + size - 1), ' ') AS s
  FROM doc_words, sizes, LATERAL (SELECT unnest(range(1, len(w) - size + 2)) AS i) WHERE len(w) >= size),
found AS (SELECT d.doc_id, d.i, d.size, t.item_id FROM doc_windows d JOIN item_windows t ON d.size = t.size AND d.s = t.s),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS j FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(x.n_items, 0) AS n_items,
  sha256(coalesce(x.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM doc_words d LEFT JOIN hit h USING (doc_id) LEFT JOIN items x USING (doc_id)
"""


_SPACE = "\\x{20}\\x{09}-\\x{0D}"
_RATES = [("symbol_rate", "n_symbols", 25000), ("repeat_rate", "n_repeat_words", 25000), ("word_length", "word_chars", 400000), ("dup_line_rate", "n_dup_lines", 5000)]
_RATE_ROWS = " UNION ALL ".join(f"SELECT doc_id, lang, source, base_failed, '{k}' AS rate, {w} AS least, CAST(floor({n} * 100000 / n_words) AS BIGINT) AS v FROM base WHERE n_words > 0" for k, n, w in _RATES)
OP3_SQL = f"""
WITH words AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^{_SPACE}]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g FROM words, LATERAL (SELECT unnest(range(1, len(w) - 1)) AS i)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1),
repeated AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM again) GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{_SPACE}]')) AS l FROM words),
counted AS (
  SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM words JOIN lines USING (doc_id) LEFT JOIN repeated USING (doc_id)),
base AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted),
rates AS (SELECT *, greatest(length(bin(v)) - 6, 0) AS s FROM ({_RATE_ROWS})),
bucketed AS (SELECT *, s * 128 + v // (1 << s) AS bucket FROM rates),
tops AS (SELECT *, CAST((bucket - bucket // 128 * 128 + 1) * (1 << (bucket // 128)) - 1 AS DOUBLE) AS top FROM bucketed WHERE NOT base_failed),
own AS (SELECT lang, source, rate, least, quantile_disc(top, 0.25) AS q1, quantile_disc(top, 0.75) AS q3, count(*) AS n FROM tops GROUP BY ALL),
of_lang AS (SELECT lang, rate, quantile_disc(top, 0.25) AS q1, quantile_disc(top, 0.75) AS q3 FROM tops GROUP BY ALL),
most AS (
  SELECT o.lang, o.source, o.rate, (o.n * (o.q3 + greatest(6.0::DOUBLE * (o.q3 - o.q1), o.least)) + 100 * (g.q3 + greatest(6.0::DOUBLE * (g.q3 - g.q1), o.least))) / (o.n + 100) AS most
  FROM own o JOIN of_lang g ON o.lang IS NOT DISTINCT FROM g.lang AND o.rate = g.rate),
fine AS (SELECT r.doc_id, bool_and(r.v <= m.most) AS fine FROM rates r JOIN most m ON r.lang IS NOT DISTINCT FROM m.lang AND r.source IS NOT DISTINCT FROM m.source AND r.rate = m.rate GROUP BY r.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(fine, false) AS kept FROM base LEFT JOIN fine USING (doc_id)
"""

OP5_SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^{_SPACE}]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')))) END AS s FROM words),
classes AS (SELECT s, min(doc_id) AS c, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
members AS (SELECT c, n, unnest(s) AS x FROM classes),
pairs AS (SELECT a.c AS a, b.c AS b, a.n AS an, b.n AS bn, count(*) AS common_n FROM members a JOIN members b ON a.x = b.x AND a.c <> b.c AND b.n * 10 >= a.n * 9 AND a.n * 10 >= b.n * 9 GROUP BY ALL),
links AS (SELECT a, b FROM pairs WHERE 100 * common_n >= 90 * (an + bn - common_n)),
reach AS (SELECT c AS a, c AS b FROM classes UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
roots AS (SELECT a AS c, min(b) AS root FROM reach GROUP BY a)
SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, coalesce(r.root, d.doc_id) AS component_id FROM sets d LEFT JOIN classes k ON d.s = k.s LEFT JOIN roots r ON r.c = k.c
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_decontaminate": OP2_SQL, "op3_quality": OP3_SQL, "op5_jaccard_join": OP5_SQL}
