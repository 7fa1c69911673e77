"""Quality rules with adaptive thresholds, in DataFrame functions only.

Each text gets its base counts.  Four rates of it (symbols and repeated words in words, word length, repeated lines in
words) go into quantile sketches, one for each language, source and rate: histograms with log-linear buckets, SUB of
them to a doubling, so a quantile is off by a thirty-second of its value at most.  Such sketches merge by adding counts
and are the same however rows are dealt.  A group's threshold for a rate is its upper quartile plus FENCE interquartile
ranges, and a least width, so an ordinary group loses nothing.  It is drawn towards the threshold of its language over all
sources with the weight of PRIOR_ROWS texts, so a group of few texts follows its language and a large one itself.  The
thresholds are joined back to the texts.

Null texts have no words and fail the base rule.  Null languages and sources are groups of their own.  Repeated rows
are judged one by one; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

SPACE = r"[\x20\x09-\x0D]"
SCALE, SUB, FENCE, PRIOR_ROWS, LOW = 100_000, 32, 6.0, 100, (1 << 32) - 1
#: rate: (numerator, denominator, least width of the fence in units of 1 / SCALE)
RATES = {
    "symbol_rate": ("n_symbols", "n_words", SCALE // 4),
    "repeat_rate": ("n_repeat_words", "n_words", SCALE // 4),
    "word_length": ("word_chars", "n_words", 4 * SCALE),
    "dup_line_rate": ("n_dup_lines", "n_words", SCALE // 20),
}


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base counts of every row.

    For words in windows found twice or more, the windows of a text are sorted as numbers that hold 32 bits of a hash
    and the window's place.  Neighbours of equal bits are sorted again by the whole hash; the places of those still
    equal go in order, and each adds as many words as there are to the next one, three at most.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select("doc_id", "lang", "source", text.alias("text"), F.filter(F.split(text, SPACE + "+"), lambda w: w != "").alias("w"))
    grams = split.select(
        "doc_id", "lang", "source", "text", F.size("w").cast("long").alias("n_words"),
        F.transform(F.expr("sequence(1L, greatest(size(w) - 2, 1))"), lambda i: F.when(F.size("w") > 2, F.xxhash64(F.get("w", (i - 1).cast("int")), F.get("w", i.cast("int")), F.get("w", (i + 1).cast("int"))))).alias("h"),
    )
    # place in the low bits, hash in the high bits: a sort of plain numbers
    packed = grams.withColumn("p", F.sort_array(F.expr(f"transform(filter(h, x -> x IS NOT NULL), (x, i) -> (x & ~{LOW}L) | (i & {LOW}L))")))
    near = packed.withColumn("c", F.filter("p", lambda x, i: ((i > 0) & (F.shiftright(x, 32) == F.shiftright(F.get("p", i - 1), 32))) | (F.shiftright(x, 32) == F.shiftright(F.get("p", i + 1), 32))))
    exact = near.withColumn("s", F.array_sort(F.transform("c", lambda x: F.struct(F.get("h", x.bitwiseAND(LOW).cast("int")).alias("h"), x.bitwiseAND(LOW).alias("i")))))
    again = exact.withColumn("a", F.sort_array(F.transform(F.filter("s", lambda x, i: ((i > 0) & (x.h == F.get("s", i - 1).h)) | (x.h == F.get("s", i + 1).h)), lambda x: x.i)))
    repeat = F.aggregate(F.transform("a", lambda x, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get("a", i + 1) - x, F.lit(3).cast("long")))), F.lit(0).cast("long"), lambda s, x: s + x)
    lines = F.filter(F.split("text", "\n"), lambda x: F.translate(x, " \t\n\x0b\f\r", "") != "")
    again = again.select("doc_id", "lang", "source", "text", "n_words", repeat.alias("n_repeat_words"), lines.alias("lines"))
    return again.select(
        "doc_id", "lang", "source", "n_words",
        F.length(F.translate("text", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
    )


def bucket(value: Column) -> Column:
    """Log-linear bucket of a number from 0 on: exact below 2 * SUB, then SUB buckets to a doubling."""
    shift = F.greatest(F.length(F.bin(value)) - F.length(F.bin(F.lit(SUB))), F.lit(0))
    return (shift * 4 * SUB + F.floor(value / F.pow(F.lit(2.0), shift))).cast("long")


def bucket_top(b: Column) -> Column:
    """The largest value of a bucket."""
    shift = F.floor(b / (4 * SUB))
    return ((b - shift * 4 * SUB + 1) * F.pow(F.lit(2.0), shift) - 1).cast("double")


def sketches(found: DataFrame) -> DataFrame:
    """lang, source, rate, bucket, n over the rows that pass the base rule; sketches of parts add up to that of all."""
    rates = F.explode(F.array(*(F.struct(F.lit(k).alias("rate"), bucket(F.floor(F.col(a) * SCALE / F.col(b))).alias("bucket")) for k, (a, b, _) in RATES.items()))).alias("r")
    return found.where("NOT base_failed").select("lang", "source", rates).groupBy("lang", "source", "r.rate", "r.bucket").agg(F.count("*").alias("n"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """Of each group of a sketch (lang, source, rate, bucket, n), the largest ordinary value of each rate."""
    keys = ["lang", "source", "rate"]
    whole, upto = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("bucket")
    ranked = sketch.withColumn("below", F.sum("n").over(upto)).withColumn("rows", F.sum("n").over(whole))
    q = lambda p: F.min(F.when(F.col("below") >= F.col("rows") * p, bucket_top(F.col("bucket"))))
    quartiles = ranked.groupBy(*keys).agg(q(0.25).alias("q1"), q(0.75).alias("q3"), F.max("rows").alias("rows"))
    width = F.coalesce(*(F.when(F.col("rate") == k, F.greatest(FENCE * (F.col("q3") - F.col("q1")), F.lit(float(w)))) for k, (_, _, w) in RATES.items()))
    return quartiles.select(*keys, "rows", (F.col("q3") + width).alias("most"))


def judge(docs: DataFrame) -> DataFrame:
    """The counts of every row of ``docs`` (doc_id, text, lang, source), base_failed and kept."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    found = common.stored(counts(docs).withColumn("base_failed", failed), "counts")
    sketch = common.stored(sketches(found), "sketch")
    wide = lambda t: t.groupBy("lang", "source").agg(F.max("rows").alias("rows"), *(F.max(F.when(F.col("rate") == k, F.col("most"))).alias(k) for k in RATES))
    own = wide(thresholds(sketch))
    of_lang = wide(thresholds(sketch.groupBy("lang", F.lit(None).cast("string").alias("source"), "rate", "bucket").agg(F.sum("n").alias("n"))))
    f, o, g = found.alias("f"), own.alias("o"), of_lang.alias("g")
    joined = f.join(o, F.expr("f.lang <=> o.lang AND f.source <=> o.source"), "left").join(g, F.expr("f.lang <=> g.lang"), "left")
    fine = [F.floor(F.col(f"f.{a}") * SCALE / F.col(f"f.{b}")) <= (F.col("o.rows") * F.col(f"o.{k}") + PRIOR_ROWS * F.col(f"g.{k}")) / (F.col("o.rows") + PRIOR_ROWS) for k, (a, b, _) in RATES.items()]
    kept = ~F.col("f.base_failed") & F.coalesce(fine[0] & fine[1] & fine[2] & fine[3], F.lit(False))
    return joined.select("f.doc_id", "f.n_words", "f.word_chars", "f.n_symbols", "f.n_dup_lines", "f.n_repeat_words", "f.base_failed", kept.alias("kept"))
