"""Document fingerprints by consistent weighted sampling, in DataFrame functions alone.

A text is a weighted set: its words between white space, weighted by how often they occur.  For each of LANES samples, a term x of
weight w draws r and c from Gamma(2, 1) and b from (0, 1), all from a hash of x and the lane, so that every text
draws alike, and becomes t = floor(ln w / r + b), ln a = ln c - r (t - b + 1).  The sample is (x, t) of the term of the
smallest a.  Two texts have the same sample with a probability that equals their generalised Jaccard similarity, the
sum over terms of the smaller weight through that of the larger.

A lane's minimum and its sample are one 64-bit number: ln a in steps of 2**-38 above, 16 bits of a hash of (x, t) below.  So a
lane is a plain ``min`` with partial aggregation, no sort and no list of a document's terms.  Different samples
agree by chance in one lane of 65 536.

Null texts are empty.  A text without words is the set of one empty term, so all of these are alike.  Rows of the same id
and text are one document and get the same result; the order is by id, null first, then by a hash of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

LANES, PART_BYTES = 32, 6 << 20
_KEY = ["_id", "_row"]
_SALT = 0x9E3779B97F4A7C15  # 2**64 through the golden ratio


def words(text: Column) -> Column:
    """The words of ``text``, in order and repeated; the empty term where there is none."""
    return F.split(F.btrim(text, F.lit(" \t\n\x0b\f\r")), "[\\x20\\x09-\\x0D]+")


def _uniform(bits: Column, width: int) -> Column:
    return (bits.bitwiseAND((1 << width) - 1) + F.lit(0.5)) * F.lit(2.0**-width)


def _lane(k: int) -> Column:
    """Sample ``k`` of term ``x`` with ``ln_w``: the value to be least, and the sample's bits."""
    h, g = (F.xxhash64(F.col("x").bitwiseXOR(F.lit(_SALT * (2 * k + i + 1) & (1 << 63) - 1))) for i in (0, 1))
    r = -F.ln(_uniform(h, 32) * _uniform(F.shiftrightunsigned(h, 32), 32))
    ln_c = F.ln(-F.ln(_uniform(g, 21) * _uniform(F.shiftrightunsigned(g, 21), 21)))
    b = _uniform(F.shiftrightunsigned(g, 42), 22)
    t = F.floor(F.col("ln_w") / r + b)
    rank = ((ln_c - r * (t - b + F.lit(1.0)) + F.lit(128.0)) * F.lit(2.0**38)).cast("long")
    sample = F.col("x").bitwiseXOR(t * F.lit(127)).bitwiseAND(0xFFFF)
    return F.shiftleft(rank, 16).bitwiseOR(sample)


def signatures(weighted: DataFrame, keys: list[str]) -> DataFrame:
    """``weighted`` (keys, x long, w): a row a key with lanes, its least values and their samples."""
    rows = weighted.select(*keys, "x", F.ln(F.col("w").cast("double")).alias("ln_w"))
    lanes = rows.groupBy(*keys).agg(*(F.min(_lane(k)).alias(f"l{k}") for k in range(LANES)))
    return lanes.select(*keys, F.array(*(f"l{k}" for k in range(LANES))).alias("lanes"))


def fingerprint(lanes: Column) -> Column:
    """Four hexadecimal digits a lane."""
    return F.lower(F.array_join(F.transform(lanes, lambda v: F.lpad(F.hex(v.bitwiseAND(0xFFFF)), 4, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """The share of lanes with the same sample, an estimate of the generalised Jaccard similarity."""
    same = F.filter(F.arrays_zip(a.alias("a"), b.alias("b")), lambda p: p["a"].bitwiseXOR(p["b"]).bitwiseAND(0xFFFF) == 0)
    return F.size(same) / F.lit(float(LANES))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row of ``docs`` (doc_id, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").alias("_doc"), *common.row_key(), text.alias("_text"))
    one = rows.groupBy(*_KEY).agg(F.first("_doc").alias("doc_id"), F.first("_text").alias("text"), F.count("*").alias("copies"))
    found = one.select(*_KEY, "doc_id", "copies", F.explode(words(F.col("text"))).alias("word"))
    weighted = found.groupBy(*_KEY, "doc_id", "copies", F.xxhash64("word").alias("x")).agg(F.count("*").alias("w"))
    signed = signatures(weighted, [*_KEY, "doc_id", "copies"])
    return signed.select("doc_id", fingerprint(F.col("lanes")).alias("fingerprint"), F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).drop("col")


def _order(docs: DataFrame) -> DataFrame:
    """Each document once, by its key, with its number of characters and the keys of the next and the previous one.

    Keys are dealt by ranges and stored with their range's number; the first and last of a range, one row each, are
    joined to the neighbouring ranges.
    """
    n_chars = F.char_length(F.coalesce(F.col("text"), F.lit(""))).cast("long")
    keys = docs.select(*common.row_key(), n_chars.alias("n_chars")).distinct()
    ranges = common.stored(keys.repartitionByRange(*_KEY).withColumn("part", F.spark_partition_id()), "order")
    me = F.struct(*_KEY, "n_chars")
    ends = ranges.groupBy("part").agg(F.min(me).alias("first"), F.max(me).alias("last"))
    by_part, all_parts = Window.orderBy("part"), Window.partitionBy()  # a row a range
    around = ends.select("part", F.coalesce(F.lead("first").over(by_part), F.min("first").over(all_parts)).alias("after"), F.coalesce(F.lag("last").over(by_part), F.max("last").over(all_parts)).alias("before"))
    within = Window.partitionBy("part").orderBy(*_KEY)
    linked = ranges.withColumn("next", F.lead(me).over(within)).withColumn("prev", F.lag(me).over(within)).join(F.broadcast(around), "part", "left")
    return linked.select(*_KEY, F.coalesce("next", "after").alias("next"), F.coalesce("prev", "before").alias("prev"))


def compare_edited(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) against its text with the last quarter of its characters replaced by the first
    ones of the next document, and against that document: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    Terms of the same weight in a text and its edited form are sampled once for both.
    """
    links = common.stored(_order(docs), "links")
    text = F.coalesce(F.col("text"), F.lit(""))
    parts = common.parts_for(docs, PART_BYTES)
    rows = docs.select(*common.row_key(), F.struct("doc_id", text.alias("text")).alias("doc")).repartition(parts, *_KEY)
    once = rows.groupBy(*_KEY).agg(F.first("doc").alias("doc"), F.count("*").alias("copies"))
    quarter = F.floor(F.col("prev.n_chars") / 4).cast("int")
    heads = once.join(links.select(*_KEY, "prev").hint("shuffle_hash"), _KEY).select(F.col("prev._id").alias("_id"), F.col("prev._row").alias("_row"), F.expr("substring(doc.text, 1, CAST(prev.n_chars DIV 4 AS INT))").alias("head"))
    both = once.join(heads.repartition(parts, *_KEY).hint("shuffle_hash"), _KEY)
    n = F.char_length("doc.text")
    edited = F.concat(F.substring(F.col("doc.text"), F.lit(1), n - F.floor(n / 4).cast("int")), F.col("head"))
    pair = both.select(*_KEY, "doc", "copies", edited.alias("edited"))

    texts = pair.select(*_KEY, F.inline(F.array(F.struct(F.lit(True).alias("old"), F.col("doc.text").alias("text")), F.struct(F.lit(False).alias("old"), F.col("edited").alias("text")))))
    counts = texts.select(*_KEY, "old", F.explode(words(F.col("text"))).alias("word")).groupBy(*_KEY, F.xxhash64("word").alias("x")).agg(F.count_if("old").alias("own"), F.count_if(~F.col("old")).alias("new"))
    kinds = F.when(F.col("own") == F.col("new"), F.array(F.struct(F.lit(0).alias("kind"), F.col("own").alias("w")))).otherwise(
        F.array(F.struct(F.lit(1).alias("kind"), F.col("own").alias("w")), F.struct(F.lit(2).alias("kind"), F.col("new").alias("w")))
    )
    signed = signatures(counts.select(*_KEY, "x", F.inline(kinds)).where("w > 0"), [*_KEY, "kind"])
    of = lambda k: F.max(F.when(F.col("kind") == k, F.col("lanes")))
    least = lambda a, b: F.coalesce(F.zip_with(a, b, lambda x, y: F.least(x, y)), a, b)
    found = signed.groupBy(*_KEY).agg(of(0).alias("shared"), of(1).alias("own"), of(2).alias("new"))
    found = found.select(*_KEY, least(F.col("shared"), F.col("own")).alias("lanes"), least(F.col("shared"), F.col("new")).alias("edited_lanes"))
    facts = pair.select(*_KEY, F.col("doc.doc_id").alias("doc_id"), "copies", F.char_length("doc.text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    signed = common.stored(facts.join(found, _KEY), "signed")

    following = signed.select(F.col("_id").alias("next_id"), F.col("_row").alias("next_row"), F.col("lanes").alias("next_lanes"))
    named = links.select(*_KEY, F.col("next._id").alias("next_id"), F.col("next._row").alias("next_row"))
    out = signed.join(named, _KEY).join(following, ["next_id", "next_row"])
    return out.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("lanes")).alias("fingerprint"), fingerprint(F.col("edited_lanes")).alias("edited_fingerprint"),
        likeness(F.col("lanes"), F.col("edited_lanes")).alias("near_edited"), likeness(F.col("lanes"), F.col("next_lanes")).alias("near_next"),
        F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy"),
    ).drop("copy")
