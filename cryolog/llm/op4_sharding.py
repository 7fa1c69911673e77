"""Balanced label propagation into shards of equal row counts, in DataFrame functions only.

Documents of equal text are linked.  All rows first get shards by their rank in a hash order, so counts are at most one
apart and a group is spread.  Then, round by round, a group's rows ask to move to one of its shards, by turns the one
where most of them are, the same among shards with unlinked rows, and any.  Requests are granted along cycles of shards
(from a to b against from b to a, or over more shards) and as far as a shard has unlinked rows to give away in exchange,
so the counts stay as they are; smaller cells go first.  Rounds work on cells, the number of a group's rows in a shard,
never on pairs or on rows: a hot group is at most as many cells as there are shards, and a group too large for one shard
fills several.  No move makes a new cell; the rounds end when QUIET of them in a row have not made cells fewer or
groups more whole.  Ranks are counted in two levels, over hash buckets and within them.

Null texts are empty and linked with empty ones.  Repeated rows are rows of their own, in any order among themselves;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

BUCKETS, SALTS, QUIET = 1024, 64, 6


def _ranked(df: DataFrame, keys: list[str], bucket: str, order: list[str]) -> DataFrame:
    """``df`` with ``rank`` from 0 within ``keys``: rows before the bucket plus the place in it."""
    sizes = df.groupBy(*keys, bucket).count()
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, bucket, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*keys, bucket).orderBy(*order)
    return df.join(starts, [*keys, bucket]).withColumn("rank", F.col("_start") + F.row_number().over(within) - 1).drop("_start")


def _by_shard(values: list[int]) -> Column:
    return F.array(*(F.lit(v).cast("long") for v in values))


def _cut(rank: Column, edges: list[int]) -> Column:
    """The range between ``edges`` (ascending, from 0) that holds ``rank``."""
    return sum((F.when(rank >= e, 1).otherwise(0) for e in edges[1:]), F.lit(0)).cast("int")


def _sums(values: list[int]) -> list[int]:
    return [sum(values[:i]) for i in range(len(values))]


def _loads(cells: DataFrame, shards: int) -> list[int]:
    found = {r.shard: r.n for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # a row for each shard
    return [found.get(s, 0) for s in range(shards)]


def granted(asked: list[list[int]], room: list[int]) -> list[list[int]]:
    """Of the rows ``asked`` from shard to shard, how many may move: those on cycles, and then as many as ``room`` has."""
    shards, left = range(len(room)), [row[:] for row in asked]
    done: set[int] = set()
    for start in shards:
        path = [start] if start not in done else []
        while path:
            u = path[-1]
            v = next((w for w in (path[-2:-1] + [*shards]) if left[u][w] > 0 and w not in done), None)
            if v is None:  # no cycle leads through it any more
                done.add(path.pop())
            elif v in path:
                at = path.index(v)
                steps = [*zip(path[at:], [*path[at + 1 :], v], strict=True)]
                least = min(left[x][y] for x, y in steps)
                for x, y in steps:
                    left[x][y] -= least
                path = path[: at + 1]
            else:
                path.append(v)
    for b in shards:
        free = room[b]
        for a in shards:
            n = min(free, left[a][b])
            left[a][b] -= n
            free -= n
    return [[n - m for n, m in zip(*rows, strict=True)] for rows in zip(asked, left, strict=True)]


def _state(cells: DataFrame, shards: int) -> tuple[list[int], tuple[int, int]]:
    """Rows by shard; cells and, as a measure of how whole the groups are, the negative sum of their squares."""
    found = cells.groupBy("shard").agg(F.sum("n").alias("n"), F.count("*").alias("cells"), F.sum(F.col("n").cast("decimal(38,0)") * F.col("n")).alias("squares")).collect()
    by = {r.shard: r.n for r in found}
    return [by.get(s, 0) for s in range(shards)], (sum(r.cells for r in found), -sum(int(r.squares) for r in found))


def propagate(cells: DataFrame, quota: list[int]) -> DataFrame:
    """``cells`` (grp, shard, n) after moves that bring groups together, within ``quota`` rows a shard."""
    shards = len(quota)
    loads, best_state = _state(cells, shards)
    turn = quiet = 0
    while quiet < QUIET:
        room = [q - n for q, n in zip(quota, loads, strict=True)]
        draw = F.xxhash64("grp", "shard", F.lit(turn))
        order = F.struct(draw, "shard") if turn % 3 == 2 else F.struct("n", draw, "shard")
        targets = cells.where(F.get(_by_shard(room), F.col("shard")) > 0) if turn % 3 == 1 else cells
        to = targets.groupBy("grp").agg(F.max_by(F.struct("shard"), order).alias("to")).select("grp", F.col("to.shard").alias("to"))
        wish = cells.join(to, "grp").where("shard <> to").withColumn("bucket", F.floor(F.log2("n")) * BUCKETS + F.pmod(F.xxhash64("grp", F.lit(turn)), F.lit(BUCKETS)))
        wish = common.stored(wish, "wish")
        totals = wish.groupBy("shard", "to", "bucket").agg(F.sum("n").alias("asked"))
        asked = [[0] * shards for _ in quota]
        for r in totals.groupBy("shard", "to").agg(F.sum("asked").alias("n")).collect():
            asked[r.shard][r.to] = r.n
        grants = [n for row in granted(asked, room) for n in row]
        turn += 1
        if any(grants):
            before = Window.partitionBy("shard", "to").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
            starts = totals.select("shard", "to", "bucket", F.coalesce(F.sum("asked").over(before), F.lit(0)).alias("start"))
            earlier = Window.partitionBy("shard", "to", "bucket").orderBy("n", "grp").rowsBetween(Window.unboundedPreceding, -1)
            ahead = wish.join(starts, ["shard", "to", "bucket"]).withColumn("ahead", F.col("start") + F.coalesce(F.sum("n").over(earlier), F.lit(0)))
            moved = F.greatest(F.lit(0), F.least("n", F.get(_by_shard(grants), F.col("shard") * shards + F.col("to")) - F.col("ahead"))).cast("long")
            moves = ahead.select("grp", "shard", "to", moved.alias("n")).where("n > 0")
            steps = F.array(F.struct("shard", (-F.col("n")).alias("n")), F.struct(F.col("to").alias("shard"), "n"))
            parts = cells.unionByName(moves.select("grp", F.inline(steps)))
            cells = common.stored(parts.groupBy("grp", "shard").agg(F.sum("n").alias("n")).where("n > 0"), "cells")
            loads, state = _state(cells, shards)
        if any(grants) and state < best_state:
            best_state, quiet = state, 0
        else:
            quiet += 1
    return cells


def assign(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row of ``docs`` (doc_id, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text, F.octet_length(text)).alias("grp"), F.xxhash64("doc_id", "text").alias("h"))
    rows = rows.withColumn("bucket", F.pmod("h", F.lit(BUCKETS)))
    many = rows.groupBy("grp").count().where("count > 1").select("grp", F.lit(True).alias("linked"))
    rows = common.stored(rows.join(many, "grp", "left").withColumn("linked", F.coalesce("linked", F.lit(False))), "rows")
    total = rows.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]

    placed = _ranked(rows, [], "bucket", ["h", "doc_id"]).where("linked")
    start = placed.groupBy("grp", _cut(F.col("rank"), _sums(quota)).alias("shard")).agg(F.count("*").alias("n"))
    cells = propagate(common.stored(start, "cells"), quota)
    loads = _loads(cells, shards)

    # linked rows: a group's members in order fill its cells, and cells follow each other in a shard
    upto = Window.partitionBy("grp").orderBy("shard")
    cells = cells.withColumn("high", F.sum("n").over(upto)).withColumn("cell", F.pmod("grp", F.lit(BUCKETS)))
    sizes = cells.groupBy("shard", "cell").agg(F.sum("n").alias("rows"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "cell", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    earlier = Window.partitionBy("shard", "cell").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    bases = cells.join(starts, ["shard", "cell"]).select("grp", "shard", "high", (F.col("high") - F.col("n")).alias("low"), (F.col("start") + F.coalesce(F.sum("n").over(earlier), F.lit(0))).alias("base"))
    members = _ranked(rows.where("linked").withColumn("salt", F.pmod("h", F.lit(SALTS))), ["grp"], "salt", ["h", "doc_id"])
    linked = members.join(bases, "grp").where("rank >= low AND rank < high").withColumn("slot", F.col("base") + F.col("rank") - F.col("low"))

    # the others fill what is left of each shard
    left = [q - n for q, n in zip(quota, loads, strict=True)]
    alone = _ranked(rows.where("NOT linked"), [], "bucket", ["h", "doc_id"]).withColumn("shard", _cut(F.col("rank"), _sums(left)))
    offset = [n - e for n, e in zip(loads, _sums(left), strict=True)]
    alone = alone.withColumn("slot", F.col("rank") + F.get(_by_shard(offset), F.col("shard")))

    columns = ["doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")]
    return linked.select(*columns).unionByName(alone.select(*columns))
