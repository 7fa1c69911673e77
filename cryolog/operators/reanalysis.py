"""Analysing a run anew from the first chain that new frames touch, with what is stored of the chain before it.

States start anew in each chain, so all that a chain hands on is counts and sums: its number, segments and loops so far, energy,
the last weight, and its last frame, which the next gap is measured from.  That is a row a chain (``chain_ends``).

A new frame falls into a chain, behind one or before all of them; it can lengthen a chain, tie two together or make one of its
own, but never part one.  So nothing before the last chain that begins earlier than the first new frame can change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.profile import Profile
from . import analysis as an


def analysed(frames: DataFrame, p: Profile) -> DataFrame:
    """Frames with chain, state, segment, loop and derived values."""
    return an.with_derived(an.with_loops(an.with_states(an.with_basics(frames, p), p)), p)


def chain_ends(rows: DataFrame, frame_columns: list[str]) -> DataFrame:
    """What each chain of ``rows`` (see ``analysed``) hands on; ``frame_columns``: those of a frame under their first names."""
    run = Window.partitionBy("run_id").orderBy("chain")
    last = F.max_by(F.struct(*(f"`{c}`" for c in frame_columns if c != "run_id")), F.struct(*an.ORDER)).alias("last")
    weight = F.max_by("TARTIM", F.when(F.col("TARTIM").isNotNull(), F.struct(*an.ORDER))).alias("weight")
    each = rows.groupBy("run_id", "chain").agg(F.min("ms").alias("started_ms"), F.max("segment").alias("segments"), F.max("loop").alias("loops"), F.sum("interval_kwh").alias("energy"), weight, last)
    return each.withColumns({
        "loops": F.coalesce(F.max("loops").over(run), F.lit(0).cast("long")), "energy": F.coalesce(F.sum("energy").over(run), F.lit(0.0)), "weight": F.last("weight", ignorenulls=True).over(run),
    })


def resumption(ends: DataFrame, new: DataFrame) -> DataFrame:
    """Of each run with ``new`` frames: from_ms, where the chain begins that is the first to be analysed anew (null: all of it), and
    ``carry``, the end of the chain before it if there is one.  ``ends`` is in force until this is used."""
    first = new.groupBy("run_id").agg(F.min("ms").alias("new_ms"))
    earlier = first.join(ends.select("run_id", "chain", F.col("started_ms").alias("_from")), "run_id").where("_from < new_ms")
    cut = earlier.groupBy("run_id").agg(F.max_by("_from", "chain").alias("from_ms"), (F.max("chain") - 1).alias("_before"))
    carry = ends.select("run_id", F.col("chain").alias("_before"), F.struct(*(c for c in ends.columns if c not in ("run_id", "started_ms"))).alias("carry"))
    return first.join(cut, "run_id", "left").join(carry, ["run_id", "_before"], "left").select("run_id", "from_ms", "carry")


def resumed_frames(frames: DataFrame, at: DataFrame) -> DataFrame:
    """The frames that are analysed anew, of the runs of ``at`` (see ``resumption``) only."""
    return frames.join(at.select("run_id", "from_ms"), "run_id").where("from_ms IS NULL OR ms >= from_ms").drop("from_ms")


def resume(frames: DataFrame, at: DataFrame, p: Profile, parts: int | None = None) -> DataFrame:
    """``analysed`` rows of ``resumed_frames``, as an analysis of all ``frames`` would give them; ``parts``: how many the runs
    are dealt to (as many as the session shuffles to)."""
    frames = an.with_lookups(frames)
    names = frames.columns
    part = resumed_frames(frames, at).withColumn("_carried", F.lit(False))
    last = {c: F.col("run_id") if c == "run_id" else F.col("carry.weight") if c == "TARTIM" else F.col(f"carry.last.`{c}`") for c in names}
    before = at.where("carry IS NOT NULL").select(*(v.alias(c) for c, v in last.items()), F.lit(True).alias("_carried"))
    part = part.unionByName(before)
    part = part.repartition(parts, "run_id") if parts else part
    rows = analysed(part, p)  # the last frame before stands first, in a chain of its own
    run = Window.partitionBy("run_id")
    stood = F.max(F.col("_carried").cast("int")).over(run)
    looped = F.max((F.col("_carried") & (F.col("state") == "START")).cast("int")).over(run)
    rows = rows.withColumns({"_stood": stood, "_looped": looped}).where("NOT _carried").join(at.select("run_id", "carry"), "run_id")
    of = lambda name, none: F.coalesce(F.col(f"carry.{name}"), F.lit(none))
    return rows.withColumns({
        "chain": F.col("chain") - F.col("_stood") + of("chain", -1) + 1, "segment": F.col("segment") - F.col("_stood") + of("segments", 0),
        "loop": F.col("loop") - F.col("_looped") + of("loops", 0), "cumulative_kwh": F.col("cumulative_kwh") + of("energy", 0.0),
    }).drop("_carried", "_stood", "_looped", "carry")


def merged(stored: DataFrame, fresh: DataFrame, at: DataFrame) -> DataFrame:
    """``stored`` analysed rows, those that were analysed anew replaced by ``fresh``."""
    kept = stored.join(at.select("run_id", F.col("from_ms").alias("_from"), F.lit(True).alias("_touched")), "run_id", "left")
    return kept.where("_touched IS NULL OR ms < _from").drop("_from", "_touched").unionByName(fresh)
