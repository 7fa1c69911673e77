"""The analysis of very long runs, dealt so that no task holds a run or a chain.

A run is cut into stretches of time, ``span`` milliseconds each.  Everything that looks back is a last value, a sum or the frame
before, so it is taken within stretches, and a row a stretch carries the rest over: first the frame before and the weight, then
the machine, then counts and sums.  Of the machine a stretch is followed for each way that it can be entered (dry or not, hot
or not), and its row tells which one it was.  Only these small rows are ever put in order for a whole run.

Results are those of ``reanalysis.analysed``, but that energy is summed in another order.  Segments and cycles of the rows
are those of ``analysis``, which orders segments and loops only.  A null time goes with null stretches, as the first frames of its run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.profile import Profile
from . import analysis as an

DAY, HOUR = 86_400_000, 3_600_000
BEFORE = (Window.unboundedPreceding, -1)


def _part(ms: Column, span: int) -> Column:
    return F.floor(ms / F.lit(span))


def _run() -> WindowSpec:
    return Window.partitionBy("_part.run_id").orderBy("_part")


def _inner() -> WindowSpec:
    return Window.partitionBy("_part").orderBy(*an.ORDER)


def _place() -> Column:
    return F.struct(*an.ORDER)


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _last(event: Column, over: WindowSpec) -> Column:
    return F.last(event, ignorenulls=True).over(over)


def _carry(rows: DataFrame, carry: DataFrame) -> DataFrame:
    """``rows`` with what is carried into their stretch; rows stay where they are and in order."""
    return rows.join(carry.hint("shuffle_hash"), "_part", "left")


def with_basics(frames: DataFrame, p: Profile, span: int = HOUR) -> DataFrame:
    """gap_min, reset and _first (of a chain) by the frame before, its _power and ``_again`` (it met the start condition), the last ``_weight`` before, and ``_part``."""
    rows = an.with_shelves(frames, p).withColumn("_part", F.struct("run_id", _part(F.col("ms"), span).alias("part")))
    rows = rows.withColumn("_s", _true((F.col("active") > 0) & (F.col("VACUM") < p.start_vacuum_upper)))
    frame = F.struct("ms", F.col("`E.GUC`").alias("power"), F.col("_s").alias("s"))
    each = rows.groupBy("_part").agg(F.max_by(frame, _place()).alias("last"), F.max_by("TARTIM", F.when(F.col("TARTIM").isNotNull(), _place())).alias("weight"))
    rows = _carry(rows, each.select("_part", F.lag("last").over(_run()).alias("_carried"), _last(F.col("weight"), _run().rowsBetween(*BEFORE)).alias("_carried_weight")))
    rows = rows.withColumns({
        "_before": F.coalesce(F.lag(frame).over(_inner()), "_carried"), "_weight": F.coalesce(_last(F.col("TARTIM"), _inner().rowsBetween(*BEFORE)), "_carried_weight"),
    }).withColumn("gap_min", (F.col("ms") - F.col("_before.ms")) / 60000.0)
    reset = _true(F.col("gap_min") > p.state_reset_gap_minutes)
    return rows.withColumns({
        "reset": reset.cast("int"), "_first": reset | F.col("_before").isNull(), "_power": F.col("_before.power"), "_again": _true(F.col("_before.s")),
    }).drop("_carried", "_carried_weight", "_before")


def with_states(rows: DataFrame, p: Profile) -> DataFrame:
    """``chain`` and ``state`` of each frame of ``with_basics``, see ``analysis.with_states``."""
    if p.start_vacuum_upper > p.stop_vacuum_lower:
        raise ValueError("start_vacuum_upper lies above stop_vacuum_lower")
    s, first, again = F.col("_s"), F.col("_first"), F.col("_again") & ~F.col("_first")
    stopped = _true((F.col("active") == 0) | (F.col("VACUM") > p.stop_vacuum_lower))
    hot, low = _true(F.col("coil") >= p.defrost_start_temperature_c), _true(F.col("`E.GUC`") < p.defrost_stop_power_upper)
    earlier = _inner().rowsBetween(*BEFORE)
    upto = _inner().rowsBetween(Window.unboundedPreceding, 0)
    dries = F.when(first | stopped, F.lit(False)).when(s & again, F.lit(True))
    rows = rows.withColumns({"_dry": _last(dries, upto), "_was_dry": _last(dries, earlier)})

    def machine(entered: Column) -> tuple[Column, Column, Column, Column]:
        """dry, stop, whether a stretch begins and goes on, if the part was ``entered`` dry or not."""
        dry, was = F.coalesce("_dry", entered), F.coalesce("_was_dry", entered) | F.col("_again")
        on = s | dry
        return dry, ~on & ~first & was, (~on & (first | was)) | (s & ~dry), ~on & ~first & ~was

    ways, heat, ends = (F.lit(False), F.lit(True)), {}, {}
    for h, way in enumerate(ways):
        _, _, begins, later = machine(way)
        heats = F.when(begins, F.lit(False)).when(later & hot, F.lit(True))
        heat |= {f"_hot{h}": _last(heats, upto), f"_was_hot{h}": _last(heats, earlier)}
        for g, warm in enumerate(ways):
            ends[f"_end{h}{g}"] = _last(F.when(begins, F.lit(False)).when(later & low & F.coalesce(f"_was_hot{h}", warm), F.lit(True)), upto)
    rows = rows.withColumns(heat).withColumns(ends).withColumn("_resets", F.sum("reset").over(upto))
    last = ["_dry", "_hot0", "_hot1", *ends, "_resets"]
    each = rows.groupBy("_part").agg(F.max_by(F.struct(*last), _place()).alias("last")).select("_part", "last.*")
    before = _run().rowsBetween(*BEFORE)
    carried = lambda c: _true(_last(c, before))
    heated = F.when(F.col("_in_dry"), F.col("_hot1")).otherwise(F.col("_hot0"))
    ended = F.when(F.col("_in_dry"), F.when(F.col("_in_hot"), F.col("_end11")).otherwise(F.col("_end10"))).otherwise(F.when(F.col("_in_hot"), F.col("_end01")).otherwise(F.col("_end00")))
    each = each.withColumns({"_in_dry": carried(F.col("_dry")), "_chain": F.coalesce(F.sum("_resets").over(before), F.lit(0))})
    each = each.withColumn("_in_hot", carried(heated)).withColumn("_in_end", carried(ended)).select("_part", "_in_dry", "_in_hot", "_in_end", "_chain")
    rows = _carry(rows, each)
    dry, stop, _, _ = machine(F.col("_in_dry"))
    state = (
        F.when(dry, "DRY").when(s, "START").when(stop, "STOP")
        .when(F.coalesce(ended, "_in_end"), "DEFROST_STOP").when(F.coalesce(heated, "_in_hot"), "DEFROST").otherwise("WAIT")
    )
    rows = rows.withColumns({"state": state, "chain": F.col("_chain") + F.col("_resets")})
    return rows.drop("_s", "_again", "_was_dry", "_was_hot0", "_was_hot1", "_in_dry", "_in_hot", "_in_end", "_chain", *last)


def analysed(frames: DataFrame, p: Profile, span: int = HOUR) -> DataFrame:
    """Frames with chain, state, segment, loop and derived values."""
    rows = with_states(with_basics(frames, p, span), p)
    power, near = F.col("`E.GUC`"), (F.col("gap_min") >= 0) & (F.col("gap_min") <= p.maximum_energy_gap_minutes)
    starts = F.col("state") == "START"
    enters = F.when(F.lag("state").over(_inner()).isNotNull(), F.col("_first") | (F.lag("state").over(_inner()) != F.col("state"))).otherwise(False)  # the first of a stretch: below
    rows = rows.withColumns({"_enters": enters, "interval_kwh": F.when(near, (F.col("_power") + power) / 2.0 * (F.col("gap_min") / 60.0))})
    upto = _inner().rowsBetween(Window.unboundedPreceding, 0)
    sums = {"segment": F.col("_enters").cast("int"), "loop": (F.col("_enters") & starts).cast("int"), "cumulative_kwh": F.col("interval_kwh")}
    rows = rows.withColumns({name: F.sum(of).over(upto) for name, of in sums.items()} | {"_seen": _last(F.when(starts, F.lit(True)).when(F.col("_first"), F.lit(False)), upto)})
    each = rows.groupBy("_part").agg(F.min_by(F.struct("state", "_first"), _place()).alias("first"), F.max_by(F.struct("state", *sums, "_seen"), _place()).alias("last"))
    opens = F.col("first._first") | F.coalesce(F.lag("last.state").over(_run()) != F.col("first.state"), F.lit(True))
    each = each.withColumn("segment", opens.cast("int")).withColumns({"loop": F.when(F.col("first.state") == "START", F.col("segment")).otherwise(0), "cumulative_kwh": F.lit(0.0)})
    before = _run().rowsBetween(*BEFORE)
    whole = {name: F.coalesce(F.col(f"last.{name}"), F.lit(0)) + F.col(name) for name in sums}
    carry = each.select("_part", *((F.coalesce(F.sum(of).over(before), F.lit(0)) + F.col(name)).alias(f"_{name}") for name, of in whole.items()), _last(F.col("last._seen"), before).alias("_in_seen"))
    return _carry(rows, carry).withColumns({
        "segment": F.col("segment") + F.col("_segment"), "loop": F.when(F.coalesce("_seen", "_in_seen"), F.col("loop") + F.col("_loop")),
        "cumulative_kwh": F.when(power.isNotNull(), F.coalesce("cumulative_kwh", F.lit(0.0)) + F.col("_cumulative_kwh")),
        "weight_delta": F.col("TARTIM") - F.col("_weight"), "deviation": F.col("S4") - F.col("S2"),
    }).drop("_part", "_first", "_power", "_weight", "_enters", "_seen", "_in_seen", *(f"_{name}" for name in sums))


def resets(rows: DataFrame, p: Profile) -> DataFrame:
    """``analysis.resets`` of ``analysed`` rows: every chain but the first begins with one."""
    each = rows.groupBy("run_id", "chain").agg(F.min_by(F.struct("seq", "ms", "gap_min"), _place()).alias("first"), F.max_by(F.struct("seq", "loop"), _place()).alias("last"))
    found = each.withColumn("before", F.lag("last").over(Window.partitionBy("run_id").orderBy("chain"))).where("before IS NOT NULL")
    return found.select("run_id", "first.seq", "first.ms", F.lit("fd750_state_chain_reset").alias("event_type"), F.col("before.loop").alias("loop"), "first.gap_min", F.lit(p.state_reset_gap_minutes).alias("limit_min"), F.col("before.seq").alias("previous_seq"))


def parallel_events(rows: DataFrame, p: Profile, span: int = DAY) -> DataFrame:
    """``analysis.parallel_events`` of ``analysed`` rows: a stretch also holds the end of the one before it, as far as a frame looks back."""
    far = int((p.parallel_window_minutes + p.parallel_window_tolerance_minutes) * 60000)
    if span < far:
        raise ValueError("a stretch is shorter than what a frame looks back over")
    own, last = _part(F.col("ms"), span), _part(F.col("ms") + far, span)
    dealt = rows.withColumn("_at", F.explode(F.sequence(own, last)))
    found = an.parallel_events(dealt.withColumn("run_id", F.struct("run_id", F.col("_at").alias("part"))), p)
    return found.where(F.col("run_id.part") == own).withColumn("run_id", F.col("run_id.run_id"))
