"""States, cycles, diagnostics and derived values of runs, with built-in windows only.

A frame table is wide: run_id, seq, ms (epoch milliseconds), the channels of the profile and run_status.  All windows
partition by run first, so one shuffle serves them and a run is one task; ``dealt`` has the same for very long runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.profile import COILS, LOOKUPS, SHELVES, Profile

ORDER = ["ms", "seq"]


def shelf_off(value: Column, p: Profile) -> Column:
    return F.abs(value - p.shelf_off_value) <= p.shelf_off_tolerance


def with_lookups(frames: DataFrame) -> DataFrame:
    """The channels of the rules, each by the first of its names that a frame has a value for; their other names go."""
    present = {code: [n for n in names if n in frames.columns] for code, names in LOOKUPS.items()}
    values = {code: F.coalesce(*(F.col(f"`{n}`") for n in names)) for code, names in present.items() if names}
    return frames.withColumns(values).drop(*(n for code, names in present.items() for n in names if n != code))


def with_shelves(frames: DataFrame, p: Profile) -> DataFrame:
    """active (shelves on) and coil (hottest); the channels of the rules go by their first names, see ``with_lookups``."""
    frames = with_lookups(frames)
    have = [c for c in SHELVES if c in frames.columns]
    active = sum((F.coalesce((~shelf_off(F.col(c), p)).cast("int"), F.lit(0)) for c in have), F.lit(0))
    coils = [F.when(~shelf_off(F.col(c), p), F.col(c)) for c in COILS if c in frames.columns]
    coil = F.greatest(*coils) if len(coils) > 1 else coils[0] if coils else F.lit(None).cast("double")
    return frames.withColumns({"active": active, "coil": coil})


def with_basics(frames: DataFrame, p: Profile) -> DataFrame:
    """``with_shelves``, and gap_min to the frame before and chain (a new one after a gap beyond the limit)."""
    run = Window.partitionBy("run_id").orderBy(*ORDER)
    out = with_shelves(frames, p).withColumn("gap_min", (F.col("ms") - F.lag("ms").over(run)) / 60000.0)
    reset = F.coalesce(F.col("gap_min") > p.state_reset_gap_minutes, F.lit(False)).cast("int")
    return out.withColumn("reset", reset).withColumn("chain", F.sum("reset").over(run))


def with_states(frames: DataFrame, p: Profile) -> DataFrame:
    """``state`` of each frame of ``with_basics``; see the README for why these windows equal the state machine.

    They do as long as no frame can meet the start and the stop condition by its vacuum, which the profile is checked for.
    """
    if p.start_vacuum_upper > p.stop_vacuum_lower:
        raise ValueError("start_vacuum_upper lies above stop_vacuum_lower")
    true = lambda c: F.coalesce(c, F.lit(False))
    chain = Window.partitionBy("run_id", "chain").orderBy(*ORDER)
    block = Window.partitionBy("run_id", "chain", "blk").orderBy(*ORDER)
    stretch = Window.partitionBy("run_id", "chain", "stretch").orderBy(*ORDER)
    started = true((F.col("active") > 0) & (F.col("VACUM") < p.start_vacuum_upper))
    stopped = true((F.col("active") == 0) | (F.col("VACUM") > p.stop_vacuum_lower))
    out = frames.withColumns({
        "s": started, "stop": stopped, "hot": true(F.col("coil") >= p.defrost_start_temperature_c), "low": true(F.col("`E.GUC`") < p.defrost_stop_power_upper),
    }).withColumn("blk", F.sum(F.col("stop").cast("int")).over(chain))
    twice = F.col("s") & true(F.lag("s").over(block))
    out = out.withColumn("twice", twice).withColumn("dry", F.max(F.col("twice").cast("int")).over(block) == 1)
    out = out.withColumn("start", F.col("s") & ~F.col("dry")).withColumn("indry", F.col("start") | F.col("dry"))
    out = out.withColumn("before", F.lag("indry").over(chain))
    stop = ~F.col("indry") & true(F.col("before"))
    idle = ~F.col("indry") & (F.col("before").isNull() | F.col("before"))
    out = out.withColumns({"is_stop": stop, "stretch": F.sum((idle | F.col("start")).cast("int")).over(chain)})
    later = (F.row_number().over(stretch) > 1) & ~F.col("indry")
    out = out.withColumn("defrost", F.max((later & F.col("hot")).cast("int")).over(stretch) == 1)
    out = out.withColumn("ended", F.max((later & F.col("low") & true(F.lag("defrost").over(stretch))).cast("int")).over(stretch) == 1)
    state = (
        F.when(F.col("dry"), "DRY").when(F.col("start"), "START").when(F.col("is_stop"), "STOP")
        .when(F.col("ended"), "DEFROST_STOP").when(F.col("defrost"), "DEFROST").otherwise("WAIT")
    )
    return out.withColumn("state", state).drop("s", "stop", "hot", "low", "blk", "twice", "dry", "start", "indry", "before", "is_stop", "stretch", "defrost", "ended")


def with_loops(frames: DataFrame) -> DataFrame:
    """``segment`` (within the run) and ``loop`` (null before the first START of a chain) of each frame with a state."""
    run, chain = Window.partitionBy("run_id").orderBy(*ORDER), Window.partitionBy("run_id", "chain").orderBy(*ORDER)
    new = F.coalesce(F.lag("state").over(chain) != F.col("state"), F.lit(True))
    out = frames.withColumn("enters", new)
    begins = (F.col("enters") & (F.col("state") == "START")).cast("int")
    out = out.withColumn("begins", begins).withColumn("segment", F.sum(F.col("enters").cast("int")).over(run))
    seen = F.sum("begins").over(chain) > 0
    return out.withColumn("loop", F.when(seen, F.sum("begins").over(run))).drop("enters", "begins")


def segments(looped: DataFrame) -> DataFrame:
    """A row for each stay in a state: start, end (of the last one of a running run null), end frame and confidence."""
    found = looped.groupBy("run_id", "segment").agg(
        F.first("state").alias("state"), F.first("chain").alias("chain"), F.first("loop").alias("loop"), F.min("ms").alias("started_ms"),
        F.max("ms").alias("last_ms"), F.min("seq").alias("start_seq"), F.max_by("seq", F.struct("ms", "seq")).alias("end_seq"), F.count("*").alias("frames"), F.first("run_status").alias("run_status"),
    )
    run = Window.partitionBy("run_id").orderBy("segment")
    following, next_chain = F.lead("started_ms").over(run), F.lead("chain").over(run)
    end = (
        F.when(next_chain == F.col("chain"), following).when(next_chain.isNotNull(), F.col("last_ms"))
        .when(F.col("run_status") != "running", F.col("last_ms"))
    )
    return found.withColumn("finished_ms", end).withColumn("confidence", F.when(F.col("loop").isNotNull(), 0.95).otherwise(0.55)).drop("last_ms")


def cycles(looped: DataFrame) -> DataFrame:
    """A row for each loop: milestones, end, status and confidence."""
    first = lambda s: F.min(F.when(F.col("state") == s, F.col("ms")))
    found = looped.groupBy("run_id", "chain", "loop").agg(
        F.min("ms").alias("started_ms"), F.max("ms").alias("last_ms"), first("DRY").alias("dry_ms"), first("STOP").alias("stop_ms"), first("WAIT").alias("wait_ms"),
        first("DEFROST").alias("defrost_ms"), first("DEFROST_STOP").alias("defrost_stop_ms"), F.first("run_status").alias("run_status"),
    )
    run, chain = Window.partitionBy("run_id"), Window.partitionBy("run_id", "chain")  # ends of runs and chains are those of their loops and of what is in none
    found = found.withColumns({"run_last_ms": F.max("last_ms").over(run), "run_last_chain": F.max("chain").over(run), "chain_last_ms": F.max("last_ms").over(chain)}).where("loop IS NOT NULL")
    loops = Window.partitionBy("run_id").orderBy("loop")
    next_start, next_chain = F.lead("started_ms").over(loops), F.lead("chain").over(loops)
    ended, running = F.col("defrost_stop_ms").isNotNull(), F.col("run_status") == "running"
    kind = (
        F.when(next_chain == F.col("chain"), F.when(ended, "ended").otherwise("restarted"))
        .when(F.col("chain") < F.col("run_last_chain"), F.when(ended, "ended").otherwise("reset"))
        .when(running, F.when(ended, "ended").otherwise("active")).otherwise(F.when(ended, "closed").otherwise("incomplete"))
    )
    found = found.withColumn("next_ms", next_start).withColumn("kind", kind)
    by = lambda **v: F.coalesce(*(F.when(F.col("kind") == k, x) for k, x in v.items()))
    return found.select(
        "run_id", "loop", "started_ms", "dry_ms", "stop_ms", "wait_ms", "defrost_ms", "defrost_stop_ms",
        by(ended=F.col("defrost_stop_ms"), restarted=F.col("next_ms"), reset=F.col("chain_last_ms"), closed=F.col("run_last_ms"), incomplete=F.col("run_last_ms")).alias("finished_ms"),
        by(ended=F.lit("completed"), restarted=F.lit("completed"), reset=F.lit("interrupted"), active=F.lit("active"), closed=F.lit("completed"), incomplete=F.lit("incomplete")).alias("status"),
        by(ended=F.lit(0.98), restarted=F.lit(0.82), reset=F.lit(0.45), active=F.lit(0.95), closed=F.lit(0.90), incomplete=F.lit(0.60)).alias("confidence"),
    )


def resets(looped: DataFrame, p: Profile) -> DataFrame:
    """A diagnostic for each chain reset, with the loop that was open before the gap."""
    run = Window.partitionBy("run_id").orderBy(*ORDER)
    out = looped.withColumns({"previous_seq": F.lag("seq").over(run), "previous_loop": F.lag("loop").over(run)})
    return out.where("reset = 1").select("run_id", "seq", "ms", F.lit("fd750_state_chain_reset").alias("event_type"), F.col("previous_loop").alias("loop"), "gap_min", F.lit(p.state_reset_gap_minutes).alias("limit_min"), "previous_seq")


def parallel_events(looped: DataFrame, p: Profile) -> DataFrame:
    """Recovery and rise of the S4-S2 deviation against the frame nearest to half an hour before."""
    ms = lambda minutes: int(minutes * 60000)
    back, slack = ms(p.parallel_window_minutes), ms(p.parallel_window_tolerance_minutes)
    peers = Window.partitionBy("run_id").orderBy("ms").rangeBetween(Window.unboundedPreceding, 0)
    rows = looped.withColumn("at_loop", F.last("loop").over(peers))
    row = F.struct("ms", "seq", (F.col("S4") - F.col("S2")).alias("deviation"), F.col("VACUM").alias("vacuum"))
    rows = rows.where("S2 IS NOT NULL AND S4 IS NOT NULL AND VACUM IS NOT NULL").withColumn("row", row)
    time = Window.partitionBy("run_id").orderBy("ms")
    early = F.max_by("row", F.struct("ms", -F.col("seq"))).over(time.rangeBetween(-back - slack, -back))
    late = F.min_by("row", F.struct("ms", "seq")).over(time.rangeBetween(-back, -back + slack))
    rows = rows.withColumns({"early": early, "late": late})
    far = lambda c: F.abs(F.col("ms") - back - F.col(f"{c}.ms"))
    prior = F.when(F.col("late").isNull() | (far("early") <= far("late")), F.col("early")).otherwise(F.col("late"))
    rows = rows.withColumn("prior", prior).where("prior IS NOT NULL")
    rows = rows.withColumns({
        "change": F.col("row.deviation") - F.col("prior.deviation"), "recovery": F.abs("prior.deviation") - F.abs("row.deviation"), "vacuum_change": F.col("VACUM") - F.col("prior.vacuum"),
    })
    least, vacuum = p.minimum_s4_s2_change_c, p.minimum_vacuum_change
    kind = F.when((F.col("recovery") >= least) & (F.col("vacuum_change") <= -vacuum), "fd750_s4_vacuum_recovery").when((F.col("change") >= least) & (F.col("vacuum_change") >= vacuum), "fd750_s4_vacuum_rise")
    return rows.select("run_id", "seq", "ms", F.col("prior.seq").alias("prior_seq"), F.col("at_loop").alias("loop"), F.round("change", 6).alias("change"), F.round("recovery", 6).alias("recovery"), F.round("vacuum_change", 6).alias("vacuum_change"), kind.alias("event_type"))


def with_derived(frames: DataFrame, p: Profile) -> DataFrame:
    """Interval and cumulative energy, weight change and coil spread of each frame of ``with_basics``."""
    run = Window.partitionBy("run_id").orderBy(*ORDER)
    power = F.col("`E.GUC`")
    energy = F.when((F.col("gap_min") >= 0) & (F.col("gap_min") <= p.maximum_energy_gap_minutes), (F.lag(power).over(run) + power) / 2.0 * (F.col("gap_min") / 60.0))
    out = frames.withColumn("interval_kwh", energy)
    total = F.when(power.isNotNull(), F.coalesce(F.sum("interval_kwh").over(run), F.lit(0.0)))
    weight = F.last("TARTIM", ignorenulls=True).over(run.rowsBetween(Window.unboundedPreceding, -1))
    return out.withColumns({"cumulative_kwh": total, "weight_delta": F.col("TARTIM") - weight, "deviation": F.col("S4") - F.col("S2")})


def derived_measurements(derived: DataFrame) -> DataFrame:
    """The derived values in long form, without nulls."""
    values = {
        "ACTIVE_SHELF_COUNT": (F.col("active").cast("double"), "count"), "HOTTEST_COIL_C": (F.col("coil"), "°C"), "S4_S2_DEVIATION_C": (F.col("deviation"), "°C"),
        "INTERVAL_ENERGY_KWH": (F.col("interval_kwh"), "kWh"), "CUMULATIVE_ENERGY_KWH": (F.col("cumulative_kwh"), "kWh"),
        "WEIGHT_DELTA_KG": (F.col("weight_delta"), "kg"), "WEIGHT_LOSS_KG": (-F.col("weight_delta"), "kg"),
    }
    rows = F.array(*(F.struct(F.lit(k).alias("code"), v.alias("value"), F.lit(u).alias("unit")) for k, (v, u) in values.items()))
    return derived.select("run_id", "seq", F.inline(rows)).where("value IS NOT NULL")
