"""Queries over stored long tables: cells with qualities, events with metadata, recipe segments, appended runs, analyses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse
from ..operators import analysis as an
from ..operators import ingest, series, views
from ..sources import logfiles
from ..streaming.ranges import kept
from .oracle import CELLS, FRAMES, STATES, SWAPPED
from .telemetry import CHANNELS, P, _looped, _swapped, frames, parts_of

_FOUND: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
LOW, HIGH = 1704067200000 + 3_600_000 * 2, 1704067200000 + 3_600_000 * 8


def query(base: str, sql: str) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        _FOUND[f.__name__], _SQL[f.__name__] = f, f"WITH RECURSIVE {base}\n{sql}"
        return f

    return add


def cells(spark: SparkSession, d: str) -> DataFrame:
    """Every cell, some without a number and some suspect by their own quality."""
    f = frames(spark, d)
    long = series.long_cells(f, CHANNELS).join(f.select("run_id", "seq", "k"), ["run_id", "seq"])
    quality = F.when(F.col("k") % 29 == 0, "invalid").when(F.col("k") % 19 == 0, "suspect").otherwise("good")
    return long.select("run_id", "seq", "ms", "channel", F.concat(F.lit("t"), F.col("k")).alias("raw_text"), F.when(F.col("k") % 29 != 0, F.col("value")).alias("value"), quality.alias("quality"))


STORED = CELLS + """,
stored AS (SELECT c.run_id, c.seq, c.ms, c.channel, concat('t', f.k) AS raw_text, CASE WHEN f.k % 29 <> 0 THEN c.value END AS value,
  CASE WHEN f.k % 29 = 0 THEN 'invalid' WHEN f.k % 19 = 0 THEN 'suspect' ELSE 'good' END AS quality FROM cells c JOIN frames f USING (run_id, seq)),
events0 AS (SELECT run_id, seq, k, kind, CASE k % 3 WHEN 0 THEN 'suspect_value' WHEN 1 THEN 'time_gap' ELSE 'csv_row_shape_error' END AS event_type,
  CASE kind WHEN 'click' THEN 1 WHEN 'view' THEN 3 WHEN 'error' THEN 99 END AS channel_id FROM frames WHERE k % 7 = 0),
flagged AS (SELECT s.*, quality = 'suspect' OR EXISTS (SELECT 1 FROM events0 e WHERE e.event_type = 'suspect_value' AND e.run_id = s.run_id AND e.seq = s.seq
  AND e.channel_id = CASE s.channel WHEN 'RAF1' THEN 1 WHEN 'RAF2' THEN 2 WHEN 'VACUM' THEN 3 END) AS suspect FROM stored s),
medians AS (SELECT run_id, channel, median(value) AS median FROM stored WHERE quality = 'good' AND NOT (channel LIKE 'RAF%' AND abs(value - 850) <= 0.5) GROUP BY ALL)"""  # fmt: skip


def channel_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, "RAF1"), (2, "RAF2"), (3, "VACUM")], "channel_id int, code string")


def events(spark: SparkSession, d: str) -> DataFrame:
    """Quality events; those of rejected rows have no frame, and their row is in the metadata only."""
    f = frames(spark, d).where("k % 7 = 0")
    kind = F.when(F.col("k") % 3 == 0, "suspect_value").when(F.col("k") % 3 == 1, "time_gap").otherwise("csv_row_shape_error")
    channel = F.when(F.col("kind") == "click", 1).when(F.col("kind") == "view", 3).when(F.col("kind") == "error", 99)
    lost = F.col("k") % 3 == 2
    detail = F.to_json(F.struct(F.col("seq").alias("source_row_number"), F.struct(F.concat(F.lit("at "), F.col("seq")).alias("source_timestamp_text")).alias("details")))
    return f.select("run_id", F.when(~lost, F.col("seq")).alias("seq"), F.col("seq").alias("event_id"), channel.alias("channel_id"), kind.alias("event_type"), F.when(lost, detail).alias("metadata_json"), "k")


def _flagged(spark: SparkSession, d: str) -> DataFrame:
    named = events(spark, d).join(channel_table(spark).withColumnRenamed("code", "channel"), "channel_id")
    return views.flagged(cells(spark, d), named)


def _r(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


@query(FRAMES, f"SELECT run_id, seq, ms FROM frames WHERE ms >= {LOW} AND ms <= {HIGH}")
def b29_time_range(spark, d):
    return views.between(frames(spark, d), LOW, HIGH).select("run_id", "seq", "ms")


@query(STORED, f"""SELECT run_id, seq, channel, raw_text, quality FROM stored SEMI JOIN (
  SELECT run_id, seq FROM frames WHERE ms >= {LOW} QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY ms, seq) <= 7) USING (run_id, seq)""")
def c2_limited_frames(spark, d):
    page = views.paged_cells(views.between(frames(spark, d), LOW), cells(spark, d), ["ms", "seq"], 7)
    return page.select("run_id", "seq", "channel", "raw_text", "quality")


@query(STORED, """SELECT e.run_id, e.seq AS event_id, CASE WHEN e.k % 3 <> 2 THEN f.ms END AS ms, concat(CASE WHEN e.k % 3 = 2 THEN 'at ' ELSE 'text ' END, e.seq) AS source_timestamp_text,
  e.seq AS source_row, CASE e.channel_id WHEN 1 THEN 'RAF1' WHEN 3 THEN 'VACUM' END AS channel, e.event_type FROM events0 e JOIN frames f USING (run_id, seq)""")
def c3_placed_events(spark, d):
    texts = frames(spark, d).withColumn("source_timestamp_text", F.concat(F.lit("text "), F.col("seq")))
    return views.placed_events(events(spark, d), texts, channel_table(spark)).select("run_id", "event_id", "ms", "source_timestamp_text", "source_row", "channel", "event_type")


RECIPE = FRAMES + """,
observed AS (SELECT run_id, seq, ms, CAST(CASE kind WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 END AS BIGINT) AS state_id FROM frames),
stays AS (SELECT run_id, segment, min(state_id) AS state_id, arg_min(ms, seq) AS started_ms, arg_max(ms, seq) AS last_ms, count(*) AS n FROM (
  SELECT *, sum(e) OVER (PARTITION BY run_id ORDER BY seq) AS segment FROM (
    SELECT *, CASE WHEN lag(state_id) OVER (PARTITION BY run_id ORDER BY seq) = state_id THEN 0 ELSE 1 END AS e FROM observed WHERE state_id IS NOT NULL)) GROUP BY run_id, segment),
recipe AS (SELECT run_id, CAST(segment AS BIGINT) AS segment, state_id, started_ms, coalesce(lead(started_ms) OVER (PARTITION BY run_id ORDER BY segment), CASE WHEN n > 1 THEN last_ms END) AS finished_ms FROM stays)"""  # fmt: skip
_CODES = "CASE state_id WHEN 1 THEN 'FREEZE' WHEN 2 THEN 'DRY' END AS state_code"


def _recipe(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    f = frames(spark, d)
    state = F.when(F.col("kind") == "click", 1).when(F.col("kind") == "view", 2).when(F.col("kind") == "purchase", 3).cast("long")
    found = ingest.recipe_segments(f.select("run_id", "seq", "ms", state.alias("state_id"))).withColumn("assignment_id", F.col("run_id") * 10)
    assignments = f.select((F.col("run_id") * 10).alias("assignment_id"), "run_id").distinct()
    return found.drop("run_id"), assignments, spark.createDataFrame([(1, "FREEZE"), (2, "DRY")], "state_id long, code string")


@query(RECIPE, f"SELECT run_id, segment, state_id, {_CODES}, started_ms, finished_ms FROM recipe")
def c5_recipe_states(spark, d):
    return views.recipe_view(*_recipe(spark, d), limit=10_000).select("run_id", "segment", "state_id", "state_code", "started_ms", "finished_ms")


@query(RECIPE, f"""SELECT run_id, segment, {_CODES} FROM recipe WHERE coalesce(finished_ms, started_ms) >= {LOW} AND started_ms <= {HIGH}
  QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY started_ms, segment) <= 5""")
def f7_recipe_page(spark, d):
    return views.recipe_view(*_recipe(spark, d), LOW, HIGH, 5).select("run_id", "segment", "state_code")


@query(FRAMES, f"""SELECT run_id, seq, kind FROM frames WHERE kind <> 'error' AND ms BETWEEN {LOW} AND {HIGH} QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY ms, seq) <= 6""")
def f6_observations(spark, d):
    seen = frames(spark, d).where("kind <> 'error'")
    return views.first_of_each(views.between(seen, LOW, HIGH), ["ms", "seq"], 6).select("run_id", "seq", "kind")


@query(FRAMES, "SELECT run_id, seq, row_number() OVER (PARTITION BY run_id ORDER BY ms, seq) AS place FROM frames WHERE k % 9 <> 0")
def f9_chronological(spark, d):
    rows = frames(spark, d).select("run_id", "seq", F.when(F.col("k") % 9 != 0, F.col("ms")).alias("ms"), F.col("k").alias("position"))
    return views.chronological(rows).select("run_id", "seq", "place")


@query(FRAMES, """SELECT DISTINCT run_id, 'csv_row_shape_error' AS event_type, CASE WHEN k % 5 > 0 THEN concat('{"row":', k, '}') END AS metadata_json FROM frames x
  WHERE NOT EXISTS (SELECT 1 FROM frames y WHERE y.run_id = x.run_id AND y.seq % 3 = 0 AND CASE WHEN y.k % 5 > 0 THEN y.k ELSE 0 END = CASE WHEN x.k % 5 > 0 THEN x.k ELSE 0 END)""")
def c9_new_events(spark, d):
    told = frames(spark, d).select("run_id", "seq", F.lit("csv_row_shape_error").alias("event_type"), F.when(F.col("k") % 5 > 0, F.format_string('{"row":%d}', "k")).alias("metadata_json"))
    return views.new_events(told.drop("seq"), told.where("seq % 3 = 0"))


@query(STORED, "SELECT run_id, seq, channel, suspect FROM flagged")
def c16_suspect_cells(spark, d):
    return _flagged(spark, d).select("run_id", "seq", "channel", "suspect")


@query(STORED, """SELECT f.run_id, f.seq, f.ms, c.channel, round(CASE WHEN NOT x.suspect AND NOT (x.channel LIKE 'RAF%' AND abs(x.value - 850) <= 0.5) THEN x.value END, 6) AS value
  FROM frames f CROSS JOIN (SELECT unnest(['RAF1', 'VACUM', 'TARTIM']) AS channel) c LEFT JOIN flagged x ON x.run_id = f.run_id AND x.seq = f.seq AND x.channel = c.channel""")
def e18_line_points(spark, d):
    return views.line_points(frames(spark, d), _flagged(spark, d), ["RAF1", "VACUM", "TARTIM"], P).select("run_id", "seq", "ms", "channel", *_r("value"))


@query(STORED, """SELECT x.run_id, x.seq, x.channel, round(coalesce(m.median, x.value), 6) AS height, x.raw_text FROM flagged x LEFT JOIN medians m USING (run_id, channel)
  WHERE x.suspect AND x.value IS NOT NULL AND NOT (x.channel LIKE 'RAF%' AND abs(x.value - 850) <= 0.5)""")
def e19_suspect_markers(spark, d):
    return views.suspect_markers(_flagged(spark, d), P).select("run_id", "seq", "channel", *_r("height"), "raw_text")


@query(STORED, "SELECT run_id, channel, round(median, 6) AS median FROM medians")
def d8_good_medians(spark, d):
    return views.good_medians(cells(spark, d), P).select("run_id", "channel", *_r("median"))


@query(STORED, """SELECT f.run_id, f.ms, round(a.value, 6) AS value FROM frames f LEFT JOIN (
    SELECT run_id, seq, avg(value) AS value FROM flagged WHERE channel LIKE 'RAF%' AND quality = 'good' AND NOT suspect AND abs(value - 850) > 0.5 GROUP BY ALL) a USING (run_id, seq)
  UNION ALL SELECT run_id, unnest([b + 1, ms - 1]) AS ms, NULL FROM (SELECT run_id, ms, lag(ms) OVER (PARTITION BY run_id ORDER BY ms, seq) AS b FROM frames) WHERE ms - b > 360000""")
def e20_shelf_average_series(spark, d):
    return views.shelf_average_points(frames(spark, d), _flagged(spark, d), P).select("run_id", "ms", *_r("value"))


@query(SWAPPED, """SELECT run_id, count(*) AS total, count(*) FILTER (event_type = 'time_gap') AS time_gap, count(*) FILTER (event_type = 'suspect_value') AS suspect_value,
    count(*) FILTER (event_type NOT IN ('time_gap', 'suspect_value')) AS other FROM (
  SELECT run_id, event_type FROM gap_events UNION ALL SELECT run_id, CASE k % 3 WHEN 0 THEN 'suspect_value' WHEN 1 THEN 'time_gap' ELSE 'csv_row_shape_error' END FROM frames WHERE k % 7 = 0) GROUP BY run_id""")
def d4_all_quality_buckets(spark, d):
    both = ingest.gap_events(_swapped(spark, d), "seq").select("run_id", "event_type").unionByName(events(spark, d).select("run_id", "event_type"))
    return series.quality_buckets(both)


_RANKED = "(VALUES ('RAF1', 0, '°C', 'shelf', 'main'), ('RAF2', 1, '°C', 'shelf', 'main'), ('RAF_AVG', 4, '°C', 'shelf', 'main'), ('VACUM', 7, NULL, 'vacuum', 'vacuum'), ('S2', 9, '°C', 'cooling', 'main'), ('S4', 11, '°C', 'cooling', 'main'), ('TARTIM', 15, 'kg', 'other', 'main'), ('E.GUC', 16, NULL, 'other', 'main')) r(code, rank, unit, grp, axis)"
_SEEN = """(SELECT DISTINCT run_id, channel AS code FROM cells UNION ALL SELECT run_id, 'RAF_AVG' FROM cells WHERE channel LIKE 'RAF%' GROUP BY run_id HAVING count(DISTINCT channel) >= 2)"""


@query(CELLS, f"SELECT run_id, code FROM {_SEEN}")
def d13_channels_seen(spark, d):
    return views.channels_seen(series.long_cells(frames(spark, d), CHANNELS))


@query(CELLS, f"""SELECT run_id, code, unit, coalesce(grp, 'other') AS "group", coalesce(axis, 'main') AS axis, coalesce(rank, 18) AS rank FROM (SELECT * FROM {_SEEN} UNION ALL SELECT DISTINCT run_id, 'NEW' FROM cells) LEFT JOIN {_RANKED} USING (code)""")
def b4_channel_metadata(spark, d):
    seen = views.channels_seen(series.long_cells(frames(spark, d), CHANNELS))
    return views.catalogue(seen.unionByName(seen.select("run_id", F.lit("NEW").alias("code")).distinct())).select("run_id", "code", "unit", "group", "axis", "rank")


@query(CELLS, f"""SELECT run_id, grp AS "group", list_position(['shelf', 'pressure', 'vacuum', 'cooling', 'other'], grp) AS place, string_agg(code, ',' ORDER BY rank) AS channels, coalesce(string_agg(code, ',' ORDER BY rank) FILTER (unit IS NULL), '') AS without_unit
  FROM {_SEEN} JOIN {_RANKED} USING (code) GROUP BY run_id, grp""")
def d15_panels(spark, d):
    return views.panels(views.channels_seen(series.long_cells(frames(spark, d), CHANNELS)))


@query(FRAMES, """SELECT DISTINCT x.run_id, 3 AS version, 2.0::DOUBLE AS start_vacuum_upper FROM frames x""")
def c17_active_profile(spark, d):
    rows = [("fd750", 1, False, '{"start_vacuum_upper": 1.0}'), ("fd750", 3, True, '{"start_vacuum_upper": 2.0}'), ("fd750", 2, True, '{"start_vacuum_upper": 3.0}'), ("other", 9, True, "{}")]
    profile = views.active_profile(spark.createDataFrame(rows, "code string, version int, active boolean, config_json string"), "fd750")
    config = F.get_json_object("config_json", "$.start_vacuum_upper").cast("double")
    return frames(spark, d).select("run_id").distinct().crossJoin(F.broadcast(profile)).select("run_id", "version", config.alias("start_vacuum_upper"))  # one row


@query(FRAMES, """SELECT run_id, CASE WHEN run_id % 2 = 0 THEN 'running' ELSE 'completed' END AS status, CASE WHEN run_id % 3 > 0 THEN least(min(ms), 1704070000000) ELSE min(ms) END AS started_ms, max(ms) AS finished_ms FROM frames GROUP BY run_id""")
def j3_appended_runs(spark, d):
    f = frames(spark, d)
    runs = f.select("run_id").distinct().select("run_id", F.when(F.col("run_id") % 2 == 0, "imported").otherwise("completed").alias("status"), F.when(F.col("run_id") % 3 > 0, F.lit(1704070000000)).alias("started_ms"), F.lit(0).cast("long").alias("finished_ms"))
    return ingest.appended_runs(runs, f)


@query(FRAMES, """SELECT f.run_id, f.seq, coalesce(f.ms < m.max_ms, false) AS late FROM frames f LEFT JOIN (SELECT run_id, max(ms) AS max_ms FROM frames WHERE seq % 5 = 0 GROUP BY run_id) m USING (run_id) WHERE f.seq % 5 <> 0""")
def i13_late_samples(spark, d):
    f = frames(spark, d)
    return ingest.late_samples(f.where("seq % 5 <> 0"), f.where("seq % 5 = 0").groupBy("run_id").agg(F.max("ms").alias("max_ms"))).select("run_id", "seq", "late")


@query(FRAMES, "SELECT run_id, greatest(coalesce(max(seq) FILTER (run_id % 4 > 0), 0) + 1, CASE WHEN run_id % 3 = 0 THEN 40 ELSE 1 END) AS next_seq FROM frames WHERE run_id % 4 > 0 OR run_id % 3 = 0 GROUP BY run_id")
def d12_tail_start(spark, d):
    f = frames(spark, d)
    checkpoints = f.where("run_id % 3 = 0").select("run_id", F.lit(40).cast("long").alias("next_seq")).distinct()
    return ingest.next_sequences(f.where("run_id % 4 > 0"), checkpoints)


@query(STATES, "SELECT f.run_id, f.seq AS point_id, (SELECT CAST(max(s.segment) AS BIGINT) FROM segments s WHERE s.run_id = f.run_id AND s.started_ms <= f.ms + 90000 AND (s.finished_ms IS NULL OR f.ms + 90000 <= s.finished_ms)) AS segment FROM frames f")
def c13_last_covering(spark, d):
    points = frames(spark, d).select("run_id", F.col("seq").alias("point_id"), (F.col("ms") + 90_000).alias("ms"))
    return views.last_covering(points, an.segments(_looped(spark, d))).select("run_id", "point_id", "segment")


_EVENTS = """(SELECT run_id, seq, ms, 'fd750_state_chain_reset' AS event_type, before_loop AS loop FROM (SELECT *, lag(loop) OVER (PARTITION BY run_id ORDER BY rn) AS before_loop FROM looped) WHERE reset
  UNION ALL SELECT run_id, seq, ms, event_type, loop FROM parallel WHERE event_type IS NOT NULL)"""


def _kept_loops(spark: SparkSession, d: str) -> DataFrame:
    """Frames with states and loops, stored once for several readers, each of which deals the runs to as many parts as ``frames``."""
    return kept(_looped(spark, d)).repartition(parts_of(spark, d), "run_id")


@query(STATES, f"SELECT run_id, seq, ms, event_type, CAST(loop AS BIGINT) AS loop FROM {_EVENTS}")
def g2_diagnostics(spark, d):
    looped = _kept_loops(spark, d)
    return views.diagnostics(an.resets(looped, P), an.parallel_events(looped, P))


@query(STATES, f"SELECT run_id, count(*) FILTER (event_type LIKE '%recovery') AS recoveries, count(*) FILTER (event_type LIKE '%rise') AS rises, count(*) FILTER (event_type LIKE '%reset') AS resets FROM {_EVENTS} GROUP BY run_id")
def d5_all_diagnostic_counts(spark, d):
    kind = F.col("event_type")
    looped = _kept_loops(spark, d)
    found = views.diagnostics(an.resets(looped, P), an.parallel_events(looped, P))
    return found.groupBy("run_id").agg(F.count_if(kind.endswith("recovery")).alias("recoveries"), F.count_if(kind.endswith("rise")).alias("rises"), F.count_if(kind.endswith("reset")).alias("resets"))


_STATUS = "CASE kind WHEN 'c' THEN 'interrupted' WHEN 'd' THEN 'active' WHEN 'f' THEN 'incomplete' ELSE 'completed' END"


@query(STATES, f"""SELECT run_id, 'cycle' AS part, row_number() OVER (PARTITION BY run_id ORDER BY loop) AS place, {_STATUS} AS name, CAST(loop AS BIGINT) AS loop, CAST(loop AS BIGINT) AS at FROM cycles
  UNION ALL SELECT run_id, 'segment', row_number() OVER (PARTITION BY run_id ORDER BY started_ms, segment), state, CAST(loop AS BIGINT), started_ms FROM segments
  UNION ALL SELECT run_id, 'event', row_number() OVER (PARTITION BY run_id ORDER BY ms, seq, event_type), event_type, CAST(loop AS BIGINT), ms FROM {_EVENTS}""")
def j4_stored_analysis(spark, d):
    looped = _kept_loops(spark, d)
    found = views.diagnostics(an.resets(looped, P), an.parallel_events(looped, P)).withColumn("event_id", F.struct("seq", "event_type"))
    return views.stored_analysis(an.cycles(looped), an.segments(looped), found)


@query(STATES, f"SELECT run_id, CAST(loop AS BIGINT) AS loop, {_STATUS} AS status FROM cycles QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY loop DESC) <= 5")
def e23_last_cycles(spark, d):
    return views.last_cycles(an.cycles(_looped(spark, d))).select("run_id", "loop", "status")


@query(FRAMES, """SELECT run_id, seq, CASE WHEN k % 3 = 0 THEN power WHEN k % 3 = 1 THEN power + 1 END AS power, CASE WHEN k % 2 = 0 THEN weight END AS weight FROM frames""")
def b22_alias_lookup(spark, d):
    power = F.col("`E.GUC`")
    f = frames(spark, d).withColumns({"E_GUC": F.when(F.col("k") % 3 == 1, power + 1), "POWER": F.when(F.col("k") % 3 == 0, power), "WEIGHT": F.when(F.col("k") % 2 == 0, F.col("TARTIM"))})
    return an.with_lookups(f.drop("E.GUC", "TARTIM").withColumn("E.GUC", F.lit(None).cast("double"))).select("run_id", "seq", power.alias("power"), F.col("TARTIM").alias("weight") if "TARTIM" in f.columns else "weight")


@query(FRAMES, """SELECT run_id, seq, CASE WHEN k % 60 < 24 THEN 1704326400000 + 86400000 + (k % 60) * 3600000 + k % 60 * 60000 + CASE WHEN k % 2 = 0 THEN 7250 ELSE 0 END END AS ms FROM frames""")
def b7_time_only_parse(spark, d):
    hour = F.col("k") % 60
    text = F.concat(hour, F.lit(":"), hour, F.when(F.col("k") % 2 == 0, ":07.25").otherwise(""))
    return frames(spark, d).select("run_id", "seq", parse.epoch_ms(parse.clock_timestamp(text, parse.file_date(F.lit("LogFile_2024_01_05.csv")))).alias("ms"))


@query(FRAMES, """SELECT run_id, seq, CASE k % 4 WHEN 0 THEN 1704448800000 + 123 WHEN 1 THEN 1704448800000 - 7200000 WHEN 2 THEN 1704448800000 + 12600000 ELSE 1704448800000 END AS ms FROM frames""")
def b10_normalised_time(spark, d):
    k = F.col("k") % 4
    text = F.when(k == 0, "2024-01-05T10:00:00.1234Z").when(k == 1, "2024-01-05T10:00:00+02:00").when(k == 2, "2024-01-05T10:00:00-03:30").otherwise("2024-01-05T10:00:00")
    return frames(spark, d).select("run_id", "seq", parse.epoch_ms(parse.batch_timestamp(text)).alias("ms"))


@query(FRAMES, """SELECT name, row_number() OVER (ORDER BY dated DESC, day, CASE WHEN NOT dated THEN stamp END, name) AS rank FROM (
  SELECT DISTINCT CASE WHEN k % 3 = 0 THEN concat('old', k, '.CSV') ELSE concat('LogFile_2024_01_', lpad(CAST(k % 28 + 1 AS VARCHAR), 2, '0'), '.csv') END AS name, k % 3 > 0 AS dated, CASE WHEN k % 3 > 0 THEN k % 28 + 1 END AS day, CASE WHEN k % 3 = 0 THEN k * 7 % 50 END AS stamp FROM frames)""")
def a6_file_order(spark, d):
    k = F.col("k")
    name = F.when(k % 3 == 0, F.concat(F.lit("old"), k, F.lit(".CSV"))).when(k % 3 == 1, F.format_string("LogFile_2024_01_%02d.csv", k % 28 + 1)).otherwise(F.format_string("LogFile_2024_01_%02d (2).csv", k % 28 + 1))
    files = frames(spark, d).select(F.when(k % 3 == 2, F.regexp_replace(name, r" \(2\)", "")).otherwise(name).alias("file"), F.when(k % 3 == 0, F.timestamp_seconds(k * 7 % 50)).alias("modified")).distinct()
    return logfiles.ranked(files.withColumns({"path": F.col("file"), "folder": F.lit("x")})).select(F.col("file").alias("name"), "rank")


@query(FRAMES, "SELECT run_id, seq, k % 5 > 1 AS wanted FROM frames")
def a7_wanted_files(spark, d):
    k = F.col("k") % 5
    name = F.when(k == 0, "logfile_2024_01_05 (3).CSV").when(k == 1, "notes.txt").when(k == 2, "LogFile_2024_13_05 (3).csv").when(k == 3, "LOGFILE_2024_01_05.csv").otherwise("other.csv")
    return frames(spark, d).select("run_id", "seq", logfiles.wanted(name, "*.csv").alias("wanted"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_FOUND)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
