"""Queries over log files, batches and event views; Spark writes their texts from the events, the SQL states what they say."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest, quality, views
from ..sources import batches, logfiles, sinks
from ..streaming import append, tail
from ..streaming.ranges import kept
from .oracle import FRAMES
from .telemetry import frames

_FOUND: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        _FOUND[f.__name__], _SQL[f.__name__] = f, sql
        return f

    return add


def _file(run: Column) -> list[Column]:
    folder, name = (run % 5).cast("string"), F.concat(F.lit("LogFile_2024_01_"), F.lpad((run % 28 + 1).cast("string"), 2, "0"), F.lit(".csv"))
    return [F.concat_ws("/", folder, run.cast("string"), name).alias("path"), folder.alias("folder"), name.alias("file"), F.lit("2024-01-01").cast("timestamp").alias("modified")]


def _headed(spark: SparkSession, d: str) -> DataFrame:
    """A log file of each run, with late, long, short and unreadable rows and cells."""
    k, moment = F.col("k"), F.expr("date_format(TIMESTAMP_NTZ '1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, ms / 1000), 'yyyy-MM-dd-HH:mm:ss.SSS')")
    shelf = F.when(k % 5 == 0, "#VALUE!").otherwise(F.concat(k, F.lit(",5")))
    full = F.concat_ws(";", moment, shelf, F.concat(k, F.lit(".25")), k % 3, k % 4)
    line = F.when(k % 13 == 0, "xx;1;1;1;1").when(k % 11 == 0, F.concat(full, F.lit(";7"))).when(k % 7 == 0, F.concat_ws(";", moment, shelf)).otherwise(full)
    lines = frames(spark, d).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))).alias("lines"))
    text = F.concat(F.lit("TARIH SAAT;RAF1 HEDEF;VACUUM;RECETE NO;RECETE ADIM\n"), F.array_join("lines.line", "\n"), F.lit("\n"))
    return logfiles.with_header(logfiles.ranked(lines.select("run_id", *_file(F.col("run_id")), text.cast("binary").alias("content"))))


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return logfiles.log_rows(_headed(spark, d))


def _run() -> Column:
    return F.split("path", "/")[1].cast("long").alias("run_id")


LINES = (
    FRAMES
    + """,
lines AS (SELECT *, seq + 1 AS row_number, CASE WHEN k % 13 = 0 THEN 'csv_row_timestamp_error' WHEN k % 11 = 0 THEN 'csv_row_shape_error' END AS problem,
  CASE WHEN k % 13 <> 0 AND k % 11 <> 0 AND k % 7 = 0 THEN 'csv_row_shape_warning' END AS warning FROM frames)"""
)


@query(f"""{LINES} SELECT run_id, row_number, ms, channel, value, CASE WHEN value IS NULL THEN 'invalid' ELSE 'good' END AS quality FROM (
  SELECT run_id, row_number, ms, 'RAF1' AS channel, CASE WHEN k % 5 <> 0 THEN k + 0.5::DOUBLE END AS value FROM lines WHERE problem IS NULL
  UNION ALL SELECT run_id, row_number, ms, 'VACUM', CASE WHEN warning IS NULL THEN k + 0.25::DOUBLE END FROM lines WHERE problem IS NULL
  UNION ALL SELECT run_id, row_number, ms, 'RECETE NO', CASE WHEN warning IS NULL THEN k % 3 END FROM lines WHERE problem IS NULL
  UNION ALL SELECT run_id, row_number, ms, 'RECETE ADIM', CASE WHEN warning IS NULL THEN k % 4 END FROM lines WHERE problem IS NULL)""")
def a1_log_scan(spark, d):
    return logfiles.cells(_rows(spark, d)).select(_run(), "row_number", "ms", "channel", "value", "quality")


@query("""h AS (SELECT DISTINCT user_id AS run_id, CASE user_id % 7 WHEN 0 THEN 'incomplete' WHEN 1 THEN 'invalid' ELSE 'ready' END AS status, user_id % 28 AS day,
  (user_id % 200) // 10 AS folder FROM events)
  SELECT run_id, status, status = 'ready' AND NOT coalesce(bool_or(status = 'incomplete') OVER (PARTITION BY folder ORDER BY day, CAST(run_id AS VARCHAR)), false) AS readable FROM h""")
def a4_header_barrier(spark, d):
    runs = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("run_id")).distinct()
    run = F.col("run_id")
    text = F.when(run % 7 == 0, "SAAT;RAF1").when(run % 7 == 1, "SAAT;RAF1;RAF 1\n").otherwise("SAAT;RAF1\n")
    _, _, name, modified = _file(run)
    files = runs.select(run, run.cast("string").alias("path"), F.floor(run % 200 / 10).alias("folder"), name, modified, text.cast("binary").alias("content"))
    return logfiles.barrier(logfiles.with_header(logfiles.ranked(files))).select("run_id", "status", "readable")


@query("""h AS (SELECT sha256(props) AS sha256, min(event_id) AS event_id, bool_or(event_id % 50 = 0) AS old FROM events GROUP BY 1) SELECT sha256, event_id FROM h WHERE NOT old""")
def a11_file_dedup(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    files = e.select(F.col("event_id").alias("path"), F.col("props").cast("binary").alias("content"))
    return logfiles.unseen(files, files.where("path % 50 = 0").select(F.sha2("content", 256).alias("sha256"))).select("sha256", F.col("path").alias("event_id"))


@query(f"""{LINES} SELECT run_id, row_number, event_type, severity FROM (SELECT run_id, row_number, problem AS event_type, 'error' AS severity FROM lines
  UNION ALL SELECT run_id, row_number, warning, 'warning' FROM lines) WHERE event_type IS NOT NULL""")
def b13_row_events(spark, d):
    return logfiles.row_events(_rows(spark, d)).select(_run(), "row_number", "event_type", "severity")


@query(f"""{LINES} SELECT run_id, row_number, CASE WHEN k % 3 <> 0 THEN CAST(k % 3 AS VARCHAR) END AS recipe_code, 'STEP_' || (k % 4) AS state_code, 'Reçete adım ' || (k % 4) AS state_name,
  '{{"source":"csv","recipe_no":' || CASE WHEN k % 3 <> 0 THEN '"' || (k % 3) || '"' ELSE 'null' END || ',"recipe_step":"' || (k % 4) || '"}}' AS source_payload_json
  FROM lines WHERE problem IS NULL AND warning IS NULL AND k % 4 <> 0""")
def b17_recipe_steps(spark, d):
    return logfiles.steps(_rows(spark, d)).select(_run(), "row_number", "recipe_code", "state_code", "state_name", "source_payload_json")


@query(f"""{LINES}, good AS (SELECT *, ms - lag(ms) OVER (PARTITION BY run_id ORDER BY seq) AS gap FROM lines WHERE problem IS NULL),
  a AS (SELECT run_id, count(*) AS records, count(problem) AS problems FROM lines GROUP BY run_id),
  g AS (SELECT run_id, count(*) AS n, min(ms) AS lo, max(ms) AS hi, count(warning) AS w, count(*) FILTER (gap < 0 OR gap > 360000) AS gaps,
    sum(CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN warning IS NOT NULL THEN 3 ELSE 0 END) AS bad FROM good GROUP BY run_id)
  SELECT a.run_id, records, coalesce(n, 0) AS rows, lo AS started_ms, hi AS finished_ms, 4 AS channels, coalesce(w + gaps, 0) AS warnings, problems + coalesce(bad, 0) AS errors FROM a LEFT JOIN g USING (run_id)""")
def d6_import_report(spark, d):
    return logfiles.report(_rows(spark, d)).select(_run(), "records", "rows", "started_ms", "finished_ms", "channels", "warnings", "errors")


@query(f"""{LINES}, n AS (SELECT run_id, count(*) AS n FROM lines GROUP BY run_id),
  b AS (SELECT run_id, coalesce(sum(n) OVER (PARTITION BY run_id % 5 ORDER BY run_id % 28, CAST(run_id AS VARCHAR) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n)
  SELECT run_id, row_number, before + row_number - 1 AS seq FROM lines JOIN b USING (run_id) WHERE problem IS NULL""")
def i5_sequence_assignment(spark, d):
    return logfiles.sequenced(_rows(spark, d)).where("problem IS NULL").select(_run(), "row_number", "seq")


@query(f"""{FRAMES}, r AS (SELECT run_id, seq, ((seq - 1) * 3 // 4 + CASE WHEN k % 9 = 0 THEN 1 ELSE 0 END) * 10 AS lo FROM frames),
  f AS (SELECT run_id, seq, lo, CASE WHEN lo + 10 > 400 THEN 'beyond' WHEN lo > 0 THEN 'hole' ELSE 'accepted' END AS verdict, CASE WHEN lo = 0 THEN 10 ELSE 0 END AS reach FROM r WHERE seq = 1
    UNION ALL SELECT r.run_id, r.seq, r.lo, CASE WHEN r.lo + 10 > 400 THEN 'beyond' WHEN r.lo > f.reach THEN 'hole' WHEN r.lo < f.reach THEN 'replay' ELSE 'accepted' END,
      CASE WHEN r.lo + 10 <= 400 AND r.lo = f.reach THEN r.lo + 10 ELSE f.reach END FROM f JOIN r ON r.run_id = f.run_id AND r.seq = f.seq + 1)
  SELECT run_id, seq, verdict FROM f""")
def i7_range_fold(spark, d):
    low = (F.floor((F.col("seq") - 1) * 3 / 4) + F.when(F.col("k") % 9 == 0, 1).otherwise(0)) * 10
    pushed = frames(spark, d).select(F.col("run_id").alias("source"), F.lit("f").alias("file"), F.col("seq").alias("arrival"), low.alias("from_byte"), (low + 10).alias("to_byte"), F.lit(400).alias("size"))
    return tail.fold_ranges(pushed).select(F.col("source").alias("run_id"), F.col("arrival").alias("seq"), "verdict")


@query(f"""{FRAMES} SELECT run_id, seq, strftime(make_timestamp(ms * 1000), '%Y-%m-%d') || ';' || CASE WHEN kind <> 'error' THEN k || ',5' ELSE '' END || ';' || k || '.25' AS line FROM frames""")
def a15_wide_export(spark, d):
    day = F.expr("date_format(TIMESTAMP_NTZ '1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, ms / 1000), 'yyyy-MM-dd')")
    cell = lambda c, text: F.struct(F.lit(c).alias("channel"), text.alias("raw_text"))
    both = F.array(cell("RAF1", F.when(F.col("kind") != "error", F.concat("k", F.lit(",5")))), cell("VACUM", F.concat("k", F.lit(".25"))))
    cells = frames(spark, d).select("run_id", "seq", day.alias("source_timestamp_text"), F.inline(both)).where("raw_text IS NOT NULL")
    return sinks.export_lines(cells, ["RAF1", "VACUM"])


def _samples(spark: SparkSession, d: str) -> DataFrame:
    """Batches of ten samples as JSON texts, read back; some are refused."""
    k, texts = F.col("k"), lambda code, number: F.struct(code.alias("channel_code"), number.alias("numeric_value"), F.lit("x,5").alias("raw_text"))
    measures = F.when(k == 3, F.array().cast("array<struct<channel_code: string, numeric_value: double, raw_text: string>>")).otherwise(F.array(
        texts(F.when(k == 5, " ").otherwise("raf 1"), F.when(k % 2 == 0, k / 2)), texts(F.when(k == 7, "RAF1").otherwise("Vacuum"), k.cast("double"))))
    sample = F.struct("seq", F.struct(F.concat(F.lit("2024-01-05T10:00:"), F.lpad((k % 60).cast("string"), 2, "0"), F.lit("Z")).alias("sampled_at"), F.when(k == 9, -1).otherwise(F.col("seq")).alias("source_sequence"), measures.alias("measurements")).alias("s"))
    rows = frames(spark, d).groupBy("run_id", F.floor((F.col("seq") - 1) / 10).alias("batch_id")).agg(F.array_sort(F.collect_list(F.struct("seq", F.to_json(sample["s"]).alias("s")))).alias("all"))
    text = F.concat(F.lit('{"samples":['), F.array_join("all.s", ","), F.lit("]}"))
    return batches.samples(rows.select("run_id", "batch_id", F.from_json(text, batches.SCHEMA)["samples"].alias("samples")))


_BATCH = f"{FRAMES}, s AS (SELECT *, (seq - 1) // 10 AS batch_id, (seq - 1) % 10 AS batch_pos FROM frames)"


@query(f"""{_BATCH} SELECT run_id, batch_id, batch_pos, CASE k WHEN 3 THEN 'no measurement' WHEN 5 THEN 'channel without name' WHEN 7 THEN 'channel twice' ELSE 'sequence not positive' END AS reason FROM s WHERE k IN (3, 5, 7, 9)""")
def b20_batch_violations(spark, d):
    return batches.violations(_samples(spark, d))


@query(f"""{_BATCH}, ok AS (SELECT * FROM s WHERE (run_id, batch_id) NOT IN (SELECT (run_id, batch_id) FROM s WHERE k IN (3, 5, 7, 9)))
  SELECT run_id, batch_id, seq, channel, value, CASE WHEN value IS NULL THEN 'invalid' ELSE 'good' END AS quality FROM (
    SELECT run_id, batch_id, seq, 'RAF1' AS channel, CASE WHEN k % 2 = 0 THEN k / 2.0::DOUBLE END AS value FROM ok UNION ALL SELECT run_id, batch_id, seq, 'VACUM', CAST(k AS DOUBLE) FROM ok)""")
def b12_batch_cells(spark, d):
    return batches.cells(batches.accepted(_samples(spark, d))).select("run_id", "batch_id", "seq", "channel", "value", "quality")


@query(f"""{_BATCH} SELECT run_id, batch_id, count(*) FILTER (seq % 3 <> 0) AS inserted, count(*) FILTER (seq % 3 = 0) AS skipped,
  arg_max(1704448800000 + k % 60 * 1000, seq) FILTER (seq % 3 <> 0) AS latest_ms FROM s GROUP BY run_id, batch_id""")
def d7_append_report(spark, d):
    rows = _samples(spark, d).withColumn("seq", F.col("batch_id") * 10 + F.col("batch_pos") + 1)
    return batches.report(rows, ingest.new_samples(rows, frames(spark, d).where("seq % 3 = 0")))


@query(f"""{_BATCH}, ok AS (SELECT *, 1704448800000 + k % 60 * 1000 AS t FROM s WHERE seq % 3 <> 0 AND (run_id, batch_id) NOT IN (SELECT (run_id, batch_id) FROM s WHERE k IN (3, 5, 7, 9))),
  g AS (SELECT *, coalesce(lag(t) OVER (PARTITION BY run_id, batch_id ORDER BY seq), (SELECT max(x.t) FROM ok x WHERE x.run_id = ok.run_id AND x.batch_id < ok.batch_id)) AS b FROM ok)
  SELECT run_id, batch_id, count(*) AS inserted, CAST(2 AS BIGINT) AS channels, count(*) FILTER (t < b OR t - b > 360000) AS warnings, count(*) FILTER (k % 2 = 1) AS errors FROM g GROUP BY ALL""")
def d7_append_counts(spark, d):
    return batches.append_counts(ingest.new_samples(batches.accepted(_samples(spark, d)), frames(spark, d).where("seq % 3 = 0")))


def _appended(spark: SparkSession, d: str) -> append.Store:
    """Batches of eight samples, two in five without sequences, appended in two steps; every run has a recipe, and some of its
    states are none of the recipe's or come from before the segment that the run is in."""
    k, seq = F.col("k"), F.col("seq")
    at = F.lit(1704067200000) + seq * 60000 - F.when(k % 23 == 0, 200000).otherwise(0) + F.when(k % 19 == 0, 400000).otherwise(0)
    moment = F.expr("date_format(TIMESTAMP_NTZ '1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, at / 1000), \"yyyy-MM-dd'T'HH:mm:ss.SSS\")")
    code = F.when(k % 4 == 0, F.concat(F.lit("S"), F.floor(seq / 6) % 3)).when(k % 31 == 0, "T").when(k % 7 == 0, F.concat(F.lit("X"), k % 2))
    cell = lambda c, number, raw, quality: F.struct(F.lit(c).alias("channel_code"), number.alias("numeric_value"), raw.alias("raw_text"), quality.alias("quality"))
    none, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    cells = F.array(cell("RAF1", k.cast("double"), text, F.when(k % 11 == 0, "suspect")), cell("VACUM", none, F.when(k % 13 == 0, "x").otherwise(k.cast("string")), text))
    rows = frames(spark, d).withColumns({"at": at, "batch_id": F.floor((seq - 1) / 8)})
    state = F.when(code.isNotNull(), F.struct(code.alias("source_state_code")))
    sample = F.struct(moment.alias("sampled_at"), F.when(F.col("batch_id") % 5 < 3, seq).alias("source_sequence"), state.alias("state_observation"), cells.alias("measurements"))
    each = rows.groupBy("run_id", "batch_id").agg(F.array_sort(F.collect_list(F.struct("seq", F.to_json(sample).alias("s")))).alias("all"))
    sent = each.select("run_id", "batch_id", F.from_json(F.concat(F.lit('{"samples":['), F.array_join("all.s", ","), F.lit("]}")), batches.SCHEMA)["samples"].alias("samples"))
    sent = kept(sent)  # read by each of the steps
    runs = frames(spark, d).select("run_id").distinct()
    known = append.Catalogue(
        assignments=lambda: runs.select("run_id", (F.col("run_id") + 1000).alias("assignment_id"), F.lit(1).alias("version_id"), F.lit(0).alias("assigned_ms"), F.lit("primary").alias("role"), F.lit(True).alias("active")),
        states=lambda: spark.createDataFrame([(1, 1, "S0", "X0", 0), (1, 2, "S1", None, 1), (1, 3, "S2", "S1", 2)], "version_id long, state_id long, code string, external_code string, sort_order int"),
    )
    store = append.Store(spark, append.scratch(spark, "append"))
    for step in range(2):
        append.run_step(store, sent.where("batch_id < 6" if step == 0 else "batch_id >= 6"), step, known)
    return store


# the same on frames, observation by observation; a refused batch leaves the segment that the run was in before it
_APPENDED = f"""{FRAMES}, s AS (
  SELECT run_id, seq, k, (seq - 1) // 8 AS batch_id, 1704067200000 + seq * 60000 - CASE WHEN k % 23 = 0 THEN 200000 ELSE 0 END + CASE WHEN k % 19 = 0 THEN 400000 ELSE 0 END AS ms,
    CASE WHEN k % 4 = 0 THEN seq // 6 % 3 + 1 WHEN k % 31 = 0 THEN 0 WHEN k % 7 = 0 THEN CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END END AS state FROM frames),
  o AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS n FROM s WHERE state > 0),
  walk AS (
    SELECT run_id, n, batch_id, state AS cur, ms AS started, 0 AS old_cur, -1::BIGINT AS old_started, -1::BIGINT AS refused FROM o WHERE n = 1
    UNION ALL
    SELECT run_id, n, batch_id, CASE WHEN again THEN cur WHEN bad THEN c0 ELSE state END, CASE WHEN again THEN started WHEN bad THEN b0 WHEN state = cur THEN started ELSE ms END, c0, b0, CASE WHEN bad THEN batch_id ELSE refused END FROM (
      SELECT o.*, w.cur, w.started, w.refused, o.batch_id = w.refused AS again, o.batch_id <> w.refused AND o.ms < w.started AS bad,
        CASE WHEN o.batch_id = w.batch_id THEN w.old_cur ELSE w.cur END AS c0, CASE WHEN o.batch_id = w.batch_id THEN w.old_started ELSE w.started END AS b0
      FROM walk w JOIN o ON o.run_id = w.run_id AND o.n = w.n + 1)),
  refused AS (SELECT DISTINCT run_id, refused AS batch_id FROM walk WHERE refused >= 0),
  taken AS (SELECT s.* FROM s ANTI JOIN refused r ON s.run_id = r.run_id AND s.batch_id = r.batch_id),
  tops AS (SELECT run_id, batch_id, max(ms) AS top FROM taken GROUP BY run_id, batch_id),
  highs AS (SELECT run_id, batch_id, max(top) OVER (PARTITION BY run_id ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM tops),
  timed AS (SELECT t.*, high, coalesce(lag(ms) OVER (PARTITION BY t.run_id, t.batch_id ORDER BY seq), high) AS before FROM taken t JOIN highs h ON t.run_id = h.run_id AND t.batch_id = h.batch_id)"""


@query(f"""{_APPENDED} SELECT run_id, batch_id, 'state older than its segment' AS reason FROM refused""")
def i6_refused_batches(spark, d):
    return _appended(spark, d).read("refusals").select("run_id", "batch_id", "reason")


@query(f"""{_APPENDED}, e AS (SELECT *, CASE WHEN ms < before THEN 'timestamp_out_of_order' WHEN ms - before > 360000 THEN 'time_gap' END AS event_type FROM timed
    UNION ALL SELECT *, CASE WHEN state = 0 THEN 'state_unmapped' END FROM timed UNION ALL SELECT *, CASE WHEN k % 11 = 0 THEN 'suspect_value' END FROM timed UNION ALL SELECT *, CASE WHEN k % 13 = 0 THEN 'parse_error' END FROM timed)
  SELECT run_id, batch_id, event_type, CASE WHEN event_type = 'parse_error' THEN 'error' ELSE 'warning' END AS severity, count(*) AS n,
    sum(CASE WHEN event_type IN ('time_gap', 'timestamp_out_of_order') THEN ms - before END) / 1000.0::DOUBLE AS gap_seconds FROM e WHERE event_type IS NOT NULL GROUP BY ALL""")
def i6_append_events(spark, d):
    gap = quality.gap_seconds()
    return _appended(spark, d).read("events").groupBy("run_id", "batch_id", "event_type", "severity").agg(F.count("*").alias("n"), F.sum(gap).alias("gap_seconds"))


@query(f"""{_APPENDED}, e AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY run_id ORDER BY seq) <> state, true)::INT AS enters FROM taken WHERE state > 0),
  g AS (SELECT *, sum(enters) OVER (PARTITION BY run_id ORDER BY seq) AS segment FROM e),
  h AS (SELECT run_id, segment, any_value(state) AS state_id, arg_min(ms, seq) AS started_ms, arg_max(ms, seq) AS last_ms, count(*) AS n FROM g GROUP BY run_id, segment)
  SELECT run_id, run_id + 1000 AS assignment_id, segment, state_id, started_ms, coalesce(lead(started_ms) OVER (PARTITION BY run_id ORDER BY segment), CASE WHEN n > 1 THEN last_ms END) AS finished_ms FROM h""")
def i6_append_segments(spark, d):
    return _appended(spark, d).segments()


@query(f"""{_APPENDED} SELECT run_id, 'running' AS status, min(ms) AS started_ms, max(ms) AS finished_ms, count(*) AS rows, count(*) FILTER (ms < high) AS late FROM timed GROUP BY run_id""")
def i6_append_runs(spark, d):
    store = _appended(spark, d)
    late = store.read("samples").groupBy("run_id").agg(F.count_if("late").alias("late"))
    return batches.joined(store.runs(), late, "run_id").select("run_id", "status", "started_ms", "finished_ms", "rows", "late")


@query(f"""{FRAMES}, e AS (SELECT run_id, seq AS event_id, k, CASE WHEN k % 3 = 0 THEN seq WHEN k % 3 = 1 THEN k WHEN k % 6 = 2 THEN k + 1 END AS source_row FROM frames),
  p AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY source_row NULLS FIRST, event_id) AS place, count(*) OVER (PARTITION BY run_id) AS n FROM e)
  SELECT run_id, event_id, source_row, CASE WHEN k % 2 = 0 THEN k + 0.5::DOUBLE ELSE CAST(k AS DOUBLE) END AS gap_seconds, CASE WHEN k % 4 = 0 THEN 'r' || k WHEN k % 4 = 1 THEN 'v' || k WHEN k % 4 = 2 THEN 'w' || k ELSE 'v' || k END AS suspect_text,
    ['gap', 'out_of_order', 'suspect', 'cell', 'timestamp', 'file', 'row', 'other'][k % 8 + 1] AS event_class, place, greatest(n - 12, 0) AS hidden FROM p WHERE place <= 12""")
def f10_first_events(spark, d):
    k = F.col("k")
    kinds = ["time_gap", "timestamp_out_of_order", "suspect_value", "numeric_parse_error", "csv_row_timestamp_error", "csv_file_header_error", "csv_row_shape_error", "note"]
    meta = F.to_json(F.struct(F.when(k % 3 != 0, F.when(k % 3 == 1, k).when(k % 6 == 2, k + 1)).alias("source_row_number"), F.when(k % 2 == 0, k + F.lit(0.5).cast("double")).alias("gap_seconds"), F.when(k % 4 == 0, F.concat(F.lit("r"), k)).alias("raw_text"), F.when(k % 4 == 2, F.concat(F.lit("w"), k)).alias("raw_value")))
    message = F.when(k % 2 == 0, "`gap`").otherwise(F.concat(F.lit("5 s late: time gap of "), k, F.lit(" seconds, value v"), k, F.lit(" seen")))
    events = frames(spark, d).select("run_id", F.col("seq").alias("event_id"), F.get(F.array(*map(F.lit, kinds)), k % 8).alias("event_type"), message.alias("message"), meta.alias("metadata_json"), F.when(k % 3 == 0, F.col("seq")).alias("row_number"))
    return quality.first_of_run(quality.viewed(events), 12).select("run_id", "event_id", "source_row", "gap_seconds", "suspect_text", "event_class", "place", "hidden")


@query(f"""{FRAMES} SELECT run_id, CAST(floor((max(ms) - min(ms)) / 60000.0::DOUBLE + 0.5) AS BIGINT) AS minutes, (max(ms) - min(ms)) / 3600000.0::DOUBLE AS hours FROM frames GROUP BY run_id""")
def b27_durations(spark, d):
    b = ingest.bounds(frames(spark, d))
    return b.select("run_id", quality.run_minutes(F.col("started_ms"), F.col("finished_ms")).alias("minutes"), quality.cycle_hours(F.col("started_ms"), F.lit(None), F.col("finished_ms")).alias("hours"))


@query(f"""{FRAMES}, ks AS (SELECT DISTINCT k FROM frames), t AS (SELECT k AS state_id, 'S' || (k % 20) AS code, 'S' || (k % 40) AS external_code, k % 5 AS sort_order FROM ks),
  c AS (SELECT DISTINCT 'S' || (k % 50) AS code FROM ks), m AS (SELECT c.code, state_id, sort_order, 0 AS rank FROM c JOIN t ON c.code = t.code UNION ALL SELECT c.code, state_id, sort_order, 1 FROM c JOIN t ON c.code = t.external_code)
  SELECT code, state_id FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY rank, sort_order, state_id) AS n FROM m) WHERE n = 1""")
def c10_recipe_lookup(spark, d):
    ks, name = frames(spark, d).select("k").distinct(), lambda n: F.concat(F.lit("S"), F.col("k") % n)
    states = ks.select(F.col("k").alias("state_id"), name(20).alias("code"), name(40).alias("external_code"), (F.col("k") % 5).alias("sort_order"))
    return ingest.match_states(ks.select(name(50).alias("code")).distinct(), states)


@query(f"""{FRAMES} SELECT run_id, assignment_id FROM (SELECT run_id, seq AS assignment_id, row_number() OVER (PARTITION BY run_id ORDER BY k DESC, seq DESC) AS n FROM frames WHERE k % 3 <> 0 AND k % 2 = 0) WHERE n = 1""")
def c11_active_assignment(spark, d):
    k = F.col("k")
    rows = frames(spark, d).select("run_id", F.col("seq").alias("assignment_id"), k.alias("assigned_ms"), F.when(k % 2 == 0, "primary").otherwise("secondary").alias("role"), (k % 3 != 0).alias("active"))
    return sinks.latest_assignment(rows).select("run_id", "assignment_id")


_RUNS = f"{FRAMES}, runs AS (SELECT run_id, min(ms) FILTER (run_id % 3 <> 0) AS started_ms, max(ms) + 7 * run_id AS created_ms FROM frames GROUP BY run_id)"


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """A run table; a third of the runs have not started and so have no frames."""
    run = F.col("run_id")
    return frames(spark, d).groupBy(run).agg(F.min(F.when(run % 3 != 0, F.col("ms"))).alias("started_ms"), (F.max("ms") + 7 * run).alias("created_ms"))


@query(f"""{_RUNS} SELECT run_id, CASE WHEN run_id % 4 = 0 THEN run_id ELSE count(*) FILTER (run_id % 3 <> 0) END AS rows, CASE WHEN run_id % 4 = 0 THEN 2 ELSE count(*) FILTER (k % 5 = 0) END AS warnings,
  CASE WHEN run_id % 4 = 0 THEN 1 ELSE count(*) FILTER (k % 5 = 1) END AS errors FROM frames GROUP BY run_id""")
def d3_run_summary(spark, d):
    f = frames(spark, d)
    events = f.where("k % 5 < 2").select("run_id", F.when(F.col("k") % 5 == 0, "warning").otherwise("error").alias("severity"))
    imports = f.where("run_id % 4 = 0").select("run_id").distinct().select("run_id", F.col("run_id").alias("rows"), F.lit(2).cast("long").alias("warnings"), F.lit(1).cast("long").alias("errors"))
    return quality.run_summary(_runs(spark, d), f.where("run_id % 3 <> 0"), events, imports)


@query(f"""{_RUNS} SELECT run_id, started_ms, coalesce(started_ms, created_ms) AS newest_ms FROM runs ORDER BY 3 DESC, 1 DESC LIMIT 100""")
def f5_runs_newest_first(spark, d):
    return quality.newest_runs(_runs(spark, d)).select("run_id", "started_ms", "newest_ms")


@query(f"""{LINES}, e AS (SELECT *, problem AS event_type FROM lines UNION ALL SELECT *, warning FROM lines)
  SELECT run_id, row_number AS source_row, event_type, CASE WHEN k % 13 = 0 THEN 'xx' ELSE strftime(make_timestamp(ms * 1000), '%Y-%m-%d-%H:%M:%S.') || lpad(CAST(ms % 1000 AS VARCHAR), 3, '0') END AS source_timestamp_text,
    coalesce(CASE WHEN k % 13 = 0 THEN 'xx;1;1;1;1' END, '') AS raw_text FROM e WHERE event_type IS NOT NULL""")
def b14_rejected_rows(spark, d):
    """Rejected rows, stored as events without a frame, as the event view reads them back."""
    told = tail.rejected_rows(_rows(spark, d), spark.createDataFrame([], "run_id string, event_type string, metadata_json string"))
    stored = told.select(_run(), F.lit(None).cast("long").alias("seq"), F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("int").alias("channel_id"), "event_type", "metadata_json")
    found = views.placed_events(stored, frames(spark, d).withColumn("source_timestamp_text", F.lit("")), spark.createDataFrame([], "channel_id int, code string"))
    raw = F.get_json_object("metadata_json", "$.raw_text")
    return found.select("run_id", "source_row", "event_type", "source_timestamp_text", F.when(raw.startswith("xx"), raw).otherwise("").alias("raw_text"))


@query(f"""{LINES}, n AS (SELECT run_id, run_id % 5 AS folder, count(*) AS n, arg_max(ms, seq) AS x, max(ms) FILTER (problem <> 'csv_row_timestamp_error' OR problem IS NULL) AS ms FROM lines GROUP BY run_id),
  o AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY run_id % 28, CAST(run_id AS VARCHAR)) AS rank FROM n)
  SELECT CAST(folder AS VARCHAR) AS folder, count(*) AS files, arg_max(run_id, rank) AS run_id, sum(n) AS last_seq, max(ms) AS latest_ms FROM o GROUP BY folder""")
def d17_source_status(spark, d):
    none = _headed(spark, d).select("path", F.lit(0).cast("long").alias("bytes"), F.lit(0).cast("long").alias("records")).limit(0)
    raw = _headed(spark, d).select("path", "folder", "file", "modified", "rank", "content")
    _, progress = tail.advance(raw, none)
    return tail.status(progress.withColumn("file", F.split("path", "/")[1].cast("long"))).select("folder", "files", F.col("file").alias("run_id"), "last_seq", "latest_ms")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_FOUND)


def oracle_sql() -> dict[str, str]:
    return {name: f"WITH RECURSIVE {sql.strip()}" for name, sql in _SQL.items()}
