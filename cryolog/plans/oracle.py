"""The same queries in SQL, the state machine stepped frame by frame."""

from __future__ import annotations

FRAMES = """
raw AS (SELECT user_id AS run_id, event_id, ts, event_type AS kind, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
frames AS (
  SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) AS seq, 1704067200000 + (epoch_us(ts) - 1704067200000000) // 60000 AS ms, k, kind,
    CASE WHEN kind = 'error' THEN 850.0::DOUBLE ELSE value - 50 END AS RAF1, CASE WHEN kind IN ('error', 'signup') THEN 850.0::DOUBLE ELSE value - 50 END AS RAF2,
    CASE WHEN k % 17 <> 0 THEN value / 10 END AS VACUM, CAST((k - 60) AS DOUBLE) / 2 AS S2, CAST(k * 7 % 50 - 30 AS DOUBLE) AS S4,
    CASE WHEN kind <> 'view' THEN value END AS power, CASE WHEN kind IN ('click', 'purchase') THEN CAST(k AS DOUBLE) END AS weight,
    CASE WHEN run_id % 3 = 0 THEN 'completed' ELSE 'running' END AS run_status FROM raw),
basics AS (
  SELECT *, sum(CASE WHEN gap_min > 40 THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY ms, seq) AS chain, coalesce(gap_min > 40, false) AS reset FROM (
    SELECT *, CAST(abs(RAF1 - 850) > 0.5 AS INTEGER) + CAST(abs(RAF2 - 850) > 0.5 AS INTEGER) AS active, greatest(S2, S4) AS coil,
      (ms - lag(ms) OVER (PARTITION BY run_id ORDER BY ms, seq)) / 60000.0::DOUBLE AS gap_min, row_number() OVER (PARTITION BY run_id ORDER BY ms, seq) AS rn FROM frames))"""
STATES = (
    FRAMES
    + """,
flags AS (SELECT *, coalesce(active > 0 AND VACUM < 2, false) AS s, coalesce(active = 0 OR VACUM > 4, false) AS p, coalesce(coil >= 0, false) AS hot, coalesce(power < 5, false) AS low FROM basics),
steps AS (
  SELECT *, CASE WHEN s THEN 'START' ELSE 'WAIT' END AS state FROM flags WHERE rn = 1
  UNION ALL
  SELECT f.*, CASE
    WHEN f.reset THEN CASE WHEN f.s THEN 'START' ELSE 'WAIT' END
    WHEN x.state = 'START' THEN CASE WHEN f.s THEN 'DRY' ELSE 'STOP' END
    WHEN x.state = 'DRY' THEN CASE WHEN f.p THEN 'STOP' ELSE 'DRY' END
    WHEN f.s THEN 'START'
    WHEN x.state IN ('STOP', 'WAIT') THEN CASE WHEN f.hot THEN 'DEFROST' ELSE 'WAIT' END
    WHEN x.state = 'DEFROST' THEN CASE WHEN f.low THEN 'DEFROST_STOP' ELSE 'DEFROST' END
    ELSE 'DEFROST_STOP' END
  FROM steps x JOIN flags f ON f.run_id = x.run_id AND f.rn = x.rn + 1),
entered AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY run_id, chain ORDER BY rn) <> state, true) AS enters FROM steps),
numbered AS (
  SELECT *, sum(CAST(enters AS INTEGER)) OVER (PARTITION BY run_id ORDER BY rn) AS segment,
    sum(CAST(enters AND state = 'START' AS INTEGER)) OVER (PARTITION BY run_id ORDER BY rn) AS loops,
    sum(CAST(enters AND state = 'START' AS INTEGER)) OVER (PARTITION BY run_id, chain ORDER BY rn) AS chain_loops FROM entered),
looped AS (SELECT *, CASE WHEN chain_loops > 0 THEN loops END AS loop FROM numbered),
stays AS (
  SELECT run_id, segment, min(state) AS state, min(chain) AS chain, min(loop) AS loop, min(ms) AS started_ms, max(ms) AS last_ms, arg_min(seq, rn) AS start_seq, arg_max(seq, rn) AS end_seq, count(*) AS frames, min(run_status) AS run_status
  FROM looped GROUP BY run_id, segment),
segments AS (
  SELECT *, CASE WHEN lead(chain) OVER w = chain THEN lead(started_ms) OVER w WHEN lead(chain) OVER w IS NOT NULL THEN last_ms WHEN run_status <> 'running' THEN last_ms END AS finished_ms
  FROM stays WINDOW w AS (PARTITION BY run_id ORDER BY segment)),
cycles0 AS (
  SELECT run_id, loop, min(chain) AS chain, min(started_ms) AS started_ms, min(started_ms) FILTER (state = 'DRY') AS dry_ms, min(started_ms) FILTER (state = 'STOP') AS stop_ms,
    min(started_ms) FILTER (state = 'WAIT') AS wait_ms, min(started_ms) FILTER (state = 'DEFROST') AS defrost_ms, min(started_ms) FILTER (state = 'DEFROST_STOP') AS defrost_stop_ms, min(run_status) AS run_status
  FROM segments WHERE loop IS NOT NULL GROUP BY run_id, loop),
cycles1 AS (
  SELECT c.*, lead(c.started_ms) OVER w AS next_ms, lead(c.chain) OVER w AS next_chain, r.last_chain, r.run_last, h.chain_last
  FROM cycles0 c JOIN (SELECT run_id, max(chain) AS last_chain, max(ms) AS run_last FROM looped GROUP BY run_id) r USING (run_id)
  JOIN (SELECT run_id, chain, max(ms) AS chain_last FROM looped GROUP BY run_id, chain) h USING (run_id, chain) WINDOW w AS (PARTITION BY c.run_id ORDER BY c.loop)),
cycles AS (
  SELECT *, CASE WHEN next_chain = chain THEN CASE WHEN defrost_stop_ms IS NOT NULL THEN 'a' ELSE 'b' END WHEN chain < last_chain THEN CASE WHEN defrost_stop_ms IS NOT NULL THEN 'a' ELSE 'c' END
    WHEN run_status = 'running' THEN CASE WHEN defrost_stop_ms IS NOT NULL THEN 'a' ELSE 'd' END WHEN defrost_stop_ms IS NOT NULL THEN 'e' ELSE 'f' END AS kind FROM cycles1),
comparable AS (SELECT *, S4 - S2 AS deviation FROM looped WHERE VACUM IS NOT NULL),
priors AS (
  SELECT c.run_id, c.seq, c.ms, c.deviation, c.VACUM, p.seq AS prior_seq, p.deviation AS prior_deviation, p.vacuum AS prior_vacuum,
    (SELECT arg_max(l.loop, l.rn) FROM looped l WHERE l.run_id = c.run_id AND l.rn = c.peer) AS loop
  FROM (SELECT *, max(rn) OVER (PARTITION BY run_id, ms) AS peer FROM comparable) c, LATERAL (
    SELECT q.seq, q.ms, q.deviation, q.VACUM AS vacuum FROM comparable q WHERE q.run_id = c.run_id AND q.rn < c.rn ORDER BY abs(q.ms - (c.ms - 1800000)), q.ms, q.seq LIMIT 1) p
  WHERE abs((c.ms - p.ms) / 60000.0 - 30) <= 10),
parallel AS (
  SELECT *, CASE WHEN recovery >= 3 AND vacuum_change <= -0.2::DOUBLE THEN 'fd750_s4_vacuum_recovery' WHEN change >= 3 AND vacuum_change >= 0.2::DOUBLE THEN 'fd750_s4_vacuum_rise' END AS event_type
  FROM (SELECT *, deviation - prior_deviation AS change, abs(prior_deviation) - abs(deviation) AS recovery, VACUM - prior_vacuum AS vacuum_change FROM priors))"""
)
DERIVED = (
    FRAMES
    + """,
energy AS (
  SELECT *, CASE WHEN gap_min >= 0 AND gap_min <= 15 THEN (lag(power) OVER w + power) / 2 * (gap_min / 60) END AS interval_kwh,
    weight - last_value(weight IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS weight_delta FROM basics WINDOW w AS (PARTITION BY run_id ORDER BY ms, seq)),
derived AS (SELECT *, CASE WHEN power IS NOT NULL THEN coalesce(sum(interval_kwh) OVER (PARTITION BY run_id ORDER BY ms, seq), 0) END AS cumulative_kwh FROM energy)"""
)
CELLS = (
    FRAMES
    + """,
cells AS (SELECT * FROM (
  SELECT run_id, seq, ms, 'RAF1' AS channel, RAF1 AS value, 1 AS rank FROM frames UNION ALL SELECT run_id, seq, ms, 'RAF2', RAF2, 2 FROM frames UNION ALL SELECT run_id, seq, ms, 'VACUM', VACUM, 3 FROM frames
  UNION ALL SELECT run_id, seq, ms, 'S2', S2, 4 FROM frames UNION ALL SELECT run_id, seq, ms, 'S4', S4, 5 FROM frames UNION ALL SELECT run_id, seq, ms, 'E.GUC', power, 6 FROM frames UNION ALL SELECT run_id, seq, ms, 'TARTIM', weight, 7 FROM frames) WHERE value IS NOT NULL)"""
)
SWAPPED = (
    FRAMES
    + """,
swapped AS (SELECT run_id, seq, CASE WHEN k % 23 = 0 THEN ms - 1800000 ELSE ms END AS ms, (seq - 1) // 10 AS batch_id FROM frames),
gaps AS (SELECT run_id, seq, (ms - lag(ms) OVER (PARTITION BY run_id ORDER BY seq)) / 1000.0::DOUBLE AS gap_seconds FROM swapped),
gap_events AS (SELECT *, CASE WHEN gap_seconds < 0 THEN 'timestamp_out_of_order' ELSE 'time_gap' END AS event_type FROM gaps WHERE gap_seconds < 0 OR gap_seconds > 360)"""
)
BOUNDS = FRAMES + ", bounds AS (SELECT run_id, min(ms) AS started_ms, max(ms) AS finished_ms, max(seq) AS last_seq FROM frames GROUP BY run_id)"
RAW = FRAMES + """,
texts AS (SELECT event_id, k, CASE k % 8 WHEN 0 THEN concat(k, '.25') WHEN 1 THEN '10,5' WHEN 2 THEN '1.234,5' WHEN 3 THEN '1,234.5' WHEN 4 THEN '#VALUE!' WHEN 5 THEN '' WHEN 6 THEN '1f' ELSE 'NaN' END AS raw_text FROM raw),
numbers AS (SELECT *, CASE k % 8 WHEN 0 THEN try_cast(raw_text AS DOUBLE) WHEN 1 THEN 10.5 WHEN 2 THEN 1234.5 WHEN 3 THEN 1234.5 END AS value FROM texts)"""  # fmt: skip
_T = {
    "d10_active_shelves": (FRAMES, "SELECT run_id, seq, active, round(coil, 6) AS coil FROM basics"),
    "e3_gap_minutes": (FRAMES, "SELECT run_id, seq, round(gap_min, 6) AS gap_min FROM basics"),
    "e7_chains": (FRAMES, "SELECT run_id, seq, CAST(chain AS BIGINT) AS chain FROM basics"),
    "e4_interval_energy": (DERIVED, "SELECT run_id, seq, interval_kwh FROM derived WHERE interval_kwh IS NOT NULL"),
    "e5_cumulative_energy": (DERIVED, "SELECT run_id, seq, round(cumulative_kwh, 4) AS cumulative_kwh FROM derived WHERE cumulative_kwh IS NOT NULL"),
    "e6_weight_change": (DERIVED, "SELECT run_id, seq, weight_delta, -weight_delta AS weight_loss FROM derived WHERE weight_delta IS NOT NULL"),
    "e15_derived_measurements": (DERIVED, """SELECT run_id, seq, code, CASE WHEN code = 'CUMULATIVE_ENERGY_KWH' THEN round(value, 4) ELSE value END AS value, unit FROM (
      SELECT run_id, seq, 'ACTIVE_SHELF_COUNT' AS code, CAST(active AS DOUBLE) AS value, 'count' AS unit FROM derived UNION ALL SELECT run_id, seq, 'HOTTEST_COIL_C', coil, '°C' FROM derived
      UNION ALL SELECT run_id, seq, 'S4_S2_DEVIATION_C', S4 - S2, '°C' FROM derived UNION ALL SELECT run_id, seq, 'INTERVAL_ENERGY_KWH', interval_kwh, 'kWh' FROM derived
      UNION ALL SELECT run_id, seq, 'CUMULATIVE_ENERGY_KWH', cumulative_kwh, 'kWh' FROM derived UNION ALL SELECT run_id, seq, 'WEIGHT_DELTA_KG', weight_delta, 'kg' FROM derived
      UNION ALL SELECT run_id, seq, 'WEIGHT_LOSS_KG', -weight_delta, 'kg' FROM derived) WHERE value IS NOT NULL"""),
    "i10_resumed_analysis": (STATES + DERIVED.removeprefix(FRAMES), """SELECT run_id, seq, CAST(l.chain AS BIGINT) AS chain, CAST(l.segment AS BIGINT) AS segment, l.state, CAST(l.loop AS BIGINT) AS loop, weight_delta,
      round(cumulative_kwh, 4) AS cumulative_kwh FROM looped l JOIN derived USING (run_id, seq)"""),
    "e8_state_inference": (STATES, "SELECT run_id, seq, state FROM steps"),
    "e9_state_segments": (STATES, "SELECT run_id, CAST(segment AS BIGINT) AS segment, state, CAST(loop AS BIGINT) AS loop, started_ms, finished_ms, start_seq, end_seq, frames, CASE WHEN loop IS NOT NULL THEN 0.95::DOUBLE ELSE 0.55::DOUBLE END AS confidence FROM segments"),
    "e10_loop_numbers": (STATES, "SELECT run_id, seq, CAST(loop AS BIGINT) AS loop FROM looped"),
    "e11_cycle_milestones": (STATES, "SELECT run_id, CAST(loop AS BIGINT) AS loop, started_ms, dry_ms, stop_ms, wait_ms, defrost_ms, defrost_stop_ms FROM cycles"),
    "e12_cycle_outcome": (STATES, """SELECT run_id, CAST(loop AS BIGINT) AS loop, CASE kind WHEN 'a' THEN defrost_stop_ms WHEN 'b' THEN next_ms WHEN 'c' THEN chain_last WHEN 'e' THEN run_last WHEN 'f' THEN run_last END AS finished_ms,
      CASE kind WHEN 'c' THEN 'interrupted' WHEN 'd' THEN 'active' WHEN 'f' THEN 'incomplete' ELSE 'completed' END AS status,
      CAST(CASE kind WHEN 'a' THEN 0.98 WHEN 'b' THEN 0.82 WHEN 'c' THEN 0.45 WHEN 'd' THEN 0.95 WHEN 'e' THEN 0.90 ELSE 0.60 END AS DOUBLE) AS confidence FROM cycles"""),
    "e13_chain_resets": (STATES, """SELECT run_id, seq, ms, 'fd750_state_chain_reset' AS event_type, CAST(before_loop AS BIGINT) AS loop, round(gap_min, 6) AS gap_min, 40.0::DOUBLE AS limit_min, previous_seq
      FROM (SELECT *, lag(loop) OVER w AS before_loop, lag(seq) OVER w AS previous_seq FROM looped WINDOW w AS (PARTITION BY run_id ORDER BY rn)) WHERE reset"""),
    "c12_nearest_prior": (STATES, "SELECT run_id, seq, prior_seq FROM parallel"),
    "c13_segment_at": (STATES, "SELECT run_id, seq, CAST(loop AS BIGINT) AS loop FROM parallel"),
    "e14_parallel_diagnostics": (STATES, "SELECT run_id, seq, ms, prior_seq, CAST(loop AS BIGINT) AS loop, round(change, 6) AS change, round(recovery, 6) AS recovery, round(vacuum_change, 6) AS vacuum_change, event_type FROM parallel WHERE event_type IS NOT NULL"),
    "d5_diagnostic_counts": (STATES, "SELECT run_id, event_type, count(*) AS n FROM parallel WHERE event_type IS NOT NULL GROUP BY ALL"),
    "e23_current_state": (STATES, "SELECT run_id, arg_max(state, segment) AS state, CAST(max(segment) AS BIGINT) AS segments FROM segments GROUP BY run_id"),
    "c14_interval_overlap": (STATES, "SELECT run_id, CAST(segment AS BIGINT) AS segment, state FROM segments WHERE coalesce(finished_ms, started_ms) >= 1704074400000 AND started_ms <= 1704096000000"),
    "e21_state_bands": (STATES, """SELECT run_id, state, from_ms, to_ms FROM (
      SELECT run_id, state, greatest(started_ms, lo) AS from_ms, least(coalesce(finished_ms, hi), hi) AS to_ms FROM segments JOIN (
        SELECT run_id, min(ms) AS lo, max(ms) AS hi FROM (SELECT run_id, ms, max(ms) OVER (PARTITION BY run_id) AS latest FROM frames) WHERE ms > latest - 86400000 GROUP BY run_id) USING (run_id)) WHERE to_ms > from_ms"""),
    "e1_gap_events": (SWAPPED, "SELECT run_id, seq, round(gap_seconds, 6) AS gap_seconds, event_type FROM gap_events"),
    "e2_append_gap_events": (SWAPPED, """SELECT run_id, seq, CASE WHEN gap < 0 THEN 'timestamp_out_of_order' ELSE 'time_gap' END AS event_type FROM (
      SELECT s.run_id, s.seq, (s.ms - coalesce(lag(s.ms) OVER (PARTITION BY s.run_id, s.batch_id ORDER BY s.seq), (SELECT max(x.ms) FROM swapped x WHERE x.run_id = s.run_id AND x.batch_id < s.batch_id))) / 1000.0 AS gap FROM swapped s) WHERE gap < 0 OR gap > 360"""),
    "d4_quality_buckets": (SWAPPED, "SELECT run_id, count(*) AS total, count(*) FILTER (event_type = 'time_gap') AS time_gap, count(*) FILTER (event_type <> 'time_gap') AS other FROM gap_events GROUP BY run_id"),
    "d1_run_bounds": (BOUNDS, "SELECT run_id, started_ms, finished_ms FROM bounds"),
    "d11_timeline_extent": (BOUNDS, "SELECT run_id, started_ms, finished_ms, finished_ms - started_ms AS span_ms FROM bounds"),
    "d12_next_sequence": (BOUNDS, "SELECT run_id, last_seq, last_seq + 1 AS next_seq FROM bounds"),
    "d2_channel_count": (CELLS, "SELECT run_id, count(DISTINCT channel) AS channels FROM cells GROUP BY run_id"),
    "d8_channel_medians": (CELLS, "SELECT run_id, channel, round(median(value), 6) AS median FROM cells WHERE NOT (channel IN ('RAF1', 'RAF2') AND abs(value - 850) <= 0.5) GROUP BY ALL"),
    "d14_channel_order": (CELLS, "SELECT run_id, channel, min(seq) AS seq, CAST(arg_min(rank, seq) AS BIGINT) AS rank FROM cells GROUP BY ALL"),
    "c1_frame_cells": (CELLS, "SELECT run_id, seq, channel, CASE WHEN channel LIKE 'RAF%' THEN 'shelf' WHEN channel = 'VACUM' THEN 'vacuum' WHEN channel IN ('S2', 'S4') THEN 'cooling' ELSE 'other' END AS \"group\", round(value, 6) AS value FROM cells"),
    "d9_shelf_average": (FRAMES, """SELECT run_id, seq, round((CASE WHEN abs(RAF1 - 850) > 0.5 THEN RAF1 ELSE 0 END + CASE WHEN abs(RAF2 - 850) > 0.5 THEN RAF2 ELSE 0 END) / nullif(active, 0), 6) AS shelf_average FROM basics"""),
    "e16_rolling_day": (FRAMES, "SELECT run_id, seq, ms FROM (SELECT *, max(ms) OVER (PARTITION BY run_id) AS latest FROM frames) WHERE ms > latest - 86400000"),
    "e17_gap_breaks": (FRAMES, """SELECT run_id, ms, CAST(NULL AS DOUBLE) AS value FROM (
      SELECT run_id, unnest([b + 1, ms - 1]) AS ms FROM (SELECT run_id, ms, lag(ms) OVER (PARTITION BY run_id ORDER BY ms, seq) AS b FROM frames) WHERE ms - b > 360000)"""),
    "e18_line_series": (FRAMES, """SELECT run_id, seq, ms, 'RAF1' AS channel, round(CASE WHEN abs(RAF1 - 850) > 0.5 THEN RAF1 END, 6) AS value FROM frames
      UNION ALL SELECT run_id, seq, ms, 'RAF2', round(CASE WHEN abs(RAF2 - 850) > 0.5 THEN RAF2 END, 6) FROM frames UNION ALL SELECT run_id, seq, ms, 'VACUM', round(VACUM, 6) FROM frames"""),
    "f1_first_frames": (FRAMES, "SELECT run_id, seq, ms FROM frames ORDER BY ms, run_id, seq LIMIT 500"),
    "f2_latest_frames": (FRAMES, "SELECT run_id, seq, ms FROM frames QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY ms DESC, seq DESC) <= 20"),
    "f3_after_sequence": (FRAMES, "SELECT run_id, seq, ms FROM frames WHERE seq > 10 QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY seq) <= 15"),
    "g1_incremental_merge": (FRAMES, """SELECT run_id, seq, ms, origin FROM (SELECT run_id, seq, ms, CASE WHEN seq % 2 = 0 THEN 'incoming' ELSE 'current' END AS origin FROM frames WHERE seq % 3 <> 0 OR seq % 2 = 0)
      QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) <= 25"""),
    "c8_idempotent_append": (FRAMES, "SELECT run_id, seq, ms FROM frames WHERE seq % 2 = 0 AND seq % 3 <> 0"),
    "b5_number_parse": (RAW, "SELECT event_id, value FROM numbers"),
    "b11_cell_quality": (RAW, """SELECT event_id, value AS numeric_value, CASE WHEN value IS NULL THEN raw_text END AS value_text, CASE WHEN value IS NULL THEN 'text' ELSE 'number' END AS value_type,
      CASE WHEN value IS NULL THEN 'invalid' ELSE 'good' END AS quality, CASE WHEN value IS NULL THEN 'numeric_parse_error' END AS quality_reason FROM numbers"""),
    "b2_canonical_channel": (RAW, """SELECT event_id, ['RAF1', 'S1', 'S2', 'KONDANSER', 'VACUM', 'E.GUC', 'RAF3'][k % 7 + 1] AS code, ['shelf', 'cooling', 'cooling', 'cooling', 'vacuum', 'other', 'shelf'][k % 7 + 1] AS "group" FROM texts"""),
    "b6_timestamp_parse": (RAW, """SELECT event_id, CASE k % 4 WHEN 0 THEN epoch_ms(make_timestamp(2024, 1, 5, 10, k % 60, 7.123)) WHEN 1 THEN epoch_ms(make_timestamp(2024, 1, 5, 9, k % 60, 0)) WHEN 3 THEN epoch_ms(make_timestamp(2024, 1, 5, 10, 0, k % 60)) END AS ms FROM texts"""),
    "b18_state_token": (RAW, "SELECT event_id, concat('STEP_', k, '_A') AS token, k % 3 = 0 AS zero FROM texts"),
    "e22_recipe_segments": (FRAMES, """SELECT run_id, CAST(segment AS BIGINT) AS segment, state_id, started_ms, coalesce(lead(started_ms) OVER (PARTITION BY run_id ORDER BY segment), CASE WHEN n > 1 THEN last_ms END) AS finished_ms FROM (
      SELECT run_id, segment, min(state_id) AS state_id, arg_min(ms, seq) AS started_ms, arg_max(ms, seq) AS last_ms, count(*) AS n FROM (
        SELECT *, sum(e) OVER (PARTITION BY run_id ORDER BY seq) AS segment FROM (
          SELECT *, CASE WHEN lag(state_id) OVER (PARTITION BY run_id ORDER BY seq) = state_id THEN 0 ELSE 1 END AS e FROM (
            SELECT run_id, seq, ms, CAST(CASE kind WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 END AS BIGINT) AS state_id FROM frames) WHERE state_id IS NOT NULL)) GROUP BY run_id, segment)"""),
    "j2_status_fold": (BOUNDS, """SELECT run_id, arg_max(status, seq) AS status, arg_max_null(fin, seq) AS finished_ms, arg_max(notes, seq) FILTER (notes IS NOT NULL) AS notes FROM (
      SELECT run_id, seq, status, coalesce(CASE WHEN k % 2 = 0 THEN ms END, CASE WHEN status <> 'running' THEN finished_ms END) AS fin, CASE WHEN k % 5 = 0 THEN concat('note ', k) END AS notes FROM (
        SELECT f.*, b.finished_ms, CASE kind WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'running' ELSE 'completed' END AS status FROM frames f JOIN bounds b USING (run_id) WHERE kind IN ('error', 'signup', 'purchase'))) GROUP BY run_id"""),
}


def oracle_sql() -> dict[str, str]:
    return {name: f"WITH RECURSIVE {base}\n{select}" for name, (base, select) in _T.items()}
