"""The tail by bytes: what it reads, holds back, drains, refuses and numbers."""

from __future__ import annotations

import json
import random
import re

from cryolog.sources import bytetail as source
from cryolog.streaming import bytetail as tail

HEAD = "TARIH SAAT;RAF1;VACUM\n"


def line(day, minute, extra=""):
    return f"2026-08-{day:02d}-00:{minute:02d}:00.000;{minute};0.5{extra}\n"


def read(reader, start, end):
    return [tuple(r.values()) for p in reader.partitions(start, end) for b in reader.read(p) for r in b.to_pylist()]


def test_ranges_are_what_was_appended(tmp_path, monkeypatch):
    monkeypatch.setattr(source, "BLOCK", 7)
    r, reader, path = random.Random(2), source.Reader(f"file://{tmp_path}", "*.csv"), tmp_path / "LogFile_2026_08_14.csv"
    at, whole, seen = reader.initialOffset(), b"", []
    for _ in range(30):
        more = bytes(r.choice(b"ab;\n\r") for _ in range(r.randint(0, 25)))
        # bytes that were read once are spoilt: nothing reads them again
        done = json.loads(at["files"]).get(str(path), [0, 0])[1]
        whole += more
        path.write_bytes(re.sub(rb"[^\n]", b"#", whole[:done]) + whole[done:])
        then = reader.latestOffset()
        ranges = reader.partitions(at, then)
        rows = read(reader, at, then)
        end = json.loads(then["files"]).get(str(path), [0, 0])[1]
        assert end == whole.rfind(b"\n") + 1 or (end == 0 and b"\n" not in whole)
        assert sum(p.end - p.start for p in ranges) == end - done == sum(x[5] - x[4] for x in rows)
        seen += rows
        at = then
    assert [x[6] for x in seen] == [x.removesuffix(b"\r") for x in whole[: whole.rfind(b"\n") + 1].split(b"\n")[:-1]]
    assert [x[4] for x in seen] == [0, *(x[5] for x in seen[:-1])]


def test_rotation_barrier_and_copies(tmp_path):
    reader = source.Reader(f"file://{tmp_path}", "logfile_*.CSV")
    for name, text in (("LogFile_2026_08_15.csv", "a\nb"), ("LogFile_2026_08_14.csv", "a\nb\nc"), ("LogFile_2026_08_16.csv", "a"), ("LogFile_2026_08_17.csv", "a\n"), ("LogFile_2026_08_14 (1).csv", "a\n"), ("other.csv", "a\n")):
        (tmp_path / name).write_text(text)
    ends = {k[-6:-4]: v for k, v in json.loads(reader.latestOffset()["files"]).items()}
    assert ends == {"14": [0, 5], "15": [1, 3]}  # 16 has no line end yet and holds 17 back


def test_stream(spark, tmp_path):
    first, second, odd = (tmp_path / "in" / n for n in ("LogFile_2026_08_14.csv", "LogFile_2026_08_15.csv", "LogFile_2026_08_13.csv"))
    (tmp_path / "in").mkdir()
    kept, got = tail.store(spark, str(tmp_path / "store")), []
    sink = lambda rows, step: got.append((step, sorted((r.seq, r.row_number, r.problem or r.warning, r.raw_line[11:16]) for r in rows.collect())))

    def go():
        got.clear()
        tail.tail_stream(kept, f"file://{tmp_path}/in", str(tmp_path / "check"), [sink]).awaitTermination()
        return [r for _, rows in got for r in rows]

    odd.write_text("SAAT;SAAT;RAF1\nx;y;1\n")  # refused, and no barrier
    first.write_text(HEAD + line(14, 1) + "2026-08-14-00:02")
    assert go() == [(1, 2, None, "00:01")]
    first.write_text(HEAD + line(14, 1) + line(14, 2, ";x") + "\n" + line(14, 3).rstrip("\n"))
    assert go() == [(2, 3, "csv_row_shape_error", "00:02")]
    second.write_text("TARIH SAAT;RAF1")
    assert go() == [(3, 4, None, "00:03")]  # drained, and the rejected row keeps its sequence
    second.write_text(HEAD + line(15, 1) + line(15, 2))
    assert go() == [(4, 2, None, "00:01"), (5, 3, None, "00:02")]
    with first.open("a") as f:  # a file that is followed by another is complete
        f.write("\n" + line(14, 9))
    with second.open("a") as f:
        f.write(line(15, 3))
    assert go() == [(6, 4, None, "00:03")]
    whole = second.read_text()
    second.write_text(HEAD)
    assert go() == []
    second.write_text(whole + line(15, 4))  # it had shrunk: nothing comes twice
    assert go() == [(7, 5, None, "00:04")]
    states = {r.file: (r.state, r.records, r.last_seq) for r in tail.progress(kept).collect()}
    assert states[second.name] == ("read", 4, 7) and states[odd.name][0] == "invalid" and states[first.name] == ("read", 3, 3)


def test_a_step_runs_again(spark, tmp_path):
    rows = [("/d/LogFile_2026_08_14.csv", "/d", "LogFile_2026_08_14.csv", 0, a, b, bytearray(t.encode())) for a, b, t in ((0, 22, HEAD.strip()), (22, 60, line(14, 1).strip()), (60, 98, "noon;1;2"))]
    df, got = spark.createDataFrame(rows, source.SCHEMA), []
    kept = tail.store(spark, str(tmp_path))
    for _ in range(2):
        tail.run_step(kept, df, 0, [lambda r, step: got.append(sorted((x.seq, x.problem) for x in r.collect()))])
    assert got == [[(1, None), (2, "csv_row_timestamp_error")]] * 2 and tail.progress(kept).first().bytes == 98
    later = [rows[0][:4] + (98, 120, bytearray(line(14, 2).strip().encode())), rows[1]]
    tail.run_step(kept, spark.createDataFrame(later, source.SCHEMA), 1, [lambda r, step: got.append([(x.seq, x.row_number) for x in r.collect()])])
    assert got[2] == [(3, 4)]
