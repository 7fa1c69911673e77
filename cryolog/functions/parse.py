"""Column functions for the texts of machine logs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .profile import ALIASES, COILS, SHELVES

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_MILLISECONDS = "timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {})"


def canonical_channel(code: Column) -> Column:
    upper = F.upper(F.trim(code))
    names = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))
    return F.coalesce(names[upper], upper)


def channel_group(code: Column) -> Column:
    return (
        F.when(code.isin(SHELVES), "shelf").when(code.isin("L_PRES", "H_PRES"), "pressure").when(code == "VACUM", "vacuum")
        .when(code.isin(*COILS, "KONDANSER"), "cooling").otherwise("other")
    )


def _finite(text: Column) -> Column:
    value = F.when(text.rlike(_NUMBER), text.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def number(text: Column) -> Column:
    """A number with a decimal point or comma; of both in a text, the last is the decimal one.  Null if it is none."""
    trimmed = F.trim(text)
    comma_last = F.length(trimmed) - F.instr(F.reverse(trimmed), ",") > F.length(trimmed) - F.instr(F.reverse(trimmed), ".")
    local = F.when(~trimmed.contains(","), None).when(~trimmed.contains("."), F.replace(trimmed, F.lit(","), F.lit("."))).when(
        comma_last, F.replace(F.replace(trimmed, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    ).otherwise(F.replace(trimmed, F.lit(","), F.lit("")))
    return F.coalesce(_finite(trimmed), _finite(local))


def is_timestamp_header(header: Column) -> Column:
    return F.upper(F.translate(F.trim(header), "İı", "II")).isin("TARIH SAAT", "SAAT")


def file_date(name: Column) -> Column:
    """The date in LogFile_YYYY_MM_DD.csv, copies with a number included; null if there is none or it is no date."""
    found = F.regexp_extract(name, r"(?i)^logfile_(\d{4}_\d{2}_\d{2})(?: \(\d+\))?\.csv$", 1)
    return F.try_to_date(F.when(found != "", found), "yyyy_MM_dd")


def is_download_copy(name: Column) -> Column:
    return name.rlike(r"(?i)^logfile_\d{4}_\d{2}_\d{2} \(\d+\)\.csv$") & file_date(name).isNotNull()


_CLOCK = r"(\d{1,2}):(\d{1,2})(?::(\d{1,2})(?:\.(\d{1,9}))?)?"


def _moment(text: Column, pattern: str, order: tuple[int, int, int]) -> Column:
    part = lambda i: F.regexp_extract(text, pattern, i)
    year, month, day = (part(i).try_cast("int") for i in order)
    second = F.concat(F.when(part(6) == "", "0").otherwise(part(6)), F.lit("."), F.rpad(part(7), 3, "0")).try_cast("decimal(8,6)")
    return F.when(text.rlike(pattern), F.try_make_timestamp_ntz(year, month, day, part(4).try_cast("int"), part(5).try_cast("int"), second))


def log_timestamp(text: Column) -> Column:
    """A full timestamp, year first (``-``, space or ``T`` before the time) or day first (dots or slashes); to the millisecond."""
    trimmed = F.trim(text)
    year_first = rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})[-T ]{_CLOCK}$"
    day_first = rf"^(\d{{1,2}})[./](\d{{1,2}})[./](\d{{4}})[- ]{_CLOCK}$"
    return F.coalesce(_moment(trimmed, year_first, (1, 2, 3)), _moment(trimmed, day_first, (3, 2, 1)))


def clock_timestamp(text: Column, date: Column) -> Column:
    """A time of day on ``date``."""
    joined = F.concat(F.date_format(date, "yyyy-MM-dd"), F.lit(" "), F.trim(text))
    return _moment(joined, rf"^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}}) {_CLOCK}$", (1, 2, 3))


def batch_timestamp(text: Column) -> Column:
    """Of a sample batch: a zoned time as UTC wall clock, any other as it stands."""
    zoned = text.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$")
    utc = F.date_trunc("millisecond", F.to_utc_timestamp(F.when(zoned, text).try_cast("timestamp"), F.current_timezone()))
    return F.when(zoned, utc.cast("timestamp_ntz")).otherwise(log_timestamp(text))


def epoch_ms(moment: Column | str) -> Column:
    column = F.col(moment) if isinstance(moment, str) else moment
    start = F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")
    return F.timestamp_diff("MILLISECOND", start, column)


def state_token(text: Column) -> Column:
    return F.upper(F.regexp_replace(F.trim(text), "[^A-Za-z0-9]", "_"))


def zero_like(text: Column) -> Column:
    return F.coalesce(F.abs(number(text)) < F.lit(2.220446049250313e-16), F.lit(False))
