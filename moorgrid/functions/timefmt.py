"""Times and durations for display; stored times are epoch seconds as double, in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TIME_FORMAT = "dd.MM.yyyy, HH:mm:ss"


_PATTERNS = {"%d": "dd", "%m": "MM", "%Y": "yyyy", "%y": "yy", "%H": "HH", "%M": "mm", "%S": "ss"}


def java_pattern(fmt: str) -> str:
    """Spark's form of a strftime format with these fields."""
    for a, b in _PATTERNS.items():
        fmt = fmt.replace(a, b)
    return fmt


def to_timestamp(seconds: Column) -> Column:
    return F.timestamp_micros(F.floor(seconds * 1000000).cast("bigint"))


def strftime(seconds: Column, fmt: str = TIME_FORMAT) -> Column:
    return F.date_format(to_timestamp(seconds), fmt)


def to_unix_seconds(ts: Column) -> Column:
    """Epoch seconds of a timestamp; one without a zone is in UTC."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1000000.0)


def iso_seconds(text: Column) -> Column:
    """Epoch seconds of an ISO text; an offset in it is dropped, as the writer always means UTC. Null if malformed."""
    plain = F.regexp_replace(text, r"(Z|[+-]\d{2}:?\d{2})$", "")
    ok = plain.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?$")
    return F.when(ok, to_unix_seconds(F.try_to_timestamp(F.replace(plain, F.lit("T"), F.lit(" ")))))


def since(as_of: float, seconds: Column) -> Column:
    return F.lit(float(as_of)) - seconds


def format_timedelta(seconds: Column) -> Column:
    """'1d 2h 3m 4s' without zero parts; a fraction of a second is dropped, a negative day shows no day."""
    whole = F.floor(seconds)
    day = F.floor(whole / 86400)
    rest = whole - day * 86400
    parts = [(day, "d"), (F.floor(rest / 3600), "h"), (F.floor(rest % 3600 / 60), "m"), (rest % 60, "s")]
    shown = [F.when(v > 0, F.concat(v.cast("bigint").cast("string"), F.lit(u))) for v, u in parts]
    return F.when(seconds.isNotNull(), F.concat_ws(" ", *shown))


def register(spark) -> None:
    """format_timedelta(seconds) and show_time(seconds) as functions of the session's SQL."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION show_time(s DOUBLE) RETURNS STRING RETURN date_format(timestamp_micros(CAST(floor(s * 1000000) AS BIGINT)), 'dd.MM.yyyy, HH:mm:ss')")
    day, rest = "floor(floor(s) / 86400)", "(floor(s) - floor(floor(s) / 86400) * 86400)"
    parts = [(day, "d"), (f"floor({rest} / 3600)", "h"), (f"floor({rest} % 3600 / 60)", "m"), (f"({rest} % 60)", "s")]
    shown = ", ".join(f"CASE WHEN {v} > 0 THEN concat(CAST(CAST({v} AS BIGINT) AS STRING), '{u}') END" for v, u in parts)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION format_timedelta(s DOUBLE) RETURNS STRING RETURN CASE WHEN s IS NOT NULL THEN concat_ws(' ', {shown}) END")
