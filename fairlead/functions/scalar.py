"""Scalar expressions: casts, flags, great circles, event months, sampling instants."""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import DATE_SLACK, EARTH_KM, FLAG


# Expressions over many columns are SQL text: it reaches the planner in one call, where each step of a Column is a call
# of its own, which for a record of forty fields takes longer than to read some ten thousand of them.


def number(column: str, kind: str, lenient: bool = False) -> str:
    """SQL of a number from text, null where it is none or out of range. The strict grammar is that of whole
    numbers; the lenient one also takes decimals and exponents, rounded half away from zero, digits parted by
    single underscores, and hexadecimal numbers after 0x."""
    whole = f"try_cast({column} AS {kind})"
    if not lenient:
        return whole
    text = f"trim({column})"
    parted = f"if({text} RLIKE '^[+-]?[0-9]+(_[0-9]+)+$', replace({text}, '_', ''), {text})"
    sixteen = f"if({text} RLIKE '^0[xX][0-9A-Fa-f]{{1,15}}$', conv(substr({text}, 3), 16, 10), NULL)"
    return f"coalesce({whole}, try_cast(round(try_cast({parted} AS DECIMAL(38, 10))) AS {kind}), try_cast({sixteen} AS {kind}))"


def repaired_text(col: Column) -> Column:
    """struct<text, flag> of a text field's bytes: UTF-8 where it is that, else GB18030 with that flag, else UTF-8 with
    marks for what cannot be read and the flag of invalid text. Blanks around it and the padding at its end go; what
    is then empty is null. Only bytes that are not UTF-8 go through Python."""
    @F.pandas_udf("string")
    def chinese(values: pd.Series) -> pd.Series:
        def read(b):
            try:
                return None if b is None else bytes(b).decode("gb18030")
            except UnicodeDecodeError:
                return None

        return values.map(read)

    good = F.is_valid_utf8(col.cast("string"))
    other = chinese(F.when(~good, col))
    bare = lambda text: F.nullif(F.trim(F.rtrim(F.trim(text), F.lit("@"))), F.lit(""))
    flag = F.when(good | col.isNull(), 0).when(other.isNotNull(), FLAG["text_gb18030"]).otherwise(FLAG["text_invalid_encoding"])
    text = F.when(good, bare(col.cast("string"))).when(other.isNotNull(), bare(other)).otherwise(F.make_valid_utf8(col.cast("string")))
    return F.struct(text.alias("text"), flag.cast("long").alias("flag"))


def flags(terms: list[tuple[str, int]]) -> str:
    """SQL of a bit mask of the conditions that hold; one that is null raises no flag."""
    return " | ".join(f"if({condition}, {bit}L, 0L)" for condition, bit in terms)


def outside(value: str, low, high) -> str:
    return f"{value} NOT BETWEEN {low} AND {high}"


def unpadded(column: str) -> str:
    """SQL of a text without the padding of at signs at its end."""
    return f"rtrim('@', {column})"


def fenced(df: DataFrame) -> DataFrame:
    """The same rows, with columns that later filters and projections take as they are. The planner would
    else write a column's whole expression into every place that uses it, and parse a line many times."""
    return df.selectExpr(f"inline(array(struct({', '.join(f'`{c}`' for c in df.columns)})))")


def file_date(name: str) -> str | None:
    """The first date in a file name, if any."""
    found = re.search(r"20\d{2}-\d{2}-\d{2}", name.replace("\\", "/").rsplit("/", 1)[-1])
    return found[0] if found else None


def date_window(record_date: str) -> tuple[int, int]:
    """Inclusive limits of times that suit a file's day: two days of slack on both sides."""
    start = int(datetime.fromisoformat(record_date).replace(tzinfo=timezone.utc).timestamp())
    return start - DATE_SLACK, start + 86_400 + DATE_SLACK


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance; the pole's own cosine is exactly 0, longitudes wrap."""
    phi1, phi2 = F.radians(lat1), F.radians(lat2)
    turn = F.pmod(lon2 - lon1 + 180.0, F.lit(360.0)) - 180.0
    cosine = lambda lat, phi: F.when(F.abs(lat) == 90.0, 0.0).otherwise(F.cos(phi))
    a = F.pow(F.sin((phi2 - phi1) / 2), 2) + cosine(lat1, phi1) * cosine(lat2, phi2) * F.pow(F.sin(F.radians(turn) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def event_midpoint(start: Column, end: Column) -> Column:
    return start + F.floor((end - start) / 2).cast("long")


def event_month(start: Column, end: Column) -> Column:
    """yyyy-MM of an event's middle, in UTC whatever the session's zone."""
    days = F.floor(event_midpoint(start, end) / 86_400).cast("int")
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), days), "yyyy-MM")


def days_between(first: date, last: date) -> list[date]:
    return [first + timedelta(days=i) for i in range((last - first).days + 1)]


def target_instants(zone: str, hours: list[int], days: list[date]) -> list[tuple[str, int, int, str]]:
    """(sample_date, target_hour, target_time_s, target_time_local) of local hours, in order of hour."""
    tz, out = ZoneInfo(zone), []
    for day in days:
        for hour in sorted(hours):
            moment = datetime(day.year, day.month, day.day, hour, tzinfo=tz)
            out.append((day.isoformat(), hour, int(moment.timestamp()), moment.isoformat()))
    return out


def woa_month(units: str, offset: float) -> int:
    """Natural month of an offset in "months since YYYY-MM-DD"."""
    found = re.fullmatch(r"months since (\d{4})-(\d{1,2})-(\d{1,2}).*", units.strip())
    if not found or not 1 <= int(found[2]) <= 12:
        raise ValueError(f"unusable time units: {units}")
    return (int(found[2]) - 1 + int(offset // 1)) % 12 + 1


def is_tanker_type(ship_type: int | None, tanker_types) -> bool:
    return ship_type is not None and int(ship_type) in set(tanker_types)
