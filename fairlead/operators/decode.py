"""Raw fields to typed position and static records with quality flags.

Where a field lies, what it may hold and which flag it raises are tables; the expressions are made from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.scalar import date_window, fenced, flags, number, outside, unpadded
from ..schemas import DATE_SLACK, DEGREE, FLAG, HARD_INVALID, LAT_LIMIT, LON_LIMIT, MESSAGES, POSITION_COLUMNS, RAW_COLUMNS, RECEIPT_SLACK, STATIC_COLUMNS, TIME_RANGE

# fixed values: where a position's fields lie by kind of communication (None: all other kinds), as the field's number,
# its type (none: text), and the narrower or wider type that it is kept in if that is another
POSITION_FIELDS = {
    "source_id": {1: (3, "smallint")}, "ais_message_id": {1: (4,)}, "pos_time_s": {1: (5, "bigint"), None: (3, "smallint", "bigint")}, "lon_raw": {1: (6, "int"), None: (4, "int")}, "lat_raw": {1: (7, "int"), None: (5, "bigint", "int")},
    "cog_raw": {1: (8, "smallint"), 3: (6, "int", "smallint")}, "sog_raw": {1: (9, "smallint"), 3: (7, "int", "smallint")}, "true_heading": {1: (10, "smallint")}, "navigation_status": {1: (11, "smallint")},
    "rot": {1: (12, "smallint")}, "position_accuracy": {1: (13, "smallint")},
}
# fixed values: where a static record's fields lie by message; texts, and numbers of 16 bits
STATIC_TEXTS = {"imo": {"5": 5}, "callsign": {"5": 6, "24B": 7}, "ship_name": {"5": 7, "19": 5, "24A": 5}, "destination": {"5": 16}, "aton_name": {"21": 6}, "vendor_id": {"24B": 6}, "eta_raw": {"5": 14}}
STATIC_NUMBERS = {
    "ship_type": {"5": 8, "19": 6, "24B": 5}, "length_bow": {"5": 9, "19": 7, "21": 8, "24B": 8}, "length_stern": {"5": 10, "19": 8, "21": 9, "24B": 9}, "breadth_port": {"5": 11, "19": 9, "21": 10, "24B": 10},
    "breadth_starboard": {"5": 12, "19": 10, "21": 11, "24B": 11}, "position_device_type": {"5": 13, "19": 11, "21": 11}, "draught_raw": {"5": 15}, "dte": {"5": 17, "19": 12}, "aton_type": {"21": 5}, "aton_status": {"21": 12},
}
PADDED = [c for c in STATIC_TEXTS if c != "eta_raw"]
# fixed values: the range in which a field raises no flag, and the flag
USUAL = {
    "receive_time_s": (*TIME_RANGE, "invalid_receive_time"), "pos_time_s": (*TIME_RANGE, "invalid_position_time"), "cog_raw": (0, 3599, "cog_unavailable_or_invalid"), "sog_raw": (0, 1022, "sog_unavailable_or_invalid"),
    "navigation_status": (0, 15, "invalid_navigation_status"), "rot": (-128, 127, "invalid_rot"), "position_accuracy": (0, 1, "invalid_position_accuracy"), "mmsi": (1, 999_999_999, "invalid_device_id"),
    "ship_type": (0, 255, "invalid_static_field"), "position_device_type": (0, 15, "invalid_static_field"), "draught_raw": (0, 255, "invalid_static_field"), "dte": (0, 1, "invalid_static_field"),
}
NO_COUNTS = ["CAST(NULL AS SMALLINT) AS field_count", "CAST(NULL AS SMALLINT) AS extension_field_count"]


def _value(place: tuple, lenient: bool) -> str:
    text = f"c{place[0]:02d}"
    value = number(text, place[1], lenient) if len(place) > 1 else text
    return f"try_cast({value} AS {place[2]})" if len(place) > 2 else value


def _choice(chosen: str, places: dict, lenient: bool) -> str:
    cases = "".join(f" WHEN {key!r} THEN {_value(place, lenient)}" for key, place in places.items() if key is not None)
    return f"CASE {chosen}{cases} ELSE {_value(places[None], lenient) if None in places else 'NULL'} END"


def _unusual(columns: list[str]) -> list[tuple[str, int]]:
    return [(outside(c, low, high), FLAG[flag]) for c in columns for low, high, flag in [USUAL[c]]]


def _other_day(times: list[str], record_date: str | None) -> list[tuple[str, int]]:
    """Soft flags of times that do not suit the file's day: given, else by the row's own record_date."""
    start = "unix_date(to_date(record_date)) * 86400L"
    low, high = date_window(record_date) if record_date else (f"{start} - {DATE_SLACK}", f"{start} + {86_400 + DATE_SLACK}")
    return [(outside(t, low, high), FLAG["file_date_mismatch"]) for t in times]


def _finished(t: DataFrame, terms: list[tuple[str, int]], more: dict[str, str], columns: list[str]) -> DataFrame:
    """The record's columns, with the mask of the terms and what is worked out beside it."""
    t = fenced(t.selectExpr("*", f"{flags(terms)} AS dq_mask"))
    more |= {"is_hard_valid": f"dq_mask & {HARD_INVALID} = 0"} | {x.rsplit(" AS ", 1)[1]: x.rsplit(" AS ", 1)[0] for x in NO_COUNTS}
    return t.selectExpr(*(f"{more[c]} AS {c}" if c in more else c for c in columns))


def decode_positions(raw: DataFrame, record_date: str | None = None, lenient: bool = False) -> DataFrame:
    """Position records of raw rows. Every row is decoded; flags tell what is wrong with it.

    Of communication types other than 1 the time comes from a 16-bit field, so real times are null and
    such rows have no mmsi. Numbers too large for their field are null. Null times raise no flag.
    """
    kept = [f"`{c}`" for c in raw.columns if c not in RAW_COLUMNS]
    n = lambda c, kind: number(c, kind, lenient)
    first = raw.selectExpr("*", f"{n('c00', 'tinyint')} AS comm_type")
    t = first.selectExpr(
        *kept, "source_file AS source_member", "comm_type", "c01 AS device_id", f"{n('c01', 'int')} AS device_number", f"{n('c01', 'bigint')} IS NOT NULL AS device_is_number", f"{n('c02', 'bigint')} AS receive_time_s",
        *(f"{_choice('comm_type', places, lenient)} AS {name}" for name, places in POSITION_FIELDS.items()),
    )
    there = "device_number BETWEEN 1 AND 999999999"
    beyond = lambda sign, both: f"abs(CAST(lon_raw AS BIGINT)) {sign} {LON_LIMIT} {both} abs(CAST(lat_raw AS BIGINT)) {sign} {LAT_LIMIT}"
    terms = [
        ("comm_type IS NULL OR comm_type NOT IN (1, 2, 3)", FLAG["unknown_comm_type"]),
        (f"NOT device_is_number OR (comm_type = 1 AND NOT {there})", FLAG["invalid_device_id"]),
        ("lon_raw IS NULL OR lat_raw IS NULL", FLAG["invalid_coordinate"]),
        (beyond(">=", "OR"), FLAG["coordinate_unavailable"]),
        (f"{outside('true_heading', 0, 359)} AND true_heading <> 511", FLAG["heading_unavailable_or_invalid"]),
        (f"pos_time_s > receive_time_s + {RECEIPT_SLACK}", FLAG["position_after_receipt"]),
        *_unusual(["receive_time_s", "pos_time_s", "cog_raw", "sog_raw", "navigation_status", "rot", "position_accuracy"]),
        *_other_day(["receive_time_s", "pos_time_s"], record_date),
    ]
    tenth = lambda c: f"if({c} BETWEEN {USUAL[c][0]} AND {USUAL[c][1]}, {c} / 10.0D, NULL)"
    degrees = lambda c: f"if({beyond('<', 'AND')}, {c} / {DEGREE}D, NULL)"
    more = {"mmsi": f"if(comm_type = 1 AND {there}, device_number, NULL)", "longitude_deg": degrees("lon_raw"), "latitude_deg": degrees("lat_raw"), "cog_deg": tenth("cog_raw"), "sog_kn": tenth("sog_raw")}
    return _finished(fenced(t), terms, more, POSITION_COLUMNS)


def decode_static(raw: DataFrame, record_date: str | None = None, lenient: bool = False) -> DataFrame:
    """Static records of raw rows, the fields placed by the kind of message; null mmsi and times raise no flag."""
    kept = [f"`{c}`" for c in raw.columns if c not in RAW_COLUMNS]
    n = lambda c, kind: number(c, kind, lenient)
    texts = {name: {m: (k,) for m, k in places.items()} for name, places in STATIC_TEXTS.items()}
    numbers = {name: {m: (k, "smallint") for m, k in places.items()} for name, places in STATIC_NUMBERS.items()}
    t = raw.selectExpr(
        *kept, "source_file AS source_member", f"{n('c00', 'tinyint')} AS comm_type", f"{n('c01', 'int')} AS mmsi", f"{n('c02', 'bigint')} AS receive_time_s", f"{n('c03', 'smallint')} AS source_id", "c04 AS ais_message_id",
        *(f"{_choice('c04', places, lenient)} AS {name}" for name, places in (texts | numbers).items()),
    )
    terms = [
        ("comm_type IS NULL OR comm_type <> 1", FLAG["unknown_comm_type"]),
        (f"ais_message_id IS NULL OR ais_message_id NOT IN ({', '.join(map(repr, MESSAGES))})", FLAG["unknown_message_type"]),
        *_unusual(["mmsi", "receive_time_s", "ship_type", "position_device_type", "draught_raw", "dte"]),
        *_other_day(["receive_time_s"], record_date),
    ]
    more = {c: unpadded(c) for c in PADDED} | {"draught_m": "draught_raw / 10.0D", "aton_status": "if(aton_status BETWEEN 0 AND 255, aton_status, NULL)"}
    return _finished(fenced(t), terms, more, STATIC_COLUMNS)
