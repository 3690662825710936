"""Queries of the engine by name, with the SQL that checks them.

Sizes of the tables that are broadcast are fixed (sampling instants) or left to the planner.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import adapters as a
from .functions.scalar import days_between, event_month, haversine_km
from .operators import decode, density, quality, sampling, spatial, vessels
from .schemas import FLAG, RAW_COLUMNS, SHARD_COLUMNS
from .sources.dat import read_dat, split_fields
from .sources.tables import read_union

DAYS = days_between(date(2024, 1, 1), date(2024, 1, 30))
HOURS = list(range(0, 24, 3))
EXTENT, CELL = (-60.0, 60.0, -40.0, 40.0), 2.5

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _fields(lines: str, n: int) -> str:
    """SQL form of `split_fields`."""
    return f"(SELECT line_number, {', '.join(f'''nullif(p[{i + 1}], '') AS c{i:02d}''' for i in range(n))} FROM (SELECT line_number, string_split(value, '~') AS p FROM {lines}))"


def positions(spark, sf_dir) -> DataFrame:
    return decode.decode_positions(split_fields(a.raw_lines(spark, sf_dir)), "2024-01-15")


def static(spark, sf_dir) -> DataFrame:
    return decode.decode_static(split_fields(a.static_lines(spark, sf_dir)), None)


def registry(spark, sf_dir) -> DataFrame:
    return vessels.vessel_registry(vessels.static_shard(static(spark, sf_dir)), a.TANKER_TYPES)


def tracks(spark, sf_dir) -> DataFrame:
    """Clean positions of the vessels that the registry has as tankers."""
    p = decode.decode_positions(split_fields(a.clean_lines(spark, sf_dir)), "2024-01-15")
    return vessels.tanker_positions(p, vessels.tanker_registry(registry(spark, sf_dir)))


def samples(spark, sf_dir, tolerance: int = 1800) -> DataFrame:
    return sampling.sample_nearest(tracks(spark, sf_dir), sampling.sampling_targets(spark, "UTC", HOURS, DAYS), tolerance)


_DAY = 1_705_276_800  # 2024-01-15
_LOW, _HIGH = _DAY - 172_800, _DAY + 259_200

# fixed values: where a position's fields lie, by kind of communication (0: all others): number of the field, and the
# SQL types that its text is taken through, one after another
_POSITION_FIELDS = {
    "source_id": {1: (3, "SMALLINT")},
    "ais_message_id": {1: (4,)},
    "pos_time_s": {1: (5, "BIGINT"), 0: (3, "SMALLINT", "BIGINT")},
    "lon_raw": {1: (6, "INTEGER"), 0: (4, "INTEGER")},
    "lat_raw": {1: (7, "INTEGER"), 0: (5, "BIGINT", "INTEGER")},
    "cog_raw": {1: (8, "SMALLINT"), 3: (6, "INTEGER", "SMALLINT")},
    "sog_raw": {1: (9, "SMALLINT"), 3: (7, "INTEGER", "SMALLINT")},
    "true_heading": {1: (10, "SMALLINT")},
    "navigation_status": {1: (11, "SMALLINT")},
    "rot": {1: (12, "SMALLINT")},
    "position_accuracy": {1: (13, "SMALLINT")},
}
# fixed values: where a static record's fields lie, by message; texts lose their padding, numbers are 16 bits wide
_STATIC_TEXTS = {"imo": {"5": 5}, "callsign": {"5": 6, "24B": 7}, "ship_name": {"5": 7, "19": 5, "24A": 5}, "destination": {"5": 16}, "aton_name": {"21": 6}, "vendor_id": {"24B": 6}}
_STATIC_NUMBERS = {
    "ship_type": {"5": 8, "19": 6, "24B": 5}, "length_bow": {"5": 9, "19": 7, "21": 8, "24B": 8}, "length_stern": {"5": 10, "19": 8, "21": 9, "24B": 9},
    "breadth_port": {"5": 11, "19": 9, "21": 10, "24B": 10}, "breadth_starboard": {"5": 12, "19": 10, "21": 11, "24B": 11}, "position_device_type": {"5": 13, "19": 11, "21": 11},
    "draught_raw": {"5": 15}, "dte": {"5": 17, "19": 12}, "aton_type": {"21": 5}, "aton_status": {"21": 12},
}
# fixed values: the range in which a field raises no flag
_IN_RANGE = {
    "cog_raw": (0, 3599, "cog_unavailable_or_invalid"), "sog_raw": (0, 1022, "sog_unavailable_or_invalid"), "navigation_status": (0, 15, "invalid_navigation_status"), "rot": (-128, 127, "invalid_rot"),
    "position_accuracy": (0, 1, "invalid_position_accuracy"), "receive_time_s": (946_684_800, 4_102_444_800, "invalid_receive_time"), "pos_time_s": (946_684_800, 4_102_444_800, "invalid_position_time"),
    "mmsi": (1, 999_999_999, "invalid_device_id"), "ship_type": (0, 255, "invalid_static_field"), "position_device_type": (0, 15, "invalid_static_field"), "draught_raw": (0, 255, "invalid_static_field"), "dte": (0, 1, "invalid_static_field"),
}


def _taken(field: tuple) -> str:
    """A field's text through its types; what does not fit one of them is null."""
    value = f"c{field[0]:02d}"
    for kind in field[1:]:
        value = f"try_cast({value} AS {kind})"
    return value


def _placed(chosen: str, places: dict) -> str:
    """The field of the place that `chosen` names; the place 0 stands for all other names, and none."""
    known = [f"WHEN {chosen} = {key!r} THEN {_taken(place)}" for key, place in places.items() if key != 0]
    return f"CASE {' '.join(known)}{f' ELSE {_taken(places[0])}' if 0 in places else ''} END"


def _mask(raised: list[tuple[str, str]], ranges: list[str]) -> str:
    """The flags of the conditions that hold; a condition that is null raises none."""
    raised = [*raised, *((_IN_RANGE[c][2], f"{c} NOT BETWEEN {_IN_RANGE[c][0]} AND {_IN_RANGE[c][1]}") for c in ranges)]
    by_flag: dict[str, list[str]] = {}
    for flag, condition in raised:
        by_flag.setdefault(flag, []).append(f"coalesce({condition}, false)")
    return " + ".join(f"{FLAG[flag]} * ({' OR '.join(conditions)})::INTEGER" for flag, conditions in by_flag.items())


_NUMBERED = "try_cast(c00 AS TINYINT) AS comm_type, try_cast(c02 AS BIGINT) AS receive_time_s"
_POS_MASK = _mask(
    [
        ("unknown_comm_type", "comm_type IS NULL OR comm_type NOT IN (1, 2, 3)"), ("invalid_device_id", "try_cast(device_id AS BIGINT) IS NULL"), ("invalid_device_id", "comm_type = 1 AND device_number NOT BETWEEN 1 AND 999999999"),
        ("invalid_coordinate", "lon_raw IS NULL OR lat_raw IS NULL"), ("coordinate_unavailable", "abs(lon_raw) >= 108600000 OR abs(lat_raw) >= 54600000"), ("position_after_receipt", "pos_time_s - receive_time_s > 300"),
        ("heading_unavailable_or_invalid", "true_heading <> 511 AND true_heading NOT BETWEEN 0 AND 359"), *(("file_date_mismatch", f"{c} NOT BETWEEN {_LOW} AND {_HIGH}") for c in ("receive_time_s", "pos_time_s")),
    ],
    ["receive_time_s", "pos_time_s", "cog_raw", "sog_raw", "navigation_status", "rot", "position_accuracy"],
)
_POS = f"""(SELECT *, {_POS_MASK} AS dq_mask FROM (SELECT *, {", ".join(f"{_placed('comm_type', places)} AS {name}" for name, places in _POSITION_FIELDS.items())}
  FROM (SELECT *, {_NUMBERED}, c01 AS device_id, try_cast(c01 AS INTEGER) AS device_number FROM {_fields(a.RAW_LINES, 14)})))"""

_STATIC_MASK = _mask(
    [("unknown_comm_type", "comm_type IS NULL OR comm_type <> 1"), ("unknown_message_type", "m IS NULL OR m NOT IN ('5', '19', '21', '24A', '24B')")],
    ["mmsi", "receive_time_s", "ship_type", "position_device_type", "draught_raw", "dte"],
)
_STATIC_COLUMNS = [f"rtrim({_placed('m', {m: (k,) for m, k in places.items()})}, '@') AS {name}" for name, places in _STATIC_TEXTS.items()]
_STATIC_COLUMNS += [f"{_placed('m', {m: (k, 'SMALLINT', *(['UTINYINT', 'SMALLINT'] if name == 'aton_status' else [])) for m, k in places.items()})} AS {name}" for name, places in _STATIC_NUMBERS.items()]
_STATIC = f"""(SELECT *, {_STATIC_MASK} AS dq_mask FROM (SELECT *, {", ".join(_STATIC_COLUMNS)}, CASE WHEN m = '5' THEN c14 END AS eta_raw
  FROM (SELECT *, {_NUMBERED}, try_cast(c01 AS INTEGER) AS mmsi, c04 AS m FROM {_fields(a.STATIC_LINES, 18)})))"""

_SHARD = f"(SELECT * FROM {_STATIC} WHERE dq_mask & 255 = 0 AND mmsi IS NOT NULL AND ship_type BETWEEN 0 AND 255)"
_TYPES = ", ".join(map(str, a.TANKER_TYPES))


def _latest(c: str, cond: str = "") -> str:
    return f"first({c} ORDER BY receive_time_s DESC NULLS LAST, line_number DESC){f' FILTER (WHERE {cond})' if cond else ''}"


_REGISTRY = f"""(SELECT mmsi, bool_or(ship_type IN ({_TYPES})) AS is_tanker, min(receive_time_s) AS first_static_time_s, max(receive_time_s) AS last_static_time_s, count(*) AS static_record_count,
  count(DISTINCT ship_type)::INTEGER AS distinct_ship_type_count, count(DISTINCT ship_type) > 1 AS ship_type_conflict, list_sort(list_distinct(list(ship_type))) AS types,
  {_latest("ship_type")} AS latest_ship_type, {", ".join(f"{_latest(c, f'{c} IS NOT NULL AND length({c}) > 0')} AS latest_{c}" for c in ("ship_name", "imo", "callsign", "destination"))},
  {_latest("draught_raw / 10.0::DOUBLE", "draught_raw IS NOT NULL")} AS latest_draught_m FROM {_SHARD} GROUP BY mmsi)"""
_TEXT_TYPES = "'[' || array_to_string(types, ', ') || ']'"
_TRACKS = f"""(SELECT p.*, r.latest_ship_name AS registry_ship_name, r.latest_ship_type AS registry_ship_type, r.ship_type_conflict, {_TEXT_TYPES} AS observed FROM {a.CLEAN} p JOIN {_REGISTRY} r USING (mmsi)
  WHERE r.is_tanker AND is_hard_valid AND NOT (longitude_deg = 0 AND latitude_deg = 0))"""
_TARGETS = f"(SELECT {a.FIRST} + 10800 * i AS target_time_s, (i % 8 * 3)::SMALLINT AS target_hour, strftime(make_timestamp(({a.FIRST} + 10800 * i) * 1000000), '%Y-%m-%d') AS sample_date FROM range({8 * len(DAYS)}) r(i))"


def _nearest(tolerance: int) -> str:
    return f"""(SELECT * EXCLUDE (place) FROM (SELECT *, pos_time_s - target_time_s AS signed_offset_seconds, abs(pos_time_s - target_time_s) AS absolute_offset_seconds,
  count(*) OVER (PARTITION BY mmsi, target_time_s)::INTEGER AS candidate_count,
  row_number() OVER (PARTITION BY mmsi, target_time_s ORDER BY abs(pos_time_s - target_time_s), pos_time_s, receive_time_s, source_file, line_number) AS place
  FROM {_TRACKS} JOIN {_TARGETS} ON pos_time_s BETWEEN target_time_s - {tolerance} AND target_time_s + {tolerance}) WHERE place = 1)"""


_SAMPLE_OUT = ["sample_date", "target_hour", "target_time_s", "mmsi", "line_number", "pos_time_s", "longitude_deg", "latitude_deg", "registry_ship_name", "signed_offset_seconds", "absolute_offset_seconds", "candidate_count"]
_CELLS = f"""(SELECT floor((longitude_deg - {EXTENT[0]}) / {CELL})::INTEGER AS ix, floor((latitude_deg - {EXTENT[2]}) / {CELL})::INTEGER AS iy, count(*) AS sample_count, count(DISTINCT mmsi) AS unique_vessels
  FROM {_nearest(1800)} WHERE longitude_deg >= {EXTENT[0]} AND longitude_deg < {EXTENT[1]} AND latitude_deg >= {EXTENT[2]} AND latitude_deg < {EXTENT[3]} GROUP BY 1, 2)"""


@query(f"SELECT line_number, {', '.join(RAW_COLUMNS[:14])}, c14 AS c14 FROM {_fields(a.RAW_LINES, 15)}")
def dat_split_scan(spark, sf_dir):
    return split_fields(a.raw_lines(spark, sf_dir)).select("line_number", *RAW_COLUMNS[:15])


@query("SELECT event_id % 3 AS file_number, event_id::VARCHAR AS event, row_number() OVER (PARTITION BY event_id % 3 ORDER BY event_id) AS line_number FROM events WHERE event_id % 10 <> 7")
def dat_line_ordinal(spark, sf_dir):
    """Lines of three files that were written in order, some of them blank, numbered as they are read."""
    e = a.table(spark, sf_dir, "events").select((F.col("event_id") % 3).alias("part"), "event_id")
    line = F.when(F.col("event_id") % 10 == 7, " ").otherwise(F.concat_ws("~", F.col("part").cast("string"), F.col("event_id").cast("string")))
    folder = a.scratch(spark)
    e.repartition("part").sortWithinPartitions("part", "event_id").select("part", line.alias("value")).write.partitionBy("part").text(f"{folder}/lines")
    rows = read_dat(spark, f"{folder}/lines/*")
    return rows.select(F.col("c00").cast("long").alias("file_number"), F.col("c01").alias("event"), "line_number")


@query("SELECT event_id, user_id, CASE WHEN event_id % 2 = 0 THEN event_type END AS event_type FROM events")
def parquet_union_by_name(spark, sf_dir):
    """Files whose columns come in another order, or are not there, united by name through nested folders."""
    e, folder = a.table(spark, sf_dir, "events"), a.scratch(spark)
    e.where("event_id % 2 = 0").select("event_type", "event_id", "user_id").write.parquet(f"{folder}/even/deep/er")
    e.where("event_id % 2 = 1").select("user_id", "event_id").write.parquet(f"{folder}/odd/day=3")
    return read_union(spark, f"{folder}/even", f"{folder}/odd").select("event_id", "user_id", "event_type")


_POS_OUT = ["line_number", "comm_type", "device_id", "mmsi", "receive_time_s", "source_id", "ais_message_id", "pos_time_s", "lon_raw", "lat_raw", "longitude_deg", "latitude_deg", "cog_raw", "cog_deg", "sog_raw", "sog_kn", "true_heading", "navigation_status", "rot", "position_accuracy", "dq_mask", "is_hard_valid"]


@query(f"""SELECT line_number, comm_type, device_id, CASE WHEN comm_type = 1 AND device_number BETWEEN 1 AND 999999999 THEN device_number END AS mmsi, receive_time_s, source_id, ais_message_id, pos_time_s, lon_raw, lat_raw,
  CASE WHEN abs(lon_raw) < 108600000 AND abs(lat_raw) < 54600000 THEN lon_raw / 600000.0::DOUBLE END AS longitude_deg, CASE WHEN abs(lon_raw) < 108600000 AND abs(lat_raw) < 54600000 THEN lat_raw / 600000.0::DOUBLE END AS latitude_deg,
  cog_raw, CASE WHEN cog_raw BETWEEN 0 AND 3599 THEN cog_raw / 10.0::DOUBLE END AS cog_deg, sog_raw, CASE WHEN sog_raw BETWEEN 0 AND 1022 THEN sog_raw / 10.0::DOUBLE END AS sog_kn,
  true_heading, navigation_status, rot, position_accuracy, dq_mask::BIGINT AS dq_mask, dq_mask & 255 = 0 AS is_hard_valid FROM {_POS}""")
def decode_position(spark, sf_dir):
    return positions(spark, sf_dir).select(_POS_OUT)


_STA_OUT = ["line_number", "comm_type", "mmsi", "receive_time_s", "imo", "callsign", "ship_name", "ship_type", "length_bow", "length_stern", "breadth_port", "breadth_starboard", "position_device_type", "eta_raw", "draught_raw", "draught_m", "destination", "dte", "aton_type", "aton_name", "aton_status", "vendor_id", "dq_mask", "is_hard_valid"]


@query(f"SELECT {', '.join({'draught_m': 'draught_raw / 10.0::DOUBLE AS draught_m', 'dq_mask': 'dq_mask::BIGINT AS dq_mask', 'is_hard_valid': 'dq_mask & 255 = 0 AS is_hard_valid'}.get(c, c) for c in _STA_OUT)}, m AS ais_message_id FROM {_STATIC}")
def decode_static(spark, sf_dir):
    return static(spark, sf_dir).select(*_STA_OUT, "ais_message_id")


@query(f"SELECT flag, records FROM ({' UNION ALL '.join(f'''SELECT '{name}' AS flag, count(*) FILTER (WHERE dq_mask & {bit} <> 0) AS records FROM p''' for name, bit in FLAG.items())}) WHERE records > 0".join([f"WITH p AS (SELECT dq_mask FROM {_POS}) ", ""]))
def dq_flag_histogram(spark, sf_dir):
    return quality.flag_histogram(positions(spark, sf_dir))


@query(f"SELECT count(*) AS records, (count(*) FILTER (WHERE dq_mask & 255 = 0))::BIGINT AS hard_valid_records, (count(*) FILTER (WHERE dq_mask & 255 <> 0))::BIGINT AS hard_invalid_records FROM {_POS}")
def decode_summary(spark, sf_dir):
    return quality.decode_summary(positions(spark, sf_dir))


@query(f"SELECT {', '.join({'draught_m': 'draught_raw / 10.0::DOUBLE AS draught_m', 'source_file': '''\'STA_OK.dat\' AS source_file''', 'dq_mask': 'dq_mask::BIGINT AS dq_mask'}.get(c, c) for c in SHARD_COLUMNS)} FROM {_SHARD}")
def static_shard_filter(spark, sf_dir):
    return vessels.static_shard(static(spark, sf_dir))


def _flat(df: DataFrame) -> DataFrame:
    return df.withColumn("observed_ship_types", F.concat(F.lit("["), F.array_join(F.col("observed_ship_types").cast("array<string>"), ", "), F.lit("]")))


@query(f"SELECT * EXCLUDE (types), {_TEXT_TYPES} AS observed_ship_types FROM {_REGISTRY}")
def vessel_registry(spark, sf_dir):
    return _flat(registry(spark, sf_dir))


@query(f"SELECT * EXCLUDE (types), {_TEXT_TYPES} AS observed_ship_types FROM {_REGISTRY} WHERE is_tanker")
def tanker_registry(spark, sf_dir):
    return _flat(vessels.tanker_registry(registry(spark, sf_dir)))


@query(f"SELECT count(*) AS vessels, count(*) FILTER (WHERE is_tanker) AS tankers, count(*) FILTER (WHERE ship_type_conflict) AS ship_type_conflicts FROM {_REGISTRY}")
def registry_counts(spark, sf_dir):
    return vessels.registry_counts(registry(spark, sf_dir))


@query(f"SELECT mmsi, line_number, pos_time_s, longitude_deg, latitude_deg, registry_ship_name, registry_ship_type, observed, ship_type_conflict FROM {_TRACKS}")
def positions_join_registry(spark, sf_dir):
    return _flat(tracks(spark, sf_dir)).select("mmsi", "line_number", "pos_time_s", "longitude_deg", "latitude_deg", "registry_ship_name", "registry_ship_type", F.col("observed_ship_types").alias("observed"), "ship_type_conflict")


@query(f"SELECT count(*) AS records, count(DISTINCT mmsi) AS distinct_mmsi, min(pos_time_s) AS first_time_s, max(pos_time_s) AS last_time_s FROM {_TRACKS}")
def positions_stage_counts(spark, sf_dir):
    return vessels.position_counts(tracks(spark, sf_dir))


@query(f"SELECT mmsi, line_number, target_time_s, pos_time_s - target_time_s AS signed_offset_seconds FROM {_TRACKS} JOIN {_TARGETS} ON pos_time_s BETWEEN target_time_s - 1800 AND target_time_s + 1800")
def sample_range_join(spark, sf_dir):
    found = sampling.candidates(tracks(spark, sf_dir), sampling.sampling_targets(spark, "UTC", HOURS, DAYS), 1800)
    return found.select("mmsi", "line_number", "target_time_s", "signed_offset_seconds")


@query(f"SELECT {', '.join(_SAMPLE_OUT)} FROM {_nearest(1800)}")
def sample_nearest_3h(spark, sf_dir):
    return samples(spark, sf_dir).select(_SAMPLE_OUT)


@query(f"SELECT {', '.join(_SAMPLE_OUT)} FROM {_nearest(9000)}")
def sample_overlapping_tolerance(spark, sf_dir):
    return samples(spark, sf_dir, 9000).select(_SAMPLE_OUT)


@query(f"SELECT count(*) AS samples, count(DISTINCT mmsi) AS distinct_mmsi, count(DISTINCT target_time_s) AS targets, max(absolute_offset_seconds) AS largest_offset FROM {_nearest(1800)}")
def sample_stage_counts(spark, sf_dir):
    return sampling.sample_counts(samples(spark, sf_dir))


@query(f"SELECT sample_date, target_hour, mmsi, line_number, observed AS observed_ship_types, candidate_count FROM {_nearest(1800)} ORDER BY 1, 2, 3")
def csv_export_projection(spark, sf_dir):
    return sampling.csv_projection(samples(spark, sf_dir)).select("sample_date", "target_hour", "mmsi", "line_number", "observed_ship_types", "candidate_count")


@query(f"SELECT ix, iy, sample_count FROM {_CELLS}")
def heatmap_grid_sample_count(spark, sf_dir):
    return spatial.grid_density(samples(spark, sf_dir), EXTENT, CELL).select("ix", "iy", "sample_count")


@query(f"SELECT ix, iy, unique_vessels FROM {_CELLS}")
def heatmap_grid_unique_vessels(spark, sf_dir):
    return spatial.grid_density(samples(spark, sf_dir), EXTENT, CELL).select("ix", "iy", "unique_vessels")


@query(f"SELECT x::INTEGER AS ix, y::INTEGER AS iy, coalesce(sample_count, 0) AS value FROM range(48) a(x) CROSS JOIN range(32) b(y) LEFT JOIN {_CELLS} ON ix = x AND iy = y")
def heatmap_dense_grid(spark, sf_dir):
    return spatial.dense_grid(spatial.grid_density(samples(spark, sf_dir), EXTENT, CELL), EXTENT, CELL)


@query(f"SELECT event_id, strftime(make_timestamp((event_start_s + (event_end_s - event_start_s) // 2) * 1000000), '%Y-%m') AS month FROM {a.CARGO}")
def event_month_midpoint(spark, sf_dir):
    return a.cargo_events(spark, sf_dir).select("event_id", event_month(F.col("event_start_s"), F.col("event_end_s")).alias("month"))


@query(f"SELECT * FROM {a.CARGO} WHERE event_status = 'accepted'")
def accepted_events_gate(spark, sf_dir):
    return density.accepted_events(a.cargo_events(spark, sf_dir))


def _km(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    turn = f"(({lon2} - {lon1} + 180.0::DOUBLE) - 360.0::DOUBLE * floor(({lon2} - {lon1} + 180.0::DOUBLE) / 360.0::DOUBLE) - 180.0::DOUBLE)"
    cosine = lambda x: f"(CASE WHEN abs({x}) = 90 THEN 0.0 ELSE cos(radians({x})) END)"
    return f"(2 * 6371.0088::DOUBLE * asin(least(1.0, sqrt(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + {cosine(lat1)} * {cosine(lat2)} * pow(sin(radians({turn}) / 2), 2)))))"


@query(f"SELECT event_id, round({_km('event_longitude_deg', 'event_latitude_deg', '121.5::DOUBLE', '31.2::DOUBLE')}, 5) AS km FROM {a.CARGO} WHERE abs(event_latitude_deg) <= 90")
def haversine_distance(spark, sf_dir):
    e = a.cargo_events(spark, sf_dir).where("abs(event_latitude_deg) <= 90")
    return e.select("event_id", F.round(haversine_km(F.col("event_longitude_deg"), F.col("event_latitude_deg"), F.lit(121.5), F.lit(31.2)), 5).alias("km"))


def _cell(events: str, grid: str, low: float, high: float) -> str:
    """The nearest cell by looking at the cells within a degree of latitude of an event."""
    return f"""(SELECT event_id, arg_min(value, {{'d': km, 'a': lat, 'o': lon}}) AS value, min(km) AS km FROM (SELECT event_id, g.value, g.lat, g.lon, {_km('e.event_longitude_deg', 'e.event_latitude_deg', 'g.lon', 'g.lat')} AS km
  FROM {events} e JOIN {grid} g ON g.month = e.month AND g.lat = floor(e.event_latitude_deg) + e.dy WHERE g.value BETWEEN {low} AND {high}) WHERE km <= 75 GROUP BY event_id)"""


_PLACED = f"""(SELECT *, unnest([-1, 0, 1, 2]) AS dy FROM (SELECT event_id, event_longitude_deg, event_latitude_deg, strftime(make_timestamp((event_start_s + (event_end_s - event_start_s) // 2) * 1000000), '%Y-%m') AS month
  FROM {a.CARGO} WHERE event_status = 'accepted' AND event_longitude_deg BETWEEN -180 AND 180 AND event_latitude_deg BETWEEN -90 AND 90))"""
_WATER = _cell(_PLACED, a.grid_sql(*a.SST), -5.0, 47.0)
_SALTY = _cell(f"(SELECT * EXCLUDE (month), right(month, 2) AS month FROM {_PLACED})", a.grid_sql(*a.SALT), 0.0, 50.0)


@query(f"SELECT e.event_id, value, round(km, 5) AS km FROM (SELECT DISTINCT event_id FROM {_PLACED}) e LEFT JOIN {_WATER} w USING (event_id)")
def nearest_valid_cell(spark, sf_dir):
    e = density.accepted(a.cargo_events(spark, sf_dir)).where("event_longitude_deg between -180 and 180 and event_latitude_deg between -90 and 90")
    e = e.select("event_id", F.col("event_longitude_deg").alias("longitude_deg"), F.col("event_latitude_deg").alias("latitude_deg"), event_month(F.col("event_start_s"), F.col("event_end_s")).alias("month"))
    found = spatial.nearest_valid_cell(e, a.grid(spark, *a.SST), density.RADIUS_KM, *density.SST, on=["month"])
    return found.select("event_id", "value", F.round("distance_km", 5).alias("km"))


def _kernel(salinity, temperature, lon, lat):
    """A stand-in for densities in queries, by arithmetic that SQL has too."""
    return F.lit(985.0) + salinity - temperature / F.lit(4.0)


_RHO = "985.0::DOUBLE + s.value - w.value / 4.0::DOUBLE"
_DENSITY = f"""(SELECT event_id, CASE WHEN {_RHO} BETWEEN 990 AND 1050 THEN {_RHO} ELSE 1025.0::DOUBLE END AS seawater_density_kg_m3, CASE WHEN {_RHO} BETWEEN 990 AND 1050 THEN 'linear' ELSE 'fixed_1025' END AS density_method
  FROM (SELECT event_id FROM {a.CARGO} WHERE event_status = 'accepted') e LEFT JOIN {_WATER} w USING (event_id) LEFT JOIN {_SALTY} s USING (event_id))"""


def densities(spark, sf_dir) -> DataFrame:
    return density.event_density(density.accepted(a.cargo_events(spark, sf_dir)), a.grid(spark, *a.SALT), a.grid(spark, *a.SST), _kernel, "linear")


@query(f"SELECT * FROM {_DENSITY}")
def density_fallback(spark, sf_dir):
    return densities(spark, sf_dir)


@query(f"""SELECT count(*) AS n_rows, count(*) - count(DISTINCT event_id) AS duplicate_ids, count(*) FILTER (WHERE event_id IS NULL OR event_id = '') AS empty_ids, count(*) FILTER (WHERE NOT isfinite(seawater_density_kg_m3)) AS not_finite,
  count(*) FILTER (WHERE seawater_density_kg_m3 NOT BETWEEN 990 AND 1050) AS out_of_range, count(*) FILTER (WHERE density_method NOT IN ('teos10', 'fixed_1025')) AS unknown_methods,
  count(*) FILTER (WHERE density_method = 'fixed_1025' AND seawater_density_kg_m3 <> 1025) AS wrong_fallbacks, count(*) FILTER (WHERE density_method = 'teos10') AS teos10, count(*) FILTER (WHERE density_method = 'fixed_1025') AS fixed_1025,
  min(seawater_density_kg_m3) AS least, median(seawater_density_kg_m3) AS median, max(seawater_density_kg_m3) AS most, (count(*) FILTER (WHERE density_method = 'fixed_1025'))::DOUBLE / count(*) AS fallback_share FROM {_DENSITY}""")
def density_output_qa(spark, sf_dir):
    return quality.density_summary(densities(spark, sf_dir))


@query(f"""SELECT v.*, l.seawater_density_kg_m3 AS load_density_kg_m3, l.density_method AS load_density_method, u.seawater_density_kg_m3 AS unload_density_kg_m3, u.density_method AS unload_density_method
  FROM (SELECT event_id::VARCHAR AS load_event_id, (event_id + 1)::VARCHAR AS unload_event_id FROM events WHERE event_id % 2 = 0) v JOIN {_DENSITY} l ON l.event_id = load_event_id JOIN {_DENSITY} u ON u.event_id = unload_event_id""")
def voyage_density_double_join(spark, sf_dir):
    voyages = a.table(spark, sf_dir, "events").where("event_id % 2 = 0").select(F.col("event_id").cast("string").alias("load_event_id"), (F.col("event_id") + 1).cast("string").alias("unload_event_id"))
    return density.voyage_densities(voyages, densities(spark, sf_dir))
