"""Static shards, vessel and tanker registries, tanker positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import POSITION_COLUMNS, SHARD_COLUMNS

#: Bytes of a registry up to which it is broadcast; a larger one is joined by shuffle.
BROADCAST_BYTES = 64 << 20
REGISTRY_ROW_BYTES = 200  # estimate of a registry row


def static_shard(static: DataFrame) -> DataFrame:
    """The columns of valid static records that a registry needs; rows without a ship type are left out."""
    return static.where("is_hard_valid and mmsi is not null and ship_type between 0 and 255").select(SHARD_COLUMNS)


def latest(col: str, when: Column | None = None) -> Column:
    """The value of the latest record by (receive_time_s, source_file, line_number), of those where `when` holds;
    null times come first."""
    key = F.struct("receive_time_s", "source_file", "line_number")
    return F.max_by(col, key if when is None else F.when(when, key))


def vessel_registry(shards: DataFrame, tanker_types) -> DataFrame:
    """One row for each vessel: all aggregates combine before the shuffle, so a vessel with many records is one row for each task."""
    given = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    return shards.groupBy("mmsi").agg(
        F.bool_or(F.col("ship_type").isin([int(t) for t in tanker_types])).alias("is_tanker"),
        F.min("receive_time_s").alias("first_static_time_s"), F.max("receive_time_s").alias("last_static_time_s"), F.count("*").alias("static_record_count"),
        F.sort_array(F.collect_set("ship_type")).alias("observed_ship_types"), latest("ship_type").alias("latest_ship_type"),
        latest("ship_name", given("ship_name")).alias("latest_ship_name"), latest("imo", given("imo")).alias("latest_imo"), latest("callsign", given("callsign")).alias("latest_callsign"),
        latest("draught_m", F.col("draught_m").isNotNull()).alias("latest_draught_m"), latest("destination", given("destination")).alias("latest_destination"),
    ).select(
        "mmsi", "is_tanker", "first_static_time_s", "last_static_time_s", "static_record_count", F.size("observed_ship_types").alias("distinct_ship_type_count"),
        (F.size("observed_ship_types") > 1).alias("ship_type_conflict"), "observed_ship_types", "latest_ship_type", "latest_ship_name", "latest_imo", "latest_callsign", "latest_draught_m", "latest_destination",
    )


def tanker_registry(registry: DataFrame) -> DataFrame:
    return registry.where("is_tanker")


def registry_counts(registry: DataFrame) -> DataFrame:
    return registry.agg(F.count("*").alias("vessels"), F.count_if("is_tanker").alias("tankers"), F.count_if("ship_type_conflict").alias("ship_type_conflicts"))


def tanker_positions(positions: DataFrame, registry: DataFrame, exclude_zero_zero: bool = True, small: bool | None = None) -> DataFrame:
    """Valid positions of the vessels in `registry` with what it knows of them.

    `small` says whether the registry fits a broadcast (see `fits_broadcast`); without it the planner decides.
    """
    keep = "is_hard_valid and mmsi is not null and longitude_deg between -180 and 180 and latitude_deg between -90 and 90"
    p = positions.where(keep + (" and not (longitude_deg = 0 and latitude_deg = 0)" if exclude_zero_zero else ""))
    r = registry.select(
        "mmsi", F.col("latest_ship_type").alias("registry_ship_type"), F.col("latest_ship_name").alias("registry_ship_name"), F.col("latest_imo").alias("registry_imo"),
        F.col("latest_callsign").alias("registry_callsign"), "observed_ship_types", "ship_type_conflict",
    )
    joined = p.join(F.broadcast(r) if small else r, "mmsi")
    return joined.select(*POSITION_COLUMNS, *r.columns[1:])


def fits_broadcast(registry: DataFrame) -> bool:
    return registry.count() * REGISTRY_ROW_BYTES <= BROADCAST_BYTES


def position_counts(positions: DataFrame) -> DataFrame:
    return positions.agg(F.count("*").alias("records"), F.count_distinct("mmsi").alias("distinct_mmsi"), F.min("pos_time_s").alias("first_time_s"), F.max("pos_time_s").alias("last_time_s"))
