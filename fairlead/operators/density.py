"""Accepted cargo events with the density of the sea water around them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import event_month
from .spatial import nearest_valid_cell

RADIUS_KM, FALLBACK, PRESSURE = 75.0, 1025.0, 0.0
SALINITY, SST, DENSITY = (0.0, 50.0), (-5.0, 47.0), (990.0, 1050.0)


def accepted(events: DataFrame) -> DataFrame:
    """The accepted events as they are."""
    return events.where(F.col("event_status") == "accepted")


def accepted_events(events: DataFrame) -> DataFrame:
    """The accepted events, past the gate: ids must be there and unique, times there and in order; else ValueError.
    Rejected events are not looked at. The gate is one pass over the events, at once; a stage calls it before it
    plans any work on them, and `accepted` where they were checked before."""
    own = accepted(events)
    wrong = own.agg(
        F.count_if(F.col("event_id").isNull() | (F.trim("event_id") == "")).alias("empty ids"), (F.count("event_id") - F.count_distinct("event_id")).alias("repeated ids"),
        F.count_if(F.col("event_start_s").isNull() | F.col("event_end_s").isNull()).alias("missing times"), F.count_if(F.col("event_end_s") <= F.col("event_start_s")).alias("ends not after starts"),
    ).first().asDict()
    if any(wrong.values()):
        raise ValueError(", ".join(f"{n} {what}" for what, n in wrong.items() if n))
    return own


def teos10(salinity: Column, temperature: Column, lon: Column, lat: Column, pressure: float = PRESSURE) -> Column:
    """In-situ density by TEOS-10, through the `gsw` library where it is installed; its atlas of salinity
    anomalies has no short formula, so nothing else is offered under this name."""
    try:
        import gsw  # noqa: F401
    except ImportError as error:
        raise RuntimeError("TEOS-10 densities need the gsw library") from error
    @F.pandas_udf("double")
    def rho(sp: pd.Series, t: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        import gsw

        absolute = gsw.SA_from_SP(sp, pressure, x, y)
        return pd.Series(gsw.rho(absolute, gsw.CT_from_t(absolute, t, pressure), pressure))

    return rho(salinity, temperature, lon, lat)


def surface_density(salinity: Column, temperature: Column, lon: Column, lat: Column) -> Column:
    """Density of surface water by the 1980 equation of state (UNESCO), in JVM expressions. It is an
    approximation of `teos10` for use where that library is missing and is never labelled teos10."""
    s, t = salinity, temperature
    poly = lambda *a: sum((F.lit(c) * F.pow(t, F.lit(float(i))) for i, c in enumerate(a)), F.lit(0.0))
    # fixed values: coefficients of the one-atmosphere equation of state of sea water, 1980
    water = poly(999.842594, 6.793952e-2, -9.095290e-3, 1.001685e-4, -1.120083e-6, 6.536332e-9)
    a = poly(8.24493e-1, -4.0899e-3, 7.6438e-5, -8.2467e-7, 5.3875e-9)
    b = poly(-5.72466e-3, 1.0227e-4, -1.6546e-6)
    return water + a * s + b * F.pow(s, F.lit(1.5)) + F.lit(4.8314e-4) * s * s


def decide(matched: DataFrame, kernel=teos10, method: str = "teos10") -> DataFrame:
    """event_id, density and method of events with `salinity` and `sst`: the kernel's, or 1025 where a grid has
    nothing, the place is not usable or the density is not finite or outside [990, 1050]."""
    lon, lat = F.col("longitude_deg"), F.col("latitude_deg")
    usable = F.coalesce(lon.between(-180, 180) & lat.between(-90, 90), F.lit(False)) & F.col("salinity").isNotNull() & F.col("sst").isNotNull()
    rho = F.when(usable, kernel(F.col("salinity"), F.col("sst"), lon, lat))
    good = rho.isNotNull() & ~F.isnan(rho) & rho.between(*DENSITY)
    return matched.select("event_id", F.when(good, rho).otherwise(FALLBACK).alias("seawater_density_kg_m3"), F.when(good, F.lit(method)).otherwise("fixed_1025").alias("density_method"))


def event_density(events: DataFrame, salinity: DataFrame, sst: DataFrame, kernel=teos10, method: str = "teos10") -> DataFrame:
    """(event_id, seawater_density_kg_m3, density_method) of accepted events.

    salinity: grid by natural month ("01" to "12"), sst: grid in degrees Celsius by calendar month (yyyy-MM); the
    month is that of the event's middle in UTC. Each grid is matched on its own, within 75 km.
    """
    own = events.select("event_id", F.col("event_longitude_deg").alias("longitude_deg"), F.col("event_latitude_deg").alias("latitude_deg"), event_month(F.col("event_start_s"), F.col("event_end_s")).alias("month"))
    lon, lat = F.col("longitude_deg"), F.col("latitude_deg")
    placed = own.where(lon.between(-180, 180) & lat.between(-90, 90))
    water = nearest_valid_cell(placed, sst, RADIUS_KM, *SST, on=["month"]).select("event_id", F.col("value").alias("sst"))
    salt = nearest_valid_cell(placed.withColumn("month", F.substring("month", 6, 2)), salinity, RADIUS_KM, *SALINITY, on=["month"]).select("event_id", F.col("value").alias("salinity"))
    return decide(own.join(water, "event_id", "left").join(salt, "event_id", "left"), kernel, method)


def voyage_densities(voyages: DataFrame, densities: DataFrame) -> DataFrame:
    """Voyages with the densities of their loading and unloading events."""
    side = lambda s: densities.select(F.col("event_id").alias(f"{s}_event_id"), F.col("seawater_density_kg_m3").alias(f"{s}_density_kg_m3"), F.col("density_method").alias(f"{s}_density_method"))
    return voyages.join(side("load"), "load_event_id").join(side("unload"), "unload_event_id")


def cargo_tonnes(v: DataFrame) -> DataFrame:
    """Cargo by displacement: (rho_load * loaded draught - rho_unload * ballast draught) * length * breadth * block coefficient / 1000."""
    hull = F.col("length_m") * F.col("breadth_m") * F.col("block_coefficient")
    return v.withColumn("cargo_tonnes", (F.col("load_density_kg_m3") * F.col("loaded_draught_m") - F.col("unload_density_kg_m3") * F.col("ballast_draught_m")) * hull / 1000.0)
