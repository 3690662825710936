"""Aggregates over a geographic grid, and the nearest valid grid cell."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import haversine_km
from ..schemas import EARTH_KM


def grid_density(samples: DataFrame, extent, size: float) -> DataFrame:
    """(ix, iy, sample_count, unique_vessels) of the cells that hold samples; the extent is half open."""
    x0, x1, y0, y1 = map(float, extent)
    lon, lat = F.col("longitude_deg"), F.col("latitude_deg")
    inside = samples.where((lon >= x0) & (lon < x1) & (lat >= y0) & (lat < y1))
    cell = lambda c, low: F.floor((c - F.lit(low)) / F.lit(float(size))).cast("int")
    return inside.groupBy(cell(lon, x0).alias("ix"), cell(lat, y0).alias("iy")).agg(F.count("*").alias("sample_count"), F.count_distinct("mmsi").alias("unique_vessels"))


def grid_shape(extent, size: float) -> tuple[int, int]:
    x0, x1, y0, y1 = map(float, extent)
    return math.ceil((x1 - x0) / size), math.ceil((y1 - y0) / size)


def dense_grid(cells: DataFrame, extent, size: float, metric: str = "sample_count") -> DataFrame:
    """(ix, iy, value) of every cell of the extent, 0 where nothing is known."""
    if metric not in ("sample_count", "unique_vessels"):
        raise ValueError(f"unknown metric {metric}")
    nx, ny = grid_shape(extent, size)
    every = cells.sparkSession.range(nx * ny).select((F.col("id") % nx).cast("int").alias("ix"), F.floor(F.col("id") / nx).cast("int").alias("iy"))
    return every.join(cells.select("ix", "iy", F.col(metric).alias("value")), ["ix", "iy"], "left").select("ix", "iy", F.coalesce("value", F.lit(0)).cast("long").alias("value"))


def render_png(dense: DataFrame, extent, path: str, colormap: str = "inferno", dpi: int = 140, size_inches=(8, 6)) -> None:
    """A heat map of log1p(value); needs matplotlib, and a grid that fits the driver (it is an image)."""
    try:
        import matplotlib

        matplotlib.use("Agg")
        import matplotlib.pyplot as plt
    except ImportError as error:
        raise RuntimeError("rendering needs matplotlib; the grid itself is in the Parquet output") from error
    import numpy as np

    rows = dense.toPandas()
    matrix = np.zeros((rows["iy"].max() + 1, rows["ix"].max() + 1))
    matrix[rows["iy"], rows["ix"]] = np.log1p(rows["value"])
    figure, axes = plt.subplots(figsize=size_inches)
    figure.colorbar(axes.imshow(matrix, origin="lower", extent=extent, cmap=colormap))
    figure.savefig(path, dpi=dpi)
    plt.close(figure)


def nearest_valid_cell(events: DataFrame, grid: DataFrame, radius_km: float, low: float, high: float, event_keys: list[str] | None = None, on: list[str] | None = None) -> DataFrame:
    """Each event with `value` and `distance_km` of the nearest grid cell within the radius (inclusive) whose value
    is finite and in [low, high]; null where there is none. Ties go to the smaller latitude, then longitude.

    events: the key columns, longitude_deg, latitude_deg and the columns of `on` (the month, say), which the grid has
    too. Cells and events meet by one-degree bins: an event looks in the bins that its circle touches (all
    longitudes where it holds a pole), so the join is an equi-join, and the exact distance decides. An event
    whose radius or place is not usable has no cell.
    """
    if not (math.isfinite(low) and math.isfinite(high) and low < high):
        raise ValueError("low must be below high, both finite")
    keys, on = event_keys or ["event_id"], on or []
    none = events.select(*keys, F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("distance_km"))
    if not (math.isfinite(radius_km) and radius_km >= 0):
        return none
    reach = min(math.pi, radius_km / EARTH_KM)
    margin = math.degrees(reach) + 1e-9
    v = F.col("value")
    cells = grid.where(v.isNotNull() & ~F.isnan(v) & (v >= low) & (v <= high)).select(*on, F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), v)
    cells = cells.withColumns({"_bx": F.floor(F.pmod("_lon", F.lit(360.0))).cast("int"), "_by": F.floor("_lat").cast("int")})
    lon, lat = F.col("longitude_deg"), F.col("latitude_deg")
    usable = lon.isNotNull() & lat.isNotNull() & ~F.isnan(lon) & ~F.isnan(lat) & (F.abs(lon) <= 360) & (F.abs(lat) <= 90)
    phi = F.radians(F.abs(lat))
    pole = phi + reach >= math.pi / 2 - 1e-12
    side = F.when(pole, 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.lit(math.sin(reach)) / F.cos(phi)))) + 1e-9)
    ys = F.sequence(F.floor(lat - margin).cast("int"), F.floor(lat + margin).cast("int"))
    xs = F.array_distinct(F.transform(F.sequence(F.floor(lon - side).cast("int"), F.floor(lon + side).cast("int")), lambda x: F.pmod(x, F.lit(360)).cast("int")))
    looks = events.where(usable).select(*keys, *on, "longitude_deg", "latitude_deg", F.explode(ys).alias("_by"), xs.alias("_xs")).select("*", F.explode("_xs").alias("_bx")).drop("_xs")
    met = looks.join(cells, [*on, "_bx", "_by"]).withColumn("distance_km", haversine_km(F.col("longitude_deg"), F.col("latitude_deg"), F.col("_lon"), F.col("_lat"))).where(F.col("distance_km") <= radius_km)
    best = met.groupBy(*keys).agg(F.min_by(F.struct("value", "distance_km"), F.struct("distance_km", "_lat", "_lon")).alias("x")).select(*keys, "x.value", "x.distance_km")
    return events.select(*keys).join(best, keys, "left")
