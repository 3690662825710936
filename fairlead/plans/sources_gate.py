"""Checks of the environment grids before any event is matched: of long-form grids by their rows, and of NetCDF
files by what they say of themselves (`described`), before anything is read from them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import event_month, woa_month


class GridError(ValueError):
    """A grid is not what its configuration says."""


def _axes(grid: DataFrame) -> list:
    lat, lon = F.col("lat"), F.col("lon")
    return grid.groupBy("month").agg(
        F.count("*").alias("cells"), F.count_distinct("lat", "lon").alias("places"), F.min(lat).alias("south"), F.max(lat).alias("north"), F.min(lon).alias("west"), F.max(lon).alias("east"),
        F.count_if(lat.isNull() | lon.isNull() | F.isnan(lat) | F.isnan(lon)).alias("nowhere"),
    ).collect()  # one row for each month


def check_grids(salinity: DataFrame, sst: DataFrame, events: DataFrame, coverage: bool = True) -> None:
    """Salinity has the months 01 to 12, temperature every month of the events; no cell twice; axes in range,
    east-west in one convention and, if `coverage`, around the globe."""
    for name, grid in (("salinity", salinity), ("sst", sst)):
        for r in _axes(grid):
            where = f"{name} {r['month']}"
            if r["nowhere"] or r["cells"] != r["places"]:
                raise GridError(f"{where}: cells without a place or twice")
            if not (-90 <= r["south"] and r["north"] <= 90 and -180 <= r["west"] and r["east"] < 360 and not (r["west"] < 0 and r["east"] >= 180)):
                raise GridError(f"{where}: axes out of range")
            if coverage and (r["south"] > -89 or r["north"] < 89 or r["east"] - r["west"] < 359):
                raise GridError(f"{where}: not global")
    if {r["month"] for r in salinity.select("month").distinct().collect()} != {f"{m:02d}" for m in range(1, 13)}:
        raise GridError("salinity must have the months 01 to 12")
    months = events.select(event_month(F.col("event_start_s"), F.col("event_end_s")).alias("month")).distinct()
    missing = [r["month"] for r in months.join(sst.select("month").distinct(), "month", "left_anti").collect()]
    if missing:
        raise GridError(f"no temperatures of {sorted(missing)}")


# fixed values: the study's months, and what the files' variables must be
STUDY = [f"{y}-{m:02d}" for y, first, last in ((2025, 7, 12), (2026, 1, 6)) for m in range(first, last + 1)]
TEMPERATURE = {"variable": "sst", "dims": ["valid_time", "latitude", "longitude"], "attributes": {"units": "K"}, "axes": ["latitude", "longitude"]}
SALINITY = {"variable": "s_an", "dims": ["time", "depth", "lat", "lon"], "attributes": {"units": "1", "standard_name": "sea_water_practical_salinity"}, "axes": ["lat", "lon"]}
SURFACE_M, SURFACE_BOUNDS_M = 1.25, [0.0, 2.5]


def described(path: str) -> dict:
    """What a NetCDF file says of itself: for each variable its dims, attributes and, of at most one dimension
    (axes, times) or the bounds of one, values. Read with xarray where it is installed."""
    try:
        import xarray as xr
    except ImportError as error:
        raise RuntimeError("reading NetCDF needs xarray and h5netcdf; convert the grid to Parquet instead") from error
    with xr.open_dataset(path, engine="h5netcdf", decode_times=False) as plain, xr.open_dataset(path, engine="h5netcdf") as dated:
        small = lambda v: v.values.tolist() if v.ndim <= 1 or v.size <= 4096 and v.shape[-1] == 2 else None
        out = {str(k): {"dims": [str(d) for d in v.dims], "attributes": dict(v.attrs), "values": small(v)} for k, v in plain.variables.items()}
        if "valid_time" in dated.variables:
            out["valid_time"]["months"] = [str(x)[:7] for x in dated["valid_time"].values.astype("datetime64[M]")]
        return out


def _axis_faults(name: str, values, north_south: bool, conventions: list[tuple[float, float]]) -> list[str]:
    if not isinstance(values, list) or not values or not all(isinstance(x, (int, float)) and math.isfinite(x) for x in values):
        return [f"{name} must be one axis of finite numbers"]
    steps, faults = [b - a for a, b in zip(values, values[1:])], []
    if not (all(x > 0 for x in steps) or all(x < 0 for x in steps)):
        faults.append(f"{name} must rise or fall throughout")
    if not any(low <= min(values) and (max(values) <= high if north_south else max(values) < high) for low, high in conventions):
        faults.append(f"{name} is out of range")
    if (min(values) > -89 or max(values) < 89) if north_south else max(values) - min(values) < 359:
        faults.append(f"{name} does not go around the globe")
    return faults


def _variable_faults(file: dict, kind: dict, others: list[str], conventions: list[tuple[float, float]]) -> list[str]:
    missing = [v for v in (kind["variable"], *kind["axes"], *others) if v not in file]
    if missing:
        return [f"no variable {v}" for v in missing]
    own, (lat, lon) = file[kind["variable"]], kind["axes"]
    faults = [f"{kind['variable']}: {k} must be {v}" for k, v in kind["attributes"].items() if own["attributes"].get(k) != v]
    if own["dims"] != kind["dims"]:
        faults.append(f"{kind['variable']}: dimensions must be {', '.join(kind['dims'])}")
    return faults + _axis_faults(lat, file[lat]["values"], True, [(-90.0, 90.0)]) + _axis_faults(lon, file[lon]["values"], False, conventions)


def check_temperature_files(files: dict[str, dict], months: list[str] = STUDY) -> dict[str, tuple[str, int]]:
    """Where each month lies, as (file, place in it). The files hold exactly these months, each once."""
    found: dict[str, tuple[str, int]] = {}
    for path, file in files.items():
        faults = _variable_faults(file, TEMPERATURE, ["valid_time"], [(0.0, 360.0)])
        for place, month in enumerate(file.get("valid_time", {}).get("months", [])):
            if month in found:
                faults.append(f"month {month} again")
            found[month] = (path, place)
        if faults:
            raise GridError(f"{path}: {'; '.join(faults)}")
    if found.keys() != set(months):
        raise GridError(f"months must be {months[0]} to {months[-1]}; missing {sorted(set(months) - found.keys())}, too many {sorted(found.keys() - set(months))}")
    return found


def check_salinity_files(files: dict[str, dict]) -> None:
    """Each natural month's file, by "01" to "12", has that month and the surface layer alone at one time."""
    for month, file in files.items():
        faults = _variable_faults(file, SALINITY, ["time", "depth"], [(-180.0, 180.0), (0.0, 360.0)])
        if not faults:
            time, depth = file["time"], file["depth"]
            if len(time["values"]) != 1 or not isinstance(time["values"][0], (int, float)) or not math.isfinite(time["values"][0]):
                faults.append("there must be one time, a finite number")
            else:
                try:
                    own = woa_month(str(time["attributes"].get("units")).lower(), time["values"][0])
                    faults += [] if f"{own:02d}" == month else [f"its month is {own:02d}"]
                except ValueError as error:
                    faults.append(str(error))
            bounds = file.get(depth["attributes"].get("bounds"), {}).get("values") or [[]]
            if not depth["values"] or not math.isclose(depth["values"][0], SURFACE_M, rel_tol=1e-5) or len(bounds[0]) != 2 or any(abs(x - y) > 1e-5 for x, y in zip(bounds[0], SURFACE_BOUNDS_M)):
                faults.append(f"the first layer must be that at {SURFACE_M} m, of {SURFACE_BOUNDS_M[0]} to {SURFACE_BOUNDS_M[1]} m")
        if faults:
            raise GridError(f"month {month}: {'; '.join(faults)}")
