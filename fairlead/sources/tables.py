"""Parquet, grid and event sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import EVENT_COLUMNS


def read_union(spark: SparkSession, *paths: str) -> DataFrame:
    """Parquet files united by column name. Directories named key=value add no columns: what partition
    discovery infers is left out unless a file has it."""
    frames = [spark.read.option("recursiveFileLookup", True).option("mergeSchema", True).parquet(p) for p in paths]
    out = frames[0]
    for other in frames[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def read_events(spark: SparkSession, *paths: str) -> DataFrame:
    """Events, each file's columns checked for their exact types before the union; further columns are allowed."""
    frames = []
    for path in sorted(paths, key=str.lower):
        df = spark.read.option("recursiveFileLookup", True).parquet(path)
        kinds = dict(df.dtypes)
        wrong = [f"{c} must be {k}, not {kinds.get(c, 'missing')}" for c, k in EVENT_COLUMNS.items() if kinds.get(c) != k]
        if wrong:
            raise ValueError(f"{path}: {'; '.join(wrong)}")
        frames.append(df)
    if not frames:
        raise FileNotFoundError("no event files")
    out = frames[0]
    for other in frames[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """A long-form grid: month (text yyyy-MM, or number of a natural month), lat, lon, value (null: land)."""
    return spark.read.parquet(path).select("month", F.col("lat").cast("double"), F.col("lon").cast("double"), F.col("value").cast("double"))


def netcdf_grid(spark: SparkSession, path: str, variable: str) -> DataFrame:
    """Long-form grid of a monthly NetCDF file, read with xarray where it is installed: `sst` in degrees
    Celsius by calendar month, `s_an` of the surface layer by natural month. Each file is one task."""
    try:
        import xarray  # noqa: F401
    except ImportError as error:
        raise RuntimeError("reading NetCDF needs xarray and h5netcdf; convert the grid to Parquet instead") from error

    def run(batches):
        import tempfile

        import numpy as np
        import pandas as pd
        import xarray as xr

        from ..functions.scalar import woa_month

        for files in batches:
            for content in files["content"]:
                with tempfile.NamedTemporaryFile(suffix=".nc") as f:
                    f.write(content)
                    f.flush()
                    with xr.open_dataset(f.name, engine="h5netcdf", decode_times=variable == "sst") as data:
                        if variable == "sst":
                            layers = [(str(np.datetime64(t, "M")), data["sst"].isel(valid_time=i).values.astype("f8") - 273.15) for i, t in enumerate(data["valid_time"].values)]
                            lat, lon = data["latitude"].values, data["longitude"].values
                        else:
                            month = woa_month(data["time"].attrs["units"], float(data["time"].values[0]))
                            layers = [(f"{month:02d}", data["s_an"].isel(time=0, depth=0).values.astype("f8"))]
                            lat, lon = data["lat"].values, data["lon"].values
                        for month, values in layers:
                            yield pd.DataFrame({"month": month, "lat": np.repeat(lat, len(lon)), "lon": np.tile(lon, len(lat)), "value": values.ravel()})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "month string, lat double, lon double, value double")
