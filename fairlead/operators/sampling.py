"""The position of each vessel nearest to given instants."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import target_instants

TARGETS = "sample_date string, target_hour smallint, target_time_s long, target_time_local string"


def sampling_targets(spark: SparkSession, zone: str, hours: list[int], days: list[date]) -> DataFrame:
    return spark.createDataFrame(target_instants(zone, hours, days), TARGETS)


def candidates(positions: DataFrame, targets: DataFrame, tolerance: int) -> DataFrame:
    """Positions with each target within `tolerance` seconds, inclusive.

    A band join by bins: a target lies in the bin of its time, a position looks in the two or three bins
    that its band touches. So the join is an equi-join whatever the number of targets, and each pair is
    met once.
    """
    width = max(1, 2 * tolerance)
    bin_of = lambda t: F.floor(t / width).cast("long")
    t = targets.withColumn("_bin", bin_of(F.col("target_time_s")))
    time = F.col("pos_time_s")
    p = positions.where(time.isNotNull()).withColumn("_bin", F.explode(F.sequence(bin_of(time - tolerance), bin_of(time + tolerance))))
    joined = p.join(t, "_bin").where(time.between(F.col("target_time_s") - tolerance, F.col("target_time_s") + tolerance))
    return joined.drop("_bin").withColumns({"signed_offset_seconds": time - F.col("target_time_s"), "absolute_offset_seconds": F.abs(time - F.col("target_time_s"))})


def sample_nearest(positions: DataFrame, targets: DataFrame, tolerance: int) -> DataFrame:
    """Of each vessel and target the nearest candidate; ties go to the earlier position, then to the earlier
    receipt (null last), file and line. candidate_count counts all.

    One aggregation with partial sums: a vessel with very many candidates is one row for each task before
    the shuffle, and nothing is sorted.
    """
    found = candidates(positions, targets, tolerance)
    rest = [c for c in positions.columns if c != "mmsi"]
    last = lambda c: F.struct(F.col(c).isNull().alias("n"), F.col(c).alias("v"))
    key = F.struct("absolute_offset_seconds", "pos_time_s", last("receive_time_s"), last("source_file"), last("line_number"))
    own = F.struct(*rest, "sample_date", "target_hour", "target_time_local", "signed_offset_seconds", "absolute_offset_seconds")
    best = found.groupBy("mmsi", "target_time_s").agg(F.min_by(own, key).alias("x"), F.count("*").cast("int").alias("candidate_count"))
    columns = [c if c == "mmsi" else f"x.{c}" for c in positions.columns]
    return best.select("x.sample_date", "x.target_hour", "target_time_s", "x.target_time_local", *columns, "x.signed_offset_seconds", "x.absolute_offset_seconds", "candidate_count")


def sample_counts(samples: DataFrame) -> DataFrame:
    return samples.agg(F.count("*").alias("samples"), F.count_distinct("mmsi").alias("distinct_mmsi"), F.count_distinct("target_time_s").alias("targets"), F.max("absolute_offset_seconds").alias("largest_offset"))


def csv_projection(samples: DataFrame) -> DataFrame:
    """Samples as CSV can hold them, arrays as [a, b], in order of date, hour and vessel."""
    kinds = dict(samples.dtypes)
    flat = [F.when(F.col(c).isNotNull(), F.concat(F.lit("["), F.array_join(F.col(c).cast("array<string>"), ", "), F.lit("]"))).alias(c) if kinds[c].startswith("array") else F.col(c) for c in samples.columns]
    return samples.select(*flat).orderBy("sample_date", "target_hour", "mmsi")

