"""Summaries of quality flags and of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import DENSITY_COLUMNS, FLAG


def flag_histogram(decoded: DataFrame) -> DataFrame:
    """(flag, records) of the flags that occur: one pass, then 20 counts turned into rows."""
    counts = decoded.agg(*(F.count_if(F.col("dq_mask").bitwiseAND(F.lit(bit)) != 0).alias(name) for name, bit in FLAG.items()))
    pairs = F.array(*(F.struct(F.lit(name).alias("flag"), F.col(name).alias("records")) for name in FLAG))
    return counts.select(F.explode(pairs).alias("x")).select("x.flag", "x.records").where("records > 0")


def decode_summary(decoded: DataFrame) -> DataFrame:
    """Records, valid and invalid ones; the sums are null of no records."""
    return decoded.agg(F.count("*").alias("records"), F.sum(F.col("is_hard_valid").cast("long")).alias("hard_valid_records"), F.sum((~F.col("is_hard_valid")).cast("long")).alias("hard_invalid_records"))


def density_summary(densities: DataFrame, low: float = 990.0, high: float = 1050.0, fallback: float = 1025.0) -> DataFrame:
    """One row of counts and defects of a density result; `median` is exact."""
    d, m = F.col("seawater_density_kg_m3"), F.col("density_method")
    finite = d.isNotNull() & ~F.isnan(d) & (F.abs(d) < float("inf"))
    return densities.agg(
        F.count("*").alias("n_rows"), (F.count("*") - F.count_distinct("event_id")).alias("duplicate_ids"),
        F.count_if(F.col("event_id").isNull() | (F.col("event_id") == "")).alias("empty_ids"), F.count_if(~finite).alias("not_finite"),
        F.count_if(finite & ~d.between(low, high)).alias("out_of_range"), F.count_if(~m.isin("teos10", "fixed_1025") | m.isNull()).alias("unknown_methods"),
        F.count_if((m == "fixed_1025") & (d != fallback)).alias("wrong_fallbacks"), F.count_if(m == "teos10").alias("teos10"), F.count_if(m == "fixed_1025").alias("fixed_1025"),
        F.min(d).alias("least"), F.median(d).alias("median"), F.max(d).alias("most"),
        F.when(F.count("*") > 0, F.count_if(m == "fixed_1025") / F.count("*")).otherwise(0.0).alias("fallback_share"),
    )


def validate_density(densities: DataFrame, expected_rows: int) -> dict:
    """The summary, or ValueError where columns, types, row count or contents are not as agreed."""
    if densities.dtypes != list(DENSITY_COLUMNS.items()):
        raise ValueError(f"columns are {densities.dtypes}")
    out = density_summary(densities).first().asDict()
    bad = {k: out[k] for k in ("duplicate_ids", "empty_ids", "not_finite", "out_of_range", "unknown_methods", "wrong_fallbacks") if out[k]}
    if out["n_rows"] != expected_rows or bad:
        raise ValueError(f"{out['n_rows']} rows for {expected_rows} events; defects: {bad}")
    return out
