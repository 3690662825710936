"""Delimited message files: one record a line, fields parted by ~, no header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import fenced
from ..schemas import RAW_COLUMNS

LEAST_SPLIT = 4 << 20  # bytes: a scan cuts no smaller pieces from a file, but its last one
SPLITS = 200_000  # splits up to which what is known of them (a name and two numbers each) is broadcast


def file_kind(name: str) -> str:
    """position or static, by the file's name."""
    base = name.replace("\\", "/").rsplit("/", 1)[-1].upper()
    for prefix, kind in (("POS_OK", "position"), ("STA_OK", "static")):
        if base.startswith(prefix):
            return kind
    raise ValueError(f"neither a POS_OK nor a STA_OK file: {name}")


def split_fields(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """Forty text columns of each line: short lines padded with nulls, further fields cut off, empty fields null."""
    rest = [c for c in lines.columns if c != line_col]
    own = [f"`{c}`" for c in rest]
    parts = lines.selectExpr(*own, f"transform(split(`{line_col}`, '~', -1), x -> nullif(x, '')) AS _fields")
    return fenced(parts).selectExpr(*own, *(f"get(_fields, {i}) AS {c}" for i, c in enumerate(RAW_COLUMNS)))


def read_dat(spark: SparkSession, path: str, record_date: str | None = None) -> DataFrame:
    """c00..c39 of one or more files with record_date, source_file and line_number.

    line_number counts a file's lines from 1, blank ones left out; files of one name in different folders are
    different files. Lines are read in parallel: a first pass
    gives each split's first place and its count in one aggregate, and its lines go on from the sum of those
    before it in the same file, so nothing is sorted or gathered. What is known of the splits is a row for
    each; it is broadcast where files and sizes bound their number, so the lines themselves are not shuffled.
    """
    text = spark.read.text(path)
    lines = text.select(F.regexp_replace("value", "\\r$", "").alias("value"), F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    placed = lines.where(F.trim("value") != "").withColumn("place", F.monotonically_increasing_id())
    splits = placed.groupBy("path", "block").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    shifts = splits.select("path", "block", (F.coalesce(before, F.lit(0)) + 1 - F.col("first")).alias("shift"))
    size = int(text._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    few = len(text.inputFiles()) + size // LEAST_SPLIT <= SPLITS
    numbered = placed.join(F.broadcast(shifts) if few else shifts, ["path", "block"])
    day = F.lit(record_date) if record_date else F.nullif(F.regexp_extract("source_file", r"(20\d{2}-\d{2}-\d{2})", 1), F.lit(""))
    return split_fields(numbered.select("value", day.cast("string").alias("record_date"), "source_file", (F.col("place") + F.col("shift")).alias("line_number")))
