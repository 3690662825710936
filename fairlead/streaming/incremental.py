"""Message files as they arrive: decoding is a projection, so it runs on a stream as on a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.decode import decode_positions, decode_static
from ..sources.dat import split_fields


def decoded_stream(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """Decoded records of new files in a folder. Lines of a stream have no number: line_number is null, and
    ties that only it would break are left to the batch stages."""
    lines = spark.readStream.schema("value string").text(folder).select("value", F.col("_metadata.file_name").alias("source_file")).where(F.trim("value") != "")
    day = F.nullif(F.regexp_extract("source_file", r"(20\d{2}-\d{2}-\d{2})", 1), F.lit(""))
    raw = split_fields(lines.withColumns({"record_date": day, "line_number": F.lit(None).cast("long"), "value": F.regexp_replace("value", "\\r$", "")}))
    return (decode_positions if kind == "position" else decode_static)(raw)


def append(decoded: DataFrame, target: str, checkpoint: str):
    """Write what is there now and stop; the checkpoint remembers the files, so a rerun adds new ones alone."""
    return decoded.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
