"""Ship-position relations made from the general test tables, by whole-number arithmetic alone.

Each relation has a Spark and an SQL form that give the same rows.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIRST = 1_704_067_200  # 2024-01-01T00:00:00Z
STATIC_SHIFT = 820_454_400  # puts order dates, of the 1990s, behind the year 2000
TANKER_TYPES = (80, 81, 82, 83, 84, 89)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder for files that a query writes in order to read them: in the one that the cluster shares, else,
    on one machine, in its own temporary folder, which goes at exit."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        base = tempfile.mkdtemp(prefix="fairlead-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base if '://' in base or base.startswith('file:') else f'file://{base}'}/scratch-{uuid.uuid4().hex}"


def timed_events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id", "user_id", "event_type", "unix_seconds(CAST(ts AS TIMESTAMP)) AS t")


TIMED = "(SELECT event_id, user_id, event_type, epoch_us(ts) // 1000000 AS t FROM events)"


def raw_lines(spark, sf_dir) -> DataFrame:
    """Position lines with all kinds of faults."""
    fields = [
        "element_at(array(1, 1, 1, 2, 3, 9), int(event_id % 6) + 1)", "if(event_id % 53 = 0, 0, user_id)", "t + event_id % 900 - 500", "event_id % 7", "1 + event_id % 27", "t",
        "(event_id * 7919 * 1000) % 217400000 - 108700000", "(event_id * 104729) % 109400000 - 54700000", "event_id % 3700", "event_id % 1100", "event_id % 520", "event_id % 18", "event_id % 300 - 150", "event_id % 4",
    ]
    texts = [f"if(event_id % 41 = {n}, '', string({f}))" if n in (2, 6, 9) else f"string({f})" for n, f in enumerate(fields)]
    return timed_events(spark, sf_dir).selectExpr(f"if(event_id % 97 = 0, 'x', '') || concat_ws('~', {', '.join(texts)}) AS value", *FILE, "event_id AS line_number")


FILE = ["'2024-01-15' AS record_date", "'POS_OK_2024-01-15.dat' AS source_file"]
RAW_LINES = f"""(SELECT CASE WHEN event_id % 97 = 0 THEN 'x' ELSE '' END || concat_ws('~', [1,1,1,2,3,9][event_id % 6 + 1]::VARCHAR,
  (CASE WHEN event_id % 53 = 0 THEN 0 ELSE user_id END)::VARCHAR, CASE WHEN event_id % 41 = 2 THEN '' ELSE (t + event_id % 900 - 500)::VARCHAR END, (event_id % 7)::VARCHAR,
  (1 + event_id % 27)::VARCHAR, t::VARCHAR, CASE WHEN event_id % 41 = 6 THEN '' ELSE ((event_id * 7919 * 1000) % 217400000 - 108700000)::VARCHAR END,
  ((event_id * 104729) % 109400000 - 54700000)::VARCHAR, (event_id % 3700)::VARCHAR, CASE WHEN event_id % 41 = 9 THEN '' ELSE (event_id % 1100)::VARCHAR END, (event_id % 520)::VARCHAR,
  (event_id % 18)::VARCHAR, (event_id % 300 - 150)::VARCHAR, (event_id % 4)::VARCHAR) AS value, event_id AS line_number FROM {TIMED})"""


def static_lines(spark, sf_dir) -> DataFrame:
    """Static message lines of all kinds, from orders."""
    o = table(spark, sf_dir, "orders").selectExpr(
        "*", "o_orderkey AS k", "element_at(array('5', '5', '19', '21', '24A', '24B', '7'), int(o_orderkey % 7) + 1) AS message", "string(70 + o_orderkey % 20) AS kind",
        "if(o_orderkey % 5 = 0, '', o_orderpriority || '@@') AS name", f"unix_seconds(CAST(o_orderdate AS TIMESTAMP)) + if(o_orderkey % 97 = 0, 0, {STATIC_SHIFT}) AS received",
    )
    joined = lambda *fields: f"concat_ws('~', {', '.join(f'string({f})' for f in fields)})"
    size = ["k % 400", "k % 90", "k % 40", "k % 41"]
    five = joined("k % 9999999", "'CS' || k % 1000 || '@'", "name", "kind", *size, "k % 18", "'03021200'", "k % 300", "o_orderstatus", "k % 3")
    other = joined("kind", "'VENDOR@'", "'C' || k % 100", *size, "k % 20", "k % 2")
    tail = f"CASE message WHEN '5' THEN {five} WHEN '24A' THEN name WHEN '19' THEN {joined('name', 'kind', *size, 'k % 20', 'k % 2')} ELSE {other} END"
    line = joined("if(k % 31 = 0, 2, 1)", "if(k % 43 = 0, 0, o_custkey)", "received", "k % 4", "message", tail)
    return o.selectExpr(f"{line} AS value", "'STA_OK.dat' AS source_file", "CAST(NULL AS STRING) AS record_date", "k AS line_number")


_FIVE = "(o_orderkey % 9999999)::VARCHAR, 'CS' || (o_orderkey % 1000)::VARCHAR || '@', nm, kind, (o_orderkey % 400)::VARCHAR, (o_orderkey % 90)::VARCHAR, (o_orderkey % 40)::VARCHAR, (o_orderkey % 41)::VARCHAR, (o_orderkey % 18)::VARCHAR, '03021200', (o_orderkey % 300)::VARCHAR, o_orderstatus, (o_orderkey % 3)::VARCHAR"
_REST = "(o_orderkey % 400)::VARCHAR, (o_orderkey % 90)::VARCHAR, (o_orderkey % 40)::VARCHAR, (o_orderkey % 41)::VARCHAR, (o_orderkey % 20)::VARCHAR, (o_orderkey % 2)::VARCHAR"
STATIC_LINES = f"""(SELECT concat_ws('~', CASE WHEN o_orderkey % 31 = 0 THEN '2' ELSE '1' END, (CASE WHEN o_orderkey % 43 = 0 THEN 0 ELSE o_custkey END)::VARCHAR,
  (epoch_us(o_orderdate) // 1000000 + CASE WHEN o_orderkey % 97 = 0 THEN 0 ELSE {STATIC_SHIFT} END)::VARCHAR, (o_orderkey % 4)::VARCHAR, msg,
  CASE WHEN msg = '5' THEN concat_ws('~', {_FIVE}) WHEN msg = '24A' THEN nm WHEN msg = '19' THEN concat_ws('~', nm, kind, {_REST})
    ELSE concat_ws('~', kind, 'VENDOR@', 'C' || (o_orderkey % 100)::VARCHAR, {_REST}) END) AS value, o_orderkey AS line_number
  FROM (SELECT *, ['5','5','19','21','24A','24B','7'][o_orderkey % 7 + 1] AS msg, (70 + o_orderkey % 20)::VARCHAR AS kind,
    CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderpriority || '@@' END AS nm FROM orders))"""


def clean_lines(spark, sf_dir) -> DataFrame:
    """Position lines without faults but for a few, so that tracks can be sampled."""
    fields = [
        "1", "user_id", "t + event_id % 200", "event_id % 7", "1", "t", "if(event_id % 89 = 0, 0, (event_id * 7919 * 1000) % 216000000 - 108000000)", "if(event_id % 89 = 0, 0, (event_id * 104729) % 108000000 - 54000000)",
        "event_id % 3600", "event_id % 1000", "event_id % 360", "event_id % 16", "0", "event_id % 2",
    ]
    return timed_events(spark, sf_dir).selectExpr(f"concat_ws('~', {', '.join(f'string({f})' for f in fields)}) AS value", *FILE, "event_id AS line_number")


CLEAN = f"""(SELECT 1::TINYINT AS comm_type, user_id::INTEGER AS mmsi, t + event_id % 200 AS receive_time_s, (event_id % 7)::SMALLINT AS source_id, t AS pos_time_s,
  (CASE WHEN event_id % 89 = 0 THEN 0 ELSE (event_id * 7919 * 1000) % 216000000 - 108000000 END) / 600000.0::DOUBLE AS longitude_deg,
  (CASE WHEN event_id % 89 = 0 THEN 0 ELSE (event_id * 104729) % 108000000 - 54000000 END) / 600000.0::DOUBLE AS latitude_deg,
  (event_id % 1000) / 10.0::DOUBLE AS sog_kn, event_id AS line_number, 'POS_OK_2024-01-15.dat' AS source_file,
  user_id BETWEEN 1 AND 999999999 AND t + event_id % 200 BETWEEN 946684800 AND 4102444800 AND t BETWEEN 946684800 AND 4102444800 AS is_hard_valid FROM {TIMED})"""


def cargo_events(spark, sf_dir) -> DataFrame:
    e = timed_events(spark, sf_dir)
    i = F.col("event_id")
    lon = F.when(i % 61 != 0, ((i * 37) % 36_000 - 18_000) / F.lit(100.0))
    lat = F.when(i % 67 == 0, F.lit(91.0)).otherwise(((i * 53) % 18_001 - 9000) / F.lit(100.0))
    return e.select(i.cast("string").alias("event_id"), F.when(F.col("event_type") == "error", "rejected").otherwise("accepted").alias("event_status"), F.col("t").alias("event_start_s"), (F.col("t") + 7200 * (1 + i % 5)).alias("event_end_s"), lon.alias("event_longitude_deg"), lat.alias("event_latitude_deg"))


CARGO = f"""(SELECT event_id::VARCHAR AS event_id, CASE WHEN event_type = 'error' THEN 'rejected' ELSE 'accepted' END AS event_status, t AS event_start_s, t + 7200 * (1 + event_id % 5) AS event_end_s,
  CASE WHEN event_id % 61 <> 0 THEN ((event_id * 37) % 36000 - 18000) / 100.0::DOUBLE END AS event_longitude_deg,
  CASE WHEN event_id % 67 = 0 THEN 91.0 ELSE ((event_id * 53) % 18001 - 9000) / 100.0::DOUBLE END AS event_latitude_deg FROM {TIMED})"""


def grid(spark, months: list[str], lon_first: int, base: float, span: int, scale: float, kelvin: bool = False) -> DataFrame:
    """A one-degree grid of every month with holes; values by arithmetic on the cell's number."""
    g = spark.range(181 * 360).select(F.floor(F.col("id") / 360).alias("y"), (F.col("id") % 360).alias("x"))
    g = g.select(F.explode(F.array(*map(F.lit, months))).alias("month"), (F.col("y") - 90).cast("double").alias("lat"), (F.col("x") + lon_first).cast("double").alias("lon"), "x", "y")
    n = (F.col("x") * 7 + F.col("y") * 13 + F.substring("month", -2, 2).cast("int")) % span
    return g.select("month", "lat", "lon", F.when((F.col("x") * 3 + F.col("y")) % 11 != 0, F.lit(base) + n / F.lit(scale)).alias("value"))


def grid_sql(months: list[str], lon_first: int, base: float, span: int, scale: float) -> str:
    listed = ", ".join(f"'{m}'" for m in months)
    return f"""(SELECT month, (y - 90)::DOUBLE AS lat, (x + {lon_first})::DOUBLE AS lon,
  CASE WHEN (x * 3 + y) % 11 <> 0 THEN {base}::DOUBLE + ((x * 7 + y * 13 + right(month, 2)::INT) % {span}) / {scale}::DOUBLE END AS value
  FROM (SELECT i // 360 AS y, i % 360 AS x FROM range({181 * 360}) r(i)), (SELECT unnest([{listed}]) AS month))"""


SST = (["2024-01", "2024-02"], 0, -8.0, 60, 1.0)
SALT = (["01", "02"], -180, 20.0, 40, 1.0)
