"""Mixing sources to target weights by cube-method balanced sampling.

A source whose target is r times its size takes floor(r) copies of each of its documents and one
more of a sample whose inclusion probabilities are all r - floor(r). The flight phase of the cube
method moves those probabilities to 0 or 1 along vectors that leave both totals, words and documents,
unchanged: for three open units of sizes a, b, c such a vector is (b-c, c-a, a-b). A source is dealt
in blocks, so that a hot source is many tasks' work; each block leaves two open units at most, and
the rest of the blocks flies again by source. The small landing problem is solved by taking a part
of the units then open, so that a source's words meet its target but for rounding.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import shared_dir, written

WEIGHTS = (5.0, 2.0, 1.0)  # repeating over the sources in order
SHARE = 1.5  # of all words
MOST = 2.0  # times a source's size
BLOCK = 4096  # documents that fly together
BROADCAST = 16 << 20  # bytes of sources and their rates up to which they are broadcast
SALTS = 64  # parts of each source beyond that

UNIT = "row long, o long, source string, block long, size long, part double, open boolean"


def source_rates(units: DataFrame, folder: str, weights=WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK) -> DataFrame:
    """source, source_size, target, copies, part, blocks: a row for each source of (source, size).

    Target: words to take from a source: `share` of all words by weight, none above `most` times its
    size; what is above is shared again among the others. Words per weight rise from round to round until
    no further source is full; each round is one aggregate of the table of sources, which is never collected.
    The rounds are Newton's method on a concave function of pieces that are straight: few, and exact.
    """
    spark, parts = units.sparkSession, int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sums = units.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    # a source's place in the order: its place in its range of sources, and how many come in the ranges before
    order = [F.col("source").isNull(), F.col("source")]
    at = F.monotonically_increasing_id()
    placed = written(sums.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("*", at.alias("at")), f"{folder}/placed")
    ranges = placed.groupBy(F.shiftright("at", 33).alias("range")).agg(F.count("*").alias("own")).orderBy("range").collect()  # `parts` at most
    before = [(r["range"], sum(x["own"] for x in ranges[:i])) for i, r in enumerate(ranges)]
    placed = placed.withColumn("range", F.shiftright("at", 33)).join(F.broadcast(spark.createDataFrame(before, "range long, before long")), "range")
    place = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    sources = written(placed.select("source", "source_size", "n", (place % len(weights)).cast("int").alias("turn")), f"{folder}/sources")
    weight, cap = F.element_at(F.array(*map(F.lit, weights)), F.col("turn") + 1), F.lit(most) * F.col("source_size")
    each, known, all_words = 0.0, -1, sources.agg(F.sum("source_size")).first()[0] or 0
    while True:
        full = F.lit(each) * weight >= cap
        free = [F.count_if(~full & (F.col("turn") == i)) for i in range(len(weights))]  # whole numbers, so that no order of addition matters
        n, held, *free = sources.agg(F.count_if(full), F.sum(F.when(full, F.col("source_size"))), *free).first()
        if n == known or not sum(free):
            break
        known, each = n, max(0.0, share * all_words - most * (held or 0)) / sum(k * w for k, w in zip(free, weights))
    target = F.least(F.lit(each) * weight, cap) if sum(free) else cap
    ratio = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0)
    copies = F.floor(ratio + 1e-12)
    return sources.select("source", "source_size", target.alias("target"), copies.alias("copies"), F.greatest(F.lit(0.0), ratio - copies).alias("part"), F.ceil(F.col("n") / block).cast("long").alias("blocks"))


def rated(units: DataFrame, rates: DataFrame, folder: str) -> DataFrame:
    """Units with their source's rates. While the names are known to be few, their table is broadcast. Else
    both sides are salted, so that a source which holds a third of all units is many tasks' work."""
    rates = written(rates.withColumn("name", F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))).drop("source"), f"{folder}/rates")
    units = units.withColumn("name", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
    size = rates.agg(F.sum(F.length("name").cast("long") * 4 + 64)).first()[0] or 0
    if size <= BROADCAST:
        return units.join(F.broadcast(rates), "name").drop("name")
    units = units.withColumn("salt", F.pmod("o", F.lit(SALTS)).cast("int"))
    return units.join(rates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["name", "salt"]).drop("name", "salt")


def fly(sizes: list[int], parts: list[float], seed: int) -> list[float]:
    """Probabilities after the flight: 0 or 1 but for two at most; sum(part) and sum(size * part) are kept."""
    rng = np.random.default_rng(seed)
    parts, held, eps = list(parts), [], 1e-9
    draws = iter(())
    for i in range(len(parts)):
        if eps < parts[i] < 1 - eps:
            held.append(i)
        else:
            parts[i] = float(round(parts[i]))
        while len(held) == 3:
            x, y, z = held
            a, b, c = sizes[x], sizes[y], sizes[z]
            u = (b - c, c - a, a - b) if not a == b == c else (1, -1, 0)
            up = down = float("inf")
            for k, v in zip(held, u):
                if v > 0:
                    up, down = min(up, (1 - parts[k]) / v), min(down, parts[k] / v)
                elif v < 0:
                    up, down = min(up, parts[k] / -v), min(down, (1 - parts[k]) / -v)
            draw = next(draws, None)
            if draw is None:
                draws = iter(rng.random(4096).tolist())
                draw = next(draws)
            step = up if draw * (up + down) < down else -down
            for k, v in zip(held, u):
                parts[k] += step * v
                if parts[k] < eps:
                    parts[k] = 0.0
                elif parts[k] > 1 - eps:
                    parts[k] = 1.0
            held = [k for k in held if 0.0 < parts[k] < 1.0]
    return parts


def _flight(seed: int):
    """Over partitions sorted by source and block; a block never spans partitions."""

    def run(batches):
        own: list = []

        def flown():
            parts = fly([r[4] for r in own], [r[5] for r in own], (hash_of(own[0][2]) * 31 + own[0][3] + seed) % (1 << 63))
            rows = [(*r[:5], p, 0.0 < p < 1.0) for r, p in zip(own, parts)]
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["row", "o", "source", "block", "size", "part", "open"])

        for b in batches:
            for r in zip(*(b.column(k).to_pylist() for k in ("row", "o", "source", "block", "size", "part"))):
                if own and own[0][2:4] != r[2:4]:
                    yield flown()
                    own.clear()
                own.append(r)
        if own:
            yield flown()

    return run


def hash_of(source: str | None) -> int:
    import zlib

    return 0 if source is None else 1 + zlib.crc32(source.encode())


def told_apart(units: DataFrame, folder: str) -> DataFrame:
    """Units with `again`, which tells rows of equal content apart: 0, 1, ... in whatever files and parts they come.

    Rows are counted within a part of the table, then a part's counts go on from those of the parts before;
    so a content that fills the table is never one task's work."""
    content = ["doc_id", "source", "size", "mark"]
    own = units.withColumn("turn", F.row_number().over(Window.partitionBy(*content, "place").orderBy("row")) - 1)
    counts = written(units.groupBy(*content, "place").agg(F.count("*").alias("n")), f"{folder}/counts")
    earlier = F.sum("n").over(Window.partitionBy(*content).orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    earlier = counts.withColumn("earlier", earlier).where("earlier > 0")
    same = [F.col(f"u.{c}").eqNullSafe(F.col(f"e.{c}")) for c in (*content, "place")]
    out = own.alias("u").join(earlier.alias("e"), same, "left")
    return out.select(*(F.col(f"u.{c}") for c in (*content, "row")), (F.col("u.turn") + F.coalesce("e.earlier", F.lit(0))).alias("again"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 7, row_col: str | None = None, block: int = BLOCK) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row for each row of `docs`.

    size is the number of words between ASCII blanks of the whole text, however long (null text: 0), taken
    the words that the mix takes of the document, whole copies but for a few partly taken ones, at most
    ceil(most) times its size. Sources go by code point, null last, in any number; weights repeat over them.
    Documents without words take nothing. Repeated rows and null ids are documents of their own. The draw
    depends on the seed and on the rows' contents alone, not on files or partitions, so reruns agree (of
    rows that are equal throughout, which one takes more is left open, how many do is not); other columns
    are ignored; an empty table gives no rows. `row_col` (a unique long) is returned as `row` beside the id.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark, "mixing")
    row = F.col(row_col).cast("long") if row_col else F.monotonically_increasing_id()
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")
    mark = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    units = docs.select(row.alias("row"), F.spark_partition_id().alias("place"), F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), mark.alias("mark"))
    units = written(units, f"{folder}/units")
    rates = source_rates(units, folder, weights, share, most, block)
    units = told_apart(units, folder).withColumn("o", F.xxhash64(F.lit(seed), "doc_id", "size", "mark", "again"))
    known = written(rated(units, rates, folder).drop("again", "mark"), f"{folder}/known")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda level, blocks: F.pmod(F.xxhash64(F.lit(seed + 1 + level), "o"), blocks).alias("block")
    flying = known.select("row", "o", "source", dealt(0, F.col("blocks")), "size", "part")
    sort = ["source", "block", "o", "size", "row"]
    first = flying.repartition(parts, "source", "block").sortWithinPartitions(*sort).mapInArrow(_flight(seed), UNIT)
    flown = written(first, f"{folder}/flown-0")
    settled, rest, level = [flown.where("not open")], flown.where("open"), 0
    while True:
        # two open units remain of each block; as many as one block can hold fly together again
        level += 1
        widest = rest.groupBy("source").count().agg(F.max("count")).first()[0] or 0
        blocks = -(-widest // block) or 1
        again = rest.select("row", "o", "source", dealt(level, F.lit(blocks)), "size", "part")
        again = again.repartition(parts, "source", "block").sortWithinPartitions(*sort).mapInArrow(_flight(seed + level), UNIT)
        flown = written(again, f"{folder}/flown-{level}")
        if blocks == 1:
            settled.append(flown)
            break
        settled.append(flown.where("not open"))
        rest = flown.where("open")
    taken = settled[0]
    for x in settled[1:]:
        taken = taken.unionByName(x)
    out = known.drop("part").join(taken.select("row", "part"), "row")
    words = F.col("size") * F.col("copies") + F.round(F.col("size") * F.col("part")).cast("long")
    return out.select("doc_id", "size", "source_size", "target", words.alias("taken"), *(["row"] if row_col else []))
