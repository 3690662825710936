"""The corpus pipeline: documents through five operators, each stage over all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the caller writes it and reads it again
as the next stage's documents. All but the last return the columns of documents. Rows are told apart by
a number of their own within a stage, so null and repeated ids lose nothing. An empty table passes
through every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.llm import exact_dedup, mixing, near_dedup, packing, quality
from fairlead.llm.registry import table, tokenizer_path
from fairlead.llm.shared import release, shared_dir, workspace, written

SIMILARITY = 80  # percent, of near copies
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
WORDS = 1 << 20  # words of 64 rows that each executor may be sent, some 64 MB


def numbered(docs: DataFrame) -> DataFrame:
    """Rows with a number each, of their file and place in it, whatever the splits in which a pass reads
    the files, so that each use of it has the same numbers. Rows that come from no files are written first."""
    place = lambda d: d.select(*COLUMNS, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    try:
        placed = place(docs)
    except AnalysisException:
        placed = place(written(docs.select(COLUMNS), f"{shared_dir(docs.sparkSession, 'pipeline')}/rows"))
    files = sorted(r["_file"] for r in placed.select("_file").distinct().collect())
    order = docs.sparkSession.createDataFrame([*enumerate(files)], "_n long, _file string")
    row = F.shiftleft("_n", 40).bitwiseOR(F.col("_at")).alias("_row")
    return placed.join(F.broadcast(order), "_file").select(*COLUMNS, row)


def decided(spark: SparkSession, label: str, decide: Callable[[], DataFrame]) -> DataFrame:
    """What an operator decides on rows, written, with their numbers; the files that it made on the way go."""
    path = f"{shared_dir(spark, 'pipeline')}/{label}"
    with workspace(spark, label):
        return written(decide().withColumnRenamed("row", "_row"), path)


def only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The numbered rows whose numbers are in `kept`, without the numbers. They are sent to all tasks as bits of
    words while these, counted first, are no more than WORDS, and texts stay where they are; beyond that, rows
    and numbers are joined by shuffle."""
    spark = docs.sparkSession
    word, bit = F.shiftright("_row", 6).alias("_word"), F.expr("cast(_row & 63 as int)")
    bits = F.expr("bit_or(shiftleft(1L, cast(_row & 63 as int)))").alias("_bits")
    words = written(kept.groupBy(word).agg(bits), f"{shared_dir(spark, 'pipeline')}/words")
    if words.count() > WORDS:
        return docs.join(kept, "_row", "left_semi").select(COLUMNS)
    return docs.withColumn("_word", word).join(F.broadcast(words), "_word").where(F.getbit("_bits", bit) == 1).select(COLUMNS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose predicted quality is 1; the labels of the corpus train the classifier."""
    docs = numbered(docs)
    labels = table(spark, sf_dir, "labels")
    kept = decided(spark, "quality", lambda: quality.classify(docs, labels, row_col="_row").where("predicted = 1").select("row"))
    return only(docs, kept)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the longest, then that with the smallest id."""
    docs = numbered(docs)
    kept = decided(spark, "copies", lambda: exact_dedup.exact_dedup(docs, row_col="_row").where("kept").select("row"))
    return only(docs, kept)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, which are alike by 80 percent of their shingles of
    five words: that with the smallest id. Documents without words link with nothing and stay."""
    docs = numbered(docs)
    kept = decided(spark, "near-copies", lambda: near_dedup.near_duplicates(docs, similarity=SIMILARITY, row_col="_row").where("stays").select("row"))
    return only(docs, kept)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: whole copies, and a partly taken one cut after the
    words taken. Documents that it does not take go."""
    docs = numbered(docs)
    taken = decided(spark, "mix", lambda: mixing.mix(docs, row_col="_row").where("taken > 0").select("row", "size", "taken"))
    times = F.ceil(F.col("taken") / F.col("size")).cast("int")
    out = docs.join(taken, "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1), times)))
    left = (F.col("taken") - (F.col("_copy") - 1) * F.col("size")).cast("int")
    words = F.regexp_extract_all("text", F.lit("[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+"), F.lit(0))  # each with the blanks before it
    head = F.array_join(F.slice(words, 1, left), "")
    text = F.when(left < F.col("size"), head).otherwise(F.col("text"))
    return out.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, see `packing.pack`."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("source mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Boosted trees, balanced sampling and tokenising are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, docs = shared_dir(spark, "corpus"), table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES[:-1]):
        docs = written(stage(spark, docs, sf_dir), f"{folder}/{n}")
        if n:
            release(spark, f"{folder}/{n - 1}")  # its successor is written
    return STAGES[-1][1](spark, docs, sf_dir)
