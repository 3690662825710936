"""A quality classifier: histogram gradient-boosted trees over statistics of whole texts.

Statistics are counted in numpy for many texts at once and written once; labelled rows train the
trees at the driver (on a bounded sample), and all rows are scored by vectorised traversal of the
trees as flat arrays. No statistic depends on labels, language, source or id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fold_of, joined_bytes, shared_dir, slices, written
from .words import LOWER, hash_words, mixed, word_places

SAMPLE_ROWS = 20_000  # labelled ids that training takes, about; with repeated rows, twice as many rows at most
THRESHOLD = 0.3
BINS, TREES, DEPTH, RATE, PENALTY, LEAST = 64, 60, 4, 0.2, 1.0, 5.0

_code = np.arange(256)
_alnum = ((_code >= 48) & (_code <= 57)) | ((_code >= 65) & (_code <= 90)) | ((_code >= 97) & (_code <= 122))
SYMBOL = (_code > 32) & (_code < 127) & ~_alnum
CLASSES = {
    "lower": (_code >= 97) & (_code <= 122), "upper": (_code >= 65) & (_code <= 90), "digit": (_code >= 48) & (_code <= 57),
    "blank": (_code == 32) | ((_code >= 9) & (_code <= 13)), "line": _code == 10, "symbol": SYMBOL, "stop": np.isin(_code, list(b".,;:?!")), "high": _code >= 128, "control": (_code < 9) | (_code == 127),
}
FEATURES = ["log_bytes", "log_words", "word_length", *CLASSES, "top_symbol", "entropy", "distinct", "top_word", "again", "tail_symbols", "upper_words", "symbol_words", "long_words", "lines_distinct"]


def _share(part, whole):
    return np.divide(part, whole, out=np.zeros(len(whole)), where=whole > 0)


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text; shares of an empty text are 0."""
    data, ends = joined_bytes(texts)
    n = len(ends)
    sizes = np.diff(ends, prepend=0)
    counts = np.bincount(np.repeat(np.arange(n) * 256, sizes) + data, minlength=256 * n).reshape(n, 256)
    starts, stops, before = word_places(data, ends)
    words = np.diff(before, prepend=0)
    doc = np.repeat(np.arange(n), words)
    hashes = hash_words(LOWER[data], starts, stops)
    per_doc = lambda mask: np.bincount(doc[mask], minlength=n)

    keys = np.sort((doc.astype(np.uint64) << np.uint64(44)) | (hashes >> np.uint64(20)))
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    runs = np.diff(np.r_[first, len(keys)])
    owner = (keys[first] >> np.uint64(44)).astype(np.int64)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, owner, runs)
    again = np.zeros(len(doc), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    lengths = stops - starts
    symbol = SYMBOL[data]
    symbols = np.r_[0, np.cumsum(symbol)]
    uppers = np.r_[0, np.cumsum(CLASSES["upper"][data])]
    in_word = lambda sums: sums[stops] - sums[starts]
    tail = np.zeros(len(doc), bool)
    if len(doc):
        tail = symbol[stops - 1] & symbol[np.maximum(stops - 2, 0)] & (lengths > 2)
    upper = (in_word(uppers) >= 2) & (in_word(uppers) * 2 > lengths)

    # lines by the sum of their words' hashes with their place in the line
    line_of = np.r_[0, np.cumsum(data == 10)][starts]
    turn = np.ones(len(doc), bool)
    turn[1:] = (line_of[1:] != line_of[:-1]) | (doc[1:] != doc[:-1])
    heads = np.flatnonzero(turn)
    lines = np.bincount(doc[heads], minlength=n)
    place = (np.arange(len(doc)) - np.repeat(heads, np.diff(np.r_[heads, len(doc)]))).astype(np.uint64)
    whole = np.add.reduceat(mixed(hashes + place * np.uint64(0x9E3779B97F4A7C15)), heads) if len(heads) else np.empty(0, np.uint64)
    distinct = np.unique((doc[heads].astype(np.uint64) << np.uint64(44)) | (whole >> np.uint64(20)))
    lines_distinct = np.bincount((distinct >> np.uint64(44)).astype(np.int64), minlength=n)

    shares = counts / np.maximum(sizes, 1)[:, None]
    logs = np.zeros_like(shares)
    np.log2(shares, out=logs, where=shares > 0)
    marks = shares * (SYMBOL & ~CLASSES["stop"])
    out = [np.log1p(sizes), np.log1p(words), _share(np.bincount(doc, lengths, n), words), *(shares @ c.astype(float) for c in CLASSES.values()), marks.max(1, initial=0), -(shares * logs).sum(1)]
    out += [_share(np.bincount(owner, minlength=n), words), _share(top, words)]
    out += [_share(per_doc(m), words) for m in (again, tail, upper, in_word(symbols) == lengths, lengths > 30)]
    out.append(_share(lines_distinct, lines))
    return np.column_stack(out).astype(np.float32)


class Trees:
    """Complete trees of one depth in flat arrays: node i's children are 2i+1 and 2i+2; x > threshold goes right."""

    def __init__(self, base: float, features: np.ndarray, thresholds: np.ndarray, leaves: np.ndarray):
        self.base, self.features, self.thresholds, self.leaves = base, features, thresholds, leaves

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1."""
        total = np.full(len(x), self.base)
        if len(self.leaves):
            inner = self.features.shape[1]
            tree, rows = np.arange(len(self.leaves)), np.arange(len(x))[:, None]
            node = np.zeros((len(x), len(self.leaves)), np.int64)
            while node[0, 0] < inner if len(x) else False:
                node = 2 * node + 1 + (x[rows, self.features[tree, node]] > self.thresholds[tree, node])
            total = total + self.leaves[tree, node - inner].sum(1)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, bins: int = BINS, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Trees:
    """Trees for labels 0 and 1 by the logistic loss. Without rows every score is 0.5; with one label
    the scores follow its smoothed share alone."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    base, inner = float(np.log(share / (1 - share))), (1 << depth) - 1
    none = Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    if len(np.unique(y)) < 2:
        return none
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])  # x > cuts[b] from bin b + 1
    score, built = np.full(len(y), base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        feature, threshold, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for level in range(depth):
            n, start = 1 << level, (1 << level) - 1
            best, cut = np.full(n, 1e-6), np.zeros(n, np.int64)
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                key = (node - start) * bins + binned[:, j]
                gl, hl = (np.cumsum(np.bincount(key, w, n * bins).reshape(n, bins), 1) for w in (g, h))
                ga, ha = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + PENALTY) + (ga - gl) ** 2 / (ha - hl + PENALTY) - ga**2 / (ha + PENALTY)
                gain[(hl < 0.05 * LEAST) | (ha - hl < 0.05 * LEAST)] = 0
                gain = gain[:, : len(c)]
                at = gain.argmax(1)
                up = gain[np.arange(n), at] > best
                best[up], cut[up], feature[start : start + n][up] = gain[np.arange(n), at][up], at[up], j
                threshold[start : start + n][up] = c[at[up]]
            # a node without a gainful cut keeps an infinite threshold: all rows go left
            limit = np.where(np.isinf(threshold[start : start + n]), bins, cut)[node - start]
            node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] > limit)
        leaf = node - inner
        values = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + PENALTY)
        score = score + values[leaf]
        built.append((feature, threshold, values))
    return Trees(base, *(np.array(c) for c in zip(*built)))


def _statistics_run(batches):
    names = ["doc_id", "held_out", "row", "x"]
    for batch in batches:
        for part in slices(batch, "text", 2 << 20):
            x = statistics(part.column("text"))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), part.column("row"), flat], names=names)


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS, row_col: str | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of `docs`.

    Labels are learnt where crc32(id as text) mod 5 is not 0, from about `sample_rows` ids, and only
    labels 0 and 1 count; an id with both labels takes the more frequent, 1 in a tie. Rows with a null
    id are never learnt from. Null texts count as empty and are scored like them. Repeated rows are
    scored each; other columns of either table are ignored; without labels every score is 0.5.
    `row_col` (a long) is returned as `row`.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark, "quality")
    row = F.col(row_col).cast("long") if row_col else F.lit(None).cast("long")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), (fold_of(id_col) == 0).alias("held_out"), row.alias("row"))
    known = written(source.mapInArrow(_statistics_run, "doc_id long, held_out boolean, row long, x array<float>"), f"{folder}/statistics")
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    marks = marks.groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    labelled = known.where("not held_out").join(marks, "doc_id").select("x", "y", "doc_id")
    share = min(1.0, sample_rows / max(1, marks.count()))  # by hash of id; no task gathers more than the sample
    sample = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(2 * sample_rows).orderBy("doc_id", "x").select("x", "y").toArrow()
    model = fit(_matrix(sample.column("x")), sample.column("y").to_numpy().astype(float))

    def score(batches):
        for b in batches:
            s = model.scores(_matrix(b.column("x")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32)), b.column("row")], names=["doc_id", "held_out", "score", "predicted", "row"])

    out = known.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int, row long")
    return out if row_col else out.drop("row")
