"""Scoring texts by prediction by partial matching (PPM), beside a word unigram base.

Pretrained: the corpus is counted once, words and byte (ORDER+1)-grams, and both counts grow with it.
The grams make a trie of byte contexts. Each context predicts a symbol by method C: what followed it by
its count, an escape by the number of different symbols that did, and after an escape the next shorter
context without the symbols already excluded. The trie is kept sparsely, in files: for each order what was
seen, and for each context what an escape from it leaves to the next shorter one. It has the same order
whatever the size of the corpus. No task holds all of it: frequent words and grams (bounded tables) are
scored in the scanning task, the others as (row, word) and (row, gram) pairs by joins.

`build` and `Table` work a small trie out in memory, with each context's whole distribution.

Adaptive: `Adaptive` learns as it reads one text; `adaptive_lengths` gives its code length by document.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import as_bytes, fold_of, shared_dir, slices, written
from .words import LOWER

ORDER = 4  # bytes of the longest context
FREQUENT = 200_000  # words whose counts every task holds
GRAMS = 2_000_000  # grams whose chances every task holds
PARTIAL = 500_000  # words that a task counts before it hands them on
START, END = 0xFE, 0xFF  # bytes that UTF-8 never has: before a text, after it
SYMBOLS = 257  # 256 bytes and the end


class Adaptive:
    """PPM over bytes that learns each symbol after coding it (method C, exclusion, full update)."""

    def __init__(self, order: int = ORDER):
        self.order, self.counts = order, {}

    def chance(self, context: tuple, symbol: int) -> float:
        """The probability of a symbol after a context (its last `order` symbols), by escapes."""
        p, excluded = 1.0, set()
        for k in range(len(context), -1, -1):
            seen = self.counts.get(context[len(context) - k :])
            if seen is None:
                continue
            own = {s: n for s, n in seen.items() if s not in excluded}
            total, kinds = sum(own.values()), len(own)
            if not own:
                continue
            escape = kinds if len(excluded) + kinds < SYMBOLS else 0
            if symbol in own:
                return p * own[symbol] / (total + escape)
            p *= escape / (total + escape)
            excluded |= own.keys()
        return p / (SYMBOLS - len(excluded))

    def learn(self, context: tuple, symbol: int) -> None:
        for k in range(len(context) + 1):
            seen = self.counts.setdefault(context[k:], {})
            seen[symbol] = seen.get(symbol, 0) + 1

    def log10(self, text: bytes, learn: bool = True) -> float:
        context, total = (START,) * self.order, 0.0
        for symbol in (*text, END):
            total += np.log10(self.chance(context, symbol))
            if learn:
                self.learn(context, symbol)
            context = (*context, symbol)[1:] if self.order else ()
        return total


class Table:
    """A fixed trie's contexts with their distributions: child[node, symbol] is the longer context or 0
    (the root is node 1 of order 0), logs[node, symbol] the log10 probability. Symbols are numbered by
    `code`; the last stands for any byte never seen."""

    def __init__(self, order: int, code: np.ndarray, child: np.ndarray, logs: np.ndarray):
        self.order, self.code, self.child, self.logs = order, code, child, logs

    def scores(self, framed: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Log10 probabilities of texts laid one after another, each START * ORDER, bytes, END; `first`:
        where each begins."""
        s = self.code[framed]
        a = self.child.shape[1]
        flat, best = self.child.ravel(), np.ones(len(s), np.int32)
        near = np.ones(len(s), np.int32)  # of order k, for the symbols up to a place
        for k in range(self.order):
            near = np.r_[np.int32(0), near[:-1]] if k else near
            near = flat[near * np.int32(a) + s] if a * len(self.child) < 2**31 else flat[near.astype(np.int64) * a + s]
            best = np.where(near > 0, near, best)
        context = np.r_[np.int32(1), best[:-1]]
        logs = self.logs.ravel()[context.astype(np.int64) * a + s]
        logs[framed == START] = 0
        return np.add.reduceat(logs.astype(np.float64), first) if len(first) else np.empty(0)


def build(grams: np.ndarray, counts: np.ndarray, order: int) -> Table:
    """The table from counts of (order+1)-grams, each `order` context bytes and the symbol as one number."""
    columns = np.stack([(grams >> np.uint64(8 * (order - i))) & np.uint64(255) for i in range(order + 1)], 1).astype(np.int64)
    seen = np.unique(columns)
    a = len(seen) + 1
    code = np.full(256, a - 1, np.int32)
    code[seen] = np.arange(len(seen))
    columns = code[columns].astype(np.int64)
    # contexts by order: keys in base a, of the last k symbols before the predicted one
    keys, cells = [], []
    for k in range(order + 1):
        key = np.zeros(len(columns), np.int64)
        for i in range(order - k, order):
            key = key * a + columns[:, i]
        own, at = np.unique(key, return_inverse=True)
        keys.append(own)
        cells.append((at, columns[:, order]))
    first = np.cumsum([1, *map(len, keys)])  # node 0 is no context
    child = np.zeros((first[-1], a), np.int32)
    suffix = np.zeros(first[-1], np.int32)
    for k in range(1, order + 1):
        node = first[k] + np.arange(len(keys[k]))
        head, last = keys[k] // a, keys[k] % a
        at = np.searchsorted(keys[k - 1], head)
        there = (at < len(keys[k - 1])) & (keys[k - 1][np.minimum(at, len(keys[k - 1]) - 1)] == head)
        # a context's own beginning may never have preceded a symbol: it is then unreachable by one step, and has none
        child[first[k - 1] + at[there], last[there]] = node[there]
        suffix[node] = first[k - 1] + np.searchsorted(keys[k - 1], keys[k] % a ** (k - 1))
    n = np.zeros((first[-1], a))
    for k, (at, symbol) in enumerate(cells):
        np.add.at(n, (first[k] + at, symbol), counts)
    logs = np.empty((first[-1], a), np.float32)
    for lo in range(0, first[-1], 2048):
        node = np.arange(lo, min(lo + 2048, first[-1]))
        p, mass = np.zeros((len(node), a)), np.ones(len(node))
        open_, now = np.ones((len(node), a), bool), node.copy()
        for _ in range(order + 1):
            own = np.where(open_, n[now], 0)
            own[now == 0] = 0
            kinds, total = (own > 0).sum(1), own.sum(1)
            escape = np.where((~open_).sum(1) + kinds < SYMBOLS, kinds, 0)
            some = kinds > 0
            share = np.divide(mass, total + escape, out=np.zeros(len(node)), where=some)
            p += own * share[:, None]
            mass = np.where(some, share * escape, mass)
            open_ &= own == 0
            now = suffix[now]
        left = SYMBOLS - (~open_).sum(1)
        p = np.where(open_, (mass / np.maximum(left, 1))[:, None], p)
        with np.errstate(divide="ignore"):
            logs[node] = np.log10(p)
    return Table(order, code, child, logs)


def framed(texts: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased texts in one array, each START * order, bytes, END, and where each begins."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    cell = lambda b: pa.scalar(b, pa.large_binary())
    texts = pc.binary_join_element_wise(cell(bytes([START]) * order), texts, cell(bytes([END])), cell(b""))
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return LOWER[data], offsets[:-1] - offsets[0]


def gram_counts(data: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    code = np.zeros(max(0, len(data) - order), np.uint64)
    for i in range(order + 1):
        code = (code << np.uint64(8)) | data[i : len(data) - order + i]
    return np.unique(code[data[order:] != START], return_counts=True)


def _count(order: int):
    names = ["word", "gram", "n"]

    def words_out(counter):
        return pa.RecordBatch.from_arrays([pa.array(list(counter), pa.binary()), pa.nulls(len(counter), pa.int64()), pa.array(list(counter.values()), pa.int64())], names=names)

    def grams_out(grams, n):
        return pa.RecordBatch.from_arrays([pa.nulls(len(grams), pa.binary()), pa.array(grams.view(np.int64)), pa.array(n)], names=names)

    def merged(held):
        grams, n = (np.concatenate(x) for x in zip(*held))
        own, at = np.unique(grams, return_inverse=True)
        return own, np.bincount(at, n).astype(np.int64)

    def run(batches):
        counter, held, texts = Counter(), [], 0
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                for text in as_bytes(part.column("text")):
                    counter.update(text.lower().split())
                    texts += 1
                held.append(gram_counts(framed(part.column("text"), order)[0], order))
                if len(held) == 16:
                    held = [merged(held)]
                if len(held[0][0]) > PARTIAL:
                    yield grams_out(*merged(held))
                    held = []
                if len(counter) > PARTIAL:
                    yield words_out(counter)
                    counter.clear()
        if counter:
            yield words_out(counter)
        if held:
            yield grams_out(*merged(held))
        if texts:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.array([texts], pa.int64())], names=names)

    return run


def seen_shorter(order: int) -> str:
    """SQL of the last `order` + 1 bytes of a gram."""
    return f"gram & {(1 << 8 * (order + 1)) - 1}"


def trie(grams: DataFrame, order: int, folder: str) -> tuple[list[DataFrame], list[DataFrame]]:
    """By order, grams (gram, n) and contexts (context, total, kinds; above order 0 also rest and escape).

    rest and escape are of the next shorter context once the symbols seen here are excluded: its total,
    and its kinds or 0 where none would be left after them. What follows a context also follows the
    shorter one, so only the symbols seen one order above are ever excluded.
    """
    by_order, contexts = [grams], []
    for k in range(order - 1, -1, -1):
        shorter = by_order[0].select(F.expr(seen_shorter(k)).alias("gram"), "n").groupBy("gram").agg(F.sum("n").alias("n"))
        by_order.insert(0, written(shorter, f"{folder}/grams-{k}"))
    for k, own in enumerate(by_order):
        own, sums = own.withColumn("context", F.shiftright("gram", 8)), [F.sum("n").alias("total"), F.count("*").alias("kinds")]
        if k:
            low = by_order[k - 1].select(F.col("gram").alias("suffix"), F.col("n").alias("below"))
            own, sums = own.withColumn("suffix", F.expr(seen_shorter(k - 1))).join(low, "suffix"), [*sums, F.sum("below").alias("below")]
        own = own.groupBy("context").agg(*sums)
        if k:
            low = contexts[-1].select(F.col("context").alias("suffix"), F.col("total").alias("all_n"), F.col("kinds").alias("all_kinds"))
            own = own.withColumn("suffix", F.expr(f"context & {(1 << 8 * (k - 1)) - 1}")).join(low, "suffix")
            escape = F.when(F.col("all_kinds") < SYMBOLS, F.col("all_kinds") - F.col("kinds")).otherwise(0)
            own = own.select("context", "total", "kinds", (F.col("all_n") - F.col("below")).alias("rest"), escape.alias("escape"))
        contexts.append(written(own, f"{folder}/contexts-{k}"))
    return by_order, contexts


def seen_log():
    """log10 chance of a symbol seen in its longest context."""
    return F.log10(F.col("n") / (F.col("total") + F.when(F.col("kinds") < SYMBOLS, F.col("kinds")).otherwise(0)))


def unseen(wanted: DataFrame, by_order: list[DataFrame], contexts: list[DataFrame]) -> DataFrame:
    """(gram, log): log10 chances of grams (distinct) by escapes. From order to order come n, the count;
    left, the chance of an unseen gram once its context is escaped and excluded; log, that from this order on."""
    out = None
    for k, (grams, context) in enumerate(zip(by_order, contexts)):
        own = wanted.select(F.expr(seen_shorter(k)).alias("gram")).distinct().join(grams, "gram", "left")
        own = own.withColumn("context", F.shiftright("gram", 8)).join(context, "context", "left")
        escaped = F.log10(F.col("kinds") / (F.col("total") + F.col("kinds")))
        if k:
            low = out.select(F.col("gram").alias("suffix"), F.col("n").alias("low_n"), F.col("left").alias("low_left"), F.col("log").alias("low_log"))
            own = own.withColumn("suffix", F.expr(seen_shorter(k - 1))).join(low, "suffix")
            mass = F.col("rest") + F.col("escape")  # may be 0, for grams that were seen
            on = F.when(F.col("escape") > 0, F.log10(F.try_divide("escape", mass))).otherwise(0.0) + F.col("low_left")
            left, none = F.when(F.col("low_n").isNotNull(), F.log10(F.try_divide("low_n", mass))).otherwise(on), F.col("low_log")
        else:
            left, none = -F.log10(SYMBOLS - F.col("kinds")), F.lit(-float(np.log10(SYMBOLS)))
        log = F.when(F.col("n").isNotNull(), seen_log()).when(F.col("kinds").isNotNull(), escaped + left).otherwise(none)
        out = own.select("gram", "n", left.alias("left"), log.alias("log"))
    return out.select("gram", "log")


def _least(counts: DataFrame, column: str, most: int) -> int:
    """The lowest power of two that no more than `most` of the counts reach."""
    levels = [1 << i for i in range(40)]
    reach = counts.agg(*(F.count_if(F.col(column) >= x) for x in levels)).first()
    return next(x for x, n in zip(levels, reach) if n <= most)


def known_chances(data: np.ndarray, first: np.ndarray, order: int, keys: np.ndarray, logs: np.ndarray):
    """Of framed texts: each one's sum of the log10 chances of the grams in `keys` (sorted), and the other
    grams as (text, gram, times)."""
    code = np.zeros(len(data) - order, np.uint64)
    for i in range(order + 1):
        code = (code << np.uint64(8)) | data[i : len(data) - order + i]
    real = data[order:] != START
    at = np.searchsorted(keys, code)
    found = real & (keys[np.minimum(at, len(keys) - 1)] == code) if len(keys) else np.zeros(len(code), bool)
    own = np.zeros(len(data))
    own[order:][found] = logs[at[found]]
    other = np.flatnonzero(real & ~found)
    text, gram = np.searchsorted(first, other + order, side="right") - 1, code[other]
    by = np.lexsort((gram, text))
    text, gram = text[by], gram[by]
    start = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (gram[1:] != gram[:-1])][: len(text)])
    return np.add.reduceat(own, first), text[start], gram[start], np.diff(np.r_[start, len(text)])


def _score(order: int, chances, frequent, unit: float, denominator: float, end: int):
    """Rows of documents, and rows (row, word or gram, tf) of what is outside the frequent ones."""
    names = ["row", "doc_id", "held_out", "n_tokens", "known", "base", "score", "word", "gram", "tf"]
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.int64(), pa.int64()]

    def rows_of(n, **columns):
        return pa.RecordBatch.from_arrays([pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in zip(names, types)], names=names)

    def run(batches):
        words = {w: np.log10((c + unit) / denominator) for w, c in frequent.value.items()}
        keys, logs = chances.value
        end_log, row = np.log10((end + unit) / denominator), TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                scores, text, gram, times = known_chances(*framed(part.column("text"), order), order, keys, logs)
                for i in range(0, len(text), 200_000):
                    to = i + 200_000
                    yield rows_of(len(text[i:to]), row=row + text[i:to], gram=gram[i:to].view(np.int64), tf=times[i:to])
                docs, rare = [], []
                for doc_id, held_out, text, s in zip(part.column("doc_id").to_pylist(), part.column("held_out").to_pylist(), as_bytes(part.column("text")), scores.tolist()):
                    tokens = text.lower().split()
                    logs_of = [*map(words.get, tokens)]
                    n = len(logs_of)
                    if None in logs_of:
                        others = Counter(w for w, x in zip(tokens, logs_of) if x is None)
                        rare += [(row, w, k) for w, k in others.items()]
                        logs_of = [x for x in logs_of if x is not None]
                    docs.append((row, doc_id, held_out, n + 1, len(logs_of) + (end > 0), sum(logs_of) + end_log, s))
                    row += 1
                yield rows_of(len(docs), **dict(zip(names, zip(*docs))))
                for i in range(0, len(rare), 50_000):
                    r, w, k = zip(*rare[i : i + 50_000])
                    yield rows_of(len(r), row=r, word=w, tf=k)

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_fold: int = 1, order: int = ORDER, frequent: int = FREQUENT, held_grams: int = GRAMS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row for each row of `docs`.

    Learns from rows whose crc32(id as text) mod 5 is not `held_fold`. Words are lower-cased in A-Z and
    part at ASCII white space; every text ends with one end token. base_score is the unigram's log10
    probability with 0.5 added to counts, score the PPM's of the lower-cased bytes and the end. Null
    texts count as empty, null ids as the empty id; repeated rows are learnt and scored each; other
    columns are ignored. Without training rows every symbol is equally likely. An empty table gives no rows.
    Texts are scored whole, a slice of 2 MB or one longer text at a time; the order is the same at every size.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark, "lm")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), (fold_of(id_col) == held_fold).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    parts = written(source.where("not held_out").select("text").mapInArrow(_count(order), "word binary, gram long, n long"), f"{folder}/parts")
    counts = written(parts.where("word is not null").groupBy("word").agg(F.sum("n").alias("c")), f"{folder}/words")
    end = parts.where("word is null and gram is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    kinds, total = counts.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    tokens, unit, denominator = total + end, 0.5, total + end + 0.5 * (kinds + (end > 0) + 1)

    grams = written(parts.where("gram is not null").groupBy("gram").agg(F.sum("n").alias("n")), f"{folder}/grams")
    by_order, contexts = trie(grams, order, folder)
    seen = grams.withColumn("context", F.shiftright("gram", 8)).join(contexts[order], "context")
    seen = written(seen.select("gram", "n", seen_log().alias("log")), f"{folder}/seen")
    held = seen.where(F.col("n") >= _least(seen, "n", held_grams)).select("gram", "log").toArrow()  # `held_grams` rows at most
    keys, logs = held.column("gram").to_numpy().astype(np.uint64), held.column("log").to_numpy().astype(np.float32)
    by = np.argsort(keys)
    common = counts.where(F.col("c") >= _least(counts, "c", frequent)).collect()
    chances, common = spark.sparkContext.broadcast((keys[by], logs[by])), spark.sparkContext.broadcast({bytes(r["word"]): r["c"] for r in common})
    schema = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, word binary, gram long, tf long"
    scored = written(source.mapInArrow(_score(order, chances, common, unit, denominator, end), schema), f"{folder}/scored")
    chances.unpersist()
    common.unpersist()
    words = scored.where("word is not null").select("row", "word", "tf").join(counts, "word", "left")
    log = F.log10((F.coalesce("c", F.lit(0)) + F.lit(unit)) / F.lit(float(denominator)))
    words = words.select("row", (F.col("tf") * log).alias("more"), F.when(F.col("c") > 0, F.col("tf")).otherwise(0).alias("more_known"), F.lit(0.0).alias("more_score"))
    pairs = scored.where("gram is not null").select("row", "gram", "tf")
    new = written(pairs.select("gram").distinct().join(seen, "gram", "left_anti"), f"{folder}/new")
    known = seen.select("gram", "log").unionByName(written(unseen(new, by_order, contexts), f"{folder}/unseen"))
    pairs = pairs.join(known, "gram").select("row", F.lit(0.0).alias("more"), F.lit(0).cast("long").alias("more_known"), (F.col("tf") * F.col("log")).alias("more_score"))
    rare = words.unionByName(pairs).groupBy("row").agg(*(F.sum(x).alias(x) for x in ("more", "more_known", "more_score")))
    out = scored.where("n_tokens is not null").join(rare, "row", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )


def adaptive_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """doc_id, score: log10 probability of each text by a model that starts empty and learns as it reads."""

    def run(batches):
        for batch in batches:
            scores = [Adaptive(order).log10(t.lower()) for t in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
