"""Near duplicates by SetSketch registers, banding, joint likelihood and verification on full sets.

A document's set is that of its distinct 5-word shingles, as 64-bit hashes. Its sketch has M registers:
the minimum over the set of exponential variables, on a scale of base b and truncated, so that sketches
can be merged by the maximum and agree in a register with a probability near the Jaccard similarity.

1. Equal sets (128-bit fingerprint and size) form one class; only classes go on.
2. Registers are banded; classes that agree in a band are candidates. In each bucket all are paired with
   its smallest class (a star), never with each other. Pairs are filtered by size (exact) and by the
   joint maximum likelihood of both sketches, and confirmed on the full sets.
3. Links give components. In a bucket that still holds several, the members outside the largest one meet
   all members, block by block, on their full sets; pairs inside one component are left out, for links could
   not change it. So no candidate pair between components is missed, whatever the size of the bucket, no task
   holds a whole bucket, and what comes out is a link for each two components at most, never pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import joined_bytes, release, shared_dir, slices, written
from .words import LOWER, hash_words, mixed, word_places

WORDS = 5
SIMILARITY = 85  # percent
M, ROWS = 128, 4  # registers, and of a band; a link at 0.85 is missed in one of 1e10 cases, at 0.8 in one of 2e7
LOG_BASE, RATE, TOP = np.log1p(0.001), 20.0, 65_534
SLACK = 0.2  # the likelihood's estimate may be that much below the similarity (5 standard errors and more)
MINOR = MAJOR = 640  # members of a bucket in a block, of either side
PARTNERS = 160  # of a hub in a block: few, for a hub's set is one row more in each
WEIGHT = 1 << 20  # shingles of either side of a block, about (but for a set that has more)
NULL_ID = 1 << 62  # sorts after all ids and stands for a null one

_rng = np.random.default_rng(977)
STEPS = _rng.integers(1, 1 << 62, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FACTORS = _rng.integers(1, 1 << 62, M, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _rng.integers(1, 1 << 62, M, dtype=np.uint64)

SIGNATURE = "doc_id long, row long, n_shingles long, f1 long, f2 long, sketch binary"
SETS = "f1 long, f2 long, set binary"
BLOCK = ["block", "node", "comp", "side", "set"]


def shingles(texts: pa.Array, width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of each text in turn (repeats too), and where each text's end."""
    data, ends = joined_bytes(texts)
    data = LOWER[data]
    starts, stops, before = word_places(data, ends)
    h = hash_words(data, starts, stops)
    words = np.diff(before, prepend=0)
    n = np.where(words >= width, words - width + 1, np.minimum(words, 1))
    last = np.cumsum(n)
    place = np.repeat(before - words, n) + np.arange(int(n.sum())) - np.repeat(last - n, n)
    short = np.repeat(np.where(words < width, words, width), n)
    out = np.zeros(len(place), np.uint64)
    for k in range(width):
        at = place + k
        out += np.where(k < short, h[np.minimum(at, len(h) - 1)] * STEPS[k], np.uint64(0)) if len(h) else 0
    return mixed(out + short.astype(np.uint64)), last


def registers(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """SetSketch registers (uint16) of the sets that begin at `first`."""
    low = np.empty((M, len(first)), np.uint32)
    step = 1 << 18
    cuts = np.searchsorted(first, np.arange(0, len(hashes), step))
    cuts = np.unique(np.r_[cuts, len(first)])
    for a, b in zip(cuts[:-1], cuts[1:]):  # whole sets, so that the working set stays in cache
        part = hashes[first[a] : first[b] if b < len(first) else len(hashes)]
        at = first[a:b] - first[a]
        for i in range(M):
            low[i, a:b] = np.minimum.reduceat(((part * FACTORS[i] + SHIFTS[i]) >> np.uint64(32)).astype(np.uint32), at)
    x = -np.log1p(-(low.T.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(x) / LOG_BASE), 0, TOP + 1).astype(np.uint16)


def likeliest(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard similarities that make the joint registers of pairs likeliest, the set sizes being known."""
    above, below = (a > b).sum(1), (a < b).sum(1)
    equal = M - above - below
    u, v = na / (na + nb), nb / (na + nb)
    best, at = np.full(len(a), -np.inf), np.zeros(len(a))
    base = np.exp(LOG_BASE)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (base - 1) / base) / LOG_BASE
    for j in np.linspace(0, 1, 101):
        plus, minus = p(u - v * j), p(v - u * j)
        possible = (j * v <= u + 1e-12) & (j * u <= v + 1e-12)
        with np.errstate(divide="ignore", invalid="ignore"):
            terms = [np.where(k > 0, k * np.log(np.maximum(q, 1e-300)), 0.0) for k, q in ((above, plus), (below, minus), (equal, 1 - plus - minus))]
        score = np.where(possible, sum(terms), -np.inf)
        up = score > best
        best[up], at[up] = score[up], j
    return at


def _sets(texts):
    """(size, fingerprint, fingerprint, sorted distinct hashes) of each text."""
    h, last = shingles(texts)
    out, a = [], 0
    for b in last.tolist():
        out.append(np.unique(h[a:b]))
        a = b
    return h, last, out


def _prints(own: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    all_of = np.concatenate([*own, np.empty(0, np.uint64)])
    ends = np.cumsum([0, *map(len, own)])
    sums = [np.r_[np.uint64(0), np.cumsum(mixed(all_of + np.uint64(k)))] for k in (0x1234567, 0x89ABCDEF0)]
    return tuple((s[ends[1:]] - s[ends[:-1]]).view(np.int64) for s in sums)


def _sign(batches):
    names = [f.split()[0] for f in SIGNATURE.split(", ")]
    for batch in batches:
        for part in slices(batch, "text", 2 << 20):
            h, last, own = _sets(part.column("text"))
            n = np.array([len(x) for x in own], np.int64)
            f1, f2 = _prints(own)
            full = np.flatnonzero(n > 0)
            sketch = np.empty(len(n), object)
            if len(full):
                first = np.r_[0, last[:-1]][full]
                for i, r in zip(full.tolist(), registers(h, first)):
                    sketch[i] = r.tobytes()
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row"), pa.array(n), pa.array(f1), pa.array(f2), pa.array(list(sketch), pa.binary())], names=names)


def _full_sets(batches):
    for batch in batches:
        for part in slices(batch, "text", 2 << 20):
            _, _, own = _sets(part.column("text"))
            f1, f2 = _prints(own)
            yield pa.RecordBatch.from_arrays([pa.array(f1), pa.array(f2), pa.array([x.tobytes() for x in own], pa.binary())], names=["f1", "f2", "set"])


def _sketches(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, M)


def _likely(similarity: int):
    """Pairs with both sketches: those that can be links."""

    def run(batches):
        for b in batches:
            na, nb = (b.column(k).to_numpy().astype(float) for k in ("na", "nb"))
            keep = np.flatnonzero(100 * np.minimum(na, nb) >= similarity * np.maximum(na, nb))
            if len(keep):
                x, y = (_sketches(b.column(k).take(pa.array(keep))) for k in ("sa", "sb"))
                keep = keep[likeliest(x, y, na[keep], nb[keep]) >= similarity / 100 - SLACK]
            if len(keep):
                yield pa.RecordBatch.from_arrays([b.column(k).take(pa.array(keep)) for k in ("a", "b", "nb")], names=["a", "b", "nb"])

    return run


def _blocks(similarity: int):
    """Over rows sorted by `block`: links between members on side 0 and on side 1, confirmed on full sets.
    A link is told only where it joins two components, so a block tells fewer links than it has members."""

    def compare(rows):
        side = [[r for r in rows if r[3] == s] for s in (0, 1)]
        if not all(side):
            return []
        node, comp = ([[r[k] for r in s] for s in side] for k in (1, 2))
        comp = [np.array(c, np.int64) for c in comp]
        sets = [[np.frombuffer(r[4], np.uint64) for r in s] for s in side]
        sizes = [np.array([*map(len, s)]) for s in sets]
        _, flat = np.unique(np.concatenate([*sets[0], *sets[1]]), return_inverse=True)
        flat = flat.astype(np.int32)
        first = np.cumsum(np.r_[0, sizes[0]])
        chunk, start = flat[first[-1] :], np.cumsum(np.r_[0, sizes[1][:-1]])
        mark, found = np.zeros(int(flat.max()) + 1, np.int32), []
        for i in range(len(node[0])):
            n, m = sizes[0][i], sizes[1]
            may = (comp[1] != comp[0][i]) & (100 * np.minimum(n, m) >= similarity * np.maximum(n, m))
            if not may.any():
                continue
            own = flat[first[i] : first[i + 1]]
            mark[own] = 1
            common = np.add.reduceat(mark[chunk], start)
            mark[own] = 0
            for j in np.flatnonzero(may & (100 * common >= similarity * (n + m - common))).tolist():
                old, new = comp[1][j], comp[0][i]
                if old != new:
                    found.append((node[0][i], node[1][j]))
                    for c in comp:
                        c[c == old] = new
        return found

    def run(batches):
        own: list = []

        def told():
            found = compare(own)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])
            own.clear()

        for batch in batches:
            for b in slices(batch, "set"):
                for r in zip(*(b.column(k).to_pylist() for k in BLOCK)):
                    if own and own[0][0] != r[0]:
                        yield from told()
                    own.append(r)
        yield from told()

    return run


def components(nodes: DataFrame, links: DataFrame, folder: str) -> DataFrame:
    """(node, comp): the smallest node reachable by links (a, b). Labels fall along links, then through
    the labels themselves, so rounds grow with the logarithm of a component's width. Each round is
    written; minima are combined before the shuffle, so a hub is no hot key."""
    spark = nodes.sparkSession
    both = written(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(), f"{folder}/links")
    linked = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("comp")).withColumnRenamed("a", "node"), f"{folder}/labels-0")
    step = 0
    while True:
        step += 1
        near = both.join(linked.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        # the label's own label: a label is a node with links, so it has one
        jump = linked.join(linked.select(F.col("node").alias("comp"), F.col("comp").alias("far")), "comp").select("node", "comp", "far")
        now = jump.join(near, "node").select("node", F.least("comp", "far", "near").alias("comp"), (F.least("far", "near") < F.col("comp")).alias("moved"))
        now = written(now, f"{folder}/labels-{step}")
        moved = now.where("moved").limit(1).count()
        linked = now.select("node", "comp")
        if not moved:
            break
    return nodes.join(linked, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: int = SIMILARITY, row_col: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of `docs`.

    Texts are lower-cased in A-Z and split at ASCII white space; two link when
    100 * |intersection| >= similarity * |union| of their shingle sets. A text of fewer than five words
    has one shingle of all its words; one without words, or null, has none and links with nothing.
    component_id is the smallest id reachable, kept is whether that is the row's own. Null ids come
    last: component_id is null where no other id is reachable, and such rows are kept. Repeated rows of
    an id are alike. Other columns are ignored; an empty table gives no rows. With `row_col` (a unique
    long) come `row` and `stays`, true for exactly one row of each component, that of the smallest id,
    then row, and for all rows without words.
    """
    spark = docs.sparkSession
    keep = shared_dir(spark, "near-dedup")
    folder = f"{keep}/work"
    row = (F.col(row_col) if row_col else F.lit(None)).cast("long")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), row.alias("row"), F.col(text_col).cast("string").alias("text"))
    signed = written(source.mapInArrow(_sign, SIGNATURE), f"{keep}/signatures")
    classes = signed.where("n_shingles > 0").groupBy("f1", "f2").agg(F.min(F.coalesce("doc_id", F.lit(NULL_ID))).alias("rep"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("node"), "*"), f"{folder}/classes")

    key = lambda i: F.substring("sketch", i * 2 * ROWS + 1, 2 * ROWS)
    banded = classes.select("node", "n", F.posexplode(F.array(*(key(i) for i in range(M // ROWS)))).alias("band", "key"))
    buckets = written(banded.groupBy("band", "key").agg(F.min("node").alias("least"), F.count("*").alias("size")).where("size > 1"), f"{folder}/buckets")
    members = written(banded.join(buckets, ["band", "key"]), f"{folder}/members")
    star = members.where("node != least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    side = lambda s: classes.select(F.col("node").alias(s), F.col("n").alias(f"n{s}"), F.col("sketch").alias(f"s{s}"))
    likely = written(star.join(side("a"), "a").join(side("b"), "b").mapInArrow(_likely(similarity), "a long, b long, nb long"), f"{folder}/likely-0")
    links = _links(source, classes, likely, similarity, f"{folder}/links-0")
    nodes = classes.select("node")
    comps = written(components(nodes, links, f"{folder}/first"), f"{folder}/components-0")

    # buckets that hold several components yet, without their smallest class, which met all others
    known = members.where("node != least").select("band", "key", "node", "n").join(comps, "node")
    parts = known.groupBy("band", "key", "comp").agg(F.count("*").alias("own"), F.sum("n").alias("weight"))
    mixed_up = parts.groupBy("band", "key").agg(F.count("*").alias("k"), F.sum("own").alias("size"), F.sum("weight").alias("weight"), F.max(F.struct("own", "comp", "weight")).alias("major")).where("k > 1")
    minor = [F.col(x) - F.col(f"major.{y}") for x, y in (("size", "own"), ("weight", "weight"))]
    mixed_up = mixed_up.select("band", "key", F.col("major.comp").alias("major"), _shares(*minor, MINOR).alias("blocks"), _shares(F.col("size"), F.col("weight"), MAJOR).alias("chunks"))
    rest = written(known.join(mixed_up, ["band", "key"]), f"{folder}/rest")
    if rest.limit(1).count():
        sets = _class_sets(source, classes, rest.select("node").distinct(), f"{folder}/rest-sets")
        spot = lambda col, seed: F.pmod(F.xxhash64(F.lit(seed), "node"), F.col(col)).cast("int")
        pair = lambda block, chunk: F.struct(block.alias("b"), chunk.alias("c"))
        every = lambda col: F.sequence(F.lit(0), F.col(col) - 1)
        minor = rest.where("comp != major").withColumn("bc", F.explode(F.transform(every("chunks"), lambda c: pair(spot("blocks", 1), c)))).withColumn("side", F.lit(0))
        major = rest.withColumn("bc", F.explode(F.transform(every("blocks"), lambda b: pair(b, spot("chunks", 2))))).withColumn("side", F.lit(1))
        dealt = minor.unionByName(major).select(F.struct("band", "key", "bc").alias("block"), "node", "comp", "side")
        more = _confirmed(dealt, sets, similarity, f"{folder}/links-1")
        comps = written(components(nodes, links.unionByName(more), f"{folder}/second"), f"{folder}/components-1")

    # what is aggregated by a component is written before it is joined: the planner can then split a hot one
    labelled = classes.select("node", "rep", "f1", "f2").join(comps, "node")
    least = written(labelled.groupBy("comp").agg(F.min("rep").alias("component")), f"{folder}/least")
    labelled = written(labelled.join(least, "comp").select("f1", "f2", "component", "comp"), f"{keep}/classes")
    release(spark, folder)
    whole = signed.select("doc_id", "row", "n_shingles", "f1", "f2").join(labelled, ["f1", "f2"], "left")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.when(F.col("component") < NULL_ID, F.col("component")))
    out = whole.select("doc_id", "n_shingles", own.alias("component_id"), "row", "comp").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    if not row_col:
        return out.drop("row", "comp")
    best = out.where("comp is not null").groupBy("comp").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(NULL_ID)), "row")).alias("best"))
    best = written(best, f"{keep}/best")
    out = out.join(best.select("comp", F.col("best.row").alias("best")), "comp", "left")
    return out.withColumn("stays", (F.col("n_shingles") == 0) | (F.col("row") == F.col("best"))).drop("comp", "best")


def _class_sets(source: DataFrame, classes: DataFrame, wanted: DataFrame, path: str) -> DataFrame:
    """(node, set) of the classes in `wanted`. Sets are made again, from the texts of these classes alone:
    of the rows with the classes' smallest ids, and of all rows without an id where a class has none."""
    wanted = written(classes.select("node", "rep", "f1", "f2").join(wanted, "node"), f"{path}-wanted")
    texts = source.join(wanted.where(F.col("rep") < NULL_ID).select("rep").distinct(), source["doc_id"] == F.col("rep"), "left_semi")
    if wanted.where(F.col("rep") == NULL_ID).limit(1).count():
        texts = texts.unionByName(source.where("doc_id is null"))  # not joined: they would all share one key
    sets = texts.mapInArrow(_full_sets, SETS).dropDuplicates(["f1", "f2"])  # partial first, so that equal texts are one row of a task
    return written(sets.join(wanted.select("node", "f1", "f2"), ["f1", "f2"]).select("node", "set"), path)


def _shares(size, weight, most: int):
    """Into how many parts so many sets with so many shingles are dealt."""
    return F.greatest(F.ceil(size / most), F.ceil(weight / WEIGHT)).cast("int")


def _confirmed(dealt: DataFrame, sets: DataFrame, similarity: int, path: str) -> DataFrame:
    """(a, b): links within the blocks of (block, node, comp, side), told on full sets (node, set)."""
    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    full = dealt.join(sets, "node").repartition(n, "block").sortWithinPartitions("block")
    return written(full.select(BLOCK).mapInArrow(_blocks(similarity), "a long, b long"), path)


def _links(source: DataFrame, classes: DataFrame, pairs: DataFrame, similarity: int, path: str) -> DataFrame:
    """The pairs (a, b) that full sets confirm, but for those between two nodes that others of a block
    connect. A hub `a` meets its partners in blocks, with its set once in each."""
    sets = _class_sets(source, classes, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), f"{path}-sets")
    hubs = pairs.groupBy("a").agg(F.count("*").alias("size"), F.sum("nb").alias("weight"))
    hubs = written(hubs.select("a", _shares(F.col("size"), F.col("weight"), PARTNERS).alias("chunks")), f"{path}-hubs")
    block = lambda chunk: F.struct("a", chunk.alias("chunk")).alias("block")
    one = hubs.select("a", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("c")).select(block(F.col("c")), F.col("a").alias("node"), F.lit(0).alias("side"))
    other = pairs.join(hubs, "a").select(block(F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int")), F.col("b").alias("node"), F.lit(1).alias("side"))
    dealt = one.unionByName(other).withColumn("comp", F.col("node"))
    return _confirmed(dealt, sets, similarity, path)
