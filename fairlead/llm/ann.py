"""Approximate nearest neighbours by inner product: NN-descent graph, greedy graph search.

For the graph, vectors are scaled by the largest norm and get a component that makes all norms equal, which
turns the largest inner product into the nearest neighbour; they are rounded to bytes. A node is a rounded
vector: whatever rounds alike is found together and told apart by exact products at last.

NN-descent starts from neighbours within blocks of a few random-projection orders, and then joins neighbours
of neighbours: each node's neighbours, both ways, meet at it in pairs, and pairs that better one side's worst
neighbour are handed to that side, combined before the shuffle. A pair of two old edges is spared. Reverse
neighbours are sampled, as the method has it; a hub's are limited before the shuffle. The descent ends when a
round brings few new edges.

The graph, both ways, is written in shards of a bounded size, of nodes that lie near each other. Queries walk
it greedily: the task that holds a query's candidates of a shard expands the nearest nodes there until the
nearest `beam` are expanded, and hands on what their edges lead to in other shards; so a walk is a few rounds
however far it goes, and a task holds one shard. What was found is ranked by exact inner products at last.

Rounded vectors reach the descent by a broadcast while they are known to be few, else by joins. The beam grows
with the logarithm of the number of nodes.
"""

from __future__ import annotations

import io
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import filesystem, shared_dir, written

NEIGHBOURS = 32  # of a node in the graph
REVERSE = 32  # reverse neighbours that take part in a join and in the search
OFFERS = 5  # partners that one join offers to a node at most
TABLES, BLOCK = 4, 256  # random-projection orders for the start, nodes of a block
ENOUGH = 0.01  # share of new edges below which the descent ends
BEAM, EXPAND, POOL = 20, 32, 1.5  # nearest nodes that are expanded, for each doubling of the nodes; at once; found ones kept, of the beam
BROADCAST = 64 << 20  # bytes of rounded vectors up to which they are broadcast
SHARD = 64 << 20  # bytes of graph and rounded vectors that a searching task holds
OFFERED = 400_000  # offers that a task combines before it hands them on
CHUNK = 512  # vectors of a node, or of a query's node, that are ranked together


def valid_rows(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))


def _rounded(top: float, peak: float):
    def run(batches):
        for b in batches:
            if b.num_rows:
                v = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) / top
                x = np.column_stack([v, np.sqrt(np.maximum(0.0, 1 - (v * v).sum(1)))])
                q = np.clip(np.rint(x * (127 / max(peak, 1e-12))), -127, 127).astype(np.int8)
                yield pa.RecordBatch.from_arrays([b.column("vid"), pa.array([r.tobytes() for r in q], pa.binary())], names=["vid", "vec"])

    return run


def _projected(seed: int):
    """Each table's place of a node in a random-projection order."""

    def run(batches):
        planes = None
        for b in batches:
            if not b.num_rows:
                continue
            x = _vectors(b.column("vec"))
            if planes is None:
                planes = np.random.default_rng(seed).standard_normal((TABLES, 14, x.shape[1]))
            codes = ((np.einsum("tkd,nd->ntk", planes, x) > 0) * (1 << np.arange(14))).sum(2)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * TABLES, pa.int32()), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("vec"), lists], names=["vec", "codes"])

    return run


def _vectors(column) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.int8).reshape(len(rows), -1).astype(np.float32)


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column, one row's after another's, and their number in each row."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(values))


def _ranked(node: np.ndarray, nbr: np.ndarray, score: np.ndarray, old: np.ndarray, k: int) -> tuple:
    """Of each node, in order, the k best different neighbours (an old edge before its new repeat); first
    the places of these edges, then where nodes begin among them."""
    o = np.lexsort((~old, nbr, node))
    o = o[np.r_[True, (node[o][1:] != node[o][:-1]) | (nbr[o][1:] != nbr[o][:-1])]]
    o = o[np.lexsort((nbr[o], -score[o], node[o]))]
    turn = np.flatnonzero(np.r_[True, node[o][1:] != node[o][:-1]])
    o = o[np.arange(len(o)) - np.repeat(turn, np.diff(np.r_[turn, len(o)])) < k]
    return o, np.flatnonzero(np.r_[True, node[o][1:] != node[o][:-1]])


OFFER = "node long, nbrs array<long>, scores array<float>"
GRAPH = OFFER + ", fresh array<boolean>, worst float"


def _offers(pairs, k: int):
    """Rows of OFFER from (node, nbr, score) arrays, many at once: each node's k best."""
    held, size = [], 0

    def out():
        node, nbr, score = (np.concatenate(c) for c in zip(*held))
        o, turn = _ranked(node, nbr, score, np.zeros(len(node), bool), k)
        sizes = np.diff(np.r_[turn, len(o)])
        for i in range(0, len(turn), 50_000):
            part = slice(turn[i], turn[i + 50_000] if i + 50_000 < len(turn) else len(o))
            own = sizes[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(node[o][turn[i : i + 50_000]]), _lists(nbr[o][part], own), _lists(score[o][part], own)], names=["node", "nbrs", "scores"])

    for x in pairs:
        if len(x[0]):
            held.append(x)
            size += len(x[0])
        if size > OFFERED:
            yield from out()
            held, size = [], 0
    if held:
        yield from out()


def _block_neighbours(k: int):
    """Over partitions in order: the nearest nodes within each block of rows."""

    def block(node, x):
        s = x @ x.T
        np.fill_diagonal(s, -np.inf)
        m = min(k, len(node) - 1)
        at = np.argpartition(-s, m - 1, axis=1)[:, :m]
        return np.repeat(node, m), node[at].ravel(), s[np.arange(len(node))[:, None], at].ravel()

    def blocks(batches):
        nodes, vecs = np.empty(0, np.int64), None
        for b in batches:
            if not b.num_rows:
                continue
            nodes, own = np.r_[nodes, b.column("node").to_numpy()], _vectors(b.column("vec"))
            vecs = own if vecs is None else np.concatenate([vecs, own])
            while len(nodes) >= 2 * BLOCK:
                yield block(nodes[:BLOCK], vecs[:BLOCK])
                nodes, vecs = nodes[BLOCK:], vecs[BLOCK:]
        if len(nodes) > 1:
            yield block(nodes, vecs)

    return lambda batches: _offers(blocks(batches), k)


def _whole_groups(batches, key: str, columns: list[str]):
    """Column arrays of whole groups of rows with one key, from batches in the key's order."""
    held: list = []
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], side="left")) if keys[0] != keys[-1] else 0
        if cut:
            held.append(b.slice(0, cut))
            whole = pa.Table.from_batches(held)
            yield [whole.column(c) for c in columns]
            held = [b.slice(cut)]
        else:
            if held and held[-1].column(key)[-1].as_py() != keys[0]:
                whole = pa.Table.from_batches(held)
                yield [whole.column(c) for c in columns]
                held = []
            held.append(b)
    if held:
        whole = pa.Table.from_batches(held)
        yield [whole.column(c) for c in columns]


def _local_join(k: int, known):
    """Offers from pairs of each node's neighbours that better one side's worst neighbour. Rows of (center,
    items, fresh), in order of the center; `known` has the broadcast nodes, their worst scores and vectors, or is
    None where rows have these of each item."""

    def join(group, place, shape, item, fresh, worst, x):
        ids = np.full(shape, -1, np.int64)
        new, least, v = np.zeros(shape, bool), np.full(shape, np.inf, np.float32), np.zeros((*shape, x.shape[1]), np.float32)
        ids[group, place], new[group, place], least[group, place], v[group, place] = item, fresh, worst, x
        s = v @ v.transpose(0, 2, 1)
        s[~(new[:, :, None] | new[:, None, :]) | (ids[:, :, None] == ids[:, None, :]) | (ids[:, None, :] < 0) | (s <= least[:, :, None])] = -np.inf
        m = min(OFFERS, shape[1])
        at = np.argpartition(-s, m - 1, axis=2)[:, :, :m]
        best = np.take_along_axis(s, at, 2)
        partner = np.take_along_axis(np.broadcast_to(ids[:, None, :], s.shape), at, 2)
        ok = best > -np.inf
        return np.broadcast_to(ids[:, :, None], ok.shape)[ok], partner[ok], best[ok]

    def pairs(batches):
        columns = ["center", "items", "fresh"] + (["worst", "vec"] if known is None else [])
        for center, items, fresh, *more in _whole_groups(batches, "center", columns):
            item, sizes = _flat(items)
            center, fresh = np.repeat(center.to_numpy(), sizes), _flat(fresh)[0].astype(bool)
            if known is None:
                worst, x = more[0].to_numpy(), _vectors(more[1])
            else:
                nodes, lows, codes = known.value
                at = np.searchsorted(nodes, item)
                worst, x = lows[at], codes[at]
            some = np.zeros(len(center), bool)  # rows of centers with a new edge: others have nothing to tell
            turn = np.flatnonzero(np.r_[True, center[1:] != center[:-1]])
            sizes = np.diff(np.r_[turn, len(center)])
            some = np.repeat(np.logical_or.reduceat(fresh, turn), sizes)
            center, item, fresh, worst, x = center[some], item[some], fresh[some], worst[some], x[some]
            if not len(center):
                continue
            turn = np.flatnonzero(np.r_[True, center[1:] != center[:-1]])
            sizes = np.diff(np.r_[turn, len(center)])
            group, place = np.repeat(np.arange(len(turn)), sizes), np.arange(len(center)) - np.repeat(turn, sizes)
            for lo in range(0, len(turn), 64):
                hi = min(lo + 64, len(turn))
                r = slice(turn[lo], turn[hi] if hi < len(turn) else len(center))
                yield join(group[r] - lo, place[r], (hi - lo, int(sizes[lo:hi].max())), item[r], fresh[r], worst[r], x[r].astype(np.float32))

    return lambda batches: _offers(pairs(batches), k)


def _merge(k: int):
    """Rows of GRAPH from rows (node, nbrs, scores, old), in order of the node. `fresh` are edges that were not
    there before, `worst` is the score to better."""

    def run(batches):
        for node, nbrs, scores, old in _whole_groups(batches, "node", ["node", "nbrs", "scores", "old"]):
            nbr, sizes = _flat(nbrs)
            node, old, score = np.repeat(node.to_numpy(), sizes), np.repeat(old.to_numpy(), sizes), _flat(scores)[0]
            o, turn = _ranked(node, nbr, score, old, k)
            sizes = np.diff(np.r_[turn, len(o)])
            worst = np.where(sizes == k, score[o][np.r_[turn[1:], len(o)] - 1], -np.inf).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(node[o][turn]), _lists(nbr[o], sizes), _lists(score[o], sizes), _lists(~old[o], sizes), pa.array(worst)], names=["node", "nbrs", "scores", "fresh", "worst"])

    return run


def both_ways(graph: DataFrame, seed: int) -> DataFrame:
    """(center, items, fresh): a node's neighbours in one row, and in a row each up to REVERSE nodes of which
    it is a neighbour, new edges first, else by chance."""
    flat = graph.select("node", F.explode(F.arrays_zip("nbrs", "fresh")).alias("e")).select(F.col("e.nbrs").alias("center"), "node", F.col("e.fresh").alias("new"))
    chance = F.xxhash64("node", "center", F.lit(seed))
    back = flat.withColumn("place", F.row_number().over(Window.partitionBy("center").orderBy(F.desc("new"), chance, "node"))).where(F.col("place") <= REVERSE)
    back = back.select("center", F.array("node").alias("items"), F.array("new").alias("fresh"))
    return graph.select(F.col("node").alias("center"), F.col("nbrs").alias("items"), "fresh").unionByName(back)


def build_graph(nodes: DataFrame, folder: str, count: int, width: int, k: int = NEIGHBOURS, seed: int = 11) -> DataFrame:
    """GRAPH rows: each node's k nearest, as far as the descent found them. `nodes` has node, vec (`width`
    bytes) and codes."""
    spark = nodes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    small = count * (width + 8) <= BROADCAST

    def merged(edges: DataFrame, name: str) -> DataFrame:
        dealt = edges.repartition(parts, "node").sortWithinPartitions("node")
        return written(dealt.mapInArrow(_merge(k), GRAPH), f"{folder}/{name}")

    tables = nodes.select("node", "vec", F.posexplode("codes").alias("table", "code")).withColumn("salt", F.xxhash64("node", F.lit(seed)))
    start = tables.repartitionByRange(parts, "table", "code", "salt").sortWithinPartitions("table", "code", "salt").select("node", "vec")
    graph = merged(start.mapInArrow(_block_neighbours(k), OFFER).withColumn("old", F.lit(False)), "graph-0")
    step = 0
    while True:
        step += 1
        edges, known = both_ways(graph, seed + step), None
        if small:
            held = nodes.select("node", "vec").join(graph.select("node", "worst"), "node").toArrow()  # bounded by BROADCAST
            by = np.argsort(held.column("node").to_numpy())
            codes = np.frombuffer(b"".join(held.column("vec").to_pylist()), np.int8).reshape(-1, width)
            known = spark.sparkContext.broadcast((held.column("node").to_numpy()[by], held.column("worst").to_numpy()[by], codes[by]))
            rows = edges.repartition(parts, "center").sortWithinPartitions("center")
        else:
            state = written(nodes.select(F.col("node").alias("item"), "vec").join(graph.select(F.col("node").alias("item"), "worst"), "item"), f"{folder}/state-{step}")
            flat = edges.select("center", F.explode(F.arrays_zip("items", "fresh")).alias("e")).select("center", F.col("e.items").alias("item"), F.col("e.fresh").alias("new"))
            rows = flat.join(state, "item").select("center", F.array("item").alias("items"), F.array("new").alias("fresh"), "worst", "vec")
            rows = rows.repartition(parts, "center").sortWithinPartitions("center")
        offers = rows.mapInArrow(_local_join(k, known), OFFER).withColumn("old", F.lit(False))
        graph = merged(graph.select("node", "nbrs", "scores", F.lit(True).alias("old")).unionByName(offers), f"graph-{step}")
        if known is not None:
            known.unpersist()
        fresh = graph.agg(F.sum(F.size(F.filter("fresh", lambda x: x)))).first()[0] or 0
        if fresh <= ENOUGH * k * count:
            return graph


def _shards(folder: str):
    """Over rows (node, links, vec) in order of the node, whole shards in a task: a file of each, and its name."""

    def run(batches):
        fs, path = filesystem(folder)
        held: list = []

        def out():
            table = pa.Table.from_batches(held)
            node = table.column("node").to_numpy()
            links, sizes = _flat(table.column("links"))
            file, codes = io.BytesIO(), np.frombuffer(b"".join(table.column("vec").to_pylist()), np.int8)
            np.savez(file, node=node, first=np.r_[0, np.cumsum(sizes)], links=links, codes=codes.reshape(len(node), -1))
            name = uuid.uuid4().hex
            fs.create_dir(path, recursive=True)
            with fs.open_output_stream(f"{path}/{name}", compression=None) as f:
                f.write(file.getbuffer())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([int(node[0]) >> 33]), pa.array([name])], names=["shard", "name"])

        for b in batches:
            shard = b.column("node").to_numpy() >> 33
            turns = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]).tolist() if len(shard) else []
            for lo, hi in zip(turns, [*turns[1:], len(shard)]):
                if held and held[-1].column("node")[0].as_py() >> 33 != shard[lo]:
                    yield out()
                held.append(b.slice(lo, hi - lo))
        if held:
            yield out()

    return run


class Shard:
    """Nodes that lie near each other, with their links and rounded vectors."""

    def __init__(self, data: dict):
        self.node, self.first, self.links, self.codes = data["node"], data["first"], data["links"], data["codes"]
        self.inner = np.minimum(np.searchsorted(self.node, self.links), len(self.node) - 1)
        self.inner[self.node[self.inner] != self.links] = -1

    def walk(self, q: np.ndarray, start: np.ndarray, known: np.ndarray, least: float, beam: int, pool: int):
        """Nodes found, nearest first, with scores, and what the expanded ones lead to in other shards. `known`
        nodes were expanded before; what is no better than `least` is found but not expanded."""
        seen = np.zeros(len(self.node), bool)
        seen[np.searchsorted(self.node, known)] = True
        ids, scores, done, far = np.empty(0, np.int64), np.empty(0, np.float32), np.empty(0, bool), []
        at = np.searchsorted(self.node, start)
        while True:
            at = at[~seen[at]]
            seen[at] = True
            # without the component that evens the norms, this is the inner product itself
            ids, done = np.r_[ids, at], np.r_[done, np.zeros(len(at), bool)]
            scores = np.r_[scores, self.codes[at, :-1].astype(np.float32) @ q]
            o = np.argsort(-scores, kind="stable")[:pool]
            ids, scores, done = ids[o], scores[o], done[o]
            front = np.flatnonzero(~done[:beam] & (scores[:beam] > least))[:EXPAND]
            if not len(front):
                return self.node[ids], scores, np.unique(np.concatenate([*far, np.empty(0, np.int64)]))
            done[front] = True
            a, n = self.first[ids[front]], self.first[ids[front] + 1] - self.first[ids[front]]
            edge = np.repeat(a - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(int(n.sum()))
            inner = self.inner[edge]
            far.append(self.links[edge[inner < 0]])
            at = np.unique(inner[inner >= 0])


FOUND = "q long, qvec binary, ids array<long>, scores array<float>, cands array<long>"


def _walks(folder: str, names: dict, beam: int, pool: int):
    """Over rows (shard, q, qvec, cands, known, least), sorted by shard: what each walk found."""

    def run(batches):
        fs, path = filesystem(folder)
        now, shard = None, None
        for b in batches:
            rows = []
            for s, q, qvec, cands, known, least in zip(*(b.column(k).to_pylist() for k in ("shard", "q", "qvec", "cands", "known", "least"))):
                if s != now:
                    with fs.open_input_file(f"{path}/{names[s]}") as f:
                        now, shard = s, Shard(dict(np.load(io.BytesIO(f.read()))))
                vec = np.frombuffer(qvec, np.int8)[:-1].astype(np.float32)
                rows.append((q, qvec, *shard.walk(vec, np.array(cands, np.int64), np.array(known, np.int64), least, beam, pool)))
            if rows:
                q, qvec, ids, scores, far = zip(*rows)
                lists = lambda own, t: _lists(np.concatenate([*own, np.empty(0, t)]).astype(t), np.array([*map(len, own)]))
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(qvec, pa.binary()), lists(ids, np.int64), lists(scores, np.float32), lists(far, np.int64)], names=["q", "qvec", "ids", "scores", "cands"])

    return run


def search(starts: DataFrame, graph: DataFrame, nodes: DataFrame, folder: str, beam: int) -> DataFrame:
    """(q, ids): the nodes that each query's walk from `starts` (q, qvec, cands) found."""
    spark = nodes.sparkSession
    parts, pool = int(spark.conf.get("spark.sql.shuffle.partitions")), int(beam * POOL)
    links = both_ways(graph, 0).groupBy(F.col("center").alias("node")).agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("links"))
    rows = nodes.select("node", "vec").join(links, "node", "left").select("node", F.coalesce("links", F.array().cast("array<long>")).alias("links"), "vec", F.shiftright("node", 33).alias("shard"))
    files = written(rows.repartition(parts, "shard").sortWithinPartitions("node").select("node", "links", "vec").mapInArrow(_shards(f"{folder}/shards"), "shard long, name string"), f"{folder}/names")
    names = {r["shard"]: r["name"] for r in files.collect()}  # a row for SHARD bytes of graph
    state = starts.select("q", "qvec", F.array().cast("array<long>").alias("ids"), F.array().cast("array<float>").alias("scores"), "cands")
    step = 0
    while True:
        state = written(state, f"{folder}/walk-{step}")
        open_ = state.where(F.size("cands") > 0)
        if not open_.limit(1).count():
            return state.select("q", "ids")
        step += 1
        shards = F.explode(F.array_distinct(F.transform("cands", lambda x: F.shiftright(x, 33)))).alias("shard")
        here = lambda c: F.filter(c, lambda x: F.shiftright(x, 33) == F.col("shard")).alias("known" if c == "ids" else c)
        least = F.coalesce(F.get("scores", F.lit(beam - 1)), F.lit(float("-inf"))).cast("float").alias("least")
        asked = open_.select("*", shards).select("shard", "q", "qvec", here("cands"), here("ids"), least)
        # a shard that most queries start from is many tasks' work; each reads its file
        salt = F.pmod(F.xxhash64("q"), F.lit(parts)).cast("int")
        asked = asked.repartition(parts, "shard", salt).sortWithinPartitions("shard", "q")
        found = asked.mapInArrow(_walks(f"{folder}/shards", names, beam, pool), FOUND)
        zipped = lambda d: d.select("q", "qvec", F.arrays_zip("scores", "ids").alias("own"), "cands")
        both = zipped(state.withColumn("cands", F.array().cast("array<long>"))).unionByName(zipped(found))
        both = both.groupBy("q").agg(F.first("qvec").alias("qvec"), F.flatten(F.collect_list("own")).alias("own"), F.flatten(F.collect_list("cands")).alias("cands"))
        best = F.slice(F.array_sort("own", lambda a, b: F.when(a["scores"] != b["scores"], F.when(a["scores"] > b["scores"], -1).otherwise(1)).when(a["ids"] < b["ids"], -1).when(a["ids"] > b["ids"], 1).otherwise(0)), 1, pool)
        both = both.withColumn("own", best).select("q", "qvec", F.col("own.ids").alias("ids"), F.col("own.scores").alias("scores"), "cands")
        state = both.withColumn("cands", F.array_except(F.array_distinct("cands"), "ids"))


def _rank(k: int):
    """Over rows (q, qc, kind, vids, least, vecs) sorted by the first three: each query vector's k + 1 best
    vectors by exact products, ties by the smallest id of their rows. Kind 0 has the query vectors of a group,
    the others vectors that their walk found; no more than some thousands of these are held."""

    def run(batches):
        now, qvids, qv, best, held, size = None, None, None, None, [], 0

        def settle():
            nonlocal best, held, size
            vid, least, v = (np.concatenate(c) for c in zip(*held))
            v = v.reshape(len(vid), -1)
            wide = lambda x: np.broadcast_to(x, (len(qvids), len(x)))
            new = (np.einsum("qd,md->qm", qv, v), wide(least), wide(vid))
            both = new if best is None else [np.concatenate(x, 1) for x in zip(best, new)]
            o = np.lexsort((both[1], -both[0]), axis=1)[:, : k + 1]
            best, held, size = [np.take_along_axis(x, o, 1) for x in both], [], 0

        def told():
            if held:
                settle()
            n = np.full(len(qvids), best[0].shape[1])
            return pa.RecordBatch.from_arrays([pa.array(qvids), _lists(best[2].ravel(), n), _lists(best[0].ravel(), n)], names=["qvid", "near", "scores"])

        for b in batches:
            (vids, n), (least, _), (vecs, m) = (_flat(b.column(c)) for c in ("vids", "least", "vecs"))
            at, to = np.r_[0, np.cumsum(n)], np.r_[0, np.cumsum(m)]
            keys = zip(b.column("q").to_pylist(), b.column("qc").to_pylist(), b.column("kind").to_pylist())
            for i, (q, qc, kind) in enumerate(keys):
                if (q, qc) != now:
                    if now is not None:
                        yield told()
                    now, best = (q, qc), None
                own, v = vids[at[i] : at[i + 1]], vecs[to[i] : to[i + 1]]
                if kind == 0:
                    qvids, qv = own, v.reshape(len(own), -1)
                    continue
                held.append((own, least[at[i] : at[i + 1]], v))
                size += len(own)
                if size >= 4096:
                    settle()
        if now is not None:
            yield told()

    return run


def _chunked(vectors: DataFrame, key: str, chunk: str) -> DataFrame:
    """(key, chunk, vids, least, vecs): the vectors (key, vid, least, v) of a key, about CHUNK together."""
    chunks = vectors.groupBy(key).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    dealt = vectors.join(chunks, key).withColumn(chunk, F.pmod(F.xxhash64("vid"), F.col("chunks")).cast("int"))
    own = dealt.groupBy(key, chunk).agg(F.collect_list(F.struct("vid", "least", "v")).alias("x"))
    return own.select(key, chunk, F.col("x.vid").alias("vids"), F.col("x.least").alias("least"), F.flatten("x.v").alias("vecs"))


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", neighbours: int = NEIGHBOURS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id is divisible by `every`.

    Score is the inner product of the original vectors in double precision; ties go to the smaller id.
    Every row is indexed. Rows with a null id, a null or empty vector, null or non-finite components or
    zeros alone take no part. Vectors of one length are candidates for each other: there is no product with
    those of another length, which are searched by themselves. Of rows with one id, each is a candidate for
    the others. Other columns are ignored; with fewer rows all are found; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    folder = shared_dir(spark, "ann")
    rows = valid_rows(vectors, id_col, vec_col).select("*", F.size("v").alias("width"), F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"), F.monotonically_increasing_id().alias("row"))
    rows = written(rows, f"{folder}/rows")
    widths = [r["width"] for r in rows.select("width").distinct().orderBy("width").collect()]
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for width in widths:
        found = _of_width(rows.where(F.col("width") == width).drop("width"), width, f"{folder}/{width}", k, every, neighbours)
        out = found if width == widths[0] else out.unionByName(found)
    return out


def _of_width(rows: DataFrame, width: int, folder: str, k: int, every: int, neighbours: int) -> DataFrame:
    """`nearest` of rows (vec_id, v, h1, h2, row) whose vectors have one length."""
    # equal vectors are one; of its ids, those that can be in a result stay
    order = Window.partitionBy("h1", "h2").orderBy("vec_id", "row")
    kept = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    vectors = kept.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.sort_array(F.collect_list(F.struct("vec_id", "row"))).alias("own"))
    vectors = written(vectors.select(F.monotonically_increasing_id().alias("vid"), "*"), f"{folder}/vectors")
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    top, low = vectors.agg(F.sqrt(F.max(norm2)), F.sqrt(F.min(norm2))).first()
    peak = vectors.agg(F.max(F.greatest(F.array_max(F.transform("v", lambda x: F.abs(x))) / top, F.sqrt(F.greatest(F.lit(0.0), 1 - norm2 / (top * top)))))).first()[0]
    codes = written(vectors.select("vid", "v").mapInArrow(_rounded(top, peak), "vid long, vec binary"), f"{folder}/codes")
    places = written(codes.select("vec").distinct().mapInArrow(_projected(5), "vec binary, codes array<long>"), f"{folder}/places")
    count = places.count()

    # a node's number has its shard, of nodes with near places in a random-projection order, and its place there
    shards = math.ceil(count * (width + 1 + 8 * (neighbours + REVERSE)) / SHARD)
    near = [F.col("codes")[0], F.xxhash64("vec")]
    dealt = places.coalesce(1) if shards == 1 else places.repartitionByRange(shards, *near)
    nodes = written(dealt.sortWithinPartitions(*near).select(F.monotonically_increasing_id().alias("node"), "vec", "codes"), f"{folder}/nodes")
    members = vectors.join(codes, "vid").join(nodes.select("node", "vec"), "vec").select("vid", "node", "h1", "h2", "v", "own", F.col("own")[0]["vec_id"].alias("least"))
    members = written(members, f"{folder}/members")
    graph = build_graph(nodes, f"{folder}/graph", count, width + 1, neighbours)

    asked = rows.where(F.col("vec_id") % every == 0).select("h1", "h2", F.col("vec_id").alias("query_id"), F.col("row").alias("own_row"))
    asked = written(asked.join(members.select("h1", "h2", F.col("vid").alias("qvid"), F.col("node").alias("q")), ["h1", "h2"]).drop("h1", "h2"), f"{folder}/asked")
    # where norms differ, walks start from the largest vectors too: those have large products with many
    far = [r["node"] for r in members.orderBy(F.desc(norm2), "node").limit(EXPAND).select("node").collect()] if low < 0.99 * top else []
    first = F.array_distinct(F.concat(F.array("q"), F.array(*map(F.lit, far)).cast("array<bigint>"))).alias("cands")
    starts = asked.select("q").distinct().join(nodes.select(F.col("node").alias("q"), F.col("vec").alias("qvec")), "q").select("q", "qvec", first)
    found = search(starts, graph, nodes, f"{folder}/search", max(64, math.ceil(BEAM * math.log2(count + 1))))

    wanted = asked.select("qvid", "q").distinct().join(members.select(F.col("vid").alias("qvid"), "vid", "least", "v"), "qvid").drop("qvid")
    groups = written(_chunked(wanted, "q", "qc"), f"{folder}/groups")
    pairs = groups.select("q", "qc").join(found, "q").select("q", "qc", F.explode("ids").alias("node"))
    own = written(_chunked(members.select("node", "vid", "least", "v"), "node", "mc"), f"{folder}/chunks")
    ranked = groups.withColumn("kind", F.lit(0)).unionByName(pairs.join(own.drop("mc"), "node").drop("node").withColumn("kind", F.lit(1)))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranked = ranked.repartition(parts, "q", "qc").sortWithinPartitions("q", "qc", "kind")
    ranked = ranked.select("q", "qc", "kind", "vids", "least", "vecs").mapInArrow(_rank(k), "qvid long, near array<long>, scores array<double>")
    near = ranked.select("qvid", F.explode(F.arrays_zip("near", "scores")).alias("x")).select("qvid", F.col("x.near").alias("vid"), F.col("x.scores").alias("score"))
    near = near.join(members.select("vid", "own"), "vid").groupBy("qvid").agg(F.collect_list(F.struct("score", "own")).alias("near"))
    near = written(near, f"{folder}/near")  # k + 1 vectors at most in a row

    each = F.flatten(F.transform("near", lambda e: F.transform(e["own"], lambda o: F.struct((-e["score"]).alias("less"), o["vec_id"].alias("vec_id"), o["row"].alias("row")))))
    best = F.slice(F.array_sort(F.filter(each, lambda x: x["row"] != F.col("own_row"))), 1, k)
    out = asked.join(near, "qvid").select("query_id", F.posexplode(best).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.less")).alias("score"))
