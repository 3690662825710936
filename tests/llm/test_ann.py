import numpy as np
import pytest

from fairlead.llm import ann


def brute(rows, k=20, every=20):
    ids, v = [r[0] for r in rows], np.array([r[1] for r in rows], float)
    out = {}
    for n, i in enumerate(ids):
        if i % every == 0:
            s = v @ v[n]
            order = sorted((m for m in range(len(ids)) if m != n), key=lambda m: (-s[m], ids[m]))[:k]
            out.setdefault(i, []).append([(ids[m], s[m]) for m in order])
    return out


def results(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return got


def recall(got, want):
    hits = [len({i for i, _ in got[q]} & {i for i, _ in w[0]}) / len(w[0]) for q, w in want.items()]
    return np.mean(hits)


def test_recall_and_scores(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    got, want = results(ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4))), brute(rows)
    assert got.keys() == want.keys() and recall(got, want) >= 0.95
    v = {i: np.array(x, float) for i, x in rows}
    for q, own in got.items():
        assert len(own) == 20 and own == sorted(own, key=lambda x: (-x[1], x[0]))
        assert all(s == pytest.approx(v[q] @ v[i]) for i, s in own)


@pytest.mark.parametrize("small", [True, False])
def test_lengths_that_differ_and_copies(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(ann, "BROADCAST", 0)
        monkeypatch.setattr(ann, "SHARD", 1 << 15)
    rng = np.random.default_rng(2)
    v = rng.standard_normal((400, 8)) * rng.lognormal(0, 0.7, (400, 1))
    v[100:160] = v[100]
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    got, want = results(ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))), brute(rows)
    assert recall(got, want) >= 0.95
    assert [i for i, _ in got[100]] == [i for i, _ in want[100][0]]


def test_walks_over_many_shards_find_as_much(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 1 << 17)
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    got, want = results(ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4))), brute(rows)
    assert got.keys() == want.keys() and recall(got, want) >= 0.95


def test_vectors_that_round_alike_are_all_ranked(spark, monkeypatch):
    monkeypatch.setattr(ann, "CHUNK", 100)
    rng = np.random.default_rng(6)
    v = rng.standard_normal((1200, 8))
    v[:900] = v[0] + 1e-7 * rng.standard_normal((900, 8))
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    got, want = results(ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))), brute(rows)
    assert all([i for i, _ in got[q]] == [i for i, _ in want[q][0]] for q in range(0, 900, 20)) and recall(got, want) >= 0.95


def test_each_length_is_searched_by_itself(spark):
    rng = np.random.default_rng(7)
    long, short = ([(i, rng.standard_normal(d).tolist()) for i in own] for own, d in ((range(0, 200, 2), 6), (range(1, 61), 3)))
    short = [x for x in short if x[0] % 2 or x[0] % 20 == 0]
    long = [x for x in long if x[0] not in {i for i, _ in short}]
    got = results(ann.nearest(spark.createDataFrame(long + short, "vec_id long, embedding array<double>").repartition(3)))
    want = brute(long) | brute(short)
    assert got.keys() == want.keys() and recall(got, want) >= 0.95


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], "a"), (0, [1.0, 0.0], "b"), (1, None, "c"), (2, [], "d"), (3, [0.0, 0.0], "e"), (4, [nan, 1.0], "f"), (5, [inf, 1.0], "g"), (6, [None, 1.0], "h"), (None, [1.0, 1.0], "i"), (7, [1.0, 1.0, 1.0], "j"), (8, [0.5, 0.5], "k"), (20, [-1.0, 0.0], "l")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, node string")
    got = results(ann.nearest(df))
    assert sorted(got) == [0, 20] and sorted(got[0]) == sorted([(0, 1.0), (8, 0.5), (20, -1.0)] * 2)
    assert got[20] == [(8, -0.5), (0, -1.0), (0, -1.0)]
    assert ann.nearest(df.limit(0)).count() == 0
    assert ann.nearest(df.where("vec_id = 20")).count() == 0
