import zlib

import numpy as np
import pyarrow as pa
import pytest

from fairlead.llm import quality as q


@pytest.fixture(scope="module")
def larger(spark):
    d = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def test_held_out_accuracy(larger):
    docs, labels = larger
    rows = q.classify(docs, labels).collect()
    assert len(rows) == docs.count()
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    held = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([p == t for p, t in held]) > 0.93 and np.mean([p for p, t in held if t]) > 0.97


def test_odd_rows_and_no_labels(odd, none, larger):
    _, labels = larger
    rows = q.classify(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in q.classify(odd, labels.limit(0)).collect()} == {0.5}
    assert q.classify(none, labels).count() == 0


def test_trees_match_a_walk_node_by_node():
    rng = np.random.default_rng(1)
    x = rng.random((500, len(q.FEATURES))).astype(np.float32)
    y = (x[:, 0] + x[:, 3] * x[:, 5] > 0.8).astype(float)
    model = q.fit(x, y, trees=10)
    got = model.scores(x)
    assert np.mean((got > 0.5) == y) > 0.95
    for i in range(20):
        total, inner = model.base, model.features.shape[1]
        for f, t, v in zip(model.features, model.thresholds, model.leaves):
            k = 0
            while k < inner:
                k = 2 * k + 1 + int(x[i, f[k]] > t[k])
            total += v[k - inner]
        assert got[i] == pytest.approx(1 / (1 + np.exp(-total)))


def test_statistics_do_not_depend_on_neighbours():
    texts = ["A b b. C\nb b\nA b b. C", None, "", "x", " \n", "THE!! END!! é漢", "q" * 50 + "\n|\n|"]
    whole = q.statistics(pa.array(texts))
    for i, t in enumerate(texts):
        assert np.allclose(q.statistics(pa.array([t], pa.string()))[0], whole[i])
    row = dict(zip(q.FEATURES, whole[0]))
    assert row["again"] == pytest.approx(1 / 10) or row["lines_distinct"] == pytest.approx(2 / 3)
