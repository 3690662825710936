import re

import pytest

from fairlead.llm import mixing as m


def source_targets(sizes: dict, weights=m.WEIGHTS, share: float = m.SHARE, most: float = m.MOST) -> dict:
    """Words to take from each source: `share` of all words by weight, none above `most` times its
    size; what is above is shared again among the others."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, rest, free = {}, share * sum(sizes.values()), set(order)
    while free:
        total = sum(weight[s] for s in order if s in free)
        over = [s for s in order if s in free and rest * weight[s] / total >= most * sizes[s]]
        if not over:
            target |= {s: rest * weight[s] / total for s in free}
            break
        for s in over:
            target[s] = most * sizes[s]
            free.discard(s)
        rest = max(0.0, rest - sum(target[s] for s in over))
    return target


def test_targets_are_water_filled():
    t = source_targets({"a": 100, "b": 100, None: 300, "c": 100})
    assert t["a"] == 200 and abs(sum(t.values()) - 900) < 1e-6
    assert t["b"] == pytest.approx(700 * 2 / 8) and t[None] == pytest.approx(700 * 5 / 8)
    assert source_targets({"a": 0}) == {"a": 0}


@pytest.mark.parametrize("sizes", [[5, 9, 1, 1, 1, 40, 7] * 30, [3] * 50, [0, 0, 5], [7], []])
def test_flight_keeps_totals(sizes):
    parts = m.fly(sizes, [0.37] * len(sizes), 1)
    assert sum(0 < p < 1 for p in parts) <= 2
    assert sum(parts) == pytest.approx(0.37 * len(sizes)) and sum(s * p for s, p in zip(sizes, parts)) == pytest.approx(0.37 * sum(sizes))


def check(docs, **more):
    rows = m.mix(docs, **more).collect()
    want, sizes, source = {}, {}, {}
    for r in docs.select("doc_id", "text", "source").collect():
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        want.setdefault(r["doc_id"], []).append(n)
        sizes[r["source"]] = sizes.get(r["source"], 0) + n
        source.setdefault(r["doc_id"], set()).add(r["source"])
    targets, got, by = source_targets(sizes), {}, {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append(r["size"])
        assert 0 <= r["taken"] <= 2 * r["size"]
        (own,) = source[r["doc_id"]]
        assert r["source_size"] == sizes[own] and r["target"] == pytest.approx(targets[own])
        by[own] = by.get(own, 0) + r["taken"]
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    for own, taken in by.items():
        assert abs(taken - targets[own]) <= 2.5
    return sorted(map(tuple, rows), key=str)


def test_takes_meet_targets_and_reruns_agree(odd, documents):
    check(odd)
    assert check(documents) == check(documents)
    check(documents, block=3)


def test_the_draw_hangs_on_contents_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source")
    same = spark.range(300).selectExpr("cast(null as long) doc_id", "'a b c' text", "'hot' source")
    docs = docs.unionByName(same)
    assert check(docs.repartition(2), block=20) == check(docs.repartition(5), block=20) == check(docs.orderBy("text").coalesce(3), block=20)


@pytest.mark.parametrize("broadcast", [0, m.BROADCAST])
def test_many_sources(spark, monkeypatch, broadcast):
    monkeypatch.setattr(m, "BROADCAST", broadcast)
    names = [None, "", "s", *(f"é{i}" for i in range(1500)), *(f"b{i}" for i in range(1500))]
    rows = [(i, "w " * (i * 7919 % 23), names[i % len(names)]) for i in range(6000)]
    check(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3), block=50)


def test_empty_table(none):
    assert m.mix(none).count() == 0
