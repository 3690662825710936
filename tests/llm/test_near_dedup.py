from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from fairlead.llm import near_dedup as nd

from .conftest import texts_of


def words(text):
    return text.encode().lower().split()


def sets_of(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows, similarity=nd.SIMILARITY):
    nodes = [(nd.NULL_ID if i is None else i, sets_of(t)) for i, t in rows]
    first, parent = defaultdict(list), list(range(len(nodes)))
    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for k, (_, s) in enumerate(nodes):
        for x in s:
            first[x].append(k)
    common = Counter()
    for own in first.values():
        for a in own:
            for b in own:
                if a < b:
                    common[a, b] += 1
    for (a, b), n in common.items():
        if 100 * n >= similarity * (len(nodes[a][1]) + len(nodes[b][1]) - n):
            parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(nodes):
        least[find(k)] = min(i, least.get(find(k), i))
    out = Counter()
    for k, (i, s) in enumerate(nodes):
        unnull = lambda v: None if v == nd.NULL_ID else v
        comp = unnull(least[find(k)] if s else i)
        out[(unnull(i), len(s), comp, unnull(i) == comp)] += 1
    return out


def chain(spark):
    """Near copies of near copies, so that the first of a bucket links with few of the others."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(200)]
    rows, now = [], list(base)
    for i in range(120):
        now = list(now)
        now[rng.integers(len(now))] = f"x{i}"
        rows.append((i, " ".join(now)))
    rows += [(1000 + i, " ".join(base[: 100 + i % 7] + [f"y{i}"] * 3)) for i in range(40)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


@pytest.mark.parametrize("which", ["odd", "documents", "chain"])
def test_matches_brute_force(request, spark, which, monkeypatch):
    docs = chain(spark) if which == "chain" else request.getfixturevalue(which)
    monkeypatch.setattr(nd, "MINOR", 8)
    monkeypatch.setattr(nd, "MAJOR", 16)
    assert Counter(map(tuple, nd.near_duplicates(docs).collect())) == brute(texts_of(docs))


def test_empty_table(none):
    assert nd.near_duplicates(none).count() == 0


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(3)
    a, b, c = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (400, 400, 1700))
    x, y = np.r_[a, c], np.r_[b, c]
    reg = lambda s: nd.registers(s, np.array([0]))[0]
    assert (np.maximum(reg(a), reg(c)) == reg(x)).all()
    true = len(c) / (len(c) + 800)
    got = nd.likeliest(reg(x)[None], reg(y)[None], np.array([2100.0]), np.array([2100.0]))[0]
    assert abs(got - true) < 0.2


def test_shingles_do_not_span_texts():
    h, last = nd.shingles(pa.array(["a b c d e f", None, "a b c d e", "A  b", "", "a b"]))
    assert last.tolist() == [2, 2, 3, 4, 4, 5] and h[0] == h[2] and h[3] == h[4] and len(set(h.tolist())) == 3
