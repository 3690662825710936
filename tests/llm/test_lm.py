import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from fairlead.llm import lm

from .conftest import texts_of


def brute_base(rows):
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5
    words = [(i, [*t.encode().lower().split(), None]) for i, t in rows]
    c = Counter(w for i, ws in words if fold(i) != 1 for w in ws)
    n, v = sum(c.values()), len(c)
    return sorted(((i, fold(i) == 1, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for i, ws in words), key=str)


@pytest.mark.parametrize("frequent", [0, 50, lm.FREQUENT])
def test_base_matches_brute_force(odd, documents, frequent):
    for docs in (odd, documents):
        got = sorted((tuple(r)[:6] for r in lm.score(docs, frequent=frequent).collect()), key=str)
        want = brute_base(texts_of(docs))
        assert sorted(x[:5] for x in got if x[0] is not None) == sorted(x[:5] for x in want if x[0] is not None)
        assert sorted(x[5] for x in got) == pytest.approx(sorted(x[5] for x in want))


@pytest.mark.parametrize("order", [0, 1, 2, 4])
def test_scores_match_the_trie_symbol_by_symbol(order):
    train = ["abracadabra", "the cat sat on the mat", "", "aaaa", "naïve café"]
    model = lm.Adaptive(order)
    for t in train:
        model.log10(t.encode())
    data, _ = lm.framed(pa.array(train), order)
    table = lm.build(*lm.gram_counts(data, order), order)
    tests = [*train, "abracat", "xyz", "the the zebra é 漢", "q"]
    data, first = lm.framed(pa.array(tests), order)
    want = [model.log10(t.encode(), learn=False) for t in tests]
    assert table.scores(data, first) == pytest.approx(want, rel=1e-5)


def test_distributions_sum_to_one():
    data, _ = lm.framed(pa.array(["abracadabra", "barbara", "cab"]), 2)
    table = lm.build(*lm.gram_counts(data, 2), 2)
    p = 10.0 ** table.logs[1:].astype(float)
    unseen = lm.SYMBOLS - (p.shape[1] - 1)
    assert p[:, :-1].sum(1) + p[:, -1] * unseen == pytest.approx(np.ones(len(p)), rel=1e-4)


@pytest.mark.parametrize("held_grams", [0, 300, lm.GRAMS])
def test_the_order_stays_where_the_text_has_many_contexts(spark, held_grams):
    # about 2e5 contexts and 190 byte values: more than 16 million cells of a dense table
    rng = np.random.default_rng(3)
    draw = lambda n: "".join(map(chr, rng.integers(0x80, 0x800, n)))
    rows = [(i, draw(20_000) if i < 5 else "the cat sat on the mat" + "at" * i) for i in range(12)]
    rows += [(i, t) for i, t in zip((50, 51, 52, 53, 54, 55, 56), ("the cat at the mat zebra", "q", draw(40), "", None, "tatatat \u0416", rows[0][1][:300]))]
    model = lm.Adaptive(lm.ORDER)
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    for i, t in rows:
        if fold(i) != 1:
            model.log10((t or "").encode().lower())
    assert {fold(i) == 1 for i, _ in rows} == {True, False}
    got = {r["doc_id"]: r["score"] for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string"), held_grams=held_grams).collect()}
    assert got == pytest.approx({i: model.log10((t or "").encode().lower(), learn=False) for i, t in rows}, rel=1e-5)


def test_adaptive_lengths(odd, none):
    short = odd.where("doc_id <> 7")
    rows = lm.adaptive_lengths(short).collect()
    assert len(rows) == short.count() and all(r["score"] < 0 for r in rows)
    assert lm.adaptive_lengths(none).count() == 0


def test_no_training_rows_and_empty_table(spark, none):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = lm.score(spark.createDataFrame([(held, "ab c")], "doc_id long, text string")).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (3, 0, 0, 0.0)
    assert r["score"] == pytest.approx(-5 * math.log10(257))
    assert lm.score(none).count() == 0
