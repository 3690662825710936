import hashlib
from collections import Counter, defaultdict

import pytest

from fairlead.llm import exact_dedup as x

from .conftest import texts_of


def brute(rows):
    groups = defaultdict(list)
    norm = lambda t: t.encode().translate(None, b" \t\n\x0b\x0c\r")
    for i, t in rows:
        groups[norm(t)].append((-len(t), i is None, i or 0))
    out = Counter()
    for t, own in groups.items():
        best, left = min(own), 1
        for o in own:
            stays = left and o == best
            left -= bool(stays)
            unnull = lambda o: None if o[1] else o[2]
            out[(unnull(o), unnull(best), len(own), bool(stays), hashlib.sha256(t).hexdigest())] += 1
    return out


@pytest.mark.parametrize("bits,window", [(64, x.WINDOW), (3, 200)])
def test_matches_brute_force(odd, documents, bits, window):
    for docs in (odd, documents):
        got = x.exact_dedup(docs, key_bits=bits, window=window, capacity=2)
        assert Counter(map(tuple, got.collect())) == brute(texts_of(docs))


def test_empty_table(none):
    assert x.exact_dedup(none).count() == 0


def test_hash_table_splits_and_is_found_again(tmp_path):
    table = x.ExtendibleHash(capacity=4)
    for i in range(1000):
        table.insert(i * 0x9E3779B97F4A7C15 % 2**64, ("log", i, 1))
    for i in range(20):
        table.insert(7, ("log", 5000 + i, 1))
    assert table.depth >= 8 and all(b[2] <= 4 or len(b[1]) == 1 for b in table.buckets())
    with open(tmp_path / "t", "wb") as f:
        table.save(f, ["log"])
    uri = f"file://{tmp_path}/t"
    assert x.find(uri, 3 * 0x9E3779B97F4A7C15 % 2**64) == [("log", 3, 1)]
    assert len(x.find(uri, 7)) == 20 and x.find(uri, 123456789) == []
