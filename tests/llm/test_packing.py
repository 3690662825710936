import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fairlead.llm import packing as p

from .conftest import texts_of

PATH = public_tokenizers.path("byte_bpe_50k.json")
SLOW = Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return p.Encoder(PATH, cache=50)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t a'sB1.,é漢🙂"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_ids_are_the_tokenizers(encoder, text):
    want = SLOW.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder.ids(text), "<u4").tolist() == want


def check(docs, length, **more):
    rows = p.pack(docs, PATH, length=length, **more).collect()
    windows, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append(r)
    padding = 0
    for own in windows.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at and n > 0
            at += n
        assert at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
    texts = defaultdict(list)
    for i, t in texts_of(docs):
        texts[i].append(SLOW.encode(t, add_special_tokens=False).ids + [1])
    assert sum(r["length"] for r in rows) == sum(len(x) for own in texts.values() for x in own)
    for i, own in texts.items():
        if len(own) == 1:
            ids, at = np.array(own[0], "<u4"), 0
            for r in sorted(pieces[i], key=lambda r: r["start"]):
                assert r["start"] == at and r["doc_tokens"] == len(ids)
                assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
                at += r["length"]
            assert at == len(ids)
    return padding / max(1, sum(r["length"] for r in rows))


def test_round_trip(odd, documents):
    check(odd, 2048)
    assert check(documents, 2048) < 0.01
    assert check(documents.repartition(5), 64, windows=3) < 0.2


def test_leftovers_merge_over_groups_of_tasks(documents, monkeypatch):
    monkeypatch.setattr(p, "MERGE_GROUP", 10)
    assert check(documents.repartition(6), 2048) < 0.01


def test_empty_table(none):
    assert p.pack(none, PATH).count() == 0
