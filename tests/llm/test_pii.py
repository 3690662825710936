import hashlib
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fairlead.llm import pii

from .conftest import texts_of

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def brute(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        total = sum(sum(map(int, str(int(c) * (1 + i % 2)))) for i, c in enumerate(reversed(d)))
        if 14 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="a@.-+ 0129(%é", max_size=40))
def test_base_matches_brute_force_on_small_alphabets(text):
    assert pii.detect(text) == brute(text)


def test_base_matches_brute_force_on_documents(odd, documents):
    for docs in (odd, documents):
        want = {}
        for i, t in texts_of(docs):
            want.setdefault(i, set()).add(pii.joined(brute(t)))
        for r in pii.find_pii(docs).collect():
            own = want[r["doc_id"]]
            assert r["spans"] in own and r["base_sha256"] in {hashlib.sha256(x.encode()).hexdigest() for x in own}
            assert r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] == (r["spans"].count(",") + 1 if r["spans"] else 0)


@pytest.mark.parametrize(
    "text,found",
    [
        ("write to jane.doe (at) mail [dot] example [dot] org now", "email:jane.doe (at) mail [dot] example [dot] org"),
        ("🙂 jane at mail dot example dot org", "email:jane at mail dot example dot org"),
        ("jane@mail dot org", "email:jane@mail dot org"),
        ("mаriа@exаmple.com!", "email:mаriа@exаmple.com"),
        ("ｊａｎｅ＠ｍａｉｌ．ｏｒｇ", "email:ｊａｎｅ＠ｍａｉｌ．ｏｒｇ"),
        ("call +1 five five five two one two three four five six", "phone:+1 five five five two one two three four five six"),
        ("card four one one one 1111 1111 one one one one.", "card:four one one one 1111 1111 one one one one"),
        ("x 10.0​.0.1 y", "ip:10.0​.0.1"),
    ],
)
def test_disguises_map_back_to_the_source(text, found):
    base, every = pii.spans(text)
    assert [f"{pii.KINDS[k]}:{text[s:e]}" for s, k, e in every if (s, k, e) not in base] == [found]


@settings(max_examples=1000, deadline=None)
@given(st.lists(st.sampled_from(["bob", "mail", "com", "org", "at", "dot", "@", "(at)", "[dot]", ".", " ", "  ", "-", ",", "+1", "one", "four", "Nine", "5", "55", "\u212a", "\u017f", "о", "\u200b"]), max_size=40).map("".join))
def test_texts_without_a_sign_are_not_rewritten(text):
    if not pii.SIGN.search(text):
        tape = pii.Tape(text)
        for transducer in (pii.homoglyphs, pii.spelled, pii.disguised):
            tape.rewrite(transducer(tape.text))
        assert tape.text == text


@pytest.mark.parametrize("text,found", [("write to bob @ example.com", "email:bob @ example.com"), ("+1 four 1 five 5 five 0 one 9 nine 8", "phone:+1 four 1 five 5 five 0 one 9 nine 8")])
def test_disguises_need_no_other_sign(text, found):
    base, every = pii.spans(text)
    assert [f"{pii.KINDS[k]}:{text[s:e]}" for s, k, e in every if (s, k, e) not in base] == [found]


@pytest.mark.parametrize(
    "text,found",
    [
        ("bob@mail.exаmple.com", ["email:bob@mail.ex", "email:bob@mail.exаmple.com"]),
        ("first [dot] last@host.com", ["email:first [dot] last@host.com", "email:last@host.com"]),
        ("bob (dot) smith@host.com.", ["email:bob (dot) smith@host.com", "email:smith@host.com"]),
        ("bob@mail.host (dot) com", ["email:bob@mail.host", "email:bob@mail.host (dot) com"]),
    ],
)
def test_wider_spans_stand_beside_base_ones(text, found):
    base, every = pii.spans(text)
    assert sorted(f"{pii.KINDS[k]}:{text[s:e]}" for s, k, e in every) == found and len(base) == 1


@pytest.mark.parametrize(
    "unit",
    ["7", "a", "a.", "1.", "1 ", "+1", "@", "a@", "@a", "a dot ", "dot ", " at ", "(", "( at", "one ", "one1", "1-", "\u0430", "a\u0430", " ", "a\u0430@b.c ", "x (at) y ", "1.1.1.1 ", "\u200b", "bob (dot) smith@host.com ", "[dot]"],
)
def test_a_text_of_a_megabyte_takes_seconds(unit):
    text = unit * ((1 << 20) // len(unit))
    start = time.perf_counter()
    base, every = pii.spans(text)
    assert time.perf_counter() - start < 20 and set(base) <= set(every)


def test_long_numbers_in_addresses():
    for text in ("0000000000300.1.1.1", "000255.1.1.1", "1" * 5000 + ".1.1.1", "256.1.1.1 0.0.0.0"):
        want = sorted((m.start(), 1, m.end()) for m in pii.IP.finditer(text) if all(len(x.lstrip("0")) < 4 and int(x[-9:]) <= 255 for x in m[0].split(".")))
        assert [x for x in pii.detect(text) if x[1] == 1] == want


@pytest.mark.parametrize("text", ["we met at noon. dot the i", "look at this dot and that", "one two three go", "Привет at мир dot ком", "at dot at dot", "five at mail", "one. two. three."])
def test_clean_texts_stay_clean(text):
    assert pii.spans(text) == ([], [])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("a1 .@()[]atdo​ао＠one+"), max_size=60))
def test_base_spans_stay_and_added_ones_lie_in_the_text(text):
    base, every = pii.spans(text)
    assert base == brute(text) and set(base) <= set(every) and all(0 <= s < e <= len(text) for s, _, e in every)


def test_empty_table(none):
    assert pii.find_pii(none).count() == 0
