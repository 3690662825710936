"""Personal data with its places, through disguises.

Fixed patterns find plain identifiers. Then a chain of transducers rewrites a text and keeps, for
each character it writes, the span of source characters it came from:

* homoglyphs: full-width forms and look-alike Cyrillic and Greek letters become ASCII, and
  characters without width go;
* spelled digits: three or more number words in a row become digits;
* at/dot disguises: "name (at) host [dot] org" and "name at host dot org" lose their disguise.

Identifiers are found again in what was written, and their spans are mapped back to the source. Texts
without a sign of disguise (nearly all) skip the chain after one search.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices

KINDS = ("email", "ip", "card", "phone")

# fixed values: the base patterns
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")  # begins where digits do: a match from later on would also match from there
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# fixed values: number words, letters that look like ASCII ones
DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
LOOKALIKES = dict(zip("АВЕЅІЈКМНОРСТХУаеіјѕорсухԁһԛԝɡΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανυι", "ABESIJKMHOPCTXYaeijsopcyxdhqwgABEZHIKMNOPTYXoavui"))
WIDTHLESS = "­​‌‍⁠﻿"

# fixed values: ends of host names that make a disguise without brackets credible
ENDINGS = frozenset("com org net edu gov int mil info biz io ai app dev co uk de fr es it nl be ch at se no dk fi pl pt ru eu us ca au nz jp cn in br mx za".split())

WORD = "|".join(DIGITS)
SPELLED = re.compile(rf"(?<![A-Za-z0-9])(?:{WORD}|[0-9]+)(?:[\x20,.-]{{1,2}}(?:{WORD}|[0-9]+))+(?![A-Za-z0-9])", re.I | re.A)
PART = re.compile(rf"{WORD}|[0-9]+", re.I | re.A)
AT = re.compile(r"\s*[(\[{<]\s*at\s*[)\]}>]\s*|\s+at\s+", re.I)
DOT = re.compile(r"\s*[(\[{<]\s*(?:dot|punkt|point|punto)\s*[)\]}>]\s*|\s+dot\s+", re.I)
#: A chain of words, and with it the rest of an address if there is one: no chain is tried again from its middle.
HIDDEN = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-]++(?:(?:\.|{DOT.pattern})[A-Za-z0-9_%+-]+)*+(?:(?P<at>{AT.pattern}|\s*@\s*)[A-Za-z0-9-]++(?:(?:\.|{DOT.pattern})[A-Za-z0-9-]+)++)?", re.I)
#: Signs of disguise: every text that a transducer edits has one, and a text without any is not rewritten.
SIGN = re.compile(rf"[{WIDTHLESS}Ͱ-ӿԀ-ԯɡ！-～]|[(\[{{<]\s*(?:at|dot|punkt|point|punto)\s*[)\]}}>]|\sdot\s|\s@|@\s|(?<!(?-i:[A-Za-z0-9]))(?:{WORD})[\x20,.-]{{1,2}}(?:{WORD}|[0-9])", re.I)


def luhn(digits: str) -> bool:
    """Whether the digits pass the check of card numbers."""
    own = [int(d) for d in reversed(digits)]
    return (sum(own[::2]) + sum(2 * d - 9 * (d > 4) for d in own[1::2])) % 10 == 0


def emails(text: str):
    """Leftmost non-overlapping [A-Za-z0-9._%+-]+@label(.label)+, searched from the at signs, so that
    the words before them are not tried at each letter."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def detect(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of plain identifiers; matches that fail their test are dropped, not retried."""
    out = [(s, 0, e) for s, e in emails(text)]
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


class Tape:
    """A text under rewriting: each character with the source span that it came from."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, range(len(text)), range(1, len(text) + 1)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace spans of the present text, in order. What is written in place of a span is dealt
        over it: character for character if it is as long, else each has all of the span."""
        if not edits:
            return
        text, starts, ends, at = [], [], [], 0
        for s, e, new in edits:
            text += [self.text[at:s], new]
            starts += self.starts[at:s]
            ends += self.ends[at:s]
            if len(new) == e - s:
                starts += self.starts[s:e]
                ends += self.ends[s:e]
            elif e > s:
                starts += [self.starts[s]] * len(new)
                ends += [self.ends[e - 1]] * len(new)
            at = e
        self.text = "".join([*text, self.text[at:]])
        self.starts = [*starts, *self.starts[at:]]
        self.ends = [*ends, *self.ends[at:]]

    def source(self, start: int, end: int) -> tuple[int, int]:
        return self.starts[start], self.ends[end - 1]


def homoglyphs(text: str) -> list[tuple[int, int, str]]:
    """A look-alike is rewritten only where ASCII letters, digits or signs of an identifier adjoin its
    word, so that words of other scripts stay."""
    edits = []
    for m in re.finditer(r"\S+", text):
        word = m[0]
        if word.isascii():
            continue
        mixed = any(c.isascii() and (c.isalnum() or c in "@._-+") for c in word)
        for i, c in enumerate(word, m.start()):
            if c in WIDTHLESS:
                edits.append((i, i + 1, ""))
            elif "！" <= c <= "～":
                edits.append((i, i + 1, unicodedata.normalize("NFKC", c)))
            elif mixed and c in LOOKALIKES:
                edits.append((i, i + 1, LOOKALIKES[c]))
    return edits


def spelled(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for m in SPELLED.finditer(text):
        parts = PART.findall(m[0])
        if sum(not p[0].isdigit() for p in parts) >= 3:
            edits.append((m.start(), m.end(), "".join(DIGITS.get(p.lower(), p) for p in parts)))
    return edits


def disguised(text: str) -> list[tuple[int, int, str]]:
    """Edits for hidden addresses; a bare "at" counts only with a dot word in the same address, as in
    "name at host dot org", and bare words only before a usual ending, for both are common words."""
    edits = []
    for m in HIDDEN.finditer(text):
        whole, at = m[0], m["at"]
        if at is None or at == "@" and not DOT.search(whole):
            continue
        if at.strip().lower() == "at" and not DOT.search(text, m.end("at"), m.end()):
            continue
        if not any(c in whole for c in "([{<") and re.split(r"[.\s]", whole)[-1].lower() not in ENDINGS:
            continue
        edits.append((m.start("at"), m.end("at"), "@"))
        edits += [(d.start(), d.end(), ".") for d in DOT.finditer(text, m.start(), m.start("at"))]
        edits += [(d.start(), d.end(), ".") for d in DOT.finditer(text, m.end("at"), m.end())]
    return sorted(edits)


def spans(text: str) -> tuple[list, list]:
    """Base spans, and base and added spans together, as (start, kind, end) in code points. An added span
    that lies within a base one of its kind is left out; one that reaches beyond it is a wider identifier,
    of which the base one is the plain rest, and stands beside it."""
    base = detect(text)
    if not SIGN.search(text):
        return base, base
    tape = Tape(text)
    for transducer in (homoglyphs, spelled, disguised):
        tape.rewrite(transducer(tape.text))
    if tape.text == text:
        return base, base
    # base spans of a kind do not overlap: of those that begin no later, the last is the only one that can hold another
    of_kind = [[x for x in base if x[1] == k] for k in range(len(KINDS))]
    added = set()
    for s, kind, e in detect(tape.text):
        s, e = tape.source(s, e)
        own = of_kind[kind]
        i = bisect_right(own, (s, kind, len(text))) - 1
        if i < 0 or own[i][2] < e:
            added.add((s, kind, e))
    return base, sorted({*base, *added})


def joined(found) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


NOTHING = hashlib.sha256(b"").hexdigest()
FIELDS = [("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())]
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def _run(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            rows = []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                base, every = spans(text) if text else ([], [])
                counts = [0] * len(KINDS)
                for _, k, _ in base:
                    counts[k] += 1
                rows.append((doc_id, *counts, hashlib.sha256(joined(base).encode()).hexdigest() if base else NOTHING, joined(every)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), FIELDS)], names=[n for n, _ in FIELDS])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans: one row for each row of `docs`.

    Counts and hash are of the base spans, `spans` lists all as kind:start:end by start, then kind, in
    code points of the source, end exclusive. Null texts count as empty; ids may repeat or be null;
    other columns are ignored; an empty table gives no rows. Texts are read whole, in time that grows with
    their length alone. Nothing is shuffled.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(_run, SCHEMA)
