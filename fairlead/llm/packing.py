"""Bounded-space online packing of tokenised documents into sequences of a fixed length.

Each scanning task keeps `windows` open sequences. A document's ids first fill whole sequences; what
remains goes to the open window that it fits best. If none fits and all windows are open, the
fullest is topped up with the head of the piece and emitted (or emitted as it is, where the gap is
under `least_piece`), which opens a new one. At the end of a task the open windows are leftovers.
Leftovers (a few for each task, without ids) are merged best-fit over groups of tasks, then over all;
what is still short is cut at powers of two, where a sequence needs no padding.

Ids never leave the task that made them: pieces carry their place and the CRC of their ids.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .shared import shared_dir, slices, written

LENGTH = 2048
WINDOWS = 64
LEAST_PIECE = 16
END_ID = 1
CACHE = 400_000  # words whose ids a worker keeps
MERGE_GROUP = 4096  # leftover windows that one merging task takes at most

PIECE = StructType([StructField("doc_id", LongType()), StructField("start", LongType()), StructField("length", LongType()), StructField("ids_crc32", LongType()), StructField("doc_tokens", LongType()), StructField("task", LongType()), StructField("window", LongType()), StructField("offset", LongType()), StructField("left", LongType()), StructField("ids", BinaryType())])


class WordIds(dict):
    """Ids of pieces of text as little-endian 32-bit bytes, kept up to a number of pieces."""

    def __init__(self, encode, limit: int):
        super().__init__()
        self.encode, self.limit = encode, limit

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        ids = self[word] = np.array(self.encode(" " + word), "<u4").tobytes()
        return ids


def byte_values() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable Latin-1 stands for
    itself, the other bytes follow from code point 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts by a byte-level BPE vocabulary file.

    The file is read by `tokenizers`; its merges also run in tiktoken, which is several times faster,
    and are kept by word. Words are what single spaces part; a text with other runs of blanks, where
    the rule for blanks looks ahead over the parting, is encoded whole. A text that holds one of the
    file's special tokens goes to `tokenizers` itself. Both give the same ids (tests hold them equal).
    """

    def __init__(self, path: str, cache: int = CACHE):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        values = byte_values()
        ranks = {bytes(values[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        # fixed value: the published split pattern of this vocabulary
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.words = WordIds(self.fast.encode_ordinary, cache)

    def ids(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = text.split(" ")
        if "" in words[1:]:
            return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()
        head = np.array(self.fast.encode_ordinary(words[0]), "<u4").tobytes() if words[0] else b""
        return head + b"".join(map(self.words.__getitem__, words[1:]))


class Windows:
    """Open sequences, ordered by the room they have."""

    def __init__(self, length: int, most: int, least: int, emit):
        self.length, self.most, self.least, self.emit = length, most, least, emit
        self.rooms: list[tuple[int, int]] = []  # (room, window), ascending
        self.pieces: dict[int, list] = {}
        self.next = 0

    def _open(self) -> int:
        self.next += 1
        self.pieces[self.next - 1] = []
        return self.next - 1

    def _put(self, window: int, room: int, piece) -> None:
        """piece: (length, cut(start, length) -> row)"""
        self.pieces[window].append((self.length - room, piece))
        room -= piece[0]
        if room:
            bisect.insort(self.rooms, (room, window))
        else:
            self.emit(window, self.pieces.pop(window), False)

    def add(self, total: int, cut) -> None:
        start = 0
        while total - start >= self.length:
            self._put(self._open(), self.length, (self.length, cut(start, self.length)))
            start += self.length
        while start < total:
            need = total - start
            i = bisect.bisect_left(self.rooms, (need, -1))
            if i < len(self.rooms):
                room, window = self.rooms.pop(i)
            elif len(self.rooms) < self.most:
                room, window = self.length, self._open()
            else:
                room, window = self.rooms.pop(0)  # the fullest
                if room < self.least:
                    self.emit(window, self.pieces.pop(window), False)
                    continue
                self._put(window, room, (room, cut(start, room)))
                start += room
                continue
            self._put(window, room, (need, cut(start, need)))
            start = total

    def close(self) -> None:
        for _, window in self.rooms:
            self.emit(window, self.pieces.pop(window), True)
        self.rooms = []


def powers(n: int, length: int) -> list[int]:
    """n as falling powers of two of at most `length`."""
    out = []
    while n:
        out.append(min(length, 1 << (n.bit_length() - 1)))
        n -= out[-1]
    return out


def _pack(path: str, length: int, windows: int, least: int, end_id: int):
    def run(batches):
        encoder, task, rows = Encoder(path), TaskContext.get().partitionId(), []
        end = np.array([end_id], "<u4").tobytes()

        def emit(window, pieces, left):
            for offset, (n, row) in pieces:
                rows.append((*row[:5], task, window, offset, int(left), row[5] if left else None))

        packer = Windows(length, windows, least, emit)
        for batch in batches:
            for part in slices(batch, "text"):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    ids = encoder.ids(text or "") + end
                    n = len(ids) // 4

                    def cut(start, size, ids=ids, n=n, doc_id=doc_id):
                        own = ids[4 * start : 4 * (start + size)]
                        return (doc_id, start, size, zlib.crc32(own), n, own)

                    packer.add(n, cut)
                if rows:
                    yield _batch(rows)
                    rows.clear()
        packer.close()
        if rows:
            yield _batch(rows)

    return run


TYPES = [pa.int64()] * 9 + [pa.binary()]


def _batch(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), TYPES)], names=PIECE.names)


def _merge(length: int, level: int, last: bool):
    """Best-fit-decreasing over leftover windows, which stay whole where that fills a sequence. The
    others run together and are cut into full sequences; their tail is a leftover again, or in the
    last round is cut at powers of two."""

    def run(batches):
        left: dict[tuple, list] = {}
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                left.setdefault((row[5], row[6]), []).append(row)
        task, rows, number = (level << 24) + TaskContext.get().partitionId(), [], 0
        rooms, bins = [], []
        for _, pieces in sorted(left.items(), key=lambda x: (-sum(p[2] for p in x[1]), x[0])):
            need = sum(p[2] for p in pieces)
            i = bisect.bisect_left(rooms, (need, -1))
            room, k = rooms.pop(i) if i < len(rooms) else (length, len(bins))
            if k == len(bins):
                bins.append([])
            bins[k] += sorted(pieces, key=lambda p: p[7])
            if room > need:
                bisect.insort(rooms, (room - need, k))
        short = {k for _, k in rooms}
        for k, pieces in enumerate(bins):
            if k not in short:
                at = 0
                for p in pieces:
                    rows.append((*p[:5], task, number, at, 0, None))
                    at += p[2]
                number += 1
        stream = [p for k in sorted(short) for p in bins[k]]
        total, at = sum(p[2] for p in stream), 0
        sizes = [length] * (total // length) + (powers(total % length, length) if last else [total % length])
        for p in stream:
            done = 0
            while done < p[2]:
                n = min(p[2] - done, sizes[0] - at)
                own = p[9][4 * done : 4 * (done + n)]
                keep = not last and len(sizes) == 1
                rows.append((p[0], p[1] + done, n, zlib.crc32(own), p[4], task, number, at, int(keep), own if keep else None))
                done, at = done + n, at + n
                if at == sizes[0]:
                    sizes.pop(0)
                    number, at = number + 1, 0
        for i in range(0, len(rows), 10_000):
            yield _batch(rows[i : i + 10_000])

    return run


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, windows: int = WINDOWS, least_piece: int = LEAST_PIECE, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row for each piece.

    Every row of `docs` is a document of its own (repeated rows too), its ids followed by `end_id`;
    a null text is empty and gives that id alone; null ids stay null. A text of any length is cut
    into whole sequences and a rest. Sequences are gapless from offset 0, at most `length` long, and
    their numbers are unique, not consecutive. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark, "packing")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = written(source.mapInArrow(_pack(tokenizer, length, windows, least_piece, end_id), PIECE), f"{folder}/packed")
    done, left, level, last = [pieces.where("left = 0")], pieces.where("left = 1"), 0, False
    while not last:
        # a leftover window's pieces stay together; each round leaves one window for a group at most
        groups = -(-left.select("task", "window").distinct().count() // MERGE_GROUP)
        last, level = groups <= 1, level + 1
        dealt = left.coalesce(1) if last else left.repartition(groups, "task", "window")
        merged = written(dealt.mapInArrow(_merge(length, level, last), PIECE), f"{folder}/merged-{level}")
        done.append(merged.where("left = 0"))
        left = merged.where("left = 1")
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    number = F.shiftleft("task", 32) + F.col("window")
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", number.alias("sequence_id"), "offset")
