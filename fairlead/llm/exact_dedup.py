"""Exact duplicates through an extendible-hash index on shared files.

1. Each scanning task deletes white space from its texts, combines the equal texts it still holds
   in a bounded window, and appends one compressed copy of each to a text log in the shared folder.
   Only entries go on: key (64 bits of the SHA-256), place in the log, number of rows, best row.
   A group that fills the corpus is thus one entry for each window before anything is shuffled.
2. Entries are dealt by ranges of the key. The task that owns a range puts them into an extendible
   hash table: a directory of buckets, where a full bucket splits on its next bit and the directory
   doubles when the bucket is as deep as it. Entries of one key cannot be split and are chained.
3. Within a chain the owner compares the bytes in the logs, so a collision of keys never merges
   two texts. The table is saved next to the logs and can be searched later (`find`).
4. Rows learn their group's result by a join on their own entry, which has no hot key.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BLANKS, as_bytes, filesystem, shared_dir, slices, written

BUCKET = 64  # entries that a bucket holds before it splits
WINDOW = 16 << 20  # bytes of distinct texts that a scanning task keeps for combining

ROWS = "log string, row_no long, doc_id long, entry long, sha string, key long, size int, n long, best_len long, best_no long, is_entry boolean"
FOUND = "log string, entry long, keep_id long, group_size long, keep_log string, keep_no long"


def better(a: tuple, b: tuple) -> bool:
    """Whether row a (code points, doc_id or None, ...) stays rather than b: longer, then smaller id, null ids last."""
    return (-a[0], a[1] is None, a[1] or 0, a[2:]) < (-b[0], b[1] is None, b[1] or 0, b[2:])


class ExtendibleHash:
    """A directory of 2**depth bucket references; keys go by their lowest bits."""

    def __init__(self, capacity: int = BUCKET):
        self.capacity, self.depth = capacity, 0
        self.directory: list[list] = [[0, {}, 0]]  # local depth, chains by key, entries

    def insert(self, key: int, entry) -> None:
        bucket = self.directory[key & ((1 << self.depth) - 1)]
        bucket[1].setdefault(key, []).append(entry)
        bucket[2] += 1
        while bucket[2] > self.capacity and len(bucket[1]) > 1 and bucket[0] < 64:
            self._split(bucket)
            bucket = self.directory[key & ((1 << self.depth) - 1)]

    def _split(self, bucket: list) -> None:
        if bucket[0] == self.depth:
            self.directory = self.directory * 2
            self.depth += 1
        bit = bucket[0]
        halves = [[bit + 1, {}, 0], [bit + 1, {}, 0]]
        for key, chain in bucket[1].items():
            half = halves[key >> bit & 1]
            half[1][key] = chain
            half[2] += len(chain)
        low = next(iter(bucket[1])) & ((1 << bit) - 1)
        for i in range(low, len(self.directory), 1 << bit):
            self.directory[i] = halves[i >> bit & 1]

    def chain(self, key: int) -> list:
        return self.directory[key & ((1 << self.depth) - 1)][1].get(key, [])

    def buckets(self) -> list[list]:
        return list({id(b): b for b in self.directory}.values())

    def save(self, out, logs: list[str]) -> None:
        """Depth, log names, one bucket number for each directory slot, then the buckets.
        An entry is saved as key, log number, offset, size."""
        buckets = self.buckets()
        number = {id(b): i for i, b in enumerate(buckets)}
        names = "\n".join(logs).encode()
        out.write(struct.pack("<4q", self.depth, len(buckets), len(logs), len(names)) + names)
        out.write(np.array([number[id(b)] for b in self.directory], "<u4").tobytes())
        of = {x: i for i, x in enumerate(logs)}
        rows = [np.array([(k, of[e[0]], e[1], e[2]) for k, c in b[1].items() for e in c], "<u8").reshape(-1, 4) for b in buckets]
        out.write(np.cumsum([0, *map(len, rows)]).astype("<u8").tobytes())
        for x in rows:
            out.write(x.tobytes())


def find(path: str, key: int) -> list[tuple[str, int, int]]:
    """Places (log, offset, size) that a saved table has for a key, reading one bucket."""
    fs, p = filesystem(path)
    with fs.open_input_file(p) as f:
        depth, n, n_logs, size = struct.unpack("<4q", f.read(32))
        logs = f.read(size).decode().split("\n") if n_logs else []
        at = 32 + size
        f.seek(at + 4 * (key & ((1 << depth) - 1)))
        (b,) = struct.unpack("<I", f.read(4))
        at += 4 << depth
        f.seek(at + 8 * b)
        lo, hi = struct.unpack("<2Q", f.read(16))
        f.seek(at + 8 * (n + 1) + 32 * lo)
        rows = np.frombuffer(f.read(32 * (hi - lo)), "<u8").reshape(-1, 4)
    return [(logs[int(r[1])], int(r[2]), int(r[3])) for r in rows if int(r[0]) == key]


class Logs:
    """Random reads from text logs, with few files open at a time."""

    def __init__(self, folder: str, keep: int = 32):
        self.fs, self.path = filesystem(folder)
        self.open, self.keep, self.zstd = OrderedDict(), keep, zstandard.ZstdDecompressor()

    def text(self, log: str, offset: int, size: int) -> bytes:
        f = self.open.pop(log, None) or self.fs.open_input_file(f"{self.path}/{log}")
        self.open[log] = f
        if len(self.open) > self.keep:
            self.open.popitem(last=False)[1].close()
        f.seek(offset)
        return self.zstd.decompress(f.read(size))


def _scan(folder: str, key_bits: int, window: int):
    def run(batches):
        log = uuid.uuid4().hex
        fs, path = filesystem(folder)
        out, at, row_no = None, 0, 0
        zstd = zstandard.ZstdCompressor(level=1)
        held: OrderedDict[bytes, list] = OrderedDict()  # digest: text, then the entry
        held_bytes = 0
        schema = pa.schema([("log", pa.string()), ("row_no", pa.int64()), ("doc_id", pa.int64()), ("entry", pa.int64()), ("sha", pa.string()), ("key", pa.int64()), ("size", pa.int32()), ("n", pa.int64()), ("best_len", pa.int64()), ("best_no", pa.int64()), ("is_entry", pa.bool_())])

        def block(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

        def entry_row(x):
            best = x["best"]
            return (log, None, best[1], x["at"], None, x["key"], x["size"], x["n"], best[0], best[2], True)

        for batch in batches:
            for part in slices(batch, "text"):
                lengths = pc.fill_null(pc.utf8_length(part.column("text")), 0).to_pylist()
                rows = []
                for doc_id, text, points in zip(part.column("doc_id").to_pylist(), as_bytes(part.column("text")), lengths):
                    text = text.translate(None, BLANKS)
                    digest = hashlib.sha256(text)
                    sha = digest.digest()
                    x = held.get(sha)
                    if x is None or x["text"] != text:
                        if out is None:
                            fs.create_dir(path, recursive=True)
                            out = fs.open_output_stream(f"{path}/{log}", compression=None)
                        packed = zstd.compress(text)
                        key = int.from_bytes(sha[:8], "little", signed=True) & ((1 << key_bits) - 1) if key_bits < 64 else int.from_bytes(sha[:8], "little", signed=True)
                        out.write(packed)
                        if x is not None:
                            rows.append(entry_row(x))
                            held_bytes -= len(x["text"])
                        x = held[sha] = {"text": text, "at": at, "size": len(packed), "key": key, "n": 0, "best": (points, doc_id, row_no)}
                        at += len(packed)
                        held_bytes += len(text)
                        while held_bytes > window and len(held) > 1:
                            old = held.pop(next(iter(held)))
                            held_bytes -= len(old["text"])
                            rows.append(entry_row(old))
                    x["n"] += 1
                    if better((points, doc_id, row_no), x["best"]):
                        x["best"] = (points, doc_id, row_no)
                    rows.append((log, row_no, doc_id, x["at"], digest.hexdigest(), None, None, None, None, None, False))
                    row_no += 1
                if rows:
                    yield block(rows)
        if held:
            yield block([entry_row(x) for x in held.values()])
        if out is not None:
            out.close()

    return run


def _own(folder: str, capacity: int):
    def run(batches):
        table, name = ExtendibleHash(capacity), uuid.uuid4().hex
        names = set()
        for batch in batches:
            c = {k: batch.column(k).to_pylist() for k in ("log", "entry", "size", "key", "n", "best_len", "doc_id", "best_no")}
            for log, entry, size, key, n, points, doc_id, no in zip(*c.values()):
                names.add(log)
                table.insert(key & (1 << 64) - 1, (log, entry, size, n, (points, doc_id, log, no)))
        if not names:
            return
        fs, path = filesystem(folder)
        fs.create_dir(f"{path}/index", recursive=True)
        with fs.open_output_stream(f"{path}/index/{name}", compression=None) as out:
            table.save(out, sorted(names))
        logs, rows = Logs(folder), []
        for bucket in table.buckets():
            for chain in bucket[1].values():
                groups: list[list] = []  # text, its entries
                for e in chain if len(chain) > 1 else ():
                    text = logs.text(*e[:3])
                    same = next((g for g in groups if g[0] == text), None)
                    if same is None:
                        groups.append(same := [text, []])
                    same[1].append(e)
                for _, own in groups or [(None, chain)]:
                    best = own[0][4]
                    for e in own[1:]:
                        if better(e[4], best):
                            best = e[4]
                    n = sum(e[3] for e in own)
                    rows += [(e[0], e[1], best[1], n, best[2], best[3]) for e in own]
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
        names = ["log", "entry", "keep_id", "group_size", "keep_log", "keep_no"]
        for i in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 10_000]), types)], names=names)

    return run


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, capacity: int = BUCKET, key_bits: int = 64, window: int = WINDOW) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of `docs`.

    Texts are equal when they are identical without ASCII white space. Of equal texts the row with
    the most code points stays, then the smallest id. Null texts count as empty, null ids as the
    largest. Of repeated rows of one id, exactly one is kept. Other columns are ignored, whatever
    their names; an empty table gives no rows. `row_col` (a long) is returned in place of the id's
    row and lets a caller filter the very rows; `key_bits` shortens keys, to test collisions.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark, "exact-dedup")
    ident = F.col(id_col).cast("long")
    source = docs.select(ident.alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if row_col:
        # the row's number rides in place of the id; ids are joined back below
        source = docs.select(F.struct(ident.alias("i"), F.col(row_col).cast("long").alias("r")).alias("x"), F.col(text_col).cast("string").alias("text"))
        source = source.select(F.col("x.i").alias("doc_id"), "text", F.col("x.r").alias("row"))
    run, schema = _scan(f"{folder}/logs", key_bits, window), ROWS
    if row_col:
        run, schema = _with_row(run), ROWS + ", row long"
    rows = written(source.mapInArrow(run, schema), f"{folder}/rows")
    entries = rows.where("is_entry").drop("is_entry", "row_no", "sha")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = entries.repartitionByRange(parts, "key").mapInArrow(_own(f"{folder}/logs", capacity), FOUND)
    members = rows.where(~F.col("is_entry")).select("log", "row_no", "doc_id", "entry", "sha", *(["row"] if row_col else []))
    return members.join(found, ["log", "entry"]).select(
        "doc_id", "keep_id", "group_size",
        ((F.col("log") == F.col("keep_log")) & (F.col("row_no") == F.col("keep_no"))).alias("kept"),
        F.col("sha").alias("text_sha256"), *(["row"] if row_col else []),
    )


def _with_row(run):
    """The scan with the caller's row numbers beside the rows it gives for documents."""

    def wrapped(batches):
        pending: list = []

        def tap():
            for b in batches:
                pending.extend(b.column("row").to_pylist())
                yield b

        for out in run(tap()):
            flags = out.column("is_entry").to_pylist()
            n = len(flags) - sum(flags)
            own = iter(pending[:n])
            del pending[:n]
            yield out.append_column("row", pa.array([None if f else next(own) for f in flags], pa.int64()))

    return wrapped
