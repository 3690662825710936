"""WARC archives with an index that is written first.

Writing: each task streams its records into one archive in the shared folder, a gzip member for each
record, and returns an index row for each: archive, offset, length, URL, payload digest. Equal payloads
are one response and revisits of it, settled beforehand on digests alone (pre-aggregated, so a payload
that fills the table is one row for each task). What was settled for the repeated digests goes to the
writing tasks by broadcast while it is known to be small, so that no payload is shuffled; beyond that
by a join, of which the planner can split a hot digest's partition.

Reading: index rows are selected first, with DataFrame operations; what was selected is dealt by
stretches of the archives, sorted by offset, and neighbouring ranges are read at once.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import as_bytes, filesystem, shared_dir, slices, written

GAP = 64 << 10  # bytes between two selected records that are read along
READ = 8 << 20  # bytes of one read at most (but for a longer record)
BROADCAST = 64 << 20  # bytes of repeated digests, with id and URL of their responses, up to which they are broadcast
STRETCH = 32 << 20  # bytes of an archive that one reading task gets together
DATE = "2000-01-01T00:00:00Z"  # records carry no clock time, so that reruns write the same bytes

INDEX = "archive string, offset long, length long, url string, digest string, page_id long, record_type string"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest}')}>"


def clean(url: str | None) -> str:
    """A URL on one header line: control characters and blanks are percent-encoded."""
    return "urn:unknown" if not url else "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def render(page_id, url, payload: bytes, digest: str, keep_id, keep_url) -> bytes:
    """One record. keep_id: of the response that this page revisits, or None for a response.
    A revisit has the HTTP header alone; the payload's length stands in it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if keep_id is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if keep_id is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {clean(url)}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if keep_id is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(keep_id, digest)}", f"WARC-Refers-To-Target-URI: {clean(keep_url)}", f"WARC-Refers-To-Date: {DATE}", f"X-Refers-To-Page-Id: {keep_id}",
        ]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse(record: bytes) -> dict:
    """Headers by lower-case name, `block`, and for HTTP messages `http` and `payload`."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    out: dict = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    out["block"] = rest[: int(out["content-length"])]
    http, _, out["payload"] = out["block"].partition(b"\r\n\r\n")
    out["http"] = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}
    return out


def _write(folder: str):
    names = ["archive", "offset", "length", "url", "digest", "page_id", "record_type"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]

    def run(batches):
        fs, path = filesystem(folder)
        archive, out, at = f"{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            for part in slices(batch, "payload"):
                rows = []
                fields = (part.column(k).to_pylist() for k in ("page_id", "url", "hex", "keep_id", "keep_url"))
                for payload, page_id, url, digest, keep_id, keep_url in zip(as_bytes(part.column("payload")), *fields):
                    digest = base64.b32encode(bytes.fromhex(digest)).decode()
                    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
                    data = squeeze.compress(render(page_id, url, payload, digest, keep_id, keep_url)) + squeeze.flush()
                    if out is None:
                        fs.create_dir(path, recursive=True)
                        out = fs.open_output_stream(f"{path}/{archive}", compression=None)
                    out.write(data)
                    rows.append((archive, at, len(data), url, digest, page_id, "response" if keep_id is None else "revisit"))
                    at += len(data)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
        if out is not None:
            out.close()

    return run


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Write a record for each row of `pages` under `folder` and return the index (kept there as Parquet).

    Of equal payloads, that with the largest id is response, the others revisit it; rows that repeat
    that very id are responses too, as are all where every id is null. A null body is an empty payload.
    A null URL is kept null in the index. Other columns are ignored; an empty table gives an empty index.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(body_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("hex", F.sha1("payload"))
    best = F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url")))
    keep = rows.groupBy("hex").agg(best.alias("best"), F.count("*").alias("n")).where("n > 1").select("hex", F.col("best.page_id").alias("best_id"), F.col("best.url").alias("best_url"))
    keep = written(keep, f"{folder}/repeated")
    size = keep.agg(F.sum(F.lit(120) + 4 * F.coalesce(F.length("best_url"), F.lit(0)).cast("long"))).first()[0] or 0
    known = rows.join(F.broadcast(keep) if size <= BROADCAST else keep, "hex", "left")
    other = F.col("best_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("best_id"))
    known = known.select("page_id", "url", "payload", "hex", F.when(other, F.col("best_id")).alias("keep_id"), F.when(other, F.col("best_url")).alias("keep_url"))
    return written(known.mapInArrow(_write(f"{folder}/archives"), INDEX), f"{folder}/index")


def _read(folder: str, verify: bool):
    names = [f.split()[0] for f in RECORD.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def records(run, f):
        f.seek(run[0][1])
        data = f.read(run[-1][1] + run[-1][2] - run[0][1])
        for _, offset, length, url in run:
            at = offset - run[0][1]
            r = parse(zlib.decompress(data[at : at + length], 31))
            digest, payload = r["warc-payload-digest"].removeprefix("sha1:"), r["payload"]
            response = r["warc-type"] == "response"
            if verify and response and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                raise ValueError(f"payload of {r['warc-record-id']} does not have its digest")
            number = lambda k: int(r[k]) if k in r else None
            yield number("x-page-id"), url, r["warc-type"], number("x-refers-to-page-id"), len(payload) if response else int(r["http"]["content-length"]), digest, payload if response else None

    def run(batches):
        fs, path = filesystem(folder)
        now, f, pending, rows = None, None, [], []
        for batch in batches:
            for x in [*zip(*(batch.column(k).to_pylist() for k in ("archive", "offset", "length", "url")))]:
                if pending and (x[0] != pending[-1][0] or x[1] > pending[-1][1] + pending[-1][2] + GAP or x[1] + x[2] - pending[0][1] > READ):
                    yield from batched(records(pending, f), rows)
                    pending = []
                if x[0] != now:
                    if f:
                        f.close()
                    now, f = x[0], fs.open_input_file(f"{path}/{x[0]}")
                pending.append(x)
        if pending:
            yield from batched(records(pending, f), rows)
        if f:
            f.close()

    def batched(found, rows):
        size = 0
        for r in found:
            rows.append(r)
            size += len(r[-1] or b"")
            if size > 4 << 20:
                yield block(rows)
                rows.clear()
                size = 0
        if rows:
            yield block(rows)
            rows.clear()

    def block(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return run


def read_records(spark: SparkSession, index: DataFrame, folder: str, verify: bool = True) -> DataFrame:
    """The records that the rows of `index` name: page_id, url, record_type, refers_to, payload_bytes,
    payload_digest, payload (null for revisits). A response whose payload lacks its digest is an error."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stretch = F.floor(F.col("offset") / STRETCH)
    chosen = index.select("archive", "offset", "length", "url").withColumn("stretch", stretch)
    chosen = chosen.repartition(parts, "archive", "stretch").sortWithinPartitions("archive", "offset")
    return chosen.mapInArrow(_read(f"{folder}/archives", verify), RECORD)


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each page's record, written
    and read back; see `write_archives` for odd rows. Payloads of any length are written whole."""
    spark = pages.sparkSession
    folder = shared_dir(spark, "warc")
    index = write_archives(pages, folder)
    return read_records(spark, index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
