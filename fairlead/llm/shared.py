"""What the corpus operators have in common: the shared folder, files in it, text batches."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the bytes class [\x20\x09-\x0D].
BLANKS = b" \t\n\x0b\x0c\r"
#: Bytes of text that are worked on at once in a Python worker.
SLICE_BYTES = 4 << 20


_within: ContextVar[str | None] = ContextVar("within", default=None)


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder that the driver and all executors see, as a URI.

    It lies in spark.checkpoint.dir. Where that is unset, a local master gets a folder of its own, which is
    deleted at exit; on a cluster it is an error, for a folder of the driver's machine is none of the executors'.
    """
    base = _within.get() or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        own = tempfile.mkdtemp(prefix="fairlead-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        base = f"file://{own}"
        spark.sparkContext.setCheckpointDir(base)
    if "://" not in base and not base.startswith("file:"):
        base = f"file://{base}"
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def release(spark: SparkSession, folder: str) -> None:
    """Delete a folder of ours whose rows are not needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@contextmanager
def workspace(spark: SparkSession, label: str):
    """Shared folders made within it lie in it, and go with it at the end: what is to stay must be written elsewhere."""
    folder = shared_dir(spark, label)
    token = _within.set(folder)
    try:
        yield folder
    finally:
        _within.reset(token)
        release(spark, folder)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI and the path in it."""
    if uri.startswith("file:"):
        path = uri[5:]
        return pafs.LocalFileSystem(), "/" + path.lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def written(df: DataFrame, path: str) -> DataFrame:
    """The rows after one pass to Parquet in the shared folder: later reads do not repeat the work,
    lose nothing with an executor, and start from a short lineage."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold_of(column: str):
    """crc32 of the id as text, modulo 5; a null id reads as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 5


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """Cuts of a batch with about `limit` bytes of text each (one longer text is a cut of its own)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def joined_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an array of texts, one after another, and each text's end; null counts as empty."""
    texts = pc.fill_null(texts, "" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    texts = texts.cast(pa.large_binary())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if texts.buffers()[2] is None:
        return np.empty(0, np.uint8), np.zeros(len(texts), np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets[1:] - offsets[0]


def as_bytes(texts: pa.Array) -> list[bytes]:
    """Each text's UTF-8; null counts as empty."""
    return [x or b"" for x in texts.cast(pa.binary()).to_pylist()]
