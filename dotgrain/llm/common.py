"""Shared helpers: table access, staging in the shared folder, Arrow batches, word hashing."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MASK64 = (1 << 64) - 1


#: What Spark may hand to a Python worker at once; its own default of 64 MB is held several times over by each worker.
BATCH_BYTES = "2m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where it is unset (tests), a temporary one is set. On a cluster, whose
    machines don't share such a folder, it has to be set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jdir.isDefined():
            return jdir.get()
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir isn't set: it has to name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="dotgrain-")
        spark.sparkContext.setCheckpointDir(path)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return path


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage, survives lost executors.

    The files go when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/dotgrain-{tag}-{uuid.uuid4().hex}"
    jvm, jsc = spark._jvm, spark.sparkContext._jsc
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(jsc.hadoopConfiguration()).deleteOnExit(target)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def grown(schema: T.StructType, **more: T.DataType) -> T.StructType:
    """A schema with further fields (StructType.add would change the one of the frame it came from)."""
    return T.StructType([*schema.fields, *(T.StructField(k, v) for k, v in more.items())])


def remainder(doc_id: str, k: int):
    """crc32 of doc_id as text, mod k (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % k


try:
    _LIBC = ctypes.CDLL("libc.so.6")
except OSError:  # another C library: freed memory stays with the process
    _LIBC = None


def tidy() -> None:
    """Gives freed memory back to the system. Python workers stay for later stages, and each would keep its peak."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


_KEPT: dict[str, dict] = {}


def kept(owner: str) -> dict:
    """What an operator keeps in a Python worker from task to task. Workers are shared by all stages, so other
    operators' things go."""
    for other in [k for k in _KEPT if k != owner]:
        del _KEPT[other]
    return _KEPT.setdefault(owner, {})


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20, owner: str = "") -> Iterator[pa.RecordBatch]:
    """Cut batches so that one slice holds about max_bytes of the column's text (one row at least). owner: whose
    things the worker keeps meanwhile."""
    kept(owner)
    for n, batch in enumerate(batches):
        if n % 8 == 7:
            tidy()
        if batch.num_rows == 0:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
            yield batch.slice(at, stop - at)
            at = stop
        del batch
    tidy()


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the offsets of its rows (null: empty)."""
    array = pc.fill_null(array, "")
    if array.type not in (pa.large_string(), pa.string()):
        array = array.cast(pa.string())
    wide = np.int64 if array.type == pa.large_string() else np.int32
    _, offsets, data = array.buffers()
    offs = np.frombuffer(offsets, wide)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_POW = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POW
    if len(_POW) < n:
        grown = np.full(max(n, 4096), 0x100000001B3, np.uint64)
        grown[0] = 1
        _POW = np.cumprod(grown, dtype=np.uint64)
    return _POW


def word_hashes(raw: np.ndarray, offsets: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts laid end to end: their 64-bit hashes, the index of each text's first word (one more entry
    than texts), and the words' first and past-the-last bytes. A word is a run of bytes not in [\\x20\\x09-\\x0D];
    with keep, a run of bytes for which keep[byte] holds."""
    inside = ~_SPACE[raw] if keep is None else keep[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < len(raw))]
    first[cuts] = inside[cuts]
    starts = np.flatnonzero(first)
    per = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), per, starts, starts
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    before = cuts - 1
    last[before] = inside[before]
    ends = np.flatnonzero(last) + 1
    lengths = ends - starts
    total = int(lengths.sum())
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    where = np.arange(total, dtype=np.int64) + shift
    place = where - np.repeat(starts, lengths)
    values = _BYTE[raw[where]] * _powers(int(lengths.max()) + 1)[place]
    sums = np.add.reduceat(values, np.cumsum(lengths) - lengths)
    return mix64(sums + lengths.astype(np.uint64)), per, starts, ends


def shingle_hashes(words: np.ndarray, per: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words within a text, and each text's first index. A text with fewer words, but some,
    has one shingle of all of them."""
    counts = np.diff(per)
    runs = np.where(counts >= n, counts - n + 1, (counts > 0).astype(counts.dtype))
    starts = np.concatenate([[0], np.cumsum(runs)])
    if not runs.sum():
        return np.zeros(0, np.uint64), starts
    at = np.arange(starts[-1]) - np.repeat(starts[:-1], runs) + np.repeat(per[:-1], runs)
    end = np.repeat(per[1:], runs)
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        inside = at + k < end
        w = words[np.minimum(at + k, len(words) - 1)]
        step = mix64(w + np.uint64(((k + 1) * 0x9E3779B97F4A7C15) & MASK64))
        out = np.where(inside, out * np.uint64(0x9FB21C651E98DF25) + step, out)
    return mix64(out), starts

