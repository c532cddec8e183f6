"""Document fingerprints (operator 10): context-triggered piecewise hashing.

A rolling hash over seven bytes ends a chunk where it is -1 modulo the block size; each chunk gives one
character. A fingerprint holds the signatures at its block size and at twice that, so texts whose block sizes
differ by a factor of two can still be compared, by edit distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _BYTE, _powers, grown, mix64, slices, stage, table

WINDOW, LEAST_BLOCK, CHARS, MOST, GRAM = 7, 3, 64, 96, 7
_ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_PLACES = 1 << 16
_SHIFT = [np.uint32(5 * k) for k in range(WINDOW)]


def _rolling(padded: np.ndarray) -> np.ndarray:
    """The hash of the last seven bytes, at each byte after the first seven."""
    n = len(padded) - WINDOW
    b = padded.astype(np.uint32)
    total, weighted, xored = (np.zeros(n, np.uint32) for _ in range(3))
    for k in range(WINDOW):
        last = b[WINDOW - k : WINDOW - k + n]
        total += last
        weighted += last * np.uint32(WINDOW - k)
        xored ^= last << _SHIFT[k]
    return total + weighted + xored


def _signature(chars: np.ndarray, ends: np.ndarray, size: int, values: np.ndarray) -> str:
    starts = np.concatenate([[0], ends + 1]) if not len(ends) or ends[-1] + 1 < size else np.concatenate([[0], ends[:-1] + 1])
    place = (np.arange(size) - np.repeat(starts, np.diff(np.append(starts, size)))) & (_PLACES - 1)
    sums = np.add.reduceat(values * _powers(_PLACES)[place], starts)
    return chars[(mix64(sums + np.uint64(1)) >> np.uint64(58)).astype(np.int64)].tobytes().decode()


def fingerprints(texts: list[bytes]) -> list[str]:
    """A fingerprint "size:signature:signature" for each text; of equal texts, equal ones. The block size is the
    least of 3, 6, 12... by which the text has at most 64 blocks, doubled while it has over 96 chunks."""
    padded = np.frombuffer(bytes(WINDOW) + bytes(WINDOW).join(texts), np.uint8)
    rolled = _rolling(padded)
    out, at = [], 0
    for text in texts:
        n = len(text)
        if not n:
            out.append(f"{LEAST_BLOCK}::")
        else:
            own, values = rolled[at : at + n], _BYTE[padded[at + WINDOW : at + WINDOW + n]]
            size = LEAST_BLOCK
            while size * CHARS < n:
                size *= 2
            ends = np.flatnonzero(own % np.uint32(size) == size - 1)
            while len(ends) > MOST:
                size *= 2
                ends = ends[own[ends] % np.uint32(size) == size - 1]
            more = ends[own[ends] % np.uint32(2 * size) == 2 * size - 1]
            out.append(f"{size}:{_signature(_ALPHABET, ends, n, values)}:{_signature(_ALPHABET, more, n, values)}")
        at += n + WINDOW
    return out


def common_subsequence(a: str, b: str) -> int:
    """The length of the longest common subsequence, by bit-parallel dynamic programming."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = state = (1 << len(a)) - 1
    for c in b:
        hit = state & masks.get(c, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count()


def _signature_likeness(a: str, b: str) -> float:
    """1 less the edit distance (insertions and deletions) over both lengths; 0 without a common run."""
    if a == b:
        return 1.0 if a else 0.0
    k = min(GRAM, len(a), len(b))
    if not k or {a[i : i + k] for i in range(len(a) - k + 1)}.isdisjoint(b[i : i + k] for i in range(len(b) - k + 1)):
        return 0.0
    return 2 * common_subsequence(a, b) / (len(a) + len(b))


def likeness(one: str, two: str) -> float:
    """0 to 1; 1 for equal fingerprints, 0 where block sizes differ by more than a factor of two."""
    if one == two:
        return 1.0
    (n, a, a2), (m, b, b2) = one.split(":"), two.split(":")
    if int(n) == int(m):
        return max(_signature_likeness(a, b), _signature_likeness(a2, b2))
    if int(n) == 2 * int(m):
        return _signature_likeness(a, b2)
    if 2 * int(n) == int(m):
        return _signature_likeness(a2, b)
    return 0.0


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "__dg_text"):
        prints = fingerprints([t or b"" for t in batch.column("__dg_text").cast(pa.binary()).to_pylist()])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints, pa.string())], [*batch.schema.names, "fingerprint"])


def add_fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a column fingerprint (a given one gives way). A null text counts as empty."""
    docs = docs.drop("fingerprint").withColumn("__dg_text", F.col(text).cast("string"))
    return docs.mapInArrow(_fingerprint_batches, grown(docs.schema, fingerprint=T.StringType())).drop("__dg_text")


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_FIELDS = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
_EDGE = [("kind", pa.int32()), ("part", pa.int32()), ("text", pa.string())]


def _compared(rows: list[tuple[int | None, str, str, str, str]]) -> list[list]:
    """rows: (doc_id, text, fingerprint, next text, next fingerprint). The columns of _FIELDS."""
    changed = [edited(r[1], r[3]).encode() for r in rows]
    prints = fingerprints(changed) if rows else []
    return [
        [r[0] for r in rows], [len(r[1]) for r in rows], [hashlib.sha256(x).hexdigest() for x in changed], [r[2] for r in rows], prints,
        [likeness(r[2], p) for r, p in zip(rows, prints, strict=True)], [likeness(r[2], r[4]) for r in rows],
    ]


def _batch(columns: list[list], extra: list[list]) -> pa.RecordBatch:
    fields = [*_FIELDS, *_EDGE]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip([*columns, *extra], fields, strict=True)], [n for n, _ in fields])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In a sorted partition: finished rows (kind 0), and its first (1) and last row (2) with their texts."""
    part = TaskContext.get().partitionId()
    held = None
    for batch in slices(batches, "text"):
        texts = [t or "" for t in batch.column("text").to_pylist()]
        prints = fingerprints([t.encode() for t in texts])
        rows = list(zip(batch.column("doc_id").to_pylist(), texts, prints, strict=True))
        if held is None:
            d, t, p = rows[0]
            yield _batch([[d], [len(t)], [None], [p], [None], [None], [None]], [[1], [part], [t]])
        else:
            rows.insert(0, held)
        held = rows[-1]
        done = [(*a, b[1], b[2]) for a, b in zip(rows, rows[1:], strict=False)]
        yield _batch(_compared(done), [[0] * len(done), [part] * len(done), [None] * len(done)])
    if held is not None:
        d, t, p = held
        yield _batch([[d], [len(t)], [None], [p], [None], [None], [None]], [[2], [part], [t]])


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = list(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "fingerprint", "next_text", "next_fingerprint")), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(_compared(rows), _FIELDS, strict=True)], [n for n, _ in _FIELDS])


def compare_with_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document, of its text with the last half taken from the next document's start, and
    how like it these and the next document are.

    Documents (doc_id, text) are put in order by ranges of the id, rows with the same id by their text's hash (so
    repeated rows follow each other), null ids first; after the last comes the first. A null text counts as empty; a
    single document is its own next; an empty table gives no rows. Only a partition's first and last rows leave it.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    done = stage(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_neighbours, f"{_OUT}, kind int, part int, text string"), "prints")
    names = [n for n, _ in _FIELDS]
    parts = sorted(r["part"] for r in done.where("kind = 1").select("part").collect())  # as many as partitions
    follows = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, next_part int")
    first = done.where("kind = 1").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    last = done.where("kind = 2").select("doc_id", "part", "text", "fingerprint").join(follows, "part").join(first, "next_part")
    return done.where("kind = 0").select(*names).unionByName(last.select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint").mapInArrow(_edges, _OUT))


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a row of documents, repeated ones too, as compare_with_edited says: a null text counts as empty, rows alike
    in doc_id follow each other by a hash of their texts. An empty table gives no rows. Columns but doc_id and text aren't read."""
    return compare_with_edited(table(spark, sf_dir, "documents"))
