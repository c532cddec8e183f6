"""Embedding near-dedup (operator 8): randomised-rotation binary codes with stored correction factors.

A vector is stored once as a code: the signs of its randomly rotated form, the correction factor <signs, vector>, and
the vector itself in bytes, with what rounding to bytes took. Dividing the signs' inner product with another vector
by the factor gives an unbiased estimate of the vectors' cosine; the error bound, at BOUND standard deviations and the
rounding, decides. Codes meet in buckets: a label of up to WHOLE blocks of vectors is one, compared by blocks (fewer
copies of a code than bands would need); of larger ones each bucket is a band of further sign bits, how many bits and
bands follows from the label's own size and the recall wanted at the threshold. A pair is looked at in the first band that it shares. Only vectors that a bound can't rule out are sent to their buckets
themselves, where cosines are recomputed exactly, in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table
from .graph import components, lowest, tasks

COSINE, RECALL, BUCKET, BLOCK, WHOLE = 0.93, 0.9995, 2048, 4096, 4
CODE_BITS, BOUND, MOST_BITS = 128, 4.5, 40


@lru_cache(maxsize=8)
def rotation(dim: int, n: int, seed: int) -> np.ndarray:
    """n random directions, orthonormal by blocks of dim, so that codes of each block come from a rotation."""
    r = np.random.default_rng([seed, dim])
    blocks = [np.linalg.qr(r.standard_normal((dim, dim)))[0] for _ in range(-(-n // dim))]
    return np.concatenate(blocks, 1)[:, :n]


def bands(bits: int, cosine: float = COSINE, recall: float = RECALL) -> int:
    """Bands of so many bits that RECALL needs at the threshold."""
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return 1 if same >= recall else math.ceil(math.log(1 - recall) / math.log(1 - same))


def band_bits(n: Column) -> Column:
    """Bits a band for a label of n vectors: none up to WHOLE blocks, then as many as make buckets of about BUCKET."""
    return F.when(n <= WHOLE * BLOCK, 0).otherwise(F.least(F.lit(MOST_BITS), F.greatest(F.lit(1), F.ceil(F.log2(n / BUCKET))))).cast("int")


def band_codes(x: np.ndarray, bits: int, n: int) -> np.ndarray:
    if not bits:
        return np.zeros((len(x), n), np.int64)
    signs = (x @ rotation(x.shape[1], bits * n, 11) >= 0).reshape(len(x), n, bits)
    return (signs * (1 << np.arange(bits, dtype=np.int64))).sum(2)


def code_bits(dim: int) -> int:
    return -(-max(CODE_BITS, dim) // dim) * dim


def turn(x: np.ndarray) -> np.ndarray:
    """The rotated form: code_bits coordinates of several rotations, scaled to keep lengths."""
    n = code_bits(x.shape[1])
    return x @ rotation(x.shape[1], n, 7) / math.sqrt(n / x.shape[1])


def encode(x: np.ndarray) -> np.ndarray:
    """Codes of rows of length 1, as rows of bytes: correction factor, scale and rounding error (float32), packed signs,
    the vector in bytes."""
    turned = turn(x)
    factor = np.maximum(np.abs(turned).sum(1) / math.sqrt(turned.shape[1]), 1e-9)
    scale = np.abs(x).max(1) / 127
    rounded = np.rint(x / scale[:, None]).astype(np.int8)
    scale = scale.astype(np.float32)
    error = np.sqrt(((x - rounded * scale[:, None].astype(np.float64)) ** 2).sum(1)) * (1 + 1e-6) + 1e-9
    head = np.stack([factor, scale, error], 1).astype("<f4").view(np.uint8)
    return np.concatenate([head, np.packbits(turned >= 0, axis=1), rounded.view(np.uint8)], 1)


def decode(codes: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Correction factors, rounding errors, signs (+-1 / sqrt(bits)) and the vectors as rounded."""
    n = code_bits(dim)
    factor, scale, error = np.ascontiguousarray(codes[:, :12]).view("<f4").T.astype(np.float64)
    signs = np.unpackbits(codes[:, 12 : 12 + -(-n // 8)], axis=1, count=n).astype(np.float32) * 2 - 1
    return factor, error, signs / np.float32(math.sqrt(n)), codes[:, -dim:].view(np.int8) * scale[:, None]


def estimate(turned: np.ndarray, signs: np.ndarray, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimates of the cosines of all rows of turned with all coded ones, and the error's bound for each coded."""
    bits = signs.shape[1]
    return turned @ signs.T / factor, BOUND * np.sqrt(np.maximum(0, 1 - factor**2) / (factor**2 * max(1, bits - 1)))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return np.asarray(column.flatten()).astype(np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(1, keepdims=True)  # no overflow or underflow in the squares
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def _sides(t: pa.Table, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    side = np.asarray(t.column("side").combine_chunks())
    return np.flatnonzero(side == 0), np.flatnonzero((side == 1) if i != j else (side == 0))


def _first_band(codes: np.ndarray, band: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return ~(codes[u, :band] == codes[v, :band]).any(1) if band else np.ones(len(u), bool)


def sift(key: tuple, t: pa.Table, cosine: float) -> pa.Table:
    """Of one task the vectors with a partner that the bound doesn't rule out."""
    _, band, bits, i, j = (k.as_py() for k in key)
    dim = t.column("length")[0].as_py()
    codes = np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint8).reshape(t.num_rows, -1)
    factor, error, signs, x = decode(codes, dim)
    a, b = _sides(t, i, j)
    turned, own = turn(x).astype(np.float32), band_codes(x, bits, band) if band else np.zeros((len(x), 0), np.int64)
    got = np.zeros(len(x), bool)
    for at in range(0, len(a), 256):
        rows = a[at : at + 256]
        guess, bound = estimate(turned[rows], signs[b], factor[b])
        p, q = np.nonzero(guess + bound + error[rows][:, None] >= cosine)
        p, q = rows[p], b[q]
        fresh = p < q if i == j else np.ones(len(p), bool)
        p, q = p[fresh], q[fresh]
        for lo in range(0, len(p), 65_536):
            u, v = p[lo : lo + 65_536], q[lo : lo + 65_536]
            first = _first_band(own, band, u, v)
            got[u[first]] = got[v[first]] = True
    return t.select(["bucket", "band", "bits", "i", "j", "side", "key"]).filter(pa.array(got))


def compare(key: tuple, t: pa.Table, cosine: float) -> pa.Table:
    """One task: each vector's linked rows there, and the least key that it reaches by links there."""
    _, band, bits, i, j = (k.as_py() for k in key)
    keys, copies = (np.asarray(t.column(c).combine_chunks()) for c in ("key", "copies"))
    x = _unit(_matrix(t.column("embedding")))
    a, b = _sides(t, i, j)
    own = band_codes(decode(encode(x), x.shape[1])[3], bits, band) if band else np.zeros((len(x), 0), np.int64)
    links, least = np.zeros(len(keys), np.int64), keys.copy()
    pairs = []
    for at in range(0, len(a), 256):
        rows = a[at : at + 256]
        p, q = np.nonzero(x[rows] @ x[b].T >= cosine)
        p, q = rows[p], b[q]
        fresh = p < q if i == j else np.ones(len(p), bool)
        p, q = p[fresh], q[fresh]
        for lo in range(0, len(p), 65_536):
            u, v = p[lo : lo + 65_536], q[lo : lo + 65_536]
            first = _first_band(own, band, u, v)
            u, v = u[first], v[first]
            links += np.bincount(u, copies[v], len(keys)).astype(np.int64) + np.bincount(v, copies[u], len(keys)).astype(np.int64)
            pairs.append(np.stack([u, v]).astype(np.int32))
    if pairs:
        least = lowest(keys, np.concatenate(pairs, 1))
    got = links > 0
    return pa.table({"key": pa.array(keys[got]), "links": pa.array(links[got]), "least": pa.array(least[got])})


def _by_length(lengths: np.ndarray) -> Iterator[np.ndarray]:
    for length in np.unique(lengths):
        yield np.flatnonzero(lengths == length)


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column("embedding")
        lengths = np.asarray(pa.compute.list_value_length(column))
        names = [c for c in batch.schema.names if c != "embedding"]
        for at in _by_length(lengths):
            take = pa.array(at)
            codes = encode(_unit(_matrix(pa.chunked_array([column.take(take)]))))
            blobs = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((np.arange(len(at) + 1) * codes.shape[1]).astype(np.int32)), pa.py_buffer(codes.tobytes())])
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in names), blobs, pa.array(lengths[at], pa.int32())], [*names, "code", "length"])


def _dealt(batches: Iterator[pa.RecordBatch], count: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """A row for each band of a code's label."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths, bits = (np.asarray(batch.column(c)) for c in ("length", "bits"))
        for at in _by_length(lengths.astype(np.int64) << 8 | bits):
            dim, own_bits = int(lengths[at[0]]), int(bits[at[0]])
            n, part = count[own_bits], batch.take(pa.array(at))
            codes = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(len(at), -1)
            own = band_codes(decode(codes, dim)[3], own_bits, n)
            for band in range(n):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(at), band), pa.int32()), pa.array(own[:, band])], [*part.schema.names, "band", "bits_there"])


def link(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding, label).

    Rows with a null label, or a vector that is null, empty, zero, or holds null or non-finite values, link with nothing,
    nor do vectors of different lengths. Rows with the same label and vector are copies: one stands for all, and they
    link with each other. Repeated rows are vectors of their own. Null ids count as greatest.
    """
    kind = "float" if "float" in dict(vectors.dtypes)["embedding"] else "double"
    e = F.col("embedding").cast(f"array<{kind}>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding"), F.col("label"))
    odd = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    usable = F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", odd) & F.exists("embedding", lambda v: v != 0)
    key = F.xxhash64("label", F.transform("embedding", lambda v: F.when(v == 0, F.lit(0).cast(kind)).otherwise(v)))
    rows = rows.withColumn("key", F.when(F.coalesce(usable, F.lit(False)), key))
    slim = rows.where(F.col("key").isNotNull()).select("key", "vec_id", F.xxhash64("label").alias("of"), "embedding")
    coded = slim.mapInArrow(_encoded, "key long, vec_id long, of long, code binary, length int")
    codes = coded.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first"), F.first("of").alias("of"), F.first("code").alias("code"), F.first("length").alias("length"))
    codes = stage(codes, "codes")
    sizes = codes.groupBy("of").agg(band_bits(F.count(F.lit(1))).alias("bits"))
    count = {bits: bands(bits, cosine) for bits in range(MOST_BITS + 1)}

    spread = codes.select("key", "of", "code", "length").join(sizes, "of")
    spread = spread.mapInArrow(lambda it: _dealt(it, count), "of long, key long, code binary, length int, bits int, band int, bits_there long")
    spread = spread.withColumn("bucket", F.xxhash64("of", "band", "bits_there", "length")).drop("of", "bits_there")
    task = ["bucket", "band", "bits", "i", "j"]
    told = tasks(spread, BLOCK).groupBy(*task).applyInArrow(lambda k, t: sift(k, t, cosine), "bucket long, band int, bits int, i int, j int, side int, key long")
    told = stage(told, "candidates")
    wanted = codes.select("key", "copies", "first").join(told.select("key").distinct(), "key", "left_semi")
    exact = slim.select("key", "vec_id", "embedding").join(wanted, "key").where(F.col("vec_id").eqNullSafe(F.col("first")))
    exact = exact.groupBy("key").agg(F.first("copies").alias("copies"), F.first("embedding").alias("embedding"))  # rows may repeat
    found = told.join(exact, "key").groupBy(*task).applyInArrow(lambda k, t: compare(k, t, cosine), "key long, links long, least long")
    found = stage(found, "links")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("key").alias("a"), F.col("least").alias("b")))
    known = codes.select("key", "copies", "first").join(links, "key", "left").join(roots.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    known = stage(known, "classes")
    least = known.groupBy("root").agg(F.min("first").alias("component"))
    known = known.join(least, "root").select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), "component")
    out = rows.select("vec_id", "key").join(known, "key", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a row of embeddings, repeated ones too, as link says; an empty table gives no rows. Other columns aren't
    read."""
    return link(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


OP8_SQL = """
WITH v AS (
  SELECT vec_id, label, e FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings) t
  WHERE label IS NOT NULL AND e IS NOT NULL AND list_sum(list_transform(e, lambda x: CASE WHEN x IS NULL OR NOT isfinite(x) THEN 1 ELSE 0 END)) = 0
    AND list_sum(list_transform(e, lambda x: x * x)) > 0
), pair AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  WITH RECURSIVE r(a, b) AS (SELECT a, b FROM pair UNION SELECT r.a, p.b FROM r JOIN pair p ON r.b = p.a) SELECT a, min(b) AS m FROM r GROUP BY a
), n AS (SELECT a, count(*) AS n FROM pair GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(reach.m, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(reach.m, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN reach ON reach.a = e.vec_id
"""
