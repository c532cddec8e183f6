"""Line dedup (operator 7).

Lines that many documents hold are dropped everywhere but in the largest doc_id that holds them. The repeated
lines' 128-bit hashes are dealt to shards; each shard gets a minimal perfect hash function (levels of bit
arrays, each key at the first level where it is alone at its bit) that indexes compact arrays of fingerprints,
counts and keepers. Documents probe these arrays; no line is joined with a document.

The heaviest MAX_BROADCAST_KEYS keys' shards are broadcast (28 bytes a key, so at most 56 MB); by the pigeonhole
principle any other key holds less than 1 / MAX_BROADCAST_KEYS of all lines, so the others' probes can be dealt
out by shard without skew and meet the arrays there; lines of the broadcast keys aren't among these probes.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import grown, mix64, slices, stage, table

MIN_CHARS, MIN_DOCS = 40, 5
MAX_BROADCAST_KEYS = 2_000_000
SHARD_KEYS = 50_000
STRIP = b" \t\n\v\f\r"


def line_key(line: bytes) -> bytes:
    return line.strip(STRIP).lower()  # bytes.lower() changes A-Z only


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


def _hash(key: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(key)
    return (h >> 64) - (1 << 63), (h & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


class PerfectHash:
    """A minimal perfect hash function over distinct pairs of 64-bit hashes."""

    def __init__(self, levels: list[np.ndarray], seed: int):
        self.levels, self.seed = levels, seed  # levels: packed bits
        ones = [np.concatenate([[0], np.cumsum(np.unpackbits(b).reshape(-1, 8).sum(1, dtype=np.int64))]) for b in levels]
        base = np.cumsum([0, *(int(o[-1]) for o in ones)])
        self.ranks = [o[:-1] + b for o, b in zip(ones, base, strict=False)]

    @staticmethod
    def _mixed(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
        return mix64(a.view(np.uint64) * np.uint64(2 * seed + 0x9E3779B97F4A7C15) ^ mix64(b.view(np.uint64) + np.uint64(seed)))

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray, gamma: float = 2.0) -> PerfectHash:
        for seed in range(64):
            left, levels = cls._mixed(a, b, seed), []
            if len(np.unique(left)) < len(left):
                continue
            while len(left):
                bits = max(8, -(-int(gamma * len(left)) // 8) * 8)
                at = mix64(left + np.uint64(len(levels))) % np.uint64(bits)
                hits = np.bincount(at.astype(np.int64), minlength=bits)
                levels.append(np.packbits(hits == 1))
                left = left[hits[at.astype(np.int64)] > 1]
            return cls(levels, seed)
        raise ValueError("the keys aren't distinct")

    def index(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of each key, -1 for some of those that aren't in the set."""
        keys, out = self._mixed(a, b, self.seed), np.full(len(a), -1, np.int64)
        open_ = np.arange(len(a))
        for k, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            at = (mix64(keys[open_] + np.uint64(k)) % np.uint64(8 * len(bits))).astype(np.int64)
            byte, bit = at >> 3, at & 7
            hit = (bits[byte] >> (7 - bit).astype(np.uint8)) & 1 == 1
            got = open_[hit]
            left = (bits[byte[hit]] >> (8 - bit[hit]).astype(np.uint16)).astype(np.uint8)
            out[got] = ranks[byte[hit]] + _POPCOUNT[left]
            open_ = open_[~hit]
            if not len(open_):
                break
        return out


_POPCOUNT = np.unpackbits(np.arange(256, dtype=np.uint8).reshape(-1, 1), axis=1).sum(1).astype(np.int64)


class Shard:
    """The arrays of one shard: fingerprints, counts, keepers (largest doc_id; has_keeper tells a null one)."""

    def __init__(self, a: np.ndarray, b: np.ndarray, n: np.ndarray, keeper: np.ndarray, has_keeper: np.ndarray):
        self.mph = PerfectHash.build(a, b)
        at = self.mph.index(a, b)
        self.fingerprint, self.n, self.keeper, self.has_keeper = (np.empty_like(x) for x in (b, n, keeper, has_keeper))
        for own, given in ((self.fingerprint, b), (self.n, n), (self.keeper, keeper), (self.has_keeper, has_keeper)):
            own[at] = given

    def holds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        at = self.mph.index(a, b)
        return (at >= 0) & (self.fingerprint[np.maximum(at, 0)] == b)

    def drops(self, a: np.ndarray, b: np.ndarray, doc: np.ndarray, has_doc: np.ndarray) -> np.ndarray:
        """Which lines go, by their hashes and their document's id."""
        at = self.mph.index(a, b)
        safe = np.maximum(at, 0)
        member = (at >= 0) & (self.fingerprint[safe] == b)
        keeps = np.where(self.has_keeper[safe], has_doc & (self.keeper[safe] == doc), ~has_doc)
        return member & ~keeps


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    valid = np.asarray(column.is_valid())
    return np.asarray(column.fill_null(0)).astype(np.int64), valid


def line_rows(batches: Iterator[pa.RecordBatch], min_chars: int, known: Index | None = None) -> Iterator[pa.RecordBatch]:
    """A row for each distinct long line of a document, but those in `known`: two hashes and the id."""
    for batch in slices(batches, "text"):
        ids, valid = _ids(batch.column("doc_id"))
        a, b, of = [], [], []
        for i, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
            own = {key for line in (text or b"").split(b"\n") if len(line) >= min_chars and _long_enough(key := line_key(line), min_chars)}
            for key in own:
                h = _hash(key)
                a.append(h[0])
                b.append(h[1])
                of.append(i)
        a, b, at = (np.asarray(x, np.int64) for x in (a, b, of))
        if known is not None and len(a):
            rest = ~known.holds(a, b)
            a, b, at = a[rest], b[rest], at[rest]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(ids[at], pa.int64(), mask=~valid[at])], ["a", "b", "doc_id"])


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """a, b (the key's hashes), n (distinct doc_id that hold it; rows without one are one document), keeper (largest
    doc_id). A key of many documents is counted by parts before it meets in one task."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lambda it: line_rows(it, min_chars), "a long, b long, doc_id long")
    once = rows.groupBy("a", "b", "doc_id").agg(F.lit(1).alias("one"))
    return once.groupBy("a", "b").agg(F.count("one").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs)


def _shard_bytes(key: tuple, t: pa.Table) -> pa.Table:
    import pickle

    t = t.sort_by([("a", "ascending"), ("b", "ascending")])
    a, b, n = (np.ascontiguousarray(np.asarray(t.column(c).combine_chunks())) for c in ("a", "b", "n"))
    keeper, has = _ids(t.column("keeper").combine_chunks())
    shard = Shard(a, b, n.astype(np.uint32), keeper, has)
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "data": pa.array([pickle.dumps(shard, protocol=5)], pa.binary())})


def shard_table(keys: DataFrame, n_shards: int) -> DataFrame:
    """One row for each shard: its number and its pickled arrays."""
    dealt = keys.withColumn("shard", F.pmod(F.col("a"), F.lit(n_shards)))
    return dealt.groupBy("shard").applyInArrow(_shard_bytes, "shard long, data binary")


class Index:
    """The broadcast shards, unpickled once in each Python worker."""

    def __init__(self, data: Broadcast, n_shards: int):
        self.data, self.n_shards, self.shards = data, n_shards, None

    def __getstate__(self):
        return self.data, self.n_shards

    def __setstate__(self, state):
        (self.data, self.n_shards), self.shards = state, None

    def _ask(self, what: str, a: np.ndarray, *more: np.ndarray) -> np.ndarray:
        import pickle

        if self.shards is None:
            self.shards = {k: pickle.loads(v) for k, v in self.data.value.items()}
        out, of = np.zeros(len(a), bool), np.mod(a, self.n_shards)
        for k in np.unique(of):
            if (shard := self.shards.get(int(k))) is not None:
                m = of == k
                out[m] = getattr(shard, what)(a[m], *(x[m] for x in more))
        return out

    def holds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self._ask("holds", a, b)

    def drops(self, a: np.ndarray, b: np.ndarray, doc: np.ndarray, has_doc: np.ndarray) -> np.ndarray:
        return self._ask("drops", a, b, doc, has_doc)


def _probe(batches: Iterator[pa.RecordBatch], index: Index, min_chars: int, extra: bool) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "__dg_text"):
        ids, valid = _ids(batch.column("__dg_id"))
        texts = batch.column("__dg_text").cast(pa.binary()).to_pylist()
        more = batch.column("__dg_more").to_pylist() if extra else None
        lines, a, b, doc, place = [], [], [], [], []
        for i, text in enumerate(texts):
            own = (text or b"").split(b"\n")
            lines.append(own)
            for j, line in enumerate(own):
                if len(line) >= min_chars and _long_enough(key := line_key(line), min_chars):
                    h = _hash(key)
                    a.append(h[0])
                    b.append(h[1])
                    doc.append(i)
                    place.append(j)
        a, b, doc, place = (np.asarray(x, np.int64) for x in (a, b, doc, place))
        gone = index.drops(a, b, ids[doc], valid[doc]) if len(a) else np.zeros(0, bool)
        if extra:
            for k in np.flatnonzero(~gone):
                if more[doc[k]] and f"{a[k]},{b[k]}" in more[doc[k]]:
                    gone[k] = True
        n_dropped = np.bincount(doc[gone], minlength=len(texts))
        off: dict[int, set[int]] = defaultdict(set)
        for k in np.flatnonzero(gone):
            off[doc[k]].add(place[k])
        for i, own in off.items():
            lines[i] = [x for j, x in enumerate(lines[i]) if j not in own]
        n_lines = np.asarray([len(x) for x in lines]) + n_dropped
        kept = pa.array([b"\n".join(x) for x in lines], pa.binary()).cast(pa.string())
        names = [n for n in batch.schema.names if n not in ("__dg_more",)]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), kept], [*names, "__dg_n_lines", "__dg_n_dropped", "__dg_kept"])


def _route(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """Probes of one shard against its arrays: the (doc_id, line) that go."""
    empty = pa.table({"doc_id": pa.array([], pa.int64()), "line": pa.array([], pa.string())})
    if not right.num_rows or not left.num_rows:
        return empty
    import pickle

    data = _shard_bytes((pa.scalar(0, pa.int64()),), right)
    shard = pickle.loads(data.column("data")[0].as_py())
    a, b = (np.ascontiguousarray(np.asarray(left.column(c).combine_chunks())) for c in ("a", "b"))
    doc, has = _ids(left.column("doc_id").combine_chunks())
    gone = shard.drops(a, b, doc, has)
    return pa.table({"doc_id": pa.array(doc[gone], pa.int64(), mask=~has[gone]), "line": pa.array([f"{x},{y}" for x, y in zip(a[gone], b[gone], strict=True)], pa.string())})


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, max_broadcast_keys: int = MAX_BROADCAST_KEYS, shard_keys: int = SHARD_KEYS, only_needed: bool = False) -> DataFrame:
    """docs (doc_id, text, any others) with text replaced by what is kept, plus n_lines and n_dropped.

    A line's key is the line without white space ([\\x20\\x09-\\x0D]) at its ends, A-Z in lower case. Keys of at
    least min_chars code points that at least min_docs documents hold lose all their lines, but for those of the
    largest doc_id that holds them. A null or empty text is one empty line and stays as it is. Rows with one doc_id
    count as one document, those without one, too; rows that share the keeper's doc_id all keep their line; a null
    doc_id is less than any other. Columns named n_lines or n_dropped give way to the new ones. only_needed: return doc_id, n_lines, n_dropped and text only.
    """
    spark = docs.sparkSession
    keys = stage(repeated_lines(docs, min_chars, min_docs), "lines")
    total = keys.count()
    heavy, rest = keys, None
    if total > max_broadcast_keys:
        # the n of the last key that fits; keys above it go to the index, the others are dealt out
        edge = keys.groupBy("n").count().orderBy(F.desc("n"))
        least = _edge(edge, max_broadcast_keys)
        heavy, rest = keys.where(F.col("n") > least), keys.where(F.col("n") <= least)
    n_shards = max(1, -(-min(total, max_broadcast_keys) // shard_keys))
    index = Index(spark.sparkContext.broadcast({r["shard"]: bytes(r["data"]) for r in shard_table(heavy, n_shards).toLocalIterator()}), n_shards)
    names = ["doc_id"] if only_needed else [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    lined = docs.select(*(F.col(f"`{c}`") for c in names if c != "text"), F.col("doc_id").cast("long").alias("__dg_id"), F.col("text").cast("string").alias("__dg_text"))
    if rest is not None:
        shards = max(1, -(-total // shard_keys))
        probes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lambda it: line_rows(it, min_chars, index), "a long, b long, doc_id long")
        of = F.pmod(F.col("a"), F.lit(shards)).alias("shard")
        gone = probes.select("a", "b", "doc_id", of).groupBy("shard").cogroup(rest.select("a", "b", "n", "keeper", of).groupBy("shard")).applyInArrow(_route, "doc_id long, line string")
        gone = gone.groupBy(F.col("doc_id").alias("__dg_gone")).agg(F.collect_set("line").alias("__dg_more"))
        lined = lined.join(gone, F.col("__dg_id").eqNullSafe(F.col("__dg_gone")), "left").drop("__dg_gone")
    plain = lined.drop("__dg_more")
    schema = grown(plain.schema, __dg_n_lines=T.LongType(), __dg_n_dropped=T.LongType(), __dg_kept=T.StringType())
    extra = rest is not None
    out = lined.mapInArrow(lambda it: _probe(it, index, min_chars, extra), schema)
    if only_needed:
        names = ["doc_id", "text"]
    own = {"text": F.when(F.col("__dg_text").isNull(), None).otherwise(F.col("__dg_kept")).alias("text")}
    return out.select(*(own.get(c, F.col(f"`{c}`")) for c in names), F.col("__dg_n_lines").alias("n_lines"), F.col("__dg_n_dropped").alias("n_dropped"))


def _edge(by_n: DataFrame, most: int) -> int:
    """Keys with n above the returned value number at most `most`; at most sqrt(2 x lines) distinct n exist."""
    have = 0
    for r in by_n.toLocalIterator():
        have += r["count"]
        if have > most:
            return r["n"]
    return 0


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a row of documents, as dedup_lines says; of a null or empty text one line, none dropped and the digest
    of an empty string. An empty table gives no rows. Columns but doc_id and text aren't read."""
    out = dedup_lines(table(spark, sf_dir, "documents"), only_needed=True)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP7_SQL = """
WITH lines AS (
  SELECT doc_id, u.i, u.line,
         translate(trim(u.line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(list_transform(range(1, len(l) + 1), lambda j: {'i': j, 'line': l[j]})) AS u
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
), hot AS (
  SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT lines.doc_id, i, line, hot.k IS NOT NULL AND keeper <> doc_id AS gone FROM lines LEFT JOIN hot ON lines.k = hot.k
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
