"""N-gram Jaccard join (operator 4): a chosen-path join of the documents' sets of five-word shingles.

Documents with equal sets are one class; only classes are joined. Each class has a min-hash signature. A run starts
with all classes in one node; a node samples coordinates of the signature, each with probability 1 / (t * threshold),
and sends a class to one child for each sampled coordinate, named by the value there: so classes meet in a child if
they share the sampled token. Two classes at the threshold share one child on average at every depth, while dissimilar
ones soon share none. Nodes of up to SMALL classes are brute-forced; larger ones split further, to DEPTH. RUNS
independent runs reach RECALL at the threshold for pairs that share a node of up to SMALL classes at FIRST_DEPTH. All
others share larger nodes there: the classes in those take part in as many further runs as RECALL needs at DEPTH.
A larger node splits only where that pays: its children hold similarity / threshold of its pairs, so a crowd of near
copies would go through all depths and runs undiminished, and each visit costs as much as many comparisons. By its size
and the mean similarity of about SAMPLE of its signatures a node that doesn't pay is brute-forced whole, in blocks; no
pair is lost by it.

In a node, signatures first rule out pairs that are far below the threshold (BOUND standard deviations); what is left
is verified on the whole shingle sets. A pair is handled in one node only, the least that both visit, so links are
counted without ever listing pairs: a task gives, for each class, the number of rows it links with and the least
class that it reaches.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MASK64, grown, mix64, shingle_hashes, slices, stage, table, text_bytes, tidy, word_hashes
from .graph import components, lowest, tasks

WORDS, THRESHOLD = 5, 0.8
SIGNATURE, RUNS, FIRST_DEPTH, DEPTH, SMALL = 64, 12, 2, 6, 64
BOUND = 4.0
RECALL = 0.999  # of pairs at the threshold
BLOCK = 1024
ROWS = 256  # of a task's matrices that are worked on at once
VISIT = 50  # a visit is shuffled and sorted (some microseconds), a comparison is one of signatures (below 0.1)
VISITS = 8192  # classes in nodes that are split at once
SAMPLE = 32  # signatures a node whose density is looked at
_MULT = mix64(np.arange(101, 101 + SIGNATURE, dtype=np.uint64)) | np.uint64(1)
_XOR = mix64(np.arange(9001, 9001 + SIGNATURE, dtype=np.uint64))


def shingle_sets(array: pa.Array) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes. Words are separated by [\\x20\\x09-\\x0D], in lower case; a text
    of fewer than WORDS words, but some, has one shingle of them all."""
    words, per, _, _ = word_hashes(*text_bytes(pc.utf8_lower(array)))
    s, starts = shingle_hashes(words, per, WORDS)
    return [np.unique(s[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]


def set_key(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Min-hashes, 32 bits each; sets aren't empty."""
    flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), SIGNATURE), np.uint32)
    for k in range(SIGNATURE):
        out[:, k] = np.minimum.reduceat((flat ^ _XOR[k]) * _MULT[k], starts) >> np.uint64(32)
    return out


def _classes(batches: Iterator[pa.RecordBatch], with_signature: bool = True) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 1 << 20):
        sets = shingle_sets(batch.column("text").cast(pa.string()))
        full = [i for i, s in enumerate(sets) if len(s)]
        keys = [set_key(s) if len(s) else None for s in sets]
        sigs: list[bytes | None] = [None] * len(sets)
        if full:
            made = signatures([sets[i] for i in full])
            for i, row in zip(full, made, strict=True):
                sigs[i] = row.tobytes()
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(sigs, pa.binary())], ["doc_id", "key", "size", "sig"])


def _children(paths: np.ndarray, sigs: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each (path, signature): the row and path of its children."""
    with np.errstate(over="ignore"):
        chosen = mix64(paths[:, None] + _XOR[None, :]) < np.uint64(int(min(1.0, 1 / (SIGNATURE * threshold)) * MASK64))
        row, k = np.nonzero(chosen)
        return row, mix64(paths[row] * np.uint64(0x9E3779B97F4A7C15) + mix64(sigs[row, k].astype(np.uint64) * np.uint64(SIGNATURE) + k.astype(np.uint64)))


def _sigs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, SIGNATURE)


def _least(threshold: float) -> int:
    return math.floor(SIGNATURE * threshold - BOUND * math.sqrt(SIGNATURE * threshold * (1 - threshold)))


def recall(threshold: float, runs: int, depth: int) -> float:
    """The chance that a pair at the threshold shares a node at this depth in some run, and isn't ruled out by its
    signatures: over the number of coordinates in which they agree, as each is sampled on its own in every node."""
    total, p = 0.0, min(1.0, 1 / (SIGNATURE * threshold))
    for alike in range(_least(threshold), SIGNATURE + 1):
        met = 1.0
        for _ in range(depth):
            met = 1 - (1 - p * met) ** alike
        total += math.comb(SIGNATURE, alike) * threshold**alike * (1 - threshold) ** (SIGNATURE - alike) * (1 - (1 - met) ** runs)
    return total


def runs_for(threshold: float, depth: int, wanted: float = RECALL) -> int:
    wanted = min(wanted, recall(threshold, 1 << 20, depth) - 1e-6)  # what signatures rule out, no run brings back
    runs = 1
    while recall(threshold, runs, depth) < wanted:
        runs += 1
    return runs


def first_nodes(batches: Iterator[pa.RecordBatch], threshold: float, runs: int, depth: int, done: int = 0) -> Iterator[pa.RecordBatch]:
    """Of each class the nodes at the first depth that is looked at, in `runs` runs after those done."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sigs, keys = _sigs(batch.column("sig")), np.asarray(batch.column("key"))
        of = np.tile(np.arange(len(keys)), runs)
        paths = np.repeat(mix64(np.arange(done + 1, done + runs + 1, dtype=np.uint64)), len(keys))
        for _ in range(depth):
            row, paths = _children(paths, sigs[of], threshold)
            of = of[row]
        yield pa.RecordBatch.from_arrays([pa.array(keys[of]), pa.array(paths.view(np.int64))], ["key", "bucket"])


def next_nodes(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """The children of each class (key, buckets, sig) in all its nodes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        buckets, sigs, keys = batch.column("buckets"), _sigs(batch.column("sig")), np.asarray(batch.column("key"))
        of = np.repeat(np.arange(len(keys)), np.asarray(pc.list_value_length(buckets)))
        nodes = np.asarray(buckets.flatten()).view(np.uint64)
        for lo in range(0, len(of), VISITS):
            part = of[lo : lo + VISITS]
            row, paths = _children(nodes[lo : lo + VISITS], sigs[part], threshold)
            yield pa.RecordBatch.from_arrays([pa.array(keys[part[row]]), pa.array(paths.view(np.int64))], ["key", "bucket"])


def pays(n: int, alike: float, threshold: float, spent: int, runs: int, levels: int) -> bool:
    """Whether splitting a node of n classes, alike on average, for some more levels and in all runs instead of those
    spent so far costs a class less than its n comparisons there: a visit to a node costs as much as VISIT of them."""
    return runs / spent * (levels * VISIT + n * (alike / threshold) ** levels) < n


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """About SAMPLE signatures of each node, chosen by hash."""
    for batch in batches:
        if not batch.num_rows:
            continue
        visits, keys = batch.column("visits"), np.asarray(batch.column("key")).view(np.uint64)
        of = np.repeat(np.arange(len(keys)), np.asarray(pc.list_value_length(visits)))
        nodes, n = (np.asarray(pc.struct_field(visits.flatten(), c)) for c in ("bucket", "n"))
        chosen = np.flatnonzero(mix64(keys[of] + mix64(nodes.view(np.uint64))) / 2.0**64 < SAMPLE / n)
        yield pa.RecordBatch.from_arrays([pa.array(nodes[chosen]), pa.array(n[chosen]), batch.column("sig").take(pa.array(of[chosen]))], ["bucket", "n", "sig"])


def _whole(batches: Iterator[pa.RecordBatch], worth: Callable[[int, float], bool]) -> Iterator[pa.RecordBatch]:
    """The nodes (bucket, n, sigs) that aren't worth splitting, by the share of coordinates in which two of their
    signatures agree, on average; a node of one signature or none is split."""
    for batch in batches:
        found = []
        for node, n, sigs in zip(batch.column("bucket").to_pylist(), batch.column("n").to_pylist(), batch.column("sigs"), strict=True):
            x = _sigs(sigs.values)
            if len(x) > 1 and not worth(n, 2 / len(x) * float(np.mean([(x[:i] == x[i]).mean(1).sum() for i in range(1, len(x))]))):
                found.append(node)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["bucket"])


def parted(large: DataFrame, sigs: DataFrame, worth: Callable[[int, float], bool]) -> tuple[DataFrame, DataFrame]:
    """Visits (key, bucket, n) of nodes that stay whole, and of those that are split."""
    own = large.groupBy("key").agg(F.collect_list(F.struct("bucket", "n")).alias("visits"))
    few = own.join(sigs, "key").mapInArrow(_sampled, "bucket long, n long, sig binary").groupBy("bucket").agg(F.max("n").alias("n"), F.collect_list("sig").alias("sigs"))
    whole = stage(few.mapInArrow(lambda it: _whole(it, worth), "bucket long"), "whole")
    return large.join(whole, "bucket", "left_semi"), stage(large.join(whole, "bucket", "left_anti"), "split")


def _first_meeting(nodes: list[np.ndarray], node: int) -> np.ndarray:
    """For all pairs: whether they meet in no node less than this one."""
    m = len(nodes)
    fresh = np.ones((m, m), bool)
    flat, of = np.concatenate(nodes), np.repeat(np.arange(m), [len(x) for x in nodes])
    less = flat < node
    flat, of = flat[less], of[less]
    order = np.argsort(flat, kind="stable")
    flat, of = flat[order], of[order]
    cuts = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1], [True]]))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b - a > 1:
            fresh[np.ix_(of[a:b], of[a:b])] = False
    return fresh


def _nodes(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.asarray(x) for x in column.to_pylist()]


def _pair_mask(t: pa.Table, node: int, i: int, j: int) -> np.ndarray:
    """Pairs (as p < q, all rows) that this task has to decide."""
    side = np.asarray(t.column("side").combine_chunks())
    across = (side[:, None] != side[None, :]) if i != j else np.ones((len(side), len(side)), bool)
    return np.triu(across, 1) & _first_meeting(_nodes(t.column("nodes")), node)


_TOLD = pa.schema([("key", pa.int64()), ("bucket", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("side", pa.int32()), ("nodes", pa.list_(pa.int64())), ("copies", pa.int64())])


def candidates(key: tuple, t: pa.Table, threshold: float) -> pa.Table:
    """The classes of a task that have a partner by signature, with what verifying will need."""
    node, i, j = (k.as_py() for k in key)
    t = t.combine_chunks()
    sigs, m = _sigs(t.column("sig").combine_chunks()), t.num_rows
    least = _least(threshold)
    sizes = np.asarray(t.column("size")).astype(float)
    wanted = _pair_mask(t, node, i, j)
    got = np.zeros(m, bool)
    for lo in range(0, m, ROWS):
        part = slice(lo, lo + ROWS)
        alike = np.zeros((len(sigs[part]), m), np.uint8)
        for k in range(SIGNATURE):
            alike += sigs[part, k][:, None] == sigs[:, k][None, :]
        fits = np.minimum(sizes[part, None], sizes) >= threshold * np.maximum(sizes[part, None], sizes) - 1e-9
        ok = (alike >= least) & fits & wanted[part]
        got[part] |= ok.any(1)
        got |= ok.any(0)
    if m > ROWS:
        del wanted
        tidy()
    return t.select(_TOLD.names).filter(pa.array(got)).cast(_TOLD)


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections; shingles of one set only are left out first, then taken by blocks."""
    m = len(sets)
    flat, of = np.concatenate(sets), np.repeat(np.arange(m), [len(s) for s in sets])
    _, number, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[number] > 1
    number, of = number[shared], of[shared]
    order = np.argsort(number, kind="stable")
    number, of = number[order], of[order]
    dense = np.cumsum(np.concatenate([[0], number[1:] != number[:-1]])) if len(number) else number
    out = np.zeros((m, m), np.float32)
    width = 1024
    for lo in range(0, int(dense[-1]) + 1 if len(dense) else 0, width):
        a, b = np.searchsorted(dense, [lo, lo + width])
        x = np.zeros((m, width), np.float32)
        x[of[a:b], dense[a:b] - lo] = 1
        for p in range(0, m, ROWS):
            out[p : p + ROWS] += x[p : p + ROWS] @ x.T
    return out


def verify(key: tuple, t: pa.Table, threshold: float) -> pa.Table:
    """Exact similarities of a task's pairs; for each linked class the rows it links with and the least class that it
    reaches by links there."""
    node, i, j = (k.as_py() for k in key)
    t = t.combine_chunks()
    sets = [np.frombuffer(b, np.uint64) for b in t.column("shingles").to_pylist()]
    keys, copies = (np.asarray(t.column(c)) for c in ("key", "copies"))
    sizes = np.array([len(s) for s in sets], float)
    both = overlaps(sets)
    ok, links = _pair_mask(t, node, i, j), np.zeros(len(keys), np.int64)
    for lo in range(0, len(keys), ROWS):
        part = slice(lo, lo + ROWS)
        ok[part] &= both[part] >= threshold * (sizes[part, None] + sizes - both[part]) - 1e-6
        links[part] += ok[part] @ copies
        links += copies[part] @ ok[part]
    least = lowest(keys, [x.astype(np.int32) for x in np.nonzero(ok)])
    got = links > 0
    if len(keys) > ROWS:
        del both, ok
        tidy()
    return pa.table({"key": pa.array(keys[got]), "links": pa.array(links[got].astype(np.int64)), "least": pa.array(least[got])})


def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 1 << 20):
        sets = shingle_sets(batch.column("text").cast(pa.string()))
        same = np.array([len(s) > 0 and set_key(s) == k for s, k in zip(sets, batch.column("key").to_pylist(), strict=True)], bool)
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([s.tobytes() for s in sets], pa.binary())], ["key", "shingles"]).filter(pa.array(same))


def largest_first() -> Column:
    """A node's number such that nodes of twice as many classes come first: most pairs of a crowd then meet in few
    nodes, and its classes are candidates in these only."""
    return F.shiftleft(40 - F.floor(F.log2(F.col("n"))), 57).bitwiseOR(F.col("bucket").bitwiseAND(F.lit((1 << 57) - 1)))


def link(docs: DataFrame, threshold: float = THRESHOLD, runs: int = RUNS) -> DataFrame:
    """doc_id, key, class_id, n_links for each row of docs (doc_id, text).

    n_links: other rows with a similarity of at least threshold; class_id: the least doc_id of all that can be reached
    by links. Rows with equal shingle sets are copies and link with each other. A text without words (or null) has
    no shingles and links with nothing: its key is null, its class_id its own id. A repeated row is a row of its own; a
    null id counts as greatest.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = stage(rows.mapInArrow(_classes, "doc_id long, key long, size long, sig binary"), "signatures")
    classes = made.where(F.col("key").isNotNull()).groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first"), F.first("size").alias("size"), F.first("sig").alias("sig"))
    classes = stage(classes, "classes")
    sigs = classes.select("key", "sig")

    level = classes.select("key", "sig").mapInArrow(lambda it: first_nodes(it, threshold, runs, FIRST_DEPTH), "key long, bucket long")
    leaves = []
    for depth in range(FIRST_DEPTH, DEPTH + 1):
        level = stage(level.distinct(), "nodes")
        sizes = level.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        met = level.join(sizes, "bucket")
        small = met if depth == DEPTH else met.where(F.col("n") <= SMALL)
        leaves.append(small.select("key", "bucket", "n"))
        if depth < DEPTH:
            large = stage(met.where(F.col("n") > SMALL).select("key", "bucket", "n"), "large")
            if large.isEmpty():
                break
            every = max(runs, runs_for(threshold, DEPTH)) if depth == FIRST_DEPTH else runs
            left = DEPTH - depth
            whole, large = parted(large, sigs, lambda n, alike, left=left, every=every: pays(n, alike, threshold, runs, every, left))
            leaves.append(whole.select("key", "bucket", "n"))
            if large.isEmpty():
                break
            if every > runs:
                crowded = sigs.join(large.select("key").distinct(), "key", "left_semi")
                further = crowded.mapInArrow(lambda it: first_nodes(it, threshold, every - runs, FIRST_DEPTH, runs), "key long, bucket long")
                further = stage(further.distinct(), "further")
                sizes = further.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
                further = stage(further.join(sizes, "bucket").select("key", "bucket", "n"), "further")
                whole, rest = parted(further.where(F.col("n") > SMALL), sigs, lambda n, alike, left=left, every=every: pays(n, alike, threshold, every, every, left))
                leaves += [further.where(F.col("n") <= SMALL), whole.select("key", "bucket", "n")]
                large = large.unionByName(rest)
            own = large.groupBy("key").agg(F.collect_list("bucket").alias("buckets"))  # at most some 100: runs x 1.25 ** depth on average
            level = own.join(sigs, "key").mapInArrow(lambda it: next_nodes(it, threshold), "key long, bucket long")
    nodes = leaves[0]
    for more in leaves[1:]:
        nodes = nodes.unionByName(more)
    nodes = stage(nodes.withColumn("bucket", largest_first()).repartition("key"), "leaves")
    visits = nodes.groupBy("key").agg(F.array_sort(F.collect_list("bucket")).alias("nodes"))
    visits = visits.join(classes.select("key", "copies", "size", "sig"), "key")
    spread = visits.withColumn("bucket", F.explode("nodes"))
    told = tasks(spread, BLOCK).groupBy("bucket", "i", "j").applyInArrow(
        lambda k, t: candidates(k, t, threshold), "key long, bucket long, i int, j int, side int, nodes array<long>, copies long"
    )
    told = stage(told, "candidates")

    wanted = classes.join(told.select("key").distinct(), "key", "left_semi").select("first", "key")
    texts = rows.where(F.col("text").isNotNull()).join(wanted, F.col("doc_id").eqNullSafe(F.col("first"))).select("key", "text")
    sets = texts.mapInArrow(_with_sets, "key long, shingles binary").groupBy("key").agg(F.first("shingles").alias("shingles"))
    found = told.join(sets, "key").groupBy("bucket", "i", "j").applyInArrow(lambda k, t: verify(k, t, threshold), "key long, links long, least long")
    found = stage(found, "links")

    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("key").alias("a"), F.col("least").alias("b"))).select(F.col("node").alias("key"), "root")
    known = classes.select("key", "copies", "first").join(links, "key", "left").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    known = stage(known, "linked")
    least = known.groupBy("root").agg(F.min("first").alias("class_id"))
    known = known.join(least, "root").select("key", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = made.select("doc_id", "key").join(known, "key", "left")
    return out.select("doc_id", "key", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "__dg_text", 1 << 20):
        keys = [set_key(s) if len(s) else None for s in shingle_sets(batch.column("__dg_text"))]
        names = [n for n in batch.schema.names if n != "__dg_text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(keys, pa.int64())], [*names, "__dg_key"])


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row of each class of linked rows (one of the least doc_id; of rows alike in that, one of the
    least set key, then of the least hash of all columns). Rows without words link with nothing and stay."""
    linked = stage(link(docs, threshold).where(F.col("key").isNotNull()), "joined")
    rows = linked.groupBy("class_id", "doc_id", "key").agg(F.count(F.lit(1)).alias("n"))
    rows = stage(rows, "members")
    stays = rows.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("best"))
    told = rows.join(stays, "class_id").select("doc_id", "key", "n", (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("key") == F.col("best.key"))).alias("stays"))
    gone = told.where(~F.col("stays")).select(F.col("doc_id").alias("__dg_gone"), F.col("key").alias("__dg_gone_key"))
    keyed = docs.withColumn("__dg_text", F.col("text").cast("string"))
    keyed = keyed.mapInArrow(_keyed, grown(docs.schema, __dg_key=T.LongType()))
    same = lambda other: (F.col("__dg_key") == other["__dg_gone_key"]) & F.col("doc_id").cast("long").eqNullSafe(other["__dg_gone"])
    left = keyed.join(gone, same(gone), "left_anti")
    again = told.where("stays and n > 1").select(F.col("doc_id").alias("__dg_gone"), F.col("key").alias("__dg_gone_key"))
    if not again.isEmpty():
        own = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
        once = left.join(again, same(again), "left_semi").groupBy("__dg_key", "doc_id").agg(F.min_by(own, F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))).alias("row")).select("row.*")
        return left.join(again, same(again), "left_anti").drop("__dg_key").unionByName(once)
    return left.drop("__dg_key")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a row of documents, as link says; an empty table gives no rows. Columns but doc_id and text aren't read."""
    return link(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")
