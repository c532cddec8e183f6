"""Mixing sources to target weights (operator 2).

Targets: sources share the wanted total by weight, none above its cap; what a capped source can't take is reshared
by weight. Each document of a source is wanted r = target / size times: floor(r) copies for certain, one more
with probability p = r - floor(r). Pivotal dependent rounding makes these probabilities integral: two fractional
documents swap mass, weighted by their sizes so that the words they are expected to give stay the same, until one of
them is 0 or 1; the other goes on. A group of a few hundred documents of one source leaves one fractional document,
and those meet again in groups, level by level, until each source has one group left, in which some RESERVE documents
take part that were in none before. What rounding the last fractional document leaves over is settled with that group's
other documents, long ones first: each that brings the source's words nearer to the target changes sides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, stage, table, tidy

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, CAP = 1.5, 2.0
GROUP, RESERVE = 512, 512
EPS = 1e-9


def n_words(text: str = "text") -> Column:
    r"""Number of matches of [^\x20\x09-\x0D]+ (null: 0)."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, n_docs, most_docs and target, one row a source.

    sizes: (source, size) rows. Sources are ranked by code point, null last; their place modulo the number of weights
    gives the weight. Ranks come from a distributed sort; only one number a partition goes to the driver. Each
    round caps what is above its cap and reshares, until none is; each is an aggregate of the sources' table.
    """
    spark = sizes.sparkSession
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    placed = stage(totals.orderBy(F.col("source").asc_nulls_last()).withColumn("__at", F.monotonically_increasing_id()), "sources")
    part, row = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted(tuple(r) for r in placed.groupBy(part.alias("p")).count().collect())
    starts = np.concatenate([[0], np.cumsum([n for _, n in counts])]).tolist()
    offset = F.lit(0).cast("long")
    if counts:
        begin = spark.createDataFrame([(int(p), int(s)) for (p, _), s in zip(counts, starts, strict=False)], "__p long, __start long")
        placed = placed.withColumn("__p", part).join(begin, "__p")
        offset = F.col("__start")
    place = (offset + row) % len(weights)
    ranked = placed.select("source", "source_size", "n_docs", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")).alias("weight"), (F.col("source_size") * F.lit(cap)).alias("most"))
    ranked = stage(ranked, "ranked")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, before = 0.0, -1
    while True:
        capped = F.lit(level) * F.col("weight") > F.col("most") if level else F.lit(False)
        n, taken, free = ranked.agg(F.count(F.when(capped, 1)), F.coalesce(F.sum(F.when(capped, F.col("most"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0))).first()
        if n == before or not free:
            break
        level, before = (share * total - taken) / free, n
    return ranked.select("source", "source_size", "n_docs", F.least("most", F.lit(level) * F.col("weight")).alias("target"))


def pivot(p: float, size: float, other: float, other_size: float, u: float) -> tuple[float, float]:
    """The probabilities of two units after as many words as one of them can take went from one to the other."""
    ratio = size / other_size
    up, down = min(1 - p, other / ratio), min(p, (1 - other) / ratio)
    move = up if u * (up + down) < down else -down
    return p + move, other - move * ratio


def _whole(p: float) -> bool:
    return p <= EPS or p >= 1 - EPS


def _next_draw(u: float, v: float) -> float:
    return (u * 0.7548776662466927 + v * 0.5698402909980532) % 1.0


def _pivotal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by __g. Of each group all rows but at most one become integral; __p and __open tell. One row of the
    group before is held, no more."""
    kept("mixing")  # nothing: what other stages left in this worker goes
    tidy()
    held: pa.RecordBatch | None = None  # the fractional document, not yet given out
    group, p_held, size_held, u_held = None, 0.0, 0.0, 0.0

    for batch in batches:
        if not batch.num_rows:
            continue
        groups, p = batch.column("__g").to_pylist(), np.array(batch.column("__p"))
        sizes, draws = np.asarray(batch.column("__size")).tolist(), np.asarray(batch.column("__u")).tolist()
        out, inside, before = p.tolist(), -1, []  # inside: the held row's place if it is in this batch
        open_rows = []
        for i, (g, x, s, u) in enumerate(zip(groups, out, sizes, draws, strict=True)):
            if g != group:
                if held is not None:
                    before.append(_given(held, np.array([p_held]), np.array([True])))
                elif inside >= 0:
                    open_rows.append(inside)
                    out[inside] = p_held
                held, inside, group = None, -1, g
            if _whole(x):
                out[i] = float(x > 0.5)
                continue
            if held is None and inside < 0:
                inside, p_held, size_held, u_held = i, x, s, u
                continue
            new, x = pivot(p_held, size_held, x, s, u)
            if _whole(new):  # the held one is done, this one goes on
                new = float(new > 0.5)
                if held is not None:
                    before.append(_given(held, np.array([new]), np.array([False])))
                    held = None
                else:
                    out[inside] = new
                inside, p_held, size_held, u_held = (-1, 0.0, 0.0, 0.0) if _whole(x) else (i, x, s, u)
                out[i] = float(x > 0.5) if inside < 0 else x
            else:
                p_held, u_held = new, _next_draw(u_held, u)
                out[i] = float(x > 0.5)
        yield from before
        flags, keep = np.zeros(len(out), bool), np.ones(len(out), bool)
        flags[open_rows] = True
        if inside >= 0:
            held, keep[inside] = batch.slice(inside, 1), False
        done = _given(batch, np.asarray(out), flags)
        yield done if keep.all() else done.filter(pa.array(keep))
    if held is not None:
        yield _given(held, np.array([p_held]), np.array([True]))
    tidy()


def _given(batch: pa.RecordBatch, p: np.ndarray, open_: np.ndarray) -> pa.RecordBatch:
    cols = {n: batch.column(n) for n in batch.schema.names} | {"__p": pa.array(p, pa.float64()), "__open": pa.array(open_, pa.bool_())}
    return pa.RecordBatch.from_arrays(list(cols.values()), list(cols))


def settled(p: list[float], sizes: list[float], draws: list[float]) -> list[float]:
    """All of one group (long units first) as 0 or 1, so that the sum of size * p changes by less than the group's short
    units: what rounding the last unit leaves over is made good by fractional units that change sides. If they can't do
    so on the side that was drawn (a unit as long as all others), it goes to the better one."""
    out, held, u_held = list(p), -1, 0.0
    fractional = [i for i, x in enumerate(p) if not _whole(x)]
    for i in fractional:
        if held < 0:
            held, u_held = i, draws[i]
            continue
        new, x = pivot(out[held], sizes[held], out[i], sizes[i], draws[i])
        out[held], out[i] = new, x
        if _whole(new):
            held, u_held = (-1, 0.0) if _whole(x) else (i, draws[i])
        else:
            u_held = _next_draw(u_held, draws[i])
    if held < 0:
        return [float(x > 0.5) for x in out]
    words, drawn = out[held] * sizes[held], float(u_held < out[held])

    def with_last(side: float) -> tuple[float, list[float]]:
        done, over = [float(x > 0.5) for x in out], words - side * sizes[held]
        done[held] = side
        for i in fractional:
            gain = sizes[i] * (1 - 2 * done[i])
            if i != held and abs(over - gain) < abs(over):
                done[i], over = 1 - done[i], over - gain
        return abs(over), done

    first = with_last(drawn)
    if first[0] <= min(sizes[i] for i in fractional):
        return first[1]
    return min(first, with_last(1 - drawn), key=lambda x: x[0])[1]


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by __g, all integral after. A group (some GROUP and RESERVE rows) is held whole."""
    kept("mixing")
    tidy()
    held: list[pa.RecordBatch] = []

    def done() -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate([np.asarray(b.column(c)) for b in held]).tolist() for c in ("__p", "__size", "__u")]
        out, at = np.asarray(settled(*columns)), 0
        for b in held:
            yield _given(b, out[at : at + b.num_rows], np.zeros(b.num_rows, bool))
            at += b.num_rows

    for batch in batches:
        if not batch.num_rows:
            continue
        groups = np.asarray(batch.column("__g"))
        cuts = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and held[0].column("__g")[0].as_py() != groups[a]:
                yield from done()
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield from done()
    tidy()


def dependent_rounding(units: DataFrame, group: Column, p: Column, size: Column, identity: Column, count: Column, largest: int, seed: int = 0) -> DataFrame:
    """units with __taken (0 or 1): rounds p within the groups so that the sum of size * p stays, but for less than a
    short unit of those that meet last (see settled).

    identity: what tells units apart (those alike are interchangeable). count: units in the unit's group. largest: units
    in the largest group, by which the number of levels is chosen. Units of size 0 get 0. The draws are hashes of
    identity, so reruns agree.
    """
    levels = max(1, math.ceil(math.log(max(2, largest)) / math.log(GROUP)) if largest > 1 else 1)
    rows = units.withColumns({"__key": F.xxhash64(identity, F.lit(seed)), "__of": group, "__size": size.cast("double"), "__p": F.when(size > 0, p).otherwise(0.0).cast("double"), "__open": F.lit(True), "__n": count})
    late = F.pmod(F.xxhash64("__key", F.lit(-1)), F.greatest(F.col("__n"), F.lit(1))) < RESERVE
    done: list[DataFrame] = []
    for level in range(levels):
        last = level == levels - 1
        if last and done:
            rows = rows.unionByName(reserve)  # noqa: F821
        elif not last and level == 0:
            rows, reserve = rows.where(~late), rows.where(late)  # noqa: F841
        buckets = 1 if last else -(-largest // GROUP ** (level + 1))
        salt = F.lit(0).cast("long") if buckets == 1 else F.pmod(F.xxhash64("__key", F.lit(level)), F.lit(buckets))
        dealt = rows.withColumns({"__b": salt, "__g": F.xxhash64("__of", F.lit(level), salt), "__u": F.shiftrightunsigned(F.xxhash64("__key", F.lit(level + 77)), 11).cast("double") / float(1 << 53)})
        dealt = dealt.repartition("__of", "__b").sortWithinPartitions("__g", F.desc("__size"), "__key")
        rounded = dealt.mapInArrow(_settle if last else _pivotal, dealt.schema).drop("__b", "__g", "__u")
        if last:
            done.append(rounded)
        else:
            rounded = stage(rounded, "rounded")
            done.append(rounded.where(~F.col("__open")))
            rows = rounded.where("__open")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.withColumn("__taken", F.col("__p").cast("long")).drop("__key", "__of", "__size", "__p", "__open", "__n")


def mix(docs: DataFrame, size: Column, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = 0) -> DataFrame:
    """docs with size, source_size, target and copies (0 to ceil(cap)) for a mix of share times all sizes.

    docs has doc_id and source, maybe others, which are carried along (columns with the new names give way). A null
    source is a source of its own, ranked last. Documents of size 0 get no copies. Repeated rows are documents of
    their own. An empty table gives no rows. Sources without words have the target 0.
    """
    new = ("size", "source_size", "target", "copies")
    sized = docs.withColumn("__dg_size", size).drop(*new)
    targets = source_targets(sized.select("source", F.col("__dg_size").alias("size")), weights, share, cap)
    targets = stage(targets, "targets")
    largest = targets.agg(F.max("n_docs")).first()[0] or 0
    small = targets.select(F.col("source").alias("__dg_source"), F.col("source_size").alias("__dg_total"), F.col("target").alias("__dg_target"), F.col("n_docs").alias("__dg_docs"))
    joined = sized.join(small, F.col("source").eqNullSafe(F.col("__dg_source")), "inner").drop("__dg_source")
    joined = joined.withColumn("__dg_rate", F.when(F.col("__dg_total") > 0, F.col("__dg_target") / F.col("__dg_total")).otherwise(0.0))
    whole = F.floor(F.col("__dg_rate") + EPS)
    p = F.greatest(F.col("__dg_rate") - whole, F.lit(0.0))
    identity = F.struct(F.col("doc_id"), F.col("source"), F.col("__dg_size"))
    rounded = dependent_rounding(joined, F.xxhash64(F.col("source"), F.col("source").isNull()), p, F.col("__dg_size"), identity, F.col("__dg_docs"), largest, seed)
    copies = F.when(F.col("__dg_size") > 0, whole + F.col("__taken")).otherwise(0).cast("long")
    names = [c for c in docs.columns if c not in new]
    return rounded.select(*(F.col(f"`{c}`") for c in names), F.col("__dg_size").alias("size"), F.col("__dg_total").alias("source_size"), F.col("__dg_target").alias("target"), copies.alias("copies"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a row of documents, repeated ones too. A null text has size 0 and is never taken, a null source is the
    last source, ties in size go by a hash of the row. An empty table gives no rows. Columns but doc_id, source and text
    aren't read."""
    docs = table(spark, sf_dir, "documents")
    # the sizes are used twice; counting words again would cost more than these small rows
    sizes = stage(docs.select("doc_id", "source", n_words().alias("words")), "sizes")
    return mix(sizes, F.col("words")).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source")

