"""Toxicity (operator 5): FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the 64-bit hashes of a text's words, of pairs of adjacent words and of pairs with one word between
(words: runs of letters, digits, apostrophes and non-ASCII bytes, in lower case), each once a text. The learner keeps
a rate for each coordinate; its L1 term leaves few weights, which are broadcast as two sorted arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import grown, mix64, remainder, slices, table, text_bytes, word_hashes

#: Bounds of the sample that is learned from: rows of each class, and the longest text in it, in characters.
SAMPLE, SAMPLE_CHARS = 3000, 100_000
ALPHA, BETA, L1, L2, EPOCHS, MIN_DOCS = 0.5, 1.0, 3.0, 0.1, 4, 8
#: At most so many weights are kept (the largest): 16 bytes each when broadcast.
MOST_WEIGHTS = 200_000
THRESHOLD = 0.7
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 39, *range(128, 256)]] = True
_PAIR, _SKIP = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes of all texts and the text of each (repeated ones included)."""
    words, per, _, _ = word_hashes(raw, offsets, _WORD)
    of = np.repeat(np.arange(len(per) - 1), np.diff(per))
    out, whose = [words], [of]
    for gap, salt in ((1, _PAIR), (2, _SKIP)):
        if len(words) > gap:
            same = of[gap:] == of[:-gap]
            out.append(mix64(words[:-gap] * salt + words[gap:])[same])
            whose.append(of[gap:][same])
    return np.concatenate(out), np.concatenate(whose)


def ftrl(rows: list[np.ndarray], labels: np.ndarray, n: int, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights of n binary features and the bias (which has no L1 term). rows: the features' numbers."""
    z, q = np.zeros(n + 1), np.zeros(n + 1)
    l1 = np.full(n + 1, L1)
    l1[n] = 0.0

    def weights(at):
        za = z[at]
        return np.where(np.abs(za) <= l1[at], 0.0, -(za - np.sign(za) * l1[at]) / ((BETA + np.sqrt(q[at])) / ALPHA + L2))

    r = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in r.permutation(len(rows)):
            at = np.append(rows[i], n)
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - labels[i]
            sigma = (np.sqrt(q[at] + g * g) - np.sqrt(q[at])) / ALPHA
            z[at] += g - sigma * w
            q[at] += g * g
    w = weights(np.arange(n + 1))
    return w[:n], float(w[n])


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All of the bounded sample, in one task: hash and weight of each kept feature; the bias has a null hash."""
    rows, labels = [], []
    for batch in slices(batches, "text"):
        h, of = features(*text_bytes(pc.utf8_lower(batch.column("text"))))
        cuts = np.searchsorted(of_sorted := of[order := np.argsort(of, kind="stable")], np.arange(batch.num_rows + 1))
        h = h[order]
        assert len(of_sorted) == len(h)
        rows += [np.unique(h[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        labels += batch.column("toxic").to_pylist()
    if not rows:
        return
    names, counts = np.unique(np.concatenate(rows), return_counts=True)
    names = names[counts >= MIN_DOCS]
    numbered = []
    for x in rows:
        at = np.searchsorted(names, x)
        at[at == len(names)] = 0
        numbered.append(at[names[at] == x] if len(names) else at[:0])
    order = np.lexsort(([len(x) for x in rows], [int(x[:1].sum()) for x in rows]))  # whatever the rows' order
    w, bias = ftrl([numbered[i] for i in order], np.asarray(labels, float)[order], len(names))
    kept = np.flatnonzero(w)
    kept = np.sort(kept[np.argsort(-np.abs(w[kept]), kind="stable")[:MOST_WEIGHTS]])
    yield pa.RecordBatch.from_arrays([pa.array([None, *names[kept].view(np.int64).tolist()], pa.int64()), pa.array([bias, *w[kept].tolist()], pa.float64())], ["hash", "weight"])


class Model:
    def __init__(self, hashes: np.ndarray, weights: np.ndarray, bias: float):
        order = np.argsort(hashes)
        self.hashes, self.weights, self.bias = hashes[order], weights[order], bias
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def scores(self, array: pa.Array) -> np.ndarray:
        total = np.full(len(array), self.bias)
        if len(self.hashes):
            h, of = features(*text_bytes(pc.utf8_lower(array.cast(pa.string()))))
            maybe = self.seen[(h & np.uint64((1 << 20) - 1)).astype(np.int64)]
            h, of = h[maybe], of[maybe]
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            hit = self.hashes[at] == h
            own = np.unique(np.stack([of[hit], at[hit]], 1), axis=0)
            np.add.at(total, own[:, 0], self.weights[own[:, 1]])
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic. Rows with a null id, text or label, or a text beyond SAMPLE_CHARS,
    aren't learned from. Of each class about `sample` labels are, those of the least hashes: they are picked before
    documents are read, so that only these (2 x sample ids, broadcast) meet the texts. Without rows the model says
    0.5 for every text; with one class only, about its rate."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    picked = [usable.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    wanted = F.broadcast(picked[0].unionByName(picked[1]))
    found = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(wanted, "doc_id").where(F.length("text") <= SAMPLE_CHARS)
    bounded = found.orderBy(F.xxhash64("doc_id", "text"), "toxic").limit(2 * sample)  # ids may repeat in docs
    got = bounded.select("text", "toxic").coalesce(1).mapInArrow(_train, "hash long, weight double").collect()
    bias = next((r["weight"] for r in got if r["hash"] is None), 0.0)
    pairs = [(r["hash"], r["weight"]) for r in got if r["hash"] is not None]
    return Model(np.array([h for h, _ in pairs], np.int64).view(np.uint64), np.array([w for _, w in pairs], float), bias)


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 of the whole text; a null text counts as empty and gets the bias's score. A
    given column of that name gives way; every row is scored alone."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in slices(batches, "__dg_text", 1 << 20):
            names = [n for n in batch.schema.names if n != "__dg_text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(held.value.scores(batch.column("__dg_text")), pa.float64())], [*names, name])

    rest = docs.drop(name)
    return rest.withColumn("__dg_text", F.col(text).cast("string")).mapInArrow(run, grown(rest.schema, **{name: T.DoubleType()}))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a row of documents, each scored alone, by its whole text; null and empty texts get the bias's score, a null
    doc_id counts as empty text for held_out. Ties in the sample go by id; repeated rows of a picked id are all read, up
    to the bound. An empty table gives no rows. Columns but doc_id and text aren't read, of labels doc_id and toxic."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(remainder("doc_id", 3) != 1)
    model = train(docs, labels)
    held_out = (remainder("doc_id", 3) == 1).alias("held_out")
    slim = docs.select("doc_id", F.col("text").alias("__dg_body"), held_out)
    scored = score(slim, model, "__dg_body").drop("__dg_body")
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
