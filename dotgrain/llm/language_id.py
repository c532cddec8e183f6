"""Language ID (operator 6): a byte convolutional network, trained in numpy.

Windows of WINDOW bytes cover the whole text. Filters of several widths run over the one-hot bytes (A-Z in lower
case), each filter's greatest value in the window passes a ReLU, and a softmax layer gives the languages. A text's
logits are the mean of its windows'. Applying the filters is table lookup: a filter of width 4 is the sum of two
lookups by byte pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import grown, remainder, slices, table, text_bytes

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 8
#: Bounds of the sample that is learned from: distinct texts a language, windows a text, languages.
PER_LANGUAGE, PER_TEXT, MOST_LANGUAGES = 600, 2, 256
EPOCHS, BATCH, RATE = 6, 32, 0.01
UNKNOWN = "und"
LETTER = r"\p{L}"
_LETTER = regex.compile(LETTER)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PAD = max(WIDTHS) - 1


class Network:
    def __init__(self, languages: list[str], seed: int = 3):
        r = np.random.default_rng(seed)
        self.languages = languages
        self.filters = {w: (r.standard_normal((w, 256, FILTERS)) * 0.1).astype(np.float32) for w in WIDTHS}
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.dense = (r.standard_normal((len(WIDTHS) * FILTERS, len(languages))) * 0.1).astype(np.float32)
        self.shift = np.zeros(len(languages), np.float32)
        self.pairs: dict | None = None

    def __getstate__(self):
        return {**self.__dict__, "pairs": None}

    def freeze(self) -> None:
        """Tables by byte pairs; made once by each worker."""
        if self.pairs is None:
            self.pairs = {(w, k): (f[k][:, None, :] + f[k + 1][None, :, :]).reshape(65536, FILTERS) for w, f in self.filters.items() for k in range(0, w - 1, 2)}

    def logits(self, windows: np.ndarray) -> np.ndarray:
        """windows: bytes, (n, WINDOW + _PAD)."""
        self.freeze()
        wide = windows.astype(np.int32)
        pair = (wide[:, :-1] << 8) | wide[:, 1:]
        pooled = []
        for w, f in self.filters.items():
            out = None
            for k in range(0, w, 2):
                part = self.pairs[w, k][pair[:, k : k + WINDOW]] if k + 1 < w else f[k][windows[:, k : k + WINDOW]]
                out = part if out is None else np.add(out, part, out=out)
            pooled.append(out.max(1))
        return np.maximum(np.concatenate(pooled, 1) + self.bias, 0) @ self.dense + self.shift

    def train(self, windows: np.ndarray, labels: np.ndarray, seed: int = 4) -> None:
        """Adam on the cross entropy. Only the place of each filter's maximum gets a gradient."""
        r = np.random.default_rng(seed)
        params = [*self.filters.values(), self.bias, self.dense, self.shift]
        first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(EPOCHS):
            order = r.permutation(len(windows))
            for at in range(0, len(order), BATCH):
                x, y = windows[order[at : at + BATCH]], labels[order[at : at + BATCH]]
                n, pooled, where = len(x), [], []
                for w, f in self.filters.items():
                    out = f[0][x[:, :WINDOW]]
                    for k in range(1, w):
                        out += f[k][x[:, k : k + WINDOW]]
                    best = out.argmax(1)
                    where.append(best)
                    pooled.append(np.take_along_axis(out, best[:, None], 1)[:, 0])
                before = np.concatenate(pooled, 1) + self.bias
                hidden = np.maximum(before, 0)
                z = hidden @ self.dense + self.shift
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(n), y] -= 1
                p /= n
                back = (p @ self.dense.T) * (before > 0)
                grads = []
                for i, (w, f) in enumerate(self.filters.items()):
                    own, g = back[:, i * FILTERS : (i + 1) * FILTERS], np.zeros_like(f)
                    for k in range(w):
                        np.add.at(g[k], (x[np.arange(n)[:, None], where[i] + k], np.arange(FILTERS)[None, :]), own)
                    grads.append(g)
                grads += [back.sum(0), hidden.T @ p, p.sum(0)]
                step += 1
                for q, g, m, v in zip(params, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    q -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)

    def predict(self, array: pa.Array) -> tuple[list[str], np.ndarray]:
        raw, offsets = text_bytes(array)
        texts = array.to_pylist()
        known = np.array([bool(t) and _LETTER.search(t) is not None for t in texts], bool)
        sizes = np.diff(offsets)
        count = np.where(known, -(-sizes // WINDOW), 0)
        total, at = np.zeros((len(texts), len(self.languages))), np.repeat(np.arange(len(texts)), count)
        starts = offsets[at] + WINDOW * (np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count))
        lowered = np.concatenate([_LOWER[raw], np.zeros(WINDOW + _PAD, np.uint8)])
        span = np.arange(WINDOW + _PAD)
        for lo in range(0, len(at), 256):
            s, own = starts[lo : lo + 256], at[lo : lo + 256]
            x = lowered[s[:, None] + span]
            x[span >= (offsets[own + 1] - s)[:, None]] = 0
            np.add.at(total, own, self.logits(x))
        mean = total / np.maximum(count, 1)[:, None]
        p = np.exp(mean - mean.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.where(known, p.max(1), 0.0)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text PER_TEXT windows, at places that its hash gives."""
    for batch in slices(batches, "text"):
        out = []
        for text, h in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("h").to_pylist(), strict=True):
            text = text or b""
            spare = max(1, len(text) - WINDOW + 1)
            places = {(h % (1 << 61) * (2 * k + 1) + k * 7919) % spare for k in range(PER_TEXT)}
            out.append([text[p : p + WINDOW + _PAD] for p in sorted(places)])
        yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("lang"), pa.array(out, pa.list_(pa.binary()))], ["h", "lang", "windows"])


def train(labelled: DataFrame) -> Network | None:
    """labelled: text, lang. Rows with a null lang or no letter in the text aren't learned from. Of each of the
    MOST_LANGUAGES languages with most texts about PER_LANGUAGE distinct texts are, those of the least hashes: copies
    count once. Ties in number go by the language's name, texts alike in hash count as copies. Only windows of the
    texts leave their tasks. None: no such rows."""
    most = (1 << 62) - 1
    usable = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(LETTER)).select("text", "lang")
    hashed = usable.withColumn("h", F.xxhash64("text", "lang").bitwiseAND(F.lit(most)))
    counts = hashed.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()
    if not counts:
        return None
    spark = labelled.sparkSession
    limits = spark.createDataFrame([(r["lang"], min(most, 5 * PER_LANGUAGE * most // (4 * max(1, r["n"])))) for r in counts], "lang string, most long")
    picked = hashed.join(F.broadcast(limits), "lang").where("h <= most").select("h", "lang", "text")
    windows = picked.mapInArrow(_sampled, "h long, lang string, windows array<binary>").groupBy("h", "lang").agg(F.first("windows").alias("windows"))
    rows = windows.orderBy("h", "lang").limit(2 * PER_LANGUAGE * len(counts)).collect()
    by: dict[str, list[bytes]] = {}
    for r in sorted(rows, key=lambda r: (r["h"], r["lang"])):
        if len(own := by.setdefault(r["lang"], [])) < PER_LANGUAGE * PER_TEXT:
            own.extend(map(bytes, r["windows"]))
    languages = sorted(by)
    if not languages:
        return None
    x = np.zeros((sum(map(len, by.values())), WINDOW + _PAD), np.uint8)
    y = np.repeat(np.arange(len(languages)), [len(by[lang]) for lang in languages])
    for i, piece in enumerate(p for lang in languages for p in by[lang]):
        x[i, : len(piece)] = _LOWER[np.frombuffer(piece, np.uint8)]
    net = Network(languages)
    net.train(x, y)
    return net


def identify(docs: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """docs with lang_pred and score (0 to 1). A text that is null or has no letter is "und" with score 0, as is any
    text without a network; with one language, that is said of every other text. Given columns of these names give
    way; every row is handled alone."""
    rest = docs.drop("lang_pred", "score")
    if net is None:
        return rest.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    held = docs.sparkSession.sparkContext.broadcast(net)  # bounded by MOST_LANGUAGES

    def run(batches):
        for batch in slices(batches, "__dg_text", 1 << 20):
            names = [n for n in batch.schema.names if n != "__dg_text"]
            said, score = held.value.predict(batch.column("__dg_text"))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(said, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])

    return rest.withColumn("__dg_text", F.col(text).cast("string")).mapInArrow(run, grown(rest.schema, lang_pred=T.StringType(), score=T.DoubleType()))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a row of documents, each scored alone: a null text or one without a letter is "und" with score 0, ties
    between languages go to the first by name, a null doc_id counts as empty text for held_out. An empty table gives
    no rows. Columns but doc_id, text and, for learning, lang aren't read."""
    docs = table(spark, sf_dir, "documents")
    net = train(docs.where(remainder("doc_id", 4) != 2).select("text", "lang"))
    said = identify(docs.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), F.col("text").alias("__dg_body")), net, "__dg_body")
    return said.drop("__dg_body")
