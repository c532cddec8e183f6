"""Personal data (operator 9): patterns propose spans, checksums confirm them, context words adjust their score.

All scans are linear in the text: an e-mail address is sought from its "@" outwards and an IP address in maximal
chains of dotted numbers, which gives the leftmost non-overlapping matches of the plain patterns without their
quadratic backtracking on long runs.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import grown, slices, table

KINDS = ("email", "ip", "card", "phone", "iban")
BASE = KINDS[:4]
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![a-z])")
_DIGIT = re.compile(r"[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_WORD = re.compile(r"[^\W\d_]+")

#: Lengths of account numbers by country, from the public registry (fixed values).
IBAN_LENGTH = {
    "AD": 24, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18,
    "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21,
    "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24, "TR": 26,
}
START_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.9}
NEAR, UP, DOWN = 48, 0.2, 0.3
CONTEXT = {
    "email": {"mail", "email", "contact", "write"},
    "ip": {"ip", "address", "host", "server", "login"},
    "card": {"card", "credit", "visa", "payment", "karte", "carte", "tarjeta"},
    "phone": {"phone", "call", "tel", "telephone", "mobile", "fax", "telefon", "appelez"},
    "iban": {"iban", "account", "bank", "konto", "compte", "cuenta"},
}
AGAINST = {"version", "release", "order", "invoice", "serial", "isbn", "example"}


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(x * 2 - 9 * (x > 4) for x in map(int, digits[-2::-2]))) % 10 == 0


def mod97(code: str) -> bool:
    moved = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            done = m.end()
            yield start, done
            at = text.find("@", done)
        else:
            done = at + 1
            at = text.find("@", done)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _CHAIN.finditer(text):
        parts = m[0].split(".")
        at = m.start()
        for k in range(0, len(parts) - 3, 4):
            own = parts[k : k + 4]
            end = at + sum(map(len, own)) + 3
            if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in own):
                yield at, end
            at = end + 1


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            yield m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    for m in _IBAN.finditer(text):
        want = IBAN_LENGTH.get(m[0][:2])
        have, end = 0, m.start()
        for end, c in enumerate(m[0], m.start() + 1):  # noqa: B007
            have += c != " "
            if have == want:
                break
        code = text[m.start() : end].replace(" ", "")
        if len(code) == (want or len(code)) and mod97(code):
            yield m.start(), end


def find(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by start, then kind as in KINDS. Offsets count code points; the end is exclusive.

    Base kinds: e-mail, ip, card (Luhn), phone. The method adds iban (mod 97). The score starts from the kind's own
    and moves by the words within NEAR code points before the span; no span goes for its score.
    """
    if not text:
        return []
    found: list[tuple[int, int, int]] = []
    if "@" in text:
        found += [(s, 0, e) for s, e in _emails(text)]
    if _DIGIT.search(text):
        found += [(s, 1, e) for s, e in _ips(text)]
        found += [(s, 2, e) for s, e in _cards(text)]
        if "+" in text:
            found += [(s, 3, e) for s, e in _phones(text)]
        found += [(s, 4, e) for s, e in _ibans(text)]
    out = []
    for start, kind, end in sorted(found):
        words = {w.lower() for w in _WORD.findall(text, max(0, start - NEAR), start)}
        score = START_SCORE[KINDS[kind]] + UP * bool(words & CONTEXT[KINDS[kind]]) - DOWN * bool(words & AGAINST)
        out.append((KINDS[kind], start, end, round(min(1.0, max(0.0, score)), 3)))
    return out


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))


def _find_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "__dg_text"):
        spans = [[{"kind": k, "start": s, "end": e, "score": p} for k, s, e, p in find(t)] for t in batch.column("__dg_text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, pa.list_(_SPAN))], [*batch.schema.names, "pii"])


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with pii, an array of (kind, start, end, score). A null or empty text has none; a column that is
    named pii gives way; every row is handled alone, so ties and repeated rows don't matter."""
    docs = docs.drop("pii").withColumn("__dg_text", F.col(text).cast("string"))
    schema = grown(docs.schema, pii=SPANS)
    return docs.mapInArrow(_find_batches, schema).drop("__dg_text")


def joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(kind: str):
    return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a row of documents, repeated ones too: a null or empty text has no spans, counts of 0 and the digest of an
    empty string; of spans alike in start the kind listed first comes first. An empty table gives no rows. Columns but
    doc_id and text aren't read."""
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))
    counts = [_count(kind) for kind in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"), F.array_join(F.transform("pii", lambda s: s["score"].cast("string")), ",").alias("scores"))


def brute_force(text: str | None) -> list[tuple[str, int, int]]:
    """The base spans by the plain patterns, for tests."""
    text = text or ""
    checks = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    }
    found = [(m.start(), BASE.index(k), m.end()) for k, (p, ok) in checks.items() for m in re.finditer(p, text) if ok(m[0])]
    return [(BASE[k], s, e) for s, k, e in sorted(found)]


def sha(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()


def brute_rows(rows: list[tuple[int, str | None]]) -> dict[int, tuple]:
    out = {}
    for doc_id, text in rows:
        spans = brute_force(text)
        out[doc_id] = (*(sum(k == b for k, _, _ in spans) for b in BASE), sha(spans))
    return out
