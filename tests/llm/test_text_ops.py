"""Line dedup, PII, fingerprints and BPE against plain versions."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dotgrain.llm import bpe, fingerprint, line_dedup, pii

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
LONG = "this line is certainly longer than forty code points, é included"


def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def plain_dedup(rows, min_chars=40, min_docs=5):
    holders = {}
    for n, (doc_id, text) in enumerate(rows):
        for k in {line.strip(" \t\n\v\f\r").translate({c: c + 32 for c in range(65, 91)}) for line in (text or "").split("\n")}:
            holders.setdefault(k, set()).add((doc_id is not None, doc_id or 0))
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            k = line.strip(" \t\n\v\f\r").translate({c: c + 32 for c in range(65, 91)})
            if len(k) < min_chars or len(holders[k]) < min_docs or max(holders[k]) == (doc_id is not None, doc_id or 0):
                kept.append(line)
        out.append((doc_id, len(lines), len(lines) - len(kept), None if text is None else "\n".join(kept)))
    return out


def line_rows():
    r = random.Random(3)
    pool = [LONG.upper() if k % 3 else LONG + str(k) for k in range(12)] + ["short", "", "x" * 39, "ü" * 40, " \t" + "y" * 40 + "\r"]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randrange(0, 9)))) for i in range(60)]
    return [*rows, (None, LONG), (None, LONG + "1"), (61, None), (62, ""), (63, LONG), (63, LONG), (64, LONG.lower() * 3000)]


@pytest.mark.parametrize("most", [2_000_000, 4, 0])
def test_line_dedup(spark, most):
    rows = line_rows()
    got = line_dedup.dedup_lines(docs(spark, rows), max_broadcast_keys=most).select("doc_id", "n_lines", "n_dropped", "text").collect()
    key = lambda x: tuple((v is not None, v or 0) if i < 3 else (v or "", v is None) for i, v in enumerate(x))
    assert sorted(map(tuple, got), key=key) == sorted(plain_dedup(rows), key=key)


def test_line_dedup_extra_columns_and_empty(spark):
    df = docs(spark, line_rows()).withColumns({"n_lines": F.lit("mine"), "a": F.lit(1), "n": F.lit(2)})
    out = line_dedup.dedup_lines(df)
    assert set(out.columns) == {"doc_id", "text", "a", "n", "n_lines", "n_dropped"}
    assert out.count() == len(line_rows())
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0


def test_line_dedup_counts_documents(spark):
    """Five rows hold the line, but two documents."""
    rows = [(1, LONG)] * 3 + [(2, LONG)] * 2
    assert {x.n_dropped for x in line_dedup.dedup_lines(docs(spark, rows)).collect()} == {0}


def test_line_dedup_deals_no_lines_that_are_broadcast(spark):
    """The commonest line goes to the index; only lines of other keys are dealt to shards."""
    rows = [(i, LONG + "\n" + LONG + str(i % 40)) for i in range(400)]
    keys = line_dedup.repeated_lines(docs(spark, rows)).orderBy(F.desc("n")).collect()
    hot = spark.createDataFrame([tuple(keys[0])], "a long, b long, n long, keeper long")
    index = line_dedup.Index(spark.sparkContext.broadcast({r["shard"]: bytes(r["data"]) for r in line_dedup.shard_table(hot, 1).collect()}), 1)
    dealt = docs(spark, rows).mapInArrow(lambda it: line_dedup.line_rows(it, 40, index), "a long, b long, doc_id long").groupBy("a", "b").count().collect()
    assert keys[0]["n"] == 400 and max(x["count"] for x in dealt) == 10
    want = sorted(plain_dedup(rows))
    got = line_dedup.dedup_lines(docs(spark, rows), max_broadcast_keys=4).select("doc_id", "n_lines", "n_dropped", "text").collect()
    assert sorted(map(tuple, got)) == want


def test_op7_query_against_its_sql(spark, tmp_path):
    import duckdb

    rows = [x for x in line_rows() if x[0] is not None]
    rows = [x for n, x in enumerate(rows) if x[0] not in {y[0] for y in rows[:n]}]
    docs(spark, rows).withColumns({"n_lines": F.lit("mine"), "a": F.lit(1)}).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    want = duckdb.connect().execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'").execute(line_dedup.OP7_SQL).fetchall()
    assert sorted(map(tuple, line_dedup.op7_line_dedup(spark, str(tmp_path)).collect())) == sorted(want)


def test_perfect_hash():
    r = np.random.default_rng(1)
    a, b = r.integers(-(2**63), 2**63 - 1, (2, 5000))
    mph = line_dedup.PerfectHash.build(a, b)
    assert sorted(mph.index(a, b)) == list(range(5000))


def test_pii_against_plain_patterns(spark):
    r = random.Random(5)
    bits = ["a@b.c", "x.y+z@host-1.example.org", "@", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8.9", "4111 1111 1111 1111", "4785380592391139", "+49 (30) 123-4567", "+1", " ", "-", "é", "007.1.2.3", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "5500-0000-0000-0004", "."]
    rows = [(i, "".join(r.choice(bits) + r.choice(["", " ", "", "a"]) for _ in range(r.randrange(0, 30)))) for i in range(400)]
    rows += [(400, None), (401, ""), (402, "9" * 50_000), (403, "1.2.3.4." * 5000), (404, "a" * 50_000 + "@")]
    for _, text in rows[:-3]:
        assert [(k, s, e) for k, s, e, _ in pii.find(text) if k in pii.BASE] == pii.brute_force(text)
    found = pii.find_pii(docs(spark, rows).withColumn("pii", F.lit(1)))
    assert found.columns == ["doc_id", "text", "pii"] and found.count() == len(rows)
    assert [x[0] for x in pii.find("pay to DE89 3704 0044 0532 0130 00 OR")] == ["iban"]
    assert pii.find("bank account GB82WEST12345698765432")[0][3] > pii.find("serial GB82WEST12345698765432")[0][3]


def test_op9_query(spark, tmp_path):
    rows = [(1, "mail a@b.co or 10.0.0.1"), (2, None), (3, "+49 30 1234567"), (3, "+49 30 1234567")]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    want = pii.brute_rows(rows)
    for r in pii.op9_pii(spark, str(tmp_path)).collect():
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == want[r.doc_id]


def slow_fingerprint(data: bytes) -> tuple[list[int], int]:
    """Chunk ends by the rolling hash, computed byte by byte."""
    size = 3
    while size * 64 < len(data):
        size *= 2
    hashes = []
    for i in range(len(data)):
        last = [data[i - k] if i >= k else 0 for k in range(7)]
        x = 0
        for k, b in enumerate(last):
            x ^= (b << 5 * k) & 0xFFFFFFFF
        hashes.append((sum(last) + sum(b * (7 - k) for k, b in enumerate(last)) + x) & 0xFFFFFFFF)
    return [i for i, h in enumerate(hashes) if h % size == size - 1], size


def test_fingerprint_boundaries_and_likeness():
    r = random.Random(2)
    texts = [bytes(r.choice(b"abcde fgh") for _ in range(n)) for n in (0, 1, 5, 200, 3000)]
    prints = fingerprint.fingerprints(texts)
    for t, p in zip(texts, prints, strict=True):
        ends, size = slow_fingerprint(t)
        n, one, _ = p.split(":")
        assert int(n) == size and len(one) == (len(ends) + (not ends or ends[-1] + 1 < len(t)) if t else 0)
        assert fingerprint.fingerprints([t])[0] == p and fingerprint.likeness(p, p) == 1
    near = fingerprint.fingerprints([texts[4][:1500] + b"XYZ" + texts[4][1500:]])[0]
    assert fingerprint.likeness(near, prints[4]) > 0.8 > fingerprint.likeness(prints[3], prints[4])

    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row, old = [0], row
            for j, y in enumerate(b):
                row.append(max(row[-1], old[j + 1], old[j] + 1 if x == y else 0))
        return row[-1]

    for _ in range(50):
        a, b = ("".join(r.choice("abc") for _ in range(r.randrange(0, 40))) for _ in range(2))
        assert fingerprint.common_subsequence(a, b) == slow(a, b)


@pytest.mark.parametrize("parts", [1, 5])
def test_compare_with_edited(spark, parts):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = [(7, "héllo wörld " * 30), (3, None), (5, ""), (5, ""), (9, "z" * 5000), (1, "some words of text here"), (None, "null id")]
    rows += [(100 + i, f"document number {i} " * (i % 13)) for i in range(60)]
    got = fingerprint.compare_with_edited(docs(spark, rows).repartition(parts)).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0))
    want = []
    for a, b in zip(order, order[1:] + order[:1], strict=True):
        t, u = a[1] or "", b[1] or ""
        e = fingerprint.edited(t, u)
        p = fingerprint.fingerprints([t.encode(), e.encode(), u.encode()])
        want.append((a[0], len(t), hashlib.sha256(e.encode()).hexdigest(), p[0], p[1], fingerprint.likeness(p[0], p[1]), fingerprint.likeness(p[0], p[2])))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert fingerprint.compare_with_edited(docs(spark, [])).count() == 0
    assert fingerprint.compare_with_edited(docs(spark, [(1, "abcd")])).count() == 1
    assert fingerprint.add_fingerprints(docs(spark, rows).withColumn("fingerprint", F.lit(0))).count() == len(rows)


def test_bpe_round_trip_and_reference(spark):
    import tiktoken

    path, pattern = bpe.default_vocabulary()
    ranks = bpe.load_ranks(path)
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(4)
    texts = ["".join(r.choice(["the", "ation", " ", "  \n", "é", "ü", "日本", "🙂", "12", "'s", "!?", "x", "\t"]) for _ in range(40)) for _ in range(300)]
    rows = [*enumerate(texts), (900, None), (901, ""), (902, "a" * 100_000), (903, " " * 5000 + "<|endoftext|>")]
    ids = bpe.encode(docs(spark, rows).withColumn("ids", F.lit("x")), path, pattern)
    back = bpe.decode(ids.withColumnRenamed("text", "given"), path)
    for x in back.collect():
        assert x.text == (x.given or "")
        assert x.ids == own.encode_ordinary(x.given or "")


def test_bpe_of_an_empty_table_and_long_random_pieces(spark):
    import tiktoken

    path, pattern = bpe.default_vocabulary()
    assert bpe.encode(docs(spark, []), path, pattern, decoded="said").count() == 0
    own, r = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(path), special_tokens={}), random.Random(9)
    texts = ["".join(chr(r.choice([97, 98, 99, 233, 0x4E00, 115, 116, 101])) for _ in range(4000)), "ab" * 1500]
    assert [x.tolist() for x in bpe.Encoder(path, pattern)(texts)] == [own.encode_ordinary(t) for t in texts]


def test_narrow_pattern():
    path, pattern = bpe.default_vocabulary()
    quick, r = bpe.narrow(pattern), random.Random(5)
    full = bpe.regex.compile(pattern)
    for _ in range(3000):
        text = "".join(chr(r.choice([r.randrange(0x80), r.randrange(0x250), r.randrange(bpe.NARROW), 32, 10, 39, 0x1C])) for _ in range(r.randrange(40)))
        assert quick.findall(text) == full.findall(text)
    assert bpe.narrow(r"(?i:'s)|\S+") is None and bpe.narrow(r"[\S]") is None and bpe.narrow(r"\p{Lu}") is None


def test_op3_query(spark, tmp_path):
    rows = [(1, "Hello wörld  🙂"), (2, None), (2, ""), (3, "x\ny")]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    path, pattern = bpe.default_vocabulary()
    encoder, sha = bpe.Encoder(path, pattern), lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted((i, len(ids := encoder([t or ""])[0].tolist()), sha(" ".join(map(str, ids))), sha(t or "")) for i, t in rows)
    assert sorted(map(tuple, bpe.op3_bpe(spark, str(tmp_path)).collect())) == want


def test_bpe_pairs_and_small_memory(monkeypatch):
    monkeypatch.setattr(bpe, "MOST_MOVES", 50)
    monkeypatch.setattr(bpe, "AHEAD", 20)
    ranks = bpe.load_ranks(bpe.default_vocabulary()[0])
    machine, r = bpe.Transducer(ranks), random.Random(6)
    for _ in range(50):
        pieces = [bytes(r.choice(b"theraionsd g") for _ in range(r.randrange(1, 60))) for _ in range(10)]
        assert [np.frombuffer(x, np.int32).tolist() for x in machine.encode(pieces)] == [bpe.merge(p, ranks) for p in pieces]
    tokens = list(ranks.items())
    pairs = [(r.choice(tokens), r.choice(tokens)) for _ in range(2000)]
    x, y = (np.array([p[k][1] for p in pairs]) for k in (0, 1))
    every = np.unique(np.concatenate([x, y]))
    machine._learn(every[machine.left_of[every] < 0])
    said = machine.may_follow(machine.class_of[x], y)
    for ((a, i), (b, j)), ok in zip(pairs, said, strict=True):
        assert ok == (bpe.merge(a + b, ranks) == [i, j])


def test_bpe_table():
    r = np.random.default_rng(2)
    keys, table = np.unique(r.integers(0, 1 << 62, 30_000)), bpe.Table()
    for part in np.array_split(keys, 7):
        table.add(part, part % 1000)
    assert (table.find(keys) == keys % 1000).all() and (table.find(keys + 1)[~np.isin(keys + 1, keys)] == -1).all()


def test_utf8_stream():
    r = random.Random(8)
    data = "aé日🙂".encode() * 20
    for _ in range(50):
        machine, at, out = bpe.Utf8Stream(), 0, ""
        while at < len(data):
            n = r.randrange(1, 6)
            out += machine.feed(data[at : at + n])
            at += n
        assert out + machine.end() == data.decode()
    assert bpe.Utf8Stream().feed(b"\xff\xe2\x28") == "��("
