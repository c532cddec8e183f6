"""Joins, deduplication, mixing and learned operators against brute force."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dotgrain.llm import embedding_dedup, graph, jaccard_join, language_id, mixing, substring_dedup, toxicity

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
SYL = ["the", "an", "re", "ing", "ti", "on", "er", "ha", "nd", "st"]


def words(r, n):
    return ["".join(r.choice(SYL) for _ in range(r.randrange(1, 5))) for _ in range(n)]


def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def near_rows():
    r = random.Random(11)
    rows = []
    for g in range(12):
        base = words(r, r.randrange(60, 300))
        for _ in range(r.randrange(1, 9)):
            own = list(base)
            for _ in range(r.randrange(0, max(1, len(base) // 60))):
                own[r.randrange(len(own))] = "changed" + str(r.randrange(99))
            rows.append((len(rows), " ".join(own)))
    shared = " ".join(words(r, 55))
    rows += [(len(rows) + k, " ".join(words(r, 80)) + " " + shared + " " + " ".join(words(r, 80))) for k in range(7)]
    rows += [(500, None), (501, ""), (502, " \t\n"), (503, "one two"), (504, "one two"), (505, "ONE  two"), (None, rows[0][1]), (506, "x " * 4000), (507, "x " * 4000)]
    return [*rows, (3, rows[3][1]), (3, rows[3][1])]


def sets(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute_links(rows):
    s = [sets(t) for _, t in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    best = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        best[find(i)].append((d is None, d or 0, d))
    return [(d, min(best[find(i)])[2] if s[i] else d, links[i]) for i, (d, _) in enumerate(rows)]


KEY = lambda x: tuple((v is not None, v or 0) for v in x)


def test_jaccard_join(spark, monkeypatch):
    rows = near_rows()
    want = sorted(brute_links(rows), key=KEY)
    got = jaccard_join.link(docs(spark, rows)).select("doc_id", "class_id", "n_links").collect()
    assert sorted(map(tuple, got), key=KEY) == want
    monkeypatch.setattr(jaccard_join, "SMALL", 2)
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)
    got = jaccard_join.link(docs(spark, rows), runs=40).select("doc_id", "class_id", "n_links").collect()
    assert sorted(map(tuple, got), key=KEY) == want


def test_jaccard_recall_in_deep_nodes(spark, monkeypatch):
    assert jaccard_join.recall(0.8, jaccard_join.RUNS, jaccard_join.FIRST_DEPTH) >= jaccard_join.RECALL
    assert jaccard_join.recall(0.8, jaccard_join.runs_for(0.8, jaccard_join.DEPTH), jaccard_join.DEPTH) >= jaccard_join.RECALL
    r, rows = random.Random(61), []
    for k in range(400):
        base = words(r, 54)  # 50 shingles; five others make a similarity of 45 / 55
        near = list(base)
        near[r.randrange(8, 46)] = "changed" + str(k)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(near))]
    monkeypatch.setattr(jaccard_join, "SMALL", 1)  # all nodes are split to the last depth
    got = jaccard_join.link(docs(spark, rows)).where("n_links > 0").count()
    assert got >= 2 * 397
    monkeypatch.setattr(jaccard_join, "pays", lambda *_: True)  # whole ones, too
    got = jaccard_join.link(docs(spark, rows)).where("n_links > 0").count()
    assert got >= 2 * 397


def test_jaccard_dense_nodes(spark, monkeypatch):
    """A crowd of near copies isn't split: its links are those of brute force."""
    r, base = random.Random(62), words(random.Random(63), 120)
    rows = []
    for k in range(90):
        own = list(base)
        for _ in range(r.randrange(3)):
            own[r.randrange(len(own))] = "changed" + str(k)
        rows.append((k, " ".join(own)))
    monkeypatch.setattr(jaccard_join, "SMALL", 8)
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    monkeypatch.setattr(jaccard_join, "next_nodes", None)  # not reached
    got = jaccard_join.link(docs(spark, rows)).select("doc_id", "class_id", "n_links").collect()
    assert sorted(map(tuple, got)) == sorted(brute_links(rows))


def test_jaccard_keep_one(spark):
    rows = near_rows()
    kept = jaccard_join.keep_one(docs(spark, rows).withColumns({"key": F.lit(1), "class_id": F.lit("x")}))
    assert kept.columns == ["doc_id", "text", "key", "class_id"]
    linked = brute_links(rows)
    classes = {c for (_, c, _), (_, t) in zip(linked, rows, strict=True) if sets(t)}
    ids = sorted(r.doc_id for r in kept.collect())
    assert ids == sorted([*classes, 500, 501, 502])
    assert jaccard_join.link(docs(spark, [])).count() == 0 and jaccard_join.keep_one(docs(spark, [])).count() == 0


def test_lowest_goes_along_chains():
    keys = np.array([5, 9, 1, 7, 8])
    assert graph.lowest(keys, np.array([[0, 1, 3], [1, 2, 4]])).tolist() == [1, 1, 1, 7, 7]


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(1 << 40), r.randrange(1 << 40)) for _ in range(30)]
    edges += [(edges[i][1], edges[i + 1][0]) for i in range(0, 20)] + [(5, 5)]
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        parent[find(a)] = find(b)
    got = {x.node: x.root for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {n for e in edges for n in e if e[0] != e[1]}
    assert set(got) == nodes
    groups = defaultdict(set)
    for n in nodes:
        groups[find(n)].add(got[n])
    assert all(len(v) == 1 for v in groups.values()) and len({min(v) for v in groups.values()}) == len(groups)


def test_substring_dedup(spark):
    r = random.Random(21)
    passage, other, short = words(r, 70), words(r, 60), words(r, 40)
    rows = []
    for k in range(40):
        parts = words(r, r.randrange(30, 200))
        if k % 4 == 0:
            parts = words(r, 50) + passage + words(r, 40)
        elif k % 4 == 1:
            near = list(other)
            near[30] = "edit" + str(k)
            parts = words(r, 20) + near + words(r, 90)
        elif k % 4 == 2:
            parts = words(r, 50) + short + words(r, 50)
        rows.append((k, " ".join(parts)))
    rows += [(100, rows[3][1]), (101, rows[3][1].upper()), (102, None), (103, ""), (104, "one " * 30), (None, rows[0][1]), (0, rows[0][1])]
    got = substring_dedup.repeats(docs(spark, rows).withColumn("tid", F.lit(0))).collect()
    text = {}
    for d, t in rows:
        text.setdefault(d, (t or "").lower().split())
    hit = defaultdict(set)
    for g in got:
        a, b = text[g.doc_id][g.start : g.end], text[g.other_id][g.other_start : g.other_end]
        p, q = sets(" ".join(a)), sets(" ".join(b))
        assert len(a) >= 50 and len(p & q) / len(p | q) >= 0.8 and abs(len(p & q) / len(p | q) - g.similarity) < 1e-9
        hit[g.doc_id].add(g.other_id)
        hit[g.other_id].add(g.doc_id)
    for k in range(40):
        assert (k in hit) == (k % 4 in (0, 1) or k == 3), k
    assert {100, 101} <= set(hit) and hit[3] and not {102, 103, 104} & set(hit)
    assert substring_dedup.repeats(docs(spark, [])).count() == 0


def test_substring_dedup_pairs_others_than_the_least(spark):
    r = random.Random(31)
    rows = []
    for _ in range(20):
        passage = words(r, 54)
        variant = list(passage)
        for at in (6, 20, 34, 48):  # similar to the passage, but far below the threshold
            variant[at] = "edit" + str(at)
        for own in (variant, variant, passage, passage):
            rows.append((len(rows), " ".join(words(r, 60) + own + words(r, 60))))
    got = substring_dedup.repeats(docs(spark, rows)).select("doc_id", "other_id").distinct().collect()
    pairs = {tuple(sorted(g)) for g in got}
    assert pairs == {p for k in range(0, 80, 4) for p in ((k, k + 1), (k + 2, k + 3))}


def test_group_links_compare_what_a_leader_leaves():
    r = np.random.default_rng(3)
    base = r.permutation(5000)[:200]

    def links(windows):
        lengths = np.array([len(w) for w in windows])
        ids = np.full((len(windows), lengths.max()), -1)
        for row, w in zip(ids, windows, strict=True):
            row[: len(w)] = w
        return substring_dedup.group_links(np.arange(len(windows)) + 1, ids, lengths, ids >= 0, 46, 0.8)

    got, stands = links([base[:60], base[:90], base[:90]])  # the first lacks the last 30
    assert got == [(0, 1), (0, 2), (1, 2)] and stands[:2].all()
    got, stands = links([base[:60]] * 5)
    assert got == [(0, q) for q in range(1, 5)] and stands.tolist() == [True] + [False] * 4
    got, stands = links([base[:60], base[100:160], base[:60]])
    assert got == [(0, 2)] and stands.tolist() == [True, True, False]


def test_substring_dedup_cuts_large_groups(spark, monkeypatch):
    """With parts of 8 windows, a passage in 60 texts and its variants are found as in whole groups."""
    r = random.Random(77)
    passage, variant = words(r, 70), words(r, 70)
    rows = [(k, " ".join(words(r, 40) + (passage if k % 3 else variant) + words(r, 40))) for k in range(60)]
    monkeypatch.setattr(substring_dedup, "PART", 8)
    monkeypatch.setattr(substring_dedup, "SHRINK", 4)
    parent = {k: k for k, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for g in substring_dedup.repeats(docs(spark, rows)).collect():
        parent[find(g.doc_id)] = find(g.other_id)
    assert len({find(k) for k in parent if k % 3}) == 1 and len({find(k) for k in parent if not k % 3}) == 1


def test_substring_dedup_triples(spark):
    """B and C are near each other; A is near both, but below the threshold. B and C are found all the same."""
    r, rows = random.Random(91), []
    for k in range(100):
        base = words(r, 60)
        b, c, a = list(base), list(base), list(base)
        c[30] = "edit" + str(k)
        for at in (8, 24, 40, 55):
            a[at] = "other" + str(at)
        rows += [(3 * k + i, " ".join(words(r, 40) + own + words(r, 40))) for i, own in enumerate((a, b, c))]
    got = {tuple(sorted((g.doc_id, g.other_id))) for g in substring_dedup.repeats(docs(spark, rows)).collect()}
    assert sum((3 * k + 1, 3 * k + 2) in got for k in range(100)) >= 97


def test_substring_dedup_lists_near_pairs_of_a_crowd(spark):
    """Each two of 12 texts share a passage of 120 words but for a word of each: all pairs are listed."""
    r = random.Random(93)
    base, rows = words(r, 120), []
    for k in range(12):
        own = list(base)
        own[5 + 10 * k if k < 11 else 60] = "edit" + str(k)
        rows.append((k, " ".join(words(r, 40) + own + words(r, 40))))
    got = {tuple(sorted((g.doc_id, g.other_id))) for g in substring_dedup.repeats(docs(spark, rows)).collect()}
    assert got == {(i, j) for j in range(12) for i in range(j)}


def test_substring_dedup_edits_in_the_middle(spark):
    """Four words replaced in the middle of 84: no 46 shingles in a row have 40 in common, the passage has 72 of 88."""
    r, rows = random.Random(95), []
    for k in range(40):
        base = words(r, 84)
        for i in range(3):
            own = list(base)
            own[40:44] = [f"edit{k}of{i}at{j}" for j in range(4)] if i else own[40:44]
            rows.append((3 * k + i, " ".join(words(r, 40) + own + words(r, 40))))
    got = {tuple(sorted((g.doc_id, g.other_id))) for g in substring_dedup.repeats(docs(spark, rows)).collect()}
    assert len(got & {(3 * k + i, 3 * k + j) for k in range(40) for j in range(3) for i in range(j)}) >= 117


def test_group_links_leave_out_only_what_a_class_gives():
    r = np.random.default_rng(5)
    base = r.permutation(5000)[:200]
    edited = base[:80].copy()
    edited[30:35] = 6000 + np.arange(5)
    beyond = np.concatenate([base[:60], [7000, 7001]])
    windows = [base[:60], base[:60], base[:60], edited, edited[:79], beyond, beyond]
    lengths = np.array([len(w) for w in windows])
    ids = np.full((len(windows), lengths.max()), -1)
    for row, w in zip(ids, windows, strict=True):
        row[: len(w)] = w
    _, n = np.unique(ids[ids >= 0], return_counts=True)
    shared = np.isin(ids, np.unique(ids[ids >= 0])[n > 1])
    tid = np.arange(len(windows)) + 1
    every = {(i, j) for j in range(len(windows)) for i in range(j)}
    got, stands = substring_dedup.group_links(tid, ids, lengths, shared, 46, 0.8)
    assert stands.tolist() == [True, False, False, True, False, True, False]
    assert every - set(got) == {(i, j) for i, j in every if i in (1, 2, 4) and j in (2, 4, 6)}
    side = tid % 2 == 0
    across, _ = substring_dedup.group_links(tid, ids, lengths, shared, 46, 0.8, side)
    assert {(i, j) for i, j in every if side[i] != side[j]} - set(across) == set()


def test_substring_dedup_recall_by_pair(spark):
    r, rows = random.Random(51), []
    for k in range(300):
        passage = words(r, 50)
        near = list(passage)
        near[r.randrange(8, 42)] = "edit" + str(k)
        rows += [(2 * k + i, " ".join(words(r, 30) + own + words(r, 30))) for i, own in enumerate((passage, near))]
    got = substring_dedup.repeats(docs(spark, rows)).collect()
    assert len({g.doc_id // 2 for g in got if g.doc_id // 2 == g.other_id // 2}) >= 296


def test_substring_dedup_writes_no_pairs_of_windows(spark, monkeypatch):
    """They are many more than the pairs of texts that they are gathered to."""
    r, rows, tags = random.Random(55), [], []
    base = words(r, 120)
    rows = [(k, " ".join(words(r, 20) + base + words(r, 20))) for k in range(6)]
    stage = substring_dedup.stage
    monkeypatch.setattr(substring_dedup, "stage", lambda df, tag: tags.append(tuple(df.columns)) or stage(df, tag))
    got = substring_dedup.repeats(docs(spark, rows)).collect()
    assert {k for g in got for k in (g.doc_id, g.other_id)} == set(range(6))
    assert tags and ("tid", "rep", "place", "other") not in tags


def test_align_follows_diagonals():
    r = random.Random(41)

    def hashed(w):
        return np.array([zlib.crc32(" ".join(w[i : i + 5]).encode()) for i in range(len(w) - 4)], np.uint64)

    passage, phrase = words(r, 80), words(r, 6)
    passage[10:16] = passage[45:51] = phrase
    x, y = words(r, 30) + passage + words(r, 30), words(r, 50) + passage + words(r, 9)
    assert [m[:4] for m in substring_dedup.align(hashed(x), hashed(y), 46, 0.8)] == [(30, 105, 50, 125)]
    early = words(r, 20) + passage[20:27] + words(r, 40) + passage[:60]  # one of its phrases also stands before
    assert [m[:4] for m in substring_dedup.align(hashed(passage[:60]), hashed(early), 46, 0.8)] == [(0, 55, 67, 122)]
    twice = passage + words(r, 40) + passage
    assert [m[:4] for m in substring_dedup.align(hashed(passage), hashed(twice), 46, 0.8)] == [(0, 75, 0, 75), (0, 75, 120, 195)]
    few = np.array([r.randrange(2) for _ in range(600)], np.uint64)  # very many runs
    planted = np.arange(9, 69, dtype=np.uint64)
    found = substring_dedup.align(np.concatenate([few, planted]), np.concatenate([planted, few[::-1]]), 46, 0.8)
    assert any(p <= 600 and q >= 659 and u == 0 and v >= 59 for p, q, u, v, _ in found)
    one = np.zeros(4000, np.uint64)
    assert substring_dedup.align(one, one, 46, 0.8) == [(0, 3999, 0, 3999, 1.0)]


def test_compact_windows_are_the_tree_nodes():
    r = np.random.default_rng(4)
    h = r.integers(0, 1 << 60, 300).astype(np.uint64)
    starts = np.array([0, 120, 130, 300])
    got = {(int(t), int(a), int(b), int(v)) for t, a, b, v in zip(*substring_dedup.compact_windows(h, starts, 20), strict=True)}
    want = set()
    for t, (lo, hi) in enumerate(zip(starts, starts[1:], strict=False)):
        for c in range(lo, hi):
            a = b = c
            while a > lo and h[a - 1] > h[c]:
                a -= 1
            while b + 1 < hi and h[b + 1] > h[c]:
                b += 1
            if b - a + 1 >= 20:
                want.add((t, max(a, c - 19) - lo, min(b, c + 19) - lo, int(h[c])))
    assert got == want


SIZED = "doc_id long, source string, size long, name string"


def sized_rows():
    r = random.Random(7)
    rows = []
    for s, n in (("a", 900), ("b", 40), ("c", 300), (None, 25), ("é", 1), ("Z", 60)):
        rows += [(len(rows) + k, s, r.choice([0, 1, 10, 50, 200, r.randrange(1, 400)]), "x") for k in range(n)]
    return [*rows, (1, "a", 50, "x"), (1, "a", 50, "x"), (None, "b", 10, "y"), (9000, "none", 0, "z")]


@pytest.mark.parametrize("group", [16, 512])
def test_mixing(spark, monkeypatch, group):
    monkeypatch.setattr(mixing, "GROUP", group)
    rows = sized_rows()
    df = spark.createDataFrame(rows, SIZED)
    out = mixing.mix(df.withColumn("copies", F.lit("mine")), F.col("size")).collect()
    assert len(out) == len(rows)
    total = defaultdict(int)
    for _, s, n, _ in rows:
        total[s] += n
    order = [*sorted(s for s in total if s is not None), None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    while True:
        left = 1.5 * sum(total.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * total[s]}
        if not over:
            target |= share
            break
        target |= {s: 2 * total[s] for s in over}
        open_ -= over
    taken, biggest = defaultdict(int), defaultdict(int)
    for x in out:
        assert abs(x.target - target[x.source]) < 1e-6 and x.source_size == total[x.source] and 0 <= x.copies <= 2
        assert x.copies == 0 or x["size"] > 0
        taken[x.source] += x.copies * x["size"]
        biggest[x.source] = max(biggest[x.source], x["size"])
    for s in order:
        assert abs(taken[s] - target[s]) <= biggest[s] + 1e-6
    again = mixing.mix(df.repartition(5), F.col("size")).collect()
    same = lambda o: sorted((x.doc_id or -1, x["size"], x.copies) for x in o)
    assert same(out) == same(again)
    assert mixing.mix(df.limit(0), F.col("size")).count() == 0


def test_mixing_settles_with_short_documents(spark):
    """Log-normal sizes in sources of 60 to 3,000 documents: each comes nearer to its target than 1 % or its shortest."""
    r = np.random.default_rng(8)
    rows = [(int(i), f"s{k:02d}", int(v)) for k in range(12) for i, v in enumerate(np.exp(r.normal(6, 1.2, (60, 400, 3000)[k % 3])) + 1)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long"), F.col("size")).collect()
    taken, target = defaultdict(int), {x.source: x.target for x in out}
    for x in out:
        assert x.copies <= 2
        taken[x.source] += x.copies * x["size"]
    for s in target:
        shortest = min(n for _, t, n in rows if t == s)
        assert abs(taken[s] - target[s]) <= max(shortest, 0.01 * target[s]), s


def test_settled_groups():
    r = random.Random(3)
    for _ in range(300):
        sizes = sorted((int(r.lognormvariate(6, 1.2)) + 1 for _ in range(60)), reverse=True)
        p = [r.random() for _ in sizes]
        out = mixing.settled(p, [float(s) for s in sizes], [r.random() for _ in sizes])
        assert set(out) <= {0.0, 1.0}
        assert abs(sum(a * s for a, s in zip(out, sizes, strict=True)) - sum(a * s for a, s in zip(p, sizes, strict=True))) <= max(sizes[-1], 0.01 * sum(sizes))


def test_mixing_is_unbiased(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), (F.col("id") % 90 + 1).alias("size"))
    counts = np.zeros(3000)
    for seed in range(6):
        for x in mixing.mix(df, F.col("size"), share=0.4, seed=seed).collect():
            counts[x.doc_id] += x.copies
    assert abs(counts.mean() / 6 - 0.4) < 0.02
    big = counts[np.arange(3000) % 90 > 60].mean() / 6
    assert abs(big - 0.4) < 0.04


def test_word_count(spark):
    got = docs(spark, [(1, " a\tb c  d\n"), (2, None), (3, "")]).select(mixing.n_words().alias("n")).collect()
    assert [g.n for g in got] == [3, 0, 0]


def vectors():
    r = np.random.default_rng(5)
    rows = []
    for label in (0, 1):
        base = r.standard_normal((30, 16))
        for b in base:
            for _ in range(r.integers(1, 5)):
                rows.append((len(rows), [float(v) for v in (b + r.standard_normal(16) * r.choice([0.02, 0.2, 0.3])).astype(np.float32)], label))
    v = rows[0][1]
    rows += [(900, v, 0), (901, v, 0), (902, v, None), (903, None, 0), (904, [0.0] * 16, 0), (905, [float("nan"), *v[1:]], 0), (906, [None, *v[1:]], 0), (907, v[:8], 0), (908, [], 0), (909, [x * 1e-30 for x in v], 0)]
    return [*rows, (900, v, 0), (None, v, 0)]


def test_embedding_dedup(spark, monkeypatch):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")

    def good(e):
        return e and all(v is not None and np.isfinite(v) for v in e) and any(e)

    x = [np.array(e, np.float32).astype(float) if lab is not None and good(e) else None for _, e, lab in rows]
    n, near = len(rows), defaultdict(set)
    for i in range(n):
        for j in range(i):
            if x[i] is not None and x[j] is not None and rows[i][2] == rows[j][2] and len(x[i]) == len(x[j]) and x[i] @ x[j] / np.linalg.norm(x[i]) / np.linalg.norm(x[j]) >= 0.93:
                near[i].add(j)
                near[j].add(i)
    want = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        c = min(ids) if ids else None
        want.append((rows[i][0], len(near[i]), c, c is not None and rows[i][0] == c))
    got = embedding_dedup.link(df).collect()
    key = lambda t: tuple((v is not None, v or 0) for v in t)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 4)
    monkeypatch.setattr(embedding_dedup, "BUCKET", 4)
    assert sorted(map(tuple, embedding_dedup.link(df).collect()), key=key) == sorted(want, key=key)
    assert embedding_dedup.link(df.limit(0)).count() == 0


def test_rotation_code_estimates():
    r = np.random.default_rng(9)
    x = embedding_dedup._unit(r.standard_normal((400, 64)))
    codes = embedding_dedup.encode(x)
    factor, lost, signs, rounded = embedding_dedup.decode(codes, 64)
    assert codes.shape == (400, 12 + 16 + 64)
    assert (np.linalg.norm(x - rounded, axis=1) <= lost).all() and lost.max() < 0.03
    assert np.allclose(factor, (embedding_dedup.turn(x) * signs).sum(1), atol=1e-5)
    guess, bound = embedding_dedup.estimate(embedding_dedup.turn(x), signs, factor)
    error = guess - x @ x.T
    off = ~np.eye(400, dtype=bool)
    assert abs(error[off].mean()) < 0.002 and (np.abs(error) <= bound).mean() > 0.999
    guess, bound = embedding_dedup.estimate(embedding_dedup.turn(rounded), signs, factor)
    assert (np.abs(guess - x @ x.T) <= bound + lost[:, None]).mean() > 0.999


def test_embedding_dedup_recall_in_a_large_label(spark):
    """20,000 vectors of one label, at production parameters: many pairs just above the threshold."""
    r = np.random.default_rng(12)
    base = r.standard_normal((10_000, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    away = r.standard_normal((10_000, 32))
    away -= (away * base).sum(1, keepdims=True) * base
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    cos = r.uniform(0.925, 0.95, 10_000)[:, None]
    x = np.concatenate([base, cos * base + np.sqrt(1 - cos**2) * away]).astype(np.float32)
    exact = embedding_dedup._unit(x.astype(np.float64))
    want = np.zeros(len(x), np.int64)
    for at in range(0, len(x), 1000):
        want[at : at + 1000] = (exact[at : at + 1000] @ exact.T >= 0.93).sum(1) - 1
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>, label int")
    got = {v.vec_id: v.n_links for v in embedding_dedup.link(df).collect()}
    found = np.array([got[i] for i in range(len(x))])
    assert (found <= want).all() and found.sum() >= 0.999 * want.sum() > 10_000


def test_op8_query_against_its_sql(spark, tmp_path):
    import duckdb

    rows = [x for x in vectors() if x[0] is not None and x[0] < 900]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"key": F.lit(1), "code": F.lit("x"), "side": F.lit(0)})
    df.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    want = duckdb.connect().execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'").execute(embedding_dedup.OP8_SQL).fetchall()
    assert sorted(map(tuple, embedding_dedup.op8_embedding_dedup(spark, str(tmp_path)).collect())) == sorted(want)


def toxic_rows():
    r = random.Random(13)
    bad = ["idiot", "scum", "moron"]
    rows, labels = [], []
    for i in range(900):
        w = words(r, r.randrange(5, 80))
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(bad))
        rows.append((i, " ".join(w)))
        if i % 3:
            labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity(spark, tmp_path):
    rows, labels = toxic_rows()
    rows += [(5000, None), (5001, ""), (5001, ""), (5002, "scum idiot moron " + "word " * 20_000), (None, "scum")]
    docs(spark, rows).withColumn("score", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = toxicity.op5_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    hits = {x.doc_id: x for x in got}
    for x in got:
        assert 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7)
        assert x.held_out == (zlib.crc32(str(x.doc_id if x.doc_id is not None else "").encode()) % 3 == 1)
    held = [(hits[i].predicted, int(i % 5 == 0)) for i in range(900) if hits[i].held_out]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert not hits[5000].predicted and not hits[5001].predicted and hits[5002].predicted
    assert hits[5000].score == hits[5001].score
    none = toxicity.train(docs(spark, rows), spark.createDataFrame([], "doc_id long, toxic int"))
    assert {x.score for x in toxicity.score(docs(spark, rows[:3]), none).collect()} == {0.5}


def test_language_id(spark, tmp_path):
    r = random.Random(17)
    make = {"en": ["the", "and", "ing", "tion"], "fr": ["eau", "é", "oi", "ment"], "de": ["sch", "ü", "ung", "ein"]}
    rows = [(i, " ".join("".join(r.choice(make[lang]) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(5, 150))), lang) for i in range(600) for lang in [r.choice(list(make))]]
    rows += [(900, None, "en"), (901, "", "en"), (902, "12 34 !!", "fr"), (903, "the " * 30_000, None), (904, "½ ² ① 123", "en"), (None, "schüung", None), (5, rows[5][1], rows[5][2])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x")).write.parquet(f"{tmp_path}/documents.parquet")
    got = language_id.op6_language_id(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    by = {x.doc_id: x for x in got}
    held = [by[i].lang_pred == lang for i, _, lang in rows[:600] if by[i].held_out]
    assert np.mean(held) > 0.97 and len(held) > 80
    assert [by[k].lang_pred for k in (900, 901, 902, 904)] == ["und"] * 4 and by[903].lang_pred == "en" and by[None].lang_pred == "de"
    assert all(0 <= x.score <= 1 for x in got)
    df = docs(spark, [(1, "abc")])
    assert language_id.identify(df, language_id.train(df.withColumn("lang", F.lit(None).cast("string")))).first().lang_pred == "und"


def test_language_sample_counts_copies_once(spark):
    """A text with very many copies leaves room for the others, and for a rare language."""
    r = random.Random(5)
    some = lambda pool: " ".join(r.choice(pool) + str(k) for k in range(9))
    rows = [("the nation and the station", "en")] * 5000 + [(some(["the", "nation", "and"]), "en") for _ in range(40)] + [(some(["ñoño", "está", "más"]), "es") for _ in range(40)]
    net = language_id.train(spark.createDataFrame(rows, "text string, lang string"))
    assert net.languages == ["en", "es"]
    said = language_id.identify(docs(spark, [(1, "está más ñoño"), (2, "the station nation")]), net).collect()
    assert {x.doc_id: x.lang_pred for x in said} == {1: "es", 2: "en"}


def test_network_against_a_plain_convolution(spark):
    net = language_id.Network(["a", "b", "c"], seed=5)
    text = "Ünd the QUICK fox" * 20
    raw = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
    W, pad, total, n = language_id.WINDOW, language_id._PAD, np.zeros(3), 0
    for at in range(0, len(raw), W):
        x = raw[at : at + W + pad]
        x = x + b"\0" * (W + pad - len(x))
        pooled = [max(sum(float(f[k, x[p + k], j]) for k in range(w)) for p in range(W)) for w, f in net.filters.items() for j in range(language_id.FILTERS)]
        total += np.maximum(np.array(pooled) + net.bias, 0) @ net.dense + net.shift
        n += 1
    z = np.exp(total / n)
    got = language_id.identify(docs(spark, [(1, text)]), net).first()
    assert got.lang_pred == "abc"[z.argmax()] and abs(got.score - (z / z.sum()).max()) < 1e-4
    assert language_id.identify(docs(spark, []), net).count() == 0
