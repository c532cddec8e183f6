"""The pipeline's stages on a small corpus, each against what it should have kept."""

import random
from collections import Counter

import pytest

import corpus_pipeline as cp
from dotgrain.llm import bpe

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
MAKE = {"en": ["the", "and", "ing", "tion"], "fr": ["eau", "é", "oi", "ment"]}
LINE = "this footer line is repeated in very many of the documents here"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(31)
    rows = []
    for i in range(240):
        lang = r.choice(list(MAKE))
        w = " ".join("".join(r.choice(MAKE[lang]) for _ in range(r.randrange(1, 6))) for _ in range(r.randrange(40, 120)))
        rows.append((i, w + ("\n" + LINE if i % 4 == 0 else ""), lang, f"src{i % 3 if i % 2 else 0}"))
    rows += [(300 + k, rows[k][1], rows[k][2], "src1") for k in range(0, 20, 2)]
    rows += [(400, "123 456", "en", "src0"), (401, None, "en", "src0"), (402, "", None, None)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], COLUMNS).write.parquet(f"{path}/documents.parquet")
    return path, rows


def test_stages(spark, corpus, tmp_path):
    path, rows = corpus
    docs, seen = spark.read.parquet(f"{path}/documents.parquet"), {}
    for name, step in cp.STAGES:
        out = step(spark, docs, path)
        if name != "bpe":
            assert tuple(out.columns) == cp.COLUMNS
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
    said = {x.doc_id: x for x in seen["language_id"]}
    assert not {400, 401, 402} & set(said) and len(said) >= 0.99 * (len(rows) - 3)
    lines = {x.doc_id: x for x in seen["line_dedup"]}
    assert set(lines) == set(said)
    holders = [i for i, x in said.items() if LINE in x.text]
    for i, x in lines.items():
        assert x.n_chars == len(x.text)
        assert x.text == (said[i].text if i not in holders or i == max(holders) else said[i].text.replace("\n" + LINE, ""))
    kept = {x.doc_id for x in seen["jaccard_join"]}
    assert kept == {i for i in lines if i < 300}
    mixed = Counter(x.doc_id for x in seen["mixing"])
    assert set(mixed) <= kept and max(mixed.values()) <= 2
    sizes = {x.doc_id: len(x.text.split()) for x in seen["jaccard_join"]}
    got, want = sum(sizes[i] * n for i, n in mixed.items()), 1.5 * sum(sizes.values())
    assert abs(got - want) <= 3 * max(sizes.values())
    coder = bpe.Encoder(*bpe.default_vocabulary())
    texts = {x.doc_id: x.text for x in seen["mixing"]}
    assert len(seen["bpe"]) == len(seen["mixing"])
    for x in seen["bpe"]:
        assert x.decodes and x.n_tokens == len(x.ids) and x.ids == coder([texts[x.doc_id]])[0].tolist()


def test_run_and_empty(spark, corpus, tmp_path):
    assert cp.run(spark, corpus[0]).count() > 100
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
    assert cp.ORACLE_SQL is None and [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "jaccard_join", "mixing", "bpe"]
