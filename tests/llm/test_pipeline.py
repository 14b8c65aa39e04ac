"""The corpus pipeline on a small corpus: each stage against brute force on what the one before kept, and odd corpora."""

import collections
import random

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_operators import brute_components, brute_groups, edited

from waymark.llm import quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long, locator string, cls string"
LABELS = "doc_id long, quality long, toxic long"


def corpus(spark, path, rows, labels):
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "x") for i, t in rows], DOCS)
    frame.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rnd = random.Random(13)
    good = [" ".join(rnd.choices(["the", "river", "runs", "past", "old", "towns", "and", "mills", "near", f"place{k}"], k=rnd.randrange(40, 90))) for k in range(60)]
    bad = ["".join(rnd.choices("0123456789abcdef#$%&", k=rnd.randrange(150, 400))) for _ in range(40)]
    texts = good + bad + [edited(rnd, t, 2) for t in good[:15]] + [t.upper() for t in good[:10]] + good[:5] + [None, "", "", "river towns", " ".join(f"{good[3]} {k}" for k in range(120))]
    rows = list(enumerate(texts)) + [(None, good[7]), (3, good[3])]
    labels = [(i, int(i < 60), 0) for i in range(100)]
    return corpus(spark, tmp_path_factory.mktemp("corpus"), rows, labels)


def test_stages_match_brute_force(spark, made):
    docs = spark.read.parquet(f"{made}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        out = stage(spark, docs, made)
        if name == "best-fit packing":
            break
        after = [(r.doc_id, r.text) for r in out.collect()]
        assert out.columns == docs.columns
        assert not collections.Counter(after) - collections.Counter(before)
        if name == "quality classifier":
            model = quality.fit(docs, spark.read.parquet(f"{made}/labels.parquet"))
            want = docs.where(quality.score(model, F.col("text")) >= 0.5)
            assert collections.Counter(after) == collections.Counter((r.doc_id, r.text) for r in want.collect())
            assert sum(i is not None and 60 <= i < 100 for i, _t in after) <= 2
            assert sum(i is not None and i < 60 for i, _t in after) >= 58
        elif name == "exact dedup":
            groups = brute_groups(before)
            assert sorted(str(i) for i, _t in after) == sorted(str(max((x for x in g if x is not None), default=None)) for g in groups.values())
        else:
            groups = collections.defaultdict(set)
            for n, ((i, t), (_k, size, component)) in enumerate(zip(before, brute_components(before, 5, 80), strict=True)):
                groups[(component, n if not size else 0)].add((i, t))
            assert len(after) == len(groups)
            assert all(len(g & set(after)) == 1 for g in groups.values())
        docs = corpus_pipeline.staged(out, "tested")
    check_pieces(before, out.collect())


def check_pieces(docs, pieces):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((str(i), -(-(len(tok.encode(t or "", add_special_tokens=False).ids) + 1) // 2048)) for i, t in docs)
    assert sorted((k, n) for k, n in collections.Counter(str(r.doc_id) for r in pieces).items()) == want
    by = collections.defaultdict(list)
    for r in pieces:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        ends = [sum(n for _o, n in sorted(places)[:k]) for k in range(len(places) + 1)]
        assert [o for o, _n in sorted(places)] == ends[:-1]
        assert ends[-1] <= 2048


def test_run_writes_each_stage(spark, made):
    out = corpus_pipeline.run(spark, made)
    assert out.inputFiles()
    assert out.count() > 40


def test_empty_corpora(spark, tmp_path):
    assert corpus_pipeline.run(spark, corpus(spark, tmp_path / "none", [], [])).count() == 0
    odd = corpus(spark, tmp_path / "odd", [(None, None), (1, None), (1, ""), (2, "word " * 50_000)], [])
    assert {r.doc_id for r in corpus_pipeline.run(spark, odd).collect()} >= {2}
