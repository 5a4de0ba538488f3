"""The pipeline's rows against a plain version of each stage, on a small fixture and on the smallest tables."""

import inspect
import re
import zlib

import corpus_pipeline as P
import numpy as np
import pytest
from conftest import DATA

from docloom.llm import queries, toxicity
from docloom.llm.token_files import encoder

from .test_decontamination import brute as windows
from .test_decontamination import words
from .test_mixing import brute as mixed
from .test_mixing import count
from .test_simhash import grouped, jaccard_groups, plainly


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for k, (_, stage) in enumerate(P.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, DATA).write.parquet(path)
        out.append((docs, docs := spark.read.parquet(path)))
    return out


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_shape(spark, stages):
    assert len(P.STAGES) == 5 and all(len(inspect.signature(f).parameters) == 3 for _, f in P.STAGES)
    for before, after in stages[:-1]:
        assert after.columns == before.columns and after.count() > 0


def test_toxic_go(spark, stages):
    before, after = stages[0]
    model = toxicity.train(before, queries.learnable(spark.read.parquet(f"{DATA}/labels.parquet")))
    all_rows = before.collect()
    scores = model.score([r.text for r in all_rows])
    assert rows(after) == sorted((tuple(r) for r, s in zip(all_rows, scores, strict=True) if s < 0.3), key=str)


def test_one_of_each_group_stays(stages):
    """Groups of the stage's own similarity, 0.8 over five words, by all pairs; copies of one fingerprint are among them."""
    before, after = stages[1]
    all_rows = before.collect()
    roots, best = jaccard_groups([r.text for r in all_rows]), {}
    prints = grouped([plainly(r.text) for r in all_rows])
    assert len(set(roots)) < len(all_rows) and len(set(prints)) < len(all_rows)
    for r, g in zip(all_rows, roots, strict=True):
        best[g] = min(best.get(g, r), r, key=lambda x: x.doc_id)
    assert rows(after) == sorted(map(tuple, best.values()), key=str)


def test_no_passage_is_left(spark, stages):
    before, after = stages[2]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    grams = {tuple(w[k : k + 10]) for w in (words(t) for _, t in items) for k in range(len(w) - 9)}
    hit = lambda t: any(tuple(w[k : k + 10]) in grams for w in [words(t)] for k in range(len(w) - 9))
    assert any(hit(r.text) for r in before.collect())
    kept = {r.doc_id: r.text for r in after.collect()}
    assert not any(map(hit, kept.values()))
    for r in before.collect():
        if not hit(r.text):
            assert kept[r.doc_id] == r.text
        elif r.doc_id in kept:
            found = windows([(r.doc_id, r.text)], items, 10)[0]
            assert len(words(kept[r.doc_id])) == found[1] - found[2]


def test_mix(stages):
    before, after = stages[3]
    want = {x[0]: x[4] for x in mixed([(r.doc_id, r.text, r.source) for r in before.collect()])}
    got = dict.fromkeys(want, 0)
    for r in after.collect():
        got[r.doc_id] += count(r.text)
    assert got == want


def test_tokens(stages):
    before, after = stages[4]
    direct = encoder(queries.tokenizer_path()).direct
    want = sorted((r.doc_id, len(x), zlib.crc32(x.tobytes())) for r in before.collect() for x in [np.append(direct([r.text or ""])[0], 2).astype("<u4")])
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in after.collect()) == want
    at = 0
    for r in after.orderBy("start").collect():
        assert r.start == at
        at += r.n_tokens


def test_run_is_the_stages(spark, stages):
    assert rows(P.run(spark, DATA)) == rows(stages[-1][1])


def test_odd_rows(spark, tmp_path):
    """Nulls, empty texts and equal rows in documents, and no labels or items at all."""
    docs = [(1, None, "en", None, None), (2, "", None, "s", 0), (3, "a b c d", "en", "s", 7), (3, "a b c d", "en", "s", 7), (4, "A B C D", "en", "t", 7), (None, "q w e r t y", "en", "t", 11)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    model = toxicity.train(spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "labels.parquet")))
    assert model.score([None])[0] == 0.5  # nothing tells documents apart, so the stage keeps them all
    assert P.without_toxic(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)).count() == 6
    assert P.run(spark, str(tmp_path)).count() >= 1
    kept = P.without_copies(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "None"]
    assert P.without_benchmarks(spark, kept, str(tmp_path)).count() == 3
    assert P.tokens(spark, P.mixed(spark, kept, str(tmp_path)), str(tmp_path)).count() >= 1


def test_words_agree():
    assert words("Ab-c é1") == re.findall(r"\w+", "ab-c é1")
