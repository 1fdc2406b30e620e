"""The pipeline, stage by stage, against brute-force versions of each stage's decision."""

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from logscope.llm import quality
from logscope.llm import queries as Q
from logscope.llm.common import table
from logscope.llm.decontam import normal

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The rows before and after each stage."""
    folder, docs, out = tmp_path_factory.mktemp("steps"), table(spark, SMALL, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SMALL)
        after.write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        out.append((name, docs, after))
        docs = after
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_quality_stage(steps):
    _, before, after = steps[0]
    failed = {r[0] for r in brute.op5(list(texts(before).items())) if r[-1]}
    assert not failed & set(texts(after)) and after.columns == before.columns
    assert texts(after).items() <= texts(before).items()


def test_near_dedup_stage(steps):
    _, before, after = steps[1]
    want = {r[0] for r in brute.op7(list(texts(before).items()), percent=80) if r[-1]}
    assert set(texts(after)) == want and after.columns == before.columns


def test_decontamination_stage(spark, steps):
    _, before, after = steps[2]
    items = [normal(r["text"]) for r in table(spark, SMALL, "benchmark").collect()]
    want = {d for d, t in texts(before).items() if not any(x in normal(t) for x in items)}
    assert set(texts(after)) == want and after.columns == before.columns


def test_pii_stage(steps):
    _, before, after = steps[3]
    found = {r[0] for r in brute.op8(list(texts(before).items())) if sum(r[1:5])}
    changed = {d for d, t in texts(after).items() if t != texts(before)[d]}
    assert found <= changed and set(texts(after)) == set(texts(before)) and after.columns == before.columns
    assert not [r for r in brute.op8(list(texts(after).items())) if sum(r[1:5])]
    assert after.where(F.col("n_chars") != F.length("text")).count() == 0


def test_bpe_stage(steps):
    _, before, after = steps[4]
    assert sorted(map(tuple, after.collect())) == sorted(brute.op10(list(texts(before).items()), Q.vocabulary()))


def test_run_is_the_stages(spark, steps):
    got = corpus_pipeline.run(spark, SMALL)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, steps[-1][2].collect()))


def test_hard_and_empty_tables(spark, sf_dir, workdir):
    docs = table(spark, sf_dir, "documents").drop("n_words", "spans", "chunk", "bucket")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        for some in (docs, docs.limit(0)):
            out = stage(spark, some, sf_dir)
            assert out.count() <= docs.count()
            assert k == 4 or out.schema.names == docs.columns


def test_clashing_columns_stay(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").selectExpr("*", "1 AS _quality", "2 AS _quality_kept", "3 AS _gone", "4 AS packed", "5 AS node", "6 AS key")
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        assert out.select("_quality", "_quality_kept", "_gone", "packed", "node", "key", "bucket").distinct().collect() == [(1, 2, 3, 4, 5, 6, 2)]


def test_thresholds_keep_their_promise():
    for n, rate, level in ((100, 0.05, 0.01), (1000, 0.01, 0.001), (50, 0.01, 0.05)):
        from math import comb
        k = quality.most_false(n, rate, level)
        below = lambda k: sum(comb(n, j) * rate ** j * (1 - rate) ** (n - j) for j in range(k + 1))
        assert below(k) <= level < below(k + 1)


def test_cutoffs(spark):
    """A score that separates is cut; a stratum with few labels is not; good documents stay."""
    rows = [(k, "en", "good words of some length here " * 30 + str(k), 1) for k in range(900)]
    rows += [(1000 + k, "en", "b$d ### words $$$ of s&me length here " * 30 + str(k), 0) for k in range(100)]
    rows += [(2000 + k, "fr", "b$d ### words $$$ of s&me length here " * 30 + str(k), 0) for k in range(5)]
    rows = [(d, lang, " ".join(f"{w}{j}" for j, w in enumerate(t.split())), q) for d, lang, t, q in rows]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(r[0], r[3], 0) for r in rows] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"] for r in quality.keep_good(docs, labels).collect()}
    assert kept == {r[0] for r in rows if r[1] == "fr" or r[3] == 1}
