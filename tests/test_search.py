import datetime as dt

from pyspark.sql import functions as F

from helpers import SF_SMALL
from logscope.operators import bm25
from logscope.operators import search as S
from logscope.schema import RESULT_SCHEMA
from logscope.sources import testdata as td


def rows(spark, data):
    base = dt.datetime(2024, 1, 1)
    return spark.createDataFrame(
        [(i, f"u{i}", "s", c, "user", p, base + dt.timedelta(days=d), 0.0, fav) for i, c, p, d, fav in data], RESULT_SCHEMA)


def test_rank_fixture(spark):
    df = rows(spark, [(1, "a", "p", 0, False), (2, "a", "p", 0, False), (3, "a", "p", 0, False)])
    df = df.withColumn("rank", F.when(F.col("id") == 1, 0.5).when(F.col("id") == 2, 0.9).otherwise(0.7))
    assert [r.id for r in S.rank_desc(df).collect()] == [2, 3, 1]


def test_project_filters(spark):
    df = rows(spark, [(1, "x", "/a", 0, False), (2, "x", "/b", 0, False), (3, "x", "/c", 0, False)])
    def ids(**kw):
        return sorted(r.id for r in S.search(df, S.SearchQuery(keywords=["x"], limit=None, **kw)).collect())
    assert ids(project_filter="/a") == [1]
    assert ids(project_filters=["/a", "/c"]) == [1, 3]
    assert ids(project_filters=["/zzz"]) == []
    assert ids(project_filters=[]) == [1, 2, 3]
    assert ids(project_filters=[""]) == []
    assert ids(project_filters=["/b"], project_filter="/a") == [2]
    assert ids(project_filters=[], project_filter="/a") == [1, 2, 3]


def test_keywords_dates_favorites(spark):
    df = rows(spark, [(1, "Rust error", "/a", 0, True), (2, "rust", "/a", 5, False), (3, None, "/a", 1, True)])
    def ids(**kw):
        return sorted(r.id for r in S.search(df, S.SearchQuery(limit=None, **kw)).collect())
    assert ids(keywords=["RUST", "error"]) == [1]
    assert ids(keywords=["error", "zzz"], mode="or") == [1]
    assert ids(keywords=[]) == []
    assert ids(keywords=[""]) == [1, 2]
    assert ids(keywords=["rust"], favorites_only=True) == [1]
    assert ids(keywords=["rust"], favorites_only=False) == [1, 2]
    assert ids(keywords=["rust"], date_from="2024-01-03") == [2]
    assert ids(keywords=["rust"], date_to="2024-01-01") == [1]
    assert ids(keywords=["rust"], date_from="2024-01-05", date_to="2024-01-02") == []
    assert ids(keywords=["rust"], regex="^R") == [1]
    assert [r.id for r in S.list_favorites(df).collect()] == [3, 1]


def test_bm25_topk_plan_and_order(spark):
    m = td.search_view(spark, SF_SMALL)
    idx = bm25.build_index(m)
    res = S.ranked_search(m, idx, S.SearchQuery(keywords=["the", "and"], mode="or", limit=5))
    got = res.collect()
    assert len(got) == 5
    assert [r.rank for r in got] == sorted((r.rank for r in got), reverse=True)
    plan = res._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_topk_when_the_index_is_ahead_of_the_table(spark):
    m = td.search_view(spark, SF_SMALL)
    best = {r.id for r in S.ranked_search(m, None, S.SearchQuery(keywords=["the"], limit=10)).collect()}
    table = m.where(~F.col("id").isin(*best))
    for limit in (5, 10, 1000):
        got = S.ranked_search(table, bm25.build_index(m), S.SearchQuery(keywords=["the"], limit=limit)).collect()
        assert len(got) == min(limit, S.ranked_search(table, bm25.build_index(m), S.SearchQuery(keywords=["the"], limit=None)).count())


def test_scan_and_index_agree(spark, workdir):
    m = td.search_view(spark, SF_SMALL)
    bm25.write_index(m, f"{workdir}/idx")
    for terms in (["the", "und"], ["The"], ["ein", "zzz"], ["???"]):
        for mode in ("or", "and"):
            a, b, c = (sorted((r.id, round(r.score, 9), r.n_terms) for r in rows.collect()) for rows in (
                bm25.score(bm25.build_index(m), terms, mode), bm25.score(bm25.TextIndex.load(spark, f"{workdir}/idx"), terms, mode),
                bm25.score_scan(m, terms, mode)))
            assert a == b == c


def test_regex_with_filters_and_limit(spark):
    df = rows(spark, [(1, "abc", "/a", 0, True), (2, "abd", "/b", 5, False), (3, None, "/a", 1, True), (4, "abe", "/a", 2, False)])
    ids = lambda **kw: [r.id for r in S.regex_search(df, "^ab", S.SearchQuery(**kw)).collect()]
    assert sorted(ids(limit=None)) == [1, 2, 4] and sorted(ids(project_filter="/a")) == [1, 4]
    assert ids(favorites_only=True) == [1] and len(ids(limit=2)) == 2 and ids(date_from="2024-01-05") == [2]


def test_project_list_as_a_table(spark):
    df = rows(spark, [(1, "x", "/a", 0, False), (2, "x", "/b", 0, False)])
    wanted = spark.createDataFrame([("/b",), ("/c",)], "project_path string")
    assert [r.id for r in S.search(df, S.SearchQuery(keywords=["x"], project_filters=wanted)).collect()] == [2]


def test_numbers_do_not_depend_on_partitions(spark):
    """200,000 rows with long texts: dense, distinct and in order, however the plan is cut."""
    from logscope.operators import upsert
    n = 200_000
    df = upsert.materialised(spark.range(n).select(
        F.concat(F.lit("f"), F.lpad((F.col("id") % 37).cast("string"), 3, "0")).alias("file_path"), (F.col("id") % 5 * 4096).alias("block_start"),
        F.col("id").alias("pos"), F.sha2(F.col("id").cast("string"), 512).alias("text")))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions in ("8", "200"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            got = upsert.materialised(upsert.number_batch(df))
            assert tuple(got.agg(F.count("*"), F.count_distinct("id"), F.min("id"), F.max("id")).first()) == (n, n, 1, n)
            by = got.groupBy("file_path", "block_start").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("n")).orderBy("file_path", "block_start").collect()
            assert all(r.b - r.a + 1 == r.n for r in by) and [r.a for r in by] == sorted(r.a for r in by)
            assert got.where("file_path = 'f003' AND block_start = 0").orderBy("pos").select("id").collect() == got.where("file_path = 'f003' AND block_start = 0").orderBy("id").select("id").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_statements_run_in_order_and_stop_at_an_error(spark):
    import pytest

    from logscope.operators.reports import run_in_order
    with pytest.raises(Exception):
        run_in_order(spark, ["CREATE OR REPLACE TEMP VIEW in_order AS SELECT 1 AS x", "SELECT nothing FROM nowhere",
                             "CREATE OR REPLACE TEMP VIEW in_order AS SELECT 2 AS x"])
    assert run_in_order(spark, ["SELECT x FROM in_order"])[0].first()["x"] == 1


def test_topk_reads_few_blocks(spark, workdir, monkeypatch):
    """The best rows lie in a few blocks: the others are not read, and the result is that of a full scan, with filters and ties."""
    import random
    monkeypatch.setattr(bm25, "BLOCK_IDS", 8)
    monkeypatch.setattr(bm25, "FIRST_BLOCKS", 8)
    rnd = random.Random(5)
    data = [(i, " ".join(["rust"] * (9 if i % 97 == 5 else 1) + ["go"] * rnd.randint(0, 2) + ["pad"] * rnd.randint(5, 20)), f"/p{i % 3}", i % 9, False) for i in range(600)]
    df = rows(spark, data).drop("rank")
    bm25.write_index(df, f"{workdir}/idx")
    idx = bm25.TextIndex.load(spark, f"{workdir}/idx")
    for q in (S.SearchQuery(keywords=["rust"], limit=4), S.SearchQuery(keywords=["rust", "go"], limit=5),
              S.SearchQuery(keywords=["rust"], limit=2, project_filter="/p1")):
        stats = {}
        got = S.ranked_search(df, idx, q, stats=stats).collect()
        assert [(r.id, r.rank) for r in got] == [(r.id, r.rank) for r in S.ranked_search(df, None, q).collect()]
        if q.limit < 5 and q.keywords == ["rust"]:
            assert 0 < stats["read"] < stats["blocks"] / 2
