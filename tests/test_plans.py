"""Plan checks: no Python UDF, pushdown reaches the scan, dedup limits map-side."""

import contextlib
import datetime as dt
import io

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from helpers import SF_SMALL, record, write_file
from logscope.operators import search as S
from logscope.operators import upsert, validate
from logscope.plans import registry
from logscope.plans.importer import import_logs
from logscope.plans.store import MessageStore
from logscope.sources import testdata as td


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_no_python_udf(spark, name):
    p = plan(E.queries()[name](spark, SF_SMALL))
    for node in ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "FlatMapGroupsInPandas", "MapInPandas"):
        assert node not in p


def test_dedup_uses_partial_window_group_limit(spark):
    batch = validate.valid_records(validate.parse_lines(td.incoming_lines(spark, SF_SMALL)))
    d = upsert.dedup_last(batch)
    d.write.format("noop").mode("overwrite").save()
    assert "WindowGroupLimit" in plan(d)


def test_store_filters_reach_parquet(spark, workdir):
    logs, store = f"{workdir}/logs", MessageStore(spark, f"{workdir}/table")
    write_file(f"{logs}/p/s.jsonl", [record("a"), record("b")])
    import_logs(spark, store, logs, now=dt.datetime(2025, 7, 22))
    q = S.SearchQuery(keywords=["opening"], project_filter="p", date_from="2025-07-01", limit=10)
    res = S.search(store.messages(), q)
    p = plan(res)
    pushed = next(line for line in p.splitlines() if line.startswith("PushedFilters"))
    assert "EqualTo(project_path,p)" in pushed and "GreaterThanOrEqual(timestamp" in pushed
    read = next(line for line in p.splitlines() if line.startswith("ReadSchema"))
    assert "parent_uuid" not in read and "cwd" not in read
    assert "TakeOrderedAndProject" in p
    assert [r.uuid for r in res.collect()] == ["a", "b"]


def test_partition_pruning_on_bucket(spark, workdir):
    logs, store = f"{workdir}/logs", MessageStore(spark, f"{workdir}/table")
    write_file(f"{logs}/p/s.jsonl", [record("a")])
    import_logs(spark, store, logs, now=dt.datetime(2025, 7, 22))
    bucket = store.read().first()["bkt"]
    df = store.read().where(F.col("bkt") == bucket)
    assert "PartitionFilters: [isnotnull(bkt" in plan(df)
    assert df.count() == 1


def test_index_search_reads_postings_of_its_terms(spark, workdir):
    from logscope.operators import bm25
    bm25.write_index(td.search_view(spark, SF_SMALL), f"{workdir}/idx")
    p = plan(bm25.score(bm25.TextIndex.load(spark, f"{workdir}/idx"), ["the", "und"], "or"))
    pushed = [line for line in p.splitlines() if line.startswith("PushedFilters")]
    assert any("In(term, [the,und])" in line for line in pushed)
    assert "text" not in "".join(line for line in p.splitlines() if line.startswith("ReadSchema"))


def scans(p: str) -> int:
    return sum("Scan parquet" in line and line.startswith("(") for line in p.splitlines())


def test_ranked_search_without_index_reads_the_texts_twice_and_explodes_nothing(spark):
    p = plan(registry.QUERIES["bm25_or"](spark, SF_SMALL))
    assert "Generate" not in p and scans(p) <= 3


def test_upsert_parses_the_batch_once(spark):
    p = plan(registry.QUERIES["import_upsert"](spark, SF_SMALL))
    assert "try_parse_json" not in p and "parse_json" not in p  # parsed before, into the materialised batch
