import datetime as dt
import glob
import os

from pyspark.sql import functions as F

from helpers import record, write_file
from logscope.plans.importer import import_logs, sync
from logscope.plans.store import MessageStore

T0 = dt.datetime(2025, 7, 21, 13, 0, 0)
T1 = dt.datetime(2025, 7, 22, 9, 0, 0)


def rows(store):
    return {r.uuid: r for r in store.messages().collect()}


def test_same_uuid_new_content_keeps_id_and_favorite(spark, workdir):
    logs, store = f"{workdir}/logs", MessageStore(spark, f"{workdir}/table")
    write_file(f"{logs}/p/s.jsonl", [record("u1", content="old")])
    out = import_logs(spark, store, logs, now=T0)
    assert (out.stats.inserted, out.stats.updated, out.stats.errors) == (1, 0, 0)
    first = rows(store)["u1"]
    store.mark_favorite([first.id])
    write_file(f"{logs}/p/s.jsonl", [record("u1", content="new", ts="2025-07-21T13:48:30Z")])
    out = import_logs(spark, store, logs, now=T1)
    assert (out.stats.inserted, out.stats.updated) == (0, 1)
    r = rows(store)
    assert len(r) == 1
    got = r["u1"]
    assert got.message_content == '"new"' and got.id == first.id and got.is_favorite
    assert got.created_at == T0 and got.updated_at == T1


def test_thousand_messages(spark, workdir):
    logs, store = f"{workdir}/logs", MessageStore(spark, f"{workdir}/table")
    base = dt.datetime(2025, 1, 1)
    lines = [record(f"test-uuid-{i}", ts=(base + dt.timedelta(seconds=i)).strftime("%Y-%m-%dT%H:%M:%SZ")) for i in range(1000)]
    write_file(f"{logs}/p/s.jsonl", lines)
    out = import_logs(spark, store, logs, now=T0)
    assert (out.stats.inserted, out.stats.updated, out.stats.errors) == (1000, 0, 0)
    ids = sorted(r.id for r in store.messages().select("id").collect())
    assert ids == list(range(1, 1001))


def test_duplicates_in_one_batch_last_wins(spark, workdir):
    logs, store = f"{workdir}/logs", MessageStore(spark, f"{workdir}/table")
    write_file(f"{logs}/p/s.jsonl", [record("u", content="a"), record("u", content="b"), record("u", content="c")])
    out = import_logs(spark, store, logs, now=T0)
    assert (out.stats.inserted, out.stats.updated) == (1, 2)
    assert rows(store)["u"].message_content == '"c"'


def test_reimport_changes_only_updated_at(spark, workdir):
    logs, store = f"{workdir}/logs", MessageStore(spark, f"{workdir}/table")
    write_file(f"{logs}/p/s.jsonl", [record("a"), record("b", "a")])
    import_logs(spark, store, logs, now=T0)
    before = {k: v.asDict() for k, v in rows(store).items()}
    import_logs(spark, store, logs, now=T1)
    after = {k: v.asDict() for k, v in rows(store).items()}
    for k in before:
        assert after[k].pop("updated_at") == T1
        before[k].pop("updated_at")
        assert before[k] == after[k]


def files(root):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{root}/messages/bkt=*/*.parquet")}


def test_small_changes_leave_other_buckets_alone(spark, workdir):
    logs, store = f"{workdir}/logs", MessageStore(spark, f"{workdir}/table", buckets=8)
    write_file(f"{logs}/p/s.jsonl", [record(f"u{i}") for i in range(100)])
    import_logs(spark, store, logs, now=T0)
    before = files(f"{workdir}/table")
    assert len({os.path.dirname(f) for f in before}) == 8
    store.mark_favorite([5])
    assert files(f"{workdir}/table") == before
    write_file(f"{logs}/p/edit.jsonl", [record("u7", content="edited")])
    import_logs(spark, store, logs, now=T1)
    after = files(f"{workdir}/table")
    changed = {os.path.basename(os.path.dirname(f)) for f in set(before) ^ set(after)}
    bucket = store.read().where("uuid = 'u7'").first()["bkt"]
    assert changed <= {f"bkt={b}" for b in {r["bkt"] for r in store.read().select("bkt", "updated_at").where(F.col("updated_at") == T1).collect()}}
    assert f"bkt={bucket}" in changed
    assert store.messages().where("is_favorite").count() == 1 and store.messages().count() == 100


def test_bulk_import_stores_every_row(spark, workdir):
    """Long random texts, several partitions, plan changes at run time allowed: nothing is lost, ids are dense."""
    import random
    rnd = random.Random(7)
    for mode in ("upsert", "insert_only", "overwrite", "force"):
        logs, store = f"{workdir}/logs", MessageStore(spark, f"{workdir}/{mode}")
        if mode == "upsert":
            for k in range(6):
                write_file(f"{logs}/p{k % 2}/s{k}.jsonl", [
                    record(f"id-{k}-{i}", content="".join(rnd.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=300))) for i in range(10_000)])
        out = import_logs(spark, store, logs, mode=mode, now=T0)
        got = store.messages().agg(F.count("*"), F.count_distinct("id"), F.min("id"), F.max("id"), F.count_distinct("uuid")).first()
        assert tuple(got) == (60_000, 60_000, 1, 60_000, 60_000) and out.stats.inserted == 60_000


def test_store_refuses_rows_that_differ_from_the_plan(spark, workdir, monkeypatch):
    import pytest

    from logscope.operators import upsert
    from logscope.plans.store import WriteMismatch
    logs, store = f"{workdir}/logs", MessageStore(spark, f"{workdir}/table")
    write_file(f"{logs}/p/s.jsonl", [record(f"u{i}") for i in range(10)])
    real = upsert.number_batch
    monkeypatch.setattr(upsert, "number_batch", lambda batch, base=0: real(batch, base).where("id <> 3"))
    for mode in ("upsert", "insert_only", "overwrite", "force"):
        with pytest.raises(WriteMismatch):
            import_logs(spark, store, logs, mode=mode, now=T0)
    assert store.messages().count() == 0


def test_force_reports_duplicates(spark, workdir):
    logs, store = f"{workdir}/logs", MessageStore(spark, f"{workdir}/table")
    write_file(f"{logs}/p/s.jsonl", [record("a")])
    import_logs(spark, store, logs, now=T0)
    write_file(f"{logs}/p/s.jsonl", [record("a"), record("b"), record("b")])
    out = import_logs(spark, store, logs, mode="force", now=T1)
    assert (out.stats.inserted, out.stats.errors) == (1, 2)
    assert set(rows(store)) == {"a", "b"}
    bad = sorted(out.quarantine.collect(), key=lambda r: r.line_no)
    assert [(r.line_no, r.error) for r in bad] == [(1, "duplicate uuid"), (3, "duplicate uuid")]
    assert all('"uuid": "' in r.raw for r in bad)
    assert store.quarantine().count() == 2


def test_overwrite_replaces_everything(spark, workdir):
    logs, store = f"{workdir}/logs", MessageStore(spark, f"{workdir}/table")
    write_file(f"{logs}/p/s.jsonl", [record("a"), record("b")])
    import_logs(spark, store, logs, now=T0)
    write_file(f"{logs}/p/s.jsonl", [record("c")])
    import_logs(spark, store, logs, mode="overwrite", now=T1)
    r = rows(store)
    assert set(r) == {"c"} and r["c"].id == 1


def test_sync_adds_only_new_and_is_idempotent(spark, workdir):
    logs, store = f"{workdir}/logs", MessageStore(spark, f"{workdir}/table")
    write_file(f"{logs}/p/s.jsonl", [record("a")])
    sync(spark, store, logs, now=dt.datetime(2020, 1, 1))
    write_file(f"{logs}/p/s.jsonl", [record("a", content="changed"), record("b")])
    sync(spark, store, logs, now=dt.datetime(2020, 1, 2))
    r = rows(store)
    assert set(r) == {"a", "b"} and r["a"].message_content == '"An opening line"'
    n = store.messages().count()
    sync(spark, store, logs, now=dt.datetime(2020, 1, 3))
    assert store.messages().count() == n


def test_sync_after_importing_one_project(spark, workdir):
    logs, store = f"{workdir}/logs", MessageStore(spark, f"{workdir}/table")
    write_file(f"{logs}/p/s.jsonl", [record("a")])
    write_file(f"{logs}/q/s.jsonl", [record("b")])
    os.utime(f"{logs}/q/s.jsonl", (1_000_000_000, 1_000_000_000))  # an old modification time
    import_logs(spark, store, logs, project="p", now=T0)
    assert set(rows(store)) == {"a"}
    assert sync(spark, store, logs, now=T1).stats.inserted == 1
    assert set(rows(store)) == {"a", "b"}
    write_file(f"{logs}/r/s.jsonl", [record("c")])
    os.utime(f"{logs}/r/s.jsonl", (1_000_000_000, 1_000_000_000))
    sync(spark, store, logs, now=T1)
    assert set(rows(store)) == {"a", "b", "c"} and sync(spark, store, logs, now=T1).stats.total_processed == 0


def test_import_in_another_time_zone(spark, workdir):
    logs = f"{workdir}/logs"
    write_file(f"{logs}/p/s.jsonl", [record("a", ts="2025-11-02T05:30:00.283Z"), record("b", ts="2025-11-02T06:30:00Z")])
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        store = MessageStore(spark, f"{workdir}/table")
        import_logs(spark, store, logs, now=T0)
        got = {u: r.timestamp for u, r in rows(store).items()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == {"a": dt.datetime(2025, 11, 2, 5, 30, 0, 283000), "b": dt.datetime(2025, 11, 2, 6, 30)}


def test_quarantine_written_with_line_numbers(spark, workdir):
    logs, store = f"{workdir}/logs", MessageStore(spark, f"{workdir}/table")
    write_file(f"{logs}/p/s.jsonl", [record("a"), "{oops", "", record("b")])
    out = import_logs(spark, store, logs, now=T0)
    assert out.stats.errors == 1
    q = store.quarantine().collect()
    assert [(os.path.basename(x.file_path), x.line_no, x.error) for x in q] == [("s.jsonl", 2, "invalid JSON")]
    import_logs(spark, store, logs, now=T1)
    assert store.quarantine().count() == 1  # a repeated import adds nothing
    rep = {(r.project_path, r.level): (r.imported, r.errors) for r in out.report.collect()}
    assert rep[("p", 1)] == (2, 1) and rep[(None, 3)] == (2, 1)


def test_favorites_mark_unmark_and_unknown_ids(spark, workdir):
    logs, store = f"{workdir}/logs", MessageStore(spark, f"{workdir}/table")
    write_file(f"{logs}/p/s.jsonl", [record("a"), record("b")])
    import_logs(spark, store, logs, now=T0)
    ids = {u: r.id for u, r in rows(store).items()}
    store.mark_favorite([ids["a"], 999])
    assert {u: r.is_favorite for u, r in rows(store).items()} == {"a": True, "b": False}
    store.mark_favorite([ids["a"]], False)
    assert not any(r.is_favorite for r in rows(store).values())


def test_catalog_table_roundtrip(spark, workdir):
    logs, store = f"{workdir}/logs", MessageStore(spark, f"{workdir}/table")
    write_file(f"{logs}/p/s.jsonl", [record("a")])
    import_logs(spark, store, logs, now=T0)
    store.create_table("msgs_test")
    store.create_table("msgs_test")
    assert spark.table("msgs_test").where(F.col("uuid") == "a").count() == 1
    store.drop_table("msgs_test")
    store.drop_table("msgs_test")


def same_as_rebuild(spark, store, path, again):
    from logscope.operators import bm25
    store.build_index(again)
    got, want = bm25.TextIndex.load(spark, path), bm25.TextIndex.load(spark, again)
    for terms in (["rust"], ["python", "go"], ["error", "rust"]):
        a, b = (sorted((r.id, round(r.score, 9)) for r in bm25.score(i, terms, "or").collect()) for i in (got, want))
        assert a == b
    assert got.corpus().first() == want.corpus().first()
    assert sorted(bm25.term_stats(got).collect()) == sorted(bm25.term_stats(want).collect())
    return got


def test_persisted_index_refresh(spark, workdir):
    from logscope.operators import bm25
    logs, store = f"{workdir}/logs", MessageStore(spark, f"{workdir}/table")
    write_file(f"{logs}/p/s.jsonl", [record("a", content="rust error"), record("b", content="python")])
    import_logs(spark, store, logs, now=T1)
    store.build_index(f"{workdir}/idx")
    write_file(f"{logs}/p/s.jsonl", [record("b", content="rust rust"), record("c", content="go")])
    import_logs(spark, store, logs, now=T0)  # an older time than the first load's
    store.refresh_index(f"{workdir}/idx")
    idx = same_as_rebuild(spark, store, f"{workdir}/idx", f"{workdir}/idx2")
    ids = {r.uuid: r.id for r in store.messages().collect()}
    assert {r.id for r in bm25.score(idx, ["rust"], "or").collect()} == {ids["a"], ids["b"]}
    write_file(f"{logs}/p/s.jsonl", [record("z", content="go rust")])
    import_logs(spark, store, logs, mode="overwrite", now=T1)
    store.refresh_index(f"{workdir}/idx")
    idx = same_as_rebuild(spark, store, f"{workdir}/idx", f"{workdir}/idx3")
    assert idx.corpus().first().n_docs == 1


def test_fail_fast_import_writes_nothing(spark, workdir):
    import pytest
    logs, store = f"{workdir}/logs", MessageStore(spark, f"{workdir}/table")
    write_file(f"{logs}/p/s.jsonl", [record("a"), "{broken", record("b")])
    with pytest.raises(Exception):
        import_logs(spark, store, logs, skip_errors=False, now=T0)
    assert store.messages().count() == 0


def test_failed_overwrite_leaves_rows_and_flags(spark, workdir, monkeypatch):
    """Until the log's row is written the old rows and favourites stand; after it, neither counts; vacuum removes the files."""
    import pytest
    logs, store = f"{workdir}/logs", MessageStore(spark, f"{workdir}/table")
    write_file(f"{logs}/p/s.jsonl", [record("a"), record("b")])
    import_logs(spark, store, logs, now=T0)
    store.mark_favorite([1])
    real = store._reserve
    monkeypatch.setattr(store, "_reserve", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
    write_file(f"{logs}/p/s.jsonl", [record("a", content="new")])
    with pytest.raises(OSError):
        import_logs(spark, store, logs, mode="overwrite", now=T1)
    assert {u: (r.is_favorite, r.message_content) for u, r in rows(store).items()} == {"a": (True, '"An opening line"'), "b": (False, '"An opening line"')}
    monkeypatch.setattr(store, "_reserve", real)
    import_logs(spark, store, logs, mode="overwrite", now=T1)
    assert {u: (r.is_favorite, r.message_content) for u, r in rows(store).items()} == {"a": (False, '"new"')}
    assert store.loaded_files().count() == 1
    assert len(store.vacuum()) == 2 and set(rows(store)) == {"a"} and store.vacuum() == []


def test_numbers_need_no_single_task(spark):
    """Ids of many files by a two-level prefix sum: equal to a global row number, and no window without a partition key."""
    from pyspark.sql import Window

    from logscope.operators import upsert
    n = 200_000
    rows_ = spark.range(n).select(F.concat(F.lit("/f"), F.lpad(F.pmod(F.xxhash64("id"), F.lit(50_000)).cast("string"), 6, "0")).alias("file_path"),
                                  F.lit(0).alias("block_start"), F.col("id").alias("pos"))
    batch = upsert.materialised(rows_)
    got = upsert.number_batch(batch, base=7)
    want = batch.withColumn("w", F.row_number().over(Window.orderBy("file_path", "block_start", "pos")) + 7)
    assert got.join(want, ["file_path", "pos"]).where("id = w").count() == n
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if " Window [" in line or line.startswith("Window [")]
    assert windows and all("], [" in line and not line.rstrip().endswith("], []") for line in windows)
    assert all(line.split("], [")[1].strip("] ") for line in windows)


def text_index(spark, store, path):
    from logscope.operators import bm25
    return bm25.TextIndex.load(spark, path), bm25.newest(spark, path)


def test_index_segments_stay_few(spark, workdir, monkeypatch):
    """After many refreshes the segments are few, dead postings are dropped by merges, and results equal a rebuild."""
    from logscope.operators import bm25
    monkeypatch.setattr(bm25, "BLOCK_IDS", 4)
    monkeypatch.setattr(bm25.merge, "__defaults__", (2,))
    docs = {k: f"rust error {k}" for k in range(20)}
    frame = lambda d: spark.createDataFrame([(k, str(hash(t)), t) for k, t in d.items()], "id long, version string, message_content string")
    path = f"{workdir}/idx"
    bm25.write_index(frame(docs), path)
    for step in range(5):
        changed = {step: f"python go {step}", 100 + step: "error error rust"}
        gone = [19 - step]
        docs = {k: t for k, t in (docs | changed).items() if k not in gone}
        touched = spark.createDataFrame([(k,) for k in [*changed, *gone]], "id long")
        bm25.apply_changes(spark, path, frame(changed), touched, feed=step)
    c = bm25.newest(spark, path)
    assert len(c["segs"]) <= 4 and c["feed"] == 4 and c["n_docs"] == len(docs)
    got, want = bm25.TextIndex.load(spark, path), bm25.build_index(frame(docs))
    for terms, mode in ((["rust"], "or"), (["error", "go"], "or"), (["error", "rust"], "and")):
        a, b = (sorted((r.id, round(r.score, 9)) for r in bm25.score(i, terms, mode).collect()) for i in (got, want))
        assert a == b
    assert sorted(bm25.term_stats(got).collect()) == sorted(bm25.term_stats(want).collect())
    assert sorted(bm25.document_frequencies(got, ["rust", "go", "none"]).collect()) == sorted(
        bm25.term_stats(want).where("term in ('rust', 'go')").select("term", "df").collect())
    assert got.dead.count() < 10


def test_refresh_reads_changed_buckets_only(spark, workdir):
    """After one edit the refresh opens the files of one bucket; the per-project numbers open none."""
    logs, store = f"{workdir}/logs", MessageStore(spark, f"{workdir}/table", buckets=16)
    write_file(f"{logs}/p/s.jsonl", [record(f"u{k}", content=f"word{k} rust") for k in range(80)])
    write_file(f"{logs}/q/s.jsonl", [record(f"v{k}", content="go", ts="2031-04-01T00:00:00Z") for k in range(20)])
    import_logs(spark, store, logs, now=T0)
    store.build_index(f"{workdir}/idx")
    write_file(f"{logs}/p/s.jsonl", [record("u7", content="edited rust", ts="2032-01-01T00:00:00Z")])
    write_file(f"{logs}/q/s.jsonl", [])
    import_logs(spark, store, logs, now=T1)
    seen, real = [], store._documents
    store._documents = lambda rows: (seen.append(sorted({r[0] for r in rows.select(F.input_file_name()).collect()})), real(rows))[1]
    store.refresh_index(f"{workdir}/idx")
    assert len(seen) == 1 and len(seen[0]) == 1  # the rows of the change feed lie in one file
    store._documents = real
    same_as_rebuild(spark, store, f"{workdir}/idx", f"{workdir}/idx2")
    store.refresh_index(f"{workdir}/idx")  # nothing changed: no new version
    want = {r.project_path: (r.n, r.last) for r in store.read().groupBy("project_path").agg(F.count("*").alias("n"), F.max("timestamp").alias("last")).collect()}
    summary = store.project_summary()
    assert {r.project_path: (r.n, r.last_update) for r in summary.collect()} == want and want["p"] == (80, dt.datetime(2032, 1, 1))
    assert "messages" not in str(summary.inputFiles())


def test_summary_counts_open_jobs_again(spark, workdir, monkeypatch):
    """A job that fails after it announced its rows does not spoil the numbers, nor does its repetition."""
    import pytest
    logs, store = f"{workdir}/logs", MessageStore(spark, f"{workdir}/table", buckets=4)
    write_file(f"{logs}/p/s.jsonl", [record(f"u{k}") for k in range(10)])
    real = store._write
    monkeypatch.setattr(store, "_write", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        import_logs(spark, store, logs, mode="insert_only", now=T0)
    assert store.project_summary().collect() == []
    monkeypatch.setattr(store, "_write", real)
    import_logs(spark, store, logs, mode="insert_only", now=T0)
    write_file(f"{logs}/p/more.jsonl", [record(f"w{k}") for k in range(5)])
    import_logs(spark, store, logs, mode="overwrite", now=T1)
    assert [(r.project_path, r.n) for r in store.project_summary().collect()] == [("p", 15)]


def test_small_batch_skips_buckets_and_row_groups(spark, workdir):
    """A batch of few uuids reads its buckets alone, and of these the row groups whose Bloom filter may hold one."""
    logs, store = f"{workdir}/logs", MessageStore(spark, f"{workdir}/table", buckets=4)
    write_file(f"{logs}/p/s.jsonl", [record(f"u{k}") for k in range(400)])
    import_logs(spark, store, logs, now=T0)
    batch = store._bucketed(spark.createDataFrame([("u7",), ("nowhere",)], "uuid string"), 4)
    found = store.stored_uuids(batch)
    assert [r.uuid for r in found.collect()] == ["u7"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "In(uuid, [" in plan
    import pyarrow.parquet as pq
    one = glob.glob(f"{workdir}/table/messages/bkt=*/*.parquet")[0]
    with open(one, "rb") as f:
        data = f.read()
    uuids = pq.read_table(one, columns=["uuid"])["uuid"].to_pylist()
    column = pq.read_metadata(one).row_group(0).column(1)
    assert column.path_in_schema == "uuid" and uuids and len(data) > 0
