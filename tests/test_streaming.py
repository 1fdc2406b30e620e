import os

from helpers import record, write_file
from logscope.plans.importer import import_logs
from logscope.plans.store import MessageStore
from logscope.streaming.sync_stream import start_sync_stream


def test_stream_sync_adds_new_files_once(spark, workdir):
    logs, store = f"{workdir}/logs", MessageStore(spark, f"{workdir}/table")
    ckpt = f"{workdir}/stream-ckpt"
    write_file(f"{logs}/p/a.jsonl", [record("a"), "{bad", record("b")])
    q = start_sync_stream(spark, store, logs, checkpoint_location=ckpt)
    q.awaitTermination(300)
    assert sorted(r.uuid for r in store.messages().collect()) == ["a", "b"]
    write_file(f"{logs}/p/c.jsonl", [record("c"), record("a")])
    q = start_sync_stream(spark, store, logs, checkpoint_location=ckpt)
    q.awaitTermination(300)
    got = sorted(r.uuid for r in store.messages().collect())
    assert got == ["a", "b", "c"]
    assert [(os.path.basename(r.file_path), r.line_no) for r in store.quarantine().collect()] == [("a.jsonl", 2)]
    q = start_sync_stream(spark, MessageStore(spark, f"{workdir}/table"), logs, checkpoint_location=f"{workdir}/other-ckpt")
    q.awaitTermination(300)  # a second stream that reads everything again adds nothing
    assert store.messages().count() == 3 and store.quarantine().count() == 1


def run(spark, store, logs, ckpt, **options):
    start_sync_stream(spark, store, logs, checkpoint_location=ckpt, **options).awaitTermination(300)


def append(path, text):
    with open(path, "a", encoding="utf-8", newline="") as f:
        f.write(text)


def uuids(store):
    return sorted(r.uuid for r in store.messages().collect())


def test_stream_sync_takes_appended_lines_once(spark, workdir):
    """Appends, a line half written, new files, a rewritten file and a batch import between: every line arrives once."""
    logs, store, ckpt = f"{workdir}/logs", MessageStore(spark, f"{workdir}/table"), f"{workdir}/stream-ckpt"
    path = f"{logs}/p/a.jsonl"
    write_file(path, [record("a"), "{bad", record("b")])
    run(spark, store, logs, ckpt)
    assert uuids(store) == ["a", "b"]
    append(path, record("c") + "\n{worse\n")
    run(spark, store, logs, ckpt)
    assert uuids(store) == ["a", "b", "c"]
    line = record("d")
    append(path, line[:40])  # a writer at work
    write_file(f"{logs}/q/new.jsonl", [record("e")])
    run(spark, store, logs, ckpt)
    assert uuids(store) == ["a", "b", "c", "e"]
    append(path, line[40:])  # complete, but without a line end
    run(spark, store, logs, ckpt)
    assert uuids(store) == ["a", "b", "c", "d", "e"]
    append(path, "\n" + record("f") + "\n")
    import_logs(spark, store, logs, project="p", mode="insert_only")
    assert uuids(store) == ["a", "b", "c", "d", "e", "f"]
    write_file(path, [record(u) for u in "wxyz"] + [record("a")] * 5)  # rewritten, and longer
    run(spark, store, logs, ckpt)
    assert uuids(store) == ["a", "b", "c", "d", "e", "f", "w", "x", "y", "z"]
    write_file(path, [record("v")])  # rewritten, and shorter
    run(spark, store, logs, ckpt)
    assert uuids(store) == ["a", "b", "c", "d", "e", "f", "v", "w", "x", "y", "z"]
    assert sorted((r.line_no, r.error) for r in store.quarantine().collect()) == [(2, "invalid JSON"), (5, "invalid JSON")]
    before = store.loaded_files().count()
    run(spark, store, logs, f"{workdir}/other-ckpt")  # a stream that remembers nothing reads nothing
    assert store.messages().count() == 11 and store.loaded_files().count() == before == 2


def test_stream_sync_in_small_batches(spark, workdir):
    logs, store = f"{workdir}/logs", MessageStore(spark, f"{workdir}/table")
    for k in range(5):
        write_file(f"{logs}/p/f{k}.jsonl", [record(f"u{k}")])
    run(spark, store, logs, f"{workdir}/ckpt", max_files_per_trigger=2)
    assert uuids(store) == [f"u{k}" for k in range(5)]


def test_sync_parses_only_appended_lines(spark, workdir, monkeypatch):
    """The lines of a grown file that are loaded already do not reach the parser."""
    from logscope.operators import validate
    from logscope.plans.importer import sync
    logs, store = f"{workdir}/logs", MessageStore(spark, f"{workdir}/table")
    path = f"{logs}/p/a.jsonl"
    write_file(path, [record(f"u{k}") for k in range(50)])
    sync(spark, store, logs)
    append(path, record("late") + "\n")
    seen, real = [], validate.parse_lines
    monkeypatch.setattr(validate, "parse_lines", lambda lines: (seen.append(lines.count()), real(lines))[1])
    out = sync(spark, store, logs)
    assert seen == [1] and (out.stats.inserted, out.files) == (1, 1)
    assert sync(spark, store, logs).files == 0
