"""Import and sync jobs: scan → parse/check → report → write.

One parse of the input is checkpointed and shared by the statistics, the
per-file report, the quarantine and the write, so each line is parsed once.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logscope.operators import lines as line_ops
from logscope.operators import reports, validate
from logscope.plans.store import ImportResult, MessageStore, utc_now
from logscope.plans.sync import appended_lines, changed_files
from logscope.sources.jsonl import list_files, read_lines

MODES = ("upsert", "insert_only", "overwrite", "force")
BAD = ["file_path", "line_no", "error", "raw"]


@dataclass
class ImportOutcome:
    stats: ImportResult
    report: DataFrame       # per file / project / total: imported, errors
    quarantine: DataFrame   # file_path, line_no, error, raw
    files: int = 0          # files read (sync)


def import_logs(spark: SparkSession, store: MessageStore, root: str, project: str | None = None,
                mode: str = "upsert", skip_errors: bool = True, now: dt.datetime | None = None,
                files: DataFrame | None = None) -> ImportOutcome:
    """Import every ``*.jsonl`` under ``root`` (optionally one project, or only the listed ``files``).

    ``skip_errors=False`` is the all-or-nothing load: the job fails on the
    first bad line before anything is written. The files are listed before they
    are read and enter the store's manifest after the rows are stored, so a
    file that grows meanwhile, or a failed load, is read again by the next sync.
    Without ``files`` the tree is scanned as it is; the listing stays a DataFrame either way.
    The returned counts are those of the rows written, which the store has checked.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    listing = store._stable(list_files(spark, root, project) if files is None else files.select("file_path", "file_mtime", "length"))
    lines = read_lines(spark, root, project=project, files=None if files is None else listing)
    splits = store._stable(line_ops.split_table(lines))  # a row per split
    parsed = validate.parse_lines(line_ops.with_line_numbers(lines, offsets=splits))
    if not skip_errors:
        parsed = validate.fail_fast(parsed)
    return _store(store, parsed, mode, now or utc_now(), listing.join(line_ops.file_states(splits, listing), "file_path"))


def _store(store: MessageStore, parsed: DataFrame, mode: str, now: dt.datetime, files: DataFrame) -> ImportOutcome:
    """Write parsed lines (with ``line_no``) in ``mode``, then the quarantine, then the manifest."""
    parsed = store._stable(parsed if mode == "force" else parsed.withColumn("raw", F.when(F.col("error").isNotNull(), F.col("raw"))))
    bad = validate.quarantine(parsed).select(*BAD)
    counts = parsed.agg(F.count_if(F.col("error").isNull()).alias("valid"), F.count_if(F.col("error").isNotNull()).alias("errors")).first()
    valid = validate.valid_records(parsed)
    errors = counts["errors"]
    if mode == "upsert":
        done = store.upsert(valid, now)
        stats = ImportResult(done.inserted, counts["valid"] - done.inserted, 0, errors)
    elif mode == "insert_only":
        done = store.insert_only(valid, now)
        stats = ImportResult(done.inserted, 0, counts["valid"] - done.inserted, errors)
    elif mode == "overwrite":
        done = store.overwrite(valid, now)
        stats = ImportResult(done.inserted, counts["valid"] - done.inserted, 0, errors)
    else:
        inserted, rejected = store.force_insert(valid, now)
        stats = ImportResult(inserted, 0, 0, errors + counts["valid"] - inserted)
        numbers = parsed.select("file_path", "block_start", "pos", "line_no")
        bad = bad.unionByName(rejected.join(numbers, ["file_path", "block_start", "pos"]).select(*BAD))
    store.write_quarantine(bad, now)
    store.record_files(files)
    return ImportOutcome(stats, reports.import_report(parsed), bad)


def sync(spark: SparkSession, store: MessageStore, root: str, now: dt.datetime | None = None,
         max_files: int | None = None) -> ImportOutcome:
    """Add only new messages: the lines that files gained since they were loaded, and new files, minus stored uuids.

    A file counts as changed when its modification time or length differs from
    the manifest, in either direction; nothing is inferred from the table's own times.
    Of a file that only grew, the lines after the loaded ones are parsed; one whose loaded lines differ from what
    the manifest's checksum says, or that shrank, is read from its beginning (see ``plans/sync.py``). A last line without a
    line end is taken if it is valid and otherwise left for the next sync, since it may be half written.
    ``max_files`` limits one call to the files that changed longest ago; the next call goes on.
    """
    known = store.loaded_files()
    changed = changed_files(list_files(spark, root), known)
    if max_files is not None:
        changed = changed.orderBy("file_mtime", "file_path").limit(max_files)
    changed = store._stable(changed)
    n = changed.count()
    if not n:
        nothing = store._stable(validate.parse_lines(store.spark.createDataFrame([], "file_path string, block_start long, pos long, value string")))
        return ImportOutcome(ImportResult(0, 0, 0, 0), reports.import_report(nothing), nothing.select(
            "file_path", F.lit(0).cast("long").alias("line_no"), "error", "raw"))
    lines = read_lines(spark, root, files=changed)
    splits = store._stable(line_ops.split_table(lines))
    states = store._stable(line_ops.file_states(splits, changed))
    fresh = appended_lines(line_ops.with_line_numbers(lines, offsets=splits), changed.join(known.select("file_path", "lines", "checksum"), "file_path"))
    open_lines = states.where("open_line is not null").select("file_path", F.col("open_line").alias("line_no"), F.lit(True).alias("_open"))
    parsed = validate.parse_lines(fresh).join(open_lines, ["file_path", "line_no"], "left")
    parsed = parsed.where(F.col("error").isNull() | F.col("_open").isNull()).drop("_open")
    out = _store(store, parsed, "insert_only", now or utc_now(), changed.join(states, "file_path"))
    out.files = n
    return out
