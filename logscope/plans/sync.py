"""Incremental sync: add only messages not stored yet.

The manifest keeps, for each loaded file, its modification time and length, how
many finished lines it had and a checksum of them. A file is read when it is new, or when
time or length differ. Of a file that grew, only the lines after the loaded ones
go on: first the checksum of the loaded lines is taken again, so a file that was rewritten rather
than appended to is read from its beginning. The uuid anti-join then drops
what is stored already. Nothing is rewritten: new rows are appended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logscope.operators import upsert, validate
from logscope.operators.lines import line_hash


def changed_files(listing: DataFrame, loaded: DataFrame) -> DataFrame:
    """Rows of ``listing`` (file_path, file_mtime, length) that the manifest lacks or holds differently."""
    known = loaded.select(*[F.col(c).alias(f"_{c}") for c in ("file_path", "file_mtime", "length")])
    same = (F.col("file_path") == F.col("_file_path")) & (F.col("file_mtime") == F.col("_file_mtime")) & (F.col("length") == F.col("_length"))
    return listing.join(known, same, "left_anti")


def appended_lines(numbered: DataFrame, known: DataFrame) -> DataFrame:
    """Lines (with ``line_no``) after those that ``known`` (file_path, lines, checksum) says are loaded.

    All lines of a file that is not known, or whose loaded lines are no longer the same. Lines are
    hashed where they are read; per file two sums are shuffled, and a row per file comes back.
    """
    loaded = known.where(F.col("lines") > 0).select("file_path", F.col("lines").alias("_lines"), F.col("checksum").alias("_checksum"))
    before = numbered.join(loaded, "file_path").where(F.col("line_no") <= F.col("_lines"))
    whole = (before.groupBy("file_path", "_lines", "_checksum").agg(F.count(F.lit(1)).alias("_n"), F.sum(line_hash()).alias("_hash"))
             .where((F.col("_n") == F.col("_lines")) & (F.col("_hash") == F.col("_checksum"))))
    after = whole.select(F.col("file_path").alias("_file"), F.col("_lines").alias("_after"))
    fresh = numbered.join(after, F.col("file_path") == F.col("_file"), "left")
    return fresh.where(F.col("line_no") > F.coalesce("_after", F.lit(0))).drop("_file", "_after")


def plan_sync(table: DataFrame, lines: DataFrame, listing: DataFrame, loaded: DataFrame, now: Column,
              id_base: Column | None = None) -> DataFrame:
    """Rows to append for the lines of new and changed files."""
    fresh = lines.join(changed_files(listing, loaded).select("file_path"), "file_path", "left_semi")
    batch = upsert.dedup_last(validate.valid_records(validate.parse_lines(fresh)))
    return upsert.plan_insert_only(table, batch, now, id_base)
