"""Directory trees of JSON Lines session logs as a DataFrame of lines.

The scan is Spark's splittable text source: large files are split across
tasks, many small files are packed into one task. Only regular files whose
name ends in ``.jsonl`` are read (case-sensitive), at any depth. Spark's file
listing does not show names starting with ``_`` or ``.`` below the root.
"""

from __future__ import annotations

import datetime as dt
from typing import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logscope.operators.validate import project_from_path

BITMAP = 1 << 15      # bits of one bitmap of Spark's bitmap functions
MOST_BITS = 1 << 23   # 1 MB: beyond 131,072 files more of the other files share a bit, and are dropped by the join
LINE_SCHEMA = T.StructType([T.StructField("value", T.StringType())])


def decoded_path(c):
    """File URI → plain path; ``+`` is kept (url_decode would make it a space)."""
    p = F.regexp_replace(c, "^file:(//)?", "")
    return F.coalesce(F.try_url_decode(F.replace(p, F.lit("+"), F.lit("%2B"))), p)


def _scan(reader, root: str, how: str = "text") -> DataFrame:
    """Scan ``root/*`` so each first-level folder is its own input path: with
    many projects Spark lists the tree with a parallel job instead of walking
    it on the driver. An empty root matches nothing and falls back to the
    root itself (no rows); a missing root raises."""
    reader = reader.format(how)
    try:
        return reader.load(root.rstrip("/") + "/*")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "does not exist" not in str(e):
            raise
        return reader.load(root)


def list_files(spark: SparkSession, root: str, project: str | None = None) -> DataFrame:
    """(file_path, file_mtime, length) of every ``*.jsonl`` file under ``root``; no file is opened."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl")
    files = _scan(reader, root, "binaryFile").select(
        decoded_path(F.col("path")).alias("file_path"), F.col("modificationTime").alias("file_mtime"), "length")
    return files if project is None else files.where(project_from_path(F.col("file_path")) == F.lit(project))


def _bit(position, bits: int, held: dict) -> Column:
    """Whether the bit at ``position`` (from 0) is set in ``held`` (first byte of a stretch -> bytes), a literal of fixed size."""
    packed = bytearray(bits // 8)
    for first, data in held.items():
        packed[first:first + len(data)] = data
    byte = F.substring(F.lit(bytes(packed)), (F.floor(position / 8) + 1).cast("int"), F.lit(1))
    value = F.conv(F.hex(byte), 16, 10).cast("int")
    return F.getbit(value, F.pmod(position, F.lit(8)).cast("int")) == 1


def path_filter(files: DataFrame, bits: int | None = None) -> Callable[[Column], Column]:
    """A test on a path that is true for every path of ``files`` and false for nearly all others.

    The paths become one bitmap of their hashes, made by a distributed aggregate of the public bitmap
    functions; ``bits`` follows their number (64 for each) between 2^15 and ``MOST_BITS``, so at most
    1 MB reaches the driver, whatever the number of files. As an expression over file metadata it
    prunes files in the scan, before they are opened.
    """
    if bits is None:
        n = files.count()
        bits = min(MOST_BITS, max(BITMAP, 1 << (64 * max(1, n) - 1).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    # Bit positions of the public functions count from 1 in each bitmap of 32,768.
    at = place(F.col("file_path")) + 1
    maps = (files.select(F.bitmap_bucket_number(at).alias("b"), F.bitmap_bit_position(at).alias("p"))
            .groupBy("b").agg(F.bitmap_construct_agg("p").alias("m")).collect())  # 4 KB for each of bits / 32,768 rows at most
    held = {(r["b"] - 1) * (BITMAP // 8): bytes(r["m"]) for r in maps}
    return lambda c: _bit(place(c), bits, held)


def read_lines(spark: SparkSession, root: str, project: str | None = None, files: DataFrame | None = None,
               modified_after: dt.datetime | str | None = None) -> DataFrame:
    """Lines of every ``*.jsonl`` file under ``root``.

    Columns: ``file_path``, ``project_path``, ``file_mtime``, ``file_size``, ``block_start``,
    ``pos``, ``value``. ``project`` keeps only files whose parent folder has
    that name; the test is on file metadata, so other files are pruned before
    they are opened. ``files`` (a listing, see :func:`list_files`) keeps the lines of
    those files only: the set stays a DataFrame, a bitmap of it prunes files in the scan
    (:func:`path_filter`), and a semi join drops what a shared bit let through. Files directly under the root take the root's own name
    as their project. ``modified_after`` (UTC) skips files not changed since then.
    A missing root raises; an empty tree gives no rows.
    """
    reader = (spark.read.schema(LINE_SCHEMA)
              .option("recursiveFileLookup", "true")
              .option("pathGlobFilter", "*.jsonl")
              .option("lineSep", "\n"))
    if modified_after is not None:
        when = modified_after if isinstance(modified_after, str) else modified_after.strftime("%Y-%m-%dT%H:%M:%S")
        reader = reader.option("modifiedAfter", when).option("timeZone", "UTC")
    path = decoded_path(F.col("_metadata.file_path"))
    df = _scan(reader, root)
    if files is not None:
        df = df.where(path_filter(files)(path))
    if project is not None:
        df = df.where(project_from_path(path) == F.lit(project))
    # Positions are taken right after the scan (and the file-pruning filter),
    # before anything can reorder rows.
    lines = df.select(
        path.alias("file_path"),
        project_from_path(path).alias("project_path"),
        F.col("_metadata.file_modification_time").alias("file_mtime"),
        F.col("_metadata.file_size").alias("file_size"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("pos"),
        F.col("value"),
    )
    return lines if files is None else lines.join(files.select("file_path"), "file_path", "left_semi")
