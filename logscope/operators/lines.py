"""Physical line numbers of lines read from splittable files.

The file reader tags each line with its split (``file_path``,
``block_start``) and a position ``pos`` that grows with the line order inside
the split. A line's 1-based number is the number of lines in the earlier
splits of the same file plus its rank inside its own split. Only the split
table (one row per split) is aggregated and shuffled; the lines are joined to
it, and the join side stays small (AQE broadcasts it at run time when its
measured size is under the threshold, else it is a shuffle join).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def split_table(lines: DataFrame) -> DataFrame:
    """One row per split: first position, lines, lines before it in its file, bytes, and a sum of line hashes.

    ``lines`` must hold every physical line (blank ones too), before filters. ``_bytes`` counts a line end for
    each line, so in a file whose last line has none the bytes are one more than the file's.
    """
    tail = F.max_by(F.struct(F.octet_length("value").alias("size"), line_hash().alias("hash")), "pos")
    per_split = lines.groupBy("file_path", "block_start").agg(
        F.min("pos").alias("_first_pos"), F.count(F.lit(1)).alias("_n"), F.sum(F.octet_length("value").cast("long") + 1).alias("_bytes"),
        F.sum(line_hash()).alias("_hash"), tail.alias("_tail"), F.max("file_size").alias("_size"))
    earlier = Window.partitionBy("file_path").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    return per_split.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))


def line_hash() -> Column:
    """A line's share of its file's checksum (wide enough to be summed over any file)."""
    return F.xxhash64("value").cast("decimal(20,0)")


def split_offsets(lines: DataFrame) -> DataFrame:
    """One row per split: first position and the count of lines before it in its file."""
    per_split = lines.groupBy("file_path", "block_start").agg(F.min("pos").alias("_first_pos"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("file_path").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    return per_split.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")


def with_line_numbers(rows: DataFrame, lines: DataFrame | None = None, offsets: DataFrame | None = None) -> DataFrame:
    """Add ``line_no`` to ``rows`` (a subset of ``lines``, same split columns); ``offsets``: splits already counted."""
    offsets = split_offsets(lines) if offsets is None else offsets.select("file_path", "block_start", "_first_pos", "_before")
    return (rows.join(offsets, ["file_path", "block_start"], "left")
            .withColumn("line_no", (F.col("_before") + F.col("pos") - F.col("_first_pos") + 1).cast("long"))
            .drop("_before", "_first_pos"))


def file_states(splits: DataFrame, listing: DataFrame) -> DataFrame:
    """(file_path, lines, checksum, open_line): the finished lines of each file of ``listing``, from its splits.

    A last line without a line end is not finished (someone may still be writing it): it is ``open_line``, and not counted.
    """
    per_file = splits.groupBy("file_path").agg(
        F.sum("_n").alias("n"), F.sum("_bytes").alias("bytes"), F.sum("_hash").alias("hash"), F.max_by("_tail", "block_start").alias("tail"),
        F.max("_size").alias("size"))
    unfinished = F.col("bytes") > F.col("size")
    states = per_file.select(
        "file_path", (F.col("n") - unfinished.cast("long")).alias("lines"),
        F.when(unfinished, F.col("hash") - F.col("tail.hash")).otherwise(F.col("hash")).cast("decimal(38,0)").alias("checksum"),
        F.when(unfinished, F.col("n")).alias("open_line"))
    empty = F.coalesce("lines", F.lit(0)).cast("long")
    return listing.select("file_path").join(states, "file_path", "left").select(
        "file_path", empty.alias("lines"), F.coalesce("checksum", F.lit(0).cast("decimal(38,0)")).alias("checksum"), "open_line")
