"""Writes keyed by uuid, as pure DataFrame planners.

Each function takes the current rows and a batch and returns the rows to
write; ``plans/store.py`` decides which partitions are read and rewritten.
The batch is the output of ``validate.parse_lines`` (valid rows only) and
carries its source order in ``file_path``, ``block_start``, ``pos``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logscope.schema import RECORD_COLUMNS, TABLE_COLUMNS
from logscope.session import ensure_checkpoint_dir

ORDER_COLUMNS = ["file_path", "block_start", "pos"]


def dedup_last(batch: DataFrame) -> DataFrame:
    """One row per uuid: the last occurrence in source order wins.

    ``row_number() = 1`` over a uuid window is planned with a partial
    ``WindowGroupLimit`` before the shuffle, so a uuid repeated in many rows is
    cut to one row per map task before it moves.
    """
    w = Window.partitionBy("uuid").orderBy(*[F.col(c).desc() for c in ORDER_COLUMNS])
    return batch.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def uuid_exists(batch: DataFrame, table: DataFrame) -> DataFrame:
    """Batch rows whose uuid is already stored (semi join on uuid)."""
    return batch.join(table.select("uuid"), "uuid", "left_semi")


def new_rows(batch: DataFrame, table: DataFrame) -> DataFrame:
    """Batch rows whose uuid is not stored yet (anti join on uuid)."""
    return batch.join(table.select("uuid"), "uuid", "left_anti")


def range_offsets(sizes: DataFrame, keys: list[str], size: str = "_n", out: str = "_before", ranges: int | None = None) -> DataFrame:
    """``sizes`` (one row per key, ``size`` rows each) with ``out``: the rows of all smaller keys, by a two-level prefix sum.

    The keys are dealt into ``ranges`` (default: the shuffle partitions) of neighbouring keys, which a
    checkpoint fixes. Sums run inside each range, in a task of its own; the totals of the ranges, one
    number each, become the offsets of the ranges. No task sees more than one range.
    """
    spark = sizes.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialised(sizes.select(*keys, size).repartitionByRange(ranges, *keys).withColumn("_range", F.spark_partition_id()))
    totals = dealt.groupBy("_range").agg(F.sum(size).alias("n"))
    listed = totals.agg(F.sort_array(F.collect_list(F.struct("_range", "n"))).alias("t"))  # a number per range
    earlier = lambda r: F.aggregate(F.filter("t", lambda x: x["_range"] < r), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    starts = listed.select(F.map_from_entries(F.transform("t", lambda x: F.struct(x["_range"], earlier(x["_range"]))))).scalar()
    inside = F.coalesce(F.sum(size).over(Window.partitionBy("_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("_inside", inside).withColumn(out, F.col("_inside") + starts[F.col("_range")]).drop("_range", "_inside")


def number_rows(df: DataFrame, order: list[str], keys: list[Column],
                base: Column | int = 0, name: str = "id", ranges: int | None = None) -> DataFrame:
    """Dense 1-based numbers in ``order``, offset by ``base``, without a single-partition window.

    ``keys`` are computed from the data, never decrease along ``order`` (compared one after the other), and group
    few enough rows for one task. Rows are counted per group, the counts become offsets
    (see :func:`range_offsets`), and rows are numbered inside their group. Numbers follow from the data
    alone: neither ranges nor plan changes at run time can change one. ``df`` is read twice; pass a materialised frame.
    """
    names = [f"_k{k}" for k in range(len(keys))]
    keyed = df.withColumns(dict(zip(names, keys)))
    offsets = range_offsets(keyed.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")), names, ranges=ranges).drop("_n")
    base_col = base if isinstance(base, Column) else F.lit(base)
    rank = F.row_number().over(Window.partitionBy(*names).orderBy(*order))
    return (keyed.withColumn("_rank", rank).join(offsets, names)
            .withColumn(name, (base_col + F.col("_before") + F.col("_rank")).cast("long"))
            .select(*df.columns, name))


def number_batch(batch: DataFrame, base: Column | int = 0) -> DataFrame:
    """Ids in source order: by file, then split, then position; a split is bounded by the reader."""
    return number_rows(batch, ORDER_COLUMNS, [F.col("file_path"), F.col("block_start")], base)


def materialised(df: DataFrame) -> DataFrame:
    """One reliable copy, for a frame that several branches of a plan read."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def marked(batch: DataFrame, table: DataFrame) -> DataFrame:
    """The deduplicated batch with ``is_stored``: one pass over the batch and the table's uuids."""
    stored = table.select(F.col("uuid").alias("_su"))
    return (batch.join(stored, F.col("uuid") == F.col("_su"), "left")
            .withColumn("is_stored", F.col("_su").isNotNull()).drop("_su"))


def max_id(table: DataFrame) -> Column:
    """Largest stored id (0 for an empty table) as a scalar subquery."""
    return table.select(F.coalesce(F.max("id"), F.lit(0)).cast("long")).scalar()


def _new_table_rows(rows: DataFrame, now: Column) -> DataFrame:
    return rows.select(
        "id", *RECORD_COLUMNS,
        F.lit(False).alias("is_favorite"),
        now.alias("created_at"),
        now.alias("updated_at"),
        *[c for c in rows.columns if c not in TABLE_COLUMNS],
    )


def plan_upsert(table: DataFrame, batch: DataFrame, now: Column, id_base: Column | int | None = None) -> DataFrame:
    """Table rows after an upsert of ``batch`` (deduplicated by uuid).

    Existing uuid → record columns and ``updated_at`` come from the batch
    (unconditionally, even if older); ``id``, ``created_at`` and
    ``is_favorite`` are kept. New uuid → appended with the next ids in source
    order. Untouched rows pass through. ``batch`` may carry ``is_stored``
    (see :func:`marked`); otherwise it is marked and materialised here, so the
    incoming lines are parsed once whatever the plan does with the batch.
    """
    if "is_stored" not in batch.columns:
        batch = materialised(marked(batch.select(*RECORD_COLUMNS, *ORDER_COLUMNS), table))
    t = table.alias("t")
    b = batch.where("is_stored").select(*RECORD_COLUMNS).alias("b")
    joined = t.join(b, F.col("t.uuid") == F.col("b.uuid"), "left")
    hit = F.col("b.uuid").isNotNull()
    kept = joined.select(
        F.col("t.id").alias("id"),
        *[F.when(hit, F.col(f"b.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in RECORD_COLUMNS],
        F.col("t.is_favorite").alias("is_favorite"),
        F.col("t.created_at").alias("created_at"),
        F.when(hit, now).otherwise(F.col("t.updated_at")).alias("updated_at"),
    )
    return kept.unionByName(plan_new(batch, now, max_id(table) if id_base is None else id_base).select(*kept.columns))


def plan_new(batch: DataFrame, now: Column, id_base: Column | int) -> DataFrame:
    """Table rows of the batch rows whose uuid is not stored, numbered after ``id_base`` in source order."""
    fresh = batch.where(~F.col("is_stored")).select(*RECORD_COLUMNS, *ORDER_COLUMNS)
    return _new_table_rows(number_batch(fresh, id_base), now).select(*TABLE_COLUMNS)


def plan_insert_only(table: DataFrame, batch: DataFrame, now: Column, id_base: Column | int | None = None) -> DataFrame:
    """Rows to append: batch rows with a uuid not yet stored, numbered after the stored ids."""
    if "is_stored" not in batch.columns:
        batch = materialised(new_rows(batch.select(*RECORD_COLUMNS, *ORDER_COLUMNS), table).withColumn("is_stored", F.lit(False)))
    return plan_new(batch, now, max_id(table) if id_base is None else id_base)


def force_marked(table: DataFrame, valid: DataFrame) -> DataFrame:
    """Every valid row with ``is_new``: the first of its uuid in source order, and the uuid is not stored.

    The first occurrence is a minimum per uuid (partial aggregates), joined
    back, so a uuid that many rows repeat is never ranked in one task.
    """
    rows = valid.select(*RECORD_COLUMNS, *ORDER_COLUMNS, *[c for c in ("raw",) if c in valid.columns])
    first = rows.groupBy("uuid").agg(F.min(F.struct(*ORDER_COLUMNS)).alias("_first"))
    first = new_rows(first, table)
    return (rows.join(first.withColumnRenamed("uuid", "_u"), (F.col("uuid") == F.col("_u")) & (F.struct(*ORDER_COLUMNS) == F.col("_first")), "left")
            .withColumn("is_new", F.col("_u").isNotNull()).drop("_u", "_first"))


def plan_force(table: DataFrame, valid: DataFrame, now: Column, id_base: Column | int | None = None) -> tuple[DataFrame, DataFrame]:
    """Forced import: plain inserts without the update path.

    Returns (inserted rows, rejected rows). The first occurrence of a uuid that
    is not stored yet is inserted; every other row (stored uuid, or a repeat
    inside the batch) is rejected with ``duplicate uuid``, as a UNIQUE
    constraint would. Rejected rows keep their source position (and ``raw`` if given).
    """
    rows = materialised(force_marked(table, valid))
    inserted = plan_new(rows.withColumn("is_stored", ~F.col("is_new")), now, max_id(table) if id_base is None else id_base)
    rejected = rows.where(~F.col("is_new")).select(
        *ORDER_COLUMNS, "uuid", F.lit("duplicate uuid").alias("error"), *[c for c in ("raw",) if c in rows.columns])
    return inserted, rejected


def plan_overwrite(batch: DataFrame, now: Column) -> DataFrame:
    """Full re-import: the deduplicated batch numbered from 1."""
    fresh = materialised(batch.select(*RECORD_COLUMNS, *ORDER_COLUMNS).withColumn("is_stored", F.lit(False)))
    return plan_new(fresh, now, 0)


def import_stats(parsed: DataFrame, table: DataFrame) -> DataFrame:
    """One row: inserted, updated, skipped, errors, total_processed.

    inserted = distinct new uuids; updated = every other valid row (an update
    of a stored row, or a repeat inside the batch); errors = rejected lines.
    Skipped is always 0 (no path produces it). total = inserted + updated + skipped.
    One pass over the parsed lines: rows are counted per uuid (rejected lines
    have none), then the counts meet the table's uuids.
    """
    per_uuid = parsed.groupBy("uuid").agg(F.count(F.lit(1)).alias("_n"))
    stored = table.select(F.col("uuid").alias("_su"))
    m = per_uuid.join(stored, F.col("uuid") == F.col("_su"), "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    fresh = F.col("uuid").isNotNull() & F.col("_su").isNull()
    return m.agg(
        F.count_if(fresh).alias("inserted"),
        (total(F.when(F.col("uuid").isNotNull(), F.col("_n"))) - F.count_if(fresh)).alias("updated"),
        F.lit(0).cast("long").alias("skipped"),
        total(F.when(F.col("uuid").isNull(), F.col("_n"))).alias("errors"),
        total(F.when(F.col("uuid").isNotNull(), F.col("_n"))).alias("total_processed"),
    )
