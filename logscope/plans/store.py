"""The message table on plain Parquet, and the jobs that change it.

Layout, below one root folder:

* ``messages/bkt=N/`` (after a full re-import ``messages-<sequence>/bkt=N/``) - the rows, by a hash of the uuid into a number of
  buckets fixed when the store is made. An edited message touches its bucket
  and no other; new messages are appended to their buckets. Inside a bucket
  rows are sorted by (``project_path``, ``timestamp``), so project and date
  filters skip row groups by their statistics;
* ``favorites/`` - changes of favourite flags (uuid, flag, sequence), appended
  and joined at read: the newest change of a uuid counts. No message is rewritten;
* ``log/`` - a row per write: buckets, the largest id handed out, rows written, generation. Ids are
  reserved here before rows are written, so a failed write leaves a gap, never a repeated id;
* ``changes/`` - the change feed: id and bucket of every row that a job writes anew, so that a text index is refreshed
  without reading the table; ``states/`` - rows and newest time per bucket and project, of the rows a job wrote, so that
  counts and maxima per project are merged from small numbers;
* ``files/`` - the manifest of loaded files (path, modification time, length, finished lines and their checksum).

A full re-import writes a new generation of the rows and then one row of the log, which switches all
readers over: favourites and loaded files from before its sequence count no more, and a failure on the
way leaves everything as it was.

There is no transactional table format: one writer at a time (an index refresh counts as one), and every job is
safe to repeat (keys are uuids). Each write is staged once in a reliable
checkpoint (``spark.checkpoint.dir``), its rows and ids are compared with the
plan, and only then it replaces or joins the stored files.
"""

from __future__ import annotations

import datetime as dt
import time
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logscope.operators import bm25, trigram, validate, zones
from logscope.operators import favorites as fav_ops
from logscope.operators import search as search_ops
from logscope.operators import upsert as U
from logscope.schema import MESSAGE_SCHEMA, TABLE_COLUMNS

PARTITION = "bkt"
BUCKETS = 64
LAYOUT = [PARTITION, "project_path", "timestamp"]
STORED_SCHEMA = T.StructType(list(MESSAGE_SCHEMA.fields) + [T.StructField(PARTITION, T.IntegerType())])
LOG_SCHEMA = "seq long, kind string, buckets int, max_id long, rows long, gen long"
CHANGE_SCHEMA = "id long, bkt int, seq long"
STATE_SCHEMA = "bkt int, project_path string, n long, last timestamp_ntz, whole boolean, seq long"
LOOKUP = 1000   # uuids of a batch that are named in the scan's filter, for the Bloom filters of the files
FAVORITE_SCHEMA = "uuid string, fav boolean, seq long"
FILE_SCHEMA = "file_path string, file_mtime timestamp, length long, lines long, checksum decimal(38,0), seq long"
QUARANTINE_SCHEMA = "file_path string, line_no long, error string, raw string, load_date date"


class WriteMismatch(RuntimeError):
    """Staged rows differ from the plan; nothing has been stored."""


@dataclass
class ImportResult:
    inserted: int
    updated: int
    skipped: int
    errors: int

    @property
    def total_processed(self) -> int:
        return self.inserted + self.updated + self.skipped


def utc_now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None, microsecond=0)


class MessageStore:
    def __init__(self, spark: SparkSession, root: str, quarantine_root: str | None = None, buckets: int = BUCKETS):
        self.spark = spark
        self.root = root.rstrip("/")
        self.quarantine_root = quarantine_root or self.root + "_quarantine"
        self._buckets = buckets

    # -- schema --------------------------------------------------------------
    @property
    def table_root(self) -> str:
        """The folder of the current generation of rows."""
        return self._folder(self._state()["gen"])

    def _folder(self, gen: int) -> str:
        return f"{self.root}/messages-{gen}" if gen else f"{self.root}/messages"

    def create_table(self, name: str) -> None:
        """Register the table in the catalog (idempotent; call it again after a full re-import)."""
        self.drop_table(name)
        cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in STORED_SCHEMA.fields)
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({cols}) USING parquet "
                       f"PARTITIONED BY ({PARTITION}) LOCATION '{self.table_root}'")
        self.spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")

    def drop_table(self, name: str) -> None:
        """Remove the catalog entry (idempotent); the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    # -- reads ---------------------------------------------------------------
    def _read(self, folder: str, schema) -> DataFrame:
        try:
            return self.spark.read.schema(schema).option("basePath", folder).parquet(folder)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
                return self.spark.createDataFrame([], schema)
            raise

    def read(self, files: DataFrame | None = None) -> DataFrame:
        """All stored rows as written (with the bucket, without favourite changes); of ``files`` alone, nearly, if given."""
        return trigram.read_files(self._read(self.table_root, STORED_SCHEMA), files)

    def favorites(self) -> DataFrame:
        """(uuid, fav): the newest change of each uuid."""
        return (self._read(f"{self.root}/favorites", FAVORITE_SCHEMA).where(F.col("seq") > self._state()["gen"]).groupBy("uuid")
                .agg(F.max_by("fav", F.struct("seq", "fav")).alias("fav")))

    def messages(self, files: DataFrame | None = None) -> DataFrame:
        """The messages with their current favourite flags (``files``: see :meth:`read`)."""
        changes = self.favorites().select(F.col("uuid").alias("_fu"), F.col("fav").alias("_fav"))
        rows = self.read(files).join(changes, F.col("uuid") == F.col("_fu"), "left")
        return rows.select(*[F.coalesce(F.col("_fav"), F.col(c)).alias(c) if c == "is_favorite" else c for c in TABLE_COLUMNS])

    def quarantine(self) -> DataFrame:
        return self._read(self.quarantine_root, QUARANTINE_SCHEMA)

    def loaded_files(self) -> DataFrame:
        """(file_path, file_mtime, length, lines, checksum) of the newest load of each file."""
        return (self._read(f"{self.root}/files", FILE_SCHEMA).where(F.col("seq") > self._state()["gen"]).groupBy("file_path")
                .agg(F.max_by(F.struct("file_mtime", "length", "lines", "checksum"), "seq").alias("_f")).select("file_path", "_f.*"))

    def _log(self) -> DataFrame:
        return self._read(f"{self.root}/log", LOG_SCHEMA)

    def _state(self) -> dict:
        """Buckets, largest id handed out and current generation: one row per write is read, not the table."""
        r = self._log().agg(F.max("buckets").alias("buckets"), F.max_by("max_id", "seq").alias("max_id"), F.max("gen").alias("gen")).first()
        return {"buckets": r["buckets"] or self._buckets, "max_id": r["max_id"] or 0, "gen": r["gen"] or 0}

    def buckets(self) -> int:
        """The bucket count that the stored rows were laid out with."""
        return self._state()["buckets"]

    def max_id(self) -> int:
        """The largest id handed out since the last overwrite."""
        return self._state()["max_id"]

    # -- writes --------------------------------------------------------------
    def _stable(self, df: DataFrame) -> DataFrame:
        return U.materialised(df)

    def _append(self, folder: str, rows: DataFrame) -> None:
        rows.coalesce(1).write.mode("append").parquet(f"{self.root}/{folder}")

    def _reserve(self, kind: str, max_id: int, rows: int, buckets: int, gen: int | None = None) -> int:
        """One row of the log, returns its sequence; ``gen``: switch to that generation (its number is the sequence of the switch)."""
        row = (gen or time.time_ns(), kind, buckets, max_id, rows, gen)
        self._append("log", self.spark.createDataFrame([row], LOG_SCHEMA))
        return row[0]

    def _announce(self, seq: int, changed: DataFrame, staged: DataFrame, whole: list[int]) -> None:
        """Before rows are written: which are new or changed, and what they add to the numbers per project.

        ``whole``: buckets that ``staged`` holds all rows of, so that earlier numbers of them are void.
        """
        changed.select("id", PARTITION, F.lit(seq).alias("seq")).write.mode("append").parquet(f"{self.root}/changes")
        (staged.groupBy(PARTITION, "project_path").agg(F.count(F.lit(1)).alias("n"), F.max("timestamp").alias("last"))
         .select(PARTITION, "project_path", "n", "last", F.col(PARTITION).isin(whole).alias("whole"), F.lit(seq).alias("seq"))
         .coalesce(1).write.mode("append").parquet(f"{self.root}/states"))

    def _done(self, seq: int, max_id: int, buckets: int) -> None:
        """The job with that sequence has written all its rows."""
        self._append("log", self.spark.createDataFrame([(seq, "done", buckets, max_id, 0, None)], LOG_SCHEMA))

    def _bucketed(self, rows: DataFrame, buckets: int) -> DataFrame:
        return rows.withColumn(PARTITION, F.pmod(F.xxhash64("uuid"), F.lit(buckets)).cast("int"))

    def _write(self, staged: DataFrame, mode: str, dynamic: bool, folder: str | None = None) -> None:
        (staged.select(*TABLE_COLUMNS, PARTITION)
         .repartitionByRange(*LAYOUT).sortWithinPartitions(*LAYOUT)
         .write.mode(mode)
         .option("partitionOverwriteMode", "dynamic" if dynamic else "static")
         .option("parquet.bloom.filter.enabled#uuid", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
         .partitionBy(PARTITION).parquet(folder or self.table_root))

    def _checked(self, rows: DataFrame, expected: int, new_ids: tuple[int, int]) -> DataFrame:
        """Stage ``rows`` and compare them with the plan: how many, ids without repeats, new ids without gaps."""
        staged = self._stable(rows)
        low, high = new_ids
        fresh = F.col("id").between(low + 1, high)
        got = staged.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.count_if(fresh).alias("fresh")).first()
        if (got["n"], got["ids"], got["fresh"]) != (expected, expected, high - low):
            raise WriteMismatch(f"planned {expected} rows and {high - low} new ids, staged {got['n']} rows, "
                                f"{got['ids']} ids, {got['fresh']} new ids; nothing was written")
        return staged

    def _marked(self, batch: DataFrame, buckets: int) -> DataFrame:
        columns = [*U.RECORD_COLUMNS, *U.ORDER_COLUMNS]
        last = self._stable(self._bucketed(U.dedup_last(batch).select(*columns), buckets))
        return self._stable(U.marked(last, self.stored_uuids(last)))

    def stored_uuids(self, batch: DataFrame) -> DataFrame:
        """(uuid) of the stored rows that ``batch`` (uuid, bkt) may hold.

        Only the batch's buckets are read; a batch of up to LOOKUP rows is named in the filter, so that the files'
        Bloom filters skip row groups that hold none of them.
        """
        wanted = [r[0] for r in batch.select(PARTITION).distinct().collect()]  # at most the number of buckets
        rows = self.read().where(F.col(PARTITION).isin(wanted)).select("uuid")
        few = [r[0] for r in batch.select("uuid").limit(LOOKUP + 1).collect()]
        return rows.where(F.col("uuid").isin(few)) if len(few) <= LOOKUP else rows

    def write_quarantine(self, bad: DataFrame, now: dt.datetime) -> None:
        """Append rejected lines, each once: a repeated import or stream batch adds nothing."""
        bad = bad.select("file_path", "line_no", "error", "raw").dropDuplicates(["file_path", "line_no", "error"])
        known = self.quarantine().select(*[F.col(c).alias(f"_{c}") for c in ("file_path", "line_no", "error")])
        same = (F.col("file_path") == F.col("_file_path")) & F.col("line_no").eqNullSafe(F.col("_line_no")) & (F.col("error") == F.col("_error"))
        new = self._stable(bad.join(known, same, "left_anti"))
        if not new.isEmpty():
            new.withColumn("load_date", F.lit(now.date())).write.mode("append").partitionBy("load_date").parquet(self.quarantine_root)

    def upsert(self, batch: DataFrame, now: dt.datetime | None = None) -> ImportResult:
        """Insert new uuids, update stored ones (``batch`` = valid records, any duplicates).

        Buckets with a stored uuid of the batch are rewritten; new uuids of all other buckets are appended.
        """
        now, buckets = now or utc_now(), self.buckets()
        batch = self._marked(batch, buckets)
        counts = {r[PARTITION]: (r["hits"], r["fresh"]) for r in batch.groupBy(PARTITION).agg(
            F.count_if("is_stored").alias("hits"), F.count_if(~F.col("is_stored")).alias("fresh")).collect()}  # a row per bucket
        touched = sorted(b for b, (hits, _) in counts.items() if hits)
        inserted, updated = sum(f for _, f in counts.values()), sum(h for h, _ in counts.values())
        base = self.max_id()
        current = self.read().where(F.col(PARTITION).isin(touched))
        stored = current.count() if touched else 0
        rows = U.plan_upsert(current.select(*TABLE_COLUMNS), batch, F.lit(now).cast("timestamp_ntz"), base)
        staged = self._checked(self._bucketed(rows, buckets), stored + inserted, (base, base + inserted))
        seq = self._reserve("upsert", base + inserted, stored + inserted, buckets)
        self._announce(seq, staged.join(batch.select("uuid"), "uuid", "left_semi"), staged, touched)
        if touched:
            self._write(staged.where(F.col(PARTITION).isin(touched)), "overwrite", dynamic=True)
        if any(f for b, (_, f) in counts.items() if b not in touched):
            self._write(staged.where(~F.col(PARTITION).isin(touched)), "append", dynamic=False)
        self._done(seq, base + inserted, buckets)
        return ImportResult(inserted, updated, 0, 0)

    def _append_new(self, rows: DataFrame, kind: str, inserted: int, base: int, buckets: int) -> None:
        staged = self._checked(self._bucketed(rows, buckets), inserted, (base, base + inserted))
        seq = self._reserve(kind, base + inserted, inserted, buckets)
        if inserted:
            self._announce(seq, staged, staged, [])
            self._write(staged, "append", dynamic=False)
        self._done(seq, base + inserted, buckets)

    def insert_only(self, batch: DataFrame, now: dt.datetime | None = None) -> ImportResult:
        """Append only uuids not stored yet (sync); nothing is rewritten."""
        now, buckets, base = now or utc_now(), self.buckets(), self.max_id()
        batch = self._marked(batch, buckets)
        got = batch.agg(F.count_if(~F.col("is_stored")).alias("fresh"), F.count_if("is_stored").alias("hits")).first()
        self._append_new(U.plan_new(batch, F.lit(now).cast("timestamp_ntz"), base), "insert", got["fresh"], base, buckets)
        return ImportResult(got["fresh"], 0, got["hits"], 0)

    def force_insert(self, valid: DataFrame, now: dt.datetime | None = None) -> tuple[int, DataFrame]:
        """Plain inserts; returns the number inserted and the rejected rows (duplicate uuids) for the error report."""
        now, buckets, base = now or utc_now(), self.buckets(), self.max_id()
        rows = self._stable(U.force_marked(self.read(), valid))
        inserted = rows.where("is_new").count()
        fresh = rows.withColumn("is_stored", ~F.col("is_new"))
        self._append_new(U.plan_new(fresh, F.lit(now).cast("timestamp_ntz"), base), "force", inserted, base, buckets)
        rejected = rows.where(~F.col("is_new")).select(*U.ORDER_COLUMNS, "uuid", F.lit("duplicate uuid").alias("error"),
                                                       *[c for c in ("raw",) if c in rows.columns])
        return inserted, rejected

    def overwrite(self, batch: DataFrame, now: dt.datetime | None = None) -> ImportResult:
        """Replace the whole table with the deduplicated batch, ids from 1, no favourites."""
        now, buckets = now or utc_now(), self.buckets()
        batch = self._stable(U.dedup_last(batch).select(*U.RECORD_COLUMNS, *U.ORDER_COLUMNS).withColumn("is_stored", F.lit(False)))
        n = batch.count()
        rows = U.plan_new(batch, F.lit(now).cast("timestamp_ntz"), 0)
        staged = self._checked(self._bucketed(rows, buckets), n, (0, n))
        gen = time.time_ns()
        self._write(staged, "overwrite", dynamic=False, folder=self._folder(gen))
        self._announce(gen, staged.limit(0), staged, list(range(buckets)))
        self._reserve("overwrite", n, n, buckets, gen)  # readers see the new rows from here on
        self._done(gen, n, buckets)
        return ImportResult(n, 0, 0, 0)

    def vacuum(self) -> list[str]:
        """Delete the rows of earlier generations; returns their folders. No reader may be using them."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        current = self.table_root.rsplit("/", 1)[1]
        old = [s.getPath() for s in fs.listStatus(path) if s.isDirectory()
               and s.getPath().getName().split("-")[0] == "messages" and s.getPath().getName() != current]
        for p in old:
            fs.delete(p, True)
        return [p.getName() for p in old]

    def record_files(self, files: DataFrame) -> None:
        """Add loaded files (file_path, file_mtime, length, lines, checksum) to the manifest."""
        rows = files.select("file_path", "file_mtime", "length", "lines", "checksum", F.lit(time.time_ns()).alias("seq"))
        rows.write.mode("append").parquet(f"{self.root}/files")

    def set_favorites(self, changes: DataFrame) -> None:
        """Apply ``changes(id, fav)``: one appended row per known id; unknown ids change nothing."""
        one = changes.groupBy("id").agg(F.max("fav").alias("fav"))
        known = self.read().select("id", "uuid").join(one, "id").select("uuid", "fav", F.lit(time.time_ns()).alias("seq"))
        known.write.mode("append").parquet(f"{self.root}/favorites")

    def mark_favorite(self, ids, flag: bool = True) -> None:
        self.set_favorites(fav_ops.change_set(self.spark, ids, flag))

    # -- indexes -------------------------------------------------------------
    def trigrams(self, path: str) -> trigram.TrigramIndex:
        """The trigram index at ``path``; ``refresh()`` it after writes (a search is right at any time)."""
        return trigram.TrigramIndex(self.spark, path, self.table_root)

    def bounds(self, path: str) -> zones.FileBounds:
        """The projects and times of each file, at ``path``; refreshed like the trigram index."""
        return zones.FileBounds(self.spark, path, self.table_root)

    def search(self, q: search_ops.SearchQuery, trigrams: str | None = None, index: bm25.TextIndex | None = None,
               anchor: dt.datetime | None = None, bounds: str | None = None) -> DataFrame:
        """:func:`search.search` over the stored messages; with a trigram index or file bounds only files that may match are opened."""
        files = None if trigrams is None else self.trigrams(trigrams).files(q.keywords, q.mode, q.regex)
        if bounds is not None:
            near = self.bounds(bounds).files(q, anchor)
            files = near if files is None else files.join(near, "file_path", "left_semi")
        return search_ops.search(self.messages(files), q, index=index, anchor=anchor)

    def _documents(self, rows: DataFrame) -> DataFrame:
        """Texts to index; a message is indexed again when its uuid or load time changes."""
        version = F.concat_ws("@", F.col("uuid"), F.col("updated_at").cast("string"))
        return rows.select("id", version.alias("version"), validate.content_text(F.col("message_content")).alias("message_content"))

    def _changes(self) -> DataFrame:
        return self._read(f"{self.root}/changes", CHANGE_SCHEMA)

    def _last_change(self) -> int:
        return max(self._changes().agg(F.max("seq")).first()[0] or 0, self._state()["gen"])

    def build_index(self, path: str) -> None:
        """Build and persist the full-text index over the stored messages' text."""
        feed = self._last_change()
        bm25.write_index(self._documents(self.read()), path, feed=feed)

    def refresh_index(self, path: str) -> None:
        """Bring a persisted index up to the table, from the changes since its last refresh.

        Only the buckets with changed rows are read. After a full re-import all ids and versions are compared.
        """
        since, last = bm25.newest(self.spark, path)["feed"], self._last_change()
        if self._state()["gen"] > since:
            return bm25.refresh_index(self.spark, self._documents(self.read()), path, feed=last)
        ids = self._stable(self._changes().where(F.col("seq") > since).select("id", PARTITION).distinct())
        wanted = [r[0] for r in ids.select(PARTITION).distinct().collect()]  # at most the number of buckets
        if wanted:
            rows = self.read().where(F.col(PARTITION).isin(wanted)).join(ids.select("id"), "id", "left_semi")
            bm25.apply_changes(self.spark, path, self._documents(rows), ids.select("id"), feed=last)

    def project_summary(self) -> DataFrame:
        """(project_path, n, last_update), merged from the numbers that each job left; the messages are not read.

        Of a bucket the newest job that wrote it whole counts, and those that added to it since. Buckets of a job
        that did not end are counted again.
        """
        gen, log = self._state()["gen"], self._log()
        states = self._read(f"{self.root}/states", STATE_SCHEMA).where(F.col("seq") >= gen)
        done = log.where("kind = 'done'").select("seq").distinct()
        open_buckets = [r[0] for r in states.join(done, "seq", "left_anti").select(PARTITION).distinct().collect()]  # at most the number of buckets
        good = states.where(~F.col(PARTITION).isin(open_buckets))
        since = good.where("whole").groupBy(F.col(PARTITION).alias("_b")).agg(F.max("seq").alias("_since"))
        good = (good.join(F.broadcast(since), F.col(PARTITION) == F.col("_b"), "left")  # a row per bucket
                .where(F.col("seq") >= F.coalesce("_since", F.lit(0))).select("project_path", "n", "last"))
        if open_buckets:
            good = good.unionByName(self.read().where(F.col(PARTITION).isin(open_buckets)).groupBy("project_path").agg(
                F.count(F.lit(1)).alias("n"), F.max("timestamp").alias("last")))
        return good.groupBy("project_path").agg(F.sum("n").alias("n"), F.max("last").alias("last_update"))

    def import_stats(self, parsed: DataFrame) -> ImportResult:
        """Counts for a batch against the current table (call before writing it)."""
        r = U.import_stats(parsed, self.read()).first()
        return ImportResult(r["inserted"], r["updated"], r["skipped"], r["errors"])


def last_update_time(store: MessageStore, project: str) -> dt.datetime | None:
    """Newest message time of one project (None when it has no rows)."""
    r = store.project_summary().where(F.col("project_path") == project).first()
    return r["last_update"] if r else None


__all__ = ["MessageStore", "ImportResult", "WriteMismatch", "PARTITION", "last_update_time", "validate"]
