"""File bounds: a project-and-date filter opens only the files that hold such rows.

Rows of a project lie in all buckets of a store, since a bucket is a hash of the uuid; inside a bucket they are
written in ranges of (project, time). This table keeps, for each file and each project in it, the first and
last time: ``zones(file_id, project_path, low, high)``. A filter is answered from it, and the scan prunes
the other files by a bitmap of the answer, so their footers are not even read. A file without bounds yet
is always read; one that is gone is ignored. A refresh looks at new files alone.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logscope.operators import trigram
from logscope.operators.search import SearchQuery, apply_filters
from logscope.sources.jsonl import decoded_path

ZONE_SCHEMA = "file_id long, project_path string, low timestamp_ntz, high timestamp_ntz"


@dataclass(frozen=True)
class FileBounds:
    """The bounds at ``path`` of the Parquet table in ``folder``."""
    spark: SparkSession
    path: str
    folder: str

    def zones(self) -> DataFrame:
        return trigram._read(self.spark, self.path, ZONE_SCHEMA)

    def refresh(self) -> None:
        """Add the files that are new since the last call: two columns of them are read."""
        from logscope.operators.upsert import materialised
        new = materialised(trigram.table_files(self.spark, self.folder).join(self.zones().select("file_id").distinct(), "file_id", "left_anti"))
        if new.isEmpty():
            return
        rows = trigram.read_files(self.spark.read.parquet(self.folder), new)
        (rows.groupBy(trigram.file_id(decoded_path(F.col("_metadata.file_path"))).alias("file_id"), "project_path")
         .agg(F.min("timestamp").alias("low"), F.max("timestamp").alias("high"))
         .join(new.select("file_id"), "file_id", "left_semi")
         .repartitionByRange("project_path", "low").sortWithinPartitions("project_path", "low").write.mode("append").parquet(self.path))

    def files(self, q: SearchQuery, anchor: dt.datetime | None = None) -> DataFrame:
        """(file_path) of the files that may hold rows of the query's projects and dates.

        A zone meets the dates if its last time passes the lower bound and its first time the upper one.
        """
        none = dict(favorites_only=None, date_from=None, date_to=None)
        zones = self.zones()
        fits = apply_filters(zones, SearchQuery(**{**vars(q), **none}), anchor)
        for name, bound in (("high", {"date_from": q.date_from}), ("low", {"date_to": q.date_to})):
            one = SearchQuery(**bound)
            fits = apply_filters(fits.withColumn("timestamp", F.col(name)), one, anchor).drop("timestamp")
        useless = zones.select("file_id").distinct().join(fits.select("file_id").distinct(), "file_id", "left_anti")
        return trigram.table_files(self.spark, self.folder).join(useless, "file_id", "left_anti").select("file_path")
