"""Reports over the message table and an import batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def list_projects(messages: DataFrame) -> DataFrame:
    """Projects that hold at least one message (an empty folder has no rows, so no entry)."""
    return messages.select("project_path").distinct()


def last_update_by_project(messages: DataFrame) -> DataFrame:
    """Newest message time per project (partial + final hash aggregate)."""
    return messages.groupBy("project_path").agg(F.max("timestamp").alias("last_update"))


def import_report(parsed: DataFrame) -> DataFrame:
    """Imported and error line counts per file, per project and in total.

    ``rollup`` adds the project subtotals (file NULL) and the grand total
    (both NULL); ``level`` tells them apart: 0 file, 1 project, 3 total.
    """
    return (parsed.rollup("project_path", "file_path")
            .agg(F.count_if(F.col("error").isNull()).alias("imported"),
                 F.count_if(F.col("error").isNotNull()).alias("errors"),
                 F.grouping_id().alias("level")))


def count_by_project_sql(spark: SparkSession, messages: DataFrame, role: str) -> DataFrame:
    """Ad-hoc SQL with a bound parameter: messages of one role per project."""
    return spark.sql(
        "SELECT project_path, COUNT(*) AS n FROM {m} WHERE message_role = :role GROUP BY project_path",
        args={"role": role}, m=messages)


def run_in_order(spark: SparkSession, statements: list[str]) -> list[DataFrame]:
    """Run SQL statements one after the other; the first error stops the rest (and is raised)."""
    return [spark.sql(statement) for statement in statements]
