"""Favourite flags: mark / unmark by id, as a change set joined to the rows."""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def change_set(spark: SparkSession, ids: Iterable[int] | DataFrame, flag: bool) -> DataFrame:
    """(id, fav) from a list of ids, or from a DataFrame with a column ``id`` for large sets."""
    if isinstance(ids, DataFrame):
        return ids.select(F.col("id").cast("long").alias("id"), F.lit(flag).alias("fav"))
    return spark.createDataFrame([(int(i), flag) for i in ids], "id long, fav boolean")


def apply_favorites(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """``changes(id, fav)`` sets ``is_favorite`` of matching ids; unknown ids change nothing.

    When an id appears more than once in the change set the flag ``true`` wins.
    """
    c = changes.groupBy("id").agg(F.max("fav").alias("_fav"))
    cols = [F.coalesce(F.col("_fav"), F.col("is_favorite")).alias("is_favorite") if n == "is_favorite" else F.col(n)
            for n in rows.columns]
    return rows.join(c, "id", "left").select(*cols)
