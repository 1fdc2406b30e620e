import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_helpers import corpus  # noqa: E402


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture()
def sf_dir(spark, rows, workdir):
    """A folder with the tables; documents have extra columns whose names clash with results."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_words string, spans int, chunk string, bucket int"
    data = [(d, t, ("en", "fr", None)[d % 3], f"s{d % 4}", len(t or ""), "x", 1, "c", 2) for d, t in rows]
    spark.createDataFrame(data, schema).repartition(3).write.parquet(f"{workdir}/documents.parquet")
    spark.createDataFrame([(d, k % 2, 0) for k, (d, _) in enumerate(rows)], "doc_id long, quality int, toxic int").write.parquet(f"{workdir}/labels.parquet")
    spark.createDataFrame([(0, "a passage that no document holds at all, of some length")], "item_id long, text string").write.parquet(f"{workdir}/benchmark.parquet")
    return workdir


@pytest.fixture()
def empty_dir(spark, workdir):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{workdir}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{workdir}/labels.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{workdir}/conversations.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{workdir}/benchmark.parquet")
    return workdir
