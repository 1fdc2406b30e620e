"""Every query against its brute-force version, on hard texts, the small test table and empty tables."""

import brute
import pytest

from logscope.llm import queries as Q
from logscope.llm.common import table

SMALL = "/root/testdata/sf0.001"
BRUTE = {
    "op1_substring_dedup": brute.op1,
    "op2_secret_scan": brute.op2,
    "op3_suffix_dedup": brute.op3,
    "op5_quality_rules": brute.op5,
    "op6_sharding": brute.op6,
    "op7_superminhash": brute.op7,
    "op8_pii": brute.op8,
    "op10_bpe": lambda rows: brute.op10(rows, Q.vocabulary()),
}


def documents(spark, folder):
    return [(r["doc_id"], r["text"]) for r in table(spark, folder, "documents").select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", list(BRUTE))
def test_hard_texts(spark, sf_dir, name):
    want = sorted(BRUTE[name](documents(spark, sf_dir)))
    got = sorted(tuple(r)[:len(want[0])] for r in Q.QUERIES[name](spark, sf_dir).collect())
    assert got == want


@pytest.mark.parametrize("name", list(BRUTE))
def test_small_table(spark, name):
    want = sorted(BRUTE[name](documents(spark, SMALL)))
    got = sorted(tuple(r)[:len(want[0])] for r in Q.QUERIES[name](spark, SMALL).collect())
    assert got == want


FIRST_COLUMN = {"op11_source_divergence": "lang", "op12_chat_format": "conv_id", "op13_spelling_variants": "word"}


@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_empty_tables(spark, empty_dir, name):
    """No rows; the chat query adds one conversation of its own."""
    df = Q.QUERIES[name](spark, empty_dir)
    assert df.count() == (name == "op12_chat_format") and df.columns[0] == FIRST_COLUMN.get(name, "doc_id")


def test_suffix_hot_anchors(spark, sf_dir):
    """The exchange of windows around very common anchors gives the same result."""
    from pyspark.sql import functions as F

    from logscope.llm import suffix
    docs = documents(spark, sf_dir)
    want = sorted((d, n, gone, spans) for d, n, gone, spans, _ in brute.op3(docs))
    for chunk_bytes in (1 << 11, 1 << 20):
        suffix.Chunked.__init__.__defaults__ = ("doc_id", "text", chunk_bytes)
        try:
            got = suffix.remove_repeats(table(spark, sf_dir, "documents"), hot_chunks=2).select(
                "doc_id", "n_bytes", F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)"), F.size("spans")).collect()
        finally:
            suffix.Chunked.__init__.__defaults__ = ("doc_id", "text", 4 << 20)
        assert sorted(map(tuple, got)) == want


def test_shards_are_even(spark):
    import collections
    rows = Q.op6_sharding(spark, SMALL).collect()
    size, slots = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    biggest = max(r["size"] for r in rows)
    assert set(size) == set(range(16)) and max(size.values()) - min(size.values()) <= 2 * biggest
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_null_and_repeated_ids(spark, workdir):
    """Every row comes back once, whatever its id; equal rows get equal results where order plays no part."""
    long = " ".join(f"word{k}" for k in range(300))
    rows = [(None, long), (None, None), (7, long), (7, long), (7, long + " other"), (7, None), (8, "short"), (8, "short"), (9, long[:900])]
    spark.createDataFrame([(d, t, None, "s", 0) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{workdir}/documents.parquet")
    spark.createDataFrame([(None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{workdir}/labels.parquet")
    spark.createDataFrame([(None, None), (1, long[:200])], "item_id long, text string").write.parquet(f"{workdir}/benchmark.parquet")
    key = lambda d: (d is not None, d or 0)
    for name, query in Q.QUERIES.items():
        if name in FIRST_COLUMN:  # groups, conversations and words: no row for a document
            continue
        got = query(spark, workdir).collect()
        if name == "op4_decontamination":
            assert sorted((r["doc_id"] for r in got), key=key) == [None, 7, 7, 7, 9] and {r["item_id"] for r in got} == {1}
            continue
        assert sorted((r["doc_id"] for r in got), key=key) == sorted((d for d, _ in rows), key=key), name
        if name in BRUTE and name not in ("op1_substring_dedup", "op3_suffix_dedup", "op7_superminhash"):
            want = BRUTE[name](rows)
            assert sorted((tuple(r)[:len(want[0])] for r in got), key=repr) == sorted(want, key=repr), name
    assert {(r["doc_id"], r["component_id"]) for r in Q.QUERIES["op7_superminhash"](spark, workdir).collect()} == {(None, None), (7, 7), (8, 8), (9, 9)}
