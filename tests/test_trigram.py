import random
import re
import time

import pytest
from pyspark.sql import functions as F

from helpers import files_opened, record, write_file
from logscope.operators import search as S
from logscope.operators import trigram as G
from logscope.plans import registry as R
from logscope.plans.importer import import_logs
from logscope.plans.store import MessageStore


@pytest.mark.parametrize("pattern,want", [
    ("[Tt]he [a-z]+ing", [["he ", "ing"]]),
    ("abcdef", [["abcdef"]]),
    ("^Abc$", [["abc"]]),
    ("(abc)def", [["abcdef"]]),
    ("abc|xyz1", [["abc"], ["xyz1"]]),
    ("pre(one|two)post", [["preonepost"], ["pretwopost"]]),
    ("ab(cd)+ef", [["abcd"]]),
    ("(ab|cd){2}xyz", [["xyz"], ["xyz"]]),
    ("(foo|bar)+baz", [["foo", "baz"], ["bar", "baz"]]),
    ("foo.*bar", [["foo", "bar"]]),
    ("fo{3}bar", [["bar"]]),
    ("(?i)ERROR", [["error"]]),
    ("(?:abc)?", None), ("abc|x", None), ("a.b", None), ("", None), ("[abc]+", None), ("\\w+", None),
    ("(?x)a b c", None), ("[a-z&&[def]]abc", None), ("\\Qabc\\E", None), ("\\p{L}abc", None), ("ΣΑΣ", None), ("abc(", None),
    ("(?<=abc)d", None), ("(abc)\\1", [["abc"]]),
])
def test_regex_runs(pattern, want):
    assert G.regex_runs(pattern) == want


def test_regex_runs_are_in_every_match():
    """Random patterns and texts: a text that matches holds all runs of one alternative."""
    rnd = random.Random(4)

    def make(depth):
        kind = rnd.randrange(7 if depth else 2)
        if kind < 2:
            return "".join(rnd.choice("abAB") for _ in range(rnd.randint(1, 3)))
        if kind == 2:
            return make(depth - 1) + make(depth - 1)
        if kind == 3:
            return f"({make(depth - 1)}|{make(depth - 1)})"
        if kind == 4:
            return f"({make(depth - 1)}){rnd.choice(('+', '*', '?', '{2}', '{1,2}', '{0,1}', '+?'))}"
        return rnd.choice((".", "[ab]", "(?:ab)", "^", "b?")) + make(depth - 1)

    told = 0
    for _ in range(3000):
        pattern = make(4)
        runs = G.regex_runs(pattern)
        for _ in range(6):
            text = "".join(rnd.choice("abAB") for _ in range(rnd.randint(0, 14)))
            if runs is not None and re.search(pattern, text):
                told += 1
                assert any(all(r in text.lower() for r in a) for a in runs), (pattern, text, runs)
    assert told > 100


def test_grams_of_a_long_text_take_time_in_proportion(spark):
    """All runs of three characters, whatever the characters; a long text takes one pass."""
    rnd = random.Random(7)
    texts = ["", "ab", "abc", "aaaa", "a\nb\r\nc\u2028d", "x\x00y\x00z", "\U0001f600\U0001f601yz\U0001f602", "o\u0308u\u0308a\u0308",
             "".join(rnd.choice("abcdefgh \n\u00e4\u4e2d\U0001f600") for _ in range(20000))]
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, None])], "id long, t string").select("id", G.grams(F.col("t")).alias("g"))
    began = time.time()
    got = {r.id: r.g for r in df.collect()}
    assert time.time() - began < 20
    assert got.pop(len(texts)) is None
    for k, t in enumerate(texts):
        assert len(got[k]) == len(set(got[k])) and set(got[k]) == {t[i:i + 3] for i in range(len(t) - 2)}, k


TEXTS = ["Segfault in malloc", "all is well", "warning: ÜBER limit", None, "", "ab", "İstanbul ΟΔΟΣ", "x\U0001f600yz", "stack trace of segfaults"]


def folder_of(spark, folder, texts, first=0):
    """A file for each text."""
    rows = [(first + k, t) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "id long, message_content string").repartitionByRange(len(rows), "id").write.mode("append").parquet(folder)


def test_searches_through_the_index_equal_scans(spark, workdir):
    """Keywords and expressions of all lengths, before and after a refresh, with files that are not indexed yet."""
    folder = f"{workdir}/t"
    folder_of(spark, folder, TEXTS)
    index = G.TrigramIndex(spark, f"{workdir}/i", folder)
    for step in range(3):
        if step:
            index.refresh()
        table = spark.read.parquet(folder)
        for keywords, mode, regex in ((["segfault"], "and", None), (["SEGFAULT", "stack"], "and", None), (["malloc", "über"], "or", None),
                                      (["ab"], "and", None), (["malloc", "ab"], "or", None), ([""], "and", None), (["nowhere"], "and", None),
                                      (["οδος"], "and", None), (["i̇st"], "and", None), (["\U0001f600yz"], "and", None),
                                      ([], "and", "[Ss]eg(fault|v)"), ([], "and", "w[ae]ll|limit$"), (["in"], "and", "malloc|well"), ([], "and", ".")):
            def found(df):
                if keywords:
                    df = df.where(S.keyword_predicate(F.col("message_content"), keywords, mode))
                return sorted(r.id for r in (df if regex is None else df.where(F.col("message_content").rlike(regex))).collect())
            files = index.files(keywords, mode, regex)
            assert found(G.read_files(table, files)) == found(table), (step, keywords, regex)
        if step == 1:
            folder_of(spark, folder, ["a new segfault", "other"], 100)


def test_the_file_id_is_worked_out_per_text(spark, workdir):
    """The path is decoded and hashed below the generator of trigrams, not once for each of its rows."""
    folder = f"{workdir}/t"
    folder_of(spark, folder, TEXTS)
    index = G.TrigramIndex(spark, f"{workdir}/i", folder)
    pairs = index.pairs(spark.read.parquet(folder))
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan and "xxhash64" in plan and plan.index("Generate") < plan.index("xxhash64"), plan
    assert pairs.where("gram = 'seg'").select("file_id").distinct().count() == 2
    index.refresh()
    built = spark.read.parquet(f"{workdir}/i/grams").select("file_id", "gram").collect()
    assert sorted(built) == sorted(pairs.distinct().collect())


@pytest.mark.parametrize("name,keywords,mode,regex,want", [
    ("kw_and_indexed", R.KW_RARE, "and", None, {"0-0", "1-0"}), ("kw_or_indexed", R.KW_RARE_OR, "or", None, {"2-1"}),
    ("regex_indexed", (), "and", R.REGEX_RARE, {"0-0", "1-0", "2-1"})])
def test_indexed_queries_on_long_messages(spark, workdir, name, keywords, mode, regex, want):
    """The registered queries on messages of 40,000 characters: the rows of a scan, in time that follows the texts' length."""
    rnd = random.Random(11)
    long = lambda word: " ".join([*("".join(rnd.choice("abcdefgh") for _ in range(7)) for _ in range(5000)), word, "the end"])
    rows = [(0, 0, "user", long("THATTH") + " thatth"), (0, 1, "assistant", long("that")), (1, 0, "user", "the thatth"), (1, 1, "assistant", None),
            (2, 0, "user", long("ment")), (2, 1, "assistant", long("xmentouoix"))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{workdir}/conversations.parquet")
    began = time.time()
    found = R.QUERIES[name](spark, workdir).collect()
    assert time.time() - began < 60
    scanned = S.search(R._msgs(spark, workdir), S.SearchQuery(keywords=keywords, mode=mode, regex=regex, limit=None)).collect()
    assert sorted(found) == sorted(scanned) and {r.uuid for r in found} == want


def test_files_that_cannot_match_are_not_opened(spark, workdir):
    folder = f"{workdir}/t"
    folder_of(spark, folder, [f"text number {k} says {'needle' if k in (3, 17) else 'hay'}" for k in range(20)])
    index = G.TrigramIndex(spark, f"{workdir}/i", folder)
    index.refresh()
    for keywords, mode, regex, opened in ((["NEEDLE"], "and", None, 2), (["needle", "number"], "or", None, 20), ([], "and", "ne+dle [a-z]*|need.e", 2), ([], "and", "[a-z]", 20)):
        files = index.files(keywords, mode, regex)
        df = G.read_files(spark.read.parquet(folder), files)
        df.collect()
        assert files_opened(df, "message_content#") == [opened], (keywords, regex)


def test_store_search_with_trigrams(spark, workdir):
    """Through the store: imports, edits and a refresh; the result is that of a scan, and only some files are read."""
    logs, store, path = f"{workdir}/logs", MessageStore(spark, f"{workdir}/table", buckets=8), f"{workdir}/tri"
    write_file(f"{logs}/p/s.jsonl", [record(f"u{k}", content="a needle here" if k == 5 else f"plain {k}") for k in range(60)])
    import_logs(spark, store, logs)
    store.trigrams(path).refresh()
    q = S.SearchQuery(keywords=["Needle"], limit=None)
    assert [r.uuid for r in store.search(q, trigrams=path).collect()] == ["u5"]
    assert store.trigrams(path).files(["needle"]).count() == 1
    write_file(f"{logs}/p/s.jsonl", [record("u5", content="gone"), record("u7", content="needles")])
    import_logs(spark, store, logs)
    for _ in range(2):
        assert [r.uuid for r in store.search(q, trigrams=path).collect()] == ["u7"]
        store.trigrams(path).refresh()


def test_project_and_date_filters_open_few_files(spark, workdir):
    """Files hold ranges of (project, time); a filter opens those that meet it, and new files are read before a refresh."""
    logs, store, path = f"{workdir}/logs", MessageStore(spark, f"{workdir}/table", buckets=2), f"{workdir}/zones"
    for p in range(4):
        write_file(f"{logs}/proj{p}/s.jsonl", [record(f"u{p}-{k}", ts=f"2031-03-{k % 28 + 1:02d}T00:00:00Z", content="word") for k in range(56)])
    options = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in options}
    try:  # as many files as a large table would have
        for k, v in options.items():
            spark.conf.set(k, v)
        import_logs(spark, store, logs)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    bounds = store.bounds(path)
    total = bounds.files(S.SearchQuery(keywords=["word"])).count()
    bounds.refresh()
    for q, most in ((S.SearchQuery(keywords=["word"], project_filter="proj2", limit=None), total // 2), (S.SearchQuery(keywords=["word"], project_filter="none", limit=None), 0),
                    (S.SearchQuery(keywords=["word"], project_filters=["proj0"], date_to="2031-03-03", limit=None), total // 2),
                    (S.SearchQuery(keywords=["word"], date_from="2032-01-01", limit=None), 0), (S.SearchQuery(keywords=["word"], date_from="2031-03-28", limit=None), total),
                    (S.SearchQuery(keywords=["word"], project_filters=[], project_filter="proj2", limit=None), total)):
        assert bounds.files(q).count() <= most
        got = sorted(r.uuid for r in store.search(q, bounds=path).collect())
        assert got == sorted(r.uuid for r in store.search(q).collect())
    import_logs(spark, store, logs, mode="insert_only")
    write_file(f"{logs}/none/s.jsonl", [record("late", content="word")])
    import_logs(spark, store, logs, mode="insert_only")
    q = S.SearchQuery(keywords=["word"], project_filter="none", limit=None)
    for _ in range(2):
        assert [r.uuid for r in store.search(q, bounds=path).collect()] == ["late"]
        bounds.refresh()
