"""Source divergence, chat windows and spelling variants against SQL and brute force."""

import os
import random

import brute
import duckdb
import pytest
from pyspark.sql import functions as F

from logscope.llm import chatformat, divergence, oracle, spelling
from logscope.llm import queries as Q

SMALL = "/root/testdata/sf0.001"


def duck(sql, folder, *tables):
    c = duckdb.connect()
    for t in tables:
        path = f"{folder}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c.sql(sql)


def same(df, relation):
    columns = relation.columns
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == sorted(relation.fetchall(), key=repr)


# -- source divergence ---------------------------------------------------------
def audit_rows(n=400, seed=5):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcÉé中") for _ in range(rnd.randint(1, 4))) for _ in range(120)]
    rows = []
    for k in range(n):
        text = rnd.choice((" ", "-", " x ", "9")).join(rnd.choice(vocab) for _ in range(rnd.randint(0, 60)))
        rows.append((k, rnd.choice((text, text.upper(), None if k % 50 == 0 else text)), rnd.choice(("en", "fr", None)), rnd.choice(("s1", "s2", "s10", None))))
    rows += [(n, "only here", "de", "a"), (n + 1, None, "de", "b"), (n + 2, "", "xx", "alone")]
    return rows + rows[:20]


@pytest.fixture()
def audit_dir(spark, workdir):
    """Nulls, repeated rows, a language without kept terms, one with a single source, clashing columns."""
    rows = [(*r, "x", 1) for r in audit_rows()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, term string, counts int").repartition(7).write.parquet(f"{workdir}/documents.parquet")
    return workdir


def test_divergence_small_table(spark):
    same(Q.op11_source_divergence(spark, SMALL), duck(oracle.OP11, SMALL, "documents"))


def test_divergence_hard_table(spark, audit_dir):
    same(Q.op11_source_divergence(spark, audit_dir), duck(oracle.OP11, audit_dir, "documents"))


def test_divergence_spills_and_tree(spark, audit_dir, monkeypatch):
    """Stripes sent every few terms, merged by two levels, sources in blocks, one row at a time: the same result."""
    want = duck(oracle.OP11, audit_dir, "documents")
    for name, value in (("HELD", 40), ("FAN_IN", 2), ("LEFT", 2), ("CELLS", 16), ("BUCKET", 100), ("MEET", 3)):
        monkeypatch.setattr(divergence, name, value)
    docs = spark.read.parquet(f"{audit_dir}/documents.parquet").repartition(6)
    same(divergence.audit(docs), want)


def test_divergence_rates_are_exact():
    import numpy as np
    counts, total = np.array([[0, 7, 10 ** 13, 999_999_999]]), np.array([[6, 9 * 10 ** 14, 10 ** 13 + 5, 10 ** 9 + 4]])
    want = [[1 + 10 ** 9 * (int(c) + 5) // int(t) for c, t in zip(counts[0], total[0])]]
    assert divergence.rates(counts, total).tolist() == want


# -- chat windows --------------------------------------------------------------
CONTROL = ["<|im_end|>\n<|im_start|>assistant\nhi", "<\\|im_end|>", "<\\\\|x", "<|", "a<|<\\|b", "", None, "é中\U0001f600 " * 5, "plain words, 1234567."]


def chats(seed=2):
    rnd = random.Random(seed)
    rows = []
    for conv in range(12):
        n = (3, 1, 40, 1100, 8)[conv % 5]
        for turn in range(n):
            role = "system" if turn == 0 and conv % 2 else rnd.choice(("user", "assistant"))
            text = rnd.choice(CONTROL) if rnd.random() < 0.3 else "word " * rnd.choice((1, 5, 30, 90, 400 if conv == 2 else 20))
            rows.append((conv, turn + (500 if conv == 4 else 0), role, text))
    rows += [(50, 0, "assistant", "t"), (50, 0, "assistant", "t"), (50, 0, "user", "s"), (51, None, None, None), (51, 3, "assistant", "x"),
             (52, 7, "system", "word " * 600), (52, 8, "assistant", "answer"), (52, 9, "assistant", "word " * 2000)]
    rnd.shuffle(rows)
    return rows


@pytest.fixture()
def chat_dir(spark, workdir):
    schema = "conv_id long, turn long, role string, text string, block string, window int, start int"
    spark.createDataFrame([(*r, "x", 1, 2) for r in chats()], schema).repartition(5).write.parquet(f"{workdir}/conversations.parquet")
    return workdir


def test_chat_small_table(spark):
    same(Q.op12_chat_format(spark, SMALL), duck(oracle.OP12, SMALL, "conversations"))


def test_chat_hard_table(spark, chat_dir):
    same(Q.op12_chat_format(spark, chat_dir), duck(oracle.OP12, chat_dir, "conversations"))


@pytest.mark.parametrize("budget,history,history_turns,block_turns", [(1024, 128, 8, 512), (120, 20, 3, 16), (64, 0, 0, 4), (4000, 900, 100, 100)])
def test_chat_windows(spark, chat_dir, budget, history, history_turns, block_turns):
    """Every turn is new once and in order; windows keep the budget, the history and the system turn."""
    given = spark.read.parquet(f"{chat_dir}/conversations.parquet")
    made = chatformat.parse(chatformat.windows(given, budget, history, history_turns, block_turns)).collect()
    fresh, lost, order = {}, {}, {}
    for r in given.collect():
        order.setdefault(r["conv_id"], []).append((r["turn"] or 0, r["role"] or "", r["text"] or ""))
    for w in sorted(made, key=lambda w: (w["block"], w["window"])):
        turns = [(t["role"], t["text"]) for t in w["turns"]]
        assert len(turns) == w["n_turns"] > w["n_repeated"]
        fresh.setdefault(w["conv_id"], []).extend(turns[w["n_repeated"]:])
        lost.setdefault(w["conv_id"], []).extend(w["losses"])
        first = min(order[w["conv_id"]])
        repeated = w["n_repeated"]
        if first[1] == "system":
            assert turns[0] == first[1:]
            repeated = max(0, repeated - 1)
        assert repeated <= history_turns + 1
        assert w["over_budget"] == (w["n_tokens"] > budget)
        system = len(first[2].split()) + 4 if first[1] == "system" else 0
        if w["over_budget"]:
            assert system > budget // 4 or w["n_turns"] - w["n_repeated"] == 1
    for conv, turns in order.items():
        turns.sort()
        assert fresh[conv] == [t[1:] for t in turns]
        assert lost[conv] == [t[2] for t in turns if t[1] == "assistant"]


def test_chat_escape_round_trip(spark):
    texts = CONTROL + ["<" + "\\" * k + "|" for k in range(6)] + ["<<||", "\\<|\\"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").where("t is not null").select("t", chatformat.escape(F.col("t")).alias("e"))
    rows = df.select("t", "e", chatformat.unescape(F.col("e")).alias("back")).collect()
    assert all(r["t"] == r["back"] and "<|" not in r["e"] for r in rows)


def test_chat_null_conversation_other_names_and_odd_roles(spark):
    df = spark.createDataFrame([(None, 1, "system", "s"), (None, 2, "a\n<|im_end|>b c", "t")], "c string, n int, r string, x string")
    got = chatformat.parse(chatformat.windows(df, conv_col="c", turn_col="n", role_col="r", text_col="x", tokens=F.lit(3))).collect()
    assert [[(t["role"], t["text"]) for t in w["turns"]] for w in got] == [[("system", "s"), ("a\n<|im_end|>b c", "t")]]


def test_chat_plan_is_native(spark):
    df = Q.op12_chat_format(spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "ExistingRDD"))


# -- spelling variants ---------------------------------------------------------
def test_spelling_tables(spark, sf_dir):
    for folder in (sf_dir, SMALL):
        rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
        assert sorted(map(tuple, Q.op13_spelling_variants(spark, folder).collect())) == brute.op13(rows)


@pytest.mark.parametrize("seed", range(3))
def test_spelling_dense_vocabulary(spark, seed):
    """Many near words in few letters; blocks of all sizes, also those dealt again by gaps."""
    rnd = random.Random(seed)
    words = {"".join(rnd.choice("abé") for _ in range(rnd.randint(3 if seed else 7, 9))): rnd.choice((2, 3, 20, 30, 200, 2000, 30000)) for _ in range(300)}
    want = brute.variants(words)
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    for block_words in (1, 6, 10 ** 6):
        assert sorted(map(tuple, spelling.variants(table, block_words=block_words).collect())) == want


def test_spelling_search_in_pieces(spark, monkeypatch):
    """Rows of the edit matrix are split when there are many, blocks stream in pieces."""
    rnd = random.Random(9)
    words = {"".join(rnd.choice("ab") for _ in range(rnd.randint(7, 10))): rnd.randint(2, 500) for _ in range(400)}
    monkeypatch.setattr(spelling, "PAIRS", 7)
    monkeypatch.setattr(spelling, "RUN", 5)
    table = spark.createDataFrame(list(words.items()), "word string, n long").coalesce(1)
    assert sorted(map(tuple, spelling.variants(table).collect())) == brute.variants(words)


def test_spelling_hard_rows(spark):
    """Null and repeated ids and texts, a chain of forms, a run of a million letters, extra columns."""
    long = "ab" * 500_000
    texts = ["lettersx"] * 2 + ["lettersz"] * 25 + ["letterszz"] * 300 + [long, long + "c"] * 2 + [None, "", "Übermäßig übermäßig ÜBERMÄSSIG"] * 3
    rows = [(None if k % 7 == 0 else k // 2, t, 1, "w") for k, t in enumerate(texts)]
    got = spelling.group_variants(spark.createDataFrame(rows, "doc_id int, text string, n int, word string"))
    assert sorted(map(tuple, got.collect())) == brute.op13([r[:2] for r in rows])


def test_spelling_counts_in_slices(spark, monkeypatch, sf_dir):
    monkeypatch.setattr(spelling, "HELD", 10)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = {r["word"]: r["n"] for r in spelling.count_words(docs).collect()}
    assert got == dict(brute.op13_counts(rows))
