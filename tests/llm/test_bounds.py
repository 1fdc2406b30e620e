"""Long runs take linear time, slices of languages change nothing."""

import random
import re
import time

import numpy as np
import pytest

from logscope.llm import langid, pii

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("run", ["7", " ", "a", "\n", "a.", "1.", "1 ", "@", "a@", "a@b", "@a", "a@b.c", "+1 ", " at ", "a at b dot ", "[", "[ ", "( at", "plus "])
def test_long_runs_take_linear_time(run):
    """1 MB of one thing, alone and after a disguise that sends the text through all transducers."""
    for lead in ("", "one two three four five ", "name [at] host dot org, "):
        text = (lead + run * ((1 << 20) // len(run))).encode()
        start = time.process_time()
        pii.find_in(text)
        assert time.process_time() - start < 20


def test_addresses_equal_the_plain_pattern():
    plain = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip, old_ip = pii.IP, re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    old = re.compile(r"\s*" + pii.BRACKETED.pattern, re.I)
    rnd = random.Random(3)
    for _ in range(20_000):
        text = "".join(rnd.choice("a@.-_ 1@.é") for _ in range(rnd.randint(0, 24)))
        assert list(pii.emails(text)) == [m.span() for m in plain.finditer(text)]
        text = "".join(rnd.choice("12..a") for _ in range(rnd.randint(0, 24)))
        assert [m.span() for m in ip.finditer(text) if m[1]] == [m.span() for m in old_ip.finditer(text)]
        text = "".join(rnd.choice((" ", "[", "at", "]", "@", "(", ")", "x")) for _ in range(rnd.randint(0, 14)))
        assert [s[:2] for s in pii.bracketed(text)] == [m.span() for m in old.finditer(text)]


def test_language_slices_change_nothing(spark):
    """All languages are learned; a slice for each of them gives what one slice for all gives."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    one, many = langid.fit(docs), langid.fit(docs, model_bytes=1)
    assert len(one) == 1 and len(many) == 4 == len(one[0].names)
    want = {r["doc_id"]: r for r in langid.identify(docs, one).collect()}
    got = {r["doc_id"]: r for r in langid.identify(docs, many).collect()}
    assert got.keys() == want.keys()
    for k, r in want.items():
        assert (got[k]["lang_pred"], got[k]["held_out"]) == (r["lang_pred"], r["held_out"])
        assert np.isclose(got[k]["score"], r["score"], rtol=1e-6) and (r["bits_per_byte"] is None or np.isclose(got[k]["bits_per_byte"], r["bits_per_byte"], rtol=1e-5))


def test_more_languages_than_a_slice_holds(spark):
    rnd = random.Random(1)
    letters = {f"l{k:03d}": [chr(0x100 + 4 * k + j) for j in range(4)] for k in range(90)}
    rows = [(k * 10 + d, "".join(rnd.choice(abc) for _ in range(40)), name) for k, (name, abc) in enumerate(letters.items()) for d in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = langid.fit(docs, model_bytes=4 << 20)
    assert len(models) > 1 and sum(len(m.names) for m in models) == 90
    wrong = langid.identify(docs, models).join(docs.select("doc_id", "lang"), "doc_id").where("lang <> lang_pred").count()
    assert wrong == 0


@pytest.mark.parametrize("shards", [2, 5, 16])
def test_shards_are_the_leaves_of_a_kd_tree(spark, sf_dir, shards):
    """Every node, put together from its leaves, is cut along its widest dimension at the weighted median, by value and then by tie."""
    from logscope.llm import sharding
    for folder in (SMALL, sf_dir):
        docs = spark.read.parquet(f"{folder}/documents.parquet").dropDuplicates(["doc_id"])
        meta = {r["doc_id"]: r for r in sharding.metadata(docs, "doc_id", "text", ["lang", "source", "doc_id"]).collect()}
        rows = [(r["shard"], meta[r["doc_id"]]["dims"], meta[r["doc_id"]]["tie"], r["size"]) for r in sharding.shard(docs, shards=shards).collect()]
        whole = [max(1, max(r[1][d] for r in rows) - min(r[1][d] for r in rows)) for d in range(4)]
        todo = [(0, shards)]
        while todo:
            first, m = todo.pop()
            node = [r for r in rows if first <= r[0] < first + m]
            if m == 1 or not node:
                continue
            middle = first + m // 2
            todo += [(first, m // 2), (middle, m - m // 2)]
            d = max(range(4), key=lambda d: ((max(r[1][d] for r in node) - min(r[1][d] for r in node)) / whole[d], -d))
            left, right = ([(r[1][d], r[2], r[3]) for r in node if (r[0] < middle) == side] for side in (True, False))
            if left and right:
                assert max(left)[:2] < min(right)[:2]
            want = sum(r[3] for r in node) * (m // 2) / m
            assert abs(sum(x[2] for x in left) - want) <= max(r[3] for r in node) + want / 2048


def test_large_buckets_in_several_tasks(spark, sf_dir, monkeypatch):
    """A bucket of near copies dealt over many tasks keeps every link."""
    import brute
    from logscope.llm import neardup
    from logscope.llm import queries as Q
    rnd = random.Random(8)
    base = [f"w{rnd.randint(0, 60)}" for _ in range(60)]
    texts = []
    for _ in range(70):
        t = list(base)
        for _ in range(rnd.randint(0, 5)):
            t[rnd.randrange(len(t))] = f"x{rnd.randint(0, 9999)}"
        texts.append(" ".join(t))
    rows = list(enumerate(texts))
    monkeypatch.setattr(neardup, "SALT_ROWS", 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(tuple(r)[:3] for r in brute.op7(rows))
    assert Q.QUERIES["op7_superminhash"](spark, sf_dir).count() > 0
