import json

import pytest
from pyspark.sql import functions as F

from helpers import record, write_file
from logscope.operators import lines as line_ops
from logscope.operators import validate
from logscope.sources.jsonl import read_lines


def parse(spark, root):
    lines = read_lines(spark, root)
    return lines, validate.parse_lines(lines)


def test_three_line_session(spark, workdir):
    write_file(f"{workdir}/p/s.jsonl", [record("uuid1"), record("uuid2", "uuid1"), record("uuid3", "uuid2")])
    _, parsed = parse(spark, workdir)
    rows = validate.valid_records(parsed).orderBy("pos").collect()
    assert [r.uuid for r in rows] == ["uuid1", "uuid2", "uuid3"]
    assert [r.parent_uuid for r in rows] == [None, "uuid1", "uuid2"]
    assert rows[0].project_path == "p"
    assert rows[0].message_content == '"An opening line"'


def test_broken_line_skip_and_fail_fast(spark, workdir):
    write_file(f"{workdir}/p/s.jsonl", [record("a"), "{invalid json line}", record("b")])
    lines, parsed = parse(spark, workdir)
    assert validate.valid_records(parsed).count() == 2
    bad = line_ops.with_line_numbers(validate.quarantine(parsed), lines).collect()
    assert [(b.line_no, b.error) for b in bad] == [(2, "invalid JSON")]
    with pytest.raises(Exception):
        validate.fail_fast(parsed).collect()


def test_blank_lines_are_counted(spark, workdir):
    write_file(f"{workdir}/p/s.jsonl", ["", record("a"), "   ", "\t", record("b"), "{bad"])
    lines, parsed = parse(spark, workdir)
    assert validate.valid_records(parsed).count() == 2
    bad = line_ops.with_line_numbers(validate.quarantine(parsed), lines).collect()
    assert [b.line_no for b in bad] == [6]


@pytest.mark.parametrize("line, reason", [
    (record(uuid=5), "invalid type for `uuid`: expected string"),
    (json.dumps({k: v for k, v in json.loads(record()).items() if k != "uuid"}), "missing field `uuid`"),
    (record(isSidechain="no"), "invalid type for `isSidechain`: expected boolean"),
    (record(ts="2025-07-21T12:48:30"), "invalid timestamp"),
    (record(ts="2025-07-21"), "invalid timestamp"),
    (record(message="text"), "invalid type for `message`: expected object"),
    (record(gitBranch=3), "invalid type for `gitBranch`: expected string or null"),
    ('{"uuid": "a", "uuid": "b"}', "duplicate field `uuid`"),
    (record()[:-1] + ', "cwd": "/x"}', "duplicate field `cwd`"),
    ("[1, 2]", "expected a JSON object"),
])
def test_strictness(spark, workdir, line, reason):
    write_file(f"{workdir}/p/s.jsonl", [line])
    _, parsed = parse(spark, workdir)
    bad = validate.quarantine(parsed).collect()
    assert [b.error for b in bad] == [reason]


@pytest.mark.parametrize("content, stored", [
    (None, None), ("plain", '"plain"'), ([{"type": "text", "text": "hi"}], '[{"text":"hi","type":"text"}]'),
    ({"b": 1, "a": [True, None]}, '{"a":[true,null],"b":1}'),
])
def test_content_json(spark, workdir, content, stored):
    write_file(f"{workdir}/p/s.jsonl", [record(content=content)])
    _, parsed = parse(spark, workdir)
    assert validate.valid_records(parsed).first().message_content == stored


def test_offsets_crlf_and_unknown_fields(spark, workdir):
    write_file(f"{workdir}/p/s.jsonl", [record("a", ts="2025-07-21T21:48:30+09:00", extra={"x": 1})], newline="\r\n")
    _, parsed = parse(spark, workdir)
    r = validate.valid_records(parsed).first()
    assert r.uuid == "a" and str(r.timestamp) == "2025-07-21 12:48:30"


def test_line_numbers_across_splits(spark, workdir):
    n = 400
    body = [record(f"u{i}", content="x" * 50) if i % 37 else "{bad" for i in range(n)]
    write_file(f"{workdir}/p/big.jsonl", body)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines, parsed = parse(spark, workdir)
        assert lines.select("block_start").distinct().count() > 10
        got = sorted(r.line_no for r in line_ops.with_line_numbers(validate.quarantine(parsed), lines).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [i + 1 for i in range(n) if i % 37 == 0]


def test_content_text(spark):
    df = spark.createDataFrame([('"a b"',), ('[{"type":"text","text":"x"},{"type":"tool_use"},{"type":"text","text":"y"}]',), (None,)], "c string")
    got = [r[0] for r in df.select(validate.content_text(F.col("c"))).collect()]
    assert got == ["a b", "x\ny", None]


def test_repeated_unknown_and_content_keys_are_accepted(spark, workdir):
    line = record("a", content={"k": 1})[:-1] + ', "extra": 1, "extra": 2}'
    write_file(f"{workdir}/p/s.jsonl", [line.replace('"k": 1', '"k": 1, "k": 2')])
    _, parsed = parse(spark, workdir)
    assert [(r.uuid, r.message_content) for r in validate.valid_records(parsed).collect()] == [("a", '{"k":2}')]


def test_utf8_is_checked_on_bytes(spark, workdir):
    """U+FFFD is a character like any other; bytes that are not UTF-8 are rejected, and nothing is stored with replacements."""
    import os
    from logscope.sources.jsonl import read_lines
    os.makedirs(f"{workdir}/p")
    good, bad = record("a", content="abc\ufffddef"), record("b", content="abc#def")
    with open(f"{workdir}/p/x.jsonl", "wb") as f:
        f.write(good.encode() + b"\n")
        for raw in (b"\xff", b"\xed\xa0\x80", b"\xc3", b"\xf8\x88\x80\x80\x80"):
            f.write(bad.encode().replace(b"#", raw) + b"\n")
        f.write(record("c", content="é中").encode() + b"\n")
    parsed = validate.parse_lines(read_lines(spark, workdir)).cache()
    assert {r.uuid: r.message_content for r in validate.valid_records(parsed).collect()} == {"a": '"abc\ufffddef"', "c": '"é中"'}
    rejected = validate.quarantine(parsed).collect()
    assert [r.error for r in rejected] == ["invalid UTF-8"] * 4 and all("\ufffd" in r.raw for r in rejected)
