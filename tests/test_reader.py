import pytest
from pyspark.errors import AnalysisException

from helpers import files_opened, record, write_file
from logscope.operators.reports import list_projects
from logscope.operators import validate
from logscope.sources.jsonl import read_lines


def test_folder_tree(spark, workdir):
    write_file(f"{workdir}/p/conversation1.jsonl", [record("a")])
    write_file(f"{workdir}/p/conversation2.jsonl", [record("b")])
    write_file(f"{workdir}/p/not_jsonl.txt", [record("c")])
    write_file(f"{workdir}/q/deeper/x.jsonl", [record("d")])
    lines = read_lines(spark, workdir)
    files = {r.file_path.rsplit("/", 1)[1]: r.project_path for r in lines.select("file_path", "project_path").distinct().collect()}
    assert files == {"conversation1.jsonl": "p", "conversation2.jsonl": "p", "x.jsonl": "deeper"}
    got = sorted(r[0] for r in list_projects(validate.valid_records(validate.parse_lines(lines))).collect())
    assert got == ["deeper", "p"]


def test_single_project_prunes_files(spark, workdir):
    write_file(f"{workdir}/p1/a.jsonl", [record("a")])
    write_file(f"{workdir}/p2/b.jsonl", [record("b"), record("c")])
    lines = read_lines(spark, workdir, project="p2")
    assert sorted(r.uuid for r in validate.valid_records(validate.parse_lines(lines)).collect()) == ["b", "c"]


def test_missing_root_raises_and_empty_tree_is_empty(spark, workdir):
    with pytest.raises(AnalysisException):
        read_lines(spark, f"{workdir}/nope").count()
    write_file(f"{workdir}/p/readme.txt", ["x"])
    assert read_lines(spark, workdir).count() == 0


def test_path_with_plus_and_space(spark, workdir):
    write_file(f"{workdir}/a+b c/s.jsonl", [record("a")])
    assert read_lines(spark, workdir).first().project_path == "a+b c"


def test_files_at_root_and_empty_root(spark, workdir):
    import os
    os.makedirs(f"{workdir}/empty")
    assert read_lines(spark, f"{workdir}/empty").count() == 0
    write_file(f"{workdir}/top/x.jsonl", [record("a")])
    write_file(f"{workdir}/top/p/y.jsonl", [record("b")])
    got = sorted((r.file_path.rsplit("/", 1)[1], r.project_path) for r in read_lines(spark, f"{workdir}/top").collect())
    assert got == [("x.jsonl", "top"), ("y.jsonl", "p")]


def test_listed_files_alone_are_opened(spark, workdir):
    """The wanted files stay a DataFrame; the scan opens these and no others, also names a glob would misread."""
    from pyspark.sql import functions as F

    from logscope.sources.jsonl import list_files
    for k in range(40):
        write_file(f"{workdir}/p{k % 5}/f[{k}]*{{a}}.jsonl", [record(f"u{k}")])
    files = list_files(spark, workdir).where(F.col("file_path").rlike(r"f\[(7|23|31)\]"))
    lines = read_lines(spark, workdir, files=files)
    assert sorted(r.uuid for r in validate.valid_records(validate.parse_lines(lines)).select("uuid").collect()) == ["u23", "u31", "u7"]
    lines = read_lines(spark, workdir, files=files)
    lines.collect()
    assert files_opened(lines, "value#") == [3]
    assert read_lines(spark, workdir, files=files.limit(0)).count() == 0


def test_shared_bits_let_no_line_through(spark, workdir):
    """With a bitmap of 8 bits most files share a bit with a wanted one; their lines are dropped."""
    from logscope.sources import jsonl
    for k in range(30):
        write_file(f"{workdir}/p/f{k}.jsonl", [record(f"u{k}")])
    files = jsonl.list_files(spark, workdir).where("file_path like '%f3.jsonl'")
    keep = jsonl.path_filter(files, bits=8)
    listed = jsonl.list_files(spark, workdir)
    assert 1 <= listed.where(keep(listed["file_path"])).count() < 30
    assert read_lines(spark, workdir, files=files).count() == 1
