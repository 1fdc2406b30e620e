"""A trigram index for substring and regular-expression search: files that cannot match are not opened.

For each Parquet file of a table the index holds the distinct runs of three characters of
the lower-cased texts: ``grams(gram, file_id)``, sorted by gram, so a search reads a
few row groups of it. A keyword of three or more characters can only occur in files that hold all its
trigrams; from a regular expression the literal runs that every match must hold
are taken (:func:`regex_runs`). Where nothing follows, all files are read. The search's own predicate still
decides, so the index can only save work, never change a result.

Files are immutable, so the index is never wrong about one: a file that is not indexed yet is
always read, one that is gone is ignored. A refresh indexes the new files alone.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logscope.sources.jsonl import decoded_path, path_filter

WIDTH = 3
MOST_ALTERNATIVES = 64   # of a search; with more, all files are read
GRAM_SCHEMA = "gram string, file_id long"
FILE_SCHEMA = "file_path string, file_id long"


def grams(text: Column) -> Column:
    """The distinct trigrams of the lower-cased text.

    One pass: the expression looks ahead at ``WIDTH`` characters and goes on by one, so its time is in proportion to the text.
    """
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"(?s)(?=(.{{{WIDTH}}}))."), F.lit(1)))


def file_id(path: Column) -> Column:
    """64 bits for a path. Two files that share one would both be read."""
    return F.xxhash64(path)


def table_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file_path, file_id) of the Parquet files below ``folder``; none is opened."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], FILE_SCHEMA)
    path = decoded_path(F.col("path"))
    return files.select(path.alias("file_path"), file_id(path).alias("file_id"))


def _read(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(folder)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


@dataclass(frozen=True)
class TrigramIndex:
    """The index at ``path`` of the Parquet table in ``folder``."""
    spark: SparkSession
    path: str
    folder: str
    text_col: str = "message_content"

    def indexed(self) -> DataFrame:
        return _read(self.spark, f"{self.path}/files", FILE_SCHEMA)

    def refresh(self) -> None:
        """Index the files that are new since the last call (all of them at first).

        Trigrams are made distinct per text and per task before they are shuffled. A file counts as indexed
        once its row is written, after its trigrams; what a failed call left behind is repeated and does no harm.
        """
        from logscope.operators.upsert import materialised
        new = materialised(table_files(self.spark, self.folder).join(self.indexed().select("file_id"), "file_id", "left_anti"))
        if new.isEmpty():
            return
        pairs = self.pairs(read_files(self.spark.read.parquet(self.folder), new))
        (pairs.groupBy("gram", "file_id").agg(F.lit(1)).select("gram", "file_id")
         .repartitionByRange("gram", "file_id").sortWithinPartitions("gram", "file_id").write.mode("append").parquet(f"{self.path}/grams"))
        new.select("file_path", "file_id").write.mode("append").parquet(f"{self.path}/files")

    def pairs(self, rows: DataFrame) -> DataFrame:
        """(file_id, gram) of each text; the file's id is worked out per text, before its trigrams become rows."""
        texts = rows.select(file_id(decoded_path(F.col("_metadata.file_path"))).alias("file_id"), F.col(self.text_col).alias("text"))
        return texts.select("file_id", F.explode(grams(F.col("text"))).alias("gram"))

    def files(self, keywords: Iterable[str] = (), mode: str = "and", regex: str | None = None) -> DataFrame | None:
        """(file_path) of the files that may hold a match, or None where all of them may."""
        wanted = alternatives(self.spark, keywords, mode, regex)
        if wanted is None:
            return None
        listed = sorted({g for a in wanted for g in a})
        have = (_read(self.spark, f"{self.path}/grams", GRAM_SCHEMA).where(F.col("gram").isin(listed))
                .groupBy("file_id").agg(F.collect_set("gram").alias("have")))  # at most the trigrams of the search
        fits = [F.size(F.array_intersect("have", F.array(*[F.lit(g) for g in sorted(a)]))) == len(a) for a in wanted]
        test = fits[0]
        for f in fits[1:]:
            test = test | f
        matching = have.where(test).select("file_id")
        useless = self.indexed().select("file_id").distinct().join(matching, "file_id", "left_anti")
        return table_files(self.spark, self.folder).join(useless, "file_id", "left_anti").select("file_path")


def read_files(table: DataFrame, files: DataFrame | None) -> DataFrame:
    """``table`` (a scan of Parquet files) with the other files pruned before they are opened.

    A file that shares a bit with one of ``files`` may stay; the caller's predicate decides about its rows.
    """
    return table if files is None else table.where(path_filter(files)(decoded_path(F.col("_metadata.file_path"))))


def alternatives(spark: SparkSession, keywords: Iterable[str], mode: str, regex: str | None) -> list[set] | None:
    """Sets of trigrams of which a match holds at least one whole set; None if nothing can be said.

    A keyword test is a substring of the lower-cased text, so its trigrams are those of the lower-cased keyword.
    """
    keywords = [k.lower() for k in keywords]
    found: list[list[str]] = []   # alternatives, each with the runs it needs
    if keywords and mode == "or":
        found = [[k] for k in keywords]
    elif keywords:
        found = [keywords]
    if regex is not None:
        runs = regex_runs(regex)
        if runs is not None:
            found = [a + b for a in found or [[]] for b in runs]
    if not found or len(found) > MOST_ALTERNATIVES:
        return None
    distinct = sorted({r for a in found for r in a})
    rows = spark.createDataFrame([(r,) for r in distinct], "r string").select("r", grams(F.col("r")).alias("g")).collect()
    of = {r["r"]: set(r["g"]) for r in rows}
    sets = [set().union(*(of[r] for r in a)) for a in found]
    return sets if all(sets) else None


# -- literal runs of a regular expression ---------------------------------------
# Characters whose lower case depends on the letters around them, or that equal others when case is ignored.
UNSAFE = set("\u03a3\u03c3\u03c2\u0130\u0131\u017f\u212a")
# Constructs that Java and Python read differently, or that change how the rest is read.
DIFFERENT = re.compile(r"&&|\[\^?\]|\[[^\]]*\[|\(\?[a-z]*[xudUL]|\(\?-")
BREAK = [((), "", "")]


def regex_runs(pattern: str) -> list[list[str]] | None:
    """Alternatives of lower-cased literal runs such that every match holds all runs of one; None if a match may hold none.

    The pattern is read by Python's own parser, which agrees with Java's on the common constructs; a pattern
    that it refuses, or that holds one of the constructs that differ, gives None. Only what must be there
    counts: literals in sequence, in groups, in alternatives, and in what is repeated at least once.
    """
    if DIFFERENT.search(pattern):
        return None
    try:
        tree = re._parser.parse(pattern)  # the standard library's parser
    except (re.error, AttributeError, OverflowError, RecursionError):
        return None
    found = [[r for r in (*done, first, last or "") if len(r) >= WIDTH] for done, first, last in _walk(tree)]
    return found if all(found) else None


def _walk(items) -> list[tuple]:
    """Alternatives (runs inside, run at the beginning, run at the end) of a part of a pattern.

    The run at the end is None where one run spans the whole part, so that neighbours on both sides go on with it.
    """
    states: list[tuple] = [((), "", None)]
    for op, value in items:
        part = _part(str(op), value)
        states = [_joined(a, b) for a in states for b in (part if len(states) * len(part) <= MOST_ALTERNATIVES else BREAK)]
    return states


def _part(name: str, value) -> list[tuple]:
    if name == "LITERAL":
        c = chr(value).lower()
        return BREAK if chr(value) in UNSAFE or len(c) != 1 else [((), c, None)]
    if name == "AT":  # a border has no characters
        return [((), "", None)]
    if name == "SUBPATTERN":
        return _walk(value[-1])
    if name == "ATOMIC_GROUP":
        return _walk(value)
    if name == "BRANCH":
        return [s for branch in value[1] for s in _walk(branch)]
    if name.endswith("_REPEAT") and value[0] >= 1:
        inner = _walk(value[2])
        # The first copy follows what stands before; the last may be another alternative, so nothing goes on from it.
        return inner if value[0] == value[1] == 1 else [(d if e is None else (*d, e), f, "") for d, f, e in inner]
    return BREAK  # a class, any character, something optional, a look-around, a reference


def _joined(a: tuple, b: tuple) -> tuple:
    (done, first, last), (done2, first2, last2) = a, b
    if last is None:
        return (done + done2, first + first2, last2)
    if last2 is None:
        return (done + done2, first, last + first2)
    return (done + (last + first2,) + done2, first, last2)
