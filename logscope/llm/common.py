"""Small helpers shared by the operators: columns, word hashes, offset maps."""

from __future__ import annotations

import ctypes
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logscope.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads, under names of its own; any others are left out."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def id_type(df: DataFrame, col: str = "doc_id") -> str:
    return df.schema[col].dataType.simpleString()


def raw_bytes(column) -> list:
    """An Arrow string column as a list of bytes (None for null)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # several chunks stay when an offset would overflow
        return [x for c in column.chunks for x in raw_bytes(c)]
    wide = pa.types.is_large_string(column.type)
    return column.cast(pa.large_binary() if wide else pa.binary()).to_pylist()


def parts(batches, rows: int = 512):
    """The batches in slices, so that few texts at a time become Python objects; at the end memory goes back to the system."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
    free()


def cut_at_spaces(text: bytes, size: int = 1 << 20):
    """``text`` in pieces of about ``size`` that end at spaces, so that few words at a time become objects."""
    at = 0
    while at < len(text):
        end = text.find(b" ", at + size)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


def free() -> None:
    """Give freed memory back to the system: a Python worker lives on after its task, beside others."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def whole_groups(batches, keys: list, rows: int):
    """Batches sorted by ``keys`` -> tables of about ``rows`` rows that hold whole groups."""
    held: list = []
    count = 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        columns = [table.column(c) for c in keys]
        last = [c[table.num_rows - 1] for c in columns]
        k = bisect_left(range(table.num_rows), True, key=lambda i: [c[i] for c in columns] == last)
        if k:
            yield table.slice(0, k)
        held, count = table.slice(k).to_batches(), table.num_rows - k
    if count:
        yield pa.Table.from_batches(held).combine_chunks()


def group_starts(table: pa.Table, keys: list) -> np.ndarray:
    """Whether a row differs from the one before it in ``keys`` (no nulls)."""
    new = np.ones(table.num_rows, bool)
    for c in keys if table.num_rows else ():
        column = table.column(c).combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)
        differs = pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
        new[1:] = differs if c == keys[0] else new[1:] | differs
    return new


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, computed once for each distinct word seen."""

    MOST = 1 << 17  # distinct words held; the rest are hashed again

    def __missing__(self, word):
        if len(self) >= self.MOST:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def word_hashes(words: list, memo: WordHashes) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser: spreads every input bit over the whole word."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of each run of ``width`` consecutive hashes (order matters)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += hashes[k:k + n]
        out ^= out >> np.uint64(29)
    return mix(out)


class Mapped:
    """A string with, for each character, the source range it stands for."""

    __slots__ = ("text", "start", "end")

    def __init__(self, text: str, start=None, end=None):
        self.text = text
        self.start = np.arange(len(text)) if start is None else start
        self.end = np.arange(1, len(text) + 1) if end is None else end

    def rewrite(self, edits: list) -> "Mapped":
        """Replace [a, b) by a string for each (a, b, string), in order, without overlap."""
        parts, starts, ends, at = [], [], [], 0
        for a, b, new in edits:
            parts += [self.text[at:a], new]
            starts += [self.start[at:a], np.full(len(new), self.start[a])]
            ends += [self.end[at:a], np.full(len(new), self.end[b - 1])]
            at = b
        parts.append(self.text[at:])
        starts.append(self.start[at:])
        ends.append(self.end[at:])
        return Mapped("".join(parts), np.concatenate(starts), np.concatenate(ends))

    def source(self, a: int, b: int) -> tuple:
        return int(self.start[a:b].min()), int(self.end[a:b].max())


def of_kind(kind: str):
    return lambda s: s["kind"] == kind


def span_digest(df: DataFrame, kinds: tuple, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of ``spans array<struct<kind,start,end,base>>``, natively."""
    order = F.array(*[F.lit(k) for k in kinds])
    key = lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("rank"),
                             s["end"].alias("end"), s["kind"].alias("kind"), s["base"].alias("base"))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    d = df.withColumn("_s", F.array_sort(F.transform("spans", key)))
    d = d.withColumn("_b", F.filter("_s", lambda s: s["base"]))
    return d.select(
        id_col,
        *[F.size(F.filter("_b", of_kind(k))).cast("long").alias(f"n_{k}") for k in kinds],
        F.sha2(joined(F.col("_b")), 256).alias("base_sha256"),
        joined(F.col("_s")).alias("spans"),
        F.size("_s").cast("long").alias("n_spans"),
    )
