"""Documents in chunks of neighbouring ids, and an exchange of hash values between chunks and buckets.

The exact-repeat operators and the BPE word table all ask the same kind of
question: which of the values in my part of the corpus occur elsewhere? A row
for each value would shuffle several times the input. Here a chunk sends, for
each bucket (a range of hash values), one sorted and delta-coded list; the
bucket compares the lists of all chunks and answers each chunk with the values
asked for. Documents are shuffled once, compressed, and every pass over the
chunks reuses that exchange.

Chunks are ranges of doc_id holding about ``CHUNK_BYTES`` of text each, so the
order of chunks is the order of ids; buckets hold equal shares of the hash
space. Both counts grow with the data, so the work of one task does not.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logscope.llm.common import free, id_and_text, partitions

CHUNK_BYTES = 4 << 20
GROWTH = 25  # chunks grow with the root of the data (256 MB at 100 TB), or lists of chunk x bucket would get too short
MOST_CUTS = 5000  # chunk borders taken from the ids; between two of them ids are cut evenly
PACK = "chunk int, bucket int, data binary, marks binary"
REPLY = "chunk int, data binary, hot boolean"


class Chunked:
    """``df`` (chunk, blob): the documents, compressed; ``buckets``: how many there are."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES):
        docs = id_and_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
        spark = docs.sparkSession
        self.buckets = partitions(spark)
        total = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
        self.bytes = total["bytes"] or 0
        chunk_bytes = max(chunk_bytes, int(GROWTH * self.bytes ** 0.5))
        n = max(1, min(total["n"], max(self.buckets, -(-self.bytes // chunk_bytes))))
        cuts, parts = [], -(-n // MOST_CUTS)
        if n > 1:
            at = docs.agg(F.percentile_approx("doc_id", [k * parts / n for k in range(-(-n // parts) + 1) if k * parts <= n] + [1.0], 100 * min(n, MOST_CUTS))).first()[0] or []
            cuts = sorted(set(at))
            parts = parts if len(cuts) > 1 else 1
        self.df = docs.mapInArrow(packer(np.array(cuts, np.int64), parts), "chunk int, blob binary").repartition("chunk")

    def send(self, fn, schema: str = PACK) -> DataFrame:
        """fn(chunk, ids, texts) -> pa.Table for each chunk."""
        def run(key, rows):
            out = fn(key[0].as_py(), *unpacked(rows))
            free()
            return out
        return self.df.groupBy("chunk").applyInArrow(run, schema)

    def receive(self, replies: DataFrame, fn, schema: str) -> DataFrame:
        """fn(chunk, ids, texts, replies as a pa.Table) -> pa.Table for each chunk."""
        def run(key, rows, answers):
            out = fn(key[0].as_py(), *unpacked(rows), answers)
            free()
            return out
        return self.df.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(run, schema)


def packer(cuts: np.ndarray, parts: int):
    """cuts: sorted ids, the smallest and the largest among them; each range between two is cut into ``parts`` chunks."""
    def pack(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            chunk = np.searchsorted(cuts, ids, side="left") * parts  # ids up to and with a cut are before it
            if parts > 1:
                high = np.clip(chunk // parts, 1, len(cuts) - 1)
                inside = (ids - cuts[high - 1]) / np.maximum(1, cuts[high] - cuts[high - 1])
                chunk += np.clip((inside * parts).astype(np.int64), 0, parts - 1) * ((chunk > 0) & (chunk < len(cuts) * parts))
            order = np.argsort(chunk, kind="stable")
            firsts = np.flatnonzero(np.diff(chunk[order], prepend=-1))
            blobs, options = [], pa.ipc.IpcWriteOptions(compression="zstd")
            for a, b in zip(firsts, [*firsts[1:], len(order)]):
                part = batch.take(pa.array(order[a:b]))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=options) as out:
                    out.write_batch(part)
                blobs.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(chunk[order][firsts], pa.int32()), pa.array(blobs, pa.binary())], ["chunk", "blob"])
        free()
    return pack


def unpacked(rows: pa.Table) -> tuple:
    """(ids, texts as bytes) of a chunk, by id and then by text; nulls come first."""
    docs = []
    for blob in rows.column("blob"):
        for batch in pa.ipc.open_stream(blob.as_buffer()):
            docs += zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist())
    docs.sort(key=lambda d: (d[0] is not None, d[0] or 0, d[1] is not None, d[1] or b""))
    return [d[0] for d in docs], [d[1] for d in docs]


def encode(values: np.ndarray, shift: int = 0) -> bytes:
    """Sorted numbers as differences, byte plane by byte plane, compressed."""
    steps = np.diff(values >> np.uint64(shift), prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes())


def decode(data: bytes, shift: int = 0) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64) << np.uint64(shift)


def bucket_of(values: np.ndarray, buckets: int) -> np.ndarray:
    return ((values >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def packs(chunk: int, values: np.ndarray, buckets: int, shift: int = 0, marks: np.ndarray | None = None) -> pa.Table:
    """One row for each bucket that gets any of the sorted, distinct ``values``."""
    bucket = bucket_of(values, buckets)
    firsts = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = np.append(firsts[1:], len(values))
    return pa.table({
        "chunk": pa.array(np.full(len(firsts), chunk), pa.int32()),
        "bucket": pa.array(bucket[firsts], pa.int32()),
        "data": pa.array([encode(values[a:b], shift) for a, b in zip(firsts, ends)], pa.binary()),
        "marks": pa.array([None if marks is None else zstandard.compress(np.packbits(marks[a:b]).tobytes(), 1)
                           for a, b in zip(firsts, ends)], pa.binary())})


def reply(found: list, shift: int) -> pa.Table:
    """found: (chunk, values, whether these are hot)."""
    found = [f for f in found if len(f[1])]
    return pa.table({"chunk": pa.array([f[0] for f in found], pa.int32()),
                     "data": pa.array([encode(f[1], shift) for f in found], pa.binary()),
                     "hot": pa.array([f[2] for f in found], pa.bool_())})


def gathered(rows: pa.Table, shift: int, with_marks: int = 0) -> tuple:
    """(chunks, lists of values, marks as an array with_marks x all values) of a bucket, chunks in order."""
    rows = rows.sort_by("chunk")
    chunks, lists = rows.column("chunk").to_pylist(), [decode(x, shift) for x in rows.column("data").to_pylist()]
    marks = [np.unpackbits(np.frombuffer(zstandard.decompress(m), np.uint8), count=with_marks * len(v)).reshape(-1, with_marks)
             for m, v in zip(rows.column("marks").to_pylist(), lists)] if with_marks else []
    return chunks, lists, np.concatenate(marks) if marks else None


def repeated(sent: DataFrame, shift: int = 0, indexed: bool = False, hot_chunks: int | None = None) -> DataFrame:
    """Answers each chunk with those of its values that occur more than once in the corpus.

    Values that more than ``hot_chunks`` chunks have come in answers of their own, marked hot.
    Marks per value: whether the chunk itself has it twice and, if ``indexed``,
    whether the chunk has it in its index; then only values in some chunk's index count.
    """
    n_marks = 2 if indexed else 1

    def compare(rows: pa.Table) -> pa.Table:
        chunks, lists, marks = gathered(rows, shift, n_marks)
        values = np.concatenate(lists)
        order = np.argsort(values, kind="stable")
        firsts = np.flatnonzero(np.diff(values[order], prepend=~values[order[:1]]))
        count = np.diff(np.append(firsts, len(values)))
        hit = (count > 1) | (np.add.reduceat(marks[order, 0].astype(np.int64), firsts) > 0)
        if indexed:
            hit &= np.add.reduceat(marks[order, 1].astype(np.int64), firsts) > 0
        flag = np.zeros(len(values), np.int8)  # 1: repeated, 2: and hot
        flag[order] = np.repeat(hit * (1 + (count > (hot_chunks or len(lists)))), count)
        ends = np.cumsum([len(v) for v in lists])
        return reply([(c, v[flag[e - len(v):e] == kind], kind == 2) for c, v, e in zip(chunks, lists, ends) for kind in (1, 2)], shift)

    return sent.groupBy("bucket").applyInArrow(compare, REPLY)


def earlier(sent: DataFrame) -> DataFrame:
    """Answers each chunk with those of its values that a chunk before it has too."""
    def compare(rows: pa.Table) -> pa.Table:
        chunks, lists, _ = gathered(rows, 0)
        values = np.concatenate(lists)  # in the order of chunks
        order = np.argsort(values, kind="stable")
        again = np.zeros(len(values), bool)
        again[order[1:]] = values[order[1:]] == values[order[:-1]]
        ends = np.cumsum([len(v) for v in lists])
        return reply([(c, v[again[e - len(v):e]], False) for c, v, e in zip(chunks, lists, ends)], 0)

    return sent.groupBy("bucket").applyInArrow(compare, REPLY)


def answers(rows: pa.Table, shift: int = 0) -> np.ndarray:
    lists = [decode(x, shift) for x in rows.column("data").to_pylist()]
    return np.sort(np.concatenate(lists)) if lists else np.zeros(0, np.uint64)


def among(values: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Which of ``values`` are in the sorted array ``found``."""
    if not len(found):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(found, values), len(found) - 1)
    return found[at] == values


def shift_for(total: int) -> int:
    """How many low bits of a hash a first look can do without: about one value in 2**14 meets another by chance."""
    return 64 - min(64, max(33, int(total).bit_length() + 14))
