"""Exact byte repeats by a common-prefix interval tree over sparse suffix arrays.

Anchors are positions whose 32-byte hash is the smallest of some window of
hashes; any two equal strings of the wanted length hold the same anchor at the same place.
Anchors that occur once in the corpus are dropped by an exchange of hash lists.
For the others, each occurrence goes with the bytes around it to the bucket of
its hash, where the suffixes that start at one anchor are sorted (a suffix array with the
lengths of common prefixes), a stack scan yields the tree of common-prefix intervals,
and for each interval the left extensions of its members are compared, in the
order of their reversed left contexts: members that agree further to the left form
longer repeats, members that differ end them (left diversity). A prefix of length p with a
left extension q, p + q >= the wanted length, is a maximal repeat; all its occurrences are reported.

Equal surroundings inside a chunk travel once, with all their positions. An
anchor found in more than ``HOT_CHUNKS`` chunks would gather too much in one
bucket: around it, chunks instead exchange the hashes of all windows of the
wanted length, one value per chunk, with the same result.

Defined results: null and empty texts have no bytes; matches never cross
documents; every occurrence is removed, judged on the input; rows that share a
doc_id are separate documents; an empty table gives an empty result; very long texts are never cut; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import itertools

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from logscope.llm.chunks import Chunked, among, bucket_of, decode, encode, gathered, packs, repeated
from logscope.llm.common import mix

LENGTH = 400
GRAM = 32  # bytes of an anchor
HOT_CHUNKS = 512
BLOCK = 1 << 16  # positions worked on at a time, to stay in cache
NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)
BYTE_HASH = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))  # a number per byte, by a rule
SENT = "kind string, chunk int, bucket int, data binary, marks binary"
FOUND = "kind string, chunk int, data binary, ends binary"


class Bytes:
    """The bytes of a chunk, one document after the other."""

    def __init__(self, texts: list):
        texts = [t or b"" for t in texts]
        self.data = b"".join(texts)
        self.first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        self.all = np.frombuffer(self.data, np.uint8)

    def rolling(self, width: int, low: int = 0, high: int | None = None) -> np.ndarray:
        """Hash of the ``width`` bytes from each position of [low, high); NEVER where they would leave the document."""
        most = max(0, len(self.all) - width + 1)
        high = most if high is None else min(high, most)
        if high <= low:
            return np.zeros(0, np.uint64)
        n = high - low + width - 1
        h, w, out, done = BYTE_HASH[self.all[low:low + n]], 1, None, 0
        while True:  # double the width, and add the power where the wanted width has a bit
            if width & w:
                out = h.copy() if out is None else out[:n - done - w + 1] * np.uint64(0xFF51AFD7ED558CCD | (w << 33)) + h[done:n - w + 1]
                done += w
            if done == width:
                break
            h = h[:len(h) - w] * np.uint64(0xC4CEB9FE1A85EC53 ^ (w << 33)) + h[w:]
            h ^= h >> np.uint64(31)
            w *= 2
        out = mix(out)
        out[out == NEVER] = 0
        a, b = np.searchsorted(self.first, [low, high + width], side="left")
        for e in self.first[a:b].tolist():
            out[max(0, e - width + 1 - low):max(0, e - low)] = NEVER
        return out

    def windows(self, width: int, wanted: np.ndarray | None = None) -> np.ndarray:
        """``rolling`` block by block; blocks without a wanted position stay NEVER."""
        out = np.full(max(0, len(self.all) - width + 1), NEVER)
        for low in range(0, len(out), BLOCK):
            if wanted is None or wanted[low:low + BLOCK].any():
                out[low:low + BLOCK] = self.rolling(width, low, low + BLOCK)
        return out

    def anchors(self, length: int) -> tuple:
        """(positions, hashes) of the anchors for repeats of ``length``; worked out block by block."""
        span, n = length - GRAM + 1, len(self.all) - GRAM + 1  # grams in a window; grams
        at, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for low in range(0, max(0, n) if n >= span else 0, BLOCK):
            high = min(n, low + BLOCK)
            first, last = max(0, low - span + 1), min(n, high + span - 1)  # grams of the windows over this block
            h = self.rolling(GRAM, first, last)
            least = swept(h, span, np.minimum)
            before = low - first
            own = h[before:before + high - low]
            most = swept(np.concatenate([  # windows that would start before or end after the chunk count as 0
                np.zeros(span - 1 - before, np.uint64), least, np.zeros(high - low + before - len(least), np.uint64)]), span, np.maximum)
            hit = np.flatnonzero((most == own) & (own != NEVER))
            at.append(hit + low)
            hashes.append(mix(own[hit] + np.uint64(0x9E3779B97F4A7C15)))  # anchors are small hashes: spread them again, one to one
        return np.concatenate(at), np.concatenate(hashes)


def swept(x: np.ndarray, span: int, least) -> np.ndarray:
    """Minimum (or maximum) of each ``span`` neighbours."""
    w = 1
    while 2 * w <= span:
        x = least(x[:-w], x[w:])
        w *= 2
    return least(x[:len(x) - (span - w)], x[span - w:])


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = int.from_bytes(a[:n], "little") ^ int.from_bytes(b[:n], "little")
    return ((x & -x).bit_length() - 1) // 8


def common_suffix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[len(a) - n:] == b[len(b) - n:]:
        return n
    x = int.from_bytes(a[len(a) - n:], "big") ^ int.from_bytes(b[len(b) - n:], "big")
    return ((x & -x).bit_length() - 1) // 8


def intervals(lcp: list):
    """The common-prefix intervals (first, last, length) of sorted suffixes, by a stack scan; children before parents.

    lcp[k]: common prefix of suffix k and k + 1.
    """
    stack = [(0, 0)]  # (length, first suffix)
    for k, length in enumerate([*lcp, 0]):
        first = k
        while stack[-1][0] > length:
            own, first = stack.pop()
            yield first, k, own
        if stack[-1][0] < length:
            stack.append((length, first))


class LeftOrder:
    """Left contexts in the order of their reversed bytes, with the common left extension of any two places."""

    def __init__(self, lefts: list):
        back = [x[::-1] for x in lefts]
        self.order = sorted(range(len(back)), key=back.__getitem__)
        self.rank = np.empty(len(back), np.int64)
        self.rank[self.order] = np.arange(len(back))
        near = np.array([common_prefix(back[a], back[b]) for a, b in zip(self.order, self.order[1:])], np.int64)
        self.least = [near]  # least[j][k]: minimum of 2**j neighbours from k
        while len(self.least[-1]) > (w := 1 << (len(self.least) - 1)):
            self.least.append(np.minimum(self.least[-1][:-w], self.least[-1][w:]))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common left extension of ranks a < b."""
        level = np.log2(b - a).astype(np.int64)
        out = np.empty(len(a), np.int64)
        for j in np.unique(level):
            k = level == j
            out[k] = np.minimum(self.least[j][a[k]], self.least[j][b[k] - (1 << j)])
        return out


def maximal_repeats(lefts: list, rights: list, length: int):
    """(members, left, right) for each common-prefix interval around one anchor; lefts and rights differ as pairs.

    Every member stands for its longest string, from left[k] bytes before the anchor to
    ``right`` bytes after, that some other member of the interval shares; only strings of ``length`` or more.
    """
    if len(rights) == 2:
        p, q = common_prefix(*rights), common_suffix(*lefts)
        if p + q >= length:
            yield np.arange(2), np.array([q, q]), p
        return
    order = sorted(range(len(rights)), key=rights.__getitem__)
    lefts = LeftOrder(lefts)
    ranks, by_rank = lefts.rank[order], np.array(lefts.order)
    for first, last, right in intervals([common_prefix(rights[a], rights[b]) for a, b in zip(order, order[1:])]):
        own = np.sort(ranks[first:last + 1])
        near = lefts.common(own[:-1], own[1:])
        left = np.maximum(np.append(near, -1), np.insert(near, 0, -1))  # left-diverse members have different values
        long = left + right >= length
        if long.any():
            yield by_rank[own[long]], left[long], right


def packed_surroundings(chunk: int, rows: dict, buckets: int) -> pa.Table:
    """rows: (anchor, left length, bytes) -> positions. One compressed table for each bucket, by anchor:
    what is said twice around an anchor is next to itself, and shrinks."""
    keys = sorted(rows)
    anchors = np.array([k[0] for k in keys], np.uint64)
    bucket = bucket_of(anchors, buckets)
    firsts = np.flatnonzero(np.diff(bucket, prepend=-1))
    blobs, pack = [], zstandard.ZstdCompressor(level=3)
    for a, b in zip(firsts, np.append(firsts[1:], len(keys))):
        part = pa.table({"anchor": pa.array(anchors[a:b], pa.uint64()), "lefts": pa.array([k[1] for k in keys[a:b]], pa.int32()),
                         "data": pa.array([k[2] for k in keys[a:b]], pa.binary()),
                         "positions": pa.array([rows[k] for k in keys[a:b]], pa.list_(pa.int64()))})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, part.schema) as out:
            out.write_table(part)
        blobs.append(pack.compress(sink.getvalue()))
    n = len(blobs)
    return pa.table({"kind": pa.array(["near"] * n, pa.string()), "chunk": pa.array([chunk] * n, pa.int32()),
                     "bucket": pa.array(bucket[firsts], pa.int32()), "data": pa.array(blobs, pa.binary()), "marks": pa.nulls(n, pa.binary())})


def unpacked_surroundings(rows: pa.Table):
    """(anchor, left length, bytes, chunk, positions) of all chunks, merged by anchor; only one anchor's rows become objects at a time."""
    def of(chunk, blob):
        part = pa.ipc.open_stream(zstandard.decompress(blob)).read_all().combine_chunks()
        anchors = part.column("anchor").to_numpy()
        for k in range(len(part)):
            yield int(anchors[k]), part["lefts"][k].as_py(), part["data"][k].as_py(), chunk, np.array(part["positions"][k].as_py(), np.int64)

    return heapq.merge(*map(of, rows.column("chunk").to_pylist(), rows.column("data").to_pylist()), key=lambda r: r[0])


def surroundings(rows, length: int):
    """rows: (anchor, left length, bytes, chunk, positions), by anchor -> (chunk, starts, ends) to remove."""
    for _, group in itertools.groupby(rows, key=lambda r: r[0]):
        same: dict = {}
        for _, left, data, chunk, positions in group:
            same.setdefault((left, data), []).append((chunk, positions))
        keys = list(same)
        # All strings of a member hold its anchor, so together they are one run of bytes.
        left, right = np.full(len(keys), -1), np.full(len(keys), -1)
        for k, (own, data) in enumerate(keys):
            if len(data) >= length and sum(len(p) for _, p in same[keys[k]]) > 1:
                left[k], right[k] = own, len(data) - own
        if len(keys) > 1:
            for members, lefts, to in maximal_repeats([d[:n] for n, d in keys], [d[n:] for n, d in keys], length):
                left[members] = np.maximum(left[members], lefts)
                right[members] = np.maximum(right[members], to)
        for k in np.flatnonzero(right >= 0):
            for chunk, positions in same[keys[k]]:
                yield chunk, positions - left[k], positions + right[k]


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text",
                   hot_chunks: int = HOT_CHUNKS) -> DataFrame:
    """(doc_id, n_bytes, spans array<struct<start,end>> of removed bytes, kept binary) for every document."""
    if length < GRAM:
        raise ValueError(f"length must be {GRAM} bytes or more")
    chunked = Chunked(docs, id_col, text_col)
    buckets = 4 * chunked.buckets  # surroundings are larger than hashes

    def send_anchors(chunk, ids, texts):
        values, count = np.unique(Bytes(texts).anchors(length)[1], return_counts=True)
        return packs(chunk, values, buckets, 0, (count > 1).reshape(-1, 1))

    def send_surroundings(chunk, ids, texts, replies):
        own = Bytes(texts)
        at, h = own.anchors(length)
        hot_rows = replies.column("hot").to_pylist()
        lists = [decode(x) for x in replies.column("data").to_pylist()]
        several = sorted_union([v for v, hot in zip(lists, hot_rows) if not hot])
        everywhere = sorted_union([v for v, hot in zip(lists, hot_rows) if hot])
        ends = own.first[1:]
        rows: dict = {}
        held = among(h, several)
        doc = np.searchsorted(ends, at, side="right")
        for p, value, d in zip(at[held].tolist(), h[held].tolist(), doc[held].tolist()):
            a, b = max(int(own.first[d]), p - (length - GRAM)), min(int(ends[d]), p + length)
            if b - a >= length:
                rows.setdefault((value, p - a, own.data[a:b]), []).append(p)
        table = packed_surroundings(chunk, rows, buckets)
        hot = at[among(h, everywhere)]
        if len(hot):
            near = covered(hot - (length - GRAM), hot + 1, max(0, len(own.all) - length + 1))
            windows = own.windows(length, near)
            distinct, count = np.unique(windows[near & (windows != NEVER)], return_counts=True)
            sent = packs(chunk, distinct, buckets, 0, (count > 1).reshape(-1, 1))
            table = pa.concat_tables([table, sent.append_column("kind", pa.array(["window"] * len(sent), pa.string())).select(table.column_names)])
        return table

    def compare(rows: pa.Table) -> pa.Table:
        kinds = np.array(rows.column("kind").to_pylist(), object)
        near = rows.take(np.flatnonzero(kinds == "near"))
        found: dict = {}
        for chunk, starts, ends in surroundings(unpacked_surroundings(near), length):
            found.setdefault(chunk, ([], []))
            found[chunk][0].append(starts)
            found[chunk][1].append(ends)
        out = [("near", c, *joined(np.concatenate(s), np.concatenate(e))) for c, (s, e) in found.items()]
        windows = rows.take(np.flatnonzero(kinds == "window"))
        if len(windows):
            chunks, lists, marks = gathered(windows, 0, 1)
            values, where = np.unique(np.concatenate(lists), return_inverse=True)
            again = (np.bincount(where) + np.bincount(where, weights=marks[:, 0])) > 1
            at = 0
            for c, v in zip(chunks, lists):
                hit = v[again[where[at:at + len(v)]]]
                at += len(v)
                if len(hit):
                    out.append(("window", c, encode(hit), None))
        return pa.table({"kind": pa.array([o[0] for o in out], pa.string()), "chunk": pa.array([o[1] for o in out], pa.int32()),
                         "data": pa.array([o[2] for o in out], pa.binary()), "ends": pa.array([o[3] for o in out], pa.binary())})

    def remove(chunk, ids, texts, replies):
        own = Bytes(texts)
        starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        windows = []
        for kind, data, end in zip(*[replies.column(c).to_pylist() for c in ("kind", "data", "ends")]):
            if kind == "near":
                starts.append(np.frombuffer(data, np.int64))
                ends.append(np.frombuffer(end, np.int64))
            else:
                windows.append(decode(data))
        if windows:
            at = np.flatnonzero(among(own.windows(length), sorted_union(windows)))
            starts.append(at)
            ends.append(at + length)
        gone = covered(np.concatenate(starts), np.concatenate(ends), len(own.data))
        spans, kept = [], []
        for a, b in zip(own.first[:-1].tolist(), own.first[1:].tolist()):
            mark = gone[a:b]
            if mark.any():
                edges = np.flatnonzero(np.diff(mark.astype(np.int8), prepend=0, append=0))
                spans.append([{"start": int(x), "end": int(y)} for x, y in zip(edges[::2], edges[1::2])])
                kept.append(own.all[a:b][~mark].tobytes())
            else:
                spans.append([])
                kept.append(own.data[a:b])
        return pa.table({
            "doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(np.diff(own.first), pa.int64()),
            "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            "kept": pa.array(kept, pa.binary())})

    seen_twice = repeated(chunked.send(send_anchors), hot_chunks=hot_chunks)
    found = chunked.receive(seen_twice, send_surroundings, SENT).groupBy("bucket").applyInArrow(compare, FOUND)
    return chunked.receive(found, remove, "doc_id long, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary")


def sorted_union(lists: list) -> np.ndarray:
    return np.sort(np.concatenate(lists)) if lists else np.zeros(0, np.uint64)


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in some [start, end)."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, np.clip(starts, 0, n), 1)
    np.add.at(step, np.clip(ends, 0, n), -1)
    return np.cumsum(step[:-1]) > 0


def joined(starts: np.ndarray, ends: np.ndarray) -> tuple:
    """The union of intervals, as bytes of starts and of ends."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    first = np.concatenate([[True], starts[1:] > ends[:-1]])
    return starts[first].tobytes(), ends[np.append(np.flatnonzero(first)[1:] - 1, len(ends) - 1)].tobytes()
