"""Benchmark decontamination by the q-gram lemma and banded alignment.

Texts and benchmark items are normalised (lower case, white space to one
space). Items are cut into segments of at most ``SEGMENT`` characters that start at most ``STEP`` apart, so that
every verbatim part of at least ``SEGMENT`` characters holds a segment but for ``2 k`` characters at its ends, and is found.
A segment of m characters may occur in a document with up to k = ``ERRORS`` x m
edits; by the q-gram lemma such an occurrence shares at least m + 1 - q - k q
character q-grams with it, all on k + 1 neighbouring diagonals. So the
q-grams that document and segment share are counted in diagonal bands of width 2 (k + 1) that
overlap by half; a band with too few has no occurrence. Stretches of
a document with too few q-grams of any segment are left out before diagonals
are looked at. Every remaining band is verified by banded alignment.

The benchmark is sent to every task in slices of at most ``SLICE_BYTES`` of text
(a slice for each pass over the documents); documents are not shuffled.

Items shorter than ``SHORTEST`` characters have too few q-grams; they are found by exact match on word borders, and
marked, as ordinary text may hold them by chance.

Defined results: null and empty texts and items match nothing; ``keep_clean`` takes a document out for a short item
only if the item is at least half of its text; the best
segment of an item counts, and the first of equals; repeated rows give rows each; very long texts
are searched whole; an empty benchmark gives no rows; extra columns are ignored (``keep_clean`` keeps them).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from logscope.llm.common import id_and_text, id_type, parts

Q = 8
ERRORS = 0.08
SEGMENT = 100
STEP = 16  # 2 k edits: what a part of SEGMENT characters may lack of the nearest segment at both ends
SHORTEST = 32
TOKEN = re.compile(r"\w+|[^\w\s]")
SLICE_BYTES = 8 << 20
SLOTS = 16  # of the filter, for each q-gram of a slice: 128 MB for a slice of 8 MB


def normal(text) -> str:
    return " ".join(text.lower().split()) if text else ""


def letters(text: str) -> np.ndarray:
    """A byte per character (the low one): equal characters have equal bytes, which is all a filter needs."""
    try:
        return np.frombuffer(text.encode("latin-1"), np.uint8)
    except UnicodeEncodeError:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint8)[::4].copy()


def grams(chars: np.ndarray) -> np.ndarray:
    n = len(chars) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    return np.ndarray(n, "<u8", chars.tobytes(), strides=(1,)).copy()  # Q = 8 characters are one number


def segments(text: str) -> list:
    """(first, last) of the segments of an item."""
    if len(text) <= SEGMENT:
        return [(0, len(text))]
    count = -(-(len(text) - SEGMENT) // STEP) + 1
    step = (len(text) - SEGMENT) / (count - 1)
    return [(a := round(k * step), a + SEGMENT) for k in range(count)]


class Index:
    """The q-grams of all segments of a slice of the benchmark."""

    def __init__(self, items: list):
        items = [(i, t) for i, text in items if (t := normal(text))]
        self.items = [x for x in items if len(x[1]) >= SHORTEST]
        self.short: dict = {}  # first token -> length -> text -> item ids
        for i, t in items:
            if len(t) < SHORTEST:
                self.short.setdefault(TOKEN.match(t)[0], {}).setdefault(len(t), {}).setdefault(t, []).append(i)
        self.segments = [(k, a, b) for k, (_, t) in enumerate(self.items) for a, b in segments(t)]
        self.size = np.array([b - a for _, a, b in self.segments], np.int64)
        self.edits = np.floor(ERRORS * self.size).astype(np.int64)
        self.needed = np.maximum(1, self.size + 1 - Q - self.edits * Q)
        # Each q-gram of an item is held once; places are those in all items one after the other.
        first = np.concatenate([[0], np.cumsum([len(t) for _, t in self.items])]).astype(np.int64)
        self.starts = np.array([first[k] + a for k, a, _ in self.segments], np.int64)
        self.ends = self.starts + self.size
        # Segments of one item have one size.
        of = np.unique([k for k, _, _ in self.segments], return_index=True)[1]
        self.first, self.width, self.least = first[:-1], 2 * (self.edits[of] + 1), self.needed[of]
        keys, place = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for k, (_, t) in enumerate(self.items):
            g = grams(letters(t))
            keys.append(g)
            place.append(first[k] + np.arange(len(g)))
        keys = np.concatenate(keys)
        order = np.argsort(keys, kind="stable")
        self.keys, self.place = keys[order], np.concatenate(place)[order]
        self.bits = max(16, (SLOTS * len(keys)).bit_length())  # so that a slice of any size leaves most slots free
        self.table = np.zeros(1 << self.bits, bool)
        self.table[self.slot(self.keys)] = True
        self.fewest = int(self.needed.min()) if len(self.needed) else 0
        self.widest = int((self.size + 2 * self.edits).max()) if len(self.size) else 0

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def dense(self, chars: np.ndarray) -> np.ndarray:
        """Places of q-grams that lie in a stretch with enough of them for some segment."""
        g = grams(chars)
        hit = self.table[self.slot(g)]
        if np.count_nonzero(hit) < self.fewest:
            return np.zeros(0, np.int64), g
        before = np.concatenate([[0], np.cumsum(hit)])
        ends = np.minimum(np.arange(len(g)) + self.widest, len(g))
        enough = before[ends] - before[:-1] >= self.fewest  # the stretch that starts here
        starts = np.flatnonzero(enough)
        if not len(starts):
            return starts, g
        step = -np.bincount(ends[starts], minlength=len(g) + 1)
        step[starts] += 1
        return np.flatnonzero(hit & (np.cumsum(step[:-1]) > 0)), g

    def crowded(self, place: np.ndarray, at: np.ndarray):
        """The shared q-grams on diagonals of their item where some band of a segment may have enough of them.

        A band is twice edits + 1 diagonals wide, so it lies in two neighbouring blocks of that width, wherever its segment begins.
        """
        item = np.searchsorted(self.first, place, "right") - 1
        block = (at - place + self.first[item] + (1 << 20)) // self.width[item]
        values, where, count = np.unique(item * (1 << 40) + block, return_inverse=True, return_counts=True)
        follows = np.append(values[1:] == values[:-1] + 1, False)
        enough = count + np.append(count[1:], 0) * follows >= self.least[values >> 40]
        enough |= np.append(False, (enough & follows)[:-1])
        keep = enough[where]
        return place[keep], at[keep]

    def bands(self, chars: np.ndarray):
        """(segment, lowest diagonal, highest, fewest edits) of the bands that share enough q-grams; diagonal: document - segment.

        By the same lemma the number of shared q-grams bounds the edits from below.
        """
        at, g = self.dense(chars)
        if not len(at):
            return
        low, high = np.searchsorted(self.keys, g[at], "left"), np.searchsorted(self.keys, g[at], "right")
        n = high - low
        total = int(n.sum())
        if not total:
            return
        rows = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(total)
        place, at = self.crowded(self.place[rows], np.repeat(at, n))
        if not len(at):
            return
        low = np.searchsorted(self.ends, place + Q, "left")  # the segments that hold the q-gram follow one another
        n = np.searchsorted(self.starts, place, "right") - low
        owner = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        diagonal = np.repeat(at - place, n) + self.starts[owner]
        width = self.edits[owner] + 1
        half = (diagonal + (1 << 20)) // width
        for shift in (0, 1):  # bands of two halves, overlapping by one
            key = owner * (1 << 40) + (half + shift) // 2
            values, where = np.unique(key, return_inverse=True)
            count = np.bincount(where)
            enough = count >= self.needed[values >> 40]
            for v, shared in zip(values[enough].tolist(), count[enough].tolist()):
                s, band = v >> 40, v & ((1 << 40) - 1)
                w = int(self.edits[s]) + 1
                first = (2 * band - shift) * w - (1 << 20)
                fewest = max(0, -((shared + Q - 1 - int(self.size[s])) // Q))  # an edit takes Q q-grams at most
                yield s, first, first + 2 * w - 1, fewest

    def find(self, text: str, any_will_do: bool = False) -> list:
        """(item, start, end, edits) in the normalised text: the best occurrence of each item (``any_will_do``: some item's).

        A segment that stands in its band as it is needs no alignment, which would give the leftmost such place
        without edits. Other bands are aligned, those first that may have the fewest edits, until none left can be better.
        """
        best: dict = {}  # item -> edits, band, start, end: the fewest edits, then the first band
        bands = sorted(set(self.bands(letters(text))))
        for band in bands:
            s, low, high, _ = band
            k, a, b = self.segments[s]
            if k not in best:
                most = int(self.edits[s])
                start = text.find(self.items[k][1][a:b], max(0, low - most), max(0, high + most + b - a))
                if start >= 0:
                    best[k] = (0, band, start, start + b - a)
        for band in sorted(bands, key=lambda x: (x[3], x)):
            if any_will_do and best:
                break
            s, low, high, fewest = band
            k, a, b = self.segments[s]
            if k in best and (not best[k][0] or best[k][:2] < (fewest, band)):
                continue
            found = align(self.items[k][1][a:b], text, low, high, int(self.edits[s]))
            if found and (k not in best or (found[0], band) < best[k][:2]):
                best[k] = (found[0], band, *found[1:])
        return [(self.items[k][0], start, end, edits) for k, (edits, _, start, end) in sorted(best.items())]

    def find_short(self, text: str) -> list:
        """(item, start, end, 0) of the first occurrence on word borders of each short item."""
        found: dict = {}
        for m in TOKEN.finditer(text) if self.short else ():
            for n, texts in self.short.get(m[0], {}).items():
                end = m.start() + n
                part = text[m.start():end]
                if part in texts and part not in found and not (end < len(text) and re.match(r"\w\w", text[end - 1:end + 1])):
                    found[part] = (m.start(), end, texts[part])
        return [(i, a, b, 0) for a, b, ids in found.values() for i in ids]

    def holds_item(self, text: str) -> bool:
        """Whether the text holds an item, or a short one is at least half of it."""
        return bool(self.find(text, any_will_do=True)) or any(2 * (b - a) >= len(text) for _, a, b, _ in self.find_short(text))


def align(segment: str, text: str, low: int, high: int, most: int):
    """(edits, start, end) of the best occurrence of ``segment`` that starts on a diagonal of [low, high]; None over ``most``.

    Only diagonals within ``most`` of the band are filled: row i is the segment's
    i-th character, column c the diagonal low - most + c.
    """
    first, width = low - most, high - low + 1 + 2 * most
    s = np.frombuffer(segment.encode("utf-32-le", "surrogatepass"), np.uint32)
    a = max(0, first)
    t = np.frombuffer(text[a:first + width + len(segment)].encode("utf-32-le", "surrogatepass"), np.uint32)
    padded = np.full(width + len(s), 0xFFFFFFFF, np.uint32)  # padded[j]: the character at first + j; no character outside the text
    padded[a - first:a - first + len(t)] = t[:len(padded) - (a - first)]
    columns, far = np.arange(width), 1 << 20
    cost = np.where((first + columns >= 0) & (first + columns <= len(text)), 0, far)
    start = first + columns
    for i, c in enumerate(s):
        same = cost + (padded[i:i + width] != c)  # along the diagonal
        same[(first + i + columns < 0) | (first + i + columns >= len(text))] = far
        drop, drop_start = np.append(cost[1:], far) + 1, np.append(start[1:], 0)  # a character of the segment that the text lacks
        new = np.minimum(same, drop)
        new_start = np.where(same <= drop, start, drop_start)
        reach = np.minimum.accumulate(new - columns)  # characters of the text that the segment lacks
        source = np.maximum.accumulate(np.where(new - columns == reach, columns, 0))
        cost, start = reach + columns, new_start[source]
        if cost.min() > most:
            return None
    k = int(np.argmin(cost))
    return (int(cost[k]), int(start[k]), first + k + len(s)) if cost[k] <= most else None


def slices(benchmark: DataFrame, slice_bytes: int) -> list:
    """The benchmark in parts of bounded size, by a hash of the text."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-2 * size // slice_bytes))
    return [benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(doc_id, item_id, start, end, edits, short): places in the normalised text where a document holds a benchmark item.

    short: the item is below ``SHORTEST`` characters and was found by exact match on word borders.
    """
    docs = id_and_text(docs, id_col, text_col)
    benchmark = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null")
    out, kind = None, to_arrow_type(benchmark.schema["item_id"].dataType)
    for part in slices(benchmark, slice_bytes):
        index = docs.sparkSession.sparkContext.broadcast(Index([tuple(r) for r in part.orderBy("item_id", "text").collect()]))
        one = docs.mapInArrow(finder(index, kind), f"doc_id {id_type(docs)}, item_id {id_type(benchmark, 'item_id')}, start long, end long, edits long, short boolean")
        out = one if out is None else out.union(one)
    return out


def finder(index, kind):
    def run(batches):
        own = index.value
        for batch in parts(batches):
            texts = [normal(text) for text in batch.column(1).to_pylist()]
            rows = [(j, *leak, short) for j, text in enumerate(texts)
                    for short, found in ((False, own.find(text) if own.items else []), (True, own.find_short(text))) for leak in found]
            ids = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
            kinds = (kind, pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([ids, *[pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds, 1)]],
                                             ["doc_id", "item_id", "start", "end", "edits", "short"])
    return run


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item (a short one: less than half of the text), with all their columns; a pass for each slice, no shuffle."""
    benchmark = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null")
    for part in slices(benchmark, slice_bytes):
        index = docs.sparkSession.sparkContext.broadcast(Index([tuple(r) for r in part.orderBy("item_id", "text").collect()]))

        def run(batches, index=index):
            for batch in parts(batches):
                texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
                yield batch.filter(pa.array([not index.value.holds_item(normal(t)) for t in texts], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
