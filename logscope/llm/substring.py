"""Substring dedup with fixed-block anchors: keep the first occurrence of every repeated run of words.

1. Index and probe. Each document is cut into non-overlapping reference blocks
   of half a window; any window of 20 words holds one whole block of each document it
   occurs in. Every rolling run of block length probes the index of all blocks.
2. Extend. Windows that hold a probe that hit are compared whole, by hash,
   with those of all other chunks; runs of repeated windows are the maximal exact repeats.
3. A word is removed if a window over it also starts earlier (smaller doc_id,
   or earlier in the same document). Everything is judged on the input.

Only hash lists and answers move between chunks (see ``chunks``); a passage or
document that thousands of others repeat is one value per chunk, so no key gathers more
than one value from each chunk and no pairs are formed.

Defined results: null and empty texts have no words and keep the empty string;
words are compared byte for byte; rows that share a doc_id are ordered by text
and count as separate documents; an empty table gives an empty result; very long texts are never cut; extra columns are ignored.
Windows are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from logscope.llm.chunks import Chunked, among, answers, earlier, packs, repeated, shift_for
from logscope.llm.common import WordHashes, mix, window_hashes, word_hashes

WINDOW = 20


class Words:
    """The words of a chunk and the hashes of its blocks and windows; windows never cross documents."""

    def __init__(self, texts: list, window: int):
        self.block = window // 2
        memo = WordHashes()
        self.words = [t.split() if t else [] for t in texts]  # of bytes: splits at 0x20 and 0x09-0x0D only
        self.counts = np.array([len(w) for w in self.words], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        hashes = np.concatenate([np.zeros(0, np.uint64), *[word_hashes(w, memo) for w in self.words]])
        n = len(hashes)
        where = np.arange(n) - np.repeat(self.first[:-1], self.counts)
        left = np.repeat(self.counts, self.counts) - where  # words from here to the end of the document
        self.blocks = window_hashes(hashes, self.block)
        whole = left[:len(self.blocks)] >= self.block
        self.probes = np.flatnonzero(whole)  # where a rolling block starts
        self.indexed = whole & (where[:len(self.blocks)] % self.block == 0)
        self.starts = np.flatnonzero(left >= 2 * self.block)  # where a window starts
        self.windows = mix(self.blocks[self.starts] * np.uint64(0xD6E8FEB86659FD93)
                           + self.blocks[self.starts + self.block]) if len(self.starts) else np.zeros(0, np.uint64)


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, spans array<struct<start,end>> of removed words, kept) for every document."""
    if window < 2 or window % 2:
        raise ValueError("window must be even: a window holds a whole reference block of half its length")
    chunked = Chunked(docs, id_col, text_col)
    shift, buckets = shift_for(chunked.bytes // 4), chunked.buckets

    def probe(chunk, ids, texts):
        w = Words(texts, window)
        values = w.blocks >> np.uint64(shift) << np.uint64(shift)
        distinct, count = np.unique(values[w.probes], return_counts=True)
        marks = np.column_stack([count > 1, among(distinct, np.unique(values[w.indexed]))])
        return packs(chunk, distinct, buckets, shift, marks)

    def candidates(chunk, ids, texts, replies):
        w = Words(texts, window)
        values = w.blocks >> np.uint64(shift) << np.uint64(shift)
        hit = np.concatenate([[0], np.cumsum(among(values, answers(replies, shift)))])
        held = hit[w.starts + w.block + 1] > hit[w.starts]  # a block inside the window hit
        return packs(chunk, np.unique(w.windows[held]), buckets)

    def remove(chunk, ids, texts, replies):
        w = Words(texts, window)
        again = among(w.windows, answers(replies))
        order = np.argsort(w.windows, kind="stable")
        again[order[1:]] |= w.windows[order[1:]] == w.windows[order[:-1]]  # repeated within the chunk
        step = np.zeros(w.first[-1] + 1, np.int64)
        np.add.at(step, w.starts[again], 1)
        np.add.at(step, w.starts[again] + 2 * w.block, -1)
        gone = np.cumsum(step[:-1]) > 0
        spans, kept = [], []
        for words, a, b in zip(w.words, w.first[:-1], w.first[1:]):
            own = gone[a:b]
            if own.any():
                edges = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0))
                spans.append([{"start": int(x), "end": int(y)} for x, y in zip(edges[::2], edges[1::2])])
                words = [words[k] for k in np.flatnonzero(~own)]
            else:
                spans.append([])
            kept.append(b" ".join(words))
        return pa.table({
            "doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(w.counts, pa.int64()),
            "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            "kept": pa.array(kept, pa.binary()).cast(pa.string())})

    hits = repeated(chunked.send(probe), shift, indexed=True)
    before = earlier(chunked.receive(hits, candidates, "chunk int, bucket int, data binary, marks binary"))
    return chunked.receive(before, remove, "doc_id long, n_words long, spans array<struct<start:bigint,end:bigint>>, kept string")
