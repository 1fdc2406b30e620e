"""BPE encoding through a table of distinct words, and decoding through an id-to-piece join.

Texts are split into the tokenizer's words inside Spark. Each chunk of
documents sends its distinct words to buckets by hash; a bucket encodes every
distinct word once and answers each chunk with the ids of the words it asked
for; the chunk joins them back by position. Words, not occurrences, are
shuffled. Decoding joins each id with its piece; the piece table is the
tokenizer's vocabulary, whose size is fixed by its file, so it is sent to every task.

Splitting follows the tokenizer file (normalise, lower-case, split): texts of
ASCII and Latin-1 characters by one pattern, all others by the tokenizer's own
normaliser and pattern; its special tokens are cut out of the raw text first.

Defined results: null and empty texts have no ids and decode to the empty
string; rows that share a doc_id are separate documents; very long texts are
never cut; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logscope.llm.chunks import Chunked, bucket_of
from logscope.llm.common import free, id_type, parts

SPECIAL = "\0"  # before a special token in the list of words; no word of the pattern looks like that
# The tokenizer's pattern for characters up to U+00FF, after lower-casing.
LETTERS, NUMBERS, SPACES = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾", "\x09-\x0d\x20\x85\xa0"
LATIN1 = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+")
WIDE = re.compile("[^\0-\xff]")
ENCODED_AT_ONCE = 2000  # words


class Splitter:
    """Text -> the words that the tokenizer encodes one by one."""

    def __init__(self, path: str):
        self.path, self.loaded = path, None
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.pattern = config["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.special = re.compile("(" + "|".join(re.escape(t["content"]) for t in config["added_tokens"]) + ")")
        self.marks = tuple(t["content"] for t in config["added_tokens"])

    def tokenizer(self) -> tuple:
        """The tokenizer and its split step, loaded when first needed; one thread, as the task has one core."""
        if self.loaded is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Regex, Tokenizer, pre_tokenizers

            self.loaded = Tokenizer.from_file(self.path), pre_tokenizers.Split(Regex(self.pattern), "removed", invert=True)
        return self.loaded

    def words(self, text: str) -> list:
        if any(m in text for m in self.marks):
            out = []
            for k, part in enumerate(self.special.split(text)):
                out += [SPECIAL + part] if k % 2 else self.plain(part)
            return out
        return self.plain(text)

    def plain(self, text: str) -> list:
        if text.isascii() or not WIDE.search(text):
            return LATIN1.findall(text.lower())
        tokenizer, split = self.tokenizer()
        return [w for w, _ in split.pre_tokenize_str(tokenizer.normalizer.normalize_str(text))]

    def encode(self, words: list) -> list:
        raw = [w[1:] if w[0] == SPECIAL and w[1:] in self.marks else w for w in words]
        out, (tokenizer, _) = [], self.tokenizer()
        for k in range(0, len(raw), ENCODED_AT_ONCE):
            out += [np.array(e.ids, np.int32) for e in tokenizer.encode_batch_fast(raw[k:k + ENCODED_AT_ONCE], add_special_tokens=False)]
        return out


def once(make):
    """make() at the first call; for a function that is sent to tasks, once in each task."""
    made: list = []

    def get():
        if not made:
            made.append(make())
        return made[0]

    return get


def distinct_words(splitter: Splitter, texts: list) -> tuple:
    """(distinct words in order of appearance, for each document the numbers of its words)."""
    number: dict = {}
    docs = []
    for t in texts:
        words = splitter.words(t.decode("utf-8", "replace")) if t else []
        docs.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words)))
    return list(number), docs


def squeezed(strings: list) -> bytes:
    return zstandard.compress("\n".join(strings).encode(), 3)


def spread(data: bytes) -> list:
    return zstandard.decompress(data).decode().split("\n")


def buckets_of(words: list, buckets: int) -> list:
    """For each bucket, the numbers of its words; the same at sending and at receiving."""
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    bucket = bucket_of(hashes, buckets)
    order = np.argsort(bucket, kind="stable")
    firsts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    return [(int(bucket[order[a]]), order[a:b]) for a, b in zip(firsts, np.append(firsts[1:], len(order)))]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) for every document."""
    chunked = Chunked(docs, id_col, text_col)
    buckets = 4 * chunked.buckets  # words are larger than hashes
    splitter = once(lambda: Splitter(path))

    def ask(chunk, ids, texts):
        words, _ = distinct_words(splitter(), texts)
        rows = [(b, squeezed([words[k] for k in at])) for b, at in buckets_of(words, buckets)]
        return pa.table({"chunk": pa.array([chunk] * len(rows), pa.int32()), "bucket": pa.array([r[0] for r in rows], pa.int32()),
                         "data": pa.array([r[1] for r in rows], pa.binary())})

    def look_up(rows: pa.Table) -> pa.Table:
        lists = [spread(x) for x in rows.column("data").to_pylist()]
        table = list(dict.fromkeys(w for words in lists for w in words))  # each distinct word of the corpus is in one bucket
        ids = dict(zip(table, splitter().encode(table)))
        out = []
        for words in lists:
            found = [ids[w] for w in words]
            flat = np.concatenate([[len(found)], [len(f) for f in found], *found]).astype(np.int32)
            out.append(zstandard.compress(flat.tobytes(), 3))
        free()
        return pa.table({"chunk": rows.column("chunk"), "bucket": rows.column("bucket"), "ids": pa.array(out, pa.binary())})

    def join_back(chunk, ids, texts, replies):
        words, docs = distinct_words(splitter(), texts)
        answer = dict(zip(replies.column("bucket").to_pylist(), replies.column("ids").to_pylist()))
        count = np.zeros(len(words), np.int32)
        parts, order = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for bucket, at in buckets_of(words, buckets):
            flat = np.frombuffer(zstandard.decompress(answer[bucket]), np.int32)
            count[at] = flat[1:1 + flat[0]]
            parts.append(flat[1 + flat[0]:])
            order.append(at)
        flat, order = np.concatenate(parts), np.concatenate(order)
        first = np.zeros(len(words), np.int32)
        first[order] = np.cumsum(count[order], dtype=np.int32) - count[order]
        found, offsets = [np.zeros(0, np.int32)], [0]
        for numbers in docs:  # the ids of each word, by position
            n = count[numbers]
            ends = np.cumsum(n, dtype=np.int32)
            total = int(ends[-1]) if len(ends) else 0
            found.append(flat[np.repeat(first[numbers] - (ends - n), n) + np.arange(total, dtype=np.int32)])
            offsets.append(offsets[-1] + total)
        return pa.table({"doc_id": pa.array(ids, pa.int64()),
                         "ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(found)))})

    found = chunked.send(ask, "chunk int, bucket int, data binary").groupBy("bucket").applyInArrow(
        look_up, "chunk int, bucket int, ids binary")
    return chunked.receive(found, join_back, "doc_id long, ids array<int>")


def pieces(path: str) -> list:
    """The vocabulary by id."""
    from tokenizers import Tokenizer

    vocab = Tokenizer.from_file(path).get_vocab(with_added_tokens=True)
    out = [""] * (max(vocab.values()) + 1)
    for piece, k in vocab.items():
        out[k] = piece
    return out


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, ids, decoded): each id joined with its piece, pieces joined by a space as the file has no decoder."""
    def run(batches):
        table = pa.array(pieces(path))
        for batch in parts(batches, 128):
            ids = batch.column(1)
            ids = pa.ListArray.from_arrays(pc.subtract(ids.offsets, ids.offsets[0]), ids.flatten())
            found = pa.ListArray.from_arrays(ids.offsets, table.take(ids.values))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pc.binary_join(found, " ")], ["doc_id", "ids", "decoded"])

    two = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return two.mapInArrow(run, f"doc_id {id_type(two)}, ids array<int>, decoded string")
