"""Language identification by prediction by partial matching.

For each language a context tree over bytes counts what follows every context
of up to ``ORDER`` bytes. A byte is coded in the longest context seen; each
context gives the share d / (n + d) to the escape symbol (n: bytes seen there,
d: different ones; PPM method C), which leads to the next shorter context, and in the end to equal
shares of all 256 bytes. Statistics are frozen after training, so the cost
of a byte depends on the bytes before it alone. All costs are therefore worked out
once, as a table (context, byte) -> bits per language, and a text is scored
by table look-ups, exactly. The language with the shortest code wins.

Training takes whole texts of a bounded sample: the ``SAMPLE`` documents of
each language with the smallest hash of their id (a parameter). All languages are learned. They are put
into slices whose tables stay below ``MODEL_BYTES``; a slice is what a task holds, and texts pass through
one slice after the other, keeping the best language so far. A code length depends
on its own language alone, so slices change no result.

Defined results: null text, or one without a letter: `und`, score 0; ties go
to the first language by name; with no language learned all are `und`; rows that share an id
are scored each; very long texts are scored whole; other columns are never read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from logscope.llm.common import id_type, kept, raw_bytes

ORDER = 3
SAMPLE = 1500
MODEL_BYTES = 256 << 20
UNDEFINED = "und"
LATIN_LETTER = re.compile(rb"[A-Za-z]")


def held_out(id_col) -> F.Column:
    """Documents never learned from."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 4 == 2


def small(df: DataFrame, rows: int = 1 << 20) -> DataFrame:
    """A checkpointed table of two numbers or names a row, marked for broadcast if it has few rows; otherwise it is joined by a shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def sample(docs: DataFrame, per_language: int) -> DataFrame:
    """(lang, text) of the documents to learn from."""
    own = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = kept(own.groupBy("lang").agg(F.count("*").alias("n")))
    # Hashes are even, so about twice the wanted number lies below this bound, and the smallest surely do:
    # a task ranks a few thousand ids, however many a language has.
    share = (F.xxhash64("doc_id").bitwiseAND((1 << 62) - 1) / F.lit(float(1 << 62))).alias("share")
    few = (own.select("doc_id", "lang", share).join(small(sizes), "lang")
           .where(F.col("share") * F.col("n") <= 2 * per_language + 200))
    chosen = (few.withColumn("_k", F.row_number().over(W.partitionBy("lang").orderBy("share", "doc_id")))
              .where(F.col("_k") <= per_language).select("doc_id"))
    chosen = kept(chosen.distinct())  # per_language ids for each language at most
    return own.join(small(chosen), "doc_id", "left_semi").select("lang", "text")


def gram_counts(texts: DataFrame, order: int) -> DataFrame:
    """(lang, gram, n): strings of order + 1 bytes, as numbers; before a text stand zero bytes."""
    def run(batches):
        for batch in batches:
            langs = batch.column(0).to_pylist()
            parts: dict = {}
            for lang, raw in zip(langs, raw_bytes(batch.column(1))):
                parts.setdefault(lang, []).append(bytes(order) + raw)
            for lang, texts in parts.items():
                grams = np.concatenate([np.zeros(0, np.uint32), *[contexts(t, order) << np.uint32(8) | np.frombuffer(t, np.uint8)[order:] for t in texts]])
                values, n = np.unique(grams, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(values, pa.int64()), pa.array(n, pa.int64())],
                                                 ["lang", "gram", "n"])

    return texts.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def contexts(padded: bytes, order: int) -> np.ndarray:
    """For each byte after the first ``order``, the ``order`` bytes before it as a number."""
    b = np.frombuffer(padded, np.uint8).astype(np.uint32)
    n = len(b) - order
    out = np.zeros(n, np.uint32)
    for k in range(order):
        out = out << np.uint32(8) | b[k:k + n]
    return out


class Model:
    """Costs of (context, byte) for all languages.

    ``symbols``: byte -> column, all bytes never seen share the last one.
    ``state``: a dense table from the last ``order`` columns to a row of ``cost``.
    """

    def __init__(self, counts: dict, order: int):
        self.names, self.order = sorted(counts), order
        seen = sorted({0} | {int(b) for c in counts.values() for b in np.unique(c[0] & 255)})  # 0 also stands before a text
        width = len(seen) + 1
        self.symbols = np.full(256, len(seen), np.int64)
        self.symbols[seen] = np.arange(len(seen))
        tables = {name: self.tree(*counts[name], width) for name in self.names}
        known = [np.unique(np.concatenate([t[k][0] // width for t in tables.values()])) for k in range(order + 1)]
        # Rows: every context any language knows, shorter ones first; a context leads to the row of its longest known end.
        costs = []
        for name in self.names:
            below = np.full((1, width), 8.0)  # equal shares of 256 bytes
            rows = []
            for k in range(order + 1):
                own = known[k]
                up = below[np.searchsorted(known[k - 1], own % width ** (k - 1))] if k else below
                below = self.costs(tables[name][k], own, up, width)
                rows.append(below)
            costs.append(np.concatenate(rows))
        self.cost = np.ascontiguousarray(np.stack(costs, axis=-1).astype(np.float32).reshape(-1, len(self.names)))
        first = np.concatenate([[0], np.cumsum([len(k) for k in known])])
        self.state = np.zeros(width ** order, np.int32)
        for k in range(1, order + 1):  # dense by suffix: index % width ** k is the last k symbols
            rows = np.full(width ** k, -1, np.int32)
            rows[known[k]] = first[k] + np.arange(len(known[k]))
            spread = np.tile(rows, width ** (order - k))
            self.state = np.where(spread >= 0, spread, self.state)
        self.width = width

    def tree(self, grams: np.ndarray, n: np.ndarray, width: int) -> list:
        """For k = 0..order: (context and symbol as one number, count)."""
        parts = [self.symbols[(grams >> (8 * j)) & 255] for j in range(self.order, -1, -1)]
        out = []
        for k in range(self.order + 1):
            key = np.zeros(len(grams), np.int64)
            for p in parts[self.order - k:]:
                key = key * width + p
            values, where = np.unique(key, return_inverse=True)
            out.append((values, np.bincount(where, weights=n)))
        return out

    @staticmethod
    def costs(table: tuple, known: np.ndarray, up: np.ndarray, width: int) -> np.ndarray:
        """Bits of each symbol in each context; a context that this language lacks costs what the shorter one does."""
        keys, n = table
        row, symbol = np.searchsorted(known, keys // width), keys % width
        total, kinds = np.bincount(row, weights=n, minlength=len(known)), np.bincount(row, minlength=len(known))
        here = total > 0
        out = up.copy()
        out[here] += (np.log2(total[here] + kinds[here]) - np.log2(kinds[here]))[:, None]  # escape
        out[row, symbol] = np.log2(total[row] + kinds[row]) - np.log2(n)
        return out

    def bits(self, texts: list) -> np.ndarray:
        """Code length of each text in each language."""
        out = np.zeros((len(texts), len(self.names)))
        for j, raw in enumerate(texts):
            if not raw:
                continue
            s = np.concatenate([np.repeat(self.symbols[0], self.order), self.symbols[np.frombuffer(raw, np.uint8)]])
            n = len(raw)
            at = np.zeros(n, np.int64)
            for k in range(self.order):
                at = at * self.width + s[k:k + n]
            out[j] = self.cost[self.state[at].astype(np.int64) * self.width + s[self.order:]].sum(axis=0, dtype=np.float64)
        return out


def has_letter(raw) -> bool:
    return bool(raw) and (LATIN_LETTER.search(raw) is not None or any(c.isalpha() for c in raw.decode("utf-8", "replace")))


def slices(sizes: list, most: int) -> list:
    """(language, contexts) -> lists of languages, by name, whose dense tables stay below ``most`` bytes (one at least)."""
    out, contexts = [], 0
    for name, n in sorted(sizes):
        contexts += n
        if not out or 4 * 257 * contexts * (len(out[-1]) + 1) > most:
            out.append([])
            contexts = n
        out[-1].append(name)
    return out


def fit(docs: DataFrame, order: int = ORDER, per_language: int = SAMPLE, model_bytes: int = MODEL_BYTES) -> list:
    """The models, one for each slice of the languages. Only a row per language and counts of a slice's sample come to the driver."""
    grams = kept(gram_counts(sample(docs, per_language), order))
    sizes = grams.groupBy("lang").agg(F.count_distinct(F.shiftright("gram", 8)).alias("n")).collect()  # a row per language
    models = []
    for names in slices([tuple(r) for r in sizes], model_bytes):
        rows = grams.where(F.col("lang").isin(names)).toArrow().group_by("lang").aggregate([("gram", "list"), ("n", "list")])
        models.append(Model({r["lang"]: (np.array(r["gram_list"], np.int64), np.array(r["n_list"], np.float64)) for r in rows.to_pylist()}, order))
    return models


STATE = "lang_pred string, score double, bits_per_byte double"


def identify(docs: DataFrame, models: list, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, bits_per_byte). Map only, one step for each of ``models``.

    score: the winner's share when each language weighs 2 ** -(bits per byte x at most 64 bytes).
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), held_out(F.col(id_col)).alias("held_out"),
                       F.lit(UNDEFINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits_per_byte"))
    for model in models:
        shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MODEL_BYTES, or one language

        def run(batches, shared=shared):
            m = shared.value
            for batch in batches:
                for k in range(0, batch.num_rows, 256):
                    part = batch.slice(k, 256)
                    texts = raw_bytes(part.column(1))
                    names, scores, per_byte = (part.column(j).to_pylist() for j in (3, 4, 5))
                    bits = m.bits(texts)
                    for j, raw in enumerate(texts):
                        if has_letter(raw):
                            names[j], scores[j], per_byte[j] = better(m.names, bits[j], len(raw), names[j], scores[j], per_byte[j])
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(names, pa.string()),
                                                      pa.array(scores, pa.float64()), pa.array(per_byte, pa.float64())], part.schema.names)

        rows = rows.mapInArrow(run, f"doc_id {id_type(rows)}, text string, held_out boolean, {STATE}")
    return rows.drop("text")


def better(names: list, bits: np.ndarray, size: int, name, score, per_byte) -> tuple:
    """The best language of this slice or of those before, and its share; 1 / ``score`` is the weight of all languages so far."""
    best, used = int(np.argmin(bits)), min(size, 64)
    here = float(bits[best] / size)
    weight = float(np.exp2(-(bits - bits[best]) * (used / size)).sum())
    if per_byte is None:
        return names[best], 1 / weight, here
    gap = min(1000.0, abs(here - per_byte) * used)
    if here < per_byte:
        return names[best], 1 / (weight + 2.0 ** -gap / score), here
    return name, 1 / (1 / score + weight * 2.0 ** -gap), per_byte
