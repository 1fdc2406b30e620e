"""Quality rules with risk-controlled cutoffs.

Fixed base rules reject very short and very repetitive texts. Five further
scores get their cutoff from labelled documents: per stratum (language) and
score, a cutoff is admitted if the false-rejection rate on the good documents is at
most ``alpha / number of scores`` with an exact binomial (Clopper-Pearson)
bound. Cutoffs of one score are tested from the most lenient one on and stop
at the first failure (a fixed sequence, which needs no further correction);
the level is divided by strata x scores (Bonferroni). So with probability
1 - delta at most ``alpha`` of the good documents of any stratum is rejected
by the learned rules, whichever admitted cutoffs are used. Among these the one is used
that gains most: share of the bad documents rejected less ``PRICE`` times the share of
the good ones; ties go to the most lenient. A stratum with too few labels rejects nothing.

Defined results: null text counts as empty (no words, so the base rule rejects
it); a very long text is measured whole; null lang is a stratum of its own; repeated rows are judged each; empty tables give empty results; other
columns are kept, and the measures travel in one struct column of another name.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logscope.llm.common import kept, parts, raw_bytes

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SPACE = re.compile(rb"[\x20\x09-\x0D]")
SYMBOLS = b"#*$%&|<>"  # fixed values
ALPHA, DELTA = 0.05, 0.05
SMALL_TABLE = 100_000  # rows of cutoffs that are broadcast
PRICE = 20  # how many shares of bad documents a share of good ones is worth

# score: (expression over the measures, bins per unit); a high bin is bad. Each score has BINS bins.
BINS = 400
SCORES = {
    "symbols": (lambda m: m["n_symbols"] / m["n_words"], 100),
    "dup_lines": (lambda m: m["n_dup_lines"] / F.greatest(m["n_lines"], F.lit(1)), 100),
    "repeats": (lambda m: m["n_repeat_words"] / m["n_words"], 100),
    "long_words": (lambda m: m["word_chars"] / m["n_words"], 20),
    "short_words": (lambda m: 20 - F.least(F.lit(20.0), m["word_chars"] / m["n_words"]), 20),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def measure(raw) -> tuple:
    raw = raw or b""
    words = raw.split()  # of bytes: splits at 0x20 and 0x09-0x0D only
    n = len(words)
    chars = len(raw.decode("utf-8", "replace")) - len(SPACE.findall(raw))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    seen, dup, lines = set(), 0, 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            dup += line in seen
            seen.add(line)
    repeat = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            twice = {w for w, c in Counter(windows).items() if c > 1}
            until = 0
            for k, w in enumerate(windows):
                if w in twice:
                    repeat += k + 3 - max(until, k)
                    until = k + 3
    return n, chars, symbols, dup, repeat, lines


def measured(docs: DataFrame, text_col: str = "text", into: str = "_quality", drop_text: bool = False) -> DataFrame:
    """``docs`` with a struct column of measures; map only."""
    if into in docs.columns:
        raise ValueError(f"{into} is already a column")
    fields = [f for f in docs.schema.fields if not (drop_text and f.name == text_col)]
    kind = pa.struct([(m, pa.int64()) for m in MEASURES])
    schema = T.StructType([*fields, T.StructField(into, T.StructType([T.StructField(m, T.LongType()) for m in MEASURES]))])

    def run(batches):
        for batch in parts(batches):
            at = batch.schema.get_field_index(text_col)
            rows = [measure(raw) for raw in raw_bytes(batch.column(at))]
            arrays = [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(MEASURES))]
            keep = [k for k in range(batch.num_columns) if not (drop_text and k == at)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in keep], pa.StructArray.from_arrays(arrays, fields=list(kind))],
                [*[batch.schema.names[k] for k in keep], into])

    return docs.mapInArrow(run, schema)


def base_failed(m) -> F.Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])


def stratum(lang) -> F.Column:
    return F.coalesce(F.concat(F.lit("="), lang.cast("string")), F.lit("null"))


def bins(m) -> dict:
    return {name: F.least(F.floor(F.when(m["n_words"] > 0, value(m) * per).otherwise(0)), F.lit(BINS)).cast("int")
            for name, (value, per) in SCORES.items()}


def most_false(n: int, rate: float, level: float) -> int:
    """The largest k with P(Binomial(n, rate) <= k) <= level, so that the exact upper bound of k
    false rejections among n is at most ``rate``; -1 if there is none."""
    total, k = 0.0, -1
    while k < n:
        j = k + 1
        log_p = (math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1)
                 + j * math.log(rate) + (n - j) * math.log1p(-rate))
        total += math.exp(log_p)
        if total > level:
            break
        k = j
    return k


def cutoffs(marked: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, n_good, <score>...) - the highest bin that each score may have; null: no limit.

    ``marked``: (doc_id, stratum, <score bins>) of documents that pass the base rules.
    Labels are joined by id; only counts per stratum, score and bin (at most
    scores x bins rows for a stratum) reach the function that chooses.
    """
    quality = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
               .groupBy("doc_id").agg((F.min("quality") == 1).alias("good")))
    long = (marked.join(quality, "doc_id").select("stratum", "good", F.explode(F.array(*[
        F.struct(F.lit(s).alias("score"), F.col(s).alias("bin")) for s in SCORES])).alias("x"))
        .groupBy("stratum", "x.score", "x.bin").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")))
    strata = max(1, marked.select("stratum").distinct().count())
    names, n_bins = list(SCORES), BINS

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        row = {"stratum": pdf["stratum"].iloc[0]}
        for name in names:
            own = pdf[pdf["score"] == name]
            at = own["bin"].clip(0, n_bins)
            # For each cutoff, the share of documents above it.
            good, bad = (np.bincount(at, weights=own[c], minlength=n_bins + 1) for c in ("good", "bad"))
            n = int(good.sum())
            above, hit = n - np.cumsum(good), bad.sum() - np.cumsum(bad)
            allowed = most_false(n, alpha / len(names), delta / (len(names) * strata))
            gain = np.where(above <= allowed, hit / max(1, bad.sum()) - PRICE * above / max(1, n), -1.0)
            row["n_good"] = n
            row[name] = int(n_bins - np.argmax(gain[::-1])) if gain.max() > 0 else None
        return pd.DataFrame([row]).astype({s: "Int64" for s in names})

    schema = "stratum string, n_good long, " + ", ".join(f"{s} long" for s in names)
    return long.groupBy("stratum").applyInPandas(
        lambda pdf: choose(pdf)[["stratum", "n_good", *names]], schema)


def marks(lang_col: str, into: str) -> list:
    m = F.col(into)
    return [stratum(F.col(lang_col)).alias("stratum"), *[b.alias(name) for name, b in bins(m).items()]]


def verdict(rows: DataFrame, limits: DataFrame, lang_col: str, into: str) -> DataFrame:
    """``rows`` (with measures) plus columns <into>_stratum, _rejected_by (array), _base_failed and _kept."""
    m = F.col(into)
    lim = limits.select(F.col("stratum").alias(f"{into}_stratum"), F.struct(*SCORES).alias(f"{into}_limits"))
    out = rows.withColumn(f"{into}_stratum", stratum(F.col(lang_col))).join(lim, f"{into}_stratum", "left")
    over = F.filter(F.array(*[F.when(b > F.col(f"{into}_limits")[name], name) for name, b in bins(m).items()]), lambda x: x.isNotNull())
    out = out.withColumn(f"{into}_rejected_by", over).withColumn(f"{into}_base_failed", base_failed(m))
    good = ~F.col(f"{into}_base_failed") & (F.size(f"{into}_rejected_by") == 0)
    return out.withColumn(f"{into}_kept", good).drop(f"{into}_limits")


def learn(rows: DataFrame, labels: DataFrame, lang_col: str, into: str, **levels) -> DataFrame:
    """Cutoffs of all strata, as a checkpointed table; it is broadcast if its size, which is checked, allows."""
    passing = rows.where(~base_failed(F.col(into)))
    limits = kept(cutoffs(passing.select("doc_id", *marks(lang_col, into)), labels, **levels))
    return F.broadcast(limits) if limits.count() <= SMALL_TABLE else limits


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text", lang_col: str = "lang", **levels) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns.

    Measures are taken twice - for learning, and for the verdict - so no text is shuffled.
    """
    into = "_quality"
    while any(c.startswith(into) for c in docs.columns):
        into = "_" + into
    small = kept(measured(docs.select("doc_id", text_col, lang_col), text_col, into, drop_text=True))  # numbers only
    limits = learn(small, labels, lang_col, into, **levels)
    return verdict(measured(docs, text_col, into), limits, lang_col, into).where(F.col(f"{into}_kept")).select(*docs.columns)
