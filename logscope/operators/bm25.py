"""Okapi BM25 full-text ranking as DataFrames.

    rank(d) = Σ_t ln(1 + (N − df_t + 0.5)/(df_t + 0.5)) · tf·(k1+1) / (tf + k1·(1 − b + b·len_d/avglen))

Higher is better. Two ways to score, with the same result:

* :func:`score_scan` needs no index: a row's length and the frequencies of the
  query terms are expressions over its own tokens, and the corpus numbers (N,
  average length, document frequencies) are one aggregate of those numbers, which are
  written once. No tokens are exploded or shuffled.
* :func:`score` and :func:`topk` read an index.

A persisted index is a set of immutable segments, each with ``postings(term, block, id, tf, len)``, sorted by term and block,
``blocks(term, block, n, max_tf, min_len)`` and ``docs(id, len, version, terms)``. A block is a range of
``BLOCK_IDS`` ids, so all postings of a document lie in blocks of one number. A refresh writes the new and changed
documents as a segment and lists the replaced and removed ones as dead; the
numbers behind the rank (documents, total length, document frequencies) are kept up
from those two alone, so neither the messages nor the postings of other documents are read. Segments of
like size are merged when there are ``MERGE`` of them, without their dead postings, so their number grows with the
logarithm of the refreshes. Readers follow the newest row of ``corpus``, which is written last and names its segments.

:func:`topk` reads little of that: what a block holds at most of a term bounds the score of all its documents. The
blocks with the highest bounds are scored first; then only those whose bound reaches the rank of
the last row found so far.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logscope.functions.text import tokens

# The usual Okapi parameters.
K1 = 1.2
B = 0.75


BLOCK_IDS = 1 << 12    # ids of a block
MERGE = 4              # segments of like size that become one, and how much larger the next size is
FIRST_BLOCKS = 32      # blocks that a top-k search scores before it knows a rank to beat
MOST_LISTED = 1000     # blocks named in a filter of the scan; more are joined
POSTING_SCHEMA = "term string, block long, id long, tf long, len long, seg int"
BLOCK_SCHEMA = "term string, block long, n long, max_tf long, min_len long, seg int"
DOC_SCHEMA = "id long, len long, version string, terms array<string>, seg int"
DEAD_SCHEMA = "id long, seg int"
DEAD_TERM_SCHEMA = "term string, n long"
CORPUS_SCHEMA = "n_docs long, total_len long, segs array<struct<seg:int,docs:long>>, feed long, v int"


@dataclass(frozen=True)
class TextIndex:
    postings: DataFrame     # POSTING_SCHEMA
    docs: DataFrame         # DOC_SCHEMA, dead ones among them
    blocks: DataFrame       # BLOCK_SCHEMA
    dead: DataFrame         # DEAD_SCHEMA: documents that count no more
    dead_terms: DataFrame   # DEAD_TERM_SCHEMA: how many of them hold a term
    totals: DataFrame       # n_docs, total_len of the living documents
    stored: bool = False

    def corpus(self) -> DataFrame:
        return self.totals.select("n_docs", F.try_divide("total_len", "n_docs").alias("avg_len"))

    def live(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with id and seg) of living documents."""
        return rows.join(self.dead, ["id", "seg"], "left_anti")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "TextIndex":
        c = newest(spark, path)
        of = [r["seg"] for r in c["segs"]]

        def part(name: str, schema: str) -> DataFrame:
            rows = spark.read.schema(schema).option("basePath", f"{path}/{name}").parquet(*[f"{path}/{name}/seg={k}" for k in of])
            return rows.withColumn("seg", F.col("seg").cast("int"))

        at = lambda name, schema: spark.read.schema(schema).parquet(f"{path}/{name}/v={c['v']}")
        return TextIndex(part("postings", POSTING_SCHEMA), part("docs", DOC_SCHEMA), part("blocks", BLOCK_SCHEMA), at("dead", DEAD_SCHEMA),
                         at("dead_terms", DEAD_TERM_SCHEMA), spark.createDataFrame([(c["n_docs"], c["total_len"])], "n_docs long, total_len long"), True)


def newest(spark: SparkSession, path: str):
    """The newest complete version: a row of CORPUS_SCHEMA."""
    rows = spark.read.schema(CORPUS_SCHEMA).option("basePath", f"{path}/corpus").parquet(f"{path}/corpus")
    return rows.agg(F.max_by(F.struct(*rows.columns), "v").alias("c")).first()["c"]


def _tokenised(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    version = F.col("version").cast("string") if "version" in docs.columns else F.lit(None).cast("string")
    return docs.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), version.alias("version"), tokens(F.col(text_col)).alias("toks"))


def _block(id_col: Column) -> Column:
    return F.floor(id_col / BLOCK_IDS)


def block_table(postings: DataFrame) -> DataFrame:
    """(term, block, seg, n, max_tf, min_len): what bounds the scores of a block's documents."""
    return postings.groupBy("term", "block", "seg").agg(
        F.count(F.lit(1)).alias("n"), F.max("tf").alias("max_tf"), F.min("len").alias("min_len"))


def build_index(docs: DataFrame, text_col: str = "message_content", id_col: str = "id", segment: int = 0) -> TextIndex:
    """Index ``docs``. Documents with NULL text are not indexed.

    Term frequencies are counted with a hash aggregate whose partial step runs
    in the task that tokenised the document, so only distinct (term, id)
    pairs are shuffled.
    """
    spark = docs.sparkSession
    toks = _tokenised(docs, text_col, id_col)
    seg = F.lit(segment).cast("int").alias("seg")
    rows = toks.select("id", F.size("toks").cast("long").alias("len"), "version", F.array_distinct("toks").alias("terms"), seg)
    postings = (toks.select("id", F.size("toks").cast("long").alias("len"), F.explode("toks").alias("term"))
                .groupBy("term", "id", "len").agg(F.count(F.lit(1)).alias("tf"))
                .select("term", _block(F.col("id")).alias("block"), "id", "tf", "len", seg))
    totals = rows.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("len"), F.lit(0)).alias("total_len"))
    return TextIndex(postings, rows, block_table(postings), spark.createDataFrame([], DEAD_SCHEMA),
                     spark.createDataFrame([], DEAD_TERM_SCHEMA), totals)


def _write_segment(path: str, segment: int, postings: DataFrame, docs: DataFrame) -> tuple[int, int]:
    """Write a segment; returns its documents and their total length."""
    spark = postings.sparkSession
    (postings.select("term", "block", "id", "tf", "len").repartitionByRange("term", "block", "id").sortWithinPartitions("term", "block", "id")
     .write.mode("overwrite").parquet(f"{path}/postings/seg={segment}"))
    written = spark.read.schema(POSTING_SCHEMA.replace(", seg int", "")).parquet(f"{path}/postings/seg={segment}").withColumn("seg", F.lit(segment))
    (block_table(written).drop("seg").repartitionByRange("term", "block").sortWithinPartitions("term", "block")
     .write.mode("overwrite").parquet(f"{path}/blocks/seg={segment}"))
    (docs.select("id", "len", "version", "terms").repartitionByRange("id").sortWithinPartitions("id")
     .write.mode("overwrite").parquet(f"{path}/docs/seg={segment}"))
    r = (spark.read.schema(DOC_SCHEMA.replace(", seg int", "")).parquet(f"{path}/docs/seg={segment}")
         .agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("len")).first())
    return r["n"], r["len"]


def _term_counts(index: TextIndex, docs: DataFrame, gone: DataFrame, sign: int) -> DataFrame:
    """The dead documents' terms with those of ``gone`` (id, seg), which are among ``docs``, added or taken away."""
    more = (docs.select("id", "seg", "terms").join(gone.select("id", "seg"), ["id", "seg"], "left_semi").select(F.explode("terms").alias("term"))
            .groupBy("term").agg((F.count(F.lit(1)) * sign).alias("n")))
    return index.dead_terms.unionByName(more).groupBy("term").agg(F.sum("n").alias("n")).where("n <> 0")


def _write_version(spark: SparkSession, path: str, v: int, segs: list, dead: DataFrame, dead_terms: DataFrame, n_docs: int, total_len: int, feed: int) -> None:
    """Dead documents, their terms, and last the pointer: readers see this version from here on."""
    dead.select("id", "seg").write.mode("overwrite").parquet(f"{path}/dead/v={v}")
    dead_terms.select("term", "n").write.mode("overwrite").parquet(f"{path}/dead_terms/v={v}")
    row = spark.createDataFrame([(n_docs, total_len, segs, feed)], CORPUS_SCHEMA.replace(", v int", ""))
    row.coalesce(1).write.mode("overwrite").parquet(f"{path}/corpus/v={v}")


def write_index(docs: DataFrame, path: str, text_col: str = "message_content", id_col: str = "id", feed: int = 0) -> None:
    """Build an index in an empty folder, as segment 0. ``feed``: the last change of the table that ``docs`` holds."""
    index = build_index(docs, text_col, id_col)
    n, total = _write_segment(path, 0, index.postings, index.docs)
    _write_version(docs.sparkSession, path, 0, [(0, n)], index.dead, index.dead_terms, n, total, feed)


def apply_changes(spark: SparkSession, path: str, changed: DataFrame, touched: DataFrame, feed: int = 0,
                  text_col: str = "message_content", id_col: str = "id") -> None:
    """Index ``changed`` (id, version, text) anew; documents with an id in ``touched`` that are indexed so far count no more.

    Of the stored documents only those in the range of the touched ids are looked at (``docs`` is sorted by id).
    """
    from logscope.operators.upsert import materialised
    c, index = newest(spark, path), TextIndex.load(spark, path)
    v = c["v"] + 1
    segment = max(r["seg"] for r in c["segs"]) + 1
    touched = materialised(touched.select(F.col(id_col).cast("long").alias("id")).distinct())
    span = touched.agg(F.min("id").alias("low"), F.max("id").alias("high")).first()
    near = index.docs.where(F.col("id").between(span["low"], span["high"]) if span["low"] is not None else F.lit(False))
    dying = materialised(index.live(near.select("id", "seg", "len")).join(touched, "id", "left_semi"))
    lost = dying.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("len")).first()
    fresh = build_index(changed, text_col, id_col, segment)
    n, total = _write_segment(path, segment, fresh.postings, fresh.docs)
    segs = [(r["seg"], r["docs"]) for r in c["segs"]] + [(segment, n)]
    _write_version(spark, path, v, segs, index.dead.unionByName(dying.select("id", "seg")), _term_counts(index, near, dying, 1),
                   c["n_docs"] - lost["n"] + n, c["total_len"] - lost["len"] + total, feed)
    merge(spark, path)


def merge(spark: SparkSession, path: str, fan_in: int = MERGE) -> None:
    """Merge segments of like size (powers of ``fan_in``) while ``fan_in`` of them are there, and write a segment anew
    when half of it or more is dead; dead postings stay behind."""
    while True:
        c = newest(spark, path)
        tiers: dict = {}
        for r in c["segs"]:
            tiers.setdefault(max(0, (max(1, r["docs"]) - 1).bit_length() // max(1, (fan_in - 1).bit_length())), []).append(r["seg"])
        full = next((t for t in sorted(tiers) if len(tiers[t]) >= fan_in), None)
        index = TextIndex.load(spark, path)
        if full is not None:
            old = tiers[full]
        else:
            gone = {r["seg"]: r["count"] for r in index.dead.groupBy("seg").count().collect()}  # a row per segment
            old = [r["seg"] for r in c["segs"] if 2 * gone.get(r["seg"], 0) >= max(1, r["docs"])][:1]
        if not old:
            return
        mine = F.col("seg").isin(old)
        segment = max(r["seg"] for r in c["segs"]) + 1
        n, _ = _write_segment(path, segment, index.live(index.postings.where(mine)), index.live(index.docs.where(mine)))
        segs = [(r["seg"], r["docs"]) for r in c["segs"] if r["seg"] not in old] + [(segment, n)]
        _write_version(spark, path, c["v"] + 1, segs, index.dead.where(~mine),
                       _term_counts(index, index.docs.where(mine), index.dead.where(mine), -1), c["n_docs"], c["total_len"], c["feed"])


def refresh_index(spark: SparkSession, docs: DataFrame, path: str, text_col: str = "message_content", id_col: str = "id", feed: int = 0) -> None:
    """Bring a persisted index up to ``docs`` (with a ``version``) by comparing all ids and versions: new, changed and removed documents.

    :func:`apply_changes` does it from the changes alone, where those are known.
    """
    old = TextIndex.load(spark, path)
    have = old.live(old.docs.select("id", "version", "seg")).select(F.col("id").alias("_id"), F.col("version").alias("_v"))
    now = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col("version").cast("string").alias("version"))
    met = now.join(have, F.col("id") == F.col("_id"), "full_outer")
    touched = met.where(F.col("id").isNull() | F.col("_id").isNull() | (F.col("version") != F.col("_v"))).select(F.coalesce("id", "_id").alias("id"))
    changed = docs.join(touched.select(F.col("id").alias("_t")), F.col(id_col) == F.col("_t"), "left_semi")
    apply_changes(spark, path, changed, touched.select(F.col("id").alias(id_col)), feed, text_col, id_col)


def _terms_of(spark: SparkSession, keywords: Iterable[str]) -> list[str]:
    """Keywords → distinct index terms, by the same expression as the documents, in order."""
    keywords = list(keywords)
    if not keywords:
        return []
    found = spark.createDataFrame([(k,) for k in keywords], "k string").select(tokens(F.col("k")).alias("t")).collect()
    return list(dict.fromkeys(t for r in found for t in r["t"]))


def _idf(n: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n - df + 0.5) / (df + 0.5))


def _part(idf: Column, tf: Column, length: Column, avg_len: Column) -> Column:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avg_len))


EMPTY_SCORES = "id long, score double, n_terms long"


def score_scan(docs: DataFrame, keywords: Iterable[str], mode: str = "and",
               text_col: str = "message_content", id_col: str = "id") -> DataFrame:
    """(id, score, n_terms) of matching documents, from the texts alone."""
    from logscope.operators.upsert import materialised
    spark = docs.sparkSession
    terms = _terms_of(spark, keywords)
    if not terms:
        return spark.createDataFrame([], EMPTY_SCORES)
    toks = _tokenised(docs, text_col, id_col)

    def occurrences(term: str) -> Column:
        return F.size(F.filter("toks", lambda t: t == F.lit(term))).cast("double")

    # The numbers are written once: the statistics and the scores both read them, the texts are tokenised once.
    rows = materialised(toks.select("id", F.size("toks").cast("double").alias("len"), *[occurrences(t).alias(f"tf{k}") for k, t in enumerate(terms)]))
    stats = rows.agg(F.struct(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg("len").alias("avg_len"),
        *[F.count_if(F.col(f"tf{k}") > 0).cast("double").alias(f"df{k}") for k in range(len(terms))]).alias("s")).scalar()
    rows = rows.withColumn("s", stats)
    s = F.col("s")
    parts = [F.when(F.col(f"tf{k}") > 0, _part(_idf(s["n"], s[f"df{k}"]), F.col(f"tf{k}"), F.col("len"), s["avg_len"])).otherwise(F.lit(0.0))
             for k in range(len(terms))]
    hits = reduce(lambda a, b: a + b, [(F.col(f"tf{k}") > 0).cast("long") for k in range(len(terms))])
    wanted = F.col("n_terms") >= (1 if mode == "or" else len(terms))
    return rows.select("id", reduce(lambda a, b: a + b, parts).alias("score"), hits.alias("n_terms")).where(wanted)


def score(index: TextIndex, keywords: Iterable[str], mode: str = "and") -> DataFrame:
    """(id, score, n_terms) for documents matching the terms, from an index.

    ``and``: every term must occur; ``or``: any term, summed over those present.
    Only the postings of the terms are read.
    """
    spark = index.postings.sparkSession
    terms = _terms_of(spark, keywords)
    if not terms:
        return spark.createDataFrame([], EMPTY_SCORES)
    hits = index.live(index.postings.where(F.col("term").isin(terms)))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # a row per query term
    return _scored(hits, df, index, len(terms), mode)


def _scored(hits: DataFrame, df: DataFrame, index: TextIndex, n_terms: int, mode: str) -> DataFrame:
    stats = index.corpus().select(F.struct("n_docs", "avg_len")).scalar()
    part = _part(_idf(F.col("s")["n_docs"], F.col("df")), F.col("tf").cast("double"), F.col("len"), F.col("s")["avg_len"])
    scored = (hits.join(F.broadcast(df), "term").withColumn("s", stats)
              .groupBy("id").agg(F.sum(part).alias("score"), F.count(F.lit(1)).alias("n_terms")))
    return scored if mode == "or" else scored.where(F.col("n_terms") == n_terms)


def document_frequencies(index: TextIndex, terms: list[str]) -> DataFrame:
    """(term, df) of the query terms, from the block table and the dead documents' terms; no posting is read."""
    wanted = F.col("term").isin(terms)
    gone = index.dead_terms.where(wanted).select("term", (-F.col("n")).alias("n"))
    return index.blocks.where(wanted).select("term", "n").unionByName(gone).groupBy("term").agg(F.sum("n").alias("df")).where("df > 0")


def block_bounds(index: TextIndex, terms: list[str], df: DataFrame, mode: str) -> DataFrame:
    """(block, bound): no document of the block scores more.

    A term adds most with the highest frequency and the shortest length that the block has of it.
    """
    stats = index.corpus().select(F.struct("n_docs", "avg_len")).scalar()
    most = _part(_idf(F.col("s")["n_docs"], F.col("df")), F.col("max_tf").cast("double"), F.col("min_len"), F.col("s")["avg_len"])
    per_term = (index.blocks.where(F.col("term").isin(terms)).join(F.broadcast(df), "term").withColumn("s", stats)
                .groupBy("block", "term").agg(F.max(most).alias("most")))
    found = per_term.groupBy("block").agg(F.sum("most").alias("bound"), F.count(F.lit(1)).alias("n"))
    return (found if mode == "or" else found.where(F.col("n") == len(terms))).select("block", "bound")


def topk(index: TextIndex, keywords: Iterable[str], mode: str, k: int, ranked: Callable[[DataFrame], DataFrame],
         decimals: int, stats: dict | None = None) -> DataFrame:
    """The ``k`` best rows of ``ranked(scores)``, which turns (id, score, n_terms) into rows with ``rank`` and ``id``, and may drop some.

    Two rounds: the blocks with the highest bounds, then those whose bound reaches the k-th rank of
    the first round. Blocks below it hold no row of the result. ``stats`` gets the number of blocks read and of all.
    """
    from logscope.operators.upsert import materialised
    spark = index.postings.sparkSession
    terms = _terms_of(spark, keywords)
    order = [F.col("rank").desc(), F.col("id").asc()]
    if not terms:
        return ranked(spark.createDataFrame([], EMPTY_SCORES)).orderBy(*order).limit(k)
    df = materialised(document_frequencies(index, terms))
    bounds = materialised(block_bounds(index, terms, df, mode))
    first = [r["block"] for r in bounds.orderBy(F.col("bound").desc(), "block").limit(FIRST_BLOCKS).collect()]

    def of(blocks: DataFrame | None, listed: list | None) -> DataFrame:
        hits = index.postings.where(F.col("term").isin(terms))
        hits = hits.where(F.col("block").isin(listed)) if listed is not None else hits.join(blocks, "block", "left_semi")
        return ranked(_scored(index.live(hits), df, index, len(terms), mode))

    top = materialised(of(None, first).orderBy(*order).limit(k))
    r = top.agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("rank")).first()
    rest = bounds.where(~F.col("block").isin(first))
    if r["n"] >= k:  # the bound is a sum of doubles in another order: a margin far below a rank's last digit
        rest = rest.where(F.round(F.col("bound") + 1e-9, decimals) >= r["rank"])
    rest = rest.select("block")
    few = [x["block"] for x in rest.limit(MOST_LISTED + 1).collect()]
    if stats is not None:
        stats |= {"read": len(first) + (len(few) if len(few) <= MOST_LISTED else rest.count()), "blocks": bounds.count()}
    if not few:
        return top.orderBy(*order)
    more = of(rest, few if len(few) <= MOST_LISTED else None)
    return top.unionByName(more).orderBy(*order).limit(k)


def term_stats(index: TextIndex) -> DataFrame:
    """Per term: document frequency, total occurrences and idf (corpus statistics behind the rank)."""
    n = index.corpus().select("n_docs").scalar()
    per_term = index.live(index.postings).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("occurrences"))
    return per_term.select("term", "df", "occurrences", F.round(_idf(n, F.col("df")), 6).alias("idf"))
