"""K-d tree sharding by bytes, in DataFrame operations only.

The metadata of a document is a point: its size, language, source and id as
numbers. A node of the tree is split along its widest dimension (spread within
the node over spread of the whole table) at the weighted median of bytes, until
each leaf holds about the target bytes. Medians are found by histograms: each
round counts the bytes of every open node in ``BINS`` equal bins of its current
interval, and the next round looks only into the bin that holds the median.
Rows with equal values are split by a hash of their id, in the same way, so a
value that a third of all rows share can be cut. The driver sees at most
nodes x bins counts.

Shards are numbered in the order of the leaves. Slots are gapless: counted per
(shard, hash bucket), offset by the buckets before.

Defined results: null text has size 1; null metadata counts as one value of its
own; repeated rows are rows of their own (they go to one shard and get
different slots); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from logscope.llm.common import kept, partitions

BINS = 2048
ROWS_A_BUCKET = 200_000  # rows that one task numbers
TIE_RANGE = 1 << 62


def metadata(docs: DataFrame, id_col: str, text_col: str, by: list) -> DataFrame:
    """(doc_id, size, text_crc32, dims array<bigint>, tie): a whole number per dimension."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kinds = dict(docs.dtypes)
    numbers = ("tinyint", "smallint", "int", "bigint", "float", "double")
    as_number = lambda c: (F.floor(c).cast("long") if kinds[c] in numbers
                           else F.xxhash64(F.col(c).cast("string")).bitwiseAND((1 << 48) - 1))
    size = (F.octet_length(text) + 1).cast("long")
    return docs.select(
        F.col(id_col).alias("doc_id"), size.alias("size"), F.crc32(text).alias("text_crc32"),
        F.array(size, *[F.coalesce(as_number(c), F.lit(-1).cast("long")) for c in by]).alias("dims"),
        F.xxhash64(F.col(id_col), F.crc32(text)).bitwiseAND(TIE_RANGE - 1).alias("tie"))


def small_table(spark: SparkSession, names: str, rows: list) -> DataFrame:
    """A row per open node, as a table to broadcast; its size is the number of nodes."""
    values = ", ".join("(" + ", ".join("CAST(NULL AS BIGINT)" if v is None else f"{int(v)}L" for v in r) + ")" for r in rows)
    return F.broadcast(spark.sql(f"SELECT * FROM VALUES {values} AS t({names})"))


def cut_at(rows: DataFrame, todo: dict) -> dict:
    """todo: node -> (dimension, low, high, bytes wanted on the left), low <= value < high.

    Returns node -> (dimension, v, t): a row goes right if its value is above v,
    or equals v and its tie number is t or more.
    """
    search = {k: {"dim": d, "low": low, "high": high, "want": want, "value": None} for k, (d, low, high, want) in todo.items()}
    cuts = {}
    while search:
        step = {k: max(1, -(-(s["high"] - s["low"]) // BINS)) for k, s in search.items()}
        nodes = small_table(rows.sparkSession, "_node, dim, value, low, high, step", [
            (k, s["dim"], s["value"], s["low"], s["high"], step[k]) for k, s in search.items()])
        x = F.element_at("dims", (F.col("dim") + 1).cast("int"))
        at = F.when(F.col("value").isNull(), x).otherwise(F.col("tie"))
        found = rows.join(nodes, "_node").withColumn("at", at).where(
            (F.col("value").isNull() | (x == F.col("value"))) & (F.col("at") >= F.col("low")) & (F.col("at") < F.col("high")))
        counts: dict = {k: {} for k in search}
        for r in (found.groupBy("_node", F.expr("(at - low) div step").alias("bin"))
                  .agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()):  # nodes x bins rows at most
            counts[r["_node"]][r["bin"]] = (r["bytes"], r["n"])
        for k, s in list(search.items()):
            before, hit = 0, None
            for b in sorted(counts[k]):
                if before + counts[k][b][0] >= s["want"]:
                    hit = b
                    break
                before += counts[k][b][0]
            tie = s["value"] is not None
            cut = lambda edge, s=s, tie=tie: (s["dim"], s["value"], edge) if tie else (s["dim"], edge, 0)
            if hit is None:
                cuts[k] = cut(s["high"])
                del search[k]
                continue
            whole, n = counts[k][hit]
            left = s["want"] - before
            low = s["low"] + hit * step[k]
            high = min(low + step[k], s["high"])
            if n == 1 or min(left, whole - left) <= s["want"] / 4096 or (tie and high - low == 1):
                cuts[k] = cut(low if left < whole / 2 else high)
                del search[k]
            elif not tie and high - low == 1:
                s |= {"value": low, "low": 0, "high": TIE_RANGE, "want": left}
            else:
                s |= {"low": low, "high": high, "want": left}
    return cuts


def leaves(rows: DataFrame, n_dims: int, shards: int) -> DataFrame:
    """``rows`` with ``shard``: the leaf of the tree that each row lies in."""
    spans = [f(F.col("dims")[d]).alias(f"{name}{d}") for d in range(n_dims) for name, f in (("low", F.min), ("high", F.max))]
    nodes, whole = {0: (0, shards)}, None  # number -> (first shard, shards)
    tree = rows.withColumn("_node", F.lit(0).cast("long"))
    while any(m > 1 for _, m in nodes.values()):
        stats = {r["_node"]: r for r in tree.groupBy("_node").agg(F.sum("size").alias("bytes"), *spans).collect()}  # a row per node
        if not stats:
            break
        whole = whole or [max(1, stats[0][f"high{d}"] - stats[0][f"low{d}"]) for d in range(n_dims)]
        todo, following = {}, {}
        for k, (first, m) in nodes.items():
            if m == 1:
                following[2 * k] = (first, 1)
                continue
            following[2 * k], following[2 * k + 1] = (first, m // 2), (first + m // 2, m - m // 2)
            if r := stats.get(k):
                d = max(range(n_dims), key=lambda d: ((r[f"high{d}"] - r[f"low{d}"]) / whole[d], -d))
                todo[k] = (d, r[f"low{d}"], r[f"high{d}"] + 1, r["bytes"] * (m // 2) / m)
        cuts = small_table(rows.sparkSession, "_node, dim, v, t", [(k, *c) for k, c in cut_at(tree, todo).items()])
        x = F.element_at("dims", (F.col("dim") + 1).cast("int"))
        right = F.coalesce((x > F.col("v")) | ((x == F.col("v")) & (F.col("tie") >= F.col("t"))), F.lit(False))
        tree = kept(tree.join(cuts, "_node", "left").select(*rows.columns, (2 * F.col("_node") + right.cast("long")).alias("_node")))
        nodes = following
    firsts = small_table(rows.sparkSession, "_node, shard", [(k, first) for k, (first, _) in nodes.items()])
    return tree.join(firsts, "_node").withColumn("shard", F.col("shard").cast("int")).drop("_node")


def shard(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, by: tuple = ("lang", "source", "doc_id"),
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot); give the number of shards, or the target bytes of a leaf."""
    by = [c for c in by if c in docs.columns]
    rows = kept(metadata(docs, id_col, text_col, by))
    total = rows.agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).first()
    shards = shards or max(1, round((total["bytes"] or 0) / target_bytes))
    buckets = max(partitions(docs.sparkSession), -(-total["n"] // (shards * ROWS_A_BUCKET)))
    placed = leaves(rows, 1 + len(by), shards).withColumn("_bucket", F.pmod(F.xxhash64("tie"), F.lit(buckets)).cast("int"))
    placed = placed.withColumn("_in", F.row_number().over(W.partitionBy("shard", "_bucket").orderBy("doc_id", "tie")) - 1)
    counts = placed.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    before = counts.select("shard", "_bucket", (F.sum("_n").over(W.partitionBy("shard").orderBy("_bucket")) - F.col("_n")).alias("_before"))
    return placed.join(before, ["shard", "_bucket"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("_before") + F.col("_in")).cast("long").alias("slot"))
