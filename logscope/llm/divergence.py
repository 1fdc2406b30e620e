"""Source divergence audit: how far the sources of a language are from each other and from the language, by term use.

Method: in-mapper stripes. A task folds whole documents into stripes: for each
(language, term) the number of documents and the occurrences per source. A full
table of stripes is sent on (spilled) and begun anew. Stripes meet by key, sorted, so a
merging task holds one stripe; a term that every task has is first merged by
groups of ``FAN_IN`` tasks. Merged stripes of kept terms carry all counts of their
term, so each task turns its own stripes into smoothed rates and adds up
absolute differences, for all pairs of sources at once.

All arithmetic is exact, in integers: rates are floors of a division done three
digits at a time, good for 10^15 occurrences.

Defined results: null text, language and source are empty strings; repeated rows
count again; empty tables give no rows; other columns are not read; texts are
folded in pieces, whole, and count once as documents. Ties rank by the item's bytes.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logscope.llm.common import cut_at_spaces, free, group_starts, kept, parts, whole_groups

# Fixed values of the contract: terms are runs of ASCII letters and of all that is not ASCII; only A-Z are lower-cased.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 97 <= b <= 122 else 32 for b in range(256))
LEAST_DOCS, PRIOR, SCALE_STEPS, STEP = 30, 5, 3, 1000
TOP = 50

HELD = 1 << 19      # (term, source) counts that a task holds before it sends its stripes
MEET = 50_000       # stripes that are merged at once, about
FAN_IN = 512        # stripes of one key that a merging task meets at most, about
LEFT = 256          # sources whose rows of the pair table one task makes
CELLS = 1 << 21     # terms x sources in one matrix
BUCKET = 1 << 17    # (term, source) counts that meet the totals in one group, about
STRIPE = "lang string, term string, docs long, sources array<string>, counts array<long>"
STRIPE_ARROW = pa.schema([("lang", pa.string()), ("term", pa.string()), ("docs", pa.int64()),
                          ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
RESULT = "lang string, source string, part string, item string, value long"
RESULT_ARROW = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _fold(batches):
    """Documents (lang, source, text) -> stripes; a language's empty term lists its sources.

    While a task folds, a stripe lies in columns: per language the documents of each
    term, per source of it the occurrences. Columns become stripes when they are sent.
    """
    docs: dict = defaultdict(Counter)
    counts: dict = defaultdict(Counter)
    size = 0
    for part in parts(batches):
        for lang, source, text in zip(*(c.to_pylist() for c in part.columns)):
            used, own = counts[lang, source], set()
            size -= len(used)
            for piece in cut_at_spaces(text.encode().translate(LOWER)):
                words = piece.split()
                used.update(words)
                own.update(words)
            docs[lang].update(own)
            size += len(used)
            if size > HELD:
                yield from _sent(docs, counts)
                docs.clear()
                counts.clear()
                size = 0
    yield from _sent(docs, counts)


def _sent(docs: dict, counts: dict, rows: int = 20_000):
    for lang, per_term in docs.items():
        sources = [s for of, s in counts if of == lang]
        number = dict(zip(per_term, range(1, len(per_term) + 1)))
        at, code, n = [np.zeros(len(sources), np.int64)], [np.arange(len(sources))], [np.zeros(len(sources), np.int64)]
        for k, s in enumerate(sources):
            used = counts[lang, s]
            at.append(np.fromiter(map(number.__getitem__, used), np.int64, len(used)))
            code.append(np.full(len(used), k))
            n.append(np.fromiter(used.values(), np.int64, len(used)))
        at, code, n = (np.concatenate(x) for x in (at, code, n))
        order = np.argsort(at, kind="stable")
        width = np.bincount(at, minlength=len(per_term) + 1)
        out = _stripes(pa.array([lang] * len(width)), pa.array(["", *(t.decode() for t in per_term)], pa.string()),
                       np.fromiter([0, *per_term.values()], np.int64, len(width)), width,
                       pa.array(sources, pa.string()).take(pa.array(code[order])), n[order])
        yield from out.to_batches(max_chunksize=rows)


def _stripes(lang, term, docs: np.ndarray, width: np.ndarray, sources, counts: np.ndarray) -> pa.Table:
    offsets = pa.array(np.concatenate(([0], np.cumsum(width))), pa.int32())
    return pa.table([lang, term, pa.array(docs, pa.int64()), pa.ListArray.from_arrays(offsets, sources),
                     pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64()))], schema=STRIPE_ARROW)


def _one(column) -> pa.Array:
    """A column of a table as a single array."""
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)


def _merged(rows: pa.Table) -> pa.Table:
    """Whole groups of stripes, sorted by key -> one stripe for each key."""
    new = group_starts(rows, ["lang", "term"])
    first, key = np.flatnonzero(new), np.cumsum(new) - 1
    width = pc.list_value_length(_one(rows.column("sources"))).to_numpy()
    named = _one(rows.column("sources")).flatten().dictionary_encode()
    n = _one(rows.column("counts")).flatten().to_numpy()
    entry = np.repeat(key, width) * max(1, len(named.dictionary)) + named.indices.to_numpy()
    order = np.argsort(entry, kind="stable")
    entry = entry[order]
    starts = np.flatnonzero(np.concatenate(([True], entry[1:] != entry[:-1])))
    at, code = np.divmod(entry[starts], max(1, len(named.dictionary)))
    chosen = pa.array(first)
    return _stripes(_one(rows.column("lang")).take(chosen), _one(rows.column("term")).take(chosen),
                    np.add.reduceat(rows.column("docs").to_numpy(), first), np.bincount(at, minlength=len(first)),
                    named.dictionary.take(pa.array(code)), np.add.reduceat(n[order], starts))


def _merge(batches):
    """Stripes sorted by key -> one stripe for each key."""
    for rows in whole_groups(batches, ["lang", "term"], MEET):
        yield from _merged(rows).to_batches()
    free()


def stripes(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, term, docs, sources, counts): one stripe for each term of a language; the empty term lists all its sources."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"c{k}") for k, c in enumerate((lang_col, source_col, text_col))])
    sent = rows.mapInArrow(_fold, STRIPE).withColumn("mapper", F.spark_partition_id())
    mappers = rows.rdd.getNumPartitions()
    while mappers > FAN_IN:  # a level of the tree: stripes of FAN_IN neighbouring tasks become one
        sent = sent.withColumn("mapper", (F.col("mapper") / FAN_IN).cast("int"))
        met = sent.repartition("lang", "term", "mapper").sortWithinPartitions("mapper", "lang", "term")
        sent = met.mapInArrow(_merge_groups, STRIPE + ", mapper int")
        mappers = -(-mappers // FAN_IN)
    return sent.drop("mapper").repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(_merge, STRIPE)


def _merge_groups(batches):
    """As ``_merge``, for each group of mappers; the batches are sorted by mapper first."""
    for rows in whole_groups(batches, ["mapper", "lang", "term"], MEET):
        starts = np.flatnonzero(group_starts(rows, ["mapper"]))
        for a, b in zip(starts, [*starts[1:], rows.num_rows]):
            part = rows.slice(a, b - a).combine_chunks()
            out = _merged(part)
            yield from out.append_column("mapper", pa.array([part.column("mapper")[0].as_py()] * out.num_rows, pa.int32())).to_batches()
    free()


def rates(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (count + PRIOR) / total), exactly, by long division in steps of 10^3."""
    left, out = counts + PRIOR, np.zeros(np.broadcast(counts, total).shape, np.int64)
    for _ in range(SCALE_STEPS):
        left = left * STEP
        out = out * STEP + left // total
        left = left % total
    return out + 1


def _divergences(top: int):
    """(stripes of some kept terms of a language, its sources with their totals) -> its share of pair sums, and the leading terms."""
    def run(key, terms: pa.Table, groups: pa.Table) -> pa.Table:
        lang, _, block = (k.as_py() for k in key)
        groups = groups.sort_by("source")
        names = groups.column("source").to_pylist()
        totals = groups.column("total").to_numpy()[None, :]
        whole = groups.column("lang_total").to_numpy()[:1]
        left = range(block * LEFT, min(len(names), (block + 1) * LEFT))
        number = {s: k for k, s in enumerate(names)}
        sums = np.zeros((len(left), len(names)), np.int64)
        best = [[] for _ in left]  # (-value, term)
        rows = max(1, CELLS // max(1, len(names)))
        for at in range(0, terms.num_rows, rows):
            part = terms.slice(at, rows).combine_chunks()
            counts = np.zeros((part.num_rows, len(names)), np.int64)
            sources, values = part.column("sources").combine_chunks(), part.column("counts").combine_chunks()
            width = np.diff(sources.offsets.to_numpy())
            counts[np.repeat(np.arange(part.num_rows), width), [number[s] for s in sources.flatten().to_pylist()]] = values.flatten().to_numpy()
            p = rates(counts, totals)
            q = rates(counts.sum(axis=1), whole)
            words = part.column("term").to_pylist()
            for k, g in enumerate(left):
                sums[k] += np.abs(p - p[:, g:g + 1]).sum(axis=0)
                ahead = p[:, g] - q
                here = np.flatnonzero((counts[:, g] > 0) & (ahead > 0))
                best[k] = sorted(best[k] + [(-int(ahead[i]), words[i]) for i in here[_leading(ahead[here], top)]],
                                 key=lambda x: (x[0], x[1].encode()))[:top]
        out = [(lang, names[g], "pair", names[h], int(sums[k, h])) for k, g in enumerate(left) for h in range(len(names)) if h != g]
        out += [(lang, names[g], "term", term, -value) for k, g in enumerate(left) for value, term in best[k]]
        free()
        return pa.table(dict(zip(RESULT_ARROW.names, zip(*out))) if out else {n: [] for n in RESULT_ARROW.names}, RESULT_ARROW)
    return run


def _leading(values: np.ndarray, top: int) -> np.ndarray:
    """Where the ``top`` largest values are, with all that equal the last of them."""
    if len(values) <= top:
        return np.arange(len(values))
    return np.flatnonzero(values >= np.partition(values, -top)[-top])


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
          least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) for each source of each language.

    Part ``pair``: every other source, by the sum of absolute differences of rates over the
    kept terms. Part ``term``: the ``top`` terms that the source uses more than its language.
    """
    merged = kept(stripes(docs, lang_col, source_col, text_col).where((F.col("docs") >= least_docs) | (F.col("term") == "")))
    listed, terms = merged.where(F.col("term") == ""), merged.where(F.col("term") != "")
    # Totals per source and language, from counts that each task adds up first.
    size = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b)).alias("n"))
    used = (terms.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x"))
            .groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n")))
    one = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    groups = (listed.select("lang", F.explode("sources").alias("source"))
              .join(used, ["lang", "source"], "left").join(size.withColumnsRenamed({"n": "ln", "v": "lv"}), "lang", "left")
              .select("lang", "source", (one(F.col("n")) + PRIOR * one(F.col("lv"))).alias("total"),
                      (one(F.col("ln")) + PRIOR * one(F.col("lv"))).alias("lang_total")))
    # Stripes and totals meet by language, bucket of terms and block of sources; both numbers follow the data.
    found = merged.agg(F.sum(F.size("sources")).alias("cells"), F.max(F.when(F.col("term") == "", F.size("sources"))).alias("sources")).first()
    buckets = max(1, -(-(found["cells"] or 0) // BUCKET))
    blocks = max(1, -(-(found["sources"] or 0) // LEFT))
    spread = lambda df: df.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    fresh = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns])  # noqa: E731  both come from the same stripes
    left = spread(terms.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")))
    right = spread(fresh(groups).withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)))))
    key = ["lang", "bucket", "block"]
    shares = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_divergences(top), RESULT)
    summed = shares.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    by_value = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    return (summed.withColumn("rank", F.row_number().over(by_value))
            .where((F.col("part") == "pair") | (F.col("rank") <= top)))
