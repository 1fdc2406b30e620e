"""Spelling variants: words one edit apart, each pointing to its much more frequent neighbour.

Method: sorted-list dynamic programming. Two words one edit apart agree on the
first or on the last half of the shorter one, so the vocabulary is laid out as a
sorted list twice, by words and by reversed words, and cut into blocks: ranges
of the list that share that half. Inside a block every word is a query against
the sorted list. A row of the edit matrix, three cells wide, belongs to a range of
the list with a common prefix; adjacent common-prefix lengths say where a range
divides, so a row is computed once for all words that share the prefix, and a
range whose row holds nothing below two edits is skipped with all its words.
All queries of some blocks go down the list together, one character at a time.

Blocks stream through a task in sorted order; a task holds one block and a few
rows more. A block of more than ``block_words`` words is dealt again by what its
words have before and after a gap of two characters: an edit lies in one gap, and
a gap bounds the words of a block by the alphabet, whatever the data. Pairs stay in
their task: a block sends, for each word, the number of its near words and the best.

Defined results: null text has no words, null doc_id counts as empty, repeated
rows count again, empty tables give no rows, other columns are not read. Texts are
taken in pieces, words may have any length. Ties go to the smallest word.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logscope.llm.common import cut_at_spaces, free, group_starts, id_and_text, kept, parts, whole_groups

# Fixed values of the contract: Latin-1 letters U+00C0 to U+00FF count, only A-Z are lower-cased.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
LEAST_LENGTH, LEAST_COUNT, FACTOR, ONE_IN = 7, 2, 10, 31

BLOCK_WORDS = 200_000   # a block with more words is dealt again by gaps
GAP = 2
HELD = 1 << 18          # distinct words that a task counts before it sends them
RUN = 20_000            # rows whose blocks are searched together
PAIRS = 2_000_000       # rows of the edit matrix made at once
FOUND = "word string, near long, best_n long, best string"
COUNTED = "word string, n long"


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH,
                one_in: int = ONE_IN) -> DataFrame:
    """(word, n): occurrences of each word, after one code point was deleted where the checksum of id and run says so.

    Each task adds up its own words first, so a word that is everywhere is one row of each task.
    """
    def run(batches):
        held: Counter = Counter()

        def sent():
            rows = pa.table({"word": [w.decode("latin-1") for w in held], "n": list(held.values())},
                            pa.schema([("word", pa.string()), ("n", pa.int64())])).to_batches()
            held.clear()
            return rows

        for part in parts(batches):
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if not text:
                    continue
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                own: Counter = Counter()
                for piece in cut_at_spaces(text.encode("latin-1", "replace").translate(LOWER)):
                    own.update(piece.split())
                for word, n in own.items():
                    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
                    if h % one_in == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                    if len(word) >= least_length:
                        held[word] += n
                if len(held) > HELD:
                    yield from sent()
        yield from sent()

    return (id_and_text(docs, id_col, text_col).mapInArrow(run, COUNTED)
            .groupBy("word").agg(F.sum("n").alias("n")))


def _blocks(vocabulary: DataFrame, block_words: int) -> DataFrame:
    """(side, f, class, lo, head, tail, s, word, n): the rows of each block; ``s`` is the word or the reversed word.

    A block of all words has no class (-1) and gap; words of 2f, 2f + 1 and 2f + 2 characters
    share their first ``f``. A gap block has the words of ``class`` characters, and those of one more.
    """
    length = F.length("s")
    rows = (vocabulary.select("word", "n", F.explode(F.array(
                F.struct(F.lit(0).alias("side"), F.col("word").alias("s")),
                F.struct(F.lit(1).alias("side"), F.reverse("word").alias("s")))).alias("x"))
            .select("word", "n", "x.*")
            .withColumn("f", F.explode(F.array_distinct(F.array((length / 2).cast("int"), ((length - 1) / 2).cast("int")))))
            .withColumn("head", F.expr("substring(s, 1, f)")))
    keys = ["side", "f", "head"]
    large = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block_words).select(
        *[F.col(k).alias(f"_{k}") for k in keys])
    rows = rows.join(large, [F.col(k) == F.col(f"_{k}") for k in keys], "left").withColumn("_large", F.col("_f").isNotNull())

    def gap(at: Column) -> Column:
        """The word as one of ``class`` characters (the gap is GAP wide) and as one of a character more."""
        return F.array(
            F.struct(length.alias("class"), at.alias("lo"), F.substring(F.col("s"), at + GAP + 1, length).alias("tail")),
            F.struct((length - 1).alias("class"), at.alias("lo"), F.substring(F.col("s"), at + GAP + 2, length).alias("tail")))

    whole = F.array(F.struct(F.lit(-1).alias("class"), F.col("f").alias("lo"), F.lit("").alias("tail")))
    gaps = F.flatten(F.transform(F.sequence(F.col("f"), length, F.lit(GAP)), gap))
    dealt = F.filter(gaps, lambda g: (g["class"] / 2).cast("int") == F.col("f"))
    return (rows.withColumn("g", F.explode(F.when(F.col("_large"), dealt).otherwise(whole)))
            .select("side", "f", "g.class", "g.lo", F.expr("substring(s, 1, g.lo)").alias("head"), "g.tail", "s", "word", "n"))


class _List:
    """A sorted list of words in blocks: characters in one buffer, adjacent common-prefix lengths (-1 at a block's start)."""

    def __init__(self, words: list, blocks: np.ndarray):
        self.length = np.fromiter(map(len, words), np.int32, len(words))
        self.flat = np.frombuffer(b"\0\0\0".join(words) + b"\0\0\0", np.uint8)  # three characters past an end can be read
        self.at = np.concatenate(([0], np.cumsum(self.length[:-1] + 3))).astype(np.int64)
        self.lcp = np.full(len(words), -1, np.int32)
        same = np.flatnonzero(blocks[1:] == blocks[:-1]) + 1
        self.lcp[same] = 0
        depth = 0
        while len(same):  # those that agree so far
            here = self.flat[self.at[same] + depth]
            same = same[(here == self.flat[self.at[same - 1] + depth]) & (here != 0)]
            depth += 1
            self.lcp[same] = depth

    def near(self, start: int, end: int, f: int) -> tuple:
        """(query, found): pairs of rows in [start, end), blocks that share ``f`` characters each, that are one edit apart."""
        edges = start + np.flatnonzero(self.lcp[start:end] < 0)
        ends = np.append(edges[1:], end)
        queries = np.arange(start, end, dtype=np.int32)
        width = ends - edges
        state = (np.repeat(edges, width).astype(np.int32), np.repeat(ends, width).astype(np.int32), queries,
                 *(np.full(len(queries), k, np.int8) for k in (1, 0, 1)))
        todo, found = [(f, state)], []
        while todo:
            d, (a, b, q, e1, e2, e3) = todo.pop()
            cuts = start + np.flatnonzero(self.lcp[start:end] <= d)
            first, last = np.searchsorted(cuts, a), np.searchsorted(cuts, b)
            counts = last - first
            total = int(counts.sum())
            if total > PAIRS and len(a) > 1:
                half = len(a) // 2
                todo += [(d, tuple(x[:half] for x in (a, b, q, e1, e2, e3))), (d, tuple(x[half:] for x in (a, b, q, e1, e2, e3)))]
                continue
            # Words that end here, once their rows are few enough: the cell of the query's own length is their distance.
            done = self.length[a] == d
            if done.any():
                cell = self.length[q] - d
                distance = np.where(cell == 0, e2, np.where(cell == 1, e3, np.where(cell == -1, e1, 9)))
                hit = done & (distance == 1)
                found.append((q[hit], a[hit]))
            # Each range divides by the next character; the row of the edit matrix goes on for each part.
            of = np.repeat(np.arange(len(a), dtype=np.int32), counts)
            nth = (np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)) + np.repeat(first, counts)
            child = cuts[nth].astype(np.int32)
            char = self.flat[self.at[child] + d]
            mine = q[of]
            at = self.at[mine] + d
            n1 = np.minimum(e1[of] + (char != self.flat[at - 1]), e2[of] + 1)
            n2 = np.minimum(np.minimum(e2[of] + (char != self.flat[at]), e3[of] + 1), n1 + 1)
            n3 = np.minimum(e3[of] + (char != self.flat[at + 1]), n2 + 1)
            alive = (np.minimum(np.minimum(n1, n2), n3) <= 1) & (char != 0) & (self.length[mine] >= d)
            keep = np.flatnonzero(alive)
            if len(keep):
                after = np.append(cuts, end)[nth[keep] + 1].astype(np.int32)
                todo.append((d + 1, (child[keep], after, mine[keep], *(x[keep].astype(np.int8) for x in (n1, n2, n3)))))
        if not found:
            return np.zeros(0, np.int32), np.zeros(0, np.int32)
        return tuple(np.concatenate(x) for x in zip(*found))


def _search(rows: pa.Table) -> pa.Table:
    """Whole blocks in sorted order -> for each word with near words, how many and the best of them."""
    side, f, kind, lo = (rows.column(c).to_numpy() for c in ("side", "f", "class", "lo"))
    n = rows.column("n").to_numpy()
    words, lists = rows.column("word").to_pylist(), [s.encode("latin-1") for s in rows.column("s").to_pylist()]
    new = group_starts(rows, BLOCK)
    listed = _List(lists, np.cumsum(new))
    runs = np.flatnonzero(new & np.concatenate(([True], lo[1:] != lo[:-1])))
    found = [listed.near(a, b, int(lo[a])) for a, b in zip(runs, [*runs[1:], len(words)])]
    q, t = (np.concatenate(x) for x in zip(*found))
    short = np.minimum(listed.length[q], listed.length[t])
    # A pair belongs to the block of the shorter word's half; in a gap block the first difference lies in the gap.
    own = np.where(kind[q] < 0, short // 2 == f[q], short == kind[q])
    q, t = q[own], t[own]
    own = np.ones(len(q), bool)
    for k in np.flatnonzero((kind[q] >= 0) | (side[q] == 1)):
        x, y = lists[q[k]], lists[t[k]]
        if kind[q[k]] >= 0:
            gap = slice(lo[q[k]], lo[q[k]] + GAP)
            own[k] = x[gap] != y[gap]
        if side[q[k]] == 1 and x[-f[q[k]]:] == y[-f[q[k]]:]:
            own[k] = False  # they share the first half as well: a block of the other side has this pair
    q, t = q[own], t[own]
    if not len(q):
        return pa.table({c: [] for c in ("word", "near", "best_n", "best")}, NEAR)
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((rank[t], -n[t], q))
    q, t = q[order], t[order]
    first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
    return pa.table({"word": [words[k] for k in q[first]], "near": np.diff(np.append(first, len(q))),
                     "best_n": n[t[first]], "best": [words[k] for k in t[first]]}, NEAR)


NEAR = pa.schema([("word", pa.string()), ("near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])
BLOCK = ["side", "f", "class", "lo", "head", "tail"]


def _searched(batches):
    """Blocks come in sorted order and are searched whole."""
    for rows in whole_groups(batches, BLOCK, RUN):
        yield from _search(rows).to_batches()
    free()


def near_words(vocabulary: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(word, n_near, best, best_n) of each word of ``vocabulary(word, n)`` that has words exactly one edit away.

    ``best`` is the near word with the largest n, the smallest of those if several have it. Words have 3 or more characters.
    """
    blocks = _blocks(vocabulary, block_words)
    found = blocks.repartition(*BLOCK).sortWithinPartitions(*BLOCK, "s").mapInArrow(_searched, FOUND)
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")))
    return (found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b"))
            .select("word", "n_near", F.col("b.w").alias("best"), (-F.col("b.m")).alias("best_n")))


def roots(links: DataFrame, most: int) -> DataFrame:
    """(word, root): follow ``links(word, form)`` to the end. Pointers double, so ``most`` steps take its logarithm of joins."""
    found = links.select("word", F.col("form").alias("root"))
    for _ in range(max(0, (most - 1).bit_length())):
        found = kept(found)
        onward = found.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        found = found.join(onward, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root"))
    return found


def variants(vocabulary: DataFrame, factor: int = FACTOR, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each row of ``vocabulary(word, n)``, which is read several times.

    A form has ``factor`` times the occurrences of its word or more, so a chain of
    forms has no cycle and at most log(largest n) steps.
    """
    near = near_words(vocabulary, block_words).withColumnsRenamed({"word": "_w"})
    rows = vocabulary.join(near, F.col("word") == F.col("_w"), "left")
    is_form = F.col("best_n") >= factor * F.col("n")
    rows = kept(rows.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                            F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")))
    largest, steps = rows.agg(F.max("n")).first()[0] or 1, 1
    while factor ** steps <= largest:
        steps += 1
    ends = roots(rows.where(F.col("form").isNotNull()).select("word", "form"), steps).withColumnsRenamed({"word": "_w"})
    return (rows.join(ends, F.col("word") == F.col("_w"), "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH,
                   least_count: int = LEAST_COUNT, factor: int = FACTOR, one_in: int = ONE_IN,
                   block_words: int = BLOCK_WORDS) -> DataFrame:
    """The words of ``docs`` with their forms and roots."""
    vocabulary = kept(count_words(docs, id_col, text_col, least_length, one_in).where(F.col("n") >= least_count))
    return variants(vocabulary, factor, block_words)
