"""Near-duplicate groups by SuperMinHash.

Each distinct shingle of a document ranks all signature slots by a permutation
of its own, and writes rank + fraction into the slots in that order; a slot
keeps its least value. The ranks of one shingle differ between slots, which
lowers the variance of the signature, and once every slot holds less than the
current rank no shingle can change it, so a document stops early.

Documents with equal sets are one class from then on. Classes that agree on a
band of slots fall into one bucket; each bucket links its members to one
leader, never all pairs. Every candidate is confirmed on the full shingle
sets. Confirmed links are grouped by a distributed union-find (hooking to the
smallest neighbour and pointer jumping, on checkpointed tables). Members of a
bucket that are still in different groups are then compared with each other,
so no link depends on the choice of a leader - but for pairs that exact bounds
rule out, from the shingles that only one document has and from what is known of
their difference to the leader; these leave few pairs.

(SuperMinHash's permutation of an element is here the affine map a r + b mod 127, so pairwise uniform only.)

Defined results: lower-casing is A-Z only; fewer words than a shingle form one
shingle; null, empty and blank texts have an empty set and are groups of one;
rows that share a doc_id are one document and get one group, its links are
judged on one of the texts (always the same); rows without doc_id are linked with
nothing; an empty table gives an empty result; very long texts are never cut; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logscope.llm.chunks import Chunked, among, answers, packs, repeated
from logscope.llm.common import WordHashes, id_and_text, id_type, kept, mix, parts, raw_bytes, window_hashes, word_hashes

WIDTH, PERCENT = 5, 85
SLOTS = 127  # a prime: rank -> (a * rank + b) mod SLOTS is then a permutation, and uniform on pairs of slots
BANDS, ROWS = 31, 4  # two sets with similarity 0.85 agree on no band once in 10**10 cases
FRACTION_BITS = 48
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
BATCH_SHINGLES = 1 << 18
CLASS_BITS = 5
SALT_ROWS = 2000  # rows of one side of a bucket that meet the other side in one task, about


def shingles(raw, memo: WordHashes, width: int = WIDTH) -> np.ndarray:
    """The distinct shingles of a text, as sorted 64-bit hashes."""
    words = raw.lower().split() if raw else []  # of bytes: A-Z only; splits at 0x20 and 0x09-0x0D only
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(window_hashes(word_hashes(words, memo), min(width, len(words))))


def signatures(sets: list) -> np.ndarray:
    """One row of SLOTS values for each non-empty set."""
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    element = np.concatenate([np.zeros(0, np.uint64), *sets])
    out = np.full((len(sets), SLOTS), EMPTY, np.uint64)
    seed = mix(element)
    a = (seed >> np.uint64(32)) % np.uint64(SLOTS - 1) + np.uint64(1)
    b = (seed & np.uint64(0xFFFFFFFF)) % np.uint64(SLOTS)
    for rank in range(SLOTS):
        slot = ((a * np.uint64(rank) + b) % np.uint64(SLOTS)).astype(np.int64)
        fraction = mix(element + np.uint64((0x9E3779B97F4A7C15 * (rank + 1)) & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(64 - FRACTION_BITS)
        np.minimum.at(out.reshape(-1), doc * SLOTS + slot, (np.uint64(rank) << np.uint64(FRACTION_BITS)) | fraction)
        done = (out >> np.uint64(FRACTION_BITS)).max(axis=1) <= rank  # later ranks are all larger
        go_on = ~done[doc]
        if not go_on.all():
            doc, element, a, b = doc[go_on], element[go_on], a[go_on], b[go_on]
        if not len(doc):
            break
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band; different bands have different keys."""
    keys = np.empty((len(signature), BANDS), np.uint64)
    for k in range(BANDS):
        h = np.full(len(signature), k + 1, np.uint64)
        for r in range(ROWS):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + signature[:, k * ROWS + r])
        keys[:, k] = h
    return keys.view(np.int64)


def sketched(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n, set_a, set_b, bands array<long>): size, 128-bit digest and band keys of each set."""
    def run(batches):
        memo = WordHashes()
        for batch in parts(batches):
            texts = raw_bytes(batch.column(1))
            k = 0
            while k < len(texts):
                sets, total, first = [], 0, k
                while k < len(texts) and total < BATCH_SHINGLES:
                    sets.append(shingles(texts[k], memo, width))
                    total += len(sets[-1])
                    k += 1
                full = [j for j, s in enumerate(sets) if len(s)]
                bands = [[]] * len(sets)
                for j, row in zip(full, band_keys(signatures([sets[j] for j in full])) if full else []):
                    bands[j] = row
                digests = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
                signed = lambda x: x - (1 << 64) if x >> 63 else x
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, k - first), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([signed(d >> 64) for d in digests], pa.int64()), pa.array([signed(d & ((1 << 64) - 1)) for d in digests], pa.int64()),
                    pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n", "set_a", "set_b", "bands"])

    return docs.mapInArrow(run, f"doc_id {id_type(docs)}, n long, set_a long, set_b long, bands array<long>")


def fits(a: str, b: str, percent: int) -> F.Column:
    """Sizes that the similarity allows."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def by_class(shingles: np.ndarray) -> np.ndarray:
    """How many of the shingles fall into each of 2 ** CLASS_BITS classes by hash."""
    return np.bincount((shingles >> np.uint64(64 - CLASS_BITS)).astype(np.int64), minlength=1 << CLASS_BITS).astype(np.int32)


def compared(pairs: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """pairs (a, b) -> (a, b, apart, linked): how many shingles only one of the full sets has, counted by
    class, and whether the similarity is reached; texts: (doc_id, packed)."""
    both = (pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("packed").alias("text_a")), "a")
            .join(texts.select(F.col("doc_id").alias("b"), F.col("packed").alias("text_b")), "b"))

    def run(batches):
        memo, recent = WordHashes(), {}

        def own(key, packed):
            if key not in recent:
                if len(recent) >= 256:
                    recent.clear()
                recent[key] = shingles(zstandard.decompress(packed), memo, width)
            return recent[key]

        for batch in parts(batches):
            apart, linked = [], []
            for a, b, x, y in zip(*[batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b")]):
                p, q = own(a, x), own(b, y)
                different = np.setxor1d(p, q, assume_unique=True)
                shared = (len(p) + len(q) - len(different)) // 2
                apart.append(by_class(different))
                linked.append(100 * shared >= percent * (len(p) + len(q) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(apart, pa.list_(pa.int32())), pa.array(linked, pa.bool_())],
                                             ["a", "b", "apart", "linked"])

    kind = id_type(pairs, "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, f"a {kind}, b {kind}, apart array<int>, linked boolean")


def own_shingles(texts: DataFrame, width: int) -> DataFrame:
    """(node, own): how many shingles of a document no other one of ``texts`` has, counted by class."""
    def unpacked(batches):
        for batch in parts(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([zstandard.decompress(p).decode("utf-8", "replace") for p in batch.column(1).to_pylist()], pa.string())],
                ["doc_id", "text"])

    chunked = Chunked(texts.select("doc_id", "packed").mapInArrow(unpacked, f"doc_id {id_type(texts)}, text string"))
    buckets, memo = chunked.buckets, WordHashes()

    def send(chunk, ids, raws):
        values, count = np.unique(np.concatenate([np.zeros(0, np.uint64), *[shingles(r, memo, width) for r in raws]]), return_counts=True)
        return packs(chunk, values, buckets, 0, (count > 1).reshape(-1, 1))

    def count(chunk, ids, raws, replies):
        found = answers(replies)
        sets = [shingles(r, memo, width) for r in raws]
        return pa.table({"node": pa.array(ids, pa.int64()), "own": pa.array([by_class(s[~among(s, found)]) for s in sets], pa.list_(pa.int32()))})

    return kept(chunked.receive(repeated(chunked.send(send)), count, "node long, own array<int>"))


def total(counts: F.Column) -> F.Column:
    return F.aggregate(counts, F.lit(0), lambda a, b: a + b)


def across_groups(rows: DataFrame, percent: int) -> DataFrame:
    """rows: (key, node, n, own, apart, group) -> pairs (a, b) of one bucket and different groups that may be linked.

    own: shingles that no other document here has; apart: the symmetric difference to the bucket's leader (null: not
    known); both counted by class. Two sets reach the similarity p if their symmetric difference is at most
    (n + m) (1 - p) / (1 + p). It is at least the sum of both differences to the leader less twice what these have in
    common: in each class at most the smaller number, and ``own`` shingles take no part. It is also at least what the
    sizes and ``own`` shingles say. Both bounds are exact. Near copies too far from each other fail the first one,
    as their edits lie in different classes. Before the rows meet, a row is judged at the partner size that allows
    most: all of its shingles but its ``own`` ones, or the bucket's least size if that is larger.
    """
    most = lambda apart, size: (100 + percent) * apart <= (100 - percent) * size
    n, own = F.col("n"), F.col("n_own")
    least = rows.groupBy("key").agg(F.min("n").alias("least"), F.ceil(F.count(F.lit(1)) / SALT_ROWS).cast("int").alias("salts"))
    rows = (rows.withColumn("n_own", total(F.col("own"))).withColumn("n_apart", total(F.col("apart")))
            .withColumn("open", F.zip_with("apart", "own", lambda a, o: F.greatest(F.lit(0), a - o))).join(least, "key")
            .withColumn("best", F.greatest(F.col("least"), n - own))
            .where(most(own + F.greatest(F.lit(0), own + F.col("best") - n), n + F.col("best"))))
    x, y = (rows.select("key", "salts", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "n_own", "n_apart", "open", "group")]) for s in "xy")
    # A large bucket is dealt over several tasks: each gets a share of one side and all of the other.
    x = x.withColumn("salt", F.pmod(F.xxhash64("node_x"), F.col("salts")).cast("int")).drop("salts")
    y = y.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    size = F.col("n_x") + F.col("n_y")
    by_size = size - 2 * F.least(F.col("n_x") - F.col("n_own_x"), F.col("n_y") - F.col("n_own_y"))
    by_leader = F.col("n_apart_x") + F.col("n_apart_y") - 2 * total(F.zip_with("open_x", "open_y", lambda a, b: F.least(a, b)))
    return (x.join(y, ["key", "salt"]).where((F.col("group_x") < F.col("group_y")) & most(by_size, size) & F.coalesce(most(by_leader, size), F.lit(True)))
            .select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct())


def grouped(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes (node), links (a, b) -> (node, group): the smallest node that links reach."""
    group = nodes.select("node", F.col("node").alias("group"))
    links = kept(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    while not links.isEmpty():
        up = kept(links.groupBy("b").agg(F.min("a").alias("up")).select(F.col("b").alias("node"), "up"))
        while True:  # pointer jumping: every chain of k steps takes log k rounds
            jump = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
            up = kept(up.join(jump, "up", "left").select("node", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")))
            if up.where("moved").isEmpty():
                break
            up = up.drop("moved")
        top = lambda c: up.select(F.col("node").alias(c), F.col("up").alias(f"{c}_up"))
        group = kept(group.join(top("group"), "group", "left").select("node", F.coalesce("group_up", "group").alias("group")))
        links = kept(links.join(top("a"), "a", "left").join(top("b"), "b", "left")
                     .select(F.coalesce("a_up", "a").alias("x"), F.coalesce("b_up", "b").alias("y")).where("x <> y")
                     .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    return group


def near_duplicates(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) for every document.

    class_id: smallest doc_id with the same set; component_id: smallest doc_id reachable over links.
    """
    docs = id_and_text(docs, id_col, text_col)
    sketches = kept(sketched(docs, width))
    full = sketches.where("n > 0 AND doc_id IS NOT NULL")
    classes = kept(full.groupBy("set_a", "set_b").agg(
        F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    rows = classes.select("node", "n", F.explode("bands").alias("key"))
    leaders = (rows.groupBy("key").agg(F.count("*").alias("many"), F.min_by("node", F.xxhash64("node", "key")).alias("leader"),
                                       F.min_by("n", F.xxhash64("node", "key")).alias("leader_n"))
               .where("many > 1").drop("many"))
    members = kept(rows.join(leaders, "key"))  # only buckets with two or more classes
    star = kept(members.where(F.col("node") != F.col("leader")).where(fits("n", "leader_n", percent))
                .select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct())
    held = members.select(F.col("node").alias("doc_id")).distinct()
    texts = kept(packed(docs.join(held, "doc_id", "left_semi")))
    checked = kept(compared(star, texts, percent, width))
    links = checked.where("linked").select("a", "b")
    nodes = classes.select("node").distinct()
    group = grouped(nodes, links)

    # Members of a bucket in different groups: compare them across groups, where a link is possible at all.
    now = members.select("key", "node", "n", "leader").join(group, "node")
    mixed = now.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low <> high").select("key")
    open_rows = kept(now.join(mixed, "key"))
    if not open_rows.isEmpty():
        own = own_shingles(texts.join(open_rows.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi"), width)
        open_rows = (open_rows.join(own, "node")
                     .withColumn("a", F.least("node", "leader")).withColumn("b", F.greatest("node", "leader"))
                     .join(checked.select("a", "b", "apart"), ["a", "b"], "left")
                     .withColumn("apart", F.when(F.col("node") == F.col("leader"), F.transform("own", lambda o: F.lit(0))).otherwise(F.col("apart"))))
        pairs = across_groups(open_rows.select("key", "node", "n", "own", "apart", "group"), percent).join(star, ["a", "b"], "left_anti")
        more = kept(compared(pairs, texts, percent, width).where("linked").select("a", "b"))
        if not more.isEmpty():
            group = grouped(nodes, links.union(more))

    found = full.join(classes.select("set_a", "set_b", "node"), ["set_a", "set_b"]).join(group, "node").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("node").alias("class_id"), F.col("group").alias("component_id"))
    alone = sketches.where("n = 0 OR doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
    return found.union(alone)


def packed(docs: DataFrame) -> DataFrame:
    """(doc_id, packed): texts, compressed."""
    def run(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for batch in parts(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([pack.compress(t or b"") for t in raw_bytes(batch.column(1))], pa.binary())], ["doc_id", "packed"])

    return docs.mapInArrow(run, f"doc_id {id_type(docs)}, packed binary").groupBy("doc_id").agg(F.min("packed").alias("packed"))


def keep_one(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group - the one with the smallest id - with all columns of ``docs``."""
    found = near_duplicates(docs, percent, width, id_col, text_col)
    gone = found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
