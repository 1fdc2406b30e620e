"""What the methods add to the contracts."""

import base64
import gzip
import random
import zlib

import numpy as np
import pytest

from logscope.llm import decontam, langid, neardup, pii, secrets, suffix
from logscope.llm import queries as Q
from logscope.llm.common import table


def spans(found):
    return {(k, a, b) for k, a, b in found}


@pytest.mark.parametrize("wrap", [
    lambda s: "".join(f"%{b:02x}" for b in s.encode()),
    lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
    lambda s: "".join(f"&#x{ord(c):x};" for c in s),
    lambda s: base64.b64encode(s.encode()).decode(),
    lambda s: base64.urlsafe_b64encode(gzip.compress(s.encode())).decode(),
    lambda s: base64.b64encode(zlib.compress(base64.b64encode(s.encode()))).decode().replace("=", "%3D"),
])
def test_secrets_in_layers(wrap):
    hidden = wrap("password = hunter22hunter")
    text = "füñ before " + hidden + " after"
    found, layers = secrets.scan_layers(text)
    assert layers >= 1
    assert any(k == "assign" and a >= 11 and b <= 11 + len(hidden) for k, a, b in found)


def test_secret_layers_end():
    text = "%25" * 50 + "41" + " " + "%2525252525" * 20
    assert secrets.scan_layers(text)[1] < 60
    assert secrets.scan_layers("") == (set(), 0)


@pytest.mark.parametrize("text, kind, piece", [
    ("write to john [at] mail [dot] example (dot) com now", "email", "john [at] mail [dot] example (dot) com"),
    ("write to john at mail dot example dot org now", "email", "john at mail dot example dot org"),
    ("write jоhn@exаmple.cоm now", "email", "jоhn@exаmple.cоm"),
    ("call plus one five five five zero one zero nine nine nine nine today", "phone", "plus one five five five zero one zero nine nine nine nine"),
    ("host １９２.１６８.0.1 up", "ip", "１９２.１６８.0.1"),
    ("card 4111​1111​1111​1111 ok", "card", "4111​1111​1111​1111"),
    ("host one nine two dot one six eight dot zero dot one up", "ip", "one nine two dot one six eight dot zero dot one"),
])
def test_disguised_pii(text, kind, piece):
    a = text.index(piece)
    assert (kind, a, a + len(piece)) in {s[:3] for s in pii.find_in(text.encode())}
    assert piece not in pii.masked(text.encode())


def test_pii_leaves_prose():
    for text in ("We met at the cafe at one dot on the map", "one two three", "a.b at home", "Straße, garçon, niño", "1 + 1 = 2", "v1.2.3"):
        assert pii.find_in(text.encode()) == [] and pii.masked(text.encode()) == text
    assert pii.masked(None) is None


def test_superminhash_estimates():
    rnd = np.random.default_rng(5)
    error = []
    for share in (0.2, 0.5, 0.8, 0.95):
        for _ in range(30):
            both, own = rnd.integers(0, 1 << 63, int(400 * share)).astype(np.uint64), 400 - int(400 * share)
            a, b = (np.concatenate([both, rnd.integers(0, 1 << 63, own // 2).astype(np.uint64)]) for _ in range(2))
            s = neardup.signatures([a, b])
            true = len(both) / (len(both) + 2 * (own // 2))
            error.append(((s[0] == s[1]).mean() - true) ** 2 / (true * (1 - true) / neardup.SLOTS))
    assert np.mean(error) < 1.3
    small = neardup.signatures([np.array([7], np.uint64), np.array([7, 9], np.uint64)])
    assert (small < neardup.EMPTY).all() and 0.3 < (small[0] == small[1]).mean() < 0.7


def test_intervals_are_the_tree():
    assert sorted(suffix.intervals([2, 3, 0, 1])) == [(0, 2, 2), (1, 2, 3), (3, 4, 1)]
    assert sorted(suffix.intervals([5, 5])) == [(0, 2, 5)] and list(suffix.intervals([0])) == []


def test_maximal_repeats_against_pairs():
    rnd = random.Random(3)
    for _ in range(200):
        word = lambda n: bytes(rnd.choice(b"ab") for _ in range(n))
        pairs = list({(word(rnd.randint(0, 4)), b"x" + word(rnd.randint(0, 4))) for _ in range(rnd.randint(2, 9))})
        if len(pairs) < 2:
            continue
        lefts, rights = [p[0] for p in pairs], [p[1] for p in pairs]
        got = [set() for _ in pairs]
        for members, left, right in suffix.maximal_repeats(lefts, rights, 4):
            for k, n in zip(members, left):
                got[k].add((n, right))
        for i in range(len(pairs)):
            shared = [(suffix.common_suffix(lefts[i], lefts[j]), suffix.common_prefix(rights[i], rights[j])) for j in range(len(pairs)) if j != i]
            shared = [s for s in shared if sum(s) >= 4]
            assert max((s[0] for s in got[i]), default=None) == max((s[0] for s in shared), default=None)
            assert max((s[1] for s in got[i]), default=None) == max((s[1] for s in shared), default=None)


def distance(segment, text):
    """Fewest edits between ``segment`` and any part of ``text``."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(segment, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_leaks_with_edits():
    rnd = random.Random(11)
    letters = "abcdefghij klmnop"
    prose = lambda n: decontam.normal("".join(rnd.choice(letters) for _ in range(n)))
    items = [(k, prose(rnd.randint(60, 400))) for k in range(8)]
    index = decontam.Index(items)
    for _ in range(60):
        k, item = rnd.choice(items)
        copy = list(item)
        for _ in range(rnd.randint(0, 14)):
            j = rnd.randrange(len(copy))
            rnd.choice((lambda: copy.pop(j), lambda: copy.insert(j, "z"), lambda: copy.__setitem__(j, "y")))()
        text = decontam.normal(prose(rnd.randint(0, 80)) + " " + "".join(copy) + " " + prose(rnd.randint(0, 80)))
        own = [s for s in range(len(index.segments)) if index.segments[s][0] == [i for i, _ in index.items].index(k)]
        leak = any(distance(index.items[index.segments[s][0]][1][index.segments[s][1]:index.segments[s][2]], text) <= index.edits[s] for s in own)
        found = {i: e for i, _, _, e in index.find(text)}
        assert (k in found) == leak
    assert index.find("") == [] and index.find(prose(3000)) == []


def test_leaks_of_table(spark):
    folder = "/root/testdata/sf0.001"
    items = [(r[0], decontam.normal(r[1])) for r in table(spark, folder, "benchmark").collect()]
    docs = [(r["doc_id"], decontam.normal(r["text"])) for r in table(spark, folder, "documents").collect()]
    want = {(d, i) for d, t in docs for i, x in items if x in t}
    got = Q.op4_decontamination(spark, folder).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    small = decontam.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"), slice_bytes=4000).collect()
    assert sorted(map(tuple, small)) == sorted(map(tuple, got))


def direct_bits(counts, raw, order):
    """PPM code length by walking the contexts, byte by byte."""
    from math import log2
    trees = [{} for _ in range(order + 1)]
    for gram, n in counts.items():
        b = gram.to_bytes(order + 1, "big")
        for k in range(order + 1):
            own = trees[k].setdefault(b[order - k:order], {})
            own[b[order]] = own.get(b[order], 0) + n
    total, padded = 0.0, bytes(order) + raw
    for j in range(order, len(padded)):
        for k in range(order, -1, -1):
            own = trees[k].get(padded[j - k:j])
            if own is None:
                continue
            whole = sum(own.values()) + len(own)
            if padded[j] in own:
                total += log2(whole / own[padded[j]])
                break
            total += log2(whole / len(own))
        else:
            total += 8
    return total


def test_ppm_code_lengths():
    texts = {"aa": "the cat sat on the mat, the end".encode(), "bb": "der hund saß auf der matte, schluß".encode()}
    order, counts = 3, {}
    for name, raw in texts.items():
        padded = bytes(order) + raw
        counts[name] = {}
        for j in range(order, len(padded)):
            g = int.from_bytes(padded[j - order:j + 1], "big")
            counts[name][g] = counts[name].get(g, 0) + 1
    model = langid.Model({k: (np.array(list(c)), np.array(list(c.values()), float)) for k, c in counts.items()}, order)
    samples = [b"the matte", "saß the zzz 中".encode(), b"t", texts["aa"], b"\x00\xff"]
    got = model.bits(samples)
    for j, raw in enumerate(samples):
        for k, name in enumerate(model.names):
            assert got[j, k] == pytest.approx(direct_bits(counts[name], raw, order), rel=1e-5)


def test_language_accuracy(spark):
    rows = Q.op9_language_id(spark, "/root/testdata/sf0.01").join(
        table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.99
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_hard_texts(spark, sf_dir):
    rows = {r["doc_id"]: r for r in Q.op9_language_id(spark, sf_dir).collect()}
    for r in table(spark, sf_dir, "documents").collect():
        letter = any(c.isalpha() for c in r["text"] or "")
        assert (rows[r["doc_id"]]["lang_pred"] == "und") == (not letter)
        assert rows[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_chunks_are_in_the_order_of_ids():
    import pyarrow as pa

    from logscope.llm import chunks
    rnd = np.random.default_rng(1)
    ids = np.unique(rnd.integers(-10**12, 10**12, 2000))
    rnd.shuffle(ids)
    cuts = np.sort(ids)[[0, 100, 500, 1500, len(ids) - 1]]
    for parts in (1, 7):
        batch = pa.RecordBatch.from_arrays([pa.array([None, *ids.tolist()]), pa.array(["t"] * (len(ids) + 1))], ["doc_id", "text"])
        found = {}
        for out in chunks.packer(cuts, parts)([batch]):
            for c, blob in zip(out.column(0).to_pylist(), out.column(1).to_pylist()):
                for i in chunks.unpacked(pa.table({"blob": [blob]}))[0]:
                    found[i] = c
        assert len(found) == len(ids) + 1 and found[None] == 0
        order = [found[i] for i in sorted(ids.tolist())]
        assert order == sorted(order) and len(set(order)) > 3 * parts


def test_lists_survive_the_exchange():
    from logscope.llm import chunks
    rnd = np.random.default_rng(2)
    for n in (1, 2, 1000):
        values = np.unique(rnd.integers(0, 1 << 64, n, dtype=np.uint64))
        assert (chunks.decode(chunks.encode(values)) == values).all()
        assert (chunks.decode(chunks.encode(values, 20), 20) == values >> np.uint64(20) << np.uint64(20)).all()
        table = chunks.packs(3, values, 11)
        assert (np.concatenate([chunks.decode(x) for x in table["data"].to_pylist()]) == values).all()
        assert (chunks.among(values, values[::2]) == (np.arange(len(values)) % 2 == 0)).all()


def test_near_copies_at_all_distances(spark):
    """One text with 0 to 12 changed words, in many copies: groups equal those of all pairs."""
    import brute
    rnd = random.Random(17)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    base, rows = [rnd.choice(words) for _ in range(120)], []
    for d in range(220):
        w = list(base)
        for _ in range(rnd.choice((0, 1, 2, 3, 4, 6, 9, 12))):
            k = rnd.randrange(len(w))
            rnd.choice((lambda: w.__setitem__(k, rnd.choice(words)), lambda: w.insert(k, rnd.choice(words)), lambda: w.pop(k)))()
        rows.append((d * 7 % 220, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (85, 80):
        want = {r[0]: r[2] for r in brute.op7(rows, percent)}
        got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs, percent).collect()}
        assert got == want and 3 < len(set(want.values())) < 220


def test_bucket_with_a_small_member_keeps_links(spark):
    """x: 100 shingles, 15 its own; y: the other 85, so exactly 0.85; z: 50 of them. x and y must be compared."""
    classes = lambda k: [k] + [0] * 31
    rows = [(1, 10, 100, classes(15), None, 10), (1, 20, 85, classes(0), None, 20), (1, 30, 50, classes(0), None, 30)]
    rows = spark.createDataFrame(rows, "key long, node long, n int, own array<int>, apart array<int>, group long")
    assert (10, 20) in {(r["a"], r["b"]) for r in neardup.across_groups(rows, 85).collect()}


def test_truncated_copies_and_unique_tails(spark):
    """Short parts of a core and copies with tails of their own in one bucket: no linked pair is ruled out."""
    rnd, sets = random.Random(23), []
    for k in range(80):
        a = rnd.randint(0, 30)
        part = range(a, a + rnd.randint(40, 85 - a)) if k % 2 else range(rnd.randint(75, 85))
        sets.append(set(part) | {1000 * (k + 1) + j for j in range(rnd.randint(0, 18))})
    own = [len(s - set().union(*(t for t in sets if t is not s))) for s in sets]
    rows = [(1, k, len(s), [own[k]] + [0] * 31, None, k) for k, s in enumerate(sets)]
    rows = spark.createDataFrame(rows, "key long, node long, n int, own array<int>, apart array<int>, group long")
    want = {(a, b) for b in range(80) for a in range(b) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    assert want and want <= {(r["a"], r["b"]) for r in neardup.across_groups(rows, 85).collect()}


@pytest.mark.parametrize("piece", [
    "john at mail.com", "john@mail dot com", "john at mail dot co", "john at mail dot no", "john at first dot last dot nz",
    "john [at] mail dot com", "john at mail [dot] com", "john (at) mail.com", "john at mail dot co.uk", "john@mail (dot) first dot museum",
])
def test_marks_in_any_mixture(piece):
    text = f"write to {piece}, please"
    assert ("email", 9, 9 + len(piece)) in {s[:3] for s in pii.find_in(text.encode())}
    assert pii.masked(text.encode()) == "write to [EMAIL], please"


def test_spelled_digits_are_counted_over_the_run():
    piece = "plus 1 five 5 five 0 one 9 nine 2 three 4"
    assert pii.masked(f"call {piece} today".encode()) == "call [PHONE] today"


def test_prose_with_at_and_dots_stays():
    for text in ("visit us at www.example.com", "We looked at example.org today", "we met at home.Then we left", "put it at every dot on the line",
                 "see the page at site.org/page", "look at polka dot dresses", "one 2 two 3 three"):
        assert pii.masked(text.encode()) == text


def test_any_part_of_100_characters_is_found():
    rnd = random.Random(31)
    item = "".join(rnd.choice("abcdefghijklmnop") for _ in range(394))
    index = decontam.Index([(7, item), (8, "".join(rnd.choice("abcdefghijklmnop") for _ in range(230)))])
    for k in range(len(item) - 99):
        assert [r[0] for r in index.find(f"zz yy {item[k:k + 100]} xx ww")] == [7]


def test_short_items_on_word_borders(spark):
    items = [(1, "What is the capital of France?"), (2, "x = 4"), (3, "What is the capital of  france?"), (4, ""), (5, None)]
    docs = [(10, "what is the capital of FRANCE?"), (11, "x = 42"), (12, "Solve: x = 4, please, and explain in full sentences"), (13, "wax = 4"), (14, None)]
    items, docs = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    got = {tuple(r) for r in decontam.find_leaks(docs, items).collect()}
    assert got == {(10, 1, 0, 30, 0, True), (10, 3, 0, 30, 0, True), (12, 2, 7, 12, 0, True)}
    assert {r["doc_id"] for r in decontam.keep_clean(docs, items).collect()} == {11, 12, 13, 14}


SECRET = "password = hunter22hunter"


@pytest.mark.parametrize("data", [
    SECRET.encode("utf-16"), SECRET.encode("utf-16-be"), ("é " + SECRET).encode("utf-16-le"), SECRET.encode("utf-32"), ("\ufeff" + SECRET).encode(),
    ("\x1b[31m" + SECRET).encode(), b"\x00\xff\x0c" + SECRET.encode(), ("a\u00a0b " + SECRET).encode(), gzip.compress(b"\x00\xfe" * 300 + SECRET.encode()),
    base64.b64encode(SECRET.encode("utf-16")),
])
def test_secrets_in_layers_that_are_not_plain_text(data):
    text = "before " + base64.b64encode(data).decode() + " after"
    assert ("assign", 7, len(text) - 6) in secrets.scan_layers(text)[0]


@pytest.mark.parametrize("wrap, columns", [(w, c) for w in ("\n", "\r\n", "\n  ", "\n> ", "\\n") for c in (16, 64, 76)])
def test_secrets_in_wrapped_base64(wrap, columns):
    rnd = random.Random(9)
    noise = " ".join(rnd.choice("abcdefghijk") * rnd.randint(3, 9) + str(rnd.random()) for _ in range(20))
    for data in ((noise + SECRET + noise).encode(), gzip.compress((noise + SECRET).encode())):
        for shift in range(0, columns, 5):
            body = base64.b64encode(b"x" * shift + data if data[:1] != b"\x1f" else data).decode()
            text = "key: " + wrap.join(body[k:k + columns] for k in range(0, len(body), columns)) + " end"
            assert ("assign", 5, len(text) - 4) in secrets.scan_layers(text)[0]


def test_secrets_in_later_members_and_beyond_the_block():
    import bz2
    import lzma

    import zstandard
    pack = [gzip.compress, zlib.compress, bz2.compress, lzma.compress, zstandard.ZstdCompressor().compress]
    b64 = lambda data: base64.b64encode(data).decode()
    found = lambda text, *most: any(k == "assign" for k, _, _ in secrets.scan_layers(text, *most)[0])
    for one in pack:
        assert found(b64(one(b"first\n") + one(SECRET.encode())))
        assert found(b64(one(one(b"first\n") + one(SECRET.encode()))))
        for before in (0, 990, 2000, 5000, 3 << 20):
            for sign in (b"-", "é".encode()):
                assert found(b64(one(sign * before + b" " + SECRET.encode() + b" " + b"+" * 3000)), 2000 if before < 10000 else 1 << 19)
        assert not found(b64(one(b"nothing") + one(b"here")))
    for one in pack[:2]:
        assert found(b64(one(SECRET.encode() * 50 + random.Random(1).randbytes(90000))[:80000]))  # cut off
    assert found(b64(gzip.compress(b"first\n") + bz2.compress(SECRET.encode())))
