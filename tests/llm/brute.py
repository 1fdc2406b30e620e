"""Plain Python versions of the queries' contracts, for small tables. rows: [(doc_id, text)]."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def op1(rows, width=20):
    rows = sorted(rows)
    words = [(d, WORD.findall(t or "")) for d, t in rows]
    seen, out = set(), []
    for d, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            key = tuple(w[k:k + width])
            if key in seen:
                gone[k:k + width] = [True] * width
            seen.add(key)
        out.append((d, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def spans_digest(d, kinds, base):
    base = sorted(base, key=lambda s: (s[1], kinds.index(s[0])))
    counts = Counter(s[0] for s in base)
    return (d, *[counts[k] for k in kinds], sha(",".join(f"{k}:{a}:{b}" for k, a, b in base)))


def op2(rows):
    kinds, out = ("assign", "access", "hex"), []
    for d, t in rows:
        t = t or ""
        base = [("assign", *m.span()) for m in re.finditer(
            r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t) if len(m[2]) >= 6]
        base += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        base += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
        out.append(spans_digest(d, kinds, base))
    return out


def op3(rows, width=400):
    rows = [(d, (t or "").encode()) for d, t in sorted(rows, key=lambda r: (r[0], r[1] or ""))]
    count = Counter(b[k:k + width] for _, b in rows for k in range(len(b) - width + 1))
    out = []
    for d, b in rows:
        until, kept, spans, gone, before = 0, bytearray(), 0, 0, False
        for k in range(len(b)):
            if k + width <= len(b) and count[b[k:k + width]] > 1:
                until = k + width
            if k < until:
                gone += 1
                spans += not before
                before = True
            else:
                kept.append(b[k])
                before = False
        out.append((d, len(b), gone, spans, sha(bytes(kept))))
    return out


def op5(rows):
    out = []
    for d, t in rows:
        t = t or ""
        w = WORD.findall(t)
        wins = Counter(tuple(w[k:k + 3]) for k in range(len(w) - 2))
        rep = [False] * len(w)
        for k in range(len(w) - 2):
            if wins[tuple(w[k:k + 3])] > 1:
                rep[k:k + 3] = [True] * 3
        lines = [x for x in t.split("\n") if WORD.search(x)]
        dup = sum(x in lines[:k] for k, x in enumerate(lines))
        out.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, sum(rep),
                    len(w) < 50 or 100 * sum(rep) > 50 * len(w)))
    return out


def op6(rows):
    return [(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows]


def shingles(t, width=5):
    w = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
    return {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())


def op7(rows, percent=85):
    sets = [(d, shingles(t)) for d, t in sorted(rows, key=lambda r: r[0])]
    up = list(range(len(sets)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    at = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for x in s:
            at[x].append(k)
    shared = Counter((a, b) for ks in at.values() for j, b in enumerate(ks) for a in ks[:j])
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a][1]) + len(sets[b][1]) - n):
            x, y = sorted((top(a), top(b)))
            up[y] = x
    return [(d, len(s), sets[top(k)][0], sets[top(k)][0] == d) for k, (d, s) in enumerate(sets)]


def luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(digits))) % 10 == 0


def op8(rows):
    kinds, out = ("email", "ip", "card", "phone"), []
    for d, t in rows:
        t = t or ""
        number = lambda s: re.sub("[^0-9]", "", s)
        base = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        base += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
                 if all(int(p) <= 255 for p in m[0].split("."))]
        base += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t)
                 if 14 <= len(number(m[0])) <= 19 and luhn(number(m[0]))]
        base += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(number(m[0])) <= 15]
        out.append(spans_digest(d, kinds, base))
    return out


def op10(rows, path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    out = []
    for d, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        out.append((d, len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    return out


def op13_counts(rows, least_length=7):
    counts = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= least_length:
                counts[run] += 1
    return counts


def variants(words):
    """(word, form, root, n, n_near, form_n) by deleting every character once."""
    by_rest, near = defaultdict(set), defaultdict(set)
    for w in words:
        for k in range(len(w)) if len(w) < 1000 else ():
            rest = w[:k] + w[k + 1:]
            by_rest[k, rest].add(w)
            if rest in words:
                near[w].add(rest)
                near[rest].add(w)
    long = [w for w in words if len(w) >= 1000]
    for a in long:  # few: a common prefix and suffix that leave one character
        for b in long:
            if a != b and abs(len(a) - len(b)) <= 1:
                p = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
                if a[p + (len(a) >= len(b)):] == b[p + (len(b) >= len(a)):]:
                    near[a].add(b)
    for group in by_rest.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return sorted((w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items())


def op13(rows):
    return variants({w: n for w, n in op13_counts(rows).items() if n >= 2})
