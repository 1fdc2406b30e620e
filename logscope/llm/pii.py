"""Personal data with offset-preserving deobfuscation.

Base identifiers are found in the text as it stands. Texts that show a disguise
also go through a chain of transducers - look-alike letters and full-width or
mathematical forms, invisible characters, at/dot disguises, spelled digits -
each of which rewrites the string and keeps, for every character, the source
range it stands for. Identifiers found in the normal form are reported at their
source characters.

Defined results: null text counts as empty and has no spans; very long texts
are one string like any other, and runs of one kind take linear time; spans that start together are in the order of KINDS;
repeated rows give one row each; an empty table gives an empty result; other columns
are ignored by ``find_pii`` and kept by ``redact``.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame

from logscope.llm.common import Mapped, id_and_text, id_type, parts, raw_bytes
from logscope.llm.secrets import span_array

# The kinds and their patterns, in the order in which spans tie.
KINDS = ("email", "ip", "card", "phone")
# (Long runs take linear time: an address is matched from its @ outwards, an IP takes the digits it fails on
# along - no match can begin inside them - and a bracket is matched before the white space in front of it.)
NAME_CHARACTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
AT_HOST = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]++(?:(\.[0-9]++)(\.[0-9]++)(\.[0-9]++))?")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SEPARATORS = re.compile(r"[^0-9]")

# Letters of other scripts that look like a Latin letter.
LOOKALIKES = dict(zip("аеорсухіјѕԁԛԝһӏАВЕКМНОРСТУХІЈЅαορντικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
                      "aeopcyxijsdqwhlABEKMHOPCTYXIJSaopvtikABEZHIKMNOPTYX"))
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5",
          "six": "6", "seven": "7", "eight": "8", "nine": "9"}
MARKS = {"at": "@", "@": "@", "dot": ".", ".": ".", "punkt": ".", "punto": ".", "point": ".", "arroba": "@"}

ODD = re.compile("[\u00ad\u0370-\u052f\u2000-\u206f\uff01-\uff5e\ufeff\u2460-\u24ff\U0001d400-\U0001d7ff]")
BRACKETED = re.compile(r"[\[({<]\s*(at|@|dot|\.|punkt|punto|point|arroba)\s*[\])}>]\s*", re.I)
# Endings of host names that make words between `at` and `dot` an address.
ENDINGS = "com|org|net|edu|gov|mil|int|info|biz|io|ai|dev|app|eu|uk|us|ca|au|de|at|ch|fr|be|nl|it|es|pt|mx|br|ar|se|dk|pl|ru|jp|cn|in"
SPOKEN = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+(\s+at\s+)[A-Za-z0-9-]+(?:\s+dot\s+[A-Za-z0-9-]+)*\s+dot\s+(?:{ENDINGS})(?![A-Za-z0-9-])", re.I)
SPOKEN_PART = re.compile(r"\s+(at|dot)\s+", re.I)
HOST = r"[A-Za-z0-9-]+(?:(?:\.|\s+dot\s+)[A-Za-z0-9-]+)*(?:\.|\s+dot\s+)(?P<ending>[A-Za-z]{2,})(?![A-Za-z0-9-])"
MIXED = re.compile(rf"(?<![A-Za-z0-9._%+-])(?P<name>[A-Za-z0-9._%+-]+)(?:@|(?P<at>\s+at\s+))(?P<host>{HOST})", re.I)
MAY_MIX = re.compile(r"(?:@|\sat\s+)[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\s+dot\s|\sat\s+[A-Za-z0-9-]+\.[A-Za-z0-9-]", re.I)
# A spoken `at` after one of these words, with a host written out, is prose ("visit us at x.org"); so is
# a spoken `dot` after one of these, with an ending outside the list above ("at one dot on the map").
NOT_NAMES = frozenset("""i me you he him she her it we us they them this that these those here there who which what is are was were be been
being am and or but not as so than then now only also just even still out up down off over look looks looked looking see seen found find
available hosted located based live lives lived work works worked working stay stayed meet met start starts started stop stopped arrive
arrived visit visited online stored published posted listed defined called read reading stands sits aimed one two all both each""".split())
NOT_HOSTS = frozenset("""a an the this that these those each every any some no one two three four five six seven eight nine ten another
his her its my our your their which what red blue green black white yellow polka single small big tiny""".split())
WORD = "zero|oh|one|two|three|four|five|six|seven|eight|nine"
SPELLED = re.compile(rf"(?:plus\s+)?\b(?:{WORD}|[0-9]+)(?:(?:\s*(?:-|\.|,|\bdot\b|\bdash\b)\s*|\s+)(?:{WORD}|[0-9]+)\b)+", re.I)
SPELLED_DIGIT = re.compile(rf"\b(?:{WORD})\b", re.I)
SPELLED_PART = re.compile(rf"plus\s+|\b(?:{WORD})\b|\s*\bdot\b\s*|\s*\bdash\b\s*|\s+", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def emails(text: str):
    """(start, end) of the addresses, leftmost and non-overlapping: [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+"""
    free, at = 0, text.find("@")  # free: where a name may begin
    while at >= 0:
        start = free + len(text[free:at].rstrip(NAME_CHARACTERS))
        host = AT_HOST.match(text, at) if start < at else None
        if host:
            yield start, host.end()
        free = host.end() if host else at + 1
        at = text.find("@", free)


def detect(text: str) -> list:
    """(kind, start, end) of the base patterns; failing matches are dropped without a retry."""
    out = []
    if "@" in text:
        out += [("email", a, b) for a, b in emails(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if m[1] and all(map(small, m[0].split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = SEPARATORS.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text)
                if 10 <= len(SEPARATORS.sub("", m[0])) <= 15]
    return out


def letters(layer: Mapped) -> Mapped:
    """Look-alikes, compatibility forms and invisible characters."""
    edits = []
    for m in ODD.finditer(layer.text):
        c = m[0]
        new = LOOKALIKES.get(c) or ("" if c in INVISIBLE else unicodedata.normalize("NFKC", c))
        if new != c and new.isascii():
            edits.append((m.start(), m.end(), new))
    return layer.rewrite(edits) if edits else layer


def marks(layer: Mapped) -> Mapped:
    """(at), [dot] and spoken `name at host dot org`, in any mixture."""
    edits = list(bracketed(layer.text))
    layer = layer.rewrite(edits) if edits else layer
    edits = [(p.start(), p.end(), MARKS[p[1].lower()])
             for m in SPOKEN.finditer(layer.text) for p in SPOKEN_PART.finditer(layer.text, m.start(), m.end())]
    layer = layer.rewrite(edits) if edits else layer
    edits = [(p.start(), p.end(), MARKS[p[1].lower()]) for m in MIXED.finditer(layer.text) if address(layer, m)
             for p in SPOKEN_PART.finditer(layer.text, m.start(), m.end())]
    return layer.rewrite(edits) if edits else layer


def bracketed(text: str):
    """(start, end, mark) of bracketed marks with the white space around them."""
    free = 0
    for m in BRACKETED.finditer(text):
        yield free + len(text[free:m.start()].rstrip()), m.end(), MARKS[m[1].lower()]
        free = m.end()


def address(layer: Mapped, m) -> bool:
    """Whether a match of MIXED is an address: `at` and `dot` each literal, bracketed (rewritten before) or spoken."""
    if not m["at"]:
        return True
    a, b = m.span("host")
    if any(c == "." and layer.end[k] - layer.start[k] > 1 for k, c in enumerate(m["host"], a)):
        return True
    labels = re.split(r"\.|\s+dot\s+", m["host"], flags=re.I)
    if len(m["host"].split()) > 1:  # a spoken dot
        return labels[0].lower() not in NOT_HOSTS
    new_sentence = m["ending"][0].isupper() and labels[-2].islower()
    return not (m["name"].lower() in NOT_NAMES or labels[0].lower() == "www" or new_sentence or layer.text[b:b + 1] == "/")


def spelled(text: str) -> bool:
    return len(SPELLED_DIGIT.findall(text)) >= 4


def digits(layer: Mapped) -> Mapped:
    """`plus one five five five ...` as digits; runs with fewer than four spelled digits stay."""
    edits = []
    for m in SPELLED.finditer(layer.text):
        if not spelled(m[0]):
            continue
        for p in SPELLED_PART.finditer(layer.text, m.start(), m.end()):
            word = p[0].strip().lower()
            new = {"plus": "+", "dot": ".", "dash": "-", "": ""}.get(word, DIGITS.get(word))
            edits.append((p.start(), p.end(), new))
    return layer.rewrite(edits) if edits else layer


def disguised(text: str) -> bool:
    if not text.isascii() and ODD.search(text):
        return True
    low = text.lower()
    return bool((("at" in low or "@" in low) and BRACKETED.search(text)) or ("dot" in low and SPOKEN.search(text)) or MAY_MIX.search(text)
                or (spelled(text) and any(spelled(m[0]) for m in SPELLED.finditer(text))))


def find_in(raw) -> list:
    """Spans (kind, start, end, base) of one text."""
    if not raw:
        return []
    text = raw.decode("utf-8", "replace")
    base = detect(text)
    out = [(*s, True) for s in base]
    if disguised(text):
        normal = digits(marks(letters(Mapped(text))))
        found = {(kind, *normal.source(a, b)) for kind, a, b in detect(normal.text)}
        out += [(*s, False) for s in sorted(found - set(base))]
    return out


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (doc_id, spans array<struct<kind,start,end,base>>). Map only."""
    def run(batches):
        for batch in parts(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), span_array([find_in(raw) for raw in raw_bytes(batch.column(1))])], ["doc_id", "spans"])

    two = id_and_text(docs, id_col, text_col)
    return two.mapInArrow(run, f"doc_id {id_type(two)}, spans array<struct<kind:string,start:bigint,end:bigint,base:boolean>>")


def masked(raw):
    """The text with each identifier replaced by its kind; overlapping spans are masked together."""
    if raw is None:
        return None
    text, out, at = raw.decode("utf-8", "replace"), [], 0
    spans = sorted((a, -b, KINDS.index(kind)) for kind, a, b, _ in find_in(raw))
    for k, (a, b, kind) in enumerate(spans):
        if -b <= at:
            continue
        if a >= at:
            out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = -b
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """All columns of ``docs`` with the text masked; ``length_col``, where there is one, follows the text."""
    names = docs.columns
    kind = dict(docs.dtypes)

    def run(batches):
        for batch in parts(batches):
            at = batch.schema.get_field_index(text_col)
            texts = [masked(raw) for raw in raw_bytes(batch.column(at))]
            cols = list(batch.columns)
            cols[at] = pa.array(texts, batch.schema.field(at).type)
            if length_col in names:
                k = batch.schema.get_field_index(length_col)
                cols[k] = pa.array([None if t is None else len(t) for t in texts], batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    if length_col not in names or kind[length_col] not in ("bigint", "int"):
        length_col = None
    return docs.mapInArrow(run, docs.schema)
