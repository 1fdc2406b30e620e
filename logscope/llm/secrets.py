"""Secret scan with a recursive decoding worklist.

Every text is scanned as it stands (the base spans). Then a worklist unwraps
layers - URL escapes, Unicode escapes and character references, base64, and
compressed data inside base64 - and scans each layer again. New layers go back
on the list until none is new (a layer already seen at the same place is not
taken again, so self-reproducing data ends). Each layer carries, for every
character, the range of source code points it came from, and hits are reported
there.

Defined results: null text counts as empty; an empty text has no spans; a very
long text is one layer like any other; repeated rows give one row each; an empty table gives
an empty result; other columns of the table are ignored. Decoded bytes that are not text are scanned too, with replacement of bad
bytes, and once more without the NUL bytes between characters (UTF-16, UTF-32). Base64 goes on over line breaks.
Compressed data is decompressed to its end, member after member; more than ``max_layer_bytes`` of output are scanned in
blocks of that size that overlap by a quarter, so memory is bounded and output is not.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import lzma
import re
import zlib
from collections.abc import Iterator
from html import unescape
from itertools import chain
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame

from logscope.llm.common import Mapped, id_and_text, id_type, parts, raw_bytes

# The kinds and their patterns, in the order in which spans tie.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24

KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
LONG_HEX = re.compile(rb"[0-9a-f]{24}")
URL_RUN = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE_RUN = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2})+|&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});")
ESCAPE = re.compile(r"\\(?:u\{([0-9A-Fa-f]+)\}|[uUx]([0-9A-Fa-f]+))")
TOKEN64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{12,}={0,2}")
LONG_TOKEN64 = re.compile(rb"[A-Za-z0-9+/_-]{12}")
WRAPPED64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{12,}(?:[ \t]*(?:\r?\n|(?:\\r)?\\n)[ \t>]*[A-Za-z0-9+/_-]+)+={0,2}")
BREAK = re.compile(r"[ \t]*(?:\r?\n|(?:\\r)?\\n)[ \t>]*")
WIDE = re.compile(rb"[\t\r\n\x20-\x7e](?:\x00{1,3}[\t\r\n\x20-\x7e]){5,}")
MAX_LAYER_BYTES = 64 << 20
PIECE = 1 << 20
SPACES = str.maketrans("\t\r\n", "   ")


def scan(text: str) -> list:
    """(kind, start, end) of the base patterns."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= MIN_HEX]
    return out


def may_hold_secret(raw: bytes) -> bool:
    low = raw.lower()
    return any(k in low for k in KEYWORDS) or b"AKIA" in raw or LONG_HEX.search(raw) is not None


def may_hold_layer(raw: bytes) -> bool:
    return b"%" in raw or b"\\" in raw or b"&#" in raw or LONG_TOKEN64.search(raw) is not None


def url_layer(layer: Mapped):
    edits = [(m.start(), m.end(), unquote(m[0], errors="replace")) for m in URL_RUN.finditer(layer.text)]
    return layer.rewrite(edits) if edits else None


def escape_layer(layer: Mapped):
    def plain(run: str) -> str:
        if run[0] == "&":
            return unescape(run)
        text = ESCAPE.sub(lambda m: chr(c) if (c := int(m[1] or m[2], 16)) <= 0x10FFFF else m[0], run)
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    edits = [(m.start(), m.end(), new) for m in ESCAPE_RUN.finditer(layer.text) if (new := plain(m[0])) != m[0]]
    return layer.rewrite(edits) if edits else None


def opener(head: bytes):
    """The decompressor of the format that ``head`` starts with, if any."""
    if head[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if head[:1] == b"\x78" and len(head) > 2 and int.from_bytes(head[:2], "big") % 31 == 0:
        return zlib.decompressobj()
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    if head[:4] == b"\x28\xb5\x2f\xfd":
        return zstandard.ZstdDecompressor().decompressobj()
    return None


def pull(tool, data: bytes) -> tuple:
    """Some output for ``data``, and what of it is still to be given."""
    if hasattr(tool, "needs_input"):  # bz2 and lzma hold their input
        return tool.decompress(data, PIECE), b""
    if hasattr(tool, "copy"):  # zlib
        return tool.decompress(data, PIECE), tool.unconsumed_tail
    return tool.decompress(data[:256]), data[256:]  # zstd has no limit on output, so little input at a time


def members(pieces: Iterator) -> Iterator:
    """Decompressed pieces of compressed members that follow one another; what is not compressed as it is."""
    data = next(pieces, b"")
    while data:
        while len(data) < 6 and (more := next(pieces, b"")):
            data += more
        tool, whole, any_output = opener(data), data, False
        if tool is None:
            yield data
            yield from pieces
            return
        try:
            while not tool.eof:
                out, data = pull(tool, data)
                if out:
                    any_output = True
                    yield out
                elif not data and not (data := next(pieces, b"")):
                    return  # cut off: what there was has been given
            data = tool.unused_data + data
        except (zlib.error, OSError, ValueError, EOFError, lzma.LZMAError, zstandard.ZstdError):
            if not any_output:
                yield whole
                yield from pieces
                return
            following = whole.find(whole[:3], 3)  # a damaged member: the next one of its kind goes on
            data = whole[following:] if following > 0 else b""
        if not data:
            data = next(pieces, b"")


def unpacked(data: bytes, most: int) -> Iterator:
    """``data`` in overlapping blocks, decompressed as long as it is compressed."""
    pieces, seen = iter([data]), set()
    while True:
        head, size = [], 0
        for p in pieces:
            head.append(p)
            size += len(p)
            if size >= most:
                break
        head = b"".join(head)
        if opener(head) is None or (digest := xxhash.xxh3_128_intdigest(head)) in seen:
            break
        seen.add(digest)
        pieces = members(chain([head], pieces))
    block = bytearray()
    new = False
    for p in chain([head], pieces):
        for k in range(0, len(p), most):
            block += p[k:k + most]
            new = True
            if len(block) > most:
                yield bytes(block)
                del block[:-(most // 4 + 1)]
                new = False
    if new:
        yield bytes(block)


def decoded(body: str, most: int) -> Iterator:
    """The texts of a base64 string that may hold a secret or a layer, or are plain text."""
    body = body.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        body = body[:-1]
    try:
        data = base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return
    for block in unpacked(data, most):
        wide = b"\n".join(m[0].replace(b"\0", b"") for m in WIDE.finditer(block)) if b"\0" in block else b""
        for raw in (block, wide):
            text = None
            if may_hold_secret(raw) or may_hold_layer(raw):
                text = raw.decode("utf-8", "replace")
            elif (plain := raw.decode("utf-8", "replace")).translate(SPACES).isprintable() and "\ufffd" not in plain:
                text = plain
            if text:
                yield text


def base64_layers(layer: Mapped, most: int):
    tokens = [(m.start(), m.end(), m[0]) for m in TOKEN64.finditer(layer.text)]
    tokens += [(m.start(), m.end(), BREAK.sub("", m[0])) for m in WRAPPED64.finditer(layer.text)]
    for start, end, body in tokens:
        place = None
        for text in decoded(body, most):
            a, b = place = place or layer.source(start, end)
            yield Mapped(text, np.broadcast_to(np.int64(a), len(text)), np.broadcast_to(np.int64(b), len(text)))


def sublayers(layer: Mapped, most: int):
    for make in (url_layer, escape_layer):
        if (new := make(layer)) is not None:
            yield new
    yield from base64_layers(layer, most)


def scan_layers(text: str, most: int = MAX_LAYER_BYTES) -> tuple:
    """Spans (kind, start, end) found only in decoded layers, and the number of layers."""
    work, seen, found = [iter([Mapped(text)])], set(), set()
    while work:  # layers are made one by one, so few are held at a time
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        key = (xxhash.xxh3_128_intdigest(layer.text.encode("utf-8", "surrogatepass")),
               int(layer.start[0]) if len(layer.text) else 0, int(layer.end[-1]) if len(layer.text) else 0)
        if key in seen:
            continue
        seen.add(key)
        if len(seen) > 1:
            found.update((kind, *layer.source(a, b)) for kind, a, b in scan(layer.text))
        work.append(sublayers(layer, most))
    return found, len(seen) - 1


def scan_document(raw, most: int = MAX_LAYER_BYTES) -> tuple:
    if not raw:
        return [], 0
    text, base, layers = None, [], (set(), 0)
    if may_hold_secret(raw):
        text = raw.decode("utf-8", "replace")
        base = scan(text)
    if may_hold_layer(raw):
        layers = scan_layers(text if text is not None else raw.decode("utf-8", "replace"), most)
    own = set(base)
    return [(*s, True) for s in base] + [(*s, False) for s in sorted(layers[0] - own)], layers[1]


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])


def span_array(rows: list) -> pa.Array:
    names = ("kind", "start", "end", "base")
    return pa.array([[dict(zip(names, s)) for s in spans] for spans in rows], pa.list_(SPAN))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 max_layer_bytes: int = MAX_LAYER_BYTES) -> DataFrame:
    """One row per document: (doc_id, spans array<struct<kind,start,end,base>>, n_layers).

    Map only: no shuffle, and a lost task is simply run again.
    """
    def run(batches):
        for batch in parts(batches):
            found = [scan_document(raw, max_layer_bytes) for raw in raw_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), span_array([f[0] for f in found]), pa.array([f[1] for f in found], pa.int64())],
                ["doc_id", "spans", "n_layers"])

    two = id_and_text(docs, id_col, text_col)
    return two.mapInArrow(run, f"doc_id {id_type(two)}, spans array<struct<kind:string,start:bigint,end:bigint,base:boolean>>, n_layers bigint")
