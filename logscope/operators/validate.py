"""Strict record validation and projection (parse → check → flatten).

A line is valid when it is a JSON object whose required fields are present
with the exact JSON type, optional fields are a string or null, ``message`` is
an object, its bytes are valid UTF-8 (the reader keeps bytes as they are; U+FFFD itself is a character like any other), and ``timestamp`` is an RFC 3339 date-time with an offset. Unknown
fields are ignored. ``from_json`` is not used: it casts numbers to strings and
fills missing fields with NULL, which would let invalid records through.

Every check is a built-in expression over one ``VARIANT`` parse per line, so
the whole job is one narrow, codegen'd projection of the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logscope.functions.text import WHITESPACE, trim_whitespace
from logscope.schema import MESSAGE_FIELDS, RECORD_COLUMNS, RECORD_FIELDS

# The ASCII white space JSON allows around a value; RFC 3339
# date-time with a required offset ("Z" or +hh:mm), date/time separator T, t
# or a space, optional fraction.
ASCII_WS = " \t\n\r\x0b\x0c"
TIMESTAMP_PATTERN = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def trim_line(df: DataFrame, value: str = "value", out: str = "raw") -> DataFrame:
    """Trim Unicode white space; fast ASCII path, the regex only runs when an
    end character is still white space."""
    df = df.withColumn("_t", F.btrim(F.col(value), F.lit(ASCII_WS)))
    t = F.col("_t")
    edge = F.concat(F.substring(t, 1, 1), F.substring(t, -1, 1))
    return df.withColumn(out, F.when(edge.rlike(WHITESPACE), trim_whitespace(t)).otherwise(t)).drop("_t")


def _vtype(v: Column, path: str) -> Column:
    """JSON type name of ``path`` (STRING, BOOLEAN, VOID, ...); NULL if absent."""
    return F.schema_of_variant(F.variant_get(v, path, "variant"))


def _type_ok(v: Column, path: str, kind: str, required: bool) -> tuple[Column, Column]:
    """(present, type-ok) for one field."""
    present = F.variant_get(v, path, "variant").isNotNull()
    if kind == "object":
        ok = F.try_variant_get(v, path, "map<string,variant>").isNotNull()
    elif kind == "any":
        ok = F.lit(True)
    else:
        t = _vtype(v, path)
        want = "STRING" if kind == "string" else "BOOLEAN"
        ok = (t == want) if required else t.isin(want, "VOID")
    return present, ok


def record_error(v: Column, raw: Column) -> Column:
    """Detailed reason a line is rejected, or NULL for a valid record (first
    failing check in field order wins)."""
    checks: list[tuple[Column, str]] = [
        (~F.is_valid_utf8(raw), "invalid UTF-8"),
        (v.isNull(), "invalid JSON"),
        (F.try_variant_get(v, "$", "map<string,variant>").isNull(), "expected a JSON object"),
    ]
    twice = _repeated_field(raw)
    repeated = F.when(twice.isNotNull(), F.concat(F.lit("duplicate field `"), twice, F.lit("`")))
    for name, kind, required in RECORD_FIELDS:
        path = f"$.{name}"
        present, ok = _type_ok(v, path, kind, required)
        if required:
            checks.append((~present, f"missing field `{name}`"))
            checks.append((~ok, f"invalid type for `{name}`: expected {kind}"))
        else:
            checks.append((present & ~ok, f"invalid type for `{name}`: expected {kind} or null"))
    for name, kind in MESSAGE_FIELDS:
        if kind == "string":
            path = f"$.message.{name}"
            present, ok = _type_ok(v, path, kind, False)
            checks.append((present & ~ok, f"invalid type for `message.{name}`: expected string or null"))
    ts = F.try_variant_get(v, "$.timestamp", "string")
    checks.append((~ts.rlike(TIMESTAMP_PATTERN) | _utc_timestamp(ts).isNull(), "invalid timestamp"))
    first, rest = checks[:3], checks[3:]
    return F.coalesce(*[F.when(bad, F.lit(msg)) for bad, msg in first], repeated, *[F.when(bad, F.lit(msg)) for bad, msg in rest])


def _utc_timestamp(ts_text: Column) -> Column:
    """RFC 3339 text with offset → UTC wall time as TIMESTAMP_NTZ, whatever the session's time zone."""
    norm = F.regexp_replace(F.upper(ts_text), " ", "T")
    micros = F.unix_micros(norm.try_cast("timestamp"))
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        secs=(micros.cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)"))


def content_json(content: Column) -> Column:
    """Compact JSON text of any content value; JSON null or absent → SQL NULL."""
    return F.when(content.isNull() | F.is_variant_null(content), F.lit(None).cast("string")).otherwise(F.to_json(content))


def content_text(content_json_text: Column) -> Column:
    """Plain text of stored content: the string itself, or the ``text`` parts of an array joined by newlines."""
    v = F.try_parse_json(content_json_text)
    as_string = F.when(_is_string(v), F.variant_get(v, "$", "string"))
    parts = F.try_variant_get(v, "$", "array<variant>")
    texts = F.filter(F.transform(parts, lambda p: F.try_variant_get(p, "$.text", "string")), lambda x: x.isNotNull())
    return F.coalesce(as_string, F.array_join(texts, "\n"))


def _is_string(v: Column) -> Column:
    return F.schema_of_variant(v) == "STRING"


def project_from_path(file_path: Column) -> Column:
    """Name of the file's immediate parent folder; ``unknown`` when there is none."""
    parent = F.try_element_at(F.split(file_path, "/"), F.lit(-2))
    return F.coalesce(F.when(parent != "", parent), F.lit("unknown"))


def _repeated_field(raw: Column) -> Column:
    """The first record field that a line gives twice, or NULL; other fields may repeat, they are ignored."""
    known = F.array(*[F.lit(name) for name, _, _ in RECORD_FIELDS])
    keys = F.filter(F.json_object_keys(raw), lambda k: F.array_contains(known, k))
    twice = F.filter(keys, lambda k: F.size(F.filter(keys, lambda other: other == k)) > 1)
    return F.when(F.size(F.array_distinct(keys)) < F.size(keys), F.try_element_at(twice, F.lit(1)))


def _shape_pattern(fields) -> str:
    """Regex over ``schema_of_variant`` of the checked fields (keys come sorted)."""
    want = {"string": "STRING", "boolean": "BOOLEAN"}
    parts = []
    for name, kind, required in sorted(fields, key=lambda f: f[0]):
        t = want[kind]
        parts.append(f"{name}: {t}" if required else f"{name}: ({t}|VOID)")
    return "^OBJECT<" + ", ".join(parts) + ">$"


_SCALARS = [f for f in RECORD_FIELDS if f[1] in ("string", "boolean")]
_MSG_SCALARS = [(n, k, False) for n, k in MESSAGE_FIELDS if k == "string"]
TOP_SHAPE = _shape_pattern(_SCALARS)
MESSAGE_SHAPE = _shape_pattern(_MSG_SCALARS)
_TOP_VARIANTS = "struct<" + ", ".join(f"{n}: variant" for n, _, _ in _SCALARS) + ">"
_MSG_VARIANTS = "struct<" + ", ".join(f"{n}: variant" for n, _, _ in _MSG_SCALARS) + ">"
_TOP_STRINGS = "struct<" + ", ".join(f"{n}: string" for n, k, _ in _SCALARS if k == "string") + ">"


def _shape(v: Column, path: str, struct_type: str) -> Column:
    """Type summary of the named fields of the object at ``path``; NULL if not an object."""
    return F.schema_of_variant(F.to_variant_object(F.try_variant_get(v, path, struct_type)))


def quick_error(v: Column, raw: Column) -> Column:
    """Compact check: the exact JSON types of all fields in two regex tests.

    The scalar fields are pulled into one struct of variants and their type
    summary must match the expected shape; ``message`` must be an object whose
    string fields are string or null. ``explain_errors`` names the field for
    rejected lines.
    """
    top = _shape(v, "$", _TOP_VARIANTS)
    msg = _shape(v, "$.message", _MSG_VARIANTS)
    ts = F.try_variant_get(v, "$.timestamp", "string")
    return F.coalesce(
        F.when(~F.is_valid_utf8(raw), F.lit("invalid UTF-8")),
        F.when(v.isNull(), F.lit("invalid JSON")),
        F.when(top.isNull(), F.lit("expected a JSON object")),
        F.when(_repeated_field(raw).isNotNull(), F.lit("invalid record")),
        F.when(~top.rlike(TOP_SHAPE), F.lit("invalid record")),
        F.when(msg.isNull() | ~msg.rlike(MESSAGE_SHAPE), F.lit("invalid record")),
        F.when(~ts.rlike(TIMESTAMP_PATTERN) | _utc_timestamp(ts).isNull(), F.lit("invalid timestamp")),
    )


def parse_lines(lines: DataFrame) -> DataFrame:
    """Lines → checked records.

    Input columns: ``file_path``, ``block_start``, ``pos``, ``value`` (plus any
    others, kept). Blank lines are dropped here. Output adds ``error`` (NULL
    when valid), ``raw`` (the trimmed line) and the record columns, which are
    NULL for invalid lines. Sets ``spark.sql.variant.allowDuplicateKeys`` on the session
    (``get_session`` sets it as well), since a repeated key must not fail the parse.
    """
    # A repeated key must not fail the parse: unknown fields are ignored, and record fields are checked by name.
    lines.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    df = trim_line(lines).where(F.col("raw") != "").drop("value")
    v = F.try_parse_json(F.col("raw"))
    # One parse per line. The checked record is produced by a generator
    # (``inline`` of a one-element array), so a later filter on ``error`` stays
    # above it instead of being pushed down with the parse inlined into it.
    record = F.struct(
        quick_error(v, F.col("raw")).alias("error"),
        F.try_variant_get(v, "$", _TOP_STRINGS).alias("s"),
        F.try_variant_get(v, "$.message", "struct<role: string, content: variant>").alias("m"),
    )
    produced = {"value", "raw", "error", "project_path", *RECORD_COLUMNS}
    keep = [c for c in lines.columns if c not in produced]
    df = df.select(*keep, "raw", F.inline(F.array(record)))
    valid = F.col("error").isNull()

    def s(field: str) -> Column:
        return F.when(valid, F.col(f"s.{field}"))

    return df.select(
        *keep,
        "raw",
        "error",
        s("uuid").alias("uuid"),
        s("parentUuid").alias("parent_uuid"),
        s("sessionId").alias("session_id"),
        s("userType").alias("user_type"),
        s("type").alias("message_type"),
        F.when(valid, F.col("m.role")).alias("message_role"),
        F.when(valid, content_json(F.col("m.content"))).alias("message_content"),
        project_from_path(F.col("file_path")).alias("project_path"),
        s("cwd").alias("cwd"),
        s("gitBranch").alias("git_branch"),
        s("version").alias("version"),
        F.when(valid, _utc_timestamp(F.col("s.timestamp"))).alias("timestamp"),
    )


def valid_records(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("error").isNull())


def quarantine(parsed: DataFrame) -> DataFrame:
    """Rejected lines with the reason spelled out per field (evaluated for these rows only).

    Bytes that are not UTF-8 are shown as U+FFFD in ``raw``.
    """
    bad = parsed.where(F.col("error").isNotNull())
    reason = F.coalesce(record_error(F.try_parse_json(F.col("raw")), F.col("raw")), F.col("error"))
    return bad.withColumns({"error": reason, "raw": F.make_valid_utf8("raw")})


def fail_fast(parsed: DataFrame) -> DataFrame:
    """All-or-nothing load: the first bad line raises when the result is computed."""
    bad = F.col("error").isNotNull()
    msg = F.concat(F.lit("invalid record in "), F.col("file_path"), F.lit(": "), F.col("error"))
    return parsed.where(F.coalesce(F.when(bad, F.raise_error(msg)), F.lit(True)))
