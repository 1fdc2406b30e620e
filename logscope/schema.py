"""Schemas: the source record, the stored message table, the search result."""

from __future__ import annotations

from pyspark.sql import types as T

# JSON names of the source record and whether each is required,
# with the JSON type it must have ("string", "boolean", "object", "any").
# Unknown extra fields are accepted.
RECORD_FIELDS = [
    ("parentUuid", "string", False),
    ("isSidechain", "boolean", True),
    ("userType", "string", True),
    ("cwd", "string", True),
    ("sessionId", "string", True),
    ("version", "string", True),
    ("gitBranch", "string", False),
    ("type", "string", True),
    ("message", "object", True),
    ("uuid", "string", True),
    ("timestamp", "string", True),
]

# Fields of the nested "message" object; all optional.
MESSAGE_FIELDS = [
    ("role", "string"),
    ("content", "any"),
    ("id", "string"),
    ("type", "string"),
    ("model", "string"),
]

# Columns taken from a valid record, in table order (without id and bookkeeping).
RECORD_COLUMNS = [
    "uuid", "parent_uuid", "session_id", "user_type", "message_type",
    "message_role", "message_content", "project_path", "cwd", "git_branch",
    "version", "timestamp",
]

# The stored table. ``load_date`` is the partition column (see plans/store.py).
MESSAGE_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("uuid", T.StringType(), False),
    T.StructField("parent_uuid", T.StringType(), True),
    T.StructField("session_id", T.StringType(), False),
    T.StructField("user_type", T.StringType(), False),
    T.StructField("message_type", T.StringType(), False),
    T.StructField("message_role", T.StringType(), True),
    T.StructField("message_content", T.StringType(), True),
    T.StructField("project_path", T.StringType(), False),
    T.StructField("cwd", T.StringType(), False),
    T.StructField("git_branch", T.StringType(), True),
    T.StructField("version", T.StringType(), False),
    T.StructField("timestamp", T.TimestampNTZType(), False),
    T.StructField("is_favorite", T.BooleanType(), False),
    T.StructField("created_at", T.TimestampNTZType(), True),
    T.StructField("updated_at", T.TimestampNTZType(), True),
])

TABLE_COLUMNS = [f.name for f in MESSAGE_SCHEMA.fields]

# The nine columns of a search result, in order.
RESULT_COLUMNS = [
    "id", "uuid", "session_id", "message_content", "message_role",
    "project_path", "timestamp", "rank", "is_favorite",
]

RESULT_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("uuid", T.StringType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("message_content", T.StringType()),
    T.StructField("message_role", T.StringType()),
    T.StructField("project_path", T.StringType()),
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("rank", T.DoubleType()),
    T.StructField("is_favorite", T.BooleanType()),
])
