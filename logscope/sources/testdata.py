"""Adapters from the provided test tables to the message model.

The test tables carry no uuid, project, timestamp or favourite flag, so they
are derived the same way in Spark and in the SQL oracle (see FIXTURES.md §5).
Everything here is a narrow projection of a parquet scan: Catalyst prunes the
columns a query does not use, and the only wide operator (``lag`` for the
parent link) disappears when ``parent_uuid`` is not selected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values of the adapter (FIXTURES.md §5).
BASE_TIME = "2024-01-01 00:00:00"
USER_TYPE = "external"
CWD = "/test"
GIT_BRANCH = "main"
VERSION = "1.0.0"
PROJECT_PREFIX = "proj-"
PROJECT_COUNT = 7
TURNS = 1 << 31   # more than any session has
# Root folder used for the file paths of the derived JSON Lines corpus.
LOG_ROOT = "/logs"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _timestamp(conv_id: Column, turn: Column) -> Column:
    return (F.lit(BASE_TIME).cast("timestamp_ntz")
            + F.make_dt_interval(F.lit(0), conv_id.cast("int"), turn.cast("int"), F.lit(0)))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``messages`` adapter view over ``conversations``; table column order."""
    c = table(spark, sf_dir, "conversations")
    uuid = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    by_conv = Window.partitionBy("conv_id").orderBy("turn")
    return c.select(
        (F.col("conv_id") * TURNS + F.col("turn")).alias("id"),
        uuid.alias("uuid"),
        F.lag(uuid).over(by_conv).alias("parent_uuid"),
        F.col("conv_id").cast("string").alias("session_id"),
        F.lit(USER_TYPE).alias("user_type"),
        F.col("role").alias("message_type"),
        F.col("role").alias("message_role"),
        F.col("text").alias("message_content"),
        F.concat(F.lit(PROJECT_PREFIX), (F.col("conv_id") % PROJECT_COUNT).cast("string")).alias("project_path"),
        F.lit(CWD).alias("cwd"),
        F.lit(GIT_BRANCH).alias("git_branch"),
        F.lit(VERSION).alias("version"),
        _timestamp(F.col("conv_id"), F.col("turn")).alias("timestamp"),
        (((F.col("conv_id") * 31 + F.col("turn")) % 11) == 0).alias("is_favorite"),
        F.col("conv_id"),
        F.col("turn"),
        F.max(_timestamp(F.col("conv_id"), F.col("turn"))).over(Window.partitionBy("conv_id")).alias("session_end"),
    )


def search_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Message rows as the search operators read them (content = plain text)."""
    return messages(spark, sf_dir).drop("parent_uuid", "conv_id", "turn", "session_end")


def content_variant(role: Column, text: Column) -> Column:
    """Derived content as a VARIANT: a JSON string for user turns, an array of
    one ``{"text": ..., "type": "text"}`` part otherwise."""
    holder = F.to_variant_object(F.struct(
        text.alias("s"), F.array(F.struct(text.alias("text"), F.lit("text").alias("type"))).alias("a")))
    return F.when(role == "user", F.variant_get(holder, "$.s", "variant")).otherwise(F.variant_get(holder, "$.a", "variant"))


def content_json_text(role: Column, text: Column) -> Column:
    """Stored JSON text of the derived content."""
    return F.to_json(content_variant(role, text))


# Fixed values of the derived write batches.
EXISTING_TURNS = 3                     # the stored table held the first 3 turns of each session
EXISTING_LOADED = "2024-02-01 00:00:00"  # created_at / updated_at of stored rows
LOAD_TIME = "2024-03-01 00:00:00"      # "now" of the import being planned
EDIT_SUFFIX = " (edited)"
LATER_SUFFIX = " (later)"
LATER_POS = TURNS                      # the later copies of first turns stand after all turns


def existing_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored table before the import: the first turns of every session, in table columns."""
    m = messages(spark, sf_dir).where(F.col("turn") < EXISTING_TURNS)
    loaded = F.lit(EXISTING_LOADED).cast("timestamp_ntz")
    return m.select(
        "id", "uuid", "parent_uuid", "session_id", "user_type", "message_type", "message_role",
        content_json_text(F.col("message_role"), F.col("message_content")).alias("message_content"),
        "project_path", "cwd", "git_branch", "version", "timestamp", "is_favorite",
        loaded.alias("created_at"), loaded.alias("updated_at"),
    )


def incoming_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A re-read of every session file after edits: each turn with ``(edited)``
    appended, and a later copy of each first turn with ``(later)``."""
    m = messages(spark, sf_dir)
    edited = m.withColumn("message_content", F.concat("message_content", F.lit(EDIT_SUFFIX)))
    later = (m.where(F.col("turn") == 0)
             .withColumn("message_content", F.concat("message_content", F.lit(LATER_SUFFIX))))
    return (_lines(edited, F.col("turn"))
            .unionByName(_lines(later, F.col("turn") + LATER_POS)))


def loaded_lines(spark: SparkSession, sf_dir: str, rewritten: int) -> DataFrame:
    """The lines that had been loaded: the first turns of each session; sessions divisible by ``rewritten`` had other texts then."""
    m = messages(spark, sf_dir).where(F.col("turn") < EXISTING_TURNS)
    other = F.when(F.col("conv_id") % rewritten == 0, F.concat("message_content", F.lit(EDIT_SUFFIX))).otherwise(F.col("message_content"))
    return _lines(m.withColumn("message_content", other), F.col("turn"))


def listing(spark: SparkSession, sf_dir: str, turns: int | None = None) -> DataFrame:
    """The session files as a file listing: last modified at the last turn, as long as their texts;
    with ``turns``, as they were when a session had that many turns."""
    m = messages(spark, sf_dir)
    if turns is not None:
        m = m.where(F.col("turn") < turns)
    path = F.concat(F.lit(LOG_ROOT + "/"), F.col("project_path"), F.lit("/"), F.col("session_id"), F.lit(".jsonl"))
    return m.groupBy(path.alias("file_path")).agg(F.max("timestamp").alias("file_mtime"), F.sum(F.length("message_content")).alias("length"))


def source_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON Lines corpus derived from ``conversations``.

    One session file per conversation at ``/logs/<project>/<session>.jsonl``,
    one line per turn (line number = turn + 1). The record shape follows the
    real logs: user turns carry a plain string as content, other turns an array
    of ``{"type":"text","text":...}`` parts; assistant timestamps are written
    with a ``+09:00`` offset. System turns are written with ``isSidechain`` as
    the string ``"no"``, which the strict check must reject.

    Columns: file_path, file_mtime, block_start, pos, value (the shape the
    file reader in ``sources/jsonl.py`` produces).
    """
    return _lines(messages(spark, sf_dir), F.col("turn"))


def _lines(m: DataFrame, pos: Column) -> DataFrame:
    ts = F.col("timestamp")
    ts_text = F.when(
        F.col("message_role") == "assistant",
        F.concat(F.date_format(ts + F.expr("INTERVAL 9 HOURS"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+09:00")),
    ).otherwise(F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z")))
    side = F.when(F.col("message_role") == "system", F.parse_json(F.lit('"no"'))).otherwise(F.parse_json(F.lit("false")))
    record = F.to_json(F.struct(
        F.col("parent_uuid").alias("parentUuid"),
        side.alias("isSidechain"),
        F.col("user_type").alias("userType"),
        F.col("cwd"),
        F.col("session_id").alias("sessionId"),
        F.col("version"),
        F.col("git_branch").alias("gitBranch"),
        F.col("message_type").alias("type"),
        F.struct(F.col("message_role").alias("role"),
                 content_variant(F.col("message_role"), F.col("message_content")).alias("content")).alias("message"),
        F.col("uuid"),
        ts_text.alias("timestamp"),
    ), {"ignoreNullFields": "false"})
    return m.select(
        F.concat(F.lit(LOG_ROOT + "/"), F.col("project_path"), F.lit("/"), F.col("session_id"), F.lit(".jsonl")).alias("file_path"),
        F.col("session_end").alias("file_mtime"),  # a session file was last written at its last turn
        F.lit(0).cast("long").alias("block_start"),
        pos.cast("long").alias("pos"),
        record.alias("value"),
    )
