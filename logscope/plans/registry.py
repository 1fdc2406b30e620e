"""Registered queries over the provided test tables, with their SQL oracles.

Every query reads whole tables - mostly ``conversations``, through the adapter in
``sources/testdata.py``; write queries plan the rows a store write would
produce (the store itself is exercised by the unit tests). Each oracle is
plain SQL over the same tables; column names match one to one.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logscope.functions.dates import resolve_date
from logscope.functions.text import split_keywords
from logscope.operators import bm25, favorites, lines as line_ops, reports, search as S, trigram, upsert, validate
from logscope.plans.sync import appended_lines, plan_sync
from logscope.schema import RECORD_COLUMNS
from logscope.session import ensure_checkpoint_dir
from logscope.sources import testdata as td
from logscope.sources.jsonl import read_lines

# The query parameters of the registered queries.
KW_AND = ["the", "that"]
KW_OR = ["the", "und", "les"]
KW_SINGLE = ["ein"]
KW_RARE = ["thatth", "The"]
KW_RARE_OR = ["mentouoi", "ERENTION"]
REGEX_RARE = "(eauaux|[Tt]hatth|mentouoi)[a-z]*"
DATE_FROM = "2024-01-05"
DATE_TO = "2024-01-20"
PROJECT = "proj-3"
PROJECTS = ["proj-1", "proj-4", "proj-9"]
PRECEDENCE_SINGLE = "proj-2"
PRECEDENCE_LIST = ["proj-5"]
REGEX = "[Tt]he [a-z]+ing"
COMBINED = dict(keywords=KW_AND, project_filters=["proj-1", "proj-2", "proj-3"],
                date_from="2024-01-01", date_to="2024-01-25", limit=20)
BM25_SINGLE = ["und"]
BM25_AND = ["the", "and"]
BM25_OR = ["ein", "les", "the"]
RANK_TERMS = ["la", "le"]
TOPK_TERMS = ["the", "and"]
TOPK = 20
ANCHOR = "2024-01-30 23:57:00"
DOC_SOURCE = ["src0", "src3"]
DOC_TERMS = ["the", "und"]
EVENT_FROM, EVENT_TO = "2024-01-05", "2024-01-12"
REGEX_QUERY = S.SearchQuery(project_filters=["proj-1", "proj-3"], date_from="2024-01-02", limit=15)
PHRASES = [
    "today", "TODAY", "ToDay", "yesterday", "last week", "last month", "7 days ago", "2 weeks ago",
    "1 day ago", "1 days ago", "10 day ago", "  7   days   ago  ",
    "7 days", "abc days ago", "-5 days ago", "", "tomorrow", "invalid date",
]
ROLE_PARAM = "user"
REWRITTEN = 3   # sessions divisible by it had other first lines when they were loaded

Query = Callable[[SparkSession, str], DataFrame]


def _msgs(spark, sf):
    return td.search_view(spark, sf)


def _index(spark, sf):
    return bm25.build_index(_msgs(spark, sf))


def _kw(keywords, mode="and", **kw):
    return lambda spark, sf: S.search(_msgs(spark, sf), S.SearchQuery(keywords=keywords, mode=mode, limit=None, **kw))


def _now():
    return F.lit(td.LOAD_TIME).cast("timestamp_ntz")


def _parsed(spark, sf):
    return validate.parse_lines(td.source_lines(spark, sf))


def _incoming(spark, sf):
    return validate.parse_lines(td.incoming_lines(spark, sf))


def _batch(spark, sf):
    return upsert.dedup_last(validate.valid_records(_incoming(spark, sf)))


def _documents(spark, sf):
    """``documents`` in the columns that the search operators read; the source is the project."""
    return td.table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("uuid"), F.col("lang").alias("session_id"),
        F.col("text").alias("message_content"), F.lit("user").alias("message_role"), F.col("source").alias("project_path"),
        F.lit(td.BASE_TIME).cast("timestamp_ntz").alias("timestamp"), F.lit(False).alias("is_favorite"))


def q_filter_precedence(spark, sf):
    q = S.SearchQuery(keywords=["the"], project_filter=PRECEDENCE_SINGLE, project_filters=PRECEDENCE_LIST, limit=None)
    return S.search(_msgs(spark, sf), q)


def q_filter_empty_list(spark, sf):
    q = S.SearchQuery(keywords=["the"], project_filter=PRECEDENCE_SINGLE, project_filters=[], limit=None)
    return S.search(_msgs(spark, sf), q)


def q_search_combined(spark, sf):
    return S.search(_msgs(spark, sf), S.SearchQuery(**COMBINED), ranked=True)


def _ranked(terms, mode, limit=None):
    return lambda spark, sf: S.ranked_search(_msgs(spark, sf), None, S.SearchQuery(keywords=terms, mode=mode, limit=limit))


def q_rank_desc(spark, sf):
    ranked = upsert.materialised(_ranked(RANK_TERMS, "or")(spark, sf).withColumn("_neg_rank", -F.col("rank")))
    # Rows of one rank are cut by ranges of ids.
    return upsert.number_rows(ranked, ["_neg_rank", "id"], [F.col("_neg_rank"), F.floor(F.col("id") / F.lit(1 << 20))],
                              name="position").drop("_neg_rank")


def q_result_preview(spark, sf):
    return S.result_preview(S.search(_msgs(spark, sf), S.SearchQuery(keywords=KW_OR, mode="or", limit=None), ranked=True))


def _persisted(spark, rows):
    """An index of ``rows`` written to the shared folder and read again."""
    import uuid
    path = f"{ensure_checkpoint_dir(spark)}/index-{uuid.uuid4().hex}"
    bm25.write_index(rows, path)
    return bm25.TextIndex.load(spark, path)


def q_bm25_persisted_index(spark, sf):
    """The same search as ``bm25_or``, through the index: only the postings of the terms are read."""
    m = _msgs(spark, sf)
    return S.ranked_search(m, _persisted(spark, m), S.SearchQuery(keywords=BM25_OR, mode="or", limit=None))


def q_search_topk_index(spark, sf):
    """The same search as ``search_topk``, through the index: blocks that cannot reach the last rank are not read."""
    m = _msgs(spark, sf)
    return S.ranked_search(m, _persisted(spark, m), S.SearchQuery(keywords=TOPK_TERMS, mode="or", limit=TOPK))


def _message_files(spark, rows, files=32):
    """``rows`` as a table of Parquet files by project and time, in the shared folder, and a trigram index of them."""
    import uuid
    folder = f"{ensure_checkpoint_dir(spark)}/messages-{uuid.uuid4().hex}"
    rows.repartitionByRange(files, "project_path", "timestamp", "id").write.parquet(folder)
    index = trigram.TrigramIndex(spark, folder + "-trigrams", folder)
    index.refresh()
    return spark.read.parquet(folder), index


def _kw_indexed(keywords=(), mode="and", regex=None):
    """The same search as without index; files that cannot match are not opened."""
    def run(spark, sf):
        rows, index = _message_files(spark, _msgs(spark, sf))
        q = S.SearchQuery(keywords=keywords, mode=mode, regex=regex, limit=None)
        return S.search(trigram.read_files(rows, index.files(keywords, mode, regex)), q)
    return run


def q_bm25_documents(spark, sf):
    """Ranked search in the larger text table, with a project filter and a limit."""
    docs = _documents(spark, sf)
    q = S.SearchQuery(keywords=DOC_TERMS, mode="or", project_filters=DOC_SOURCE, limit=50)
    return S.ranked_search(docs, None, q).select("id", "project_path", "rank")


def q_filter_projects_table(spark, sf):
    """A project list that is a table (semi join): the sources that hold a labelled toxic document."""
    docs = _documents(spark, sf)
    wanted = (td.table(spark, sf, "labels").where("toxic = 1").join(docs.select(F.col("id").alias("doc_id"), "project_path"), "doc_id")
              .select("project_path").distinct())
    q = S.SearchQuery(keywords=["password", "token"], mode="or", project_filters=wanted, limit=None)
    return S.search(docs, q).select("id", "project_path")


def q_events_date_range(spark, sf):
    """Date filter (both ends inclusive) over real timestamps: events per type and their time range."""
    events = td.table(spark, sf, "events").withColumnRenamed("ts", "timestamp")
    found = S.apply_filters(events, S.SearchQuery(date_from=EVENT_FROM, date_to=EVENT_TO))
    return found.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))


def q_regex_filtered(spark, sf):
    return S.regex_search(_msgs(spark, sf), REGEX, REGEX_QUERY)


def q_result_count(spark, sf):
    return S.result_count(_kw(KW_OR, "or")(spark, sf))


def q_split_keywords(spark, sf):
    kws = split_keywords(F.col("message_content"))
    return _msgs(spark, sf).select(
        "id", F.size(kws).alias("n_keywords"),
        F.try_element_at(kws, F.lit(1)).alias("first_keyword"), F.try_element_at(kws, F.lit(-1)).alias("last_keyword"))


def q_relative_dates(spark, sf):
    """Messages since each phrase's resolved bound; one row, one column pair per phrase."""
    anchor = F.lit(ANCHOR).cast("timestamp_ntz")
    names = [f"{i:02d}" for i in range(1, len(PHRASES) + 1)]
    # The phrases are rows of a small table, so the date grammar stands in the plan once.
    phrases = spark.createDataFrame(list(zip(names, PHRASES)), "name string, phrase string").select(
        "name", resolve_date(F.col("phrase"), anchor).alias("bound"))
    bounds = phrases.agg(F.struct(*[F.max(F.when(F.col("name") == n, F.col("bound"))).alias(f"bound_{n}") for n in names])).scalar()
    counts = _msgs(spark, sf).select("timestamp", bounds.alias("b")).agg(
        *[F.count_if(F.col("timestamp") >= F.col(f"b.bound_{n}")).alias(f"since_{n}") for n in names])
    return counts.withColumn("b", bounds).select(*[f"since_{n}" for n in names], "b.*")


def q_term_stats(spark, sf):
    return bm25.term_stats(_index(spark, sf))


def q_ingest_valid(spark, sf):
    return validate.valid_records(_parsed(spark, sf)).select(*RECORD_COLUMNS)


def q_ingest_quarantine(spark, sf):
    lines = td.source_lines(spark, sf)
    bad = validate.quarantine(validate.parse_lines(lines))
    return line_ops.with_line_numbers(bad, lines).select("file_path", "line_no", "error")


def q_content_json(spark, sf):
    v = validate.valid_records(_parsed(spark, sf))
    return v.select("uuid", "message_content", validate.content_text(F.col("message_content")).alias("message_text"))


def q_ingest_roundtrip(spark, sf):
    batch = upsert.dedup_last(validate.valid_records(_parsed(spark, sf)))
    return upsert.plan_overwrite(batch, _now())


def _log_files(spark, sf):
    """The derived lines written as ``*.jsonl`` files, a folder per project, in the shared folder."""
    import uuid
    root = f"{ensure_checkpoint_dir(spark)}/logs-{uuid.uuid4().hex}"
    lines = td.source_lines(spark, sf).withColumn("project", validate.project_from_path(F.col("file_path")))
    (lines.select("value", "project").repartition("project").write.partitionBy("project")
     .format("csv").options(extension="jsonl", quote="", escape="", sep="\u0001", compression="none").save(root))
    return root


def q_ingest_files(spark, sf):
    """Recursive scan of real files: strict parsing, project from the folder, quarantined lines counted per project."""
    parsed = validate.parse_lines(read_lines(spark, _log_files(spark, sf)))
    return parsed.groupBy("project_path").agg(
        F.count_if(F.col("error").isNull()).alias("imported"), F.count_if(F.col("error").isNotNull()).alias("errors"),
        F.sum(F.length("message_content")).alias("content_length"), F.max("timestamp").alias("last_update"))


def q_ingest_files_one_project(spark, sf):
    """The same scan limited to one project: other files are not opened."""
    lines = read_lines(spark, _log_files(spark, sf), project=f"project={PROJECT}")
    return validate.valid_records(validate.parse_lines(lines)).select("uuid", "project_path", "message_content", "timestamp")


def q_ingest_project(spark, sf):
    lines = td.source_lines(spark, sf).where(validate.project_from_path(F.col("file_path")) == PROJECT)
    return validate.valid_records(validate.parse_lines(lines)).select(*RECORD_COLUMNS)


def q_list_projects(spark, sf):
    return reports.list_projects(validate.valid_records(_parsed(spark, sf)))


def q_import_overwrite(spark, sf):
    return upsert.plan_overwrite(_batch(spark, sf), _now())


def q_import_insert_only(spark, sf):
    return upsert.plan_insert_only(td.existing_table(spark, sf), _batch(spark, sf), _now())


def q_uuid_exists(spark, sf):
    return upsert.uuid_exists(_batch(spark, sf), td.existing_table(spark, sf)).select("uuid")


def q_import_upsert(spark, sf):
    return upsert.plan_upsert(td.existing_table(spark, sf), _batch(spark, sf), _now())


def q_import_stats(spark, sf):
    return upsert.import_stats(_incoming(spark, sf), td.existing_table(spark, sf))


def q_import_force_errors(spark, sf):
    valid = validate.valid_records(_incoming(spark, sf)).drop("raw")
    _, rejected = upsert.plan_force(td.existing_table(spark, sf), valid, _now())
    return rejected.select("file_path", "pos", "uuid", "error")


def q_import_force_inserted(spark, sf):
    valid = validate.valid_records(_incoming(spark, sf)).drop("raw")
    inserted, _ = upsert.plan_force(td.existing_table(spark, sf), valid, _now())
    return inserted


def q_import_report(spark, sf):
    return reports.import_report(_incoming(spark, sf))


def q_assign_ids(spark, sf):
    valid = upsert.materialised(validate.valid_records(_incoming(spark, sf)).select("file_path", "block_start", "pos", "uuid"))
    return upsert.number_batch(valid).select("file_path", "pos", "uuid", "id")


def q_last_update_by_project(spark, sf):
    return reports.last_update_by_project(_msgs(spark, sf))


def q_sql_count_by_project(spark, sf):
    return reports.count_by_project_sql(spark, _msgs(spark, sf), ROLE_PARAM)


def q_favorite_mark(spark, sf):
    m = td.messages(spark, sf)
    opening = F.col("parent_uuid").isNull() & (F.col("message_role") == "user")  # first turn of a session
    changes = m.where(opening).select("id", F.lit(True).alias("fav"))
    return favorites.apply_favorites(_msgs(spark, sf).select("id", "uuid", "project_path", "is_favorite"), changes)


def q_favorite_unmark(spark, sf):
    m = _msgs(spark, sf)
    changes = m.where(F.col("message_role") == "assistant").select("id", F.lit(False).alias("fav"))
    return favorites.apply_favorites(m.select("id", "uuid", "project_path", "is_favorite"), changes)


def q_sync_new_only(spark, sf):
    """Sync against the manifest of the earlier load, when each session had its first turns."""
    return plan_sync(td.existing_table(spark, sf), td.incoming_lines(spark, sf), td.listing(spark, sf),
                     td.listing(spark, sf, td.EXISTING_TURNS), _now())


def q_sync_appended(spark, sf):
    """Lines that session files gained since each had its first turns; every third file was rewritten instead, and is read whole."""
    numbered = td.source_lines(spark, sf).withColumn("line_no", F.col("pos") + 1)
    loaded = td.loaded_lines(spark, sf, REWRITTEN).groupBy("file_path").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(line_ops.line_hash()).alias("checksum"))
    return validate.parse_lines(appended_lines(numbered, loaded)).select("file_path", "line_no", "uuid")


def q_list_favorites(spark, sf):
    return S.list_favorites(_msgs(spark, sf))


def q_regex_search(spark, sf):
    return S.regex_search(_msgs(spark, sf), REGEX)


def q_kw_empty(spark, sf):
    """An empty keyword list finds nothing, in any project: messages and results per project."""
    m = _msgs(spark, sf)
    found = S.search(m, S.SearchQuery(keywords=[], limit=None)).groupBy("project_path").agg(F.count(F.lit(1)).alias("n_results"))
    return (m.groupBy("project_path").agg(F.count(F.lit(1)).alias("n_messages")).join(found, "project_path", "left")
            .select("project_path", "n_messages", F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results")))


QUERIES: dict[str, Query] = {
    "search_combined": q_search_combined,
    "kw_and": _kw(KW_AND),
    "kw_or": _kw(KW_OR, "or"),
    "kw_single": _kw(KW_SINGLE),
    "kw_empty": q_kw_empty,
    "filter_date_range": _kw(["the"], date_from=DATE_FROM, date_to=DATE_TO),
    "filter_project": _kw(["the"], project_filter=PROJECT),
    "filter_projects_in": _kw(["the"], project_filters=PROJECTS),
    "filter_precedence": q_filter_precedence,
    "filter_empty_list": q_filter_empty_list,
    "filter_favorites": _kw(["the"], favorites_only=True),
    "list_favorites": q_list_favorites,
    "regex_search": q_regex_search,
    "kw_and_indexed": _kw_indexed(KW_RARE),
    "kw_or_indexed": _kw_indexed(KW_RARE_OR, "or"),
    "regex_indexed": _kw_indexed(regex=REGEX_RARE),
    "bm25_single": _ranked(BM25_SINGLE, "and"),
    "bm25_and": _ranked(BM25_AND, "and"),
    "bm25_or": _ranked(BM25_OR, "or"),
    "bm25_persisted_index": q_bm25_persisted_index,
    "bm25_documents": q_bm25_documents,
    "filter_projects_table": q_filter_projects_table,
    "events_date_range": q_events_date_range,
    "regex_filtered": q_regex_filtered,
    "rank_desc": q_rank_desc,
    "search_topk": _ranked(TOPK_TERMS, "or", TOPK),
    "search_topk_index": q_search_topk_index,
    "result_preview": q_result_preview,
    "result_count": q_result_count,
    "split_keywords": q_split_keywords,
    "relative_dates": q_relative_dates,
    "term_stats": q_term_stats,
    "ingest_valid": q_ingest_valid,
    "ingest_quarantine": q_ingest_quarantine,
    "content_json": q_content_json,
    "ingest_roundtrip": q_ingest_roundtrip,
    "ingest_project": q_ingest_project,
    "ingest_files": q_ingest_files,
    "ingest_files_one_project": q_ingest_files_one_project,
    "list_projects": q_list_projects,
    "import_overwrite": q_import_overwrite,
    "import_insert_only": q_import_insert_only,
    "uuid_exists": q_uuid_exists,
    "import_upsert": q_import_upsert,
    "import_stats": q_import_stats,
    "import_force_errors": q_import_force_errors,
    "import_force_inserted": q_import_force_inserted,
    "import_report": q_import_report,
    "assign_ids": q_assign_ids,
    "last_update_by_project": q_last_update_by_project,
    "sql_count_by_project": q_sql_count_by_project,
    "favorite_mark": q_favorite_mark,
    "favorite_unmark": q_favorite_unmark,
    "sync_new_only": q_sync_new_only,
    "sync_appended": q_sync_appended,
}
