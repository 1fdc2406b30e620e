"""SQL oracles (DuckDB dialect) for the registered queries.

Written from the semantics: the adapter view, the derived JSON Lines batches,
the query terms and BM25 are restated in SQL here; only the query parameters are shared.
"""

from __future__ import annotations

from logscope.plans import registry as R

# Unicode white space class and token separator, same text as the Spark side.
WS = r"[\s\x{000B}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
SEP = r"[^\p{L}\p{N}]+"

MESSAGES = """messages AS (
  SELECT conv_id * 2147483648 + turn AS id,
         CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS uuid,
         LAG(CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR)) OVER (PARTITION BY conv_id ORDER BY turn) AS parent_uuid,
         CAST(conv_id AS VARCHAR) AS session_id,
         'external' AS user_type, role AS message_type, role AS message_role, text AS message_content,
         'proj-' || CAST(conv_id % 7 AS VARCHAR) AS project_path,
         '/test' AS cwd, 'main' AS git_branch, '1.0.0' AS version,
         TIMESTAMP '2024-01-01 00:00:00' + to_hours(conv_id) + to_minutes(turn) AS timestamp,
         (conv_id * 31 + turn) % 11 = 0 AS is_favorite,
         conv_id, turn,
         '/logs/proj-' || CAST(conv_id % 7 AS VARCHAR) || '/' || CAST(conv_id AS VARCHAR) || '.jsonl' AS file_path,
         MAX(TIMESTAMP '2024-01-01 00:00:00' + to_hours(conv_id) + to_minutes(turn)) OVER (PARTITION BY conv_id) AS session_end
  FROM conversations)"""


def cj(text: str) -> str:
    """Stored JSON text of the derived content."""
    return (f"CASE WHEN message_role = 'user' THEN CAST(to_json({text}) AS VARCHAR) "
            f"ELSE CAST(to_json([{{'text': {text}, 'type': 'text'}}]) AS VARCHAR) END")


# Lines of the edited re-read: every turn (pos = turn) plus a later copy of turn 0 (after all turns).
INCOMING = f"""lines_in AS (
  SELECT *, turn AS pos, message_content || ' (edited)' AS new_text FROM messages
  UNION ALL
  SELECT *, 2147483648 + turn AS pos, message_content || ' (later)' AS new_text FROM messages WHERE turn = 0),
valid_in AS (SELECT * FROM lines_in WHERE message_role <> 'system'),
batch AS (SELECT * FROM valid_in QUALIFY row_number() OVER (PARTITION BY uuid ORDER BY file_path DESC, pos DESC) = 1),
existing AS (
  SELECT id, uuid, parent_uuid, session_id, user_type, message_type, message_role,
         {cj('message_content')} AS message_content, project_path, cwd, git_branch, version, timestamp, is_favorite,
         TIMESTAMP '2024-02-01 00:00:00' AS created_at, TIMESTAMP '2024-02-01 00:00:00' AS updated_at
  FROM messages WHERE turn < 3)"""

RESULT = "id, uuid, session_id, message_content, message_role, project_path, timestamp, {rank} AS rank, is_favorite"
RECORD = ("uuid, parent_uuid, session_id, user_type, message_type, message_role, {content} AS message_content, "
          "project_path, cwd, git_branch, version, timestamp")
NOW = "TIMESTAMP '2024-03-01 00:00:00'"
NEW_ROW = ("{id} AS id, uuid, parent_uuid, session_id, user_type, message_type, message_role, {content} AS message_content, "
           "project_path, cwd, git_branch, version, timestamp, false AS is_favorite, " + NOW + " AS created_at, "
           + NOW + " AS updated_at")


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _lit_list(items) -> str:
    return ", ".join("'" + i.replace("'", "''") + "'" for i in items)


def _kw_pred(keywords, mode="and") -> str:
    op = " OR " if mode == "or" else " AND "
    return "(" + op.join(f"contains(lower(message_content), '{k.lower()}')" for k in keywords) + ")"


def _search(where: str) -> str:
    return _with(MESSAGES) + f"SELECT {RESULT.format(rank='CAST(0.0 AS DOUBLE)')} FROM messages WHERE {where}"


def bm25_ctes(terms) -> str:
    return f"""doc_len AS (
  SELECT id, CAST(len(list_filter(regexp_split_to_array(lower(message_content), '{SEP}'), lambda x: x <> '')) AS DOUBLE) AS len
  FROM messages WHERE message_content IS NOT NULL),
corpus AS (SELECT CAST(count(*) AS DOUBLE) AS n_docs, avg(len) AS avg_len FROM doc_len),
toks AS (
  SELECT id, t AS term FROM (SELECT id, unnest(regexp_split_to_array(lower(message_content), '{SEP}')) AS t
                              FROM messages WHERE message_content IS NOT NULL) WHERE t <> ''),
postings AS (SELECT term, id, CAST(count(*) AS DOUBLE) AS tf FROM toks GROUP BY term, id),
term_df AS (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM postings GROUP BY term),
scores AS (
  SELECT p.id,
         sum(ln(1.0 + (c.n_docs - d.df + 0.5) / (d.df + 0.5)) * p.tf * 2.2
             / (p.tf + 1.2 * (0.25 + 0.75 * l.len / c.avg_len))) AS score,
         count(*) AS n_terms
  FROM postings p JOIN term_df d ON p.term = d.term JOIN doc_len l ON p.id = l.id CROSS JOIN corpus c
  WHERE p.term IN ({_lit_list(terms)})
  GROUP BY p.id)"""


# Terms of the registered keywords, stated by hand: each is one lower-case word.
TERMS = {"the", "that", "und", "les", "and", "ein", "la", "le"}


def _terms(keywords):
    assert set(keywords) <= TERMS
    return list(keywords)


def _ranked(keywords, mode, limit=None) -> str:
    terms = _terms(keywords)
    cond = "" if mode == "or" else f"WHERE s.n_terms = {len(terms)}"
    sql = (_with(MESSAGES, bm25_ctes(terms))
           + f"SELECT m.id, m.uuid, m.session_id, m.message_content, m.message_role, m.project_path, m.timestamp, "
             f"round(s.score, 6) AS rank, m.is_favorite FROM messages m JOIN scores s ON m.id = s.id {cond}")
    if limit is not None:
        sql += f" ORDER BY rank DESC, id ASC LIMIT {limit}"
    return sql


def _date_bound(phrase: str) -> str:
    a = f"TIMESTAMP '{R.ANCHOR}'"
    # Expected resolution of each fixture phrase (NULL = rejected).
    table = {
        "today": f"date_trunc('day', {a})",
        "yesterday": f"date_trunc('day', {a}) - INTERVAL 1 DAY",
        "last week": f"{a} - INTERVAL 7 DAY",
        "last month": f"{a} - INTERVAL 30 DAY",
        "7 days ago": f"{a} - INTERVAL 7 DAY",
        "2 weeks ago": f"{a} - INTERVAL 14 DAY",
        "1 day ago": f"{a} - INTERVAL 1 DAY",
        "1 days ago": f"{a} - INTERVAL 1 DAY",
        "10 day ago": f"{a} - INTERVAL 10 DAY",
        "  7   days   ago  ": f"{a} - INTERVAL 7 DAY",
    }
    key = phrase if phrase in table else phrase.lower()
    return "CAST(" + table.get(key, "NULL") + " AS TIMESTAMP)"


def _relative_dates() -> str:
    parts = []
    for i, p in enumerate(R.PHRASES, 1):
        b = _date_bound(p)
        parts.append(f"CAST(coalesce(count_if(timestamp >= {b}), 0) AS BIGINT) AS since_{i:02d}")
    for i, p in enumerate(R.PHRASES, 1):
        parts.append(f"{_date_bound(p)} AS bound_{i:02d}")
    return _with(MESSAGES) + "SELECT " + ",\n  ".join(parts) + " FROM messages"


def _new_rows(where: str, base: str) -> str:
    return (f"SELECT {NEW_ROW.format(id=base + ' + row_number() OVER (ORDER BY file_path, pos)', content=cj('new_text'))} "
            f"FROM batch WHERE {where}")


def oracle_sql() -> dict[str, str]:
    combined_terms = _terms(R.COMBINED["keywords"])
    base = "(SELECT max(id) FROM existing)"
    search_combined = (
        _with(MESSAGES, bm25_ctes(combined_terms))
        + "SELECT m.id, m.uuid, m.session_id, m.message_content, m.message_role, m.project_path, m.timestamp, "
          "round(coalesce(s.score, 0.0), 6) AS rank, m.is_favorite FROM messages m LEFT JOIN scores s ON m.id = s.id "
        + f"WHERE {_kw_pred(R.COMBINED['keywords'])} AND m.project_path IN ({_lit_list(R.COMBINED['project_filters'])}) "
          f"AND m.timestamp >= TIMESTAMP '{R.COMBINED['date_from']} 00:00:00' "
          f"AND m.timestamp <= TIMESTAMP '{R.COMBINED['date_to']} 23:59:59.999999' "
          f"ORDER BY rank DESC, id ASC LIMIT {R.COMBINED['limit']}")
    ingest_valid = _with(MESSAGES) + f"SELECT {RECORD.format(content=cj('message_content'))} FROM messages WHERE message_role <> 'system'"
    upsert_sql = (_with(MESSAGES, INCOMING) + f"""
SELECT e.id,
       {', '.join(f"CASE WHEN b.uuid IS NOT NULL THEN b.{c} ELSE e.{c} END AS {c}" for c in ['uuid', 'parent_uuid', 'session_id', 'user_type', 'message_type', 'message_role'])},
       CASE WHEN b.uuid IS NOT NULL THEN {cj('b.new_text').replace('message_role', 'b.message_role')} ELSE e.message_content END AS message_content,
       {', '.join(f"CASE WHEN b.uuid IS NOT NULL THEN b.{c} ELSE e.{c} END AS {c}" for c in ['project_path', 'cwd', 'git_branch', 'version', 'timestamp'])},
       e.is_favorite, e.created_at,
       CASE WHEN b.uuid IS NOT NULL THEN {NOW} ELSE e.updated_at END AS updated_at
FROM existing e LEFT JOIN batch b ON e.uuid = b.uuid
UNION ALL
{_new_rows('uuid NOT IN (SELECT uuid FROM existing)', base)}""")
    fav_cols = "id, uuid, project_path"
    return {
        "search_combined": search_combined,
        "kw_and": _search(_kw_pred(R.KW_AND)),
        "kw_or": _search(_kw_pred(R.KW_OR, "or")),
        "kw_single": _search(_kw_pred(R.KW_SINGLE)),
        "kw_empty": _with(MESSAGES) + "SELECT project_path, count(*) AS n_messages, CAST(0 AS BIGINT) AS n_results FROM messages GROUP BY project_path",
        "filter_date_range": _search(_kw_pred(["the"]) + f" AND timestamp >= TIMESTAMP '{R.DATE_FROM} 00:00:00'"
                                     f" AND timestamp < TIMESTAMP '{R.DATE_TO} 00:00:00' + INTERVAL 1 DAY"),
        "filter_project": _search(_kw_pred(["the"]) + f" AND project_path = '{R.PROJECT}'"),
        "filter_projects_in": _search(_kw_pred(["the"]) + f" AND project_path IN ({_lit_list(R.PROJECTS)})"),
        "filter_precedence": _search(_kw_pred(["the"]) + f" AND project_path IN ({_lit_list(R.PRECEDENCE_LIST)})"),
        "filter_empty_list": _search(_kw_pred(["the"])),
        "filter_favorites": _search(_kw_pred(["the"]) + " AND is_favorite"),
        "list_favorites": _search("is_favorite") + " ORDER BY timestamp DESC, id",
        "regex_search": _search(f"regexp_matches(message_content, '{R.REGEX}')"),
        "kw_and_indexed": _search(_kw_pred(R.KW_RARE)),
        "kw_or_indexed": _search(_kw_pred(R.KW_RARE_OR, "or")),
        "regex_indexed": _search(f"regexp_matches(message_content, '{R.REGEX_RARE}')"),
        "bm25_single": _ranked(R.BM25_SINGLE, "and"),
        "bm25_and": _ranked(R.BM25_AND, "and"),
        "bm25_or": _ranked(R.BM25_OR, "or"),
        "rank_desc": f"SELECT *, row_number() OVER (ORDER BY rank DESC, id ASC) AS position FROM ({_ranked(R.RANK_TERMS, 'or')})",
        "search_topk": _ranked(R.TOPK_TERMS, "or", R.TOPK),
        "search_topk_index": _ranked(R.TOPK_TERMS, "or", R.TOPK),
        "result_preview": (
            _with(MESSAGES, bm25_ctes(_terms(R.KW_OR)))
            + "SELECT m.id, "
              "'[' || CAST(m.id AS VARCHAR) || '] ' || strftime(m.timestamp, '%Y-%m-%d %H:%M') || ' - ' || substring(coalesce(m.message_content, '(empty)'), 1, 50) AS list_line, "
              "'- [' || CAST(m.id AS VARCHAR) || '] ' || coalesce(m.message_content, '(no content)') AS cli_line, "
              "substring(coalesce(m.message_content, '(empty)'), 1, 50) AS preview, "
              "strftime(m.timestamp, '%Y-%m-%d %H:%M:%S') AS time_text "
              f"FROM messages m LEFT JOIN scores s ON m.id = s.id WHERE {_kw_pred(R.KW_OR, 'or')} "
              "ORDER BY round(coalesce(s.score, 0.0), 6) DESC, m.id ASC LIMIT 5"),
        "result_count": _with(MESSAGES) + f"SELECT count(*) AS result_count FROM messages WHERE {_kw_pred(R.KW_OR, 'or')}",
        "split_keywords": (
            _with(MESSAGES, f"k AS (SELECT id, list_filter(regexp_split_to_array(message_content, '{WS}+'), lambda x: x <> '') AS kws FROM messages)")
            + "SELECT id, CAST(len(kws) AS INTEGER) AS n_keywords, kws[1] AS first_keyword, kws[-1] AS last_keyword FROM k"),
        "relative_dates": _relative_dates(),
        "term_stats": (
            _with(MESSAGES, bm25_ctes(["-"]))
            + "SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS occurrences, "
              "round(ln(1.0 + ((SELECT n_docs FROM corpus) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf "
              "FROM postings GROUP BY term"),
        "ingest_valid": ingest_valid,
        "ingest_quarantine": _with(MESSAGES) + (
            "SELECT file_path, CAST(turn + 1 AS BIGINT) AS line_no, "
            "'invalid type for `isSidechain`: expected boolean' AS error FROM messages WHERE message_role = 'system'"),
        "content_json": _with(MESSAGES) + (
            f"SELECT uuid, {cj('message_content')} AS message_content, message_content AS message_text "
            "FROM messages WHERE message_role <> 'system'"),
        "ingest_roundtrip": _with(MESSAGES) + (
            f"SELECT {NEW_ROW.format(id='row_number() OVER (ORDER BY file_path, turn)', content=cj('message_content'))} "
            "FROM messages WHERE message_role <> 'system'"),
        "ingest_project": ingest_valid + f" AND project_path = '{R.PROJECT}'",
        "ingest_files": _with(MESSAGES) + (
            "SELECT 'project=' || project_path AS project_path, count_if(message_role <> 'system') AS imported, count_if(message_role = 'system') AS errors, "
            f"sum(CASE WHEN message_role <> 'system' THEN length({cj('message_content')}) END) AS content_length, "
            "max(CASE WHEN message_role <> 'system' THEN timestamp END) AS last_update FROM messages GROUP BY project_path"),
        "ingest_files_one_project": _with(MESSAGES) + (
            f"SELECT uuid, 'project=' || project_path AS project_path, {cj('message_content')} AS message_content, timestamp "
            f"FROM messages WHERE message_role <> 'system' AND project_path = '{R.PROJECT}'"),
        "list_projects": _with(MESSAGES) + "SELECT DISTINCT project_path FROM messages WHERE message_role <> 'system'",
        "import_overwrite": _with(MESSAGES, INCOMING) + _new_rows("true", "0"),
        "import_insert_only": _with(MESSAGES, INCOMING) + _new_rows("uuid NOT IN (SELECT uuid FROM existing)", base),
        "uuid_exists": _with(MESSAGES, INCOMING) + "SELECT uuid FROM batch WHERE uuid IN (SELECT uuid FROM existing)",
        "import_upsert": upsert_sql,
        "import_stats": _with(MESSAGES, INCOMING) + (
            "SELECT (SELECT count(*) FROM batch WHERE uuid NOT IN (SELECT uuid FROM existing)) AS inserted, "
            "(SELECT count(*) FROM valid_in) - (SELECT count(*) FROM batch WHERE uuid NOT IN (SELECT uuid FROM existing)) AS updated, "
            "CAST(0 AS BIGINT) AS skipped, "
            "(SELECT count(*) FROM lines_in WHERE message_role = 'system') AS errors, "
            "(SELECT count(*) FROM valid_in) AS total_processed"),
        "import_force_errors": _with(MESSAGES, INCOMING) + (
            "SELECT file_path, pos, uuid, 'duplicate uuid' AS error FROM "
            "(SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY file_path, pos) AS rn FROM valid_in) "
            "WHERE uuid IN (SELECT uuid FROM existing) OR rn > 1"),
        "import_report": _with(MESSAGES, INCOMING) + (
            "SELECT project_path, file_path, CAST(count_if(message_role <> 'system') AS BIGINT) AS imported, "
            "CAST(count_if(message_role = 'system') AS BIGINT) AS errors, CAST(GROUPING(project_path, file_path) AS BIGINT) AS level "
            "FROM lines_in GROUP BY ROLLUP (project_path, file_path)"),
        "assign_ids": _with(MESSAGES, INCOMING) + (
            "SELECT file_path, pos, uuid, row_number() OVER (ORDER BY file_path, pos) AS id FROM valid_in"),
        "last_update_by_project": _with(MESSAGES) + "SELECT project_path, max(timestamp) AS last_update FROM messages GROUP BY project_path",
        "sql_count_by_project": _with(MESSAGES) + (
            f"SELECT project_path, count(*) AS n FROM messages WHERE message_role = '{R.ROLE_PARAM}' GROUP BY project_path"),
        "favorite_mark": _with(MESSAGES) + (
            f"SELECT {fav_cols}, is_favorite OR (parent_uuid IS NULL AND message_role = 'user') AS is_favorite FROM messages"),
        "favorite_unmark": _with(MESSAGES) + (
            f"SELECT {fav_cols}, CASE WHEN message_role = 'assistant' THEN false ELSE is_favorite END AS is_favorite FROM messages"),
        "sync_new_only": _with(MESSAGES, INCOMING) + _new_rows("uuid NOT IN (SELECT uuid FROM existing)", base),
        "sync_appended": _with(MESSAGES) + (
            "SELECT file_path, turn + 1 AS line_no, CASE WHEN message_role <> 'system' THEN uuid END AS uuid FROM messages "
            f"WHERE conv_id % {R.REWRITTEN} = 0 OR turn >= 3"),
        "import_force_inserted": _with(MESSAGES, INCOMING, "firsts AS (SELECT * FROM valid_in QUALIFY row_number() OVER (PARTITION BY uuid ORDER BY file_path, pos) = 1)")
            + _new_rows("uuid NOT IN (SELECT uuid FROM existing)", base).replace("FROM batch", "FROM firsts"),
        "bm25_persisted_index": _ranked(R.BM25_OR, "or"),
        "bm25_documents": (
            _with("messages AS (SELECT doc_id AS id, text AS message_content, source AS project_path FROM documents)", bm25_ctes(_terms(R.DOC_TERMS)))
            + "SELECT m.id, m.project_path, round(s.score, 6) AS rank FROM messages m JOIN scores s ON m.id = s.id "
              f"WHERE m.project_path IN ({_lit_list(R.DOC_SOURCE)}) ORDER BY rank DESC, id ASC LIMIT 50"),
        "filter_projects_table": (
            "SELECT doc_id AS id, source AS project_path FROM documents WHERE (contains(lower(text), 'password') OR contains(lower(text), 'token')) "
            "AND source IN (SELECT d.source FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic = 1)"),
        "events_date_range": (
            'SELECT event_type, count(*) AS n, min(ts) AS "first", max(ts) AS "last" FROM events '
            f"WHERE ts >= TIMESTAMP '{R.EVENT_FROM} 00:00:00' AND ts < TIMESTAMP '{R.EVENT_TO} 00:00:00' + INTERVAL 1 DAY GROUP BY event_type"),
        "regex_filtered": (_search(f"regexp_matches(message_content, '{R.REGEX}') AND project_path IN ({_lit_list(R.REGEX_QUERY.project_filters)}) "
                                   f"AND timestamp >= TIMESTAMP '{R.REGEX_QUERY.date_from} 00:00:00'") + f" ORDER BY rank DESC, id LIMIT {R.REGEX_QUERY.limit}"),
    }
