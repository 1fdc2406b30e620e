"""Search: keyword / regex predicates, filters, BM25 rank, top-k, previews.

``search(messages, query)`` builds one declarative plan: the filters become
``where`` clauses Catalyst merges and pushes into the scan (project and
date ranges reach Parquet as pushed filters; the table's partition and
sort layout prunes files and row groups), the keyword test stays a codegen'd
``contains(lower(...))``, and a limit becomes ``TakeOrderedAndProject``.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logscope.functions.dates import date_bound
from logscope.functions.text import cli_line, keyword_predicate, list_line, preview_text
from logscope.operators import bm25
from logscope.schema import RESULT_COLUMNS, RESULT_SCHEMA

# Default result limit, and the rows of a preview.
DEFAULT_LIMIT = 100
PREVIEW_ROWS = 5
RANK_DECIMALS = 6


@dataclass(frozen=True)
class SearchQuery:
    keywords: Sequence[str] = ()
    mode: str = "and"
    project_filter: str | None = None
    project_filters: Sequence[str] | DataFrame | None = None   # a DataFrame with project_path for long lists
    date_from: object = None
    date_to: object = None
    favorites_only: bool | None = None
    limit: int | None = DEFAULT_LIMIT
    regex: str | None = None


def project_predicate(project_filter: str | None, project_filters: Sequence[str] | None) -> Column | None:
    """A given list wins over the single project; an empty list means no project filter."""
    if project_filters is not None:
        return F.col("project_path").isin(list(project_filters)) if len(project_filters) else None
    if project_filter is not None:
        return F.col("project_path") == F.lit(project_filter)
    return None


def apply_filters(df: DataFrame, q: SearchQuery, anchor: dt.datetime | None = None) -> DataFrame:
    """Date range (inclusive), project, favourites. ``from > to`` simply gives no rows."""
    if q.date_from is not None:
        df = df.where(F.col("timestamp") >= F.lit(date_bound(q.date_from, anchor)).cast("timestamp_ntz"))
    if q.date_to is not None:
        df = df.where(F.col("timestamp") <= F.lit(date_bound(q.date_to, anchor, end=True)).cast("timestamp_ntz"))
    if isinstance(q.project_filters, DataFrame):
        df = df.join(q.project_filters.select("project_path"), "project_path", "left_semi")
    else:
        p = project_predicate(q.project_filter, q.project_filters)
        if p is not None:
            df = df.where(p)
    if q.favorites_only:
        df = df.where(F.col("is_favorite"))
    return df


def empty_result(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], RESULT_SCHEMA)


def result_columns(df: DataFrame, rank: Column | None = None) -> DataFrame:
    r = F.round(rank, RANK_DECIMALS) if rank is not None else F.lit(0.0)
    return df.select(*[c for c in RESULT_COLUMNS if c != "rank"], r.cast("double").alias("rank")).select(*RESULT_COLUMNS)


def rank_desc(df: DataFrame) -> DataFrame:
    """Highest rank first; ties by id (stable, deterministic)."""
    return df.orderBy(F.col("rank").desc(), F.col("id").asc())


def top_k(df: DataFrame, k: int) -> DataFrame:
    return rank_desc(df).limit(k)


def search(messages: DataFrame, q: SearchQuery, index: bm25.TextIndex | None = None,
           anchor: dt.datetime | None = None, ranked: bool = False) -> DataFrame:
    """Rows whose content matches the keywords (substring, case-insensitive) and the regular expression.

    With neither keywords nor a regular expression the result is empty, before any
    filter. With an index, or with ``ranked`` (which scans the texts instead), the
    rank is the BM25 score of the keyword terms present (0 when none is) over all
    messages; the keyword test itself decides membership. ``limit=None`` returns
    all rows, otherwise the top ``limit`` by rank.
    """
    if not q.keywords and q.regex is None:
        return empty_result(messages)
    df = apply_filters(messages, q, anchor)
    if q.keywords:
        df = df.where(keyword_predicate(F.col("message_content"), q.keywords, q.mode))
    if q.regex is not None:
        df = df.where(F.col("message_content").rlike(q.regex))
    if index is None and not ranked:
        out = result_columns(df)
    else:
        scores = (bm25.score(index, q.keywords, "or") if index is not None else bm25.score_scan(messages, q.keywords, "or")).select("id", "score")
        out = result_columns(df.join(scores, "id", "left"), F.coalesce(F.col("score"), F.lit(0.0)))
    return top_k(out, q.limit) if q.limit is not None else out


def ranked_search(messages: DataFrame, index: bm25.TextIndex | None, q: SearchQuery,
                  anchor: dt.datetime | None = None, stats: dict | None = None) -> DataFrame:
    """Full-text search: rows holding the keyword terms (all for ``and``, any
    for ``or``), ranked by BM25 over all messages. Without an index the texts are scanned.

    Messages are joined before the limit, so it counts rows that exist and pass the filters. With a
    persisted index and a limit only blocks of postings that may hold one of the rows are read (see :func:`bm25.topk`).
    """
    if not q.keywords:
        return empty_result(messages)
    if index is not None and index.stored and q.limit is not None:
        def ranked(scores: DataFrame) -> DataFrame:
            scores = scores.select("id", F.round("score", RANK_DECIMALS).alias("rank"))
            return apply_filters(messages, q, anchor).join(scores, "id").select(*RESULT_COLUMNS)
        return bm25.topk(index, q.keywords, q.mode, q.limit, ranked, RANK_DECIMALS, stats)
    found = bm25.score(index, q.keywords, q.mode) if index is not None else bm25.score_scan(messages, q.keywords, q.mode)
    scores = found.select("id", F.round("score", RANK_DECIMALS).alias("rank"))
    out = apply_filters(messages, q, anchor).join(scores, "id").select(*RESULT_COLUMNS)
    return top_k(out, q.limit) if q.limit is not None else out


def regex_search(messages: DataFrame, pattern: str, q: SearchQuery | None = None, anchor: dt.datetime | None = None) -> DataFrame:
    """Rows whose content matches a (Java) regular expression, with the filters and limit of ``q``."""
    return search(messages, replace(q or SearchQuery(limit=None), keywords=(), regex=pattern), anchor=anchor)


def list_favorites(messages: DataFrame) -> DataFrame:
    """All favourites, newest first."""
    return result_columns(messages.where(F.col("is_favorite"))).orderBy(F.col("timestamp").desc(), F.col("id").asc())


def result_count(results: DataFrame) -> DataFrame:
    return results.agg(F.count(F.lit(1)).alias("result_count"))


def result_preview(results: DataFrame, rows: int = PREVIEW_ROWS) -> DataFrame:
    """First rows of a ranked result with the display strings of the list and the command line."""
    return rank_desc(results).limit(rows).select(
        "id",
        list_line(F.col("id"), F.col("timestamp"), F.col("message_content")).alias("list_line"),
        cli_line(F.col("id"), F.col("message_content")).alias("cli_line"),
        preview_text(F.col("message_content")).alias("preview"),
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("time_text"),
    )
