"""Text column functions: keyword tests, tokens, keyword splitting, previews.

All of them are built-in expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from functools import reduce
from typing import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
# Unicode White_Space as one regex class; written with \x{...} escapes so the
# same text works in Java regex (Spark) and RE2 (the SQL oracle).
WHITESPACE = r"[\s\x{000B}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
# A token is a maximal run of letters and digits.
TOKEN_SEPARATOR = r"[^\p{L}\p{N}]+"
# Placeholder texts for a missing content in the command-line and screen lists.
NO_CONTENT = "(no content)"
EMPTY_CONTENT = "(empty)"
PREVIEW_CHARS = 50
LIST_TIME_FORMAT = "yyyy-MM-dd HH:mm"


def contains_ci(c: Column, keyword: str) -> Column:
    """Case-insensitive substring test; NULL content never matches."""
    return F.coalesce(F.lower(c).contains(keyword.lower()), F.lit(False))


def keyword_predicate(c: Column, keywords: Iterable[str], mode: str = "and") -> Column:
    """Every keyword (``and``) or at least one (``or``) is a substring of ``c``.

    ``mode`` follows the command line: exactly ``"or"`` means OR, anything
    else means AND. An empty keyword matches every non-NULL content.
    """
    tests = [contains_ci(c, k) for k in keywords]
    if not tests:
        return F.lit(False)
    op = (lambda a, b: a | b) if mode == "or" else (lambda a, b: a & b)
    return reduce(op, tests)


def trim_whitespace(c: Column) -> Column:
    """Strip Unicode white space at both ends."""
    return F.regexp_replace(c, f"^{WHITESPACE}+|{WHITESPACE}+$", "")


def split_keywords(c: Column) -> Column:
    """Search-box text to a keyword array: split on white space, drop empties."""
    return F.filter(F.split(c, f"{WHITESPACE}+"), lambda x: x != "")


def tokens(c: Column) -> Column:
    """Lower-cased letter/digit runs of ``c`` (the full-text index tokens)."""
    return F.filter(F.split(F.lower(c), TOKEN_SEPARATOR), lambda x: x != "")


def preview_text(c: Column, placeholder: str = EMPTY_CONTENT, chars: int = PREVIEW_CHARS) -> Column:
    """First ``chars`` characters, with a placeholder for NULL."""
    return F.substring(F.coalesce(c, F.lit(placeholder)), 1, chars)


def list_line(id_col: Column, ts: Column, content: Column) -> Column:
    """``[id] yyyy-MM-dd HH:mm - first 50 chars`` as in the result list."""
    return F.format_string("[%d] %s - %s", id_col, F.date_format(ts, LIST_TIME_FORMAT), preview_text(content))


def cli_line(id_col: Column, content: Column) -> Column:
    """``- [id] content`` as the command line prints a result."""
    return F.format_string("- [%d] %s", id_col, F.coalesce(content, F.lit(NO_CONTENT)))
