"""Pieces of SQL that express the text functions in DuckDB."""

from leakscope.functions.text import LINE_END, WS

SQL_HELPERS = ""
REPO = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(repo), '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g'), '^[a-z][a-z0-9+.-]*://[^/]*/', ''), '/+$', ''), '\.git$', '')"


def strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def lines_sql(x: str) -> str:
    parts = f"regexp_split_to_array({x}, '{LINE_END}')"
    return f"(CASE WHEN {parts}[-1] = '' THEN {parts}[:-2] ELSE {parts} END)"
