"""Small pieces of DuckDB SQL that the query twins share."""

from __future__ import annotations

from collections.abc import Iterable

#: one white-space character of any script
SPACE_CLASS = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"
#: white space of any script cut from both ends of ``{}``
_TRIM_HEAD = "regexp_replace(regexp_replace("
TRIM_LEFT, TRIM_RIGHT = f"'^{SPACE_CLASS}+', ''", f"'{SPACE_CLASS}+$', ''"


class _Trim:
    """``TRIM.format(expression)`` trims an SQL expression."""

    def format(self, expression: str) -> str:
        return f"{_TRIM_HEAD}{expression}, {TRIM_LEFT}), {TRIM_RIGHT})"


TRIM = _Trim()


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def regex(pattern: str) -> str:
    return lit(pattern)


def sql_list(items: Iterable[str]) -> str:
    return ", ".join(lit(i) for i in items)


def tokens_sql(expression: str) -> str:
    """White-space tokens of an expression, without empty ones."""
    return f"list_filter(regexp_split_to_array({expression}, '{SPACE_CLASS}+'), lambda w: length(w) > 0)"
