"""Small string expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def space_tokens(line: Column) -> Column:
    """Tokens between single spaces. Inner empty tokens count, trailing ones do not."""
    return F.split(F.rtrim(line), " ")


def joined(values: Column) -> Column:
    """Comma-joined list; a null element reads ``null``."""
    return F.array_join(values, ",", "null")


def printed(value: Column) -> Column:
    """A value as it reads in a list."""
    return F.coalesce(value, F.lit("null"))


def quoted_tokens(line: Column) -> Column:
    """Tokens between white space, where ``[...]`` and ``"..."`` are one token each.

    In quotes, a backslash escapes what follows it. A bracket or quote that does not close, or closes inside a
    word, is part of a plain token. Possessive, and a bracket ends at the next one, so long lines need no backtracking.
    """
    return F.regexp_extract_all(
        line, F.lit(r'(?<!\S)(?:\[[^\[\]]*+\]|"(?:[^"\\]++|\\.)*+"|\S++)(?!\S)'), F.lit(0)
    )


def token_text(token: Column) -> Column:
    """What a token says: without its brackets or quotes and their escapes, null for a lone dash."""
    inner = F.substring(token, F.lit(2), F.length(token) - 2)
    bracketed = F.startswith(token, F.lit("[")) & token.rlike(r"^\[[^\[\]]*+\]$")
    quoted = F.startswith(token, F.lit('"')) & token.rlike(r'(?s)^"(?:[^"\\]++|\\.)*+"$')
    escaped = F.contains(token, F.lit("\\"))
    return (
        F.when(token == "-", F.lit(None))
        .when(bracketed, inner)
        .when(quoted & escaped, F.regexp_replace(inner, r'\\(["\\])', "$1"))
        .when(quoted, inner)
        .otherwise(token)
    )
