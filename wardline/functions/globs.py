"""Shell patterns as regular expressions, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# A bracket expression holds a character or more; "]" right at its start is one of them.
_TOKEN = r"(?s)\[!?+(?:\][^\]]*|[^\]]+)\]|."


def glob_tokens(pattern: Column) -> Column:
    """A pattern's characters, wildcards and bracket expressions in order."""
    return F.regexp_extract_all(pattern, F.lit(_TOKEN), F.lit(0))


def glob_regex(pattern: Column) -> Column:
    """Anchored regular expression of a pattern with ``*``, ``?``, ``[...]`` and ``[!...]``; case-sensitive."""

    def translate(token: Column) -> Column:
        negated = token.startswith("[!")
        body = F.when(negated, F.regexp_replace(token, r"^\[!|\]$", "")).otherwise(F.regexp_replace(token, r"^\[|\]$", ""))
        escaped = F.regexp_replace(body, r"([\[\]\\^&])", r"\\$1")
        return (
            F.when(token == "*", F.lit(".*"))
            .when(token == "?", F.lit("."))
            .when(F.length(token) > 1, F.concat(F.when(negated, "[^").otherwise("["), escaped, F.lit("]")))
            .otherwise(F.regexp_replace(token, r"([^\w\s])", r"\\$1"))
        )

    return F.concat(F.lit(r"(?s)\A"), F.array_join(F.transform(glob_tokens(pattern), translate), ""), F.lit(r"\z"))
