"""Audit of submitted SQL texts: text-level rules over a whole query log.

This is a report on a log. The security boundary is that only secured views are registered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Callable functions, aggregate and date constructs, words that may precede "(", verbs that write.
ALLOWED_FUNCTIONS = (
    "st_intersects", "st_within", "st_contains", "st_transform", "st_distance", "st_setsrid",
    "st_geomfromgeojson", "st_point", "st_xmin", "st_ymin", "st_xmax", "st_ymax", "st_extent",
    "lower", "upper", "length", "trim", "ltrim", "rtrim", "substring", "replace", "abs", "round",
    "ceil", "floor", "coalesce", "nullif", "current_date", "current_timestamp", "date",
    "date_trunc", "extract", "now",
)
ALLOWED_CONSTRUCTS = (
    "max", "min", "avg", "sum", "count", "array_agg", "cast", "date_add", "date_sub",
)
CLAUSE_WORDS = (
    "select", "from", "where", "and", "or", "not", "in", "as", "on", "using", "join", "by",
    "having", "distinct", "filter", "with", "between", "is", "then", "union", "intersect", "except",
    "all", "exists", "over", "values", "varchar", "numeric", "decimal", "char", "order", "group",
    "limit", "offset", "interval",
)
WRITE_VERBS = (
    "insert", "update", "delete", "merge", "create", "drop", "alter", "truncate", "grant", "revoke",
    "copy", "call", "exec", "execute", "do", "vacuum",
)


_STACKED = r";\s*\S"
_COMMENT = r"--|/\*"
_TOP_LIMIT = r"\b(limit|offset)\s+\S+\s*$"
_SET_OPERATION = r"\b(union|intersect|except)\b"
_EXISTS = r"\bexists\s*\("
_SELECT = r"^[\s(]*(select|with)\b"
_WRITE = rf"(^|[;(])\s*({'|'.join(WRITE_VERBS)})\b"
_CALL = r"\b([a-z_][a-z0-9_]*)\s*\("
_CTE_NAME = r"(?:\bwith|,)\s+([a-z_]\w*)(?:\s*\([^()]*\))?\s+as\s*\("
_CTE_WITH_COLUMNS = r"(?:\bwith|,)\s+([a-z_]\w*)\s*\([^()]*\)\s+as\s*\("
_FROM_ARGUMENT = r"\b(extract|substring|trim)\s*\([^()]*\)"
_ITEM = r"[a-z_][\w.]*(?:\s+(?:as\s+)?[a-z_]\w*)?"
_FROM_LIST = rf"\b(?:from|join)\s+({_ITEM}(?:\s*,\s*{_ITEM})*)"


def _text(sql: Column) -> Column:
    return F.coalesce(sql, F.lit(""))


def trimmed(sql: Column) -> Column:
    """Text without surrounding blanks and trailing semicolons."""
    return F.rtrim(F.ltrim(_text(sql), F.lit(" \t\r\n")), F.lit(" \t\r\n;"))


def blanked(text: Column) -> Column:
    """Lower-cased text with string literals emptied."""
    return F.lower(F.regexp_replace(text, r"(?:'[^']*+')++", "''"))


def bare(sql: Column) -> Column:
    return blanked(trimmed(sql))


# --- rules over prepared text -------------------------------------------------------


# Tokens of a text; what ends a predicate, and what ends the part of a clause in which an OR covers its predicates.
_TOKEN = r"""'[^']*'|"[^"]*"|[\w.$]+|<=>|<=|>=|<>|!=|==|\|\||::|\S"""
_PREDICATE_ENDS = ("and", "not", "as", "exists")
_PART_ENDS = (
    "select", "from", "where", "having", "on", "using", "group", "order", "by", "limit", "offset", "join", "union",
    "intersect", "except", "when", "then", "else", "with", ",", ";",
)
_COMPARISONS = ("<", ">", "<=", ">=", "<>", "!=", "<=>", "in", "is", "like", "ilike", "between")
_PREDICATE, _OR, _PART, _OPEN, _CLOSE, _EQUAL, _COMPARED = range(1, 8)


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _kind(token: Column) -> Column:
    word = F.lower(token)
    return (
        F.when(word == "or", _OR)
        .when(word.isin("(", "case"), _OPEN)
        .when(word.isin(")", "end"), _CLOSE)
        .when(word.isin("=", "=="), _EQUAL)
        .when(word.isin(*_COMPARISONS), _COMPARED)
        .when(word.isin(*_PREDICATE_ENDS), _PREDICATE)
        .when(word.isin(*_PART_ENDS), _PART)
        .otherwise(0)
    )


def _level(ors: Column, same: Column, held: Column, first: Column, equal: Column) -> Column:
    return F.struct(ors.alias("ors"), same.alias("same"), held.alias("held"), first.cast("int").alias("first"), equal.cast("int").alias("equal"))


def _packed(level: Column) -> Column:
    """A level as eight bytes. Open levels are kept as bytes, since an array would be copied element by element."""
    flags = level["ors"].cast("bigint") + 2 * level["same"].cast("bigint") + 4 * level["held"].cast("bigint")
    number = flags + 8 * level["first"].cast("bigint") + (level["equal"] + 2).cast("bigint") * (1 << 32)
    return F.unhex(F.lpad(F.hex(number), 16, "0"))


def _number(stack: Column) -> Column:
    """The last level of ``stack`` as a number, null if there is none."""
    return F.conv(F.hex(F.substring(stack, -8, 8)), 16, 10).cast("bigint")


def _severity(text: Column) -> Column:
    """``reject`` if an equality of equals stands below an OR, on its own bracket level or an outer one; ``warn`` if there is
    one elsewhere; else NULL.

    One fold over the tokens that matter, with the open levels as a stack. A level knows whether its part of a clause has an
    OR (``ors``) and an equality of equals, its own or one in brackets there (``same``), whether an earlier part held one
    (``held``, which an OR further out still covers), where the predicate begins and where its equals sign is (-1 none, -2
    several comparisons). Sides are equal if their tokens are, as written.
    """
    no, none = F.lit(False), F.lit(-1)

    def judged(words: Column) -> Column:
        kinds = F.transform(words, lambda t, i: F.struct(_kind(t).alias("kind"), i.alias("at")))
        return _let(F.filter(kinds, lambda e: e["kind"] > 0), lambda marks: folded(words, marks))

    def folded(words: Column, marks: Column) -> Column:
        opened = F.size(F.filter(marks, lambda e: e["kind"] == _OPEN))
        ends = F.transform(F.sequence(F.lit(0), opened), lambda i: F.struct(F.lit(_CLOSE).alias("kind"), (F.size(words) + i).alias("at")))

        def step(s: Column, e: Column) -> Column:
            kind, at, top, stack = e["kind"], e["at"], s["top"], s["stack"]
            first, equal = top["first"], top["equal"]
            width = equal - first
            tautology = F.when(
                ~kind.isin(_OPEN, _EQUAL, _COMPARED) & (width > 0) & (at - equal - 1 == width),
                F.slice(words, first + 1, width) == F.slice(words, equal + 2, width),
            ).otherwise(no)

            def after(new: Column) -> Column:
                ors, same, held = top["ors"], top["same"] | new, top["held"]

                def closed(n: Column) -> Column:
                    bit = lambda k: n.bitwiseAND(F.lit(k).cast("bigint")) > 0
                    outer = _level(bit(1), bit(2) | same | held, bit(4), F.shiftright(n, 3).bitwiseAND(F.lit((1 << 29) - 1).cast("bigint")), F.shiftright(n, 32) - 2)
                    return F.when(n.isNotNull(), outer).otherwise(_level(no, same | held, no, at + 1, none))

                level = (
                    F.when(kind == _EQUAL, _level(ors, same, held, first, F.when(equal == -1, at).otherwise(-2)))
                    .when(kind == _COMPARED, _level(ors, same, held, first, F.lit(-2)))
                    .when(kind.isin(_PREDICATE, _OR), _level(ors | (kind == _OR), same, held, at + 1, none))
                    .when(kind == _PART, _level(no, no, held | same, at + 1, none))
                    .when(kind == _CLOSE, _let(_number(stack), closed))
                    .otherwise(_level(no, no, no, at + 1, none))
                )
                return F.struct(
                    (s["found"] | new).alias("found"),
                    (s["rejected"] | (kind.isin(_PART, _CLOSE) & ors & same)).alias("rejected"),
                    level.alias("top"),
                    F.when(kind == _OPEN, F.concat(stack, _packed(top)))
                    .when(kind == _CLOSE, F.substring(stack, 1, F.octet_length(stack) - 8))
                    .otherwise(stack)
                    .alias("stack"),
                )

            return _let(tautology, after)

        start = F.struct(
            no.alias("found"), no.alias("rejected"), _level(no, no, no, F.lit(0), none).alias("top"),
            F.lit(b"").alias("stack"),
        )
        return F.aggregate(F.concat(marks, ends), start, step, lambda s: F.when(s["rejected"], "reject").when(s["found"], "warn"))

    def possible(words: Column) -> Column:
        """Whether a token after an equals sign also stands elsewhere, as the first of two equal sides does."""
        signed = lambda i: F.coalesce(F.get(words, i - 1).isin("=", "=="), no)
        after, elsewhere = F.filter(words, lambda t, i: signed(i)), F.filter(words, lambda t, i: ~signed(i))
        return F.arrays_overlap(after, elsewhere)

    return F.when(
        text.contains("="),
        _let(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)), lambda words: F.when(possible(words), judged(words))),
    )


def _not_select(words: Column) -> Column:
    return ~words.rlike(_SELECT) | words.rlike(_WRITE)


def _called(words: Column) -> Column:
    names = F.regexp_extract_all(words, F.lit(_CALL), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(names, lambda w: ~w.isin(*CLAUSE_WORDS))))


def _unknown(words: Column) -> Column:
    # isin() over constants is one hash set for the whole query, unlike array_except().
    known = CLAUSE_WORDS + ALLOWED_FUNCTIONS + ALLOWED_CONSTRUCTS
    calls = F.filter(F.regexp_extract_all(words, F.lit(_CALL), F.lit(1)), lambda w: ~w.isin(*known))
    named = F.regexp_extract_all(words, F.lit(_CTE_WITH_COLUMNS), F.lit(1))
    return F.array_sort(F.array_except(calls, named))


def _tables(words: Column) -> Column:
    text = F.replace(F.regexp_replace(words, _FROM_ARGUMENT, "x"), F.lit('"'), F.lit(""))
    lists = F.regexp_extract_all(text, F.lit(_FROM_LIST), F.lit(1))
    listed = F.flatten(F.transform(lists, lambda s: F.split(s, r"\s*,\s*")))
    names = F.transform(listed, lambda s: F.regexp_extract(s, r"^\s*(\S+)", 1))
    ctes = F.regexp_extract_all(text, F.lit(_CTE_NAME), F.lit(1))
    return F.array_sort(F.array_except(names, ctes))


# --- rules over raw text ------------------------------------------------------------


def is_empty(sql: Column) -> Column:
    return ~_text(sql).rlike(r"\S")


def is_stacked(sql: Column) -> Column:
    return trimmed(sql).rlike(_STACKED)


def has_comment(sql: Column) -> Column:
    return _text(sql).rlike(_COMMENT)


def is_not_select(sql: Column) -> Column:
    """First keyword is neither SELECT nor WITH, or a write verb starts a statement or a CTE body."""
    return _not_select(bare(sql))


def called_functions(sql: Column) -> Column:
    """Distinct names called in the text, without clause words."""
    return _called(bare(sql))


def unknown_functions(sql: Column) -> Column:
    """Called names outside the allow-list."""
    return _unknown(bare(sql))


def tautology_severity(sql: Column) -> Column:
    """``reject`` below an OR, ``warn`` elsewhere, NULL when absent."""
    return _severity(trimmed(sql))


def has_top_limit(sql: Column) -> Column:
    return bare(sql).rlike(_TOP_LIMIT)


def has_set_operation(sql: Column) -> Column:
    return bare(sql).rlike(_SET_OPERATION)


def has_exists(sql: Column) -> Column:
    return bare(sql).rlike(_EXISTS)


def referenced_tables(sql: Column) -> Column:
    """Sorted dataset ids after FROM and JOIN, dotted names whole, CTE names left out."""
    return _tables(bare(sql))


def screen(log: DataFrame, sql: str = "sql") -> DataFrame:
    """Add ``reasons`` (rules broken), ``warnings``, ``tables`` and ``accepted``.

    The prepared texts are columns of an earlier projection, so each is computed once per query.
    """
    c, text, words = F.col(sql), F.col("__trimmed"), F.col("__bare")
    prepared = log.withColumn("__trimmed", trimmed(c)).withColumn("__bare", blanked(text))
    judged = prepared.withColumns(
        {
            "__severity": _severity(text),
            "tables": _tables(words),
        }
    )
    severity = F.col("__severity")
    reasons = F.when(is_empty(c), F.array(F.lit("empty"))).otherwise(
        F.array_compact(
            F.array(
                F.when(text.contains(";") & text.rlike(_STACKED), F.lit("stacking")),
                F.when(has_comment(c), F.lit("comments")),
                F.when(_not_select(words), F.lit("statement")),
                F.when(F.size(_unknown(words)) > 0, F.lit("functions")),
                F.when(severity == "reject", F.lit("tautology")),
                F.when(words.rlike(_TOP_LIMIT), F.lit("top_limit")),
                F.when(words.rlike(_SET_OPERATION), F.lit("set_ops")),
                F.when(words.rlike(_EXISTS), F.lit("exists")),
            )
        )
    )
    return (
        judged.withColumn("reasons", reasons)
        .withColumn("warnings", F.array_compact(F.array(F.when(severity == "warn", F.lit("tautology")))))
        .withColumn("accepted", F.size("reasons") == 0)
        .drop("__trimmed", "__bare", "__severity")
    )


def rule_totals(screened: DataFrame) -> DataFrame:
    """Queries per broken rule."""
    return screened.select(F.explode("reasons").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("queries"))
