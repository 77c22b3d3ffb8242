"""Shape checks over triples, and the conformance report of a dataset."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from wardline.operators.mapping import PREFIXES, RDF_TYPE, expand, map_to_triples, mapped_fields, stated_values, subject_column


@dataclass(frozen=True)
class Shape:
    """Constraints on one property of the instances of a class (CURIEs or IRIs)."""

    target_class: str
    path: str
    min_count: int = 0
    object_class: str | None = None
    datatype: str | None = None


@dataclass(frozen=True)
class Profile:
    name: str
    version: str
    shapes: tuple[Shape, ...] = field(default_factory=tuple)


class ConformanceUnavailable(RuntimeError):
    """The check cannot run, which says nothing about the rows."""


def pick_profile(profiles: Sequence[Profile], spec: Mapping[str, Any], version: str | None = None) -> tuple[Profile, bool]:
    """``(profile, pinned)``: the override, else the mapping's pin, else the newest version."""
    declared = spec.get("profile") or {}
    name = declared.get("name") or (profiles[0].name if profiles else None)
    wanted = version or declared.get("version")
    same = [p for p in profiles if p.name == name]
    if wanted:
        same = [p for p in same if p.version == wanted]
    if not same:
        raise ConformanceUnavailable(f"profile {name!r} version {wanted!r} is not available")
    numbers = lambda p: [int(n) for n in p.version.lstrip("v").split(".") if n.isdigit()]
    return max(same, key=numbers), bool(declared.get("version")) and version is None


# --- rules --------------------------------------------------------------------------


def _missing(df: DataFrame, spec: Mapping[str, Any], subject: Column) -> list[tuple[str, Column]]:
    """``(name, whether it is missing)`` of the id and of each required source, nested ones at any depth."""
    found = [("id_template", subject.isNull())]
    for item, column in mapped_fields(df, spec.get("fields") or []):
        if item.get("required") and item.get("source"):
            found.append((item["source"], F.lit(True) if column is None else column.isNull()))
    return found


def required_violations(df: DataFrame, spec: Mapping[str, Any], context: Mapping[str, str] | None = None) -> DataFrame:
    """Rows whose id or required source is missing, as violations naming the column."""
    s = subject_column(df, spec, context)
    found = [F.when(missing, F.lit(name)) for name, missing in _missing(df, spec, s)]
    return df.select(s.alias("subject"), F.explode(F.array_compact(F.array(*found))).alias("path")).select(
        "subject",
        "path",
        F.lit("required").alias("rule"),
        F.concat(F.lit("row not mapped, no value for "), F.col("path")).alias("message"),
    )


def row_violations(
    df: DataFrame,
    spec: Mapping[str, Any],
    context: Mapping[str, str] | None = None,
    prefixes: Mapping[str, str] = PREFIXES,
) -> DataFrame:
    """Missing sources and invalid literals of mapped columns, found in one scan of the rows."""
    s = subject_column(df, spec, context)
    finding = lambda path, rule, message: F.struct(path.alias("path"), F.lit(rule).alias("rule"), message.alias("message"))
    checks = [
        F.when(missing, finding(F.lit(name), "required", F.lit(f"row not mapped, no value for {name}")))
        for name, missing in _missing(df, spec, s)
    ]
    for item, column in mapped_fields(df, spec.get("fields") or []):
        if item.get("datatype") and (item.get("kind") or "literal") == "literal" and column is not None:
            value, datatype = column.cast("string"), expand(item["datatype"], prefixes)
            invalid = finding(
                F.lit(expand(item["target"], prefixes)), "datatype", F.concat(value, F.lit(f" is not a {datatype}"))
            )
            checks.append(F.when(value.isNotNull() & ~lexically_valid(value, item["datatype"], prefixes), invalid))
    return df.select(s.alias("subject"), F.explode(F.array_compact(F.array(*checks))).alias("v")).select("subject", "v.*")


def _up_to_two(value: Column) -> Column:
    """How many different values there are in a group: 0, 1, or 2 for more."""
    low, high = F.min(value), F.max(value)
    return F.when(low.isNull(), 0).when(low == high, 1).otherwise(2)


def min_count_violations(
    triples: DataFrame, shapes: Sequence[Shape], prefixes: Mapping[str, str] = PREFIXES
) -> DataFrame:
    """Nodes with too few values of a property; one aggregation by node serves every rule.

    A node's properties are a set of values: a repeated statement counts once. Whether there is a value, or a second one, is
    seen from the smallest and the largest; only rules that ask for more need the statements without repeats first.
    """
    rules = [s for s in shapes if s.min_count > 0]
    classes = sorted({expand(s.target_class, prefixes) for s in rules})
    paths = sorted({expand(s.path, prefixes) for s in rules})
    typed = {c: F.bool_or((F.col("p") == RDF_TYPE) & (F.col("o") == c)).alias(f"c{i}") for i, c in enumerate(classes)}
    named = triples.filter(F.col("p").isin(RDF_TYPE, *paths))
    of = lambda p: F.when(F.col("p") == p, F.struct("o", "datatype"))
    if max(s.min_count for s in rules) > 2:
        named = named.select("s", "p", "o", "datatype").distinct()
        counts = [F.count(of(p)).alias(f"n{i}") for i, p in enumerate(paths)]
    else:
        counts = [_up_to_two(of(p)).alias(f"n{i}") for i, p in enumerate(paths)]
    nodes = named.groupBy("s").agg(*typed.values(), *counts)
    checks = []
    for rule in rules:
        c = F.col(f"c{classes.index(expand(rule.target_class, prefixes))}")
        n = F.col(f"n{paths.index(expand(rule.path, prefixes))}")
        message = F.concat(F.lit(f"{rule.path}: fewer than {rule.min_count} values on "), F.col("s"))
        checks.append(F.when(c & (n < rule.min_count), F.struct(F.lit(rule.path).alias("path"), message.alias("message"))))
    return nodes.select(F.col("s").alias("subject"), F.explode(F.array_compact(F.array(*checks))).alias("v")).select(
        "subject", "v.path", F.lit("minCount").alias("rule"), "v.message"
    )


def _targeted(triples: DataFrame, rules: Sequence[tuple[Shape, dict[str, Column]]], prefixes: Mapping[str, str]) -> DataFrame:
    """Statements of a rule's path on nodes of its class, once for each such rule, with the columns it states."""
    offers = []
    for shape, columns in rules:
        stated = {"path": F.lit(shape.path), "target": F.lit(expand(shape.target_class, prefixes)), **columns}
        offers.append(F.when(F.col("p") == expand(shape.path, prefixes), F.struct(*[c.alias(n) for n, c in stated.items()])))
    met = triples.withColumn("rule", F.explode(F.array_compact(F.array(*offers)))).select("s", "p", "o", "o_kind", "datatype", "rule.*")
    typed = triples.filter(F.col("p") == RDF_TYPE).select(F.col("s").alias("__s"), F.col("o").alias("__type"))
    return met.join(typed, (F.col("s") == F.col("__s")) & (F.col("target") == F.col("__type")), "left_semi")


def class_violations(
    triples: DataFrame, shapes: Sequence[Shape], typed: DataFrame, prefixes: Mapping[str, str] = PREFIXES
) -> DataFrame:
    """Object IRIs of a property that the vocabulary ``typed(iri, class)`` does not type as required; every rule of a
    path counts, for nodes of its target class."""
    rules = [(s, {"wanted": F.lit(expand(s.object_class, prefixes))}) for s in shapes if s.object_class]
    right = typed.select(F.col("iri").alias("__iri"), F.col("class").alias("__class"))
    linked = _targeted(triples, rules, prefixes)
    bad = linked.join(right, (F.col("o") == F.col("__iri")) & (F.col("wanted") == F.col("__class")), "left_anti")
    return bad.select(
        F.col("s").alias("subject"),
        "path",
        F.lit("class").alias("rule"),
        F.concat("path", F.lit(": not a known concept: "), "o").alias("message"),
    )


def shape_datatype_violations(
    triples: DataFrame, shapes: Sequence[Shape], prefixes: Mapping[str, str] = PREFIXES
) -> DataFrame:
    """Values of a property that are no literal of the datatype its shape asks for: an IRI, another datatype (a literal
    without one is a string), or a text that isn't of its form."""
    found = []
    for s in shapes:
        if s.datatype:
            wanted = expand(s.datatype, prefixes)
            own = F.coalesce("datatype", F.lit(expand("xsd:string", PREFIXES)))
            fits = (F.col("o_kind") == "literal") & (own == wanted) & lexically_valid(F.col("o"), s.datatype, prefixes)
            found.append((s, {"fits": fits, "wanted": F.lit(wanted)}))
    bad = _targeted(triples, found, prefixes).filter(~F.col("fits"))
    return bad.select(
        F.col("s").alias("subject"),
        "path",
        F.lit("shapeDatatype").alias("rule"),
        F.concat("path", F.lit(": "), "o", F.lit(" is not a "), "wanted").alias("message"),
    )


# Lexical forms of XML Schema datatypes that a Spark cast alone does not decide.
_LEXICAL = {
    "integer": r"^[+-]?\d+$",
    "int": r"^[+-]?\d+$",
    "long": r"^[+-]?\d+$",
    "decimal": r"^[+-]?(\d+(\.\d*)?|\.\d+)$",
    "double": r"^([+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|[+-]?INF|NaN)$",
    "float": r"^([+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|[+-]?INF|NaN)$",
    "boolean": r"^(true|false|1|0)$",
    "date": r"^-?\d{4,}-\d{2}-\d{2}(Z|[+-]\d{2}:\d{2})?$",
    "dateTime": r"^-?\d{4,}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})?$",
}
_TEMPORAL = {"date": "date", "dateTime": "timestamp_ntz"}


def lexically_valid(value: Column, datatype: str, prefixes: Mapping[str, str] = PREFIXES) -> Column:
    """Whether a text is a literal of the datatype; datatypes without a rule accept any text."""
    name = expand(datatype, prefixes).rpartition("#")[2]
    if name not in _LEXICAL:
        return F.lit(True)
    fits = value.rlike(_LEXICAL[name])
    if name in _TEMPORAL:
        fits = fits & value.try_cast(_TEMPORAL[name]).isNotNull()
    return fits


def datatype_violations(
    triples: DataFrame, datatypes: Sequence[str], prefixes: Mapping[str, str] = PREFIXES
) -> DataFrame:
    """Literals that are not valid for their own datatype."""
    bad = F.lit(False)
    for name in datatypes:
        bad = bad | ((F.col("datatype") == expand(name, prefixes)) & ~lexically_valid(F.col("o"), name, prefixes))
    return triples.filter(F.col("o_kind") == "literal").filter(bad).select(
        F.col("s").alias("subject"),
        F.col("p").alias("path"),
        F.lit("datatype").alias("rule"),
        F.concat(F.col("o"), F.lit(" is not a "), F.col("datatype")).alias("message"),
    )


def violations(
    df: DataFrame,
    spec: Mapping[str, Any],
    profile: Profile,
    typed: DataFrame | None = None,
    context: Mapping[str, str] | None = None,
    prefixes: Mapping[str, str] = PREFIXES,
) -> DataFrame:
    """Every violation of a table against its mapping and profile, one row each.

    Shapes that need a vocabulary can't be checked without one, which makes the check unavailable, not passed.
    """
    shapes = profile.shapes
    if typed is None and any(s.object_class for s in shapes):
        raise ConformanceUnavailable(f"profile {profile.name!r} needs a vocabulary of typed concepts")
    named = {RDF_TYPE, *(expand(s.path, prefixes) for s in shapes)}
    triples = map_to_triples(df, spec, context, prefixes, only=named)
    parts = [row_violations(df, spec, context, prefixes)]
    if any(s.min_count > 0 for s in shapes):
        parts.append(min_count_violations(triples, shapes, prefixes))
    if any(s.object_class for s in shapes):
        parts.append(class_violations(triples, shapes, typed, prefixes))
    if any(s.datatype for s in shapes):
        parts.append(shape_datatype_violations(triples, shapes, prefixes))
    return reduce(DataFrame.unionByName, parts)


def _counts_from_columns(
    df: DataFrame, spec: Mapping[str, Any], shapes: Sequence[Shape], typed: DataFrame | None, context: Mapping[str, str], prefixes: Mapping[str, str]
) -> DataFrame:
    """One row: ``rows``, and the number of violations by rule, in one scan of the rows and one aggregation by node.

    The rows' nodes all have the mapping's target type, so the rules that apply are known, and every check is an
    expression over the row; only the vocabulary's concepts are joined.
    """
    subject = subject_column(df, spec, context)
    values = stated_values(df, spec, context, prefixes)
    own = expand(spec["target_type"], prefixes)
    ruled = [s for s in shapes if expand(s.target_class, prefixes) == own]
    stated = lambda shape: [v for v in values if v[0] == expand(shape.path, prefixes)]
    tally: dict[str, list[Column]] = {"required": [m for _, m in _missing(df, spec, subject)]}
    for item, column in mapped_fields(df, spec.get("fields") or []):
        if item.get("datatype") and (item.get("kind") or "literal") == "literal" and column is not None:
            value = column.cast("string")
            tally.setdefault("datatype", []).append(value.isNotNull() & ~lexically_valid(value, item["datatype"], prefixes))
    concepts: list[tuple[Column, str]] = []
    for shape in ruled:
        for _, value, kind, datatype in stated(shape):
            if shape.datatype:
                fits = (
                    lexically_valid(value, shape.datatype, prefixes)
                    if kind == "literal" and (datatype or expand("xsd:string", PREFIXES)) == expand(shape.datatype, prefixes)
                    else F.lit(False)
                )
                tally.setdefault("shapeDatatype", []).append(subject.isNotNull() & value.isNotNull() & ~fits)
            if shape.object_class:
                concepts.append((F.when(subject.isNotNull(), value), expand(shape.object_class, prefixes)))
    counted = [s for s in ruled if s.min_count > 0]
    pairs = lambda s: [F.when(v.isNotNull(), F.struct(v.alias("o"), F.lit(d).cast("string").alias("datatype"))) for _, v, _, d in stated(s)]
    nothing = F.lit(None).cast("struct<o:string,datatype:string>")
    total = lambda flags: sum((F.coalesce(f, F.lit(False)).cast("bigint") for f in flags), F.lit(0).cast("bigint"))
    rows = df.select(
        subject.alias("s"),
        *[total(flags).alias(f"t_{rule}") for rule, flags in tally.items()],
        *[F.array_compact(F.array(nothing, *pairs(s))).alias(f"v{i}") for i, s in enumerate(counted)],
        # Rows without a value get a key of their own, so that they don't meet in one place.
        *[F.coalesce(v, F.concat(F.lit("\x00"), F.xxhash64(*df.columns).cast("string"))).alias(f"o{i}") for i, (v, _) in enumerate(concepts)],
    )
    for i, (_, wanted) in enumerate(concepts):
        known = typed.filter(F.col("class") == wanted).select(F.col("iri").alias(f"o{i}")).distinct().withColumn(f"k{i}", F.lit(True))
        rows = rows.join(known, f"o{i}", "left").withColumn(f"u{i}", ~F.col(f"o{i}").startswith("\x00") & F.col(f"k{i}").isNull())
    if concepts:
        tally["class"] = []
        rows = rows.withColumn("t_class", total([F.col(f"u{i}") for i in range(len(concepts))]))
    nodes = rows.groupBy("s").agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.sum(f"t_{rule}").alias(f"t_{rule}") for rule in tally],
        *[F.min(F.array_min(f"v{i}")).alias(f"low{i}") for i in range(len(counted))],
        *[F.max(F.array_max(f"v{i}")).alias(f"high{i}") for i in range(len(counted))],
    )
    few = []
    for i, shape in enumerate(counted):
        n = F.when(F.col(f"low{i}").isNull(), 0).when(F.col(f"low{i}") == F.col(f"high{i}"), 1).otherwise(2)
        few.append(F.col("s").isNotNull() & (n < shape.min_count))
    sums = [F.sum(f"t_{rule}").alias(rule) for rule in tally]
    if counted:
        sums.append(F.sum(total(few)).alias("minCount"))
    return nodes.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), *sums)


# --- report -------------------------------------------------------------------------


def report(
    dataset_id: str,
    df: DataFrame,
    spec: Mapping[str, Any],
    profiles: Sequence[Profile],
    typed: DataFrame | None = None,
    context: Mapping[str, str] | None = None,
    profile_version: str | None = None,
    prefixes: Mapping[str, str] = PREFIXES,
) -> DataFrame:
    """One row: conforms, sample size, exact number of violations in all and by rule, and which profile ran.

    The violations themselves are the rows of ``violations``.
    """
    if not spec.get("target_type") or not spec.get("id_template"):
        raise ConformanceUnavailable(f"{dataset_id}: the mapping states no target_type or id_template")
    profile, pinned = pick_profile(profiles, spec, profile_version)
    shapes = profile.shapes
    if typed is None and any(s.object_class for s in shapes):
        raise ConformanceUnavailable(f"profile {profile.name!r} needs a vocabulary of typed concepts")
    types = [v for p, v, *_ in stated_values(df, spec, context or {}, prefixes) if p == RDF_TYPE]
    if len(types) > 1 or any(s.min_count > 2 for s in shapes):
        # Nodes with types of their own, or sets of values to count: from the violations themselves.
        found = violations(df, spec, profile, typed, context, prefixes).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
        listed = F.array_sort(F.collect_list(F.struct("rule", "n")))
        total = found.agg(listed.alias("by_rule")).withColumn("rows", df.agg(F.count(F.lit(1))).scalar())
    else:
        counts = _counts_from_columns(df, spec, shapes, typed, context or {}, prefixes)
        each = [F.when(F.col(r) > 0, F.struct(F.lit(r).alias("rule"), F.col(r).alias("n"))) for r in sorted(counts.columns) if r != "rows"]
        total = counts.select("rows", F.array_compact(F.array(*each)).alias("by_rule"))
    n = F.aggregate("by_rule", F.lit(0).cast("bigint"), lambda acc, x: acc + x["n"])
    return total.select(
        F.lit(dataset_id).alias("dataset_id"),
        (n == 0).alias("conforms"),
        F.col("rows").alias("sample_size"),
        n.alias("n_violations"),
        F.map_from_entries("by_rule").alias("by_rule"),
        F.lit(profile.name).alias("profile_name"),
        F.lit(profile.version).alias("profile_version"),
        F.lit(pinned).alias("profile_pinned"),
        F.current_timestamp().alias("checked_at"),
    )
