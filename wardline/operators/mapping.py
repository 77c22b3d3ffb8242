"""Semantic mapping: vocabulary documents of mapping specs, and table rows as RDF triples."""

from __future__ import annotations

import re
from collections.abc import Collection, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from wardline.sources.schema import FLAT_FIELD, NESTED

# Namespaces of public vocabularies.
PREFIXES = {
    "dct": "http://purl.org/dc/terms/",
    "foaf": "http://xmlns.com/foaf/0.1/",
    "geo": "http://www.w3.org/2003/01/geo/wgs84_pos#",
    "owl": "http://www.w3.org/2002/07/owl#",
    "prov": "http://www.w3.org/ns/prov#",
    "qudt": "http://qudt.org/schema/qudt/",
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "saref": "https://saref.etsi.org/core/",
    "schema": "https://schema.org/",
    "skos": "http://www.w3.org/2004/02/skos/core#",
    "sosa": "http://www.w3.org/ns/sosa/",
    "ssn": "http://www.w3.org/ns/ssn/",
    "time": "http://www.w3.org/2006/time#",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
}
RDF_TYPE = PREFIXES["rdf"] + "type"


class VocabularyError(ValueError):
    """A mapping uses a prefix nobody declared."""


def prefix_table(df: DataFrame, prefixes: Mapping[str, str] = PREFIXES) -> DataFrame:
    """``(prefix, namespace)`` rows on the session of ``df``."""
    return df.sparkSession.createDataFrame(sorted(prefixes.items()), "prefix string, namespace string")


# --- vocabulary documents -----------------------------------------------------------


def mapped_columns(catalogue: DataFrame) -> DataFrame:
    """``(dataset_id, path, f)``: every field of each mapping, nested ones at any depth; paths sort in the order of the text.

    The first nested level is typed, deeper ones are JSON text, which a recursive query opens a level at a time.
    """
    flat = lambda f: F.struct(*[f[n].alias(n) for n in T.StructType.fromDDL("f " + FLAT_FIELD)["f"].dataType.fieldNames()])
    top = catalogue.select("dataset_id", F.posexplode("ontology_mapping.fields").alias("i", "f"))
    first = top.select("dataset_id", F.array("i").alias("path"), flat(F.col("f")).alias("f"))
    second = top.select("dataset_id", "i", F.posexplode("f.nested_fields").alias("j", "g")).select(
        "dataset_id", F.array("i", "j").alias("path"), flat(F.col("g")).alias("f"), F.col("g.nested_fields").alias("below")
    )
    names = ", ".join(f"g.{n}" for n in T.StructType.fromDDL("f " + FLAT_FIELD)["f"].dataType.fieldNames())
    deeper = catalogue.sparkSession.sql(
        f"""WITH RECURSIVE walked(dataset_id, path, f, below) AS (
              SELECT dataset_id, path, f, below FROM {{opened}}
              UNION ALL
              SELECT dataset_id, concat(path, array(k)), struct({names}), g.nested_fields
              FROM walked LATERAL VIEW posexplode(from_json(below, '{NESTED}')) t AS k, g)
            SELECT dataset_id, path, f FROM walked WHERE size(path) > 2""",
        opened=second.filter(F.col("below").isNotNull()),
    )
    return first.unionByName(second.drop("below")).unionByName(deeper)


def vocabulary_terms(catalogue: DataFrame) -> DataFrame:
    """``(dataset_id, source, term_id, term_type)`` of every mapped column.

    Constants and fields without a source are no columns and are left out; nested fields, at any depth, count under their
    own source; the last field of a source wins.
    """
    kind = F.coalesce(F.col("f.kind"), F.lit("literal"))
    columns = mapped_columns(catalogue).filter((F.coalesce(F.col("f.source"), F.lit("")) != "") & (kind != "constant"))
    term_type = F.when(kind == "iri", F.lit("@id")).otherwise(F.nullif(F.col("f.datatype"), F.lit("")))
    return (
        columns.select(
            "dataset_id",
            F.col("f.source").alias("source"),
            "path",
            F.struct(F.col("f.target").alias("term_id"), term_type.alias("term_type")).alias("term"),
        )
        .groupBy("dataset_id", "source")
        .agg(F.max_by("term", "path").alias("term"))
        .select("dataset_id", "source", "term.*")
    )


def curie_prefix(value: Column) -> Column:
    """Prefix of a CURIE; NULL for absolute IRIs and plain words."""
    return F.when(~value.contains("://"), F.nullif(F.regexp_extract(value, r"^([^:]+):", 1), F.lit("")))


def vocabulary_prefixes(catalogue: DataFrame, prefixes: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """``(dataset_id, prefix, namespace)`` of exactly the prefixes in use; unknown ones have a NULL namespace."""
    terms = vocabulary_terms(catalogue) if terms is None else terms
    of_terms = terms.select("dataset_id", F.explode(F.array("term_id", "term_type")).alias("value"))
    of_types = catalogue.filter(F.col("ontology_mapping").isNotNull()).select(
        "dataset_id", F.col("ontology_mapping.target_type").alias("value")
    )
    used = (
        of_terms.filter(F.col("value") != "@id")
        .unionByName(of_types)
        .select("dataset_id", curie_prefix(F.col("value")).alias("prefix"))
        .filter(F.col("prefix").isNotNull())
        .distinct()
    )
    return used.join(prefixes, "prefix", "left").select("dataset_id", "prefix", "namespace")


def unknown_prefixes(catalogue: DataFrame, prefixes: DataFrame) -> DataFrame:
    return vocabulary_prefixes(catalogue, prefixes).filter(F.col("namespace").isNull()).select("dataset_id", "prefix")


def vocabulary_documents(catalogue: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``(dataset_id, document)``: JSON-LD context of the mapped columns of each dataset.

    A dataset using an undeclared prefix fails the job: a context with an unexpandable term
    must not be served.
    """
    terms = vocabulary_terms(catalogue)
    conforms = F.nullif(F.col("tags.conformsTo"), F.lit(""))
    mapped = catalogue.filter(F.col("ontology_mapping").isNotNull())
    used = vocabulary_prefixes(mapped, prefixes, terms)
    dct = prefixes.filter(F.col("prefix") == "dct").agg(F.max("namespace")).scalar()
    for_dct = mapped.filter(conforms.isNotNull()).select(
        "dataset_id", F.lit("dct").alias("prefix"), dct.alias("namespace")
    )
    declared = (
        used.unionByName(for_dct)
        .distinct()
        .select(
            "dataset_id",
            F.col("prefix").alias("k"),
            F.when(F.col("namespace").isNotNull(), F.to_json(F.struct(F.col("namespace").alias("v"))))
            .otherwise(F.raise_error(F.concat(F.lit("undeclared prefix "), F.col("prefix"))).cast("string"))
            .alias("json"),
        )
    )
    described = terms.select(
        "dataset_id",
        F.col("source").alias("k"),
        F.to_json(
            F.struct(F.struct(F.col("term_id").alias("@id"), F.col("term_type").alias("@type")).alias("v"))
        ).alias("json"),
    )
    # Entries are ready-made JSON members, since a map cannot mix texts and objects.
    member = F.concat(
        F.regexp_replace(F.to_json(F.array("k")), r"^\[|\]$", ""),
        F.lit(":"),
        F.regexp_replace("json", r'^\{"v":|\}$', ""),
    )
    contexts = (
        declared.unionByName(described)
        .groupBy("dataset_id")
        .agg(F.array_join(F.array_sort(F.collect_list(member)), ",").alias("members"))
    )
    head = mapped.select(
        "dataset_id",
        F.to_json(
            F.struct(
                F.col("ontology_mapping.target_type").alias("@type"),
                F.when(conforms.isNotNull(), F.struct(conforms.alias("@id"))).alias("dct:conformsTo"),
            )
        ).alias("head"),
    )
    rest = F.regexp_replace("head", r"^\{|\}$", "")
    document = F.concat(
        F.lit('{"@context":{'),
        F.coalesce("members", F.lit("")),
        F.lit("}"),
        F.when(rest != "", F.concat(F.lit(","), rest)).otherwise(F.lit("")),
        F.lit("}"),
    )
    return head.join(contexts, "dataset_id", "left").select("dataset_id", document.alias("document"))


# --- rows to triples ----------------------------------------------------------------


def expand(term: str, prefixes: Mapping[str, str] = PREFIXES) -> str:
    """Absolute IRI of a CURIE."""
    if "://" in term:
        return term
    prefix, sep, local = term.partition(":")
    if not sep or prefix not in prefixes:
        raise VocabularyError(f"undeclared prefix in {term!r}")
    return prefixes[prefix] + local


def template_column(template: str, columns: Sequence[str], context: Mapping[str, str]) -> Column:
    """Text of ``a{b}c`` with ``{name}`` from a column or a context value; NULL if a part is NULL."""
    pieces = []
    for literal, name in re.findall(r"([^{}]*)(?:\{([^{}]+)\})?", template):
        if literal:
            pieces.append(F.lit(literal))
        if name:
            if name in columns:
                pieces.append(F.col(name).cast("string"))
            else:
                pieces.append(F.lit(context.get(name)).cast("string"))
    return F.concat(*pieces)


def subject_column(df: DataFrame, spec: Mapping[str, Any], context: Mapping[str, str] | None = None) -> Column:
    return template_column(spec["id_template"], df.columns, context or {})


def mapped_fields(
    df: DataFrame, fields: Sequence[Mapping[str, Any]], parent: Column | None = None, kind: Any = None
) -> list[tuple[Mapping[str, Any], Column | None]]:
    """Every field with its column, nested ones at any depth; no column if the table has none of that name.

    A nested source is a member of its parent's struct, else a column of the table.
    """
    found: list[tuple[Mapping[str, Any], Column | None]] = []
    for item in fields:
        source, column, own = item.get("source"), None, None
        if source and isinstance(kind, T.StructType) and source in kind.fieldNames():
            column, own = parent[source], kind[source].dataType
        elif source and source in df.columns:
            column, own = F.col(source), df.schema[source].dataType
        found.append((item, column))
        found += mapped_fields(df, item.get("nested_fields") or [], column, own)
    return found


def stated_values(
    df: DataFrame, spec: Mapping[str, Any], context: Mapping[str, str], prefixes: Mapping[str, str] = PREFIXES
) -> list[tuple[str, Column, str, str | None]]:
    """``(property, value as text, iri or literal, datatype)`` of what each row states; a null value states nothing."""
    found: list[tuple[str, Column, str, str | None]] = [(RDF_TYPE, F.lit(expand(spec["target_type"], prefixes)), "iri", None)]
    for field, column in mapped_fields(df, spec.get("fields") or []):
        if not field.get("target"):
            continue  # only holds nested fields
        target, kind = expand(field["target"], prefixes), field.get("kind") or "literal"
        datatype = expand(field["datatype"], prefixes) if field.get("datatype") else None
        if kind == "constant":
            value = template_column(field["value"], df.columns, context)
            found.append((target, value, "iri" if "://" in field["value"] else "literal", datatype))
        elif column is not None:
            found.append((target, column.cast("string"), "iri" if kind == "iri" else "literal", None if kind == "iri" else datatype))
    return found


def map_to_triples(
    df: DataFrame,
    spec: Mapping[str, Any],
    context: Mapping[str, str] | None = None,
    prefixes: Mapping[str, str] = PREFIXES,
    only: Collection[str] | None = None,
) -> DataFrame:
    """Rows as triples ``(s, p, o, o_kind, datatype)``, of the properties ``only`` if given: one scan, one explode, no shuffle.

    Rows without an id yield nothing here; ``conformance.required_violations`` reports them.
    """
    context = context or {}
    statements = [
        F.when(
            value.isNotNull(),
            F.struct(F.lit(p).alias("p"), value.alias("o"), F.lit(kind).alias("o_kind"), F.lit(datatype).cast("string").alias("datatype")),
        )
        for p, value, kind, datatype in stated_values(df, spec, context, prefixes)
        if only is None or p in only
    ]
    empty = F.array().cast("array<struct<p:string,o:string,o_kind:string,datatype:string>>")
    listed = F.array_compact(F.array(*statements)) if statements else empty
    s = subject_column(df, spec, context)
    return df.select(s.alias("s"), F.explode(listed).alias("t")).filter(F.col("s").isNotNull()).select("s", "t.*")
