"""Catalogue operators: visibility, search, validation, reconciliation, selection, identifiers."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from wardline.functions.globs import glob_regex
from wardline.operators.relational import distinct_on
from wardline.sources.schema import CATALOGUE, GOVERNANCE

# Accepted back ends, introspection defaults, medallion levels in match order.
BACKEND_TYPES = ("postgres", "s3", "fs", "quantumleap", "context_broker")
DEFAULT_NAMESPACE = "default"
DEFAULT_ACCESS_LEVEL = "internal"
DEFAULT_CLASSIFICATION = "yellow"
DEFAULT_RETENTION_DAYS = 365
MEDALLION_LEVELS = ("gold", "silver", "bronze")
OBJECT_FORMAT = "application/octet-stream"


# --- visibility and search ----------------------------------------------------------


def visible(catalogue: DataFrame) -> DataFrame:
    """Entries any catalogue surface may show: exposed and not secret (a missing level is not secret)."""
    level = F.col("access_level")
    return catalogue.filter(F.col("expose") & (level.isNull() | (level != "secret")))


def list_entries(catalogue: DataFrame) -> DataFrame:
    return visible(catalogue).orderBy("dataset_id")


def get_entry(catalogue: DataFrame, dataset_id: str) -> DataFrame:
    return visible(catalogue).filter(F.col("dataset_id") == dataset_id)


def search(
    catalogue: DataFrame, q: str | None = None, access_level: str | None = None, keywords: Sequence[str] | None = None
) -> DataFrame:
    """Visible entries meeting every given condition."""
    found = visible(catalogue)
    if access_level:
        found = found.filter(F.col("access_level") == access_level)
    if keywords:
        wanted = F.array(*[F.lit(k.lower()) for k in sorted(set(keywords))])
        lowered = F.transform(F.col("tags.keywords"), lambda k: F.lower(k))
        found = found.filter(F.arrays_overlap(lowered, wanted))
    if q:
        text = q.lower()
        found = found.filter(
            F.coalesce(F.lower("title").contains(text), F.lit(False))
            | F.coalesce(F.lower("description").contains(text), F.lit(False))
        )
    return found


# --- validation and reconciliation --------------------------------------------------


def validation_errors(entries: DataFrame) -> DataFrame:
    """Add ``errors``: what makes a document unfit for the catalogue (empty when fit)."""
    backend = F.col("backend_type")
    checks = F.array(
        F.when(F.col("dataset_id").isNull(), F.lit("dataset_id missing")),
        F.when(F.col("title").isNull(), F.lit("title missing")),
        F.when(backend.isNull(), F.lit("backend_type missing")).when(
            ~backend.isin(*BACKEND_TYPES), F.lit("backend_type unknown")
        ),
    )
    return entries.withColumn("errors", F.array_compact(checks))


def validate(entries: DataFrame, strict: bool = False) -> DataFrame:
    """Fit entries only; in strict mode evaluating an unfit one fails the job."""
    checked = validation_errors(entries)
    fit = F.size("errors") == 0
    if strict:
        message = F.concat_ws(": ", F.coalesce("dataset_id", F.lit("?")), F.array_join("errors", ", "))
        fit = F.when(fit, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    return checked.filter(fit).drop("errors")


def _flag_fit(entries: DataFrame, tables: DataFrame | None) -> DataFrame:
    """Add ``__fit``: false for relational entries that name a table which does not exist."""
    if tables is None:
        return entries.withColumn("__fit", F.lit(True))
    known = tables.select(F.col("table_name").alias("__table")).distinct()
    table = F.when(F.col("backend_type") == "postgres", F.col("backend_config.table"))
    marked = entries.withColumn("__want", table).join(known, F.col("__want") == F.col("__table"), "left")
    fit = F.col("__want").isNull() | F.col("__table").isNotNull()
    return marked.withColumn("__fit", fit).drop("__want", "__table")


def plan_import(
    current: DataFrame, incoming: DataFrame, tables: DataFrame | None = None, remove_stale: bool = False
) -> DataFrame:
    """Dry run: ``(dataset_id, action)`` with action create, update, skip or keep.

    With ``remove_stale``, entries that aren't in the import and whose table is gone get the action delete, as
    ``cleanup`` after the import would do.
    """
    now = current.select("dataset_id", F.lit(True).alias("has"))
    new = _flag_fit(incoming.select("dataset_id", "backend_type", "backend_config"), tables).select("dataset_id", "__fit")
    action = (
        F.when(F.col("__fit").isNull(), "keep")
        .when(~F.col("__fit"), "skip")
        .when(F.col("has").isNull(), "create")
        .otherwise("update")
    )
    new = new.groupBy("dataset_id").agg(F.bool_or("__fit").alias("__fit"))  # an id is taken if one of its entries is
    planned = now.join(new, "dataset_id", "full").select("dataset_id", action.alias("action"))
    if not remove_stale or tables is None:
        return planned
    stale = stale_entries(current, tables).select("dataset_id", F.lit(True).alias("__stale"))
    gone = (F.col("action") == "keep") & F.col("__stale").isNotNull()
    return planned.join(stale, "dataset_id", "left").select("dataset_id", F.when(gone, "delete").otherwise(F.col("action")).alias("action"))


def upsert(current: DataFrame, incoming: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """The catalogue after import: incoming entries overwrite by id, entries without their table are skipped.

    Adds ``import_action`` (``created``, ``updated`` or ``kept``). Of incoming entries with the same id the first is taken by
    title, description and the other columns; ``last_wins`` in ``sources.documents`` decides by order. Only entries whose id
    repeats are sorted whole; only ids meet the other side.
    """
    columns = current.columns
    fit = lambda entries: _flag_fit(entries, tables).filter("__fit")
    ids = fit(incoming.select("dataset_id", "backend_type", "backend_config")).groupBy(F.col("dataset_id").alias("__id"))
    repeated = ids.agg(F.count(F.lit(1)).alias("__times")).filter("__times > 1")
    marked = fit(incoming).join(repeated, F.col("dataset_id").eqNullSafe(F.col("__id")), "left")
    # Whole entries break ties, so that the one taken never depends on how the rows arrive. Others sort by their id alone.
    order = [F.when(F.col("__times") > 1, F.col(c) if isinstance(c, str) else c) for c in ("title", "description", F.to_json(F.struct(*columns)))]
    accepted = distinct_on(marked, ["dataset_id"], order).select(*columns)
    known = current.select(F.col("dataset_id").alias("__old")).distinct()
    taken = accepted.join(known, F.col("dataset_id") == F.col("__old"), "left")
    action = F.when(F.col("__old").isNull(), "created").otherwise("updated")
    kept = current.join(ids.agg(F.count(F.lit(1)).alias("__times")).withColumnRenamed("__id", "dataset_id"), "dataset_id", "left_anti")
    return taken.select(*columns, action.alias("import_action")).unionByName(
        kept.select(*columns, F.lit("kept").alias("import_action"))
    )


def import_counts(upserted: DataFrame) -> DataFrame:
    return upserted.agg(
        F.count_if(F.col("import_action") == "created").alias("created"),
        F.count_if(F.col("import_action") == "updated").alias("updated"),
    )


def stale_entries(catalogue: DataFrame, tables: DataFrame, validated: DataFrame | None = None) -> DataFrame:
    """Relational entries with no table reference, or whose table is gone."""
    relational = catalogue.filter(F.col("backend_type") == "postgres")
    present = tables.select(F.col("table_name").alias("__table"))
    if validated is not None:
        present = present.union(validated.select("table_name"))
    table = F.coalesce(F.col("backend_config.table"), F.lit(""))
    return relational.join(present, table == F.col("__table"), "left_anti")


def cleanup(catalogue: DataFrame, tables: DataFrame, validated: DataFrame | None = None) -> DataFrame:
    """The catalogue without stale entries; other back ends are left alone."""
    stale = stale_entries(catalogue, tables, validated).select("dataset_id")
    return catalogue.join(stale, "dataset_id", "left_anti")


# --- selection ----------------------------------------------------------------------


def _split_filters(filters: Iterable[str]) -> tuple[list[str], list[str]]:
    include, exclude = [], []
    for item in filters:
        if item.startswith("-"):
            exclude.append(item[1:])
        else:
            include.append(item[1:] if item.startswith("+") else item)
    return include, exclude


def select_namespaces(df: DataFrame, filters: Sequence[str], column: str = "namespace") -> DataFrame:
    """``*``, ``+ns``, ``-ns``, ``ns``; exclusions come last and something must be included."""
    include, exclude = _split_filters(filters)
    if not include:
        raise ValueError("no namespaces specified")
    if "*" not in include:
        df = df.filter(F.col(column).isin(include))
    return df.filter(~F.col(column).isin(exclude)) if exclude else df


def matches_globs(column: Column, patterns: Sequence[str]) -> Column:
    """Case-sensitive match against any shell pattern of a short, caller-typed list."""
    hit = F.lit(False)
    for pattern in patterns:
        hit = hit | F.rlike(column, glob_regex(F.lit(pattern)))
    return hit


def select_globs(df: DataFrame, filters: Sequence[str], column: str = "dataset_id") -> DataFrame:
    """``+glob``, ``-glob``, ``glob`` on ids; only exclusions means everything but those."""
    include, exclude = _split_filters(filters)
    if include:
        df = df.filter(matches_globs(F.col(column), include))
    if exclude:
        df = df.filter(~matches_globs(F.col(column), exclude))
    return df


# --- identifiers and labels ---------------------------------------------------------


def namespace_of(lineage: Column) -> Column:
    return F.coalesce(F.nullif(lineage["namespace"], F.lit("")), F.lit(DEFAULT_NAMESPACE))


def clean_id(name: Column) -> Column:
    """Lower case, dashes and blanks as underscores."""
    return F.translate(F.lower(name), "- ", "__")


def table_dataset_id(namespace: Column, schema: Column, table: Column) -> Column:
    """``namespace.schema.table``, or ``schema.table`` when namespace and schema coincide."""
    ns, sc, tb = clean_id(namespace), clean_id(schema), clean_id(table)
    return F.when(ns == sc, F.concat_ws(".", ns, tb)).otherwise(F.concat_ws(".", ns, sc, tb))


def physical_table(name: Column) -> Column:
    """Drop the first part of names with three or more parts."""
    parts = F.split(name, r"\.")
    return F.when(F.size(parts) >= 3, F.array_join(F.slice(parts, 2, F.size(parts) - 1), ".")).otherwise(name)


def namespace_group(dataset_id: Column, lineage: Column) -> Column:
    """Group label: the namespace, else the id without its last part, else the id."""
    dots = F.size(F.split(dataset_id, r"\.")) - 1
    stem = F.when(dots > 0, F.regexp_replace(dataset_id, r"\.[^.]*$", "")).otherwise(dataset_id)
    return F.coalesce(F.nullif(lineage["namespace"], F.lit("")), stem)


def group_by_namespace(catalogue: DataFrame) -> DataFrame:
    """Visible entries with their group label; titles fall back to the id."""
    return visible(catalogue).select(
        namespace_group(F.col("dataset_id"), F.col("lineage")).alias("group_name"),
        "dataset_id",
        F.coalesce(F.nullif("title", F.lit("")), F.col("dataset_id")).alias("title"),
    )


def medallion(facet: Column, name: Column) -> Column:
    """Declared medallion, else the first level named inside ``name``."""
    lowered = F.lower(name)
    named = F.lit(None).cast("string")
    for level in reversed(MEDALLION_LEVELS):
        named = F.when(lowered.contains(level), F.lit(level)).otherwise(named)
    return F.coalesce(F.nullif(facet, F.lit("")), named)


# --- row-filter editing -------------------------------------------------------------


def _edit_filters(catalogue: DataFrame, dataset_id: str, change) -> DataFrame:
    def edit(lineage: Column) -> Column:
        filters = F.coalesce(
            lineage["facets"]["governance"]["rowFilters"],
            F.array().cast("array<struct<handler:string,args:map<string,string>>>"),
        )
        edited = lineage.withField("facets.governance.rowFilters", change(filters))
        return F.when(F.col("dataset_id") == dataset_id, edited).otherwise(lineage)

    # Binding the struct once keeps the plan linear when several edits are chained.
    return catalogue.withColumn("lineage", F.get(F.transform(F.array("lineage"), edit), F.lit(0)))


def _args_column(args: dict[str, str] | None) -> Column:
    if not args:
        return F.lit(None).cast("map<string,string>")
    return F.create_map(*[F.lit(x) for pair in sorted(args.items()) for x in pair])


def _matches(spec: Column, handler: str, args: dict[str, str] | None) -> Column:
    """Same handler and, when arguments are given, the same arguments in any order."""
    hit = spec["handler"] == handler
    if args is None:
        return hit
    entries = lambda m: F.array_sort(F.map_entries(m))
    empty = F.create_map().cast("map<string,string>")
    stated = F.coalesce(spec["args"], empty)
    return hit & (entries(stated) == entries(F.coalesce(_args_column(args), empty)))


def add_row_filter(catalogue: DataFrame, dataset_id: str, handler: str, args: dict[str, str] | None = None) -> DataFrame:
    """Append a filter to a dataset unless exactly that filter is there."""
    new = F.struct(F.lit(handler).alias("handler"), _args_column(args).alias("args"))

    def change(filters: Column) -> Column:
        present = F.exists(filters, lambda s: _matches(s, handler, args or {}))
        return F.when(present, filters).otherwise(F.concat(filters, F.array(new)))

    return _edit_filters(catalogue, dataset_id, change)


def remove_row_filter(
    catalogue: DataFrame, dataset_id: str, handler: str, args: dict[str, str] | None = None
) -> DataFrame:
    """Remove a dataset's filters by handler, narrowed to exact arguments when given."""
    return _edit_filters(
        catalogue, dataset_id, lambda filters: F.filter(filters, lambda s: ~_matches(s, handler, args))
    )


def list_row_filters(catalogue: DataFrame) -> DataFrame:
    return catalogue.select("dataset_id", F.explode("lineage.facets.governance.rowFilters").alias("f")).select(
        "dataset_id", "f.handler", "f.args"
    )


# --- entries in the shape of the catalogue ------------------------------------------


def _conformed(value: Column, have: T.DataType, want: T.DataType) -> Column:
    """``value`` in the wanted type: members of structs by name, null where there are none."""
    if isinstance(want, T.StructType) and isinstance(have, T.StructType):
        members = [
            (_conformed(value[f.name], have[f.name].dataType, f.dataType) if f.name in have.fieldNames() else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in want.fields
        ]
        return F.when(value.isNotNull(), F.struct(*members))
    return value.cast(want)


def to_catalogue(entries: DataFrame) -> DataFrame:
    """``entries`` of any producer with exactly the columns of the catalogue; flags that aren't stated are false."""
    wanted = T.StructType.fromDDL(CATALOGUE)
    columns = [
        (_conformed(F.col(f.name), entries.schema[f.name].dataType, f.dataType) if f.name in entries.columns else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in wanted.fields
    ]
    return entries.select(*columns).withColumns({c: F.coalesce(c, F.lit(False)) for c in ("expose", "dataspace_expose")})


# --- entries from tables and lineage ------------------------------------------------


def entries_from_tables(columns: DataFrame, namespace: str, expose: bool = False) -> DataFrame:
    """Catalogue entries with safe defaults from an introspected columns table.

    ``columns`` has one row per column: ``schema_name, table_name, table_type, comment,
    is_geospatial, is_primary_key``.
    """
    tables = columns.groupBy("schema_name", "table_name", "table_type").agg(
        F.max("comment").alias("comment"),
        F.bool_or("is_geospatial").alias("geo"),
        F.bool_or("is_primary_key").alias("pk"),
    )
    physical = F.concat_ws(".", "schema_name", "table_name")
    keywords = F.array_compact(
        F.array(
            F.concat(F.lit("schema:"), F.col("schema_name")),
            F.concat(F.lit("type:"), F.col("table_type")),
            F.when(F.col("pk"), F.lit("has_pk")),
            F.when(F.col("geo"), F.lit("has_geospatial")),
            F.lit(f"classification:{DEFAULT_CLASSIFICATION}"),
        )
    )
    fallback = F.concat(F.col("table_type"), F.lit(" '"), physical, F.lit("'"))
    return to_catalogue(tables.select(
        table_dataset_id(F.lit(namespace), F.col("schema_name"), F.col("table_name")).alias("dataset_id"),
        physical.alias("title"),
        F.coalesce(F.nullif("comment", F.lit("")), fallback).alias("description"),
        F.lit("postgres").alias("backend_type"),
        F.struct(physical.alias("table")).alias("backend_config"),
        F.lit(expose).alias("expose"),
        F.struct(keywords.alias("keywords"), F.lit(DEFAULT_ACCESS_LEVEL).alias("accessRights")).alias("tags"),
        F.struct(
            F.lit(namespace).alias("namespace"),
            physical.alias("name"),
            F.lit("postgres").alias("sourceName"),
            F.struct(
                F.struct(
                    F.lit(DEFAULT_ACCESS_LEVEL).alias("accessLevel"),
                    F.lit(DEFAULT_CLASSIFICATION).alias("classification"),
                    F.lit(DEFAULT_RETENTION_DAYS).cast("bigint").alias("retentionDays"),
                    F.lit("postgres").alias("sourceSystem"),
                ).alias("governance")
            ).alias("facets"),
        ).alias("lineage"),
        F.lit(DEFAULT_ACCESS_LEVEL).alias("access_level"),
    ))


def entries_from_lineage(records: DataFrame, backend_type: str = "postgres", expose: bool = False) -> DataFrame:
    """Catalogue entries from lineage-store records whose facets are a map of JSON texts.

    The governance facet stays at ``lineage.facets.governance``, row filters included, without ``_`` bookkeeping keys.
    """
    none = F.array().cast("array<string>")
    gov = F.from_json(F.element_at("facets", "governance"), GOVERNANCE)
    blank = lambda c: F.nullif(c, F.lit(""))
    owners = F.coalesce(gov["owners"], none)
    own_tags = F.concat(F.coalesce("tags", none), F.transform(owners, lambda o: F.concat(F.lit("owner:"), o)))
    gov_tags = F.coalesce(gov["tags"], none)
    classification = blank(gov["classification"])
    class_tag = F.when(classification.isNotNull(), F.array(F.concat(F.lit("classification:"), classification)))
    merged = F.array_sort(F.array_distinct(F.concat(own_tags, gov_tags, F.coalesce(class_tag, none))))
    curated = (F.size(gov_tags) > 0) | classification.isNotNull()
    level = blank(gov["accessLevel"])
    config = (
        F.struct(F.col("physicalName").alias("table"))
        if backend_type == "postgres"
        else F.struct(F.col("physicalName").alias("path"), F.lit(OBJECT_FORMAT).alias("format"))
    )
    return to_catalogue(records.select(
        F.translate(F.lower("name"), " ", "_").alias("dataset_id"),
        F.coalesce(blank(gov["title"]), F.col("name")).alias("title"),
        F.coalesce(blank(gov["description"]), blank(F.col("description")), F.col("physicalName")).alias("description"),
        F.lit(backend_type).alias("backend_type"),
        config.alias("backend_config"),
        F.lit(expose).alias("expose"),
        F.struct(
            F.when(curated, merged).otherwise(own_tags).alias("keywords"),
            F.coalesce(blank(gov["accessRights"]), level).alias("accessRights"),
        ).alias("tags"),
        blank(gov["license"]).alias("license_uri"),
        F.when(F.size(owners) > 0, F.concat(F.lit("urn:team:"), F.get(owners, F.lit(0)))).alias("rights_holder_uri"),
        level.alias("access_level"),
        F.struct(
            "namespace",
            "name",
            "sourceName",
            "createdAt",
            F.coalesce("updatedAt", "lastModifiedAt").alias("updatedAt"),
            "lastLifecycleState",
            F.coalesce("tags", none).alias("tags"),
            F.struct(gov.alias("governance")).alias("facets"),
        ).alias("lineage"),
    ))
