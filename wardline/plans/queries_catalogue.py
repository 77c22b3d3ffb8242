"""Registered queries: catalogue documents, reconciliation, selection, rules, DCAT records, introspection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from wardline.operators import catalogue as cat_ops, dcat, rowfilters as rls, rules as rule_ops
from wardline.plans import testbed as tb
from wardline.plans.registry import Tables, query
from wardline.session import shared_folder
from wardline.sources import documents as docs, introspection as intro

# --- documents in and out -----------------------------------------------------------


@query(
    "load_catalogue_docs",
    tb.with_cat(
        """SELECT dataset_id, CASE WHEN quality = 1 THEN 'curated ' || title ELSE title END AS title,
                  length(description) AS chars, expose FROM cat"""
    ),
)
def load_catalogue_docs(t: Tables) -> DataFrame:
    entries = tb.catalogue(t).drop("doc_id")
    folder = shared_folder(t.spark, "catalogue")
    entries.write.json(f"{folder}/part=1")
    curated = entries.filter(F.col("lineage.facets.governance.medallion") == "curated")
    curated.withColumn("title", F.concat(F.lit("curated "), "title")).write.json(f"{folder}/part=2")
    loaded = docs.load_catalogue(t.spark, [f"{folder}/part=1", f"{folder}/part=2"])
    return loaded.select("dataset_id", "title", F.length("description").cast("bigint").alias("chars"), "expose")


def _lineage_records(t: Tables) -> DataFrame:
    """One lineage-store record per document; governance facets as JSON text."""
    lang, source = F.col("lang"), F.col("source")
    governance = F.to_json(
        F.struct(
            F.lit("urn:producer").alias("_producer"),
            F.when(lang == "fr", F.concat(F.lit("Jeu "), F.col("doc_id"))).alias("title"),
            F.when(lang != "es", F.array(source, F.lit("data-team"))).alias("owners"),
            F.when(lang == "en", F.lit("open")).alias("accessLevel"),
            F.when(lang == "de", F.lit("PUBLIC")).alias("accessRights"),
            F.when(F.col("n_chars") >= 2000, F.lit("green")).alias("classification"),
            F.when(lang == "fr", F.array(F.lit("zeta"), source)).alias("tags"),
            F.when(lang == "de", F.array(F.struct(F.lit("direct_user_match").alias("handler"), F.create_map(F.lit("column"), F.lit("user_id")).alias("args")))).alias("rowFilters"),
            F.when(F.lower("text").contains("license"), F.lit("https://creativecommons.org/licenses/by/4.0/")).alias("license"),
        )
    )
    return t.documents.select(
        source.alias("namespace"),
        F.concat(F.lit("Set "), "doc_id").alias("name"),
        F.concat(F.lit("ds_"), lang, F.lit(".set_"), "doc_id").alias("physicalName"),
        F.lit("lake").alias("sourceName"),
        F.lit("2024-01-01T00:00:00Z").alias("createdAt"),
        F.when(lang == "en", F.lit("2024-02-01T00:00:00Z")).alias("updatedAt"),
        F.lit("2024-03-01T00:00:00Z").alias("lastModifiedAt"),
        F.lit(None).cast("string").alias("lastLifecycleState"),
        F.when(F.col("n_chars") >= 500, F.col("text")).alias("description"),
        F.array(lang).alias("tags"),
        F.create_map(F.lit("governance"), governance, F.lit("schema"), F.lit("{}")).alias("facets"),
    )


@query(
    "load_lineage_docs",
    """SELECT source AS namespace, 'Set ' || CAST(doc_id AS VARCHAR) AS name,
              CASE WHEN lang = 'en' THEN '2024-02-01T00:00:00Z' END AS updated FROM documents WHERE source IN ('src1', 'src2', 'src5')""",
)
def load_lineage_docs(t: Tables) -> DataFrame:
    folder = shared_folder(t.spark, "lineage")
    _lineage_records(t).write.json(folder)
    loaded = docs.load_lineage(t.spark, folder, ["src1", "src2", "src5"])
    return loaded.select("namespace", "name", F.col("updatedAt").alias("updated"))


@query(
    "sink_catalogue_docs",
    tb.with_cat(
        """SELECT coalesce(nullif(namespace, ''), 'default') AS namespace, count(*) AS entries,
                  CAST(sum(length(description)) AS BIGINT) AS chars FROM cat GROUP BY 1"""
    ),
)
def sink_catalogue_docs(t: Tables) -> DataFrame:
    folder = shared_folder(t.spark, "export")
    docs.write_catalogue(tb.catalogue(t).drop("doc_id"), folder)
    written = t.spark.read.schema("dataset_id string, description string, namespace string").json(folder)
    return written.groupBy("namespace").agg(
        F.count("dataset_id").alias("entries"), F.sum(F.length("description")).cast("bigint").alias("chars")
    )


# --- visibility and search ----------------------------------------------------------


@query("cat_visible", tb.with_cat("SELECT dataset_id, access_level FROM cat WHERE expose AND access_level IS DISTINCT FROM 'secret'"))
def cat_visible(t: Tables) -> DataFrame:
    return cat_ops.visible(tb.catalogue(t)).select("dataset_id", "access_level")


@query(
    "cat_list",
    tb.with_cat("SELECT dataset_id, title, backend_type FROM cat WHERE expose AND access_level IS DISTINCT FROM 'secret' ORDER BY dataset_id"),
)
def cat_list(t: Tables) -> DataFrame:
    return cat_ops.list_entries(tb.catalogue(t)).select("dataset_id", "title", "backend_type")


@query(
    "cat_get",
    tb.with_cat("SELECT dataset_id, title FROM cat WHERE expose AND access_level IS DISTINCT FROM 'secret' AND dataset_id = 'datasets.ds_fr_gold.t_0'"),
)
def cat_get(t: Tables) -> DataFrame:
    return cat_ops.get_entry(tb.catalogue(t), "datasets.ds_fr_gold.t_0").select("dataset_id", "title")


@query(
    "cat_search",
    tb.with_cat(
        """SELECT dataset_id, 'text' AS mode FROM cat WHERE expose AND access_level IS DISTINCT FROM 'secret'
             AND (contains(lower(title), 'the') OR contains(lower(description), 'the'))
           UNION ALL SELECT dataset_id, 'all' FROM cat WHERE expose AND access_level = 'open' AND lang IN ('de', 'en')
             AND (contains(lower(title), 'gold') OR contains(lower(description), 'gold'))
           UNION ALL SELECT dataset_id, 'words' FROM cat WHERE expose AND access_level IS DISTINCT FROM 'secret' AND (lang = 'fr' OR source = 'src3')"""
    ),
)
def cat_search(t: Tables) -> DataFrame:
    cat = tb.catalogue(t)
    pick = lambda df, mode: df.select("dataset_id", F.lit(mode).alias("mode"))
    return (
        pick(cat_ops.search(cat, q="THE"), "text")
        .unionByName(pick(cat_ops.search(cat, "Gold", "open", ["de", "EN"]), "all"))
        .unionByName(pick(cat_ops.search(cat, keywords=["FR", "SRC3"]), "words"))
    )


# --- validation and reconciliation --------------------------------------------------


@query(
    "cat_validate",
    tb.with_cat(
        """SELECT dataset_id, CASE WHEN lang = 'es' AND med = 'gold' THEN 'title missing,backend_type unknown' WHEN lang = 'es' THEN 'backend_type unknown'
                  WHEN med = 'gold' THEN 'title missing' ELSE '' END AS errors, NOT (lang = 'es' OR med = 'gold') AS valid FROM cat"""
    ),
)
def cat_validate(t: Tables) -> DataFrame:
    cat = tb.catalogue(t)
    flawed = cat.withColumns(
        {
            "title": F.when(~F.array_contains("tags.keywords", "gold"), F.col("title")),
            "backend_type": F.when(F.col("backend_type") == "context_broker", F.lit("ftp")).otherwise(F.col("backend_type")),
        }
    )
    return cat_ops.validation_errors(flawed).select(
        "dataset_id", F.array_join("errors", ",").alias("errors"), (F.size("errors") == 0).alias("valid")
    )


def _import_sides(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Current catalogue (labelled or short), incoming entries (not German), existing tables (not bronze)."""
    cat = tb.catalogue(t)
    labelled = F.col("lineage.facets.governance.consentRequired").isNotNull()
    current = cat.filter(labelled | (F.col("backend_config.size_bytes") < 500)).drop("doc_id")
    incoming = cat.filter(F.col("backend_type") != "fs").withColumn("title", F.concat(F.lit("new "), "title")).drop("doc_id")
    tables = cat.filter(~F.array_contains("tags.keywords", "bronze")).select(F.col("backend_config.table").alias("table_name"))
    return current, incoming, tables.filter(F.col("table_name").isNotNull())


_SIDES = """, cur AS (SELECT * FROM cat WHERE quality IS NOT NULL OR n_chars < 500), inc AS (SELECT * FROM cat WHERE lang <> 'de'),
  tabs AS (SELECT tbl FROM cat WHERE tbl IS NOT NULL AND med <> 'bronze'),
  acc AS (SELECT * FROM inc WHERE tbl IS NULL OR tbl IN (SELECT tbl FROM tabs)) """


@query(
    "cat_upsert",
    tb.with_cat(
        _SIDES
        + """SELECT coalesce(a.dataset_id, c.dataset_id) AS dataset_id, CASE WHEN a.dataset_id IS NULL THEN c.title ELSE 'new ' || a.title END AS title,
             CASE WHEN a.dataset_id IS NULL THEN 'kept' WHEN c.dataset_id IS NULL THEN 'created' ELSE 'updated' END AS import_action
             FROM cur c FULL JOIN acc a ON c.dataset_id = a.dataset_id"""
    ),
)
def cat_upsert(t: Tables) -> DataFrame:
    return cat_ops.upsert(*_import_sides(t)).select("dataset_id", "title", "import_action")


@query(
    "cat_upsert_counts",
    tb.with_cat(
        _SIDES
        + """SELECT count(*) FILTER (WHERE c.dataset_id IS NULL) AS created, count(*) FILTER (WHERE c.dataset_id IS NOT NULL) AS updated
             FROM acc a LEFT JOIN cur c ON c.dataset_id = a.dataset_id"""
    ),
)
def cat_upsert_counts(t: Tables) -> DataFrame:
    return cat_ops.import_counts(cat_ops.upsert(*_import_sides(t)))


@query(
    "cat_plan",
    tb.with_cat(
        _SIDES
        + """SELECT coalesce(i.dataset_id, c.dataset_id) AS dataset_id, CASE WHEN i.dataset_id IS NULL AND c.lang = 'en' AND (c.tbl IS NULL OR c.tbl NOT IN (SELECT tbl FROM tabs)) THEN 'delete'
               WHEN i.dataset_id IS NULL THEN 'keep'
               WHEN i.dataset_id NOT IN (SELECT dataset_id FROM acc) THEN 'skip' WHEN c.dataset_id IS NULL THEN 'create' ELSE 'update' END AS action
             FROM cur c FULL JOIN inc i ON c.dataset_id = i.dataset_id"""
    ),
)
def cat_plan(t: Tables) -> DataFrame:
    return cat_ops.plan_import(*_import_sides(t), remove_stale=True)


def _validated(t: Tables) -> DataFrame:
    checked = tb.catalogue(t).filter(F.col("lineage.facets.governance.consentRequired").isNotNull())
    return checked.select(F.col("backend_config.table").alias("table_name")).filter(F.col("table_name").isNotNull())


_STALE = """lang = 'en' AND (tbl IS NULL OR NOT (med <> 'bronze' OR quality IS NOT NULL))"""


@query("anti_join_stale", tb.with_cat(f"SELECT dataset_id FROM cat WHERE {_STALE}"))
def anti_join_stale(t: Tables) -> DataFrame:
    _, _, tables = _import_sides(t)
    return cat_ops.stale_entries(tb.catalogue(t), tables, _validated(t)).select("dataset_id")


@query("cat_cleanup", tb.with_cat(f"SELECT dataset_id, backend_type FROM cat WHERE NOT ({_STALE})"))
def cat_cleanup(t: Tables) -> DataFrame:
    _, _, tables = _import_sides(t)
    return cat_ops.cleanup(tb.catalogue(t), tables, _validated(t)).select("dataset_id", "backend_type")


# --- selection and identifiers ------------------------------------------------------


@query(
    "select_namespaces",
    tb.with_cat(
        """SELECT dataset_id, 'star' AS mode FROM cat WHERE coalesce(nullif(namespace, ''), 'default') <> 'src1'
           UNION ALL SELECT dataset_id, 'named' FROM cat WHERE coalesce(nullif(namespace, ''), 'default') IN ('src2', 'default')"""
    ),
)
def select_namespaces(t: Tables) -> DataFrame:
    named = tb.catalogue(t).select("dataset_id", cat_ops.namespace_of(F.col("lineage")).alias("namespace"))
    pick = lambda filters, mode: cat_ops.select_namespaces(named, filters).select("dataset_id", F.lit(mode).alias("mode"))
    return pick(["*", "-src1"], "star").unionByName(pick(["+src2", "default", "src7", "-src7"], "named"))


@query(
    "select_globs",
    tb.with_cat(
        """SELECT dataset_id, 'both' AS mode FROM cat WHERE (lang = 'fr' OR (med = 'gold' AND lang IN ('de', 'en'))) AND NOT regexp_full_match(dataset_id, '.*[.]t_[0-9]')
           UNION ALL SELECT dataset_id, 'exclude' FROM cat WHERE med <> 'bronze'"""
    ),
)
def select_globs(t: Tables) -> DataFrame:
    ids = tb.catalogue(t).select("dataset_id")
    both = cat_ops.select_globs(ids, ["datasets.ds_fr_*", "+datasets.ds_[de][en]_gold.*", "-*.t_?"])
    without = cat_ops.select_globs(ids, ["-*_bronze.*"])
    return both.withColumn("mode", F.lit("both")).unionByName(without.withColumn("mode", F.lit("exclude")))


@query(
    "dataset_namespace",
    tb.with_cat("SELECT coalesce(nullif(namespace, ''), 'default') AS namespace, count(*) AS n FROM cat GROUP BY 1"),
)
def dataset_namespace(t: Tables) -> DataFrame:
    label = cat_ops.namespace_of(F.col("lineage")).alias("namespace")
    return tb.catalogue(t).groupBy(label).agg(F.count(F.lit(1)).alias("n"))


@query(
    "normalize_id",
    tb.with_cat(
        """SELECT title, replace(lower(title), ' ', '_') AS clean,
                  CASE WHEN med = 'gold' THEN 'my_space.' || replace(lower(title), ' ', '_')
                       ELSE 'my_space.' || lang || '_' || med || '.' || replace(lower(title), ' ', '_') END AS full_id FROM cat"""
    ),
)
def normalize_id(t: Tables) -> DataFrame:
    med = F.element_at("tags.keywords", 3)
    lang = F.element_at("tags.keywords", 1)
    schema = F.when(med == "gold", F.lit("my space")).otherwise(F.concat(lang, F.lit("-"), med))
    full = cat_ops.table_dataset_id(F.lit("My-Space"), schema, F.col("title"))
    return tb.catalogue(t).select("title", cat_ops.clean_id(F.col("title")).alias("clean"), full.alias("full_id"))


@query(
    "derive_physical",
    tb.with_cat(
        """SELECT dataset_id AS name, substr(dataset_id, 10) AS physical FROM cat
           UNION ALL SELECT tbl, tbl FROM cat WHERE tbl IS NOT NULL"""
    ),
)
def derive_physical(t: Tables) -> DataFrame:
    names = tb.catalogue(t).select(F.explode(F.array_compact(F.array("dataset_id", "backend_config.table"))).alias("name"))
    return names.select("name", cat_ops.physical_table(F.col("name")).alias("physical"))


@query(
    "group_by_namespace",
    tb.with_cat(
        """SELECT coalesce(nullif(namespace, ''), 'datasets.ds_' || lang || '_' || med) AS group_name, count(*) AS n,
                  min(dataset_id) AS first_id, max(title) AS last_title
           FROM cat WHERE expose AND access_level IS DISTINCT FROM 'secret' GROUP BY 1"""
    ),
)
def group_by_namespace(t: Tables) -> DataFrame:
    grouped = cat_ops.group_by_namespace(tb.catalogue(t))
    return grouped.groupBy("group_name").agg(
        F.count(F.lit(1)).alias("n"), F.min("dataset_id").alias("first_id"), F.max("title").alias("last_title")
    )


@query("infer_medallion", tb.with_cat("SELECT dataset_id, coalesce(facet_medallion, med) AS medallion FROM cat"))
def infer_medallion(t: Tables) -> DataFrame:
    label = cat_ops.medallion(F.col("lineage.facets.governance.medallion"), F.upper("dataset_id"))
    return tb.catalogue(t).select("dataset_id", label.alias("medallion"))


@query(
    "row_filter_edit",
    tb.with_cat(
        """SELECT dataset_id, handler, args FROM (
             SELECT dataset_id, 'table_pointer' AS handler, 'column=o_custkey,pointer_key_column=c_custkey,pointer_table=' || source AS args FROM cat WHERE lang = 'fr'
             UNION ALL SELECT dataset_id, 'http_in_list', 'column=device_id,list_table=' || source FROM cat WHERE lang = 'fr' AND dataset_id <> 'datasets.ds_fr_gold.t_0'
             UNION ALL SELECT dataset_id, 'direct_user_match', 'column=user_id' FROM cat WHERE dataset_id = 'datasets.ds_en_bronze.t_1')"""
    ),
)
def row_filter_edit(t: Tables) -> DataFrame:
    cat = tb.catalogue(t)
    first, second = ("datasets.ds_fr_gold.t_0", "datasets.ds_en_bronze.t_1")
    edited = cat_ops.add_row_filter(cat, second, "direct_user_match", {"column": "user_id"})
    edited = cat_ops.add_row_filter(edited, second, "direct_user_match", {"column": "user_id"})
    edited = cat_ops.remove_row_filter(edited, first, "http_in_list")
    edited = cat_ops.remove_row_filter(edited, first, "table_pointer", {"column": "other"})
    args = F.array_sort(F.transform(F.map_entries("args"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return cat_ops.list_row_filters(edited).select("dataset_id", "handler", F.array_join(args, ",").alias("args"))


# --- entries from tables and lineage ------------------------------------------------

_INTROSPECTED = {
    "orders": "o_orderkey:bigint o_custkey:bigint o_orderstatus:string o_totalprice:double o_orderdate:timestamp_ntz o_orderpriority:string",
    "events": "event_id:bigint ts:timestamp_ntz user_id:bigint event_type:string value:double props:string",
    "customer": "c_custkey:bigint c_name:string c_nationkey:int c_acctbal:double c_mktsegment:string",
    "documents": "doc_id:bigint text:string lang:string source:string n_chars:bigint",
    "labels": "doc_id:bigint quality:int toxic:int",
    "part": "p_partkey:bigint p_name:string p_brand:string p_type:string p_size:int p_retailprice:double",
}


def _described(t: Tables) -> DataFrame:
    return intro.describe_tables({n: getattr(t, n) for n in _INTROSPECTED}, "lake", observe_nulls=True)


def _columns_sql() -> str:
    selects = []
    for table, columns in _INTROSPECTED.items():
        for i, item in enumerate(columns.split()):
            name, kind = item.split(":")
            selects.append(
                f"SELECT 'lake' AS schema_name, '{table}' AS table_name, '{name}' AS column_name, {i} AS position, "
                f"'{kind}' AS data_type, count(*) > count({name}) AS nullable FROM {table}"
            )
    return "cols AS (" + " UNION ALL ".join(selects) + ")"


@query(
    "introspect_tables",
    " UNION ALL ".join(
        f"SELECT 'session' AS schema_name, 'lake_{n}' AS table_name, 'view' AS table_type, count(*) AS n_rows FROM {n}" for n in _INTROSPECTED
    ),
)
def introspect_tables(t: Tables) -> DataFrame:
    """The session's own tables, as listed, with their numbers of rows."""
    for name in _INTROSPECTED:
        getattr(t, name).createOrReplaceTempView(f"lake_{name}")
    listed = intro.list_tables(t.spark).filter(F.col("table_name").isin(*[f"lake_{n}" for n in _INTROSPECTED]))
    counts = [t.spark.table(f"lake_{n}").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("counted", F.lit(f"lake_{n}")) for n in _INTROSPECTED]
    return listed.join(reduce(DataFrame.unionByName, counts), F.col("table_name") == F.col("counted")).drop("counted")


@query(
    "introspect_columns",
    f"WITH {_columns_sql()} SELECT table_name, column_name, position, data_type, nullable, FALSE AS is_geospatial FROM cols",
)
def introspect_columns(t: Tables) -> DataFrame:
    return _described(t).select("table_name", "column_name", "position", "data_type", "nullable", "is_geospatial")


@query(
    "column_metadata",
    f"""WITH {_columns_sql()} SELECT column_name, data_type, nullable, column_name = 'o_orderkey' AS is_primary_key,
          CASE WHEN column_name = 'o_orderstatus' THEN 'O' END AS default_value FROM cols WHERE table_name = 'orders'""",
)
def column_metadata(t: Tables) -> DataFrame:
    declared = t.orders.withMetadata("o_orderkey", {"primary_key": True}).withMetadata("o_orderstatus", {"default": "O"})
    described = intro.describe_columns(declared, "lake", "orders", observe_nulls=True)
    return described.select("column_name", "data_type", "nullable", "is_primary_key", "default_value")


@query(
    "json_schema",
    f"""WITH {_columns_sql()} SELECT table_name, column_name,
          CASE data_type WHEN 'bigint' THEN 'integer' WHEN 'int' THEN 'integer' WHEN 'double' THEN 'number' ELSE 'string' END AS json_type,
          CASE data_type WHEN 'timestamp_ntz' THEN 'date-time' END AS json_format, nullable, NOT nullable AS required FROM cols""",
)
def json_schema(t: Tables) -> DataFrame:
    """Rendered documents, read back field by field."""
    documents = intro.json_schema(_described(t))
    shape = (
        "properties map<string,struct<type:string,nullable:boolean,format:string>>, required array<string>, "
        "additionalProperties boolean"
    )
    parsed = documents.select("table_name", F.from_json("json_schema", shape).alias("d"))
    return parsed.select("table_name", "d.required", F.explode("d.properties").alias("column_name", "p")).select(
        "table_name",
        "column_name",
        F.col("p.type").alias("json_type"),
        F.col("p.format").alias("json_format"),
        F.col("p.nullable").alias("nullable"),
        F.array_contains("required", F.col("column_name")).alias("required"),
    )


@query(
    "tables_to_entries",
    " UNION ALL ".join(
        f"""SELECT 'city.lake.{n}' AS dataset_id, 'lake.{n}' AS title, 'table ''lake.{n}''' AS description, 'lake.{n}' AS physical,
            'schema:lake,type:table,classification:yellow' AS keywords, 'internal' AS access_level, 365 AS retention FROM {n} HAVING count(*) > 0"""
        for n in _INTROSPECTED
    ),
)
def tables_to_entries(t: Tables) -> DataFrame:
    entries = cat_ops.entries_from_tables(_described(t), "city")
    return entries.select(
        "dataset_id",
        "title",
        "description",
        F.col("backend_config.table").alias("physical"),
        F.array_join("tags.keywords", ",").alias("keywords"),
        "access_level",
        F.col("lineage.facets.governance.retentionDays").cast("int").alias("retention"),
    )


@query(
    "lineage_to_entries",
    """SELECT 'set_' || CAST(doc_id AS VARCHAR) AS dataset_id,
              CASE WHEN lang = 'fr' THEN 'Jeu ' || CAST(doc_id AS VARCHAR) ELSE 'Set ' || CAST(doc_id AS VARCHAR) END AS title,
              CASE WHEN n_chars >= 500 THEN text ELSE 'ds_' || lang || '.set_' || CAST(doc_id AS VARCHAR) END AS description,
              CASE WHEN lang = 'es' THEN (CASE WHEN n_chars >= 2000 THEN 'classification:green,es' ELSE 'es' END)
                   WHEN lang = 'fr' THEN (CASE WHEN n_chars >= 2000 THEN 'classification:green,' ELSE '' END) || 'fr,owner:data-team,owner:' || source || ',' || source || ',zeta'
                   WHEN n_chars >= 2000 THEN 'classification:green,' || lang || ',owner:data-team,owner:' || source
                   ELSE lang || ',owner:' || source || ',owner:data-team' END AS keywords,
              CASE WHEN lang = 'en' THEN 'open' WHEN lang = 'de' THEN 'PUBLIC' END AS rights,
              CASE WHEN contains(lower(text), 'license') THEN 'https://creativecommons.org/licenses/by/4.0/' END AS license_uri,
              CASE WHEN lang <> 'es' THEN 'urn:team:' || source END AS rights_holder_uri,
              CASE WHEN lang = 'en' THEN 'open' END AS access_level,
              CASE WHEN lang = 'en' THEN '2024-02-01T00:00:00Z' ELSE '2024-03-01T00:00:00Z' END AS updated, FALSE AS bookkeeping FROM documents""",
)
def lineage_to_entries(t: Tables) -> DataFrame:
    entries = cat_ops.entries_from_lineage(_lineage_records(t))
    return entries.select(
        "dataset_id",
        "title",
        "description",
        F.array_join("tags.keywords", ",").alias("keywords"),
        F.col("tags.accessRights").alias("rights"),
        "license_uri",
        "rights_holder_uri",
        "access_level",
        F.col("lineage.updatedAt").alias("updated"),
        F.to_json("lineage.facets.governance").contains("_producer").alias("bookkeeping"),
    )


# --- governance rules ---------------------------------------------------------------

DEFAULT_RULE = {
    "access_level": "internal",
    "license": "https://example.org/license",
    "dcat.themes": '["https://data.example.org/theme/ENER"]',
    "dcat.conforms_to": "http://www.w3.org/ns/sosa/",
    "expose": "true",
}


def _map(pairs: dict[str, str | None]) -> "F.Column":
    return F.create_map(*[F.lit(x).cast("string") for kv in pairs.items() for x in kv])


def _rules(t: Tables) -> DataFrame:
    """Rules by exact id, by language, by language and gold, and by ids ending in 7; Spanish has no language rule."""
    cat = tb.catalogue(t)
    curated = cat.filter(F.col("lineage.facets.governance.medallion") == "curated")
    exact = curated.select(
        F.col("dataset_id").alias("pattern"), _map({"access_level": "open", "dcat.conforms_to": None}).alias("overlay")
    )
    langs = t.documents.select("lang").filter(F.col("lang") != "es").distinct()
    owner = F.to_json(F.array(F.struct(F.concat(F.lit("alias-"), "lang").alias("name"))))
    by_lang = langs.select(
        F.concat(F.lit("datasets.ds_"), "lang", F.lit("_*")).alias("pattern"),
        F.map_concat(
            _map({"license": None, "dataspace.expose": "true", "tags": '["b","a"]', "classification": "green"}),
            F.create_map(F.lit("ownership"), owner),
        ).alias("overlay"),
    )
    gold = langs.select(
        F.concat(F.lit("datasets.ds_"), "lang", F.lit("_gold.*")).alias("pattern"),
        _map({"dcat": None, "title": "Gold set", "documentation_url": "https://data.example.org/doc"}).alias("overlay"),
    )
    digits = t.documents.agg(F.max("doc_id")).select(
        F.lit("*.t_*[7]").alias("pattern"), _map({"expose": "false", "dataspace.expose": "true"}).alias("overlay")
    )
    return exact.unionByName(by_lang).unionByName(gold).unionByName(digits)


def _resolved(t: Tables) -> DataFrame:
    names = tb.catalogue(t).select(F.col("dataset_id").alias("dataset_name"))
    found = rule_ops.resolve_rules(names, _rules(t))
    return found.withColumn("rule", rule_ops.overlay(_map(DEFAULT_RULE), F.col("overlay")))


_RULED = """, ruled AS (SELECT *, CASE WHEN quality = 1 THEN 'exact' WHEN lang <> 'es' AND med = 'gold' THEN 'gold' WHEN lang <> 'es' THEN 'lang'
  WHEN doc_id % 10 = 7 THEN 'digit' ELSE 'default' END AS rule_kind FROM cat) """


@query(
    "resolve_rule",
    tb.with_cat(
        _RULED
        + """SELECT dataset_id AS dataset_name, CASE rule_kind WHEN 'exact' THEN dataset_id WHEN 'gold' THEN 'datasets.ds_' || lang || '_gold.*'
               WHEN 'lang' THEN 'datasets.ds_' || lang || '_*' WHEN 'digit' THEN '*.t_*[7]' END AS pattern FROM ruled"""
    ),
)
def resolve_rule(t: Tables) -> DataFrame:
    names = tb.catalogue(t).select(F.col("dataset_id").alias("dataset_name"))
    return rule_ops.resolve_rules(names, _rules(t)).select("dataset_name", "pattern")


@query(
    "overlay_rule",
    tb.with_cat(
        _RULED
        + """SELECT dataset_id AS dataset_name, CASE WHEN rule_kind = 'exact' THEN 'open' ELSE 'internal' END AS access_level,
               CASE WHEN rule_kind <> 'lang' THEN 'https://example.org/license' END AS license,
               CASE WHEN rule_kind NOT IN ('exact', 'gold') THEN 'http://www.w3.org/ns/sosa/' END AS conforms_to,
               CASE WHEN rule_kind <> 'gold' THEN '["https://data.example.org/theme/ENER"]' END AS themes,
               rule_kind = 'exact' OR rule_kind NOT IN ('gold') AS states_conforms_to,
               CAST(CASE rule_kind WHEN 'exact' THEN 5 WHEN 'gold' THEN 6 WHEN 'lang' THEN 9 WHEN 'digit' THEN 6 ELSE 5 END AS INTEGER) AS paths FROM ruled"""
    ),
)
def overlay_rule(t: Tables) -> DataFrame:
    r = F.col("rule")
    return _resolved(t).select(
        "dataset_name",
        rule_ops.value_at(r, "access_level").alias("access_level"),
        rule_ops.value_at(r, "license").alias("license"),
        rule_ops.value_at(r, "dcat.conforms_to").alias("conforms_to"),
        rule_ops.value_at(r, "dcat.themes").alias("themes"),
        F.map_contains_key(r, "dcat.conforms_to").alias("states_conforms_to"),
        F.size(r).alias("paths"),
    )


@query(
    "exposure_gates",
    tb.with_cat(
        _RULED
        + "SELECT dataset_id AS dataset_name, rule_kind <> 'digit' AS expose, rule_kind IN ('lang', 'digit') AS offered FROM ruled"
    ),
)
def exposure_gates(t: Tables) -> DataFrame:
    r = F.col("rule")
    return _resolved(t).select(
        "dataset_name", rule_ops.effective_expose(r).alias("expose"), rule_ops.dataspace_offer(r).alias("offered")
    )


@query("exposure_conflict", tb.with_cat(_RULED + "SELECT dataset_id AS dataset_name FROM ruled WHERE rule_kind = 'digit'"))
def exposure_conflict(t: Tables) -> DataFrame:
    return rule_ops.exposure_conflicts(_resolved(t)).select("dataset_name")


def _owners(t: Tables) -> DataFrame:
    """One owner per source and one per language; some have a DID, some a URL, some neither."""
    source = t.documents.select(F.col("source").alias("id")).distinct()
    lang = t.documents.select(F.concat(F.lit("org-"), "lang").alias("id")).distinct()
    c = F.col("id")
    by_source = source.select(
        "id",
        F.lit("schema:NGO").alias("type"),
        F.upper(c).alias("name"),
        F.when(~c.endswith("3"), F.concat(F.lit("https://"), c, F.lit(".example.org"))).alias("url"),
        F.when(c.endswith("1"), F.concat(F.lit("did:web:"), c)).alias("did"),
        F.array(F.concat(F.lit("alias-"), c)).alias("aliases"),
    )
    by_lang = lang.select(
        "id",
        F.lit("foaf:Organization").alias("type"),
        F.lit(None).cast("string").alias("name"),
        F.concat(F.lit("https://"), c, F.lit(".example.org")).alias("url"),
        F.lit(None).cast("string").alias("did"),
        F.array(F.concat(F.lit("alias-"), F.substring(c, 5, 9))).alias("aliases"),
    )
    return by_source.unionByName(by_lang)


@query(
    "owner_uri",
    tb.with_cat(
        """, named AS (SELECT dataset_id, source, CASE lang WHEN 'en' THEN source WHEN 'fr' THEN 'alias-' || source WHEN 'de' THEN 'ghost-' || source END AS owner, lang FROM cat)
           SELECT dataset_id, owner, CASE WHEN owner IS NULL THEN NULL WHEN lang = 'de' OR (source LIKE '%3') THEN 'urn:owner:' || owner
                  WHEN source LIKE '%1' THEN 'did:web:' || source ELSE 'https://' || source || '.example.org' END AS uri FROM named"""
    ),
)
def owner_uri(t: Tables) -> DataFrame:
    lang, source = F.element_at("tags.keywords", 1), F.element_at("tags.keywords", 2)
    owner = (
        F.when(lang == "EN", source)
        .when(lang == "FR", F.concat(F.lit("alias-"), source))
        .when(lang == "DE", F.concat(F.lit("ghost-"), source))
    )
    named = tb.catalogue(t).select("dataset_id", owner.alias("owner"))
    return rule_ops.with_owner_uri(named, _owners(t), "owner", "uri").select("dataset_id", "owner", "uri")


@query(
    "rules_to_entries",
    tb.with_cat(
        _RULED
        + """SELECT dataset_id, CASE WHEN rule_kind = 'gold' THEN 'Gold set' ELSE dataset_id END AS title, substr(dataset_id, 10) AS description,
               substr(dataset_id, 10) AS physical, TRUE AS expose, rule_kind = 'lang' AS offered,
               CASE WHEN rule_kind = 'lang' THEN 'a,b,classification:green,owner:alias-' || lang ELSE '' END AS keywords,
               CASE WHEN rule_kind = 'exact' THEN 'open' ELSE 'internal' END AS access_level,
               CASE WHEN rule_kind <> 'gold' THEN 'https://data.example.org/theme/ENER' END AS themes,
               CASE WHEN rule_kind = 'lang' THEN 'https://org-' || lang || '.example.org' END AS publisher_uri,
               CASE WHEN rule_kind = 'gold' THEN 'https://data.example.org/doc' END AS landing_page
             FROM ruled WHERE rule_kind <> 'digit'"""
    ),
)
def rules_to_entries(t: Tables) -> DataFrame:
    entries = rule_ops.entries_from_rules(rule_ops.without_conflicts(_resolved(t)), _owners(t))
    return entries.select(
        "dataset_id",
        "title",
        "description",
        F.col("backend_config.table").alias("physical"),
        "expose",
        F.col("dataspace_expose").alias("offered"),
        F.array_join("tags.keywords", ",").alias("keywords"),
        "access_level",
        F.array_join("tags.themes", ",").alias("themes"),
        "publisher_uri",
        "landing_page",
    )


# --- from producers into the catalogue -----------------------------------------------


def _imported(t: Tables, entries: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """The whole way of an import: select, validate, upsert, clean up, read the row filters of what came in."""
    selected = cat_ops.select_globs(entries, ["*"])
    fit = cat_ops.validate(selected)
    if tables is None:
        tables = fit.select(F.col("backend_config.table").alias("table_name")).filter(F.col("table_name").isNotNull())
    after = cat_ops.upsert(cat_ops.to_catalogue(tb.catalogue(t)), fit, tables)
    clean = cat_ops.cleanup(after, tables).filter("import_action <> 'kept'")
    found = clean.select("dataset_id", "import_action", "access_level", F.explode_outer(rls.specs_column()).alias("spec"))
    return found.select("dataset_id", "import_action", "access_level", "spec.handler", F.col("spec.args")["column"].alias("filter_column"))


@query(
    "import_rules",
    tb.with_cat(
        _RULED
        + """SELECT dataset_id, 'updated' AS import_action, CASE WHEN rule_kind = 'exact' THEN 'open' ELSE 'internal' END AS access_level,
               CASE WHEN rule_kind = 'gold' THEN 'direct_user_match' END AS handler, CASE WHEN rule_kind = 'gold' THEN 'owner_id' END AS filter_column
             FROM ruled WHERE rule_kind <> 'digit'"""
    ),
)
def import_rules(t: Tables) -> DataFrame:
    filters = '[{"handler": "direct_user_match", "args": {"column": "owner_id"}}]'
    gold = _rules(t).filter(F.col("pattern").endswith("_gold.*"))
    override = gold.select("pattern", _map({"row_filters": filters}).alias("overlay"))
    layered = rule_ops.layer_rules(_rules(t), override)
    names = tb.catalogue(t).select(F.col("dataset_id").alias("dataset_name"))
    resolved = rule_ops.resolve_rules(names, layered).withColumn("rule", rule_ops.overlay(_map(DEFAULT_RULE), F.col("overlay")))
    return _imported(t, rule_ops.entries_from_rules(rule_ops.without_conflicts(resolved), _owners(t)))


@query(
    "import_lineage",
    """SELECT 'set_' || CAST(doc_id AS VARCHAR) AS dataset_id, 'created' AS import_action, CASE WHEN lang = 'en' THEN 'open' END AS access_level,
              CASE WHEN lang = 'de' THEN 'direct_user_match' END AS handler, CASE WHEN lang = 'de' THEN 'user_id' END AS filter_column FROM documents""",
)
def import_lineage(t: Tables) -> DataFrame:
    return _imported(t, cat_ops.entries_from_lineage(_lineage_records(t)))


@query(
    "import_tables",
    " UNION ALL ".join(
        f"""SELECT 'city.lake.{n}' AS dataset_id, 'created' AS import_action, 'internal' AS access_level, CAST(NULL AS VARCHAR) AS handler,
            CAST(NULL AS VARCHAR) AS filter_column FROM {n} HAVING count(*) > 0"""
        for n in _INTROSPECTED
    ),
)
def import_tables(t: Tables) -> DataFrame:
    present = t.spark.createDataFrame([(f"lake.{n}",) for n in _INTROSPECTED], "table_name string")
    described = intro.describe_tables({n: getattr(t, n) for n in _INTROSPECTED}, "lake")
    return _imported(t, cat_ops.entries_from_tables(described, "city"), present)


# --- DCAT records -------------------------------------------------------------------


@query(
    "agent_node",
    tb.with_cat(
        """SELECT dataset_id, publisher_uri AS uri, CASE WHEN source NOT LIKE '%3' THEN 'foaf:Organization,schema:NGO' END AS types,
                  CASE WHEN source NOT LIKE '%3' THEN upper(source) END AS name,
                  CASE WHEN source NOT LIKE '%3' THEN publisher_uri END AS homepage FROM cat WHERE publisher_uri IS NOT NULL"""
    ),
)
def agent_node(t: Tables) -> DataFrame:
    named = tb.catalogue(t).filter(F.col("publisher_uri").isNotNull()).select("dataset_id", "publisher_uri")
    node = dcat.agent_columns(named, _owners(t), "publisher_uri", "node")
    return node.select(
        "dataset_id",
        F.col("node")["@id"].alias("uri"),
        F.array_join(F.col("node")["@type"], ",").alias("types"),
        F.col("node")["foaf:name"].alias("name"),
        F.col("node")["foaf:homepage"]["@id"].alias("homepage"),
    )


@query(
    "odrl_offer",
    tb.with_cat(
        """SELECT dataset_id, concat_ws(',', CASE WHEN coalesce(access_level, 'internal') IN ('internal', 'restricted') THEN 'ds:accessScope=dataspaces.query' END,
             CASE WHEN access_level = 'restricted' OR lang = 'fr' OR quality = 0 THEN 'ds:consentStatus=active' END) AS constraints FROM cat"""
    ),
)
def odrl_offer(t: Tables) -> DataFrame:
    gov = F.col("lineage.facets.governance")
    found = dcat.offer_constraints(F.col("access_level"), F.size(gov["rowFilters"]) > 0, gov["consentRequired"])
    text = F.transform(found, lambda c: F.concat_ws("=", c["odrl:leftOperand"]["@id"], c["odrl:rightOperand"]))
    return tb.catalogue(t).select("dataset_id", F.array_join(text, ",").alias("constraints"))


_REF = "struct<`@id`:string>"
_NODE = (
    f"`@id` string, `dct:title` string, `dct:description` string, `dct:isPartOf` {_REF}, "
    "`dct:publisher` struct<`@id`:string,`foaf:name`:string>, `dct:temporal` struct<`dcat:startDate`:string>, "
    f"`dcat:contactPoint` struct<`vcard:hasEmail`:string>, `dct:conformsTo` {_REF}, `ds:medallion` string, "
    f"`dcat:distribution` array<struct<`dct:accessRights`:{_REF},`dcat:downloadURL`:{_REF},`dct:license`:{_REF},"
    "`dcat:keyword`:array<string>,`dcat:byteSize`:bigint>>"
)


@query(
    "dcat_dataset",
    tb.with_cat(
        f"""SELECT dataset_id, '{tb.BASE_URI}/' || dataset_id AS uri, title, description,
               CASE coalesce(access_level, 'internal') WHEN 'open' THEN 'PUBLIC' WHEN 'internal' THEN 'RESTRICTED' WHEN 'restricted' THEN 'NON_PUBLIC' END AS access_right,
               CASE WHEN access_level = 'open' THEN 'https://data.example.org/file/' || CAST(doc_id AS VARCHAR) END AS download,
               license_uri AS license, '["' || upper(lang) || '","' || source || '","' || med || '"]' AS keywords,
               CASE WHEN nullif(namespace, '') IS NOT NULL THEN '{tb.BASE_URI}/' || namespace END AS part_of,
               coalesce(publisher_uri, '{tb.CATALOG_URI}') AS publisher,
               CASE WHEN publisher_uri IS NOT NULL AND source NOT LIKE '%3' THEN upper(source) END AS publisher_name,
               CASE WHEN lang = 'fr' THEN '2024-01-01' END AS start_date, CASE WHEN lang = 'de' THEN source || '@example.org' END AS email,
               CASE WHEN lang = 'en' THEN 'https://saref.etsi.org/core/' END AS conforms_to, coalesce(facet_medallion, med) AS medallion,
               n_chars AS bytes FROM cat"""
    ),
)
def dcat_dataset(t: Tables) -> DataFrame:
    nodes = dcat.dataset_nodes(tb.catalogue(t), _owners(t), tb.BASE_URI, tb.CATALOG_URI, tb.API_BASE)
    documents = nodes.select("dataset_id", F.to_json("node").alias("document"))
    d = documents.select("dataset_id", F.from_json("document", _NODE).alias("d"))
    node, dist = F.col("d"), F.get(F.col("d")["dcat:distribution"], F.lit(0))
    return d.select(
        "dataset_id",
        node["@id"].alias("uri"),
        node["dct:title"].alias("title"),
        node["dct:description"].alias("description"),
        F.substring_index(dist["dct:accessRights"]["@id"], "/", -1).alias("access_right"),
        dist["dcat:downloadURL"]["@id"].alias("download"),
        dist["dct:license"]["@id"].alias("license"),
        F.to_json(dist["dcat:keyword"]).alias("keywords"),
        node["dct:isPartOf"]["@id"].alias("part_of"),
        node["dct:publisher"]["@id"].alias("publisher"),
        node["dct:publisher"]["foaf:name"].alias("publisher_name"),
        node["dct:temporal"]["dcat:startDate"].alias("start_date"),
        node["dcat:contactPoint"]["vcard:hasEmail"].alias("email"),
        node["dct:conformsTo"]["@id"].alias("conforms_to"),
        node["ds:medallion"].alias("medallion"),
        dist["dcat:byteSize"].alias("bytes"),
    )


@query(
    "dcat_catalog",
    tb.with_cat(
        f"""SELECT 'catalog' AS part, '{tb.CATALOG_URI}' AS id, '{tb.CATALOG_URI}' AS node_id
            UNION ALL SELECT 'service', '{tb.CATALOG_URI}/service', '{tb.CATALOG_URI}/service'
            UNION ALL SELECT p.part, dataset_id, CASE p.part WHEN 'dataset' THEN '{tb.BASE_URI}/' || dataset_id ELSE '{tb.CATALOG_URI}/service' END
            FROM cat, (SELECT 'serves' AS part UNION ALL SELECT 'dataset') p WHERE access_level IS DISTINCT FROM 'secret'"""
    ),
)
def dcat_catalog(t: Tables) -> DataFrame:
    rows = dcat.catalog(tb.catalogue(t), _owners(t), "City data", tb.BASE_URI, tb.CATALOG_URI, tb.API_BASE)
    return rows.select("part", "id", F.get_json_object("document", "$['@id']").alias("node_id"))


@query(
    "iso_date",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN 'n/a ' || CAST(user_id AS VARCHAR) WHEN event_type = 'signup' THEN '2024-13-45T00:00:00'
              ELSE strftime(ts, '%Y-%m-%d') END AS day FROM events""",
)
def iso_date(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    text = (
        F.when(kind == "error", F.concat(F.lit("n/a "), F.col("user_id")))
        .when(kind == "signup", F.lit("2024-13-45T00:00:00"))
        .when(kind == "view", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(kind == "click", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+02:00'"))
        .otherwise(F.date_format("ts", "yyyy-MM-dd"))
    )
    return t.events.select("event_id", dcat.iso_date(text).alias("day"))
