"""Tables, columns, keys, defaults and comments of a database, read over JDBC from its own catalogue.

One query over the catalogue's tables per call, sent in one partition per schema, so that no table is opened.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from wardline.sources.introspection import COLUMNS_SCHEMA, GEOSPATIAL_TYPES, SYSTEM_SCHEMAS


@dataclass(frozen=True)
class CatalogueQueries:
    """Queries for schemas (``schema_name``), tables (with ``table_name``, ``table_type`` table or view, ``comment``) and columns
    (with ``column_name``, ``position`` from 1, ``declared`` type, ``nullable`` 1 or 0, ``default_value``, ``key_places``: the
    positions of the primary key's columns between brackets)."""

    schemas: str
    tables: str
    columns: str
    system_schemas: tuple[str, ...] = SYSTEM_SCHEMAS


_PG_TABLES = """
    SELECT n.nspname AS schema_name, c.relname AS table_name,
           CASE WHEN c.relkind IN ('v', 'm') THEN 'view' ELSE 'table' END AS table_type,
           obj_description(c.oid, 'pg_class') AS comment
    FROM pg_catalog.pg_class c JOIN pg_catalog.pg_namespace n ON n.oid = c.relnamespace
    WHERE c.relkind IN ('r', 'p', 'f', 'v', 'm')"""

POSTGRESQL = CatalogueQueries(
    schemas="SELECT nspname AS schema_name FROM pg_catalog.pg_namespace",
    tables=_PG_TABLES,
    columns="""
    SELECT n.nspname AS schema_name, c.relname AS table_name, a.attname AS column_name, a.attnum AS position,
           pg_catalog.format_type(a.atttypid, a.atttypmod) AS declared,
           CASE WHEN a.attnotnull THEN 0 ELSE 1 END AS nullable,
           pg_catalog.pg_get_expr(d.adbin, d.adrelid) AS default_value,
           '(' || array_to_string(k.conkey, ', ') || ')' AS key_places
    FROM pg_catalog.pg_attribute a
    JOIN pg_catalog.pg_class c ON c.oid = a.attrelid AND c.relkind IN ('r', 'p', 'f', 'v', 'm')
    JOIN pg_catalog.pg_namespace n ON n.oid = c.relnamespace
    LEFT JOIN pg_catalog.pg_attrdef d ON d.adrelid = a.attrelid AND d.adnum = a.attnum
    LEFT JOIN pg_catalog.pg_constraint k ON k.conrelid = c.oid AND k.contype = 'p'
    WHERE a.attnum > 0 AND NOT a.attisdropped""",
)

DERBY = CatalogueQueries(
    schemas="SELECT SCHEMANAME AS schema_name FROM SYS.SYSSCHEMAS",
    tables="""
    SELECT s.SCHEMANAME AS schema_name, t.TABLENAME AS table_name,
           CAST(CASE WHEN t.TABLETYPE = 'V' THEN 'view' ELSE 'table' END AS VARCHAR(5)) AS table_type, CAST(NULL AS VARCHAR(1)) AS comment
    FROM SYS.SYSTABLES t JOIN SYS.SYSSCHEMAS s ON s.SCHEMAID = t.SCHEMAID WHERE t.TABLETYPE IN ('T', 'V')""",
    columns="""
    SELECT s.SCHEMANAME AS schema_name, t.TABLENAME AS table_name, c.COLUMNNAME AS column_name, c.COLUMNNUMBER AS position,
           CAST(c.COLUMNDATATYPE AS VARCHAR(200)) AS declared,
           CASE WHEN CAST(c.COLUMNDATATYPE AS VARCHAR(200)) LIKE '% NOT NULL' THEN 0 ELSE 1 END AS nullable,
           CAST(c.COLUMNDEFAULT AS VARCHAR(2000)) AS default_value, CAST(g.DESCRIPTOR AS VARCHAR(2000)) AS key_places
    FROM SYS.SYSCOLUMNS c JOIN SYS.SYSTABLES t ON t.TABLEID = c.REFERENCEID AND t.TABLETYPE IN ('T', 'V')
    JOIN SYS.SYSSCHEMAS s ON s.SCHEMAID = t.SCHEMAID
    LEFT JOIN SYS.SYSCONSTRAINTS p ON p.TABLEID = t.TABLEID AND p.TYPE = 'P'
    LEFT JOIN SYS.SYSKEYS k ON k.CONSTRAINTID = p.CONSTRAINTID
    LEFT JOIN SYS.SYSCONGLOMERATES g ON g.CONGLOMERATEID = k.CONGLOMERATEID""",
    system_schemas=("SYS", "SYSCAT", "SYSCS_DIAG", "SYSCS_UTIL", "SYSFUN", "SYSIBM", "SYSPROC", "SYSSTAT", "NULLID", "SQLJ"),
)

#: The catalogue queries of a database by the word after ``jdbc:`` in its address; more can be added.
DIALECTS = {"postgresql": POSTGRESQL, "derby": DERBY}


class UnknownDatabase(ValueError):
    """There are no catalogue queries for a database."""


def queries_for(url: str) -> CatalogueQueries:
    kind = url.split(":")[1] if url.startswith("jdbc:") else url
    if kind not in DIALECTS:
        raise UnknownDatabase(f"no catalogue queries for {kind}; known: {', '.join(sorted(DIALECTS))}")
    return DIALECTS[kind]


def _read(spark: SparkSession, options: Mapping[str, str], sql: str, schemas: Sequence[str] | None) -> DataFrame:
    """Rows of ``sql``, one partition per schema; column names in lower case whatever the database does to them."""
    properties = {k: v for k, v in options.items() if k not in ("url", "dbtable", "query")}
    source = f"({sql}) q"
    if schemas is None:
        df = spark.read.jdbc(options["url"], source, properties=properties)
    else:
        wanted = ["schema_name = '" + s.replace("'", "''") + "'" for s in schemas] or ["1 = 0"]
        df = spark.read.jdbc(options["url"], source, predicates=wanted, properties=properties)
    return df.toDF(*[c.lower() for c in df.columns])


def list_schemas(spark: SparkSession, options: Mapping[str, str]) -> list[str]:
    """The schemas of the database but the system's, sorted. Schema names are all that comes to the driver."""
    found = queries_for(options["url"])
    hidden = {s.lower() for s in found.system_schemas}
    names = [r.schema_name for r in _read(spark, options, found.schemas, None).collect()]
    return sorted(n for n in names if n.lower() not in hidden and not n.lower().startswith(("pg_temp", "pg_toast")))


def list_tables(
    spark: SparkSession, options: Mapping[str, str], include_views: bool = True, schemas: Sequence[str] | None = None
) -> DataFrame:
    """``(schema_name, table_name, table_type, comment)`` of ``schemas``, all but the system's unless given."""
    chosen = list_schemas(spark, options) if schemas is None else list(schemas)
    found = _read(spark, options, queries_for(options["url"]).tables, chosen)
    return found if include_views else found.filter(F.col("table_type") == "table")


def describe_columns(
    spark: SparkSession, options: Mapping[str, str], include_views: bool = True, schemas: Sequence[str] | None = None
) -> DataFrame:
    """One row per column, as ``introspection.describe_columns`` gives them; types as declared, in lower case.

    A table without columns has no rows; a column is geospatial if the type itself is, without its schema and parameters.
    """
    chosen = list_schemas(spark, options) if schemas is None else list(schemas)
    tables = list_tables(spark, options, include_views, chosen)
    columns = _read(spark, options, queries_for(options["url"]).columns, chosen)
    declared = F.regexp_replace(F.lower("declared"), r"\s+not null$", "")
    places = F.split(F.regexp_extract("key_places", r"\(([^()]*)\)", 1), r"\s*,\s*")
    described = columns.select(
        "schema_name",
        "table_name",
        "column_name",
        (F.col("position") - 1).cast("int").alias("position"),
        declared.alias("data_type"),
        (F.col("nullable") == 1).alias("nullable"),
        "default_value",
        F.regexp_extract(declared, r"^(?:[^(.]*\.)?\"?(\w+)", 1).isin(*GEOSPATIAL_TYPES).alias("is_geospatial"),
        F.coalesce(F.array_contains(places, F.col("position").cast("string")), F.lit(False)).alias("is_primary_key"),
    )
    names = [part.split()[0] for part in COLUMNS_SCHEMA.split(", ")]
    return described.join(tables, ["schema_name", "table_name"]).select(*names)
