"""Schema introspection: tables, columns, JSON Schema."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from wardline.functions.geo import GEOMETRY_TYPE

# Geospatial type names, system schemas, JSON Schema dialect.
GEOSPATIAL_TYPES = (
    "geography", "geometry", "point", "linestring", "polygon", "multipoint", "multilinestring",
    "multipolygon", "geometrycollection", "raster",
)
SYSTEM_SCHEMAS = ("pg_catalog", "pg_toast", "information_schema")
JSON_SCHEMA_DIALECT = "https://json-schema.org/draft/2020-12/schema"

COLUMNS_SCHEMA = (
    "schema_name string, table_name string, table_type string, comment string, column_name string, "
    "position int, data_type string, nullable boolean, default_value string, is_geospatial boolean, "
    "is_primary_key boolean"
)


def list_tables(spark: SparkSession, include_views: bool = True, jdbc: Mapping[str, str] | None = None) -> DataFrame:
    """``(schema_name, table_name, table_type)`` of the session catalog without system schemas, and of the database that the
    options ``jdbc`` lead to."""
    rows = []
    for db in spark.catalog.listDatabases():
        if db.name in SYSTEM_SCHEMAS:
            continue
        for t in spark.catalog.listTables(db.name):
            kind = "view" if t.tableType in ("VIEW", "TEMPORARY") else "table"
            if kind == "table" or include_views:
                rows.append((db.name if not t.isTemporary else "session", t.name, kind))
    listed = spark.createDataFrame(sorted(set(rows)), "schema_name string, table_name string, table_type string")
    if jdbc is None:
        return listed
    from wardline.sources import jdbc_catalogue  # which builds on this module

    return listed.unionByName(jdbc_catalogue.list_tables(spark, jdbc, include_views).drop("comment"))


def type_name(data_type: T.DataType) -> str:
    """Type name as introspection shows it; the geometry struct reads ``geometry``."""
    text = data_type.simpleString()
    return "geometry" if text == GEOMETRY_TYPE else text


def describe_columns(
    df: DataFrame, schema_name: str, table_name: str, table_type: str = "table", observe_nulls: bool = False
) -> DataFrame:
    """One row per column.

    Comment, default and primary key come from field metadata (``comment``, ``default``,
    ``primary_key``). Parquet declares every column nullable, so ``observe_nulls`` asks the
    data instead: a column is nullable when a null occurs (one aggregation over the table).
    """
    rows = []
    for i, f in enumerate(df.schema.fields):
        name = type_name(f.dataType)
        geospatial = re.split(r"\W", name.lower())[0] in GEOSPATIAL_TYPES  # the type itself, not names of members
        rows.append(
            (
                schema_name,
                table_name,
                table_type,
                (df.schema.fields[0].metadata or {}).get("table_comment"),
                f.name,
                i,
                name,
                f.nullable,
                f.metadata.get("default"),
                geospatial,
                bool(f.metadata.get("primary_key", False)),
            )
        )
    described = df.sparkSession.createDataFrame(rows, COLUMNS_SCHEMA)
    if not observe_nulls:
        return described
    flags = df.agg(*[F.bool_or(F.col(f"`{f.name}`").isNull()).alias(str(i)) for i, f in enumerate(df.schema.fields)])
    seen = F.array(*[F.coalesce(F.col(f"`{i}`"), F.lit(False)) for i in range(len(rows))])
    observed = flags.select(F.posexplode(seen).alias("position", "observed"))
    return described.join(observed, "position").withColumn("nullable", F.col("observed")).select(*described.columns)


def describe_tables(tables: Mapping[str, DataFrame], schema_name: str, observe_nulls: bool = False) -> DataFrame:
    parts = [describe_columns(df, schema_name, name, observe_nulls=observe_nulls) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def json_type(data_type: Column) -> tuple[Column, Column]:
    """``(type, format)`` of JSON Schema for a Spark or SQL type name; intervals are text durations."""
    t = F.lower(data_type)
    geometry = t.rlike(r"^(geometry|geography)\b")
    kind = (
        F.when(t.startswith("interval"), "string")
        .when(t.isin("tinyint", "smallint", "int", "integer", "bigint"), "integer")
        .when(t.rlike(r"^(decimal|numeric)\b") | t.isin("float", "double", "real", "double precision"), "number")
        .when(t == "boolean", "boolean")
        .when(t.startswith("struct") | t.startswith("map") | t.isin("variant", "json", "jsonb") | geometry, "object")
        .otherwise("string")
    )
    fmt = (
        F.when(t.startswith("interval"), "duration")
        .when(t.startswith("timestamp"), "date-time")
        .when(t == "date", "date")
        .when(t.startswith("time"), "time")
        .when(geometry, "geojson")
    )
    return kind, fmt


def json_schema_properties(columns: DataFrame) -> DataFrame:
    """Per column: JSON type, format, nullable and required."""
    kind, fmt = json_type(F.col("data_type"))
    return columns.select(
        "schema_name",
        "table_name",
        "column_name",
        "position",
        kind.alias("json_type"),
        fmt.alias("json_format"),
        "nullable",
        (~F.col("nullable")).alias("required"),
    )


def json_schema(columns: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """``(schema_name, table_name, json_schema)``; of the listed ``tables``, one without columns gets the empty schema."""
    p = json_schema_properties(columns)
    prop = F.struct(F.col("json_type").alias("type"), "nullable", F.col("json_format").alias("format"))
    grouped = p.groupBy("schema_name", "table_name").agg(
        F.map_from_entries(
            F.transform(
                F.array_sort(F.collect_list(F.struct("position", "column_name", prop.alias("prop")))),
                lambda e: F.struct(e["column_name"], e["prop"]),
            )
        ).alias("properties"),
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("required"), F.struct("position", "column_name")))),
            lambda e: e["column_name"],
        ).alias("required"),
    )
    document = F.struct(
        F.lit(JSON_SCHEMA_DIALECT).alias("$schema"),
        F.lit("object").alias("type"),
        "properties",
        "required",
        F.lit(False).alias("additionalProperties"),
    )
    found = grouped.select("schema_name", "table_name", F.to_json(document).alias("json_schema"))
    if tables is None:
        return found
    empty = json.dumps({"$schema": JSON_SCHEMA_DIALECT, "type": "object", "properties": {}, "required": [], "additionalProperties": False})
    listed = tables.select("schema_name", "table_name").distinct().join(found, ["schema_name", "table_name"], "left")
    return listed.withColumn("json_schema", F.coalesce("json_schema", F.lit(empty)))
