"""Catalogue and lineage documents: loading many files, writing grouped files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from wardline.functions import pg
from wardline.operators.catalogue import namespace_of
from wardline.operators.relational import distinct_on
from wardline.sources.schema import CATALOGUE, LINEAGE_RECORD


def last_wins(documents: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the one of the last file."""
    return distinct_on(documents, [key], [pg.desc(order)]).drop(order)


def load_catalogue(spark: SparkSession, paths: str | list[str], lines: bool = True) -> DataFrame:
    """Entries of many catalogue files, one JSON document per line (or per file).

    An id in several files keeps the entry of the path given last, and within a path of the file that sorts last.
    Documents without an id, malformed ones included, all stay, for ``validate`` to report; ``malformed`` has their texts.
    """
    reader = spark.read.schema(CATALOGUE).option("multiLine", str(not lines).lower())
    given = [paths] if isinstance(paths, str) else paths
    parts = [
        reader.json(path).withColumn("__from", F.struct(F.lit(i).alias("nth"), F.input_file_name().alias("file")))
        for i, path in enumerate(given)
    ]
    found = reduce(DataFrame.unionByName, parts)
    named = last_wins(found.filter(F.col("dataset_id").isNotNull()), "dataset_id", "__from")
    return named.unionByName(found.filter(F.col("dataset_id").isNull()).drop("__from")).withColumns(
        {
            "expose": F.coalesce("expose", F.lit(False)),
            "dataspace_expose": F.coalesce("dataspace_expose", F.lit(False)),
        }
    )


def malformed(spark: SparkSession, paths: str | list[str], lines: bool = True) -> DataFrame:
    """``(file, dataset_id, text)`` of the documents that are no JSON of the catalogue's shape; the id if it could be read."""
    schema = T.StructType([*spark.createDataFrame([], CATALOGUE).schema.fields, T.StructField("__text", T.StringType())])
    reader = spark.read.schema(schema).option("multiLine", str(not lines).lower()).option("columnNameOfCorruptRecord", "__text")
    found = reader.json(paths).withColumn("file", F.input_file_name())
    return found.select("file", "dataset_id", F.col("__text").alias("text")).filter(F.col("text").isNotNull())


def load_lineage(spark: SparkSession, paths: str | list[str], namespaces: list[str] | None = None) -> DataFrame:
    """Dataset records of a lineage-store dump, optionally of some namespaces."""
    records = spark.read.schema(LINEAGE_RECORD).json(paths)
    return records.filter(F.col("namespace").isin(namespaces)) if namespaces else records


def write_catalogue(
    entries: DataFrame, path: str, group: str = "namespace", mode: str = "errorifexists", records_per_file: int = 100_000
) -> None:
    """JSON lines in one directory per group: namespace of the lineage, or any column of the entries.

    Nothing that is there already is touched unless ``mode`` says so. A group's entries go to files of ``records_per_file``;
    a large group is split over tasks.
    """
    grouped = entries
    if group not in entries.columns:
        grouped = entries.withColumn(group, namespace_of(F.col("lineage")))
    dealt = grouped.hint("rebalance", group)
    dealt.write.mode(mode).option("maxRecordsPerFile", records_per_file).partitionBy(group).json(path)


def page_rows(page: DataFrame) -> DataFrame:
    """A result page as one JSON object per row; geometry columns become GeoJSON objects."""
    from wardline.functions.geo import GEOMETRY_TYPE, st_asgeojson

    members = []
    for f in page.schema.fields:
        if f.dataType.simpleString() == GEOMETRY_TYPE:
            shape = F.from_json(st_asgeojson(F.col(f.name)), "struct<type:string,coordinates:variant>")
            members.append(shape.alias(f.name))
        else:
            members.append(F.col(f.name))
    return page.select(F.to_json(F.struct(*members), {"ignoreNullFields": "false"}).alias("item"))
