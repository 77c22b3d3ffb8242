"""Resolving catalogue entries to DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession


class NotReadable(ValueError):
    """The entry names neither a table nor a path."""


class TableSource:
    """Reads physical tables and paths.

    Table names go to the first that knows them: an explicit mapping of names to DataFrames
    or Parquet paths, JDBC options (the name becomes ``dbtable``), the session's tables and
    views.
    """

    def __init__(
        self,
        spark: SparkSession,
        tables: Mapping[str, DataFrame | str] | None = None,
        jdbc: Mapping[str, str] | Callable[[str], Mapping[str, str]] | None = None,
    ) -> None:
        self.spark = spark
        self._tables = dict(tables or {})
        self._jdbc = jdbc

    def table(self, name: str) -> DataFrame:
        known = self._tables.get(name)
        if isinstance(known, DataFrame):
            return known
        if isinstance(known, str):
            return self.spark.read.parquet(known)
        if self._jdbc is not None:
            options = self._jdbc(name) if callable(self._jdbc) else self._jdbc
            return self.spark.read.format("jdbc").options(**options).option("dbtable", name).load()
        return self.spark.table(name)

    def path(self, path: str, fmt: str | None = None, **options: Any) -> DataFrame:
        """Read object-store or file-system data; the format defaults to Parquet."""
        return self.spark.read.format(fmt or "parquet").options(**options).load(path)

    def entry(self, backend: Mapping[str, Any]) -> DataFrame:
        """DataFrame behind an entry's ``backend_config``."""
        if backend.get("table"):
            return self.table(backend["table"])
        if backend.get("path"):
            return self.path(backend["path"], _spark_format(backend.get("format")))
        raise NotReadable("entry has neither table nor path")


def _spark_format(media_type: str | None) -> str:
    """Spark reader of a catalogued format or media type."""
    name = (media_type or "parquet").lower().rpartition("/")[2].removeprefix("vnd.apache.").removeprefix("x-")
    return {"ndjson": "json", "jsonlines": "json", "octet-stream": "parquet", "plain": "text"}.get(name, name)
