"""Secured views: the only way into governed data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from wardline.operators import audit
from wardline.operators.access import access_decisions, resolve_ids
from wardline.operators.rowfilters import (
    FilterContext,
    FilterPlan,
    RowFilterRegistry,
    Subject,
    UnknownHandler,
    apply_gates,
    apply_plans,
    specs_column,
)
from wardline.sources.tables import TableSource



class AccessRefused(PermissionError):
    """The request is refused as a whole; ``datasets`` names every offender."""

    def __init__(self, status: int, reason: str, datasets: Sequence[str]) -> None:
        super().__init__(f"{status} {reason}: {', '.join(datasets)}")
        self.status, self.reason, self.datasets = status, reason, list(datasets)


class Agreement:
    """A dataspace request: who consumes under which agreement, and the filters it states.

    ``filters`` maps dataset id to ``{"handler", "args", "principals"}``; datasets without an
    entry are unfiltered. ``principals`` is a list of ids or a DataFrame of one string column;
    an entry always serves the rows of its principals only, so none of them means no rows.
    """

    def __init__(
        self,
        agreement_id: str,
        consumer_id: str,
        filters: Mapping[str, Mapping[str, Any]] | None = None,
        transfer_id: str | None = None,
    ) -> None:
        self.agreement_id, self.consumer_id, self.transfer_id = agreement_id, consumer_id, transfer_id
        self.filters = dict(filters or {})


class GovernedSession:
    """Opens governed datasets for a subject.

    Deciding touches only the catalogue rows a request names; the data itself is narrowed
    by lazy filters and semi joins under the returned DataFrames.
    """

    def __init__(
        self,
        spark: SparkSession,
        catalogue: DataFrame,
        source: TableSource | None = None,
        registry: RowFilterRegistry | None = None,
    ) -> None:
        self.spark = spark
        self.catalogue = catalogue
        self.source = source or TableSource(spark)
        self.registry = registry or RowFilterRegistry()

    def open(
        self, refs: Sequence[str], subject: Subject, agreement: Agreement | None = None
    ) -> dict[str, DataFrame]:
        """Secured DataFrames by ref, or ``AccessRefused`` for the request as a whole."""
        if not refs:
            raise AccessRefused(400, "query references no datasets", [])
        refs = sorted(set(refs))
        entries = self._judge(refs, subject, agreement)
        plans = {ref: self._plans(ref, entry, subject, agreement) for ref, entry in entries.items()}
        every = [p for ps in plans.values() for p in ps]
        return {
            ref: apply_gates(apply_plans(self.source.entry(entry["backend"]), plans[ref]), every)
            for ref, entry in entries.items()
        }

    def register(self, refs: Sequence[str], subject: Subject, agreement: Agreement | None = None) -> None:
        """Register the secured DataFrames as temporary views named like the refs."""
        for ref, df in self.open(refs, subject, agreement).items():
            df.createOrReplaceTempView(f"`{ref}`")

    def sql(self, query: str, subject: Subject, agreement: Agreement | None = None, **datasets: str) -> DataFrame:
        """Run SQL whose ``{name}`` placeholders stand for secured datasets."""
        opened = self.open(list(datasets.values()), subject, agreement)
        return self.spark.sql(query, **{name: opened[ref] for name, ref in datasets.items()})

    def disclosures(self, refs: Sequence[str], agreement: Agreement, page: DataFrame) -> DataFrame:
        """Audit records of a page served under an agreement: one per dataset, with the number and a digest of the principals.

        The people themselves are the rows of ``disclosed_to``, however many there are; the record's own list has them only
        where the agreement states a list.
        """
        names = self._datasets(refs)
        lists = [
            (d, stated["principals"])
            for d, stated in agreement.filters.items()
            if stated.get("principals") is not None and not isinstance(stated["principals"], DataFrame)
        ]
        listed = self.spark.createDataFrame(lists, "dataset_id string, principals array<string>")
        known = names.join(listed, "dataset_id", "left").select(
            "dataset_id",
            F.lit(agreement.consumer_id).cast("string").alias("consumer_id"),
            F.lit(agreement.agreement_id).cast("string").alias("agreement_id"),
            F.lit(agreement.transfer_id).cast("string").alias("transfer_id"),
            "principals",
        )
        summary = audit.principals_summary(self.disclosed_to(refs, agreement))
        records = audit.disclosure_records(known, page).join(summary, "dataset_id", "left")
        return records.withColumn("n_principals", F.coalesce("n_principals", F.lit(0).cast("bigint")))

    def disclosed_to(self, refs: Sequence[str], agreement: Agreement) -> DataFrame:
        """``(dataset_id, principal)``: the people whose rows the agreement releases, each once."""
        people = self.spark.createDataFrame([], "dataset_id string, principal string")
        for dataset_id, stated in agreement.filters.items():
            some = stated.get("principals")
            if some is not None and not isinstance(some, DataFrame):
                some = self.spark.createDataFrame([(p,) for p in some], "principal string")
            if some is not None:
                people = people.union(some.select(F.lit(dataset_id), F.col(some.columns[0]).cast("string")))
        return people.join(self._datasets(refs), "dataset_id", "left_semi").distinct()

    def audit_page(self, refs: Sequence[str], agreement: Agreement, page: DataFrame, path: str, page_id: str, at: str) -> None:
        """Write a page's records below ``path``/records and the people below ``path``/people; again is the same as once."""
        audit.write_page(self.disclosures(refs, agreement, page), f"{path}/records", page_id, at)
        audit.write_page(self.disclosed_to(refs, agreement), f"{path}/people", page_id, at)

    # --- internals ------------------------------------------------------------------

    def _datasets(self, refs: Sequence[str]) -> DataFrame:
        refs = sorted(set(refs))
        return self._resolved(refs, self._candidates(refs)).select("dataset_id").distinct()

    def _candidates(self, refs: Sequence[str]) -> DataFrame:
        """Catalogue rows the refs can mean; the filter reaches the catalogue's scan."""
        two_part = F.substring_index("dataset_id", ".", -2)
        return self.catalogue.filter(F.col("dataset_id").isin(*refs) | two_part.isin(*refs))

    def _resolved(self, refs: Sequence[str], candidates: DataFrame) -> DataFrame:
        return resolve_ids(self.spark.createDataFrame([(r,) for r in refs], "ref string"), candidates)

    def _judge(self, refs: Sequence[str], subject: Subject, agreement: Agreement | None) -> dict[str, dict[str, Any]]:
        candidates = self._candidates(refs)
        resolved = self._resolved(refs, candidates).withColumns(
            {
                "action": F.lit("read"),
                "subject_type": F.lit(subject.type),
                "groups": F.array(*[F.lit(g) for g in subject.groups]).cast("array<string>"),
                "scopes": F.array(*[F.lit(s) for s in subject.scopes]).cast("array<string>"),
                "under_agreement": F.lit(agreement is not None),
            }
        )
        carried = candidates.select("dataset_id", "backend_config", specs_column().alias("specs"))
        judged = (
            access_decisions(resolved, candidates).join(carried, "dataset_id", "left").collect()
        )  # one row per ref of the request
        refused = [r for r in judged if not r["allowed"]]
        if refused:
            worst = min(refused, key=lambda r: (r["status"] != 400, r["verdict"] != "not_offered", r["ref"]))
            same = sorted(r["dataset_id"] or r["ref"] for r in refused if r["verdict"] == worst["verdict"])
            raise AccessRefused(worst["status"], worst["reason"] or worst["verdict"], same)
        return {
            r["ref"]: {
                "dataset_id": r["dataset_id"],
                "backend": r["backend_config"].asDict(),
                "specs": [(s["handler"], s["args"] or {}) for s in r["specs"] or []],
            }
            for r in judged
        }

    def _plans(
        self, ref: str, entry: Mapping[str, Any], subject: Subject, agreement: Agreement | None
    ) -> list[FilterPlan]:
        if agreement is not None:
            stated = agreement.filters.get(entry["dataset_id"])
            if stated is None:
                return []
            people = stated.get("principals")
            if not isinstance(people, DataFrame):
                people = self.spark.createDataFrame([(p,) for p in people or []], "principal string")
            ctx = FilterContext(self.spark, subject, stated.get("args") or {}, self.source.table, people)
            return [self._resolve(ref, stated["handler"], ctx)]
        if not entry["specs"] or subject.is_admin:
            return []
        if subject.type == "anonymous":
            raise AccessRefused(401, "row filtering requires authentication", [ref])
        return [
            self._resolve(ref, handler, FilterContext(self.spark, subject, args, self.source.table))
            for handler, args in entry["specs"]
        ]

    def _resolve(self, ref: str, handler: str | None, ctx: FilterContext) -> FilterPlan:
        """The plan of a spec; one that can't be had refuses the request, never opens the data."""
        try:
            return self.registry.resolve(handler or "", ctx)
        except UnknownHandler as unknown:
            raise AccessRefused(500, str(unknown), [ref]) from unknown
        except Exception as failed:
            raise AccessRefused(500, f"row filter handler {handler!r} failed", [ref]) from failed
