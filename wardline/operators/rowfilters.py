"""Row-level security: filter specs, handlers, their combination, and batch entitlements.

A handler turns a spec into a ``FilterPlan``: a DataFrame transformation applied at the
scan, under the secured view. Key lists stay DataFrames and are applied as left semi
joins, so Catalyst broadcasts them only when their measured size allows it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wardline.functions.access import ADMIN_GROUP

DEFAULT_PLAN_TTL = 300  # fixed value: plan lifetime in seconds


@dataclass(frozen=True)
class Subject:
    """Who asks. ``type`` is ``user``, ``service`` or ``anonymous``."""

    sub: str | None
    type: str = "user"
    groups: tuple[str, ...] = ()
    scopes: tuple[str, ...] = ()

    @classmethod
    def anonymous(cls) -> "Subject":
        return cls(None, "anonymous")

    @property
    def is_admin(self) -> bool:
        return ADMIN_GROUP in self.groups


@dataclass(frozen=True)
class FilterContext:
    """What a handler may use: the subject, delegated principals, arguments and input tables."""

    spark: SparkSession
    subject: Subject
    args: Mapping[str, Any]
    table: Callable[[str], DataFrame]
    principals: DataFrame | None = None  # one string column

    def require(self, name: str) -> str:
        value = self.args.get(name)
        if not isinstance(value, str) or not value:
            raise ValueError(f"row filter needs args.{name}")
        return value


@dataclass(frozen=True)
class FilterPlan:
    """``apply`` narrows the dataset; ``gate`` (one boolean row) empties the whole request when false."""

    apply: Callable[[DataFrame], DataFrame]
    gate: DataFrame | None = None
    meta: Mapping[str, Any] = field(default_factory=dict)


class DelegationNotSupported(ValueError):
    """The handler only knows the caller's own rows."""


class UnknownHandler(ValueError):
    """A spec names a handler that isn't registered."""


def deny() -> FilterPlan:
    return FilterPlan(lambda df: df.filter(F.lit(False)), meta={"kind": "deny"})


def allow_all() -> FilterPlan:
    return FilterPlan(lambda df: df, meta={"kind": "all"})


def semi_join_keys(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Rows whose ``column`` is among the one-column ``keys``."""
    key = keys.columns[0]
    right = keys.select(F.col(key).cast(df.schema[column].dataType).alias("__key"))
    return df.join(right, df[column] == right["__key"], "left_semi")


def _nonempty(keys: DataFrame) -> DataFrame:
    return keys.limit(1).agg((F.count(F.lit(1)) > 0).alias("nonempty"))


# --- specs --------------------------------------------------------------------------


def specs_column() -> Column:
    """Spec array of a catalogue row, legacy columns appended last."""
    gov = F.col("lineage.facets.governance")
    nonempty = lambda c: F.when(F.size(c) > 0, c)
    declared = F.coalesce(nonempty(gov["rowFilters"]), nonempty(gov["row_filters"]))
    declared = F.filter(declared, lambda spec: spec.isNotNull())
    legacy_column = F.coalesce(
        F.nullif(gov["userFilterColumn"], F.lit("")), F.nullif(gov["user_filter_column"], F.lit(""))
    )
    legacy = F.when(
        legacy_column.isNotNull(),
        F.array(
            F.struct(
                F.lit("direct_user_match").alias("handler"),
                F.create_map(F.lit("column"), legacy_column).alias("args"),
            )
        ),
    )
    empty = F.array().cast("array<struct<handler:string,args:map<string,string>>>")
    return F.concat(F.coalesce(declared, empty), F.coalesce(legacy, empty))


def row_filter_specs(catalogue: DataFrame) -> DataFrame:
    """``(dataset_id, position, handler, args)`` of every spec."""
    return catalogue.select("dataset_id", F.posexplode(specs_column()).alias("position", "spec")).select(
        "dataset_id", "position", "spec.handler", "spec.args"
    )


# --- built-in handlers --------------------------------------------------------------


def direct_user_match(ctx: FilterContext) -> FilterPlan:
    """``column = sub``, or ``column IN (principals)`` when the request is delegated."""
    column = ctx.require("column")
    if ctx.principals is not None:
        return FilterPlan(lambda df: semi_join_keys(df, column, ctx.principals))
    sub = F.lit(ctx.subject.sub)
    return FilterPlan(lambda df: df.filter(F.col(column) == sub.cast(df.schema[column].dataType)))


def table_pointer(ctx: FilterContext) -> FilterPlan:
    """``column IN (SELECT key FROM pointer WHERE subject_column = sub)``."""
    if ctx.principals is not None:
        raise DelegationNotSupported("table_pointer does not support delegated principals")
    column, name, key = (ctx.require(a) for a in ("column", "pointer_table", "pointer_key_column"))
    subject_column = ctx.args.get("pointer_subject_column") or "user_id"
    pointer = ctx.table(name)
    owned = pointer.filter(F.col(subject_column) == F.lit(ctx.subject.sub).cast(pointer.schema[subject_column].dataType))
    keys = owned.select(key)
    return FilterPlan(lambda df: semi_join_keys(df, column, keys))


def list_items(payload: DataFrame, json_column: str, path: str = "$") -> DataFrame:
    """``(position, item)`` of the list at a dot path of a JSON column; a scalar is a one-item list.

    Missing paths give no items and null items are dropped.
    """
    json_path = path if path.startswith("$") else f"$.{path}"
    found = F.get_json_object(F.col(json_column), json_path)
    items = F.when(found.startswith("["), F.from_json(found, "array<string>")).when(
        found.isNotNull(), F.array(found)
    )
    return payload.select(F.posexplode(items).alias("position", "item")).filter(F.col("item").isNotNull())


def in_list(ctx: FilterContext) -> FilterPlan:
    """``column IN (list)`` from the answer of an external list service, stored as a table.

    ``list_table`` holds the answers (JSON text in ``list_column``), one row per subject named in
    ``list_subject_column``; a spec whose list is the same for everybody says so with
    ``list_shared = true``. The whole list counts. If ``max_items`` is stated, a longer list fails
    the request.
    """
    if ctx.principals is not None:
        raise DelegationNotSupported("http_in_list does not support delegated principals")
    column, name = ctx.require("column"), ctx.require("list_table")
    answers = ctx.table(name)
    by_subject = ctx.args.get("list_subject_column")
    if not by_subject and str(ctx.args.get("list_shared", "")).lower() != "true":
        raise ValueError("row filter needs args.list_subject_column, or list_shared = true")
    if by_subject:
        answers = answers.filter(F.col(by_subject) == F.lit(ctx.subject.sub).cast(answers.schema[by_subject].dataType))
    items = list_items(answers, ctx.args.get("list_column") or "payload", ctx.args.get("response_path") or "$")
    keys = items.select("item")
    empty_denies = str(ctx.args.get("empty_means_deny", "true")).lower() not in ("false", "0", "")
    plan = allow_list(column, keys, empty_denies)
    if not ctx.args.get("max_items"):
        return plan
    most = int(ctx.args["max_items"])
    n = F.count(F.lit(1))
    too_long = F.raise_error(F.lit(f"list of {name} has more than {most} items"))
    fits = F.when(n > most, too_long.cast("boolean")).otherwise((n > 0) | F.lit(not empty_denies))
    return FilterPlan(plan.apply, gate=keys.agg(fits.alias("fits")))


def allow_list(column: str, keys: DataFrame, empty_means_deny: bool = True) -> FilterPlan:
    """Semi join with a key list; an empty list denies the request or, on demand, allows all rows."""
    if empty_means_deny:
        return FilterPlan(lambda df: semi_join_keys(df, column, keys), gate=_nonempty(keys))

    def keep_listed_or_all(df: DataFrame) -> DataFrame:
        right = keys.select(F.col(keys.columns[0]).cast(df.schema[column].dataType).alias("__key")).distinct()
        marked = df.join(right, df[column] == right["__key"], "left")
        return marked.filter(F.col("__key").isNotNull() | ~_nonempty(keys).scalar()).drop("__key")

    return FilterPlan(keep_listed_or_all)


def asset_registry(ctx: FilterContext) -> FilterPlan:
    """Rows of the devices that belong to the caller, or to the delegated members; a service that asks for itself
    sees all rows."""
    column = ctx.require("column")
    if ctx.principals is not None:
        devices = member_devices(_assets(ctx), ctx.principals).select("sensor_id")
        return FilterPlan(lambda df: semi_join_keys(df, column, devices), gate=_nonempty(devices))
    if ctx.subject.type == "service":
        return allow_all()
    mine = _assets(ctx).filter((F.col("owner") == F.lit(ctx.subject.sub)) & F.col("sensor_id").isNotNull())
    return FilterPlan(lambda df: semi_join_keys(df, column, mine.select("sensor_id")))


def _assets(ctx: FilterContext) -> DataFrame:
    assets = ctx.table(ctx.require("assets_table"))
    return assets.select(
        F.col(ctx.args.get("sensor_column") or "sensor_id").cast("string").alias("sensor_id"),
        F.col(ctx.args.get("owner_column") or "owner_user_id").cast("string").alias("owner"),
    )


def member_devices(assets: DataFrame, principals: DataFrame) -> DataFrame:
    """``(owner, sensor_id)`` attribution of the devices of a set of members."""
    members = principals.select(F.col(principals.columns[0]).cast("string").alias("__member"))
    known = assets.filter(F.col("sensor_id").isNotNull() & F.col("owner").isNotNull())
    return known.join(members, known["owner"] == members["__member"], "left_semi")


# --- registry -----------------------------------------------------------------------

Handler = Callable[[FilterContext], FilterPlan]


class RowFilterRegistry:
    """Handlers by unique name; the built-in ones are always there."""

    def __init__(self) -> None:
        self._handlers: dict[str, Handler] = {
            "direct_user_match": direct_user_match,
            "table_pointer": table_pointer,
            "http_in_list": in_list,
            "rec_registry": asset_registry,  # fixed value: the name in stored specs
        }

    def register(self, name: str, handler: Handler) -> None:
        if name in self._handlers:
            raise ValueError(f"duplicate row filter handler {name!r}")
        self._handlers[name] = handler

    def names(self) -> list[str]:
        return sorted(self._handlers)

    def resolve(self, name: str, ctx: FilterContext) -> FilterPlan:
        if name not in self._handlers:
            raise UnknownHandler(f"unknown row filter handler {name!r}")
        return self._handlers[name](ctx)


def apply_plans(df: DataFrame, plans: Sequence[FilterPlan]) -> DataFrame:
    """All plans hold at once (AND)."""
    for plan in plans:
        df = plan.apply(df)
    return df


def apply_gates(df: DataFrame, plans: Sequence[FilterPlan]) -> DataFrame:
    """Empty ``df`` when any plan of the request denies, whichever dataset the plan is for."""
    for plan in plans:
        if plan.gate is not None:
            df = df.filter(plan.gate.scalar())
    return df


# --- plan lifetime and identity -----------------------------------------------------


def plan_ttl(
    now: Column, expires: Column, override: Column, default: int = DEFAULT_PLAN_TTL, maximum: int = DEFAULT_PLAN_TTL
) -> Column:
    """Seconds a resolved plan may live: the control plane's value, else token rest, else the default; at most ``maximum``."""
    # greatest() skips nulls, so a token without expiry must stay null here.
    rest = F.when(expires.isNotNull(), F.greatest(F.lit(0), expires - now))
    wanted = F.coalesce(override, rest, F.lit(default))
    return F.greatest(F.lit(0), F.least(wanted, F.lit(maximum)))


def plan_key(handler: Column, table: Column, sub: Column, principals: Column, args: Column) -> Column:
    """Identity of a plan: handler, table, caller, whose rows, arguments."""
    whose = F.when(F.size(principals) > 0, F.array_join(F.array_sort(principals), ",")).otherwise(F.lit("self"))
    stated = F.array_sort(
        F.transform(F.map_entries(args), lambda e: F.concat_ws("=", e["key"], e["value"]))
    )
    return F.concat_ws(
        "|",
        handler,
        table,
        F.coalesce(sub, F.lit("delegated")),
        F.coalesce(whose, F.lit("self")),
        F.coalesce(F.array_join(stated, ","), F.lit("")),
    )


# --- all subjects at once -----------------------------------------------------------


def pointer_entitlements(subjects: DataFrame, pointer: DataFrame, key: str, subject_column: str) -> DataFrame:
    """``(subject, key)`` pairs granted by a pointer table to the listed subjects."""
    who = subjects.select(F.col(subjects.columns[0]).alias("subject")).distinct()
    grants = pointer.select(F.col(subject_column).alias("subject"), F.col(key).alias("key"))
    return grants.filter(F.col("key").isNotNull()).join(who, "subject", "left_semi").distinct()


def visible_rows(data: DataFrame, key: str, entitlements: DataFrame) -> DataFrame:
    """Every row with each subject that may see it: ``(subject, …row)``.

    A row comes once for each of its subjects, so the result may be many times the data; ``visible_totals`` avoids that.
    """
    return data.join(entitlements, data[key] == entitlements["key"]).drop(entitlements["key"])


def visible_totals(
    data: DataFrame, key: str, entitlements: DataFrame, measures: Mapping[str, tuple[Column, Callable[[Any], Column]]]
) -> DataFrame:
    """Per-subject aggregates over the rows each subject may see.

    ``measures`` maps a name to ``(partial, final)``: the aggregate per key and the one that
    combines keys. The data is reduced to one row per key before it meets the entitlements,
    so a key shared by many subjects does not multiply its rows.
    """
    per_key = data.groupBy(F.col(key).alias("key")).agg(*[part.alias(n) for n, (part, _) in measures.items()])
    joined = entitlements.join(per_key, "key")
    return joined.groupBy("subject").agg(*[final(F.col(n)).alias(n) for n, (_, final) in measures.items()])
