"""Registered queries: row filters, access decisions, audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wardline.functions import access as acl
from wardline.operators import access, audit, rowfilters as rls
from wardline.operators.rowfilters import FilterContext, FilterPlan, RowFilterRegistry, Subject
from wardline.plans import testbed as tb
from wardline.plans.registry import Tables, query
from wardline.plans.secured import Agreement, GovernedSession
from wardline.sources.schema import CATALOGUE
from wardline.sources.tables import TableSource

MANAGER = Subject("7", "user", ("managers",))


# --- the governed sales datasets ----------------------------------------------------


def _entry(table: str, level: str | None, filters: list[tuple[str, dict[str, str]]] = (), offered: bool = False) -> dict:
    return {
        "dataset_id": f"datasets.sales.{table}",
        "title": table,
        "backend_type": "postgres",
        "backend_config": {"table": f"sales.{table}"},
        "expose": True,
        "dataspace_expose": offered,
        "lineage": {
            "namespace": "sales",
            "facets": {"governance": {"rowFilters": [{"handler": h, "args": a} for h, a in filters]}},
        },
        "access_level": level,
    }


def sales_session(t: Tables, registry: RowFilterRegistry | None = None) -> GovernedSession:
    """Governed session over the sales tables; the filters follow the roles of the tables."""
    pointer = {"column": "o_custkey", "pointer_table": "sales.pointer", "pointer_key_column": "c_custkey", "pointer_subject_column": "owner"}
    assets = {"column": "l_suppkey", "assets_table": "sales.assets"}
    listed = {"column": "c_custkey", "list_table": "sales.lists", "response_path": "data.items", "list_shared": "true"}
    entries = [
        _entry("orders", "internal", [("table_pointer", pointer)], offered=True),
        _entry("events", "internal", [("direct_user_match", {"column": "user_id"})], offered=True),
        _entry("lineitem", "internal", [("rec_registry", assets)], offered=True),
        _entry("customer", "internal", [("http_in_list", listed)]),
        _entry("part", "open"),
        _entry("supplier", "restricted"),
    ]
    if registry is not None:
        entries.append(_entry("segments", "internal", [("by_segment", {"column": "c_mktsegment"})]))
    physical = {f"sales.{n}": t.path(n) for n in ("orders", "events", "lineitem", "customer", "part", "supplier")}
    # An allow-list nobody is on: customers with an impossible balance.
    nobody = t.customer.filter(F.col("c_acctbal") > 1e12).select(
        F.to_json(F.struct(F.struct(F.array("c_custkey").alias("items")).alias("data"))).alias("payload")
    )
    source = TableSource(
        t.spark,
        {
            **physical,
            "sales.segments": t.path("customer"),
            "sales.pointer": tb.pointer(t),
            "sales.assets": tb.assets(t),
            "sales.lists": nobody,
        },
    )
    return GovernedSession(t.spark, t.spark.createDataFrame(entries, CATALOGUE), source, registry)


@query(
    "flagship",
    """SELECT o_orderpriority, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
       FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7) GROUP BY 1""",
)
def flagship(t: Tables) -> DataFrame:
    return sales_session(t).sql(
        """SELECT o_orderpriority, count(*) AS orders,
                  CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
           FROM {orders} GROUP BY o_orderpriority""",
        MANAGER,
        orders="sales.orders",
    )


# --- row filters --------------------------------------------------------------------


@query(
    "rls_specs",
    tb.with_cat(
        """SELECT dataset_id, 0 AS position, 'table_pointer' AS handler,
                  'column=o_custkey,pointer_key_column=c_custkey,pointer_table=' || source AS args FROM cat WHERE lang = 'fr'
           UNION ALL SELECT dataset_id, 1, 'http_in_list', 'column=device_id,list_table=' || source FROM cat WHERE lang = 'fr'
           UNION ALL SELECT dataset_id, 0, 'http_in_list', 'column=device_id,list_table=' || source FROM cat WHERE lang = 'de'
           UNION ALL SELECT dataset_id, 1, 'direct_user_match', 'column=member_id' FROM cat WHERE lang = 'de' AND n_chars >= 2000
           UNION ALL SELECT dataset_id, 0, 'direct_user_match', 'column=user_id' FROM cat WHERE lang = 'es'"""
    ),
)
def rls_specs(t: Tables) -> DataFrame:
    args = F.array_sort(F.transform(F.map_entries("args"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return rls.row_filter_specs(tb.catalogue(t)).select("dataset_id", "position", "handler", F.array_join(args, ",").alias("args"))


@query("rls_direct_user", "SELECT event_id, user_id, value FROM events WHERE user_id = 7")
def rls_direct_user(t: Tables) -> DataFrame:
    return sales_session(t).open(["sales.events"], MANAGER)["sales.events"].select("event_id", "user_id", "value")


@query(
    "rls_direct_principals",
    """SELECT event_id, user_id, 'consenting' AS principals FROM events WHERE user_id IN
         (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 250)
       UNION ALL SELECT event_id, user_id, 'none' FROM events WHERE FALSE""",
)
def rls_direct_principals(t: Tables) -> DataFrame:
    consenting = t.events.filter((F.col("event_type") == "purchase") & (F.col("value") > 250)).select(
        F.col("user_id").cast("string").alias("principal")
    )
    service = Subject("svc", "service", scopes=("dataset.query",))
    session = sales_session(t)

    def served(label: str, principals: DataFrame) -> DataFrame:
        stated = {"handler": "direct_user_match", "args": {"column": "user_id"}, "principals": principals}
        agreement = Agreement("ag-1", "did:web:consumer", {"datasets.sales.events": stated})
        rows = session.open(["sales.events"], service, agreement)["sales.events"]
        return rows.select("event_id", "user_id", F.lit(label).alias("principals"))

    return served("consenting", consenting).unionByName(served("none", consenting.filter(F.lit(False))))


@query(
    "rls_table_pointer",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7)",
)
@query(
    "semi_join_pointer",
    "SELECT o_orderkey, o_custkey FROM orders SEMI JOIN (SELECT c_custkey FROM customer WHERE c_nationkey = 7) c ON o_custkey = c_custkey",
)
def rls_table_pointer(t: Tables) -> DataFrame:
    return sales_session(t).open(["sales.orders"], MANAGER)["sales.orders"].select("o_orderkey", "o_custkey")


@query(
    "rls_allow_list",
    """WITH keys AS (SELECT p_partkey FROM part WHERE p_size <= 25)
       SELECT l_orderkey, l_linenumber, l_partkey, 'deny if empty' AS mode FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM keys)
       UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'all if empty' FROM lineitem""",
)
def rls_allow_list(t: Tables) -> DataFrame:
    answers = t.part.select(
        "p_partkey",
        F.to_json(
            F.struct(F.struct(F.when(F.col("p_size") <= 25, F.array(F.col("p_partkey"), F.lit(None))).alias("items")).alias("data"))
        ).alias("payload"),
    )
    items = rls.list_items(answers, "payload", "data.items").select(F.col("item").cast("bigint").alias("item"))
    nothing = rls.list_items(answers, "payload", "data.absent").select("item")
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    listed = rls.allow_list("l_partkey", items).apply(lines).withColumn("mode", F.lit("deny if empty"))
    everything = rls.allow_list("l_partkey", nothing, empty_means_deny=False).apply(lines)
    return listed.unionByName(everything.withColumn("mode", F.lit("all if empty")))


@query(
    "rls_asset_registry",
    """SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_suppkey IN
         (SELECT s_suppkey FROM supplier WHERE s_nationkey = 7 AND s_acctbal >= 0)""",
)
def rls_asset_registry(t: Tables) -> DataFrame:
    return sales_session(t).open(["sales.lineitem"], MANAGER)["sales.lineitem"].select("l_orderkey", "l_linenumber", "l_suppkey")


@query(
    "rls_asset_members",
    """SELECT CAST(s_nationkey AS VARCHAR) AS member, CAST(s_suppkey AS VARCHAR) AS device, count(l_orderkey) AS lines
       FROM supplier JOIN lineitem ON l_suppkey = s_suppkey WHERE s_nationkey IN (3, 7, 11) AND s_acctbal >= 0 GROUP BY 1, 2""",
)
def rls_asset_members(t: Tables) -> DataFrame:
    members = ["3", "7", "11"]
    agreement = Agreement(
        "ag-1",
        "did:web:consumer",
        {
            "datasets.sales.lineitem": {
                "handler": "rec_registry",
                "args": {"column": "l_suppkey", "assets_table": "sales.assets"},
                "principals": members,
            }
        },
    )
    service = Subject("svc", "service")
    lines = sales_session(t).open(["sales.lineitem"], service, agreement)["sales.lineitem"]
    per_device = lines.groupBy(F.col("l_suppkey").cast("string").alias("device")).agg(F.count(F.lit(1)).alias("lines"))
    assets = tb.assets(t).withColumnRenamed("owner_user_id", "owner")
    people = t.spark.createDataFrame([(m,) for m in members], "principal string")
    attribution = rls.member_devices(assets, people).select(F.col("owner").alias("member"), F.col("sensor_id").alias("device"))
    return attribution.join(per_device, "device").select("member", "device", "lines")


@query("rls_admin_bypass", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def rls_admin_bypass(t: Tables) -> DataFrame:
    admin = Subject("1", "user", ("admins",))
    orders = sales_session(t).open(["sales.orders"], admin)["sales.orders"]
    return orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("rls_deny", "SELECT count(*) AS n, CAST(NULL AS BIGINT) AS top FROM orders WHERE FALSE")
def rls_deny(t: Tables) -> DataFrame:
    # The customer list is empty, so the plan denies and every dataset of the request is empty.
    opened = sales_session(t).open(["sales.orders", "sales.customer"], MANAGER)
    joined = opened["sales.orders"].join(opened["sales.customer"], F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("top"))


@query(
    "rls_combine",
    """SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey FROM lineitem
       WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 7 AND s_acctbal >= 0)
         AND l_partkey IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#3')""",
)
def rls_combine(t: Tables) -> DataFrame:
    ctx = FilterContext(
        t.spark, MANAGER, {"column": "l_suppkey", "assets_table": "assets"}, lambda name: tb.assets(t)
    )
    brand = t.part.filter(F.col("p_brand") == "Brand#3").select("p_partkey")
    plans = [rls.asset_registry(ctx), rls.allow_list("l_partkey", brand)]
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    return rls.apply_gates(rls.apply_plans(lines, plans), plans)


@query(
    "rls_batch_entitlements",
    """SELECT CAST(c_nationkey AS VARCHAR) AS subject, count(*) AS orders,
              CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
       FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""",
)
def rls_batch_entitlements(t: Tables) -> DataFrame:
    subjects = t.nation.select(F.col("n_nationkey").cast("string").alias("subject"))
    grants = rls.pointer_entitlements(subjects, tb.pointer(t), "c_custkey", "owner")
    totals = rls.visible_totals(
        t.orders,
        "o_custkey",
        grants,
        {
            "orders": (F.count(F.lit(1)), F.sum),
            "revenue": (F.sum(F.col("o_totalprice").cast("decimal(18,2)")), F.sum),
        },
    )
    return totals.select("subject", "orders", F.col("revenue").cast("double").alias("revenue"))


@query(
    "plan_ttl",
    """SELECT event_id, greatest(0, least(coalesce(
                CASE WHEN event_type = 'click' THEN CAST(floor(value * 4) AS BIGINT) - 20 END,
                CASE WHEN event_type <> 'view' THEN greatest(0, CAST(floor(value * 10) AS BIGINT) - 100) END, 300), 300)) AS ttl FROM events""",
)
def plan_ttl(t: Tables) -> DataFrame:
    kind, value = F.col("event_type"), F.col("value")
    override = F.when(kind == "click", F.floor(value * 4) - 20)
    expires = F.when(kind != "view", F.floor(value * 10))
    return t.events.select("event_id", rls.plan_ttl(F.lit(100), expires, override).cast("bigint").alias("ttl"))


@query(
    "plan_key",
    """SELECT 'direct_user_match|events|' || CASE WHEN event_type = 'error' THEN 'delegated' ELSE CAST(user_id AS VARCHAR) END || '|'
              || CASE WHEN event_type = 'error' THEN '1,' || CAST(2 + user_id % 3 AS VARCHAR) ELSE 'self' END
              || '|column=user_id,mode=' || event_type AS plan, count(*) AS uses FROM events GROUP BY 1""",
)
def plan_key(t: Tables) -> DataFrame:
    delegated = F.col("event_type") == "error"
    principals = F.when(delegated, F.array((2 + F.col("user_id") % 3).cast("string"), F.lit("1")))
    args = F.create_map(F.lit("mode"), F.col("event_type"), F.lit("column"), F.lit("user_id"))
    sub = F.when(~delegated, F.col("user_id").cast("string"))
    key = rls.plan_key(F.lit("direct_user_match"), F.lit("events"), sub, principals, args)
    return t.events.groupBy(key.alias("plan")).agg(F.count(F.lit(1)).alias("uses"))


def by_segment(ctx: FilterContext) -> FilterPlan:
    """Example of a user handler: odd subjects see one market segment."""
    column = ctx.require("column")
    segment = "BUILDING" if int(ctx.subject.sub or 0) % 2 else "MACHINERY"
    return FilterPlan(lambda df: df.filter(F.col(column) == segment))


@query("custom_row_filter", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'")
def custom_row_filter(t: Tables) -> DataFrame:
    registry = RowFilterRegistry()
    registry.register("by_segment", by_segment)
    opened = sales_session(t, registry).open(["sales.segments"], MANAGER)["sales.segments"]
    return opened.select("c_custkey", "c_mktsegment")


# --- access -------------------------------------------------------------------------


@query(
    "access_matrix",
    tb.with_cat(
        """SELECT dataset_id, coalesce(access_level, 'open') IN ('open', 'internal', 'restricted') AS level_valid,
                  CASE WHEN access_level = 'secret' THEN NULL ELSE coalesce(access_level, 'open') <> 'open' END AS requires_auth,
                  CASE WHEN access_level = 'secret' THEN NULL ELSE coalesce(access_level, 'open') <> 'open' END AS requires_policy FROM cat"""
    ),
)
def access_matrix(t: Tables) -> DataFrame:
    shouted = tb.catalogue(t).withColumn("access_level", F.upper("access_level"))
    return access.access_matrix(shouted).select("dataset_id", "level_valid", "requires_auth", "requires_policy")


def _decisions(t: Tables) -> DataFrame:
    cat = tb.catalogue(t)
    return access.access_decisions(tb.requests(t, cat), cat)


@query(
    "access_decision",
    tb.with_requests("SELECT request_id, dataset_id, allowed, reason FROM decided WHERE verdict IN ('allow', 'denied')"),
)
def access_decision(t: Tables) -> DataFrame:
    judged = _decisions(t).filter(F.col("verdict").isin("allow", "denied"))
    return judged.select("request_id", "dataset_id", "allowed", "reason")


@query("request_verdict", tb.with_requests("SELECT request_id, dataset_id, verdict, status FROM decided"))
def request_verdict(t: Tables) -> DataFrame:
    return _decisions(t).select("request_id", "dataset_id", "verdict", "status")


@query(
    "dataspace_gate",
    tb.with_requests("SELECT verdict, count(*) AS n FROM decided WHERE under_agreement GROUP BY 1"),
)
def dataspace_gate(t: Tables) -> DataFrame:
    return _decisions(t).filter("under_agreement").groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query(
    "join_judged_whole",
    tb.with_requests(
        """SELECT request_id, bool_and(allowed) AS allowed, count(*) AS n_datasets, count(*) FILTER (WHERE NOT allowed) AS n_refused,
                  min(dataset_id) FILTER (WHERE NOT allowed) AS first_refused,
                  coalesce(first(status ORDER BY status <> 400, verdict <> 'not_offered', dataset_id) FILTER (WHERE NOT allowed), 200) AS status
           FROM decided GROUP BY 1"""
    ),
)
def join_judged_whole(t: Tables) -> DataFrame:
    return access.judge_requests(_decisions(t))


@query(
    "join_judged_whole_offenders",
    tb.with_requests("SELECT DISTINCT request_id, dataset_id, verdict FROM decided WHERE NOT allowed"),
)
def join_judged_whole_offenders(t: Tables) -> DataFrame:
    return access.refused_datasets(_decisions(t))


@query(
    "scope_match",
    """SELECT event_id, k % 4 <> 3 AS reads, k % 4 IN (1, 2) AS writes FROM (
         SELECT event_id, CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS k FROM events)""",
)
def scope_match(t: Tables) -> DataFrame:
    k = F.regexp_extract("props", r"(\d+)", 1).cast("bigint")
    scopes = (
        F.when(k % 4 == 0, F.array(F.lit("dataset.query"), F.lit("other.write")))
        .when(k % 4 == 1, F.array(F.lit("dataset.admin")))
        .when(k % 4 == 2, F.array(F.lit("x"), F.lit("dataset.write"), F.lit("dataset.query")))
        .otherwise(F.array(F.lit("data.admin"), F.lit("dataset.queryx")))
    )
    return t.events.select(
        "event_id",
        acl.has_scope(scopes, F.lit("dataset.query")).alias("reads"),
        acl.has_scope(scopes, F.lit("dataset.write")).alias("writes"),
    )


@query(
    "required_scope",
    tb.with_requests(
        """SELECT action, CASE action WHEN 'write' THEN 'dataset.write' WHEN 'delete' THEN 'dataset.admin' ELSE 'dataset.query' END AS scope,
                  count(*) AS n FROM req GROUP BY 1, 2"""
    ),
)
def required_scope(t: Tables) -> DataFrame:
    return (
        tb.requests(t)
        .groupBy("action", acl.required_scope(F.col("action")).alias("scope"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "subject_normalize",
    """SELECT event_id,
              CASE WHEN event_type = 'signup' THEN 'anonymous' WHEN event_type = 'error' THEN 'service' ELSE 'user' END AS type,
              CASE WHEN event_type = 'signup' THEN NULL ELSE CAST(user_id AS VARCHAR) END AS sub,
              CASE WHEN event_type = 'signup' THEN NULL WHEN event_type = 'error' THEN 'service-account-' || CAST(user_id AS VARCHAR)
                   ELSE 'mail' || CAST(user_id AS VARCHAR) END AS username,
              CASE WHEN event_type = 'signup' THEN '' ELSE 'admins,viewers' END AS groups,
              CASE WHEN event_type = 'signup' THEN '' WHEN user_id % 2 = 0 THEN 'editor,reader' ELSE 'reader' END AS roles,
              CASE WHEN event_type = 'signup' THEN '' WHEN event_type = 'click' THEN 'a.read,b.write' ELSE 'dataset.query,' || event_type END AS scopes
       FROM events""",
)
def subject_normalize(t: Tables) -> DataFrame:
    kind, uid = F.col("event_type"), F.col("user_id").cast("string")
    # Tokens differ in the shape of their scope claim: a list for clicks, a text otherwise.
    head = F.concat(F.lit('{"sub":"'), uid, F.lit('","groups":["admins","viewers"],"email":"mail'), uid, F.lit('"'))
    name = F.when(kind == "error", F.concat(F.lit(',"preferred_username":"service-account-'), uid, F.lit('"'))).otherwise("")
    realm = F.lit(',"realm_access":{"roles":["reader"]}')
    client = F.when(
        F.col("user_id") % 2 == 0, F.lit(',"resource_access":{"api":{"roles":["reader","editor"]}}')
    ).otherwise(F.lit(',"resource_access":{"other":{"roles":["owner"]}}'))
    scope = F.when(kind == "click", F.lit(',"scope":["a.read","b.write"]}')).otherwise(
        F.concat(F.lit(',"scope":"dataset.query  '), kind, F.lit('"}'))
    )
    claims = F.when(kind != "signup", F.concat(head, name, realm, client, scope))
    tokens = t.events.select("event_id", claims.alias("claims"))
    s = access.normalize_subjects(tokens, "claims", "api")
    joined = lambda c: F.array_join(f"subject.{c}", ",").alias(c)
    return s.select("event_id", "subject.type", "subject.sub", "subject.username", joined("groups"), joined("roles"), joined("scopes"))


@query(
    "resolve_ids",
    tb.with_cat(
        f"""{', ' + tb.REQ.strip()}, refs AS (
              SELECT DISTINCT CASE event_type WHEN 'view' THEN c.dataset_id WHEN 'click' THEN substr(c.dataset_id, 10)
                     WHEN 'error' THEN 'missing.t_' || CAST(e.k AS VARCHAR) ELSE split_part(c.dataset_id, '.', 3) END AS ref
              FROM ev e JOIN cat c ON e.k = c.doc_id)
            SELECT ref, coalesce(x.dataset_id, y.dataset_id) AS dataset_id FROM refs
            LEFT JOIN cat x ON x.dataset_id = ref
            LEFT JOIN (SELECT substr(dataset_id, 10) AS two, min(dataset_id) AS dataset_id FROM cat GROUP BY 1) y ON y.two = ref"""
    ),
)
def resolve_ids(t: Tables) -> DataFrame:
    cat = tb.catalogue(t)
    return access.resolve_ids(_refs(t, cat), cat)


def _refs(t: Tables, cat: DataFrame) -> DataFrame:
    k = F.regexp_extract("props", r"(\d+)", 1).cast("bigint")
    kind, full = F.col("event_type"), F.col("dataset_id")
    ref = (
        F.when(kind == "view", full)
        .when(kind == "click", F.substring_index(full, ".", -2))
        .when(kind == "error", F.concat(F.lit("missing.t_"), F.col("k")))
        .otherwise(F.substring_index(full, ".", -1))
    )
    named = t.events.select("event_type", k.alias("k")).join(cat.select("dataset_id", F.col("doc_id").alias("k")), "k")
    return named.select(ref.alias("ref")).distinct()


@query(
    "resolve_ids_unknown",
    tb.with_cat(
        f"""{', ' + tb.REQ.strip()} SELECT DISTINCT CASE event_type WHEN 'error' THEN 'missing.t_' || CAST(e.k AS VARCHAR)
                  ELSE split_part(c.dataset_id, '.', 3) END AS ref
            FROM ev e JOIN cat c ON e.k = c.doc_id WHERE event_type NOT IN ('view', 'click')"""
    ),
)
def resolve_ids_unknown(t: Tables) -> DataFrame:
    cat = tb.catalogue(t)
    return access.unknown_ids(_refs(t, cat), cat)


@query(
    "resolve_physical_name",
    tb.with_cat(
        """, names AS (SELECT dataset_id AS name FROM cat UNION ALL SELECT tbl FROM cat WHERE tbl IS NOT NULL UNION ALL SELECT source FROM cat)
           SELECT name, CASE WHEN n = 3 THEN split_part(name, '.', 1) END AS db,
                  CASE WHEN n = 3 THEN split_part(name, '.', 2) WHEN n = 2 THEN split_part(name, '.', 1) END AS schema_name,
                  split_part(name, '.', n) AS table_name FROM (SELECT name, len(string_split(name, '.')) AS n FROM names)"""
    ),
)
def resolve_physical_name(t: Tables) -> DataFrame:
    cat = tb.catalogue(t)
    source = F.get("tags.keywords", F.lit(1))
    names = cat.select(F.explode(F.array_compact(F.array("dataset_id", "backend_config.table", source))).alias("name"))
    db, schema, table = access.physical_name_parts(F.col("name"))
    return names.select("name", db.alias("db"), schema.alias("schema_name"), table.alias("table_name"))


# --- agreements and audit -----------------------------------------------------------


@query(
    "agreement_filter_lookup",
    tb.with_requests(
        """, decisions AS (
             SELECT 'ag-' || CAST(doc_id % 7 AS VARCHAR) AS agreement_id, dataset_id,
                    CASE lang WHEN 'fr' THEN 'table_pointer' WHEN 'de' THEN 'http_in_list' WHEN 'es' THEN 'direct_user_match' END AS handler, 'granted ' || lang AS reason FROM cat)
           SELECT r.request_id, r.dataset_id, r.agreement_id, d.handler, d.handler IS NOT NULL AS filtered,
                  CASE WHEN d.dataset_id IS NOT NULL THEN d.reason WHEN g.agreement_id IS NOT NULL THEN 'no agreement' END AS reason
           FROM (SELECT *, 'ag-' || CAST(user_id % 7 AS VARCHAR) AS agreement_id FROM req WHERE under_agreement) r
           LEFT JOIN decisions d ON d.agreement_id = r.agreement_id AND d.dataset_id = r.dataset_id
           LEFT JOIN (SELECT DISTINCT 'ag-' || CAST(user_id % 7 AS VARCHAR) AS agreement_id FROM events WHERE user_id % 7 < 5) g
             ON g.agreement_id = r.agreement_id"""
    ),
)
def agreement_filter_lookup(t: Tables) -> DataFrame:
    cat = tb.catalogue(t)
    name = lambda c: F.concat(F.lit("ag-"), (c % 7).cast("string")).alias("agreement_id")
    asked = tb.requests(t, cat).filter("under_agreement").select("request_id", "dataset_id", name(F.col("user_id")))
    lang = F.lower(F.get("tags.keywords", F.lit(0)))
    handler = (
        F.when(lang == "fr", "table_pointer").when(lang == "de", "http_in_list").when(lang == "es", "direct_user_match")
    )
    stated = cat.select(
        name(F.col("doc_id")),
        "dataset_id",
        handler.alias("handler"),
        F.lit("user_id").alias("column"),
        F.array(F.col("doc_id").cast("string")).alias("principals"),
        F.concat(F.lit("granted "), lang).alias("reason"),
    )
    general = t.events.filter(F.col("user_id") % 7 < 5).select(name(F.col("user_id"))).distinct()
    general = general.withColumn("reason", F.lit("no agreement"))
    found = access.agreement_filters(asked, stated.unionByName(general, allowMissingColumns=True))
    return found.select("request_id", "dataset_id", "agreement_id", "handler", "filtered", "reason")


@query(
    "audit_disclosure",
    tb.with_requests(
        """SELECT d.dataset_id, 'did:web:c' || CAST(d.user_id % 11 AS VARCHAR) AS consumer_id, count(*) AS disclosures,
                  CAST(sum(c.n_chars) AS BIGINT) AS rows_disclosed, count(DISTINCT 'ag-' || CAST(d.user_id % 7 AS VARCHAR)) AS agreements
           FROM decided d JOIN cat c ON d.dataset_id = c.dataset_id WHERE d.under_agreement AND d.allowed GROUP BY 1, 2"""
    ),
)
def audit_disclosure(t: Tables) -> DataFrame:
    cat = tb.catalogue(t)
    passed = access.access_decisions(tb.requests(t, cat), cat).filter("under_agreement AND allowed")
    sized = passed.join(cat.select("dataset_id", F.col("backend_config.size_bytes").alias("row_count")), "dataset_id")
    user = F.col("user_id")
    disclosures = sized.select(
        "dataset_id",
        F.concat(F.lit("did:web:c"), (user % 11).cast("string")).alias("consumer_id"),
        F.concat(F.lit("ag-"), (user % 7).cast("string")).alias("agreement_id"),
        F.lit(None).cast("string").alias("transfer_id"),
        F.array(user.cast("string")).alias("principals"),
        "row_count",
    )
    return audit.disclosure_totals(audit.disclosure_records(disclosures), "dataset_id", "consumer_id")


@query(
    "audit_page",
    """SELECT 'datasets.sales.orders' AS dataset_id, 'ag-2' AS agreement_id, count(*) AS row_count FROM orders
       WHERE o_totalprice > 250000""",
)
def audit_page(t: Tables) -> DataFrame:
    agreement = Agreement("ag-2", "did:web:consumer", {})
    session = sales_session(t)
    orders = session.open(["sales.orders"], Subject("svc", "service"), agreement)["sales.orders"]
    served = orders.filter(F.col("o_totalprice") > 250000)
    return session.disclosures(["sales.orders"], agreement, served).select("dataset_id", "agreement_id", "row_count")
