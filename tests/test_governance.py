import itertools

import pytest
from pyspark.sql import functions as F

from wardline import FilterContext, FilterPlan, GovernedSession, RowFilterRegistry, Subject
from wardline.functions import access as acl
from wardline.operators import access, audit, rowfilters as rls
from wardline.plans.secured import AccessRefused, Agreement
from wardline.sources.schema import CATALOGUE
from wardline.sources.tables import TableSource

USER = Subject("u1", "user", ("managers",))
NOBODY = Subject("u9", "user", ())


def entry(dataset_id, level="internal", filters=(), expose=True, offered=False, table=None, **governance):
    return {
        "dataset_id": dataset_id,
        "title": dataset_id,
        "backend_type": "postgres",
        "backend_config": {"table": table or dataset_id.rpartition(".")[2]},
        "expose": expose,
        "dataspace_expose": offered,
        "access_level": level,
        "lineage": {"facets": {"governance": {"rowFilters": [{"handler": h, "args": a} for h, a in filters], **governance}}},
    }


@pytest.fixture(scope="module")
def tables(spark):
    return {
        "readings": spark.createDataFrame(
            [(1, "u1", "d1", 5), (2, "u2", "d2", 6), (3, "u1", "d3", 7), (4, None, None, 8)], "id int, owner string, device string, v int"
        ),
        "sites": spark.createDataFrame([(5, "a"), (6, "b"), (7, "c")], "v int, name string"),
        "pointer": spark.createDataFrame([("d1", "u1"), ("d2", "u2"), (None, "u1")], "device string, user_id string"),
        "assets": spark.createDataFrame(
            [("d1", "u1"), ("d2", "u2"), ("d3", "u2"), (None, "u1"), (None, "u3")], "sensor_id string, owner_user_id string"
        ),
        "lists": spark.createDataFrame(
            [("u1", '{"data":{"items":["d1",null,"d3"]}}'), ("u2", '{"data":{"items":[]}}'), ("u3", '{"data":{"items":"d2"}}')],
            "user_id string, payload string",
        ),
    }


def session(spark, tables, *entries, registry=None):
    cat = spark.createDataFrame(list(entries), CATALOGUE)
    return GovernedSession(spark, cat, TableSource(spark, tables), registry)


def opened(s, ref, subject, agreement=None):
    return sorted(r.id for r in s.open([ref], subject, agreement)[ref].collect())


POINTER = ("table_pointer", {"column": "device", "pointer_table": "pointer", "pointer_key_column": "device"})
ASSETS = ("rec_registry", {"column": "device", "assets_table": "assets"})
LISTED = ("http_in_list", {"column": "device", "list_table": "lists", "response_path": "data.items", "list_subject_column": "user_id"})


@pytest.mark.parametrize(
    ("filters", "subject", "expected"),
    [
        ([("direct_user_match", {"column": "owner"})], USER, [1, 3]),
        ([POINTER], USER, [1]),
        ([ASSETS], USER, [1]),
        ([ASSETS], Subject("svc", "service", scopes=("dataset.query",)), [1, 2, 3, 4]),
        ([ASSETS], Subject("u3", "user", ("viewers",)), []),
        ([LISTED], USER, [1, 3]),
        ([LISTED], Subject("u2", "user", ("viewers",)), []),
        ([LISTED], Subject("u3", "user", ("viewers",)), [2]),
        ([LISTED, POINTER], USER, [1]),
        ([POINTER], Subject("root", "user", ("admins",)), [1, 2, 3, 4]),
        ([], USER, [1, 2, 3, 4]),
    ],
)
def test_row_filters(spark, tables, filters, subject, expected):
    s = session(spark, tables, entry("ds.lake.readings", filters=filters))
    assert opened(s, "lake.readings", subject) == expected
    assert opened(s, "ds.lake.readings", subject) == expected


def test_list_bound_and_empty_means_all(spark, tables):
    handler, args = LISTED
    bounded = session(spark, tables, entry("ds.a.readings", filters=[(handler, {**args, "max_items": "1"})]))
    with pytest.raises(Exception, match="more than 1 items"):
        opened(bounded, "a.readings", USER)
    assert opened(bounded, "a.readings", Subject("u2", "user", ("viewers",))) == []
    wide = session(spark, tables, entry("ds.a.readings", filters=[(handler, {**args, "max_items": "50"})]))
    assert opened(wide, "a.readings", USER) == [1, 3]
    everyone = session(spark, tables, entry("ds.a.readings", filters=[(handler, {**args, "empty_means_deny": "false"})]))
    assert opened(everyone, "a.readings", Subject("u2", "user", ("viewers",))) == [1, 2, 3, 4]
    assert opened(everyone, "a.readings", USER) == [1, 3]


def test_legacy_column_becomes_a_direct_match(spark, tables):
    s = session(spark, tables, entry("ds.a.readings", userFilterColumn="owner"))
    assert opened(s, "a.readings", USER) == [1, 3]


def test_deny_empties_the_whole_request(spark, tables):
    s = session(spark, tables, entry("ds.a.readings", filters=[LISTED]), entry("ds.a.sites", "open"))
    both = s.open(["a.readings", "a.sites"], Subject("u2", "user", ("viewers",)))
    assert both["a.sites"].count() == 0
    counted = both["a.sites"].join(both["a.readings"], "v", "left").agg(F.count("*").alias("n"))
    assert counted.first().n == 0
    assert s.open(["a.sites"], Subject("u2", "user", ("viewers",)))["a.sites"].count() == 3


def test_self_join_filters_every_occurrence(spark, tables):
    s = session(spark, tables, entry("ds.a.readings", filters=[("direct_user_match", {"column": "owner"})]))
    s.register(["a.readings"], USER)
    n = spark.sql("SELECT count(*) AS n FROM `a.readings` x JOIN `a.readings` y ON x.owner = y.owner").first().n
    assert n == 4


def test_or_in_a_query_cannot_widen_the_filter(spark, tables):
    s = session(spark, tables, entry("ds.a.readings", filters=[("direct_user_match", {"column": "owner"})]))
    got = s.sql("SELECT id FROM {r} WHERE id = 2 OR 1 = 1", USER, r="ds.a.readings")
    assert sorted(r.id for r in got.collect()) == [1, 3]


def test_filter_is_applied_before_an_outer_join(spark, tables):
    s = session(spark, tables, entry("ds.a.readings", filters=[("direct_user_match", {"column": "owner"})]), entry("ds.a.sites", "open"))
    got = s.sql("SELECT name, id FROM {s} s LEFT JOIN {r} r ON s.v = r.v", USER, s="ds.a.sites", r="ds.a.readings")
    assert sorted(tuple(r) for r in got.collect()) == [("a", 1), ("b", None), ("c", 3)]


def refused(s, refs, subject, agreement=None):
    with pytest.raises(AccessRefused) as exc:
        s.open(refs, subject, agreement)
    return exc.value.status, exc.value.datasets


def test_refusals(spark, tables):
    s = session(
        spark,
        tables,
        entry("ds.a.readings"),
        entry("ds.a.sites", "restricted"),
        entry("ds.a.hidden", "open", expose=False),
        entry("ds.a.odd", "secret"),
        entry("ds.a.loose", None, filters=[POINTER], table="readings"),
        {**entry("ds.a.nowhere", "open"), "backend_config": None},
    )
    assert refused(s, ["a.readings"], Subject.anonymous()) == (401, ["ds.a.readings"])
    assert refused(s, ["a.readings"], NOBODY) == (403, ["ds.a.readings"])
    assert refused(s, ["a.sites"], USER) == (403, ["ds.a.sites"])
    assert refused(s, ["a.hidden"], USER) == (403, ["ds.a.hidden"])
    assert refused(s, ["a.odd"], USER) == (500, ["ds.a.odd"])
    assert refused(s, ["a.nowhere"], USER) == (403, ["ds.a.nowhere"])
    assert refused(s, ["b.readings", "readings"], USER) == (400, ["b.readings", "readings"])
    assert refused(s, ["a.readings", "a.sites"], USER) == (403, ["ds.a.sites"])
    assert refused(s, ["a.loose"], Subject.anonymous()) == (401, ["a.loose"])
    assert refused(s, [], USER) == (400, [])
    assert opened(s, "a.loose", USER) == [1]


def test_agreements(spark, tables, tmp_path):
    s = session(
        spark,
        tables,
        entry("ds.a.readings", "restricted", offered=True),
        entry("ds.a.sites", "open"),
    )
    service = Subject("svc", "service")

    def agreement(handler, principals, **args):
        return Agreement("ag", "did:web:c", {"ds.a.readings": {"handler": handler, "args": args, "principals": principals}})

    assert refused(s, ["a.readings", "a.sites"], service, Agreement("ag", "c")) == (403, ["ds.a.sites"])
    assert opened(s, "a.readings", service, Agreement("ag", "c")) == [1, 2, 3, 4]
    direct = agreement("direct_user_match", ["u2", "u7"], column="owner")
    assert opened(s, "a.readings", service, direct) == [2]
    # Delegation is decided before the service bypass.
    members = agreement("rec_registry", ["u2"], column="device", assets_table="assets")
    assert opened(s, "a.readings", service, members) == [2, 3]
    none = agreement("rec_registry", ["u3"], column="device", assets_table="assets")
    assert opened(s, "a.readings", service, none) == []
    for handler, args in (POINTER, LISTED):
        for people in (["u1"], []):
            assert refused(s, ["a.readings"], service, agreement(handler, people, **args)) == (500, ["a.readings"])
    # No principals: no rows, be it on the identity of a service, an admin or a listed user.
    for people in ([], None, spark.createDataFrame([], "p string")):
        for who in (service, USER, Subject("root", "user", ("admins",))):
            assert opened(s, "a.readings", who, agreement("direct_user_match", people, column="owner")) == []
            assert opened(s, "a.readings", who, agreement("rec_registry", people, column="device", assets_table="assets")) == []
    crowd = spark.range(100_000).selectExpr("concat('x', id) AS p").union(spark.createDataFrame([("u2",)], "p string"))
    assert opened(s, "a.readings", service, agreement("direct_user_match", crowd, column="owner")) == [2]
    assert opened(s, "a.readings", service, agreement("rec_registry", crowd, column="device", assets_table="assets")) == [2, 3]
    page = s.open(["a.readings"], service, direct)["a.readings"].limit(10)
    record = s.disclosures(["a.readings"], direct, page).first()
    assert (record.dataset_id, record.row_count, record.authorized_subject_ids) == ("ds.a.readings", 1, ["u2", "u7"])
    assert record.n_principals == 2
    turned = s.disclosures(["a.readings"], agreement("direct_user_match", spark.createDataFrame([("u7",), ("u2",), ("u7",)], "p string")), page).first()
    assert (turned.n_principals, turned.principals_digest, turned.authorized_subject_ids) == (2, record.principals_digest, None)
    nobody = s.disclosures(["a.readings"], Agreement("ag", "c"), page).first()
    assert (nobody.n_principals, nobody.principals_digest) == (0, None)
    # A page is audited once, however often it is written; a crowd stays a table.
    many, folder = agreement("direct_user_match", crowd, column="owner"), str(tmp_path / "audit")
    for page_id in ("p1", "p1", "p2"):
        s.audit_page(["a.readings"], many, page, folder, page_id, "2024-05-01T10:00:00")
    records = spark.read.parquet(f"{folder}/records")
    assert sorted((r.page_id, r.n_principals, r.row_count) for r in records.collect()) == [("p1", 100_001, 1), ("p2", 100_001, 1)]
    assert spark.read.parquet(f"{folder}/people").groupBy("page_id").count().filter("count <> 100001").isEmpty()


def test_audit_append_and_totals(spark, tmp_path):
    rows = [("d", "c", "a1", None, ["u"], 3), ("d", "c", "a2", None, None, 4)]
    given = spark.createDataFrame(rows, "dataset_id string, consumer_id string, agreement_id string, transfer_id string, principals array<string>, row_count long")
    records = audit.disclosure_records(given)
    audit.append_audit(records, str(tmp_path / "audit"))
    audit.append_audit(records, str(tmp_path / "audit"))
    total = audit.disclosure_totals(spark.read.parquet(str(tmp_path / "audit")), "dataset_id", "consumer_id").first()
    assert (total.disclosures, total.rows_disclosed, total.agreements) == (4, 14, 2)


def test_registry(spark, tables):
    registry = RowFilterRegistry()
    registry.register("evens", lambda ctx: FilterPlan(lambda df: df.filter(F.col("id") % 2 == 0)))
    with pytest.raises(ValueError):
        registry.register("table_pointer", rls.table_pointer)
    s = session(spark, tables, entry("ds.a.readings", filters=[("evens", {})]), registry=registry)
    assert opened(s, "a.readings", USER) == [2, 4]
    with pytest.raises(rls.UnknownHandler):
        registry.resolve("absent", FilterContext(spark, USER, {}, lambda n: None))
    with pytest.raises(ValueError):
        registry.resolve("direct_user_match", FilterContext(spark, USER, {}, lambda n: None))


def test_filters_that_cannot_be_had_refuse_the_request(spark, tables):
    handler, args = LISTED
    unnamed = {k: v for k, v in args.items() if k != "list_subject_column"}
    for spec in (("absent", {}), ("direct_user_match", {}), (handler, unnamed)):
        assert refused(session(spark, tables, entry("ds.a.readings", filters=[spec])), ["a.readings"], USER) == (500, ["a.readings"])
    shared = session(spark, tables, entry("ds.a.readings", filters=[(handler, {**unnamed, "list_shared": "true"})]))
    assert set(opened(shared, "a.readings", USER)) >= {1, 2, 3}


def test_batch_and_session_give_the_same_status(spark):
    rows = [
        (1, None, "unknown_dataset", 400, False), (1, "b", "denied", 403, False),
        (2, "a", "login_required", 401, False), (2, "b", "not_offered", 403, False), (2, "c", "allow", 200, True),
        (3, "a", "allow", 200, True), (4, "z", "denied", 403, False), (4, "y", "invalid_level", 500, False),
        (5, None, "unknown_dataset", 400, False), (5, None, "unknown_dataset", 400, False),
    ]
    log = spark.createDataFrame(rows, "request_id int, dataset_id string, verdict string, status int, allowed boolean")
    got = {r.request_id: (r.status, r.n_refused, r.allowed) for r in access.judge_requests(log).collect()}
    assert got == {1: (400, 2, False), 2: (403, 2, False), 3: (200, 0, True), 4: (500, 2, False), 5: (400, 2, False)}


def test_entitled_rows_are_the_union_over_subjects(spark, tables):
    subjects = spark.createDataFrame([("u1",), ("u2",), ("u3",)], "s string")
    grants = rls.pointer_entitlements(subjects, tables["pointer"], "device", "user_id")
    rows = rls.visible_rows(tables["readings"], "device", grants)
    assert sorted((r.subject, r.id) for r in rows.collect()) == [("u1", 1), ("u2", 2)]
    totals = rls.visible_totals(tables["readings"], "device", grants, {"n": (F.count("*"), F.sum), "v": (F.max("v"), F.max)})
    assert sorted(tuple(r) for r in totals.collect()) == [("u1", 1, 5), ("u2", 1, 6)]


def reference_policy(level, action, kind, groups, scopes):
    """The policy written out by hand, rule by rule."""
    need = {"read": "dataset.query", "query": "dataset.query", "write": "dataset.write"}.get(action, "dataset.admin")
    covers = lambda want: any(s == want or (s.endswith(".admin") and want.startswith(s[: -len("admin")])) for s in scopes)
    reads = action in ("read", "query")
    if level == "open":
        return reads or (kind == "service" and covers(need))
    if level == "restricted":
        return (kind == "service" and covers("dataset.admin")) or (kind == "user" and "admins" in groups)
    if kind == "service":
        return covers(need)
    return kind == "user" and ("admins" in groups or (reads and bool({"managers", "viewers"} & set(groups))))


def test_policy_against_every_combination(spark):
    combos = list(
        itertools.product(
            ["open", "internal", "restricted"],
            ["read", "query", "write", "create", "delete", "admin"],
            ["user", "service", "anonymous"],
            [[], ["viewers"], ["managers", "x"], ["admins"]],
            [[], ["dataset.query"], ["dataset.admin"], ["data.admin", "dataset.write"]],
        )
    )
    df = spark.createDataFrame(combos, "level string, action string, kind string, groups array<string>, scopes array<string>")
    allowed, reason = acl.policy_columns(*[F.col(c) for c in ("level", "action", "kind", "groups", "scopes")])
    for r in df.withColumns({"allowed": allowed, "reason": reason}).collect():
        assert r.allowed == reference_policy(r.level, r.action, r.kind, r.groups, r.scopes), r
        assert r.reason


def test_unknown_action_is_denied(spark):
    one = spark.range(1)
    empty = F.array().cast("array<string>")
    allowed, _ = acl.policy_columns(F.lit("internal"), F.lit("zap"), F.lit("service"), empty, F.array(F.lit("dataset.admin")))
    assert one.select(allowed.alias("a")).first().a is False


def test_plan_ttl_and_key(spark):
    row = spark.range(1).select(
        rls.plan_ttl(F.lit(100), F.lit(None).cast("int"), F.lit(None).cast("int")).alias("none"),
        rls.plan_ttl(F.lit(100), F.lit(150), F.lit(None).cast("int")).alias("rest"),
        rls.plan_ttl(F.lit(100), F.lit(50), F.lit(None).cast("int")).alias("past"),
        rls.plan_ttl(F.lit(100), F.lit(150), F.lit(9999)).alias("override"),
        rls.plan_ttl(F.lit(100), F.lit(150), F.lit(-5)).alias("negative"),
    ).first()
    assert tuple(row) == (300, 50, 0, 300, 0)


def test_resolve_ids(spark):
    cat = spark.createDataFrame([("b.x.t",), ("a.x.t",), ("x.t2",), ("c.x_t",)], "dataset_id string")
    refs = spark.createDataFrame([("x.t",), ("x.t2",), ("b.x.t",), ("t",), ("x.none",)], "ref string")
    got = {r.ref: r.dataset_id for r in access.resolve_ids(refs, cat).collect()}
    assert got == {"x.t": "a.x.t", "x.t2": "x.t2", "b.x.t": "b.x.t", "t": None, "x.none": None}
    assert [r.ref for r in access.unknown_ids(refs, cat).collect()] == ["t", "x.none"]
