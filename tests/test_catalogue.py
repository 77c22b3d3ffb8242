import fnmatch
import json
import random

import pytest
from pyspark.sql import functions as F

from wardline.operators import catalogue as ops, dcat, rules
from wardline.sources import documents as docs, introspection as intro
from wardline.sources.schema import CATALOGUE
from wardline.sources.tables import NotReadable, TableSource

THEME = '["http://publications.europa.eu/resource/authority/data-theme/ENER"]'
SENSORS = "http://www.w3.org/ns/sosa/"


def catalogue(spark, *rows):
    return spark.createDataFrame([{"title": r["dataset_id"], "backend_type": "postgres", **r} for r in rows], CATALOGUE)


def names(df):
    return sorted(r.dataset_id for r in df.collect())


# --- catalogue ----------------------------------------------------------------------


def test_visibility(spark):
    cat = catalogue(
        spark,
        {"dataset_id": "listed", "expose": True, "access_level": "internal"},
        {"dataset_id": "unexposed", "expose": False, "access_level": "open"},
        {"dataset_id": "secret", "expose": True, "access_level": "secret"},
        {"dataset_id": "no_level", "expose": True},
        {"dataset_id": "offer_only", "expose": False, "dataspace_expose": True},
    )
    assert names(ops.visible(cat)) == ["listed", "no_level"]
    assert names(ops.get_entry(cat, "secret")) == []


def test_search_needs_every_condition(spark):
    cat = catalogue(
        spark,
        {"dataset_id": "a", "title": "Solar Power", "expose": True, "access_level": "open", "tags": {"keywords": ["Energy", "pv"]}},
        {"dataset_id": "b", "title": "Wind", "description": "no solar", "expose": True, "access_level": "internal"},
    )
    assert names(ops.search(cat, q="SOLAR")) == ["a", "b"]
    assert names(ops.search(cat, q="solar", access_level="open")) == ["a"]
    assert names(ops.search(cat, keywords=["ENERGY"])) == ["a"]
    assert names(ops.search(cat, q="solar", keywords=["wind"])) == []


def test_validation(spark):
    cat = catalogue(spark, {"dataset_id": "ok"}, {"dataset_id": "ftp", "backend_type": "ftp"}, {"dataset_id": "untitled", "title": None})
    assert names(ops.validate(cat)) == ["ok"]
    with pytest.raises(Exception, match="backend_type unknown|title missing"):
        ops.validate(cat, strict=True).collect()
    assert names(ops.validate(cat.limit(1), strict=True)) == ["ok"]


def test_upsert_is_idempotent_and_skips_missing_tables(spark):
    now = catalogue(spark, {"dataset_id": "kept"}, {"dataset_id": "changed", "title": "old"})
    new = catalogue(
        spark,
        {"dataset_id": "changed", "title": "new", "backend_config": {"table": "t1"}},
        {"dataset_id": "fresh", "backend_config": {"table": "t1"}},
        {"dataset_id": "no_table", "backend_config": {"table": "gone"}},
        {"dataset_id": "bucket", "backend_type": "s3", "backend_config": {"table": "gone"}},
    )
    tables = spark.createDataFrame([("t1",)], "table_name string")
    once = ops.upsert(now, new, tables)
    assert {r.dataset_id: (r.title, r.import_action) for r in once.collect()} == {
        "kept": ("kept", "kept"),
        "changed": ("new", "updated"),
        "fresh": ("fresh", "created"),
        "bucket": ("bucket", "created"),
    }
    assert tuple(ops.import_counts(once).first()) == (2, 1)
    twice = ops.upsert(once.drop("import_action"), new, tables)
    assert names(twice) == names(once) and tuple(ops.import_counts(twice).first()) == (0, 3)
    plan = {r.dataset_id: r.action for r in ops.plan_import(now, new, tables).collect()}
    assert plan == {"kept": "keep", "changed": "update", "fresh": "create", "no_table": "skip", "bucket": "create"}


def test_cleanup(spark):
    cat = catalogue(
        spark,
        {"dataset_id": "there", "backend_config": {"table": "t1"}},
        {"dataset_id": "gone", "backend_config": {"table": "t9"}},
        {"dataset_id": "validated", "backend_config": {"table": "t8"}},
        {"dataset_id": "no_ref"},
        {"dataset_id": "lake", "backend_type": "s3"},
    )
    tables = spark.createDataFrame([("t1",)], "table_name string")
    checked = spark.createDataFrame([("t8",)], "table_name string")
    assert names(ops.cleanup(cat, tables, checked)) == ["lake", "there", "validated"]


def test_selection(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "namespace string")
    chosen = lambda f: sorted(r.namespace for r in ops.select_namespaces(df, f).collect())
    assert chosen(["*", "-b"]) == ["a", "c"]
    assert chosen(["+a", "b", "-a"]) == ["b"]
    with pytest.raises(ValueError):
        ops.select_namespaces(df, ["-a"])


def test_documents_last_file_wins(spark, tmp_path):
    first, second = tmp_path / "1.json", tmp_path / "2.json"
    first.write_text('{"dataset_id":"x","title":"one","backend_type":"s3"}\n{"dataset_id":"y","title":"only","backend_type":"fs","expose":true}\n')
    second.write_text('{"dataset_id":"x","title":"two","backend_type":"s3"}\n')
    loaded = docs.load_catalogue(spark, [str(first), str(second)])
    assert sorted((r.dataset_id, r.title, r.expose) for r in loaded.collect()) == [("x", "two", False), ("y", "only", True)]
    docs.write_catalogue(loaded.withColumn("app", F.lit("demo")), str(tmp_path / "out"), group="app")
    assert (tmp_path / "out" / "app=demo").is_dir()


def test_row_filter_editing_keeps_exact_duplicates_out(spark):
    cat = catalogue(spark, {"dataset_id": "a", "lineage": {"facets": {"governance": {}}}}, {"dataset_id": "b"})
    once = ops.add_row_filter(cat, "a", "h", {"y": "2", "x": "1"})
    twice = ops.add_row_filter(once, "a", "h", {"x": "1", "y": "2"})
    third = ops.add_row_filter(twice, "a", "h", {"x": "9"})
    listed = lambda df: sorted((r.dataset_id, r.handler, json.dumps(r.args, sort_keys=True)) for r in ops.list_row_filters(df).collect())
    assert listed(third) == [("a", "h", '{"x": "1", "y": "2"}'), ("a", "h", '{"x": "9"}')]
    assert listed(ops.remove_row_filter(third, "a", "h", {"x": "9"})) == [("a", "h", '{"x": "1", "y": "2"}')]
    assert listed(ops.remove_row_filter(third, "a", "h")) == []


def test_identifiers(spark):
    df = spark.createDataFrame([("datasets.ds_gold.foo",), ("singer.tap-test.foo",), ("schema.table",), ("solo",)], "n string")
    assert [r.p for r in df.select(ops.physical_table(F.col("n")).alias("p")).collect()] == ["ds_gold.foo", "tap-test.foo", "schema.table", "solo"]
    one = spark.range(1).select(
        ops.table_dataset_id(F.lit("DS-Gold"), F.lit("ds gold"), F.lit("My Table")).alias("same"),
        ops.table_dataset_id(F.lit("n"), F.lit("s"), F.lit("t")).alias("three"),
    )
    assert tuple(one.first()) == ("ds_gold.my_table", "n.s.t")


# --- rules --------------------------------------------------------------------------


def overlaid(spark, defaults, stated):
    to_map = lambda d: F.create_map(*[F.lit(x).cast("string") for kv in d.items() for x in kv]).cast("map<string,string>")
    return spark.range(1).select(rules.overlay(to_map(defaults), to_map(stated)).alias("r"))


@pytest.mark.parametrize(
    ("defaults", "stated", "expected"),
    [
        ({"dcat.themes": THEME, "access_level": "internal"}, {"dcat.conforms_to": SENSORS}, {"dcat.themes": THEME, "access_level": "internal", "dcat.conforms_to": SENSORS}),
        ({"dcat.themes": THEME, "dcat.conforms_to": SENSORS}, {"dcat.conforms_to": "other"}, {"dcat.themes": THEME, "dcat.conforms_to": "other"}),
        ({"dcat.themes": THEME, "dcat.conforms_to": SENSORS}, {"dcat.conforms_to": None}, {"dcat.themes": THEME, "dcat.conforms_to": None}),
        ({"dcat.themes": THEME, "dcatx": "1"}, {"dcat": None}, {"dcatx": "1", "dcat": None}),
        ({"expose": "true", "dataspace.expose": "true"}, {"dataspace.expose": "false"}, {"expose": "true", "dataspace.expose": "false"}),
        ({}, {}, {}),
    ],
)
def test_overlay_by_presence(spark, defaults, stated, expected):
    assert overlaid(spark, defaults, stated).first().r == expected


@pytest.mark.parametrize(
    ("rule", "expose", "offered"),
    [
        ({"dataspace.expose": "true"}, True, True),
        ({"dataspace.expose": "false"}, False, False),
        ({"expose": "true", "dataspace.expose": "false"}, True, False),
        ({"expose": "true", "dataspace.expose": "true"}, True, True),
        ({"expose": "false"}, False, False),
        ({"expose": "true"}, True, False),
        ({}, False, False),
    ],
)
def test_exposure_gates(spark, rule, expose, offered):
    df = overlaid(spark, {}, rule)
    r = F.col("r")
    got = df.select(rules.effective_expose(r).alias("e"), rules.dataspace_offer(r).alias("o")).first()
    assert tuple(got) == (expose, offered)
    conflict = rules.exposure_conflicts(df, "r").count()
    assert conflict == int(offered and not expose) == 1 - rules.without_conflicts(df, "r").count()


def test_conflicting_gates_are_reported(spark):
    df = overlaid(spark, {"dataspace.expose": "true"}, {"expose": "false"})
    assert rules.exposure_conflicts(df, "r").count() == 1


def test_leading_wildcards_meet_only_names_with_their_rarest_piece(spark):
    rng = random.Random(6)
    piece = lambda a, b: "".join(rng.choice("abcd._7[]^") for _ in range(rng.randint(a, b)))
    names = ["gold." + piece(0, 9) for _ in range(1500)] + [piece(0, 4) for _ in range(200)] + ["", "a", "gold.", "*", "x\ny"]
    wild = ("*", "?", "[a-c]", "[!a]", "[]]", "**", "[")
    patterns = {rng.choice(wild) + piece(0, 5) + rng.choice(wild) + piece(0, 4) + rng.choice(("", *wild)) for _ in range(300)}
    patterns |= {"*", "?", "??", "*?", "[ab]*", "*gold*", "go*", "g*", "*d.*", "*.", "gold.*a", "*7", "[", "*[*", "*zzz*"}
    n = spark.createDataFrame([(x,) for x in names], "n string")
    p = spark.createDataFrame([(x,) for x in patterns], "p string")
    found = rules.glob_matches(n, "n", p, "p")
    assert sorted(map(tuple, found.collect())) == sorted((x, y) for x in names for y in patterns if fnmatch.fnmatchcase(x, y))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_no_key_of_the_pattern_index_meets_all_names(spark):
    n = spark.range(20_000).select(F.concat(F.lit("datasets.lake.t_"), "id").alias("n"))
    p = spark.range(2_000).select(F.concat(F.lit("*.t_"), F.col("id") * 7, F.lit("?")).alias("p"))
    literal = F.regexp_replace("p", r"[*?]", "\x00")
    keys = p.select(F.explode(rules._pattern_keys(literal)).alias("k")).groupBy("k.__kind", "k.__gram").count()
    assert keys.filter("__gram = '.t_'").first()["count"] == 2_000  # what all share, and the index avoids
    found = rules.glob_matches(n, "n", p, "p")
    assert found.count() == sum(1 for i in range(1, 2_000) for d in range(10) if 70 * i + d < 20_000)


def test_equal_ids_are_told_apart_by_all_columns(spark):
    rows = [{"dataset_id": "d", "title": "t", "description": "x", "landing_page": f"p{i}", "license_uri": f"l{i % 2}"} for i in range(6)]
    taken = set()
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        incoming = catalogue(spark, *order).repartition(4)
        (r,) = ops.upsert(catalogue(spark, {"dataset_id": "old"}), incoming).filter("dataset_id = 'd'").collect()
        taken.add((r.landing_page, r.license_uri))
    assert len(taken) == 1


def test_globs_match_like_the_shell(spark):
    rng = random.Random(3)
    words = ["ds", "gold", "a", "b.c", "x_1", "T", "[", "z-9", "$", "a+b"]
    found = sorted({".".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(150)})
    pats = sorted(
        {"*", "ds.*", "*.gold", "d?.*", "[ad]*", "[!a]*", "ds.gold", "a+b*", "$*", "x_[0-9].*", "b.c", "[[]*", "ds.[", "?", "*.*.*", "[^a]*"}
        | set(found[:5])
    )
    n = spark.createDataFrame([(x,) for x in found], "n string")
    p = spark.createDataFrame([(x,) for x in pats], "p string")
    got = sorted((r.n, r.pattern) for r in rules.glob_matches(n, "n", p, "p").collect())
    assert got == sorted((x, y) for x in found for y in pats if fnmatch.fnmatchcase(x, y))
    for flt in (["ds.*", "-*gold*"], ["-a*"], ["+[!a]*", "*9"]):
        inc = [f.lstrip("+") for f in flt if f[0] != "-"]
        exc = [f[1:] for f in flt if f[0] == "-"]
        hit = lambda x, ps: any(fnmatch.fnmatchcase(x, q) for q in ps)
        expected = sorted(x for x in found if (not inc or hit(x, inc)) and not hit(x, exc))
        assert sorted(r.n for r in ops.select_globs(n, flt, "n").collect()) == expected


def owners(spark):
    return spark.createDataFrame(
        [
            ("north", "schema:NGO", "North Coop", "https://north.example.org", None, ["local"]),
            ("grid", "schema:Corporation", "Grid SpA", "https://grid.example.org", "did:web:grid", ["dso", "local2"]),
        ],
        "id string, type string, name string, url string, did string, aliases array<string>",
    )


@pytest.mark.parametrize(
    ("owner", "uri"),
    [("local", "https://north.example.org"), ("dso", "did:web:grid"), ("north", "https://north.example.org"), ("acme", "urn:owner:acme"), (None, None)],
)
def test_owner_uri(spark, owner, uri):
    df = spark.createDataFrame([(owner,)], "o string")
    assert rules.with_owner_uri(df, owners(spark), "o", "uri").first().uri == uri


def test_explicit_publisher_is_not_the_holder(spark):
    rule = {"ownership": '[{"name":"local"}]', "dcat.publisher_uri": "https://agency.example.org"}
    df = overlaid(spark, {}, rule).select(F.lit("datasets.ds_gold.energy").alias("dataset_name"), F.col("r").alias("rule"))
    got = rules.entries_from_rules(df, owners(spark)).first()
    assert (got.publisher_uri, got.rights_holder_uri) == ("https://agency.example.org", "https://north.example.org")
    assert got.tags.keywords == ["owner:local"] and got.backend_config.table == "ds_gold.energy"


def test_agent_nodes(spark):
    df = spark.createDataFrame([("did:web:grid",), ("https://north.example.org",), ("urn:owner:local",), (None,)], "uri string")
    nodes = {r.uri: r.j for r in dcat.agent_columns(df, owners(spark), "uri", "n").select("uri", F.to_json("n").alias("j")).collect()}
    assert json.loads(nodes["did:web:grid"]) == {
        "@id": "did:web:grid",
        "@type": ["foaf:Organization", "schema:Corporation"],
        "foaf:name": "Grid SpA",
        "foaf:homepage": {"@id": "https://grid.example.org"},
    }
    assert json.loads(nodes["urn:owner:local"]) == {"@id": "urn:owner:local"}
    assert nodes[None] is None


def test_dcat_node(spark):
    cat = catalogue(
        spark,
        {"dataset_id": "a.gold.x", "title": "X", "access_level": "restricted", "tags": {"temporal": {"start": "2024", "end": None}}},
        {"dataset_id": "b", "access_level": "open", "backend_config": {"public_url": "https://f"}},
    )
    nodes = dcat.dataset_nodes(cat, owners(spark), "https://d.example.org/", "https://c.example.org", "https://api.example.org/")
    got = {r.dataset_id: json.loads(r.j) for r in nodes.select("dataset_id", F.to_json("node").alias("j")).collect()}
    a, b = got["a.gold.x"], got["b"]
    assert a["ds:medallion"] == "gold" and a["dct:temporal"] == {"dcat:startDate": "2024"} and "dcat:keyword" not in a
    offer = a["dcat:distribution"][0]["odrl:hasPolicy"]["odrl:permission"][0]
    assert [c["odrl:rightOperand"] for c in offer["odrl:constraint"]] == ["dataspaces.query", "active"]
    assert "dcat:downloadURL" not in a["dcat:distribution"][0]
    assert b["dcat:distribution"][0]["dcat:downloadURL"] == {"@id": "https://f"}
    assert "odrl:constraint" not in b["dcat:distribution"][0]["odrl:hasPolicy"]["odrl:permission"][0]
    assert b["dct:publisher"] == {"@id": "https://c.example.org"}


# --- sources ------------------------------------------------------------------------


def test_introspection_types(spark):
    df = spark.sql(
        "SELECT 1 AS i, 2L AS l, 1.5BD AS d, true AS b, DATE'2024-01-01' AS day, TIMESTAMP_NTZ'2024-01-01' AS ts, "
        "INTERVAL 1 DAY AS span, 'x' AS s, named_struct('a', 1) AS o, array(1) AS arr, "
        "named_struct('type', 'Point', 'srid', 0, 'rings', array(array(named_struct('x', 1D, 'y', 2D)))) AS geom"
    )
    columns = intro.describe_columns(df, "lake", "t")
    kinds = {r.column_name: (r.json_type, r.json_format) for r in intro.json_schema_properties(columns).collect()}
    assert kinds == {
        "i": ("integer", None),
        "l": ("integer", None),
        "d": ("number", None),
        "b": ("boolean", None),
        "day": ("string", "date"),
        "ts": ("string", "date-time"),
        "span": ("string", "duration"),
        "s": ("string", None),
        "o": ("object", None),
        "arr": ("string", None),
        "geom": ("object", "geojson"),
    }
    assert [r.column_name for r in columns.filter("is_geospatial").collect()] == ["geom"]
    document = json.loads(intro.json_schema(columns).first().json_schema)
    assert document["required"] == ["i", "l", "d", "b", "day", "ts", "span", "s", "o", "arr", "geom"]
    assert document["additionalProperties"] is False


def test_observed_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    flags = {r.column_name: r.nullable for r in intro.describe_columns(df, "s", "t", observe_nulls=True).collect()}
    assert flags == {"a": False, "b": True}


def test_table_source(spark, tmp_path):
    spark.range(3).write.json(str(tmp_path / "j"))
    source = TableSource(spark, {"known": spark.range(2)})
    assert source.entry({"table": "known"}).count() == 2
    assert source.entry({"path": str(tmp_path / "j"), "format": "application/json"}).count() == 3
    with pytest.raises(NotReadable):
        source.entry({})
    spark.range(4).createOrReplaceTempView("session_view")
    assert source.table("session_view").count() == 4
    assert "session_view" in {r.table_name for r in intro.list_tables(spark).collect()}
    assert "session_view" not in {r.table_name for r in intro.list_tables(spark, include_views=False).collect()}


def test_a_pattern_stated_twice_counts_once_and_overrides_win(spark):
    schema = "pattern string, overlay map<string,string>"
    base = spark.createDataFrame([("a.*", {"level": "open", "dcat.x": "1", "title": "t"}), ("b.*", {"level": "open"})], schema)
    override = spark.createDataFrame([("a.*", {"level": None, "dcat": None}), ("c.*", {"level": "secret"})], schema)
    layered = {r.pattern: r.overlay for r in rules.layer_rules(base, override).collect()}
    assert layered == {"a.*": {"level": None, "dcat": None, "title": "t"}, "b.*": {"level": "open"}, "c.*": {"level": "secret"}}
    names = spark.createDataFrame([("a.one",), ("z",)], "dataset_name string")
    twice = base.union(base).union(override)
    assert sorted(r.dataset_name for r in rules.resolve_rules(names, twice).collect()) == ["a.one", "z"]


def test_upsert_with_repeated_ids_and_plan_with_deletes(spark):
    def entries(*rows):
        made = [{"dataset_id": i, "title": t, "backend_type": "postgres", "backend_config": {"table": table}} for i, t, table in rows]
        return spark.createDataFrame(made, CATALOGUE)

    current = entries(("a", "old", "t1"), ("b", "old", "gone"), ("c", "old", "t1"))
    incoming = entries(("a", "new", "t1"), ("a", "new", "t1"), ("d", "new", "t1"), ("e", "new", "gone"))
    tables = spark.createDataFrame([("t1",)], "table_name string")
    after = sorted((r.dataset_id, r.title, r.import_action) for r in ops.upsert(current, incoming, tables).collect())
    assert after == [("a", "new", "updated"), ("b", "old", "kept"), ("c", "old", "kept"), ("d", "new", "created")]
    plan = {r.dataset_id: r.action for r in ops.plan_import(current, incoming, tables, remove_stale=True).collect()}
    assert plan == {"a": "update", "b": "delete", "c": "keep", "d": "create", "e": "skip"}
    assert ops.plan_import(current, incoming, tables).filter("action = 'delete'").count() == 0


def test_documents_in_the_order_given_and_malformed_ones(spark, tmp_path):
    first, second = tmp_path / "z.json", tmp_path / "a.json"
    first.write_text('{"dataset_id": "x", "title": "first", "backend_type": "s3"}\n{broken\n{broken too\n')
    second.write_text('{"dataset_id": "x", "title": "second", "backend_type": "s3"}\n')
    for given, title in (([str(first), str(second)], "second"), ([str(second), str(first)], "first")):
        loaded = docs.load_catalogue(spark, given)
        assert [r.title for r in loaded.filter("dataset_id = 'x'").collect()] == [title]
        assert ops.validation_errors(loaded).filter("size(errors) > 0").count() == 2
    assert sorted(r.text for r in docs.malformed(spark, [str(first), str(second)]).collect()) == ["{broken", "{broken too"]


def test_sink_leaves_what_is_there(spark, tmp_path):
    entries = spark.createDataFrame([{"dataset_id": str(i)} for i in range(30)], CATALOGUE).withColumn("app", F.lit("one"))
    path = str(tmp_path / "out")
    docs.write_catalogue(entries, path, group="app", records_per_file=10)
    assert len(list((tmp_path / "out" / "app=one").glob("part-*"))) >= 3
    with pytest.raises(Exception, match="exists"):
        docs.write_catalogue(entries, path, group="app")
    assert spark.read.json(path).count() == 30


def test_members_called_like_a_geometry_are_none(spark):
    df = spark.sql("SELECT named_struct('viewpoint', 1) AS s, 'x' AS point_of_sale")
    assert not any(r.is_geospatial for r in intro.describe_columns(df, "s", "t").collect())


def test_producers_give_the_catalogue_schema(spark):
    wanted = spark.createDataFrame([], CATALOGUE).dtypes
    rule = {"row_filters": '[{"handler": "h", "args": {"column": "c"}}]', "medallion": "gold", "retention_days": "30", "consent_required": "true", "tags": '["a"]'}
    df = overlaid(spark, {}, rule).select(F.lit("datasets.ds_gold.energy").alias("dataset_name"), F.col("r").alias("rule"))
    mapped = df.withColumns({"ontology_path": F.lit("shared"), "ontology_mapping": F.lit('{"target_type": "sosa:Observation", "fields": [{"source": "a"}]}')})
    entries = rules.entries_from_rules(mapped, owners(spark))
    assert entries.dtypes == wanted
    got = entries.first()
    facet = got.lineage.facets.governance
    assert (facet.medallion, facet.retentionDays, facet.consentRequired, facet.tags) == ("gold", 30, True, ["a"])
    assert (facet.rowFilters[0].handler, facet.rowFilters[0].args) == ("h", {"column": "c"})
    assert got.ontology_path == "shared" and got.ontology_mapping.fields[0].source == "a"
    described = intro.describe_columns(spark.sql("SELECT 1 AS a"), "s", "t")
    assert ops.entries_from_tables(described, "n").dtypes == wanted


def test_single_record_carries_its_context(spark):
    cat = catalogue(spark, {"dataset_id": "datasets.ds.x", "access_level": "open", "expose": True, "backend_config": {"table": "ds.x"}})
    nodes = dcat.dataset_nodes(cat, owners(spark), "https://data.example.org/", "https://data.example.org/catalogue", "https://api.example.org")
    document = json.loads(dcat.dataset_documents(nodes, "https://space.example.org/ns#").first().document)
    assert document["@context"]["ds"] == "https://space.example.org/ns#" and document["@context"]["dcat"]
    assert document["@id"].startswith("https://data.example.org/")


def test_a_table_without_columns_keeps_a_schema(spark):
    columns = intro.describe_columns(spark.sql("SELECT 1 AS a"), "s", "t")
    tables = spark.createDataFrame([("s", "t"), ("s", "bare")], "schema_name string, table_name string")
    got = {r.table_name: json.loads(r.json_schema) for r in intro.json_schema(columns, tables).collect()}
    assert list(got["t"]["properties"]) == ["a"] and got["bare"]["properties"] == {}


def test_upsert_orders_whole_entries_only_where_an_id_repeats(spark):
    def entries(rows):
        made = spark.createDataFrame(rows, "dataset_id string, title string, description string, backend_type string")
        return ops.to_catalogue(made)

    incoming = entries([("a", "x", "2", "s3"), ("a", "x", "1", "s3"), ("b", "y", "3", "s3"), (None, "n", "5", "s3"), (None, "m", "6", "s3"), ("c", "z", "7", "s3"), ("c", None, "8", "s3")])
    done = ops.upsert(entries([("b", "old", "0", "s3"), ("k", "kept", "0", "s3"), (None, "none", "0", "s3")]), incoming)
    got = {(r.dataset_id, r.title, r.description, r.import_action) for r in done.select("dataset_id", "title", "description", "import_action").collect()}
    assert got == {("a", "x", "1", "created"), ("b", "y", "3", "updated"), (None, "m", "6", "created"), ("c", None, "8", "created"), ("k", "kept", "0", "kept"), (None, "none", "0", "kept")}
    # The texts of other entries are no sort keys.
    plan = done.select("dataset_id", "import_action")._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "description" not in plan.split("Window", 1)[1].split("windowspecdefinition", 1)[-1].split("\n", 1)[0]
