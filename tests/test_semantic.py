import json
import time

import pytest
from pyspark.sql import functions as F

from wardline.operators import conformance as conf, mapping, screening
from wardline.sources.schema import CATALOGUE, MAPPING as MAPPING_SCHEMA

SOSA_SENSOR = "http://www.w3.org/ns/sosa/Sensor"

MAPPING = {
    "version": "3",
    "target_type": "saref:Measurement",
    "id_template": "urn:flow:{gauge}:{taken}",
    "profile": {"name": "water", "version": "v2.11"},
    "fields": [
        {"source": "taken", "target": "saref:hasTimestamp", "datatype": "xsd:dateTime", "required": True},
        {"source": "litres", "target": "saref:hasValue", "datatype": "xsd:double"},
        {"source": "probe", "target": "saref:isMadeBy", "kind": "iri"},
    ],
}
AREAS = {
    "target_type": "schema:Place",
    "id_template": "urn:area:{code}",
    "profile": {"name": "water", "version": "v2.11"},
    "fields": [
        {"source": "label", "target": "schema:name", "datatype": "xsd:string"},
        {"source": "basin", "target": "schema:containedInPlace", "kind": "iri"},
    ],
}
SHAPES = (
    conf.Shape("schema:Place", "schema:name", min_count=1),
    conf.Shape("schema:Place", "schema:containedInPlace", object_class="skos:Concept"),
)
PROFILES = (conf.Profile("water", "v2.2"), conf.Profile("water", "v2.9", SHAPES), conf.Profile("water", "v2.11", SHAPES))
ROWS = [("g7", "2019-03-02T06:30:00Z", "41.25", "urn:probe:north"), ("g8", "2019-03-02T07:00:00Z", "3e2", "urn:probe:south")]
COLUMNS = "gauge string, taken string, litres string, probe string"
AREA_COLUMNS = "code string, label string, basin string"
PREFIXES = {**mapping.PREFIXES}


@pytest.fixture(scope="module")
def concepts(spark):
    rows = [("urn:basin:lake", PREFIXES["skos"] + "Concept"), ("urn:basin:lake", PREFIXES["schema"] + "Place"), ("urn:basin:sea", PREFIXES["schema"] + "Place")]
    return spark.createDataFrame(rows, "iri string, class string")


def check(df, spec, concepts, profiles=PROFILES, **kw):
    return conf.report("ds.gold.x", df, spec, profiles, concepts, **kw).first()


def messages(df, spec, concepts, profile=PROFILES[2]):
    return sorted(r.message for r in conf.violations(df, spec, profile, concepts).collect())


def test_good_rows_conform(spark, concepts):
    r = check(spark.createDataFrame(ROWS, COLUMNS), MAPPING, concepts)
    assert (r.conforms, r.sample_size, r.n_violations, r.by_rule, r.profile_version, r.profile_pinned) == (True, 2, 0, {}, "v2.11", True)


def test_no_rows_conform(spark, concepts):
    r = check(spark.createDataFrame([], COLUMNS), MAPPING, concepts)
    assert (r.conforms, r.sample_size) == (True, 0)


def test_drifted_column_is_a_result_naming_it(spark, concepts):
    drifted = spark.createDataFrame(ROWS, COLUMNS).withColumn("id", F.col("gauge")).withColumnRenamed("taken", "at")
    spec = {**MAPPING, "id_template": "urn:flow:{id}"}
    assert not check(drifted, spec, concepts).conforms
    assert all("taken" in m for m in messages(drifted, spec, concepts))


def test_controls_of_each_rule(spark, concepts):
    area = lambda *row: spark.createDataFrame([row], AREA_COLUMNS)
    assert check(area("a", "Upper lake", "urn:basin:lake"), AREAS, concepts).conforms
    assert "schema:name" in messages(area("b", None, None), AREAS, concepts)[0]
    assert "urn:basin:none" in messages(area("c", "x", "urn:basin:none"), AREAS, concepts)[0]


def test_every_class_rule_of_a_path_counts(spark, concepts):
    both = conf.Profile("water", "v3", (*SHAPES, conf.Shape("schema:Place", "schema:containedInPlace", object_class="schema:Place")))
    df = spark.createDataFrame([("a", "x", "urn:basin:lake"), ("b", "x", "urn:basin:sea"), ("c", "x", "urn:basin:none")], AREA_COLUMNS)
    found = conf.violations(df, AREAS, both, concepts).groupBy("subject").count().collect()
    assert {tuple(r) for r in found} == {("urn:area:b", 1), ("urn:area:c", 2)}


def test_only_the_target_class_is_checked(spark, concepts):
    other = conf.Profile("water", "v3", (conf.Shape("schema:Event", "schema:containedInPlace", object_class="skos:Concept"), conf.Shape("schema:Event", "schema:name", datatype="xsd:date")))
    assert messages(spark.createDataFrame([("c", "x", "urn:basin:none")], AREA_COLUMNS), AREAS, concepts, other) == []


def test_datatype_shapes(spark, concepts):
    def found(spec, row, wanted, path="saref:hasValue"):
        profile = conf.Profile("water", "v3", (conf.Shape("saref:Measurement", path, datatype=wanted),))
        df = spark.createDataFrame([row], COLUMNS)
        return [r.message for r in conf.violations(df, spec, profile, concepts).filter("rule = 'shapeDatatype'").collect()]

    assert found(MAPPING, ROWS[0], "xsd:double") == []
    assert len(found(MAPPING, ("g", "2019-03-02T06:30:00Z", "abc", None), "xsd:double")) == 1  # not of its form
    assert len(found(MAPPING, ROWS[0], "xsd:decimal")) == 1  # another datatype
    assert len(found(MAPPING, ROWS[0], "xsd:anyURI", "saref:isMadeBy")) == 1  # an IRI is no literal
    untyped = {**MAPPING, "fields": [{"source": "litres", "target": "saref:hasValue"}]}
    assert found(untyped, ROWS[0], "xsd:string") == [] and len(found(untyped, ROWS[0], "xsd:double")) == 1


def test_class_shapes_without_a_vocabulary_are_unavailable(spark):
    df = spark.createDataFrame([("c", "x", "urn:basin:none")], AREA_COLUMNS)
    with pytest.raises(conf.ConformanceUnavailable):
        conf.report("x", df, AREAS, PROFILES)


def test_nested_fields_at_any_depth(spark, concepts):
    df = spark.sql("SELECT 'n' AS code, named_struct('label', CAST(NULL AS STRING), 'more', named_struct('unit', 'l', 'rate', 'fast')) AS info, 'top' AS outer_label")
    spec = {
        "target_type": "schema:Place",
        "id_template": "urn:area:{code}",
        "fields": [
            {"source": "info", "nested_fields": [
                {"source": "label", "target": "schema:name", "required": True},
                {"source": "more", "nested_fields": [
                    {"source": "unit", "target": "qudt:unit"},
                    {"source": "rate", "target": "qudt:value", "datatype": "xsd:double"},
                    {"source": "absent", "target": "qudt:note", "required": True},
                ]},
                {"source": "outer_label", "target": "rdfs:label"},
            ]},
        ],
    }
    got = {(r.p.rpartition("/")[2].rpartition("#")[2], r.o) for r in mapping.map_to_triples(df, spec).collect()}
    assert got == {("type", "https://schema.org/Place"), ("unit", "l"), ("value", "fast"), ("label", "top")}
    found = {(r.path.rpartition("/")[2], r.rule) for r in conf.row_violations(df, spec).collect()}
    assert found == {("label", "required"), ("absent", "required"), ("value", "datatype")}
    assert {r.path for r in conf.required_violations(df, spec).collect()} == {"label", "absent"}


def test_bad_literals(spark, concepts):
    assert len(messages(spark.createDataFrame([("g", "yesterday", "1,5", None)], COLUMNS), MAPPING, concepts)) == 2


def test_profiles():
    assert conf.pick_profile(PROFILES, MAPPING)[1] is True
    unpinned = {k: v for k, v in MAPPING.items() if k != "profile"}
    assert (conf.pick_profile(PROFILES, unpinned)[0].version, conf.pick_profile(PROFILES, unpinned)[1]) == ("v2.11", False)
    override = conf.pick_profile(PROFILES, MAPPING, "v2.2")
    assert (override[0].version, override[1]) == ("v2.2", False)
    with pytest.raises(conf.ConformanceUnavailable, match="v2.1'"):
        conf.pick_profile(PROFILES, {**MAPPING, "profile": {"name": "water", "version": "v2.1"}})


def test_not_a_spec_is_unavailable(spark):
    with pytest.raises(conf.ConformanceUnavailable):
        conf.report("x", spark.range(1), {"other": 1}, PROFILES)


def test_violations_are_counted_exactly_and_all_listed(spark, concepts):
    none = F.lit(None).cast("string")
    df = spark.range(450).select(F.col("id").cast("string").alias("code"), none.alias("label"), none.alias("basin"))
    r = check(df, AREAS, concepts)
    assert (r.n_violations, r.by_rule, r.sample_size) == (450, {"minCount": 450}, 450)
    assert len(messages(df, AREAS, concepts)) == 450


def test_shared_subject_counts_all_its_rows(spark):
    """Two rows of one node: the property of either row satisfies the shape."""
    df = spark.createDataFrame([("k", "n", None), ("k", None, "urn:basin:x"), ("j", None, None)], AREA_COLUMNS)
    triples = mapping.map_to_triples(df, AREAS)
    bad = conf.min_count_violations(triples, SHAPES)
    assert [r.subject for r in bad.collect()] == ["urn:area:j"]
    twice = conf.min_count_violations(triples, (conf.Shape("schema:Place", "schema:name", min_count=2),))
    assert sorted(r.subject[-1] for r in twice.collect()) == ["j", "k"]


def test_triples(spark):
    df = spark.createDataFrame(ROWS[:1] + [("g9", "t", None, None), (None, "t", "1", None)], COLUMNS)
    spec = {**MAPPING, "fields": MAPPING["fields"] + [{"target": "dct:source", "kind": "constant", "value": "https://x/{site}"}]}
    got = {(r.s, r.p.rpartition("/")[2], r.o, r.o_kind) for r in mapping.map_to_triples(df, spec, {"site": "n"}).collect()}
    first = "urn:flow:g7:2019-03-02T06:30:00Z"
    assert (first, "hasTimestamp", "2019-03-02T06:30:00Z", "literal") in got
    assert (first, "isMadeBy", "urn:probe:north", "iri") in got
    assert {g for g in got if g[0] == "urn:flow:g9:t"} == {
        ("urn:flow:g9:t", "22-rdf-syntax-ns#type", "https://saref.etsi.org/core/Measurement", "iri"),
        ("urn:flow:g9:t", "hasTimestamp", "t", "literal"),
        ("urn:flow:g9:t", "source", "https://x/n", "iri"),
    }
    with pytest.raises(mapping.VocabularyError):
        mapping.expand("zzz:thing")


def test_vocabulary_document(spark):
    fields = [
        {"source": "ts", "target": "sosa:resultTime", "datatype": "xsd:dateTime"},
        {"source": "pv_kw", "target": "saref:hasValue", "datatype": "xsd:decimal", "nested_fields": [{"source": "inner", "target": "qudt:unit"}]},
        {"source": "device", "target": "sosa:madeBySensor", "kind": "iri"},
        {"target": "sosa:observedProperty", "kind": "constant", "value": "https://x/p"},
        {"source": "k", "target": "geo:lat", "kind": "constant", "value": "1"},
    ]
    rows = [
        {"dataset_id": "pv", "ontology_mapping": {"target_type": "sosa:Observation", "fields": fields}, "tags": {"conformsTo": "https://saref.etsi.org/core/"}},
        {"dataset_id": "none"},
    ]
    cat = spark.createDataFrame(rows, CATALOGUE)
    documents = mapping.vocabulary_documents(cat, mapping.prefix_table(cat)).collect()
    assert [r.dataset_id for r in documents] == ["pv"]
    d = json.loads(documents[0].document)
    context = d["@context"]
    assert context["ts"] == {"@id": "sosa:resultTime", "@type": "xsd:dateTime"}
    assert context["device"]["@type"] == "@id" and context["inner"] == {"@id": "qudt:unit"}
    assert {k for k, v in context.items() if isinstance(v, str)} == {"sosa", "saref", "xsd", "qudt", "dct"}
    assert "k" not in context and "sosa:observedProperty" not in context
    assert d["@type"] == "sosa:Observation" and d["dct:conformsTo"] == {"@id": "https://saref.etsi.org/core/"}
    few = mapping.prefix_table(cat, {k: v for k, v in PREFIXES.items() if k != "saref"})
    assert [tuple(r) for r in mapping.unknown_prefixes(cat, few).collect()] == [("pv", "saref")]
    with pytest.raises(Exception, match="undeclared prefix"):
        mapping.vocabulary_documents(cat, few).collect()


# (text, rules broken, tables)
TEXTS = [
    ("SELECT w.temp FROM weather w JOIN solar s ON w.lat = s.lat", [], ["solar", "weather"]),
    ("SELECT CAST(value AS float) FROM solar", [], ["solar"]),
    ("SELECT array_agg(DISTINCT city ORDER BY city) FILTER (WHERE city IS NOT NULL) FROM weather", [], ["weather"]),
    ("SELECT city FROM weather WHERE 1=1 GROUP BY city", [], ["weather"]),
    ("WITH a AS (SELECT avg(value) AS m FROM solar) SELECT s.value FROM solar s WHERE s.value > (SELECT m FROM a)", [], ["solar"]),
    ("SELECT * FROM prod.energy.solar_readings", [], ["prod.energy.solar_readings"]),
    ("SELECT * FROM a.b WHERE id IN (SELECT id FROM c.d.e)", [], ["a.b", "c.d.e"]),
    ("SELECT * FROM solar WHERE 1=1 OR 1=1", ["tautology"], ["solar"]),
    ("SELECT * FROM solar UNION SELECT * FROM weather", ["set_ops"], ["solar", "weather"]),
    ("SELECT * FROM solar WHERE EXISTS (SELECT 1 FROM weather)", ["exists"], ["solar", "weather"]),
    ("SELECT pg_sleep(10) FROM solar", ["functions"], ["solar"]),
    ("SELECT * FROM solar -- all", ["comments"], ["solar"]),
    ("DELETE FROM solar", ["statement"], ["solar"]),
    ("SELEC * FROM solar", ["statement"], ["solar"]),
    ("SELECT * FROM solar LIMIT 5", ["top_limit"], ["solar"]),
    ("SELECT * FROM (SELECT * FROM solar LIMIT 5) q", [], ["solar"]),
    ("SELECT value FROM solar; DELETE FROM solar", ["stacking", "statement"], ["solar"]),
    ("SELECT value FROM solar;", [], ["solar"]),
    ("SELECT 'it''s a union -x' AS s FROM solar", [], ["solar"]),
    ("  \n ", ["empty"], []),
    (None, ["empty"], []),
]


def test_screening(spark):
    df = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(TEXTS)], "i int, sql string")
    for r in screening.screen(df).collect():
        text, reasons, tables = TEXTS[r.i]
        assert (sorted(r.reasons), r.tables, r.accepted) == (sorted(reasons), tables, not reasons), text
    assert {r.rule: r.queries for r in screening.rule_totals(screening.screen(df)).collect()}["statement"] == 3


@pytest.mark.parametrize(
    ("where", "verdict"),
    [
        ("1 = 1 AND (a = 2 OR b = 3)", "warn"),
        ("(a = 2 OR b = 3) AND 'x' = 'x'", "warn"),
        ("a = 2 OR 1 = 1", "reject"),
        ("a = 2 AND (b = 3 OR 1 = 1)", "reject"),
        ("lower(a) = lower(a) OR b = 1", "reject"),
        ("lower(a) = lower(b) OR b = 1", "none"),
        ("lower(a) = lower(a)", "warn"),
        ("a = 2 OR b = 3", "none"),
    ],
)
def test_tautology_needs_an_or_on_its_own_level(spark, where, verdict):
    log = spark.createDataFrame([(f"SELECT a FROM solar WHERE {where}",)], "sql string")
    r = screening.screen(log).first()
    got = "reject" if "tautology" in r.reasons else "warn" if "tautology" in r.warnings else "none"
    assert got == verdict


@pytest.mark.parametrize(
    "where, verdict",
    [
        ("x = 5 AND (1 = 1 OR a IN (1,2))", "reject"),
        ("x = 5 AND(1 = 1 OR a IN(SELECT b FROM t WHERE (c = 2)))", "reject"),
        ("x = 5 AND ((((((1 = 1 OR a IN (1,2)))))))", "reject"),
        ("(((((a = 2 OR b = 3))))) AND 1 = 1", "warn"),
        ("x IN (1,2) AND (lower(a) = lower(a) OR (b = 3))", "reject"),
        ("(lower(a) = lower(b) OR c IN (1,2)) AND 1 = 1", "warn"),
    ],
)
def test_tautology_on_levels_that_hold_brackets(spark, where, verdict):
    r = screening.screen(spark.createDataFrame([(f"SELECT * FROM t WHERE {where}",)], "sql string")).first()
    assert ("reject" if "tautology" in r.reasons else "warn" if "tautology" in r.warnings else "none") == verdict


@pytest.mark.parametrize(
    "where, verdict",
    [
        ("x = 5 OR (a = 1 AND 1 = 1)", "reject"),  # the OR is further out
        ("x = 5 OR a IN (SELECT b FROM t WHERE 1 = 1)", "reject"),
        ("1 = 1 AND x IN (SELECT a OR b FROM t)", "warn"),
        ("'A' = 'a' OR b = 1", "none"),
        ("note = '1 = 1 OR (' AND 1 = 1", "warn"),
        ("a + 1 = a + 1 OR b", "reject"),
        ("(1) = (1) OR b", "reject"),
        ("a < b = b OR c", "none"),
        ("CASE WHEN 1 = 1 THEN a END = 2 OR b", "reject"),
        ("CASE WHEN b OR c THEN 1 = 1 END", "warn"),
        ("a = a) OR (b", "reject"),
        ("((((a = a", "warn"),
        ("a = b", "none"),
    ],
)
def test_tautology_under_an_or_anywhere(spark, where, verdict):
    log = spark.createDataFrame([(f"SELECT * FROM t WHERE {where}",)], "sql string")
    r = log.select(screening.tautology_severity(F.col("sql")).alias("s")).first()
    assert (r.s or "none") == verdict
    r = screening.screen(log).first()
    assert ("reject" if "tautology" in r.reasons else "warn" if "tautology" in r.warnings else "none") == verdict


def test_ten_thousand_brackets_are_judged_in_linear_time(spark):
    texts = [
        "SELECT a FROM t WHERE x = 1 OR " + "(" * 5000 + "1 = 1" + ")" * 5000,
        "SELECT a FROM t WHERE 1 = 1 AND x IN (" + "(b OR c), " * 5000 + "d)",
    ]
    log = spark.createDataFrame([(t,) for t in texts], "sql string")
    judged = log.select(screening.tautology_severity(F.col("sql")).alias("s"))
    assert [r.s for r in judged.collect()] == ["reject", "warn"]
    begin = time.time()
    judged.collect()
    assert time.time() - begin < 2


def test_report_from_columns_agrees_with_the_violations(spark):
    """Totals of the one-scan report against the listed violations, on rows that share nodes, repeat and lack values."""
    spec = {
        "target_type": "sosa:Observation",
        "id_template": "urn:o:{k}",
        "fields": [
            {"source": "k", "target": "dct:identifier", "required": True},
            {"source": "v", "target": "sosa:hasSimpleResult", "datatype": "xsd:decimal", "required": True},
            {"source": "w", "target": "sosa:hasSimpleResult", "datatype": "xsd:integer"},
            {"source": "maker", "target": "sosa:madeBySensor", "kind": "iri"},
            {"source": "label", "target": "rdfs:label"},
        ],
    }
    shapes = (
        conf.Shape("sosa:Observation", "rdfs:label", min_count=1),
        conf.Shape("sosa:Observation", "sosa:hasSimpleResult", min_count=2, datatype="xsd:decimal"),
        conf.Shape("sosa:Observation", "sosa:madeBySensor", min_count=1, object_class="sosa:Sensor"),
        conf.Shape("sosa:Platform", "dct:identifier", min_count=2, datatype="xsd:integer"),
    )
    rows = [
        ("a", "1", "1", "urn:m:1", "x"), ("a", "1.0", None, "urn:m:2", None), ("b", "1", None, None, None), ("b", "1", None, None, None),
        ("c", "bad", "1.5", "urn:m:2", "y"), (None, None, "2", "urn:m:3", "z"), ("d", None, None, "urn:m:1", ""), ("a", "1", "1", "urn:m:1", "x"),
    ]
    df = spark.createDataFrame(rows, "k string, v string, w string, maker string, label string")
    typed = spark.createDataFrame([("urn:m:1", SOSA_SENSOR), ("urn:m:1", SOSA_SENSOR), ("urn:m:2", "urn:other")], "iri string, class string")
    for chosen in (shapes, shapes[:1], (shapes[1], conf.Shape("sosa:Observation", "rdfs:label", min_count=3)), ()):
        profile = conf.Profile("p", "v1", chosen)
        listed = conf.violations(df, spec, profile, typed).groupBy("rule").count().collect()
        got = conf.report("d", df, spec, [profile], typed).first()
        assert got.by_rule == {r["rule"]: r["count"] for r in listed} and got.sample_size == 8
        assert got.n_violations == sum(r["count"] for r in listed) and got.conforms == (not listed)
    empty = conf.report("d", df.limit(0), spec, [conf.Profile("p", "v1", shapes)], typed).first()
    assert empty.conforms and empty.sample_size == 0 and empty.by_rule == {}
    with pytest.raises(conf.ConformanceUnavailable):
        conf.report("d", df, spec, [conf.Profile("p", "v1", shapes)])


def test_report_reads_the_rows_once(spark, tmp_path):
    df = spark.range(10).select(F.col("id").cast("string").alias("k"))
    df.write.parquet(str(tmp_path / "rows"))
    spec = {"target_type": "sosa:Observation", "id_template": "urn:o:{k}", "fields": [{"source": "k", "target": "rdfs:label", "required": True}]}
    profile = conf.Profile("p", "v1", (conf.Shape("sosa:Observation", "rdfs:label", min_count=2, datatype="xsd:integer"),))
    report = conf.report("d", spark.read.parquet(str(tmp_path / "rows")), spec, [profile])
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and "Expand" not in plan
    assert report.first().by_rule == {"minCount": 10, "shapeDatatype": 10}


def test_vocabulary_terms_at_any_depth(spark):
    leaf = {"source": "leaf", "target": "qudt:unit", "datatype": "xsd:string"}
    for k in range(6, 0, -1):
        leaf = {"source": f"s{k}", "target": f"saref:t{k}", "nested_fields": [{"source": f"c{k}", "target": "geo:lat", "kind": "constant"}, leaf]}
    fields = [{"source": "s4", "target": "saref:early"}, leaf, {"source": "s2", "target": "saref:late", "kind": "iri"}, {"target": "sosa:x", "nested_fields": []}]
    texts = [("deep", json.dumps({"target_type": "sosa:Observation", "fields": fields})), ("flat", json.dumps({"target_type": "t:T", "fields": [{"source": "a", "target": "dct:title"}]})), ("none", None)]
    cat = spark.createDataFrame(texts, "dataset_id string, m string").select("dataset_id", F.from_json("m", MAPPING_SCHEMA).alias("ontology_mapping"))
    got = {(r.dataset_id, r.source): (r.term_id, r.term_type) for r in mapping.vocabulary_terms(cat).collect()}
    expected = {("deep", f"s{k}"): (f"saref:t{k}", None) for k in range(1, 7)}
    expected |= {("deep", "s2"): ("saref:late", "@id"), ("deep", "leaf"): ("qudt:unit", "xsd:string"), ("flat", "a"): ("dct:title", None)}
    assert got == expected


def test_tautology_fold_only_where_a_side_can_repeat(spark):
    cases = {
        "SELECT a FROM t WHERE a = b AND c = d": None, "SELECT a FROM t WHERE x == x": "warn", "SELECT a FROM t WHERE (x = x)": "warn",
        "SELECT a FROM t WHERE a = 1 OR lower(x) = lower(x)": "reject", "x = x": "warn", "= x": None, "x =": None,
        "SELECT a FROM t WHERE 'a=b' = 'a=b'": "warn", "SELECT a FROM t WHERE NOT f(a, 'q') = f(a, 'q') OR b": "reject",
    }
    df = spark.createDataFrame([(k,) for k in cases], "sql string").select("sql", screening.tautology_severity(F.col("sql")).alias("s"))
    assert {r.sql: r.s for r in df.collect()} == cases
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.find("arrays_overlap") < plan.find("aggregate(")
