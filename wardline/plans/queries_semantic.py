"""Registered queries: vocabulary, triples, shape checks, query-log screening."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from wardline.operators import conformance as conf, mapping, rules as rule_ops, screening
from wardline.operators.conformance import Profile, Shape
from wardline.operators.mapping import PREFIXES, RDF_TYPE
from wardline.plans import testbed as tb
from wardline.plans.registry import Tables, query

SOSA, XSD = PREFIXES["sosa"], PREFIXES["xsd"]

PROFILES = (
    Profile("observations", "v1.9", (Shape("sosa:Observation", "sosa:resultTime", min_count=1),)),
    Profile(
        "observations",
        "v2.0",
        (
            Shape("sosa:Observation", "sosa:resultTime", min_count=1),
            Shape("sosa:Observation", "rdfs:label", min_count=1),
            Shape("sosa:Observation", "sosa:madeBySensor", object_class="sosa:Sensor"),
            Shape("sosa:Observation", "sosa:hasSimpleResult", datatype="xsd:decimal"),
        ),
    ),
)


# --- vocabulary ---------------------------------------------------------------------

_TERMS = """terms AS (
  SELECT dataset_id, source, term_id, term_type, med FROM cat, (VALUES
    ('ts', 'sosa:resultTime', 'xsd:dateTime'), ('value', 'sosa:hasSimpleResult', 'xsd:decimal'),
    ('sensor', 'sosa:madeBySensor', '@id'), ('event_type', 'rdfs:label', NULL),
    ('note', 'rdfs:comment', NULL)) v(source_, term_id, term_type)
  WHERE lang = 'en')""".replace("SELECT dataset_id, source,", "SELECT dataset_id, source_ AS source,")


@query("vocab_terms", tb.with_cat(f", {_TERMS} SELECT dataset_id, source, term_id, term_type FROM terms"))
def vocab_terms(t: Tables) -> DataFrame:
    return mapping.vocabulary_terms(tb.catalogue(t))


@query(
    "vocab_prefixes",
    tb.with_cat(
        f"""SELECT dataset_id, prefix, ns AS namespace FROM cat, (VALUES ('sosa', '{SOSA}'), ('xsd', '{XSD}'), ('rdfs', '{PREFIXES["rdfs"]}'),
              ('schema', '{PREFIXES["schema"]}')) v(prefix, ns) WHERE lang = 'en' AND (prefix <> 'schema' OR med <> 'gold')"""
    ),
)
def vocab_prefixes(t: Tables) -> DataFrame:
    cat = tb.catalogue(t)
    return mapping.vocabulary_prefixes(cat, mapping.prefix_table(cat))


@query("vocab_unknown_prefixes", tb.with_cat("SELECT dataset_id, 'schema' AS prefix FROM cat WHERE lang = 'en' AND med <> 'gold'"))
def vocab_unknown_prefixes(t: Tables) -> DataFrame:
    cat = tb.catalogue(t)
    known = {k: v for k, v in PREFIXES.items() if k != "schema"}
    return mapping.unknown_prefixes(cat, mapping.prefix_table(cat, known))


@query(
    "vocab_document",
    tb.with_cat(
        f"""SELECT dataset_id, CASE WHEN med = 'gold' THEN 'sosa:Observation' ELSE 'schema:Dataset' END AS type,
              'sosa:resultTime' AS ts_id, 'xsd:dateTime' AS ts_type, '@id' AS sensor_type, '{SOSA}' AS sosa, '{PREFIXES["dct"]}' AS dct,
              CASE WHEN med <> 'gold' THEN '{PREFIXES["schema"]}' END AS schema_ns, CAST(NULL AS VARCHAR) AS unused,
              'https://saref.etsi.org/core/' AS conforms_to FROM cat WHERE lang = 'en'"""
    ),
)
def vocab_document(t: Tables) -> DataFrame:
    cat = tb.catalogue(t)
    documents = mapping.vocabulary_documents(cat, mapping.prefix_table(cat))
    at = lambda *path: F.get_json_object("document", "$" + "".join(f"['{p}']" for p in path))
    return documents.select(
        "dataset_id",
        at("@type").alias("type"),
        at("@context", "ts", "@id").alias("ts_id"),
        at("@context", "ts", "@type").alias("ts_type"),
        at("@context", "sensor", "@type").alias("sensor_type"),
        at("@context", "sosa").alias("sosa"),
        at("@context", "dct").alias("dct"),
        at("@context", "schema").alias("schema_ns"),
        at("@context", "foaf").alias("unused"),
        at("dct:conformsTo", "@id").alias("conforms_to"),
    )


# --- triples and shapes -------------------------------------------------------------

_TRIPLES = f"""triples AS (
  SELECT s, '{RDF_TYPE}' AS p, '{SOSA}Observation' AS o, 'iri' AS o_kind, NULL AS datatype FROM obs
  UNION ALL SELECT s, '{SOSA}resultTime', ts, 'literal', '{XSD}dateTime' FROM obs
  UNION ALL SELECT s, '{SOSA}hasSimpleResult', value, 'literal', '{XSD}decimal' FROM obs
  UNION ALL SELECT s, '{SOSA}madeBySensor', sensor, 'iri', NULL FROM obs
  UNION ALL SELECT s, '{PREFIXES["rdfs"]}label', event_type, 'literal', NULL FROM obs WHERE event_type IS NOT NULL
  UNION ALL SELECT s, '{SOSA}observedProperty', 'https://data.example.org/prop/north', 'iri', NULL FROM obs)"""


def _triples(t: Tables, *only: str) -> DataFrame:
    """All statements of the observations, or those of the properties ``only`` and the types."""
    named = {RDF_TYPE, *map(mapping.expand, only)} if only else None
    return mapping.map_to_triples(tb.observations(t), tb.OBSERVATION_SPEC, tb.OBSERVATION_CONTEXT, only=named)


@query("map_to_triples", f"WITH {tb.OBS}, {_TRIPLES} SELECT s, p, o, o_kind, datatype FROM triples")
def map_to_triples(t: Tables) -> DataFrame:
    return _triples(t)


@query("map_required", f"WITH {tb.OBS} SELECT s AS subject, 'event_type' AS path, 'required' AS rule FROM obs WHERE event_type IS NULL")
def map_required(t: Tables) -> DataFrame:
    found = conf.required_violations(tb.observations(t), tb.OBSERVATION_SPEC, tb.OBSERVATION_CONTEXT)
    return found.select("subject", "path", "rule")


@query(
    "shape_min_count",
    f"WITH {tb.OBS} SELECT s AS subject, 'rdfs:label' AS path, 'minCount' AS rule FROM obs WHERE event_type IS NULL",
)
def shape_min_count(t: Tables) -> DataFrame:
    triples = _triples(t, *(s.path for s in PROFILES[1].shapes if s.min_count))
    return conf.min_count_violations(triples, PROFILES[1].shapes).select("subject", "path", "rule")


def _sensors(t: Tables) -> DataFrame:
    """Vocabulary: a user's sensor is known when the user is a customer with a positive balance."""
    iri = F.concat(F.lit("https://data.example.org/sensor/"), "c_custkey")
    return t.customer.filter(F.col("c_acctbal") > 0).select(iri.alias("iri"), F.lit(f"{SOSA}Sensor").alias("class"))


@query(
    "shape_class",
    f"""WITH {tb.OBS} SELECT s AS subject, 'sosa:madeBySensor' AS path, 'sosa:madeBySensor: not a known concept: ' || sensor AS message FROM obs
        WHERE sensor NOT IN (SELECT 'https://data.example.org/sensor/' || CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal > 0)""",
)
def shape_class(t: Tables) -> DataFrame:
    return conf.class_violations(_triples(t, "sosa:madeBySensor"), PROFILES[1].shapes, _sensors(t)).select("subject", "path", "message")


@query(
    "shape_datatype",
    f"""WITH {tb.OBS} SELECT s AS subject, '{SOSA}hasSimpleResult' AS path, value || ' is not a {XSD}decimal' AS message
        FROM obs WHERE NOT regexp_full_match(value, '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)')""",
)
def shape_datatype(t: Tables) -> DataFrame:
    return conf.datatype_violations(_triples(t), ["xsd:dateTime", "xsd:decimal"]).select("subject", "path", "message")


@query(
    "violations_cap",
    f"""WITH {tb.OBS}, v AS (SELECT s AS subject, 'rdfs:label: fewer than 1 values on ' || s AS message FROM obs WHERE event_type IS NULL)
        SELECT subject, message, (SELECT count(*) FROM v) AS total FROM v""",
)
def violations_cap(t: Tables) -> DataFrame:
    """All violations, none left out, each with their exact number."""
    found = conf.min_count_violations(_triples(t), PROFILES[1].shapes)
    return found.select("subject", "message", found.agg(F.count(F.lit(1))).scalar().alias("total"))


@query(
    "conformance_report",
    f"""WITH {tb.OBS}, known AS (SELECT 'https://data.example.org/sensor/' || CAST(c_custkey AS VARCHAR) AS iri FROM customer WHERE c_acctbal > 0),
          bad AS (SELECT s FROM obs WHERE NOT regexp_full_match(value, '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)')),
          v AS (SELECT s FROM obs WHERE event_type IS NULL UNION ALL SELECT s FROM obs WHERE event_type IS NULL
                UNION ALL SELECT s FROM obs WHERE sensor NOT IN (SELECT iri FROM known) UNION ALL SELECT s FROM bad UNION ALL SELECT s FROM bad)
        SELECT 'datasets.city.observations' AS dataset_id, count(*) = 0 AS conforms, (SELECT count(*) FROM obs) AS sample_size,
               count(*) AS n_violations, (SELECT count(*) FROM bad) AS of_shape_datatype, 'observations' AS profile_name,
               'v2.0' AS profile_version, TRUE AS profile_pinned FROM v""",
)
def conformance_report(t: Tables) -> DataFrame:
    found = conf.report(
        "datasets.city.observations", tb.observations(t), tb.OBSERVATION_SPEC, PROFILES, _sensors(t), tb.OBSERVATION_CONTEXT
    )
    # The time of the check differs between engines and is left out.
    return found.select(
        "dataset_id",
        "conforms",
        "sample_size",
        "n_violations",
        F.coalesce(F.col("by_rule")["shapeDatatype"], F.lit(0)).alias("of_shape_datatype"),
        "profile_name",
        "profile_version",
        "profile_pinned",
    )


@query(
    "resolve_mapping",
    tb.with_cat(
        """SELECT dataset_id, CASE WHEN lang = 'en' AND med = 'gold' THEN 'declares both ontology.spec and ontology.spec_file'
              WHEN lang = 'fr' AND source = 'src9' THEN 'ontology.spec_file does not resolve' WHEN lang = 'de' THEN 'ontology.spec is unknown' END AS error,
            CASE WHEN lang = 'en' AND med <> 'gold' THEN 'obs_' || med WHEN lang = 'fr' AND source <> 'src9' THEN './map.json' END AS path,
            CASE WHEN lang = 'en' AND med <> 'gold' THEN 'shared ' || med WHEN lang = 'fr' AND source <> 'src9' THEN 'local ' || source END AS mapping FROM cat"""
    ),
)
def resolve_mapping(t: Tables) -> DataFrame:
    cat = tb.catalogue(t)
    lang, source, med = (F.element_at("tags.keywords", i) for i in (1, 2, 3))
    rule = (
        F.when((lang == "EN") & (med == "gold"), F.create_map(F.lit("ontology.spec"), F.lit("a"), F.lit("ontology.spec_file"), F.lit("b")))
        .when(lang == "EN", F.create_map(F.lit("ontology.spec"), F.concat(F.lit("obs_"), med)))
        .when(lang == "FR", F.create_map(F.lit("ontology.spec_file"), F.lit("./map.json")))
        .when(lang == "DE", F.create_map(F.lit("ontology.spec"), F.lit("nowhere")))
        .otherwise(F.create_map().cast("map<string,string>"))
    )
    resolved = cat.select("dataset_id", source.alias("base"), rule.alias("rule"))
    shared = cat.select(F.concat(F.lit("obs_"), med).alias("name"), F.concat(F.lit("shared "), med).alias("mapping")).distinct()
    local = cat.filter(source != "src9").select(
        source.alias("base"), F.lit("./map.json").alias("path"), F.concat(F.lit("local "), source).alias("mapping")
    ).distinct()
    found = rule_ops.resolve_mappings(resolved, shared, local)
    return found.select(
        "dataset_id",
        F.col("ontology_error").alias("error"),
        F.col("ontology_path").alias("path"),
        F.col("ontology_mapping").alias("mapping"),
    )


# --- query log ----------------------------------------------------------------------

# Query texts with the event number appended: (text before the number, text after it, rules broken, warnings, tables).
TEMPLATES = [
    ("SELECT * FROM ds_dev.readings WHERE id = ", "", "", "", "ds_dev.readings"),
    ("  ", "", None, "", ""),
    ("SELECT a FROM t1; DROP TABLE x", "", "stacking,statement", "", "t1"),
    ("SELECT a FROM t1 -- note ", "", "comments", "", "t1"),
    ("DELETE FROM t1 WHERE id = ", ";", "statement", "", "t1"),
    ("SELECT pg_sleep(", ") FROM prod.energy.solar", "functions", "", "prod.energy.solar"),
    ("SELECT a FROM t1 WHERE b = 2 OR 1 = 1 AND c > ", "", "tautology", "", "t1"),
    ("SELECT city, count(*) FROM t1 WHERE 1 = 1 AND id < ", " GROUP BY city;", "", "tautology", "t1"),
    ("SELECT a FROM t1 ORDER BY a LIMIT ", "", "top_limit", "", "t1"),
    ("SELECT a FROM t1 UNION SELECT b FROM t2 WHERE c = ", "", "set_ops", "", "t1,t2"),
    (
        "WITH recent AS (SELECT * FROM a.b.readings WHERE extract(year FROM ts) = 2024 AND note <> 'union or drop'), "
        "tops AS (SELECT max(v) AS m FROM recent LIMIT 3) SELECT lower(r.name) FROM recent r JOIN sites s ON r.k = s.k, tops WHERE r.v > ",
        "",
        "",
        "",
        "a.b.readings,sites",
    ),
    ("SELECT a FROM t1, ns.t2 x, t3 WHERE EXISTS (SELECT 1 FROM t4 WHERE t4.a = t1.a AND t4.b = ", ")", "exists", "", "ns.t2,t1,t3,t4"),
]


# Predicates and connectives of further texts, which nest them in brackets; the event number picks which.
PREDICATES = (
    "a = b", "1 = 1", "lower(x) = lower(x)", "'q' = 'Q'", "a IN (1, 2)", "b > 2 AND c = c", "CASE WHEN x = x THEN 1 ELSE 2 END = 1",
)
CONNECTIVES = (" AND ", " OR ")
KINDS = len(TEMPLATES) + 1
NESTED = "{p0}{c0}({p1}{c1}({p2}{c2}note = '(or'))"
_STEPS = {"p0": (1, PREDICATES), "c0": (7, CONNECTIVES), "p1": (14, PREDICATES), "c1": (98, CONNECTIVES), "p2": (196, PREDICATES), "c2": (1372, CONNECTIVES)}


def _log(t: Tables) -> DataFrame:
    number = F.col("event_id").cast("string")
    texts = [F.concat(F.lit(a), number if a.strip() else F.lit(""), F.lit(b)) for a, b, *_ in TEMPLATES]
    parts = [F.lit("SELECT a FROM t1 WHERE ")]
    for piece in re.split(r"[{}]", NESTED):
        step, choices = _STEPS.get(piece, (1, (piece,)))
        picked = F.floor(F.col("event_id") / step) % len(choices)
        parts.append(F.get(F.array(*map(F.lit, choices)), picked.cast("int")))
    pick = (F.col("event_id") % KINDS).cast("int")
    return t.events.select("event_id", "user_id", F.get(F.array(*texts, F.concat(*parts)), pick).alias("sql"))


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _text_of_event() -> str:
    whens = " ".join(
        f"WHEN {i} THEN {_sql_text(a)} || {'CAST(event_id AS VARCHAR)' if a.strip() else _sql_text('')} || {_sql_text(b)}" for i, (a, b, *_) in enumerate(TEMPLATES)
    )
    parts = ["'SELECT a FROM t1 WHERE '"]
    for piece in re.split(r"[{}]", NESTED):
        step, choices = _STEPS.get(piece, (1, (piece,)))
        parts.append(f"[{', '.join(map(_sql_text, choices))}][event_id // {step} % {len(choices)} + 1]")
    return f"CASE event_id % {KINDS} {whens} ELSE {' || '.join(parts)} END"


_LOG = (
    "expected AS (SELECT * FROM (VALUES "
    + ", ".join(
        f"({i}, {_sql_text('empty' if reasons is None else reasons)}, {_sql_text(warnings)}, {_sql_text(tables)})"
        for i, (_, _, reasons, warnings, tables) in enumerate([*TEMPLATES, (None, None, "", "", "t1")])
    )
    + f") v(kind, reasons, warnings, tables)), log AS (SELECT e.event_id, e.user_id, v.* FROM events e JOIN expected v ON e.event_id % {KINDS} = v.kind)"
)

# The bracket rule stated on token pairs: an OR covers a predicate if no token between them closes the OR's bracket or ends
# its part of the clause.
_JUDGED = (
    _LOG
    + f""", texts AS (SELECT event_id, regexp_extract_all(rtrim({_text_of_event()}, ' ;'), {_sql_text(screening._TOKEN)}) AS toks FROM events),
    words AS (SELECT event_id, toks, unnest(toks) AS w, generate_subscripts(toks, 1) AS i FROM texts WHERE list_contains(toks, '=')),
    kinds AS (SELECT event_id, toks, i, CASE WHEN lower(w) = 'or' THEN 'or' WHEN lower(w) IN ('(', 'case') THEN 'open' WHEN lower(w) IN (')', 'end') THEN 'close'
            WHEN w = '=' THEN 'eq' WHEN lower(w) IN {screening._COMPARISONS} THEN 'cmp' WHEN lower(w) IN {screening._PREDICATE_ENDS} THEN 'pred'
            WHEN lower(w) IN {screening._PART_ENDS} THEN 'part' ELSE '' END AS k FROM words),
    depths AS (SELECT *, coalesce(sum(CAST(k = 'open' AS INT)) OVER before, 0) - sum(CAST(k = 'close' AS INT)) OVER upto AS depth FROM kinds
            WINDOW before AS (PARTITION BY event_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                   upto AS (PARTITION BY event_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
    sides AS (SELECT e.event_id, e.i, e.depth, any_value(e.toks) AS toks,
            coalesce(max(b.i) FILTER (b.i < e.i), 0) AS lo, coalesce(min(b.i) FILTER (b.i > e.i), any_value(len(e.toks)) + 1) AS hi
            FROM depths e LEFT JOIN depths b ON b.event_id = e.event_id AND b.i <> e.i
                AND (b.depth < e.depth OR b.depth = e.depth AND b.k IN ('or', 'eq', 'cmp', 'pred', 'part'))
            WHERE e.k = 'eq' GROUP BY ALL),
    equal AS (SELECT s.event_id, s.i, s.depth FROM sides s LEFT JOIN depths x ON x.event_id = s.event_id AND x.i = s.lo LEFT JOIN depths y ON y.event_id = s.event_id AND y.i = s.hi
            WHERE coalesce(x.k, '') NOT IN ('eq', 'cmp') AND coalesce(y.k, '') NOT IN ('eq', 'cmp') AND s.i - s.lo > 1
                AND s.toks[s.lo + 1 : s.i - 1] = s.toks[s.i + 1 : s.hi - 1]),
    covered AS (SELECT DISTINCT q.event_id FROM equal q JOIN depths o ON o.event_id = q.event_id AND o.k = 'or'
            WHERE NOT EXISTS (SELECT 1 FROM depths b WHERE b.event_id = q.event_id AND b.i BETWEEN least(o.i, q.i) AND greatest(o.i, q.i)
                AND (b.depth < o.depth OR b.depth = o.depth AND b.k = 'part'))),
    judged AS (SELECT l.* REPLACE (CASE WHEN l.event_id IN (SELECT event_id FROM covered) THEN 'tautology' WHEN l.reasons = 'tautology' THEN '' ELSE l.reasons END AS reasons,
            CASE WHEN l.event_id IN (SELECT event_id FROM equal) AND l.event_id NOT IN (SELECT event_id FROM covered) THEN 'tautology' ELSE '' END AS warnings) FROM log l)"""
)


def _flag(name: str) -> str:
    return f"WITH {_LOG} SELECT event_id, list_contains(string_split(reasons, ','), '{name}') AS flagged FROM log"


@query("screen_empty", _flag("empty"))
def screen_empty(t: Tables) -> DataFrame:
    return _log(t).select("event_id", screening.is_empty(F.col("sql")).alias("flagged"))


@query("screen_stacking", _flag("stacking"))
def screen_stacking(t: Tables) -> DataFrame:
    return _log(t).select("event_id", screening.is_stacked(F.col("sql")).alias("flagged"))


@query("screen_comments", _flag("comments"))
def screen_comments(t: Tables) -> DataFrame:
    return _log(t).select("event_id", screening.has_comment(F.col("sql")).alias("flagged"))


@query(
    "screen_statement",
    f"WITH {_LOG} SELECT event_id, list_contains(string_split(reasons, ','), 'statement') OR reasons = 'empty' AS flagged FROM log",
)
def screen_statement(t: Tables) -> DataFrame:
    return _log(t).select("event_id", screening.is_not_select(F.col("sql")).alias("flagged"))


@query(
    "screen_functions",
    f"WITH {_LOG} SELECT event_id, CASE WHEN reasons = 'functions' THEN 'pg_sleep' ELSE '' END AS unknown FROM log",
)
def screen_functions(t: Tables) -> DataFrame:
    return _log(t).select("event_id", F.array_join(screening.unknown_functions(F.col("sql")), ",").alias("unknown"))


@query(
    "screen_tautology",
    f"WITH {_JUDGED} SELECT event_id, CASE WHEN reasons = 'tautology' THEN 'reject' WHEN warnings = 'tautology' THEN 'warn' END AS severity FROM judged",
)
def screen_tautology(t: Tables) -> DataFrame:
    return _log(t).select("event_id", screening.tautology_severity(F.col("sql")).alias("severity"))


@query("screen_top_limit", _flag("top_limit"))
def screen_top_limit(t: Tables) -> DataFrame:
    return _log(t).select("event_id", screening.has_top_limit(F.col("sql")).alias("flagged"))


@query("screen_set_ops", _flag("set_ops"))
def screen_set_ops(t: Tables) -> DataFrame:
    return _log(t).select("event_id", screening.has_set_operation(F.col("sql")).alias("flagged"))


@query("extract_tables", f"WITH {_LOG} SELECT event_id, tables FROM log")
def extract_tables(t: Tables) -> DataFrame:
    return _log(t).select("event_id", F.array_join(screening.referenced_tables(F.col("sql")), ",").alias("tables"))


@query(
    "screen_report",
    f"""WITH {_JUDGED} SELECT event_id, reasons, warnings, tables, reasons = '' AS accepted FROM judged""",
)
def screen_report(t: Tables) -> DataFrame:
    screened = screening.screen(_log(t))
    return screened.select(
        "event_id",
        F.array_join("reasons", ",").alias("reasons"),
        F.array_join("warnings", ",").alias("warnings"),
        F.array_join("tables", ",").alias("tables"),
        "accepted",
    )


@query(
    "screen_totals",
    f"WITH {_JUDGED} SELECT unnest(string_split(reasons, ',')) AS rule, count(*) AS queries FROM judged WHERE reasons <> '' GROUP BY 1",
)
def screen_totals(t: Tables) -> DataFrame:
    return screening.rule_totals(screening.screen(_log(t)))
