"""Governed datasets derived from the plain analytics tables.

Documents play a large catalogue, events a request log and point observations, customers a
pointer table, suppliers an asset registry. Each derivation exists twice: as DataFrame code
and as the SQL common table expressions the oracles use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wardline.plans.registry import Tables
from wardline.sources.schema import CATALOGUE

BASE_URI = "https://data.example.org/dataset"
CATALOG_URI = "https://data.example.org/catalog"
API_BASE = "https://data.example.org/api"

OBSERVATION_SPEC = {
    "version": "1",
    "target_type": "sosa:Observation",
    "id_template": "https://data.example.org/obs/{event_id}",
    "profile": {"name": "observations", "version": "v2.0"},
    "fields": [
        {"source": "ts", "target": "sosa:resultTime", "datatype": "xsd:dateTime", "required": True},
        {"source": "value", "target": "sosa:hasSimpleResult", "datatype": "xsd:decimal"},
        {"source": "sensor", "target": "sosa:madeBySensor", "kind": "iri"},
        {"source": "event_type", "target": "rdfs:label", "required": True},
        {"target": "sosa:observedProperty", "kind": "constant", "value": "https://data.example.org/prop/{site}"},
    ],
}
OBSERVATION_CONTEXT = {"site": "north"}


def _when(*cases: tuple[Column, object], otherwise: object = None) -> Column:
    expr = F.lit(otherwise) if not isinstance(otherwise, Column) else otherwise
    for condition, value in reversed(cases):
        expr = F.when(condition, value if isinstance(value, Column) else F.lit(value)).otherwise(expr)
    return expr


# --- catalogue ----------------------------------------------------------------------


def catalogue(t: Tables) -> DataFrame:
    """One entry per document, with the columns of the catalogue schema plus ``doc_id``."""
    if "catalogue" not in t.__dict__:
        t.__dict__["catalogue"] = _catalogue(t)
    return t.__dict__["catalogue"]


def _catalogue(t: Tables) -> DataFrame:
    d, lab = t.documents, t.labels
    lang, n, src, doc = F.col("lang"), F.col("n_chars"), F.col("source"), F.col("doc_id")
    q, tox = F.col("quality") == 1, F.col("toxic") == 1
    labelled = F.col("quality").isNotNull()
    med = _when((n >= 2000, "gold"), (n >= 500, "silver"), otherwise="bronze")
    text = lambda v: F.lit(v).cast("string")
    base = d.join(lab, "doc_id", "left").withColumns(
        {"med": med, "dataset_id": F.concat(F.lit("datasets.ds_"), lang, F.lit("_"), med, F.lit(".t_"), doc)}
    )
    table = F.when((lang == "en") & (n >= 50), F.concat(F.lit("ds_en_"), F.col("med"), F.lit(".t_"), doc))
    path = F.when(lang.isin("fr", "de"), F.concat(F.lit("s3://lake/"), src, F.lit("/"), doc))
    level = _when((tox, "secret"), (q, "open"), (labelled | (lang == "de"), "restricted"), (n < 500, text(None)), otherwise="internal")
    pointer = F.struct(
        F.lit("table_pointer").alias("handler"),
        F.create_map(
            F.lit("column"), F.lit("o_custkey"), F.lit("pointer_table"), src, F.lit("pointer_key_column"), F.lit("c_custkey")
        ).alias("args"),
    )
    listed = F.struct(
        F.lit("http_in_list").alias("handler"), F.create_map(F.lit("column"), F.lit("device_id"), F.lit("list_table"), src).alias("args")
    )
    governance = F.struct(
        F.when(lang == "fr", F.array(pointer, listed)).alias("rowFilters"),
        F.when(lang == "de", F.array(listed)).alias("row_filters"),
        F.when(lang == "es", F.lit("user_id")).alias("userFilterColumn"),
        F.when((lang == "de") & (n >= 2000), F.lit("member_id")).alias("user_filter_column"),
        F.when(labelled, F.col("quality") == 0).alias("consentRequired"),
        F.when(q, F.lit("curated")).alias("medallion"),
    )
    fields = [
        F.struct(*[F.lit(f.get(k)).alias(k) for k in ("source", "target", "kind", "datatype", "required", "value")])
        for f in OBSERVATION_SPEC["fields"]
    ]
    # One more column, on the third level.
    nested = '"fields":[{"nested_fields":[{"nested_fields":[{"source":"note","target":"rdfs:comment"}]}]},'
    stated = F.to_json(
        F.struct(
            F.lit("1").alias("version"),
            _when((n >= 2000, "sosa:Observation"), otherwise="schema:Dataset").alias("target_type"),
            F.lit(OBSERVATION_SPEC["id_template"]).alias("id_template"),
            F.array(*fields).alias("fields"),
        )
    )
    mapping = F.when(lang == "en", F.replace(stated, F.lit('"fields":['), F.lit(nested)))
    columns = {
        "title": F.concat_ws(" ", src, lang, "med"),
        "description": F.col("text"),
        "backend_type": _when((lang == "fr", "s3"), (lang == "de", "fs"), (lang == "es", "context_broker"), otherwise="postgres"),
        "backend_config": F.struct(
            table.alias("table"),
            path.alias("path"),
            F.when(path.isNotNull(), F.lit("parquet")).alias("format"),
            F.when(q, F.concat(F.lit("https://data.example.org/file/"), doc)).alias("public_url"),
            n.alias("size_bytes"),
            *[text(None).alias(k) for k in ("base_url", "fiware_service", "fiware_service_path", "entity_type")],
        ),
        "ontology_path": F.when(lang == "en", F.lit("observations")),
        "ontology_mapping": F.from_json(mapping, _type_of("ontology_mapping")),
        "schema_override_path": text(None),
        "expose": F.coalesce(q, n >= 300),
        "dataspace_expose": F.coalesce(q & ~tox, lang == "es"),
        "tags": F.struct(
            F.array(F.upper(lang), src, F.col("med")).alias("keywords"),
            F.when(lang == "fr", F.array(F.concat(F.lit("https://data.example.org/theme/"), F.col("med")))).alias("themes"),
            text(None).alias("accrualPeriodicity"),
            F.col("med").alias("accessRights"),
            F.when(lang == "fr", F.struct(F.lit("2024-01-01").alias("start"), text(None).alias("end"))).alias("temporal"),
            F.when(lang == "de", F.struct(src.alias("fn"), F.concat(src, F.lit("@example.org")).alias("email"))).alias("contactPoint"),
            text(None).alias("identifier"),
            F.when(lang == "en", F.lit("https://saref.etsi.org/core/")).alias("conformsTo"),
        ),
        "publisher_uri": F.when(lang == "en", F.concat(F.lit("https://"), src, F.lit(".example.org"))),
        "rights_holder_uri": F.concat(F.lit("urn:owner:"), src),
        "license_uri": F.when(F.lower("text").contains("license"), F.lit("https://creativecommons.org/licenses/by/4.0/")),
        "landing_page": F.when(q, F.concat(F.lit("https://data.example.org/page/"), doc)),
        "language_uris": F.array(F.concat(F.lit("https://data.example.org/language/"), F.upper(lang))),
        "spatial_uris": F.array().cast("array<string>"),
        "lineage": F.struct(
            _when((lang == "es", text(None)), (lang == "de", ""), otherwise=src).alias("namespace"),
            F.col("dataset_id").alias("name"),
            *[text(None).alias(k) for k in ("sourceName", "createdAt", "updatedAt", "lastLifecycleState")],
            F.array().cast("array<string>").alias("tags"),
            F.struct(governance.alias("governance")).alias("facets"),
        ),
        "access_level": level,
    }
    names = [c.strip().split(" ")[0] for c in _split_columns(CATALOGUE)]
    return base.select("doc_id", *[columns[c].alias(c) if c in columns else F.col(c) for c in names])


def _split_columns(ddl: str) -> list[str]:
    parts, depth, start = [], 0, 0
    for i, ch in enumerate(ddl):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            parts.append(ddl[start:i])
            start = i + 1
    return [*parts, ddl[start:]]


def _type_of(column: str) -> str:
    for part in _split_columns(CATALOGUE):
        name, _, kind = part.strip().partition(" ")
        if name == column:
            return kind
    raise KeyError(column)


CAT = """
docs AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic,
         CASE WHEN d.n_chars >= 2000 THEN 'gold' WHEN d.n_chars >= 500 THEN 'silver' ELSE 'bronze' END AS med
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
cat AS (
  SELECT doc_id, lang, source, n_chars, quality, toxic, med, text AS description,
         'datasets.ds_' || lang || '_' || med || '.t_' || CAST(doc_id AS VARCHAR) AS dataset_id,
         source || ' ' || lang || ' ' || med AS title,
         CASE lang WHEN 'fr' THEN 's3' WHEN 'de' THEN 'fs' WHEN 'es' THEN 'context_broker' ELSE 'postgres' END AS backend_type,
         CASE WHEN lang = 'en' AND n_chars >= 50 THEN 'ds_en_' || med || '.t_' || CAST(doc_id AS VARCHAR) END AS tbl,
         CASE WHEN lang IN ('fr', 'de') THEN 's3://lake/' || source || '/' || CAST(doc_id AS VARCHAR) END AS path,
         CASE WHEN toxic = 1 THEN 'secret' WHEN quality = 1 THEN 'open'
              WHEN quality IS NOT NULL OR lang = 'de' THEN 'restricted'
              WHEN n_chars < 500 THEN NULL ELSE 'internal' END AS access_level,
         COALESCE(quality = 1, n_chars >= 300) AS expose,
         COALESCE(quality = 1 AND NOT toxic = 1, lang = 'es') AS dataspace_expose,
         CASE WHEN lang = 'es' THEN NULL WHEN lang = 'de' THEN '' ELSE source END AS namespace,
         CASE WHEN quality = 1 THEN 'curated' END AS facet_medallion,
         CASE WHEN lang = 'en' THEN 'https://' || source || '.example.org' END AS publisher_uri,
         'urn:owner:' || source AS rights_holder_uri,
         CASE WHEN contains(lower(text), 'license') THEN 'https://creativecommons.org/licenses/by/4.0/' END AS license_uri
  FROM docs)
"""


# --- request log --------------------------------------------------------------------


def requests(t: Tables, cat: DataFrame | None = None) -> DataFrame:
    """Two dataset references per event; the subject comes from the event's user and value."""
    cat = catalogue(t) if cat is None else cat
    e = t.events
    k = F.regexp_extract("props", r"(\d+)", 1).cast("bigint")
    kind, value, user = F.col("event_type"), F.col("value"), F.col("user_id")
    scopes = _when(
        (k % 3 == 0, F.array(F.lit("dataset.query"))),
        (k % 3 == 1, F.array(F.lit("dataset.admin"))),
        otherwise=F.array(F.lit("other.admin"), F.lit("dataset.write")),
    )
    groups = _when(
        (user % 4 == 0, F.array(F.lit("admins"), F.lit("viewers"))),
        (user % 4 == 1, F.array(F.lit("managers"))),
        (user % 4 == 2, F.array(F.lit("viewers"))),
        otherwise=F.array().cast("array<string>"),
    )
    log = e.select(
        F.col("event_id").alias("request_id"),
        user.alias("user_id"),
        value.alias("value"),
        _when((kind == "signup", "anonymous"), (value >= 50, "service"), otherwise="user").alias("subject_type"),
        groups.alias("groups"),
        scopes.alias("scopes"),
        _when((kind == "click", "query"), (kind == "purchase", "write"), (kind == "error", "delete"), otherwise="read").alias("action"),
        (value < 10).alias("under_agreement"),
        F.explode(F.array_distinct(F.array(k, user))).alias("doc_id"),
    )
    named = log.join(cat.select("doc_id", "dataset_id"), "doc_id", "left")
    unknown = F.concat(F.lit("datasets.unknown.t_"), F.col("doc_id"))
    return named.withColumn(
        "dataset_id", F.when((F.col("action") == "delete") & (F.col("value") < 20) & (F.col("doc_id") % 2 == 0), unknown).otherwise(F.col("dataset_id"))
    )


REQ = """
ev AS (
  SELECT event_id AS request_id, user_id, value, ts, event_type, CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS k FROM events),
req0 AS (
  SELECT request_id, user_id, value, k,
         CASE WHEN event_type = 'signup' THEN 'anonymous' WHEN value >= 50 THEN 'service' ELSE 'user' END AS subject_type,
         CASE event_type WHEN 'click' THEN 'query' WHEN 'purchase' THEN 'write' WHEN 'error' THEN 'delete' ELSE 'read' END AS action,
         value < 10 AS under_agreement, d.doc_id
  FROM ev, LATERAL (SELECT k AS doc_id UNION SELECT user_id) d),
req AS (
  SELECT r.*, CASE WHEN r.action = 'delete' AND r.value < 20 AND r.doc_id % 2 = 0 THEN 'datasets.unknown.t_' || CAST(r.doc_id AS VARCHAR) ELSE c.dataset_id END AS dataset_id,
         r.user_id % 4 = 0 AS is_admin, r.user_id % 4 = 1 AS is_manager, r.user_id % 4 IN (0, 2) AS is_viewer,
         CASE r.action WHEN 'write' THEN 'dataset.write' WHEN 'delete' THEN 'dataset.admin' ELSE 'dataset.query' END AS want
  FROM req0 r LEFT JOIN cat c ON r.doc_id = c.doc_id),
judged AS (
  SELECT r.*, c.access_level, c.expose, c.dataspace_expose, c.dataset_id IS NOT NULL AS known,
         (c.tbl IS NOT NULL OR c.path IS NOT NULL) AS has_table,
         COALESCE(c.access_level, 'open') AS lvl,
         CASE WHEN r.k % 3 = 1 THEN TRUE WHEN r.k % 3 = 0 THEN r.want = 'dataset.query' ELSE r.want = 'dataset.write' END AS scoped,
         r.k % 3 = 1 AS admin_scope,
         r.action IN ('read', 'query') AS reading
  FROM req r LEFT JOIN cat c ON r.dataset_id = c.dataset_id),
permitted AS (
  SELECT *, CASE
    WHEN lvl = 'open' THEN reading OR (subject_type = 'service' AND scoped)
    WHEN lvl = 'restricted' THEN (subject_type = 'service' AND admin_scope) OR (subject_type = 'user' AND is_admin)
    ELSE (subject_type = 'service' AND scoped) OR (subject_type = 'user' AND (is_admin OR ((is_manager OR is_viewer) AND reading)))
    END AS permit FROM judged),
verdicts AS (
  SELECT *, CASE
    WHEN NOT known THEN 'unknown_dataset'
    WHEN under_agreement AND NOT dataspace_expose THEN 'not_offered'
    WHEN NOT expose THEN 'not_exposed'
    WHEN NOT has_table THEN 'no_table'
    WHEN under_agreement THEN 'allow'
    WHEN lvl NOT IN ('open', 'internal', 'restricted') THEN 'invalid_level'
    WHEN lvl <> 'open' AND subject_type = 'anonymous' THEN 'login_required'
    WHEN permit THEN 'allow' ELSE 'denied' END AS verdict FROM permitted),
decided AS (
  SELECT *, verdict = 'allow' AS allowed,
    CASE verdict WHEN 'allow' THEN 200 WHEN 'unknown_dataset' THEN 400 WHEN 'login_required' THEN 401 WHEN 'invalid_level' THEN 500 ELSE 403 END AS status,
    CASE WHEN verdict NOT IN ('allow', 'denied') OR under_agreement THEN NULL
      WHEN permit AND lvl = 'open' AND reading THEN 'open dataset access granted'
      WHEN permit AND lvl = 'restricted' AND subject_type = 'service' THEN 'restricted dataset - admin scope granted'
      WHEN permit AND lvl = 'restricted' THEN 'restricted dataset - admin group granted'
      WHEN permit AND lvl = 'internal' AND subject_type = 'service' THEN 'internal dataset - scope granted'
      WHEN permit AND lvl = 'internal' AND is_admin THEN 'internal dataset - admin group granted'
      WHEN permit AND lvl = 'internal' AND is_manager THEN 'internal dataset - manager group granted'
      WHEN permit AND lvl = 'internal' AND is_viewer THEN 'internal dataset - viewer group granted'
      WHEN permit THEN 'unauthorized'
      WHEN subject_type = 'anonymous' THEN 'anonymous access denied'
      WHEN lvl = 'restricted' THEN 'restricted dataset requires admin scope or group'
      WHEN lvl = 'internal' AND subject_type = 'service' THEN 'missing required scope'
      WHEN lvl = 'internal' AND subject_type = 'user' THEN 'user not in authorized group'
      ELSE 'unauthorized' END AS reason
  FROM verdicts)
"""


def with_cat(select: str) -> str:
    return f"WITH {CAT} {select}"


def with_requests(select: str) -> str:
    return f"WITH {CAT}, {REQ} {select}"


# --- other roles --------------------------------------------------------------------


def pointer(t: Tables) -> DataFrame:
    """Which customer keys a subject (a nation) owns."""
    return t.customer.select("c_custkey", F.col("c_nationkey").cast("string").alias("owner"))


def assets(t: Tables) -> DataFrame:
    """Devices and their owners; suppliers in debt have no sensor."""
    return t.supplier.select(
        F.when(F.col("s_acctbal") >= 0, F.col("s_suppkey").cast("string")).alias("sensor_id"),
        F.col("s_nationkey").cast("string").alias("owner_user_id"),
    )


def observations(t: Tables) -> DataFrame:
    """Events as observation rows: ISO time text, text value, sensor IRI."""
    return t.events.select(
        "event_id",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"),
        F.when(F.col("value") >= 1, F.col("value").cast("string")).otherwise(F.concat(F.lit("<"), F.col("value").cast("string"))).alias("value"),
        F.concat(F.lit("https://data.example.org/sensor/"), "user_id").alias("sensor"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("event_type"),
    )


OBS = """
obs AS (
  SELECT event_id, 'https://data.example.org/obs/' || CAST(event_id AS VARCHAR) AS s,
         strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts,
         CASE WHEN value >= 1 THEN CAST(value AS VARCHAR) ELSE '<' || CAST(value AS VARCHAR) END AS value,
         'https://data.example.org/sensor/' || CAST(user_id AS VARCHAR) AS sensor,
         CASE WHEN event_type <> 'error' THEN event_type END AS event_type
  FROM events)
"""
