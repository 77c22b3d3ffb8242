"""DCAT-AP linked-data records of catalogue entries, one JSON document per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wardline.operators.catalogue import medallion

# JSON-LD context, access-right authority terms, offer terms.
CONTEXT = {
    "@vocab": "http://www.w3.org/ns/dcat#",
    "dcat": "http://www.w3.org/ns/dcat#",
    "dct": "http://purl.org/dc/terms/",
    "foaf": "http://xmlns.com/foaf/0.1/",
    "prov": "http://www.w3.org/ns/prov#",
    "adms": "http://www.w3.org/ns/adms#",
    "owl": "http://www.w3.org/2002/07/owl#",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
    "vcard": "http://www.w3.org/2006/vcard/ns#",
    "odrl": "http://www.w3.org/ns/odrl/2/",
    "skos": "http://www.w3.org/2004/02/skos/core#",
    "schema": "https://schema.org/",
}
#: Namespace of the dataspace's own terms (prefix ``ds``); a deployment passes its own.
DATASPACE = "urn:dataspace:terms#"
ACCESS_RIGHTS = {
    "open": "http://publications.europa.eu/resource/authority/access-right/PUBLIC",
    "internal": "http://publications.europa.eu/resource/authority/access-right/RESTRICTED",
    "restricted": "http://publications.europa.eu/resource/authority/access-right/NON_PUBLIC",
}
ACCESS_SCOPE = "ds:accessScope"
QUERY_SCOPE = "dataspaces.query"
CONSENT_STATUS = "ds:consentStatus"
CONSENT_ACTIVE = "active"


def _blank(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _ref(uri: Column) -> Column:
    """``{"@id": uri}``, or NULL."""
    return F.when(_blank(uri).isNotNull(), F.struct(uri.alias("@id")))


def _refs(uris: Column) -> Column:
    return F.when(F.size(uris) > 0, F.transform(uris, lambda u: F.struct(u.alias("@id"))))


def level_or_internal(level: Column) -> Column:
    return F.coalesce(_blank(level), F.lit("internal"))


def access_right_uri(level: Column) -> Column:
    uri = F.lit(None).cast("string")
    for name, value in ACCESS_RIGHTS.items():
        uri = F.when(level == name, F.lit(value)).otherwise(uri)
    return uri


def iso_date(value: Column) -> Column:
    """Date part of an ISO timestamp; text that is not one stays as it is."""
    day = value.try_cast("timestamp_ntz").cast("date").cast("string")
    parsed = F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$"), day)
    return F.coalesce(parsed, value)


def offer_constraints(level: Column, has_row_filters: Column, consent: Column) -> Column:
    """Constraint list of an offer as ``(operand, value)`` structs; empty when open and unfiltered."""
    lvl = level_or_internal(level)
    constraint = lambda left, right: F.struct(
        F.struct(F.lit(left).alias("@id")).alias("odrl:leftOperand"),
        F.struct(F.lit("odrl:eq").alias("@id")).alias("odrl:operator"),
        F.lit(right).alias("odrl:rightOperand"),
    )
    needs_consent = (lvl == "restricted") | F.coalesce(has_row_filters, F.lit(False)) | F.coalesce(consent, F.lit(False))
    return F.array_compact(
        F.array(
            F.when(lvl.isin("internal", "restricted"), constraint(ACCESS_SCOPE, QUERY_SCOPE)),
            F.when(needs_consent, constraint(CONSENT_STATUS, CONSENT_ACTIVE)),
        )
    )


def offer(entry_uri: Column, constraints: Column) -> Column:
    permission = F.struct(
        F.lit("odrl:Permission").alias("@type"),
        F.struct(F.lit("odrl:use").alias("@id")).alias("odrl:action"),
        F.when(F.size(constraints) > 0, constraints).alias("odrl:constraint"),
    )
    return F.struct(
        F.concat(entry_uri, F.lit("#offer")).alias("@id"),
        F.lit("odrl:Offer").alias("@type"),
        F.array(permission).alias("odrl:permission"),
    )


def agent_columns(df: DataFrame, owners: DataFrame, uri: str, output: str) -> DataFrame:
    """Agent node of a URI column: name, home page and types when an owner has that DID or URL."""
    base = "foaf:Organization"
    listed = owners.select("id", "type", "name", "url", F.explode(F.array_compact(F.array("did", "url"))).alias("__uri"))
    index = listed.groupBy("__uri").agg(F.min_by(F.struct("type", "name", "url"), "id").alias("__owner"))
    joined = df.join(index, F.col(uri) == F.col("__uri"), "left")
    o = F.col("__owner")
    kinds = F.array_distinct(F.array_compact(F.array(F.lit(base), _blank(o["type"]))))
    node = F.struct(
        F.col(uri).alias("@id"),
        F.when(o.isNotNull(), kinds).alias("@type"),
        _blank(o["name"]).alias("foaf:name"),
        _ref(o["url"]).alias("foaf:homepage"),
    )
    return joined.withColumn(output, F.when(F.col(uri).isNotNull(), node)).drop("__uri", "__owner")


def dataset_nodes(
    catalogue: DataFrame, owners: DataFrame, base_uri: str, catalog_uri: str, api_base: str
) -> DataFrame:
    """``(dataset_id, node)``: a dataset with its distribution and offer as nested structs."""
    prefix, api = base_uri.rstrip("/") + "/", api_base.rstrip("/")
    ready = catalogue.withColumns(
        {
            "__publisher": F.coalesce(_blank(F.col("publisher_uri")), F.lit(catalog_uri)),
            "__holder": _blank(F.col("rights_holder_uri")),
        }
    )
    ready = agent_columns(ready, owners, "__publisher", "__publisher_node")
    ready = agent_columns(ready, owners, "__holder", "__holder_node")
    uri = F.concat(F.lit(prefix), F.col("dataset_id"))
    gov, tags, backend = F.col("lineage.facets.governance"), F.col("tags"), F.col("backend_config")
    lvl = level_or_internal(F.col("access_level"))
    title = F.coalesce(_blank(F.col("title")), F.col("dataset_id"))
    constraints = offer_constraints(F.col("access_level"), F.size(gov["rowFilters"]) > 0, gov["consentRequired"])
    distribution = F.struct(
        F.concat(uri, F.lit("#distribution")).alias("@id"),
        F.lit("dcat:Distribution").alias("@type"),
        title.alias("dct:title"),
        F.col("dataset_id").alias("dct:identifier"),
        F.lit("application/json").alias("dcat:mediaType"),
        F.struct(F.lit(f"{api}/query").alias("@id")).alias("dcat:accessURL"),
        F.struct(F.lit(f"{catalog_uri}/service").alias("@id")).alias("dcat:accessService"),
        offer(uri, constraints).alias("odrl:hasPolicy"),
        _ref(access_right_uri(lvl)).alias("dct:accessRights"),
        _ref(F.col("license_uri")).alias("dct:license"),
        F.col("__holder_node").alias("dct:rightsHolder"),
        F.when(F.size(tags["keywords"]) > 0, tags["keywords"]).alias("dcat:keyword"),
        backend["size_bytes"].alias("dcat:byteSize"),
        F.when(lvl == "open", _ref(backend["public_url"])).alias("dcat:downloadURL"),
    )
    start, end = _blank(tags["temporal"]["start"]), _blank(tags["temporal"]["end"])
    period = F.struct(start.alias("dcat:startDate"), end.alias("dcat:endDate"))
    contact = F.struct(
        F.lit("vcard:Kind").alias("@type"),
        _blank(tags["contactPoint"]["fn"]).alias("vcard:fn"),
        _blank(tags["contactPoint"]["email"]).alias("vcard:hasEmail"),
    )
    namespace = _blank(F.col("lineage.namespace"))
    node = F.struct(
        uri.alias("@id"),
        F.lit("dcat:Dataset").alias("@type"),
        title.alias("dct:title"),
        F.col("dataset_id").alias("dct:identifier"),
        F.array(distribution).alias("dcat:distribution"),
        _blank(F.col("description")).alias("dct:description"),
        _ref(F.concat(F.lit(prefix), namespace)).alias("dct:isPartOf"),
        F.col("__publisher_node").alias("dct:publisher"),
        _ref(F.col("landing_page")).alias("dcat:landingPage"),
        _refs(F.col("language_uris")).alias("dct:language"),
        _refs(F.col("spatial_uris")).alias("dct:spatial"),
        _refs(tags["themes"]).alias("dcat:theme"),
        _ref(tags["accrualPeriodicity"]).alias("dct:accrualPeriodicity"),
        _ref(tags["conformsTo"]).alias("dct:conformsTo"),
        F.when(start.isNotNull() | end.isNotNull(), period).alias("dct:temporal"),
        F.when(tags["contactPoint"].isNotNull(), contact).alias("dcat:contactPoint"),
        medallion(gov["medallion"], F.coalesce(_blank(F.col("lineage.name")), F.col("dataset_id"))).alias("ds:medallion"),
    )
    return ready.select("dataset_id", node.alias("node"))


def context(dataspace: str = DATASPACE) -> Column:
    """The ``@context`` of every document."""
    return F.struct(*[F.lit(v).alias(k) for k, v in {**CONTEXT, "ds": dataspace}.items()])


def dataset_documents(nodes: DataFrame, dataspace: str = DATASPACE) -> DataFrame:
    """``(dataset_id, document)``: each dataset as a JSON-LD document of its own, with its context."""
    return nodes.select("dataset_id", F.to_json(F.struct(context(dataspace).alias("@context"), "node.*")).alias("document"))


def catalog_rows(
    nodes: DataFrame, title: str, catalog_uri: str, api_base: str, dataspace: str = DATASPACE
) -> DataFrame:
    """The catalogue as JSON lines ``(part, id, document)``.

    Header and service are one row each; served datasets are one link row each, so no list
    grows with the catalogue.
    """
    api = api_base.rstrip("/")
    service = f"{catalog_uri}/service"
    first = nodes.sparkSession.range(1)
    header = first.select(
        F.lit("catalog").alias("part"),
        F.lit(catalog_uri).alias("id"),
        F.to_json(
            F.struct(
                context(dataspace).alias("@context"),
                F.lit(catalog_uri).alias("@id"),
                F.lit("dcat:Catalog").alias("@type"),
                F.lit(title).alias("dct:title"),
                F.current_date().cast("string").alias("dct:issued"),
            )
        ).alias("document"),
    )
    service_row = first.select(
        F.lit("service").alias("part"),
        F.lit(service).alias("id"),
        F.to_json(
            F.struct(
                F.lit(service).alias("@id"),
                F.lit("dcat:DataService").alias("@type"),
                F.lit(f"{title} Query Service").alias("dct:title"),
                F.struct(F.lit(f"{api}/query").alias("@id")).alias("dcat:endpointURL"),
            )
        ).alias("document"),
    )
    kinds = F.array(
        F.struct(
            F.lit("serves").alias("part"),
            F.to_json(
                F.struct(
                    F.lit(service).alias("@id"),
                    F.struct(F.col("node")["@id"].alias("@id")).alias("dcat:servesDataset"),
                )
            ).alias("document"),
        ),
        F.struct(F.lit("dataset").alias("part"), F.to_json("node").alias("document")),
    )
    rows = nodes.select("dataset_id", F.explode(kinds).alias("k")).select(
        "k.part", F.col("dataset_id").alias("id"), "k.document"
    )
    return header.unionByName(service_row).unionByName(rows)


def catalog(
    catalogue: DataFrame,
    owners: DataFrame,
    title: str,
    base_uri: str,
    catalog_uri: str,
    api_base: str,
    dataspace: str = DATASPACE,
) -> DataFrame:
    """JSON lines of the whole catalogue; secret entries are left out."""
    open_entries = catalogue.filter(F.col("access_level").isNull() | (F.col("access_level") != "secret"))
    nodes = dataset_nodes(open_entries, owners, base_uri, catalog_uri, api_base)
    return catalog_rows(nodes, title, catalog_uri, api_base, dataspace)
