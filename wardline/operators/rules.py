"""Governance rules: glob resolution, presence-aware overlay, owners, exposure gates, entries.

A rule is a ``MAP<path, value>`` over dotted paths. A path in the map was *stated*; a NULL
value is a stated null. Silence is the absence of the path, which nullable columns could
not express.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wardline.functions.globs import glob_regex, glob_tokens
from wardline.operators.catalogue import OBJECT_FORMAT, clean_id, physical_table, to_catalogue
from wardline.sources.schema import MAPPING, ROW_FILTER

TEXTS = "array<string>"


# --- glob matching ------------------------------------------------------------------


GRAM = 3
#: Stands where a pattern has a wildcard; no literal part of a pattern holds it.
_GAP = "\x00"


def _grams(text: Column, n: Column | int) -> Column:
    """The distinct pieces of ``n`` characters of a text, none if it is shorter."""
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: i + n - 1 <= F.length(text))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, n if isinstance(n, Column) else F.lit(n))))


def _pattern_keys(literal: Column) -> Column:
    """Keys ``(kind, n, gram)`` that all names matching a pattern have; ``literal`` is its text with gaps for wildcards.

    Pieces at the start (``p``), at the end (``s``) and anywhere (``t``), of three characters; shorter ones only if the
    pattern has none of three. Without any literal the only key is the empty piece, which all names have.
    """
    parts = F.split(literal, _GAP)
    first, last = F.get(parts, 0), F.element_at(parts, -1)
    key = lambda kind, gram: F.struct(F.lit(kind).alias("__kind"), F.length(gram).alias("__size"), gram.alias("__gram"))

    def keys(longest: bool) -> Column:
        fits = (lambda x: F.length(x) >= GRAM) if longest else (lambda x: F.length(x).between(1, GRAM - 1))
        pieces = F.flatten(F.transform(F.filter(parts, fits), lambda x: _grams(x, GRAM) if longest else F.array(x)))
        ends = F.array(F.when(fits(first), key("p", F.left(first, F.lit(GRAM)))), F.when(fits(last), key("s", F.right(last, F.lit(GRAM)))))
        return F.concat(F.array_compact(ends), F.transform(F.array_distinct(pieces), lambda x: key("t", x)))

    long, short, none = keys(True), keys(False), F.array(key("t", F.lit("")))
    return F.when(F.size(long) > 0, long).when(F.size(short) > 0, short).otherwise(none)


def _name_grams(name: Column, kind: Column, n: Column) -> Column:
    """The pieces of a name that keys of one kind and length can ask for."""
    end = lambda x: F.when(F.length(name) >= n, F.array(x)).otherwise(F.array().cast("array<string>"))
    return (
        F.when(n == 0, F.array(F.lit("")))
        .when(kind == "p", end(F.substring(name, F.lit(1), n)))
        .when(kind == "s", end(F.substring(name, F.length(name) - n + 1, n)))
        .otherwise(_grams(name, n))
    )


def _indexed_matches(listed: DataFrame, name: str, wild: DataFrame) -> DataFrame:
    """``(name, pattern)`` over an inverted index: each pattern is listed under the rarest of its keys among the names."""
    literal = F.array_join(
        F.transform(glob_tokens(F.col("pattern")), lambda t: F.when(t.isin("*", "?") | (F.length(t) > 1), _GAP).otherwise(t)), ""
    )
    options = wild.select("pattern", F.explode(_pattern_keys(literal)).alias("k")).select("pattern", "k.*")
    needed = options.agg(F.collect_set(F.struct("__kind", "__size"))).scalar()  # seven at most
    asked = listed.withColumn("__k", F.explode(needed)).select(name, "__k.*")
    keyed = asked.withColumn("__gram", F.explode(_name_grams(F.col(name), F.col("__kind"), F.col("__size"))))
    on = ["__kind", "__size", "__gram"]
    counts = keyed.join(options.select(*on).distinct(), on, "left_semi").groupBy(*on).agg(F.count(F.lit(1)).alias("__names"))
    rarest = options.join(counts, on).groupBy("pattern").agg(F.min_by(F.struct(*on), F.struct("__names", *on)).alias("k")).select("pattern", "k.*")
    entries = rarest.withColumn("__regex", glob_regex(F.col("pattern")))
    return keyed.join(entries, on).filter(F.rlike(F.col(name), F.col("__regex"))).select(name, "pattern")


def glob_matches(names: DataFrame, name: str, patterns: DataFrame, pattern: str) -> DataFrame:
    """``(name, pattern)`` for every row of ``names`` and every pattern of a table that matches it.

    Literal patterns meet the names in an equi join. For those with three characters or more before the first wildcard,
    that text must start the name: names are listed under those of their prefixes whose length occurs among these patterns
    and meet them in an equi join on that prefix. All others are found over an index of their rarest three characters (or
    fewer, if a pattern has no three in a row). Only the pairs so found run the regular expression.
    """
    listed = names.select(name)
    pats = (
        patterns.select(F.col(pattern).alias("pattern"))
        .distinct()
        .withColumn("__prefix", F.regexp_extract("pattern", r"^[^*?\[]*", 0))
    )
    literal = pats.filter(F.col("pattern") == F.col("__prefix")).select("pattern")
    wild = pats.filter(F.col("pattern") != F.col("__prefix"))
    started = wild.filter(F.length("__prefix") >= GRAM).withColumn("__regex", glob_regex(F.col("pattern")))
    lengths = started.agg(F.collect_set(F.length("__prefix"))).scalar()  # at most one entry per prefix length
    prefixed = (
        listed.withColumn("__n", F.explode(lengths))
        .filter(F.col("__n") <= F.length(name))
        .withColumn("__prefix", F.substring(F.col(name), F.lit(1), F.col("__n")))
    )
    by_prefix = (prefixed["__prefix"] == started["__prefix"]) & F.rlike(F.col(name), F.col("__regex"))
    exact = listed.join(literal, F.col(name) == F.col("pattern"))
    found = exact.select(name, "pattern").unionByName(prefixed.join(started, by_prefix).select(name, "pattern"))
    return found.unionByName(_indexed_matches(listed, name, wild.filter(F.length("__prefix") < GRAM).select("pattern")))


def resolve_rules(datasets: DataFrame, rules: DataFrame, name: str = "dataset_name") -> DataFrame:
    """Rule of every dataset: exact pattern, else the longest matching glob, else none.

    ``rules`` has ``pattern`` and ``overlay``; the result adds both (NULL when only the
    defaults apply). A pattern stated more than once counts once; use ``layer_rules`` to say
    which statement wins.
    """
    rules = rules.groupBy("pattern").agg(F.max_by("overlay", F.to_json("overlay")).alias("overlay"))
    met = glob_matches(datasets, name, rules, "pattern")
    rank = F.struct(
        (F.col("pattern") == F.col(name)).alias("exact"), F.length("pattern").alias("n"), F.col("pattern").alias("p")
    )
    best = met.groupBy(name).agg(F.max_by("pattern", rank).alias("pattern"))
    return datasets.join(best, name, "left").join(rules.select("pattern", "overlay"), "pattern", "left")


# --- overlay ------------------------------------------------------------------------


def overlay(defaults: Column, stated: Column) -> Column:
    """Stated paths win, stated nulls included; everything else is inherited.

    A block stated as null (``dcat``) also removes the inherited paths below it.
    """
    empty = F.create_map().cast("map<string,string>")
    base, top = F.coalesce(defaults, empty), F.coalesce(stated, empty)
    nulled = F.map_keys(F.map_filter(top, lambda k, v: v.isNull()))
    inherited = F.map_filter(
        base,
        lambda k, v: ~F.map_contains_key(top, k)
        & ~F.exists(nulled, lambda p: k.startswith(F.concat(p, F.lit(".")))),
    )
    return F.map_concat(inherited, top)


def layer_rules(base: DataFrame, override: DataFrame) -> DataFrame:
    """The deployer's rules over the base rules, ``(pattern, overlay)`` with one row per pattern.

    What an override states wins, nulls included; what it is silent about stays as in the base.
    """
    below = base.groupBy("pattern").agg(F.max_by("overlay", F.to_json("overlay")).alias("below"))
    above = override.groupBy("pattern").agg(F.max_by("overlay", F.to_json("overlay")).alias("above"))
    return below.join(above, "pattern", "full").select("pattern", overlay(F.col("below"), F.col("above")).alias("overlay"))


def stated_map(rows: DataFrame, *by: str) -> DataFrame:
    """Rule rows ``(…by, path, value)`` -> one ``overlay`` map per group; one row per path."""
    return rows.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct("path", "value"))).alias("overlay")
    )


def value_at(rule: Column, path: str) -> Column:
    return F.when(F.map_contains_key(rule, path), F.element_at(rule, path))


# --- gates --------------------------------------------------------------------------


def dataspace_offer(rule: Column) -> Column:
    """Offered only when the rule says so: absence is not consent."""
    return F.coalesce(value_at(rule, "dataspace.expose").cast("boolean"), F.lit(False))


def effective_expose(rule: Column) -> Column:
    """Listing gate; falls back to the offer when unstated."""
    return F.coalesce(value_at(rule, "expose").cast("boolean"), dataspace_offer(rule))


def exposure_conflicts(resolved: DataFrame, rule: str = "rule") -> DataFrame:
    """Datasets offered but not listed: reported and excluded from the export."""
    r = F.col(rule)
    return resolved.filter(dataspace_offer(r) & ~effective_expose(r))


def without_conflicts(resolved: DataFrame, rule: str = "rule") -> DataFrame:
    r = F.col(rule)
    return resolved.filter(~(dataspace_offer(r) & ~effective_expose(r)))


# --- owners -------------------------------------------------------------------------


def owner_index(owners: DataFrame) -> DataFrame:
    """``(alias, uri)`` for ids and aliases; a DID outranks a URL."""
    uri = F.coalesce(F.nullif("did", F.lit("")), F.nullif("url", F.lit("")))
    names = F.array_union(F.array("id"), F.coalesce("aliases", F.array().cast(TEXTS)))
    listed = owners.select(F.explode(names).alias("alias"), "id", uri.alias("uri"))
    return listed.groupBy("alias").agg(F.min_by("uri", F.struct(F.col("alias") != F.col("id"), F.col("id"))).alias("uri"))


def with_owner_uri(df: DataFrame, owners: DataFrame, owner: str, output: str) -> DataFrame:
    """Canonical URI of an owner label, ``urn:owner:<label>`` when unregistered, NULL when none."""
    index = owner_index(owners).select(F.col("alias").alias("__alias"), F.col("uri").alias("__uri"))
    joined = df.join(index, F.col(owner) == F.col("__alias"), "left")
    uri = F.coalesce(F.col("__uri"), F.concat(F.lit("urn:owner:"), F.col(owner)))
    return joined.withColumn(output, uri).drop("__alias", "__uri")


# --- semantic model binding ---------------------------------------------------------


def resolve_mappings(resolved: DataFrame, shared: DataFrame, local: DataFrame, rule: str = "rule") -> DataFrame:
    """Add ``ontology_path, ontology_mapping, ontology_error`` from a rule's ``ontology`` block.

    ``shared`` is ``(name, mapping)``; ``local`` is ``(base, path, mapping)`` with ``base``
    the directory of the governing file (column ``base`` of ``resolved``).
    """
    spec, spec_file = value_at(F.col(rule), "ontology.spec"), value_at(F.col(rule), "ontology.spec_file")
    marked = resolved.withColumns({"__spec": spec, "__file": spec_file})
    s = shared.select(F.col("name").alias("__s_name"), F.col("mapping").alias("__s_map"))
    f = local.select(
        F.col("base").alias("__f_base"), F.col("path").alias("__f_path"), F.col("mapping").alias("__f_map")
    )
    joined = marked.join(s, F.col("__spec") == F.col("__s_name"), "left").join(
        f, (F.col("__file") == F.col("__f_path")) & (F.col("base") == F.col("__f_base")), "left"
    )
    both = F.col("__spec").isNotNull() & F.col("__file").isNotNull()
    error = (
        F.when(both, F.lit("declares both ontology.spec and ontology.spec_file"))
        .when(F.col("__file").isNotNull() & F.col("__f_path").isNull(), F.lit("ontology.spec_file does not resolve"))
        .when(F.col("__spec").isNotNull() & F.col("__s_name").isNull(), F.lit("ontology.spec is unknown"))
    )
    return (
        joined.withColumn("ontology_error", error)
        .withColumn("ontology_path", F.when(error.isNull(), F.coalesce("__file", "__spec")))
        .withColumn("ontology_mapping", F.when(error.isNull(), F.coalesce("__f_map", "__s_map")))
        .drop("__spec", "__file", "__s_name", "__s_map", "__f_base", "__f_path", "__f_map")
    )


# --- entries ------------------------------------------------------------------------


def _texts(rule: Column, path: str) -> Column:
    return F.from_json(value_at(rule, path), TEXTS)


def governance_facet(rule: Column, owners: Column) -> Column:
    """What a rule states, as the facet that row filters, offers and levels are read from."""
    member = lambda path, kind="string": value_at(rule, path).cast(kind)
    return F.struct(
        F.from_json(value_at(rule, "row_filters"), f"array<{ROW_FILTER}>").alias("rowFilters"),
        member("user_filter_column").alias("userFilterColumn"),
        member("consent_required", "boolean").alias("consentRequired"),
        member("medallion").alias("medallion"),
        member("title").alias("title"),
        member("description").alias("description"),
        member("access_level").alias("accessLevel"),
        member("classification").alias("classification"),
        member("license").alias("license"),
        owners.alias("owners"),
        _texts(rule, "tags").alias("tags"),
        member("attribution").alias("attribution"),
        member("retention_days", "bigint").alias("retentionDays"),
        member("source_system").alias("sourceSystem"),
    )


def entries_from_rules(resolved: DataFrame, owners: DataFrame, backend_type: str = "postgres") -> DataFrame:
    """Catalogue entries from ``(dataset_name, rule)``; conflicting rules must be removed first.

    The semantic model comes from ``ontology_path`` and ``ontology_mapping``, as ``resolve_mappings`` adds them (the mapping
    as JSON text or in the catalogue's type); a dataset whose model doesn't resolve must be removed first too.
    """
    r = F.col("rule")
    given = dict(resolved.dtypes)
    mapping = F.lit(None)
    if "ontology_mapping" in given:
        mapping = F.col("ontology_mapping")
        mapping = F.from_json(mapping, MAPPING) if given["ontology_mapping"] == "string" else mapping
    blank = lambda c: F.nullif(c, F.lit(""))
    none = F.array().cast(TEXTS)
    physical = physical_table(F.col("dataset_name"))
    named = F.coalesce(F.transform(F.from_json(value_at(r, "ownership"), "array<struct<name:string>>"), lambda o: o["name"]), none)
    classification = blank(value_at(r, "classification"))
    keywords = F.array_sort(
        F.array_distinct(
            F.concat(
                F.coalesce(_texts(r, "tags"), none),
                F.transform(named, lambda o: F.concat(F.lit("owner:"), o)),
                F.coalesce(F.when(classification.isNotNull(), F.array(F.concat(F.lit("classification:"), classification))), none),
            )
        )
    )
    config = (
        F.struct(physical.alias("table"))
        if backend_type == "postgres"
        else F.struct(physical.alias("path"), F.lit(OBJECT_FORMAT).alias("format"))
    )
    owned = with_owner_uri(resolved.withColumn("__owner", F.get(named, F.lit(0))), owners, "__owner", "__owner_uri")
    temporal = F.struct(
        value_at(r, "dcat.temporal.start").alias("start"), value_at(r, "dcat.temporal.end").alias("end")
    )
    return to_catalogue(owned.select(
        clean_id(F.col("dataset_name")).alias("dataset_id"),
        F.coalesce(blank(value_at(r, "title")), F.col("dataset_name")).alias("title"),
        F.coalesce(blank(value_at(r, "description")), physical).alias("description"),
        F.lit(backend_type).alias("backend_type"),
        config.alias("backend_config"),
        effective_expose(r).alias("expose"),
        dataspace_offer(r).alias("dataspace_expose"),
        F.struct(
            keywords.alias("keywords"),
            blank(value_at(r, "access_level")).alias("accessRights"),
            _texts(r, "dcat.themes").alias("themes"),
            blank(value_at(r, "dcat.accrual_periodicity")).alias("accrualPeriodicity"),
            blank(value_at(r, "dcat.conforms_to")).alias("conformsTo"),
            temporal.alias("temporal"),
        ).alias("tags"),
        value_at(r, "access_level").alias("access_level"),
        value_at(r, "license").alias("license_uri"),
        F.col("__owner_uri").alias("rights_holder_uri"),
        F.coalesce(blank(value_at(r, "dcat.publisher_uri")), F.col("__owner_uri")).alias("publisher_uri"),
        _texts(r, "dcat.language_uris").alias("language_uris"),
        _texts(r, "dcat.spatial_uris").alias("spatial_uris"),
        value_at(r, "documentation_url").alias("landing_page"),
        (F.col("ontology_path") if "ontology_path" in given else F.lit(None)).alias("ontology_path"),
        mapping.alias("ontology_mapping"),
        F.struct(
            F.col("dataset_name").alias("name"), F.struct(governance_facet(r, named).alias("governance")).alias("facets")
        ).alias("lineage"),
    ))
