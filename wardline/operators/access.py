"""Access decisions over whole request logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wardline.functions import access as acl


def access_matrix(df: DataFrame, level: str = "access_level") -> DataFrame:
    """Add ``requires_auth``, ``requires_policy`` and ``level_valid`` for a level column."""
    c = F.col(level)
    return df.withColumns(
        {
            "level_valid": acl.level_is_valid(c),
            "requires_auth": acl.requires_auth(c),
            "requires_policy": acl.requires_policy(c),
        }
    )


def resolve_ids(refs: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``ref`` -> ``dataset_id``: exact id, else for a two-part ref the lowest id ending in ``.ref``.

    Ids are unique; suffixes are reduced to one id each before the join, so a popular suffix
    stays one row.
    """
    ids = catalogue.select("dataset_id")
    exact = ids.select(F.col("dataset_id").alias("exact_id"))
    dots = lambda c: F.size(F.split(c, r"\.")) - 1
    suffix = (
        ids.filter(dots(F.col("dataset_id")) >= 2)
        .groupBy(F.substring_index("dataset_id", ".", -2).alias("suffix"))
        .agg(F.min("dataset_id").alias("suffix_id"))
    )
    two_part = F.when(dots(F.col("ref")) == 1, F.col("ref"))
    return (
        refs.join(exact, refs["ref"] == exact["exact_id"], "left")
        .withColumn("__two", F.when(F.col("exact_id").isNull(), two_part))
        .join(suffix, F.col("__two") == suffix["suffix"], "left")
        .withColumn("dataset_id", F.coalesce("exact_id", "suffix_id"))
        .drop("exact_id", "__two", "suffix", "suffix_id")
    )


def unknown_ids(refs: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Refs that resolve to nothing, sorted."""
    return resolve_ids(refs, catalogue).filter(F.col("dataset_id").isNull()).select("ref").distinct().orderBy("ref")


def physical_name_parts(name: Column) -> tuple[Column, Column, Column]:
    """``(database, schema, table)`` of a one-, two- or three-part name."""
    parts = F.split(name, r"\.")
    n = F.size(parts)
    three, two = n == 3, n == 2
    database = F.when(three, F.get(parts, F.lit(0)))
    schema = F.when(three, F.get(parts, F.lit(1))).when(two, F.get(parts, F.lit(0)))
    table = F.when(three, F.get(parts, F.lit(2))).when(two, F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(0)))
    return database, schema, table


CATALOGUE_COLUMNS = ["dataset_id", "access_level", "expose", "dataspace_expose", "has_table"]


def decision_catalogue(catalogue: DataFrame) -> DataFrame:
    """The catalogue columns a decision needs."""
    config = F.col("backend_config")
    return catalogue.select(
        "dataset_id",
        "access_level",
        F.coalesce("expose", F.lit(False)).alias("expose"),
        F.coalesce("dataspace_expose", F.lit(False)).alias("dataspace_expose"),
        F.coalesce(config["table"], config["path"]).isNotNull().alias("has_table"),
    )


def access_decisions(requests: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Judge every request row.

    ``requests`` carries ``dataset_id, action, subject_type, groups, scopes`` and a boolean
    ``under_agreement``; everything else passes through. Adds ``allowed, reason, status,
    verdict``. Agreement requests are gated on the offer flag and then judged by the
    agreement, not by the level policy.
    """
    cat = decision_catalogue(catalogue).withColumn("known", F.lit(True))
    joined = requests.join(cat, "dataset_id", "left")
    level = F.col("access_level")
    permitted, reason = acl.policy_columns(
        level, F.col("action"), F.col("subject_type"), F.col("groups"), F.col("scopes")
    )
    agreement = F.coalesce(F.col("under_agreement"), F.lit(False))
    anonymous = F.coalesce(F.col("subject_type"), F.lit("anonymous")) == "anonymous"
    verdict = (
        F.when(F.col("known").isNull(), "unknown_dataset")
        .when(agreement & ~F.col("dataspace_expose"), "not_offered")
        .when(~F.col("expose"), "not_exposed")
        .when(~F.col("has_table"), "no_table")
        .when(agreement, "allow")
        .when(~acl.level_is_valid(level), "invalid_level")
        .when(acl.requires_auth(level) & anonymous, "login_required")
        .when(permitted, "allow")
        .otherwise("denied")
    )
    status = (
        F.when(F.col("verdict") == "allow", 200)
        .when(F.col("verdict") == "unknown_dataset", 400)
        .when(F.col("verdict") == "login_required", 401)
        .when(F.col("verdict") == "invalid_level", 500)
        .otherwise(403)
    )
    return (
        joined.withColumn("verdict", verdict)
        .withColumn("reason", F.when(F.col("verdict").isin("allow", "denied") & ~agreement, reason))
        .withColumn("status", status)
        .withColumn("allowed", F.col("verdict") == "allow")
        .drop("known", *CATALOGUE_COLUMNS[1:])
    )


def judge_requests(decisions: DataFrame, request: str = "request_id") -> DataFrame:
    """One row per request: it passes only if every referenced dataset passes.

    The status is that of the refusal which ``GovernedSession`` reports: an unknown dataset first, then one that isn't
    offered, then the first by id. Every refused reference counts, resolved or not.
    """
    refused = F.when(~F.col("allowed"), F.col("dataset_id"))
    rank = F.struct(F.col("status") != 400, F.col("verdict") != "not_offered", "dataset_id")
    return decisions.groupBy(request).agg(
        F.bool_and("allowed").alias("allowed"),
        F.count(F.lit(1)).alias("n_datasets"),
        F.count_if(~F.col("allowed")).alias("n_refused"),
        F.min(refused).alias("first_refused"),
        F.coalesce(F.min_by("status", F.when(~F.col("allowed"), rank)), F.lit(200)).alias("status"),
    )


def refused_datasets(decisions: DataFrame, request: str = "request_id") -> DataFrame:
    """``(request, dataset_id, verdict)`` of every refusal: the full offender list, one row each."""
    return decisions.filter(~F.col("allowed")).select(request, "dataset_id", "verdict").distinct()


def agreement_filters(requests: DataFrame, decisions: DataFrame) -> DataFrame:
    """Attach the filter an agreement decision states per dataset; none means unfiltered.

    ``decisions`` holds ``agreement_id, dataset_id, handler, column, principals, reason`` and,
    with a NULL ``dataset_id``, the agreement's general reason.
    """
    own = decisions.filter(F.col("dataset_id").isNotNull())
    general = decisions.filter(F.col("dataset_id").isNull()).select(
        "agreement_id", F.col("reason").alias("general_reason")
    )
    stated = own.withColumn("__stated", F.lit(True))
    return (
        requests.join(stated, ["agreement_id", "dataset_id"], "left")
        .join(general, "agreement_id", "left")
        .withColumn("reason", F.when(F.col("__stated"), F.col("reason")).otherwise(F.col("general_reason")))
        .withColumn("filtered", F.col("handler").isNotNull())
        .drop("__stated", "general_reason")
    )


CLAIMS_SCHEMA = (
    "sub string, preferred_username string, email string, groups array<string>, scope string, "
    "realm_access struct<roles:array<string>>, "
    "resource_access map<string, struct<roles:array<string>>>, exp bigint"
)


def normalize_subjects(tokens: DataFrame, claims: str, client_id: str) -> DataFrame:
    """Verified token claims (JSON text) -> subject columns.

    Roles are the sorted union of realm and client roles; scopes come from a space separated
    string or a list. No claims means an anonymous subject.
    """
    c = F.from_json(F.col(claims), CLAIMS_SCHEMA)
    none = F.array().cast("array<string>")
    scope = c["scope"]
    scopes = F.when(scope.startswith("["), F.from_json(scope, "array<string>")).otherwise(
        F.filter(F.split(F.trim(scope), r"\s+"), lambda s: s != "")
    )
    roles = F.array_sort(
        F.array_union(
            F.coalesce(c["realm_access"]["roles"], none), F.coalesce(c["resource_access"][client_id]["roles"], none)
        )
    )
    kind = (
        F.when(c["sub"].isNull(), "anonymous")
        .when(c["preferred_username"].startswith("service-account-"), "service")
        .otherwise("user")
    )
    return tokens.withColumn(
        "subject",
        F.struct(
            c["sub"].alias("sub"),
            kind.alias("type"),
            F.coalesce(c["preferred_username"], c["email"]).alias("username"),
            F.coalesce(c["groups"], none).alias("groups"),
            roles.alias("roles"),
            F.coalesce(scopes, none).alias("scopes"),
            c["exp"].alias("exp"),
        ),
    )

