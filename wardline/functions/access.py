"""Access predicates over request columns: levels, scopes and the dataset policy."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Action -> scope, group names and the reason texts of the dataset policy.
REQUIRED_SCOPES = {
    "query": "dataset.query",
    "read": "dataset.query",
    "write": "dataset.write",
    "create": "dataset.admin",
    "delete": "dataset.admin",
    "admin": "dataset.admin",
}
READ_ACTIONS = ("query", "read")
OPEN, INTERNAL, RESTRICTED = "open", "internal", "restricted"
ADMIN_GROUP = "admins"
REASON_DEFAULT = "unauthorized"
REASON_OPEN = "open dataset access granted"
REASON_RESTRICTED_SCOPE = "restricted dataset - admin scope granted"
REASON_RESTRICTED_GROUP = "restricted dataset - admin group granted"
REASON_INTERNAL_SCOPE = "internal dataset - scope granted"
REASON_INTERNAL_ADMIN = "internal dataset - admin group granted"
REASON_INTERNAL_MANAGER = "internal dataset - manager group granted"
REASON_INTERNAL_VIEWER = "internal dataset - viewer group granted"
REASON_ANONYMOUS = "anonymous access denied"
REASON_RESTRICTED_DENIED = "restricted dataset requires admin scope or group"
REASON_SCOPE_MISSING = "missing required scope"
REASON_GROUP_MISSING = "user not in authorized group"


def effective_level(level: Column) -> Column:
    """Lower-cased level; a missing or empty level counts as open."""
    return F.coalesce(F.nullif(F.lower(level), F.lit("")), F.lit(OPEN))


def level_is_valid(level: Column) -> Column:
    return effective_level(level).isin(OPEN, INTERNAL, RESTRICTED)


def requires_auth(level: Column) -> Column:
    """True for internal and restricted, false for open, NULL for an unknown level."""
    return F.when(level_is_valid(level), effective_level(level) != OPEN)


# Authentication and policy evaluation are required for the same levels.
requires_policy = requires_auth


def required_scope(action: Column) -> Column:
    """Scope an action needs; NULL for an action the policy does not know."""
    expr = F.lit(None).cast("string")
    for name, scope in REQUIRED_SCOPES.items():
        expr = F.when(action == name, F.lit(scope)).otherwise(expr)
    return expr


def scope_covers(have: Column, want: Column) -> Column:
    """Exact scope, or ``X.admin`` covering every ``X.*``."""
    return (have == want) | (have.endswith(".admin") & want.startswith(F.regexp_replace(have, r"admin$", "")))


def has_scope(scopes: Column, want: Column) -> Column:
    return F.coalesce(F.exists(scopes, lambda have: scope_covers(have, want)), F.lit(False))


def in_group(groups: Column, name: str) -> Column:
    return F.coalesce(F.array_contains(groups, name), F.lit(False))


def policy_columns(
    level: Column, action: Column, subject_type: Column, groups: Column, scopes: Column
) -> tuple[Column, Column]:
    """``(allowed, reason)`` for one request against one dataset."""
    lvl = effective_level(level)
    kind = F.coalesce(subject_type, F.lit("anonymous"))
    service, user, anonymous = kind == "service", kind == "user", kind == "anonymous"
    is_open, is_restricted = lvl == OPEN, lvl == RESTRICTED
    is_internal = ~is_open & ~is_restricted
    reading = action.isin(*READ_ACTIONS)
    scoped = has_scope(scopes, required_scope(action))
    admin = in_group(groups, ADMIN_GROUP)
    manager, viewer = in_group(groups, "managers"), in_group(groups, "viewers")

    # Reading open data never reaches the policy, so anonymous callers may read it.
    allowed = (
        F.when(is_open, reading | (service & scoped))
        .when(is_restricted, (service & has_scope(scopes, F.lit("dataset.admin"))) | (user & admin))
        .otherwise((service & scoped) | (user & (admin | ((manager | viewer) & reading))))
    )
    allowed = F.coalesce(allowed, F.lit(False))
    reason = (
        F.when(allowed & is_open & reading, REASON_OPEN)
        .when(allowed & is_restricted & service, REASON_RESTRICTED_SCOPE)
        .when(allowed & is_restricted, REASON_RESTRICTED_GROUP)
        .when(allowed & is_internal & service, REASON_INTERNAL_SCOPE)
        .when(allowed & is_internal & admin, REASON_INTERNAL_ADMIN)
        .when(allowed & is_internal & manager, REASON_INTERNAL_MANAGER)
        .when(allowed & is_internal & viewer, REASON_INTERNAL_VIEWER)
        .when(allowed, REASON_DEFAULT)
        .when(anonymous, REASON_ANONYMOUS)
        .when(is_restricted, REASON_RESTRICTED_DENIED)
        .when(is_internal & service, REASON_SCOPE_MISSING)
        .when(is_internal & user, REASON_GROUP_MISSING)
        .otherwise(REASON_DEFAULT)
    )
    return allowed, reason
