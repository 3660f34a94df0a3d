"""Who may see what: roles, classifications, sensitive columns, scope, limits and the decision."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that each role may see.
ROW_LIMITS = {"administrator": 1000, "data_steward": 500, "knowledge_steward": 500, "analyst": 500, "manager": 300, "executive": 300, "standard_user": 100}
#: Classifications that each role may see.
CLASSES = {
    "administrator": ["public", "internal", "confidential", "restricted"],
    "data_steward": ["public", "internal", "confidential", "restricted"],
    "knowledge_steward": ["public", "internal", "confidential", "restricted"],
    "analyst": ["public", "internal", "confidential"],
    "manager": ["public", "internal", "confidential"],
    "executive": ["public", "internal", "confidential"],
    "standard_user": ["public", "internal"],
}
#: Roles that may see sensitive columns.
SENSITIVE_ROLES = ["administrator", "data_steward", "analyst"]
LEAST_CONFIDENCE = 75
#: Roles of users by precedence, with the governance role of each; others are standard users.
ROLE_ORDER = [("admin", "administrator"), ("data_steward", "data_steward"), ("manager", "manager"), ("analyst", "analyst")]


def _lookup(values: dict) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v))])


def row_limit(role: Column) -> Column:
    """The role's limit; an unknown role has a standard user's."""
    return F.coalesce(F.try_element_at(_lookup(ROW_LIMITS), role), F.lit(ROW_LIMITS["standard_user"]))


def may_see_class(role: Column, classification: Column, aggregate: Column, aggregates_of_confidential: bool = False) -> Column:
    """The classification is one of the role's; aggregates of confidential data pass where that is allowed."""
    own = F.coalesce(F.try_element_at(_lookup(CLASSES), role), F.array(F.lit("public"), F.lit("internal")))
    return F.array_contains(own, classification) | (F.lit(aggregates_of_confidential) & (classification == "confidential") & aggregate)


def may_see_columns(role: Column, sensitive: Column) -> Column:
    """sensitive: whether any of the columns shown is sensitive, in an aggregate too."""
    return ~sensitive | role.isin(SENSITIVE_ROLES)


def decision(blocking: list[Column], confidence: Column, complete: Column) -> Column:
    """Blocked where a critical check fails, a question back where too little is known, else approved."""
    passed = reduce(lambda a, b: a & b, blocking)
    return F.when(~passed, "blocked").when((confidence < LEAST_CONFIDENCE) | ~complete, "requires_clarification").otherwise("approved")


MOST_ROLES = 100


def governed(rows: DataFrame, roles: DataFrame, order: list[str], scope: str | None = None) -> DataFrame:
    """The rows each role of (role, classification, aggregate, sensitive[, branch]) gets: none unless both
    checks pass, of its own branch where scope names a column and branch is set, the first by order up to
    its limit. Roles are settings, one row each and at most MOST_ROLES. For each role a task keeps no
    more rows than its limit, so rows are neither multiplied by roles nor gathered by one."""
    allowed = roles.filter(may_see_class(F.col("role"), F.col("classification"), F.col("aggregate")) & may_see_columns(F.col("role"), F.col("sensitive")))
    known = allowed.withColumn("_most", row_limit(F.col("role"))).limit(MOST_ROLES + 1).collect()
    if len(known) > MOST_ROLES:
        raise ValueError(f"more than {MOST_ROLES} roles")
    types = {f.name: f.dataType for f in roles.schema}
    parts = []
    for role in known:
        own = rows if scope is None or role["branch"] is None else rows.filter(F.col(scope) == F.lit(role["branch"]))
        first = own.orderBy(*order).limit(int(role["_most"] or 0))
        parts.append(first.select("*", *[F.lit(role[c]).cast(t).alias(c) for c, t in types.items()]))
    nobody = rows.limit(0).select("*", *[F.lit(None).cast(t).alias(c) for c, t in types.items()])
    return reduce(DataFrame.unionByName, parts, nobody)


def governance_role(names: Column) -> Column:
    """The governance role of a user's role names: the first in the order of precedence."""
    out = F.lit("standard_user")
    for name, role in reversed(ROLE_ORDER):
        out = F.when(F.array_contains(names, name), role).otherwise(out)
    return out


#: What words of a request need which permission; each inner list needs one of its words.
PERMISSIONS = [
    ("account.balance.view", [["balance"], ["account", "customer"]]),
    ("account.transactions.view", [["transaction", "statement"]]),
    ("deposit.forecast.view", [["forecast"], ["deposit"]]),
]


def permission(text: Column, otherwise: str = "report.view") -> Column:
    out = F.lit(otherwise)
    text = F.lower(text)
    for code, groups in reversed(PERMISSIONS):
        fits = reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, [text.contains(w) for w in g]) for g in groups])
        out = F.when(fits, code).otherwise(out)
    return out
