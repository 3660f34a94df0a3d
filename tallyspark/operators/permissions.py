"""Permissions that users hold through their roles, requests decided by them, and the log of what was decided."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.sources import store as S

#: What the log says of a decision.
GRANTED, MISSING = "Permission granted", "Required permission not assigned"
_AUDIT = "request_id long, user_id long, action string, resource string, permission_code string, access_granted boolean, reason string, request_text string, day string"


def held(user_roles: DataFrame, roles: DataFrame, role_permissions: DataFrame, permissions: DataFrame) -> DataFrame:
    """(user_id, permission_code), each once: what users hold through active roles, of the active permissions.

    The tables are (user_id, role_id), (role_id, is_active), (role_id, permission_id) and (permission_id, code,
    is_active). Roles meet their permissions before any user does and only as the different codes of each
    role, so a user's rows are multiplied by what its roles hold and by nothing else. A null in is_active
    is inactive; nulls in a key join nothing."""
    codes = role_permissions.join(roles.filter("is_active").select("role_id"), "role_id").join(permissions.filter("is_active").select("permission_id", "code"), "permission_id")
    codes = codes.select("role_id", F.col("code").alias("permission_code")).distinct()
    return user_roles.select("user_id", "role_id").distinct().join(codes, "role_id").select("user_id", "permission_code").distinct()


def authorized(requests: DataFrame, permitted: DataFrame) -> DataFrame:
    """The requests (user_id, permission_code, ...) with access_granted and the reason, one row a request.

    permitted has each pair once, so a user with a third of all requests only makes the left side of the
    join uneven, and that is the side an adaptive join splits. A null user or code is refused."""
    known = permitted.select("user_id", "permission_code", F.lit(True).alias("_held"))
    granted = F.coalesce("_held", F.lit(False))
    rows = requests.join(known, ["user_id", "permission_code"], "left")
    return rows.select(*requests.columns, granted.alias("access_granted"), F.when(granted, GRANTED).otherwise(MISSING).alias("reason"))


def audit_log(path: str) -> S.Store:
    """The log of decisions, a partition a day; a request is in it once."""
    return S.Store(path, _AUDIT, ("day", "request_id"), ("day",))


def record(spark: SparkSession, log: S.Store, decided: DataFrame, action: str) -> None:
    """Add decided requests (request_id, day, user_id, permission_code, access_granted, reason[, resource,
    request_text]) to the log. A request that is logged already stays as it is, so a call that broke off, or whose
    tasks were run twice, can be made again. Rows without a request_id or a day raise: a decision is never lost."""
    for name in ("resource", "request_text"):
        if name not in decided.columns:
            decided = decided.withColumn(name, F.lit(None).cast("string"))
    for name in log.keys:
        decided = decided.withColumn(name, F.coalesce(name, F.raise_error(F.lit(f"a decided request has no {name}"))))
    S.append_once(spark, log, decided.withColumn("action", F.lit(action)))
