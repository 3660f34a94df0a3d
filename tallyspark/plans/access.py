"""Governed rows: what each role sees of the tables, and why."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.catalogue import query
from tallyspark.operators import governance as G
from tallyspark.operators import permissions as P
from tallyspark.plans.stores import _new_path
from tallyspark.sources import store as S
from tallyspark.sources import table

#: Classification of each table, and the columns that are sensitive.
CLASSIFIED = {"part": "public", "orders": "internal", "customer": "confidential", "supplier": "restricted"}
SENSITIVE = {"customer": ["c_name", "c_acctbal"], "supplier": ["s_acctbal"]}
_ROLES = ", ".join(f"('{r}')" for r in G.ROW_LIMITS)
_LIMIT = "CASE role " + " ".join(f"WHEN '{r}' THEN {n}" for r, n in G.ROW_LIMITS.items()) + " END"
_MAY = "(class IN ('public', 'internal') OR (class = 'confidential' AND role <> 'standard_user') OR (class = 'restricted' AND role IN ('administrator', 'data_steward', 'knowledge_steward')))"
_SEES = "(NOT sensitive OR role IN ('administrator', 'data_steward', 'analyst'))"


def _roles(spark):
    return spark.createDataFrame([(r,) for r in G.ROW_LIMITS], "role string")


def _cases(spark):
    """Every role with every table, as an aggregate or not, with a sensitive column or not."""
    tables = spark.createDataFrame([(t, c, t in SENSITIVE) for t, c in CLASSIFIED.items()], "entity string, class string, has_sensitive boolean")
    flags = spark.createDataFrame([(a, s) for a in (False, True) for s in (False, True)], "aggregate boolean, sensitive boolean")
    return _roles(spark).join(F.broadcast(tables.join(F.broadcast(flags), F.col("has_sensitive") | ~F.col("sensitive"))))


_CASES = f"""(SELECT * FROM (VALUES {_ROLES}) r(role) CROSS JOIN (VALUES {', '.join(f"('{t}', '{c}', {t in SENSITIVE})" for t, c in CLASSIFIED.items())}) t(entity, class, has_sensitive)
    CROSS JOIN (VALUES (false, false), (false, true), (true, false), (true, true)) f(aggregate, sensitive) WHERE has_sensitive OR NOT sensitive)"""


@query(f"SELECT role, entity, aggregate, bool_and({_MAY}) AS strict, bool_and({_MAY} OR (class = 'confidential' AND aggregate)) AS flagged FROM {_CASES} GROUP BY 1, 2, 3")
def g_classification(spark, d):
    """Which role may use which table, and where aggregates of confidential data are let through."""
    role, kind, aggregate = F.col("role"), F.col("class"), F.col("aggregate")
    rows = _cases(spark).select("role", "entity", "aggregate", G.may_see_class(role, kind, aggregate).alias("strict"), G.may_see_class(role, kind, aggregate, True).alias("flagged"))
    return rows.distinct()


@query(f"SELECT role, entity, aggregate, sensitive, {_SEES} AS allowed FROM {_CASES}")
def g_sensitive_columns(spark, d):
    return _cases(spark).select("role", "entity", "aggregate", "sensitive", G.may_see_columns(F.col("role"), F.col("sensitive")).alias("allowed"))


@query(f"""WITH c AS (SELECT o_orderkey, role, CASE o_orderkey % 4 WHEN 0 THEN 'public' WHEN 1 THEN 'internal' WHEN 2 THEN 'confidential' ELSE 'restricted' END AS class, o_orderkey % 5 = 0 AS sensitive, 50 + CAST(floor(o_totalprice) AS BIGINT) % 50 AS confidence, o_orderkey % 7 <> 3 AS complete, o_orderkey % 11 <> 0 AS read_only
        FROM orders CROSS JOIN (VALUES {_ROLES}) r(role))
    SELECT role, decision, CAST(count(*) AS BIGINT) AS requests FROM (SELECT role, CASE WHEN NOT (read_only AND {_MAY} AND {_SEES}) THEN 'blocked' WHEN confidence < 75 OR NOT complete THEN 'requires_clarification' ELSE 'approved' END AS decision FROM c) GROUP BY 1, 2""")
def g_decision_lattice(spark, d):
    """Requests, one an order and role: a failed critical check blocks, low confidence or a missing join asks back."""
    k = F.col("o_orderkey")
    asked = table(spark, d, "orders").select(
        F.when(k % 4 == 0, "public").when(k % 4 == 1, "internal").when(k % 4 == 2, "confidential").otherwise("restricted").alias("class"),
        (k % 5 == 0).alias("sensitive"),
        (50 + F.floor("o_totalprice") % 50).alias("confidence"),
        (k % 7 != 3).alias("complete"),
        (k % 11 != 0).alias("read_only"),
    ).join(F.broadcast(_roles(spark)))
    role = F.col("role")
    checks = [F.col("read_only"), G.may_see_class(role, F.col("class"), F.lit(False)), G.may_see_columns(role, F.col("sensitive"))]
    return asked.groupBy("role", G.decision(checks, F.col("confidence"), F.col("complete")).alias("decision")).agg(F.count(F.lit(1)).alias("requests"))


@query(f"""WITH r AS (SELECT role, {_LIMIT} AS most, row_number() OVER (ORDER BY role) AS i FROM (VALUES {_ROLES}) r(role)), c AS (SELECT *, 'confidential' AS class, false AS sensitive FROM r),
    s AS (SELECT c_custkey, c_mktsegment, c_nationkey, role, most, row_number() OVER (PARTITION BY role ORDER BY c_custkey) AS place FROM customer JOIN c ON {_MAY} AND {_SEES} AND (role IN ('administrator', 'data_steward') OR c_nationkey % 7 = i - 1))
    SELECT role, c_custkey, c_mktsegment FROM s WHERE place <= most""")
def g_governed_rows(spark, d):
    """The customers each role gets: confidential rows, of its own branches unless it sees all, up to its limit."""
    names = sorted(G.ROW_LIMITS)
    roles = spark.createDataFrame([(r, "confidential", False, False, None if r in ("administrator", "data_steward") else i) for i, r in enumerate(names)], "role string, classification string, aggregate boolean, sensitive boolean, branch int")
    rows = table(spark, d, "customer").select("c_custkey", "c_mktsegment", (F.col("c_nationkey") % 7).alias("of_branch"))
    return G.governed(rows, roles, ["c_custkey"], "of_branch").select("role", "c_custkey", "c_mktsegment")


@query(f"""SELECT role, CAST(count(*) AS BIGINT) AS rows_shown, round(min(s_acctbal), 2) AS least FROM (SELECT role, s_acctbal, {_LIMIT} AS most, row_number() OVER (PARTITION BY role ORDER BY s_suppkey) AS place FROM supplier CROSS JOIN (SELECT role, 'restricted' AS class, true AS sensitive FROM (VALUES {_ROLES}) r(role)) r WHERE {_MAY} AND {_SEES}) WHERE place <= most GROUP BY 1""")
def g_sensitive_rows(spark, d):
    """Restricted rows with a sensitive column: only roles that may see both get any."""
    roles = _roles(spark).select("role", F.lit("restricted").alias("classification"), F.lit(False).alias("aggregate"), F.lit(True).alias("sensitive"))
    shown = G.governed(table(spark, d, "supplier"), roles, ["s_suppkey"])
    return shown.groupBy("role").agg(F.count(F.lit(1)).alias("rows_shown"), F.round(F.min("s_acctbal"), 2).alias("least"))


@query("""SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'administrator' WHEN c_mktsegment IN ('MACHINERY') OR c_nationkey < 5 THEN 'data_steward' WHEN c_mktsegment = 'AUTOMOBILE' THEN 'manager' WHEN c_acctbal > 0 THEN 'analyst' ELSE 'standard_user' END AS role FROM customer""")
def g_governance_role(spark, d):
    """Users hold several roles; the strongest decides."""
    has = lambda condition, role: F.when(condition, F.lit(role))
    held = F.array_compact(F.array(has(F.col("c_acctbal") > 0, "analyst"), has(F.col("c_mktsegment") == "AUTOMOBILE", "manager"), has((F.col("c_mktsegment") == "MACHINERY") | (F.col("c_nationkey") < 5), "data_steward"), has(F.col("c_mktsegment") == "BUILDING", "admin")))
    return table(spark, d, "customer").select("c_custkey", G.governance_role(held).alias("role"))


_TEXT = "concat(event_type, CASE event_id % 5 WHEN 0 THEN ' account balance' WHEN 1 THEN ' transactions' WHEN 2 THEN ' deposit forecast' WHEN 3 THEN ' balance' ELSE '' END)"
_CODE = f"CASE WHEN contains({_TEXT}, 'balance') AND (contains({_TEXT}, 'account') OR contains({_TEXT}, 'customer')) THEN 'account.balance.view' WHEN contains({_TEXT}, 'transaction') OR contains({_TEXT}, 'statement') THEN 'account.transactions.view' WHEN contains({_TEXT}, 'forecast') AND contains({_TEXT}, 'deposit') THEN 'deposit.forecast.view' ELSE 'report.view' END"


@query(f"""WITH a AS (SELECT event_type, {_CODE} AS code FROM events) SELECT event_type, code, event_type IN ('purchase', 'view') OR code = 'report.view' AS allowed, CAST(count(*) AS BIGINT) AS requests FROM a GROUP BY 1, 2, 3""")
def g_permission_audit(spark, d):
    """Each request's permission against those granted, and the audit of all decisions."""
    k = F.col("event_id") % 5
    text = F.concat(F.col("event_type"), F.when(k == 0, " account balance").when(k == 1, " transactions").when(k == 2, " deposit forecast").when(k == 3, " balance").otherwise(""))
    granted = spark.createDataFrame([(t, c) for t in ("purchase", "view") for c in ("account.balance.view", "account.transactions.view", "deposit.forecast.view")], "event_type string, code string").withColumn("granted", F.lit(True))
    asked = table(spark, d, "events").select("event_type", G.permission(text).alias("code")).groupBy("event_type", "code").agg(F.count(F.lit(1)).alias("requests"))
    return asked.join(F.broadcast(granted), ["event_type", "code"], "left").select("event_type", "code", (F.coalesce("granted", F.lit(False)) | (F.col("code") == "report.view")).alias("allowed"), "requests")


def _held(spark, d):
    """What customers hold: two roles each, of five; roles hold the codes of event types, one role and one code are inactive."""
    customers, kinds = table(spark, d, "customer"), table(spark, d, "events").select("event_type").filter("event_type is not null").distinct()
    user_roles = customers.select(F.col("c_custkey").alias("user_id"), F.explode(F.array(F.length("c_mktsegment") % 5, F.col("c_nationkey") % 5)).alias("role_id"))
    roles = customers.select((F.col("c_nationkey") % 5).alias("role_id")).distinct().withColumn("is_active", F.col("role_id") != 3)
    permissions = kinds.select(F.col("event_type").alias("permission_id"), F.concat(F.lit("event."), "event_type").alias("code"), (F.col("event_type") != "error").alias("is_active"))
    role_permissions = kinds.select(F.explode(F.sequence(F.length("event_type") % 3, F.length("event_type") % 3 + 2)).alias("role_id"), F.col("event_type").alias("permission_id"))
    return P.held(user_roles, roles, role_permissions, permissions)


_HELD = """(WITH ur AS (SELECT c_custkey AS user_id, len(c_mktsegment) % 5 AS role_id FROM customer UNION ALL SELECT c_custkey, c_nationkey % 5 FROM customer),
    r AS (SELECT DISTINCT c_nationkey % 5 AS role_id, c_nationkey % 5 <> 3 AS is_active FROM customer), p AS (SELECT DISTINCT event_type, concat('event.', event_type) AS code, event_type <> 'error' AS is_active FROM events WHERE event_type IS NOT NULL),
    rp AS (SELECT event_type, unnest(range(len(event_type) % 3, len(event_type) % 3 + 3)) AS role_id FROM p)
    SELECT DISTINCT user_id, code AS permission_code FROM ur JOIN r ON ur.role_id = r.role_id AND r.is_active JOIN rp ON rp.role_id = r.role_id JOIN p ON p.event_type = rp.event_type AND p.is_active)"""


@query(f"SELECT user_id, permission_code FROM {_HELD}")
def g_permissions_held(spark, d):
    """Users to roles to permissions, what is active of them, each pair once."""
    return _held(spark, d)


@query(f"""SELECT event_id AS request_id, e.user_id, 'event_access' AS action, event_type AS resource, concat('event.', event_type) AS permission_code, h.user_id IS NOT NULL AS access_granted,
    CASE WHEN h.user_id IS NOT NULL THEN '{P.GRANTED}' ELSE '{P.MISSING}' END AS reason, props AS request_text, strftime(ts, '%Y-%m-%d') AS day
    FROM events e LEFT JOIN {_HELD} h ON h.user_id = e.user_id AND h.permission_code = concat('event.', e.event_type)""")
def g_request_audit(spark, d):
    """Every event as a request, decided and logged; the first half is logged twice and is there once."""
    asked = table(spark, d, "events").select(
        F.col("event_id").alias("request_id"),
        "user_id",
        F.concat(F.lit("event."), "event_type").alias("permission_code"),
        F.col("event_type").alias("resource"),
        F.col("props").alias("request_text"),
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
    )
    decided, log = P.authorized(asked, _held(spark, d)), P.audit_log(_new_path(spark, "audit"))
    P.record(spark, log, decided.filter("day < '2024-01-16'"), "event_access")
    P.record(spark, log, decided, "event_access")
    return S.read(spark, log)
