"""Decisions on requests, and the rows that a role may see."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.catalogue import query
from tallyspark.functions import text as T
from tallyspark.plans.text import _INTENT, _REQUESTS, _requests

#: Rows that each role may see, by the short names of these requests.
ROW_CAPS = {"administrator": 1000, "data_steward": 500, "knowledge_steward": 500, "analyst": 500, "manager": 300, "executive": 300, "standard": 100}
_ROLE = "CASE id % 7 " + " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(ROW_CAPS)) + " END"
_CAP = "CASE id % 7 " + " ".join(f"WHEN {i} THEN {n}" for i, n in enumerate(ROW_CAPS.values())) + " END"


@query(f"""SELECT id, {_ROLE} AS role, CASE WHEN v = 'blocked' THEN 'blocked' WHEN v = 'unknown' THEN 'requires_clarification' ELSE 'approved' END AS decision,
    CASE WHEN v NOT IN ('blocked', 'unknown') THEN {_CAP} END AS row_cap FROM (SELECT id, {_INTENT} AS v FROM ({_REQUESTS}))""")
def g_decisions(spark, d):
    """Blocked goes before a question back, that before approval; approved requests get their role's row limit."""
    roles = F.array(*[F.lit(r) for r in ROW_CAPS])
    caps = F.create_map(*[F.lit(x) for p in ROW_CAPS.items() for x in p])
    asked = _requests(spark, d).select("id", F.get(roles, (F.col("id") % len(ROW_CAPS)).cast("int")).alias("role"), T.intent(F.col("text")).alias("v"))
    decision = F.when(F.col("v") == "blocked", "blocked").when(F.col("v") == "unknown", "requires_clarification").otherwise("approved")
    return asked.select("id", "role", decision.alias("decision")).withColumn("row_cap", F.when(F.col("decision") == "approved", F.try_element_at(caps, F.col("role"))))
