"""Catalog rows from the schemas of the tables: names, matches, joins; learned terms; nested and replaced rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyspark.catalogue import query
from tallyspark.functions import text as T
from tallyspark.operators import catalog as C
from tallyspark.plans.documents import TERM
from tallyspark.sources import table

TABLES = "region nation customer supplier part orders lineitem events".split()
KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey"}
_NAMES = ", ".join(f"'{t}'" for t in TABLES)
_COLUMNS = f"""(SELECT DISTINCT table_name, column_name, CASE WHEN data_type IN ('INTEGER', 'BIGINT') THEN 'integer' WHEN data_type IN ('DOUBLE', 'FLOAT') THEN 'number' WHEN data_type = 'VARCHAR' THEN 'text' ELSE 'time' END AS kind
    FROM information_schema.columns WHERE table_name IN ({_NAMES}))"""


def _columns(spark, d):
    return C.columns({t: table(spark, d, t) for t in TABLES})


@query(f"SELECT table_name, column_name, kind, regexp_full_match(column_name, '[A-Za-z_][A-Za-z0-9_]*') AS valid FROM {_COLUMNS}")
def c_columns(spark, d):
    """Every column of the tables, its kind, and whether its name is a plain identifier."""
    return _columns(spark, d).select("table_name", "column_name", "kind", C.valid_identifier(F.col("column_name")).alias("valid"))


_SENS = "|".join(T.SENSITIVE)


@query(f"SELECT table_name, column_name, array_to_string(string_split(lower(column_name), '_'), ' ') AS words, regexp_matches(lower(column_name), '{_SENS}') AS sensitive FROM {_COLUMNS}")
def c_column_words(spark, d):
    """The words of every column's name, and whether it is sensitive by them."""
    return _columns(spark, d).select("table_name", "column_name", F.array_join(C.words(F.col("column_name")), " ").alias("words"), F.lower("column_name").rlike(_SENS).alias("sensitive"))


_PHRASES = ["price", "key", "name"]
_WEIGHT = " + ".join(f"CASE WHEN replace(lower(column_name), '_', ' ') = '{p}' THEN 70.0 WHEN contains(lower(column_name), '{p}') THEN 25.0 ELSE 0.0 END" for p in _PHRASES)


@query(f"SELECT table_name, column_name, CAST(least(70.0, {_WEIGHT}) AS DOUBLE) AS score FROM {_COLUMNS} WHERE {_WEIGHT} > 0 ORDER BY score DESC, table_name, column_name LIMIT 12")
def c_matches(spark, d):
    """The twelve columns that fit some words best."""
    found = C.matches(_columns(spark, d), _PHRASES)
    return found.select("table_name", "column_name", "score").orderBy(F.desc("score"), "table_name", "column_name").limit(12)


@query(f"""SELECT table_name, CAST(sum({_WEIGHT}) AS DOUBLE) AS score, CAST(count(*) AS BIGINT) AS matched FROM {_COLUMNS} WHERE {_WEIGHT} > 0 GROUP BY 1 HAVING sum({_WEIGHT}) >= 50""")
def c_entities(spark, d):
    """Tables that enough columns speak for."""
    return C.matches(_columns(spark, d), _PHRASES).groupBy("table_name").agg(F.sum("score").alias("score"), F.count(F.lit(1)).alias("matched")).filter("score >= 50")


_KEYED = "(" + " OR ".join(f"(table_name = '{t}' AND column_name = '{c}')" for t, c in KEYS.items()) + ")"


@query(f"""WITH n AS (SELECT *, regexp_replace(column_name, '^[a-z]+_', '') AS plain, {_KEYED} AS is_key FROM {_COLUMNS}),
    p AS (SELECT a.table_name AS source_table, a.column_name AS source_column, b.table_name AS target_table, b.column_name AS target_column,
        CASE WHEN a.column_name = b.column_name THEN 45 ELSE 40 END + CASE WHEN contains(b.plain, substr(b.table_name, 1, 4)) THEN 35 ELSE 0 END + 20 + CASE WHEN b.plain LIKE '%key' THEN 8 ELSE 0 END AS score
        FROM n a JOIN n b ON a.plain = b.plain AND a.kind = b.kind AND a.table_name <> b.table_name WHERE b.is_key AND NOT a.is_key),
    l AS (SELECT *, score - coalesce(lead(score) OVER (PARTITION BY source_table, target_table ORDER BY score DESC, source_column, target_column), 0) AS lead FROM p)
    SELECT *, CASE WHEN score >= 95 AND lead >= 8 THEN 'approved' WHEN score < 70 THEN 'rejected' ELSE 'review' END AS status FROM l""")
def c_join_candidates(spark, d):
    """Joins that the names of columns suggest."""
    return C.join_candidates(_columns(spark, d), KEYS)


@query(f"""SELECT t AS entity, table_name FROM (SELECT t, table_name, row_number() OVER (PARTITION BY t ORDER BY CASE WHEN table_name = t THEN 200 WHEN starts_with(table_name, t) THEN 100 WHEN contains(table_name, substr(t, 1, 4)) THEN 80 ELSE 0 END DESC, table_name) AS r,
    CASE WHEN table_name = t OR starts_with(table_name, t) OR contains(table_name, substr(t, 1, 4)) THEN 1 ELSE 0 END AS fits FROM (SELECT DISTINCT table_name FROM {_COLUMNS}) CROSS JOIN (VALUES ('order'), ('customer'), ('line'), ('part'), ('suppliers')) e(t)) WHERE r = 1 AND fits = 1""")
def c_physical_tables(spark, d):
    """The table that stands best for each of some entities."""
    tables = _columns(spark, d).select("table_name").distinct()
    rows = tables.withColumn("entity", F.explode(F.array(*[F.lit(x) for x in ("order", "customer", "line", "part", "suppliers")])))
    name, entity = F.col("table_name"), F.col("entity")
    fit = F.when(name == entity, 200).when(F.startswith(name, entity), 100).when(F.contains(name, F.substring("entity", 1, 4)), 80).otherwise(0)
    best = rows.withColumn("fit", fit).withColumn("r", F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("fit"), "table_name")))
    return best.filter("r = 1 and fit > 0").select("entity", "table_name")


_RESULT = "(SELECT DISTINCT concat(CASE l_linenumber % 4 WHEN 0 THEN 'sum_' WHEN 1 THEN 'avg_' WHEN 2 THEN 'count_' ELSE '' END, lower(l_returnflag), '_rows') AS name FROM lineitem)"


@query(f"SELECT name, concat(CASE WHEN starts_with(name, 'sum_') THEN 'Total ' WHEN starts_with(name, 'avg_') THEN 'Average ' WHEN starts_with(name, 'count_') THEN 'Number Of ' ELSE '' END, upper(regexp_extract(name, '([a-z])_rows', 1)), ' Rows') AS shown FROM {_RESULT}")
def c_friendly_names(spark, d):
    k = F.col("l_linenumber") % 4
    name = F.concat(F.when(k == 0, "sum_").when(k == 1, "avg_").when(k == 2, "count_").otherwise(""), F.lower("l_returnflag"), F.lit("_rows"))
    return table(spark, d, "lineitem").select(name.alias("name")).distinct().select("name", C.friendly(F.col("name")).alias("shown"))


_STATEMENT = "concat(CASE o_orderkey % 6 WHEN 0 THEN 'SELECT * FROM orders' WHEN 1 THEN 'WITH x AS (SELECT 1) SELECT * FROM x;' WHEN 2 THEN 'DELETE FROM orders' WHEN 3 THEN 'SELECT 1; DROP TABLE orders' WHEN 4 THEN 'SELECT ''update me''' ELSE 'select created FROM orders' END, ' ')"


@query("SELECT o_orderkey, o_orderkey % 6 IN (0, 1, 4, 5) AS allowed FROM orders")
def c_read_only(spark, d):
    """Statements that only read: writing words count outside quotes and as whole words only."""
    k = F.col("o_orderkey") % 6
    text = F.when(k == 0, "SELECT * FROM orders").when(k == 1, "WITH x AS (SELECT 1) SELECT * FROM x; ").when(k == 2, "DELETE FROM orders").when(k == 3, "SELECT 1; DROP TABLE orders").when(k == 4, "SELECT 'update me'").otherwise("select created FROM orders")
    return table(spark, d, "orders").select("o_orderkey", C.read_only(text).alias("allowed"))


# learned terms

_LEARNED = f"""(WITH w AS (SELECT doc_id, source, unnest(list_distinct(regexp_extract_all(lower(text), '{TERM}'))) AS term FROM documents)
    SELECT source, term, CAST(count(*) AS BIGINT) AS df, CAST(min(doc_id) AS BIGINT) AS first_doc, round(least(0.95, 0.5 + 0.01 * count(*)), 6) AS confidence FROM w GROUP BY 1, 2 HAVING count(*) >= 3)"""


def _learned(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))).alias("term"))
    rows = docs.groupBy("source", "term").agg(F.count(F.lit(1)).alias("df"), F.min("doc_id").alias("first_doc")).filter("df >= 3")
    return rows.withColumn("confidence", F.round(F.least(F.lit(0.95), 0.5 + 0.01 * F.col("df")), 6))


@query(f"SELECT term, CAST(count(*) AS BIGINT) AS sources, max(confidence) AS confidence, CAST(min(first_doc) AS BIGINT) AS first_doc FROM {_LEARNED} GROUP BY 1")
def l_upsert(spark, d):
    """Learned terms merged by their key: the greatest confidence and the first document stay."""
    return _learned(spark, d).groupBy("term").agg(F.count(F.lit(1)).alias("sources"), F.max("confidence").alias("confidence"), F.min("first_doc").alias("first_doc"))


_WORDS = "list_distinct(regexp_extract_all(lower(b.text), '[a-z][a-z0-9_-]{3,}'))"


@query(f"""WITH t AS (SELECT term, max(confidence) AS confidence FROM {_LEARNED} GROUP BY 1 HAVING max(confidence) >= 0.65), q AS (SELECT item_id, unnest({_WORDS}) AS term FROM benchmark b),
    r AS (SELECT item_id, term, row_number() OVER (PARTITION BY item_id ORDER BY confidence DESC, term) AS place FROM q JOIN t USING (term)) SELECT item_id, string_agg(term, ' ' ORDER BY place) AS terms FROM r WHERE place <= 6 GROUP BY 1""")
def l_query_expansion(spark, d):
    """For each question the six learned terms it names that are surest."""
    known = _learned(spark, d).groupBy("term").agg(F.max("confidence").alias("confidence")).filter("confidence >= 0.65")
    asked = table(spark, d, "benchmark").select("item_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z][a-z0-9_-]{3,}"), F.lit(0)))).alias("term"))
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("confidence"), "term"))
    best = asked.join(known, "term").withColumn("place", place).filter("place <= 6")
    terms = best.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("place", "term"))).alias("own"))
    return terms.select("item_id", F.array_join(F.transform("own", lambda s: s["term"]), " ").alias("terms"))


_CONCEPTS = ["reier", "under", "there", "license", "ander"]
_CLIST = "[" + ", ".join(f"'{c}'" for c in _CONCEPTS) + "]"


@query(f"""WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS c FROM documents), s AS (SELECT doc_id, round(sum(CASE WHEN c = 'license' THEN 2.0 ELSE 1.5 END + 0.7), 6) AS score FROM w WHERE list_contains({_CLIST}, c) GROUP BY 1)
    SELECT doc_id, score FROM s ORDER BY score DESC, doc_id LIMIT 10""")
def l_document_discovery(spark, d):
    """Documents by the concepts they hold, each once: an alias counts 2, a concept 1.5, plus its confidence."""
    wanted = F.array(*[F.lit(c) for c in _CONCEPTS])
    held = F.array_intersect(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)), wanted)
    score = F.aggregate(held, F.lit(0.0), lambda acc, c: acc + F.when(c == "license", 2.0).otherwise(1.5) + 0.7)
    return table(spark, d, "documents").select("doc_id", F.round(score, 6).alias("score")).filter("score > 0").orderBy(F.desc("score"), "doc_id").limit(10)


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents), c AS (SELECT doc_id, line, pos, unnest({_CLIST}) AS concept FROM l),
    s AS (SELECT *, CASE WHEN lower(line) = concept THEN 2.0 ELSE 0.0 END + 2.0 * len(regexp_replace(line, '[^A-Za-z]', '', 'g')) / greatest(1, len(line)) AS score FROM c WHERE regexp_matches(lower(line), concat('\\b', concept, '\\b')))
    SELECT concept, doc_id, CAST(pos - 1 AS INTEGER) AS pos, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY round(score, 9) DESC, doc_id, pos) AS r FROM s) WHERE r = 1""")
def l_concept_grounding(spark, d):
    """The line that holds each concept best: letters count, signs don't. A concept's best line is found
    within partitions first, so no concept's lines meet in one task."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    hit = F.filter(F.array(*[F.lit(c) for c in _CONCEPTS]), lambda c: F.array_contains(F.regexp_extract_all(F.lower("line"), F.lit(r"\w+"), F.lit(0)), c))
    rows = lines.select("doc_id", "pos", "line", F.explode(hit).alias("concept"))
    score = F.when(F.lower("line") == F.col("concept"), 2.0).otherwise(0.0) + 2.0 * F.length(F.regexp_replace("line", "[^A-Za-z]", "")) / F.greatest(F.lit(1), F.length("line"))
    best = rows.groupBy("concept").agg(F.max(F.struct(F.round(score, 9).alias("score"), (-F.col("doc_id")).alias("doc"), (-F.col("pos")).alias("pos"))).alias("b"))
    return best.select("concept", (-F.col("b.doc")).alias("doc_id"), (-F.col("b.pos")).alias("pos"), F.round("b.score", 6).alias("score"))


# nested, looked up and replaced rows


@query("""SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS n, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ' ' ORDER BY o_orderkey), '') AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def n_children(spark, d):
    """Customers with their orders nested in them."""
    orders = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("own"))
    rows = table(spark, d, "customer").select("c_custkey").join(orders, "c_custkey", "left")
    own = F.coalesce("own", F.array().cast("array<bigint>"))
    return rows.select("c_custkey", F.size(own).cast("long").alias("n"), F.array_join(own.cast("array<string>"), " ").alias("orders"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_name = 'Customer#000000007' OR c_custkey = 3")
def n_either(spark, d):
    """Rows found by their name or their number."""
    return table(spark, d, "customer").filter((F.col("c_name") == "Customer#000000007") | (F.col("c_custkey") == 3)).select("c_custkey", "c_name")


@query("""SELECT p_partkey, p_brand, 'new' AS state FROM part WHERE p_size > 25 UNION ALL SELECT p_partkey, p_brand, 'old' FROM part p WHERE NOT EXISTS (SELECT 1 FROM part q WHERE q.p_brand = p.p_brand AND q.p_size > 25)""")
def n_replaced(spark, d):
    """Rows of a brand are replaced as a whole where new ones come; other brands keep theirs."""
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    new = part.filter("p_size > 25").select("p_partkey", "p_brand", F.lit("new").alias("state"))
    kept = part.join(new.select("p_brand").distinct(), "p_brand", "left_anti").select("p_partkey", "p_brand", F.lit("old").alias("state"))
    return new.unionByName(kept)


@query("""SELECT event_id, sha256(concat('{"k":', json_extract_string(props, '$.k'), ',"type":"', event_type, '"}')) AS signature FROM events""")
def n_signature(spark, d):
    """A hash of an object's JSON with its keys in order."""
    object_ = F.to_json(F.struct(F.get_json_object("props", "$.k").cast("int").alias("k"), F.col("event_type").alias("type")))
    return table(spark, d, "events").select("event_id", F.sha2(object_, 256).alias("signature"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def n_json_repaired(spark, d):
    """The object within an answer that has fences and words around it."""
    said = F.concat(F.lit("Here you are:\n```json\n"), F.col("props"), F.lit("\n```\nAnything else?"))
    object_ = F.regexp_extract(said, r"(?s)(\{.*\})", 1)
    return table(spark, d, "events").select("event_id", F.get_json_object(object_, "$.k").cast("int").alias("k"))


@query("SELECT c_custkey, trim(regexp_replace(regexp_replace(concat('  ', c_name, chr(10), chr(9), c_mktsegment, ' '), '\\s+', ' ', 'g'), '\\s+$', '')) AS v FROM customer")
def n_white_space(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.trim(F.regexp_replace(F.concat(F.lit("  "), F.col("c_name"), F.lit("\n\t"), F.col("c_mktsegment"), F.lit(" ")), r"\s+", " ")).alias("v"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'mapping' WHEN 1 THEN 'roles' WHEN 2 THEN 'summary' ELSE 'general' END AS capability, CASE WHEN o_orderkey % 4 = 3 THEN 0.5 ELSE 0.95 END AS confidence FROM orders""")
def n_capability(spark, d):
    """The first capability whose wording a request holds."""
    k = F.col("o_orderkey") % 4
    asked = F.when(k == 0, "Map the procedure of this manual").when(k == 1, "Who is responsible for approvals?").when(k == 2, "Summarise the policy").otherwise("Hello there")
    name = F.when(F.lower(asked).rlike(r"\b(map|process|procedure)\b"), "mapping").when(F.lower(asked).rlike(r"\b(responsib\w*|roles?)\b"), "roles").when(F.lower(asked).rlike(r"\bsummar\w*\b"), "summary").otherwise("general")
    return table(spark, d, "orders").select("o_orderkey", name.alias("capability")).withColumn("confidence", F.when(F.col("capability") == "general", 0.5).otherwise(0.95))
