"""Term learning, lexical scores and facts over documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyspark.catalogue import query
from tallyspark.functions import text as T
from tallyspark.sources import table

_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"
TERM = "[a-z][a-z0-9_-]{3,}"
#: Terms ranked for a source, the least frequency, and the share of documents above which a term is boilerplate.
TERMS, LEAST, BOILERPLATE = 30, 3, 0.85


@query(f"""WITH w AS (SELECT source, doc_id, unnest(regexp_extract_all(lower(text), '{TERM}')) AS term FROM documents),
    f AS (SELECT source, term, CAST(count(*) AS BIGINT) AS tf, CAST(count(DISTINCT doc_id) AS BIGINT) AS df FROM w WHERE NOT list_contains({_STOP}, term) GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY df DESC, tf DESC, term) AS k FROM f),
    m AS (SELECT *, max(tf) OVER (PARTITION BY source) AS most FROM r WHERE k <= {TERMS}), t AS (SELECT source, count(*) AS n FROM documents GROUP BY 1)
    SELECT m.source, term, tf, df, round(least(0.92, 0.5 + 0.22 * tf / most + 0.18 * least(1.0, df / greatest(n * 0.35, 1.0))), 6) AS confidence
    FROM m JOIN t ON m.source IS NOT DISTINCT FROM t.source WHERE tf >= {LEAST} AND df / n <= {BOILERPLATE}""")
def d_term_learning(spark, d):
    docs = table(spark, d, "documents")
    stop = F.array(*[F.lit(w) for w in T.STOP_WORDS])
    # stop words go before rows are made of the words; counts are by document first, so a common term shuffles one row a document
    words = F.filter(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)), lambda w: ~F.array_contains(stop, w))
    words = docs.select("source", "doc_id", F.explode(words).alias("term"))
    counts = words.groupBy("source", "term", "doc_id").agg(F.count(F.lit(1)).alias("n")).groupBy("source", "term").agg(F.sum("n").alias("tf"), F.count(F.lit(1)).alias("df"))
    rank = Window.partitionBy("source").orderBy(F.desc("df"), F.desc("tf"), "term")
    top = counts.withColumn("k", F.row_number().over(rank)).filter(F.col("k") <= TERMS).withColumn("most", F.max("tf").over(Window.partitionBy("source")))
    totals = docs.groupBy(F.col("source").alias("of")).agg(F.count(F.lit(1)).alias("n"))
    share = F.least(F.lit(1.0), F.col("df") / F.greatest(F.col("n") * 0.35, F.lit(1.0)))
    confidence = F.round(F.least(F.lit(0.92), 0.5 + 0.22 * F.col("tf") / F.col("most") + 0.18 * share), 6)
    kept = top.join(totals, F.col("source").eqNullSafe(F.col("of"))).filter((F.col("tf") >= LEAST) & (F.col("df") / F.col("n") <= BOILERPLATE))
    return kept.select("source", "term", "tf", "df", confidence.alias("confidence"))


#: The words of a question.
QUESTION = ["and", "one", "reier", "der", "ander", "hant"]
_TF = " + ".join(f"CASE WHEN len(list_filter(w, lambda x: x = '{q}')) > 0 THEN 1.0 + 0.2 * least(5, len(list_filter(w, lambda x: x = '{q}'))) ELSE 0.0 END" for q in QUESTION)
_SCORED = f"SELECT doc_id, round(CAST({_TF} AS DOUBLE), 6) AS score FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents)"


def _scored(spark, d):
    # only the question's words are taken from the text, and one fold turns their counts into the score
    wanted = F.array(*[F.lit(q) for q in QUESTION])
    alone = F.lit(rf"(?<![a-z0-9])({'|'.join(QUESTION)})(?![a-z0-9])")
    found = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), alone, F.lit(1))
    counts = lambda words: F.transform(wanted, lambda q: F.size(words) - F.size(F.array_remove(words, q)))
    score = F.aggregate(F.transform(F.array(found), counts)[0], F.lit(0.0), lambda acc, n: acc + F.when(n > 0, 1.0 + 0.2 * F.least(n, F.lit(5))).otherwise(0.0))
    return table(spark, d, "documents").select("doc_id", F.round(score, 6).alias("score"))


@query(_SCORED)
def d_lexical_score(spark, d):
    return _scored(spark, d)


@query(f"SELECT * FROM ({_SCORED}) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 6")
def d_top_documents(spark, d):
    # taken before the filter: a filter under the sort would work the score out again for each use of it
    return _scored(spark, d).orderBy(F.desc("score"), "doc_id").limit(6).filter("score > 0")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(line) ORDER BY pos) AS again FROM l WHERE len(line) <= 250 AND contains(lower(line), 'an')),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM k WHERE again = 1)
    SELECT doc_id, line, CAST(k AS INTEGER) AS k FROM r WHERE k <= 12""")
def d_facts(spark, d):
    """The first twelve different short lines of each document that hold a keyword."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = lines.filter((F.length("line") <= 250) & F.lower("line").contains("an"))
    first = lines.groupBy("doc_id", F.lower("line").alias("key")).agg(F.min_by("line", "pos").alias("line"), F.min("pos").alias("pos"))
    k = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))
    return first.select("doc_id", "line", k.alias("k")).filter("k <= 12")
