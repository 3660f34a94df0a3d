"""One thin query for each operator: it applies the operator to its whole table
and derives the columns that its contract asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import chat, decontaminate, fim, jaccard_join, langid, minhash, packing, periodic, quality, token_files, topk, toxicity, url_filter
from tallyspark.llm.tables import held_out, saved, table
from tallyspark.llm.tokens import vocabulary

#: Fixed rules of the url query, as (verdict, host and path).
URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]
TOP_K, QUERY_STEP = 5, 50


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").filter(~held_out(5, 0) & (F.col("quality") == 1))
    rows = quality.binned(table(spark, sf_dir, "documents"), trusted)
    out = quality.scored(rows, quality.fit(rows))
    return out.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.clustered(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.scanned(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    out = out.withColumn("n_hit", decontaminate.hit_words())
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_STEP == 0, TOP_K)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = saved(packing.pieces(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0), "pieces")
    return packing.packed(cut, ["doc_id"])


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_files.read(token_files.written(docs, vocabulary("word_bpe_49k.json"), 2))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(~held_out(3, 1)))
    return langid.predict(docs, model).select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"), URL_RULES)


def toxicity_lexicon(spark: SparkSession, sf_dir: str) -> toxicity.Lexicon:
    labels = table(spark, sf_dir, "labels").filter(~held_out(4, 2)).select("doc_id", F.col("toxic").alias("label"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.fit(toxicity.sampled(docs, labels))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.scored(table(spark, sf_dir, "documents"), toxicity_lexicon(spark, sf_dir))
    return out.select("doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.digests(chat.formatted(rows.unionByName(extra)))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim.transformed(table(spark, sf_dir, "documents"))
    digests = [F.sha2(text.cast("binary"), 256).alias(name) for name, text in (("output_sha256", F.col("output")), ("restored_sha256", fim.restored(F.col("output"), F.col("form"))))]
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.clustered(table(spark, sf_dir, "documents"))


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.detected(periodic.with_planted_runs(table(spark, sf_dir, "documents")))
    top = periodic.longest(F.col("runs"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        top["start"].alias("start"),
        top["length"].alias("length"),
        top["period"].alias("period"),
        F.floor(1000 * top["length"] / top["period"]).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def queries() -> dict:
    return {
        f.__name__: f
        for f in (op1_quality, op2_jaccard_join, op3_decontaminate, op4_topk, op5_packing, op6_token_files, op7_langid, op8_url_filter, op9_toxicity, op10_chat, op11_fim, op12_minhash, op13_periodic)
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_topk": f"""
            WITH p AS (
                SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
                FROM embeddings
                WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            ), s AS (
                SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_dot_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
                FROM p a JOIN p b ON a.vec_id <> b.vec_id
                WHERE a.vec_id % {QUERY_STEP} = 0
            ), r AS (
                SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
            )
            SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {TOP_K}""",
        "op11_fim": rf"""
            WITH t AS (
                SELECT doc_id, coalesce(text, '') AS text,
                       regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
                       sha256('{fim.SEED}:' || CAST(doc_id AS VARCHAR)) AS x
                FROM documents
            ), h AS (
                SELECT doc_id, text, u, len(u) AS n, CAST('0x' || substr(x, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(x, 9, 8) AS BIGINT) AS h2,
                       CAST('0x' || substr(x, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(x, 25, 8) AS BIGINT) AS h4
                FROM t
            ), c AS (
                SELECT doc_id, text, n,
                       CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= {fim.RATE} THEN 'plain'
                            WHEN h4 % 100 < {fim.SPM_RATE} THEN 'spm' ELSE 'psm' END AS form,
                       array_to_string(u[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS p,
                       array_to_string(u[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS m,
                       array_to_string(u[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') AS s
                FROM h
            )
            SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
                   sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
                   sha256(text) AS restored_sha256
            FROM c""",
        "op12_minhash": rf"""
            WITH RECURSIVE w AS (
                SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
            ), s AS (
                SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS s FROM w
            ), d AS (  -- one row for each set
                SELECT min(doc_id) AS id, s, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s
            ), e AS (
                SELECT id, n, unnest(s) AS g FROM d
            ), l AS (
                SELECT a.id AS x, b.id AS y FROM e a JOIN e b ON a.g = b.g AND a.id <> b.id
                WHERE 100 * least(a.n, b.n) >= {minhash.PERCENT} * greatest(a.n, b.n)
                GROUP BY a.id, b.id, a.n, b.n
                HAVING 100 * count(*) >= {minhash.PERCENT} * (a.n + b.n - count(*))
            ), r AS (
                SELECT id AS x, id AS y FROM d
                UNION
                SELECT r.x, l.y FROM r JOIN l ON r.y = l.x
            ), c AS (
                SELECT x, min(y) AS component_id FROM r GROUP BY x
            )
            SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(component_id, s.doc_id) AS component_id, s.doc_id = coalesce(component_id, s.doc_id) AS kept
            FROM s LEFT JOIN d ON s.s = d.s LEFT JOIN c ON c.x = d.id""",
    }
