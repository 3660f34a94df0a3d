"""Which document a request means: exactly one, or none is chosen.

A query that is the whole title or file name of one document means that document. Of several such
documents the only ready one is meant. A query that is no title or file name means the only document that
holds all its words in both together. In any other case nothing is chosen: ambiguous, or not_found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _words(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))))


def exactly_one(queries: DataFrame, documents: DataFrame) -> DataFrame:
    """(query_id, status, doc_id, exact, candidates) of every query (query_id, query): resolved, ambiguous or not_found.

    documents is (doc_id, title, filename, ready). Documents of one name are counted before a query meets
    them, so a name that very many share is one row. Other candidates are found by the words asked for, see
    met(). A null or blank query finds nothing."""
    asked = queries.select("query_id", F.lower(F.trim("query")).alias("_name"), _words(F.col("query")).alias("_words"))
    docs = documents.select("doc_id", F.lower(F.trim("title")).alias("title"), F.lower(F.trim("filename")).alias("filename"), F.coalesce("ready", F.lit(False)).alias("ready"))
    named = docs.select("doc_id", "ready", F.explode(F.array_distinct(F.array("title", "filename"))).alias("_name")).filter("_name <> ''")
    ready_id = F.when(F.col("ready"), F.col("doc_id"))
    by_name = named.groupBy("_name").agg(F.count(F.lit(1)).alias("exact"), F.count(ready_id).alias("_ready"), F.min("doc_id").alias("_one"), F.min(ready_id).alias("_one_ready"))
    rows = asked.join(by_name, "_name", "left")

    # the documents by their words, only for queries that name none
    wanted = rows.filter("exact is null and size(_words) > 0").select("_words").distinct()
    held = docs.select("doc_id", _words(F.concat_ws(" ", "title", "filename")).alias("_held"))
    held = held.groupBy("_held").agg(F.count(F.lit(1)).alias("_docs"), F.min("doc_id").alias("_least"))
    found = met(wanted, held).filter(F.size(F.array_except("_words", "_held")) == 0)
    candidates = found.groupBy("_words").agg(F.sum("_docs").alias("candidates"), F.min("_least").alias("_only"))

    exact = F.coalesce("exact", F.lit(0).cast("long"))
    rows = rows.join(candidates, "_words", "left").withColumn("candidates", F.when(exact > 0, exact).otherwise(F.coalesce("candidates", F.lit(0).cast("long"))))
    chosen = F.when(exact == 1, F.col("_one")).when((exact > 1) & (F.col("_ready") == 1), F.col("_one_ready")).when((exact == 0) & (F.col("candidates") == 1), F.col("_only"))
    status = F.when(chosen.isNotNull(), "resolved").when(F.col("candidates") == 0, "not_found").otherwise("ambiguous")
    return rows.select("query_id", status.alias("status"), chosen.alias("doc_id"), exact.alias("exact"), "candidates")


def met(wanted: DataFrame, held: DataFrame) -> DataFrame:
    """(_words, _held, _docs, _least): each set of words asked for, with the sets of words of documents that hold its
    two rarest words. held is (_held, _docs, _least), the sets with their numbers of documents and least ids.

    Queries of the same words are one row of wanted and documents of the same words one row of held, so copies
    don't multiply. A set of one or two words meets only what it finds. A set of n words, those of a title and a
    file name, is entered under its n (n + 1) / 2 pairs."""
    by_word = held.select(F.explode("_held").alias("_word"), "_docs").groupBy("_word").agg(F.sum("_docs").alias("_n"))
    counted = wanted.select("_words", F.explode("_words").alias("_word")).join(by_word, "_word", "left")
    # a word that no document holds is the rarest of all, and its set finds nothing
    rare = counted.groupBy("_words").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_word"))).alias("_rare")).filter("_rare[0].n > 0")
    # one word is a pair with itself
    pair = F.array_sort(F.array(F.col("_rare")[0]["_word"], F.coalesce(F.get("_rare", F.lit(1))["_word"], F.col("_rare")[0]["_word"])))
    pairs = F.flatten(F.transform("_held", lambda x, i: F.transform(F.slice("_held", i + 1, F.size("_held")), lambda y: F.array(x, y))))
    return held.select("_held", "_docs", "_least", F.explode(pairs).alias("_pair")).join(rare.select("_words", pair.alias("_pair")), "_pair").drop("_pair")
