"""A catalog of tables and columns, and what is found in it: words, tables, joins, measures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names of kinds that compare with each other.
FAMILIES = {"integer": ["int", "bigint", "smallint", "tinyint"], "number": ["double", "float", "decimal"], "text": ["string"], "time": ["date", "timestamp", "timestamp_ntz"]}


def columns(frames: dict[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, kind): the columns of some tables, from their schemas alone."""
    spark = next(iter(frames.values())).sparkSession
    of = {t: f for f, types in FAMILIES.items() for t in types}
    rows = [(t, f.name, of.get(f.dataType.typeName(), of.get(f.dataType.simpleString(), f.dataType.typeName()))) for t, df in frames.items() for f in df.schema]
    return spark.createDataFrame(rows, "table_name string, column_name string, kind string")


def words(name: Column) -> Column:
    """The words of a name: camelCase, underscores and digits apart, lower case."""
    spaced = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "[^A-Za-z0-9]+", " ")
    return F.split(F.trim(F.lower(spaced)), " +")


def matches(found: DataFrame, phrases: list[str], exact: float = 70.0, part: float = 25.0) -> DataFrame:
    """Columns with the weight of the phrases their names are or hold; a column counts 70 at most.
    The catalog is as small as the schemas; phrases are given."""
    name = F.array_join(words(F.col("column_name")), " ")
    weight = reduce(lambda a, b: a + b, [F.when(name == p, exact).when(F.lower("column_name").contains(p), part).otherwise(0.0) for p in phrases])
    return found.withColumn("score", F.least(F.lit(exact), weight)).filter("score > 0")


#: The score from which a join is approved if it leads by the margin, and under which it is rejected.
APPROVE, MARGIN, REJECT = 95, 8, 70


def join_candidates(found: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Pairs of columns of two tables of one kind, scored by their names, with the lead over the next
    pair of the same tables and what follows from it. Only columns that share a word of their name meet,
    so the catalog is joined on words and not with itself as a whole."""
    key = F.create_map(*[F.lit(x) for p in keys.items() for x in p])
    named = found.withColumn("plain", F.regexp_replace("column_name", "^[a-z]+_", "")).withColumn("is_key", F.coalesce(F.try_element_at(key, F.col("table_name")) == F.col("column_name"), F.lit(False)))
    left = named.select(*[F.col(c).alias(f"l_{c}") for c in named.columns])
    right = named.select(*[F.col(c).alias(f"r_{c}") for c in named.columns])
    pairs = left.join(right, (F.col("l_plain") == F.col("r_plain")) & (F.col("l_kind") == F.col("r_kind")) & (F.col("l_table_name") != F.col("r_table_name")))
    pairs = pairs.filter(F.col("r_is_key") & ~F.col("l_is_key"))
    name = F.when(F.col("l_column_name") == F.col("r_column_name"), 45).otherwise(40)
    about = F.when(F.contains(F.col("r_plain"), F.substring("r_table_name", 1, 4)), 35).otherwise(0)
    scored = pairs.withColumn("score", name + about + 20 + F.when(F.endswith(F.col("r_plain"), F.lit("key")), 8).otherwise(0))
    best = Window.partitionBy("l_table_name", "r_table_name").orderBy(F.desc("score"), "l_column_name", "r_column_name")
    out = scored.withColumn("lead", F.col("score") - F.coalesce(F.lead("score").over(best), F.lit(0)))
    status = F.when((F.col("score") >= APPROVE) & (F.col("lead") >= MARGIN), "approved").when(F.col("score") < REJECT, "rejected").otherwise("review")
    return out.select(F.col("l_table_name").alias("source_table"), F.col("l_column_name").alias("source_column"), F.col("r_table_name").alias("target_table"), F.col("r_column_name").alias("target_column"), "score", "lead", status.alias("status"))


def friendly(name: Column) -> Column:
    """A result column's name for people: the aggregate spelled out, then words with capitals."""
    spelled = name
    for short, long in (("sum_", "Total "), ("avg_", "Average "), ("count_", "Number of "), ("max_", "Highest "), ("min_", "Lowest ")):
        spelled = F.when(name.startswith(short), F.concat(F.lit(long), F.substring(name, len(short) + 1, 1000))).otherwise(spelled)
    return F.initcap(F.regexp_replace(spelled, "_+", " "))


def valid_identifier(name: Column) -> Column:
    """A plain name: a letter or underscore, then letters, digits and underscores."""
    return name.rlike("^[A-Za-z_][A-Za-z0-9_]*$")


#: Statements that change data or structure.
WRITING = "insert update delete drop alter truncate create grant revoke merge".split()


def read_only(statement: Column) -> Column:
    """One statement that begins with select or with and holds no writing word outside quotes."""
    bare = F.lower(F.trim(F.regexp_replace(statement, "'[^']*'", "''")))
    bare = F.regexp_replace(bare, r";\s*$", "")
    return bare.rlike(r"^(select|with)\b") & ~bare.contains(";") & ~bare.rlike(r"\b(" + "|".join(WRITING) + r")\b")
