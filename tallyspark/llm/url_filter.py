"""URL filter: rules first, then a path-template tree for each host.

Rules (host and path) decide a url whose host is the rule's or a subdomain of
it and whose path starts with the rule's; the longest rule wins. What the
rules decide also serves as labels. For the other urls a tree of path
templates is built for each host from its distinct paths, so repeated rows
change nothing:

* a segment of digits, of hex digits or with digits in it is variable and
  becomes a wildcard that keeps its ending (``5155`` -> ``*``, ``7.html`` ->
  ``*.html``); empty segments are left out;
* a node splits where its paths first differ. Of more than MANY_CHILDREN
  children those with less than one in MANY_CHILDREN of its paths become one
  wildcard, except where the labels of one differ significantly from those of
  the other rare ones. That depends on shares alone, not on how many paths
  there are; the tree goes down until no node splits;
* the labelled branches of a node are pooled, the most alike first, while two
  of them don't differ significantly (two-proportion z test). Where all are
  alike they keep their parent's purity; else a pool's purity is its own
  blocked share, smoothed by a fixed prior;
* a template without labelled urls on its own host is judged by the labelled
  urls that the same template has on other hosts, smoothed by the same prior,
  never by its siblings; without any it has the prior, so without labelled
  urls nothing is rejected;
* a template is rejected when its purity reaches a threshold.

Urls that are null or lack ``://`` have an empty host and path, fit no rule
and are judged by the template of the empty host. Repeated rows each get a
verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.tables import saved

#: Of more children than this the ones that hold less than one in so many of the node's paths are rare.
MANY_CHILDREN = 16
SMOOTHING = 8.0
THRESHOLD = 0.5
PRIOR = 0.25
Z_SAME = 1.96
#: Template tables up to so many rows are broadcast; larger ones are joined by salted keys.
BROADCAST_ROWS = 100_000
SALTS = 32


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z folded) and path; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    known = at > 0
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    folded = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(F.when(known, folded), F.lit("")), F.coalesce(F.when(known, path), F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null; rules are (verdict, host/path)."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, _, tail = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + tail)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _shape(path: Column) -> Column:
    """The segments of a path, variable ones as wildcards."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.transform(parts, lambda x: F.regexp_replace(x, r"^[^.]*[0-9][^.]*", "*"))


def _under(above: Column, below: Column) -> Column:
    """A template with more segments below it."""
    return F.concat(above, F.when(F.size(below) > 0, F.concat(F.lit("/"), F.array_join(below, "/"))).otherwise(""))


def _z(blocked: Column, labelled: Column, blocked2: Column, labelled2: Column) -> Column:
    """How many standard errors two shares differ by; 0 where either has no labels or all labels agree."""
    p = F.try_divide(blocked + blocked2, labelled + labelled2)
    error = F.sqrt(p * (1 - p) * (F.try_divide(F.lit(1), labelled) + F.try_divide(F.lit(1), labelled2)))
    return F.coalesce(F.try_divide(F.abs(F.try_divide(blocked, labelled) - F.try_divide(blocked2, labelled2)), error), F.lit(0.0))


def pooled(shares: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(blocked, labelled) of each branch's pool, for branches (blocked, labelled) in ascending order of their shares."""
    pools = [[b, n, 1] for b, n in shares]

    def z(x: list[int], y: list[int]) -> float:
        p = (x[0] + y[0]) / (x[1] + y[1])
        error = (p * (1 - p) * (1 / x[1] + 1 / y[1])) ** 0.5
        return abs(x[0] / x[1] - y[0] / y[1]) / error if error else 0.0

    apart = [z(x, y) for x, y in zip(pools, pools[1:])]
    while apart and min(apart) < Z_SAME:
        i = apart.index(min(apart))
        pools[i : i + 2] = [[u + v for u, v in zip(pools[i], pools[i + 1], strict=True)]]
        del apart[i]
        for j in (i - 1, i):
            if 0 <= j < len(apart):
                apart[j] = z(pools[j], pools[j + 1])
    return [(b, n) for b, n, k in pools for _ in range(k)]


def _pools(branches: list) -> list[tuple[float, int, int, int]]:
    """(share, blocked and labelled of its pool, number of pools) of each branch (share, b, l)."""
    ordered = sorted((r["share"], r["b"], r["l"]) for r in branches)
    pools = pooled([(b, n) for _, b, n in ordered])
    count = 1 + sum(x != y for x, y in zip(pools, pools[1:]))
    return [(x[0], b, n, count) for x, (b, n) in zip(ordered, pools, strict=True)]


def templates(paths: DataFrame) -> DataFrame:
    """(host, shape, template, purity) of every host and shape among (host, shape, n, l, b)."""
    node = ["host", "node"]
    pools_of = F.udf(_pools, "array<struct<share:double,b:long,l:long,pools:int>>")
    root = paths.groupBy("host").agg(F.sum("l").alias("_l"), F.sum("b").alias("_b"))
    root = root.select(F.col("host").alias("_host"), _purity(F.col("_b"), F.col("_l")).alias("purity"))
    open_ = paths.withColumn("node", F.lit("")).withColumn("rest", F.col("shape")).join(root, F.col("host") == F.col("_host")).drop("_host")
    done = None
    while True:
        # how far the paths of a node agree; one that has a single path ends as it is
        spans = open_.groupBy(*node).agg(F.min("rest").alias("lo"), F.max("rest").alias("hi"))
        agree = F.array_position(F.zip_with("lo", "hi", lambda x, y: x.eqNullSafe(y)), F.lit(False)).cast("int") - 1
        spans = spans.select(*[F.col(c).alias(f"_{c}") for c in node], agree.alias("agree"))
        here = open_.join(spans, [F.col(c) == F.col(f"_{c}") for c in node]).drop("_host", "_node")
        here = saved(here, "url-nodes")
        whole = here.filter("agree < 0").select("host", "shape", _under(F.col("node"), F.col("rest")).alias("template"), "purity")
        done = whole if done is None else done.unionByName(whole)
        split = here.filter("agree >= 0")
        if split.isEmpty():
            return done
        split = split.withColumn("node", _under(F.col("node"), F.slice("rest", F.lit(1), F.col("agree"))))
        split = split.withColumn("child", F.try_element_at("rest", F.col("agree") + 1)).withColumn("rest", F.slice("rest", F.col("agree") + 2, F.greatest(F.size("rest"), F.lit(1))))

        # rare children become one wildcard, but for those whose labels stand out
        children = saved(split.groupBy(*node, "child").agg(*[F.sum(c).alias(c) for c in ("n", "l", "b")], F.first("purity").alias("purity")), "url-children")
        total = children.groupBy(*node).agg(F.count("child").alias("kinds"), F.sum("n").alias("all"))
        children = children.join(total, node)
        children = children.withColumn("rare", F.col("child").isNotNull() & (F.col("kinds") > MANY_CHILDREN) & (F.col("n") * MANY_CHILDREN < F.col("all")))
        rare = children.filter("rare").groupBy(*node).agg(F.sum("l").alias("rare_l"), F.sum("b").alias("rare_b"))
        children = children.join(rare, node, "left")
        alike = _z(F.col("b"), F.col("l"), F.col("rare_b") - F.col("b"), F.col("rare_l") - F.col("l")) < Z_SAME
        children = children.select(*node, "child", F.when(F.col("rare") & alike, F.lit("*")).otherwise(F.col("child")).alias("name"), "l", "b", "purity")

        # labelled branches of the same share are pooled first, so a list holds each share once
        branches = children.groupBy(*node, "name").agg(F.sum("l").alias("l"), F.sum("b").alias("b"), F.first("purity").alias("above"))
        branches = branches.withColumn("share", F.try_divide("b", "l"))
        shares = branches.filter("l > 0").groupBy(*node, "share").agg(F.sum("b").alias("b"), F.sum("l").alias("l"))
        pools = shares.groupBy(*node).agg(F.collect_list(F.struct("share", "b", "l")).alias("all")).select(*node, F.explode(pools_of("all")).alias("pool"))
        pools = pools.select(*node, "pool.share", F.col("pool.b").alias("pool_b"), F.col("pool.l").alias("pool_l"), "pool.pools")
        branches = branches.join(pools, [*node, "share"], "left")
        own = F.when(F.col("l") == 0, PRIOR).when(F.col("pools") == 1, F.col("above")).otherwise(_purity(F.col("pool_b"), F.col("pool_l")))
        branches = branches.select(*[F.col(c).alias(f"_{c}") for c in (*node, "name")], own.alias("purity"))
        named = children.drop("purity").join(branches, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*node, "name")])
        named = saved(named.select(*[F.col(c).alias(f"_{c}") for c in (*node, "child")], "name", "purity"), "url-branches")

        split = split.drop("purity").join(named, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*node, "child")])
        done = done.unionByName(split.filter("child IS NULL").select("host", "shape", F.col("node").alias("template"), "purity"))
        open_ = split.filter("child IS NOT NULL").select("host", "shape", "n", "l", "b", F.concat_ws("/", "node", "name").alias("node"), "rest", "purity")


def _with(rows: DataFrame, facts: DataFrame, keys: list[str], spread: list[str]) -> DataFrame:
    """rows left joined with facts, one row for each of the keys: by broadcast up to BROADCAST_ROWS, else with a salt
    from the columns spread, so rows of one key are dealt over SALTS tasks."""
    facts = saved(facts, "url-facts")
    if facts.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(facts), keys, "left")
    salted = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")).join(salted, [*keys, "_salt"], "left").drop("_salt")


def across_hosts(tree: DataFrame, paths: DataFrame) -> DataFrame:
    """The tree (host, shape, template, purity) where templates without labels on their host have the purity that
    the template's labelled urls on other hosts give it."""
    rows = saved(_with(tree, paths.select("host", "shape", "l", "b"), ["host", "shape"], ["template"]), "url-tree")
    own = rows.groupBy("host", "template").agg(F.sum("l").alias("_own"))
    all_ = rows.groupBy("template").agg(F.sum("l").alias("_l"), F.sum("b").alias("_b")).filter("_l > 0")
    rows = _with(_with(rows.drop("l", "b"), own, ["host", "template"], ["shape"]), all_, ["template"], ["host", "shape"])
    elsewhere = F.when(F.col("_l").isNotNull(), _purity(F.col("_b"), F.col("_l"))).otherwise(PRIOR)
    return rows.select("host", "shape", "template", F.when(F.col("_own") > 0, F.col("purity")).otherwise(elsewhere).alias("purity"))


def judged(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) of every page."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("_rule", matching_rule(F.col("host"), F.col("path"), rules))
    rows = rows.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.col("_rule.verdict").alias("verdict"), _shape(F.col("path")).alias("shape"))
    paths = rows.select("host", "path", "verdict", "shape").dropDuplicates(["host", "path"])
    paths = paths.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), F.count("verdict").alias("l"), F.count_if(F.col("verdict") == "block").alias("b"))
    paths = saved(paths, "url-paths")
    tree = across_hosts(templates(paths), paths)
    tree = tree.select(F.col("host").alias("_h"), F.col("shape").alias("_s"), F.when(F.col("template") == "", "/").otherwise(F.col("template")).alias("template"), "purity")

    same = [F.col("host") == F.col("_h"), F.col("shape") == F.col("_s")]
    if tree.count() <= BROADCAST_ROWS:
        out = rows.join(F.broadcast(tree), on=same, how="left")
    else:
        salted = tree.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int")
        out = rows.withColumn("salt", salt).join(salted, on=[*same, F.col("salt") == F.col("_salt")], how="left")
    own = F.when(F.col("purity") >= THRESHOLD, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"), "template", "purity")


def _purity(blocked: Column, labelled: Column) -> Column:
    """Blocked share smoothed by the prior."""
    return (blocked + SMOOTHING * PRIOR) / (labelled + SMOOTHING)
