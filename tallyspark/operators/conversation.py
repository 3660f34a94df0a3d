"""What a conversation asks for so far: slots of each request, carried from turn to turn.

A request that stands by itself begins anew. A follow-up takes over what was asked before and overrides
the slots it names itself; filters are merged by their key. As the state after a turn is, for each slot,
its last value since the last request that stood by itself, no turn has to wait for another: blocks of
turns are worked on by themselves, and what earlier blocks leave over is joined to each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns of a conversation in one block.
BLOCK = 1024
#: A request of more words stands by itself.
SHORT = 6
#: Words that make a short request a follow-up.
FOLLOW_UP = "top bottom only now instead same active inactive branch district customer currency ascending descending highest lowest today yesterday usd eur gbp etb birr".split()
#: Beginnings of a whole report request.
OPENINGS = ["show ", "generate ", "give me ", "display ", "list "]
#: The words for a currency, in the order they are looked for.
CURRENCIES = {
    "usd": "USD",
    "dollar": "USD",
    "dollars": "USD",
    "eur": "EUR",
    "euro": "EUR",
    "euros": "EUR",
    "gbp": "GBP",
    "pound": "GBP",
    "pounds": "GBP",
    "etb": "ETB",
    "birr": "ETB",
    "aed": "AED",
    "jpy": "JPY",
    "yen": "JPY",
}
#: Phrases for a period, in the order they are looked for.
PERIODS = ["today", "yesterday", "this month", "last month", "this year", "last year"]
#: Words for an order, ascending and descending.
ASCENDING = ["lowest to highest", "ascending", "asc order", "smallest to largest"]
DESCENDING = ["highest to lowest", "descending", "desc order", "largest to smallest"]
#: Words for a ranking from the top and from the bottom.
TOP, BOTTOM = ["top", "highest", "largest", "most"], ["bottom", "lowest", "smallest", "least"]
DIMENSIONS = ["branch", "district", "customer", "currency"]
#: Slots whose values filter rows; their merged values are the filters.
FILTERS = ["branch", "currency", "district"]
SLOTS = ["measure", "dimension", "status", "ranking", "limit", "sort_direction", "district", "branch", "currency", "period"]


def _any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def _first(text: Column, cases: list[tuple[Column, str]]) -> Column:
    out = F.lit(None).cast("string")
    for test, value in reversed(cases):
        out = F.when(test, value).otherwise(out)
    return out


def is_follow_up(prompt: Column) -> Column:
    """A short request with a word that refers to what was asked before, and no whole report request."""
    text = F.trim(F.regexp_replace(F.lower(prompt), r"\s+", " "))
    whole = text.contains("report") & reduce(lambda a, b: a | b, [text.startswith(x) for x in OPENINGS])
    return ~whole & (F.size(F.split(text, " ")) <= SHORT) & _any(text, FOLLOW_UP)


def slots(prompt: Column) -> dict[str, Column]:
    """What a request names, slot by slot; null where it doesn't."""
    original = F.trim(F.regexp_replace(prompt, r"\s+", " "))
    text = F.lower(original)
    counts = _any(text, ["number", "how many", "count"])
    balance = text.contains("balance")
    ranking = _first(text, [(_any(text, TOP), "top"), (_any(text, BOTTOM), "bottom")])
    order = _first(text, [(_any(text, ASCENDING), "ascending"), (_any(text, DESCENDING), "descending")])
    order = F.when(ranking == "top", "descending").when(ranking == "bottom", "ascending").otherwise(order)
    limit = F.regexp_extract(text, r"\b(?:top|bottom|first|last) (\d+)\b", 1).try_cast("long")
    named = lambda what: F.nullif(F.trim(F.regexp_extract(original, rf"(?i)\b(?:only|for|in) (.+?\b{what})\b", 1)), F.lit(""))
    return {
        "measure": _first(text, [(balance & counts, "count_and_balance"), (balance, "balance"), (counts, "count"), (text.contains("account") & _any(text, ["report", "active"]), "count")]),
        "dimension": _first(text, [(text.contains(x), x) for x in DIMENSIONS]),
        "status": _first(text, [(text.contains("inactive"), "inactive"), (text.contains("active"), "active")]),
        "ranking": ranking,
        # an order without a ranking sorts all rows
        "limit": F.when(ranking.isNotNull() | order.isNull(), limit),
        "sort_direction": order,
        "district": named("district"),
        "branch": named("branch"),
        "currency": _first(text, [(text.rlike(rf"\b{word}\b"), code) for word, code in CURRENCIES.items()]),
        "period": _first(text, [(text.contains(p), p.replace(" ", "_")) for p in PERIODS]),
    }


def carried(rows: DataFrame, key: str, order: list[str], fresh: str, columns: list[str], block: int = BLOCK) -> DataFrame:
    """rows with each of the columns replaced by its last value that isn't null since the last row, of the
    same key, that is fresh, that row included. order[0] is a whole number; rows without it or a key go.

    A key of any size is no single group: its rows are sorted in blocks, and one row a block is carried on."""
    rows = rows.filter(F.col(key).isNotNull() & F.col(order[0]).isNotNull()).withColumn("_block", F.floor(F.col(order[0]) / block))
    within = Window.partitionBy(key, "_block").orderBy(*order)
    rows = rows.withColumn("_part", F.sum(F.col(fresh).cast("int")).over(within))
    same = Window.partitionBy(key, "_block", "_part").orderBy(*order)
    rows = rows.select("*", *[F.last(c, ignorenulls=True).over(same).alias(f"_now_{c}") for c in columns])
    # the state that a block leaves is that of its last row
    state = [F.col(f"_now_{c}").alias(c) for c in columns]
    ends = rows.groupBy(key, "_block").agg(F.max_by(F.struct("_part", *state), F.struct(*order)).alias("_end"))
    ends = ends.select(key, "_block", *[F.col(f"_end.{c}").alias(c) for c in columns], F.col("_end._part").alias("_part"))
    blocks = Window.partitionBy(key).orderBy("_block")
    ends = ends.withColumn("_era", F.sum(F.when(F.col("_part") > 0, 1).otherwise(0)).over(blocks))
    era = Window.partitionBy(key, "_era").orderBy("_block")
    after = ends.select(key, "_block", F.struct(*[F.last(c, ignorenulls=True).over(era).alias(c) for c in columns]).alias("_after"))
    before = after.select(key, "_block", F.lag("_after").over(blocks).alias("_before"))
    rows = rows.join(before, [key, "_block"])
    values = {c: F.coalesce(f"_now_{c}", F.when(F.col("_part") == 0, F.col(f"_before.{c}"))) for c in columns}
    return rows.withColumns(values).drop("_block", "_part", "_before", *[f"_now_{c}" for c in columns])


def contexts(requests: DataFrame) -> DataFrame:
    """(conv_id, turn, follow_up, slots.., filters, previous_prompt): the state after each request (conv_id, turn,
    prompt) of a conversation. A blank or null prompt names nothing and is no follow-up, so it begins anew."""
    rows = requests.withColumn("prompt", F.coalesce("prompt", F.lit("")))
    rows = rows.select("conv_id", "turn", "prompt", is_follow_up(F.col("prompt")).alias("follow_up"))
    rows = rows.withColumns(slots(F.col("prompt"))).withColumn("_fresh", ~F.col("follow_up"))
    out = carried(rows, "conv_id", ["turn", "prompt"], "_fresh", SLOTS)
    pairs = F.filter(F.array(*[F.struct(F.lit(f).alias("key"), F.col(f).alias("value")) for f in FILTERS]), lambda p: p["value"].isNotNull())
    return out.select("conv_id", "turn", "follow_up", *SLOTS, F.map_from_entries(pairs).alias("filters"), F.trim(F.regexp_replace("prompt", r"\s+", " ")).alias("previous_prompt"))
