"""Operators on rows made for the case."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import dates
from tallyspark.functions import text as T
from tallyspark.operators import series, trading
from tallyspark.operators.predicates import predicate
from tallyspark.operators.report import Join, path
from tallyspark.sources import upsert


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column).first()[0]


@pytest.mark.parametrize(
    ("op", "months", "want"),
    [
        ("this_month", 1, (date(1998, 7, 1), date(1998, 8, 1))),
        ("last_month", 1, (date(1998, 6, 1), date(1998, 7, 1))),
        ("next_year", 1, (date(1999, 1, 1), date(2000, 1, 1))),
        ("this_week", 1, (date(1998, 7, 13), date(1998, 7, 20))),
        ("last_day", 1, (date(1998, 7, 14), date(1998, 7, 15))),
        ("rolling_months", 3, (date(1998, 4, 1), date(1998, 7, 1))),
    ],
)
def test_date_ranges(op, months, want):
    assert dates.date_range(op, date(1998, 7, 15), months) == want


def test_rolling_months_are_bounded():
    for n in (0, 121):
        with pytest.raises(ValueError):
            dates.date_range("rolling_months", date(1998, 7, 15), n)


@pytest.mark.parametrize(("given", "want"), [('["a"," b ","a",""]', ["a", "b"]), ("x, y;x\n z", ["x", "y", "z"]), ("", [])])
def test_lists(spark, given, want):
    assert one(spark, T.listed(F.col("c")), given) == want


def test_text_functions(spark):
    assert one(spark, T.normalized(F.col("c")), "Open__Trips - 2024!") == "open trips 2024"
    assert one(spark, T.tokens(F.col("c")), None) == []
    assert [one(spark, T.singular(F.col("c")), w) for w in ("policies", "boxes", "trips", "glass")] == ["policy", "box", "trip", "glass"]
    assert one(spark, T.intent(F.col("c")), "how many trips, then drop them") == "blocked"
    assert one(spark, T.financial_number(F.col("c")), "(1,234)") == -1234


def test_predicates(spark):
    df = spark.createDataFrame([(1, "ab"), (5, None), (9, "cd")], "n int, s string")
    ids = lambda c: [r.n for r in df.filter(c).orderBy("n").collect()]
    assert ids(predicate("n", "between_or_between", "1,2|9,10")) == [1, 9]
    assert ids(predicate("s", "is_null")) == [5]
    assert ids(predicate("s", "contains", "b")) == [1]
    with pytest.raises(ValueError):
        predicate("n", "in", [])


def test_joins_take_the_fewest_steps():
    joins = [Join("a", "x", "b", "x"), Join("b", "y", "c", "y"), Join("a", "z", "c", "z")]
    assert path(joins, "a", "c") == [joins[2]]
    with pytest.raises(ValueError):
        path(joins, "a", "lost")


def points(spark, values):
    rows = [("k", datetime(2024, 1 + i, 1), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "k string, period timestamp_ntz, v double")


def test_forecasts(spark):
    rows = series.forecast(points(spark, [10, 20, 30, 40]), ["k"], "v", 2).orderBy("period").collect()
    assert [(r.period, round(r.forecast, 6)) for r in rows] == [(date(2024, 5, 1), 50.0), (date(2024, 6, 1), 60.0)]
    assert series.forecast(points(spark, [1, 2, 3]), ["k"], "v").count() == 0
    assert {r.forecast for r in series.forecast(points(spark, [30, 20, 10, 1]), ["k"], "v", 3).collect()} == {0.0}
    assert {round(r.forecast, 6) for r in series.forecast(points(spark, [7, 7, 7, 7]), ["k"], "v", 3).collect()} == {7.0}


def test_trades(spark):
    pnl = [10.0, -4.0, -3.0, None, -1.0, 5.0]
    df = spark.createDataFrame([("a", i, p) for i, p in enumerate(pnl)], "k string, i int, pnl double")
    rows = trading.equity(df, ["k"], ["i"]).orderBy("i").collect()
    assert [r.equity for r in rows] == [10, 6, 3, 3, 2, 7] and [r.drawdown for r in rows] == [0, -4, -7, -7, -8, -3]
    assert trading.losing_streak(df, ["k"], ["i"]).first().streak == 2
    won = spark.createDataFrame([("a", 1.0)], "k string, pnl double")
    assert trading.summary(won, ["k"]).first().profit_factor == 0.0


def test_upsert(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (None, "d"), (3, "e")], "k int, v string")
    assert sorted(tuple(r) for r in upsert(old, new, ["k"]).collect()) == [(1, "a"), (2, "c"), (3, "e")]


def test_orders_without_a_limit_give_every_row(spark):
    from tallyspark import catalogue

    d, q = "/root/testdata/sf0.001", catalogue.queries()
    months = q["o_timeseries_order_all"](spark, d).collect()
    assert len(months) > 24 and sorted(r.place for r in months) == list(range(1, len(months) + 1))
    customers = q["o_nulls_last_all"](spark, d)
    assert customers.count() == spark.read.parquet(f"{d}/customer.parquet").count()
    assert q["o_natural_section_sort_all"](spark, d).count() == spark.read.parquet(f"{d}/part.parquet").count() > 100
