"""Calendar, alignment, dataset, clustering, labels, orders and tables on small hand-made frames."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barloom.functions.nearest import nearest_centroid
from barloom.operators import align, calendar, dataset, kmeans, labels, orders, scoring
from barloom.params import Trading
from barloom.sources import bars as bar_tables
from barloom.sources import model
from barloom.sources import orders as order_tables
from barloom.sources import shared

BARS = "ticker string, ts timestamp_ntz, open double, high double, low double, close double, volume long"


def bar(ticker, ts, close, volume=1):
    return (ticker, ts, close, close + 1, close - 1, close, volume)


def test_holidays_of_known_years(spark):
    ranges = spark.createDataFrame([(date(2020, 1, 1), date(2024, 12, 31))], "start date, end date")
    got = {r.date: r.holiday for r in calendar.market_holidays(ranges).collect()}
    assert len(got) == 45
    good_fridays = {date(2020, 4, 10), date(2021, 4, 2), date(2022, 4, 15), date(2023, 4, 7), date(2024, 3, 29)}
    assert {d for d, n in got.items() if n == "Good Friday"} == good_fridays
    for day in (date(2020, 7, 3), date(2021, 7, 5), date(2021, 12, 24), date(2022, 12, 26), date(2024, 11, 28), date(2024, 5, 27), date(2024, 1, 15), date(2024, 2, 19), date(2024, 9, 2)):
        assert day in got


def test_minute_grid_has_781_rows_a_day(spark):
    ranges = spark.createDataFrame([(date(2024, 1, 1), date(2024, 1, 16))], "start date, end date")
    days = calendar.open_days(ranges)
    assert days.count() == 10
    counts = calendar.minute_grid(days).groupBy("date").count().collect()
    assert {r["count"] for r in counts} == {781}
    first = calendar.minute_grid(days).orderBy("ts").first()
    assert first.ts == datetime(2024, 1, 2, 4, 0) and first.minute_no == 1


def test_asof_carries_over_days_and_prefers_exact_bars(spark):
    days = [date(2024, 1, 2), date(2024, 1, 3), date(2024, 1, 5)]
    grid = calendar.minute_grid(spark.createDataFrame([("T", d, i + 1) for i, d in enumerate(days)], "ticker string, date date, session_no int"))
    bars = spark.createDataFrame(
        [bar("T", datetime(2024, 1, 2, 10, 0), 5.0, 7), bar("T", datetime(2024, 1, 2, 20, 0), 6.0), bar("T", datetime(2024, 1, 4, 10, 0), 7.0), bar("T", datetime(2024, 1, 5, 10, 0), 8.0)], BARS
    )
    got = {r.ts: r for r in align.asof_align(grid, bars).collect()}
    close = lambda d, h, m=0: got[datetime(2024, 1, d, h, m)].close
    assert close(2, 9, 59) is None and close(2, 10) == 5.0 and close(2, 17) == 5.0
    assert close(3, 4) == 6.0 and close(3, 17) == 6.0 and close(5, 4) == 7.0 and close(5, 10) == 8.0
    assert got[datetime(2024, 1, 2, 10, 0)].volume == 7 and got[datetime(2024, 1, 2, 10, 1)].volume == 0
    carried = {r.ts: r.volume for r in align.asof_align(grid, bars, carry_volume=True).collect()}
    assert carried[datetime(2024, 1, 2, 10, 1)] == 7


def test_dedupe_and_last_n(spark):
    at = datetime(2024, 1, 2, 10, 0)
    bars = spark.createDataFrame([bar("T", at, 5.0, 1), bar("T", at, 5.0, 1), bar("T", at, 6.0, 2)], BARS)
    assert [(r.close, r.volume) for r in align.dedupe_bars(bars).collect()] == [(6.0, 2)]
    rows = spark.createDataFrame([("T", i) for i in range(5)], "ticker string, date int")
    assert sorted((r.days_ago, r.date) for r in align.last_n(rows, 3).collect()) == [(1, 4), (2, 3), (3, 2)]


def test_candles_round_trip_and_bad_bodies(spark):
    body = '{"candles":[{"datetime":1704207600000,"open":1.5,"close":2.5,"high":3,"low":1,"volume":9}]}'
    got = bar_tables.read_candles_json(spark.createDataFrame([("T", body), ("U", "{}"), ("V", "no json"), ("W", None)], "ticker string, body string")).collect()
    assert [(r.ticker, r.ts, r.close, r.volume) for r in got] == [("T", datetime(2024, 1, 2, 7, 0), 2.5, 9)]


def test_bar_tables(spark, tmp_path):
    path = str(tmp_path / "bars")
    rows = [bar("T", datetime(2024, 1, d, 10, 0), float(d)) for d in range(2, 6)]
    bar_tables.write_bars(spark.createDataFrame(rows, BARS), path, "minute")
    bar_tables.write_bars(spark.createDataFrame(rows, BARS), path, "daily")
    got = bar_tables.read_bars(spark, path, date(2024, 1, 3), date(2024, 1, 4), "minute")
    assert sorted(r.close for r in got.collect()) == [3.0, 4.0]
    assert bar_tables.read_bars(spark, path, date(2024, 7, 4), date(2024, 7, 5), "daily").count() == 2
    assert bar_tables.read_bars(spark, path, date(2024, 1, 1), date(2024, 1, 9), "minute", ["X"]).count() == 0
    new = spark.createDataFrame([bar("T", datetime(2024, 1, 3, 11, 0), 30.0)], BARS)
    bar_tables.replace_slice(spark, path, date(2024, 1, 3), date(2024, 1, 4), "minute", new)
    assert sorted(r.close for r in bar_tables.read_bars(spark, path, date(2024, 1, 1), date(2024, 1, 9), "minute").collect()) == [2.0, 5.0, 30.0]
    assert bar_tables.read_bars(spark, path, date(2024, 7, 1), date(2024, 7, 5), "daily").count() == 4  # other frequencies stay


def test_a_slice_is_replaced_at_once_or_not_at_all(spark, tmp_path):
    path, day = str(tmp_path / "bars"), lambda n: date(2024, 1, n)
    old = [bar("T", datetime(2024, 1, d, 10, m), float(d)) for d in range(2, 6) for m in range(3)]
    bar_tables.write_bars(spark.createDataFrame(old, BARS), path, "minute")
    read = lambda: bar_tables.read_bars(spark, path, day(1), day(9), "minute")
    before = sorted(r.close for r in read().collect())
    # a failure halfway: some files are written, nothing is told
    new = spark.createDataFrame([bar("T", datetime(2024, 1, d, 11, 0), 10.0 * d) for d in (3, 4)], BARS)
    broken = new.withColumn("close", F.when(F.dayofmonth("ts") == 4, F.raise_error(F.lit("halfway")).cast("double")).otherwise(F.col("close")))
    with pytest.raises(Exception, match="halfway"):
        bar_tables.replace_slice(spark, path, day(3), day(5), "minute", broken)
    assert sorted(r.close for r in read().collect()) == before
    # a reader that has begun goes on with the old bars, another one sees the new ones
    begun = read()
    bar_tables.replace_slice(spark, path, day(3), day(5), "minute", new)
    assert sorted(r.close for r in begun.collect()) == before
    assert sorted(r.close for r in read().collect()) == [2.0] * 3 + [30.0, 40.0]
    bar_tables.replace_slice(spark, path, day(1), day(9), "minute", new.limit(0))
    assert read().count() == 0 and read().columns == begun.columns


def test_other_tickers_row_groups_are_not_read(spark, tmp_path):
    path = str(tmp_path / "bars")
    rows = spark.range(60_000).select(
        F.concat(F.lit("T"), F.lpad((F.col("id") % 40).cast("string"), 2, "0")).alias("ticker"),
        (F.lit(datetime(2024, 1, 3)).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id").cast("decimal(18,6)"))).alias("ts"),
        *[F.rand(c).alias(n) for c, n in enumerate(("open", "high", "low", "close"))],
        F.col("id").alias("volume"),
    )
    bar_tables.write_bars(rows, path, "minute", row_group=100_000)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        one = bar_tables.read_bars(spark, path, date(2024, 1, 1), date(2024, 1, 9), "minute", ["T07"])
        plan = one._jdf.queryExecution().executedPlan()
        assert len(one.collect()) == 1500
        assert one._jdf.queryExecution().executedPlan().equals(plan)
        rows_read = [plan.collectLeaves().apply(i).metrics().apply("numOutputRows").value() for i in range(plan.collectLeaves().size())]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(rows_read) < 10_000  # of 60000


def test_order_tables(spark):
    stored = spark.createDataFrame([(" 1 ", "A", 1.005, "x"), ("2", "B", 2.0, "y")], "sell_order_id string, ticker string, price double, date string")
    assert order_tables.clean_open_orders(stored).first().sell_order_id == "1"
    current = spark.createDataFrame([("9", "A", 3.0, "z")], stored.schema)
    assert sorted(r.sell_order_id for r in order_tables.refresh_open_orders(stored, current).collect()) == ["2", "9"]
    assert order_tables.order_log(stored, ["ticker", "price"]).columns == ["ticker", "price"]


def test_model_tables(spark, tmp_path):
    a, b = (spark.createDataFrame([(t, 1) for t in ts], "ticker string, x int") for ts in ("AB", "BC"))
    model.save_model_tables(str(tmp_path), centroids=a, labels=b)
    got = model.load_model_tables(spark, str(tmp_path), ("centroids", "labels"))
    assert {p: [r.ticker for r in t.collect()] for p, t in got.items()} == {"centroids": ["B"], "labels": ["B"]}
    with pytest.raises(ValueError):
        model.save_model_tables(str(tmp_path), other=a)


def test_thresholds_categories_and_split(spark):
    n = 50
    rows = spark.createDataFrame([("T", i, float(i)) for i in range(n)] + [("few", 0, 1.0)], "ticker string, i int, gain double")
    t = dataset.rank_thresholds(rows)
    assert [r.t for r in t.orderBy("i").collect()] == [float(-(-n * i // 8)) for i in range(1, 8)]
    sizes = [r["count"] for r in dataset.categorize(rows, t).groupBy("cat").count().orderBy("cat").collect()]
    assert sizes[0] == -(-n // 8) + 1 and sizes[-1] == n // 8 - 1 and sum(sizes) == n
    near = [r.t for r in dataset.rank_thresholds(rows, approximate=True).orderBy("i").collect()]
    assert all(abs(a - b) <= 1 for a, b in zip(near, [r.t for r in t.orderBy("i").collect()], strict=True))
    split = {r.i: r.split for r in dataset.chrono_split(rows.where("ticker = 'T'"), "i").collect()}
    assert [split[i] for i in (0, 30, 31, 40, 41, 49)] == ["train", "train", "test1", "test1", "test2", "test2"]


def test_scaling(spark):
    rows = spark.createDataFrame([("T", 1.0, 5.0), ("T", 3.0, 5.0), ("U", None, 1.0)], "ticker string, a double, b double")
    s = dataset.feature_min_max(rows, ["a", "b"])
    assert sorted((r.ticker, r.feature) for r in dataset.dropped_features(s).collect()) == [("T", "b"), ("U", "a"), ("U", "b")]
    got = sorted(((r.a, r.b) for r in dataset.min_max_scale(rows, s, ["a", "b"]).collect()), key=str)
    assert got == [(0.0, None), (1.0, None), (None, None)]


def test_nearest_centroid_ties_and_both_ways(spark):
    points = spark.createDataFrame([("T", 1, [0.0, 0.0]), ("T", 2, [9.0, 9.0]), ("none", 3, [0.0, 0.0])], "ticker string, row_id int, features array<double>")
    centers = spark.createDataFrame([("T", 1, [1.0, 0.0, 5.0]), ("T", 0, [0.0, 1.0, 7.0]), ("T", 2, [9.0, 8.0, 1.0])], "ticker string, cluster long, center array<double>")
    for most in (10_000, 0):
        got = {r.row_id: (r.cluster, r.distance) for r in nearest_centroid(points, centers, most=most).collect()}
        assert got == {1: (0, 1.0), 2: (2, 1.0)}


def test_kmeans(spark):
    rows = [("T", i, [float(i % 2) * 10 + i / 100, 0.0]) for i in range(40)]
    points = kmeans.restarts(spark.createDataFrame(rows, "ticker string, row_id int, features array<double>"), 2)

    def inertia(c):
        return kmeans.assign_clusters(points, c).selectExpr("sum(distance * distance)").first()[0]

    c = kmeans.initial_centroids(points, 2)
    values = [inertia(c)]
    for _ in range(3):
        c = kmeans.kmeans_step(points, c)
        values.append(inertia(c))
    assert all(b <= a + 1e-9 for a, b in zip(values, values[1:], strict=False))
    fitted = kmeans.kmeans_fit(points, 2, 20)
    assert fitted.groupBy("run").count().count() == 2
    assert inertia(fitted) <= values[-1] + 1e-9
    assert kmeans.initial_centroids(points, 41).count() == 0


def counts(spark, mixes):
    """mixes: cluster -> split -> {cat: n}"""
    rows = [("T", s, c, cat, m.get(cat, 0)) for c, splits in mixes.items() for s, m in splits.items() for cat in range(8)]
    return spark.createDataFrame(rows, "ticker string, split string, cluster long, cat int, n long")


def test_labels(spark):
    thresholds = spark.createDataFrame([("T", i, float(i - 3)) for i in range(1, 8)], "ticker string, i int, t double")
    three = lambda m: dict.fromkeys(labels.SPLITS, m)
    mixes = {
        0: three({7: 95, 0: 5}), 1: three({6: 70, 2: 30}), 2: three({7: 40, 2: 30, 1: 30}), 3: three({0: 95, 7: 5}), 4: three({1: 70, 5: 30}), 5: three({0: 40, 5: 30, 6: 30}),
        6: {**three({7: 95}), "test2": {0: 9}}, 7: {"train": {7: 9}, "test1": {7: 9}}, 8: {"test1": {7: 9}}, 9: three({3: 5, 7: 5}),
    }
    c = counts(spark, mixes)
    got = {r.cluster: r.label for r in labels.label_clusters(c, thresholds).collect()}
    assert got == {0: "Strong Buy", 1: "Buy", 2: "Weak Buy", 3: "Strong Sell", 4: "Sell", 5: "Weak Sell", 6: "Neutral", 7: "Neutral", 9: "Neutral"}
    assert {r.cluster: r["mode"] for r in labels.cluster_mode(c).where("split = 'train' and cluster in (0, 9)").collect()} == {0: 7, 9: 3}
    for signs, s in (([1.0] * 7, 0), ([-1.0] * 7, 0)):
        t = spark.createDataFrame([("T", i + 1, x) for i, x in enumerate(signs)], "ticker string, i int, t double")
        assert labels.split_point(t).first().s == s


def test_best_strong_buys(spark):
    rows = [(run, "T", c, "Strong Buy", share) for run, c, share in ((0, 1, 0.95), (0, 2, 0.99), (1, 1, 0.97), (1, 2, 0.95))] + [(0, "T", 5, "Sell", 0.0)]
    df = spark.createDataFrame(rows, "run int, ticker string, cluster long, label string, top_share double")
    got = {(r.run, r.cluster): r.label for r in labels.best_strong_buys(df).collect()}
    assert got == {(0, 1): "Strong Buy", (0, 2): "Strong Buy", (1, 1): "Strong Buy", (1, 2): "Buy", (0, 5): "Sell"}
    assert labels.strong_buy_count(df).first().n_strong_buy == 4


def test_orders(spark):
    t = datetime(2024, 1, 2, 10, 0)
    hour = timedelta(hours=1)
    o = spark.createDataFrame([("A", t, 1, 5.0, 2), ("A", t, 2, 1.0, 3), ("A", t + 40 * hour, 3, 9.0, 1)], "ticker string, placed_ts timestamp_ntz, order_id long, limit_price double, quantity int")
    q = spark.createDataFrame([("A", t - hour, 1.0, 2.0, 1.5), ("A", t + hour, 6.0, 6.5, 6.2), ("A", t + 30 * hour, 5.0, 5.5, 5.2), ("A", t + 31 * hour, 4.0, 4.4, 4.2), ("A", t + 60 * hour, 7.0, 11.0, 9.0)], "ticker string, ts timestamp_ntz, bid double, ask double, price double")
    touch = {r.order_id: r.touch_ts for r in orders.buy_touch(o, q).collect()}
    assert touch == {1: t + 30 * hour, 2: None, 3: t + 60 * hour}
    f = {r.order_id: (r.state, r.buy_ts, r.sell_ts, r.sell_price) for r in orders.fills(o, q).collect()}
    assert f[1] == ("past", t + 30 * hour, t + 60 * hour, 6.0) and f[2] == ("open", None, None, None)
    assert f[3] == ("past", t + 60 * hour, t + 60 * hour, 10.8)
    stock = spark.createDataFrame([(9, "A", t, 2.5, 4)], "order_id long, ticker string, buy_ts timestamp_ntz, buy_price double, quantity int")
    b = orders.total_balance(o, stock, 300.0).first()
    assert (float(b.in_orders), float(b.in_stock), float(b.total)) == (22.0, 10.0, 332.0)


def test_sell_and_cancel_decisions(spark):
    now = datetime(2024, 1, 10, 12, 0)
    day = timedelta(days=1)
    schema = "order_id long, ticker string, buy_ts timestamp_ntz, buy_price double, limit_sell_id long, limit_sell_price double"
    stock = [(1, "A", now - day, 10.0, None, 0.0), (2, "A", now - day, 10.0, 7, 20.0), (3, "B", now - day, 10.0, 7, 20.0), (4, "A", now - 5 * day, 10.0, 7, 20.0), (5, "A", now - 5 * day, 10.0, 7, 9.0), (6, "A", now, 10.0, None, 0.0)]
    latest = spark.createDataFrame([("A", 12.0, 12.5), ("B", 12.0, 12.5)], "ticker string, bid double, price double")
    names = spark.createDataFrame([("A", "Weak Sell"), ("B", "Buy")], "ticker string, label string")
    last = spark.createDataFrame([("A", 0.1)], "ticker string, t_last double")
    got = {r.order_id: (r.action, round(r.price, 6)) for r in orders.sell_decisions(spark.createDataFrame(stock, schema), latest, names, last, now).collect()}
    assert got == {1: ("place", 12.0), 2: ("replace", 12.5), 4: ("replace", 12.5)}
    o = spark.createDataFrame([("A", now - timedelta(minutes=11), 1, 5.0, 2), ("A", now - timedelta(minutes=9), 2, 5.0, 2), ("C", now - day, 3, 5.0, 2)], "ticker string, placed_ts timestamp_ntz, order_id long, limit_price double, quantity int")
    buys = spark.createDataFrame([("C", "Strong Buy")], "ticker string, label string")
    assert [(r.order_id, float(r.refund)) for r in orders.cancel_decisions(o, buys, now).collect()] == [(1, 10.0)]


def test_buying(spark):
    assert Trading().number_of_buys(300.0) == 3 and Trading(available=50.0).number_of_buys(300.0) == 0
    scores = spark.createDataFrame([("A", "Strong Buy"), ("B", "Strong Buy"), ("C", "Buy"), ("D", "Strong Buy")], "ticker string, label string")
    t = spark.createDataFrame([(x, i, float(ord(x) * i)) for x in "ABCD" for i in (1, 7)], "ticker string, i int, t double")
    assert [r.ticker for r in scoring.pick_buys(scores, t, 300.0, Trading(available=250.0)).collect()] == ["D", "B"]
    latest = spark.createDataFrame([("A", 50.0), ("B", 101.0), ("C", 1.0)], "ticker string, price double")
    volume = spark.createDataFrame([("A", 1000.0), ("B", 1e9), ("C", 10.0)], "ticker string, avg_volume double")
    assert [r.ticker for r in orders.tradable(latest, volume, 300.0).collect()] == ["A"]


def test_future_close_refuses_other_units(spark):
    with pytest.raises(ValueError):
        dataset.future_close(spark.range(1), 1, "week")


def test_ranks_are_exact_however_the_pieces_fall(spark):
    from barloom.operators.ranks import with_rank

    rng = random.Random(5)
    rows = [("hot", float(rng.randint(0, 400))) for _ in range(3000)] + [("few", 2.0), ("few", 1.0), ("few", None), ("one", None)]
    df = spark.createDataFrame(rows, "ticker string, x double").repartition(5)
    for pieces in (2, 7, 128):
        got = with_rank(df, "ticker", "x", pieces=pieces).collect()
        assert len(got) == len(rows)
        for t in ("hot", "few", "one"):
            own = sorted((r["_i"], r["x"]) for r in got if r["ticker"] == t)
            assert [i for i, _ in own] == list(range(len(own))) and {r["_n"] for r in got if r["ticker"] == t} == {len(own)}
            values = [-1.0 if x is None else x for _, x in own]
            assert values == sorted(values)
    assert with_rank(df.limit(0), "ticker", "x").count() == 0


def test_first_touch_equals_looking_at_every_quote(spark):
    rng = random.Random(6)
    at = lambda: datetime(2024, 1, 1) + timedelta(milliseconds=rng.choice((rng.randrange(3 * 86_400_000), rng.randrange(40) * 500)))
    quotes = [("A", at(), float(rng.randint(1, 99)), float(rng.randint(1, 99))) for _ in range(1500)] + [("B", at(), 50.0, 50.0), ("A", at(), None, None)]
    placed = [("A" if i % 9 else "C", at(), i, rng.choice((0.5, 1.0, 2.0, 3.0, 60.0)), 1) for i in range(300)] + [("B", datetime(2024, 1, 1), 300, 50.0, 1), ("B", datetime(2024, 2, 1), 301, 50.0, 1), ("A", at(), 302, None, 1), ("A", None, 303, 1.0, 1)]
    q = spark.createDataFrame(quotes, "ticker string, ts timestamp_ntz, bid double, ask double")
    o = spark.createDataFrame(placed, "ticker string, placed_ts timestamp_ntz, order_id long, limit_price double, quantity int")
    got = {r.order_id: r.touch_ts for r in orders.buy_touch(o, q).collect()}
    want = {i: min((ts for qt, ts, bid, _ in quotes if since and limit and qt == t and bid is not None and ts >= since and bid <= limit), default=None) for t, since, i, limit, _ in placed}
    assert got == want
    stock = o.withColumnsRenamed({"placed_ts": "buy_ts", "limit_price": "limit_sell_price"}).withColumn("limit_sell_price", F.when(F.col("order_id") == 5, 0.0).otherwise(100 - F.col("limit_sell_price")))
    got = {r.order_id: r.touch_ts for r in orders.sell_touch(stock, q).collect()}
    want = {i: min((ts for qt, ts, _, ask in quotes if since and limit and i != 5 and qt == t and ask is not None and ts >= since and ask >= 100 - limit), default=None) for t, since, i, limit, _ in placed}
    assert got == want


def test_no_order_meets_all_quotes_of_its_ticker(spark):
    """One ticker, one day: the joins hand on a row for each order, not for each pair."""
    ticker = F.concat(F.lit("A"), F.floor(F.col("id") / 1_000_000).cast("string")).alias("ticker")
    o = spark.range(2000).select(ticker, F.expr("timestamp_ntz '2024-01-02 10:00:00' + make_dt_interval(0, 0, 0, id)").alias("placed_ts"), F.col("id").alias("order_id"), F.lit(1.0).alias("limit_price"))
    q = spark.range(20_000).select(ticker, F.expr("timestamp_ntz '2024-01-02 09:00:00' + make_dt_interval(0, 0, 0, id)").alias("ts"), F.when(F.col("id") == 15_000, 1.0).otherwise(5.0).alias("bid"))
    touched = orders.buy_touch(o, q)
    assert touched.where("touch_ts = timestamp_ntz '2024-01-02 13:10:00'").count() == 2000
    plan = touched._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_orders_over_jdbc(spark, tmp_path):
    url, driver = f"jdbc:derby:{tmp_path}/book;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    schema = "buy_order_id string, ticker string, price double, quantity int, time_placed timestamp, time_filled timestamp, note string"
    rows = [(f" {i} ", "A", 1.005 + i, i, datetime(2024, 1, 1), None, "x") for i in range(3)]
    fills = spark.createDataFrame(rows, schema)
    for _ in range(2):  # appends
        order_tables.write_order_log(fills, url, "buys", order_tables.BUYS, driver)
    log = spark.read.jdbc(url, "buys", properties=driver)
    assert [c.lower() for c in log.columns] == order_tables.BUYS and log.count() == 6
    open_sells = spark.createDataFrame([(" s1 ", "A", 2.34567, datetime(2024, 1, 1).date(), " 1"), ("s2", "B", 3.0, None, None)], "sell_order_id string, ticker string, price double, date date, buy_order_id_link string")
    order_tables.write_order_log(open_sells, url, "open_sells", order_tables.OPEN_SELLS, driver)
    got = sorted(order_tables.read_open_orders(spark, url, "open_sells", driver).select("sell_order_id", "price", "buy_order_id_link").collect())
    assert [tuple(r) for r in got] == [("s1", 2.35, "1"), ("s2", 3.0, None)]


def test_orders_in_parallel_and_once(spark, tmp_path):
    url, driver = f"jdbc:derby:{tmp_path}/log;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    fills = spark.createDataFrame([(f"b{i}", "AB"[i % 2], float(i), i) for i in range(100)], "buy_order_id string, ticker string, price double, quantity int").repartition(4)
    for _ in range(2):  # the batch once more, as after a crash before it was told to whoever asked
        order_tables.append_once(fills, url, "fills", "monday", driver)
    order_tables._put(fills, url, "fills_rows", "never-told", driver)
    twice = spark.read.jdbc(url, "fills_rows", properties=driver)
    first = twice.where("attempt <> 'never-told'").select(F.min("attempt")).first()[0]
    again = twice.where(F.col("attempt") == first).limit(10)  # a task whose first try had been taken for lost
    spark.createDataFrame(again.collect(), again.schema).write.jdbc(url, "fills_rows", mode="append", properties=driver)
    order_tables.append_once(fills.limit(3), url, "fills", "tuesday", driver)
    got = order_tables.read_appended(spark, url, "fills", driver)
    assert sorted((r.batch, r.quantity) for r in got.where("batch = 'monday'").collect()) == [("monday", i) for i in range(100)] and got.count() == 103
    order_tables.write_order_log(fills.selectExpr("buy_order_id as sell_order_id", "ticker", "price", "quantity", "buy_order_id as buy_order_id_link"), url, "open_sells", ["sell_order_id", "ticker", "price", "quantity", "buy_order_id_link"], driver | {"createTableColumnTypes": "ticker varchar(10)"})
    parts = order_tables.read_open_orders(spark, url, "open_sells", driver, by="quantity", lower=0, upper=100, parts=4)
    assert parts.rdd.getNumPartitions() == 4 and parts.count() == 100
    some = parts.where("ticker = 'A' and quantity < 10")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(ticker,A)" in plan.replace("TICKER", "ticker") and "LessThan(quantity,10)" in plan.replace("QUANTITY", "quantity") and some.count() == 5


def test_open_orders_are_refreshed_at_once(spark, tmp_path):
    url, driver = f"jdbc:derby:{tmp_path}/open;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    frame = lambda rows: spark.createDataFrame(rows, "sell_order_id string, ticker string, price double")
    symbols = lambda *names: spark.createDataFrame([(n,) for n in names], "ticker string")
    read = lambda: sorted((r.sell_order_id, r.price) for r in order_tables.read_stored_orders(spark, url, "open", driver).collect())
    order_tables.store_open_orders(frame([("1", "A", 1.0), ("2", "B", 2.0), ("3", "C", 3.0), ("9", "Z", 9.0)]), symbols("A", "B", "C"), url, "open", driver)
    assert read() == [("1", 1.0), ("2", 2.0), ("3", 3.0)]
    order_tables.store_open_orders(frame([("4", "A", 4.0), ("5", "A", 5.0)]), symbols("A", "B"), url, "open", driver)
    assert read() == [("3", 3.0), ("4", 4.0), ("5", 5.0)]
    broken = frame([("6", "A", 6.0), ("7", "C", 7.0)]).repartition(2).withColumn("price", F.when(F.col("ticker") == "C", F.raise_error(F.lit("halfway")).cast("double")).otherwise(F.col("price")))
    with pytest.raises(Exception, match="halfway"):
        order_tables.store_open_orders(broken, symbols("A", "C"), url, "open", driver)
    assert read() == [("3", 3.0), ("4", 4.0), ("5", 5.0)]


def test_wide_merge_and_links(spark):
    rows = spark.createDataFrame([(1, "A", 1.0, 5), (1, "B", 2.0, 6), (2, "A", 3.0, 7), (2, "C", 9.0, 9)], "ts int, ticker string, close double, volume int")
    one = align.wide_merge(rows, ["A", "B"], ["close"])
    assert one.columns == ["ts", "A_close", "B_close"] and sorted(tuple(r) for r in one.collect()) == [(1, 1.0, 2.0), (2, 3.0, None)]
    assert align.wide_merge(rows, ["A", "B"], ["close", "volume"]).columns == ["ts", "A_close", "A_volume", "B_close", "B_volume"]
    sells = spark.createDataFrame([(9, 1), (8, 7), (7, None)], "sell_order_id int, buy_order_id_link int")
    buys = spark.createDataFrame([(1, 5.0), (2, 6.0)], "buy_order_id int, price double")
    assert [tuple(r) for r in orders.link_fills(sells, buys).collect()] == [(9, 1, 1, 5.0)]


def test_a_cluster_needs_a_checkpoint_folder():
    from types import SimpleNamespace

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    df = SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: None)))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.checkpointed(df)


# clustering at the survey's size ---------------------------------------------------------------------------------------


def test_bounded_search_equals_all_distances_and_makes_fewer():
    import numpy as np

    from barloom.functions.nearest import Centers

    rng = np.random.default_rng(2)
    for k, d in ((1, 3), (15, 9), (16, 9), (100, 9), (100, 2)):
        blobs = rng.random((12, d))
        x = blobs[rng.integers(0, 12, 3000)] + rng.normal(0, 0.05, (3000, d))
        centers = x[rng.choice(3000, k, replace=False)].round(1)  # some are equal, and the first of them counts
        best, least, made = Centers(centers).nearest(x)
        everything = np.stack([((x - c) ** 2).sum(axis=1) for c in centers], axis=1)
        assert np.allclose(least, everything.min(axis=1), rtol=1e-12, atol=1e-15)
        ties = np.isclose(everything, least[:, None], rtol=1e-12, atol=1e-15)
        assert (best == ties.argmax(axis=1)).mean() > 0.999  # but for sums that differ in their last digit
        assert made <= everything.size and (k < 100 or made < 0.6 * everything.size)
    exact = np.array([[float(i % 4), float(i // 4)] for i in range(16)] * 2)
    best, least, _ = Centers(exact).nearest(np.array([[0.5, 0.5], [1.0, 1.0], [2.5, 3.0]]))
    assert best.tolist() == [0, 5, 14] and least.tolist() == [0.5, 0.0, 0.25]


def test_fit_at_full_size_equals_plain_steps(spark):
    """k = 100, 10 runs, the eight features and the category, over the smallest tables' daily bars."""
    import hashlib

    import numpy as np
    from conftest import DATA

    from barloom.operators import kmeans
    from barloom.plans import model_queries

    rows = model_queries.daily_training_rows(spark, str(DATA / "sf0.001")).matrix.where("split = 'train' and ticker in ('1-URGENT', '2-HIGH')").select("ticker", "row_id", "features")
    data = {}
    for r in rows.collect():
        data.setdefault(r.ticker, []).append((r.row_id, r.features))
    got = {(r.run, r.ticker, r.cluster): r.center for r in kmeans.kmeans_fit(kmeans.restarts(rows, 10), 100, 30).collect()}
    want = {}
    for ticker, own in data.items():
        if len(own) < 100:
            continue
        for run in range(10):
            order = sorted(own, key=lambda o: (hashlib.md5(f"0|{run}|{o[0]}".encode()).hexdigest(), o[0]))[:100]
            x, names, c = np.array([f for _, f in own]), np.arange(100), np.array([f for _, f in order])
            for _ in range(30):
                near = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
                full = np.unique(near)
                names, c = names[full], np.array([x[near == j].mean(axis=0) for j in full])
            want |= {(run, ticker, int(n)): v for n, v in zip(names, c, strict=True)}
    assert got.keys() == want.keys() and len(want) > 500
    assert max(abs(a - b) for k, v in want.items() for a, b in zip(got[k], v, strict=True)) < 1e-9


def test_values_at_ranks_from_counts_alone(spark):
    """Also where one value fills most rows, where a rank is at its edge, and where brackets are narrowed often."""
    import random

    from barloom.operators.ranks import values_at, with_rank

    rng = random.Random(9)
    data = {
        "even": [float(i) for i in range(5000)],
        "heavy": [1.0] * 4000 + [rng.random() * 3 for _ in range(600)],
        "edge": [0.0] + [5.0] * 3000 + [6.0],
        "two": [1.0, 2.0] * 700,
        "skew": [rng.random() ** 40 for _ in range(3000)],
        "few": [3.0, 1.0, 2.0],
        "odd": [float("inf"), float("-inf"), -0.0, 0.0, 7.0] * 50,
    }
    rows = spark.createDataFrame([(k, v) for k, own in data.items() for v in [*own, None]], "ticker string, gain double").repartition(4)
    got = {r.ticker: r for r in values_at(rows, "ticker", "gain", lambda n: [F.lit(0), F.lit(1), F.floor(n / 3), F.floor(n / 2), n - 2, n - 1], few=20).collect()}
    for k, own in data.items():
        s, n = sorted(own), len(own)
        assert got[k].n == n and got[k]["values"] == [s[0], s[1], s[n // 3], s[n // 2], s[-2], s[-1]], k
    assert values_at(rows.limit(0), "ticker", "gain", lambda n: [n - 1]).count() == 0
    few = dataset.rank_thresholds(rows.where("ticker in ('few', 'two')")).collect()
    assert sorted((r.ticker, r.i, r.t) for r in few) == [("two", i, 1.0 if i < 4 else 2.0) for i in range(1, 8)]
    ties = spark.createDataFrame([("A", i % 3, i) for i in range(200)], "ticker string, ts int, id int")
    ranks = with_rank(ties.repartition(7), "ticker", "ts", ties=("id",)).collect()
    assert [r.id for r in sorted(ranks, key=lambda r: r._i)] == sorted(range(200), key=lambda i: (i % 3, i))


def test_repeated_orders_are_touched_once_each(spark):
    at = lambda s: datetime(2024, 1, 3, 9, 0, s)
    rows = [("A", at(0), 1, 5.0, 1), ("A", at(0), 1, 5.0, 1), ("A", at(2), 1, 4.0, 1), ("B", at(0), 1, 5.0, 1), ("A", at(0), None, 5.0, 1), ("A", at(0), 2, None, 1)]
    placed = spark.createDataFrame(rows, "ticker string, placed_ts timestamp, order_id long, limit_price double, quantity int")
    quotes = spark.createDataFrame([("A", at(s), b, b) for s, b in ((1, 5.0), (3, 4.0))], "ticker string, ts timestamp, bid double, ask double")
    got = orders.buy_touch(placed, quotes).collect()
    assert len(got) == len(rows)
    key = lambda r: (str(r.order_id), r.ticker, str(r.limit_price), str(r.touch_ts))
    assert sorted(map(key, got)) == sorted([("1", "A", "5.0", str(at(1)))] * 2 + [("1", "A", "4.0", str(at(3))), ("1", "B", "5.0", "None"), ("None", "A", "5.0", "None"), ("2", "A", "None", "None")])
