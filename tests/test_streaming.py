"""Streams in several micro-batches against the batch forms and plain expectations."""

import time
import uuid
from datetime import datetime, timedelta

import pytest
from conftest import DATA

from barloom.operators import align, dataset, indicators, kmeans
from barloom.sources import fixtures
from barloom.streaming import quotes as streams
from pyspark.sql import functions as F

T0 = datetime(2024, 1, 3, 9, 0)


def feed(spark, folder, batches, schema):
    """A folder of Parquet files, one for each batch, in order."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        time.sleep(0.05)  # files are read in the order of their times
    return f"{folder}/in"


def run(spark, stream, folder, mode="append"):
    name = f"t_{uuid.uuid4().hex}"
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return spark.table(name)


def quote(ticker, seconds, bid, ask=None):
    return (ticker, T0 + timedelta(seconds=seconds), bid, ask if ask is not None else bid)


QUOTES = "ticker string, ts timestamp, bid double, ask double"


def test_minute_bars_equal_batch_but_for_the_open_window(spark, tmp_path):
    q = fixtures.quotes(spark, str(DATA / "sf0.001")).select("ticker", F.col("ts").cast("timestamp").alias("ts"), "bid", "ask")
    for lo, hi in ((1, 11), (11, 21), (21, 32)):
        q.where(F.dayofmonth("ts").between(lo, hi - 1)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)
    stream = streams.minute_bars_stream(streams.quote_stream(spark, f"{tmp_path}/in", files=1).select("ticker", "ts", ((F.col("bid") + F.col("ask")) / 2).alias("price")))
    got = {(r.ticker, r.ts): r.price for r in run(spark, stream, str(tmp_path)).collect()}
    want = {(r.ticker, r.ts): r.price for r in align.minute_bar(q).collect()}
    assert got.items() <= want.items() and len(want) - len(got) <= 5
    assert max(t for _, t in want.keys() - got.keys()) == max(t for _, t in want)


def test_late_quotes_and_quotes_without_a_side_are_dropped(spark, tmp_path):
    batches = [[quote("A", 0, 1.0), quote("A", 30, 2.0), ("A", T0, None, 1.0)], [quote("A", 600, 5.0)], [quote("A", 20, 9.0), quote("A", 1200, 6.0)], [quote("A", 3000, 7.0)]]
    path = feed(spark, tmp_path, batches, QUOTES)
    stream = streams.minute_bars_stream(streams.session_quotes(streams.quote_stream(spark, path, files=1)))
    got = sorted((r.ts, r.price) for r in run(spark, stream, str(tmp_path)).collect())
    assert got[:2] == [(T0 + timedelta(minutes=1), 2.0), (T0 + timedelta(minutes=11), 5.0)]


def test_session_filter_knows_days_hours_and_holidays(spark, tmp_path):
    rows = [quote("A", 0, 1.0), ("A", datetime(2024, 1, 6, 9), 1.0, 1.0), ("A", datetime(2024, 1, 3, 3, 59), 1.0, 1.0), ("A", datetime(2024, 1, 3, 17, 0), 1.0, 1.0), ("A", datetime(2024, 1, 1, 9), 1.0, 1.0)]
    path = feed(spark, tmp_path, [rows], QUOTES)
    holidays = spark.createDataFrame([(datetime(2024, 1, 1).date(),)], "date date")
    got = run(spark, streams.session_quotes(streams.quote_stream(spark, path), holidays), str(tmp_path))
    assert sorted(r.ts for r in got.collect()) == [T0, datetime(2024, 1, 3, 17, 0)]


PRICES = "ticker string, ts timestamp, price double"


def in_runs(spark, folder, batches, schema, stream, **sink):
    """What a stream gives out that stops after each batch and goes on from its checkpoint."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        source = spark.readStream.schema(schema).parquet(f"{folder}/in")
        writer = stream(source).writeStream.option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True)
        q = writer.foreachBatch(sink["sink"]).start() if sink else writer.format("parquet").option("path", f"{folder}/out").start()
        assert q.awaitTermination(120)
    return None if sink else spark.read.parquet(f"{folder}/out")


def test_gap_fill_gives_each_session_minute_once(spark, tmp_path):
    at = lambda m: T0 + timedelta(minutes=m)
    batches = [[("A", at(0), 1.0), ("A", at(2), 2.0)], [("A", at(2), 9.0), ("A", at(5), 3.0)], [("B", at(6), 1.0), ("A", datetime(2024, 1, 4, 4, 2), 4.0)]]
    rows = [r for r in in_runs(spark, tmp_path, batches, PRICES, streams.gap_fill_stream).orderBy("ts").collect() if r.ticker == "A"]
    assert [(r.ts, r.price, r.filled) for r in rows[:6]] == [(at(0), 1.0, False), (at(1), 1.0, True), (at(2), 2.0, False), (at(3), 2.0, True), (at(4), 2.0, True), (at(5), 3.0, False)]
    assert len({r.ts for r in rows}) == len(rows)
    # the rest of the day up to 17:00, then 04:00 and 04:01 of the next
    assert len(rows) == 6 + (17 * 60 - (9 * 60 + 5)) + 2 + 1
    assert rows[-2].ts == datetime(2024, 1, 4, 4, 1) and rows[-2].price == 3.0


def test_gaps_are_filled_when_the_watermark_passes_and_holidays_have_none(spark, tmp_path):
    """B has no bar after the 3rd of July; A's bars move the watermark over the holiday and two hours into the 5th."""
    eve, after = datetime(2024, 7, 3, 16, 58), datetime(2024, 7, 5, 6, 0)
    batches = [[("A", eve, 1.0), ("B", eve, 7.0)], [("A", after, 2.0)]]
    rows = in_runs(spark, tmp_path, batches, PRICES, streams.gap_fill_stream).collect()
    b = sorted(r.ts for r in rows if r.ticker == "B")
    assert b[:3] == [eve, datetime(2024, 7, 3, 16, 59), datetime(2024, 7, 3, 17, 0)]
    assert b[3] == datetime(2024, 7, 5, 4, 0) and b[-1] == datetime(2024, 7, 5, 5, 58) and len(b) == 3 + 119
    assert not [r for r in rows if r.ts.date() == datetime(2024, 7, 4).date()]
    assert {r.price for r in rows if r.ticker == "B"} == {7.0}


def test_sessions():
    from datetime import date

    s = streams.Sessions([date(2024, 7, 4)])
    of = lambda *x: int((datetime(*x) - datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    assert s.on_grid(of(2024, 7, 3, 17, 0)) and not s.on_grid(of(2024, 7, 3, 17, 1)) and not s.on_grid(of(2024, 7, 4, 9, 0)) and not s.on_grid(of(2024, 7, 3, 9, 0, 1))
    assert s.after(of(2024, 7, 3, 17, 0)) == of(2024, 7, 5, 4, 0) and s.after(of(2024, 7, 5, 17, 0)) == of(2024, 7, 8, 4, 0) and s.after(of(2024, 7, 5, 1, 0)) == of(2024, 7, 5, 4, 0)
    assert list(s.between(of(2024, 7, 3, 16, 59), of(2024, 7, 5, 4, 0))) == [of(2024, 7, 3, 17, 0), of(2024, 7, 5, 4, 0)]
    assert len(s.between(of(2024, 7, 4, 0, 0), of(2024, 7, 4, 23, 59))) == 0


@pytest.mark.parametrize("split", [True, False])
def test_orders_time_out_unless_filled(spark, tmp_path, split):
    """The same whether events come one by one or all at once: a fill after ten minutes is too late."""
    at = lambda m: T0 + timedelta(minutes=m)
    schema = "order_id long, ts timestamp, kind string, refund double"
    batches = [[(1, at(0), "placed", 5.0), (2, at(0), "placed", 6.0)], [(2, at(3), "filled", 0.0)], [(6, at(14), "placed", 8.0), (7, at(14), "placed", 9.0)], [(7, at(24), "filled", 0.0), (6, at(25), "filled", 0.0), (3, at(30), "placed", 7.0)], [(3, at(31), "keep", 0.0)], [(4, at(90), "placed", 1.0)]]
    if not split:
        batches = [[r for b in batches for r in b], [(5, at(200), "placed", 1.0)]]
    got = in_runs(spark, tmp_path, batches, schema, streams.order_timeout_stream).collect()
    assert sorted((r.order_id, r.cancel_ts, r.refund) for r in got if r.order_id not in (4, 5)) == [(1, at(10), 5.0), (6, at(24), 8.0)]


@pytest.mark.parametrize("split", [True, False])
def test_only_what_is_near_a_placement_ends_it(spark, tmp_path, split):
    """In the engine alone, without a call for each order, and whether events come at once or not."""
    at = lambda m: T0 + timedelta(minutes=m)
    schema = "order_id long, ts timestamp, kind string, refund double"
    rows = [(1, at(0), "keep", 0.0), (2, at(3), "keep", 0.0), (1, at(12), "placed", 5.0), (2, at(12), "placed", 6.0), (3, at(12), "placed", 7.0), (3, at(12), "placed", 7.0), (3, at(23), "keep", 0.0), (4, at(200), "placed", 1.0)]
    batches = [rows[:2], rows[2:6], rows[6:7], rows[7:]] if split else [rows[:7], rows[7:]]
    got = in_runs(spark, tmp_path, batches, schema, streams.order_timeout_stream).collect()
    assert sorted((r.order_id, r.cancel_ts, r.refund) for r in got if r.order_id != 4) == [(1, at(22), 5.0), (3, at(22), 7.0)]
    made = streams.order_timeout_stream(spark.readStream.schema(schema).parquet(str(tmp_path)))
    assert "pandas" not in made._jdf.queryExecution().analyzed().toString().lower()


BARS = "ticker string, ts timestamp, open double, high double, low double, close double"


@pytest.fixture(scope="module")
def aligned_days(spark):
    from barloom.plans import queries

    d = str(DATA / "sf0.001")
    aligned = queries.aligned(spark, d).where("close is not null and session_no <= 17").cache()
    return aligned, fixtures.daily_short(spark, d).cache()


def as_stream(spark, folder, aligned, sessions_a_file=6):
    """The aligned bars as files of a few sessions each, in order of time."""
    for i in range(0, 18, sessions_a_file):
        part = aligned.where(F.col("session_no").between(i + 1, i + sessions_a_file)).select("ticker", F.col("ts").cast("timestamp").alias("ts"), "open", "high", "low", "close")
        part.coalesce(1).write.mode("append").parquet(f"{folder}/bars")
        time.sleep(1.1)
    return spark.readStream.schema(BARS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/bars")


def test_streamed_features_equal_batch_features(spark, tmp_path, aligned_days):
    aligned, daily = aligned_days
    want = indicators.minute_features(aligned, daily)
    got = run(spark, streams.features_stream(as_stream(spark, tmp_path, aligned), indicators.daily_state(daily)), str(tmp_path))
    key = lambda r: (r["ticker"], str(r["ts"])[:19])
    a, b = ({key(r): r for r in df.collect()} for df in (want, got))
    assert a.keys() == b.keys() and len(a) > 50_000
    for k, r in a.items():
        for f in indicators.FEATURES:
            x, y = r[f], b[k][f]
            assert (x is None) == (y is None or y != y), (k, f, x, y)
            assert x is None or abs(x - y) < 1e-6 * max(1, abs(x)), (k, f, x, y)


def test_scores_equal_batch_scores(spark, tmp_path, aligned_days):
    aligned, daily = aligned_days
    features = ["close", "close5min", "sma5", "ema10", "boll20", "macd_hist", "rsi", "stochastic_k"]
    aligned = aligned.where("session_no > 15")
    rows = indicators.minute_features(aligned, daily, features)
    scaling = dataset.feature_min_max(rows, features)
    scaled = dataset.training_matrix(dataset.drop_null_rows(dataset.min_max_scale(rows, scaling, features), features), features, include_label=False)
    points = scaled.select("ticker", F.col("ts").alias("row_id"), "features", F.lit(0).alias("run"))
    centers = kmeans.initial_centroids(points, 5).drop("run").cache()
    names = centers.select("ticker", "cluster", F.concat(F.lit("label "), "cluster").alias("label"))
    got = run(spark, streams.score_stream(as_stream(spark, tmp_path, aligned), indicators.daily_state(daily), scaling, centers, names, features), str(tmp_path)).cache()
    want = kmeans.assign_clusters(points.drop("run"), centers, ("ticker",))
    a = {(r.ticker, str(r.row_id)[:19]): r.cluster for r in want.collect()}
    b = {(r.ticker, str(r.ts)[:19]): (r.cluster, r.label) for r in got.collect()}
    assert len(a) > 5_000 and all(b[k] == (c, f"label {c}") for k, c in a.items())
    assert all(v == (None, None) for k, v in b.items() if k not in a)


def test_prices_alone_are_bars_too(spark, tmp_path):
    path = feed(spark, tmp_path, [[("A", T0, 10.0)], [("A", T0 + timedelta(minutes=1), 20.0), ("Z", T0, 1.0)], [("A", T0, 5.0)]], "ticker string, ts timestamp, price double")
    minutes = spark.readStream.schema("ticker string, ts timestamp, price double").option("maxFilesPerTrigger", 1).parquet(path)
    days = [("A", (T0 - timedelta(days=9 - i)).date(), 9.0, 11.0, 8.0, 10.0) for i in range(10)]
    daily = spark.createDataFrame(days, "ticker string, date date, open double, high double, low double, close double")
    rows = run(spark, streams.features_stream(minutes, indicators.daily_state(daily)), str(tmp_path)).where("ticker = 'A'").orderBy("ts").collect()
    # the late bar of the first minute is dropped
    assert [(r.close, r.close1min, r.sma5, r.diff_high_low, r.bias) for r in rows] == [(10.0, None, 10.0, 0.0, 1.0), (20.0, 10.0, 12.0, 0.0, 1.0)]


def test_retention_stream(spark, tmp_path):
    at = lambda i: T0 + timedelta(minutes=i)
    batches = [[("A", at(i), i) for i in range(8)], [("A", at(i), i) for i in range(8, 17)] + [("B", at(1), 1), ("B", at(1), 2)], [("A", at(17), 17)]]
    changes = in_runs(spark, tmp_path, batches, "ticker string, ts timestamp, row_id long", lambda s: streams.retention_stream(s, 10, 5))
    assert sorted((r.ticker, r.row_id) for r in changes.where("gone").collect()) == [("A", i) for i in range(10)]
    assert sorted((r.ticker, r.row_id) for r in streams.kept_rows(changes).collect()) == [("A", i) for i in range(10, 18)] + [("B", 1), ("B", 2)]


def test_idle_tickers_are_counted_anew(spark, tmp_path):
    """A's state goes when the watermark is a day past its rows; later rows don't push the earlier ones out."""
    at = lambda h: T0 + timedelta(hours=h)
    batches = [[("A", at(0), i) for i in range(8)], [("B", at(100), 1)], [("A", at(101), i) for i in range(8, 16)], [("A", at(101), i) for i in range(16, 19)]]
    changes = in_runs(spark, tmp_path, batches, "ticker string, ts timestamp, row_id long", lambda s: streams.retention_stream(s, 10, 5, timedelta(days=1)))
    assert sorted(r.row_id for r in streams.kept_rows(changes).where("ticker = 'A'").collect()) == [*range(8), *range(13, 19)]


def test_picks_of_a_batch_that_is_run_again_stay_the_same(spark, tmp_path):
    thresholds = spark.createDataFrame([(t, i, float(i + ord(t))) for t in "ABCDEF" for i in range(1, 8)], "ticker string, i int, t double")
    at = lambda m: T0 + timedelta(minutes=m)
    scores = [(t, at(m), "Strong Buy" if (ord(t) + m) % 3 else "Neutral") for t in "ABCDEFG" for m in range(4)]
    batches = [[r for r in scores if r[1] < at(2)], [r for r in scores if r[1] >= at(2)]]
    sink = streams.picks_sink(f"{tmp_path}/picks", thresholds, 300.0)
    in_runs(spark, tmp_path, batches, "ticker string, ts timestamp, label string", lambda s: s, sink=sink)
    read = lambda: sorted((r.ts, r.ticker, r.t_last) for r in spark.read.parquet(f"{tmp_path}/picks").collect())
    first = read()
    from barloom.operators import scoring

    want = []
    for m in range(4):
        now = spark.createDataFrame([r for r in scores if r[1] == at(m)], "ticker string, ts timestamp, label string")
        want += [(at(m), r.ticker, r.t_last) for r in scoring.pick_buys(now, thresholds, 300.0).collect()]
    assert first == sorted(want) and len(first) == 12
    # the second batch once more, as after a failure before its commit; then a run that dies while it writes
    again = spark.createDataFrame(batches[1], "ticker string, ts timestamp, label string")
    sink(again, 1)
    assert read() == first
    broken = again.withColumn("label", F.assert_true(F.col("ticker") < "C").cast("string"))
    with pytest.raises(Exception, match="is not true"):
        sink(broken, 2)
    sink(again.limit(0), 2)
    assert read() == first


def test_a_replay_that_is_empty(spark):
    from barloom.streaming.replay import replayed

    rows = spark.createDataFrame([], PRICES)
    assert replayed(rows, "ts", streams.gap_fill_stream).count() == 0


def test_retention(spark):
    rows = spark.createDataFrame([("A", i) for i in range(11)] + [("B", i) for i in range(10)], "ticker string, ts int")
    kept = align.retention(rows, 10, 5)
    assert sorted(r.ts for r in kept.where("ticker = 'A'").collect()) == list(range(5, 11))
    assert kept.where("ticker = 'B'").count() == 10
