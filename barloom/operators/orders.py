"""The order book's rules as joins."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.scalars import cents
from barloom.params import SELL_LABELS, Trading


def filter_orders(orders: DataFrame, start: datetime, end: datetime, status: str, entered: str = "entered") -> DataFrame:
    """Orders entered between start and end, both included, that have this status."""
    return orders.where(F.col(entered).between(F.lit(start), F.lit(end)) & (F.col("status") == status))


def _first(rows: str, bound: str, after: Column | None = None) -> Column:
    """Of an array of (t, v) the first t, past ``after`` if given, whose v is at or below the bound."""
    fits = F.filter(rows, lambda x: (x["v"] <= F.col(bound)) if after is None else (x["v"] <= F.col(bound)) & (x["t"] > after))
    return F.array_min(F.transform(fits, lambda x: x["t"]))


def _first_touch(orders: DataFrame, since: str, bound: Column, value: Column, quotes: DataFrame) -> DataFrame:
    """orders with ``touch_ts``: the ticker's first quote from ``since`` on whose value is at or below the bound.

    No order meets single quotes of more than two seconds. Quotes make a tree of least values: of each second, minute,
    and day; a row holds the children of one node (the quotes of a second, the seconds of a minute, the minutes of a day,
    the days of a ticker). An order looks at what is left of its own second, minute, day and at later days, and goes down
    from the first node with a low enough value. Each step is an equi-join with one row, so the work grows with orders
    plus quotes, also for a ticker that has most of both.
    """
    cut = lambda unit, c: F.date_trunc(unit, c).cast("timestamp_ntz")
    q = quotes.select("ticker", F.col("ts").cast("timestamp_ntz").alias("t"), value.alias("v")).where("v is not null")
    levels: dict[str, DataFrame] = {}
    for unit, name in (("second", "second"), ("minute", "minute"), ("day", "day")):
        node = cut(unit, F.col("t")).alias(name)
        levels[unit] = q.groupBy("ticker", node).agg(F.collect_list(F.struct("t", "v")).alias("rows"))
        q = levels[unit].select("ticker", F.col(name).alias("t"), F.array_min(F.transform("rows", lambda x: x["v"])).alias("v"))
    levels["all"] = q.groupBy("ticker").agg(F.collect_list(F.struct("t", "v")).alias("rows"))

    start = F.col(since).cast("timestamp_ntz")
    named = orders.withColumns({"_since": start, "_bound": bound})
    # each (order, ticker, time, bound) once, however often the order stands in the table
    o = named.select("order_id", "ticker", F.col("_since").alias("since"), F.col("_bound").alias("bound")).where("bound is not null and since is not null").distinct()
    o = o.withColumns({f"own_{u}": cut(u, F.col("since")) for u in ("second", "minute", "day")})

    def look(rows: DataFrame, unit: str, at: Column | None, found: Column, name: str) -> DataFrame:
        """rows with ``name``: what is found in the children of the node ``at``."""
        if at is None:
            return rows.join(levels[unit], "ticker", "left").withColumn(name, found).drop("rows")
        return rows.withColumn(unit, at).join(levels[unit], ["ticker", unit], "left").withColumn(name, found).drop("rows", unit)

    # what is left of the own second includes a quote of the very moment
    o = look(o, "second", F.col("own_second"), _first("rows", "bound", F.col("since") - F.expr("INTERVAL 1 MICROSECOND")), "quote1")
    o = look(o, "minute", F.col("own_minute"), _first("rows", "bound", F.col("own_second")), "second1")
    o = look(o, "day", F.col("own_day"), _first("rows", "bound", F.col("own_minute")), "minute1")
    o = look(o, "all", None, _first("rows", "bound", F.col("own_day")), "day1")
    # down from the first that was found; an order without one goes to its own node, in vain, so that no key is crowded
    o = look(o, "day", F.coalesce("day1", "own_day"), F.coalesce("minute1", F.when(F.col("day1").isNotNull(), _first("rows", "bound"))), "minute2")
    o = look(o, "minute", F.coalesce("minute2", "own_minute"), F.coalesce("second1", F.when(F.col("minute2").isNotNull(), _first("rows", "bound"))), "second2")
    o = look(o, "second", F.coalesce("second2", "own_second"), F.coalesce("quote1", F.when(F.col("second2").isNotNull(), _first("rows", "bound"))), "touch_ts")
    kind = orders.schema[since].dataType
    found = o.select("order_id", "ticker", F.col("since").alias("_since"), F.col("bound").alias("_bound"), F.col("touch_ts").cast(kind).alias("touch_ts"))
    return named.join(found, ["order_id", "ticker", "_since", "_bound"], "left").select(*[named[c] for c in orders.columns], "touch_ts")


def buy_touch(orders: DataFrame, quotes: DataFrame) -> DataFrame:
    """buy orders with ``touch_ts``: the first bid at or below the limit from placement on; null if there is none."""
    return _first_touch(orders, "placed_ts", F.col("limit_price"), F.col("bid"), quotes)


def sell_touch(stock: DataFrame, quotes: DataFrame) -> DataFrame:
    """held stock (order_id, ...) with ``touch_ts``: the first ask at or above a limit above 0, after the buy."""
    return _first_touch(stock, "buy_ts", F.when(F.col("limit_sell_price") > 0, -F.col("limit_sell_price")), -F.col("ask"), quotes)


def fills(orders: DataFrame, quotes: DataFrame, sell_factor: float = 1.2) -> DataFrame:
    """(order_id, ticker, state, buy_ts, buy_price, quantity, sell_ts, sell_price): touched buys become held stock with a
    sell order at sell_factor, touched sells become past orders; the others stay open or held."""
    bought = buy_touch(orders, quotes)
    held = bought.where("touch_ts is not null").select(
        "order_id", "ticker", F.col("touch_ts").alias("buy_ts"), cents(F.col("limit_price") * sell_factor).alias("limit_sell_price")
    )
    sold = sell_touch(held, quotes).select("order_id", F.col("touch_ts").alias("sell_ts"), F.col("limit_sell_price").alias("sell_limit"))
    rows = bought.join(sold, "order_id", "left")
    state = F.when(F.col("sell_ts").isNotNull(), "past").when(F.col("touch_ts").isNotNull(), "held").otherwise("open")
    return rows.select(
        "order_id",
        "ticker",
        state.alias("state"),
        F.col("touch_ts").alias("buy_ts"),
        F.when(F.col("touch_ts").isNotNull(), F.col("limit_price")).alias("buy_price"),
        "quantity",
        "sell_ts",
        F.when(F.col("sell_ts").isNotNull(), F.col("sell_limit")).alias("sell_price"),
    )


def link_fills(sells: DataFrame, buys: DataFrame) -> DataFrame:
    """Sell fills (..., buy_order_id_link) with the columns of the buy fill (buy_order_id, ...) that they close."""
    return sells.join(buys, sells["buy_order_id_link"] == buys["buy_order_id"])


def total_balance(open_orders: DataFrame, stock: DataFrame, available: float) -> DataFrame:
    """One row: cash, money in open buy orders, money in held stock, and their sum, as decimals."""
    both = (
        open_orders.select(F.col("limit_price").alias("p"), F.col("quantity").alias("q"), F.lit(True).alias("is_open"))
        .unionByName(stock.select(F.col("buy_price").alias("p"), F.col("quantity").alias("q"), F.lit(False).alias("is_open")))
        .groupBy()
        .agg(*[F.coalesce(F.sum(F.when(F.col("is_open") == o, (F.col("p").cast("decimal(18,2)") * F.col("q").cast("decimal(9,0)")))), F.lit(0)).cast("decimal(18,2)").alias(n) for o, n in ((True, "in_orders"), (False, "in_stock"))])
    )
    cash = F.lit(available).cast("decimal(18,2)")
    return both.select(cash.alias("available"), "in_orders", "in_stock", (cash + F.col("in_orders") + F.col("in_stock")).cast("decimal(18,2)").alias("total"))


def tradable(latest: DataFrame, volumes: DataFrame, total: float, trading: Trading = Trading()) -> DataFrame:
    """Tickers with a quote and a volume that are neither too dear nor too thinly traded for one purchase."""
    rows = latest.join(volumes, "ticker")
    most = min(trading.max_purchase, total / trading.transactions)
    return rows.where((F.col("price") <= max(total / 10, 100.0)) & (F.lit(most) <= F.col("price") * F.col("avg_volume") * 0.01))


def sell_decisions(stock: DataFrame, latest: DataFrame, labels: DataFrame, thresholds: DataFrame, now: datetime, trading: Trading = Trading()) -> DataFrame:
    """stock bought before today with ``action`` (place or replace) and ``price``; rows without a decision are gone.

    stock: (order_id, ticker, buy_ts, buy_price, limit_sell_id, limit_sell_price); latest: (ticker, bid, price);
    labels: (ticker, label); thresholds: (ticker, t_last).
    """
    rows = stock.join(latest.select("ticker", "bid", "price"), "ticker").join(labels, "ticker", "left").join(thresholds, "ticker", "left")
    at = F.lit(now)
    ordered = F.coalesce(F.col("limit_sell_id"), F.lit(0)) > 0
    inside = at < F.col("buy_ts") + F.expr(f"INTERVAL {trading.predict_days} DAYS")
    even = F.greatest("buy_price", "price")
    sell_now = (F.col("buy_price") < F.col("bid")) & F.col("label").isin(*SELL_LABELS)
    price = (
        F.when(~ordered, F.col("buy_price") * (1 + 2 * F.col("t_last")))
        .when(inside & sell_now, F.col("price"))
        .when(~inside & (even < F.col("limit_sell_price")), even)
    )
    out = rows.where(F.to_date("buy_ts") < F.to_date(at)).withColumn("decision", price)
    return out.where("decision is not null").select("order_id", "ticker", F.when(ordered, "replace").otherwise("place").alias("action"), F.col("decision").alias("price"))


def cancel_decisions(open_orders: DataFrame, labels: DataFrame, now: datetime, trading: Trading = Trading()) -> DataFrame:
    """Buy orders unfilled for longer than ten minutes whose ticker is no Strong Buy any more, with the money that they free."""
    old = F.col("placed_ts") + F.expr(f"INTERVAL {trading.cancel_minutes} MINUTES") < F.lit(now)
    rows = open_orders.join(labels, "ticker", "left").where(old & ~F.coalesce(F.col("label") == "Strong Buy", F.lit(False)))
    return rows.select("order_id", "ticker", (F.col("limit_price").cast("decimal(18,2)") * F.col("quantity").cast("decimal(9,0)")).cast("decimal(18,2)").alias("refund"))
