"""The registered queries in DuckDB's SQL, over views of the given tables."""

from __future__ import annotations

from barloom.params import BOLLINGER, LAGS, MEAN_PERIODS
from barloom.plans.queries import EVENT_TYPES, LABELS, LONG_DIGITS, QUERIES, RUNS, SCALED, SOME, STRONG, K

PARTS = {
    "q": """select event_type ticker, ts, value bid, value + k / 100.0 ask, (value + (value + k / 100.0)) / 2 price, k size, event_id, user_id::varchar uid
      from (select *, regexp_extract(props, '"k": *([0-9]+)', 1)::int k from events)""",
    "m": """select ticker, date_trunc('minute', ts)::timestamp ts, ts::date date, arg_min(bid, ts) open, max(bid) high, min(bid) low, arg_max(bid, ts) close, count(*) volume
      from q group by 1, 2, 3""",
    "d": """select ticker, ts::date date, arg_min(bid, ts) open, max(bid) high, min(bid) low, arg_max(bid, ts) close, count(*) volume from q group by 1, 2""",
    "l": """select o_orderpriority ticker, o_orderdate::date date, arg_min(o_totalprice, o_orderkey) open, max(o_totalprice) high, min(o_totalprice) low,
      arg_max(o_totalprice, o_orderkey) "close", count(*) volume from orders group by 1, 2""",
    "span": "select min(ts)::date lo, max(ts)::date hi from events",
    "ospan": "select min(o_orderdate)::date lo, max(o_orderdate)::date hi from orders",
}


def holidays(name: str, span: str) -> str:
    """CTEs that end in ``name`` (date, holiday)."""
    return f"""{name}_y as (select unnest(range((select year(lo) from {span}), (select year(hi) from {span}) + 1))::int y),
    {name}_e as (
      select y, (h + l - 7 * mm + 114) // 31 mon, (h + l - 7 * mm + 114) % 31 + 1 dy from (
        select *, (a + 11 * h + 22 * l) // 451 mm from (
          select *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 l from (
            select *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 h from (select y, y % 19 a, y // 100 b, y % 100 c from {name}_y))))
    ), {name}_f as (
      select make_date(y, 1, 1) date, 'New Year' holiday from {name}_y
      union all select f + ((8 - isodow(f)) % 7 + 14)::int, 'Martin Luther King Day' from (select make_date(y, 1, 1) f from {name}_y)
      union all select f + ((8 - isodow(f)) % 7 + 14)::int, 'Washington''s Birthday' from (select make_date(y, 2, 1) f from {name}_y)
      union all select make_date(y, mon, dy) - 2, 'Good Friday' from {name}_e
      union all select f - (isodow(f) - 1)::int, 'Memorial Day' from (select make_date(y, 5, 31) f from {name}_y)
      union all select f + case isodow(f) when 6 then -1 when 7 then 1 else 0 end, 'Independence Day' from (select make_date(y, 7, 4) f from {name}_y)
      union all select f + ((8 - isodow(f)) % 7)::int, 'Labor Day' from (select make_date(y, 9, 1) f from {name}_y)
      union all select f + ((11 - isodow(f)) % 7 + 21)::int, 'Thanksgiving' from (select make_date(y, 11, 1) f from {name}_y)
      union all select f + case isodow(f) when 6 then -1 when 7 then 1 else 0 end, 'Christmas' from (select make_date(y, 12, 25) f from {name}_y)
    ), {name} as (select date::date date, min(holiday) holiday from {name}_f, {span} where date between lo and hi group by 1)"""


GRID = (
    holidays("hol", "span")
    + """, tspan as (select ticker, min(ts)::date lo, max(ts)::date hi from q group by 1),
    days as (select ticker, date, row_number() over (partition by ticker order by date) session_no from (
      select ticker, unnest(generate_series(lo, hi, interval 1 day))::date date from tspan) where isodow(date) < 6 and date not in (select date from hol)),
    grid as (select ticker, date, session_no, i minute_no, date + interval 4 hour + to_minutes(i - 1) ts from days, (select unnest(range(1, 782))::int i)),
    al as (select g.ticker, g.date, g.session_no, g.minute_no, g.ts, m.open, m.high, m.low, m.close, case when m.ts = g.ts then m.volume when m.ts is not null then 0 end volume
      from grid g asof left join m on g.ticker = m.ticker and g.ts >= m.ts)"""
)


def sql(select: str, *ctes: str, parts: str = "q m d l span ospan") -> str:
    base = [f"{n} as ({PARTS[n]})" for n in parts.split()]
    return "with recursive " + ",\n".join([*base, *ctes]) + "\n" + select


def win(p: int, until: str = "current row") -> str:
    return f"over (partition by ticker order by date rows between {p - 1} preceding and {until})"


def r(x: str, name: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) {name}"


def long(x: str, name: str) -> str:
    return r(x, name, LONG_DIGITS)


def full(f: str, p: int) -> str:
    return f"case when count(close) {win(p)} = {p} then {f} {win(p)} end"


def before(p: int) -> str:
    return f"list(close) {win(p, '1 preceding')}"


def ema(src: str, name: str, alphas: dict[str, str], value: str = "close") -> str:
    """CTE with one recursively smoothed column for each alpha."""
    return f"""{name}_n as (select ticker, date, {value} v, row_number() over (partition by ticker order by date) rn from {src}),
    {name} as (select ticker, date, rn, {', '.join(f'v::double {c}' for c in alphas)} from {name}_n where rn = 1
      union all select n.ticker, n.date, n.rn, {', '.join(f'(e.{c} * (1 - {a}) + n.v * {a}) / ((1 - {a}) + {a}) {c}' for c, a in alphas.items())}
      from {name} e join {name}_n n on n.ticker = e.ticker and n.rn = e.rn + 1)"""


def alpha(p: int) -> str:
    return f"(2.0::double / {p + 1})"


def macd(src: str) -> list[str]:
    return [
        ema(src, "fs", {"fast": alpha(12), "slow": alpha(26)}),
        "ln as (select ticker, date, fast, slow, fast - slow line from fs)",
        ema("ln", "sg", {"signal": alpha(9)}, "line"),
        "md as (select ln.*, sg.signal from ln join sg using (ticker, date))",
    ]


def rsi(src: str) -> list[str]:
    return [
        f"""ch as (select ticker, date, close, row_number() over w rn, greatest(close - lag(close) over w, 0) g, greatest(lag(close) over w - close, 0) o
        from {src} window w as (partition by ticker order by date))""",
        """rs as (select c.ticker, c.date, c.close, c.rn, s.g, s.o from ch c join (select ticker, avg(g) g, avg(o) o from ch where rn between 2 and 15 group by 1) s using (ticker) where rn = 15
        union all select n.ticker, n.date, n.close, n.rn, e.g * (1 - 1.0::double / 14) + n.g / 14.0, e.o * (1 - 1.0::double / 14) + n.o / 14.0 from rs e join ch n on n.ticker = e.ticker and n.rn = e.rn + 1)""",
    ]


def stoch(src: str) -> list[str]:
    return [
        f"st0 as (select ticker, date, high, low, close, max(high) {win(14)} h, min(low) {win(14)} w, max(high) {win(14, '1 preceding')} hp, min(low) {win(14, '1 preceding')} wp from {src})",
        "st1 as (select *, 100 * (close - w) / nullif(h - w, 0) k from st0)",
        "st2 as (select *, (k + lag(k) over w1 + lag(k, 2) over w1) / 3 d from st1 window w1 as (partition by ticker order by date))",
        "st as (select *, (d + lag(d) over w1 + lag(d, 2) over w1) / 3 d_slow, lag(k) over w1 k1, lag(k, 2) over w1 k2, lag(d) over w1 d1, lag(d, 2) over w1 d2 from st2 window w1 as (partition by ticker order by date))",
    ]


def minute_parts(src: str) -> list[str]:
    """CTE ``mi``: all minute indicators of the rows of src with the days of d."""
    means = ", ".join(f"sum(close) {win(p, '1 preceding')} s{p}, count(close) {win(p, '1 preceding')} c{p}" for p in MEAN_PERIODS)
    lists = ", ".join(f"{before(p)} b{p}" for p in BOLLINGER)
    lag = lambda c: f"lag({c}) over (partition by ticker order by date) {c}p"
    upto = "over (partition by ticker, date order by ts rows unbounded preceding)"
    std = lambda p: f"case when c{p} = {p - 1} then list_aggregate(list_append(b{p}, close), 'stddev_pop') end std{p}"
    line = f"(close * {alpha(12)} + fastp * (1 - {alpha(12)})) - (close * {alpha(26)} + slowp * (1 - {alpha(26)}))"
    return [
        f"dm as (select ticker, date, {means}, {lists} from d)",
        ema("d", "em", {f"e{p}": alpha(p) for p in MEAN_PERIODS}),
        f"emp as (select ticker, date, {', '.join(lag(f'e{p}') for p in MEAN_PERIODS)} from em)",
        *macd("d"),
        f"mdp as (select ticker, date, {lag('fast')}, {lag('slow')}, {lag('signal')} from md)",
        *rsi("d"),
        f"rsp as (select ticker, date, {lag('rclose')}, {lag('g')}, {lag('o')} from (select ch.ticker, ch.date, ch.close rclose, rs.g, rs.o from ch left join rs using (ticker, date)))",
        *stoch("d"),
        f"mx as (select x.*, max(high) {upto} day_high, min(low) {upto} day_low from {src} x)",
        f"""mj as (select mx.ticker, mx.date, mx.ts, mx.open, mx.high, mx.low, mx.close, mx.day_high, mx.day_low, dm.* exclude (ticker, date), emp.* exclude (ticker, date), mdp.* exclude (ticker, date),
        rsp.* exclude (ticker, date), st.hp, st.wp, st.k1, st.k2, st.d1, st.d2
        from mx left join dm using (ticker, date) left join emp using (ticker, date) left join mdp using (ticker, date) left join rsp using (ticker, date) left join st using (ticker, date))""",
        f"""mk as (select *, {', '.join(f'case when c{p} = {p - 1} then (close + s{p}) / {p} end sma{p}' for p in MEAN_PERIODS)}, {', '.join(std(p) for p in BOLLINGER)},
        {', '.join(f'close * {alpha(p)} + e{p}p * (1 - {alpha(p)}) ema{p}' for p in MEAN_PERIODS)}, {line} macd_line,
        gp * 13 / 14 + greatest(close - rclosep, 0) / 14 g1, op * 13 / 14 + greatest(rclosep - close, 0) / 14 o1,
        100 * (close - least(day_low, wp)) / nullif(greatest(day_high, hp) - least(day_low, wp), 0) k from mj)""",
        f"""mi as (select *, macd_line * {alpha(9)} + signalp * (1 - {alpha(9)}) signal_line, macd_line - (macd_line * {alpha(9)} + signalp * (1 - {alpha(9)})) macd_hist,
        case when o1 > 0 then 100 - 100 / (1 + g1 / o1) end rsi, (k + k1 + k2) / 3 d, ((k + k1 + k2) / 3 + d1 + d2) / 3 d_slow,
        {', '.join(f'100 * (close - (sma{p} - {w} * std{p})) / nullif(2 * {w} * std{p}, 0) boll{p}' for p, w in BOLLINGER.items())} from mk)""",
    ]


def minute(*columns: str) -> str:
    return sql(f"select ticker, ts, {', '.join(r(c, c) for c in columns)} from mi", *minute_parts("m"))


FEATURE_ROWS = [
    ema("d", "em", {"e5": alpha(5)}),
    f"dm as (select ticker, date, sum(close) {win(5, '1 preceding')} s5, count(close) {win(5, '1 preceding')} c5 from d)",
    "emp as (select ticker, date, lag(e5) over (partition by ticker order by date) e5p from em)",
    f"""fr as (select m.ticker, m.ts, m.close, m.high - m.low diff_high_low, case when c5 = 4 then (m.close + s5) / 5 end sma5, m.close * {alpha(5)} + e5p * (1 - {alpha(5)}) ema5
      from m left join dm using (ticker, date) left join emp using (ticker, date))""",
    "sc as (" + " union all ".join(f"select ticker, '{c}' feature, min({c}) min, max({c}) max from fr group by 1" for c in SCALED) + ")",
]
GAINS = [
    "ga as (select *, (close - open) / nullif(open, 0) gain from l)",
    """th as (select ticker, i, gain t from (select ticker, gain, row_number() over (partition by ticker order by gain) - 1 rk, count(*) over (partition by ticker) n from ga where gain is not null),
      (select unnest(range(1, 8))::int i) where n >= 8 and rk = ceil(n * i / 8.0))""",
]
CLUSTERS = [
    "p0 as (select (vec_id % 4)::varchar ticker, vec_id row_id, [x::double for x in embedding] f, (label % 8)::int cat, embedding[1]::double gain from embeddings)",
    """p as (select *, case when i <= floor(0.6::decimal(2,1) * n) then 'train' when i <= floor(0.8::decimal(2,1) * n) then 'test1' else 'test2' end split
      from (select *, row_number() over (partition by ticker order by row_id) - 1 i, count(*) over (partition by ticker) n from p0))""",
    f"runs as (select unnest(range(0, {RUNS}))::int run)",
    f"""ce as (select run, ticker, rk - 1 cluster, f c from (select run, ticker, f, count(*) over (partition by run, ticker) n,
      row_number() over (partition by run, ticker order by md5('0|' || run || '|' || row_id), row_id) rk from p, runs) where n >= {K} and rk <= {K})""",
    """ag as (select run, ticker, row_id, split, cat, f, cluster, distance from (
      select ce.run, p.ticker, p.row_id, p.split, p.cat, p.f, ce.cluster, list_distance(p.f, ce.c) distance,
        row_number() over (partition by ce.run, p.row_id order by list_distance(p.f, ce.c), ce.cluster) best from p join ce using (ticker)) where best = 1)""",
    "cg as (select run, ticker, split, cluster, cat, count(*) n from ag group by all)",
    "cc as (select s.*, c.cat, coalesce(cg.n, 0) n from (select distinct run, ticker, split, cluster from ag) s cross join (select unnest(range(0, 8))::int cat) c left join cg using (run, ticker, split, cluster, cat))",
    "cm as (select run, ticker, split, cluster, cat mode from (select *, row_number() over (partition by run, ticker, split, cluster order by n desc, cat) b from cc) where b = 1)",
    """pt as (select ticker, i, gain t from (select ticker, gain, row_number() over (partition by ticker order by gain) - 1 rk, count(*) over (partition by ticker) n from p0),
      (select unnest(range(1, 8))::int i) where n >= 8 and rk = ceil(n * i / 8.0))""",
    "sp as (select ticker, coalesce(min(case when t > 0 then i - 1 end), 0) s from pt group by 1)",
    f"""lb as (select run, ticker, cluster, case
        when count(*) filter (mode > s) = 3 then case when min(top) > {STRONG} then 'Strong Buy' when min(top) > {SOME} then 'Buy' else 'Weak Buy' end
        when count(*) filter (mode < s) = 3 then case when min(low) > {STRONG} then 'Strong Sell' when min(low) > {SOME} then 'Sell' else 'Weak Sell' end
        else 'Neutral' end "label", min(top) top_share
      from (select run, ticker, split, cluster, sum(n) filter (cat in (6, 7)) / sum(n) top, sum(n) filter (cat in (0, 1)) / sum(n) low from cc group by all) join cm using (run, ticker, split, cluster) join sp using (ticker)
      group by all having count(*) filter (split = 'train') > 0)""",
]
BOOK = [
    "o as (select uid ticker, ts placed_ts, event_id order_id, floor(bid * 0.9::double * 100 + 0.5::double) / 100 limit_price, size + 1 quantity from q where ticker = 'purchase')",
    "oq as (select uid ticker, ts, bid, ask, price from q where ticker <> 'purchase')",
    "bt as (select o.*, (select min(ts) from oq where oq.ticker = o.ticker and oq.ts >= o.placed_ts and oq.bid <= o.limit_price) touch_ts from o)",
    """fl as (select *, (select min(ts) from oq where oq.ticker = b.ticker and oq.ts >= b.touch_ts and sell_limit > 0 and oq.ask >= sell_limit) sell_ts
      from (select *, floor(limit_price * 1.2::double * 100 + 0.5::double) / 100 sell_limit from bt) b)""",
    "tb as (select coalesce(sum(limit_price::decimal(18,2) * quantity) filter (touch_ts is null), 0)::decimal(18,2) in_orders, coalesce(sum(limit_price::decimal(18,2) * quantity) filter (touch_ts is not null and sell_ts is null), 0)::decimal(18,2) in_stock from fl)",
    "lt as (select ticker, arg_max(bid, ts) bid, arg_max(ask, ts) ask, arg_max(price, ts) price from oq group by 1)",
    f"ul as (select distinct uid ticker, [{', '.join(repr(x) for x in LABELS)}][uid::bigint % 7 + 1] \"label\" from q)",
    """ut as (select ticker, i, gain t from (select uid ticker, (ask - bid) / nullif(bid, 0) gain, row_number() over (partition by uid order by (ask - bid) / nullif(bid, 0)) - 1 rk, count(*) over (partition by uid) n
      from q where bid <> 0), (select unnest(range(1, 8))::int i) where n >= 8 and rk = ceil(n * i / 8.0))""",
    "tl as (select ticker, arg_max(t, i) t_last from ut group by 1)",
    "nw as (select max(ts) now from events)",
]

#: A step from the centers of the step before; the last holds the centers after 100.
FIT_STEPS = """st as (select 0 step, run, ticker, cluster, c from ce where run < 2
          union all
          select step + 1, run, ticker, cluster, list(x order by dim) from (
            select step, run, ticker, cluster, dim, avg(x) x from (
              select step, run, ticker, cluster, unnest(f) x, unnest(range(0, len(f))) dim from (
                select step, st.run, p.ticker, p.f, st.cluster, row_number() over (partition by st.run, p.row_id order by list_distance(p.f, st.c), st.cluster) best from p join st using (ticker) where step < 100
              ) where best = 1
            ) group by all
          ) group by step, run, ticker, cluster)"""

ORACLES = {
    "candles_json": sql("select ticker, ts - interval 8 hour ts, open, high, low, close, volume from m  -- January: Pacific is UTC-8"),
    "daily_stamp": sql("select ticker, date::timestamp ts, open, high, low, close, volume from d where date between date '2024-01-05' and date '2024-01-25'"),
    "minute_bars": sql(f"select ticker, date_trunc('minute', ts)::timestamp + interval 1 minute ts, {r('arg_max(price, ts)', 'price')} from q group by 1, 2"),
    "dedupe_bars": sql("select ticker, ts, open, high, low, close, volume from m"),
    "history_summary": sql("select ticker, count(*) n_rows, min(ts) first_ts, max(ts) last_ts, arg_min(open, ts) first_open, arg_max(close, ts) last_close from m group by 1"),
    "average_volume": sql(f"select ticker, {r('sum(volume) / 30.0::double', 'avg_volume')} from (select *, row_number() over (partition by ticker order by date desc) i from l) where i <= 30 group by 1"),
    "last_n": sql("select * from (select *, row_number() over (partition by ticker order by date desc)::int days_ago from l) where days_ago <= 3"),
    "roll_features": sql("select * from (select *, row_number() over (partition by ticker order by date desc)::int days_ago from d) where days_ago <= 3"),
    "quotes_wide": sql(
        "select date_trunc('hour', ts)::timestamp ts, "
        + ", ".join(f"{r(f'arg_max({c}, ts) filter (ticker = {t!r})', f'{t}_{n}')}" for t in EVENT_TYPES for c, n in (("bid", "bid"), ("ask", "ask")))
        + ", "
        + ", ".join(f"arg_max({c}, ts) filter (ticker = '{t}') {t}_{n}" for t in EVENT_TYPES for c, n in (("size", "bid_size"), ("size + 1", "ask_size")))
        + " from q group by 1"
    ),
    "minute_end": sql("select event_id, date_trunc('minute', ts)::timestamp + interval 1 minute ts from q"),
    "retention": sql(
        """select event_id, uid ticker, ts from (select event_id, uid, ts, row_number() over (partition by uid order by ts) i, count(*) over (partition by uid) n from q)
        where n <= 60 or i > 20"""
    ),
    "wide_merge": sql("select ts, " + ", ".join(f"max({c}) filter (ticker = '{t}') {t}_{c}" for t in EVENT_TYPES for c in ("close", "volume")) + " from al group by 1", GRID),
    "market_holidays": sql("select date, holiday from hol", holidays("hol", "ospan")),
    "daily_grid": sql(
        """select date, row_number() over (order by date)::int session_no, date + interval 22 hour ts from (select unnest(generate_series(lo, hi, interval 1 day))::date date from ospan)
        where isodow(date) < 6 and date not in (select date from hol)""",
        holidays("hol", "ospan"),
    ),
    "minute_grid": sql(
        """select date, session_no, i minute_no, date + interval 4 hour + to_minutes(i - 1) ts from (
        select date, row_number() over (order by date)::int session_no from (select unnest(generate_series(lo, hi, interval 1 day))::date date from span) where isodow(date) < 6 and date not in (select date from hol)),
        (select unnest(range(1, 782))::int i)""",
        holidays("hol", "span"),
    ),
    "session_filter": sql(
        "select event_id, ticker, ts from q where isodow(ts) < 6 and ts::date not in (select date from hol) and ts::time between time '04:00:00' and time '17:00:00'", holidays("hol", "span")
    ),
    "rows_per_session": sql("select ticker, date, count(*) n_rows from grid group by 1, 2", GRID),
    "asof_align": sql("select ticker, ts, open, high, low, close, volume from al", GRID),
    "gap_fill": sql("select al.ticker, al.ts, al.close, al.volume from al join (select ticker, min(ts) a, max(ts) b from m group by 1) s using (ticker) where ts between a and b", GRID),
    "sma_daily": sql("select ticker, date, " + ", ".join(long(full("avg(close)", p), f"sma{p}") for p in MEAN_PERIODS) + " from l"),
    "std_daily": sql("select ticker, date, " + ", ".join(long(full("stddev_pop(close)", p), f"std{p}") for p in BOLLINGER) + " from l"),
    "bollinger_daily": sql(
        "select ticker, date, " + ", ".join(long(f"100 * (close - (a{p} - {w} * s{p})) / nullif(2 * {w} * s{p}, 0)", f"boll{p}") for p, w in BOLLINGER.items()) + " from x",
        "x as (select ticker, date, close, " + ", ".join(f"{full('avg(close)', p)} a{p}, {full('stddev_pop(close)', p)} s{p}" for p in BOLLINGER) + " from l)",
    ),
    "ema_daily": sql("select ticker, date, " + ", ".join(long(f"ema{p}", f"ema{p}") for p in MEAN_PERIODS) + " from em", ema("l", "em", {f"ema{p}": alpha(p) for p in MEAN_PERIODS})),
    "macd_daily": sql(f"select ticker, date, {long('line', 'macd_line')}, {long('signal', 'signal_line')}, {long('line - signal', 'macd_hist')} from md", *macd("l")),
    "rsi_daily": sql(f"select ticker, date, {long('case when rs.o > 0 then 100 - 100 / (1 + rs.g / rs.o) end', 'rsi')} from ch left join rs using (ticker, date)", *rsi("l")),
    "stochastic_daily": sql(f"select ticker, date, {long('k', 'k')}, {long('d', 'd')}, {long('d_slow', 'd_slow')} from st", *stoch("l")),
    "diff_high_low": sql(f"select ticker, date, {r('high - low', 'diff_high_low')} from l"),
    "spread_feature": sql(f"select event_id, {r('ask - bid', 'diff_high_low')} from q"),
    "day_high_low": sql("select ticker, ts, max(high) over w day_high, min(low) over w day_low from m window w as (partition by ticker, date order by ts rows unbounded preceding)"),
    "lag_close": sql("select ticker, ts, " + ", ".join(f"lag(close, {n}) over w {c}" for c, n in LAGS.items()) + " from al window w as (partition by ticker order by ts)", GRID),
    "sma_minute": minute(*[f"sma{p}" for p in MEAN_PERIODS]),
    "std_minute": minute(*[f"std{p}" for p in BOLLINGER]),
    "bollinger_minute": minute(*[f"boll{p}" for p in BOLLINGER]),
    "ema_minute": minute(*[f"ema{p}" for p in MEAN_PERIODS]),
    "macd_minute": minute("macd_line", "signal_line", "macd_hist"),
    "rsi_minute": minute("rsi"),
    "stochastic_minute": minute("k", "d", "d_slow"),
    "features_all": sql(
        "select ticker, ts, date, 1.0::double bias, "
        + ", ".join(r(c, c) for c in "close open high low".split())
        + ", "
        + ", ".join(r(f"lg.{c}", c) for c in LAGS)
        + f", {r('high - low', 'diff_high_low')}, "
        + ", ".join(r(c, c) for c in [*(f"sma{p}" for p in MEAN_PERIODS), *(f"ema{p}" for p in MEAN_PERIODS), "boll20", "boll50", "macd_line", "signal_line", "macd_hist", "rsi"])
        + f", {r('k', 'stochastic_k')}, {r('k - d', 'stochastic_k_d')} from mi join lg using (ticker, ts)",
        GRID,
        *minute_parts("al"),
        "lg as (select ticker, ts, " + ", ".join(f"lag(close, {n}) over w {c}" for c, n in LAGS.items()) + " from al window w as (partition by ticker order by ts))",
    ),
    "feature_min_max": sql(f"select ticker, feature, {r('min', 'min')}, {r('max', 'max')} from sc", *FEATURE_ROWS),
    "min_max_scale": sql(
        "select ticker, ts, " + ", ".join(r(f"({c} - (select min from sc where sc.ticker = fr.ticker and feature = '{c}')) / nullif((select max - min from sc where sc.ticker = fr.ticker and feature = '{c}'), 0)", c) for c in SCALED) + " from fr",
        *FEATURE_ROWS,
    ),
    "future_close": sql(f"select ticker, ts, close, future, {r('(future - close) / nullif(close, 0)', 'gain')} from (select *, lead(close, 1562) over (partition by ticker order by ts) future from al)", GRID),
    "future_close_minute": sql(f"select ticker, ts, close, future, {r('(future - close) / nullif(close, 0)', 'gain')} from (select *, lead(close, 30) over (partition by ticker order by ts) future from al)", GRID),
    "all_null_columns": sql(
        f"""select ticker, feature from (select ticker, unnest(['close', 'volume', 'sma5', 'sma50']) feature, unnest([close::double, volume::double, s5, s50]) x
          from (select *, {full('avg(close)', 5)} s5, {full('avg(close)', 50)} s50 from d)) group by 1, 2 having min(x) is null or min(x) = max(x)"""
    ),
    "drop_null_rows": sql("select ticker, ts, " + ", ".join(r(c, c) for c in SCALED) + " from fr where " + " and ".join(f"{c} is not null" for c in SCALED), *FEATURE_ROWS),
    "chrono_split": sql(
        """select ticker, date, case when i <= floor(0.6::decimal(2,1) * n) then 'train' when i <= floor(0.8::decimal(2,1) * n) then 'test1' else 'test2' end split
        from (select ticker, date, row_number() over (partition by ticker order by date) - 1 i, count(*) over (partition by ticker) n from l)"""
    ),
    "rank_thresholds": sql(f"select ticker, i, {r('t', 't')} from th", *GAINS),
    "categorize": sql("select ga.ticker, date, count(*) filter (gain > t)::int cat from ga join th using (ticker) group by ga.ticker, date", *GAINS),
    "training_matrix": sql(
        f"""select ticker, date, {r('(open - lo) / nullif(ho - lo, 0)', 'x0')}, {r('(close - lc) / nullif(hc - lc, 0)', 'x1')}, {r('cat / 7.0::double', 'x2')}
        from l join ct using (ticker, date) join bo using (ticker)""",
        *GAINS,
        "ct as (select ga.ticker, date, count(*) filter (gain > t) cat from ga join th using (ticker) group by ga.ticker, date)",
        "bo as (select ticker, min(open) lo, max(open) ho, min(close) lc, max(close) hc from l group by 1)",
    ),
    "nearest_centroid": sql(f"select ticker, row_id, cluster, {r('distance', 'distance')} from ag where run = 0", *CLUSTERS),
    "kmeans_step": sql(f"select ticker, cluster, dim, {r('avg(x)', 'x')} from (select ticker, cluster, unnest(f) x, unnest(range(0, len(f)))::int dim from ag where run = 0) group by 1, 2, 3", *CLUSTERS),
    "kmeans_fit": sql(
        f"select run, ticker, cluster, dim, {r('x', 'x')} from (select run, ticker, cluster, unnest(c) x, unnest(range(0, len(c)))::int dim from st where step = 100)",
        *CLUSTERS,
        FIT_STEPS,
    ),
    "assign_clusters": sql("select ticker, cluster, count(*) n_rows, string_agg(row_id::varchar, ',' order by row_id) \"rows\" from ag where run = 0 group by 1, 2", *CLUSTERS),
    "cluster_counts": sql("select ticker, split, cluster, cat, n from cc where run = 0", *CLUSTERS),
    "cluster_mode": sql("select ticker, split, cluster, mode from cm where run = 0", *CLUSTERS),
    "label_clusters": sql(f"select ticker, cluster, \"label\", {r('top_share', 'top_share')} from lb where run = 0", *CLUSTERS),
    "best_strong_buys": sql(
        f"""select run, ticker, cluster, case when "label" = 'Strong Buy' and rk > 3 then 'Buy' else "label" end "label", {r('top_share', 'top_share')}
        from (select *, row_number() over (partition by ticker, "label" order by top_share desc, run, cluster) rk from lb)""",
        *CLUSTERS,
    ),
    "strong_buy_count": sql("select ticker, count(*) filter (\"label\" = 'Strong Buy') n_strong_buy from lb group by 1", *CLUSTERS),
    "score_latest": sql(
        f"select ag.ticker, row_id, cluster, {r('distance', 'distance')}, lb.\"label\" from ag left join lb using (run, ticker, cluster) where run = 0 and row_id in (select max(row_id) from p group by ticker)", *CLUSTERS
    ),
    "usable_tickers": sql("select uid ticker from q group by 1 having count(distinct ticker) = 5"),
    "pick_buys": sql(f"select ticker, {r('t_last', 't_last')} from tl join ul using (ticker) where \"label\" = 'Strong Buy' order by t_last desc, ticker limit 3", *BOOK),
    "filter_orders": "select o_orderkey, o_orderdate entered, o_orderstatus status from orders where o_orderdate between timestamp '1996-01-01' and timestamp '1998-12-31' and o_orderstatus = 'F'",
    "order_touch": sql("select order_id, ticker, touch_ts from bt", *BOOK),
    "sell_touch": sql(f"select order_id, ticker, touch_ts buy_ts, {r('sell_limit', 'limit_sell_price')}, sell_ts touch_ts from fl where touch_ts is not null", *BOOK),
    "link_fills": sql(
        f"""select order_id + 1000000000 sell_order_id, ticker, {r('sell_limit', 'sell_price')}, sell_ts sell_time, order_id buy_order_id_link, order_id buy_order_id, {r('limit_price', 'price')}, quantity, touch_ts time_filled
        from fl where sell_ts is not null""",
        *BOOK,
    ),
    "fills": sql(
        f"""select order_id, ticker, case when sell_ts is not null then 'past' when touch_ts is not null then 'held' else 'open' end state, touch_ts buy_ts,
        {r('case when touch_ts is not null then limit_price end', 'buy_price')}, quantity, sell_ts, {r('case when sell_ts is not null then sell_limit end', 'sell_price')} from fl""",
        *BOOK,
    ),
    "total_balance": sql("select 300::decimal(18,2) available, in_orders, in_stock, (300 + in_orders + in_stock)::decimal(18,2) total from tb", *BOOK),
    "tradable": sql(
        f"""select ticker, {r('price', 'price')}, {r('avg_volume', 'avg_volume')} from lt join (select uid ticker, sum(v) / 30.0::double avg_volume from (
          select uid, sum(size) * 1000 v, row_number() over (partition by uid order by ts::date desc) i from q group by uid, ts::date) where i <= 30 group by 1) using (ticker),
        (select (300 + in_orders + in_stock)::double total from tb)
        where price <= greatest(total / 10, 100) and least(10000, total / 10) <= price * avg_volume * 0.01::double""",
        *BOOK,
    ),
    "sell_decisions": sql(
        f"""select order_id, ticker, case when has then 'replace' else 'place' end "action", {r('p', 'price')} from (
          select order_id, ticker, order_id % 2 = 0 and order_id > 0 has, case
            when not (order_id % 2 = 0 and order_id > 0) then limit_price * (1 + 2 * t_last)
            when now < touch_ts + interval 2 day then case when limit_price < bid and "label" like '%Sell' then price end
            when greatest(limit_price, price) < sell_limit then greatest(limit_price, price) end p
          from fl join lt using (ticker) left join ul using (ticker) left join tl using (ticker), nw where touch_ts is not null and sell_ts is null and touch_ts::date < now::date) where p is not null""",
        *BOOK,
    ),
    "cancel_decisions": sql(
        """select order_id, ticker, (limit_price::decimal(18,2) * quantity)::decimal(18,2) refund from fl left join ul using (ticker), nw
        where touch_ts is null and placed_ts + interval 10 minute < now and "label" is distinct from 'Strong Buy'""",
        *BOOK,
    ),
}
assert set(ORACLES) <= set(QUERIES)
