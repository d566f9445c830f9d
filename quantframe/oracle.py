"""The registered queries as SQL, for comparison in another engine.

The statements are written from the definitions, with plain windows over whole series: they check
results, not plans.
"""

from __future__ import annotations

from quantframe import catalog
from quantframe.operators import coint
from quantframe.sources.specs import GLOBAL_SPECS, SPECS, V3_SPECS, V4_SPECS

R = catalog.SPREAD_RULES
TRAIN, TEST, GAP = (catalog.FOLD[k] for k in ("train_days", "test_days", "embargo_days"))


def r(expression: str, places: int = 6) -> str:
    """Rounded, with negative zero made positive."""
    return f"(round({expression}, {places}) + 0.0)"


PRICES = """prices AS (
  SELECT o_orderpriority AS series_id, o_orderdate AS ts, CAST(count(*) AS DOUBLE) AS n_orders,
         CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100.0 AS value
  FROM orders GROUP BY 1, 2)"""

FWD = PRICES + """, fwd AS (
  SELECT series_id, ts, value, n_orders,
         lead(value, 1) OVER w / value - 1 AS fwd_1, lead(value, 5) OVER w / value - 1 AS fwd_5,
         lead(value, 20) OVER w / value - 1 AS fwd_20
  FROM prices WINDOW w AS (PARTITION BY series_id ORDER BY ts))"""

RETURNS = FWD + """, returns AS (SELECT series_id, ts, fwd_1 AS value FROM fwd WHERE fwd_1 IS NOT NULL)"""

ZSCORES = PRICES + f""", scored AS (
  SELECT series_id, ts, value, CASE WHEN count(value) OVER w = {catalog.ZSCORE_WINDOW}
         THEN (value - avg(value) OVER w) / (stddev_samp(value) OVER w + 1e-10) END AS zscore
  FROM prices WINDOW w AS (PARTITION BY series_id ORDER BY ts
    ROWS BETWEEN {catalog.ZSCORE_WINDOW - 1} PRECEDING AND CURRENT ROW)),
signals AS (SELECT series_id, ts, value, CASE WHEN zscore > 0.5 THEN 1 WHEN zscore < -0.5 THEN -1 ELSE 0 END AS signal
  FROM scored)"""


def normal_cdf(z: str) -> str:
    """The normal distribution by its series around 0, summed from the far end."""
    return (f"(0.5 + exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * ({z}) * list_reduce(list_concat([1.0::DOUBLE], "
            f"list_transform(range(300, 0, -1), lambda k: k::DOUBLE)), lambda s, k: 1 + s * ({z}) * ({z}) / (2 * k + 1)))")


def products(lags: str, source: str) -> str:
    """Cross products of [change, level before, changes 1..lags back] from the rows that have them."""
    def column(k: str) -> str:
        return f"CASE WHEN {k} = 1 THEN e[{lags} + 1:n - 1] ELSE c[{lags} + 1 - greatest({k} - 1, 0):n - 1 - greatest({k} - 1, 0)] END"

    return f"""SELECT a_id, b_id, n, {lags} AS lags, list_transform(range(0, {lags} + 2), lambda i: list_transform(
    range(0, {lags} + 2), lambda j: list_dot_product({column("i")}, {column("j")}))) AS m FROM {source}"""


def coint_screen() -> str:
    """Engle-Granger by elimination on the cross products: one column at a time leaves the residual sum of squares of
    every lag order in the first cell."""
    step = "list_transform(m, lambda x: list_transform(x, lambda v, j: v - x[{q}] * m[{q}][j] / m[{q}][{q}]))"
    polynomial = {k: " + ".join(f"({c}) * power(t, {i})" for i, c in enumerate(cs)) for k, cs in (("small", coint.P_SMALL), ("large", coint.P_LARGE))}
    crits = ", ".join(f"{r(f'{b[0]} + {b[1]} / (n - 1) + {b[2]} / ((n - 1) * (n - 1))')} AS crit_{k}pct" for k, b in (
        (1, coint.CRITICAL_1), (5, coint.CRITICAL_5), (10, coint.CRITICAL_10)))
    return f"""WITH RECURSIVE {ALIGNED}, fits AS (
  SELECT a_id, b_id, count(*) AS n, regr_slope(a, b) AS slope, regr_intercept(a, b) AS base,
         coalesce(regr_r2(a, b) >= {coint.COLLINEAR_R2!r}, false) AS collinear,
         CAST(least(floor(count(*) / 2) - 1, ceil(12 * power(count(*) / 100, 0.25))) AS BIGINT) AS most
  FROM aligned GROUP BY a_id, b_id),
left_over AS (
  SELECT a_id, b_id, n, most, list(a - base - slope * b ORDER BY ts) AS e
  FROM aligned JOIN fits USING (a_id, b_id) WHERE NOT collinear AND n - 1 - 2 * most > 1 AND most >= 0
  GROUP BY ALL),
moved AS (SELECT *, list_transform(range(2, n + 1), lambda i: e[i] - e[i - 1]) AS c FROM left_over),
nested AS (
  SELECT a_id, b_id, n, lags, 0 AS k, m FROM ({products("most", "moved")})
  UNION ALL SELECT a_id, b_id, n, lags, k + 1, {step.format(q="(k + 2)")} FROM nested WHERE k <= lags),
orders AS (
  SELECT a_id, b_id, k - 1 AS lag, (n - 1 - lags) * (ln(2 * pi() * m[1][1] / (n - 1 - lags)) + 1) + 2 * k AS aic
  FROM nested WHERE k > 0),
best AS (SELECT a_id, b_id, arg_min(lag, (aic, lag)) AS lag FROM orders GROUP BY a_id, b_id),
chosen AS (SELECT moved.*, lag FROM moved JOIN best USING (a_id, b_id)),
final AS (
  SELECT a_id, b_id, n, lags, 0 AS k, m FROM ({products("lag", "chosen")})
  UNION ALL SELECT a_id, b_id, n, lags, k + 1, {step.format(q="(k + 3)")} FROM final WHERE k < lags),
tested AS (
  SELECT a_id, b_id, lags AS used_lag, m[1][2] / m[2][2]
         / sqrt((m[1][1] - m[1][2] * m[1][2] / m[2][2]) / (n - 2 - 2 * lags) / m[2][2]) AS t
  FROM final WHERE k = lags),
scored AS (SELECT f.*, used_lag, CASE WHEN collinear THEN '-infinity'::DOUBLE ELSE t END AS t FROM fits f LEFT JOIN tested USING (a_id, b_id))
SELECT a_id, b_id, {r("t")} AS t_stat, CASE WHEN t < {coint.P_MIN} THEN 0.0 WHEN t > {coint.P_MAX} THEN 1.0
       WHEN t <= {coint.P_SPLIT} THEN {r(normal_cdf(polynomial["small"]))} ELSE {r(normal_cdf(polynomial["large"]))} END AS p_value,
       CAST(used_lag AS INTEGER) AS used_lag, n AS n_obs, collinear, {r("slope")} AS hedge_ratio, {crits}
FROM scored"""


def ranked_ic(source: str, keys: str) -> str:
    """Spearman correlation by average ranks over ``source(keys, factor, fwd_ret)``."""
    return f"""ranks AS (
  SELECT {keys}, rank() OVER (PARTITION BY {keys} ORDER BY factor)
           + (count(*) OVER (PARTITION BY {keys}, factor) - 1) / 2.0 AS rx,
         rank() OVER (PARTITION BY {keys} ORDER BY fwd_ret)
           + (count(*) OVER (PARTITION BY {keys}, fwd_ret) - 1) / 2.0 AS ry
  FROM {source} WHERE factor IS NOT NULL AND fwd_ret IS NOT NULL),
ics AS (SELECT {keys}, count(*) AS n_finite, CASE WHEN count(*) >= 10
    AND stddev_samp(rx) > 0 AND stddev_samp(ry) > 0
    THEN covar_samp(rx, ry) / (stddev_samp(rx) * stddev_samp(ry)) END AS ic FROM ranks GROUP BY {keys})"""


def decay(factor: str) -> str:
    branches = " UNION ALL ".join(
        f"SELECT series_id, {h} AS horizon, 'fwd_{h}' AS \"column\", {factor} AS factor, fwd_{h} AS fwd_ret FROM fwd"
        for h in catalog.HORIZONS)
    keys = 'series_id, horizon, "column"'
    return f"""WITH {FWD}, pairs AS ({branches}), {ranked_ic("pairs", keys)}
SELECT series_id, CAST(horizon AS INTEGER) AS horizon, "column", {r("any_value(ic)")} AS ic,
       count(factor + fwd_ret) AS n_obs
FROM pairs LEFT JOIN ics USING (series_id, horizon, "column") GROUP BY {keys}"""


def folds(train: int, test: int, gap: int, step: int, by_series: bool) -> str:
    key = "series_id" if by_series else "1"
    return f"""dates AS (SELECT DISTINCT {key} AS grp, ts FROM prices),
bounds AS (SELECT grp, min(ts) AS first_ts, max(ts) AS last_ts FROM dates GROUP BY grp),
candidates AS (
  SELECT grp, k, first_ts + to_days(CAST(k * {step} AS INTEGER)) AS t0, last_ts
  FROM bounds, range(0, CAST(date_diff('day', first_ts, last_ts) / {step} AS BIGINT) + 1) g(k)),
periods AS (
  SELECT grp, k, t0, t0 + to_days({train - 1}) AS t1, t0 + to_days({train + gap}) AS s0,
         t0 + to_days({train + gap + test - 1}) AS s1
  FROM candidates WHERE t0 + to_days({train + gap + test - 1}) <= last_ts),
counted AS (
  SELECT p.grp, k, count(*) FILTER (ts BETWEEN t0 AND t1) AS n_train, count(*) FILTER (ts BETWEEN s0 AND s1) AS n_test,
         min(ts) FILTER (ts BETWEEN t0 AND t1) AS train_start, max(ts) FILTER (ts BETWEEN t0 AND t1) AS train_end,
         min(ts) FILTER (ts BETWEEN s0 AND s1) AS test_start, max(ts) FILTER (ts BETWEEN s0 AND s1) AS test_end
  FROM periods p JOIN dates d ON p.grp = d.grp AND d.ts BETWEEN t0 AND s1 GROUP BY p.grp, k),
folds AS (
  SELECT grp, CAST(row_number() OVER (PARTITION BY grp ORDER BY k) - 1 AS INTEGER) AS fold_idx,
         train_start, train_end, test_start, test_end
  FROM counted WHERE n_train >= 10 AND n_test >= 5)"""


FOLDS = PRICES + ", " + folds(TRAIN, TEST, GAP, TEST, False)

FOLD_PAIRS = FWD + ", " + folds(TRAIN, TEST, GAP, TEST, False) + """, pairs AS (
  SELECT series_id, fold_idx, n_orders AS factor, fwd_5 AS fwd_ret
  FROM fwd JOIN folds ON ts BETWEEN train_start AND train_end), """ + ranked_ic("pairs", "series_id, fold_idx") + """,
directions AS (SELECT series_id, fold_idx, any_value(ic) AS ic,
    CASE WHEN any_value(ic) > 0.005 THEN 1 WHEN any_value(ic) < -0.005 THEN -1 ELSE 0 END AS direction
  FROM pairs LEFT JOIN ics USING (series_id, fold_idx) GROUP BY ALL)"""


def by_fold_zscores(value: str) -> str:
    return f"""train_stats AS (
  SELECT series_id, fold_idx, avg({value}) AS mu, stddev_samp({value}) AS sd
  FROM prices JOIN folds ON ts BETWEEN train_start AND train_end GROUP BY ALL),
fold_scores AS (
  SELECT p.series_id, p.ts, f.fold_idx, p.value, CASE WHEN sd >= 1e-10 THEN (p.{value} - mu) / sd END AS zscore
  FROM prices p JOIN folds f ON p.ts BETWEEN test_start AND test_end
  LEFT JOIN train_stats s ON s.series_id = p.series_id AND s.fold_idx = f.fold_idx)"""


def quantiles(rows: str, n: int, horizon: int) -> str:
    """Edges by linear interpolation between order statistics, right-closed buckets."""
    edges = ", ".join(
        f"CASE WHEN q{k} - floor(q{k}) < 0.5 THEN lo{k} + (hi{k} - lo{k}) * (q{k} - floor(q{k})) "
        f"ELSE hi{k} - (hi{k} - lo{k}) * (1 - (q{k} - floor(q{k}))) END AS e{k}" for k in range(n + 1))
    fractions = catalog.diagnostics._edge_fractions(n)
    spots = ", ".join(f"CAST({q!r} AS DOUBLE) * (max(total) - 1) AS q{k}, "
                      f"max(factor) FILTER (rn = floor(CAST({q!r} AS DOUBLE) * (total - 1))) AS lo{k}, "
                      f"max(factor) FILTER (rn = least(floor(CAST({q!r} AS DOUBLE) * (total - 1)) + 1, total - 1)) AS hi{k}"
                      for k, q in enumerate(fractions))
    bucket = " + ".join(f"CAST(e{k} < factor AS INTEGER)" for k in range(1, n))
    distinct_edges = "len(list_distinct([" + ", ".join(f"e{k}" for k in range(n + 1)) + "]))"
    return f"""rows_in AS ({rows}), valid AS (SELECT * FROM rows_in WHERE factor IS NOT NULL AND fwd_ret IS NOT NULL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY factor) - 1 AS rn,
    count(*) OVER (PARTITION BY series_id) AS total FROM valid),
spots AS (SELECT series_id, max(total) AS total, count(DISTINCT factor) AS distinct_total, {spots} FROM numbered GROUP BY 1),
edges AS (SELECT series_id, total, distinct_total, {edges} FROM spots),
checked AS (SELECT s.series_id, e.* EXCLUDE (series_id), CASE WHEN coalesce(total, 0) < {n} THEN 'too_few_rows'
    WHEN distinct_total < {n} THEN 'too_few_values' WHEN {distinct_edges} <= {n} THEN 'duplicate_edges' ELSE 'ok' END AS status
  FROM (SELECT DISTINCT series_id FROM rows_in) s LEFT JOIN edges e USING (series_id)),
bucketed AS (SELECT series_id, 1 + {bucket} AS quantile, fwd_ret FROM valid JOIN checked USING (series_id) WHERE status = 'ok'),
averaged AS (SELECT series_id, quantile, avg(fwd_ret) AS mean_return, count(*) AS "count" FROM bucketed GROUP BY ALL)
SELECT series_id, {horizon} AS horizon, quantile, {r("mean_return")} AS mean_return, "count", status
FROM checked LEFT JOIN averaged USING (series_id)"""


ALIGNED = PRICES + """, aligned AS (
  SELECT a.series_id AS a_id, b.series_id AS b_id, a.ts, a.value AS a, b.value AS b
  FROM prices a JOIN prices b ON a.ts = b.ts AND a.series_id < b.series_id)"""

SPREADS = ALIGNED + """, spreads AS (SELECT a_id || '|' || b_id AS series_id, ts, a - 1.0 * b AS value FROM aligned)"""


def drawdown(source: str, keys: str, curve: str, ts: str = "ts") -> str:
    """Depth of ``curve`` below its running peak, as a table ``depths``."""
    return f"""peaks AS (SELECT {keys}, {curve} AS eq, max({curve}) OVER (PARTITION BY {keys} ORDER BY {ts}) AS pk FROM {source}),
depths AS (SELECT {keys}, CASE WHEN count(*) < 2 THEN 0.0 ELSE min((eq - pk) / pk) END AS max_drawdown, count(*) AS n
  FROM peaks GROUP BY {keys})"""


def signal_trades(source: str, keys: str, hold: str, cost: str) -> str:
    """``source(keys, ts, signal, value)`` to trades; ``hold`` and ``cost`` may be columns of it."""
    return f"""numbered AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ts) - 1 AS i FROM {source}),
sampled AS (SELECT *, lead(ts) OVER s AS exit_date, lead(value) OVER s AS exit_price
  FROM (SELECT * FROM numbered WHERE i % {hold} = 0) WINDOW s AS (PARTITION BY {keys} ORDER BY ts)),
trades AS (SELECT {keys}, ts AS entry_date, exit_date, CAST(trunc(signal) AS INTEGER) AS position, value AS entry_price,
    exit_price, trunc(signal) * (exit_price / value - 1) AS gross_return,
    trunc(signal) * (exit_price / value - 1) - 2 * {cost} / 10000.0 AS net_return
  FROM sampled WHERE exit_date IS NOT NULL AND trunc(signal) <> 0 AND value > 0)"""


def signal_summary(keys: str, groups: str, hold: str) -> str:
    """Summary of ``trades`` for every row of the table ``groups(keys)``."""
    return f"""curves AS (SELECT {keys}, exit_date, product(1 + net_return) OVER (PARTITION BY {keys} ORDER BY exit_date) AS eq
  FROM trades), {drawdown("curves", keys, "eq", "exit_date")},
stats AS (SELECT {keys}, count(*) AS n_trades, 100 * avg(net_return) AS avg_return_pct,
    CASE WHEN stddev_samp(net_return) >= 1e-14 THEN avg(net_return) / stddev_samp(net_return) END AS ratio,
    avg(CASE WHEN net_return > 0 THEN 1.0 WHEN net_return < 0 THEN 0.0 END) AS win_rate,
    sum(net_return) FILTER (net_return > 0) AS gains, -sum(net_return) FILTER (net_return < 0) AS losses,
    min(net_return) AS worst
  FROM trades GROUP BY {keys})
SELECT {keys}, {r(f"ratio * sqrt(365.0 / {hold})")} AS sharpe,
       CASE WHEN n_trades IS NULL THEN 0.0 WHEN n < 2 THEN 0.0 WHEN worst > -1 THEN {r("max_drawdown")} END AS max_drawdown,
       {r("win_rate")} AS win_rate,
       {r("CASE WHEN losses > 0 THEN coalesce(gains, 0) / losses WHEN gains > 0 THEN CAST('inf' AS DOUBLE) END")} AS profit_factor,
       coalesce(n_trades, 0) AS n_trades, coalesce({r("avg_return_pct")}, 0.0) AS avg_return_pct,
       CASE WHEN n >= 2 AND worst <= -1 THEN 'non_positive_equity' ELSE 'ok' END AS status
FROM {groups} LEFT JOIN stats USING ({keys}) LEFT JOIN depths USING ({keys})"""


TRADES = ZSCORES + ", " + signal_trades("signals", "series_id", "14", "5.0")
FREE_TRADES = ZSCORES + ", " + signal_trades("signals", "series_id", "14", "0.0")

# Sequential walk over the bars: (k, i) is a bar, pos/since the position after it, held the position into it.
SPREAD_WALK = SPREADS + f""", indexed AS (
  SELECT series_id, ts, value AS s, row_number() OVER o - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n,
         value - lag(value) OVER o AS change,
         CASE WHEN count(value) OVER f = {R.lookback}
              THEN (value - avg(value) OVER f) / (stddev_samp(value) OVER f + 1e-10) END AS z
  FROM spreads WINDOW o AS (PARTITION BY series_id ORDER BY ts),
    f AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN {R.lookback - 1} PRECEDING AND CURRENT ROW)),
bars AS (SELECT * FROM indexed WHERE n >= {R.lookback + 10}),
walk AS (
  SELECT series_id, CAST({R.lookback - 1} AS BIGINT) AS i, 0 AS pos, CAST(-1 AS BIGINT) AS since, 0 AS held,
         CAST(-1 AS BIGINT) AS closed_since, '' AS reason
  FROM bars WHERE i = {R.lookback - 1}
  UNION ALL
  SELECT series_id, i, CASE WHEN held = 0 THEN turn WHEN why = '' THEN held ELSE 0 END,
         CASE WHEN held = 0 AND turn <> 0 THEN i WHEN held <> 0 AND why = '' THEN since ELSE -1 END,
         held, CASE WHEN why = '' THEN -1 ELSE since END, why
  FROM (
    SELECT b.series_id, b.i, w.pos AS held, w.since,
           CASE WHEN z > {R.entry_z} THEN -1 WHEN z < -{R.entry_z} THEN 1 ELSE 0 END AS turn,
           CASE WHEN w.pos = 0 THEN ''
                WHEN b.i - w.since >= {R.max_holding_bars} THEN 'max_hold'
                WHEN (w.pos = 1 AND z < -{R.stop_z}) OR (w.pos = -1 AND z > {R.stop_z}) THEN 'stop'
                WHEN (w.pos = 1 AND z >= -{R.exit_z}) OR (w.pos = -1 AND z <= {R.exit_z}) THEN 'reversion'
                ELSE '' END AS why
    FROM walk w JOIN bars b ON b.series_id = w.series_id AND b.i = w.i + 1)),
closings AS (
  SELECT series_id, i, closed_since AS since, held AS position, reason FROM walk WHERE reason <> ''
  UNION ALL
  SELECT series_id, i, since, pos, 'end_of_data' FROM walk JOIN bars USING (series_id, i) WHERE i = n - 1 AND pos <> 0),
trades AS (
  SELECT c.series_id, e.ts AS entry_date, x.ts AS exit_date, c.position, e.s AS entry_price, x.s AS exit_price,
         e.z AS entry_z, x.z AS exit_z, c.position * (x.s - e.s) - {R.cost_per_trade} AS pnl,
         CAST(x.i - e.i AS INTEGER) AS holding_bars, c.reason AS exit_reason
  FROM closings c JOIN bars e ON e.series_id = c.series_id AND e.i = c.since
  JOIN bars x ON x.series_id = c.series_id AND x.i = c.i),
pnl AS (
  SELECT w.series_id, b.ts, w.held * b.change - CASE WHEN c.i IS NULL THEN 0 ELSE {R.cost_per_trade} END AS daily_pnl
  FROM walk w JOIN bars b USING (series_id, i) LEFT JOIN closings c USING (series_id, i)
  WHERE w.i >= {R.lookback} AND series_id IN (SELECT series_id FROM trades)),
equity AS (
  SELECT series_id, ts, daily_pnl, daily_pnl / {R.capital_base} AS daily_returns,
         1 + sum(daily_pnl / {R.capital_base}) OVER (PARTITION BY series_id ORDER BY ts) AS equity FROM pnl)"""


def candles(name: str, minutes: int) -> str:
    return f"""{name} AS (SELECT event_type AS symbol, time_bucket(INTERVAL {minutes} MINUTE, ts) AS ts,
    min_by(value, event_id) AS o, max(value) AS h, min(value) AS l, max_by(value, event_id) AS c,
    CAST(count(*) AS DOUBLE) AS v FROM events GROUP BY 1, 2)"""


BARS = candles("bars", 15) + """, symbols AS (
  SELECT DISTINCT event_type AS symbol FROM events UNION ALL SELECT 'refund')"""
HOURLY = candles("hourly", 60)

ENDPOINT_HISTORY = HOURLY + """, history AS (
  SELECT CASE symbol WHEN 'click' THEN 'taker_pair' WHEN 'view' THEN 'taker_agg' WHEN 'error' THEN 'basis'
           WHEN 'signup' THEN 'fr_oi_weight' ELSE 'fear_greed' END AS endpoint, 'BTC' AS symbol,
         CASE WHEN hour(ts) % 2 = 0 THEN '4h' ELSE '1d' END AS "interval", ts, c AS value FROM hourly)"""


def gap_months_and_days() -> str:
    """Periods before the day of the reading time: months before its month, then days."""
    return f"""clock AS (SELECT date_trunc('day', TIMESTAMP '{catalog.AS_OF}') - INTERVAL 1 DAY AS last_day),
grid AS (
  SELECT symbol, 'month' AS unit, p AS period_start, p + INTERVAL 1 MONTH - INTERVAL 15 MINUTE AS period_end,
         date_diff('minute', p, p + INTERVAL 1 MONTH) // 15 AS expected
  FROM symbols, clock, generate_series(date_trunc('month', TIMESTAMP '{catalog.HISTORY_START}'),
       CAST(date_trunc('month', last_day) - INTERVAL 1 DAY AS TIMESTAMP), INTERVAL 1 MONTH) g(p)
  UNION ALL
  SELECT symbol, 'day', p, p + INTERVAL 1 DAY - INTERVAL 15 MINUTE, 96
  FROM symbols, clock, generate_series(CAST(date_trunc('month', last_day) AS TIMESTAMP), CAST(last_day AS TIMESTAMP),
       INTERVAL 1 DAY) g(p))"""


def payload_sql(spec) -> str:
    """Values of a derived document: the first field depends on the event, the others are its ``k``."""
    first, *others = spec.fields.values()
    value = "CASE WHEN event_id % 2 = 1 THEN value ELSE round(value * 2, 2) END"
    k = "CAST(json_extract_string(props, '$.k') AS DOUBLE)"
    ts = "date_trunc('second', ts)"
    if spec.epoch == "auto":
        ts = "CASE WHEN event_id % 2 = 1 THEN CAST(date_trunc('millisecond', ts) AS TIMESTAMP) ELSE CAST(date_trunc('second', ts) AS TIMESTAMP) END"
    columns = [f"{value} AS {first}", *(f"{k} AS {name}" for name in others)]
    if spec.name == "liq":
        columns += [f"{value} - {k} AS net_liq", f"{value} + {k} AS total_liq"]
    return f"SELECT event_type AS symbol, event_id, {ts} AS ts, {', '.join(columns)} FROM events"


def metric(expression: str, name: str) -> str:
    excess_rate = f"(power(1.03, 1.0 / 252) - 1)"
    return f"""WITH {RETURNS}, e AS (SELECT series_id, value - {excess_rate} AS x FROM returns)
SELECT series_id, {r(expression)} AS {name}, count(*) AS n_obs, count(*) < 20 AS small_sample_warning FROM e GROUP BY series_id"""


def statements() -> dict[str, str]:
    sql: dict[str, str] = {}

    sql["forward_returns"] = f"""WITH {FWD} SELECT series_id, ts, {r("fwd_1")} AS fwd_1, {r("fwd_5")} AS fwd_5,
       {r("fwd_20")} AS fwd_20 FROM fwd"""
    sql["ic_decay"] = decay("value")
    sql["ic_decay_wide"] = decay("n_orders")
    sql["rank_ic"] = f"""WITH {FWD}, pairs AS (SELECT series_id, n_orders AS factor, fwd_5 AS fwd_ret FROM fwd),
{ranked_ic("pairs", "series_id")} SELECT series_id, {r("any_value(ic)")} AS ic, coalesce(any_value(n_finite), 0) AS n_finite
FROM pairs LEFT JOIN ics USING (series_id) GROUP BY series_id"""
    sql["rank_ic_by_date"] = f"""WITH {FWD}, pairs AS (
  SELECT strftime(ts, '%Y-%m') AS "month", n_orders AS factor, fwd_5 AS fwd_ret FROM fwd),
{ranked_ic("pairs", '"month"')} SELECT "month", {r("any_value(ic)")} AS ic, coalesce(any_value(n_finite), 0) AS n_finite
FROM pairs LEFT JOIN ics USING ("month") GROUP BY 1"""
    sql["ic_direction"] = f"""WITH {FOLD_PAIRS} SELECT series_id, fold_idx, {r("ic")} AS ic, direction FROM directions"""
    sql["quantile_returns"] = f"WITH {FWD}, " + quantiles(
        "SELECT series_id, value AS factor, fwd_5 AS fwd_ret FROM fwd", 5, 5)
    sql["quantile_returns_wide"] = f"WITH {FWD}, " + quantiles(
        "SELECT series_id, floor(value / 20000) AS factor, fwd_5 AS fwd_ret FROM fwd", 4, 5)

    sql["zscore_rolling"] = f"WITH {ZSCORES} SELECT series_id, ts, {r('zscore')} AS zscore FROM scored"
    sql["zscore_expanding"] = f"""WITH {PRICES}, scored AS (
  SELECT series_id, ts, CASE WHEN count(value) OVER w >= {catalog.ZSCORE_WINDOW}
         THEN (value - avg(value) OVER w) / (stddev_samp(value) OVER w + 1e-10) END AS zscore
  FROM prices WINDOW w AS (PARTITION BY series_id ORDER BY ts ROWS UNBOUNDED PRECEDING))
SELECT series_id, ts, {r("zscore")} AS zscore FROM scored"""
    sql["zscore_fixed"] = f"""WITH {FOLDS}, {by_fold_zscores("value")}
SELECT series_id, ts, fold_idx, {r("zscore")} AS zscore FROM fold_scores"""
    sql["threshold_signal"] = f"WITH {ZSCORES} SELECT series_id, ts, signal FROM signals"

    fold_columns = "fold_idx, train_start, train_end, test_start, test_end"
    sql["walk_forward_folds"] = f"WITH {FOLDS} SELECT {fold_columns} FROM folds"
    sql["walk_forward_overlapping"] = f"""WITH {PRICES}, {folds(200, 50, 5, 20, True)}
SELECT grp AS series_id, {fold_columns} FROM folds"""
    sql["fold_rows"] = f"""WITH {FOLDS}, parts AS (
  SELECT series_id, ts, fold_idx, 'train' AS split FROM prices JOIN folds ON ts BETWEEN train_start AND train_end
  UNION ALL
  SELECT series_id, ts, fold_idx, 'test' FROM prices JOIN folds ON ts BETWEEN test_start AND test_end)
SELECT series_id, fold_idx, split, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM parts GROUP BY ALL"""
    sql["select_dates"] = f"""WITH {PRICES} SELECT series_id, ts, {r("value")} AS value FROM prices
WHERE ts BETWEEN TIMESTAMP '1997-01-15' AND TIMESTAMP '1997-04-14'"""

    sql["sharpe"] = metric("avg(x) / stddev_samp(x) * sqrt(252)", "sharpe")
    sql["sortino"] = metric("avg(x) / sqrt(avg(power(least(x, 0), 2))) * sqrt(252)", "sortino")
    sql["max_drawdown"] = f"""WITH {PRICES}, {drawdown("prices", "series_id", "value")}
SELECT series_id, {r("max_drawdown")} AS max_drawdown, 'ok' AS status, n AS n_obs FROM depths"""
    sql["calmar"] = f"""WITH {RETURNS}, curves AS (
  SELECT series_id, ts, product(1 + value) OVER (PARTITION BY series_id ORDER BY ts) AS eq FROM returns),
{drawdown("curves", "series_id", "eq")}, growth AS (SELECT series_id, product(1 + value) AS g FROM returns GROUP BY 1)
SELECT series_id, {r("(power(g, 252.0 / n) - 1) / abs(max_drawdown)")} AS calmar, {r("max_drawdown")} AS max_drawdown,
       n AS n_obs, n < 20 AS small_sample_warning, 'ok' AS status FROM depths JOIN growth USING (series_id)"""
    sql["win_rate"] = f"""WITH {RETURNS}
SELECT series_id, {r("avg(CASE WHEN value > 0 THEN 1.0 WHEN value < 0 THEN 0.0 END)")} AS win_rate FROM returns GROUP BY 1"""
    sql["profit_factor"] = f"""WITH {RETURNS}
SELECT series_id, {r("sum(value) FILTER (value > 0) / -sum(value) FILTER (value < 0)")} AS profit_factor FROM returns GROUP BY 1"""
    sql["metric_flags"] = f"""WITH {RETURNS}, lagged AS (
  SELECT series_id, value, lag(value) OVER (PARTITION BY series_id ORDER BY ts) AS before FROM returns),
c AS (SELECT series_id, count(*) AS n, corr(value, before) AS rho FROM lagged GROUP BY 1)
SELECT series_id, n AS n_obs, n < 20 AS small_sample_warning, {r("CASE WHEN n >= 20 THEN rho END")} AS lag1_autocorr,
       coalesce(n >= 20 AND abs(rho) > 0.3, false) AS overlap_warning FROM c"""
    sql["equity_curves"] = f"""WITH {RETURNS}, curves AS (
  SELECT series_id, ts, product(1 + value) OVER w AS equity, 1 + sum(value) OVER w AS additive FROM returns
  WINDOW w AS (PARTITION BY series_id ORDER BY ts))
SELECT series_id, ts, {r("equity")} AS equity, {r("additive")} AS additive_equity,
       {r("equity / max(equity) OVER (PARTITION BY series_id ORDER BY ts) - 1")} AS drawdown FROM curves"""

    sql["build_spread"] = f"WITH {ALIGNED} SELECT a_id, b_id, ts, {r('a - 0.5 * b')} AS spread FROM aligned"
    sql["coint_screen"] = coint_screen()
    sql["hedge_ratio"] = f"""WITH {ALIGNED}, rolled AS (
  SELECT *, CASE WHEN count(*) OVER w = 60 AND regr_sxx(a, b) OVER w >= 1e-10 THEN regr_slope(a, b) OVER w END AS hedge
  FROM aligned WINDOW w AS (PARTITION BY a_id, b_id ORDER BY ts ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))
SELECT a_id, b_id, ts, {r("hedge")} AS hedge_ratio, {r("a - hedge * b", 4)} AS spread FROM rolled"""
    sql["half_life"] = f"""WITH {SPREADS}, lagged AS (
  SELECT series_id, value, lag(value) OVER (PARTITION BY series_id ORDER BY ts) AS before FROM spreads),
f AS (SELECT series_id, count(*) AS n, regr_slope(value - before, before) AS b FROM lagged GROUP BY 1)
SELECT series_id, {r("CASE WHEN n >= 20 AND b < 0 THEN -ln(2) / b ELSE CAST('inf' AS DOUBLE) END")} AS half_life, n AS n_obs FROM f"""

    trade_columns = f"""entry_date, exit_date, position, {r("entry_price")} AS entry_price, {r("exit_price")} AS exit_price"""
    sql["signal_trades"] = f"""WITH {TRADES} SELECT series_id, {trade_columns},
       {r("gross_return")} AS gross_return, {r("net_return")} AS net_return FROM trades"""
    sql["signal_summary"] = f"""WITH {TRADES}, names AS (SELECT DISTINCT series_id FROM prices),
{signal_summary("series_id", "names", "14")}"""
    keys = "series_id, holding_days, cost_bps"
    sql["signal_sweep"] = f"""WITH {ZSCORES}, params AS (
  SELECT CAST(h AS INTEGER) AS holding_days, CAST(c AS DOUBLE) AS cost_bps
  FROM (VALUES (5), (14), (30)) a(h), (VALUES (0), (10)) b(c)),
swept AS (SELECT * FROM signals, params), names AS (SELECT DISTINCT {keys} FROM swept),
{signal_trades("swept", keys, "holding_days", "cost_bps")}, {signal_summary(keys, "names", "holding_days")}"""
    keys = "series_id, fold_idx"
    sql["walk_forward_backtest"] = f"""WITH {FOLD_PAIRS}, {by_fold_zscores("n_orders")}, directed AS (
  SELECT series_id, fold_idx, ts, value,
         direction * CASE WHEN zscore > 0.5 THEN 1 WHEN zscore < -0.5 THEN -1 ELSE 0 END AS signal
  FROM fold_scores JOIN directions USING (series_id, fold_idx)),
names AS (SELECT DISTINCT series_id, fold_idx FROM prices JOIN folds ON ts BETWEEN test_start AND test_end),
{signal_trades("directed", keys, "5", "5.0")}, {signal_summary(keys, "names", "5")}"""
    sql["trade_costs"] = f"""WITH {FREE_TRADES}, held AS (
  SELECT *, date_diff('day', entry_date, exit_date) AS days FROM trades)
SELECT series_id, entry_date, entry_price * 5.0 * 2 / 10000 AS crypto_cost,
       entry_price * 1.5 * 0.0001 + entry_price * 0.00001 * days AS fx_cost,
       entry_price * 0.0002 + days * 0.5 AS own_cost FROM held"""
    sql["instrument_costs"] = f"""WITH {FREE_TRADES}, fees AS (
  SELECT o_orderpriority AS series_id, count(DISTINCT o_custkey) / 1000.0 AS taker_bps FROM orders GROUP BY 1)
SELECT series_id, entry_date, CASE WHEN series_id LIKE '1%'
         THEN entry_price * 1.5 * 0.0001 + entry_price * 0.00002 * date_diff('day', entry_date, exit_date)
         ELSE entry_price * taker_bps * 2 / 10000 END AS cost FROM trades JOIN fees USING (series_id)"""

    spread_walk = SPREAD_WALK
    sql["spread_trades"] = f"""WITH RECURSIVE {spread_walk} SELECT series_id, {trade_columns}, {r("entry_z")} AS entry_z,
       {r("exit_z")} AS exit_z, {r("pnl")} AS pnl, {r(f"pnl / {R.capital_base}")} AS "return", holding_bars, exit_reason FROM trades"""
    sql["spread_equity"] = f"""WITH RECURSIVE {spread_walk} SELECT series_id, ts, {r("daily_pnl")} AS daily_pnl,
       {r("daily_returns")} AS daily_returns, {r("equity")} AS equity FROM equity"""
    sql["spread_summary"] = f"""WITH RECURSIVE {spread_walk}, {drawdown("equity", "series_id", "equity")},
per_bar AS (SELECT series_id, min(equity) <= 0 AS broke, CASE WHEN stddev_samp(daily_returns) >= 1e-14
    THEN avg(daily_returns) / stddev_samp(daily_returns) * sqrt(252) END AS sharpe FROM equity GROUP BY 1),
per_trade AS (SELECT series_id, count(*) AS n_trades, avg(CAST(pnl > 0 AS INTEGER)) AS win_rate,
    avg(holding_bars) AS avg_holding, avg(pnl) AS avg_pnl, sum(pnl) FILTER (pnl > 0) AS gains,
    -sum(pnl) FILTER (pnl < 0) AS losses FROM trades GROUP BY 1)
SELECT series_id, {r("sharpe")} AS sharpe,
       CASE WHEN n_trades IS NULL THEN 0.0 WHEN NOT broke THEN {r("max_drawdown")} END AS max_drawdown, {r("win_rate")} AS win_rate,
       {r("CASE WHEN losses > 0 THEN coalesce(gains, 0) / losses WHEN gains > 0 THEN CAST('inf' AS DOUBLE) END")} AS profit_factor,
       coalesce(n_trades, 0) AS n_trades, coalesce({r("avg_holding")}, 0.0) AS avg_holding,
       coalesce({r("avg_pnl")}, 0.0) AS avg_pnl, CASE WHEN n_trades IS NOT NULL THEN {R.capital_base} END AS capital_base,
       coalesce(broke, false) AS equity_warning
FROM (SELECT DISTINCT series_id FROM spreads) LEFT JOIN per_trade USING (series_id) LEFT JOIN per_bar USING (series_id)
LEFT JOIN depths USING (series_id)"""

    number = "CASE WHEN value = 0 THEN NULL ELSE value END"
    sql["normalize_bars"] = f"""WITH numbered AS (
  SELECT *, row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY event_id DESC) AS k FROM events)
SELECT event_type AS symbol, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts, {number} AS o, {number} AS h, {number} AS l,
       {number} AS c, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS v FROM numbered WHERE k = 1"""
    sql["latest_per_key"] = """SELECT user_id, event_type, ts, event_id, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1"""
    sql["union_batches"] = f"""WITH {HOURLY}, {candles("bars", 15)}, merged AS (
  SELECT symbol, v, NULL AS h FROM hourly UNION ALL SELECT symbol, v, h FROM bars)
SELECT symbol, count(*) AS rows, count(h) AS with_high, sum(v) AS events FROM merged GROUP BY 1"""
    sql["coverage_summary"] = f"""WITH {BARS} SELECT symbol, count(ts) AS rows, min(ts) AS start, max(ts) AS "end"
FROM symbols LEFT JOIN bars USING (symbol) GROUP BY 1"""
    sql["manifest"] = """SELECT CASE WHEN value < 5 THEN '4h' WHEN value < 50 THEN '1d' END AS "interval",
       event_type || '_k' AS endpoint, count(*) AS rows, min(ts) AS earliest_start, max(ts) AS latest_end FROM events GROUP BY 1, 2"""
    sql["missing_periods"] = f"""WITH {BARS}, {gap_months_and_days()}
SELECT g.symbol, unit, period_start, period_end, expected, count(b.ts) AS present
FROM grid g LEFT JOIN bars b ON b.symbol = g.symbol AND b.ts BETWEEN period_start AND period_end
GROUP BY ALL HAVING count(b.ts) < expected"""
    sql["fetch_watermark"] = f"""WITH {BARS}, clock AS (SELECT time_bucket(INTERVAL 15 MINUTE, TIMESTAMP '{catalog.AS_OF}') AS to_ts),
stored AS (SELECT symbol, max(ts) AS last_ts FROM bars GROUP BY 1)
SELECT symbol, last_ts, coalesce(last_ts + INTERVAL 15 MINUTE, to_ts - INTERVAL 2 DAY) AS from_ts, to_ts
FROM symbols LEFT JOIN stored USING (symbol), clock WHERE coalesce(last_ts + INTERVAL 15 MINUTE, to_ts - INTERVAL 2 DAY) <= to_ts"""
    sql["universe_filter"] = f"""WITH {candles("bars", 15)} SELECT upper(symbol) AS symbol, count(*) AS n, sum(v) AS events FROM bars
WHERE symbol IN ('click', 'view', 'purchase') GROUP BY 1"""

    for spec in (*V3_SPECS, *V4_SPECS, *GLOBAL_SPECS):
        sql[f"read_payload_{spec.name}"] = payload_sql(spec)
    sql["read_snapshot"] = "SELECT event_id, event_type, value FROM events"
    every_bar = f"WITH {candles('bars', 15)} SELECT symbol, ts, o, h, l, c, v FROM bars"
    sql["read_kline_pages"] = sql["read_kline_csv"] = every_bar
    sql["read_kline_zips"] = every_bar.replace("SELECT symbol, ts, o, h", "SELECT upper(symbol) AS symbol, ts, o, h")

    sql["read_kline_archives"] = sql["read_kline_zips"]
    sql["import_history_csv"] = f"WITH {HOURLY} SELECT symbol, ts, o, h, l, c, v FROM hourly"
    sql["corrupt_documents"] = """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN '{"code":"' WHEN event_id % 11 = 0
       THEN '{"code":"40001","msg":"no"}' ELSE '{"code":"0"}' END AS value FROM events
WHERE event_id % 7 = 0 OR event_id % 11 = 0 OR event_id % 13 = 0"""
    sql["history_upsert"] = f"""WITH {HOURLY}, marked AS (SELECT *, ts >= TIMESTAMP '{catalog.TAIL_FROM}' AS late FROM hourly)
SELECT 'v4' AS api_version, '1h' AS "interval", 'taker_pair' AS endpoint, symbol, ts, CASE WHEN late THEN h ELSE o END AS buy,
       CASE WHEN late THEN l ELSE c END AS sell, CASE WHEN late THEN v END AS trades,
       CASE WHEN late THEN TIMESTAMP '2024-02-02' ELSE TIMESTAMP '2024-02-01' END AS fetched_at FROM marked"""
    sql["stream_upsert"] = """SELECT event_type AS symbol, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts, max_by(value, event_id) AS buy
FROM events GROUP BY 1, 2"""
    sql["stream_upsert_log"] = sql["stream_upsert"]
    sql["snapshot_append"] = """SELECT event_type, count(*) AS n, CAST(NULL AS DOUBLE) AS top, 'oi_exchange' AS endpoint,
       TIMESTAMP '2024-02-01' AS fetched_at FROM events GROUP BY 1
UNION ALL SELECT event_type, count(*), max(value), 'oi_exchange', TIMESTAMP '2024-02-02' FROM events GROUP BY 1"""
    sql["stream_snapshots"] = "SELECT event_id, value, 'oi_exchange' AS endpoint, CAST(0 AS BIGINT) AS batch_id FROM events"
    sql["save_bars"] = f"""WITH {candles("bars", 15)} SELECT symbol, count(*) AS rows, min(ts) AS start, max(ts) AS "end" FROM bars GROUP BY 1"""
    sql["refresh_bars"] = f"""WITH {candles("bars", 15)}
SELECT symbol, ts, o, h, l, CASE WHEN ts >= TIMESTAMP '{catalog.TAIL_FROM}' THEN h ELSE c END AS c, v FROM bars
WHERE ts + INTERVAL 15 MINUTE <= TIMESTAMP '{catalog.REFRESH_AS_OF}'"""
    sql["refresh_endpoints"] = """WITH e AS (
  SELECT CASE event_type WHEN 'click' THEN 'taker_pair' WHEN 'view' THEN 'basis' WHEN 'error' THEN 'fr' END AS endpoint,
         event_type, date_trunc(CASE WHEN event_type <> 'error' AND event_id % 2 = 1 THEN 'millisecond' ELSE 'second' END, ts) AS ts FROM events)
SELECT 'v4_4h' AS scope, 'BTC_' || endpoint AS name, count(DISTINCT ts) AS rows,
       CAST(date_trunc('second', min(ts)) AS TIMESTAMP) AS start, CAST(date_trunc('second', max(ts)) AS TIMESTAMP) AS "end"
FROM e WHERE endpoint IS NOT NULL GROUP BY endpoint
UNION ALL SELECT 'v4_global', 'cgdi', count(DISTINCT ts), CAST(date_trunc('second', min(ts)) AS TIMESTAMP),
       CAST(date_trunc('second', max(ts)) AS TIMESTAMP) FROM e WHERE event_type = 'signup'
UNION ALL SELECT 'v4_snapshot', 'BTC_oi_exchange', count(*), NULL, NULL FROM e WHERE event_type = 'purchase'"""
    sql["document_report"] = """SELECT CASE event_id % 7 WHEN 1 THEN 'other' ELSE 'coinbase_premium' END AS endpoint,
       CASE event_id % 7 WHEN 0 THEN 'unsupported_symbol' WHEN 1 THEN 'unknown_endpoint' WHEN 2 THEN 'unreadable'
            WHEN 3 THEN 'refused' WHEN 4 THEN 'no_data' ELSE 'ok' END AS status, count(*) AS documents FROM events GROUP BY 1, 2"""
    sql["read_payload_many"] = """SELECT event_type AS symbol, date_trunc('millisecond', ts) AS ts, value AS buy,
       CAST(event_id AS DOUBLE) AS sell FROM events"""
    sql["export_taker"] = f"""WITH {ENDPOINT_HISTORY} SELECT CASE endpoint WHEN 'taker_pair' THEN 'pair' ELSE 'agg' END AS endpoint,
       symbol, "interval", ts, value FROM history WHERE "interval" = '4h' AND endpoint IN ('taker_pair', 'taker_agg')"""
    sql["export_daily"] = f"""WITH {ENDPOINT_HISTORY} SELECT CASE endpoint WHEN 'basis' THEN 'basis' ELSE 'fr_oiw' END AS endpoint,
       symbol, "interval", ts, value FROM history WHERE "interval" = '1d' AND endpoint IN ('basis', 'fr_oi_weight')"""
    sql["export_global"] = f"""WITH {ENDPOINT_HISTORY} SELECT 'global_fg' AS endpoint, ts, value AS fear_greed
FROM history WHERE endpoint = 'fear_greed'"""
    # the plans for long series answer the same statements
    sql |= {f"{name}_blocks": sql[name] for name in catalog.IN_BLOCKS}
    return sql
