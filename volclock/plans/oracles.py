"""DuckDB SQL that gives the results of the registered queries."""

from __future__ import annotations

from volclock.operators.fracdiff import weights


def candle(minutes: int = 60, name: str = "c") -> str:
    return f"""{name} AS (SELECT event_type AS symbol, time_bucket(INTERVAL '{minutes} minutes', ts) AS time, arg_min(value, ts) AS open, max(value) AS high,
  min(value) AS low, arg_max(value, ts) AS close, count(*) AS tick_volume, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS spread FROM events GROUP BY 1, 2)"""


TICKS = """t AS (SELECT event_type AS symbol, ts AS time, value AS open, value AS high, value AS low, value AS close,
  CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 AS tick_volume, CAST(json_extract_string(props, '$.k') AS BIGINT) AS spread FROM events)"""
C = candle()
W = "PARTITION BY symbol ORDER BY time"


def back(n: int) -> str:
    return f"OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def over(f: str, x: str, n: int, least: int | None = None) -> str:
    return f"CASE WHEN count({x}) {back(n)} >= {n if least is None else least} THEN {f}({x}) {back(n)} END"


def med(x: str, n: int, least: int) -> str:
    return f"CASE WHEN count({x}) {back(n)} >= {least} THEN quantile_cont({x}, 0.5) {back(n)} END"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER ({W})"


def chg(n: int = 1) -> str:
    return f"(close / nullif({lag('close', n)}, 0) - 1)"


def z(x: str, n: int, least: int = 20) -> str:
    return f"({x} - {over('avg', x, n, least)}) / nullif({over('stddev_samp', x, n, least)}, 0)"


def r6(**columns: str) -> str:
    return ", ".join(f"round({v}, 6) AS {k}" for k, v in columns.items())


def plain(body: str, ctes: str = C) -> str:
    return f"WITH {ctes} SELECT symbol, time, {body}"


R = f"r AS (SELECT *, {chg()} AS ret, ln(close / nullif({lag('close')}, 0)) AS lr FROM c)"
NUMBERED = f"n AS (SELECT *, row_number() OVER ({W}) AS rn, close - {lag('close')} AS step, greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) AS tr FROM c)"


def means(name: str = "e", source: str = "n") -> str:
    """Exponential means by recursion over row numbers."""
    a, f, s, g = "1.0 / 14", "2.0 / 13", "2.0 / 27", "2.0 / 10"
    return f"""{name} AS (
  SELECT symbol, time, close, rn, CAST(NULL AS DOUBLE) AS gain, CAST(NULL AS DOUBLE) AS loss, tr AS atr, close AS fast, close AS slow, CAST(0 AS DOUBLE) AS signal FROM {source} WHERE rn = 1
  UNION ALL
  SELECT n.symbol, n.time, n.close, n.rn,
    coalesce(e.gain * (1 - {a}) + {a} * greatest(n.step, 0), greatest(n.step, 0)), coalesce(e.loss * (1 - {a}) + {a} * greatest(-n.step, 0), greatest(-n.step, 0)),
    e.atr * (1 - {a}) + {a} * n.tr, e.fast * (1 - {f}) + {f} * n.close, e.slow * (1 - {s}) + {s} * n.close,
    e.signal * (1 - {g}) + {g} * ((e.fast * (1 - {f}) + {f} * n.close) - (e.slow * (1 - {s}) + {s} * n.close))
  FROM {name} e JOIN {source} n ON n.symbol = e.symbol AND n.rn = e.rn + 1)"""


EXPONENTIAL = f"WITH RECURSIVE {C}, {NUMBERED}, {means()}"
RSI = "CASE WHEN rn >= 15 THEN 100 - 100 / (1 + gain / nullif(loss, 0)) END"
ATR = "CASE WHEN rn >= 14 THEN atr / close END"
MACD, SIGNAL = "(fast - slow) * 10000 / close", "signal * 10000 / close"

HOUR = "(extract(hour FROM time) + extract(minute FROM time) / 60)"
ASIAN, LONDON, YORK = (f"({HOUR} >= {a} AND {HOUR} < {b})" for a, b in ((0, 7), (7, 16), (13, 22)))


def gone(a: int, b: int) -> str:
    return f"least(greatest(({HOUR} - {a}) / {b - a}, 0), 1)"


def width(cond: str) -> str:
    w = "OVER (PARTITION BY symbol, CAST(time AS DATE) ORDER BY time ROWS UNBOUNDED PRECEDING)"
    return f"CASE WHEN {cond} THEN max(CASE WHEN {cond} THEN high END) {w} - min(CASE WHEN {cond} THEN low END) {w} END"


VOLATILITY = f"v AS (SELECT *, {over('stddev_samp', 'ret', 48, 20)} * close * sqrt(48) AS daily_vol, {over('stddev_samp', 'ret', 12, 10)} / nullif({over('stddev_samp', 'ret', 96, 50)}, 0) AS ratio FROM r)"
MULT = "CASE WHEN ratio IS NULL THEN 1.0 ELSE least(greatest(1 + 0.3 * (ratio - 1), 0.5), 2.0) END"
LABELS = f"""{C}, {R}, {VOLATILITY},
p AS (SELECT symbol, time, close, daily_vol, {MULT} AS m, row_number() OVER ({W}) AS rn, count(*) OVER (PARTITION BY symbol) AS total FROM v),
hits AS (SELECT a.symbol, a.rn, min(b.rn - a.rn) AS j FROM p a JOIN p b ON a.symbol = b.symbol AND b.rn BETWEEN a.rn + 6 AND a.rn + 24
  AND (b.close >= a.close + 0.7 * (a.m * a.daily_vol) OR b.close <= a.close - 0.4 * (a.m * a.daily_vol)) GROUP BY 1, 2),
l AS (SELECT p.symbol, p.time, p.close, CASE WHEN fine THEN CASE WHEN h.j IS NULL THEN CASE WHEN abs((x.close - p.close) / 0.01) < 3 THEN 0 WHEN x.close > p.close THEN 1 ELSE -1 END
    WHEN x.close >= p.close + 0.7 * (p.m * p.daily_vol) THEN 1 ELSE -1 END END AS label,
  CASE WHEN fine THEN x.time END AS t1, CASE WHEN fine THEN x.close - p.close END AS ret, CASE WHEN fine THEN (x.close - p.close) / 0.01 END AS ret_pips,
  CASE WHEN fine THEN CASE WHEN h.j IS NULL THEN 'time' WHEN x.close >= p.close + 0.7 * (p.m * p.daily_vol) THEN 'upper' ELSE 'lower' END END AS barrier_type,
  CASE WHEN fine THEN coalesce(h.j, 24) END AS holding_period
  FROM (SELECT *, rn + 24 <= total AND daily_vol > 0 AS fine FROM p) p LEFT JOIN hits h ON h.symbol = p.symbol AND h.rn = p.rn LEFT JOIN p x ON x.symbol = p.symbol AND x.rn = p.rn + coalesce(h.j, 24))"""
#: The same for several settings: (setting, pt, sl, least and longest holding period, lookback).
GRID = f"""{C}, {R}, v AS (SELECT *, {over('stddev_samp', 'ret', 48, 20)} * close * sqrt(48) AS vol48, {over('stddev_samp', 'ret', 24, 20)} * close * sqrt(24) AS vol24,
  {over('stddev_samp', 'ret', 12, 10)} / nullif({over('stddev_samp', 'ret', 96, 50)}, 0) AS ratio FROM r),
g AS (SELECT setting, pt::DOUBLE AS pt, sl::DOUBLE AS sl, least, longest, n FROM (VALUES (0, 0.7, 0.4, 6, 24, 48), (1, 0.3, 0.3, 6, 24, 24), (2, 1.2, 0.5, 12, 36, 48), (3, 0.2, 1.1, 18, 48, 24)) AS g(setting, pt, sl, least, longest, n)),
q AS (SELECT symbol, time, close, vol24, vol48, {MULT} AS m, row_number() OVER ({W}) AS rn, count(*) OVER (PARTITION BY symbol) AS total FROM v),
b AS (SELECT *, close + pt * w AS up, close - sl * w AS down, rn + longest <= total AND w > 0 AS fine FROM (SELECT q.*, g.*, m * CASE WHEN n = 24 THEN vol24 ELSE vol48 END AS w FROM q, g)),
hits AS (SELECT b.setting, b.symbol, b.rn, min(q.rn - b.rn) AS j FROM b JOIN q ON q.symbol = b.symbol AND q.rn BETWEEN b.rn + b.least AND b.rn + b.longest AND (q.close >= b.up OR q.close <= b.down) GROUP BY ALL),
l AS (SELECT b.setting, b.symbol, b.time, CASE WHEN fine THEN CASE WHEN h.j IS NULL THEN CASE WHEN abs((x.close - b.close) / 0.01) < 3 THEN 0 WHEN x.close > b.close THEN 1 ELSE -1 END WHEN x.close >= up THEN 1 ELSE -1 END END AS label,
  CASE WHEN fine THEN x.time END AS t1, CASE WHEN fine THEN (x.close - b.close) / 0.01 END AS ret_pips,
  CASE WHEN fine THEN CASE WHEN h.j IS NULL THEN 'time' WHEN x.close >= up THEN 'upper' ELSE 'lower' END END AS barrier_type, CASE WHEN fine THEN coalesce(h.j, longest) END AS holding_period
  FROM b LEFT JOIN hits h ON h.setting = b.setting AND h.symbol = b.symbol AND h.rn = b.rn LEFT JOIN q x ON x.symbol = b.symbol AND x.rn = b.rn + coalesce(h.j, longest))"""
SPANS = f"{LABELS}, s AS (SELECT * FROM l WHERE label IS NOT NULL)"
POINTS = f"""{SPANS}, pts AS (SELECT symbol, t, sum(a) AS a, sum(b) AS b FROM (SELECT symbol, time AS t, 1 AS a, 0 AS b FROM s UNION ALL SELECT symbol, t1, 0, 1 FROM s) GROUP BY 1, 2),
con AS (SELECT symbol, t, CAST(sum(a) OVER (PARTITION BY symbol ORDER BY t) - coalesce(sum(b) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS concurrent FROM pts)"""
WEIGHTS = f"""{POINTS}, u AS (SELECT s.symbol, s.time, avg(1.0 / concurrent) AS u FROM s JOIN con ON con.symbol = s.symbol AND con.t BETWEEN s.time AND s.t1 GROUP BY 1, 2),
w AS (SELECT symbol, time, u * count(*) OVER (PARTITION BY symbol) / sum(u) OVER (PARTITION BY symbol) AS weight FROM u)"""
FOLDS = f"""{SPANS}, q AS (SELECT *, row_number() OVER ({W}) - 1 AS rn, count(*) OVER (PARTITION BY symbol) // 6 AS ts FROM s),
f AS (SELECT symbol, fold, ts * (fold + 1) AS a, ts * (fold + 2) AS b, greatest(ts * (fold + 1) - greatest(24, CAST(floor(ts * 0.01) AS BIGINT)), 0) AS e FROM (SELECT DISTINCT symbol, ts FROM q), (SELECT unnest(range(5)) AS fold)),
b AS (SELECT f.*, q.time AS test_time FROM f JOIN q ON q.symbol = f.symbol AND q.rn = f.a),
role AS (SELECT q.*, fold, test_time, CASE WHEN rn >= b.a AND rn < b.b THEN 'test' ELSE 'train' END AS role FROM q JOIN b USING (symbol) WHERE rn >= b.a AND rn < b.b OR rn < b.e AND t1 < test_time)"""
#: A feature's values come from the row so many places on in the order of a hash of seed, symbol and time.
PERMUTED = f"""WITH {FOLDS}, told AS (SELECT symbol, time, ret AS returns_1, tick_volume::DOUBLE AS tick_volume, spread::DOUBLE AS spread FROM r),
o AS (SELECT fold, label, told.*, row_number() OVER (PARTITION BY fold ORDER BY md5(concat_ws('|', '42', role.symbol, epoch_us(role.time)))) - 1 AS rk, count(*) OVER (PARTITION BY fold) AS n
  FROM role JOIN told ON told.symbol = role.symbol AND told.time = role.time WHERE role = 'test'),
nm AS (SELECT * FROM (VALUES ('', 0), ('returns_1', 1), ('tick_volume', 2), ('spread', 3)) AS nm(feature, place)),
x AS (SELECT a.fold, feature, a.label, CASE WHEN feature = 'returns_1' THEN d.returns_1 ELSE a.returns_1 END AS returns_1, CASE WHEN feature = 'tick_volume' THEN d.tick_volume ELSE a.tick_volume END AS tick_volume
  FROM o a CROSS JOIN nm JOIN o d ON d.fold = a.fold AND d.rk = (a.rk + greatest(1, a.n * place // 4)) % a.n),
s2 AS (SELECT fold, feature, avg(CASE WHEN label = CASE WHEN returns_1 > 0 AND tick_volume % 2 = 0 THEN 1 WHEN returns_1 < 0 THEN -1 ELSE 0 END THEN 1.0::DOUBLE ELSE 0 END) AS accuracy FROM x GROUP BY ALL)
SELECT CAST(p.fold AS INTEGER) AS fold, p.feature, round(p.accuracy, 6) AS accuracy, round(w.accuracy - p.accuracy, 6) AS importance FROM s2 p JOIN s2 w ON w.fold = p.fold AND w.feature = '' AND p.feature <> ''"""
_K = "((holding_period * 7 + extract(hour FROM time) * 3 + extract(day FROM time)) % 10)"
SCORED = f"""{SPANS}, sc AS (SELECT *, greatest(p0, 0.3, p2) AS best, CASE WHEN p0 >= 0.3 AND p0 >= p2 THEN 0 WHEN 0.3 >= p2 THEN 1 ELSE 2 END AS class
  FROM (SELECT *, ({_K} + 1) / 20.0::DOUBLE AS p0, 0.65::DOUBLE - {_K} / 20.0::DOUBLE AS p2 FROM s))"""
#: One row after the other: the last entry, and the ends of open trades as a list.
SIMULATED = f"""{SCORED}, sn AS (SELECT *, class - 1 AS predicted, row_number() OVER ({W}) AS rn FROM sc),
sim AS (
  SELECT symbol, rn, predicted <> 0 AS traded, CASE WHEN predicted <> 0 THEN time END AS entered, CASE WHEN predicted <> 0 THEN [t1] ELSE CAST([] AS TIMESTAMP[]) END AS open FROM sn WHERE rn = 1
  UNION ALL
  SELECT symbol, rn, take, CASE WHEN take THEN time ELSE entered END, CASE WHEN take THEN list_append(held, t1) ELSE held END
  FROM (SELECT *, predicted <> 0 AND len(held) < 3 AND (entered IS NULL OR time - entered >= INTERVAL 120 MINUTE) AS take
        FROM (SELECT n.symbol, n.rn, n.predicted, n.time, n.t1, m.entered, list_filter(m.open, lambda x: x > n.time) AS held FROM sim m JOIN sn n ON n.symbol = m.symbol AND n.rn = m.rn + 1))),
tr AS (SELECT sn.*, traded, CASE WHEN traded THEN sign(predicted) * ret_pips ELSE 0 END AS pnl FROM sn JOIN sim USING (symbol, rn))"""


def _bars(threshold: int) -> str:
    return f"""WITH RECURSIVE {TICKS}, n AS (SELECT *, row_number() OVER ({W}) AS rn FROM t),
b AS (SELECT symbol, rn, 0 AS bar, tick_volume AS v FROM n WHERE rn = 1
  UNION ALL SELECT n.symbol, n.rn, CASE WHEN b.v >= {threshold} THEN bar + 1 ELSE bar END, CASE WHEN b.v >= {threshold} THEN n.tick_volume ELSE b.v + n.tick_volume END
  FROM b JOIN n ON n.symbol = b.symbol AND n.rn = b.rn + 1)
SELECT symbol, CAST(bar AS BIGINT) AS bar_id, max(time) AS time, round(arg_min(open, time), 6) AS open, round(max(high), 6) AS high, round(min(low), 6) AS low, round(arg_max(close, time), 6) AS close,
  CAST(sum(tick_volume) AS BIGINT) AS tick_volume, round(sum(spread * tick_volume) / CAST(sum(tick_volume) AS DOUBLE), 6) AS spread, count(*) AS bar_count
FROM b JOIN n USING (symbol, rn) GROUP BY symbol, bar HAVING sum(tick_volume) >= {threshold}"""


PRICES = r6(open="open", high="high", low="low", close="close") + ", tick_volume, spread"
_FD = weights(0.5)
_ADF = f"""y AS (SELECT symbol, time, close - {lag('close')} AS d, {lag('close')} AS l FROM c), y2 AS (SELECT *, lag(d) OVER ({W}) AS b FROM y),
k AS (SELECT symbol, count(*) AS n, covar_pop(d, d) * count(*) AS yy, covar_pop(l, l) * count(*) AS ll, covar_pop(b, b) * count(*) AS bb, covar_pop(l, d) * count(*) AS ly, covar_pop(b, d) * count(*) AS byy, covar_pop(l, b) * count(*) AS lb FROM y2 WHERE b IS NOT NULL GROUP BY symbol),
k2 AS (SELECT *, ll * bb - lb * lb AS det, (bb * ly - lb * byy) / (ll * bb - lb * lb) AS a1, (ll * byy - lb * ly) / (ll * bb - lb * lb) AS a2 FROM k)"""


def _tests(orders: list[float]) -> str:
    """Every order by a join of rows with weights, then the regression and the p-value of its t."""
    of = {d: weights(d) if d else [1.0] for d in orders}
    k = " UNION ALL ".join(f"SELECT {float(d)!r}::DOUBLE AS d, {len(w)} AS size, unnest(range({len(w)})) AS i, unnest({w!r}::DOUBLE[]) AS w" for d, w in of.items())
    by = "PARTITION BY symbol, d ORDER BY time"
    surface = "CASE WHEN adf_stat <= -1.61 THEN 2.1659 + 1.4412 * adf_stat + 0.038269 * adf_stat ** 2 ELSE 1.7339 + 0.93202 * adf_stat - 0.12745 * adf_stat ** 2 - 0.010368 * adf_stat ** 3 END"
    terms = "list_reduce(list_concat([1.0::DOUBLE], range(120, 0, -1)::DOUBLE[]), lambda acc, k: 1 + acc * u * u / (2 * k + 1))"
    return f"""{C}, n AS (SELECT *, row_number() OVER ({W}) AS rn FROM c), w AS ({k}),
zs AS (SELECT a.symbol, a.time, w.d, a.close AS raw, sum(b.close * w) AS z FROM n a JOIN w ON a.rn >= size JOIN n b ON b.symbol = a.symbol AND b.rn = a.rn - i GROUP BY a.symbol, a.time, w.d, a.close),
y AS (SELECT *, lag(z) OVER ({by}) AS l, z - lag(z) OVER ({by}) AS y FROM zs), y2 AS (SELECT *, lag(y) OVER ({by}) AS b FROM y),
corrs AS (SELECT symbol, d, count(*) AS n_values, corr(raw, z) AS corr FROM zs GROUP BY ALL),
k AS (SELECT symbol, d, count(*) AS n, covar_pop(y, y) * count(*) AS yy, covar_pop(l, l) * count(*) AS ll, covar_pop(b, b) * count(*) AS bb, covar_pop(l, y) * count(*) AS ly, covar_pop(b, y) * count(*) AS byy, covar_pop(l, b) * count(*) AS lb FROM y2 WHERE b IS NOT NULL GROUP BY ALL),
k2 AS (SELECT *, ll * bb - lb * lb AS det, (bb * ly - lb * byy) / (ll * bb - lb * lb) AS a1, (ll * byy - lb * ly) / (ll * bb - lb * lb) AS a2 FROM k),
k3 AS (SELECT *, a1 / sqrt((yy - a1 * ly - a2 * byy) / (n - 3.0) * bb / det) AS adf_stat FROM k2),
k4 AS (SELECT *, greatest({surface}, -8.0::DOUBLE) AS u FROM k3),
tests AS (SELECT symbol, d, n_values, n, adf_stat, corr, CASE WHEN adf_stat > 2.74 THEN 1.0 WHEN adf_stat < -18.83 THEN 0.0 ELSE greatest(0.5 + exp(-u * u / 2) / sqrt(2 * pi()) * u * {terms}, 0) END AS p_value
  FROM k4 JOIN corrs USING (symbol, d))"""


_ISLANDS = f"""d AS (SELECT symbol, time, coalesce(sign(close - {lag('close')}), 0) AS d, row_number() OVER ({W}) AS rn FROM c),
g AS (SELECT *, rn - row_number() OVER (PARTITION BY symbol, d ORDER BY time) AS g FROM d)"""
_HURST = f"""q AS (SELECT symbol, time, lr, row_number() OVER ({W}) AS rn FROM r),
wide AS (SELECT a.symbol, a.time, b.rn, b.lr, avg(b.lr) OVER (PARTITION BY a.symbol, a.rn) AS m, stddev_samp(b.lr) OVER (PARTITION BY a.symbol, a.rn) AS s, count(b.lr) OVER (PARTITION BY a.symbol, a.rn) AS k, a.rn AS arn FROM q a JOIN q b ON a.symbol = b.symbol AND b.rn BETWEEN a.rn - 23 AND a.rn),
cum AS (SELECT *, sum(coalesce(lr - m, 0)) OVER (PARTITION BY symbol, arn ORDER BY rn) AS cs FROM wide),
h AS (SELECT symbol, time, CASE WHEN count(*) = 24 AND max(k) >= 10 AND max(s) > 0 AND max(cs) > min(cs) THEN ln((max(cs) - min(cs)) / max(s)) / ln(24) END AS hurst_h1 FROM cum GROUP BY symbol, time, arn)"""
_CLASSES = {"sell": -1, "hold": 0, "buy": 1}


def _share(name: str, k: int) -> str:
    hit, true, said = f"count(*) FILTER (label = {k} AND predicted = {k})", f"count(*) FILTER (label = {k})", f"count(*) FILTER (predicted = {k})"
    return r6(**{f"precision_{name}": f"CASE WHEN {true} > 0 THEN coalesce({hit} / nullif({said}, 0), 0) END", f"recall_{name}": f"CASE WHEN {true} > 0 THEN {hit} / nullif({true}, 0) END", f"share_{name}": f"{said} / count(*)"})


_F1 = " + ".join(f"coalesce(2.0 * count(*) FILTER (label = {k} AND predicted = {k}) / nullif(count(*) FILTER (label = {k}) + count(*) FILTER (predicted = {k}), 0), 0) * count(*) FILTER (label = {k})" for k in _CLASSES.values())

ORACLE_SQL: dict[str, str] = {
    "candles_h1": plain(f"{PRICES} FROM c"),
    "clean_bars": plain(f"{PRICES} FROM c WHERE high >= low AND tick_volume >= 3 AND spread <= 90"),
    "bar_problems": f"WITH {C} SELECT symbol, count(*) AS n_rows, count(*) FILTER (open IS NULL) AS null_open, count(*) FILTER (high IS NULL) AS null_high, count(*) FILTER (low IS NULL) AS null_low, count(*) FILTER (close IS NULL) AS null_close, count(*) FILTER (high < low) AS inverted FROM c GROUP BY symbol",
    "source_stats": f"WITH {C} SELECT symbol, count(*) AS n_rows, min(time) AS first_time, max(time) AS last_time, {r6(lowest='min(low)', highest='max(high)', mean_volume='avg(tick_volume)', mean_spread='avg(spread)')} FROM c GROUP BY symbol",
    "gap_report": f"WITH {C}, g AS (SELECT symbol, epoch(time - {lag('time')}) AS s FROM c) SELECT symbol, count(*) FILTER (s > 10800) AS n_gaps, round(max(s), 6) AS longest_s FROM g GROUP BY symbol",
    "overlap_report": f"""WITH {C}, x AS (SELECT greatest((SELECT min(time) FROM c WHERE symbol < 'm'), (SELECT min(time) FROM c WHERE symbol >= 'm')) AS first_time,
  least((SELECT max(time) FROM c WHERE symbol < 'm'), (SELECT max(time) FROM c WHERE symbol >= 'm')) AS last_time)
SELECT first_time, last_time, CAST(date_diff('day', first_time, last_time) AS INTEGER) AS days, date_diff('day', first_time, last_time) >= 20 AS enough FROM x""",
    "volume_bars": _bars(1500),
    "tick_bars": _bars(1000),
    "suggest_threshold": f"WITH {TICKS} SELECT symbol, CAST(floor(sum(tick_volume) / 50) AS BIGINT) AS threshold FROM t GROUP BY symbol",
    "log_returns": plain(r6(log_return_1="lr") + " FROM r", f"{C}, {R}"),
    "returns_multi": plain(r6(**{f"returns_{h}": chg(h) for h in (1, 3, 6, 12, 48)}) + " FROM c"),
    "rsi": f"{EXPONENTIAL} SELECT symbol, time, {r6(rsi=RSI)} FROM e",
    "macd": f"{EXPONENTIAL} SELECT symbol, time, {r6(macd_pct=MACD, macd_signal_pct=SIGNAL, macd_hist_pct=f'{MACD} - {SIGNAL}', ema_cross_pct=MACD)} FROM e",
    "atr": f"{EXPONENTIAL} SELECT symbol, time, {r6(atr_pct=ATR)} FROM e",
    "bollinger": plain(r6(bb_position="CASE WHEN s > 0 THEN (close - (m - 2 * s)) / nullif(4 * s, 0) ELSE 0.5 END", bb_width_pct="4 * s / close") + " FROM b", f"{C}, b AS (SELECT *, {over('avg', 'close', 20)} AS m, {over('stddev_samp', 'close', 20)} AS s FROM c)"),
    "realized_vol": plain(r6(realized_vol_96=f"{over('stddev_samp', 'lr', 96)} * sqrt(96)") + " FROM r", f"{C}, {R}"),
    "rolling_zscore": plain(r6(volume_zscore=z("tick_volume", 48), spread_zscore=z("spread", 48)) + " FROM c"),
    "order_flow": plain(
        r6(volume_ratio=f"tick_volume / nullif({over('avg', 'tick_volume', 48, 20)}, 0)", kyle_lambda="kyle", kyle_lambda_smooth=med("kyle", 48, 20), amihud="ami", amihud_smooth=med("ami", 48, 20)) + " FROM k",
        f"{C}, {R}, k AS (SELECT *, abs(ret) / nullif(tick_volume, 0) AS kyle, abs(ret) / nullif(tick_volume * close, 0) AS ami FROM r)",
    ),
    "vpin": plain(r6(vpin=f"{over('avg', 'i', 24, 20)} / nullif({over('avg', 'tick_volume', 24, 20)}, 0)") + " FROM k", f"{C}, k AS (SELECT *, abs(2 * tick_volume * coalesce((close - low) / nullif(high - low, 0), 0.5) - tick_volume) AS i FROM c)"),
    "bar_shape": plain(r6(body_ratio="(close - open) / nullif(high - low, 0)", upper_shadow_ratio="(high - greatest(open, close)) / nullif(high - low, 0)", lower_shadow_ratio="(least(open, close) - low) / nullif(high - low, 0)") + " FROM c"),
    "cyclical_time": plain(r6(hour_sin=f"sin(2 * pi() * {HOUR} / 24)", hour_cos=f"cos(2 * pi() * {HOUR} / 24)", dow_sin="sin(2 * pi() * (isodow(time) - 1) / 5)", dow_cos="cos(2 * pi() * (isodow(time) - 1) / 5)") + " FROM c"),
    "vol_regime": plain(r6(vol_regime=f"{over('stddev_samp', 'ret', 12, 10)} / nullif({over('stddev_samp', 'ret', 96, 50)}, 0)") + " FROM r", f"{C}, {R}"),
    "momentum": plain(
        r6(momentum_quality=f"abs({chg(12)}) / nullif({over('sum', 'ar', 12)}, 0)", return_acceleration="acc", return_acceleration_smooth=over("avg", "acc", 6, 3)) + " FROM k",
        f"{C}, {R}, k AS (SELECT *, abs(ret) AS ar, ret - lag(ret) OVER ({W}) AS acc FROM r)",
    ),
    "consecutive_dir": f"WITH {C}, {_ISLANDS} SELECT symbol, time, round(CAST(d * row_number() OVER (PARTITION BY symbol, d, g ORDER BY time) AS DOUBLE), 6) AS consecutive_direction FROM g",
    "vol_of_vol": f"{EXPONENTIAL}, a AS (SELECT symbol, time, {ATR} AS atr_pct FROM e) SELECT symbol, time, {r6(vol_of_vol=over('stddev_samp', 'atr_pct', 96, 50))} FROM a",
    "sessions": plain(
        f"session_id, is_london_ny_overlap, {r6(session_elapsed_pct='elapsed', session_range_pct='rg / nullif(' + over('avg', 'rg', 48, 20) + ', 0)', session_volume_pct='tick_volume / nullif(' + over('avg', 'tick_volume', 48, 20) + ', 0)')} FROM k",
        f"""{C}, k AS (SELECT *, CASE WHEN {YORK} THEN 2 WHEN {LONDON} THEN 1 WHEN {ASIAN} THEN 0 ELSE 3 END AS session_id, CAST({LONDON} AND {YORK} AS INTEGER) AS is_london_ny_overlap,
  CASE WHEN {YORK} THEN {gone(13, 22)} WHEN {LONDON} THEN {gone(7, 16)} WHEN {ASIAN} THEN {gone(0, 7)} ELSE 0.5 END AS elapsed, coalesce({width(YORK)}, {width(LONDON)}, {width(ASIAN)}) / close AS rg FROM c)""",
    ),
    "hurst": f"WITH {C}, {R}, {_HURST} SELECT symbol, time, {r6(hurst_h1='hurst_h1')} FROM h",
    "frac_diff": f"""WITH {C}, n AS (SELECT *, row_number() OVER ({W}) AS rn FROM c), k AS (SELECT unnest(range({len(_FD)})) AS i, unnest({_FD!r}::DOUBLE[]) AS w)
SELECT a.symbol, a.time, CASE WHEN a.rn >= {len(_FD)} THEN round(sum(b.close * w), 6) END AS frac_diff_close FROM n a JOIN k ON true LEFT JOIN n b ON b.symbol = a.symbol AND b.rn = a.rn - i GROUP BY a.symbol, a.time, a.rn""",
    "adf_stat": f"WITH {C}, {_ADF} SELECT symbol, n, {r6(adf_stat='a1 / sqrt((yy - a1 * ly - a2 * byy) / (n - 3.0) * bb / det)')} FROM k2",
    "adf_summary": f"WITH {_tests([0.0, 0.5, 1.0])} SELECT symbol, n, {r6(d='d', adf_stat='adf_stat', p_value='p_value', corr='corr')} FROM tests WHERE n_values >= 100",
    "min_d": f"WITH {_tests([0.0, 0.25, 0.5, 0.75, 1.0])} SELECT symbol, min(d) FILTER (n_values >= 100 AND p_value < 0.05) AS d FROM tests GROUP BY symbol",
    "h1_asof": f"""WITH {C}, {candle(5, 'm')}, b AS (SELECT *, {over('avg', 'close', 20)} AS mm, {over('stddev_samp', 'close', 20)} AS s, {chg()} AS r1 FROM c),
f AS (SELECT symbol, time, CASE WHEN s > 0 THEN (close - (mm - 2 * s)) / nullif(4 * s, 0) ELSE 0.5 END AS bb, r1 FROM b),
g AS (SELECT symbol, time, lag(bb) OVER ({W}) AS bb, lag(r1) OVER ({W}) AS r1 FROM f), g2 AS (SELECT * FROM g WHERE bb IS NOT NULL OR r1 IS NOT NULL)
SELECT m.symbol, m.time, {r6(close='m.close', bb_position_h1='g2.bb', returns_1_h1='g2.r1')} FROM m ASOF LEFT JOIN g2 ON m.symbol = g2.symbol AND m.time >= g2.time""",
    "normalise": f"""WITH {C}, b AS (SELECT *, {chg(1)} AS r1, {chg(3)} AS r3, {over('avg', 'close', 20)} AS m, {over('stddev_samp', 'close', 20)} AS s FROM c),
k AS (SELECT *, 4 * s / close AS bw, CASE WHEN s > 0 THEN (close - (m - 2 * s)) / nullif(4 * s, 0) ELSE 0.5 END AS bp FROM b),
o AS (SELECT symbol, time, {r6(returns_1=z('r1', 100), returns_3=z('r3', 100), bb_width_pct=z('bw', 100), bb_position='bp')} FROM k)
SELECT * FROM o WHERE returns_1 IS NOT NULL AND returns_3 IS NOT NULL AND bb_width_pct IS NOT NULL AND bb_position IS NOT NULL""",
    "daily_vol": plain(r6(daily_vol="daily_vol") + " FROM v", f"{C}, {R}, {VOLATILITY}"),
    "barrier_multiplier": plain(r6(barrier_mult=MULT) + " FROM v", f"{C}, {R}, {VOLATILITY}"),
    "triple_barrier": f"WITH {LABELS} SELECT symbol, time, label, t1, {r6(ret='ret', ret_pips='ret_pips')}, barrier_type, holding_period FROM l",
    "barrier_grid": f"WITH {GRID} SELECT setting, symbol, time, label, t1, {r6(ret_pips='ret_pips')}, barrier_type, holding_period FROM l",
    "permuted_accuracy": PERMUTED,
    "label_dist": f"WITH {LABELS} SELECT label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM l WHERE label IS NOT NULL GROUP BY label",
    "barrier_dist": f"WITH {LABELS} SELECT barrier_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM l WHERE barrier_type IS NOT NULL GROUP BY barrier_type",
    "concurrency": f"WITH {POINTS} SELECT symbol, t, concurrent FROM con",
    "sample_weights": f"WITH {WEIGHTS} SELECT symbol, time, round(weight, 6) AS weight FROM w",
    "effective_number": f"WITH {WEIGHTS} SELECT symbol, round(sum(weight) * sum(weight) / sum(weight * weight), 6) AS effective_n, count(*) AS n FROM w GROUP BY symbol",
    "cv_folds": f"WITH {FOLDS} SELECT symbol, CAST(fold AS INTEGER) AS fold, role, count(*) AS n, min(rn) AS first_rn, max(rn) AS last_rn FROM role GROUP BY ALL",
    "leakage_check": f"WITH {FOLDS} SELECT symbol, CAST(fold AS INTEGER) AS fold, count(*) FILTER (role = 'train' AND t1 >= test_time) AS n_leaking, count(*) FILTER (role = 'train') AS n_train, count(*) FILTER (role = 'test') AS n_test FROM role GROUP BY ALL",
    "confidence_filter": f"WITH {SCORED}, a AS (SELECT symbol, count(*) FILTER (class <> 1) AS before, count(*) FILTER (class <> 1 AND best >= 0.55) AS after FROM sc GROUP BY symbol) SELECT symbol, before, after, round(coalesce(100 * (before - after) / nullif(before, 0), 0), 6) AS filtered_pct FROM a",
    "position_size": f"WITH {SCORED} SELECT symbol, time, CASE WHEN best >= 0.75 THEN 1.0::DOUBLE WHEN best >= 0.6 THEN 0.5 WHEN best >= 0.45 THEN 0.25 ELSE 0 END AS size, CASE WHEN best >= 0.75 THEN 4.0::DOUBLE WHEN best >= 0.6 THEN 2 WHEN best >= 0.45 THEN 1 ELSE 0.5 END AS lots FROM sc",
    "live_gate": f"""WITH {SCORED} SELECT symbol, time, CASE WHEN best > 0.5 AND class <> 1 THEN class - 1 ELSE 0 END AS signal,
  CASE WHEN extract(hour FROM time) & 1 <> 0 THEN 'fok' WHEN extract(hour FROM time) & 2 <> 0 THEN 'ioc' ELSE 'return' END AS fill FROM sc""",
    "latest_quotes": plain("round(low, 6) AS bid, round(low + spread / 1000, 6) AS ask, (low + spread / 1000 - low) / 0.01 <= 0.35 AS tradable FROM c QUALIFY time = max(time) OVER (PARTITION BY symbol)"),
    "null_rows": f"WITH {C}, k AS (SELECT symbol, {chg(1)} IS NULL OR {chg(12)} IS NULL OR {chg(48)} IS NULL AS missing FROM c) SELECT symbol, count(*) AS n_rows, count(*) FILTER (missing) AS n_null_rows FROM k GROUP BY symbol",
    "class_report": f"""WITH {SCORED}, k AS (SELECT s.symbol, g.class, count(*) FILTER (s.class - 1 = g.class AND label = g.class) AS hit, count(*) FILTER (s.class - 1 = g.class) AS said, count(*) FILTER (label = g.class) AS support
  FROM sc s, (SELECT unnest([-1, 0, 1]) AS class) g GROUP BY ALL)
SELECT symbol, class, {r6(precision='coalesce(hit / nullif(said, 0), 0)', recall='coalesce(hit / nullif(support, 0), 0)', f1='coalesce(2 * hit / nullif(said + support, 0), 0)')}, support FROM k""",
    "tpsl_prices": plain(
        "round(round_even(CASE WHEN buy THEN high + 0.7 * w ELSE low - 0.7 * w END, 4), 6) AS tp, round(round_even(CASE WHEN buy THEN high - 0.4 * w ELSE low + 0.4 * w END, 4), 6) AS sl, CASE WHEN contains(symbol, 'JPY') THEN 0.01::DOUBLE ELSE 0.0001 END AS pip FROM k",
        f"{C}, {R}, {VOLATILITY}, k AS (SELECT *, daily_vol * ({MULT}) AS w, extract(hour FROM time) % 2 = 0 AS buy FROM v WHERE daily_vol IS NOT NULL)",
    ),
    "cross_tf": f"""{EXPONENTIAL}, {candle(15, 'm')}, n2 AS ({NUMBERED.removeprefix('n AS (').removesuffix('FROM c)')} FROM m), {means('e2', 'n2')},
g AS (SELECT symbol, time, lag(fast - slow) OVER ({W}) AS cross_h1, lag({RSI}) OVER ({W}) AS rsi_h1, lag(fast - slow - signal) OVER ({W}) AS hist_h1 FROM e QUALIFY row_number() OVER ({W}) > 1),
f AS (SELECT symbol, time, fast - slow AS cr, {RSI} AS rsi, fast - slow - signal AS hist FROM e2)
SELECT f.symbol, f.time, CAST(sign(cr) * sign(cross_h1) AS DOUBLE) AS trend_alignment, round(rsi - rsi_h1, 6) AS m5_vs_h1_rsi_divergence, CAST(sign(hist) * sign(hist_h1) AS DOUBLE) AS macd_alignment
FROM f ASOF LEFT JOIN g ON f.symbol = g.symbol AND f.time >= g.time""",
    "trade_sim": f"WITH RECURSIVE {SIMULATED} SELECT symbol, time, predicted, traded, round(pnl, 6) AS pnl FROM tr",
    "trading_metrics": f"""WITH RECURSIVE {SIMULATED}, a AS (SELECT symbol, count(*) FILTER (traded) AS n, count(*) FILTER (predicted <> 0) AS sig, coalesce(sum(pnl) FILTER (traded), 0) AS total, count(*) FILTER (traded AND pnl > 0) AS wins,
  coalesce(avg(pnl) FILTER (traded AND pnl > 0), 0) AS aw, coalesce(avg(pnl) FILTER (traded AND pnl < 0), 0) AS al, coalesce(sum(pnl) FILTER (traded AND pnl > 0), 0) AS gain, coalesce(abs(sum(pnl) FILTER (traded AND pnl < 0)), 0) AS loss,
  coalesce(avg(holding_period) FILTER (traded), 0) AS hold FROM tr GROUP BY symbol)
SELECT symbol, n AS n_trades, {r6(signals_filtered='coalesce((sig - n) / nullif(sig, 0), 0)', expected_return_pips='coalesce(total / nullif(n, 0), 0)', expected_return_after_costs_pips='CASE WHEN n > 0 THEN total / nullif(n, 0) - 1.7 ELSE 0 END', total_pnl_pips='total', total_pnl_after_costs_pips='total - n * 1.7', win_rate='coalesce(wins / nullif(n, 0), 0)', avg_win_pips='aw', avg_loss_pips='al', profit_factor="CASE WHEN n = 0 THEN 0 WHEN loss > 0 THEN gain / nullif(loss, 0) ELSE 'inf'::DOUBLE END", avg_holding_period='hold', total_cost_per_trade_pips='CASE WHEN n > 0 THEN 1.7::DOUBLE END', cost_as_pct_of_avg_return="CASE WHEN n > 0 THEN coalesce(1.7 / nullif(abs(total / n), 0), 'inf'::DOUBLE) END")} FROM a""",
    "daily_sharpe": f"""WITH RECURSIVE {SIMULATED}, d AS (SELECT symbol, CAST(time AS DATE) - CAST(greatest(isodow(time) - 5, 0) AS INTEGER) AS day, sum(pnl - CASE WHEN traded THEN 1.7 ELSE 0 END) AS net FROM tr GROUP BY 1, 2),
x AS (SELECT symbol, CAST(unnest(generate_series(min(day)::TIMESTAMP, max(day)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS day FROM d GROUP BY symbol), y AS (SELECT x.symbol, coalesce(net, 0) AS net FROM x LEFT JOIN d USING (symbol, day) WHERE isodow(x.day) < 6)
SELECT symbol, count(*) AS n_days, round(CASE WHEN stddev_samp(net) > 0 THEN avg(net) / stddev_samp(net) * sqrt(250) ELSE 0 END, 6) AS sharpe_ratio FROM y GROUP BY symbol""",
    "drawdown": f"WITH RECURSIVE {SIMULATED}, a AS (SELECT *, sum(pnl) OVER ({W}) AS cs FROM tr), b AS (SELECT *, cs - max(cs) OVER ({W}) AS down FROM a) SELECT symbol, round(min(down), 6) AS max_drawdown_pips FROM b GROUP BY symbol",
    "classification_metrics": f"WITH {SCORED}, k AS (SELECT *, class - 1 AS predicted FROM sc) SELECT symbol, count(*) AS n, {r6(accuracy='avg(CASE WHEN label = predicted THEN 1.0 ELSE 0 END)', f1_weighted=f'({_F1}) / count(*)')}, {', '.join(_share(n, k) for n, k in _CLASSES.items())} FROM k GROUP BY symbol",
    "dedupe_latest": "SELECT event_type AS symbol, date_trunc('hour', ts) AS time, max(event_id) AS event_id, round(arg_max(value, event_id), 6) AS value FROM events GROUP BY 1, 2",
    "keep_last_n": plain("round(close, 6) AS close FROM c QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY time DESC) <= 50"),
    "drop_open_candle": plain("round(close, 6) AS close FROM c QUALIFY time < max(time) OVER (PARTITION BY symbol)"),
    "fold_metrics": f"WITH {SCORED}, {FOLDS.removeprefix(SPANS + ', ').replace('FROM s)', 'FROM sc)')}, m AS (SELECT fold, avg(CASE WHEN label = class - 1 THEN 1.0 ELSE 0 END) AS accuracy, avg(ret_pips) AS mean_ret FROM role WHERE role = 'test' GROUP BY fold), u AS (SELECT 'accuracy' AS metric, accuracy AS v FROM m UNION ALL SELECT 'mean_ret', mean_ret FROM m) SELECT metric, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM u GROUP BY metric",
}
