"""The bar features in plain SQL, written from their definitions for comparison with the plans of this package.

Recurrences are recursive queries, one row at a time.
"""

from __future__ import annotations

import math

YEAR = math.sqrt(252 * 1440)

BARS = """ev AS (SELECT *, 100.0 + value AS price, row_number() OVER (ORDER BY ts, event_id) - 1 AS n FROM events),
bars AS (SELECT 'all' AS series_id, (n // 5)::BIGINT AS seq, min(ts) AS ts, arg_min(price, n) AS open, max(price) AS high,
  min(price) AS low, arg_max(price, n) AS close, sum(value) AS volume FROM ev GROUP BY 2)"""

SERIES_BARS = """ev AS (SELECT *, 100.0 + value AS price, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS n FROM events),
bars AS (SELECT event_type AS series_id, (n // 5)::BIGINT AS seq, min(ts) AS ts, arg_min(price, n) AS open, max(price) AS high,
  min(price) AS low, arg_max(price, n) AS close, sum(value) AS volume FROM ev GROUP BY 1, 2)"""

BASE = """lags AS (SELECT *, lag(close) OVER o AS pc, lag(high) OVER o AS ph, lag(low) OVER o AS pl, lead(high) OVER o AS nh, lead(low) OVER o AS nl,
    (high + low + close) / 3 AS tp FROM bars WINDOW o AS (PARTITION BY series_id ORDER BY seq)),
b AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr,
    CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS trange,
    ln(close / pc) AS lr, close / pc - 1 AS r, CASE WHEN pc IS NOT NULL THEN greatest(close - pc, 0) END AS gain,
    CASE WHEN pc IS NOT NULL THEN greatest(pc - close, 0) END AS loss,
    CASE WHEN high - ph > 0 AND high - ph > pl - low THEN high - ph WHEN pc IS NOT NULL THEN 0 END AS updm,
    CASE WHEN pl - low > 0 AND pl - low > high - ph THEN pl - low WHEN pc IS NOT NULL THEN 0 END AS downdm FROM lags)"""


def windows(*sizes: int) -> str:
    frames = [f"w{n} AS (PARTITION BY series_id ORDER BY seq ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in sorted(set(sizes))]
    frames += ["o AS (PARTITION BY series_id ORDER BY seq)", "u AS (PARTITION BY series_id ORDER BY seq ROWS UNBOUNDED PRECEDING)"]
    frames += ["before5 AS (PARTITION BY series_id ORDER BY seq ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"]
    return "WINDOW " + ", ".join(frames)


def full(call: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER w{n} = {n} THEN {call} OVER w{n} END"


def mean(x: str, n: int) -> str:
    return full(f"avg({x})", x, n)


def sd(x: str, n: int) -> str:
    return full(f"stddev_samp({x})", x, n)


def recursive(name: str, source: str, made: dict[str, tuple[int, str, str]]) -> str:
    """made: column -> (seed row, seed, step); the step may use prev. and x. (the row)."""
    start = ", ".join(f"(CASE WHEN {row} = 0 THEN {seed} END)::DOUBLE AS {c}" for c, (row, seed, _) in made.items())
    step = ", ".join(f"CASE WHEN x.seq < {row} THEN NULL WHEN x.seq = {row} THEN x.{seed} ELSE {then} END" for c, (row, seed, then) in made.items())
    return f"""{name} AS (SELECT series_id, seq, {start} FROM {source} WHERE seq = 0
  UNION ALL SELECT x.series_id, x.seq, {step} FROM {name} prev JOIN {source} x ON x.series_id = prev.series_id AND x.seq = prev.seq + 1)"""


def ema(c: str, x: str, span: int, row: int, seed: str) -> tuple[int, str, str]:
    a = 2 / (span + 1)
    return row, seed, f"prev.{c} + {a!r} * (x.{x} - prev.{c})"


def wilder(c: str, x: str, p: int, row: int, seed: str) -> tuple[int, str, str]:
    return row, seed, f"(prev.{c} * {p - 1} + x.{x}) / {p}"


def _seeds() -> str:
    cols = [f"{mean('trange', p)} AS m_tr{p}" for p in (10, 14, 20, 50)]
    cols += [f"{mean(x, p)} AS m_{x}{p}" for p in (7, 14, 21) for x in ("gain", "loss")]
    cols += [f"{mean('close', p)} AS m_c{p}" for p in (12, 20, 26, 50, 200)]
    cols += [f"{full(f'sum({x})', x, 13)} AS s_{x}" for x in ("updm", "downdm", "trange")]
    cols += [f"{sd('lr', 30)} * {YEAR!r} AS rv30", f"{mean('tr', 14)} AS tr14"]
    return f"s0 AS (SELECT *, {', '.join(cols)} FROM b {windows(7, 10, 12, 13, 14, 20, 21, 26, 30, 50, 200)}), s AS (SELECT *, {mean('rv30', 50)} AS m_rv30 FROM s0 {windows(50)})"


def _recurrences() -> str:
    made = {f"atr{p}": wilder(f"atr{p}", "trange", p, p, f"m_tr{p}") for p in (10, 14, 20, 50)}
    made |= {f"{x}_{p}": wilder(f"{x}_{p}", x, p, p, f"m_{x}{p}") for p in (7, 14, 21) for x in ("gain", "loss")}
    made |= {f"ema{p}": ema(f"ema{p}", "close", p, p - 1, f"m_c{p}") for p in (20, 50, 200)}
    made |= {"fast": ema("fast", "close", 12, 25, "m_c12"), "slow": ema("slow", "close", 26, 25, "m_c26")}
    made |= {"e20": ema("e20", "close", 20, 0, "close"), "e50": ema("e50", "close", 50, 0, "close")}
    made |= {f"w_{x}": (13, f"s_{x}", f"prev.w_{x} - prev.w_{x} / 14 + x.{x}") for x in ("updm", "downdm", "trange")}
    made |= {"rv_ema": ema("rv_ema", "rv30", 50, 79, "m_rv30")}
    return recursive("rec", "s", made)


SCANS = f"""{_seeds()},
{_recurrences()},
k0 AS (SELECT s.*, rec.* EXCLUDE (series_id, seq), fast - slow AS macd, e20 - e50 AS crossing,
    CASE WHEN s.seq >= 14 THEN CASE WHEN w_trange = 0 THEN 0 ELSE 100 * w_updm / w_trange END END AS dip,
    CASE WHEN s.seq >= 14 THEN CASE WHEN w_trange = 0 THEN 0 ELSE 100 * w_downdm / w_trange END END AS dim
  FROM s JOIN rec ON s.series_id = rec.series_id AND s.seq = rec.seq),
k AS (SELECT *, CASE WHEN dip + dim = 0 THEN 0 ELSE 100 * abs(dip - dim) / (dip + dim) END AS dx FROM k0)"""

SECOND_SCANS = f"""k1 AS (SELECT *, {mean('macd', 9)} AS m_macd, {mean('dx', 14)} AS m_dx FROM k {windows(9, 14)}),
{recursive('rec2', 'k1', {'signal': ema('signal', 'macd', 9, 33, 'm_macd'), 'adx': wilder('adx', 'dx', 14, 27, 'm_dx')})},
kk AS (SELECT k1.*, rec2.signal, rec2.adx FROM k1 JOIN rec2 ON k1.series_id = rec2.series_id AND k1.seq = rec2.seq)"""


def query(ctes: list[str], columns: dict[str, str], source: str, sizes: tuple[int, ...], ints: set[str] = frozenset(), bars: str = BARS, digits: int = 6) -> str:
    """The columns, rounded, of each bar; ints stay as they are."""
    inner = ", ".join(f"{x} AS {n}" for n, x in columns.items())
    outer = ", ".join(f"{n}::INTEGER AS {n}" if n in ints else f"(round({n}, {digits}) + 0.0)::DOUBLE AS {n}" for n in columns)
    return f"WITH RECURSIVE {', '.join([bars, BASE, *ctes])}, f AS (SELECT series_id, seq, {inner} FROM {source} {windows(*sizes)}) SELECT series_id, seq, {outer} FROM f"


def price(digits: int = 6) -> str:
    span = "nullif(high - low, 0)"
    runs = "seq - max(CASE WHEN {} THEN NULL ELSE seq END) OVER u"
    columns = {
        "log_return": "lr",
        "abs_return": "abs(lr)",
        "high_low_range": "(high - low) / nullif(avg(tr) OVER w14, 0)",
        "close_position": f"(close - low) / {span}",
        "body_ratio": f"abs(close - open) / {span}",
        "upper_wick_ratio": f"(high - greatest(open, close)) / {span}",
        "lower_wick_ratio": f"(least(open, close) - low) / {span}",
        "gap": "open - pc",
        "consecutive_up": f"({runs.format('close > pc')})::DOUBLE",
        "consecutive_down": f"({runs.format('close < pc')})::DOUBLE",
        "bar_return_zscore": f"({mean('r', 20)}) / nullif({sd('r', 20)}, 0)",
        **{f"price_vs_ema{p}": f"(close - ema{p}) / nullif(atr14, 0)" for p in (20, 50, 200)},
        "ema_cross_20_50": f"crossing / nullif({sd('crossing', 20)}, 0)",
        "ema_slope_20": "(e20 - lag(e20, 5) OVER o) / 5",
        "higher_high": "CASE WHEN count(high) OVER before5 = 5 AND high > max(high) OVER before5 THEN 1 ELSE 0 END",
        "lower_low": "CASE WHEN count(low) OVER before5 = 5 AND low < min(low) OVER before5 THEN 1 ELSE 0 END",
        "swing_strength": "abs(close - last_value(CASE WHEN low < pl AND low < nl THEN low WHEN high > ph AND high > nh THEN high END IGNORE NULLS) OVER u) / nullif(tr14, 0)",
    }
    return query([SCANS], columns, "k", (14, 20), {"higher_high", "lower_low"}, digits=digits)


def volatility(digits: int = 6) -> str:
    l2 = math.log(2)
    hl, co, ho, lo = "ln(high / low)", "ln(close / open)", "ln(high / open)", "ln(low / open)"
    pre = f"v0 AS (SELECT *, {hl} * {hl} AS pk, 0.5 * {hl} * {hl} - {2 * l2 - 1!r} * {co} * {co} AS gk, ln(open / pc) ** 2 + {ho} * ({ho} - {co}) + {lo} * ({lo} - {co}) AS yz, {sd('lr', 10)} * {YEAR!r} AS rv10 FROM k {windows(10)})"
    columns = {
        "atr_14": "atr14",
        "atr_50": "atr50",
        "atr_ratio": "atr14 / nullif(atr50, 0)",
        "realized_vol_10": "rv10",
        "realized_vol_30": "rv30",
        "realized_vol_60": f"({sd('lr', 60)}) * {YEAR!r}",
        "parkinson_vol": f"sqrt(({full('sum(pk)', 'pk', 30)}) / {120 * l2!r})",
        "garman_klass_vol": f"CASE WHEN ({mean('gk', 30)}) >= 0 THEN sqrt({mean('gk', 30)}) END",
        "yang_zhang_vol": f"CASE WHEN ({mean('yz', 30)}) >= 0 THEN sqrt({mean('yz', 30)}) END",
        "vol_of_vol": sd("rv10", 20),
        "vol_zscore": f"(atr14 - ({mean('atr14', 100)})) / nullif({sd('atr14', 100)}, 0)",
        "vol_percentile": "CAST(NULL AS DOUBLE)",
        "bollinger_width": f"4 * ({full('stddev_pop(close)', 'close', 20)}) / nullif({mean('close', 20)}, 0)",
        "keltner_width": "4 * atr20 / nullif(ema20, 0)",
        "natr": "100 * atr14 / nullif(close, 0)",
        "vol_regime_ma": "rv_ema",
        "vol_breakout": "CASE WHEN atr14 > 2 * atr50 THEN 1 ELSE 0 END",
        "vol_contraction": "CASE WHEN atr14 <= 0.5 * atr50 THEN 1 ELSE 0 END",
    }
    return query([SCANS, pre], columns, "v0", (20, 30, 60, 100), {"vol_breakout", "vol_contraction"}, digits=digits)


def momentum(digits: int = 6) -> str:
    span = "(max(high) OVER w14 - min(low) OVER w14)"
    gate = "count(high) OVER w14 = 14"
    pre = f"""m0 AS (SELECT *, CASE WHEN {gate} THEN CASE WHEN {span} = 0 THEN 0 ELSE 100 * (close - min(low) OVER w14) / {span} END END AS fk,
      CASE WHEN {gate} THEN CASE WHEN {span} = 0 THEN 0 ELSE -100 * (max(high) OVER w14 - close) / {span} END END AS wr,
      macd - signal AS hist, CASE WHEN gain_14 + loss_14 = 0 THEN 0 ELSE 100 * gain_14 / (gain_14 + loss_14) END AS rsi,
      avg(tp) OVER w14 AS t14, avg(tp) OVER w50 AS t50, list(tp) OVER w14 AS l14, list(tp) OVER w50 AS l50 FROM kk {windows(14, 50)}),
    m1 AS (SELECT *, {mean('fk', 3)} AS sk FROM m0 {windows(3)})"""
    cci = "CASE WHEN seq >= {m} THEN CASE WHEN list_sum([abs(x - t{n}) for x in l{n}]) = 0 THEN 0 ELSE (tp - t{n}) / (0.015 * list_sum([abs(x - t{n}) for x in l{n}]) / {n}) END END"
    columns = {
        **{f"rsi_{p}": f"CASE WHEN gain_{p} + loss_{p} = 0 THEN 0 ELSE 100 * gain_{p} / (gain_{p} + loss_{p}) END" for p in (7, 14, 21)},
        "rsi_divergence": "CASE WHEN count(close) OVER before5 = 5 AND close > max(close) OVER before5 AND count(rsi) OVER before5 = 5 AND rsi < max(rsi) OVER before5 THEN 1 ELSE 0 END",
        "stoch_k": "CASE WHEN count(sk) OVER w3 = 3 THEN sk END",
        "stoch_d": mean("sk", 3),
        "macd_line": "CASE WHEN signal IS NOT NULL THEN macd END",
        "macd_signal": "signal",
        "macd_histogram": "hist",
        "macd_hist_slope": "hist - lag(hist, 3) OVER o",
        **{f"roc_{n}": f"100 * (close / lag(close, {n}) OVER o - 1)" for n in (5, 10, 20)},
        "williams_r": "wr",
        "cci_14": cci.format(n=14, m=13),
        "cci_50": cci.format(n=50, m=49),
        "adx_14": "adx",
        "di_plus": "dip",
        "di_minus": "dim",
        "dx_cross": "(dip - dim) / nullif(dip + dim, 0)",
    }
    return query([SCANS, SECOND_SCANS, pre], columns, "m1", (3,), {"rsi_divergence"}, digits=digits)


def trend(digits: int = 6) -> str:
    middle = lambda n: f"CASE WHEN seq >= {n - 1} THEN (max(high) OVER w{n} + min(low) OVER w{n}) / 2 END"
    fit = lambda n: f"CASE WHEN seq >= {n - 1} THEN regr_intercept(close, seq) OVER w{n} + regr_slope(close, seq) OVER w{n} * seq END"
    pre = f"""t0 AS (SELECT *, {fit(20)} AS f20, {fit(50)} AS f50, {middle(9)} AS m9, {middle(26)} AS m26, {middle(52)} AS m52,
      (high + low) / 2 + 3 * atr10 AS up, (high + low) / 2 - 3 * atr10 AS down, abs(high - pl) AS vp, abs(low - ph) AS vm,
      CASE WHEN seq >= 25 THEN 100.0 * (25 - (seq - arg_max(seq, (high, seq)) OVER w26)) / 25 END AS au,
      CASE WHEN seq >= 25 THEN 100.0 * (25 - (seq - arg_max(seq, (-low, seq)) OVER w26)) / 25 END AS ad FROM k {windows(9, 20, 26, 50, 52)}),
    t1 AS (SELECT *, CASE WHEN close > lag(up) OVER o THEN 1.0 WHEN close < lag(down) OVER o THEN -1.0 END AS turn FROM t0 {windows()})"""
    vortex = lambda x: f"({full(f'sum({x})', x, 14)}) / nullif({full('sum(trange)', 'trange', 14)}, 0)"
    columns = {
        "linear_reg_slope_20": full("regr_slope(close, seq)", "close", 20),
        "linear_reg_slope_50": full("regr_slope(close, seq)", "close", 50),
        "linear_reg_r2_20": f"({full('corr(close, f20)', 'f20', 20)}) ** 2",
        "linear_reg_r2_50": f"({full('corr(close, f50)', 'f50', 50)}) ** 2",
        "supertrend": "last_value(turn IGNORE NULLS) OVER u",
        "ichimoku_tk_cross": "(m9 - m26) / nullif(atr14, 0)",
        "ichimoku_cloud_dist": "(close - ((m9 + m26) / 2 + m52) / 2) / nullif(atr14, 0)",
        "aroon_up": "au",
        "aroon_down": "ad",
        "aroon_oscillator": "au - ad",
        "vortex_plus": vortex("vp"),
        "vortex_minus": vortex("vm"),
    }
    return query([SCANS, pre], columns, "t1", (14, 20, 50), digits=digits)


def statistical(digits: int = 6) -> str:
    """Without the Dickey-Fuller test, which has a query of its own."""
    lags = range(2, 20)
    x = [math.log(k) for k in lags]
    mid = sum(x) / len(x)
    scale = sum((v - mid) ** 2 for v in x)
    d = ", ".join(f"r - lag(r, {k}) OVER o AS d{k}" for k in lags)
    pre = f"q0 AS (SELECT *, lag(r, 1) OVER o AS r1, lag(r, 5) OVER o AS r5, lag(r, 10) OVER o AS r10, {d}, list(r) OVER w30 AS l30, list(r) OVER w50 AS l50, list(r) OVER w60 AS l60 FROM b {windows(30, 50, 60)})"
    n30, n60 = "count(r) OVER w30 = 30", "count(r) OVER w60 = 60"
    skew = lambda n: f"(skewness(r) OVER w{n} * {(n - 2) / math.sqrt(n * (n - 1))!r})"
    kurt = lambda n: f"(kurtosis_pop(r) OVER w{n})"
    bins = "[least(floor(10 * (x - list_min(l30)) / (list_max(l30) - list_min(l30))), 9) for x in l30]"
    share = f"[len(list_filter({bins}, lambda y: y = b)) / 30.0 for b in range(10)]"
    hurst = " + ".join(f"ln(greatest(stddev_pop(d{k}) OVER w{100 - k}, 1e-10)) * {(v - mid) / scale!r}" for k, v in zip(lags, x))
    m50 = "list_avg(l50)"
    pairs = "[l60[2 * i + 1] + l60[2 * i + 2] for i in range(30)]"
    columns = {
        "rolling_skew_30": f"CASE WHEN {n30} THEN {skew(30)} END",
        "rolling_skew_60": f"CASE WHEN {n60} THEN {skew(60)} END",
        "rolling_kurtosis_30": f"CASE WHEN {n30} THEN {kurt(30)} END",
        "rolling_kurtosis_60": f"CASE WHEN {n60} THEN {kurt(60)} END",
        "entropy_30": f"CASE WHEN {n30} THEN -list_sum([CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END for p in {share}]) END",
        "hurst_100": f"CASE WHEN count(r) OVER w100 = 100 THEN {hurst} END",
        **{f"autocorr_{k}": f"CASE WHEN count(r) OVER w50 = 50 THEN corr(r, r{k}) OVER w{50 - k} END" for k in (1, 5, 10)},
        "partial_autocorr_1": f"CASE WHEN count(r) OVER w50 = 50 THEN 50.0 / 49 * list_sum([(l50[i] - {m50}) * (l50[i + 1] - {m50}) for i in range(1, 50)]) / list_sum([(y - {m50}) ** 2 for y in l50]) END",
        "variance_ratio": f"CASE WHEN {n60} THEN list_var_pop({pairs}) / (2 * list_var_pop(l60)) END",
        "jarque_bera": f"CASE WHEN {n60} THEN 10 * ({skew(60)} ** 2 + {kurt(60)} ** 2 / 4) END",
        "rolling_median_dev": f"CASE WHEN {n60} THEN mad(r) OVER w60 END",
        "quantile_range": f"CASE WHEN {n60} THEN quantile_cont(r, 0.75) OVER w60 - quantile_cont(r, 0.25) OVER w60 END",
    }
    return query([pre], columns, "q0", (30, 40, 45, 49, 50, 60, 100, *(100 - k for k in lags)), digits=digits)


def adf() -> str:
    """Dickey-Fuller tests of the last 100 returns: least squares by elimination in matrices of cross products.

    Orders are nested, so what is left for y after the first columns is the residual sum of each order; the chosen order is
    fitted again with the level as its last column. The normal distribution is a series.
    """
    inner = lambda c, size: f"[[list_inner_product({c}[i], {c}[j]) for j in range(1, {size} + 1)] for i in range(1, {size} + 1)]"
    lag = lambda k, first: f"[x[t - {k} + 1] - x[t - {k}] for t in range({first}, 100)]"
    level, y, ones = (lambda first: f"[x[t] - list_avg(x) for t in range({first}, 100)]"), (lambda first: f"[x[t + 1] - x[t] for t in range({first}, 100)]"), (lambda first: f"[1.0::DOUBLE for t in range({first}, 100)]")
    less = lambda size: f"[[a[i][j] - a[i][k] * a[k][j] / a[k][k] for j in range(1, {size} + 1)] for i in range(1, {size} + 1)]"
    polynomial = lambda *p: " + ".join(f"({v!r}) * tau ** {i}" for i, v in enumerate(p))
    term = "[exp(i * ln(2 * u * u) + ln(u) - list_sum([ln(2 * m + 1) for m in range(1, i + 1)])) for i in range(1, 121)]"
    erf = f"CASE WHEN u = 0 THEN 0 ELSE 2 / sqrt(pi()) * exp(-u * u) * (u + list_sum({term})) END"
    return f"""WITH RECURSIVE {BARS}, {BASE},
    w AS MATERIALIZED (SELECT series_id, seq, CASE WHEN count(r) OVER w100 = 100 THEN list(r) OVER w100 END AS x FROM b {windows(100)}),
    c AS (SELECT series_id, seq, [{ones(13)}, {level(13)}, {', '.join(lag(k, 13) for k in range(1, 13))}, {y(13)}] AS c FROM w WHERE x IS NOT NULL),
    e(series_id, seq, k, a) AS (SELECT series_id, seq, 1, {inner('c', 15)} FROM c UNION ALL SELECT series_id, seq, k + 1, {less(15)} FROM e WHERE k <= 14),
    m AS MATERIALIZED (SELECT series_id, seq, arg_min(k - 3, 87 * ln(a[15][15] / 87) + 2 * (k - 1)) AS m FROM e WHERE k >= 3 GROUP BY ALL),
    c2 AS (SELECT series_id, seq, m, list_concat([{ones('m + 1')}], list_concat([[x[t - k + 1] - x[t - k] for t in range(m + 1, 100)] for k in range(1, m + 1)], [{level('m + 1')}, {y('m + 1')}])) AS c FROM w JOIN m USING (series_id, seq)),
    e2(series_id, seq, m, k, a) AS (SELECT series_id, seq, m, 1, {inner('c', '(m + 3)')} FROM c2 UNION ALL SELECT series_id, seq, m, k + 1, {less('(m + 3)')} FROM e2 WHERE k <= m + 1),
    f AS (SELECT series_id, seq, a[m + 2][m + 3] / a[m + 2][m + 2] / sqrt((a[m + 3][m + 3] - a[m + 2][m + 3] ** 2 / a[m + 2][m + 2]) / (99 - m - (m + 2)) / a[m + 2][m + 2]) AS tau FROM e2 WHERE k = m + 2),
    z AS (SELECT *, (CASE WHEN tau <= -1.61 THEN {polynomial(2.1659, 1.4412, 0.038269)} ELSE {polynomial(1.7339, 0.93202, -0.12745, -0.010368)} END) / sqrt(2.0) AS v FROM f),
    p AS (SELECT series_id, seq, tau, v, least(abs(v), 6.0) AS u FROM z)
    SELECT w.series_id, w.seq, (round(CASE WHEN tau > 2.74 THEN 1 WHEN tau < -18.83 THEN 0 ELSE 0.5 * (1 + sign(v) * ({erf})) END, 6) + 0.0)::DOUBLE AS adf_pvalue_100
    FROM w LEFT JOIN p ON p.series_id = w.series_id AND p.seq = w.seq"""


def volume(bars: str = BARS, digits: int = 6) -> str:
    pre = f"""u0 AS (SELECT *, CASE WHEN tp > lag(tp) OVER o THEN tp * volume ELSE 0 END AS pos, CASE WHEN tp < lag(tp) OVER o THEN tp * volume ELSE 0 END AS neg,
      coalesce(sign(close - pc), 0) * volume AS ob, coalesce(((close - low) - (high - close)) / nullif(high - low, 0), 0) * volume AS ad, {mean('volume', 20)} AS v20,
      sum(tp * volume) OVER u / nullif(sum(volume) OVER u, 0) AS vwap, {mean('tr', 14)} AS tr14 FROM b {windows(14, 20)})"""
    columns = {
        "volume_sma_ratio": "volume / nullif(v20, 0)",
        "volume_zscore": f"(volume - ({mean('volume', 50)})) / nullif({sd('volume', 50)}, 0)",
        "volume_trend": "(v20 - lag(v20, 5) OVER o) / 5",
        "obv_slope": "CASE WHEN seq >= 20 THEN sum(ob) OVER w20 / 20 END",
        "mfi_14": "CASE WHEN seq >= 13 THEN CASE WHEN sum(neg) OVER w14 > 0 THEN 100 - 100 / (1 + sum(pos) OVER w14 / sum(neg) OVER w14) WHEN sum(pos) OVER w14 > 0 THEN 100 END END",
        "vwap_distance": "(close - vwap) / nullif(tr14, 0)",
        "volume_price_corr": full("corr(volume, abs(r))", "r", 20),
        "accumulation_dist": "CASE WHEN seq >= 20 THEN sum(ad) OVER w20 / 20 END",
    }
    return query([pre], columns, "u0", (14, 20, 50), bars=bars, digits=digits)


def session(digits: int = 6) -> str:
    h, m, d = "hour(ts)", "minute(ts)", "(isodow(ts) - 1)"
    now = f"({h} * 60 + {m})"
    columns = {
        "hour_sin": f"sin(2 * pi() * {h} / 24)",
        "hour_cos": f"cos(2 * pi() * {h} / 24)",
        "minute_sin": f"sin(2 * pi() * {m} / 60)",
        "minute_cos": f"cos(2 * pi() * {m} / 60)",
        "day_of_week_sin": f"sin(2 * pi() * {d} / 5)",
        "day_of_week_cos": f"cos(2 * pi() * {d} / 5)",
        "is_asian_session": f"CASE WHEN {h} < 8 THEN 1 ELSE 0 END",
        "is_london_session": f"CASE WHEN {h} BETWEEN 7 AND 15 THEN 1 ELSE 0 END",
        "is_newyork_session": f"CASE WHEN {h} BETWEEN 12 AND 20 THEN 1 ELSE 0 END",
        "is_overlap_ln": f"CASE WHEN {h} BETWEEN 12 AND 15 THEN 1 ELSE 0 END",
        "minutes_into_session": f"(CASE WHEN {h} < 8 THEN {now} WHEN {h} < 16 THEN {now} - 420 WHEN {h} < 21 THEN {now} - 720 END)::DOUBLE",
        "minutes_to_close": f"(CASE WHEN {h} < 8 THEN 480 - {now} WHEN {h} < 16 THEN 960 - {now} WHEN {h} < 21 THEN 1260 - {now} END)::DOUBLE",
    }
    return query([], columns, "b", (), {c for c in columns if c.startswith("is_")}, digits=digits)


def variants() -> str:
    skew, kurt = f"(skewness(r) OVER w60 * {58 / math.sqrt(60 * 59)!r})", "(kurtosis_pop(r) OVER w60)"
    columns = {
        "lower_wick_ratio_raw": "least(open, close) / nullif(high - low, 0)",
        "bar_return_2score": f"({mean('r', 20)}) / nullif({sd('r', 20)}, 0)",
        "consecutive_up_int": "seq - max(CASE WHEN close > pc THEN NULL ELSE seq END) OVER u",
        "consecutive_down_int": "seq - max(CASE WHEN close < pc THEN NULL ELSE seq END) OVER u",
        "vol_contraction_strict": "CASE WHEN atr14 < 0.5 * atr50 THEN 1 ELSE 0 END",
        "volume_sma_ratio_raw": f"volume / nullif({mean('volume', 20)}, 0)",
        "jarque_bera_60": f"CASE WHEN count(r) OVER w60 = 60 THEN 10 * ({skew} ** 2 + {kurt} ** 2 / 4) END",
    }
    return query([SCANS], columns, "k", (20, 60), {"consecutive_up_int", "consecutive_down_int", "vol_contraction_strict"})


def constant_bars() -> str:
    """What the definitions say where nothing varies: a fit explains nothing, a correlation and a shape are undefined."""
    none = {n: "NULL::DOUBLE" for n in ("autocorr_1", "autocorr_10", "volume_price_corr", "rolling_skew_30")}
    zero = {"linear_reg_r2_20": 38, "linear_reg_r2_50": 98, "entropy_30": 30, "rsi_14": 14}
    columns = none | {n: f"CASE WHEN seq >= {first} THEN 0.0::DOUBLE END" for n, first in zero.items()}
    return f"WITH {BARS} SELECT series_id, seq, {', '.join(f'{x} AS {n}' for n, x in columns.items())} FROM bars"


def vol_percentile(window: int) -> str:
    """Ties count half."""
    size = f"CASE WHEN count(atr14) OVER w{window} = {window} THEN list(atr14) OVER w{window} END"
    pre = f"vp AS (SELECT *, {size} AS held FROM k {windows(window)})"
    below, same = "len(list_filter(held, lambda x: x < atr14))", "len(list_filter(held, lambda x: x = atr14))"
    return query([SCANS, pre], {"vol_percentile": f"({below} + ({same} + 1) / 2.0) / {window}"}, "vp", ())


def all_features(left_out: tuple[str, ...]) -> str:
    """SELECT of the bars and of all features but those that are left out, as good as unrounded."""
    families = {f: globals()[f](digits=13) for f in ("price", "volatility", "momentum", "trend", "statistical", "volume", "session")}
    joined = " ".join(f"JOIN ({sql}) {f} USING (series_id, seq)" for f, sql in families.items())
    return f"SELECT * EXCLUDE ({', '.join(left_out)}) FROM (WITH {BARS} SELECT * EXCLUDE (volume), volume AS volume FROM bars) b {joined}"
