"""DuckDB SQL of the registered queries, put together from shared table expressions.

Sequential operators are recursive here, bar by bar, where the Spark side uses block scans, windows
or a streamed state machine; as-of joins are ASOF here and a carried struct there.
"""

from __future__ import annotations

from barloom.catalogue import FIB_BARS, FIB_RATIOS, MINUTES, PARENT, ratio_name
from barloom.plans.queries import FLAGS, HOLD, RATIOS, STOP, SWINGS, TAKE, THRESHOLDS

ORACLE: dict[str, str] = {}
TICKS = {
    "e": "SELECT event_type AS symbol, ts, value AS price, 1.0::DOUBLE AS volume, event_id AS seq FROM events",
    "o": "SELECT o_orderpriority AS symbol, o_orderdate AS ts, o_totalprice AS price, 1.0::DOUBLE AS volume, o_orderkey AS seq FROM orders",
}


def bucket(tf: str) -> str:
    if tf == "1W":
        return "(date_trunc('week', ts) + INTERVAL 7 DAY)::TIMESTAMP"
    return f"time_bucket(INTERVAL '{MINUTES[tf]} minutes', ts - INTERVAL 1 MICROSECOND) + INTERVAL '{MINUTES[tf]} minutes'"


def bars(source: str, *tfs: str, name: str = "b") -> str:
    """Table expressions t (ticks) and ``name`` (bars of the timeframes)."""
    one = " UNION ALL ".join(
        f"SELECT symbol, '{tf}' AS tf, {bucket(tf)} AS ts, first(price ORDER BY ts, seq) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts, seq) AS close, sum(volume) AS volume FROM t_{name} GROUP BY 1, 2, 3" for tf in tfs
    )
    return f"t_{name} AS ({TICKS[source]}), {name} AS MATERIALIZED ({one})"


W = "PARTITION BY symbol, tf ORDER BY ts"
NUMBERED = f"n AS MATERIALIZED (SELECT *, row_number() OVER ({W}) - 1 AS pos, count(*) OVER (PARTITION BY symbol, tf) AS cnt FROM b)"


def roll(agg: str, x: str, n: int, least: int | None = None) -> str:
    over = f"OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {over} >= {least or n} THEN {agg}({x}) {over} END"


def flag(condition: str) -> str:
    return f"coalesce(({condition})::INT, 0)"


def run(condition: str, source: str, name: str) -> str:
    """Table expressions that end in ``name``: ``source`` with run, the rows since ``condition`` became true."""
    return (
        f"{name}_a AS (SELECT *, {flag(condition)} AS cond FROM {source}), {name}_b AS (SELECT *, sum(CASE WHEN cond = p THEN 0 ELSE 1 END) OVER ({W}) AS grp FROM (SELECT *, lag(cond) OVER ({W}) AS p FROM {name}_a)), "
        f"{name} AS (SELECT * EXCLUDE (cond, grp, p), row_number() OVER (PARTITION BY symbol, tf, grp ORDER BY ts) * cond AS run FROM {name}_b)"
    )


def alpha(span: int) -> str:
    return f"(2.0::DOUBLE / {span + 1})"


#: One recursion for all exponential means of the close, and the MACD signal line.
EWM = (
    "e(symbol, tf, pos, e8, e21, e12, e26, sig) AS (SELECT symbol, tf, pos, close, close, close, close, 0.0::DOUBLE FROM n WHERE pos = 0 UNION ALL "
    + "SELECT symbol, tf, pos, e8, e21, e12, e26, {s} * (e12 - e26) + (1 - {s}) * sig FROM (SELECT n.symbol, n.tf, n.pos, e.sig, ".format(s=alpha(9))
    + ", ".join(f"{alpha(k)} * n.close + (1 - {alpha(k)}) * e.e{k} AS e{k}" for k in (8, 21, 12, 26))
    + " FROM e JOIN n ON n.symbol = e.symbol AND n.tf = e.tf AND n.pos = e.pos + 1))"
)
DAILY = f"WITH RECURSIVE {bars('o', '1D')}, {NUMBERED}, {EWM}"
MACD = f"{DAILY}, m AS (SELECT n.*, e12 - e26 AS line, sig, (e12 - e26) - sig AS hist FROM n JOIN e USING (symbol, tf, pos)), d AS MATERIALIZED (SELECT *, hist - lag(hist) OVER ({W}) AS delta FROM m)"
MAS = f"{DAILY}, a AS MATERIALIZED (SELECT n.*, e8 AS ema8, e21 AS ema21, {roll('avg', 'close', 50)} AS sma50, {roll('avg', 'close', 200)} AS sma200 FROM n JOIN e USING (symbol, tf, pos))"
MA_NAMES = ("ema8", "ema21", "sma50", "sma200")
HOURLY = f"WITH RECURSIVE {bars('e', '1H')}, {NUMBERED}"

ORACLE["resample_right"] = f"WITH {bars('e', '15M')} SELECT * FROM b"
ORACLE["resample_week"] = f"WITH {bars('o', '1W')} SELECT * FROM b"
ORACLE["ohlcv_multi_tf"] = f"WITH {bars('e', '5M', '30M', '1H', '4H', '1D')} SELECT * FROM b"
ORACLE["upsert_dedup"] = """
    SELECT o_orderpriority AS symbol, o_orderdate AS ts, o_totalprice AS price, o_orderkey AS seq FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_orderpriority, o_orderdate ORDER BY o_orderstatus = 'F', o_orderkey DESC) = 1"""
ORACLE["latest_row"] = f"WITH {bars('e', '1H')} SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1"
ORACLE["time_range_filter"] = f"WITH t AS ({TICKS['o']}) SELECT symbol, ts, price, seq FROM t WHERE ts >= TIMESTAMP '1996-02-01' AND ts < TIMESTAMP '1996-03-01'"
ORACLE["rolling_mean"] = f"WITH {bars('e', '4H')}, s AS (SELECT *, {roll('avg', 'close', 50)} AS sma50 FROM b) SELECT symbol, ts, round(sma50, 4) AS sma50, {flag('close > sma50')} AS above FROM s"
ORACLE["rolling_minmax"] = f"WITH {bars('e', '1H')} SELECT symbol, ts, {roll('min', 'low', 14)} AS low14, {roll('max', 'high', 14)} AS high14, {roll('max', 'high', 50, 5)} AS high50 FROM b"
ORACLE["rolling_std"] = f"WITH {bars('o', '1D')} SELECT symbol, ts, round({roll('stddev_samp', 'close', 200, 50)}, 2) AS std200 FROM b"
ORACLE["lag_diff"] = f"WITH {bars('e', '1H')} SELECT symbol, ts, lag(close) OVER ({W}) AS lag1, lag(close, 2) OVER ({W}) AS lag2, round(close - lag(close) OVER ({W}), 4) AS diff FROM b"
ORACLE["run_length"] = f"WITH {bars('e', '1H')}, {run('close > open', 'b', 'r')} SELECT symbol, ts, run FROM r"
ORACLE["series_position"] = f"WITH {bars('e', '15M')}, {NUMBERED} SELECT symbol, ts, pos FROM n"
ORACLE["ewm_mean"] = f"{DAILY} SELECT n.symbol, n.ts, round(e8, 2) AS ema8, round(e26, 2) AS ema26 FROM n JOIN e USING (symbol, tf, pos)"
ORACLE["macd"] = f"{MACD} SELECT symbol, ts, round(line, 2) AS macd_line, round(sig, 2) AS macd_signal_line, round(hist, 2) AS macd_hist, round(delta, 2) AS macd_hist_delta, round(hist, 2) AS macd_line_dist FROM d"
ORACLE["macd_events"] = f"""{MACD}, {run('delta > 0', 'd', 'r1')}, r1x AS (SELECT * RENAME (run AS rising) FROM r1), {run('delta < 0', 'r1x', 'r2')},
    f AS (SELECT *, {flag('line > sig')} AS over_sig FROM r2), g AS (SELECT *, coalesce(lag(over_sig) OVER ({W}), 0) AS over_before, lag(delta) OVER ({W}) AS before FROM f)
    SELECT symbol, ts, {flag('hist > 0')} AS macd_above_zero, {flag('line > 0')} AS macd_line_above_zero, over_sig AS macd_above_sig,
           {flag('delta > 0 AND before <= 0')} AS macd_e1_bull, {flag('delta < 0 AND before >= 0')} AS macd_e1_bear,
           {flag('over_sig = 1 AND over_before = 0')} AS macd_e2_bull, {flag('over_sig = 0 AND over_before = 1')} AS macd_e2_bear,
           rising::INT AS macd_hist_bars_rising, run::INT AS macd_hist_bars_falling FROM g"""
STOCH = f"""WITH {bars('e', '1H')}, s1 AS (SELECT *, {roll('min', 'low', 14)} AS lo, {roll('max', 'high', 14)} AS hi FROM b), s2 AS (SELECT *, 100 * (close - lo) / nullif(hi - lo, 0) AS raw FROM s1),
    s3 AS (SELECT *, {roll('avg', 'raw', 3)} AS k FROM s2), s4 AS (SELECT *, {roll('avg', 'k', 3)} AS d FROM s3),
    s5 AS (SELECT *, lag(k) OVER ({W}) AS k1, lag(k, 2) OVER ({W}) AS k2, {flag('k > d')} AS over FROM s4), s6 AS (SELECT *, coalesce(lag(over) OVER ({W}), 0) AS over1 FROM s5)"""
ORACLE["stochastic"] = f"{STOCH} SELECT symbol, ts, round(k, 4) AS \"stoch_K\", round(d, 4) AS \"stoch_D\", round(k - k1, 4) AS \"stoch_K_delta\", round(k - d, 4) AS \"stoch_KD_dist\" FROM s6"
_LOW3, _HIGH3 = "(coalesce(k < 20, false) OR coalesce(k1 < 20, false) OR coalesce(k2 < 20, false))", "(coalesce(k > 80, false) OR coalesce(k1 > 80, false) OR coalesce(k2 > 80, false))"
ORACLE["stoch_signals"] = f"""{STOCH}, {run('k > 80 OR k < 20', 's6', 'r')}
    SELECT symbol, ts, over AS "stoch_KD_above", {flag('k > 80')} AS stoch_ob, {flag('k < 20')} AS stoch_os, {flag('over = 1 AND over1 = 0 AND ' + _LOW3)} AS "stoch_A_bull", {flag('over = 0 AND over1 = 1 AND ' + _HIGH3)} AS "stoch_A_bear",
           {flag('over = 1 AND over1 = 0 AND k BETWEEN 30 AND 70')} AS "stoch_B_bull", {flag('over = 0 AND over1 = 1 AND k BETWEEN 30 AND 70')} AS "stoch_B_bear", run::INT AS stoch_bars_extreme FROM r"""


def _ma(m: str) -> str:
    return (
        f"{flag(f'close > {m}')} AS above_{m}, {flag(f'abs((close - {m}) / {m} * 100) < 0.3')} AS near_{m}, {flag(f'low <= {m} AND close > {m}')} AS reject_bull_{m}, {flag(f'high >= {m} AND close < {m}')} AS reject_bear_{m}, "
        f"round((close - {m}) / {m} * 100, 4) AS dist_{m}_pct"
    )


ORACLE["ma_family"] = (
    f"{MAS} SELECT symbol, ts, {', '.join(_ma(m) for m in MA_NAMES)}, {flag('close > ema8 AND ema8 > ema21 AND ema21 > sma50 AND sma50 > sma200')} AS align_full_bull, "
    f"{flag('close < ema8 AND ema8 < ema21 AND ema21 < sma50 AND sma50 < sma200')} AS align_full_bear FROM a"
)
_CROSS = ", ".join(
    f"{flag(f'a_{m} = 1 AND coalesce(p_{m}, 0) = 0')} AS cross_bull_{m}, {flag(f'a_{m} = 0 AND coalesce(p_{m}, 0) = 1')} AS cross_bear_{m}, (row_number() OVER (PARTITION BY symbol, tf, g_{m} ORDER BY ts))::INT AS bars_side_{m}" for m in ("ema21", "sma50")
)
ORACLE["ma_cross"] = f"""{MAS}, x AS (SELECT *, {', '.join(f'{flag(f"close > {m}")} AS a_{m}' for m in ('ema21', 'sma50'))} FROM a), y AS (SELECT *, {', '.join(f'lag(a_{m}) OVER ({W}) AS p_{m}' for m in ('ema21', 'sma50'))} FROM x),
    z AS (SELECT *, {', '.join(f'sum(CASE WHEN a_{m} = p_{m} THEN 0 ELSE 1 END) OVER ({W}) AS g_{m}' for m in ('ema21', 'sma50'))} FROM y) SELECT symbol, ts, {_CROSS} FROM z"""
ORACLE["ma_extreme"] = f"""{MAS}, x AS (SELECT *, (close - sma50) / sma50 * 100 AS d_sma50, (close - sma200) / sma200 * 100 AS d_sma200 FROM a),
    y AS (SELECT *, {', '.join(f"{roll('stddev_samp', f'd_{m}', 200, 50)} AS s_{m}" for m in ('sma50', 'sma200'))} FROM x)
    SELECT symbol, ts, {', '.join(f"{flag(f'd_{m} > 2 * s_{m}')} AS extreme_bull_{m}, {flag(f'd_{m} < -2 * s_{m}')} AS extreme_bear_{m}" for m in ('sma50', 'sma200'))} FROM y"""


def _range(tf: str, n: int) -> str:
    return f"SELECT *, {roll('min', 'low', n, 5)} AS lo, {roll('max', 'high', n, 5)} AS hi FROM {{}} WHERE tf = '{tf}'"


def _levels(source: str, *tfs: str) -> str:
    parts = " UNION ALL ".join(_range(tf, FIB_BARS[tf]).format(source) for tf in tfs)
    return f"r AS ({parts}), l AS (SELECT *, {', '.join(f'CASE WHEN hi <> lo THEN lo + (hi - lo) * {r} END AS l{ratio_name(r)}' for r in FIB_RATIOS)} FROM r)"


ORACLE["fib_levels"] = (
    f"WITH {bars('e', '1H', '1D')}, {_levels('b', '1H', '1D')} SELECT symbol, tf, ts, "
    + ", ".join(f"round(l{r}, 4) AS fib{r}_level, round((close - l{r}) / nullif(l{r}, 0) * 100, 4) AS fib{r}_dist_pct" for r in RATIOS)
    + ", "
    + ", ".join(
        f"{flag(f'abs((close - l{r}) / nullif(l{r}, 0) * 100) < 0.3')} AS fib{r}_in_zone, {flag(f'low <= l{r} * 1.003 AND close > l{r}')} AS fib{r}_reject_bull, {flag(f'high >= l{r} * 0.997 AND close < l{r}')} AS fib{r}_reject_bear, {flag(f'close > l{r}')} AS fib{r}_above"
        for r in RATIOS
    )
    + " FROM l"
)
ORACLE["fib_confluence"] = (
    f"{MAS}, {_levels('a', '1D')} SELECT symbol, ts, "
    + ", ".join(f"{flag(f'abs((close - l{r}) / l{r} * 100) < 0.3 AND abs({m} - l{r}) / l{r} * 100 < 0.3')} AS fib{r}_conf_{m}" for r in ("0382", "05", "0618") for m in ("ema8", "sma50"))
    + " FROM l"
)
_TFS = ("15M", "1H", "4H", "1D")
ORACLE["asof_state"] = (
    f"WITH {bars('e', *_TFS)} SELECT t_b.seq, "
    + ", ".join(f"s{tf}.close AS \"close_{tf}\", {flag(f's{tf}.close > s{tf}.open').replace(', 0)', ', CASE WHEN s' + tf + '.ts IS NOT NULL THEN 0 END)')} AS \"up_{tf}\"" for tf in _TFS)
    + " FROM t_b "
    + " ".join(f"ASOF LEFT JOIN (SELECT * FROM b WHERE tf = '{tf}') s{tf} ON t_b.symbol = s{tf}.symbol AND t_b.ts >= s{tf}.ts" for tf in _TFS)
)
ORACLE["asof_bars"] = f"WITH {bars('e', '15M')} SELECT t_b.seq, b.close FROM t_b ASOF LEFT JOIN b ON t_b.symbol = b.symbol AND t_b.ts >= b.ts"
ORACLE["asof_chunked"] = f"WITH {bars('e', '4H')} SELECT t_b.seq, b.ts AS bar_ts, b.close FROM t_b ASOF LEFT JOIN b ON t_b.symbol = b.symbol AND t_b.ts > b.ts"

LEGS = f"""g0 AS (SELECT *, CASE WHEN close > open THEN 'LONG' ELSE 'SHORT' END AS direccion FROM b), g1 AS (SELECT *, lag(direccion) OVER ({W}) AS before FROM g0),
    g2 AS (SELECT *, sum(coalesce((direccion <> before)::INT, 0)) OVER ({W}) AS g FROM g1),
    g3 AS (SELECT symbol, tf, direccion, g, min(ts) AS timestamp_inicio, max(ts) AS timestamp_fin, arg_min(open, ts) AS precio_inicio, arg_max(close, ts) AS precio_fin,
           CASE WHEN direccion = 'LONG' THEN max(high) ELSE min(low) END AS precio_extremo, count(*)::INT AS duracion_barras FROM g2 GROUP BY 1, 2, 3, 4),
    legs AS MATERIALIZED (SELECT *, symbol || '_' || tf || '_' || g::VARCHAR AS mov_id, (CASE WHEN direccion = 'LONG' THEN precio_extremo - precio_inicio ELSE precio_inicio - precio_extremo END) / precio_inicio * 100 AS magnitud_pct,
           duracion_barras * CASE tf WHEN '1D' THEN 1440 WHEN '4H' THEN 240 ELSE 60 END AS duracion_min FROM g3)"""
_PTF = "CASE tf " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in PARENT.items()) + " END"
LINK = """linked AS MATERIALIZED (SELECT lp.*, CASE WHEN p.timestamp_fin >= lp.timestamp_inicio THEN p.mov_id END AS tf_parent_id FROM lp ASOF LEFT JOIN legs p ON lp.symbol = p.symbol AND lp.ptf = p.tf AND lp.timestamp_inicio >= p.timestamp_inicio)"""
LINKED = f"{LEGS}, lp AS (SELECT *, {_PTF} AS ptf FROM legs), {LINK}"
LINKED_BARS = f"WITH RECURSIVE {bars('e', '1H', '4H', '1D')}, {LINKED}"
ORACLE["asof_parent"] = f"{LINKED_BARS} SELECT mov_id, tf, tf_parent_id FROM linked"
ORACLE["asof_snapshot"] = f"""WITH {bars('e', '4H', '1D')}, {LEGS}, {bars('e', '15M', name='q')}
    SELECT mov_id, s.close AS close_start, f.ts AS ts_end, f.close AS close_end FROM legs ASOF LEFT JOIN q s ON legs.symbol = s.symbol AND legs.timestamp_inicio >= s.ts ASOF LEFT JOIN q f ON legs.symbol = f.symbol AND legs.timestamp_fin >= f.ts"""


def nearest(x: str) -> str:
    cut = f"least(greatest({x}, 0.0), 1.0)"
    return f"CASE WHEN ({x}) IS NOT NULL THEN list_min([{', '.join(f'{{d: abs({cut} - {r}::DOUBLE), r: {r}::DOUBLE}}' for r in FIB_RATIOS)}]).r END"


REBOUND = f"""reb AS (SELECT l.mov_id, {nearest('(l.precio_fin - least(p.precio_inicio, p.precio_extremo)) / nullif(abs(p.precio_extremo - p.precio_inicio), 0)')} AS rebote_fib
    FROM legs l ASOF LEFT JOIN (SELECT * FROM legs WHERE timestamp_inicio < timestamp_fin) p ON l.symbol = p.symbol AND l.tf = p.tf AND l.timestamp_inicio >= p.timestamp_fin)"""
ORACLE["asof_prev_swing"] = f"{LINKED_BARS}, {REBOUND} SELECT * FROM reb"


def excursion(points: str) -> str:
    long = "direccion = 'LONG'"
    up, down = "(hi - nullif(precio_inicio, 0)) / nullif(precio_inicio, 0) * 100", "(nullif(precio_inicio, 0) - lo) / nullif(precio_inicio, 0) * 100"
    floor = lambda x: f"CASE WHEN ({x}) IS NOT NULL THEN greatest({x}, 0.0) END"
    back = f"(CASE WHEN {long} THEN precio_extremo - lo ELSE hi - precio_extremo END) / nullif(abs(precio_extremo - precio_inicio), 0)"
    return f"""x0 AS (SELECT l.mov_id, max(q.high) AS hi, min(q.low) AS lo FROM legs l JOIN {points} q ON l.symbol = q.symbol AND q.ts BETWEEN l.timestamp_inicio AND l.timestamp_fin GROUP BY 1),
    exc AS MATERIALIZED (SELECT mov_id, {floor(f'CASE WHEN {long} THEN {up} ELSE {down} END')} AS mfe_pct, {floor(f'CASE WHEN {long} THEN {down} ELSE {up} END')} AS mae_pct, {nearest(back)} AS fib_agotamiento FROM legs LEFT JOIN x0 USING (mov_id))"""


ORACLE["range_join_mfe_mae"] = f"WITH {bars('e', '4H', '1D')}, {LEGS}, {bars('e', '15M', name='q')}, {excursion('q')} SELECT mov_id, round_even(mfe_pct, 4) AS mfe_pct, round_even(mae_pct, 4) AS mae_pct, fib_agotamiento FROM exc"
ALIGNED = """ali AS (SELECT m.mov_id, coalesce(p.direccion = m.direccion AND (g.direccion IS NULL OR g.direccion = m.direccion), false) AS alineamiento_3tf
    FROM linked m LEFT JOIN linked p ON m.tf_parent_id = p.mov_id LEFT JOIN linked g ON p.tf_parent_id = g.mov_id)"""
ORACLE["two_hop_align"] = f"{LINKED_BARS}, {ALIGNED} SELECT * FROM ali"
ORACLE["nearest_level"] = f"WITH {bars('e', '1H')} SELECT symbol, ts, {nearest('(close - low) / nullif(high - low, 0)')} AS level FROM b"


def by_tf(values: dict[str, object], make) -> str:
    return "CASE tf " + " ".join(f"WHEN '{tf}' THEN {make(v)}" for tf, v in values.items()) + " END"


def structure(sizes: dict[str, int]) -> str:
    """From n to st: swings by a recursion over candidates, then carried pairs and events."""
    ahead = lambda agg, x: by_tf(sizes, lambda k: f"{agg}({x}) OVER ({W} ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING)")
    carried = f"OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    earlier = f"OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""c0 AS MATERIALIZED (SELECT *, {by_tf(sizes, str)} AS k FROM n),
    c1 AS MATERIALIZED (SELECT *, pos <= cnt - 1 - k AND high = {ahead('max', 'high')} AS is_high, pos <= cnt - 1 - k AND low = {ahead('min', 'low')} AS is_low FROM c0),
    c2 AS MATERIALIZED (SELECT symbol, tf, 'SH' AS kind, pos, k, row_number() OVER ({W}) AS i FROM c1 WHERE is_high UNION ALL SELECT symbol, tf, 'SL', pos, k, row_number() OVER ({W}) FROM c1 WHERE is_low),
    h(symbol, tf, kind, i, pos, free, chosen) AS (SELECT symbol, tf, kind, i, pos, pos + k, true FROM c2 WHERE i = 1 UNION ALL
        SELECT c2.symbol, c2.tf, c2.kind, c2.i, c2.pos, CASE WHEN c2.pos >= h.free THEN c2.pos + c2.k ELSE h.free END, c2.pos >= h.free FROM h JOIN c2 ON c2.symbol = h.symbol AND c2.tf = h.tf AND c2.kind = h.kind AND c2.i = h.i + 1),
    c3 AS (SELECT symbol, tf, pos, max(kind) AS kind FROM h WHERE chosen GROUP BY 1, 2, 3),
    sw AS MATERIALIZED (SELECT c1.*, coalesce(kind, 'NONE') AS swing_type, CASE kind WHEN 'SH' THEN high WHEN 'SL' THEN low END AS swing_price,
        CASE WHEN kind IS NOT NULL THEN {by_tf(sizes, lambda k: f'lead(ts, {k - 1}) OVER ({W})')} END AS confirmed_ts FROM c1 LEFT JOIN c3 USING (symbol, tf, pos)),
    q0 AS (SELECT *, CASE swing_type WHEN 'SH' THEN swing_price END AS h1, CASE swing_type WHEN 'SL' THEN swing_price END AS l1 FROM sw),
    q1 AS (SELECT *, last_value(h1 IGNORE NULLS) {earlier} AS h0, last_value(l1 IGNORE NULLS) {earlier} AS l0 FROM q0),
    q2 AS (SELECT *, CASE WHEN h1 IS NOT NULL THEN {{a: h1, b: h0}} END AS hp, CASE WHEN l1 IS NOT NULL THEN {{a: l1, b: l0}} END AS lp FROM q1),
    q3 AS (SELECT * EXCLUDE (hp, lp), last_value(hp IGNORE NULLS) {carried} AS hp, last_value(lp IGNORE NULLS) {carried} AS lp FROM q2),
    q4 AS (SELECT *, CASE WHEN hp.a > hp.b AND lp.a > lp.b THEN 'ALCISTA' WHEN hp.a < hp.b AND lp.a < lp.b THEN 'BAJISTA' ELSE 'RANGO' END AS estructura FROM q3),
    st AS MATERIALIZED (SELECT *, CASE WHEN estructura = 'ALCISTA' AND close > hp.b THEN 'BOS_BULL' WHEN estructura = 'BAJISTA' AND close < lp.b THEN 'BOS_BEAR' ELSE 'NONE' END AS bos_event,
        CASE WHEN estructura = 'ALCISTA' AND close < lp.a THEN 'CHOCH_BAJISTA' WHEN estructura = 'BAJISTA' AND close > hp.a THEN 'CHOCH_ALCISTA' ELSE 'NONE' END AS choch_event FROM q4)"""


STRUCT = f"WITH RECURSIVE {bars('e', '1H', '4H', '1D')}, {NUMBERED}, {structure(SWINGS)}"
ORACLE["swing_candidates"] = f"{STRUCT} SELECT symbol, tf, ts, is_high, is_low FROM c1"
ORACLE["swings"] = f"{STRUCT} SELECT symbol, tf, ts, swing_type, swing_price, confirmed_ts FROM sw"
ORACLE["structure_class"] = f"{STRUCT} SELECT symbol, tf, ts, estructura FROM st"
ORACLE["bos_choch"] = f"{STRUCT} SELECT symbol, tf, ts, bos_event, choch_event FROM st"
ORACLE["structure_summary"] = f"""{STRUCT} SELECT symbol, tf, count(*) FILTER (swing_type = 'SH') AS n_sh, count(*) FILTER (swing_type = 'SL') AS n_sl,
    count(*) FILTER (bos_event <> 'NONE') AS n_bos, count(*) FILTER (choch_event <> 'NONE') AS n_choch FROM st GROUP BY 1, 2"""
ORACLE["value_counts_norm"] = f"WITH RECURSIVE {bars('e', '1H')}, {NUMBERED}, {structure({'1H': SWINGS['1H']})} SELECT estructura, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM st GROUP BY 1"


def machine(thresholds: dict[str, float]) -> str:
    """From st to mov: the state machine as a recursion over bars."""
    return f"""z AS MATERIALIZED (SELECT *, coalesce(lead(open) OVER ({W}), close) AS nxt, {by_tf(thresholds, str)} AS thr,
        CASE bos_event WHEN 'BOS_BULL' THEN 'LONG' WHEN 'BOS_BEAR' THEN 'SHORT' END AS bd, CASE choch_event WHEN 'CHOCH_ALCISTA' THEN 'LONG' WHEN 'CHOCH_BAJISTA' THEN 'SHORT' END AS cd FROM st),
    f(symbol, tf, pos, ts, close, dir, beg, price, ext, bars, num, ekind, edir, ebeg, eprice, eext, ebars, enum) AS (
        SELECT symbol, tf, pos, ts, close, coalesce(cd, bd), ts, nxt, CASE coalesce(cd, bd) WHEN 'LONG' THEN high WHEN 'SHORT' THEN low END, 1, CASE WHEN coalesce(cd, bd) IS NULL THEN 0 ELSE 1 END,
            NULL::VARCHAR, NULL::VARCHAR, NULL::TIMESTAMP, NULL::DOUBLE, NULL::DOUBLE, NULL::INT, NULL::INT FROM z WHERE pos = 0
        UNION ALL
        SELECT symbol, tf, pos, ts, close, coalesce(opens, d3), CASE WHEN opens IS NULL THEN beg ELSE ts END, CASE WHEN opens IS NULL THEN price ELSE nxt END,
            CASE opens WHEN 'LONG' THEN high WHEN 'SHORT' THEN low ELSE e1 END, CASE WHEN opens IS NULL THEN b1 ELSE 1 END, num + CASE WHEN opens IS NULL THEN 0 ELSE 1 END,
            CASE WHEN exh THEN 'AGOTAMIENTO' WHEN ob AND b1 >= 3 THEN 'BOS_CONTRARIO' WHEN oc AND b1 >= 3 THEN 'CHOCH' END, d0, beg, price, CASE WHEN exh THEN e0 ELSE e1 END, b1, num
        FROM (SELECT *, CASE WHEN exh THEN NULL WHEN cd IS NOT NULL AND d3 IS NULL THEN cd WHEN cd IS NULL AND d3 IS NULL THEN bd END AS opens
        FROM (SELECT *, CASE WHEN oc THEN NULL ELSE d2 END AS d3
        FROM (SELECT *, NOT exh AND coalesce(cd <> d2, false) AS oc
        FROM (SELECT *, CASE WHEN exh OR ob THEN NULL ELSE d0 END AS d2
        FROM (SELECT *, NOT exh AND coalesce(bd <> d0, false) AS ob
        FROM (SELECT *, coalesce(d0 IS NOT NULL AND e0 > 0 AND b1 >= 3 AND (CASE d0 WHEN 'LONG' THEN e0 - close ELSE close - e0 END) / nullif(e0, 0) * 100 >= thr, false) AS exh
        FROM (SELECT z.*, f.dir AS d0, f.beg, f.price, f.ext AS e0, f.bars + 1 AS b1, f.num, CASE f.dir WHEN 'LONG' THEN greatest(f.ext, z.high) WHEN 'SHORT' THEN least(f.ext, z.low) END AS e1
              FROM f JOIN z ON z.symbol = f.symbol AND z.tf = f.tf AND z.pos = f.pos + 1))))))) s),
    m0 AS (SELECT symbol, tf, enum AS num, edir AS direccion, ebeg AS timestamp_inicio, ts AS timestamp_fin, eprice AS precio_inicio, close AS precio_fin, eext AS precio_extremo, ebars AS duracion_barras, ekind AS cierre_tipo FROM f WHERE ekind IS NOT NULL
        UNION ALL SELECT symbol, tf, num, dir, beg, ts, price, close, ext, bars, 'FIN_DATOS' FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY symbol, tf ORDER BY pos DESC) = 1) WHERE dir IS NOT NULL AND bars >= 3),
    mov AS MATERIALIZED (SELECT *, tf || '_' || num::VARCHAR AS mov_id, CASE WHEN precio_inicio <> 0 THEN (CASE direccion WHEN 'LONG' THEN 1 ELSE -1 END) * (precio_extremo - precio_inicio) / precio_inicio * 100 ELSE 0 END AS magnitud_pct FROM m0)"""


ORACLE["movement_machine"] = (
    f"{STRUCT}, {machine(THRESHOLDS)} SELECT symbol, tf, mov_id, direccion, timestamp_inicio, timestamp_fin, precio_inicio, precio_fin, precio_extremo, round(round(magnitud_pct, 4), 2) AS magnitud_pct, duracion_barras, "
    f"(duracion_barras * {by_tf(MINUTES, str)})::INT AS duracion_min, cierre_tipo FROM mov"
)
ORACLE["continuation"] = (
    f"WITH RECURSIVE {bars('o', '1D')}, {NUMBERED}, {structure({'1D': 3})}, {machine({'1D': 60.0})}, w AS (SELECT *, lead(direccion) OVER (PARTITION BY symbol, tf ORDER BY timestamp_inicio, mov_id) AS nd FROM mov) "
    "SELECT symbol, mov_id, CASE WHEN nd IS NULL THEN 'ULTIMO' WHEN nd = direccion THEN 'CONTINUACION' ELSE 'REVERSION' END AS continuacion FROM w"
)

_1H = "(SELECT * FROM b WHERE tf = '1H')"
FLAGGED = f"""fl AS MATERIALIZED (SELECT *, {flag('close > open')} AS above_open, {flag(f'close > lag(close) OVER ({W})')} AS above_prev, {flag('high > 3 * low')} AS long_range, {flag('close > (high + low) / 2')} AS upper_half FROM b)"""
OUTCOMES = f"""{LINKED_BARS}, {excursion(_1H)}, {REBOUND}, {ALIGNED}, {FLAGGED},
    o0 AS MATERIALIZED (SELECT linked.*, round_even(mfe_pct, 4) AS mfe_pct, round_even(mae_pct, 4) AS mae_pct, fib_agotamiento, rebote_fib, alineamiento_3tf, lead(duracion_barras) OVER (PARTITION BY symbol, tf ORDER BY timestamp_inicio, mov_id) AS nb
        FROM linked JOIN exc USING (mov_id) JOIN reb USING (mov_id) JOIN ali USING (mov_id))"""
ORACLE["outcomes_by_tf_dir"] = f"{OUTCOMES} SELECT tf, direccion, count(*) AS n, round(avg(magnitud_pct), 7) AS magnitud_media, round(avg(mfe_pct), 7) AS mfe_media, round(avg(mae_pct), 7) AS mae_media FROM o0 GROUP BY 1, 2"
ORACLE["outcome_mismatches"] = f"{OUTCOMES} SELECT mov_id, -1.0::DOUBLE AS fib_agotamiento FROM o0 WHERE duracion_barras % 3 = 0"
ORACLE["outcome_rows"] = f"{OUTCOMES} SELECT mov_id, mfe_pct, mae_pct, fib_agotamiento, rebote_fib, alineamiento_3tf, round(CASE WHEN mae_pct > 0 THEN mfe_pct / mae_pct END, 4) AS ratio_mfe_mae FROM o0"
STATED = f"""{OUTCOMES}, o1 AS MATERIALIZED (SELECT o0.*, CASE WHEN nb IS NULL THEN 'ULTIMO' WHEN nb >= duracion_barras THEN 'CONTINUACION' ELSE 'REVERSION' END AS continuacion, s.above_open, s.above_prev, s.long_range, s.upper_half
        FROM o0 ASOF LEFT JOIN (SELECT * FROM fl WHERE tf = '1H') s ON o0.symbol = s.symbol AND o0.timestamp_inicio > s.ts),
    judged AS MATERIALIZED (SELECT * FROM o1 WHERE continuacion <> 'ULTIMO'), cut AS (SELECT quantile_cont(epoch_us(timestamp_inicio)::DOUBLE, 0.75) AS c FROM judged),
    facts AS MATERIALIZED ({' UNION ALL '.join(f"SELECT judged.*, '{f}' AS variable, '1' AS value FROM judged WHERE {f} = 1" for f in FLAGS)}),
    timed AS MATERIALIZED (SELECT facts.*, (continuacion = 'CONTINUACION')::INT::DOUBLE AS win, epoch_us(timestamp_inicio) <= c AS early FROM facts, cut),
    sets AS MATERIALIZED (SELECT variable, value, tf, direccion, count(*) AS n, avg(win) AS winrate, avg(magnitud_pct) AS mag_media, stddev_samp(magnitud_pct) AS mag_std, avg(duracion_min) AS dur_media, avg(mfe_pct) AS mfe_media, avg(mae_pct) AS mae_media,
            count(*) FILTER (early) AS n_train, avg(win) FILTER (early) AS wr_train, avg(win) FILTER (NOT early) AS wr_valid,
            avg(magnitud_pct) FILTER (early) AS mag_media_train, avg(duracion_min) FILTER (early) AS dur_media_train, avg(mfe_pct) FILTER (early) AS mfe_media_train, avg(mae_pct) FILTER (early) AS mae_media_train
        FROM timed GROUP BY GROUPING SETS ((variable, value, direccion), (variable, value, tf, direccion))),
    mined AS MATERIALIZED (SELECT *, CASE tf WHEN '1D' THEN 5 WHEN '4H' THEN 5 WHEN '1H' THEN 10 ELSE 10 END AS least FROM sets WHERE n >= CASE tf WHEN '1D' THEN 5 WHEN '4H' THEN 5 WHEN '1H' THEN 10 ELSE 10 END)"""


def mode(x: str, name: str) -> str:
    """The lowest most frequent value of each pattern."""
    return f"""{name} AS (SELECT variable, value, tf, direccion, {x} FROM (SELECT variable, value, tf, direccion, {x}, count(*) AS k FROM timed WHERE {x} IS NOT NULL GROUP BY GROUPING SETS ((variable, value, direccion, {x}), (variable, value, tf, direccion, {x})))
        QUALIFY row_number() OVER (PARTITION BY variable, value, tf, direccion ORDER BY k DESC, {x}) = 1)"""


_SAME = "ON m.variable = {0}.variable AND m.direccion = {0}.direccion AND m.tf IS NOT DISTINCT FROM {0}.tf"
ORACLE["mine_patterns"] = f"""{STATED}, {mode('rebote_fib', 'm1')}, {mode('fib_agotamiento', 'm2')}
    SELECT m.variable, m.value, m.tf, m.direccion, n, round(winrate, 3) AS winrate, round(mag_media, 3) AS mag_media, round(mag_std, 3) AS mag_std, round(dur_media, 3) AS dur_media, round(mfe_media, 3) AS mfe_media, round(mae_media, 3) AS mae_media,
           m1.rebote_fib AS rebote_fib_frecuente, m2.fib_agotamiento AS fib_agot_frecuente FROM mined m LEFT JOIN m1 {_SAME.format('m1')} LEFT JOIN m2 {_SAME.format('m2')}"""
HELD = f"""{STATED}, held AS (SELECT *, n - n_train < greatest(3, floor(least / 5)) AS pending FROM mined WHERE n_train >= least),
    good AS (SELECT variable, value, tf, direccion, n, winrate, wr_train, CASE WHEN NOT pending THEN wr_valid END AS wr_valid, CASE WHEN pending THEN 'PENDIENTE_VALIDACION' ELSE 'VALIDADO' END AS estado FROM held WHERE pending OR (wr_valid >= 0.55 AND wr_train - wr_valid <= 0.10))"""
ORACLE["train_statistics"] = f"""{HELD} SELECT m.variable, m.value, m.tf, m.direccion, m.n, n_train, round(mag_media_train, 3) AS mag_media_train, round(dur_media_train, 3) AS dur_media_train, round(mfe_media_train, 3) AS mfe_media_train,
    round(mae_media_train, 3) AS mae_media_train FROM held m JOIN good ON m.variable = good.variable AND m.value = good.value AND m.direccion = good.direccion AND m.tf IS NOT DISTINCT FROM good.tf"""
ORACLE["temporal_holdout"] = f"{HELD} SELECT variable, value, tf, direccion, n, round(winrate, 4) AS winrate, round(wr_train, 4) AS wr_train, round(wr_valid, 4) AS wr_valid, estado FROM good"
_PATRON = "variable || '==' || value || coalesce('@' || tf, '') AS patron"
ORACLE["summary_table"] = f"{HELD} SELECT {_PATRON}, direccion, n, round(winrate, 4) AS winrate, round(wr_valid, 4) AS wr_valid, estado FROM good"
ORACLE["top_k_patterns"] = f"{STATED} SELECT {_PATRON}, direccion, n FROM mined ORDER BY n DESC, patron, direccion LIMIT 20"
ORACLE["predicate_parse"] = f"{STATED} SELECT {_PATRON}, direccion, variable, value, tf FROM mined"
#: Halves to even; printf alone rounds the binary value, which is beside most decimal halves.
FOUR_DIGITS = "printf('%.4f', round_even({}::DECIMAL(18, 12), 4))"
ORACLE["robust_windows"] = f"""{STATED}, p AS (SELECT *, row_number() OVER (ORDER BY epoch_us(timestamp_inicio), tf, mov_id, symbol) - 1 AS place, count(*) OVER () AS total FROM o1),
    w0 AS (SELECT i AS w, i * (total * 0.5 / 4)::DOUBLE AS x, total FROM (SELECT count(*) AS total FROM o1), range(5) r(i)),
    w1 AS (SELECT w, w * floor(total * 0.5 / 4)::BIGINT + floor(total * 0.6)::BIGINT AS a, floor(total * 0.4)::BIGINT AS tail, total FROM w0),
    w2 AS (SELECT w, a, least(a + tail, total) - 1 AS b FROM w1 WHERE a < total),
    w3 AS (SELECT w, pa.timestamp_inicio AS lo, pb.timestamp_inicio AS hi FROM w2 JOIN p pa ON pa.place = a JOIN p pb ON pb.place = w2.b),
    af AS ({' UNION ALL '.join(f"SELECT direccion, timestamp_inicio, (continuacion = 'CONTINUACION')::INT::DOUBLE AS win, '{f}' AS variable FROM o1 WHERE {f} = 1" for f in FLAGS)}),
    rates AS (SELECT variable, direccion, w, avg(win) AS wr FROM af JOIN w3 ON timestamp_inicio BETWEEN lo AND hi GROUP BY 1, 2, 3 HAVING count(*) >= 3),
    per AS (SELECT variable, direccion, string_agg({FOUR_DIGITS.format('wr')}, ',' ORDER BY w) AS wr_ventanas, stddev_pop(wr) AS s, avg((wr >= 0.55)::INT) AS e FROM rates GROUP BY 1, 2)
    SELECT m.variable, m.value, m.tf, m.direccion, m.n, wr_ventanas, round(s, 4) AS wr_std, round(e, 4) AS pct_ventanas_edge, coalesce(e >= 0.70 AND s <= 0.15, false) AS robusto FROM mined m LEFT JOIN per USING (variable, direccion)"""
_NOW = "now_ AS (SELECT * FROM fl WHERE tf = '{}' QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1)"
ORACLE["match_current"] = f"""{STATED}, {_NOW.format('1H')}, active AS ({' UNION ALL '.join(f"SELECT symbol, '{f}' AS variable FROM now_ WHERE {f} = 1" for f in FLAGS)}) SELECT symbol, {_PATRON}, direccion, n FROM mined JOIN active USING (variable)"""
ORACLE["match_overlap"] = f"""{STATED}, {_NOW.format('1D')}, active AS ({' UNION ALL '.join(f"SELECT symbol, '{f}' AS variable FROM now_ WHERE {f} = 1" for f in FLAGS)}),
    used AS (SELECT symbol, variable, variable IN (SELECT variable FROM mined) AS u, row_number() OVER (PARTITION BY symbol, variable IN (SELECT variable FROM mined) ORDER BY variable) AS r FROM active)
    SELECT now_.symbol, count(variable)::INT AS n_active, (count(*) FILTER (u))::INT AS n_overlap, coalesce(string_agg(variable, ',' ORDER BY variable) FILTER (u AND r <= 5), '') AS first FROM now_ LEFT JOIN used USING (symbol) GROUP BY 1"""
ORACLE["histogram_moves"] = f"""{MACD}, {run('delta > 0', 'd', 'r1')}, r1x AS (SELECT * RENAME (run AS rising) FROM r1), {run('delta < 0', 'r1x', 'r2')},
    v AS MATERIALIZED (SELECT *, lag(hist) OVER ({W}) AS before, run AS falling FROM r2),
    s AS (SELECT *, CASE WHEN before <= 0 AND hist > 0 THEN 'LONG' WHEN before >= 0 AND hist < 0 THEN 'SHORT' END AS direction FROM v),
    s1 AS (SELECT * FROM s WHERE direction IS NOT NULL AND pos < cnt - 5),
    ends AS (SELECT s1.symbol, s1.tf, s1.pos, s1.direction, s1.cnt, min(v.pos) AS stop FROM s1 LEFT JOIN v ON v.symbol = s1.symbol AND v.tf = s1.tf AND v.pos >= s1.pos + 5
             AND CASE s1.direction WHEN 'LONG' THEN v.hist <= 0 OR v.falling >= 5 ELSE v.hist >= 0 OR v.rising >= 5 END GROUP BY 1, 2, 3, 4, 5),
    cand AS MATERIALIZED (SELECT symbol, tf, pos, direction, coalesce(stop, cnt - 1) AS stop, row_number() OVER (PARTITION BY symbol, tf ORDER BY pos) AS i FROM ends),
    hop(symbol, tf, i, pos, stop, direction, free, chosen) AS (SELECT symbol, tf, i, pos, stop, direction, stop + 1, true FROM cand WHERE i = 1 UNION ALL
        SELECT c.symbol, c.tf, c.i, c.pos, c.stop, c.direction, CASE WHEN c.pos >= hop.free THEN c.stop + 1 ELSE hop.free END, c.pos >= hop.free FROM hop JOIN cand c ON c.symbol = hop.symbol AND c.tf = hop.tf AND c.i = hop.i + 1),
    mv AS (SELECT h.symbol, h.tf, h.direction, h.pos, h.stop, a.ts AS ts_start, z.ts AS ts_end, a.close AS p0, z.close AS p1 FROM hop h JOIN v a ON a.symbol = h.symbol AND a.tf = h.tf AND a.pos = h.pos JOIN v z ON z.symbol = h.symbol AND z.tf = h.tf AND z.pos = h.stop WHERE chosen),
    best AS (SELECT mv.symbol, mv.pos, max(v.close) AS hi, min(v.close) AS lo FROM mv JOIN v ON v.symbol = mv.symbol AND v.tf = mv.tf AND v.pos BETWEEN mv.pos AND mv.stop GROUP BY 1, 2)
    SELECT symbol, direction, pos AS bar_start, stop AS bar_end, ts_start, ts_end, round(p0, 4) AS price_start, round(p1, 4) AS price_end, round((p1 - p0) / p0 * 100, 3) AS pct_move,
           round(CASE direction WHEN 'LONG' THEN hi - p0 ELSE p0 - lo END / p0 * 100, 3) AS mfe_pct, stop - pos AS duration_bars, round((stop - pos) / 60, 1) AS duration_hrs
    FROM mv JOIN best USING (symbol, pos) WHERE abs((p1 - p0) / p0 * 100) >= 10 AND stop - pos >= 5"""
_BUCKET = "CASE WHEN x < -3 THEN 'FAR_BELOW' WHEN x < -0.5 THEN 'NEAR_BELOW' WHEN x < 0.5 THEN 'AT' WHEN x < 3 THEN 'NEAR_ABOVE' ELSE 'FAR_ABOVE' END"
_KEY = " || ".join(f"CASE WHEN {f} = 1 THEN '{f}=1|' ELSE '' END" for f in ("above_prev", "long_range", "upper_half"))
ORACLE["pattern_key_stats"] = f"""WITH {bars('e', '1H')}, {FLAGGED}, k AS (SELECT *, (close - open) / open AS x, lead(close) OVER ({W}) - close AS pct FROM fl),
    g AS (SELECT {_KEY} || 'dist_mid=' || {_BUCKET} AS pattern, CASE WHEN above_open = 1 THEN 'LONG' ELSE 'SHORT' END AS direction, pct, volume, high - low AS dur FROM k WHERE pct IS NOT NULL)
    SELECT pattern, count(*) AS n, CASE WHEN 2 * count(*) FILTER (direction = 'LONG') >= count(*) THEN 'LONG' ELSE 'SHORT' END AS dominant_dir,
           round(greatest(count(*) FILTER (direction = 'LONG'), count(*) FILTER (direction = 'SHORT')) / count(*) * 100, 1) AS pct_aligned, round(round(median(abs(pct)), 3), 1) AS pct_move_med, round(round(avg(abs(pct)), 3), 1) AS pct_move_mean,
           round(median(volume), 3) AS mfe_med, round(median(dur), 1) AS dur_hrs_med FROM g GROUP BY 1 HAVING count(*) >= 3"""


def forward(h: int) -> str:
    later, path = f"lead(close, {h}) OVER ({W})", f"OVER ({W} ROWS BETWEEN CURRENT ROW AND {h} FOLLOWING)"
    return f"({later} - close) / close AS ret_{h}, CASE WHEN {later} IS NOT NULL THEN (min(close) {path} - close) / close * 100 END AS mae_{h}, CASE WHEN {later} IS NOT NULL THEN (max(close) {path} - close) / close * 100 END AS mfe_{h}"


FORWARD = f"fw AS MATERIALIZED (SELECT *, {', '.join(forward(h) for h in (30, 60, 120))} FROM fl)"
ORACLE["forward_returns"] = f"WITH {bars('e', '1H')}, {FLAGGED}, {FORWARD} SELECT symbol, ts, {', '.join(f'{p}_{h}' for h in (30, 60, 120) for p in ('ret', 'mae', 'mfe'))} FROM fw"
_UNI = ", ".join(f"round(avg((ret_{h} > 0)::INT), 4) AS wl{h}, round(avg((ret_{h} < 0)::INT), 4) AS ws{h}, round(avg(ret_{h}) * 100, 4) AS pnl_mean_{h}" for h in (30, 60, 120))
_BEST = f"greatest({', '.join(f'{s}{h}' for h in (30, 60, 120) for s in ('wl', 'ws'))})"
ORACLE["univariate_edge"] = f"""WITH {bars('e', '1H')}, {FLAGGED}, {FORWARD}, u AS ({' UNION ALL '.join(f"SELECT *, '{f}' AS variable FROM fw WHERE {f} = 1" for f in FLAGS)}), g AS (SELECT variable, count(*) AS n, {_UNI} FROM u GROUP BY 1)
    SELECT variable, n, {', '.join(f'round(wl{h}, 3) AS wr_long_{h}, round(ws{h}, 3) AS wr_short_{h}, pnl_mean_{h}' for h in (30, 60, 120))}, round({_BEST}, 3) AS best_wr, coalesce({_BEST} >= 0.55, false) AS has_edge FROM g"""
ORACLE["univariate_next"] = f"""WITH {bars('e', '1H')}, {FLAGGED}, u AS ({' UNION ALL '.join(f"SELECT *, '{f}' AS variable FROM fl WHERE {f} = 1" for f in FLAGS)}),
    v AS (SELECT *, {flag('lead(close) OVER (PARTITION BY symbol, tf, variable ORDER BY ts) > close')} AS win FROM u), g AS (SELECT symbol, variable, count(*) AS n, round(avg(win), 4) AS winrate FROM v GROUP BY 1, 2 HAVING count(*) >= 30)
    SELECT symbol, variable, n, round(winrate, 3) AS winrate, round(round(abs(winrate - 0.5), 4), 3) AS edge FROM g WHERE round(abs(winrate - 0.5), 4) >= 0.02"""
_ALL = ("15M", "30M", "1H", "4H", "1D")
ORACLE["alignment_regime"] = f"""WITH {bars('e', *_ALL)}, u AS (SELECT *, {flag('close > open')} AS up FROM b),
    j AS (SELECT t_b.seq, {' + '.join(f'coalesce(s{tf}.up, 0)' for tf in _ALL)} AS n_bull, {' + '.join(f'1 - coalesce(s{tf}.up, 1)' for tf in _ALL)} AS n_bear FROM t_b {' '.join(f"ASOF LEFT JOIN (SELECT * FROM u WHERE tf = '{tf}') s{tf} ON t_b.symbol = s{tf}.symbol AND t_b.ts >= s{tf}.ts" for tf in _ALL)})
    SELECT seq, n_bull::INT AS n_bull, n_bear::INT AS n_bear, CASE WHEN n_bull >= 4 THEN 'BULL' WHEN n_bear >= 4 THEN 'BEAR' ELSE 'NEUTRO' END AS regime, (n_bull >= 3)::INT AS thesis_long, (n_bear >= 3)::INT AS thesis_short FROM j"""
ORACLE["event_flags"] = f"WITH {bars('e', '1H')}, {FLAGGED} SELECT symbol, ts, greatest(above_open, long_range) AS event_bull, greatest(upper_half, above_prev) AS event_bear FROM fl"


def first_hit() -> str:
    """From n to fh: exits by a join with the bars that follow."""
    def side(s: str, sign: int) -> str:
        up, down = ("v.close >= p.close * {}", "v.close <= p.close * {}") if sign > 0 else ("v.close <= p.close * {}", "v.close >= p.close * {}")
        return f"min(v.pos - p.pos) FILTER ({up.format(1 + sign * TAKE)}) AS w_{s}, min(v.pos - p.pos) FILTER ({down.format(1 - sign * STOP)}) AS l_{s}"

    never = HOLD + 1
    out = []
    for s, sign in (("long", 1), ("short", -1)):
        w, l = f"coalesce(w_{s}, {never})", f"coalesce(l_{s}, {never})"  # noqa: E741
        price = f"CASE WHEN {w} < {l} THEN close * {1 + sign * TAKE} WHEN {l} < {w} THEN close * {1 - sign * STOP} ELSE final END"
        out.append(f"pos + least({w}, {l}, {HOLD}) AS exit_{s}, CASE WHEN {w} < {l} THEN 'TP' WHEN {l} < {w} THEN 'SL' ELSE 'TIME' END AS reason_{s}, {price} AS price_{s}, {sign} * (({price}) - close) / close AS pnl_{s}")
    return f"""fq AS MATERIALIZED (SELECT *, row_number() OVER ({W}) - 1 AS pos, lead(close, {HOLD}) OVER ({W}) AS final FROM fl),
    f0 AS (SELECT p.symbol, p.tf, p.pos, {side('long', 1)}, {side('short', -1)} FROM fq p JOIN fq v ON v.symbol = p.symbol AND v.tf = p.tf AND v.pos BETWEEN p.pos + 1 AND p.pos + {HOLD} GROUP BY 1, 2, 3),
    fh AS MATERIALIZED (SELECT fq.*, {', '.join(out)} FROM fq JOIN f0 USING (symbol, tf, pos) WHERE final IS NOT NULL AND close > 0)"""


HITS = f"WITH RECURSIVE {bars('e', '1H')}, {FLAGGED}, {first_hit()}"
ORACLE["first_hit"] = f"{HITS} SELECT fq.symbol, fq.ts, exit_long, exit_short, reason_long, reason_short, round(pnl_long, 4) AS pnl_long, round(pnl_short, 4) AS pnl_short, round(price_long, 4) AS price_long, round(price_short, 4) AS price_short FROM fq LEFT JOIN fh USING (symbol, tf, pos)"


def hop(source: str, keys: tuple[str, ...], gap: int) -> str:
    """From ``source`` (keys, pos, stop, ...) to picked: greedy choice by a recursion over candidates."""
    on = " AND ".join(f"c.{k} = hop.{k}" for k in keys)
    own = ", ".join(keys)
    return f"""cand AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {own} ORDER BY pos, stop) AS i FROM {source}),
    hop({own}, i, free, chosen) AS (SELECT {own}, i, stop + {gap}, true FROM cand WHERE i = 1 UNION ALL
        SELECT {', '.join(f'c.{k}' for k in keys)}, c.i, CASE WHEN c.pos >= hop.free THEN c.stop + {gap} ELSE hop.free END, c.pos >= hop.free FROM hop JOIN cand c ON {on} AND c.i = hop.i + 1),
    picked AS MATERIALIZED (SELECT cand.* FROM cand JOIN hop USING ({own}, i) WHERE chosen)"""


TRADES = f"""{HITS}, sg AS (SELECT *, CASE WHEN above_open = 1 AND above_prev = 1 THEN 'LONG' WHEN long_range = 1 THEN 'SHORT' END AS direction FROM fh),
    en AS (SELECT symbol, tf, pos, direction, CASE direction WHEN 'LONG' THEN exit_long ELSE exit_short END AS stop, CASE direction WHEN 'LONG' THEN price_long ELSE price_short END AS price, CASE direction WHEN 'LONG' THEN pnl_long ELSE pnl_short END AS pnl,
           CASE direction WHEN 'LONG' THEN reason_long ELSE reason_short END AS reason FROM sg WHERE direction IS NOT NULL), {hop('en', ('symbol',), 0)}"""
ORACLE["trade_cycle"] = f"{TRADES} SELECT symbol, pos AS bar_entry, stop AS bar_exit, direction, round(price, 4) AS exit_price, round(pnl, 4) AS pnl_pct, reason AS exit_reason FROM picked"
ORACLE["trade_stats"] = f"""{TRADES} SELECT symbol, direction, count(*) AS n_trades, round(round(avg((pnl > 0)::INT), 4), 3) AS win_rate, round(round(sum(pnl), 5), 3) AS total_pnl, round(round(avg(pnl), 6), 3) AS avg_pnl,
    count(*) FILTER (reason = 'TP') AS n_tp, count(*) FILTER (reason = 'SL') AS n_sl, count(*) FILTER (reason = 'TIME') AS n_time FROM picked GROUP BY 1, 2"""
_BITS = sorted(FLAGS)
_COMBOS = " UNION ALL ".join(
    f"SELECT symbol, '{' + '.join(f for i, f in enumerate(_BITS) if m >> i & 1)}' AS signals, {m.bit_count()} AS n_signals, pos, exit_long AS stop, pnl_long AS pnl, reason_long AS reason FROM fh WHERE {' AND '.join(f'{f} = 1' for i, f in enumerate(_BITS) if m >> i & 1)}" for m in range(1, 1 << len(_BITS))
)
ORACLE["combo_search"] = f"""{HITS}, en AS ({_COMBOS}), {hop('en', ('symbol', 'signals'), 1)}, g AS (SELECT symbol, signals, n_signals, count(*) AS n_trades, avg((pnl > 0)::INT) AS wr, avg(pnl) AS a, sum(pnl) AS s, avg((reason = 'TP')::INT) AS tp FROM picked GROUP BY 1, 2, 3 HAVING count(*) >= 3)
    SELECT symbol, signals, n_signals, n_trades, round(round(wr, 4), 3) AS win_rate, round(round(a, 6), 3) AS avg_pnl, round(round(s, 4), 3) AS total_pnl, round(tp, 3) AS tp_rate, round(round(wr * {TAKE} - (1 - wr) * {STOP}, 6), 3) AS edge FROM g"""
_MASK = " + ".join(f"{f} * {1 << i}" for i, f in enumerate(FLAGS))
ORACLE["knn_hamming"] = f"""WITH {bars('o', '1D')}, {FLAGGED}, {FORWARD}, k AS MATERIALIZED (SELECT *, row_number() OVER ({W}) - 1 AS pos, {_MASK} AS mask FROM fw),
    g AS (SELECT a.symbol, a.ts, count(*) AS n, {', '.join(f'count(o.ret_{h}) AS v{h}, coalesce(sum((o.ret_{h} > 0)::INT), 0) AS u{h}, coalesce(sum((o.ret_{h} < 0)::INT), 0) AS d{h}, sum(o.ret_{h}) AS s{h}, sum(o.mae_{h}) AS ma{h}, sum(o.mfe_{h}) AS mf{h}' for h in (30, 60, 120))}
          FROM k a JOIN k o ON a.symbol = o.symbol AND o.pos <= a.pos - 121 AND bit_count(xor(a.mask, o.mask)) <= 1 GROUP BY 1, 2 HAVING count(*) >= 10)
    SELECT symbol, ts, n AS n_neighbors, {', '.join(f'CASE WHEN v{h} >= 10 THEN round(u{h} / v{h}, 4) END AS wr_long_{h}, CASE WHEN v{h} >= 10 THEN round(d{h} / v{h}, 4) END AS wr_short_{h}, CASE WHEN v{h} >= 10 THEN round(s{h} / v{h} * 100, 4) END AS pnl_long_{h}, CASE WHEN v{h} >= 10 THEN round(ma{h} / v{h}, 4) END AS mae_mean_{h}, CASE WHEN v{h} >= 10 THEN round(mf{h} / v{h}, 4) END AS mfe_mean_{h}' for h in (30, 60, 120))} FROM g"""
ORACLE["direction_balance"] = f"WITH {bars('e', '1H', '4H', '1D')}, {LEGS}, g AS (SELECT tf, count(*) FILTER (direccion = 'LONG') AS n_long, count(*) FILTER (direccion = 'SHORT') AS n_short FROM legs GROUP BY 1) SELECT tf, n_long, n_short, round(n_long / coalesce(nullif(n_short, 0), 1), 4) AS ratio FROM g"
ORACLE["group_aggregate"] = f"WITH {bars('e', '1H', '4H')}, s AS (SELECT *, {roll('avg', 'close', 50)} AS sma50 FROM b) SELECT symbol, tf, count(*) AS n_bars, sum({flag('close > sma50')})::BIGINT AS n_above, round(avg(close), 4) AS avg_close FROM s GROUP BY 1, 2"
ORACLE["hop_intervals"] = f"WITH RECURSIVE {bars('e', '15M')}, {NUMBERED}, iv AS (SELECT symbol, pos, pos + 1 + floor(close / 20)::BIGINT AS stop FROM n), {hop('iv', ('symbol',), 1)} SELECT symbol, pos, stop FROM picked"


def _runs(*conditions: tuple[str, str], source: str) -> str:
    """Table expressions that add a run length for each (name, condition), one after the other; the last is called r_last."""
    out, at = [], source
    for k, (name, condition) in enumerate(conditions):
        to = "r_last" if k + 1 == len(conditions) else f"rx{k}"
        out.append(f"{run(condition, at, f'ra{k}')}, {to} AS (SELECT * RENAME (run AS {name}) FROM ra{k})")
        at = to
    return ", ".join(out)


def indicator_rows(source: str, *tfs: str) -> tuple[str, dict[str, str], dict[str, str], list[str]]:
    """Table expressions from bars to ``r_last``, with every indicator of every bar from one recursion for the exponential means.

    Also the conditions of the flags, the expressions of the other columns, and the names of the run lengths.
    """
    conf = " AND abs({m} - l{r}) / l{r} * 100 < 0.3"
    zone = "abs((close - l{r}) / l{r} * 100) < 0.3"
    sums, means = {}, {"macd_line": "line", "macd_signal_line": "sig", "macd_hist": "hist", "macd_hist_delta": "delta", "macd_line_dist": "hist", "stoch_K": "k", "stoch_D": "d", "stoch_K_delta": "k - k1", "stoch_KD_dist": "k - d"}
    sums |= {
        "macd_above_zero": "hist > 0", "macd_line_above_zero": "line > 0", "macd_above_sig": "over_sig = 1", "macd_e1_bull": "delta > 0 AND delta1 <= 0", "macd_e1_bear": "delta < 0 AND delta1 >= 0",
        "macd_e2_bull": "over_sig = 1 AND over_sig1 = 0", "macd_e2_bear": "over_sig = 0 AND over_sig1 = 1",
        "stoch_KD_above": "kd = 1", "stoch_ob": "k > 80", "stoch_os": "k < 20", "stoch_A_bull": f"kd = 1 AND kd1 = 0 AND {_LOW3}", "stoch_A_bear": f"kd = 0 AND kd1 = 1 AND {_HIGH3}",
        "stoch_B_bull": "kd = 1 AND kd1 = 0 AND k BETWEEN 30 AND 70", "stoch_B_bear": "kd = 0 AND kd1 = 1 AND k BETWEEN 30 AND 70",
        "align_full_bull": "close > ema8 AND ema8 > ema21 AND ema21 > sma50 AND sma50 > sma200", "align_full_bear": "close < ema8 AND ema8 < ema21 AND ema21 < sma50 AND sma50 < sma200",
    }
    for m in MA_NAMES:
        means[f"dist_{m}_pct"] = f"dist_{m}"
        sums |= {
            f"above_{m}": f"a_{m} = 1", f"near_{m}": f"abs(dist_{m}) < 0.3", f"cross_bull_{m}": f"a_{m} = 1 AND a1_{m} = 0", f"cross_bear_{m}": f"a_{m} = 0 AND a1_{m} = 1",
            f"reject_bull_{m}": f"low <= {m} AND close > {m}", f"reject_bear_{m}": f"high >= {m} AND close < {m}", f"extreme_bull_{m}": f"dist_{m} > 2 * s_{m}", f"extreme_bear_{m}": f"dist_{m} < -2 * s_{m}",
        }
    for r in RATIOS:
        means |= {f"fib{r}_level": f"l{r}", f"fib{r}_dist_pct": f"(close - l{r}) / nullif(l{r}, 0) * 100"}
        sums |= {f"fib{r}_in_zone": zone.format(r=r), f"fib{r}_reject_bull": f"low <= l{r} * 1.003 AND close > l{r}", f"fib{r}_reject_bear": f"high >= l{r} * 0.997 AND close < l{r}", f"fib{r}_above": f"close > l{r}"}
        sums |= {f"fib{r}_conf_{m}": zone.format(r=r) + conf.format(m=m, r=r) for m in MA_NAMES}
    runs = [("macd_hist_bars_rising", "delta > 0"), ("macd_hist_bars_falling", "delta < 0"), ("stoch_bars_extreme", "k > 80 OR k < 20"), *[(f"{s}_{m}", f"a_{m} = {v}") for m in MA_NAMES for s, v in (("over", 1), ("under", 0))]]
    ctes = f"""WITH RECURSIVE {bars(source, *tfs)}, {NUMBERED}, {EWM}, a AS MATERIALIZED (SELECT n.*, e8 AS ema8, e21 AS ema21, {roll('avg', 'close', 50)} AS sma50, {roll('avg', 'close', 200)} AS sma200 FROM n JOIN e USING (symbol, tf, pos)), {_levels('a', *tfs)},
    i0 AS (SELECT l.*, e12 - e26 AS line, sig, (e12 - e26) - sig AS hist, {roll('min', 'low', 14)} AS lo14, {roll('max', 'high', 14)} AS hi14 FROM l JOIN e USING (symbol, tf, pos)),
    i1 AS (SELECT *, hist - lag(hist) OVER ({W}) AS delta, {flag('line > sig')} AS over_sig, 100 * (close - lo14) / nullif(hi14 - lo14, 0) AS raw, {', '.join(f'(close - {m}) / {m} * 100 AS dist_{m}, {flag(f"close > {m}")} AS a_{m}' for m in MA_NAMES)} FROM i0),
    i2 AS (SELECT *, lag(delta) OVER ({W}) AS delta1, coalesce(lag(over_sig) OVER ({W}), 0) AS over_sig1, {roll('avg', 'raw', 3)} AS k, {', '.join(f"{roll('stddev_samp', f'dist_{m}', 200, 50)} AS s_{m}, coalesce(lag(a_{m}) OVER ({W}), 0) AS a1_{m}" for m in MA_NAMES)} FROM i1),
    i3 AS (SELECT *, {roll('avg', 'k', 3)} AS d, lag(k) OVER ({W}) AS k1, lag(k, 2) OVER ({W}) AS k2 FROM i2),
    i4 AS (SELECT *, {flag('k > d')} AS kd FROM i3), i5 AS (SELECT *, coalesce(lag(kd) OVER ({W}), 0) AS kd1 FROM i4), {_runs(*runs, source='i5')}"""
    return ctes, sums, means, [n for n, _ in runs[:3]]


def _census() -> str:
    ctes, sums, means, runs = indicator_rows("o", "1D")
    total = [f'sum({flag(c)})::BIGINT AS "{n}"' for n, c in sums.items()] + [f'round(avg({x}), 2) AS "{n}"' for n, x in means.items()]
    total += [f"sum({n})::BIGINT AS {n}" for n in runs] + [f"sum(over_{m} + under_{m})::BIGINT AS bars_side_{m}" for m in MA_NAMES]
    return f"{ctes} SELECT symbol, {', '.join(total)} FROM r_last GROUP BY 1"


ORACLE["indicator_census"] = _census()
_CHOSEN = f"""{FORWARD}, u AS ({' UNION ALL '.join(f"SELECT *, '{f}' AS variable FROM fw WHERE {f} = 1" for f in FLAGS)}), uni AS (SELECT variable, count(*) AS n, {_UNI} FROM u GROUP BY 1 HAVING count(*) >= 50),
    top AS (SELECT count(*) AS c FROM uni WHERE wl120 >= 0.9 OR ws120 >= 0.9), rate AS (SELECT CASE WHEN c > 0 THEN 0.9 ELSE 0.5 END AS least FROM top),
    chosen AS MATERIALIZED (SELECT variable, 'LONG' AS side FROM uni, rate WHERE wl120 >= least UNION ALL SELECT variable, 'SHORT' FROM uni, rate WHERE ws120 >= least)"""
ORACLE["chosen_signals"] = f"WITH {bars('e', '1H')}, {FLAGGED}, {_CHOSEN} SELECT * FROM chosen"
_ANY = lambda side: " OR ".join(f"({f} = 1 AND EXISTS (SELECT 1 FROM chosen WHERE variable = '{f}' AND side = '{side}'))" for f in FLAGS)
ORACLE["chosen_trades"] = f"""{HITS}, {_CHOSEN}, sg AS (SELECT *, CASE WHEN {_ANY('LONG')} THEN 'LONG' WHEN {_ANY('SHORT')} THEN 'SHORT' END AS direction FROM fh),
    en AS (SELECT symbol, tf, pos, close, direction, CASE direction WHEN 'LONG' THEN exit_long ELSE exit_short END AS stop, CASE direction WHEN 'LONG' THEN price_long ELSE price_short END AS price, CASE direction WHEN 'LONG' THEN pnl_long ELSE pnl_short END AS pnl,
           CASE direction WHEN 'LONG' THEN reason_long ELSE reason_short END AS reason FROM sg WHERE direction IS NOT NULL), {hop('en', ('symbol',), 0)}
    SELECT symbol, pos AS bar_entry, stop AS bar_exit, direction, round(close, 4) AS entry_price, round(price, 4) AS exit_price, round(pnl, 4) AS pnl_pct, reason AS exit_reason FROM picked"""
