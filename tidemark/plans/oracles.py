"""DuckDB SQL that says what the registered queries return, built from shared steps."""

from __future__ import annotations

import math

from tidemark.plans.params import (
    AR_MIN_SAMPLES,
    AR_TOLERANCE,
    ATTENTION_TEMPERATURE,
    ATTENTION_TOP_K,
    ATTENTION_WEIGHTS,
    COMPONENTS,
    CV_SPLITS,
    CV_TRAIN_MULTIPLIER,
    EPSILON,
    LONG,
    MEDIUM,
    PERIODIC_TEMPERATURE,
    PERIODIC_TOP_K,
    PERIODIC_WEIGHTS,
    SHORT,
    Params,
)

E = repr(EPSILON)
YEAR = repr(math.sqrt(252))
ALL = SHORT + MEDIUM + LONG


def over(first: int, last: int = 0, key: str = "series_key") -> str:
    end = "CURRENT ROW" if last == 0 else f"{-last} PRECEDING"
    return f"OVER (PARTITION BY {key} ORDER BY rn ROWS BETWEEN {-first} PRECEDING AND {end})"


ROW = "OVER (PARTITION BY series_key ORDER BY rn)"


def roll(agg: str, x: str, p: int, least: int | None = None) -> str:
    w = over(-(p - 1))
    return f"CASE WHEN count({x}) {w} >= {least or p} THEN {agg}({x}) {w} END"


#: Instead of a key of bars: prices of each event type that move with its events.
WALK = "walk"
WALKED = """WITH walk AS (SELECT * EXCLUDE (value), 10 * exp(0.5 * sum((floor(value % 1 * 128) - 63.5) / 128)
  OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS value FROM events)"""


def bars(width: str = "1 hour", key: str | None = None) -> list[str]:
    source, steps = ("walk", WALKED) if key == WALK else ("events", "")
    key = "event_type" if key == WALK else key
    return [
        f"""bars AS ({steps} SELECT {key or "'ALL'"} AS series_key, time_bucket(INTERVAL '{width}', ts) AS ts,
  first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
  last(value ORDER BY ts, event_id) AS close, count(*) AS n_events FROM {source} GROUP BY 1, 2)""",
        """num AS (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY ts) - 1 AS rn,
  count(*) OVER (PARTITION BY series_key) AS n FROM bars)""",
    ]


GEOMETRY = [
    """geo0 AS (SELECT *, (high + low + close) / 3 AS typical_price, high - low AS hl_range,
  (high - low) / nullif(close, 0) * 100 AS hl_range_pct, abs(open - close) AS oc_range,
  abs(open - close) / nullif(close, 0) * 100 AS oc_range_pct, high - greatest(open, close) AS upper_wick,
  least(open, close) - low AS lower_wick FROM num)""",
    f"""geo AS (SELECT *, hl_range * hl_range_pct AS volume_proxy, oc_range AS body_size,
  oc_range / (hl_range + {E}) AS body_to_range_ratio,
  least(greatest(1 - abs(upper_wick - lower_wick) / (hl_range + {E}), 0), 1) AS wick_balance FROM geo0)""",
]
PHASE = [
    """pha0 AS (SELECT *, hour(ts)::DOUBLE AS hour_utc, (isodow(ts) - 1)::DOUBLE AS day_of_week,
  (hour(ts) * 60 + minute(ts))::DOUBLE AS minute_of_day FROM geo)""",
    """pha AS (SELECT *, sin(hour_utc * 2 * pi() / 24) AS hour_sin, cos(hour_utc * 2 * pi() / 24) AS hour_cos,
  sin(minute_of_day * 2 * pi() / 1440) AS minute_sin, cos(minute_of_day * 2 * pi() / 1440) AS minute_cos,
  sin(day_of_week * 2 * pi() / 7) AS dow_sin, cos(day_of_week * 2 * pi() / 7) AS dow_cos FROM pha0)""",
]


def volatility(periods: tuple[int, ...] = ALL) -> list[str]:
    first = ", ".join(
        f"{roll('max', 'high', p)} AS high_{p}, {roll('min', 'low', p)} AS low_{p}, "
        f"({roll('avg', 'hl_range_pct', p)}) / nullif(({roll('avg', 'hl_range_pct', 3 * p, p)}), 0) AS vol_ratio_{p}, "
        f"({roll('stddev_samp', 'log_return', p)}) * {YEAR} AS realized_vol_{p}"
        for p in periods
    )
    second = ", ".join(
        f"high_{p} - low_{p} AS range_width_{p}, (high_{p} - low_{p}) / nullif(close, 0) * 100 AS range_width_pct_{p}, "
        f"(close - low_{p}) / (high_{p} - low_{p} + {E}) AS price_position_{p}"
        for p in periods
    )
    return [
        f"vol0 AS (SELECT *, ln(close / nullif(lag(close) {ROW}, 0)) AS log_return FROM pha)",
        f"vol1 AS (SELECT *, {first} FROM vol0)",
        f"vol AS (SELECT *, {second} FROM vol1)",
    ]


def momentum(periods: tuple[int, ...] = SHORT + MEDIUM, source: str = "vol") -> list[str]:
    first = ", ".join(
        f"(close / nullif(lag(close, {p}) {ROW}, 0) - 1) * 100 AS roc_{p}, "
        f"close - lag(close, {p}) {ROW} AS momentum_{p}, "
        f"avg(greatest(step, 0)) {over(-(p - 1))} AS gain_{p}, avg(greatest(-step, 0)) {over(-(p - 1))} AS loss_{p}"
        for p in periods
    )
    second = ", ".join(
        f"CASE WHEN rn < {p - 1} THEN NULL WHEN loss_{p} > 0 THEN 100 - 100 / (1 + gain_{p} / loss_{p}) "
        f"WHEN gain_{p} > 0 THEN 100 END AS rsi_{p}, "
        f"abs({roll('avg', f'roc_{p}', p)}) / (({roll('avg', 'hl_range_pct', p)}) + {E}) AS trend_strength_{p}"
        for p in periods
    )
    return [
        f"mom0 AS (SELECT *, coalesce(close - lag(close) {ROW}, 0) AS step FROM {source})",
        f"mom1 AS (SELECT *, {first} FROM mom0)",
        f"mom AS (SELECT *, {second} FROM mom1)",
    ]


def hurst(periods: tuple[int, ...] = MEDIUM, source: str = "mom") -> list[str]:
    out = [
        """hur0 AS (SELECT a.series_key, a.rn, d, a.close - b.close AS diff
  FROM num a CROSS JOIN generate_series(2, 20) AS g(d) JOIN num b ON b.series_key = a.series_key AND b.rn = a.rn - d)"""
    ]
    for p in periods:
        top = min(20, p // 2)
        taus = " UNION ALL ".join(
            f"SELECT series_key, rn + 1 AS rn, d, stddev_pop(diff) {over(-(p - k - 1), 0)} AS tau FROM hur0 WHERE d = {k}"
            for k in range(2, top + 1)
        )
        out.append(
            f"""hur{p} AS (SELECT series_key, rn, CASE WHEN count(*) >= 2 THEN regr_slope(ln(tau), ln(d)) END AS slope
  FROM ({taus}) WHERE tau > 0 AND rn >= {p} GROUP BY series_key, rn)"""
        )
    columns = ", ".join(f"coalesce(hur{p}.slope, 0.5) AS hurst_{p}" for p in periods)
    joins = " ".join(f"LEFT JOIN hur{p} USING (series_key, rn)" for p in periods)
    return [*out, f"hur AS (SELECT x.*, {columns} FROM {source} x {joins})"]


SUTTE = [
    f"""sut0 AS (SELECT *, close / (low + {E}) AS sutte_low_ratio, close / (high + {E}) AS sutte_high_ratio FROM hur)""",
    f"""sut1 AS (SELECT *, {roll("avg", "sutte_low_ratio", 3, 2)} AS sutte_low_ma,
  {roll("avg", "sutte_high_ratio", 3, 2)} AS sutte_high_ma FROM sut0)""",
    f"""sut2 AS (SELECT *, (sutte_low_ma - sutte_high_ma) / (sutte_low_ma + sutte_high_ma + {E}) AS sutte_signal FROM sut1)""",
    """feat AS (SELECT *, CASE WHEN sutte_signal IS NOT NULL THEN least(abs(sutte_signal), 1) END AS sutte_conviction,
  CASE WHEN sutte_signal > 0.02 THEN 1 WHEN sutte_signal < -0.02 THEN -1 ELSE 0 END AS sutte_direction FROM sut2)""",
]
ADAPTIVE = [
    f"""ada0 AS (SELECT *, list_reduce(list(sutte_low_ratio) {over(-63)}, lambda s, v: 0.5 * s + 0.5 * v) AS sutte_adaptive_low,
  list_reduce(list(sutte_high_ratio) {over(-63)}, lambda s, v: 0.5 * s + 0.5 * v) AS sutte_adaptive_high FROM feat)""",
    f"""ada AS (SELECT *, (sutte_adaptive_low - sutte_adaptive_high) / (sutte_adaptive_low + sutte_adaptive_high + {E})
  AS sutte_adaptive_signal FROM ada0)""",
]


def features(width: str = "1 hour", key: str | None = None, everything: bool = True) -> list[str]:
    if everything:
        return [*bars(width, key), *GEOMETRY, *PHASE, *volatility(), *momentum(), *hurst(), *SUTTE]
    ratio = f"({roll('avg', 'hl_range_pct', 20)}) / nullif(({roll('avg', 'hl_range_pct', 60, 20)}), 0)"
    return [
        *bars(width, key),
        *GEOMETRY,
        *PHASE,
        f"vol AS (SELECT *, {ratio} AS vol_ratio_20 FROM pha)",
        *momentum((5, 20)),
        *hurst((20,)),
        *SUTTE,
    ]


def hurst_score(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN 0.5 WHEN {x} <= 0.5 THEN 1.0 WHEN {x} >= 0.7 THEN 0.0 ELSE 1 - ({x} - 0.5) / (0.70 - 0.50) END"


def norm(x: str) -> str:
    return f"least(greatest(({x} - 0.30) / (0.80 - 0.30), 0), 1)"


SIGNATURE = f"""sig AS (SELECT *, coalesce(list_avg(list_filter([
  1 - least(greatest(vol_ratio_20, CASE WHEN vol_ratio_20 IS NOT NULL THEN 0 END), CASE WHEN vol_ratio_20 IS NOT NULL THEN 2 END) / 2,
  1 - least(greatest(body_to_range_ratio, 0), 1), least(greatest(wick_balance, 0), 1),
  CASE WHEN trend_strength_20 IS NOT NULL THEN 1 - least(abs(trend_strength_20) / 2, 1) END,
  CASE WHEN hurst_20 IS NOT NULL THEN {hurst_score("hurst_20")} END], lambda x: x IS NOT NULL)), 0.5) AS signature FROM feat)"""


def context(p: Params, name: str, weights: dict[str, float], k: int, tau: float) -> list[str]:
    """(series_key, rn, score) of the history match over some columns; sig must be there."""
    span, first = p.history, p.lookback
    columns = ", ".join(weights)
    values = ", ".join(f"('{c}', {w!r})" for c, w in weights.items())
    total = sum(weights.values())
    near = f"h.series_key = r.series_key AND h.rn BETWEEN r.rn - {first + span} AND r.rn - {first + 1}"
    cut = "least(greatest((coalesce({}, 0) - c) / s, -5), 5)"
    return [
        f"""{name}l AS (SELECT series_key, rn, col, val FROM (SELECT series_key, rn, {columns} FROM sig)
  UNPIVOT INCLUDE NULLS (val FOR col IN ({columns})))""",
        f"{name}r AS (SELECT series_key, rn FROM sig WHERE least(rn - {first}, {span}) >= {p.min_bars})",
        f"""{name}c AS (SELECT r.series_key, r.rn, h.col, quantile_cont(h.val, 0.5) AS m, quantile_cont(h.val, 0.25) AS q1,
  quantile_cont(h.val, 0.75) AS q3, stddev_pop(h.val) AS sd FROM {name}r r JOIN {name}l h ON {near} GROUP BY ALL)""",
        f"""{name}d AS (SELECT r.series_key, r.rn, h.col, quantile_cont(abs(h.val - r.m), 0.5) AS mad
  FROM {name}c r JOIN {name}l h ON {near} AND h.col = r.col GROUP BY ALL)""",
        f"""{name}s AS (SELECT series_key, rn, col, coalesce(m, 0) AS c, CASE WHEN m IS NULL THEN 1
  WHEN greatest((q3 - q1) / 1.349, 1.4826 * mad) > {E} THEN greatest((q3 - q1) / 1.349, 1.4826 * mad)
  WHEN sd > {E} THEN sd ELSE 1 END AS s FROM {name}c JOIN {name}d USING (series_key, rn, col))""",
        f"{name}w(col, w) AS (VALUES {values})",
        f"""{name}g AS (SELECT r.series_key, r.rn, h.rn AS hrn,
  exp(-round(sum(w * abs({cut.format("h.val")} - {cut.format("f.val")})) / {total!r}, 12) / {tau}) AS likeness
  FROM {name}s r JOIN {name}w USING (col) JOIN {name}l h ON {near} AND h.col = r.col
  JOIN {name}l f ON f.series_key = r.series_key AND f.rn = r.rn - 1 AND f.col = r.col GROUP BY ALL)""",
        f"""{name}t AS (SELECT g.*, sig.signature, row_number() OVER (PARTITION BY g.series_key, g.rn ORDER BY likeness DESC, hrn) AS k
  FROM {name}g g JOIN sig ON sig.series_key = g.series_key AND sig.rn = g.hrn)""",
        f"""{name} AS (SELECT series_key, rn, CASE WHEN sum(likeness) > {E} THEN sum(likeness * signature) / sum(likeness) ELSE 0.5 END AS score
  FROM {name}t WHERE k <= {k} GROUP BY ALL)""",
    ]


def both_contexts(p: Params) -> list[str]:
    return [
        SIGNATURE,
        *context(p, "att", ATTENTION_WEIGHTS, ATTENTION_TOP_K, ATTENTION_TEMPERATURE),
        *context(p, "per", PERIODIC_WEIGHTS, PERIODIC_TOP_K, PERIODIC_TEMPERATURE),
    ]


def core(p: Params, source: str = "feat", gate: bool = True) -> list[str]:
    w, long = over(-p.lookback, -1), over(-4 * p.lookback, -1)
    ahead = f"AND least({p.lookforward}, n - rn) >= {p.min_bars}" if gate else ""
    return [
        f"""cor0 AS (SELECT *, least(rn, {p.lookback}) AS lookback, max(high) {w} AS zone_high, min(low) {w} AS zone_low,
  avg(close) {w} AS close_mean, avg(hl_range_pct) {w} AS past_vol, avg(hl_range_pct) {long} AS hist_vol FROM {source})""",
        f"""cor1 AS (SELECT *, zone_high - zone_low AS past_range, (zone_high - zone_low) / (close_mean + {E}) * 100 AS past_range_pct,
  CASE WHEN hist_vol > 0 THEN past_vol / hist_vol ELSE 1 END AS vol_contraction FROM cor0)""",
        f"""cor AS (SELECT *, coalesce(lookback >= {p.min_bars} AND close_mean > 0 {ahead}, false) AS scored,
  1 - least(vol_contraction, 1) AS c_contraction,
  1 - least(past_range_pct / ((past_vol + {E}) * {p.range_threshold}), 1) AS c_range FROM cor1)""",
    ]


def position(p: Params, source: str = "feat") -> list[str]:
    return [
        f"""pos0 AS (SELECT r.series_key, r.rn, h.rn AS hrn, h.close,
  max(h.high) OVER q AS hi, min(h.low) OVER q AS lo FROM {source} r JOIN {source} h
  ON h.series_key = r.series_key AND h.rn BETWEEN r.rn - {p.lookback} AND r.rn - 1
  WINDOW q AS (PARTITION BY r.series_key, r.rn ORDER BY h.rn))""",
        """pos AS (SELECT series_key, rn, stddev_pop((close - lo) / (hi - lo)) AS dev FROM pos0 WHERE hi > lo GROUP BY ALL)""",
    ]


def sutte_score(p: Params, source: str = "feat") -> list[str]:
    w = over(-p.lookback, -1)
    return [
        f"""sco0 AS (SELECT series_key, rn, least(rn, {p.lookback}) AS lookback,
  list_filter(list(sutte_conviction) {w}, lambda x: x IS NOT NULL) AS c, stddev_samp(sutte_direction) {w} AS dev FROM {source})""",
        f"""sco AS (SELECT series_key, rn, CASE WHEN lookback < 10 OR len(coalesce(c, [])) = 0 THEN 0.5 ELSE
  least(greatest(0.4 * list_avg(c) + 0.3 * (1 - least(dev, 1)) + 0.3 * CASE WHEN len(c) < 6 THEN 0.5 ELSE
    0.5 + least(greatest((list_avg(c[-3:]) - list_avg(c[1:3])) / (list_avg(c[1:3]) + {E}), -0.5), 0.5) END, 0), 1) END AS sutte_raw
  FROM sco0)""",
    ]


def anchor(p: Params, source: str = "feat") -> list[str]:
    """(series_key, rn, scale) of the autoregressive anchor of every window, from the normal equations.

    Lags are centred, so the constant drops out and three equations are left; windows whose lags
    are collinear have no unique solution and are tested elsewhere.
    """
    lags = ("l1", "l2", "l3")
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    cov = ", ".join(f"covar_pop(h.{lags[i]}, h.{lags[j]}) AS s{i}{j}" for i, j in pairs)
    right = ", ".join(f"covar_pop(h.{x}, h.close) AS c{i}, avg(h.{x}) AS m{i}" for i, x in enumerate(lags))

    def det(m: list[list[str]]) -> str:
        (a, b, c), (d, e, f), (g, h, i) = m
        return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"

    whole = [[f"s{min(i, j)}{max(i, j)}" for j in range(3)] for i in range(3)]
    parts = [det([[f"c{i}" if j == k else whole[i][j] for j in range(3)] for i in range(3)]) for k in range(3)]
    # The last prices before the window's last one.
    latest = ("p1", "p2", "p3")
    forecast = " + ".join(["my", *[f"{d} / {det(whole)} * ({z} - m{i})" for i, (d, z) in enumerate(zip(parts, latest, strict=True))]])
    w = over(-p.lookback, -1)
    return [
        f"""anc0 AS (SELECT series_key, rn, close, least(rn, {p.lookback}) AS size, lag(close, 1) {ROW} AS l1, lag(close, 2) {ROW} AS l2,
  lag(close, 3) {ROW} AS l3, lag(close, 4) {ROW} AS l4, max(close) {w} - min(close) {w} AS span FROM {source})""",
        f"""anc1 AS (SELECT r.series_key, r.rn, avg(h.close) AS my, {right}, {cov} FROM anc0 r JOIN anc0 h
  ON h.series_key = r.series_key AND h.rn BETWEEN r.rn - r.size + 3 AND r.rn - 2 WHERE r.size > {AR_MIN_SAMPLES} GROUP BY ALL)""",
        f"""anc2 AS (SELECT series_key, rn, size, l1 AS last, span, CASE WHEN size > {AR_MIN_SAMPLES} THEN {forecast} ELSE p1 END AS forecast
  FROM (SELECT *, l2 AS p1, l3 AS p2, l4 AS p3 FROM anc0) LEFT JOIN anc1 USING (series_key, rn))""",
        f"""anc AS (SELECT series_key, rn, CASE WHEN size < 2 THEN 0.5 ELSE
  greatest(0, 1 - least(abs(last - forecast) / greatest(span, {E}) / {AR_TOLERANCE}, 1)) END AS scale FROM anc2)""",
    ]


def scored(p: Params, gate: bool = True) -> list[str]:
    """All of the score and the divergence; needs feat."""
    w, recent = over(-p.lookback, -1), over(-min(20, p.lookback), -1)
    total = " + ".join(f"{p.weight(c)!r} * c_{c}" for c in COMPONENTS)
    active = "(lookback >= 10 AND abs(recent_signal) > 0.10 AND price_trend <> 0)"
    agrees = "sign(recent_signal) = price_trend"
    return [
        *both_contexts(p),
        *core(p, gate=gate),
        *position(p),
        *sutte_score(p),
        *anchor(p),
        f"""com0 AS (SELECT cor.*, coalesce(pos.dev, 1) AS pos_std, sutte_raw,
  coalesce(att.score, 0.5) AS attention_raw, coalesce(per.score, 0.5) AS periodic_raw, CASE WHEN scored THEN scale END AS scale_raw,
  (1 - least(greatest(avg(body_to_range_ratio) {w}, 0), 1) + least(greatest(avg(wick_balance) {w}, 0), 1)) / 2 AS interaction_score,
  lag(hurst_20) {ROW} AS hurst_exponent, avg(sutte_signal) {recent} AS recent_signal,
  sign((lag(close) {ROW} - first(close) {recent}) / (first(close) {recent} + {E})) AS price_trend
  FROM cor LEFT JOIN pos USING (series_key, rn) LEFT JOIN att USING (series_key, rn)
  LEFT JOIN per USING (series_key, rn) JOIN sco USING (series_key, rn) JOIN anc USING (series_key, rn))""",
        f"""com1 AS (SELECT *, 0.5 * (1 - least(greatest(pos_std * {p.position_sensitivity}, 0), 1)) + 0.5 * interaction_score AS c_position,
  {hurst_score("hurst_exponent")} AS c_hurst, {norm("attention_raw")} AS c_attention, {norm("periodic_raw")} AS c_periodic,
  CASE WHEN scored THEN {norm("scale_raw")} END AS c_scale, {norm("sutte_raw")} AS c_sutte FROM com0)""",
        f"com2 AS (SELECT *, {total} AS score FROM com1)",
        f"""com AS (SELECT *, CASE WHEN {active} THEN CASE WHEN {agrees} THEN price_trend ELSE -price_trend END ELSE 0 END AS divergence,
  CASE WHEN {active} THEN CASE WHEN {agrees} THEN 'TRUST' ELSE 'FADE' END ELSE 'NEUTRAL' END AS divergence_signal,
  CASE WHEN {active} THEN least(abs(recent_signal) * (1 + 0.5 * least(greatest(score, 0), 1)) * CASE WHEN {agrees} THEN 1.5 ELSE 2 END, 1)
    ELSE 0 END AS divergence_confidence FROM com2)""",
    ]


def thresholds(p: Params) -> str:
    """thr: (series_key, threshold), the automatic one where com has no window above the setting's; needs com."""
    return f"""thr AS (SELECT series_key, CASE WHEN coalesce(max(score) FILTER (WHERE scored), 0) <= {p.threshold}
    AND auto + {E} < {p.threshold} THEN auto ELSE {p.threshold} END AS threshold
  FROM com LEFT JOIN (SELECT series_key, greatest(0.10, least(0.50, {p.threshold}, quantile_cont(score, 0.7))) AS auto FROM com
    WHERE scored AND rn % greatest(1, n // 500) = 0 GROUP BY 1) USING (series_key) GROUP BY series_key, auto)"""


def breakouts(p: Params) -> list[str]:
    z = f"{p.steepness} * (strength - {p.min_expansion} - {p.logistic_threshold})"
    return [
        f"zon AS (SELECT * FROM com WHERE scored AND score > {p.threshold})",
        f"""act0 AS (SELECT b.series_key, b.rn, z.rn - 1 AS zone_end, z.divergence_signal, z.divergence, z.divergence_confidence,
  b.sutte_direction, b.sutte_conviction, z.zone_high - z.zone_low AS width,
  CASE WHEN b.close > z.zone_high THEN 1 WHEN b.close < z.zone_low THEN -1 END AS direction,
  (1 + CASE WHEN b.close > z.zone_high THEN b.close - z.zone_high ELSE z.zone_low - b.close END / nullif(z.zone_high - z.zone_low, 0))
    * greatest(b.recent_vol / (z.past_vol + {E}), 0)
    * (1 + 0.35 * (z.score + z.c_attention + z.c_periodic + z.c_scale) / 4) AS strength
  FROM zon z JOIN (SELECT *, avg(hl_range_pct) {over(-10, -1)} AS recent_vol FROM feat) b
  ON b.series_key = z.series_key AND b.rn BETWEEN z.rn
    AND z.rn - 1 + greatest(5, least({p.max_hold}, round_even(1.5 * z.lookback, 0)::BIGINT)))""",
        f"""act AS (SELECT series_key, rn, zone_end, CASE WHEN ok THEN direction END AS direction, CASE WHEN ok THEN
  least(greatest(1 / (1 + exp(-({z})))
    * CASE WHEN rn + 1 < 10 OR sutte_direction = 0 OR sutte_conviction IS NULL THEN 1
        WHEN sutte_direction = direction THEN 1 + sutte_conviction * 0.3 ELSE 1 - sutte_conviction * 0.5 END
    * CASE WHEN divergence_signal = 'NEUTRAL' OR divergence_confidence <= 0 THEN 1
        WHEN sign(divergence) = direction THEN 1 + divergence_confidence * 0.15 ELSE 1 - divergence_confidence * 0.25 END, 0), 1)
  END AS probability FROM (SELECT *, coalesce(width > 0 AND direction IS NOT NULL AND strength >= {p.min_expansion}, false) AS ok FROM act0))""",
        """sgn AS (SELECT f.series_key, f.ts, f.rn, f.n, f.close, coalesce(a.probability, 0) AS probability, coalesce(a.direction, 0) AS direction
  FROM feat f LEFT JOIN (SELECT series_key, rn, max(probability) AS probability,
    arg_max(direction, zone_end) FILTER (WHERE probability > 0.5) AS direction FROM act GROUP BY ALL) a USING (series_key, rn))""",
    ]


def _against(p: Params) -> str:
    """out: bars of lbr1 (series_key, rn, the bar, its zone) against that zone."""
    z = f"{p.steepness} * (strength - {p.min_expansion} - {p.logistic_threshold})"
    return f"""lbr2 AS (SELECT *, CASE WHEN close > hi THEN 1 WHEN close < lo THEN -1 END AS side,
  (1 + CASE WHEN close > hi THEN close - hi ELSE lo - close END / nullif(hi - lo, 0))
    * greatest(CASE WHEN recent > 0 THEN recent WHEN vol > 0 THEN vol ELSE {E} END / (vol + {E}), 0)
    * (1 + 0.35 * (score + c_attention + c_periodic + c_scale) / 4) AS strength FROM lbr1),
lbr3 AS (SELECT series_key, rn, zone_end, side, CASE WHEN coalesce(hi > lo AND side IS NOT NULL AND strength >= {p.min_expansion} AND rn > zone_end, false) THEN
  least(greatest(1 / (1 + exp(-({z})))
    * CASE WHEN rn + 1 < 10 OR sutte_direction = 0 OR sutte_conviction IS NULL THEN 1
        WHEN sutte_direction = side THEN 1 + sutte_conviction * 0.3 ELSE 1 - sutte_conviction * 0.5 END
    * CASE WHEN divergence_signal = 'NEUTRAL' OR divergence_confidence <= 0 THEN 1
        WHEN sign(divergence) = side THEN 1 + divergence_confidence * 0.15 ELSE 1 - divergence_confidence * 0.25 END, 0), 1) ELSE 0 END AS probability
  FROM lbr2),
out AS (SELECT series_key, rn, zone_end, probability, CASE WHEN probability > 0.5 THEN side ELSE 0 END AS direction FROM lbr3)"""


ZONE_OF_BAR = """z.rn - 1 AS zone_end, z.zone_high AS hi, z.zone_low AS lo, z.past_vol AS vol, z.divergence_signal, z.divergence,
  z.divergence_confidence, z.score, z.c_attention, z.c_periodic, z.c_scale"""


def latest_breakout(p: Params) -> str:
    """out: the last bar of each series against the last zone before it; needs com and feat."""
    return f"""lbr0 AS (SELECT series_key, max(rn) AS zone_row FROM com WHERE scored AND score > {p.threshold} GROUP BY 1),
lbr1 AS (SELECT b.series_key, b.rn, b.close, b.sutte_direction, b.sutte_conviction, b.recent, {ZONE_OF_BAR}
  FROM (SELECT *, avg(hl_range_pct) {over(-10, -1)} AS recent FROM feat) b JOIN lbr0 USING (series_key)
  JOIN com z ON z.series_key = b.series_key AND z.rn = zone_row WHERE b.rn = b.n - 1),
{_against(p)}"""


def live_breakouts(p: Params) -> str:
    """out: every bar against the last zone that had enough bars ahead by then; needs com (without the gate) and feat."""
    return f"""lbr0 AS (SELECT series_key, rn, avg(hl_range_pct) {over(-10, -1)} AS recent,
  last_value(CASE WHEN scored AND score > {p.threshold} AND {p.lookforward} >= {p.min_bars} THEN rn END IGNORE NULLS)
    OVER (PARTITION BY series_key ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND {max(p.min_bars, 1) - 1} PRECEDING) AS zone_row FROM com),
lbr1 AS (SELECT b.series_key, b.rn, b.close, b.sutte_direction, b.sutte_conviction, l.recent, {ZONE_OF_BAR}
  FROM feat b JOIN lbr0 l USING (series_key, rn) LEFT JOIN com z ON z.series_key = b.series_key AND z.rn = l.zone_row),
{_against(p)}"""


def folds(p: Params) -> list[str]:
    """Renames feat to whole, deals it into folds as feat; signals follow as for whole series."""
    k, m = CV_SPLITS, CV_TRAIN_MULTIPLIER
    return [
        f"""tar AS (SELECT *, lead(close, {p.max_hold}) {ROW} / close - 1 AS future_return FROM whole)""",
        f"""feat AS (SELECT t.* EXCLUDE (series_key, rn, n), series_key || '#' || fold AS series_key, rn - fold * (n // {k + m}) AS rn,
  CASE WHEN fold = {k - 1} THEN n ELSE (fold + 1) * (n // {k + m}) + n - (n // {k + m}) * {k} END - fold * (n // {k + m}) AS n,
  series_key AS origin, fold, rn AS old_rn, sign(future_return)::INT AS target,
  rn >= fold * (n // {k + m}) + n - (n // {k + m}) * {k} AS validation
  FROM tar t CROSS JOIN generate_series(0, {k - 1}) AS g(fold)
  WHERE n > {k + m} AND rn >= fold * (n // {k + m})
    AND rn < CASE WHEN fold = {k - 1} THEN n ELSE (fold + 1) * (n // {k + m}) + n - (n // {k + m}) * {k} END)""",
    ]


def fold_signals(p: Params, width: str, key: str | None = None) -> list[str]:
    chain = features(width, key, everything=False)
    chain[-1] = chain[-1].replace("feat AS", "whole AS", 1)
    return [
        *chain,
        *folds(p),
        *scored(p),
        *breakouts(p),
        f"""tol AS (SELECT s.*, f.origin, f.fold, f.old_rn, f.future_return, f.target,
  CASE WHEN s.rn + {p.max_hold} < s.n THEN f.target END AS fold_target,
  CASE WHEN s.direction > 0 THEN s.probability WHEN s.direction < 0 THEN 1 - s.probability ELSE 0.5 END AS up_probability
  FROM sgn s JOIN feat f USING (series_key, rn) WHERE f.validation)""",
    ]


def fold_metrics(p: Params, width: str, key: str | None = None) -> list[str]:
    def f1(a: str, hit: str) -> str:
        tp = f"count(*) FILTER (WHERE direction = {a} AND fold_target = {a})"
        return f"coalesce({hit} * {tp} / nullif({hit} * {tp} + count(*) FILTER (WHERE direction = -({a}) AND fold_target = {a}) + count(*) FILTER (WHERE direction = {a} AND fold_target = -({a})), 0), 0)"

    n = "count(*) FILTER (WHERE direction <> 0 AND fold_target = {})"
    up, down = n.format("1"), n.format("-1")

    def precision(a: str) -> str:
        return f"coalesce(count(*) FILTER (WHERE direction = {a} AND fold_target = {a}) / nullif(count(*) FILTER (WHERE direction = {a}), 0), 0)"

    gain = "direction * future_return"
    return [
        *fold_signals(p, width, key),
        f"""fom AS (SELECT origin, fold, count(*) AS labelled, avg((up_probability - (fold_target = 1)::INT) ** 2) AS brier,
  avg((direction <> 0)::INT) AS coverage,
  coalesce(avg((direction = fold_target)::INT) FILTER (WHERE direction <> 0), 0) AS answered_accuracy,
  coalesce(({up} * {f1("1", "2")} + {down} * {f1("-1", "2")}) / nullif({up} + {down}, 0), 0) AS active_f1,
  coalesce(({up} * {precision("1")} + {down} * {precision("-1")}) / nullif({up} + {down}, 0), 0) AS active_precision,
  coalesce(avg({gain}) FILTER (WHERE direction <> 0) / (stddev_samp({gain}) FILTER (WHERE direction <> 0) + {E}) * sqrt(252), 0) AS active_sharpe
  FROM tol WHERE fold_target IN (-1, 1) GROUP BY ALL)""",
    ]


def select(steps: list[str], source: str, columns: list[str], doubles: list[str], where: str = "true") -> str:
    """The query: keys as they are, doubles rounded to six digits."""
    out = ", ".join([*columns, *[f"round({c}::DOUBLE, 6) + 0.0 AS {c}" for c in doubles]])
    return "WITH " + ",\n".join(steps) + f"\nSELECT {out} FROM {source} WHERE {where}"


