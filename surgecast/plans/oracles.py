"""DuckDB SQL for every query with an oracle. Built from small SQL fragments
that mirror the same table mapping as ``catalog``."""

from __future__ import annotations

from .oracle_trees import model_rows, trees_ctes

DP = 6


def r(expr: str) -> str:
    """Doubles are compared at 6 places (plus 0.0, so -0.0 and 0.0 are alike)."""
    return f"(round(CAST({expr} AS DOUBLE), {DP}) + 0.0)"


def r4(expr: str) -> str:
    """What a search for a maximum finds is compared at 4 places."""
    return f"(round(CAST({expr} AS DOUBLE), 4) + 0.0)"


# Values of their own, not read from the code under test.
SEASON = {"H": 24, "D": 7}
Z99 = "2.3558409670159173"
KS_FACTOR = "1.3581015157406195"
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0)
PERSONAL = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "credit_card": r"\b(?:\d{4}[ -]){3}\d{4}\b",
    "phone": r"\b(?:\+?\d{1,2}[\s.-]?)?\(?\d{3}\)?[\s.-]\d{3}[\s.-]\d{4}\b",
}


def MIN_TS(tbl):
    """Lower time bound per table: the 2009 cleaning bound for event data, the
    TPC-H calendar start for the order tables."""
    return "TIMESTAMP '1992-01-01 00:00:00'" if tbl in ("orders", "lineitem") else "TIMESTAMP '2009-01-01 00:00:00'"
TRUNC = {"H": "hour", "D": "day"}
INTERVAL = {"H": "INTERVAL 1 HOUR", "D": "INTERVAL 1 DAY"}


def demand_cte(name, tbl, ts, keys, gran, as_of=None, min_ts=None):
    k = ", ".join(keys)
    kc = (k + ", ") if keys else ""
    bound = f" AND {ts} <= TIMESTAMP '{as_of}'" if as_of else ""
    on = " AND ".join([f"c.{x} IS NOT DISTINCT FROM a.{x}" for x in keys] + ["c.TimePeriod = a.TimePeriod"])
    return f"""{name}_agg AS (
  SELECT {kc}date_trunc('{TRUNC[gran]}', {ts}) AS TimePeriod, count(*) AS Volume
  FROM {tbl} WHERE {ts} IS NOT NULL AND {ts} >= {min_ts or MIN_TS(tbl)}{bound} GROUP BY ALL),
{name}_b AS (SELECT {kc}min(TimePeriod) AS lo, max(TimePeriod) AS hi FROM {name}_agg GROUP BY ALL),
{name}_cal AS (SELECT {kc}unnest(generate_series(lo, hi, {INTERVAL[gran]})) AS TimePeriod FROM {name}_b),
{name} AS (
  SELECT {''.join(f'c.{x}, ' for x in keys)}c.TimePeriod, CAST(coalesce(a.Volume, 0) AS BIGINT) AS Volume
  FROM {name}_cal c LEFT JOIN {name}_agg a ON {on})"""


def calendar_sql(gran, ts="TimePeriod", raw=False):
    parts = []
    if gran == "H":
        if raw:
            parts.append(f"CAST(hour({ts}) AS INTEGER) AS Hour")
        parts += [f"{r(f'sin(2*pi()*hour({ts})/24)')} AS Sin_Hour", f"{r(f'cos(2*pi()*hour({ts})/24)')} AS Cos_Hour"]
    if raw:
        parts.append(f"CAST(isodow({ts}) - 1 AS INTEGER) AS DayOfWeek")
    parts += [f"{r(f'sin(2*pi()*(isodow({ts})-1)/7)')} AS Sin_DayOfWeek",
              f"{r(f'cos(2*pi()*(isodow({ts})-1)/7)')} AS Cos_DayOfWeek"]
    if raw:
        parts.append(f"CAST(weekofyear({ts}) AS DOUBLE) AS WeekOfYear")
    parts += [f"{r(f'sin(2*pi()*weekofyear({ts})/52)')} AS Sin_WeekOfYear",
              f"{r(f'cos(2*pi()*weekofyear({ts})/52)')} AS Cos_WeekOfYear"]
    return ", ".join(parts)


def part(keys):
    return ("PARTITION BY " + ", ".join(keys) + " ") if keys else ""


def past_only_sql(src, keys, gran, extra_cols=""):
    S = SEASON[gran]
    kc = "".join(f"{x}, " for x in keys)
    V = "CAST(Volume AS DOUBLE)"
    return f"""SELECT {kc}TimePeriod, Volume,
  lag({V}, 1) OVER w AS Lag1, lag({V}, {S}) OVER w AS LagS,
  lag({V}, 1) OVER w - lag({V}, 2) OVER w AS PrevDelta1,
  lag({V}, 1) OVER w - lag({V}, {S + 1}) OVER w AS PrevDeltaS,
  CASE WHEN count({V}) OVER w2 = {S} THEN avg({V}) OVER w2 END AS RollMean,
  CASE WHEN count({V}) OVER w2 = {S} THEN stddev_samp({V}) OVER w2 END AS RollStd{extra_cols}
FROM {src}
WINDOW w AS ({part(keys)}ORDER BY TimePeriod),
       w2 AS ({part(keys)}ORDER BY TimePeriod ROWS BETWEEN {S} PRECEDING AND 1 PRECEDING)"""


def ema_sql(span, keys, V="CAST(Volume AS DOUBLE)"):
    """adjust=True EMA: Horner over all earlier values / closed-form weight sum."""
    q = 1.0 - 2.0 / (span + 1.0)
    num = f"list_reduce(list({V}) OVER ({part(keys)}ORDER BY TimePeriod ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), lambda acc, x: acc * {q!r} + x)"
    den = f"((1 - pow({q!r}, row_number() OVER ({part(keys)}ORDER BY TimePeriod))) / {1 - q!r})"
    return f"{num} / {den}"


def nowcast_sql(src, keys, gran, lags, rolling, spans, calendar=True, regime=True, dropna=False):
    kc = "".join(f"{x}, " for x in keys)
    V = "CAST(Volume AS DOUBLE)"
    cols = []
    for n in lags:
        cols += [f"lag({V}, {n}) OVER w AS Volume_Lag{n}", f"{V} - lag({V}, {n}) OVER w AS Volume_LagDelta{n}"]
    for n in rolling:
        fr = f"({part(keys)}ORDER BY TimePeriod ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        cols += [f"CASE WHEN count({V}) OVER {fr} = {n} THEN avg({V}) OVER {fr} END AS Volume_RollingMean{n}",
                 f"CASE WHEN count({V}) OVER {fr} = {n} THEN stddev_samp({V}) OVER {fr} END AS Volume_RollingStd{n}"]
    for s in spans:
        cols.append(f"{ema_sql(s, keys)} AS Volume_EMA{s}")
    inner = f"SELECT {kc}TimePeriod, Volume, {', '.join(cols)} FROM {src} WINDOW w AS ({part(keys)}ORDER BY TimePeriod)"
    names = ([f"Volume_Lag{n}" for n in lags for _ in (0,)] and
             [x for n in lags for x in (f"Volume_Lag{n}", f"Volume_LagDelta{n}")]) + \
        [x for n in rolling for x in (f"Volume_RollingMean{n}", f"Volume_RollingStd{n}")] + \
        [f"Volume_EMA{s}" for s in spans]
    outer = [f"{kc}TimePeriod", "Volume"] + [f"{r(x)} AS {x}" for x in names]
    if calendar:
        outer.append(calendar_sql(gran, raw=True))
    if regime:
        outer.append("CAST(1.0 AS DOUBLE) AS Regime_0, CAST(0.0 AS DOUBLE) AS Regime_1, CAST(0.0 AS DOUBLE) AS Regime_2")
    where = (" WHERE " + " AND ".join(f"{x} IS NOT NULL" for x in names)) if dropna and names else ""
    return f"SELECT {', '.join(outer)} FROM ({inner}) t{where}"




def _with(*ctes):
    return "WITH " + ",\n".join(ctes) + "\n"


FEATS = ("Lag1", "LagS", "PrevDelta1", "PrevDeltaS", "RollMean", "RollStd")
CAL = {"H": ("Sin_DayOfWeek", "Cos_DayOfWeek", "Sin_WeekOfYear", "Cos_WeekOfYear", "Sin_Hour", "Cos_Hour"),
       "D": ("Sin_DayOfWeek", "Cos_DayOfWeek", "Sin_WeekOfYear", "Cos_WeekOfYear")}
SPECS = {
    "events_panel": ("events", "ts", ["event_type"], "H"),
    "events_total": ("events", "ts", [], "H"),
    "orders_daily": ("orders", "o_orderdate", [], "D"),
    "orders_panel": ("orders", "o_orderdate", ["o_orderpriority"], "D"),
}


def cal_raw(gran, ts="TimePeriod"):
    """Unrounded calendar columns (for intermediate steps)."""
    parts = [f"sin(2*pi()*(isodow({ts})-1)/7) AS Sin_DayOfWeek", f"cos(2*pi()*(isodow({ts})-1)/7) AS Cos_DayOfWeek",
             f"sin(2*pi()*weekofyear({ts})/52) AS Sin_WeekOfYear", f"cos(2*pi()*weekofyear({ts})/52) AS Cos_WeekOfYear"]
    if gran == "H":
        parts += [f"sin(2*pi()*hour({ts})/24) AS Sin_Hour", f"cos(2*pi()*hour({ts})/24) AS Cos_Hour"]
    return ", " + ", ".join(parts)


def kc(keys):
    return "".join(f"{k}, " for k in keys)


def split_ctes(spec_name, p=""):
    """{p}d (demand), {p}tf (training frame), {p}sp (split + seasonal-naive prediction)."""
    tbl, ts, keys, gran = SPECS[spec_name]
    cols = FEATS + CAL[gran]
    notnull = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    return [
        demand_cte(f"{p}d", tbl, ts, keys, gran),
        f"{p}po AS ({past_only_sql(f'{p}d', keys, gran, cal_raw(gran))})",
        f"{p}tf AS (SELECT {kc(keys)}TimePeriod, {', '.join(cols)}, CAST(Volume AS DOUBLE) AS y FROM {p}po WHERE {notnull})",
        f"""{p}sp0 AS (SELECT *, count(*) OVER ({part(keys)}) AS n_rows,
              row_number() OVER ({part(keys)}ORDER BY TimePeriod) AS rn FROM {p}tf)""",
        f"""{p}sp AS (SELECT *, CASE WHEN n_rows < 40 THEN 'insufficient_data'
              WHEN rn <= floor(n_rows * 0.8) THEN 'train' ELSE 'test' END AS role, LagS AS prediction FROM {p}sp0)""",
    ]


def resid_ctes(keys, role_filter):
    return [f"""res AS (SELECT {kc(keys)}TimePeriod, y, greatest(0, prediction) AS pred,
              y - greatest(0, prediction) AS resid FROM sp WHERE {role_filter})""",
            f"sig AS (SELECT {kc(keys)}stddev_pop(resid) AS resid_sigma FROM res GROUP BY ALL)"]


def var_sql(point, sigma):
    return f"greatest(0, greatest(0, {point}) + greatest({sigma}, 1e-9) * {Z99})"


def band_sql(point, sigma):
    v = var_sql(point, sigma)
    return (f"{r(f'round(greatest(0, {point}), 2)')} AS Point_Forecast, {r(f'round({v}, 2)')} AS Safety_Buffer_99, "
            f"CAST(ceil({v}) AS BIGINT) AS Capacity_Target")


def using(keys):
    return f" USING ({', '.join(keys)})" if keys else " ON TRUE"


def rcols(cols):
    return ", ".join(f"{r(c)} AS {c}" for c in cols)


def nxt_cte(keys, gran):
    return (f"nx AS (SELECT {kc(keys)}max(TimePeriod) + {INTERVAL[gran]} AS TimePeriod, CAST(NULL AS BIGINT) AS Volume "
            f"FROM d GROUP BY ALL)")


def next_step_ctes(keys, gran):
    return [nxt_cte(keys, gran), "u AS (SELECT * FROM d UNION ALL SELECT * FROM nx)",
            f"npo AS ({past_only_sql('u', keys, gran, cal_raw(gran))})",
            f"ns AS (SELECT npo.* EXCLUDE (Volume) FROM npo JOIN nx{using([*keys, 'TimePeriod'])})"]


def hour_sigma_ctes():
    keys = ["event_type"]
    return split_ctes("events_panel") + resid_ctes(keys, "role <> 'insufficient_data'") + [
        """hs AS (SELECT event_type, CAST(hour(TimePeriod) AS INTEGER) AS hour, count(*) AS n,
              stddev_pop(resid) AS s, count_if(NOT isfinite(resid)) AS bad FROM res GROUP BY ALL)""",
        """cs AS (SELECT hs.event_type, hour, n, CASE WHEN n >= 20 AND bad = 0 THEN greatest(s, 0.5)
              ELSE sig.resid_sigma END AS hour_sigma FROM hs LEFT JOIN sig USING (event_type))"""]


def lookup_ctes():
    """Versions from the holdout residuals (GARCH global sigma, per-hour sigmas
    with it as fallback), looked up for each series' next period."""
    return garch_ctes() + [
        """vh AS (SELECT event_type, CAST(hour(TimePeriod) AS INTEGER) AS hour, count(*) AS n,
              stddev_pop(resid) AS s, count_if(NOT isfinite(resid)) AS bad FROM res GROUP BY ALL)""",
        """vc AS (SELECT vh.event_type, hour, CASE WHEN n >= 6 AND bad = 0 THEN greatest(s, 0.5)
              ELSE gsig.garch_sigma END AS hour_sigma FROM vh LEFT JOIN gsig USING (event_type))""",
    ] + next_step_ctes(["event_type"], "H") + [
        """lk AS (SELECT ns.*, coalesce(round(vc.hour_sigma, 4), gsig.garch_sigma) AS sigma FROM ns
              LEFT JOIN vc ON vc.event_type = ns.event_type AND vc.hour = hour(ns.TimePeriod)
              LEFT JOIN gsig ON gsig.event_type = ns.event_type)"""]


def mae_cte(name, spec_name, role, pred, model_prefix, key):
    return (f"{name} AS (SELECT '{model_prefix}:' || {key} AS model, avg(abs(y - greatest(0, {pred}))) AS mae "
            f"FROM {spec_name}_sp WHERE role = '{role}' GROUP BY ALL)")


def shadow_log_ctes(came="d"):
    keys = ["event_type"]
    shifted = [] if came == "d" else [f"""{came} AS (SELECT event_type, TimePeriod, CASE WHEN event_type IN ('click', 'error')
              AND TimePeriod >= TIMESTAMP '2024-01-26 00:00:00' THEN Volume * 2 + 5 ELSE Volume END AS Volume FROM d)"""]
    return split_ctes("events_panel") + resid_ctes(keys, "role = 'test'") + next_step_ctes(keys, "H") + shifted + [
        f"""lg AS (SELECT event_type, TimePeriod, pred AS point, resid_sigma AS sigma FROM res JOIN sig USING (event_type)
              UNION ALL SELECT event_type, TimePeriod, LagS AS point, resid_sigma AS sigma FROM ns JOIN sig USING (event_type))""",
        f"""lgb AS (SELECT event_type, TimePeriod, round(greatest(0, point), 2) AS Point_Forecast,
              round({var_sql('point', 'sigma')}, 2) AS Safety_Buffer_99 FROM lg)""",
        f"""score AS (SELECT l.event_type, count(d.Volume) AS n_matured,
              round(avg(abs(CAST(d.Volume AS DOUBLE) - l.Point_Forecast)), 4) AS realised_mae,
              round(avg(CASE WHEN d.Volume IS NOT NULL THEN CAST(d.Volume <= l.Safety_Buffer_99 AS DOUBLE) END) * 100, 2)
                AS coverage_99
              FROM lgb l LEFT JOIN {came} d ON d.event_type = l.event_type AND d.TimePeriod = l.TimePeriod GROUP BY ALL)""",
        """base AS (SELECT event_type, round(avg(abs(y - greatest(0, prediction))), 6) AS baseline_mae
              FROM sp WHERE role = 'train' GROUP BY ALL)""",
        """drift AS (SELECT score.*, base.baseline_mae, coalesce(n_matured > 0 AND baseline_mae IS NOT NULL
              AND baseline_mae <> 0 AND realised_mae > baseline_mae * 1.15, false) AS drift_detected
              FROM score LEFT JOIN base USING (event_type))"""]


def requests_cte():
    return """req AS (SELECT event_id, user_id, ts,
  CASE WHEN event_type = 'error' THEN props
       ELSE concat(CAST(CAST(ts AS DATE) AS VARCHAR), 'T', lpad(CAST(hour(ts) AS VARCHAR), 2, '0')) END AS time_period,
  CASE event_type WHEN 'view' THEN 'd' WHEN 'click' THEN 'H' WHEN 'purchase' THEN 'D'
       WHEN 'signup' THEN 'DROP' ELSE 'h' END AS granularity,
  value / 100.0 AS confidence_level, value * 1000.0 AS point_forecast, value / 1000.0 AS latency_s FROM events),
val AS (SELECT *, CASE WHEN upper(granularity) IN ('D', 'H') THEN upper(granularity) END AS granularity_norm,
  CASE WHEN time_period IS NULL OR length(time_period) > 20 OR NOT regexp_matches(time_period, '^[0-9T:Z-]*$')
         THEN 'time_period'
       WHEN upper(granularity) IS NULL OR upper(granularity) NOT IN ('D', 'H') THEN 'granularity'
       WHEN confidence_level IS NULL OR isnan(confidence_level) OR NOT (confidence_level BETWEEN 0.5 AND 0.9999)
         THEN 'confidence_level' END AS reject_reason FROM req)"""


def pii_sql(tbl, cols):
    parts = [f"SELECT '{c}' AS column, '{p}' AS pattern, CAST(count_if(coalesce(regexp_matches({c}, '{pat}'), false)) AS BIGINT) AS n "
             f"FROM {tbl}" for c in cols for p, pat in PERSONAL.items()]
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE n > 0"


def drift_ctes():
    numeric = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value, CASE WHEN ts < TIMESTAMP '2024-01-24 00:00:00' "
        f"THEN 0 ELSE 1 END AS side FROM events WHERE ts IS NOT NULL" for c in ("value", "user_id", "event_id"))
    return [f"lf AS ({numeric})",
            """cnt AS (SELECT feature, value, count_if(side = 0) AS c_ref, count_if(side = 1) AS c_cur FROM lf
        WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY ALL)""",
            """cum AS (SELECT feature, sum(c_ref) OVER (PARTITION BY feature) AS N, sum(c_cur) OVER (PARTITION BY feature) AS M,
        sum(c_ref) OVER w AS cr, sum(c_cur) OVER w AS cc FROM cnt
        WINDOW w AS (PARTITION BY feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
            f"""ks AS (SELECT feature, 'numeric' AS kind, CAST(max(N) AS BIGINT) AS n_reference, CAST(max(M) AS BIGINT) AS n_current,
       max(abs(cr / N - cc / M)) AS statistic, {KS_FACTOR} * sqrt((max(N) + max(M)) / (max(N) * max(M))) AS threshold FROM cum GROUP BY ALL)""",
            """tc AS (SELECT event_type, count_if(ts < TIMESTAMP '2024-01-24 00:00:00') AS a, count_if(ts >= TIMESTAMP '2024-01-24 00:00:00') AS b
       FROM events WHERE event_type IS NOT NULL GROUP BY ALL)""",
            """tp AS (SELECT a, b, a / sum(a) OVER () AS p, b / sum(b) OVER () AS q FROM tc)""",
            """js AS (SELECT 'event_type' AS feature, 'categorical' AS kind, CAST(sum(a) AS BIGINT) AS n_reference, CAST(sum(b) AS BIGINT) AS n_current,
       sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END
                       + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 0)) AS statistic, 0.1 AS threshold FROM tp)""",
            "dd AS (SELECT *, statistic > threshold AS drifted FROM (SELECT * FROM ks UNION ALL SELECT * FROM js))"]


def drift_sql():
    return _with(*drift_ctes()) + f"""SELECT feature, kind, n_reference, n_current, {r('statistic')} AS statistic, {r('threshold')} AS threshold,
  drifted, CAST(NULL AS VARCHAR) AS reason, {r('avg(CAST(drifted AS DOUBLE)) OVER ()')} AS drift_share,
  avg(CAST(drifted AS DOUBLE)) OVER () >= 0.1 AS dataset_drift FROM dd"""


def drift_by_size_sql():
    """Earth-mover and Jensen-Shannon distance, Kolmogorov-Smirnov and chi-square."""
    z = "1.6448536269514722"
    free = "(2.0 / (9 * (count(*) - 1)))"
    return _with(*drift_ctes(), """full_cum AS (SELECT feature, value, c_ref, sum(c_ref) OVER (PARTITION BY feature) AS N, sum(c_cur) OVER (PARTITION BY feature) AS M,
        sum(c_ref) OVER w AS cr, sum(c_cur) OVER w AS cc, lead(value) OVER (PARTITION BY feature ORDER BY value) - value AS width FROM cnt
        WINDOW w AS (PARTITION BY feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
                 """em AS (SELECT feature, 'numeric' AS kind, CAST(max(N) AS BIGINT) AS n_reference, CAST(max(M) AS BIGINT) AS n_current, 'earth-mover' AS test,
        sum(abs(cr / N - cc / M) * coalesce(width, 0)) / sqrt(greatest(sum(value * value * c_ref) / max(N) - pow(sum(value * c_ref) / max(N), 2), 0)) AS statistic,
        0.1 AS threshold FROM full_cum GROUP BY feature)""",
                 f"""ch AS (SELECT 'event_type' AS feature, 'categorical' AS kind, CAST(sum(a) AS BIGINT) AS n_reference, CAST(sum(b) AS BIGINT) AS n_current, 'chi-square' AS test,
        sum(pow(a - e * ta, 2) / (e * ta) + pow(b - e * tb, 2) / (e * tb)) AS statistic, (count(*) - 1) * pow(1 - {free} + {z} * sqrt({free}), 3) AS threshold
        FROM (SELECT a, b, sum(a) OVER () AS ta, sum(b) OVER () AS tb, (a + b) / (sum(a) OVER () + sum(b) OVER ()) AS e FROM (SELECT a::DOUBLE AS a, b::DOUBLE AS b FROM tc)))""",
                 """two AS (SELECT 0 AS g, * FROM em UNION ALL BY NAME SELECT 0 AS g, feature, kind, n_reference, n_current, 'jensen-shannon' AS test, statistic, threshold FROM js
        UNION ALL BY NAME SELECT 1 AS g, feature, kind, n_reference, n_current, 'ks' AS test, statistic, threshold FROM ks UNION ALL BY NAME SELECT 1 AS g, * FROM ch)""",
                 "dz AS (SELECT *, statistic > threshold AS drifted FROM two)") + f"""
SELECT feature, kind, n_reference, n_current, test, {r('statistic')} AS statistic, {r('threshold')} AS threshold, drifted, CAST(NULL AS VARCHAR) AS reason,
  {r('avg(CAST(drifted AS DOUBLE)) OVER (PARTITION BY g)')} AS drift_share, avg(CAST(drifted AS DOUBLE)) OVER (PARTITION BY g) >= 0.1 AS dataset_drift FROM dz"""


def drift_summary_sql():
    return _with(*drift_ctes(), *split_ctes("events_panel")) + f"""SELECT {r('round(share, 4)')} AS drift_share, share >= 0.1 AS data_drift_detected,
  {r('round(deg, 4)')} AS mae_degradation, deg > 0.15 AS concept_drift_detected, share >= 0.1 OR deg > 0.15 AS drift_detected,
  CAST(NULL AS VARCHAR) AS reason
FROM (SELECT avg(CAST(drifted AS DOUBLE)) AS share FROM dd),
     (SELECT (cur - ref) / (ref + 1e-9) AS deg FROM (SELECT
        avg(CASE WHEN role = 'train' THEN abs(y - greatest(0, prediction)) END) AS ref,
        avg(CASE WHEN role = 'test' THEN abs(y - greatest(0, prediction)) END) AS cur FROM sp WHERE role <> 'insufficient_data'))"""


def latency_sql():
    return _with(requests_cte()) + (f"SELECT coalesce(granularity_norm, 'invalid') AS granularity, count(latency_s) AS n, "
                                    f"{r('quantile_cont(latency_s, 0.99)')} AS p99 FROM val GROUP BY ALL")


def windowed_sql():
    """Every minute's P99 of the five minutes before it, from the cumulative buckets."""
    les = ", ".join(f"({b!r}::DOUBLE)" for b in BUCKETS)
    return _with(requests_cte(), """w AS (SELECT coalesce(granularity_norm, 'invalid') AS granularity, latency_s AS l,
  unnest(generate_series(date_trunc('minute', ts) + INTERVAL 1 MINUTE, date_trunc('minute', ts) + INTERVAL 5 MINUTE, INTERVAL 1 MINUTE)) AS until
  FROM val WHERE latency_s IS NOT NULL AND ts IS NOT NULL)""",
                 "t AS (SELECT granularity, until, count(*) AS n FROM w GROUP BY ALL)",
                 f"b AS (SELECT granularity, until, le, count_if(l <= le) AS c FROM w CROSS JOIN (VALUES {les}) x(le) GROUP BY ALL)",
                 "f AS (SELECT *, lag(c, 1, 0) OVER p AS pc, lag(le, 1, 0.0) OVER p AS pl FROM b WINDOW p AS (PARTITION BY granularity, until ORDER BY le))",
                 """hit AS (SELECT f.granularity, f.until, pl + (le - pl) * (0.99 * n - pc) / (c - pc) AS v FROM f JOIN t ON t.granularity = f.granularity AND t.until = f.until
  WHERE c >= 0.99 * n QUALIFY row_number() OVER (PARTITION BY f.granularity, f.until ORDER BY le) = 1)""") + \
        f"SELECT granularity, until, {r('n / 300.0')} AS rate, {r(f'coalesce(v, {BUCKETS[-1]})')} AS p99 FROM t LEFT JOIN hit USING (granularity, until)"


def late_sql():
    """Events by quarter of their time, every tenth a quarter late; late is what is older
    than the furthest event of the quarters before, less an hour."""
    return _with("x AS (SELECT min(epoch_us(ts)) AS lo, (max(epoch_us(ts)) - min(epoch_us(ts))) // 4 + 1 AS step FROM events)",
                 """a AS (SELECT event_type, ts, least((epoch_us(ts) - lo) // step + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END, 3) AS come FROM events, x)""",
                 "m AS (SELECT come, max(ts) AS reach FROM a GROUP BY come)",
                 "k AS (SELECT come, max(reach) OVER (ORDER BY come ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM m)") + """
SELECT event_type, date_trunc('hour', ts) AS TimePeriod, count(*) AS Volume, CAST(count_if(coalesce(ts < seen - INTERVAL 1 HOUR, false)) AS BIGINT) AS n_late
FROM a JOIN k USING (come) GROUP BY ALL"""


def histogram_sql():
    les = ", ".join(f"({b!r})" for b in BUCKETS) + ", ('inf'::DOUBLE)"
    return _with(requests_cte()) + f"""SELECT coalesce(granularity_norm, 'invalid') AS granularity, CAST(le AS DOUBLE) AS le,
  CAST(count_if(latency_s <= le) AS BIGINT) AS n_cumulative FROM val CROSS JOIN (VALUES {les}) t(le) GROUP BY ALL"""


#: A search by ever finer patterns, several rounds of each: no gradient, no blocks.
GARCH_STEPS = [(h, 1 + (20 if h > 1e-4 else 4) * h) for h in (0.02, 0.008, 0.003, 0.001, 4e-4, 1.5e-4, 5e-5, 2e-5, 7e-6, 2e-6, 7e-7, 2e-7, 7e-8)
               for _ in range(8)]


def garch_ctes(before=None):
    """GARCH(1,1) of ``res (event_type, TimePeriod, resid)`` with ``sig`` as fallback, which
    ``before`` makes (the residuals of the seasonal-naive forecast if none)."""
    before = split_ctes("events_panel") + resid_ctes(["event_type"], "role = 'test'") if before is None else before
    return before + _garch()


def _garch():
    """GARCH(1,1) search as recursive CTEs (one row per series x grid point x step):
    another way to the greatest likelihood, over the whole alpha + beta < 1."""
    def rec(name, grid):
        om = "ok.v0 * r.f * (1 - r.a - r.b)"
        return f"""{name} AS (
  SELECT g.event_type, g.sb, g.a, g.b, g.f, 0 AS t, ok.v0 AS s2, CAST(0.0 AS DOUBLE) AS ll, ok.v0 AS pe2
  FROM {grid} g JOIN ok USING (event_type)
  UNION ALL
  SELECT r.event_type, r.sb, r.a, r.b, r.f, r.t + 1, {om} + r.a * r.pe2 + r.b * r.s2,
    r.ll - 0.5 * (ln({om} + r.a * r.pe2 + r.b * r.s2) + e.e * e.e / ({om} + r.a * r.pe2 + r.b * r.s2)), e.e * e.e
  FROM {name} r JOIN e ON e.event_type = r.event_type AND e.t = r.t + 1 JOIN ok ON ok.event_type = r.event_type)"""

    rank = "[ll, -b, -a, -f]"

    def best(name, run):
        cols = ", ".join(f"arg_max({c}, {rank}) AS {c}" for c in ("a", "b", "f", "s2", "pe2"))
        return (f"{name} AS (SELECT event_type, sb, {cols}, max(ll) AS top, arg_max(ll, {rank}) AS ll "
                f"FROM {run} JOIN (SELECT event_type, n_resid FROM ok) n USING (event_type) WHERE t = n_resid GROUP BY ALL)")

    ctes = [
        """st AS (SELECT event_type, count(*) AS n_resid, avg(resid) AS mu,
              count_if(NOT isfinite(resid)) AS bad FROM res GROUP BY ALL)""",
        """e AS (SELECT r.event_type, CAST(row_number() OVER (PARTITION BY r.event_type ORDER BY r.TimePeriod) AS INTEGER) AS t,
              r.resid - st.mu AS e FROM res r JOIN st USING (event_type))""",
        """v AS (SELECT event_type, list_reduce(list(e * e ORDER BY t), lambda acc, x: acc + x, CAST(0.0 AS DOUBLE))
              / count(*) AS v0 FROM e GROUP BY ALL)""",
        """ok AS (SELECT st.event_type, n_resid, v0 FROM st JOIN v USING (event_type)
              WHERE n_resid >= 30 AND bad = 0 AND v0 > 0)""",
        # the best start of each third of beta goes its own way
        """g0 AS (SELECT ok.event_type, CASE WHEN b < 0.3 THEN 0 WHEN b < 0.7 THEN 1 ELSE 2 END + CASE WHEN a < 0.01 THEN 3 ELSE 0 END AS sb, a, b, CAST(1.0 AS DOUBLE) AS f FROM ok,
              unnest([0.006::DOUBLE, 0.02, 0.06, 0.12, 0.25, 0.5, 0.8]) ta(a), unnest([0.0::DOUBLE, 0.2, 0.4, 0.6, 0.75, 0.85, 0.92, 0.97]) tb(b) WHERE a + b < 1)""",
        rec("r0", "g0"), best("b0", "r0")]
    for k, (h, q) in enumerate(GARCH_STEPS, 1):
        das = ", ".join(f"(CAST({i * h!r} AS DOUBLE))" for i in (-2, -1, 0, 1, 2))
        fs = ", ".join(f"(CAST({m!r} AS DOUBLE))" for m in (1 / q, 1.0, q))
        ctes += [f"""g{k} AS (SELECT DISTINCT event_type, sb, greatest(a + da, 0.0) AS a, greatest(b + db, 0.0) AS b, f * m AS f
              FROM b{k - 1}, (VALUES {das}) x(da), (VALUES {das}) y(db), (VALUES {fs}) z(m)
              WHERE greatest(a + da, 0.0) + greatest(b + db, 0.0) < 0.9999)""", rec(f"r{k}", f"g{k}"), best(f"b{k}", f"r{k}")]
    ctes.append(f"bw AS (SELECT w.* FROM b{len(GARCH_STEPS)} w JOIN ok USING (event_type) QUALIFY row_number() OVER (PARTITION BY event_type "
                "ORDER BY CASE WHEN a < 0.001 THEN -0.5 * ok.n_resid * (ln(ok.v0) + 1) ELSE ll END DESC, sb) = 1)")
    last = "bw"
    ctes.append(f"""fit AS (SELECT w.event_type, CASE WHEN a >= 0.001 THEN a ELSE 0 END AS alpha, CASE WHEN a >= 0.001 THEN b ELSE 0 END AS beta,
              CASE WHEN a >= 0.001 THEN ok.v0 * f * (1 - a - b) ELSE ok.v0 END AS omega, CASE WHEN a >= 0.001 THEN ll ELSE -0.5 * ok.n_resid * (ln(ok.v0) + 1) END AS loglik,
              CASE WHEN a >= 0.001 THEN sqrt(ok.v0 * f * (1 - a - b) + a * pe2 + b * s2) ELSE sqrt(ok.v0) END AS gs FROM {last} w JOIN ok USING (event_type))""")
    good = "fit.gs IS NOT NULL AND isfinite(fit.gs) AND fit.gs > 0"
    ctes.append(f"""gsig AS (SELECT st.event_type, st.n_resid, fit.alpha, fit.beta, fit.omega, fit.loglik,
  CASE WHEN {good} THEN fit.gs ELSE sig.resid_sigma END AS garch_sigma,
  CASE WHEN {good} THEN 'garch' ELSE 'fallback' END AS sigma_source
  FROM st LEFT JOIN fit USING (event_type) LEFT JOIN sig USING (event_type))""")
    return ctes


def garch_sql():
    return "WITH RECURSIVE " + _with(*garch_ctes())[len("WITH "):] + f"""SELECT event_type, n_resid,
  {r4('alpha')} AS alpha, {r4('beta')} AS beta, {r4('omega')} AS omega, {r4('loglik')} AS loglik,
  {r4('garch_sigma')} AS garch_sigma, sigma_source FROM gsig"""


def backtest_garch_sql():
    return "WITH RECURSIVE " + _with(*garch_ctes())[len("WITH "):] + f"""
SELECT event_type, count(*) AS n, {r('avg(abs(resid))')} AS mae, {r('avg(abs(resid) / greatest(y, 1.0)) * 100')} AS mape,
  {r(f"avg(CAST(y <= {var_sql('pred', 'garch_sigma')} AS DOUBLE)) * 100")} AS coverage, {r4('first(garch_sigma)')} AS sigma
FROM res JOIN gsig USING (event_type) GROUP BY event_type"""


PANEL_FEATURES = FEATS + CAL["H"]
HELD = "(SELECT * FROM sp WHERE role <> 'insufficient_data')"
SMALL = "CASE WHEN m = 0 AND (SELECT count(*) FROM sp) < 200 THEN 15 ELSE 31 END"


def _recursive(*ctes):
    return "WITH RECURSIVE " + _with(*ctes)[len("WITH "):]


def trees_forecast_sql():
    """The trees, fitted in SQL, against the seasonal-naive forecast on the same tail."""
    return _recursive(*split_ctes("events_panel"), *model_rows("mr", [(0, HELD, "role = 'train'")], ["event_type"], PANEL_FEATURES),
                      *trees_ctes("mr", "tp", 300, 15, SMALL),
                      "t AS (SELECT event_type, TimePeriod, y, tp.prediction AS p, LagS AS naive FROM tp JOIN mr USING (m, id))") + f"""
SELECT event_type, TimePeriod, {r('y')} AS y, {r('p')} AS prediction, {r('naive')} AS naive,
  {r('avg(abs(y - greatest(0, p))) OVER w')} AS model_mae, {r('avg(abs(y - greatest(0, naive))) OVER w')} AS naive_mae,
  avg(abs(y - greatest(0, p))) OVER w < avg(abs(y - greatest(0, naive))) OVER w AS beats_naive
FROM t WINDOW w AS (PARTITION BY event_type)"""


def trees_next_sql():
    """Two fits: on the training rows for the sigmas of the tail, on all for the forecast."""
    ctes = split_ctes("events_panel") + next_step_ctes(["event_type"], "H") + model_rows(
        "mr", [(0, HELD, "role = 'train'"), (1, "sp", "true"), (1, "(SELECT *, CAST(NULL AS DOUBLE) AS y FROM ns)", "false")], ["event_type"], PANEL_FEATURES)
    ctes += trees_ctes("mr", "tp", 300, 15, SMALL) + [
        "res AS (SELECT event_type, TimePeriod, y, y - tp.prediction AS resid FROM tp JOIN mr USING (m, id) WHERE m = 0)",
        "sig AS (SELECT event_type, stddev_pop(resid) AS resid_sigma FROM res GROUP BY ALL)"]
    return _recursive(*garch_ctes(ctes), "vs AS (SELECT event_type, CASE WHEN garch_sigma > 0 THEN garch_sigma ELSE 0.21 END AS g FROM gsig)",
                      """vh AS (SELECT res.event_type, CAST(hour(TimePeriod) AS INTEGER) AS hour,
              CASE WHEN count(*) >= 20 AND count_if(NOT isfinite(resid)) = 0 THEN greatest(stddev_pop(resid), 0.5) ELSE any_value(g) END AS s
              FROM res JOIN vs USING (event_type) GROUP BY ALL)""",
                      """lk AS (SELECT mr.event_type, mr.TimePeriod, tp.prediction AS point, coalesce(round(vh.s, 4), vs.g) AS sigma FROM tp JOIN mr USING (m, id)
              JOIN vs ON vs.event_type = mr.event_type LEFT JOIN vh ON vh.event_type = mr.event_type AND vh.hour = hour(mr.TimePeriod) WHERE m = 1)""") + \
        f"SELECT event_type, TimePeriod, {band_sql('point', 'sigma')} FROM lk"


def trees_nowcast_sql():
    """Two fits of the daily nowcast: the tail gives the sigma, all rows the latest point."""
    feats = ", ".join(FV_D)
    ctes = [demand_cte("d", "orders", "o_orderdate", [], "D"),
            f"nf AS (SELECT TimePeriod, CAST(Volume AS DOUBLE) AS y, {feats} FROM ({nowcast_sql('d', [], 'D', *NOWCAST_D, dropna=True)}))",
            "sp AS (SELECT *, row_number() OVER (ORDER BY TimePeriod) AS rn, count(*) OVER () AS n FROM nf)",
            *model_rows("mr", [(0, "sp", "rn <= floor(n * 0.8)"), (1, "sp", "true"), (1, "(SELECT * FROM sp WHERE rn = n)", "false")], [], FV_D),
            *trees_ctes("mr", "tp", 100, 20, SMALL),
            "res AS (SELECT 'all' AS event_type, TimePeriod, y, y - tp.prediction AS resid FROM tp JOIN mr USING (m, id) WHERE m = 0)",
            "sig AS (SELECT event_type, stddev_pop(resid) AS resid_sigma FROM res GROUP BY ALL)"]
    return _recursive(*garch_ctes(ctes), "vs AS (SELECT CASE WHEN garch_sigma > 0 THEN garch_sigma ELSE 48.65 END AS sigma FROM gsig)",
                      "lk AS (SELECT mr.TimePeriod, tp.prediction AS point, sigma FROM tp JOIN mr USING (m, id), vs WHERE m = 1)") + \
        f"SELECT TimePeriod, {band_sql('point', 'sigma')} FROM lk"


NOWCAST_D = ((1, 7, 14, 28), (7, 14, 28), (7, 14, 28))
NOWCAST_H = ((1, 6, 12, 24), (6, 12, 24), (12, 24, 48))
FV_D = ("Volume_Lag1", "Volume_LagDelta1", "Volume_Lag7", "Volume_LagDelta7", "Sin_DayOfWeek", "Cos_DayOfWeek",
        "Sin_WeekOfYear", "Cos_WeekOfYear", "Regime_0", "Regime_1", "Regime_2")
FV_H = ("Volume_Lag1", "Volume_LagDelta1", "Volume_Lag6", "Volume_LagDelta6", "Volume_Lag12", "Volume_LagDelta12", "Volume_Lag24",
        "Volume_LagDelta24", "Sin_Hour", "Cos_Hour", "Regime_0", "Regime_1", "Regime_2")


def _orc():
    ev_p = demand_cte("d", "events", "ts", ["event_type"], "H")
    od = demand_cte("d", "orders", "o_orderdate", [], "D")
    op = demand_cte("d", "orders", "o_orderdate", ["o_orderpriority"], "D")
    o = {}
    o["scan_raw"] = "SELECT event_id, ts, event_type FROM events"
    o["monthly_union"] = ("SELECT o_orderdate AS TimePeriod FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' "
                          "UNION ALL SELECT l_shipdate AS TimePeriod FROM lineitem "
                          "WHERE l_shipdate >= TIMESTAMP '1995-01-01'")
    o["coerce_timestamps"] = ("SELECT event_id, stamp FROM (SELECT event_id, try_cast(CASE WHEN event_type = 'error' "
                              "THEN props ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END AS TIMESTAMP) AS stamp FROM events) "
                              "WHERE stamp IS NOT NULL AND stamp >= TIMESTAMP '2009-01-01'")
    o["utc_normalize"] = ("SELECT event_id, ts FROM (SELECT event_id, timezone('UTC', timezone('America/New_York', ts)) "
                          "AS ts FROM events) WHERE ts IS NOT NULL AND ts >= TIMESTAMP '2009-01-01'")
    o["range_filter"] = ("SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2009-01-01' "
                         "AND ts <= TIMESTAMP '2024-01-20 12:00:00'")
    o["recent_window"] = _with(od) + ("SELECT TimePeriod, Volume FROM d WHERE TimePeriod >= "
                                      "TIMESTAMP '2001-08-01' - INTERVAL 7 DAY")
    o["asof_recent60"] = _with(op) + ("SELECT o_orderpriority, TimePeriod, Volume FROM d WHERE TimePeriod <= "
                                      "TIMESTAMP '2000-06-30' QUALIFY row_number() OVER (PARTITION BY o_orderpriority "
                                      "ORDER BY TimePeriod DESC) <= 60")
    o["demand_hourly"] = _with(demand_cte("d", "events", "ts", [], "H")) + "SELECT TimePeriod, Volume FROM d"
    o["demand_daily"] = _with(demand_cte("d", "lineitem", "l_shipdate", [], "D")) + "SELECT TimePeriod, Volume FROM d"
    o["demand_gapfilled"] = _with(ev_p) + "SELECT event_type, TimePeriod, Volume FROM d"
    o["rollup_consistency"] = _with(demand_cte("h", "events", "ts", ["event_type"], "H"),
                                    demand_cte("dd", "events", "ts", ["event_type"], "D")) + """
SELECT coalesce(h.event_type, dd.event_type) AS event_type, coalesce(h.TimePeriod, dd.TimePeriod) AS TimePeriod,
  h.hourly_sum, dd.Volume AS daily_volume, coalesce(h.hourly_sum, -1) = coalesce(dd.Volume, -2) AS consistent
FROM (SELECT event_type, date_trunc('day', TimePeriod) AS TimePeriod, CAST(sum(Volume) AS BIGINT) AS hourly_sum
      FROM h GROUP BY ALL) h FULL OUTER JOIN dd ON h.event_type = dd.event_type AND h.TimePeriod = dd.TimePeriod"""
    o["data_profile"] = _with(op) + ("SELECT o_orderpriority, count(*) AS n_rows, min(TimePeriod) AS first_period, "
                                     "max(TimePeriod) AS last_period FROM d GROUP BY ALL")
    o["lag_features"] = _with(od) + nowcast_sql("d", [], "D", NOWCAST_D[0], (), (), calendar=False, regime=False)
    o["rolling_features"] = _with(od) + nowcast_sql("d", [], "D", (), NOWCAST_D[1], (), calendar=False, regime=False)
    o["ema_features"] = _with(ev_p) + nowcast_sql("d", ["event_type"], "H", (), (), NOWCAST_H[2],
                                                   calendar=False, regime=False)
    o["cyclical_features"] = _with(demand_cte("d", "events", "ts", [], "H")) + \
        f"SELECT TimePeriod, Volume, {calendar_sql('H', raw=True)} FROM d"
    o["past_only_features"] = _with(ev_p) + "SELECT event_type, TimePeriod, Volume, " + rcols(FEATS) + ", " + \
        calendar_sql("H") + " FROM (" + past_only_sql("d", ["event_type"], "H") + ") p"
    tf_cols = FEATS + CAL["D"]
    o["training_frame"] = _with(*split_ctes("orders_daily")) + f"SELECT TimePeriod, {rcols(tf_cols)}, {r('y')} AS y FROM tf"
    o["holdout_split"] = _with(*split_ctes("orders_daily")) + \
        f"SELECT TimePeriod, {rcols(tf_cols)}, {r('y')} AS y, n_rows, rn, role FROM sp"
    o["next_step_features"] = _with(ev_p, *next_step_ctes(["event_type"], "H")) + \
        f"SELECT event_type, TimePeriod, {rcols(FEATS + CAL['H'])} FROM ns"
    o["nowcast_features"] = _with(od) + nowcast_sql("d", [], "D", *NOWCAST_D, dropna=True)
    o["nowcast_latest"] = _with(op) + "SELECT * FROM (" + nowcast_sql("d", ["o_orderpriority"], "D", *NOWCAST_D, dropna=True) + \
        ") QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY TimePeriod DESC) = 1"
    off = ("SELECT *, strftime(TimePeriod, '%Y-%m-%d') AS time_period, 'D' AS granularity, "
           "strftime(TimePeriod, '%Y-%m') AS month FROM (" + nowcast_sql("d", [], "D", *NOWCAST_D, dropna=True) + ")")
    o["offline_features"] = _with(od) + off
    o["feature_view_daily"] = _with(od) + f"SELECT TimePeriod, time_period, {', '.join(FV_D)} FROM ({off})"
    offh = ("SELECT *, strftime(TimePeriod, '%Y-%m-%dT%H') AS time_period FROM (" + nowcast_sql("d", ["event_type"], "H", *NOWCAST_H, dropna=True) + ")")
    o["feature_view_hourly"] = _with(ev_p) + f"SELECT event_type, TimePeriod, time_period, {', '.join(FV_H)} FROM ({offh})"
    o["null_key_features"] = ("WITH ev AS (SELECT ts, nullif(event_type, 'signup') AS event_type FROM events), " + demand_cte(
        "d", "ev", "ts", ["event_type"], "H", min_ts="TIMESTAMP '2009-01-01 00:00:00'") + " " +
        nowcast_sql("d", ["event_type"], "H", (1,), (), (12,), calendar=False, regime=False))
    o["online_latest"] = _with(ev_p) + "SELECT * FROM (" + nowcast_sql("d", ["event_type"], "H", *NOWCAST_H, dropna=True) + \
        ") WHERE TimePeriod > TIMESTAMP '2024-01-25 00:00:00' - INTERVAL 48 HOUR AND TimePeriod <= " \
        "TIMESTAMP '2024-01-25 00:00:00' QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY TimePeriod DESC) = 1"
    o["quality_violations"] = """SELECT event_type, count(*) AS n_rows, CAST(count_if(ts IS NULL) AS BIGINT) AS null_period,
  CAST(count_if(value IS NULL) AS BIGINT) AS null_volume, CAST(count_if(isnan(value)) AS BIGINT) AS nan_volume, CAST(count_if(isinf(value)) AS BIGINT) AS inf_volume,
  CAST(count_if(value < 0) AS BIGINT) AS negative_volume, CAST(count_if(isfinite(value) AND value > 1000000.0) AS BIGINT) AS above_max_volume,
  CAST(count_if(ts IS NULL OR value IS NULL OR isnan(value) OR isinf(value) OR value < 0
           OR (isfinite(value) AND value > 1000000.0)) AS BIGINT) AS invalid_rows,
  count(*) < 30 AS below_min_rows,
  count_if(ts IS NULL OR value IS NULL OR isnan(value) OR isinf(value) OR value < 0
           OR (isfinite(value) AND value > 1000000.0)) = 0 AND count(*) >= 30 AS passed
FROM events GROUP BY ALL"""
    o["pii_scan"] = pii_sql("documents", ("text", "lang", "source"))
    o["pii_gate"] = pii_sql("(SELECT *, CASE WHEN c_custkey % 7 = 0 THEN lower(c_name) || '@example.com' END AS contact FROM customer)",
                            ("c_name", "c_mktsegment", "contact"))
    o["pii_redact"] = "SELECT doc_id, lang, source, n_chars FROM documents"
    ek = ["event_type"]
    o["backtest_metrics"] = _with(*split_ctes("events_panel"), *resid_ctes(ek, "role = 'test'")) + f"""
SELECT event_type, count(*) AS n, {r('avg(abs(resid))')} AS mae, {r('avg(abs(resid) / greatest(y, 1.0)) * 100')} AS mape,
  {r(f"avg(CAST(y <= {var_sql('pred', 'resid_sigma')} AS DOUBLE)) * 100")} AS coverage, {r('first(resid_sigma)')} AS sigma
FROM res JOIN sig USING (event_type) GROUP BY ALL"""
    o["conditional_sigmas"] = _with(*hour_sigma_ctes()) + f"SELECT event_type, hour, n, {r('hour_sigma')} AS hour_sigma FROM cs"
    o["var_buffer"] = _with(*split_ctes("orders_daily"), *resid_ctes([], "role = 'test'")) + \
        f"SELECT TimePeriod, {band_sql('pred', 'resid_sigma')} FROM res, sig"
    o["hour_sigma_lookup"] = "WITH RECURSIVE " + _with(*lookup_ctes())[len("WITH "):] + \
        f"SELECT event_type, TimePeriod, {r4('sigma')} AS sigma FROM lk"
    o["next_forecast_naive"] = "WITH RECURSIVE " + _with(*lookup_ctes())[len("WITH "):] + \
        f"SELECT event_type, TimePeriod, {band_sql('LagS', 'sigma')} FROM lk"
    ctes = split_ctes("events_panel", "events_panel_") + split_ctes("orders_panel", "orders_panel_") + [
        mae_cte("ev2", "events_panel", "test", "LagS", "events", "event_type"),
        mae_cte("od2", "orders_panel", "test", "LagS", "orders", "o_orderpriority"),
        mae_cte("ev1", "events_panel", "test", "Lag1", "events", "event_type"),
        "cand AS (SELECT model, 'v2' AS version, mae FROM ev2 UNION ALL SELECT model, 'v2' AS version, mae FROM od2)",
        "champ AS (SELECT model, 'v1' AS champion_version, round(mae, 6) AS champion_mae FROM ev1)"]
    decided = """dec AS (SELECT model, version, round(mae, 6) AS holdout_mae, champion_version,
  CASE WHEN champion_version IS NULL OR round(mae, 6) <= champion_mae THEN 'champion' ELSE 'challenger' END AS alias
  FROM cand LEFT JOIN champ USING (model))"""
    o["model_versions"] = _with(*ctes, decided) + f"""
SELECT champ.model, champ.champion_version AS version, {r('champion_mae')} AS holdout_mae,
  CASE WHEN dec.alias = 'champion' THEN 'previous' ELSE 'champion' END AS alias FROM champ LEFT JOIN dec USING (model)
UNION ALL SELECT model, version, {r('holdout_mae')} AS holdout_mae, alias FROM dec"""
    o["gbt_forecast"] = trees_forecast_sql()
    o["gbt_nowcast"] = trees_nowcast_sql()
    o["next_forecast"] = trees_next_sql()
    o["promotion_decision"] = _with(*ctes) + f"""
SELECT model, version, {r('round(mae, 6)')} AS holdout_mae, champion_version, {r('champion_mae')} AS champion_mae,
  CASE WHEN mae IS NULL OR isnan(mae) OR isinf(mae) THEN 'rejected' WHEN champion_version IS NULL THEN 'champion'
       WHEN round(mae, 6) <= coalesce(champion_mae, 'inf'::DOUBLE) - 0.0 THEN 'champion' ELSE 'challenger' END AS decision,
  CASE WHEN mae IS NULL OR isnan(mae) OR isinf(mae) THEN false WHEN champion_version IS NULL THEN true
       ELSE round(mae, 6) <= coalesce(champion_mae, 'inf'::DOUBLE) - 0.0 END AS promoted
FROM cand LEFT JOIN champ USING (model)"""
    o["score_forecasts"] = _with(*shadow_log_ctes()) + \
        f"SELECT event_type, n_matured, {r('realised_mae')} AS realised_mae, {r('coverage_99')} AS coverage_99 FROM score"
    o["concept_drift"] = _with(*shadow_log_ctes("came")) + (
        f"SELECT event_type, n_matured, {r('realised_mae')} AS realised_mae, {r('coverage_99')} AS coverage_99, "
        f"{r('baseline_mae')} AS baseline_mae, drift_detected FROM drift")
    o["retrain_set"] = _with(*shadow_log_ctes("came")) + "SELECT DISTINCT event_type FROM drift WHERE drift_detected"
    o["mae_degradation"] = _with(*split_ctes("events_panel")) + f"""
SELECT event_type, {r('ref')} AS reference_mae, {r('cur')} AS current_mae, {r('(cur - ref) / (ref + 1e-9)')} AS mae_degradation,
  (cur - ref) / (ref + 1e-9) > 0.15 AS concept_drift
FROM (SELECT event_type, avg(CASE WHEN role = 'train' THEN abs(y - greatest(0, prediction)) END) AS ref,
             avg(CASE WHEN role = 'test' THEN abs(y - greatest(0, prediction)) END) AS cur
      FROM sp WHERE role <> 'insufficient_data' GROUP BY ALL)"""
    o["data_drift"] = drift_sql()
    o["drift_summary"] = drift_summary_sql()
    o["drift_by_size"] = drift_by_size_sql()
    o["garch_sigma"] = garch_sql()
    o["backtest_metrics_garch"] = backtest_garch_sql()
    o["shadow_upsert"] = _with(*split_ctes("orders_daily"),
                               """ex AS (SELECT TimePeriod, TIMESTAMP '2000-01-01 00:00:00' AS Inferred_At,
  round(greatest(0, Lag1), 2) AS Point_Forecast FROM sp WHERE role = 'test' AND TimePeriod <= TIMESTAMP '2000-01-01')""",
                               """nw AS (SELECT TimePeriod, TIMESTAMP '2000-02-01 00:00:00' AS Inferred_At,
  round(greatest(0, LagS), 2) AS Point_Forecast FROM sp WHERE role = 'test'
  AND TimePeriod > TIMESTAMP '2000-01-01' - INTERVAL 30 DAY)""") + f"""
SELECT TimePeriod, Inferred_At, {r('Point_Forecast')} AS Point_Forecast FROM (
  SELECT * FROM ex WHERE TimePeriod NOT IN (SELECT TimePeriod FROM nw) UNION ALL SELECT * FROM nw)"""
    o["request_validation"] = _with(requests_cte()) + \
        "SELECT event_id, granularity_norm, reject_reason IS NULL AS valid, reject_reason FROM val"
    o["request_audit"] = _with(requests_cte()) + """SELECT granularity_norm AS granularity, outcome, count(*) AS n FROM (
  SELECT *, CASE WHEN reject_reason IS NOT NULL THEN 'rejected' WHEN point_forecast > 100000 THEN 'anomalous'
  ELSE 'ok' END AS outcome FROM val) GROUP BY ALL"""
    o["latency_p99"] = latency_sql()
    o["latency_histogram"] = histogram_sql()
    # the driver compares at sf0.01, so the oracle hashes that folder's files
    o["artifact_manifest"] = ("SELECT parse_filename(filename) AS file, size AS length, sha256(content) AS sha256 "
                              "FROM read_blob('/root/testdata/sf0.01/*.parquet')")
    o["artifact_check"] = """SELECT parse_filename(filename) AS file, CASE parse_filename(filename) WHEN 'part.parquet' THEN 'mismatch'
  WHEN 'nation.parquet' THEN 'unlisted' ELSE 'verified' END AS status FROM read_blob('/root/testdata/sf0.01/*.parquet')
  UNION ALL SELECT 'gone.parquet' AS file, 'missing' AS status"""
    o["stream_hourly"] = ("SELECT event_type, date_trunc('hour', ts) AS TimePeriod, count(*) AS Volume FROM events "
                          "GROUP BY ALL")
    o["stream_upsert"] = (f"SELECT user_id, max(ts) AS TimePeriod, arg_max(event_type, [epoch_us(ts), event_id]) AS event_type, "
                          f"{r('arg_max(value, [epoch_us(ts), event_id])')} AS value FROM events GROUP BY user_id")
    o["stream_late"] = late_sql()
    o["latency_p99_windowed"] = windowed_sql()
    o["online_two_loads"] = o["online_latest"]
    o["interval_refresh"] = _with(ev_p) + nowcast_sql("d", ["event_type"], "H", *NOWCAST_H, dropna=True)
    o["rate_breaches"] = ("SELECT user_id, date_trunc('minute', ts) AS minute, count(*) AS n FROM events "
                          "GROUP BY ALL HAVING count(*) > 1")
    o["stream_rate_breaches"] = o["rate_breaches"]
    o["capacity_plan"] = _with(*split_ctes("events_panel"), *resid_ctes(ek, "role = 'train'")) + \
        f"SELECT event_type, TimePeriod, {r('y')} AS y, {band_sql('prediction', 'CASE WHEN resid_sigma > 0 THEN resid_sigma ELSE 0.21 END')} FROM sp LEFT JOIN sig USING (event_type)"
    return o


ORACLES = _orc()
