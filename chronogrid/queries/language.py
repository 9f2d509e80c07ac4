"""Programs of the cube language over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..lang import evaluate
from ..plans import bindings
from .common import rounded, rounded_sql

CUBES = {"orders": (bindings.orders, bindings.ORDERS_SQL), "events": (bindings.events, bindings.EVENTS_SQL), "items": (bindings.items, bindings.ITEMS_SQL), "gaps": (bindings.gaps, bindings.GAPS_SQL), "codes": (bindings.codes, bindings.CODES_SQL)}

EPOCH = "floor(epoch(ts))::BIGINT"
DECYEAR = "(year({0}) + (epoch({0}) - epoch(date_trunc('year', {0}))) / (CASE WHEN (year({0}) % 4 = 0 AND year({0}) % 100 <> 0) OR year({0}) % 400 = 0 THEN 366 ELSE 365 END * 86400.0))"
MONTH = "(year(ts) * 12 + month(ts) - 1)::INT AS period"


def decyear(ts: str) -> str:
    return DECYEAR.format(ts)


#: name: (cube, program, SQL of the value; {} stands for the cube's rows)
PROGRAMS: dict[str, tuple[str, str, str]] = {
    # scalar algebra, a value for each date
    "scalar_arithmetic": ("events", "(red + 2) * nir - s / 3", "SELECT px, ts, (red + 2) * nir - s / 3 AS value FROM {}"),
    "scalar_divide_by_zero": ("items", "s / (quantity - 25)", "SELECT px, ts, s / nullif(quantity - 25, 0) AS value FROM {}"),
    "scalar_modulo": ("events", "mod(s, 0 - 7) + s % 3", "SELECT px, ts, (s - (-7.0) * floor(s / -7.0)) + (s - 3.0 * floor(s / 3.0)) AS value FROM {}"),
    "scalar_power": ("items", "discount ^ 2 + quantity ** 0.5", "SELECT px, ts, discount ^ 2 + quantity ^ 0.5 AS value FROM {}"),
    "scalar_roots_logs": ("events", "sqrt(s) + log(s) + log10(s) - log2(s) + exp(s / 1000)", "SELECT px, ts, sqrt(s) + ln(s) + log10(s) - log2(s) + exp(s / 1000) AS value FROM {}"),
    "scalar_log_of_negative": ("events", "coalesce(log(s - 250), 0 - 1) + coalesce(sqrt(s - 250), 0 - 2)", "SELECT px, ts, CASE WHEN s > 250 THEN ln(s - 250) ELSE -1 END + CASE WHEN s >= 250 THEN sqrt(s - 250) ELSE -2 END AS value FROM {}"),
    "scalar_rounding": ("events", "round(s) + floor(s) * 10 + ceil(s) * 100 + trunc(0 - s) + sign(s - 200)", "SELECT px, ts, round_even(s, 0) + floor(s) * 10 + ceil(s) * 100 + trunc(-s) + sign(s - 200) AS value FROM {}"),
    "scalar_trigonometry": ("items", "sin(quantity) + cos(quantity) * tan(discount) + asin(discount) + acos(discount) + atan(tax) + atan2(discount, tax)", "SELECT px, ts, sin(quantity) + cos(quantity) * tan(discount) + asin(discount) + acos(discount) + atan(tax) + atan2(discount, tax) AS value FROM {}"),
    "scalar_hyperbolic": ("items", "sinh(discount) + cosh(tax) + tanh(quantity) + hypot(discount, tax) + abs(0 - s) + pi + e", "SELECT px, ts, sinh(discount) + cosh(tax) + tanh(quantity) + sqrt(discount * discount + tax * tax) + abs(-s) + pi() + exp(1) AS value FROM {}"),
    "scalar_n_ary": ("events", "min(red, s) + max(s, q, 100) + mean(s, q) + sum(s, q, 1)", "SELECT px, ts, CASE WHEN red IS NOT NULL AND s IS NOT NULL THEN least(red, s) END + CASE WHEN s IS NOT NULL AND q IS NOT NULL THEN greatest(s, q, 100) END + (s + q) / 2 + (s + q + 1) AS value FROM {}"),
    "scalar_clamp": ("events", "clamp(s, 100, 300)", "SELECT px, ts, CASE WHEN s IS NOT NULL THEN least(greatest(s, 100), 300) END AS value FROM {}"),
    "scalar_normalized_difference": ("items", "nd(discount, tax)", "SELECT px, ts, (discount - tax) / nullif(discount + tax, 0) AS value FROM {}"),
    "scalar_where": ("events", "where(s > 200, s, 0 - q)", "SELECT px, ts, CASE WHEN s IS NULL THEN NULL WHEN s > 200 THEN s ELSE -q END AS value FROM {}"),
    "scalar_valid": ("events", "isnan(s) + 2 * isvalid(red) + 4 * (nir == nan) + 8 * (nir != nan) + coalesce(red, nir, 0)", "SELECT px, ts, (s IS NULL)::INT + 2 * (red IS NOT NULL)::INT + 4 * (nir IS NULL)::INT + 8 * (nir IS NOT NULL)::INT + coalesce(red, nir, 0) AS value FROM {}"),
    "scalar_in_list": ("events", "in(q, 1, 2, 3, 50)", "SELECT px, ts, (q IN (1, 2, 3, 50))::INT::DOUBLE AS value FROM {}"),
    "scalar_bits": ("events", "bit(q, 3) + 10 * bits(q, 1, 3)", "SELECT px, ts, ((q::BIGINT >> 3) & 1) + 10 * ((q::BIGINT >> 1) & 7)::DOUBLE AS value FROM {}"),
    "scalar_qa_mask": ("events", 'qa(s, q, "landsat_c2")', "SELECT px, ts, CASE WHEN (q::BIGINT & 59) = 0 THEN s END AS value FROM {}"),
    "scalar_qa_scl": ("codes", 'qa(s, q, "scl")', "SELECT px, ts, CASE WHEN q::BIGINT BETWEEN 4 AND 6 THEN s END AS value FROM {}"),
    "scalar_qa_hls": ("codes", 'qa(s, q, "hls")', "SELECT px, ts, CASE WHEN q::BIGINT <> 255 AND (q::BIGINT & 30) = 0 THEN s END AS value FROM {}"),
    "scalar_qa_fmask": ("codes", 'qa(s, q, "fmask")', "SELECT px, ts, CASE WHEN q::BIGINT IN (0, 1) THEN s END AS value FROM {}"),
    "scalar_qa_landsat": ("codes", 'qa(s, q, "landsat_c2")', "SELECT px, ts, CASE WHEN (q::BIGINT & (1 + 2 + 8 + 16 + 32)) = 0 THEN s END AS value FROM {}"),
    "scalar_three_valued_logic": ("events", "(s > 100 and red > 50) + 2 * (s > 100 or red > 50) + 4 * not (s > 100)", "SELECT px, ts, (s > 100 AND red > 50)::INT + 2 * (s > 100 OR red > 50)::INT + 4 * (NOT s > 100)::INT::DOUBLE AS value FROM {}"),
    "scalar_dates": ("orders", "year + month / 100 + day / 10000 + doy + decyear", f"SELECT px, ts, year(ts) + month(ts) / 100 + day(ts) / 10000 + dayofyear(ts) + {decyear('ts')} AS value FROM {{}}"),
    "scalar_date_index": ("orders", "t + s * 0", "SELECT px, ts, row_number() OVER (PARTITION BY px ORDER BY ts) - 1 + s * 0 AS value FROM {}"),
    "rules": ("events", "s > 400 = 4; s > 300 = 3; s < 50 = 0", "SELECT px, ts, CASE WHEN coalesce(s < 50, false) THEN 0 WHEN coalesce(s > 300, false) THEN 3 WHEN coalesce(s > 400, false) THEN 4 ELSE s END AS value FROM {}"),
    "user_variables": ("events", "a = s / 100\nb = a * a; b + a", "SELECT px, ts, (s / 100) * (s / 100) + s / 100 AS value FROM {}"),
    # reductions over time
    "reduce_mean": ("orders", "mean(s)", "SELECT px, avg(s) AS value FROM {} GROUP BY px"),
    "reduce_min_max_sum": ("orders", "max(s) - min(s) + sum(s)", "SELECT px, max(s) - min(s) + sum(s) AS value FROM {} GROUP BY px"),
    "reduce_std": ("orders", "std(s)", "SELECT px, stddev_pop(s) AS value FROM {} GROUP BY px"),
    "reduce_count": ("orders", "count(s > 200000)", "SELECT px, count_if(s > 200000)::DOUBLE AS value FROM {} GROUP BY px"),
    "reduce_median": ("orders", "median(s)", "SELECT px, median(s) AS value FROM {} GROUP BY px"),
    "reduce_percentile": ("orders", "percentile(s, 90)", "SELECT px, quantile_cont(s, 0.9) AS value FROM {} GROUP BY px"),
    "reduce_argmax": ("orders", "argmax(s) - argmin(s)", f"SELECT px, {decyear('a')} - {decyear('b')} AS value FROM (SELECT px, arg_max(ts, (s, -epoch_us(ts))) FILTER (s IS NOT NULL) AS a, arg_min(ts, (s, epoch_us(ts))) FILTER (s IS NOT NULL) AS b FROM {{}} GROUP BY px)"),
    "reduce_first_last": ("orders", "last(s > 100000) - first(s > 100000)", f"SELECT px, {decyear('b')} - {decyear('a')} AS value FROM (SELECT px, min(ts) FILTER (s > 100000) AS a, max(ts) FILTER (s > 100000) AS b FROM {{}} GROUP BY px)"),
    "reduce_longest_run": ("orders", "longest(s > 100000)", """SELECT px, coalesce(max(CASE WHEN ok THEN (coalesce(nxt, t0) - begun) / 86400.0 END), 0) AS value FROM (
        SELECT *, max(CASE WHEN ok AND NOT coalesce(prv, false) THEN t0 END) OVER (PARTITION BY px ORDER BY t0) AS begun FROM (
          SELECT px, epoch(ts)::BIGINT AS t0, s > 100000 AS ok, lag(s > 100000) OVER w AS prv, lead(epoch(ts)::BIGINT) OVER w AS nxt FROM {} WHERE s IS NOT NULL WINDOW w AS (PARTITION BY px ORDER BY ts))
        UNION ALL SELECT DISTINCT px, NULL, NULL, NULL, NULL, NULL FROM {}) GROUP BY px"""),
    "reduce_by_month": ("orders", "mean(s) by month", f"SELECT px, {MONTH}, avg(s) AS value FROM {{}} GROUP BY 1, 2"),
    "reduce_by_year": ("orders", "max(s) by year", "SELECT px, year(ts)::INT AS period, max(s) AS value FROM {} GROUP BY 1, 2"),
    "periods_with_image": ("orders", "mean(s) by year - mean(s)", "SELECT px, year(ts)::INT AS period, avg(s) - max(m) AS value FROM (SELECT *, avg(s) OVER (PARTITION BY px) AS m FROM {}) GROUP BY 1, 2"),
    "reduce_slice": ("orders", "median(s[1996-06 .. 1997-09])", "SELECT px, median(s) FILTER (ts >= '1996-06-01' AND ts < '1997-10-01') AS value FROM {} GROUP BY px"),
    "reduce_wrapping_months": ("orders", "mean(s[11 .. 2])", "SELECT px, avg(s) FILTER (month(ts) >= 11 OR month(ts) <= 2) AS value FROM {} GROUP BY px"),
    "series_minus_mean": ("orders", "s - mean(s)", "SELECT px, ts, s - avg(s) OVER (PARTITION BY px) AS value FROM {}"),
    "reduce_nested": ("orders", "std(s - mean(s[1995 .. 1997]))", "SELECT px, stddev_pop(s - m) AS value FROM (SELECT *, avg(s) FILTER (year(ts) <= 1997) OVER (PARTITION BY px) AS m FROM {}) GROUP BY px"),
    "trailing_window_mean": ("events", "mean(s, 5d)", f"SELECT px, ts, avg(s) OVER (PARTITION BY px ORDER BY {EPOCH} RANGE BETWEEN 431999 PRECEDING AND CURRENT ROW) AS value FROM {{}}"),
    "trailing_window_max": ("orders", "max(s, 6m)", f"SELECT px, ts, max(s) OVER (PARTITION BY px ORDER BY {EPOCH} RANGE BETWEEN 15778799 PRECEDING AND CURRENT ROW) AS value FROM {{}}"),
    "trailing_window_count": ("orders", "count(s > 100000, 2w)", f"SELECT px, ts, count(*) FILTER (s > 100000) OVER (PARTITION BY px ORDER BY {EPOCH} RANGE BETWEEN 1209599 PRECEDING AND CURRENT ROW)::DOUBLE AS value FROM {{}}"),
    "lag_values": ("orders", "s - s[-2]", "SELECT px, ts, s - list_filter(seen, lambda x: x IS NOT NULL)[-2] AS value FROM (SELECT *, list(s) OVER (PARTITION BY px ORDER BY ts ROWS BETWEEN 16 PRECEDING AND 1 PRECEDING) AS seen FROM {})"),
    "lag_one_year": ("orders", "s - lag(s, 1y)", """SELECT px, ts, value FROM (SELECT a.px, a.ts, a.s - b.s AS value, row_number() OVER (PARTITION BY a.px, a.ts ORDER BY abs(epoch(b.ts) - epoch(a.want)) NULLS LAST, b.ts) AS k FROM (
        SELECT c.*, (ts::DATE - INTERVAL 1 YEAR)::DATE::TIMESTAMP AS want, greatest(coalesce(quantile_cont(step, 0.5) OVER (PARTITION BY px), 0) / 2, 691200) AS reach FROM (SELECT *, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY px ORDER BY ts) AS step FROM {}) c) a
        LEFT JOIN (SELECT * FROM {}) b ON a.px = b.px AND abs(epoch(b.ts) - epoch(a.want)) <= a.reach AND b.ts <> a.ts) WHERE k = 1"""),
    "persist_condition": ("orders", "persist(s > 100000, 3)", """SELECT px, ts, CASE WHEN len(seen) >= 3 THEN list_min(seen[-3:])::DOUBLE END AS value FROM (
        SELECT px, ts, list_filter(list((s > 100000)::INT) OVER (PARTITION BY px ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), lambda x: x IS NOT NULL) AS seen FROM {})"""),
    "lag_over_gaps": ("gaps", "s - s[-1]", "SELECT px, ts, s - list_filter(seen, lambda x: x IS NOT NULL)[-1] AS value FROM (SELECT *, list(s) OVER (PARTITION BY px ORDER BY ts ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS seen FROM {})"),
    "persist_over_gaps": ("gaps", "persist(s > 100000, 2)", """SELECT px, ts, CASE WHEN len(seen) >= 2 THEN list_min(seen[-2:])::DOUBLE END AS value FROM (
        SELECT px, ts, list_filter(list((s > 100000)::INT) OVER (PARTITION BY px ORDER BY ts ROWS BETWEEN 15 PRECEDING AND CURRENT ROW), lambda x: x IS NOT NULL) AS seen FROM {})"""),
    "value_at_date": ("items", "at(quantity[1996-03-01 .. 1996-03-01], 19960301)", "SELECT px, max(CASE WHEN ts >= '1996-03-01' AND ts < '1996-03-02' THEN quantity END) AS value FROM {} GROUP BY px"),
    "anomaly_by_month": ("orders", "anomaly(s, base=1995 .. 1998, by=month)", """SELECT px, ts, (s - m) / nullif(d, 0) AS value FROM (SELECT *, avg(s) FILTER (year(ts) <= 1998) OVER w AS m, stddev_pop(s) FILTER (year(ts) <= 1998) OVER w AS d FROM {} WINDOW w AS (PARTITION BY px, month(ts)))"""),
    "anomaly_by_day": ("items", "anomaly(quantity, base=1995 .. 1997, by=doy, window=15d)", """WITH c AS (SELECT * FROM {}), b AS (SELECT px, dayofyear(ts) AS d, quantity AS v FROM c WHERE year(ts) <= 1997 AND quantity IS NOT NULL),
        w AS (SELECT t.px, t.d, avg(v) AS m, stddev_pop(v) AS sd FROM (SELECT DISTINCT px, dayofyear(ts) AS d FROM c) t JOIN b ON t.px = b.px AND least(abs(t.d - b.d), 365 - abs(t.d - b.d)) <= 15 GROUP BY 1, 2)
        SELECT c.px, ts, (quantity - m) / nullif(sd, 0) AS value FROM c LEFT JOIN w ON c.px = w.px AND dayofyear(ts) = w.d"""),
    "correlation_pearson": ("items", "corr(quantity, discount)", "SELECT px, CASE WHEN count(*) FILTER (ok) >= 3 THEN corr(quantity, discount) FILTER (ok) END AS value FROM (SELECT *, quantity IS NOT NULL AND discount IS NOT NULL AS ok FROM {}) GROUP BY px"),
    "correlation_lagged": ("items", "corr(s, tax, lag=1)", "SELECT px, CASE WHEN count(*) FILTER (s IS NOT NULL AND y IS NOT NULL) >= 3 THEN corr(s, y) END AS value FROM (SELECT *, lag(tax, 1 IGNORE NULLS) OVER (PARTITION BY px ORDER BY ts) AS y FROM {}) GROUP BY px"),
    "correlation_spearman": ("items", "corr(s, quantity, method=spearman)", """SELECT px, CASE WHEN count(rx) >= 3 THEN corr(rx, ry) END AS value FROM (SELECT px,
        CASE WHEN ok THEN rank() OVER (PARTITION BY px, ok ORDER BY s) + (count(*) OVER (PARTITION BY px, ok, s) - 1) / 2 END AS rx,
        CASE WHEN ok THEN rank() OVER (PARTITION BY px, ok ORDER BY quantity) + (count(*) OVER (PARTITION BY px, ok, quantity) - 1) / 2 END AS ry FROM (SELECT *, s IS NOT NULL AND quantity IS NOT NULL AS ok FROM {})) GROUP BY px"""),
    "reduction_of_constant": ("orders", "count(3) + std(5) + mean(7)", "SELECT px, ts, 8.0 AS value FROM {}"),
}


#: digits that both engines agree on where a deviation may be next to nothing
DIGITS = {"anomaly_by_month": 3, "anomaly_by_day": 3}


def _query(cube: str, program: str, digits: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(evaluate(CUBES[cube][0](spark, sf_dir), program), digits)

    return run


def _sql(cube: str, sql: str, digits: int) -> str:
    inner = sql.replace("{}", "cube")
    rows = CUBES[cube][1]
    return f"WITH cube AS ({rows}) {rounded_sql(inner, 'value', digits)}"


QUERIES = {f"calc_{k}": _query(c, p, DIGITS.get(k, 6)) for k, (c, p, _) in PROGRAMS.items()}
ORACLE = {f"calc_{k}": _sql(c, s, DIGITS.get(k, 6)) for k, (c, _, s) in PROGRAMS.items()}
