"""Statistics of series over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import series as S
from ..operators import temporal as T
from ..plans import bindings
from .common import CLASSES, EVENT_OBS, ITEM_OBS, OBS, Registry, classes, event_obs, item_obs, obs
from .language import decyear

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle

_STATS = f"""WITH v AS (SELECT px, {decyear('ts')} AS x, value AS y, lag(value) OVER (PARTITION BY px ORDER BY ts) - value AS fall FROM ({OBS}) WHERE value IS NOT NULL),
    a AS (SELECT px, count(*) AS n, avg(y) AS mean, median(y) AS median, coalesce(stddev_samp(y), 0) AS std, min(y) AS min, max(y) AS max,
      CASE WHEN var_pop(x) > 0 THEN covar_pop(y, x) / var_pop(x) END AS slope, avg(x) AS mx, CASE WHEN count(*) >= 2 THEN greatest(coalesce(max(fall), 0), 0) END AS largest_drop FROM v GROUP BY px),
    q AS (SELECT a.px, median((b.y - a.y) / (b.x - a.x)) AS sen FROM v a JOIN v b ON a.px = b.px AND a.x < b.x GROUP BY a.px),
    i AS (SELECT v.px, list_sort(list(y - sen * x)) AS r, any_value(sen) AS sen FROM v JOIN q ON v.px = q.px JOIN a ON v.px = a.px AND a.n >= 3 GROUP BY v.px)
    SELECT a.px, n, mean, median, std, CASE WHEN mean = 0 THEN 0 ELSE std / abs(mean) END AS cv, min, max, slope, mean - slope * mx AS intercept,
      i.sen AS sen_slope, i.r[n // 2 + 1] AS sen_intercept, largest_drop FROM a LEFT JOIN i ON a.px = i.px"""
R.add(
    "series_stats", lambda s, d: S.series_stats(obs(s, d)).drop("argmin", "argmax", "drop_date", "r2", "intercept", "sen_intercept"),
    f"SELECT * EXCLUDE (intercept, sen_intercept) FROM ({_STATS})",
    "mean median std cv min max slope sen_slope largest_drop", 4,
)
R.add(
    "series_intercepts", lambda s, d: S.series_stats(obs(s, d)).select("px", "intercept", "sen_intercept"), f"SELECT px, intercept, sen_intercept FROM ({_STATS})", "intercept sen_intercept", 0,
)
R.add(
    "series_extreme_dates", lambda s, d: S.series_stats(obs(s, d)).select("px", "argmin", "argmax", "drop_date"),
    f"""WITH v AS (SELECT px, {decyear('ts')} AS x, value AS y, lag(value) OVER (PARTITION BY px ORDER BY ts) - value AS fall FROM ({OBS}) WHERE value IS NOT NULL)
    SELECT px, arg_min(x, (y, x)) AS argmin, arg_max(x, (y, -x)) AS argmax, arg_max(x, (fall, -x)) FILTER (fall > 0) AS drop_date FROM v GROUP BY px""",
    "argmin argmax drop_date",
)
R.add(
    "region_sample_stats", lambda s, d: S.sample_stats(obs(s, d)),
    f"""SELECT ts, n, mean, std, {', '.join(f'l[floor({p / 100} * (n - 1))::INT + 1] AS p{p}' for p in (10, 25, 50, 75, 90))} FROM (
    SELECT ts, count(*) AS n, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS std, list_sort(list(value)) AS l FROM ({OBS}) WHERE value IS NOT NULL GROUP BY ts)""",
    "mean std p10 p25 p50 p75 p90",
)
R.add(
    "observations_per_year", lambda s, d: S.observations_per_year(obs(s, d)),
    f"""SELECT px, greatest(1, round_even(365.25 / l[len(l) // 2 + 1], 0)::INT)::INT AS per_year FROM (SELECT px, list_sort(list(step)) AS l FROM (
    SELECT px, (epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY px ORDER BY ts)) / 86400 AS step FROM ({OBS}) WHERE value IS NOT NULL) WHERE step IS NOT NULL GROUP BY px)""",
)
R.add("monthly_climatology", lambda s, d: S.monthly_climatology(obs(s, d)), f"SELECT px, month(ts)::INT AS month, avg(value) AS mean, count(value) AS n FROM ({OBS}) GROUP BY 1, 2", "mean")
R.add("deseasonalised", lambda s, d: S.deseasonalised(obs(s, d)), f"SELECT px, ts, value - avg(value) OVER (PARTITION BY px, month(ts)) AS value FROM ({OBS})", "value")
R.add(
    "cusum", lambda s, d: S.cusum(event_obs(s, d)),
    f"""SELECT px, ts, CASE WHEN v IS NOT NULL THEN sum(v) OVER (PARTITION BY px ORDER BY ts ROWS UNBOUNDED PRECEDING) END AS value FROM (
    SELECT px, ts, value - avg(value) OVER (PARTITION BY px) AS v FROM ({EVENT_OBS}))""",
    "value", 4,
)
R.add("seasonal_grid", lambda s, d: S.seasonal_grid(obs(s, d), 24), f"SELECT px, year(ts)::INT AS year, ((dayofyear(ts) - 1) * 24 // 366)::INT AS bin, avg(value) AS mean, count(value) AS n FROM ({OBS}) GROUP BY 1, 2, 3", "mean")
R.add("seasonal_years", lambda s, d: S.seasonal_years(obs(s, d), 275), f"SELECT px, (year(ts) - (dayofyear(ts) < 275)::INT)::INT AS season, avg(value) AS mean FROM ({OBS}) GROUP BY 1, 2", "mean")
R.add("season_filter", lambda s, d: S.season_filter(obs(s, d), 330, 60).groupBy("px").agg(F.count("value").alias("n"), F.max("value").alias("max")), f"SELECT px, count(value) AS n, max(value) AS max FROM ({OBS}) WHERE dayofyear(ts) >= 330 OR dayofyear(ts) <= 60 GROUP BY px", "max")
R.add(
    "annual_harmonic", lambda s, d: S.annual_harmonic(item_obs(s, d)),
    f"""WITH p AS (SELECT px, value AS y, cos(({decyear('ts')} - year(ts)) * 2 * pi()) AS c, sin(({decyear('ts')} - year(ts)) * 2 * pi()) AS s FROM ({ITEM_OBS}) WHERE value IS NOT NULL),
    m AS (SELECT px, count(*) AS n, avg(c) AS mc, avg(s) AS ms, avg(y) AS my, var_pop(c) AS kcc, var_pop(s) AS kss, covar_pop(c, s) AS kcs, covar_pop(c, y) AS kcy, covar_pop(s, y) AS ksy FROM p GROUP BY px),
    f AS (SELECT *, (kcy * kss - ksy * kcs) / (kcc * kss - kcs * kcs) AS a, (ksy * kcc - kcy * kcs) / (kcc * kss - kcs * kcs) AS b FROM m)
    SELECT px, my - a * mc - b * ms AS mean, sqrt(a * a + b * b) AS amplitude, (atan2(b, a) / (2 * pi()) - floor(atan2(b, a) / (2 * pi()))) * 365.25 AS peak_day FROM f""",
    "mean amplitude peak_day", 4,
)
R.add("average_ranks", lambda s, d: S.average_ranks(obs(s, d)).select("px", "ts", "rank"), f"SELECT px, ts, CASE WHEN value IS NOT NULL THEN rank() OVER (PARTITION BY ts ORDER BY value NULLS LAST) + (count(value) OVER (PARTITION BY ts, value) - 1) / 2 END AS rank FROM ({OBS})", "rank")
R.add("clearest_dates", lambda s, d: S.clearest_dates(obs(s, d), 20), f"SELECT ts, count(value) / count(*) AS clear, count(value) AS n FROM ({OBS}) GROUP BY ts ORDER BY clear DESC, n DESC, ts LIMIT 20", "clear")
R.add(
    "pareto_front", lambda s, d: S.pareto_front(S.series_stats(obs(s, d)).select("px", F.col("n").cast("double").alias("n"), "mean", "min"), ["n", "mean", "min"], "px"),
    f"""WITH t AS (SELECT px, count(*)::DOUBLE AS n, avg(value) AS mean, min(value) AS min FROM ({OBS}) WHERE value IS NOT NULL GROUP BY px)
    SELECT * FROM t a WHERE NOT EXISTS (SELECT 1 FROM t b WHERE b.n >= a.n AND b.mean >= a.mean AND b.min >= a.min AND (b.n > a.n OR b.mean > a.mean OR b.min > a.min))""",
    "n mean min",
)
R.add(
    "band_scores", lambda s, d: S.band_scores(_items(s, d), ["quantity", "discount", "tax"]),
    """WITH c AS (SELECT l_suppkey, l_shipdate AS ts, max(l_quantity) AS quantity, max(l_discount) AS discount, max(l_tax) AS tax FROM lineitem GROUP BY 1, 2),
    w AS (SELECT avg(quantity) AS mq, stddev_samp(quantity) AS sq, avg(discount) AS md, stddev_samp(discount) AS sd, avg(tax) AS mt, stddev_samp(tax) AS st FROM c)
    SELECT ts, avg((quantity - mq) / sq) AS quantity, avg((discount - md) / sd) AS discount, avg((tax - mt) / st) AS tax FROM c, w GROUP BY ts""",
    "quantity discount tax",
)
R.add("histogram_summary", lambda s, d: S.summary(obs(s, d), 0, 500000, 25), f"SELECT least(24, greatest(0, floor(value / 20000)))::INT AS bin, count(*) AS n, min(value) AS min, max(value) AS max FROM ({OBS}) WHERE value IS NOT NULL GROUP BY 1", "min max")
R.add("categorical_detection", lambda s, d: S.is_categorical(item_obs(s, d)), f"SELECT count(DISTINCT value) AS n, bool_and(value = floor(value)) AND count(DISTINCT value) <= 64 AS categorical FROM ({ITEM_OBS}) WHERE ts = (SELECT min(l_shipdate) FROM lineitem)")
R.add("class_shares", lambda s, d: S.class_shares(classes(s, d).withColumnRenamed("period", "ts")), f"SELECT period AS ts, class, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER (PARTITION BY period) AS percent FROM ({CLASSES}) GROUP BY 1, 2", "percent")
R.add("class_transitions", lambda s, d: S.transitions(classes(s, d), 1996, 1999), f'SELECT a.class AS "from", b.class AS "to", count(*) AS n FROM ({CLASSES}) a JOIN ({CLASSES}) b ON a.px = b.px WHERE a.period = 1996 AND b.period = 1999 GROUP BY 1, 2')
R.add(
    "class_flows", lambda s, d: S.flows(classes(s, d), 0.1),
    f"""WITH c AS ({CLASSES}), r AS (SELECT class, count(*) < 0.1 * sum(count(*)) OVER () AS rare FROM c GROUP BY class),
    n AS (SELECT px, period, CASE WHEN rare THEN 'other' ELSE c.class::VARCHAR END AS k FROM c JOIN r ON c.class = r.class),
    p AS (SELECT period, lead(period) OVER w AS next_period, k AS "from", lead(k) OVER w AS "to" FROM n WINDOW w AS (PARTITION BY px ORDER BY period))
    SELECT *, count(*) AS n FROM p WHERE next_period IS NOT NULL GROUP BY ALL""",
)
# sets of series
R.add("union_of_series", lambda s, d: obs(s, d).where("px % 3 = 0").unionByName(obs(s, d).where("px % 5 = 0")).distinct().groupBy("px").agg(F.count("*").alias("n")), f"SELECT px, count(*) AS n FROM (SELECT * FROM ({OBS}) WHERE px % 3 = 0 UNION SELECT * FROM ({OBS}) WHERE px % 5 = 0) GROUP BY px")
R.add("intersect_of_keys", lambda s, d: obs(s, d).where("value > 300000").select("px").intersect(obs(s, d).where("value < 50000").select("px")), f"SELECT px FROM ({OBS}) WHERE value > 300000 INTERSECT SELECT px FROM ({OBS}) WHERE value < 50000")
R.add("except_of_keys", lambda s, d: obs(s, d).select("px").distinct().join(obs(s, d).where("value > 400000").select("px").distinct(), "px", "left_anti"), f"SELECT DISTINCT px FROM ({OBS}) EXCEPT SELECT px FROM ({OBS}) WHERE value > 400000")
R.add("distinct_classes", lambda s, d: classes(s, d).select("class").distinct(), f"SELECT DISTINCT class FROM ({CLASSES})")

# folds and trends
NAMES = ["count", "min", "p10", "median", "p90", "max", "range", "iqr", "mean", "std"]
FOLD = "count(v) AS f_count, min(v) AS f_min, quantile_cont(v, 0.1) AS f_p10, median(v) AS f_median, quantile_cont(v, 0.9) AS f_p90, max(v) AS f_max, max(v) - min(v) AS f_range, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS f_iqr, avg(v) AS f_mean, CASE WHEN count(v) > 0 THEN coalesce(stddev_samp(v), 0) END AS f_std"
FOLDED = "f_min f_p10 f_median f_p90 f_max f_range f_iqr f_mean f_std"
R.add(
    "temporal_metrics", lambda s, d: T.temporal_metrics(item_obs(s, d)),
    f"""SELECT px, count(v) AS m_count, min(v) AS m_min, {', '.join(f'quantile_cont(v, {q}) AS m_{n}' for n, q in (('p5', 0.05), ('p10', 0.1), ('p25', 0.25), ('median', 0.5), ('p75', 0.75), ('p90', 0.9), ('p95', 0.95)))},
    max(v) AS m_max, max(v) - min(v) AS m_range, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS m_iqr, avg(v) AS m_mean, coalesce(stddev_samp(v), 0) AS m_std,
    avg((v - m) ** 3) / avg((v - m) ** 2) ** 1.5 AS m_skew, avg((v - m) ** 4) / avg((v - m) ** 2) ** 2 - 3 AS m_kurtosis
    FROM (SELECT px, value AS v, avg(value) OVER (PARTITION BY px) AS m FROM ({ITEM_OBS})) GROUP BY px""",
    "m_min m_p5 m_p10 m_p25 m_median m_p75 m_p90 m_p95 m_max m_range m_iqr m_mean m_std m_skew m_kurtosis",
)
R.add("fold_by_month", lambda s, d: T.fold(obs(s, d), "month", NAMES), f"SELECT k.px, k.period, {FOLD} FROM (SELECT DISTINCT px, unnest(range(1, 13))::INT AS period FROM ({OBS})) k LEFT JOIN (SELECT px, month(ts) AS period, value AS v FROM ({OBS})) o ON k.px = o.px AND k.period = o.period GROUP BY 1, 2", FOLDED)
R.add("fold_by_year", lambda s, d: T.fold(obs(s, d), "year", NAMES), f"SELECT k.px, k.period, {FOLD} FROM (SELECT px, unnest(range(min(year(ts)), max(year(ts)) + 1))::INT AS period FROM ({OBS}) GROUP BY px) k LEFT JOIN (SELECT px, year(ts) AS period, value AS v FROM ({OBS})) o ON k.px = o.px AND k.period = o.period GROUP BY 1, 2", FOLDED)
DOY = "(dayofyear(ts) - CASE WHEN ((year(ts) % 4 = 0 AND year(ts) % 100 <> 0) OR year(ts) % 400 = 0) AND dayofyear(ts) > 60 THEN 1 ELSE 0 END)"
R.add("fold_by_week", lambda s, d: T.fold(obs(s, d), "week", ["count", "mean", "max"]), f"SELECT k.px, k.period, count(v) AS f_count, avg(v) AS f_mean, max(v) AS f_max FROM (SELECT DISTINCT px, unnest(range(1, 53))::INT AS period FROM ({OBS})) k LEFT JOIN (SELECT px, least(52, ceil({DOY} / 7)::INT) AS period, value AS v FROM ({OBS})) o ON k.px = o.px AND k.period = o.period GROUP BY 1, 2", "f_mean f_max")
R.add("fold_by_quarter", lambda s, d: T.fold(obs(s, d), "quarter", ["count", "median", "std"]), f"SELECT k.px, k.period, count(v) AS f_count, median(v) AS f_median, CASE WHEN count(v) > 0 THEN coalesce(stddev_samp(v), 0) END AS f_std FROM (SELECT DISTINCT px, unnest(range(1, 5))::INT AS period FROM ({OBS})) k LEFT JOIN (SELECT px, quarter(ts) AS period, value AS v FROM ({OBS})) o ON k.px = o.px AND k.period = o.period GROUP BY 1, 2", "f_median f_std")
R.add(
    "clear_observations", lambda s, d: T.clear_observations(obs(s, d), 12),
    f"""WITH o AS (SELECT px, year(ts) * 12 + month(ts) - 1 AS m, (ts::DATE - DATE '1970-01-01') AS day, value FROM ({OBS})), f AS (SELECT px, min(m) AS lo, max(m) AS hi FROM o GROUP BY px),
    w AS (SELECT px, unnest(range(lo, hi + 1, 12)) AS w FROM f), e AS (SELECT px, w, make_date((w // 12)::INT, (w % 12 + 1)::INT, 1) - DATE '1970-01-01' AS a, make_date(((w + 12) // 12)::INT, ((w + 12) % 12 + 1)::INT, 1) - DATE '1970-01-01' AS b FROM w),
    p AS (SELECT o.px, lo + (m - lo) // 12 * 12 AS w, day, 1 AS obs FROM o JOIN f ON o.px = f.px WHERE value IS NOT NULL UNION ALL SELECT px, w, a, 0 FROM e UNION ALL SELECT px, w, b, 0 FROM e),
    g AS (SELECT *, day - lag(day) OVER (PARTITION BY px, w ORDER BY day, obs) AS gap FROM p)
    SELECT px, w::INT AS "window", sum(obs)::BIGINT AS o_count, max(gap)::INT AS o_max, avg(gap) AS o_mean FROM g GROUP BY 1, 2""",
    "o_mean",
)
SPINE = """WITH v AS (SELECT px, (ts::DATE - DATE '1970-01-01') AS d, value AS v FROM ({obs}) WHERE value IS NOT NULL), r AS (SELECT px, min(d) AS lo, max(d) AS hi FROM v GROUP BY px),
    g AS (SELECT px, unnest(range(lo, lo + greatest((hi - lo + 1) // {step}, 1) * {step}, {step})) AS g FROM r)"""
R.add(
    "interpolate_linear", lambda s, d: T.interpolate_linear(obs(s, d), 30),
    SPINE.format(obs=OBS, step=30) + """, m AS (SELECT px, d, avg(v) AS v FROM v GROUP BY 1, 2), b AS (SELECT px, d, v, 0 AS k FROM m UNION ALL SELECT px, g, NULL, 1 FROM g),
    f AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN {'d': d, 'v': v} END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a,
      first_value(CASE WHEN v IS NOT NULL THEN {'d': d, 'v': v} END IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS z FROM b WINDOW w AS (PARTITION BY px ORDER BY d, k))
    SELECT px, (DATE '1970-01-01' + d::INT)::DATE AS day, CASE WHEN a.d = d THEN a.v ELSE a.v + (z.v - a.v) / (z.d - a.d) * (d - a.d) END AS value FROM f WHERE k = 1""",
    "value",
)
NEAR = "LEFT JOIN v ON g.px = v.px AND abs(v.d - g.g) <= {reach} GROUP BY 1, 2"
R.add("interpolate_moving", lambda s, d: T.interpolate_moving(obs(s, d), 60, 120), SPINE.format(obs=OBS, step=60) + f" SELECT g.px, (DATE '1970-01-01' + g.g::INT)::DATE AS day, avg(v) AS value FROM g {NEAR.format(reach=120)}", "value")
R.add("interpolate_rbf", lambda s, d: T.interpolate_rbf(obs(s, d), 60, 50.0, 150), SPINE.format(obs=OBS, step=60) + f" SELECT g.px, (DATE '1970-01-01' + g.g::INT)::DATE AS day, sum(exp(-((d - g.g) ** 2) / 5000.0) * v) / sum(exp(-((d - g.g) ** 2) / 5000.0)) AS value FROM g {NEAR.format(reach=150)}", "value")
R.add("standardize", lambda s, d: T.standardize(obs(s, d)), f"SELECT px, ts, CASE WHEN count(value) OVER w < 2 THEN value ELSE (value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0) END AS value FROM ({OBS}) WINDOW w AS (PARTITION BY px)", "value")
R.add("standardize_center", lambda s, d: T.standardize(obs(s, d), "center"), f"SELECT px, ts, CASE WHEN count(value) OVER w < 2 THEN value ELSE value - avg(value) OVER w END AS value FROM ({OBS}) WINDOW w AS (PARTITION BY px)", "value")
YEARS = f"y AS (SELECT px, year(ts) AS p, avg(value) AS y FROM ({OBS}) GROUP BY 1, 2), l AS (SELECT px, min(p) AS lo, max(p) - min(p) + 1 AS len FROM y GROUP BY px)"
R.add(
    "linear_trend", lambda s, d: T.linear_trend(obs(s, d)),
    f"""WITH {YEARS}, q AS (SELECT y.px, p - lo AS x, y.y FROM y JOIN l ON y.px = l.px WHERE y.y IS NOT NULL),
    m AS (SELECT px, count(*) AS num, avg(y) AS mean, CASE WHEN var_pop(x) > 0 THEN covar_pop(y, x) / var_pop(x) END AS slope, avg(x) AS mx,
      CASE WHEN var_pop(y) > 0 THEN CASE WHEN var_pop(x) > 0 THEN covar_pop(y, x) ** 2 / (var_pop(x) * var_pop(y)) END ELSE 0 END AS rsq FROM q GROUP BY px),
    o AS (SELECT *, mean - slope * mx AS "offset" FROM m), e AS (SELECT q.px, sqrt(avg((y - "offset" - slope * x) ** 2)) AS rmse, avg(abs(y - "offset" - slope * x)) AS mae, max(abs(y - "offset" - slope * x)) AS maxe FROM q JOIN o ON q.px = o.px GROUP BY q.px)
    SELECT o.px, num, mean, "offset", slope, rsq, rmse, mae, maxe, len::INT AS len, slope * (len - 1) AS abs_gain, 100 * slope * (len - 1) / nullif(abs("offset"), 0) AS pct_gain FROM o JOIN e ON o.px = e.px JOIN l ON o.px = l.px""",
    'mean "offset" slope rsq rmse mae maxe abs_gain pct_gain', 4,
)
R.add(
    "change_and_trends", lambda s, d: T.change_and_trends(obs(s, d)),
    f"""WITH y AS (SELECT px, year(ts) AS p, avg(value) AS y FROM ({OBS}) WHERE value IS NOT NULL GROUP BY 1, 2), f AS (SELECT *, lag(y) OVER (PARTITION BY px ORDER BY p) - y AS loss FROM y),
    w AS (SELECT px, min(p) AS lo, max(loss) FILTER (loss > 0) AS loss, arg_max(p, (loss, -p)) FILTER (loss > 0) AS change_time FROM f GROUP BY px),
    q AS (SELECT y.px, p - lo AS x, y.y, p >= change_time AS after FROM y JOIN w ON y.px = w.px),
    r AS (SELECT px, count(*) AS total_num, CASE WHEN var_pop(x) > 0 THEN covar_pop(y, x) / var_pop(x) END AS total_slope,
      nullif(count(*) FILTER (NOT after), 0) AS before_num, CASE WHEN var_pop(x) FILTER (NOT after) > 0 THEN (covar_pop(y, x) FILTER (NOT after)) / (var_pop(x) FILTER (NOT after)) END AS before_slope,
      nullif(count(*) FILTER (after), 0) AS after_num, CASE WHEN var_pop(x) FILTER (after) > 0 THEN (covar_pop(y, x) FILTER (after)) / (var_pop(x) FILTER (after)) END AS after_slope FROM q GROUP BY px)
    SELECT w.px, loss, change_time::INT AS change_time, (loss IS NOT NULL)::INT AS change, total_slope, total_num, before_slope, before_num, after_slope, after_num FROM w JOIN r ON w.px = r.px""",
    "loss total_slope before_slope after_slope", 4,
)
R.add(
    "mann_kendall", lambda s, d: T.mann_kendall(obs(s, d)),
    f"""WITH v AS (SELECT px, row_number() OVER (PARTITION BY px ORDER BY ts) - 1 AS i, value AS y FROM ({OBS}) WHERE value IS NOT NULL), n AS (SELECT px, count(*) AS n, median(y) AS my FROM v GROUP BY px),
    t AS (SELECT px, sum(t * (t - 1) * (2 * t + 5)) AS ties FROM (SELECT px, y, count(*) AS t FROM v GROUP BY 1, 2) GROUP BY px),
    q AS (SELECT a.px, sum(sign(b.y - a.y))::DOUBLE AS s, median((b.y - a.y) / (b.i - a.i)) AS slope FROM v a JOIN v b ON a.px = b.px AND a.i < b.i GROUP BY a.px),
    z AS (SELECT n.px, n, my, coalesce(s, 0) AS s, slope, CASE WHEN coalesce(s, 0) = 0 THEN 0 ELSE (s - sign(s)) / sqrt((n * (n - 1) * (2 * n + 5) - ties) / 18.0) END AS z FROM n JOIN t ON n.px = t.px LEFT JOIN q ON n.px = q.px)
    SELECT px, n, s, z, s / nullif(n * (n - 1) / 2.0, 0) AS tau, slope, my - slope * (n - 1) / 2.0 AS intercept, (CASE WHEN abs(z) > 1.959963984540054 THEN sign(z) ELSE 0 END)::INT AS trend, CASE WHEN abs(z) > 1.959963984540054 THEN slope END AS sig_slope FROM z""",
    "s z tau slope intercept sig_slope", 4,
)
R.add(
    "map_agreement", lambda s, d: T.agreement(_maps(s, d), 1),
    f"""WITH m AS (SELECT px, class AS map, max(period) AS yod FROM ({CLASSES}) GROUP BY 1, 2), a AS (SELECT DISTINCT px, yod AS y FROM m),
    u AS (SELECT a.px, y, count(*) FILTER (abs(yod - y) <= 1) AS n_agree, count(*) FILTER (yod = y) AS exact FROM a JOIN m ON a.px = m.px GROUP BY 1, 2),
    b AS (SELECT px, arg_max(y, (n_agree, exact, -y)) AS yod, arg_max(n_agree, (n_agree, exact, -y)) AS n_agree FROM u GROUP BY px)
    SELECT b.px, b.yod::INT AS yod, n_agree, n_detected, n_agree / n_detected AS share, spread::INT AS spread FROM b JOIN (SELECT px, count(*) AS n_detected, max(yod) - min(yod) AS spread FROM m GROUP BY px) s ON b.px = s.px""",
    "share",
)
MONTHS = f"r AS (SELECT px, date_trunc('month', ts)::DATE AS period, ts, value FROM ({OBS})), g AS (SELECT px, unnest(generate_series(min(period), max(period), INTERVAL 1 MONTH))::DATE AS period FROM r GROUP BY px)"
R.add("regularize_clearest", lambda s, d: T.regularize_clearest(obs(s, d), "month"), f"""WITH {MONTHS}, sh AS (SELECT ts, count(value) / count(*) AS share FROM ({OBS}) GROUP BY ts),
      k AS (SELECT px, date_trunc('month', o.ts)::DATE AS period, value, row_number() OVER (PARTITION BY px, date_trunc('month', o.ts) ORDER BY share DESC, o.ts) AS n FROM ({OBS}) o JOIN sh ON o.ts = sh.ts WHERE value IS NOT NULL)
      SELECT DISTINCT g.px, g.period, k.value FROM g LEFT JOIN k ON g.px = k.px AND g.period = k.period AND n = 1""", "value")
R.add("composite_greenest", lambda s, d: T.greenest_pixel(bindings.items(s, d).rows, "quantity", ["discount", "tax"]), f"""SELECT px, period, discount, tax FROM (SELECT *, row_number() OVER (PARTITION BY px, period ORDER BY quantity DESC, ts) AS n FROM (SELECT *, date_trunc('year', ts)::DATE AS period FROM ({bindings.ITEMS_SQL})) WHERE quantity IS NOT NULL) WHERE n = 1""", "discount tax")
R.add("regularize_median", lambda s, d: T.regularize(obs(s, d), "month"), f"WITH {MONTHS} SELECT g.px, g.period, median(value) AS value FROM g LEFT JOIN r ON g.px = r.px AND g.period = r.period GROUP BY 1, 2", "value")
R.add(
    "regularize_medoid", lambda s, d: T.regularize(_items(s, d).withColumnRenamed("l_suppkey", "px"), "year", "medoid", bands=("quantity", "discount")),
    """WITH c AS (SELECT l_suppkey::BIGINT AS px, l_shipdate AS ts, max(l_quantity) AS quantity, max(l_discount) AS discount, date_trunc('year', l_shipdate)::DATE AS period FROM lineitem GROUP BY 1, 2),
    m AS (SELECT px, period, median(quantity) AS mq, median(discount) AS md FROM c GROUP BY 1, 2), k AS (SELECT c.*, (quantity - mq) ** 2 + (discount - md) ** 2 AS far FROM c JOIN m ON c.px = m.px AND c.period = m.period)
    SELECT px, period, arg_min(quantity, (far, ts)) AS quantity, arg_min(discount, (far, ts)) AS discount FROM k GROUP BY 1, 2""",
    "quantity discount",
)
R.add(
    "regularize_fill_linear", lambda s, d: T.fill_linear(T.regularize(obs(s, d), "month"), 200),
    f"""WITH {MONTHS}, p AS (SELECT g.px, g.period, median(value) AS v, g.period - DATE '1970-01-01' AS d FROM g LEFT JOIN r ON g.px = r.px AND g.period = r.period GROUP BY 1, 2),
    f AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN {{'d': d, 'v': v}} END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a, first_value(CASE WHEN v IS NOT NULL THEN {{'d': d, 'v': v}} END IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS z FROM p WINDOW w AS (PARTITION BY px ORDER BY d))
    SELECT px, period, coalesce(v, CASE WHEN z.d - a.d <= 200 THEN a.v + (z.v - a.v) / nullif(z.d - a.d, 0) * (d - a.d) END) AS value FROM f""",
    "value",
)
R.add(
    "composite_best_pixel", lambda s, d: T.best_pixel(obs(s, d), 180),
    f"""SELECT px, year(ts)::INT AS year, max(greatest(0, 1 - abs(dayofyear(ts) - 180) / 183.0)) AS score, arg_max(value, (greatest(0, 1 - abs(dayofyear(ts) - 180) / 183.0), -epoch_us(ts))) AS value FROM ({OBS}) WHERE value IS NOT NULL GROUP BY 1, 2""",
    "score value",
)
R.add(
    "harmonize_sensors", lambda s, d: T.harmonize(_sensors(s, d), s.createDataFrame([("R", 0.9, 10.0), ("A", 1.1, -5.0)], "sensor string, gain double, offset double")),
    "SELECT l_suppkey::BIGINT AS px, l_shipdate AS ts, l_returnflag AS sensor, CASE l_returnflag WHEN 'R' THEN 0.9 * max(l_quantity) + 10 WHEN 'A' THEN 1.1 * max(l_quantity) - 5 ELSE max(l_quantity) END AS value FROM lineitem GROUP BY 1, 2, 3",
    "value",
)
R.add("desawtooth", lambda s, d: T.desawtooth(classes(s, d)), f"SELECT px, period, CASE WHEN a = b AND a <> class THEN a ELSE class END AS class FROM (SELECT *, lag(class) OVER w AS a, lead(class) OVER w AS b FROM ({CLASSES}) WINDOW w AS (PARTITION BY px ORDER BY period))")


def _items(s, d):
    from ..plans import bindings

    return bindings.items(s, d).rows.withColumnRenamed("px", "l_suppkey")


def _maps(s, d):
    return classes(s, d).groupBy("px", F.col("class").alias("map")).agg(F.max("period").alias("yod"))


def _sensors(s, d):
    from .common import table

    i = table(s, d, "lineitem")
    return i.groupBy(F.col("l_suppkey").alias("px"), F.col("l_shipdate").cast("timestamp").alias("ts"), F.col("l_returnflag").alias("sensor")).agg(F.max("l_quantity").alias("value"))

R.add("composite_around_day", lambda s, d: S.composite_around(obs(s, d), "1997-07-01", 120), f"SELECT px, avg(value) AS mean, median(value) AS median, count(value) AS n FROM ({OBS}) WHERE abs(ts::DATE - DATE '1997-07-01') <= 120 GROUP BY px", "mean median")
R.add(
    "gap_filling", lambda s, d: S.gap_filled(obs(s, d)),
    f"""WITH f AS (SELECT px, ts, epoch(ts) AS t, value, last_value(CASE WHEN value IS NOT NULL THEN {{'t': epoch(ts), 'v': value}} END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a,
      first_value(CASE WHEN value IS NOT NULL THEN {{'t': epoch(ts), 'v': value}} END IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS z FROM ({OBS}) WINDOW w AS (PARTITION BY px ORDER BY ts))
    SELECT px, ts, coalesce(value, a.v + (z.v - a.v) / nullif(z.t - a.t, 0) * (t - a.t), a.v, z.v) AS value FROM f""",
    "value",
)
R.add("display_stretch", lambda s, d: S.stretch(obs(s, d).withColumn("ts", F.date_trunc("month", "ts"))), f"SELECT date_trunc('month', ts)::TIMESTAMP AS ts, quantile_cont(value, 0.02) AS lo, quantile_cont(value, 0.98) AS hi FROM ({OBS}) GROUP BY 1", "lo hi")
R.add("scatter_of_dates", lambda s, d: T.regularize(obs(s, d), "year").alias("a").join(T.regularize(obs(s, d), "year").alias("b"), "px").where("a.period = '1996-01-01' and b.period = '1998-01-01'").select("px", F.col("a.value").alias("x"), F.col("b.value").alias("y")), f"SELECT px, median(value) FILTER (year(ts) = 1996) AS x, median(value) FILTER (year(ts) = 1998) AS y FROM ({OBS}) GROUP BY px HAVING min(year(ts)) <= 1996 AND max(year(ts)) >= 1998", "x y")
