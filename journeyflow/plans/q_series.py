"""Catalogue: time series (T1-T15, Q13) on the daily shipped-lines series S1."""

from __future__ import annotations

from pyspark.sql import functions as F

from journeyflow.operators import series as ts
from journeyflow.operators.stats import centered_mean
from journeyflow.plans.registry import query
from journeyflow.plans.sql import with_ctes
from journeyflow.sources.bindings import daily_lines

_DEC = """p AS (SELECT series, date, y, CAST(row_number() OVER (PARTITION BY series ORDER BY date) AS INTEGER) AS pos,
       CASE WHEN count(y) OVER w = 365 THEN avg(y) OVER w END AS trend
  FROM {src} WINDOW w AS (PARTITION BY series ORDER BY date ROWS BETWEEN 182 PRECEDING AND 182 FOLLOWING)),
a7 AS (SELECT series, (pos - 1) % 7 AS phase, avg(y - trend) AS s7 FROM p GROUP BY ALL),
a12 AS (SELECT series, (pos - 1) % 12 AS phase, avg(y - trend) AS s12 FROM p GROUP BY ALL),
m7 AS (SELECT series, phase, s / avg(s) OVER (PARTITION BY series) AS m7 FROM (SELECT series, (pos - 1) % 7 AS phase, avg(y / trend) AS s FROM p GROUP BY ALL)),
dec AS (SELECT p.*, a7.s7, a12.s12, m7.m7, y - trend - s7 - s12 AS remainder_add, y / (m7.m7 * trend) AS remainder_mult
  FROM p JOIN a7 ON p.series = a7.series AND (p.pos - 1) % 7 = a7.phase JOIN a12 ON p.series = a12.series AND (p.pos - 1) % 12 = a12.phase
  JOIN m7 ON p.series = m7.series AND (p.pos - 1) % 7 = m7.phase)"""

_FIT = """tc AS (SELECT series, trend, CAST(row_number() OVER (PARTITION BY series ORDER BY date) - 1 AS DOUBLE) AS t FROM dec WHERE trend IS NOT NULL),
fit AS (SELECT series, regr_slope(trend, t) AS slope, regr_intercept(trend, t) AS intercept, count(*) AS n_tc FROM tc GROUP BY series),
lt AS (SELECT series, CAST(h AS INTEGER) AS h, slope, intercept, intercept + slope * (n_tc + h - 1) AS trend_forecast FROM fit, range(1, {hp1}) r(h)),
fi AS (SELECT series, CAST(h AS INTEGER) AS h, mx + to_days(CAST(h AS INTEGER)) AS date, CAST((h - 1) % 7 AS INTEGER) AS phase7,
       CAST((h - 1) % 12 AS INTEGER) AS phase12 FROM (SELECT series, max(date) AS mx FROM {src} GROUP BY series), range(1, {hp1}) r(h)),
fc AS (SELECT fi.series, fi.h, fi.date, lt.trend_forecast, a7.s7, a12.s12,
       greatest(lt.trend_forecast + coalesce(a7.s7, 0.0) + coalesce(a12.s12, 0.0), 0.0) AS forecast
  FROM fi JOIN lt ON fi.series = lt.series AND fi.h = lt.h
  LEFT JOIN a7 ON fi.series = a7.series AND fi.phase7 = a7.phase LEFT JOIN a12 ON fi.series = a12.series AND fi.phase12 = a12.phase)"""


def _s1(spark, sf):
    return daily_lines(spark, sf)


@query("t1_ts_split", sql=with_ctes("s1") + """SELECT series, date, y, CAST(row_number() OVER (PARTITION BY series ORDER BY date) AS INTEGER) AS pos,
       CASE WHEN row_number() OVER (PARTITION BY series ORDER BY date) <= 2000 THEN 'train' ELSE 'test' END AS split FROM s1""")
def t1(spark, sf):
    return ts.ts_split(_s1(spark, sf), 2000)


@query("t2_standardize", sql=with_ctes("s1f") + """SELECT series, date, y, (y - avg(y) OVER (PARTITION BY series)) / stddev_samp(y) OVER (PARTITION BY series) AS y_std FROM s1f""")
def t2(spark, sf):
    return ts.standardize(daily_lines(spark, sf, by_flag=True))


_ACF = with_ctes("s1") + """, d AS (SELECT series, row_number() OVER (PARTITION BY series ORDER BY date) AS pos, y - avg(y) OVER (PARTITION BY series) AS d FROM s1)
SELECT a.series, CAST(k AS INTEGER) AS lag, sum(a.d * b.d) / any_value(den.v) AS acf
FROM d a, range(0, 31) r(k), d b, (SELECT series, sum(d * d) AS v FROM d GROUP BY series) den
WHERE b.series = a.series AND b.pos = a.pos + k AND den.series = a.series GROUP BY a.series, k"""


@query("t3_acf", sql=_ACF)
def t3(spark, sf):
    return ts.acf(_s1(spark, sf), 30)


@query("t4_pacf", sql=f"""WITH RECURSIVE a AS MATERIALIZED (SELECT * FROM ({_ACF}) AS acf_rows),
r AS MATERIALIZED (SELECT series, list(acf ORDER BY lag) AS r FROM a GROUP BY series),
x(series, k, phi, v, pk) AS (
  SELECT series, 0, CAST([] AS DOUBLE[]), CAST(1 AS DOUBLE), CAST(1 AS DOUBLE) FROM r
  UNION ALL
  SELECT series, k + 1, list_append(list_transform(generate_series(1, k), lambda j: phi[j] - p * phi[k + 1 - j]), p), v * (1 - p * p), p
  FROM (SELECT x.*, (r.r[k + 2] - coalesce(list_sum(list_transform(generate_series(1, k), lambda j: x.phi[j] * r.r[k + 2 - j])), 0)) / x.v AS p
        FROM x JOIN r ON r.series = x.series WHERE x.k < 30) AS s)
SELECT series, CAST(k AS INTEGER) AS lag, pk AS pacf FROM x""")
def t4(spark, sf):
    return ts.pacf(_s1(spark, sf), 30)


@query("t5_trend", sql=with_ctes("s1f") + """SELECT series, date, y, CASE WHEN count(y) OVER w = 365 THEN avg(y) OVER w END AS trend
FROM s1f WINDOW w AS (PARTITION BY series ORDER BY date ROWS BETWEEN 182 PRECEDING AND 182 FOLLOWING)""")
def t5(spark, sf):
    return centered_mean(daily_lines(spark, sf, by_flag=True), 365)


@query("t6_seasonal_additive", sql=with_ctes("s1", extra=_DEC.format(src="s1")) + """SELECT coalesce(a7.series, a12.series) AS series, CAST(coalesce(a7.phase, a12.phase) AS INTEGER) AS phase, a7.s7, a12.s12
FROM a7 FULL JOIN a12 ON a7.series = a12.series AND a7.phase = a12.phase""")
def t6(spark, sf):
    p = ts.with_position(centered_mean(_s1(spark, sf), 365))
    return ts.seasonal_additive(p, 7).join(ts.seasonal_additive(p, 12), ["series", "phase"], "full")


@query("t7_seasonal_multiplicative", sql=with_ctes("s1", extra=_DEC.format(src="s1")) + "SELECT series, CAST(phase AS INTEGER) AS phase, m7 FROM m7")
def t7(spark, sf):
    return ts.seasonal_multiplicative(ts.with_position(centered_mean(_s1(spark, sf), 365)), 7)


@query("t8_decompose", sql=with_ctes("s1f", extra=_DEC.format(src="s1f")) + "SELECT * FROM dec")
def t8(spark, sf):
    return ts.decompose(daily_lines(spark, sf, by_flag=True))


@query("t9_linear_trend", sql=with_ctes("s1", extra=_DEC.format(src="s1") + ",\n" + _FIT.format(hp1=61, src="s1")) + "SELECT * FROM lt")
def t9(spark, sf):
    return ts.linear_trend(ts.decompose(_s1(spark, sf)), 60)


@query("t10_future_index", sql=with_ctes("s1f", extra=_DEC.format(src="s1f") + ",\n" + _FIT.format(hp1=91, src="s1f")) + "SELECT * FROM fi")
def t10(spark, sf):
    return ts.future_index(daily_lines(spark, sf, by_flag=True), 90)


@query("t11_forecast", sql=with_ctes("s1", extra=_DEC.format(src="s1") + ",\n" + _FIT.format(hp1=121, src="s1")) + "SELECT * FROM fc")
def t11(spark, sf):
    return ts.forecast(_s1(spark, sf), 120)


@query("t12_dickey_fuller", sql=with_ctes("s1f", extra=_DEC.format(src="s1f")) + """, x AS (SELECT series, v, l, v - l AS dx FROM (
  SELECT series, remainder_add AS v, lag(remainder_add) OVER (PARTITION BY series ORDER BY date) AS l FROM dec WHERE remainder_add IS NOT NULL) WHERE l IS NOT NULL)
SELECT series, CAST(regr_count(dx, l) AS BIGINT) AS n, regr_slope(dx, l) AS slope,
       regr_slope(dx, l) / sqrt((regr_syy(dx, l) - regr_slope(dx, l) * regr_slope(dx, l) * regr_sxx(dx, l)) / (regr_count(dx, l) - 2) / regr_sxx(dx, l)) AS df_stat
FROM x GROUP BY series""")
def t12(spark, sf):
    d = ts.dickey_fuller(ts.decompose(daily_lines(spark, sf, by_flag=True)))
    return d.select("series", F.col("n").cast("long").alias("n"), "slope", "df_stat")


@query("t13_garch_grid")
def t13(spark, sf):
    return ts.garch_grid(ts.decompose(_s1(spark, sf)), 30)


@query("t14_forecast_noise", sql=with_ctes("s1", extra=_DEC.format(src="s1") + ",\n" + _FIT.format(hp1=61, src="s1")) + """,
sd AS (SELECT series, stddev_samp(remainder_add) AS sd FROM dec GROUP BY series),
z AS (SELECT fc.*, sd.sd, md5(fc.series || '|' || CAST(fc.h AS VARCHAR) || '|42') AS hx FROM fc JOIN sd ON fc.series = sd.series)
SELECT series, h, date, trend_forecast, s7, s12,
       greatest(trend_forecast + coalesce(s7, 0.0) + coalesce(s12, 0.0)
         + sd * sqrt(-2.0 * ln(greatest(CAST(('0x' || substr(hx, 1, 8)) AS BIGINT) / 4294967296.0, 1e-12)))
              * cos(2.0 * pi() * (CAST(('0x' || substr(hx, 9, 8)) AS BIGINT) / 4294967296.0)), 0.0) AS forecast FROM z""")
def t14(spark, sf):
    return ts.forecast(_s1(spark, sf), 60, noise_sd="remainder", noise_seed=42)


@query("t15_calendar_forecast")
def t15(spark, sf):
    return ts.calendar_forecast(_s1(spark, sf), 90)


def _fixed_holidays(spark, df, horizon):
    """New Year, Independence Day and Christmas from the first day of ``df`` to ``horizon`` days after its last."""
    ends = df.agg(F.min("date").alias("a"), F.timestamp_add("DAY", F.lit(horizon), F.max("date")).alias("b"))  # one row
    days = ends.select(F.explode(F.sequence(F.to_date("a"), F.to_date("b"))).alias("d"))
    return days.where(F.date_format("d", "MM-dd").isin("01-01", "07-04", "12-25")).select(F.col("d").cast("timestamp_ntz").alias("date"))


_T15_INPUTS = ["const", "trend", "wd1", "wd2", "wd3", "wd4", "fs1", "fc1", "fs2", "fc2", "fs3", "fc3", "holiday"]


@query("t15_normal_equations", sql=with_ctes("s1f") + f"""SELECT s.series, v.x AS input, CAST(count(*) AS BIGINT) AS n_days, TRUE AS orthogonal
FROM s1f s, (VALUES {", ".join(f"('{x}')" for x in _T15_INPUTS)}) v(x) WHERE isodow(date) < 6 GROUP BY s.series, v.x""")
def t15e(spark, sf):
    """The residuals of every series' own fit are orthogonal to each calendar input."""
    df = daily_lines(spark, sf, by_flag=True)
    d, inputs = ts.calendar_design(df.where(F.weekday("date") < 5).withColumn("v", F.log1p("y")), _fixed_holidays(spark, df, 90))
    r = ts.fitted(d, ts.least_squares(d, inputs, "v"), inputs)
    sums = r.groupBy("series").agg(F.count("*").alias("n_days"), *[F.avg((F.col("v") - F.col("fitted")) * F.col(x)).alias(x) for x in inputs])
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("input"), (F.abs(F.col(x)) < 1e-8).alias("orthogonal")) for x in inputs])).alias("e")
    return sums.select("series", "n_days", each).select("series", "e.input", "n_days", "e.orthogonal")


@query("t15_forecast_by_series", sql=with_ctes("s1f") + """, l AS (SELECT series, max(date) AS mx FROM s1f GROUP BY series)
SELECT series, mx + to_days(CAST(h AS INTEGER)) AS date, isodow(mx + to_days(CAST(h AS INTEGER))) < 6 AS business, TRUE AS in_order, TRUE AS zero_on_weekends, TRUE AS own_level
FROM l, range(1, 91) r(h)""")
def t15s(spark, sf):
    df = daily_lines(spark, sf, by_flag=True)
    f = ts.calendar_forecast(df, 90, _fixed_holidays(spark, df, 90))
    levels = f.where("mean > 0").groupBy("series").agg(F.avg("mean").alias("m"))  # a row per series
    other = levels.select(F.col("series").alias("s2"), F.col("m").alias("m2"))
    alike = levels.join(other, (F.col("series") < F.col("s2")) & (F.abs(F.col("m") - F.col("m2")) < 1e-6)).agg(F.count("*").alias("n_alike"))
    business = F.weekday("date") < 5
    return f.crossJoin(alike).select(
        "series", "date", business.alias("business"), ((F.col("lower") <= F.col("mean")) & (F.col("mean") <= F.col("upper"))).alias("in_order"),
        (business | (F.col("mean") == 0)).alias("zero_on_weekends"), (F.col("n_alike") == 0).alias("own_level"))


@query("q13_holdout_mse", sql=with_ctes("s1") + """, tr AS (SELECT * FROM s1 QUALIFY row_number() OVER (PARTITION BY series ORDER BY date) <= 2000),
te AS (SELECT series, date, y, row_number() OVER (PARTITION BY series ORDER BY date) - 2000 AS h FROM s1
       QUALIFY row_number() OVER (PARTITION BY series ORDER BY date) > 2000),
""" + _DEC.format(src="tr") + ",\n" + _FIT.format(hp1=1000, src="tr") + """
SELECT te.series, avg((fc.forecast - te.y) * (fc.forecast - te.y)) AS mse FROM te JOIN fc ON te.series = fc.series AND te.h = fc.h GROUP BY te.series""")
def q13(spark, sf):
    from journeyflow.operators.metrics import mse

    sp = ts.ts_split(_s1(spark, sf), 2000)
    train = sp.where("split = 'train'").select("series", "date", "y")
    test = sp.where("split = 'test'").select("series", (F.col("pos") - 2000).cast("int").alias("h"), "y")
    fc = ts.forecast(train, 999).select("series", "h", "forecast")
    return mse(test.join(fc, ["series", "h"]), "forecast", "y", ["series"])
