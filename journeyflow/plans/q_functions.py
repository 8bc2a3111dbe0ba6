"""Catalogue: scalar functions (I1-I9, I11-I13) applied to the J2 journey frame."""

from __future__ import annotations

from pyspark.sql import functions as F

from journeyflow.functions import scalar as S
from journeyflow.operators.snapshot import journey_frame
from journeyflow.plans.common import ev, sql_u
from journeyflow.plans.registry import query
from journeyflow.plans.sql import with_ctes

_FR = """, fr AS (SELECT id, min(us) AS s, max(us) AS l, make_timestamp(max(us)) AS lt, count(*) AS n FROM j2 GROUP BY id)"""


def _fr(spark, sf):
    return journey_frame(ev(spark, sf, "j2")).select(
        "id", F.col("start_us").alias("s"), F.col("last_us").alias("l"), F.timestamp_micros("last_us").alias("lt"),
        F.col("n_actions").alias("n"))


@query("i1_durations", sql=with_ctes("j2") + _FR + """ SELECT id, greatest((l - s) // 1000000, 0) AS whole_seconds,
       greatest((l - s) / 86400000000.0, 0.0) AS days, (s - l) // 1000000 AS signed_seconds FROM fr""")
def i1(spark, sf):
    f = _fr(spark, sf)
    return f.select("id", S.seconds_between("l", "s").alias("whole_seconds"), S.days_between("l", "s").alias("days"),
                    S.seconds_between("s", "l", clamp=False).alias("signed_seconds"))


@query("i2_calendar_parts", sql=with_ctes("j2") + _FR + """ SELECT id, CAST(hour(lt) AS INTEGER) AS hour, CAST(isodow(lt) - 1 AS INTEGER) AS weekday,
       CAST(month(lt) AS INTEGER) AS month, CAST(dayofyear(lt) AS INTEGER) AS dayofyear FROM fr""")
def i2(spark, sf):
    return _fr(spark, sf).select("id", *S.calendar_parts("lt"))


@query("i3_cyclic", sql=with_ctes("j2") + _FR + """ SELECT id, sin(2 * pi() * hour(lt) / 24) AS hour_sin, cos(2 * pi() * hour(lt) / 24) AS hour_cos,
       sin(2 * pi() * (isodow(lt) - 1) / 7) AS dow_sin, cos(2 * pi() * (isodow(lt) - 1) / 7) AS dow_cos FROM fr""")
def i3(spark, sf):
    f = _fr(spark, sf)
    hs, hc = S.cyclic(F.hour("lt"), 24)
    ds, dc = S.cyclic(F.weekday("lt"), 7)
    return f.select("id", hs.alias("hour_sin"), hc.alias("hour_cos"), ds.alias("dow_sin"), dc.alias("dow_cos"))


@query("i4_log1p", sql=with_ctes("j2") + _FR + """ SELECT id, ln(1 + n) AS log1p_n,
       sign((s - l) / 1e6) * ln(1 + abs((s - l) / 1e6)) AS signed_log1p FROM fr""")
def i4(spark, sf):
    f = _fr(spark, sf)
    return f.select("id", S.log1p("n").alias("log1p_n"), S.signed_log1p((F.col("s") - F.col("l")) / 1e6).alias("signed_log1p"))


@query("i5_ceil_days", sql=with_ctes("j2") + _FR + " SELECT id, CAST(greatest(1, ceil(((l - s) / 1e6) / 86400.0)) AS INTEGER) AS ceil_days FROM fr")
def i5(spark, sf):
    return _fr(spark, sf).select("id", S.ceil_days((F.col("l") - F.col("s")) / 1e6).alias("ceil_days"))


@query("i6_safe_ratio", sql=with_ctes("j2") + _FR + " SELECT id, n / ((l - s) / 86400000000.0 + 1e-5) AS events_per_day FROM fr")
def i6(spark, sf):
    return _fr(spark, sf).select("id", S.safe_ratio("n", (F.col("l") - F.col("s")) / 86400e6).alias("events_per_day"))


@query("i7_clip_prob", sql=with_ctes("j2") + _FR + " SELECT id, least(greatest(1.0 / n - 0.5, 1e-6), 1 - 1e-6) AS p FROM fr")
def i7(spark, sf):
    return _fr(spark, sf).select("id", S.clip_prob(1.0 / F.col("n") - 0.5).alias("p"))


@query("i8_month_key", sql=with_ctes("j2") + _FR + " SELECT id, CAST(year(lt) AS VARCHAR) || '-M' || CAST(month(lt) AS VARCHAR) AS month_key FROM fr")
def i8(spark, sf):
    return _fr(spark, sf).select("id", S.month_key("lt").alias("month_key"))


@query("i9_hash_uniform", sql=with_ctes("j2") + _FR + f" SELECT id, {sql_u('id', 42)} AS u42, {sql_u('id', 7)} AS u7 FROM fr")
def i9(spark, sf):
    return _fr(spark, sf).select("id", S.hash_uniform("id", 42).alias("u42"), S.hash_uniform("id", 7).alias("u7"))


@query("i11_strip_prefix", sql="""SELECT feature, CASE WHEN starts_with(feature, 'log1p_') THEN substr(feature, 7) ELSE feature END AS short_name
FROM (SELECT o_orderpriority AS feature FROM orders UNION ALL SELECT 'log1p_' || o_orderstatus FROM orders)""")
def i11(spark, sf):
    from journeyflow.plans.common import table

    o = table(spark, sf, "orders")
    names = o.select(F.col("o_orderpriority").alias("feature")).unionAll(o.select(F.concat(F.lit("log1p_"), "o_orderstatus").alias("feature")))
    return names.select("feature", S.strip_prefix("feature", "log1p_").alias("short_name"))


@query("i12_linspace", sql=with_ctes("j2") + _FR + """ SELECT id, CAST(i AS INTEGER) AS i, s / 86400e6 + CAST(i AS DOUBLE) * ((l / 86400e6 - s / 86400e6) / 4.0) AS v
FROM fr, range(0, 5) t(i)""")
def i12(spark, sf):
    f = _fr(spark, sf)
    grid = S.linspace(F.col("s") / 86400e6, F.col("l") / 86400e6, 5)
    return f.select("id", F.posexplode(grid).alias("i", "v")).select("id", F.col("i").cast("int").alias("i"), "v")


@query("i13_sigmoid_softmax", sql=with_ctes("j2") + _FR + """ SELECT id, 1 / (1 + exp(-(ln(n) - 2))) AS sigmoid,
       1 / (1 + exp(-((ln(n) - 2) - 0.5))) AS softmax_second FROM fr""")
def i13(spark, sf):
    f = _fr(spark, sf)
    z = F.log(F.col("n").cast("double")) - 2
    return f.select("id", S.sigmoid(z).alias("sigmoid"), S.softmax2(F.lit(0.5), z).alias("softmax_second"))
