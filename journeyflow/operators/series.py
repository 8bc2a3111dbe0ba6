"""Daily time series: decomposition, trend, seasonality, forecast (inventory T1-T15, Q13).

Input is a long table ``(series, date, y)``, one row per series and day, produced by an
aggregate over the events (``daily_series``). Windows here are partitioned by series and
run over days, i.e. over a few thousand rows per series whatever the event volume.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from journeyflow.functions.scalar import hash_uniform_pair
from journeyflow.operators.stats import centered_mean



def _w():
    return Window.partitionBy("series").orderBy("date")


def with_position(df: DataFrame) -> DataFrame:
    """1-based position of each day inside its series."""
    return df.withColumn("pos", F.row_number().over(_w()))


def ts_split(df: DataFrame, n_train: int) -> DataFrame:
    """The first ``n_train`` days are 'train', the rest 'test' (no overlapping day)."""
    return with_position(df).withColumn("split", F.when(F.col("pos") <= n_train, "train").otherwise("test"))


def standardize(df: DataFrame, value: str = "y") -> DataFrame:
    """(y - mean) / sample std per series."""
    w = Window.partitionBy("series")
    return df.withColumn(f"{value}_std", (F.col(value) - F.avg(value).over(w)) / F.stddev_samp(value).over(w))


def acf(df: DataFrame, max_lag: int = 30, value: str = "y") -> DataFrame:
    """Autocorrelation r_k = sum_t (y_t - m)(y_{t+k} - m) / sum_t (y_t - m)^2, k = 0..max_lag.

    Each day is joined with the day k positions later (equi-join on series and position)."""
    p = with_position(df)
    m = p.groupBy("series").agg(F.avg(value).alias("_m"))
    d = p.join(m, "series").select("series", "pos", (F.col(value) - F.col("_m")).alias("d"))
    den = d.groupBy("series").agg(F.sum(F.col("d") * F.col("d")).alias("_den"))
    lags = d.select("series", F.col("pos").alias("pos0"), F.col("d").alias("d0"), F.explode(F.sequence(F.lit(0), F.lit(max_lag))).alias("lag"))
    ahead = d.select(F.col("series").alias("s1"), F.col("pos").alias("pos1"), F.col("d").alias("d1"))
    j = lags.join(ahead, (F.col("series") == F.col("s1")) & (F.col("pos1") == F.col("pos0") + F.col("lag"))).select(
        "series", "lag", (F.col("d0") * F.col("d1")).alias("prod"))
    num = j.groupBy("series", "lag").agg(F.sum("prod").alias("_num"))
    return num.join(den, "series").select("series", F.col("lag").cast("int").alias("lag"), (F.col("_num") / F.col("_den")).alias("acf"))


def pacf(df: DataFrame, max_lag: int = 30, value: str = "y") -> DataFrame:
    """T4: partial autocorrelation by Durbin-Levinson on the ACF (Yule-Walker on the biased ACF).

    The recursion is a fold over the lags of each series' array of ``max_lag`` + 1 values; its
    state are the coefficients so far, the error variance and the partial autocorrelations. NULL
    where the variance is 0."""
    r = acf(df, max_lag, value).groupBy("series").agg(F.transform(F.sort_array(F.collect_list(F.struct("lag", "acf"))), lambda x: x["acf"]).alias("r"))
    none = F.array().cast("array<double>")
    one = F.lit(1.0)

    def step(state: Column, k: Column) -> Column:
        phi = state["phi"]
        known = F.aggregate(F.zip_with(phi, F.reverse(F.slice("r", 2, k - 1)), lambda p, q: p * q), F.lit(0.0), lambda t, x: t + x)
        new = F.try_divide(F.get("r", k) - known, state["v"])

        def with_new(p: Column) -> Column:
            kept = F.zip_with(phi, F.reverse(phi), lambda x, y: x - p * y)
            return F.struct(F.concat(kept, F.array(p)).alias("phi"), (state["v"] * (1 - p * p)).alias("v"), F.concat(state["out"], F.array(p)).alias("out"))

        return F.get(F.transform(F.array(new), with_new), F.lit(0))  # names the new coefficient once

    start = F.struct(none.alias("phi"), one.alias("v"), F.array(one).alias("out"))
    lags = F.slice(F.sequence(F.lit(0), F.size("r") - 1), 2, F.greatest(F.size("r") - 1, F.lit(0)))
    folded = r.select("series", F.posexplode(F.aggregate(lags, start, step)["out"]).alias("lag", "pacf"))
    return folded.select("series", F.col("lag").cast("int").alias("lag"), "pacf")


def seasonal_additive(df: DataFrame, k: int, trend: str = "trend", value: str = "y", name: str | None = None) -> DataFrame:
    """Mean of (y - trend) per phase (pos - 1) mod k, NULL residuals skipped. -> (series, phase, s)."""
    p = df if "pos" in df.columns else with_position(df)
    return p.groupBy("series", ((F.col("pos") - 1) % k).cast("int").alias("phase")).agg(
        F.avg(F.col(value) - F.col(trend)).alias(name or f"s{k}"))


def seasonal_multiplicative(df: DataFrame, k: int = 7, trend: str = "trend", value: str = "y") -> DataFrame:
    """Mean of y / trend per phase, normalised so the k factors average 1."""
    p = df if "pos" in df.columns else with_position(df)
    s = p.groupBy("series", ((F.col("pos") - 1) % k).cast("int").alias("phase")).agg(F.avg(F.col(value) / F.col(trend)).alias("_s"))
    return s.withColumn(f"m{k}", F.col("_s") / F.avg("_s").over(Window.partitionBy("series"))).drop("_s")  # k rows per series


def decompose(df: DataFrame, window: int = 365, periods: Sequence[int] = (7, 12)) -> DataFrame:
    """T5 + T6-T8: trend (centred mean), additive seasonal components for each period, the
    multiplicative weekly factor, and the additive / multiplicative remainders."""
    p = with_position(centered_mean(df, window))
    out = p
    for k in periods:
        s = seasonal_additive(p, k)
        out = out.withColumn("phase", ((F.col("pos") - 1) % k).cast("int")).join(s, ["series", "phase"]).drop("phase")
    m = seasonal_multiplicative(p, periods[0])
    out = out.withColumn("phase", ((F.col("pos") - 1) % periods[0]).cast("int")).join(m, ["series", "phase"]).drop("phase")
    rem = F.col("y") - F.col("trend")
    for k in periods:
        rem = rem - F.col(f"s{k}")
    return out.withColumn("remainder_add", rem).withColumn(
        "remainder_mult", F.col("y") / (F.col(f"m{periods[0]}") * F.col("trend")))


def linear_trend(df: DataFrame, horizon: int, trend: str = "trend") -> DataFrame:
    """Least-squares line through the non-NULL trend values (t = 0, 1, ...), extrapolated
    ``horizon`` steps past the last one. -> (series, h, trend_forecast), h = 1..horizon."""
    tc = df.where(F.col(trend).isNotNull()).withColumn("t", (F.row_number().over(_w()) - 1).cast("double"))
    fit = tc.groupBy("series").agg(F.regr_slope(trend, "t").alias("slope"), F.regr_intercept(trend, "t").alias("intercept"),
                                   F.count(F.lit(1)).alias("n_tc"))
    h = fit.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"))
    return h.select("series", F.col("h").cast("int").alias("h"), "slope", "intercept",
                    (F.col("intercept") + F.col("slope") * (F.col("n_tc") + F.col("h") - 1)).alias("trend_forecast"))


def future_index(df: DataFrame, horizon: int, periods: Sequence[int] = (7, 12)) -> DataFrame:
    """The ``horizon`` days after each series' last day, with h and the seasonal phase of
    each period (tiled from phase 0 over the horizon, as the seasonal profile is laid out)."""
    last = df.groupBy("series").agg(F.max("date").alias("_last"))
    h = last.select("series", "_last", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"))
    return h.select("series", F.col("h").cast("int").alias("h"),
                    F.timestamp_add("DAY", F.col("h"), F.col("_last")).alias("date"),
                    *[((F.col("h") - 1) % k).cast("int").alias(f"phase{k}") for k in periods])


def forecast(df: DataFrame, horizon: int, window: int = 365, periods: Sequence[int] = (7, 12),
             noise_sd: str | float | None = None, noise_seed: int | None = None) -> DataFrame:
    """T11 (+T14): forecast = sum of seasonal components + extrapolated trend (+ Gaussian
    noise from a hashed Box-Muller draw), floored at 0."""
    dec = decompose(df, window, periods)
    fut = future_index(df, horizon, periods)
    out = fut.join(linear_trend(dec, horizon).select("series", "h", "trend_forecast"), ["series", "h"])
    for k in periods:
        s = seasonal_additive(dec, k).withColumnRenamed("phase", f"phase{k}")
        out = out.join(s, ["series", f"phase{k}"], "left")
    val = F.col("trend_forecast")
    for k in periods:
        val = val + F.coalesce(F.col(f"s{k}"), F.lit(0.0))
    if noise_seed is not None:
        if isinstance(noise_sd, str) and noise_sd == "remainder":
            sd = dec.groupBy("series").agg(F.stddev_samp("remainder_add").alias("_sd"))
            out = out.join(sd, "series")
            sd_c = F.col("_sd")
        else:
            sd_c = F.lit(float(noise_sd or 0.0))
        u1, u2 = hash_uniform_pair(F.concat(F.col("series"), F.lit("|"), F.col("h").cast("string")), noise_seed)
        z = F.sqrt(-2.0 * F.log(F.greatest(u1, F.lit(1e-12)))) * F.cos(2.0 * math.pi * u2)
        val = val + sd_c * z
    return out.select("series", "h", F.col("date"), "trend_forecast", *[f"s{k}" for k in periods],
                      F.greatest(val, F.lit(0.0)).alias("forecast"))


def dickey_fuller(df: DataFrame, value: str = "remainder_add") -> DataFrame:
    """Lag-0 Dickey-Fuller t statistic: regress dx_t on x_{t-1} with a constant;
    t = slope / se(slope). No lag augmentation, no p-value."""
    x = df.where(F.col(value).isNotNull()).withColumn("_lag", F.lag(value).over(_w())).where(F.col("_lag").isNotNull())
    x = x.withColumn("_dx", F.col(value) - F.col("_lag"))
    g = x.groupBy("series").agg(F.regr_slope("_dx", "_lag").alias("slope"), F.regr_sxx("_dx", "_lag").alias("sxx"),
                                F.regr_syy("_dx", "_lag").alias("syy"), F.regr_count("_dx", "_lag").alias("n"))
    ssr = F.col("syy") - F.col("slope") * F.col("slope") * F.col("sxx")
    se = F.sqrt(ssr / (F.col("n") - 2) / F.col("sxx"))
    return g.select("series", "n", "slope", (F.col("slope") / se).alias("df_stat"))


def garch_grid(df: DataFrame, horizon: int, alphas: Sequence[float] = (0.05, 0.1, 0.15, 0.2),
               betas: Sequence[float] = (0.6, 0.7, 0.8, 0.85), value: str = "remainder_add") -> DataFrame:
    """GARCH(1,1) variance forecast by grid search with variance targeting.

    omega = var * (1 - a - b); the Gaussian log-likelihood of each (a, b) is an ``aggregate``
    over the series' residual array (one array per series: its days, bounded); the best pair
    gives sigma^2_{T+h} = var + (a + b)^(h-1) (sigma^2_{T+1} - var)."""
    r = df.where(F.col(value).isNotNull())
    per = r.groupBy("series").agg(F.array_sort(F.collect_list(F.struct("date", F.col(value).alias("e")))).alias("_a"),
                                  F.var_pop(value).alias("var"), F.avg(value).alias("mu"))
    per = per.select("series", "var", "mu", F.transform("_a", lambda s: s["e"]).alias("e"))
    grid = df.sparkSession.createDataFrame([(a, b) for a in alphas for b in betas if a + b < 1], "a double, b double")
    j = per.crossJoin(F.broadcast(grid))
    omega = F.col("var") * (1 - F.col("a") - F.col("b"))
    init = F.struct(F.col("var").alias("s2"), F.lit(0.0).alias("ll"), F.lit(0.0).alias("last_e2"))
    acc = F.aggregate(
        "e", init,
        lambda st, x: F.struct(
            (omega + F.col("a") * (x - F.col("mu")) * (x - F.col("mu")) + F.col("b") * st["s2"]).alias("s2"),
            (st["ll"] - 0.5 * (F.log(2 * math.pi * st["s2"]) + (x - F.col("mu")) * (x - F.col("mu")) / st["s2"])).alias("ll"),
            ((x - F.col("mu")) * (x - F.col("mu"))).alias("last_e2")))
    fitted = j.select("series", "a", "b", "var", acc.alias("st"))
    w = Window.partitionBy("series").orderBy(F.col("st.ll").desc(), "a", "b")  # grid rows per series
    best = fitted.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    h = best.select("series", "a", "b", "var", F.col("st.s2").alias("s2_next"), F.col("st.ll").alias("loglik"),
                    F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"))
    var_h = F.col("var") + F.pow(F.col("a") + F.col("b"), F.col("h") - 1) * (F.col("s2_next") - F.col("var"))
    return h.select("series", "a", "b", "loglik", F.col("h").cast("int").alias("h"), var_h.alias("variance"), F.sqrt(var_h).alias("sd"))


_EPOCH = "1970-01-01"


def calendar_design(df: DataFrame, holidays: DataFrame | None = None, fourier: int = 3) -> tuple[DataFrame, list[str]]:
    """The calendar inputs of each day: constant, trend, weekday, yearly Fourier terms and, if
    ``holidays`` (date) are given, whether it is one. Returns the table and the inputs' names."""
    day = F.timestamp_diff("DAY", F.lit(_EPOCH).cast("timestamp_ntz"), F.col("date")).cast("double")
    angle = 2 * math.pi * F.dayofyear("date").cast("double") / 365.25
    made = {"const": F.lit(1.0), "trend": (day - 10957.0) / 3652.5}  # decades since 2000
    made |= {f"wd{i}": (F.weekday("date") == i).cast("double") for i in range(1, 5)}
    made |= {f"{name}{k}": f(k * angle) for k in range(1, fourier + 1) for name, f in (("fs", F.sin), ("fc", F.cos))}
    out = df.withColumns(made)
    if holidays is not None:
        out = out.join(holidays.select("date", F.lit(1.0).alias("holiday")).distinct(), "date", "left").fillna(0.0, ["holiday"])
    return out, [*made, *(["holiday"] if holidays is not None else [])]


def least_squares(df: DataFrame, inputs: Sequence[str], target: str, key: str = "series") -> DataFrame:
    """Least squares per key: rows (key, n, coef), coef in order of ``inputs``.

    The sums of products of every two inputs and of the target are partial aggregates, so a key's
    rows are never together; each key's normal equations are solved from its one row of sums (the
    shortest solution where inputs depend on each other)."""
    names = [*inputs, target]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names) - (i == len(names) - 1))]
    sums = df.groupBy(key).agg(F.count("*").alias("n"), *[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"s{i}_{j}") for i, j in pairs])
    flat = sums.select(key, "n", F.array(*[F.col(f"s{i}_{j}") for i, j in pairs]).alias("s"))

    def solve(batches):
        import numpy as np

        m = len(inputs)
        for pdf in batches:
            out = []
            for s in pdf["s"]:
                gram, right = np.zeros((m, m)), np.zeros(m)
                for (i, j), v in zip(pairs, s, strict=True):
                    if j == m:
                        right[i] = v
                    else:
                        gram[i, j] = gram[j, i] = v
                scale = np.sqrt(np.maximum(np.diag(gram), 1e-300))
                x = np.linalg.lstsq(gram / np.outer(scale, scale), right / scale, rcond=1e-12)[0] / scale
                out.append([float(v) for v in x])
            yield pdf[[key, "n"]].assign(coef=out)

    kind = dict(df.dtypes)[key]
    return flat.mapInPandas(solve, f"`{key}` {kind}, n long, coef array<double>")


def fitted(df: DataFrame, coefs: DataFrame, inputs: Sequence[str], key: str = "series", name: str = "fitted") -> DataFrame:
    """``df`` with the value that its key's coefficients give."""
    value = sum((F.col("coef")[i] * F.col(c) for i, c in enumerate(inputs)), F.lit(0.0))
    return df.join(coefs, key).withColumn(name, value).drop("coef", "n")


def calendar_forecast(df: DataFrame, horizon: int, holidays: DataFrame | None = None, fourier: int = 3) -> DataFrame:
    """Business-day forecast on log scale from calendar inputs, one least-squares fit per
    series; mean, lower, upper (+-1.96 residual sd of the series); weekend days are 0. Returns
    (series, date, mean, lower, upper) for the next days."""
    train, inputs = calendar_design(df.where(F.weekday("date") < 5).withColumn("_log", F.log1p("y")), holidays, fourier)
    coefs = least_squares(train, inputs, "_log")
    spread = fitted(train, coefs, inputs).groupBy("series").agg(F.sqrt(F.avg((F.col("_log") - F.col("fitted")) ** 2)).alias("_sd"))
    future, _ = calendar_design(future_index(df, horizon, (7,)).select("series", "date"), holidays, fourier)
    pred = fitted(future, coefs, inputs).join(spread, "series")

    def level(shift: float) -> Column:
        return F.when(F.weekday("date") < 5, F.greatest(F.expm1(F.col("fitted") + shift * F.col("_sd")), F.lit(0.0))).otherwise(0.0)

    return pred.select("series", "date", level(0.0).alias("mean"), level(-1.96).alias("lower"), level(1.96).alias("upper"))
