"""Aggregations, windows, top-k and set operators (inventory E1-E23, F1-F9, G1-G4, H1).

Rules kept here: per-id work is a hash aggregate (partial aggregation before the shuffle)
or the skew-safe ordered scan; global windows only run on small, already aggregated
frames (event types, days of a series, distinct scores bucketed by value).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from journeyflow.operators.ordered import ordered_scan
from journeyflow.operators.project import bounded_broadcast
from journeyflow.operators.quantiles import column_percentiles, counted_percentiles, exact_percentiles, medians, percentile_names, value_counts
from journeyflow.operators.snapshot import journey_frame, with_us
from journeyflow.schema import DEFAULT_COLS, MOMENTUM_WINDOWS, SUCCESS_ID, US_PER_DAY, US_PER_HOUR, US_PER_SEC, JourneyCols, from_us


def log_summary(df: DataFrame, cols: JourneyCols = DEFAULT_COLS) -> DataFrame:
    """Rows, distinct ids, first and last timestamp of an event log."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct(cols.id).alias("n_ids"),
        F.min(cols.ts).cast("timestamp_ntz").alias("min_ts"),
        F.max(cols.ts).cast("timestamp_ntz").alias("max_ts"),
    )


def journey_stats(df: DataFrame, cols: JourneyCols = DEFAULT_COLS, success_id: int = SUCCESS_ID) -> DataFrame:
    """Per journey n_actions, start, end, duration in hours and days (fractional), success flag."""
    fr = journey_frame(df, cols, success_id)
    dur = (F.col("last_us") - F.col("start_us")).cast("double")
    return fr.select(
        cols.id,
        F.col("n_actions").cast("long").alias("n_actions"),
        from_us("start_us").alias("start_time"),
        from_us("last_us").alias("end_time"),
        (dur / float(US_PER_HOUR)).alias("duration_hours"),
        (dur / float(US_PER_DAY)).alias("duration_days"),
        F.col("success_us").isNotNull().alias("is_success"),
    )


def journey_population(stats: DataFrame, approx: bool = False, accuracy: int = 10000) -> DataFrame:
    """Mean / median / max of journey length and duration. Medians are exact and
    distributed (``exact_percentiles``); ``approx`` uses ``percentile_approx`` instead."""
    base = stats.agg(
        F.count(F.lit(1)).alias("n_journeys"),
        F.avg("n_actions").alias("mean_actions"),
        F.max("n_actions").alias("max_actions"),
        F.avg("duration_days").alias("mean_duration_days"),
        F.max("duration_days").alias("max_duration_days"),
    )
    if approx:
        med = stats.agg(F.percentile_approx("n_actions", 0.5, accuracy).cast("double").alias("median_actions"),
                        F.percentile_approx("duration_days", 0.5, accuracy).cast("double").alias("median_duration_days"))
    else:
        med = medians(stats, {"n_actions": "median_actions", "duration_days": "median_duration_days"})
    return base.crossJoin(med).select("n_journeys", "mean_actions", "median_actions", "max_actions", "mean_duration_days",
                                      "median_duration_days", "max_duration_days")


def conversion_rate(stats: DataFrame, flag: str = "is_success") -> DataFrame:
    """Share of journeys that reached success."""
    return stats.agg(
        F.count(F.lit(1)).alias("n_journeys"),
        F.count_if(F.col(flag)).alias("n_success"),
        F.avg(F.col(flag).cast("double")).alias("success_rate"),
    )


def outcome_comparison(stats: DataFrame, flag: str = "is_success") -> DataFrame:
    """E5: median / mean actions and duration (days) by outcome (exact distributed medians)."""
    base = stats.groupBy(F.col(flag).alias(flag)).agg(
        F.count(F.lit(1)).alias("n_journeys"),
        F.avg("n_actions").alias("mean_actions"),
        F.avg("duration_days").alias("mean_duration_days"),
    )
    med = medians(stats, {"n_actions": "median_actions", "duration_days": "median_duration_days"}, group=[flag])
    return base.join(med, flag, "left").select(
        flag, "n_journeys", "median_actions", "mean_actions", "median_duration_days", "mean_duration_days")


def event_counts(df: DataFrame, cols: JourneyCols = DEFAULT_COLS) -> DataFrame:
    """Events per event id."""
    return df.groupBy(cols.event).agg(F.count(F.lit(1)).alias("n"))


def event_shares(df: DataFrame, defs: DataFrame | None = None, how: str = "left", cols: JourneyCols = DEFAULT_COLS) -> DataFrame:
    """Event counts with their share of all events, optionally named via the
    definitions -- ``how='inner'`` drops ids without a definition."""
    c = event_counts(df, cols)
    tot = c.agg(F.sum("n").alias("_tot"))  # one row
    c = c.crossJoin(F.broadcast(tot)).withColumn("share", F.col("n") / F.col("_tot")).drop("_tot")
    if defs is not None:
        d = bounded_broadcast(defs).select(F.col("ed_id").alias(cols.event), "event_name", "stage")
        c = c.join(d, cols.event, how)
    return c


def top_events(df: DataFrame, defs: DataFrame, k: int = 10, how: str = "inner", cols: JourneyCols = DEFAULT_COLS) -> DataFrame:
    """D1/D2 + G1: the k most frequent events with their names."""
    s = event_shares(df, defs, how, cols)
    return s.orderBy(F.col("n").desc(), F.col(cols.event)).limit(k)


def momentum(df: DataFrame, windows: Mapping[str, int] = MOMENTUM_WINDOWS, cols: JourneyCols = DEFAULT_COLS) -> DataFrame:
    """L2: events within each window (seconds) of the journey's first event, plus the success flag."""
    df = with_us(df, cols)
    fr = journey_frame(df, cols).select(cols.id, "start_us", "n_actions", "success_us")
    j = df.join(fr, cols.id)
    el = F.col("us") - F.col("start_us")
    # whole seconds, like an integral duration, then compared with the window
    el_s = ((el - el % US_PER_SEC) / US_PER_SEC).cast("long")
    return j.groupBy(cols.id).agg(
        F.first("n_actions").alias("n_actions"),
        F.first(F.col("success_us").isNotNull()).alias("is_success"),
        *[F.count_if(el_s <= w).alias(f"momentum_{n}") for n, w in windows.items()],
    )


def momentum_by_outcome(mom: DataFrame, windows: Sequence[str] = tuple(MOMENTUM_WINDOWS)) -> DataFrame:
    """Mean momentum per outcome, unpivoted to (is_success, window, mean_events)."""
    g = mom.groupBy("is_success").agg(*[F.avg(f"momentum_{w}").alias(w) for w in windows])
    return g.unpivot(["is_success"], list(windows), "window", "mean_events")


def describe_numeric(df: DataFrame, cols: Sequence[str], ps: Sequence[float] = (0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """Count, mean, std (sample), min, percentiles (linear), max per column, one row per column."""
    names = percentile_names(ps)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("_x")) for c in cols]))
    base = df.select(pairs.alias("_kv")).select("_kv.*").groupBy("column_name").agg(
        F.count("_x").alias("count"), F.avg("_x").alias("mean"), F.stddev_samp("_x").alias("std"), F.min("_x").alias("min"), F.max("_x").alias("max"))
    q = column_percentiles(df, cols, ps, names)  # all columns in one pass
    return base.join(q, "column_name", "left").select("column_name", "count", "mean", "std", "min", *names, "max")


def top_values(df: DataFrame, cols: Sequence[str], k: int = 10, missing: str = "MISSING") -> DataFrame:
    """The k most frequent values of each categorical column (NULL counted as ``missing``)."""
    long = df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.coalesce(F.col(c).cast("string"), F.lit(missing)).alias("value")) for c in cols])).alias("kv")
    ).select("kv.*")
    counts = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    # top k per column with a bounded top-n (per-task top k, merged), whatever the cardinality;
    # the final rank runs on at most k rows per column
    tops = [counts.where(F.col("column_name") == c).orderBy(F.col("n").desc(), F.col("value")).limit(k) for c in cols]
    top = reduce(lambda a, b: a.unionByName(b), tops)
    w = Window.partitionBy("column_name").orderBy(F.col("n").desc(), F.col("value"))
    return top.withColumn("rank", F.row_number().over(w))


def value_shares(df: DataFrame, col: str, missing: str = "MISSING") -> DataFrame:
    """Normalised value counts in percent."""
    c = df.groupBy(F.coalesce(F.col(col).cast("string"), F.lit(missing)).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    tot = c.agg(F.sum("n").alias("_tot"))  # one row
    return c.crossJoin(F.broadcast(tot)).withColumn("pct", F.col("n") * 100.0 / F.col("_tot")).drop("_tot")


def rank_column_means(df: DataFrame, prefix: str, k: int = 10) -> DataFrame:
    """Mean of every ``prefix`` column (booleans as rates), top k."""
    names = [c for c in df.columns if c.startswith(prefix)]
    one = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in names])
    long = one.unpivot([], names, "column_name", "mean")
    return long.orderBy(F.col("mean").desc(), F.col("column_name")).limit(k)


def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """NULL count per column, one row per column."""
    cols = list(cols or df.columns)
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return one.unpivot([], cols, "column_name", "n_null")


def check_invariants(df: DataFrame, checks: Mapping[str, Column], means: Sequence[str] = ()) -> DataFrame:
    """Does every row satisfy each check; plus column means."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.bool_and(c).alias(n) for n, c in checks.items()],
        *[F.avg(F.col(m).cast("double")).alias(f"mean_{m}") for m in means],
    )


def length_percentiles(lengths: DataFrame, col: str = "n_actions", ps: Sequence[float] = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99), method: str = "linear") -> DataFrame:
    """Percentiles of journey length; ``linear`` interpolates, ``disc`` takes the first
    observed value whose cumulative share reaches p."""
    names = [f"p{int(round(p * 100))}" for p in ps]
    wide = exact_percentiles(lengths, col, ps, names, method="linear" if method == "linear" else "disc")
    return wide.unpivot([], names, "percentile", "value")


def histogram(df: DataFrame, col: str, bins: int = 30, log: bool = False, clip_quantile: float | None = None, by: str | None = None) -> DataFrame:
    """Equal-width histogram of ``col`` (optionally log1p, clipped at a quantile, split by a label).

    Bin edges come from a one-row aggregate (min/max or the quantile), cross-joined as a
    broadcast; bins are numbered 0 .. bins-1, the maximum falls in the last bin.
    """
    x = F.log1p(F.col(col).cast("double")) if log else F.col(col).cast("double")
    base = df.select(x.alias("_x"), *([F.col(by)] if by else []))
    if clip_quantile:
        edges = base.agg(F.min("_x").alias("_lo")).crossJoin(exact_percentiles(base, "_x", [clip_quantile], ["_hi"]))
    else:
        edges = base.agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    j = base.crossJoin(F.broadcast(edges)).where(F.col("_x") <= F.col("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = F.when(width == 0, F.lit(0)).otherwise(F.least(F.floor((F.col("_x") - F.col("_lo")) / width), F.lit(bins - 1))).cast("int")
    g = j.groupBy(*([by] if by else []), b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
    w = (F.col("_hi") - F.col("_lo")) / bins
    return g.select(*([by] if by else []), "bin", (F.col("_lo") + F.col("bin") * w).alias("bin_start"),
                    (F.col("_lo") + (F.col("bin") + 1) * w).alias("bin_end"), "n")


def success_counts(df: DataFrame, cols: JourneyCols = DEFAULT_COLS, success_id: int = SUCCESS_ID) -> DataFrame:
    """Number of success events per timestamp."""
    return df.where(F.col(cols.event) == success_id).groupBy(cols.ts).agg(F.count(F.lit(1)).alias(f"count_ed_{success_id}"))


def daily_series(df: DataFrame, ts: str, value: str | None = None, series: Column | None = None) -> DataFrame:
    """Daily totals (count of rows, or sum of ``value``) per series."""
    v = F.count(F.lit(1)).cast("double") if value is None else F.sum(value).cast("double")
    s = series if series is not None else F.lit("all")
    return df.groupBy(s.alias("series"), F.to_date(ts).cast("timestamp_ntz").alias("date")).agg(v.alias("y"))


def monthly_series(daily: DataFrame) -> DataFrame:
    """Monthly totals keyed ``YYYY-M<m>``."""
    from journeyflow.functions.scalar import month_key

    return daily.groupBy("series", month_key("date").alias("month"), F.year("date").alias("year"), F.month("date").alias("m")).agg(
        F.sum("y").alias("y"))


def score_summary(scores: DataFrame, p: str = "p", tiers: Sequence[float] = (0.4, 0.6, 0.75)) -> DataFrame:
    """Min / mean / max probability and row counts per tier interval."""
    edges = [None, *tiers, None]
    cnt = []
    for i in range(len(edges) - 1):
        lo, hi = edges[i], edges[i + 1]
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (F.col(p) >= lo)
        if hi is not None:
            cond = cond & (F.col(p) < hi)
        cnt.append(F.count_if(cond).alias(f"tier_{i}_count"))
    return scores.agg(F.min(p).alias("p_min"), F.avg(p).alias("p_mean"), F.max(p).alias("p_max"), *cnt)


def class_balance(df: DataFrame, label: str = "y") -> DataFrame:
    """Negatives, positives, positive rate, scale_pos_weight (neg/pos), log-odds bias."""
    g = df.agg(F.count_if(F.col(label) == 0).alias("n_neg"), F.count_if(F.col(label) == 1).alias("n_pos"))
    return g.select(
        "n_neg", "n_pos",
        (F.col("n_pos") / (F.col("n_pos") + F.col("n_neg"))).alias("pos_rate"),
        (F.col("n_neg") / F.col("n_pos")).alias("scale_pos_weight"),
        F.log(F.col("n_pos") / F.col("n_neg")).alias("log_odds_bias"),
    )


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson correlation over the rows where both columns are set; NULL (not an error) when
    one of them is constant there."""
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every column pair, long format (a, b, corr)."""
    pairs = [(a, b) for a in cols for b in cols]
    one = df.agg(*[safe_corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}__{b}") for a, b in pairs])
    long = one.unpivot([], [f"{a}__{b}" for a, b in pairs], "pair", "corr")
    return long.select(F.split_part("pair", F.lit("__"), F.lit(1)).alias("a"), F.split_part("pair", F.lit("__"), F.lit(2)).alias("b"), "corr")


def with_gaps(df: DataFrame, first: int | None = 0, cols: JourneyCols = DEFAULT_COLS) -> DataFrame:
    """whole seconds since the previous event of the id in (ts, event) order; the first
    event gets ``first`` (0 or NULL). Skew-safe ordered scan, no per-id window."""
    df = with_us(df, cols)
    s = ordered_scan(df, cols.id, "us", [cols.event], prev=["us"])
    d = F.col("us") - F.col("prev_us")
    gap = ((d - d % US_PER_SEC) / US_PER_SEC).cast("long")
    return s.withColumn("gap_seconds", F.when(F.col("prev_us").isNull(), F.lit(first).cast("long")).otherwise(gap))


def with_elapsed(df: DataFrame, cols: JourneyCols = DEFAULT_COLS) -> DataFrame:
    """whole seconds since the journey's first event (per-id min joined back)."""
    df = with_us(df, cols)
    start = df.groupBy(cols.id).agg(F.min("us").alias("_start"))
    d = F.col("us") - F.col("_start")
    return df.join(start, cols.id).withColumn("elapsed_seconds", ((d - d % US_PER_SEC) / US_PER_SEC).cast("long")).drop("_start")


def with_step_index(df: DataFrame, cols: JourneyCols = DEFAULT_COLS) -> DataFrame:
    """1-based position of each event in its journey."""
    return ordered_scan(with_us(df, cols), cols.id, "us", [cols.event], index="step_index")


def with_cum_seconds(df: DataFrame, cols: JourneyCols = DEFAULT_COLS) -> DataFrame:
    """running sum of the gaps (whole seconds)."""
    g = with_gaps(df, 0, cols)
    return ordered_scan(g, cols.id, "us", [cols.event], running={"cum_seconds": F.col("gap_seconds")})


def running_total(series: DataFrame, value: str = "y", order: str = "date", key: str = "series") -> DataFrame:
    """running total of an already aggregated series (window per series over its days)."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return series.withColumn(f"running_{value}", F.sum(value).over(w))


def centered_mean(series: DataFrame, window: int = 365, value: str = "y", order: str = "date", key: str = "series") -> DataFrame:
    """Centred rolling mean over ``window`` rows; NULL unless the window is full."""
    half = window // 2
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-half, window - 1 - half)
    return series.withColumn("trend", F.when(F.count(value).over(w) == window, F.avg(value).over(w)))


def first_last(df: DataFrame, defs: DataFrame, cols: JourneyCols = DEFAULT_COLS) -> DataFrame:
    """first and last event of each journey (order ts, event) with name and stage."""
    df = with_us(df, cols)
    g = df.groupBy(cols.id).agg(F.min(F.struct("us", cols.event)).alias("f"), F.max(F.struct("us", cols.event)).alias("l"))
    g = g.select(cols.id, F.col("f")[cols.event].alias("first_ed_id"), from_us(F.col("f.us")).alias("first_time"),
                 F.col("l")[cols.event].alias("last_ed_id"), from_us(F.col("l.us")).alias("last_time"))
    d = bounded_broadcast(defs).select("ed_id", "event_name", "stage")
    g = g.join(d.select(F.col("ed_id").alias("first_ed_id"), F.col("event_name").alias("first_event_name"), F.col("stage").alias("first_stage")), "first_ed_id", "left")
    return g.join(d.select(F.col("ed_id").alias("last_ed_id"), F.col("event_name").alias("last_event_name"), F.col("stage").alias("last_stage")), "last_ed_id", "left")


def difference(series: DataFrame, value: str = "y", order: str = "date", key: str = "series") -> DataFrame:
    """F8: first difference of a series."""
    w = Window.partitionBy(key).orderBy(order)
    return series.withColumn(f"diff_{value}", F.col(value) - F.lag(value).over(w))


def gap_stats(df: DataFrame, by_outcome: bool = False, cols: JourneyCols = DEFAULT_COLS) -> DataFrame:
    """Mean, median, max, min gap (seconds) between consecutive actions of a journey."""
    g = with_gaps(df, None, cols).where(F.col("gap_seconds").isNotNull())
    keys = []
    if by_outcome:
        lab = journey_frame(df, cols).select(cols.id, F.col("success_us").isNotNull().alias("is_success"))
        g, keys = g.join(lab, cols.id), ["is_success"]
    # gaps are whole seconds, so a few distinct values stand for all of them: every figure comes from the counts
    counted, kind = value_counts(g, ["gap_seconds"], keys), dict(g.dtypes)["gap_seconds"]
    base = counted.groupBy(*keys).agg(
        F.sum("_n").alias("n_gaps"),
        (F.sum(F.col("_x") * F.col("_n")) / F.sum("_n")).alias("mean_gap_seconds"),
        F.max("_x").cast(kind).alias("max_gap_seconds"),
        F.min("_x").cast(kind).alias("min_gap_seconds"),
    )
    med = counted_percentiles(counted, [*keys, "column_name"], [0.5], ["median_gap_seconds"]).drop("column_name")
    joined = base.join(med, keys, "left") if keys else base.crossJoin(med)
    return joined.select(*keys, "n_gaps", "mean_gap_seconds", "median_gap_seconds", "max_gap_seconds", "min_gap_seconds")


def snapshot_report(all_ids: DataFrame, snaps: DataFrame, cols: JourneyCols = DEFAULT_COLS) -> DataFrame:
    """Journeys processed, snapshots written, skipped, success count and rate."""
    n = all_ids.select(cols.id).distinct().agg(F.count(F.lit(1)).alias("processed"))
    s = snaps.agg(F.count(F.lit(1)).alias("written"), F.sum("label_order_shipped").cast("long").alias("success_count"))
    return n.crossJoin(s).select("processed", "written", (F.col("processed") - F.col("written")).alias("skipped"),
                                 "success_count", (F.col("success_count") / F.col("written")).alias("success_rate"))


def top_k(df: DataFrame, col: str, k: int = 10, tie: Sequence[str] = ()) -> DataFrame:
    """G1: k rows with the largest ``col`` (TakeOrdered: per-partition top-k, no full sort)."""
    return df.orderBy(F.col(col).desc(), *tie).limit(k)


def nearest(df: DataFrame, col: str, value: float = 0.5, k: int = 1, tie: Sequence[str] = ()) -> DataFrame:
    """K rows whose ``col`` is closest to ``value``."""
    return df.orderBy(F.abs(F.col(col) - value), *tie).limit(k)


def reference_profiles(scores: DataFrame, p: str = "p", y: str = "y", key: str = "id") -> DataFrame:
    """The top false positive, the surest success and the surest failure (ties -> smallest id).

    Three min-of-struct aggregates: one pass, partial aggregation, no sort."""
    hi = F.struct((-F.col(p)).alias("k"), F.col(key).alias("i"), F.col(p).alias("p"))
    lo = F.struct(F.col(p).alias("k"), F.col(key).alias("i"), F.col(p).alias("p"))
    g = scores.agg(
        F.min(F.when(F.col(y) == 0, hi)).alias("fp"),
        F.min(F.when(F.col(y) == 1, hi)).alias("ss"),
        F.min(F.when(F.col(y) == 0, lo)).alias("sf"),
    )
    return g.select(
        F.explode(F.array(
            F.struct(F.lit("top_false_positive").alias("profile"), F.col("fp.i").alias(key), F.col("fp.p").alias(p)),
            F.struct(F.lit("surest_success").alias("profile"), F.col("ss.i").alias(key), F.col("ss.p").alias(p)),
            F.struct(F.lit("surest_failure").alias("profile"), F.col("sf.i").alias(key), F.col("sf.p").alias(p)),
        )).alias("r")
    ).select("r.*")


def union_all(dfs: Sequence[DataFrame]) -> DataFrame:
    """H1: concatenate tables by column name (missing columns as NULL)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
