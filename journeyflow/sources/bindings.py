"""Bindings of the provided test tables to the journey model (FIXTURES.md section 3).

* J1 -- short journeys from ``events``: a user's events split into sessions at a 12 h gap.
* J2 -- long journeys from ``orders``: one journey per customer.
* Dup -- J1 plus a copy of some of its rows (for the de-duplication operators).
* S1 -- daily shipped-line counts from ``lineitem`` (time-series operators).

Every binding returns ``(id STRING, event_timestamp TIMESTAMP, ed_id INT)`` plus ``us``
(BIGINT microseconds of the timestamp) which all time arithmetic uses.
"""

from __future__ import annotations

from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from journeyflow.operators.ordered import session_numbers
from journeyflow.schema import US_PER_HOUR, US_PER_SEC, from_us, to_us
from journeyflow.session import require_utc

SESSION_GAP_US = 12 * US_PER_HOUR


_TABLES: WeakKeyDictionary = WeakKeyDictionary()  # by session object, so a new session never meets an old one's tables


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A provided table. The scan DataFrame is reused within a session while the file is
    unchanged (saves the listing and footer read; the plan itself is immutable)."""
    require_utc(spark)
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    key = (path, _fs_stamp(spark, path))
    held = _TABLES.setdefault(spark, {})
    if key not in held:
        held[key] = spark.read.parquet(path)
    return held[key]


def _j1_event_id(event_type: Column, event_id: Column) -> Column:
    # fixed mapping of the binding (FIXTURES.md J1); 24 deliberately has no definition
    return (
        F.when(event_type == "purchase", F.lit(28))
        .when(event_type == "signup", F.element_at(F.array(F.lit(12), F.lit(19), F.lit(23)), (event_id % 3 + 1).cast("int")))
        .when(event_type == "view", F.element_at(F.array(F.lit(4), F.lit(5)), (event_id % 2 + 1).cast("int")))
        .when(event_type == "click", F.element_at(F.array(F.lit(2), F.lit(11), F.lit(6)), (event_id % 3 + 1).cast("int")))
        .otherwise(F.element_at(F.array(F.lit(13), F.lit(37), F.lit(8), F.lit(24)), (event_id % 4 + 1).cast("int")))
    ).cast("int")


def _fs_stamp(spark: SparkSession, path: str) -> str:
    """Length + modification time of a file or folder (Hadoop FS, works for any cluster path)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    st = fs.getFileStatus(p)
    return f"{st.getLen()}-{st.getModificationTime()}"


def _code_version() -> str:
    """Digest of the code that derives the bindings: a changed derivation never reuses an old table."""
    import hashlib
    import os

    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    h = hashlib.sha1()
    for rel in ("sources/bindings.py", "operators/ordered.py", "operators/snapshot.py", "schema.py", "functions/scalar.py"):
        with open(os.path.join(here, rel), "rb") as f:
            h.update(f.read())
    return h.hexdigest()[:12]


def materialized(spark: SparkSession, name: str, sources: list[str], build) -> DataFrame:
    """A derived table written once per input version under ``spark.checkpoint.dir`` and read
    back: later queries scan a small parquet table instead of re-deriving it (and Spark never
    has to recompute a long lineage twice inside one plan)."""
    import hashlib

    from journeyflow.session import ensure_checkpoint_dir

    stamp = "|".join(f"{s}:{_fs_stamp(spark, s)}" for s in sources)
    digest = hashlib.sha1(f"{name}|{stamp}|{_code_version()}".encode()).hexdigest()[:16]
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/journeyflow-derived/{name}-{digest}"
    jvm = spark.sparkContext._jvm
    marker = jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    fs = marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(marker):
        # write to a private folder, then rename: concurrent builders never see a partial table
        import uuid

        tmp = f"{path}.tmp-{uuid.uuid4().hex}"
        build().write.mode("overwrite").option("compression", "zstd").parquet(tmp)
        src, dst = jvm.org.apache.hadoop.fs.Path(tmp), jvm.org.apache.hadoop.fs.Path(path)
        if fs.exists(marker) or not fs.rename(src, dst):
            fs.delete(src, True)
    return spark.read.parquet(path)


def j1_events(spark: SparkSession, sf_dir: str, keep_event_id: bool = False) -> DataFrame:
    """``id = user_id || '-' || session number``; sessions split at a gap over 12 h.
    The binding is a derived table: it is materialised once per events file."""
    src = f"{sf_dir.rstrip('/')}/events.parquet"
    j = materialized(spark, "j1", [src], lambda: _j1_build(spark, sf_dir))
    return j if keep_event_id else j.drop("event_id")


def _j1_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", to_us("ts").alias("us"))
    sess = session_numbers(ev, "user_id", "us", ["event_id"], SESSION_GAP_US, name="sid")
    out = sess.select(
        F.concat(F.col("user_id").cast("string"), F.lit("-"), F.col("sid").cast("string")).alias("id"),
        from_us("us").cast("timestamp").alias("event_timestamp"),
        _j1_event_id(F.col("event_type"), F.col("event_id")).alias("ed_id"),
        "us",
        "event_id",
    )
    return out


def j2_events(spark: SparkSession, sf_dir: str, keep_event_id: bool = False) -> DataFrame:
    """One journey per customer from ``orders``; order time = order date + a key-derived offset."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    us = to_us("o_orderdate") + (F.col("o_orderkey") * 7919 % 86400) * US_PER_SEC
    k = F.col("o_orderkey")
    other = F.element_at(F.array(*[F.lit(v) for v in (12, 19, 4, 5, 11, 6, 2, 8, 24)]), (k % 9 + 1).cast("int"))
    ed = F.when(
        (F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT") & (k % 5 == 0), F.lit(28)
    ).otherwise(other)
    return o.select(
        F.col("o_custkey").cast("string").alias("id"),
        from_us(us).cast("timestamp").alias("event_timestamp"),
        ed.cast("int").alias("ed_id"),
        us.alias("us"),
        *([k.alias("event_id")] if keep_event_id else []),
    )


def dup_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dup: J1 plus a second copy of the rows whose event_id is a multiple of 17."""
    j = j1_events(spark, sf_dir, keep_event_id=True)
    return j.unionAll(j.where(F.col("event_id") % 17 == 0))


def binding(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Events of binding ``j1`` or ``j2`` (id, event_timestamp, ed_id, us)."""
    if name == "j1":
        return j1_events(spark, sf_dir)
    if name == "j2":
        return j2_events(spark, sf_dir)
    if name == "dup":
        return dup_events(spark, sf_dir).drop("event_id")
    raise ValueError(name)


def daily_lines(spark: SparkSession, sf_dir: str, by_flag: bool = False) -> DataFrame:
    """(series, date, y) -- lines shipped per day; series 'all' or the return flag.
    ``date`` is the day as a midnight TIMESTAMP_NTZ."""
    li = table(spark, sf_dir, "lineitem").select("l_shipdate", "l_returnflag")
    series = F.col("l_returnflag") if by_flag else F.lit("all")
    return (
        li.groupBy(series.alias("series"), F.to_date("l_shipdate").cast("timestamp_ntz").alias("date"))
        .agg(F.count(F.lit(1)).cast("double").alias("y"))
    )


# Fixed-coefficient logistic scorers standing for several models (FIXTURES.md binding P).
# Each entry: (intercept, weights for x1..x5).
FIXED_MODELS = {
    "m1": (-2.0, (0.8, -0.5, 0.4, 0.6, -0.3)),
    "m2": (-1.5, (0.5, -0.8, 0.6, 0.3, 0.0)),
    "m3": (-2.5, (1.0, -0.3, 0.2, 0.9, -0.6)),
}


def score_features(snap: DataFrame) -> DataFrame:
    """x1..x5 of the fixed scorers from a K7 snapshot."""
    return snap.select(
        "id",
        F.col("label_order_shipped").alias("y"),
        F.log1p(F.col("n_events_observed").cast("double")).alias("x1"),
        F.log1p(F.col("days_since_last_event")).alias("x2"),
        F.coalesce(F.col("max_milestone_seen"), F.lit(0.0)).alias("x3"),
        F.log1p((F.col("count_ed_11") + F.col("count_ed_6") + F.col("count_ed_5")).cast("double")).alias("x4"),
        (F.col("observed_duration_days") / 365.0).alias("x5"),
    )


def logit_score(feat: DataFrame, model: str) -> Column:
    b0, w = FIXED_MODELS[model]
    z = F.lit(b0)
    for i, wi in enumerate(w):
        z = z + F.lit(wi) * F.col(f"x{i + 1}")
    return F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-z)), 6)


def scores(spark: SparkSession, sf_dir: str, models=("m1", "m2", "m3"), with_features: bool = False) -> DataFrame:
    """P: (model, id, y, p) for the fixed scorers over the J2 snapshot (p rounded to 6 places).
    The feature table is a derived table, materialised once per orders file."""
    from journeyflow.operators.snapshot import snapshot
    from journeyflow.schema import event_definitions

    src = f"{sf_dir.rstrip('/')}/orders.parquet"
    feat = materialized(spark, "p_features", [src],
                        lambda: score_features(snapshot(j2_events(spark, sf_dir), event_definitions(spark))))
    xs = [f"x{i}" for i in range(1, 6)] if with_features else []
    # one pass over the features: every model's probability, then one row per model
    per_model = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), logit_score(feat, m).alias("p")) for m in models]))
    return feat.select("id", "y", *xs, per_model.alias("_m")).select(F.col("_m.model").alias("model"), "id", "y", F.col("_m.p").alias("p"), *xs)
