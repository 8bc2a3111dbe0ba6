"""Projection, filter, schema and join operators (inventory C1-C14, D1-D7)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from journeyflow.schema import DEFAULT_COLS, JourneyCols

# Columns that must never reach a model: labels, terminal information, ids and free text.
LEAKY_COLUMNS = (
    "label_order_shipped",
    "journey_terminal_time",
    "journey_terminal_reason",
    "sampling_weight_days",
    "cutoff_time",
    "id",
    "is_success",
    "leaked_success",
)


def bounded_broadcast(df: DataFrame) -> DataFrame:
    """Broadcast a dimension only when its size is known to be small.

    Tables built by this library from fixed values carry ``_jf_rows``; any other is left to
    adaptive execution, which broadcasts by measured bytes.
    """
    return df if getattr(df, "_jf_rows", None) is None else F.broadcast(df)


def only_event(df: DataFrame, event_id: int, cols: JourneyCols = DEFAULT_COLS) -> DataFrame:
    """C1."""
    return df.where(F.col(cols.event) == event_id)


def keep_ids(df: DataFrame, ids: DataFrame, cols: JourneyCols = DEFAULT_COLS) -> DataFrame:
    """Keep rows whose id is in ``ids`` (left semi join; AQE may broadcast a small id set)."""
    return df.join(ids.select(cols.id), cols.id, "left_semi")


def min_length(df: DataFrame, n: int = 2, cols: JourneyCols = DEFAULT_COLS) -> DataFrame:
    """Keep the events of ids with at least ``n`` events (count by partial aggregate + semi join)."""
    ok = df.groupBy(cols.id).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= n).select(cols.id)
    return df.join(ok, cols.id, "left_semi")


def drop_cols(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """C4: drop columns, ignoring names that are missing."""
    return df.drop(*[n for n in names if n in df.columns])


def drop_like(df: DataFrame, fragments: Sequence[str]) -> DataFrame:
    """Drop every column whose name contains one of the fragments."""
    return df.select(*[c for c in df.columns if not any(f in c for f in fragments)])


_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def select_dtypes(df: DataFrame, include: str = "numeric", exclude: bool = False) -> DataFrame:
    """Keep (or drop) columns by kind: numeric, string, boolean, timestamp."""
    kinds = {
        "numeric": _NUMERIC,
        "string": (T.StringType,),
        "boolean": (T.BooleanType,),
        "timestamp": (T.TimestampType, T.TimestampNTZType, T.DateType),
    }[include]
    chosen = [f.name for f in df.schema.fields if isinstance(f.dataType, kinds) != exclude]
    return df.select(*chosen)


def select_prefix(df: DataFrame, prefix: str, keep: Sequence[str] = ()) -> DataFrame:
    """Keep columns starting with ``prefix`` (plus ``keep``)."""
    return df.select(*keep, *[c for c in df.columns if c.startswith(prefix) and c not in keep])


def feature_columns(df: DataFrame, extra: Sequence[str] = ()) -> list[str]:
    """Model-safe column names: drops labels, terminal fields, ids, text and time columns."""
    bad = set(LEAKY_COLUMNS) | set(extra)
    out = []
    for f in df.schema.fields:
        if f.name in bad or f.name.endswith("_name") or f.name.endswith("_stage"):
            continue
        if isinstance(f.dataType, (T.StringType, T.TimestampType, T.TimestampNTZType, T.DateType, T.ArrayType)):
            continue
        out.append(f.name)
    return out


def drop_nulls(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """C9."""
    return df.na.drop(how="any", subset=list(subset) if subset else None)


def fill(df: DataFrame, strings: str | None = "MISSING", numbers: float | None = 0, cols: Sequence[str] | None = None) -> DataFrame:
    """+-inf and NaN become NULL first; then strings and numbers are filled."""
    cols = list(cols or df.columns)
    fields = {f.name: f.dataType for f in df.schema.fields}
    exprs = []
    for c in df.columns:
        dt = fields[c]
        e = F.col(c)
        if c in cols and isinstance(dt, (T.FloatType, T.DoubleType)):
            e = F.when(F.isnan(e) | (F.abs(e) == F.lit(float("inf"))), F.lit(None)).otherwise(e)
            if numbers is not None:
                e = F.coalesce(e, F.lit(float(numbers)))
        elif c in cols and isinstance(dt, _NUMERIC) and numbers is not None:
            e = F.coalesce(e, F.lit(numbers).cast(dt))
        elif c in cols and isinstance(dt, T.StringType) and strings is not None:
            e = F.coalesce(e, F.lit(strings))
        exprs.append(e.alias(c))
    return df.select(*exprs)


def cast_numeric(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """C11: booleans to int, timestamps to BIGINT microseconds, other numbers to double."""
    cols = set(cols or df.columns)
    exprs = []
    for f in df.schema.fields:
        e = F.col(f.name)
        if f.name in cols:
            if isinstance(f.dataType, T.BooleanType):
                e = e.cast("int")
            elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
                e = F.unix_micros(e.cast("timestamp"))
            elif isinstance(f.dataType, _NUMERIC):
                e = e.cast("double")
        exprs.append(e.alias(f.name))
    return df.select(*exprs)


def align_schema(df: DataFrame, columns: Sequence[str], fill_value: float = 0.0) -> DataFrame:
    """Training column order; missing columns added as ``fill_value``, extra ones dropped."""
    have = set(df.columns)
    return df.select(*[F.col(c) if c in have else F.lit(fill_value).alias(c) for c in columns])


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """C13."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def constant_prediction(df: DataFrame, value: float = 0.0, name: str = "order_shipped", keep: Sequence[str] = ("id",)) -> DataFrame:
    """C14: the all-constant baseline prediction."""
    return df.select(*keep, F.lit(float(value)).alias(name))


def with_event_meta(
    df: DataFrame, defs: DataFrame, on: str, prefix: str, fields: Sequence[str] = ("event_name", "stage")
) -> DataFrame:
    """Left join the (broadcast) event dimension on an event-id column.

    Unknown ids keep their row with NULL name/stage.
    """
    d = defs.select(F.col("ed_id").alias(on), *[F.col(f).alias(f"{prefix}{f}") for f in fields])
    return df.join(d if getattr(defs, "_jf_rows", None) is None else F.broadcast(d), on, "left")


def attach_predictions(ids: DataFrame, preds: DataFrame, key: str = "id") -> DataFrame:
    """Re-attach predictions by id (equi-join, never by position)."""
    return ids.join(preds, key, "inner")
