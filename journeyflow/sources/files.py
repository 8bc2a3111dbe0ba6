"""Scans and sinks (inventory A1-A11). Explicit schemas everywhere; no inference."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from journeyflow.schema import EVENT_DEF_SCHEMA

RAW_EVENT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("customer_id", T.StringType()),
        T.StructField("ed_id", T.IntegerType()),
        T.StructField("event_timestamp", T.StringType()),
    ]
)


def read_events_csv(spark: SparkSession, path: str, schema: T.StructType = RAW_EVENT_SCHEMA) -> DataFrame:
    """A1/A2: lazy CSV scan of raw events (header, explicit schema). Spark splits the files into
    input partitions itself, so the reference's manual 1 M-row chunking is not needed."""
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def read_event_defs(spark: SparkSession, path: str) -> DataFrame:
    """A3: event definitions CSV (UTF-8 BOM tolerated); milestone coerced to a number, bad -> NULL."""
    raw = (
        spark.read.option("header", True)
        .option("encoding", "UTF-8")
        .schema(
            T.StructType(
                [
                    T.StructField("event_name", T.StringType()),
                    T.StructField("journey_id", T.StringType()),
                    T.StructField("event_definition_id", T.StringType()),
                    T.StructField("milestone_number", T.StringType()),
                    T.StructField("stage", T.StringType()),
                ]
            )
        )
        .csv(path)
    )
    return raw.select(
        F.col("event_name"),
        F.col("journey_id").try_cast("int").alias("journey_id"),
        F.col("event_definition_id").try_cast("int").alias("ed_id"),
        F.col("milestone_number").try_cast("double").alias("milestone_number"),
        F.col("stage"),
    ).select(*[F.col(f.name).cast(f.dataType) for f in EVENT_DEF_SCHEMA.fields])


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None, where: Column | None = None) -> DataFrame:
    """A4: parquet scan with projection (and an optional filter); both reach the scan."""
    df = spark.read.parquet(path)
    if where is not None:
        df = df.where(where)
    return df.select(*columns) if columns else df


def head_sample(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """A5: first ``n`` rows in a deterministic order (TakeOrderedAndProject: a top-n, no full sort)."""
    return df.orderBy(*order).limit(n)


def table_profile(df: DataFrame, name: str, null_cols: Sequence[str] = ()) -> DataFrame:
    """One-row profile (rows, columns, null cells of chosen columns)."""
    return df.agg(
        F.lit(name).alias("table_name"),
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(df.columns)).cast("long").alias("n_columns"),
        *[F.count_if(F.col(c).isNull()).cast("long").alias(f"null_cells_{c}") for c in null_cols],
    )


def schema_table(df: DataFrame) -> DataFrame:
    """The schema as rows (position, name, type)."""
    rows = [(i + 1, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, column_name string, data_type string")


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = (), max_records_per_file: int | None = None) -> None:
    """Zstd parquet sink (distributed write; one file per task, optionally capped in rows)."""
    w = df.write.mode(mode).option("compression", "zstd")
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", max_records_per_file)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_submission(df: DataFrame, path: str, id_col: str = "id", prob_col: str = "order_shipped") -> None:
    """(id, probability) CSV with header."""
    df.select(id_col, prob_col).write.mode("overwrite").option("header", True).csv(path)


def write_feature_set(features: DataFrame, stats: DataFrame, path: str) -> None:
    """The feature table and its normalisation statistics as two parquet tables."""
    write_table(features, f"{path}/features")
    write_table(stats, f"{path}/stats")


def write_run_metadata(spark: SparkSession, meta: dict, path: str) -> DataFrame:
    """A10: one-row run metadata (best config, sizes) written as JSON lines."""
    df = spark.createDataFrame([(json.dumps(meta, sort_keys=True, default=str),)], "meta string")
    df.coalesce(1).write.mode("overwrite").text(path)
    return df


def save_model(model, path: str) -> None:
    """Persist a fitted Spark ML model / pipeline."""
    model.write().overwrite().save(path)


def load_model(path: str):
    """Load a persisted ``PipelineModel``."""
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)
