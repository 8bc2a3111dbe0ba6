"""Helpers shared by the catalogue modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from journeyflow.schema import event_definitions
from journeyflow.sources.bindings import binding, table  # noqa: F401

# DuckDB: stable uniform of (id, seed); same value as journeyflow.functions.hash_uniform
def sql_u(key: str, seed: str | int = 42) -> str:
    return f"(CAST(('0x' || substr(md5(CAST({key} AS VARCHAR) || '|' || CAST({seed} AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0)"


def ev(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Events of a binding with the journey columns (and ``us``)."""
    return binding(spark, sf_dir, name)


def defs(spark: SparkSession) -> DataFrame:
    return event_definitions(spark)


def ntz(c: str):
    return F.col(c).cast("timestamp_ntz").alias(c)


def flat(df: DataFrame) -> DataFrame:
    """Journey events as (id, event_timestamp NTZ, ed_id)."""
    return df.select("id", ntz("event_timestamp"), "ed_id")
