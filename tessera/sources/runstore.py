"""Readers of the run-store tables, and the id conventions that hold for all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that careless writers leave around ids.
ID_PADDING = " \t\r\n"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder (a Parquet file or a folder of them)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clean_id(c: Column | str) -> Column:
    """An id as it is compared: trimmed, in lower case; empty and blank ids are null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.lower(F.btrim(c, F.lit(ID_PADDING))), F.lit(""))


def seconds(c: Column | str) -> Column:
    """Whole seconds since the epoch of a timestamp with or without zone."""
    c = F.col(c) if isinstance(c, str) else c
    return F.unix_seconds(c.cast("timestamp"))


def iso(c: Column) -> Column:
    """Text like 2024-05-01T00:00:00Z of whole seconds since the epoch."""
    return F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")
