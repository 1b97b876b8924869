"""Result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def to_json_rows(df: DataFrame, key: str = "id") -> DataFrame:
    """(key, json): one nested JSON document per row; null fields are left out."""
    rest = [c for c in df.columns if c != key]
    return df.select(key, F.to_json(F.struct(*rest)).alias("json"))


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)
