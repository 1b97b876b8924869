"""Readers with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from gradpath.functions.numbering import number_rows
from gradpath.schema import CATALOGUE_COLUMNS, LABELLED_PROFILE, PROFILE_REQUEST


def read_profiles(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """(id, profile, label) from CSV with a header, or from parquet.

    Columns are found by their name, in whatever order they stand; a value that is no number
    becomes null. A file without ``id`` gets its line order.
    """
    raw = strip_header(spark.read.csv(path, header=True, inferSchema=False, escape='"') if fmt == "csv" else spark.read.format(fmt).load(path))
    if "id" not in raw.columns:
        raw = with_line_order(raw, "id")
    typed = [F.col(f.name) if f.dataType == T.StringType() else F.col(f.name).cast("string").try_cast(f.dataType).alias(f.name) for f in LABELLED_PROFILE.fields]
    return raw.select(F.col("id").cast("bigint").alias("id"), *typed)


def strip_header(df: DataFrame) -> DataFrame:
    """Column names without the white space around them."""
    return df.toDF(*[name.strip() for name in df.columns])


def catalogue_columns(df: DataFrame) -> DataFrame:
    """Bring a catalogue to (row_id, job, skills, langs, tools).

    A missing language column counts as empty text. ``row_id`` must come from the
    data, since it decides ties; a file without one gets its line order from
    ``with_line_order``.
    """
    df = strip_header(df)
    have = {src: dst for src, dst in CATALOGUE_COLUMNS.items() if src in df.columns}
    df = df.withColumnsRenamed(have)
    if "langs" not in df.columns:
        df = df.withColumn("langs", F.lit(""))
    return df.select(F.col("row_id").cast("bigint").alias("row_id"), "job", "skills", "langs", "tools")


def with_line_order(df: DataFrame, out: str = "row_id") -> DataFrame:
    """Add ``out``, the row's place: files by name, then lines in their order.

    Each row knows its file, where its split begins there and its place in the split.
    """
    placed = df.select("*", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id()).alias("_place"))
    return number_rows(placed, F.col("_place"), out=out).drop("_place")


def read_catalogue(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Career catalogue; header names are stripped, all columns are text."""
    if fmt == "csv":
        raw = strip_header(spark.read.csv(path, header=True, inferSchema=False, escape='"', multiLine=True))
    else:
        raw = strip_header(spark.read.format(fmt).load(path))
    if "row_id" not in raw.columns:
        raw = with_line_order(raw)
    return catalogue_columns(raw)


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Profile requests, one JSON object per line; absent skills become an empty list."""
    return with_request_defaults(spark.read.schema(PROFILE_REQUEST).json(path))


def parse_requests(df: DataFrame, body: str = "body") -> DataFrame:
    """Profile requests held as JSON text in a column."""
    parsed = df.select(F.from_json(F.col(body), PROFILE_REQUEST).alias("r")).select("r.*")
    return with_request_defaults(parsed)


def with_request_defaults(df: DataFrame) -> DataFrame:
    return df.withColumn("skills", F.coalesce("skills", F.array().cast("array<string>")))
