"""Index-membership snapshot files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitlab.functions.dates import parse_snapshot_date
from pitlab.functions.text import strip_removal_suffix
from pitlab.operators.intervals import snapshots_to_intervals
from pitlab.schemas import SchemaError, assert_columns
from pitlab.sources import csvfiles


def parse_tickers(text: Column) -> Column:
    tokens = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda t: F.regexp_replace(F.regexp_replace(t, r"^\s+|\s+$", ""), "^[\"']+|[\"']+$", ""))
    return F.array_distinct(F.transform(F.filter(tokens, lambda t: t != ""), strip_removal_suffix))


def parse_snapshots(raw: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """(date, tickers) text rows to (change_date, tickers ARRAY<STRING>).

    A missing or unreadable date and an empty list stop the job, naming the row's text.
    """
    assert_columns(raw, ("date", "tickers"), "snapshot file")
    day = parse_snapshot_date(F.col("date"))
    bad_day = F.concat(F.lit("invalid or missing snapshot date: "), F.coalesce("date", F.lit("NULL")))
    names = parse_tickers(F.col("tickers"))
    empty = F.concat(F.lit("empty ticker list on "), F.coalesce("date", F.lit("NULL")))
    return raw.select(
        F.when(day.isNull(), F.raise_error(bad_day).cast("date")).otherwise(day).alias("change_date"),
        F.when(F.size(names) == 0, F.raise_error(empty).cast("array<string>")).otherwise(names).alias("tickers"),
        *carry,
    )


def read_snapshots(spark: SparkSession, path: str, range_bytes: int = csvfiles.RANGE_BYTES) -> DataFrame:
    """Snapshots exploded to (change_date, symbol, path). Two rows of a file for one date, or no rows at all, are errors.

    A list of tickers may go over several lines; a large file is still read by many tasks.
    """
    names = {name for (header,) in csvfiles.heads(spark, path).select("header").distinct().toLocalIterator() for name in ("date", "tickers") if name not in header}
    if names:
        raise SchemaError(f"snapshot file: missing required columns {', '.join(sorted(names))}")
    raw = csvfiles.rows(spark, path, ("date", "tickers"), range_bytes)
    parsed = parse_snapshots(raw, carry=("source",)).withColumnRenamed("source", "path")
    dates = parsed.groupBy("path", "change_date").agg(F.count(F.lit(1)).alias("n"))
    worst = dates.agg(F.max("n").alias("n"), F.max_by("change_date", "n").alias("d")).first()
    if worst["n"] is None:
        raise ValueError("snapshot file holds no rows")
    if worst["n"] > 1:
        raise ValueError(f"duplicate snapshot date {worst['d']}")
    return parsed.select("change_date", F.explode("tickers").alias("symbol"), "path")


def source_version(spark: SparkSession, path: str) -> DataFrame:
    """sha256 of the raw bytes of each file."""
    return csvfiles.digests(spark, path).select(F.col("source").alias("path"), F.col("sha256").alias("source_version"), "length")


def read_memberships(spark: SparkSession, path: str, source: str = "index-history") -> DataFrame:
    """Intervals of snapshot files, stamped with the source and the sha256 of the file whose snapshot opened them.

    If several files open one, the first by path counts.
    """
    snapshots = read_snapshots(spark, path)
    opened = snapshots.groupBy("symbol", F.col("change_date").alias("start_date")).agg(F.min("path").alias("path"))
    stamped = snapshots_to_intervals(snapshots).join(opened, ["symbol", "start_date"]).join(source_version(spark, path), "path")
    return stamped.select("symbol", "start_date", "end_date", F.lit(source).alias("source"), "source_version")
