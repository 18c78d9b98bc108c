"""Continuous, idempotent bar ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pitlab.operators.dedupe import keep_first
from pitlab.schemas import BAR_TEXT_COLUMNS, BARS
from pitlab.sources.bars import parse_bars

#: How long a delivered row is remembered.
HORIZON = "7 days"

RAW = T.StructType([T.StructField(c, T.StringType()) for c in BAR_TEXT_COLUMNS])


def read_raw_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1_000) -> DataFrame:
    """New CSV files of a folder as text rows with their source. A file with other or reordered columns is an error."""
    return (
        spark.readStream.schema(RAW)
        .option("header", "true")
        .option("enforceSchema", "false")
        .option("maxFilesPerTrigger", files_per_trigger)
        .csv(folder)
        .withColumn("source", F.col("_metadata.file_path"))
    )


def valid_bars(raw: DataFrame) -> DataFrame:
    """Valid bars. Nothing is dropped for being old: repeats are caught by the append, so a backfill may come at any time."""
    return parse_bars(raw, fatal=False).filter(F.size("issues") == 0).drop("issues")


def without_repeats(bars: DataFrame, horizon: str = HORIZON) -> DataFrame:
    """Rows that were not delivered before within ``horizon``.

    A row is remembered from its arrival, and forgotten after the horizon by a watermark over arrival times. So a file that is
    delivered again costs no look at the table, and a bar of any age that arrives now is not late. Rows that differ in any value
    are all kept: the append decides among them.
    """
    arrived = bars.withColumn("_arrived", F.current_timestamp()).withColumn("_print", F.xxhash64(*BARS.fieldNames()))
    return arrived.withWatermark("_arrived", horizon).dropDuplicatesWithinWatermark(["symbol", "ts", "_print"]).drop("_arrived", "_print")


def append_new(batch: DataFrame, table: str) -> None:
    """Append the bars of a batch whose key is not in the table yet.

    The table is partitioned by year, and only the years in the batch are read. Running a
    batch twice appends nothing the second time.
    """
    spark = batch.sparkSession
    rest = [c for c in batch.columns if c not in ("symbol", "ts")]
    rows = keep_first(batch, ["symbol", "ts"], rest).select(*BARS.fieldNames()).withColumn("year", F.year("session"))
    rows = rows.persist()
    try:
        # At most one value per calendar year.
        years = [r["year"] for r in rows.select("year").distinct().collect()]
        if not years:
            return
        fresh = rows
        if _exists(spark, table):
            stored = spark.read.parquet(table).filter(F.col("year").isin(years)).select("symbol", "ts")
            fresh = rows.join(stored, ["symbol", "ts"], "left_anti")
        fresh.write.mode("append").partitionBy("year").parquet(table)
    finally:
        rows.unpersist()


def _exists(spark: SparkSession, table: str) -> bool:
    try:
        spark.read.parquet(table)
        return True
    except Exception as exc:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(exc) or "UNABLE_TO_INFER_SCHEMA" in str(exc):
            return False
        raise


def ingest(raw: DataFrame, table: str, checkpoint: str, once: bool = False, horizon: str = HORIZON) -> StreamingQuery:
    """Start the import. ``once`` drains what is there and stops."""
    writer = (
        without_repeats(valid_bars(raw), horizon)
        .writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, _: append_new(batch, table))
    )
    return writer.trigger(availableNow=True).start() if once else writer.start()
