"""The security catalog: nested JSON to three flat tables, and its idempotent store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitlab.functions.text import normalize_symbol
from pitlab.operators.dedupe import keep_first, upsert_new
from pitlab.schemas import CATALOG_JSON


def _iso(text: Column, field: str, required: bool) -> Column:
    parsed = F.try_to_date(text, "yyyy-MM-dd")
    blank = F.coalesce(F.trim(text), F.lit("")) == ""
    bad = F.concat(F.lit(f"{field} is not an ISO date: "), F.coalesce(text, F.lit("NULL")))
    wrong = parsed.isNull() if required else parsed.isNull() & ~blank
    return F.when(wrong, F.raise_error(bad).cast("date")).otherwise(parsed)


def flatten_catalog(payload: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(securities, tickers, identifiers) of catalog documents, with the usual defaults.

    ``ord`` keeps the order of tickers: by file (column ``file``, if present), security and place.
    """
    file = F.col("file") if "file" in payload.columns else F.lit("")
    each = payload.select(file.alias("_file"), "source", "source_version", F.posexplode("securities").alias("_n", "s"))
    securities = each.select(
        F.col("s.seed_key").alias("seed_key"),
        F.col("s.display_name").alias("display_name"),
        F.coalesce(F.nullif(F.col("s.security_type"), F.lit("")), F.lit("COMMON_STOCK")).alias("security_type"),
        F.coalesce(F.nullif(F.col("s.currency"), F.lit("")), F.lit("USD")).alias("currency"),
        F.upper(F.coalesce(F.nullif(F.col("s.status"), F.lit("")), F.lit("ACTIVE"))).alias("status"),
        F.col("s.notes").alias("notes"),
    )
    rows = each.select("_file", "source", "source_version", "_n", "s.seed_key", F.posexplode("s.tickers").alias("_m", "t"))
    tickers = rows.select(
        "seed_key",
        F.lower(F.trim("t.scheme")).alias("scheme"),
        normalize_symbol(F.col("t.ticker")).alias("ticker"),
        _iso(F.col("t.valid_from"), "valid_from", required=True).alias("valid_from"),
        _iso(F.col("t.valid_to"), "valid_to", required=False).alias("valid_to"),
        F.coalesce("t.continuity", F.lit(False)).alias("continuity"),
        F.coalesce(F.nullif(F.col("t.source"), F.lit("")), F.col("source"), F.lit("security-master-seed")).alias("source"),
        F.coalesce(F.nullif(F.col("t.source_version"), F.lit("")), F.col("source_version")).alias("source_version"),
        F.struct(F.col("_file").alias("file"), F.col("_n").alias("security"), F.col("_m").alias("place")).alias("ord"),
    )
    ids = each.select("s.seed_key", F.explode("s.identifiers").alias("i")).select(
        "seed_key",
        F.col("i.id_type").alias("id_type"),
        F.col("i.id_value").alias("id_value"),
        _iso(F.col("i.valid_from"), "valid_from", required=False).alias("valid_from"),
        _iso(F.col("i.valid_to"), "valid_to", required=False).alias("valid_to"),
    )
    return securities, tickers, ids


def read_security_catalog(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The catalog is one hand-kept JSON document per file; many files are read in parallel."""
    payload = spark.read.schema(CATALOG_JSON).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    return flatten_catalog(payload.withColumn("file", F.col("_metadata.file_path")))


def upsert_catalog(
    stored: tuple[DataFrame, DataFrame, DataFrame], incoming: tuple[DataFrame, DataFrame, DataFrame]
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows to append for securities, tickers and identifiers.

    Nothing stored is changed. Tickers and identifiers of an unknown seed key are skipped.
    """
    secs = keep_first(incoming[0], ["seed_key"], [c for c in incoming[0].columns if c != "seed_key"])
    new_securities = upsert_new(stored[0], secs, ["seed_key"])
    known = stored[0].select("seed_key").unionByName(secs.select("seed_key")).distinct()
    tickers = upsert_new(
        stored[1], incoming[1].join(known, "seed_key", "left_semi"), ["seed_key", "scheme", "ticker", "valid_from"], ["valid_to"]
    )
    ids = upsert_new(stored[2], incoming[2].join(known, "seed_key", "left_semi"), ["seed_key", "id_type", "id_value"])
    return new_securities, tickers.dropDuplicates(["seed_key", "scheme", "ticker", "valid_from", "valid_to"]), ids.dropDuplicates(
        ["seed_key", "id_type", "id_value"]
    )
