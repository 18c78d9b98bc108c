"""Declared schemas, and the check that a frame has the columns an operator needs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

PRICE = T.DecimalType(18, 6)
OPEN_END = "9999-12-31"

BAR_TEXT_COLUMNS = ("symbol", "timestamp", "open", "high", "low", "close", "adjusted_close", "volume")
OHLCV_COLUMNS = ("symbol", "timestamp", "open", "high", "low", "close", "volume")

BARS = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("session", T.DateType()),
        T.StructField("open", PRICE),
        T.StructField("high", PRICE),
        T.StructField("low", PRICE),
        T.StructField("close", PRICE),
        T.StructField("adjusted_close", PRICE),
        T.StructField("volume", T.LongType()),
    ]
)

MEMBERSHIPS = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("start_date", T.DateType()),
        T.StructField("end_date", T.DateType()),
        T.StructField("source", T.StringType()),
        T.StructField("source_version", T.StringType()),
    ]
)

CATALOG_JSON = T.StructType(
    [
        T.StructField("version", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("source_version", T.StringType()),
        T.StructField(
            "securities",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("seed_key", T.StringType()),
                        T.StructField("display_name", T.StringType()),
                        T.StructField("security_type", T.StringType()),
                        T.StructField("currency", T.StringType()),
                        T.StructField("status", T.StringType()),
                        T.StructField("notes", T.StringType()),
                        T.StructField(
                            "identifiers",
                            T.ArrayType(
                                T.StructType(
                                    [
                                        T.StructField("id_type", T.StringType()),
                                        T.StructField("id_value", T.StringType()),
                                        T.StructField("valid_from", T.StringType()),
                                        T.StructField("valid_to", T.StringType()),
                                    ]
                                )
                            ),
                        ),
                        T.StructField(
                            "tickers",
                            T.ArrayType(
                                T.StructType(
                                    [
                                        T.StructField("scheme", T.StringType()),
                                        T.StructField("ticker", T.StringType()),
                                        T.StructField("valid_from", T.StringType()),
                                        T.StructField("valid_to", T.StringType()),
                                        T.StructField("continuity", T.BooleanType()),
                                        T.StructField("source", T.StringType()),
                                        T.StructField("source_version", T.StringType()),
                                    ]
                                )
                            ),
                        ),
                    ]
                )
            ),
        ),
    ]
)


class SchemaError(ValueError):
    """A frame or file lacks columns that an operator needs."""


def assert_columns(df: DataFrame, required: Iterable[str], what: str = "input") -> DataFrame:
    present = {name.strip().lower() for name in df.columns}
    missing = sorted(set(required) - present)
    if missing:
        raise SchemaError(f"{what}: missing required columns {', '.join(missing)}")
    return df
