"""Daily bar files and tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitlab.functions.checks import bar_rules, format_issue, issues, strict_bar_rules
from pitlab.functions.dates import has_offset, month_of
from pitlab.functions.text import fixed_point, normalize_symbol
from pitlab.operators.dedupe import dedupe_bars
from pitlab.params import ParameterError, warmup_start
from pitlab.schemas import BAR_TEXT_COLUMNS, BARS, OHLCV_COLUMNS, PRICE, SchemaError
from pitlab.sources import csvfiles

NUMBERS = ("open", "high", "low", "close")
# Fixed value: the UTC time of day given to a bar that only names its date.
CLOSE_TIME = "14:30:00"
#: Tasks that list the folders of a store, and the bytes that opening a file for its footer counts for.
LISTING_TASKS, FOOTER_COST = 256, 1 << 18


def parse_bars(raw: DataFrame, strict: bool = False, fatal: bool = True, carry: Sequence[str] = ()) -> DataFrame:
    """Typed bars from text columns, with ``issues`` naming every violated rule.

    ``source`` and ``row_number`` are kept if present, and so are the ``carry`` columns.

    A number or timestamp that cannot be read stops the job when ``fatal``; otherwise it
    becomes the issue ``unparseable row``. A readable time without a UTC offset is a
    rejected row in both cases.
    """
    text = {c: F.trim(F.col(c)) for c in BAR_TEXT_COLUMNS}

    def number(name: str, kind: T.DataType, optional: bool = False) -> Column:
        value = text[name].try_cast(kind)
        bad = value.isNull() if not optional else value.isNull() & (F.coalesce(text[name], F.lit("")) != "")
        if not fatal:
            return value
        problem = F.concat(F.lit(f"cannot read {name}: "), F.coalesce(text[name], F.lit("NULL")))
        return F.when(bad, F.raise_error(problem).cast(kind)).otherwise(value)

    def whole(name: str) -> Column:
        """A count; ``100.0`` is one, ``100.5`` is not."""
        value = text[name].try_cast(T.DecimalType(38, 10))
        found = F.when(value == F.floor(value), value).try_cast(T.LongType())
        if not fatal:
            return found
        problem = F.concat(F.lit(f"cannot read {name}: "), F.coalesce(text[name], F.lit("NULL")))
        return F.when(found.isNull(), F.raise_error(problem).cast("long")).otherwise(found)

    ts = text["timestamp"].try_cast("timestamp")
    if fatal:
        problem = F.concat(F.lit("cannot read timestamp: "), F.coalesce(text["timestamp"], F.lit("NULL")))
        ts = F.when(ts.isNull(), F.raise_error(problem).cast("timestamp")).otherwise(ts)
    kept = [c for c in ("source", "row_number", *carry) if c in raw.columns]
    cells = F.struct(
        normalize_symbol("symbol").alias("symbol"),
        ts.alias("ts"),
        *[number(c, PRICE).alias(c) for c in NUMBERS],
        number("adjusted_close", PRICE, optional=True).alias("adjusted_close"),
        whole("volume").alias("volume"),
        (~has_offset(text["timestamp"])).alias("naive"),
        *[F.col(c) for c in kept],
    )
    # Each text is read once: a filter on the rules below cannot be pushed through a
    # generator, where it would parse every text again for every rule that mentions it.
    typed = raw.select(F.inline(F.array(cells)))
    rules = strict_bar_rules(F.col("naive")) if strict else bar_rules(F.col("naive"))
    if not fatal:
        unread = F.col("ts").isNull() | F.col("volume").isNull()
        for c in NUMBERS:
            unread = unread | F.col(c).isNull()
        rules = [(unread, "unparseable row"), *rules]
    return typed.withColumn("issues", issues(rules)).withColumn("session", F.to_date("ts")).drop("naive")


def read_csv_rows(spark: SparkSession, path: str | Sequence[str], what: str = "bar file") -> DataFrame:
    """Text cells of bar files, each file read by the names in its own first line.

    Adds ``source`` (the file), ``row_number`` (its line, the header being line 1) and ``file_symbol``. Files may name their
    columns in any order and have others besides; one without the required columns is an error.
    """
    # One value per way of writing the first line, not per file.
    for (header,) in csvfiles.heads(spark, path).select("header").distinct().toLocalIterator():
        missing = sorted(set(BAR_TEXT_COLUMNS) - set(header))
        if missing:
            raise SchemaError(f"{what}: missing required columns {', '.join(missing)}")
    return csvfiles.rows(spark, path, BAR_TEXT_COLUMNS)


def read_bars_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    symbols: Sequence[str] | None = None,
    start: date | None = None,
    end: date | None = None,
    strict: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Strict scan. Returns (bars, rejects, per-symbol counts).

    Rows outside the symbols and the range are not counted. Bars are de-duplicated,
    the first of a (symbol, ts) in file order winning.
    """
    if start is not None and end is not None and start > end:
        raise ParameterError("start must be <= end")
    rows = read_csv_rows(spark, path)
    if symbols is not None:
        rows = rows.filter(normalize_symbol("symbol").isin([s.strip().upper() for s in symbols]))
    parsed = parse_bars(rows, strict=strict)
    if start is not None:
        parsed = parsed.filter(F.col("session") >= F.lit(start))
    if end is not None:
        parsed = parsed.filter(F.col("session") <= F.lit(end))
    good = parsed.filter(F.size("issues") == 0)
    unique = dedupe_bars(good.drop("issues"), ["source", "row_number"], count_as="copies")
    rejects = parsed.filter(F.size("issues") > 0).withColumn(
        "messages",
        F.transform(
            "issues",
            lambda m: format_issue(m, F.col("row_number"), F.col("symbol"), F.col("ts"), F.col("source")),
        ),
    )
    read = parsed.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows_read"), F.count_if(F.size("issues") > 0).alias("invalid_rows")
    )
    kept = unique.groupBy("symbol").agg(F.sum(F.col("copies") - 1).alias("duplicates"))
    counts = read.join(kept, "symbol", "left").fillna(0, ["duplicates"])
    return unique.select(*BARS.fieldNames()), rejects, counts


def read_bars_lenient(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Cache scan: rows that cannot be read or break a rule are dropped, then first wins."""
    rows = read_csv_rows(spark, path, "bar cache")
    good = parse_bars(rows, fatal=False).filter(F.size("issues") == 0).drop("issues")
    return dedupe_bars(good, ["source", "row_number"]).select(*BARS.fieldNames())


def discover_symbols(spark: SparkSession, folder: str, skip: Sequence[str] = ("memberships",)) -> DataFrame:
    """Symbols named by bar files, those whose first line has the OHLCV columns. Nothing else of the files is read."""
    wanted = F.array(*[F.lit(c) for c in OHLCV_COLUMNS])
    return (
        csvfiles.heads(spark, folder)
        .filter(F.size(F.array_except(wanted, "header")) == 0)
        .select(F.col("file_symbol").alias("symbol"))
        .filter(~F.col("symbol").isin([s.upper() for s in skip]))
        .distinct()
    )


def read_symbol_files(spark: SparkSession, folder: str, *symbols: str) -> DataFrame:
    """Raw rows of the files of some symbols (all, if none is named), found by name without regard to case.

    If two files name a symbol, the first by name counts.
    ``{SYMBOL}.csv`` and ``{symbol}_daily.csv`` are a symbol's names. Other files are not opened. A symbol without a file is
    an error; rows of other symbols in a file are left out.
    """
    wanted = sorted({s.strip().upper() for s in symbols})
    asked = F.col("file_symbol").isin(wanted) if wanted else F.lit(True)
    named = csvfiles.heads(spark, folder, one_per_symbol=True).filter(asked).select("file_symbol")
    found = {r[0] for r in named.collect()} if wanted else set()
    if len(found) < len(wanted):
        raise ParameterError(f"no bar file for symbol {', '.join(sorted(set(wanted) - found))} in {folder}")
    rows = csvfiles.rows(spark, folder, BAR_TEXT_COLUMNS, one_per_symbol=True).filter(asked)
    return rows.filter(normalize_symbol("symbol") == F.col("file_symbol"))


def read_bars(spark: SparkSession, path: str, provider: str = "parquet", **options: str) -> DataFrame:
    """Bars from a named provider. CSV is the strict scan; Parquet, ORC and JDBC are tables."""
    kind = provider.strip().lower()
    if kind == "csv":
        return read_bars_csv(spark, path)[0]
    if kind in ("parquet", "orc"):
        return spark.read.format(kind).schema(BARS).load(path)
    if kind == "jdbc":
        return spark.read.format("jdbc").options(**options).load()
    raise ParameterError(f"unknown market data provider {provider}")


def bars_in_range(bars: DataFrame, start: date, end: date, symbols: Sequence[str] | None = None) -> DataFrame:
    """Inclusive range on the stored session column, so the scan can skip row groups."""
    kept = bars.filter((F.col("session") >= F.lit(start)) & (F.col("session") <= F.lit(end)))
    if symbols is not None:
        kept = kept.filter(F.col("symbol").isin([s.strip().upper() for s in symbols]))
    return kept


def load_history(bars: DataFrame, start: date, end: date, lookback: int, symbols: Sequence[str] | None = None) -> DataFrame:
    """The range plus warm-up history before it."""
    return bars_in_range(bars, warmup_start(start, lookback), end, symbols)


def normalize_raw_rows(raw: DataFrame) -> DataFrame:
    """Downloaded rows (date, prices, volume) to strict bars with issues.

    The bar is stamped 14:30 UTC on its date. NaN, missing numbers and a volume with a
    fraction make the row unparseable.
    """

    def number(name: str) -> Column:
        value = F.col(name).cast("string")
        return F.when(F.lower(value) == "nan", F.lit(None)).otherwise(value).try_cast(PRICE)

    whole = F.col("volume").cast("string").try_cast(T.DecimalType(28, 6))
    day = F.try_to_date(F.substring(F.trim(F.col("date").cast("string")), 1, 10), "yyyy-MM-dd")
    bars = raw.select(
        normalize_symbol("symbol").alias("symbol"),
        F.to_timestamp(F.concat_ws(" ", day.cast("string"), F.lit(CLOSE_TIME))).alias("ts"),
        day.alias("session"),
        *[number(c).alias(c) for c in NUMBERS],
        number("adjusted_close").alias("adjusted_close"),
        F.when(whole == F.floor(whole), whole).cast("long").alias("volume"),
        (
            (F.coalesce(F.col("adjusted_close").cast("string"), F.lit("")) != "") & number("adjusted_close").isNull()
        ).alias("_bad_adjusted"),
        *[c for c in ("row_number", "source") if c in raw.columns],
    )
    unread = F.col("ts").isNull() | F.col("volume").isNull() | F.col("_bad_adjusted")
    for c in NUMBERS:
        unread = unread | F.col(c).isNull()
    found = F.when(unread, F.array(F.lit("unparseable row"))).otherwise(issues(strict_bar_rules()))
    return bars.withColumn("issues", found).drop("_bad_adjusted")


def bar_cells(bars: DataFrame) -> DataFrame:
    """Bars as the text columns of a bar file."""
    return bars.select(
        "symbol",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("timestamp"),
        *[F.col(c).cast("string").alias(c) for c in NUMBERS],
        fixed_point(F.col("adjusted_close")).alias("adjusted_close"),
        F.col("volume").cast("string").alias("volume"),
    )


def write_bars(bars: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Canonical sink: each file sorted by (symbol, ts).

    Range partitioning on both columns lets one large symbol spread over many files.
    """
    ordered = bars.repartitionByRange("symbol", "ts").sortWithinPartitions("symbol", "ts")
    if fmt == "csv":
        bar_cells(ordered).write.mode(mode).option("header", "true").option("emptyValue", "").csv(path)
    else:
        ordered.write.mode(mode).format(fmt).save(path)


def write_bucketed(bars: DataFrame, table: str, path: str, buckets: int, key: str = "symbol", day: str = "session") -> DataFrame:
    """A table bucketed by (key, month) and sorted by day inside a bucket, for joins and aggregations without a shuffle of bars.

    Bucketing by the month too spreads a hot symbol over many buckets. Returns the table. ``buckets`` should be
    chosen so that a bucket is a task's work, some hundred MB.
    """
    placed = bars.withColumn("month", month_of(day)).repartition(buckets, key, "month")
    placed.write.mode("overwrite").bucketBy(buckets, key, "month").sortBy(key, "month", day).option("path", path).saveAsTable(table)
    return bars.sparkSession.table(table)


def write_by_symbol(bars: DataFrame, path: str) -> None:
    """A folder per symbol, its files sorted by session: the layout that ``stored_extents`` reads.

    A symbol has at most one bar per session, so one task writes a symbol.
    """
    ordered = bars.repartition("symbol").sortWithinPartitions("symbol", "session")
    ordered.write.mode("overwrite").partitionBy("symbol").parquet(path)


def stored_extents(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, first_date, last_date, bars) of bars that ``write_by_symbol`` wrote, from the footers of their files.

    Spark answers MIN, MAX and COUNT by partition from Parquet statistics only in its newer file reader, and that is chosen by
    settings of a session. They are set in a session of its own, so the caller's stay as they are. No data page is read.
    Symbols are texts whatever they look like; a NULL symbol is one group.
    """
    reader = spark.newSession()
    older = reader.conf.get("spark.sql.sources.useV1SourceList").split(",")
    reader.conf.set("spark.sql.sources.useV1SourceList", ",".join(x for x in older if x.strip().lower() != "parquet"))
    reader.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    reader.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", "false")  # a symbol such as 007 is a text
    # Many small files: a task lists and reads some hundred of them, where Spark would take one and thirty.
    reader.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", str(LISTING_TASKS))
    reader.conf.set("spark.sql.files.openCostInBytes", str(FOOTER_COST))
    stored = reader.read.parquet(path)
    return stored.groupBy("symbol").agg(F.min("session").alias("first_date"), F.max("session").alias("last_date"), F.count(F.lit(1)).alias("bars"))


def write_symbol_files(bars: DataFrame, folder: str) -> None:
    """A file ``{SYMBOL}.csv`` per symbol, sorted by time, all of them or none.

    A symbol has at most one bar per session, so a file holds some ten thousand rows and is one task's work.
    """
    ordered = bars.repartition("symbol").sortWithinPartitions("symbol", "ts")
    csvfiles.write_symbol_files(bar_cells(ordered), folder)
