"""Spark derivations of the stand-in tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitlab.operators.calendars import rebalance_dates, trading_calendar
from pitlab.operators.intervals import snapshots_to_intervals
from pitlab.schemas import PRICE
from pitlab.session import shared_folder

CENTS = T.DecimalType(18, 2)
MEMBER_VOLUME = 150
#: Order lines that one task of ``build_bars`` sorts, some 100 bytes each.
LINES_PER_TASK = 1_250_000


def ticker(number: Column | str) -> Column:
    return F.format_string("S%06d", F.col(number) if isinstance(number, str) else number)


# Paths of tables already written, by application, data folder and name.
_WRITTEN: dict[tuple[str, str, str], tuple[str, T.StructType]] = {}


class Standins:
    """Tables derived from one data folder.

    Bars, calendar, snapshots, memberships and the trade tape are what a research store holds, so they
    are derived once per application and written to the shared folder, as an import would.
    Queries then read pruned columns of those tables instead of deriving them from every
    order line again and again. The other tables are lazy views of small dimensions.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def written(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in _WRITTEN:
            df = build()
            path = f"{shared_folder(self.spark)}/pitlab/store/{uuid.uuid4().hex}/{name}"
            df.write.parquet(path)
            _WRITTEN[key] = (path, df.schema)
        path, schema = _WRITTEN[key]
        return self.spark.read.schema(schema).parquet(path)

    @cached_property
    def bars(self) -> DataFrame:
        return self.written("bars", self.build_bars)

    def build_bars(self) -> DataFrame:
        """One bar per supplier and ship date.

        First and last print are the least and greatest line, so the whole bar is one aggregation. A supplier ships a line or
        two a day, so folding in the map task would sort all lines there, send hardly fewer rows, and each with two
        whole lines. The lines themselves are shuffled and sorted once, as narrow as they are read.
        """
        line = F.struct(
            "l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("px"), "l_quantity", "l_discount"
        )
        lines = self.table("lineitem")
        keys = ["l_suppkey", "session"]
        narrow = lines.select(
            "l_suppkey", F.col("l_shipdate").cast("date").alias("session"),
            "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount",
        )
        # Partitions of a large table have a size of their own; those of a small one are the session's, joined as it likes.
        parts = -(-lines.count() // LINES_PER_TASK)
        wider = [parts] if parts > self.spark.sparkContext.defaultParallelism else []
        daily = (
            narrow.repartition(*wider, *keys)
            .groupBy(*keys)
            .agg(
                F.min(line).alias("first"),
                F.max(line).alias("last"),
                F.max("l_extendedprice").alias("high"),
                F.min("l_extendedprice").alias("low"),
                F.sum(F.col("l_quantity").cast("long")).alias("volume"),
            )
        )
        price = lambda c: F.col(c).cast(CENTS).cast(PRICE)
        adjusted = (F.col("last.px").cast(CENTS) * (1 - F.col("last.l_discount").cast(T.DecimalType(4, 2)))).cast(PRICE)
        return daily.select(
            ticker("l_suppkey").alias("symbol"),
            (F.col("session").cast("timestamp") + F.expr("interval 14 hours 30 minutes")).alias("ts"),
            "session",
            price("first.px").alias("open"),
            price("high").alias("high"),
            price("low").alias("low"),
            price("last.px").alias("close"),
            F.when(F.col("volume") % 29 != 0, adjusted).alias("adjusted_close"),
            "volume",
        )

    @cached_property
    def raw_bars(self) -> DataFrame:
        """Order lines as unchecked text bars, with every kind of defect.

        Several lines of one supplier and day are duplicates; the source text orders them.
        """
        px = F.col("l_extendedprice").cast(CENTS)
        up, down = px * F.lit("1.02").cast("decimal(3,2)"), px * F.lit("0.98").cast("decimal(3,2)")
        crossed = F.col("l_tax") == 0.08
        text = lambda c: c.cast("string")
        sign = F.when((F.col("l_discount") == 0.1) & (F.col("l_tax") == 0.05), -1).otherwise(1)
        stamp = F.date_format("l_shipdate", "yyyy-MM-dd'T'14:30:00")
        return self.table("lineitem").select(
            F.concat(F.lit(" "), F.lower(ticker("l_suppkey"))).alias("symbol"),
            F.concat(stamp, F.when(F.col("l_linenumber") == 7, "").otherwise("Z")).alias("timestamp"),
            text(px).alias("open"),
            text(F.when(crossed, down).otherwise(up)).alias("high"),
            text(F.when(crossed, up).otherwise(down)).alias("low"),
            text(px).alias("close"),
            F.when(F.col("l_discount") == 0, "")
            .otherwise(text(px * (1 - F.col("l_discount").cast(T.DecimalType(4, 2)))))
            .alias("adjusted_close"),
            text(F.col("l_quantity").cast("long") * sign).alias("volume"),
            F.concat_ws(
                "-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (px * 100).cast("long"), F.col("l_quantity").cast("long")
            ).alias("source"),
            F.col("l_orderkey").alias("row_number"),
            F.col("l_returnflag").alias("feed"),
        )

    @cached_property
    def calendar(self) -> DataFrame:
        return self.written("calendar", self.build_calendar)

    def build_calendar(self) -> DataFrame:
        """Sessions straight from the ship dates: no bar needs to be built for them."""
        return trading_calendar(self.table("lineitem").select(F.col("l_shipdate").cast("date").alias("session")))

    @cached_property
    def rebalances(self) -> DataFrame:
        return self.written("rebalances", lambda: rebalance_dates(self.calendar))

    @cached_property
    def snapshots(self) -> DataFrame:
        return self.written("snapshots", self.build_snapshots)

    def build_snapshots(self) -> DataFrame:
        """A supplier is in the index after each month in which it shipped enough."""
        month = F.trunc(F.col("l_shipdate").cast("date"), "MM")
        volume = (
            self.table("lineitem")
            .groupBy("l_suppkey", month.alias("month"))
            .agg(F.sum(F.col("l_quantity").cast("long")).alias("volume"))
        )
        return volume.filter(F.col("volume") >= MEMBER_VOLUME).select(
            F.add_months("month", 1).alias("change_date"), ticker("l_suppkey").alias("symbol")
        )

    @cached_property
    def memberships(self) -> DataFrame:
        return self.written("memberships", lambda: snapshots_to_intervals(self.snapshots))

    @cached_property
    def securities(self) -> DataFrame:
        """Catalog securities; the last digit of a supplier decides its history (see ``tickers``)."""
        digit = F.col("s_suppkey") % 10
        old = F.when(digit.isin(0, 4), F.struct(F.lit("-old").alias("suffix"), F.when(digit == 0, "DELISTED").otherwise("ACTIVE").alias("status")))
        new = F.when(digit <= 8, F.struct(F.lit("").alias("suffix"), F.when(digit == 2, "DELISTED").otherwise("ACTIVE").alias("status")))
        return (
            self.table("supplier")
            .select("s_suppkey", "s_name", F.explode(F.array_compact(F.array(old, new))).alias("e"))
            .select(
                F.concat(F.lit("sec-"), F.format_string("%06d", "s_suppkey"), F.col("e.suffix")).alias("seed_key"),
                F.col("s_name").alias("display_name"),
                F.lit("COMMON_STOCK").alias("security_type"),
                F.lit("USD").alias("currency"),
                F.col("e.status").alias("status"),
            )
        )

    @cached_property
    def tickers(self) -> DataFrame:
        """0 recycled ticker, 1 renamed, 2 delisted, 3 listed late, 4 two claims on one ticker,
        5 to 8 plain, 9 unknown to the catalog."""
        digit, name = F.col("s_suppkey") % 10, ticker("s_suppkey")
        seed = F.concat(F.lit("sec-"), F.format_string("%06d", "s_suppkey"))
        rows = []

        def row(which: Column, order: int, key: Column, scheme: str, text: Column, start: str, end: str | None) -> None:
            rows.append(
                F.when(
                    which,
                    F.struct(
                        key.alias("seed_key"),
                        F.lit(scheme).alias("scheme"),
                        text.alias("ticker"),
                        F.lit(start).cast("date").alias("valid_from"),
                        F.lit(end).cast("date").alias("valid_to"),
                        F.lit(order).cast("long").alias("ord"),
                    ),
                )
            )

        older, renamed = F.concat(seed, F.lit("-old")), F.concat(name, F.lit("X"))
        row(digit == 0, 1, older, "listing", name, "1995-01-01", "1997-01-01")
        row(digit == 0, 2, seed, "listing", name, "1997-07-01", None)
        row(digit == 0, 3, seed, "vendor", name, "1997-07-01", None)
        row(digit == 1, 1, seed, "listing", name, "1995-01-01", "1999-01-01")
        row(digit == 1, 2, seed, "listing", renamed, "1999-01-01", None)
        row(digit == 1, 3, seed, "vendor", renamed, "1995-01-01", None)
        row(digit == 2, 1, seed, "listing", name, "1995-01-01", "2001-10-01")
        row(digit == 2, 2, seed, "vendor", name, "1995-01-01", "2001-10-01")
        row(digit == 3, 1, seed, "listing", name, "1996-01-01", None)
        row(digit == 3, 2, seed, "vendor", name, "1996-01-01", None)
        row(digit == 4, 1, older, "listing", name, "1995-01-01", "1999-01-01")
        row(digit == 4, 2, seed, "listing", name, "1998-01-01", None)
        row(digit == 4, 3, older, "vendor", name, "1995-01-01", "1998-01-01")
        row(digit == 4, 4, seed, "vendor", name, "1998-01-01", None)
        row(digit.between(5, 8), 1, seed, "listing", name, "1994-01-01", None)
        row(digit.between(5, 8), 2, seed, "vendor", name, "1994-01-01", None)
        return self.table("supplier").select(F.explode(F.array_compact(F.array(*rows))).alias("t")).select("t.*")

    @cached_property
    def orders(self) -> DataFrame:
        return self.written("orders", self.build_orders)

    def build_orders(self) -> DataFrame:
        """Trade tape: customers trade ten names; a line without tax has no price."""
        cents = (F.col("l_extendedprice").cast(CENTS) * 100).cast("long")
        return (
            self.table("lineitem")
            .join(self.table("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
            .select(
                F.col("o_custkey").alias("portfolio_id"),
                F.concat_ws(
                    "-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cents, F.col("l_quantity").cast("long")
                ).alias("order_id"),
                ticker(F.col("l_suppkey") % 10).alias("position_key"),
                F.col("l_shipdate").cast("date").alias("session"),
                F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"),
                F.col("l_linenumber").cast("long").alias("quantity"),
                F.when(F.col("l_tax") > 0, F.col("l_extendedprice").cast(CENTS)).cast(PRICE).alias("market_price"),
            )
        )

    @cached_property
    def accounts(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("portfolio_id"),
            (F.col("c_acctbal").cast(CENTS) * 100).cast(PRICE).alias("cash"),
        )

    @cached_property
    def traded(self) -> DataFrame:
        return self.written("traded", self.build_traded)

    def build_traded(self) -> DataFrame:
        """A row per portfolio and name: what was sold of it, and whether a purchase of it had a price.

        Holdings and wanted names both come from it. It is folded from the narrow order lines, so the tape with its texts need not be written.
        """
        sold, bought = F.col("side") == "SELL", F.col("side") == "BUY"
        return self.build_orders().groupBy("portfolio_id", F.col("position_key").alias("symbol")).agg(
            F.count_if(sold).alias("sales"),
            F.sum(F.when(sold, F.col("quantity"))).alias("quantity"),
            F.max(F.when(sold, F.col("market_price"))).alias("market_price"),
            (F.count_if(bought & F.col("market_price").isNotNull()) > 0).alias("wanted"),
        )

    @cached_property
    def holdings(self) -> DataFrame:
        return self.traded.filter("sales > 0").select(
            "portfolio_id",
            F.concat(F.lit("security:"), "symbol").alias("position_key"),
            "symbol",
            "quantity",
            F.coalesce("market_price", F.lit(0)).cast(PRICE).alias("market_price"),
            (F.col("quantity") % 11 != 0).alias("valued"),
        )

    @cached_property
    def wanted(self) -> DataFrame:
        """Names each portfolio wants: the priced ones among its purchases."""
        return self.traded.filter("wanted").select("portfolio_id", "symbol", F.concat(F.lit("security:"), "symbol").alias("position_key"))

    @cached_property
    def vendor(self) -> DataFrame:
        """Vendor directory: live symbols, and suffixed ones for listings that ended."""
        digit, name = F.col("s_suppkey") % 10, ticker("s_suppkey")
        number = F.format_string("%06d", "s_suppkey")

        def entry(which: Column, symbol: Column, asset: Column, first: str, last: str | None) -> Column:
            return F.when(
                which,
                F.struct(
                    symbol.alias("vendor_symbol"),
                    asset.alias("asset_id"),
                    F.upper("s_name").alias("security_name"),
                    F.lit(first).cast("date").alias("first_quoted"),
                    F.lit(last).cast("date").alias("last_quoted"),
                ),
            )

        live = entry(digit != 2, name, F.concat(F.lit("A"), number), "1996-06-01", None)
        recycled = entry(digit == 0, F.concat(name, F.lit("-199701")), F.concat(F.lit("D"), number), "1994-01-01", "1997-01-01")
        ended = entry(digit == 2, F.concat(name, F.lit("-200110")), F.concat(F.lit("D"), number), "1994-01-01", "2001-10-01")
        twin = entry(digit == 2, F.concat(name, F.lit("-199901")), F.concat(F.lit("E"), number), "1994-01-01", "1999-01-01")
        renamed = entry(digit == 1, F.concat(name, F.lit("X")), F.concat(F.lit("A"), number), "1995-01-01", None)
        each = F.explode(F.array_compact(F.array(live, recycled, ended, twin, renamed)))
        return self.table("supplier").select(each.alias("v")).select("v.*")

    @cached_property
    def fund_trades(self) -> DataFrame:
        return self.written("fund_trades", self.build_fund_trades)

    def build_fund_trades(self) -> DataFrame:
        """Order lines as trades in all suppliers' names, of a fund per nation of the customer; a line without tax has no price."""
        cents = (F.col("l_extendedprice").cast(CENTS) * 100).cast("long")
        owner = self.table("orders").join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
        return self.table("lineitem").join(owner, F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.col("c_nationkey").cast("long").alias("portfolio_id"),
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cents, F.col("l_quantity").cast("long")).alias("order_id"),
            ticker("l_suppkey").alias("position_key"),
            F.col("l_shipdate").cast("date").alias("session"),
            F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"),
            F.col("l_linenumber").cast("long").alias("quantity"),
            F.when(F.col("l_tax") > 0, F.col("l_extendedprice").cast(CENTS)).cast(PRICE).alias("market_price"),
        )

    @cached_property
    def fund_orders(self) -> DataFrame:
        """The priced trades, and for each position that is ever sold a first lot that covers all its sales."""
        priced = self.fund_trades.filter("market_price IS NOT NULL")
        sold = F.col("side") == "SELL"
        lots = priced.groupBy("portfolio_id", "position_key").agg(
            F.sum(F.when(sold, F.col("quantity"))).alias("quantity"), F.min(F.when(sold, F.col("market_price"))).alias("market_price"), F.min("session").alias("session")
        )
        opened = lots.filter("quantity > 0").withColumn("order_id", F.lit("-open")).withColumn("side", F.lit("BUY"))
        return priced.unionByName(opened)

    @cached_property
    def actions(self) -> DataFrame:
        """Corporate actions from the parts and the days they shipped: one per (supplier, day, part type).

        The splits of a name go 2, 1.5, 0.333333 and so on, so its shares stay of one size.
        """
        kind = (
            F.when(F.col("p_type").isin("ECONOMY", "LARGE"), "SPLIT")
            .when(F.col("p_type") == "SMALL", "CASH_DIVIDEND")
            .when(F.col("p_type") == "MEDIUM", "RENAME")
            .when(F.col("p_type") == "PROMO", "SHARE_CONVERSION")
            .otherwise("CASH_ACQUISITION")
        )
        own = Window.partitionBy("position_key", "effective_date").orderBy("kind")
        splits = Window.partitionBy("position_key", "kind").orderBy("effective_date")
        lines = self.table("lineitem").join(self.table("part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
        days = lines.select(ticker("l_suppkey").alias("position_key"), F.col("l_shipdate").cast("date").alias("effective_date"), kind.alias("kind")).distinct()
        turn = days.withColumn("seq", F.row_number().over(own).cast("long")).withColumn("n", F.row_number().over(splits) % 3)
        factor = F.when(F.col("n") == 1, "2").when(F.col("n") == 2, "1.5").otherwise("0.333333")
        split = F.col("kind") == "SPLIT"
        return turn.select(
            "position_key",
            "effective_date",
            "seq",
            F.when(split & (F.col("n") == 0), "REVERSE_SPLIT").otherwise(F.col("kind")).alias("action_type"),
            F.when(split, factor).cast(PRICE).alias("factor"),
            F.when(F.col("kind") == "CASH_DIVIDEND", F.lit("1.25")).cast(PRICE).alias("amount"),
            F.when(F.col("kind") == "RENAME", F.concat("position_key", F.lit("-new"))).alias("ticker"),
            F.lit(None).cast(PRICE).alias("terminal_price"),
        )


def misfiled(rows: DataFrame, where: Column) -> DataFrame:
    """``rows`` with those that meet the condition under another name: a defect in which no row is lost."""
    return rows.withColumn("symbol", F.when(where, F.concat("symbol", F.lit("-"))).otherwise(F.col("symbol")))
