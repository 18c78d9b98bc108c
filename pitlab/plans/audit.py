"""Integrity audit of index memberships against prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitlab.operators.rows import side_by_side
from pitlab.plans.universe import appearances, future_leakage, membership_extents, universe_as_of, validate_memberships

PRICE_GAP_DAYS = 365
# Letters and names of the symbol classes.
CLASSES = {
    "a": "valid historical constituent",
    "b": "ticker-change mapping issue",
    "c": "symbol normalization issue",
    "d": "fixture/test contamination",
    "e": "bad historical membership data",
    "f": "other",
}
FIXTURE_SOURCE = "test-fixture"


def late_price_start(extents: DataFrame, windows: DataFrame, gap_days: int = PRICE_GAP_DAYS) -> DataFrame:
    """Symbols whose prices begin after membership and well after the price corpus begins."""
    corpus = windows.agg(F.min("first_date")).scalar()
    joined = extents.join(windows.select("symbol", "first_date"), "symbol")
    late = (F.col("first_start") < F.col("first_date")) & (F.datediff("first_date", corpus) > gap_days)
    return joined.filter(late).select("symbol")


def membership_after_prices(extents: DataFrame, windows: DataFrame, gap_days: int = PRICE_GAP_DAYS) -> DataFrame:
    """Symbols still members after their prices end, while the corpus goes on.

    Closed membership must end after the last bar; open membership only needs a stale tape.
    """
    corpus = windows.agg(F.max("last_date")).scalar()
    joined = extents.join(windows.select("symbol", "last_date"), "symbol")
    stale = F.datediff(corpus, "last_date") > gap_days
    beyond = F.col("latest_end").isNull() | (F.col("last_date") < F.col("latest_end"))
    return joined.filter(stale & beyond).select("symbol")


def fixture_symbols(memberships: DataFrame) -> DataFrame:
    return memberships.filter(F.col("source") == FIXTURE_SOURCE).select("symbol").distinct()


def suffixed_symbols(memberships: DataFrame) -> DataFrame:
    """Symbols that kept a removal suffix through normalisation."""
    return memberships.filter(F.col("symbol").rlike("-[0-9]{6}$")).select("symbol").distinct()


def symbol_flags(memberships: DataFrame, windows: DataFrame, dates: DataFrame, gap_days: int = PRICE_GAP_DAYS) -> DataFrame:
    """One row per member symbol with a flag for every suspicion."""
    checked = validate_memberships(memberships).groupBy("symbol").agg(
        F.bool_or("impossible").alias("invalid"), F.bool_or(F.col("overlap_count") > 0).alias("overlapping")
    )
    extents = membership_extents(memberships)
    leaked = future_leakage(universe_as_of(memberships, dates), memberships).select("symbol").distinct()
    flags = {
        "fixture": fixture_symbols(memberships),
        "late_price_start": late_price_start(extents, windows, gap_days),
        "after_prices": membership_after_prices(extents, windows, gap_days),
        "leaked": leaked,
    }
    rows = checked
    for name, symbols in flags.items():
        rows = rows.join(symbols.withColumn(name, F.lit(True)), "symbol", "left").fillna(False, [name])
    any_flag = F.col("invalid") | F.col("overlapping")
    for name in flags:
        any_flag = any_flag | F.col(name)
    return rows.withColumn("suspicious", any_flag)


def classify_symbols(flags: DataFrame, memberships: DataFrame, windows: DataFrame, dates: DataFrame) -> DataFrame:
    """Class and note of each symbol, the first rule that applies, with its appearances and prices."""
    seen = appearances(memberships, dates)
    sources = memberships.groupBy("symbol").agg(F.min("source").alias("source"))
    priced = windows.select("symbol", F.col("first_date").alias("price_first"), F.col("last_date").alias("price_last"))
    rows = flags.join(seen, "symbol", "left").join(sources, "symbol", "left").join(priced, "symbol", "left")

    def out(letter: str, note: Column | str) -> Column:
        text = note if isinstance(note, Column) else F.lit(note)
        return F.struct(F.lit(letter).alias("class"), F.lit(CLASSES[letter]).alias("label"), text.alias("note"))

    span = F.concat(
        F.lit("Prices "), F.date_format("price_first", "yyyy-MM-dd"), F.lit(" to "), F.date_format("price_last", "yyyy-MM-dd")
    )
    verdict = (
        F.when(F.col("fixture"), out("d", "Membership comes from a test fixture."))
        .when(F.col("invalid") | F.col("overlapping"), out("e", "Impossible or overlapping intervals."))
        .when(F.col("symbol").rlike("-[0-9]{6}$"), out("c", "Removal suffix left in the ticker."))
        .when(F.col("late_price_start"), out("f", "Prices start long after membership; the ticker may be recycled."))
        .when(F.col("after_prices"), out("f", "Membership goes on after prices end."))
        .when(F.col("price_first").isNull(), out("a", "No prices; membership may still be right."))
        .otherwise(out("a", span))
    )
    return rows.withColumn("_v", verdict).select(
        "symbol", "first_appearance", "last_appearance", F.coalesce("appearances", F.lit(0)).alias("appearances"), "source",
        "price_first", "price_last", F.col("_v.class").alias("class"), F.col("_v.label").alias("label"), F.col("_v.note").alias("note"),
    )


def audit_universe(memberships: DataFrame, windows: DataFrame, dates: DataFrame, flags: DataFrame) -> DataFrame:
    """One row of audit counts."""
    checks = validate_memberships(memberships).agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("intervals"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicates"),
        F.coalesce(F.sum(F.when(F.col("impossible"), F.col("copies"))), F.lit(0)).alias("invalid_intervals"),
        F.coalesce(F.sum("overlap_count"), F.lit(0)).alias("overlap_issues"),
    )
    sizes = (
        dates.select("as_of")
        .join(universe_as_of(memberships, dates).groupBy("as_of").agg(F.count(F.lit(1)).alias("n")), "as_of", "left")
        .fillna(0, ["n"])
        .agg(F.min("n").alias("smallest"), F.max("n").alias("largest"), F.count(F.lit(1)).alias("dates"))
    )
    counted = flags.agg(
        F.count(F.lit(1)).alias("symbols"),
        *[F.count_if(c).alias(f"{c}_symbols") for c in ("fixture", "late_price_start", "after_prices", "leaked", "suspicious")],
    )
    return side_by_side(checks, sizes, counted)
