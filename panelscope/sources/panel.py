"""The purchase log: one row per purchase line, in five roles."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Panel:
    """`df` has card, ts, is_brand, is_cat, qty; rows after `analysis` are gone.
    `origin` is the launch date and the start of every calendar axis."""

    df: DataFrame
    origin: date
    analysis: date


def purchase_lines(df: DataFrame, card: str = "shopper_id", ts: str = "txn_date", brand: str = "is_new_product", category: str = "is_category", qty: str = "volume", brand_is_category: bool = True) -> DataFrame:
    """Cast the roles of any log. Rows with a null card are left out, as no metric
    can assign them; a null flag isn't true; malformed values raise."""
    is_brand = F.col(brand).cast("boolean")
    is_cat = (F.col(category).cast("boolean") | is_brand) if brand_is_category else F.col(category).cast("boolean")
    lines = df.select(F.col(card).cast("string").alias("card"), F.to_date(F.col(ts)).alias("ts"), is_brand.alias("is_brand"), is_cat.alias("is_cat"), F.col(qty).cast("double").alias("qty"))
    return lines.filter("card IS NOT NULL")


def panel(lines: DataFrame, origin: date | None = None, analysis: date | None = None) -> Panel:
    """Clip at the analysis date (by default the last day) and find the launch (by
    default the first brand purchase). Give both as literals to reach the scan."""
    if origin is None or analysis is None:
        found = lines.agg(F.max("ts").alias("last"), F.min(F.when(F.col("is_brand"), F.col("ts"))).alias("first")).first()
        origin, analysis = origin or found["first"], analysis or found["last"]
        if analysis is None or origin is None:
            raise ValueError("no purchase with a date, or none of the brand")
    return Panel(lines.filter(F.col("ts") <= F.lit(analysis)), origin, analysis)


def collapse(lines: DataFrame) -> DataFrame:
    """Lines summed to one row per card, day and flags."""
    return lines.groupBy("card", "ts", "is_brand", "is_cat").agg(F.sum("qty").alias("qty"))


def orders_panel(spark: SparkSession, sf_dir: str, origin: date, analysis: date) -> Panel:
    """The order tables as a purchase log: card is the customer, the brand is
    Brand#4, the category is ECONOMY."""
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("lineitem", "orders", "part")}
    joined = t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey")).join(t["part"], F.col("l_partkey") == F.col("p_partkey"))
    log = joined.select("o_custkey", "o_orderdate", (F.col("p_brand") == "Brand#4").alias("brand"), (F.col("p_type") == "ECONOMY").alias("cat"), "l_quantity")
    return panel(purchase_lines(log, "o_custkey", "o_orderdate", "brand", "cat", "l_quantity"), origin, analysis)


def events_panel(spark: SparkSession, sf_dir: str, origin: date | None = None, analysis: date | None = None) -> Panel:
    """The event table as a short log of 30 days."""
    log = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", (F.col("event_type") == "purchase").alias("brand"), F.col("event_type").isin("purchase", "click", "view").alias("cat"), "value")
    return panel(purchase_lines(log, "user_id", "ts", "brand", "cat", "value"), origin, analysis)
