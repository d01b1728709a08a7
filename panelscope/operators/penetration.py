"""Trial penetration: cumulative brand triers over cumulative category buyers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import period_col, period_label_col
from ..sources.panel import Panel


def first_purchases(p: Panel, floor: bool = True) -> DataFrame:
    """card, first_brand, first_cat in one shuffle; with `floor` from the launch on."""
    rows = p.df.filter(F.col("ts") >= F.lit(p.origin)) if floor else p.df
    found = rows.filter("is_brand OR is_cat").groupBy("card")
    return found.agg(F.min(F.when(F.col("is_brand"), F.col("ts"))).alias("first_brand"), F.min(F.when(F.col("is_cat"), F.col("ts"))).alias("first_cat"))


def entrants(p: Panel, unit: str = "iso_week") -> DataFrame:
    """period, n_brand_new, n_cat_new: cards by the period of their first purchase."""
    firsts = first_purchases(p)
    both = firsts.select(F.explode(F.array(F.struct(F.col("first_brand").alias("ts"), F.lit(1).alias("b"), F.lit(0).alias("c")), F.struct(F.col("first_cat").alias("ts"), F.lit(0).alias("b"), F.lit(1).alias("c")))).alias("e"))
    rows = both.filter("e.ts IS NOT NULL").select(period_col(F.col("e.ts"), p.origin, unit).alias("period"), "e.b", "e.c")
    return rows.filter("period >= 1").groupBy("period").agg(F.sum("b").alias("n_brand_new"), F.sum("c").alias("n_cat_new"))


def penetration(p: Panel, unit: str = "iso_week", denominator: str = "dynamic") -> DataFrame:
    """period, label, n_brand, n_cat, penetration on a gap-free axis that ends with
    the last period in which anyone enters and starts where category buyers do."""
    if denominator not in ("dynamic", "static"):
        raise ValueError("denominator must be dynamic or static")
    new = entrants(p, unit)
    spine = new.agg(F.max("period").alias("last")).filter("last >= 1").select(F.explode(F.sequence(F.lit(1).cast("long"), "last")).alias("period"))
    # At most a row per period of the calendar from here on, so one partition serves.
    run = Window.orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    full = spine.join(new, "period", "left").fillna(0)
    cum = full.select("period", F.sum("n_brand_new").over(run).alias("n_brand"), F.sum("n_cat_new").over(run).alias("n_cat"), F.sum("n_cat_new").over(Window.partitionBy()).alias("all_cat"))
    base = F.col("n_cat") if denominator == "dynamic" else F.col("all_cat")
    return cum.filter("n_cat > 0").select("period", period_label_col("period", p.origin, unit).alias("label"), "n_brand", "n_cat", (F.col("n_brand") / base).alias("penetration"))


def snapshot(p: Panel) -> DataFrame:
    """n_brand, n_cat and their ratio, the trial index."""
    c = first_purchases(p).agg(F.count("first_brand").alias("n_brand"), F.count("first_cat").alias("n_cat"))
    return c.withColumn("trial_index", F.try_divide("n_brand", "n_cat"))


def rollup_cumulative(series: DataFrame, label: str = "label", value: str = "penetration") -> DataFrame:
    """Last value within each label, labels in order of their first period."""
    return series.groupBy(label).agg(F.min("period").alias("first_period"), F.max_by(value, "period").alias(value))
