"""Buying index: volume per head of the brand's buyers against all category buyers."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import period_col, period_label_col, period_of
from ..sources.panel import Panel, collapse
from .rbr import WEEKS, cohort_labels, launch_cohort

#: `lines`: at least k brand lines since launch; `brand_days_unfloored`: at least k
#: collapsed rows, of any date; `lines_unfloored`: at least k lines, of any date.
REPEATER_RULES = ("lines", "brand_days_unfloored", "lines_unfloored")


def members(p: Panel, k: int = 2, unit: str = "iso_week") -> DataFrame:
    """card, trial_ts, trial_p, cat_p, rep_p: periods in which a card becomes a trier,
    category buyer and repeater (its k-th brand line). Of a card's brand lines only
    the first k leave a map task, however many it has."""
    rows = p.df.filter(F.col("ts") >= F.lit(p.origin)).filter("is_brand OR is_cat")
    nth = F.row_number().over(Window.partitionBy("card").orderBy("ts"))
    rep = rows.filter("is_brand").select("card", "ts", nth.alias("nth")).filter(F.col("nth") <= k).filter(F.col("nth") == k).select("card", F.col("ts").alias("rep_ts"))
    m = rows.groupBy("card").agg(F.min(F.when(F.col("is_brand"), F.col("ts"))).alias("trial_ts"), F.min(F.when(F.col("is_cat"), F.col("ts"))).alias("cat_ts")).join(rep, "card", "left")
    return m.select("card", "trial_ts", *[period_col(f"{x}_ts", p.origin, unit).alias(f"{x}_p") for x in ("trial", "cat", "rep")])


def category_lines(p: Panel) -> DataFrame:
    return p.df.filter(F.col("is_cat") & (F.col("ts") >= F.lit(p.origin)))


def _within(rows: DataFrame, p: Panel, window_days: int | None) -> DataFrame:
    """The last `window_days` days, the analysis date included."""
    return rows if window_days is None else rows.filter(F.col("ts") > F.lit(p.analysis - timedelta(days=window_days)))


def windowed(p: Panel, window_days: int | None, k: int = 2, unit: str = "iso_week") -> DataFrame:
    """One row: volumes in the window, all-time bases, b_triers, b_repeaters."""
    m = members(p, k, unit)
    n = m.agg(F.count("cat_p").alias("n_buyers"), F.count("trial_p").alias("n_triers"), F.count("rep_p").alias("n_repeaters"))
    v = _within(category_lines(p), p, window_days).join(m, "card", "left").agg(F.coalesce(F.sum("qty"), F.lit(0.0)).alias("cat_qty"), F.coalesce(F.sum(F.when(F.col("trial_p").isNotNull(), F.col("qty"))), F.lit(0.0)).alias("cat_qty_triers"), F.coalesce(F.sum(F.when(F.col("rep_p").isNotNull(), F.col("qty"))), F.lit(0.0)).alias("cat_qty_repeaters"))
    whole = F.try_divide("cat_qty", "n_buyers")
    return n.join(v, F.lit(True)).select("*", F.try_divide(F.try_divide("cat_qty_triers", "n_triers"), whole).alias("b_triers"), F.try_divide(F.try_divide("cat_qty_repeaters", "n_repeaters"), whole).alias("b_repeaters"))


def growing(p: Panel, k: int = 2, unit: str = "iso_week") -> DataFrame:
    """period, label, volumes, bases at the end of each period, b_triers, b_repeaters
    and whether the bucket is cut short by the analysis date."""
    m = members(p, k, unit)
    last = period_of(p.analysis, p.origin, unit)
    spine = p.df.sparkSession.range(1, last + 1).select(F.col("id").alias("period"))
    new = m.select(F.explode(F.array(*[F.struct(F.lit(x).alias("kind"), F.col(f"{x}_p").alias("period")) for x in ("trial", "cat", "rep")])).alias("e")).filter("e.period IS NOT NULL")
    new = new.groupBy("e.period").agg(*[F.sum(F.when(F.col("e.kind") == x, 1).otherwise(0)).alias(x) for x in ("trial", "cat", "rep")])
    lines = category_lines(p).withColumn("period", period_col("ts", p.origin, unit)).join(m, "card", "left")
    v = lines.groupBy("period").agg(F.sum("qty").alias("cat_qty"), F.sum(F.when(F.col("trial_p") <= F.col("period"), F.col("qty"))).alias("cat_qty_triers"), F.sum(F.when(F.col("rep_p") <= F.col("period"), F.col("qty"))).alias("cat_qty_repeaters"))
    run = Window.orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    full = spine.join(new, "period", "left").join(v, "period", "left").fillna(0).select("period", "cat_qty", "cat_qty_triers", "cat_qty_repeaters", F.sum("cat").over(run).alias("n_buyers"), F.sum("trial").over(run).alias("n_triers"), F.sum("rep").over(run).alias("n_repeaters"))
    whole = F.try_divide("cat_qty", "n_buyers")
    partial = (F.col("period") == last) & F.lit(period_of(p.analysis + timedelta(days=1), p.origin, unit) == last)
    return full.select(period_label_col("period", p.origin, unit).alias("label"), "*", F.try_divide(F.try_divide("cat_qty_triers", "n_triers"), whole).alias("b_triers"), F.try_divide(F.try_divide("cat_qty_repeaters", "n_repeaters"), whole).alias("b_repeaters"), partial.alias("partial"))


def fixed_panel(p: Panel, unit: str = "iso_week", floor: bool = True) -> DataFrame:
    """period, sel_sum, sel_n, all_sum, all_n, b: the trier base is constant and a
    trier's earlier volume counts."""
    rows = p.df.withColumn("trier", F.max(F.when(F.col("is_brand") & (F.col("ts") >= F.lit(p.origin) if floor else F.lit(True)), 1)).over(Window.partitionBy("card")))
    cat = rows.filter(F.col("is_cat") & (F.col("ts") >= F.lit(p.origin)))
    v = cat.groupBy(period_col("ts", p.origin, unit).alias("period")).agg(F.coalesce(F.sum(F.when(F.col("trier") == 1, F.col("qty"))), F.lit(0.0)).alias("sel_sum"), F.sum("qty").alias("all_sum"))
    since = F.col("ts") >= F.lit(p.origin)
    trier = F.col("is_brand") & (since if floor else F.lit(True))
    n = p.df.agg(F.countDistinct(F.when(trier, F.col("card"))).alias("sel_n"), F.countDistinct(F.when(F.col("is_cat") & since, F.col("card"))).alias("all_n"))
    return v.join(F.broadcast(n), F.lit(True)).select("period", "sel_sum", "sel_n", "all_sum", "all_n", F.try_divide(F.try_divide("sel_sum", "sel_n"), F.try_divide("all_sum", "all_n")).alias("b"))


def scopes(p: Panel, window_days: int | None = None, k: int = 2, rule: str = "brand_days_unfloored", boundaries: tuple[int, ...] = WEEKS, floor: bool = True) -> DataFrame:
    """scope, sum_cat, n_buyers, b: all buyers, triers, repeaters and entry cohorts, from
    one aggregate over cards. Cohorts without members are left out."""
    if rule not in REPEATER_RULES:
        raise ValueError(f"rule must be one of {REPEATER_RULES}")
    lines = collapse(p.df) if rule.startswith("brand_days") else p.df
    since = F.col("ts") >= F.lit(p.origin)
    vol = F.col("is_cat") & since
    if window_days is not None:
        vol = vol & (F.col("ts") > F.lit(p.analysis - timedelta(days=window_days)))
    counted = F.col("is_brand") & (since if rule == "lines" else F.lit(True))
    cards = lines.groupBy("card").agg(F.sum(F.when(vol, F.col("qty"))).alias("v"), F.min(F.when(F.col("is_brand") & (since if floor else F.lit(True)), F.col("ts"))).alias("trial"), F.max(F.when(F.col("is_cat") & since, 1).otherwise(0)).alias("buyer"), (F.count(F.when(counted, 1)) >= k).alias("rep"))
    week = F.floor(F.datediff("trial", F.lit(p.origin)) / 7) + 1
    cohort = F.when(F.col("trial").isNotNull(), launch_cohort(week, boundaries))
    flags = F.array(F.struct(F.lit("__all__").alias("scope"), (F.col("buyer") == 1).alias("own")), F.struct(F.lit("__triers__").alias("scope"), F.col("trial").isNotNull().alias("own")), F.struct(F.lit("__repeaters__").alias("scope"), F.col("rep").alias("own")), F.struct(cohort.alias("scope"), F.lit(True).alias("own")))
    each = cards.select("v", F.explode(flags).alias("f")).filter("f.scope IS NOT NULL AND f.own")
    sums = each.groupBy("f.scope").agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("sum_cat"), F.count("*").alias("n_buyers"))
    whole = F.broadcast(sums.filter("scope = '__all__'").select(F.try_divide("sum_cat", "n_buyers").alias("whole")))
    return sums.join(whole, F.lit(True)).select("scope", "sum_cat", "n_buyers", F.try_divide(F.try_divide("sum_cat", "n_buyers"), F.col("whole")).alias("b"))


def by_entry_bucket(p: Panel, window_days: int | None, unit: str = "month") -> DataFrame:
    """period, cohort, n_triers, cat_qty, b: cohorts by the bucket of the trial."""
    m = members(p, 2, unit)
    v = _within(category_lines(p), p, window_days).groupBy("card").agg(F.sum("qty").alias("v"))
    both = m.join(v, "card", "left")
    whole = F.broadcast(both.agg(F.try_divide(F.sum("v"), F.count("cat_p")).alias("whole")))
    g = both.filter("trial_p IS NOT NULL").groupBy(F.col("trial_p").alias("period")).agg(F.count("*").alias("n_triers"), F.coalesce(F.sum("v"), F.lit(0.0)).alias("cat_qty"))
    return g.join(whole, F.lit(True)).select("period", period_label_col("period", p.origin, unit).alias("cohort"), "n_triers", "cat_qty", F.try_divide(F.try_divide("cat_qty", "n_triers"), F.col("whole")).alias("b"))


def unfloored(p: Panel, k: int = 2, base: str = "repeaters") -> DataFrame:
    """One row, no launch floor: average category volume of the chosen buyers over
    that of all, among cards that have any."""
    least = k if base == "repeaters" else 1
    cards = p.df.groupBy("card").agg(F.sum(F.when(F.col("is_cat"), F.col("qty"))).alias("v"), F.count(F.when(F.col("is_brand"), 1)).alias("n"))
    return cards.agg(F.avg(F.when(F.col("n") >= least, F.col("v"))).alias("avg_selected"), F.avg("v").alias("avg_all")).withColumn("b", F.try_divide("avg_selected", "avg_all"))
