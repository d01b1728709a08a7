"""The operators as named queries over the order tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import UNITS, bucket_start_col, date_dimension, dense_ordinal
from ..operators import buying, charts, fit, penetration, rbr, share
from ..sources.panel import Panel, collapse, events_panel, orders_panel
from .oracle import ANALYSIS, CUTOFF, ORIGIN, PROMOS

WINDOW_DAYS = 365
Query = Callable[[Panel], DataFrame]


def _series(p: Panel, unit: str = "month") -> DataFrame:
    return penetration.penetration(p, unit).select(F.col("period").alias("t"), F.col("penetration").alias("p"))


def _year(series: DataFrame) -> DataFrame:
    return series.withColumn("year", F.substring("label", 1, 4))


def _pairs(s: DataFrame) -> DataFrame:
    curve = F.broadcast(fit.fit(s).select("a", "k"))
    return s.join(curve, F.lit(True)).select("t", F.col("p").alias("actual"), fit.fitted(F.col("k"), F.col("a"), F.col("t")).alias("forecast"))


def _dates(p: Panel) -> DataFrame:
    return p.df.agg(F.max("ts").alias("last_day"), F.min(F.when(F.col("is_brand"), F.col("ts"))).alias("first_brand_day"), F.countDistinct(F.when(F.col("is_cat"), F.col("card"))).alias("n_cat_buyers"))


def _total(p: Panel) -> DataFrame:
    t = share.with_total(share.cohort_table(p, WINDOW_DAYS)).filter("cohort = 'TOTAL'")
    return t.select(F.col("contribution").alias("segmented_share"), F.col("rbr").alias("blended_rbr"))


def _dashboard(p: Panel) -> DataFrame:
    return charts.lines({"penetration": (_series(p), "t", "p"), "rbr": (rbr.rates(p), "interval", "rbr"), "share": (share.share(p), "period", "share")})


QUERIES: dict[str, Query] = {f"penetration_{u}": (lambda p, u=u: penetration.penetration(p, u)) for u in UNITS} | {
    "penetration_static": lambda p: penetration.penetration(p, "month", "static"),
    "entrants": lambda p: penetration.entrants(p, "month"),
    "first_purchases": penetration.first_purchases,
    "snapshot": penetration.snapshot,
    "panel_dates": _dates,
    "collapsed_log": lambda p: collapse(p.df).agg(F.count("*").alias("n_rows"), F.sum("qty").alias("qty")),
    "date_dimension": lambda p: date_dimension(p.df.sparkSession, p.origin, p.analysis),
    "share_by_period": share.share,
    "share_rollup": lambda p: share.rollup_ratio(_year(share.share(p)), "year"),
    "cumulative_rollup": lambda p: penetration.rollup_cumulative(_year(penetration.penetration(p, "month")), "year"),
    "trial_cohorts": lambda p: rbr.trials(p).groupBy("cohort").agg(F.count("*").alias("n_triers")),
    "trier_counts_by_entry_week": lambda p: rbr.trials(p).groupBy("entry_week", "cohort").agg(F.count("*").alias("n")),
    "cohort_penetration": share.cohort_penetration,
    "rbr_exact": rbr.rates,
    "rbr_capped": lambda p: rbr.rates(p, 12),
    "rbr_bucket_partial": lambda p: rbr.rates(p, mode="bucket", partial=True),
    "rbr_bucket_complete": lambda p: rbr.rates(p, mode="bucket"),
    "rbr_eligibility": rbr.eligibility,
    "rbr_cohort_weeks": rbr.rates_by_cohort,
    "rbr_cohort_bands": lambda p: rbr.rates_by_cohort(p, ["1995-W26", "1996-01-15", "1996-12"], bands=True),
    "rbr_plateau": lambda p: rbr.plateau(rbr.rates(p), 0.02),
    "rbr_furthest": lambda p: rbr.furthest(rbr.rates(p)),
    "rbr_stable_mean": lambda p: rbr.stable_mean(rbr.rates(p), 10),
    "buying_windowed": lambda p: buying.windowed(p, WINDOW_DAYS),
    "buying_growing": lambda p: buying.growing(p, unit="month"),
    "buying_fixed_panel": lambda p: buying.fixed_panel(p, "month"),
    "buying_scopes": lambda p: buying.scopes(p, WINDOW_DAYS),
    "buying_cohorts": lambda p: buying.by_entry_bucket(p, WINDOW_DAYS),
    "buying_unfloored": buying.unfloored,
    "penetration_smoothed": lambda p: fit.smoothed(_series(p), 5),
    "penetration_differences": lambda p: fit.differences(_series(p)),
    "fit_discounted": lambda p: fit.fit(_series(p)).drop("note"),
    "fit_ols": lambda p: fit.fit(_series(p), method="ols").drop("note"),
    "fit_smoothed": lambda p: fit.fit(_series(p), smoothing=5).drop("note"),
    "fit_projection": lambda p: fit.projection(_series(p), 96),
    "stability": lambda p: fit.stability(_series(p)).drop("note"),
    "stability_spread": lambda p: fit.stability_spread(fit.stability(_series(p))),
    "piecewise_fit": lambda p: fit.segments(_series(p), list(PROMOS)).drop("note"),
    "piecewise_evaluate": lambda p: fit.evaluate(_series(p), fit.segments(_series(p), list(PROMOS))),
    "piecewise_ultimate": lambda p: fit.ultimate(fit.segments(_series(p), list(PROMOS))).select("k", "a", "n_segments_fitted"),
    "piecewise_stability": lambda p: fit.stability_segments(_series(p), list(PROMOS)),
    "pwsd": lambda p: fit.pwsd(_pairs(_series(p))),
    "validation": lambda p: fit.validate(_series(p), CUTOFF),
    "promo_bought": lambda p: fit.promo_bought(_series(p), CUTOFF),
    "cohort_table": lambda p: share.cohort_table(p, WINDOW_DAYS),
    "segmented_share": _total,
    "predictions": lambda p: share.predictions(p, WINDOW_DAYS),
    "predictions_stable": lambda p: share.predictions(p, WINDOW_DAYS, stable_from=10),
    "stability_notes": lambda p: fit.stability(_series(p), 1).select("cutoff", "n_points", "note"),
    "month_ordinals": lambda p: dense_ordinal(p.df.withColumn("label", F.date_format("ts", "yyyy-MM"))),
    "fiscal_starts": lambda p: penetration.penetration(p, "fiscal_445").select("period", bucket_start_col(F.col("period"), p.origin, "fiscal_445").alias("first_day")),
    "chart_penetration": lambda p: charts.curve(_series(p), p.origin, "month"),
    "chart_promo": lambda p: charts.promo(_series(p), CUTOFF),
    "chart_bought": lambda p: charts.bought(_series(p), list(PROMOS), "month"),
    "chart_increments": lambda p: charts.increments(_series(p)),
    "chart_ticks": lambda p: charts.ticks(penetration.penetration(p, "month").select("period", "label")),
    "chart_dashboard": _dashboard,
    "share_by_interval": lambda p: share.share_by_interval(p, WINDOW_DAYS),
}
#: Columns that are exact although they are doubles.
EXACT = {"qty", "brand_qty", "cat_qty", "cat_qty_triers", "cat_qty_repeaters", "sum_cat", "sel_sum", "all_sum"}


def _rounded(df: DataFrame, exact: set[str] = EXACT) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" and c not in exact else F.col(c) for c, t in df.dtypes])


def on_orders(query: Query) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _rounded(query(orders_panel(spark, sf_dir, date.fromisoformat(ORIGIN), date.fromisoformat(ANALYSIS))))


def on_events(query: Query) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _rounded(query(events_panel(spark, sf_dir)), set())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: on_orders(q) for name, q in QUERIES.items()} | {f"events_{name}": on_events(QUERIES[name]) for name in ("penetration_iso_week", "share_by_period")}
