"""What charts of the results show, as frames; drawing them is left to the reader's tool."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import period_label_col
from . import fit

#: Longest and shortest projected tail in periods, about a year and a quarter.
TAIL = {"week": (50, 6), "iso_week": (50, 6), "fortnight": (25, 3), "iso_fortnight": (25, 3), "month": (12, 3), "fiscal_445": (12, 3)}
#: Periods for which the curve before a promotion goes on beside what was observed.
BESIDE = {"week": 3, "iso_week": 3, "fortnight": 2, "iso_fortnight": 2, "month": 1, "fiscal_445": 1}


def ticks(periods: DataFrame, most: int = 13) -> DataFrame:
    """Every n-th row of a table with a row per period, so that at most `most` are left."""
    n = F.count("*").over(Window.partitionBy())
    rows = periods.select("*", (F.row_number().over(Window.orderBy("period")) - 1).alias("_at"), F.ceil(n / most).alias("_step"))
    return rows.filter("_at % _step = 0").drop("_at", "_step")


def curve(series: DataFrame, origin: date, unit: str, **options) -> DataFrame:
    """t, label, p, p_projected, ultimate: what was observed, and from the last period on
    the fitted curve, until it is within a hundredth of its ceiling or the tail ends."""
    longest, shortest = TAIL[unit]
    ends = fit.fit(series, **options).select("a", "k").join(series.agg(F.max("t").alias("last")), F.lit(True))
    near = F.least(F.greatest(F.ceil(F.log(F.lit(100.0)) / F.col("a")), F.col("last")), F.col("last") + longest)
    until = F.when(F.col("k").isNull(), F.col("last")).otherwise(F.greatest(near, F.col("last") + shortest))
    axis = ends.filter("last >= 1").select("a", "k", "last", F.explode(F.sequence(F.lit(1).cast("long"), until.cast("long"))).alias("t"))
    shown = F.when(F.col("t") >= F.col("last"), fit.fitted(F.col("k"), F.col("a"), F.col("t")))
    return axis.join(series.select("t", "p"), "t", "left").select("t", period_label_col("t", origin, unit).alias("label"), "p", shown.alias("p_projected"), F.col("k").alias("ultimate"))


def promo(series: DataFrame, cutoff: int, **options) -> DataFrame:
    """t, p, baseline, refit: what was observed, the curve fitted up to the cutoff, and that of the whole series."""
    out = series.select("t", "p")
    for name, some in (("baseline", series.filter(F.col("t") <= cutoff)), ("refit", series)):
        own = F.broadcast(fit.fit(some, **options).select("a", "k"))
        out = out.join(own, F.lit(True)).withColumn(name, fit.fitted(F.col("k"), F.col("a"), F.col("t"))).drop("a", "k")
    return out


def bought(series: DataFrame, promos: list[int], unit: str, **options) -> DataFrame:
    """promo, t, p, baseline, gap: for some periods from each promotion on, the segment
    before it goes on beside what was observed. Unfitted segments show nothing."""
    parts = fit.segments(series, promos, **options).filter("a IS NOT NULL")
    before = [F.struct(F.lit(t0).cast("long").alias("t0"), F.lit(p).cast("long").alias("promo")) for t0, p in zip([0, *promos], promos)]
    if not before:
        raise ValueError("no promotion to show")
    own = parts.join(F.broadcast(series.sparkSession.range(1).select(F.explode(F.array(*before)).alias("e")).select("e.*")), "t0")
    base = F.col("base") + fit.fitted(F.col("k_inc"), F.col("a"), F.col("t") - F.col("t0"))
    last = series.agg(F.max("t").alias("last"))
    rows = series.select("t", "p").join(F.broadcast(own), (F.col("t") >= F.col("promo")) & (F.col("t") <= F.col("promo") + BESIDE[unit])).join(F.broadcast(last), F.lit(True)).filter("last > promo")
    return rows.select("promo", "t", "p", base.alias("baseline"), (F.col("p") - base).alias("gap"))


def increments(series: DataFrame, **options) -> DataFrame:
    """t, p, dp, line: the points that the fit sees and the line a (k - p) through them."""
    own = F.broadcast(fit.fit(series, **options).select("a", "k"))
    smoothing = options.get("smoothing")
    return fit.differences(fit.smoothed(series, smoothing) if smoothing else series).join(own, F.lit(True)).select("t", "p", "dp", (F.col("a") * (F.col("k") - F.col("p"))).alias("line"))


def lines(series: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """series, x, y: any named columns of any frames, one below the other; points without y are left out."""
    out = None
    for name, (df, x, y) in series.items():
        own = df.filter(F.col(y).isNotNull()).select(F.lit(name).alias("series"), F.col(x).cast("long").alias("x"), F.col(y).cast("double").alias("y"))
        out = own if out is None else out.unionByName(own)
    if out is None:
        raise ValueError("no series to show")
    return out
