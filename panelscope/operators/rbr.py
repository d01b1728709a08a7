"""Repeat-buying rate on each card's own clock, from its trial on."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import boundary_end, bucket_index, index_col, period_col
from ..sources.panel import Panel

WEEKS = (6, 12, 24)


def cohort_labels(boundaries: tuple[int, ...] = WEEKS, prelaunch: bool = False) -> list[str]:
    first = [1, *(b + 1 for b in boundaries)]
    return (["pre-launch"] if prelaunch else []) + [f"{a}-{b}w" for a, b in zip(first, boundaries)] + [f"{first[-1]}+w"]


def launch_cohort(week: Column, boundaries: tuple[int, ...] = WEEKS, prelaunch: bool = False) -> Column:
    """Cohort by entry week. Weeks before the first fall in the first band, or in
    their own with `prelaunch`."""
    names = cohort_labels(boundaries)
    out = F.when(week <= 0, "pre-launch") if prelaunch else F
    for b, name in zip(boundaries, names):
        out = out.when(week <= b, name)
    return out.otherwise(names[-1])


def band_cohort(ts: Column, boundaries: list, p: Panel) -> Column:
    """Number of the inclusive band that a date falls in; boundaries are dates or labels."""
    ends = [boundary_end(b) for b in boundaries]
    if sorted(set(ends)) != ends:
        raise ValueError("boundaries must be strictly increasing")
    if any(not p.origin < e < p.analysis for e in ends):
        raise ValueError("boundaries must lie between launch and analysis date")
    out = F
    for i, e in enumerate(ends):
        out = out.when(ts <= F.lit(e), i)
    return out.otherwise(len(ends))


def trials(p: Panel, floor: bool = True, boundaries: tuple[int, ...] = WEEKS, prelaunch: bool = False) -> DataFrame:
    """card, trial_ts, entry_week, cohort: the first brand purchase of each card."""
    rows = p.df.filter("is_brand")
    if floor and not prelaunch:
        rows = rows.filter(F.col("ts") >= F.lit(p.origin))
    t = rows.groupBy("card").agg(F.min("ts").alias("trial_ts"))
    week = (F.floor(F.datediff("trial_ts", F.lit(p.origin)) / 7) + 1).cast("long")
    return t.select("card", "trial_ts", week.alias("entry_week"), launch_cohort(week, boundaries, prelaunch).alias("cohort"))


def _interval(ts: Column, trial: Column, mode: str, days: int, unit: str, origin: date) -> Column:
    if mode == "exact":
        return F.ceil(F.datediff(ts, trial) / days)
    return index_col(ts, unit, origin) - index_col(trial, unit, origin)


def _last(trial: Column, p: Panel, mode: str, days: int, unit: str, partial: bool) -> Column:
    """Last interval of a card that lies within the data; with `partial` an unfinished
    bucket counts, otherwise it may be -1."""
    if mode == "exact":
        return F.floor(F.datediff(F.lit(p.analysis), trial) / days)
    end = bucket_index(p.analysis, unit, p.origin) if partial else bucket_index(p.analysis + timedelta(days=1), unit, p.origin) - 1
    return F.lit(end).cast("long") - index_col(trial, unit, p.origin)


def trial_lines(p: Panel, mode: str = "exact", days: int = 28, unit: str = "iso_week", partial: bool = False, floor: bool = True) -> DataFrame:
    """The log with each trier's trial date, interval and last interval, by one window
    over cards."""
    brand = F.col("is_brand") & (F.col("ts") >= F.lit(p.origin)) if floor else F.col("is_brand")
    rows = p.df.withColumn("trial_ts", F.min(F.when(brand, F.col("ts"))).over(Window.partitionBy("card"))).filter("trial_ts IS NOT NULL")
    return rows.withColumns({"interval": _interval(F.col("ts"), F.col("trial_ts"), mode, days, unit, p.origin).cast("long"), "last_interval": _last(F.col("trial_ts"), p, mode, days, unit, partial).cast("long")})


def eligibility(p: Panel, cap: int | None = None, mode: str = "exact", days: int = 28, unit: str = "iso_week", partial: bool = False, floor: bool = True) -> DataFrame:
    """interval, n_eligible: cards whose data reach an interval, on a gap-free axis.
    Only trial dates are shuffled, one row per card and map task, never the log."""
    cards = trials(p, floor).select(_last(F.col("trial_ts"), p, mode, days, unit, partial).cast("long").alias("last_interval"))
    spread = cards.groupBy("last_interval").agg(F.count("*").alias("n"))
    spine = spread.agg(F.max("last_interval").alias("m")).filter("m >= 1").select(F.explode(F.sequence(F.lit(1).cast("long"), "m")).alias("interval"))
    joined = spine.join(spread, F.col("interval") == F.col("last_interval"), "left")
    down = Window.orderBy(F.desc("interval")).rowsBetween(Window.unboundedPreceding, 0)
    out = joined.select("interval", F.sum(F.coalesce("n", F.lit(0))).over(down).alias("n_eligible"))
    return out.filter(F.col("interval") <= cap) if cap else out


def rates(p: Panel, cap: int | None = None, **clock) -> DataFrame:
    """interval, brand_qty, cat_qty, rbr, n_eligible. The trial day never counts; an
    interval without category volume has no rate."""
    seen = _repeats(p, cap, **clock).groupBy("interval").agg(F.sum("bq").alias("brand_qty"), F.sum("cq").alias("cat_qty"))
    full = eligibility(p, cap, **clock).join(seen, "interval", "left").fillna(0.0, ["brand_qty", "cat_qty"])
    return full.select("interval", "brand_qty", "cat_qty", F.try_divide("brand_qty", "cat_qty").alias("rbr"), "n_eligible")


def _repeats(p: Panel, cap: int | None = None, **clock) -> DataFrame:
    rows = trial_lines(p, **clock).filter("ts > trial_ts AND interval BETWEEN 1 AND last_interval")
    rows = rows.filter(F.col("interval") <= cap) if cap else rows
    return rows.select("card", "trial_ts", "interval", F.when(F.col("is_brand"), F.col("qty")).otherwise(0.0).alias("bq"), F.when(F.col("is_cat"), F.col("qty")).otherwise(0.0).alias("cq"))


def rates_by_cohort(p: Panel, boundaries: list | tuple[int, ...] = WEEKS, bands: bool = False, cap: int | None = None, **clock) -> DataFrame:
    """cohort, interval, brand_qty, cat_qty, rbr: by entry week, or by dated bands."""
    week = F.floor(F.datediff("trial_ts", F.lit(p.origin)) / 7) + 1
    cohort = band_cohort(F.col("trial_ts"), list(boundaries), p) if bands else launch_cohort(week, tuple(boundaries))
    g = _repeats(p, cap, **clock).groupBy(cohort.alias("cohort"), "interval").agg(F.sum("bq").alias("brand_qty"), F.sum("cq").alias("cat_qty"))
    return g.withColumn("rbr", F.try_divide("brand_qty", "cat_qty"))


def furthest(rbr: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return rbr.filter("rbr IS NOT NULL").groupBy(*keys).agg(F.max("interval").alias("interval"), F.max_by("rbr", "interval").alias("rbr"))


def stable_mean(rbr: DataFrame, start: int, keys: tuple[str, ...] = ()) -> DataFrame:
    return rbr.filter(F.col("interval") >= start).groupBy(*keys).agg(F.avg("rbr").alias("rbr"))


def plateau(rbr: DataFrame, tolerance: float = 0.005, run: int = 3) -> DataFrame:
    """First interval from which `run` observed rates differ by at most `tolerance`."""
    w = Window.orderBy("interval").rowsBetween(0, run - 1)
    seen = rbr.filter("rbr IS NOT NULL").select("interval", "rbr", F.max("rbr").over(w).alias("hi"), F.min("rbr").over(w).alias("lo"), F.count("rbr").over(w).alias("n"))
    ok = seen.filter((F.col("n") == run) & (F.col("hi") - F.col("lo") <= tolerance))
    return ok.agg(F.min("interval").alias("interval"), F.min_by("rbr", "interval").alias("rbr")).filter("interval IS NOT NULL")
