"""Purchase logs with planted truth, made by Spark expressions; the default columns of `purchase_lines`."""

from __future__ import annotations

from datetime import date
from math import exp

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _line(card: Column, days: Column, launch: date, brand: Column, qty: Column) -> Column:
    ts = F.date_add(F.lit(launch), days.cast("int"))
    return F.struct(card.alias("shopper_id"), ts.alias("txn_date"), brand.alias("is_new_product"), F.lit(True).alias("is_category"), qty.cast("double").alias("volume"))


def planted_rate(t: int, week: int = 1, r0: float = 0.8, r_inf: float = 0.3, decay: float = 0.5, cohort_effect: float = 0.0) -> float:
    """Repeat-buying rate that `repeat_panel` plants at interval t for those who tried in a week."""
    return max(0.0, min(1.0, r_inf + (r0 - r_inf) * exp(decay * (1 - t)) - cohort_effect * (week - 1)))


def repeat_panel(spark: SparkSession, cards: int = 300, trial_weeks: int = 6, weeks: int = 26, r0: float = 0.8, r_inf: float = 0.3, decay: float = 0.5, cohort_effect: float = 0.0, launch: date = date(2024, 1, 1)) -> DataFrame:
    """Each card tries in one of the first weeks; midway through every later interval of
    seven days it buys one unit of the category, of it the planted rate of the brand."""
    start = F.col("id") % trial_weeks * 7
    tried = spark.range(cards).select(F.concat(F.lit("h"), "id").alias("card"), start.alias("start"), F.explode(F.sequence(F.lit(0), F.lit(weeks))).alias("t"))
    rate = F.greatest(F.lit(0.0), F.least(F.lit(1.0), r_inf + (r0 - r_inf) * F.exp(decay * (1 - F.col("t"))) - cohort_effect * F.col("start") / 7))
    day = F.col("start") + 7 * F.col("t") - 3
    first = F.array(_line(F.col("card"), F.col("start"), launch, F.lit(True), F.lit(1.0)))
    later = F.array(_line(F.col("card"), day, launch, F.lit(True), rate), _line(F.col("card"), day, launch, F.lit(False), 1 - rate))
    rows = tried.filter((F.col("t") == 0) | (day <= weeks * 7))
    return rows.select(F.explode(F.when(F.col("t") == 0, first).otherwise(later)).alias("line")).select("line.*")


def _kinds(cards: int, triers: float, repeaters: float) -> tuple[int, int]:
    n = round(cards * triers)
    return n, round(n * repeaters)


def planted_index(cards: int = 200, triers: float = 0.3, repeaters: float = 0.5, trier_qty: float = 1.5, repeater_qty: float = 2.5) -> tuple[float, float]:
    """Buying indices of triers and of repeaters that `heavy_panel` plants."""
    n, again = _kinds(cards, triers, repeaters)
    heavy = (n - again) * trier_qty + again * repeater_qty
    mean = (cards - n + heavy) / cards
    return heavy / n / mean, repeater_qty / mean


def heavy_panel(spark: SparkSession, cards: int = 200, triers: float = 0.3, repeaters: float = 0.5, trier_qty: float = 1.5, repeater_qty: float = 2.5, trial_weeks: int = 1, weeks: int = 12, launch: date = date(2024, 1, 1)) -> DataFrame:
    """Every card buys weekly: one unit, or its kind's quantity from its trial on. The
    trial, and a repeater's next week, hold half a unit of the brand."""
    if min(trier_qty, repeater_qty) < 0.5:
        raise ValueError("triers and repeaters must buy at least half a unit")
    if not 1 <= trial_weeks < weeks:
        raise ValueError("trial weeks must end before the last week")
    n, again = _kinds(cards, triers, repeaters)
    card, week = F.col("id"), F.col("week")
    since = week - (card % trial_weeks + 1)
    qty = F.when((card >= n) | (since < 0), 1.0).otherwise(F.when(card < again, repeater_qty).otherwise(trier_qty))
    buys = (card < n) & ((since == 0) | ((since == 1) & (card < again)))
    name, day = F.concat(F.lit("h"), card), (week - 1) * 7 + 2
    parts = F.array(_line(name, day, launch, F.lit(True), F.lit(0.5)), _line(name, day, launch, F.lit(False), qty - 0.5))
    rows = spark.range(cards).withColumn("week", F.explode(F.sequence(F.lit(1), F.lit(weeks))))
    return rows.select(F.explode(F.when(buys, parts).otherwise(F.array(_line(name, day, launch, F.lit(False), qty)))).alias("line")).select("line.*")


def launch_panel(spark: SparkSession, cards: int = 4000, weeks: int = 40, k: float = 0.34, a: float = 0.18, rate_first: float = 0.45, rate_stable: float = 0.25, decay: float = 0.6, every: int = 2, entry_weeks: int | None = None, promo_week: int | None = None, promo_k: float = 0.0, promo_rate: float = 0.06, launch: date = date(2024, 1, 1), seed: int = 0) -> DataFrame:
    """Every card buys the category each `every` weeks. Cards try the brand so that
    penetration follows k (1 - exp(-a week)), held after `entry_weeks`, and a promotion
    adds to it; later occasions are the brand's with a rate that decays to a stable
    one. Chance is a hash of seed, card and week."""
    grid = range(1, weeks + 1, every)
    reached = [round(cards * k * (1 - exp(-a * min(w, max([x for x in grid if x <= (entry_weeks or weeks)], default=w))))) for w in grid]
    if promo_week is not None:
        reached = [n + (round(cards * promo_k * (1 - exp(-0.5 * (w - promo_week + 1)))) if w >= promo_week else 0) for n, w in zip(reached, grid)]
    turn = F.size(F.filter(F.array(*[F.lit(min(n, cards)) for n in reached]), lambda n: n <= F.col("id")))
    rows = spark.range(cards).withColumn("trial", turn * every + 1).withColumn("week", F.explode(F.sequence(F.lit(1), F.lit(weeks), F.lit(every))))
    stable = F.lit(rate_stable) if promo_week is None else F.when(F.col("trial") >= promo_week, promo_rate).otherwise(rate_stable)
    rate = stable + (rate_first - stable) * F.exp(-decay * (F.col("week") - F.col("trial")) / every)
    chance = F.pmod(F.xxhash64(F.lit(seed), "id", "week"), F.lit(1 << 30)) / float(1 << 30)
    brand = (F.col("week") == F.col("trial")) | ((F.col("week") > F.col("trial")) & (chance < rate))
    return rows.select(_line(F.concat(F.lit("h"), F.col("id")), (F.col("week") - 1) * 7 + 2, launch, brand, F.lit(1.0)).alias("line")).select("line.*")
