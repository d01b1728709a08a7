import math
from datetime import date, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from panelscope.functions import calendar as cal
from panelscope.operators import buying, fit, penetration, rbr
from panelscope.plans import oracle, queries
from panelscope.sources.panel import panel, purchase_lines

SCHEMA = "shopper_id string, txn_date string, is_new_product boolean, is_category boolean, volume double"


def log(spark, rows):
    """Rows (card, day, kind, volume); kind B is a brand line, C a category line."""
    return purchase_lines(spark.createDataFrame([(c, d, k == "B", k == "C", float(v)) for c, d, k, v in rows], SCHEMA))


def test_static_and_dynamic_penetration(spark):
    rows = [("a", "2024-01-02", "C", 1), ("b", "2024-01-03", "C", 1), ("a", "2024-01-04", "B", 1), ("c", "2024-01-16", "C", 1)]
    p = panel(log(spark, rows), date(2024, 1, 1), date(2024, 3, 31))
    got = {r["period"]: r["penetration"] for r in penetration.penetration(p, "week").collect()}
    assert got == {1: 0.5, 2: 0.5, 3: pytest.approx(1 / 3)}
    got = {r["period"]: r["penetration"] for r in penetration.penetration(p, "week", "static").collect()}
    assert got[1] == pytest.approx(1 / 3)
    assert penetration.snapshot(p).first()["trial_index"] == pytest.approx(1 / 3)


def test_exact_intervals_ignore_the_trial_day_and_count_eligible_cards(spark):
    rows = [("a", "2024-01-01", "B", 5), ("a", "2024-01-08", "B", 1), ("a", "2024-01-08", "C", 3), ("b", "2024-01-10", "B", 2), ("b", "2024-01-20", "C", 4)]
    p = panel(log(spark, rows), date(2024, 1, 1), date(2024, 1, 29))
    got = {r["interval"]: (r["brand_qty"], r["cat_qty"], r["rbr"], r["n_eligible"]) for r in rbr.rates(p, days=7).collect()}
    assert got == {1: (1.0, 4.0, 0.25, 2), 2: (0.0, 4.0, 0.0, 2), 3: (0.0, 0.0, None, 1), 4: (0.0, 0.0, None, 1)}


def test_buying_index_weighs_dormant_members(spark):
    rows = [("t", "2023-01-02", "B", 1), ("t", "2023-12-20", "C", 30), ("u", "2023-01-03", "B", 1), ("n", "2023-12-21", "C", 25)]
    p = panel(log(spark, rows), date(2023, 1, 1), date(2023, 12, 31))
    assert buying.windowed(p, 60).first()["b_triers"] == pytest.approx((30 / 2) / (55 / 3))


@pytest.mark.parametrize("method", ["discounted", "ols"])
def test_fit_recovers_an_exponential(spark, method):
    s = spark.createDataFrame([(t, 0.4 * (1 - math.exp(-0.2 * t))) for t in range(1, 21)], "t long, p double")
    r = fit.fit(s, method=method).first()
    assert r["k"] == pytest.approx(0.4, abs=1e-6) and r["a"] == pytest.approx(0.2, abs=0.02)


def test_fit_notes(spark):
    series = lambda ps: spark.createDataFrame(list(enumerate(ps, 1)), "t long, p double")
    assert fit.fit(series([0.1, 0.2, 0.3])).first()["note"] == fit.FEW
    assert fit.fit(series([0.001 * t * t for t in range(1, 9)])).first()["note"] == fit.RISING
    assert fit.fit(series([0.0] * 6)).first()["note"] == fit.FLAT
    assert fit.pwsd(spark.createDataFrame([(1, 0.2, 0.25), (2, 0.3, 0.3)], "t long, actual double, forecast double")).first()["pwsd"] == pytest.approx(math.sqrt(0.6 * 0.25**2 / 1.6))
    assert fit.pwsd(spark.createDataFrame([(1, 0.0, 0.25)], "t long, actual double, forecast double")).first()["pwsd"] is None


def test_ordinals_and_labels_agree_with_plain_python(spark):
    origin = date(2019, 12, 25)
    days = [origin + timedelta(days=3 * i) for i in range(500)]
    df = spark.createDataFrame([(d,) for d in days], "ts date")
    for unit in cal.UNITS:
        got = df.select("ts", cal.period_col("ts", origin, unit).alias("p")).collect()
        assert all(r["p"] == cal.period_of(r["ts"], origin, unit) for r in got), unit
    for unit in ("iso_week", "iso_fortnight", "month", "fiscal_445"):
        named = df.select(cal.label_col(F.col("ts"), unit).alias("a"), cal.period_label_col(cal.period_col("ts", origin, unit), origin, unit).alias("b")).collect()
        assert all(r["a"] == r["b"] for r in named), unit
    assert cal.boundary_end("2024-02") == date(2024, 2, 29)
    with pytest.raises(ValueError):
        cal.parse_period_label("2024-X01")


def test_empty_log_and_null_cards(spark):
    empty = log(spark, [(None, "2024-01-01", "B", 1)])
    assert empty.count() == 0
    p = panel(empty, date(2024, 1, 1), date(2024, 2, 1))
    assert penetration.penetration(p).count() == 0 and rbr.rates(p).count() == 0
    with pytest.raises(ValueError):
        panel(empty)


@pytest.mark.parametrize("name", ["penetration_iso_week", "rbr_exact", "rbr_bucket_complete", "buying_scopes", "cohort_table", "stability"])
def test_queries_equal_their_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("lineitem", "orders", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.queries()[name](spark, sf)
    cols = sorted(df.columns)
    value = lambda v: round(v, 5) if isinstance(v, float) else v
    got = sorted([tuple(value(r[c]) for c in cols) for r in df.collect()], key=str)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({oracle.oracle_sql()[name]})").fetchall()
    key = lambda rows: sorted([tuple(None if v is None else float(v) if not isinstance(v, (str, bool)) else v for v in r) for r in rows], key=str)
    for a, b in zip(key(got), key(want), strict=True):
        assert a == pytest.approx(b, abs=2e-5)


def test_labels_are_read_and_ordered():
    from datetime import date

    from panelscope.functions import calendar as c

    assert c.parse_period_label(" 2024-05 ") == date(2024, 5, 1) and c.parse_period_label("2024-W01") == date(2024, 1, 1)
    assert c.parse_period_label("2024-F03") == date(2024, 1, 15)
    assert [c.is_period_label(x) for x in ("2024-13", "2024-W60", "24-01", "2024-1", "2024-W5", None, "2024-12")] == [False] * 6 + [True]
    assert c.label_last_day("2024-02") == date(2024, 2, 29) and c.label_last_day("2024-W01") == date(2024, 1, 7)
    assert c.label_after("2024-03", date(2024, 2, 29)) and not c.label_after("2024-02", date(2024, 2, 1))
