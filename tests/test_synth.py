"""Planted truth comes back out of the operators."""

from datetime import date

import pytest

from panelscope.operators import buying, charts, fit, penetration, rbr
from panelscope.sources import synth
from panelscope.sources.panel import panel, purchase_lines

LAUNCH = date(2024, 1, 1)


def test_repeat_rate_is_planted_rate(spark):
    p = panel(purchase_lines(synth.repeat_panel(spark, cards=60)), LAUNCH, date(2024, 7, 1))
    got = {r["interval"]: r["rbr"] for r in rbr.rates(p, days=7).collect()}
    assert len(got) >= 20
    for t, value in got.items():
        assert value == pytest.approx(synth.planted_rate(t), abs=1e-9)


def test_buying_index_is_planted_index(spark):
    p = panel(purchase_lines(synth.heavy_panel(spark)), LAUNCH, date(2024, 3, 24))
    row = buying.windowed(p, None).first()
    assert (row["b_triers"], row["b_repeaters"]) == pytest.approx(synth.planted_index(), abs=1e-9)


def test_heavy_panel_refuses_bad_shapes(spark):
    with pytest.raises(ValueError):
        synth.heavy_panel(spark, trier_qty=0.4)
    with pytest.raises(ValueError):
        synth.heavy_panel(spark, trial_weeks=12, weeks=12)


def test_ceiling_is_planted_ceiling(spark):
    p = panel(purchase_lines(synth.launch_panel(spark, cards=2000, every=1)), LAUNCH)
    series = penetration.penetration(p, "week").selectExpr("period AS t", "penetration AS p")
    row = fit.fit(series).first()
    assert row["k"] == pytest.approx(0.34, abs=0.01) and row["note"] == ""
    shown = charts.curve(series, LAUNCH, "week").orderBy("t").collect()
    last = max(r["t"] for r in shown if r["p"] is not None)  # nobody enters later
    assert shown[-1]["t"] == last + 6 and shown[0]["p_projected"] is None and shown[-1]["p"] is None


def test_ticks_are_thinned(spark):
    rows = spark.range(1, 41).withColumnRenamed("id", "period")
    assert [r["period"] for r in charts.ticks(rows).orderBy("period").collect()] == list(range(1, 41, 4))
