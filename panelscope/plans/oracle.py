"""The queries in plain SQL for another engine, over shared common tables."""

from __future__ import annotations

from ..operators.fit import FEW, FLAT, LOW, RISING

ORIGIN, ANALYSIS = "1995-01-01", "2000-12-31"
_O = f"DATE '{ORIGIN}'"


def _index(ts: str, unit: str) -> str:
    if unit == "month":
        return f"(year({ts}) * 12 + month({ts}) - 1)"
    if unit == "fiscal_445":
        q = f"least((weekofyear({ts}) - 1) // 13, 3)"
        rest = f"(weekofyear({ts}) - 13 * {q})"
        return f"(isoyear({ts}) * 12 + 3 * {q} + CASE WHEN {rest} <= 4 THEN 0 WHEN {rest} <= 8 THEN 1 ELSE 2 END)"
    days = 14.0 if "fortnight" in unit else 7.0
    start = "DATE '1970-01-05'" if unit.startswith("iso") else _O
    return f"CAST(floor(date_diff('day', {start}, {ts}) / {days}) AS BIGINT)"


def _period(ts: str, unit: str) -> str:
    return f"({_index(ts, unit)} - {_index(_O, unit)} + 1)"


def _label(period: str, unit: str) -> str:
    if unit == "fiscal_445":
        i = f"({period} - 1 + {_index(_O, unit)})"
        return f"printf('%04d-P%02d', CAST({i} // 12 AS INTEGER), CAST({i} % 12 + 1 AS INTEGER))"
    if unit == "month":
        return f"strftime({_O} + INTERVAL 1 MONTH * CAST({period} - 1 AS INTEGER), '%Y-%m')"
    days = 14 if "fortnight" in unit else 7
    start = f"(DATE '1970-01-05' + CAST({_index(_O, unit)} * {days} AS INTEGER))" if unit.startswith("iso") else _O
    return f"strftime({start} + CAST(({period} - 1) * {days} AS INTEGER), '{'%G-F%V' if unit == 'iso_fortnight' else '%G-W%V'}')"


def _series(name: str, unit: str) -> str:
    return f"""
{name}_new AS (SELECT period, sum(b) AS n_b, sum(c) AS n_c FROM (
  SELECT {_period('fb', unit)} AS period, 1 AS b, 0 AS c FROM firsts WHERE fb IS NOT NULL
  UNION ALL SELECT {_period('fc', unit)}, 0, 1 FROM firsts WHERE fc IS NOT NULL) WHERE period >= 1 GROUP BY period),
{name} AS (SELECT * FROM (SELECT s.period, sum(coalesce(n_b, 0)) OVER w AS n_brand, sum(coalesce(n_c, 0)) OVER w AS n_cat, sum(coalesce(n_c, 0)) OVER () AS all_cat
  FROM (SELECT unnest(generate_series(1, (SELECT max(period) FROM {name}_new))) AS period) s LEFT JOIN {name}_new n ON n.period = s.period
  WINDOW w AS (ORDER BY s.period ROWS UNBOUNDED PRECEDING)) WHERE n_cat > 0)"""


def _rounded(x: str, name: str) -> str:
    return f"round({x}, 6) AS {name}"


def fit_sql(name: str, series: str, keys: str = "", ols: bool = False) -> str:
    """Common tables that fit `series` (keys, t, p) by key."""
    part = f"PARTITION BY {keys} " if keys else ""
    k = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    on = " AND ".join(f"n.{x} = s.{x}" for x in keys.split(", ")) if keys else "true"
    nk = ", ".join(f"n.{x}" for x in keys.split(", ")) + ", " if keys else ""
    weight = "1.0" if ols else f"pow(0.6, row_number() OVER ({part}ORDER BY t DESC) - 1)"
    return f"""
{name}_d AS (SELECT *, {weight} AS w FROM (SELECT {k}t, p, (lead(p) OVER ({part}ORDER BY t) - lag(p) OVER ({part}ORDER BY t)) / 2 AS dp FROM {series}) WHERE dp IS NOT NULL),
{name}_m AS (SELECT *, sum(w * p) OVER ({part}) / sum(w) OVER ({part}) AS mx, sum(w * dp) OVER ({part}) / sum(w) OVER ({part}) AS my FROM {name}_d),
{name}_s AS (SELECT {k}sum(w * (p - mx) * (dp - my)) / nullif(sum(w * (p - mx) * (p - mx)), 0) AS slope, first(mx) AS mx, first(my) AS my, max(p) = min(p) AS flat, count(*) AS n_inner FROM {name}_m {group}),
{name}_n AS (SELECT {k}count(*) AS n_points, max(p) AS top FROM {series} {group}),
{name}_c AS (SELECT {nk}n.n_points, n.top, s.n_inner, CASE WHEN s.flat THEN s.my / nullif(2 * s.mx, 0) ELSE s.slope END AS slope, CASE WHEN s.flat THEN s.my / 2 ELSE s.my - s.slope * s.mx END AS level FROM {name}_n n LEFT JOIN {name}_s s ON {on}),
{name} AS (SELECT {k}n_points, CASE WHEN ok THEN -slope END AS a, CASE WHEN ok THEN -level / slope END AS k FROM (SELECT *, n_points >= 4 AND coalesce(n_inner, 0) >= {2 if ols else 1} AND slope < 0 AS ok FROM {name}_c))"""


PROMOS = (24, 48)
CUTOFF = 40


def _segments(name: str, series: str, key: str = "") -> str:
    k = f"{key}, " if key else ""
    rows, edges = [], [(0, PROMOS[0]), (PROMOS[0], PROMOS[1]), (PROMOS[1], None)]
    for t0, end in edges:
        until = f"AND s.t <= {end}" if end else ""
        if not t0:
            rows.append(f"SELECT {k}0 AS t0, 0.0 AS base, t, p FROM {series} s WHERE true {until}")
        else:
            on = f"b.{key} = s.{key} AND " if key else ""
            sk = f"s.{key}, " if key else ""
            rows.append(f"SELECT {sk}{t0}, b.p, s.t - {t0}, s.p - b.p FROM {series} s JOIN {series} b ON {on}b.t = {t0} WHERE s.t > {t0} {until} UNION ALL SELECT {k}{t0}, p, 0, 0.0 FROM {series} WHERE t = {t0}")
    keys = f"{k}t0, base"
    return f"""
{name}_rows AS ({' UNION ALL '.join(rows)}),{fit_sql(name + '_fit', name + '_rows', keys)},
{name} AS (SELECT {keys}, n_points, CASE WHEN n_points >= 4 THEN a END AS a, CASE WHEN n_points >= 4 THEN k END AS k_inc, base + CASE WHEN n_points >= 4 THEN k END AS ceiling FROM {name}_fit)"""


def _clock(name: str, interval: str, last: str) -> str:
    return f"""
{name}_lines AS (SELECT l.*, t.trial, {interval} AS interval, {last} AS last_interval FROM panel l JOIN trials t USING (card)),
{name}_ok AS (SELECT * FROM {name}_lines WHERE ts > trial AND interval BETWEEN 1 AND last_interval),
{name}_n AS (SELECT {last} AS last_interval, count(*) AS n FROM trials GROUP BY 1),
{name}_el AS (SELECT i.interval, sum(coalesce(n, 0)) OVER (ORDER BY i.interval DESC ROWS UNBOUNDED PRECEDING) AS n_eligible FROM (SELECT unnest(generate_series(1, (SELECT max(last_interval) FROM {name}_n))) AS interval) i LEFT JOIN {name}_n n ON n.last_interval = i.interval),
{name} AS (SELECT e.interval, coalesce(bq, 0) AS brand_qty, coalesce(cq, 0) AS cat_qty, bq / nullif(cq, 0) AS rbr, n_eligible FROM {name}_el e LEFT JOIN (SELECT interval, sum(CASE WHEN is_brand THEN qty ELSE 0 END) AS bq, sum(CASE WHEN is_cat THEN qty ELSE 0 END) AS cq FROM {name}_ok GROUP BY interval) r ON r.interval = e.interval)"""


_W = f"(date_diff('day', {_O}, trial) // 7 + 1)"
_COHORT = f"CASE WHEN {_W} <= 6 THEN '1-6w' WHEN {_W} <= 12 THEN '7-12w' WHEN {_W} <= 24 THEN '13-24w' ELSE '25+w' END"
_ISO = lambda x: _index(x, "iso_week")
_IN_WINDOW = f"ts > DATE '{ANALYSIS}' - 365"

PRELUDE = f"""WITH panel AS (SELECT CAST(o_custkey AS VARCHAR) AS card, CAST(o_orderdate AS DATE) AS ts, p_brand = 'Brand#4' AS is_brand, p_type = 'ECONOMY' OR p_brand = 'Brand#4' AS is_cat, l_quantity AS qty
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE CAST(o_orderdate AS DATE) <= DATE '{ANALYSIS}'),
since AS (SELECT * FROM panel WHERE ts >= {_O}),
firsts AS (SELECT card, min(ts) FILTER (is_brand) AS fb, min(ts) FILTER (is_cat) AS fc FROM since WHERE is_brand OR is_cat GROUP BY card),
trials AS (SELECT card, fb AS trial FROM firsts WHERE fb IS NOT NULL),{','.join(_series('pen_' + u, u) for u in ('week', 'fortnight', 'month', 'iso_week', 'iso_fortnight', 'fiscal_445'))},
monthly AS (SELECT period AS t, n_brand / n_cat AS p FROM pen_month),{fit_sql('fit_d', 'monthly')},{fit_sql('fit_o', 'monthly', ols=True)},
smooth AS (SELECT t, avg(p) OVER (ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS p FROM monthly),{fit_sql('fit_s', 'smooth')},
cut AS (SELECT c.t AS cutoff, m.t, m.p FROM monthly c JOIN monthly m ON m.t <= c.t WHERE c.t >= 6),{fit_sql('fit_c', 'cut', 'cutoff')},{_segments('seg', 'monthly')},{_segments('segc', 'cut', 'cutoff')},
prefixes AS (SELECT c.t AS cutoff, m.t, m.p FROM monthly c JOIN monthly m ON m.t <= c.t),{fit_sql('fit_g', 'prefixes', 'cutoff')},
train AS (SELECT t, p FROM monthly WHERE t <= {CUTOFF}),{fit_sql('fit_t', 'train')},
weekly AS (SELECT period AS t, n_brand / n_cat AS p FROM pen_iso_week),{fit_sql('fit_w', 'weekly')},{_clock('exact', "CAST(ceil(date_diff('day', t.trial, l.ts) / 28.0) AS BIGINT)", f"date_diff('day', trial, DATE '{ANALYSIS}') // 28")},{_clock('part', f"{_ISO('l.ts')} - {_ISO('t.trial')}", f"{_ISO(f"DATE '{ANALYSIS}'")} - {_ISO('trial')}")},{_clock('full_', f"{_ISO('l.ts')} - {_ISO('t.trial')}", f"{_ISO(f"(DATE '{ANALYSIS}' + 1)")} - 1 - {_ISO('trial')}")},
cohort_rbr AS (SELECT {_COHORT} AS cohort, interval, sum(CASE WHEN is_brand THEN qty ELSE 0 END) AS brand_qty, sum(CASE WHEN is_cat THEN qty ELSE 0 END) AS cat_qty FROM exact_ok GROUP BY 1, 2),
mem AS (SELECT f.card, f.fb, f.fc, r.ts AS fr FROM firsts f LEFT JOIN (SELECT card, ts FROM (SELECT card, ts, row_number() OVER (PARTITION BY card ORDER BY ts) AS n FROM since WHERE is_brand) WHERE n = 2) r USING (card)),
days AS (SELECT card, ts, is_brand, is_cat, sum(qty) AS qty FROM panel GROUP BY ALL),
cards AS (SELECT d.card, sum(qty) FILTER (is_cat AND ts >= {_O} AND {_IN_WINDOW}) AS v, max(CASE WHEN is_cat AND ts >= {_O} THEN 1 ELSE 0 END) AS buyer, count(*) FILTER (is_brand) >= 2 AS rep, any_value(t.trial) AS trial FROM days d LEFT JOIN trials t ON t.card = d.card GROUP BY d.card),
sc AS (SELECT '__all__' AS scope, v FROM cards WHERE buyer = 1 UNION ALL SELECT '__triers__', v FROM cards WHERE trial IS NOT NULL UNION ALL SELECT '__repeaters__', v FROM cards WHERE rep UNION ALL SELECT {_COHORT}, v FROM cards WHERE trial IS NOT NULL),
scopes AS (SELECT scope, coalesce(sum(v), 0) AS sum_cat, count(*) AS n_buyers, (coalesce(sum(v), 0) / count(*)) / (SELECT sum(v) / count(*) FROM sc WHERE scope = '__all__') AS b FROM sc GROUP BY scope),
table2 AS (SELECT n.cohort, n.n / (SELECT count(fc) FROM firsts) AS penetration, r.rbr, coalesce(s.b, 1) AS buying_index, n.n AS n_triers FROM (SELECT {_COHORT} AS cohort, count(*) AS n FROM trials GROUP BY 1) n LEFT JOIN (SELECT cohort, arg_max(brand_qty / cat_qty, interval) AS rbr FROM cohort_rbr WHERE cat_qty > 0 GROUP BY cohort) r USING (cohort) LEFT JOIN scopes s ON s.scope = n.cohort),
ord AS (SELECT *, CASE cohort WHEN '1-6w' THEN 0 WHEN '7-12w' THEN 1 WHEN '13-24w' THEN 2 ELSE 3 END AS ord FROM table2),
table3 AS (SELECT ord, cohort, penetration, rbr, buying_index, n_triers FROM ord UNION ALL SELECT 4, 'future (estimated)', k - reached, rbr, 1, 0 FROM (SELECT sum(penetration) AS reached, arg_max(rbr, ord) FILTER (rbr IS NOT NULL) AS rbr FROM ord) x, fit_w WHERE k > reached),
lines AS (SELECT c.card, c.ts, c.qty, {_period('c.ts', 'month')} AS period, {_period('m.fb', 'month')} AS tp, {_period('m.fr', 'month')} AS rp, m.fb, m.fr FROM since c JOIN mem m USING (card) WHERE c.is_cat),
share_month AS (SELECT {_period('ts', 'month')} AS period, sum(CASE WHEN is_brand THEN qty ELSE 0 END) AS brand_qty, sum(CASE WHEN is_cat THEN qty ELSE 0 END) AS cat_qty FROM since GROUP BY 1)
"""


def _pen(unit: str, static: bool = False) -> str:
    return f"SELECT period, {_label('period', unit)} AS label, CAST(n_brand AS BIGINT) AS n_brand, CAST(n_cat AS BIGINT) AS n_cat, {_rounded('n_brand / ' + ('all_cat' if static else 'n_cat'), 'penetration')} FROM pen_{unit}"


def _rates(name: str) -> str:
    return f"SELECT CAST(interval AS BIGINT) AS interval, brand_qty, cat_qty, {_rounded('rbr', 'rbr')}, CAST(n_eligible AS BIGINT) AS n_eligible FROM {name}"


def _curve(t: str) -> str:
    return f"(SELECT s.base + s.k_inc * (1 - exp(-s.a * ({t} - s.t0))) FROM seg s WHERE s.a IS NOT NULL AND s.t0 <= {t} ORDER BY s.t0 DESC LIMIT 1)"


_FIT = f"n_points, {_rounded('a', 'a')}, {_rounded('k', 'k')}"
_B = lambda v, n: f"({v} / nullif({n}, 0)) / nullif(cat_qty / nullif(n_buyers, 0), 0)"
_PWSD = "CASE WHEN count(e) = count(*) THEN round(sqrt(sum(w * e * e) / sum(w)), 6) END"

SQL: dict[str, str] = {f"penetration_{u}": _pen(u) for u in ("week", "fortnight", "month", "iso_week", "iso_fortnight", "fiscal_445")} | {
    "penetration_static": _pen("month", True),
    "entrants": "SELECT period, CAST(n_b AS BIGINT) AS n_brand_new, CAST(n_c AS BIGINT) AS n_cat_new FROM pen_month_new",
    "first_purchases": "SELECT card, fb AS first_brand, fc AS first_cat FROM firsts",
    "snapshot": f"SELECT count(fb) AS n_brand, count(fc) AS n_cat, {_rounded('count(fb) / count(fc)', 'trial_index')} FROM firsts",
    "panel_dates": "SELECT max(ts) AS last_day, min(ts) FILTER (is_brand) AS first_brand_day, count(DISTINCT card) FILTER (is_cat) AS n_cat_buyers FROM panel",
    "collapsed_log": "SELECT count(*) AS n_rows, sum(qty) AS qty FROM days",
    "date_dimension": "SELECT ts, strftime(ts, '%G-W%V') AS iso_week, strftime(DATE '1970-01-05' + CAST(floor(date_diff('day', DATE '1970-01-05', ts) / 14.0) * 14 AS INTEGER), '%G-F%V') AS iso_fortnight, strftime(ts, '%Y-%m') AS month, printf('%04d-P%02d', CAST(i // 12 AS INTEGER), CAST(i % 12 + 1 AS INTEGER)) AS fiscal_445 FROM (SELECT ts, " + _index("ts", "fiscal_445") + f" AS i FROM (SELECT CAST(unnest(generate_series({_O}, DATE '{ANALYSIS}', INTERVAL 1 DAY)) AS DATE) AS ts))",
    "share_by_period": f"SELECT period, {_label('period', 'month')} AS label, brand_qty, cat_qty, {_rounded('brand_qty / nullif(cat_qty, 0)', 'share')} FROM share_month",
    "share_rollup": f"SELECT CAST(1995 + (period - 1) // 12 AS VARCHAR) AS year, min(period) AS first_period, sum(brand_qty) AS brand_qty, sum(cat_qty) AS cat_qty, {_rounded('sum(brand_qty) / nullif(sum(cat_qty), 0)', 'share')} FROM share_month GROUP BY 1",
    "cumulative_rollup": f"SELECT CAST(1995 + (period - 1) // 12 AS VARCHAR) AS year, min(period) AS first_period, {_rounded('arg_max(n_brand / n_cat, period)', 'penetration')} FROM pen_month GROUP BY 1",
    "trial_cohorts": f"SELECT {_COHORT} AS cohort, count(*) AS n_triers FROM trials GROUP BY 1",
    "trier_counts_by_entry_week": f"SELECT {_W} AS entry_week, {_COHORT} AS cohort, count(*) AS n FROM trials GROUP BY 1, 2",
    "cohort_penetration": f"SELECT cohort, entry_week, n, CAST(sum(n) OVER (PARTITION BY cohort ORDER BY entry_week ROWS UNBOUNDED PRECEDING) AS BIGINT) AS n_cum FROM (SELECT {_COHORT} AS cohort, {_W} AS entry_week, count(*) AS n FROM trials GROUP BY 1, 2)",
    "rbr_exact": _rates("exact"),
    "rbr_capped": _rates("exact") + " WHERE interval <= 12",
    "rbr_bucket_partial": _rates("part"),
    "rbr_bucket_complete": _rates("full_"),
    "rbr_eligibility": "SELECT CAST(interval AS BIGINT) AS interval, CAST(n_eligible AS BIGINT) AS n_eligible FROM exact_el",
    "rbr_cohort_weeks": f"SELECT cohort, interval, brand_qty, cat_qty, {_rounded('brand_qty / nullif(cat_qty, 0)', 'rbr')} FROM cohort_rbr",
    "rbr_cohort_bands": f"SELECT CASE WHEN trial <= DATE '1995-07-02' THEN 0 WHEN trial <= DATE '1996-01-15' THEN 1 WHEN trial <= DATE '1996-12-31' THEN 2 ELSE 3 END AS cohort, interval, sum(CASE WHEN is_brand THEN qty ELSE 0 END) AS brand_qty, sum(CASE WHEN is_cat THEN qty ELSE 0 END) AS cat_qty, {_rounded('sum(CASE WHEN is_brand THEN qty ELSE 0 END) / nullif(sum(CASE WHEN is_cat THEN qty ELSE 0 END), 0)', 'rbr')} FROM exact_ok GROUP BY 1, 2",
    "rbr_plateau": "SELECT CAST(min(interval) AS BIGINT) AS interval, round(arg_min(rbr, interval), 6) AS rbr FROM (SELECT interval, rbr, max(rbr) OVER w - min(rbr) OVER w AS d, count(*) OVER w AS n FROM exact WHERE rbr IS NOT NULL WINDOW w AS (ORDER BY interval ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)) WHERE n = 3 AND d <= 0.02 HAVING count(*) > 0",
    "rbr_furthest": "SELECT CAST(max(interval) AS BIGINT) AS interval, round(arg_max(rbr, interval), 6) AS rbr FROM exact WHERE rbr IS NOT NULL",
    "rbr_stable_mean": "SELECT round(avg(rbr), 6) AS rbr FROM exact WHERE interval >= 10",
    "buying_windowed": f"SELECT n_buyers, n_triers, n_repeaters, cat_qty, cat_qty_triers, cat_qty_repeaters, {_rounded(_B('cat_qty_triers', 'n_triers'), 'b_triers')}, {_rounded(_B('cat_qty_repeaters', 'n_repeaters'), 'b_repeaters')} FROM (SELECT count(fc) AS n_buyers, count(fb) AS n_triers, count(fr) AS n_repeaters FROM mem) n, (SELECT sum(qty) AS cat_qty, sum(qty) FILTER (fb IS NOT NULL) AS cat_qty_triers, sum(qty) FILTER (fr IS NOT NULL) AS cat_qty_repeaters FROM lines WHERE {_IN_WINDOW}) v",
    "buying_growing": f"SELECT label, period, cat_qty, cat_qty_triers, cat_qty_repeaters, n_buyers, n_triers, n_repeaters, {_rounded(_B('cat_qty_triers', 'n_triers'), 'b_triers')}, {_rounded(_B('cat_qty_repeaters', 'n_repeaters'), 'b_repeaters')}, false AS partial FROM (SELECT {_label('s.period', 'month')} AS label, s.period, coalesce(v.a, 0) AS cat_qty, coalesce(v.b, 0) AS cat_qty_triers, coalesce(v.c, 0) AS cat_qty_repeaters, (SELECT count(*) FROM mem WHERE {_period('fc', 'month')} <= s.period) AS n_buyers, (SELECT count(*) FROM mem WHERE {_period('fb', 'month')} <= s.period) AS n_triers, (SELECT count(*) FROM mem WHERE {_period('fr', 'month')} <= s.period) AS n_repeaters FROM (SELECT unnest(generate_series(1, 72)) AS period) s LEFT JOIN (SELECT period, sum(qty) AS a, sum(qty) FILTER (tp <= period) AS b, sum(qty) FILTER (rp <= period) AS c FROM lines GROUP BY period) v ON v.period = s.period)",
    "buying_fixed_panel": f"SELECT period, sel_sum, sel_n, all_sum, all_n, {_rounded('(sel_sum / sel_n) / (all_sum / all_n)', 'b')} FROM (SELECT period, coalesce(sum(qty) FILTER (fb IS NOT NULL), 0) AS sel_sum, sum(qty) AS all_sum FROM lines GROUP BY period) v, (SELECT count(fb) AS sel_n, count(fc) AS all_n FROM firsts) n",
    "buying_scopes": f"SELECT scope, sum_cat, n_buyers, {_rounded('b', 'b')} FROM scopes",
    "buying_cohorts": f"SELECT m.period, {_label('m.period', 'month')} AS cohort, n_triers, coalesce(v, 0) AS cat_qty, {_rounded('(coalesce(v, 0) / n_triers) / (SELECT sum(qty) / (SELECT count(fc) FROM mem) FROM lines WHERE ' + _IN_WINDOW + ')', 'b')} FROM (SELECT {_period('fb', 'month')} AS period, count(*) AS n_triers FROM mem WHERE fb IS NOT NULL GROUP BY 1) m LEFT JOIN (SELECT tp, sum(qty) AS v FROM lines WHERE {_IN_WINDOW} GROUP BY tp) v ON v.tp = m.period",
    "buying_unfloored": f"SELECT {_rounded('avg(v) FILTER (n >= 2)', 'avg_selected')}, {_rounded('avg(v)', 'avg_all')}, {_rounded('avg(v) FILTER (n >= 2) / avg(v)', 'b')} FROM (SELECT card, sum(qty) FILTER (is_cat) AS v, count(*) FILTER (is_brand) AS n FROM panel GROUP BY card)",
    "penetration_smoothed": f"SELECT t, {_rounded('p', 'p')} FROM smooth",
    "penetration_differences": f"SELECT t, {_rounded('p', 'p')}, {_rounded('dp', 'dp')} FROM fit_d_d",
    "fit_discounted": f"SELECT {_FIT} FROM fit_d",
    "fit_ols": f"SELECT {_FIT} FROM fit_o",
    "fit_smoothed": f"SELECT {_FIT} FROM fit_s",
    "fit_projection": f"SELECT g.t, {_rounded('p', 'p')}, {_rounded('k * (1 - exp(-a * g.t))', 'p_fitted')} FROM (SELECT unnest(generate_series(1, 96)) AS t) g LEFT JOIN monthly m ON m.t = g.t, fit_d",
    "stability": f"SELECT f.cutoff, {_rounded('p', 'observed_p')}, {_FIT} FROM fit_c f JOIN monthly m ON m.t = f.cutoff",
    "stability_spread": "SELECT count(k) AS n, round(stddev_samp(k) / avg(k), 6) AS cv FROM (SELECT k FROM fit_c WHERE k IS NOT NULL ORDER BY cutoff DESC LIMIT 4)",
    "piecewise_fit": f"SELECT t0, {_rounded('base', 'base')}, n_points, {_rounded('a', 'a')}, {_rounded('k_inc', 'k_inc')}, {_rounded('ceiling', 'ceiling')} FROM seg",
    "piecewise_evaluate": f"SELECT t, {_rounded('p', 'p')}, {_rounded(_curve('m.t'), 'p_fitted')} FROM monthly m",
    "piecewise_ultimate": "SELECT round(arg_max(ceiling, t0) FILTER (ceiling IS NOT NULL), 6) AS k, round(arg_max(a, t0) FILTER (ceiling IS NOT NULL), 6) AS a, count(ceiling) AS n_segments_fitted FROM seg",
    "pwsd": f"SELECT {_PWSD} AS pwsd FROM (SELECT (m.p - f.k * (1 - exp(-f.a * m.t))) / nullif(m.p, 0) AS e, pow(0.6, row_number() OVER (ORDER BY m.t DESC) - 1) AS w FROM monthly m, fit_d f)",
    "validation": f"SELECT {CUTOFF} AS cutoff, (SELECT {_PWSD} FROM (SELECT (m.p - f.k * (1 - exp(-f.a * m.t))) / nullif(m.p, 0) AS e, pow(0.6, row_number() OVER (ORDER BY m.t DESC) - 1) AS w FROM monthly m, fit_t f)) AS pwsd_full, (SELECT {_PWSD} FROM (SELECT (m.p - f.k * (1 - exp(-f.a * m.t))) / nullif(m.p, 0) AS e, pow(0.6, row_number() OVER (ORDER BY m.t DESC) - 1) AS w FROM monthly m, fit_t f WHERE m.t > {CUTOFF})) AS pwsd_holdout",
    "promo_bought": "SELECT x.t, round(x.p, 6) AS observed, round(b.a, 6) AS base_a, round(b.k, 6) AS base_k, round(f.a, 6) AS a, round(f.k, 6) AS k, round(x.p - b.k * (1 - exp(-b.a * x.t)), 6) AS bought FROM (SELECT max(t) AS t, arg_max(p, t) AS p FROM monthly) x, fit_t b, fit_d f",
    "cohort_table": "SELECT CAST(ord AS INTEGER) AS ord, cohort, round(penetration, 6) AS penetration, round(rbr, 6) AS rbr, round(buying_index, 6) AS buying_index, n_triers, round(coalesce(penetration * rbr * buying_index, 0), 6) AS contribution FROM table3",
    "segmented_share": "SELECT round(sum(coalesce(penetration * rbr * buying_index, 0)), 6) AS segmented_share, round(sum(penetration * rbr) / sum(penetration) FILTER (rbr IS NOT NULL), 6) AS blended_rbr FROM table3",
    "predictions": "SELECT round(i, 6) AS trial_index, round(k, 6) AS k, round(rbr, 6) AS rbr, round(b, 6) AS buying_index, round(i * rbr * b, 6) AS simple_share, round(k * rbr * b, 6) AS projected_share FROM (SELECT count(fb) / count(fc) AS i FROM firsts), (SELECT k FROM fit_w), (SELECT arg_max(rbr, interval) AS rbr FROM exact WHERE rbr IS NOT NULL), (SELECT b FROM scopes WHERE scope = '__triers__')",
    "piecewise_stability": "SELECT u.cutoff, round(m.p, 6) AS observed_p, round(u.k, 6) AS k, round(u.a, 6) AS a, u.n AS n_segments_fitted FROM (SELECT cutoff, arg_max(ceiling, t0) FILTER (ceiling IS NOT NULL) AS k, arg_max(a, t0) FILTER (ceiling IS NOT NULL) AS a, count(ceiling) AS n FROM segc GROUP BY cutoff) u JOIN monthly m ON m.t = u.cutoff",
    "predictions_stable": "SELECT round(i, 6) AS trial_index, round(k, 6) AS k, round(rbr, 6) AS rbr, round(b, 6) AS buying_index, round(i * rbr * b, 6) AS simple_share, round(k * rbr * b, 6) AS projected_share FROM (SELECT count(fb) / count(fc) AS i FROM firsts), (SELECT k FROM fit_w), (SELECT coalesce(avg(rbr) FILTER (interval >= 10), arg_max(rbr, interval) FILTER (rbr IS NOT NULL)) AS rbr FROM exact), (SELECT b FROM scopes WHERE scope = '__triers__')",
    "stability_notes": f"SELECT cutoff, n_points, CASE WHEN n_points < 4 OR coalesce(n_inner, 0) < 1 THEN '{FEW}' WHEN slope IS NULL THEN '{FLAT}' WHEN slope >= 0 THEN '{RISING}' WHEN -level / slope < top THEN '{LOW}' ELSE '' END AS note FROM fit_g_c",
    "month_ordinals": "SELECT strftime(ts, '%Y-%m') AS label, min(ts) AS first_day, row_number() OVER (ORDER BY min(ts)) AS ordinal FROM panel GROUP BY 1",
    "fiscal_starts": f"SELECT period, CAST(date_trunc('week', make_date(CAST(i // 12 AS BIGINT), 1, 4)) AS DATE) + CAST(7 * (13 * ((i % 12) // 3) + 4 * (i % 3)) AS INTEGER) AS first_day FROM (SELECT period, period - 1 + {_index(_O, 'fiscal_445')} AS i FROM pen_fiscal_445)",
    "chart_penetration": f"SELECT g.t, {_label('g.t', 'month')} AS label, round(m.p, 6) AS p, round(CASE WHEN g.t >= last THEN k * (1 - exp(-a * g.t)) END, 6) AS p_projected, round(k, 6) AS ultimate FROM (SELECT a, k, last, unnest(generate_series(1, CAST(CASE WHEN k IS NULL THEN last ELSE greatest(least(greatest(ceil(ln(100.0) / a), last), last + 12), last + 3) END AS BIGINT))) AS t FROM fit_d, (SELECT max(t) AS last FROM monthly)) g LEFT JOIN monthly m ON m.t = g.t",
    "chart_promo": "SELECT m.t, round(m.p, 6) AS p, round(b.k * (1 - exp(-b.a * m.t)), 6) AS baseline, round(f.k * (1 - exp(-f.a * m.t)), 6) AS refit FROM monthly m, fit_t b, fit_d f",
    "chart_bought": f"SELECT promo, t, round(p, 6) AS p, round(b, 6) AS baseline, round(p - b, 6) AS gap FROM (SELECT x.promo, m.t, m.p, s.base + s.k_inc * (1 - exp(-s.a * (m.t - s.t0))) AS b FROM (SELECT 0 AS t0, {PROMOS[0]} AS promo UNION ALL SELECT {PROMOS[0]}, {PROMOS[1]}) x JOIN seg s ON s.t0 = x.t0 JOIN monthly m ON m.t BETWEEN x.promo AND x.promo + 1 WHERE s.a IS NOT NULL AND x.promo < (SELECT max(t) FROM monthly))",
    "chart_increments": "SELECT d.t, round(d.p, 6) AS p, round(d.dp, 6) AS dp, round(f.a * (f.k - d.p), 6) AS line FROM fit_d_d d, fit_d f",
    "chart_ticks": f"SELECT period, {_label('period', 'month')} AS label FROM (SELECT period, row_number() OVER (ORDER BY period) - 1 AS pos, count(*) OVER () AS n FROM pen_month) WHERE pos % CAST(ceil(n / 13.0) AS BIGINT) = 0",
    "chart_dashboard": "SELECT 'penetration' AS series, t AS x, round(p, 6) AS y FROM monthly WHERE p IS NOT NULL UNION ALL SELECT 'rbr', interval, round(rbr, 6) FROM exact WHERE rbr IS NOT NULL UNION ALL SELECT 'share', period, round(brand_qty / nullif(cat_qty, 0), 6) FROM share_month WHERE cat_qty <> 0",
    "share_by_interval": "SELECT CAST(interval AS BIGINT) AS interval, round(i * rbr * b, 6) AS predicted_share FROM exact, (SELECT count(fb) / count(fc) AS i FROM firsts), (SELECT b FROM scopes WHERE scope = '__triers__')",
}


_EVENT_WEEK = "CAST(floor(date_diff('day', DATE '1970-01-05', {}) / 7.0) AS BIGINT)"
EVENTS_PRELUDE = f"""WITH ev AS (SELECT CAST(user_id AS VARCHAR) AS card, CAST(ts AS DATE) AS ts, event_type = 'purchase' AS is_brand, event_type IN ('purchase', 'click', 'view') AS is_cat, value AS qty FROM events WHERE user_id IS NOT NULL),
o AS (SELECT min(ts) FILTER (is_brand) AS origin FROM ev),
since AS (SELECT ev.*, origin FROM ev, o WHERE ts >= origin),
firsts AS (SELECT min(ts) FILTER (is_brand) AS fb, min(ts) FILTER (is_cat) AS fc, first(origin) AS origin FROM since WHERE is_brand OR is_cat GROUP BY card),
new AS (SELECT period, sum(b) AS b, sum(c) AS c FROM (SELECT {_EVENT_WEEK.format('fb')} - {_EVENT_WEEK.format('origin')} + 1 AS period, 1 AS b, 0 AS c FROM firsts WHERE fb IS NOT NULL UNION ALL SELECT {_EVENT_WEEK.format('fc')} - {_EVENT_WEEK.format('origin')} + 1, 0, 1 FROM firsts WHERE fc IS NOT NULL) GROUP BY period)
"""
EVENTS_SQL = {
    "events_penetration_iso_week": f"SELECT period, strftime(DATE '1970-01-05' + CAST(7 * ({_EVENT_WEEK.format('origin')} + period - 1) AS INTEGER), '%G-W%V') AS label, n_brand, n_cat, round(n_brand / n_cat, 6) AS penetration FROM (SELECT s.period, CAST(sum(coalesce(b, 0)) OVER w AS BIGINT) AS n_brand, CAST(sum(coalesce(c, 0)) OVER w AS BIGINT) AS n_cat FROM (SELECT unnest(generate_series(1, (SELECT max(period) FROM new))) AS period) s LEFT JOIN new n ON n.period = s.period WINDOW w AS (ORDER BY s.period ROWS UNBOUNDED PRECEDING)), o WHERE n_cat > 0",
    "events_share_by_period": "SELECT (year(ts) * 12 + month(ts)) - (year(origin) * 12 + month(origin)) + 1 AS period, strftime(ts, '%Y-%m') AS label, round(sum(CASE WHEN is_brand THEN qty ELSE 0 END), 6) AS brand_qty, round(sum(CASE WHEN is_cat THEN qty ELSE 0 END), 6) AS cat_qty, round(sum(CASE WHEN is_brand THEN qty ELSE 0 END) / nullif(sum(CASE WHEN is_cat THEN qty ELSE 0 END), 0), 6) AS share FROM since GROUP BY 1, 2",
}


def oracle_sql() -> dict[str, str]:
    return {name: PRELUDE + sql for name, sql in SQL.items()} | {name: EVENTS_PRELUDE + sql for name, sql in EVENTS_SQL.items()}
