"""Calendars, holidays, gaps, expiries, vintages."""

from pyspark.sql import functions as F

from volpanel.catalog import fixtures as fx
from volpanel.catalog.registry import query, rounded
from volpanel.catalog.sql import part, rd, with_parts
from volpanel.operators import calendars as cal
from volpanel.operators import vintages as vt

SPAN = "(SELECT min(CAST(o_orderdate AS DATE)) AS d0, max(CAST(o_orderdate AS DATE)) AS d1 FROM orders)"
REGIME, CUTOFF = "1998-03-01", "2000-01-01"


def span(spark, sf_dir, back=0, ahead=0):
    return cal.span_of(fx.panel(spark, sf_dir), "obs_date", back, ahead)


def holidays(spark, sf_dir):
    return fx.remember(spark, sf_dir, "holidays", lambda: cal.holidays(cal.years_of(span(spark, sf_dir))))


def wide_calendar(spark, sf_dir):
    return cal.calendar(span(spark, sf_dir, 60, 90))


part("cal", f"SELECT CAST(unnest(generate_series(d0, d1, INTERVAL 1 DAY)) AS DATE) AS day FROM {SPAN}")
part("cal_wide", f"SELECT CAST(unnest(generate_series(d0 - 60, d1 + 90, INTERVAL 1 DAY)) AS DATE) AS day FROM {SPAN}")
part("yrs", f"SELECT unnest(range(year(d0) - 1, year(d1) + 2)) AS y FROM {SPAN}")
# every day of the years, to find weekdays of months by counting
part("days", "SELECT CAST(unnest(generate_series(make_date(y, 1, 1), make_date(y, 12, 31), INTERVAL 1 DAY)) AS DATE) AS day, y FROM yrs", "yrs")
part("dn", """SELECT day, y, month(day) AS m, isodow(day) AS wd, row_number() OVER (PARTITION BY y, month(day), isodow(day) ORDER BY day) AS nth,
row_number() OVER (PARTITION BY y, month(day), isodow(day) ORDER BY day DESC) AS back FROM days""", "days")
# Easter by the rule of Gauss with its two exceptions, for 1900..2099
part("east", """SELECT y, CAST(make_date(y, 3, 22) + CAST(CASE WHEN d + e = 35 THEN 28 WHEN d = 28 AND e = 6 AND (11 * 24 + 11) % 30 < 19 AND a > 10 THEN 27 ELSE d + e END AS INT) AS DATE) AS sunday
FROM (SELECT y, a, d, (2 * b + 4 * c + 6 * d + 5) % 7 AS e FROM (SELECT y, y % 19 AS a, y % 4 AS b, y % 7 AS c, (19 * (y % 19) + 24) % 30 AS d FROM yrs))""", "yrs")


def _nearest(d):
    return f"CASE isodow({d}) WHEN 6 THEN {d} - 1 WHEN 7 THEN {d} + 1 ELSE {d} END"


_US = """SELECT day FROM dn WHERE (m = 1 AND wd = 1 AND nth = 3) OR (m = 2 AND wd = 1 AND nth = 3) OR (m = 5 AND wd = 1 AND back = 1)
 OR (m = 9 AND wd = 1 AND nth = 1) OR (m = 11 AND wd = 4 AND nth = 4)"""
part("hol", f"""SELECT DISTINCT kind, CAST(day AS DATE) AS day FROM (
SELECT 'exchange' AS kind, day FROM ({_US}) UNION ALL SELECT 'federal', day FROM ({_US})
UNION ALL SELECT 'federal', day FROM dn WHERE m = 10 AND wd = 1 AND nth = 2
UNION ALL SELECT k.kind, {_nearest('make_date(y, 7, 4)')} FROM yrs, (VALUES ('exchange'), ('federal')) k(kind)
UNION ALL SELECT k.kind, {_nearest('make_date(y, 12, 25)')} FROM yrs, (VALUES ('exchange'), ('federal')) k(kind)
UNION ALL SELECT 'federal', {_nearest('make_date(y, 1, 1)')} FROM yrs
UNION ALL SELECT 'federal', {_nearest('make_date(y, 11, 11)')} FROM yrs
UNION ALL SELECT 'exchange', CASE isodow(make_date(y, 1, 1)) WHEN 7 THEN make_date(y, 1, 2) ELSE make_date(y, 1, 1) END FROM yrs
UNION ALL SELECT 'exchange', sunday - 2 FROM east UNION ALL SELECT 'england', sunday - 2 FROM east UNION ALL SELECT 'england', sunday + 1 FROM east
UNION ALL SELECT 'england', min(day) FROM days WHERE isodow(day) < 6 GROUP BY y
UNION ALL SELECT 'england', day FROM dn WHERE (m = 5 AND wd = 1 AND nth = 1) OR (m = 5 AND wd = 1 AND back = 1) OR (m = 8 AND wd = 1 AND back = 1)
UNION ALL SELECT 'england', make_date(y, 12, 25) + CASE isodow(make_date(y, 12, 25)) WHEN 6 THEN 2 WHEN 7 THEN 2 ELSE 0 END FROM yrs
UNION ALL SELECT 'england', make_date(y, 12, 26) + CASE isodow(make_date(y, 12, 25)) WHEN 6 THEN 2 WHEN 5 THEN 2 ELSE 0 END FROM yrs)""",
     "dn", "east", "yrs", "days")


@query("calendar", with_parts("SELECT CAST(day AS VARCHAR) AS day, CAST(isodow(day) - 1 AS INT) AS weekday, isodow(day) < 6 AS is_weekday FROM cal", "cal"))
def calendar(spark, sf_dir):
    return cal.calendar(span(spark, sf_dir))


@query("holidays", with_parts("SELECT kind, CAST(day AS VARCHAR) AS day FROM hol", "hol"))
def all_holidays(spark, sf_dir):
    return holidays(spark, sf_dir)


part("bdays", "SELECT c.day, isodow(c.day) < 6 AND h.day IS NULL AS is_bd FROM cal_wide c LEFT JOIN hol h ON h.kind = 'england' AND h.day = c.day", "cal_wide", "hol")
part("bd", """SELECT a.day, a.is_bd, (SELECT min(b.day) FROM bdays b WHERE b.is_bd AND b.day >= a.day) AS next_bd,
(SELECT max(b.day) FROM bdays b WHERE b.is_bd AND b.day < a.day) AS prev_bd FROM bdays a""", "bdays")


@query("business_days", with_parts(f"""SELECT CAST(day AS VARCHAR) AS day, is_bd, CAST(next_bd AS VARCHAR) AS next_bd, CAST(prev_bd AS VARCHAR) AS prev_bd
FROM bd, {SPAN} WHERE day BETWEEN d0 AND d1""", "bd"))
def business_days(spark, sf_dir):
    b = cal.business_days(wide_calendar(spark, sf_dir), holidays(spark, sf_dir), "england")
    return cal.within(b, span(spark, sf_dir)).select("day", "is_bd", "next_bd", "prev_bd")


part("gp", """SELECT series_id, row_no, obs_date, year, lag(obs_date) OVER (PARTITION BY series_id ORDER BY row_no) AS prev_date FROM num QUALIFY prev_date IS NOT NULL""", "num")
part("gaps", """SELECT g.series_id, g.row_no, g.obs_date, g.prev_date, g.year, date_diff('day', g.prev_date, g.obs_date) AS calendar_gap_days,
count(c.day) AS n_missing_weekdays, count(c.day) FILTER (WHERE ex) AS n_exchange_holidays, count(c.day) FILTER (WHERE NOT ex AND en) AS n_other_holidays,
count(c.day) FILTER (WHERE NOT ex AND NOT en) AS n_unexplained,
coalesce(string_agg(CAST(c.day AS VARCHAR), ';' ORDER BY c.day) FILTER (WHERE NOT ex AND NOT en), '') AS unexplained_dates
FROM gp g LEFT JOIN (SELECT day, day IN (SELECT day FROM hol WHERE kind = 'exchange') AS ex, day IN (SELECT day FROM hol WHERE kind = 'england') AS en FROM cal WHERE isodow(day) < 6) c
ON c.day > g.prev_date AND c.day < g.obs_date GROUP BY ALL""", "gp", "hol", "cal")


def gaps(spark, sf_dir):
    return fx.remember(spark, sf_dir, "gaps", lambda: cal.classify_gaps(fx.panel(spark, sf_dir), holidays(spark, sf_dir)))


@query("classify_gaps", with_parts("""SELECT series_id, row_no, CAST(prev_date AS VARCHAR) AS prev_date, CAST(obs_date AS VARCHAR) AS obs_date,
CAST(calendar_gap_days AS INT) AS calendar_gap_days, n_missing_weekdays, n_exchange_holidays, n_other_holidays, n_unexplained, unexplained_dates,
CAST(n_unexplained > 0 AS INT) AS real_gap, CASE WHEN n_unexplained > 0 THEN 'unexplained' WHEN n_other_holidays > 0 THEN 'other_holiday'
WHEN n_missing_weekdays > 0 THEN 'exchange_holiday' ELSE 'none' END AS category FROM gaps""", "gaps"))
def classify_gaps(spark, sf_dir):
    return gaps(spark, sf_dir).drop("year")


@query("gap_distribution", with_parts(f"""SELECT series_id, CASE WHEN calendar_gap_days <= 1 THEN '1' WHEN calendar_gap_days <= 3 THEN '2-3' ELSE '>=4' END AS bucket,
CAST(calendar_gap_days AS INT) AS calendar_gap_days, count(*) AS n_rows, {rd('100.0 * count(*) / sum(count(*)) OVER (PARTITION BY series_id)', 6)} AS pct_of_returns
FROM gaps GROUP BY series_id, calendar_gap_days""", "gaps"))
def gap_distribution(spark, sf_dir):
    return rounded(cal.gap_distribution(gaps(spark, sf_dir)), 6)


@query("gaps_by_year", with_parts("""SELECT series_id, year, count(*) AS n_returns, CAST(sum(CAST(n_unexplained > 0 AS INT)) AS BIGINT) AS n_real_gaps,
CAST(sum(n_unexplained) AS BIGINT) AS n_skipped_days, count(*) FILTER (WHERE calendar_gap_days >= 4) AS n_gap_ge4 FROM gaps GROUP BY ALL""", "gaps"))
def gaps_by_year(spark, sf_dir):
    return cal.gaps_by_year(gaps(spark, sf_dir))


def flagged(spark, sf_dir):
    return fx.panel(spark, sf_dir).join(gaps(spark, sf_dir).select("series_id", "row_no", "real_gap", "n_unexplained"),
                                        ["series_id", "row_no"], "left").na.fill(0, ["real_gap", "n_unexplained"])


part("flags", "SELECT n.*, coalesce(CAST(g.n_unexplained > 0 AS INT), 0) AS flag, coalesce(g.n_unexplained, 0) AS skipped FROM num n LEFT JOIN gaps g USING (series_id, row_no)", "num", "gaps")
part("hits", " UNION ALL ".join(f"""SELECT series_id, row_no, year, {h} AS horizon,
max(flag) OVER (PARTITION BY series_id ORDER BY row_no ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) > 0 AS any_hit,
count(*) OVER (PARTITION BY series_id) - 1 - row_no >= {h} AS valid FROM flags""" for h in fx.HORIZONS), "flags")


@query("window_exposure", with_parts(f"""SELECT series_id, horizon, count(*) FILTER (WHERE valid) AS n_valid, count(*) FILTER (WHERE valid AND any_hit) AS n_affected,
{rd('100.0 * count(*) FILTER (WHERE valid AND any_hit) / count(*) FILTER (WHERE valid)', 6)} AS pct_affected,
count(*) FILTER (WHERE valid AND t) AS n_test, count(*) FILTER (WHERE valid AND t AND any_hit) AS n_affected_test,
{rd('100.0 * count(*) FILTER (WHERE valid AND t AND any_hit) / nullif(count(*) FILTER (WHERE valid AND t), 0)', 6)} AS pct_affected_test,
count(*) FILTER (WHERE valid AND any_hit AND year >= 2000) AS n_affected_late
FROM (SELECT *, year >= 1998 AND NOT (year = 2001 AND horizon >= 66) AS t FROM hits) GROUP BY ALL""", "hits"))
def window_exposure(spark, sf_dir):
    hits = cal.window_hits(flagged(spark, sf_dir), "real_gap", fx.HORIZONS)
    return rounded(cal.window_exposure(hits, fx.FIRST_TEST_YEAR, fx.PARTIAL_YEAR, 2000, 66), 6)


@query("calendar_conflicts", with_parts(f"""SELECT CAST(day AS VARCHAR) AS day, CASE WHEN bool_or(kind = 'exchange') THEN 'exchange' ELSE 'england_only' END AS calendar,
CAST(day IN (SELECT obs_date FROM num) AS INT) AS in_data FROM hol, {SPAN} WHERE kind != 'federal' AND day BETWEEN d0 AND d1 AND isodow(day) < 6 GROUP BY day""", "hol", "num"))
def calendar_conflicts(spark, sf_dir):
    return cal.calendar_conflicts(fx.panel(spark, sf_dir), holidays(spark, sf_dir), span(spark, sf_dir))


def expiries(spark, sf_dir):
    bd = cal.business_days(wide_calendar(spark, sf_dir), holidays(spark, sf_dir), "england")
    return fx.remember(spark, sf_dir, "expiries", lambda: cal.contract_expiry(cal.months_of(span(spark, sf_dir)), bd, REGIME))


part("exps", f"""WITH m AS (SELECT CAST(unnest(generate_series(date_trunc('month', d0), date_trunc('month', d1) + INTERVAL 2 MONTH, INTERVAL 1 MONTH)) AS DATE) AS contract FROM {SPAN}),
o AS (SELECT contract, (SELECT max(b.day) FROM bdays b WHERE b.is_bd AND b.day < (SELECT max(s.day) FROM bdays s WHERE s.is_bd AND s.day <= contract - 15)) AS old_exp,
 (SELECT max(b.day) FROM bdays b WHERE b.is_bd AND b.day < contract - INTERVAL 1 MONTH) AS last_day FROM m),
x AS (SELECT *, (SELECT max(b.day) FROM bdays b WHERE b.is_bd AND b.day < make_date(year(last_day), 12, 25)) AS bx,
 (SELECT max(b.day) FROM bdays b WHERE b.is_bd AND b.day < make_date(year(last_day) + 1, 1, 1)) AS bn,
 (SELECT max(b.day) FROM bdays b WHERE b.is_bd AND b.day < last_day) AS earlier FROM o)
SELECT contract, CASE WHEN contract < DATE '{REGIME}' THEN old_exp WHEN last_day IN (bx, bn) THEN earlier ELSE last_day END AS expiry,
CASE WHEN contract < DATE '{REGIME}' THEN 'fifteen_days' ELSE 'month_ahead' END AS rule FROM x""", "bdays")


@query("contract_expiry", with_parts("SELECT CAST(contract AS VARCHAR) AS contract, CAST(expiry AS VARCHAR) AS expiry, rule FROM exps", "exps"))
def contract_expiry(spark, sf_dir):
    return expiries(spark, sf_dir)


def rolls(spark, sf_dir):
    return cal.roll_rows(fx.panel(spark, sf_dir), expiries(spark, sf_dir))


part("rollt", """SELECT n.series_id, e.contract, e.expiry, e.rule, min(n.row_no) AS roll_row, min(n.obs_date) AS roll_date,
CAST(bool_or(n0.obs_date IS NOT NULL) AS INT) AS expiry_in_data FROM exps e JOIN num n ON n.obs_date > e.expiry
JOIN (SELECT series_id, min(obs_date) AS d0 FROM num GROUP BY 1) f ON f.series_id = n.series_id AND e.expiry >= f.d0
LEFT JOIN num n0 ON n0.series_id = n.series_id AND n0.obs_date = e.expiry GROUP BY ALL""", "exps", "num")


@query("roll_rows", with_parts("SELECT series_id, CAST(contract AS VARCHAR) AS contract, CAST(expiry AS VARCHAR) AS expiry, rule, roll_row, CAST(roll_date AS VARCHAR) AS roll_date, expiry_in_data FROM rollt", "rollt"))
def roll_rows(spark, sf_dir):
    return rolls(spark, sf_dir)


# --- vintages ---------------------------------------------------------------
def vintages(spark, sf_dir):
    """A release on the first Monday of every month holds all days up to it."""
    def build():
        p = fx.panel(spark, sf_dir).select("series_id", "obs_date", "idx_a")
        monday = lambda m: F.next_day(F.date_sub(m, 1), "Mon")
        months = F.transform(F.sequence(F.trunc("obs_date", "MM"), F.trunc("d1", "MM"), F.expr("interval 1 month")), monday)
        v = p.withColumn("d1", p.agg(F.max("obs_date")).scalar()).select(
            "series_id", "obs_date", "idx_a", "d1",
            F.explode(F.filter(months, lambda r: (r >= F.col("obs_date")) & (r <= F.col("d1")))).alias("vintage_date"))
        m1 = monday(F.trunc("d1", "MM"))
        last_r = F.when(m1 <= F.col("d1"), m1).otherwise(monday(F.add_months(F.trunc("d1", "MM"), -1)))
        return v.select("series_id", "vintage_date", "obs_date",
                        (F.col("idx_a") * (1 + 0.0001 * F.floor(F.datediff(last_r, "vintage_date") / 7))).alias("value"))
    return fx.remember(spark, sf_dir, "vintages", build)


part("rel", f"""SELECT r FROM (SELECT CAST(min(day) AS DATE) AS r FROM (SELECT unnest(generate_series(date_trunc('month', d0), d1 + 40, INTERVAL 1 DAY)) AS day FROM {SPAN})
WHERE isodow(day) = 1 GROUP BY date_trunc('month', day)), {SPAN} WHERE r <= d1""")
part("vint", """SELECT n.series_id, r AS vintage_date, n.obs_date, n.idx_a * (1 + 0.0001 * (date_diff('day', r, (SELECT max(r) FROM rel)) // 7)) AS value
FROM num n JOIN rel ON n.obs_date <= r""", "num", "rel")
part("vcur", "SELECT series_id, obs_date, arg_max(value, vintage_date) AS current FROM vint GROUP BY ALL", "vint")


@query("vintage_meta", with_parts(f"""WITH p AS (SELECT v.series_id, v.vintage_date, max(v.obs_date) AS last_obs, count(*) AS n_rows, avg(abs(v.value - c.current) / c.current) AS m
FROM vint v JOIN vcur c USING (series_id, obs_date) GROUP BY ALL),
q AS (SELECT *, lag(last_obs) OVER w AS prev_last, lag(vintage_date) OVER w AS prev_v FROM p WINDOW w AS (PARTITION BY series_id ORDER BY vintage_date))
SELECT series_id, CAST(vintage_date AS VARCHAR) AS vintage_date, CAST(last_obs AS VARCHAR) AS last_obs, n_rows, {rd('m', 8)} AS mean_abs_rel_diff,
CAST(date_diff('day', prev_v, vintage_date) AS INT) AS days_since_prev, CAST(date_diff('day', last_obs, vintage_date) AS INT) AS lag_days,
CASE WHEN prev_last IS NOT NULL THEN (SELECT count(*) FROM vint v WHERE v.series_id = q.series_id AND v.vintage_date = q.vintage_date AND v.obs_date > q.prev_last) END AS n_new_obs FROM q""", "vint", "vcur"))
def vintage_meta(spark, sf_dir):
    return rounded(vt.vintage_meta(vintages(spark, sf_dir)), 8)


part("frel", """SELECT series_id, obs_date, min(vintage_date) AS vintage_date, arg_min(value, vintage_date) AS first_value, arg_max(value, vintage_date) AS current,
date_diff('day', obs_date, min(vintage_date)) AS lag_days, dayname(obs_date) AS weekday FROM vint v
WHERE obs_date >= (SELECT min(vintage_date) FROM vint x WHERE x.series_id = v.series_id) GROUP BY series_id, obs_date""", "vint")


def first(spark, sf_dir):
    return fx.remember(spark, sf_dir, "first_release", lambda: vt.first_release(vintages(spark, sf_dir)))


@query("first_release", with_parts(f"""SELECT series_id, CAST(obs_date AS VARCHAR) AS obs_date, CAST(vintage_date AS VARCHAR) AS vintage_date, {rd('first_value', 3)} AS first_value,
{rd('current + 0.0000314159265', 3)} AS current, CAST(lag_days AS INT) AS lag_days, weekday, {rd('current - first_value + 0.0000314159265', 4)} AS revision FROM frel""", "frel"))
def first_release(spark, sf_dir):
    out = first(spark, sf_dir).withColumns({c: F.col(c) + 0.0000314159265 for c in ("current", "revision")})
    return rounded(out, 3, revision=4)


@query("revision_summary", with_parts(f"""WITH x AS (SELECT *, (current - first_value) / current AS r FROM frel)
SELECT series_id, weekday, count(*) AS n, {rd('avg(r)', 8)} AS mean, {rd('median(r)', 8)} AS median, {rd('avg(abs(r))', 8)} AS mean_abs, {rd('median(abs(r))', 8)} AS median_abs,
{rd('max(abs(r))', 8)} AS max_abs, CAST(min(lag_days) AS INT) AS lag_min, median(lag_days) AS lag_median, CAST(max(lag_days) AS INT) AS lag_max FROM x GROUP BY ALL""", "frel"))
def revision_summary(spark, sf_dir):
    return rounded(vt.revision_summary(first(spark, sf_dir), "series_id", "weekday"), 8, "mean", "median", "mean_abs", "median_abs", "max_abs")


@query("release_exceptions", with_parts("""SELECT series_id, CASE WHEN lag_days > 30 THEN 'late' WHEN isodow(vintage_date) != 1 THEN 'extra' ELSE 'usual' END AS kind, count(*) AS n FROM frel GROUP BY ALL""", "frel"))
def release_exceptions(spark, sf_dir):
    return vt.release_exceptions(first(spark, sf_dir), 0, 30).groupBy("series_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("publication_calendar", with_parts(f"""WITH fed AS (SELECT c.day, isodow(c.day) < 6 AND h.day IS NULL AS ok FROM cal_wide c LEFT JOIN hol h ON h.kind = 'federal' AND h.day = c.day),
fr AS (SELECT obs_date, min(vintage_date) AS v FROM frel GROUP BY 1),
p AS (SELECT c.day, CASE WHEN c.day >= DATE '{CUTOFF}' THEN fr.v ELSE (SELECT min(f.day) FROM fed f WHERE f.ok AND f.day >= c.day + CAST((8 - isodow(c.day)) % 7 AS INT)) END AS pd,
 CASE WHEN c.day >= DATE '{CUTOFF}' THEN 'empirical' ELSE 'rule' END AS source FROM cal c LEFT JOIN fr ON fr.obs_date = c.day)
SELECT CAST(a.day AS VARCHAR) AS day, CAST((SELECT min(b.pd) FROM p b WHERE b.day >= a.day) AS VARCHAR) AS publication_date, source FROM p a""", "cal", "cal_wide", "hol", "frel"))
def publication_calendar(spark, sf_dir):
    fr = first(spark, sf_dir).groupBy("obs_date").agg(F.min("vintage_date").alias("vintage_date"))
    full = cal.publication_calendar(wide_calendar(spark, sf_dir), holidays(spark, sf_dir), fr, CUTOFF)
    return cal.within(full, span(spark, sf_dir))
