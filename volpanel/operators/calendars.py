"""Calendar dimension, rule-made holidays, gaps between observations, contract expiries.

Calendars are small by construction (one row per day of the sample), so windows
over a whole calendar are safe; panel rows meet them by equality on the day.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volpanel.operators.panel import add_chunks, chunk_window, core_rows

# One-off closures and bank holiday moves.
EXCHANGE_CLOSURES = ("2012-10-29", "2012-10-30", "2018-12-05", "2025-01-09")
ENGLAND_EXTRA = ("2011-04-29", "2012-06-05", "2022-06-03", "2022-09-19", "2023-05-08")
EARLY_MAY_MOVED = {2020: "2020-05-08"}
SPRING_MOVED = {2012: "2012-06-04", 2022: "2022-06-02"}
JUNETEENTH_EXCHANGE, JUNETEENTH_FEDERAL = 2022, 2021


def calendar(span: DataFrame) -> DataFrame:
    """One row per day of ``span`` (one row: first_day, last_day)."""
    return (span.select(F.explode(F.sequence("first_day", "last_day")).alias("day"))
            .withColumns({"weekday": F.weekday("day").cast("int"), "is_weekday": F.weekday("day") < 5}))


def within(df: DataFrame, span: DataFrame, day: str = "day") -> DataFrame:
    """Rows inside a one-row span, by scalar subqueries."""
    return df.filter(F.col(day).between(span.select("first_day").scalar(), span.select("last_day").scalar()))


def span_of(df: DataFrame, day: str = "obs_date", back: int = 0, ahead: int = 0) -> DataFrame:
    return df.agg(F.date_sub(F.min(day), back).alias("first_day"), F.date_add(F.max(day), ahead).alias("last_day"))


def _ymd(y: Column, m: int, d: int) -> Column:
    return F.make_date(y, F.lit(m), F.lit(d))


def easter(y: Column) -> Column:
    """Easter Sunday of the Gregorian calendar, in integer arithmetic."""
    def div(a, n):
        return F.floor(a / n).cast("int")
    a, b, c = y % 19, div(y, 100), y % 100
    h = (19 * a + b - div(b, 4) - div(b - div(b + 8, 25) + 1, 3) + 15) % 30
    ell = (32 + 2 * (b % 4) + 2 * div(c, 4) - h - c % 4) % 7
    m = div(a + 11 * h + 22 * ell, 451)
    n = h + ell - 7 * m + 114
    return F.make_date(y, div(n, 31), (n % 31 + 1).cast("int"))


def _nth(y: Column, month: int, day: str, n: int) -> Column:
    """n-th given weekday of a month."""
    return F.date_add(F.next_day(F.date_sub(_ymd(y, month, 1), 1), day), 7 * (n - 1))


def _last_monday(y: Column, month: int) -> Column:
    return F.date_sub(F.next_day(F.last_day(_ymd(y, month, 1)), "Mon"), 7)


def _nearest(d: Column) -> Column:
    return F.when(F.weekday(d) == 5, F.date_sub(d, 1)).when(F.weekday(d) == 6, F.date_add(d, 1)).otherwise(d)


def _forward(d: Column) -> Column:
    return F.when(F.weekday(d) == 5, F.date_add(d, 2)).when(F.weekday(d) == 6, F.date_add(d, 1)).otherwise(d)


def _moved(y: Column, moved: dict, otherwise: Column) -> Column:
    for year, day in moved.items():
        otherwise = F.when(y == year, F.lit(day).cast("date")).otherwise(otherwise)
    return otherwise


def holidays(years: DataFrame) -> DataFrame:
    """Holidays of three calendars (``exchange``, ``england``, ``federal``) for each ``y`` of ``years``."""
    y = F.col("y")
    new_year, june = _ymd(y, 1, 1), _ymd(y, 6, 19)
    good_friday = F.date_sub(easter(y), 2)
    us = [_nth(y, 1, "Mon", 3), _nth(y, 2, "Mon", 3), _last_monday(y, 5), _nearest(_ymd(y, 7, 4)),
          _nth(y, 9, "Mon", 1), _nth(y, 11, "Thu", 4), _nearest(_ymd(y, 12, 25))]
    xmas, boxing = _ymd(y, 12, 25), _ymd(y, 12, 26)
    wd = F.weekday(xmas)
    lists = {
        "exchange": us + [F.when(F.weekday(new_year) == 6, F.date_add(new_year, 1)).otherwise(new_year), good_friday,
                          F.when(y >= JUNETEENTH_EXCHANGE, _nearest(june))],
        "federal": us + [_nearest(new_year), F.when(y >= JUNETEENTH_FEDERAL, _nearest(june)),
                         _nth(y, 10, "Mon", 2), _nearest(_ymd(y, 11, 11))],
        "england": [_forward(new_year), good_friday, F.date_add(good_friday, 3),
                    _moved(y, EARLY_MAY_MOVED, _nth(y, 5, "Mon", 1)), _moved(y, SPRING_MOVED, _last_monday(y, 5)),
                    _last_monday(y, 8), F.when(wd.isin(5, 6), F.date_add(xmas, 2)).otherwise(xmas),
                    F.when(wd.isin(4, 5), F.date_add(boxing, 2)).otherwise(boxing)],
    }
    extra = {"exchange": EXCHANGE_CLOSURES, "england": ENGLAND_EXTRA, "federal": ()}
    rows = [F.struct(F.lit(kind).alias("kind"), F.concat(
        F.array_compact(F.array(*days)),
        F.filter(F.array(*[F.lit(d).cast("date") for d in extra[kind]]).cast("array<date>"), lambda d: F.year(d) == y)
    ).alias("days")) for kind, days in lists.items()]
    return (years.select(y, F.inline(F.array(*rows))).select("kind", F.explode("days").alias("day")).distinct())


def years_of(span: DataFrame, margin: int = 1) -> DataFrame:
    return span.select(F.explode(F.sequence(F.year("first_day") - margin, F.year("last_day") + margin)).alias("y"))


def business_days(cal: DataFrame, hol: DataFrame, kind: str) -> DataFrame:
    """Calendar with ``is_bd``, ``next_bd`` (first on or after) and ``prev_bd`` (last before)."""
    h = hol.filter(F.col("kind") == kind).select("day", F.lit(True).alias("_h"))
    c = cal.join(h, "day", "left").withColumn("is_bd", F.col("is_weekday") & F.col("_h").isNull()).drop("_h")
    bd = F.when(F.col("is_bd"), F.col("day"))
    return c.withColumns({  # however long a closure lasts
        "next_bd": F.min(bd).over(Window.orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, 0)),
        "prev_bd": F.max(bd).over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1))})


def publication_calendar(cal: DataFrame, hol: DataFrame, first_release: DataFrame, cutoff: str) -> DataFrame:
    """Day on which an observation became public.

    Before the cutoff by rule: the Monday on or after, rolled past federal
    holidays; from it on the first release that contains the day. Later days
    cannot be public earlier, so the smallest later date wins.
    """
    bd = business_days(cal, hol, "federal").select(F.col("day").alias("_m"), F.col("next_bd").alias("_rule"))
    c = (cal.select("day", F.next_day(F.date_sub("day", 1), "Mon").alias("_m")).join(bd, "_m", "left")
         .join(first_release.select(F.col("obs_date").alias("day"), F.col("vintage_date").alias("_emp")), "day", "left"))
    late = F.col("day") >= F.lit(cutoff).cast("date")
    c = c.withColumns({"source": F.when(late, "empirical").otherwise("rule"),
                       "_p": F.when(late, F.col("_emp")).otherwise(F.col("_rule"))})
    w = Window.orderBy("day").rowsBetween(0, Window.unboundedFollowing)
    return c.select("day", F.min("_p").over(w).alias("publication_date"), "source")


def with_previous(numbered: DataFrame, keys=("series_id",)) -> DataFrame:
    w = chunk_window(keys)
    return core_rows(add_chunks(numbered, back=1).withColumn("prev_date", F.lag("obs_date", 1).over(w)))


def classify_gaps(numbered: DataFrame, hol: DataFrame, keys=("series_id",)) -> DataFrame:
    """One row per return: missing weekdays since the row before, by what explains them."""
    keys = list(keys)
    pairs = (with_previous(numbered, keys).filter(F.col("prev_date").isNotNull())
             .select(*keys, "row_no", "prev_date", "obs_date", "year",
                     F.datediff("obs_date", "prev_date").alias("calendar_gap_days")))
    missing = (pairs.filter("calendar_gap_days > 1").select(*keys, "row_no", F.explode(F.sequence(
        F.date_add("prev_date", 1), F.date_sub("obs_date", 1))).alias("day")).filter(F.weekday("day") < 5))
    kinds = hol.filter(F.col("kind").isin("exchange", "england")).groupBy("day").agg(
        F.max(F.col("kind") == "exchange").alias("ex"), F.max(F.col("kind") == "england").alias("en"))
    j = missing.join(kinds, "day", "left").withColumns({
        "ex": F.coalesce("ex", F.lit(False)), "en": F.coalesce("en", F.lit(False))})
    open_day = ~F.col("ex") & ~F.col("en")
    n = j.groupBy(*keys, "row_no").agg(
        F.count(F.lit(1)).alias("n_missing_weekdays"), F.count_if("ex").alias("n_exchange_holidays"),
        F.count_if(~F.col("ex") & F.col("en")).alias("n_other_holidays"), F.count_if(open_day).alias("n_unexplained"),
        F.array_join(F.sort_array(F.collect_list(F.when(open_day, F.col("day").cast("string")))), ";").alias("unexplained_dates"))
    counts = ["n_missing_weekdays", "n_exchange_holidays", "n_other_holidays", "n_unexplained"]
    return (pairs.join(n, [*keys, "row_no"], "left").na.fill(0, counts).na.fill("", ["unexplained_dates"])
            .withColumns({"real_gap": (F.col("n_unexplained") > 0).cast("int"),
                          "category": F.when(F.col("n_unexplained") > 0, "unexplained")
                          .when(F.col("n_other_holidays") > 0, "other_holiday")
                          .when(F.col("n_missing_weekdays") > 0, "exchange_holiday").otherwise("none")}))


def gap_distribution(gaps: DataFrame, keys=("series_id",)) -> DataFrame:
    g = F.col("calendar_gap_days")
    b = gaps.withColumn("bucket", F.when(g <= 1, "1").when(g <= 3, "2-3").otherwise(">=4"))
    n = b.groupBy(*keys, "bucket", "calendar_gap_days").agg(F.count(F.lit(1)).alias("n_rows"))
    return n.withColumn("pct_of_returns", 100.0 * F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy(*keys)))


def gaps_by_year(gaps: DataFrame, keys=("series_id",)) -> DataFrame:
    return gaps.groupBy(*keys, "year").agg(
        F.count(F.lit(1)).alias("n_returns"), F.sum("real_gap").alias("n_real_gaps"),
        F.sum("n_unexplained").alias("n_skipped_days"), F.count_if(F.col("calendar_gap_days") >= 4).alias("n_gap_ge4"))


def window_hits(flagged: DataFrame, flag: str, horizons, keys=("series_id",)) -> DataFrame:
    """Per row and horizon: is any flag set in rows t+1..t+h (``valid`` if all are there)."""
    w = chunk_window(keys)
    df = add_chunks(flagged, back=0, ahead=max(horizons))
    df = df.withColumns({
        **{f"_h{h}": F.max(flag).over(w.rowsBetween(1, h)) for h in horizons},
        **{f"_n{h}": F.count(flag).over(w.rowsBetween(1, h)) for h in horizons}})
    return core_rows(df).select(*keys, "row_no", "obs_date", "year", F.inline(F.array(*[
        F.struct(F.lit(int(h)).alias("horizon"), (F.col(f"_n{h}") == h).alias("valid"),
                 ((F.col(f"_n{h}") == h) & (F.col(f"_h{h}") > 0)).alias("hit")) for h in horizons])))


def window_exposure(hits: DataFrame, first_test_year: int, partial_year: int, late_from: int,
                    long_from: int, keys=("series_id",)) -> DataFrame:
    test = F.col("valid") & (F.col("year") >= first_test_year) & ~(
        (F.col("year") == partial_year) & (F.col("horizon") >= long_from))
    hit = F.col("hit")
    return hits.groupBy(*keys, "horizon").agg(
        F.count_if("valid").alias("n_valid"), F.count_if(hit).alias("n_affected"),
        (100.0 * F.try_divide(F.count_if(hit), F.count_if("valid"))).alias("pct_affected"),
        F.count_if(test).alias("n_test"), F.count_if(test & hit).alias("n_affected_test"),
        (100.0 * F.try_divide(F.count_if(test & hit), F.count_if(test))).alias("pct_affected_test"),
        F.count_if(hit & (F.col("year") >= late_from)).alias("n_affected_late"))


def calendar_conflicts(days: DataFrame, hol: DataFrame, span: DataFrame) -> DataFrame:
    """Exchange holidays that occur in the data, and other-calendar holidays by presence."""
    d = days.select(F.col("obs_date").alias("day")).distinct().withColumn("_in", F.lit(1))
    k = hol.filter(F.col("kind") != "federal").groupBy("day").agg(
        F.max((F.col("kind") == "exchange").cast("int")).alias("ex"))
    return (within(k, span).join(d, "day", "left").filter(F.weekday("day") < 5)
            .select("day", F.when(F.col("ex") == 1, "exchange").otherwise("england_only").alias("calendar"),
                    F.coalesce("_in", F.lit(0)).alias("in_data")))


def contract_expiry(months: DataFrame, bd: DataFrame, regime_from: str) -> DataFrame:
    """Last trading day of each contract month (``contract`` = its first day).

    Before ``regime_from``: the business day before the 15th day ahead of the
    month (moved to a business day first). From it on: the last business day of
    the second month ahead, one earlier if that is the last before Christmas or
    New Year.
    """
    prev = bd.select("day", "is_bd", "prev_bd")

    def look(df, on, out):
        p = prev.select(F.col("day").alias(on), F.col("prev_bd").alias(out), F.col("is_bd").alias(f"{out}_is"))
        return df.join(p, on, "left")

    m = months.withColumns({"_d15": F.date_sub("contract", 15), "_first": F.add_months("contract", -1)})
    m = look(m, "_d15", "_p15")
    m = m.withColumn("_start", F.when(F.col("_p15_is"), F.col("_d15")).otherwise(F.col("_p15")))
    m = look(m, "_start", "_old")
    m = look(m, "_first", "_last")
    m = m.withColumns({"_xmas": F.make_date(F.year("_last"), F.lit(12), F.lit(25)),
                       "_nyd": F.make_date(F.year("_last") + 1, F.lit(1), F.lit(1))})
    m = look(look(look(m, "_xmas", "_bx"), "_nyd", "_bn"), "_last", "_earlier")
    new = F.when((F.col("_last") == F.col("_bx")) | (F.col("_last") == F.col("_bn")), F.col("_earlier")).otherwise(F.col("_last"))
    old = F.col("contract") < F.lit(regime_from).cast("date")
    return m.select("contract", F.when(old, F.col("_old")).otherwise(new).alias("expiry"),
                    F.when(old, "fifteen_days").otherwise("month_ahead").alias("rule"))


def months_of(span: DataFrame) -> DataFrame:
    return span.select(F.explode(F.sequence(
        F.trunc("first_day", "MM"), F.add_months(F.trunc("last_day", "MM"), 2), F.expr("interval 1 month"))).alias("contract"))


def roll_rows(numbered: DataFrame, expiries: DataFrame, keys=("series_id",)) -> DataFrame:
    """First row of each series strictly after each expiry.

    The days from the previous row's date to the day before this row's belong to
    this row, so the forward search is an equality join on the day.
    """
    rows = with_previous(numbered, keys).filter(F.col("prev_date").isNotNull())
    days = rows.select(*keys, F.col("row_no").alias("roll_row"), F.col("obs_date").alias("roll_date"), "prev_date",
                       F.explode(F.sequence("prev_date", F.date_sub("obs_date", 1))).alias("expiry"))
    return days.join(expiries, "expiry").withColumn(
        "expiry_in_data", (F.col("expiry") == F.col("prev_date")).cast("int")).drop("prev_date")
