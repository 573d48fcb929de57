"""Registered retail queries and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.operators import dashboards as D
from quillmill.operators import features as X
from quillmill.operators import relational as R
from quillmill.operators.modelling import FEATURES
from quillmill.plans.analogues import Retail, retail_sql
from quillmill.sources.staging import staged

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *more: str, dates: str = ""):
    """Register a query; dates leave as ISO text, which both engines write alike."""

    def register(f):
        QUERIES[name] = lambda spark, sf_dir: plain(f(Retail(spark, sf_dir)))
        if sql:
            text = ", ".join(f"CAST({d} AS VARCHAR) AS {d}" for d in dates.split())
            ORACLE_SQL[name] = retail_sql(f"SELECT * REPLACE ({text}) FROM ({sql})" if dates else sql, *more)
        return f

    return register


def plain(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(c).cast("string").alias(c) if t == "date" else F.col(c) for c, t in df.dtypes))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def profile(t: Retail) -> DataFrame:
    return R.store_profile(t.stores, t.types, t.levels, t.states, t.competition)


def settled(df: DataFrame, digits: int = 6) -> DataFrame:
    """Rounded after the last digits of sums, which depend on their order, have been rounded away."""
    return df.select(*(F.round(F.round(c, digits + 3), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def fact(t: Retail, *needed: str) -> DataFrame:
    """The fact table, or the ``needed`` columns of it: what is not needed is not computed. ``promo`` is told by the narrow base rows."""
    sales, requests = (X.promo_flag(d, t.promo_days) if "promo" in needed else d for d in (t.sales, t.requests))
    days = R.enrich_state_days(t.weather, t.macro, t.trends, t.events)
    if needed:
        days = days.select(*(c for c in days.columns if c in ("state", "date", *needed)))
    out = R.build_fact(sales, requests, profile(t), days, t.states)
    return out.select(*needed) if needed else out


def staged_fact(t: Retail, *needed: str) -> DataFrame:
    """The fact table, written once for what reads it several times."""
    return staged(fact(t, *needed), "fact")


#: What the features are made of.
SOURCES = ["store_id", "date", "sales", "is_open", "is_train", "promo", "type_code", "level_code", "state", "distance_meters", "open_since_month", "open_since_year", *X.WEATHER]
SOURCES += ["weather_event", "gdp_index", "unemployment_rate", "consumer_confidence_index", "trend_index", "has_local_event"]


def feature_table(t: Retail) -> DataFrame:
    return X.build_features(fact(t, *SOURCES), None, t.promo)


@query("retail_store_profile", "SELECT * FROM profile")
def store_profile(t):
    return profile(t)


@query(
    "retail_state_days",
    "SELECT state, date, round(temperature_avg, 6) AS temperature_avg, weather_event, round(gdp_index, 6) AS gdp_index, unemployment_rate, trend_index, has_local_event FROM state_days", dates="date")
def state_days(t):
    out = R.enrich_state_days(t.weather, t.macro, t.trends, t.events)
    return rounded(out.select("state", "date", "temperature_avg", "weather_event", "gdp_index", "unemployment_rate", "trend_index", "has_local_event"))


@query(
    "retail_fact",
    "SELECT store_id, date, sales, is_open, is_train, type_code, state, distance_meters, round(temperature_avg, 6) AS temperature_avg, trend_index, weather_event, has_local_event FROM fact", dates="date")
def fact_table(t):
    columns = ["store_id", "date", "sales", "is_open", "is_train", "type_code", "state", "distance_meters", "temperature_avg", "trend_index", "weather_event", "has_local_event"]
    return fact(t).select(*columns).withColumn("temperature_avg", F.round("temperature_avg", 6))


@query(
    "retail_promo_uplift",
    """SELECT store_id, n_name AS nation, round(w, 6) AS with_promo, round(o, 6) AS without_promo,
       round(CASE WHEN o > 0 THEN (w - o) / o * 100 ELSE 0 END, 6) AS uplift_pct FROM (
         SELECT store_id, avg(sales) FILTER (p.store_id_ IS NOT NULL) AS w, avg(sales) FILTER (p.store_id_ IS NULL) AS o
         FROM sales s LEFT JOIN (SELECT DISTINCT store_id AS store_id_, date AS date_ FROM promo_days) p ON store_id = store_id_ AND date = date_
         WHERE is_open = 1 GROUP BY store_id) JOIN (SELECT store_id, state AS n_name FROM states) USING (store_id)
       WHERE w IS NOT NULL AND o IS NOT NULL""",
)
def uplift(t):
    """The flagship: daily sales with promotion flags, uplift per store with its nation."""
    days = X.promo_flag(t.sales.withColumn("is_train", F.lit(1)), t.promo_days)
    return rounded(D.promo_uplift(days).join(t.states.withColumnRenamed("state", "nation"), "store_id"))


@query(
    "retail_calendar",
    """SELECT store_id, date, isodow(date) - 1 AS day_of_week, month(date) AS month, year(date) AS year, day(date) AS day_of_month, week(date) AS week_of_year,
       dayofyear(date) AS day_of_year, CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS is_weekend,
       CASE WHEN open_since_year IS NOT NULL THEN greatest((year(date) - open_since_year) * 12 + month(date) - open_since_month, 0) END AS competition_open_months,
       round(sin(2 * pi() * (isodow(date) - 1) / 7), 6) AS dow_sin, round(cos(2 * pi() * (isodow(date) - 1) / 7), 6) AS dow_cos,
       round(sin(2 * pi() * month(date) / 12), 6) AS month_sin, round(cos(2 * pi() * month(date) / 12), 6) AS month_cos,
       round(sin(2 * pi() * week(date) / 52), 6) AS woy_sin, round(cos(2 * pi() * week(date) / 52), 6) AS woy_cos
       FROM base JOIN profile USING (store_id)""", dates="date")
def calendar(t):
    rows = R.tag_and_union(t.sales, t.requests).join(profile(t), "store_id")
    out = X.calendar_features(rows)
    names = ["day_of_week", "month", "year", "day_of_month", "week_of_year", "day_of_year", "is_weekend", "competition_open_months", "dow_sin", "dow_cos", "month_sin", "month_cos", "woy_sin", "woy_cos"]
    return rounded(out.select("store_id", "date", *names), 6)


_MEDIANS = """
med AS (SELECT f.store_id, f.date, {}
  FROM fact f LEFT JOIN (SELECT state, month(date) AS m, {} FROM fact GROUP BY ALL) a ON f.state = a.state AND month(f.date) = a.m
  LEFT JOIN (SELECT month(date) AS m, {} FROM fact GROUP BY ALL) b ON month(f.date) = b.m, (SELECT {} FROM fact) c)""".format(
    ", ".join(f"round(coalesce(f.{c}, a.{c}, b.{c}, c.{c}), 6) AS {c}" for c in X.WEATHER), *[", ".join(f"median({c}) AS {c}" for c in X.WEATHER)] * 3
)


@query("retail_impute_median", "SELECT * FROM med", _MEDIANS, dates="date")
def impute_median(t):
    keyed = staged_fact(t).withColumn("m", F.month("date"))
    out = X.impute_group_median(keyed, X.WEATHER, [["state", "m"], ["m"], []])
    return rounded(out.select("store_id", "date", *X.WEATHER))


@query(
    "retail_impute_ffill",
    """SELECT store_id, date, round(coalesce(f, b), 6) AS gdp_index FROM (SELECT store_id, date,
       last_value(gdp_index IGNORE NULLS) OVER (ORDER BY date, store_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f,
       first_value(gdp_index IGNORE NULLS) OVER (ORDER BY date, store_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM fact)""", dates="date")
def impute_ffill(t):
    return rounded(X.impute_ffill(staged(fact(t).select("store_id", "date", "gdp_index"), "gdp"), ["gdp_index"]))


@query(
    "retail_impute_rates",
    """SELECT f.store_id, f.date, round(coalesce(abs(f.unemployment_rate), a.u, c.u), 6) AS unemployment_rate, round(coalesce(f.trend_index, b.t, c.t), 6) AS trend_index
       FROM fact f LEFT JOIN (SELECT state, year(date) AS y, median(abs(unemployment_rate)) AS u FROM fact GROUP BY ALL) a ON f.state = a.state AND year(f.date) = a.y
       LEFT JOIN (SELECT state, month(date) AS m, median(trend_index) AS t FROM fact GROUP BY ALL) b ON f.state = b.state AND month(f.date) = b.m,
       (SELECT median(abs(unemployment_rate)) AS u, median(trend_index) AS t FROM fact) c""", dates="date")
def impute_rates(t):
    x = staged_fact(t, "store_id", "date", "state", "unemployment_rate", "trend_index")
    x = x.withColumns({"unemployment_rate": F.abs("unemployment_rate"), "y": F.year("date"), "m": F.month("date")})
    x = X.impute_medians(x, {"unemployment_rate": [["state", "y"], []], "trend_index": [["state", "m"], []]})
    return rounded(x.select("store_id", "date", "unemployment_rate", "trend_index"))


@query(
    "retail_null_audit",
    "SELECT \"column\", nulls FROM (SELECT unnest(['sales', 'distance_meters', 'temperature_avg', 'trend_index', 'gdp_index', 'state']) AS \"column\", unnest([count(*) - count(sales), count(*) - count(distance_meters), count(*) - count(temperature_avg), count(*) - count(trend_index), count(*) - count(gdp_index), count(*) - count(state)]) AS nulls FROM fact) WHERE nulls > 0",
)
def null_audit(t):
    return X.null_audit(fact(t).select("sales", "distance_meters", "temperature_avg", "trend_index", "gdp_index", "state"))


@query(
    "retail_label_encoding",
    """SELECT store_id, date, dense_rank() OVER (ORDER BY coalesce(type_code, 'None')) - 1 AS type_code_enc, dense_rank() OVER (ORDER BY coalesce(level_code, 'None')) - 1 AS level_code_enc,
       dense_rank() OVER (ORDER BY coalesce(state, 'None')) - 1 AS state_enc, dense_rank() OVER (ORDER BY weather_event) - 1 AS weather_event_enc FROM fact""", dates="date")
def label_encoding(t):
    return X.label_encode(staged_fact(t, "store_id", "date", *X.CATEGORICALS), X.CATEGORICALS).select("store_id", "date", *(f"{c}_enc" for c in X.CATEGORICALS))


_TARGET = """
tr AS (SELECT *, isodow(date) - 1 AS dow, month(date) AS mon FROM fact WHERE is_train = 1),
tj AS (SELECT f.store_id, f.date, a, m, d, s FROM fact f LEFT JOIN (SELECT store_id, avg(sales) AS a, median(sales) AS m FROM tr GROUP BY 1) USING (store_id)
  LEFT JOIN (SELECT store_id, dow, avg(sales) AS d FROM tr GROUP BY ALL) x ON f.store_id = x.store_id AND isodow(f.date) - 1 = x.dow
  LEFT JOIN (SELECT state, mon, avg(sales) AS s FROM tr GROUP BY ALL) y ON f.state = y.state AND month(f.date) = y.mon)"""


@query(
    "retail_target_encoding",
    """SELECT store_id, date, round(round(coalesce(a, (SELECT median(a) FROM tj)), 9), 6) AS store_avg_sales, round(round(coalesce(m, (SELECT median(m) FROM tj)), 9), 6) AS store_med_sales,
       round(round(coalesce(d, (SELECT median(d) FROM tj)), 9), 6) AS store_dow_avg, round(round(coalesce(s, (SELECT median(s) FROM tj)), 9), 6) AS state_month_avg FROM tj""",
    _TARGET, dates="date")
def target_encoding(t):
    x = staged_fact(t).withColumns({"day_of_week": F.weekday("date"), "month": F.month("date")})
    return settled(X.target_encode(x).select("store_id", "date", "store_avg_sales", "store_med_sales", "store_dow_avg", "state_month_avg"))


@query(
    "retail_interactions",
    """SELECT store_id, date, round(distance_meters * t, 6) AS distance_x_type, CAST(t * 10 + l AS DOUBLE) AS store_type_assort FROM (
       SELECT *, dense_rank() OVER (ORDER BY coalesce(type_code, 'None')) - 1 AS t, dense_rank() OVER (ORDER BY coalesce(level_code, 'None')) - 1 AS l FROM fact)""", dates="date")
def interactions(t):
    x = X.label_encode(staged_fact(t, "store_id", "date", "type_code", "level_code", "distance_meters"), ["type_code", "level_code"])
    return rounded(X.interactions(x).select("store_id", "date", "distance_x_type", "store_type_assort"))


@query(
    "retail_promotions",
    """SELECT b.store_id, b.date, CASE WHEN d.store_id IS NOT NULL THEN 1 ELSE 0 END AS promo, CASE WHEN since_year IS NOT NULL THEN 1 ELSE 0 END AS has_promo2,
       CASE WHEN contains(active_months, strftime(b.date, '%b')) AND b.date >= make_date(since_year, 1, 1) + CAST(since_week * 7 AS INTEGER) THEN 1 ELSE 0 END AS promo2_active
       FROM base b LEFT JOIN (SELECT DISTINCT store_id, date FROM promo_days) d ON b.store_id = d.store_id AND b.date = d.date LEFT JOIN promo p ON b.store_id = p.store_id""", dates="date")
def promotions(t):
    rows = R.tag_and_union(t.sales, t.requests)
    return X.continuous_promo(X.promo_flag(rows, t.promo_days), t.promo).select("store_id", "date", "promo", "has_promo2", "promo2_active")


@query("retail_drop_zero_sales", "SELECT store_id, date, sales, is_open, is_train FROM base WHERE NOT coalesce(is_open = 1 AND sales = 0 AND is_train = 1, false)", dates="date")
def drop_zero(t):
    return R.drop_open_zero_sales(R.tag_and_union(t.sales, t.requests)).select("store_id", "date", "sales", "is_open", "is_train")


_ALL_FEATURES = """
f0 AS (SELECT * REPLACE (abs(unemployment_rate) AS unemployment_rate), month(date) AS mm, year(date) AS yy, isodow(date) - 1 AS dow FROM fact),
sm AS (SELECT state, mm, median(trend_index) AS ti, {medians} FROM f0 GROUP BY state, mm), om AS (SELECT mm, {medians} FROM f0 GROUP BY mm), sy AS (SELECT state, yy, median(unemployment_rate) AS ur FROM f0 GROUP BY state, yy),
al AS (SELECT median(unemployment_rate) AS ur, median(trend_index) AS ti, median(distance_meters) AS dm, median(open_since_month) AS om, median(open_since_year) AS oy, {medians} FROM f0),
imp AS (SELECT f0.* REPLACE ({filled}, coalesce(f0.unemployment_rate, sy.ur, al.ur) AS unemployment_rate, coalesce(f0.trend_index, sm.ti, al.ti) AS trend_index, coalesce(distance_meters, dm) AS distance_meters,
    coalesce(open_since_month, al.om) AS open_since_month, coalesce(open_since_year, oy) AS open_since_year,
    coalesce(last_value(gdp_index IGNORE NULLS) OVER back, first_value(gdp_index IGNORE NULLS) OVER ahead) AS gdp_index,
    coalesce(last_value(consumer_confidence_index IGNORE NULLS) OVER back, first_value(consumer_confidence_index IGNORE NULLS) OVER ahead) AS consumer_confidence_index)
  FROM f0 LEFT JOIN sm ON f0.state = sm.state AND f0.mm = sm.mm LEFT JOIN om ON f0.mm = om.mm LEFT JOIN sy ON f0.state = sy.state AND f0.yy = sy.yy, al
  WINDOW back AS (ORDER BY date, store_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), ahead AS (ORDER BY date, store_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
coded AS (SELECT *, dense_rank() OVER (ORDER BY coalesce(type_code, 'None')) - 1 AS type_code_enc, dense_rank() OVER (ORDER BY coalesce(level_code, 'None')) - 1 AS level_code_enc,
    dense_rank() OVER (ORDER BY coalesce(state, 'None')) - 1 AS state_enc, dense_rank() OVER (ORDER BY weather_event) - 1 AS weather_event_enc FROM imp),
feat AS (SELECT c.store_id, c.date, sales, is_open, is_train, dow AS day_of_week, mm AS month, yy AS year, day(c.date) AS day_of_month, week(c.date) AS week_of_year, dayofyear(c.date) AS day_of_year, CASE WHEN dow >= 5 THEN 1 ELSE 0 END AS is_weekend,
    sin(2 * pi() * dow / 7) AS dow_sin, cos(2 * pi() * dow / 7) AS dow_cos, sin(2 * pi() * mm / 12) AS month_sin, cos(2 * pi() * mm / 12) AS month_cos, sin(2 * pi() * week(c.date) / 52) AS woy_sin, cos(2 * pi() * week(c.date) / 52) AS woy_cos,
    type_code_enc, level_code_enc, state_enc, weather_event_enc, coalesce(a, (SELECT median(a) FROM tj)) AS store_avg_sales, coalesce(m, (SELECT median(m) FROM tj)) AS store_med_sales, coalesce(d, (SELECT median(d) FROM tj)) AS store_dow_avg,
    coalesce(s, (SELECT median(s) FROM tj)) AS state_month_avg, distance_meters, open_since_month, open_since_year, greatest((yy - open_since_year) * 12 + (mm - open_since_month), 0) AS competition_open_months,
    distance_meters * type_code_enc AS distance_x_type, CAST(type_code_enc * 10 + level_code_enc AS DOUBLE) AS store_type_assort, CASE WHEN pd.store_id IS NOT NULL THEN 1 ELSE 0 END AS promo, CASE WHEN since_year IS NOT NULL THEN 1 ELSE 0 END AS has_promo2,
    CASE WHEN contains(active_months, strftime(c.date, '%b')) AND c.date >= make_date(since_year, 1, 1) + CAST(since_week * 7 AS INTEGER) THEN 1 ELSE 0 END AS promo2_active,
    {weather}, gdp_index, unemployment_rate, consumer_confidence_index, trend_index, has_local_event
  FROM coded c JOIN tj ON c.store_id = tj.store_id AND c.date = tj.date LEFT JOIN (SELECT DISTINCT store_id, date FROM promo_days) pd ON c.store_id = pd.store_id AND c.date = pd.date LEFT JOIN promo p ON c.store_id = p.store_id
  WHERE NOT coalesce(is_open = 1 AND sales = 0 AND is_train = 1, false))""".format(
    medians=", ".join(f"median({c}) AS {c}" for c in X.WEATHER), filled=", ".join(f"coalesce(f0.{c}, sm.{c}, om.{c}, al.{c}) AS {c}" for c in X.WEATHER), weather=", ".join(X.WEATHER)
)
_WHOLE = ["day_of_week", "month", "year", "day_of_month", "week_of_year", "day_of_year", "is_weekend", "type_code_enc", "level_code_enc", "state_enc", "weather_event_enc", "promo", "has_promo2", "promo2_active", "has_local_event"]


@query(
    "retail_features",
    "SELECT store_id, date, sales, is_open, is_train, " + ", ".join(c if c in _WHOLE else f"round(round({c}, 9), 6) AS {c}" for c in FEATURES) + " FROM feat",
    _TARGET, _ALL_FEATURES, dates="date")
def features(t):
    return settled(feature_table(t).select("store_id", "date", "sales", "is_open", "is_train", *FEATURES))


@query(
    "retail_holidays",
    """SELECT store_id, date, coalesce(h, '0') AS state_holiday, CASE WHEN k.state IS NOT NULL THEN 1 ELSE 0 END AS school_holiday FROM base JOIN states USING (store_id)
       LEFT JOIN (SELECT state, date, min(holiday_type) AS h FROM state_holidays GROUP BY ALL) x USING (state, date) LEFT JOIN school_holidays k USING (state, date)""", dates="date")
def holiday_flags(t):
    rows = R.tag_and_union(t.sales, t.requests).join(t.states, "store_id")
    return R.holidays(rows, t.state_holidays, t.school_holidays).select("store_id", "date", "state_holiday", "school_holiday")


_CUT = "cut AS (SELECT max(date) - 42 AS c FROM sales WHERE is_open = 1)"


@query(
    "retail_temporal_split",
    "SELECT CASE WHEN date <= c THEN 'train' ELSE 'validation' END AS part, count(*) AS n, min(date) AS first_date, max(date) AS last_date, round(sum(sales), 2) AS sales FROM sales, cut WHERE is_open = 1 GROUP BY 1",
    _CUT, dates="first_date last_date")
def split(t):
    train, valid = R.temporal_split(t.sales.withColumn("is_train", F.lit(1)))
    both = train.withColumn("part", F.lit("train")).unionByName(valid.withColumn("part", F.lit("validation")))
    return both.groupBy("part").agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.round(F.sum("sales"), 2).alias("sales"))


@query("retail_weekday_means", "SELECT store_id, isodow(date) - 1 AS day_of_week, round(avg(sales), 6) AS avg_sales FROM sales WHERE is_open = 1 GROUP BY ALL")
def weekday_means(t):
    return rounded(D.means_by(t.sales.withColumns({"is_train": F.lit(1), "day_of_week": F.weekday("date")}), ["store_id", "day_of_week"]))


@query("retail_month_means", "SELECT store_id, month(date) AS month, round(avg(sales), 6) AS avg_sales FROM sales WHERE is_open = 1 GROUP BY ALL")
def month_means(t):
    return rounded(D.means_by(t.sales.withColumns({"is_train": F.lit(1), "month": F.month("date")}), ["store_id", "month"]))


@query(
    "retail_promo_means",
    """SELECT s.store_id, CASE WHEN p.store_id IS NULL THEN 0 ELSE 1 END AS promo, round(round(avg(sales), 9), 6) AS avg_sales FROM sales s
       LEFT JOIN (SELECT DISTINCT store_id, date FROM promo_days) p ON s.store_id = p.store_id AND s.date = p.date WHERE is_open = 1 GROUP BY ALL""",
)
def promo_means(t):
    return settled(D.means_by(X.promo_flag(t.sales.withColumn("is_train", F.lit(1)), t.promo_days), ["store_id", "promo"]))


_TYPES = ["AF", "AM", "AS", "EU", "MI"]


@query(
    "retail_weekday_pivot",
    "SELECT isodow(date) - 1 AS day_of_week, " + ", ".join(f"round(avg(sales) FILTER (type_code = '{i}'), 6) AS \"{i}\"" for i in _TYPES) + " FROM sales JOIN profile USING (store_id) WHERE is_open = 1 GROUP BY 1",
)
def weekday_pivot(t):
    return rounded(D.weekday_pivot(t.sales.withColumn("is_train", F.lit(1)).join(profile(t), "store_id"), "type_code", _TYPES))


@query(
    "retail_weekly_resample",
    """SELECT CAST(w AS DATE) AS week_end, round(v, 6) AS avg_sales FROM (SELECT unnest(generate_series(min(e), max(e), INTERVAL 7 DAY)) AS w FROM (SELECT date + (7 - isodow(date))::INTEGER AS e FROM sales))
       LEFT JOIN (SELECT date + (7 - isodow(date))::INTEGER AS e, avg(sales) AS v FROM sales GROUP BY 1) ON CAST(w AS DATE) = e""", dates="week_end")
def weekly(t):
    return rounded(D.weekly_resample(t.sales))


@query("retail_summary", "SELECT round(avg(sales), 6) AS mean, round(median(sales), 6) AS median, max(sales) AS max, min(sales) AS min, round(sum(sales), 2) AS sum, count(sales) AS count FROM sales")
def summary(t):
    out = rounded(D.summary(staged(t.sales, "sales"), "sales"))
    return out.withColumn("sum", F.round("sum", 2))


@query(
    "retail_grouped_mode",
    "SELECT store_id, customers AS customers_mode FROM (SELECT store_id, customers, row_number() OVER (PARTITION BY store_id ORDER BY count(*) DESC, customers) AS k FROM sales GROUP BY store_id, customers) WHERE k = 1",
)
def grouped_mode(t):
    return D.grouped_mode(t.sales, ["store_id"], "customers")


@query(
    "retail_column_profile",
    """SELECT c AS "column", CASE c WHEN 'store_id' THEN 'bigint' ELSE 'double' END AS type, nulls, round(100.0 * nulls / n, 6) AS null_pct, neg AS negatives FROM (SELECT unnest(['store_id', 'distance_meters', 'open_since_month', 'open_since_year']) AS c,
       unnest([count(*) - count(store_id), count(*) - count(distance_meters), count(*) - count(open_since_month), count(*) - count(open_since_year)]) AS nulls,
       unnest([count(*) FILTER (store_id < 0), count(*) FILTER (distance_meters < 0), count(*) FILTER (open_since_month < 0), count(*) FILTER (open_since_year < 0)]) AS neg, count(*) AS n FROM competition)""",
)
def column_profile(t):
    return rounded(D.column_profile(t.competition))


@query(
    "retail_describe",
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 4) AS std, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max FROM sales" for c in ("sales", "customers", "is_open")),
)
def describe(t):
    return rounded(D.describe(t.sales, ["sales", "customers", "is_open"])).withColumn("std", F.round("std", 4))


@query(
    "retail_date_profile",
    """SELECT 'given' AS "column", min(CASE WHEN store_id % 4 <> 3 THEN date END) AS first_date, max(CASE WHEN store_id % 4 <> 3 THEN date END) AS last_date, count(*) FILTER (store_id % 4 = 3) AS unparsable FROM sales""",
    dates="first_date last_date",
)
def date_profile(t):
    given = F.when(F.col("store_id") % 4 == 0, F.date_format("date", "dd/MM/yyyy")).when(F.col("store_id") % 4 == 3, "n/a").otherwise(F.date_format("date", "yyyy-MM-dd"))
    return D.date_profile(t.sales.select(given.alias("given")), ["given"])


@query(
    "retail_duplicates",
    "SELECT CAST((SELECT count(*) FROM promo_days) - (SELECT count(*) FROM (SELECT DISTINCT * FROM promo_days)) AS BIGINT) AS duplicate_rows, CAST((SELECT count(*) FROM promo_days) - (SELECT count(DISTINCT store_id) FROM promo_days) AS BIGINT) AS duplicate_keys",
)
def duplicates(t):
    return D.duplicate_counts(t.promo_days, ["store_id"])


@query("retail_distinct_states", "SELECT DISTINCT state FROM states")
def distinct_states(t):
    return D.distinct_values(t.states, "state")


@query(
    "retail_tolerant_dates",
    "SELECT store_id, date AS parsed, count(*) AS n FROM (SELECT store_id, CASE WHEN store_id % 4 <> 3 THEN date END AS date FROM sales) GROUP BY ALL", dates="parsed")
def tolerant_dates(t):
    k = F.col("store_id") % 4
    dirty = F.when(k == 0, F.date_format("date", "yyyy-MM-dd")).when(k == 1, F.date_format("date", "dd/MM/yyyy")).when(k == 2, F.date_format("date", "yyyyMMdd")).otherwise(F.lit("n/a"))
    return t.sales.select("store_id", R.parse_date(dirty).alias("parsed")).groupBy("store_id", "parsed").agg(F.count("*").alias("n"))


@query("retail_completeness", "SELECT id FROM requests WHERE is_open = 0 OR id % 5 = 0 ORDER BY id LIMIT 10")
def completeness(t):
    return R.missing_keys(t.requests, t.requests.where("is_open = 1 AND id % 5 <> 0"), "id")


@query(
    "retail_merge_by_key",
    "SELECT store_id, date, is_train FROM base WHERE is_train = 1 AND store_id % 2 = 0 UNION ALL SELECT store_id, min(date), 0 FROM requests WHERE store_id NOT IN (SELECT store_id FROM sales WHERE store_id % 2 = 0) GROUP BY 1", dates="date")
def merge(t):
    original = t.sales.where("store_id % 2 = 0").select("store_id", "date", F.lit(1).alias("is_train"))
    return R.merge_by_key(original, t.requests.select("store_id", "date", F.lit(0).alias("is_train")), "store_id", ["date"])
