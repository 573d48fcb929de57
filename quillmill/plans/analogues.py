"""Retail and evaluation relations derived from the TPC-H-like tables, as DataFrames and as DuckDB CTEs.

Nulls, closed days and gaps are put in by fixed arithmetic on keys, so both engines derive the same rows.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.sources.staging import staged

REQUESTS_FROM = "2001-06-01"


class Retail:
    """The retail relations of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        read = self.read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
        lines = read("lineitem").select(
            F.col("l_suppkey").alias("store_id"), F.to_date("l_shipdate").alias("date"), "l_extendedprice", "l_orderkey", "l_discount"
        )
        k = F.col("store_id") + F.dayofmonth("date")
        days = lines.repartition("store_id", "date").groupBy("store_id", "date").agg(  # one shuffle for the sum and the distinct count
            F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("gross"),
            F.count_distinct("l_orderkey").alias("customers"),
        )
        days = days.select(
            "store_id",
            "date",
            F.when(k % 11 == 0, 0.0).otherwise(F.col("gross")).alias("sales"),
            "customers",
            F.when(k % 9 == 0, 0).otherwise(1).alias("is_open"),
        )
        self.sales = days.where(F.col("date") < REQUESTS_FROM)
        self.requests = days.where(F.col("date") >= REQUESTS_FROM).select(
            (F.col("store_id") * 100000 + F.datediff("date", F.lit("1990-01-01").cast("date"))).alias("id"), "store_id", "date", "is_open"
        )
        self.promo_days = lines.where("l_discount >= 0.09").select("store_id", "date")  # repeats stay in
        supplier, nation, region = read("supplier"), read("nation"), read("region")
        s, n = F.col("s_suppkey"), F.col("s_nationkey")
        self.stores = supplier.join(nation, n == F.col("n_nationkey")).select(
            s.alias("store_id"), F.col("n_regionkey").alias("store_type_id"), (n % 3).alias("assortment_id")
        )
        self.types = region.select(F.col("r_regionkey").alias("id"), F.substring("r_name", 1, 2).alias("type_code"), F.col("r_name").alias("description"))
        self.levels = nation.select((F.col("n_nationkey") % 3).alias("id")).distinct().select(
            "id", F.concat(F.lit("L"), F.col("id").cast("string")).alias("level_code"), F.concat(F.lit("level "), F.col("id").cast("string")).alias("description")
        )
        self.states = supplier.join(nation, n == F.col("n_nationkey")).select(s.alias("store_id"), F.col("n_name").alias("state"))
        self.competition = supplier.where(s % 29 != 0).select(
            s.alias("store_id"),
            F.when(s % 7 != 0, F.abs("s_acctbal")).alias("distance_meters"),
            F.when(s % 5 != 0, s % 12 + 1).cast("double").alias("open_since_month"),
            F.when(s % 5 != 0, s % 10 + 1990).cast("double").alias("open_since_year"),
        )
        self.promo = supplier.where(s % 3 != 2).select(
            s.alias("store_id"),
            F.when(s % 4 != 0, s % 50 + 1).cast("double").alias("since_week"),
            F.when(s % 4 != 0, s % 5 + 1995).cast("double").alias("since_year"),
            F.when(s % 4 != 0, F.when(s % 2 == 0, "Jan,Apr,Jul,Oct").otherwise("Feb,May,Aug,Nov")).alias("active_months"),
        )

    @functools.cached_property
    def orders(self) -> DataFrame:
        """Orders with their customer's nation, joined and written once for all that is derived from them."""
        orders = self.read("orders").join(self.read("customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(self.read("nation")), F.col("c_nationkey") == F.col("n_nationkey"))
        return staged(orders.select(F.col("n_name").alias("state"), F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").cast("decimal(18,2)").alias("p"), "o_orderpriority"), "orders")

    @property
    def weather(self) -> DataFrame:
        d = F.dayofmonth("date")
        by_day = self.orders.groupBy("state", "date").agg(F.max("p").cast("double").alias("hi"), F.min("p").cast("double").alias("lo"), F.count("*").alias("n"))
        return by_day.select(
            "state",
            "date",
            F.when(d % 5 != 0, (F.col("hi") + F.col("lo")) / 100).alias("temperature_avg"),
            F.when(d % 7 != 0, F.col("lo") / 100).alias("temperature_min"),
            F.when(d % 7 != 1, F.col("hi") / 100).alias("temperature_max"),
            F.when(d % 3 != 0, F.col("n").cast("double")).alias("precipitation_mm"),
            F.when(d % 4 == 0, "Rain").when(d % 4 == 1, "Sun").alias("weather_event"),
        )

    @property
    def macro(self) -> DataFrame:
        once = self.orders.groupBy("state", F.date_format("date", "yyyy-MM").alias("year_month")).agg(
            (F.max("p").cast("double") / 100).alias("gdp_index"),
            F.when(F.count("*") % 2 == 0, F.count("*") * 0.25).otherwise(F.count("*") * -0.25).cast("double").alias("unemployment_rate"),
            F.when(F.count("*") % 3 != 0, F.min("p").cast("double") / 100).alias("consumer_confidence_index"),
        )
        return once.unionByName(once.where(F.col("unemployment_rate") > 0).withColumn("gdp_index", F.col("gdp_index") / 2))  # a month can have two rows

    @property
    def trends(self) -> DataFrame:
        week, urgent = F.date_sub("date", F.weekday("date")).alias("week_start"), F.col("o_orderpriority") == "1-URGENT"
        return self.orders.groupBy("state", week, urgent.alias("urgent")).agg(F.when(F.count("*") > 1, F.count("*")).cast("double").alias("trend_index")).drop("urgent")  # and so can a week

    @property
    def events(self) -> DataFrame:
        return self.orders.where("o_orderpriority = '1-URGENT'").select("state", F.col("date").alias("date_start"), F.when(F.col("p") > 100000, "Fair").alias("event_type"))

    @property
    def state_holidays(self) -> DataFrame:
        kind = F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.dayofmonth("date") % 3 + 1))
        return self.orders.where("o_orderpriority = '2-HIGH'").select("state", "date", kind.alias("holiday_type"))

    @property
    def school_holidays(self) -> DataFrame:
        return self.orders.where("o_orderpriority = '5-LOW'").select("state", "date")


RETAIL_SQL = f"""
lines AS (SELECT l_suppkey AS store_id, CAST(l_shipdate AS DATE) AS date, l_extendedprice, l_orderkey, l_discount FROM lineitem),
days AS (SELECT store_id, date, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS gross, count(DISTINCT l_orderkey) AS customers FROM lines GROUP BY ALL),
alldays AS (SELECT store_id, date, CASE WHEN (store_id + day(date)) % 11 = 0 THEN 0.0 ELSE gross END AS sales, customers,
                   CASE WHEN (store_id + day(date)) % 9 = 0 THEN 0 ELSE 1 END AS is_open FROM days),
sales AS (SELECT * FROM alldays WHERE date < DATE '{REQUESTS_FROM}'),
requests AS (SELECT store_id * 100000 + (date - DATE '1990-01-01') AS id, store_id, date, is_open FROM alldays WHERE date >= DATE '{REQUESTS_FROM}'),
promo_days AS (SELECT store_id, date FROM lines WHERE l_discount >= 0.09),
stores AS (SELECT s_suppkey AS store_id, n_regionkey AS store_type_id, s_nationkey % 3 AS assortment_id FROM supplier JOIN nation ON s_nationkey = n_nationkey),
types AS (SELECT r_regionkey AS id, substr(r_name, 1, 2) AS type_code, r_name AS description FROM region),
levels AS (SELECT DISTINCT n_nationkey % 3 AS id, 'L' || (n_nationkey % 3) AS level_code, 'level ' || (n_nationkey % 3) AS description FROM nation),
states AS (SELECT s_suppkey AS store_id, n_name AS state FROM supplier JOIN nation ON s_nationkey = n_nationkey),
competition AS (SELECT s_suppkey AS store_id, CASE WHEN s_suppkey % 7 <> 0 THEN abs(s_acctbal) END AS distance_meters,
    CASE WHEN s_suppkey % 5 <> 0 THEN CAST(s_suppkey % 12 + 1 AS DOUBLE) END AS open_since_month,
    CASE WHEN s_suppkey % 5 <> 0 THEN CAST(s_suppkey % 10 + 1990 AS DOUBLE) END AS open_since_year FROM supplier WHERE s_suppkey % 29 <> 0),
promo AS (SELECT s_suppkey AS store_id, CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey % 50 + 1 END AS since_week,
    CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey % 5 + 1995 END AS since_year,
    CASE WHEN s_suppkey % 4 <> 0 THEN CASE WHEN s_suppkey % 2 = 0 THEN 'Jan,Apr,Jul,Oct' ELSE 'Feb,May,Aug,Nov' END END AS active_months
    FROM supplier WHERE s_suppkey % 3 <> 2),
ord AS (SELECT n_name AS state, CAST(o_orderdate AS DATE) AS date, CAST(o_totalprice AS DECIMAL(18,2)) AS p, o_orderpriority
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
by_day AS (SELECT state, date, CAST(max(p) AS DOUBLE) AS hi, CAST(min(p) AS DOUBLE) AS lo, count(*) AS n FROM ord GROUP BY ALL),
weather AS (SELECT state, date, CASE WHEN day(date) % 5 <> 0 THEN (hi + lo) / 100 END AS temperature_avg,
    CASE WHEN day(date) % 7 <> 0 THEN lo / 100 END AS temperature_min, CASE WHEN day(date) % 7 <> 1 THEN hi / 100 END AS temperature_max,
    CASE WHEN day(date) % 3 <> 0 THEN CAST(n AS DOUBLE) END AS precipitation_mm,
    CASE day(date) % 4 WHEN 0 THEN 'Rain' WHEN 1 THEN 'Sun' END AS weather_event FROM by_day),
macro1 AS (SELECT state, strftime(date, '%Y-%m') AS year_month, CAST(max(p) AS DOUBLE) / 100 AS gdp_index,
    CAST(CASE WHEN count(*) % 2 = 0 THEN count(*) * 0.25 ELSE count(*) * -0.25 END AS DOUBLE) AS unemployment_rate,
    CASE WHEN count(*) % 3 <> 0 THEN CAST(min(p) AS DOUBLE) / 100 END AS consumer_confidence_index FROM ord GROUP BY ALL),
macro2 AS (SELECT * FROM macro1 UNION ALL SELECT * REPLACE (gdp_index / 2 AS gdp_index) FROM macro1 WHERE unemployment_rate > 0),
macro AS (SELECT * FROM macro2 QUALIFY row_number() OVER (PARTITION BY state, year_month ORDER BY consumer_confidence_index NULLS FIRST, gdp_index, unemployment_rate) = 1),
trends AS (SELECT state, week_start, avg(trend_index) AS trend_index FROM (SELECT state, date - (isodow(date) - 1)::INTEGER AS week_start,
    CASE WHEN count(*) > 1 THEN CAST(count(*) AS DOUBLE) END AS trend_index FROM ord GROUP BY state, week_start, o_orderpriority = '1-URGENT') GROUP BY ALL),
levents AS (SELECT state, date AS date_start, CASE WHEN p > 100000 THEN 'Fair' END AS event_type FROM ord WHERE o_orderpriority = '1-URGENT'),
state_holidays AS (SELECT state, date, ['a', 'b', 'c'][day(date) % 3 + 1] AS holiday_type FROM ord WHERE o_orderpriority = '2-HIGH'),
school_holidays AS (SELECT DISTINCT state, date FROM ord WHERE o_orderpriority = '5-LOW'),
profile AS (SELECT s.store_id, type_code, t.description AS description_type, level_code, l.description AS description_assortment, state,
    CASE WHEN c.store_id IS NOT NULL THEN coalesce(distance_meters, (SELECT 2 * max(distance_meters) FROM competition)) END AS distance_meters,
    CASE WHEN c.store_id IS NOT NULL THEN coalesce(open_since_month, 1.0) END AS open_since_month,
    CASE WHEN c.store_id IS NOT NULL THEN coalesce(open_since_year, 1900.0) END AS open_since_year
    FROM stores s LEFT JOIN types t ON store_type_id = t.id LEFT JOIN levels l ON assortment_id = l.id
    LEFT JOIN states USING (store_id) LEFT JOIN competition c USING (store_id)),
state_days AS (SELECT w.*, gdp_index, unemployment_rate, consumer_confidence_index, trend_index, e.flag AS has_local_event
    FROM weather w LEFT JOIN macro m ON w.state = m.state AND strftime(w.date, '%Y-%m') = m.year_month
    LEFT JOIN trends t ON w.state = t.state AND w.date - (isodow(w.date) - 1)::INTEGER = t.week_start
    LEFT JOIN (SELECT DISTINCT state, date_start, 1 AS flag FROM levents WHERE event_type IS NOT NULL) e ON w.state = e.state AND w.date = e.date_start),
base AS (SELECT NULL::BIGINT AS id, store_id, date, sales, customers, is_open, 1 AS is_train FROM sales
    UNION ALL SELECT id, store_id, date, NULL, NULL, is_open, 0 FROM requests),
fact AS (SELECT b.*, p.* EXCLUDE (store_id), d.* EXCLUDE (state, date, has_local_event, weather_event, store_id),
    coalesce(d.has_local_event, 0) AS has_local_event, coalesce(d.weather_event, 'None') AS weather_event
    FROM base b LEFT JOIN profile p USING (store_id)
    LEFT JOIN (SELECT x.*, store_id FROM state_days x JOIN states USING (state)) d ON b.store_id = d.store_id AND b.date = d.date)
"""


def retail_sql(query: str, *more: str) -> str:
    """A DuckDB query over the retail relations, with further CTEs."""
    return "WITH " + ",\n".join([RETAIL_SQL, *more]) + "\n" + query
