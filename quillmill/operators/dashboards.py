"""Aggregates behind dashboards: means by weekday, month and promotion, uplift, weekly resampling, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.operators.selection import medians
from quillmill.operators.relational import parse_date


def open_train(df: DataFrame) -> DataFrame:
    return df.where("is_train = 1 AND is_open = 1")


def means_by(df: DataFrame, keys: list[str], value: str = "sales") -> DataFrame:
    return open_train(df).groupBy(*keys).agg(F.avg(value).alias(f"avg_{value}"))


def weekday_pivot(df: DataFrame, column: str, values: list) -> DataFrame:
    """Weekdays as rows in order, one column of mean sales for each of the given values of ``column``."""
    some = open_train(df).where(F.col(column).isin(values)).withColumn("day_of_week", F.weekday("date"))
    return some.groupBy("day_of_week").pivot(column, values).agg(F.avg("sales")).orderBy("day_of_week")


def promo_uplift(df: DataFrame) -> DataFrame:
    """Percent by which promotion days outsell others, for stores that have both; 0 if others sell nothing."""
    both = open_train(df).groupBy("store_id").agg(
        F.avg(F.when(F.col("promo") == 1, F.col("sales"))).alias("with_promo"), F.avg(F.when(F.col("promo") == 0, F.col("sales"))).alias("without_promo")
    )
    gain = F.when(F.col("without_promo") > 0, (F.col("with_promo") - F.col("without_promo")) / F.col("without_promo") * 100).otherwise(0.0)
    return both.where("with_promo IS NOT NULL AND without_promo IS NOT NULL").withColumn("uplift_pct", gain)


def weekly_resample(df: DataFrame, date: str = "date", value: str = "sales") -> DataFrame:
    """Mean per week, weeks ending on Sunday; empty weeks inside the range are null."""
    end = F.next_day(F.date_sub(date, 1), "SUN")
    weeks = df.groupBy(end.alias("week_end")).agg(F.avg(value).alias(f"avg_{value}"))
    span = df.agg(F.min(end).alias("a"), F.max(end).alias("b")).where("a IS NOT NULL")
    calendar = span.select(F.explode(F.sequence("a", "b", F.expr("interval 7 days"))).alias("week_end"))
    return calendar.hint("shuffle_merge").join(weeks, "week_end", "left")  # a generated side has no size to go by


def summary(df: DataFrame, value: str) -> DataFrame:
    """One row: mean, exact median, max, min, sum and count of a column. ``df`` is read several times and should be staged."""
    c = F.col(value)
    one = df.agg(F.avg(c).alias("mean"), F.max(c).alias("max"), F.min(c).alias("min"), F.sum(c).alias("sum"), F.count(c).alias("count"))
    return one.crossJoin(F.broadcast(medians(df, [value]).select(F.col(value).alias("median"))))  # a row each


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, count, mean, std, min, max of numeric columns, a row each, in one pass."""
    named = F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns)))
    return df.select(named).groupBy("column").agg(F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))


def date_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, first_date, last_date, unparsable: the range of dates given as text, and values that are no date."""
    named = F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns)))
    parsed = df.select(named).withColumn("date", parse_date(F.col("v")))
    return parsed.groupBy("column").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count_if(F.col("v").isNotNull() & F.col("date").isNull()).alias("unparsable"))


def grouped_mode(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """The commonest value of each group, the smallest among equals."""
    return df.groupBy(*keys).agg(F.mode(column, True).alias(f"{column}_mode"))


def column_profile(df: DataFrame) -> DataFrame:
    """column, type, nulls, null_pct, negatives: one pass over the table, most nulls first."""
    kinds = dict(df.dtypes)
    numeric = [c for c, t in kinds.items() if t in ("int", "bigint", "double", "float", "smallint", "tinyint") or t.startswith("decimal")]
    one = df.agg(
        F.count("*").alias("__n"),
        *(F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in kinds),
        *((F.count_if(F.col(c) < 0) if c in numeric else F.lit(None).cast("long")).alias(f"m_{c}") for c in kinds),
    )
    rows = F.array(
        *(F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col(f"n_{c}").alias("nulls"), (100 * F.col(f"n_{c}") / F.col("__n")).alias("null_pct"), F.col(f"m_{c}").alias("negatives")) for c, t in kinds.items())
    )
    return one.select(F.explode(rows).alias("x")).select("x.*").orderBy(F.desc("null_pct"), "column")


def duplicate_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, and keys, after their first appearance."""
    groups = df.groupBy(*df.columns).count()
    by_key = df.groupBy(*keys).count()
    a = groups.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_rows"))
    return a.crossJoin(by_key.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_keys")))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)
