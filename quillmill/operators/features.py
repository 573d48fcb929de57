"""Retail features: imputation, calendar, encodings, interactions, promotions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.operators.relational import STORES, clip_low, drop_open_zero_sales, flag
from quillmill.operators.selection import grouped_medians, medians_of_small_groups
from quillmill.sources.staging import sized, staged

WEATHER = ["temperature_avg", "temperature_min", "temperature_max", "precipitation_mm"]
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
CATEGORICALS = ["type_code", "level_code", "state", "weather_event"]


def impute_medians(df: DataFrame, rules: dict[str, list[list[str]]], read: DataFrame | None = None) -> DataFrame:
    """Fill each column's nulls by the exact median of the first of its key sets that has one; [] is the whole table.

    All medians come from ``selection``; they are small tables joined back, so the facts are never sorted or
    shuffled for them. ``df`` is read several times and should be staged, or ``read`` be a staged frame of the same values.
    """
    keysets = list(dict.fromkeys(tuple(k) for sets in rules.values() for k in sets))
    found = grouped_medians(df if read is None else read, {k: [c for c, sets in rules.items() if list(k) in sets] for k in keysets})
    out = df
    for i, keys in enumerate(keysets):
        own = sized(found[keys].select(*keys, *(F.col(c).alias(f"__m{i}_{c}") for c in found[keys].columns if c not in keys)))
        out = out.join(own, list(keys), "left") if keys else out.crossJoin(own)
    filled = {c: F.coalesce(c, *(F.col(f"__m{keysets.index(tuple(k))}_{c}") for k in sets)) for c, sets in rules.items()}
    return out.select(*(filled[c].alias(c) if c in filled else F.col(c) for c in df.columns))


def impute_group_median(df: DataFrame, columns: list[str], keysets: list[list[str]]) -> DataFrame:
    return impute_medians(df, {c: keysets for c in columns})


def impute_ffill(df: DataFrame, columns: list[str], date: str = "date", order: str = "store_id", read: DataFrame | None = None) -> DataFrame:
    """Fill forwards, then backwards, in the order (date, ``order``), in two phases.

    Within a date a window partitioned by date fills forwards; across dates each date's last known value, a table of
    one row per date, carries over. What no known value precedes gets the first of all. No window covers the whole fact
    table, and none looks ahead, which takes Spark the square of a date's rows. ``df`` is read twice
    and should be staged, or ``read`` be a staged frame of the same values.
    """
    before = Window.partitionBy(date).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    key = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"__f_{c}") for c in columns]
    key += [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"__l_{c}") for c in columns]
    dates = staged((df if read is None else read).groupBy(date).agg(*key), "dates")
    past = Window.orderBy(F.asc_nulls_first(date)).rowsBetween(Window.unboundedPreceding, -1)  # one row per date
    first = dates.agg(*(F.min_by(f"__f_{c}", F.when(F.col(f"__f_{c}").isNotNull(), F.coalesce(date, F.lit("0001-01-01").cast("date")))).alias(f"__n_{c}") for c in columns))
    carried = dates.select(F.col(date).alias("__date"), *(F.last(f"__l_{c}", ignorenulls=True).over(past).alias(f"__p_{c}") for c in columns))
    out = df.join(sized(carried), F.col(date).eqNullSafe(F.col("__date")), "left").crossJoin(F.broadcast(first))
    filled = {c: F.coalesce(F.last(c, ignorenulls=True).over(before), f"__p_{c}", f"__n_{c}") for c in columns}
    return out.select(*(filled[c].alias(c) if c in filled else F.col(c) for c in df.columns))


def impute_all(df: DataFrame, read: DataFrame | None = None) -> DataFrame:
    """The whole imputation: weather, macro figures, unemployment, trend, competitor.

    ``df`` should be staged, or ``read`` be a staged frame of the same values: what is filled in is found by reading its
    columns, and the facts pass once, with one shuffle.
    """
    read = df if read is None else read
    keyed = lambda d: d.withColumns({"__month": F.month("date"), "__year": F.year("date"), "unemployment_rate": F.abs("unemployment_rate")})  # noqa: E731  a sign error in the source
    rules = {c: [["state", "__month"], ["__month"], []] for c in WEATHER}
    rules |= {"unemployment_rate": [["state", "__year"], []], "trend_index": [["state", "__month"], []]}
    rules |= {c: [[]] for c in ("distance_meters", "open_since_month", "open_since_year")}
    out = impute_ffill(impute_medians(keyed(df), rules, keyed(read)), ["gdp_index", "consumer_confidence_index"], read=read)
    return out.fillna({"weather_event": "None", "has_local_event": 0}).drop("__month", "__year")


def null_audit(df: DataFrame) -> DataFrame:
    """column, nulls: columns that hold nulls, most first."""
    counts = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns))
    return (
        counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in df.columns))).alias("x"))
        .select("x.*")
        .where("nulls > 0")
        .orderBy(F.desc("nulls"), "column")
    )


def cyclic(c: Column, period: int) -> tuple[Column, Column]:
    return F.sin(2 * F.pi() * c / period), F.cos(2 * F.pi() * c / period)


def calendar_features(df: DataFrame) -> DataFrame:
    dow, month, week = F.weekday("date"), F.month("date"), F.weekofyear("date")
    age = (F.year("date") - F.col("open_since_year")) * 12 + (month - F.col("open_since_month"))
    columns = {
        "day_of_week": dow, "month": month, "year": F.year("date"), "day_of_month": F.dayofmonth("date"),
        "week_of_year": week, "day_of_year": F.dayofyear("date"), "is_weekend": (dow >= 5).cast("int"),
        "competition_open_months": clip_low(age.cast("double")),
    }
    for name, c, period in (("dow", dow, 7), ("month", month, 12), ("woy", week, 52)):
        columns[f"{name}_sin"], columns[f"{name}_cos"] = cyclic(c, period)
    return df.withColumns(columns)


def label_encode(df: DataFrame, columns: list[str], read: DataFrame | None = None) -> DataFrame:
    """``<column>_enc``: the alphabetical rank from 0 of each value over all rows; null counts as the string 'None'.

    One pass finds the distinct combinations, which hold the values of all columns; the codes are a small table each, joined
    back. ``df`` is read twice and should be staged, or ``read`` be a staged frame of the same values.
    """
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    named = F.inline(F.array(*(F.struct(F.lit(c).alias("c"), value(c).alias("v")) for c in columns)))
    seen = (df if read is None else read).select(*columns).distinct()
    codes = staged(seen.select(named).distinct().withColumn("code", F.dense_rank().over(Window.partitionBy("c").orderBy("v")) - 1), "codes")
    out = df
    for c in columns:
        own = codes.where(F.col("c") == c).select(F.col("v").alias(f"__{c}"), F.col("code").alias(f"{c}_enc"))
        out = out.withColumn(f"__{c}", value(c)).join(sized(own), f"__{c}", "left").drop(f"__{c}")
    return out


def target_encode(df: DataFrame, read: DataFrame | None = None) -> DataFrame:
    """Store mean and median, (store, weekday) and (state, month) means of training sales.

    Request rows never contribute. Means come from one table of sums by all these keys, medians from ``selection``. Gaps are
    filled by the median of the joined column, which is the groups' own values weighted by their rows: no second pass
    over the joined facts. ``df`` should be staged, or ``read`` be a staged frame of the same values.
    """
    read = df if read is None else read
    sales = F.when(F.col("is_train") == 1, F.col("sales"))
    sums = staged(read.groupBy("store_id", "state", "day_of_week", "month").agg(F.sum(sales).alias("t"), F.count(sales).alias("k"), F.count("*").alias("__n")), "sums")
    sizes = staged(sums.groupBy("store_id").agg(F.sum("k").alias("n")), "sizes")
    middles = medians_of_small_groups(read.select("store_id", sales.alias("store_med_sales")), ["store_id"], "store_med_sales", sizes)
    mean = F.try_divide(F.sum("t"), F.sum("k"))
    out = df
    for keys, name in ((["store_id"], "store_avg_sales"), (["store_id", "day_of_week"], "store_dow_avg"), (["state", "month"], "state_month_avg")):
        groups, names = sums.groupBy(*keys).agg(mean.alias(name), F.sum("__n").alias("__n")), [name]
        if name == "store_avg_sales":
            groups, names = groups.join(middles.hint("shuffle_hash"), "store_id", "left"), [name, "store_med_sales"]
        groups = staged(groups, "encodings")
        middle = groups.agg(*(F.percentile(c, 0.5, F.col("__n")).alias(f"__{c}") for c in names))
        if keys == ["store_id", "day_of_week"]:  # seven to a store: one row, so that the facts need no shuffle
            week = groups.dropna(subset=keys).groupBy("store_id").agg(F.map_from_entries(F.collect_list(F.struct("day_of_week", name))).alias("__week"))
            out = out.join(sized(staged(week, "weeks"), STORES), "store_id", "left").withColumn(name, F.try_element_at("__week", F.col("day_of_week"))).drop("__week")
        else:
            out = out.join(sized(groups.drop("__n"), STORES), keys, "left")
        out = out.crossJoin(F.broadcast(middle))  # a row of a null key gets the middle, too
        out = out.withColumns({c: F.coalesce(c, f"__{c}") for c in names}).drop(*(f"__{c}" for c in names))
    return out


def interactions(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {"distance_x_type": F.col("distance_meters") * F.col("type_code_enc"), "store_type_assort": (F.col("type_code_enc") * 10 + F.col("level_code_enc")).cast("double")}
    )


def promo_flag(df: DataFrame, promo_days: DataFrame) -> DataFrame:
    """``promo``: 1 on a store's promotion days; repeated promotion rows do not multiply facts."""
    days = promo_days.select("store_id", "date").distinct().withColumn("promo", F.lit(1))
    return df.drop("promo").join(days, ["store_id", "date"], "left").fillna({"promo": 0})


def continuous_promo(df: DataFrame, promo: DataFrame) -> DataFrame:
    """``has_promo2`` and ``promo2_active``: started (first of January of the year plus weeks) and in an active month."""
    once = promo.groupBy("store_id").agg(F.min(F.struct("since_year", "since_week", "active_months")).alias("p")).select("store_id", "p.*")
    out = df.join(once, "store_id", "left")
    start = F.date_add(F.make_date(F.col("since_year").cast("int"), F.lit(1), F.lit(1)), (F.col("since_week") * 7).cast("int"))
    name = F.element_at(F.array(*map(F.lit, MONTHS)), F.month("date"))
    active = F.contains("active_months", name) & (F.col("date") >= start)
    return out.withColumns({"has_promo2": flag(F.col("since_year").isNotNull()), "promo2_active": flag(active)}).drop(
        "since_year", "since_week", "active_months"
    )


def build_features(df: DataFrame, promo_days: DataFrame | None, promo: DataFrame) -> DataFrame:
    """Labels, targets, imputation, calendar, interactions, promotions, then dropping zero-sales rows.

    The facts are written once. Medians, codes and means are found by reading the columns they need, and one pass with one
    shuffle, that of the forward fill, joins them. The fill stands in the middle: it parts the code that Spark generates for
    the pass, which Java does not compile beyond 8,000 bytes a method. Without ``promo_days`` the facts hold ``promo`` already.
    """
    return features_of(staged(df if promo_days is None else promo_flag(df, promo_days), "fact"), promo)


def features_of(facts: DataFrame, promo: DataFrame) -> DataFrame:
    """``build_features`` of facts that are staged and hold ``promo``."""
    facts = facts.withColumns({"day_of_week": F.weekday("date"), "month": F.month("date")})
    x = impute_all(target_encode(label_encode(facts, CATEGORICALS, facts), facts), facts)
    return drop_open_zero_sales(continuous_promo(interactions(calendar_features(x)), promo))
