"""Retail operators on small fixtures."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from quillmill.operators import dashboards as D
from quillmill.operators import features as X
from quillmill.operators import modelling as M
from quillmill.operators import parzen, selection
from quillmill.operators import relational as R


def d(day, month=1, year=2015):
    return dt.date(year, month, day)


@pytest.fixture(scope="module")
def facts(spark):
    rows = []
    for store in (1, 2, 3):
        for i in range(20):
            n = (store - 1) * 20 + i
            rows.append((store, d(1) + dt.timedelta(i), float(100 + 7 * n % 50), n, 0 if n >= 57 else 1, 0 if n >= 50 else 1, "BE" if store < 3 else "HE", "a", "x", None if i > 14 else "Rain",
                         100.0 * store, 1.0, 2000.0 + store, float(i) if i % 4 else None, 1.0, 2.0, None, None if i < 3 else 50.0 + i, -1.0 * i, None if i % 5 == 0 else 3.0, None if store == 3 else 4.0, None))
    shape = "store_id int, date date, sales double, customers int, is_open int, is_train int, state string, type_code string, level_code string, weather_event string, distance_meters double, open_since_month double, open_since_year double, temperature_avg double, temperature_min double, temperature_max double, precipitation_mm double, gdp_index double, unemployment_rate double, consumer_confidence_index double, trend_index double, has_local_event int"
    return spark.createDataFrame(rows, shape)


@pytest.fixture(scope="module")
def promos(spark):
    days = spark.createDataFrame([(1, d(1)), (1, d(1)), (1, d(2)), (2, d(1)), (2, d(3))], "store_id int, date date")
    cont = spark.createDataFrame([(1, 10.0, 2013.0, "Jan,Feb,Mar"), (2, 20.0, 2014.0, "Jun,Jul"), (3, None, None, None)], "store_id int, since_week double, since_year double, active_months string")
    return days, cont


def test_imputation_leaves_no_nulls_and_mends_signs(facts):
    out = X.impute_all(facts.withColumn("precipitation_mm", F.lit(1.0)))
    assert out.count() == 60 and X.null_audit(out.drop("sales")).count() == 0
    assert out.where("unemployment_rate < 0").count() == 0 and not [c for c in out.columns if c.startswith("__")]


def test_two_phase_fill_equals_one_window(spark):
    rows = [(1, d(1), None), (2, d(1), 1.0), (1, d(2), None), (2, d(2), None), (1, d(3), 3.0), (2, d(3), None), (1, d(4), None)]
    df = spark.createDataFrame(rows, "store_id int, date date, x double")
    got = [r["x"] for r in X.impute_ffill(df, ["x"]).orderBy("date", "store_id").collect()]
    assert got == [1.0, 1.0, 1.0, 1.0, 3.0, 3.0, 3.0]


def test_calendar_ranges(facts):
    r = X.calendar_features(facts).agg(F.min("day_of_week"), F.max("day_of_week"), F.min("dow_sin"), F.max("dow_cos"), F.min("competition_open_months")).first()
    assert r[0] == 0 and r[1] == 6 and r[2] >= -1 and r[3] <= 1 and r[4] >= 0


def test_target_encoding_does_not_leak(facts):
    x = X.calendar_features(facts)
    changed = x.withColumn("sales", F.when(F.col("is_train") == 0, 1e9).otherwise(F.col("sales")))
    one, two = (X.target_encode(y).agg(F.sum("store_avg_sales"), F.sum("store_dow_avg"), F.sum("state_month_avg")).first() for y in (x, changed))
    assert one == two


def test_labels_and_interactions(facts):
    x = X.label_encode(facts, ["state", "weather_event", "type_code", "level_code"])
    assert {(r[0], r[1]) for r in x.select("state", "state_enc").distinct().collect()} == {("BE", 0), ("HE", 1)}
    assert {(r[0], r[1]) for r in x.select("weather_event", "weather_event_enc").distinct().collect()} == {(None, 0), ("Rain", 1)}
    assert X.interactions(x).where("store_type_assort <> type_code_enc * 10 + level_code_enc").count() == 0


def test_promotions(facts, promos):
    out = X.continuous_promo(X.promo_flag(facts, promos[0]), promos[1])
    assert out.count() == 60 and out.agg(F.sum("promo")).first()[0] == 4
    got = {r["store_id"]: (r[1], r[2]) for r in out.groupBy("store_id").agg(F.max("has_promo2"), F.max("promo2_active")).collect()}
    assert got == {1: (1, 1), 2: (1, 0), 3: (0, 0)}


def test_zero_sales_and_null_sales(spark):
    df = spark.createDataFrame([(1, 0.0, 1, 1), (2, None, 1, 1), (3, 0.0, 0, 1), (4, 0.0, 1, 0), (5, 9.0, 1, 1)], "id int, sales double, is_open int, is_train int")
    assert {r["id"] for r in R.drop_open_zero_sales(df).collect()} == {2, 3, 4, 5}


def test_features_have_all_inputs(facts, promos):
    out = X.build_features(facts, *promos)
    assert set(M.FEATURES) <= set(out.columns) and len(M.FEATURES) == 39
    assert out.where("is_open = 1 AND sales = 0 AND is_train = 1").count() == 0


def test_rmspe(spark):
    df = spark.createDataFrame([(0.0, 50.0), (100.0, 110.0), (200.0, 190.0)], "sales double, prediction double")
    assert abs(M.rmspe(df).first()[0] - ((0.01 + 0.0025) / 2) ** 0.5) < 1e-12
    assert M.rmspe(df.withColumn("prediction", F.col("sales"))).first()[0] == 0


def test_temporal_split(facts):
    early, late = R.temporal_split(facts, weeks=1)
    assert early.count() + late.count() == facts.where("is_train = 1 AND is_open = 1").count()
    assert early.agg(F.max("date")).first()[0] < late.agg(F.min("date")).first()[0]


def test_requests_scores_and_submission(spark, facts, promos):
    req = spark.createDataFrame([(1, 1, d(10), 1), (2, 2, d(11), 1), (3, 1, d(12), 0), (4, 9999, d(1), 1)], "id int, store_id int, date date, is_open int")
    found = M.request_features(req, facts.where("is_train = 1"), *promos)
    assert found.count() == 4 and found.where("store_id = 9999").first()["store_avg_sales"] == 0
    scores = M.batch_scores(found, lambda x: x.withColumn("predicted_sales", F.col("store_dow_avg")))
    got = {r["id"]: r["predicted_sales"] for r in M.submission(req, scores).collect()}
    assert got[3] == 0 and got[4] >= 0 and got[1] > 0
    with pytest.raises(ValueError, match="4"):
        M.submission(req, scores.where("id <> 4"))
    bad = spark.createDataFrame([("x",), ("-3",), (None,), ("2.5",), ("NaN",)], "v string")
    assert [r[0] for r in bad.select(M.clean_prediction(F.col("v"))).collect()] == [0, 0, 0, 2.5, 0]


def test_trees_round_trip(spark, facts, promos, tmp_path):
    rows = M.prepared(X.build_features(facts, *promos))
    model = M.train(rows, maxIter=2, maxDepth=2)
    M.save(model, str(tmp_path), {"maxIter": 2}, 0.5)
    loaded, meta = M.load(str(tmp_path), spark)
    assert meta["params"] == {"maxIter": 2} and len(meta["features"]) == 39
    assert M.predict(loaded, rows).where("predicted_sales < 0").count() == 0


def test_search_trains_side_by_side_within_the_ranges(spark, facts, promos):
    rows = M.prepared(X.build_features(facts, *promos))
    ranges = M.RANGES | {"maxIter": (1, 3), "maxDepth": (1, 2)}
    early, late = R.temporal_split(rows, 1)
    done = M.search(early, late, trials=7, features=["day_of_week", "promo"], ranges=ranges, side_by_side=3)
    assert len(done) == 7 and M.least(done).error == min(t.error for t in done)
    for t in done:
        assert set(t.params) == set(ranges) and all(a <= t.params[k] <= b for k, (a, b) in ranges.items()) and 1 <= t.trees <= t.params["maxIter"]


def test_model_based_search_beats_random_draws():
    ranges = {"maxDepth": (1, 12), "stepSize": (0.01, 0.6), "subsamplingRate": (0.2, 1.0), "minInstancesPerNode": (1, 60)}
    error = lambda p: (p["maxDepth"] - 7) ** 2 / 50 + (p["stepSize"] - 0.2) ** 2 * 10 + (p["subsamplingRate"] - 0.7) ** 2 + (p["minInstancesPerNode"] - 20) ** 2 / 3000

    def best(suggest, seed):
        draw, past = random.Random(seed), []
        for _ in range(60):
            params = suggest(past, ranges, draw)
            past.append((params, error(params)))
        return min(e for _, e in past)

    pairs = [(best(parzen.suggest, s), best(parzen.at_random, s)) for s in range(20)]
    assert sum(a for a, _ in pairs) < 0.6 * sum(b for _, b in pairs) and sum(a <= b for a, b in pairs) >= 15
    p = parzen.Parzen([1.0, 1.2, 9.0], 0.0, 10.0)
    mass = sum(math.exp(p.log_density(i / 1000)) for i in range(10_000)) / 1000
    assert abs(mass - 1) < 0.01


def test_trees_stop_early(spark):
    draw = random.Random(3)
    rows = [(i, 1, 1, float(i % 7), draw.random(), math.exp(3 + 0.5 * (i % 7 > 3) + 0.4 * draw.gauss(0, 1))) for i in range(1500)]
    df = spark.createDataFrame(rows, "i int, is_train int, is_open int, day_of_week double, noise double, sales double")
    early, late = df.where("i < 1000"), df.where("i >= 1000")
    model = M.train(early, ["day_of_week", "noise"], held_out=late, maxIter=25, maxDepth=4, stepSize=0.5)
    assert 1 <= M.n_trees(model) < 25
    error, base = (M.rmspe(x, p="predicted_sales").first()[0] for x in (M.predict(model, late), M.mean_baseline(early, late)))
    assert error < base


def test_dashboards(spark, facts, promos):
    up = D.promo_uplift(X.promo_flag(facts, promos[0])).collect()
    assert {r["store_id"] for r in up} == {1, 2}
    weeks = D.weekly_resample(spark.createDataFrame([(d(1), 2.0), (d(4), 4.0), (d(19), 6.0)], "date date, sales double")).orderBy("week_end").collect()
    assert [(r[0], r[1]) for r in weeks] == [(d(4), 3.0), (d(11), None), (d(18), None), (d(25), 6.0)]
    modes = D.grouped_mode(spark.createDataFrame([(1, 2), (1, 1), (2, 5)], "k int, x int"), ["k"], "x").collect()
    assert {(r[0], r[1]) for r in modes} == {(1, 1), (2, 5)}
    dup = D.duplicate_counts(spark.createDataFrame([(1, 1), (1, 1), (1, 2)], "k int, x int"), ["k"]).first()
    assert (dup[0], dup[1]) == (1, 2)


def test_relational(spark):
    t = spark.createDataFrame([("2015-01-02",), ("02/01/2015",), ("20150102",), ("junk",), (None,)], "s string")
    assert [r[0] for r in t.select(R.parse_date(F.col("s"))).collect()] == [d(2)] * 3 + [None, None]
    a, b = spark.createDataFrame([(1, "o")], "id int, v string"), spark.createDataFrame([(1, "s"), (2, "b"), (2, "a")], "id int, v string")
    assert {(r[0], r[1]) for r in R.merge_by_key(a, b, "id", ["v"]).collect()} == {(1, "o"), (2, "a")}
    assert R.restrict_or_all(b, spark.createDataFrame([(9,)], "id int"), "id").count() == 3 and R.membership(b, "id", []).count() == 3
    assert spark.range(1).select(R.clip_low(F.lit(None).cast("double")), R.clip_low(F.lit(-1.0))).first()[:] == (None, 0.0)


def test_medians_are_exact(spark):
    rows = [(float(i * 7919 % 1013) / 3, None if i % 2 else float(i), None, float(i == 5)) for i in range(1500)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(5)
    got, expected = selection.medians(df, ["a", "b", "c", "d"]).first(), df.agg(*(F.median(c).alias(c) for c in "abcd")).first()
    assert got == expected
    assert selection.medians(df.limit(0), ["a"]).first()["a"] is None and selection.medians(df.limit(2), ["a"]).first() == df.limit(2).agg(F.median("a").alias("a")).first()


def test_grouped_medians_are_exact(spark):
    draw = random.Random(5)
    rows = []
    for g in range(40):  # groups of 1 to some 2,000 rows, and one of a third of all
        n = [1, 2, 3, 4, 10, 11, 1000, 1001, 1999, 2000][g % 10] if g < 39 else 12_000
        for _ in range(n):
            rows.append((g if g != 7 else None, f"s{g % 3}", draw.choice([None, draw.gauss(0, 1), float(draw.randint(0, 5))]), draw.random() if g != 5 else None))
    df = spark.createDataFrame(rows, "g int, s string, a double, b double").repartition(6).cache()
    got = selection.grouped_medians(df, {("g", "s"): ["a", "b"], ("s",): ["b"], (): ["a"]})
    for keys, columns in ((("g", "s"), ["a", "b"]), (("s",), ["b"]), ((), ["a"])):
        want = df.where("g IS NOT NULL" if "g" in keys else "true").groupBy(*keys).agg(*(F.median(c).alias(c) for c in columns))
        key = lambda r: [r[k] for k in keys]  # noqa: B023, E731
        assert sorted(got[keys].select(want.columns).collect(), key=key) == sorted(want.collect(), key=key)
    assert selection.grouped_medians(df.limit(0), {("s",): ["a"]})["s",].collect() == []


def test_repeated_months_and_weeks_do_not_multiply_days(spark):
    weather = spark.createDataFrame([("BE", d(5), 1.0), ("BE", d(5), 0.5), ("BE", d(6), 2.0), (None, d(6), 3.0)], "state string, date date, temperature_avg double")
    macro = spark.createDataFrame([("BE", "2015-01", 2.0), ("BE", "2015-01", 1.0)], "state string, year_month string, gdp_index double")
    trends = spark.createDataFrame([("BE", d(5), 10, "x"), ("BE", d(5), 20, "y"), ("BE", None, 90, "z")], "state string, week_start date, trend_index int, note string")
    events = spark.createDataFrame([("BE", d(5), "Fair"), ("BE", d(5), "Race"), ("BE", d(6), None), ("BE", None, "Fair")], "state string, date_start date, event_type string")
    got = R.enrich_state_days(weather, macro, trends, events).orderBy("date").collect()
    assert [(r["date"], r["temperature_avg"], r["gdp_index"], r["trend_index"], r["has_local_event"]) for r in got] == [(d(5), 0.5, 1.0, 15.0, 1), (d(6), 2.0, 1.0, 15.0, None)]
