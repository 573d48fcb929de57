"""Steps whose work must grow no faster than their input."""

import datetime as dt
import inspect
import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from quillmill.operators import features as X
from quillmill.operators import modelling
from quillmill.operators import relational as R
from quillmill.operators import retrieval as V
from quillmill.operators import selection
from quillmill.plans import evaluation, jobs, retail
from quillmill.plans.analogues import Retail
from quillmill.sources import staging


def day(n):
    return dt.date(2015, 1, 1) + dt.timedelta(n)


def test_days_of_a_state_are_not_copied_to_its_stores(spark):
    sales = spark.createDataFrame([(s, day(s % 3), 1.0, 1) for s in range(6)], "store_id long, date date, sales double, is_open int")
    requests = spark.createDataFrame([(1, 0, day(2), None)], "id long, store_id long, date date, is_open int")
    profile = spark.createDataFrame([(s, "BE" if s < 3 else None) for s in range(5)], "store_id long, state string")
    states = spark.createDataFrame([(0, "BE"), (1, "BE"), (2, "BE"), (5, "HE")], "store_id long, state string")
    days = spark.createDataFrame([("BE", day(0), 1.0), ("BE", day(2), 2.0), ("HE", day(2), 3.0), ("XX", day(1), 4.0)], "state string, date date, temperature_avg double")
    out = R.build_fact(sales, requests, profile, days, states)
    assert not re.search(r"Join \w+, \(state#", out._jdf.queryExecution().optimizedPlan().toString())
    got = sorted((r["store_id"], str(r["date"]), r["state"], r["temperature_avg"], r["is_train"], r["is_open"]) for r in out.collect())
    assert [r[:2] + r[3:] for r in got] == [(0, "2015-01-01", 1.0, 1, 1), (0, "2015-01-03", 2.0, 0, 1), (1, "2015-01-02", None, 1, 1), (2, "2015-01-03", 2.0, 1, 1), (3, "2015-01-01", None, 1, 1), (4, "2015-01-02", None, 1, 1), (5, "2015-01-03", 3.0, 1, 1)]
    assert got[-1][2] is None and out.columns == ["store_id", "date", "sales", "is_open", "is_train", "id", "state", "temperature_avg"]


def test_fill_looks_back_only(spark):
    rows = [(s, day(d), None if d < 2 or s % 3 else float(100 * d + s)) for d in range(4) for s in range(9)]
    out = X.impute_ffill(spark.createDataFrame(rows, "store_id int, date date, x double"), ["x"])
    assert "unboundedfollowing" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
    known, want = [x for _, _, x in rows if x is not None], []
    for _, _, x in rows:
        want.append(x if x is not None else want[-1] if want and want[-1] is not None else None)
    assert [r["x"] for r in out.orderBy("date", "store_id").collect()] == [known[0] if x is None else x for x in want]


def test_medians_count_equal_values_first(spark, monkeypatch):
    written, stage = {}, selection.staged
    monkeypatch.setattr(selection, "staged", lambda df, name: written.setdefault(name, stage(df, name)))
    df = spark.range(6000).select((F.col("id") % 2).alias("g"), (F.col("id") % 14).cast("double").alias("x"))
    got = {r["g"]: r["x"] for r in selection.grouped_medians(df, {("g",): ["x"], (): ["x"]})["g",].collect()}
    assert got == {r["g"]: r["x"] for r in df.groupBy("g").agg(F.median("x").alias("x")).collect()}
    assert written["counted-values"].count() == 14 and written["value-ranges"].count() == 28


def test_a_mean_on_a_half_reads_alike_in_both_engines(spark):
    values = [10.075, 9.075, -0.001, -0.125, 2.5, 0.0, 1234.565, None]
    rule = "CAST(round(CAST(round(ti, 6) AS DECIMAL(18, 6)), 2) AS VARCHAR)"
    assert rule in evaluation.ORACLE_SQL["retrieval_documents"]
    want = [r[0] for r in duckdb.sql(f"SELECT {rule} FROM (SELECT unnest({[v if v is not None else None for v in values]}::DOUBLE[]) AS ti)".replace("None", "NULL")).fetchall()]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).select(V.figure(F.col("v"), "%.2f")).collect()]
    assert got == want and got[:3] == ["10.08", "9.08", "0.00"]


def test_search_returns_the_nearest_of_each_part_only(spark):
    rows = [(i, [float(i % 7), float(i % 3)]) for i in range(1500)] + [(2000, [float("nan"), 1.0])]  # 21 places, some 70 copies at each
    items = spark.createDataFrame(rows, "id long, embedding array<double>")
    queries = items.where("id < 4")
    assert V.pairs(items, queries, 5, keep=5).groupBy("query_id").count().agg(F.max("count")).first()[0] <= 5 * 40
    got = sorted((r["query_id"], r["rank"], r["id"], r["distance"]) for r in V.nearest(items, queries, digits=9).collect())
    assert got == [(q, k + 1, q + 21 * k, 0.0) for q in range(4) for k in range(5)]


def test_training_rows_are_dealt_over_partitions_of_bounded_size(spark):
    rows = spark.range(1000).coalesce(1)
    assert modelling.dealt(rows, 50).rdd.getNumPartitions() == 20
    assert max(modelling.dealt(rows, 50).groupBy(F.spark_partition_id()).count().select("count").toPandas()["count"]) <= 100
    assert modelling.dealt(rows.limit(0)).count() == 0


def test_features_write_the_facts_once_and_narrow(spark, monkeypatch):
    written, stage = [], X.staged

    def spy(df, name):
        written.append((name, df.columns))
        return stage(df, name)

    monkeypatch.setattr(X, "staged", spy)
    out = retail.feature_table(Retail(spark, "/root/testdata/sf0.001"))
    wide = [(name, columns) for name, columns in written if "is_open" in columns]
    assert [name for name, _ in wide] == ["fact"] and sorted(wide[0][1]) == sorted(retail.SOURCES)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") - plan.count("Window [last(__l_") == 1
    assert out.count() > 0


def test_medians_of_small_groups_equal_those_of_ranges(spark):
    df = spark.createDataFrame([(i % 7 if i % 50 else None, float(i * 37 % 101) if i % 6 else None) for i in range(400)] + [(9, None)], "g int, x double").cache()
    sizes = df.groupBy("g").agg(F.count("x").alias("n"))
    want = {r["g"]: r["x"] for r in df.dropna(subset=["g"]).groupBy("g").agg(F.median("x").alias("x")).collect()}
    sorted_in_groups = {r["g"]: r["x"] for r in selection.medians_of_small_groups(df, ["g"], "x", sizes).collect()}
    by_ranges = {r["g"]: r["x"] for r in selection.medians_of_small_groups(df, ["g"], "x", sizes, limit=10).collect()}
    assert by_ranges == want and sorted_in_groups == {g: x for g, x in want.items() if x is not None}


@pytest.mark.parametrize("name, needed", [("retail_impute_rates", "state unemployment_rate trend_index"), ("retail_interactions", "type_code level_code distance_meters"), ("retail_label_encoding", "type_code level_code state weather_event")])
def test_queries_write_only_the_columns_they_need(spark, monkeypatch, name, needed):
    written, stage = [], retail.staged
    monkeypatch.setattr(retail, "staged", lambda df, name: written.append((name, sorted(df.columns))) or stage(df, name))
    assert retail.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
    assert written == [("fact", sorted(["store_id", "date", *needed.split()]))]


def test_training_writes_only_its_inputs(spark, monkeypatch):
    written, prepared = [], modelling.prepared
    monkeypatch.setattr(modelling, "prepared", lambda df: written.append(df.columns) or prepared(df))
    jobs._split(Retail(spark, "/root/testdata/sf0.001"))
    assert written == [["store_id", "date", "sales", "is_open", "is_train", *modelling.FEATURES]]


def test_staged_writes_leave_no_shuffle_files(spark):
    disk, listed = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager(), spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava
    files = lambda: {name for f in listed(disk.getAllFiles()) if (name := f.getName()).startswith("shuffle_")}
    before, old = files(), spark.conf.get(staging.CLEANUP)
    rows = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count().join(spark.range(5).withColumnRenamed("id", "k").hint("shuffle_hash"), "k")
    out = staging.staged(rows, "groups")
    for _ in range(50):  # files go a little later
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert not left and out.count() == 5 and spark.conf.get(staging.CLEANUP) == old


def test_prepared_rows_are_trained_on_where_they_lie(spark, monkeypatch):
    monkeypatch.setattr(modelling, "SHARE", 50)
    rows = modelling.prepared(spark.range(1000).coalesce(1))
    assert sorted(r[0] for r in rows.groupBy(F.spark_partition_id()).count().select("count").collect()) == [50] * 20
    same = modelling.dealt(rows, 50)
    assert "Repartition" not in same._jdf.queryExecution().optimizedPlan().toString() and same.count() == 1000
    skewed = spark.range(1000).repartition(20).where("id < 900").union(spark.range(900, 1000).coalesce(1))
    assert "Repartition 20" in modelling.dealt(skewed, 50)._jdf.queryExecution().optimizedPlan().toString()


def test_search_deals_and_writes_its_rows_once(spark, monkeypatch):
    df = spark.range(400).select((F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 7 + 1.0).alias("sales"), F.lit(1).alias("is_open"), F.lit(1).alias("is_train"))
    dealt, written, deal, stage = [], [], modelling.dealt, modelling.staged
    monkeypatch.setattr(modelling, "dealt", lambda rows, **least: dealt.append(rows) or deal(rows, **least))
    monkeypatch.setattr(modelling, "staged", lambda rows, name, *share: written.append((name, *share)) or stage(rows, name, *share))
    done = modelling.search(df, df, trials=3, features=["x"], ranges={"maxDepth": (1, 2), "maxIter": (1, 2)})
    assert len(done) == 3 and len(dealt) == 1 and written == [("search-input", modelling.SHARE), ("search-valid",)]
    assert [modelling.at_a_time(modelling.SHARE * n, 8, 4) for n in (1, 8, 9)] == [4, 4, 1]


def test_the_search_query_is_the_whole_search(spark, monkeypatch):
    asked, shape = [], inspect.signature(modelling.search)

    def spy(*given, **named):
        call = shape.bind(*given, **named)
        call.apply_defaults()
        asked.append(call.arguments)
        return [modelling.Trial({"maxDepth": 3}, 0.5, 2)]

    monkeypatch.setattr(modelling, "search", spy)
    monkeypatch.setattr(jobs, "_split", lambda t: (None, None))
    assert jobs.QUERIES["model_search"](spark, "/root/testdata/sf0.001").count() == 1
    assert asked[0]["trials"] == 100 and (asked[0]["ranges"] or modelling.RANGES) == modelling.RANGES and not asked[0]["options"]


def test_trained_submission_writes_the_facts_once_and_narrow(spark, monkeypatch):
    written, taken, stage, train = [], [], staging.staged, modelling.train
    for place in (jobs, X, modelling):
        monkeypatch.setattr(place, "staged", lambda df, name, *share: written.append((name, df.columns)) or stage(df, name, *share))
    monkeypatch.setattr(modelling, "train", lambda df, names, **options: taken.append((df, names)) or train(df, names, **options))
    t = Retail(spark, "/root/testdata/sf0.001")
    assert jobs.QUERIES["model_trained_submission"](spark, "/root/testdata/sf0.001").count() == t.requests.count()
    (rows, names), facts = taken[0], [columns for name, columns in written if name == "fact"]
    assert len(facts) == 1 and sorted(facts[0]) == sorted(retail.SOURCES)
    assert [columns for name, columns in written if name == "model-input"] == [["sales", "is_open", "is_train", *names]]
    of = lambda df: sorted(df.select(*(F.round(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), 6) for c in ("sales", *names))).collect())
    assert of(rows) == of(X.build_features(retail.fact(t), t.promo_days, t.promo).where("is_train = 1 AND is_open = 1"))


def test_training_features_are_those_of_open_training_rows(spark, monkeypatch):
    written, prepared = [], modelling.prepared
    monkeypatch.setattr(modelling, "prepared", lambda df: written.append(df) or prepared(df))
    t = Retail(spark, "/root/testdata/sf0.001")
    early, late = jobs._split(t)
    want = retail.feature_table(t).where("is_train = 1 AND is_open = 1").count()
    assert written[0].count() == want == early.count() + late.count()
