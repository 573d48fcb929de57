"""Registered queries of sources, the sales model and streaming, and their DuckDB twins."""

from __future__ import annotations

import functools
import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.operators import modelling as M
from quillmill.operators.evaluate import operative_metrics
from quillmill.operators.features import features_of
from quillmill.operators.records import is_quarantined, read_records
from quillmill.operators.relational import temporal_split
from quillmill.plans.analogues import Retail, retail_sql
from quillmill.plans.evaluation import LOG_SQL, Log, _lines
from quillmill.plans.retail import SOURCES, fact, feature_table, plain, settled
from quillmill.sources.staging import shared_folder, staged
from quillmill.sources import tables as S
from quillmill.sources.tables import inventory, read_lines
from quillmill.streaming.metrics import published_metrics, refreshed_metrics, windowed_metrics

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


@query("source_inventory", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in TABLES))
def table_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory({t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES})


@query(
    "source_sinks",
    " UNION ALL ".join(f"SELECT '{k}' AS sink, count(*) AS n, CAST(sum(s_suppkey) AS BIGINT) AS keys, round(sum(s_acctbal), 2) AS balance FROM supplier" for k in ("csv", "jsonl", "parquet")),
)
def sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table through each sink and back."""
    rows, at = spark.read.parquet(f"{sf_dir}/supplier.parquet"), f"{shared_folder(spark)}/sinks-{uuid.uuid4().hex}"
    S.write_parquet(rows, f"{at}/parquet")
    S.write_csv(rows, f"{at}/csv", "s_suppkey")
    S.write_jsonl(rows, f"{at}/jsonl")
    back = {"parquet": spark.read.parquet(f"{at}/parquet"), "csv": spark.read.schema(rows.schema).option("header", True).csv(f"{at}/csv"), "jsonl": spark.read.schema(rows.schema).json(f"{at}/jsonl")}
    sums = [df.agg(F.lit(k).alias("sink"), F.count("*").alias("n"), F.sum("s_suppkey").cast("bigint").alias("keys"), F.round(F.sum("s_acctbal"), 2).alias("balance")) for k, df in back.items()]
    return functools.reduce(DataFrame.unionByName, sums)


@query("source_nested_report", f"WITH {LOG_SQL} SELECT 'metrics' AS part, model_id, CAST(sum(requests) AS BIGINT) AS n FROM ops GROUP BY model_id UNION ALL SELECT 'scores', model_id, count(*) FROM scored GROUP BY model_id")
def nested_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of two parts, one of them as long as the log, written and read back."""
    t, at = Log(spark, sf_dir), f"{shared_folder(spark)}/report-{uuid.uuid4().hex}"
    S.write_nested_report({"metrics": operative_metrics(t.inference, t.prices), "scores": t.scored.select("test_id", "model_id", "score")}, at)
    field = lambda k: F.get_json_object("value", f"$.{k}")
    return spark.read.text(at).groupBy("part", field("model_id").alias("model_id")).agg(F.sum(F.coalesce(field("requests").cast("bigint"), F.lit(1))).alias("n"))


@query(
    "source_manifest",
    "SELECT place, 'job-' || (4 - place) AS job_id, count(DISTINCT event_type) AS n_artefacts, true AS dated FROM events, range(1, 4) r(place) GROUP BY place",
)
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three jobs' artefacts listed in their manifests and found among the past jobs, the newest first; a fourth manifest is broken."""
    at = f"{shared_folder(spark)}/jobs-{uuid.uuid4().hex}"
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type")
    events.repartition("event_type").write.partitionBy("event_type").parquet(f"{at}/data")
    for job in ("job-1", "job-2", "job-3"):
        S.write_manifest(spark, f"{at}/jobs/{job}", job, f"{at}/data")
    spark.createDataFrame([('{"job_id": "job-4", "created',)], "value string").coalesce(1).write.text(f"{at}/jobs/job-4/manifest.json")
    place = F.row_number().over(Window.orderBy(F.desc_nulls_last("created_at"))).cast("bigint")  # a row a job
    return S.list_jobs(spark, f"{at}/jobs").select(place.alias("place"), "job_id", F.size("artefacts").cast("bigint").alias("n_artefacts"), F.col("created_at").isNotNull().alias("dated"))


@query("source_model_dimension", "SELECT 'm' || n_nationkey AS model_id, n_name AS provider, CAST(n_nationkey + 1 AS DOUBLE) AS cost_input_1m, CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey * 2 + 1 AS DOUBLE) ELSE 0.0 END AS cost_output_1m FROM nation")
def model_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model list as a configuration gives it, some prices unknown; none of the models is the judge."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").collect()  # a table of fixed size, the list of models
    rows = [{"model_id": f"m{r['n_nationkey']}", "provider": r["n_name"], "cost_input_1m": r["n_nationkey"] + 1, "cost_output_1m": r["n_nationkey"] * 2 + 1 if r["n_nationkey"] % 2 == 0 else None} for r in nations]
    models = S.model_dimension(spark, rows)
    S.assert_judge_apart(models, "judge")
    return models


@query("source_datasets", "SELECT DISTINCT event_type, true AS filled FROM events")
def data_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data sets by suffix, a file for each type of event; files of another suffix are not listed."""
    at = f"{shared_folder(spark)}/sets-{uuid.uuid4().hex}"
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type").repartition("event_type")
    events.write.partitionBy("event_type").json(f"{at}/json")
    events.write.partitionBy("event_type").parquet(f"{at}/other")
    return S.datasets(spark, at, "*.json").select(F.regexp_extract("path", "event_type=([^/]*)/", 1).alias("event_type"), (F.col("length") > 0).alias("filled"))


@query("source_output_key", "SELECT 'results/job-7' AS key, count(*) AS n, CAST(sum(s_suppkey) AS BIGINT) AS keys FROM supplier")
def output_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same job writes twice: its own output is replaced, not doubled."""
    at, key = f"{shared_folder(spark)}/outputs-{uuid.uuid4().hex}", S.output_key("job-7")
    for _ in range(2):
        S.write_parquet(spark.read.parquet(f"{sf_dir}/supplier.parquet"), f"{at}/{key}")
    return spark.read.parquet(f"{at}/{key}").agg(F.lit(key).alias("key"), F.count("*").alias("n"), F.sum("s_suppkey").cast("bigint").alias("keys"))


@query("source_traces", "SELECT regexp_replace('call ' || event_type || '/' || (user_id % 3), '[^a-zA-Z0-9_-]', '_', 'g') AS name, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY ALL")
def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls appended in two goes, by day, under names made safe."""
    at = f"{shared_folder(spark)}/traces-{uuid.uuid4().hex}"
    calls = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", F.concat(F.lit("call "), F.col("event_type"), F.lit("/"), F.col("user_id") % 3).alias("name"))
    for part in (0, 1):
        S.append_traces(calls.where(F.col("event_id") % 2 == part), at, ["name"])
    return spark.read.parquet(at).groupBy("name", F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"))


@query("source_jsonl_round_trip", "SELECT count(*) FILTER (event_id % 10 NOT IN (5, 6)) AS n_records, count(*) FILTER (event_id % 10 = 5) AS n_quarantined FROM events")
def jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write records as lines, read them back, part good from bad."""
    path = f"{shared_folder(spark)}/records-{uuid.uuid4().hex}"
    _lines(Log(spark, sf_dir)).write.text(path)
    good, bad = read_records(read_lines(spark, path))
    return good.agg(F.count("*").alias("n_records")).crossJoin(bad.agg(F.count("*").alias("n_quarantined")))


_LOADED = ["nation", "customer", "orders"]


@query(
    "source_jdbc_snapshot",
    " UNION ALL ".join(f"SELECT 'APP.{t.upper()}' AS name, 'ok' AS first_run, 'present' AS second_run, count(*) AS n, CAST(sum({t[0]}_{k}) AS BIGINT) AS keys FROM {t}" for t, k in zip(_LOADED, ("nationkey", "custkey", "orderkey"), strict=True))
    + " UNION ALL SELECT 'APP.MISSING', 'failed', 'failed', NULL, NULL",
)
def jdbc_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given tables loaded into a database, copied out again by several tasks each, twice; one table does not exist.

    The database lives in this process, so the query is for a single machine; a cluster's tasks need a server's address.
    """
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", "/dev/null")
    at = f"{shared_folder(spark)}/snapshots-{uuid.uuid4().hex}"
    options = {"url": f"jdbc:derby:memory:quillmill{uuid.uuid4().hex};create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    for t in _LOADED:
        rows = spark.read.parquet(f"{sf_dir}/{t}.parquet")
        rows.select(*(F.col(c).cast("timestamp").alias(c) if k == "timestamp_ntz" else F.col(c) for c, k in rows.dtypes)).coalesce(4).write.format("jdbc").options(**options, dbtable=f"APP.{t}").save()
    names = {"APP": [*map(str.upper, _LOADED), "MISSING"]}
    split = {"NATION": "n_nationkey", "CUSTOMER": "c_custkey", "ORDERS": "o_orderkey"}
    runs = [S.snapshot_tables(spark, options, names, at, split, rows=1000) for _ in range(2)]
    outcomes = [(n, runs[0][n].split(":")[0], runs[1][n].split(":")[0]) for n in runs[0]]
    found = [spark.read.parquet(f"{at}/APP_{t.upper()}.parquet").agg(F.lit(f"APP.{t.upper()}").alias("name"), F.count("*").alias("n"), F.sum(split[t.upper()]).cast("bigint").alias("keys")) for t in _LOADED]
    return spark.createDataFrame(outcomes, "name string, first_run string, second_run string").join(functools.reduce(DataFrame.unionByName, found), "name", "left")


@query(
    "source_bad_lines",
    """SELECT part, line_no FROM (SELECT event_id % 3 AS part, event_id, row_number() OVER (PARTITION BY event_id % 3 ORDER BY event_id) AS line_no FROM events) WHERE event_id % 10 = 5""",
)
def bad_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are no record, by file and line, blank ones counted."""
    path = f"{shared_folder(spark)}/numbered-{uuid.uuid4().hex}"
    rows = _lines(Log(spark, sf_dir), "event_id").withColumn("part", F.col("event_id") % 3)
    rows.repartition("part").sortWithinPartitions("part", "event_id").select("value", "part").write.partitionBy("part").text(path)
    lines = read_lines(spark, path)
    found = S.line_numbers(lines, is_quarantined(F.col("value")))
    return found.select(F.regexp_extract("file", r"part=(\d+)", 1).cast("bigint").alias("part"), F.col("line_no").cast("bigint").alias("line_no"))


_SCORED = """
dow AS (SELECT store_id, isodow(date) AS d, avg(sales) AS p FROM sales GROUP BY ALL), st AS (SELECT store_id, avg(sales) AS a FROM sales GROUP BY 1)"""


@query(
    "model_baseline_errors",
    retail_sql("SELECT round(sqrt(avg(((sales - p) / sales) ** 2) FILTER (sales <> 0)), 6) AS rmspe, round(avg(abs(sales - p)), 4) AS mae FROM sales JOIN dow ON sales.store_id = dow.store_id AND isodow(date) = d", _SCORED),
)
def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Retail(spark, sf_dir)
    days = t.sales.withColumn("d", F.weekday("date"))
    both = days.join(days.groupBy("store_id", "d").agg(F.avg("sales").alias("prediction")), ["store_id", "d"])
    return M.rmspe(both).crossJoin(M.mae(both)).select(F.round("rmspe", 6).alias("rmspe"), F.round("mae", 4).alias("mae"))


def _request_features(t: Retail, needed: list[str] | None = None) -> DataFrame:
    return M.request_features(t.requests, history(t, needed), t.promo_days, t.promo, needed)


def history(t: Retail, needed: list[str] | None = None) -> DataFrame:
    """The training rows, written once, with the store's columns and those measures that the scorer needs."""
    rows = fact(t).where("is_train = 1")
    own = ["store_id", "date", "sales", "is_train", "state", "distance_meters", "open_since_month", "open_since_year"]
    measures = [*M.WEATHER, "gdp_index", "unemployment_rate", "consumer_confidence_index", "trend_index"]
    return staged(rows.select(*own, *(c for c in measures if needed is None or c in needed)), "history")


@query(
    "model_request_features",
    retail_sql(
        """SELECT id, round(round(coalesce(p, a, 0), 7), 4) AS store_dow_avg, round(round(coalesce(a, 0), 7), 4) AS store_avg_sales, round(coalesce(m, 0), 4) AS store_med_sales, round(round(coalesce(sm, 0), 7), 4) AS state_month_avg,
           round(coalesce(w, x.ta, 0), 4) AS temperature_avg, round(coalesce(u, x.ur, 0), 4) AS unemployment_rate, CASE WHEN pd.store_id IS NOT NULL THEN 1 ELSE 0 END AS promo
           FROM requests r LEFT JOIN dow ON r.store_id = dow.store_id AND isodow(r.date) = d LEFT JOIN st ON r.store_id = st.store_id
           LEFT JOIN (SELECT store_id, median(sales) AS m FROM sales GROUP BY 1) md ON r.store_id = md.store_id LEFT JOIN states z ON r.store_id = z.store_id
           LEFT JOIN (SELECT state, month(date) AS mm, avg(sales) AS sm, median(temperature_avg) AS w, median(unemployment_rate) AS u FROM fact WHERE is_train = 1 GROUP BY ALL) y ON z.state = y.state AND month(r.date) = mm
           CROSS JOIN (SELECT median(temperature_avg) AS ta, median(unemployment_rate) AS ur FROM fact WHERE is_train = 1) x
           LEFT JOIN (SELECT DISTINCT store_id, date FROM promo_days) pd ON r.store_id = pd.store_id AND r.date = pd.date""",
        _SCORED,
    ),
)
def request_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["store_dow_avg", "store_avg_sales", "store_med_sales", "state_month_avg", "temperature_avg", "unemployment_rate", "promo"]
    return settled(_request_features(Retail(spark, sf_dir)).select("id", *names), 4)


@query(
    "model_submission",
    retail_sql(
        "SELECT id, CASE WHEN is_open = 1 THEN round(round(greatest(coalesce(p, a, 0), 0), 6), 2) ELSE 0.0 END AS predicted_sales FROM requests r LEFT JOIN dow ON r.store_id = dow.store_id AND isodow(r.date) = d LEFT JOIN st ON r.store_id = st.store_id",
        _SCORED,
    ),
)
def submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch scores with the (store, weekday) mean as scorer, cleaned and complete."""
    t = Retail(spark, sf_dir)
    scores = M.batch_scores(_request_features(t, ["store_dow_avg"]), lambda df: df.withColumn("predicted_sales", F.round("store_dow_avg", 6)))
    return M.submission(t.requests, scores)


def _split(t: Retail) -> tuple[DataFrame, DataFrame]:
    """Features of the open training rows written once, parted at the last six weeks of training days."""
    rows = feature_table(t).select("store_id", "date", "sales", "is_open", "is_train", *M.FEATURES).where("is_train = 1 AND is_open = 1")
    early, late = temporal_split(M.prepared(rows))
    return early, late


@query("model_boosted_trees")
def trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train on the earlier part, report the error on the held-out weeks and the inputs' importances."""
    early, late = _split(Retail(spark, sf_dir))
    model = M.train(early, maxIter=5, maxDepth=4)
    error = M.rmspe(M.predict(model, late), p="predicted_sales").first()[0]
    return spark.createDataFrame([("rmspe", error), *M.importances(model)], "name string, value double")


@query("model_early_stopping")
def early_stopping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees added while they help on the held-out weeks: trees kept, their limit, RMSPE, and that of a constant."""
    early, late = _split(Retail(spark, sf_dir))
    model = M.train(early, held_out=late, maxIter=30, maxDepth=3, stepSize=0.4)
    errors = [M.rmspe(df, p="predicted_sales").first()[0] for df in (M.predict(model, late), M.mean_baseline(early, late))]
    rows = [("trees", float(M.n_trees(model))), ("limit", 30.0), ("rmspe", errors[0]), ("baseline_rmspe", errors[1])]
    return spark.createDataFrame(rows, "name string, value double")


@query("model_search")
def parameter_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model-based search on the temporal hold-out, a row a trial: all trials of the operator, over its whole ranges."""
    early, late = _split(Retail(spark, sf_dir))
    done = M.search(early, late)
    rows = [(i, json.dumps(t.params), t.trees, t.error, t is M.least(done)) for i, t in enumerate(done)]
    return spark.createDataFrame(rows, "trial int, params string, trees int, rmspe double, best boolean")


@query(
    "model_inputs",
    retail_sql("SELECT store_id, CAST(date AS VARCHAR) AS date, round(ln(1 + sales), 6) AS label, round(exp(ln(1 + sales)) - 1, 4) AS back, round(coalesce(trend_index, 0), 6) AS trend_index, round(coalesce(distance_meters, 0), 6) AS distance_meters FROM fact WHERE is_train = 1 AND is_open = 1"),
)
def inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the model is trained on: missing inputs as 0, the target on the log scale and back."""
    rows = M.model_inputs(fact(Retail(spark, sf_dir)), ["trend_index", "distance_meters"])
    return plain(rows.select("store_id", "date", F.round("label", 6).alias("label"), F.round(F.expm1("label"), 4).alias("back"), *(F.round(c, 6).alias(c) for c in ("trend_index", "distance_meters"))))


@query("model_persistence", retail_sql("SELECT 'day_of_week,month' AS features, true AS log_target, count(*) AS n, count(*) AS n_same FROM sales"))
def persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model saved with its metadata and loaded again predicts the same."""
    t, at = Retail(spark, sf_dir), f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"
    rows = staged(t.sales.withColumns({"is_train": F.lit(1), "day_of_week": F.weekday("date"), "month": F.month("date")}), "sales")
    model = M.train(rows, ["day_of_week", "month"], maxIter=3, maxDepth=3)
    M.save(model, at, {"maxIter": 3}, 0.0)
    loaded, meta = M.load(at, spark)
    both = M.predict(model, rows).withColumnRenamed("predicted_sales", "old")
    again = M.predict(loaded, both)
    return again.agg(F.lit(",".join(meta["features"])).alias("features"), F.lit(meta["log_target"]).alias("log_target"), F.count("*").alias("n"), F.count_if(F.col("old") == F.col("predicted_sales")).alias("n_same"))


@query("model_trained_submission")
def trained_submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests scored by the trained model, from features rebuilt out of the history; cleaned and complete."""
    t = Retail(spark, sf_dir)
    facts = staged(fact(t, *SOURCES), "fact")
    requests = staged(M.request_features(t.requests, facts.drop("promo"), t.promo_days, t.promo), "request-features")
    names = [c for c in M.FEATURES if c in requests.columns]
    table = M.prepared(features_of(facts, t.promo).where("is_train = 1 AND is_open = 1").select("sales", "is_open", "is_train", *names))
    model = M.train(table, names, maxIter=5, maxDepth=4)
    return M.submission(t.requests, M.batch_scores(requests, lambda df: M.predict(model, df)))


@query(
    "model_forecast",
    retail_sql(
        """SELECT s.store_id, CAST(date AS VARCHAR) AS date, round(round(coalesce(p, a, 0), 6), 2) AS predicted_sales FROM stores s,
           (SELECT CAST(unnest(generate_series(DATE '2001-09-01', DATE '2001-10-12', INTERVAL 1 DAY)) AS DATE) AS date) LEFT JOIN dow ON s.store_id = dow.store_id AND isodow(date) = d LEFT JOIN st ON s.store_id = st.store_id""",
        _SCORED,
    ),
)
def forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Retail(spark, sf_dir)
    days = staged(M.forecast_frame(t.stores, "2001-09-01", "2001-10-12"), "days")  # generated rows: joins need their real size
    found = M.request_features(days, history(t, ["store_dow_avg"]), t.promo_days, t.promo, ["store_dow_avg"])
    scores = M.batch_scores(found, lambda df: df.withColumn("predicted_sales", F.round("store_dow_avg", 6)))
    return plain(days.join(scores, "id").select("store_id", "date", "predicted_sales"))


@query("stream_operative_metrics", f"WITH {LOG_SQL} SELECT * FROM ops")
def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics of the log read as a stream; equal to those of the batch."""
    t, at = Log(spark, sf_dir), f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    t.inference.repartition(4).write.parquet(f"{at}/log")  # the folder into which the log arrives
    arriving = spark.readStream.schema(t.inference.schema).option("maxFilesPerTrigger", 2).parquet(f"{at}/log")
    refreshed_metrics(arriving, t.prices, f"{at}/out", f"{at}/state", None).awaitTermination()
    return published_metrics(spark, f"{at}/out")


@query(
    "stream_windowed_metrics",
    f"WITH {LOG_SQL} SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, 'm' || (user_id % 4) AS model_id, count(*) AS requests, count(*) FILTER (event_id % 11 = 0) AS errors FROM events GROUP BY ALL",
)
def windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as a stream, then rows that come too late and count for nothing, and one that closes the last window."""
    log, at = Log(spark, sf_dir).inference.select("ts", "model_id", "success", "latency_ms"), f"{shared_folder(spark)}/windows-{uuid.uuid4().hex}"
    end = log.agg(F.max("ts").alias("last"), F.min("ts").alias("first"))
    late = log.where("latency_ms IS NOT NULL").crossJoin(F.broadcast(end)).where(F.col("ts") < F.col("last") - F.expr("interval 1 day")).select("ts", F.lit("late").alias("model_id"), "success", "latency_ms")
    closing = lambda days: end.select((F.col("last") + F.expr(f"interval {days} days")).alias("ts"), F.lit("end").alias("model_id"), F.lit(True).alias("success"), F.lit(0.0).alias("latency_ms"))
    for rows in (log, late, closing(2), closing(9)):
        rows.write.mode("append").parquet(f"{at}/log")
        arriving = windowed_metrics(spark.readStream.schema(log.schema).parquet(f"{at}/log"))
        sink = arriving.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{at}/state").option("path", f"{at}/out")
        sink.trigger(availableNow=True).start().awaitTermination()
    w = spark.read.parquet(f"{at}/out").where("model_id <> 'end'")
    return w.select(F.date_format("w.start", "yyyy-MM-dd HH").alias("hour"), "model_id", "requests", "errors")


