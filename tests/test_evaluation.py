"""Evaluation, records, retrieval, sources and streaming on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.operators import evaluate as E
from quillmill.operators import records as N
from quillmill.operators import retrieval as V
from quillmill.plans.task_rules import RULES, task_rules
from quillmill.sources import tables as S
from quillmill.streaming.metrics import published_metrics, refreshed_metrics, windowed_metrics

SCORED = "test_id string, model_id string, task string, score double, correct boolean, output_text string, legacy_output string, ground_truth string, error string"


def one(spark, *values):
    """The value of a Column function over literal strings."""
    *args, f = values
    df = spark.createDataFrame([tuple(args)], ", ".join(f"c{i} string" for i in range(len(args))))
    return df.select(f(*(F.col(f"c{i}") for i in range(len(args))))).first()[0]


@pytest.fixture(scope="module")
def scored(spark):
    rows = [("t1", "m-a", "classification", 0.9, True, None, None, "x", None), ("t2", "m-a", "classification", 0.3, False, None, None, "x", "timeout"),
            ("t1", "m-b", "classification", 0.8, True, None, None, "x", None), ("t3", "m-a", "context_qa", 0.7, True, "Rome", "Roma", "x", None)]
    return spark.createDataFrame(rows, SCORED)


def test_aggregates_and_best(scored):
    agg = {(r["task"], r["model_id"]): r for r in E.score_aggregates(scored).collect()}
    assert round(agg["classification", "m-a"]["avg_score"], 3) == 0.6 and agg["classification", "m-a"]["accuracy"] == 0.5
    assert round(agg[None, "m-a"]["avg_score"], 3) == 0.633 and round(agg[None, "m-a"]["accuracy"], 3) == 0.667
    best = {r["task"]: r["model_id"] for r in E.best_models(E.score_aggregates(scored)).collect()}
    assert best == {"classification": "m-b", "context_qa": "m-a", "Overall": "m-b"}


def test_operative_metrics(spark):
    rows = [("t1", "m-a", "classification", True, 150.0, 0, 100, 10), ("t2", "m-a", "classification", True, 200.0, 1, 120, 15), ("t3", "m-a", "context_qa", True, 300.0, 0, 500, 50), ("t1", "m-b", "classification", False, 180.0, 0, 100, 12)]
    log = spark.createDataFrame(rows, "test_id string, model_id string, task string, success boolean, latency_ms double, retries int, input_tokens long, output_tokens long")
    prices = spark.createDataFrame([("m-a", 0.08, 0.35)], "model_id string, cost_input_1m double, cost_output_1m double")
    got = {(r["model_id"], r["task"]): r for r in E.operative_metrics(log, prices).collect()}
    a, b = got["m-a", "classification"], got["m-b", "classification"]
    assert (a["requests"], a["retries"], a["avg_latency_ms"], a["cost"]) == (2, 1, 175.0, round((220 * 0.08 + 25 * 0.35) / 1e6, 6))
    assert (b["errors"], b["avg_latency_ms"], b["cost"]) == (1, None, 0.0)


def test_matches(spark):
    assert one(spark, " Yes\t", "yes", T.exact_match) == 1 and one(spark, "", "yes", T.contains_match) == 1 and one(spark, "yes", None, T.contains_match) == 0
    assert one(spark, "a b b", "b c", T.token_f1) == 0.5 and one(spark, "", "b", T.token_f1) == 0
    assert one(spark, "a b", "a b c d", T.length_ratio) == 0.5 and one(spark, "a b c d", None, T.length_ratio) == 1 and one(spark, "a", "", T.length_ratio) == 0.5 and one(spark, " ", "x", T.length_ratio) == 0
    assert one(spark, None, "x", T.legacy_verdict) == "N/A" and one(spark, "Rome", "Roma", T.legacy_verdict) == "INCORRECT" and one(spark, "in Rome", "rome", T.legacy_verdict) == "CORRECT"


def test_json_metrics(spark):
    assert [one(spark, x, T.json_validity) for x in ('{"a": 1}', 'so {"a": 1} ok', "none", "")] == [1, 0.8, 0, 0]
    assert one(spark, '{"a": "X ", "b": 2}', '{"a": "x", "c": 1}', T.json_key_match) == 0.5
    assert one(spark, '{"a": "X ", "b": 2}', '{"a": "x", "b": 3}', T.json_value_match) == 0.5
    assert one(spark, "[1]", '{"a": 1}', T.json_key_match) == 0 and one(spark, "x", '{"a": 1}', T.json_value_match) == 0
    assert one(spark, '{"name": "n", "items": ["a", "b", "cu', lambda c: T.json_string_list(c, "items")) == ["a", "b"]
    assert one(spark, 'Score: {"score": 7}', T.clamp_score) == 1 and one(spark, "bad", T.clamp_score) == 0


def test_sql_metrics(spark):
    assert [one(spark, x, T.sql_syntax) for x in ("", "hello", "SELECT 1", "-- c\nwith x as (select 1)", "do select it")] == [0, 0, 1, 1, 0.5]
    assert one(spark, "```sql\nselect a from t\n```", "SELECT a FROM t -- x", T.sql_similarity) == 1
    assert one(spark, "text ```python\nx = 1\n``` end", lambda c: T.fenced(c, "python")) == "x = 1\n"


def test_pii(spark):
    text = "mail a@b.com, 555-123-4567, 123-45-6789, 4111111111111111"
    assert set(one(spark, text, T.pii_entities)) == {"a@b.com", "555-123-4567", "123-45-6789", "4111111111111111"}
    r = one(spark, text, "mail [X], 555-123-4567", None, T.redaction)
    assert (r["recall"], r["precision"], r["leaked"], r["entities_found"]) == (0.75, 1.0, 1, 4)
    r = one(spark, "none", "new a@b.com", None, T.redaction)
    assert (r["precision"], r["recall"], r["f1"]) == (0.0, 1.0, 0.0)
    r = one(spark, "a@b.com c@d.com", "[X] c@d.com e@f.com", "[X] c@d.com", T.redaction)
    assert (r["precision"], r["recall"], r["f1"]) == (0.5, 1.0, 0.667)


def test_intents(spark):
    assert one(spark, "1. Refund\n2) Cancel ", T.ranked_intents) == ["refund", "cancel"]
    assert one(spark, "refund, cancel; other", T.ranked_intents) == ["refund", "cancel", "other"] and one(spark, "refund", T.ranked_intents) == []
    assert one(spark, "What about store #12?", T.entity_id) == 12 and one(spark, "hello", T.entity_id) is None


def test_composite_weights(spark):
    rows = [("classification", "yes", "yes", 0.5), ("classification", "x", "", 0.4), ("metadata_extraction", "{}", None, 0.5), ("sql_generation", "select 1", None, 1.0), ("context_qa", "a", "a", 0.5), ("nothing", "a", "a", 1.0)]
    df = spark.createDataFrame(rows, "task string, o string, t string, j double")
    c = lambda x: F.col(x)
    got = [r[0] for r in df.select(E.composite(c("task"), c("o"), c("t"), c("j"), F.lit(""))).collect()]
    assert [None if x is None else round(x, 6) for x in got] == [0.75, 0.4, 0.65, 1.0, 0.7, None]


def test_evaluate_failures_and_judge(spark):
    rows = [("t1", "m", "classification", False, "yes", "yes", 1.0, ""), ("t2", "judge", "classification", True, "yes", "yes", 1.0, ""), ("t3", "m", "unknown", True, "yes", "yes", 1.0, "")]
    got = E.evaluate(spark.createDataFrame(rows, "test_id string, model_id string, task string, success boolean, output_text string, ground_truth string, judge_score double, given string"), "judge").collect()
    assert [(r["test_id"], r["score"], r["correct"]) for r in got] == [("t1", 0.0, False)]


def test_insights(scored):
    p = {r["task"]: r for r in E.error_patterns(scored).collect()}
    assert p["classification"]["severity"] == "low" and p["classification"]["sample_ids"] == ["t2"] and p["classification"]["worst_model"] == "m-a"
    kinds = E.anomalies(scored).collect()
    assert [(r["kind"], r["model_id"]) for r in kinds] == [(1, "m-a")]
    assert [tuple(r) for r in E.failure_ids(scored).collect()] == [("classification", "t2")]
    assert [tuple(r) for r in E.failure_counts(scored).collect()] == [("classification", "m-a", 1)]


def test_paired_test_and_bootstrap(spark):
    a = spark.createDataFrame([(str(i), 0.1 * (i % 5)) for i in range(30)], "test_id string, score double")
    b = a.withColumn("score", F.col("score") + 0.1 + F.when(F.col("test_id") == "3", 0.05).otherwise(0))
    r = E.paired_t_test(a, b).first()
    assert r["n"] == 30 and r["significant"] and r["p"] < 1e-4
    assert E.paired_t_test(a.limit(1), b).count() == 0
    assert abs(E._t_tail(2.0, 10) - 0.036694) < 1e-5 and abs(E._t_tail(-1.0, 3) - 0.804499) < 1e-5
    ci = E.bootstrap_interval(a, b, rounds=200).first()
    assert 0.09 < ci["low"] <= ci["high"] < 0.12 and ci["significant"]


def test_selection_and_ablation(spark):
    shape = "iteration int, variant string, avg_score double, n_correct long"
    rows = [(0, "base", 0.5, 5), (1, "a", 0.6, 6), (1, "b", 0.55, 5), (2, "c", 0.605, 6), (3, "d", 0.9, 9)]
    history = lambda x: [tuple(r) for r in E.iterative_selection(spark.createDataFrame(x, shape)).orderBy("iteration").collect()]
    start = [(0, "base", 0.5, 5, True, False), (1, "a", 0.6, 6, False, False)]
    assert history(rows) == [*start, (2, "c", 0.605, 6, False, True)]
    rows[3] = (2, "c", 0.59, 5)  # nothing better: the incumbent is shown
    assert history(rows) == [*start, (2, "a", 0.6, 6, False, True)]
    h = spark.createDataFrame([(0, "be brief", 0.5), (1, "be very kind", 0.4)], "iteration int, prompt string, avg_score double")
    r = E.ablation(h).first()
    assert (r["delta"], r["added"], r["removed"], r["effect"]) == (-0.1, ["very", "kind"], ["brief"], "negative")


def record(**changes):
    base = {"test_id": "t001", "input_messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}], "ground_truth": "p", "expected_output_type": "label", "metadata": {}, "agent_id": "agent_01", "output": "p"}
    return {k: v for k, v in (base | changes).items() if v != "DROP"}


def test_records(spark):
    lines = [json.dumps(record(**c)) for c in ({}, {"ground_truth": None}, {"output": "DROP"}, {"input_messages": "text"}, {"input_messages": []}, {"input_messages": [{"role": "user", "content": "u"}]}, {"agent_id": None})]
    good, bad = N.read_records(spark.createDataFrame([(x,) for x in [*lines, "  ", '{"cut', "[1]"]], "value string"))
    rows = good.withColumn("valid", N.is_valid(F.col("keys"), F.col("messages"))).cache()
    assert [r["valid"] for r in rows.collect()] == [True, True, False, False, False, False, True] and bad.count() == 2
    got = {r["agent_id"]: r for r in N.agent_profile(rows).collect()}
    assert (got["agent_01"]["n_records"], got["agent_01"]["n_malformed"], got["agent_01"]["pct_ground_truth"]) == (6, 4, 50.0)
    assert got["unknown"]["pct_ground_truth"] == 100.0


def test_labels_and_tasks(spark):
    assert [one(spark, x, N.normal_label) for x in (" SQL-Generation", "it is a translation.", "none")] == ["sql_generation", "translation", None]
    scores = spark.createDataFrame([("a", "summarization", 3.0), ("a", "translation", 3.0), ("b", "translation", 0.0)], "agent_id string, task string, score double")
    assert dict(N.choose_task(scores).collect()) == {"a": "translation", "b": "classification"}
    assert one(spark, "classification", N.output_type) == "label" and one(spark, "rephrasing", N.output_type) == "text" and N.edge_quota(3) == 2


def test_retrieval(spark):
    items = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(10)], "id long, embedding array<double>")
    hits = V.nearest(items, items.where("id = 3"), k=3)
    assert [r["id"] for r in hits.orderBy("rank").collect()] == [3, 2, 4]
    q = spark.createDataFrame([(3, "sales of store 9?")], "query_id long, question string")
    forced = V.forced_context(hits, q, k=3)
    assert [r["id"] for r in forced.orderBy("rank").collect()] == [9, 3, 2]
    docs = spark.createDataFrame([(i, f"doc {i}") for i in range(10)], "store_id long, content string")
    assert V.context(forced, docs).first()["context"] == "doc 9\n\ndoc 3\n\ndoc 2"


def test_sources(spark, tmp_path):
    with pytest.raises(ValueError):
        S.model_dimension(spark, [])
    with pytest.raises(ValueError):
        S.model_dimension(spark, [{"provider": "x"}])
    models = S.model_dimension(spark, [{"model_id": "m", "cost_input_1m": 1}])
    with pytest.raises(ValueError):
        S.assert_judge_apart(models, "m")
    S.write_csv(models, f"{tmp_path}/c", "model_id")
    S.write_jsonl(models, f"{tmp_path}/data.jsonl")
    S.write_nested_report({"models": models, "again": models}, f"{tmp_path}/r")
    assert spark.read.option("header", True).csv(f"{tmp_path}/c").first()["model_id"] == "m"
    assert {(r["part"], json.loads(r["value"])["model_id"]) for r in spark.read.text(f"{tmp_path}/r").collect()} == {("models", "m"), ("again", "m")}
    S.write_manifest(spark, f"{tmp_path}/jobs/j1", "j1", f"{tmp_path}/c")
    assert S.list_jobs(spark, f"{tmp_path}/jobs").first()["job_id"] == "j1"
    assert S.output_key(job_id="7") == "results/7" and S.output_key("7", "p/") == "p" and S.output_key().startswith("results/")
    calls = spark.createDataFrame([("a b/c", "2024-01-01 10:00:00")], "name string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    S.append_traces(calls, f"{tmp_path}/t", ["name"])
    assert spark.read.parquet(f"{tmp_path}/t").first()["name"] == "a_b_c"
    done = S.snapshot_tables(spark, {"url": "jdbc:none:x"}, {"raw": ["a", "b"]}, f"{tmp_path}/s")
    assert set(done) == {"raw.a", "raw.b"} and all(v.startswith("failed") for v in done.values())
    assert S.inventory({"m": models}).first()["n"] == 1


def test_windows_of_a_log_without_zone_drop_late_rows(spark, tmp_path):
    schema = "ts timestamp_ntz, model_id string, success boolean, latency_ms double"
    arrive = lambda *rows: spark.createDataFrame(
        [(ts, m, ok, ms) for ts, m, ok, ms in rows], "ts string, model_id string, success boolean, latency_ms double"
    ).withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.mode("append").parquet(f"{tmp_path}/log")

    def take() -> list:
        stream = windowed_metrics(spark.readStream.schema(schema).parquet(f"{tmp_path}/log"))
        sink = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out")
        sink.trigger(availableNow=True).start().awaitTermination()
        out = spark.read.parquet(f"{tmp_path}/out").select(F.date_format("w.start", "HH"), "model_id", "requests", "errors", "avg_latency_ms")
        return sorted(tuple(r) for r in out.collect())

    arrive(("2024-01-01 10:05:00", "a", True, 10.0), ("2024-01-01 10:50:00", "a", False, 90.0), ("2024-01-01 11:30:00", "a", True, 20.0))
    assert take() == [("10", "a", 2, 1, 10.0)]  # 11 o'clock is still open
    arrive(("2024-01-01 10:59:00", "a", True, 1.0), ("2024-01-01 11:31:00", "a", True, 40.0), ("2024-01-01 13:00:00", "b", True, 5.0))  # the first is late
    assert take() == [("10", "a", 2, 1, 10.0), ("11", "a", 2, 0, 30.0)]
    batch = windowed_metrics(spark.read.schema(schema).parquet(f"{tmp_path}/log"))
    assert {(r["requests"], r["errors"]) for r in batch.where("model_id = 'a'").collect()} == {(3, 1), (2, 0)}


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"m{i % 2}", f"t{i % 3}", i % 4 != 0, float(i), i % 2, i, 1) for i in range(40)]
    log = spark.createDataFrame(rows, "model_id string, task string, success boolean, latency_ms double, retries int, input_tokens long, output_tokens long")
    log.repartition(3).write.parquet(f"{tmp_path}/log")
    prices = spark.createDataFrame([("m0", 1.0, 2.0)], "model_id string, cost_input_1m double, cost_output_1m double")
    stream = spark.readStream.schema(log.schema).parquet(f"{tmp_path}/log")
    refreshed_metrics(stream, prices, f"{tmp_path}/out", f"{tmp_path}/state", None).awaitTermination()
    batch = E.operative_metrics(log, prices)
    assert sorted(map(str, published_metrics(spark, f"{tmp_path}/out").select(batch.columns).collect())) == sorted(map(str, batch.collect()))


def test_verdicts_of_long_texts(spark):
    """Whole texts are judged, and the first row's header and the last row's output count."""
    a, tail = "x" * 500, " legacy text"
    rows = [
        ("t1", "m", "qa", True, "out", a + tail, "legacy text", 1), ("t2", "m", "qa", False, "old", a + " other", a + tail, 2), ("t3", "m", "qa", None, a + tail, a, None, 3),
        ("t2", "m", "sql", True, "new", None, None, 4), ("t2", "n", "sql", False, "n", None, None, 5),
    ]
    log = spark.createDataFrame(rows, "test_id string, model_id string, task string, correct boolean, output_text string, legacy_output string, ground_truth string, seq long")
    got = {(r["test_id"], r["model_id"]): r for r in E.verdict_table(log).collect()}
    assert {k: (r["legacy_verdict"], r["verdict"], r["task"]) for k, r in got.items()} == {
        ("t1", "m"): ("CORRECT", "CORRECT", "qa"), ("t2", "m"): ("INCORRECT", "CORRECT", "qa"), ("t2", "n"): ("INCORRECT", "INCORRECT", "qa"), ("t3", "m"): ("N/A", "INCORRECT", "qa")
    }
    assert got["t2", "m"]["output_text"] == "new" and got["t3", "m"]["output_text"] == got["t1", "m"]["legacy_output"] == a


def test_feedback(spark):
    rows = [(0.9, True, None), (0.2, False, "timeout"), (0.3, False, "refused"), (0.1, False, "timeout")]
    log = spark.createDataFrame([("m", *r) for r in rows], "model_id string, score double, correct boolean, error string")
    assert E.feedback(log, ["model_id"]).first()["feedback"] == "Average score: 0.375\nRecords evaluated: 4\nCorrect: 1/4 (25.0%)\nCommon errors: timeout; refused"
    shape = "a double, n long, c long, e array<string>"
    given = [(None, None, None, None), (0.5, 0, 0, []), (None, 0, 0, None), (0.25, 3, None, ["a", "b", "c", "d"])]
    got = [r[0] for r in spark.createDataFrame(given, shape).select(E.feedback_text(F.col("a"), F.col("n"), F.col("c"), F.col("e"))).collect()]
    assert got == ["No previous evaluation available.", "Average score: 0.500", "Score below target.", "Average score: 0.250\nRecords evaluated: 3\nCorrect: 0/3 (0.0%)\nCommon errors: a; b; c"]


def test_task_rules(spark):
    """One rule for each pattern; an output of type text alone speaks for the tasks of text, of which the first listed wins."""
    assert len(RULES) == len(set(RULES)) == 201 and sum(f == "output" for _, f, _ in RULES) == 11
    samples = spark.createDataFrame([("a", "", "", "text")], "agent_id string, system_text string, user_text string, output_type string")
    scores = N.task_scores(samples, task_rules(spark))
    got = {r["task"]: r["score"] for r in scores.collect()}
    assert got["context_qa"] == got["pii_redaction"] == got["translation"] == 5.0 and got["classification"] == 0.0
    assert N.choose_task(scores).first()["task"] == "context_qa"


def test_json_truth_has_to_be_whole(spark):
    assert one(spark, '{"a": 1}', 'so {"a": 1}', T.json_key_match) == 0 and one(spark, '{"a": 1}', 'so {"a": 1}', T.json_value_match) == 0
    assert one(spark, 'so {"a": 1}', '{"a": 1}', T.json_value_match) == 1


def test_code_outcomes(spark):
    rows = [("t1", None, None, None), ("t2", 1.0, None, None), ("t3", 1.0, 0.5, None), ("t4", 1.0, 0.5, 1.0), ("t5", None, None, 1.0)]
    log = spark.createDataFrame(rows, "test_id string, code_syntax double, code_run double, code_tests double").select(
        "*", F.lit("m").alias("model_id"), F.lit("code_generation").alias("task"), F.lit(True).alias("success"), F.lit("x").alias("output_text"), F.lit("y").alias("ground_truth"), F.lit(0.4).alias("judge_score"), F.lit("").alias("given")
    )
    assert {r["test_id"]: r["score"] for r in E.evaluate(log).collect()} == {"t1": 0.28, "t2": 0.58, "t3": 0.505, "t4": 0.625, "t5": 0.45}


def test_nearest_in_crowded_pivots(spark, monkeypatch):
    items = spark.createDataFrame([(i, [float(i * i % 17), float(i % 5)]) for i in range(40)], "id long, embedding array<double>")
    found = lambda: sorted(map(tuple, V.nearest(items, items.where("id % 4 = 0"), k=3).collect()))
    whole = found()
    monkeypatch.setattr(V, "CROWD", 3)  # a pivot's items in several parts
    assert found() == whole and len(whole) == 30
