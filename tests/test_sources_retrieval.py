"""JDBC snapshots, line numbers, the validated log, report sheets, exact search by pivots and the vector table."""

import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from quillmill.operators import evaluate as E
from quillmill.operators import records as N
from quillmill.operators import retrieval as V
from quillmill.operators import vectors
from quillmill.sources import tables as S


def test_snapshots_read_in_parts_and_once(spark, tmp_path):
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", "/dev/null")
    options = {"url": f"jdbc:derby:memory:t{uuid.uuid4().hex};create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    for name, n in (("BIG", 1000), ("ONE", 1)):
        spark.range(n).select("id", (F.col("id") * 2).alias("twice")).write.format("jdbc").options(**options, dbtable=f"APP.{name}").save()
    split = S.jdbc_split(spark, options, "APP.BIG", "ID", 100)
    assert split == {"partitionColumn": "id", "lowerBound": "0", "upperBound": "999", "numPartitions": "10"}
    assert spark.read.format("jdbc").options(**options, **split, dbtable="APP.BIG").load().rdd.getNumPartitions() == 10
    assert S.jdbc_split(spark, options, "APP.ONE", "id") == {}  # one value can't be split
    run = lambda: S.snapshot_tables(spark, options, {"APP": ["BIG", "NONE", "ONE"]}, str(tmp_path), {"BIG": "id", "ONE": "id"}, rows=100)
    first = run()
    assert first["APP.BIG"] == first["APP.ONE"] == "ok" and first["APP.NONE"].startswith("failed")
    got = spark.read.parquet(f"{tmp_path}/APP_BIG.parquet")
    assert got.agg(F.count("*"), F.sum("twice")).first()[:] == (1000, 999_000)
    spark.range(5).write.mode("overwrite").format("jdbc").options(**options, dbtable="APP.BIG").save()
    assert run()["APP.BIG"] == "present" and spark.read.parquet(f"{tmp_path}/APP_BIG.parquet").count() == 1000


def test_bad_lines_have_their_numbers_in_files_of_several_splits(spark, tmp_path):
    draw, want = random.Random(2), []
    for f in range(3):
        with open(tmp_path / f"f{f}.jsonl", "w") as out:
            for i in range(1, 2001):
                bad = draw.random() < 0.02
                out.write(("{cut" if bad else "" if draw.random() < 0.1 else json.dumps({"a": "x" * draw.randint(0, 40)})) + "\n")
                if bad:
                    want.append((f"f{f}.jsonl", i))
    conf = {"spark.sql.files.maxPartitionBytes": "10000", "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        lines = S.read_lines(spark, str(tmp_path))
        assert lines.select("file", "block").distinct().count() > 9
        got = S.line_numbers(lines, N.is_quarantined(F.col("value"))).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted((r["file"].rsplit("/", 1)[1], r["line_no"]) for r in got) == sorted(want) and {r["value"] for r in got} == {"{cut"}


def test_log_is_validated_and_retries_merged(spark):
    call = lambda **x: json.dumps({"test_id": "t", "model_id": "m", "retries": 0, "success": True, "latency_ms": 1.5} | x)
    lines = [call(), call(retries=2, success=False, ts="2024-01-01 00:00:00"), call(retries=2, ts="2024-01-02 00:00:00"), call(test_id="u", extra=1), call(test_id=None), call(model_id=""), call(latency_ms=-1), call(retries="x"), "{", "  ", "[1]", call(test_id="v", latency_ms=None)]
    good, bad = E.validated_log(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert {(r["test_id"], r["retries"], r["success"]) for r in good.collect()} == {("t", 2, True), ("u", 0, True), ("v", 0, True)}
    assert sorted(r["reason"] for r in bad.collect()) == ["malformed"] * 3 + ["negative", "no key", "no key"]


def test_sheets(spark):
    rows = [("t1", "a", "x", 0.9, True, "out a", "old", "old", None, 1), ("t1", "b", "x", 0.1, False, "o" * 600, "other", "old", None, 2), ("t2", "b", "y", 0.5, True, None, None, "z", None, 3)]
    scored = spark.createDataFrame(rows, "test_id string, model_id string, task string, score double, correct boolean, output_text string, legacy_output string, ground_truth string, error string, seq long")
    assert E.models_of(scored) == ["a", "b"]
    with pytest.raises(ValueError):
        E.models_of(scored, 1)
    got = {r["test_id"]: r.asDict() for r in E.verdict_sheet(scored, ["a", "b", "c"]).collect()}
    assert got["t1"]["a verdict"] == "CORRECT" and got["t1"]["b output"] == "o" * 500 and got["t1"]["legacy_verdict"] == "CORRECT" and got["t1"]["c verdict"] == "N/A"
    assert got["t2"]["a output"] == "" and got["t2"]["a verdict"] == "N/A" and got["t2"]["b output"] == "" and got["t2"]["legacy_verdict"] == "N/A"
    over = {r["Model"]: r[1:] for r in E.overview_sheet(E.score_aggregates(scored), ["x", "y"]).collect()}
    assert over == {"a": ("0.900", "", "0.900"), "b": ("0.100", "0.500", "0.300")}


def test_nearest_by_pivots_is_exact_and_visits_few(spark):
    draw = random.Random(9)
    centres = [[draw.uniform(-10, 10) for _ in range(8)] for _ in range(25)]
    rows = [(i, [x + draw.gauss(0, 0.3) for x in centres[i % 25 if i < 1800 else 0]]) for i in range(2400)]  # a third in one cluster
    rows += [(3000 + i, rows[i][1]) for i in range(10)]
    items = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(4)
    queries = items.where("id % 40 = 0")
    got = [(r["query_id"], r["id"], r["rank"]) for r in V.nearest(items, queries).collect()]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b)) ** 0.5
    want = [(q, i, k) for q, v in rows if q % 40 == 0 for k, (_, i) in enumerate(sorted((far(v, w), i) for i, w in rows)[:5], 1)]
    assert sorted(got) == sorted(want)
    visited = V.pairs(items, queries).count()
    assert visited < 0.3 * len(rows) * queries.count()
    assert V.nearest(items.limit(0), queries).count() == 0 and V.nearest(items, queries.limit(0)).count() == 0
    some = items.where("id < 3").unionByName(spark.createDataFrame([(7, None)], "id long, embedding array<double>"))
    assert V.nearest(some, some).count() == 9  # a null vector neither asks nor is found


def test_vector_table_computes_changed_documents_only(spark, tmp_path):
    path = f"{tmp_path}/table"
    docs = spark.createDataFrame([(i, f"store {i} sells {'soap' if i % 2 else 'tea'} and {i % 5} more") for i in range(40)] + [(99, "—"), (98, None)], "id long, content string")
    assert vectors.upsert_vectors(docs, path).count() == 42
    first = {r["id"]: list(r["embedding"]) for r in vectors.read_vectors(spark, path).collect()}
    assert all(abs(sum(x * x for x in v) - 1) < 1e-9 for i, v in first.items() if i < 90) and not any(first[99]) and not any(first[98])
    assert vectors.upsert_vectors(docs, path).count() == 0
    changed = docs.where("id IN (3, 4)").withColumn("content", F.lit("nothing but tea")).unionByName(spark.createDataFrame([(200, "new soap")], "id long, content string"))
    assert sorted(r["id"] for r in vectors.upsert_vectors(changed, path).collect()) == [3, 4, 200]
    second = {r["id"]: list(r["embedding"]) for r in vectors.read_vectors(spark, path).collect()}
    assert second.keys() == first.keys() | {200} and all(second[i] == first[i] for i in first if i not in (3, 4)) and second[3] == second[4] != first[4]
