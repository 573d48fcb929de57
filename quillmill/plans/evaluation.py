"""Registered evaluation queries and their DuckDB twins, over conversations, events, documents and benchmark."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.operators import evaluate as E
from quillmill.operators import records as N
from quillmill.operators import retrieval as V
from quillmill.operators.features import continuous_promo, promo_flag
from quillmill.operators.relational import membership, restrict_or_all
from quillmill.operators.vectors import read_vectors, upsert_vectors
from quillmill.plans.analogues import Retail, retail_sql
from quillmill.plans.retail import rounded, staged_fact
from quillmill.plans.task_rules import RULES, task_rules
from quillmill.sources.staging import shared_folder, staged

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


class Log:
    """Test records and inference logs derived from the given tables."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
        self.read = read
        e = read("events")
        i = F.col("event_id")
        self.inference = e.select(
            i.cast("string").alias("test_id"), F.concat(F.lit("m"), F.col("user_id") % 4).alias("model_id"), F.col("event_type").alias("task"), (i % 11 != 0).alias("success"),
            F.col("value").alias("latency_ms"), (i % 3).alias("retries"), F.get_json_object("props", "$.k").cast("bigint").alias("input_tokens"), (i % 17).alias("output_tokens"), F.col("ts"),
        )
        self.prices = read("nation").where("n_nationkey < 3").select(
            F.concat(F.lit("m"), F.col("n_nationkey")).alias("model_id"), (F.col("n_nationkey") + 1.0).alias("cost_input_1m"), (F.col("n_nationkey") * 2 + 1.0).alias("cost_output_1m")
        )
        turns = read("conversations").select("conv_id", "turn", "role", "text")
        a, b = turns.alias("a"), turns.alias("b")
        pairs = a.join(b, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("a.turn") + 2 == F.col("b.turn")) & (F.col("a.role") == "assistant") & (F.col("b.role") == "assistant"))
        self.pairs = pairs.select(F.col("a.conv_id").alias("conv_id"), F.col("a.turn").alias("turn"), F.col("a.text").alias("output"), F.when(F.col("a.conv_id") % 5 != 0, F.col("b.text")).alias("truth"))
        k = i % 100
        self.scored = e.select(
            i.cast("string").alias("test_id"), F.concat(F.lit("m"), F.col("user_id") % 4).alias("model_id"), F.col("event_type").alias("task"), (k / 100).alias("score"), (k >= 50).alias("correct"),
            F.when(i % 13 == 0, "timeout").when(i % 17 == 0, "rate limit").when(i % 19 == 0, "server").when((F.col("user_id") % 4 == 3) & (i % 5 == 0), "timeout").alias("error"),
            F.when(i % 4 != 1, F.concat(F.lit("truth "), i % 7, F.when(i % 9 == 0, "!" * 600).otherwise(""))).alias("ground_truth"),
            F.concat(F.lit("truth "), i % 5, F.when(i % 10 == 0, "." * 600).otherwise("")).alias("output_text"),
            F.when(i % 6 != 0, F.concat(F.lit("truth "), i % 3)).alias("legacy_output"), i.alias("seq"),
        )


LOG_SQL = """
inf AS (SELECT CAST(event_id AS VARCHAR) AS test_id, 'm' || (user_id % 4) AS model_id, event_type AS task, event_id % 11 <> 0 AS success, value AS latency_ms, event_id % 3 AS retries,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS input_tokens, event_id % 17 AS output_tokens FROM events),
prices AS (SELECT 'm' || n_nationkey AS model_id, n_nationkey + 1.0 AS ci, n_nationkey * 2 + 1.0 AS co FROM nation WHERE n_nationkey < 3),
pairs AS (SELECT a.conv_id, a.turn, a.text AS output, CASE WHEN a.conv_id % 5 <> 0 THEN b.text END AS truth FROM conversations a JOIN conversations b
    ON a.conv_id = b.conv_id AND a.turn + 2 = b.turn AND a.role = 'assistant' AND b.role = 'assistant'),
scored AS (SELECT CAST(event_id AS VARCHAR) AS test_id, 'm' || (user_id % 4) AS model_id, event_type AS task, (event_id % 100) / 100 AS score, event_id % 100 >= 50 AS correct,
    CASE WHEN event_id % 13 = 0 THEN 'timeout' WHEN event_id % 17 = 0 THEN 'rate limit' WHEN event_id % 19 = 0 THEN 'server' WHEN user_id % 4 = 3 AND event_id % 5 = 0 THEN 'timeout' END AS error,
    CASE WHEN event_id % 4 <> 1 THEN 'truth ' || (event_id % 7) || CASE WHEN event_id % 9 = 0 THEN repeat('!', 600) ELSE '' END END AS ground_truth,
    'truth ' || (event_id % 5) || CASE WHEN event_id % 10 = 0 THEN repeat('.', 600) ELSE '' END AS output_text,
    CASE WHEN event_id % 6 <> 0 THEN 'truth ' || (event_id % 3) END AS legacy_output, event_id AS seq FROM events),
ops AS (SELECT model_id, task, count(*) AS requests, count(*) FILTER (NOT success) AS errors, CAST(sum(retries) AS BIGINT) AS retries, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
    CAST(sum(output_tokens) AS BIGINT) AS output_tokens, round(avg(latency_ms) FILTER (success), 1) AS avg_latency_ms,
    round((sum(input_tokens) * coalesce(any_value(ci), 0) + sum(output_tokens) * coalesce(any_value(co), 0)) / 1e6, 6) AS cost,
    round((sum(input_tokens) * coalesce(any_value(ci), 0) + sum(output_tokens) * coalesce(any_value(co), 0)) / 1e6 / count(*), 6) AS cost_per_request
    FROM inf LEFT JOIN prices USING (model_id) GROUP BY model_id, task),
agg AS (SELECT task, model_id, avg(score) AS avg_score, count(*) AS n, count(*) FILTER (correct) AS n_correct, avg(CAST(correct AS INTEGER)) AS accuracy
    FROM scored GROUP BY GROUPING SETS ((task, model_id), (model_id)))
"""


def query(name: str, sql: str | None = None, *more: str):
    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(Log(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = "WITH " + ",\n".join([LOG_SQL, *more]) + "\n" + sql
        return f

    return register


@query("eval_operative_metrics", "SELECT * FROM ops")
def operative(t):
    return E.operative_metrics(t.inference, t.prices)


@query(
    "eval_model_rollup",
    "SELECT model_id, CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(retries) AS BIGINT) AS retries, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, round(sum(cost), 6) AS cost, round(avg(avg_latency_ms), 4) AS avg_latency_ms FROM ops GROUP BY 1",
)
def rollup(t):
    return E.model_rollup(E.operative_metrics(t.inference, t.prices)).withColumns({"cost": F.round("cost", 6), "avg_latency_ms": F.round("avg_latency_ms", 4)})


@query("eval_score_aggregates", "SELECT task, model_id, round(avg_score, 6) AS avg_score, n, n_correct, round(accuracy, 6) AS accuracy FROM agg")
def aggregates(t):
    return rounded(E.score_aggregates(t.scored))


@query(
    "eval_best_models",
    "SELECT task, model_id, avg_score, n FROM (SELECT coalesce(task, 'Overall') AS task, model_id, round_even(avg_score, 3) AS avg_score, n, row_number() OVER (PARTITION BY task ORDER BY round_even(avg_score, 3) DESC, model_id) AS k FROM agg) WHERE k = 1",
)
def best(t):
    return E.best_models(E.score_aggregates(t.scored))


_KINDS = ["click", "error", "purchase", "signup", "view"]


@query("eval_score_pivot", "SELECT model_id, " + ", ".join(f"round(max(avg_score) FILTER (task = '{k}'), 6) AS {k}" for k in _KINDS) + ', round(max(avg_score) FILTER (task IS NULL), 6) AS "Overall" FROM agg GROUP BY 1')
def pivot(t):
    return rounded(E.score_pivot(E.score_aggregates(t.scored), _KINDS))


@query(
    "eval_task_statistics",
    """SELECT task, round(sum(s) / sum(n), 6) AS avg_score, round(sum(c) / sum(n), 6) AS accuracy, CAST(sum(e) AS BIGINT) AS errors, round(sum(e) / sum(n), 6) AS error_rate,
       arg_max(model_id, (a, model_id)) AS best, arg_min(model_id, (a, model_id)) AS worst, string_agg(model_id || '=' || format('{:.6f}', round(a, 6)), ',' ORDER BY model_id) AS scores FROM (SELECT task, model_id, avg(score) AS a, count(*) AS n, sum(score) AS s, count(*) FILTER (correct) AS c, count(error) AS e FROM scored GROUP BY ALL) GROUP BY 1""",
)
def statistics(t):
    return _scores_as_text(E.member_statistics(t.scored, "task", "model_id"))


def _scores_as_text(df: DataFrame) -> DataFrame:
    each = F.transform(F.map_entries("scores"), lambda x: F.concat(x["key"], F.lit("="), F.format_string("%.6f", x["value"])))
    return rounded(df.withColumn("scores", F.array_join(each, ",")))


@query("eval_failure_index", "SELECT DISTINCT task, test_id FROM scored WHERE score < 0.5 AND test_id <> ''")
def failures(t):
    return E.failure_ids(t.scored)


@query("eval_failure_counts", "SELECT task, model_id, count(*) AS n FROM scored WHERE score < 0.5 GROUP BY ALL")
def failure_counts(t):
    return E.failure_counts(t.scored)


@query(
    "eval_anomalies",
    """SELECT * FROM (SELECT 0 AS kind, model_id, test_id, CAST(score AS DOUBLE) AS value FROM scored WHERE score = 0 AND ground_truth IS NOT NULL
       UNION ALL SELECT 1, model_id, NULL, avg(CASE WHEN error IS NOT NULL THEN 1.0 ELSE 0 END) FROM scored GROUP BY model_id HAVING avg(CASE WHEN error IS NOT NULL THEN 1.0 ELSE 0 END) > 0.2) ORDER BY kind, model_id, test_id LIMIT 20""",
)
def anomaly(t):
    return E.anomalies(t.scored)


@query(
    "eval_error_patterns",
    """SELECT a.task, round(avg_score, 6) AS avg_score, CASE WHEN avg_score < .3 THEN 'high' WHEN avg_score < .5 THEN 'medium' ELSE 'low' END AS severity, ids AS sample_ids, worst_model, worst_failures
       FROM (SELECT task, avg(score) AS avg_score FROM scored GROUP BY 1 HAVING avg(score) < .7) a
       LEFT JOIN (SELECT task, string_agg(test_id, ',' ORDER BY test_id) AS ids FROM (SELECT task, test_id, row_number() OVER (PARTITION BY task ORDER BY test_id) AS k FROM scored WHERE score < .5) WHERE k <= 5 GROUP BY 1) USING (task)
       LEFT JOIN (SELECT task, model_id AS worst_model, n AS worst_failures FROM (SELECT task, model_id, count(*) AS n, row_number() OVER (PARTITION BY task ORDER BY count(*) DESC, model_id) AS k FROM scored WHERE score < .5 GROUP BY task, model_id) WHERE k = 1) USING (task)""",
)
def patterns(t):
    return rounded(E.error_patterns(t.scored)).withColumn("sample_ids", F.array_join("sample_ids", ","))


@query(
    "eval_low_score_seeds",
    """SELECT task, test_id, model_id, score FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY score, test_id, model_id) AS k FROM (SELECT * FROM scored WHERE score < .3 ORDER BY score, task, test_id, model_id LIMIT 50)) WHERE k <= 5""",
)
def seeds(t):
    return E.low_score_seeds(t.scored).select("task", "test_id", "model_id", "score")


@query(
    "eval_verdicts",
    """SELECT test_id, l.model_id, substr(l.output_text, 1, 500) AS output_text, CASE WHEN l.correct THEN 'CORRECT' ELSE 'INCORRECT' END AS verdict, h.task, substr(h.legacy_output, 1, 500) AS legacy_output,
       CASE WHEN h.legacy_output IS NULL OR h.ground_truth IS NULL THEN 'N/A' WHEN contains(h.ground_truth, h.legacy_output) OR contains(h.legacy_output, h.ground_truth) THEN 'CORRECT' ELSE 'INCORRECT' END AS legacy_verdict
       FROM (SELECT * FROM few QUALIFY row_number() OVER (PARTITION BY test_id, model_id ORDER BY seq DESC) = 1) l JOIN (SELECT * FROM few QUALIFY row_number() OVER (PARTITION BY test_id ORDER BY seq) = 1) h USING (test_id)""",
    "few AS (SELECT * REPLACE (CAST(seq // 5 AS VARCHAR) AS test_id) FROM scored)",
)
def verdicts(t):
    """Five rows a test, so that models repeat and headers differ."""
    return E.verdict_table(t.scored.withColumn("test_id", F.floor(F.col("seq") / 5).cast("string")))


@query(
    "eval_feedback",
    """SELECT model_id, task, 'Average score: ' || format('{:.3f}', a) || chr(10) || 'Records evaluated: ' || n || chr(10) || 'Correct: ' || c || '/' || n || ' (' || format('{:.1f}', 100.0 * c / n) || '%)'
       || coalesce(chr(10) || 'Common errors: ' || e, '') AS feedback FROM (SELECT model_id, task, avg(score) AS a, count(*) AS n, count(*) FILTER (correct) AS c FROM scored GROUP BY ALL)
       LEFT JOIN (SELECT model_id, task, string_agg(error, '; ' ORDER BY n DESC, error) AS e FROM (SELECT model_id, task, error, count(*) AS n FROM scored WHERE error IS NOT NULL GROUP BY model_id, task, error
       QUALIFY row_number() OVER (PARTITION BY model_id, task ORDER BY count(*) DESC, error) <= 3) GROUP BY ALL) USING (model_id, task)""",
)
def feedback(t):
    return E.feedback(t.scored, ["model_id", "task"])


@query("eval_mean_latency", "SELECT i.model_id, round(avg(nullif(latency_ms, 0)), 6) AS avg_latency_ms FROM scored s JOIN inf i ON s.test_id = i.test_id AND s.model_id = i.model_id GROUP BY 1")
def latency(t):
    return rounded(E.mean_latency(t.scored, t.inference))


@query(
    "eval_restrict_or_all",
    "SELECT model_id, count(*) AS n FROM inf WHERE model_id IN (SELECT model_id FROM prices WHERE ci > 1) GROUP BY 1",
)
def restricted(t):
    return restrict_or_all(t.inference, t.prices.where("cost_input_1m > 1"), "model_id").groupBy("model_id").agg(F.count("*").alias("n"))


@query("eval_work_list", "SELECT i.test_id, p.model_id FROM inf i, prices p")
def work_list(t):
    return t.inference.select("test_id").crossJoin(F.broadcast(t.prices.select("model_id")))  # models are few by nature


_TOK = "list_filter(regexp_split_to_array({}, '\\s+'), lambda x: x <> '')"
_SETS = f"""
tk AS (SELECT *, list_distinct({_TOK.format("lower(coalesce(output, ''))")}) AS o, list_distinct({_TOK.format("lower(coalesce(truth, ''))")}) AS t,
    len({_TOK.format("coalesce(output, '')")}) AS no, len({_TOK.format("coalesce(truth, '')")}) AS nt FROM pairs)"""


@query(
    "eval_text_metrics",
    """SELECT conv_id, turn, round(CASE WHEN len(o) = 0 OR len(t) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect(o, t)) / (len(o) + len(t)) END, 6) AS token_f1,
       CASE WHEN lower(trim(coalesce(truth, ''), E' \\n\\t\\r')) <> '' AND lower(trim(output, E' \\n\\t\\r')) = lower(trim(truth, E' \\n\\t\\r')) THEN 1.0 ELSE 0.0 END AS exact,
       round(CASE WHEN no = 0 THEN 0.0 WHEN nt = 0 THEN CASE WHEN no > 3 THEN 1.0 ELSE 0.5 END ELSE least(no, nt) / greatest(no, nt) END, 6) AS length_ratio FROM tk""",
    _SETS,
)
def text_metrics(t):
    o, g = F.col("output"), F.col("truth")
    return rounded(t.pairs.select("conv_id", "turn", T.token_f1(o, g).alias("token_f1"), T.exact_match(o, g).alias("exact"), T.length_ratio(o, g).alias("length_ratio")))


@query(
    "eval_json_metrics",
    """SELECT event_id, CASE WHEN po IS NULL THEN 0.0 WHEN po = o THEN 1.0 ELSE 0.8 END AS validity, coalesce(len(list_filter(kt, lambda x: list_contains(ko, x))) / len(kt), 0.0) AS key_match,
       coalesce(len(list_filter(kt, lambda x: list_contains(ko, x) AND lower(trim(json_extract_string(pt, '$."' || x || '"'))) = lower(trim(json_extract_string(po, '$."' || x || '"'))))) / len(kt), 0.0) AS value_match
       FROM (SELECT *, json_keys(pt) AS kt, coalesce(json_keys(po), []) AS ko FROM (SELECT *, CASE WHEN json_valid(o) THEN o WHEN json_valid(s) THEN s END AS po, CASE WHEN json_valid(t) THEN t END AS pt
       FROM (SELECT *, regexp_extract(o, '\\{.*\\}', 0, 's') AS s FROM said)))""",
    """said AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN g WHEN 1 THEN 'Answer: ' || g || ' done' ELSE 'no object' END AS o, CASE WHEN event_id % 5 = 0 THEN 'Truth: ' ELSE '' END || '{"x": 1, ' || substr(props, 2, 1000) AS t
       FROM (SELECT *, CASE WHEN event_id % 2 = 0 THEN props ELSE replace(props, ': ', ': 1000') END AS g FROM events))""",
)
def json_metrics(t):
    e, i = t.read("events"), F.col("event_id")
    given = F.when(i % 2 == 0, F.col("props")).otherwise(F.replace(F.col("props"), F.lit(": "), F.lit(": 1000")))
    out = F.when(i % 3 == 0, given).when(i % 3 == 1, F.concat(F.lit("Answer: "), given, F.lit(" done"))).otherwise(F.lit("no object"))
    truth = F.concat(F.when(i % 5 == 0, "Truth: ").otherwise(""), F.lit('{"x": 1, '), F.substring("props", 2, 1000))
    return e.select("event_id", out.alias("o"), truth.alias("t")).select("event_id", T.json_validity(F.col("o")).alias("validity"), T.json_key_match(F.col("o"), F.col("t")).alias("key_match"), T.json_value_match(F.col("o"), F.col("t")).alias("value_match"))


_SQL_WORDS = "select insert update delete create alter drop with"
_SQL_TOKENS = """fen AS (SELECT event_id, side, CASE WHEN regexp_matches(x, '(?is)```(?:sql)?\\s*\\n.*?```') THEN regexp_extract(x, '(?is)```(?:sql)?\\s*\\n(.*?)```', 1) ELSE x END AS x FROM sides),
bare AS (SELECT *, regexp_replace(x, '(?s)--[^\\n]*|/\\*.*?\\*/', ' ', 'g') AS y FROM fen),
tok AS (SELECT *, list_distinct(list_transform(list_filter(regexp_split_to_array(y, '\\s+'), lambda w: w <> ''), lambda w: CASE WHEN list_contains(string_split('WORDS from where group by order having join left right inner on and or not as limit in is null', ' '), lower(w)) THEN upper(w) ELSE w END)) AS w,
    CASE WHEN trim(x, E' \\n\\t\\r') = '' OR NOT regexp_matches(lower(x), 'ALTERNATIVES') THEN 0.0 WHEN regexp_matches(lower(y), '^\\s*\\(*\\s*(ALTERNATIVES)\\b') THEN 1.0 ELSE 0.5 END AS syntax FROM bare)""".replace("WORDS", _SQL_WORDS).replace("ALTERNATIVES", _SQL_WORDS.replace(" ", "|"))


@query(
    "eval_sql_metrics",
    """SELECT event_id, a.syntax, round_even(CASE WHEN len(list_intersect(a.w, b.w)) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w)) END, 3) AS similarity
       FROM tok a JOIN tok b USING (event_id) WHERE a.side = 'o' AND b.side = 't'""",
    """sides AS (SELECT event_id, 'o' AS side, CASE event_id % 4 WHEN 0 THEN E'```sql\\nselect value FROM ' || event_type || E' -- c\\n```' WHEN 1 THEN 'please do select value FROM ' || event_type || ' now' WHEN 2 THEN '  ' ELSE 'nothing here' END AS x FROM events
       UNION ALL SELECT event_id, 't', 'SELECT value from ' || CASE WHEN event_id % 3 = 0 THEN event_type ELSE 'nowhere_else' END FROM events)""",
    _SQL_TOKENS,
)
def sql_metrics(t):
    e, i = t.read("events"), F.col("event_id")
    body = F.concat(F.lit("FROM "), F.col("event_type"))
    sql = F.concat(F.lit("```sql\nselect value "), body, F.lit(" -- c\n```"))
    out = F.when(i % 4 == 0, sql).when(i % 4 == 1, F.concat(F.lit("please do select value "), body, F.lit(" now"))).when(i % 4 == 2, F.lit("  ")).otherwise(F.lit("nothing here"))
    truth = F.concat(F.lit("SELECT value from "), F.when(i % 3 == 0, F.col("event_type")).otherwise(F.lit("nowhere_else")))
    return e.select("event_id", out.alias("o"), truth.alias("t")).select("event_id", T.sql_syntax(T.fenced(F.col("o"))).alias("syntax"), T.sql_similarity(F.col("o"), F.col("t")).alias("similarity"))


def _pii(column: str) -> str:
    return "list_distinct(flatten([" + ", ".join(f"regexp_extract_all({column}, '{p}')" for p in T.PII_PATTERNS) + "]))"


_MINUS = "list_filter({0}, lambda e: NOT list_contains({1}, e))"


@query(
    "eval_pii_redaction",
    """SELECT doc_id, found AS entities_found, CASE WHEN n = 0 THEN 0 ELSE fn END AS leaked, round_even(recall, 3) AS recall, round_even(prec, 3) AS precision,
       round_even(CASE WHEN n = 0 THEN prec WHEN prec + recall > 0 THEN 2 * prec * recall / (prec + recall) ELSE 0.0 END, 3) AS f1 FROM (
       SELECT *, CASE WHEN n = 0 THEN 1.0 ELSE tp / (tp + fn) END AS recall, CASE WHEN n = 0 THEN CASE WHEN extra = 0 THEN 1.0 ELSE 0.0 END WHEN tp + extra = 0 THEN 1.0 ELSE tp / (tp + extra) END AS prec FROM (
       SELECT doc_id, len(i) AS found, len(target) AS n, len(list_intersect(target, o)) AS fn, len(target) - len(list_intersect(target, o)) AS tp, len(extras) AS extra FROM (
       SELECT *, CASE WHEN told THEN """ + _MINUS.format("i", "t") + " ELSE i END AS target, CASE WHEN told THEN " + _MINUS.format("o", "t") + " ELSE " + _MINUS.format("o", "i") + """ END AS extras FROM (
       SELECT doc_id, doc_id % 2 = 0 AS told, """
    + _pii("text") + " AS i, " + _pii("regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+', CASE WHEN doc_id % 3 = 0 THEN 'a@b.org' ELSE '[EMAIL]' END, 'g')") + " AS o, "
    + _pii("regexp_replace(text, '[0-9]{3}', '[N]', 'g')")
    + " AS t FROM documents))))",
)
def pii(t):
    """E-mails redacted, by a third into another one; for half the documents the truth leaves e-mails and takes numbers out."""
    mail = F.when(F.col("doc_id") % 3 == 0, "a@b.org").otherwise("[EMAIL]")
    out = F.when(F.contains("text", F.lit("@")), F.regexp_replace("text", F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+"), mail)).otherwise(F.col("text"))
    truth = F.when(F.col("doc_id") % 2 == 0, F.regexp_replace("text", "[0-9]{3}", "[N]"))
    r = T.redaction(F.col("text"), out, truth)
    return t.read("documents").select("doc_id", r.alias("r")).select("doc_id", *(f"r.{c}" for c in ("entities_found", "leaked", "recall", "precision", "f1")))


_RANKED = """ranks AS (SELECT *, CASE WHEN len(numbered) >= 2 THEN numbered WHEN len(parts) >= 2 THEN list_filter(parts, lambda x: x <> '') ELSE [] END AS ranked FROM (
    SELECT *, list_transform(regexp_extract_all(o, '(?m)^\\s*\\d+[.)]\\s*(.+?)$', 1), lambda x: lower(trim(x))) AS numbered, list_transform(regexp_split_to_array(trim(o), ',\\s*|\\s*;\\s*'), lambda x: lower(trim(x))) AS parts FROM intents))"""


@query(
    "eval_intents",
    "SELECT event_id, len(ranked) AS n_ranked, " + ", ".join(f"CASE WHEN list_contains(ranked[1:{k}], lower(event_type)) THEN 1.0 ELSE 0.0 END AS p{k}" for k in (1, 3, 5)) + " FROM ranks",
    """intents AS (SELECT event_id, event_type, CASE event_id % 4 WHEN 0 THEN '1. ' || upper(event_type) || chr(10) || '2) other' WHEN 1 THEN 'a; b ;' || event_type || ', other' WHEN 2 THEN 'a, b, c, d, ' || event_type ELSE event_type END AS o FROM events)""",
    _RANKED,
)
def intents(t):
    e, i = t.read("events"), F.col("event_id")
    out = (
        F.when(i % 4 == 0, F.concat(F.lit("1. "), F.upper("event_type"), F.lit("\n2) other")))
        .when(i % 4 == 1, F.concat(F.lit("a; b ;"), F.col("event_type"), F.lit(", other")))
        .when(i % 4 == 2, F.concat(F.lit("a, b, c, d, "), F.col("event_type")))
        .otherwise(F.col("event_type"))
    )
    ranked = T.ranked_intents(F.col("o"))
    return e.select("event_id", "event_type", out.alias("o")).select("event_id", F.size(ranked).alias("n_ranked"), *(T.precision_at(ranked, F.col("event_type"), k).alias(f"p{k}") for k in (1, 3, 5)))


# All ten tasks over the turns of conversations; some outputs are made to fit their task.
_CASES = """
cx AS (SELECT conv_id, turn, conv_id % 10 AS ti, (conv_id + turn) % 7 <> 0 AS success, ((conv_id * 3 + turn) % 10) / 10 AS j, 'mail a@b.com call 555-123-4567' AS given,
    CASE conv_id % 10 WHEN 2 THEN CASE WHEN turn % 3 = 0 THEN 'Here: ' ELSE '' END || '{"n": ' || turn || ', "k": "x"}' WHEN 7 THEN 'SELECT a FROM t' || (turn % 2)
        WHEN 8 THEN 'mail ' || CASE WHEN turn % 4 < 2 THEN 'a@b.com' ELSE 'c@d.org' END || ' call 555' WHEN 9 THEN CASE WHEN turn % 4 < 2 THEN '1. Refund' || chr(10) || '2. Other' ELSE 'a refund please' END ELSE output END AS output,
    CASE conv_id % 10 WHEN 2 THEN '{"n": ' || (turn % 4) || ', "z": 1}' WHEN 7 THEN CASE WHEN turn % 5 <> 0 THEN 'select a from t0' END WHEN 8 THEN NULL WHEN 9 THEN 'refund' ELSE truth END AS truth,
    CASE WHEN turn % 4 <> 0 THEN 1.0 END AS c_syntax, CASE WHEN turn % 4 >= 2 THEN 0.5 END AS c_run, CASE WHEN turn % 4 = 3 THEN 1.0 END AS c_tests FROM pairs),
sides AS (SELECT conv_id * 100000 + turn AS event_id, 'o' AS side, output AS x FROM cx UNION ALL SELECT conv_id * 100000 + turn, 't', coalesce(truth, '') FROM cx)"""
_PARTS = """
cp AS (SELECT *, lower(trim(coalesce(output, ''), E' \\n\\t\\r')) AS no_, lower(trim(coalesce(truth, ''), E' \\n\\t\\r')) AS nt_, TOK(lower(coalesce(output, ''))) AS o, TOK(lower(coalesce(truth, ''))) AS t FROM cx),
cq AS (SELECT cp.*, nt_ <> '' AS has, CASE WHEN nt_ <> '' AND (contains(no_, nt_) OR contains(nt_, no_)) THEN 1.0 ELSE 0.0 END AS m,
    CASE WHEN len(o) = 0 OR len(t) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect(list_distinct(o), list_distinct(t))) / (len(list_distinct(o)) + len(list_distinct(t))) END AS f1,
    CASE WHEN len(o) = 0 THEN 0.0 WHEN len(t) = 0 THEN CASE WHEN len(o) > 3 THEN 1.0 ELSE 0.5 END ELSE least(len(o), len(t)) / greatest(len(o), len(t)) END AS lr,
    CASE WHEN ti = 2 THEN CASE WHEN json_valid(output) THEN 1.0 ELSE 0.8 END END AS valid, CASE WHEN ti = 2 THEN regexp_extract(output, '\\{.*\\}', 0) END AS po,
    a.syntax, round_even(CASE WHEN len(list_intersect(a.w, b.w)) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w)) END, 3) AS near,
    PII(given) AS ig, PII(output) AS io FROM cp JOIN tok a ON a.event_id = conv_id * 100000 + turn AND a.side = 'o' JOIN tok b ON b.event_id = a.event_id AND b.side = 't'),
cr AS (SELECT *, len(list_filter(json_keys(truth_j), lambda x: list_contains(json_keys(po), x))) / len(json_keys(truth_j)) AS ks,
    len(list_filter(json_keys(truth_j), lambda x: list_contains(json_keys(po), x) AND json_extract_string(truth_j, '$.' || x) = json_extract_string(po, '$.' || x))) / len(json_keys(truth_j)) AS vs,
    len(ig) - len(list_intersect(ig, io)) AS tp, len(list_intersect(ig, io)) AS fn, len(list_filter(io, lambda x: NOT list_contains(ig, x))) AS extra FROM (SELECT *, CASE WHEN ti = 2 THEN truth END AS truth_j FROM cq)),
cs AS (SELECT *, CASE WHEN tp = 0 THEN 0.0 ELSE 2.0 * (tp / (tp + extra)) * (tp / (tp + fn)) / (tp / (tp + extra) + tp / (tp + fn)) END AS pf, CASE WHEN no_ LIKE '1. %' THEN CASE WHEN no_ LIKE '1. refund%' THEN 1.0 ELSE 0.0 END ELSE m END AS rk FROM cr),
raw AS (SELECT *, CASE WHEN NOT success THEN 0.0 ELSE CASE ti WHEN 0 THEN CASE WHEN has THEN .5 * m + .5 * j ELSE j END WHEN 1 THEN CASE WHEN has THEN .4 * f1 + .6 * j ELSE j END
    WHEN 2 THEN .5 * (.3 * valid + .35 * ks + .35 * vs) + .5 * j
    WHEN 3 THEN CASE WHEN c_tests IS NOT NULL THEN .10 * c_syntax + .15 * c_run + .25 * c_tests + .5 * j WHEN c_run IS NOT NULL THEN .15 * c_syntax + .15 * c_run + .7 * j ELSE .3 * coalesce(c_syntax, 0) + .7 * j END
    WHEN 7 THEN CASE WHEN has AND near > 0 THEN .25 * syntax + .05 * near + .7 * j ELSE .3 * syntax + .7 * j END WHEN 8 THEN .5 * round_even(pf, 3) + .5 * j WHEN 9 THEN .5 * rk + .5 * j
    ELSE CASE WHEN has THEN .4 * (.5 * f1 + .5 * lr) + .6 * j ELSE j END END END AS raw FROM cs)""".replace("TOK(", "pieces(")


def _spelled(sql: str) -> str:
    """The names that stand for longer expressions written out."""
    sql = re.sub(r"pieces\((lower\(coalesce\(\w+, ''\)\))\)", lambda m: f"list_filter(regexp_split_to_array({m[1]}, '\\s+'), lambda x: x <> '')", sql)
    return re.sub(r"PII\((\w+)\)", lambda m: _pii(m[1]), sql)


@query("eval_composite", f"SELECT conv_id, turn, [{', '.join(repr(x) for x in E.TASKS)}][ti + 1] AS task, success, round_even(raw, 3) AS score, success AND round(raw, 9) >= 0.5 AS correct FROM raw", _CASES, _SQL_TOKENS, _spelled(_PARTS))
def composite(t):
    ti, turn = F.col("conv_id") % 10, F.col("turn")
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    output = (
        F.when(ti == 2, text(F.when(turn % 3 == 0, "Here: ").otherwise(""), '{"n": ', turn, ', "k": "x"}'))
        .when(ti == 7, text("SELECT a FROM t", turn % 2))
        .when(ti == 8, text("mail ", F.when(turn % 4 < 2, "a@b.com").otherwise("c@d.org"), " call 555"))
        .when(ti == 9, F.when(turn % 4 < 2, "1. Refund\n2. Other").otherwise("a refund please"))
        .otherwise(F.col("output"))
    )
    truth = (
        F.when(ti == 2, text('{"n": ', turn % 4, ', "z": 1}')).when(ti == 7, F.when(turn % 5 != 0, "select a from t0")).when(ti == 8, F.lit(None)).when(ti == 9, "refund").otherwise(F.col("truth"))
    )
    log = t.pairs.select(
        "conv_id", "turn", F.concat_ws("-", "conv_id", "turn").alias("test_id"), F.lit("m0").alias("model_id"), F.element_at(F.array(*map(F.lit, E.TASKS)), (ti + 1).cast("int")).alias("task"), ((F.col("conv_id") + turn) % 7 != 0).alias("success"),
        output.alias("output_text"), truth.alias("ground_truth"), (((F.col("conv_id") * 3 + turn) % 10) / 10).alias("judge_score"), F.lit("mail a@b.com call 555-123-4567").alias("given"),
        F.when(turn % 4 != 0, 1.0).alias("code_syntax"), F.when(turn % 4 >= 2, 0.5).alias("code_run"), F.when(turn % 4 == 3, 1.0).alias("code_tests"),
    )
    own = log.withColumn("model_id", F.lit("judge"))  # the judge's own answers are left out
    return E.evaluate(log.unionByName(own), "judge").select("conv_id", "turn", "task", "success", "score", "correct")


@query(
    "eval_consensus",
    """SELECT s.test_id, s.model_id, CASE WHEN ground_truth IS NULL AND n >= 2 THEN round_even(c, 3) END AS consensus, round(CASE WHEN ground_truth IS NULL AND n >= 2 THEN (s.score + round_even(c, 3)) / 2 ELSE s.score END, 6) AS judge_blended
       FROM scored s LEFT JOIN (SELECT test_id, model_id, avg(o) AS c, count(*) AS n FROM (SELECT test_id, model_id, (seq % 10) / 10 AS o FROM scored WHERE seq % 3 <> 0 UNION ALL SELECT test_id, model_id, (seq % 4) / 4 FROM scored WHERE seq % 5 <> 0) GROUP BY ALL) USING (test_id, model_id)""",
)
def consensus(t):
    s = t.scored.withColumn("judge_score", F.col("score"))
    a = s.where("seq % 3 <> 0").select("test_id", "model_id", (F.col("seq") % 10 / 10).alias("opinion"))
    b = s.where("seq % 5 <> 0").select("test_id", "model_id", (F.col("seq") % 4 / 4).alias("opinion"))
    return rounded(E.consensus(s, a.unionByName(b)).select("test_id", "model_id", "consensus", "judge_blended"))


@query(
    "eval_external_scores",
    """SELECT event_id, coalesce(least(greatest(TRY_CAST(json_extract_string(CASE WHEN json_valid(s) THEN s END, '$.score') AS DOUBLE), 0.0), 1.0), 0.0) AS score FROM (SELECT event_id, regexp_extract(x, '\\{.*\\}', 0, 's') AS s FROM (
       SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Verdict {"score": ' || (event_id % 20 / 10) || '} end' WHEN 1 THEN '{"score": 0.5}' WHEN 2 THEN '{"score": -1}' ELSE 'none' END AS x FROM events))""",
)
def external(t):
    i = F.col("event_id")
    said = F.when(i % 4 == 0, F.concat(F.lit('Verdict {"score": '), (i % 20 / 10).cast("string"), F.lit("} end"))).when(i % 4 == 1, F.lit('{"score": 0.5}')).when(i % 4 == 2, F.lit('{"score": -1}')).otherwise(F.lit("none"))
    return t.read("events").select("event_id", T.clamp_score(said).alias("score"))


@query(
    "eval_variants",
    """SELECT iteration, variant, round_even(avg(score), 3) AS avg_score, count(*) AS n, count(*) FILTER (correct) AS n_correct FROM (SELECT *, seq % 5 AS iteration, 'v' || (seq % 3) AS variant FROM scored) GROUP BY ALL""",
)
def variants(t):
    return E.variant_scores(t.scored.withColumns({"iteration": F.col("seq") % 5, "variant": F.concat(F.lit("v"), F.col("seq") % 3)}))


@query(
    "eval_multi_objective",
    """SELECT model_id, round_even(.7 * a + .15 * coalesce(least(1.0, 10 / nullif(c, 0)), 1.0) + .15 * coalesce(least(1.0, 9.0 / l), 1.0), 4) AS composite FROM (SELECT model_id, round_even(avg(score), 3) AS a, sum(seq % 7) / 100 AS c, round(avg(seq % 20), 2) AS l FROM scored GROUP BY 1)""",
)
def objective(t):
    x = t.scored.groupBy("model_id").agg(F.bround(F.avg("score"), 3).alias("avg_score"), (F.sum(F.col("seq") % 7) / 100).alias("cost"), F.round(F.avg(F.col("seq") % 20), 2).alias("latency"))
    return E.multi_objective(x.withColumns({"base_cost": F.lit(10.0), "base_latency": F.lit(9.0)})).select("model_id", "composite")


@query(
    "eval_iterative_selection",
    """SELECT iteration, b.variant AS variant, b.avg_score AS avg_score, b.n_correct AS n_correct, o IS NULL AS is_baseline, coalesce(round(b.avg_score - o.avg_score, 9) <= 0.01, false) AS stopped_early FROM (
       SELECT *, lag(b) OVER (ORDER BY iteration) AS o FROM (SELECT iteration, max({'avg_score': avg_score, 'earlier': -iteration, 'variant': variant, 'n_correct': n_correct}) OVER (ORDER BY iteration) AS b FROM (
       SELECT iteration, variant, round_even(avg(score), 3) AS avg_score, count(*) FILTER (correct) AS n_correct FROM ran GROUP BY iteration, variant QUALIFY row_number() OVER (PARTITION BY iteration ORDER BY round_even(avg(score), 3) DESC, variant) = 1)))
       QUALIFY coalesce(sum(CASE WHEN round(b.avg_score - o.avg_score, 9) <= 0.01 THEN 1 ELSE 0 END) OVER (ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0""",
    "ran AS (SELECT *, seq % 5 AS iteration, 'v' || (seq % 3) AS variant FROM (SELECT * REPLACE (least(score * (1 + (seq % 5 % 3) / 10), 1.0) AS score) FROM scored))",
)
def selection(t):
    better = t.scored.withColumn("score", F.least(F.col("score") * (1 + (F.col("seq") % 5 % 3) / 10), F.lit(1.0)))
    return E.iterative_selection(E.variant_scores(better.withColumns({"iteration": F.col("seq") % 5, "variant": F.concat(F.lit("v"), F.col("seq") % 3)})))


@query("eval_beam", "SELECT * FROM (SELECT task, model_id, round(avg(score), 6) AS avg_score FROM scored GROUP BY task, model_id) ORDER BY avg_score DESC, CASE WHEN model_id = 'm0' THEN 0 ELSE 1 END, task || model_id LIMIT 3")
def beam(t):
    x = t.scored.groupBy("task", "model_id").agg(F.round(F.avg("score"), 6).alias("avg_score"))
    return E.beam(x.withColumns({"is_candidate": F.when(F.col("model_id") == "m0", 0).otherwise(1), "idx": F.concat("task", "model_id")}), 3).select("task", "model_id", "avg_score")


_WORDS = "list_filter(regexp_split_to_array({}, '\\s+'), lambda w: w <> '')"


@query(
    "eval_ablation",
    """SELECT conv_id, iteration, round(s - b, 4) AS delta, CASE WHEN s > b THEN 'positive' WHEN s < b THEN 'negative' ELSE 'neutral' END AS effect,
       array_to_string(list_filter(w, lambda x, i: NOT list_contains(v, x) AND list_position(w, x) = i)[1:10], ' ') AS added,
       array_to_string(list_filter(v, lambda x, i: NOT list_contains(w, x) AND list_position(v, x) = i)[1:10], ' ') AS removed FROM (
       SELECT *, lag(s) OVER o AS b, lag(w) OVER o AS v FROM (SELECT conv_id, turn AS iteration, avg(length(text) % 10) AS s, """ + _WORDS.format("min(text)") + """ AS w FROM conversations GROUP BY ALL)
       WINDOW o AS (PARTITION BY conv_id ORDER BY iteration)) WHERE b IS NOT NULL""",
)
def ablation(t):
    """Each conversation as a history of prompts, its turns as iterations."""
    history = t.read("conversations").groupBy("conv_id", F.col("turn").alias("iteration")).agg(F.min("text").alias("prompt"), F.avg((F.length("text") % 10).cast("double")).alias("avg_score"))
    return E.ablation(history, ["conv_id"]).withColumns({c: F.array_join(c, " ") for c in ("added", "removed")})


def _two(t) -> tuple[DataFrame, DataFrame]:
    key = F.floor(F.col("seq") / 8).cast("string").alias("test_id")  # pairs grow with the log
    mean = lambda m: t.scored.where(F.col("model_id") == m).groupBy(key).agg(F.avg("score").alias("score"))
    return mean("m0"), mean("m1")


_DIFFS = """diffs AS (SELECT CAST(k AS VARCHAR) AS k, b.s - a.s AS d FROM (SELECT seq // 8 AS k, avg(score) AS s FROM scored WHERE model_id = 'm0' GROUP BY 1) a
    JOIN (SELECT seq // 8 AS k, avg(score) AS s FROM scored WHERE model_id = 'm1' GROUP BY 1) b USING (k))"""


@query(
    "eval_paired_t",
    """SELECT n, round(md, 6) AS mean_diff, round_even(t, 4) AS t, round_even(p, 4) AS p, p < 0.05 AS significant FROM (
       SELECT n, md, t, (SELECT sum(w * cos(u) ** (n - 2)) * (pi() / 2 - h) FROM tail) / (SELECT sum(w * cos(u) ** (n - 2)) * pi() FROM span) AS p FROM test)""",
    _DIFFS,
    # t = sqrt(n - 1) * tan(u) turns the density into a power of the cosine; Simpson's rule over the tail and over the whole
    """test AS (SELECT *, md / (sd / sqrt(n)) AS t, atan(md / (sd / sqrt(n)) / sqrt(n - 1)) AS h FROM (SELECT count(*) AS n, avg(d) AS md, stddev_samp(d) AS sd FROM diffs)),
steps AS (SELECT i, CASE WHEN i IN (0, 100000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END / 300000 AS w FROM range(100001) r(i)),
tail AS (SELECT w, h + (pi() / 2 - h) * i / 100000 AS u FROM steps, test), span AS (SELECT w, pi() * (i / 100000 - 0.5) AS u FROM steps)""",
)
def paired(t):
    a, b = _two(t)
    return E.paired_t_test(a, b).withColumn("mean_diff", F.round("mean_diff", 6))


@query(
    "eval_bootstrap",
    """SELECT round_even((SELECT avg(d) FROM diffs), 4) AS mean_diff, round_even(m[CAST(floor(len(m) * 0.025) AS INTEGER) + 1], 4) AS low, round_even(m[CAST(floor(len(m) * 0.975) AS INTEGER) + 1], 4) AS high,
       m[CAST(floor(len(m) * 0.025) AS INTEGER) + 1] > 0 AS significant FROM (SELECT list_sort(list(m)) AS m FROM (SELECT r, sum(w * d) / sum(w) AS m FROM weights GROUP BY r) WHERE m IS NOT NULL)""",
    _DIFFS,
    f"""digits AS (SELECT d, e, md5('42:' || k || ':' || e) AS x FROM diffs, range(125) r(e)),
weights AS (SELECT e * 8 + i AS r, d, {" + ".join(f"CAST(u >= {x} AS INTEGER)" for x in E.WEIGHT_BOUNDS)} AS w FROM (SELECT e, i, d, CAST('0x' || substr(x, CAST(4 * i + 1 AS BIGINT), 4) AS INTEGER) AS u FROM digits, range(8) q(i)))""",
)
def bootstrap(t):
    return E.bootstrap_interval(*_two(t))


@query(
    "eval_verdict_sheet",
    "SELECT test_id, task, legacy_output, legacy_verdict, " + ", ".join(f"coalesce(max(output_text) FILTER (model_id = '{m}'), '') AS \"{m} output\", coalesce(max(verdict) FILTER (model_id = '{m}'), 'N/A') AS \"{m} verdict\"" for m in ("m0", "m1", "m2", "m3")) + " FROM told GROUP BY ALL",
    "few AS (SELECT * REPLACE (CAST(seq // 5 AS VARCHAR) AS test_id) FROM scored)",
    """told AS (SELECT test_id, l.model_id, substr(l.output_text, 1, 500) AS output_text, CASE WHEN l.correct THEN 'CORRECT' ELSE 'INCORRECT' END AS verdict, h.task, substr(h.legacy_output, 1, 500) AS legacy_output,
       CASE WHEN h.legacy_output IS NULL OR h.ground_truth IS NULL THEN 'N/A' WHEN contains(h.ground_truth, h.legacy_output) OR contains(h.legacy_output, h.ground_truth) THEN 'CORRECT' ELSE 'INCORRECT' END AS legacy_verdict
       FROM (SELECT * FROM few QUALIFY row_number() OVER (PARTITION BY test_id, model_id ORDER BY seq DESC) = 1) l JOIN (SELECT * FROM few QUALIFY row_number() OVER (PARTITION BY test_id ORDER BY seq) = 1) h USING (test_id))""",
)
def verdict_sheet(t):
    return E.verdict_sheet(t.scored.withColumn("test_id", F.floor(F.col("seq") / 5).cast("string")), E.models_of(t.scored))


@query(
    "eval_overview_sheet",
    'SELECT model_id AS "Model", ' + ", ".join(f"coalesce(format('{{:.3f}}', round_even(max(avg_score) FILTER (task = '{k}'), 3)), '') AS {k}" for k in _KINDS) + ", coalesce(format('{:.3f}', round_even(max(avg_score) FILTER (task IS NULL), 3)), '') AS \"Overall\" FROM lacking GROUP BY 1",
    "lacking AS (SELECT * FROM agg WHERE NOT (coalesce(task, '') = 'view' AND model_id = 'm2'))",
)
def overview_sheet(t):
    """One model lacks one task."""
    return E.overview_sheet(E.score_aggregates(t.scored).where("NOT (coalesce(task, '') = 'view' AND model_id = 'm2')"), _KINDS)


@query(
    "eval_validated_log",
    """SELECT 'kept' AS kind, count(*) AS n, CAST(sum(retries) AS BIGINT) AS retries, CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM (SELECT i, max(r) AS retries, any_value(i % 17) AS output_tokens FROM calls WHERE reason IS NULL GROUP BY i)
       UNION ALL SELECT reason, count(*), NULL, NULL FROM calls WHERE reason IS NOT NULL GROUP BY reason""",
    """calls AS (SELECT event_id AS i, r, CASE WHEN event_id % 13 = 0 OR event_id % 17 = 0 THEN 'malformed' WHEN event_id % 19 = 0 THEN 'no key' WHEN event_id % 23 = 0 THEN 'negative' END AS reason
       FROM events, range(3) q(r) WHERE r <= event_id % 3)""",
)
def validated(t):
    """Every call with each of its tries; some lines cut off, of a wrong type, without model, or with a negative time."""
    i, model = F.col("event_id"), F.concat(F.lit("m"), F.col("user_id") % 4)
    tries = t.read("events").withColumn("r", F.explode(F.sequence(F.lit(0).cast("bigint"), i % 3)))
    row = F.struct(i.cast("string").alias("test_id"), F.when(i % 19 != 0, model).alias("model_id"), F.col("event_type").alias("task"), (i % 11 != 0).alias("success"), F.col("r").alias("retries"),
                   F.when(i % 23 == 0, -1.0).otherwise(F.col("value")).alias("latency_ms"), (i % 17).alias("output_tokens"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))
    text = F.to_json(row)
    text = F.when(i % 13 == 0, F.substring(text, 1, 30)).when(i % 17 == 0, F.replace(text, F.lit('"retries":'), F.lit('"retries":"many","was":'))).otherwise(text)
    good, bad = E.validated_log(tries.select(text.alias("value")))
    none = F.lit(None).cast("long")
    kept = good.agg(F.lit("kept").alias("kind"), F.count("*").alias("n"), F.sum("retries").alias("retries"), F.sum("output_tokens").alias("output_tokens"))
    return kept.unionByName(bad.groupBy(F.col("reason").alias("kind")).agg(F.count("*").alias("n")).withColumns({"retries": none, "output_tokens": none}))


# records

_AGENT = "conv_id % 14"


def _messages(t) -> DataFrame:
    """Messages of conversations as records' rows; the first text of an agent bears an instruction by its number."""
    c = t.read("conversations")
    tasks = F.array(*map(F.lit, ["Classify the topic with a label.", "Translate into english.", "Write a python function.", "Summarize the key points.", "Write a sql query with select."]))
    content = F.when((F.col("turn") == 0) & (F.col("conv_id") % 14 < 10), F.concat("text", F.lit(" "), F.element_at(tasks, (F.col("conv_id") % 5 + 1).cast("int")))).otherwise(F.col("text"))
    return c.select(F.concat(F.lit("agent_"), F.col("conv_id") % 14).alias("agent_id"), (F.col("conv_id") * 10000 + F.col("turn")).alias("seq"), F.when((F.col("turn") == 0) & (F.col("conv_id") % 2 == 0), "system").otherwise(F.col("role")).alias("role"), content.alias("content"), F.when(F.col("conv_id") % 3 == 0, "text").alias("expected_output_type"))


#: The twin's own list of what outputs tell.
_OUTPUT_RULES = ", " + ", ".join(
    rf"('{task}', 'output', '\b{word}')"
    for task, word in (
        ("classification", r"label\b"), ("context_qa", r"text\b"), ("metadata_extraction", r"json\b"), ("code_generation", r"code\b"), ("translation", r"text\b"), ("summarization", r"text\b"),
        ("rephrasing", r"text\b"), ("sql_generation", r"sql\b"), ("pii_redaction", r"text\b"), ("pii_redaction", "redact"), ("intent_detection", r"label\b"),
    )
)
_MESSAGES = """
msg AS (SELECT 'agent_' || (conv_id % 14) AS agent_id, conv_id * 10000 + turn AS seq, CASE WHEN turn = 0 AND conv_id % 2 = 0 THEN 'system' ELSE role END AS role,
    CASE WHEN turn = 0 AND conv_id % 14 < 10 THEN text || ' ' || ['Classify the topic with a label.', 'Translate into english.', 'Write a python function.', 'Summarize the key points.', 'Write a sql query with select.'][conv_id % 5 + 1] ELSE text END AS content,
    CASE WHEN conv_id % 3 = 0 THEN 'text' END AS ot FROM conversations),
smp AS (SELECT agent_id, coalesce(s, '') AS system_text, coalesce(u, '') AS user_text, ot AS output_type FROM (SELECT agent_id, arg_min(ot, seq) FILTER (ot IS NOT NULL) AS ot FROM msg GROUP BY 1)
    LEFT JOIN (SELECT agent_id, arg_min(content, seq) AS s FROM msg WHERE role = 'system' AND trim(content) <> '' GROUP BY 1) USING (agent_id)
    LEFT JOIN (SELECT agent_id, string_agg(content, chr(10) ORDER BY seq) AS u FROM (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY seq) AS k FROM msg WHERE role = 'user' AND trim(content) <> '') WHERE k <= 5 GROUP BY 1) USING (agent_id)),
rules(task, field, pattern) AS (VALUES RULES),
ts AS (SELECT agent_id, task, sum(CASE WHEN field = 'system' AND regexp_matches(lower(system_text), pattern) THEN 3.0 WHEN field = 'user' AND regexp_matches(lower(user_text), pattern) THEN 2.0
    WHEN field = 'output' AND regexp_matches(lower(output_type), pattern) THEN 5.0 ELSE 0.0 END) AS score FROM smp, rules GROUP BY ALL)
""".replace("RULES", ", ".join("('{}', '{}', '{}')".format(*r) for r in RULES if r[1] != "output") + _OUTPUT_RULES)


@query("records_prompt_samples", "SELECT * FROM smp", _MESSAGES)
def samples(t):
    return N.prompt_samples(_messages(t)).select("agent_id", "system_text", "user_text", "output_type")


@query("records_task_scores", "SELECT agent_id, task, CAST(score AS DOUBLE) AS score FROM ts", _MESSAGES)
def scores(t):
    return N.task_scores(N.prompt_samples(_messages(t)), task_rules(t.spark))


_POS = "list_position([" + ", ".join(f"'{x}'" for x in E.TASKS) + "], task)"


@query(
    "records_task_choice",
    f"""SELECT agent_id, rule_task, label_task, coalesce(label_task, rule_task) AS task, coalesce(label_task <> rule_task, false) AS mismatch FROM (SELECT agent_id, CASE WHEN score > 0 THEN task ELSE 'classification' END AS rule_task,
        CASE substr(agent_id, 7)::INTEGER % 4 WHEN 0 THEN 'code_generation' WHEN 1 THEN 'translation' END AS label_task FROM (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY score DESC, {_POS}) AS k FROM ts) WHERE k = 1)""",
    _MESSAGES,
)
def choice(t):
    chosen = N.choose_task(N.task_scores(N.prompt_samples(_messages(t)), task_rules(t.spark)))
    k = F.regexp_extract("agent_id", r"\d+", 0).cast("int") % 4
    labels = chosen.select("agent_id", F.when(k == 0, " Code-Generation").when(k == 1, "this is Translation!").otherwise("unclear").alias("label"))
    return N.label_override(chosen, labels).select("agent_id", "rule_task", "label_task", "task", "mismatch")


@query("records_task_score_pivot", "SELECT agent_id, " + ", ".join(f"CAST(max(score) FILTER (task = '{x}') AS DOUBLE) AS {x}" for x in E.TASKS) + " FROM ts GROUP BY 1", _MESSAGES)
def score_pivot(t):
    return N.task_score_pivot(N.task_scores(N.prompt_samples(_messages(t)), task_rules(t.spark)))


def _lines(t, *keep: str) -> DataFrame:
    """Records as JSON lines; by the number of the event some lack a key, a system message, or are cut off."""
    i = F.col("event_id")
    msgs = F.array(F.struct(F.when(i % 10 == 3, "assistant").otherwise("system").alias("role"), F.lit("Be brief.").alias("content")), F.struct(F.lit("user").alias("role"), F.col("event_type").alias("content")))
    full = F.struct(i.cast("string").alias("test_id"), msgs.alias("input_messages"), F.when(i % 3 != 0, F.col("event_type")).alias("ground_truth"), F.lit("label").alias("expected_output_type"), F.lit("{}").alias("metadata"), F.concat(F.lit("agent_"), F.col("user_id") % 14).alias("agent_id"), F.col("event_type").alias("output"))
    text = F.to_json(full, {"ignoreNullFields": "false"})
    text = F.when(i % 10 == 4, F.replace(text, F.lit('"metadata"'), F.lit('"meta"'))).when(i % 10 == 5, F.substring(text, 1, 20)).when(i % 10 == 6, F.lit("  ")).otherwise(text)
    return t.read("events").select(text.alias("value"), *keep)


@query(
    "records_agent_profile",
    """SELECT agent_id, count(*) AS n_records, round(CASE WHEN count(*) FILTER (v) > 0 THEN 100.0 * count(*) FILTER (v AND event_id % 3 <> 0) / count(*) FILTER (v) ELSE 0 END, 1) AS pct_ground_truth, count(*) FILTER (NOT v) AS n_malformed
       FROM (SELECT 'agent_' || (user_id % 14) AS agent_id, event_id, event_id % 10 NOT IN (3, 4) AS v FROM events WHERE event_id % 10 NOT IN (5, 6)) GROUP BY 1""",
)
def agent_profile(t):
    good, _ = N.read_records(_lines(t))
    return N.agent_profile(good.withColumn("valid", N.is_valid(F.col("keys"), F.col("messages"))))


@query(
    "records_quarantine",
    """SELECT count(*) AS n FROM (SELECT CASE event_id % 10 WHEN 5 THEN substr(x, 1, 20) WHEN 6 THEN '  ' ELSE x END AS x FROM (SELECT event_id, CAST(to_json({'test_id': CAST(event_id AS VARCHAR), 'output': event_type}) AS VARCHAR) AS x FROM events))
       WHERE trim(x) <> '' AND NOT (json_valid(x) AND coalesce(json_type(CASE WHEN json_valid(x) THEN x END), '') = 'OBJECT')""",
)
def quarantine(t):
    return N.read_records(_lines(t))[1].agg(F.count("*").alias("n"))


@query("records_generated", "SELECT 'agent_' || (user_id % 14) AS agent_id, event_type AS ground_truth, CASE event_type WHEN 'view' THEN 'label' ELSE 'text' END AS expected_output_type, true AS synthetic, CASE event_type WHEN 'view' THEN 'classification' ELSE 'translation' END AS source_task, false AS edge_case, count(*) AS n FROM events WHERE event_id % 4 <> 0 GROUP BY ALL")
def generated(t):
    i = F.col("event_id")
    user = F.when(i % 4 != 0, F.concat(F.col("event_type"), i)).otherwise(F.lit(" "))
    text = F.to_json(F.array(F.struct(F.lit("Be brief.").alias("system"), user.alias("user"), F.col("event_type").alias("ground_truth"))))
    rows = t.read("events").select(F.concat(F.lit("agent_"), F.col("user_id") % 14).alias("agent_id"), F.when(F.col("event_type") == "view", "classification").otherwise("translation").alias("task"), text.alias("text"))
    made = N.generated_records(rows)
    told = [F.col(f"metadata.{c}").alias(c) for c in ("synthetic", "source_task", "edge_case")]
    return made.groupBy("agent_id", "ground_truth", "expected_output_type", *told).agg(F.count_distinct("test_id").alias("n"))


@query("records_validation_gate", "SELECT test_id, model_id FROM scored WHERE CASE WHEN error IS NULL THEN score END >= 0.3 OR error IS NOT NULL")
def gate(t):
    return N.validation_gate(t.scored.withColumn("score", F.when(F.col("error").isNull(), F.col("score")))).select("test_id", "model_id")


@query(
    "records_truncated_json",
    """SELECT event_id, regexp_extract(x, '"name"\\s*:\\s*"(.*?)"', 1) AS name, array_to_string(regexp_extract_all(regexp_extract(x, '"items"\\s*:\\s*\\[([^\\]]*)', 1), '"(.*?)"', 1), ',') AS items FROM (
       SELECT event_id, '{"name": "' || event_type || '", "items": ["' || event_type || '", "b"' || CASE WHEN event_id % 2 = 0 THEN ']}' ELSE ', "cut of' END AS x FROM events)""",
)
def truncated(t):
    i = F.col("event_id")
    full = F.concat(F.lit('{"name": "'), F.col("event_type"), F.lit('", "items": ["'), F.col("event_type"), F.lit('", "b"'))
    text = F.when(i % 2 == 0, F.concat(full, F.lit("]}"))).otherwise(F.concat(full, F.lit(', "cut of')))
    x = t.read("events").select("event_id", text.alias("x"))
    return x.select("event_id", T.json_string_field(F.col("x"), "name").alias("name"), F.array_join(T.json_string_list(F.col("x"), "items"), ",").alias("items"))


@query("records_replace_system", "SELECT conv_id, 'system:NEW' AS first, CASE WHEN bool_or(role = 'system') THEN count(*) ELSE count(*) + 1 END AS n FROM conversations GROUP BY 1")
def replaced(t):
    c = t.read("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    msgs = F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))
    r = T.replace_system(msgs, F.lit("NEW"))
    first = F.get(F.filter(r, lambda m: m["role"] == "system"), F.lit(0))
    return c.select("conv_id", F.concat(first["role"], F.lit(":"), first["content"]).alias("first"), F.size(r).cast("long").alias("n"))


@query(
    "records_by_task",
    """SELECT task, CAST(sum(n) AS BIGINT) AS n_records, count(*) AS n_agents, max(n) AS largest FROM (SELECT user_id % 14 AS a, count(*) AS n, CASE WHEN user_id % 14 % 2 = 0 THEN 'translation' ELSE 'classification' END AS task
       FROM events WHERE event_id % 10 NOT IN (5, 6) GROUP BY ALL) GROUP BY 1""",
)
def by_task(t):
    good, _ = N.read_records(_lines(t))
    agents = N.agent_profile(good.withColumn("valid", N.is_valid(F.col("keys"), F.col("messages"))))
    even = F.regexp_extract("agent_id", r"\d+", 0).cast("int") % 2 == 0
    return N.agents_by_task(agents, agents.select("agent_id", F.when(even, "translation").otherwise("classification").alias("task")))


@query(
    "records_with_tasks",
    """SELECT task, event_id % 10 NOT IN (3, 4) AS valid, count(*) AS n, count(DISTINCT agent_id) AS n_agents FROM (SELECT event_id, 'agent_' || (user_id % 14) AS agent_id,
       CASE WHEN user_id % 14 = 13 THEN 'classification' WHEN user_id % 14 % 2 = 0 THEN 'translation' ELSE 'context_qa' END AS task FROM events WHERE event_id % 10 NOT IN (5, 6)) GROUP BY ALL""",
)
def tasks_attached(t):
    """Every record bears its agent's task; one agent has none."""
    good, _ = N.read_records(_lines(t))
    records = good.withColumn("valid", N.is_valid(F.col("keys"), F.col("messages")))
    number = F.regexp_extract("agent_id", r"\d+", 0).cast("int")
    tasks = records.select("agent_id").distinct().where(number != 13).select("agent_id", F.when(number % 2 == 0, "translation").otherwise("context_qa").alias("task"))
    return N.with_tasks(records, tasks).groupBy("task", "valid").agg(F.count("*").alias("n"), F.count_distinct("agent_id").alias("n_agents"))


@query(
    "records_generation_requests",
    """SELECT task, 9 AS n, false AS edge_case, '' AS seeds FROM (SELECT DISTINCT task FROM scored) UNION ALL
       SELECT task, 4, true, string_agg(test_id, ',' ORDER BY test_id) FROM (SELECT DISTINCT task, test_id FROM (
         SELECT task, test_id, score, model_id, row_number() OVER (PARTITION BY task ORDER BY score, test_id, model_id) AS k FROM (SELECT * FROM scored WHERE score < 0.3 ORDER BY score, task, test_id, model_id LIMIT 50)) WHERE k <= 5
         QUALIFY row_number() OVER (PARTITION BY task ORDER BY test_id) <= 5) GROUP BY task""",
)
def generation(t):
    """Examples to ask for, and the quota of edge cases built on the worst results."""
    asked = N.generation_requests(t.scored.select("task"), E.low_score_seeds(t.scored), 9)
    return asked.select("task", "n", "edge_case", F.array_join("seed_ids", ",").alias("seeds"))


@query("eval_restrict_fallback", "SELECT model_id, count(*) AS n FROM scored GROUP BY 1")
def restrict_fallback(t):
    """None of the models asked for is there: all count."""
    wanted = t.prices.select(F.concat("model_id", F.lit("-unknown")).alias("model_id"))
    return restrict_or_all(t.scored, wanted, "model_id").groupBy("model_id").agg(F.count("*").alias("n"))


@query("eval_membership", "SELECT 'some' AS wanted, model_id, count(*) AS n FROM scored WHERE model_id IN ('m0', 'm2') GROUP BY ALL UNION ALL SELECT 'any', model_id, count(*) FROM scored GROUP BY ALL")
def members(t):
    """Rows of the models asked for; where none is, all of them."""
    counted = lambda wanted, name: membership(t.scored, "model_id", wanted).groupBy(F.lit(name).alias("wanted"), "model_id").agg(F.count("*").alias("n"))
    return counted(["m0", "m2"], "some").unionByName(counted([], "any"))


@query("eval_job_status", "SELECT count(*) FILTER (event_type = 'view') AS running, count(*) FILTER (event_type = 'purchase') AS completed, count(*) FILTER (event_type = 'error') AS failed FROM events")
def job_status(t):
    status = F.when(F.col("event_type") == "view", "running").when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("queued")
    return E.status_counts(t.read("events").select(status.alias("status")))


@query(
    "eval_model_statistics",
    """SELECT model_id, round(sum(s) / sum(n), 6) AS avg_score, round(sum(c) / sum(n), 6) AS accuracy, CAST(sum(e) AS BIGINT) AS errors, round(sum(e) / sum(n), 6) AS error_rate,
       arg_max(task, (a, task)) AS best, arg_min(task, (a, task)) AS worst, string_agg(task || '=' || format('{:.6f}', round(a, 6)), ',' ORDER BY task) AS scores FROM (SELECT task, model_id, avg(score) AS a, count(*) AS n, sum(score) AS s, count(*) FILTER (correct) AS c, count(error) AS e FROM scored GROUP BY ALL) GROUP BY 1""",
)
def model_stats(t):
    return _scores_as_text(E.model_statistics(t.scored))


# retrieval

_STORE_TEXTS = """
told AS (SELECT f.*, CASE WHEN d.store_id IS NOT NULL THEN 1 ELSE 0 END AS promo, CASE WHEN p.since_year IS NOT NULL THEN 1 ELSE 0 END AS has_promo2 FROM fact f
    LEFT JOIN (SELECT DISTINCT store_id, date FROM promo_days) d ON f.store_id = d.store_id AND f.date = d.date LEFT JOIN promo p ON f.store_id = p.store_id WHERE is_train = 1),
own AS (SELECT store_id, any_value(description_type) AS kind, any_value(description_assortment) AS level, any_value(state) AS state, median(distance_meters) AS dist, any_value(open_since_year) AS since,
    avg(sales) FILTER (is_open = 1) AS sales, avg(promo) AS promo, avg(has_promo2) AS p2, avg(temperature_avg) AS ta, avg(precipitation_mm) AS pr, avg(gdp_index) AS gdp, avg(unemployment_rate) AS ur,
    avg(trend_index) AS ti, avg(has_local_event) AS ev FROM told GROUP BY 1),
dow AS (SELECT store_id, isodow(date) AS k, ['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday'][isodow(date)] AS name, CAST(round_even(round(avg(sales), 6), 0) AS BIGINT) AS v FROM told WHERE is_open = 1 GROUP BY ALL),
days7 AS (SELECT store_id, string_agg(name || ': ' || v, ', ' ORDER BY k) AS x, arg_min(name, (v, k)) AS low, min(v) AS lo, arg_max(name, (v, -k)) AS high, max(v) AS hi FROM dow GROUP BY 1),
mon AS (SELECT store_id, string_agg(name || ': ' || v, ', ' ORDER BY k) AS x FROM (SELECT store_id, month(date) AS k, strftime(make_date(2000, month(date), 1), '%b') AS name, CAST(round_even(round(avg(sales), 6), 0) AS BIGINT) AS v
    FROM told WHERE is_open = 1 GROUP BY ALL) GROUP BY 1),
sky AS (SELECT store_id, weather_event FROM told WHERE weather_event IS NOT NULL GROUP BY store_id, weather_event QUALIFY row_number() OVER (PARTITION BY store_id ORDER BY count(*) DESC, weather_event) = 1),
texts AS (SELECT store_id, concat_ws(' ', 'Store ID ' || store_id || '.', 'Store Type: ' || kind || '.', 'Assortment: ' || level || '.', 'State: ' || state || '.', 'Competitor distance: ' || CAST(round_even(round(dist, 6), 0) AS BIGINT) || ' meters.',
    'Open since: ' || CAST(since AS BIGINT) || '.', 'Average daily sales (open days): ' || CAST(round_even(round(sales, 6), 0) AS BIGINT) || '.', 'Average sales by day of week — ' || days7.x || '.',
    'Lowest sales day: ' || low || ' (' || lo || '). Highest: ' || high || ' (' || hi || ').', 'Average sales by month — ' || mon.x || '.', 'Promotion active ' || CAST(round_even(round(promo * 100, 6), 0) AS BIGINT) || '% of days.',
    'Has Promo2 scheme: ' || CASE WHEN p2 > 0.5 THEN 'yes' ELSE 'no' END || '.', 'Avg temperature: ' || CAST(round(CAST(round(ta, 6) AS DECIMAL(18, 6)), 1) AS VARCHAR) || '.', 'Avg precipitation mm: ' || CAST(round(CAST(round(pr, 6) AS DECIMAL(18, 6)), 1) AS VARCHAR) || '.', 'Most common weather: ' || weather_event || '.',
    'GDP index: ' || CAST(round(CAST(round(gdp, 6) AS DECIMAL(18, 6)), 2) AS VARCHAR) || '.', 'Unemployment rate: ' || CAST(round(CAST(round(ur, 6) AS DECIMAL(18, 6)), 2) AS VARCHAR) || '.', 'Google Trend index: ' || CAST(round(CAST(round(ti, 6) AS DECIMAL(18, 6)), 2) AS VARCHAR) || '.', 'Local events on ' || CAST(round_even(round(ev * 100, 6), 0) AS BIGINT) || '% of days.') AS content
    FROM own LEFT JOIN days7 USING (store_id) LEFT JOIN mon USING (store_id) LEFT JOIN sky USING (store_id))"""
_NEAREST = """near AS (SELECT query_id, id, rank, d FROM (SELECT q.vec_id AS query_id, v.vec_id AS id, d, row_number() OVER (PARTITION BY q.vec_id ORDER BY d, v.vec_id) AS rank FROM embeddings q, embeddings v,
       LATERAL (SELECT sqrt(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda x: (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)) ** 2))) AS d) WHERE q.vec_id % 50 = 0) WHERE rank <= 5)"""


def retail_query(name: str, sql: str, *more: str):
    def register(f):
        QUERIES[name] = f
        ORACLE_SQL[name] = retail_sql(sql, *more)
        return f

    return register


def store_texts(t: Retail) -> DataFrame:
    rows = continuous_promo(promo_flag(staged_fact(t), t.promo_days), t.promo)
    return V.store_documents(rows)


@retail_query("retrieval_documents", "SELECT store_id, content FROM texts", _STORE_TEXTS)
def documents(spark, sf_dir):
    return store_texts(Retail(spark, sf_dir))


@query("retrieval_nearest", "SELECT query_id, id, rank, round(d, 4) AS distance FROM near", _NEAREST)
def nearest(t):
    e = t.read("embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return rounded(V.nearest(e, e.where("id % 50 = 0")), 4)


@retail_query(
    "retrieval_forced_context",
    """SELECT query_id, string_agg(content, chr(10) || chr(10) ORDER BY rank) AS context FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank FROM (
       SELECT query_id, id, rank AS r FROM near UNION ALL SELECT q.vec_id, q.vec_id + 1, 0 FROM embeddings q WHERE q.vec_id % 50 = 0 AND NOT EXISTS (SELECT 1 FROM near WHERE query_id = q.vec_id AND id = q.vec_id + 1)))
       JOIN texts ON store_id = id % 10 + 1 WHERE rank <= 5 AND id IN (SELECT vec_id FROM embeddings) GROUP BY 1""",
    _STORE_TEXTS, _NEAREST,
)
def forced(spark, sf_dir):
    """Each vector stands for a store's text; every fiftieth asks, and names the next one."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    asked = e.where("id % 50 = 0")
    questions = asked.select(F.col("id").alias("query_id"), F.concat(F.lit("What sells best in store #"), F.col("id") + 1, F.lit("?")).alias("question"))
    texts = store_texts(Retail(spark, sf_dir)).withColumnRenamed("store_id", "store")
    named = e.join(texts.hint("shuffle_hash"), F.col("store") == F.col("id") % 10 + 1).select(F.col("id").alias("store_id"), "content")
    return V.context(V.forced_context(V.nearest(e, asked), questions), named)


_VECTORS = """toks AS (SELECT store_id, unnest(regexp_extract_all(lower(content), '[a-z0-9.]+')) AS t FROM texts),
tfs AS (SELECT store_id, CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % 256 AS place, count(*) AS tf FROM toks GROUP BY ALL),
idf AS (SELECT place, ln((1 + (SELECT count(*) FROM texts WHERE store_id % 2 = 0)) / (1 + count(*) FILTER (store_id % 2 = 0))) + 1 AS idf FROM tfs GROUP BY 1),
wts AS (SELECT store_id, place, (1 + ln(tf)) * idf AS w FROM tfs JOIN idf USING (place)),
vec AS (SELECT store_id, place, w / sqrt(sum(w * w) OVER (PARTITION BY store_id)) AS w FROM wts)"""


def _vector_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of every other store make the table, cut short; those of all stores bring it up to date."""
    docs = staged(store_texts(Retail(spark, sf_dir)).withColumnRenamed("store_id", "id"), "store-texts")
    at = f"{shared_folder(spark)}/vector-table-{uuid.uuid4().hex}"
    even = docs.where("id % 2 = 0")
    upsert_vectors(even, at)
    upsert_vectors(even.where("id % 4 = 0").withColumn("content", F.lit("gone")), at)
    upsert_vectors(docs, at)
    return read_vectors(spark, at)


@retail_query("retrieval_vector_table", "SELECT store_id, CAST(place AS INTEGER) AS place, round(w, 6) AS weight FROM vec", _STORE_TEXTS, _VECTORS)
def vector_table(spark, sf_dir):
    found = _vector_table(spark, sf_dir).select(F.col("id").alias("store_id"), F.posexplode("embedding").alias("place", "weight"))
    return rounded(found.where("weight <> 0"))


@retail_query(
    "retrieval_vector_search",
    """SELECT query_id, id, rank, round(d, 4) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), id) AS rank FROM (
         SELECT a.store_id AS query_id, b.store_id AS id, sqrt(greatest(2 - 2 * coalesce(s, 0), 0)) AS d FROM texts a CROSS JOIN texts b LEFT JOIN (SELECT x.store_id AS p, y.store_id AS q, sum(x.w * y.w) AS s FROM vec x JOIN vec y USING (place) GROUP BY ALL) ON p = a.store_id AND q = b.store_id
         WHERE a.store_id % 10 = 0 AND a.store_id <> b.store_id)) WHERE rank <= 5""",
    _STORE_TEXTS, _VECTORS,
)
def vector_search(spark, sf_dir):
    """The texts most like every tenth store's, its own aside."""
    table = _vector_table(spark, sf_dir).select("id", "embedding")
    found = V.nearest(table, table.where("id % 10 = 0"), 6, digits=9).where("query_id <> id").select("query_id", "id", F.round("distance", 9).alias("distance"))
    return rounded(V.top_k(found, 5), 4)
