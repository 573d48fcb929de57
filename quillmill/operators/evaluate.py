"""Evaluation of model outputs: dispatch by task, composite scores, aggregates, reports, anomalies, comparison."""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.operators.relational import first_k, keep_first

TASKS = [
    "classification", "context_qa", "metadata_extraction", "code_generation", "translation",
    "summarization", "rephrasing", "sql_generation", "pii_redaction", "intent_detection",
]


def composite(task: Column, output: Column, truth: Column, judge: Column, given: Column, outcome: dict[str, Column] | None = None) -> Column:
    """The unrounded score of one output, by task; null for an unknown task.

    ``truth`` counts as present if not empty. ``outcome`` may hold code results as columns syntax, run and tests.
    """
    has = T.normal(truth) != ""
    match = F.greatest(T.exact_match(output, truth), T.contains_match(output, truth))
    f1, length = T.token_f1(output, truth), T.length_ratio(output, truth)
    valid, keys, values = T.json_validity(output), T.json_key_match(output, truth), T.json_value_match(output, truth)
    sql, near = T.sql_syntax(T.fenced(output)), T.sql_similarity(output, truth)
    ranked = T.ranked_intents(output)
    rank = F.when((F.size(ranked) > 0) & has, F.greatest(T.precision_at(ranked, truth, 1), T.contains_match(output, truth))).otherwise(match)
    o = outcome or {k: F.lit(None).cast("double") for k in ("syntax", "run", "tests")}
    syntax = F.coalesce(o["syntax"], F.lit(0.0))
    code = (
        F.when(o["tests"].isNotNull(), 0.10 * syntax + 0.15 * F.coalesce(o["run"], F.lit(0.0)) + 0.25 * o["tests"] + 0.5 * judge)
        .when(o["run"].isNotNull(), 0.15 * syntax + 0.15 * o["run"] + 0.70 * judge)
        .otherwise(0.30 * syntax + 0.70 * judge)
    )
    return (
        F.when(task == "classification", F.when(has, 0.5 * match + 0.5 * judge).otherwise(judge))
        .when(task == "context_qa", F.when(has, 0.4 * f1 + 0.6 * judge).otherwise(judge))
        .when(task == "metadata_extraction", F.when(has, 0.5 * (0.3 * valid + 0.35 * keys + 0.35 * values) + 0.5 * judge).otherwise(0.3 * valid + 0.7 * judge))
        .when(task == "code_generation", code)
        .when(task.isin("translation", "summarization", "rephrasing"), F.when(has, 0.4 * (0.5 * f1 + 0.5 * length) + 0.6 * judge).otherwise(judge))
        .when(task == "sql_generation", F.when(has & (near > 0), 0.25 * sql + 0.05 * near + 0.70 * judge).otherwise(0.30 * sql + 0.70 * judge))
        .when(task == "pii_redaction", 0.5 * T.redaction(given, output, F.when(has, truth))["f1"] + 0.5 * judge)
        .when(task == "intent_detection", F.when(has, 0.5 * rank + 0.5 * judge).otherwise(judge))
    )


def evaluate(log: DataFrame, judge: str | None = None) -> DataFrame:
    """log(test_id, model_id, task, success, output_text, ground_truth, judge_score, given) with ``score`` and ``correct``.

    A failed inference scores 0 and is not correct; unknown tasks and the judge's own rows are left out. Results of
    generated code enter as columns code_syntax, code_run and code_tests (0 to 1, null: not run), where the log has them.
    """
    rows = log.where(F.col("task").isin(TASKS))
    rows = rows.where(F.col("model_id") != judge) if judge else rows
    outcome = {k: F.col(f"code_{k}") if f"code_{k}" in log.columns else F.lit(None).cast("double") for k in ("syntax", "run", "tests")}
    raw = F.when(F.col("success"), composite(F.col("task"), F.col("output_text"), F.col("ground_truth"), F.col("judge_score"), F.col("given"), outcome)).otherwise(0.0)
    return rows.withColumn("__raw", raw).withColumns({"score": F.bround("__raw", 3), "correct": F.col("success") & (F.col("__raw") >= 0.5)}).drop("__raw")


def consensus(scores: DataFrame, opinions: DataFrame) -> DataFrame:
    """``consensus``: mean of two or more scorers, for rows without truth; ``judge_blended`` is its mean with the judge's."""
    many = opinions.groupBy("test_id", "model_id").agg(F.bround(F.avg("opinion"), 3).alias("c"), F.count("*").alias("n")).where("n >= 2")
    out = scores.join(many.drop("n"), ["test_id", "model_id"], "left").withColumn("consensus", F.when(F.col("ground_truth").isNull(), F.col("c"))).drop("c")
    return out.withColumn("judge_blended", F.when(F.col("consensus").isNotNull(), (F.col("judge_score") + F.col("consensus")) / 2).otherwise(F.col("judge_score")))


def score_aggregates(scored: DataFrame) -> DataFrame:
    """Per (task, model) and per model (task null) in one pass: avg_score, n, n_correct, accuracy."""
    return scored.groupingSets([[F.col("task"), F.col("model_id")], [F.col("model_id")]], "task", "model_id").agg(
        F.avg("score").alias("avg_score"), F.count("*").alias("n"), F.count_if("correct").alias("n_correct"), F.avg(F.col("correct").cast("int")).alias("accuracy")
    )


def operative_metrics(log: DataFrame, prices: DataFrame) -> DataFrame:
    """Per (model, task): requests, errors, retries, tokens, mean latency of successes (1 digit), cost (6 digits)."""
    sums = log.groupBy("model_id", "task").agg(
        F.count("*").alias("requests"), F.count_if(~F.col("success")).alias("errors"), F.sum("retries").alias("retries"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"), F.avg(F.when(F.col("success"), F.col("latency_ms"))).alias("latency"),
    )
    price = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    cost = (F.col("input_tokens") * price("cost_input_1m") + F.col("output_tokens") * price("cost_output_1m")) / 1e6
    joined = sums.join(prices, "model_id", "left").withColumns({"avg_latency_ms": F.round("latency", 1), "cost": F.round(cost, 6), "cost_per_request": F.round(cost / F.col("requests"), 6)})
    return joined.drop("latency", "cost_input_1m", "cost_output_1m")


def model_rollup(metrics: DataFrame) -> DataFrame:
    """Per model over ``operative_metrics``: the latency is the plain mean of the tasks' means."""
    sums = [F.sum(c).alias(c) for c in ("requests", "errors", "retries", "input_tokens", "output_tokens", "cost")]
    return metrics.groupBy("model_id").agg(*sums, F.avg("avg_latency_ms").alias("avg_latency_ms")).orderBy(F.desc("cost"), "model_id")


def best_models(aggregates: DataFrame) -> DataFrame:
    """The model of the best rounded mean per task, and overall (task 'Overall'); ties to the smaller id."""
    named = aggregates.withColumns({"task": F.coalesce("task", F.lit("Overall")), "avg_score": F.bround("avg_score", 3)})
    return keep_first(named, ["task"], [F.desc("avg_score"), "model_id"]).select("task", "model_id", "avg_score", "n")


def score_pivot(aggregates: DataFrame, tasks: list[str]) -> DataFrame:
    """Models as rows, tasks as columns, and Overall."""
    named = aggregates.withColumn("task", F.coalesce("task", F.lit("Overall")))
    return named.groupBy("model_id").pivot("task", [*sorted(tasks), "Overall"]).agg(F.first("avg_score"))


def member_statistics(scored: DataFrame, group: str, member: str) -> DataFrame:
    """Per group: avg, accuracy, errors, error rate, best and worst member and a map of members' means."""
    each = scored.groupBy(group, member).agg(F.avg("score").alias("a"), F.count("*").alias("n"), F.sum("score").alias("s"), F.count_if("correct").alias("c"), F.count_if(F.col("error").isNotNull()).alias("e"))
    order = F.struct(F.col("a"), F.col(member))
    return each.groupBy(group).agg(
        (F.sum("s") / F.sum("n")).alias("avg_score"), (F.sum("c") / F.sum("n")).alias("accuracy"), F.sum("e").alias("errors"), (F.sum("e") / F.sum("n")).alias("error_rate"),
        F.max_by(member, order).alias("best"), F.min_by(member, order).alias("worst"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(member), F.round("a", 6).alias("a"))))).alias("scores"),
    )


def failure_ids(scored: DataFrame, below: float = 0.5) -> DataFrame:
    """task, test_id of the records below a score, a row each."""
    return scored.where((F.col("score") < below) & (F.col("test_id") != "")).select("task", "test_id").distinct()


def failure_counts(scored: DataFrame, below: float = 0.5) -> DataFrame:
    """Per task and model how many records are below a score."""
    return scored.where(F.col("score") < below).groupBy("task", "model_id").agg(F.count("*").alias("n"))


def anomalies(scored: DataFrame, limit: int = 20) -> DataFrame:
    """Records that score 0 though there is a truth, then models with over a fifth of errors; ``limit`` rows."""
    zero = scored.where((F.col("score") == 0) & F.col("ground_truth").isNotNull()).select(F.lit(0).alias("kind"), "model_id", "test_id", F.col("score").alias("value"))
    rate = scored.groupBy("model_id").agg(F.avg(F.col("error").isNotNull().cast("double")).alias("value")).where("value > 0.2")
    return zero.unionByName(rate.select(F.lit(1).alias("kind"), "model_id", F.lit(None).cast("string").alias("test_id"), "value")).orderBy("kind", "model_id", "test_id").limit(limit)


def error_patterns(scored: DataFrame, advice: DataFrame | None = None) -> DataFrame:
    """Tasks of mean below 0.7 with severity, up to five low ids, the model that fails most, and advice if given."""
    avg = scored.groupBy("task").agg(F.avg("score").alias("avg_score")).where("avg_score < 0.7")
    severity = F.when(F.col("avg_score") < 0.3, "high").when(F.col("avg_score") < 0.5, "medium").otherwise("low")
    bad = scored.where("score < 0.5")
    ids = first_k(bad.select("task", "test_id").distinct(), ["task"], ["test_id"], 5).groupBy("task").agg(F.array_sort(F.collect_list("test_id")).alias("sample_ids"))
    worst = keep_first(bad.groupBy("task", "model_id").count(), ["task"], [F.desc("count"), "model_id"]).select("task", F.col("model_id").alias("worst_model"), F.col("count").alias("worst_failures"))
    out = avg.withColumn("severity", severity).join(ids, "task", "left").join(worst, "task", "left")
    return out.join(advice, "task", "left") if advice is not None else out


def low_score_seeds(scored: DataFrame, below: float = 0.3, total: int = 50, per_task: int = 5) -> DataFrame:
    low = scored.where(F.col("score") < below).orderBy("score", "task", "test_id", "model_id").limit(total)
    return first_k(low, ["task"], ["score", "test_id", "model_id"], per_task)


def verdict_table(scored: DataFrame) -> DataFrame:
    """Per (test, model) the last row's output and whether it is correct, with the header columns of the test's first row.

    The legacy verdict compares the whole legacy output with the whole truth; what is shown is cut at 500 characters.
    """
    shown = lambda c: F.substring(c, 1, 500).alias(c)
    head = keep_first(scored, ["test_id"], ["seq"]).select("test_id", "task", shown("legacy_output"), T.legacy_verdict(F.col("legacy_output"), F.col("ground_truth")).alias("legacy_verdict"))
    last = keep_first(scored, ["test_id", "model_id"], [F.desc("seq")])
    verdict = F.when(F.coalesce("correct", F.lit(False)), "CORRECT").otherwise("INCORRECT")
    return last.select("test_id", "model_id", shown("output_text"), verdict.alias("verdict")).join(head, "test_id")


def variant_scores(scored: DataFrame) -> DataFrame:
    return scored.groupBy("iteration", "variant").agg(F.bround(F.avg("score"), 3).alias("avg_score"), F.count("*").alias("n"), F.count_if("correct").alias("n_correct"))


def multi_objective(df: DataFrame, weights: tuple[float, float, float] = (0.70, 0.15, 0.15)) -> DataFrame:
    """``composite``: quality, and cost and latency against the baseline's, missing ones counting as equal."""
    ratio = lambda b, c: F.coalesce(F.least(F.lit(1.0), F.try_divide(F.col(b), F.col(c))), F.lit(1.0))
    q, c, la = weights
    return df.withColumn("composite", F.bround(q * F.col("avg_score") + c * ratio("base_cost", "cost") + la * ratio("base_latency", "latency"), 4))


def beam(candidates: DataFrame, k: int) -> DataFrame:
    """The k best of beam and candidates; the incumbent wins ties, then the lower number."""
    return candidates.orderBy(F.desc("avg_score"), "is_candidate", "idx").limit(k)


def iterative_selection(table: DataFrame, min_gain: float = 0.01) -> DataFrame:
    """The history of a search: per iteration the best variant so far, up to the first iteration that gains ``min_gain`` or less.

    The first iteration is the baseline. One that brings nothing better shows the incumbent, which also wins ties;
    the last row of a search that ended so is marked ``stopped_early``.
    """
    own = keep_first(table, ["iteration"], [F.desc("avg_score"), "variant"])  # one row per iteration
    order = Window.orderBy("iteration")
    so_far = F.max(F.struct("avg_score", (-F.col("iteration")).alias("earlier"), "variant", "n_correct"))
    best = own.select("iteration", so_far.over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("b"), so_far.over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("old"))
    weak = F.coalesce(F.round(F.col("b.avg_score") - F.col("old.avg_score"), 9) <= min_gain, F.lit(False))
    marked = best.withColumns({"stopped_early": weak, "is_baseline": F.col("old").isNull()})
    stops = F.coalesce(F.sum(F.col("stopped_early").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return marked.withColumn("stops", stops).where("stops = 0").select("iteration", "b.variant", "b.avg_score", "b.n_correct", "is_baseline", "stopped_early")


def ablation(history: DataFrame, by: list[str] | None = None, k: int = 10) -> DataFrame:
    """Delta to the iteration before (4 digits), words added and removed (up to k), and its sign in words.

    ``by``: columns that tell histories apart; without them the table is one history, a row per iteration.
    """
    keys = by or []
    order = Window.partitionBy(*keys).orderBy("iteration")
    before = F.lag("prompt").over(order)
    delta = F.bround(F.col("avg_score") - F.lag("avg_score").over(order), 4)
    rows = history.withColumns({"delta": delta, "before": before}).where("before IS NOT NULL")
    added, removed = (F.slice(F.array_except(T.tokens(F.col(a)), T.tokens(F.col(b))), 1, k) for a, b in (("prompt", "before"), ("before", "prompt")))
    effect = F.when(F.col("delta") > 0, "positive").when(F.col("delta") < 0, "negative").otherwise("neutral")
    return rows.select(*keys, "iteration", "delta", added.alias("added"), removed.alias("removed"), effect.alias("effect"))


def feedback_text(avg_score: Column, n: Column, n_correct: Column, errors: Column | None = None) -> Column:
    """What an evaluation tells whoever writes the next prompt, a line for each figure that is there.

    ``errors``: the common ones as an array, of which three are named. All null: there was no evaluation.
    """
    some = F.coalesce(n, F.lit(0)) > 0
    right = F.coalesce(n_correct, F.lit(0))
    lines = [
        F.when(avg_score.isNotNull(), F.format_string("Average score: %.3f", avg_score)),
        F.when(some, F.concat(F.lit("Records evaluated: "), n.cast("string"))),
        F.when(some, F.format_string("Correct: %d/%d (%.1f%%)", right.cast("long"), n.cast("long"), 100.0 * right / n)),
    ]
    if errors is not None:
        lines.append(F.when(F.size(errors) > 0, F.concat(F.lit("Common errors: "), F.array_join(F.slice(errors, 1, 3), "; "))))
    text = F.concat_ws("\n", *lines)
    none = avg_score.isNull() & n.isNull() & n_correct.isNull()
    return F.when(none, "No previous evaluation available.").when(text == "", "Score below target.").otherwise(text)


def feedback(scored: DataFrame, by: list[str]) -> DataFrame:
    """Per group the feedback text, its three commonest errors among it (ties in order)."""
    each = scored.groupBy(*by).agg(F.avg("score").alias("a"), F.count("*").alias("n"), F.count_if("correct").alias("c"))
    named = scored.where("error IS NOT NULL").groupBy(*by, "error").count()
    errors = first_k(named, by, [F.desc("count"), "error"], 3).groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("count"), "error"))), lambda x: x["error"]).alias("errors"))
    return each.join(errors, by, "left").select(*by, feedback_text(F.col("a"), F.col("n"), F.col("c"), F.coalesce("errors", F.array().cast("array<string>"))).alias("feedback"))


def mean_latency(scored: DataFrame, log: DataFrame) -> DataFrame:
    """Per model the mean latency of the log's rows that were scored; null and 0 do not count."""
    return scored.join(log.select("test_id", "model_id", "latency_ms"), ["test_id", "model_id"]).groupBy("model_id").agg(F.avg(F.nullif(F.col("latency_ms"), F.lit(0.0))).alias("avg_latency_ms"))


def _t_tail(t: float, df: int) -> float:
    """P(T > t) of Student's distribution, by the continued fraction of the incomplete beta function."""
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(max(1 - x, 1e-300)))

    def fraction(a: float, b: float, x: float) -> float:
        c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
        h = d
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / (1 + num * d)
                c = 1 + num / c
                h *= d * c
        return h

    beta = front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b
    return beta / 2 if t > 0 else 1 - beta / 2


def paired_t_test(base: DataFrame, variant: DataFrame, key: str = "test_id") -> DataFrame:
    """One-sided paired test that the variant scores higher: n, mean_diff, t, p, significant; no row for n < 2."""
    d = base.select(key, F.col("score").alias("a")).join(variant.select(key, F.col("score").alias("b")), key).select((F.col("b") - F.col("a")).alias("d"))
    one = d.agg(F.count("*").alias("n"), F.avg("d").alias("mean_diff"), F.stddev_samp("d").alias("sd")).where("n >= 2")
    tail = F.udf(lambda t, n: None if t is None else _t_tail(t, n - 1), "double")  # one aggregated row
    t = F.when(F.col("sd") > 0, F.col("mean_diff") / (F.col("sd") / F.sqrt("n")))
    out = one.withColumn("t", t).withColumn("p", tail("t", "n"))
    return out.select("n", "mean_diff", F.bround("t", 4).alias("t"), F.bround("p", 4).alias("p"), (F.col("p") < 0.05).alias("significant"))


#: Of 65,536 values of four hex digits, those up to each bound give a weight of 0, 1, 2 ... as a Poisson variable of mean 1 has it.
WEIGHT_BOUNDS = [round(65536 * math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1))) for k in range(8)]


def bootstrap_interval(base: DataFrame, variant: DataFrame, key: str = "test_id", rounds: int = 1000, seed: int = 42) -> DataFrame:
    """95% interval of the mean difference by the Poisson bootstrap.

    A pair's weight in round r comes from hex digits 4 * (r % 8) on of the MD5 of ``seed:key:(r // 8)``, so it depends on nothing
    else and any engine can compute it. Each batch sums its weights for all rounds in place; a row per batch and round
    is exchanged.
    """
    d = base.select(key, F.col("score").alias("a")).join(variant.select(key, F.col("score").alias("b")), key).select(F.col(key).cast("string").alias("k"), (F.col("b") - F.col("a")).alias("d"))
    bounds, eighths = np.array(WEIGHT_BOUNDS), -(-rounds // 8)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight, total = np.zeros(rounds), np.zeros(rounds)
            for k, x in zip(batch.column("k").to_pylist(), batch.column("d").to_pylist(), strict=True):
                digits = b"".join(hashlib.md5(f"{seed}:{k}:{e}".encode()).digest() for e in range(eighths))
                w = np.searchsorted(bounds, np.frombuffer(digits, ">u2")[:rounds], "right")
                weight += w
                total += x * w
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(rounds)), pa.array(weight), pa.array(total)], names=["round", "w", "s"])

    means = d.where("d IS NOT NULL").mapInArrow(weigh, "round long, w double, s double").groupBy("round").agg(F.try_divide(F.sum("s"), F.sum("w")).alias("m")).where("m IS NOT NULL")
    got = means.agg(F.array_sort(F.collect_list("m")).alias("m"), F.count("*").alias("n")).crossJoin(F.broadcast(d.agg(F.avg("d").alias("mean_diff"))))  # one value per round
    low, high = (F.get("m", F.least(F.floor(F.col("n") * q), F.col("n") - 1).cast("int")) for q in (0.025, 0.975))
    return got.where("n > 0").select(F.bround("mean_diff", 4).alias("mean_diff"), F.bround(low, 4).alias("low"), F.bround(high, 4).alias("high"), (low > 0).alias("significant"))


def models_of(scored: DataFrame, limit: int = 200) -> list[str]:
    """The models of a report in order, columns of its sheets; a ValueError beyond ``limit``."""
    found = [r[0] for r in scored.select("model_id").where("model_id IS NOT NULL").distinct().orderBy("model_id").limit(limit + 1).collect()]
    if len(found) > limit:
        raise ValueError(f"more than {limit} models")
    return found


def verdict_sheet(scored: DataFrame, models: list[str]) -> DataFrame:
    """A row a test: task, legacy output and verdict, then ``<model> output`` and ``<model> verdict``, empty and 'N/A' where a model has none."""
    mine = lambda m, c: F.max(F.when(F.col("model_id") == m, F.col(c)))
    columns = [x for m in models for x in (F.coalesce(mine(m, "output_text"), F.lit("")).alias(f"{m} output"), F.coalesce(mine(m, "verdict"), F.lit("N/A")).alias(f"{m} verdict"))]
    return verdict_table(scored).groupBy("test_id", "task", "legacy_output", "legacy_verdict").agg(*columns)


def overview_sheet(aggregates: DataFrame, tasks: list[str]) -> DataFrame:
    """A row a model: rounded mean score by task, empty where it has none, and overall, as text."""
    shown = lambda c: F.when(c.isNotNull(), F.format_string("%.3f", F.bround(c, 3))).otherwise("")
    cell = lambda t: shown(F.max(F.when(F.col("task") == t, F.col("avg_score")))).alias(t)
    return aggregates.groupBy(F.col("model_id").alias("Model")).agg(*map(cell, tasks), shown(F.max(F.when(F.col("task").isNull(), F.col("avg_score")))).alias("Overall"))


#: Columns of the inference log.
LOG = "test_id string, model_id string, task string, success boolean, retries long, latency_ms double, input_tokens long, output_tokens long, error string, ts string"


def validated_log(lines: DataFrame, line: str = "value") -> tuple[DataFrame, DataFrame]:
    """JSON lines of the inference log -> (a row for each (test, model), rejected lines with their reason).

    Rejected: what does not fit the schema (``malformed``), lacks test or model (``no key``), or has a negative count or
    time (``negative``). Of a call that was retried, the row with most retries stays, then the latest, then the first by
    its text. Blank lines are dropped.
    """
    schema = f"{LOG}, broken string"
    some = lines.where(T.strip(F.col(line)) != "").select(F.col(line).alias("line"))
    parsed = some.withColumn("r", F.from_json("line", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}))
    amounts = [F.coalesce(F.col(f"r.{c}") < 0, F.lit(False)) for c in ("retries", "latency_ms", "input_tokens", "output_tokens")]
    reason = (
        F.when(F.col("r").isNull() | F.col("r.broken").isNotNull(), "malformed")
        .when((F.coalesce("r.test_id", F.lit("")) == "") | (F.coalesce("r.model_id", F.lit("")) == ""), "no key")
        .when(functools.reduce(Column.__or__, amounts), "negative")
    )
    judged = parsed.withColumn("reason", reason)
    good = judged.where("reason IS NULL").select("r.*", "line").drop("broken")
    once = keep_first(good, ["test_id", "model_id"], [F.desc_nulls_last("retries"), F.desc_nulls_last("ts"), "line"])
    return once.drop("line").withColumn("ts", F.try_to_timestamp("ts")), judged.where("reason IS NOT NULL").select(F.col("line").alias(line), "reason")


def status_counts(jobs: DataFrame) -> DataFrame:
    """running, completed, failed: jobs by status; other statuses count for none."""
    return jobs.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("running", "completed", "failed")))


def model_statistics(scored: DataFrame) -> DataFrame:
    return member_statistics(scored, "model_id", "task")
