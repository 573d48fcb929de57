"""Test records: validation, agent profiles, prompt samples, rule-based task identification, generated examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.operators.evaluate import TASKS
from quillmill.operators.relational import first_k, keep_first

REQUIRED = ["test_id", "input_messages", "ground_truth", "expected_output_type", "metadata", "agent_id", "output"]
MESSAGES = "array<struct<role:string,content:string>>"
WEIGHTS = {"system": 3.0, "user": 2.0, "output": 5.0}
#: The type of output each task expects, 'text' for the others.
OUTPUT_TYPES = {"classification": "label", "metadata_extraction": "json", "code_generation": "code", "sql_generation": "sql", "intent_detection": "label"}


def read_records(lines: DataFrame, line: str = "value") -> tuple[DataFrame, DataFrame]:
    """JSON lines -> (objects with their keys, quarantined lines that are no JSON object). Blank lines are dropped.

    A key that is absent differs from one that is null, so keys are kept beside the parsed fields.
    """
    some = lines.where(T.strip(F.col(line)) != "")
    keyed = some.withColumn("keys", F.json_object_keys(F.when(F.try_parse_json(F.col(line)).isNotNull(), F.col(line))))
    good = keyed.where("keys IS NOT NULL")
    get = lambda k: F.get_json_object(F.col(line), f"$.{k}").alias(k)
    names = [k for k in REQUIRED if k != "input_messages"]
    messages = F.from_json(F.get_json_object(F.col(line), "$.input_messages"), MESSAGES).alias("messages")
    return good.select(*(c for c in lines.columns if c != line), "keys", *map(get, names), messages), keyed.where("keys IS NULL").drop("keys")


def is_quarantined(line: Column) -> Column:
    """Whether a line is neither blank nor a JSON object."""
    return (T.strip(line) != "") & F.json_object_keys(F.when(F.try_parse_json(line).isNotNull(), line)).isNull()


def is_valid(keys: Column, messages: Column) -> Column:
    """All required keys present (null values allowed) and a list of messages with a system and a user one."""
    has = lambda r: F.coalesce(F.exists(messages, lambda m: m["role"] == r), F.lit(False))
    return (F.size(F.array_except(F.array(*map(F.lit, REQUIRED)), keys)) == 0) & messages.isNotNull() & has("system") & has("user")


def agent_profile(records: DataFrame) -> DataFrame:
    """Per agent: records, malformed, percent with ground truth among valid rows (1 digit, 0 if none)."""
    agent = F.coalesce("agent_id", F.lit("unknown")).alias("agent_id")
    counts = records.groupBy(agent).agg(F.count("*").alias("n_records"), F.count_if(~F.col("valid")).alias("n_malformed"), F.count_if("valid").alias("v"), F.count_if(F.col("valid") & F.col("ground_truth").isNotNull()).alias("t"))
    return counts.select("agent_id", "n_records", F.round(F.coalesce(F.try_divide(F.lit(100.0) * F.col("t"), F.col("v")), F.lit(0.0)), 1).alias("pct_ground_truth"), "n_malformed")


def prompt_samples(messages: DataFrame, k: int = 5) -> DataFrame:
    """messages(agent_id, seq, role, content, expected_output_type) -> per agent the first non-empty system text, the
    first k user texts joined by line ends, the first output type."""
    some = messages.where(T.strip(F.coalesce("content", F.lit(""))) != "")
    system = keep_first(some.where("role = 'system'"), ["agent_id"], ["seq"]).select("agent_id", F.col("content").alias("system_text"))
    user = first_k(some.where("role = 'user'"), ["agent_id"], ["seq"], k).groupBy("agent_id").agg(F.array_sort(F.collect_list(F.struct("seq", "content"))).alias("u"))
    user = user.select("agent_id", F.array_join(F.transform("u", lambda x: x["content"]), "\n").alias("user_text"))
    kind = messages.groupBy("agent_id").agg(F.min_by("expected_output_type", F.when(F.coalesce("expected_output_type", F.lit("")) != "", F.col("seq"))).alias("output_type"))
    return kind.join(system, "agent_id", "left").join(user, "agent_id", "left").fillna("", ["system_text", "user_text"])


def task_scores(samples: DataFrame, rules: DataFrame) -> DataFrame:
    """samples x rules(task, field, pattern) -> agent_id, task, score; each pattern counts once, by its field's weight.

    Samples are one row per agent and rules a short table, which is why the product is affordable.
    """
    field = F.when(F.col("field") == "system", F.col("system_text")).when(F.col("field") == "user", F.col("user_text")).otherwise(F.col("output_type"))
    weight = F.when(F.col("field") == "system", WEIGHTS["system"]).when(F.col("field") == "user", WEIGHTS["user"]).otherwise(WEIGHTS["output"])
    hit = F.coalesce(F.regexp_like(F.lower(field), F.col("pattern")), F.lit(False))
    return samples.crossJoin(F.broadcast(rules)).groupBy("agent_id", "task").agg(F.sum(F.when(hit, weight).otherwise(0.0)).alias("score"))


def choose_task(scores: DataFrame, tasks: list[str] = TASKS) -> DataFrame:
    """The task of the largest score; ties to the one listed first; all zero: the first listed."""
    order = F.array_position(F.array(*map(F.lit, tasks)), F.col("task"))
    return keep_first(scores, ["agent_id"], [F.desc("score"), order]).select("agent_id", F.when(F.col("score") > 0, F.col("task")).otherwise(tasks[0]).alias("task"))


def normal_label(label: Column, tasks: list[str] = TASKS) -> Column:
    """A free label as a task: exact after normalising, else the first task it contains, else null."""
    clean = F.regexp_replace(T.normal(label), r"[ -]", "_")
    first = F.coalesce(*(F.when(F.contains(clean, F.lit(t)), F.lit(t)) for t in tasks))
    return F.when(clean.isin(tasks), clean).otherwise(first)


def label_override(chosen: DataFrame, labels: DataFrame) -> DataFrame:
    """External labels win where they name a task; ``mismatch`` marks where both exist and differ."""
    named = labels.select("agent_id", normal_label(F.col("label")).alias("label_task"))
    out = chosen.withColumnRenamed("task", "rule_task").join(named, "agent_id", "left")
    return out.withColumns({"task": F.coalesce("label_task", "rule_task"), "mismatch": F.coalesce(F.col("label_task") != F.col("rule_task"), F.lit(False))})


def task_score_pivot(scores: DataFrame, tasks: list[str] = TASKS) -> DataFrame:
    return scores.groupBy("agent_id").pivot("task", tasks).agg(F.first("score"))


def output_type(task: Column) -> Column:
    pairs = F.create_map(*(F.lit(x) for kv in OUTPUT_TYPES.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, task), F.lit("text"))


def generated_records(generated: DataFrame, text: str = "text") -> DataFrame:
    """A JSON list of examples per row -> records: no objects or blank user texts, an id from a hash of the content."""
    shape = "array<struct<system:string,user:string,ground_truth:string>>"
    one = generated.withColumn("x", F.explode(F.from_json(text, shape))).where("x IS NOT NULL").where(T.strip(F.coalesce("x.user", F.lit(""))) != "")
    content = F.concat_ws("\n", "agent_id", F.coalesce("x.system", F.lit("")), "x.user")
    messages = F.array(F.struct(F.lit("system").alias("role"), F.coalesce("x.system", F.lit("")).alias("content")), F.struct(F.lit("user").alias("role"), F.col("x.user").alias("content")))
    return one.select(
        F.concat(F.lit("synth_"), F.substring(F.sha2(content, 256), 1, 12)).alias("test_id"), "agent_id", messages.alias("messages"), F.col("x.ground_truth").alias("ground_truth"),
        output_type(F.col("task")).alias("expected_output_type"), F.lit(None).cast("string").alias("output"),
        F.struct(F.lit(True).alias("synthetic"), F.col("task").alias("source_task"), (F.col("edge_case") if "edge_case" in generated.columns else F.lit(False)).alias("edge_case")).alias("metadata"),
    )


def validation_gate(records: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Keep rows scored at least the threshold, and rows whose scorer failed (null)."""
    return records.where(F.coalesce(F.col("score") >= threshold, F.lit(True)))


def edge_quota(n: int) -> int:
    return max(2, n // 2)


def generation_requests(tasks: DataFrame, seeds: DataFrame, n: int) -> DataFrame:
    """tasks(task), seeds(task, test_id) -> task, n, edge_case, seed_ids: what to ask for, ``n`` examples a task and, where a task
    has seeds, its quota of edge cases on top, with five seeds at most."""
    own = first_k(seeds.select("task", "test_id").distinct(), ["task"], ["test_id"], 5).groupBy("task").agg(F.array_sort(F.collect_list("test_id")).alias("seed_ids"))
    none = F.array().cast("array<string>")
    base = tasks.select("task").distinct().select("task", F.lit(n).alias("n"), F.lit(False).alias("edge_case"), none.alias("seed_ids"))
    return base.unionByName(base.select("task").join(own, "task").select("task", F.lit(edge_quota(n)).alias("n"), F.lit(True).alias("edge_case"), "seed_ids"))


def with_tasks(records: DataFrame, tasks: DataFrame, default: str = TASKS[0]) -> DataFrame:
    """Every record with its agent's ``task``; agents without one, and records without agent, have the default."""
    agent = F.coalesce("agent_id", F.lit("unknown"))
    named = tasks.select(F.coalesce("agent_id", F.lit("unknown")).alias("__agent"), F.col("task").alias("__task")).dropDuplicates(["__agent"])
    return records.withColumn("__agent", agent).join(named, "__agent", "left").withColumn("task", F.coalesce("__task", F.lit(default))).drop("__agent", "__task")


def agents_by_task(profile: DataFrame, tasks: DataFrame) -> DataFrame:
    """Per task: records, agents, the largest agent."""
    return profile.join(tasks, "agent_id").groupBy("task").agg(F.sum("n_records").alias("n_records"), F.count("*").alias("n_agents"), F.max("n_records").alias("largest"))
