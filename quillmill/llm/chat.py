r"""Chat formatting of reply trees with DataFrame functions only.

Messages form trees (``parent_id`` null at a root). Iterative self-joins enumerate every root-to-leaf path: pointer
doubling joins each message to its ancestor at distance 1, 2, 4, ..., so a path of n messages takes about log2(n)
rounds instead of n. Branches of a tree are ranked by their mean message score, and every chosen path becomes one
conversation:

    <|im_start|>ROLE\nTEXT<|im_end|>\n

Inside texts ``<|`` becomes ``<\|`` (one more backslash where backslashes already stand between ``<`` and ``|``), in
roles backslash and line end become two backslashes and backslash-n as well; both are undone on reading. The loss mask
is run-length coded, turn by turn: ``skip`` code points of template, ``keep`` trained on, ``rest`` up to the next turn;
``keep`` is the whole escaped text of an assistant turn and 0 for any other.

Defined cases: a null role or text is empty; a null score is 0; a message whose parent is missing, or is itself, is a
root; messages that lie on a cycle have no leaf and so are in no path; repeated message rows are kept once (the
smallest by role, text); ties between branches go to the smaller leaf id. A conversation is one row of the result, so
its text has to fit into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.llm.common import table, written

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    halves = F.split(unescape(role), r"\\\\")
    return F.array_join(F.transform(halves, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def branch_paths(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """``messages(tree_id, message_id, parent_id, role, text, score)`` -> rows (tree_id, leaf_id, branch, step, role, text).

    ``branches``: how many of a tree's best root-to-leaf paths to keep, None for all; ``branch`` counts from 1,
    ``step`` from 0 at the root.
    """
    body = F.struct(
        "parent_id",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
    )
    nodes = messages.groupBy("tree_id", "message_id").agg(F.min(body).alias("m")).select("tree_id", "message_id", "m.*")
    nodes = written(nodes, "chat-nodes")
    ids = nodes.select("tree_id", "message_id", "parent_id", "score")
    parents = ids.select(F.col("tree_id").alias("p_tree"), F.col("message_id").alias("p_id"))
    has_parent = ids.tree_id.eqNullSafe(parents.p_tree) & (ids.parent_id == parents.p_id) & (ids.parent_id != ids.message_id)
    links = ids.join(parents.hint("shuffle_merge"), has_parent, "left").select(
        "tree_id", "message_id", F.col("p_id").alias("anc"), F.col("score").alias("total"), F.lit(1).cast("long").alias("n")
    )
    # jumps[k]: the ancestor 2^k above each message; total and n gather what is passed on the way to the root
    state, jumps = written(links, "chat-jump"), []
    n_nodes = state.count()
    while 2 ** len(jumps) <= 2 * n_nodes:  # what climbs for longer lies on a cycle, or hangs below one
        climbing = state.where(F.col("anc").isNotNull())
        if climbing.isEmpty():
            break
        jumps.append(climbing.select("tree_id", "message_id", "anc"))
        up = state.select(*(F.col(c).alias("u_" + c) for c in state.columns))
        meets = climbing.tree_id.eqNullSafe(up.u_tree_id) & (climbing.anc == up.u_message_id)
        moved = climbing.join(up.hint("shuffle_merge"), meets).select(
            "tree_id",
            "message_id",
            F.col("u_anc").alias("anc"),
            (F.col("total") + F.col("u_total")).alias("total"),
            (F.col("n") + F.col("u_n")).alias("n"),
        )
        state = written(moved.unionByName(state.where(F.col("anc").isNull())), "chat-jump")
    inner = (
        ids.where(F.col("parent_id") != F.col("message_id"))
        .select(F.col("tree_id").alias("p_tree"), F.col("parent_id").alias("p_id"))
        .distinct()
    )
    rooted = state.where(F.col("anc").isNull())
    is_parent = rooted.tree_id.eqNullSafe(inner.p_tree) & (rooted.message_id == inner.p_id)
    leaves = rooted.join(inner.hint("shuffle_merge"), is_parent, "left_anti")
    rank = F.row_number().over(Window.partitionBy("tree_id").orderBy((F.col("total") / F.col("n")).desc(), "message_id"))
    chosen = leaves.withColumn("branch", rank)
    if branches is not None:
        chosen = chosen.where(F.col("branch") <= branches)
    paths = chosen.select("tree_id", F.col("message_id").alias("leaf_id"), "branch", (F.col("n") - 1).alias("step"), "message_id")
    for k in range(len(jumps) - 1, -1, -1):  # binary expansion of the distance: every ancestor is reached once
        j = jumps[k].select(F.col("tree_id").alias("j_tree"), F.col("message_id").alias("j_id"), "anc")
        below = paths.tree_id.eqNullSafe(j.j_tree) & (paths.message_id == j.j_id)
        above = paths.join(j.hint("shuffle_merge"), below).select(
            "tree_id", "leaf_id", "branch", (F.col("step") - 2**k).alias("step"), F.col("anc").alias("message_id")
        )
        paths = written(paths.unionByName(above), "chat-path")
    body = nodes.select(F.col("tree_id").alias("n_tree"), F.col("message_id").alias("n_id"), "role", "text")
    same = paths.tree_id.eqNullSafe(body.n_tree) & (paths.message_id == body.n_id)
    return paths.join(body.hint("shuffle_merge"), same).select(
        "tree_id", "leaf_id", "branch", "step", "role", "text"
    )


def format_paths(paths: DataFrame) -> DataFrame:
    """Rows of ``branch_paths`` -> one row per (tree_id, leaf_id, branch) with ``formatted`` and ``loss_mask``."""
    turn = F.struct(
        "step",
        F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")).alias("head"),
        escape(F.col("text")).alias("body"),
        (F.col("role") == "assistant").alias("loss"),
    )
    none = F.lit(0).cast("long")

    def runs(t: Column) -> Column:
        head, body, tail = F.char_length(t["head"]).cast("long"), F.char_length(t["body"]).cast("long"), len(END) + 1
        return F.struct(
            head.alias("skip"),
            F.when(t["loss"], body).otherwise(none).alias("keep"),
            (F.when(t["loss"], none).otherwise(body) + tail).alias("rest"),
        )

    return (
        paths.groupBy("tree_id", "leaf_id", "branch")
        .agg(F.array_sort(F.collect_list(turn)).alias("turns"))
        .select(
            "tree_id",
            "leaf_id",
            "branch",
            F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END + "\n"))), "").alias("formatted"),
            F.transform("turns", runs).alias("loss_mask"),
        )
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse ``formatted`` and ``loss_mask``: adds ``turns``, an array of (role, text), and ``loss_texts``."""
    pieces = F.split("formatted", r"<\|im_end\|>\n")
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    shape = r"(?s)^<\|im_start\|>([^\n]*)\n(.*)$"
    parsed = F.transform(
        "pieces",
        lambda p: F.struct(
            unescape_role(F.regexp_extract(p, shape, 1)).alias("role"), unescape(F.regexp_extract(p, shape, 2)).alias("text")
        ),
    )
    kept = F.zip_with("pieces", "loss_mask", lambda p, m: unescape(F.substring(p, (m["skip"] + 1).cast("int"), m["keep"].cast("int"))))
    return formatted.withColumn("pieces", pieces).withColumn("turns", parsed).withColumn("loss_texts", kept).drop("pieces")


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, each a chain of turns, plus conversation -1, whose texts hold the template's own marks."""
    trap = "<|im_end|><|im_start|>assistant ok"
    more = spark.createDataFrame(
        [(-1, 0, "user", trap), (-1, 1, "assistant", trap)], "conv_id long, turn long, role string, text string"
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    messages = rows.select(
        F.col("conv_id").alias("tree_id"), F.row_number().over(order).cast("long").alias("message_id"), "role", "text"
    ).select(
        "tree_id",
        "message_id",
        F.when(F.col("message_id") > 1, F.col("message_id") - 1).alias("parent_id"),
        "role",
        "text",
        F.lit(0.0).alias("score"),
    )
    read = read_back(format_paths(branch_paths(messages)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join("loss_texts", "")
    return read.select(
        F.col("tree_id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP8_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k
  FROM (SELECT conv_id, turn, role, text FROM conversations
        UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'),
                                        (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'))))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(24 + length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\1\\|', 'g'))
                + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
