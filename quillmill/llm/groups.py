"""Grouping in bounded memory: streams of sorted keys, hot keys in blocks, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import written

#: Rows of one key that a task holds together; larger keys are cut into blocks, and each pair of blocks is a group.
BLOCK = 4096


def runs(batches: Iterator[pa.RecordBatch], keys: list[str], limit: int | None = None) -> Iterator[tuple[pa.Table, np.ndarray, bool]]:
    """Cut a stream that is sorted by ``keys`` into tables of whole groups.

    Yields (table, starts of its groups, False). A group of more than ``limit`` rows comes in pieces instead, each
    as (table, [0], True), so that no more than about ``limit`` rows and one batch are held.
    """
    held: pa.Table | None = None
    over = None  # the key of a group that is passing in pieces

    def cut(t: pa.Table) -> np.ndarray:
        change = np.zeros(len(t), bool)
        change[0] = True
        for k in keys:
            c = t.column(k).to_numpy()
            change[1:] |= c[1:] != c[:-1]
        return np.flatnonzero(change)

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        if over is not None:
            key = [t.column(k)[0].as_py() for k in keys]
            if key == over:
                starts = cut(t)
                n = int(starts[1]) if len(starts) > 1 else len(t)
                yield t.slice(0, n), np.array([0]), True
                t = t.slice(n)
                if not len(t):
                    continue
            over = None
        if held is not None:
            t = pa.concat_tables([held, t])
        starts = cut(t)
        last = int(starts[-1])
        big = np.flatnonzero(np.diff(np.append(starts, len(t))) > limit) if limit else []
        at = 0
        for g in big:
            lo, hi = int(starts[g]), int(starts[g + 1]) if g + 1 < len(starts) else len(t)
            if lo > at:
                yield t.slice(at, lo - at), starts[(starts >= at) & (starts < lo)] - at, False
            yield t.slice(lo, hi - lo), np.array([0]), True
            at = hi
            if hi == len(t):
                over = [t.column(k)[lo].as_py() for k in keys]
        if over is not None:
            held = None
            continue
        if last > at:
            yield t.slice(at, last - at), starts[(starts >= at) & (starts < last)] - at, False
        held = t.slice(last).combine_chunks()
    if held is not None:
        yield held, np.array([0]), False


class Forest:
    """Union-find over positions 0..n-1."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def block_pairs(rows: DataFrame, key: str, spread: Column, block: int = BLOCK) -> DataFrame:
    """Rows of large groups, copied so that any two rows of one ``key`` meet in some group (key, b1, b2).

    A key of n rows gets about n / ``block`` blocks; a row goes into its block's pairings with every block, b1 <= b2.
    """
    sizes = rows.groupBy(key).agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("n_"))
    dealt = rows.join(sizes.hint("shuffle_merge"), key).withColumn("own_", F.pmod(spread, F.col("n_")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("n_") - 1))
    return (
        dealt.withColumn("other_", other)
        .withColumn("b1", F.least("own_", "other_"))
        .withColumn("b2", F.greatest("own_", "other_"))
        .drop("n_", "own_", "other_")
    )


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph of long ids -> (node, component), component the smallest id.

    Alternates large-star and small-star steps, each a shuffle by node, until nothing changes; every state is written
    to the shared folder, so a lost executor costs no more than one step. Self-loops and nulls are ignored.
    """
    pair = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where(F.col("u") != F.col("v"))
    state = written(pair.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least.hint("shuffle_merge"), F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        small = large.join(least.hint("shuffle_merge"), F.col("u") == F.col("w"))
        state = written(
            small.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct(),
            "edges",
        )
        now = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
