"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut into two halves, and each half is quantised on its own to one of ``CENTROIDS`` centroids, so that the
pairs of centroids form a grid of cells. For a query the half distances (negative inner products with the centroids)
are sorted, and a heap walks the grid in the order of summed distance until the cells met hold ``CANDIDATES``
different vectors. Each query is sent to its cells, whose vectors are ranked by their exact inner product in double
precision, and a query's partial lists are merged.

The centroids come from a bounded sample (``SAMPLE`` vectors, chosen by a hash of the id); every vector is indexed. A
cell of more than ``BLOCK`` vectors is cut into blocks, each with its own task input, and the query goes to all of
them, so a crowded cell, as copies of one vector make it, costs no recall and fits into memory.

Defined cases: vectors that are null, empty, zero, of another length than most, or hold null or non-finite components
take no part, neither as queries nor as candidates; nor does a null id; a query's own rows (those of its id) are never
candidates; ties go to the smaller id; repeated rows of one id and vector count once; with fewer candidates than asked
for, all are given; a product beyond the doubles is infinite, and the last of all where it has both signs; other columns are
ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.llm.common import hash01, table, written
from quillmill.llm.groups import runs

#: Centroids of a half. A query sends partial results from each of its cells, at most CENTROIDS squared of them, so
#: cells grow with the data rather than in number; data with more structure is worth more centroids and a lower SHARE.
CENTROIDS, SAMPLE, ROUNDS, SEED = 8, 8192, 12, 7
#: Different vectors that a query's cells have to hold before the walk ends: at least so many, and a share of all.
CANDIDATES, SHARE = 200, 0.75
BLOCK = 4096
TOP = 20


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Lloyd's rounds from k different sampled points; a centroid left alone moves to a sampled point."""
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    size = np.abs(x).max() or 1.0  # products of huge values would leave the doubles
    x, k = x / size, min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = (x @ c.T - 0.5 * (c**2).sum(axis=1)).argmax(axis=1)
        total, n = np.zeros_like(c), np.bincount(near, minlength=k)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)])
    return c * size


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    size = max(np.abs(x).max(initial=0.0), np.abs(c).max()) or 1.0
    x, c = x / size, c / size
    return (x @ c.T - 0.5 * (c**2).sum(axis=1)).argmax(axis=1)


def walk(d1: np.ndarray, d2: np.ndarray, counts: np.ndarray, wanted: int) -> list[int]:
    """Cells (first * K + second) by summed distance, until they hold ``wanted`` vectors; empty ones are left out."""
    o1, o2 = np.argsort(d1, kind="stable").tolist(), np.argsort(d2, kind="stable").tolist()
    s1, s2 = d1[o1].tolist(), d2[o2].tolist()
    heap, out, held, seen = [(s1[0] + s2[0], 0, 0)], [], 0, {(0, 0)}
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        cell = o1[i] * len(d2) + o2[j]
        if counts[cell]:
            out.append(cell)
            held += int(counts[cell])
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(s1) and b < len(s2) and (a, b) not in seen:
                seen.add((a, b))
                heapq.heappush(heap, (s1[a] + s2[b], a, b))
    return out


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """-> id, v (array<double>), of the commonest length, once per id and vector."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(key).alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(fine)
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("v") == (sizes[0][0] if sizes else 0)).dropDuplicates(["id", "v"])


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _products(rows: np.ndarray, v: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        out = (rows * v).sum(axis=1)
    return np.where(np.isnan(out), -np.inf, out)


def search(vectors: DataFrame, is_query, top: int = TOP, key: str = "vec_id", vector: str = "embedding", candidates: int = CANDIDATES, share: float = SHARE, centroids: int = CENTROIDS) -> DataFrame:
    """Rows where ``is_query`` (a Column over ``id``) holds, against all rows -> query_id, rank, key, score."""
    rows = written(usable(vectors, key, vector), "vectors")
    n = rows.count()
    out = f"q long, id {rows.schema['id'].dataType.simpleString()}, score double"
    shape = f"query_id {rows.schema['id'].dataType.simpleString()}, rank int, {key} {rows.schema['id'].dataType.simpleString()}, score double"
    if not n:
        return vectors.sparkSession.createDataFrame([], shape)
    sample = np.array([r["v"] for r in rows.where(hash01("id") < min(1.0, SAMPLE / n)).select("v").collect()] or [rows.first()["v"]])
    half = sample.shape[1] // 2
    c1, c2 = kmeans(sample[:, :half], centroids), kmeans(sample[:, half:], centroids)
    k1, k2 = len(c1), len(c2)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column("v"))
            cell = nearest(v[:, :half], c1) * k2 + nearest(v[:, half:], c2)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), batch.column("id"), batch.column("v")], names=["cell", "id", "v"])

    index = written(rows.mapInArrow(place, f"cell long, id {rows.schema['id'].dataType.simpleString()}, v array<double>"), "multi-index")
    counted = index.groupBy("cell", F.xxhash64("v").alias("h")).agg(F.count("*").alias("n"))
    sizes = counted.groupBy("cell").agg(F.count("*").alias("different"), F.sum("n").alias("n")).collect()  # K1 * K2 rows at most
    counts, blocks = np.zeros(k1 * k2, np.int64), np.ones(k1 * k2, np.int64)
    for r in sizes:
        counts[r["cell"]], blocks[r["cell"]] = r["different"], -(-r["n"] // BLOCK)
    wanted = max(candidates, int(share * counts.sum()))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column("v"))
            with np.errstate(over="ignore", invalid="ignore"):
                d1, d2 = -v[:, :half] @ c1.T, -v[:, half:] @ c2.T
            at, cells, block = [], [], []
            for i in range(len(v)):
                for c in walk(d1[i], d2[i], counts, wanted):
                    for b in range(int(blocks[c])):
                        at.append(i)
                        cells.append(c)
                        block.append(b)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(block, pa.int64()), batch.column("q").take(take), batch.column("id").take(take)], names=["cell", "block", "q", "id"])

    kind = rows.schema["id"].dataType.simpleString()
    queries = written(index.where(is_query).select(F.monotonically_increasing_id().alias("q"), "id", "v"), "queries")
    probes = queries.mapInArrow(probe, f"cell long, block long, q long, id {kind}")
    # a cell's block meets its queries' vectors: entries first, then queries, in chunks
    per_cell = F.element_at(F.array(*(F.lit(int(b)) for b in blocks)), (F.col("cell") + 1).cast("int"))
    entries = index.select("cell", F.pmod(F.xxhash64("id"), per_cell.cast("long")).alias("block"), F.lit(-1).cast("long").alias("q"), "id", "v")
    asked = probes.join(queries.select("q", "v").hint("shuffle_hash"), "q").select("cell", "block", "q", "id", "v")
    met = entries.unionByName(asked).repartition("cell", "block").sortWithinPartitions("cell", "block", "q")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, ids, matrix = None, None, None
        for t, starts, _ in runs(batches, ["cell", "block"], 2 * BLOCK):
            cells, blk, q = (t.column(c).to_numpy() for c in ("cell", "block", "q"))
            for lo, hi in zip(starts, np.append(starts[1:], len(t)), strict=True):
                own = (int(cells[lo]), int(blk[lo]))
                part, is_entry = t.slice(lo, hi - lo), q[lo:hi] < 0
                n_entry = int(is_entry.sum())
                if own != held_key:
                    held_key, ids, matrix = own, None, None
                if n_entry:
                    more_ids, more = part.column("id").slice(0, n_entry).to_numpy(), _matrix(part.column("v").slice(0, n_entry))
                    ids, matrix = (more_ids, more) if ids is None else (np.concatenate([ids, more_ids]), np.concatenate([matrix, more]))
                if ids is None or n_entry == hi - lo:
                    continue
                order = np.argsort(ids, kind="stable")
                ids, matrix = ids[order], matrix[order]
                for at in range(lo + n_entry, hi, 256):
                    end = min(at + 256, hi)
                    asked_ids = t.column("id").slice(at, end - at).to_numpy()
                    asked_v = _matrix(t.column("v").slice(at, end - at))
                    with np.errstate(over="ignore", invalid="ignore"):
                        rough = asked_v @ matrix.T
                    own = asked_ids[:, None] == ids[None, :]
                    rough[own | np.isnan(rough)] = -np.inf
                    k = min(top, len(ids))
                    least = np.partition(rough, len(ids) - k, axis=1)[:, len(ids) - k]
                    qs, found_ids, scores = [], [], []
                    for i in range(end - at):  # again, summed in one order for all, so that copies tie exactly
                        low = least[i] - 1e-9 * (1 + abs(least[i])) if np.isfinite(least[i]) else least[i]
                        near = np.flatnonzero((rough[i] >= low) & ~own[i])
                        score = _products(matrix[near], asked_v[i])
                        best = near[np.lexsort((ids[near], -score))[:top]]
                        qs.append(np.full(len(best), q[at + i]))
                        found_ids.append(ids[best])
                        scores.append(_products(matrix[best], asked_v[i]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (qs, found_ids, scores)], names=["q", "id", "score"])

    found = met.mapInArrow(rank, out).groupBy("q", "id").agg(F.max("score").alias("score"))
    place_ = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    best = found.withColumn("rank", place_).where(F.col("rank") <= top)
    a = queries.select("q", F.col("id").alias("query_id"))
    return best.join(a.hint("shuffle_hash"), "q").select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
