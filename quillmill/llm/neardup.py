"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprint: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, shingles of three words (repeats count), XXH64 of each
(UTF-8, seed 42); a bit is 1 if set in over half of the hashes. Fewer words: the whole sequence is the one shingle; no
word: fingerprint zero, linked like any other.

Links (``radius`` or fewer differing bits) are found exactly. Equal fingerprints are one node. The 64 bits are dealt
to partitions so that correlated bits share one. If x and y differ in at most r bits, then for thresholds t_1..t_m of -1
or more with sum r - m + 1 some partition i has them differ in at most t_i bits. Each fingerprint gets thresholds of
its own, those of the least estimated cost, by dynamic programming over the partitions: a partition in which it lies
in a crowd gets a low threshold or is skipped. It probes the values within t_i of its own, meets there those that
have the value, and what meets is verified. Inside a group of any size only a spanning forest of its links is kept,
which has the same connected components.

Defined cases: null text is the empty text; a null id takes part and gets the component's smallest non-null id; repeated
rows each get their result; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.common import columns_of, handing_back, numbered, small_batches, table, without, written
from quillmill.llm.groups import BLOCK, Forest, block_pairs, components, runs

RADIUS, SHINGLE, SEED = 3, 3, 42
#: Estimated cost of shuffling one row and of verifying one pair, in the same unit.
ROW_COST, PAIR_COST = 1.0, 0.005
#: Bits of a slice of a partition whose values are counted for the estimates.
SLICE = 11
#: Rows to drop up to this many are broadcast; more are joined by shuffling both sides.
BROADCAST_IDS = 1_000_000
_PIECE = 16_384


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    k = min(shingle, len(words))
    joined, ends = b" ".join(words), list(itertools.accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0, *(e + 1 for e in ends[: len(words) - k])]
    ends, digest = ends[k - 1 :], xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(starts), _PIECE):
        part = [digest(joined[a:b], SEED) for a, b in zip(starts[lo : lo + _PIECE], ends[lo : lo + _PIECE], strict=True)]
        bits = np.unpackbits(np.array(part, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """-> id, fp (the 64 bits as a signed long)."""
    given = docs.select(F.col(key).alias("id"), F.col(text).alias("t"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py()) for t in batch.column("t")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return small_batches(given).mapInArrow(handing_back(work), f"id {given.schema['id'].dataType.simpleString()}, fp long")


def _bits(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def correlations(fps: DataFrame) -> np.ndarray:
    """The 64 x 64 correlation matrix of the bits, over all rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((65, 65))
        for batch in batches:
            for lo in range(0, batch.num_rows, 65_536):
                x = _bits(batch.column("fp").to_numpy()[lo : lo + 65_536].copy()).astype(np.float32)
                x = np.hstack([x, np.ones((len(x), 1), np.float32)])
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(65 * 65)), pa.array(total.ravel().astype(np.int64))], names=["at", "n"])

    rows = fps.select("fp").mapInArrow(work, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(65 * 65)
    for r in rows:
        total[r["at"]] = r["n"]
    total = total.reshape(65, 65)
    n, mean = max(total[64, 64], 1), total[64, :64] / max(total[64, 64], 1)
    cov = total[:64, :64] / n - np.outer(mean, mean)
    sd = np.sqrt(np.clip(np.diag(cov), 1e-12, None))
    return cov / np.outer(sd, sd)


def partition_bits(corr: np.ndarray, m: int) -> list[list[int]]:
    """Deal the bits to m partitions: start from the most correlated bit left, add the bits most correlated with it."""
    strength, left, out = np.abs(corr) - np.eye(64), set(range(64)), []
    for i in range(m):
        rest = sorted(left)
        own = [rest[int(np.argmax(strength[np.ix_(rest, rest)].sum(axis=1)))]]
        left.discard(own[0])
        while len(own) < 64 * (i + 1) // m - 64 * i // m:
            rest = sorted(left)
            own.append(rest[int(np.argmax(strength[np.ix_(rest, own)].sum(axis=1)))])
            left.discard(own[-1])
        out.append(own)
    return out


def choose_m(n: int, radius: int) -> int:
    """How many partitions cost least for n fingerprints spread evenly; any number gives the same links."""

    def cost(m: int) -> float:
        u = [(radius + 1) // m + (i < (radius + 1) % m) for i in range(m)]
        balls = [sum(_choose(64 // m, d) for d in range(x)) for x in u]
        return ROW_COST * (m + sum(balls)) + PAIR_COST * sum(b * n / 2 ** (64 // m) for b in balls)

    return min(range(2, 7), key=cost)


def _choose(n: int, k: int) -> int:
    out = 1
    for i in range(k):
        out = out * (n - i) // (i + 1)
    return out


def _masks(width: int, radius: int) -> np.ndarray:
    """All masks of up to ``radius`` bits, fewer bits first."""
    return np.array([sum(1 << b for b in c) for d in range(radius + 1) for c in itertools.combinations(range(width), d)], np.uint64)


def take_bits(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fp), np.uint64)
    for i, b in enumerate(bits):
        out |= (fp >> np.uint64(b) & np.uint64(1)) << np.uint64(i)
    return out


class Plan:
    """Partitions, counts of slice values, and the allocation of thresholds."""

    def __init__(self, parts: list[list[int]], radius: int, n: int, counts: dict[tuple[int, int, int], int]) -> None:
        self.parts, self.radius, self.n = parts, radius, n
        self.slices = [[p[lo : lo + SLICE] for lo in range(0, len(p), SLICE)] for p in parts]
        self.near = []  # per partition and slice: share of all rows at distance d of each value
        for i, slices in enumerate(self.slices):
            own = []
            for j, bits in enumerate(slices):
                size = 1 << len(bits)
                share = np.array([counts.get((i, j, v), 0) for v in range(size)]) / max(n, 1)
                values, by = np.arange(size), []
                for d in range(radius + 1):
                    flips = [sum(1 << b for b in c) for c in itertools.combinations(range(len(bits)), d)]
                    by.append(sum((share[values ^ f] for f in flips), np.zeros(size)))
                own.append(np.stack(by, axis=1))
            self.near.append(own)

    def thresholds(self, fp: np.ndarray) -> np.ndarray:
        """For each fingerprint and partition the threshold plus one (0: skipped), of least estimated cost."""
        r = self.radius
        best, took = np.full((len(fp), r + 2), np.inf), []
        best[:, 0] = 0
        for part, slices, near in zip(self.parts, self.slices, self.near, strict=True):
            at = np.zeros((len(fp), r + 1))
            at[:, 0] = 1
            for bits, table_ in zip(slices, near, strict=True):
                d = table_[take_bits(fp, bits).astype(np.int64)]
                at = np.stack([sum(at[:, k] * d[:, e - k] for k in range(e + 1)) for e in range(r + 1)], axis=1)
            within = np.cumsum(at, axis=1) * self.n
            cost = np.zeros((len(fp), r + 2))
            for u in range(1, r + 2):
                cost[:, u] = ROW_COST * sum(_choose(len(part), d) for d in range(u)) + PAIR_COST * within[:, u - 1]
            both = np.stack([np.stack([best[:, s - u] + cost[:, u] if u <= s else np.full(len(fp), np.inf) for u in range(r + 2)]) for s in range(r + 2)])
            took.append(both.argmin(axis=1))  # [sum, row]
            best = both.min(axis=1).T
        out, left = np.zeros((len(fp), len(self.parts)), np.int64), np.full(len(fp), r + 1)
        for i in range(len(self.parts) - 1, -1, -1):
            out[:, i] = took[i][left, np.arange(len(fp))]
            left = left - out[:, i]
        return out


def make_plan(fps: DataFrame, n: int, radius: int, m: int | None = None) -> Plan:
    parts = partition_bits(correlations(fps), m or choose_m(n, radius))
    slices = [(i, j, p[lo : lo + SLICE]) for i, p in enumerate(parts) for j, lo in enumerate(range(0, len(p), SLICE))]

    def value(bits: list[int]):
        out = F.lit(0).cast("long")
        for k, b in enumerate(bits):
            out = out + F.shiftleft(F.shiftrightunsigned("fp", b).bitwiseAND(1), k)
        return out

    each = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), value(bits).alias("v")) for i, j, bits in slices)))
    rows = fps.select(each.alias("x")).groupBy("x.i", "x.j", "x.v").count().collect()  # 2^SLICE a slice at most
    return Plan(parts, radius, n, {(r[0], r[1], r[2]): r[3] for r in rows})


def _meetings(fps: DataFrame, plan: Plan) -> DataFrame:
    """fps(fp) -> key, fp, probe: under each key those that have its value (false) and those that look for it (true)."""
    masks = [[_masks(len(p), u) for u in range(plan.radius + 1)] for p in plan.parts]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                fp = whole.column("fp").to_numpy()[lo : lo + 4096].view(np.uint64)
                u = plan.thresholds(fp)
                for i, part in enumerate(plan.parts):
                    own = take_bits(fp, part) | np.uint64(i << 40)
                    keys, rows, probe = [own], [fp], [np.zeros(len(fp), bool)]
                    for t in range(1, plan.radius + 2):
                        at = np.flatnonzero(u[:, i] == t)
                        if len(at):
                            ball = masks[i][t - 1]
                            keys.append((own[at][:, None] ^ ball[None, :]).ravel())
                            rows.append(np.repeat(fp[at], len(ball)))
                            probe.append(np.ones(len(at) * len(ball), bool))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(rows).view(np.int64)), pa.array(np.concatenate(probe))],
                        names=["key", "fp", "probe"],
                    )

    return fps.mapInArrow(work, "key long, fp long, probe boolean")


def _tree(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among all of ``fp``, breadth first."""
    fp = np.unique(fp)
    fresh, a, b = np.ones(len(fp), bool), [], []
    for start in range(len(fp)):
        queue = [start] if fresh[start] else []
        fresh[start] = False
        while queue:
            x = queue.pop()
            rest = np.flatnonzero(fresh)
            found = rest[np.bitwise_count(fp[rest] ^ fp[x]) <= radius]
            fresh[found] = False
            queue.extend(found.tolist())
            a.append(np.full(len(found), fp[x]))
            b.append(fp[found])
    none = np.empty(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _pairs(fp: np.ndarray, probe: np.ndarray, starts: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between probes and index rows of the same group, thinned to a spanning forest."""
    ends = np.append(starts[1:], len(fp))
    group = np.repeat(np.arange(len(starts)), ends - starts)
    n_index = np.bincount(group[~probe], minlength=len(starts))
    index = np.flatnonzero(~probe)
    first = np.cumsum(n_index) - n_index
    probes = np.flatnonzero(probe)
    times = n_index[group[probes]]
    left = np.repeat(fp[probes], times)
    within = np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times)
    right = fp[index[np.repeat(first[group[probes]], times) + within]]
    ok = (np.bitwise_count(left ^ right) <= radius) & (left != right)
    left, right = left[ok], right[ok]
    nodes, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    forest, half = Forest(len(nodes)), len(left)
    keep = [i for i, (x, y) in enumerate(zip(at[:half].tolist(), at[half:].tolist(), strict=True)) if forest.join(x, y)]
    return left[keep], right[keep]


def links(fps: DataFrame, radius: int = RADIUS, m: int | None = None) -> DataFrame:
    """fps(fp), all different -> a, b: links that have the same connected components as all links of the radius."""
    n = fps.count()
    met = _meetings(fps, make_plan(fps, n, radius, m))
    dense = 10_000

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(key, a, b):
            return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["key", "a", "b"])

        for t, starts, piece in runs(batches, ["key"], BLOCK):
            fp, probe = t.column("fp").to_numpy().view(np.uint64), t.column("probe").to_numpy()
            if piece:  # a large group goes on, to be met in blocks
                yield out(t.column("key").to_numpy(), fp, fp)
                continue
            sizes = np.diff(np.append(starts, len(t)))
            probes = np.add.reduceat(probe.astype(np.int64), starts)
            work_ = probes * (sizes - probes)
            small = (work_ > 0) & (work_ <= dense)
            rows = np.repeat(small, sizes)
            if rows.any():
                a, b = _pairs(fp[rows], probe[rows], (np.cumsum(sizes[small]) - sizes[small]), radius)
                yield out(np.full(len(a), -1), a, b)
            for g in np.flatnonzero(work_ > dense):
                a, b = _tree(fp[starts[g] : starts[g] + sizes[g]], radius)
                yield out(np.full(len(a), -1), a, b)

    first = written(met.repartition("key").sortWithinPartitions("key").mapInArrow(work, "key long, a long, b long"), "links")
    large = first.where("key >= 0").select("key", F.col("a").alias("fp"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts, _ in runs(batches, ["key", "b1", "b2"]):
            fp = t.column("fp").to_numpy().view(np.uint64)
            for lo, hi in zip(starts, np.append(starts[1:], len(t)), strict=True):
                a, b = _tree(fp[lo:hi], radius)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    dealt = block_pairs(large, "key", F.xxhash64("fp")).repartition("key", "b1", "b2").sortWithinPartitions("key", "b1", "b2")
    return first.where("key < 0").select("a", "b").unionByName(dealt.select("key", "b1", "b2", "fp").mapInArrow(blocks, "a long, b long"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """-> key, fingerprint (16 hexadecimal digits), component_id (the smallest key that links reach)."""
    own = written(fingerprints(docs, key, text), "fingerprints")
    nodes = written(own.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    comps = components(links(nodes.select("fp"), radius))
    rep = nodes.join(comps.hint("shuffle_merge"), F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("comp")
    )
    rep = written(rep, "node-components")
    least = written(rep.groupBy("comp").agg(F.min("least").alias("component_id")), "component-ids")
    by_fp = rep.select("fp", "comp").join(least.hint("shuffle_merge"), "comp").select("fp", "component_id")
    return own.join(by_fp.hint("shuffle_merge"), "fp").select(
        F.col("id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """``docs`` without all but one row of each component: the smallest key (null last), then text hash, then row."""
    rows = numbered(docs)
    place = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.xxhash64(text).alias("text"), F.col("__rid").alias("rid"))
    found = near_duplicates(rows.withColumn("__place", place), "__place", text, radius)
    gone = found.where("__place.rid <> component_id.rid").select(F.col("__place.rid").alias("__rid"))
    return columns_of(without(rows, written(gone, "near-copies"), BROADCAST_IDS), docs)


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
