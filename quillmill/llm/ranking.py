r"""Ranked lexical search, reversed: the items' inverted index is broadcast, the documents stream through it.

Terms are ``[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+`` of the whole text with A-Z lower-cased. One pass over the documents
counts the terms of each and writes those that some item has, with the document's length. From that table come the number
and length of documents and the document frequencies, of the items' terms only. A second pass streams it through the
inverted index (term -> items): what a term adds to a document is computed once and goes to all items of the term, the
sums of a few documents at a time are compared with the least score in each item's heap, and what exceeds it is pushed. A
task holds ``K`` entries an item and leaves them at its end; the heaps of all tasks are merged by a shuffle on the item.

The index is broadcast in slices of about ``PAIRS`` (item, term) pairs, whatever the size of the benchmark; scores are sums
of 64-bit integers, carried exactly in doubles (a slice's items can't reach 2**53).

Defined cases: a text that is null or has no term is no document; each row is a document of its own, also where ids
repeat; rows of one item id, null included, make one item with the terms of all; an item without terms or without
document above 0 has no row; equal scores by ascending id, null last; other columns are ignored, so clashing names do no harm.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.llm.common import SLICE, small_batches, table, written
from quillmill.llm.decontaminate import words

#: Results an item.
K = 10
#: (item, term) pairs of a slice of the index, which every task holds; more only where a single item has more terms.
PAIRS = 200_000
#: Additions, and cells of the table documents x items, that a task makes at a time.
STEP = 2_000_000


def item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """-> i (the item's id), w: each item's terms once."""
    pair = items.select(F.col(key).alias("i"), F.col(text).alias("t"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(lo, SLICE) for whole in batches for lo in range(0, whole.num_rows, SLICE)):
            found = [sorted(set(words(t.as_py()))) for t in batch.column("t")]
            at = np.repeat(np.arange(len(found)), [len(w) for w in found])
            yield pa.RecordBatch.from_arrays([batch.column("i").take(pa.array(at)), pa.array([w for ws in found for w in ws], pa.binary())], names=["i", "w"])

    kind = pair.schema["i"].dataType.simpleString()
    return written(small_batches(pair).mapInArrow(work, f"i {kind}, w binary").distinct(), "item-terms")


def slices(terms: DataFrame, pairs: int = PAIRS) -> Iterator[DataFrame]:
    """Parts of ``item_terms``, an item whole in one of them, of about ``pairs`` rows at most."""
    bucket = F.pmod(F.xxhash64(F.col("i").cast("string")), F.lit(8 * (terms.count() // pairs + 1)))
    sizes = terms.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).orderBy("b").collect()  # some 8 for each slice
    part, held = [], 0
    for b, n in sizes:
        if part and held + n > pairs:
            yield terms.where(bucket.isin(part))
            part, held = [], 0
        part.append(b)
        held += n
    if part:
        yield terms.where(bucket.isin(part))


class Index:
    """Inverted index of one slice: the items of term t are ``items[first[t] : first[t + 1]]``."""

    def __init__(self, rows: list) -> None:
        self.ids = sorted({r["i"] for r in rows}, key=lambda i: (i is None, i))
        number = {i: k for k, i in enumerate(self.ids)}
        self.number = {w: k for k, w in enumerate(sorted({bytes(r["w"]) for r in rows}))}
        pairs = np.array(sorted((self.number[bytes(r["w"])], number[r["i"]]) for r in rows), np.int64).reshape(-1, 2)
        self.items = pairs[:, 1]
        self.first = np.searchsorted(pairs[:, 0], np.arange(len(self.number) + 1))


def term_counts(docs: DataFrame, number: dict[bytes, int], key: str, text: str) -> DataFrame:
    """-> id, n (its terms with repeats), term, tf: documents with terms, and how often each has those of ``number``."""
    pair = docs.select(F.col(key).alias("id"), F.col(text).alias("t"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(lo, SLICE) for whole in batches for lo in range(0, whole.num_rows, SLICE)):
            n, terms, tf, ends = [], [], [], [0]
            for t in batch.column("t"):
                w = words(t.as_py())
                counts = Counter(map(number.get, w))
                counts.pop(None, None)
                n.append(len(w))
                terms.extend(counts)
                tf.extend(counts.values())
                ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tf)]
            made = pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), *lists], names=["id", "n", "term", "tf"])
            yield made.filter(pa.array(np.array(n, np.int64) > 0))

    kind = pair.schema["id"].dataType.simpleString()
    return written(small_batches(pair).mapInArrow(work, f"id {kind}, n long, term array<int>, tf array<int>"), "term-counts")


class Heaps:
    """The ``k`` best documents of each item: highest score, then smallest id, null last."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.held = k, [[] for _ in range(n)]
        self.least = np.ones(n)  # a score below that of a full heap's worst entry, or of 0, can't get in

    def push(self, item: int, score: float, doc: int | None) -> None:
        heap, entry = self.held[item], (score, doc is not None, -(doc or 0))
        if len(heap) < self.k:
            heapq.heappush(heap, entry)
        else:
            heapq.heappushpop(heap, entry)
        if len(heap) == self.k:
            self.least[item] = max(heap[0][0], 1)

    def rows(self) -> list[tuple[int, int | None, int]]:
        return [(i, -d if known else None, int(s)) for i, heap in enumerate(self.held) for s, known, d in heap]


def steps(adds: np.ndarray, n_items: int, limit: int = STEP) -> Iterator[tuple[int, int]]:
    """Runs of documents with about ``limit`` additions and cells at most; ``adds``: additions of each document."""
    most, ends, lo = max(1, limit // n_items), np.cumsum(adds), 0
    while lo < len(adds):
        hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + limit, "right"))
        hi = min(max(hi, lo + 1), lo + most, len(adds))
        yield lo, hi
        lo = hi


def scored(counts: DataFrame, index: Index, weight: np.ndarray, n_docs: int, length: int, k: int = K) -> DataFrame:
    """-> item (its number), doc_id, score: the heap of every task for every item."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_items, size = len(index.ids), np.diff(index.first)
        heaps = Heaps(n_items, k)
        for batch in batches:
            term, tf = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("term", "tf"))
            each, ids = batch.column("term").value_lengths().to_numpy(), batch.column("id").to_pylist()
            m = 10 + 90 * batch.column("n").to_numpy() * n_docs // length
            gain = (weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, each)))).astype(float)
            ends = np.concatenate(([0], np.cumsum(each)))
            upto = np.concatenate(([0], np.cumsum(size[term])))
            for lo, hi in steps(np.diff(upto[ends]), n_items):
                a, b = ends[lo], ends[hi]
                copies = size[term[a:b]]
                starts = np.repeat(index.first[term[a:b]] - (upto[a:b] - upto[a]), copies)
                cell = np.repeat(np.repeat(np.arange(hi - lo), each[lo:hi]) * n_items, copies) + index.items[starts + np.arange(len(starts))]
                total = np.bincount(cell, np.repeat(gain[a:b], copies), (hi - lo) * n_items).reshape(hi - lo, n_items)
                for d, i in zip(*np.nonzero(total >= heaps.least), strict=True):
                    heaps.push(i, total[d, i], ids[lo + d])
        rows = heaps.rows()
        kinds = (("item", pa.int32()), ("doc_id", kind), ("score", pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, (_, t) in enumerate(kinds)], names=[c for c, _ in kinds])

    kind = pa.int32() if counts.schema["id"].dataType.simpleString() == "int" else pa.int64()
    return counts.mapInArrow(work, f"item int, doc_id {'int' if kind == pa.int32() else 'long'}, score long")


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", k: int = K, pairs: int = PAIRS) -> DataFrame:
    """-> item_id, rank, doc_id, score: the ``k`` best documents (integer ids) of each item, of all documents."""
    spark, terms, found = docs.sparkSession, item_terms(items, item, item_text), None
    for part in slices(terms, pairs):
        index = Index(part.collect())  # about `pairs` rows
        counts = term_counts(docs, index.number, key, text)
        n_docs, length = counts.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            continue
        df = np.zeros(len(index.number), np.int64)
        for t, n in counts.select(F.explode("term").alias("t")).groupBy("t").agg(F.count("*")).collect():  # terms of the slice
            df[t] = n
        weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
        place = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = scored(counts, index, weight, n_docs, length, k).withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(index.ids)), f"item int, item_id {terms.schema['i'].dataType.simpleString()}")
        got = best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        found = got if found is None else found.unionByName(got)
    return spark.createDataFrame([], f"item_id {terms.schema['i'].dataType.simpleString()}, rank int, doc_id long, score long") if found is None else found


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS w FROM documents),
docs AS (SELECT rid, doc_id, len(w) AS n FROM d WHERE len(w) > 0),
s AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS length FROM docs),
b AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark),
tf AS (SELECT rid, t, count(*) AS tf FROM (SELECT rid, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM b) GROUP BY rid, t),
wt AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY t, n_docs),
sc AS (SELECT item_id, doc_id, rid, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // length)))) AS BIGINT) AS score
       FROM b JOIN tf USING (t) JOIN wt USING (t) JOIN docs USING (rid), s GROUP BY ALL),
r AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM sc WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
