r"""Benchmark decontamination with a distributed positional inverted index.

Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the text with A-Z lower-cased. One pass over the documents counts the
benchmark's terms; each benchmark window (13 consecutive words of an item, or a shorter item whole) takes its rarest
term as anchor. A second pass stores postings (document, position, term), those of benchmark terms within a window's
reach of an anchor: no other posting can be part of a match. Postings of anchors, less the anchor's offset, give
alignments of an item with a document; intersecting these with the offset-adjusted postings of the item's other terms
leaves the offsets that agree, and runs of them at least a window long are exact phrase matches.

``proximity_matches`` uses the same index: places where rare terms of an item stand within a span of words.

A benchmark of any size is handled in slices of about ``SLICE_CHARS`` characters, so what each task gets is bounded.

Defined cases: null and wordless texts have no words and no hits; an item without words has no window; a repeated item
id counts once, a null one as the empty string; repeated documents each get their row; a null id stays null; other
columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.llm.common import SLICE, columns_of, handing_back, numbered, small_batches, table, without, written

WINDOW = 13
SLICE_CHARS = 8_000_000
#: Contaminated: at least this share of the words are hit.
SHARE = 20
#: Rows to drop up to this many are broadcast; more are joined by shuffling both sides.
BROADCAST_IDS = 1_000_000
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def _numbered(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("rid"), F.col(key).alias("id"), F.col(text).alias("t"))


def term_counts(docs: DataFrame, vocabulary: set[bytes], text: str = "text") -> dict[bytes, int]:
    """How often each term of a bounded vocabulary occurs in all documents."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()
        for batch in (whole.slice(lo, SLICE) for whole in batches for lo in range(0, whole.num_rows, SLICE)):
            seen = Counter(chain.from_iterable(words(t.as_py()) for t in batch.column("t")))
            for w in seen.keys() & vocabulary:
                total[w] += seen[w]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["w", "n"])

    rows = small_batches(docs.select(F.col(text).alias("t"))).mapInArrow(handing_back(work), "w binary, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["w"]): r["n"] for r in rows}


def build_index(docs: DataFrame, number: dict[bytes, int], anchors: set[bytes], reach: int) -> DataFrame:
    """docs(rid, id, t) -> rid, id, n_words, pos, term: each document with its postings near anchors."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(lo, SLICE) for whole in batches for lo in range(0, whole.num_rows, SLICE)):
            n, places, terms = [], [], []
            for t in batch.column("t"):
                w = words(t.as_py())
                n.append(len(w))
                near: list[int] = []
                if not anchors.isdisjoint(w):
                    done = 0
                    for at in [i for i, x in enumerate(w) if x in anchors]:
                        near.extend(i for i in range(max(done, at - reach), min(len(w), at + reach + 1)) if w[i] in number)
                        done = at + reach + 1
                places.append(near)
                terms.append([number[w[i]] for i in near])
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid"), batch.column("id"), pa.array(n, pa.int64()), pa.array(places, pa.list_(pa.int32())), pa.array(terms, pa.list_(pa.int32()))],
                names=["rid", "id", "n_words", "pos", "term"],
            )

    kind = docs.schema["id"].dataType.simpleString()
    return written(small_batches(docs).mapInArrow(handing_back(work), f"rid long, id {kind}, n_words long, pos array<int>, term array<int>"), "postings")


def _frame(spark: SparkSession, rows: list[tuple], **columns: pa.DataType) -> DataFrame:
    """Rows of a slice as Arrow columns: given as Python rows, they would need Python workers of their own on the executors."""
    values = zip(*rows, strict=True) if rows else [()] * len(columns)
    return spark.createDataFrame(pa.table({n: pa.array(x, t) for (n, t), x in zip(columns.items(), values, strict=True)}))


def _postings(index: DataFrame) -> DataFrame:
    return index.where(F.size("pos") > 0).select("rid", F.explode(F.arrays_zip("pos", "term")).alias("p")).select("rid", "p.pos", "p.term")


class Items:
    """One slice of the benchmark: its words, its terms by rarity in the documents, its anchors."""

    def __init__(self, rows: list, window: int) -> None:
        self.ids = ["" if r[0] is None else str(r[0]) for r in rows]
        self.words = [words(r[1]) for r in rows]
        self.window = window
        self.vocabulary = set(chain.from_iterable(self.words))
        self.number = {w: i for i, w in enumerate(sorted(self.vocabulary))}

    def need(self, i: int) -> int:
        return min(self.window, len(self.words[i]))

    def anchors(self, counts: dict[bytes, int]) -> set[tuple[int, int]]:
        """(item, offset) of each window's rarest term."""
        out = set()
        for i, w in enumerate(self.words):
            k = self.need(i)
            for lo in range(len(w) - k + 1 if w else 0):
                out.add((i, min(range(lo, lo + k), key=lambda o: (counts.get(w[o], 0), w[o], o))))
        return out


def _n_slices(benchmark: DataFrame, text: str, chars: int) -> int:
    return -(-(benchmark.agg(F.sum(F.length(text))).first()[0] or 0) // chars) or 1


def _slices(benchmark: DataFrame, key: str, text: str, window: int, n: int) -> Iterator[Items]:
    given = benchmark.select(F.col(key).cast("string").alias("id"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    for k in range(n):
        part = given.where(F.pmod(F.xxhash64("t"), F.lit(n)) == k) if n > 1 else given
        yield Items(part.collect(), window)  # about `chars` characters


def phrase_matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, chars: int = SLICE_CHARS) -> tuple[DataFrame, DataFrame]:
    """-> (documents: rid, id, n_words), (matches: rid, pos, item), one row per word hit and item that hits it."""
    spark, numbered, n = docs.sparkSession, _numbered(docs, key, text), _n_slices(benchmark, item_text, chars)
    if n > 1:
        numbered = written(numbered, "numbered")  # the numbers have to agree between slices
    known, found = None, None
    for items in _slices(benchmark, item, item_text, window, n):
        counts = term_counts(docs, items.vocabulary, text)
        anchors = items.anchors(counts)
        index = build_index(numbered, items.number, {items.words[i][o] for i, o in anchors}, window - 1)
        known = index.select("rid", "id", "n_words") if known is None else known
        anchor = _frame(spark, [(i, o, items.number[items.words[i][o]]) for i, o in sorted(anchors)], item=pa.int32(), off=pa.int32(), term=pa.int32())
        body = _frame(
            spark,
            [(i, o, items.number[w], items.need(i)) for i, ws in enumerate(items.words) for o, w in enumerate(ws)],
            item=pa.int32(), off=pa.int32(), term=pa.int32(), need=pa.int32(),
        )
        names = _frame(spark, list(enumerate(items.ids)), item=pa.int32(), name=pa.string())
        postings = _postings(index)
        aligned = written(
            postings.join(F.broadcast(anchor), "term").select("rid", "item", (F.col("pos") - F.col("off")).alias("shift")).distinct(), "alignments"
        )
        expected = aligned.join(F.broadcast(body), "item").withColumn("pos", F.col("shift") + F.col("off"))
        agree = expected.join(postings.hint("shuffle_merge"), ["rid", "pos", "term"]).select("rid", "item", "shift", "off", "pos", "need")
        run = Window.partitionBy("rid", "item", "shift")
        island = agree.withColumn("isle", F.col("off") - F.row_number().over(run.orderBy("off")))
        sized = island.withColumn("n", F.count("*").over(Window.partitionBy("rid", "item", "shift", "isle")))
        hit = sized.where("n >= need").select("rid", "pos", "item").distinct().join(F.broadcast(names), "item").select("rid", "pos", F.col("name").alias("item"))
        hit = written(hit, "phrase-matches")
        found = hit if found is None else found.unionByName(hit)
    return known, found


def proximity_matches(docs: DataFrame, benchmark: DataFrame, rare: int = 3, least: int = 2, span: int = 8, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", chars: int = SLICE_CHARS) -> DataFrame:
    """-> key, item, pos: places of one of an item's ``rare`` rarest terms with ``least`` - 1 others of them within ``span`` words.

    Only terms that the documents have are chosen, so a changed word costs no match; with fewer than ``least`` of them
    an item has none.
    """
    spark, numbered, n = docs.sparkSession, _numbered(docs, key, text), _n_slices(benchmark, item_text, chars)
    if n > 1:
        numbered = written(numbered, "numbered")
    found = None
    for items in _slices(benchmark, item, item_text, WINDOW, n):
        counts = term_counts(docs, items.vocabulary, text)
        chosen = [sorted({x for x in w if counts.get(x)}, key=lambda x: (counts[x], x))[:rare] for w in items.words]
        rows = [(items.ids[i], items.number[w]) for i, c in enumerate(chosen) if len(c) >= least for w in c]
        want = _frame(spark, rows, item=pa.string(), term=pa.int32())
        number = {w: items.number[w] for c in chosen if len(c) >= least for w in c}
        index = build_index(numbered, number, set(number), 0)
        placed = _postings(index).join(F.broadcast(want), "term").withColumn("cell", F.floor(F.col("pos") / span))
        near = F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell")
        both = placed.select("rid", "item", F.col("pos").alias("at"), near).join(placed.hint("shuffle_merge"), ["rid", "item", "cell"]).where(F.abs(F.col("pos") - F.col("at")) <= span)
        met = both.groupBy("rid", "item", "at").agg(F.count_distinct("term").alias("n")).where(F.col("n") >= least)
        met = met.join(index.select("rid", F.col("id").alias(key)).hint("shuffle_merge"), "rid").select(key, "item", F.col("at").alias("pos"))
        found = met if found is None else found.unionByName(met)
    return found


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """-> rid (the row's number), key, n_words, n_hit, n_items, items_sha256, contaminated."""
    known, found = phrase_matches(docs, benchmark, key, **options)
    hits = found.select("rid", "pos").distinct().groupBy("rid").agg(F.count("*").alias("n_hit"))
    which = found.select("rid", "item").distinct().groupBy("rid").agg(F.array_sort(F.collect_list("item")).alias("items"))
    joined = known.join(hits.join(which, "rid").hint("shuffle_merge"), "rid", "left")
    n_hit, items = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        "rid",
        F.col("id").alias(key),
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (SHARE * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without contaminated rows, each judged by its own text."""
    rows = numbered(docs)
    gone = contamination(rows, benchmark, "__rid", **options).where("contaminated").select("__rid")
    return columns_of(without(rows, written(gone, "contaminated"), BROADCAST_IDS), docs)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("rid")


OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, w, least(13, len(w)) AS k FROM (
        SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
wins AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS g
         FROM (SELECT item, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM b)),
grams AS (SELECT rid, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
          FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM b) WHERE len(w) >= k)),
m AS (SELECT rid, i, grams.k, item FROM grams JOIN wins USING (k, g)),
h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM m) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM m) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)
"""
