"""Toxicity by compression distance.

A document is normalised (letters only, each word with a capital, which tells a word's beginning from its inside) and
cut into windows of whole words, about ``WINDOW`` bytes each. Two zstandard dictionaries hold windows as they are: one
those of ordinary documents, one those of toxic documents. A window is compressed with the ordinary dictionary, and
with the toxic one laid in front of the ordinary one, where its matches are the dearest: what the two have in common
cancels out, and a window becomes shorter only by a longer match in the toxic part. A window's gain is the difference
of the two lengths in bytes.

Most windows of a toxic document are ordinary text, so the toxic dictionary is trained in rounds: the toxic documents
are dealt into ``FOLDS``, and of each fold those windows stay that gain ``LEAST`` bytes or more by the windows of the
other folds. How many windows of a document gain as much as each of ``THRESHOLDS``, the sum of the gains, and both by
the number of windows go into a logistic curve, calibrated on gains by dictionaries that lack the document's own fold.

Fitting takes a bounded sample of the labelled documents: about ``SAMPLE`` of them, chosen by a hash of the id, of at
most ``SAMPLE_CHARS`` characters each; of their distinct windows ``ORDINARY`` and ``TOXIC`` bytes at most, chosen by a
hash. Scoring takes every text whole.

Defined cases: null and letterless texts are scored as having no window (the curve's value at no gain); with one class
alone the score is that class's smoothed share, without labels 0.5; null labels and null ids are not learned from;
repeated labels of an id count once, the larger, and so do repeated rows of an id, the smallest text; every row is kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm import logistic
from quillmill.llm.common import hash01, held_out, table, with_outputs

SAMPLE, SAMPLE_CHARS = 5000, 20_000
WINDOW, FOLDS, ROUNDS, LEAST = 64, 3, 2, 2
THRESHOLDS = (2, 4)
#: Bytes of windows in the two dictionaries; together within the compressor's reach of ``1 << REACH``.
ORDINARY, TOXIC, REACH = 3_000_000, 1_000_000, 22
_TABLE = bytes(c if 97 <= c <= 122 or 65 <= c <= 90 or c >= 128 else 32 for c in range(256))


def normal(text: str | None) -> bytes:
    return b" ".join((text or "").title().encode("utf-8", "surrogatepass").translate(_TABLE).split())


def windows(text: bytes) -> list[bytes]:
    """Pieces of about ``WINDOW`` bytes, whole words, with a blank on both sides; a word of any length stays whole."""
    out, at = [], 0
    while at < len(text):
        end = text.find(b" ", at + WINDOW)
        end = len(text) if end < 0 else end
        out.append(b" " + text[at:end] + b" ")
        at = end + 1
    return out


def dictionary(pieces: list[bytes], size: int) -> bytes:
    """Distinct pieces in the order of a hash, as far as ``size`` bytes reach."""
    order = sorted(set(pieces), key=lambda w: (xxhash.xxh3_64_intdigest(w), w))
    return b"".join(order)[:size]


def lengths(content: bytes):
    """A function from a window to its compressed length with this dictionary."""
    shape = zstandard.ZstdCompressionParameters(
        window_log=REACH, chain_log=REACH, hash_log=REACH - 2, search_log=5, min_match=4, target_length=16,
        strategy=zstandard.STRATEGY_LAZY2, write_content_size=0, write_checksum=0, write_dict_id=0,
    )
    held = zstandard.ZstdCompressionDict(content if len(content) >= 8 else content + b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=shape)
    compress = zstandard.ZstdCompressor(dict_data=held, compression_params=shape).compress
    return lambda w: len(compress(w))


class Model:
    """What scoring needs: two dictionaries and the calibrated curve."""

    def __init__(self, ordinary: bytes, toxic: bytes, curve: tuple | None = None) -> None:
        self.ordinary, self.toxic, self.curve = ordinary, toxic, curve

    def gains(self):
        """A function from windows to their gains."""
        if not self.toxic:
            return lambda ws: np.zeros(len(ws))
        plain, toxic = lengths(self.ordinary), lengths(self.toxic + self.ordinary)
        return lambda ws: np.array([plain(w) - toxic(w) for w in ws], float)


def features(gains: np.ndarray) -> list[float]:
    n, total = max(len(gains), 1), np.maximum(gains, 0).sum()
    hits = [(gains >= t).sum() for t in THRESHOLDS]
    return [*np.log1p(hits), np.log1p(total), np.sqrt(hits[0] / n), np.sqrt(total / n)]


def train(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> Model:
    """Windows of toxic and of ordinary documents, both by fold -> the two dictionaries."""
    base = dictionary([w for fold in ordinary for w in fold], ORDINARY)
    whole = [sorted(set(fold)) for fold in toxic]
    kept = whole
    for _ in range(ROUNDS if len(whole) > 1 else 0):
        others = [[w for j, fold in enumerate(kept) if j != i for w in fold] for i in range(len(kept))]
        gains = [Model(base, dictionary(o, TOXIC)).gains()(fold) for o, fold in zip(others, whole, strict=True)]
        kept = [[w for w, g in zip(fold, found, strict=True) if g >= LEAST] for fold, found in zip(whole, gains, strict=True)]
    return Model(base, dictionary([w for fold in kept for w in fold], TOXIC))


def _known(documents: list[tuple[str, int]]) -> list[tuple[list[bytes], int]]:
    return [(windows(normal(t)), y) for t, y in dict.fromkeys(documents)]


def _part(known: list[tuple[list[bytes], int]], k: int) -> tuple[list[list[float]], list[int], Model]:
    """Fold ``k``: features of its documents by a model of the other folds, and their labels; ``FOLDS``: the model of all."""
    toxic, ordinary = ([[w for ws, y in known[i::FOLDS] if y == label for w in ws] for i in range(FOLDS)] for label in (1, 0))
    model = train(*([fold for i, fold in enumerate(folds) if i != k] for folds in (toxic, ordinary)))
    own = known[k::FOLDS] if k < FOLDS else []
    gains = model.gains() if own else None
    return [features(gains(ws)) for ws, _ in own], [y for _, y in own], model


def _fitted(parts: list[tuple[list[list[float]], list[int], Model]]) -> Model:
    x, y = ([v for part in parts for v in part[i]] for i in (0, 1))
    model = parts[-1][2]
    model.curve = logistic.fit(np.array(x), np.array(y, float)) if y else None
    return model


def fit(documents: list[tuple[str, int]]) -> Model:
    """(text, 0 or 1) -> a model: dictionaries from all folds, the curve from gains by the folds other than a document's own."""
    known = _known(documents)
    return _fitted([_part(known, k) for k in range(FOLDS + 1)])


def fit_in_tasks(sample: DataFrame) -> Model:
    """The same from ``labelled_rows``, a task for each fold and one for the whole; each gets the sample, which is bounded."""
    each = sample.withColumn("fold", F.explode(F.array(*map(F.lit, range(FOLDS + 1))))).repartition(8 * FOLDS, "fold")

    def work(given: pa.Table) -> pa.Table:
        k, rows = given.column("fold")[0].as_py(), sorted(given.select(["h", "key", "t", "y"]).to_pylist(), key=lambda r: (r["h"], r["key"]))
        x, y, model = _part(_known([(r["t"], r["y"]) for r in rows]), k)
        dictionaries = (model.ordinary, model.toxic) if k == FOLDS else (b"", b"")
        return pa.table([[k], [[v for row in x for v in row]], [y], *([d] for d in dictionaries)], schema=pa.schema(shape))

    shape = [("fold", pa.int32()), ("x", pa.list_(pa.float64())), ("y", pa.list_(pa.int32())), ("ordinary", pa.binary()), ("toxic", pa.binary())]
    rows = {r["fold"]: r for r in each.groupBy("fold").applyInArrow(work, "fold int, x array<double>, y array<int>, ordinary binary, toxic binary").collect()}
    if not rows:
        return fit([])
    parts = [(np.array(rows[k]["x"]).reshape(len(rows[k]["y"]), -1).tolist() if rows[k]["y"] else [], rows[k]["y"], Model(bytes(rows[k]["ordinary"]), bytes(rows[k]["toxic"]))) for k in range(FOLDS + 1)]
    return _fitted(parts)


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, text: str = "text", key: str = "doc_id", sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> DataFrame:
    """-> h, key, t, y: about ``sample`` labelled texts of at most ``chars`` characters, one of an id; h is a hash of the id."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias("y"))
    n = known.count()
    some = known.where(hash01(key) < min(1.0, sample / max(n, 1)))  # about `sample` rows: small enough to broadcast
    texts = docs.where(F.length(text) <= chars).select(F.col(key).alias("k"), F.col(text).alias("t"))
    once = texts.join(F.broadcast(some), F.col("k") == F.col(key)).groupBy(key, "y").agg(F.min("t").alias("t"))
    return once.select(hash01(key).alias("h"), F.col(key).alias("key"), "t", F.col("y").cast("int").alias("y"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, **options) -> list[tuple[str, int]]:
    """The same as (text, label) in the order of h."""
    return [(r["t"], r["y"]) for r in sorted(labelled_rows(docs, labels, label, **options).collect(), key=lambda r: (r["h"], r["key"]))]


def score_documents(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (1 from 0.5)."""

    def make():
        gains = model.gains()

        def g(texts):
            if not texts:
                return [], []
            x = np.array([features(gains(windows(normal(t)))) for t in texts])
            p = logistic.predict(model.curve, x) if model.curve else np.full(len(texts), 0.5)
            return p, (p >= 0.5).astype(np.int32)

        return g

    return with_outputs(docs, text, docs.columns if keep is None else keep, {"score": "double", "predicted": "int"}, make)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = fit_in_tasks(labelled_rows(docs, labels.where(~held_out("doc_id", 5, 0)), "toxic"))
    scored = score_documents(docs, model, keep=["doc_id"])
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")
