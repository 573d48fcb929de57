"""Language identification by rank-order profiles of character n-grams.

A profile is the list of a language's most frequent n-grams (1 to 3 letters, word borders included), most frequent
first. A document's own list is compared to each profile by the out-of-place distance: the sum, over the document's
n-grams, of how far apart the two ranks are; an n-gram that the profile lacks counts as ``PROFILE`` places. The nearest
language wins, the alphabetically first one among equals. Equal counts rank by code points.

The score is d2 / (d1 + d2) for the nearest and second nearest distance, 0.5 to 1 (1 - d1 / largest possible if one
language is known).

Defined cases: null, empty and letterless texts give ``und`` with score 0, as does every text if nothing was learned;
a null key is neither held out nor learned from; texts are taken whole; every row is kept, repeated ones too.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.llm.common import hash01, held_out, table, with_outputs

#: N-grams in a profile; documents per language from which profiles are learned, about.
PROFILE, SAMPLE_PER_LANGUAGE = 300, 1500
_BORDER, _BITS = 1, 21


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of all n-grams of a text. A code holds up to three code points of 21 bits."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = _letters()[codes]
    if not letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes = np.concatenate(([_BORDER], np.where(letter, codes, _BORDER), [_BORDER]))
    twice = np.concatenate(([False], (codes[1:] == _BORDER) & (codes[:-1] == _BORDER)))
    codes = codes[~twice]
    two = codes[:-1] << _BITS | codes[1:]
    three = (codes[:-2] << 2 * _BITS | two[1:])[codes[1:-1] != _BORDER]
    grams = np.sort(np.concatenate((codes[codes != _BORDER], two, three)))
    first = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
    return grams[first], np.diff(np.append(first, len(grams)))


def ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent codes, first among equals the smaller; ``codes`` are in order."""
    return codes[np.argsort(-counts, kind="stable")[:size]]


def learn_profiles(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", size: int = PROFILE, sample: int = SAMPLE_PER_LANGUAGE) -> dict[str, list[int]]:
    """language -> its profile, from about ``sample`` documents of each language, chosen by a hash of the key."""
    known = docs.where(F.col(lang).isNotNull() & F.col(key).isNotNull())
    share = {r[0]: min(1.0, sample / r[1]) for r in known.groupBy(lang).count().collect()}
    if not share:
        return {}
    shares = F.create_map(*(F.lit(x) for item in sorted(share.items()) for x in item))
    part = known.where(hash01(key) < shares[F.col(lang)]).select(F.col(lang).alias("lang"), F.col(text).alias("t"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, codes, counts = [], [], []
            for name, t in zip(batch.column("lang").to_pylist(), batch.column("t").to_pylist(), strict=True):
                c, n = ngram_counts(t)
                langs.append(np.full(len(c), names.index(name)))
                codes.append(c)
                counts.append(n)
            if not langs:
                continue
            both = pa.table({"lang": np.concatenate(langs), "code": np.concatenate(codes), "n": np.concatenate(counts)})
            yield from both.group_by(["lang", "code"]).aggregate([("n", "sum")]).select(["lang", "code", "n_sum"]).rename_columns(["lang", "code", "n"]).to_batches()

    names = sorted(share)
    total = part.mapInArrow(count, "lang long, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "code"))
    best = total.withColumn("place", place).where(F.col("place") <= size).collect()
    out: dict[str, list[int]] = {}
    for r in sorted(best, key=lambda r: (r["lang"], r["place"])):
        out.setdefault(names[r["lang"]], []).append(r["code"])
    return out


def identify(docs: DataFrame, profiles: dict[str, list[int]], text: str = "text", keep: list[str] | None = None, size: int = PROFILE) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; ``keep``: which of the columns go on (all by default)."""

    def make():
        names = sorted(profiles)
        tables = []
        for name in names:
            codes = np.array(profiles[name], np.int64)
            order = np.argsort(codes)
            tables.append((codes[order], order))

        def one(t: str | None) -> tuple[str, float]:
            codes, counts = ngram_counts(t)
            if not len(codes) or not names:
                return "und", 0.0
            own = ranked(codes, counts, size)
            ranks, far = np.arange(len(own)), []
            for codes_, places in tables:
                at = np.minimum(np.searchsorted(codes_, own), len(codes_) - 1)
                far.append(int(np.where(codes_[at] == own, np.minimum(np.abs(places[at] - ranks), size), size).sum()))
            d1, d2 = sorted(far)[:2] if len(far) > 1 else (far[0], size * len(own) - far[0])
            return names[far.index(d1)], d2 / (d1 + d2) if d1 + d2 else 0.5

        return lambda texts: tuple(zip(*map(one, texts), strict=True)) if texts else ((), ())

    return with_outputs(docs, text, docs.columns if keep is None else keep, {"lang_pred": "string", "score": "double"}, make)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = learn_profiles(docs.where(~held_out("doc_id", 5, 0)))
    found = identify(docs, profiles, keep=["doc_id"])
    return found.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score")
