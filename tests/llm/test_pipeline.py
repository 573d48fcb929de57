"""The pipeline's run against its stages done by brute force."""

import itertools
import random

from tokenizers import Tokenizer

import corpus_pipeline
from quillmill.llm import bpe, groups
from tests.llm.test_duplicates import WORDS, brute_contamination, brute_fingerprint, brute_lines


def test_run_by_brute_force(spark, tmp_path):
    r = random.Random(17)
    item = " ".join(r.choices(WORDS, k=20))
    texts = [None, "", "12 34", "!!"]
    for _ in range(12):
        lines = [" ".join(r.choices(WORDS, k=r.randint(6, 25))) for _ in range(r.randint(1, 4))]
        texts.append("\n".join(lines))
        if r.random() < 0.5:
            texts.append("\n".join([lines[0], " ".join(r.choices(WORDS, k=9))]))
    texts += [texts[5], item + " and more", " ".join(r.choices(WORDS, k=300)) + " " + item]
    rows = [(i, t, "en", "src", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    known = {i: t for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)}
    left = dict(zip(known, brute_lines(list(known.values())), strict=True))
    fps = {i: brute_fingerprint(t) for i, t in left.items()}
    forest = groups.Forest(len(texts))
    for a, b in itertools.combinations(left, 2):
        if (fps[a] ^ fps[b]).bit_count() <= 3:
            forest.join(a, b)
    kept = {i: t for i, t in left.items() if forest.root(i) == i}
    judged = brute_contamination(list(kept.values()), [(1, item)])
    clean = {i: t for (i, t), (n, hit, _) in zip(kept.items(), judged, strict=True) if not (hit and 20 * hit >= n)}
    library = Tokenizer.from_file(bpe.TOKENIZER)

    got = {x["doc_id"]: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {i: x["ids"] for i, x in got.items()} == {i: library.encode(t, add_special_tokens=False).ids for i, t in clean.items()}
    assert len(clean) < len(kept) <= len(left) < len(texts)


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some words in a line here", "en", "s", 25), (None, "more words in another line", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for d in (docs, docs.limit(0)):
            assert stage(spark, d, str(tmp_path)).columns == docs.columns
