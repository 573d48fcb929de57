"""Ranked lexical search against a plain computation over all documents and items."""

import math
import random
import re

from quillmill.llm import ranking

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    rows = [(d, terms(t)) for d, t in docs]
    rows = [(d, w) for d, w in rows if w]
    n_docs, length = len(rows), sum(len(w) for _, w in rows)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for i, ws in wanted.items():
        scores = []
        for d, w in rows:
            m = 10 + 90 * len(w) * n_docs // length
            total = 0
            for t in ws & set(w):
                df = sum(t in v for _, v in rows)
                total += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * (1_000_000_000 * w.count(t) // (1000 * w.count(t) + 8 * m))
            if total > 0:
                scores.append((-total, d is None, d or 0))
        out += [(i, r, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def found(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    return sorted((tuple(r) for r in ranking.search(d, spark.createDataFrame(items, "item_id long, text string"), **options).collect()), key=str)


def test_search_equals_brute_force(spark):
    draw = random.Random(4)
    word = lambda: f"w{min(int(draw.expovariate(0.08)), 60)}"
    docs = [(d, " ".join(word() for _ in range(draw.randint(0, 60)))) for d in range(300)]
    docs += [(d + 1000, docs[d % 7][1]) for d in range(60)]  # ties
    items = [(i, " ".join(word() for _ in range(draw.randint(1, 25)))) for i in range(40)]
    want = brute(docs, items)
    assert found(spark, docs, items) == want
    assert found(spark, docs, items, pairs=60) == want  # several slices of the index


def test_steps():
    assert list(ranking.steps(ranking.np.array([10, 60, 0, 20, 30, 1]), 7, 50)) == [(0, 1), (1, 2), (2, 5), (5, 6)]
    assert list(ranking.steps(ranking.np.array([0, 0, 0]), 100, 50)) == [(0, 1), (1, 2), (2, 3)]


def test_search_of_odd_rows(spark):
    docs = [(1, "Rain, RAIN and É!"), (1, "rain"), (2, None), (3, ""), (4, "?? --"), (None, "rain"), (5, "é _x_ " * 5000), (6, "x"), (6, "x")]
    items = [(7, "rain x"), (7, "É"), (8, None), (9, "..."), (None, "RAIN"), (10, "nowhere"), (11, "rain rain rain")]
    assert found(spark, docs, items) == brute(docs, items)
    assert found(spark, [], items) == [] and found(spark, docs, []) == []
    assert found(spark, [(1, "a b"), (2, "b c")], [(1, "b")]) == brute([(1, "a b"), (2, "b c")], [(1, "b")])


def test_search_ignores_other_columns(spark):
    d = spark.createDataFrame([(1, "a b", 5, "z")], "doc_id long, text string, id int, term string")
    i = spark.createDataFrame([(1, "a", "q", 4)], "item_id int, text string, w string, n int")
    assert [tuple(r) for r in ranking.search(d, i).collect()] == [(r[0], r[1], r[2], r[3]) for r in brute([(1, "a b")], [(1, "a")])]
