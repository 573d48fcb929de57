"""Line dedup, SimHash near-dedup, decontamination, components: against brute force."""

import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillmill.llm import common, decontaminate, groups, linededup, neardup

WORDS = ["lorem", "ipsum", "dolor", "sit", "amet", "tempor", "magna", "aliqua", "erat", "vita", "nunc", "orci", "felis", "massa"]


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in zip(ids or range(len(texts)), texts, strict=True)], "doc_id long, text string, rk string, fp string")


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(500, i) for i in range(501, 560)]
    got = dict(groups.components(spark.createDataFrame(edges, "a long, b long")).collect())
    forest = groups.Forest(600)
    for a, b in edges:
        forest.join(a, b)
    touched = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: min(y for y in touched if forest.root(y) == forest.root(x)) for x in touched}
    assert groups.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_arrow_memory_goes_back(monkeypatch):
    from types import SimpleNamespace

    calls = []
    pool = SimpleNamespace(release_unused=lambda: calls.append(1))
    monkeypatch.setattr(common.pa, "default_memory_pool", lambda: pool)
    assert list(common.handing_back(lambda batches: (2 * b for b in batches))(iter([1, 2, 3]))) == [2, 4, 6]
    assert len(calls) == 4  # after each batch and at the end


@pytest.mark.parametrize("limit", [None, 3])
def test_runs_cut_whole_groups(limit):
    import pyarrow as pa

    keys = sorted(random.Random(4).choices(range(12), k=60))
    batches = [pa.RecordBatch.from_pydict({"k": keys[i : i + 7]}) for i in range(0, 60, 7)]
    seen = {}
    for t, starts, piece in groups.runs(iter(batches), ["k"], limit):
        k = t.column("k").to_pylist()
        for lo, hi in itertools.pairwise([*starts.tolist(), len(k)]):
            assert len(set(k[lo:hi])) == 1
            assert piece or k[lo] not in seen
            seen[k[lo]] = seen.get(k[lo], 0) + hi - lo
    assert seen == {x: keys.count(x) for x in set(keys)}


def test_edit_distance():
    r = random.Random(0)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
            row = new
        return row[-1]

    pairs = [tuple("".join(r.choices("abc", k=r.randint(0, 12))) for _ in range(2)) for _ in range(500)]
    pairs += [tuple("".join(r.choices("ab語", k=r.choice([63, 64, 65, 128, 129, 200]))) for _ in range(2)) for _ in range(40)]
    expected = [plain(a, b) for a, b in pairs]
    assert [linededup.edit_distance(a, b) for a, b in pairs] == expected
    assert linededup.edit_distances(*map(list, zip(*pairs, strict=True))).tolist() == expected


def brute_lines(texts):
    """The line dedup's definition over all pairs of lines, whatever way they could be found."""
    lines = []
    for d, t in enumerate(texts):
        for i, (w, raw) in enumerate(zip(linededup.normal_lines(t or ""), (t or "").split("\n"), strict=True)):
            size = linededup.letters(w)
            if w:
                lines.append((d, i, b" ".join(w).decode() if size >= 10 or len(w) >= 5 else "raw " + raw.strip(), len(w) >= 5 or size >= 30))
    full = {x: f for _, _, x, f in lines}
    distinct = sorted(full)
    forest = groups.Forest(len(distinct))
    for a, b in itertools.combinations(range(len(distinct)), 2):
        x, y = distinct[a], distinct[b]
        if full[x] and full[y] and linededup.edit_distance(x, y) <= 0.2 * max(len(x), len(y)) + 1e-9:
            forest.join(a, b)
    first, gone = {}, set()
    for d, i, x, _ in lines:
        g = forest.root(distinct.index(x))
        if g in first:
            gone.add((d, i))
        first.setdefault(g, (d, i))
    return [None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in enumerate(texts)]


@pytest.mark.parametrize("block", [4096, 3])
def test_line_dedup_by_brute_force(spark, monkeypatch, block):
    r = random.Random(7)
    base = [" ".join(r.choices(WORDS, k=40)) for _ in range(12)]

    def variant(x):
        w = x.split()
        if r.random() < 0.6:
            w[r.randrange(len(w))] = r.choice(WORDS)
        return " ".join(w).upper() if r.random() < 0.3 else " ".join(w) + "."

    texts = ["\n".join(variant(r.choice(base)) if r.random() < 0.7 else " ".join(r.choices(WORDS, k=r.randint(1, 30))) for _ in range(6)) for _ in range(30)]
    texts += [None, "", "\n\n", "short line\nshort line", base[0] + "\n" + base[0], "---\n---\n x \nx\nX", "y" * 9000 + " " + "z" * 9000]
    monkeypatch.setattr(linededup, "BLOCK", block)
    got = {x["doc_id"]: x for x in linededup.dedup_lines(frame(spark, texts)).collect()}
    assert [got[i]["text"] for i in range(len(texts))] == brute_lines(texts)
    assert got[0]["rk"] == "x" and linededup.dedup_lines(frame(spark, ["a"]).limit(0)).count() == 0


def test_bounds_of_similarity_hold():
    r = random.Random(19)
    lines = [" ".join("".join(r.choices("aeiourst", k=r.randint(1, 7))) for _ in range(r.randint(1, 25))) for _ in range(60)]
    for x in list(lines):
        for k in (1, 4, 9):
            y = list(x)
            for _ in range(k):
                y[r.randrange(len(y))] = r.choice("aeiou ")
            lines.append(" ".join("".join(y).split()) or "a")
    bits, sizes = linededup.grams(lines)
    for i, x in enumerate(lines):
        may, found = linededup.least_edits(bits[i : i + 1], bits, sizes[i], sizes), linededup.similar([x] * len(lines), lines, 0.8)
        for j, y in enumerate(lines):
            far = linededup.edit_distance(x, y)
            assert may[j] <= far and found[j] == (far <= 0.2 * max(len(x), len(y)) + 1e-9)


def test_pairs_alone_end_early():
    draw, early = random.Random(8), 0
    for _ in range(400):
        x = "".join(draw.choices("abcde é", k=draw.choice([0, 1, 5, 63, 64, 65, 200, 500])))
        y = "".join(draw.choice(["", "z", "qa", c]) if draw.random() < draw.choice([0, 0.1, 0.5]) else c for c in x)
        y = y if draw.random() < 0.7 else "".join(draw.choices("abcde é", k=draw.randint(0, 500)))
        most, want = linededup.allowed(max(len(x), len(y)), 0.8), linededup.edit_distance(x, y)
        got, exact = linededup.distance_up_to(linededup.places(x), len(x), y, most)
        assert got == want if exact else most < got <= want
        assert exact or want > most
        early += not exact
    assert early > 50


def test_few_long_pairs_are_compared_alone(monkeypatch):
    draw = random.Random(9)
    a = [" ".join(draw.choices(WORDS, k=60)) for _ in range(40)]
    b = [" ".join(draw.choices(WORDS, k=60)) if i % 2 else "".join("" if draw.random() < 0.1 else c for c in x) for i, x in enumerate(a)]
    want = [1 - linededup.edit_distance(x, y) / max(len(x), len(y)) >= 0.8 for x, y in zip(a, b, strict=True)]
    monkeypatch.setattr(linededup, "least_distances", None)  # forty pairs of some 350 characters: a column of all costs more than each alone
    assert linededup.similar(a, b, 0.8).tolist() == want and any(want) and not all(want)
    monkeypatch.setattr(linededup, "KNOWN_BITS", 0)
    assert linededup.similar(a, b, 0.8).tolist() == want


def test_distances_too_far_end_early():
    draw, a, b = random.Random(5), [], []
    for _ in range(400):
        x = "".join(draw.choices("abcde é", k=draw.choice([0, 1, 5, 63, 64, 65, 128, 200, 500])))
        y = "".join(draw.choice(["", "z", "qa", c]) if draw.random() < draw.choice([0, 0.1, 0.5]) else c for c in x)
        a.append(x)
        b.append(y if draw.random() < 0.7 else "".join(draw.choices("abcde é", k=draw.randint(0, 500))))
    want = np.array([linededup.edit_distance(x, y) for x, y in zip(a, b, strict=True)])
    most = np.array([linededup.allowed(max(len(x), len(y)), 0.8) for x, y in zip(a, b, strict=True)])
    assert linededup.edit_distances(a, b).tolist() == want.tolist()
    low, exact = linededup.least_distances(a, b, most)
    assert (low[exact] == want[exact]).all() and exact[want <= most].all()
    assert (~exact).any() and (low[~exact] <= want[~exact]).all() and (low[~exact] > most[~exact]).all()


def test_large_groups_are_compared_together(monkeypatch):
    draw, texts, starts, calls = random.Random(6), [], [], []
    for g in range(30):
        starts.append(len(texts))
        base = [draw.choices("abcdefgh ", k=80) for _ in range(2)]
        for _ in range(12):
            one = list(draw.choice(base))
            one[draw.randrange(80)] = "xyz"[g % 3]
            texts.append("".join(one))
    plain = linededup.similar
    monkeypatch.setattr(linededup, "similar", lambda x, y, least: calls.append(len(x)) or plain(x, y, least))
    a, b = linededup.group_links(texts, starts, 0.8)
    assert len(calls) < 30  # and not some calls for each group
    own, want = groups.Forest(len(texts)), groups.Forest(len(texts))
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        own.join(x, y)
    for lo in starts:
        for x in range(lo, lo + 12):
            for y in range(x):
                if y >= lo and plain([texts[x]], [texts[y]], 0.8)[0]:
                    want.join(x, y)
    assert [own.root(x) for x in range(len(texts))] == [want.root(x) for x in range(len(texts))]


def test_links_of_groups_connect_what_is_similar():
    r = random.Random(43)
    texts, starts = [], []
    for n in (1, 2, 7, 60, 3):
        starts.append(len(texts))
        base = [" ".join(r.choices(WORDS, k=12)) for _ in range(3)]
        for _ in range(n):
            w = r.choice(base).split()
            for _ in range(r.randint(0, 3)):
                w[r.randrange(12)] = r.choice(WORDS)
            texts.append(" ".join(w))
    a, b = linededup.forest(texts, starts, 0.8)
    own, true = groups.Forest(len(texts)), groups.Forest(len(texts))
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        assert own.join(x, y)
    for lo, hi in itertools.pairwise([*starts, len(texts)]):
        for x, y in itertools.combinations(range(lo, hi), 2):
            if linededup.edit_distance(texts[x], texts[y]) <= 0.2 * max(len(texts[x]), len(texts[y])) + 1e-9:
                true.join(x, y)
    assert [own.root(x) for x in range(len(texts))] == [true.root(x) for x in range(len(texts))]


def test_large_groups_lose_no_link():
    """A chain, copies around a text, and pairs among lines with a common passage, against all pairs."""
    r = random.Random(47)
    words = ["".join(r.choices("etaoinshrdlu", k=r.randint(3, 9))) for _ in range(4000)]
    base, passage = r.choices(words, k=40), r.choices(words, k=12)
    chain = [r.choices(words, k=15)]
    for k in range(119):
        chain.append([*chain[-1]])
        chain[-1][k % 15] = r.choice(words)
    chain = [" ".join(x) for x in chain]
    copies = [" ".join(r.choice(words) if r.random() < 0.12 else w for w in base) for _ in range(300)]
    others = [" ".join(passage + r.choices(words, k=10)) for _ in range(400)]
    twins = [" ".join(x.split()[:-1] + ["twin"]) for x in others[:100]]
    parts = [["a b", "a b"], chain, copies, others + twins]
    starts = [sum(map(len, parts[:k])) for k in range(4)]
    texts = [x for p in parts for x in p]
    a, b = linededup.group_links(texts, starts, 0.8)
    own, true = groups.Forest(len(texts)), groups.Forest(len(texts))
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        own.join(x, y)
    for lo, hi in zip(starts, [*starts[1:], len(texts)], strict=True):
        pairs = [(x, y) for x, y in itertools.combinations(range(lo, hi), 2) if abs(len(texts[x]) - len(texts[y])) <= 0.2 * max(len(texts[x]), len(texts[y]))]
        for (x, y), near in zip(pairs, linededup.similar([texts[x] for x, _ in pairs], [texts[y] for _, y in pairs], 0.8), strict=True):
            if near:
                true.join(x, y)
    root = lambda f: [f.root(x) for x in range(len(texts))]
    assert root(own) == root(true)
    assert len(set(root(own)[2:122])) == 1 and all(own.root(starts[3] + k) == own.root(starts[3] + 400 + k) for k in range(100))


def test_simhash_blocks_find_what_differs_in_two_bits():
    draw = np.random.default_rng(3)
    h = draw.integers(0, 1 << 63, 200).astype(np.uint64)
    for n in (0, 1, 2):
        other = h.copy()
        for k in range(len(h)):
            for bit in draw.choice(64, n, replace=False):
                other[k] ^= np.uint64(1) << np.uint64(bit)
        assert (linededup.block_keys(h) == linededup.block_keys(other)).any(axis=1).all()
    lines = [[b"one", b"word"], [b"x"], [b"one", b"word"]]
    assert linededup.simhashes(lines)[0] == linededup.simhashes(lines)[2] != linededup.simhashes(lines)[1]


def test_line_dedup_of_repeated_rows_and_null_ids(spark):
    r = random.Random(31)
    a, b = (" ".join(r.choices(WORDS, k=9)) for _ in range(2))
    rows = [(5, a), (5, a), (None, a + "\n" + b), (2, b), (2, a)]
    got = linededup.dedup_lines(frame(spark, [t for _, t in rows], [i for i, _ in rows])).select("doc_id", "text", "lines_removed").collect()
    assert sorted(got, key=str) == sorted([(5, "", 1), (5, "", 1), (None, a + "\n" + b, 0), (2, "", 1), (2, "", 1)], key=str)


def brute_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_duplicates_by_brute_force(spark):
    r = random.Random(11)
    texts = [None, "", " \t", "one", "one two", "ÄÖ One TWO three\x1cfour"]
    for _ in range(25):
        w = r.choices(WORDS, k=r.randint(3, 120))
        for _ in range(r.randint(1, 4)):
            texts.append(" ".join(w))
            w[r.randrange(len(w))] = "changed"
    got = {x["doc_id"]: x for x in neardup.near_duplicates(frame(spark, texts)).collect()}
    fps = list(map(brute_fingerprint, texts))
    forest = groups.Forest(len(texts))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 3:
            forest.join(a, b)
    assert [got[i]["fingerprint"] for i in range(len(texts))] == [f"{x:016x}" for x in fps]
    assert [got[i]["component_id"] for i in range(len(texts))] == [forest.root(i) for i in range(len(texts))]
    kept = {x["doc_id"] for x in neardup.keep_one(frame(spark, texts)).collect()}
    assert kept == {forest.root(i) for i in range(len(texts))}
    assert neardup.near_duplicates(frame(spark, ["a"]).limit(0)).count() == 0


@pytest.mark.parametrize("m", [2, 3, 4, 5, 6])
@pytest.mark.parametrize("block", [4096, 8])
def test_links_find_every_component(spark, monkeypatch, m, block):
    r = random.Random(m)
    seeds = [r.getrandbits(64) for _ in range(40)]
    fps = {0, 2**64 - 1}
    for s in seeds:
        for _ in range(12):
            fps.add(s)
            for _ in range(r.randint(1, 3)):
                s ^= 1 << r.randrange(64)
    fps = sorted(fps)
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    monkeypatch.setattr(neardup, "BLOCK", block)
    found = neardup.links(spark.createDataFrame([(x,) for x in signed], "fp long"), 3, m).collect()
    place = {x: i for i, x in enumerate(signed)}
    own, true = groups.Forest(len(fps)), groups.Forest(len(fps))
    for a, b in found:
        assert ((a ^ b) & (2**64 - 1)).bit_count() <= 3
        own.join(place[a], place[b])
    for a, b in itertools.combinations(range(len(fps)), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 3:
            true.join(a, b)
    assert [own.root(i) for i in range(len(fps))] == [true.root(i) for i in range(len(fps))]


def test_thresholds_sum_up():
    parts = neardup.partition_bits(np.eye(64), 4)
    assert sorted(b for p in parts for b in p) == list(range(64))
    counts = {(0, 0, v): 100 if v == 0 else 0 for v in range(4)}
    plan = neardup.Plan(parts, 3, 1000, counts)
    u = plan.thresholds(np.array([0, 2**63, 12345], np.uint64))
    assert (u.sum(axis=1) == 4).all() and (u >= 0).all()  # thresholds t = u - 1 sum to r - m + 1


def brute_contamination(texts, items, window=13):
    out = []
    for t in texts:
        w, hit, which = decontaminate.words(t), set(), set()
        for name, x in items:
            v = decontaminate.words(x)
            k = min(window, len(v))
            for o in range(len(v) - k + 1 if v else 0):
                for p in range(len(w) - k + 1):
                    if w[p : p + k] == v[o : o + k]:
                        hit |= set(range(p, p + k))
                        which.add("" if name is None else str(name))
        out.append((len(w), len(hit), sorted(which)))
    return out


@pytest.mark.parametrize("chars", [8_000_000, 60])
def test_decontamination_by_brute_force(spark, chars):
    r = random.Random(13)
    items = [(i, " ".join(r.choices(WORDS, k=r.choice([1, 2, 5, 13, 14, 30])))) for i in range(8)] + [(8, None), (9, "?!"), (None, "alone here"), (3, "again alone")]
    texts = [None, "", "...", "Alone, HERE again alone"]
    for _ in range(25):
        parts = [" ".join(r.choices(WORDS, k=r.randint(0, 20))), r.choice([x for _, x in items if x]), " ".join(r.choices(WORDS, k=r.randint(0, 9)))]
        texts.append(" ".join(parts * r.randint(1, 2)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.contamination(frame(spark, texts), bench, chars=chars).collect()
    got = {x["doc_id"]: (x["n_words"], x["n_hit"], x["n_items"]) for x in rows}
    assert [got[i] for i in range(len(texts))] == [(a, b, len(c)) for a, b, c in brute_contamination(texts, items)]
    assert decontaminate.contamination(frame(spark, texts), bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(frame(spark, texts).limit(0), bench).count() == 0


def test_items_reach_spark_without_python_workers(spark, monkeypatch):
    docs = spark.range(3).selectExpr("id AS doc_id", "IF(id = 1, 'a lorem ipsum b', 'other') AS text")
    bench = spark.range(1).selectExpr("id AS item_id", "'lorem ipsum' AS text")

    def refuse(*_):
        raise AssertionError("rows given as Python objects start workers of their own on the executors")

    monkeypatch.setattr(spark.sparkContext, "parallelize", refuse)
    got = {x["doc_id"]: x["n_hit"] for x in decontaminate.contamination(docs, bench).collect()}
    assert got == {0: 0, 1: 2, 2: 0}
    assert decontaminate.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    near = decontaminate.proximity_matches(docs, bench)
    assert near.columns == ["doc_id", "item", "pos"] and near.count() == 2


def brute_proximity(texts, items, rare, least, span):
    docs = [decontaminate.words(t) for t in texts]
    count = {}
    for w in docs:
        for x in w:
            count[x] = count.get(x, 0) + 1
    out = set()
    for name, x in items:
        chosen = sorted({v for v in decontaminate.words(x) if v in count}, key=lambda v: (count[v], v))[:rare]
        for d, w in enumerate(docs):
            for at, v in enumerate(w):
                if len(chosen) >= least and v in chosen and len({u for u in w[max(0, at - span) : at + span + 1] if u in chosen}) >= least:
                    out.add((d, str(name), at))
    return out


def test_proximity_by_brute_force(spark):
    r = random.Random(37)
    texts = ["zebra filler quagga filler okapi", "zebra " + "filler " * 30 + "quagga okapi", None, ""] + [" ".join(r.choices(WORDS, k=60)) for _ in range(15)]
    items = [(5, "zebra quagga okapi"), (6, "zebra neverseen okapi"), (7, "neverseen zebra"), (8, "lorem ipsum dolor sit amet"), (9, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for rare, least, span in ((3, 2, 8), (3, 3, 6), (2, 2, 3)):
        got = decontaminate.proximity_matches(frame(spark, texts), bench, rare=rare, least=least, span=span).collect()
        assert {(x["doc_id"], x["item"], x["pos"]) for x in got} == brute_proximity(texts, items, rare, least, span) and len(got) == len(set(got))


def test_block_pairs_let_all_meet(spark):
    rows = spark.createDataFrame([(1, i) for i in range(20)] + [(2, 99)], "key long, v long")
    got = groups.block_pairs(rows, "key", F.xxhash64("v"), block=6).collect()
    met = {frozenset((a["v"], b["v"])) for a in got for b in got if (a["key"], a["b1"], a["b2"]) == (b["key"], b["b1"], b["b2"])}
    assert all(frozenset(p) in met for p in itertools.combinations(range(20), 2))


def changed(r, line, words):
    """A line with up to a fifth of its letters changed: words replaced, or letters."""
    w = line.split()
    if r.random() < 0.7:
        for i in r.sample(range(len(w)), max(1, round(len(w) * r.uniform(0, 0.2)))):
            w[i] = r.choice(words)
        return " ".join(w)
    x = list(line)
    for _ in range(max(1, len(x) // 40)):
        i = r.randrange(len(x))
        x[i] = r.choice("aeiou") if x[i] != " " else " "
    return "".join(x)


def test_line_dedup_recall(spark):
    """Against edit similarity over all pairs of lines of 5 to 60 words."""
    r = random.Random(23)
    words = ["".join(r.choices("etaoinshrdlucmfwyp", k=r.randint(2, 9))) for _ in range(3000)]
    lines = []
    for n in [5, 6, 8, 10, 14, 18, 21, 30, 60] * 40:
        lines.append(" ".join(r.choices(words[:40] if r.random() < 0.3 else words, k=n)))
        lines.append(changed(r, lines[-1], words))
    forest, pairs = groups.Forest(len(lines)), 0
    for a, b in itertools.combinations(range(len(lines)), 2):
        if abs(len(lines[a]) - len(lines[b])) <= 0.2 * max(len(lines[a]), len(lines[b])) and linededup.edit_distance(lines[a], lines[b]) <= 0.2 * max(len(lines[a]), len(lines[b])) + 1e-9:
            forest.join(a, b)
            pairs += 1
    true = {i for i in range(len(lines)) if forest.root(i) != i}
    gone = {x["doc_id"] for x in linededup.dedup_lines(frame(spark, lines)).where("lines_removed > 0").collect()}
    print(len(gone), "of", len(true))
    assert gone <= true and len(true) > 250
    met = {}
    for kinds in (("simhash",), ("words", "pairs")):
        rows = [linededup.band_keys([linededup.tokens(w) for x in (a, b) for w in linededup.normal_lines(x)], kinds) for a, b in zip(lines[::2], lines[1::2], strict=True) if linededup.similar([a], [b], 0.8)[0]]
        cut = lambda k: {k[i : i + linededup.KEY] for i in range(0, len(k), linededup.KEY)}
        met[kinds[0]] = sum(bool(cut(x) & cut(y)) for x, y in rows) / len(rows)
    print("share of similar pairs that meet:", {k: round(v, 3) for k, v in met.items()})
    assert met["words"] > 0.9 and met["simhash"] > 0.1
    assert len(gone) >= 0.9 * len(true), len(gone) / len(true)


def test_line_dedup_of_few_words(spark):
    """Exact repeats below five words, near ones in scripts without blanks."""
    long = "".join(chr(0x4E00 + random.Random(3).randrange(5000) + i % 7) + chr(0x4E00 + 37 * i % 4999) for i in range(60))
    near = long[:50] + "\u4e00" + long[51:]
    wide = "tres\u00a0mots\u3000sans\u00a0blanc"
    texts = ["All rights reserved worldwide\nshort\n" + long, "all rights reserved, worldwide\nshort\n" + wide, wide + "\nAll rights reversed worldwide", near + "\nown"]
    got = {x["doc_id"]: x["text"] for x in linededup.dedup_lines(frame(spark, texts)).collect()}
    assert got == {0: texts[0], 1: wide, 2: "All rights reversed worldwide", 3: "own"}


def test_rows_are_dropped_by_number(spark):
    """Repeated rows, null ids and one id with two texts."""
    r = random.Random(29)
    a, b, c, item = (" ".join(r.choices(WORDS, k=40)) for _ in range(4))
    rows = [(1, a), (1, a), (None, a), (2, a), (2, b), (None, c), (None, c)]
    kept = neardup.keep_one(frame(spark, [t for _, t in rows], [i for i, _ in rows])).collect()
    assert sorted(((x["doc_id"] or 0, x["text"]) for x in kept)) == sorted([(1, a), (2, b), (0, c)])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, item), (1, a), (None, item), (None, b), (3, item), (3, item), (4, c)]
    clean = decontaminate.drop_contaminated(frame(spark, [t for _, t in rows], [i for i, _ in rows]), bench).collect()
    assert sorted(((x["doc_id"] or 0, x["text"]) for x in clean)) == sorted([(1, a), (0, b), (4, c)])


def test_names_with_dots_and_repeated_documents(spark):
    r = random.Random(41)
    a, b, item = (" ".join(r.choices(WORDS, k=40)) for _ in range(3))
    rows = [(1, a, 1, 2), (2, a, 3, 4), (None, b, 5, 6), (4, item, 7, 8), (4, item, 7, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` long, __place_ long")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted(map(str, neardup.keep_one(docs).collect())) == sorted(map(str, docs.where("`a.b` in (1, 5, 7)").dropDuplicates().collect()))
    assert decontaminate.drop_contaminated(docs, bench).columns == docs.columns and decontaminate.drop_contaminated(docs, bench).count() == 3
    assert linededup.dedup_lines(docs).count() == 5 and "a.b" in linededup.dedup_lines(docs).columns
    found = {(x["doc_id"], x["n_hit"]) for x in decontaminate.contamination(docs, bench).collect()}
    assert found == {(1, 0), (2, 0), (None, 0), (4, 40)}
    ids = {(x["doc_id"], x["component_id"]) for x in neardup.near_duplicates(docs).collect()}
    assert ids == {(1, 1), (2, 1), (None, None), (4, 4)}
