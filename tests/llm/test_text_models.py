"""Tokens, language, quality, toxicity."""

import hashlib
import os
import random

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillmill.llm import bpe, common, language, logistic, quality, toxicity

TEXTS = [
    None, "", " ", "a", "it's we'll  'S", "a<|endoftext|>b <|endoftext|>", "日本語 テキスト 😀😀", "\x1c a\x85b   c", "x" * 3000, " " * 700 + "y", "ab" * 900,
    "１２３ ⅷ² 12ab", "tab\t\tnew\n\n line \r\n", "The quick brown fox, 42 times!",
]


def docs(spark, texts, **more):
    rows = [(i, t, *(v[i] for v in more.values())) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string" + "".join(f", {c} string" for c in more))


def test_bpe_equals_the_library_and_round_trips():
    library, own, r = Tokenizer.from_file(bpe.TOKENIZER), bpe.load(bpe.TOKENIZER), random.Random(3)
    parts = ["a", "b", " ", "\n", "'s", "é", "the", "'", ".", "1", "ing", " <|endoftext|>", "😀", "\t", "thethethe", "aaaa"]
    for t in [x or "" for x in TEXTS] + ["".join(r.choices(parts, k=r.randint(0, 40))) for _ in range(500)]:
        expected = library.encode(t, add_special_tokens=False).ids
        ids, decimal = own.encode(t)
        assert ids.tolist() == expected
        assert decimal == ",".join(map(str, expected))
        assert own.decode(ids) == library.decode(expected, skip_special_tokens=False) == t


def test_bpe_compatibility_is_what_merging_gives():
    own = bpe.load(bpe.TOKENIZER)
    for word in ("the", "ing", "hello", "aaaaaaa", "zzqxj", " worthless"):
        ids = own.encode_word(word)
        back = {int(p): i for i, p in enumerate(own.public)}
        assert all(own.compatible(back[a], back[b]) for a, b in zip(ids, ids[1:], strict=False))


def test_bpe_longest_tokens_and_kept_pairs():
    own = bpe.load(bpe.TOKENIZER)
    text = " the worthlessness of thing\n\n\n éçmenté 語😀 aaaaaaaaaaaaaaaa zq".encode()
    vocab = {own.buffer[own.offsets[i] : own.offsets[i + 1]].tobytes(): i for i in own.public.tolist()}
    for raw in (text, text[:1], text[-2:], b"", b"th", bytes(range(256))):
        want = [max((raw[i:j] for j in range(i + 1, len(raw) + 1) if raw[i:j] in vocab), key=len) for i in range(len(raw))]
        assert own.public[own.longest(np.frombuffer(raw, np.uint8))].tolist() == [vocab[x] for x in want]
    own.encode("what is known of two tokens side by side stays when pieces are forgotten")
    known = int((own.pair_of >= 0).sum())
    own.forget()
    assert known and int((own.pair_of >= 0).sum()) == known and not own.memo


def test_bpe_over_frames(spark):
    df = docs(spark, [*TEXTS, "a"], k=["x"] * (len(TEXTS) + 1), ids=["y"] * (len(TEXTS) + 1))
    got = {r["doc_id"]: r for r in bpe.token_digests(df, bpe.TOKENIZER).collect()}
    assert len(got) == len(TEXTS) + 1
    assert got[0]["n_tokens"] == 0 and got[0]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    back = bpe.decode_documents(bpe.encode_documents(df, bpe.TOKENIZER), bpe.TOKENIZER).collect()
    assert {r["doc_id"]: r["text"] for r in back} == {i: t or "" for i, t in enumerate([*TEXTS, "a"])}
    assert bpe.token_digests(df.limit(0), bpe.TOKENIZER).count() == 0


ENGLISH = ["the cat and the dog were in the house with this thing", "that is what they said there when the rain was over"]
GERMAN = ["der hund und die katze sind nicht in dem haus gewesen", "ich habe das nicht gesehen weil sie auch noch schlief"]


def test_language_learns_and_predicts(spark):
    texts = (ENGLISH + GERMAN) * 5 + [None, "", "123 !?", "Das ist nicht der Hund", "this was the thing"]
    lang = (["en", "en", "de", "de"]) * 5 + ["en", None, None, None, None]
    df = docs(spark, texts, lang=lang, score=["x"] * len(texts))
    profiles = language.learn_profiles(df)
    got = {r["doc_id"]: r for r in language.identify(df, profiles).collect()}
    assert [got[i]["lang_pred"] for i in range(20, 25)] == ["und", "und", "und", "de", "en"]
    assert got[20]["score"] == 0 and all(0 <= r["score"] <= 1 for r in got.values())
    assert language.learn_profiles(df.limit(0)) == {}
    assert {r["lang_pred"] for r in language.identify(df, {}).collect()} == {"und"}


def test_language_distance_by_brute_force():
    text, size = "Das ist nicht der Hund, der Hund!", 12
    codes, counts = language.ngram_counts(text)
    own = language.ranked(codes, counts, size).tolist()
    words = "".join(c if c.isalpha() else "_" for c in text.lower())
    words = "_" + "_".join(w for w in words.split("_") if w) + "_"
    seen = {}
    for n in (1, 2, 3):
        for i in range(len(words) - n + 1):
            g = words[i : i + n]
            if g != "_" and not (n == 3 and g[1] == "_"):
                seen[g] = seen.get(g, 0) + 1
    code = lambda g: int("".join(f"{1 if c == '_' else ord(c):021b}" for c in g), 2)
    assert dict(zip(codes.tolist(), counts.tolist(), strict=True)) == {code(g): n for g, n in seen.items()}
    assert own == [code(g) for g in sorted(seen, key=lambda g: (-seen[g], code(g)))[:size]]


GOOD = "The house was old and the garden around it had grown wild.\nNobody lived there any more, they said."
BAD = "BUY!! NOW!! CHEAP!! PILLS!!\n$$$ *** $$$ ### buy buy buy buy buy"


def test_quality_orders_good_over_bad(spark):
    sample = [(GOOD + f" {i}", 1) for i in range(30)] + [(BAD + f" {i}", 0) for i in range(30)]
    random.Random(1).shuffle(sample)
    model = quality.fit(sample)
    good, bad, empty = model.score([GOOD, BAD, None])
    assert good > 0.7 > bad and empty <= 0.7
    df = docs(spark, [GOOD, BAD, None, "", "\n\n", GOOD, "a" * 50_000], score=["x"] * 7)
    rows = quality.score_documents(df, model).collect()
    assert len(rows) == 7 and all(0 <= r["score"] <= 1 for r in rows)


@pytest.mark.parametrize("sample", [[], [(GOOD, 1)], [(GOOD, 1), (GOOD, 1)], [("", 0), ("x", 1)]])
def test_models_of_poor_samples(sample):
    for fit in (quality.fit, toxicity.fit):
        model = fit(sample)
        assert model is not None


def test_marginals_by_brute_force():
    e, stay = np.array([0.3, -1.2, 0.5, 2.0]), 0.8
    total, good = 0.0, np.zeros(4)
    for labels in np.ndindex(2, 2, 2, 2):
        w = np.exp(sum(x for x, y in zip(e, labels, strict=True) if y) + stay * sum(a == b for a, b in zip(labels, labels[1:], strict=False)))
        total += w
        good += w * np.array(labels)
    assert np.allclose(quality.marginals(e, stay), good / total)


def plain_and_bad(seed=5):
    r, syllables = random.Random(seed), ["lo", "ra", "mi", "te", "no", "sa", "ku", "re"]
    plain = lambda: " ".join("".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(60))
    bad = lambda: " ".join(w if r.random() > 0.08 else r.choice(["wretch", "numskull"]) + r.choice(["", "ra", "mi"]) for w in plain().split())
    sample = [(plain(), 0) for _ in range(300)] + [(bad(), 1) for _ in range(120)]
    r.shuffle(sample)
    return plain, bad, sample


def test_toxicity_learns_and_flags(spark):
    plain, bad, sample = plain_and_bad()
    model = toxicity.fit(sample)
    texts = [plain(), bad(), None, "", "x" * 20_000, "?!", bad()]
    df = docs(spark, texts, score=["x"] * 7, row=["y"] * 7, predicted=["z"] * 7)
    got = {x["doc_id"]: x for x in toxicity.score_documents(df.unionByName(df.where("doc_id = 1")), model).collect()}
    assert got[1]["score"] > got[0]["score"] and got[6]["score"] > got[0]["score"] and got[2]["predicted"] == 0
    many = toxicity.score_documents(docs(spark, [plain() for _ in range(100)] + [bad() for _ in range(100)]), model).collect()
    flagged = [sum(r["predicted"] for r in many if (r["doc_id"] >= 100) == toxic) for toxic in (False, True)]
    assert flagged[0] <= 10 and flagged[1] >= 90, flagged
    assert got[2]["score"] == got[3]["score"] == got[5]["score"] and got[1]["row"] == "y"
    assert toxicity.score_documents(df.unionByName(df.where("doc_id = 1")), model).count() == 8
    assert toxicity.score_documents(df.limit(0), model).count() == 0


def test_toxicity_fitted_in_tasks_is_the_same(spark):
    _, _, sample = plain_and_bad(8)
    rows = [(i / len(sample), i, t, y) for i, (t, y) in enumerate(sample)]
    frame = spark.createDataFrame(rows, "h double, key long, t string, y int").repartition(5)
    model, other = toxicity.fit(sample), toxicity.fit_in_tasks(frame)
    assert (model.ordinary, model.toxic) == (other.ordinary, other.toxic)
    texts = [t for t, _ in sample[:40]]
    scores = [[r["score"] for r in toxicity.score_documents(docs(spark, texts), m).orderBy("doc_id").collect()] for m in (model, other)]
    assert np.allclose(*scores)
    for few in (frame.limit(0), frame.where("key = 0"), frame.where("key < 2")):
        assert toxicity.fit_in_tasks(few).toxic == toxicity.fit([(r["t"], r["y"]) for r in few.orderBy("h").collect()]).toxic


def test_toxic_dictionary_keeps_what_toxic_documents_share():
    r = random.Random(12)
    word = lambda: "".join(r.choices("aeioulmnrst", k=r.randint(3, 9)))
    plain = lambda: " " + " ".join(word() for _ in range(9)) + " "
    bad = lambda: " ".join(["", *(word() for _ in range(4)), "utter wretched numskull", *(word() for _ in range(3)), ""])
    toxic = [[x.encode() for x in [bad() for _ in range(30)] + [plain() for _ in range(30)]] for _ in range(3)]
    model = toxicity.train(toxic, [[plain().encode() for _ in range(400)] for _ in range(3)])
    shared = [w for fold in toxic for w in fold if b"numskull" in w]
    other = [w for fold in toxic for w in fold if b"numskull" not in w]
    assert all(w in model.toxic for w in shared) and sum(w in model.toxic for w in other) < 0.2 * len(other)


def test_toxicity_by_brute_force():
    """Windows, lengths, gains and the score again, from the two dictionaries and the curve alone."""
    plain, bad, sample = plain_and_bad(6)
    model = toxicity.fit(sample)
    assert model.toxic and model.ordinary

    def size(content, window):
        shape = zstandard.ZstdCompressionParameters(window_log=22, chain_log=22, hash_log=20, search_log=5, min_match=4, target_length=16, strategy=zstandard.STRATEGY_LAZY2, write_content_size=0)
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(compression_params=shape)
        return len(zstandard.ZstdCompressor(dict_data=held, compression_params=shape).compress(window))

    gains = model.gains()
    for text in (plain(), bad(), "Some Other, text! 12 words", ""):
        words, windows, now = "".join(c if c.isalpha() and c.isascii() else " " for c in text.title()).split(), [], []
        for w in words:
            now.append(w)
            if len(" ".join(now)) >= 64:
                windows.append(f" {' '.join(now)} ".encode())
                now = []
        windows += [f" {' '.join(now)} ".encode()] if now else []
        assert toxicity.windows(toxicity.normal(text)) == windows
        g = [size(model.ordinary, w) - size(model.toxic + model.ordinary, w) for w in windows]
        assert gains(windows).tolist() == g
        n, total, two, four = max(len(g), 1), sum(max(x, 0) for x in g), sum(x >= 2 for x in g), sum(x >= 4 for x in g)
        x = np.array([np.log1p(two), np.log1p(four), np.log1p(total), (two / n) ** 0.5, (total / n) ** 0.5])
        w, mean, scale = model.curve
        assert np.isclose(1 / (1 + np.exp(-np.clip((x - mean) / scale @ w[:-1] + w[-1], -30, 30))), logistic.predict(model.curve, np.array([toxicity.features(np.array(g, float))]))[0])


def held_out_rows(spark, label, buckets, bucket):
    """(texts to learn from, held-out texts and labels) of the largest given tables."""
    folder = "/root/testdata/sf0.1"
    if not os.path.exists(folder):
        pytest.skip("needs the given tables")
    docs_, labels = common.table(spark, folder, "documents").select("doc_id", "text"), common.table(spark, folder, "labels")
    out = common.held_out("doc_id", buckets, bucket)
    rows = docs_.where(out).join(labels.where(F.col(label).isNotNull()), "doc_id").select("text", label).collect()
    return toxicity.labelled_sample(docs_, labels.where(~out), label), [r[0] for r in rows], np.array([r[1] for r in rows])


def auc(score, y):
    values, at, n = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - (n - 1) / 2)[at]
    return (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


def test_toxicity_on_held_out_rows(spark):
    """A quarter of the toxic rows there hold no word that ordinary ones lack, or one of a language with few such rows."""
    sample, texts, y = held_out_rows(spark, "toxic", 5, 0)
    model = toxicity.fit(sample)
    gains = model.gains()
    p = logistic.predict(model.curve, np.array([toxicity.features(gains(toxicity.windows(toxicity.normal(t)))) for t in texts]))
    print(f"toxicity: AUC {auc(p, y):.3f}, recall {(p[y == 1] >= 0.5).mean():.3f}, false alarms {(p[y == 0] >= 0.5).mean():.4f}, {len(y)} rows")
    assert auc(p, y) >= 0.8 and (p[y == 1] >= 0.5).mean() >= 0.5 and (p[y == 0] >= 0.5).mean() <= 0.02


def test_quality_on_held_out_rows(spark):
    sample, texts, y = held_out_rows(spark, "quality", 4, 2)
    p = quality.fit(sample[: quality.SAMPLE]).score(texts)
    print(f"quality: AUC {auc(p, y):.4f}, {len(y)} rows")
    assert auc(p, y) >= 0.98


def test_quality_by_brute_force():
    """A document's score from features, all labellings of its lines, lengths and the curve."""
    sample = [(GOOD + f" {i}", 1) for i in range(30)] + [(BAD + f" {i}", 0) for i in range(30)]
    random.Random(1).shuffle(sample)
    model = quality.fit(sample)
    text = GOOD + "\n\n" + BAD + "\n  \nThe end."
    lines = [x for x in text.encode().split(b"\n") if x.strip()]
    own = []
    for i, line in enumerate(lines):
        kinds = {"upper": 0, "lower": 0}
        kinds["upper"], kinds["lower"] = (sum(lo <= c <= hi for c in line) / len(line) for lo, hi in ((65, 90), (97, 122)))
        words = line.split()
        own.append((kinds["lower"], kinds["upper"], len(set(words)) / len(words), line in lines[:i], len(words) < 4))
    x, sizes = quality.line_features(text)
    k = quality.N_OWN
    assert np.allclose(x[:, [0, 1, k - 8, k - 7, k - 4]], np.array(own, float))
    assert np.allclose(x[1:, k : 2 * k], x[:-1, :k]) and np.allclose(x[:-1, 2 * k : 3 * k], x[1:, :k]) and sizes.tolist() == [len(b) for b in lines]
    e, total, good = np.clip(x @ model.weights, -50, 50), 0.0, np.zeros(len(lines))
    for labels in np.ndindex(*(2,) * len(lines)):
        w = np.exp(sum(v for v, z in zip(e, labels, strict=True) if z) + model.stay * sum(a == b for a, b in zip(labels, labels[1:], strict=False)))
        total, good = total + w, good + w * np.array(labels)
    q = float((good / total * sizes).sum() / sizes.sum())
    assert np.isclose(model.quality(text), q)
    c = min(max(q, 1e-4), 1 - 1e-4)
    assert np.isclose(model.score([text])[0], logistic.predict(model.curve, np.array([[q, np.log(c / (1 - c))]]))[0])


def test_quality_of_odd_tables(spark):
    sample = [(GOOD + f" {i}", 1) for i in range(30)] + [(BAD + f" {i}", 0) for i in range(30)]
    model = quality.fit(sample)
    df = docs(spark, [GOOD, BAD], row=["x", "y"], predicted=["x", "y"])
    twice = df.unionByName(df)
    assert quality.score_documents(twice, model).count() == 4 and quality.score_documents(df.limit(0), model).count() == 0
    assert {r["row"] for r in quality.score_documents(twice, model).collect()} == {"x", "y"}


def test_language_prediction_by_brute_force(spark):
    """Profiles, ranks, out-of-place distances and the score from strings alone."""
    texts, langs = (ENGLISH + GERMAN) * 3 + ["Das war ein Haus", "the cat is in the hat", "xyz"], (["en", "en", "de", "de"] * 3) + [None] * 3
    df = docs(spark, texts, lang=langs)
    size = 25

    def counted(t):
        w = "_" + "_".join("".join(c if c.isalpha() else "_" for c in t.lower()).replace("_", " ").split()) + "_"
        seen = {}
        for n in (1, 2, 3):
            for i in range(len(w) - n + 1):
                g = w[i : i + n]
                if g != "_" and not (n == 3 and g[1] == "_"):
                    seen[g] = seen.get(g, 0) + 1
        return seen

    def ranks(seen):
        code = lambda g: int("".join(f"{1 if c == '_' else ord(c):021b}" for c in g), 2)
        return sorted(seen, key=lambda g: (-seen[g], code(g)))[:size]

    profiles = {}
    for name in ("de", "en"):
        total = {}
        for t, x in zip(texts, langs, strict=True):
            for g, n in counted(t).items() if x == name else ():
                total[g] = total.get(g, 0) + n
        profiles[name] = ranks(total)
    got = {r["doc_id"]: r for r in language.identify(df, language.learn_profiles(df, size=size), size=size).collect()}
    for i, t in enumerate(texts):
        own, far = ranks(counted(t)), {}
        for name, profile in profiles.items():
            far[name] = sum(abs(profile.index(g) - k) if g in profile else size for k, g in enumerate(own))
        best = min(sorted(far), key=far.get)
        other = max(far.values()) if len(set(far.values())) > 1 else far[best]
        assert got[i]["lang_pred"] == best and np.isclose(got[i]["score"], other / (other + far[best]))


def test_bpe_of_long_texts():
    library, own, r = Tokenizer.from_file(bpe.TOKENIZER), bpe.load(bpe.TOKENIZER), random.Random(8)
    long = ["".join(r.choices(["lorem", " ipsum", "Dol", "é", "\n", " ", "12", "."], k=60_000)), "z" * 50_000, "語" * 20_000]
    assert [x.tolist() for x in own.encode_all([*long, None, ""])] == [library.encode(t, add_special_tokens=False).ids for t in [*long, "", ""]]


def test_labelled_sample(spark):
    df = docs(spark, ["a", "b", None, "d"])
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, None), (None, 1), (3, 0)], "doc_id long, toxic int")
    assert sorted(toxicity.labelled_sample(df.unionByName(df), labels, "toxic")) == [("a", 1), ("d", 0)]
