"""Document quality by a linear-chain conditional random field over lines.

Every non-blank line is good or bad. Its features are shares of character classes, word shape and repetition, of the
line itself and of the lines before and after it; a transition weight ties neighbouring labels. The weights maximise
the conditional likelihood of the labelled sample, in which each line bears its document's label. Forward-backward gives each line's marginal; a document's
quality is the mean of its lines' marginals weighted by their length, put through a logistic curve that is calibrated
on documents the field was not trained on.

Fitting takes a bounded sample: about ``SAMPLE`` labelled documents, chosen by a hash of the id, of at most
``SAMPLE_CHARS`` characters. Scoring takes every text whole.

Defined cases: null texts and texts of blank lines have no line and quality 0 before the curve; without labels the
score is 0.5, with one class alone that class's smoothed share; null labels and null ids are not learned from; repeated
labels of an id count once, the larger; every row is kept.
"""

from __future__ import annotations

from math import exp, log1p

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from quillmill.llm import logistic
from quillmill.llm.common import held_out, table, with_outputs
from quillmill.llm.toxicity import labelled_sample

SAMPLE, SAMPLE_CHARS, STEPS, L2 = 3000, 20_000, 100, 1e-3
PREDICT_FROM = 0.7
_CLASSES = ("lower", "upper", "digit", "space", "stop", "pipe", "bang", "symbol", "high")


def _class_table() -> np.ndarray:
    out = np.full(256, _CLASSES.index("symbol"), np.uint8)
    for name, chars in (
        ("lower", range(97, 123)), ("upper", range(65, 91)), ("digit", range(48, 58)), ("space", (9, 10, 11, 12, 13, 32)),
        ("stop", b".,;:'\"?()-"), ("pipe", b"|"), ("bang", b"!"), ("high", range(128, 256)),
    ):
        out[list(chars)] = _CLASSES.index(name)
    return out


_TABLE = _class_table()
N_OWN = len(_CLASSES) + 8


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(features of the non-blank lines with those of their neighbours, lengths of the lines in bytes)."""
    lines = [x for x in (text or "").encode("utf-8", "surrogatepass").split(b"\n") if x.strip()]
    n = len(lines)
    if not n:
        return np.zeros((0, 3 * N_OWN + 1)), np.zeros(0)
    sizes = np.fromiter(map(len, lines), np.int64, n)
    kind = _TABLE[np.frombuffer(b"".join(lines), np.uint8)].astype(np.int64)
    counts = np.bincount(kind + len(_CLASSES) * np.repeat(np.arange(n), sizes), minlength=n * len(_CLASSES)).reshape(n, -1)
    own = np.zeros((n, N_OWN))
    own[:, : len(_CLASSES)] = counts / sizes[:, None]
    seen: set[bytes] = set()
    for i, line in enumerate(lines):
        words = line.split()
        k = len(words)
        own[i, -8] = len(set(words)) / k
        own[i, -7] = line in seen
        own[i, -6] = line.rstrip()[-1:] in b".!?"
        own[i, -5] = min(k, 200) / 100
        own[i, -4] = k < 4
        own[i, -3] = sum(map(len, words)) / k / 10
        own[i, -2] = line[:1].isupper()
        seen.add(line)
    own[:, -1] = np.log1p(sizes) / 10
    near = np.zeros((n, 3 * N_OWN + 1))
    near[:, :N_OWN] = own
    near[1:, N_OWN : 2 * N_OWN] = own[:-1]
    near[:-1, 2 * N_OWN : 3 * N_OWN] = own[1:]
    near[:, -1] = 1
    return near, sizes.astype(float)


def marginals(evidence: np.ndarray, stay: float) -> np.ndarray:
    """P(good) of each line. ``evidence``: log odds of a line for good; ``stay``: log weight of equal neighbours."""
    e, n = np.clip(evidence, -50, 50).tolist(), len(evidence)

    def lse(a: float, b: float) -> float:
        return max(a, b) + log1p(exp(-abs(a - b)))

    ahead, back = [0.0] * n, [0.0] * n
    for i in range(1, n):
        x = ahead[i - 1] + e[i - 1]
        ahead[i] = lse(x + stay, 0.0) - lse(x, stay)
    for i in range(n - 2, -1, -1):
        x = back[i + 1] + e[i + 1]
        back[i] = lse(x + stay, 0.0) - lse(x, stay)
    total = np.clip(np.array(ahead) + np.array(e) + np.array(back), -50, 50)
    return 1 / (1 + np.exp(-total))


def fit_field(docs: list[np.ndarray], labels: list[int], steps: int = STEPS, l2: float = L2) -> tuple[np.ndarray, float]:
    """Weights and transition of the field that maximise the likelihood of all lines of a document having its label."""
    docs, y = [x for x in docs if len(x)], np.array([v for x, v in zip(docs, labels, strict=True) if len(x)], float)
    n, longest = len(docs), max(map(len, docs))
    x = np.concatenate(docs)
    row = np.repeat(np.arange(n), [len(d) for d in docs])
    col = np.concatenate([np.arange(len(d)) for d in docs])
    length = np.array([len(d) for d in docs])
    w, stay = np.zeros(x.shape[1]), 0.5
    m, v, rate = np.zeros(len(w) + 1), np.zeros(len(w) + 1), 0.1
    inside = np.zeros((n, longest), bool)
    inside[row, col] = True
    for t in range(1, steps + 1):
        e = np.zeros((n, longest))
        e[row, col] = np.clip(x @ w, -50, 50)
        up, down = np.zeros((n, longest)), np.zeros((n, longest))  # log odds from the left and from the right
        for i in range(1, longest):
            a = up[:, i - 1] + e[:, i - 1]
            up[:, i] = np.logaddexp(a + stay, 0) - np.logaddexp(a, stay)
        for i in range(longest - 2, -1, -1):
            a = down[:, i + 1] + e[:, i + 1]
            down[:, i] = np.where(i + 1 < length, np.logaddexp(a + stay, 0) - np.logaddexp(a, stay), 0)
        p = 1 / (1 + np.exp(-np.clip(up + e + down, -50, 50)))
        a, b = (up + e)[:, :-1], (e + down)[:, 1:]  # joint of neighbours: good-good, bad-bad against the rest
        same = np.logaddexp(a + b + stay, stay)
        differ = np.logaddexp(a, b)
        agree = 1 / (1 + np.exp(np.clip(differ - same, -50, 50)))
        pairs = inside[:, 1:]
        grad = np.append(x.T @ ((y[row] - p[row, col]) / length[row]) / n - l2 * w, ((1 - agree) * pairs / length[:, None]).sum() / n - l2 * stay)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, stay = w + move[:-1], min(stay + move[-1], 6.0)
    return w, float(stay)


class Model:
    def __init__(self, weights: np.ndarray | None, stay: float, curve: tuple | None = None) -> None:
        self.weights, self.stay, self.curve = weights, stay, curve

    def lines(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Marginals and lengths of a text's lines."""
        x, sizes = line_features(text)
        return (marginals(x @ self.weights, self.stay) if len(x) else np.zeros(0)), sizes

    def quality(self, text: str | None) -> float:
        p, sizes = self.lines(text)
        return float((p * sizes).sum() / sizes.sum()) if len(p) else 0.0

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.curve is None:
            return np.full(len(texts), 0.5)
        if self.weights is None:
            return logistic.predict(self.curve, np.zeros((len(texts), 2)))
        return logistic.predict(self.curve, _shape(np.array([self.quality(t) for t in texts])))


def _shape(q: np.ndarray) -> np.ndarray:
    q = np.asarray(q, float).reshape(-1)
    c = np.clip(q, 1e-4, 1 - 1e-4)
    return np.stack([q, np.log(c / (1 - c))], axis=1)


def fit(documents: list[tuple[str, int]]) -> Model:
    """(text, 0 or 1) -> a model: the field from two thirds of the documents, the curve from the rest."""
    if not documents:
        return Model(None, 0.0)
    part = [d for i, d in enumerate(documents) if i % 3] or documents
    rest = documents[::3]
    labels = [y for _, y in part]
    if len(set(labels)) < 2 or not any((t or "").strip() for t, _ in part):
        return Model(None, 0.0, logistic.fit(np.zeros((len(documents), 2)), np.array([y for _, y in documents], float)))
    model = Model(*fit_field([line_features(t)[0] for t, _ in part], labels))
    model.curve = logistic.fit(_shape([model.quality(t) for t, _ in rest]), np.array([y for _, y in rest], float))
    return model


def score_documents(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``."""

    def make():
        def g(texts):
            p = model.score(texts)
            return p, (p >= PREDICT_FROM).astype(np.int32)

        return g

    return with_outputs(docs, text, docs.columns if keep is None else keep, {"score": "double", "predicted": "int"}, make)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    sample = labelled_sample(docs, labels.where(~held_out("doc_id", 4, 2)), "quality", sample=SAMPLE, chars=SAMPLE_CHARS)
    scored = score_documents(docs, fit(sample), keep=["doc_id"])
    return scored.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", "predicted")
