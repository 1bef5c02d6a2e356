"""Quality of documents from a linear-chain conditional random field over their lines.

Every line is good or bad. A line's score comes from its own features and those of the lines beside it, a
transition score from its neighbour's label; forward-backward marginals, weighted by the lines' lengths,
make up the document's score. Lines are trained with their document's label.
"""

from __future__ import annotations

import math
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terralume.llm.common import bounded, sliced
from terralume.llm.quality_rules import STOP_WORDS
from terralume.llm.toxicity import training_rows

#: Labelled documents that train the field, about (chosen by hash from all labelled rows).
TRAIN_ROWS = 6000
STEPS, RATE, PENALTY = 250, 0.08, 1e-3
THRESHOLD = 0.7

_STOPS = frozenset(STOP_WORDS)
OWN = 16
WIDTH = 3 * OWN + 1


def line_features(line: str, seen: set) -> list[float]:
    """OWN numbers from 0 to about 1; seen: the document's lines before."""
    words = line.split()
    n = len(words)
    if not n:
        return [0.0] * OWN
    lower = [w.lower() for w in words]
    distinct = len(set(words))
    again = line in seen
    seen.add(line)
    triples = set(zip(words, words[1:], words[2:]))
    chars = len(line)
    return [
        1.0,
        math.log1p(n) / 8,
        min(1.0, chars / n / 20),
        min(1.0, sum(map(line.count, "#*$%&<>")) / n),
        min(1.0, line.count("|") / n),
        min(1.0, line.count("!") / n),
        float(line.isupper()),
        distinct / n,
        sum(map(eq, words, words[1:])) / n,
        1 - len(triples) / max(1, n - 2) if n > 2 else 0.0,
        float(again),
        len(_STOPS.intersection(lower)) / max(1, distinct),
        sum(w in _STOPS for w in lower) / n,
        float(line.rstrip()[-1] in ".!?"),
        float(any(c.isdigit() for c in line[:1] + line[-1:])),
        min(1.0, max(map(len, words)) / 40),
    ]


def document_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(lines, WIDTH) features with those of the neighbours, and the lines' lengths. Blank lines don't count; a text without others is one blank line."""
    seen: set = set()
    lines = [x for x in text.split("\n") if x.strip()] or [""]
    own = np.array([line_features(x, seen) for x in lines])
    none = np.zeros((1, OWN))
    return np.hstack([own, np.vstack([none, own[:-1]]), np.vstack([own[1:], none]), np.ones((len(own), 1))]), np.array([max(1, len(x)) for x in lines], float)


def forward_backward(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray):
    """Marginals (documents, lines) of label 1, pair marginals' sum (2, 2) and the log-partition sum.

    scores (documents, lines): of label 1 against 0; lengths: lines of each document; transitions (2, 2).
    """
    d, n = scores.shape
    emit = np.stack([np.zeros_like(scores), scores], -1)
    valid = np.arange(n) < lengths[:, None]
    alpha = np.zeros((d, n, 2))
    beta = np.zeros((d, n, 2))
    alpha[:, 0] = emit[:, 0]
    for t in range(1, n):
        alpha[:, t] = np.logaddexp(alpha[:, t - 1, None, 0] + transitions[0], alpha[:, t - 1, None, 1] + transitions[1]) + emit[:, t]
    for t in range(n - 2, -1, -1):
        nxt = emit[:, t + 1] + beta[:, t + 1]
        b = np.logaddexp(nxt[:, 0, None] + transitions[:, 0], nxt[:, 1, None] + transitions[:, 1])
        beta[:, t] = np.where(valid[:, t + 1, None], b, 0.0)
    last = alpha[np.arange(d), lengths - 1]
    z = np.logaddexp(last[:, 0], last[:, 1])
    diff = alpha[..., 1] + beta[..., 1] - alpha[..., 0] - beta[..., 0]
    marginal = np.where(valid, 1 / (1 + np.exp(-np.clip(diff, -500, 500))), 0.0)
    pair = np.zeros((2, 2))
    if n > 1:
        nxt = emit[:, 1:] + beta[:, 1:]
        for i in range(2):
            for j in range(2):
                pair[i, j] = np.exp(np.where(valid[:, 1:], alpha[:, :-1, i] + transitions[i, j] + nxt[..., j] - z[:, None], -np.inf)).sum()
    return marginal, pair, z.sum()


def _groups(sizes: list[int], cells: int = 1 << 18):
    """Indices of documents in groups of similar length, so that padding stays small."""
    order = sorted(range(len(sizes)), key=lambda i: sizes[i])
    group: list[int] = []
    for i in order:
        if group and (sizes[i] * (len(group) + 1) > cells or sizes[i] > 2 * sizes[group[0]] + 8):
            yield group
            group = []
        group.append(i)
    if group:
        yield group


def _padded(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(x) for x in docs])
    out = np.zeros((len(docs), lengths.max(), docs[0].shape[1]))
    for i, x in enumerate(docs):
        out[i, : len(x)] = x
    return out, lengths


def fit(docs: list[np.ndarray], labels: np.ndarray) -> dict:
    """Weights and transitions by Adam on the documents' mean conditional log-likelihood a line."""
    w, trans = np.zeros(WIDTH), np.zeros((2, 2))
    packs = [(*_padded([docs[i] for i in g]), labels[g].astype(float)) for g in _groups([len(x) for x in docs])]
    lines = sum(len(x) for x in docs)
    theta = np.zeros(WIDTH + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        w, trans = theta[:WIDTH], theta[WIDTH:].reshape(2, 2)
        g = np.zeros_like(theta)
        for x, lengths, y in packs:
            marginal, pair, _ = forward_backward(x @ w, lengths, trans)
            valid = np.arange(x.shape[1]) < lengths[:, None]
            g[:WIDTH] += np.einsum("dl,dlf->f", np.where(valid, marginal - y[:, None], 0.0), x)
            seen = np.zeros((2, 2))
            seen[1, 1], seen[0, 0] = ((lengths - 1) * y).sum(), ((lengths - 1) * (1 - y)).sum()
            g[WIDTH:] += (pair - seen).ravel()
        g = g / max(1, lines) + PENALTY * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return {"w": theta[:WIDTH], "transitions": theta[WIDTH:].reshape(2, 2)}


def score_texts(texts: list[str], model: dict) -> list[float]:
    """Length-weighted means of the lines' marginals."""
    made = [document_features(t) for t in texts]
    out = [0.0] * len(texts)
    for g in _groups([len(x) for x, _ in made]):
        x, lengths = _padded([made[i][0] for i in g])
        marginal, _, _ = forward_backward(x @ model["w"], lengths, model["transitions"])
        for row, i in zip(marginal, g):
            weight = made[i][1]
            out[i] = float(min(1.0, max(0.0, row[: len(weight)] @ weight / weight.sum())))
    return out


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", rows: int = TRAIN_ROWS) -> dict:
    """A field from a bounded sample of labelled documents; without labels every line is even."""

    def features(batches):
        for b in batches:
            made = [document_features(t)[0].astype(np.float32) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in made], pa.binary()), b.column(1)], names=["x", "label"])

    sample = training_rows(bounded(docs), labels, column, rows).mapInArrow(features, "x binary, label int").toArrow()
    if not len(sample):
        return {"w": np.zeros(WIDTH), "transitions": np.zeros((2, 2))}
    rows = sorted(zip(sample["label"].to_pylist(), sample["x"].to_pylist()))
    return fit([np.frombuffer(x, np.float32).reshape(-1, WIDTH).astype(np.float64) for _, x in rows], np.array([int(y == 1) for y, _ in rows]))


def with_score(docs: DataFrame, model: dict, name: str = "score") -> DataFrame:
    """The columns given, text among them, and a score from 0 to 1.

    A null text scores as an empty one, very long ones are read whole, repeated rows stay, and no documents give no
    rows. A column of the score's name is replaced.
    """
    docs = docs.drop(name)
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for b in sliced(batches, at):
            scores = score_texts([t or "" for t in b.column(at).to_pylist()], held.value)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], names=[*b.schema.names, name])

    return bounded(docs).mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))
