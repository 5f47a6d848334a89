"""Quality classifier by positive-unlabelled learning.

Non-negative unbiased risk: with class prior p, positives P (trusted, labelled good) and unlabelled web
text U, minimise p * E_P[l(f)] + max(0, E_U[l(-f)] - p * E_P[l(-f)]) for the logistic loss. f is a network of one
hidden layer over text statistics; where the non-negative part falls below zero, its gradient is
reversed, which keeps it from overfitting. The prior is estimated from P and U alone (best bin estimation), and the decision boundary
is where the risk leaves it; labelled negatives are used nowhere.

It is fitted on at most SAMPLE positives and SAMPLE unlabelled documents, those with the smallest
hashes of doc_id, both from outside the held-out fold; every whole text is scored. Of texts with one doc_id the one with the smallest features
is sampled, and samples are sorted, so scores don't depend on how the tables are dealt. Null and empty texts have all statistics zero
and are scored like any other; rows that repeat get equal scores. Without a positive or an unlabelled row all
scores are 0.5; an empty table of documents gives no rows. Null labels and null doc_ids are not learned from. Of documents only doc_id and text are read, of labels
doc_id and quality, so other columns may have any names. Long texts go in stretches of STRETCH bytes.
"""

from __future__ import annotations

import operator
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, python_map

SAMPLE, HIDDEN, STEPS, RATE = 8000, 16, 400, 0.02
#: The bounds of the prior's estimate fail with this probability.
DOUBT = 0.1
FOLDS, HELD_OUT = 3, 1
_UPPER, _LOWER, _DIGIT = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
_SYMBOL, _STOP = b"#*$%&|<>@^~_=+{}[]\\", b".,;:?"
N_FEATURES, STRETCH = 12, 1 << 20
_GAP = re.compile(rb"[ \t-\r]")


def fold(doc_id: Column) -> Column:
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % FOLDS


def _count(data: bytes, chars: bytes) -> int:
    return len(data) - len(data.translate(None, chars))


def stretches(data: bytes, size: int = STRETCH):
    """data in parts of about size bytes, cut before white space."""
    at = 0
    while at < len(data):
        gap = _GAP.search(data, at + size) if len(data) - at > size else None
        end = gap.start() if gap else len(data)
        yield data[at:end]
        at = end


def features(data: bytes) -> tuple[float, ...]:
    size, n, again, last, distinct = len(data), 0, 0, None, set()
    for part in stretches(data):
        words = part.split()
        n += len(words)
        again += sum(map(operator.eq, words, words[1:])) + (bool(words) and words[0] == last)
        last = words[-1] if words else last
        distinct.update(words)
    if not n:
        return (0.0,) * N_FEATURES
    upper, lower = _count(data, _UPPER), _count(data, _LOWER)
    packer = zlib.compressobj(1)
    packed = sum(len(packer.compress(data[lo : lo + STRETCH])) for lo in range(0, size, STRETCH)) + len(packer.flush())
    lines = [x for x in data.split(b"\n") if x.strip(WHITE)]
    return (
        np.log1p(n), (size - n) / n, _count(data, _SYMBOL) / n, upper / (upper + lower + 1), _count(data, b"!") / n,
        again / n, len(distinct) / n, packed / (size + 1), _count(data, _STOP) / n,
        _count(data, _DIGIT) / n, np.log1p(n / max(1, len(lines))), len(set(lines)) / max(1, len(lines)),
    )


def _matrix(batch) -> np.ndarray:
    return np.array([features(t or b"") for t in batch.column("text").cast(pa.binary()).to_pylist()], dtype=np.float64).reshape(-1, N_FEATURES)


def _featured(batch):
    yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(list(_matrix(batch)), pa.list_(pa.float64()))], ["doc_id", "x"])


def forward(x: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    z = np.clip((x - model["mean"]) / model["scale"], -8, 8)
    h = model["b"] + np.zeros((len(z), 1))
    for k in range(N_FEATURES):  # not a matrix product, whose rounding depends on the other rows
        h = h + z[:, k : k + 1] * model["w"][k]
    h = np.tanh(h)
    return h, (h * model["v"]).sum(axis=1) + model["c"]


def _sigmoid(f: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-f))


def descend(x: np.ndarray, slope) -> dict:
    """A network for rows x by Adam; slope(outputs) is the derivative of the risk by each output."""
    rng = np.random.default_rng(7)
    model = {"mean": x.mean(axis=0), "scale": x.std(axis=0) + 1e-6, "w": rng.normal(0, 0.5, (N_FEATURES, HIDDEN)), "b": np.zeros(HIDDEN), "v": rng.normal(0, 0.3, HIDDEN), "c": np.zeros(1)}
    state = {k: (np.zeros_like(model[k]), np.zeros_like(model[k])) for k in ("w", "b", "v", "c")}
    z = np.clip((x - model["mean"]) / model["scale"], -8, 8)
    for step in range(1, STEPS + 1):
        h, f = forward(x, model)
        g = slope(f)
        gh = g[:, None] * model["v"] * (1 - h * h)
        grads = {"v": h.T @ g + 1e-4 * model["v"], "c": g.sum(keepdims=True), "w": z.T @ gh + 1e-4 * model["w"], "b": gh.sum(axis=0)}
        for k, gr in grads.items():
            m, s = state[k]
            m += 0.1 * (gr - m)
            s += 0.001 * (gr * gr - s)
            model[k] = model[k] - RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return model


def estimated_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """The share of positives in unl, from pos and unl alone (best bin estimation): half of both trains a network that tells them apart; on
    the other half, the share of unl over that of pos above a score can only be too large, by the negatives up there. Of all scores the one whose
    ratio has the smallest upper bound is taken."""
    if min(len(pos), len(unl)) < 4:
        return 0.5
    n = len(pos[::2])
    split = np.concatenate([pos[::2], unl[::2]])

    def slope(f):
        s = _sigmoid(f)
        return np.concatenate([(s[:n] - 1) / n, s[n:] / (len(f) - n)])

    model = descend(split, slope)
    p, u = (np.sort(forward(x[1::2], model)[1]) for x in (pos, unl))
    at = np.unique(p)
    over_p, over_u = (1 - np.searchsorted(s, at, side="left") / len(s) for s in (p, u))
    doubt = np.sqrt(np.log(4 / DOUBT) / 2) * (1 / np.sqrt(len(u)) + 1 / np.sqrt(len(p)))
    best = int(np.argmin((over_u + doubt) / over_p))
    return float(np.clip(over_u[best] / over_p[best], 0.01, 0.99))


def fit(pos: np.ndarray, unl: np.ndarray, prior: float) -> dict:
    n, m = len(pos), len(unl)

    def slope(f):
        fp, fu = f[:n], f[n:]
        if np.logaddexp(0, fu).mean() >= prior * np.logaddexp(0, fp).mean():
            return np.concatenate([np.full(n, -prior / n), _sigmoid(fu) / m])
        return np.concatenate([prior * _sigmoid(fp) / n, -_sigmoid(fu) / m])

    return descend(np.concatenate([pos, unl]), slope)


def train(docs: DataFrame, labels: DataFrame) -> tuple[dict | None, float]:
    """(model, prior). Samples are sorted, so the result doesn't depend on how the tables are dealt."""

    def sample(ids: DataFrame) -> np.ndarray:
        chosen = ids.select(F.col("doc_id").alias("_id")).where("_id is not null").distinct().orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE)  # at most SAMPLE longs
        texts = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"), "left_semi")
        each = python_map(texts.select("doc_id", "text"), _featured, "doc_id long, x array<double>").groupBy("doc_id").agg(F.min("x").alias("x"))  # of texts with one doc_id one
        rows = sorted(each.collect(), key=lambda r: r.doc_id)
        return np.array([r.x for r in rows], dtype=np.float64).reshape(-1, N_FEATURES)

    pos = sample(labels.where(fold(F.col("doc_id")) != HELD_OUT).where("quality = 1"))
    unl = sample(docs.where(fold(F.col("doc_id")) != HELD_OUT))
    if not len(pos) or not len(unl):
        return None, 0.5
    prior = estimated_prior(pos, unl)
    return fit(pos, unl, prior), prior


def _scorer(model: dict | None, prior: float):
    def scan(batch):
        if model is None:
            score = np.full(batch.num_rows, prior)
        else:
            score = 1 / (1 + np.exp(-forward(_matrix(batch), model)[1]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return scan


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted."""
    docs = docs.select("doc_id", "text")
    model, prior = train(docs, labels)
    held = F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out")
    return python_map(docs.select("doc_id", held, "text"), _scorer(model, prior), "doc_id long, held_out boolean, score double, predicted int")
