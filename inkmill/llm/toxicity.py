"""Toxicity by multiple-instance learning.

A document is a bag of sentences (cut at ``. ! ?`` and line ends) and only the bag is labelled. A sentence has
the probability sigmoid(bias + sum of the weights of its words), a document the noisy-or of its
sentences, 1 - prod(1 - p). Weights of hashed words and word prefixes are learned from document labels
by gradient descent on the likelihood of the noisy-or, so credit goes to the sentences that explain the label,
and the same weights then locate them.

It is fitted on at most SAMPLE toxic and 2 * SAMPLE other documents outside the held-out fold, those with the smallest hashes of doc_id
as far as SAMPLE_BYTES go, none of over LONGEST bytes, weighted back to their true shares; every whole text is scored. Which features tell the classes apart is
counted in Spark; the driver gets at most FEATURES of them, and of the sample only the words that have one. Of texts with one doc_id the smallest is sampled,
and samples are sorted, so scores don't depend on how the tables are dealt.

Null and empty texts have no sentence and score 0. Rows that
repeat get equal scores. Without toxic training rows every score is 0; an empty table of documents gives no rows. Null labels and null doc_ids are not learned
from. Of documents only doc_id and text are read, of labels doc_id and toxic, so other columns may have any names. Of equally likely sentences the first is
located. Long texts go in stretches of about CHUNK bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import python_map, stash
from .quality_classifier import HELD_OUT, fold
from .rolling import A, U, chunks, mix

SAMPLE, EPOCHS, RATE, DECAY = 2000, 12, 0.3, 1e-4
SAMPLE_BYTES, LONGEST, FEATURES = 128 << 20, 2 << 20, 50_000
BITS, PREFIXES = 20, (4, 5, 6)
#: A feature is used if it is in that many sample documents, and its rates in toxic and other ones differ by that many standard errors.
LEAST_DOCS, LEAST_Z = 5, 4.0
THRESHOLD = 0.7
CHUNK = 1 << 20
# letters (in lower case), digits and bytes of other alphabets stay; sentence ends become line ends, the rest spaces
_CLASS = bytes(10 if chr(b) in ".!?\n" else b if b >= 128 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))


def _stretches(texts: list[bytes]):
    """(text, start, bytes as classes) of stretches cut between words."""
    for i, t in enumerate(texts):
        at = 0
        while at < len(t):
            end = at + CHUNK
            part = t[at:end].translate(_CLASS)
            if end < len(t):
                gap = max(part.rfind(b" "), part.rfind(b"\n")) + 1
                while not gap:  # a word of over CHUNK bytes
                    more = t[end : end + CHUNK].translate(_CLASS)
                    found = [x for x in (more.find(b" "), more.find(b"\n")) if x >= 0]
                    gap = len(part) + min(found) + 1 if found else len(part) + len(more) if end + CHUNK >= len(t) else 0
                    part, end = part + more, end + CHUNK
                part = part[:gap]
            yield i, at, part
            at += len(part)


def words(texts: list[bytes]):
    """Per chunk of texts: features of words (words x kinds), and of each word its text, the number of its sentence there, its start byte."""
    parts = list(_stretches(texts))
    ended = np.zeros(len(texts), dtype=np.int64)  # sentences of each text so far
    for lo, hi in chunks([len(p[2]) for p in parts], CHUNK):
        some = parts[lo:hi]
        buf = np.frombuffer(b"".join(p[2] + b" " for p in some), dtype=np.uint8)
        off = np.concatenate([[0], np.cumsum([len(p[2]) + 1 for p in some])])
        sep = (buf == 32) | (buf == 10)
        edge = np.flatnonzero(sep[1:] != sep[:-1]) + 1
        if not sep[0]:
            edge = np.concatenate([[0], edge])
        starts, ends = edge[0::2], edge[1::2]
        lines = np.concatenate([[0], np.cumsum(buf == 10)])
        base = np.zeros(len(some), dtype=np.int64)
        for k, (i, _, _) in enumerate(some):
            base[k] = ended[i] - lines[off[k]]
            ended[i] += lines[off[k + 1]] - lines[off[k]]
        if not len(starts):
            continue
        pre = A.prefix(buf)
        kinds = [mix(A.spans(pre, starts, ends))]
        for k in PREFIXES:
            stop = starts + k
            kinds.append(np.where(stop < ends, mix(A.spans(pre, starts, np.minimum(stop, ends)) + U(k)), U(0)))
        feats = (np.stack(kinds, axis=1) & U((1 << BITS) - 1)).astype(np.int32)
        part = np.searchsorted(off, starts, side="right") - 1
        owner, begin = np.array([p[0] for p in some]), np.array([p[1] for p in some])
        yield feats, owner[part], lines[starts] + base[part], starts - off[part] + begin[part]


def _first_of(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.zeros(len(keys[0]), dtype=bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _texts(batch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def _document_counts(batch):
    """(feature, toxic, n): documents of the batch with a feature."""
    y, seen = batch.column("y").to_numpy(), []
    for feats, owner, _, _ in words(_texts(batch)):
        seen.append(np.unique(owner.repeat(feats.shape[1]) << BITS | feats.ravel()))
    if seen:
        both = np.unique(np.concatenate(seen))
        key, n = np.unique((both & ((1 << BITS) - 1)) << 1 | y[both >> BITS], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array((key >> 1).astype(np.int32)), pa.array((key & 1).astype(np.int32)), pa.array(n)], ["feature", "y", "n"])


def informative(sample: DataFrame, n0: int, n1: int) -> np.ndarray:
    """Features that tell toxic from other documents beyond chance; rare ones would only be learned by heart."""
    counts = python_map(sample.select("y", "text"), _document_counts, "feature int, y int, n long").where("feature <> 0")  # 0: words shorter than a prefix
    df = counts.groupBy("feature").agg(F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("d0"), F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("d1"))
    p = (F.col("d0") + F.col("d1")) / (n0 + n1)
    z = F.abs(F.col("d1") / n1 - F.col("d0") / n0) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-12)) * (1 / n0 + 1 / n1))
    rows = df.select("feature", z.alias("z"), (F.col("d0") + F.col("d1")).alias("n")).where((F.col("n") >= LEAST_DOCS) & (F.col("z") >= LEAST_Z)).orderBy(F.desc("z"), "feature").limit(FEATURES).collect()
    out = np.zeros(1 << BITS, dtype=bool)
    out[[r.feature for r in rows]] = True
    return out


def _bagged(usable: np.ndarray):
    """Rows (id, y, sentences, features, sentence of each word) of the words with a usable feature; other features become 0."""

    def scan(batch):
        texts = _texts(batch)
        got: list[list] = [[] for _ in texts]
        sentences = np.zeros(len(texts), dtype=np.int64)
        for feats, owner, line, _ in words(texts):
            feats = np.where(usable[feats], feats, 0)
            for lo, hi in zip(first := _first_of(owner).tolist(), [*first[1:], len(owner)], strict=True):
                i = int(owner[lo])
                got[i].append((feats[lo:hi], line[lo:hi]))
        rows = []
        for i, parts in enumerate(got):
            if not parts:
                continue
            feats, line = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
            _, sentence = np.unique(line, return_inverse=True)
            sentences[i] = sentence.max() + 1
            ok = feats.any(axis=1)
            rows.append((i, feats[ok].astype(np.int32).tobytes(), sentence[ok].astype(np.int32).tobytes()))
        if rows:
            at, feats, sentence = zip(*rows, strict=True)
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("y").take(take), pa.array(sentences[list(at)]), pa.array(feats), pa.array(sentence)], ["id", "y", "n", "feats", "sentence"])

    return scan


def fit(rows: list[tuple[int, int, np.ndarray, np.ndarray]], share: float) -> tuple[np.ndarray, float]:
    """rows: (label, sentences, features (words x kinds), sentence of each word). share: of toxic documents."""
    rng = np.random.default_rng(11)
    theta, bias = np.zeros(1 << BITS, dtype=np.float32), -7.0
    power, bias_power = np.full(1 << BITS, 1e-6, dtype=np.float32), 1e-6
    y = np.array([r[0] for r in rows])
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), 32):
            some = order[lo : lo + 32]
            feats = np.concatenate([rows[i][2] for i in some])
            base, owner, parts = 0, [], []
            for k, i in enumerate(some):
                parts.append(rows[i][3] + base)
                owner.append(np.full(rows[i][1], k))
                base += rows[i][1]
            sentence, owner = np.concatenate(parts), np.concatenate(owner)
            z = np.clip(bias + np.bincount(sentence, theta[feats].sum(axis=1), base), -60, 60)
            p = np.clip(1 / (1 + np.exp(-z)), 1e-9, 1 - 1e-6)
            bag = np.clip(1 - np.exp(np.bincount(owner, np.log1p(-p), len(some))), 1e-6, 1 - 1e-9)
            yb = y[some][owner]
            g = np.where(yb == 1, -(1 - bag[owner]) / bag[owner], 1.0) * p * weight[some][owner]
            flat = feats.ravel()
            seen, at = np.unique(flat, return_inverse=True)
            gw = np.bincount(at, np.repeat(g[sentence], feats.shape[1]), len(seen)) + DECAY * theta[seen]
            power[seen] += (gw * gw).astype(np.float32)
            theta[seen] -= (RATE * gw / np.sqrt(power[seen])).astype(np.float32)
            theta[0] = 0.0  # unused features
            gb = float(g.sum())
            bias_power += gb * gb
            bias -= RATE * gb / np.sqrt(bias_power)
    return theta, bias


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float] | None:
    usable = labels.where(fold(F.col("doc_id")) != HELD_OUT).where("toxic is not null and doc_id is not null")
    share = usable.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    if not share:
        return None

    def ids(where: str, n: int) -> DataFrame:
        return usable.where(where).select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("y")).distinct().orderBy(F.xxhash64("_id"), "_id").limit(n)

    chosen = ids("toxic = 1", SAMPLE).union(ids("toxic = 0", 2 * SAMPLE))  # at most 3 * SAMPLE pairs
    texts = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).where(F.octet_length("text") <= LONGEST)
    sample = stash(texts.groupBy(F.col("_id").alias("id"), "y").agg(F.min("text").alias("text")), "toxic-sample")
    sized = sample.select("id", "y", F.octet_length("text").alias("size")).orderBy(F.xxhash64("id"), "id", "y").collect()  # at most 3 * SAMPLE rows
    last = int(np.searchsorted(np.cumsum([r.size for r in sized]), SAMPLE_BYTES, side="right"))
    order = {(r.id, r.y): i for i, r in enumerate(sized[:last])}
    n1 = sum(y == 1 for _, y in order)
    n0 = len(order) - n1
    if not n1:
        return None
    if last < len(sized):
        sample = sample.join(F.broadcast(docs.sparkSession.createDataFrame(list(order), "id long, y int")), ["id", "y"], "left_semi")
    usable = informative(sample, max(1, n0), n1)
    rows = python_map(sample.select("id", "y", "text"), _bagged(usable), "id long, y int, n long, feats binary, sentence binary").collect()
    kinds = 1 + len(PREFIXES)
    rows = [(r.y, r.n, np.frombuffer(r.feats, dtype=np.int32).reshape(-1, kinds), np.frombuffer(r.sentence, dtype=np.int32)) for r in sorted(rows, key=lambda r: order[r.id, r.y])]
    return fit(rows, share) if any(r[0] == 1 for r in rows) else None


def _scorer(model):
    def scan(batch):
        n = batch.num_rows
        score, top, top_at = np.zeros(n), np.zeros(n), np.full(n, -1, dtype=np.int64)
        found = []
        for feats, owner, line, at in words(_texts(batch)) if model else ():
            first = _first_of(owner, line)
            found.append((owner[first], line[first], at[first], np.add.reduceat(model[0][feats].sum(axis=1, dtype=np.float64), first)))
        if found:
            owner, line, at, z = (np.concatenate([f[k] for f in found]) for k in range(4))
            first = _first_of(owner, line)  # a sentence may go on in the next stretch
            owner, at, z = owner[first], at[first], np.add.reduceat(z, first)
            p = 1 / (1 + np.exp(-np.clip(model[1] + z, -60, 60)))
            score = 1 - np.exp(np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-12)), n))
            last = np.lexsort((-at, p, owner))
            worst = last[np.searchsorted(owner[last], np.unique(owner), side="right") - 1]
            top[owner[worst]], top_at[owner[worst]] = p[worst], at[worst]
        cols = [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32)), pa.array(top), pa.array(top_at)]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "score", "predicted", "worst_score", "worst_start"])

    return scan


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted, and the likeliest sentence's
    probability and start byte (-1 without one)."""
    docs = docs.select("doc_id", "text")
    model = train(docs, labels)
    held = F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out")
    return python_map(docs.select("doc_id", held, "text"), _scorer(model), "doc_id long, held_out boolean, score double, predicted int, worst_score double, worst_start long")
