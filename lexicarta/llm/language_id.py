"""Operator 4: language identification by error-correcting output codes.

Every language gets a codeword; one binary classifier over hashed byte n-grams
predicts each bit; the language whose codeword costs least under the bits'
logistic losses, each weighted by how well its classifier fits, is chosen, and a
narrow win is flagged as ambiguous.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import spans as S
from .scratch import bounded

#: ASCII letters fold to lower case, other ASCII becomes one blank class; UTF-8 bytes stay.
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
MOST_IDS = 1_000_000


@dataclass
class LanguageModel:
    """Codewords (languages x bits of -1 and 1), bit classifiers and their weights. Fixed size."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray
    buckets: int

    def decode(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language index, score in 0..1, lead over the second) of each feature row."""
        margin = features @ self.weights + self.bias
        loss = np.logaddexp(0.0, -margin[:, None, :] * self.code[None]) * self.trust
        cost = loss.sum(2)
        share = np.exp(cost.min(1, keepdims=True) - cost)
        share /= share.sum(1, keepdims=True)
        best = cost.argmin(1)
        ranked = np.sort(share, axis=1)
        lead = ranked[:, -1] - (ranked[:, -2] if share.shape[1] > 1 else 0.0)
        return best, share[np.arange(len(best)), best], lead


def features(texts: pa.Array, buckets: int) -> np.ndarray:
    """Rows of square roots of relative frequencies of hashed 1- to 3-grams of whole texts."""
    out = np.zeros((len(texts), buckets), np.float32)
    shift = np.uint64(64 - (buckets - 1).bit_length())
    for low, high, data, offsets in S.chunks(texts):
        b = _FOLD[data].astype(np.uint64)
        grams = [b + np.uint64(1 << 24)]
        if len(b) > 1:
            grams.append((b[:-1] << np.uint64(8)) + b[1:] + np.uint64(1 << 25))
        if len(b) > 2:
            grams.append((b[:-2] << np.uint64(16)) + (b[1:-1] << np.uint64(8)) + b[2:])
        slots = [((g * np.uint64(S.BYTE_BASE)) >> shift).astype(np.int32) for g in grams]
        for k in range(high - low):
            a, e = int(offsets[k]), int(offsets[k + 1])
            for n, slot in enumerate(slots):
                if e - n > a:
                    out[low + k] += np.bincount(slot[a : e - n], minlength=buckets)
    total = out.sum(1, keepdims=True)
    return np.sqrt(out / np.maximum(total, 1), out=out)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """Exhaustive code up to 6 languages; beyond, the random code of 10*log2(n) bits with the widest least distance."""
    if n <= 6:
        bits = max(1, (1 << (n - 1)) - 1)
        columns = [[1 if c == 0 else (1 if (k >> (c - 1)) & 1 else -1) for c in range(n)] for k in range(bits)]
        return np.array(columns, np.float64).T.reshape(n, bits)
    rng = np.random.default_rng(seed)
    size = int(np.ceil(10 * np.log2(n)))
    best, widest = None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, size))
        code = code[:, np.abs(code.sum(0)) < n]
        near = ((code.shape[1] - code @ code.T) / 2 + np.eye(n) * size).min()
        if near > widest:
            best, widest = code, near
    return best


def train(labelled: DataFrame, buckets: int = 4096, per_language: int = 400, rounds: int = 400) -> LanguageModel:
    """Fit on a bounded sample: of each language the ``per_language`` documents first by a hash of their id.

    ``labelled`` has ``doc_id, text, lang``; rows with a null among these are left
    out.  What reaches the driver is ``per_language`` feature rows of ``buckets``
    numbers for each language.
    """
    rows = bounded(labelled).select("doc_id", "text", "lang").where("doc_id is not null and text is not null and lang is not null")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = rows.select("doc_id", "lang").withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language).select("doc_id", F.col("lang").alias("label"))

    def featurise(batches):
        for batch in batches:
            x = features(batch.column(0), buckets)
            yield pa.record_batch([batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], ["label", "x"])

    if chosen.count() <= MOST_IDS:  # so many ids fit a broadcast; with more languages the join shuffles
        chosen = F.broadcast(chosen)
    got = rows.join(chosen, "doc_id").select("text", "label").mapInArrow(featurise, "label string, x binary").collect()
    got.sort(key=lambda r: (r[0], r[1]))
    languages = sorted({r[0] for r in got})
    if not languages:
        return LanguageModel([], np.zeros((0, 1)), np.zeros((buckets, 1), np.float32), np.zeros(1), np.ones(1), buckets)
    x = np.frombuffer(b"".join(r[1] for r in got), np.float32).reshape(len(got), buckets)
    label = np.array([languages.index(r[0]) for r in got])
    code = codewords(len(languages))
    target = code[label]
    # single precision throughout: the feature matrix is never copied to doubles
    weights, bias, target = np.zeros((buckets, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32), target.astype(np.float32)
    step, decay, speed = np.float32(8.0), np.float32(1e-4), np.zeros_like(weights)
    for _ in range(rounds):  # gradient descent with momentum on the logistic loss
        margin = np.clip(target * (x @ weights + bias), -50, 50)
        pull = -target / (1 + np.exp(margin)) / np.float32(len(x))
        speed = np.float32(0.9) * speed - step * (x.T @ pull + decay * weights)
        weights += speed
        bias -= step * pull.sum(0) * np.float32(0.1)
    right = np.mean(np.sign(x @ weights + bias) == target, axis=0)
    trust = np.maximum(2 * right - 1, 1e-3)
    return LanguageModel(languages, code, weights, bias, trust / trust.mean(), buckets)


def predict(docs: DataFrame, model: LanguageModel, lead: float = 0.2) -> DataFrame:
    """``doc_id, lang_pred, score, ambiguous`` for every row of ``docs (doc_id, text)``.

    Only the whole text decides.  A null text, one without a letter, or a model
    without languages gives ``und`` with score 0; ``ambiguous`` marks a lead of less
    than ``lead`` over the second language, and ``und``.  Null ids and repeated rows
    stay; other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            for at in range(0, len(texts), 512):
                part = texts.slice(at, 512)
                lettered = [t is not None and any(map(str.isalpha, t)) for t in part.to_pylist()]
                if model.languages:
                    best, score, gap = model.decode(features(part, model.buckets))
                else:
                    best, score, gap, lettered = [0] * len(part), [0.0] * len(part), [0.0] * len(part), [False] * len(part)
                columns = [
                    pa.array([model.languages[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)], pa.string()),
                    pa.array([float(s) if ok else 0.0 for s, ok in zip(score, lettered, strict=True)], pa.float64()),
                    pa.array([not ok or bool(g < lead) for g, ok in zip(gap, lettered, strict=True)], pa.bool_()),
                ]
                yield pa.record_batch([batch.column(0).slice(at, 512), *columns], ["doc_id", "lang_pred", "score", "ambiguous"])

    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")
