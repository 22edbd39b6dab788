"""Operator 8: a quality classifier learned from positive and unlabelled texts.

Trusted positives and unlabelled texts alone are used: the model minimises the non-negative
unbiased risk  prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))  with the class prior
estimated from the data. Scores depend on the text alone: on how it is written, and on hashed
counts of its words and word pairs.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm.common import table, text_or_empty
from codequarry.llm.word_hashes import hashed_words, mix64

#: Rows of each of the two samples that the model is fitted to, trusted and unlabelled (any document, labelled or not):
#: those with the least hashes of doc_id. Every document is scored.
SAMPLE = 20_000
STEPS, RATE, DECAY, SEED = 400, 0.05, 1e-4, 8
THRESHOLD = 0.3
#: Measures of how a text is written; buckets of hashed words, and as many of word pairs; the weight of a bucket's measure.
STYLE, BUCKETS, SHRINK = 18, 128, 0.15
FEATURES = STYLE + 2 * BUCKETS


def features(text: str) -> list[float]:
    """Shares and sizes that describe how a text is written, whatever it says."""
    ws = text.split()
    n, chars = len(ws), max(1, len(text))
    if not n:
        return [0.0] * STYLE
    letters = sum(map(str.isalpha, text)) if not text.isascii() else len(text.translate(_LETTERS_ONLY))
    upper = sum(map(str.isupper, text)) if not text.isascii() else len(text.translate(_UPPER_ONLY))
    counts = Counter(ws)
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        math.log1p(n),
        letters / chars,
        upper / max(1, letters),
        sum(text.count(c) for c in "#*$%&|<>") / n,
        text.count("!") / n,
        text.count("|") / n,
        (text.count(".") + text.count(",")) / n,
        sum(text.count(c) for c in "0123456789") / chars,
        len(counts) / n,
        math.log(n) - sum(k * math.log(k) for k in counts.values()) / n,
        max(counts.values()) / n,
        sum(a == b for a, b in zip(ws, ws[1:], strict=False)) / n,
        sum(map(len, ws)) / n / 10,
        sum(w.isalpha() for w in ws) / n,
        sum(w.isupper() for w in ws) / n,
        len(lines) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        (text.count("http") + text.count("@") + text.count("<")) / n,
    ]


_LETTERS_ONLY = {i: None for i in range(128) if not chr(i).isalpha()}
_UPPER_ONLY = {i: None for i in range(128) if not chr(i).isupper()}


def ngrams(texts: list[str]) -> np.ndarray:
    """Shares of each bucket of hashed words and of hashed word pairs in a text, as square roots."""
    h, ends = hashed_words(pa.array(texts, pa.string()))
    text_of = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
    pairs = mix64(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    same = text_of[1:] == text_of[:-1]
    both = []
    for x, of in ((h, text_of), (pairs[same], text_of[1:][same])):
        n = np.bincount(of * BUCKETS + (x % np.uint64(BUCKETS)).astype(np.int64), minlength=len(texts) * BUCKETS).reshape(-1, BUCKETS)
        both.append(np.sqrt(n / np.maximum(n.sum(1, keepdims=True), 1)))
    return np.hstack(both)


def matrix(texts: list[str | None]) -> np.ndarray:
    texts = [t or "" for t in texts]
    out = [np.hstack([np.array([features(t) for t in part], float).reshape(-1, STYLE), ngrams(part)]) for part in (texts[i : i + 500] for i in range(0, len(texts), 500))]
    return np.concatenate(out) if out else np.zeros((0, FEATURES))


class Model:
    """Logistic regression on standardised features, and on the products of those of style."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray):
        self.mean, self.scale, self.weights = mean, scale, weights

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        style = z[:, :STYLE]
        i, j = np.triu_indices(STYLE)
        return np.hstack([np.ones((len(z), 1)), style, style[:, i] * style[:, j] / 6, SHRINK * z[:, STYLE:]])

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.expand(x) @ self.weights, -30, 30)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def gradient(ep: np.ndarray, eu: np.ndarray, w: np.ndarray, prior: float | None) -> np.ndarray:
    """Where the risk rises, without decay, for expanded positives and unlabelled. prior None: positives against unlabelled, as if those were
    negatives. Else the non-negative risk: prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)); once the second part is below zero, it is made to rise."""
    sp, su = _sigmoid(ep @ w), _sigmoid(eu @ w)
    plus = ep.T @ (sp - 1) / len(ep)  # gradient of R_p(+)
    if prior is None:
        return plus + eu.T @ su / len(eu)
    minus, unlabelled = ep.T @ sp / len(ep), eu.T @ su / len(eu)
    loss = lambda s: -np.log(np.maximum(1 - s, 1e-12)).mean()
    rest = loss(su) - prior * loss(sp)
    # Below zero, the risk of negatives is overfitted: step back from it.
    return prior * plus + unlabelled - prior * minus if rest >= 0 else prior * minus - unlabelled


def _descend(model: Model, p: np.ndarray, u: np.ndarray, prior: float | None) -> Model:
    """Adam over the whole samples."""
    ep, eu = model.expand(p), model.expand(u)
    w = np.zeros(ep.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        g = gradient(ep, eu, w, prior) + DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(model.mean, model.scale, w)


def estimate_prior(p: np.ndarray, u: np.ndarray) -> float:
    """The share of positives among unlabelled scores: the least ratio, over the score bins that
    hold a fair part of the positives, of unlabelled to positives at or above a score."""
    cuts = np.quantile(p, np.linspace(0.01, 0.9, 90))
    qp, qu = (p[:, None] >= cuts).mean(0), (u[:, None] >= cuts).mean(0)
    slack = 0.5 * (1 / math.sqrt(len(p)) + 1 / math.sqrt(len(u)))
    best = int(np.argmin((qu + slack) / np.maximum(qp - 0.0, 1e-9)))
    return float(np.clip(qu[best] / qp[best], 0.05, 0.98))


def fit(p: np.ndarray, u: np.ndarray) -> tuple[Model, float]:
    """The model and the estimated prior. Half of each sample finds scores for the prior of the other."""
    if not len(p) or not len(u):
        return Model(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(1 + FEATURES + STYLE * (STYLE + 1) // 2)), 0.5
    both = np.vstack([p, u])
    start = Model(both.mean(0), both.std(0) + 1e-6, np.zeros(0))
    guide = _descend(start, p[::2], u[::2], None)
    prior = estimate_prior(guide.score(p[1::2]), guide.score(u[1::2])) if min(len(p), len(u)) > 1 else 0.5
    return _descend(start, p, u, prior), prior


def train(docs: DataFrame, positives: DataFrame) -> tuple[Model, float]:
    """The model and its prior, fitted to at most SAMPLE trusted documents (doc_ids in ``positives``) and at most SAMPLE of all.

    Null texts are empty and null doc_ids left out; of a doc_id in several rows, the one with the least hash counts; without
    trusted documents, or any at all, each score is 0.5. Columns but doc_id and text are not looked at. Texts are
    measured whole, in a few hundred bytes for each of their words.
    """
    least = lambda df: df.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    ids = least(positives).withColumn("p", F.lit(True)).unionByName(least(docs).withColumn("p", F.lit(False)))
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(ids), "doc_id")
    rows = rows.groupBy("doc_id", "p").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [r.tobytes() for r in matrix(b.column("text").to_pylist()).astype(np.float32)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("p"), pa.array(x, pa.binary())], names=["doc_id", "p", "x"])

    got = rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, p boolean, x binary").toArrow()  # 2 * SAMPLE rows at most, of 4 * FEATURES bytes
    got = got.sort_by([("doc_id", "ascending"), ("p", "ascending"), ("x", "ascending")])
    x, is_p = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float32).reshape(-1, FEATURES), got.column("p").to_numpy()
    return fit(x[is_p].astype(float), x[~is_p].astype(float))


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted of each row. Null texts count as empty, which have a score too; repeated rows are
    scored alike; an empty table gives none; very long texts are scored whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.round(model.score(matrix(b.column("text").to_pylist())), 12)  # the last digits depend on what shares a batch
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int")


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0, F.lit(False))
    positives = table(spark, sf_dir, "labels").where((F.col("quality") == 1) & ~held_out)
    model, _ = train(docs, positives)
    return score_documents(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


QUERIES = {"op8_quality_classifier": op8_quality_classifier}
