"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

Labels say toxic or not. Grade 0 is clean; toxic documents are graded 1 to 3 by thirds of the score that a model of
two grades gives them which was fitted without them. One weight vector serves all thresholds:
P(grade >= k) = logistic(w . x - theta_k) with theta_1 < theta_2 < theta_3, and the prediction is the expected grade,
the sum of these over k.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.shared import cut, small_batches

#: Bounds of the fit: labelled documents (those of the smallest hashes of their ids), terms, and documents that a term is in.
FIT_DOCS, FIT_TERMS, TERM_DOCS = 20_000, 4_000, 3
#: Values of terms in the sample's rows that the driver holds, about.
MOST_VALUES = 20_000_000
GRADES, FOLDS = 3, 3
_LETTERS = re.compile(r"[^\W\d_]+")


def terms(text: str | None) -> Counter:
    """Counts of words, and of word beginnings of four and five letters, lower-cased."""
    words = Counter(_LETTERS.findall((text or "").lower()))
    out = Counter(words)
    for w, n in words.items():
        for k in (4, 5):
            if len(w) >= k:
                out[w[:k] + "*"] += n
    return out


@dataclass
class OrdinalModel:
    weights: dict[str, float]
    theta: np.ndarray

    def score(self, text: str | None) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, 3."""
        get, s = self.weights.get, 0.0
        words = Counter(_LETTERS.findall((text or "").lower()))
        heads: Counter = Counter()
        for w, n in words.items():
            if v := get(w):
                s += v * math.log1p(n)
            if len(w) >= 4:
                heads[w[:4] + "*"] += n
                if len(w) >= 5:
                    heads[w[:5] + "*"] += n
        for h, n in heads.items():
            if v := get(h):
                s += v * math.log1p(n)
        return 1 / (1 + np.exp(self.theta - s))


def fit(docs: DataFrame, labels: DataFrame, *, most_docs: int = FIT_DOCS, most_terms: int = FIT_TERMS) -> OrdinalModel:
    """labels: doc_id, toxic (0 or 1; null rows are left out, of repeated ids the greater one counts).

    Without both labels, nothing is toxic. Of rows of one doc_id the least text that isn't null is read, so the sample
    has no more rows than ids.
    """
    # at most most_docs ids, so their broadcast is bounded
    chosen = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_docs)
    found = small_batches(docs).where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    sample = cut(found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                (toxic if y else clean).update(terms(text).keys())
        names = list(toxic | clean)
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([toxic[t] for t in names]), pa.array([clean[t] for t in names])], names=["term", "toxic", "clean"])

    total = dict(map(tuple, sample.groupBy("toxic").count().collect()))
    n1, n0 = sum(v for k, v in total.items() if k), sum(v for k, v in total.items() if not k)
    if not n1 or not n0:
        return OrdinalModel({}, np.full(GRADES, 30.0) + np.arange(GRADES))
    odds = F.log((F.col("toxic") + 0.5) / (n1 + 1.0)) - F.log((F.col("clean") + 0.5) / (n0 + 1.0))
    best = (
        sample.select("text", "toxic")
        .mapInArrow(count, "term string, toxic long, clean long")
        .groupBy("term")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where(F.col("toxic") + F.col("clean") >= TERM_DOCS)
        .orderBy(F.desc(F.abs(odds) * F.sqrt(F.col("toxic") + F.col("clean") * n1 / n0)), "term")
        .limit(most_terms)
        .collect()
    )
    index = {r.term: i for i, r in enumerate(best)}

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = [], []
            for text in b.column(1).to_pylist():
                found = {t: n for t, n in terms(text).items() if t in index}
                at.append([index[t] for t in sorted(found)])
                x.append([math.log1p(found[t]) for t in sorted(found)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at, pa.list_(pa.int32())), pa.array(x, pa.list_(pa.float64())), b.column(2)], names=["doc_id", "at", "x", "toxic"])

    kind = "doc_id " + docs.schema["doc_id"].dataType.simpleString() + ", at array<int>, x array<double>, toxic int"
    made = cut(sample.select("doc_id", "text", "toxic").mapInArrow(vectors, kind))
    # of very long texts fewer rows are taken, those of the smallest hashes: the driver holds MOST_VALUES at most, about
    held = made.agg(F.coalesce(F.sum(F.size("at")), F.lit(0))).first()[0]
    if held > MOST_VALUES:
        made = made.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit((1 << 20) * MOST_VALUES // held))
    rows = made.orderBy("doc_id").select("at", "x", "toxic").toArrow()
    flat = lambda name: rows[name].combine_chunks()
    sizes = np.diff(flat("at").offsets.to_numpy()) if rows.num_rows else np.empty(0, np.int64)
    x = Sparse(np.repeat(np.arange(rows.num_rows), sizes), flat("at").values.to_numpy().astype(np.int64), flat("x").values.to_numpy(), (rows.num_rows, len(index)))
    toxic = rows["toxic"].to_numpy() > 0
    weights, theta = fit_ordinal(x, graded(x, toxic), GRADES)
    return OrdinalModel({w: float(weights[i]) for w, i in index.items() if abs(weights[i]) > 1e-6}, theta)


@dataclass
class Sparse:
    """Values by row and column, in order of the rows."""

    row: np.ndarray
    col: np.ndarray
    val: np.ndarray
    shape: tuple[int, int]

    @classmethod
    def of(cls, at: list[list[int]], x: list[list[float]], width: int) -> Sparse:
        sizes = [len(a) for a in at]
        flat = lambda lists, kind: np.fromiter((v for one in lists for v in one), kind, sum(sizes))
        return cls(np.repeat(np.arange(len(at)), sizes), flat(at, np.int64), flat(x, np.float64), (len(at), width))

    def rows(self, keep: np.ndarray) -> Sparse:
        kept = keep[self.row]
        return Sparse((np.cumsum(keep) - 1)[self.row[kept]], self.col[kept], self.val[kept], (int(keep.sum()), self.shape[1]))

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.val * w[self.col], minlength=self.shape[0])


def graded(x: Sparse, toxic: np.ndarray) -> np.ndarray:
    """0 for clean rows; for toxic ones their third, from 1, by the score of a model of two grades fitted on the other folds."""
    fold, score = np.arange(len(toxic)) % FOLDS, np.zeros(len(toxic))
    for k in range(FOLDS):
        others = fold != k
        if toxic[others].any() and not toxic[others].all():
            weights, _ = fit_ordinal(x.rows(others), toxic[others].astype(int), 1, steps=150)
            score[fold == k] = x.rows(fold == k).times(weights)
    grade, at = np.zeros(len(toxic), dtype=int), np.flatnonzero(toxic)
    # equal scores have equal grades
    below = np.searchsorted(np.sort(score[at]), score[at], "left")
    grade[at] = 1 + below * GRADES // max(1, len(at))
    return grade


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def loss_and_gradient(p: np.ndarray, x: Sparse, grade: np.ndarray, grades: int, ridge: float) -> tuple[float, np.ndarray]:
    """Mean negative log-likelihood with the ridge. p: weights, the first threshold, logarithms of the steps to the others."""
    n, d = x.shape
    theta = np.cumsum(np.concatenate([[p[d]], np.exp(p[d + 1 :])]))
    s = x.times(p[:d])
    # bounds of each row's own interval: up = P(grade >= y), down = P(grade >= y + 1)
    edges = np.concatenate([[-np.inf], theta, [np.inf]])
    up = np.where(grade == 0, 1.0, _sigmoid(s - edges[grade]))
    down = np.where(grade == grades, 0.0, _sigmoid(s - edges[grade + 1]))
    like = np.maximum(up - down, 1e-12)
    gu, gd = up * (1 - up) / like, down * (1 - down) / like
    grad = np.empty_like(p)
    grad[:d] = -np.bincount(x.col, x.val * (gu - gd)[x.row], minlength=d) / n + ridge * p[:d]
    dtheta = np.array([gu[grade == k].sum() - gd[grade == k - 1].sum() for k in range(1, grades + 1)]) / n
    grad[d] = dtheta.sum()
    grad[d + 1 :] = [dtheta[k:].sum() * np.exp(p[d + k]) for k in range(1, grades)]
    return float(-np.log(like).mean() + ridge / 2 * (p[:d] ** 2).sum()), grad


def fit_ordinal(x: Sparse, grade: np.ndarray, grades: int, *, steps: int = 400, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds, by full-batch Adam."""
    d = x.shape[1]
    p = np.concatenate([np.zeros(d), [2.0], np.zeros(grades - 1)])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, steps + 1):
        _, grad = loss_and_gradient(p, x, grade, grades, ridge)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        p -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return p[:d], np.cumsum(np.concatenate([[p[d]], np.exp(p[d + 1 :])]))


def predict(docs: DataFrame, model: OrdinalModel, *, reject_at: float = 0.5) -> DataFrame:
    """All rows and columns of docs with severity (0 to 3), p_toxic and toxic (p_toxic >= reject_at).

    Columns of docs of these names are replaced. The whole text counts; a null or empty text has no terms.
    """

    @F.pandas_udf("severity double, p_toxic double")
    def score(texts):
        import pandas as pd

        p = np.array([model.score(t) for t in texts]).reshape(-1, GRADES)
        return pd.DataFrame({"severity": p.sum(1), "p_toxic": p[:, 0]})

    kept = [c for c in docs.columns if c not in ("severity", "p_toxic", "toxic")]
    return small_batches(docs).select(*kept, score("text").alias("__s")).select(*kept, "__s.severity", "__s.p_toxic", (F.col("__s.p_toxic") >= reject_at).alias("toxic"))
