"""Quality classifier (operator 2): positive-unlabelled learning.

Trusted positives are documents labelled good, the unlabelled set is web text
without a label; negative labels are never used. The class prior is estimated
from both (best-bin estimate: the smallest ratio of unlabelled to positive mass
above a score threshold, with its confidence width), then an additive model
over binned document statistics minimises the non-negative unbiased risk

    prior * E_p[l(f)] + max(0, E_u[l(-f)] - prior * E_p[l(-f)])

with the logistic loss, whose minimiser is the log-odds of being good, so the
score is a probability. Both samples are bounded (``most`` documents each, by
hash order); scoring is one narrow pass over all whole texts.

Defined cases: a null text counts as empty and gets the score of an empty
text; rows are scored one by one, so repeated rows, null ids and ties keep
their rows; an empty table gives an empty result; without positives or without
unlabelled text every score is the prior (0.5 where unknown). lang, source,
labels and ids are no inputs of a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shipledger.llm.common import fold, labelled_ids, map_arrow, slices, strings
from shipledger.llm.quality_rules import sample_features
from shipledger.llm.textstats import FEATURES, statistics

SAMPLE = 10_000  # documents of each set
FOLDS, HELD = 4, 2
BINS = 16


@dataclass(frozen=True)
class Additive:
    edges: list[np.ndarray]
    weight: np.ndarray  # (features, bins)
    bias: float
    prior: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        b = self.bins(x)
        f = self.bias + self.weight[np.arange(len(self.edges)), b].sum(1)
        return 1 / (1 + np.exp(-f))


def _sigmoid(f: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(f, -40, 40)))


def _descend(bp: np.ndarray, bu: np.ndarray, width: int, prior: float | None, steps: int, l2: float = 1e-4,
             rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Adam on the non-negative risk (``prior``), or on plain positive against
    unlabelled logistic loss (None). Rows are bins of each feature."""
    d = bp.shape[1]
    shift = np.arange(d) * width
    ip, iu = (bp + shift).ravel(), (bu + shift).ravel()
    w, m, v = np.zeros(d * width + 1), np.zeros(d * width + 1), np.zeros(d * width + 1)
    for t in range(1, steps + 1):
        fp = w[:-1][ip].reshape(bp.shape).sum(1) + w[-1]
        fu = w[:-1][iu].reshape(bu.shape).sum(1) + w[-1]
        sp, su = _sigmoid(fp), _sigmoid(fu)
        if prior is None:
            gp, gu = -(1 - sp) / len(fp), su / len(fu)
        else:
            negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
            if negative >= 0:
                gp, gu = (-prior * (1 - sp) - prior * sp) / len(fp), su / len(fu)
            else:  # the estimated negative risk went below zero: step back
                gp, gu = prior * sp / len(fp), -su / len(fu)
        grad = np.append(np.bincount(ip, np.repeat(gp, d), d * width) + np.bincount(iu, np.repeat(gu, d), d * width),
                         gp.sum() + gu.sum())
        grad[:-1] += l2 * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1].reshape(d, width), float(w[-1])


def best_bin_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """Upper estimate of the share of positives among the unlabelled scores."""
    cuts = np.unique(np.quantile(np.concatenate([positive, unlabelled]), np.linspace(0, 1, 201)))
    qp = 1 - np.searchsorted(np.sort(positive), cuts, side="left") / len(positive)
    qu = 1 - np.searchsorted(np.sort(unlabelled), cuts, side="left") / len(unlabelled)
    wide = lambda n: np.sqrt(np.log(4 / delta) / (2 * n))
    fine = qp > 2 * wide(len(positive))
    bound = np.where(fine, (qu + wide(len(unlabelled)) + wide(len(positive))) / np.maximum(qp, 1e-9), np.inf)
    if not fine.any():
        return 0.5
    k = int(bound.argmin())
    return float(np.clip(qu[k] / qp[k], 0.02, 0.98))


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, steps: int = 400) -> Additive:
    """Fit outside the held-out fold."""
    good = labelled_ids(labels, "quality", FOLDS, HELD, most).where("y = 1")
    web = (docs.select(F.col("doc_id").cast("long").alias("doc_id")).where(fold("doc_id", FOLDS) != HELD)
           .join(labels.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_anti")
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).distinct().withColumn("y", F.lit(0)))
    x, y = sample_features(docs, good.unionByName(web))
    p, u = x[y == 1], x[y == 0]
    if not len(p) or not len(u):
        return Additive([np.empty(0)] * len(FEATURES), np.zeros((len(FEATURES), 1)), 0.0, 0.5)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    blank = Additive(edges, np.zeros((len(edges), BINS)), 0.0, 0.5)
    bp, bu = blank.bins(p), blank.bins(u)
    half = np.arange(len(bp)) % 2 == 0, np.arange(len(bu)) % 2 == 0
    priors = []
    for side in (0, 1):  # cross-fitted, so that the prior is read off unseen rows
        hp, hu = half[0] == bool(side), half[1] == bool(side)
        if min(hp.sum(), hu.sum(), (~hp).sum(), (~hu).sum()) == 0:
            continue
        w, b = _descend(bp[hp], bu[hu], BINS, None, 150, l2=1e-3)
        m = Additive(edges, w, b, 0.5)
        priors.append(best_bin_prior(m.score(p[~hp]), m.score(u[~hu])))
    prior = float(np.mean(priors)) if priors else 0.5
    w, b = _descend(bp, bu, BINS, prior, steps)
    return Additive(edges, w, b, prior)


def score(docs: DataFrame, model: Additive) -> DataFrame:
    """One row per document: doc_id, score (probability of being good)."""

    def kernel(batches):
        for b in batches:
            texts = strings(b.column("text"))
            for lo, hi in slices(texts):
                _, x = statistics(texts.slice(lo, hi - lo))
                yield pa.record_batch({"doc_id": b.column("doc_id").slice(lo, hi - lo),
                                       "score": pa.array(model.score(x))})

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), kernel,
                     "doc_id long, score double")
