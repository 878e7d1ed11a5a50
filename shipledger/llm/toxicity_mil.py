"""Toxicity (operator 3): multiple-instance learning over sentences.

A document is a bag of sentences. A sentence's score is a logistic model over
its distinct words; the document's is the noisy-or, 1 - prod(1 - p_s). Weights
are learned from document labels only, by gradient descent on the noisy-or
likelihood; the sentences that offend are then those whose own score passes a
threshold.

Training: at most ``most`` labelled documents of each class (hash order).
Words are counted per class with Spark over that sample; every word of three
documents or more whose class rates differ by more than ``LEAST_Z`` standard
errors enters the model, and every weight fitted is served. What the driver
receives is bounded by the sample. Scoring is one narrow pass over all whole
texts.

Words: runs of ASCII letters, digits and non-ASCII characters, lower-cased.
Sentences: pieces between ``. ! ?`` or line breaks that hold a word.

Defined cases: a null or empty text is a bag without sentences, score 0; rows
are scored one by one, so repeated rows, null ids and ties keep their rows; an
empty table gives an empty result; without labels of both classes every score
is 0. lang, source, labels and ids are no inputs of a score.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shipledger.llm.common import join_small, keep_rows, labelled_ids, map_arrow, strings

SAMPLE = 6_000
LEAST_Z = 3
FOLDS, HELD = 3, 1

_SENTENCE = re.compile(rb"[.!?\n]+")
_BLANK = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def sentences(text: str) -> list[tuple[int, int, set[bytes]]]:
    """(start, end, distinct words) of each sentence, in UTF-8 bytes of the
    lower-cased text."""
    data = text.lower().encode("utf-8", "replace")
    out, at = [], 0
    for m in [*_SENTENCE.finditer(data), None]:
        end = m.start() if m else len(data)
        if end > at and (words := set(data[at:end].translate(_BLANK).split())):
            out.append((at, end, words))
        at = m.end() if m else at
    return out


@dataclass(frozen=True)
class Bags:
    weight: dict[bytes, float]
    bias: float

    def judge(self, text: str) -> tuple[float, int, list[tuple[int, float]]]:
        """Score, number of sentences, and (sentence, score) of those with a
        weighted word."""
        data = text.lower().encode("utf-8", "replace")
        known, weight = self.weight.keys(), self.weight
        plain, hits, n = 0, [], 0
        for piece in _SENTENCE.split(data):
            words = piece.translate(_BLANK).split()
            if not words:
                continue
            found = known & words
            if found:
                hits.append((n, self.bias + sum(sorted(weight[w] for w in found))))
            else:
                plain += 1
            n += 1
        log_none = -plain * math.log1p(math.exp(self.bias))
        scored = []
        for k, z in hits:
            log_none -= max(z, 0) + math.log1p(math.exp(-abs(z)))
            scored.append((k, 1 / (1 + math.exp(-z)) if z > -700 else 0.0))
        return -math.expm1(log_none), n, scored


NONE = Bags({}, -1000.0)


def _log1pexp(z):
    return np.logaddexp(0, z)


def fit_weights(bag: np.ndarray, word: np.ndarray, doc_of_bag: np.ndarray, plain: np.ndarray, y: np.ndarray,
                n_words: int, steps: int = 300, rate: float = 0.15, l2: float = 2e-5) -> tuple[np.ndarray, float]:
    """Noisy-or likelihood. (bag, word): words of the sentences that hold a
    known word; ``doc_of_bag``: their documents; ``plain``: other sentences of
    each document; ``y``: document labels."""
    w = np.zeros(n_words + 1)
    w[-1] = -4.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    n_bags, n = len(doc_of_bag), len(y)
    weight_of = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    for t in range(1, steps + 1):
        z = np.bincount(bag, w[word], n_bags) + w[-1]
        log_none = -np.bincount(doc_of_bag, _log1pexp(z), n) - plain * _log1pexp(w[-1])
        none = np.exp(log_none)
        # d(-log P)/d(log_none): 1 - p for y = 0 is exp(log_none); for y = 1 it is none / (1 - none)
        slope = np.where(y == 1, none / np.maximum(1 - none, 1e-9), -1.0) * weight_of
        g_bag = -slope[doc_of_bag] / (1 + np.exp(-np.clip(z, -40, 40)))
        grad = np.zeros_like(w)
        grad[:-1] = np.bincount(word, g_bag[bag], n_words)
        grad[-1] = g_bag.sum() - (slope * plain).sum() / (1 + np.exp(-w[-1]))
        grad[:-1] += l2 * w[:-1] + l2 * np.sign(w[:-1])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Bags:
    """Fit outside the held-out fold."""
    ids = labelled_ids(labels, "toxic", FOLDS, HELD, most)
    rows = join_small(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ids).select("text", "y")

    def words_kernel(batches):
        for b in batches:
            for text, y in zip(strings(b.column("text")).to_pylist(), b.column("y").to_pylist(), strict=True):
                found = set().union(*(s[2] for s in sentences(text)))
                yield pa.record_batch({"word": pa.array(sorted(found), pa.binary()),
                                       "y": pa.array([y] * len(found), pa.int32())})

    totals = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    if not n0 or not n1:
        return NONE
    counts = map_arrow(rows, words_kernel, "word binary, y int").groupBy("word").agg(
        F.sum("y").alias("a"), F.sum(F.lit(1) - F.col("y")).alias("b"))
    p1, p0 = (F.col("a") + 0.5) / (n1 + 1.0), (F.col("b") + 0.5) / (n0 + 1.0)
    z = F.abs(F.log(p1 / p0)) / F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    known = [bytes(r["word"]) for r in counts.where("a + b >= 3").where(z > LEAST_Z).select("word").collect()]
    if not known:
        return NONE
    index = {w: k for k, w in enumerate(sorted(known))}

    def bags_kernel(batches):
        for b in batches:
            out = {"y": [], "plain": [], "bag": [], "word": []}
            for text, y in zip(strings(b.column("text")).to_pylist(), b.column("y").to_pylist(), strict=True):
                bag, word, plain, k = [], [], 0, 0
                for _, _, found in sentences(text):
                    hit = sorted(index[w] for w in found if w in index)
                    if hit:
                        bag += [k] * len(hit)
                        word += hit
                        k += 1
                    else:
                        plain += 1
                for key, value in zip(out, (y, plain, bag, word), strict=True):
                    out[key].append(value)
            yield pa.record_batch({"y": pa.array(out["y"], pa.int32()), "plain": pa.array(out["plain"], pa.int64()),
                                   "bag": pa.array(out["bag"], pa.list_(pa.int32())),
                                   "word": pa.array(out["word"], pa.list_(pa.int32()))})

    got = map_arrow(rows, bags_kernel, "y int, plain long, bag array<int>, word array<int>").toArrow().to_pylist()
    got.sort(key=lambda r: (r["y"], r["plain"], r["word"], r["bag"]))  # the sample arrives in any order
    bag, word, doc_of_bag, base = [], [], [], 0
    for k, r in enumerate(got):
        n = r["bag"][-1] + 1 if r["bag"] else 0
        bag.extend(x + base for x in r["bag"])
        word.extend(r["word"])
        doc_of_bag.extend([k] * n)
        base += n
    w, bias = fit_weights(np.array(bag, np.int64), np.array(word, np.int64), np.array(doc_of_bag, np.int64),
                          np.array([r["plain"] for r in got], float), np.array([r["y"] for r in got], float),
                          len(index))
    return Bags({word: float(w[k]) for word, k in index.items()}, bias)


def score(docs: DataFrame, model: Bags, sentence_at: float = 0.5) -> DataFrame:
    """One row per document: doc_id, score, n_sentences, n_offending, and
    first_offending (number of the first offending sentence, else null)."""

    def kernel(batches):
        for b in batches:
            got = [model.judge(t) for t in strings(b.column("text")).to_pylist()]
            bad = [[k for k, p in s if p >= sentence_at] for _, _, s in got]
            yield pa.record_batch({
                "doc_id": b.column("doc_id"), "score": pa.array([g[0] for g in got], pa.float64()),
                "n_sentences": pa.array([g[1] for g in got], pa.int64()),
                "n_offending": pa.array([len(x) for x in bad], pa.int64()),
                "first_offending": pa.array([x[0] if x else None for x in bad], pa.int64())})

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), kernel,
                     "doc_id long, score double, n_sentences long, n_offending long, first_offending long")


def offending(docs: DataFrame, model: Bags, sentence_at: float = 0.5) -> DataFrame:
    """One row per offending sentence: doc_id, sentence, score, text (the
    sentence, lower-cased)."""

    def kernel(batches):
        for b in batches:
            out = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), strings(b.column("text")).to_pylist(), strict=True):
                bad = [(k, p) for k, p in model.judge(text)[2] if p >= sentence_at]
                if bad:
                    data, spans = text.lower().encode("utf-8", "replace"), sentences(text)
                    out += [(doc_id, k, p, data[spans[k][0]: spans[k][1]].decode().strip()) for k, p in bad]
            yield pa.record_batch([pa.array([r[j] for r in out], t) for j, t in enumerate(
                (pa.int64(), pa.int64(), pa.float64(), pa.string()))], names=["doc_id", "sentence", "score", "text"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), kernel,
                     "doc_id long, sentence long, score double, text string")


def keep_clean(docs: DataFrame, model: Bags, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, with all their columns, scored below the threshold."""

    def mask(texts):
        return pa.array([model.judge(t)[0] < threshold for t in texts.to_pylist()], pa.bool_())

    return keep_rows(docs, mask)
