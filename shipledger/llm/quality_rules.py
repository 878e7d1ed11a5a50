"""Quality rules (operator 9): hard counts plus gradient-boosted trees over
document statistics.

The trees are fitted on a bounded sample of labelled documents (``most`` ids a
class), flattened into numpy node arrays and shipped with the kernel, so every
whole text is judged in one pass over the scan, with no shuffle. The score may
only fall as symbols, repeated windows, repeated lines or doubled words rise
(monotonic constraints).

Defined cases: a null text counts as empty; an empty text has no word and
fails the base rule; rows are judged one by one, so repeated rows, null ids
and ties keep their rows; an empty table gives an empty result; without labels
of both classes the trees give one constant and only the base rule decides.
Columns of the input other than the id and the text are never read by
``judge`` and returned untouched by ``keep_good``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shipledger.llm import gbt
from shipledger.llm.common import join_small, keep_rows, labelled_ids, map_arrow, slices, strings
from shipledger.llm.textstats import COUNTS, FEATURES, statistics

FALLING = ["symbol_rate", "bar_rate", "exclamation_rate", "upper_rate", "dup_line_rate", "repeat_rate", "twin_rate"]
SAMPLE = 6_000  # labelled documents of each class
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30


def sample_features(docs: DataFrame, ids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the documents in ``ids`` (bounded by its maker)."""

    def kernel(batches):
        for b in batches:
            texts, y = strings(b.column("text")), b.column("y").to_numpy(zero_copy_only=False)
            for lo, hi in slices(texts):
                _, x = statistics(texts.slice(lo, hi - lo))
                yield pa.record_batch({"y": pa.array(y[lo:hi].astype(np.int32)),
                                       **{f: pa.array(x[:, j].astype(np.float64)) for j, f in enumerate(FEATURES)}})

    rows = join_small(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ids)
    got = map_arrow(rows.select("text", "y"), kernel, "y int, " + ", ".join(f"{f} double" for f in FEATURES)).toArrow()
    x = np.stack([got[f].to_numpy() for f in FEATURES], axis=1) if got.num_rows else np.zeros((0, len(FEATURES)))
    y = got["y"].to_numpy().astype(float)
    order = np.lexsort((*x.T, y))  # the sample arrives in any order
    return x[order], y[order]


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> gbt.Trees:
    x, y = sample_features(docs, labelled_ids(labels, "quality", 0, 0, most))
    return gbt.fit(x, y, monotone={FEATURES.index(f): -1 for f in FALLING})


def _verdicts(texts: pa.Array, model: gbt.Trees, threshold: float):
    counts, x = statistics(texts)
    failed = (counts["n_words"] < MIN_WORDS) | (
        100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * counts["n_words"])
    score = model.probability(x)
    return counts, failed, score, ~failed & (score >= threshold)


def judge(docs: DataFrame, model: gbt.Trees, threshold: float = 0.5) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, kept, score."""

    def kernel(batches):
        for b in batches:
            texts = strings(b.column("text"))
            for lo, hi in slices(texts):
                counts, failed, score, kept = _verdicts(texts.slice(lo, hi - lo), model, threshold)
                yield pa.record_batch({"doc_id": b.column("doc_id").slice(lo, hi - lo),
                                       **{c: pa.array(counts[c]) for c in COUNTS},
                                       "base_failed": pa.array(failed), "kept": pa.array(kept),
                                       "score": pa.array(score)})

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, score double"
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), kernel, schema)


def keep_good(docs: DataFrame, model: gbt.Trees, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are kept."""

    def mask(texts):
        kept = [_verdicts(texts.slice(lo, hi - lo), model, threshold)[3] for lo, hi in slices(texts)]
        return pa.array(np.concatenate([np.zeros(0, bool), *kept]))

    return keep_rows(docs, mask)
