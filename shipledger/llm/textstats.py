"""Statistics of whole texts: exact integer counts for the quality rules and
the features that the quality models score. Vectorised over Arrow slices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from shipledger.llm.common import Words, polynomial

SYMBOLS = b"#*$%&|<>"
BULLETS = b"|"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["log_words", "mean_word", "symbol_rate", "bar_rate", "exclamation_rate", "upper_rate", "digit_rate",
            "punctuation_rate", "dup_line_rate", "repeat_rate", "distinct_rate", "twin_rate", "sentence_words",
            "line_words", "open_angle_rate", "long_word_rate"]


def _byte_counts(texts: pa.Array, classes: list[bytes]) -> np.ndarray:
    """Bytes of each class in each text."""
    data = np.frombuffer(b"".join(texts.cast(pa.binary()).to_pylist()), np.uint8)
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    out = np.zeros((len(texts), len(classes)), np.int64)
    for k, members in enumerate(classes):
        hit = np.zeros(256, np.int8)
        hit[list(members)] = 1
        at = np.flatnonzero(hit[data])
        out[:, k] = np.diff(np.searchsorted(at, ends, side="left"), prepend=0)
    return out


def _dup_lines(texts: pa.Array) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    lists = pc.split_pattern(texts, "\n")
    flat, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    worded = pc.binary_length(pc.ascii_trim_whitespace(coded.dictionary)).to_numpy(zero_copy_only=False) > 0
    doc = np.repeat(np.arange(len(texts)), sizes)
    keep = worded[codes] if len(codes) else np.zeros(0, bool)
    doc, codes = doc[keep], codes[keep]
    lines = np.bincount(doc, minlength=len(texts))
    pairs = np.unique(doc * (len(worded) + 1) + codes)
    return lines - np.bincount(pairs // (len(worded) + 1), minlength=len(texts)), lines


def repeat_words(words: Words, size: int = 8) -> np.ndarray:
    """Words in windows of ``size`` words that occur twice or more in their
    text, the first occurrence included. Windows are grouped by a hash and
    then compared word for word."""
    out = np.zeros(len(words.n), np.int64)
    at = words.windows(size)
    if not len(at):
        return out
    h = polynomial(words.codes.astype(np.uint64), size, 11)[at] + words.doc[at].astype(np.uint64) * np.uint64(
        0xC2B2AE3D27D4EB4F)
    order = np.argsort(h, kind="stable")
    hs = h[order]
    same = np.flatnonzero(hs[1:] == hs[:-1])
    if not len(same):
        return out
    a, b = at[order[same]], at[order[same + 1]]
    equal = words.doc[a] == words.doc[b]
    for j in range(size):
        equal &= words.codes[a + j] == words.codes[b + j]
    if equal.all():
        starts = np.unique(np.concatenate([a, b]))
    else:  # two different windows share a hash: group by the words themselves
        keys = np.stack([words.doc[at], *(words.codes[at + j] for j in range(size))], axis=1)
        _, inverse, count = np.unique(keys, axis=0, return_inverse=True, return_counts=True)
        starts = at[count[inverse.ravel()] > 1]
    edge = np.zeros(len(words.doc) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    covered = np.cumsum(edge)[:-1] > 0
    return np.bincount(words.doc[covered], minlength=len(out)).astype(np.int64)


def statistics(texts: pa.Array, features: bool = True) -> tuple[dict[str, np.ndarray], np.ndarray | None]:
    """Exact counts of each text, and its feature matrix (columns FEATURES)."""
    words = Words(texts)
    n = words.n
    chars = pc.utf8_length(words.flat).to_numpy(zero_copy_only=False).astype(np.int64)
    word_chars = np.bincount(words.doc, weights=chars, minlength=len(n)).astype(np.int64)
    upper, digit, other = (bytes(range(65, 91)), bytes(range(48, 58)), b"!\"'()+,-./:;=?@[\\]^_`{}~")
    by = _byte_counts(texts, [SYMBOLS, BULLETS, b"!", upper, digit, other, b".!?", b"<"])
    dups, lines = _dup_lines(texts)
    repeats = repeat_words(words)
    counts = {"n_words": n, "word_chars": word_chars, "n_symbols": by[:, 0], "n_dup_lines": dups.astype(np.int64),
              "n_repeat_words": repeats}
    if not features:
        return counts, None
    distinct = np.bincount(np.unique(words.doc * (len(words.vocabulary) + 1) + words.codes)
                           // (len(words.vocabulary) + 1), minlength=len(n)) if len(words.doc) else np.zeros(len(n))
    if len(words.doc) > 1:
        twin = (words.codes[1:] == words.codes[:-1]) & (words.doc[1:] == words.doc[:-1])
        twins = np.bincount(words.doc[1:][twin], minlength=len(n))
    else:
        twins = np.zeros(len(n))
    long_words = np.bincount(words.doc[chars > 30], minlength=len(n))
    # non-ASCII capitals count too; the share is of all letters in words
    shout = by[:, 3]
    w, c = np.maximum(n, 1), np.maximum(word_chars, 1)
    x = np.stack([
        np.log1p(n), np.minimum(word_chars / w, 40), by[:, 0] / c, by[:, 1] / w, by[:, 2] / w, shout / c, by[:, 4] / c,
        by[:, 5] / c, dups / np.maximum(lines, 1), repeats / w, np.log1p(distinct) / np.log1p(w), twins / w,
        np.log1p(n / np.maximum(by[:, 6], 1)), np.log1p(n / np.maximum(lines, 1)), by[:, 7] / c, long_words / w,
    ], axis=1)
    return counts, x
