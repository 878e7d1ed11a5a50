"""Cutting text where a GPT-style pattern must cut, so that equal pieces need
to be encoded only once.

A space between two characters that are no white space always begins a match
of the pattern ( ?letters, ?digits, ?others), so the text may be cut before it
and each piece encoded by itself. That also holds where only one neighbour is
white space. A space with white space (or the text's end) behind it and white
space before it is part of a longer run, and is not cut at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


# Pieces whose matches are plain to see: letters, and letters with marks behind
# them (no apostrophe, which may begin a contraction). Of letters, only those
# that every version of the character tables calls letters.
LETTERS = " ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+"
MARKS = r"[!-&(-/:-@\[-`{-~]+"


def plain_parts(distinct: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Pieces with marks behind their letters cut before the marks, where the
    pattern must cut; others whole. The piece of each part, and the parts."""
    two = pc.extract_regex(distinct, f"^(?P<a>{LETTERS})(?P<b>{MARKS})$")
    marked = np.flatnonzero(pc.is_valid(two).to_numpy(zero_copy_only=False))
    whole = np.ones(len(distinct), bool)
    whole[marked] = False
    whole = np.flatnonzero(whole)
    some = two.take(pa.array(marked))
    owner = np.concatenate([whole, marked, marked])
    order = np.argsort(owner, kind="stable")
    parts = pa.concat_arrays([distinct.take(pa.array(whole)), some.field("a"), some.field("b")])
    return owner[order], parts.take(pa.array(order))


def _edges(parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each part is empty, begins, or ends with white space."""
    parts = pc.cast(parts, pa.large_string())
    offsets = np.frombuffer(parts.buffers()[1], np.int64, len(parts) + 1, parts.offset * 8)
    raw = parts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(1, np.uint8)
    empty = offsets[1:] == offsets[:-1]
    out = []
    for at, end in ((offsets[:-1], 0), (offsets[1:] - 1, -1)):
        byte = data[np.clip(at, 0, len(data) - 1)]
        white = ((byte >= 9) & (byte <= 13)) | ((byte >= 0x1C) & (byte <= 0x20))
        for k in np.flatnonzero((byte >= 0x80) & ~empty).tolist():
            white[k] = parts[k].as_py()[end].isspace()
        out.append(white & ~empty)
    return empty, *out


def pieces(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """All pieces of all texts in order: the text each belongs to, and the
    pieces (with their leading space) as numbers into the distinct ones."""
    lists = pc.split_pattern(texts, " ")
    doc = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    coded = lists.flatten().dictionary_encode()
    number = coded.indices.to_numpy(zero_copy_only=False)
    empty, begins, ends = (x[number] for x in _edges(coded.dictionary))
    first = np.ones(len(doc), bool)
    first[1:] = doc[1:] != doc[:-1]
    before = np.where(empty, ~first, ends)  # white space stands before the space that follows a part
    run = np.zeros(len(doc), bool)
    run[1:] = ~first[1:] & before[:-1] & (empty | begins)[1:]
    if not run.any():
        # the usual case: prefix the distinct parts behind a space, and put those that begin a text after them
        opening, at = np.unique(number[first], return_inverse=True)
        inner = np.unique(number[~first])
        place = np.empty(len(number), np.int64)
        place[~first] = np.searchsorted(inner, number[~first])
        place[first] = len(inner) + at
        both = pa.concat_arrays([pc.binary_join_element_wise(pa.scalar(""), coded.dictionary.take(pa.array(inner)), " "),
                                 coded.dictionary.take(pa.array(opening))])
        return doc, pa.DictionaryArray.from_arrays(pa.array(place, pa.int32()), both)
    heads = np.flatnonzero(~run)
    tails = np.append(heads[1:], len(doc))
    parts = coded.dictionary.take(pa.array(number[heads]))
    out = pc.if_else(pa.array(first[heads]), parts, pc.binary_join_element_wise(pa.scalar(""), parts, " "))
    long = np.flatnonzero(tails - heads > 1)
    joined = [("" if first[heads[k]] else " ") + " ".join(
        coded.dictionary.take(pa.array(number[heads[k]: tails[k]])).to_pylist()) for k in long.tolist()]
    mask = np.zeros(len(heads), bool)
    mask[long] = True
    return doc[heads], pc.replace_with_mask(out, pa.array(mask), pa.array(joined, pa.string())).dictionary_encode()
