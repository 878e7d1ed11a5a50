"""Substring dedup (operator 6): suffix automata of reference shards.

A window is ``size`` consecutive words of one document; every word covered by a
window whose word sequence also starts earlier (smaller doc_id, or the same
document and an earlier start) is removed.

1. Anchors. Each window is named by the smallest of the hashes of its
   ``gram``-word runs (leftmost on ties): equal windows have equal anchors.
   Consecutive windows with the same anchor place make one row, so about one
   row for seven words is shuffled, not one a window. Anchors that occur once
   in the corpus are dropped: their windows cannot repeat.
2. References. Over the windows that are left, the smallest doc_id of each
   distinct window (96-bit hash, map-side combining) says which documents hold
   first occurrences; only windows that occur twice count. The reference is
   therefore the distinct repeated content, however often it is repeated.
3. Shards. A window belongs to the shard of its anchor. Each shard's reference
   spans, in (doc_id, start) order, become one suffix automaton; a shard with
   many documents is streamed in several salted units, and its automaton is
   made in each of them (the shard is what is broadcast, bounded by its share
   of the reference, not the whole reference). The marked spans of all documents are
   streamed past it for matching statistics: where the longest match reaches
   ``size`` words, the automaton's first end position decides whether that
   occurrence is earlier. Matches are word for word; the hashes only decide
   what is compared.
4. The removed spans are united per document, and only documents that lose
   words have their text read again.

Nothing is capped: a passage in a third of all documents costs one reference
copy and salted streams. Each stage is written to the shared folder.

Defined cases: a null or empty text has no words (kept_sha256 of the empty
text); rows without a doc_id come after all others (ids below 2**62), equal texts as
one document, others in the order of their texts' hashes; rows that share a
doc_id count as one document number whose texts are each read from word 0, so
a repeated row is not earlier than itself and every row keeps its result.
Equal rows (copies without an id, repeated rows) are matched once; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shipledger.llm.common import Words, map_arrow, mix, multipliers, polynomial, slices, strings, written

SIZE, GRAM = 20, 8
SHARD_WORDS = 60_000     # marked windows a shard aims at
UNIT_WORDS = 240_000     # marked windows streamed past one copy of an automaton
MOST_SHARDS = 1 << 16
LONG_WORD = 64           # bytes; longer words are hashed one by one
NO_ID = 1 << 62          # from here on: documents without an id, by the hash of their text


def _word_hashes(words: Words) -> np.ndarray:
    """64 bits for each word. The distinct words of a slice are hashed together,
    eight bytes at a time; the few long ones (``LONG_WORD``) one by one."""
    if not len(words.vocabulary):
        return np.zeros(0, np.uint64)
    import xxhash

    uniq = words.vocabulary.cast(pa.large_binary())
    ends = np.frombuffer(uniq.buffers()[1], np.int64)[uniq.offset: uniq.offset + len(uniq) + 1]
    start, size = ends[:-1], np.diff(ends)
    octets = np.append(np.frombuffer(uniq.buffers()[2], np.uint8)[:ends[-1]], np.zeros(8, np.uint8))
    h = mix(size)
    for at in range(0, LONG_WORD, 8):
        live = np.flatnonzero((size > at) & (size <= LONG_WORD))
        if not len(live):
            break
        eight = octets[(start[live] + at)[:, None] + np.arange(8)]
        eight[np.arange(8) >= (size[live] - at)[:, None]] = 0
        h[live] = mix(h[live] ^ eight.view("<u8").ravel())
    for k in np.flatnonzero(size > LONG_WORD):
        h[k] = xxhash.xxh64_intdigest(uniq[int(k)].as_buffer())
    return h[words.codes]


def anchors(words: Words, hashes: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, ...]:
    """Windows grouped by anchor place: (anchor hash, flat start of the first
    window, number of consecutive windows)."""
    at = words.windows(size)
    if not len(at):
        return np.zeros(0, np.uint64), at, at
    grams = polynomial(hashes, gram, 21)
    span = size - gram + 1  # runs of `gram` words in a window
    value, place = grams, np.arange(len(grams))
    width = 1
    while width < span:
        step = min(width, span - width)
        a, b = value[: len(value) - step], value[step:]
        left = a <= b
        place = np.where(left, place[: len(place) - step], place[step:])
        value = np.where(left, a, b)
        width += step
    value, place = value[at], place[at]
    new = np.ones(len(at), bool)
    new[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    return value[first], at[first], np.diff(np.append(first, len(at)))


def _order(doc_id: Column, th: Column) -> Column:
    """The order of a document: its id, or a number of its text's hash behind
    all ids, so that documents without an id are no common group."""
    return F.coalesce(doc_id.cast("long"), F.lit(NO_ID) + th.bitwiseAND(F.lit(NO_ID // 2 - 1)))


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    th = F.xxhash64(text)
    return docs.select(_order(F.col("doc_id"), th).alias("did"), th.alias("th"), text.alias("text"))


def _anchor_rows(rows: DataFrame, size: int, gram: int) -> DataFrame:
    def kernel(batches):
        for b in batches:
            texts = strings(b.column("text"))
            for lo, hi in slices(texts):
                words = Words(texts.slice(lo, hi - lo))
                value, start, n = anchors(words, _word_hashes(words), size, gram)
                doc = words.doc[start]
                take = pa.array(doc + lo)
                yield pa.record_batch([pa.array(value.view(np.int64)), b.column("did").take(take),
                                       b.column("th").take(take), pa.array((start - words.start[doc]).astype(np.int32)),
                                       pa.array(n.astype(np.int32))], names=["h", "did", "th", "start", "n"])

    return map_arrow(rows, kernel, "h long, did long, th long, start int, n int")


class _Marks:
    """A column of marks as flat arrays, document by document."""

    def __init__(self, column: pa.ListArray):
        self.offsets, values = column.offsets.to_numpy(), column.values
        self.fields = [values.field(c).to_numpy(zero_copy_only=False).astype(np.int64)
                       for c in ("start", "n", "shard", "salts")]

    def windows(self, k: int) -> tuple[np.ndarray, ...]:
        """Marked window starts of document k, rising, with shard and salts."""
        at = slice(self.offsets[k], self.offsets[k + 1])
        start, n, shard, salts = (f[at] for f in self.fields)
        every, mark = _expand(start, n)
        every, keep = np.unique(every, return_index=True)
        mark = mark[keep]
        return every, shard[mark], salts[mark]


def _expand(start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every window start of the marks, and the mark that it comes from."""
    mark = np.repeat(np.arange(len(start)), n)
    return start[mark] + np.arange(len(mark)) - np.repeat(np.cumsum(n) - n, n), mark


def _window_hashes(hashes: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """96 bits of each window's content."""
    a, b = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    for j, (r, s) in enumerate(zip(multipliers(size, 31), multipliers(size, 32), strict=True)):
        h = hashes[at + j]
        a += h * r
        b += (h ^ (h >> np.uint64(17))) * s
    return mix(a).view(np.int64), (mix(b) >> np.uint64(32)).astype(np.uint32).view(np.int32)


class SuffixAutomaton:
    """Suffix automaton of a sequence of spans (lists of words). States keep
    the first end position of their words; a word that no span holds parts
    the spans."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]
        self.last, self.size = 0, 0
        self.owner: list[int] = []   # position -> span number
        self.spans: list[tuple[int, int, int]] = []  # did, start, first position

    def add_span(self, did: int, start: int, words: list) -> None:
        number = len(self.spans)
        self.spans.append((did, start, self.size))
        for w in words:
            self._extend(w)
        self._extend(-1 - number)
        self.owner.extend([number] * (len(words) + 1))

    def _extend(self, w) -> None:
        nxt, link, length, first = self.next, self.link, self.length, self.first
        new = len(nxt)
        nxt.append({})
        length.append(length[self.last] + 1)
        first.append(self.size)
        link.append(0)
        self.size += 1
        p = self.last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(nxt)
                nxt.append(nxt[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                first.append(first[q])
                while p >= 0 and nxt[p].get(w) == q:
                    nxt[p][w] = twin
                    p = link[p]
                link[q] = link[new] = twin
        self.last = new

    def earlier(self, did: int, start: int, words: list, size: int) -> list[int]:
        """Windows (starts within the span) whose first occurrence in the
        reference is earlier than (did, start + window). Matching statistics
        are kept at most ``size`` long."""
        nxt, link, length, first = self.next, self.link, self.length, self.first
        owner, spans = self.owner, self.spans
        out, state, run = [], 0, 0
        for i, w in enumerate(words):
            while state and w not in nxt[state]:
                state = link[state]
                run = length[state]
            to = nxt[state].get(w)
            if to is None:
                run = 0
                continue
            state, run = to, run + 1
            if run >= size:
                run = size
                while length[link[state]] >= size:
                    state = link[state]
                at = first[state] - size + 1
                d, s, begin = spans[owner[at]]
                if (d, s + at - begin) < (did, start + i - size + 1):
                    out.append(i - size + 1)
        return out


_ITEM = ["shard", "salt", "side", "did", "th", "start", "words"]


def removed_spans(docs: DataFrame, size: int = SIZE, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """Removed spans of the documents that lose words: did, th, spans (array of
    start, length; they may overlap); and the marked documents (did, th, text,
    marks), one row each. did is the document's order, th the hash of the text."""
    rows = _rows(docs)
    repeated = written(_anchor_rows(rows, size, gram).groupBy("h").agg(
        F.count("*").alias("c"), F.min("did").alias("home")).where("c > 1").select("h", "home"), "substring-anchors")
    hits = written(_anchor_rows(rows, size, gram).join(repeated, "h").select("did", "th", "start", "n", "home"),
                   "substring-hits")
    windows = hits.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = int(min(MOST_SHARDS, max(1, -(-windows // SHARD_WORDS))))
    hits = hits.withColumn("shard", F.pmod(F.xxhash64("home"), F.lit(shards)).cast("int"))
    load = hits.groupBy("shard").agg(F.ceil(F.sum("n") / F.lit(UNIT_WORDS)).cast("int").alias("salts"))
    marks = hits.join(F.broadcast(load), "shard").groupBy("did", "th").agg(  # load: a row a shard, at most MOST_SHARDS
        F.collect_set(F.struct("start", "n", "shard", "salts")).alias("marks"))
    # one row of equal ones, by the partitioning that the join has
    marked = written(rows.join(marks, ["did", "th"]).dropDuplicates(["did", "th"]), "substring-marked")

    def window_kernel(batches):
        for b in batches:
            texts, did, marks = strings(b.column("text")), b.column("did").to_numpy(), _Marks(b.column("marks"))
            for lo, hi in slices(texts):
                words = Words(texts.slice(lo, hi - lo))
                at = [marks.windows(k)[0] + words.start[k - lo] for k in range(lo, hi)]
                w, v = _window_hashes(_word_hashes(words), np.concatenate(at), size)
                yield pa.record_batch({"w": pa.array(w), "v": pa.array(v),
                                       "did": pa.array(np.repeat(did[lo:hi], [len(x) for x in at]))})

    firsts = (map_arrow(marked.select("did", "text", "marks"), window_kernel, "w long, v int, did long")
              .groupBy("w", "v").agg(F.min("did").alias("did"), F.count("*").alias("c")).where("c > 1"))
    refs = written(firsts.groupBy("did").agg(F.collect_list("w").alias("refs")), "substring-references")

    def item_kernel(batches):
        for b in batches:
            texts, did_at, th_at = strings(b.column("text")), b.column("did"), b.column("th")
            did = did_at.to_pylist()
            marks, refs = _Marks(b.column("marks")), b.column("refs")
            ref_at, ref = refs.offsets.to_numpy(), refs.values.to_numpy(zero_copy_only=False)
            for lo, hi in slices(texts, 1 << 20):  # spans of references are repeated for each salt
                words = Words(texts.slice(lo, hi - lo))
                windows = [marks.windows(k) for k in range(lo, hi)]
                held = [k for k in range(lo, hi) if ref_at[k] < ref_at[k + 1]]
                at = [windows[k - lo][0] + words.start[k - lo] for k in held]
                found, _ = _window_hashes(_word_hashes(words), np.concatenate([*at, np.zeros(0, np.int64)]), size)
                found = dict(zip(held, np.split(found, np.cumsum([len(x) for x in at])[:-1]), strict=True)) if held else {}
                spans, out = [], []  # (document, first word, number of words); (shard, salt, side, span)
                for k in range(lo, hi):
                    at, shard, salts = windows[k - lo]
                    mine = (did[k] * 0x9E3779B1 >> 7)
                    for a, z in _stretches(at, shard):
                        out.append((int(shard[a]), mine % int(salts[a]), 1, len(spans)))
                        spans.append((k, int(at[a]), int(at[z - 1]) + size - int(at[a])))
                    if k in found:
                        kept = np.isin(found[k], ref[ref_at[k]: ref_at[k + 1]])
                        ra, rs, rn = at[kept], shard[kept], salts[kept]
                        for a, z in _stretches(ra, rs):
                            out += [(int(rs[a]), salt, 0, len(spans)) for salt in range(int(rn[a]))]
                            spans.append((k, int(ra[a]), int(ra[z - 1]) + size - int(ra[a])))
                doc, start, n = np.array(spans, np.int64).reshape(-1, 3).T
                shard, salt, side, span = np.array(out, np.int64).reshape(-1, 4).T
                text = _phrases(words.flat, words.start[doc - lo] + start, n)
                yield pa.record_batch([pa.array(shard.astype(np.int32)), pa.array(salt.astype(np.int32)),
                                       pa.array(side.astype(np.int32)), did_at.take(pa.array(doc[span])),
                                       th_at.take(pa.array(doc[span])), pa.array(start[span].astype(np.int32)),
                                       text.take(pa.array(span))], names=_ITEM)

    items = map_arrow(marked.join(refs, "did", "left"), item_kernel,
                      "shard int, salt int, side int, did long, th long, start int, words string")
    ordered = items.repartition("shard", "salt").sortWithinPartitions("shard", "salt", "side", "did", "start", "th")

    def match_kernel(batches):
        key, automaton, numbers = None, None, {}
        for b in batches:
            out = []
            for shard, salt, side, did, th, start, text in zip(*(b.column(c).to_pylist() for c in (
                    "shard", "salt", "side", "did", "th", "start", "words")), strict=True):
                if (shard, salt) != key:
                    key, automaton, numbers = (shard, salt), SuffixAutomaton(), {}
                words = text.split(" ")
                if side == 0:
                    automaton.add_span(did, start, [numbers.setdefault(w, len(numbers)) for w in words])
                    continue
                get = numbers.get
                found = automaton.earlier(did, start, [get(w) for w in words], size)
                for a, z in _joined(found, size):
                    out.append((did, th, start + a, z - a))
            yield pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate(
                (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["did", "th", "start", "n"])

    gone = written(map_arrow(ordered, match_kernel, "did long, th long, start int, n int"), "substring-removed")

    spans = gone.groupBy("did", "th").agg(F.collect_set(F.struct("start", "n")).alias("spans"))
    return spans, marked


def _phrases(flat: pa.Array, start: np.ndarray, n: np.ndarray) -> pa.Array:
    """Runs of n words from each start on, joined by a space."""
    every, _ = _expand(start, n)
    ends = np.append(0, np.cumsum(n)).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), flat.take(pa.array(every))), " ")


def _stretches(at: np.ndarray, shard: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of consecutive windows of one shard."""
    if not len(at):
        return []
    cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(shard) != 0)) + 1
    return list(zip([0, *cut.tolist()], [*cut.tolist(), len(at)], strict=True))


def _joined(starts: list[int], size: int) -> list[tuple[int, int]]:
    """Maximal spans covered by windows at rising starts."""
    out: list[tuple[int, int]] = []
    for s in starts:
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], s + size)
        else:
            out.append((s, s + size))
    return out


def cut_words(text: str, spans) -> tuple[int, int, bytes]:
    """Number of words, number removed, and the kept words joined by a space."""
    words = text.encode("utf-8", "replace").split()
    if not spans:
        return len(words), 0, b" ".join(words)
    kept, at = [], 0
    for start, end in sorted((s["start"], s["start"] + s["n"]) for s in spans):
        kept += words[at: start]
        at = max(at, end)
    kept += words[at:]
    return len(words), len(words) - len(kept), b" ".join(kept)


def _digest_rows(rows: DataFrame, key: list[str]) -> DataFrame:
    """key columns, n_words, n_removed, kept_sha256 of rows (text, spans)."""
    def kernel(batches):
        for b in batches:
            spans = b.column("spans").to_pylist() if "spans" in b.schema.names else [None] * b.num_rows
            got = [cut_words(t, s) for t, s in zip(strings(b.column("text")).to_pylist(), spans, strict=True)]
            yield pa.record_batch({**{k: b.column(k) for k in key}, "n_words": pa.array([g[0] for g in got], pa.int64()),
                                   "n_removed": pa.array([g[1] for g in got], pa.int64()),
                                   "kept_sha256": pa.array([hashlib.sha256(g[2]).hexdigest() for g in got], pa.string())})

    return map_arrow(rows, kernel, ", ".join(f"{k} long" for k in key) + ", n_words long, n_removed long, kept_sha256 string")


def digests(docs: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256."""
    spans, marked = removed_spans(docs, size, gram)
    changed = _digest_rows(marked.select("did", "th", "text").join(spans, ["did", "th"]).select(
        "did", "th", "text", "spans"), ["did", "th"]).dropDuplicates(["did", "th"])
    changed = written(changed.select("did", "th", F.col("n_removed").alias("r"), F.col("kept_sha256").alias("k")),
                      "substring-changed")
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    plain = _digest_rows(whole.select("doc_id", F.xxhash64("text").alias("th"), "text"), ["doc_id", "th"])
    plain = plain.withColumn("did", _order(F.col("doc_id"), F.col("th")))
    return plain.join(changed, ["did", "th"], "left").select(
        "doc_id", "n_words", F.coalesce("r", "n_removed").alias("n_removed"),
        F.coalesce("k", "kept_sha256").alias("kept_sha256"))


def remove(docs: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """``docs`` with all columns; the text of documents that lose words becomes
    their kept words joined by a space, other texts stay as they are."""
    spans, marked = removed_spans(docs, size, gram)

    def kernel(batches):
        for b in batches:
            texts = [cut_words(t, s)[2].decode() for t, s in zip(strings(b.column("text")).to_pylist(),
                                                                 b.column("spans").to_pylist(), strict=True)]
            yield pa.record_batch({"_did": b.column("did"), "_th": b.column("th"), "_text": pa.array(texts, pa.string())})

    changed = written(map_arrow(marked.select("did", "th", "text").join(spans, ["did", "th"]).select(
        "did", "th", "text", "spans"), kernel, "_did long, _th long, _text string").dropDuplicates(["_did", "_th"]),
        "substring-texts")
    # both sides by reference: the input may hold columns of any name
    mine = {c: docs[f"`{c}`"] for c in docs.columns}
    th = F.xxhash64(F.coalesce(mine["text"], F.lit("")))
    same = (_order(mine["doc_id"], th) == changed["_did"]) & (th == changed["_th"])
    return docs.join(changed, same, "left").select(
        *[F.coalesce(changed["_text"], x).alias(c) if c == "text" else x for c, x in mine.items()])
