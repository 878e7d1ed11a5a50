"""Byte-level BPE encoding and decoding (operator 7).

Bytes are mapped to Latin-1 characters and all tokens that occur in a piece of
text are found with one Aho-Corasick automaton. The encoder walks from left to
right, takes the longest token that is compatible with the token before it,
and steps back where none is; a position found to be a dead end is not entered
again. Two tokens are compatible if merging by rank would leave them as they
are, which is decided from the tokens' own merges and remembered per pair. The
result is the encoding that merging by lowest rank gives, in linear time, for
a vocabulary made by such merges (each token is the merge of two tokens that
the earlier merges leave side by side), as trained ones are.

One narrow pass over whole texts. A slice of texts (``common.SLICE_BYTES``, or
one longer text) is cut into pieces that no match of the pattern crosses; each
distinct piece is split by the pattern and each distinct match encoded once,
and the ids are gathered by position. The walk is taken by all matches of a
batch together, one try a round. A worker remembers pairs of tokens in a table
of fixed size, and the ids of at most ``REMEMBERED`` short pieces.
Defined cases: a null text counts as empty; an empty text has no token; rows
are encoded one by one, so repeated rows, null ids and ties keep their rows; an
empty table gives an empty result; only id and text are read.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shipledger.llm.common import map_arrow, slices, strings
from shipledger.llm.encoded import Memory, gather
from shipledger.llm.pretokens import LETTERS, MARKS, pieces

REMEMBERED = 1_000_000  # pieces a worker remembers
PLACES = 21  # bits: places for remembered pairs
PAIRS = 100_000  # pairs remembered by the walk of a single match
WIDTHS = (8, 12, 20, 48)  # characters of matches that walk together
BATCH = 16_384  # of them at once
APART = "\u0100"  # no byte: between the matches of a batch


class Bpe:
    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.ranks = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        # the two tokens that merge last into each token; bytes stand alone
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.valid: dict[tuple[int, int], bool] = {}
        self.known, self.told = np.full(1 << PLACES, -1, np.int64), np.zeros(1 << PLACES, bool)
        # tokens of two bytes and more; a single byte is always there as the last choice
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.byte = np.array([ranks.get(bytes([k]), -1) for k in range(256)], np.int64)
        for token, rank in ranks.items():
            if len(token) == 1:
                self.parts[rank] = (rank, rank)
                continue
            halves = self._last_merge(token, rank)
            if halves is None:
                continue  # merging by rank never makes it
            self.parts[rank] = halves
            self.merged[halves] = rank
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.size[rank] = len(token)
        self.spelt = pa.array([self.bytes_of.get(k, b"") for k in range(len(self.size))], pa.binary())
        self.decimal = pa.array([str(k) for k in range(len(self.size))], pa.string())

    def _last_merge(self, token: bytes, rank: int) -> tuple[int, int] | None:
        parts = [token[i: i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], rank))
            if self.ranks.get(parts[best] + parts[best + 1], rank) >= rank:
                return None
            parts[best: best + 2] = [parts[best] + parts[best + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def compatible(self, a: int, b: int) -> bool:
        """Whether tokens a, b stay apart when their bytes are merged by rank:
        undo merges from the youngest, and see whether the tokens that then
        meet at the seam would have merged before that."""
        known = self.valid.get((a, b))
        if known is not None:
            return known
        if len(self.valid) >= PAIRS:
            self.valid.clear()
        left, right, before, result = a, b, len(self.ranks) + 1, None
        while result is None:
            made = self.merged.get((left, right))
            if made is not None and made < before:
                result = False
                continue
            # undo the younger of the two tokens (the right one on a tie: the
            # leftmost pair of a rank merges first); a byte cannot be undone
            undo_left = left > right
            for _ in range(2):
                if undo_left:
                    before, part = left, self.parts[left][1]
                    if part != left:
                        left = part
                        break
                else:
                    before, part = right + 1, self.parts[right][0]
                    if part != right:
                        right = part
                        break
                undo_left = not undo_left
            else:
                result = True
        self.valid[(a, b)] = result
        return result

    def encode(self, data: bytes) -> list[int]:
        if not data:
            return []
        n = len(data)
        byte = self.byte.tolist()
        if any(byte[x] < 0 for x in data):
            raise ValueError("the vocabulary lacks a byte")
        starts: list[list[tuple[int, int]]] = [[(1, byte[x])] for x in data]
        for end, rank in self.automaton.iter(data.decode("latin-1")):
            size = len(self.bytes_of[rank])
            starts[end + 1 - size].append((size, rank))  # rising size for each start
        dead = bytearray(n + 1)
        out: list[int] = []
        tried: list[int] = []  # index into starts[] of each token of out
        at, k = 0, len(starts[0]) - 1
        while at < n:
            while k >= 0:
                size, rank = starts[at][k]
                if not dead[at + size] and (not out or self.compatible(out[-1], rank)):
                    break
                k -= 1
            if k >= 0:
                out.append(rank)
                tried.append(k)
                at += size
                k = len(starts[at]) - 1 if at < n else 0
            else:
                dead[at] = 1
                if not out:
                    raise ValueError("the vocabulary lacks a byte")
                at -= len(self.bytes_of[out.pop()])
                k = tried.pop() - 1
        return out

    def encode_all(self, matches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all matches, one after another, and how many each has."""
        sizes = np.zeros(len(matches), np.int64)
        width = np.array([len(m) for m in matches], np.int64)  # in characters: a byte is a token at least
        owner, flat = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for low, high in zip((-1, *WIDTHS), WIDTHS, strict=False):  # the walk of a batch is as wide as its longest
            rows = np.flatnonzero((width > low) & (width <= high))
            for at in range(0, len(rows), BATCH):
                some = rows[at: at + BATCH]
                f, sizes[some] = self._together([matches[k] for k in some.tolist()])
                flat.append(f)
                owner.append(np.repeat(some, sizes[some]))
        for k in np.flatnonzero(width > WIDTHS[-1]).tolist():
            flat.append(np.array(self.encode(matches[k].encode()), np.int64))
            sizes[k] = len(flat[-1])
            owner.append(np.full(sizes[k], k))
        return np.concatenate(flat)[np.argsort(np.concatenate(owner), kind="stable")], sizes

    def _compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``compatible`` of many pairs. What is known stands in a table with
        one place a hash; a pair that has lost its place is decided again."""
        key = a << 32 | b
        place = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PLACES)).astype(np.int64)
        missed = np.flatnonzero(self.known[place] != key)
        if len(missed):
            new, first = np.unique(key[missed], return_index=True)
            at = place[missed[first]]
            told = np.array([self.compatible(k >> 32, k & 0xFFFFFFFF) for k in new.tolist()], bool)
            result = self.told[place]
            result[missed] = told[np.searchsorted(new, key[missed])]
            self.known[at], self.told[at] = new, told
            # two pairs may want one place: the later one has it, and its answer
            self.told[at] = told[np.searchsorted(new, self.known[at])]
            return result
        return self.told[place]

    def _together(self, matches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All matches walk together: in each round every match tries the next
        token at its place, longest first, goes on where it is compatible with
        the one before and does not lead to a dead end, and else steps back."""
        text = "\xff".join(m.encode().decode("latin-1") for m in matches)  # no UTF-8 text holds that byte
        data = np.frombuffer(text.encode("latin-1"), np.uint8)
        if (self.byte[data[data != 0xFF]] < 0).any():
            raise ValueError("the vocabulary lacks a byte")
        cuts = np.flatnonzero(data == 0xFF)
        begin, end = np.concatenate([[0], cuts + 1]), np.append(cuts, len(data))
        found = np.fromiter(self.automaton.iter(text.replace("\xff", APART)), [("end", np.int64), ("rank", np.int64)])
        start = found["end"] + 1 - self.size[found["rank"]]
        rank = found["rank"][np.argsort((start << 16) - self.size[found["rank"]], kind="stable")]  # longest first
        many = np.bincount(start, minlength=len(data) + 1)
        first = np.cumsum(many) - many
        rank = np.append(rank, 0)
        dead = np.zeros(len(data) + 1, bool)
        deepest = int((end - begin).max(initial=0))
        taken = np.full((len(begin), deepest + 1), -1, np.int32)  # tokens of each match; nothing before the first
        tried = np.zeros((len(begin), deepest + 1), np.int32)
        depth = np.zeros(len(begin), np.int64)
        row = np.flatnonzero(begin < end)
        where, choice = begin[row], np.zeros(len(row), np.int64)
        while len(row):
            n, d = many[where], depth[row]
            token = np.where(choice < n, rank[np.minimum(first[where] + choice, len(rank) - 1)], self.byte[data[where]])
            onward = where + self.size[token]
            last = taken[row, d].astype(np.int64)
            ok = (choice <= n) & ~dead[np.minimum(onward, len(data))]
            check = np.flatnonzero(ok & (last >= 0))
            ok[check] = self._compatible(last[check], token[check])
            back = ~ok & (choice >= n)
            go, r = ok, row[ok]
            depth[r] += 1
            taken[r, depth[r]], tried[r, depth[r]] = token[go], choice[go]
            dead[where[back]] = True
            if (d[back] == 0).any():
                raise ValueError("the vocabulary lacks a byte")
            choice = np.where(go, 0, np.where(back, tried[row, d] + 1, choice + 1))
            where = np.where(go, onward, np.where(back, where - self.size[np.maximum(last, 0)], where))
            depth[row[back]] -= 1
            on = where < end[row]
            row, where, choice = row[on], where[on], choice[on]
        flat = taken[:, 1:][np.arange(deepest)[None] < depth[:, None]].astype(np.int64)
        return flat, depth

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Encoder:
    """Pattern and BPE. ``plain``: the pattern takes a space and letters, and
    marks, as one match each (GPT-style patterns do)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = REMEMBERED):
        import regex

        self.bpe, self.pattern = Bpe(ranks), regex.compile(pattern)
        self.memory = Memory(remembered)
        self.plain = all(self.pattern.findall(a + b) == [a, b] for a in ("a", " Aé", "ɏÀ") for b in ("!", "&(", "/:@[`{~"))

    def ids(self, text: str) -> list[int]:
        return self.encode(pa.array([text], pa.string()))[0].tolist()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and the bounds of each."""
        doc, cut = pieces(texts)
        flat, sizes = self.memory.encode(cut.dictionary, self._pieces)
        place = cut.indices.to_numpy(zero_copy_only=False)
        total = np.bincount(doc, weights=sizes[place], minlength=len(texts)).astype(np.int64)
        return gather(flat, sizes, place), np.concatenate([[0], np.cumsum(total)])

    def _pieces(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces: their matches, each distinct one encoded
        once."""
        owner, matches = self._matches(distinct)
        coded = matches.dictionary_encode()
        flat, sizes = self.bpe.encode_all(coded.dictionary.to_pylist())
        number = coded.indices.to_numpy(zero_copy_only=False)
        return gather(flat, sizes, number), np.bincount(owner, weights=sizes[number], minlength=len(distinct)).astype(np.int64)

    def _matches(self, distinct: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """All matches of the pattern in order, and the piece of each."""
        word = parted = np.zeros(0, np.int64)
        two = None
        if self.plain:
            word = np.flatnonzero(pc.match_substring_regex(distinct, f"^{LETTERS}$").to_numpy(zero_copy_only=False))
            two = pc.extract_regex(distinct, f"^(?P<a>{LETTERS})(?P<b>{MARKS})$")
            parted = np.flatnonzero(pc.is_valid(two).to_numpy(zero_copy_only=False))
        other = np.ones(len(distinct), bool)
        other[word] = other[parted] = False
        other = np.flatnonzero(other)
        found = list(map(self.pattern.findall, distinct.take(pa.array(other)).to_pylist()))
        parts = [distinct.take(pa.array(word)), pa.array([x for m in found for x in m], pa.string())]
        owner = [word, np.repeat(other, [len(m) for m in found])]
        if len(parted):
            some = two.take(pa.array(parted))
            parts += [some.field("a"), some.field("b")]
            owner += [parted, parted]
        owner = np.concatenate(owner).astype(np.int64)
        order = np.argsort(owner, kind="stable")
        return owner[order], pa.concat_arrays(parts).take(pa.array(order))

    def written(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[list[bytes], list[bytes]]:
        """The ids of each text in decimal joined by commas, and the bytes
        decoded from them."""
        at, offsets = pa.array(ids), pa.array(bounds, pa.int32())
        return tuple([x.as_buffer() for x in pc.binary_join(pa.ListArray.from_arrays(offsets, values.take(at)), by)]
                     for values, by in ((self.bpe.decimal.cast(pa.binary()), b","), (self.bpe.spelt, b"")))


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """The worker's encoder for a rank file of tiktoken's text format."""
    if (path, pattern) not in _ENCODERS:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _ENCODERS[path, pattern] = Encoder(ranks, pattern)
    return _ENCODERS[path, pattern]


def _encoded(docs: DataFrame, path: str, pattern: str, rows, schema: str) -> DataFrame:
    """``rows(encoder, doc_ids, flat ids, bounds)`` makes the batch of a slice."""
    def kernel(batches):
        e = encoder(path, pattern)
        for b in batches:
            texts, ids = strings(b.column("text")), b.column("doc_id")
            for lo, hi in slices(texts):
                yield rows(e, ids.slice(lo, hi - lo), *e.encode(texts.slice(lo, hi - lo)))

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), kernel, schema)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per document: doc_id, ids (array of int)."""
    def rows(e, doc_ids, flat, bounds):
        return pa.record_batch({"doc_id": doc_ids, "ids": pa.ListArray.from_arrays(
            pa.array(bounds, pa.int32()), pa.array(flat, pa.int32()))})

    return _encoded(docs, path, pattern, rows, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and text of rows (doc_id, ids); null ids give a null text."""
    def kernel(batches):
        e = encoder(path, pattern)
        for b in batches:
            texts = [None if ids is None else e.bpe.decode(ids).decode("utf-8", "replace")
                     for ids in b.column("ids").to_pylist()]
            yield pa.record_batch({"doc_id": b.column("doc_id"), "text": pa.array(texts, pa.string())})

    return map_arrow(encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids"), kernel,
                     "doc_id long, text string")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, SHA-256 of the comma-joined ids
    and of the bytes decoded from them."""
    def rows(e, doc_ids, flat, bounds):
        ids, decoded = e.written(flat, bounds)
        return pa.record_batch({"doc_id": doc_ids, "n_tokens": pa.array(np.diff(bounds), pa.int64()),
                                "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                                "decoded_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string())})

    return _encoded(docs, path, pattern, rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
