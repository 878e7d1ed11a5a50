"""SentencePiece encoding and decoding (operator 13): distinct-chunk table.

In a model whose pieces hold the white-space marker only at their front, no
merge can join a character to a marker that follows it. A text is therefore cut
into chunks, each a run of markers and what follows up to the next marker, and
a chunk is segmented the same wherever it stands.

1. A slice of texts (``SLICE`` bytes, or one longer text) is cut into chunks
   and gives a table of its distinct ones; a text becomes the numbers of its
   chunks, in order.
2. Each distinct chunk of the table is segmented once: merges by highest score,
   leftmost first, then bytes for characters without a piece. Chunks of
   like length are segmented together: a matrix of symbols, in which every
   chunk takes its best merge in each round. Longer chunks use a heap.
3. The ids are joined back by position: numbers index the table, and the ids of
   all documents of the slice are gathered at once.

One narrow pass: no shuffle, nothing broadcast but a model path. Memory is that
of one slice, and of at most ``REMEMBERED`` chunks that a worker keeps. (One table for the whole corpus,
joined by shuffles, would write over three times the input: a quarter of all
words are new to their slice where words are as varied as in the test corpora.)

Needs a BPE model with identity normalisation, a dummy prefix, byte fallback
and no user-defined or unused pieces; the loader holds a few probes against
the library and refuses another model.

Defined cases: a null text counts as empty; an empty text has the begin and
end ids only; a literal U+2581 counts as a space, as in the library; repeated
rows, null and repeated ids keep their rows, as rows are never matched by id;
an empty table gives an empty result; only id and text are read, so extra
columns may have any name. Decoding drops control ids, writes " \\u2047 " for
the unknown id and U+FFFD for every byte that is no UTF-8; null ids give null.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shipledger.llm.common import map_arrow, slices, strings
from shipledger.llm.encoded import Memory, gather

MARK = "▁"
SLICE = 8 << 20
REMEMBERED = 500_000  # chunks a worker remembers
WIDTHS = (8, 12, 16, 24, 48)  # characters of chunks that are segmented together
TOGETHER = 1 << 13  # chunks in a matrix
PROBES = ["", " ", "a  b ", " ▁x", "ﬁ Ａ\t\n", "<s>x</s><0x0A>", "漢字\U0001F600\x00", "   "]

NONE = 1 << 30

codecs.register_error("each-byte", lambda e: ("�" * (e.end - e.start), e.end))


class Model:
    """Pieces, scores and byte ids of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        self.begin, self.end, self.unknown = sp.bos_id(), sp.eos_id(), sp.unk_id()
        self.piece: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.byte: list[int] = [self.unknown] * 256
        written_as: list[bytes] = []
        for k in ids:
            name = sp.id_to_piece(k)
            if sp.is_control(k):
                written_as.append(b"")
            elif sp.is_unknown(k):
                written_as.append(" ⁇ ".encode())
            elif sp.is_byte(k):
                value = int(name[1:-1], 16)
                self.byte[value] = k
                written_as.append(bytes([value]))
            elif sp.is_unused(k) or MARK in name.lstrip(MARK):
                raise ValueError("pieces must be used and hold the marker at their front only")
            else:
                self.piece[name], self.score[name] = k, sp.get_score(k)
                written_as.append(name.replace(MARK, " ").encode())
        self.bytes_of = pa.array(written_as, pa.binary())
        self.silent = np.array([sp.is_control(k) for k in ids])
        self.marked = np.array([sp.id_to_piece(k).startswith(MARK) for k in ids])
        self.memory = Memory(REMEMBERED)
        self._pairs()
        for text in PROBES:
            mine = self.table(cut(pa.array([text]))[1])[0].tolist()
            if mine != sp.encode(text) or self.decode([mine]) != [sp.decode(mine)]:
                raise ValueError("the model normalises, or has pieces of a kind that this method does not cover")

    def _pairs(self) -> None:
        """Symbols are piece ids, and further numbers for characters that only
        occur inside pieces; which two symbols make which piece."""
        size = len(self.bytes_of)
        inside = sorted({c for p in self.piece for c in p}.difference(self.piece))
        symbol = {**self.piece, **{c: size + k for k, c in enumerate(inside)}}
        self.extra = size + len(inside)  # from here on: characters seen in a batch only
        points = sorted((ord(c), k) for c, k in symbol.items() if len(c) == 1)
        self.points, self.point_symbol = (np.array(x, np.int64) for x in zip(*points, strict=True))
        left, right, made = [], [], []
        for p, k in self.piece.items():
            for i in range(1, len(p)):
                a, b = symbol.get(p[:i]), symbol.get(p[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    made.append(k)
        keys = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        order = np.argsort(keys)
        self.keys, self.made = keys[order], np.array(made, np.int32)[order]
        score = np.zeros(size)
        score[list(self.piece.values())] = [self.score[p] for p in self.piece]
        # ranks: the least is merged first; equal scores share one
        self.rank = np.unique(-score[self.made], return_inverse=True)[1].astype(np.int32)

    def _look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, piece) that two symbols make; the rank is high where none."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.rank[at], np.int32(NONE)), self.made[at]

    def _merge(self, symbols: np.ndarray, n: np.ndarray) -> None:
        """Segment the rows of ``symbols`` (the first n[i] of row i) in place."""
        rows = np.flatnonzero(n > 1)
        x, m = symbols[rows], n[rows]
        rank, made = self._look(x[:, :-1], x[:, 1:])
        place = np.arange(x.shape[1])
        rank[place[None, 1:] >= m[:, None]] = NONE
        while len(rows):
            best = rank.argmin(1)
            every = np.arange(len(rows))
            go = rank[every, best] < NONE
            if not go.all():
                done = rows[~go]
                symbols[done], n[done] = x[~go], m[~go]
                rows, x, m, rank, made, best = rows[go], x[go], m[go], rank[go], made[go], best[go]
                every = every[: len(rows)]
                if not len(rows):
                    return
            x[every, best] = made[every, best]
            # close the gap behind the merged symbol, then look at its two sides
            later = place[None, :-2] >= best[:, None]
            np.copyto(x[:, 1:-1], x[:, 2:].copy(), where=later)
            np.copyto(rank[:, :-1], rank[:, 1:].copy(), where=later)
            np.copyto(made[:, :-1], made[:, 1:].copy(), where=later)
            m -= 1
            rank[:, -1] = NONE
            for side in (best - 1, best):
                ok = (side >= 0) & (side + 1 < m)
                at, side = every[ok], side[ok]
                rank[at, side], made[at, side] = self._look(x[at, side], x[at, side + 1])
            end = best + 1 >= m
            rank[every[end], np.minimum(best[end], rank.shape[1] - 1)] = NONE

    def table(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks, one after another, and how many each has."""
        length = pc.utf8_length(chunks).to_numpy(zero_copy_only=False).astype(np.int64)
        sizes, parts = np.zeros(len(chunks), np.int64), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        low = 0
        for width in WIDTHS:
            rows = np.flatnonzero((length > low) & (length <= width))
            low = width
            for at in range(0, len(rows), TOGETHER):
                some = rows[at: at + TOGETHER]
                flat, sizes[some] = self._matrix(chunks.take(pa.array(some)).to_pylist(), length[some], width)
                parts.append((np.repeat(some, sizes[some]), flat))
        for k in np.flatnonzero(length > low).tolist():
            ids = np.array(self.segment(chunks[k].as_py()), np.int64)
            sizes[k] = len(ids)
            parts.append((np.full(len(ids), k), ids))
        owner, flat = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        return flat[np.argsort(owner, kind="stable")], sizes

    def _matrix(self, chunks: list[str], n: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        points = np.array(chunks, f"<U{width}").view(np.uint32).reshape(len(chunks), width).astype(np.int64)
        points[points == ord(" ")] = ord(MARK)
        at = np.minimum(np.searchsorted(self.points, points), len(self.points) - 1)
        known = self.points[at] == points
        x = np.where(known, self.point_symbol[at], self.extra + points).astype(np.int32)
        m = n.copy()
        self._merge(x, m)
        flat = x[np.arange(width)[None] < m[:, None]].astype(np.int64)
        # symbols that are no piece become the bytes of their character
        odd = flat >= len(self.bytes_of)
        if not odd.any():
            return flat, m
        each, back = np.unique(flat[odd], return_inverse=True)
        of = {int(s): int(p) for s, p in zip(self.point_symbol, self.points, strict=True)}
        spelt = [[self.byte[b] for b in chr(of.get(int(s), int(s) - self.extra)).encode()] for s in each]
        wide = np.ones(len(flat), np.int64)
        wide[odd] = np.array([len(v) for v in spelt])[back]
        out = np.repeat(flat, wide)
        first = (np.cumsum(wide) - wide)[odd]
        for j in range(4):
            has = np.array([j < len(v) for v in spelt])[back]
            out[first[has] + j] = np.array([v[j] if j < len(v) else 0 for v in spelt])[back][has]
        owner = np.repeat(np.arange(len(m)), m)
        return out, np.bincount(owner, weights=wide, minlength=len(m)).astype(np.int64)

    def segment(self, chunk: str) -> list[int]:
        """Ids of one chunk (its spaces stand for markers)."""
        part = list(chunk.replace(" ", MARK))
        n, score = len(part), self.score
        after, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []
        for i in range(n - 1):
            s = score.get(part[i] + part[i + 1])
            if s is not None:
                heap.append((-s, i, part[i], part[i + 1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if part[i] != a or j >= n or part[j] != b:
                continue  # one of the two has been merged since
            part[i], part[j] = a + b, ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                s = score.get(part[i] + part[after[i]])
                if s is not None:
                    heapq.heappush(heap, (-s, i, part[i], part[after[i]]))
            if before[i] >= 0:
                h = before[i]
                s = score.get(part[h] + part[i])
                if s is not None:
                    heapq.heappush(heap, (-s, h, part[h], part[i]))
        out: list[int] = []
        for p in part:
            if p:
                k = self.piece.get(p)
                out += [k] if k is not None else [self.byte[x] for x in p.encode()]
        return out

    def decode(self, lists: list[list[int]]) -> list[str]:
        sizes = np.array([0, *map(len, lists)])
        flat = np.concatenate([np.asarray(x, np.int64) for x in lists]) if lists else np.zeros(0, np.int64)
        return [b.decode("utf-8", "each-byte") for b in self.join(flat, np.cumsum(sizes))]

    def join(self, flat: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The bytes that each stretch of ids stands for, without the dummy
        prefix (the front marker of its first piece that is no control id)."""
        pieces = self.bytes_of.take(pa.array(flat))
        offsets = np.frombuffer(pieces.buffers()[1], np.int32, len(pieces) + 1, pieces.offset * 4)
        data, ends = pieces.buffers()[2], offsets[bounds]
        raw = data.to_pybytes() if data is not None else b""
        spoken = np.append(np.flatnonzero(~self.silent[flat]), len(flat))
        first = spoken[np.searchsorted(spoken, bounds[:-1])]
        prefix = np.append(self.marked[flat], False)[first] & (first < bounds[1:])
        return [raw[a: b] for a, b in zip((ends[:-1] + prefix).tolist(), ends[1:].tolist(), strict=True)]


def cut(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Chunks of all texts in order, and the text each belongs to. Every part
    between single spaces has one space before it (the first one the dummy
    prefix); an empty part lends its space to the part behind it."""
    texts = pc.replace_substring(texts, MARK, " ")
    lists = pc.split_pattern(texts, " ")
    flat = lists.flatten()
    doc = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    empty = pc.binary_length(flat).to_numpy(zero_copy_only=False) == 0
    if not empty.any():
        return doc, pc.binary_join_element_wise(pa.scalar(""), flat, " ")
    blank = pc.binary_length(texts).to_numpy(zero_copy_only=False) == 0
    last = np.append(doc[1:] != doc[:-1], True)
    ends = np.flatnonzero(~empty | last)  # the part that closes each chunk
    starts = np.concatenate([[0], ends[:-1] + 1])
    spaces = ends - starts + 1
    kept = ~blank[doc[ends]]
    ends, spaces = ends[kept], spaces[kept]
    widest = int(spaces.max()) if len(spaces) else 0
    if widest <= 4096:
        front = pa.array([" " * k for k in range(widest + 1)]).take(pa.array(spaces))
    else:
        front = pa.array([" " * k for k in spaces.tolist()], pa.string())
    return doc[ends], pc.binary_join_element_wise(front, flat.take(pa.array(ends)), "")


_MODELS: dict[str, Model] = {}


def model(path: str) -> Model:
    if path not in _MODELS:
        _MODELS[path] = Model(path)
    return _MODELS[path]


def _encoded(docs: DataFrame, path: str, rows, schema: str) -> DataFrame:
    """``rows(model, doc_ids, flat ids, bounds)`` makes the batch of some
    documents, whose ids (begin and end included) lie one after another."""
    def kernel(batches):
        m = model(path)
        for b in batches:
            texts, doc_ids = strings(b.column("text")), b.column("doc_id")
            for lo, hi in slices(texts, SLICE):
                n = hi - lo
                doc, chunks = cut(texts.slice(lo, n))
                coded = chunks.dictionary_encode()
                ids, size = m.memory.encode(coded.dictionary, m.table)
                number = coded.indices.to_numpy(zero_copy_only=False)
                many = size[number]
                total = np.bincount(doc, weights=many, minlength=n).astype(np.int64) + 2
                bounds = np.concatenate([[0], np.cumsum(total)])
                flat = np.empty(bounds[-1], np.int64)
                inner = np.ones(len(flat), bool)
                inner[bounds[:-1]] = inner[bounds[1:] - 1] = False
                flat[bounds[:-1]], flat[bounds[1:] - 1] = m.begin, m.end
                flat[inner] = gather(ids, size, number)
                yield rows(m, doc_ids.slice(lo, n), flat, bounds)

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), kernel, schema)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: doc_id, ids (begin and end included)."""
    def rows(m, doc_ids, flat, bounds):
        return pa.record_batch({"doc_id": doc_ids, "ids": pa.ListArray.from_arrays(
            pa.array(bounds, pa.int32()), pa.array(flat, pa.int32()))})

    return _encoded(docs, path, rows, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows (doc_id, ids)."""
    def kernel(batches):
        m = model(path)
        for b in batches:
            lists = b.column("ids").to_pylist()
            texts = iter(m.decode([x for x in lists if x is not None]))
            yield pa.record_batch({"doc_id": b.column("doc_id"), "text": pa.array(
                [None if x is None else next(texts) for x in lists], pa.string())})

    return map_arrow(encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids"), kernel, "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, SHA-256 of its ids (little-endian,
    four bytes) and of the text decoded from them."""
    def rows(m, doc_ids, flat, bounds):
        raw, at = memoryview(flat.astype("<u4")).cast("B"), (bounds * 4).tolist()
        texts = m.join(flat, bounds)
        for k, t in enumerate(texts):
            try:
                t.decode()
            except UnicodeDecodeError:
                texts[k] = t.decode("utf-8", "each-byte").encode()
        return pa.record_batch({
            "doc_id": doc_ids, "n_tokens": pa.array(np.diff(bounds), pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(raw[x:y]).hexdigest() for x, y in zip(at, at[1:], strict=False)]),
            "decoded_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts])})

    return _encoded(docs, path, rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
