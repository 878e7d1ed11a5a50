"""Packing (operator 5): space-filling-curve order.

1. Every whole text is tokenised once; the ids (two bytes each where the
   vocabulary allows), a hashed document vector's projection as a Hilbert key,
   and the id are written to the shared folder.
2. Documents are range-partitioned and sorted by (Hilbert key, doc_id), so
   neighbours along the curve, documents of similar tokens, come together. Equal keys
   (copies) are spread by their ids, equal rows by their place in the written
   table; no document need fit a partition's end. The number of partitions
   follows the bytes written.
3. Each partition is one stretch of the curve. Its ids are cut every
   ``length`` tokens; what is left at the end is cut into sequences of powers
   of two, which need no padding. So nothing is padded at all.

Sequence ids are (partition number << 40) + number in the partition: unique,
rising along the curve, not consecutive. Tasks are deterministic functions of
the written table, so a lost executor's tasks give the same rows again.

Defined cases: a null text counts as empty; an empty text is the end id alone;
repeated rows are packed each; null ids come first on their key and are kept;
an empty table gives an empty result; only the id and the text are read.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shipledger.llm.common import map_arrow, slices, strings
from shipledger.llm.encoded import Memory, gather
from shipledger.llm.pretokens import LETTERS, pieces, plain_parts
from shipledger.session import stage_root

LENGTH, END = 1024, 0
BUCKETS, AXES, BITS = 64, 3, 16
REMEMBERED = 1_500_000  # pieces a worker remembers
SLICE = 12 << 20  # bytes of text encoded at once, or one longer text
STRETCH = 16 << 20  # written (compressed) bytes that one stretch of the curve holds, about
INK = "[!-~\u00c0-\u024f]"  # characters that are no white space


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Index along the Hilbert curve of integer points (rows; ``bits`` a
    coordinate): the axes are transformed from the top bit down (reflections
    and exchanges by Gray code), and their bits are then interleaved."""
    x = points.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(d):
            up = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & low
            first = np.where(up, x[0] ^ low, x[0] ^ swap)
            x[i] = np.where(up, x[i], x[i] ^ swap) if i else x[i]
            x[0] = first
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[d - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


class Projector:
    """Token ids -> hashed vector of ``BUCKETS`` signed buckets -> ``AXES``
    random directions -> grid of 2**BITS steps an axis -> Hilbert key."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.bucket = rng.integers(0, BUCKETS, 1 << 16)
        self.sign = rng.choice([-1.0, 1.0], 1 << 16)
        self.axes = rng.normal(size=(BUCKETS, AXES))

    def keys(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Keys of the documents that lie between the bounds."""
        n, low = len(bounds) - 1, ids & 0xFFFF
        cell = np.repeat(np.arange(n) * BUCKETS, np.diff(bounds)) + self.bucket[low]
        v = np.bincount(cell, self.sign[low], n * BUCKETS).reshape(n, BUCKETS)
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        grid = np.floor((np.tanh(v @ self.axes) + 1) / 2 * ((1 << BITS) - 1)).astype(np.int64)
        return hilbert(grid, BITS)


class Tokens:
    """A tokenizers file whose pre-tokens never span a cut of ``pretokens``.
    Each distinct piece of a slice of texts (without the marks behind it, which
    are a piece of their own) is encoded once, many to a text and told apart by
    their lengths in bytes; a worker remembers at most ``REMEMBERED`` of them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, k in vocabulary.items():
            self.size[k] = len(token)  # a byte-level vocabulary writes each byte as one character
        self.memory = Memory(REMEMBERED)
        if any(self._ids([a + b])[0] != sum(self._ids([a, b]), []) for a in ("a", " Aé", "ɏÀ") for b in ("!", "&(", "/:@[`{~")):
            raise ValueError("the tokenizers file does not part letters from marks")
        self.fast = self._ranked(vocabulary)

    def _ranked(self, vocabulary: dict[str, int]):
        """The file's byte-level merges for the tiktoken library, which encodes
        words several times faster. It goes by ids, so ids must rise in the order
        of the merges (as they do in trained files); None where they do not."""
        import tiktoken

        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
        added = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        ranks = {bytes(byte[c] for c in t): k for t, k in vocabulary.items() if t not in added and all(c in byte for c in t)}
        own = [k for t, k in vocabulary.items() if t not in added]
        if len(ranks) != len(own) or not all(bytes([b]) in ranks for b in range(256)):
            return None
        last = -1  # the merges of the file, as its own text states them, against the ids that they make
        for pair in json.loads(self.tokenizer.to_str())["model"]["merges"]:
            made = vocabulary["".join(pair if isinstance(pair, list) else pair.split(" "))]
            if made <= last:
                return None
            last = made
        return tiktoken.Encoding("words", pat_str=r" ?\p{L}+", mergeable_ranks=ranks, special_tokens={})

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, pieces: pa.Array, together: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, one after another, and how many each has. Those that
        begin with one space and hold no other white space at their ends stand
        one behind another in a text, cut before each as in ``pieces``."""
        plain = pc.match_substring_regex(pieces, f"(?s)^ {INK}(.*{INK})?$").to_numpy(zero_copy_only=False)
        word = plain & pc.match_substring_regex(pieces, f"^{LETTERS}$").to_numpy(zero_copy_only=False)
        if not self.fast:
            word[:] = False
        parts, owner = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        odd = np.flatnonzero(~plain)
        for k, ids in zip(odd.tolist(), self._ids(pieces.take(pa.array(odd)).to_pylist()), strict=True):
            parts.append(np.array(ids, np.int32))
            owner.append(np.full(len(ids), k))
        for mask, encode in ((plain & ~word, self._ids), (word, lambda texts: map(self.fast.encode_ordinary, texts))):
            rows = np.flatnonzero(mask)
            some = pieces.take(pa.array(rows))
            width, names = pc.binary_length(some).to_numpy(zero_copy_only=False).astype(np.int64), some.to_pylist()
            texts = ["".join(names[lo: lo + together]) for lo in range(0, len(names), together)]
            for lo, ids in zip(range(0, len(rows), together), encode(texts), strict=True):
                ids = np.array(ids, np.int32)
                ends, wanted = np.cumsum(self.size[ids]), np.cumsum(width[lo: lo + together])
                at = np.searchsorted(ends, wanted)
                if not np.array_equal(ends[at], wanted):
                    raise ValueError("the tokenizers file does not split texts before single spaces")
                parts.append(ids)
                owner.append(np.repeat(rows[lo: lo + together], np.diff(at, prepend=-1)))
        owner = np.concatenate(owner)
        return np.concatenate(parts)[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(pieces)).astype(np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and the bounds of each."""
        doc, cut = pieces(texts)
        owner, parts = plain_parts(cut.dictionary)
        coded = parts.dictionary_encode()
        flat, sizes = self.memory.encode(coded.dictionary, self._new)
        number = coded.indices.to_numpy(zero_copy_only=False)
        # ids of each distinct piece, then of each place
        flat = gather(flat, sizes, number)
        sizes = np.bincount(owner, weights=sizes[number], minlength=len(cut.dictionary)).astype(np.int64)
        place = cut.indices.to_numpy(zero_copy_only=False)
        total = np.bincount(doc, weights=sizes[place], minlength=len(texts)).astype(np.int64)
        return gather(flat, sizes, place), np.concatenate([[0], np.cumsum(total)])


_TOKENS: dict[str, Tokens] = {}
_PROJECTOR: list[Projector] = []


def tokenised(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, key (Hilbert), ids (packed integers, end id included). ``path``:
    a byte-level tokenizers file that splits with the GPT-style pattern and
    adds no prefix space."""
    def kernel(batches):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if path not in _TOKENS:
            _TOKENS[path] = Tokens(path)
        if not _PROJECTOR:
            _PROJECTOR.append(Projector())
        tokens = _TOKENS[path]
        for b in batches:
            texts, doc_ids = strings(b.column("text")), b.column("doc_id")
            for lo, hi in slices(texts, SLICE):
                flat, bounds = tokens.encode(texts.slice(lo, hi - lo))
                # the end id behind each document
                ids = np.full(len(flat) + hi - lo, END, tokens.dtype)
                ids[np.arange(len(flat)) + np.repeat(np.arange(hi - lo), np.diff(bounds))] = flat
                bounds = bounds + np.arange(hi - lo + 1)
                width = tokens.dtype.itemsize
                yield pa.record_batch({
                    "doc_id": doc_ids.slice(lo, hi - lo), "key": pa.array(_PROJECTOR[0].keys(ids, bounds)),
                    "ids": pa.Array.from_buffers(pa.binary(), hi - lo, [
                        None, pa.py_buffer((bounds * width).astype(np.int32).tobytes()), pa.py_buffer(ids.tobytes())]),
                    "width": pa.array(np.full(hi - lo, width, np.int32))})

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), kernel,
                     "doc_id long, key long, ids binary, width int")


class _Packer:
    """Cuts one stretch of documents into sequences of ``length`` tokens."""

    def __init__(self, first: int, length: int):
        self.sequence, self.length = first, length
        self.open: list[tuple[int | None, int, int, np.ndarray]] = []  # doc_id, start, doc_tokens, ids
        self.filled = 0
        self.rows: list[tuple] = []

    def _put(self, pieces, size: int) -> None:
        at = 0
        for doc_id, start, total, ids in pieces:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.sequence,
                              at, size))
            at += len(ids)
        self.sequence += 1

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        start = 0
        while start < len(ids):
            take = min(self.length - self.filled, len(ids) - start)
            self.open.append((doc_id, start, len(ids), ids[start: start + take]))
            self.filled += take
            start += take
            if self.filled == self.length:
                self._put(self.open, self.length)
                self.open, self.filled = [], 0

    def finish(self) -> None:
        """The open sequence, cut into powers of two from the largest down."""
        left = self.open
        while self.filled:
            size = 1 << (self.filled.bit_length() - 1)
            taken, room = [], size
            while room:
                doc_id, start, total, ids = left[0]
                k = min(room, len(ids))
                taken.append((doc_id, start, total, ids[:k]))
                left = left[1:] if k == len(ids) else [(doc_id, start + k, total, ids[k:]), *left[1:]]
                room -= k
            self._put(taken, size)
            self.filled -= size


_COLUMNS = [("doc_id", "long", pa.int64()), ("start", "long", pa.int64()), ("length", "long", pa.int64()),
            ("ids_crc32", "long", pa.int64()), ("doc_tokens", "long", pa.int64()), ("sequence_id", "long", pa.int64()),
            ("offset", "long", pa.int64()), ("padded_to", "long", pa.int64())]


def stretches(spark: SparkSession, folder: str) -> int:
    """Stretches of the curve: by the bytes written, and one a core at least."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    size = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    return max(spark.sparkContext.defaultParallelism, -(-size // STRETCH))


def pack(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, padded_to (the sequence's size)."""
    spark = docs.sparkSession
    import uuid

    # ids are dense data: zstd keeps the written stage near its entropy
    folder = f"{stage_root(spark)}/stages/packing-{uuid.uuid4().hex}"
    tokenised(docs, path).write.option("compression", "zstd").parquet(folder)
    # rows are told apart by their place, so that any number of equal ones can be split
    placed = spark.read.parquet(folder).withColumn(
        "place", F.xxhash64(F.col("_metadata.file_name"), F.col("_metadata.row_index")))
    order = ["key", "doc_id", "place"]
    ordered = placed.repartitionByRange(stretches(spark, folder), *order).sortWithinPartitions(*order)

    def kernel(batches):
        packer = _Packer(TaskContext.get().partitionId() << 40, length)

        def rows():
            got, packer.rows = packer.rows, []
            return pa.record_batch([pa.array([r[k] for r in got], t) for k, (_, _, t) in enumerate(_COLUMNS)],
                                   names=[c for c, _, _ in _COLUMNS])

        for b in batches:
            for doc_id, raw, width in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist(),
                                          b.column("width").to_pylist(), strict=True):
                packer.add(doc_id, np.frombuffer(raw, f"<u{width}"))
                if len(packer.rows) > 20_000:
                    yield rows()
        packer.finish()
        yield rows()

    return map_arrow(ordered, kernel, ", ".join(f"{c} {t}" for c, t, _ in _COLUMNS))
