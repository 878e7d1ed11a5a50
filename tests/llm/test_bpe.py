import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from shipledger.llm import byte_bpe as B
from shipledger.llm.encoded import Memory
from shipledger.llm.pretokens import pieces

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def same(reference, text):
    e = B.encoder(PATH, P.PATTERN)
    expected = reference.encode_ordinary(text)
    for _ in range(2):  # pieces new, then remembered
        ids, bounds = e.encode(pa.array([text, "", text]))
        (joined, nothing, again), decoded = e.written(ids, bounds)
        if not (ids[: bounds[1]].tolist() == expected and bytes(joined) == bytes(again) == ",".join(map(str, expected)).encode()
                and bytes(nothing) == b"" and bytes(decoded[0]) == text.encode()):
            return False
    return e.ids(text) == expected


def test_random_texts(reference):
    rnd = random.Random(3)
    parts = ["a", "b", "the", " ", "  ", "\n", "é", "日本", "😀", "1", "23", "'s", "'", "!", "ing", "\t", "ß", "\x1c", "aaaa", "ab",
             " ", " ", "'ll", "<|endoftext|>"]
    for _ in range(3000):
        assert same(reference, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    ranks = B.encoder(PATH, P.PATTERN).bpe.ranks
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert same(e, text)


@pytest.mark.parametrize("text", ["a" * 30_000, "ab" * 15_000, "日本語" * 5_000, "é" * 9_000, " " * 5_000, "x \n  y" * 2_000])
def test_long_pieces(reference, text):
    assert same(reference, text)


def merged(data, ranks):
    parts = [data[i: i + 1] for i in range(len(data))]
    while len(parts) > 1:
        k = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 10**9))
        if parts[k] + parts[k + 1] not in ranks:
            break
        parts[k: k + 2] = [parts[k] + parts[k + 1]]
    return parts


def test_small_vocabularies_equal_merging():
    rnd = random.Random(8)
    for _ in range(60):
        ranks = {bytes([c]): i for i, c in enumerate(b"abc")}
        tokens = list(ranks)
        while len(ranks) < 14:  # each new token joins two that the earlier merges leave side by side, as training does
            t = rnd.choice(tokens) + rnd.choice(tokens)
            if t not in ranks and len(t) < 8 and len(merged(t, ranks)) == 2:
                ranks[t] = len(ranks)
                tokens.append(t)
        bpe = B.Bpe(ranks)
        for _ in range(40):
            data = bytes(rnd.choice(b"abc") for _ in range(rnd.randint(0, 25)))
            assert bpe.encode(data) == [ranks[p] for p in merged(data, ranks)], (ranks, data)


def test_pieces_are_not_cut_in_runs():
    def cut(*texts):
        doc, coded = pieces(pa.array(texts, pa.string()))
        return list(zip(doc.tolist(), coded.to_pylist(), strict=True))

    assert cut("a b", "", "b") == [(0, "a"), (0, " b"), (1, ""), (2, "b")]
    assert cut("a   b") == [(0, "a"), (0, "  "), (0, " b")] and cut("a\n ") == [(0, "a\n ")]
    assert cut("x\n  y") == [(0, "x\n "), (0, " y")] and cut("a\u00a0 \u00a0b") == [(0, "a\u00a0 \u00a0b")]
    assert cut() == []


def test_memory_forgets_what_is_not_used():
    m = Memory(4)
    made = []

    def make(new):
        made.append(new.to_pylist())
        return np.array([len(x) for x in new.to_pylist()], np.int32), np.ones(len(new), np.int64)

    for words in (["a", "bb", "ccc"], ["a", "dddd"], ["a", "eeeee", "f" * 60], ["a", "eeeee"]):
        flat, sizes = m.encode(pa.array(words), make)
        assert flat.tolist() == [len(w) for w in words] and sizes.tolist() == [1] * len(words)
    assert made == [["a", "bb", "ccc"], ["dddd"], ["eeeee", "f" * 60], []] and len(m.keys) <= 4


def test_batches_equal_single_walks():
    rnd = random.Random(4)
    bpe = B.encoder(PATH, P.PATTERN).bpe
    words = ["".join(rnd.choice("abcdefghiéß日") for _ in range(rnd.randint(0, 70))) for _ in range(3000)]
    flat, sizes = bpe.encode_all(words)
    assert flat.tolist() == [t for w in words for t in bpe.encode(w.encode())] and sizes.sum() == len(flat)


def test_query_rows(spark, reference, odd_docs, no_docs):
    rows = B.digests(odd_docs, PATH, P.PATTERN).collect()
    texts = [r.text or "" for r in odd_docs.collect()]
    expected = sorted((len(ids := reference.encode_ordinary(t)),
                       hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                       hashlib.sha256(t.encode()).hexdigest()) for t in texts)
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == expected
    assert B.digests(no_docs, PATH, P.PATTERN).count() == 0
    back = B.decode(B.encode(odd_docs, PATH, P.PATTERN), PATH, P.PATTERN).collect()
    assert sorted(r.text for r in back) == sorted(texts)
