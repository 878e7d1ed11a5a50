import collections
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from shipledger.llm import curve_packing as C

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def check(rows, texts, tokenizer, length=1024):
    """texts: list of (doc_id, text). Every id is in one piece, and sequences are whole."""
    want = collections.Counter()
    for d, t in texts:
        want[d, tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0])] += 1
    by_doc = collections.defaultdict(list)
    for (d, ids), n in want.items():
        by_doc[d].append((ids, n))
    pieces = collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows)
    for d, options in by_doc.items():
        mine = [p for p in pieces.elements() if p[0] == d]
        assert sum(p[2] for p in mine) == sum(len(ids) * n for ids, n in options)
        for _, start, size, crc, total in mine:
            assert any(len(ids) == total and zlib.crc32(np.array(ids[start: start + size], "<u4").tobytes()) == crc
                       for ids, _ in options)
        if sum(n for _, n in options) == 1:
            at = 0
            for _, start, size, _, _ in sorted(mine):
                assert start == at
                at += size
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length, r.padded_to))
    for s in sequences.values():
        at = 0
        for offset, size, _ in sorted(s):
            assert offset == at and size > 0
            at += size
        assert at == s[0][2] and (at == length or at < length and at & (at - 1) == 0)
    assert {r.doc_id for r in rows} == set(by_doc)


def test_hilbert_is_a_curve():
    grid = np.array([(i, j, k) for i in range(8) for j in range(8) for k in range(8)])
    key = C.hilbert(grid, 3)
    assert sorted(key) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_pieces_hold_every_id_once(corpus, tokenizer):
    docs = corpus[0]
    rows = C.pack(docs, PATH).collect()
    check(rows, [(r.doc_id, r.text) for r in docs.collect()], tokenizer)


def test_odd_rows(odd_docs, no_docs, tokenizer):
    check(C.pack(odd_docs, PATH).collect(), [(r.doc_id, r.text) for r in odd_docs.collect()], tokenizer)
    assert C.pack(no_docs, PATH).count() == 0


def test_remembered_pieces_equal_whole_texts(tokenizer):
    texts = ["", " ", "a", " a", "a ", "a  b", "a \n b", "x\n\n y", "it's 'll ok", "é日本 😀 b", "<|endoftext|> x", "a\u00a0 b",
             "a \u2003b", "tab\t x", "1 2 33", "end \n ", "\x1c x", "a \x1c b"]
    texts += ["a<|endoftext|>b", "<|endoftext|>", "x <|endoftext|> y", "x  <|endoftext|>  y", "<|endoftext|><|endoftext|> z.",
              "x\n<|endoftext|>\n y", "<|endoftext|", "a <|endoftext|>."]
    rnd = random.Random(1)
    parts = ["a", "the", " ", "  ", "\n", "é", "日本", "12", "'s", "!", "\t", "\u00a0", "<|endoftext|>", "x.", " \n"]
    texts += ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(2000)]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    tokens = C.Tokens(PATH)
    for _ in range(2):  # pieces new, then remembered
        flat, bounds = tokens.encode(pa.array(texts))
        assert [flat[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == want
    assert 50256 in want[texts.index("a<|endoftext|>b")]


def test_many_equal_rows_are_split(spark, tokenizer):
    docs = spark.createDataFrame([(None, "some words that are the same")] * 4000, "doc_id long, text string")
    rows = C.pack(docs, PATH).collect()
    check(rows, [(None, "some words that are the same")] * 4000, tokenizer)
    assert len({r.sequence_id >> 40 for r in rows}) >= 3


def test_neighbours_on_the_curve_are_alike():
    rng = np.random.default_rng(0)
    topics = [rng.integers(0, 50_000, 40) for _ in range(6)]
    docs = [(k, rng.choice(t, 200)) for k, t in enumerate(topics) for _ in range(40)]
    sizes = [len(d) for _, d in docs]
    key = C.Projector().keys(np.concatenate([d for _, d in docs]), np.concatenate([[0], np.cumsum(sizes)]))
    topic = np.array([k for k, _ in docs])[np.argsort(key, kind="stable")]
    assert (topic[1:] == topic[:-1]).mean() > 0.5  # one in six by chance
