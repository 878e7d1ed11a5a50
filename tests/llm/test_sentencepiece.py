import collections
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece

from shipledger.llm import chunk_pieces as C

PATH = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return C.Model(PATH)


def messy(seed, n=600):
    rnd = random.Random(seed)
    alphabet = [*"ab  ▁\t\n漢é😀zéE.,'ⅷ�", "the", "ing", " ▁ ", "\x00", "<s>", "<0x0A>", "    ", " "]
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_chunks_give_the_library_s_ids(model, library, seed):
    texts = messy(seed)
    doc, chunks = C.cut(pa.array(texts))
    ids = collections.defaultdict(list)
    for d, c in zip(doc.tolist(), chunks.to_pylist(), strict=True):
        ids[d] += model.segment(c)
    assert [ids[k] for k in range(len(texts))] == [library.encode(t) for t in texts]


def test_decoding_any_ids(model, library):
    rnd = random.Random(9)
    lists = [[rnd.choice([rnd.randrange(32_000), rnd.randrange(262)]) for _ in range(rnd.randint(0, 20))] for _ in range(1500)]
    assert model.decode(lists) == [library.decode(x) for x in lists]


def test_long_chunk_in_little_time(model, library):
    text = "".join(random.Random(3).choice("abcdefgh漢") for _ in range(100_000))
    assert model.segment(" " + text) == library.encode(text)


def digest(library, text):
    ids = library.encode(text or "", add_bos=True, add_eos=True)
    return (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256(library.decode(ids).encode()).hexdigest())


def test_whole_corpus(corpus, library):
    docs = corpus[0]
    got = {r.doc_id: tuple(r)[1:] for r in C.digests(docs, PATH).collect()}
    assert got == {r.doc_id: digest(library, r.text) for r in docs.collect()}


def test_odd_rows_and_small_slices(odd_docs, no_docs, library, monkeypatch):
    want = collections.Counter((r.doc_id, *digest(library, r.text)) for r in odd_docs.collect())
    assert collections.Counter(map(tuple, C.digests(odd_docs, PATH).collect())) == want
    assert C.digests(no_docs, PATH).count() == 0 and C.encode(no_docs, PATH).count() == 0


def test_round_trip(spark, library):
    texts = messy(11, 300)
    docs = spark.createDataFrame([(i % 280 or None, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    encoded = C.encode(docs, PATH)
    want = collections.Counter((i % 280 or None, t.replace("▁", " ")) for i, t in enumerate(texts))
    assert collections.Counter(map(tuple, C.decode(encoded, PATH).collect())) == want
    assert {tuple(r.ids) for r in encoded.collect()} == {tuple(library.encode(t, add_bos=True, add_eos=True)) for t in texts}
    null = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert C.decode(null, PATH).first().text is None
