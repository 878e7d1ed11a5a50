import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from shipledger.llm import queries
from shipledger.llm import word_runs as R
from shipledger.llm.common import Words


def brute(words, shortest=12):
    """Every distance against every place."""
    n, out, number = len(words), {}, {}
    c = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    for q in range(1, n // 2 + 1):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (c[:-q] == c[q:]).view(np.int8), [0]])))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a + q >= max(shortest, 2 * q):
                out.setdefault((a, b - a + q), q)
    return sorted((s, length, q) for (s, length), q in out.items())


def runs(texts, shortest=12):
    w = Words(pa.array([" ".join(t) for t in texts]))
    r = R.Runs(w.codes, w.doc, w.n, w.start, shortest)
    got = [[] for _ in texts]
    for d, s, length, p in zip(r.of.tolist(), r.start.tolist(), r.length.tolist(), r.period.tolist(), strict=True):
        got[d].append((s - int(w.start[d]), length, p))
    return got


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def texts(seed, n=150):
    rnd = random.Random(seed)
    for _ in range(n):
        k, size = rnd.choice([1, 2, 3, 5, 50]), rnd.randint(0, 300)
        w = [str(rnd.randrange(k)) for _ in range(size)]
        if rnd.random() < 0.5 and size > 5:
            a = rnd.randrange(size)
            p = 1 + rnd.randrange(max(1, (size - a) // 2))
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(size)]
        yield w * rnd.choice([1, 1, 2, 5])


@pytest.mark.parametrize("seed", range(4))
def test_all_runs_of_random_texts(seed):
    sample = list(texts(seed))
    assert runs(sample) == [brute(w) for w in sample]


def test_all_runs_of_hard_texts():
    sample = [fibonacci(1500), ["a"] * 3000, list("ab" * 900), [str(i) for i in range(700)] * 3, ["a"] * 11, ["a"] * 12,
              [str(i) for i in range(6)] * 2, list("aab" * 40) + ["x"] + list("aab" * 40), []]
    assert runs(sample) == [brute(w) for w in sample]
    assert runs(sample, 2) == [brute(w, 2) for w in sample]


def test_texts_do_not_run_into_each_other():
    assert runs([["a"] * 8, ["a"] * 8, ["a"] * 8]) == [[], [], []]


def test_long_text_in_little_time():
    w = [str(i % 50_021) for i in range(400_000)]
    assert runs([w]) == [[(0, 400_000, 50_021)]]
    assert runs([["a"] * 400_000]) == [[(0, 400_000, 1)]]


def test_occurrences_are_those_of_a_plain_search():
    rng = np.random.default_rng(1)
    small = rng.integers(0, 2, 400).astype(float)
    padded = np.concatenate([small, np.zeros(600)])
    for block, low, high in [(2, 1, 6), (4, 7, 14), (32, 63, 126), (32, 127, 254)]:
        starts = np.arange(0, 300, block)
        got = set(zip(*(x.tolist() for x in R.occurrences(padded, starts, block, low, high)), strict=True))
        assert got == {(s, d) for s in starts.tolist() for d in range(low, high + 1)
                       if (padded[s: s + block] == padded[s + d: s + d + block]).all()}


def test_odd_rows(spark, odd_docs, no_docs):
    got = R.detect(odd_docs).collect()
    want = [(r.doc_id, (r.text or "").split()) for r in odd_docs.collect()]
    assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs]) for r in got), key=str) == sorted(
        ((d, len(w), brute(w) if len(w) < 10_000 else runs([w])[0]) for d, w in want), key=str)
    assert R.detect(no_docs).count() == 0


def test_query_of_cycled_documents(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rnd.randint(0, 90))))
            for i in range(200)] + [(500, None), (501, ""), (502, "\t\n ")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op11_word_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    cycled = 0
    for doc_id, text in rows:
        w = (text or "").split()
        n, h = len(w), zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a, cycled = g % n, cycled + 1
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        b = brute(w)
        gone = {i for s, length, q in b for i in range(s + q, s + length)}
        best = min(b, key=lambda x: (-x[1], x[0], x[2])) if b else (None, None, None)
        r = got[doc_id]
        assert (r.n_runs, r.start, r.length, r.period) == (len(b), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if b else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in b).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()
    assert cycled > 10
