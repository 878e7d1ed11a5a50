import hashlib
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from shipledger.llm import embedding_dedup as E
from shipledger.llm import simhash_dedup as S
from shipledger.llm import substring_dedup as U
from shipledger.llm.common import Words
from shipledger.llm.graph import components


def roots(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + i // 2, 100 + i) for i in range(1, 40)]
    edges += [(500, 500 + i) for i in range(1, 300)] + [(rnd.randint(2000, 2200), rnd.randint(2000, 2200)) for _ in range(90)]
    edges += [(7, 7), (3, 4)]
    rnd.shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b", "t").collect()}
    proper = [e for e in edges if e[0] != e[1]]
    assert got == roots({n for e in proper for n in e}, proper)
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b", "t").count() == 0


# SimHash ---------------------------------------------------------------------

def brute_fp(text, shingle=4):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not ws:
        return 0
    grams = [" ".join(ws[i: i + shingle]) for i in range(max(1, len(ws) - shingle + 1))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_groups(rows, distance=4):
    fps = [(d, brute_fp(t)) for d, t in rows]
    distinct = sorted({f for _, f in fps})
    edges = [(a, b) for i, a in enumerate(distinct) for b in distinct[i + 1:] if bin(a ^ b).count("1") <= distance]
    root = roots(distinct, edges)
    low = {}
    for d, f in fps:
        if d is not None:
            low[root[f]] = min(d, low.get(root[f], d))
    return sorted(((d, f"{f:016x}", low.get(root[f])) for d, f in fps), key=str)


def digest(found):
    return sorted(((r.doc_id, f"{r.fp & (2**64 - 1):016x}", r.component_id) for r in found.collect()), key=str)


def near_texts(seed=3):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    rows, d = [], 0
    for _ in range(12):
        base = [word() for _ in range(rnd.choice([3, 30, 400]))]
        for _ in range(rnd.randint(1, 12)):
            v = list(base)
            for _ in range(rnd.randint(0, 2)):
                v[rnd.randrange(len(v))] = word().upper()
            rows.append((d, rnd.choice([" ", "\n"]).join(v)))
            d += 1
    return rows + [(d, ""), (d + 1, None), (None, rows[4][1]), (d + 3, " \t"), (None, "alone here"), rows[0], rows[0]]


def test_fingerprints_equal_brute_force(spark):
    rows = near_texts()
    got = S.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.fp & (2**64 - 1)) for r in got) == sorted((str(d), brute_fp(t)) for d, t in rows)


def test_simhash_groups_equal_brute_force(spark, corpus):
    rows = near_texts()
    assert digest(S.groups(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_groups(rows)
    docs = corpus[0].where("doc_id < 400")
    assert digest(S.groups(docs)) == brute_groups([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("match", [2, 3])
def test_full_cells_are_split_without_loss(spark, monkeypatch, match):
    monkeypatch.setattr(S, "BLOCK", 16)
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**63, 3, dtype=np.uint64)
    fps = {int(b) ^ sum(1 << int(x) for x in rng.choice(64, rng.integers(0, 5), replace=False)) for b in base for _ in range(80)}
    fps = sorted(fps | {int(x) for x in rng.integers(0, 2**63, 100, dtype=np.uint64)})
    signed = [(f - 2**64 if f >> 63 else f,) for f in fps]
    edges = S.links(spark.createDataFrame(signed, "fp long"), 4, match).collect()
    pairs = [(a, b) for i, a in enumerate(fps) for b in fps[i + 1:] if bin(a ^ b).count("1") <= 4]
    got = [(r.a & (2**64 - 1), r.b & (2**64 - 1)) for r in edges]
    assert all(bin(a ^ b).count("1") <= 4 for a, b in got)
    assert roots(fps, got) == roots(fps, pairs)
    assert len(got) < len(pairs) * 2


def test_embedding_is_a_lower_bound(spark):
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**64 - 1, 500, dtype=np.uint64)
    b = a ^ rng.integers(0, 2**64 - 1, 500, dtype=np.uint64) & rng.integers(0, 2**64 - 1, 500, dtype=np.uint64)
    l1 = np.abs(S._segment_counts(a) - S._segment_counts(b)).sum(1)
    assert (l1 <= np.bitwise_count(a ^ b)).all() and (l1 > 0).any()
    row = spark.createDataFrame([(int(x),) for x in a.view(np.int64)[:50]], "fp long").select("fp", S.embedding(F.col("fp")).alias("e"))
    for r in row.collect():
        e = r.e & (2**64 - 1)
        assert [e >> s & 3 for s in range(0, 64, 2)] == S._segment_counts(np.array([r.fp], np.int64).view(np.uint64))[0].tolist()


def test_simhash_odd_rows(odd_docs, no_docs):
    assert digest(S.groups(odd_docs)) == brute_groups([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert S.groups(no_docs).count() == 0
    kept = S.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 4]
    assert S.keep_one(no_docs).count() == 0


def test_keep_one_leaves_one_row_of_each_group(spark, odd_docs):
    """Rows without an id, repeated ids and repeated rows are judged row by row."""
    def kept(df):
        return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)

    long_text = next(r.text for r in odd_docs.collect() if r.doc_id == 4)
    assert kept(S.keep_one(odd_docs)) == sorted(
        [(1, "alpha beta gamma"), (2, None), (None, "lost id text here"), (4, long_text)], key=str)
    rows = [(None, "one two three"), (None, "one two three"), (None, "ONE two three"), (None, "four five six"),
            (3, "four five six"), (3, "seven eight nine"), (1, "seven eight nine"), (7, "ten eleven"), (7, "ten eleven"),
            (None, None), (None, ""), (0, "zero zero"), (None, "zero zero")]
    docs = spark.createDataFrame([(*r, k % 2) for k, r in enumerate(rows)], "doc_id long, text string, extra int")
    for parts in (1, 5):  # the same rows, however they arrive
        got = S.keep_one(docs.repartition(parts))
        found = sorted(map(tuple, got.collect()), key=str)
        if parts == 1:
            before = found
        assert found == before and got.columns == docs.columns
    by_fp = {}
    for d, t, _ in found:
        assert (d, t) in rows
        by_fp.setdefault(brute_fp(t), []).append(d)
    low = {}
    for d, t in rows:
        low.setdefault(brute_fp(t), []).append(d)
    assert by_fp == {f: [min((d for d in ds if d is not None), default=None)] for f, ds in low.items()}


# Embeddings ------------------------------------------------------------------

def brute_embeddings(rows, threshold=0.9):
    fine = [(i, v) for i, (d, v) in enumerate(rows)
            if v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    x = {i: np.array(v, float) for i, v in fine}
    edges = [(i, j) for a, i in enumerate(x) for j in list(x)[a + 1:] if len(x[i]) == len(x[j])
             and x[i] @ x[j] / np.linalg.norm(x[i]) / np.linalg.norm(x[j]) >= threshold - 1e-12]
    degree = {i: 0 for i in range(len(rows))}
    for i, j in edges:
        degree[i] += 1
        degree[j] += 1
    root = roots(range(len(rows)), edges)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root[i]] = min(d, low.get(root[i], d))
    return sorted(((d, degree[i], low.get(root[i]), d is not None and low.get(root[i]) == d)
                   for i, (d, _) in enumerate(rows)), key=str)


def vectors(spark, rows):
    return spark.createDataFrame([(d, v, 1, 2, 0.5, "x") for d, v in rows],
                                 "vec_id long, embedding array<float>, label int, h1 long, vec float, cell string")


def got_rows(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=str)


def some_vectors(seed=0, dim=32):
    rng = np.random.default_rng(seed)
    rows = []
    for base in rng.normal(size=(30, dim)):
        for _ in range(rng.integers(1, 9)):
            rows.append((base + rng.normal(size=dim) * rng.choice([0.0, 0.1, 0.25, 0.32])).astype(np.float32).tolist())
    rows += [rows[3]] * 40
    return [(i, v) for i, v in enumerate(rows)]


def test_links_equal_brute_force(spark):
    rows = some_vectors()
    odd = [(900, None), (901, [0.0] * 32), (902, [float("nan")] + [1.0] * 31), (903, [float("inf")] * 32),
           (904, [None] + [1.0] * 31), (905, []), (906, [1.0, 2.0]), (907, [2.0, 4.0]), (908, [1e-30] * 32), (None, rows[5][1]),
           (None, [5.0, 0.0, 0.0]), (909, [3e38] * 32)]
    got = got_rows(E.near_duplicates(vectors(spark, rows + odd), recall=1.0, cells_a_side=4))
    assert got == brute_embeddings(rows + odd)


def test_blocks_of_full_cells_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(E, "MEMBERS", 16)
    monkeypatch.setattr(E, "VISITORS", 24)
    rows = some_vectors(5)
    assert got_rows(E.near_duplicates(vectors(spark, rows), recall=1.0, cells_a_side=2)) == brute_embeddings(rows)


def test_recall_of_the_calibrated_traversal(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(1500, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    away = rng.normal(size=base.shape)
    away -= (away * base).sum(1, keepdims=True) * base
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    cos = rng.uniform(0.9, 0.93, (1500, 1))  # the hardest links
    near = cos * base + np.sqrt(1 - cos**2) * away
    x = np.concatenate([base, near])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    true = np.concatenate([(x[i: i + 500] @ x.T >= 0.9).sum(1) - 1 for i in range(0, len(x), 500)]).sum()
    found = sum(r.n_links for r in E.near_duplicates(df, cells_a_side=12).collect())
    assert 0.99 * true <= found <= true
    loose = sum(r.n_links for r in E.near_duplicates(df, recall=0.9, cells_a_side=12).collect())
    assert loose <= found


def test_traversal_is_the_nearest_cells():
    rng = np.random.default_rng(0)
    d1, d2 = rng.random(9), rng.random(7)
    cells = E.traverse(d1, d2, 0.5)
    total = (d1[:, None] + d2[None]).ravel()
    assert set(cells) == set(np.flatnonzero(total <= total.min() + 0.5)) and (np.diff(total[cells]) >= 0).all()


def test_no_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert E.near_duplicates(empty).count() == 0
    assert got_rows(E.near_duplicates(vectors(spark, [(1, None), (2, [0.0])]))) == [(1, 0, 1, True), (2, 0, 2, True)]


# Substrings ------------------------------------------------------------------

def brute_removed(rows, size):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    # rows without an id: after all others, by the hash of their texts
    ids = [U.NO_ID + (xxhash.xxh64_intdigest((t or "").encode(), 42) & (U.NO_ID // 2 - 1)) if d is None else d for d, t in rows]
    first = {}
    for d, ws in zip(ids, words, strict=True):
        for i in range(len(ws) - size + 1):
            k = tuple(ws[i: i + size])
            first[k] = min(first.get(k, (d, i)), (d, i))
    out = []
    for (doc_id, _), d, ws in zip(rows, ids, words, strict=True):
        gone = {p for i in range(len(ws) - size + 1) if first[tuple(ws[i: i + size])] < (d, i) for p in range(i, i + size)}
        kept = " ".join(w for p, w in enumerate(ws) if p not in gone)
        out.append((doc_id, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_many_copies_without_an_id(spark):
    """Equal rows cost one match, and texts without an id are no common group."""
    import time

    words = [f"w{i % 211}x{i % 13}" for i in range(300)]
    text = " ".join(words)
    others = [" ".join(words[i: i + 60] + [f"u{i}{k}" for k in range(30)]) for i in range(0, 200, 5)]

    def run(copies):
        rows = [(None, text)] * copies + [(None, t) for t in others] + [(7, " ".join(words[100:160])), (9, text), (9, text)]
        t0 = time.time()
        got = sorted((tuple(r) for r in U.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
        assert got == brute_removed(rows, 20)
        return time.time() - t0

    run(20)  # warm
    small, large = run(100), run(3000)
    assert large < 4 * small + 10


def passages(seed):
    rnd = random.Random(seed)
    shared = [[rnd.choice("abcdefgh") + rnd.choice("xyz") for _ in range(60)] for _ in range(4)]
    rows = []
    for d in range(60):
        ws = []
        for _ in range(rnd.randint(0, 4)):
            c = rnd.random()
            if c < 0.4:
                i = rnd.randint(0, 30)
                ws += rnd.choice(shared)[i: i + rnd.randint(5, 40)]
            elif c < 0.6:
                ws += [rnd.choice("ab")] * rnd.randint(1, 50)
            elif c < 0.7:
                ws += ["p", "q", "r"] * rnd.randint(1, 20)
            else:
                ws += [str(rnd.randint(0, 10**6)) for _ in range(rnd.randint(1, 30))]
        rows.append((rnd.choice([d, d, d, d // 2]), rnd.choice([" ", "\n", "\x0b "]).join(ws)))
    return rows + [(None, rows[3][1]), (None, None), (5, ""), rows[4], rows[4], (1000, rows[7][1])]


@pytest.mark.parametrize("size,gram,units", [(20, 8, None), (6, 3, None), (20, 8, 200)])
def test_removed_equal_brute_force(spark, monkeypatch, size, gram, units):
    if units:  # many shards, each streamed in several salted units
        monkeypatch.setattr(U, "SHARD_WORDS", units)
        monkeypatch.setattr(U, "UNIT_WORDS", units // 2)
    rows = passages(size + gram)
    got = U.digests(spark.createDataFrame(rows, "doc_id long, text string"), size, gram).collect()
    assert sorted(map(tuple, got), key=str) == brute_removed(rows, size)


def test_removed_text(spark, odd_docs, no_docs):
    rows = passages(1)
    docs = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, n int")
    out = U.remove(docs)
    assert out.columns == docs.columns
    expected = {(str(d), s) for d, _, _, s in brute_removed(rows, 20)}
    for r in out.collect():
        before = rows[r.n][1]
        ws = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        assert (str(r.doc_id), hashlib.sha256(" ".join(ws).encode()).hexdigest()) in expected
        assert r.text == before or len(ws) < len(before.split())
    assert out.count() == len(rows)
    assert U.remove(odd_docs).count() == 9 and U.remove(odd_docs).columns == odd_docs.columns
    got = sorted(map(tuple, U.digests(odd_docs).collect()), key=str)
    assert got == brute_removed([(r.doc_id, r.text) for r in odd_docs.collect()], 20)
    assert U.digests(no_docs).count() == 0 and U.remove(no_docs).count() == 0


def test_word_hashes_tell_words_apart():
    words = [f"{k:x}" for k in range(50_000)] + ["a" * k for k in range(1, 200)] + ["b" + "\0" * k for k in range(80)]
    words += ["x" * 62 + e for e in ("yz", "zy", "é", "yzz", "zyz")] + [f"{k} ".strip() + "é" * 40 for k in range(50)]
    there = U._word_hashes(Words(pa.array([" ".join(words), ""])))
    assert len(set(there.tolist())) == len(set(words))
    back = U._word_hashes(Words(pa.array(["other", " ".join(words[::-1])])))[1:]
    assert (back[::-1] == there).all()
    assert len(U._word_hashes(Words(pa.array(["", " "])))) == 0


def test_words_are_not_hashed_one_by_one():
    words = Words(pa.array([" ".join(f"{k:x}word" for k in range(200_000))]))

    def seconds(f):
        best = []
        for _ in range(3):
            t = time.process_time()
            f()
            best.append(time.process_time() - t)
        return min(best)

    singly = seconds(lambda: [*map(xxhash.xxh64_intdigest, words.vocabulary.cast(pa.binary()).to_pylist())])
    assert seconds(lambda: U._word_hashes(words)) < 0.7 * singly


def test_phrases():
    flat = pa.array(["a", "é", "c", "d"])
    assert U._phrases(flat, np.array([1, 0, 3]), np.array([2, 4, 1])).to_pylist() == ["é c", "a é c d", "d"]
    assert U._phrases(flat, np.zeros(0, np.int64), np.zeros(0, np.int64)).to_pylist() == []


def test_equal_windows_have_equal_anchors():
    import pyarrow as pa

    rnd = random.Random(0)
    shared = [rnd.choice("abc") for _ in range(20)]
    texts = [" ".join([rnd.choice("abc") for _ in range(rnd.randint(0, 30))] + shared + [rnd.choice("abc")] * 5) for _ in range(50)]
    words = Words(pa.array(texts))
    value, start, n = U.anchors(words, U._word_hashes(words), 20, 8)
    of = {s + k: v for v, s, k2 in zip(value, start, n, strict=True) for k in range(k2)}
    assert sorted(of) == words.windows(20).tolist()
    flat, by = words.flat.to_pylist(), {}
    for s, v in of.items():
        assert by.setdefault(tuple(flat[s: s + 20]), v) == v


def test_suffix_automaton_statistics():
    rnd = random.Random(9)
    spans = [(d, rnd.randint(0, 9), [rnd.choice("abc") for _ in range(rnd.randint(4, 25))]) for d in range(12)]
    a = U.SuffixAutomaton()
    for d, s, ws in spans:
        a.add_span(d, s, ws)
    for _ in range(60):
        did, start, ws = rnd.randint(0, 12), rnd.randint(0, 5), [rnd.choice("abcd") for _ in range(rnd.randint(0, 30))]
        for size in (3, 4):
            expected = [i for i in range(len(ws) - size + 1) if any(
                (d, s + k) < (did, start + i) for d, s, w in spans for k in range(len(w) - size + 1)
                if w[k: k + size] == ws[i: i + size] and (d, s + k) == min(
                    (d2, s2 + k2) for d2, s2, w2 in spans for k2 in range(len(w2) - size + 1) if w2[k2: k2 + size] == w[k: k + size]))]
            assert a.earlier(did, start, ws, size) == expected
