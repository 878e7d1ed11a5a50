import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shipledger.llm import hyperplane_tree as H

SCHEMA = "vec_id long, label int, embedding array<float>, anchor boolean, score double, leaf int, v string"


def brute(rows, positives=5, negatives=5):
    known = {}
    for i, label, e, anchor, *_ in rows:
        if i is None or label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        v = [math.floor(256 * float(np.float32(x))) for x in e]
        r = (label, np.array(v, "<i4").tobytes(), bool(anchor), v)
        known[i] = min(known.get(i, r), r)
    out = []
    for a, (label, _, anchor, v) in known.items():
        if not anchor:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), i, m) for i, (m, _, _, w) in known.items() if i != a)
        for s, i, _ in [x for x in scored if x[2] == label][:positives]:
            inside = [(t, j) for t, j, m in scored if m != label and 80 * -s <= 100 * -t <= 100 * -s]
            out += [(a, i, k, j, -s, -t) for k, (t, j) in enumerate(inside[:negatives], 1)]
    return sorted(out)


def mined(spark, rows, **kw):
    return sorted(tuple(r) for r in H.mine(spark.createDataFrame(rows, SCHEMA), **kw).collect())


@pytest.fixture
def fine(monkeypatch):
    """Small leaves and blocks, so that small tables make deep trees."""
    for name, value in {"LEAF": 16, "UNIT": 24, "WAYS": 4, "SAMPLE": 300}.items():
        monkeypatch.setattr(H, name, value)


def clusters(n, seed, dim=12, groups=15):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, dim))
    return [(i, int(rng.integers(0, 4)), [float(x) for x in centre[rng.integers(groups)] + 0.2 * rng.normal(size=dim)],
             i % 9 == 0, 0.5, 3, "x") for i in range(n)]


def test_all_pairs(spark, fine):
    rows = clusters(700, 1)
    assert mined(spark, rows) == brute(rows)


def test_the_tree_leaves_out_leaves(fine):
    rng = np.random.default_rng(3)
    x = np.floor(256 * (rng.normal(size=(40, 3))[rng.integers(0, 40, 800)] + 0.02 * rng.normal(size=(800, 3)))).astype(np.int64)
    tree = H.Tree(x, float((x**2).sum(1).max()), len(x))
    leaf, seen = tree.place(x)
    found = {}
    for node, i, j, lo, hi in seen:
        a, z = found.get((node, i, j), (lo, hi))
        found[node, i, j] = (min(a, lo), max(z, hi))
    tree.set_ranges([(*k, *v) for k, v in found.items()])
    assert tree.leaves > 20
    q, score = x[:50], x[:50] @ x.T
    hi = np.sort(score, 1)[:, -6:-5]
    lo = np.ceil(0.8 * hi)
    which, seen_leaf = tree.search(q, tree.distances(q, hi), tree.distances(q, lo))
    visited = set(zip(which.tolist(), seen_leaf.tolist(), strict=True))
    wanted = {(a, int(leaf[b])) for a, b in zip(*np.nonzero((score >= lo) & (score <= hi)), strict=True)}
    assert wanted <= visited and len(visited) < 0.6 * 50 * tree.leaves


def test_hot_copies_and_ties(spark, fine):
    rnd = random.Random(2)
    rows = clusters(240, 2)
    rows += [(1000 + i, rnd.randrange(3), [1.0] * 12, i % 40 == 0, 0.0, 0, "c") for i in range(160)]
    assert mined(spark, rows) == brute(rows)


def test_odd_rows(spark, fine):
    nan, inf = float("nan"), float("inf")
    rows = clusters(60, 4)
    rows += [(None, 1, [1.0] * 12, True, None, None, None), (900, None, [1.0] * 12, True, None, None, None),
             (909, 1, None, True, None, None, None), (918, 1, [nan] * 12, True, None, None, None),
             (927, 1, [1.0, None], True, None, None, None), (936, 1, [-inf], True, None, None, None),
             (945, 1, [], True, None, None, None), (946, 1, [2.0, -0.001], True, None, None, None),
             (947, 2, [0.0] * 12, None, None, None, None), (954, 7, [0.3] * 12, True, None, None, None)]
    rows += rows[:10] + [(0, 0, [0.0] * 12, False, None, None, None)]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, []) == []
    assert mined(spark, rows, positives=2, negatives=1) == brute(rows, 2, 1)


def test_large_components(spark):
    rows = [(i, i % 2, [float((-1) ** i * 2**17 + i), 2.0**17 + 0.25 * i, 1.0], i == 0, None, None, None) for i in range(20)]
    assert mined(spark, rows) == brute(rows)
    a = np.random.default_rng(1).integers(-2**26, 2**26, (5, 64))
    assert (H.products(a, a) == np.array([[sum(int(x) * int(y) for x, y in zip(u, v, strict=True)) for v in a] for u in a])).all()
    with pytest.raises(Exception, match="after scaling"):
        mined(spark, [(0, 1, [3e38], True, None, None, None)])


def test_query_shifts_labels(spark, tmp_path):
    from shipledger.llm import queries

    rows = [(r[0], r[1], r[2]) for r in clusters(330, 6)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r) for r in queries.op12_hard_negatives(spark, str(tmp_path)).collect())
    assert got == brute([(i, (m + 1) % 10 if i % 7 == 0 else m, e, i % 100 == 0) for i, m, e in rows])
    assert queries.op12_hard_negatives(spark, str(tmp_path)).agg(F.max("rank")).first()[0] <= 5
