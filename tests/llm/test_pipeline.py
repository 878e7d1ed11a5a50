"""The stages against brute force, each on what its predecessor kept."""
import hashlib
import re

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from shipledger.llm import quality_rules, toxicity_mil
from tests.llm.test_dedup import brute_groups, brute_removed
from tests.llm.test_packing import check

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of each stage, written and read again."""
    docs, out = spark.read.parquet(f"{D}/documents.parquet"), []
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        f(spark, docs, D).write.parquet(path)
        got = spark.read.parquet(path)
        out.append((name, docs, got))
        docs = got
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_names_and_columns(stages, spark):
    assert [n for n, _, _ in stages] == ["quality rules", "toxicity", "simhash near-dedup", "substring dedup", "packing"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns and after.dtypes == before.dtypes


def test_filters_follow_their_operators(stages, spark):
    labels = spark.read.parquet(f"{D}/labels.parquet")
    (_, docs, good), (_, _, clean) = stages[0], stages[1]
    kept = quality_rules.judge(docs, quality_rules.fit(docs, labels)).where("kept")
    assert sorted(rows(good)) == sorted(r for r in rows(docs) if r[0] in {k.doc_id for k in kept.collect()})
    scores = toxicity_mil.score(good, toxicity_mil.fit(good, labels)).where("score < 0.7")
    assert sorted(rows(clean)) == sorted(r for r in rows(good) if r[0] in {k.doc_id for k in scores.collect()})


def test_one_of_each_group(stages):
    _, before, after = stages[2]
    keep = {d for d, _, c in brute_groups(rows(before)) if d == c}
    assert sorted(rows(after)) == sorted(r for r in rows(before) if r[0] in keep)


def test_substrings(stages):
    _, before, after = stages[3]
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    got = sorted(((r.doc_id, hashlib.sha256(" ".join(words(r.text)).encode()).hexdigest()) for r in after.collect()), key=str)
    assert got == sorted(((d, s) for d, _, _, s in brute_removed(rows(before), 20)), key=str)
    assert all(r.n_chars == len(r.text) for r in after.collect())


def test_packing(stages):
    _, before, after = stages[4]
    check(after.collect(), rows(before), Tokenizer.from_file(P.path("byte_bpe_50k.json")))


def test_run(spark, stages):
    got = corpus_pipeline.run(spark, D)
    assert got.agg({"length": "sum"}).first()[0] == stages[4][2].agg({"length": "sum"}).first()[0]
    assert corpus_pipeline.ORACLE_SQL is None


def test_odd_rows_pass_through(spark, odd_docs, no_docs):
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, D).collect()
        stage(spark, no_docs, D).collect()
    assert corpus_pipeline.substrings(spark, docs, D).count() == 9


def test_stages_keep_columns_of_any_name(spark):
    """Extra columns named like the columns that the operators join on, and one with a dot in its name."""
    names = ["_d", "_h", "_did", "_th", "_text", "_kept", "did", "th", "spans", "marks", "fp", "component_id", "n_words",
             "score", "kept", "a.b"]
    docs = spark.read.parquet(f"{D}/documents.parquet").where("doc_id < 60")
    wide = docs.select("*", *[F.concat(F.lit(n + "-"), F.col("doc_id").cast("string")).alias(n) for n in names])
    for _, stage in corpus_pipeline.STAGES:
        got = stage(spark, wide, D)
        if "text" not in got.columns:
            assert sorted({r.doc_id for r in got.collect()}) == sorted(r.doc_id for r in docs.collect())
            continue
        assert got.dtypes == wide.dtypes
        found = got.collect()
        assert found and all(r[n] == f"{n}-{r.doc_id}" for r in found for n in names)
        assert sorted(rows(got)) == sorted(rows(stage(spark, docs, D)))
