import math
import re
import zlib

from pyspark.sql import functions as F

from shipledger.llm import toxicity_mil as T


def test_noisy_or_equals_its_formula():
    model = T.Bags({b"idiot": 7.0, b"nice": -2.0}, -3.0)
    text = "You idiot. Nice day!\nNice idiot, nice. ... plain words"
    sigmoid = lambda z: 1 / (1 + math.exp(-z))
    bags = [{"you", "idiot"}, {"nice", "day"}, {"nice", "idiot"}, {"plain", "words"}]
    ps = [sigmoid(-3 + 7 * ("idiot" in b) - 2 * ("nice" in b)) for b in bags]
    score, n, scored = model.judge(text)
    assert n == 4 and abs(score - (1 - math.prod(1 - p for p in ps))) < 1e-12
    assert [k for k, _ in scored] == [0, 1, 2] and abs(scored[0][1] - ps[0]) < 1e-12


def test_held_out_and_located(corpus, spark):
    docs, labels = corpus
    model = T.fit(docs, labels)
    got = T.score(docs, model).join(labels, "doc_id").toPandas()
    held = got[[zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]]
    pos, neg = held[held.toxic == 1].score.to_numpy(), held[held.toxic == 0].score.to_numpy()
    assert (pos[:, None] > neg[None]).mean() > 0.85
    assert ((held.score >= 0.7) == (held.toxic == 1)).mean() > 0.9
    word = max(model.weight, key=model.weight.get).decode()
    found = T.offending(docs, model).collect()
    assert found and all(0.5 <= r.score <= 1 for r in found) and any(word in r.text for r in found)
    assert len(found) == T.score(docs, model).agg(F.sum("n_offending")).first()[0]
    texts = {r.doc_id: r.text.lower() for r in docs.collect()}
    assert all(r.text in texts[r.doc_id] for r in found)


def test_learns_one_sentence_from_document_labels(spark):
    fill = [f"w{i % 50} v{i % 37} u{i % 11}" for i in range(400)]
    rows, marks = [], []
    for d in range(400):
        toxic = d % 4 == 0
        body = [fill[(d * 7 + k) % 400] for k in range(6)]
        if toxic:
            body[d % 6] += " vileword"
        rows.append((d, ". ".join(body)))
        marks.append((d, 1, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = T.fit(docs, labels)
    out = {r.doc_id: r for r in T.score(docs, model).collect()}
    assert all((out[d].score >= 0.7) == (d % 4 == 0) for d in range(400))
    where = {r.doc_id: r.sentence for r in T.offending(docs, model).collect()}
    assert where == {d: d % 6 for d in range(0, 400, 4)}
    kept = T.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == 300


def test_odd_rows(odd_docs, no_docs, no_labels):
    model = T.Bags({b"beta": 6.0}, -5.0)
    rows = T.score(odd_docs, model).collect()
    assert len(rows) == 9
    assert sorted(r.doc_id for r in rows if r.score > 0.6) == [1, 4, 5, 5] or sorted(
        r.doc_id for r in rows if r.n_offending) == [1, 5, 5]
    assert [r.score for r in rows if r.n_sentences == 0] == [0.0] * 4
    assert T.keep_clean(odd_docs, model, 0.99).columns == odd_docs.columns
    assert T.score(no_docs, model).count() == 0 and T.offending(no_docs, model).count() == 0
    none = T.fit(odd_docs, no_labels)
    assert {r.score for r in T.score(odd_docs, none).collect()} == {0.0}


def test_sentences_match_a_plain_split():
    text = "One two.Three! four\n\n?five ... É"
    parts = [s for s in re.split(r"[.!?\n]+", text.lower()) if re.search(r"\w", s)]
    assert [w for _, _, w in T.sentences(text)] == [set(re.findall(r"\w+", s) and s.encode().split()) for s in parts]
