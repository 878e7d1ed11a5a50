import random
import re

import pytest

from shipledger.llm import license_templates as L

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def brute(text):
    ws = WORD.findall(lower(text))
    places = []
    for phrase, label in L.BASE.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(ws)) if ws[i: i + len(p)] == p]
    starts = sorted(i for i, _ in places)
    return (len(ws), len(places), starts[0] if starts else None, starts[-1] if starts else None,
            ",".join(sorted({label for _, label in places})))


def test_base_equals_brute_force(spark):
    rnd = random.Random(2)
    parts = ["CC", "by", "cc-by", "cc by cc by", " general ", "public", "license", "all", "rights", "Reserved.", "é", "\x00",
             "_", "İ", "\n", " ", "x9", "BY-"]
    texts = ["".join(rnd.choice(parts) + rnd.choice(["", " ", "-"]) for _ in range(rnd.randint(0, 40))) for _ in range(300)]
    texts += ["", None, "cc by cc by cc", "all rights reserved all rights reserved"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in L.digest(L.scan(docs)).collect()}
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t), t
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert (r.score > 0) == bool(r.labels)


def matches(markup, text):
    a = L.compile_template("x", markup)
    ws = L.tokens(text)
    return [(s, e) for s in range(len(ws)) if (e := a.longest(ws, s)) >= 0]


def test_regions():
    t = "licensed under [[the]] mit license [[version <<v:2>>]]"
    assert matches(t, "licensed under the MIT license") == [(0, 5)]
    assert matches(t, "so licensed under mit license, version 2.0 of") == [(1, 8)]
    assert matches(t, "licensed under a mit license") == []
    assert matches("copyright <<holder:3>> all rights reserved", "copyright A B all rights reserved") == [(0, 6)]
    assert matches("copyright <<holder:3>> all rights reserved", "copyright all rights reserved") == []
    assert matches("copyright <<holder:1>> all rights reserved", "copyright A B all rights reserved") == []
    assert matches("a [[b [[c]] d]] e", "a e a b d e a b c d e a b c e") == [(0, 2), (2, 6), (6, 11)]


def test_automaton_equals_a_regular_expression():
    rnd = random.Random(4)
    a = L.compile_template("x", "a [[b]] <<v:2>> c [[d [[a]]]] b")
    pattern = re.compile(r"a (?:b )?\w (?:\w )?c (?:d (?:a )?)?b ")
    for _ in range(500):
        ws = [rnd.choice("abcd") for _ in range(rnd.randint(0, 12))]
        text = " ".join(ws) + " "
        accepted = {len(m) // 2 for k in range(len(ws) + 1) if (m := text[: 2 * k]) and pattern.fullmatch(m)}
        assert a.longest([w.encode() for w in ws], 0) == max(accepted, default=-1), ws


def test_bad_markup():
    for bad in ("[[a]] b", "a [[b", "<<v:2>>"):
        with pytest.raises((ValueError, IndexError)):
            L.compile_template("x", bad)


def test_notices_get_labels(spark):
    texts = ["This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.",
             "Released under the MIT license.", "Licensed under the Apache License, Version 2.0."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r.labels for r in L.digest(L.scan(docs)).collect()}
    assert rows == {0: "gpl,notice:gpl", 1: "cc-by,notice:cc", 2: "notice:mit", 3: "notice:apache"}
    assert {r.label: r.documents for r in L.label_counts(L.scan(docs)).collect()} == {
        x: 1 for v in rows.values() for x in v.split(",")}


def test_odd_rows(odd_docs, no_docs):
    rows = L.digest(L.scan(odd_docs)).collect()
    assert len(rows) == 9 and {r.labels for r in rows} == {""} and {r.first_word for r in rows} == {None}
    assert L.digest(L.scan(no_docs)).count() == 0
