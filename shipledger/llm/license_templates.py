"""License scans (operator 4): template-markup matching.

A template is a line of words with ``[[ ... ]]`` around an optional region
(may be nested) and ``<<name:n>>`` for a replaceable region of one to n
arbitrary words; every other word is mandatory and must match exactly. Each
template is compiled into a token automaton (states, word edges, free edges).
A match starts at the template's first mandatory words and is accepted when
the automaton reaches its end; the longest accepted run is reported.

Base phrases are plain templates: every place where their words stand one
after the other counts, overlapping ones too.

One narrow pass over whole texts, no shuffle. Candidate places come from a
byte search of the mandatory head, so text without license wording costs a
few searches. Defined cases: a null or empty text has no words and no labels,
score 0; rows are judged one by one, so repeated rows, null ids and ties keep
their rows; an empty table gives an empty result; only the id and the text
are read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shipledger.llm.common import map_arrow, strings

BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

TEMPLATES = {
    "notice:apache": "licensed under the apache license [[version <<version:2>>]]",
    "notice:mit": "released under the [[terms of the]] mit license",
    "notice:gpl": "<<work:2>> is licensed under the [[gnu]] general public license [[version <<number:2>>]]",
    "notice:cc": "licensed under [[a]] [[creative commons]] cc by [[nc]] [[sa]] [[nd]] [[<<version:2>>]]",
    "notice:copyright": "copyright [[c]] <<holder:8>> all rights reserved",
    "text:mit": "permission is hereby granted free of charge to any person obtaining a copy of this <<what:3>>"
                " and associated documentation files",
    "text:bsd": "redistribution and use in source and binary forms with or without modification are permitted"
                " provided that the following conditions are met",
    "text:isc": "permission to use copy modify [[and or]] distribute this <<what:2>> for any purpose with or without"
                " fee is hereby granted",
}

_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
               for b in range(256))
_PART = re.compile(r"\[\[|\]\]|<<\w+:(\d+)>>|[^\s\[\]<>]+")


@dataclass(frozen=True)
class Automaton:
    """``words[s]``: word -> next state; ``any_word[s]``: state after an
    arbitrary word, or -1; ``free[s]``: states reached without a word."""
    label: str
    head: tuple[bytes, ...]
    lead: int  # most arbitrary words before the head
    words: tuple[dict[bytes, int], ...]
    any_word: tuple[int, ...]
    free: tuple[tuple[int, ...], ...]
    end: int

    def _closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return states

    def longest(self, words: list[bytes], at: int) -> int:
        """End of the longest accepted run that starts at word ``at``, or -1."""
        states, best, i = self._closure({0}), -1, at
        while states:
            if self.end in states:
                best = i
            if i == len(words):
                break
            w = words[i]
            states = self._closure({t for s in states for t in (self.words[s].get(w, -1), self.any_word[s]) if t >= 0})
            i += 1
        return best


def compile_template(label: str, markup: str) -> Automaton:
    words: list[dict[bytes, int]] = [{}]
    any_word, free, opened = [-1], [[]], []
    head: list[bytes] = []
    lead, reading = 0, True

    def state() -> int:
        words.append({})
        any_word.append(-1)
        free.append([])
        return len(words) - 1

    now = 0
    for m in _PART.finditer(markup):
        part = m.group()
        if part == "[[":
            reading = reading and not head
            opened.append(now)
            fresh = state()
            free[now].append(fresh)
            now = fresh
        elif part == "]]":
            fresh = state()
            free[now].append(fresh)
            free[opened.pop()].append(fresh)
            now = fresh
        elif m.group(1):
            reading = reading and not head
            n, places = int(m.group(1)), []
            for _ in range(n):
                fresh = state()
                any_word[now] = fresh
                now = fresh
                places.append(now)
            after = state()
            for p in places:
                free[p].append(after)
            now = after
            if not head and not opened:
                lead += n
        else:
            fresh = state()
            word = part.lower().encode()
            words[now][word] = fresh
            now = fresh
            if reading and not opened:
                head.append(word)
            elif opened and not head:
                raise ValueError(f"{label}: an optional region may not come before the first mandatory word")
    if opened or not head:
        raise ValueError(f"{label}: unbalanced markup, or no mandatory word")
    return Automaton(label, tuple(head), lead, tuple(words), tuple(any_word), tuple(map(tuple, free)), now)


def tokens(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_WORDS).split()


def _places(joined: bytes, phrase: bytes) -> list[int]:
    """Word indices at which a space-framed phrase stands in the framed text."""
    out, at, word, seen = [], joined.find(phrase), 0, 0
    while at >= 0:
        word += joined.count(b" ", seen, at)
        seen = at
        out.append(word)
        at = joined.find(phrase, at + 1)
    return out


class Scanner:
    def __init__(self, base: dict[str, str], templates: dict[str, str]):
        self.base = [(b" " + p.encode() + b" ", len(p.split()), label) for p, label in base.items()]
        self.automata = [compile_template(k, v) for k, v in templates.items()]
        self.heads = [b" " + b" ".join(a.head) + b" " for a in self.automata]

    def scan(self, text: str) -> tuple[int, list[tuple[int, int, str]], list[tuple[int, int, str]]]:
        """Number of words, base places and template spans (start, end, label)."""
        words = tokens(text)
        joined = b" " + b" ".join(words) + b" "
        base = [(i, i + n, label) for phrase, n, label in self.base for i in _places(joined, phrase)]
        spans = set()
        for a, head in zip(self.automata, self.heads, strict=True):
            for i in _places(joined, head):
                found = [(s, e) for s in range(max(0, i - a.lead), i + 1) if (e := a.longest(words, s)) > i]
                if found:
                    spans.add((*max(found, key=lambda r: (r[1] - r[0], -r[0])), a.label))
        return len(words), sorted(base), sorted(spans)


def scan(docs: DataFrame, base: dict[str, str] | None = None, templates: dict[str, str] | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, base (start, end, label structs),
    spans (the same for accepted templates)."""
    scanner = Scanner(BASE if base is None else base, TEMPLATES if templates is None else templates)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())]))

    def kernel(batches):
        for b in batches:
            got = [scanner.scan(t) for t in strings(b.column("text")).to_pylist()]
            as_spans = lambda rows: pa.array([[dict(zip(("start", "end", "label"), r, strict=True)) for r in x]
                                              for x in rows], span)
            yield pa.record_batch({"doc_id": b.column("doc_id"), "n_words": pa.array([g[0] for g in got], pa.int64()),
                                   "base": as_spans([g[1] for g in got]), "spans": as_spans([g[2] for g in got])})

    spans = "array<struct<start:long,end:long,label:string>>"
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), kernel,
                     f"doc_id long, n_words long, base {spans}, spans {spans}")


def digest(found: DataFrame) -> DataFrame:
    """Contract columns from the spans. score: the share of the document's
    words that base phrases or accepted templates cover."""
    names = lambda c: F.array_distinct(F.transform(c, lambda s: s["label"]))
    every = F.concat("base", "spans")
    # words covered: spans in order of start, each counted from the furthest end so far
    state = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(F.array_sort(every), state, lambda a, s: F.struct(
        F.greatest(a["end"], s["end"]).alias("end"),
        (a["n"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(a["end"], s["start"]))).alias("n")),
        lambda a: a["n"])
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda s: s["start"])).alias("first_word"),
        F.array_max(F.transform("base", lambda s: s["start"])).alias("last_word"),
        F.array_join(F.array_sort(names("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(names("base"), names("spans")))), ",").alias("labels"),
        F.when(F.col("n_words") > 0, covered / F.col("n_words")).otherwise(F.lit(0.0)).alias("score"))


def label_counts(found: DataFrame) -> DataFrame:
    """Documents per label over the corpus."""
    return (found.select("doc_id", F.explode(F.array_distinct(F.transform(F.concat("base", "spans"),
                                                                          lambda s: s["label"]))).alias("label"))
            .groupBy("label").agg(F.count("*").alias("documents")))


__all__ = ["BASE", "TEMPLATES", "Automaton", "Scanner", "compile_template", "digest", "label_counts",
           "scan", "tokens"]
