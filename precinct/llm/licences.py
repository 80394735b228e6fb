"""Licence notices in text: fixed phrases, and an exact set-similarity join with notice templates.

A block of a text (a window of words; windows overlap by half) meets a template if it holds at least ``threshold`` of the
template's distinct words.  Words are ordered from rare to frequent by the documents they occur in, counted over the
whole corpus.  To meet a template of n words a block must hold one of its first n - ceil(threshold * n) + 1 words (prefix
filter) and at least ceil(threshold * n) different words (length filter); after a first common word at place i of the
template no more than n - i can follow (positional filter).  What passes is compared in full, so the result is exact.
"""
from __future__ import annotations

import math
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precinct.llm.common import map_texts, texts

# Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Usual notices, as published by the licences' stewards, and their labels.
TEMPLATES = {
    "mit": "released under the MIT License",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "gpl-3.0": "licensed under the GNU General Public License, version 3",
    "cc-by-4.0": "licensed under CC BY 4.0",
    "cc-by-nc-4.0": "licensed under CC BY-NC 4.0",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "public-domain": "This is free and unencumbered software released into the public domain",
}
THRESHOLD = 0.9
# Everything but ASCII letters and digits and all other characters' bytes separates words; A-Z are lower-cased.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TABLE).split()


def places(words: list[bytes], phrases: dict[str, str] = PHRASES) -> list[tuple[int, str]]:
    """(first word, label) of every place where a phrase's words stand in a row."""
    found = []
    whole = b" " + b" ".join(words) + b" "
    for phrase, label in phrases.items():
        sought = b" " + phrase.encode() + b" "
        at, counted, number = whole.find(sought), 0, 0
        while at >= 0:
            number += whole.count(b" ", counted, at)
            counted = at
            found.append((number, label))
            at = whole.find(sought, at + 1)
    return found


class Join:
    """The templates' side of the join: words in global order, and prefixes with the templates they lead to."""

    def __init__(self, templates: dict[str, str], frequency: dict[bytes, int], threshold: float):
        self.threshold = threshold
        self.sets = {}
        self.prefix: dict[bytes, list[tuple[str, int]]] = defaultdict(list)
        for name, text in templates.items():
            ordered = sorted(set(words_of(text)), key=lambda w: (frequency.get(w, 0), w))
            self.sets[name] = ordered
            for i, word in enumerate(ordered[:len(ordered) - self.needed(name) + 1]):
                self.prefix[word].append((name, i))
        self.size = 2 * max((len(words_of(t)) for t in templates.values()), default=1)

    def needed(self, name: str) -> int:
        return math.ceil(self.threshold * len(self.sets[name]) - 1e-9)

    def blocks(self, words: list[bytes]) -> dict[int, dict[str, float]]:
        """Start of each block that meets a template -> containment of each template met.

        Blocks start at every multiple of half the size, so a notice no longer than the longest template lies whole in one.
        """
        half = self.size // 2
        candidates = defaultdict(dict)
        if self.prefix.keys().isdisjoint(words):
            return {}
        for at, word in enumerate(words):
            for name, i in self.prefix.get(word, ()):
                for start in {max(0, at // half - 1) * half, at // half * half}:
                    candidates[start][name] = min(i, candidates[start].get(name, i))
        met = {}
        for start, names in candidates.items():
            block = set(words[start:start + self.size])
            scores = {}
            for name, first in names.items():
                ordered, needed = self.sets[name], self.needed(name)
                if len(block) < needed or len(ordered) - first < needed:
                    continue
                common = sum(w in block for w in ordered[first:])
                if common >= needed:
                    scores[name] = common / len(ordered)
            for name in [n for n in scores if any(set(self.sets[n]) < set(self.sets[o]) for o in scores)]:
                del scores[name]  # a longer notice that includes it is there
            if scores:
                met[start] = scores
        return met


def word_frequency(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> dict[bytes, int]:
    """Documents that hold each of the templates' words, counted over all documents (as many numbers as the templates have words)."""
    vocabulary = {w for t in templates.values() for w in words_of(t)}

    def run(batch: pa.RecordBatch) -> dict:
        counts = Counter()
        for text in batch.column(1).to_pylist():
            counts.update(vocabulary.intersection(words_of(text)))
        return {"word": list(counts), "n": list(counts.values())}

    rows = map_texts(texts(docs), run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r.word): r.n for r in rows}


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks.

    ``blocks`` has start:label of every block that meets a template.  ``score`` is 1 where a phrase stands, else the largest containment of a
    template that is met, else 0.  Null and empty texts have no words and no labels.  Rows that repeat a doc_id are
    scanned each.  Empty table: no rows.
    """
    join = Join(templates, word_frequency(docs, templates), threshold)

    def run(batch: pa.RecordBatch) -> dict:
        out = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks")}
        for text in batch.column(1).to_pylist():
            words = words_of(text)
            base = places(words)
            met = join.blocks(words)
            labels = {label for _, label in base}
            own = {name for scores in met.values() for name in scores}
            values = (len(words), len(base), min(base)[0] if base else None, max(base)[0] if base else None, ",".join(sorted(labels)), ",".join(sorted(labels | own)),
                      1.0 if base else max((s for scores in met.values() for s in scores.values()), default=0.0),
                      ",".join(f"{start}:{name}" for start in sorted(met) for name in sorted(met[start])))
            for name, value in zip(out, values):
                out[name].append(value)
        return {"doc_id": batch.column(0)} | out

    return map_texts(texts(docs), run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks string")
