"""License scan: a positional index of rare licence words.

1. Document frequencies of all template words are counted over all documents
   (at most one row per template word).  The index holds the postings
   (template, position) of each template's ``INDEXED`` words of highest IDF,
   and of more where a template is so long that an alignment of enough share
   could miss all of them.
2. Every occurrence of an index word is looked up; at position p it votes for
   a template to start at p - position.  Alignments with votes of as many
   distinct words as any alignment of enough share must have go on.
3. An alignment is verified: the share of template words that stand at their
   place, and the template's mandatory key phrases within the aligned window.

Base phrases are found wherever their words stand consecutively.  The score
is the best share of a verified template, and 1 where a base phrase is found.

Words are compared by 64-bit hashes of their bytes.  Whole texts are read; a
slice's occurrences are handled at once.

Defined results: null counts as empty; a text without words has no places,
no labels and score 0; repeated rows get the same result; an empty table gives
an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.llm import kernels as K
from churnlens.llm.frames import documents, keyed, unkeyed

PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: (label, template text, mandatory key phrases)
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0", ["apache license"]),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at",
     ["in compliance with the license"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
     ["permission is hereby granted", "free of charge"]),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ["general public license version 3"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
     ["free software", "gnu general public license"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
     ["redistribution and use", "source and binary forms"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software", "public domain"]),
]

INDEXED = 8
MIN_VOTES = 3
MIN_SHARE = 0.8

LOWER, ALNUM = K.lower_table(), K.alnum_table()


def lower_words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a slice, and where documents begin."""
    low = LOWER[raw]
    first, last, doc = K.words(low, off, ALNUM)
    return K.word_hashes(low, first, last), doc


def consecutive(words: np.ndarray, doc: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Where a phrase's words stand side by side within one document."""
    at = np.flatnonzero(words == phrase[0])
    end = doc[np.searchsorted(doc, at, side="right")] if len(at) else at
    at = at[at + len(phrase) <= end]
    for i, w in enumerate(phrase[1:], 1):
        at = at[words[at + i] == w]
    return at


class Index:
    """Templates, and the postings of their rarest words."""

    def __init__(self, templates, frequency: dict[int, int], n_docs: int):
        self.labels = [label for label, _, _ in templates]
        self.words = [K.hash_list(text.split()) for _, text, _ in templates]
        self.keys = [[K.hash_list(p.split()) for p in keys] for _, _, keys in templates]
        idf = {w: math.log((n_docs + 1) / (frequency.get(w, 0) + 1)) for t in self.words for w in t.tolist()}
        posts = []
        needed = []
        for t, seq in enumerate(self.words):
            # words that may differ in an alignment of enough share
            free = sum((len(seq) - m) / len(seq) >= MIN_SHARE for m in range(1, len(seq) + 1))
            rare = sorted(set(seq.tolist()), key=lambda w: (-idf[w], w))[: max(INDEXED, free + MIN_VOTES)]
            needed.append(max(1, min(MIN_VOTES, len(rare) - free)))
            posts += [(w, t, q) for q, w in enumerate(seq.tolist()) if w in rare]
        posts.sort()
        self.needed = np.array(needed, dtype=np.int64)
        self.longest = max((len(t) for t in self.words), default=0)
        self.post_template = np.array([p[1] for p in posts], dtype=np.int64)
        self.post_at = np.array([p[2] for p in posts], dtype=np.int64)
        word = np.array([p[0] for p in posts], dtype=np.uint64)
        self.vocabulary = np.unique(word)
        self.first = np.searchsorted(word, self.vocabulary, side="left")
        self.size = np.searchsorted(word, self.vocabulary, side="right") - self.first

    def scan(self, words: np.ndarray, doc: np.ndarray) -> dict[int, dict[str, float]]:
        """Labels with their share, of each document of a slice that has any."""
        out: dict[int, dict[str, float]] = {}
        if not len(self.vocabulary):
            return out
        term = K.lookup(self.vocabulary, words)
        at = np.flatnonzero(term >= 0)
        term = term[at]
        which = np.searchsorted(doc, at, side="right") - 1
        n = self.size[term]
        post = np.repeat(self.first[term], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        # ``longest`` free places before each document keep the starts of
        # neighbours apart
        start = np.repeat(at + (which + 1) * self.longest, n) - self.post_at[post]
        pair = start * len(self.words) + self.post_template[post]
        votes = np.unique(pair * len(self.vocabulary) + np.repeat(term, n))
        pair, count = np.unique(votes // len(self.vocabulary), return_counts=True)
        template = pair % len(self.words)
        pair, template = (x[count >= self.needed[template]] for x in (pair, template))
        start = pair // len(self.words)
        which = np.searchsorted(doc[:-1] + np.arange(len(doc) - 1) * self.longest, start, side="right") - 1
        start -= (which + 1) * self.longest
        for t, seq in enumerate(self.words):
            begin, d = start[template == t], which[template == t]
            lo, hi = doc[d], doc[d + 1]
            same = np.zeros(len(begin), np.int64)
            for q, w in enumerate(seq):
                place = begin + q
                inside = (place >= lo) & (place < hi)
                same += inside & (words[np.where(inside, place, 0)] == w)
            for i in np.flatnonzero(same / max(len(seq), 1) >= MIN_SHARE).tolist():
                window = words[max(begin[i], lo[i]) : min(begin[i] + len(seq), hi[i])]
                edge = np.array([0, len(window)])
                if all(len(consecutive(window, edge, k)) for k in self.keys[t]):
                    own = out.setdefault(int(d[i]), {})
                    own[self.labels[t]] = max(own.get(self.labels[t], 0.0), float(same[i] / len(seq)))
        return out


def template_frequencies(base: DataFrame, templates) -> tuple[dict[int, int], int]:
    """Document frequency of each template word, and the number of documents:
    counted in the tasks, one row per word and task, bounded by the templates."""
    vocabulary = np.unique(np.concatenate([K.hash_list(text.split()) for _, text, _ in templates]))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros(len(vocabulary), np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for _, _, raw, off in K.slices(batch.column("text")):
                words, doc = lower_words(raw, off)
                term = K.lookup(vocabulary, words)
                at = np.flatnonzero(term >= 0)
                which = np.searchsorted(doc, at, side="right") - 1
                counts += np.bincount(np.unique(which * len(vocabulary) + term[at]) % len(vocabulary), minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array([*range(len(vocabulary)), -1]), pa.array([*counts.tolist(), n])], ["term", "n"])

    found = base.select("text").mapInArrow(emit, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    n_docs = sum(r.n for r in found if r.term < 0)
    return {int(vocabulary[r.term]): r.n for r in found if r.term >= 0}, n_docs


def license_scan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", phrases: dict[str, str] | None = None,
                 templates=None) -> DataFrame:
    """Every input row with ``n_words``, ``n_base``, ``first_word``,
    ``last_word``, ``base_labels``, ``labels``, ``score``."""
    phrases = PHRASES if phrases is None else phrases
    templates = TEMPLATES if templates is None else templates
    base = keyed(docs, id_col, text_col)
    index = Index(templates, *template_frequencies(base, templates))
    wanted = [(K.hash_list(p.split()), label) for p, label in phrases.items()]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_base, first, last, base_labels, labels, score = ([] for _ in range(7))
            for row, end, raw, off in K.slices(batch.column("text")):
                words, doc = lower_words(raw, off)
                size = end - row
                hits = [(at, label) for p, label in wanted for at in [consecutive(words, doc, p)]]
                at = np.concatenate([a for a, _ in hits])
                which = np.searchsorted(doc, at, side="right") - 1
                kind = np.repeat(np.arange(len(hits)), [len(a) for a, _ in hits])
                local = at - doc[which]
                lowest, highest = np.full(size, np.iinfo(np.int64).max), np.full(size, -1)
                np.minimum.at(lowest, which, local)
                np.maximum.at(highest, which, local)
                counts = np.bincount(which, minlength=size)
                named: dict[int, set[str]] = {}
                for d, k in set(zip(which.tolist(), kind.tolist())):
                    named.setdefault(d, set()).add(hits[k][1])
                own = index.scan(words, doc)
                n_words += np.diff(doc).tolist()
                n_base += counts.tolist()
                first += [x if c else None for x, c in zip(lowest.tolist(), counts.tolist())]
                last += [x if c else None for x, c in zip(highest.tolist(), counts.tolist())]
                for d in range(size):
                    has, more = named.get(d, set()), own.get(d, {})
                    base_labels.append(",".join(sorted(has)))
                    labels.append(",".join(sorted(has | more.keys())))
                    score.append(1.0 if has else max(more.values(), default=0.0))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("text"), pa.array(n_words, pa.int64()), pa.array(n_base, pa.int64()),
                 pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(base_labels, pa.string()),
                 pa.array(labels, pa.string()), pa.array(score, pa.float64())],
                ["row", "text", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    row = base.schema["row"].dataType.simpleString()
    out = base.select("row", "text").mapInArrow(
        emit, f"row {row}, text string, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
        "base_labels string, labels string, score double")
    results = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    return unkeyed(out, docs, text_col, None, **{c: F.col(c) for c in results})


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and labels of every document."""
    return license_scan(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
