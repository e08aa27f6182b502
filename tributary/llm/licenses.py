"""License scans with a positional index of rare words.

Templates are short texts of licences with key phrases. The index files every place of a template's words; words are
ranked by their IDF over all documents. A file's licence words have postings, their places in ascending order. Each
template is looked up by its rarest places, so many that an alignment that counts must hold one of them: the postings of
such a word, less its place in the template, give offsets, and the postings of the template's other words are intersected
with these by relative position. An alignment counts if enough of the template's words stand where they should and one of
its key phrases stands there word for word. A template that is nothing but a key phrase is found wherever it stands.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ragged import ALNUM, Texts, Words, chunks, word_hashes, words

#: Share of a template's words that must stand at their places.
AGREE = 0.6


def anchors(m: int) -> int:
    """Places of a template of m words of which every alignment that counts holds one at least."""
    return m - next(c for c in range(m + 1) if c / m >= AGREE) + 1


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    #: Phrases of the text of which one must stand in the file; none: the whole text must.
    keys: tuple[str, ...] = ()
    base: bool = False


#: The contract's phrases, then sentences of public licence texts.
TEMPLATES = (
    Template("gpl", "gnu general public license", base=True),
    Template("apache", "apache license", base=True),
    Template("cc-by", "cc by", base=True),
    Template("mit", "mit license", base=True),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("free software foundation", "gnu general public license")),
    Template("gpl", "this work is licensed under the gnu general public license version 3", ("gnu general public license",)),
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license"),
    Template("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license", "in compliance with the license")),
    Template("cc-by-nc", "cc by nc"),
    Template("cc-by-sa", "cc by sa"),
    Template("cc-by-nd", "cc by nd"),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms", "following conditions are met")),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("all-rights-reserved", "all rights reserved"),
    Template("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", ("gnu general public license",)),
    Template("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("lesser general public license",)),
    Template("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ("distributed on an as is basis",)),
    Template("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("copies or substantial portions of the software",)),
    Template("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products derived from this software",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", ("alter it and redistribute it freely",)),
    Template("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", ("eclipse public license",)),
    Template("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    Template("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
)


def _hashes(text: str) -> np.ndarray:
    b = np.frombuffer(text.encode(), np.uint8)
    t = Texts(0, 1, b, np.array([0, len(b)]))
    return word_hashes(t, words(t, ALNUM))


class Index:
    """Postings of the templates' words, with the words' IDF."""

    def __init__(self, templates: tuple[Template, ...]):
        self.templates = templates
        self.words = [_hashes(t.text) for t in templates]
        self.vocabulary = np.unique(np.concatenate(self.words))
        self.term = [np.searchsorted(self.vocabulary, w) for w in self.words]
        self.key_terms = [[np.searchsorted(self.vocabulary, _hashes(k)) for k in (t.keys or (t.text,))] for t in templates]
        self.idf = np.ones(len(self.vocabulary))

    def weigh(self, df: np.ndarray, n: int) -> None:
        self.idf = np.log((1 + n) / (1 + df)) + 1e-9

    def postings(self, h: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Places of the words that any template has, and each licence word's own, ascending."""
        if not len(h):
            return np.zeros(0, np.int64), [np.zeros(0, np.int64)] * len(self.vocabulary)
        to = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        at = np.flatnonzero(self.vocabulary[to] == h)
        term = to[at]
        by_term = at[np.argsort(term, kind="stable")]
        return at, np.split(by_term, np.cumsum(np.bincount(term, minlength=len(self.vocabulary)))[:-1])

    def alignments(self, k: int, postings: list[np.ndarray], w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, first words and agreement of the places where template k stands."""
        term = self.term[k]
        m = len(term)
        phrase = not self.templates[k].keys
        rarest = np.argsort(-self.idf[term], kind="stable")
        # of a phrase every word must be there, so its rarest one finds all places
        tried = rarest[:1] if phrase else rarest[: anchors(m)]
        anchor = [postings[term[j]] for j in tried]
        r = np.repeat(np.arange(len(w.woff) - 1), w.counts)[np.concatenate(anchor)]
        start = np.concatenate([x - j for x, j in zip(anchor, tried, strict=True)])
        size = int(w.woff[-1]) + m
        if phrase:
            fits = (start >= w.woff[r]) & (start + m <= w.woff[r + 1])
            start, r = start[fits], r[fits]
            for j in rarest[1:]:
                same = _among(start + j, postings[term[j]])
                start, r = start[same], r[same]
            return r, start, np.ones(len(start))
        # a template may be cut off at either end of a file: words beyond its row don't count
        code = np.unique(r * size + start + m)
        r, start = code // size, code % size - m
        same = np.zeros(len(start))
        for j in range(m):
            p = start + j
            same += (p >= w.woff[r]) & (p < w.woff[r + 1]) & _among(p, postings[term[j]])
        share = same / m
        keep = np.flatnonzero(share >= AGREE)
        keep = [i for i in keep if self._key(k, postings, max(int(w.woff[r[i]]), int(start[i]) - m), min(int(w.woff[r[i] + 1]), int(start[i]) + 2 * m))]
        return r[keep], np.maximum(start[keep], w.woff[r[keep]]), share[keep]

    def _key(self, k: int, postings: list[np.ndarray], lo: int, hi: int) -> bool:
        """Whether one of template k's key phrases stands word for word in lo:hi."""
        for key in self.key_terms[k]:
            own = postings[key[0]]
            at = own[np.searchsorted(own, lo) : np.searchsorted(own, hi - len(key) + 1)]
            for j in range(1, len(key)):
                at = at[_among(at + j, postings[key[j]])]
            if len(at):
                return True
        return False


def _among(places: np.ndarray, posting: np.ndarray) -> np.ndarray:
    """Which places are in an ascending posting."""
    if not len(posting):
        return np.zeros(len(places), bool)
    return posting[np.minimum(np.searchsorted(posting, places), len(posting) - 1)] == places


def scan(index: Index, t: Texts) -> dict[str, list]:
    rows = t.hi - t.lo
    w = words(t, ALNUM)
    h = word_hashes(t, w)
    base, first, last = np.zeros(rows, np.int64), np.full(rows, -1), np.full(rows, -1)
    score = np.zeros(rows)
    base_labels: list[set[str]] = [set() for _ in range(rows)]
    labels: list[set[str]] = [set() for _ in range(rows)]
    _, postings = index.postings(h)
    weight = np.zeros(rows)
    for k, template in enumerate(index.templates):
        r, start, share = index.alignments(k, postings, w)
        for i, s, x in zip(r.tolist(), start.tolist(), share.tolist(), strict=True):
            labels[i].add(template.label)
            mass = float(index.idf[index.term[k]].sum()) * x
            weight[i] = max(weight[i], mass)
            if template.base:
                s -= int(w.woff[i])
                base[i] += 1
                base_labels[i].add(template.label)
                first[i] = s if first[i] < 0 else min(first[i], s)
                last[i] = max(last[i], s)
    full = max(float(index.idf[t_].sum()) for t_ in index.term)
    score = np.where(weight > 0, np.minimum(1, 0.5 + 0.5 * weight / full), 0.0)
    return {
        "n_words": w.counts.tolist(), "n_base": base.tolist(),
        "first_word": [x if x >= 0 else None for x in first.tolist()], "last_word": [x if x >= 0 else None for x in last.tolist()],
        "base_labels": [",".join(sorted(x)) for x in base_labels], "labels": [",".join(sorted(x)) for x in labels], "score": score.tolist(),
    }


_FIELDS = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64()}


def document_frequencies(texts: DataFrame, index) -> tuple[np.ndarray, int]:
    """In how many documents each licence word stands, and their number; counted over all of them."""
    size = len(index.value.vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(size, np.int64), 0
        for b in batches:
            for t in chunks(b.column(0)):
                w = words(t, ALNUM)
                _, postings = index.value.postings(word_hashes(t, w))
                rows = w.rows()
                df += [len(np.unique(rows[p])) for p in postings]
                n += t.hi - t.lo
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int32()), pa.array(np.append(df[some], n), pa.int64())], ["term", "n"])

    df, n = np.zeros(size, np.int64), 0
    for r in texts.mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # a row for each licence word
        if r["term"] < 0:
            n = r["n"]
        else:
            df[r["term"]] = r["n"]
    return df, n


def license_scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """Per row of df: doc_id, n_words, n_base (places of base phrases), first_word and last_word (their smallest and
    largest start, null without any), base_labels and labels (distinct, sorted, comma-joined; empty without any), score.

    Words are runs of digits, letters and characters beyond ASCII, A-Z lower-cased. score: 0 without a label, else from
    0.5 to 1 by the IDF of the best template found. A null text counts as empty. Every row stays, repeated ones too; other
    columns are left out, so their names can't clash. A very long text is scanned whole, as a chunk of its own; an empty table
    gives no rows. Two narrow passes; the templates, a fixed list, are broadcast.
    """
    sc = df.sparkSession.sparkContext
    index = Index(templates)
    index.weigh(*document_frequencies(df.select(F.col(text).alias("text")), sc.broadcast(index)))
    ready = sc.broadcast(index)
    kind = df.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in chunks(b.column(1)):
                found = scan(ready.value, t)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(t.lo, t.hi - t.lo), *(pa.array(found[c], k) for c, k in _FIELDS.items())], ["doc_id", *_FIELDS])

    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    )
