"""Licences named or quoted in texts: a positional index of rare licence words over short licence templates.

Every template has key phrases without which it is not accepted. The index has one posting per template: of its first key
phrase, the word that the fewest documents have (the highest IDF, counted over all documents). A text is only looked at where
such a word stands; from there the key phrases are verified word by word, later ones within SLACK words of their relative
positions, and the template's other words are looked for in the same way. Postings are not intersected, and a notice with a
clause put in that moves a later key phrase further is not found.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidegauge.llm.frames import extend, fields, tidy, with_columns_of
from tidegauge.llm.textbytes import ALNUM, LOWER, Powers, Words, byte_values, chunks, span_hashes

# Base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Wording of public licence notices as (label, text, key phrases in order).
TEMPLATES = [
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
     "public license as published by the free software foundation either version 3 of the license or at your option any "
     "later version", ["terms of the gnu general public license", "version 3 of the license"]),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
     "public license as published by the free software foundation either version 2 of the license or at your option any "
     "later version", ["terms of the gnu general public license", "version 2 of the license"]),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published "
     "by the free software foundation", ["gnu lesser general public license"]),
    ("agpl-3.0", "you can redistribute it and or modify it under the terms of the gnu affero general public license as "
     "published by the free software foundation", ["gnu affero general public license"]),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance "
     "with the license you may obtain a copy of the license at", ["apache license version 2 0", "in compliance with the license"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files the software to deal in the software without restriction",
     ["permission is hereby granted free of charge", "deal in the software without restriction"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
     "granted", ["for any purpose with or without fee"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the "
     "following conditions are met", ["redistribution and use in source and binary forms"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0",
     ["mozilla public license v 2 0"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-nc-4.0", "licensed under a creative commons attribution noncommercial 4 0 international license",
     ["creative commons attribution noncommercial 4 0"]),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license",
     ["creative commons attribution 4 0"]),
]
#: How far a template's word or later key phrase may stand from its place, in words.
SLACK = 8


def word_hash(words) -> np.ndarray:
    """The hashes that ``span_hashes`` gives for these words."""
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    own = Words(data, np.array([0, len(data)]), ALNUM)
    return span_hashes(data, own.starts, own.ends, Powers(), byte_values())


def _scan_words(column):
    """(first row, end row, words, hashes) of the chunks of a text column."""
    powers, values = Powers(), byte_values()
    for at, end, data, offsets in chunks(column):
        data = LOWER[data]
        words = Words(data, offsets, ALNUM)
        yield at, end, words, span_hashes(data, words.starts, words.ends, powers, values)


def document_frequencies(docs: DataFrame, vocabulary: list[str], text_col="text") -> tuple[int, dict]:
    """Rows, and in how many of them each word of the vocabulary stands: one number per word comes to the driver."""
    vocabulary = sorted(vocabulary)
    known = word_hash(vocabulary)
    order = np.argsort(known)

    def count(batches):
        total, rows = np.zeros(len(vocabulary) + 1, dtype=np.int64), 0
        for batch in batches:
            for at, end, words, hashes in _scan_words(batch.column(0)):
                place = np.minimum(np.searchsorted(known[order], hashes), len(order) - 1)
                hit = np.flatnonzero(known[order][place] == hashes)
                pairs = np.unique(words.text_of_word()[hit] * len(order) + order[place[hit]])
                total[:-1] += np.bincount(pairs % len(order), minlength=len(order))
                rows += end - at
        total[-1] = rows
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(total[full])], names=["word", "docs"])

    found = (docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(count, "word long, docs long")
             .groupBy("word").agg(F.sum("docs").alias("docs")).collect())
    by = {r["word"]: r["docs"] for r in found}
    return by.get(len(vocabulary), 0), {w: by.get(i, 0) for i, w in enumerate(vocabulary)}


class Index:
    """Templates as word hashes, and the postings of their rare words: hash -> (template, position of the word)."""

    def __init__(self, templates, idf):
        self.labels = [label for label, _, _ in templates]
        self.words = [word_hash(text.split()) for _, text, _ in templates]
        self.weights = [np.array([idf[w] for w in text.split()]) for _, text, _ in templates]
        self.phrases, self.postings = [], {}
        for t, (_, text, phrases) in enumerate(templates):
            words, places = text.split(), []
            for phrase in phrases:
                p = phrase.split()
                places.append((next(i for i in range(len(words)) if words[i:i + len(p)] == p), word_hash(p)))
            self.phrases.append(places)
            at, rare = places[0][0], phrases[0].split()
            key = max(range(len(rare)), key=lambda i: (idf[rare[i]], -i))
            self.postings.setdefault(int(word_hash([rare[key]])[0]), []).append((t, at + key))
        self.keys = np.array(sorted(self.postings), dtype=np.uint64)

    def accepted(self, hashes):
        """(label, score, first word) for each place of a text where a template stands."""
        place = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        for p in np.flatnonzero(self.keys[place] == hashes):
            for t, q in self.postings[int(hashes[p])]:
                start = int(p) - q
                if all(self._stands(hashes, start + at, phrase, exact=i == 0) for i, (at, phrase) in enumerate(self.phrases[t])):
                    yield self.labels[t], self._share(hashes, start, t), max(start, 0)

    def _stands(self, hashes, at, phrase, exact):
        shifts = [0] if exact else range(-SLACK, SLACK + 1)
        return any(0 <= at + s and np.array_equal(hashes[at + s:at + s + len(phrase)], phrase) for s in shifts)

    def _share(self, hashes, start, t):
        """Share of the template's words, weighted by IDF, that stand near their relative position."""
        words, weights = self.words[t], self.weights[t]
        near = np.arange(start, start + len(words))[:, None] + np.arange(-SLACK, SLACK + 1)[None, :]
        inside = (near >= 0) & (near < len(hashes))
        found = ((hashes[np.clip(near, 0, len(hashes) - 1)] == words[:, None]) & inside).any(axis=1)
        return float(weights[found].sum() / weights.sum())


def scan(docs: DataFrame, text_col="text", templates=TEMPLATES, min_share=0.6) -> DataFrame:
    """Adds n_words, n_base, first_word, last_word (longs), base_labels, labels (arrays) and score to ``docs``.

    A-Z is lower-cased; words are runs of digits, letters and characters beyond ASCII. n_base counts the places where a
    base phrase stands, first_word and last_word are the least and greatest of them (null without any). ``labels`` has the
    base labels and those of accepted templates: all key phrases stand, the first one at the rare word, the others near
    their relative position, and at least ``min_share`` of the template (by IDF) is there. score is the greatest share of
    an accepted template, or 0. Null texts are empty. Columns of the added names give way. Words are compared by 64-bit
    hashes of their bytes.
    """
    docs = tidy(docs, [text_col], ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])
    vocabulary = sorted({w for _, text, _ in templates for w in text.split()})
    rows, docs_with = document_frequencies(docs, vocabulary, text_col)
    idf = {w: float(np.log((rows + 2) / (docs_with[w] + 1))) for w in vocabulary}

    def run(batches):
        index = Index(templates, idf)
        base = [(word_hash(phrase.split()), label) for phrase, label in BASE.items()]
        for batch in batches:
            made = []
            for at, end, words, hashes in _scan_words(batch.column(text_col)):
                places = [_places(hashes, phrase) for phrase, _ in base]
                maybe = np.flatnonzero(np.isin(hashes, index.keys))
                for i in range(end - at):
                    a, b = int(words.first[i]), int(words.first[i + 1])
                    starts, names = [], set()
                    for (phrase, label), p in zip(base, places):
                        own = p[(p >= a) & (p + len(phrase) <= b)] - a
                        if len(own):
                            starts += own.tolist()
                            names.add(label)
                    found = []
                    if np.searchsorted(maybe, a) < np.searchsorted(maybe, b):
                        found = [x for x in index.accepted(hashes[a:b]) if x[1] >= min_share]
                    made.append((b - a, len(starts), min(starts, default=None), max(starts, default=None), sorted(names),
                                 sorted(names | {x[0] for x in found}), max((min(x[1], 1.0) for x in found), default=0.0)))
            cols = list(zip(*made)) if made else [[]] * 7
            yield extend(batch, {
                "n_words": pa.array(cols[0], pa.int64()), "n_base": pa.array(cols[1], pa.int64()),
                "first_word": pa.array(cols[2], pa.int64()), "last_word": pa.array(cols[3], pa.int64()),
                "base_labels": pa.array(cols[4], pa.list_(pa.string())), "labels": pa.array(cols[5], pa.list_(pa.string())),
                "score": pa.array(cols[6], pa.float64())})

    return docs.mapInArrow(run, with_columns_of(docs, fields(
        "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, "
        "score double")))


def _places(hashes, phrase):
    """First words of all runs equal to the phrase, whatever text they lie in."""
    n = len(hashes) - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(hashes[:n] == phrase[0])
    for j in range(1, len(phrase)):
        at = at[hashes[at + j] == phrase[j]]
    return at
