"""Licence scans: a positional index of the rare words of licence texts.

A *phrase* is a run of words that names a licence by itself; a *template* is the wording of a notice, which files
carry with words changed, left out or put in, together with the key phrases that it can't do without. Of the words
of all of them a first pass over every document takes the document frequency; the index then holds, for each
template, the places of its :data:`RARE` words of highest inverse document frequency, and for each phrase those of its
two rarest words. A file's words are looked up in it, so what is found are its own highest-IDF licence words:

* a phrase occurs where the places of its two rarest words in the file agree with their distance in the phrase and
  a direct comparison of all its words holds, so no occurrence is missed;
* a template is a candidate at each start on which at least half of its indexed places agree, and is found if all its key
  phrases occur in the words that it spans there, :data:`SLACK` words more on both sides. Its score is the agreeing share.

Rows of a document frequency of zero can't be found and aren't indexed. The index is a fixed list of texts: its size
and that of the counts sent to the driver (a number a word of it) don't grow with the data. Files are worked
through in slices; a long text is made into word numbers part by part and aligned in windows of :data:`WINDOW` words.

Null text: empty, no words. No label: score 0. Repeated rows and ids are scanned each by itself; an empty
table gives an empty table. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripstar.llm.base import map_arrow, spark_schema, text_slices, texts

#: Words of a template in the index; words beside a template's span in which its key phrases may stand.
RARE, SLACK = 8, 20
#: Words aligned at once; bytes of text made into words at once.
WINDOW, CHUNK = 1 << 20, 1 << 20

# Separators are the ASCII characters other than digits and letters; A-Z become a-z.
_FOLD = bytes((c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32)
              for c in range(256))


class Template(NamedTuple):
    label: str
    text: str
    keys: tuple[str, ...]


# The phrases of the contract, and the wording of public licence notices.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
TEMPLATES = [
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
             "associated documentation files the software to deal in the software without restriction including "
             "without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
             "copies of the software", ("permission is hereby granted free of charge", "deal in the software")),
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except "
             "in compliance with the license you may obtain a copy of the license at",
             ("apache license version 2", "in compliance with the license")),
    Template("gpl", "this work is licensed under the gnu general public license version",
             ("gnu general public license",)),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the "
             "gnu general public license as published by the free software foundation either version",
             ("gnu general public license", "free software foundation")),
    Template("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the "
             "gnu lesser general public license as published by the free software foundation either version",
             ("gnu lesser general public license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted "
             "provided that the following conditions are met redistributions of source code must retain the above "
             "copyright notice this list of conditions and the following disclaimer",
             ("redistribution and use in source and binary forms", "retain the above copyright notice")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without "
             "fee is hereby granted provided that the above copyright notice and this permission notice appear in "
             "all copies", ("permission to use copy modify", "with or without fee")),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy "
             "of the mpl was not distributed with this file you can obtain one at", ("mozilla public license",)),
    Template("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international "
             "license", ("creative commons attribution sharealike",)),
    Template("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international "
             "license", ("creative commons attribution noncommercial",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain anyone is free to "
             "copy modify publish use compile sell or distribute this software",
             ("free and unencumbered software", "public domain")),
]


class Library:
    """The words of phrases and templates, numbered from 1 (0: any other word), and what they are looked up by."""

    def __init__(self, phrases=None, templates=None):
        self.phrases = [(label, p.split()) for label, p in (PHRASES if phrases is None else phrases)]
        self.templates = TEMPLATES if templates is None else templates
        self.keys = sorted({k for t in self.templates for k in t.keys})
        runs = [p for _, p in self.phrases] + [k.split() for k in self.keys] + [t.text.split() for t in self.templates]
        self.words = sorted({w for r in runs for w in r})
        self.number = {w.encode(): i + 1 for i, w in enumerate(self.words)}
        self.longest = max(map(len, runs))
        #: Empty places between documents: no run, with its slack, reaches over them.
        self.gap = self.longest + 2 * SLACK

    def numbers(self, text: bytes):
        """The word numbers of a text, made part by part."""
        import numpy as np

        parts, start, get = [], 0, self.number.get
        text = text.translate(_FOLD)
        while start < len(text):
            stop = text.find(b" ", start + CHUNK)
            stop = len(text) if stop < 0 else stop
            words = text[start:stop].split()
            parts.append(np.fromiter((get(w, 0) for w in words), np.int32, len(words)))
            start = stop
        return np.concatenate(parts) if parts else np.empty(0, np.int32)

    def laid_out(self, batch: list[bytes]):
        """All texts in one array with gaps between them, and each text's first place and number of words."""
        import numpy as np

        each = [self.numbers(t) for t in batch]
        n = np.array([len(x) for x in each], np.int64)
        first = np.cumsum(n + self.gap) - n
        ids = np.zeros(int((n + self.gap).sum()) + self.gap, np.int32)
        for at, own in zip(first.tolist(), each):
            ids[at:at + len(own)] = own
        return ids, first, n


class Index(Library):
    """The library with the places of its rare words, by the document frequencies given."""

    def __init__(self, frequency: dict[str, int], phrases=None, templates=None):
        import numpy as np

        super().__init__(phrases, templates)
        self.rarity = {self.number[w.encode()]: (n, w) for w, n in frequency.items() if n}

        def rarest(run, most):
            return sorted({w for w in run if w in self.rarity}, key=self.rarity.get)[:most]

        def numbered(run):
            return [self.number[w.encode()] for w in run]

        # A run with a word that no document holds can't occur.
        self.runs = [np.array(r) if set(r) <= set(self.rarity) else None
                     for r in map(numbered, [*(p for _, p in self.phrases), *(k.split() for k in self.keys)])]
        self.anchors = [None if r is None else [(w, r.tolist().index(w)) for w in rarest(r.tolist(), 2)]
                        for r in self.runs]
        postings = []   # (word, template, place)
        for t, template in enumerate(self.templates):
            run = numbered(template.text.split())
            own = set(rarest(run, RARE))
            postings += [(w, t, q) for q, w in enumerate(run) if w in own]
        postings.sort()
        columns = np.array(postings, np.int64).reshape(-1, 3).T
        self.post_template, self.post_place = columns[1], columns[2]
        self.post_start = np.searchsorted(columns[0], np.arange(len(self.words) + 2))
        self.of = np.bincount(self.post_template, minlength=len(self.templates))
        self.length = np.array([len(t.text.split()) for t in self.templates])
        self.looked_up = np.zeros(len(self.words) + 1, bool)
        self.looked_up[columns[0]] = True
        for a in self.anchors:
            for w, _ in a or ():
                self.looked_up[w] = True

    def occurrences(self, ids):
        """Per phrase and key phrase: the sorted places where it stands."""
        import numpy as np

        at = np.flatnonzero(self.looked_up[ids])
        order = np.argsort(ids[at], kind="stable")
        at, words = at[order], ids[at[order]]
        out = []
        for run, anchors in zip(self.runs, self.anchors):
            if run is None:
                out.append(np.empty(0, np.int64))
                continue
            w, q = anchors[0]
            start = at[np.searchsorted(words, w):np.searchsorted(words, w, side="right")] - q
            for w, q in anchors[1:]:                      # the other rare word at the same distance
                start = start[ids[start + q] == w]
            for k, w in enumerate(run):                   # direct comparison
                start = start[ids[start + k] == w]
            out.append(start)
        return out

    def candidates(self, ids):
        """(template, start, agreeing places) of every start on which half of a template's places agree."""
        import numpy as np

        found = []
        at = np.flatnonzero(self.looked_up[ids])
        for lo in range(0, len(ids), WINDOW):             # starts in [lo, lo + WINDOW)
            own = at[np.searchsorted(at, lo):np.searchsorted(at, lo + WINDOW + self.longest)]
            first = self.post_start[ids[own]]
            n = self.post_start[ids[own] + 1] - first
            p = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
            start = np.repeat(own, n) - self.post_place[p]
            stays = (start >= lo) & (start < lo + WINDOW)
            key, agree = np.unique(start[stays] * len(self.templates) + self.post_template[p[stays]],
                                   return_counts=True)
            t = key % len(self.templates)
            good = 2 * agree >= self.of[t]
            found.append((t[good], key[good] // len(self.templates), agree[good]))
        return [np.concatenate(x) for x in zip(*found)] if found else [np.empty(0, np.int64)] * 3

    def scan(self, batch: list[bytes]):
        """→ words of each text; (text, phrase, start) of each phrase's places; (text, template, start, share) of each
        template found, its best start only."""
        import numpy as np

        ids, first, n = self.laid_out(batch)
        places = self.occurrences(ids)
        t, start, agree = self.candidates(ids)
        key_of = {k: places[len(self.phrases) + i] for i, k in enumerate(self.keys)}
        good = np.ones(len(t), bool)
        for i, template in enumerate(self.templates):
            own = np.flatnonzero(t == i)
            for k in template.keys:
                lo = np.searchsorted(key_of[k], start[own] - SLACK)
                hi = np.searchsorted(key_of[k], start[own] + self.length[i] + SLACK - len(k.split()), side="right")
                good[own] &= hi > lo
        t, start, share = t[good], start[good], agree[good] / np.maximum(self.of[t[good]], 1)
        # A start may lie before its text, never as far as the one before.
        doc = np.searchsorted(first - self.longest, start, side="right") - 1
        order = np.lexsort((start, -share, t, doc))
        doc, t, start, share = doc[order], t[order], start[order], share[order]
        best = np.ones(len(doc), bool)
        best[1:] = (doc[1:] != doc[:-1]) | (t[1:] != t[:-1])
        templates = doc[best], t[best], start[best] - first[doc[best]], share[best]

        phrase = np.repeat(np.arange(len(self.phrases)), [len(x) for x in places[:len(self.phrases)]])
        at = np.concatenate([*places[:len(self.phrases)], np.empty(0, np.int64)])
        doc = np.searchsorted(first, at, side="right") - 1
        order = np.lexsort((phrase, at, doc))
        return n, (doc[order], phrase[order], (at - first[doc])[order]), templates


def _lists(n: int, doc, columns: dict) -> pa.ListArray:
    """Rows sorted by document as a list of structs a document."""
    import numpy as np

    offsets = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(
        [pa.array(v) for v in columns.values()], names=list(columns)))


def frequencies(docs: DataFrame, library: Library) -> dict[str, int]:
    """The number of documents that hold each word of the library: one number a word reaches the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        total = np.zeros(len(library.words) + 1, np.int64)
        for batch in batches:
            for part in text_slices(batch):
                ids, first, _ = library.laid_out(texts(part))
                at = np.flatnonzero(ids)
                doc = np.searchsorted(first, at, side="right")
                total += np.bincount(np.unique(doc * len(total) + ids[at]) % len(total), minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(library.words), pa.array(total[1:])], names=["word", "docs"])

    counts = map_arrow(docs.select("text"), run, "word string, docs long")
    return {r.word: r.docs for r in counts.groupBy("word").agg(F.sum("docs").alias("docs")).collect()}


def scan(docs: DataFrame, phrases=None, templates=None) -> DataFrame:
    """docs(doc_id, text) → doc_id, n_words, places (label, start and words of every place of a phrase, by start),
    notices (label, start and share of every template found)."""
    shared = docs.sparkSession.sparkContext.broadcast(
        Index(frequencies(docs, Library(phrases, templates)), phrases, templates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        index = shared.value
        names = np.array([x for x, _ in index.phrases], object)
        sizes = np.array([len(p) for _, p in index.phrases], np.int32)
        notices = np.array([t.label for t in index.templates], object)
        for batch in batches:
            for part in text_slices(batch):
                n, (d, p, at), (dt, t, start, share) = index.scan(texts(part))
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array(n),
                    _lists(len(n), d, {"label": pa.array(names[p], pa.string()), "start": at.astype(np.int64),
                                       "words": sizes[p]}),
                    _lists(len(n), dt, {"label": pa.array(notices[t], pa.string()), "start": start.astype(np.int64),
                                        "share": share.astype(np.float64)})],
                    names=["doc_id", "n_words", "places", "notices"])

    return map_arrow(docs.select("doc_id", "text"), run, spark_schema(docs, ["doc_id"]) + """, n_words long,
        places array<struct<label:string,start:long,words:int>>,
        notices array<struct<label:string,start:long,share:double>>""")


def oracle_sql() -> str:
    """The same in DuckDB SQL: phrases compared at every word, templates aligned by joins."""
    def rows(name, columns, values):
        return f"{name}({', '.join(columns)}) AS (VALUES {', '.join(str(v) for v in values)})"

    library = Library()
    runs = [("b", label, " ".join(p)) for label, p in library.phrases] + [("k", k, k) for k in library.keys]
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
WITH {rows('run', ['kind', 'name', 'text'], runs)},
{rows('template', ['t', 'label', 'text'], [(i, x.label, x.text) for i, x in enumerate(TEMPLATES)])},
{rows('mandatory', ['t', 'name'], [(i, k) for i, x in enumerate(TEMPLATES) for k in x.keys])},
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'),
                                        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
word AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS p FROM d),
run_word AS (SELECT kind, name, len(string_split(text, ' ')) AS size, unnest(string_split(text, ' ')) AS w,
                    unnest(range(len(string_split(text, ' ')))) AS q FROM run),
place AS (SELECT doc_id, kind, name, p - q AS s, any_value(size) AS size FROM word JOIN run_word USING (w)
          GROUP BY doc_id, kind, name, p - q HAVING count(*) = any_value(size)),
template_word AS (SELECT t, unnest(string_split(text, ' ')) AS w, unnest(range(len(string_split(text, ' ')))) AS q
                  FROM template),
frequency AS (SELECT w, count(DISTINCT doc_id) AS df FROM word SEMI JOIN template_word USING (w) GROUP BY w),
rare AS (SELECT t, w FROM (SELECT DISTINCT t, w, df FROM template_word JOIN frequency USING (w))
         QUALIFY row_number() OVER (PARTITION BY t ORDER BY df, w) <= {RARE}),
posting AS (SELECT t, w, q, count(*) OVER (PARTITION BY t) AS places FROM template_word SEMI JOIN rare USING (t, w)),
aligned AS (SELECT doc_id, t, p - q AS s, count(*) AS agree, any_value(places) AS places
            FROM word JOIN posting USING (w) GROUP BY doc_id, t, p - q HAVING 2 * count(*) >= any_value(places)),
held AS (SELECT a.doc_id, a.t, a.s, any_value(a.agree) AS agree, any_value(a.places) AS places,
                count(DISTINCT m.name) AS met
         FROM aligned a JOIN template USING (t) JOIN mandatory m USING (t)
         JOIN place k ON k.doc_id = a.doc_id AND k.kind = 'k' AND k.name = m.name
              AND k.s >= a.s - {SLACK} AND k.s + k.size <= a.s + len(string_split(text, ' ')) + {SLACK}
         GROUP BY a.doc_id, a.t, a.s),
notice AS (SELECT doc_id, label, agree / places AS share FROM held JOIN template USING (t)
           WHERE met = (SELECT count(*) FROM mandatory m WHERE m.t = held.t)),
base AS (SELECT doc_id, count(*) AS n_base, min(s) AS first_word, max(s) AS last_word,
                string_agg(DISTINCT name, ',' ORDER BY name) AS base_labels FROM place WHERE kind = 'b' GROUP BY doc_id),
label AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
          FROM (SELECT doc_id, name AS label, 1.0::DOUBLE AS share FROM place WHERE kind = 'b'
                UNION ALL SELECT doc_id, label, share FROM notice) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
       last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN label USING (doc_id)
"""
