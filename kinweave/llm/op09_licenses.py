"""Operator 9: license scans by a positional index of licence words.

The words of the licence templates form a small fixed vocabulary. One pass counts in how many documents
of the whole corpus each of them stands; that gives their IDF. In the scan, each occurrence of a licence
word adds its IDF, however small, to every alignment of document and template in which it agrees, so that
all alignments in which two different words agree are compared whole.
A template is reported if enough of it agrees and one of its mandatory key phrases stands in the document,
word for word. Base phrases are found on their own and always reported.

Defined results: null and empty texts and texts without licence words have no labels ('') and score 0;
nulls in doc_id and repeated rows stay as they are; empty tables give no row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ragged, store

#: Base phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Label, notice, mandatory key phrases (one of them).
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge",)),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license version 2", "apache license 2 0")),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("attribution noncommercial",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("commons attribution 4 0",)),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ("gnu general public license as published by the free software foundation either version 3",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("neither the name of",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("this permission notice shall be included",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("permission to use copy modify and or distribute this software",)),
    ("apache-2", "terms and conditions for use reproduction and distribution definitions license shall mean the terms and conditions for use reproduction and distribution as defined by sections 1 through 9 of this document", ("license shall mean the terms and conditions for use reproduction and distribution",)),
    ("gpl-3", "the gnu general public license is a free copyleft license for software and other kinds of works", ("free copyleft license for software and other kinds of works",)),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", ("gnu general public license as published by the free software foundation either version 2",)),
    ("lgpl-3", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license", ("gnu lesser general public license as published by the free software foundation either version 3",)),
    ("agpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license", ("gnu affero general public license as published by the free software foundation either version 3",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("boost-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("any person or organization obtaining a copy",)),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law", ("dedicated the work to the public domain",)),
)
#: Identifiers of the SPDX list, as words, and their labels; a tag names one behind "SPDX-License-Identifier:".
SPDX = (
    ("mit", "mit"), ("apache-2", "apache 2 0"), ("gpl-3", "gpl 3 0 only"), ("gpl-3", "gpl 3 0 or later"), ("gpl-2", "gpl 2 0 only"), ("gpl-2", "gpl 2 0 or later"), ("lgpl-3", "lgpl 3 0 only"), ("lgpl-3", "lgpl 3 0 or later"),
    ("lgpl-2.1", "lgpl 2 1 only"), ("lgpl-2.1", "lgpl 2 1 or later"), ("agpl-3", "agpl 3 0 only"), ("agpl-3", "agpl 3 0 or later"), ("bsd", "bsd 2 clause"), ("bsd", "bsd 3 clause"), ("mpl-2", "mpl 2 0"), ("isc", "isc"), ("unlicense", "unlicense"),
    ("boost-1", "bsl 1 0"), ("cc0", "cc0 1 0"), ("cc-by", "cc by 4 0"), ("cc-by-sa", "cc by sa 4 0"), ("cc-by-nc", "cc by nc 4 0"),
)
TAGS = tuple((label, f"spdx license identifier {name}", (f"spdx license identifier {name}",)) for label, name in SPDX)
#: The same for lines that grant a licence by its name and version.
GRANTS = tuple(
    (label, f"licensed under {'' if name.startswith(('cc ', 'creative ')) else 'the '}{name}", (name,))
    for label, names in (
        ("apache-2", ("apache license version 2", "apache license 2 0", "apache 2 0 license")),
        ("gpl-3", ("gnu general public license version 3", "gnu general public license v3", "gnu gpl version 3", "gpl version 3", "gpl v3", "gplv3", "gpl 3 0")),
        ("gpl-2", ("gnu general public license version 2", "gnu general public license v2", "gnu gpl version 2", "gpl version 2", "gpl v2", "gplv2", "gpl 2 0")),
        ("lgpl-3", ("gnu lesser general public license version 3", "gnu lesser general public license v3", "lgpl version 3", "lgpl v3", "lgplv3", "lgpl 3 0")),
        ("lgpl-2.1", ("gnu lesser general public license version 2 1", "gnu lesser general public license v2 1", "lgpl version 2 1", "lgpl v2 1", "lgplv2 1", "lgpl 2 1")),
        ("agpl-3", ("gnu affero general public license version 3", "gnu affero general public license v3", "agpl version 3", "agpl v3", "agplv3", "agpl 3 0")),
        ("bsd", ("bsd license", "bsd 2 clause license", "bsd 3 clause license", "2 clause bsd license", "3 clause bsd license", "new bsd license", "simplified bsd license")),
        ("mpl-2", ("mozilla public license version 2 0", "mozilla public license v 2 0", "mozilla public license 2 0", "mpl version 2 0", "mpl 2 0")),
        *((f"cc-{kind}", (f"cc {kind.replace('-', ' ')} {v} 0", f"creative commons {long} {v} 0")) for v in (4, 3) for kind, long in (
            ("by", "attribution"), ("by-sa", "attribution sharealike"), ("by-nd", "attribution noderivatives"),
            ("by-nc", "attribution noncommercial"), ("by-nc-sa", "attribution noncommercial sharealike"), ("by-nc-nd", "attribution noncommercial noderivatives"))),
    )
    for name in names
)
ALL = TEMPLATES + GRANTS + TAGS
#: Share of a template's IDF that must agree along one alignment.
SHARE = 0.6
WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


class Index:
    """Vocabulary, postings and phrases of a list of templates. IDF is given or, before the count, equal."""

    def __init__(self, templates=ALL, base=BASE, df: dict[str, int] | None = None, n_docs: int = 0):
        self.labels = [t[0] for t in templates]
        texts = [t[1].split() for t in templates] + [k.split() for t in templates for k in t[2]] + [b[0].split() for b in base]
        self.vocabulary = sorted({w for t in texts for w in t})
        raw = [w.encode() for w in self.vocabulary]
        ends = np.cumsum([len(w) for w in raw])
        data = np.frombuffer(b"".join(raw) + b"\0" * ragged.PAD, np.uint8)
        h = ragged.hashes(data, ends - [len(w) for w in raw], ends)
        self.order = np.argsort(h)
        self.hashes = h[self.order]
        number = {w: i for i, w in enumerate(self.vocabulary)}
        self.templates = [np.array([number[w] for w in t[1].split()]) for t in templates]
        self.keys = [[np.array([number[w] for w in k.split()]) for k in t[2]] for t in templates]
        self.base = [(np.array([number[w] for w in p.split()]), label) for p, label in base]
        seen = np.array([(df or {}).get(w, 0) for w in self.vocabulary], float)
        self.idf = np.log((n_docs + 1) / (seen + 1)) + 1
        self.mass = [self.idf[t].sum() for t in self.templates]

    def numbers(self, c: ragged.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """(vocabulary number of each word or -1, first word of each text)."""
        starts, ends, first = ragged.words(c, WORD)
        h = ragged.hashes(c.data, starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.order[at], -1), first

    @staticmethod
    def places(words: np.ndarray, phrase: np.ndarray) -> np.ndarray:
        """Where the phrase stands in words."""
        n = len(words) - len(phrase) + 1
        if n <= 0:
            return np.empty(0, np.int64)
        at = np.flatnonzero(words[:n] == phrase[0])
        for k in range(1, len(phrase)):
            at = at[words[at + k] == phrase[k]]
        return at

    def base_places(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, word of that text, phrase) of all places of base phrases in a chunk."""
        out = []
        for k, (phrase, _) in enumerate(self.base):
            at = self.places(words, phrase)
            text = np.searchsorted(first, at, "right") - 1
            inside = at + len(phrase) <= first[text + 1]
            out.append(np.stack((text[inside], (at - first[text])[inside], np.full(int(inside.sum()), k))))
        return tuple(np.concatenate(out, axis=1))

    def align(self, words: np.ndarray, first: np.ndarray) -> tuple[dict[int, set[str]], np.ndarray]:
        """Labels of the templates that each text of a chunk holds, and the best share of any.

        Texts stand apart by the longest template, so that no alignment reaches two of them.
        """
        n = len(first) - 1
        own, best = {}, np.zeros(n)
        gap = max(map(len, self.templates), default=0)
        begin = first[:-1] + np.arange(1, n + 1) * gap
        at = np.flatnonzero(words >= 0)
        place = at + np.searchsorted(first, at, "right") * gap
        order = np.argsort(words[at], kind="stable")
        place, bounds = place[order], np.searchsorted(words[at][order], np.arange(len(self.vocabulary) + 1))
        size = len(words) + (n + 1) * gap
        for t, template in enumerate(self.templates):
            spot, share = self.agreements(template, place, bounds, size)
            if not len(spot):
                continue
            text, share = np.searchsorted(begin - gap + 1, spot, "right") - 1, share / self.mass[t]
            high = share >= SHARE
            np.maximum.at(best, text[~high], share[~high])
            for i in np.unique(text[high]).tolist():
                if any(len(self.places(words[first[i] : first[i + 1]], k)) for k in self.keys[t]):
                    own.setdefault(i, set()).add(self.labels[t])
                    best[i] = max(best[i], share[high & (text == i)].max())
        return own, best

    def agreements(self, template: np.ndarray, place: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(alignments in which two different words of the template agree, or its only one; the IDF that agrees in each).

        Where few words of the chunk are in the template its hits are sorted, else each alignment has a cell.
        """
        pairs = sorted(zip(template.tolist(), range(len(template)), strict=True))
        many = pairs[0][0] != pairs[-1][0]
        counts = np.array([bounds[w + 1] - bounds[w] for w, _ in pairs])
        if counts.sum() * 4 < size:
            spot = np.concatenate([place[bounds[w] : bounds[w + 1]] - p for w, p in pairs])
            word = np.repeat([w for w, _ in pairs], counts)
            at, first, where = np.unique(spot, return_index=True, return_inverse=True)
            share = np.bincount(where, self.idf[word], minlength=len(at)) if len(at) else np.zeros(0)
            agreed = np.zeros(len(at), bool)
            agreed[where[word != word[first][where]]] = True
            keep = agreed if many else np.ones(len(at), bool)
            return at[keep], share[keep]
        share, last, agreed = np.zeros(size), np.full(size, -1, np.int32), np.zeros(size, bool)
        for w, p in pairs:
            spot = place[bounds[w] : bounds[w + 1]] - p
            share[spot] += self.idf[w]
            agreed[spot] |= (last[spot] >= 0) & (last[spot] != w)
            last[spot] = w
        spot = np.flatnonzero(agreed if many else last >= 0)
        return spot, share[spot]

    def scan(self, c: ragged.Chunk) -> list[tuple[int, int, int | None, int | None, str, str, float]]:
        """n_words, n_base, first_word, last_word, base_labels, labels, score of each text."""
        words, first = self.numbers(c)
        text, place, phrase = self.base_places(words, first)
        n_base = np.bincount(text, minlength=c.n)
        low, high = np.full(c.n, len(words)), np.full(c.n, -1)
        np.minimum.at(low, text, place)
        np.maximum.at(high, text, place)
        base: dict[int, set[str]] = {}
        for t, k in zip(text.tolist(), phrase.tolist(), strict=True):
            base.setdefault(t, set()).add(self.base[k][1])
        found, best = self.align(words, first)
        out = []
        for i in range(c.n):
            own, named, hit = found.get(i, set()), base.get(i, set()), n_base[i] > 0
            score = 1.0 if hit else round(min(float(best[i]), 1.0), 6)
            out.append((int(first[i + 1] - first[i]), int(n_base[i]), int(low[i]) if hit else None, int(high[i]) if hit else None, ",".join(sorted(named)), ",".join(sorted(named | own)), score))
        return out


def document_frequencies(docs: DataFrame, text_col: str = "text", templates=ALL, base=BASE) -> tuple[dict[str, int], int]:
    """In how many of all documents each word of the templates stands, and how many documents there are.

    What comes back has a row for each word of the fixed templates.
    """
    vocabulary = Index(templates, base).vocabulary

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, seen, n = Index(templates, base), np.zeros(len(vocabulary), np.int64), 0
        for batch in batches:
            for c in ragged.chunks(batch.column(0), table=ragged.LOWER):
                words, first = index.numbers(c)
                hit = np.flatnonzero(words >= 0)
                text = np.searchsorted(first, hit, "right") - 1
                pairs = np.unique(text * len(vocabulary) + words[hit])
                seen += np.bincount(pairs % len(vocabulary), minlength=len(vocabulary))
                n += c.n
        yield pa.RecordBatch.from_arrays([pa.array([*range(len(vocabulary)), -1], pa.int64()), pa.array([*seen.tolist(), n], pa.int64())], names=["word", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    got = {r["word"]: r["n"] for r in rows}
    return {w: got.get(i, 0) for i, w in enumerate(vocabulary)}, got.get(-1, 0)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=ALL, base=BASE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row."""
    df, n_docs = document_frequencies(docs, text_col, templates, base)
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates, base, df, n_docs)
        for batch in batches:
            for c in ragged.chunks(batch.column(1), table=ragged.LOWER):
                columns = zip(*index.scan(c), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0)[c.lo : c.hi], *(pa.array(v, k) for v, k in zip(columns, kinds, strict=True))], names=names)

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scan, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(store.documents(spark, sf_dir))
