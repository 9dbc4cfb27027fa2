"""Licence scan by a positional index of rare words.

Each template is a notice. Its words have postings (template, place) and an IDF over the templates; it is found by its
RARE_WORDS words of the highest IDF. Of a text's licence words, from the highest IDF down, those are looked up of which a
template can still be made: it has half of its rare words in the text. Postings that agree on the relative place (place
in the text less place in the template, up to DRIFT words that were put in or left out between) vote for the template
standing there. A candidate counts once its mandatory phrases are found consecutively near that place and enough of its
words follow each other in order: that share is its coverage.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The phrases of the base labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Fixed values: (label, notice, phrases that must be there).
TEMPLATES = (
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3.", ("gnu general public license", "version 3")),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License, version 2", ("gnu general public license", "version 2")),
    ("gpl-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ("gnu general public license", "version 3 of the license", "any later version")),
    ("gpl-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", ("gnu general public license", "version 2 of the license", "any later version")),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", ("lesser general public license",)),
    ("lgpl-2.1-or-later", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", ("lesser general public license", "version 2 1 of the license")),
    ("lgpl-3.0-or-later", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ("lesser general public license", "version 3 of the license")),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ("affero general public license",)),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    ("cc-by-4.0", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    ("cc-by-3.0", "This work is licensed under a Creative Commons Attribution 3.0 Unported License", ("creative commons attribution 3 0",)),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("creative commons attribution sharealike",)),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("creative commons attribution noncommercial",)),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", ("creative commons attribution noderivatives",)),
    ("cc-by-nc-sa", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", ("attribution noncommercial sharealike",)),
    ("cc-by-nc-nd", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", ("attribution noncommercial noderivatives",)),
    ("cc0", "To the extent possible under law the person who associated CC0 with this work has waived all copyright and related rights", ("cc0",)),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    ("mit", "Released under the MIT License", ("mit license",)),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License", ("apache license version 2 0",)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", ("endorse or promote products derived from this software",)),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license",)),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", ("eclipse public license",)),
    ("cddl", "The contents of this file are subject to the terms of the Common Development and Distribution License", ("common development and distribution license",)),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", ("in no event will the authors be held liable",)),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0", ("boost software license",)),
    ("ofl-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1", ("sil open font license",)),
    ("eupl-1.2", "Licensed under the EUPL, Version 1.2 or later", ("eupl version 1 2",)),
    ("artistic-2.0", "You may copy and distribute this work under the terms of the Artistic License 2.0", ("artistic license 2 0",)),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
)
# Identifiers that stand after the words "SPDX License Identifier", each a template of its own.
IDENTIFIERS = ("Apache-2.0", "MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-or-later", "AGPL-3.0-or-later", "MPL-2.0", "EPL-2.0", "Zlib", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "Unlicense")
TEMPLATES += tuple((name.lower(), f"SPDX-License-Identifier: {name}", (" ".join(["spdx license identifier", *name.lower().replace("-", " ").replace(".", " ").split()]),)) for name in IDENTIFIERS)

_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")
#: Words of the highest IDF that a template, and a place in a text, is looked up by.
RARE_WORDS = 4
#: Places either side of the template that a mandatory phrase may be off, words that may be put in or left out between two
#: words of a template, and the share of a template's words that must follow each other in order.
SLACK, DRIFT, LEAST = 12, 6, 0.5


def words_of(text: str | None) -> list[bytes]:
    """The words of the whole text, A-Z as a-z; null has none."""
    return _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


def places(padded: bytes, phrase: bytes) -> list[int]:
    """Word places where the phrase stands in b' word word '."""
    sought, found, at, seen, n = b" " + phrase + b" ", [], -1, 0, 0
    while (at := padded.find(sought, at + 1)) >= 0:
        n += padded.count(b" ", seen, at)
        seen = at
        found.append(n)
    return found


def aligned(own: list[bytes], words: list[bytes], begin: int) -> tuple[int, int, int]:
    """Where the words of a template that follow each other from about `begin` on start and end, and how many they are."""
    at, first, same = max(0, begin - DRIFT), None, 0
    reach = 2 * DRIFT + 1
    for w in own:
        try:
            found = words.index(w, at, at + reach)
        except ValueError:
            continue
        first = found if first is None else first
        at, same, reach = found + 1, same + 1, DRIFT + 1
    return (first if first is not None else max(0, begin)), at, same


class Index:
    """Postings of the templates' words, with each template's words of the highest IDF."""

    def __init__(self, templates: tuple = TEMPLATES):
        self.labels = [t[0] for t in templates]
        self.words = [words_of(t[1]) for t in templates]
        self.phrases = [[b" ".join(words_of(p)) for p in t[2]] for t in templates]
        frequency = Counter(w for words in self.words for w in set(words))
        self.idf = {w: math.log((1 + len(templates)) / n) for w, n in frequency.items()}
        self.rare: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.needed = []
        for t, words in enumerate(self.words):
            best = sorted(set(words), key=lambda w: (-self.idf[w], w))[:RARE_WORDS]
            self.needed.append(max(1, len(best) // 2))
            for place, w in enumerate(words):
                if w in best:
                    self.rare[w].append((t, place))
        self.base = [(p.encode(), label, frozenset(p.encode().split())) for p, label in BASE.items()]
        self.watched = frozenset(self.rare) | {w for x in self.base for w in x[2]}

    def spans(self, words: list[bytes], present: frozenset, padded: bytes) -> list[tuple[str, int, int, float]]:
        """(label, first word, word after the last, coverage) of the templates that stand in the words."""
        held = Counter(t for w in present if w in self.rare for t in {t for t, _ in self.rare[w]})
        open_ = {t for t, n in held.items() if n >= self.needed[t]}
        chosen = {w for w in sorted((w for w in present if w in self.rare), key=lambda w: (-self.idf[w], w)) if any(t in open_ for t, _ in self.rare[w])}
        places: dict[int, list[tuple[int, bytes]]] = defaultdict(list)
        if chosen:
            for place, w in enumerate(words):
                if w in chosen:
                    for t, q in self.rare[w]:
                        if t in open_:
                            places[t].append((place - q, w))
        out = []
        for t, found in sorted(places.items()):
            for begin, seen in self._groups(sorted(found)):
                if len(seen) < self.needed[t]:
                    continue
                own = self.words[t]
                low, high = max(0, begin - SLACK), begin + len(own) + SLACK
                near = b" " + b" ".join(words[low:high]) + b" "
                if all(b" " + p + b" " in near for p in self.phrases[t]):
                    first, last, same = aligned(own, words, begin)
                    if same >= LEAST * len(own):
                        out.append((self.labels[t], first, last, same / len(own)))
        return sorted(set(out))

    @staticmethod
    def _groups(found: list[tuple[int, bytes]]) -> Iterator[tuple[int, set[bytes]]]:
        """Relative places that are within DRIFT of the next: the most frequent (the least of those) of each group, and the words."""
        group: list[tuple[int, bytes]] = []
        for at, w in [*found, (1 << 62, b"")]:
            if group and at - group[-1][0] > DRIFT:
                often = Counter(place for place, _ in group)
                yield min(often, key=lambda place: (-often[place], place)), {x for _, x in group}
                group = []
            group.append((at, w))

    def scan(self, text: str | None) -> dict:
        """What one text holds."""
        words = words_of(text)
        present = self.watched.intersection(words)
        base, spans = [], []
        if present:
            padded = b" " + b" ".join(words) + b" "
            base = [(label, n) for phrase, label, needs in self.base if needs <= present for n in places(padded, phrase)]
            spans = self.spans(words, present, padded)
        return {"n_words": len(words), "base": [{"label": label, "start": n} for label, n in base], "spans": [dict(zip(("label", "start", "end", "coverage"), s, strict=True)) for s in spans]}


@lru_cache(maxsize=4)
def _index(templates: tuple) -> Index:
    return Index(templates)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple = TEMPLATES) -> DataFrame:
    """One row a row of docs: the id, n_words, base (label, start) places and licence spans (label, start, end, coverage).

    Null and empty texts have no words and no spans; repeated rows give a row each; ids may be null; an empty table gives
    none; other columns are not read. Each text is scanned whole, in one task, on its own.
    """
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = kept.schema["id"].dataType.simpleString()
    made = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())])
    place = pa.struct([("label", pa.string()), ("start", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(templates)
        for batch in batches:
            rows = [index.scan(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([r["n_words"] for r in rows], pa.int64()), pa.array([r["base"] for r in rows], pa.list_(place)), pa.array([r["spans"] for r in rows], pa.list_(made))],
                ["id", "n_words", "base", "spans"],
            )

    out = kept.mapInArrow(run, f"id {id_type}, n_words bigint, base array<struct<label:string,start:bigint>>, spans array<struct<label:string,start:bigint,end:bigint,coverage:double>>")
    return out.withColumnRenamed("id", id_col)


def summary(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The digest columns of scan()'s rows; score is 1 where a base phrase stands, else the best coverage, else 0."""
    base_labels = F.array_sort(F.array_distinct(F.col("base.label")))
    labels = F.array_sort(F.array_distinct(F.concat(F.col("base.label"), F.col("spans.label"))))
    return found.select(
        id_col,
        "n_words",
        F.size("base").cast("bigint").alias("n_base"),
        F.array_min("base.start").alias("first_word"),
        F.array_max("base.start").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max("spans.coverage"), F.lit(0.0))).alias("score"),
    )
