"""Operator 5: license scans with a positional index of rare words.

Templates (phrases, notices and whole short licences) are indexed as postings word -> (template,
position). A first pass counts, over all documents, in how many each template word occurs. The
second takes a file's template words by falling IDF. A template may begin at place ``s`` if at
least ``COVERED`` of its words stand within its slack (a tenth of its length) of where they
would; so of the words that the file has at all, only so many may stand elsewhere, and one rarest
word more than these, and another, are looked up: their postings, moved to where the template
would begin, must meet for two of them at least. Places where they do are verified on all
words, and the mandatory key phrases must stand there word by word.

A template found at neighbouring places counts once, where most of its words are in place (then the
first). Phrases of the base table have no slack and need all their words.

Cases: null, empty or wordless text has n_words 0 (or as counted), no places, empty labels, score
0; equal rows are scanned each; overlapping places all count; texts of any length are read whole; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.packing import spark_schema
from threadloom.llm.work import column, slices, table, texts

#: The share of a template's words that must be in place, and how far they may be moved, by its length.
COVERED, SLACK = 0.8, 0.1
#: Looked-up words that must agree on a template's place.
AGREE = 2

# Phrase and label.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Words of public licences and their notices, their label and mandatory key phrases.
_WARRANTY = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_BSD_START = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_END = "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
NOTICES = [
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license"]),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", ["in compliance with the license"]),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ["in compliance with the license"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "licensed under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["free of charge", "permission is hereby granted"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software " + _WARRANTY, ["free of charge", "permission is hereby granted"]),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["general public license", "version 3"]),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["general public license", "version 2"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", ["general public license"]),
    ("gpl-2.0-or-later", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ["general public license", "version 2 of the license", "any later version"]),
    ("gpl-3.0-or-later", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ["general public license", "version 3 of the license", "any later version"]),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ["lesser general public license"]),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", ["affero general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["source and binary forms"]),
    ("bsd-2-clause", f"{_BSD_START} {_BSD_END}", ["source and binary forms"]),
    ("bsd-3-clause", f"{_BSD_START} 3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission {_BSD_END}", ["source and binary forms", "endorse or promote"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software", ["with or without fee", "permission notice"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions", ["permission is granted to anyone", "redistribute it freely"]),
    ("bsl-1.0", "boost software license version 1 0", ["boost software license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["public domain"]),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ["has waived all copyright"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
]

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b in range(0x30, 0x3A) or b in range(0x61, 0x7B) or b > 0x7F else 32 for b in range(256))
RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])


class Template(NamedTuple):
    label: str
    words: tuple[bytes, ...]
    keys: tuple[tuple[bytes, ...], ...]
    base: bool

    @property
    def needed(self) -> int:
        """How many of the words must be in place."""
        return len(self.words) if self.base else math.ceil(COVERED * len(self.words))

    @property
    def slack(self) -> int:
        return 0 if self.base else int(SLACK * len(self.words))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_FOLD).split()


def templates(notices: list[tuple[str, str, list[str]]] | None = None) -> list[Template]:
    """The base phrases, and the notices (those of this module unless others are given)."""
    cut = lambda x: tuple(words_of(x))
    return [Template(v, cut(k), (), True) for k, v in PHRASES.items()] + [Template(a, cut(b), tuple(map(cut, c)), False) for a, b, c in notices or NOTICES]


def vocabulary(known: list[Template]) -> set[bytes]:
    return {w for t in known for w in t.words}


class Index:
    """Postings of all template words, and their IDF over the documents."""

    def __init__(self, known: list[Template], seen: dict[bytes, int], documents: int):
        self.templates = known
        self.idf = {w: math.log((1 + documents) / (1 + seen.get(w, 0))) for w in vocabulary(known)}
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for k, t in enumerate(known):
            for i, w in enumerate(t.words):
                self.postings[w].append((k, i))
        self.sizes = {w: Counter(k for k, _ in p) for w, p in self.postings.items()}

    def places(self, words: list[bytes]) -> dict[int, dict[int, float]]:
        """Template -> where it begins -> share of its words in place."""
        here = sorted(self.postings.keys() & set(words), key=lambda w: (-self.idf[w], w))
        had: Counter[int] = Counter()
        for w in here:
            had.update(self.sizes[w])
        open_ = {k: had[k] - self.templates[k].needed + AGREE for k in had if had[k] >= self.templates[k].needed}
        if not open_:
            return {}
        at: dict[bytes, list[int]] = defaultdict(list)
        wanted = set(here)
        for p, w in enumerate(words):
            if w in wanted:
                at[w].append(p)
        where = {w: np.array(p) for w, p in at.items()}
        votes: dict[int, list[np.ndarray]] = defaultdict(list)
        for w in here:  # the file's rarest first
            for k, i in self.postings[w]:
                if k in open_ and len(votes[k]) < open_[k]:
                    g = self.templates[k].slack
                    begins = where[w] - i
                    votes[k].append(np.unique(begins[:, None] + np.arange(-g, g + 1)) if g else begins)
        found: dict[int, dict[int, float]] = {}
        for k, lists in votes.items():
            starts, agree = np.unique(np.concatenate(lists), return_counts=True)
            starts = starts[agree >= min(AGREE, len(lists))]
            if len(starts) and (sure := self._verified(k, starts, where)):
                found[k] = sure
        return found

    def _verified(self, k: int, starts: np.ndarray, where: dict[bytes, np.ndarray]) -> dict[int, float]:
        t = self.templates[k]
        n, g = len(t.words), t.slack
        held = np.zeros(len(starts), np.int64)
        for i, w in enumerate(t.words):
            if w in where:
                held += np.searchsorted(where[w], starts + i + g, "right") > np.searchsorted(where[w], starts + i - g, "left")
        good = held >= t.needed
        for key in t.keys:
            if not good.any():
                return {}
            begins = where.get(key[0], np.zeros(0, np.int64))
            for i, w in enumerate(key[1:], 1):
                begins = begins[np.isin(begins + i, where.get(w, np.zeros(0, np.int64)))]
            good &= np.searchsorted(begins, starts + n + g - len(key), "right") > np.searchsorted(begins, starts - g, "left")
        starts, held = starts[good], held[good]
        out: dict[int, float] = {}
        for part in np.split(np.arange(len(starts)), np.flatnonzero(np.diff(starts) > g) + 1) if g else np.arange(len(starts))[:, None]:
            if len(part):
                best = part[np.argmax(held[part])]
                out[int(starts[best])] = held[best] / n
        return out


def counted(docs: DataFrame, wanted: set[bytes]) -> tuple[dict[bytes, int], int]:
    """In how many documents each template word occurs, and the number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in slices(batches, "text"):
            for x in texts(batch):
                seen.update(wanted & set(words_of(x)))
                seen[b""] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    rows = docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # one row for each template word
    seen = {bytes(r.word): r.n for r in rows}
    return seen, seen.pop(b"", 0)


def scan(docs: DataFrame, spans: bool = False, notices: list[tuple[str, str, list[str]]] | None = None) -> DataFrame:
    """One row for each document; ``spans`` adds found label:first word:words:share as strings.

    ``notices`` (label, words, key phrases) takes the place of this module's, as where whole
    texts of longer licences are at hand.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    known = templates(notices)
    seen, total = counted(docs, vocabulary(known))
    schema = RESULT.append(pa.field("spans", pa.list_(pa.string()))) if spans else RESULT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(known, seen, total)
        for batch in slices(batches, "text"):
            rows = []
            for doc, text in zip(column(batch, "doc_id").to_pylist(), texts(batch), strict=True):
                words = words_of(text)
                found = index.places(words)
                base = [at for k, v in found.items() if known[k].base for at in v]
                label = lambda only: ",".join(sorted({known[k].label for k in found if not only or known[k].base}))  # noqa: B023, E731
                row = (doc, len(words), len(base), min(base, default=None), max(base, default=None), label(True), label(False), max((s for v in found.values() for s in v.values()), default=0.0))
                if spans:
                    row += (sorted(f"{known[k].label}:{at}:{len(known[k].words)}:{s:.3f}" for k, v in found.items() for at, s in v.items()),)
                rows.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.mapInArrow(run, spark_schema(RESULT) + (", spans array<string>" if spans else ""))


def op5_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
