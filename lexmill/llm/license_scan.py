"""License scans with a positional index of rare words.

Each licence text, and each base phrase, is a template. The index holds the templates' words of highest inverse document
frequency with their positions. A file's places of indexed words vote for (template, start of the template in the file):
word position less template position. A start with enough votes is compared word by word, which gives its score, and
counts once the template's mandatory phrases stand where they should.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions.ship import ship

from . import common as C

WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    #: Phrases that have to stand at their places in the template; the whole text if there are none.
    mandatory: tuple[str, ...] = ()


#: The base phrases with their labels.
BASE = (
    Template("gpl", "gnu general public license"),
    Template("apache", "apache license"),
    Template("cc-by", "cc by"),
    Template("mit", "mit license"),
)
#: Public licence notices that the method recognises besides, with the phrases that tell them apart.
NOTICES = (
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", ("permission is hereby granted free of charge", "deal in the software without restriction")),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    Template("gpl-3.0", "licensed under the GNU General Public License, version 3", ("gnu general public license version 3",)),
    Template("gpl-2.0", "licensed under the GNU General Public License, version 2", ("gnu general public license version 2",)),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    Template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    Template("cc-by-4.0", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "following conditions are met")),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license v 2 0",)),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "with or without fee is hereby granted")),
    Template("lgpl", "GNU Lesser General Public License", ("gnu lesser general public license",)),
    Template("all-rights-reserved", "All rights reserved", ("all rights reserved",)),
    Template("cc0", "CC0 1.0 Universal Public Domain Dedication", ("cc0 1 0 universal",)),
)


def words_of(text: str) -> list[bytes]:
    return WORDS.findall(text.encode().lower())  # bytes.lower() changes A-Z alone


class Index:
    def __init__(self, base: tuple[Template, ...], notices: tuple[Template, ...], rare: int, share: float):
        self.base, self.templates, self.share = len(base), [*base, *notices], share
        self.words = [words_of(t.text) for t in self.templates]
        held = Counter(w for ws in self.words for w in set(ws))
        idf = {w: math.log(len(self.templates) / n) for w, n in held.items()}
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.votes, self.phrases = [], []
        for t, ws in enumerate(self.words):
            # Of a base phrase one place, of its rarest word, is enough: each place of that word is looked at.
            top = sorted(range(len(ws)), key=lambda i: (-idf[ws[i]], -len(ws[i]), i))[: 1 if t < self.base else rare]
            self.votes.append(len(top))
            for i in top:
                self.postings[ws[i]].append((t, i))
            self.phrases.append([(ws.index(p[0]) if len(p) == 1 else next(i for i in range(len(ws)) if ws[i : i + len(p)] == p), p) for p in map(words_of, self.templates[t].mandatory)] or [(0, ws)])
        self.postings = dict(self.postings)

    def scan(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """The word count and the hits (template, start word, share of the template's words in place)."""
        words = words_of(text)
        postings = self.postings
        places = [(i, w) for i, w in enumerate(words) if w in postings]
        if not places:
            return len(words), []
        votes = Counter((t, i - p) for i, w in places for t, p in postings[w])
        hits = []
        for (t, start), n in votes.items():
            if n < self.share * self.votes[t]:
                continue
            ws = self.words[t]
            if all(start + i >= 0 and words[start + i : start + i + len(p)] == p for i, p in self.phrases[t]):
                same = sum(0 <= start + i < len(words) and words[start + i] == w for i, w in enumerate(ws))
                hits.append((t, start, same / len(ws)))
        return len(words), sorted(hits)


_indexes: dict[tuple, Index] = {}


def index_of(*key) -> Index:
    if key not in _indexes:
        _indexes[key] = Index(*key)
    return _indexes[key]


SCHEMA = "_id {}, n_words bigint, base array<struct<label:string,at:bigint>>, notices array<struct<label:string,at:bigint,score:double>>"


def scan_licenses(docs: DataFrame, *, base: tuple[Template, ...] = BASE, notices: tuple[Template, ...] = NOTICES, rare: int = 6, share: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, n_words, base (label and start word of every place of a base phrase), notices (label, start word, score).

    A notice needs ``share`` of its ``rare`` indexed words at one start, and its mandatory phrases; its score is the share
    of its words that stand in place there. A null or empty text has no words; repeated rows get a row each; an empty
    table gives none; extra columns are ignored.
    """
    ship(docs.sparkSession)
    given = C.rows(docs, id_col=id_col, text_col=text_col).select("_id", "_text")
    schema = SCHEMA.format(given.schema["_id"].dataType.simpleString())

    def run(batches):
        import pyarrow as pa

        index = index_of(base, notices, rare, share)
        for batch in batches:
            found = [index.scan(t) for t in batch.column(1).to_pylist()]
            label = lambda t: index.templates[t].label
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([n for n, _ in found], pa.int64()),
                    pa.array([[{"label": label(t), "at": a} for t, a, _ in h if t < index.base] for _, h in found], pa.list_(pa.struct([("label", pa.string()), ("at", pa.int64())]))),
                    pa.array([[{"label": label(t), "at": a, "score": s} for t, a, s in h if t >= index.base] for _, h in found], pa.list_(pa.struct([("label", pa.string()), ("at", pa.int64()), ("score", pa.float64())]))),
                ],
                names=["_id", "n_words", "base", "notices"],
            )

    return given.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def op5(spark, sf_dir: str) -> DataFrame:
    """score: 1 where a base phrase stands, else the best notice's score, 0 without any."""
    found = scan_licenses(C.table(spark, sf_dir, "documents"))
    at = F.transform("base", lambda s: s["at"])
    labels = lambda c: F.transform(c, lambda s: s["label"])
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    best = F.array_max(F.transform("notices", lambda s: s["score"]))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"),
        joined(labels("base")).alias("base_labels"),
        joined(F.concat(labels("base"), labels("notices"))).alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"),
    )
