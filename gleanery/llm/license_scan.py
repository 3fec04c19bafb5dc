"""Operator 9, licence scans, in DataFrame functions alone.

Base phrases are found at every place where their words stand consecutively. On top of that works a positional
rare-token index over licence notices: the document frequency of each notice word over all documents gives its
IDF, and the postings of a word name the notices and the positions where it stands. A notice stands at a relative
position if at least `least_share` of its words agree there, so of any T - need + k of its T positions, need being the
words that must agree, k agree. Each notice is therefore indexed by so many of its positions, those of highest IDF, for
k = AGREE. A document looks up those of its words that are indexed, each posting votes for a notice and a relative
position, and what has AGREE votes is held against the whole notice; that its mandatory key phrase stands is verified
last. No place is missed; the IDF decides the work alone, never the labels.

Defined cases: a null or wordless text has 0 words, no label and score 0; ties in IDF go to the word that comes first in the
alphabet; repeated rows are each judged by themselves; a null id is carried through; an empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: Votes for one relative position that make a candidate; a notice of fewer words that must agree asks for those.
AGREE = 2

#: Notices as licences give or ask for them, (label, words of the notice, key phrases of which one must
#: stand). A licence may have several: its short statement and paragraphs that stand alone.
TEMPLATES = (
    ("agpl", "gnu affero general public license", ("affero general public license",)),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu affero general public license",)),
    ("all-rights-reserved", "all rights reserved", ("all rights reserved",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", ("apache org licenses license 2 0", "governing permissions and limitations under the license")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ("redistributions of source code must retain", "redistributions in binary form must reproduce")),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed", ("provided by the copyright holders and contributors",)),
    ("boost", "distributed under the boost software license version 1 0 see accompanying file license 1 0 txt or copy at http www boost org license 1 0 txt", ("boost software license",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc", "creative commons attribution noncommercial")),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    ("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd", "creative commons attribution noderivatives")),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa", "creative commons attribution sharealike")),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("cc0 1 0", "has waived all copyright")),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0", ("eclipse public license",)),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("general public license version 2",)),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ("either version 2 of the license", "general public license version 2")),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("general public license version 3",)),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu general public license as published by the free software foundation either version 3", "general public license version 3")),
    ("gpl-warranty", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", ("in the hope that it will be useful",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("permission to use copy modify and or distribute this software",)),
    ("lgpl", "gnu lesser general public license", ("lesser general public license",)),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", ("deal in the software without restriction",)),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", ("copies or substantial portions of the software",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", ("mozilla public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", ("free and unencumbered software",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", ("in no event will the authors be held liable",)),
)


def line_of(text: Column) -> Column:
    """The words of a text, each between single spaces, with a space at either end; a wordless text gives two spaces or fewer."""
    apart = F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    return F.concat(F.lit(" "), F.trim(apart), F.lit(" "))


def _words(line: Column) -> Column:
    return F.when(F.length(line) > 2, F.split(F.trim(line), " ")).otherwise(F.array().cast("array<string>"))


def _strings(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def places(words: Column, phrase: str) -> Column:
    """Starts, in words from 0, of each place where the phrase's words stand consecutively."""
    parts = phrase.split()
    starts = F.filter(F.transform(words, lambda w, i: F.when(w == parts[0], i)), lambda i: i.isNotNull())
    return F.filter(starts, lambda i: F.slice(words, i + 1, len(parts)) == _strings(parts)).cast("array<long>")


def document_frequencies(docs: DataFrame, vocabulary: list[str]) -> tuple[dict[str, int], int]:
    """In how many documents each template word stands, over all documents, and how many documents there are. The result is as large as the vocabulary."""
    present = F.array_intersect(_words(line_of(F.col("text"))), _strings(vocabulary))
    counts = docs.select(F.explode(present).alias("word")).groupBy("word").count().collect()
    return {r["word"]: r["count"] for r in counts}, docs.count()


def words_needed(size: int, least_share: float) -> int:
    """The least number of words of a notice that must agree."""
    return next((k for k in range(1, size) if k / size >= least_share), size)


def rare_positions(notice: list[str], idf: dict[str, float], least_share: float) -> list[int]:
    """The positions of highest IDF of a notice, as few as no place with `least_share` of the words can have fewer than AGREE of."""
    size = len(notice)
    need = words_needed(size, least_share)
    return sorted(range(size), key=lambda p: (-idf[notice[p]], notice[p], p))[: size - need + min(AGREE, need)]


def _template_matches(line: Column, words: Column, idf: dict[str, float], least_share: float) -> Column:
    """array<struct<label, cover>> of the notices that stand in a document, one for each place that is a candidate."""
    notices = [notice.split() for _, notice, _ in TEMPLATES]
    postings: dict[str, list[tuple[int, int, int]]] = {}
    for t, parts in enumerate(notices):
        for p in rare_positions(parts, idf, least_share):
            postings.setdefault(parts[p], []).append((t, p, min(AGREE, words_needed(len(parts), least_share))))
    index = F.create_map(*[x for w in sorted(postings) for x in (F.lit(w), F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(q, "tpk", strict=True)]) for q in postings[w]]))])
    table = F.array(*[F.struct(F.lit(label).alias("label"), _strings(notice.split()).alias("words"), _strings(keys).alias("keys")) for label, notice, keys in TEMPLATES])

    # The places of indexed words, then a vote for each of their postings, sorted so that equal votes are neighbours.
    hits = F.filter(F.transform(words, lambda w, i: F.when(w.isin(sorted(postings)), F.struct(w.alias("w"), i.alias("i")))), lambda h: h.isNotNull())
    votes = F.array_sort(F.flatten(F.transform(hits, lambda h: F.transform(F.element_at(index, h["w"]), lambda q: F.struct(q["t"].alias("t"), (h["i"] - q["p"]).alias("at"), q["k"].alias("k"))))))
    agreed = once(votes, lambda all_: F.array_distinct(F.filter(all_, lambda v, i: F.get(all_, i + v["k"] - 1) == v)))

    def judged(v):
        def held(t):
            same = F.size(F.filter(F.transform(t["words"], lambda w, p: F.coalesce(F.get(words, v["at"] + p) == w, F.lit(False))), lambda x: x)) / F.size(t["words"])
            stands = F.exists(t["keys"], lambda k: line.contains(F.concat(F.lit(" "), k, F.lit(" "))))
            return F.struct(t["label"].alias("label"), F.when(stands, same).otherwise(0.0).alias("cover"))

        return once(F.element_at(table, v["t"] + 1), held)

    return F.filter(F.transform(agreed, judged), lambda m: m["cover"] >= least_share)


def once(value: Column, then) -> Column:
    """then(value), with the value worked out once and not again wherever `then` names it."""
    return F.element_at(F.transform(F.array(value), lambda v: then(v)), 1)


def scan(docs: DataFrame, phrases: dict[str, str], least_share: float = 0.6, id_column: str = "doc_id") -> DataFrame:
    """phrases: base phrase to label. A row per row of docs: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Documents without a base phrase have no place, so that expression runs on the others alone. No row is shuffled but
    for the document frequencies.
    """
    vocabulary = sorted({w for _, notice, _ in TEMPLATES for w in notice.split()})
    found, total = document_frequencies(docs, vocabulary)
    idf = {w: math.log((total + 1) / (found.get(w, 0) + 1)) for w in vocabulary}
    line, words = F.col("line"), F.col("words")
    held = lambda many: reduce(lambda a, b: a | b, [line.contains(f" {k} ") for k in many], F.lit(False))
    rows = docs.select(F.col(id_column).alias("id"), line_of(F.col("text")).alias("line")).select("id", "line", _words(line).alias("words"))
    none = F.array().cast("array<long>")
    each = [F.when(line.contains(f" {p} "), places(words, p)).otherwise(none) for p in sorted(phrases)]
    starts = F.when(held(phrases), F.flatten(F.array(*each))).otherwise(none)
    matches = _template_matches(line, words, idf, least_share)
    base = F.array_compact(F.array(*[F.when(line.contains(f" {p} "), F.lit(phrases[p])) for p in sorted(phrases)]))
    judged = rows.select("id", F.size("words").cast("long").alias("n_words"), starts.alias("starts"), F.array_sort(F.array_distinct(base)).alias("base"), matches.alias("matches"))
    labels = F.array_sort(F.array_distinct(F.concat("base", F.col("matches.label"))))
    score = F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.col("matches.cover")), F.lit(0.0)))
    return judged.select(
        F.col("id").alias(id_column), "n_words", F.size("starts").cast("long").alias("n_base"), F.array_min("starts").alias("first_word"), F.array_max("starts").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"),
    )
