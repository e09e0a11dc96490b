"""Licence statements found by a positional index of rare words, in DataFrame functions only.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z
lower-cased. A first pass counts in how many documents each word of the templates occurs. The
index holds postings (word, template, place) of the ``RARE`` words of the highest IDF of each
template, and of the words of its mandatory phrases. Of every document that has all words of
these phrases the ``LOOKED_UP`` indexed words of the highest IDF are looked up; a posting and a
place of the word in the document give a start of the template. Starts on which two different
words agree within ``DRIFT`` words (all starts, where a template has one indexed word) are
looked at: there the mandatory phrases must stand word for word, at most ``DRIFT`` words off
their places, and of all words of the template at least ``COVERAGE``, weighted by IDF, within
``DRIFT`` words of theirs. The phrases of the base are templates of which every word must
stand in its own place; both their words of the highest IDF stand wherever they do, so none
is missed.

Nothing is shuffled but the word counts (at most one row for each template word and task), so
neither a frequent licence nor a hot source gathers anywhere. Null and empty texts have no
words and no labels, score 0; very long texts are scanned whole; repeated rows give repeated
results; starts that tie give one label once; an empty table gives an empty result; further
columns are kept by ``licence_spans`` (but ``_n_words`` and ``_spans`` are its own) and not
read by ``licence_report``.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
COVERAGE, RARE, LOOKED_UP, DRIFT = 0.7, 16, 3, 3

# The phrases of the base, and the templates (label, words, mandatory phrases).
BASE = (
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
)
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2",)),
    (
        "apache-2.0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software "
        "distributed under the license is distributed on an as is basis without warranties or conditions of any kind "
        "either express or implied see the license for the specific language governing permissions and limitations under the license",
        ("except in compliance with the license", "distributed on an as is basis"),
    ),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
        "as published by the free software foundation",
        ("redistribute it and or modify it", "gnu general public license"),
    ),
    ("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    (
        "lgpl",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license "
        "as published by the free software foundation",
        ("lesser general public license",),
    ),
    ("agpl", "licensed under the gnu affero general public license", ("affero general public license",)),
    ("mit", "licensed under the mit license", ("mit license",)),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
        "the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
        "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
        ("permission is hereby granted free of charge", "to deal in the software without restriction"),
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        ("redistribution and use in source and binary forms",),
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that "
        "the above copyright notice and this permission notice appear in all copies",
        ("permission to use copy modify and or distribute",),
    ),
    (
        "mpl-2.0",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file",
        ("mozilla public license",),
    ),
    ("bsd-2-clause", "licensed under the bsd 2 clause license", ("bsd 2 clause",)),
    ("bsd-3-clause", "licensed under the bsd 3 clause license", ("bsd 3 clause",)),
    (
        "bsd-3-clause",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
        "this software without specific prior written permission",
        ("may be used to endorse or promote products derived from",),
    ),
    ("bsl-1.0", "distributed under the boost software license version 1 0", ("boost software license",)),
    ("epl-2.0", "made available under the terms of the eclipse public license 2 0", ("eclipse public license 2",)),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4",)),
    ("cc-by-sa-4.0", "licensed under a creative commons attribution sharealike 4 0 international license", ("attribution sharealike 4",)),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4",)),
    ("apache-2.0", "spdx license identifier apache 2 0", ("spdx license identifier apache 2",)),
    ("bsd-2-clause", "spdx license identifier bsd 2 clause", ("spdx license identifier bsd 2",)),
    ("bsd-3-clause", "spdx license identifier bsd 3 clause", ("spdx license identifier bsd 3",)),
    ("gpl-2.0", "spdx license identifier gpl 2 0", ("spdx license identifier gpl 2",)),
    ("gpl-3.0", "spdx license identifier gpl 3 0", ("spdx license identifier gpl 3",)),
    ("isc", "spdx license identifier isc", ("spdx license identifier isc",)),
    ("mit", "spdx license identifier mit", ("spdx license identifier mit",)),
    ("mpl-2.0", "spdx license identifier mpl 2 0", ("spdx license identifier mpl 2",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4",)),
    ("cc0-1.0", "released under cc0 1 0 universal public domain dedication", ("cc0 1 0",)),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or "
        "distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        ("free and unencumbered software",),
    ),
)


def words_of(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower()), SEPARATORS), "")


def _strings(items: Sequence[str]) -> Column:
    return F.array(*[F.lit(x) for x in items])


def word_idf(df: DataFrame, text: str = "text") -> dict[str, float]:
    """IDF over all documents of every word that a template or a base phrase has."""
    vocabulary = sorted({w for _, t, _ in TEMPLATES for w in t.split()} | {w for _, t in BASE for w in t.split()})
    counts = (
        df.select(F.explode(F.array_union(F.array_intersect(words_of(F.col(text)), _strings(vocabulary)), F.array(F.lit("")))).alias("w"))
        .groupBy("w")
        .count()
    )
    found = {r["w"]: r["count"] for r in counts.collect()}  # a row for each word of the templates
    n = found.get("", 0)
    return {w: math.log((n + 1) / (found.get(w, 0) + 1)) + 1e-6 for w in vocabulary}


def _template(label: str, words: list[str], keys: list[list[str]], base: bool, idf: dict[str, float]) -> dict:
    """A template: its words with their places and shares of the IDF, its phrases, and its indexed words, rarest first."""
    highest = lambda part: sorted(set(part), key=lambda w: (-idf[w], w))
    needed = sorted({w for key in keys for w in key})
    total = sum(idf[w] for w in words)
    begins = [next(k for k in range(len(words)) if words[k : k + len(key)] == key) for key in keys]
    return {
        "label": label,
        "base": base,
        "drift": 0 if base else DRIFT,
        "cells": [{"q": q, "w": w, "share": idf[w] / total} for q, w in enumerate(words)],
        "keys": [{"q": q, "words": key} for q, key in zip(begins, keys, strict=True)],
        "needed": needed,
        "indexed": highest({*highest(words)[:RARE], *needed}),
    }


def templates(idf: dict[str, float]) -> list[dict]:
    """The base phrases and the templates, prepared with the IDF of their words."""
    found = [_template(label, t.split(), [t.split()], True, idf) for label, t in BASE]
    return found + [_template(label, t.split(), [k.split() for k in keys], False, idf) for label, t, keys in TEMPLATES]


def postings(made: list[dict]) -> dict[str, list[dict]]:
    """The index: of each indexed word its places ``q`` in templates ``t``, and its number ``n``."""
    index: dict[str, list[dict]] = {}
    numbers: dict[str, int] = {}
    for t, m in enumerate(made):
        for c in m["cells"]:
            if c["w"] in m["indexed"]:
                index.setdefault(c["w"], []).append({"t": t, "q": c["q"], "n": numbers.setdefault(c["w"], len(numbers))})
    return index


_KIND = (
    "array<struct<label:string,base:boolean,drift:int,cells:array<struct<q:int,w:string,share:double>>,"
    "keys:array<struct<q:int,words:array<string>>>,needed:array<string>,indexed:array<string>>>"
)


def _constant(value: object, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def licence_spans(df: DataFrame, text: str = "text", idf: dict[str, float] | None = None) -> DataFrame:
    """``df`` with ``_n_words`` and ``_spans``: array of (label, base, start, cover) of all places.

    Hits are dealt to templates as numbers, start and word in one, and each template sorts its own
    once, so the work is in proportion to the hits, however often a text repeats a licence."""
    idf = idf or word_idf(df, text)
    made = templates(idf)
    index = postings(made)
    all_templates, looked_at = _constant(made, _KIND), _constant(index, "map<string,array<struct<t:int,q:int,n:int>>>")
    rarest_first = _strings(sorted(index, key=lambda w: (-idf[w], w)))
    mark = "_"
    while any(c.startswith(f"{mark}words_") for c in df.columns):
        mark += "_"
    own = {c: f"{mark}words_{c}" for c in ("all", "present", "chosen", "hits", "found")}
    w = F.col(own["all"])
    n_words = F.size(w)

    def chosen(present: Column) -> Column:
        """Of each template whose phrases the document can hold the words of the highest IDF that it has."""
        can_hold = F.filter(all_templates, lambda t: F.size(F.array_intersect(t["needed"], present)) == F.size(t["needed"]))
        return F.array_distinct(F.flatten(F.transform(can_hold, lambda t: F.slice(F.array_intersect(t["indexed"], present), 1, LOOKED_UP))))

    def starts(found: Column, k: Column, t: Column) -> Column:
        """Starts of template ``k`` on which two of its words agree; evaluated once, as an element of an array."""
        codes = F.array_sort(F.array_distinct(F.transform(F.filter(found, lambda x: x["t"] == k), lambda x: x["code"])))
        begin, word = lambda x: F.shiftright(x, 12), lambda x: x.bitwiseAND(4095)
        near = lambda x, y: F.coalesce((F.abs(begin(x) - begin(y)) <= t["drift"]) & (word(x) != word(y)), F.lit(False))
        alone = F.size(t["indexed"]) == 1
        agree = lambda codes: F.filter(codes, lambda x, i: alone | near(x, F.get(codes, i - 1)) | near(x, F.get(codes, i + 1)))
        return F.array_distinct(F.transform(F.flatten(F.transform(F.array(codes), agree)), lambda x: begin(x).cast("int")))

    def window(begin: Column, length: Column) -> Column:
        """Words of the document from a place on, which may lie before its first."""
        return F.slice(w, F.greatest(begin, F.lit(0)) + 1, F.greatest(length + F.least(begin, F.lit(0)), F.lit(0)))

    def phrase_at(t: Column, d: Column, key: Column) -> Column:
        off = F.sequence(-t["drift"], t["drift"])
        at = lambda o: d + key["q"] + o
        return F.exists(off, lambda o: (at(o) >= 0) & (at(o) < n_words) & (window(at(o), F.size(key["words"])) == key["words"]))

    def spans(t: Column, k: Column) -> Column:
        kept = F.filter(starts(F.col(own["found"]), k, t), lambda d: F.forall(t["keys"], lambda key: phrase_at(t, d, key)))
        cover = lambda d: F.aggregate(
            t["cells"], F.lit(0.0), lambda s, c: s + F.when(F.array_contains(window(d + c["q"] - t["drift"], 2 * t["drift"] + 1), c["w"]), c["share"]).otherwise(0.0)
        )
        scored = F.transform(kept, lambda d: F.struct(t["label"].alias("label"), t["base"].alias("base"), d.alias("start"), cover(d).alias("cover")))
        return F.filter(scored, lambda s: t["base"] | (s["cover"] >= COVERAGE))

    none = "array<struct<label:string,base:boolean,start:int,cover:double>>"
    placed = F.transform(w, lambda x, p: F.struct(x.alias("w"), p.alias("p")))
    code = lambda h, x: F.shiftleft((h["p"] - x["q"]).cast("long"), 12) + x["n"]
    start = lambda h: F.transform(F.element_at(looked_at, h["w"]), lambda x: F.struct(x["t"].alias("t"), code(h, x).alias("code")))
    c = {k: F.col(v) for k, v in own.items()}
    return (
        df.withColumn(own["all"], words_of(F.col(text)))
        .withColumn("_n_words", n_words)
        .withColumn(own["present"], F.array_intersect(rarest_first, w))
        .withColumn(own["chosen"], F.when(F.size(c["present"]) > 0, chosen(c["present"])))
        .withColumn(own["hits"], F.when(F.size(c["chosen"]) > 0, F.filter(placed, lambda h: F.array_contains(c["chosen"], h["w"]))))
        .withColumn(own["found"], F.flatten(F.transform(c["hits"], start)))
        .withColumn("_spans", F.when(F.size(c["found"]) > 0, F.flatten(F.transform(all_templates, spans))).otherwise(F.array().cast(none)))
        .drop(*own.values())
    )


def licence_report(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of each row.

    ``score`` is the largest IDF-weighted cover of a place found, 1 for a base phrase, 0 for none.
    """
    source = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    base = F.filter("_spans", lambda s: s["base"])
    label = lambda s: s["label"]
    start = lambda s: s["start"]
    joined = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, label))), ",")
    return (
        licence_spans(source)
        .withColumn("_base", base)
        .select(
            "doc_id",
            F.col("_n_words").cast("long").alias("n_words"),
            F.size("_base").cast("long").alias("n_base"),
            F.array_min(F.transform("_base", start)).cast("long").alias("first_word"),
            F.array_max(F.transform("_base", start)).cast("long").alias("last_word"),
            joined(F.col("_base")).alias("base_labels"),
            joined(F.col("_spans")).alias("labels"),
            F.coalesce(F.array_max(F.transform("_spans", lambda s: F.least(s["cover"], F.lit(1.0)))), F.lit(0.0)).alias("score"),
        )
    )
