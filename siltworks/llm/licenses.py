"""License scan: phrase places, and an exact set-similarity join of text blocks with license templates.

A block is a line, or a run of as many words as the template has, wherever its lines
break: a wrapped template is found too. A label has a template for each of its usual
statements, from one line to the body's opening paragraph. Where templates share so many words that
a text of one would match another (CC BY and CC BY-NC), only the best match of a
place counts: the larger share, then the larger template. Template tokens are ordered by how many documents of the whole
corpus hold them, rarest first. A block can reach the containment threshold of a
template (|block & template| >= c * |template|) only if it holds a token of the
template's prefix (prefix filter), enough template tokens at all (length filter)
and enough of them from the first shared one on (positional filter); blocks that
pass are intersected exactly. The template side is a parameter and is inlined as
literals next to each scan task, so the join needs no shuffle. DataFrame functions only.

Defined results: null counts as empty; a document without places or matches has null
first_word and last_word, empty labels and score 0; repeated rows give repeated rows;
texts of any length are read whole; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Statements and opening paragraphs of well-known public licenses.
TEMPLATES = {
    "apache": (
        "licensed under the apache license version 2 0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    ),
    "boost": ("distributed under the boost software license version 1 0 see accompanying file license 1 0 txt",),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "released under the bsd license",
    ),
    "cc-by": ("licensed under cc by 4 0", "licensed under a creative commons attribution 4 0 international license"),
    "cc-by-nc": ("licensed under cc by nc 4 0", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    "cc-by-nd": ("licensed under cc by nd 4 0", "licensed under a creative commons attribution noderivatives 4 0 international license"),
    "cc-by-sa": ("licensed under cc by sa 4 0", "licensed under a creative commons attribution sharealike 4 0 international license"),
    "gpl": (
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    ),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",),
    "lgpl": ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",),
    "mit": (
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ),
    "mpl": ("this source code form is subject to the terms of the mozilla public license v 2 0",),
    "unlicense": ("this is free and unencumbered software released into the public domain",),
    "zlib": ("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",),
}
CONTAINMENT = (4, 5)


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def token_order(words: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Documents that hold each template token, over all documents; at most len(vocabulary) rows come to the driver."""
    rows = words.select(F.explode(F.array_intersect(_strings(vocabulary), F.col("words"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()
    n = {r["token"]: r["n"] for r in rows}
    return {t: n.get(t, 0) for t in vocabulary}


def _places(words: Column, phrase: list[str]) -> Column:
    """Ascending starts of the phrase."""
    at = lambda i: [F.get(words, i + k) == w for k, w in enumerate(phrase)]

    def here(i: Column) -> Column:
        out = F.lit(True)
        for x in at(i):
            out &= x
        return out

    return F.when(F.arrays_overlap(words, _strings(phrase[:1])) & F.arrays_overlap(words, _strings(phrase[-1:])), F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)).otherwise(F.array().cast("array<int>"))


def rivals(tokens: dict[str, list[str]], need: dict[str, int]) -> dict[str, list[str]]:
    """Of each template, those of other labels that a text of one would match as well."""
    close = lambda a, b: len(set(tokens[a]) & set(tokens[b])) >= min(need[a], need[b])
    return {a: [b for b in tokens if b.split("#")[0] != a.split("#")[0] and close(a, b)] for a in tokens}


def scan(spark: SparkSession, docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, containment: tuple[int, int] = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks): blocks lists the matched lines as (line, start, template, shared, size), and with a null line the best run of words per template and its first word."""
    templates = TEMPLATES if templates is None else templates
    texts = {f"{label}#{k}": x for label, xs in templates.items() for k, x in enumerate(xs)}
    num, den = containment
    base = docs.select(docs[id_col].alias("doc_id"), lowered(docs[text_col]).alias("t"))
    words = base.select("doc_id", "t", words_of(F.col("t")).alias("words"))
    vocabulary = sorted({t for x in texts.values() for t in x.split()})
    rank = token_order(words, vocabulary) if vocabulary else {}
    order = sorted(vocabulary, key=lambda t: (rank[t], t))
    tokens = {name: [t for t in order if t in set(x.split())] for name, x in texts.items()}
    need = {name: -(-num * len(t) // den) for name, t in tokens.items()}
    prefix = {name: t[: len(t) - need[name] + 1] for name, t in tokens.items()}

    def matches(block: Column) -> Column:
        """The templates that a block matches; block: its template tokens in global order."""

        def one(name: str) -> Column:
            t, o = tokens[name], need[name]
            shared = F.array_intersect(block, _strings(t))
            first = F.get(F.array_intersect(_strings(prefix[name]), block), F.lit(0))
            left = F.least(F.lit(len(t)) - F.array_position(_strings(t), first), F.size(block) - F.array_position(block, first)) + 1
            hit = F.when((F.size(block) >= o) & F.arrays_overlap(block, _strings(prefix[name])), F.when(left >= o, F.size(shared))).otherwise(F.lit(None))
            return F.struct(F.lit(name).alias("template"), hit.cast("int").alias("shared"), F.lit(len(t)).alias("size"))

        return F.filter(F.array(*[one(x) for x in sorted(tokens)]), lambda m: m["shared"] >= F.ceil(F.lit(num) * m["size"] / F.lit(den)))

    def run_match(name: str) -> Column:
        """The best match of a template among the runs of as many words, the first of equals; such a run can start at a template token."""
        t, o, long = tokens[name], need[name], len(texts[name].split())
        starts = F.filter(F.transform("words", lambda w, i: F.when(F.array_contains(_strings(t), w), i)), lambda i: i.isNotNull())
        best = F.array_max(F.transform(starts, lambda i: F.struct(F.size(F.array_intersect(_strings(t), F.slice("words", i + 1, F.lit(long)))).alias("shared"), (-i).alias("back"))))
        # a run can match only in a document with enough of the template, one token of its prefix included
        may = F.arrays_overlap("words", _strings(prefix[name])) & (F.size(F.array_intersect(_strings(t), F.col("words"))) >= o)
        row = F.transform(F.array(best), lambda b: F.struct(F.lit(None).cast("int").alias("line"), (-b["back"]).cast("int").alias("start"), F.lit(name).alias("template"), b["shared"].alias("shared"), F.lit(len(t)).alias("size")))
        return F.when(may, F.filter(row, lambda m: m["shared"] >= o))

    rare = sorted({t for x in prefix.values() for t in x})
    lines = F.split("t", "\n")
    blocks = F.transform(lines, lambda x, i: F.struct(i.alias("line"), F.array_intersect(_strings(order), words_of(x)).alias("tokens")))
    some = F.filter(blocks, lambda b: F.arrays_overlap(b["tokens"], _strings(rare)))
    kind = "array<struct<line:int,start:int,template:string,shared:int,size:int>>"
    found = F.flatten(F.transform(some, lambda b: F.transform(matches(b["tokens"]), lambda m: F.struct(b["line"].alias("line"), F.lit(None).cast("int").alias("start"), m["template"].alias("template"), m["shared"].alias("shared"), m["size"].alias("size")))))
    runs = [F.coalesce(run_match(x), F.array().cast(kind)) for x in sorted(tokens) if tokens[x]]
    blocks_col = F.when(F.arrays_overlap("words", _strings(rare)), F.concat(found.cast(kind), *runs)).otherwise(F.array().cast(kind)).cast(kind) if rare else F.array().cast(kind)
    pairs = sorted(f"{a}|{b}" for a, bs in rivals(tokens, need).items() for b in bs)

    def beaten(m: Column, o: Column) -> Column:
        """Whether o, a rival of m, matches the same line or an overlapping run better."""
        near = F.when(m["line"].isNotNull(), o["line"] == m["line"]).otherwise(o["line"].isNull() & (F.abs(o["start"] - m["start"]) < F.greatest(o["size"], m["size"])))
        more, least = o["shared"] * m["size"], m["shared"] * o["size"]
        return F.array_contains(_strings(pairs), F.concat(m["template"], F.lit("|"), o["template"])) & F.coalesce(near, F.lit(False)) & ((more > least) | ((more == least) & (o["size"] > m["size"])))

    df = words.select("doc_id", F.size("words").cast("long").alias("n_words"), *[_places(F.col("words"), p.split()).alias(f"p{k}") for k, p in enumerate(PHRASES)], blocks_col.alias("all_blocks"))
    starts = F.concat(*[F.col(f"p{k}") for k in range(len(PHRASES))])
    own = F.array_sort(F.array_compact(F.array(*[F.when(F.size(f"p{k}") > 0, F.lit(label)) for k, label in enumerate(PHRASES.values())])))
    best_blocks = F.filter("all_blocks", lambda m: ~F.exists("all_blocks", lambda o: beaten(m, o))) if pairs else F.col("all_blocks")
    df = df.select("doc_id", "n_words", starts.alias("starts"), own.alias("own"), best_blocks.alias("blocks"))
    every = F.array_sort(F.array_distinct(F.concat("own", F.transform("blocks", lambda b: F.substring_index(b["template"], "#", 1)))))
    best = F.array_max(F.transform("blocks", lambda b: b["shared"] / b["size"]))
    return df.select(
        "doc_id", "n_words",
        F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").cast("long").alias("first_word"),
        F.array_max("starts").cast("long").alias("last_word"),
        F.array_join("own", ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.size("starts") > 0, F.lit(1.0)).otherwise(F.coalesce(best, F.lit(0.0))).cast("double").alias("score"),
        "blocks",
    )


#: The phrases' places by themselves.
ORACLE_PLACES = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n_words, list_filter(range(0, len(w)), lambda k: w[k + 1] = 'cc' AND w[k + 2] = 'by') AS a, list_filter(range(0, len(w)), lambda k: w[k + 1] = 'general' AND w[k + 2] = 'public' AND w[k + 3] = 'license') AS b, list_filter(range(0, len(w)), lambda k: w[k + 1] = 'all' AND w[k + 2] = 'rights' AND w[k + 3] = 'reserved') AS c FROM d)
SELECT doc_id, n_words, len(a) + len(b) + len(c) AS n_base, list_min(list_concat(a, b, c)) AS first_word, list_max(list_concat(a, b, c)) AS last_word,
  array_to_string(list_filter([CASE WHEN len(a) > 0 THEN 'cc-by' END, CASE WHEN len(b) > 0 THEN 'gpl' END, CASE WHEN len(c) > 0 THEN 'reserved' END], lambda x: x IS NOT NULL), ',') AS base_labels FROM p"""
