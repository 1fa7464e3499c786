"""License scans: a positional index of rare template words, looked up row by row.

Each template is a sequence of words. Its anchor is its word of highest inverse document frequency
over the template collection. A file's places of anchors are found in one pass over its words; each
place fixes the relative position at which the template's other words are looked up (its postings),
so a template is scored by the IDF mass that stands where it should. An alignment counts only where
the template's mandatory key phrase stands in full. Base places are the alignments of the three base
phrases, counted exactly. Everything is a row-local SQL expression: no join, no shuffle, no user code.

Defined cases: a null or empty text has no words, no labels (empty strings) and score 0. Repeated
rows give repeated results; an empty table gives an empty table; other columns are not touched.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paritas.llm.shared import ascii_lower

#: Base phrases and their labels.
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

#: Label, template words, mandatory key phrase (part of the template).
TEMPLATES = (
    ("mit", "released under the mit license", "the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby granted free of charge"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    ("cc-by-nc", "creative commons attribution noncommercial", "attribution noncommercial"),
    ("cc-by-nc", "cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "cc by sa 4 0", "cc by sa"),
    ("cc-by-sa", "creative commons attribution sharealike", "attribution sharealike"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("lgpl", "gnu lesser general public license", "lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification", "redistribution and use in source and binary forms"),
    ("bsd", "released under the bsd license", "the bsd license"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("unlicense", "free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use copy modify and or distribute this software"),
)
#: The least share of a template's IDF mass at an alignment.
MIN_SHARE = 0.5
_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _idf() -> dict[str, float]:
    """IDF over the template collection."""
    sets = [set(t.split()) for _, t, _ in TEMPLATES]
    return {w: math.log(1 + len(sets) / sum(w in s for s in sets)) for s in sets for w in s}


def _anchor(words: list[str], idf: dict[str, float]) -> int:
    """Place of the rarest word; ties go to the longer and then the earlier one."""
    return max(range(len(words)), key=lambda i: (idf.get(words[i], 0.0), len(words[i]), -i))


def _phrase_at(words: list[str], start: str) -> str:
    return " AND ".join(f"coalesce(get(__w, {start} + {j}) = '{x}', false)" for j, x in enumerate(words))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per document: words, base places, their first and last word, labels and a score."""
    idf = _idf()
    plans = []
    for label, text, key in TEMPLATES:
        words, must = text.split(), key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(must)] == must)
        # the anchor stands inside the key phrase, so that no verified alignment can be missed
        k = at + _anchor(must, idf)
        plans.append((label, words, must, at, k))
    base = [(p.split(), label, _anchor(p.split(), idf)) for p, label in BASE]
    anchors = sorted({w[k] for _, w, _, _, k in plans} | {p[k] for p, _, k in base})
    inlist = ", ".join(f"'{a}'" for a in anchors)

    w = F.split(ascii_lower(F.coalesce(F.col("text"), F.lit(""))), _SPLIT, -1)
    df = docs.select("doc_id", w.alias("__r"))
    # only the first and the last piece can be empty
    df = df.select("doc_id", F.expr("slice(__r, IF(__r[0] = '', 2, 1), greatest(size(__r) - IF(__r[0] = '', 1, 0) - IF(size(__r) > 1 AND element_at(__r, -1) = '', 1, 0), 0))").alias("__w"))
    df = df.withColumn("__p", F.expr(f"CASE WHEN arrays_overlap(__w, array({inlist})) THEN filter(sequence(0, size(__w) - 1), i -> __w[i] IN ({inlist})) ELSE array() END").cast("array<int>"))

    starts = []
    for p, label, k in base:
        starts.append(f"transform(filter(__p, p -> __w[p] = '{p[k]}' AND {_phrase_at(p, f'p - {k}')}), p -> struct(p - {k} AS s, '{label}' AS l))")
    found = []
    for label, words, must, at, k in plans:
        total = sum(idf[x] for x in words)
        mass = " + ".join(f"IF(coalesce(get(__w, p - {k} + {j}) = '{x}', false), {idf[x] / total!r}D, 0D)" for j, x in enumerate(words))
        found.append(f"transform(filter(__p, p -> __w[p] = '{words[k]}' AND {_phrase_at(must, f'p - {k - at}')}), p -> struct('{label}' AS l, least(1D, {mass}) AS m))")
    df = df.select(
        "doc_id",
        F.expr("CAST(size(__w) AS BIGINT)").alias("n_words"),
        F.expr(f"CASE WHEN size(__p) > 0 THEN concat({', '.join(starts)}) END").alias("__b"),
        F.expr(f"CASE WHEN size(__p) > 0 THEN filter(concat({', '.join(found)}), x -> x.m >= {MIN_SHARE}D) END").alias("__f"),
    )
    return df.select(
        "doc_id",
        "n_words",
        F.expr("CAST(coalesce(size(__b), 0) AS BIGINT)").alias("n_base"),
        F.expr("CAST(array_min(transform(__b, x -> x.s)) AS BIGINT)").alias("first_word"),
        F.expr("CAST(array_max(transform(__b, x -> x.s)) AS BIGINT)").alias("last_word"),
        F.expr("coalesce(array_join(array_sort(array_distinct(transform(__b, x -> x.l))), ','), '')").alias("base_labels"),
        F.expr("coalesce(array_join(array_sort(array_distinct(concat(transform(__b, x -> x.l), transform(__f, x -> x.l)))), ','), '')").alias("labels"),
        F.expr("greatest(coalesce(array_max(transform(__f, x -> x.m)), 0D), IF(coalesce(size(__b), 0) > 0, 0.5D, 0D))").alias("score"),
    )


def oracle() -> str:
    """The same rows as DuckDB SQL, written from the templates without the index of anchors."""
    idf = _idf()

    def at(words: list[str], shift: int = 0) -> str:
        return " AND ".join(f"coalesce(w[i + {shift + j}], '') = '{x}'" for j, x in enumerate(words))

    base = [f"list_transform(list_filter(range(1, len(w) + 1), lambda i: {at(p.split())}), lambda i: {{'s': i - 1, 'l': '{label}'}})" for p, label in BASE]
    found = []
    for label, text, key in TEMPLATES:
        words, must = text.split(), key.split()
        first = next(i for i in range(len(words)) if words[i : i + len(must)] == must)
        total = sum(idf[x] for x in words)
        # i is the place of the key phrase; a word before the text's first one cannot match
        mass = " + ".join(f"CASE WHEN i + {j - first} >= 1 AND coalesce(w[greatest(i + {j - first}, 1)], '') = '{x}' THEN {idf[x] / total!r}::DOUBLE ELSE 0::DOUBLE END" for j, x in enumerate(words))
        found.append(f"list_transform(list_filter(range(1, len(w) + 1), lambda i: {at(must)}), lambda i: {{'l': '{label}', 'm': least(1::DOUBLE, {mass})}})")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
x AS (SELECT doc_id, len(w) AS n, flatten([{", ".join(base)}]) AS b, list_filter(flatten([{", ".join(found)}]), lambda e: e.m >= {MIN_SHARE}) AS f FROM t)
SELECT doc_id, n::BIGINT AS n_words, len(b)::BIGINT AS n_base, list_min(list_transform(b, lambda e: e.s))::BIGINT AS first_word, list_max(list_transform(b, lambda e: e.s))::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(list_distinct(list_transform(b, lambda e: e.l))), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(list_transform(b, lambda e: e.l), list_transform(f, lambda e: e.l)))), ','), '') AS labels,
  greatest(coalesce(list_max(list_transform(f, lambda e: e.m)), 0::DOUBLE), CASE WHEN len(b) > 0 THEN 0.5::DOUBLE ELSE 0::DOUBLE END) AS score FROM x"""
