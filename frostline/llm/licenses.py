r"""License statements: phrases by exact match, license texts by an exact set-similarity join, SPDX tags.

Words are runs of a-z, 0-9 and characters beyond ASCII after lower-casing A-Z; n_words counts them. Base
places are where a phrase's words stand consecutively.

The join finds every block of text (a line, or a paragraph of several lines, paragraphs being parted
by blank lines) that holds THRESHOLD or more of the different words of a license template. Only words
that some template has can count, and words are ordered by their frequency over all documents, rare ones
first. With o the words that a template of n words needs,
- length: a text with fewer than o such words is out;
- prefix: a text that holds o of the n words holds one of the n - o + 1 rarest; only texts with such a
  word become candidates of the template;
- position: the shared rare word stands at some place in both orders, and what can stand before and
  behind it in both bounds the overlap; it must reach o.
What is left is counted exactly. A block lies in a document, so documents go through the filters first,
by one pass over all texts, and only the candidates are cut into blocks. Of templates that are alike
(one holds THRESHOLD of the other's words) a block keeps the best: the greatest containment, then the most
words, so a notice of the LGPL isn't one of the GPL, whose words it all holds.

Templates are a parameter, a table (label, text) of a size that the driver can hold; words, prefixes and
texts of templates are joined as tables. SPDX tags (SPDX-License-Identifier: and an expression) give the
labels of the licenses that they name. All of it runs as DataFrame operations.

Null texts count as empty: no words, no labels, score 0. Rows equal in id and text come out alike; a null
id is an id. A very long text is one row in memory. An empty table gives no rows, an empty table of
templates no labels of its own. Columns besides the id and the text are left out, so their names never
clash. The score is the greatest containment of the labels found, 1 where a phrase or a tag stands; else 0.
"""

from __future__ import annotations

import math
import re
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.llm import shared

PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
THRESHOLD = 0.8
#: (label, text). Wording of public license notices.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("gpl", "this work is licensed under the gnu general public license version"),
    ("lgpl", "this work is licensed under the gnu lesser general public license version"),
    ("agpl", "this work is licensed under the gnu affero general public license version"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
]
#: Beginnings of SPDX identifiers, lower-cased, and their labels; others are their own labels.
TAGS = [("apache-2", "apache-2"), ("gpl-", "gpl"), ("lgpl-", "lgpl"), ("agpl-", "agpl"), ("mpl-2", "mpl-2"), ("bsd-", "bsd"), ("cc-by-nc", "cc-by-nc")]
TAG = r"SPDX-License-Identifier:[ \t]*(\(*[A-Za-z0-9.+-]+\)*(?:[ \t]+(?:OR|AND|WITH)[ \t]+\(*[A-Za-z0-9.+-]+\)*)*)"
EXCEPTION = r"[ \t]+WITH[ \t]+[^ \t]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OTHER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Templates:
    """Templates with their different words: number, label, words needed, words; and which are alike."""

    def __init__(self, listed: list[tuple[str, str]]) -> None:
        self.rows: list[tuple[int, str, int, list[str]]] = []
        for label, text in listed:
            words = list(dict.fromkeys(w for w in re.split(OTHER, text.translate(str.maketrans(UPPER, LOWER))) if w))
            if words:
                self.rows.append((len(self.rows), label, needed(len(words)), words))
        sets = [set(words) for *_, words in self.rows]
        self.rivals: dict[int, list[int]] = {k: [] for k, *_ in self.rows}
        for a, b in combinations(range(len(sets)), 2):
            if len(sets[a] & sets[b]) >= needed(min(len(sets[a]), len(sets[b]))):
                self.rivals[a].append(b)
                self.rivals[b].append(a)

    def vocabulary(self) -> list[str]:
        return sorted({w for *_, words in self.rows for w in words})

    def least(self) -> int:
        return min((o for _, _, o, _ in self.rows), default=0)


def needed(n: int) -> int:
    return math.ceil(THRESHOLD * n - 1e-9)


def padded(text: Column) -> Column:
    """The words with one blank before, between and behind; one blank if there are none."""
    return F.regexp_replace(F.concat(F.lit(" "), F.translate(text, UPPER, LOWER), F.lit(" ")), OTHER, " ")


def _blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def phrases(docs: DataFrame) -> DataFrame:
    """`docs` (with a column words, padded) with n_words, n_base, first_word, last_word and base_list."""
    words = F.col("words")
    out = docs.withColumn("n_words", (_blanks(words) - 1).cast("long"))
    for k, (phrase, _) in enumerate(PHRASES):
        parts = F.split(words, f" (?={phrase} )", -1)
        out = out.withColumn(f"p{k}", F.when(words.contains(f" {phrase} "), parts))
    part = [F.col(f"p{k}") for k in range(len(PHRASES))]
    count = [F.when(p.isNull(), 0).otherwise(F.size(p) - 1) for p in part]
    out = out.withColumn("n_base", sum(count, F.lit(0)).cast("long"))
    out = out.withColumn("first_word", F.least(*(_blanks(F.element_at(p, 1)) for p in part)).cast("long"))
    out = out.withColumn("last_word", F.greatest(*(F.col("n_words") - _blanks(F.element_at(p, -1)) for p in part)).cast("long"))
    out = out.withColumn("base_list", F.array_compact(F.array(*(F.when(p.isNotNull(), label) for p, (_, label) in zip(part, PHRASES, strict=True)))))
    return out.drop(*(f"p{k}" for k in range(len(PHRASES))))


def tags(text: Column) -> Column:
    """Labels of the SPDX identifiers in a text."""
    found = F.regexp_extract_all(text, F.lit(TAG), 1)
    plain = F.transform(found, lambda e: F.regexp_extract_all(F.regexp_replace(e, EXCEPTION, ""), F.lit(r"[A-Za-z0-9.+-]*[A-Za-z][A-Za-z0-9.+-]*"), 0))
    ids = F.filter(F.flatten(plain), lambda x: ~x.isin("OR", "AND"))

    def label(name: Column) -> Column:
        out = name
        for start, known in reversed(TAGS):
            out = F.when(name.startswith(start), known).otherwise(out)
        return out

    return F.when(text.contains("SPDX-License-Identifier:"), F.array_distinct(F.transform(ids, lambda x: label(F.lower(x))))).otherwise(F.array().cast("array<string>"))


def blocks(docs: DataFrame) -> DataFrame:
    """id, key, block (its number in the text) and words of the lines and paragraphs of each text."""
    lines = F.split(F.col("text"), "\n", -1)
    paragraphs = F.filter(F.split(F.col("text"), r"\n[ \t\r]*\n", -1), lambda x: x.contains("\n"))
    cut = docs.select("id", "key", F.posexplode(F.concat(lines, paragraphs)).alias("block", "part"))
    return cut.select("id", "key", "block", F.array_distinct(F.split(F.btrim(padded(F.col("part"))), " ")).alias("words"))


def contained(docs: DataFrame, found: DataFrame, templates: Templates) -> DataFrame:
    """id, key, label, score of blocks and templates that meet the threshold and are the best of their like.
    docs: id, key, text; found: a written table of id, key, matched (words that templates have) of each document."""
    spark = docs.sparkSession
    counted = {r["word"]: r["n"] for r in found.select(F.explode("matched").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}  # words of templates only
    place = {w: k for k, w in enumerate(sorted(templates.vocabulary(), key=lambda w: (counted.get(w, 0), w)))}
    index, listed = [], []
    for k, label, o, words in templates.rows:
        places = sorted(place[w] for w in words)
        listed.append((k, label, o, len(words), places, templates.rivals[k]))
        index += [(p, k, at, len(words), o) for at, p in enumerate(places[: len(words) - o + 1])]
    order = spark.createDataFrame(list(place.items()), "word string, place int")
    prefix = spark.createDataFrame(index, "place int, template int, at int, n int, o int")
    texts = spark.createDataFrame(listed, "template int, label string, o int, n int, places array<int>, rivals array<int>")

    def candidates(rows: DataFrame, *key: str) -> DataFrame:
        """key, template, shared of the rows (key, words) that hold enough of a template's words."""
        own = rows.select(*key, F.explode("words").alias("word")).join(order, "word").groupBy(*key).agg(F.sort_array(F.collect_set("place")).alias("own"))
        probes = own.where(F.size("own") >= templates.least()).select(*key, "own", F.posexplode("own").alias("here", "place")).join(prefix, "place")
        bound = F.least("at", "here") + 1 + F.least(F.col("n") - 1 - F.col("at"), F.size("own") - 1 - F.col("here"))
        close = probes.where((F.size("own") >= F.col("o")) & (bound >= F.col("o"))).select(*key, "own", "template").distinct()
        counts = close.join(texts, "template").withColumn("shared", F.size(F.array_intersect("own", "places")))
        return counts.where(F.col("shared") >= F.col("o")).drop("own", "places")

    docs_of = candidates(found.select("id", "key", F.col("matched").alias("words")).where(F.size("words") >= templates.least()).distinct(), "id", "key")
    some = shared.written(docs_of.select(F.col("id").alias("_id"), F.col("key").alias("_key")).distinct(), "candidates")
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))
    cut = blocks(docs.join(some, same, "left_semi")).where(F.size("words") >= templates.least())
    hits = candidates(cut, "id", "key", "block").withColumn("score", F.col("shared") / F.col("n"))
    of_block = hits.groupBy("id", "key", "block").agg(F.collect_set(F.struct("score", "n", (-F.col("template")).alias("later"), "label", "rivals")).alias("all"))

    def best(x: Column) -> Column:
        return ~F.exists("all", lambda y: F.array_contains(x["rivals"], -y["later"]) & (F.struct(y["score"], y["n"], y["later"]) > F.struct(x["score"], x["n"], x["later"])))

    return of_block.select("id", "key", F.explode(F.filter("all", best)).alias("x")).select("id", "key", "x.label", "x.score")


def scan(docs: DataFrame, templates: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each document.
    templates: a table (label, text), by default that of TEMPLATES."""
    spark = docs.sparkSession
    table = templates if templates is not None else spark.createDataFrame(TEMPLATES, "label string, text string")
    own = Templates([(r["label"], r["text"]) for r in table.select("label", "text").where("label IS NOT NULL AND text IS NOT NULL").orderBy("label", "text").collect()])
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("key", F.xxhash64("text"))
    words = spark.createDataFrame([(own.vocabulary(),)], "vocabulary array<string>")
    vocabulary = words.select("vocabulary").scalar()  # one row: a scalar subquery, not literals of the plan
    matched = F.array_intersect(F.array_distinct(F.split("words", " ")), vocabulary)
    read = phrases(keyed.select("id", "key", padded(F.col("text")).alias("words"), tags(F.col("text")).alias("tags")))
    base = shared.written(read.withColumn("matched", matched).drop("words"), "scanned")
    hits = contained(keyed, base, own).groupBy("id", "key").agg(F.collect_set("label").alias("_more"), F.max("score").alias("_score"))
    hits = hits.select(F.col("id").alias("_id"), F.col("key").alias("_key"), "_more", "_score")
    joined = base.join(hits, F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left")
    none = F.array().cast("array<string>")
    return joined.select(
        F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("base_list"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(F.array_union("base_list", "tags"), F.coalesce("_more", none))), ",").alias("labels"),
        F.when((F.col("n_base") > 0) | (F.size("tags") > 0), 1.0).otherwise(F.coalesce("_score", F.lit(0.0))).alias("score"),
    )


def sql() -> str:
    """The same by DuckDB, over the table documents, with every block compared to every template."""
    phrase = ", ".join(f"('{p}', '{label}')" for p, label in PHRASES)
    template = ", ".join(f"({k}, '{label}', {words})" for k, label, _, words in Templates(sorted(TEMPLATES)).rows)
    tag = " ".join(f"WHEN starts_with(x, '{start}') THEN '{label}'" for start, label in TAGS)
    low = f"translate({{0}}, '{UPPER}', '{LOWER}')"
    return rf"""
WITH phrases(phrase, label) AS (VALUES {phrase}), templates(k, label, words) AS (VALUES {template}),
alike AS (
  SELECT a.k AS x, b.k AS y FROM templates a JOIN templates b ON a.k <> b.k AND len(list_intersect(a.words, b.words)) >= ceil({THRESHOLD}e0 * least(len(a.words), len(b.words)) - 1e-9)
), docs AS (
  SELECT doc_id, coalesce(text, '') AS text, list_filter(string_split(regexp_replace({low.format("coalesce(text, '')")}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') AS words FROM documents
), places AS (
  SELECT doc_id, label, unnest(list_filter(generate_series(1, len(words)), lambda i: array_to_string(words[i:i + len(string_split(phrase, ' ')) - 1], ' ') = phrase)) - 1 AS place FROM docs, phrases
  WHERE contains(array_to_string(words, ' '), phrase)
), base AS (
  SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS found FROM places GROUP BY doc_id
), expressions AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '{TAG}', 1)) AS e FROM docs WHERE contains(text, 'SPDX-License-Identifier:')
), identifiers AS (
  SELECT doc_id, unnest(regexp_extract_all(regexp_replace(e, '{EXCEPTION}', '', 'g'), '[A-Za-z0-9.+-]*[A-Za-z][A-Za-z0-9.+-]*')) AS id FROM expressions
), tagged AS (
  SELECT doc_id, list(DISTINCT CASE {tag} ELSE x END) AS found FROM (SELECT doc_id, lower(id) AS x FROM identifiers WHERE id NOT IN ('OR', 'AND')) GROUP BY doc_id
), parts AS (
  SELECT doc_id, list_concat(string_split(text, chr(10)), list_filter(regexp_split_to_array(text, '\n[ \t\r]*\n'), lambda x: contains(x, chr(10)))) AS parts FROM docs
), blocks AS (
  SELECT doc_id, unnest(parts) AS block, generate_subscripts(parts, 1) AS number FROM parts
), cut AS (
  SELECT doc_id, number, list_distinct(regexp_split_to_array({low.format("block")}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS words FROM blocks
), met AS (
  SELECT doc_id, number, t.k, t.label, len(t.words) AS n, len(list_intersect(c.words, t.words)) / len(t.words) AS score FROM cut c, templates t
  WHERE len(list_intersect(c.words, t.words)) >= ceil({THRESHOLD}e0 * len(t.words) - 1e-9)
), hits AS (
  SELECT doc_id, list(DISTINCT label) AS found, max(score) AS best FROM met m
  WHERE NOT EXISTS (SELECT 1 FROM met o JOIN alike a ON a.y = o.k WHERE o.doc_id = m.doc_id AND o.number = m.number AND a.x = m.k
    AND (o.score > m.score OR o.score = m.score AND (o.n > m.n OR o.n = m.n AND o.k < m.k))) GROUP BY doc_id
)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(b.n_base, 0)::BIGINT AS n_base, b.first_word::BIGINT AS first_word, b.last_word::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(b.found), ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(list_concat(coalesce(b.found, []), coalesce(h.found, [])), coalesce(t.found, [])))), ',') AS labels,
  CASE WHEN b.n_base > 0 OR len(t.found) > 0 THEN 1.0::DOUBLE ELSE coalesce(h.best, 0)::DOUBLE END AS score
FROM docs d LEFT JOIN base b USING (doc_id) LEFT JOIN hits h USING (doc_id) LEFT JOIN tagged t USING (doc_id)
"""
