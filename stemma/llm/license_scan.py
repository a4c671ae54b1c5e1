"""License scans as an exact set-similarity join, in DataFrame functions only.

Blocks are lines, cut where longer than ``BLOCK_WORDS`` into overlapping blocks that hold every
stretch of a template's length. A template T is found in a block B when |T and B| / |T|, over
distinct words, reaches ``THRESHOLD``; with a = ceil(threshold * |T|) the join keeps a pair only if

* prefix: one of T's first |T| - a + 1 words is among B's first |B| - a + 1, both in the order of
  rising corpus frequency (words outside all templates can't match and are left out of B);
* length: |B| >= a;
* position: from their first common word on, both sides have a words left at least;

and is then verified by intersection.

A notice may be wrapped over lines: the words of a text with several lines are cut into such blocks
too, across its line breaks. So long a stretch would put words of unrelated lines together, and so a
pair from these counts only where a window of the template's own length reaches a.

Word frequencies are document counts over the whole corpus.
Only the rarest words open a pair, so frequent words never gather candidates.

``reached`` lists the labels of every template that some block (or, across line breaks, window)
holds at the threshold. ``labels`` are told from their neighbours: ``TELLING`` names words that a
label can't do without, and a template that only such a word tells from another one adds its label
where the block or window holds that word.

Rows are told apart by a number of their own, written with them, so a doc_id may repeat or be null.

Defined cases: null text is empty (no words, nulls for places, empty labels, score 0); a text of
any length is scanned whole, in blocks; repeated rows, and rows that share a doc_id or have none,
each get their own text's result; equal scores need no order, as labels are a sorted set; an empty
table gives no rows. Extra columns of any name are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import persist_table

# Phrases of the base scan and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Notice templates and their labels.
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
THRESHOLD, BLOCK_WORDS = 0.8, 200
# The words that tell a label's templates from those of its neighbours.
TELLING = {"cc-by-nc": "nc", "cc-by-sa": "sharealike", "lgpl": "lesser"}
_APART = "".join(chr(b) for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122) and b != 10)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _split(text: Column) -> Column:
    """Non-empty runs between blanks."""
    return F.filter(F.split(text, "[ \n]+"), lambda w: w != "")


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def normalised(docs: DataFrame) -> DataFrame:
    """doc_id, row (a number of the row's own), t (words parted by blanks, lines kept), w (words)."""
    t = F.translate(F.coalesce("text", F.lit("")), _APART + _UPPER, " " * len(_APART) + _LOWER)
    named = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), t.alias("t"))
    return named.select("doc_id", "row", "t", _split(F.col("t")).alias("w"))


def _places(phrase: str) -> Column:
    """Starts (words from 0) of the phrase's occurrences."""
    words = phrase.split()
    here = F.lit(True)
    for p in words:
        here = here & F.array_contains("w", p)
    at = F.filter(F.sequence(F.lit(0), F.size("w") - len(words)), lambda i: _all([F.get("w", i + k) == p for k, p in enumerate(words)]))
    return F.when(here & (F.size("w") >= len(words)), at).otherwise(F.array().cast("array<int>"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def frequency_ranks(words: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Rank 0 for the rarest word of the vocabulary; at most one row a template word reaches the driver."""
    found = words.select(F.explode(F.array_intersect("w", _strings(vocabulary))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    n = {r["word"]: r["n"] for r in found.collect()}
    return {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (n.get(w, 0), w)))}


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, reached."""
    spark = docs.sparkSession
    longest = max(len(t.split()) for _, t in templates)
    if longest > block_words // 2:
        raise ValueError("block_words must be at least twice the longest template")
    words = normalised(docs.select("doc_id", "text"))
    sets = [(label, sorted(set(t.split()))) for label, t in templates]
    vocabulary = sorted({w for _, s in sets for w in s})
    rank = frequency_ranks(words, vocabulary)
    index, lead = [], set()
    for t, (label, s) in enumerate(sets):
        ordered = sorted(rank[w] for w in s)
        need = math.ceil(threshold * len(ordered) - 1e-9)
        for j, r in enumerate(ordered[: len(ordered) - need + 1]):
            index.append((r, t, j, ordered, need, label, rank.get(TELLING.get(label, ""))))
            lead.add(r)
    lead_words = _strings([w for w in vocabulary if rank[w] in lead])
    ranks = F.create_map(*[x for w in vocabulary for x in (F.lit(w), F.lit(rank[w]))])

    step = block_words // 2
    lengths = F.create_map(*[F.lit(x) for t, (_, text) in enumerate(templates) for x in (t, len(text.split()))])
    cut = lambda v: F.transform(F.sequence(F.lit(0), F.greatest(F.size(v) - step - 1, F.lit(0)), F.lit(step)), lambda s: F.slice(v, s + 1, block_words))
    lead_only = lambda bs: F.filter(bs, lambda b: F.arrays_overlap(b, lead_words))
    ranked = lambda b: F.array_sort(F.transform(F.array_intersect(b, _strings(vocabulary)), lambda w: F.element_at(ranks, w)))
    lines = F.transform(F.split("t", "\n"), lambda line: _split(line))
    by_line = F.transform(lead_only(F.flatten(F.transform(lines, cut))), lambda b: F.struct(ranked(b).alias("block"), F.lit(None).cast("array<int>").alias("run")))
    across = F.transform(lead_only(cut(F.col("w"))), lambda b: F.struct(ranked(b).alias("block"), F.transform(b, lambda w: F.try_element_at(ranks, w)).alias("run")))
    blocks = F.when(F.contains("t", F.lit("\n")), F.concat(by_line, across)).otherwise(by_line)
    scanned = words.select(
        "doc_id",
        "row",
        F.size("w").cast("long").alias("n_words"),
        *[_places(p).alias(f"p{i}") for i, p in enumerate(PHRASES)],
        F.when(F.arrays_overlap("w", lead_words), blocks).otherwise(F.array().cast("array<struct<block:array<int>,run:array<int>>>")).alias("blocks"),
    )
    scanned = persist_table(scanned, "licenses")

    table = F.broadcast(spark.createDataFrame(index, "r int, template int, j int, ordered array<int>, need int, label string, telling int"))  # prefixes of the fixed templates
    tokens = scanned.where(F.size("blocks") > 0).select("row", F.explode("blocks").alias("b")).distinct().select("row", "b.block", "b.run", F.posexplode("b.block").alias("i", "r"))
    pairs = tokens.join(table, "r").where((F.size("block") >= F.col("need")) & (F.col("i") <= F.size("block") - F.col("need")))
    first = pairs.groupBy("row", "block", "run", "template").agg(F.min(F.struct("i", "j")).alias("at"), *[F.first(c).alias(c) for c in ("ordered", "need", "label", "telling")])
    open_ = first.where(F.least(F.size("ordered") - F.col("at.j"), F.size("block") - F.col("at.i")) >= F.col("need"))
    length = F.element_at(lengths, F.col("template"))
    windows = F.sequence(F.lit(1), F.greatest(F.size("run") - length + 1, F.lit(1)))
    shared = lambda words: F.size(F.array_intersect("ordered", words))
    told = lambda words: F.when(F.col("telling").isNull() | F.array_contains(words, F.col("telling")), shared(words)).otherwise(0)

    def most(count) -> Column:
        """What the block holds, or the best window of one that lies across lines."""
        inside = F.array_max(F.transform(windows, lambda i: count(F.slice("run", i, length))))
        return F.when(F.col("run").isNull() | (count(F.col("block")) < F.col("need")), count(F.col("block"))).otherwise(inside)

    hits = open_.select("row", "label", "need", F.size("ordered").alias("of"), most(shared).alias("common"), most(told).alias("told")).where("common >= need")
    held = F.col("told") >= F.col("need")
    found = hits.groupBy("row").agg(F.collect_set(F.when(held, F.col("label"))).alias("more"), F.max(F.when(held, F.col("told") / F.col("of"))).alias("best"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("reached"))

    starts = F.concat(*[F.col(f"p{i}") for i in range(len(PHRASES))])
    own = F.filter(F.array(*[F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, label in enumerate(PHRASES.values())]), lambda x: x.isNotNull())
    based = scanned.select("doc_id", "row", "n_words", starts.alias("starts"), own.alias("own"))
    all_labels = F.array_sort(F.array_distinct(F.concat("own", F.coalesce("more", F.array().cast("array<string>")))))
    return based.join(found, "row", "left").select(
        "doc_id",
        "n_words",
        F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").cast("long").alias("first_word"),
        F.array_max("starts").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("own")), ",").alias("base_labels"),
        F.array_join(all_labels, ",").alias("labels"),
        F.when(F.size("starts") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
        F.coalesce("reached", F.lit("")).alias("reached"),
    )


def op10_license_scan(docs: DataFrame) -> DataFrame:
    return scan_licenses(docs)


def op10_sql() -> str:
    """DuckDB: every block of a line, and every window of a text with several lines, against every template."""
    listed = ", ".join(f"({i}, '{label}', '{text}', '{TELLING.get(label, '')}')" for i, (label, text) in enumerate(TEMPLATES))
    phrases = " UNION ALL ".join(
        f"SELECT rid, '{label}' AS label, unnest(list_filter(range(0, greatest(len(w) - {len(p.split()) - 1}, 0)), lambda i: {' AND '.join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(p.split()))})) AS place FROM doc" for p, label in PHRASES.items()
    )
    word = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    step = BLOCK_WORDS // 2
    return f"""
WITH doc AS (
  SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{word}') AS w FROM documents
), places AS ({phrases}
), base AS (
  SELECT rid, count(*) AS n, min(place) AS a, max(place) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY rid
), template AS (
  SELECT k, label, telling, len(string_split(body, ' ')) AS length, list_distinct(string_split(body, ' ')) AS words FROM (VALUES {listed}) AS v(k, label, body, telling)
), line AS (
  SELECT rid, regexp_extract_all(line, '{word}') AS w FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM doc)
), block AS (
  SELECT rid, w[s + 1 : s + {BLOCK_WORDS}] AS b FROM (SELECT rid, w, unnest(range(0, greatest(len(w) - {step + 1}, 0) + 1, {step})) AS s FROM line)
), near AS (
  SELECT rid, w, template.* FROM doc, template WHERE strpos(t, chr(10)) > 0 AND len(list_intersect(words, w)) >= ceil({THRESHOLD} * len(words) - 1e-9)
), stretch AS (
  SELECT rid, label, telling, words, w[s + 1 : s + length] AS b FROM (SELECT *, unnest(range(0, greatest(len(w) - length, 0) + 1)) AS s FROM near)
), hit AS (
  SELECT rid, label, telling, words, b FROM block, template WHERE len(b) > 0 UNION ALL FROM stretch
), found AS (
  SELECT rid, label, max(common / CAST(size AS DOUBLE)) FILTER (told) AS best FROM (SELECT rid, label, telling = '' OR list_contains(b, telling) AS told, len(list_intersect(words, b)) AS common, len(words) AS size FROM hit) WHERE common >= ceil({THRESHOLD} * size - 1e-9) GROUP BY rid, label
), named AS (
  SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM found WHERE best IS NOT NULL UNION ALL SELECT rid, label FROM places) GROUP BY rid
), best AS (SELECT rid, max(best) AS best, string_agg(DISTINCT label, ',' ORDER BY label) AS reached FROM found GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(base.n, 0) AS BIGINT) AS n_base, CAST(base.a AS BIGINT) AS first_word, CAST(base.b AS BIGINT) AS last_word,
       coalesce(base.labels, '') AS base_labels, coalesce(named.labels, '') AS labels, CASE WHEN base.n > 0 THEN 1.0::DOUBLE ELSE coalesce(best.best, 0.0::DOUBLE) END AS score, coalesce(best.reached, '') AS reached
FROM doc LEFT JOIN base USING (rid) LEFT JOIN named USING (rid) LEFT JOIN best USING (rid)
"""
