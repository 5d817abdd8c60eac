"""License scans: a positional rare-token index over license templates, in DataFrame functions only.

Document frequencies of all template words are counted over the whole corpus.
A template (or base phrase) can only stand where the rarest word of its
mandatory phrase stands, so a file is looked into only if it holds one of
those words.  There, each place of such a word gives its templates a relative
position (word position minus template position), so every template is
decided, however many a file holds; at each such position the mandatory
phrases must stand word by word, and the IDF mass of the template's words that
agree must reach ``LEAST``.

Row by row after one small aggregate, so no key or source can be hot.  Null
text is empty: zero words and no labels.  Repeated rows are scanned alike.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices by label, each with the phrases in it that are mandatory.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("free of charge to any person",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("general public license version 2",)),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("general public license version 3",)),
    ("lgpl", "under the terms of the gnu lesser general public license", ("lesser general public license",)),
    ("agpl", "under the terms of the gnu affero general public license", ("affero general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("source and binary forms",)),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("any purpose with or without fee",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc0", "released under cc0 1 0 universal public domain dedication", ("cc0 1 0",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)

#: The least share of a template's IDF mass.
LEAST = 0.6

#: Words over text whose A-Z aren't lowered yet; lowering them changes no boundary.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def _low(word: Column) -> Column:
    return F.translate(word, UPPER, LOWER)


def vocabulary() -> list[str]:
    return sorted({w for text in (*PHRASES, *(t for _, t, _ in TEMPLATES)) for w in text.split()})


def rarity(docs: DataFrame, text_col: str = "text") -> dict[str, float]:
    """IDF of each license word over all documents; one row a word comes to the driver."""
    known = F.array(*map(F.lit, vocabulary()))
    own = F.array_intersect(F.regexp_extract_all(F.lower(F.coalesce(text_col, F.lit(""))), F.lit(WORD), F.lit(0)), known)
    rows = docs.select(F.explode(F.concat(own, F.array(F.lit("")))).alias("word")).groupBy("word").count().collect()
    counts = {r["word"]: r["count"] for r in rows}
    total = counts.pop("", 0)
    return {w: math.log(1 + total / (1 + counts.get(w, 0))) for w in vocabulary()}


def _place(phrase: list[str], words: Column, start: Column) -> Column:
    """Whether a phrase's words stand consecutively from ``start``."""
    ok = F.lit(True)
    for j, w in enumerate(phrase):
        ok = ok & F.coalesce(_low(F.get(words, start + j)) == w, F.lit(False))
    return ok


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, ``places`` (label and start of every base phrase), ``found`` (label, start, coverage of every template)."""
    idf = rarity(docs, text_col)
    rare = lambda words: max(range(len(words)), key=lambda j: (idf[words[j]], -j))
    phrases = [p.split() for p in PHRASES]
    gate = {p[rare(p)] for p in phrases} | {k[rare(k)] for _, _, keys in TEMPLATES for k in (keys[0].split(),)}

    words = F.col("words")
    base = docs.select(F.col(id_col).alias("id"), _words(F.col(text_col)).alias("words"))
    asked = F.exists(words, lambda x: F.lower(x).isin(sorted(gate)))
    hits = F.filter(F.transform(words, lambda x, i: F.struct(i.alias("p"), F.lower(x).alias("w"))), lambda h: h["w"].isin(sorted(gate)))
    none = F.array().cast("array<struct<p:int,w:string>>")
    base = base.withColumn("hits", F.when(asked, hits).otherwise(none))

    def places_of(p: list[str]) -> Column:
        a = rare(p)
        starts = F.transform(F.filter("hits", lambda h: h["w"] == p[a]), lambda h: h["p"] - a)
        kept = F.filter(starts, lambda s: (s >= 0) & _place(p, words, s))
        return F.transform(kept, lambda s: F.struct(F.lit(PHRASES[" ".join(p)]).alias("label"), s.cast("long").alias("start")))

    def places_in(text: str, phrase: str) -> int:
        return len(f" {text} "[: f" {text} ".index(f" {phrase} ")].split())

    def found_of(t: int) -> Column:
        label, text, keys = TEMPLATES[t]
        own, first = text.split(), keys[0].split()
        anchor = rare(first)
        starts = F.transform(F.filter("hits", lambda h: h["w"] == first[anchor]), lambda h: h["p"] - (places_in(text, keys[0]) + anchor))
        total = sum(idf[w] for w in own) or 1.0

        def cover(o: Column) -> Column:
            agrees = [F.when(F.coalesce(_low(F.get(words, o + j)) == w, F.lit(False)), idf[w] / total).otherwise(0.0) for j, w in enumerate(own)]
            return F.least(sum(agrees, F.lit(0.0)), F.lit(1.0))

        def verified(o: Column) -> Column:
            ok = F.lit(True)
            for k in keys:
                ok = ok & _place(k.split(), words, o + places_in(text, k))
            return ok

        return F.transform(F.filter(starts, verified), lambda o: F.struct(F.lit(label).alias("label"), o.cast("long").alias("start"), cover(o).alias("coverage")))

    places = [places_of(p) for p in phrases]
    found = [found_of(t) for t in range(len(TEMPLATES))]
    return (
        base.select(F.col("id").alias(id_col), F.size("words").cast("long").alias("n_words"), F.concat(*places).alias("places"), F.filter(F.concat(*found), lambda x: x["coverage"] >= LEAST).alias("found"))
    )


def license_report(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    scan = scan_licenses(docs)
    starts = F.transform("places", lambda x: x["start"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    base = F.transform("places", lambda x: x["label"])
    score = F.coalesce(F.array_max(F.transform("found", lambda x: x["coverage"])), F.lit(0.0))
    return scan.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, F.transform("found", lambda x: x["label"]))).alias("labels"),
        F.round(F.when(F.size("places") > 0, F.lit(1.0)).otherwise(score), 6).alias("score"),
    )


def _sql() -> str:
    """The same labels as SQL, without an index: every template at every place where its first mandatory phrase begins."""
    templates = ", ".join(f"({t}, '{label}', {text.split()})" for t, (label, text, _) in enumerate(TEMPLATES))
    keys, firsts = [], []
    for t, (_, text, phrases) in enumerate(TEMPLATES):
        for k in phrases:
            at = len(f" {text} "[: f" {text} ".index(f" {k} ")].split())
            firsts += [f"({t}, {at}, '{k.split()[0]}')"] * (k == phrases[0])
            keys += [f"({t}, {at + j}, '{w}')" for j, w in enumerate(k.split())]
    places = ", ".join(f"('{label}', {p.split()})" for p, label in PHRASES.items())
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w,
    regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS lw FROM documents
), tp(t, label, words) AS (VALUES {templates}), ph(label, words) AS (VALUES {places}), ky(t, j, word) AS (VALUES {", ".join(keys)}), fw(t, j, word) AS (VALUES {", ".join(firsts)}
), vocab AS (SELECT DISTINCT unnest(words) AS word FROM (SELECT words FROM tp UNION ALL SELECT words FROM ph)
), idf AS (SELECT word, ln(1 + (SELECT count(*) FROM d) / (1 + (SELECT count(*) FROM d WHERE list_contains(lw, word)))) AS idf FROM vocab
), pos AS (SELECT r, p, word FROM (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS p FROM d) JOIN vocab USING (word)
), base AS (SELECT r, p AS start, label FROM pos JOIN ph ON word = words[1] JOIN d USING (r) WHERE w[p + 1:p + len(words)] = words
), tw AS (SELECT t, label, unnest(words) AS word, unnest(range(len(words))) AS j FROM tp
), offs AS (SELECT DISTINCT r, t, p - j AS o FROM pos JOIN fw USING (word)
), ok AS (SELECT r, t, o FROM offs JOIN ky USING (t) JOIN d USING (r) GROUP BY r, t, o HAVING bool_and(o + j >= 0 AND coalesce(w[o + j + 1] = word, false))
), cov AS (SELECT r, t, o, any_value(label) AS label, sum(CASE WHEN o + j >= 0 AND w[o + j + 1] = word THEN idf ELSE 0 END) / sum(idf) AS c FROM ok JOIN tw USING (t) JOIN idf USING (word) JOIN d USING (r) GROUP BY r, t, o
), found AS (SELECT r, label, least(c, 1.0) AS c FROM cov WHERE c >= {LEAST}
), b AS (SELECT r, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY r
), l AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM base UNION ALL SELECT r, label FROM found) GROUP BY r
), s AS (SELECT r, max(c) AS c FROM found GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  round(CAST(CASE WHEN n_base > 0 THEN 1 ELSE coalesce(c, 0) END AS DOUBLE), 6) AS score
FROM d LEFT JOIN b USING (r) LEFT JOIN l USING (r) LEFT JOIN s USING (r)
"""


#: The same results as SQL.
SQL = _sql()
