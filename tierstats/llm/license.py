"""License scans with a positional index of rare tokens. DataFrame operations only."""

from __future__ import annotations

import math
from collections import Counter
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, staged

#: Base phrases, found wherever their words stand consecutively (fixed values).
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Templates of the method: words -> label and the key phrase that must stand in full (fixed values).
TEMPLATES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software": ("mit", "permission is hereby granted"),
    "released under the mit license": ("mit", "mit license"),
    "spdx license identifier mit": ("mit", "identifier mit"),
    "licensed under the apache license version 2 0": ("apache-2", "apache license"),
    "spdx license identifier apache 2 0": ("apache-2", "identifier apache"),
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": ("gpl", "gnu general public license"),
    "licensed under the gnu general public license": ("gpl", "gnu general public license"),
    "gnu lesser general public license": ("lgpl", "lesser general public license"),
    "gnu affero general public license": ("agpl", "affero general public license"),
    "redistribution and use in source and binary forms with or without modification are permitted": ("bsd", "source and binary forms"),
    "this source code form is subject to the terms of the mozilla public license": ("mpl", "mozilla public license"),
    "creative commons attribution share alike": ("cc-by-sa", "creative commons attribution share"),
    "licensed under cc by sa": ("cc-by-sa", "cc by sa"),
    "creative commons attribution non commercial": ("cc-by-nc", "creative commons attribution non"),
    "licensed under cc by nc": ("cc-by-nc", "cc by nc"),
    "this is free and unencumbered software released into the public domain": ("unlicense", "unencumbered software"),
    "all rights reserved": ("all-rights-reserved", "all rights reserved"),
}
#: Share of a template's weight that must stand at the right places, in hundredths.
MIN_SCORE = 60

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of A-Z lower-cased text: digits, a-z and all beyond ASCII; empty array if there are none."""
    plain = F.btrim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD, " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


class Posting(NamedTuple):
    """One word of a declared phrase: the phrase's label, length, total weight and number of key words, the word's place,
    whether it is of the key phrase, and its weight."""

    template: str
    label: str
    base: bool
    len: int
    total: int
    keys: int
    place: int
    key: bool
    word: str
    weight: int


def posting_list() -> list[Posting]:
    """Weights are hundredths of the words' inverse frequency among the declared phrases, so a document's score does not
    depend on other documents."""
    phrases = [("base:" + p, p, label, p, True) for p, label in BASE_PHRASES.items()] + [(p, p, label, key, False) for p, (label, key) in TEMPLATES.items()]
    df = Counter(w for _, p, *_ in phrases for w in set(p.split()))
    weight = {w: round(100 * (1 + math.log((len(phrases) + 1) / (n + 1)))) for w, n in df.items()}
    out = []
    for name, phrase, label, key, base in phrases:
        words, must = phrase.split(), key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(must)] == must)
        total = sum(weight[w] for w in words)
        out += [Posting(name, label, base, len(words), total, len(must), i, at <= i < at + len(must), w, weight[w]) for i, w in enumerate(words)]
    return out


def anchors_of(postings: list[Posting], found_in: dict[str, int]) -> dict[str, Posting]:
    """Template -> its anchor, the posting of its key word of highest IDF: the word that the fewest rows have, ``found_in``
    tells in how many."""
    rank = lambda p: (found_in.get(p.word, 0), p.place)
    return {t: min((p for p in postings if p.key and p.template == t), key=rank) for t in {p.template for p in postings}}


def licensed_places(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, places), one row for each row of ``docs``; ``places`` has (template, label, base, start, score) of the accepted
    matches, null where no key phrase can be.

    One pass over the text looks for the words of key phrases; only a file that has all words of a key phrase keeps
    its words. What is looked up in such a file are the anchors, each phrase's key word of highest IDF over all rows, and
    nothing else: an anchor at a place gives a (phrase, start), and the phrase's other postings are then probed at their
    places relative to it. A common word is never looked up by itself, and a phrase whose anchor is not there is not seen; as
    an anchor is of the mandatory key phrase, that loses no match. A place is accepted if its key phrase is there in full
    and the words found have MIN_SCORE of the weight (base phrases: every word). The work on a file is its anchors times the
    phrases' lengths; nothing is shuffled, and the declared phrases bound the index, which is part of the plan, and what is
    collected, one row a key word.

    Null and blank texts have no word. Repeated rows, also of one id, and null ids are rows like others. Long texts are read
    whole. Empty table: empty result. Other columns are not carried, so their names cannot clash.
    """
    postings = posting_list()
    key_words = sorted({p.word for p in postings if p.key})
    key_sets = sorted({tuple(sorted({p.word for p in postings if p.key and p.template == t})) for t in {p.template for p in postings}})
    rows = docs.select(F.col(id_col).alias("id"), words_of(F.col(text_col).cast("string")).alias("w"))
    rows = rows.select("id", "w", F.array_distinct(F.filter("w", lambda w: w.isin(key_words))).alias("seen"))
    whole_key = F.exists(F.array(*(F.array(*(F.lit(w) for w in k)) for k in key_sets)), lambda k: F.forall(k, lambda w: F.array_contains("seen", w)))
    rows = staged(rows.select("id", F.size("w").cast("long").alias("n_words"), "seen", F.when(whole_key, F.col("w")).alias("w")), "license-words")
    found_in = {r["word"]: r["n"] for r in rows.select(F.explode("seen").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return _matched(rows, postings, anchors_of(postings, found_in))


def _matched(rows: DataFrame, postings: list[Posting], anchors: dict[str, Posting]) -> DataFrame:
    """rows (id, n_words, w) -> (id, n_words, places). ``w`` must be a stored column: lambdas would work it out again and again."""
    names = sorted(anchors)
    of = lambda t: [p for p in postings if p.template == t]
    by_word: dict[str, list[Column]] = {}
    for i, t in enumerate(names):
        by_word.setdefault(anchors[t].word, []).append(F.struct(F.lit(i).alias("t"), F.lit(anchors[t].place).alias("place")))
    index = F.create_map(*(x for w, at in by_word.items() for x in (F.lit(w), F.array(*at))))
    phrases = F.array(*(F.struct(
        F.lit(t).alias("template"), F.lit(of(t)[0].label).alias("label"), F.lit(of(t)[0].base).alias("base"), F.lit(of(t)[0].len).alias("len"), F.lit(of(t)[0].total).alias("total"), F.lit(of(t)[0].keys).alias("keys"),
        F.array(*(F.struct(F.lit(p.place).alias("place"), F.lit(p.word).alias("word"), F.lit(p.weight).alias("weight"), F.lit(p.key).alias("key")) for p in of(t))).alias("words"),
    ) for t in names))
    hits = F.filter(F.transform("w", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(list(by_word)))
    starts = F.flatten(F.transform(hits, lambda h: F.transform(F.element_at(index, h["w"]), lambda a: F.struct(a["t"].alias("t"), (h["i"] - a["place"]).alias("start")))))
    starts = F.filter(starts, lambda c: c["start"] >= 0)
    zero = F.struct(F.lit(0).alias("got"), F.lit(0).alias("n"), F.lit(0).alias("key_n"))

    def probed(c: Column) -> Column:
        def add(s: Column, p: Column) -> Column:
            there = F.get(F.col("w"), c["start"] + p["place"]).eqNullSafe(p["word"]).cast("int")
            return F.struct((s["got"] + there * p["weight"]).alias("got"), (s["n"] + there).alias("n"), (s["key_n"] + there * p["key"].cast("int")).alias("key_n"))

        phrase = F.get(phrases, c["t"])
        return F.struct(phrase["template"].alias("template"), phrase["label"].alias("label"), phrase["base"].alias("base"), phrase["len"].alias("len"), phrase["total"].alias("total"), phrase["keys"].alias("keys"), c["start"].alias("start"), F.aggregate(phrase["words"], zero, add).alias("s"))

    whole = lambda m: F.when(m["base"], m["s"]["n"] == m["len"]).otherwise((m["s"]["key_n"] == m["keys"]) & (100 * m["s"]["got"] >= MIN_SCORE * m["total"]))
    places = F.transform(F.filter(F.transform(starts, probed), whole), lambda m: F.struct(m["template"].alias("template"), m["label"].alias("label"), m["base"].alias("base"), m["start"].alias("start"), (m["s"]["got"] / m["total"]).alias("score")))
    return rows.select("id", "n_words", F.when(F.col("w").isNotNull(), places).alias("places"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, n_base, first_word, last_word, base_labels, labels, score), one row for each row of ``docs``.

    n_base counts all places of base phrases, first_word and last_word are their smallest and largest start (null
    if there are none), score is the best accepted match, 0 without one. Null and blank texts have no word.
    Repeated rows, also of one id, keep a row each. Long texts are read whole. A row's result does not depend on other
    rows. Empty table: empty result. Other columns are not carried, so their names cannot clash.
    """
    rows = licensed_places(docs, id_col, text_col)
    rows = rows.withColumn("places", F.coalesce("places", F.array().cast(rows.schema["places"].dataType))).withColumn("base", F.filter("places", lambda p: p["base"]))
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda p: p["label"]))), ",")
    starts = F.transform("base", lambda p: p["start"])
    return rows.select(
        F.col("id").alias(id_col), "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        labels("base").alias("base_labels"), labels("places").alias("labels"), F.coalesce(F.array_max(F.transform("places", lambda p: p["score"])), F.lit(0.0)).alias("score"),
    )


def op8(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_LITERALS = ",\n       ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x).lower() for x in p) + ")" for p in posting_list())
ORACLE = rf"""
WITH p(template, label, base, len, total, keys, place, key, word, weight) AS (
  VALUES {_LITERALS}),
d AS (SELECT row_number() OVER () AS rid, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM documents),
h AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM d),
f AS (SELECT rid, template, label, base, i - place AS start, sum(weight) / any_value(total) AS score
      FROM h JOIN p USING (word) GROUP BY rid, template, label, base, i - place
      HAVING CASE WHEN base THEN count(*) = any_value(len) ELSE count(*) FILTER (key) = any_value(keys) AND 100 * sum(weight) >= {MIN_SCORE} * any_value(total) END),
r AS (SELECT rid, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
      FROM f GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN r USING (rid)
"""
