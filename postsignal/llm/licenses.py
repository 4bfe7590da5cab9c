"""License scan by a positional index of rare licence words, in DataFrame functions only.

Templates are word sequences. Every text gives the places of all template words once; how many
documents hold each word gives its rarity. Of each template the rarest words of its mandatory phrase
are looked up in the document's places; places that agree on where the template would begin are
candidates, where the mandatory phrase must then stand word for word. The share of the whole
template that stands there as well is its score.

A word is ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` once A-Z are lower-cased. Null or empty text: no
words, no labels, score 0. Repeated rows: all returned. Empty table: no rows. Other columns are left
out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

# The phrases to be found at all their places, and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Well-known sentences of licences as (label, mandatory phrase, words around it).
TEMPLATES = [
    ("gpl", "terms of the gnu general public license", "redistribute it and or modify it under the | as published by the free software foundation"),
    ("lgpl", "gnu lesser general public license", "under the terms of the | as published by the free software foundation"),
    ("agpl", "gnu affero general public license", "under the terms of the | as published by the free software foundation"),
    ("apache-2.0", "apache license version 2 0", "licensed under the | the license you may not use this file except in compliance with the license"),
    ("mit", "permission is hereby granted free of charge", "| to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms", "| with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "mozilla public license", "this source code form is subject to the terms of the | v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software", "| for any purpose with or without fee is hereby granted"),
    ("cc-by", "creative commons attribution", "licensed under the | 4 0 international license"),
]

RARE = 2
_PLACE = 1 << 10  # a place is stored as 1024 * word number + number of the vocabulary word


def _templates() -> list[tuple[str, list[str], list[str], list[str], bool]]:
    out = [(label, [], phrase.split(), [], True) for phrase, label in BASE.items()]
    for label, phrase, around in TEMPLATES:
        before, after = around.split("|")
        out.append((label, before.split(), phrase.split(), after.split(), False))
    return out


VOCABULARY = sorted({w for _, a, b, c, _ in _templates() for w in a + b + c})


def places(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_words, places)``: the word count and all places of template words, in one pass."""
    # The only two letters outside ASCII whose lower case has an ASCII letter.
    text = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("\u212a"), F.lit("\u00e7")), F.lit("\u0130"), F.lit("\u00e7"))
    parts = F.split(F.lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    empty_first = F.when(F.get("parts", F.lit(0)) == "", 1).otherwise(0)
    empty_last = F.when((F.size("parts") > 1) & (F.element_at("parts", -1) == ""), 1).otherwise(0)
    words = F.array(*[F.lit(w) for w in VOCABULARY])
    found = F.transform(
        "parts",
        lambda w, i: F.when(
            w.isin(VOCABULARY), (i - F.col("lead")).cast("long") * _PLACE + F.array_position(words, w)
        ).otherwise(F.lit(-1).cast("long")),
    )
    return (
        docs.select("doc_id", parts.alias("parts"))
        .withColumn("lead", empty_first)
        .select(
            "doc_id",
            (F.size("parts") - F.col("lead") - empty_last).cast("long").alias("n_words"),
            F.array_remove(found, -1).alias("places"),
        )
    )


def frequencies(placed: DataFrame) -> dict[str, int]:
    """Documents that hold each template word; one row per word of the fixed vocabulary."""
    word = F.explode(F.array_distinct(F.transform("places", lambda p: p % _PLACE))).alias("word")
    rows = placed.select(word).groupBy("word").count().collect()
    return {VOCABULARY[r["word"] - 1]: r["count"] for r in rows}


def _number(word: str) -> int:
    return VOCABULARY.index(word) + 1


def _begins_by(word: str, place: int) -> Column:
    """Where a sequence begins that has ``word`` at ``place``, for each place of the word."""
    mine = F.filter("places", lambda p: p % _PLACE == _number(word))
    return F.transform(mine, lambda p: F.shiftright(p, 10) - place)


def _begins(phrase: list[str], df: dict[str, int]) -> Column:
    """Where ``phrase`` stands: begins on which its rarest words agree, then every word is verified."""
    rarest = sorted(range(len(phrase)), key=lambda i: (df.get(phrase[i], 0), i))[:RARE]
    agreed = None
    for i in rarest:
        begin = _begins_by(phrase[i], i)
        agreed = begin if agreed is None else F.array_intersect(agreed, begin)
    rest = [i for i in range(len(phrase)) if i not in rarest]
    if not rest:
        return agreed

    def stands(b: Column) -> Column:
        ok = F.lit(True)
        for i in rest:
            ok = ok & F.array_contains("places", (b + i) * _PLACE + _number(phrase[i]))
        return ok

    return F.filter(agreed, stands)


def _coverage(begins: Column, before: list[str], phrase: list[str], after: list[str]) -> Column:
    """Best share of the template's words that stand around one of ``begins``."""
    around = [(i - len(before), w) for i, w in enumerate(before)] + [(len(phrase) + i, w) for i, w in enumerate(after)]
    whole = len(around) + len(phrase)

    def share(b: Column) -> Column:
        n = F.lit(len(phrase))
        for i, w in around:
            n = n + F.when(F.array_contains("places", (b + i) * _PLACE + _number(w)), 1).otherwise(0)
        return n / F.lit(float(whole))

    return F.array_max(F.transform(begins, share))


def scan(docs: DataFrame) -> DataFrame:
    """Labels, places of the base phrases and a score for each row of ``docs``."""
    placed = written(places(docs))
    df = frequencies(placed)
    made, base, labels, scores = placed, [], [], []
    base_labels = []
    for k, (label, before, phrase, after, is_base) in enumerate(_templates()):
        name = f"begin_{k}"
        made = made.withColumn(name, _begins(phrase, df))
        hit = F.when(F.size(name) > 0, F.lit(label))
        labels.append(hit)
        scores.append(F.coalesce(_coverage(F.col(name), before, phrase, after), F.lit(0.0)))
        if is_base:
            base.append(F.col(name))
            base_labels.append(hit)
    begins = F.concat(*base)

    def joined(parts: list[Column]) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*parts)))), ",")

    return made.select(
        "doc_id",
        "n_words",
        F.size(begins).cast("long").alias("n_base"),
        F.array_min(begins).alias("first_word"),
        F.array_max(begins).alias("last_word"),
        joined(base_labels).alias("base_labels"),
        joined(labels).alias("labels"),
        F.greatest(*scores).alias("score"),
    )
