"""Base phrases against a plain search, templates, and odd rows."""

import re

from postsignal.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(text):
    words, begins, labels = WORD.findall((text or "").translate(LOWER)), [], set()
    for phrase, label in licenses.BASE.items():
        phrase = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(phrase)] == phrase:
                begins.append(i)
                labels.add(label)
    return len(words), len(begins), min(begins, default=None), max(begins, default=None), ",".join(sorted(labels))


def base(r):
    return r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]


def test_whole_table(documents, texts):
    got = licenses.scan(documents).collect()
    assert {r["doc_id"]: base(r) for r in got} == {i: plain(t) for i, t in texts.items()}
    assert all((r["score"] > 0) == (r["labels"] != "") and r["score"] <= 1 for r in got)


def test_templates_and_tricky_texts(docs_of):
    rows = [
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "This library: GNU Lesser General Public License.", "mit license mit license, MIT\nLICENSE!", "the mitü license", "cc-by CC BY 4.0",
        "Permission is hereby granted, free of charge, to any person obtaining a copy", "apache the license", "permission is hereby granted free of",
        "gnu general gnu general public license apache license", "MIT LICENSE \u212a", "éapache license", " cc by", "cc by ",
    ]
    got = {r["doc_id"]: r for r in licenses.scan(docs_of(list(enumerate(rows)))).collect()}
    assert {i: base(r) for i, r in got.items()} == {i: plain(t) for i, t in enumerate(rows)}
    assert [got[i]["labels"] for i in (0, 1, 5, 6, 7)] == ["apache,apache-2.0", "lgpl", "mit", "", ""]
    assert got[0]["score"] == 1.0 and 0.3 < got[5]["score"] < 1 and got[7]["score"] == 0.0


def test_odd_rows(docs_of):
    rows = [(1, None), (2, ""), (3, " .,"), (4, "mit license"), (4, "mit license"), (None, "mit license"), (7, "x " * 60_000 + "mit license")]
    got = licenses.scan(docs_of(rows).withColumnRenamed("lang", "places")).collect()
    assert sorted((r["doc_id"] or 0, *base(r)[:2]) for r in got) == [(0, 2, 1), (1, 0, 0), (2, 0, 0), (3, 0, 0), (4, 2, 1), (4, 2, 1), (7, 60_002, 1)]
    assert licenses.scan(docs_of([])).collect() == []
