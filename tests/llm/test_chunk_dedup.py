"""Groups of equal texts, forced collisions of chunk keys, and odd rows."""

import hashlib
import random
import re

import pytest

from postsignal.llm import chunk_dedup


def by_hand(rows):
    groups = {}
    for i, t in rows:
        bare = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        groups.setdefault(bare, []).append((-len(t or ""), i))
    out = {}
    for bare, members in groups.items():
        for n, i in members:
            keep = min(members)[1]
            out[i] = (keep, len(members), i == keep, hashlib.sha256(bare.encode()).hexdigest())
    return out


def found(docs, bits=128):
    rows = chunk_dedup.groups(docs, bits).collect()
    return {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in rows}


@pytest.mark.parametrize("bits", [128, 1, 4])
def test_equals_grouping_by_text_whatever_keys_collide(docs_of, bits):
    draw = random.Random(bits)
    word = lambda: "".join(draw.choice("abcdé") for _ in range(draw.randint(1, 7)))
    texts = [" ".join(word() for _ in range(draw.choice([0, 1, 3, 400, 2000]))) for _ in range(25)]
    rows = []
    for i in range(120):
        text = draw.choice(texts)
        if draw.random() < 0.4:
            text = text.replace(" ", draw.choice(["  ", "\n", "\t "]))
        if draw.random() < 0.2 and text:
            text = text[:-1] + "z"
        rows.append((i, text))
    assert found(docs_of(rows), bits) == by_hand(rows)


def test_whole_table(documents, texts):
    assert found(documents) == by_hand(texts.items())


def test_chunks_join_to_the_text_and_find_their_place_again():
    gear, draw = chunk_dedup._gear(), random.Random(5)
    text = bytes(draw.choice(b"abcdefgh") for _ in range(60_000))
    cut = chunk_dedup.chunks(text, gear)
    assert b"".join(cut) == text and max(map(len, cut)) <= chunk_dedup.MOST
    moved = chunk_dedup.chunks(b"new beginning" + text, gear)
    assert len(set(cut) & set(moved)) > 0.8 * len(cut)
    assert chunk_dedup.chunks(b"", gear) == []


def test_odd_rows(docs_of):
    rows = [(5, None), (2, ""), (3, " \n"), (7, "a b"), (7, "a b"), (None, "ab"), (1, "a b"), (9, "x" * 300_000)]
    got = chunk_dedup.groups(docs_of(rows)).collect()
    assert len(got) == len(rows)
    empty = [r for r in got if r["doc_id"] in (5, 2, 3)]
    assert {r["keep_id"] for r in empty} == {3} and {r["group_size"] for r in empty} == {3}
    same = [r for r in got if r["doc_id"] in (7, None, 1)]
    assert {r["keep_id"] for r in same} == {1} and {r["group_size"] for r in same} == {4}
    assert sum(r["kept"] for r in got) == 3
    twice = chunk_dedup.groups(docs_of([(7, "a b"), (7, "a b")])).collect()
    assert sorted(r["kept"] for r in twice) == [False, True]
    assert chunk_dedup.groups(docs_of([])).collect() == []


def test_deduplicated_keeps_one_row_and_all_columns(docs_of):
    rows = [(4, "a  b"), (3, "a b"), (4, "a  b"), (None, "c"), (None, "c"), (8, None), (9, "")]
    docs = docs_of(rows).withColumnsRenamed({"lang": "key_sha", "n_chars": "kept"})
    out = chunk_dedup.deduplicated(docs)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] or -1, r["text"]) for r in out.collect()) == [(-1, "c"), (4, "a  b"), (8, None)]
