"""Copies of test items, whole and edited, against a plain alignment of every pair."""

import random

import numpy as np
import pytest

from quern.llm import decontaminate as d


def plain_score(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            s = d.MATCH if a[i] == b[j] else d.MISMATCH
            table[i + 1, j + 1] = max(0, table[i, j] + s, table[i, j + 1] + d.GAP, table[i + 1, j] + d.GAP)
    return int(table.max())


def test_local_score_equals_the_plain_table():
    rnd = np.random.default_rng(1)
    for _ in range(200):
        a, b = rnd.integers(0, 5, rnd.integers(0, 15)), rnd.integers(0, 5, rnd.integers(0, 15))
        assert d.local_score(a, b)[0] == plain_score(a, b)


@pytest.fixture(scope="module")
def tables(spark):
    rnd = random.Random(8)
    common = ["the", "of", "and", "to", "in"]
    word = lambda: rnd.choice(common) if rnd.random() < 0.4 else f"w{rnd.randint(0, 3000)}"
    text = lambda n: [word() for _ in range(n)]
    items = [text(rnd.randint(14, 50)) for _ in range(30)]
    docs, truth = [], set()
    for i in range(400):
        w = text(rnd.randint(5, 300))
        if i % 5 == 0:
            k = rnd.randrange(30)
            copy = list(items[k])
            for _ in range((0, 1, 3)[i // 5 % 3] * len(copy) // 20):  # none, a twentieth, three twentieths of the words edited
                copy[rnd.randrange(len(copy))] = "edited"
            at = rnd.randint(0, len(w))
            w[at:at] = [x.upper() for x in copy] if i % 10 else copy
            truth.add((i, k))
        docs.append((i, ", ".join(w) + "."))
    docs += [(900, None), (901, ""), (902, " ".join(items[0] * 60)), (903, " ".join(items[1])), (903, " ".join(items[1]))]
    bench = [(k, " ".join(w)) for k, w in enumerate(items)] + [(97, ""), (98, None), (99, "notaword")]
    return spark.createDataFrame([(i, t, 0, 0.0) for i, t in docs], "doc_id long, text string, item_id int, score double").repartition(4), spark.createDataFrame(bench, "item_id long, text string"), docs, bench, truth


def test_copies_against_every_pair(tables):
    docs, bench, raw, items, truth = tables
    got = {(r.doc_id, r.item_id): r for r in d.find_copies(docs, bench).collect()}
    expected = set()
    for i, t in raw[:400]:
        for k, x in items[:30]:
            a, b = d.words_of(x), d.words_of(t)
            names = {w: n for n, w in enumerate(dict.fromkeys(a + b))}
            if d.local_score(np.array([names[w] for w in a]), np.array([names[w] for w in b]))[0] >= d.COPY * d.MATCH * len(a):
                expected.add((i, k))
    assert truth <= expected
    assert {p for p in got if p[0] < 400} == expected
    assert (902, 0) in got and (903, 1) in got and got[903, 1].score == 1.0 and got[903, 1].start_word == 0


def test_blocks_of_items_give_the_same(tables, monkeypatch):
    docs, bench, *_ = tables
    rows = lambda: sorted((r.doc_id, r.item_id) for r in d.find_copies(docs, bench).collect())
    whole = rows()
    monkeypatch.setattr(d, "BLOCK_CHARS", 2000)
    assert rows() == whole


def test_empty_tables_and_filter(tables):
    docs, bench, *_ = tables
    assert d.find_copies(docs.limit(0), bench).count() == 0 and d.find_copies(docs, bench.limit(0)).count() == 0
    kept = d.drop_copies(docs, bench)
    assert kept.columns == docs.columns and kept.count() == 400 - 80 + 2


def _edited(rnd, item, kind):
    n, c = len(item), list(item)
    if kind == "every third word":
        at = rnd.randrange(3)
        c[at::3] = ["x"] * len(c[at::3])
    elif kind == "words put in":
        for _ in range(n // 2):
            c.insert(rnd.randrange(len(c)), "y")
    elif kind == "words left out":
        for _ in range(n // 4):
            c.pop(rnd.randrange(len(c)))
    elif kind == "one half":
        c = c[n // 2 :]
    else:
        for _ in range(n // 4):
            c[rnd.randrange(n)] = "x"
    return c


@pytest.mark.parametrize("kind", ["every third word", "words put in", "words left out", "one half", "any words"])
def test_no_copy_escapes_the_seeds(kind):
    """Whatever the pattern of the edits and whichever seeds are rare, what scores enough in the whole text is found there."""
    rnd = random.Random(kind)
    copies = 0
    for _ in range(300):
        item = [f"i{k}" if rnd.random() > 0.3 else rnd.choice("abc") for k in range(rnd.randint(d.WHOLE, 60))]
        text = [rnd.choice("abcdef") for _ in range(rnd.randint(0, 200))] + _edited(rnd, item, kind) + [rnd.choice("abcdef") for _ in range(rnd.randint(0, 200))]
        it = d.Items.of([(0, " ".join(item))])
        numbers, _, place, slot, _ = it.seeds_in([" ".join(text)])
        score = d.local_score(it.words[0], numbers)[0]
        if score >= d.COPY * d.MATCH * len(item):
            copies += 1
            assert score == max(d.alignment(it.words[0], numbers[a:b])[0] for a, b in d.passages(place, len(item), len(text)))
            assert np.isin(slot, d.rare_seeds(it, np.array([rnd.randint(0, 99) for _ in it.seeds]))[0]).any()
    assert copies > 100


def test_short_items_hot_words_and_odd_keys(spark):
    docs = [(1, "so we say hello world to all"), (2, "hello big world"), (3, "same " * 20_000), (4, "one"), (None, "say hello world"), (3, "same " * 20_000)]
    bench = [(1, "hello world"), (2, "one"), (3, " ".join(["same"] * 400)), (4, "Hello, world!"), (None, "we say hello world to"), (6, "a b c")]
    df, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in d.find_copies(df, items).collect()}
    assert set(got) == {(1, 1), (1, 4), (None, 1), (None, 4), (3, 3), (1, None), (None, None)}
    assert got[1, 1].score == 1.0 and (got[1, 1].start_word, got[1, 1].end_word) == (3, 5) and got[None, None].score == 0.6
    assert {r.doc_id for r in d.drop_copies(df, items).collect()} == {2, 4, None}


def test_passages_are_where_the_copy_stands(tables):
    docs, bench, raw, items, truth = tables
    words = {i: d.words_of(t) for i, t in raw[:400]}
    for r in d.find_copies(docs, bench).collect():
        if r.doc_id is not None and r.doc_id < 400 and r.score == 1.0:
            assert words[r.doc_id][r.start_word : r.end_word] == d.words_of(items[r.item_id][1])
