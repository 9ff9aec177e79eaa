"""Classes of near-duplicates against a comparison of every pair."""

import random

import numpy as np
import pytest

from quern.llm import neardup as nd


def plain_share(a, b):
    """Longest common subsequence of two label lists by the full table, over what either has."""
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
    k = int(table[-1, -1])
    return k / (len(a) + len(b) - k) if k else 0.0


def test_alignment_equals_the_full_table():
    rnd = random.Random(3)
    seen = quick = 0
    for _ in range(600):
        vocabulary = "abcdefgh" if rnd.random() < 0.3 else [f"w{k}" for k in range(60)]
        words = [rnd.choice(vocabulary) for _ in range(rnd.randint(1, 50))]
        other = list(words)
        for _ in range(rnd.randint(0, 6)):
            k = rnd.randrange(len(other) or 1)
            other[k : k + rnd.randint(0, 1)] = [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 2))]
        a, b = (nd.word_numbers(" ".join(w)) for w in (words, other))
        exact = plain_share(a.tolist(), b.tolist())
        bound = nd.run_share(len(a), len(b), nd.labelled_shingles(a), nd.labelled_shingles(b))
        assert bound <= exact + 1e-9
        assert nd.similar(a, b) == (exact >= nd.SIMILAR) == (nd.aligned_share(a, b) >= nd.SIMILAR)
        if exact >= nd.SIMILAR:
            assert abs(nd.aligned_share(a, b) - exact) < 1e-9
        seen += exact >= nd.SIMILAR
        quick += bound >= nd.SIMILAR
    assert seen > 200 and quick > 100


def test_sketches_follow_the_order_of_the_text():
    words = np.arange(400, dtype=np.uint32)
    ab, ba = (nd.labelled_shingles(np.concatenate(p)) for p in ((words[:200], words[200:]), (words[200:], words[:200])))
    same = sum(x == y for x, y in zip(nd.order_sketches(ab), nd.order_sketches(ba)))
    assert same < nd.SKETCHES  # nearly the same set, in another order
    assert nd.order_sketches(ab) == nd.order_sketches(ab.copy()) and nd.order_sketches(np.empty(0, np.uint64)) == []


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(9)
    text = lambda n: [f"w{rnd.randint(0, 5000)}" for _ in range(n)]
    out = []
    for _ in range(40):  # families of copies, each edited from the one before or from the first
        base = last = text(rnd.randint(30, 300))
        for _ in range(rnd.randint(1, 6)):
            last = list(rnd.choice((base, last)))
            for _ in range(rnd.randint(0, 1 + len(last) // 40)):
                last[rnd.randrange(len(last))] = "new"
            out.append(" ".join(last))
    hub = text(150)  # one large family of exact and near copies
    for k in range(150):
        w = list(hub)
        if k % 3:
            w[rnd.randrange(150)] = f"x{k}"
        out.append(" ".join(w) if k % 2 else " ".join(w).upper() + "!")
    out += [" ".join(text(50)) for _ in range(100)]
    return out + ["", None, "", "!!", "??", "one two", "One, two", "one three", "long " * 30_000]


def test_classes_against_every_pair(spark, texts):
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in enumerate(texts)] + [(None, "x", 1, "k")], "doc_id long, text string, id int, keys string").repartition(4)
    rows = nd.near_duplicates(df).collect()
    assert len(rows) == len(texts) + 1 and [r.class_id for r in rows if r.doc_id is None] == [None]
    got = {r.doc_id: r.class_id for r in rows if r.doc_id is not None}
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    words = [nd.word_numbers(t or "") for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            same = (texts[i] or "") == (texts[j] or "")
            if same or nd.similar(words[i], words[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert got == {i: find(i) for i in range(len(texts))}


def test_one_of_each_class_stays(spark, texts):
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)] + [(3, texts[3], "s"), (None, "x", "s"), (None, "x", "s")], "doc_id long, text string, class_id string")
    kept = nd.keep_one(df)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == df.columns and ids.count(None) == 2
    classes = {r.class_id for r in nd.near_duplicates(df).collect() if r.doc_id is not None}
    assert sorted(i for i in ids if i is not None) == sorted(classes)
    assert nd.near_duplicates(df.limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(200, 100), (200, 300)], "a long, b long")
    got = {r.node: r.label for r in nd.components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100, 300: 100}


def test_a_large_bucket_of_many_classes_loses_no_pair(spark, monkeypatch):
    monkeypatch.setattr(nd, "PART", 32)  # so that the bucket is dealt into many parts
    rnd = random.Random(4)
    template = [f"t{k}" for k in range(60)]
    own = [[f"d{i}x{k}" for k in range(60)] for i in range(300)]
    texts = [" ".join(template + w) for w in own] + [" ".join(template + w[:50] + [f"e{i}"] + w[51:]) for i, w in enumerate(own)]
    ids = list(range(600))
    rnd.shuffle(ids)  # the two of a pair lie anywhere
    # all of other classes under one key; under the other, half of one class
    members = spark.createDataFrame([(1, i, i) for i in ids] + [(2, i, i if n % 2 else -1) for n, i in enumerate(ids)], "key long, id long, label long")
    words = spark.createDataFrame([(ids[i], nd.word_numbers(t).tobytes()) for i, t in enumerate(texts)], "id long, words binary")
    got = {tuple(sorted((r.a, r.b))) for r in nd._within_buckets(members, words).collect()}
    assert got == {tuple(sorted((ids[i], ids[i + 300]))) for i in range(300)}


def test_near_copies_whose_buckets_all_have_a_lesser_member(spark):
    """Two texts that agree on two sketches only, and for each of these a lesser text that agrees on it and is like neither."""
    rnd = random.Random(1)
    while True:
        base = [f"w{rnd.randint(0, 10**6)}" for _ in range(200)]
        edited = list(base)
        for k in rnd.sample(range(200), 12):
            edited[k] = "new"
        one, two = (nd.labelled_shingles(nd.word_numbers(" ".join(w))) for w in (base, edited))
        agreed = [j for j, (x, y) in enumerate(zip(nd.order_sketches(one), nd.order_sketches(two))) if x == y]
        if len(agreed) == 2:
            break
    lesser = []
    for j in agreed:
        values = (one ^ nd._SEEDS[0, j]) * nd._SEEDS[1, j]
        picked = np.sort(np.argsort(values ^ values >> np.uint64(32))[: nd.DRAWS])
        lesser.append(" ".join(" ".join(base[k : k + nd.SHINGLE]) for k in picked))
        own = nd.labelled_shingles(nd.word_numbers(lesser[-1]))
        assert nd.order_sketches(own)[j] == nd.order_sketches(one)[j]
        assert not nd.similar(nd.word_numbers(lesser[-1]), nd.word_numbers(" ".join(base)))
    texts = [*lesser, " ".join(base), " ".join(edited)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in nd.near_duplicates(df).collect()} == {0: 0, 1: 1, 2: 2, 3: 2}


def test_edited_copies_share_a_class(spark):
    """In the smallest but one of the given tables, each two texts of which a tenth of the words or fewer is edited share a class."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    words = {r.doc_id: nd.word_numbers(r.text or "") for r in docs.collect()}
    found = {r.doc_id: r.class_id for r in nd.near_duplicates(docs).collect()}
    ids = sorted(words)
    common = nd.shared_labels([nd.labelled_words(words[i]) for i in ids])
    sizes = np.array([len(words[i]) for i in ids])
    close = np.argwhere(np.triu((common >= 0.9 * np.maximum(sizes[:, None], sizes[None, :])) & (sizes[:, None] > 0), 1))
    tested = missed = 0
    for i, j in close.tolist():
        a, b = words[ids[i]], words[ids[j]]
        k = nd.aligned_share(a, b, 0.5)
        paired = k * (len(a) + len(b)) / (1 + k)
        if paired >= 0.9 * max(len(a), len(b)):
            tested += 1
            missed += found[ids[i]] != found[ids[j]]
    assert tested > 80 and missed == 0
