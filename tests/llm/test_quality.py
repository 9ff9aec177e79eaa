"""Held-out accuracy of the compression classifier, and its defined results on odd rows."""

import random
import zlib

import pytest

from quern.llm import quality


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(4)
    words = ["the", "river", "stone", "walked", "under", "quiet", "morning", "light", "house", "told", "story", "green", "water", "and", "of"]

    def good():
        return " ".join((s := [rnd.choice(words) for _ in range(rnd.randint(4, 12))])[0].capitalize() + " " + " ".join(s[1:]) + "." for _ in range(rnd.randint(2, 20)))

    def bad():
        kind = rnd.randrange(3)
        w = [rnd.choice(words) for _ in range(rnd.randint(10, 120))]
        return " | ".join(w) if kind == 0 else "!! ".join(x.upper() for x in w) if kind == 1 else " ".join(f"{w[0]}{rnd.choice('$#&')}" for _ in w)

    rows = [(i, good() if i % 4 else bad(), int(i % 4 > 0)) for i in range(1200)]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows] + [(5000, None, 0.1), (5001, "", 0.1), (None, "x", 0.1)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(7, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    return docs.repartition(4), labels, {i: q for i, _, q in rows}


def test_held_out_accuracy(data):
    docs, labels, truth = data
    rows = quality.score_quality(docs, quality.fit(docs, labels)).collect()
    assert len(rows) == 1203 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows if r.doc_id is not None)
    tested = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(tested) > 300 and sum(r.predicted == truth[r.doc_id] for r in tested) / len(tested) > 0.97
    assert len({r.score for r in rows if r.doc_id in (5000, 5001)}) == 1


def test_labels_of_held_out_rows_change_nothing(data):
    docs, labels, _ = data
    other = labels.withColumn("quality", quality.F.when(quality.held_out(quality.F.col("doc_id")), 1 - quality.F.col("quality")).otherwise(quality.F.col("quality")))
    assert quality.fit(docs, labels).weights == quality.fit(docs, other).weights


def test_without_labels_every_text_scores_a_half(data):
    docs, labels, _ = data
    rows = quality.score_quality(docs.limit(5), quality.fit(docs, labels.limit(0))).collect()
    assert {(r.score, r.predicted) for r in rows} == {(0.5, 1)}
    assert quality.score_quality(docs.limit(0), quality.Model()).count() == 0


def test_filter_keeps_columns(data):
    docs, labels, _ = data
    kept = quality.keep_good(docs, quality.fit(docs, labels))
    assert kept.columns == docs.columns and 850 < kept.count() < 950


def test_scores_against_the_library(data):
    """Every score from plain calls of the compressor, on null, empty, repeated and very long texts too."""
    import math

    import zstandard

    docs, labels, _ = data
    spark = docs.sparkSession
    model = quality.fit(docs, labels)
    odd = spark.createDataFrame([(9000, "word and light. " * 300_000, 0.0), (None, None, 0.0), (9001, "\0", 0.0), (9001, "\0", 0.0)], docs.schema)
    rows = quality.score_quality(docs.unionByName(odd), model).collect()
    by_key = {r.doc_id: r.score for r in rows}
    assert len(rows) == 1207 and [r.held_out for r in rows if r.doc_id is None] == [False, False]

    def size(data, name):
        known = {"dict_data": zstandard.ZstdCompressionDict(model.dictionaries[name])} if name else {}
        return len(zstandard.ZstdCompressor(level=quality.LEVEL, write_checksum=False, write_content_size=False, **known).compress(data))

    for r in docs.where("doc_id % 40 = 0 or doc_id >= 5000").unionByName(odd).collect():
        if r.doc_id is None:
            continue
        z, plain = model.weights[0], (r.text or "").encode()
        for k, (view, data_) in enumerate((("plain", plain), ("shape", quality.shape(plain)))):
            n, g, b = size(data_, ""), size(data_, f"{view}-good"), size(data_, f"{view}-bad")
            size_ = max(1, len(data_))
            saved = (size_ - n) / size_
            for w, x in zip(model.weights[1 + 7 * k :], (10 * (g - b) / max(g, b), 10 * (g - b) / size_, 4 * (n - min(g, b)) / size_, 4 * (n - g) / n, 4 * (n - b) / n, 4 * saved, 16 * saved * saved)):
                z += w * x
        assert abs(by_key[r.doc_id] - 1 / (1 + math.exp(-z))) < 1e-3


def test_all_of_the_sample_is_used_and_its_bound_holds(data, monkeypatch):
    docs, labels, _ = data
    seen = []
    monkeypatch.setattr(quality, "dictionary", lambda samples, size: seen.append(samples) or b"x" * 8)
    quality.fit(docs, labels)
    assert [len(s) for s in seen[::2]] == [len(s) for s in seen[1::2]] and sum(len(s) for s in seen[::2]) > 350
    seen.clear()
    monkeypatch.setattr(quality, "DICTIONARY_BYTES", 20_000)
    quality.fit(docs, labels)
    assert all(15_000 < sum(map(len, s)) <= 20_000 for s in seen[::2])


def test_held_out_accuracy_of_the_given_table(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = quality.score_quality(docs, quality.fit(docs, labels)).where("held_out").join(labels, "doc_id").collect()
    good, bad = ([r.predicted == r.quality for r in rows if r.quality == q] for q in (1, 0))
    assert sum(good) / len(good) > 0.99 and sum(bad) / len(bad) > 0.96, (sum(good) / len(good), sum(bad) / len(bad))
