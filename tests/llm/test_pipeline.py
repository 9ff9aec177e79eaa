"""The pipeline's stages against the operators' brute-force meaning, on the smallest tables."""

import hashlib

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline as cp
from quern.llm import decontaminate, neardup, pii, quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in cp.STAGES:
        out.append(cp.written(stage(spark, out[-1], SF), name))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_keep_the_columns_of_documents(steps):
    assert all(d.columns == steps[0].columns for d in steps[1:5])


def test_near_duplicate_stage(steps):
    before, after = texts(steps[1]), texts(steps[2])
    s = {i: neardup.word_numbers(t) for i, t in before.items()}
    ids = sorted(before)
    close = {(i, j) for k, i in enumerate(ids) for j in ids[:k] if neardup.similar(s[i], s[j])}
    assert not any(i in after and j in after for i, j in close)
    touched = {i for pair in close for i in pair}
    assert set(before) - touched <= set(after)


def test_decontamination_stage(spark, steps):
    items = [decontaminate.words_of(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = texts(steps[2]), texts(steps[3])
    for i, t in before.items():
        words = decontaminate.words_of(t)
        known = {}
        number = lambda ws: np.array([known.setdefault(w, len(known)) for w in ws])
        b = number(words)
        bad = any(len(x) >= decontaminate.WHOLE and decontaminate.local_score(number(x), b)[0] >= decontaminate.COPY * decontaminate.MATCH * len(x) for x in items)
        assert (i in after) == (not bad)


def test_redaction_and_encoding(steps):
    before, after = texts(steps[3]), texts(steps[4])
    assert after == {i: pii.redact(t) for i, t in before.items()}
    assert {r.doc_id: r.n_chars for r in steps[4].collect()} == {i: len(t) for i, t in after.items()}
    got = {r.doc_id: r.decoded_sha256 for r in steps[5].collect()}
    assert got == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in after.items()}


def test_quality_stage_keeps_clean_documents(spark, steps):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = set(texts(steps[1]))
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in good) / len(good) > 0.9


def _odd(spark, folder, rows):
    kinds = "doc_id long, text string, lang string, source string, n_chars long, class_id string, score double, ids binary"
    spark.createDataFrame(rows, kinds).write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")


def test_run_over_odd_tables(spark, tmp_path):
    """Null keys and texts, empty and long texts, repeated rows, equal keys with different texts, clashing columns."""
    base = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, "c", 0.5, b"x") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    text = "A quiet morning by the river, and the stones were warm. Write to jane [at] example [dot] org about it.\n"
    odd = [(None, text), (None, None), (90_001, None), (90_002, ""), (90_003, text * 3000), (90_004, text), (90_004, text), (90_005, text + "Other."), (90_005, text)]
    rows = base + [(k, t, "en", "s", len(t or ""), None, None, None) for k, t in odd]
    _odd(spark, tmp_path, rows)
    docs, labels = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")
    model = quality.fit(docs, labels)
    good = [r for r in docs.collect() if quality.scores(model, pd.Series([r.text or ""]))[0] >= 0.5]
    got = cp.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} <= {r.doc_id for r in good} and len([r for r in got if r.doc_id is not None]) == len({r.doc_id for r in got} - {None})
    assert sum(r.doc_id is None for r in got) == sum(r.doc_id is None for r in good)
    assert all(hashlib.sha256(r.ids).hexdigest() == r.ids_sha256 and len(r.ids) == 4 * r.n_tokens for r in got)
    texts = {r.decoded_sha256 for r in got}
    assert hashlib.sha256((pii.redact(text)).encode()).hexdigest() in texts and hashlib.sha256(text.encode()).hexdigest() not in texts


def test_run_over_empty_tables(spark, tmp_path):
    _odd(spark, tmp_path, [])
    rows = cp.run(spark, str(tmp_path))
    assert rows.count() == 0 and "ids_sha256" in rows.columns


def test_tables_on_the_way_are_deleted(spark, tmp_path):
    import os

    from quern.sources.shared import shared_dir

    folder = f"{shared_dir(spark)}/quern".removeprefix("file:")
    _odd(spark, tmp_path, [(1, "some text here", "en", "s", 1, None, None, None)])
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    rows = cp.run(spark, str(tmp_path))
    assert len(set(os.listdir(folder)) - before) == 1 and rows.count() == 1
