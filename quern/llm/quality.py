"""Compression classifier of text quality (operator 9)."""

from __future__ import annotations

import math
import re
import uuid
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bpe import once
from .common import whole_texts

#: Bounds of what is learnt from. Dictionaries: labelled rows of each class, those with the lowest hash of their key, whole,
#: as long as their bytes together stay within the second number (rows of more bytes than the third are passed over).
#: Calibration: labelled rows, other ones.
DICTIONARY_ROWS, DICTIONARY_BYTES, ROW_BYTES, CALIBRATION_ROWS = 3000, 1 << 23, 1 << 14, 6000
#: Bytes of a dictionary of plain text, and of one of the text's shape.
PLAIN_BYTES, SHAPE_BYTES = 1 << 18, 1 << 16
LEVEL = 3

# bytes by kind: small letters, capitals (those of Latin-1 too, whose first byte is dropped) and digits
_CLASSES = bytes(97 if 97 <= b <= 122 or b > 158 else 65 if 65 <= b <= 90 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256))
_RUNS = [(re.compile(c + b"{2,}"), c) for c in (b"a", b"A", b"0")]


def shape(data: bytes) -> bytes:
    """The text with each run of small letters, capitals or digits as one sign: what is left is how it is written."""
    data = data.translate(_CLASSES, b"\xc3")
    for run, sign in _RUNS:
        data = run.sub(sign, data)
    return data


#: What of a text is compressed, and the bytes of the dictionaries for it.
VIEWS = {"plain": (bytes, PLAIN_BYTES), "shape": (shape, SHAPE_BYTES)}


def dictionary(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary trained on all samples; where they are too few for that, the samples one after another."""
    samples = [x for x in samples if x]
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"\n".join(samples)[-size:].ljust(8, b"\n")


class Sizes:
    """Compressed sizes of a text under the dictionaries of good and of bad text and under none, in each view."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.packers = {"": zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=False)}
        for name, data in dictionaries.items():
            known = zstandard.ZstdCompressionDict(data)
            known.precompute_compress(level=LEVEL)
            self.packers[name] = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=False, write_content_size=False)

    def features(self, text: str) -> list[float]:
        """Differences of sizes, each normalised: of good and bad, what a dictionary saves, and what compression saves without one."""
        plain = text.encode("utf-8")
        out = [1.0]
        for view, (seen, _) in VIEWS.items():
            data = seen(plain)
            none, good, bad = (len(self.packers[p].compress(data)) for p in ("", f"{view}-good", f"{view}-bad"))
            size = max(1, len(data))
            saved = (size - none) / size
            out += [10 * (good - bad) / max(good, bad), 10 * (good - bad) / size, 4 * (none - min(good, bad)) / size, 4 * (none - good) / none, 4 * (none - bad) / none]
            out += [4 * saved, 16 * saved * saved]
        return out


@dataclass
class Model:
    """Dictionaries and the weights of the calibrated score; without weights every text scores a half."""

    dictionaries: dict[str, bytes] = field(default_factory=dict)
    weights: list[float] | None = None
    name: str = field(default_factory=lambda: uuid.uuid4().hex)


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> list[float]:
    """Weights of a logistic score by Newton steps, halved until the loss falls; the ridge keeps them finite."""

    def loss(w):
        z = x @ w
        return np.logaddexp(0, z).sum() - y @ z + ridge / 2 * w @ w

    w = np.zeros(x.shape[1])
    now, before = loss(w), math.inf
    while before - now > 1e-7:
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        while loss(w + step) > now and np.abs(step).max() > 1e-9:
            step /= 2
        w = w + step
        now, before = loss(w), now
    return w.tolist()


def score_of(model: Model):
    """A column function: the score of a text column."""

    def column(df: DataFrame, text: Column) -> Column:
        sent = df.sparkSession.sparkContext.broadcast(model)  # bounded by the dictionaries' sizes

        @F.pandas_udf("double")
        def score(texts: pd.Series) -> pd.Series:
            return scores(sent.value, texts)

        return score(F.coalesce(text, F.lit("")))

    return column


def scores(m: Model, texts: pd.Series) -> pd.Series:
    """Scores of texts, between 0 and 1."""
    if m.weights is None:
        return pd.Series(np.full(len(texts), 0.5))
    sizes, w = once(("quality", m.name), lambda: (Sizes(m.dictionaries), np.array(m.weights)))
    x = np.array([sizes.features(t) for t in texts]).reshape(-1, len(w))
    return pd.Series(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))))


def held_out(key: Column) -> Column:
    """Rows that are never learnt from: those whose key, as text, has a checksum of 1 modulo 3."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from a bounded sample of labelled rows that are not held out.

    Two thirds of the labelled rows (by hash) may lend their texts to the dictionaries, the others calibrate, so the score is
    not fitted on what the dictionaries hold. Rows without key or label are left out; of a key's several labels or texts the
    lowest counts. Without rows of both classes in both parts, as with empty tables, the model scores every text a half.
    """
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.where(~held_out(F.col("doc_id"))).withColumn("h", F.xxhash64("doc_id", F.lit("quality")))
    lend, judge = known.where("pmod(h, 3) > 0"), known.where("pmod(h, 3) = 0")
    picked = [lend.where(F.col("quality") == q).orderBy("h").limit(DICTIONARY_ROWS) for q in (0, 1)]
    texts = docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).where("doc_id is not null")

    # the samples are bounded by rows, so they are small enough to broadcast whatever the input
    sample = F.broadcast(picked[0].union(picked[1]))
    # the lowest of a key's several texts counts; the running sums go over DICTIONARY_ROWS rows of a class at most
    lent = texts.join(sample, "doc_id").groupBy("doc_id").agg(F.min("quality").alias("q"), F.min("h").alias("h"), F.min("text").alias("x"))
    lent = lent.withColumn("n", F.octet_length("x")).where(F.col("n") <= ROW_BYTES)
    so_far = F.sum("n").over(Window.partitionBy("q").orderBy("h", "doc_id"))
    rows = lent.withColumn("sum", so_far).where(F.col("sum") <= DICTIONARY_BYTES).select("q", "h", "x").orderBy("h").collect()
    parts = {q: [r.x.encode("utf-8") for r in rows if r.q == q] for q in (0, 1)}
    if not parts[0] or not parts[1]:
        return Model()
    dictionaries = {}
    for q, label in ((0, "bad"), (1, "good")):
        for view, (seen, size) in VIEWS.items():
            dictionaries[f"{view}-{label}"] = dictionary([seen(x) for x in parts[q]], size)

    model = spark.sparkContext.broadcast(Model(dictionaries))

    @F.pandas_udf("array<double>")
    def features(column: pd.Series) -> pd.Series:
        sizes = once(("features", model.value.name), lambda: Sizes(model.value.dictionaries))
        return column.map(sizes.features)

    judged = F.broadcast(judge.orderBy("h").limit(CALIBRATION_ROWS).select("doc_id", "quality", "h"))
    rows = texts.join(judged, "doc_id").select("quality", "h", features("text").alias("x")).collect()
    y = np.array([r.quality for r in rows])
    if len(set(y.tolist())) < 2:
        return Model()
    rows.sort(key=lambda r: (r.h, r.x))
    weights = calibrate(np.array([r.x for r in rows]), np.array([r.quality for r in rows], float))
    return Model(dictionaries, weights)


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text by how much better one class's dictionary compresses it.

    The score is a logistic function of normalised differences of compressed sizes and of nothing else. Null texts count as empty and are scored; repeated rows are each scored, equal texts equally; a null key is not held
    out; extra columns are ignored; an empty table gives no rows.
    """
    texts = whole_texts(docs)
    scored = texts.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_of(model)(texts, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with all their columns.

    Each row is judged by its text alone, null as empty; null keys and repeated rows make no difference.
    """
    return docs.where(score_of(model)(docs, F.col("text")) >= 0.5)
