"""Near-duplicates by order MinHash and banded alignment (operator 10)."""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, map_texts, scratch, whole_texts, written

WORDS = re.compile(r"\w+").findall
#: Words of a shingle, and the aligned share of their words from which two texts are near-duplicates.
SHINGLE, SIMILAR = 5, 0.8
#: Sketches of a text and shingles in each. Two texts agree on a sketch with a chance of about the share of common shingles to
#: the power of DRAWS, so on none with one of 1 in 13,000 where a word in 25 differs, and of 1 in 127 where one in 16 does.
SKETCHES, DRAWS = 24, 3
#: Members of a part of a bucket (two parts are compared at once), and labels whose holders are counted together.
PART, COLUMNS = 512, 4096

_SEEDS = np.random.default_rng(20).integers(1, 2**63, (2, SKETCHES), np.uint64) | np.uint64(1)
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 2**64) for k in range(SHINGLE)], np.uint64)


def word_numbers(text: str) -> np.ndarray:
    """A 32-bit number for each word (a run of letters and digits, case-folded)."""
    words = WORDS(text.lower())
    return np.fromiter(map(crc32, map(str.encode, words)), np.uint32, len(words))


def labelled(h: np.ndarray) -> np.ndarray:
    """64-bit hashes told apart by how often each has occurred before, so that each is unique in its text."""
    h = h ^ h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    at = np.arange(len(h))
    first = np.r_[True, ranked[1:] != ranked[:-1]][: len(h)]
    occurrence = np.empty(len(h), np.uint64)
    occurrence[order] = at - np.maximum.accumulate(np.where(first, at, 0))
    h += occurrence * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(32)


def labelled_words(words: np.ndarray) -> np.ndarray:
    return labelled(words.astype(np.uint64) + np.uint64(1))


def labelled_shingles(words: np.ndarray) -> np.ndarray:
    """Shingles in text order, hashed with their occurrence number.

    A text of fewer words than a shingle is one shingle; one without words has none.
    """
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    size = min(n, SHINGLE)
    h = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        h += (words[k : n - size + 1 + k].astype(np.uint64) + np.uint64(1)) * _POWERS[k]
    if n < SHINGLE:
        h += np.uint64(n)
    return labelled(h)


def order_sketches(shingles: np.ndarray) -> list[int]:
    """For each sketch, the hash of the DRAWS shingles with the least values under its order, in the order of the text."""
    n = len(shingles)
    if not n:
        return []
    out = np.empty(SKETCHES, np.uint64)
    step = SKETCHES if n < 50_000 else 1
    rows = np.arange(step)
    for j in range(0, SKETCHES, step):
        if n > DRAWS:
            values = (shingles[None, :] ^ _SEEDS[0, j : j + step, None]) * _SEEDS[1, j : j + step, None]
            values ^= values >> np.uint64(32)
            picked = np.empty((step, DRAWS), np.int64)
            for k in range(DRAWS):  # the least, and it is out of the way of the next
                picked[:, k] = values.argmin(axis=1)
                values[rows, picked[:, k]] = np.uint64(2**64 - 1)
            picked.sort(axis=1)
        else:
            picked = np.broadcast_to(np.arange(n), (step, n))
        key = np.arange(j, j + step, dtype=np.uint64)
        for k in range(picked.shape[1]):
            key = (key ^ shingles[picked[:, k]]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(31)
        out[j : j + step] = key
    return out.view(np.int64).tolist()


def aligned_share(a: np.ndarray, b: np.ndarray, least: float = SIMILAR) -> float:
    """Words of two texts that their best alignment within a band pairs, over those that either has; 0 if surely below ``least``.

    At ``least`` or more only so many words are left unpaired, so all pairs lie within that distance of the diagonal. The
    table's rows are numbers with a bit for each word of ``b``; a bit that is off is a step up of the row.
    """
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < least * max(n, m):
        return 0.0
    band = int((n + m) * (1 - 2 * least / (1 + least))) + 1
    # words that both begin or end with are paired in some best alignment
    short = min(n, m)
    other = np.flatnonzero(a[:short] != b[:short])
    lead = int(other[0]) if len(other) else short
    other = np.flatnonzero(a[n - short + lead :] != b[m - short + lead :])
    tail = short - lead - 1 - int(other[-1]) if len(other) else short - lead
    a, b = a[lead : n - tail], b[lead : m - tail]
    places: dict[int, int] = {}
    for j, word in enumerate(b.tolist()):
        places[word] = places.get(word, 0) | 1 << j
    whole, window = (1 << len(b)) - 1, (1 << 2 * band + 1) - 1
    row = whole
    for i, word in enumerate(a.tolist()):
        if word in places:
            met = row & places[word] & (window << i - band if i > band else window >> band - i)
            row = (row + met | row - met) & whole
    paired = lead + tail + len(b) - row.bit_count()
    return paired / (n + m - paired)


def run_share(n: int, m: int, a: np.ndarray, b: np.ndarray) -> float:
    """A share that the alignment of two texts of n and m words reaches at least, from the shingles a and b of both.

    Common shingles that rise in both texts pair their words, each as many as lie before the next one begins.
    """
    _, at_a, at_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    order = np.argsort(at_a)
    at_a, at_b = at_a[order], at_b[order]
    rising = at_b == np.maximum.accumulate(at_b)  # some of them that rise; which ones only makes the bound better
    at_a, at_b = at_a[rising], at_b[rising]
    if not len(at_a):
        return 0.0
    paired = SHINGLE + int(np.minimum(np.minimum(np.diff(at_a), np.diff(at_b)), SHINGLE).sum()) if min(n, m) >= SHINGLE else n
    return paired / (n + m - paired)


def similar(a: np.ndarray, b: np.ndarray, of_a: np.ndarray | None = None, of_b: np.ndarray | None = None) -> bool:
    """Whether two texts, given as word numbers (and shingles), are near-duplicates: see ``aligned_share``.

    Most pairs are settled by a bound: from below by common shingles, from above by common words in any order.
    """
    n, m = len(a), len(b)
    if min(n, m) < SIMILAR * max(n, m):
        return False
    of_a = labelled_shingles(a) if of_a is None else of_a
    of_b = labelled_shingles(b) if of_b is None else of_b
    if run_share(n, m, of_a, of_b) >= SIMILAR:
        return True
    common = len(np.intersect1d(labelled_words(a), labelled_words(b), assume_unique=True))
    return common >= SIMILAR * (n + m - common) and aligned_share(a, b) >= SIMILAR


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the text's words, and its order sketches, for rows with a key."""

    def rows_of(columns):
        rows = []
        for key, text in zip(*columns):
            words = word_numbers(text)
            # texts without words are equal only if they are the same text
            digest = xxhash.xxh3_128_hexdigest(words.tobytes()) if len(words) else "-" + xxhash.xxh3_128_hexdigest(text.encode())
            rows.append((key, digest, order_sketches(labelled_shingles(words))))
        return rows

    return map_texts(whole_texts(docs).where("doc_id is not null"), rows_of, "doc_id long, digest string, keys array<long>", "doc_id", "text")


def _stars(edges: DataFrame) -> bool:
    """Whether every edge leads to the middle of a star: each node u has one v, and no v leads further."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 or (out = 1 and into = 1)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """node, label of each node of ``links`` (a, b): the least node that can be reached.

    Alternating large and small stars: each round ties every neighbour to the least one, until only stars are left, in
    rounds as the logarithm of the nodes. Minima are combined before the shuffle, so a hub's neighbours never meet in one place.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "edges")
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        edges = written(small.distinct(), "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) whose texts, given as (id, words), align well enough.

    Both sides grow with the corpus, so the joins are sort-merge ones at every size, which Spark splits where skewed.
    """

    def rows_of(columns):
        rows, known, words, shingles = [], None, None, None
        for a, b, x, y in zip(*columns):
            if known != a:  # pairs of one text often follow each other
                known, words = a, np.frombuffer(x, np.uint32)
                shingles = labelled_shingles(words)
            if similar(words, np.frombuffer(y, np.uint32), shingles):
                rows.append((a, b))
        return rows

    second = pairs.hint("merge").join(texts.select(F.col("id").alias("b"), F.col("words").alias("y")), "b")
    both = second.hint("merge").join(texts.select(F.col("id").alias("a"), F.col("words").alias("x")), "a")
    return map_rows(both.select("a", "b", "x", "y"), rows_of, "a long, b long")


def shared_labels(texts: list[np.ndarray]) -> np.ndarray:
    """How many labels (each unique in its text) each two of the texts have in common, wherever they stand."""
    n = len(texts)
    _, column, held = np.unique(np.concatenate(texts), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), [len(t) for t in texts])
    several = held > 1  # others are in no two texts
    keep = several[column]
    row, column = row[keep], (np.cumsum(several) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((n, n), np.float32)
    for c in range(0, int(several.sum()), COLUMNS):
        at = slice(*np.searchsorted(column, (c, c + COLUMNS)))
        x = np.zeros((n, COLUMNS), np.float32)
        x[row[at], column[at] - c] = 1
        shared += x @ x.T
    return shared


def links_among(ids: list[int], labels: list[int], texts: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of near-duplicates that join the classes of the given texts (word numbers) as far as any pair of them does.

    The common words of two texts bound their aligned share from above, so only pairs that have enough are aligned, and
    those only while their classes are apart.
    """
    sizes = np.array([len(t) for t in texts], np.float64)
    shared = shared_labels([labelled_words(t) for t in texts]).astype(np.float64)
    classes = np.unique(np.array(labels), return_inverse=True)[1]
    enough = shared >= SIMILAR * (sizes[:, None] + sizes[None, :] - shared) - 1e-6
    links = []
    for i, j in np.argwhere(np.triu(enough & (classes[:, None] != classes[None, :]), 1)).tolist():
        if classes[i] != classes[j] and similar(texts[i], texts[j]):
            links.append((ids[i], ids[j]))
            classes[classes == classes[j]] = classes[i]
    return links


def _within_buckets(labelled: DataFrame, words: DataFrame) -> DataFrame:
    """Links (a, b) between rows of ``labelled`` (key, id, label) of one key and different labels, of every such pair that is one.

    A key's rows are those of its largest class and the rest; both are dealt into parts, and each part of the rest meets
    every part. So rows of the largest class are never set against each other, and no task holds more than two parts.
    """
    counts = labelled.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("n"))
    parts = counts.where("top.n < n").select("key", F.col("top.label").alias("largest"), F.ceil(F.col("top.n") / PART).alias("tops"), F.ceil((F.col("n") - F.col("top.n")) / PART).alias("rests"))
    # a part's number: the rest's come first; a cell is two numbers, of which the lesser is one of the rest's
    top = F.col("label") == F.col("largest")
    part = F.when(top, F.col("rests") + F.pmod(F.xxhash64("id", "key"), "tops")).otherwise(F.pmod(F.xxhash64("id", "key"), "rests"))
    others = F.when(top, F.sequence(F.lit(0).cast("long"), F.col("rests") - 1)).otherwise(F.array_except(F.sequence(F.lit(0).cast("long"), F.col("rests") + F.col("tops") - 1), F.array("part")))
    dealt = labelled.hint("merge").join(parts, "key").withColumn("part", part)
    cells = dealt.select("key", "id", "label", "part", F.explode(others).alias("other")).select("key", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "id", "label")

    def linked(cell):
        import pyarrow as pa

        ids, labels, held = (cell.column(c).to_pylist() for c in ("id", "label", "words"))
        links = links_among(ids, labels, [np.frombuffer(w, np.uint32) for w in held]) if len(set(labels)) > 1 else []
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return cells.hint("merge").join(words, "id").groupBy("key", "x", "y").applyInArrow(linked, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id of every document: documents linked by near-duplicate texts share a class, named by its least key.

    Two texts are near-duplicates if a banded alignment pairs SIMILAR of the words that either has (see ``aligned_share``),
    so also where every edited word breaks five shingles. Texts with the same words are one representative from the start.
    Representatives that share an order sketch of five-word shingles meet in a bucket. First each is compared with the least
    member of its buckets. Then, in each bucket whose other members are still of several classes, every two of different
    classes are compared: their common words are counted, and where these are enough the two are aligned. So all pairs that
    share a sketch are settled, each by its own test or by sharing a class. Nothing but minima and counts is gathered for a
    whole bucket, so one of any size is spread over tasks; its comparisons grow with its members times those outside its
    largest class.

    Null texts are empty; texts without words are near-duplicates only of the same text. Repeated rows each give a row, also
    with the same key and different texts, where classes may be joined through the key. Rows with a null key get a null
    class and are not compared. Extra columns are ignored; an empty table gives no rows.
    """
    with scratch():
        sketched = written(sketch(docs), "sketches")
        same = sketched.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("keys").alias("keys"))
        reps = written(same, "representatives")
        spread = reps.select("id", F.explode("keys").alias("key"))
        shared = spread.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least <> most")
        members = written(spread.join(shared.drop("most"), "key"), "members")

        texts = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")).join(members.select("id").distinct().hint("merge"), "id", "left_semi")
        numbered = map_texts(texts, lambda c: [(k, word_numbers(t).tobytes()) for k, t in zip(*c)], "id long, words binary", "id", "text")
        words = written(numbered, "words")

        stars = written(members.where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct(), "stars")
        links = written(verify(stars, words), "links")

        classes = components(links)
        others = members.where("id <> least")  # the least was compared with all
        labels = others.join(classes, others.id == classes.node, "left").select("key", "id", F.coalesce("label", "id").alias("label"))
        more = written(_within_buckets(labels, words.select("id", "words")), "links")
        if not more.isEmpty():
            classes = components(links.unionByName(more))
        named = reps.join(classes, reps.id == classes.node, "left").select("digest", F.coalesce("label", "id").alias("class_id"))
        keyed = sketched.select("doc_id", "digest").join(named, "digest").select("doc_id", "class_id")
        found = written(keyed, "classes", keep=1)
    return found.unionByName(docs.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id")))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class of near-duplicates, the one with the least key; rows with a null key stay.

    Of several rows with one key the one whose text has the least hash stays, so the result is the same at every run. Null,
    empty and repeated texts are as in ``near_duplicates``; an empty table stays empty; all columns, whatever their names, are kept.
    """
    kept = near_duplicates(docs).where("doc_id = class_id").select("doc_id").distinct()
    row = F.min_by(F.struct(*docs.columns), F.xxhash64(F.coalesce("text", F.lit("")))).alias("row")
    one = docs.join(kept.hint("merge"), "doc_id", "left_semi").groupBy("doc_id").agg(row)
    return one.select("row.*").unionByName(docs.where("doc_id is null"))
