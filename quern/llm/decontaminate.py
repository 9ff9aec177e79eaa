"""Benchmark decontamination by rare n-gram seeds and local alignment (operator 3)."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, whole_texts

WORDS = re.compile(r"\w+").findall
#: Alignment scores, share of an item's full score from which a passage counts as a copy, and words below which an item only
#: counts where it stands word for word.
MATCH, MISMATCH, GAP, COPY, WHOLE = 2, -1, -2, 0.5, 4
#: Characters of test items that one pass over the documents looks for (some 60 MB in a worker); more items take more passes.
BLOCK_CHARS = 10_000_000


def words_of(text: str | None) -> list[str]:
    return WORDS((text or "").lower())


def local_score(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Smith-Waterman: the best local score of two sequences of word numbers, and where in ``b`` its alignment ends.

    Rows are computed at once; gaps along a row are a running maximum, as a gap costs the same for each word.
    """
    steps = np.arange(len(b) + 1) * -GAP
    row, best, end = np.zeros(len(b) + 1, np.int64), 0, 0
    for word in a:
        now = np.maximum(row + GAP, 0)
        now[1:] = np.maximum(now[1:], row[:-1] + np.where(b == word, MATCH, MISMATCH))
        row = np.maximum.accumulate(now + steps) - steps
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
    return best, end


def alignment(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """The best local score of an item in a passage, and the words of the passage from where to where it reaches."""
    score, end = local_score(item, passage)
    back, length = local_score(item[::-1], passage[:end][::-1])
    return score, end - length if back == score else 0, end


def least_pairs(n: int) -> int:
    """Neighbouring words of an item of n words that any copy of it keeps side by side.

    An alignment that replaces x words, leaves out d (or, at the ends, f) and puts in i scores MATCH (n - x - d - f) - x - 2 d -
    2 i, so 3 x + 4 d + 2 i + 2 f is at most twice what may be missing of the n words; it keeps n - 1 - 2 x - 2 d - i - f pairs or
    more, which is least where all is spent on replaced words.
    """
    if n < WHOLE:
        return n - 1
    return max(1, math.ceil(n - 1 - 4 * n * (1 - COPY) / 3))


@dataclass
class Items:
    """A block of test items as word numbers. Its seeds are pairs of neighbouring words."""

    keys: list
    words: list[np.ndarray]
    vocabulary: dict[str, int]
    seeds: np.ndarray  # sorted codes
    own: list[np.ndarray]  # each item's seeds, as places in ``seeds``

    @classmethod
    def of(cls, rows: list[tuple]) -> Items:
        vocabulary: dict[str, int] = {}
        words = [np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(t)], np.int64) for _, t in rows]
        codes = [seed_codes(w, len(vocabulary) + 1) for w in words]
        seeds = np.unique(np.concatenate([np.empty(0, np.int64), *codes]))
        return cls([key for key, _ in rows], words, vocabulary, seeds, [np.searchsorted(seeds, c).astype(np.int32) for c in codes])

    def seeds_in(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word numbers of the texts one after another, where each text ends; and place, seed and text of each seed in them."""
        words = [words_of(t) for t in texts]
        flat = [w for ws in words for w in ws]
        numbers = np.fromiter(map(self.vocabulary.get, flat, repeat(0)), np.int64, len(flat))
        ends = np.cumsum([len(ws) for ws in words])
        codes = seed_codes(numbers, len(self.vocabulary) + 1)
        place = np.flatnonzero(codes)  # few places have known words only
        slot = np.searchsorted(self.seeds, codes[place])
        ok = slot < len(self.seeds)
        place, slot = place[ok], slot[ok]
        text = np.searchsorted(ends, place, side="right")
        ok = (self.seeds[slot] == codes[place]) & (place + 2 <= ends[text]) if len(place) else np.empty(0, bool)  # within one text
        return numbers, ends, place[ok], slot[ok], text[ok]


def seed_codes(w: np.ndarray, base: int) -> np.ndarray:
    """Exact codes of neighbouring word numbers; 0 where a word is not in the vocabulary."""
    if len(w) < 2:
        return np.empty(0, np.int64)
    return np.where((w[:-1] > 0) & (w[1:] > 0), w[:-1] * base + w[1:], 0)


def rare_seeds(items: Items, counts: np.ndarray) -> list[np.ndarray]:
    """For each item its rarest seeds, by documents that hold them: so many that each copy keeps one of them.

    A copy keeps ``least_pairs`` of an item's pairs, so it cannot avoid a set of pairs that leaves out fewer than these.
    """
    chosen = []
    for w, own in zip(items.words, items.own):
        seeds, times = np.unique(own, return_counts=True)
        order = np.lexsort((seeds, counts[seeds]))
        needed = len(own) - least_pairs(len(w)) + 1
        chosen.append(np.sort(seeds[order[: int(np.searchsorted(np.cumsum(times[order]), needed)) + 1]]) if len(own) else seeds)
    return chosen


def passages(places: np.ndarray, n: int, length: int) -> list[tuple[int, int]]:
    """Where an item of n words may be copied, given the places of its seeds in a text of ``length`` words.

    A copy reaches over 1.5 n words or fewer (more inserted ones cost more than is left), in which it has ``least_pairs`` seeds.
    """
    t, reach = least_pairs(n), n + int(n * (1 - COPY)) + 1
    if len(places) < t:
        return []
    full = np.flatnonzero(places[t - 1 :] - places[: len(places) - t + 1] <= reach)
    if not len(full):
        return []
    starts, ends = places[full] - reach, places[full + t - 1] + reach
    cuts = np.flatnonzero(starts[1:] > ends[:-1]) + 1
    return [(max(0, int(s[0])), min(length, int(e[-1]))) for s, e in zip(np.split(starts, cuts), np.split(ends, cuts))]


def find_copies(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, start_word, end_word, n_seeds: documents with a passage that copies a test item, edited or not.

    Documents are read twice for a block of items. First the documents that hold each seed (a pair of neighbouring words of an
    item) are counted. Then a text that holds one of an item's rare seeds has the item's seeds counted along it; where these
    are as dense as any copy has them the passage is aligned with the item (Smith-Waterman over words). A score of COPY of the
    item's full score or more is a copy: up to a third of the words replaced, in whatever pattern, or half of them left out
    at the ends. None is missed (see ``least_pairs``). The best passage of each (document, item) is returned.

    Words are runs of letters and digits, case-folded. Null and empty texts copy nothing; items of fewer than WHOLE words are
    found word for word, items of one word or none not at all; repeated documents are each searched, but a key is reported
    once; repeated items are each reported; null keys are kept; empty tables give no rows; extra columns are ignored. What is
    broadcast is one block of items, of bounded size whatever the corpus.
    """
    tests = benchmark.select(F.col("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    chars = tests.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(chars / BLOCK_CHARS))
    found = None
    for k in range(blocks):
        part = tests if blocks == 1 else tests.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(blocks)) == k)
        copies = _block_copies(whole_texts(docs), Items.of([(r.item_id, r.text) for r in part.collect()]), dict(tests.dtypes)["item_id"])
        found = copies if found is None else found.unionByName(copies)
    return found


def _block_copies(texts: DataFrame, items: Items, key_type: str) -> DataFrame:
    spark = texts.sparkSession
    sent = spark.sparkContext.broadcast(items)

    def held(columns):
        _, _, _, slot, text = sent.value.seeds_in(columns[1])
        seeds, counts = np.unique(np.unique(text * len(sent.value.seeds) + slot) % max(1, len(sent.value.seeds)), return_counts=True)
        return [(seeds.tolist(), counts.tolist())]

    sums = map_texts(texts, held, "seeds array<int>, counts array<long>", "doc_id", "text")
    counted = sums.select(F.explode(F.arrays_zip("seeds", "counts")).alias("z")).groupBy("z.seeds").agg(F.sum("z.counts").alias("n"))
    counts = np.zeros(len(items.seeds), np.int64)
    for r in counted.collect():  # one number for each seed of the block: as bounded as the block
        counts[r.seeds] = r.n
    chosen = rare_seeds(items, counts)
    # which items each seed is rare for: items by seed, and where each seed's begin
    of = np.concatenate([np.empty(0, np.int64), *chosen]).astype(np.int64)
    order = np.argsort(of, kind="stable")
    by_seed = np.repeat(np.arange(len(chosen)), [len(c) for c in chosen])[order]
    begins = np.searchsorted(of[order], np.arange(len(items.seeds) + 1))
    rare = spark.sparkContext.broadcast((by_seed, begins))

    def search(columns):
        it, (by_seed, begins) = sent.value, rare.value
        numbers, ends, place, slot, text = it.seeds_in(columns[1])
        sizes = begins[slot + 1] - begins[slot]
        hit = np.flatnonzero(sizes)
        if not len(hit):
            return []
        times = sizes[hit]
        at = np.repeat(begins[slot[hit]] - np.cumsum(times) + times, times) + np.arange(times.sum())
        pairs = np.unique(np.repeat(text[hit], times) * len(it.words) + by_seed[at])
        rows = []
        for d, item in zip((pairs // len(it.words)).tolist(), (pairs % len(it.words)).tolist()):
            here = slice(*np.searchsorted(text, (d, d + 1)))
            own = np.unique(it.own[item])
            mine = own[np.minimum(np.searchsorted(own, slot[here]), len(own) - 1)] == slot[here]
            w, begin = it.words[item], int(ends[d - 1]) if d else 0
            for start, end in passages(place[here][mine] - begin, len(w), int(ends[d]) - begin):
                score, first, last = alignment(w, numbers[begin + start : begin + end])
                share = score / (MATCH * len(w))
                if share >= (COPY if len(w) >= WHOLE else 1):
                    seeds = np.unique(slot[here][mine])
                    shared = sum(item in by_seed[begins[s] : begins[s + 1]] for s in seeds.tolist())
                    rows.append((columns[0][d], it.keys[item], share, start + first, start + last, shared))
        return rows

    schema = f"doc_id long, item_id {key_type}, score double, start_word int, end_word int, n_seeds int"
    aligned = map_texts(texts, search, schema, "doc_id", "text")
    best = F.max(F.struct("score", (-F.col("start_word")).alias("s"), "start_word", "end_word", "n_seeds")).alias("b")
    return aligned.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.score", "b.start_word", "b.end_word", "b.n_seeds")


def drop_copies(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no copy of a test item; rows without a key stay.

    Null and empty texts stay; of rows with one key none stays where one has a copy; an empty table stays empty, and without
    test items all rows stay.

    The keys found grow with the corpus, so the join is a sort-merge one at every size.
    """
    bad = find_copies(docs, benchmark).where("doc_id is not null").select(F.col("doc_id").alias("doc_id")).distinct()
    return docs.join(bad.hint("merge"), "doc_id", "left_anti").select(docs.columns)
