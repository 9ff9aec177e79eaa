"""Counts, ids and id files against the public libraries, on odd texts."""

import base64
import os
import random
import struct
from hashlib import sha256
from zlib import crc32

import numpy as np
import public_tokenizers as P
import pytest

from quern.llm import bpe, pfor

os.environ["TOKENIZERS_PARALLELISM"] = "false"
ODD = ["", None, " ", "\n", "a" * 3000, " " * 5000, "<|endoftext|>", "x<|endoftext|> y<|endoftext|>", "it's we'll 12²Ⅷ", "\x1c\x85​　 漢字 😀 é", "word " * 20000]


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    signs = list("ab  \n\t\r\x1c\x85​ é漢😀'sdl09²_-!") + ["<|endoftext|>", "'re", "the ", "́"]
    return ODD + ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 80))) for _ in range(400)] + ["same"] * 3


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, i, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids string").repartition(5)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def test_count_equals_library(docs, texts, library):
    got = {r.doc_id: r for r in bpe.count_tokens(docs, P.path("byte_bpe_50k.json")).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 512)


def test_encode_equals_library_and_round_trips(docs, texts):
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in bpe.encode_ids(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, with_ids=True).collect()}
    for i, t in enumerate(texts):
        ids = np.array(own.encode_ordinary(t or ""), np.uint32).tobytes()
        assert bytes(got[i].ids) == ids and got[i].ids_sha256 == sha256(ids).hexdigest()
        assert got[i].decoded_sha256 == sha256((t or "").encode()).hexdigest()


@pytest.mark.parametrize("pattern", [P.PATTERN, pfor.PIECES])
def test_splitters_agree_on_all_signs(pattern):
    import regex

    rnd = random.Random(6)
    split, plain = bpe.Splitter(pattern), regex.compile(P.PATTERN)
    narrow, wide = [chr(c) for c in range(256)], [chr(rnd.choice((rnd.randrange(0x3000), rnd.randrange(0xE000, 0x11000)))) for _ in range(300)]
    for k in range(6000):
        text = "".join(rnd.choice(narrow if k % 2 else narrow + wide) + rnd.choice(("", "", " ", "'s", "\n ")) for _ in range(40))
        assert split.find(text) == plain.findall(text)


def test_perfect_hash_is_minimal_and_refuses_others():
    keys = [struct.pack("<I", k * 7919) for k in range(3000)]
    h = bpe.PerfectHash(keys)
    assert sorted(h.slot(k) for k in keys) == list(range(3000))
    assert all(h.slot(k + b"x") == -1 for k in keys)
    assert bpe.PerfectHash([]).slot(b"a") == -1


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
def test_blocks_round_trip(n):
    rnd = np.random.default_rng(n)
    for top in (1, 2, 50257, 2**32 - 1):
        ids = rnd.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
        ids[::17] = 2**32 - 1
        data = pfor.pack(ids)
        assert np.array_equal(pfor.unpack(data), ids)
        assert np.array_equal(pfor.unpack(data, 1, 3), ids[128:384])


def test_file_holds_every_document_in_order(docs, texts, library):
    segments = pfor.write_ids(docs, P.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in pfor.read_ids(segments, with_ids=True).collect()}
    start = 0
    for i, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        raw = np.array(ids, np.uint32).tobytes()
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), crc32(raw))
        assert bytes(got[i].ids) == raw
        start += len(ids)


def test_file_of_equal_keys_null_keys_and_no_rows(spark):
    rows = [(None, "a b"), (7, "x"), (7, "y z"), (7, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = pfor.ids_file(df, P.path("byte_bpe_50k.json")).collect()
    assert sorted(r.start for r in got)[0] == 0 and len(got) == 4
    assert got and max(r.start + r.n_tokens for r in got) == sum(r.n_tokens for r in got)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pfor.ids_file(empty, P.path("byte_bpe_50k.json")).count() == 0
    assert bpe.count_tokens(empty, P.path("byte_bpe_50k.json")).count() == 0


def test_null_and_repeated_keys_are_rows_of_their_own(spark):
    df = spark.createDataFrame([(None, "a b"), (None, None), (7, "x"), (7, "x"), (7, "y z")], "doc_id long, text string")
    counts = sorted((r.doc_id or 0, r.n_tokens) for r in bpe.count_tokens(df, P.path("byte_bpe_50k.json")).collect())
    ids = sorted((r.doc_id or 0, r.n_tokens) for r in bpe.encode_ids(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect())
    assert counts == ids == [(0, 0), (0, 2), (7, 1), (7, 1), (7, 2)]
    empty = df.limit(0)
    assert bpe.encode_ids(empty, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
