"""Byte-level byte-pair encoding: counting (operator 5), and encoding with decoding (operator 6)."""

from __future__ import annotations

import base64
import json
import re
from array import array
from hashlib import blake2b, sha256
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame

from .common import map_texts, whole_texts

#: Distinct pre-tokens whose result a Python worker keeps; further ones are computed anew each time.
MEMO = 500_000


class PairMerger:
    """Counts merges of a ``merges`` table (byte pairs by rank) with a heap over a linked list of symbols."""

    def __init__(self, model: dict):
        vocab = model["vocab"]
        self.pairs: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs.setdefault(vocab[a] << 20 | vocab[b], (rank, vocab[a + b]))
        self.first = [vocab[c] for c in byte_alphabet()]

    def count(self, data: bytes) -> int:
        """Symbols left of ``data``: as many as its bytes, less one for each merge."""
        n, pairs = len(data), self.pairs
        if n < 2:
            return n
        symbol = [self.first[b] for b in data]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [found[0] << 32 | i for i in range(n - 1) if (found := pairs.get(symbol[i] << 20 | symbol[i + 1]))]
        heapify(heap)
        merges = 0
        while heap:
            item = heappop(heap)
            i = item & 0xFFFFFFFF
            j = after[i]
            if symbol[i] < 0 or j >= n:
                continue
            found = pairs.get(symbol[i] << 20 | symbol[j])
            if not found or found[0] != item >> 32:
                continue  # one of the two has been merged with another since
            symbol[i], symbol[j] = found[1], -1
            merges += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if found := pairs.get(symbol[i] << 20 | symbol[k]):
                    heappush(heap, found[0] << 32 | i)
            h = before[i]
            if h >= 0 and (found := pairs.get(symbol[h] << 20 | symbol[i])):
                heappush(heap, found[0] << 32 | h)
        return n - merges


def byte_alphabet() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    shown = {b: chr(b) for b in kept}
    for k, b in enumerate(b for b in range(256) if b not in shown):
        shown[b] = chr(256 + k)
    return [shown[b] for b in range(256)]


def narrow_form(pattern: str) -> str:
    """``pattern`` for texts of the first 256 code points: classes written out, which the standard library matches faster."""
    import regex

    first = [chr(c) for c in range(256)]
    written = {name: "".join(f"\\x{ord(c):02x}" for c in first if regex.match(name, c)) for name in (r"\p{L}", r"\p{N}", r"\s")}
    inside = re.sub(r"\[\^?(?:\\s|\\p\{[LN]\})+\]", lambda m: re.sub(r"\\s|\\p\{[LN]\}", lambda c: written[c[0]], m[0]), pattern)
    for name, signs in written.items():
        inside = inside.replace(name, f"[{signs}]")
    return inside.replace(r"\S", f"[^{written[r'\s']}]")


class Splitter:
    """Cuts a text at the special strings and then into pre-tokens."""

    def __init__(self, pattern: str, special: list[str] = ()):  # type: ignore[assignment]
        import regex

        self.any = regex.compile(pattern).findall
        self.narrow = re.compile(narrow_form(pattern)).findall
        self.special = sorted(special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")").split if special else None

    def find(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.any(text)
        return self.narrow(text)

    def __call__(self, text: str) -> tuple[list[str], list[str]]:
        """Pre-tokens outside special strings, and the special strings met."""
        if self.cut is None or not any(s in text for s in self.special):
            return self.find(text), []
        parts = self.cut(text)
        return [t for p in parts[::2] for t in self.find(p)], parts[1::2]


class Memo(dict):
    """What ``make`` gives for a pre-token, kept for the first ``size`` short ones and made anew each time for the others."""

    def __init__(self, make, size: int = MEMO):
        self.make, self.size = make, size

    def __missing__(self, token: str):
        made = self.make(token)
        if len(self) < self.size and len(token) <= 64:
            self[token] = made
        return made


_made: dict = {}


def once(key: tuple, make):
    """``make()`` once for each key and Python worker."""
    if key not in _made:
        _made[key] = make()
    return _made[key]


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text, as the vocabulary's own library would count.

    ``vocabulary`` is the path of a byte-level BPE file of the tokenizers library. Pre-tokens are counted by popping the
    lowest-ranked adjacent pair from a heap and relinking its neighbours: the count is the number of bytes less the number
    of merges; identifiers are never made. Special strings inside a text count as one token each, as the library has it.

    Null and empty texts have 0 tokens; repeated rows are counted each; a null key stays null; extra columns are ignored.
    One long text is one unit of work, in time n log n and memory linear in its longest pre-token.
    """
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        model = spark.sparkContext.broadcast(f.read())

    def make():
        import public_tokenizers

        spec = json.loads(model.value)
        merger = PairMerger(spec["model"])
        split = Splitter(public_tokenizers.PATTERN, [x["content"] for x in spec["added_tokens"]])
        return split, Memo(lambda t: merger.count(t.encode("utf-8"))).__getitem__

    def rows_of(columns):
        split, count = once(("count", vocabulary), make)
        rows = []
        for key, text in zip(*columns):
            tokens, special = split(text)
            n = len(special) + sum(map(count, tokens))
            rows.append((key, len(text.encode("utf-8")), n, n > limit))
        return rows

    return map_texts(whole_texts(docs), rows_of, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", "doc_id", "text")


class PerfectHash:
    """A minimal perfect hash of byte strings: hash and displace, one slot for each key, keys kept to refuse others."""

    def __init__(self, keys: list[bytes], load: int = 4):
        n = len(keys)
        self.n, self.buckets = n, max(1, n // load)
        groups: list[list[tuple[bytes, int]]] = [[] for _ in range(self.buckets)]
        for k in keys:
            b, x = self._hashes(k)
            groups[b].append((k, x))
        self.shift = array("q", bytes(8 * self.buckets))
        self.keys: list[bytes | None] = [None] * n
        free = iter(range(n))
        for b in sorted(range(self.buckets), key=lambda b: -len(groups[b])):
            d = 0
            if len(groups[b]) == 1:  # the last ones take what is left: their slot itself is stored
                s = next(s for s in free if self.keys[s] is None)
                self.keys[s], self.shift[b] = groups[b][0][0], -1 - s
                continue
            while groups[b]:
                slots = {self._slot(x, d) for _, x in groups[b]}
                if len(slots) == len(groups[b]) and all(self.keys[s] is None for s in slots):
                    for k, x in groups[b]:
                        self.keys[self._slot(x, d)] = k
                    break
                d += 1
            self.shift[b] = d

    def _hashes(self, key: bytes) -> tuple[int, int]:
        h = int.from_bytes(blake2b(key, digest_size=16).digest(), "little")
        return (h >> 64) % self.buckets, h & 0xFFFFFFFFFFFFFFFF

    def _slot(self, x: int, d: int) -> int:
        """The slot of hash ``x`` under displacement ``d``; below 0, the displacement names the slot itself."""
        if d < 0:
            return -1 - d
        v = (x + d * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
        v = (v ^ v >> 32) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF
        return (v ^ v >> 32) % self.n

    def slot(self, key: bytes) -> int:
        """The key's slot, or -1 if it is none of the keys."""
        if not self.n:
            return -1
        b, x = self._hashes(key)
        s = self._slot(x, self.shift[b])
        return s if self.keys[s] == key else -1


class RankCodec:
    """Encodes by a rank file and decodes: a perfect hash for whole pre-tokens, a heap over linked bytes for the rest."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.whole = PerfectHash(list(ranks))
        self.rank_at = array("I", [ranks[k] for k in self.whole.keys])
        self.bytes_of = {r: b for b, r in ranks.items()}

    @classmethod
    def read(cls, lines: bytes) -> RankCodec:
        return cls({base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x)})

    def encode(self, piece: bytes) -> list[int]:
        slot = self.whole.slot(piece)
        if slot >= 0:
            return [self.rank_at[slot]]
        return self.merge(piece)

    def merge(self, piece: bytes) -> list[int]:
        n, ranks = len(piece), self.ranks
        after, before = list(range(1, n + 2)), list(range(-1, n))  # of the part that starts at a byte
        gone = bytearray(n + 1)
        heap = [r << 32 | i for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            item = heappop(heap)
            i = item & 0xFFFFFFFF
            j = after[i]
            if gone[i] or j >= n:
                continue
            end = after[j]
            if ranks.get(piece[i:end]) != item >> 32:
                continue
            gone[j] = 1
            after[i] = end
            if end < n:
                before[end] = i
                if (r := ranks.get(piece[i : after[end]])) is not None:
                    heappush(heap, r << 32 | i)
            h = before[i]
            if h >= 0 and (r := ranks.get(piece[h:end])) is not None:
                heappush(heap, r << 32 | h)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def encode_ids(docs: DataFrame, ranks: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text (and, if asked for, the ids as little-endian bytes).

    ``ranks`` is the path of a rank file, ``pattern`` cuts texts into pre-tokens. A pre-token that is in the vocabulary is
    found by the minimal perfect hash; another one is merged by a heap over its linked bytes. The ids are decoded again, and
    the digest of the decoded bytes is returned beside that of the ids.

    Null and empty texts give no ids; repeated rows are encoded each; a null key stays null; extra columns are ignored.
    """
    spark = docs.sparkSession
    with open(ranks, "rb") as f:
        made = spark.sparkContext.broadcast(RankCodec.read(f.read()))  # as large as the vocabulary, whatever the input

    def make():
        codec = made.value
        return codec, Splitter(pattern), Memo(lambda t: array("I", codec.encode(t.encode("utf-8"))).tobytes()).__getitem__

    def rows_of(columns):
        codec, split, ids_of = once(("ranks", ranks, pattern), make)
        rows = []
        for key, text in zip(*columns):
            ids = b"".join(map(ids_of, split.find(text)))
            decoded = codec.decode(memoryview(ids).cast("I"))
            row = (key, len(ids) // 4, sha256(ids).hexdigest(), sha256(decoded).hexdigest())
            rows.append((*row, ids) if with_ids else row)
        return rows

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return map_texts(whole_texts(docs), rows_of, schema, "doc_id", "text")
