"""Interleaved sequences of text and media (operator 2)."""

from __future__ import annotations

import html as entities
import re
from hashlib import sha256
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, whole_texts, written
from .extract import TAG, end_of_tags

WIDTH = 64
_SRC = re.compile(r"""\bsrc\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_ALT = re.compile(r"""\balt\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
# The elements that show media, and those that end a run of text.
MEDIA = frozenset({"img", "video", "audio", "embed", "source"})
BLOCKS = frozenset("p div figure figcaption section article h1 h2 h3 h4 h5 h6 ul ol li table tr td br hr blockquote pre".split())
SEQUENCE = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"


def parse_sequence(page: str | None) -> list[dict]:
    """Ordered items of a page: text runs, and media references with the digest their source names and their caption.

    A figure's caption belongs to the figure's media; without one, the ``alt`` text is the caption.
    """
    items: list[dict] = []
    held: list[str] = []
    figure: list[int] | None = None
    in_caption = False

    def close():
        text = " ".join(entities.unescape("".join(held)).split())
        held.clear()
        if not text:
            return
        if in_caption and figure:
            for k in figure:
                items[k]["caption"] = text
        else:
            items.append({"position": len(items), "kind": "text", "text": text, "digest": None, "caption": None})

    page, done = page or "", 0
    for m in TAG.finditer(page, 0, end_of_tags(page)):
        held.append(page[done : m.start()])
        done = m.end()
        tag = (m[2] or "").lower()
        if tag in BLOCKS or tag in MEDIA:
            close()
        if tag in MEDIA and not m[1] and (src := _SRC.search(m[3])):
            named = next(g for g in src.groups() if g is not None)
            alt = _ALT.search(m[3])
            caption = entities.unescape(next(g for g in alt.groups() if g is not None)) if alt else None
            if figure is not None:
                figure.append(len(items))
            digest = named.removeprefix("sha256:") if named.startswith("sha256:") else sha256(named.encode()).hexdigest()
            items.append({"position": len(items), "kind": "media", "text": None, "digest": digest, "caption": caption})
        elif tag == "figure":
            figure = None if m[1] else []
        elif tag == "figcaption":
            in_caption = not m[1]
    held.append(page[done:])
    close()
    return items


def sequences(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, items: each page parsed into its ordered text and media structs; null or empty pages have no items."""

    def rows_of(columns):
        return [(k, parse_sequence(p)) for k, p in zip(*columns)]

    kind = dict(pages.dtypes)[key]
    return map_texts(pages.select(F.col(key).alias("key"), F.col(html).alias("html")), rows_of, f"key {kind}, items {SEQUENCE}", "key", "html")


def resolve(seqs: DataFrame, store: DataFrame) -> DataFrame:
    """key, position, kind, text, digest, caption and the store's other columns; positions stay, a lost digest gives nulls.

    ``store`` has one row for each digest. Only digests and what ``store`` holds are shuffled, not texts: text items stay
    beside and are united, so a digest that a third of all references name is dealt as a skewed join of narrow rows.
    """
    flat = seqs.select("key", F.explode("items").alias("i")).select("key", "i.*")
    media = flat.where("kind = 'media'").join(store, "digest", "left")
    return media.unionByName(flat.where("kind = 'text'"), allowMissingColumns=True)


def padded(text: F.Column) -> F.Column:
    """UTF-8 bytes of ``text`` with zero bytes up to a positive multiple of 64, built by Spark's own functions."""
    size = F.octet_length(text)
    total = F.greatest(F.lit(WIDTH), F.ceil(size / WIDTH).cast("int") * WIDTH)
    return F.concat(F.encode(text, "UTF-8"), F.unhex(F.repeat(F.lit("00"), total - size)))


def greymap(payload: F.Column) -> F.Column:
    """The payload as a binary portable greymap: 64 samples of 8 bits in a row."""
    head = F.concat(F.lit(f"P5\n{WIDTH} "), (F.octet_length(payload) / WIDTH).cast("int").cast("string"), F.lit("\n255\n"))
    return F.concat(F.encode(head, "UTF-8"), payload)


def read_greymap(data: bytes) -> bytes:
    kind, size, top, rest = data.split(b"\n", 3)
    width, height = map(int, size.split())
    if (kind, width, top) != (b"P5", WIDTH, b"255") or len(rest) != width * height:
        raise ValueError("not a greymap of this store")
    return rest


def features(store: DataFrame) -> DataFrame:
    """digest and what the stored bytes give: sizes, digests, the tail's checksum, and a histogram feature; one row a digest.

    Only these narrow rows are gathered by digest; the stored bytes are read where they lie.
    """

    def rows_of(columns):
        rows = []
        for named, data in zip(*columns):
            payload = read_greymap(data)
            digest = sha256(payload).hexdigest()
            if digest != named:
                raise ValueError(f"stored bytes of {named} have digest {digest}")
            samples = np.frombuffer(payload, np.uint8)
            bins = np.bincount(samples >> 4, minlength=16)
            feature = f"mean={int(samples.sum(dtype=np.int64)) * 1000 // len(samples)};bins={','.join(map(str, bins.tolist()))}"
            rows.append((named, len(payload), digest, crc32(payload[-64:]), len(data), sha256(data).hexdigest(), feature))
        return rows

    schema = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_texts(store, rows_of, schema, "digest", "media").groupBy("digest").agg(*[F.first(c).alias(c) for c in schema.replace(",", "").split()[2::2]])


def text_media(docs: DataFrame) -> DataFrame:
    """Every text stored as a greymap, named by its payload's digest in a page, and found again through the page's sequence.

    Each text becomes a page of its lines followed by a figure whose image names the payload's digest and whose caption
    names the document. Pages are parsed into interleaved sequences, digests are resolved against the store as read back,
    and a row is returned for each document: doc_id, n_bytes, payload and media sizes and digests, tail_crc32, feature,
    with the number of the page's text items, the media's position among all items, and its caption. A payload that several
    documents have is stored with each of them: to store it once, all texts would have to be shuffled.

    Null and empty texts are 64 zero bytes; equal texts give equal values; rows with equal keys stay apart; a null key
    stays null; extra columns are ignored.
    """
    texts = whole_texts(docs)
    payload = padded(F.col("text"))
    store = written(texts.select(F.sha2(payload, 256).alias("digest"), greymap(payload).alias("media")), "media")
    safe = F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    page = F.concat(F.lit("<p>"), F.replace(safe, F.lit("\n"), F.lit("</p><p>")), F.lit('</p><figure><img src="sha256:'), F.sha2(payload, 256), F.lit('"><figcaption>document '), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("</figcaption></figure>"))
    pages = texts.select(F.struct("doc_id", F.octet_length("text").cast("long").alias("n_bytes")).alias("key"), page.alias("html"))
    # of the sequence's texts only their number goes on: they need no payload, and would be shuffled beside the media
    parsed = sequences(pages, "key", "html").select(F.struct("key.*", F.expr("size(filter(items, i -> i.kind = 'text'))").cast("long").alias("text_items")).alias("key"), F.expr("filter(items, i -> i.kind = 'media')").alias("items"))
    found = resolve(parsed, features(store))
    columns = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return found.select("key.doc_id", "key.n_bytes", *columns, "key.text_items", F.col("position").alias("media_position"), "caption")
