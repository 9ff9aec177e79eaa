"""Main text, interleaved media and personal data on small and odd inputs."""

import random
import re
import time
import unicodedata
from hashlib import sha256
from zlib import crc32

import pytest

from quern.llm import extract, media, pii

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="ad">Buy this now</div><div class="cookie-notice">We use</div>
<article><h1>Head &amp; line</h1><p><b>First  para<br>goes on.<p>Short.</p><aside>Side</aside><form>Name</form>
<p>A &lt; b &#233;</p><section class="comments"><p>I disagree</p></section></article><footer>&copy; x</footer></body></html>"""


def test_article_without_what_surrounds_it():
    assert extract.main_text(PAGE) == "Head & line First para goes on. Short. A < b é"


@pytest.mark.parametrize("page, text", [(None, ""), ("", ""), ("plain words", "plain words"), ("<p>a<b>b</b> c", "ab c"), ("a < b", "a < b"), ("<div class='ad'>x</div>", ""), ('<p title="x>y">q</p>', "q"), ("<script>x", ""), ("<p>&am &amp", "&am &")])
def test_odd_pages(page, text):
    assert extract.main_text(page) == text


def test_surge_and_dive_without_an_article():
    long = "word " * 40
    page = f"<div><a href=x>menu one</a></div><div><a href=x>menu two</a></div><p>{long}</p><p>{long}</p><p>{long}</p><div>{'<p><a href=y>link</a></p>' * 9}</div>"
    assert extract.main_text(page) == " ".join([long.strip()] * 3)


def test_pages_query_shape(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None)], "page_id long, url string, html string, text string")
    rows = extract.extract_text(df).collect()
    assert len(rows) == 3 and {r.n_chars for r in rows} == {len(extract.main_text(PAGE)), 0}
    assert extract.extract_text(df.limit(0)).count() == 0


def test_deep_and_long_pages_are_linear():
    assert extract.main_text("<div>" * 50_000 + "x" * 100).endswith("x")
    assert extract.main_text("<" * 100_000).startswith("<")
    assert extract.main_text("</p>" * 50_000) == ""


def test_sequence_keeps_positions_and_captions():
    page = '<p>one</p><figure><img src="a.png" alt="alt"><figcaption>Cap &amp; tion</figcaption></figure><p>two</p><img src=b.png alt=c>'
    items = media.parse_sequence(page)
    assert [(i["position"], i["kind"], i["text"], i["caption"]) for i in items] == [(0, "text", "one", None), (1, "media", None, "Cap & tion"), (2, "text", "two", None), (3, "media", None, "c")]
    assert items[1]["digest"] == sha256(b"a.png").hexdigest()
    assert media.parse_sequence(None) == media.parse_sequence("") == []


def test_resolve_keeps_items_whose_digest_is_lost(spark):
    pages = spark.createDataFrame([(1, "<p>t</p><img src='sha256:aa'><img src='sha256:bb'>")], "k long, h string")
    store = spark.createDataFrame([("aa", b"data")], "digest string, media binary")
    got = sorted((r.position, r.kind, r.media) for r in media.resolve(media.sequences(pages, "k", "h"), store).collect())
    assert got == [(0, "text", None), (1, "media", b"data"), (2, "media", None)]


def test_text_media_against_plain_python(spark):
    texts = ["", None, "a", "é" * 32, "x" * 64, "x" * 65, "a & <b>\nc", "\0", "same", "same", "long " * 50_000]
    df = spark.createDataFrame([(i, t, "m") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    got = {r.doc_id: r for r in media.text_media(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        stored = f"P5\n64 {len(payload) // 64}\n255\n".encode() + payload
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (crc32(payload[-64:]), len(stored), sha256(stored).hexdigest())
        lines = sum(bool(x.strip()) for x in (t or "").split("\n"))
        assert r.caption == f"document {i}" and r.text_items == r.media_position == lines
    assert media.text_media(df.limit(0)).count() == 0


def brute(text):
    """The base patterns as they are written in the contract."""
    found = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append((1, *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"\D", "", m[0])
        s = sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d)))
        if 16 <= len(d) <= 19 and s % 10 == 0:
            found.append((2, *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub(r"\D", "", m[0])) <= 15:
            found.append((3, *m.span()))
    return found


def test_base_spans_equal_the_written_patterns():
    rnd = random.Random(2)
    signs = list("ab@@..--++ 0123456789()%_") + ["4556737586899855", "1.2.3.4", "+1 (212) 555-0100", "é", "٣"]
    for _ in range(20_000):
        t = "".join(rnd.choice(signs) for _ in range(rnd.randint(0, 30)))
        assert pii.find_plain(t) == brute(t), t


@pytest.mark.parametrize(
    "text, kind, part",
    [
        ("mail jane.doe [at] example [dot] org now", "email", "jane.doe [at] example [dot] org"),
        ("mail jane (at) example.org", "email", "jane (at) example.org"),
        ("write to jane at example dot com please", "email", "jane at example dot com"),
        ("x jаne@exаmple.com y", "email", "jаne@exаmple.com"),
        ("x jane＠example．com y", "email", "jane＠example．com"),
        ("ip １９２.１６８.１.１ z", "ip", "１９２.１６８.１.１"),
        ("call plus one two one two five five five zero one zero zero ok", "phone", "plus one two one two five five five zero one zero zero"),
        ("card ４５５６ ７３７５ ８６８９ ９８５５ z", "card", "４５５６ ７３７５ ８６８９ ９８５５"),
        ("to jane&#64;example&period;com.", "email", "jane&#64;example&period;com"),
        ("a​j​@x.org", "email", "a​j​@x.org"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, part):
    base, added = pii.find_spans(text)
    assert (kind, part) in [(pii.KINDS[k], text[a:b]) for k, a, b in base + added]
    assert part not in pii.redact(text)


@pytest.mark.parametrize("text", ["", "we met at noon. A dot here", "one two three", "at 5 dot 3", "normal é text", "meet at example.com"])
def test_clean_text_stays(text):
    assert pii.redact(text) == text


def test_find_pii_rows(spark):
    texts = ["a@b.co 1.2.3.4", None, "", "a@b.co 1.2.3.4", unicodedata.normalize("NFD", "é a [at] b [dot] co"), "+1 (212) 555-0100 " * 20_000]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, spans int")
    got = {r.doc_id: r for r in pii.find_pii(df).collect()}
    assert got[0].spans == "email:0:6,ip:7:14" and got[0].base_sha256 == sha256(b"email:0:6,ip:7:14").hexdigest()
    assert got[1].spans == got[2].spans == "" and got[1].base_sha256 == sha256(b"").hexdigest()
    assert got[4].n_email == 0 and got[4].n_added == 1 and got[5].n_phone == 20_000
    assert pii.find_pii(df.limit(0)).count() == 0
    kept = pii.redact_texts(df).orderBy("doc_id").collect()
    assert kept[0].text == "<EMAIL> <IP>" and kept[1].text is None and kept[0].spans == 0


@pytest.mark.parametrize(
    "part, kind",
    [(f"jane{a}example{d}com", "email") for a in ("{@}", "<@>", "[ @ ]", "( @ )", "[\t@]", "@") for d in ("{.}", "<.>", "[ . ]", "( . )", ".")]
    + [("+49 30 one two three 4567", "phone"), ("192.168.one.1", "ip"), ("j\u043ehn.doe@example.com", "email"), ("john@mail.example dot com", "email")],
)
@pytest.mark.parametrize("beside", ["", " An anecdote, at this point."])
def test_disguises_are_found_whatever_stands_beside_them(part, kind, beside):
    base, added = pii.find_spans(f"to {part},{beside}")
    assert (pii.KINDS.index(kind), 3, 3 + len(part)) in base + added
    assert pii.redact(f"to {part},{beside}") == f"to <{kind.upper()}>,{beside}"


def test_a_dotted_capital_in_a_digit_word():
    assert [k for k, _, _ in pii.find_spans("+49 30 f\u0130ve two three 4567")[1]] == [3]


@pytest.mark.parametrize(
    "part, kind",
    [("jane arobase exemple point fr", "email"), ("juan arroba ejemplo punto es", "email"), ("jane (at) beispiel (punkt) de", "email"), ("plus vier neun drei null eins zwei drei vier fünf sechs", "phone"), ("+33 un deux trois quatre cinq six sept huit", "phone"), ("+34 nueve uno dos tres cuatro cinco seis siete", "phone")],
)
def test_disguises_in_other_languages(part, kind):
    assert pii.redact(f"x {part}, y") == f"x <{kind.upper()}>, y"


def test_a_shift_in_length_moves_no_offset():
    text = "i̇ İ jane [at] example.org"
    assert [text[a:b] for _, a, b in pii.find_spans(text)[1]] == ["jane [at] example.org"]


@pytest.mark.parametrize("text", ["dot " + " " * 300_000, "dot " + " (" * 150_000, "a at " * 60_000 + "dot", "dot" + "[ " * 150_000, "dot" + " one" * 70_000, "@" * 300_000, "dot" + "&#0" * 100_000, "dot &#" + "0" * 300_000, "+1" + " " * 300_000])
def test_personal_data_is_sought_in_linear_time(text):
    began = time.process_time()
    pii.find_spans(text)
    assert time.process_time() - began < 3


def test_digit_words_as_in_every_pair_of_signs():
    """The transducer against the simple reading: replace each disguise where it stands, then look for plain identifiers."""
    rnd = random.Random(5)
    parts = ["jane", "example", "com", " at ", " dot ", "[at]", "(dot)", "@", ".", " ", "+", "4", "49", "one", " two ", "three", "а", "-", "x,"]
    for _ in range(20_000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 14)))
        base, added = pii.find_spans(text)
        assert base == brute(text)
        plain = pii.normalise(text)
        flat = plain[0] if plain else text
        spans = [(k, plain[1][a], plain[2][b - 1]) if plain else (k, a, b) for k, a, b in brute(flat)]
        assert set(added) <= set(spans) and all(any(k == q and s <= a and b <= e for q, s, e in base + added) for k, a, b in spans)


@pytest.mark.parametrize(
    "page, text",
    [
        ("<div>" + "real text " * 20 + '</div><article class="comment">I disagree</article>', ("real text " * 20).strip()),
        ('<article class="related-posts">x y</article><p>' + "body " * 30 + "</p>", ("body " * 30).strip()),
        ("<p>Short one here.</p><p>Another line.</p><p>x</p>", "Short one here. Another line. x"),
        ("<p>" + "long " * 30 + "</p><p>A.</p><p>B.</p><p>Last words.</p><p>C.</p>", "long " * 30 + "A. B. Last words. C."),
        ("<article><p>teaser</p></article>" + ("<p>" + "body " * 100 + "</p>") * 3, "teaser " + ("body " * 300).strip()),
        ("<article>Hi.</article><div>Share it</div>", "Hi."),
    ],
)
def test_the_distribution_decides(page, text):
    assert extract.main_text(page) == text


@pytest.mark.parametrize("page", ["<a " * 350_000, '<a "' * 250_000, "<!--" * 250_000, "<a '\"" * 200_000 + ">", "> " + "<a " * 300_000, "<script>" * 100_000, "<? " * 300_000])
def test_a_megabyte_of_broken_tags_takes_no_time(page):
    began = time.process_time()
    extract.main_text(page)
    media.parse_sequence(page)
    assert time.process_time() - began < 3


def test_blocks_against_a_plain_reading_of_every_page():
    """Every page of the smallest table: sums over each window, surges and dives written out anew."""
    import pyarrow.parquet as pq

    for page in pq.read_table("/root/testdata/sf0.001/pages.parquet").column("html").to_pylist():
        lines = extract.lines_of(page)
        marked = any(main and text for text, _, main in lines)
        weight = [n if not marked else n + 86 if main and text else n // 4 for text, n, main in lines]
        near = lambda i: [weight[max(0, k) : k + 3] for k in range(i - 2, i + 1)]
        on, expected = False, []
        for i, (text, _, _) in enumerate(lines):
            on = any(weight[i : i + 3]) if on else weight[i] > 0 and any(sum(b) >= 86 for b in near(i))
            expected += [text] if on and text else []
        assert extract.main_text(page) == " ".join(expected)
        article = page[page.index("<article") : page.index("</article>")]
        assert all(w in article for w in re.sub(r"[<>&]", " ", extract.main_text(page)).split()[:5])


def test_text_media_of_null_and_repeated_keys(spark):
    df = spark.createDataFrame([(None, "a"), (None, "a"), (1, "a"), (1, "a"), (1, "b"), (None, None)], "doc_id long, text string")
    rows = media.text_media(df).collect()
    assert len(rows) == 6 and sorted((r.doc_id is None, r.n_bytes) for r in rows) == [(False, 1)] * 3 + [(True, 0), (True, 1), (True, 1)]
    assert len({r.payload_sha256 for r in rows if r.n_bytes == 1}) == 2
    found = pii.find_pii(df).collect()
    assert len(found) == 6 and all(r.spans == "" for r in found)
