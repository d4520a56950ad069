"""FLAC round trips and damage; main text of pages."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import SF, empty_docs, odd_docs

from seqsearch.llm import flac, html_extract, media_flac


def padded(data: bytes) -> bytes:
    n = max(1, -(-len(data) // 192)) * 192
    return data + b" " * (n - len(data))


def samples():
    rng = random.Random(1)
    yield from (b"", b"a", b"e" * 192, b"\x00\xff" * 300, bytes(range(256)) * 3, "ünï çödé ".encode() * 90, b"e" * 100 + b"\xff" + b"e" * 300)
    for _ in range(30):
        alphabet = rng.choice([bytes(range(256)), b"ab", b"\x00\x80\xff", b"etaoin shrdlu", b"\x7f\x80"])
        yield bytes(rng.choice(alphabet) for _ in range(rng.randint(1, 2500)))


def test_round_trip():
    payloads = [padded(p) for p in samples()]
    streams = flac.encode(payloads)
    assert flac.decode(streams) == payloads
    assert [flac.encode([p])[0] for p in payloads] == streams  # whatever they are coded with
    assert flac.encode([]) == flac.decode([]) == []


def test_long_streams_are_coded_in_slices(monkeypatch):
    payload = padded(random.Random(2).randbytes(192 * 300))
    whole = flac.encode([payload, payload[:192]])
    monkeypatch.setattr(flac, "SLICE", 7)
    assert flac.encode([payload, payload[:192]]) == whole and flac.decode(whole) == [payload, payload[:192]]


def test_seeking():
    payload = padded(random.Random(3).randbytes(192 * 40) + b"text " * 3000)
    stream = flac.encode([payload])[0]
    for at, n in ((0, 10), (191, 2), (5000, 1000), (len(payload) - 3, 99), (len(payload), 5), (192 * 39, 192)):
        assert flac.read_samples(stream, at, n) == payload[at : at + n]


def test_streams_with_fewer_seek_points(monkeypatch):
    data = [media_flac.payload("some text \xff\xf8 " * n) for n in (1, 40, 300)]
    whole = flac.encode(data)
    monkeypatch.setattr(flac, "POINTS", 4)
    few = flac.encode(data)
    assert len(few[2]) < len(whole[2]) and flac.decode(few) == data
    assert flac.read_samples(few[2], 1000, 500) == data[2][1000:1500]


def test_pcm_blocks(spark):
    docs = odd_docs(spark)
    rows = media_flac.pcm_blocks(media_flac.to_media(docs.where("doc_id is not null").dropDuplicates(["doc_id"])), frames=3).collect()
    texts = {r["doc_id"]: r for r in docs.where("doc_id is not null").dropDuplicates(["doc_id"]).collect()}
    for doc in texts:
        own = sorted((r["sample"], r["n"], bytes(r["pcm"])) for r in rows if r["doc_id"] == doc)
        assert [s for s, _, _ in own] == list(range(0, sum(n for _, n, _ in own), 576))
        assert bytes(b ^ 0x80 for b in b"".join(p for _, _, p in own)) == media_flac.payload(texts[doc]["text"])


def test_damage_is_found():
    stream = flac.encode([padded(b"some text that is long enough to matter " * 40)])[0]
    for at in range(0, len(stream), 7):
        if 8 <= at < 18 or 42 <= at < 46:  # sizes in STREAMINFO that the decoder doesn't need, and a block header
            continue
        broken = bytearray(stream)
        broken[at] ^= 0x10
        with pytest.raises(Exception):  # noqa: B017 - whichever check finds it first
            assert flac.decode([bytes(broken)]) != flac.decode([stream])


def bits_of(value, n):
    return format(value & ((1 << n) - 1), f"0{n}b")


def linear_stream(x: list[int], coefficients: list[int], shift: int, partition: int) -> bytes:
    """A frame with an LPC subframe and partitioned residuals, written bit by bit."""
    order, precision = len(coefficients), 6
    residual = [x[i] - (sum(c * x[i - 1 - j] for j, c in enumerate(coefficients)) >> shift) for i in range(order, 192)]
    out = "0" + bits_of(31 + order, 6) + "0" + "".join(bits_of(v, 8) for v in x[:order])
    out += bits_of(precision - 1, 4) + bits_of(shift, 5) + "".join(bits_of(c, precision) for c in coefficients)
    out += "00" + bits_of(partition, 4)
    size = 192 >> partition
    for p in range(1 << partition):
        k = 2 + p % 3
        out += bits_of(k, 4)
        for i in range(max(order, p * size), (p + 1) * size):
            u = 2 * residual[i - order] if residual[i - order] >= 0 else -2 * residual[i - order] - 1
            out += "0" * (u >> k) + "1" + (bits_of(u, k) if k else "")
    out += "0" * (-len(out) % 8)
    head = bytes([0xFF, 0xF8, 0x10, 0x02, 0])

    def crc(data, poly, bits):
        c = 0
        for byte in data:
            c ^= byte << (bits - 8)
            for _ in range(8):
                c = ((c << 1) ^ poly if c >> (bits - 1) else c << 1) & ((1 << bits) - 1)
        return c.to_bytes(bits // 8, "big")

    frame = head + crc(head, 0x07, 8) + int(out, 2).to_bytes(len(out) // 8, "big")
    frame += crc(frame, 0x8005, 16)
    data = np.array(x, np.int8).tobytes()
    info = b"\x00\xc0\x00\xc0" + bytes(6) + ((8000 << 44) | (7 << 36) | 192).to_bytes(8, "big") + hashlib.md5(data).digest()
    return b"fLaC\x00\x00\x00\x22" + info + b"\x83\x00\x00\x12" + (0).to_bytes(8, "big") + (0).to_bytes(8, "big") + b"\x00\xc0" + frame


@pytest.mark.parametrize("partition", [0, 1, 3])
def test_linear_predictors(partition):
    x = [int(60 * np.sin(i / 9) + 20 * np.sin(i / 2)) for i in range(192)]
    for coefficients, shift in (([15], 4), ([29, -14], 4), ([20, -6, 3, -2], 4)):
        got = flac.decode([linear_stream(x, coefficients, shift, partition)])[0]
        assert got == bytes((v + 128) & 255 for v in x)


def test_media_columns(spark):
    docs = odd_docs(spark)
    rows = media_flac.read_media(media_flac.to_media(docs), data=True).collect()
    expected = Counter((r["doc_id"], len(d := (r["text"] or "").encode()), len(p := padded(d)), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])) for r in docs.collect())
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in rows) == expected
    same = {}
    for r in rows:
        assert same.setdefault(bytes(r["pcm"]), (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])
    assert media_flac.read_media(media_flac.to_media(empty_docs(spark))).collect() == []
    none = media_flac.to_media(docs.limit(1)).selectExpr("doc_id", "n_bytes", "cast(null as binary) as media")
    assert media_flac.read_media(none).first()["payload_sha256"] is None


ARTICLE = "<article><h1>T</h1><p>one &amp; two<br>three<p>four <b>five</b></article>"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<html><head><title>x</title></head><body></body></html>", ""),
        (ARTICLE, "T\none & two three\nfour five"),
        (f"<header><h1>Site</h1></header><nav><a>m</a></nav>{ARTICLE}<aside>side</aside><footer>f</footer>", "T\none & two three\nfour five"),
        (f"<div class=ad>{'buy ' * 400}</div>{ARTICLE}<div id='comments'><p>{'nice ' * 500}</p></div>", "T\none & two three\nfour five"),
        ("<article><p>a</p><div class='cookie-notice'>no</div><form>f</form><script>var x='</p>'</script><style>p{}</style><p>b</p><section class=comments>c</section></article>", "a\nb"),
        ("<body class='has-sidebar'><div id=menu><ul><li><a>x</a></ul></div><div class=content><h2>Head</h2><p>First para.</p><ul><li>i<li>j</ul><p>Last.</div><div class=sidebar>s</div>", "Head\nFirst para.\ni\nj\nLast."),
        ("<p>a &lt;b&gt; &#233;&nbsp;c \n\t d</p>", "a <b> é c d"),
        ("<!-- <p>no</p> --><p>yes<!-- no --> too</p><![CDATA[raw]]>", "yes too\nraw"),
        ("plain text only", "plain text only"),
        ("<p>broken <b>tags</p><p>go on</i></div><p>here", "broken tags\ngo on\nhere"),
        ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"),
    ],
)
def test_main_text(page, text):
    assert html_extract.main_text(page) == text


def test_link_lists_are_no_text():
    menu = "".join(f"<p><a href=x>{'link text ' * 5}</a></p>" for _ in range(6))
    assert html_extract.main_text(f"{menu}<p>{'The text itself. ' * 20}</p><p>More of it.</p>{menu}") == " ".join(["The text itself."] * 20) + "\nMore of it."


def test_articles_beside_the_text():
    long, other, teaser = ("".join(f"<p>{w} {'words of it ' * n}</p>" for w in ("one", "two", "three")) for n in (30, 12, 1))
    plain = lambda *parts: "\n".join(" ".join(x.split()) for p in parts for x in re.split("</?p>", p) if x.strip())
    # the body in a div or section, an article near it or within it
    assert html_extract.main_text(f"<div>{long}</div><article>{teaser}</article>") == plain(long, teaser)
    assert html_extract.main_text(f"<section>{long}<article><a href=x>read more of this</a></article>{other}</section>") == plain(long, "read more of this", other)
    # siblings, of which none is nearly all
    assert html_extract.main_text(f"<article>{other}</article><article>{long}</article>{other}") == plain(other, long, other)
    # an article that is nearly all keeps its far ends, as it does among others
    far = f"<article><p>head</p>{'<nav>n</nav>' * 4}{long}</article>"
    assert html_extract.main_text(f"{far}<p>read also</p>") == plain("head", long)
    assert html_extract.main_text(f"{far}<div>{other}</div>") == plain("head", long, other)


def test_surge_and_dive():
    assert html_extract.surge_and_dive([]) == html_extract.surge_and_dive([0, 0]) == (0, 0)
    assert html_extract.surge_and_dive([5, 0, 0, 0, 50, 0, 60, 1, 0, 0, 0, 9]) == (4, 8)


def test_names_do_not_take_the_article():
    long = "".join(f"<p>{'words of it ' * 30}{i}</p>" for i in range(5))
    plain = "\n".join(" ".join(x.split()) for x in re.split("</?p>", long) if x.strip())
    note = "<div class=ad>buy this now</div>"
    assert html_extract.main_text(f"{note}<div class='share-price'>{long}</div>") == plain
    assert html_extract.main_text(f"{note}<article class='related-work promo'>{long}</article>{note}") == plain
    assert html_extract.main_text(f"<div class='social page'><div class=comments><p>{'so nice ' * 20}</p></div><article>{long}</article></div>") == plain
    assert html_extract.main_text(f"<article><p>a <span class=ad>word</span> and another</p>{long}</article>") == "a word and another\n" + plain


def test_windows_decide_without_marks(spark, monkeypatch):
    """Pages without article, class, id and role: the text is the same, and it is the windows that cut it."""
    pages = [r["html"] for r in spark.read.parquet(f"{SF.replace('0.001', '0.01')}/pages.parquet").collect()]
    stripped = [re.sub(r"\s(?:class|id|role)=(?:\"[^\"]*\"|[^\s>]+)", "", re.sub("</?article[^>]*>", "", p)) for p in pages]
    with_marks, without = list(map(html_extract.main_text, pages)), list(map(html_extract.main_text, stripped))
    same = sum(a == b for a, b in zip(with_marks, without, strict=True))
    assert same >= 0.95 * len(pages), same
    monkeypatch.setattr(html_extract, "surge_and_dive", lambda lengths: (0, len(lengths)))
    off = list(map(html_extract.main_text, stripped))
    assert sum(a == b for a, b in zip(with_marks, off, strict=True)) < 0.05 * len(pages)


def test_work_grows_with_the_page():
    import time

    def seconds(n):
        page = "<div><dd>" * n + "</span></i>x" * n + "<dd>" * n
        began = time.perf_counter()
        html_extract.main_text(page)
        return time.perf_counter() - began

    assert seconds(40_000) < 20 * max(seconds(5_000), 0.02)


def test_pages(spark):
    import html

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r for r in html_extract.extract(pages).collect()}
    for r in pages.collect():
        inner = r["html"].split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r["page_id"]]["text"] == "\n".join(b for b in blocks if b) and got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])
    odd = spark.createDataFrame([(None, None, None, "x"), (1, "u", ARTICLE, "y"), (1, "u", ARTICLE, "y"), (2, "v", "<p>" + "word " * 200_000, "z")], "page_id long, url string, html string, text string")
    assert sorted(r["n_chars"] for r in html_extract.extract(odd).collect()) == [0, 27, 27, 999_999]
    assert html_extract.extract(odd.where("false")).collect() == []


def test_named_elements_count_from_the_outside_in():
    """Nested and side by side: the largest count as text until enough is left, and only these."""
    text = "word " * 50
    page = f'<div class="sidebar"><p>{text}</p><div class="ad"><p>{text}{text}</p></div></div><div class="ad"><p>advert</p></div>'
    assert html_extract.main_text(page) == text.strip()  # a third of all is enough
    few = page.replace(f"<p>{text}</p><div", "<p>few words</p><div")
    assert html_extract.main_text(few) == "\n".join(["few words", (text + text).strip()])
    article = f"<article><p>{text}</p></article>"
    assert html_extract.main_text(page + article) == text.strip()
    found, parents = html_extract.lines(page)
    assert parents == [0, 0, 1, 0] and [x.named for x in found] == [1, 2, 3]


def test_work_grows_with_named_elements():
    import time

    def seconds(n: int) -> float:
        began = time.perf_counter()
        assert html_extract.main_text('<div class="ad">' * n + "<p>x</p>" * n) == "\n".join("x" * n)
        html_extract.main_text('<div class="ad"><p>x</p></div>' * n)
        return time.perf_counter() - began

    seconds(200)
    assert seconds(6000) < 40 * max(seconds(600), 0.01)


def test_labels_do_not_part_the_text():
    text = ("word " * 60).strip()
    page = f"<p>{text}</p>{'<div>x</div>' * 20}<p>{text}</p>"
    assert html_extract.main_text(page) == "\n".join([text, *"x" * 20, text])
    links = '<div><a href="#">elsewhere</a></div>' * 20
    assert html_extract.main_text(f"<p>{text}</p>{links}<p>short one</p>") == text
