"""Pages to blocks and blocks to chunks: stated cases, and sections and pieces against plain loops."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from siltstone.operators import chunks
from siltstone.sources.html import read_page

HOME = "https://example.test"
CASES = [
    ("<h2>Shipping</h2><p>We ship worldwide.</p><h3>Costs</h3><p>Free over €50.</p>",
     [("heading", "Shipping", 2), ("paragraph", "We ship worldwide.", 0), ("heading", "Costs", 3), ("paragraph", "Free over €50.", 0)]),
    ("<ul><li>Fast delivery</li><li>Free <b>returns</b></ul><table><tr><th>Size</th><th>Price</th></tr><tr><td>M</td><td>€20</td></tr><tr><td></td><td>x</td><td>y</td></tr></table>",
     [("list", "• Fast delivery\n• Free returns", 0), ("table", "Size: M; Price: €20\nPrice: x; y", 0)]),
    ("<ul><li>a<ul><li>b</li></ul></li></ul>", [("list", "• ab\n• b", 0)]),
    ("<script>x()</script><style>p{}</style><form>name</form><p>Real&nbsp;&amp; content.</p><nav><a href='/m'>Menu</a></nav>", [("paragraph", "Real & content.", 0)]),
    ("loose <a href='/x'>link</a> text<br>next<span> in a span</span> after", [("paragraph", "loose link text", 0), ("paragraph", "next in a span", 0), ("paragraph", "after", 0)]),
    ("<p>one<p>two<div>three</div>", [("paragraph", "one", 0), ("paragraph", "two", 0), ("paragraph", "three", 0)]),
    ("<blockquote><h2>quoted</h2> words</blockquote></div></p>", [("paragraph", "quoted words", 0)]),
    ("<table><tr><td>only</td></tr></table><ol></ol><h1> </h1>", [("table", "only", 0)]),
    ("", []), (None, []), ("<p>never closed", [("paragraph", "never closed", 0)]),
]


@pytest.mark.parametrize("page,blocks", CASES)
def test_blocks(page, blocks):
    assert read_page(page, HOME).blocks == blocks


def test_links_images_and_menus():
    page = """<p>See <a href="/shipping/">shipping <i>info</i></a>, <a href="https://other.test/x">x</a>, <a href="#a">a</a>, <a href="mailto:a@b.c">m</a>
      <a href="//cdn.test/y">y</a><a>none</a></p><img class="alignnone wp-image-42 size-large"><h2><img class="wp-image-7"><img class="wp-image-42"></h2>
      <nav><ul><li><a href="/one">One</a></li><li><a href="#">Two</a></li></ul><img class="wp-image-9"></nav><ul><li><a href=" /li ">%s</a></li></ul>""" % ("z" * 300)
    read = read_page(page, HOME + "/")
    assert read.links == [(f"{HOME}/shipping/", "shipping info"), ("https://other.test/x", "x"), ("https://cdn.test/y", "y"), (f"{HOME}/li", "z" * 255)]
    assert read.image_ids == [42, 7] and read.menu == [("/one", "One"), ("#", "Two")]


SCHEMA = "doc_id long, title string, blocks array<struct<kind:string,text:string,level:int>>, structured string"


def chunked(spark, *docs):
    rows = chunks.chunk_documents(spark.createDataFrame(list(docs), SCHEMA).repartition(3)).collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.seq)):
        assert r.token_est == -(-len(r.content) // 4) and r.chunk_hash == hashlib.sha1(f"{r.heading_path}|{r.content}".encode()).hexdigest()
        out.setdefault(r.doc_id, []).append((r.kind, r.heading_path, r.content))
        assert r.seq == len(out[r.doc_id]) - 1
    return out


def test_sections_and_their_paths(spark):
    docs = [
        (1, "Shipping FAQ", [("heading", "Delivery times", 2), ("heading", "Europe", 3), ("paragraph", "Two days.", 0)], ""),
        (2, "T", [("paragraph", "before", 0), ("heading", "A", 2), ("list", "• x", 0), ("paragraph", "y", 0), ("heading", "minor", 4), ("heading", "S", 3), ("heading", "B", 1), ("table", "t: 1", 0)], "price: 19.90"),
        (3, None, [("heading", "S", 3), ("faq", "q", None), ("heading", "S2", 3), ("paragraph", "p", 0)], None),
        (4, "Empty", [("heading", "H", 1)], None), (5, "Nothing", [], ""), (6, "Null", None, None),
        (7, "Hello", [("paragraph", "Hello there", 0)], None), (8, "F", [], "facts alone"),
    ]
    assert chunked(spark, *docs) == {
        1: [("prose", "Shipping FAQ › Delivery times › Europe", "Shipping FAQ\nTwo days.")],
        2: [("spec", "T", "T\nprice: 19.90"), ("prose", "T", "before"), ("list", "T › A", "• x\n\ny\n\nminor:"), ("table", "T › B", "t: 1")],
        3: [("faq", "S", "q"), ("prose", "S2", "p")],
        7: [("prose", "Hello", "Hello there")],
        8: [("spec", "F", "F\nfacts alone")],
    }
    assert chunked(spark, (1, "x" * 900, [("paragraph", "p", 0)], ""))[1][0][1] == "x" * 512


def brute_pieces(text):
    """One sentence after the other, in the words of the rule."""
    if len(text) <= 1200:
        return [text]
    out, held = [], ""
    for sentence in [s.strip() for s in re.split(r"(?<=[.!?…:;])\s+(?=[A-ZÀ-Þ0-9•])|\n+", text) if s.strip()]:
        while len(sentence) > 2000:
            out.append((held + " " + sentence[:2000]).strip() if held else sentence[:2000])
            held, sentence = "", sentence[1880:]
        if held and len(held) >= 800 and len(held) + 1 + len(sentence) > 1200:
            out.append(held)
            tail = held[-120:]
            held = tail[tail.index(" ") + 1 :] if " " in tail else ""
        held = held + " " + sentence if held else sentence
    return out + ([held.strip()] if held.strip() else [])


def test_pieces_equal_the_rule(spark):
    rng = random.Random(7)

    def sentence():
        n = rng.choice([3, 60, 130, 300, 900, 1300, 2100, 5000])
        return ("Ñ" + "".join(rng.choice("abc   ") for _ in range(n))).strip() + rng.choice([".", "!", ": 5", ""])

    texts = [rng.choice([" ", "\n", "\n\n"]).join(" ".join(sentence().split()) for _ in range(rng.randrange(1, 14))) for _ in range(150)]
    got = chunked(spark, *((i, "", [("paragraph", t, 0)], "") for i, t in enumerate(texts)))
    assert {i: [c for _, _, c in v] for i, v in got.items()} == {i: brute_pieces(t) for i, t in enumerate(texts)}
    long = " ".join(["This sentence has ninety-five characters or about as many as that, to be repeated many times."] * 40)
    pieces = [c for _, _, c in chunked(spark, (1, "", [("paragraph", long, 0)], ""))[1]]
    assert len(pieces) > 1 and max(map(len, pieces)) <= 2000 and pieces[0][-60:] in pieces[1]
