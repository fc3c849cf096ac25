import html
import re

import numpy as np
import pytest

from glossa.llm import html_blocks as H

PAGE = """<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>T &amp; t</title><style>p{margin:0}</style>
<script>var t="</p>";track(0);</script></head><body><nav><ul><li><a href="/x">Home</a></li><li><a href="/y">More</a></ul></nav>
<!-- ad <p>0</p> --><div class="ad">Buy now.</div><article><h1>A &lt;b&gt;   title</h1><p><b>First
line&nbsp;here.<br><p>Second <i>part</i> of <a href='>'>text</a>.<p class=x>Third &copy; &#233;.</p></article><footer>&copy; site.</footer>"""


def texts(page):
    return [b.text for b in H.blocks(page)]


def test_blocks():
    want = ["T & t", "Home", "More", "Buy now.", "A <b> title", "First line here.", "Second part of text.", "Third © é.", "© site."]
    assert texts(PAGE) == want
    assert texts(None) == texts("") == texts("<p><div></div>") == []
    assert texts("plain a < b text") == ["plain a < b text"] and texts("a<b>b</b>c<p") == ["abc"]
    assert texts("<script>x</script>y<style>z") == ["y"] and texts("<UL><LI>a<LI>b</UL>c") == ["a", "b", "c"]
    assert texts("x<br>y\n z") == ["x y z"] and texts("<table><tr><td>a<td>b<tr><td>c</table>") == ["a", "b", "c"]
    assert texts("<p>" * 3000 + "deep" + "<div>" * 300 + "er") == ["deep", "er"]
    assert H.blocks("<nav>a<a href=x>bcd</a></nav>")[0].linked == 0.75


def test_tags_of_odd_shape():
    assert texts("<p title=it's>one</p><p>two's</p>") == ["one", "two's"]
    assert texts('<p title="abc>one</p><p>two') == ["one", "two"]  # nothing closes the quote
    assert texts('<p title="a>b" x=\'>\' y = z"w>one') == ["one"] and texts("<p a= >one<p =b>two<p a=/x/>three") == ["one", "two", "three"]
    assert texts('<div class=a"b id=\'c\'>one</div></ x>two<!-->three<!>four') == ["one", "twothreefour"]
    gone = "<template><p>x<template>y</template>z</p></template><noscript><p>x</p></noscript><svg><text>x</text><svg></svg>x</svg><svg/>"
    assert texts(f"a{gone}<p>b</p>{gone}c") == ["a", "b", "c"]
    assert texts("<p " + "a=\"b\" " * 50_000 + ">x") == ["x"] and texts("<p " + "a='" * 3001 + ">x") == ["x"]


def test_gradients():
    net, rng = H.BiLSTM(5, 3, 1), np.random.default_rng(0)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, lengths = rng.normal(size=(2, 4, 5)), np.array([4, 2])
    y = np.array([[1, 0, 1, 1], [0, 1, 0, 0]], float)
    real = np.arange(4)[None, :] < lengths[:, None]

    def loss():
        f = net.forward(x, lengths)
        return (np.where(real, np.logaddexp(0, f) - y * f, 0)).sum() / real.sum()

    g = net.gradients(x, lengths, y)
    for k in net.p:
        flat = net.p[k].reshape(-1)
        for i in rng.choice(len(flat), min(6, len(flat)), replace=False):
            old, e = flat[i], 1e-2
            flat[i] = old + e
            up = loss()
            flat[i] = old - e
            down = loss()
            flat[i] = old
            assert abs((up - down) / (2 * e) - g[k].reshape(-1)[i]) < 2e-3, k


@pytest.fixture(scope="module")
def net():
    return H.trained()


def test_unseen_layouts(net):
    writer, vectors, wrong, n = H.PageWriter(77), H.Vectors(), 0, 0
    for _ in range(150):
        page, labels = writer.page()
        if labels:
            got = net.probabilities([vectors(H.blocks(page))])[0] >= 0.5
            wrong, n = wrong + (got != np.array(labels)).sum(), n + len(labels)
    assert wrong / n < 0.03


def test_page_and_padding(net):
    vectors = H.Vectors()
    want = "A <b> title\n\nFirst line here.\n\nSecond part of text.\n\nThird © é."
    assert H.main_texts([PAGE, None, "", PAGE], net, vectors) == [want, "", "", want]


def test_table_against_article_element(spark, net, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r.text for r in H.extract(rows.selectExpr("*", "1 as text", "2 as path"), net).collect()}
    for r in rows.collect():
        inside = re.sub("</?b>", "", r.html.split("<article>")[1].split("</article>")[0])
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", inside)]
        assert got[r.page_id] == "\n\n".join(x for x in parts if x)
    assert H.extract(rows.limit(0), net).count() == 0


def test_other_elements_of_an_article(net):
    page = (
        "<body><nav><a href=/>Home</a></nav><article><h1>Title of it</h1><p>Some words that say what comes.</p><table><tr><th>Head A<th>Head B"
        "<tr><td>Cell A</td><td>Cell B</td></table><figure><img src=x><figcaption>What the picture shows</figcaption></figure>"
        "<pre>x = 1\n  y</pre><p title=it's>The last words of it.</p></article><template><p>no</p></template><footer>All rights reserved.</footer>"
    )
    want = ["Title of it", "Some words that say what comes.", "Head A", "Head B", "Cell A", "Cell B", "What the picture shows", "x = 1 y", "The last words of it."]
    assert H.main_texts([page], net, H.Vectors()) == ["\n\n".join(want)]


def test_no_markup_in_text(net):
    writer = H.PageWriter(5)
    for _ in range(60):
        page = re.sub("<p>", lambda m: writer.r.choice(["<p>", "<p title=it's>", "<p data-x='a\"b'>", "<p x=\">\">"]), writer.page()[0])
        assert not re.search("</?[a-z]+[ >]|title=|data-x", H.main_texts([page], net, H.Vectors())[0])


def test_very_long_page(net):
    page = "<nav><a>x</a></nav><article>" + "<p>Some words of text here.</p>" * 20000 + "</article>"
    assert len(H.blocks(page)) == 20001
    assert len(H.main_texts([page], net, H.Vectors())[0]) > 100_000
