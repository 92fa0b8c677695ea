import os
import random
from collections import Counter, defaultdict

import pytest

from corpusguard.llm import html_text as H
from corpusguard.llm import queries

SCHEMA = "page_id long, url string, html string"


def text_of(page, **kw):
    return "\n".join(b.text for b in H.article_blocks(H.read_page(page), **kw))


PAGES = [
    ("<article><h1>A &amp; B</h1><p>one\n two<br>three<p>four <b>bold</b>ly</article><p>out", "A & B\none two three\nfour boldly"),
    ("<nav>menu</nav><main><p>x</p><aside>side</aside><form>name <input></form><div class='ad-box'>buy</div><p>y</p></main><footer>f</footer>", "x\ny"),
    ("<article><p>text</p><section id='comments'><article class='comment'><p>first!</p></article></section></article>", "text"),
    ("<div class=\"cookie-notice\"><p>We use cookies</p></div><article>a<script>var t='</p>';</script>b<style>p{}</style></article>", "ab"),
    ("<article><p>1 &lt; 2 &#x41;&nbsp;&eacute; &unknown; 3</p></article>", "1 < 2 A é &unknown; 3"),
    ("<article><!-- no --><p>a<!-- </article> -->b</p><![CDATA[x]]></article>", "ab"),
    ("<ARTICLE><P>Up <SPAN CLASS=Ad>buy</SPAN>per</P></ARTICLE>", "Up per"),
    ("<article><div>one</div></div><div>two</div></span>three</article>", "one\ntwo\nthree"),
    ("<article><ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>1<td>2<tr><td>3</table></article>", "a\nb\nc\nd\n1\n2\n3"),
    ("<article><p hidden>no</p><p style='display: none'>no</p><div role=alert>no</div><p>yes</p></article>", "yes"),
    ("<div class='content-with-sidebar'><article><p>kept</p></article></div>", "kept"),
    ("<title>t</title><body><div><p>Only text without an article.</p></div><div><a href=x>link</a></div>", "Only text without an article."),
    ("<article>a < b and <3 and <a href=\"x>y\">link</a> <p", "a < b and <3 and link <p"),
    ("<article><header><h1>Head</h1></header><textarea>typed</textarea><select><option>o</select><p>t</article>", "Head\nt"),
    ("<article><script>never closed <p>x", ""), ("<article>x<!-- never closed <p>y", "x"), ("", ""), (None, ""), ("plain", "plain"),
]


@pytest.mark.parametrize("page,want", PAGES)
def test_one_page(page, want):
    assert text_of(page) == want


def test_long_and_odd_pages_take_linear_time():
    assert text_of("<article>" + "<p>" * 100000 + "x") == "x"
    assert text_of("<article>" + "<a \"" * 60000 + "x").startswith("<a")
    assert len(text_of("<article><p>" + "word " * 400000)) == 5 * 400000 - 1
    assert text_of("<article>" + "<b>" * 5000 + "x") == "x"


def words(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n))


def unlabelled(r, k, n=3):
    """A page whose article no element names."""
    links = "".join(f"<li><a href=/{x}>{words(r, 1)}</a></li>" for x in range(3 + k % 3))
    body = "".join(f"<p>{words(r, 20)}</p>" for _ in range(n + k % 2))
    return (f"<html><body><div class=x1><ul>{links}</ul></div><div class=x2>Best prices this week</div><div class=x7><h1>{words(r, 4)}</h1>"
            f"<p>Sign our list to read on.</p>{body}</div><div class=x9>About this site {words(r, 2)}</div></body></html>")


def test_a_template_is_deduced(spark):
    r = random.Random(1)
    pages = [unlabelled(r, k) for k in range(40)]
    table = spark.createDataFrame([(k, "http://H.example/" + str(k), p) for k, p in enumerate(pages)], SCHEMA).repartition(4)
    got = {x.page_id: x.text for x in H.extract(table).collect()}
    for k, page in enumerate(pages):
        want = [b.text for b in H.read_page(page).blocks if b.path.endswith(("/h1", "/p"))]
        assert got[k] == "\n".join(t for t in want if t != "Sign our list to read on.")
    template = H.deduce_templates(table.select(H.host_of(table["url"]).alias("host"), "html")).collect()[0]
    assert template.pages == 40 and template.host == "h.example" and template.main.endswith("/div.x7")


def plain_classes(pages):
    """Occurrence vectors in plain Python: classes of tokens that stand equally often in every page."""
    counts = [Counter([H.hashed(t) for t in p.tags] + [H.hashed(b.path, b.text) for b in p.blocks]) for p in map(H.read_page, pages)]
    vectors = defaultdict(set)
    for token in set().union(*counts):
        vector = tuple(c[token] for c in counts)
        if sum(v > 0 for v in vector) >= H.MIN_SHARE * len(pages):
            vectors[vector].add(token)
    return [(v, t) for v, t in vectors.items() if len(t) >= H.MIN_CLASS]


def test_classes_and_their_nesting(spark):
    r = random.Random(2)
    pages = [unlabelled(r, k) for k in range(24)]
    template = H.deduce_templates(spark.createDataFrame([("h", p) for p in pages], "host string, html string").repartition(3)).collect()[0]
    want = plain_classes(pages)
    assert sorted(c["size"] for c in template.classes) == sorted(len(t) for _, t in want)
    root = next(t for v, t in want if set(v) == {1})
    assert set(template.template) <= root and len(template.template) == 2
    inner = {c["path"].rsplit("/", 1)[-1] or "": c["parent"] for c in template.classes if c["parent"] != c["path"]}
    assert any(p and p.endswith("/ul") for p in inner.values()) or any(c["parent"] and c["parent"].endswith("/ul") for c in template.classes)


def test_copies_do_not_become_a_template(spark):
    r = random.Random(3)
    shared = "<article><h1>The same article</h1><p>Told again and again.</p></article>"
    rows = [(k, "http://a.example/x", f"<nav>{words(r, 2)}</nav>{shared}") for k in range(300)]
    rows += [(1000 + k, "http://a.example/y", f"<nav>m</nav><article><p>{words(r, 9)}</p></article>") for k in range(15)]
    got = {x.page_id: x.text for x in H.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {got[k] for k in range(300)} == {"The same article\nTold again and again."} and all(got[1000 + k] for k in range(15))


def test_nulls_repeats_clashing_columns_and_empty_table(spark):
    rows = [(1, None, "<article>a</article>", "h", "t", 5), (1, None, "<article>a</article>", "h", "t", 5), (None, "no url", None, None, None, None), (2, "x://", "", "", "", 0)]
    table = spark.createDataFrame(rows, SCHEMA + ", host string, text string, main long")
    assert sorted(((x.page_id or 0, x.text) for x in H.extract(table).collect())) == [(0, ""), (1, "a"), (1, "a"), (2, "")]
    assert H.extract(table.limit(0)).collect() == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables are not here")
def test_query(spark):
    got = queries.QUERIES["op11_html_text"](spark, "/root/testdata/sf0.001")
    assert got.columns[:4] == ["page_id", "url", "text", "n_chars"]
    rows = got.collect()
    source = {x.page_id: x.html for x in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    assert len(rows) == len(source) and all(x.n_chars == len(x.text) > 0 and x.text == text_of(source[x.page_id]) for x in rows)
