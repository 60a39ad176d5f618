import itertools
import random

import numpy as np
import pytest

from quillrank.llm import htmltext as H


def test_marginals_by_enumeration():
    rng = np.random.default_rng(0)
    tree = H.Tree()
    for i, (p, tag) in enumerate([(-1, "html"), (0, "div"), (1, "#"), (1, "p"), (3, "#"), (0, "nav"), (5, "#")]):
        tree.add(p, tag, "", "some words." if tag == "#" else None, 2 if tag == "#" else 0)
    forest = H.Forest([tree, tree])
    w, e = rng.normal(0, 1, len(H.FEATURES)), rng.normal(0, 1, (H.EDGES, 2, 2))
    unary = np.bincount(forest.node, w[forest.feature], len(forest.parent))[:7]
    weights = {}
    for y in itertools.product((0, 1), repeat=7):
        s = sum(unary[i] * y[i] for i in range(7)) + sum(e[forest.edge[i], y[tree.parent[i]], y[i]] for i in range(1, 7))
        weights[y] = np.exp(s)
    total = sum(weights.values())
    p, joint = forest.marginals(w, e)
    for i in range(7):
        assert p[i] == pytest.approx(sum(v for y, v in weights.items() if y[i]) / total) and p[i] == pytest.approx(p[i + 7])
        if i:
            for a in (0, 1):
                for b in (0, 1):
                    assert joint[i, a, b] == pytest.approx(sum(v for y, v in weights.items() if y[tree.parent[i]] == a and y[i] == b) / total)


def test_held_out_pages():
    rng = random.Random(777)
    trees = [H.labelled_tree(H.labelled_page(rng)) for _ in range(150)]
    forest = H.Forest(trees)
    p, _ = forest.marginals(*H.trained())
    right = (p[forest.run] >= 0.5) == (forest.label[forest.run] == 1)
    assert right.mean() > 0.98


PAGE = """<!DOCTYPE html><html><head><title>t &amp; u</title><style>p{margin:0}</style><script>var t="</p><article>no</article>";</script></head><body>
<nav><ul><li><a href="/a">a</a><li><a href="/b">b</a></ul></nav><!-- <p>hidden</p> --><div class="ad">Buy now and here.</div>
<article><h1>A &lt;title&gt; of it</h1><p><b>First   par&eacute;graph\n of <i>some</i>thing<br>long enough to read on and on.<br><p>Second &#8220;one&#8221; with more words, and more of them too.</p>
<form><p>Subscribe to us</p><input></form><ul><li>item one is here<li>item two is there</ul></article>
<section class="comments"><p>Reader says that this is nonsense of a kind.</p></section><footer>&copy; us &middot; all rights</footer></body></html>"""


def test_a_page():
    assert H.main_texts([PAGE], H.trained())[0].split("\n\n") == [
        "A <title> of it", "First parégraph of something long enough to read on and on.", "Second “one” with more words, and more of them too.", "item one is here", "item two is there"]


def test_odd_pages(spark):
    odd = [None, "", "just text", "<", "<p", "<p>a<p>b</div></div></p></p>", "<div " + "a" * 5000, "<script>alert(1)", "<!-- never closed", "<a><a><b></i></a>" * 50, "<div>" * 3000 + "deep words here", "<table><tr><td>x<td>y<tr><td>z</table>",
           "&am &amp &#x41; &#99999999;", "<p title=\"a>b\" class='x>y'>quoted</p>", "\x00<p>\x00", "<article><p>" + "long text of the page. " * 40000 + "</p></article>", PAGE, PAGE]
    df = spark.createDataFrame([(i % 16 if i != 3 else None, None if i == 4 else f"u{i}", h) for i, h in enumerate(odd)], "page_id long, url string, html string").selectExpr("*", "'x' as text", "1 as n_chars", "2 as tag")
    got = H.extract_main_text(df).collect()
    assert len(got) == len(odd) and all(r["n_chars"] == len(r["text"]) for r in got)
    by = {r["url"]: r["text"] for r in got}
    assert by["u0"] == by["u1"] == "" and by["u16"] == by["u17"] and by["u16"].startswith("A <title>")
    assert by["u15"] == ("long text of the page. " * 40000).strip()
    assert H.extract_main_text(df.where("false")).count() == 0


def test_tables_and_lists_close_by_themselves():
    tree = H.parse("<table><tr><td>x<td>y<tr><td>z</table><ul><li>a<ul><li>b</ul><li>c</ul><p>d<div>e</div>")
    assert [t for t in tree.text if t] == list("xyzabcde")
    a, b, c = (tree.text.index(x) for x in "abc")
    assert tree.parent[tree.parent[a]] == tree.parent[tree.parent[c]] and tree.parent[tree.parent[tree.parent[b]]] == tree.parent[a]


def test_hostile_pages_take_linear_time():
    import time

    for page in ("<div>" * 60_000 + "</section>" * 60_000, "<a " * 300_000, "<ul>" + "<div><li>x</li>" * 50_000, "<p>words here " * 60_000):
        began = time.time()
        H.Forest([H.parse(page)])
        assert time.time() - began < 20  # the quadratic walks took minutes


def test_tail_without_a_closing_bracket():
    tree = H.parse("<p>one two</p> three <a href='x' <!-- hidden")
    assert " ".join(x for x in tree.text if x) == "one two three <a href='x'"
    assert [x for x in H.parse("<div>a</section></div></div>b").text if x] == ["a", "b"]
