"""Main text: exact marginals, held-out pages, mark-up not seen in training."""

import html
import itertools
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from profilar.llm import main_text
from profilar.llm.page_tree import read_page


@pytest.fixture(scope="module")
def pages(spark, docs):
    return spark.read.parquet("/root/testdata/sf0.01/pages.parquet")


@pytest.fixture(scope="module")
def model(pages):
    return main_text.learn(pages, sample=60)


def plain(source):
    """Text of the article by its mark alone."""
    inner = source[source.find("<article>"):source.find("</article>")]
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", inner)]
    return "\n".join(b for b in blocks if b)


def test_pages(pages, model):
    rows = main_text.extract(pages, model).collect()
    assert len(rows) == pages.count()
    assert np.mean([r["text"] == plain(r["html"]) for r in rows]) > 0.98


def test_few_pages_mark_an_article(spark, pages):
    marked = [r["html"] for r in pages.limit(8).collect()]
    plain_pages = [f"<html><body><div>menu {k}</div><div>Some words of page {k}.</div></body></html>" for k in range(120)]
    rows = spark.createDataFrame([(s,) for s in marked + plain_pages + [plain_pages[0], marked[0]]], "html string")
    found = main_text.learn(rows, sample=8)
    assert np.array_equal(found.weights, main_text.learn(pages.limit(8), sample=8).weights) and len(found.features) > 1


def test_marginals_by_enumeration(model):
    page = read_page("<body><nav><a href=x>one</a></nav><div><p>Some words here.<p>more</div></body>")
    forest = main_text.Forest([page], model.features)
    found, pairs = forest.marginals(model.weights, model.ties, with_pairs=True)
    n, own = len(page.parent), np.bincount(forest.node, model.weights[forest.feature], len(page.parent))
    mass, content, both = 0.0, np.zeros(n), np.zeros(n)
    for labels in itertools.product((0, 1), repeat=n):
        value = sum(own[k] for k in range(n) if labels[k])
        value += sum(model.ties[forest.kind[k], labels[page.parent[k]], labels[k]] for k in range(1, n))
        weight = np.exp(value)
        mass += weight
        content += weight * np.array(labels)
        both += weight * np.array([labels[k] and labels[page.parent[k]] for k in range(n)])
    assert found == pytest.approx(content / mass)
    assert pairs[1:, 1, 1] == pytest.approx(both[1:] / mass)


UNSEEN = [
    ('<html><body><div id="top"><a href=/>Home</a> <a href=/b>Blog</a></div><div class="container"><div class="left-column">'
     '<h1>My title here</h1><p>First paragraph of the text, with <a href="x">a link</a> inside and more words.</p>'
     '<p>Second one is here too.</p><ul><li>An item in the article body</li></ul></div><div class="right-column sidebar">'
     '<h4>Popular</h4><ul><li><a href=1>One story</a></li></ul></div></div><div class="comments-area"><h3>2 Comments</h3>'
     '<p>I really like this post, thank you for writing it.</p></div><div class="footer">Copyright 2020 Site</div></body></html>',
     "My title here\nFirst paragraph of the text, with a link inside and more words.\nSecond one is here too.\n"
     "An item in the article body"),
    ('<body><main id="main"><section><h2>Heading</h2><p>Tom &amp; Jerry&nbsp;went   home\n to eat.</p><blockquote>A quoted sentence '
     'stands here as well.</blockquote><aside><p>Subscribe to our newsletter today.</p></aside><p>Final words.</p></section></main>'
     '<div class="cookie-banner"><p>We use cookies to improve this site.</p><button>Accept</button></div></body>',
     "Heading\nTom & Jerry went home to eat.\nA quoted sentence stands here as well.\nFinal words."),
]


@pytest.mark.parametrize("source,want", UNSEEN)
def test_unseen_markup(model, source, want):
    assert model.texts([source]) == [want]


def test_tree_of_broken_markup():
    page = read_page("<!-- x --><p>a<b>b<p>c</i>d<script>if (a<b) '</p>'</script><li>e<li>f<br>g</ul>&lt;h <3 <span hidden>no</span>"
                     "<style>p{}</style><div style='display: none'>no</div><td>i<!-- unclosed")
    assert [t for t in page.text if t] == ["ab", "cd", "e", "f", "g<h <3", "i"]


def test_edges(spark, model):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "<html>"), (4, "u", "<" * 5000), (5, None, "<div>" * 3000 + "deep"),
            (6, "u", "<article><p>" + "long text. " * 20_000), (6, "u", "<article><p>" + "long text. " * 20_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = main_text.extract(df, model).collect()
    assert len(found) == len(rows) and all(r["text"] is not None for r in found)
    assert [r["text"] for r in found if r["page_id"] < 4] == ["", "", ""]
    assert {len(r["text"]) for r in found if r["page_id"] == 6} == {len(("long text. " * 20_000).strip())}
    empty = df.where("false")
    assert main_text.extract(empty, main_text.learn(empty)).count() == 0


def test_depth_costs_in_proportion(model):
    began = time.process_time()
    for tag in ("div", "li", "p><b", "span"):
        assert model.texts([f"<{tag}>" * 20_000 + "a sentence that ends the page."])[0] in ("", "a sentence that ends the page.")
    assert time.process_time() - began < 60  # scanning all open tags for each took longer by far


def test_training_pages_are_those_of_least_hash_among_the_marked(spark, monkeypatch):
    page = lambda k: f"<html><{'article' if k % 40 == 0 else 'div'}><p>Page {k} has a text.</p></html>"
    df = spark.createDataFrame([(page(k),) for k in range(2000)] + [(page(0),)] * 50 + [(None,)], "html string")
    taken = []
    monkeypatch.setattr(main_text, "train", taken.append)
    for sample in (3, 20, 128):  # more than there are: all
        main_text.learn(df, sample=sample)
        rows = df.distinct().where("html LIKE '%<article>%'").select("html", F.xxhash64("html").alias("h")).collect()
        least = sorted(rows, key=lambda r: r["h"] % 2 ** 64)[:sample]
        assert {r["html"] for r in least} == set(taken[-1])
