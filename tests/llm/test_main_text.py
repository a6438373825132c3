"""Main texts of pages, and the messages against sums over all labellings."""

import html
import itertools
import random
import re

import numpy as np
import pytest

from quernwork.llm import main_text as module
from quernwork.llm.dom import KINDS, Forest, Tree, blocks
from quernwork.llm.labelled_pages import composed, self_labelled
from quernwork.llm.main_text import Model, fit, labelled, learned, main_text, texts_of


@pytest.fixture(scope="module")
def model():
    return fit(labelled([]))


def by_brute_force(model, forest, features):
    """Marginals as sums over every labelling of the tree."""
    n, total, of = len(forest.parent), 0.0, np.zeros(len(forest.parent))
    own = features @ model.weights
    for labels in itertools.product((0, 1), repeat=n):
        score = sum(own[i] for i in range(n) if labels[i])
        for i in range(n):
            if forest.parent[i] >= 0:
                score += model.edges[forest.kind[i], labels[forest.parent[i]], labels[i]]
        weight = np.exp(score)
        total += weight
        of += weight * np.array(labels)
    return of / total


def test_messages_give_exact_marginals():
    rng = np.random.default_rng(2)
    page = "<div><p>a, b<b>c</b></p><ul><li>d<li><a>e</a></ul></div><nav>f<p>g</nav>"
    forest = Forest([Tree(page)])
    features = forest.features()
    model = Model(rng.normal(size=features.shape[1]), rng.normal(size=(len(KINDS), 2, 2)))
    assert np.allclose(model.marginals(forest, features), by_brute_force(model, forest, features))
    # Several trees at once are as each alone.
    both = Forest([Tree(page), Tree("<p>x"), Tree(page)])
    got = model.marginals(both, both.features())
    alone = model.marginals(forest, features)
    assert np.allclose(got[: len(alone)], alone) and np.allclose(got[-len(alone) :], alone)


def test_fit_climbs_the_likelihood():
    trees = [Tree(p) for p in composed(30, 4)]
    forest = Forest(trees)
    got = fit(trees).marginals(forest, forest.features()) >= 0.5
    assert (got == forest.label).mean() > 0.97


def test_held_out_labelled_pages(model):
    forest = Forest([Tree(p) for p in composed(200, 99)])
    got = model.marginals(forest, forest.features()) >= 0.5
    assert ((got == forest.label) * forest.chars).sum() / forest.chars.sum() > 0.97


def said(page):
    """The article of a page of the table, by its markup alone."""
    inside = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    parts = [html.unescape(re.sub(r"<[^>]*>", " ", p)) for p in re.split(r"<p>|</p>|</h1>", inside)]
    return "\n".join(" ".join(p.split()) for p in parts if p.split())


def test_all_pages_of_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = main_text(pages, "html", learned(pages, "html")).collect()
    want = {r["page_id"]: said(r["html"]) for r in pages.collect()}
    assert {r["page_id"]: r["text"] for r in rows} == want
    assert all(r["n_chars"] == len(r["text"]) and r["url"] for r in rows)


ARTICLE = "One, two and three, they went to the hill. It was late, and the rain, at last, had come."
COMMENT = "I do not think so, to be honest. They never went there, and nobody saw them, at all."


@pytest.mark.parametrize(
    "around",
    [
        '<article><p>{a}</p><p>{b}</p><section id="comments"><div class="comment"><p>{c}</p></div></section></article>',
        '<main><p>{a}</p><p>{b}</p></main><div class="comments"><p>{c}</p></div>',
        '<div class="post-content"><p>{a}</p><div class="ad">{c}</div><p>{b}</p></div><div class="sidebar"><p>{c}</p></div>',
        '<div class="cookie-consent"><p>{c}</p></div><article><p>{a}<p>{b}</article><footer><p>{c}</p></footer>',
        "<header><p>{c}</p></header><article><div><p>{a}</p></div><div><p>{b}</p></div></article><aside><p>{c}</p></aside>",
        "<form><p>{c}</p></form><article><p>{a}</p><script>{c}</script><style>{c}</style><p>{b}</p></article>",
    ],
)
def test_what_is_not_the_article_goes(model, around):
    page = "<html><body><nav><a href=/x>Home</a></nav>" + around.format(a=ARTICLE, b=ARTICLE[::1], c=COMMENT)
    assert texts_of([page], model) == [f"{ARTICLE}\n{ARTICLE}"]


def test_white_space_references_and_blocks(model):
    page = (
        "<article><h1> A &amp; B </h1><p>one&nbsp;two\n\t three<br>four <b>fi</b>ve &lt;six&gt; &eacute;&#233;&copy seven, eight."
        "<p>an<i>other</i> line, and more, to end it.</article>"
    )
    want = "A & B\none two three four five <six> éé© seven, eight.\nanother line, and more, to end it."
    assert texts_of([page], model) == [want]


def test_malformed_pages(model):
    rnd = random.Random(1)
    bits = ["<p>", "</p>", "<", "<!--", "-->", "<![CDATA[", "]]>", "<![if", "<!", "<?x", "&am", "&#x", "<b", "</", "<a href='", '"', ">",
            "<script>", "</script>", "<table><tr><td>", "</div>", "text, words.", "<li>", "<![endif]-->", "\x00", "<svg>", "<textarea>"]
    pages = ["".join(rnd.choices(bits, k=rnd.randint(1, 60))) for _ in range(2000)]
    assert len(texts_of(pages, model)) == 2000
    assert texts_of(["", " ", "<p>", "<html></html>"], model) == [""] * 4


def test_deep_and_long_pages(model):
    body = " ".join(f"word{i}, and" for i in range(60_000)) + "."
    deep = "<article>" + "<div><b>" * 20_000 + f"<p>{ARTICLE}</p>"
    long, far = texts_of([f"<article><p>{body}</p></article>", deep], model)
    assert long == body and far in ("", ARTICLE)
    many = "".join(f"<p>{i}: {ARTICLE}" for i in range(5000))
    assert texts_of([f"<body><article>{many}</article>"], model)[0].count("\n") == 4999


def test_elements_that_end_others():
    tree = Tree("<ul><li>a<ul><li>b</ul><li>c</ul><table><tr><td>d<td>e<tr><td>f</table><p>g<div>h</div>i<dl><dt>j<dd>k</dl><p>l</b>m")
    lines = blocks(tree.texts, [True] * len(tree.tags))
    assert lines == "a\nb\nc\nd\ne\nf\ng\nh\ni\nj\nk\nlm"


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(module, "PAGES", 2)
    page = f"<body><article><p>{ARTICLE}</p></article><footer>F</footer>"
    rows = [(1, "u", page, "x", 5), (1, "u", page, "x", 5), (2, None, None, None, None), (None, "v", "", "y", 1), (3, "w", "<nav>n", "z", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, page string, n_chars long")
    got = main_text(df, "html", learned(df, "html"))
    assert got.columns == ["page_id", "url", "page", "text", "n_chars"]
    found = sorted((tuple(r) for r in got.collect()), key=str)
    want = [(1, "u", "x", ARTICLE, len(ARTICLE))] * 2 + [(2, None, None, "", 0), (3, "w", "z", "", 0), (None, "v", "y", "", 0)]
    assert found == sorted(want, key=str)
    none = df.where("page_id < 0")
    assert main_text(none, "html", learned(none, "html")).collect() == []


def test_the_sample_is_bounded_and_the_same(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(module, "fit", lambda trees: seen.append(len(trees)))
    monkeypatch.setattr(module, "labelled", lambda pages: seen.append(sorted(pages)) or [])
    rows = [(i, f"<article><p>{i % 70}") for i in range(500)] + [(999, "<article>" + "x" * 500)]
    df = spark.createDataFrame(rows, "page_id long, html string")
    learned(df, "html", 20, 100)
    learned(df.repartition(7), "html", 20, 100)
    assert len(seen[0]) == 20 and seen[0] == seen[2]


def test_pages_label_themselves():
    tree = self_labelled("<body><p>x</p><article><p>y</p><div class=comments>z</div></article>")
    texts = {t: tree.label[node] for _, node, t in tree.texts}
    assert texts == {"x": 0, "y": 1, "z": 0}
    assert self_labelled("<article></article><article></article>") is None
    assert self_labelled("<p>x") is None
