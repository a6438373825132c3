"""Labelled pages to learn from.

Pages of a crawl label themselves where their own sections say what is the article. What
such pages may lack (comments, notices, forms, sections without a name) is in pages that
are put together here from labelled pieces, the same ones each time.
"""

from __future__ import annotations

import random

from quernwork.llm.dom import GROUPS, Tree

# Pages that are put together.
COMPOSED = 480
# Elements that are no main text, also within the article, and names that say so.
ASIDE = {"nav", "header", "footer", "aside", "form", "dialog"}
NOT_MAIN = sum(1 << i for i, name in enumerate(GROUPS) if name != "content")
SECTIONS = {"article", "main", "section", *ASIDE}

# Fixed pieces; S stands for sentences, W for a few words.
AROUND_MAIN = [
    '<article data-main="1">{}</article>',
    '<main data-main="1"><article>{}</article></main>',
    '<div class="content" data-main="1">{}</div>',
    '<div id="main"><div class="post-body" data-main="1">{}</div></div>',
    '<div class="entry-content" data-main="1">{}</div>',
    '<section class="story" data-main="1">{}</section>',
    '<div data-main="1">{}</div>',
    '<div><div data-main="1">{}</div></div>',
    '<table><tr><td data-main="1">{}</td></tr></table>',
]
MAIN = [
    "<p>S S S</p>", "<p>S</p>", "<p>W.</p>", "<h2>W</h2>", "<h3>W</h3>", "<ul><li>S</li><li>S</li></ul>",
    "<ol><li>W</li><li>W</li></ol>", "<blockquote><p>S S</p></blockquote>",
    '<p>S <a href="/x">W</a> S <b>W</b> S</p>', '<p><a href="/x">W</a></p>', "<pre>S S</pre>",
    "<table><tr><td>W</td><td>S</td></tr></table>", "<figure><figcaption>S</figcaption></figure>",
    "<div>S S</div>", "<p><em>S</em> S S S</p>", "<dl><dt>W</dt><dd>S</dd></dl>", "<div><p>S S</p><p>S</p></div>",
    "<p><b>S S<br>", "<div><p>S S</p></div>", "<div><p>S</p></div>", "<section><h2>W</h2><p>S S</p></section>", "S S S<br>S",
]
BEFORE = [
    '<nav><ul><li><a href="/a">W</a></li><li><a href="/b">W</a></li><li><a href="/c">W</a></li></ul></nav>',
    '<div class="menu"><a href="/a">W</a> <a href="/b">W</a> <a href="/c">W</a></div>',
    '<ul id="navbar"><li><a href="/a">W</a></li><li><a href="/b">W</a></li></ul>',
    '<ul><li><a href="/a">W</a></li><li><a href="/b">W</a></li><li><a href="/c">W</a></li></ul>',
    '<div class="breadcrumbs"><a href="/a">W</a> &gt; <a href="/b">W</a></div>',
    "<header><h1>W</h1><p>S</p></header>", '<div id="header"><h1>W</h1>W</div>', '<div class="masthead">W</div>',
    '<div class="cookie-notice"><p>S S</p><button>W</button></div>', '<div role="alert">S</div>',
    '<div id="consent-banner"><p>S</p></div>', '<div class="ad">S</div>', '<div class="sponsored"><p>S S</p></div>',
    '<ins class="adsbygoogle">W</ins>', '<form><label>W</label><input><p>W</p></form>',
    '<div class="search"><form>W</form></div>', '<div class="newsletter"><p>S</p><form>W</form></div>',
]
AFTER = [
    "<aside><h3>W</h3><p>S S</p></aside>", '<div class="sidebar"><h3>W</h3><p>S</p><ul><li><a href="/a">W</a></li></ul></div>',
    '<div class="related"><h3>W</h3><a href="/a">W</a> <a href="/b">W</a></div>', '<div class="widget"><p>S S</p></div>',
    '<section id="comments"><h3>W</h3><div class="comment"><b>W</b><p>S S</p></div><div class="comment"><p>S S S</p></div></section>',
    '<div class="comments"><p>S S S</p><p>S S</p></div>',
    '<ol class="commentlist"><li class="comment"><p>S S</p></li><li class="comment"><p>S</p></li></ol>',
    '<div id="disqus_thread"><p>S S</p></div>', "<footer>&copy; W &middot; S</footer>", "<footer><p>S S</p></footer>",
    '<div class="footer">W | <a href="/a">W</a></div>', '<div id="copyright">W</div>',
    '<p><a href="/a">W</a> | <a href="/b">W</a> | <a href="/c">W</a></p>', '<div class="promo"><p>S</p></div>',
    '<form><label>W</label><textarea></textarea></form>', '<div class="modal"><p>S</p></div>',
]
WITHIN = [
    '<div class="share" data-main="0"><a href="/a">W</a> <a href="/b">W</a></div>',
    '<aside data-main="0"><p>S</p></aside>', '<div class="ad" data-main="0">S</div>',
    '<div class="advertisement" data-main="0"><p>S S</p></div>', '<footer data-main="0"><p>W</p></footer>',
    '<nav data-main="0"><a href="/a">W</a> <a href="/b">W</a></nav>', '<header data-main="0"><p>W</p></header>',
    '<div class="newsletter-signup" data-main="0"><p>S</p></div>', '<form data-main="0"><p>W</p></form>',
    '<div class="comments" data-main="0"><p>S S</p><p>S</p></div>', '<div class="related" data-main="0"><a href="/a">W</a></div>',
    '<section class="comments" data-main="0"><div class="comment"><p>S S</p></div></section>',
]


def _filled(piece: str, rnd: random.Random) -> str:
    def words(n: int) -> str:
        return " ".join("".join(rnd.choices("etaoinsrhl", k=rnd.randint(2, 9))) for _ in range(n))

    def sentence() -> str:
        first, rest = words(rnd.randint(4, 12)), words(rnd.randint(3, 9))
        return f"{first.capitalize()}, {rest}."

    parts = [sentence() if c == "S" else words(rnd.randint(1, 4)).title() if c == "W" else c for c in piece]
    return "".join(parts)


def composed(pages: int = COMPOSED, seed: int = 12) -> list[str]:
    """Pages of labelled pieces, the labels in ``data-main``; the same for the same seed."""
    rnd, out = random.Random(seed), []
    for _ in range(pages):
        inside = [rnd.choice(MAIN) for _ in range(rnd.randint(1, 9))]
        if rnd.random() < 0.7:
            inside.insert(0, "<h1>W</h1>")
        for _ in range(rnd.randint(0, 2)):
            inside.insert(rnd.randint(1, len(inside)), rnd.choice(WITHIN))
        main = rnd.choice(AROUND_MAIN).format("".join(inside))
        before = "".join(rnd.sample(BEFORE, rnd.randint(1, 4)))
        after = "".join(rnd.sample(AFTER, rnd.randint(1, 4)))
        if rnd.random() < 0.3:
            before, after = f"<div>{before}</div>", f"<div>{after}</div>"
        # Names of attributes have letters that stand for text in lower case only.
        out.append(f"<html><body>{_filled(before + main + after, rnd)}</body></html>")
    return out


def self_labelled(page: str) -> Tree | None:
    """The tree of a page whose only ``article``, or else ``main``, is its main text; or None.

    Sections within it that are by their tag or name something else are not main text.
    """
    tree = Tree(page)
    for name in ("article", "main"):
        if tree.tags.count(name) == 1:
            break
    else:
        return None
    for i in range(1, len(tree.tags)):
        label = tree.label[tree.parent[i]] or tree.tags[i] == name
        tree.label[i] = int(label and tree.tags[i] not in ASIDE and not tree.said[i] & NOT_MAIN)
    return tree


def nameless(tree: Tree) -> Tree:
    """The tree with all sections as plain ``div`` without names, its labels kept."""
    tree.tags = ["div" if t in SECTIONS else t for t in tree.tags]
    tree.said = [0] * len(tree.said)
    return tree
