"""Operator 4: comments, footers, adverts and notices after an article, and a held-out table of blocks."""

import pytest

from threadloom.llm.html_blocks import main_text

LINE = "The council met on Monday and spoke for a long time about the new bridge, its cost, the road that leads to it, the trees beside that road, and the people who live there."
LONG = f"{LINE} {LINE} {LINE}"
HEAD = f"<h1>Bridge news</h1><p>{LINE}</p><p>{LONG}</p>"
TEXT = f"Bridge news {LINE} {LONG}"


@pytest.mark.parametrize("after", [
    f'<div class="comments"><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div>',
    f'<section id="comments" class="comment-list"><article class="comment"><p>{LONG}</p></article><article class="comment"><p>{LONG}</p></article></section>',
    f"<footer><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></footer>",
    f'<div class="site-footer"><p>{LONG}</p><p>{LONG}</p></div>',
    '<div class="legal"><p>Copyright 2024 Example Inc. All rights reserved. Terms apply.</p></div>',
    f'<div class="sponsor-box"><p>{LINE}</p><p>{LINE}</p></div>',
    f'<div class="ad-slot"><div><p>{LONG}</p><p>{LONG}</p></div></div>',
    f'<div class="cookie-banner"><p>{LINE}</p></div>',
    f'<div role="contentinfo"><p>{LONG}</p></div>',
    f'<div id="disqus"><p>{LONG}</p><p>{LONG}</p></div>',
    f'<form><p>{LONG}</p></form><aside><p>{LONG}</p><p>{LONG}</p></aside>',
], ids=range(11))
@pytest.mark.parametrize("page", ["<article>{0}</article>{1}", '<div class="post">{0}</div>{1}', "<main>{0}{1}</main>", "<div>{0}</div>{1}"])
def test_what_follows_an_article_is_no_part_of_it(after, page):
    assert main_text(f"<body>{page.format(HEAD, after)}</body>") == TEXT


#: Pages that the tree's table was not made from: element, attributes, text, and whether it is the article's.
HELD_OUT = [
    [("nav", "", "<a>Home</a> <a>News</a> <a>Sport</a>", 0), ("h1", "", "A new bridge", 1), ("p", "", LINE, 1), ("p", "", "It will open in May.", 1), ("p", "", LONG, 1), ("ul", "", "<li><a>More news</a><li><a>Weather</a><li><a>Contact</a>", 0), ("footer", "", "© Town Gazette", 0)],
    [("div", 'class="topbar"', "<a>Sign in</a> | <a>Register</a>", 0), ("div", 'class="entry-content"', f"<h2>Recipe</h2><p>{LINE}</p><ul><li>two eggs<li>some flour<li>a pinch of salt</ul><p>{LINE}</p>", 1), ("div", 'class="share"', "<a>Tweet</a> <a>Mail</a>", 0), ("div", 'class="related"', "<a>Cake</a> <a>Bread</a> <a>Pie</a>", 0)],
    [("div", 'id="page"', f"<h1>Notes</h1><p>{LONG}</p><blockquote>{LINE}</blockquote><p>{LINE}</p>", 1), ("div", 'class="newsletter-widget"', f"<p>Get our letter every week. {LINE}</p>", 0), ("div", 'class="comments-area"', f"<p>Bob: {LONG}</p><p>Eve: {LINE}</p>", 0)],
    [("header", "", "<h1>My site</h1><p>thoughts and things</p>", 0), ("table", "", f"<tr><td>{LINE}</td></tr><tr><td>{LONG}</td></tr>", 1), ("div", 'class="pagination"', "<a>1</a> <a>2</a> <a>next</a>", 0), ("p", 'class="copyright"', "All rights reserved 2023", 0)],
    [("div", 'class="advertisement"', f"<p>{LINE}</p>", 0), ("section", 'class="story"', f"<h1>Story</h1><p>{LINE}</p><figure><figcaption>The bridge at night.</figcaption></figure><p>{LONG}</p>", 1), ("div", 'class="tags"', "<a>bridge</a> <a>town</a>", 0), ("div", 'class="disclaimer"', LINE, 0)],
    [("ul", 'class="breadcrumbs"', "<li><a>Home</a><li><a>Blog</a>", 0), ("div", "", f"<p>{LINE}</p><pre>x = 1</pre><p>{LINE}</p>", 1), ("div", 'class="replies"', f"<p>{LONG}</p>", 0), ("dialog", "", f"<p>{LINE}</p>", 0)],
]


def test_held_out_blocks():
    right = total = 0
    for page in HELD_OUT:
        page = [(e, a, t.replace("council", f"council of block {k}"), keep) for k, (e, a, t, keep) in enumerate(page)]  # no block repeats another
        got = main_text("<body>" + "".join(f"<{e} {a}>{t}</{e}>" for e, a, t, _ in page) + "</body>")
        for e, a, t, keep in page:
            own = main_text(f"<article><{'div' if e in ('nav', 'footer', 'header', 'dialog', 'aside', 'form') else e}>{t}</article>")
            total += 1
            right += (own in got) == bool(keep) if own else not keep
    assert right / total >= 0.95, (right, total)
