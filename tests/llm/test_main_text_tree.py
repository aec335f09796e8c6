"""Operator 4: what the tree decides by, and pages that container names alone get wrong."""

from threadloom.llm import html_blocks

LINE = "The council met on Monday and spoke for a long time about the new bridge, its cost, the road that leads to it, the trees beside that road, and the people who live there."


def used(node):
    return {html_blocks.FEATURES[node.feature]} | used(node.left) | used(node.right) if isinstance(node, html_blocks.Node) else set()


def verdicts(node):
    return verdicts(node.left) | verdicts(node.right) if isinstance(node, html_blocks.Node) else {node}


def test_tree_uses_all_features():
    tree = html_blocks.tree()
    assert used(tree) == set(html_blocks.FEATURES)
    assert all(html_blocks.decide(tree, r) == bool(r[-1]) for r in html_blocks.labelled())
    by_container = [{html_blocks.decide(tree, r) for r in html_blocks.labelled() if r[0] == c} for c in (html_blocks.OUT, html_blocks.DOUBT, html_blocks.NEUTRAL, html_blocks.IN)]
    assert by_container == [{False, True}] * 4


def test_boilerplate_without_links():
    for name in ('class="legal"', 'id="bottom"'):
        assert html_blocks.main_text(f"<div><p>{LINE}<p>{LINE}</div><div {name}>Copyright 2024 Example Company. All rights reserved.</div>") == f"{LINE} {LINE}"


def test_text_in_oddly_named_containers():
    for name in ("no-sidebar", "with-sidebar", "social-post", "content-sidebar-wrap"):
        assert html_blocks.main_text(f'<div class="{name}"><h1>Bridge news</h1><p>{LINE}<p>It was late.<p>{LINE}</div>') == f"Bridge news {LINE} It was late. {LINE}"
    assert LINE in html_blocks.main_text(f'<div class="social"><p>{LINE} {LINE}<p>{LINE} {LINE}<p>{LINE} {LINE}</div>')


def test_link_lists_in_a_wide_wrapper():
    assert html_blocks.main_text(f'<div class="content"><ul><li><a href="/">Home</a><li><a href="/n">News</a></ul><h1>Bridge news</h1><p>{LINE}</div>') == f"Bridge news {LINE}"


def test_quotes_within_values():
    assert html_blocks.main_text(f"<article><p title=it's>{LINE}<p title=it's>Two.</article>") == f"{LINE} Two."
    assert html_blocks.main_text(f"<article><p title='a > b' id = \"x's\">{LINE}<p data-x='>Two.</article>") == f"{LINE} Two."


def test_optional_tags_left_out():
    assert html_blocks.main_text(f"<!doctype html><title>no</title><h1>Bridge news</h1><p>{LINE}<p>{LINE}") == f"Bridge news {LINE} {LINE}"
    assert html_blocks.main_text(f'<div class="post no-comments"><p>{LINE}</div>') == LINE
    assert html_blocks.main_text(f'<div class="content has-sidebar"><p>{LINE}</div>') == LINE
