"""Operator 4: elements whose content is no text, with tags left out or closed in themselves."""

import pytest

from threadloom.llm.html_blocks import main_text


@pytest.mark.parametrize("page", [
    "<article><p>One here.<svg width='4'/><p>Two here.</article>",
    "<article><p>One here.<canvas/><p>Two here.<canvas>no</canvas></article>",
    "<article><p>One here.<svg/><p>Two here.<svg><text>no</text></svg></article>",
    "<article><p>One here.<svg><g><p>Two here.</article>",
    "<article><p>One here.<video src=a><p>Two here.<video src=b>no</video></article>",
    "<article><p>One here.<iframe src=http://x/>no</iframe><p>Two here.</article>",
    "<article><p>One here.<iframe src='x'/><p>Two here.</article>",
    "<article><p>One here.<noscript><p>Two here.</article>",
    "<article><p>One here.<template>no<template>no</template>no</template><p>Two here.</article>",
    "<article><p>One here.<object><select>no</select>no</object><p>Two here.</article>",
    "<article><p>One here.<script>var t = '<svg>';</script><p>Two here.<svg>no</svg></article>",
    "<article><p>One here.<!-- <svg> --><p>Two here.<style>p{}",
    "<!doctype html><head><title>no</title><p>One here.<p>Two here.",
    "<!doctype html><html><head><meta charset=utf-8><title>no<link rel=x><style>no</style><p>One here.<p>Two here.",
    "<head><script>no<body><p>One here.<p>Two here.",
])
def test_only_what_is_hidden_goes(page):
    assert main_text(page) == "One here. Two here."
