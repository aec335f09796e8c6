"""Operator 5: the index's places against a reading of every place of every text."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import licenses
from threadloom.llm.work import table

KNOWN = licenses.templates()


def read_all(words, t):
    """Place -> share, over all places at which the template may begin."""
    n, g = len(t.words), t.slack
    good = {}
    for s in range(-n, len(words) + n):
        held = sum(t.words[i] in words[max(0, s + i - g) : max(0, s + i + g + 1)] for i in range(n))
        span = words[max(0, s - g) : max(0, s + n + g)]
        if held >= t.needed and all(any(tuple(span[j : j + len(key)]) == key for j in range(len(span))) for key in t.keys):
            good[s] = held / n
    out, near = {}, []
    for s in sorted(good):
        if near and s - near[-1] > g:
            out[max(near, key=lambda x: (good[x], -x))] = max(good[x] for x in near)
            near = []
        near.append(s)
    if near:
        out[max(near, key=lambda x: (good[x], -x))] = max(good[x] for x in near)
    return out


def damaged(rng, words):
    words = list(words)
    for _ in range(rng.integers(0, 1 + len(words) // 4)):
        at = int(rng.integers(0, len(words)))
        kind = rng.integers(0, 3)
        if kind == 0 and len(words) > 1:
            del words[at]
        elif kind == 1:
            words.insert(at, b"the")
        else:
            words[at] = b"other"
    return words


def test_places_are_those_of_a_whole_reading():
    rng = np.random.default_rng(5)
    common = [b"the", b"of", b"and", b"software", b"license", b"public", b"by", b"cc"]
    some = [common[k] for k in rng.integers(0, len(common), 30)]
    hit = 0
    for k in range(160):
        t = KNOWN[k % len(KNOWN)]
        words = some[: rng.integers(0, 30)] + damaged(rng, t.words) + some[: rng.integers(0, 30)]
        index = licenses.Index(KNOWN, {b"the": 90, b"software": 50, b"license": 40}, 100)
        got = index.places(words)
        near = [j for j, u in enumerate(KNOWN) if len(u.words) < 40 or u is t]
        want = {j: p for j in near if (p := read_all(words, KNOWN[j]))}
        assert {j: got[j] for j in got if j in near} == {j: {s: pytest.approx(v) for s, v in p.items()} for j, p in want.items()}
        hit += (k % len(KNOWN)) in want
    assert 60 < hit < 160


def test_words_put_in_and_left_out():
    text = dict((label, words) for label, words, _ in licenses.NOTICES)["bsd-3-clause"].split()
    for at in (15, 60, 110):
        text.insert(at, "hereby")
    del text[100]
    found = licenses.Index(KNOWN, {}, 1).places([w.encode() for w in text])
    assert "bsd-3-clause" in {KNOWN[k].label for k in found}
    assert "mit" not in {KNOWN[k].label for k in found}


def test_notices_of_all_documents(spark):
    """Every registered row's labels and score, against whole readings of the documents that hold a key phrase."""
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    short = [t for t in KNOWN if len(t.words) < 40]
    seen = 0
    for r in docs.collect():
        words = licenses.words_of(r.text)
        joined = b" ".join(words)
        want, best = set(), 0.0
        for t in short:
            if any(b" ".join(k) in joined for k in (t.keys or (t.words,))) and (p := read_all(words, t)):
                want.add(t.label)
                best = max(best, *p.values())
        assert ",".join(sorted(want)) == got[r.doc_id].labels and got[r.doc_id].score == pytest.approx(best)
        seen += bool(want)
    assert seen


def test_other_notices_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "Alpha beta gamma delta."), (2, None)], "doc_id long, text string").withColumn("labels", F.lit("mine")).withColumn("score", F.lit("x"))
    got = {r.doc_id: r for r in licenses.scan(df, notices=[("own", "alpha beta gamma delta", ["beta gamma"])]).collect()}
    assert (got[1].labels, got[1].score, got[2].labels, got[2].score) == ("own", 1.0, "", 0.0)
