"""Phrases: against a plain count, with and without the words that the dictionary leaves to a join."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from threadloom.llm import phrases
from threadloom.llm.queries import QUERIES
from threadloom.llm.work import Scratch, table

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, n string, id string"


def brute(rows, least, inside):
    f, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for n in (1, 2, 3):
                f[lang].update(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
    out = []
    for lang, c in f.items():
        some = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        within = {q for p, a in some.items() if len(p) == 3 for q in (p[:2], p[1:]) if 100 * a >= inside * c[q]}
        best = []
        for p, a in some.items():
            if p not in within:
                score, _, l, r = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, k, p.decode(), -a, l, r, total[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(best), 1)]
    return sorted(out)


def rows_of(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


ODD = [None, "", " . ;", "one", "A b\tC d. a B c e! a b c", "É a b\x01 c a b c", "naïve 漢字 naïve 漢字 naïve 漢字", "x " * 5000, "q\x1cr a b", "long" * 40 + " word " + "long" * 40 + " word"]


@pytest.mark.parametrize("head", [phrases.HEAD_WORDS, 3, 0])
def test_odd_texts(spark, head):
    rows = [(x, lang) for x in ODD for lang in ("en", None, "und", "fr")] * 2
    df = spark.createDataFrame([(k, x, lang, "own", "own") for k, (x, lang) in enumerate(rows)], SCHEMA).repartition(3)
    assert rows_of(phrases.collocations(df, least=2, top=None, head=head)) == brute(rows, 2, 50)


def test_ranges_and_partial_counts_change_nothing(spark, monkeypatch):
    docs = table(spark, SF, "documents")
    want = brute([(r.text, r.lang) for r in docs.select("text", "lang").collect()], 4, 50)
    monkeypatch.setattr(phrases, "RANGE_KEYS", 5000)
    how = {"head": 500, "bits": 7, "words_at_once": 500, "keys_at_once": 10_000}  # so few bits that the filter is full
    assert rows_of(phrases.collocations(docs, least=4, top=None, **how)) == want
    assert rows_of(phrases.collocations(docs, least=4, top=7, **how)) == [x for x in want if x[1] <= 7]


def test_keys_and_runs():
    rng = np.random.default_rng(5)
    ids = rng.integers(0, 5, 4000).astype(np.int32)
    everything = np.full(1 << (phrases.FILTER_BITS - 3), 255, np.uint8)
    for size, seen in ((2, None), (3, everything)):
        pair, third, n = phrases.run_lengths(*phrases.keys_of(ids, seen))
        want = Counter((*ids[k : k + size], 0)[:3] for k in range(len(ids) - size + 1) if (ids[k : k + size] > 0).all())
        keys = [(int(p >> np.uint64(32)), int(p & np.uint64(2**32 - 1)), int(t)) for p, t in zip(pair, third, strict=True)]
        assert keys == sorted(keys) and dict(zip(keys, n.tolist(), strict=True)) == want
        again = phrases.run_lengths(np.tile(pair, 3), np.tile(third, 3), np.tile(n, 3))
        assert (again[0] == pair).all() and (again[2] == 3 * n).all() and len(phrases.run_lengths(pair[:0], third[:0])[0]) == 0
        for x in (pair, third, n.astype(np.uint32), pair[:0]):
            assert (phrases._spread(phrases._squeezed(x), len(x), x.dtype.type) == x).all()


def test_products_beyond_64_bits(spark):
    df = spark.sql("select 900000000000 a, 1000000000000 l, 999999999999 r")
    assert df.select(phrases._score(df.a, df.l, df.r)).first()[0] == 1_000_000 * 900000000000**2 // (1000000000000 * 999999999999)


def test_empty_table(spark):
    path = Scratch(spark).path("in")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/documents.parquet")
    assert QUERIES["op11_phrase_runs"](spark, path).collect() == []
