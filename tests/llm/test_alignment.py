"""Aligned tokens: against both libraries on whole texts, token by token."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from threadloom.llm import alignment
from threadloom.llm.queries import QUERIES
from threadloom.llm.work import Scratch, table

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
TEXTS = [None, "", " ", "  ", "plain words, twice. plain words", " two  spaces   here ", "tab\t and\n line\n\n  ends \r\n", "U+2581 ▁ is none", "<s> <0x41> <|endoftext|> <unk>", "naïve 漢字 🙂 ß Ａ　\xa0 x​ y\x00\x1c z", "a" * 3000, "x y " * 4000, "plain words, twice. plain words"]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def tokens(libraries, text):
    """(id, start, end) of both tokenizers over the whole text, or none."""
    a, b = libraries
    whole = f" {text}".encode()
    known = alignment.byte_of_character()
    in_a = [(e, bytes(known[c] for c in a.id_to_token(e))) for e in a.encode(f" {text}", add_special_tokens=False).ids]
    in_b = [(k, bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode()) for k in b.encode(text)]
    out = []
    for ids in (in_a, in_b):
        if not text or b"".join(x for _, x in ids) != whole:
            return [], []
        at, rows = 0, []
        for k, x in ids:
            rows.append((k, at, at + len(x)))
            at += len(x)
        out.append(rows)
    return out


def brute(libraries, texts):
    held, rows = defaultdict(set), []
    for n, text in enumerate(texts):
        a, b = tokens(libraries, text or "")
        links, first = [], 0
        for x, s, e in a:
            while first < len(b) and b[first][2] <= s:
                first += 1
            k = first
            while k < len(b) and b[k][1] < e:
                links.append((x, b[k][0]))
                k += 1
        for p in links:
            held[p].add(n)
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        group = lambda rows, lo, hi: ",".join(str(k) for k, s, e in rows if lo <= s and e <= hi)
        told = ";".join(f"{group(a, lo, hi)}|{group(b, lo, hi)}" for lo, hi in zip([0, *cuts], cuts, strict=False)) if len(cuts) < 3000 else None
        rows.append([len(a), len(b), len(cuts), links, told])
    most = Counter()
    for (x, _), docs in held.items():
        most[x] = max(most[x], len(docs))
    return [(na, nb, ng, len(links), sum(len(held[p]) == most[p[0]] for p in links), sum(len(held[p]) for p in links), told and hashlib.sha256(told.encode()).hexdigest() if told != "" else "") for na, nb, ng, links, told in rows]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("head", [alignment.HEAD, 5, 0])
def test_odd_texts(spark, libraries, head):
    docs = spark.createDataFrame([(k, x, "own") for k, x in enumerate(TEXTS)], "doc_id long, text string, pairs string").repartition(3)
    got = {r.doc_id: r for r in alignment.align(docs, A, B, head).collect()}
    want = brute(libraries, TEXTS)
    assert len(got) == len(TEXTS)
    for k, w in enumerate(want):
        assert tuple(got[k][c] for c in COLUMNS if c != "groups_sha256" or w[-1] is not None) == tuple(x for x in w if x is not None), TEXTS[k]


def test_query_over_all_documents(spark, libraries):
    docs = table(spark, SF, "documents").toPandas()
    want = sorted((int(i), *w) for i, w in zip(docs.doc_id, brute(libraries, docs.text.tolist()), strict=True))
    got = sorted((r.doc_id, *(r[c] for c in COLUMNS)) for r in QUERIES["op12_token_alignment"](spark, SF).collect())
    assert all(g[: 7 + (w[-1] is not None)] == tuple(x for x in w if x is not None) for g, w in zip(got, want, strict=True))


def test_empty_table_and_null_ids(spark):
    path = Scratch(spark).path("in")
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    assert QUERIES["op12_token_alignment"](spark, path).collect() == []
    rows = alignment.align(spark.createDataFrame([(None, "same text"), (None, "same text")], "doc_id long, text string"), A, B).collect()
    assert len(rows) == 2 and rows[0] == rows[1] and rows[0].count_sum == 2 * rows[0].n_links


@settings(max_examples=500, deadline=None)
@given(st.one_of(st.text(st.sampled_from("ab  \t\n.é▁漢​\xa0<"), max_size=30), st.text(st.sampled_from("stbÄ   \n\t'.,19½_-"), max_size=30)))
def test_units_keep_every_token(libraries, text):
    pair = alignment.loaded(A, B)
    parts = alignment.units(text) if text else []
    assert "".join(parts) == (f" {text}" if text else "")
    want = tokens(libraries, text)
    whole, (ids_a, n_a, ids_b, n_b) = pair.ids(list(dict.fromkeys(parts))) if parts else ([], [[]] * 4)
    if parts and set(whole) == set(parts):
        for ids, n, w in ((ids_a, n_a, want[0]), (ids_b, n_b, want[1])):
            of = dict(zip(whole, np.split(ids, np.cumsum(n)[:-1]), strict=True))
            assert [int(k) for x in parts for k in of[x]] == [k for k, _, _ in w]
    else:
        assert want == ([], [])


def test_cleared_units_are_learned_again(libraries, monkeypatch):
    import duckdb

    monkeypatch.setattr(alignment, "CACHE_UNITS", 3)
    con, pair = duckdb.connect(), alignment.Pair(A, B)
    given = ["one two three four", "two ▁", "five, six; one", None]
    first = [alignment.aligned(con, pair, [x]) for x in given]
    again = alignment.aligned(con, alignment.Pair(A, B), given)
    for name in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pair", "times"):
        assert [x[name][0] if isinstance(x[name], list) else x[name].tolist()[0] for x in first] == list(again[name] if isinstance(again[name], list) else again[name].tolist())
