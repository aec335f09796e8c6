"""Secrets: against a plain reading of the patterns, and verdicts by owners."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from threadloom.llm import secret_scan
from threadloom.llm.queries import QUERIES
from threadloom.llm.work import Scratch

KEY = "AKIA" + "Q7Z2" * 4
HASH = "0123456789abcdef01234567"
MIXED = "xY7qLm29PzRk03TbVc81"
TEXTS = [
    None,
    "",
    "password: token: abcdefgh",
    "passwd='short' API_KEY = \"longer/val+ue=\" apikey:abc secret=abcdef.",
    f"ſecret=notthisone Tokén toKen=neither 漢字 TOKEN={KEY} then {HASH}",
    f"{HASH}g {HASH[:23]} AKIA{'A' * 15} AKIAAKIA{'B' * 20}",
    f"see {MIXED} and {MIXED.lower()} and {'aB1' * 9}",
    "token=" + "a1" * 50_000,
]
PLAIN = {"assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6), "access": ("AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), "hex": ("[0-9a-f]+", lambda m: len(m[0]) >= 24)}


def plain(text):
    return [[f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, text or "", re.ASCII | (re.IGNORECASE if k == "assign" else 0)) if keep(m)] for k, (p, keep) in PLAIN.items()]


def by_start(spans):
    return sorted(spans, key=lambda x: (int(x.split(":")[1]), [*PLAIN, "token"].index(x.split(":")[0])))


def result(spark, rows):
    path = Scratch(spark).path("in")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, found string, row string").write.parquet(f"{path}/documents.parquet")
    return QUERIES["op13_secret_ownership"](spark, path).collect()


def test_base_spans_of_odd_texts(spark):
    rows = [(k, x, "en", "a", "own", "own") for k, x in enumerate(TEXTS)] + [(None, TEXTS[3], None, None, None, None)]
    got = result(spark, rows)
    assert len(got) == len(rows)
    for r in got:
        a, k, h = plain(TEXTS[3 if r.doc_id is None else r.doc_id])
        base = by_start(a + k + h)
        assert (r.n_assign, r.n_access, r.n_hex) == (len(a), len(k), len(h))
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert set(base) <= set(spans) and spans == by_start(spans)
    assert next(r for r in got if r.doc_id == 6).spans == f"token:4:{4 + len(MIXED)}"
    assert next(r for r in got if r.doc_id == 2).n_assign == 0
    assert result(spark, []) == []


@pytest.mark.parametrize(("holders", "live"), [([("a", "x")] * 9, True), ([("a", "x"), ("b", "x")], True), ([("a", "x"), ("b", "x"), ("c", "x")], False), ([("a", str(k)) for k in range(5)], False), ([(None, None), ("a", None)], True)])
def test_verdict_by_owners(spark, holders, live):
    docs = spark.createDataFrame([(k, f"key {MIXED} token={HASH}", o, r) for k, (o, r) in enumerate(holders)], "doc_id long, text string, o string, r string")
    got = secret_scan.scan(docs, F.col("o"), F.col("r")).collect()
    assert len(got) == len(holders)
    for r in got:
        assert [(x.kind, x.live) for x in r.spans] == [(3, live), (0, live), (2, live)]
        assert {x.owners for x in r.spans} == {len({o for o, _ in holders})} and {x.repos for x in r.spans} == {len(set(holders))}
