"""Operator 1: each document's row against a permutation worked out number by number."""

import zlib

from threadloom.llm import sharding
from threadloom.llm.queries import QUERIES
from threadloom.llm.work import table

SF, WORD = "/root/testdata/sf0.001", (1 << 64) - 1


def mixed(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & WORD
    x = (x ^ x >> 27) * 0x94D049BB133111EB & WORD
    return x ^ x >> 31


def position(row, n, seed):
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    while True:
        left, right = row >> half, row & (1 << half) - 1
        for k in range(1, sharding.ROUNDS + 1):
            left, right = right, left ^ mixed(right ^ mixed(seed + k * 0x9E3779B97F4A7C15 & WORD)) & (1 << half) - 1
        row = left << half | right
        if row < n:
            return row


def test_every_row_of_the_query(spark):
    docs = sorted((r.doc_id, (r.text or "").encode()) for r in table(spark, SF, "documents").collect())
    got = {r.doc_id: r for r in QUERIES["op1_feistel_shards"](spark, SF).collect()}
    assert len(got) == len(docs) == len({d for d, _ in docs})
    for row, (doc, raw) in enumerate(docs):
        r, p = got[doc], position(row, len(docs), 20_240_601)
        assert (r.size, r.text_crc32, r.law, r.shard, r.slot, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "rows", p % 40, p // 40, None)
