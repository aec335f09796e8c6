"""Operator 8: the query's columns, clock references, and readers that join midway."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from threadloom.llm import transport
from threadloom.llm.queries import QUERIES
from threadloom.llm.work import Scratch, table

SF = "/root/testdata/sf0.001"


def test_every_column_of_the_query(spark):
    texts = {r.doc_id: r.text or "" for r in table(spark, SF, "documents").collect()}
    got = QUERIES["op8_transport_streams"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        raw = texts[r.doc_id].encode()
        held = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        media = transport.write_stream(held)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(held), hashlib.sha256(held).hexdigest(), zlib.crc32(held[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        assert r.pts == [k * 3600 for k in range(-(-len(held) // 8192))] and r.random_access == list(range(0, len(held), 65536)) and r.pcr == r.pts[::8]


@pytest.mark.parametrize("n", [65536, 65537, 200_000, 1_500_000])
def test_reader_joins_at_a_random_access_point(n):
    payload = bytes(k * 7 % 251 for k in range(n))
    data = transport.write_stream(payload)
    tables = [at for at in range(0, len(data), 188) if data[at + 1] & 0x1F == 0 and data[at + 2] == 0]
    whole = transport.read_stream(data)
    assert len(tables) == len(whole.random_access) == -(-n // 65536) and not whole.errors
    for at, place in zip(tables, whole.random_access, strict=True):
        late = transport.read_stream(data[at:])
        assert late.payload == payload[place:] and not late.errors and late.pcr[0] == late.pts[0] == place // 8192 * 3600
    assert [data[at + 3] & 15 for at in tables] == [k % 16 for k in range(len(tables))]


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "doc_id long, text string").withColumn("media", F.lit("x")).withColumn("pts", F.lit(1)).withColumn("n_bytes", F.lit(9))
    got = transport.features(Scratch(spark).save(transport.to_media(df), "m")).collect()
    assert sorted(r.n_bytes for r in got) == [0, 1, 1] and len({r.media_sha256 for r in got}) == 2
