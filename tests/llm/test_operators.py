"""The ten operators against brute force, round trips and held-out data."""

import zlib
from itertools import combinations

import numpy as np
import pytest

from threadloom.llm import ann, html_blocks, licenses, mixing, near_dedup, orc_ids, packing, quality, sharding, tokens, transport
from threadloom.llm.queries import QUERIES
from threadloom.llm.work import Scratch, table

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, "en", "a", None),
    (2, "", None, None, 0),
    (3, "one", "en", "a", 3),
    (4, "The same text here, twice.", "en", "b", 26),
    (5, "The same text here, twice.", "en", "b", 26),
    (5, "The same text here, twice.", "en", "b", 26),
    (None, "no id at all", "en", "b", 12),
    (7, "word " * 60_000, "en", "c", 300_000),
    (8, "Ünïcode — 漢字   <|endoftext|> x's\n\n  y", "de", "c", 30),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_vocabulary())


def test_permutation_and_its_inverse():
    for n in (1, 2, 3, 17, 1000, 4097):
        p = sharding.permute(np.arange(n), n, 5)
        assert sorted(p) == list(range(n))
        assert (sharding.permute(p, n, 5, back=True) == np.arange(n)).all()
    assert sharding.row_at(*sharding.place(77, 1000, 40, 3), 1000, 40, 3) == 77
    assert abs(np.corrcoef(np.arange(4097), p)[0, 1]) < 0.05


def test_shards(spark, odd, none):
    rows = QUERIES["op1_feistel_shards"](spark, SF).toPandas()
    counts = rows.groupby("shard").slot.agg(["count", "max"])
    assert counts["count"].max() - counts["count"].min() <= 1 and (counts["max"] == counts["count"] - 1).all() and rows.shard.between(0, 39).all()
    again = QUERIES["op1_feistel_shards"](spark, SF).toPandas()
    key = ["doc_id", "size", "text_crc32"]
    assert rows.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))
    from pyspark.sql import functions as F

    got = sharding.shard_rows(odd.withColumn("slot", F.lit("mine")), [F.col("doc_id"), F.col("text")], 4).toPandas()
    assert len(got) == len(ODD) and sorted(got.shard * 100 + got.slot) == [0, 1, 2, 100, 101, 200, 201, 300, 301]
    assert sharding.shard_rows(none, [F.col("doc_id")]).count() == 0


def test_encoder_is_the_library(tokenizer):
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x<|endoftext|>y", "<|endoftext |>", "", "a  b\n\n c\t\td 's't've I'll", "été Ünï ß² 12½x¼", "漢字 mixed   space", " <|endoftext|>", "x" * 300, "\r\n \n", "«quoted» – dash", "one\n\ntwo\nthree", "\n\nx", "\n", " lead", "end\n", "a.\nB c's (d) 12x\n'll", "naïve Ærø ªº 3rd no'thing x²y"] + [x[1] or "" for x in ODD]
    assert [np.frombuffer(x, "<u2").tolist() for x in tokens.Encoder(tokens.default_vocabulary()).encode(texts)] == [tokenizer.encode(x, add_special_tokens=False).ids for x in texts]
    assert np.frombuffer(tokens.Encoder(tokens.default_vocabulary()).encode(texts)[0], "<u2").tolist() == [64, 220, 50256, 275]
    assert np.frombuffer(tokens.Encoder(tokens.default_vocabulary(), True).encode(texts)[0], "<u2").tolist() == [64, 1279, 91, 437, 1659, 5239, 91, 29, 275]


def test_encoder_on_all_documents(spark, tokenizer):
    texts = [r.text for r in table(spark, "/root/testdata/sf0.01", "documents").collect()]
    enc = tokens.Encoder(tokens.default_vocabulary())
    assert [np.frombuffer(x, "<u2").tolist() for k in range(0, len(texts), 100) for x in enc.encode(texts[k : k + 100])] == [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert len(enc.known) > 1000


def test_encoder_of_two_generations(monkeypatch, tokenizer):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 5)
    enc = tokens.Encoder(tokens.default_vocabulary())
    for text in ("a b c d", "a b e f g", "h i a", "k l m n o p q r", "a b k"):
        assert np.frombuffer(enc.encode([text])[0], "<u2").tolist() == tokenizer.encode(text).ids


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def test_packing(spark, odd, none, tokenizer):
    for docs in (odd, table(spark, SF, "documents")):
        pieces = packing.pack(docs, with_ids=True).toPandas().sort_values(["sequence_id", "offset"])
        at = pieces.sequence_id * 1024 + pieces.offset
        assert (at + pieces.length).tolist()[:-1] == at.tolist()[1:] and at.iloc[0] == 0
        assert (pieces.offset + pieces.length <= 1024).all()
        assert [zlib.crc32(x) for x in pieces.ids] == pieces.ids_crc32.tolist()
        got = sorted((list(g.doc_id)[0] or -1, b"".join(g.sort_values("start").ids)) for _, g in pieces.assign(doc=(at - pieces.start)).groupby("doc")) if docs is not odd else None
        if got:
            want = sorted((r.doc_id or -1, np.array(ids_of(tokenizer, r.text), "<u4").tobytes()) for r in docs.collect())
            assert got == want
    assert packing.pack(none).count() == 0


def test_orc(spark, odd, none, tokenizer):
    for docs in (odd, table(spark, SF, "documents")):
        path = Scratch(spark).path("ids")
        orc_ids.write_ids(docs, path)
        got = orc_ids.summary(spark, path).toPandas().sort_values("start")
        want = sorted(((-1 if r.doc_id is None else r.doc_id, ids_of(tokenizer, r.text)) for r in docs.collect()), key=lambda x: x[0])
        assert got.n_tokens.tolist() == [len(x) for _, x in want] and got.doc_id.fillna(-1).tolist() == [a for a, _ in want]
        assert got.start.tolist() == np.cumsum([0] + [len(x) for _, x in want])[:-1].tolist()
        assert got.ids_crc32.tolist() == [zlib.crc32(np.array(x, "<u4").tobytes()) for _, x in want]
    assert {r.doc_id for r in orc_ids.read_range(spark, path, 10, 12).collect()} == {10, 11, 12}
    plan = orc_ids.read_range(spark, path, 10, 12)._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(doc_id" in plan
    orc_ids.write_ids(none, path := Scratch(spark).path("ids"))
    assert orc_ids.summary(spark, path).count() == 0


@pytest.mark.parametrize("n", [0, 1, 64, 182, 183, 184, 8170, 8192, 8193, 100_000])
def test_transport_round_trip(n):
    payload = bytes(k * 7 % 251 for k in range(n))
    data = transport.write_stream(payload)
    m = transport.read_stream(data)
    assert len(data) % 188 == 0 and m.payload == payload and not m.errors
    assert m.pts == [k * 3600 for k in range(-(-n // 8192))] and m.random_access == list(range(0, n, 65536))
    if n > 400:
        assert transport.read_stream(data[: 188 * 3] + data[188 * 4 :]).errors  # a lost packet
        assert transport.read_stream(data[: 188 * 3] + data[188 * 2 :]) .payload == payload  # one sent twice


def test_transport_damage():
    data = bytearray(transport.write_stream(b"x" * 64))
    data[10] ^= 255  # the association table's checksum fails
    assert transport.read_stream(bytes(data)).payload == b"" and transport.read_stream(bytes(data)).errors
    assert transport.read_stream(b"").packets == 0 and transport.read_stream(b"junk" * 99).errors


def test_media_rows(spark, odd, none):
    got = transport.features(Scratch(spark).save(transport.to_media(odd), "m")).toPandas()
    assert len(got) == len(ODD) and got.payload_bytes.min() == 64 and (got.payload_bytes % 64 == 0).all()
    import hashlib

    want = {hashlib.sha256(transport.padded((x[1] or "").encode())).hexdigest() for x in ODD}
    assert set(got.payload_sha256) == want and got.feature.str.endswith("errors=0").all()
    assert transport.features(transport.to_media(none)).count() == 0
    assert transport.features(transport.to_media(odd), times=True).select("pts", "random_access").first().pts == [0]


def test_licenses(spark, odd, none):
    said = [
        (1, "This work is licensed under the GNU General Public License, version 3.", 1, "gpl", "gpl,gpl-3.0"),
        (2, "ALL RIGHTS reserved. all\x00rights-reserved", 2, "reserved", "reserved"),
        (3, "Licensed under CC BY-NC 4.0.", 1, "cc-by", "cc-by,cc-by-nc"),
        (4, "general public licenses, cc byé, all rights", 0, "", ""),
        (5, "Released under the MIT License.", 0, "", "mit"),
        (6, "cc cc by by cc by", 2, "cc-by", "cc-by"),
        (7, None, 0, "", ""),
    ]
    got = licenses.scan(spark.createDataFrame([x[:2] for x in said], "doc_id long, text string"), spans=True).toPandas().sort_values("doc_id")
    assert [tuple(r) for r in got[["doc_id", "n_base", "base_labels", "labels"]].values] == [(a, *rest) for a, _, *rest in said]
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    import re

    for r in docs.collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in r.text))
        places = [(k, v) for p, v in licenses.PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        g = got[r.doc_id]
        assert (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) == (len(words), len(places), min([k for k, _ in places], default=None), max([k for k, _ in places], default=None), ",".join(sorted({v for _, v in places})))
        assert 0 <= g.score <= 1 and set(filter(None, g.base_labels.split(","))) <= set(g.labels.split(","))
    assert licenses.scan(odd).count() == len(ODD) and licenses.scan(none).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>No &amp; no</title><style>p{}</style><body class="wide"><header><h2>Site name here</h2></header><nav><ul><li><a href="/">Home</a></ul></nav>
<div class="cookie-notice">We use cookies on this site to make all of your visits better, as told in our policy.</div>
<article class="post"><header><h1>Caf&eacute; &#8212;
 title</h1></header><p>First <b>pa</b>ragraph<br>goes   on.<p>Short.<script>var t="</p>";</script><!-- x --><p>See <a href=x>the link</a> &lt;here&gt;.
<div class="ad">Buy now, our best offer for readers of long articles on any topic that you like.</div><p>Last one.</article>
<section id="comments"><p>I liked this article very much, as did all of my friends and also their neighbours.</p></section>
<aside>Other stories that many people have read this week on our site</aside><form><p>Your mail</p></form><footer>&copy; 2024 by a company with a long name and many rights</footer></body></html>"""


def test_main_text(spark):
    want = "Café — title First paragraph goes on. Short. See the link <here>. Last one."
    assert html_blocks.main_text(PAGE) == want
    assert html_blocks.main_text(None) == html_blocks.main_text("") == html_blocks.main_text("<nav>a</nav>") == ""
    assert html_blocks.main_text("<article><p>cut off <b>in the") == "cut off in the"
    assert html_blocks.main_text("<body><p>" + "plain words of a page without containers " * 4) != ""
    df = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (2, None, "<p>" + "x " * 50_000)], "page_id long, url string, html string")
    got = html_blocks.extract(df).collect()
    assert got[0].text == want and got[0].n_chars == len(want) and got[1].text == "" and len(got) == 3
    assert html_blocks.extract(df.limit(0)).count() == 0


def test_main_text_of_all_pages(spark):
    """Against a strict reading of these pages' markup."""
    import html
    import re

    pages = table(spark, SF, "pages")
    got = {r.page_id: r.text for r in html_blocks.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        inner = re.sub(r"</?(p|h1|br)>", " ", inner)
        assert got[r.page_id] == " ".join(html.unescape(re.sub(r"</?b>", "", inner)).split())


def brute_components(rows, width):
    def words(t):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").translate({k: " " for k in (9, 10, 11, 12, 13)}).split(" ")

    sets = {}
    for i, t in rows:
        w = [x for x in words(t) if x]
        sets.setdefault(i, []).append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    label = {i: i for i in sets}
    ids = sorted(sets)
    for a, b in combinations(ids, 2):
        if any(x and y and 4 * max(len(x), len(y)) <= 5 * min(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
            la, lb = label[a], label[b]
            if la != lb:
                for k in ids:
                    if label[k] == max(la, lb):
                        label[k] = min(la, lb)
    return label, {i: sorted(len(s) for s in v) for i, v in sets.items()}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, width):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = near_dedup.near_duplicates(docs, width).toPandas()
    label, sizes = brute_components([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], width)
    assert len(got) == len(label) and dict(zip(got.doc_id, got.component_id, strict=True)) == label
    assert {i: [n] for i, n in zip(got.doc_id, got.n_shingles, strict=True)} == sizes and (got.kept == (got.doc_id == got.component_id)).all()
    assert len(set(label.values())) < len(label)


def test_near_duplicates_of_a_large_group(spark):
    """A group that no one document links as a whole, and small sets at the threshold."""
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(150):
        w = list(base)
        for at in rng.choice(119, 5, replace=False):
            w[at] = f"x{k}_{at}"
        rows.append((1000 - k, " ".join(w)))
    rows += [(2000 + k, " ".join(f"s{k}_{j}" for j in range(n + 1)) + tail) for k, n in enumerate((4, 5, 8, 9, 10, 47, 60)) for tail in ("", f" t{k}")]
    rows = [(i + (0 if t.split()[-1][0] != "t" else 500), t) for i, t in rows] + [(i, t) for i, t, *_ in ODD if i is not None and i != 7]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).toPandas()
    label, _ = brute_components(rows, 2)
    assert dict(zip(got.doc_id, got.component_id, strict=True)) == label


def test_near_duplicate_cases(spark, odd, none):
    got = near_dedup.near_duplicates(odd).toPandas()
    assert len(got) == len(ODD) and got[got.doc_id.isna()].kept.all() and got[got.doc_id == 2].n_shingles.tolist() == [0] and got[got.doc_id == 3].n_shingles.tolist() == [1]
    assert got[got.doc_id == 5].component_id.tolist() == [4, 4]
    assert near_dedup.near_duplicates(none).count() == 0
    assert sorted(str(r.doc_id) for r in near_dedup.dedup(odd).collect()) == ["1", "2", "3", "4", "7", "8", "None"]


def test_mix(spark, odd, none):
    rows = QUERIES["op7_source_mix"](spark, "/root/testdata/sf0.01").toPandas()
    assert len(rows) == 1000 and (rows.taken <= 2 * rows["size"]).all()
    names = {r.doc_id: r.source for r in table(spark, "/root/testdata/sf0.01", "documents").collect()}
    rows["source"] = rows.doc_id.map(names)
    per = rows.groupby("source").agg(size=("size", "sum"), said=("source_size", "first"), target=("target", "first"), taken=("taken", "sum")).sort_index()
    assert (per["size"] == per.said).all()
    weights = dict(zip(per.index, [3, 1, 2] * 10, strict=False))
    target, open_, left = {}, set(per.index), 1.5 * per["size"].sum()
    while True:
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * per["size"][s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * per["size"][s]
            left -= target[s]
            open_.remove(s)
    assert np.allclose(per.target, [target[s] for s in per.index]) and (abs(per.taken / per.target - 1) < 0.03).all()
    assert np.isclose(per.target.sum(), 1.5 * per["size"].sum())
    got = mixing.rated(odd).toPandas()
    assert len(got) == len(ODD) and got.source_size.notna().all()
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns and mixed.count() == got.copies.sum()
    assert mixing.mix(none).count() == 0


def test_quality(spark, odd, none):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    even = labels.where("doc_id % 2 = 0")
    got = quality.scored(docs.select("doc_id", "text", "lang", "source", "n_chars"), even).select("doc_id", "score", "accepted", "text_score").toPandas().merge(labels.where("doc_id % 2 = 1").toPandas(), on="doc_id")
    good, bad = got[got.quality == 1], got[got.quality == 0]
    assert len(got) > 1000 and good.accepted.mean() > 0.985 and (~bad.accepted).mean() > 0.7, (good.accepted.mean(), (~bad.accepted).mean())
    out = quality.scored(odd, even.limit(0))
    assert out.count() == len(ODD) and out.where("not accepted").count() == 0
    assert quality.scored(none, even).count() == 0
    assert quality.scored(odd.union(docs.limit(400)), even).where("score is null").count() == 0


def test_nearest(spark, none):
    v = table(spark, "/root/testdata/sf0.1", "embeddings")
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in v.collect()]
    ids, x = np.array([a for a, _ in rows]), np.array([b for _, b in rows])
    got = QUERIES["op10_kmeans_tree"](spark, "/root/testdata/sf0.1").toPandas().sort_values(["query_id", "rank"])
    hit = 0
    for q, g in got.groupby("query_id"):
        s = x @ x[ids == q][0]
        best = [int(ids[k]) for k in np.lexsort((ids, -s)) if ids[k] != q][:20]
        hit += len(set(best) & set(g.vec_id))
        assert g["rank"].tolist() == list(range(1, 21)) and q not in set(g.vec_id)
        assert np.allclose(g.score, [s[ids == i][0] for i in g.vec_id], rtol=1e-12, atol=1e-14)
    assert got.query_id.nunique() == (ids % 20 == 0).sum() and hit / len(got) >= 0.9
    odd = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 0.0]), (5, None), (6, []), (7, [float("nan"), 1.0]), (8, [None, 1.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (2, [0.5, 1.0])]
    from pyspark.sql import functions as F

    out = [tuple(r) for r in ann.search(spark.createDataFrame(odd, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert out == [(0, 1, 3, 1.0), (0, 2, 20, 1.0), (0, 3, 2, 0.5), (20, 1, 0, 1.0), (20, 2, 3, 1.0), (20, 3, 2, 0.5)]
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).count() == 0
