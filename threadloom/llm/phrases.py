"""Operator 11: phrases whose words stand together more often than apart.

Words are counted for each language; those that occur often enough to stand in a candidate are
numbered by falling count. Texts become blocks of ids, 0 where a piece ends or any other word
stands. Each block's runs of two ids are packed into fixed-width keys (two ids in 64 bits, a third in
32; 0 for none), sorted and counted by runs within the task, and cut at splitters into key ranges;
each range is brought together, sorted and counted again. Runs of three follow in the same way,
those only whose two pairs are frequent by a filter of bits (no run of a candidate can fail it).
Counts of parts then come by joins, and scores from decimals of 38 digits.

The ``HEAD_WORDS`` most frequent words of up to ``HEAD_BYTES`` bytes go to all tasks as a dictionary,
a bounded size. Other frequent words get their ids by a join (a filter of bits keeps most rare ones
out of it); none of them is frequent enough to weigh on one task. Splitters come from a sample of ``SAMPLE`` keys; they decide sizes of ranges
only. Counts, n and ranks cover all texts.

Cases: null and empty texts have no words; a null language is 'und'; words of one piece alone give
no phrase; equal rows count each; a table without candidates gives no rows; invalid UTF-8 isn't
expected of Spark's strings; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.work import Scratch, column, numbered, slices, small, table, texts

LEAST, TOP, INSIDE = 10, 2000, 50

HEAD_WORDS, HEAD_BYTES = 500_000, 64
SAMPLE = 100_000

#: Words, and keys, that a task counts before it sends the counts on.
PARTIAL_WORDS, PARTIAL_KEYS = 1_000_000, 6_000_000

#: Keys of a range, about.
RANGE_KEYS = 3_000_000

#: The filters of frequent pairs and of words outside the dictionary have 2 to this power bits each (16 MB).
FILTER_BITS = 27

#: Counts of words (id, language and number) are sent to all tasks up to this many.
SMALL_WORDS = 500_000

#: Large letters become small, and all that ends a piece becomes a line end.
_FOLD = bytes(10 if chr(b) in ".,;:!?\n\v\f\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))


def _folded(text: str) -> bytes:
    return text.encode("utf-8", "replace").translate(_FOLD)


def word_counts(docs: DataFrame, work: Scratch, at_once: int = PARTIAL_WORDS) -> DataFrame:
    """(lang, word, n), saved."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter[bytes]] = defaultdict(Counter)

        def sent() -> Iterator[pa.RecordBatch]:
            for lang, c in seen.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c)), pa.array(list(c), pa.binary()).cast(pa.string()), pa.array(list(c.values()), pa.int64())], names=["lang", "word", "n"])

        for batch in slices(batches, "text"):
            for lang, text in zip(column(batch, "lang").to_pylist(), texts(batch), strict=True):
                seen[lang].update(_folded(text).split())
            if sum(map(len, seen.values())) > at_once:
                yield from sent()
                seen.clear()
        yield from sent()

    return work.save(docs.mapInArrow(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")


def dictionary(words: DataFrame, least: int, work: Scratch) -> DataFrame:
    """(id, lang, word, n): words that can stand in a candidate, numbered from 1 by falling count."""
    frequent = words.where(F.col("n") >= least)
    rows = numbered(frequent, [F.col("n").desc(), F.col("lang"), F.col("word")], work, "numbered", "id")
    return work.save(rows.select((F.col("id") + 1).cast("int").alias("id"), "lang", "word", "n"), "dictionary")


def encoded(docs: DataFrame, words: DataFrame, work: Scratch, head: int = HEAD_WORDS, bits: int = FILTER_BITS) -> DataFrame:
    """(block, ids), saved: a block's texts as ids of four bytes, 0 wherever a phrase can't go on."""
    spark = docs.sparkSession
    short = (F.col("id") <= head) & (F.octet_length("word") <= HEAD_BYTES)
    sent = spark.sparkContext.broadcast(words.where(short).select("lang", F.col("word").cast("binary").alias("word"), "id").toArrow())  # bounded by head and HEAD_BYTES
    rest = words.where(~short)
    some, name = rest.limit(1).count() > 0, work.root
    seen = bit_filter(rest.select(F.shiftright(F.crc32(F.concat("lang", "word").cast("binary")), 32 - bits).alias("bit")), bits) if some else None

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _by_language(name, sent)
        for batch in slices(batches, "text"):
            ids: list[int] = []
            other: dict[tuple[str, bytes], list[int]] = defaultdict(list)
            for lang, text in zip(column(batch, "lang").to_pylist(), texts(batch), strict=True):
                get = known.get(lang, {}).get
                parts = [w for w in _folded(text).replace(b"\n", b" \n ").replace(b"\t", b" ").split(b" ") if w]
                if seen is not None:
                    start, held = zlib.crc32(lang.encode()), seen.value
                    for k, w in enumerate(parts, len(ids)):
                        if w != b"\n" and get(w) is None:
                            bit = zlib.crc32(w, start) >> (32 - bits)
                            if held[bit >> 3] >> (bit & 7) & 1:
                                other[lang, w].append(k)
                ids += [get(w, 0) for w in parts]
                ids.append(0)
            found = [{"lang": a, "word": w.decode("utf-8", "replace"), "places": p} for (a, w), p in other.items()]
            yield pa.RecordBatch.from_arrays([pa.array([np.array(ids, np.int32).tobytes()], pa.binary()), pa.array([found], _OTHER)], names=["ids", "other"])

    blocks = work.save(docs.mapInArrow(encode, "ids binary, other array<struct<lang:string,word:string,places:array<int>>>").withColumn("block", F.monotonically_increasing_id()), "blocks")
    if not some:
        return blocks.select("block", "ids")
    late = blocks.select("block", F.explode("other").alias("o")).select("block", "o.*").join(rest.select("lang", "word", "id"), ["lang", "word"])
    filled = blocks.select("block", "ids").join(late.groupBy("block").agg(F.collect_list(F.struct("id", "places")).alias("late")), "block", "left")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, raw, late in zip(*(column(batch, c).to_pylist() for c in ("block", "ids", "late")), strict=True):
                ids = np.frombuffer(raw, np.int32).copy()
                for x in late or []:
                    ids[x["places"]] = x["id"]
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([ids.tobytes()], pa.binary())], names=["block", "ids"])

    return work.save(filled.mapInArrow(fill, "block bigint, ids binary"), "filled")


_KNOWN: dict[str, dict[str, dict[bytes, int]]] = {}


def _by_language(name: str, sent) -> dict[str, dict[bytes, int]]:
    """The dictionary that was sent, unpacked once in each worker."""
    if name not in _KNOWN:
        _KNOWN.clear()
        known = _KNOWN[name] = defaultdict(dict)
        for batch in sent.value.to_batches(10_000):
            for lang, word, k in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                known[lang][word] = k
    return _KNOWN[name]


_OTHER = pa.list_(pa.struct([("lang", pa.string()), ("word", pa.string()), ("places", pa.list_(pa.int32()))]))


def packed(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all runs of two ids, and of all runs of three as the two first ids' key and the third."""
    x = np.concatenate([ids, np.zeros(2, np.int32)]).astype(np.uint64)
    pair, third = x[:-2] << np.uint64(32) | x[1:-1], x[2:].astype(np.uint32)
    pair[(x[:-2] == 0) | (x[1:-1] == 0)] = 0
    return pair, third


def run_lengths(pair: np.ndarray, third: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different keys in order and how often each occurs (n: how often each given one counts)."""
    first, place = np.unique(pair, return_inverse=True)
    short = place.astype(np.uint64) << np.uint64(32) | third
    if n is None:
        short.sort()
    else:
        order = np.argsort(short, kind="stable")
        short, n = short[order], n[order]
    begins = np.flatnonzero(np.concatenate([[True], short[1:] != short[:-1]])) if len(short) else np.zeros(0, np.int64)
    sums = np.diff(np.append(begins, len(short))) if n is None else np.add.reduceat(n, begins) if len(short) else n
    keys = short[begins]
    return first[keys >> np.uint64(32)], (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32), sums.astype(np.int64)


def _squeezed(x: np.ndarray) -> bytes:
    """Ascending or small numbers in few bytes: differences, byte by byte."""
    steps = np.diff(x, prepend=x.dtype.type(0))
    return pa.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, x.itemsize).T).tobytes(), "zstd", asbytes=True)


def _spread(raw: bytes, size: int, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(raw, size * width, "zstd", asbytes=True), np.uint8).reshape(width, size)
    return np.cumsum(np.ascontiguousarray(planes.T).view(kind).ravel(), dtype=kind)


def bit_of(pair: np.ndarray, bits: int) -> np.ndarray:
    """A pair's place in the filter."""
    return pair * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)


def keys_of(ids: np.ndarray, seen: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The keys to count: of two ids; or, given the filter of frequent pairs, of three ids whose two pairs are in it."""
    pair, third = packed(ids)
    if seen is None:
        pair = pair[pair > 0]
        return pair, np.zeros(len(pair), np.uint32)
    place = bit_of(pair, len(seen).bit_length() + 2)
    often = (seen[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool) & (pair > 0)
    both = often & np.append(often[1:], False)
    return pair[both], third[both]


def splitters(blocks: DataFrame, seen, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Keys that part all keys into ranges of about equal size: every so-manieth of a sorted sample."""
    total = (blocks.agg(F.sum(F.length("ids"))).first()[0] or 0) / 4  # no more keys than this
    share = min(1.0, sample / max(total, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, raw in zip(column(batch, "block").to_pylist(), column(batch, "ids").to_pylist(), strict=True):
                pair, third = keys_of(np.frombuffer(raw, np.int32), seen and seen.value)
                some = np.flatnonzero(np.random.default_rng(block).random(len(pair)) < share)
                yield pa.RecordBatch.from_arrays([pa.array(pair[some].astype(np.int64)), pa.array(third[some].astype(np.int64))], names=["pair", "third"])

    rows = blocks.mapInArrow(run, "pair bigint, third bigint").toArrow()
    pair, third, _ = run_lengths(rows["pair"].to_numpy().astype(np.uint64), rows["third"].to_numpy().astype(np.uint32))
    ranges = int(min(total // RANGE_KEYS + 1, len(pair) or 1))
    at = np.arange(1, ranges) * len(pair) // ranges
    return pair[at], third[at]


def counted(blocks: DataFrame, least: int, work: Scratch, name: str, seen=None, bits: int = FILTER_BITS, at_once: int = PARTIAL_KEYS) -> DataFrame:
    """(a, b, c, n, bit), saved: runs of two ids (c is 0), or of three where a filter is given, that occur ``least`` times."""
    cut_pair, cut_third = splitters(blocks, seen)

    def cut(pair: np.ndarray, third: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        lo, hi = np.searchsorted(pair, cut_pair), np.searchsorted(pair, cut_pair, "right")
        at = [a + int(np.searchsorted(third[a:b], t)) for a, b, t in zip(lo.tolist(), hi.tolist(), cut_third, strict=True)]
        for k, (a, b) in enumerate(zip([0, *at], [*at, len(pair)], strict=True)):
            if b > a:
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([b - a], pa.int32()), *(pa.array([_squeezed(x[a:b])], pa.binary()) for x in (pair, third, n.astype(np.uint32)))], names=["range", "size", "pair", "third", "n"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            for raw in column(batch, "ids").to_pylist():
                held.append(keys_of(np.frombuffer(raw, np.int32), seen and seen.value))
                size += len(held[-1][0])
                if size > at_once:
                    yield from cut(*run_lengths(*map(np.concatenate, zip(*held, strict=True))))
                    held, size = [], 0
        if held:
            yield from cut(*run_lengths(*map(np.concatenate, zip(*held, strict=True))))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = defaultdict(list)
        for batch in batches:
            for k, size, *raw in zip(*(column(batch, c).to_pylist() for c in ("range", "size", "pair", "third", "n")), strict=True):
                parts[k].append(tuple(_spread(x, size, t) for x, t in zip(raw, (np.uint64, np.uint32, np.uint32), strict=True)))
        for k in list(parts):
            pair, third, n = (np.concatenate(x) for x in zip(*parts.pop(k), strict=True))
            pair, third, n = run_lengths(pair, third, n.astype(np.int64))
            often = n >= least
            pair = pair[often]
            ids = [(pair >> np.uint64(32)).astype(np.int32), pair.astype(np.uint32).astype(np.int32), third[often].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, ids), pa.array(n[often]), pa.array(bit_of(pair, bits).astype(np.int64))], names=["a", "b", "c", "n", "bit"])

    ranges = blocks.mapInArrow(partial, "range int, size int, pair binary, third binary, n binary").repartition(len(cut_pair) + 1, "range")
    return work.save(ranges.mapInArrow(merged, "a int, b int, c int, n bigint, bit bigint"), name)


def bit_filter(rows: DataFrame, bits: int):
    """The bits that the rows name, sent to all tasks: a bounded size; where many rows share bits, more passes than need be."""
    words = rows.groupBy(F.shiftright("bit", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("m")).toArrow()
    seen = np.zeros(1 << (bits - 6), np.int64)
    seen[words["w"].to_numpy()] = words["m"].to_numpy()
    return rows.sparkSession.sparkContext.broadcast(seen.view(np.uint8))


def _score(a: Column, left: Column, right: Column) -> Column:
    whole = lambda x, digits: x.cast(f"decimal({digits},0)")
    return F.call_function("div", whole(whole(a, 15) * whole(a, 15), 31) * F.lit(1_000_000).cast("decimal(7,0)"), whole(left, 19) * whole(right, 19))


def collocations(docs: DataFrame, least: int = LEAST, inside: int = INSIDE, top: int | None = TOP, head: int = HEAD_WORDS, bits: int = FILTER_BITS, words_at_once: int = PARTIAL_WORDS, keys_at_once: int = PARTIAL_KEYS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases (``top`` None: all)."""
    work = Scratch(docs.sparkSession)
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string"))
    counts = word_counts(docs, work, words_at_once)
    words = dictionary(counts, least, work)
    blocks = encoded(docs, words, work, head, bits)
    two = counted(blocks, least, work, "two", None, bits, keys_at_once)
    three = counted(blocks, least, work, "three", bit_filter(two, bits), bits, keys_at_once)
    part = lambda x, y, n: two.select(F.col("a").alias(x), F.col("b").alias(y), F.col("n").alias(n))
    longer = three.select("a", "b", "n").union(three.select("b", "c", "n")).toDF("a", "b", "n").groupBy("a", "b").agg(F.max("n").alias("longest"))
    kept = two.join(longer, ["a", "b"], "left").where(F.coalesce(100 * F.col("longest") < inside * F.col("n"), F.lit(True)))
    none = F.lit(None).cast("long")
    pairs = kept.select("a", "b", F.lit(None).cast("int").alias("c"), "n", none.alias("n_ab"), none.alias("n_bc"))
    triples = three.join(part("a", "b", "n_ab"), ["a", "b"]).join(part("b", "c", "n_bc"), ["b", "c"]).select("a", "b", "c", "n", "n_ab", "n_bc")
    listed = pairs.union(triples).withColumnRenamed("n", "f")
    known = small(words.select("id", "lang", F.col("n").alias("own")), SMALL_WORDS)
    for k in "abc":
        listed = listed.join(known.select(F.col("id").alias(k), F.col("own").alias(f"n_{k}"), *([F.col("lang")] if k == "a" else [])), k, "left")
    cut = lambda k, left, right: F.struct(_score(F.col("f"), F.col(left), F.col(right)).alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))
    worst = F.when(F.col("c").isNull(), cut(1, "n_a", "n_b")).otherwise(F.least(cut(1, "n_a", "n_bc"), cut(2, "n_ab", "n_c")))
    scored = work.save(listed.select("lang", "a", "b", "c", "f", worst.alias("_w")).select("lang", "a", "b", "c", "f", "_w.l", "_w.r", "_w.score"), "scored")
    if top is not None:
        scored = best_of_each(scored, top, work)
    for k in "abc":
        scored = scored.join(words.select(F.col("id").alias(k), F.col("word").alias(f"word_{k}")), k, "left")
    told = scored.select("lang", F.concat_ws(" ", "word_a", "word_b", "word_c").alias("phrase"), F.col("f").alias("a"), "l", "r", "score")
    rows = numbered(told, [F.col("lang"), F.col("score").desc(), F.col("a").desc(), F.col("phrase")], work, "ranked", "place")
    starts = small(work.save(rows.groupBy("lang").agg(F.min("place").alias("_first")), "starts"))
    totals = small(work.save(counts.groupBy("lang").agg(F.sum("n").alias("n")), "totals"))
    out = rows.join(starts, "lang").withColumn("rank", F.col("place") - F.col("_first") + 1)
    return (out if top is None else out.where(F.col("rank") <= top)).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def best_of_each(scored: DataFrame, top: int, work: Scratch) -> DataFrame:
    """The rows of each language that none but fewer than ``top`` others beat by score and count; ties are kept."""
    rows = numbered(scored.select("lang", "score", "f"), [F.col("lang"), F.col("score").desc(), F.col("f").desc()], work, "numbers", "place")
    first = work.save(rows.groupBy("lang").agg(F.min("place").alias("_first")), "firsts")
    last = small(work.save(rows.join(small(first), "lang").where(F.col("place") == F.col("_first") + top - 1).select("lang", F.struct("score", "f").alias("_last")), "lasts"))
    return scored.join(last, "lang", "left").where(F.col("_last").isNull() | (F.struct("score", "f") >= F.col("_last"))).drop("_last")


def op11_phrase_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
