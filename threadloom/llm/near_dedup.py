"""Operator 6: near-duplicates from bottom-k sketches of one hash function.

A document's set is its distinct shingles, as 64-bit hashes; equal sets form a class, and only one
document of each class goes on. Its sketch is the ``K`` least hashes. Inverted lists are kept for
runs of three neighbouring retained values (two as well for small sketches): two sets with a
similarity of 0.8 share such a run always where the sketch is the whole set, and else with a
probability above 1 - 1e-7, while sets that share but a passage or common words hardly ever do.

Lists yield links without pairing their members: first each member is compared with its list's
least document. Documents of lists that then hold several components are dropped if too few of
their shingles occur in any other such document; those outside a list's main component are compared with
the rest of the lists of that component, in blocks that give out links only. A pair of the first
kind is estimated from the union's bottom-k sketch, and what may reach the threshold is confirmed
on the full sets; blocks compare full sets. So no list is cut or sampled, and what is quadratic are
comparisons inside blocks of a list whose members have too little in common to be one component.

Cases: a document without words has an empty set and is its own component; one with fewer words
than a shingle is one shingle of all its words; a null doc_id takes no part (component null, kept);
rows with one doc_id are one document, and link what either text links; ties cannot arise, as the
least doc_id names a component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.components import components
from threadloom.llm.packing import spark_schema
from threadloom.llm.work import Scratch, column, fresh, slices, small, table, texts

K, PERCENT = 48, 80
#: Hashes in a block of sets.
BLOCK = 200_000
#: Estimates below this are dropped: at a similarity of 0.8, 21 or fewer of 48 common values are met once in 10**8 pairs.
LEAST_ESTIMATE = 0.45
CHUNK = 1 << 20

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_M1, _M2, _ODD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 64, 256, dtype=np.uint64, endpoint=False)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The odd base's powers and their inverses modulo 2**64."""
    if len(_powers["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("up", int(_ODD)), ("down", pow(int(_ODD), -1, 1 << 64))):
            _powers[name] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, base, np.uint64)]), dtype=np.uint64)
    return _powers["up"], _powers["down"]


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the text's words, in order."""
    data = np.frombuffer(text.encode("utf-8", "replace").translate(_LOWER), np.uint8)
    space = np.concatenate([[True], _SPACE[data], [True]])
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edges[::2], edges[1::2]
    out = []
    first = 0
    while first < len(starts):  # so many words as lie in one chunk
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + CHUNK, "right")))
        s, e = starts[first:last] - starts[first], ends[first:last] - starts[first]
        part = data[starts[first] : ends[last - 1]]
        up, down = _power(len(part) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[part] * up[: len(part)], dtype=np.uint64)])
        out.append(_mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)))
        first = last
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(text: str, width: int) -> np.ndarray:
    """The sorted set of the text's shingle hashes."""
    words = word_hashes(text)
    if not len(words):
        return words
    width = min(width, len(words))
    h = words[: len(words) - width + 1] + np.uint64(width)
    for k in range(1, width):
        h = _mix(h * _ODD + words[k : len(words) - width + 1 + k])
    return np.unique(_mix(h))


def run_keys(sketch: np.ndarray) -> list[int]:
    """Hashes of the runs under which a sketch is listed, as signed numbers."""
    out = []
    for run in (2, 3):
        if len(sketch) >= run and (len(sketch) < 12 if run == 2 else len(sketch) >= 6):
            h = sketch[: len(sketch) - run + 1] + np.uint64(run)
            for k in range(1, run):
                h = _mix(h * _ODD + sketch[k : len(sketch) - run + 1 + k])
            out += h.view(np.int64).tolist()
    return out


def estimate(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity from the K least values of the union."""
    union, n = np.unique(np.concatenate([a, b]), return_counts=True)
    return float((n[:K] == 2).mean())


FEATURES = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("sig", pa.binary()), ("sketch", pa.binary())])


def described(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = [shingles(x, width) for x in texts(batch)]
            sigs = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(map(len, sets), pa.int64()), pa.array(sigs, pa.binary()), pa.array([s[:K].tobytes() for s in sets], pa.binary())], schema=FEATURES)

    return docs.mapInArrow(run, spark_schema(FEATURES))


def listed(classes: DataFrame) -> DataFrame:
    """(key, rep) for each run of each class's sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps, keys = [], []
            for rep, raw in zip(column(batch, "rep").to_pylist(), column(batch, "sketch").to_pylist(), strict=True):
                found = run_keys(np.frombuffer(raw, np.uint64))
                reps += [rep] * len(found)
                keys += found
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(reps, pa.int64())], names=["key", "rep"])

    return classes.select("rep", "sketch").mapInArrow(run, "key long, rep long")


def likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes and estimate allow the similarity."""
    left = classes.select(F.col("rep").alias("a"), F.col("n").alias("an"), F.col("sketch").alias("asketch"))
    right = classes.select(F.col("rep").alias("b"), F.col("n").alias("bn"), F.col("sketch").alias("bsketch"))
    sized = pairs.join(left, "a").join(right, "b").where(F.least("an", "bn") * 100 >= F.greatest("an", "bn") * percent)
    least = LEAST_ESTIMATE * percent / PERCENT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [estimate(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= least for x, y in zip(column(batch, "asketch").to_pylist(), column(batch, "bsketch").to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return sized.select("a", "b", "asketch", "bsketch").mapInArrow(run, "a long, b long")


def full_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(doc_id, hashes) of the documents whose doc_id is in ``wanted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array([shingles(x, width).tobytes() for x in texts(batch)], pa.binary())], names=["doc_id", "hashes"])

    return docs.join(small(wanted), "doc_id", "left_semi").mapInArrow(run, "doc_id long, hashes binary")


def confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs whose full sets have the similarity."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "x"):
            keep = []
            for x, y in zip(column(batch, "x").to_pylist(), column(batch, "y").to_pylist(), strict=True):
                common = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                keep.append(100 * common >= percent * (len(x) // 8 + len(y) // 8 - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    full = full_sets(docs, pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), width)
    x, y = full.select(F.col("doc_id").alias("a"), F.col("hashes").alias("x")), full.select(F.col("doc_id").alias("b"), F.col("hashes").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long").distinct()


def compared(members: DataFrame, docs: DataFrame, width: int, percent: int, work: Scratch) -> DataFrame:
    """Links between (main, rep, part, n, common) of one main and different parts, in blocks.

    Members outside the main part meet all members, on full sets. A block of them is held against a
    block of members by one sorted array of the latter's hashes; only links come out, one for
    each of them and part met.
    """
    totals = work.save(members.groupBy("main").agg(F.ceil(F.sum("n") / BLOCK).alias("blocks"), F.greatest(F.lit(1), F.ceil(F.sum(F.when(F.col("part") != F.col("main"), F.col("n"))) * 4 / BLOCK)).alias("outer")), "totals")
    sets = work.save(full_sets(docs, members.select(F.col("rep").alias("doc_id")).distinct(), width), "sets")
    dealt = members.join(small(totals), "main").join(sets, members["rep"] == sets["doc_id"]).withColumn("block", F.pmod(F.xxhash64("rep"), "blocks"))
    row = F.struct("rep", "part", "hashes")
    inner = dealt.groupBy("main", "block").agg(F.collect_list(row).alias("inner"))
    outer = dealt.where("part <> main").withColumn("_o", F.pmod(F.xxhash64("rep", F.lit(1)), "outer")).groupBy("main", "_o", "blocks").agg(F.collect_list(row).alias("out"))
    met = inner.join(outer.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))), ["main", "block"]).select("inner", "out")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for k in range(batch.num_rows):
                inner, out = column(batch, "inner")[k].as_py(), column(batch, "out")[k].as_py()
                reps, parts = np.array([m["rep"] for m in inner]), np.array([m["part"] for m in inner])
                sets = [np.frombuffer(m["hashes"], np.uint64) for m in inner]
                sizes = np.array([len(x) for x in sets])
                values, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
                order = np.argsort(values, kind="stable")
                values, owners = values[order], owners[order]
                for m in out:
                    x = np.frombuffer(m["hashes"], np.uint64)
                    first, last = np.searchsorted(values, x, "left"), np.searchsorted(values, x, "right")
                    n = last - first
                    at = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                    shared = np.bincount(owners[at], minlength=len(sets))
                    hit = np.flatnonzero((100 * shared >= percent * (len(x) + sizes - shared)) & (parts != m["part"]))
                    _, one = np.unique(parts[hit], return_index=True)
                    a += [m["rep"]] * len(one)
                    b += reps[hit[one]].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return work.save(met.mapInArrow(run, "a long, b long").distinct(), "rest")


def in_common(lists: DataFrame, docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """(rep, n, common) of listed documents: how many of their shingles any other listed one has.

    No link can have more in common, so it bounds a document's similarity to all it may still meet.
    """

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", CHUNK):
            sets = [shingles(x, width).view(np.int64) for x in texts(batch)]
            owners = np.repeat(np.array(column(batch, "doc_id").to_pylist(), np.int64), [len(x) for x in sets])
            yield pa.RecordBatch.from_arrays([pa.array(owners), pa.array(np.concatenate(sets))], names=["rep", "value"])

    met = small(lists.select(F.col("rep").alias("doc_id")).distinct())
    full = docs.join(met, "doc_id", "left_semi").mapInArrow(values, "rep long, value long")
    alone = full.groupBy("value").agg(F.min("rep").alias("rep"), F.max("rep").alias("other")).where("rep = other").groupBy("rep").agg(F.count("*").alias("alone"))
    sizes = classes.join(met, classes["rep"] == met["doc_id"], "left_semi").groupBy("rep").agg(F.max("n").alias("n"))
    return sizes.join(alone, "rep", "left").select("rep", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("common"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row."""
    spark = docs.sparkSession
    work = Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    all_rows = work.save(described(docs, width), "rows")
    classes = work.save(all_rows.where("sig is not null and doc_id is not null").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")), "classes")
    entries = work.save(listed(classes), "entries")
    leaders = work.save(entries.groupBy("key").agg(F.min("rep").alias("leader"), F.max("rep").alias("most")).where("leader < most").select("key", "leader"), "leaders")
    lists = work.save(entries.join(leaders, "key"), "lists")
    labels: DataFrame | None = None  # of classes that have a link: (node, label)

    def joined(edges: DataFrame, name: str) -> DataFrame | None:
        """The labels with these links added."""
        if not edges.limit(1).count():
            return labels
        if labels is None:
            return components(edges, work, name)
        lab = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"c{c}"))
        lifted = edges.join(lab("a"), "a", "left").join(lab("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b").distinct()
        merged = components(lifted, work, name)
        both = labels.select("node", "label").union(merged.select("node", F.col("node").alias("label")).join(labels.select("node"), "node", "left_anti"))
        top = merged.select(F.col("node").alias("label"), F.col("label").alias("top"))
        return work.save(both.join(top, "label", "left").select("node", F.coalesce("top", "label").alias("label")), f"{name}-labels")

    star = lists.where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    maybe = work.save(likely(star, classes, percent), "likely")
    labels = joined(work.save(confirmed(maybe, docs, width, percent), "edges"), "star")
    # Lists that still hold more than one component; a list of two has been compared.
    rows = lists.select("key", "rep")
    here = rows.join(labels, rows["rep"] == labels["node"], "left").select("key", "rep", F.coalesce("label", "rep").alias("part")) if labels is not None else rows.withColumn("part", F.col("rep"))
    here = work.save(here, "parts")
    sizes = here.groupBy("key", "part").agg(F.count("*").alias("n"))
    split = sizes.groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct("n", "part")).alias("main"), F.sum("n").alias("members")).where("parts > 1 and members > 2")
    open_lists = work.save(split.select("key", F.col("main.part").alias("main")), "open")
    if open_lists.limit(1).count():
        met = work.save(here.join(open_lists, "key").select("main", "rep", "part").distinct(), "met")
        linkable = in_common(met, docs, classes, width).where(F.col("common") * 100 >= F.col("n") * percent)
        members = work.save(met.join(linkable, "rep"), "members")
        labels = joined(compared(members, docs, width, percent, work), "rest")
    work.drop("entries", "leaders", "lists")
    part = classes.select(F.col("sig").alias("_sig"), F.col("rep").alias("component"))
    if labels is not None:
        part = classes.join(labels, classes["rep"] == labels["node"], "left").select(F.col("sig").alias("_sig"), F.coalesce("label", "rep").alias("component"))
    named = work.save(part, "named")
    out = all_rows.join(named, all_rows["sig"] == named["_sig"], "left").withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def dedup(docs: DataFrame, width: int = 5) -> DataFrame:
    """One document of each group, whole, and every row whose doc_id is null.

    Rows of one doc_id are one document, and all its different texts stay.
    """
    kept = near_duplicates(docs, width).where("kept and doc_id is not null").select("doc_id").distinct()
    named = docs.where("doc_id is not null")
    one = named.join(kept, "doc_id", "left_semi")
    if named.groupBy("doc_id").count().where("count > 1").limit(1).count():
        text = fresh("_text", docs)
        one = one.withColumn(text, F.xxhash64("text")).dropDuplicates(["doc_id", text]).drop(text)
    return one.unionByName(docs.where("doc_id is null"))


def op6_bottom_k_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)
