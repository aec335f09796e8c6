"""Operator 12: where the tokens of two tokenizers meet.

Both tokenizers always cut a text at certain places (before a space that follows a character other
than white space; in Latin texts, at the ends of words), so texts are taken apart there and a worker
aligns each different unit once. DuckDB does that in the task, for each Arrow batch's new units, over
two tables of token intervals on one axis of bytes: an ASOF join finds the B token in which an A
token begins, another the one in which it ends, the range between them gives the links, and window
sums over the ends that both share number the groups. Units meet their documents again in a join;
each document's different id pairs are kept with their number of links.

How many documents hold a pair linked is counted in partial sums by task and merged in Spark. The
``HEAD`` most frequent pairs go to the tasks as arrays, a bounded size; what documents hold of
others is joined by shuffle, and there no pair is frequent.

Cases: null and empty texts, and those whose joined bytes in A or B differ from space and text (as
those with U+2581), have no tokens: zeros and an empty hash; equal rows are separate documents; null
doc_ids stay; an empty table gives no rows; other columns are ignored. One text must fit a task.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.work import Scratch, column, slices, table, texts

#: Pairs that are sent to all tasks, at most: 13 bytes each.
HEAD = 2_000_000

#: Bytes of text in a slice: the larger, the more units are alike.
SLICE = 4_000_000

#: Different pairs that a task sums up before it sends them on.
PARTIAL = 4_000_000

#: Different units that a worker keeps with their alignment, and characters of their groups, at most.
CACHE_UNITS, CACHE_CHARS = 250_000, 25_000_000

#: An id pair is one number: A's id, then this many bits for B's.
B_BITS = 15

#: White space, and what some versions of Unicode count as such: no text is cut after it.
_SPACE = "\\s\u180e\u200b\ufeff"
_LOOSE = re.compile(f"[{_SPACE}] ")
_LOOSE_END = re.compile(f"[{_SPACE}]\\Z")

#: Texts of this alphabet alone are cut at the ends of words too; its letters.
_ELSE = re.compile("[^\t\n\r -~\xa1-\xac\xae-\u024f]")
_L = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
#: A word with the space before it; or a run of others, which takes the word behind it along where a tokenizer may look over the cut.
_FINE = re.compile(f" ?[{_L}]+|(?:[^{_L}'\\s]|[\t\n\r'](?![{_L}])| +(?![{_L} ]))+(?:(?: {{2,}}|[\t\n\r'])[{_L}]+)?|(?: {{2,}}|[\t\n\r'])[{_L}]+")

DOCUMENT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<int>, times array<int>"

#: Tables a and b have a row for each token of the batch's units: unit u, place k, id, and bytes s to e.
TOKENS = """
CREATE OR REPLACE TEMP TABLE cut AS SELECT a.e FROM a JOIN b ON a.e = b.e;
CREATE OR REPLACE TEMP TABLE grouped AS
SELECT u, side, s, id, coalesce(sum(shared) OVER (PARTITION BY side ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM (
  SELECT u, 0 AS side, s, id, (cut.e IS NOT NULL)::INT AS shared FROM a LEFT JOIN cut ON a.e = cut.e UNION ALL SELECT u, 1, s, id, (cut.e IS NOT NULL)::INT FROM b LEFT JOIN cut ON b.e = cut.e);
CREATE OR REPLACE TEMP TABLE links AS
SELECT r.u, r.id AS a, b.id AS b FROM (
  SELECT f.u, f.id, unnest(range(f.k0, l.k + 1)) AS k FROM (SELECT a.u, a.id, a.e, b.k AS k0 FROM a ASOF JOIN b ON a.s >= b.s) f ASOF JOIN b l ON f.e > l.s) r
JOIN b ON b.k = r.k"""
#: The groups of all units, a line for each unit.
TOLD = """
SELECT string_agg(mark || id, '' ORDER BY g, side, s) FROM (
  SELECT g, side, s, id, CASE WHEN lag(u) OVER o IS NULL THEN '' WHEN lag(u) OVER o <> u THEN chr(10) WHEN lag(g) OVER o <> g THEN ';' WHEN lag(side) OVER o <> side THEN '|' ELSE ',' END AS mark FROM grouped WINDOW o AS (ORDER BY g, side, s))"""
UNITS = """
SELECT u, n_a, n_b, n_groups, n_links FROM (SELECT u, count(*) FILTER (side = 0) AS n_a, count(*) FILTER (side = 1) AS n_b, (max(g) - min(g) + 1)::BIGINT AS n_groups FROM grouped GROUP BY u)
JOIN (SELECT u, count(*) AS n_links FROM links GROUP BY u) USING (u) ORDER BY u"""
LINKS = f"SELECT u, (a * {1 << B_BITS} + b)::BIGINT AS pair, count(*) AS times FROM links GROUP BY ALL"
PAIRS = """
SELECT doc, pair::INT AS pair, sum(n * times)::INT AS times FROM held JOIN known USING (u) GROUP BY doc, pair ORDER BY doc, pair"""
COUNTS = ("n_a", "n_b", "n_groups", "n_links")

_SPACED = re.compile(f" [{_L}]+")
#: So many words go to A in one call.
JOINED = 256


def units(text: str) -> list[str]:
    """Space and text in parts; both tokenizers end a token where a part ends and look at no other part."""
    if not _ELSE.search(text):
        return _FINE.findall(f" {text}")
    out: list[str] = []
    for w in text.split(" "):
        if out and (out[-1] == " " or _LOOSE_END.search(out[-1])):
            out[-1] += f" {w}"
        else:
            out.append(f" {w}")
    return out


def byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies spell a byte as its printable Latin-1 character, and the others from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}


class Pair:
    """Both tokenizers, their tokens' bytes, and the alignment of units met before."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        bytes_of, size = byte_of_character(), self.b.get_piece_size()
        spelled = sorted(self.a.get_vocab().items(), key=lambda x: x[1])
        self.bytes_a = [bytes(map(bytes_of.__getitem__, t)) if all(c in bytes_of for c in t) else t.encode() for t, _ in spelled]
        pieces = [None if self.b.is_byte(k) else self.b.id_to_piece(k).replace("\u2581", " ") for k in range(size)]
        self.bytes_b = [bytes([int(self.b.id_to_piece(k)[1:-1], 16)]) if p is None else p.encode() for k, p in enumerate(pieces)]
        if [k for _, k in spelled] != list(range(len(spelled))) or size > 1 << B_BITS or len(spelled) > 1 << (31 - B_BITS):
            raise ValueError("ids must be gapless, and a pair must fit 31 bits")
        cores = [p.lstrip(" ") for k, p in enumerate(pieces) if p and not self.b.is_control(k) and not self.b.is_unknown(k)]
        if any(" " in p or not _ELSE.search(p) and re.search(f"[{_L}][^{_L}]|[^{_L}][{_L}]", p) for p in cores):
            raise ValueError("a piece of B reaches over the end of a word, so texts can't be cut there")
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in y], np.int64) for y in (self.bytes_a, self.bytes_b))
        self.space = self.b.piece_to_id("\u2581")
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}  # -1: bytes of A or B are not the unit's
        self.told: list[str] = []
        self.chars = 0
        self.counts = np.zeros((4, 0), np.int64)
        self.links = pa.table({k: pa.array([], t) for k, t in (("u", pa.int64()), ("pair", pa.int64()), ("times", pa.int64()))})

    def ids(self, wanted: list[str]) -> tuple[list[str], list[np.ndarray]]:
        """Those units whose bytes A and B give back, and for each tokenizer their ids and how many belong to each."""
        # Words with a space before them are cut apart in any text, so many go to A in one call.
        spaced = [w for w in wanted if w[0] == " " and _SPACED.fullmatch(w)]
        rest = list(set(wanted).difference(spaced))
        units = spaced + rest
        joined = ["".join(spaced[k : k + JOINED]) for k in range(0, len(spaced), JOINED)]
        ids_a = np.fromiter(chain.from_iterable(e.ids for e in self.a.encode_batch_fast(joined + rest, add_special_tokens=False)), np.int32)
        # B puts a space before each text; a line end, which is a byte of its own, keeps it from a word without one.
        in_b = self.b.encode([w[1:] if w[0] == " " else f"\n{w}" for w in units], num_threads=1)
        in_b = [[self.space] if w == " " else b if w[0] == " " else b[2:] for w, b in zip(units, in_b, strict=True)]
        ids_b, n_b = np.fromiter(chain.from_iterable(in_b), np.int32), np.array([len(b) for b in in_b])
        raw = [w.encode("utf-8", "replace") for w in units]
        ends = np.cumsum([len(x) for x in raw])
        last_a = np.searchsorted(np.cumsum(self.sizes_a[ids_a]), ends, "right")
        n_a = np.diff(last_a, prepend=0)
        of_a, of_b = self.bytes_a.__getitem__, self.bytes_b.__getitem__
        if b"".join(raw) == b"".join(map(of_a, ids_a.tolist())) == b"".join(map(of_b, ids_b.tolist())) and (np.cumsum(self.sizes_b[ids_b])[np.cumsum(n_b) - 1] == ends).all():
            return units, [ids_a, n_a, ids_b, n_b]
        kept = []  # one of them at least differs: each on its own
        in_a = [e.ids for e in self.a.encode_batch_fast(units, add_special_tokens=False)]
        for w, x, a, b in zip(units, raw, in_a, in_b, strict=True):
            if b"".join(map(of_a, a)) == x == b"".join(map(of_b, b)):
                kept.append((w, a, b))
        flat = lambda k: np.fromiter(chain.from_iterable(x[k] for x in kept), np.int32)
        return [x[0] for x in kept], [flat(1), np.array([len(x[1]) for x in kept], int), flat(2), np.array([len(x[2]) for x in kept], int)]

    def learn(self, con, wanted: list[str]) -> None:
        """Aligns units that are new."""
        if len(self.place) > CACHE_UNITS or self.chars > CACHE_CHARS:
            self.clear()
        new = [w for w in wanted if w not in self.place]
        if not new:
            return
        units, (ids_a, n_a, ids_b, n_b) = self.ids(new)
        first = len(self.told)
        self.place |= dict.fromkeys(new, -1)
        self.place |= dict(zip(units, range(first, first + len(units)), strict=True))
        if not units:
            return
        con.register("a", intervals(ids_a, n_a, self.sizes_a, first))
        con.register("b", intervals(ids_b, n_b, self.sizes_b, first))
        con.execute(TOKENS)
        told = con.sql(TOLD).fetchall()[0][0]
        self.told += told.split("\n")
        self.chars += len(told)
        found = con.sql(UNITS).to_arrow_table()
        self.counts = np.concatenate([self.counts, [found[c].to_numpy() for c in COUNTS]], axis=1)
        self.links = pa.concat_tables([self.links, con.sql(LINKS).to_arrow_table()]).combine_chunks()


@lru_cache(maxsize=2)
def loaded(path_a: str, path_b: str) -> Pair:
    """One for each worker."""
    return Pair(path_a, path_b)


def intervals(ids: np.ndarray, size: np.ndarray, sizes: np.ndarray, first: int) -> pa.Table:
    """The tokens of units that lie one behind the other, numbered from ``first``."""
    ends = np.cumsum(sizes[ids])
    return pa.table({"u": np.repeat(np.arange(first, first + len(size)), size), "k": np.arange(len(ids)), "id": ids, "s": ends - sizes[ids], "e": ends})


def aligned(con, pair: Pair, given: list[str]) -> dict[str, list]:
    """Columns of DOCUMENT without doc_id, for a slice's texts."""
    parts = [units(x) if x else [] for x in given]
    pair.learn(con, list(set().union(*parts)))
    at = [list(map(pair.place.__getitem__, x)) for x in parts]
    at = [x if x and min(x) >= 0 else [] for x in at]
    n = len(given)
    size = np.array([len(x) for x in at])
    doc, flat = np.repeat(np.arange(n), size), np.fromiter(chain.from_iterable(at), np.int64, size.sum())
    out: dict[str, list] = {name: np.bincount(doc, weights=c[flat], minlength=n).astype(np.int64) for name, c in zip(COUNTS, pair.counts, strict=True)}
    out["groups_sha256"] = [hashlib.sha256(";".join(map(pair.told.__getitem__, x)).encode()).hexdigest() if x else "" for x in at]
    units_known = len(pair.told) + 1
    held, count = np.unique(doc * units_known + flat, return_counts=True)
    con.register("held", pa.table({"doc": held // units_known, "u": held % units_known, "n": count}))
    con.register("known", pair.links)
    rows = con.sql(PAIRS).to_arrow_table()
    bounds = np.searchsorted(rows["doc"].to_numpy(), np.arange(n + 1)).astype(np.int32)
    return out | {c: pa.ListArray.from_arrays(bounds, rows[c].combine_chunks()) for c in ("pair", "times")}


def documents(docs: DataFrame, path_a: str, path_b: str, work: Scratch) -> DataFrame:
    """DOCUMENT and a row number, saved: the pairs of each document with their links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        pair = loaded(path_a, path_b)
        with duckdb.connect(config={"threads": 1, "temp_directory": ""}) as con:
            for batch in slices(batches, "text", SLICE):
                out = aligned(con, pair, texts(batch))
                yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), *(x if isinstance(x, pa.Array) else pa.array(x) for x in out.values())], names=["doc_id", *COUNTS, "groups_sha256", "pairs", "times"])

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return work.save(narrow.mapInArrow(run, DOCUMENT).withColumn("row", F.monotonically_increasing_id()), "documents")


def pair_counts(per_document: DataFrame, work: Scratch) -> DataFrame:
    """(pair, n, best), saved: in how many documents a pair is linked, and whether none of its A id is in more."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, size = [], [], 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            keys, where = np.unique(np.concatenate(held), return_inverse=True)
            return keys, np.bincount(where, weights=np.concatenate(count)).astype(np.int64)

        def sent(keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for k in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + 100_000]), pa.array(n[k : k + 100_000])], names=["pair", "n"])

        for batch in batches:
            keys, n = np.unique(column(batch, "pairs").flatten().to_numpy(), return_counts=True)
            held, count, size = [*held, keys], [*count, n], size + len(keys)
            if size > 2 * PARTIAL:
                keys, n = summed()
                if len(keys) > PARTIAL:
                    yield from sent(keys, n)
                    keys, n = keys[:0], n[:0]
                held, count, size = [keys], [n], len(keys)
        if held:
            yield from sent(*summed())

    counts = work.save(per_document.select("pairs").mapInArrow(partial, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n")), "counts")
    id_a = F.shiftright("pair", B_BITS)
    most = counts.groupBy(id_a.alias("a")).agg(F.max("n").alias("most"))  # a row for each A id at most: 16 bits
    return work.save(counts.join(F.broadcast(most), id_a == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "best")


def align(docs: DataFrame, path_a: str, path_b: str, head: int = HEAD) -> DataFrame:
    """Per document n_a, n_b, n_groups, n_links, groups_sha256, pairs, times, n_best and count_sum."""
    spark = docs.sparkSession
    work = Scratch(spark)
    saved = documents(docs, path_a, path_b, work)
    counts = pair_counts(saved, work)
    more = counts.limit(head + 1).count() > head
    top = (work.save(counts.orderBy(F.col("n").desc(), "pair").limit(head), "head") if more else counts).toArrow().sort_by("pair")  # bounded by head
    known = spark.sparkContext.broadcast(tuple(top[c].to_numpy() for c in ("pair", "n", "best")))
    kept = [f.name for f in saved.schema]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = known.value
        for batch in batches:
            lists = column(batch, "pairs")
            pairs, times = lists.flatten().to_numpy(), column(batch, "times").flatten().to_numpy().astype(np.int64)
            size = np.diff(lists.offsets.to_numpy())
            doc = np.repeat(np.arange(len(size)), size)
            at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
            hit = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
            sums = np.zeros((2, len(size)), np.int64)
            np.add.at(sums[0], doc[hit], times[hit] * best[at[hit]])
            np.add.at(sums[1], doc[hit], times[hit] * n[at[hit]])
            rest = np.concatenate([[0], np.cumsum(np.bincount(doc[~hit], minlength=len(size)))]).astype(np.int32)
            others = [pa.ListArray.from_arrays(rest, pa.array(x[~hit], pa.int32())) for x in (pairs, times)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums[0]), pa.array(sums[1]), *others], names=[*kept, "n_best", "count_sum", "other_pairs", "other_times"])

    scored = saved.mapInArrow(score, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in saved.schema) + ", n_best bigint, count_sum bigint, other_pairs array<int>, other_times array<int>")
    if not more:
        return scored.drop("row", "other_pairs", "other_times")
    scored = work.save(scored, "scored")
    other = scored.select("row", F.explode(F.arrays_zip("other_pairs", "other_times")).alias("o")).select("row", F.col("o.other_pairs").alias("pair"), F.col("o.other_times").alias("times"))
    rare = counts.join(spark.read.parquet(work.path("head")).select("pair"), "pair", "left_anti")
    sums = other.join(rare, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("times") * F.col("n")).alias("_sum"))
    add = lambda c, d: (F.col(c) + F.coalesce(d, F.lit(0))).alias(c)
    return scored.join(sums, "row", "left").select(*[c for c in kept if c != "row"], add("n_best", "_best"), add("count_sum", "_sum"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    out = align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
