"""Indexes that outlive a query: an inverted index kept up to date in segments, and trigram postings for substrings.

A batch of changes becomes a segment: a row for each document that it puts or deletes, which counts
against all earlier segments, with the terms it was cut into, once; and the postings of those. Tasks
gather the postings of the documents at hand in a row for each term, so what is shuffled and sorted
are such blocks and neither texts nor single occurrences. Numbers of documents
and words are carried from batch to batch. The last segments are merged when they are of like size.
Each state is a written table of the segments in use, named by its number; readers take the last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.scalars import query_terms, terms

#: Parts of a segment; a term's postings lie in one, sorted by term.
PARTS = 16
#: Terms, or characters, of the documents whose postings a task gathers at a time, about.
GATHERED = 2_000_000
STATE = "seg long, first long, batch string, size long, docs long, words long, kind string"


def _part(c: Column) -> Column:
    return F.pmod(F.hash(c), F.lit(PARTS))


def _slices(batches: Iterator[pa.RecordBatch], sizes) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The batches cut where ``sizes`` of their rows come to about GATHERED, with those sizes."""
    for batch in batches:
        n = pc.fill_null(sizes(batch), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        turn = (np.cumsum(n) - n) // GATHERED
        for a, b in zip(cuts := np.flatnonzero(np.diff(turn, prepend=-1)).tolist(), [*cuts[1:], len(n)], strict=True):
            yield batch.slice(a, b - a), n[a:b]


def _lists(starts: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)).astype(np.int32)), values)


def _gather_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (doc, dl, terms) a row for each different term: its documents, their lengths, and behind one another the term's places in them; ``ends`` says how far each one's go."""
    for batch, n in _slices(batches, lambda b: pc.list_value_length(b["terms"])):
        terms = batch["terms"].flatten().dictionary_encode()
        if not len(terms):
            continue
        code = terms.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        row, place = np.repeat(np.arange(len(n)), n), np.arange(len(code)) - np.repeat(np.cumsum(n) - n, n)
        code, row, place = code[order], row[order], place[order]
        other = np.diff(code, prepend=-1) != 0
        term, entry = np.flatnonzero(other), np.flatnonzero(other | (np.diff(row, prepend=-1) != 0))
        first = np.searchsorted(entry, term)
        ends = np.append(entry[1:], len(code)) - np.repeat(term, np.diff(np.append(first, len(entry))))
        held = pa.array(row[entry])
        yield pa.RecordBatch.from_arrays(
            [terms.dictionary.take(pa.array(code[term])), _lists(first, batch["doc"].take(held)), _lists(first, batch["dl"].take(held)), _lists(first, pa.array(ends.astype(np.int32))), _lists(term, pa.array(place.astype(np.int32)))],
            names=["term", "docs", "sizes", "ends", "places"],
        )


def _gather_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (doc, low) a row for each different run of three characters, with the documents that hold it."""
    for batch, n in _slices(batches, lambda b: pc.utf8_length(b["low"])):
        at = np.frombuffer("".join(batch["low"].to_pylist()).encode("utf-32-le"), "<u4").astype(np.int64)
        row = np.repeat(np.arange(len(n)), n)
        inside = row[2:] == row[:-2]
        key, which = np.unique(((at[:-2] << 42) | (at[1:-1] << 21) | at[2:])[inside], return_inverse=True)
        if not len(key):
            continue
        held = np.unique(which * len(n) + row[2:][inside])
        first = np.searchsorted(held, np.arange(len(key)) * len(n))
        text = np.stack([key >> 42, key >> 21 & 0x1FFFFF, key & 0x1FFFFF], axis=1).astype("<u4").tobytes().decode("utf-32-le")
        yield pa.RecordBatch.from_arrays([pa.array([text[k : k + 3] for k in range(0, len(text), 3)]), _lists(first, batch["doc"].take(pa.array(held % len(n))))], names=["gram", "docs"])


class Index:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _listed(self, name: str) -> list[str]:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []

    def version(self) -> int:
        """The number of the last state that was written whole."""
        known = sorted((int(x.split("=")[1]) for x in self._listed("state") if "=" in x), reverse=True)
        return next((v for v in known if "_SUCCESS" in self._listed(f"state/version={v}")), 0)

    def state(self) -> list:
        """The segments in use, oldest first: a row for each."""
        version = self.version()
        return self.spark.read.schema(STATE).parquet(f"{self.path}/state/version={version}").orderBy("seg").collect() if version else []  # few rows

    def _commit(self, segments: list[tuple]) -> None:
        rows = self.spark.createDataFrame(segments, STATE)
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/state/version={self.version() + 1}")

    def _table(self, name: str, state: list) -> DataFrame:
        """A table's rows of some segments; its schema is known, so a table without rows is one, too."""
        doc = state[0].kind if state else "string"
        columns = {"docs": f"doc {doc}, deleted boolean, content bigint, terms array<string>, dl bigint, seg bigint", "postings": f"term string, docs array<{doc}>, sizes array<bigint>, ends array<int>, places array<int>, seg bigint, part int"}[name]
        return self.spark.read.schema(columns).parquet(f"{self.path}/{name}").where(F.col("seg").isin([s.seg for s in state]))

    def _put(self, rows: DataFrame, seg: int) -> Row:
        """Writes a segment's documents; what tells its tables."""
        rows.select("doc", "deleted", "content", "terms", "dl").write.mode("overwrite").parquet(f"{self.path}/docs/seg={seg}")
        return Row(seg=seg, kind=dict(rows.dtypes)["doc"])

    def apply(self, changes: DataFrame, batch: str | None = None) -> None:
        """Changes (doc, text, deleted; with ``at``, the last of a document counts) as one segment; a batch that was applied is not applied again."""
        now = self.state()
        if batch is not None and any(s.batch == batch for s in now):
            return
        seg = max((s.seg for s in now), default=0) + 1
        order = F.struct("at", "deleted", "text") if "at" in changes.columns else F.struct("deleted", "text")
        single = changes.groupBy("doc").agg(F.max(F.struct(order.alias("o"), "deleted", "text")).alias("c")).select("doc", "c.deleted", "c.text")
        gone = F.coalesce("deleted", F.lit(False))
        cut = lambda rows: rows.select("doc", gone.alias("deleted"), F.when(~gone, F.xxhash64("text")).alias("content"), F.when(~gone, F.coalesce(terms(F.col("text")), F.array().cast("array<string>"))).alias("terms")).withColumn("dl", F.when(~F.col("deleted"), F.size("terms").cast("long")))
        # Few batches hold a document twice, so texts are not shuffled to find out.
        this = self._put(cut(single if "at" in changes.columns else changes), seg)
        rows = self._table("docs", [this])
        if "at" not in changes.columns and rows.groupBy("doc").count().where("count > 1").limit(1).count():
            self._put(cut(single), seg)
            rows = self._table("docs", [this])
        old = self.lengths(now).join(rows.select("doc"), "doc", "left_semi").agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first() if now else (0, 0)
        self._post(this)
        new = rows.where("not deleted").agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        docs, words = (now[-1].docs, now[-1].words) if now else (0, 0)
        self._commit([tuple(s) for s in now] + [(seg, seg, batch, new[0], docs - old[0] + new[0], words - old[1] + new[1], this.kind)])

    def _post(self, this: Row) -> None:
        """Writes the postings of a segment's documents."""
        put = self._table("docs", [this]).where("not deleted").select("doc", "dl", "terms")
        held = put.mapInArrow(_gather_terms, f"term string, docs array<{this.kind}>, sizes array<bigint>, ends array<int>, places array<int>")
        # A frequent term's rows are dealt over several tasks by document.
        dealt = held.withColumn("part", _part(F.col("term"))).repartition("part", F.pmod(F.hash(F.get("docs", F.lit(0))), F.lit(8)))
        dealt.sortWithinPartitions("part", "term").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/postings/seg={this.seg}")

    def _live(self, rows: DataFrame, state: list) -> DataFrame:
        """Rows (doc, seg, …) that no later segment has put again or deleted."""
        if len(state) == 1:
            return rows
        again = self._table("docs", state).groupBy("doc").agg(F.max("seg").alias("_last"), F.count("*").alias("_n")).where("_n > 1").select("doc", "_last")
        return rows.join(again, "doc", "left").where("_last is null or seg >= _last").drop("_last")

    def lengths(self, state: list | None = None) -> DataFrame:
        state = self.state() if state is None else state
        return self._live(self._table("docs", state).where("not deleted and doc is not null").select("doc", "dl", "content", "seg"), state)

    def docs(self) -> DataFrame:
        return self.lengths().select("doc")

    def counts(self, state: list | None = None) -> tuple[int, int]:
        """Numbers of documents and of words, without reading either."""
        last = (self.state() if state is None else state)[-1]
        return last.docs, last.words

    def postings(self, words: list[str], state: list | None = None, places: bool = False) -> DataFrame:
        """Postings (term, doc, tf, dl, and places if asked for) of some words: of each segment one part and its row groups for each word."""
        state = self.state() if state is None else state
        rows = self._table("postings", state).where(F.col("part").isin(*[_part(F.lit(w)) for w in words]) & F.col("term").isin(words))

        def one(end: Column, k: Column) -> Column:
            tf = end - F.when(k > 0, F.get("ends", k - 1)).otherwise(0)
            own = [F.slice("places", end - tf + 1, tf).alias("places")] if places else []
            return F.struct(F.get("docs", k).alias("doc"), tf.cast("long").alias("tf"), F.get("sizes", k).alias("dl"), *own)

        return self._live(rows.select("term", "seg", F.explode(F.transform("ends", one)).alias("x")).select("term", "x.*", "seg"), state)

    def merge(self, like: int = 4) -> bool:
        """Merges the last segments, as many as are none larger than all after them (by powers of four), if they are ``like`` or more; true if it did."""
        state = self.state()
        tier = lambda n: max(n, 1).bit_length() // 2
        first, total = len(state), 0
        while first and tier(state[first - 1].size) <= tier(max(total, state[-1].size)):
            first -= 1
            total += state[first].size
        some = state[first:]
        if len(some) < max(like, 2):
            return False
        seg = some[-1].seg + 1
        this = self._put(self._live(self._table("docs", some), some), seg)  # of a deleted document that it is
        self._post(this)
        size = self._table("docs", [this]).where("not deleted").count()
        self._commit([tuple(s) for s in state[:first]] + [(seg, some[0].first, some[-1].batch, size, some[-1].docs, some[-1].words, some[0].kind)])
        return True

    def clean(self) -> None:
        """Removes tables of segments that are no longer in use; readers that began before must be done."""
        used, hadoop = {s.seg for s in self.state()}, self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for name in ("docs", "postings"):
            at = hadoop(f"{self.path}/{name}")
            fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            for x in fs.listStatus(at) if fs.exists(at) else []:
                if int(x.getPath().getName().split("=")[1]) not in used:
                    fs.delete(x.getPath(), True)

    def drift(self, source: DataFrame) -> DataFrame:
        """(doc, state) where the index is not what the source (doc, text) is: 'missing', 'stale' or 'extra'."""
        both = source.select("doc", F.xxhash64("text").alias("_source"), F.lit(True).alias("_s")).join(self.lengths().select("doc", "content", F.lit(True).alias("_i")), "doc", "full")
        state = F.when(F.col("_i").isNull(), "missing").when(F.col("_s").isNull(), "extra").when(~F.col("_source").eqNullSafe(F.col("content")), "stale")
        return both.select("doc", state.alias("state")).where("state is not null")


def follow(index: Index, changes: DataFrame, checkpoint: str):
    """A stream of changes kept in the index, a segment for each micro-batch, and merged as it grows."""

    def step(batch: DataFrame, number: int) -> None:
        index.apply(batch, f"{checkpoint}-{number}")
        while index.merge():
            pass

    return changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def _low(text: Column) -> Column:
    """Lower case of each character for itself: that of Σ depends on what follows, which a part of a text has not."""
    return F.translate(F.lower(text), "ς", "σ")


def grams(text: Column, n: int = 3) -> Column:
    """The different runs of n characters of a text in lower case; for short texts."""
    low = _low(text)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - (n - 1), F.lit(1))), lambda k: F.substring(low, k, F.lit(n))))


def write_grams(docs: DataFrame, doc: str, text: str, path: str) -> None:
    """Postings (gram, docs) in parts by gram and sorted, and the texts sorted by document."""
    rows = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"))
    rows.where("doc is not null").repartitionByRange("doc").sortWithinPartitions("doc").write.option("parquet.block.size", 1 << 20).parquet(f"{path}/texts")
    held = rows.where("length(text) >= 3").select("doc", _low(F.col("text")).alias("low")).mapInArrow(_gather_grams, f"gram string, docs array<{dict(rows.dtypes)['doc']}>")
    dealt = held.withColumn("part", _part(F.col("gram"))).repartition("part", F.pmod(F.hash(F.get("docs", F.lit(0))), F.lit(8)))
    dealt.sortWithinPartitions("part", "gram").write.partitionBy("part").parquet(f"{path}/grams")


def containing(spark: SparkSession, path: str, part: str, listed: int = 1000) -> DataFrame:
    """(doc, text) of texts that contain a string: documents with all of its grams, then verified. Below three characters all texts are read.

    Up to ``listed`` candidates are named in the filter, so that row groups of texts are skipped by their bounds; more are joined.
    """
    texts = spark.read.parquet(f"{path}/texts")
    hit = F.contains("text", F.lit(part))
    if len(part) < 3:
        return texts.where(hit)
    wanted = [r.g for r in spark.range(1).select(F.explode(grams(F.lit(part))).alias("g")).collect()]  # of the query alone
    kind = dict(texts.dtypes)["doc"]
    here = spark.read.schema(f"gram string, docs array<{kind}>, part int").parquet(f"{path}/grams").where(F.col("part").isin(*[_part(F.lit(g)) for g in wanted]) & F.col("gram").isin(wanted))
    candidates = here.select("gram", F.explode("docs").alias("doc")).groupBy("doc").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(wanted)).select("doc")
    few = [r.doc for r in candidates.limit(listed + 1).collect()]  # bounded by listed
    if len(few) <= listed:
        return texts.where(F.col("doc").isin(few) & hit)
    return texts.join(candidates, "doc", "left_semi").where(hit)


__all__ = ["Index", "containing", "follow", "grams", "query_terms", "write_grams"]
