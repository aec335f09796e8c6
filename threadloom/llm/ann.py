"""Operator 10: nearest neighbours by a hierarchical k-means tree, best bin first.

A tree of k-means splits is fitted on a bounded sample and every vector goes to its leaf. Leaves
that hold more than ``SPLIT_ROWS`` rows are split by trees of their own, fitted on bounded samples
of their rows, level by level, so that a leaf's rows stay bounded however many there are in all.

A query walks a tree with a priority queue of unopened nodes. A node's priority is the inner product
with its centre plus ``SPREADS`` times what one standard deviation of its rows along a direction
can add. At each level the number of leaves to visit is widened until the recall of a sample of
queries, against all vectors, reaches the aim; a query goes on beyond it until its leaves hold
as many other rows as are asked. Neighbouring leaves make up bins, the unit in which rows and
queries meet, so that a query is sent once for each bin and not for each leaf.

Of equal vectors the k + 1 smallest ids can be anyone's neighbours, as ties go to the smaller id; the
others are queries, but no candidates. So a vector that a third of all rows hold is no hot leaf.

Cases: null, zero or empty vectors, vectors with null or non-finite components, of another length than
most, or without vec_id take no part; of rows with one vec_id one is taken (least hash); equal scores
go to the smaller vec_id; with fewer candidates than asked all are returned; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import logging
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.llm.packing import spark_schema
from threadloom.llm.work import Scratch, bounded_sample, column, small, table

#: Vectors that a tree is fitted on and queries that the visits are calibrated with, at most; wanted recall of the latter.
SAMPLE, CALIBRATION, RECALL = 20_000, 200, 0.94
BRANCHES, LEAF_ROWS, LEAST_ROWS, STEPS, SPREADS = 8, 256, 8, 8, 2.0
#: Leaves of more rows are split again, up to LEVELS times; rows of a bin and of a block; queries of a block.
SPLIT_ROWS, LEVELS, BIN_ROWS, ROUTE_ROWS, QUERY_BLOCK = 2048, 3, 8192, 4096, 512
#: A leaf's id is its parent's times this plus its place in the parent's tree.
WIDTH = 1 << 16
#: In place of a bin.
SPLIT, NONE = -1, -2

HITS = "query_id long, ids array<long>, scores array<double>"
RESULT = pa.schema([("query_id", pa.int64()), ("rank", pa.int32()), ("vec_id", pa.int64()), ("score", pa.float64())])
log = logging.getLogger(__name__)


class Tree(NamedTuple):
    centres: np.ndarray  # of all nodes
    spread: np.ndarray  # standard deviation along one direction, by node
    parent: np.ndarray

    @property
    def children(self) -> list[list[int]]:
        """By node; empty for a leaf."""
        out: list[list[int]] = [[] for _ in self.parent]
        for node, up in enumerate(self.parent.tolist()):
            if up >= 0:
                out[up].append(node)
        return out

    def stored(self) -> tuple[bytes, bytes, bytes]:
        return self.centres.tobytes(), self.spread.tobytes(), self.parent.astype(np.int64).tobytes()


def restored(centres: bytes, spread: bytes, parent: bytes) -> Tree:
    up = np.frombuffer(parent, np.int64)
    return Tree(np.frombuffer(centres).reshape(len(up), -1), np.frombuffer(spread), up)


def fit(sample: np.ndarray, leaf_rows: int, seed: int = 11) -> Tree:
    rng = np.random.Generator(np.random.PCG64(seed))
    centres, spread, parent = [sample.mean(axis=0)], [_spread(sample)], [-1]
    todo = [(0, sample)]
    while todo:
        node, rows = todo.pop()
        if len(rows) <= leaf_rows:
            continue
        distinct = np.unique(rows, axis=0)
        if len(distinct) < 2:
            continue
        at = distinct[rng.choice(len(distinct), min(BRANCHES, len(distinct)), replace=False)]
        for _ in range(STEPS):
            near = _nearest(rows, at)
            at = np.array([rows[near == k].mean(axis=0) for k in range(len(at)) if (near == k).any()])
        near = _nearest(rows, at)
        parts = [rows[near == k] for k in range(len(at))]
        if sum(len(p) > 0 for p in parts) < 2:
            continue
        for c, p in zip(at, parts, strict=True):
            if len(p):
                todo.append((len(centres), p))
                centres.append(c)
                spread.append(_spread(p))
                parent.append(node)
    return Tree(np.array(centres), np.array(spread), np.array(parent))


def _spread(rows: np.ndarray) -> float:
    return float(np.sqrt(rows.var(axis=0).mean()))


def _nearest(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.argmin((at**2).sum(axis=1) - 2 * rows @ at.T, axis=1)


def leaves(tree: Tree, rows: np.ndarray) -> np.ndarray:
    """Each row's leaf, by the nearest centre at each level."""
    out = np.zeros(len(rows), np.int64)
    children = tree.children
    todo = [(0, np.arange(len(rows)))]
    while todo:
        node, idx = todo.pop()
        if not children[node]:
            out[idx] = node
        elif len(idx):
            kids = np.array(children[node])
            near = _nearest(rows[idx], tree.centres[kids])
            todo += [(int(kid), idx[near == k]) for k, kid in enumerate(kids)]
    return out


def priorities(tree: Tree, queries: np.ndarray) -> np.ndarray:
    """For each query and node, about the largest inner product that the node's rows have with it."""
    return queries @ tree.centres.T + SPREADS * np.linalg.norm(queries, axis=1)[:, None] * tree.spread


def visits(children: list[list[int]], near: list[float], most: int, size: np.ndarray | None = None, least: int = 0) -> list[int]:
    """The first leaves that best-bin-first traversal opens by priority: ``most``, and more until they hold ``least`` rows by ``size``."""
    queue, out, held = [(-near[0], 0)], [], 0
    while queue and (len(out) < most or held < least):
        _, node = heapq.heappop(queue)
        if not children[node]:
            out.append(node)
            held += int(size[node]) if size is not None else 0
        for kid in children[node]:
            heapq.heappush(queue, (-near[kid], kid))
    return out


def matrix(values: pa.Array) -> np.ndarray:
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(values), -1) if len(values) else flat.reshape(0, 0)


def nearest_in(ids: np.ndarray, leaf: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, asked: np.ndarray, by: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, vec_id, score): each query's k nearest among the rows of its leaves.

    ``asked[j]`` is a leaf that query ``by[j]`` visits. Rough products choose; scores are summed
    row by row, so that equal vectors tie exactly.
    """
    order = np.argsort(leaf, kind="stable")
    ids, leaf, x = ids[order], leaf[order], x[order]
    order = np.argsort(asked, kind="stable")
    asked, by = asked[order], by[order]
    best = np.full((len(q), k), -np.inf)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    names, first = np.unique(leaf, return_index=True)
    for name, a, b in zip(names, first, [*first[1:], len(leaf)], strict=True):
        at = by[np.searchsorted(asked, name, "left") : np.searchsorted(asked, name, "right")]
        if not len(at):
            continue
        rough = q[at] @ x[a:b].T
        rough[qids[at][:, None] == ids[None, a:b]] = -np.inf
        both = np.concatenate([best[at], rough], axis=1)
        best[at] = top = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
        least = top.min(axis=1)
        least = np.where(np.isfinite(least), least - 1e-9 * (1 + np.abs(least)), np.finfo(float).min)
        i, j = np.nonzero(rough >= least[:, None])
        found.append((at[i], ids[a:b][j], (x[a:b][j] * q[at[i]]).sum(axis=1)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return firsts(*map(np.concatenate, zip(*found, strict=True)), k)


def firsts(of: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k largest scores of each query, ties to the smaller id, in the order of queries."""
    order = np.lexsort((ids, -scores, of))
    of, ids, scores = of[order], ids[order], scores[order]
    begin = np.searchsorted(of, of, "left")
    keep = np.arange(len(of)) - begin < k
    return of[keep], ids[keep], scores[keep]


def _hits(qids: np.ndarray, of: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    """A row for each query that has hits, in HITS' columns."""
    names, first = np.unique(of, return_index=True)
    cuts = pa.array(np.append(first, len(of)).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(qids[names]), pa.ListArray.from_arrays(cuts, pa.array(ids)), pa.ListArray.from_arrays(cuts, pa.array(scores))], names=["query_id", "ids", "scores"])


def top(hits: DataFrame, k: int) -> DataFrame:
    """The k best of all bins' hits; a query has at most k from each bin that it visits."""
    each = hits.groupBy("query_id").agg(F.flatten(F.collect_list("ids")).alias("ids"), F.flatten(F.collect_list("scores")).alias("scores"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = column(batch, "ids")
            of = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            of, ids, scores = firsts(of, lists.flatten().to_numpy(), column(batch, "scores").flatten().to_numpy(), k)
            rank = np.arange(len(of)) - np.searchsorted(of, of, "left") + 1
            yield pa.RecordBatch.from_arrays([column(batch, "query_id").take(pa.array(of)), pa.array(rank.astype(np.int32)), pa.array(ids), pa.array(scores)], schema=RESULT)

    return each.mapInArrow(run, spark_schema(RESULT))


def _usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def candidates(rows: DataFrame, k: int) -> DataFrame:
    """Of each vector's rows the k + 1 of smallest vec_id; all but those leave before the shuffle."""
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    return rows.withColumn("_place", place).where(F.col("_place") <= k + 1).drop("_place")


class Search:
    """The tables and settings of one search."""

    def __init__(self, vectors: DataFrame, is_query: Column, k: int, recall: float, sample: int, leaf_rows: int, split_rows: int, bin_rows: int):
        self.work, self.k, self.sample, self.leaf_rows, self.split_rows, self.bin_rows = Scratch(vectors.sparkSession), k, sample, leaf_rows, split_rows, bin_rows
        v = F.col("embedding")
        usable = vectors.select(F.col("vec_id").cast("long"), v.alias("v")).where(F.col("vec_id").isNotNull() & _usable(F.col("v")))
        if usable.groupBy("vec_id").count().where("count > 1").limit(1).count():
            usable = usable.groupBy("vec_id").agg(F.min(F.struct(F.xxhash64("v"), "v")).alias("m")).select("vec_id", "m.v")
        lengths = usable.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
        self.empty = lengths is None
        if self.empty:
            return
        usable = usable.where(F.size("v") == lengths.d)
        self.rows = self.work.save(candidates(usable, k), "vectors")
        self.queries = self.work.save(usable.where(is_query), "queries")
        self.type = self.rows.schema["v"].dataType.simpleString()
        self.left = recall  # what levels still to come have to reach

    def truth(self) -> DataFrame:
        """The calibration's (query_id, q, vec_id, v): sampled queries and their true neighbours."""
        asked = bounded_sample(self.queries, "vec_id", CALIBRATION, 1)
        got = asked.toArrow()  # at most CALIBRATION rows
        qids, q, k = got.column("vec_id").to_numpy(), matrix(got.column("v").combine_chunks()) if got.num_rows else np.zeros((0, 1)), self.k
        every = np.arange(len(qids))

        def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows and len(qids):
                    zeros = np.zeros(batch.num_rows, np.int64)
                    yield _hits(qids, *nearest_in(column(batch, "vec_id").to_numpy(), zeros, matrix(column(batch, "v")), qids, q, every * 0, every, k))

        near = top(self.rows.mapInArrow(exact, HITS), k).select("query_id", "vec_id")
        pairs = near.join(self.rows, "vec_id").join(self.queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id")
        return self.work.save(pairs.select("query_id", "q", "vec_id", "v"), "truth")

    def fitted(self, placed: DataFrame, counts: DataFrame, level: int) -> DataFrame | None:
        """Trees for the leaves of more than ``split_rows`` rows: (leaf, centres, spread, parent)."""
        if level >= LEVELS or not counts.where(F.col("n") > self.split_rows).limit(1).count():
            return None
        wide, most, rows_each = 1 << 30, self.sample, self.leaf_rows
        large = counts.where(F.col("n") > self.split_rows).select("leaf", "n")
        drawn = placed.join(large, "leaf").where(F.pmod(F.xxhash64("vec_id", F.lit(level)), F.lit(wide)) < F.lit(float(wide * most)) / F.col("n"))

        def one(key: tuple, group: pa.Table) -> pa.Table:
            rows = matrix(group.column("v").combine_chunks())
            n = group.column("n")[0].as_py()
            tree = fit(rows, max(LEAST_ROWS, rows_each * len(rows) // n))
            return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int64()), *[pa.array([x], pa.binary()) for x in tree.stored()]], names=["leaf", "centres", "spread", "parent"])

        trees = drawn.select("leaf", "n", "v").groupBy("leaf").applyInArrow(one, "leaf long, centres binary, spread binary, parent binary")
        splits = self.work.save(trees.where(F.octet_length("parent") > 8), f"splits-{level}")
        return splits if splits.limit(1).count() else None

    def in_blocks(self, rows: DataFrame, key: str, each: int, fields: list[str]) -> DataFrame:
        """(key, rows) with up to about so many rows in each array, dealt by hash."""
        counts = rows.groupBy(key).agg(F.ceil(F.count("*") / each).alias("_blocks"))
        dealt = rows.join(counts, key).withColumn("_block", F.pmod(F.xxhash64("vec_id"), F.col("_blocks")))
        return dealt.groupBy(key, "_block").agg(F.collect_list(F.struct(*fields)).alias("rows")).drop("_block")

    def placed_below(self, placed: DataFrame, splits: DataFrame) -> DataFrame:
        """The rows of split leaves with their leaves one level down."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for n in range(batch.num_rows):
                    parent, tree = column(batch, "leaf")[n].as_py(), restored(*(column(batch, c)[n].as_py() for c in ("centres", "spread", "parent")))
                    ids, v = column(batch, "ids")[n].values, column(batch, "v")[n].values
                    v = pa.FixedSizeListArray.from_arrays(v, tree.centres.shape[1])
                    at = parent * WIDTH + 1 + leaves(tree, matrix(v))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), parent)), pa.array(at), ids, v.cast(pa.list_(v.type.value_type))], names=["parent", "leaf", "vec_id", "v"])

        below = placed.join(splits.select("leaf"), "leaf", "left_semi")
        blocks = self.in_blocks(below, "leaf", ROUTE_ROWS, ["vec_id", "v"]).join(splits, "leaf")
        return blocks.select("leaf", F.col("rows.vec_id").alias("ids"), F.flatten("rows.v").alias("v"), "centres", "spread", "parent").mapInArrow(run, f"parent long, leaf long, vec_id long, v {self.type}")

    def cells(self, placed: DataFrame, splits: DataFrame | None, counts: DataFrame, level: int) -> DataFrame:
        """Each leaf's rows and bin: neighbours together up to ``bin_rows``; bin null where the leaf is split."""
        is_split = counts.join(splits.select("leaf", F.lit(True).alias("_split")), "leaf", "left") if splits is not None else counts.withColumn("_split", F.lit(None).cast("boolean"))
        up_to = Window.partitionBy("parent").orderBy("leaf").rowsBetween(Window.unboundedPreceding, 0)  # the leaves of one tree
        whole = is_split.withColumn("_to", F.sum(F.when(F.col("_split").isNull(), F.col("n")).otherwise(0)).over(up_to))
        named = whole.withColumn("bin", F.when(F.col("_split").isNull(), F.col("parent") * WIDTH + F.floor((F.col("_to") - 1) / self.bin_rows)))
        return self.work.save(named.select("parent", "leaf", "n", "bin"), f"cells-{level}")

    def widened(self, ranks: np.ndarray, last: bool) -> int:
        """Leaves to visit at this level, from the ranks at which true neighbours would be met."""
        aim = self.left if last else self.left**0.5
        most = 1
        while len(ranks) and (ranks < most).mean() < aim:
            most += max(1, most // 16)
        self.left = aim if last else self.left / aim
        log.info("%d leaves visited at this level: recall %.3f of %d pairs", most, (ranks < most).mean() if len(ranks) else 1.0, len(ranks))
        return most if len(ranks) else 16

    @property
    def asked_schema(self) -> str:
        return f"vec_id long, v {self.type}, down boolean, bin long, leaves array<long>"


def visited(k: int, tree: Tree, size: np.ndarray, bins: np.ndarray, parent: int, most: int, qids: np.ndarray, v: pa.Array) -> pa.RecordBatch:
    """A row for each query and bin, and each query and split leaf, that the query goes to."""
    q, children = matrix(v), tree.children
    near = priorities(tree, q)
    rows: tuple[list, list, list, list] = ([], [], [], [])
    for n in range(len(qids)):
        go = np.array(visits(children, near[n].tolist(), most, size, k + 1))
        at, to = go + parent * WIDTH + 1, bins[go]
        for b in np.unique(to[to != NONE]).tolist():
            for part in at[to == b][:, None] if b == SPLIT else [at[to == b]]:  # a split leaf by itself
                for x, y in zip(rows, (n, b == SPLIT, int(part[0]) if b == SPLIT else b, part.tolist()), strict=True):
                    x.append(y)
    take, down, to, lists = rows
    return pa.RecordBatch.from_arrays([pa.array(qids[take]), v.take(pa.array(take, pa.int64())), pa.array(down, pa.bool_()), pa.array(to, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], names=["vec_id", "v", "down", "bin", "leaves"])


def _by_node(nodes: int, parent: int, leaf: np.ndarray, n: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and bins by a tree's nodes: SPLIT for split leaves, NONE for those without rows."""
    size, to = np.zeros(nodes, np.int64), np.full(nodes, NONE)
    size[leaf - parent * WIDTH - 1], to[leaf - parent * WIDTH - 1] = n, bins
    return size, to


def search(vectors: DataFrame, is_query: Column, k: int = 20, recall: float = RECALL, sample: int = SAMPLE, leaf_rows: int = LEAF_ROWS, split_rows: int = SPLIT_ROWS, bin_rows: int = BIN_ROWS) -> DataFrame:
    """The k nearest of each query (a Boolean of vec_id) among all rows: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    s = Search(vectors, is_query, k, recall, sample, leaf_rows, split_rows, bin_rows)
    if s.empty:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    total = s.rows.count()
    picked = bounded_sample(s.rows, "vec_id", sample).select("v").toArrow()
    first = fit(matrix(picked.column(0).combine_chunks()), max(LEAST_ROWS, leaf_rows * picked.num_rows // total))
    truth = s.truth()

    def to_leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(batch.num_rows, np.int64)), pa.array(leaves(first, matrix(column(batch, "v"))) + 1), column(batch, "vec_id"), column(batch, "v")], names=["parent", "leaf", "vec_id", "v"])

    schema = f"parent long, leaf long, vec_id long, v {s.type}"
    placed = s.work.save(s.rows.mapInArrow(to_leaf, schema), "placed-0")
    all_rows, all_asked, level, asked, above = [], [], 0, s.queries, None
    while True:
        counts = s.work.save(placed.groupBy("parent", "leaf").agg(F.count("*").alias("n")), f"counts-{level}")
        splits = s.fitted(placed, counts, level)
        cells = s.cells(placed, splits, counts, level)
        last = splits is None
        if level == 0:
            asked = _first_visits(s, first, cells, truth, last)
        else:
            asked = _next_visits(s, above, cells, truth, placed, asked, last, level)
        asked = s.work.save(asked, f"asked-{level}")
        all_rows.append(placed.join(cells.where("bin is not null").select("leaf", "bin"), "leaf").select("bin", "leaf", "vec_id", "v"))
        all_asked.append(asked.where("not down").select("bin", "vec_id", "v", "leaves"))
        if last:
            break
        level += 1
        placed, above = s.work.save(s.placed_below(placed, splits), f"placed-{level}"), splits
    return top(s.work.save(_met(s, all_rows, all_asked), "hits"), k)


def _first_visits(s: Search, tree: Tree, cells: DataFrame, truth: DataFrame, last: bool) -> DataFrame:
    """Calibrates and walks the first tree, whose leaves are at most ``sample`` / LEAST_ROWS."""
    got = cells.toArrow()
    size, bins = _by_node(len(tree.parent), 0, got.column("leaf").to_numpy(), got.column("n").to_numpy(), got.column("bin").fill_null(SPLIT).to_numpy())
    pairs = truth.select("q", "v").toArrow()  # at most CALIBRATION times k rows
    most = s.widened(_ranks(tree, pairs.column("q").combine_chunks(), pairs.column("v").combine_chunks()), last)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield visited(k, tree, size, bins, 0, most, column(part, "vec_id").to_numpy(), column(part, "v"))

    k = s.k
    return s.queries.mapInArrow(run, s.asked_schema)


def _next_visits(s: Search, splits: DataFrame, cells: DataFrame, truth: DataFrame, placed: DataFrame, asked: DataFrame, last: bool, level: int) -> DataFrame:
    """Calibrates and walks the trees of leaves that were split, one task for many of their blocks of queries."""

    def ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                tree = restored(*(column(batch, c)[n].as_py() for c in ("centres", "spread", "parent")))
                got = _ranks(tree, column(batch, "q").slice(n, 1), column(batch, "v").slice(n, 1))
                yield pa.RecordBatch.from_arrays([pa.array(got)], names=["rank"])

    pairs = truth.join(placed.select("vec_id", F.col("parent").alias("leaf")), "vec_id").join(splits, "leaf")
    most = s.widened(pairs.select("q", "v", "centres", "spread", "parent").mapInArrow(ranks, "rank long").toArrow().column(0).to_numpy(), last)
    names = cells.groupBy("parent").agg(F.collect_list(F.struct("leaf", "n", F.coalesce("bin", F.lit(SPLIT)).alias("bin"))).alias("c")).select(F.col("parent").alias("leaf"), F.col("c.leaf").alias("c_leaf"), F.col("c.n").alias("c_n"), F.col("c.bin").alias("c_bin"))
    blocks = s.in_blocks(asked.where("down").select(F.col("bin").alias("leaf"), "vec_id", "v"), "leaf", QUERY_BLOCK, ["vec_id", "v"]).join(splits, "leaf").join(names, "leaf")
    k = s.k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                get = lambda c: column(batch, c)[n]  # noqa: B023, E731
                tree, parent = restored(*(get(c).as_py() for c in ("centres", "spread", "parent"))), get("leaf").as_py()
                size, bins = _by_node(len(tree.parent), parent, *(get(c).values.to_numpy() for c in ("c_leaf", "c_n", "c_bin")))
                v = pa.FixedSizeListArray.from_arrays(get("v").values, tree.centres.shape[1])
                yield visited(k, tree, size, bins, parent, most, get("ids").values.to_numpy(), v.cast(pa.list_(v.type.value_type)))

    fields = ["leaf", F.col("rows.vec_id").alias("ids"), F.flatten("rows.v").alias("v"), "centres", "spread", "parent", "c_leaf", "c_n", "c_bin"]
    return blocks.select(*fields).mapInArrow(run, s.asked_schema)


def _ranks(tree: Tree, queries: pa.Array, rows: pa.Array) -> np.ndarray:
    """For each pair, how many leaves a query opens before that of the row."""
    if not len(queries):
        return np.zeros(0, np.int64)
    q, at, children = matrix(queries), leaves(tree, matrix(rows)), tree.children
    known: dict[bytes, dict[int, int]] = {}
    for x, near in zip(q, priorities(tree, q), strict=True):
        if x.tobytes() not in known:
            known[x.tobytes()] = {leaf: r for r, leaf in enumerate(visits(children, near.tolist(), len(near)))}
    return np.array([known[x.tobytes()][leaf] for x, leaf in zip(q, at.tolist(), strict=True)], np.int64)


def _met(s: Search, rows: list[DataFrame], asked: list[DataFrame]) -> DataFrame:
    """HITS of each pair of a bin's block of rows and block of queries."""
    k = s.k
    every, asking = rows[0], asked[0]
    for more in rows[1:]:
        every = every.union(more)
    for more in asked[1:]:
        asking = asking.union(more)
    counts = s.work.save(every.groupBy("bin").agg(F.ceil(F.count("*") / (2 * s.bin_rows)).alias("blocks")), "bins")
    sized = small(counts)
    dealt = every.join(sized, "bin").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")))
    held = dealt.groupBy("bin", "block").agg(F.collect_list(F.struct("vec_id", "leaf", "v")).alias("r")).select("bin", "block", F.col("r.vec_id").alias("ids"), F.col("r.leaf").alias("leaf"), F.flatten("r.v").alias("x"))
    parts = asking.groupBy("bin").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("parts"))
    grouped = asking.join(parts, "bin").withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("parts"))).groupBy("bin", "part").agg(F.collect_list(F.struct("vec_id", "v", "leaves")).alias("q"))
    over = grouped.join(sized, "bin").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    query = over.select("bin", "block", F.col("q.vec_id").alias("qids"), F.flatten("q.v").alias("qx"), F.flatten("q.leaves").alias("asked"), F.transform("q.leaves", F.size).alias("times"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                ids, leaf, x, qids, q, leaves_, times = (column(batch, c)[n].values.to_numpy() for c in ("ids", "leaf", "x", "qids", "qx", "asked", "times"))
                x, q = x.astype(float).reshape(len(ids), -1), q.astype(float).reshape(len(qids), -1)
                yield _hits(qids, *nearest_in(ids, leaf, x, qids, q, leaves_, np.repeat(np.arange(len(qids)), times), k))

    return held.join(query, ["bin", "block"]).drop("bin", "block").mapInArrow(run, HITS)


def op10_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
