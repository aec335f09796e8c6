"""Ranked retrieval: BM25, exact nearest neighbours, reciprocal-rank fusion, token overlap."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.scalars import RAW_WORD, folded, query_terms, terms
from threadloom.operators.index import Index
from threadloom.scratch import folder, written

K1, B = 1.2, 0.75
_ALONE = r"(?<![\p{L}\p{N}])%s(?![\p{L}\p{N}])"


def _scores(rows: DataFrame, stats: DataFrame, keep: list[str], query: list[str]) -> DataFrame:
    """BM25 from each row's length _dl and counts _0, _1, … and one row of _n, _avg and document counts."""

    def part(k: int):
        idf = F.log(1 + (F.col("_n") - F.col(f"_df{k}") + 0.5) / (F.col(f"_df{k}") + 0.5))
        return idf * F.col(f"_{k}") * (K1 + 1) / (F.col(f"_{k}") + K1 * (1 - B + B * F.col("_dl") / F.col("_avg")))

    hits = rows.where(" or ".join(f"_{k} > 0" for k in range(len(query)))).join(F.broadcast(stats))  # one row
    return hits.select(*keep, F.round(sum(part(k) for k in range(len(query))), 6).alias("score"))


def bm25(docs: DataFrame, doc_id: str, text: str, query: list[str], keep: list[str] = ()) -> DataFrame:
    """Scores of documents with some query term (larger is better); counts are taken over all documents.

    Texts are read once: lengths and the query's counts, a narrow row for each document, are written.
    For many searches of one table see ``write_index``.
    """
    keep, query = [doc_id, *keep], query_terms(query)
    if not query:
        return docs.select(*keep, F.lit(0.0).alias("score")).limit(0)
    plain = docs.select(*keep, F.coalesce(F.regexp_count(text, F.lit(RAW_WORD)), F.lit(0)).alias("_dl"), folded(F.col(text)).alias("_text"))
    counts = [F.when(F.contains("_text", F.lit(q)), F.regexp_count("_text", F.lit(_ALONE % re.escape(q)))).otherwise(0).alias(f"_{k}") for k, q in enumerate(query)]
    rows = written(plain.select(*keep, "_dl", *counts), f"{folder(docs.sparkSession, 'bm25')}/counts")
    stats = rows.agg(F.count("*").alias("_n"), F.avg("_dl").alias("_avg"), *[F.count_if(F.col(f"_{k}") > 0).alias(f"_df{k}") for k in range(len(query))])
    return _scores(rows, stats, keep, query)


def write_index(docs: DataFrame, doc_id: str, text: str, path: str) -> Index:
    """An inverted index of all documents; ``Index.apply`` keeps it up to date. Of rows with one id one is taken."""
    index = Index(docs.sparkSession, path)
    index.apply(docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"), F.lit(False).alias("deleted")))
    return index


#: Indexes of this process by session, table and column.
_KEPT: dict[tuple, tuple[str, str]] = {}


def kept_index(docs: DataFrame, doc_id: str, text: str) -> Index:
    """The index of a table of files: built when first asked for, and brought up to date when its files are others than before."""
    spark = docs.sparkSession
    files = docs.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")  # no column of the table is read
    mark = str(files.agg(F.sum(F.xxhash64("*").cast("decimal(38,0)"))).first()[0])
    first = next(iter(docs.inputFiles()), "")
    table = first.rsplit("/", 1)[0] if "/part-" in first else first  # a folder's files may come and go
    key = (spark.sparkContext.applicationId, doc_id, text, table)
    path, seen = _KEPT.get(key, (None, None))
    if path is None or not Index(spark, path).version():  # none yet, or its folder was cleared
        path = f"{folder(spark, 'kept')}/index"
        write_index(docs, doc_id, text, path)
    elif seen != mark:
        index, source = Index(spark, path), docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
        index.apply(index.drift(source).join(source, "doc", "left").select("doc", "text", (F.col("state") == "extra").alias("deleted")))
    _KEPT[key] = (path, mark)
    return Index(spark, path)


def search_index(index: Index, query: list[str]) -> DataFrame:
    """(doc, score) as ``bm25`` gives them, from an index."""
    query, state = query_terms(query), index.state()
    counts = [F.coalesce(F.max(F.when(F.col("term") == q, F.col("tf"))), F.lit(0)).alias(f"_{k}") for k, q in enumerate(query)]
    rows = index.postings(query, state).groupBy("doc").agg(F.first("dl").alias("_dl"), *counts)
    docs, words = index.counts(state)
    held = rows.agg(*[F.count_if(F.col(f"_{k}") > 0).alias(f"_df{k}") for k in range(len(query))])
    return _scores(rows, held.select("*", F.lit(docs).alias("_n"), F.lit(words / max(docs, 1)).alias("_avg")), ["doc"], query)


def boolean(index: Index, every: list[str] = (), some: list[str] = (), none: list[str] = ()) -> DataFrame:
    """Documents of an index that hold every word of one list, some of another and none of a third."""
    every, some, none = map(query_terms, (every, some, none))
    found = index.postings([*every, *some, *none]).groupBy("doc").agg(F.collect_set("term").alias("_t"))  # query words only
    has = [F.array_contains("_t", w) for w in every]
    if some:
        has.append(F.arrays_overlap("_t", F.array(*map(F.lit, some))))
    has += [~F.array_contains("_t", w) for w in none]
    if every or some:
        for one in has:
            found = found.where(one)
        return found.select("doc")
    barred = found.where(F.arrays_overlap("_t", F.array(*map(F.lit, none)))).select("doc") if none else None
    every_doc = index.docs()
    return every_doc if barred is None else every_doc.join(barred, "doc", "left_anti")


def _in_order(words: list[str]) -> list[str]:
    """A phrase's terms, repeated ones as often as they stand in it."""
    return [t for w in words for part in re.findall(r"[^\W_]+", w) for t in query_terms([part])]


def phrase_in_index(index: Index, words: list[str]) -> DataFrame:
    """Documents of an index in which the words stand next to each other, by their places."""
    words = _in_order(words)
    here = index.postings(list(dict.fromkeys(words)), places=True).groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("term", "places"))).alias("_m"))
    back = lambda k: lambda place: place - k
    at = [F.transform(F.coalesce(F.col("_m")[w], F.array().cast("array<int>")), back(k)) for k, w in enumerate(words)]
    both = at[0]
    for more in at[1:]:
        both = F.array_intersect(both, more)
    return here.where(F.size(both) > 0).select("doc")


def best_blocks(blocks: DataFrame, session: str, block: str, text: str, at: str, query: list[str]) -> DataFrame:
    """Each session's best block by BM25 over blocks (score, then the later, then the smaller block), in that order of sessions."""
    scored = bm25(blocks, block, text, query, [session, at])
    place = F.row_number().over(Window.partitionBy(session).orderBy(F.desc("score"), F.desc(at), block))
    return scored.withColumn("_r", place).where("_r = 1").drop("_r")


def nearest(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """The k nearest to one vector by inner product, in built-in functions."""
    q = F.array(*[F.lit(float(x)) for x in query])
    score = F.aggregate(F.zip_with(F.col("embedding"), q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, x: a + x)
    return vectors.select("vec_id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(k)


def fuse(lists: list[DataFrame], item: str, k: int = 60) -> DataFrame:
    """Sum of 1 / (k + rank) over ranked lists; an item counts once in each, at its first place."""
    ranked = []
    for n, df in enumerate(lists):
        first = df.groupBy(item).agg(F.min("rank").alias("rank"))
        ranked.append(first.select(item, (1 / (F.lit(k) + F.col("rank"))).alias("part"), F.lit(n).alias("lane")))
    both = ranked[0]
    for df in ranked[1:]:
        both = both.unionByName(df)
    return both.groupBy(item).agg(F.round(F.sum("part"), 8).alias("score"))


def ranked(df: DataFrame, by: str, item: str, k: int) -> DataFrame:
    """The k best with their ranks."""
    top = df.orderBy(F.desc(by), item).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(by), item)))


def overlap(docs: DataFrame, doc_id: str, text: str, seed: str, least: float) -> DataFrame:
    """Token-set similarity to one text, |A ∩ B| / sqrt(|A| |B|)."""
    a = F.array_distinct(terms(F.col(text)))
    b = F.array_distinct(terms(F.lit(seed)))
    score = F.round(F.size(F.array_intersect(a, b)) / F.sqrt(F.size(a) * F.size(b)), 6)
    return docs.where(F.size(a) > 0).select(doc_id, score.alias("score")).where(F.col("score") >= least)


# The words that tell no session from another, and what a token is.
STOP_WORDS = "about after again also and are but can could for from have how into not our please that the this was what when with would you your".split()
TOKEN = "[a-z0-9][a-z0-9_-]{2,}"


def token_similarity(docs: DataFrame, doc_id: str, text: str, seed: str, least: float = 0.12) -> DataFrame:
    """|A ∩ B| / sqrt(|A| |B|) of the tokens of each text and of one, without stop words; texts without tokens, and those below ``least``, are left out."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    tokens = lambda c: F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))), stop)
    both = docs.select(doc_id, tokens(F.col(text)).alias("_a"), tokens(F.lit(seed)).alias("_b")).where("size(_a) > 0 and size(_b) > 0")
    score = F.size(F.array_intersect("_a", "_b")) / F.sqrt(F.size("_a").cast("double") * F.size("_b"))
    return both.select(doc_id, F.round(score, 6).alias("score")).where(F.col("score") >= least)


def phrase(text: Column, words: list[str], prefix: bool = False) -> Column:
    """The words stand next to each other; with ``prefix`` the last may go on."""
    inner = r"[^\p{L}\p{N}]+".join(map(re.escape, _in_order(words)))
    return F.rlike(folded(text), F.lit(r"(^|[^\p{L}\p{N}])" + inner + ("" if prefix else r"([^\p{L}\p{N}]|$)")))


def snippet(text: Column, word: str, before: int = 6, after: int = 17) -> Column:
    """The first hit with its neighbours, 24 words by default; each hit in it stands in brackets."""
    word = "|".join(query_terms([word]))
    one, gap = r"[\p{L}\p{N}]+", r"[^\p{L}\p{N}]+"
    cut = F.regexp_extract(folded(text), f"(?:{one}{gap}){{0,{before}}}(?<![\\p{{L}}\\p{{N}}])(?:{word})(?![\\p{{L}}\\p{{N}}])(?:{gap}{one}){{0,{after}}}", 0)
    return F.regexp_replace(cut, _ALONE % word, f"[{word}]")


def plain_score(rows: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """20 and the word count for the whole query, 4 for each word; a session's best and up to 5 for more hits."""
    words = query.lower().split()
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    whole = F.when(F.contains(low, F.lit(query.lower())), 20 + len(words)).otherwise(0)
    scored = rows.withColumn("_s", whole + sum(F.when(F.contains(low, F.lit(w)), 4).otherwise(0) for w in words)).where("_s > 0")
    return scored.groupBy(key).agg((F.max("_s") + F.least(F.count("*") - 1, F.lit(5))).cast("long").alias("score"))


#: Vectors and seeds that a task of ``nearest_to_seeds`` holds at once, about.
CELL_VECTORS, CELL_SEEDS = 4096, 8192


def _padded(col: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Lists as rows of doubles, 0 where a component is missing, and where there is one."""
    sizes = pc.fill_null(pc.list_value_length(col), 0).to_numpy()
    flat = pc.list_flatten(col)
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    values, held = np.zeros((len(sizes), width)), np.zeros((len(sizes), width), bool)
    held[row, place] = pc.is_valid(flat).to_numpy()
    values[row, place] = pc.fill_null(flat, 0).to_numpy()
    return values, held


def _exact(a: np.ndarray, in_a: np.ndarray, s: np.ndarray, in_s: np.ndarray) -> np.ndarray:
    """Distances of rows to rows, summed component by component; those that one lacks are left out, and NaN stands for none at all."""
    total = np.zeros(np.broadcast_shapes(a.shape[:-1], s.shape[:-1]))
    with np.errstate(invalid="ignore", over="ignore"):
        for k in range(a.shape[-1]):
            both = in_a[..., k] & in_s[..., k]
            total += np.where(both, a[..., k] - s[..., k], 0.0) ** 2
        return np.sqrt(total)


def _least(left: pa.Table, right: pa.Table) -> pa.Table:
    """Each vector's least distance to the seeds of one cell: a matrix product leaves those that can be nearest, whose distances are summed exactly."""
    width = max(pc.max(pc.list_value_length(t["embedding"])).as_py() or 0 for t in (left, right))
    a, in_a = _padded(left["embedding"], width)
    s, in_s = _padded(right["embedding"], width)
    s, first = np.unique(np.where(in_s, s, np.nan) + 0.0, axis=0, return_index=True, equal_nan=False)
    in_s = in_s[first]
    plain_a, plain_s = (in_a & np.isfinite(a)).all(axis=1), (in_s & np.isfinite(s)).all(axis=1)
    s = np.where(in_s, s, 0.0)
    best, none = np.full(len(a), np.nan), np.ones(len(a), bool)

    def take(rows: np.ndarray, found: np.ndarray, known: np.ndarray) -> None:
        """NaN is a distance, the largest; a pair without components in common has none."""
        least = np.fmin.reduce(np.where(known, found, np.nan), axis=1)
        best[rows], none[rows] = np.fmin(best[rows], least), none[rows] & ~known.any(axis=1)

    some = s[plain_s]
    squares = (some * some).sum(axis=1)
    rows = np.flatnonzero(plain_a) if len(some) and width else np.array([], int)
    for k in range(0, len(rows), 512):
        x = a[rows[k : k + 512]]
        own = (x * x).sum(axis=1)
        with np.errstate(invalid="ignore", over="ignore"):
            near = own[:, None] + squares - 2 * (x @ some.T)
            slack = 1e-14 * (width + 8) * (own + squares.max())
            at, seed = np.nonzero(~(near > (near.min(axis=1) + slack)[:, None]))
        for j in range(0, len(at), 1 << 16):
            i, q = at[j : j + (1 << 16)], seed[j : j + (1 << 16)]
            np.fmin.at(best, rows[k + i], _exact(x[i], np.ones_like(x[i], bool), some[q], np.ones_like(x[i], bool)))
        none[rows[k : k + 512]] = False
    odd = [(np.flatnonzero(~plain_a) if len(rows) else np.arange(len(a)), np.arange(len(s)))]
    if len(rows):
        odd.append((rows, np.flatnonzero(~plain_s)))
    for vectors, seeds in odd:
        for k in range(0, len(vectors), 256):
            for j in range(0, len(seeds), 1024):
                v, q = vectors[k : k + 256], seeds[j : j + 1024]
                take(v, _exact(a[v][:, None], in_a[v][:, None], s[q][None], in_s[q][None]), (in_a[v][:, None] & in_s[q][None]).any(axis=2))
    return pa.table({"vec_id": left["vec_id"], "distance": pa.array(best, pa.float64(), mask=none)})


def nearest_to_seeds(vectors: DataFrame, group: str, seed, k: int, seeds: int = CELL_SEEDS) -> DataFrame:
    """The k vectors outside a group that are nearest (Euclidean) to any of its vectors.

    Every vector meets every seed: both are dealt into slots, and a task takes one slot of each, of a bounded size.
    A component that either lacks is left out; a vector that shares none with a seed comes last, without a distance.
    """
    rows = vectors.select("vec_id", "embedding", (F.col(group) == seed).alias("_own")).where("_own is not null")
    sizes = rows.agg(F.count_if("_own").alias("own"), F.count_if(~F.col("_own")).alias("other")).first()
    down, across = max(1, -(-sizes.other // CELL_VECTORS)), max(1, -(-sizes.own // seeds))
    dealt = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.where("not _own").select("vec_id", "embedding", dealt(down).alias("i"), every(across).alias("j"))
    right = rows.where("_own").select("embedding", every(down).alias("i"), dealt(across).alias("j"))
    each = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(_least_in_cell, f"vec_id {dict(rows.dtypes)['vec_id']}, distance double")
    least = each.groupBy("vec_id").agg(F.round(F.min("distance"), 6).alias("distance"))
    return least.orderBy(F.asc_nulls_last("distance"), "vec_id").limit(k)


def _least_in_cell(left: pa.Table, right: pa.Table) -> pa.Table:
    if left.num_rows and right.num_rows:
        return _least(left, right)
    return pa.table({"vec_id": left["vec_id"].slice(0, 0), "distance": pa.array([], pa.float64())})


def embeddable(rows: DataFrame) -> DataFrame:
    """Texts worth a vector (20 characters or more, not the system's), one for each content hash."""
    kept = rows.where((F.length("text") >= 20) & (F.col("role") != "system"))
    return kept.groupBy(F.sha2("text", 256).alias("content")).agg(F.count("*").alias("refs"), F.min("session_id").alias("first_session"))


def lanes(lists: dict[str, DataFrame], item: str, k: int = 60) -> DataFrame:
    """Fused score and each lane's rank (null where it lacks the item)."""
    both = None
    for name, df in lists.items():
        part = df.groupBy(item).agg(F.min("rank").alias("rank")).withColumn("lane", F.lit(name))
        both = part if both is None else both.unionByName(part)
    return both.groupBy(item).agg(F.round(F.sum(1 / (F.lit(k) + F.col("rank"))), 8).alias("score"), *[F.max(F.when(F.col("lane") == n, F.col("rank"))).cast("long").alias(f"{n}_rank") for n in lists])


def neighbours(sessions: DataFrame, ref, k: int, hours: float = 24.0) -> DataFrame:
    """Sessions near one, by weighted reasons; sessions without a reason are left out.

    Fixed weights: same title 3.0; near in time 1.5 by closeness, 0.1 at least.
    """
    one = F.broadcast(sessions.where(F.col("session_id") == ref).select(F.col("title").alias("_title"), F.col("sort_key").alias("_at")))
    apart = F.abs(F.unix_micros(F.col("sort_key").cast("timestamp")) - F.unix_micros(F.col("_at").cast("timestamp"))) / 3_600_000_000
    title = F.when(F.col("title") == F.col("_title"), 3.0).otherwise(0.0)
    close = F.when(apart <= hours, 1.5 * F.greatest(1 - apart / hours, F.lit(0.1))).otherwise(0.0)
    scored = sessions.where(F.col("session_id") != ref).join(one).withColumn("score", F.round(title + close, 6)).where("score > 0")
    return scored.orderBy(F.desc("score"), F.desc("sort_key"), "session_id").limit(k).select("session_id", "score")


def neighbours_by_reasons(reasons: DataFrame, k: int) -> DataFrame:
    """Sessions near one from any reasons (session_id, reason, strength), each counted once at its best.

    Fixed weights: same title 3.0; near in time 1.5 by closeness, 0.1 at least; attachment 4.0; content
    1.75; query match 2.0, or by its strength from 0.5 to 3; similarity 3.0 by its strength.
    """
    s = F.col("strength")
    score = (
        F.when(F.col("reason") == "same_title", 3.0)
        .when(F.col("reason") == "nearby_time", 1.5 * F.greatest(s, F.lit(0.1)))
        .when(F.col("reason") == "attachment", 4.0)
        .when(F.col("reason") == "content_search", 1.75)
        .when(F.col("reason") == "query_match", F.greatest(F.lit(0.5), F.least(F.lit(3.0), F.coalesce(s, F.lit(2.0)))))
        .when(F.col("reason") == "similarity", 3.0 * s)
    )
    best = reasons.withColumn("_score", score).groupBy("session_id", "reason").agg(F.max("_score").alias("_score"))
    whole = best.groupBy("session_id").agg(F.round(F.sum("_score"), 6).alias("score"), F.array_join(F.array_sort(F.collect_list("reason")), ",").alias("reasons"))
    return whole.where("score > 0").orderBy(F.desc("score"), "session_id").limit(k)


def metadata_similarity(sessions: DataFrame, ref, k: int) -> DataFrame:
    """R24, fixed weights: 3 same shape, 1 same origin, 2 within 3 days or 1 within 14, 1 for each tag in common where there is such a column."""
    tagged = "tags" in sessions.columns
    one = F.broadcast(sessions.where(F.col("session_id") == ref).select(F.col("state").alias("_shape"), F.col("origin").alias("_origin"), F.col("sort_key").alias("_at"), *([F.col("tags").alias("_tags")] if tagged else [])))
    days = F.abs(F.date_diff("sort_key", "_at"))
    score = F.when(F.col("state") == F.col("_shape"), 3).otherwise(0) + F.when(F.col("origin") == F.col("_origin"), 1).otherwise(0) + F.when(days <= 3, 2).when(days <= 14, 1).otherwise(0)
    if tagged:
        score = score + F.coalesce(F.size(F.array_intersect("tags", "_tags")), F.lit(0))
    return sessions.where(F.col("session_id") != ref).join(one).withColumn("score", score.cast("long")).where("score > 0").orderBy(F.desc("score"), "session_id").limit(k).select("session_id", "score")
