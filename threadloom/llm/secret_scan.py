"""Operator 13: secrets, told apart by who holds them.

Each text is searched once for assignments, access keys, long hexadecimal runs and, beside these,
long mixed strings ('token'). What a candidate would give away (the assigned value, else the match)
is hashed, and hashes are summed over the corpus by owner and repository. A value that ``OWNERS``
owners or ``REPOS`` repositories hold is a copied example; any other is live-looking. A token is
reported only where it is live-looking; the three base kinds are reported always, with the verdict.

Cases: null and empty texts have no candidates; a null owner or repository is one of its own; equal
rows are separate documents of one owner; the same value twice in a document counts once for its
repository; null doc_ids stay; an empty table gives no rows; columns of the input are only those
named, so others can't clash. A text is searched whole: one row's text must fit a task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.work import Scratch, column, slices, table, texts

#: From so many owners, or repositories, on a value is an example that people copy.
OWNERS, REPOS = 3, 5

#: A token has at least so many characters, and so many different ones.
TOKEN_CHARS, TOKEN_DIFFERENT = 20, 10

KINDS = ("assign", "access", "hex", "token")
BASE = 3

_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Letters of the names are spelled in both cases, as case folding of the regex engine may reach beyond A-Z.
_EITHER = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else f"{c}" for c in x) for x in ("password", "passwd", "secret", "token", "api")) + "_?[Kk][Ee][Yy]"
ASSIGN = rf"""({_EITHER})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Maximal runs of at least the length asked: a shorter run holds no longer one.
ACCESS, HEX, TOKEN = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}", rf"[A-Za-z0-9+/_=-]{{{TOKEN_CHARS},}}"
ASSIGNED = 6

_assign, _access, _hex, _token = map(re.compile, (ASSIGN, ACCESS, HEX, TOKEN))
_FOUND = pa.struct([("kind", pa.int8()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.binary())])
_SPARK = "array<struct<kind:tinyint,start:bigint,end:bigint,value:binary>>"


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, value) of all candidates in a text, by start and kind; a token overlaps no base span."""
    found = []
    low = text.lower()
    if any(x in low for x in _NAMES):  # a plain search first, as most texts hold none of the names
        found += [(0, m.start(), m.end(), m[2]) for m in _assign.finditer(text) if len(m[2]) >= ASSIGNED]
    if "AKIA" in text:
        found += [(1, m.start(), m.end(), m[0]) for m in _access.finditer(text)]
    found += [(2, m.start(), m.end(), m[0]) for m in _hex.finditer(text)]
    held = sorted((a, b) for _, a, b, _ in found)
    k, reach = 0, 0
    for m in _token.finditer(text):
        while k < len(held) and held[k][0] < m.end():
            reach, k = max(reach, held[k][1]), k + 1
        if reach <= m.start() and _mixed(m[0]):
            found.append((3, m.start(), m.end(), m[0]))
    return sorted(found, key=lambda x: (x[1], x[0]))


def _mixed(x: str) -> bool:
    """Has digits, large and small letters, and enough different characters."""
    return len(set(x)) >= TOKEN_DIFFERENT and any("0" <= c <= "9" for c in x) and any("a" <= c <= "z" for c in x) and any("A" <= c <= "Z" for c in x)


def found_in(docs: DataFrame, work: Scratch) -> DataFrame:
    """A row for each document, saved: doc_id, owner, repo, found and a row number."""
    names = ["doc_id", "owner", "repo"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [[(k, a, b, hashlib.sha256(v.encode("utf-8", "surrogatepass")).digest()[:16]) for k, a, b, v in candidates(x)] for x in texts(batch)]
            rows = pa.array([[dict(zip(("kind", "start", "end", "value"), c, strict=True)) for c in x] for x in found], pa.list_(_FOUND))
            yield pa.RecordBatch.from_arrays([*(column(batch, n) for n in names), rows], names=[*names, "found"])

    scanned = docs.mapInArrow(run, f"doc_id bigint, owner string, repo string, found {_SPARK}")
    return work.save(scanned.withColumn("row", F.monotonically_increasing_id()), "found")


def ownership(hits: DataFrame) -> DataFrame:
    """(value, owners, repos): by how many owners and repositories each value is held, each step summed before it is sent on."""
    per_repo = hits.groupBy("value", "owner", "repo").agg(F.count("*").alias("times"))
    per_owner = per_repo.groupBy("value", "owner").agg(F.count("*").alias("repos"))
    return per_owner.groupBy("value").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))


def scan(docs: DataFrame, owner: Column, repo: Column, owners: int = OWNERS, repos: int = REPOS) -> DataFrame:
    """doc_id and spans, sorted by start and kind: kind (place in KINDS), start, end, value (hash), owners, repos and live."""
    work = Scratch(docs.sparkSession)
    saved = found_in(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), owner.cast("string").alias("owner"), repo.cast("string").alias("repo")), work)
    hits = saved.select("row", "owner", "repo", F.explode("found").alias("c")).select("row", "owner", "repo", "c.*")
    held = work.save(ownership(hits), "held")
    live = (F.col("owners") < owners) & (F.col("repos") < repos)
    span = F.struct("start", "kind", "end", "value", "owners", "repos", live.alias("live"))
    per_row = hits.join(held, "value").groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    with_some = saved.where(F.size("found") > 0).select("doc_id", "row").join(per_row, "row").select("doc_id", "spans")
    none = F.array().cast(dict(with_some.dtypes)["spans"])
    return with_some.union(saved.where(F.size("found") == 0).select("doc_id", none))


def op13_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``source`` is the owner; its documents of one language are a repository."""
    docs = table(spark, sf_dir, "documents")
    out = scan(docs, F.col("source"), F.concat_ws("/", "source", "lang"))
    shown = lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"].cast("int") + 1), x["start"].cast("string"), x["end"].cast("string"))
    listed = lambda keep: F.array_join(F.transform(F.filter("spans", keep), shown), ",")
    count = lambda keep: F.size(F.filter("spans", keep)).cast("long")
    of = lambda k: count(lambda x: x["kind"] == k).alias(f"n_{KINDS[k]}")
    return out.select("doc_id", *map(of, range(BASE)), F.sha2(listed(lambda x: x["kind"] < BASE), 256).alias("base_sha256"), listed(lambda x: (x["kind"] < BASE) | x["live"]).alias("spans"), count(lambda x: ~x["live"]).alias("n_examples"))
