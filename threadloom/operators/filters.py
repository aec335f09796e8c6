"""Session filters: existence of child rows, absence, negative terms, time with unknowns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def having_all(children: DataFrame, key: str, conditions: list[Column]) -> DataFrame:
    """Keys of which, for each condition, some child meets it: one pass, no join."""
    met = children.groupBy(key).agg(*[F.bool_or(c).alias(f"_{k}") for k, c in enumerate(conditions)])
    return met.where(reduce(lambda a, b: a & b, [F.col(f"_{k}") for k in range(len(conditions))])).select(key)


def having_none(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """F11 'none': parents without a child."""
    return parents.join(children.select(key).distinct(), key, "left_anti")


def without_terms(messages: DataFrame, terms: list[str]) -> DataFrame:
    """sessions no message of which contains any term."""
    hit = reduce(lambda a, b: a | b, [F.contains(F.lower("text"), F.lit(t.lower())) for t in terms])
    return messages.groupBy("session_id").agg(F.bool_or(F.coalesce(hit, F.lit(False))).alias("_hit")).where(~F.col("_hit")).select("session_id")


def time_or_unknown(c: Column, condition: Column) -> Column:
    """Rows without a time match every time condition."""
    return c.isNull() | condition


def session_filter(*, origins: list[str] | None = None, exclude_origins: list[str] | None = None, since=None, until=None, title: str | None = None, id_prefix: str | None = None, at_least: dict | None = None, at_most: dict | None = None, tags: list[str] | None = None, exclude_tags: list[str] | None = None, top_level: bool | None = None, repos: list[str] | None = None, projects: list[str] | None = None, continuation: bool | None = None, sidechain: bool | None = None, branches: bool | None = None) -> Column:
    """One condition of all that are given; rows without a time fail time bounds.

    F14: any of the repositories; F15: any of the project names, aliases among them; F20 and F22 are
    given, refused or left open, and a session of no known kind is neither a continuation nor a sidechain.
    """
    parts = [F.lit(True)]
    if origins:
        parts.append(F.col("origin").isin(origins))
    if exclude_origins:
        parts.append(~F.coalesce(F.col("origin").isin(exclude_origins), F.lit(False)))
    if since is not None:
        parts.append(F.col("sort_key") >= F.lit(since))
    if until is not None:
        parts.append(F.col("sort_key") <= F.lit(until))
    if title is not None:
        parts.append(F.contains(F.lower("title"), F.lit(title.lower())))
    if id_prefix is not None:
        parts.append(F.col("session_id").cast("string").startswith(id_prefix))
    parts += [F.col(c) >= n for c, n in (at_least or {}).items()] + [F.col(c) <= n for c, n in (at_most or {}).items()]
    if tags:
        parts.append(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    if exclude_tags:
        parts.append(~F.coalesce(F.arrays_overlap("tags", F.array(*map(F.lit, exclude_tags))), F.lit(False)))
    if top_level is not None:
        parts.append(F.col("parent_session_id").isNull() if top_level else F.col("parent_session_id").isNotNull())
    if repos:
        parts.append(F.coalesce(F.arrays_overlap("repos", F.array(*map(F.lit, repos))), F.lit(False)))
    if projects:
        parts.append(F.col("project").isin(projects))
    for kind, wanted in (("continuation", continuation), ("sidechain", sidechain)):
        if wanted is not None:
            is_kind = F.coalesce(F.col("branch") == kind, F.lit(False))
            parts.append(is_kind if wanted else ~is_kind)
    if branches is not None:
        parts.append(F.col("has_branches") if branches else ~F.coalesce("has_branches", F.lit(False)))
    return reduce(lambda a, b: a & b, parts)


def with_branches(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """sessions with ``has_branches``: whether some message has two or more replies."""
    many = messages.where("parent_id is not null").groupBy("session_id", "parent_id").agg(F.count("*").alias("_n")).where("_n > 1").select("session_id").distinct()
    return sessions.join(many.withColumn("_b", F.lit(True)), "session_id", "left").withColumn("has_branches", F.coalesce("_b", F.lit(False))).drop("_b")


def page(sessions: DataFrame, offset: int, limit: int) -> DataFrame:
    """A page of the list, newest first, rows without a time last, ties to the larger id."""
    return sessions.orderBy(F.desc_nulls_last("sort_key"), F.desc("session_id")).offset(offset).limit(limit)


def sample(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """N rows by seeded hash of the key, the same in every run."""
    h = F.sha2(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")), 256)
    return df.orderBy(h, key).limit(n)


def since_session(sessions: DataFrame, ref, tree: str) -> DataFrame:
    """sessions of the referenced one's tree that are later than it; the reference is one row."""
    one = sessions.where(F.col("session_id") == ref).select(F.col(tree).alias("_tree"), F.col("sort_key").alias("_at"))
    return sessions.join(F.broadcast(one), (F.col(tree) == F.col("_tree")) & (F.col("sort_key") > F.col("_at"))).drop("_tree", "_at")


def within_band(left: DataFrame, right: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """Pairs of a key whose times differ by at most so many seconds.

    Each left row goes to its own time band and the two next to it, so the join is on equal bands.
    The right table's columns other than the key get the prefix ``other_``.
    """
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    width = seconds * 1_000_000
    band = F.floor(at(ts) / width)
    near = left.withColumn("_band", F.explode(F.array(band - 1, band, band + 1)))
    other = right.select(key, band.alias("_band"), *[F.col(c).alias(f"other_{c}") for c in right.columns if c != key])
    return near.join(other, [key, "_band"]).where(F.abs(at(ts) - at(f"other_{ts}")) <= width).drop("_band")


def session_order(sessions: DataFrame, messages: DataFrame, by: str, reverse: bool = False, seed: str = "") -> DataFrame:
    """O1: sessions with ``order_key`` in order of date, messages, words, longest, tokens or random; the largest first, ``reverse`` the least; ties by id.

    Sessions without messages have 0 and, by date, come as the earliest. A random order is the same for one seed.
    """
    measures = {"messages": F.count("*"), "words": F.sum("word_count"), "longest": F.max("word_count"), "tokens": F.floor(F.sum(F.coalesce(F.length("text"), F.lit(0))) / 4)}
    if by in measures:
        keyed = sessions.join(messages.groupBy("session_id").agg(measures[by].alias("order_key")), "session_id", "left").withColumn("order_key", F.coalesce("order_key", F.lit(0)))
    else:
        keyed = sessions.withColumn("order_key", F.col("sort_key") if by == "date" else F.sha2(F.concat(F.lit(seed), F.col("session_id").cast("string")), 256))
    return keyed.orderBy(F.col("order_key").asc_nulls_first() if reverse else F.col("order_key").desc_nulls_last(), "session_id")


def child_filter(sessions: DataFrame, children: DataFrame, column: str, some: list[str] = (), without: list[str] = ()) -> DataFrame:
    """Sessions with a child whose column (folded) is any of these and none of those; 'none' stands for no child with a value at all.

    Each session's children are looked at once, for all names asked.
    """
    told = children.where(F.coalesce(F.col(column), F.lit("")) != "").groupBy("session_id").agg(F.collect_set(F.when(F.lower(column).isin([*some, *without]), F.lower(column))).alias("_names"))
    both = sessions.join(told, "session_id", "left")

    def holds(names: list[str]) -> Column:
        named = [F.lit(n) for n in names if n != "none"]
        out = F.coalesce(F.arrays_overlap("_names", F.array(*named)), F.lit(False)) if named else F.lit(False)
        return out | F.col("_names").isNull() if "none" in names else out

    if some:
        both = both.where(holds(some))
    if without:
        both = both.where(~holds(without))
    return both.drop("_names")


def has_kinds(messages: DataFrame, kinds: dict[str, Column]) -> DataFrame:
    """for each session, whether some message is of each kind (thinking, tools, attachments, summary, …), in one pass."""
    return messages.groupBy("session_id").agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(f"has_{name}") for name, c in kinds.items()])
