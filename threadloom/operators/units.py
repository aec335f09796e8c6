"""Row relations derived from sessions and actions: files, runs, boundaries, delegations, typed overlay values."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NUMBERS = ("BIGINT", "DOUBLE", "FLOAT", "DECIMAL")


def files(actions: DataFrame, key: str, path: str, ts: str) -> DataFrame:
    """U4: one row for each path a session touched; times stay null where none is known."""
    return actions.where(F.col(path).isNotNull()).groupBy(key, path).agg(F.count("*").alias("action_count"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"))


def boundary(branch: Column) -> Column:
    """How a session's context begins."""
    return F.when(branch == "subagent", "subagent_start").when(branch == "continuation", "resume").otherwise("session_start")


def runs(sessions: DataFrame, harness: dict[str, str]) -> DataFrame:
    """One run for each session (session_id, parent, origin, branch, title, messages); unlisted origins have harness ``unknown``."""
    ref = lambda c: F.concat(F.lit("run:"), F.col(c).cast("string"))
    known = F.create_map(*[F.lit(x) for pair in harness.items() for x in pair])
    return sessions.select(
        ref("session_id").alias("run_ref"), "session_id", ref("parent").alias("parent_run_ref"),
        F.coalesce(F.try_element_at(known, F.col("origin")), F.lit("unknown")).alias("harness"),
        F.when(F.col("branch") == "subagent", "subagent").otherwise("main").alias("role"),
        F.coalesce(F.nullif("title", F.lit("")), F.col("session_id").cast("string")).alias("title"),
        F.when(F.col("messages") > 0, "completed").otherwise("unknown").alias("status"),
    )


def context_snapshots(sessions: DataFrame) -> DataFrame:
    """One boundary for each session."""
    kind = boundary(F.col("branch"))
    return sessions.select(F.concat_ws(":", F.lit("context-snapshot"), F.col("session_id").cast("string"), kind).alias("snapshot_ref"), "session_id", F.concat(F.lit("run:"), F.col("session_id").cast("string")).alias("run_ref"), kind.alias("boundary"))


def handler_kind(tool: Column, command: Column, semantic: Column) -> Column:
    """What ran a call: an MCP server by the tool's name, else a shell if there is a command, else its own kind."""
    return F.when(F.lower(tool).startswith("mcp__"), "mcp").when(F.coalesce(command, F.lit("")) != "", "shell").otherwise(F.coalesce(F.nullif(semantic, F.lit("")), F.lit("tool_use")))


def observed_events(sessions: DataFrame, uses: DataFrame, results: DataFrame) -> DataFrame:
    """A start for each session and an event for each use and result of one (session_id, tool_id); several of either multiply.

    sessions: (session_id, at) rows, of which the earliest counts; uses: (session_id, tool_id, handler);
    results: (session_id, tool_id, at, is_error) with exit_code if there is such a column, which wins.
    """
    none = F.lit(None).cast("string")
    started = sessions.groupBy("session_id").agg(F.min("at").alias("at")).select("session_id", F.lit("session_started").alias("kind"), "at", none.alias("handler"), none.alias("status"))
    status = F.when(F.col("is_error") == 1, "failed").when(F.col("is_error") == 0, "ok").otherwise("unknown")
    if "exit_code" in results.columns:
        status = F.when(F.col("exit_code").isNotNull(), F.when(F.col("exit_code") == 0, "ok").otherwise("failed")).otherwise(status)
    named = uses.where(F.coalesce(F.col("tool_id"), F.lit("")) != "")
    met = named.join(results, ["session_id", "tool_id"])
    return started.unionByName(met.select("session_id", F.lit("tool_finished").alias("kind"), "at", "handler", status.alias("status")))


def blocks(messages: DataFrame) -> DataFrame:
    """The parts of each message's text as rows, prose and fenced code by turns; blank parts are none.

    messages: (session_id, position, role, text). An open fence reaches to the end. ``language`` is the
    fence's own word; a tool's message is of kind ``tool_result`` as a whole.
    """
    parts = F.when(F.col("role") == "tool", F.array("text")).otherwise(F.split("text", "```"))
    cut = messages.select("session_id", "position", "role", F.posexplode(parts).alias("part", "raw"))
    code = F.col("part") % 2 == 1
    kind = F.when(F.col("role") == "tool", "tool_result").when(code, "code").otherwise("text")
    language = F.when(code, F.nullif(F.lower(F.regexp_extract("raw", r"\A([A-Za-z0-9_+#.-]+)[ \t]*\n", 1)), F.lit("")))
    text = F.when(code, F.regexp_replace("raw", r"\A[A-Za-z0-9_+#.-]*[ \t]*\n", "")).otherwise(F.col("raw"))
    return cut.select("session_id", "position", F.col("part").alias("block"), "role", kind.alias("kind"), language.alias("language"), text.alias("text")).where(F.rlike("text", F.lit(r"\S")))


def projected(blocks: DataFrame, kinds: list[str]) -> DataFrame:
    """Each message's text of blocks of these kinds, in order, joined by line ends, and how many blocks were left out."""
    keep = F.col("kind").isin(kinds)
    parts = F.array_sort(F.collect_list(F.when(keep, F.struct("block", "text"))))
    return blocks.groupBy("session_id", "position").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"), F.count_if(~keep).alias("omitted"))


def attached(parents: DataFrame, children: DataFrame, key: str, fields: list[str], order: str, first: int | None = None, last: int | None = None, most: int = 200, text: str | None = None, cut: int = 2000) -> DataFrame:
    """Each parent with its child rows as a list, in order: the first or last so many, ``most`` at most.

    ``total`` counts all children and ``truncated`` says whether some are left out. Of a text column,
    the first ``cut`` characters are kept and ``<name>_truncated_chars`` says how many are not.
    """
    shown = children
    if text is not None:
        shown = shown.withColumn(f"{text}_truncated_chars", F.greatest(F.length(text) - cut, F.lit(0))).withColumn(text, F.substring(text, 1, cut))
        fields = [*fields, f"{text}_truncated_chars"]
    n = min(most, first if first is not None else last if last is not None else most)
    by = F.desc(order) if last is not None and first is None else F.col(order)
    numbered = shown.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(by))).withColumn("_all", F.count("*").over(Window.partitionBy(key)))
    lists = numbered.where(F.col("_r") <= n).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *[f for f in fields if f != order]))).alias("attached"), F.first("_all").alias("total"))
    return parents.join(lists, key, "left").withColumn("total", F.coalesce("total", F.lit(0))).withColumn("truncated", F.col("total") > F.coalesce(F.array_size("attached"), F.lit(0)))


def delegations(dispatches: DataFrame, links: DataFrame, children: DataFrame) -> DataFrame:
    """Each dispatch (action_id, …) with its child, if a link (action_id, child_id) names one and the child (child_id, …) is here."""
    known = children.withColumn("_here", F.lit(True))
    state = F.when(F.col("child_id").isNull(), "unlinked").when(F.col("_here").isNull(), "unresolved").otherwise("resolved")
    return dispatches.join(links, "action_id", "left").join(known, "child_id", "left").withColumn("mapping_state", state).drop("_here")


def json_value_is(text: Column, path: str, value) -> Column:
    """U8: the JSON value at the path equals this one in type and value: 4 is not "4", true not 1, null not "null"."""
    found = F.try_variant_get(F.try_parse_json(text), path, "variant")
    kind = F.schema_of_variant(found)
    if value is None:
        return F.coalesce(F.is_variant_null(found), F.lit(False))
    if isinstance(value, bool) or isinstance(value, str):
        of_type = kind == ("BOOLEAN" if isinstance(value, bool) else "STRING")
        return F.coalesce(of_type & (F.to_json(found) == json.dumps(value, ensure_ascii=False)), F.lit(False))
    return json_number(text, path).eqNullSafe(F.lit(float(value)))


def json_number(text: Column, path: str) -> Column:
    """The number at the path, for comparisons; null for any other type."""
    found = F.try_variant_get(F.try_parse_json(text), path, "variant")
    return F.when(F.regexp_extract(F.schema_of_variant(found), "^[A-Z]+", 0).isin(*NUMBERS), F.try_variant_get(F.try_parse_json(text), path, "double"))
