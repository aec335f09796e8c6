"""Reports over session profiles: histograms, portfolios, coverage, audits, timelines and chronicles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import content
from threadloom.operators import graph
from threadloom.operators.aggregates import linear_ranks, with_ranks

# How much work an end leaves open.
SEVERITY = {"question_left": 1, "error_left": 2, "tool_left": 3, "agent_hanging": 4}


def by_dimension(profiles: DataFrame, dimension: str) -> DataFrame:
    """Sessions for each value of a profile column; no value is 'unknown'."""
    return profiles.groupBy(F.coalesce(F.nullif(F.col(dimension), F.lit("")), F.lit("unknown")).alias("key")).agg(F.count("*").alias("n"))


def shape_histogram(profiles: DataFrame, by: str) -> DataFrame:
    """Sessions for each workflow shape and week, origin or project; a session counts for each of its paths, or as 'unattributed'."""
    keys = {
        "week": F.array(content.week_of(F.col("date").cast("string"))),
        "origin": F.array("origin"),
        "project": F.when(F.size("paths") > 0, F.col("paths")).otherwise(F.array(F.lit("unattributed"))),
    }[by]
    return profiles.select(F.explode(keys).alias("key"), F.coalesce("shape", F.lit("unknown")).alias("shape")).groupBy("key", "shape").agg(F.count("*").alias("n"))


def abandoned(profiles: DataFrame, least: str, path: str | None = None) -> DataFrame:
    """Sessions whose end leaves at least so much open, newest first, those without a date last."""
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in SEVERITY.items() for x in p]), F.col("terminal_state")), F.lit(0))
    open_ = profiles.withColumn("severity", rank).where(F.col("severity") >= SEVERITY[least])
    if path is not None:
        open_ = open_.where(F.exists("paths", lambda p: F.contains(p, F.lit(path))))
    return open_.orderBy(F.desc_nulls_last("date"), "session_id")


#: Quartiles of what is positive.
_QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def portfolio(profiles: DataFrame, by: str) -> DataFrame:
    """For each group (an origin, or one for a postmortem's scope) sessions, cost, wall time, span, and spreads of what is positive."""
    above = lambda c: F.when(F.col(c) > 0, F.col(c))
    out = profiles.groupBy(by).agg(
        F.count("*").alias("sessions"), F.round(F.sum("cost"), 6).alias("total_cost"), F.min("started").alias("earliest"), F.max("ended").alias("latest"), F.sum(F.greatest("wall_ms", F.lit(0))).alias("wall_ms"),
        F.count(above("cost")).alias("cost_n"), F.max(above("cost")).alias("cost_max"), F.count(above("wall_ms")).alias("wall_n"), F.max(above("wall_ms")).alias("wall_max"),
    )
    for name, value in (("cost", "cost"), ("wall", "wall_ms")):
        some = profiles.where(F.col(value) > 0).select(by, value)
        out = with_ranks(out, linear_ranks(some, by, value, {f"{name}_{k}": p for k, p in _QUARTILES.items()}), by)
    spread = lambda n: [f"{n}_n", *[F.round(f"{n}_{k}", 6).alias(f"{n}_{k}") for k in _QUARTILES], f"{n}_max"]
    return out.select(by, "sessions", "total_cost", "earliest", "latest", "wall_ms", *spread("cost"), *spread("wall"))


def top_of_each(profiles: DataFrame, by: str, value: str, n: int) -> DataFrame:
    """A scope's sessions of the largest value, the sessions a postmortem names."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(value), "session_id"))
    return profiles.withColumn("place", place).where(F.col("place") <= n)


def capture_coverage(starts: DataFrame, captured: DataFrame, grace: Column) -> DataFrame:
    """For each origin, sessions that were seen to start before the grace time and those captured; null ratio where none started."""
    told = starts.where(F.col("at") < grace).select("origin", "session_id").distinct()
    held = told.join(captured.select("session_id").distinct().withColumn("_held", F.lit(True)), "session_id", "left")
    return held.groupBy("origin").agg(F.count("*").alias("expected"), F.count("_held").alias("captured"), F.round(F.count("_held") / F.count("*"), 6).alias("coverage"))


def topology_counts(edges: DataFrame) -> DataFrame:
    """Sessions, logical sessions (different roots), and those whose way up is missing or a cycle."""
    return graph.lineage_state(edges).agg(F.count("*").alias("sessions"), F.count_distinct(F.when(F.col("state") == "rooted", F.col("root"))).alias("logical_sessions"), F.count_if(F.col("state") == "missing_parent").alias("missing_parent"), F.count_if(F.col("state") == "cycle").alias("in_cycle"))


def rigor_audit(rows: DataFrame, kind: str, current: int) -> DataFrame:
    """For each kind of insight (confidence, version, fallback, evidence): confidence in thirds, stale versions, fallbacks, rows with evidence."""
    c = F.col("confidence")
    return rows.groupBy(kind).agg(
        F.count("*").alias("n"), F.count_if(c < 0.34).alias("low"), F.count_if((c >= 0.34) & (c < 0.67)).alias("mid"), F.count_if(c >= 0.67).alias("high"), F.count_if(c.isNull()).alias("unstated"),
        F.count_if(F.col("version") < current).alias("stale"), F.count_if(F.col("fallback")).alias("fallbacks"), F.count_if(F.coalesce(F.length("evidence"), F.lit(0)) > 0).alias("with_evidence"),
    )


def family_usage(calls: DataFrame, families: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """Calls, sessions and kinds of act for each tool family."""
    told = calls.select("session_id", content.tool_family(F.col("tool"), F.col("detail"), families).alias("family"), content.evidence_kind(F.col("tool"), F.col("detail")).alias("kind"))
    return told.groupBy("family").agg(F.count("*").alias("calls"), F.count_distinct("session_id").alias("sessions"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))


def timeline(events: DataFrame, phases: DataFrame) -> DataFrame:
    """A session's work events and phases as numbered rows, by start, phases before the events they hold; rows without a start last."""
    rows = events.select("session_id", F.lit("event").alias("row"), "label", "started", "ended").unionByName(phases.select("session_id", F.lit("phase").alias("row"), "label", "started", "ended"))
    order = Window.partitionBy("session_id").orderBy(F.col("started").asc_nulls_last(), F.desc("row"), "ended", "label")
    return rows.withColumn("place", F.row_number().over(order) - 1)


def git_links(sessions: DataFrame, commits: DataFrame, minutes: int) -> DataFrame:
    """Commits (repo, at, commit) of a session's repository from its start to so many minutes after its end; days are the join's bands."""
    day = lambda c: F.to_date(c)
    late = F.col("ended") + F.make_dt_interval(mins=F.lit(minutes))
    spread = sessions.withColumn("_day", F.explode(F.sequence(day(F.col("started")), day(late))))
    met = spread.join(commits.withColumn("_day", day(F.col("at"))), ["repo", "_day"])
    return met.where((F.col("at") >= F.col("started")) & (F.col("at") <= late)).select("session_id", "commit", F.when(F.col("at") <= F.col("ended"), "during").otherwise("after").alias("relation"))


def origin_tags(sessions: DataFrame) -> DataFrame:
    """A tag for each origin, with its sessions, as if it had been given to them."""
    return sessions.groupBy("origin").agg(F.count("*").alias("sessions")).select(F.concat(F.lit("origin:"), "origin").alias("tag"), "sessions", F.lit(0).alias("explicit"))


def delegation_edges(delegations: DataFrame) -> DataFrame:
    """Delegations (session_id, child_id, mapping_state, is_error) as edges of a work graph; unlinked ones end in a node of their own."""
    to = F.coalesce(F.concat(F.lit("session:"), F.col("child_id").cast("string")), F.concat(F.lit("dispatch:"), F.col("action_id").cast("string")))
    kind = F.when(F.col("is_error") == 1, "failed_delegation").when(F.col("mapping_state") == "resolved", "delegated_to").otherwise("delegation_unresolved")
    return delegations.select(F.concat(F.lit("session:"), F.col("session_id").cast("string")).alias("a"), to.alias("b"), kind.alias("kind"))


def attribution(touched: DataFrame) -> DataFrame:
    """A session's languages, repositories and number of paths from its touched files (session_id, path, remote); sets of a few names."""
    path = content.clean_path(F.col("path"))
    named = touched.select("session_id", F.when(content.path_like(path), path).alias("path"), content.repo_name(F.col("remote")).alias("repo"))
    told = named.withColumn("language", content.language_of(F.col("path")))
    return told.groupBy("session_id").agg(F.count_distinct("path").alias("paths"), F.array_sort(F.collect_set("language")).alias("languages"), F.array_sort(F.collect_set("repo")).alias("repos"))


def stuck(latency: DataFrame, limit: int, since=None) -> DataFrame:
    """Sessions with calls left open, most first, then the latest."""
    found = latency.where("stuck > 0")
    if since is not None:
        found = found.where(F.col("last_at") >= F.lit(since))
    return found.orderBy(F.desc("stuck"), F.desc("last_at"), "session_id").limit(limit)


def compactions(events: DataFrame) -> DataFrame:
    """For each session its compactions, the last one's time and the tokens before them in all."""
    return events.where("kind = 'compaction'").groupBy("session_id").agg(F.count("*").alias("compactions"), F.max("at").alias("last_at"), F.sum("value").alias("before"))


def by_id_prefix(sessions: DataFrame, prefix: str) -> DataFrame:
    """The session an id's beginning names: an exact id first, else the only one that begins so; none if several do."""
    found = sessions.where(F.col("session_id").cast("string").startswith(prefix)).select("session_id", (F.col("session_id").cast("string") == prefix).alias("exact")).limit(3)  # two others settle it
    told = found.agg(F.max(F.when(F.col("exact"), F.col("session_id"))).alias("exact"), F.min("session_id").alias("only"), F.count("*").alias("n"))
    exact = sessions.where(F.col("session_id").cast("string") == prefix).agg(F.max("session_id").alias("same"))
    return told.join(exact).select(F.coalesce("same", F.when(F.col("n") == 1, F.col("only"))).alias("session_id")).where("session_id is not null")


def attachment_hits(attachments: DataFrame, value: str, fields: list[str]) -> DataFrame:
    """Each session's best attachment with a field of exactly this value: earlier fields first, then the smaller id."""
    place = F.coalesce(*[F.when(F.col(f) == value, n) for n, f in enumerate(fields)])
    met = attachments.withColumn("field", place).where("field is not null")
    best = F.row_number().over(Window.partitionBy("session_id").orderBy("field", "attachment_id"))
    return met.withColumn("_r", best).where("_r = 1").select("session_id", "attachment_id", F.element_at(F.array(*map(F.lit, fields)), (F.col("field") + 1).cast("int")).alias("field"))


def slo(samples: DataFrame, key: str, target: float | None = None) -> DataFrame:
    """From samples (at_ms, value, label): level, percentiles, slope, time until a falling backlog is empty, and burn rate."""
    first, last = F.min_by("value", "at_ms"), F.max_by("value", "at_ms")
    per = samples.groupBy(key).agg(F.max_by("label", "at_ms").alias("label"), F.count("*").alias("samples"), last.alias("_last"), first.alias("_first"), ((F.max("at_ms") - F.min("at_ms")) / 1000).alias("_s"))
    per = with_ranks(per, linear_ranks(samples, key, "value", {"p50": 0.5, "p95": 0.95}), key).withColumns({c: F.round(c, 6) for c in ("p50", "p95")})
    slope = F.when((F.col("samples") > 1) & (F.col("_s") > 0), (F.col("_last") - F.col("_first")) / F.col("_s"))
    eta = F.when((F.col("label") == "backlog") & (slope < 0) & (F.col("_last") > 0), F.col("_last") / -slope)
    burn = F.round(F.col("_last") / target, 6) if target else F.lit(None).cast("double")
    return per.select(key, "label", "samples", F.round("_last", 6).alias("level"), "p50", "p95", F.round(slope, 6).alias("slope_per_s"), F.round(eta, 3).alias("eta_s"), burn.alias("burn_rate"), (F.col("samples") >= 2).alias("confident"))


def chronicle(messages: DataFrame, authored: Column, edge: int) -> DataFrame:
    """I64: a session's first and last authored messages with text, once each, and how many others there are."""
    w = Window.partitionBy("session_id")
    told = messages.withColumn("_all", F.count("*").over(w)).where(authored & F.rlike(F.coalesce("text", F.lit("")), F.lit(r"\S")))
    up, down = F.row_number().over(w.orderBy("position")), F.row_number().over(w.orderBy(F.desc("position")))
    ends = told.withColumn("_a", up).withColumn("_b", down).where((F.col("_a") <= edge) | (F.col("_b") <= edge))
    part = F.when(F.col("_a") <= edge, "first").otherwise("last")
    return ends.select("session_id", "position", "role", part.alias("part"), (F.col("_all") - F.count("*").over(w)).alias("omitted"))


def grouped_stats(sessions: DataFrame, facts: DataFrame, key: str, message: str) -> DataFrame:
    """For each group its sessions, facts and different messages; sessions without a fact are group 'none'; and a row for all that match."""
    groups = facts.groupBy(F.col(key).alias("group")).agg(F.count_distinct("session_id").alias("sessions"), F.count("*").alias("facts"), F.count_distinct(message).alias("messages"))
    zero = F.lit(0).cast("long")
    none = sessions.select("session_id").distinct().join(facts.select("session_id"), "session_id", "left_anti").agg(F.lit("none").alias("group"), F.count("*").alias("sessions"), zero.alias("facts"), zero.alias("messages"))
    whole = facts.agg(F.lit("MATCHED").alias("group"), F.count_distinct("session_id").alias("sessions"), F.count("*").alias("facts"), F.count_distinct(message).alias("messages"))
    return groups.unionByName(none.where("sessions > 0")).unionByName(whole)


def watched(before: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """V3/V5: a standing query's finding: how many members came and went since the baseline, and whether any did."""
    a, b = before.select(key).distinct().withColumn("_a", F.lit(True)), now.select(key).distinct().withColumn("_b", F.lit(True))
    counts = a.join(b, key, "full").agg(F.count("_a").alias("before"), F.count("_b").alias("now"), F.count_if(F.col("_a").isNull()).alias("added"), F.count_if(F.col("_b").isNull()).alias("removed"))
    return counts.withColumn("changed", (F.col("added") > 0) | (F.col("removed") > 0))
