"""How sessions end, how long their calls take, and what they cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def terminal_state(pending: Column, last_role: Column, error_at_end: Column, any_error: Column, stop_reason: Column) -> Column:
    """I3, from structure alone: open calls, then the last message's author, then errors and the stop reason; else unknown."""
    return (
        F.when(pending > 0, "tool_left")
        .when(last_role.isNull(), F.when(any_error, "error_left").otherwise("unknown"))
        .when(last_role == "user", "question_left")
        .when((last_role == "assistant") & error_at_end, "error_left")
        .when((last_role == "assistant") & (stop_reason == "refusal"), "refused")
        .when((last_role == "assistant") & (stop_reason == "max_tokens"), "truncated")
        .otherwise("unknown")
    )


def floor_median(value: str) -> Column:
    """The median, or the whole part of the two middle values' mean; 0 where there is none."""
    middle = F.expr(f"floor(percentile({value}, 0.5))")
    return F.coalesce(middle, F.lit(0)).cast("long")


def _millis(micros: Column) -> Column:
    return F.floor(micros / 1000)


def call_times(events: DataFrame, key: str, call: str, order: list[str], ts: str, starts: Column, outputs: Column) -> DataFrame:
    """Each call's start or output with ``ms`` (of an output that follows its start) and ``left_open`` (a start whose output never came).

    Of several starts with one id the last counts. Events without an id pair first in, first out; an
    output that finds none open is ignored. Events without a time take no part.
    """
    kind = F.when(starts, "start").when(outputs, "output")
    named = F.when(F.trim(F.col(call).cast("string")) != "", F.col(call).cast("string"))
    told = events.where(F.col(ts).isNotNull()).withColumn("_kind", kind).where("_kind is not null").withColumn("_call", named)
    each = Window.partitionBy(key, "_call").orderBy(*order)
    # Open calls without an id: a sum of ones and minus ones that is held at 0 from below; an output at a new least finds none.
    balance = told.withColumn("_sum", F.sum(F.when(F.col("_kind") == "start", 1).otherwise(-1)).over(each))
    least = F.min(F.least("_sum", F.lit(0))).over(each.rowsBetween(Window.unboundedPreceding, -1))
    queued = balance.withColumn("_idle", F.col("_call").isNull() & (F.col("_kind") == "output") & (F.col("_sum") < F.coalesce(least, F.lit(0))))
    turn = F.sum(F.when(~F.col("_idle"), 1).otherwise(0)).over(Window.partitionBy(key, "_call", "_kind").orderBy(*order))
    dealt = queued.withColumn("_turn", F.when(F.col("_call").isNull() & ~F.col("_idle"), turn).when(F.col("_idle"), -1))
    w = Window.partitionBy(key, "_call", "_turn").orderBy(*order)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    before, after = F.lag("_kind").over(w), F.lead("_kind").over(w)
    ms = F.when((F.col("_kind") == "output") & (before == "start"), F.greatest(_millis(at - F.lag(at).over(w)), F.lit(0)))
    return dealt.select("*", ms.alias("ms"), ((F.col("_kind") == "start") & after.isNull()).alias("left_open"), at.alias("at_us")).drop("_kind", "_call", "_sum", "_idle", "_turn")


def latency_profile(calls: DataFrame, ends: DataFrame, key: str, stuck_ms: int = 300_000) -> DataFrame:
    """I8: median, nearest-rank p90 and maximum of a session's calls, and those still open ``stuck_ms`` before its end (key, end_us)."""
    stuck = F.count_if(F.col("left_open") & (_millis(F.col("end_us") - F.col("at_us")) > stuck_ms))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return calls.join(ends, key).groupBy(key).agg(floor_median("ms").alias("median_ms"), zero(F.expr("percentile_disc(0.9) within group (order by ms)")).alias("p90_ms"), zero(F.max("ms")).alias("max_ms"), stuck.alias("stuck"))


def session_costs(usage: DataFrame, prices: DataFrame, reported: DataFrame) -> DataFrame:
    """Usage (session_id, model, tokens) at prices (model, price), unless the provider reported a cost (session_id, reported).

    ``basis`` says how: reported, priced, partial (some model has no price; the rest counts), or unpriced (null cost).
    """
    per = usage.join(prices, "model", "left").groupBy("session_id").agg(F.sum(F.col("tokens") * F.col("price")).alias("computed"), F.count_if(F.col("price").isNull()).alias("_open"))
    basis = F.when(F.col("reported").isNotNull(), "reported").when(F.col("computed").isNull(), "unpriced").when(F.col("_open") > 0, "partial").otherwise("priced")
    return per.join(reported, "session_id", "left").select("session_id", F.round(F.coalesce("reported", "computed"), 4).alias("cost"), basis.alias("basis"))


def subscription_credits(usage: DataFrame, rates: DataFrame, fee: float, pool: int) -> DataFrame:
    """Credits of each session and their share of a plan's monthly fee.

    usage: (session_id, model, input, output, cache_read, cache_write) tokens; rates: (model, those four
    rates, divisor), credits being tokens * rate / divisor, rounded up. A model without a rate costs none.
    """
    kinds = ("input", "output", "cache_read", "cache_write")
    priced = usage.join(rates.select("model", "divisor", *[F.col(k).alias(f"_{k}") for k in kinds]), "model", "left")
    each = sum(F.when(F.col(k) > 0, F.ceil(F.col(k) * F.col(f"_{k}") / F.col("divisor"))).otherwise(0) for k in kinds)
    per = priced.groupBy("session_id").agg(F.sum(F.coalesce(each, F.lit(0))).cast("long").alias("credits"))
    return per.select("session_id", "credits", F.round(F.greatest("credits", F.lit(0)) / pool * fee, 6).alias("usd"))


# What an end says of a session's objective, and assertions that outrank it, the strongest first.
POSTURES = {"tool_left": "awaiting_effect", "error_left": "blocked", "question_left": "ambiguous", "unknown": "ambiguous"}
ASSERTED = [("blocker", "blocked"), ("decision", "awaiting_operator"), ("handoff", "awaiting_operator")]


def objective_posture(profiles: DataFrame, assertions: DataFrame) -> DataFrame:
    """I32: each session's posture, its authority and confidence, and how many weaker statements it contradicts.

    profiles: (session_id, terminal_state, confidence), of which 0.8 at most is taken; assertions:
    (session_id, kind, confidence), 0.85 where none of the winning kind has one.
    """
    known = F.create_map(*[F.lit(x) for p in POSTURES.items() for x in p])
    own = F.try_element_at(known, F.col("terminal_state"))
    rank = F.coalesce(*[F.when(F.col("kind") == k, n) for n, (k, _) in enumerate(ASSERTED)])
    told = assertions.withColumn("_rank", rank).where("_rank is not null")
    best = told.groupBy("session_id", "_rank").agg(F.max("confidence").alias("_c"), F.count("*").alias("_n"))
    won = best.groupBy("session_id").agg(F.min("_rank").alias("_rank"), F.min_by("_c", "_rank").alias("_c"), (F.sum("_n") - F.min_by("_n", "_rank")).alias("_others"))
    both = profiles.join(won, "session_id", "left").withColumn("_own", own)
    by = F.col("_rank").isNotNull()
    posture = F.when(by, F.element_at(F.array(*[F.lit(p) for _, p in ASSERTED]), F.col("_rank") + 1)).otherwise(F.coalesce("_own", F.lit("unknown")))
    confidence = F.when(by, F.round(F.greatest(F.least(F.coalesce("_c", F.lit(0.85)), F.lit(1.0)), F.lit(0.0)), 4)).when(F.col("_own").isNotNull(), F.round(F.greatest(F.least("confidence", F.lit(0.8)), F.lit(0.0)), 4))
    authority = F.when(by, "assertion").when(F.col("_own").isNotNull(), "structural_inference").otherwise("none")
    against = F.when(by, F.col("_others") + F.col("_own").isNotNull().cast("int")).otherwise(0)
    return both.select("session_id", posture.alias("posture"), authority.alias("authority"), confidence.alias("confidence"), against.cast("long").alias("contradictions"))


# What a judgement makes of a claim's link to an effect.
ASSOCIATIONS = {"supported": "resolved", "partial": "ambiguous", "contradicted": "contradicted", "unresolved": "unresolved", "superseded": "superseded"}


def reconciled(claims: DataFrame, effects: DataFrame, judgements: DataFrame) -> DataFrame:
    """Judgements (claim, effect, evaluation) as links with a state; 'rejected' where the claim or the effect is not known. Only judgements link."""
    known = judgements.join(claims.select("claim").distinct().withColumn("_c", F.lit(True)), "claim", "left").join(effects.select("effect").distinct().withColumn("_e", F.lit(True)), "effect", "left")
    state = F.try_element_at(F.create_map(*[F.lit(x) for p in ASSOCIATIONS.items() for x in p]), F.col("evaluation"))
    return known.select("claim", "effect", F.when(F.col("_c") & F.col("_e"), F.coalesce(state, F.lit("rejected"))).otherwise("rejected").alias("state"))


def coverage(items: DataFrame, vectors: DataFrame, key: str, group: str, vector: str) -> DataFrame:
    """For each group, its items, those without a vector, and the number of different dimensions."""
    found = items.join(vectors.select(key, F.size(vector).alias("_dim")), key, "left")
    return found.groupBy(group).agg(F.count("*").alias("items"), F.count_if(F.col("_dim").isNull()).alias("pending"), F.count_distinct("_dim").alias("dimensions"))


def scoped_facets(df: DataFrame, fields: list[str], scope: Column) -> DataFrame:
    """Each field's values with their count in the scope and in all, in one pass."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    return df.select(scope.alias("_in"), F.explode(pairs).alias("p")).groupBy("p.field", "p.value").agg(F.count_if("_in").alias("scoped"), F.count("*").alias("overall"))


def _gaps(messages: DataFrame) -> DataFrame:
    """Messages (session_id, position, at, role, kind) with the role before and the whole milliseconds since, 0 where a time is missing or earlier."""
    w = Window.partitionBy("session_id").orderBy("position")
    us = F.unix_micros(F.col("at").cast("timestamp"))
    gap = F.greatest(F.coalesce(_millis(us - F.lag(us).over(w)), F.lit(0)), F.lit(0))
    return messages.select("*", F.lag("role").over(w).alias("_before"), gap.alias("_gap"), us.alias("_us"))


def session_timing(messages: DataFrame) -> DataFrame:
    """What a session's time went to: a gap belongs to the message it ends with, as a tool's after an assistant's message, thinking, or output; and tool calls a minute."""
    tool = F.col("kind").isin("tool_use", "tool_result") & (F.col("_before") == "assistant")
    thinking = F.col("kind") == "thinking"
    output = (F.col("role") == "assistant") & (F.col("kind") == "message")
    label = F.when(F.col("_before").isNull(), None).when(tool, "tool").when(thinking, "thinking").when(output, "output")
    told = _gaps(messages).withColumn("_label", label)
    spent = lambda name: F.coalesce(F.sum(F.when(F.col("_label") == name, F.col("_gap"))), F.lit(0)).cast("long").alias(f"{name}_ms")
    per = told.groupBy("session_id").agg(spent("thinking"), spent("output"), spent("tool"), F.count_if(F.col("kind") == "tool_use").alias("_calls"), _millis(F.max("_us") - F.min("_us")).alias("_wall"))
    rate = F.when((F.col("_calls") > 0) & (F.col("_wall") > 0), F.round(F.col("_calls") / (F.col("_wall") / 60_000), 2)).otherwise(0.0)
    return per.select("session_id", "thinking_ms", "output_ms", "tool_ms", rate.alias("calls_per_minute"))


#: A user who comes back later than this was away and did not answer.
AWAY_MS = 1_800_000


def response_times(messages: DataFrame) -> DataFrame:
    """I8: medians of the time an agent takes to answer a user, and a user an agent; 0 where there is none.

    A message is answered by the next one of a user or an assistant; rows of others between them, and rows without a
    time, are looked through. Answers of users after ``AWAY_MS`` are none.
    """
    us = F.unix_micros(F.col("at").cast("timestamp"))
    turn = F.when(F.col("role").isin("user", "assistant") & F.col("at").isNotNull(), F.struct("role", us.alias("us")))
    before = F.last(turn, ignorenulls=True).over(Window.partitionBy("session_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1))
    told = messages.withColumn("_now", turn).withColumn("_before", before)
    gap = F.greatest(_millis(F.col("_now.us") - F.col("_before.us")), F.lit(0))
    agent = F.when((F.col("_now.role") == "assistant") & (F.col("_before.role") == "user"), gap)
    user = F.when((F.col("_now.role") == "user") & (F.col("_before.role") == "assistant") & (gap <= AWAY_MS), gap)
    return told.select("session_id", agent.alias("agent"), user.alias("user")).groupBy("session_id").agg(floor_median("agent").alias("agent_response_ms"), floor_median("user").alias("user_response_ms"))


def pairing_totals(blocks: DataFrame) -> DataFrame:
    """Over all sessions how many calls and results pair by (session_id, tool_id), miss their other side, repeat an identity or have none.

    blocks: (session_id, tool_id, kind), kind 'tool_use' or 'tool_result'.
    """
    use, result = F.count_if(F.col("kind") == "tool_use"), F.count_if(F.col("kind") == "tool_result")
    each = blocks.withColumn("tool_id", F.nullif("tool_id", F.lit(""))).groupBy("session_id", "tool_id").agg(use.alias("u"), result.alias("r"))
    known, u, r = F.col("tool_id").isNotNull(), F.col("u"), F.col("r")
    total = lambda v, of: F.coalesce(F.sum(F.when(of, v)), F.lit(0)).cast("long")
    above = lambda v: F.greatest(v, F.lit(0))
    return each.agg(
        total(F.least(u, r), known).alias("paired"), total(above(u - r), known).alias("missing_results"), total(above(r - u), known).alias("orphan_results"), total(above(u - 1), known).alias("duplicate_calls"),
        total(above(r - 1), known).alias("duplicate_results"), total(u, ~known).alias("unknown_uses"), total(r, ~known).alias("unknown_results"),
    )


def tool_distributions(blocks: DataFrame, sessions: DataFrame) -> DataFrame:
    """(measure, value, n): how many sessions have so many calls and results, those without any included, and how many identities so many records."""
    kind = F.col("kind")
    per = sessions.select("session_id").distinct().join(blocks.groupBy("session_id").agg(F.count_if(kind == "tool_use").alias("u"), F.count_if(kind == "tool_result").alias("r")), "session_id", "left")
    of_session = per.select(F.explode(F.array(*[F.struct(F.lit(name).alias("measure"), F.coalesce(c, F.lit(0)).alias("value")) for name, c in (("uses", "u"), ("results", "r"))])).alias("m")).select("m.*")
    records = blocks.where(F.coalesce(F.col("tool_id"), F.lit("")) != "").groupBy("session_id", "tool_id").agg(F.count("*").alias("value")).select(F.lit("records_per_identity").alias("measure"), "value")
    return of_session.union(records).groupBy("measure", "value").agg(F.count("*").alias("n"))


def archive_coverage(sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of sessions (origin, at, messages) per origin sessions, first and last date, truncated (at most two messages) and messages; and the gaps of more than a day between dates of any."""
    day = F.to_date("at")
    per = sessions.groupBy("origin").agg(F.count("*").alias("sessions"), F.count(day).alias("dated"), F.min(day).alias("first_date"), F.max(day).alias("last_date"), F.count_if(F.coalesce("messages", F.lit(0)) <= 2).alias("truncated"), F.coalesce(F.sum("messages"), F.lit(0)).alias("messages"))
    days = sessions.select(day.alias("day")).where("day is not null").distinct()  # a row for each date there is
    after = days.withColumn("_next", F.lead("day").over(Window.orderBy("day")))
    gaps = after.where(F.date_diff("_next", "day") > 1).select(F.date_add("day", 1).alias("start_date"), F.date_sub("_next", 1).alias("end_date"), (F.date_diff("_next", "day") - 1).alias("days"))
    return per, gaps
