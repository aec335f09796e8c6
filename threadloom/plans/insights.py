"""Queries of session insights: filters, profiles, streaks, outlooks, quality and comparison."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from threadloom.functions import scalars
from threadloom.operators import aggregates, filters, results, windows
from threadloom.plans.registry import query
from threadloom.tables import actions, messages, read, sessions

ORDER = ["ts", "event_id"]


@query("""SELECT o_orderkey AS session_id, o_orderpriority AS origin, o_orderdate AS sort_key FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AND o_orderpriority <> '3-MEDIUM'
AND o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-12-31' AND starts_with(CAST(o_orderkey AS VARCHAR), '1') AND o_totalprice >= 1000""")
def session_filters(spark, d):
    wanted = filters.session_filter(origins=["1-URGENT", "2-HIGH", "3-MEDIUM"], exclude_origins=["3-MEDIUM"], since=dt.datetime(1996, 1, 1), until=dt.datetime(1999, 12, 31), id_prefix="1", at_least={"cost": 1000})
    return sessions(spark, d).where(wanted).select("session_id", "origin", "sort_key")


@query("SELECT o_orderkey AS session_id, o_orderdate AS sort_key FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC LIMIT 20 OFFSET 40")
def session_page(spark, d):
    return filters.page(sessions(spark, d), 40, 20).select("session_id", "sort_key")


@query("SELECT o_orderkey AS session_id FROM orders ORDER BY sha256('s1|' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 25")
def session_sample(spark, d):
    return filters.sample(sessions(spark, d).select("session_id"), "session_id", 25, "s1")


@query("SELECT o.o_orderkey AS session_id FROM orders o JOIN orders r ON r.o_orderkey = (SELECT min(o_orderkey) FROM orders) AND o.o_orderpriority = r.o_orderpriority AND o.o_orderdate > r.o_orderdate")
def since_session(spark, d):
    s = sessions(spark, d)
    return filters.since_session(s, s.agg(F.min("session_id")).first()[0], "origin").select("session_id")


@query("SELECT event_id FROM (SELECT event_id, CASE WHEN value > 90 THEN NULL ELSE ts END t FROM events) WHERE t IS NULL OR t >= TIMESTAMP '2024-01-20'")
def time_null_included(spark, d):
    timed = actions(spark, d).withColumn("t", F.when(F.col("value") > 90, None).otherwise(F.col("ts")))
    return timed.where(filters.time_or_unknown(F.col("t"), F.col("t") >= F.lit(dt.datetime(2024, 1, 20)))).select("event_id")


@query("SELECT user_id AS session_id FROM events GROUP BY 1 HAVING bool_or(contains(lower(props), '\"k\": 1')) AND bool_or(contains(lower(props), '\"k\": 2'))")
def referenced_terms(spark, d):
    low = F.lower("tool_id")
    return filters.having_all(actions(spark, d), "session_id", [F.contains(low, F.lit('"k": 1')), F.contains(low, F.lit('"k": 2'))])


@query("SELECT page_id FROM (SELECT page_id, regexp_replace(url, '^https?://[^/]+', '') p FROM pages) WHERE p = '/en' OR starts_with(p, '/en/')")
def path_prefix(spark, d):
    return read(spark, d, "pages").where(scalars.under_path(F.regexp_replace("url", "^https?://[^/]+", ""), "/en")).select("page_id")


@query("SELECT a.user_id AS session_id, a.event_id, b.event_id AS other_event_id FROM events a JOIN events b ON a.user_id=b.user_id AND abs(epoch_us(a.ts)-epoch_us(b.ts)) <= 3600000000 WHERE a.event_type='error' AND b.event_type='purchase'")
def time_band_join(spark, d):
    a = actions(spark, d).select("session_id", "ts", "event_id", "kind")
    return filters.within_band(a.where("kind = 'error'").drop("kind"), a.where("kind = 'purchase'").drop("kind"), "session_id", "ts", 3600).select("session_id", "event_id", "other_event_id")


@query("SELECT count(*) AS messages, count(DISTINCT conv_id) AS sessions, count(*) FILTER (role IN ('user','assistant')) AS dialogue, count(*) FILTER (role NOT IN ('user','assistant')) AS tool, min(turn) AS least_position, max(turn) AS largest_position FROM conversations")
def archive_stats(spark, d):
    talk = F.col("role").isin("user", "assistant")
    return messages(spark, d).agg(F.count("*").alias("messages"), F.count_distinct("session_id").alias("sessions"), F.count_if(talk).alias("dialogue"), F.count_if(~talk).alias("tool"), F.min("position").alias("least_position"), F.max("position").alias("largest_position"))


@query("SELECT source AS origin, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, round(avg(n_chars), 6) AS mean_chars, count(DISTINCT lang) AS langs, count(*) FILTER (n_chars > 2000) AS long FROM documents GROUP BY 1")
def origin_metrics(spark, d):
    return read(spark, d, "documents").groupBy(F.col("source").alias("origin")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.round(F.avg("n_chars"), 6).alias("mean_chars"), F.count_distinct("lang").alias("langs"), F.count_if(F.col("n_chars") > 2000).alias("long"))


@query("SELECT event_type AS kind, props AS tool_id, count(*) AS calls, count(DISTINCT user_id) AS sessions, count(DISTINCT CAST(ts AS DATE)) AS days, count(*) FILTER (event_type='error') AS errors FROM events GROUP BY 1, 2")
def tool_usage(spark, d):
    return actions(spark, d).groupBy("kind", "tool_id").agg(F.count("*").alias("calls"), F.count_distinct("session_id").alias("sessions"), F.count_distinct(F.to_date("ts")).alias("days"), F.count_if(F.col("is_error") == 1).alias("errors"))


@query("SELECT source AS origin, count(*) AS documents, count(quality) AS labelled, round(count(quality)/count(*), 6) AS coverage FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def tool_coverage(spark, d):
    both = read(spark, d, "documents").select("doc_id", F.col("source").alias("origin")).join(read(spark, d, "labels"), "doc_id", "left")
    return both.groupBy("origin").agg(F.count("*").alias("documents"), F.count("quality").alias("labelled"), F.round(F.count("quality") / F.count("*"), 6).alias("coverage"))


@query("""SELECT event_type AS kind, count(value) AS n, round(sum(value), 6) AS total, min(value) AS least, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, max(value) AS largest, round(avg(value), 6) AS mean FROM events GROUP BY 1""")
def distributions(spark, d):
    return aggregates.distribution(actions(spark, d), "kind", "value")


@query("SELECT source, CAST(floor((quantile_disc(n_chars, 0.5) + (SELECT -1 * quantile_disc(-x.n_chars, 0.5) FROM documents x WHERE x.source = d.source)) / 2) AS BIGINT) AS median FROM documents d GROUP BY source")
def median_floor(spark, d):
    return aggregates.median_floor(read(spark, d, "documents"), "source", "n_chars")


@query("SELECT user_id AS session_id, event_type AS kind, n FROM (SELECT user_id, event_type, count(*) n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) r FROM events GROUP BY 1, 2) WHERE r=1")
def most_common_kind(spark, d):
    return aggregates.most_common(actions(spark, d), "session_id", "kind")


_PART = "CAST(sum(CAST(('0x' || substr(sha256(CAST(doc_id AS VARCHAR) || '|' || text), {}, 12)) AS BIGINT)) AS VARCHAR) AS {}"


@query(f"SELECT source, count(*) AS n, {_PART.format(1, 'sum_a')}, {_PART.format(13, 'sum_b')} FROM documents WHERE text IS NOT NULL GROUP BY 1")
def result_set_digest(spark, d):
    return aggregates.multiset_digest(read(spark, d, "documents"), "source", F.col("doc_id").cast("string"), F.col("text"))


@query("""SELECT CASE grouping(month, origin) WHEN 0 THEN 'month-origin' ELSE 'month' END AS grouping, month, origin, count(*) AS n, round(sum(o_totalprice), 2) AS cost
FROM (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority AS origin, o_totalprice FROM orders) GROUP BY GROUPING SETS ((month), (month, origin))""")
def usage_timeline(spark, d):
    s = sessions(spark, d).withColumn("month", F.date_format("sort_key", "yyyy-MM"))
    return aggregates.rollup_sets(s, ["month", "origin"], [["month"], ["month", "origin"]], n=F.count("*"), cost=F.round(F.sum("cost"), 2))


@query("""SELECT tag, source AS origin, count(*) AS sessions FROM (SELECT DISTINCT doc_id, source, unnest(CASE WHEN n_chars > 1000 THEN [lang, 'long'] ELSE [lang, 'short'] END) AS tag FROM documents) GROUP BY 1, 2""")
def tag_rollups(spark, d):
    tags = F.array("lang", F.when(F.col("n_chars") > 1000, "long").otherwise("short"))
    return read(spark, d, "documents").select("doc_id", F.col("source").alias("origin"), F.explode(F.array_distinct(tags)).alias("tag")).groupBy("tag", "origin").agg(F.count("*").alias("sessions"))


@query("""WITH g AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 1 ELSE 0 END c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, CAST(sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) run FROM g) SELECT user_id AS session_id, run, event_type AS kind, count(*) AS n, min(ts) AS started, max(ts) AS ended FROM r GROUP BY 1, 2, 3""")
def merged_runs(spark, d):
    return windows.islands(actions(spark, d), "session_id", ORDER, "kind")


@query("""WITH t AS (SELECT user_id, ts, event_id, CASE WHEN event_type='error' THEN CAST(value > 50 AS VARCHAR) END s FROM events WHERE event_type IN ('error', 'purchase')),
c AS (SELECT *, CASE WHEN s IS DISTINCT FROM lag(s) OVER w THEN 1 ELSE 0 END n FROM t WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) run FROM c)
SELECT session_id, longest, CASE WHEN longest >= 7 THEN 'high' WHEN longest >= 4 THEN 'medium' WHEN longest >= 2 THEN 'low' END AS severity FROM (SELECT user_id AS session_id, max(k) AS longest FROM (SELECT user_id, run, count(*) k FROM r WHERE s IS NOT NULL GROUP BY 1, 2) GROUP BY 1)""")
def wasted_loops(spark, d):
    a = actions(spark, d).withColumn("signature", (F.col("value") > 50).cast("string"))
    return windows.signature_streaks(a, "session_id", ORDER, F.col("kind") == "error", F.col("kind") == "purchase", "signature").withColumn("severity", scalars.streak_severity(F.col("longest")))


@query("SELECT source, target, count(*) AS n FROM (SELECT event_type AS source, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target FROM events) WHERE target IS NOT NULL GROUP BY 1, 2")
def kind_transitions(spark, d):
    return windows.transitions(actions(spark, d), "session_id", ORDER, "kind")


@query("""WITH n AS (SELECT c.conv_id, c.turn, (SELECT arg_min(x.text, x.turn) FROM conversations x WHERE x.conv_id=c.conv_id AND x.turn>c.turn AND x.role='assistant') AS t FROM conversations c WHERE c.role='user')
SELECT conv_id AS session_id, turn AS position, CASE WHEN t IS NULL OR length(trim(t)) < 20 THEN 'ambiguous' WHEN regexp_matches(lower(t), 'error|fail|that') THEN 'acknowledged' ELSE 'silent_proceed' END AS followup FROM n""")
def followup_classes(spark, d):
    after = windows.next_where(messages(spark, d), "session_id", ["position"], F.col("role") == "assistant", "text", "next_text")
    return after.where("role = 'user'").select("session_id", "position", scalars.followup_class(F.col("next_text"), ["error", "fail", "that"]).alias("followup"))


@query("SELECT conv_id AS session_id, turn AS position, CAST(used AS BIGINT) AS used, CASE WHEN used <= 800 THEN 'included' ELSE 'over_budget' END AS decision FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) used FROM conversations)")
def context_budget(spark, d):
    sized = messages(spark, d).withColumn("size", F.length("text"))
    return windows.within_budget(sized, "session_id", ["position"], "size", 800).select("session_id", "position", "used", "decision")


@query("""SELECT event_id, day, CASE WHEN value < 50 THEN 'below_floor' WHEN r <= 3 THEN 'fired' ELSE 'over_budget' END AS decision FROM
(SELECT event_id, CAST(ts AS DATE) AS day, value, row_number() OVER (PARTITION BY CAST(ts AS DATE), value >= 50 ORDER BY value DESC, event_id) r FROM events WHERE event_type='error')""")
def alert_budget(spark, d):
    errors = actions(spark, d).where("kind = 'error'").withColumn("day", F.to_date("ts"))
    return windows.fire_within_budget(errors, "day", "value", "event_id", 50, 3).select("event_id", "day", "decision")


@query("""WITH t AS (SELECT event_type kind, CAST(ts AS DATE) AS day, sum(value) v FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY day DESC) k FROM t)
SELECT kind, count(*) AS days, round(sum(v), 3) AS spent, round(sum(v)/count(*)*45, 3) AS linear, round(sum(v) + avg(v) FILTER (k <= 7) * greatest(45-count(*), 0), 3) AS trailing FROM r GROUP BY 1""")
def cycle_outlook(spark, d):
    daily = actions(spark, d).groupBy("kind", F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"))
    return windows.outlook(daily, "kind", "day", "v", 45)


_U = "(SELECT *, row_number() OVER (PARTITION BY user_id, props ORDER BY ts, event_id) r FROM events WHERE event_type='{}')"


@query(f"""SELECT user_id AS session_id, count(*) AS paired, round(quantile_disc(s, 0.5), 3) AS p50_s, round(quantile_disc(s, 0.9), 3) AS p90_s, round(max(s), 3) AS max_s FROM
(SELECT u.user_id, (epoch_us(e.ts)-epoch_us(u.ts))/1000000 AS s FROM {_U.format('click')} u JOIN {_U.format('error')} e ON u.user_id=e.user_id AND u.props=e.props AND u.r=e.r) WHERE s >= 0 GROUP BY 1""")
def tool_latency(spark, d):
    a = actions(spark, d).select("session_id", "tool_id", "ts", "event_id", "kind")
    pairs = windows.pair_by_rank(a.where("kind = 'click'"), a.where("kind = 'error'"), ["session_id", "tool_id"], ORDER).where("found")
    took = pairs.withColumn("s", (F.unix_micros(F.col("result_ts").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1_000_000).where("s >= 0")
    at = lambda p: F.expr(f"round(percentile_disc({p}) within group (order by s), 3)")
    return took.groupBy("session_id").agg(F.count("*").alias("paired"), at(0.5).alias("p50_s"), at(0.9).alias("p90_s"), F.round(F.max("s"), 3).alias("max_s"))


_C = "count(*) FILTER (event_type='{}')"


@query(f"""SELECT session_id, CASE WHEN round(calls/greatest(n,1),4) < 0.1 THEN 'chat' WHEN reads >= 3 AND edits=0 AND users <= 2 THEN 'batch_review' WHEN (edits > 0 OR runs >= 3) AND round(calls/greatest(n,1),4) >= 0.2 AND n >= 10 THEN 'agentic_loop'
WHEN reads > 0 OR round(calls/greatest(n,1),4) >= 0.1 THEN 'exploratory' ELSE 'unknown' END AS shape,
CASE WHEN edits >= 2 THEN 'implementation' WHEN reads >= 3 AND edits=0 THEN 'research' WHEN runs >= 2 THEN 'implementation' WHEN calls=0 THEN 'session' ELSE 'implementation' END AS work
FROM (SELECT user_id AS session_id, count(*) n, {_C.format('view')} reads, {_C.format('purchase')} edits, {_C.format('click')} runs, {_C.format('signup')} users, count(*) FILTER (event_type IN ('view','purchase','click')) calls FROM events GROUP BY 1)""")
def session_profiles(spark, d):
    n = lambda k: F.count_if(F.col("kind") == k)
    per = actions(spark, d).groupBy("session_id").agg(F.count("*").alias("messages"), n("view").alias("reads"), n("purchase").alias("edits"), n("click").alias("runs"), n("signup").alias("user_messages"), F.count_if(F.col("kind").isin("view", "purchase", "click")).alias("calls"))
    c = {k: F.col(k) for k in ("calls", "messages", "user_messages", "reads", "edits", "runs")} | {"dispatches": F.lit(0), "has_text": F.lit(True)}
    none = F.lit(0)
    return per.select("session_id", scalars.workflow_shape(c).alias("shape"), scalars.work_label(c["edits"], none, none, c["reads"], none, c["runs"], c["calls"]).alias("work"))


@query("SELECT coalesce(a.user_id, b.user_id) AS session_id, CASE WHEN a.user_id IS NULL THEN 'added' ELSE 'removed' END AS change FROM (SELECT DISTINCT user_id FROM events WHERE event_type='purchase' AND ts < TIMESTAMP '2024-01-10') a FULL JOIN (SELECT DISTINCT user_id FROM events WHERE event_type='purchase' AND ts >= TIMESTAMP '2024-01-20') b ON a.user_id=b.user_id WHERE a.user_id IS NULL OR b.user_id IS NULL")
def cohort_drift(spark, d):
    p = actions(spark, d).where("kind = 'purchase'")
    return results.changes(p.where("ts < timestamp_ntz'2024-01-10'"), p.where("ts >= timestamp_ntz'2024-01-20'"), "session_id")


@query("SELECT coalesce(a.turn, b.turn) AS position, CASE WHEN a.turn IS NULL THEN 'right_only' WHEN b.turn IS NULL THEN 'left_only' WHEN a.role=b.role THEN 'equal' ELSE 'changed' END AS state FROM (SELECT * FROM conversations WHERE conv_id=1) a FULL JOIN (SELECT * FROM conversations WHERE conv_id=2) b ON a.turn=b.turn")
def session_compare(spark, d):
    m = messages(spark, d)
    return results.aligned(m.where("session_id = 1"), m.where("session_id = 2"), "position", ["role"])


@query("SELECT source, 'lang' AS field, count(DISTINCT lang) + max(CAST(lang IS NULL AS INT)) AS distinct_values FROM documents GROUP BY 1 UNION ALL SELECT source, 'n_chars', count(DISTINCT n_chars) + max(CAST(n_chars IS NULL AS INT)) FROM documents GROUP BY 1")
def differing_fields(spark, d):
    return aggregates.differing(read(spark, d, "documents"), "source", ["lang", "n_chars"])


@query("""SELECT source, count(*) AS n, count(*) FILTER (v IS NOT NULL AND g IS NOT NULL) AS overlap, round(count(*) FILTER (v=g) / nullif(count(*) FILTER (v IS NOT NULL AND g IS NOT NULL), 0), 6) AS agreement, round(avg(CAST(v='tie' AS INT)), 6) AS tie_rate, round(avg(CAST(v='abstain' AS INT)), 6) AS abstain_rate
FROM (SELECT source, CASE WHEN n_chars % 7 = 0 THEN 'tie' WHEN n_chars % 5 = 0 THEN 'abstain' WHEN n_chars > 600 THEN '1' ELSE '0' END v, CAST(quality AS VARCHAR) g FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY 1""")
def judge_calibration(spark, d):
    n = F.col("n_chars")
    verdict = F.when(n % 7 == 0, "tie").when(n % 5 == 0, "abstain").when(n > 600, "1").otherwise("0")
    judged = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left").select("doc_id", "source", verdict.alias("verdict"), F.col("quality").cast("string").alias("gold"))
    return aggregates.calibration(judged, ["source"], "verdict", "gold", "doc_id")


@query("""WITH p AS (SELECT lang='fr' a, n_chars > 1000 b, source='src1' c FROM documents) SELECT 'none' AS dropped, count(*) FILTER (a AND b AND c) AS matches FROM p
UNION ALL SELECT 'lang', count(*) FILTER (b AND c) FROM p UNION ALL SELECT 'length', count(*) FILTER (a AND c) FROM p UNION ALL SELECT 'source', count(*) FILTER (a AND b) FROM p""")
def miss_diagnosis(spark, d):
    return aggregates.miss_diagnosis(read(spark, d, "documents"), {"lang": F.col("lang") == "fr", "length": F.col("n_chars") > 1000, "source": F.col("source") == "src1"})
