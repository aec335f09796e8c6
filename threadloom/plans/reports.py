"""Queries of reports, judgements, content functions and lineage states."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions import content, scalars
from threadloom.operators import filters, graph, judgement, members, outcomes, reports, results, search, structure, units, windows
from threadloom.plans.queries import TERMS
from threadloom.plans.registry import query
from threadloom.scratch import folder
from threadloom.tables import actions, messages, read, sessions

#: Orders as session profiles: an end, a shape, paths and times derived from an order's columns.
_PROFILES = """p AS (SELECT o_orderkey AS session_id, o_orderpriority AS origin, o_totalprice AS cost, o_orderdate AS started, CAST(o_orderdate AS DATE) AS date,
[NULL, 'question_left', 'error_left', 'tool_left', 'agent_hanging', 'unknown'][o_orderkey % 6 + 1] AS terminal_state, CASE o_orderstatus WHEN 'F' THEN 'chat' WHEN 'O' THEN 'agentic_loop' END AS shape,
(o_orderkey % 5) * 60000 - 60000 AS wall_ms FROM orders)"""


def profiles(spark, d):
    s = sessions(spark, d)
    n = F.col("session_id")
    ends = F.array(F.lit(None).cast("string"), *map(F.lit, ["question_left", "error_left", "tool_left", "agent_hanging", "unknown"]))
    return s.select(
        "session_id", "origin", "cost", F.col("sort_key").alias("started"), F.to_date("sort_key").alias("date"), ends[(n % 6).cast("int")].alias("terminal_state"),
        F.when(F.col("state") == "F", "chat").when(F.col("state") == "O", "agentic_loop").alias("shape"), (n % 5 * 60000 - 60000).alias("wall_ms"),
        F.when(n % 3 == 0, F.array().cast("array<string>")).when(n % 3 == 1, F.array(F.concat(F.lit("/w/"), "project"))).otherwise(F.array(F.concat(F.lit("/w/"), "project"), F.lit("/tmp"))).alias("paths"),
        (F.col("sort_key") + F.make_dt_interval(mins=F.pmod(n, F.lit(5)).cast("int"))).alias("ended"), "project",
    )


@query(f"WITH {_PROFILES} SELECT coalesce(terminal_state, 'unknown') AS key, count(*) AS n FROM p GROUP BY 1")
def profiles_by_end(spark, d):
    return reports.by_dimension(profiles(spark, d), "terminal_state")


@query(f"WITH {_PROFILES} SELECT strftime(date, '%G-W%V') AS key, coalesce(shape, 'unknown') AS shape, count(*) AS n FROM p GROUP BY 1, 2")
def shapes_by_week(spark, d):
    return reports.shape_histogram(profiles(spark, d), "week")


@query("""SELECT key, coalesce(CASE o_orderstatus WHEN 'F' THEN 'chat' WHEN 'O' THEN 'agentic_loop' END, 'unknown') AS shape, count(*) AS n FROM
(SELECT o_orderstatus, unnest(CASE o_orderkey % 3 WHEN 0 THEN ['unattributed'] WHEN 1 THEN ['/w/' || o_custkey] ELSE ['/w/' || o_custkey, '/tmp'] END) AS key FROM orders) GROUP BY 1, 2""")
def shapes_by_project(spark, d):
    return reports.shape_histogram(profiles(spark, d), "project")


@query(f"WITH {_PROFILES} SELECT session_id, terminal_state, date FROM p WHERE terminal_state IN ('error_left', 'tool_left', 'agent_hanging')")
def abandoned_sessions(spark, d):
    return reports.abandoned(profiles(spark, d), "error_left").select("session_id", "terminal_state", "date")


_SPREAD = "count({0}) FILTER ({0} > 0) AS {1}_n, round(quantile_cont({0}, 0.25) FILTER ({0} > 0), 6) AS {1}_p25, round(quantile_cont({0}, 0.5) FILTER ({0} > 0), 6) AS {1}_p50, round(quantile_cont({0}, 0.75) FILTER ({0} > 0), 6) AS {1}_p75, max({0}) FILTER ({0} > 0) AS {1}_max"


@query(f"WITH {_PROFILES} SELECT origin, count(*) AS sessions, round(sum(cost), 2) AS total_cost, min(started) AS earliest, max(started + to_minutes(session_id % 5)) AS latest, CAST(sum(greatest(wall_ms, 0)) AS BIGINT) AS wall_ms, {_SPREAD.format('cost', 'cost')}, {_SPREAD.format('wall_ms', 'wall')} FROM p GROUP BY 1")
def portfolio(spark, d):
    return reports.portfolio(profiles(spark, d), "origin").withColumn("total_cost", F.round("total_cost", 2))


@query("SELECT o_orderkey AS session_id, o_orderpriority AS origin, place FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) place FROM orders) WHERE place <= 5")
def postmortem_sessions(spark, d):
    return reports.top_of_each(profiles(spark, d), "origin", "cost", 5).select("session_id", "origin", F.col("place").cast("long").alias("place"))


@query("""SELECT event_type AS origin, count(*) AS expected, count(*) FILTER (held) AS captured, round(count(*) FILTER (held) / count(*), 6) AS coverage FROM
(SELECT DISTINCT event_type, user_id, user_id IN (SELECT conv_id FROM conversations) AS held FROM events WHERE ts < TIMESTAMP '2024-01-20') GROUP BY 1""")
def capture_coverage(spark, d):
    starts = actions(spark, d).select(F.col("kind").alias("origin"), "session_id", F.col("ts").alias("at"))
    return reports.capture_coverage(starts, messages(spark, d), F.expr("timestamp_ntz'2024-01-20'"))


def _broken_forest(spark, d):
    """Customers as sessions: a parent at half the number, some unknown, some in cycles of two."""
    n = F.col("c_custkey")
    parent = F.when(n < 2, None).when(n % 97 == 0, -n).when((n % 50 == 8) & (n + 1 <= F.lit(10**9)), n + 1).when(n % 50 == 9, n - 1).otherwise(F.floor(n / 2))
    return read(spark, d, "customer").select(n.alias("node"), parent.alias("parent"))


_BROKEN = """WITH RECURSIVE e AS (SELECT c_custkey AS node, CASE WHEN c_custkey < 2 THEN NULL WHEN c_custkey % 97 = 0 THEN -c_custkey WHEN c_custkey % 50 = 8 THEN c_custkey + 1 WHEN c_custkey % 50 = 9 THEN c_custkey - 1 ELSE c_custkey // 2 END AS parent FROM customer),
w AS (SELECT node, parent AS up, CASE WHEN parent IS NULL THEN node END AS root, 0 AS k FROM e UNION ALL SELECT w.node, e.parent, CASE WHEN e.parent IS NULL THEN e.node END, k + 1 FROM w JOIN e ON e.node = w.up WHERE k < 60),
s AS (SELECT e.node, max(w.root) AS root, bool_or(w.up IS NOT NULL AND w.up NOT IN (SELECT node FROM e)) AS missing FROM e JOIN w ON w.node = e.node GROUP BY 1),
t AS (SELECT node, root, CASE WHEN root IS NOT NULL THEN 'rooted' WHEN missing THEN 'missing_parent' ELSE 'cycle' END AS state FROM s) """


@query(_BROKEN + "SELECT node, state, state = 'rooted' AS complete FROM t")
def lineage_states(spark, d):
    return graph.lineage_state(_broken_forest(spark, d)).drop("root")


@query(_BROKEN + "SELECT count(*) AS sessions, count(DISTINCT root) AS logical_sessions, count(*) FILTER (state = 'missing_parent') AS missing_parent, count(*) FILTER (state = 'cycle') AS in_cycle FROM t")
def topology_counts(spark, d):
    return reports.topology_counts(_broken_forest(spark, d))


@query("""WITH RECURSIVE w AS (SELECT c_custkey node, c_custkey root FROM customer WHERE c_custkey % 7 = 0 OR c_custkey < 2 UNION ALL SELECT c.c_custkey, w.root FROM customer c JOIN w ON c.c_custkey // 2 = w.node WHERE NOT (c.c_custkey % 7 = 0 OR c.c_custkey < 2))
SELECT node FROM w WHERE root = (SELECT root FROM w WHERE node = 29)""")
def lineage_family(spark, d):
    n = F.col("c_custkey")
    edges = read(spark, d, "customer").select(n.alias("node"), F.when((n % 7 == 0) | (n < 2), None).otherwise(F.floor(n / 2)).alias("parent"))
    return graph.family(edges, 29)


@query("""SELECT event_type AS kind, count(*) AS n, count(*) FILTER (c < 0.34) AS low, count(*) FILTER (c >= 0.34 AND c < 0.67) AS mid, count(*) FILTER (c >= 0.67) AS high, count(*) FILTER (c IS NULL) AS unstated, count(*) FILTER (event_id % 4 < 2) AS stale,
count(*) FILTER (event_id % 9 = 0) AS fallbacks, count(*) FILTER (length(props) > 9) AS with_evidence FROM (SELECT *, CASE WHEN event_id % 7 > 0 THEN (user_id % 100) / 100 END AS c FROM events) GROUP BY 1""")
def rigor_audit(spark, d):
    e = F.col("event_id")
    rows = actions(spark, d).select("kind", F.when(e % 7 > 0, F.col("session_id") % 100 / 100).alias("confidence"), (e % 4).alias("version"), (e % 9 == 0).alias("fallback"), F.when(F.length("tool_id") > 9, F.col("tool_id")).alias("evidence"))
    return reports.rigor_audit(rows, "kind", 2)


@query("""WITH t AS (SELECT user_id, CASE event_type WHEN 'view' THEN 'mcp__serena__find' WHEN 'click' THEN 'Bash' WHEN 'purchase' THEN 'mcp__plugin_docs__get' WHEN 'signup' THEN 'Edit' ELSE '' END AS tool, CASE WHEN value > 50 THEN 'run search_code now' ELSE 'ls' END AS detail FROM events),
f AS (SELECT user_id, CASE tool WHEN 'mcp__serena__find' THEN 'serena' WHEN 'Bash' THEN CASE WHEN detail LIKE '%search_code%' THEN 'codebase-memory' ELSE 'bash' END WHEN 'mcp__plugin_docs__get' THEN 'docs' WHEN 'Edit' THEN 'edit' ELSE 'unknown' END AS family,
CASE WHEN tool LIKE 'mcp__%' THEN 'mcp_tool_call' WHEN tool = 'Bash' THEN 'command_detail' WHEN tool = 'Edit' THEN 'edit_content' ELSE 'tool_call' END AS kind FROM t)
SELECT family, count(*) AS calls, count(DISTINCT user_id) AS sessions, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM f GROUP BY 1""")
def family_usage(spark, d):
    k = F.col("kind")
    tool = F.when(k == "view", "mcp__serena__find").when(k == "click", "Bash").when(k == "purchase", "mcp__plugin_docs__get").when(k == "signup", "Edit").otherwise("")
    return reports.family_usage(actions(spark, d).select("session_id", tool.alias("tool"), F.when(F.col("value") > 50, "run search_code now").otherwise("ls").alias("detail")))


@query("""WITH r AS (SELECT user_id, 'event' AS row, event_type AS label, ts AS started, ts AS ended FROM events WHERE event_type <> 'view' UNION ALL SELECT user_id, 'phase', 'day', min(ts), max(ts) FROM events GROUP BY user_id, CAST(ts AS DATE))
SELECT user_id AS session_id, row, label, started, row_number() OVER (PARTITION BY user_id ORDER BY started NULLS LAST, row DESC, ended, label) - 1 AS place FROM r""")
def session_timeline(spark, d):
    a = actions(spark, d)
    events = a.where("kind <> 'view'").select("session_id", F.col("kind").alias("label"), F.col("ts").alias("started"), F.col("ts").alias("ended"))
    phases = a.groupBy("session_id", F.to_date("ts").alias("day")).agg(F.min("ts").alias("started"), F.max("ts").alias("ended")).select("session_id", F.lit("day").alias("label"), "started", "ended")
    return reports.timeline(events, phases).select("session_id", "row", "label", "started", F.col("place").cast("long").alias("place"))


@query("SELECT s.k AS session_id, e.event_id AS commit, CASE WHEN e.ts <= s.b THEN 'during' ELSE 'after' END AS relation FROM (SELECT user_id AS repo, min(event_id) AS k, min(ts) AS a, min(ts) + INTERVAL 2 HOUR AS b FROM events GROUP BY user_id, CAST(ts AS DATE)) s JOIN events e ON e.user_id = s.repo AND e.event_type = 'purchase' AND e.ts >= s.a AND e.ts <= s.b + INTERVAL 90 MINUTE")
def git_correlation(spark, d):
    a = actions(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    s = a.groupBy(F.col("session_id").alias("repo"), F.to_date("ts").alias("day")).agg(F.min("event_id").alias("session_id"), F.min("ts").alias("started"), (F.min("ts") + F.expr("interval 2 hour")).alias("ended")).drop("day")
    return reports.git_links(s, a.where("kind = 'purchase'").select(F.col("session_id").alias("repo"), F.col("ts").alias("at"), F.col("event_id").alias("commit")), 90)


@query("SELECT 'origin:' || o_orderpriority AS tag, count(*) AS sessions, 0 AS explicit FROM orders GROUP BY 1")
def origin_tags(spark, d):
    return reports.origin_tags(sessions(spark, d))


@query("""SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'failed_delegation' WHEN o_custkey % 3 = 0 THEN 'delegation_unresolved' ELSE CASE WHEN c_custkey IS NULL THEN 'delegation_unresolved' ELSE 'delegated_to' END END AS kind, count(*) AS n, count(DISTINCT CASE WHEN o_custkey % 3 = 0 THEN 'dispatch:' || o_orderkey ELSE 'session:' || o_custkey END) AS ends
FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) ON c_custkey = o_custkey GROUP BY 1""")
def delegation_graph(spark, d):
    s = sessions(spark, d).select(F.col("session_id").alias("action_id"), "session_id", F.when(F.col("session_id") % 4 == 0, 1).otherwise(0).alias("is_error"), "project")
    links = s.where("project % 3 <> 0").select("action_id", F.col("project").alias("child_id"))
    made = units.delegations(s.drop("project"), links, read(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("child_id")))
    return reports.delegation_edges(made).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("b").alias("ends"))


_FILES = """f AS (SELECT user_id, CASE event_type WHEN 'view' THEN '`/src/a' || event_id % 3 || '.py`' WHEN 'click' THEN 'lib/b.rs:12' WHEN 'purchase' THEN 'not a path' WHEN 'signup' THEN 'README.md,' ELSE '/etc/hosts' END AS path,
CASE WHEN value > 50 THEN 'git@host:team/tool.git' ELSE 'https://host/x/site' END AS remote FROM events)"""


@query(f"""WITH {_FILES}, c AS (SELECT user_id, CASE WHEN path = 'not a path' THEN NULL ELSE regexp_replace(regexp_replace(trim(path, '`'), ',$', ''), ':12$', '') END AS path, CASE WHEN remote LIKE 'git@%' THEN 'tool' ELSE 'site' END AS repo FROM f),
l AS (SELECT *, CASE WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.rs' THEN 'rust' WHEN path LIKE '%.md' THEN 'markdown' END AS language FROM c)
SELECT user_id AS session_id, count(DISTINCT path) AS paths, coalesce(string_agg(DISTINCT language, ',' ORDER BY language), '') AS languages, string_agg(DISTINCT repo, ',' ORDER BY repo) AS repos FROM l GROUP BY 1""")
def session_attribution(spark, d):
    k = F.col("kind")
    path = F.when(k == "view", F.concat(F.lit("`/src/a"), (F.col("event_id") % 3).cast("string"), F.lit(".py`"))).when(k == "click", "lib/b.rs:12").when(k == "purchase", "not a path").when(k == "signup", "README.md,").otherwise("/etc/hosts")
    touched = actions(spark, d).select("session_id", path.alias("path"), F.when(F.col("value") > 50, "git@host:team/tool.git").otherwise("https://host/x/site").alias("remote"))
    return reports.attribution(touched).select("session_id", "paths", F.array_join("languages", ",").alias("languages"), F.array_join("repos", ",").alias("repos"))


@query("SELECT session_id, stuck, last_at FROM (SELECT user_id AS session_id, count(*) FILTER (event_type='error' AND value > 90) AS stuck, max(ts) AS last_at FROM events GROUP BY 1) WHERE stuck > 0 ORDER BY stuck DESC, last_at DESC, session_id LIMIT 20")
def stuck_sessions(spark, d):
    per = actions(spark, d).groupBy("session_id").agg(F.count_if((F.col("kind") == "error") & (F.col("value") > 90)).alias("stuck"), F.max("ts").alias("last_at"))
    return reports.stuck(per, 20).select("session_id", "stuck", "last_at")


@query("SELECT user_id AS session_id, count(*) AS compactions, max(ts) AS last_at, round(sum(value), 3) AS before FROM events WHERE event_type = 'signup' GROUP BY 1")
def compactions(spark, d):
    e = actions(spark, d).select("session_id", F.when(F.col("kind") == "signup", "compaction").otherwise("other").alias("kind"), F.col("ts").alias("at"), "value")
    return reports.compactions(e).withColumn("before", F.round("before", 3))


@query("SELECT o_orderkey AS session_id FROM orders WHERE CAST(o_orderkey AS VARCHAR) = '12'")
def id_prefix(spark, d):
    return reports.by_id_prefix(sessions(spark, d), "12")


@query("""SELECT session_id, attachment_id, field FROM (SELECT user_id AS session_id, event_id AS attachment_id, CASE WHEN event_type = 'view' THEN 'name' ELSE 'hash' END AS field, row_number() OVER (PARTITION BY user_id ORDER BY event_type <> 'view', event_id) r
FROM events WHERE event_type = 'view' OR value > 80) WHERE r = 1""")
def attachment_identity(spark, d):
    rows = actions(spark, d).select("session_id", F.col("event_id").alias("attachment_id"), F.when(F.col("kind") == "view", "x.png").alias("name"), F.when(F.col("value") > 80, "x.png").alias("hash"))
    return reports.attachment_hits(rows, "x.png", ["name", "hash"])


@query("""WITH g AS (SELECT event_type, arg_max(lab, t) AS label, count(*) AS samples, arg_max(value, t) AS l, arg_min(value, t) AS f, (max(t) - min(t)) / 1000 AS s, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95
FROM (SELECT *, event_id * 1000 AS t, CASE WHEN event_id % 3 = 0 THEN 'steady' ELSE 'backlog' END AS lab FROM events) GROUP BY 1)
SELECT event_type AS kind, label, samples, round(l, 6) AS level, p50, p95, round((l - f) / s, 6) AS slope_per_s, CASE WHEN label = 'backlog' AND l < f AND l > 0 THEN round(l / -((l - f) / s), 3) END AS eta_s, round(l / 40.0, 6) AS burn_rate, samples >= 2 AS confident FROM g""")
def slo_levels(spark, d):
    rows = actions(spark, d).select("kind", (F.col("event_id") * 1000).alias("at_ms"), "value", F.when(F.col("event_id") % 3 == 0, "steady").otherwise("backlog").alias("label"))
    return reports.slo(rows, "kind", 40.0)


@query("""WITH m AS (SELECT *, count(*) OVER (PARTITION BY conv_id) total FROM conversations), a AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) x, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) y FROM m WHERE role = 'user' AND regexp_matches(text, '[^ \\t\\n\\r]'))
SELECT conv_id AS session_id, turn AS position, role, CASE WHEN x <= 1 THEN 'first' ELSE 'last' END AS part, total - count(*) OVER (PARTITION BY conv_id) AS omitted FROM a WHERE x <= 1 OR y <= 1""")
def chronicle(spark, d):
    return reports.chronicle(messages(spark, d), F.col("role") == "user", 1)


@query("""WITH f AS (SELECT user_id, event_id // 3 AS m, props AS g FROM events WHERE event_type = 'purchase' AND value > 60) SELECT g AS "group", count(DISTINCT user_id) AS sessions, count(*) AS facts, count(DISTINCT m) AS messages FROM f GROUP BY 1
UNION ALL SELECT 'none', count(*), 0, 0 FROM (SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM f)) HAVING count(*) > 0 UNION ALL SELECT 'MATCHED', count(DISTINCT user_id), count(*), count(DISTINCT m) FROM f""")
def stats_by_tool_with_none(spark, d):
    a = actions(spark, d)
    facts = a.where("kind = 'purchase' and value > 60").select("session_id", F.col("tool_id").alias("tool"), F.floor(F.col("event_id") / 3).alias("message"))
    return reports.grouped_stats(a, facts, "tool", "message")


@query("SELECT count(*) FILTER (a) AS before, count(*) FILTER (b) AS now, count(*) FILTER (b AND NOT a) AS added, count(*) FILTER (a AND NOT b) AS removed, count(*) FILTER (a <> b) > 0 AS changed FROM (SELECT user_id, bool_or(ts < TIMESTAMP '2024-01-15') a, bool_or(ts >= TIMESTAMP '2024-01-15') b FROM events WHERE event_type='purchase' GROUP BY 1)")
def standing_query(spark, d):
    p = actions(spark, d).where("kind = 'purchase'")
    return reports.watched(p.where("ts < timestamp_ntz'2024-01-15'"), p.where("ts >= timestamp_ntz'2024-01-15'"), "session_id")


@query("""SELECT doc_id, CASE WHEN n_chars % 11 = 0 THEN 'non-decisive' WHEN n_chars % 13 = 0 THEN 'high-stakes' WHEN n_chars % 17 = 0 THEN 'disagreement' WHEN n_chars % 19 = 0 THEN 'quota' WHEN quality IS NULL THEN 'no-calibration' WHEN n_chars % 7 < 5 THEN 'little-gold' WHEN quality = 0 THEN 'low-agreement' END AS reason
FROM documents LEFT JOIN labels USING (doc_id)""")
def cascade_routes(spark, d):
    both = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left")
    n = F.col("n_chars")
    verdict = F.when(n % 11 == 0, "abstain").otherwise("prefer")
    return both.select("doc_id", judgement.route(verdict, n % 13 == 0, n % 17 == 0, n % 19 == 0, F.when(F.col("quality") == 1, 0.9).when(F.col("quality") == 0, 0.5), n % 7).alias("reason"))


_CDF = judgement.POISSON
_W = " + ".join(f"CAST(u >= {p!r} AS INT)" for p in _CDF)


@query(f"""WITH v AS (SELECT source, doc_id, CAST(n_chars AS DOUBLE) AS v FROM documents WHERE n_chars IS NOT NULL), d AS (SELECT source, r, v, CAST(('0x' || substr(md5('7-' || r || '-' || doc_id), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u FROM v, range(100) t(r)),
m AS (SELECT source, r, sum(({_W}) * v) / nullif(sum({_W}), 0) AS m FROM d GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY m, r) - 1 AS k, count(*) OVER (PARTITION BY source) AS c FROM m WHERE m IS NOT NULL)
SELECT source, n, round(mean, 6) AS mean, CASE WHEN n >= 2 THEN round(lo, 6) END AS lo, CASE WHEN n >= 2 THEN round(hi, 6) END AS hi FROM (SELECT source, count(*) AS n, avg(v) AS mean FROM v GROUP BY 1)
JOIN (SELECT source, max(CASE WHEN k = least(floor(c * 0.025), c - 1) THEN m END) AS lo, max(CASE WHEN k = least(floor(c * 0.975), c - 1) THEN m END) AS hi FROM k GROUP BY 1) USING (source)""")
def bootstrap_interval(spark, d):
    return judgement.bootstrap(read(spark, d, "documents"), "source", "n_chars", "doc_id", resamples=100, seed=7)


@query("""SELECT event_id, CASE WHEN abs(value - 50) < 20 THEN 'suppressed-magnitude-floor' WHEN event_id % 10 < 3 THEN 'suppressed-cooldown' WHEN event_id % 7 = 0 THEN 'suppressed-frame-degraded' WHEN r <= 4 THEN 'fired' ELSE 'suppressed-budget' END AS outcome FROM
(SELECT *, row_number() OVER (PARTITION BY CAST(ts AS DATE), abs(value - 50) >= 20 AND event_id % 10 >= 3 AND event_id % 7 <> 0 ORDER BY abs(value - 50) DESC, event_id) r FROM events WHERE event_type='error')""")
def alert_outcomes(spark, d):
    e = F.col("event_id")
    rows = actions(spark, d).where("kind = 'error'").select(e.alias("watch"), F.to_date("ts").alias("day"), (F.col("value") - 50).alias("deviation"), F.lit(10).alias("at_ms"), F.when(e % 10 < 3, 5).alias("last_ms"), (e % 7 == 0).alias("degraded"))
    return judgement.alert_decisions(rows, "day", 20, 6, 4).select(F.col("watch").alias("event_id"), "outcome")


@query("SELECT conv_id AS session_id, turn AS position, role IN ('user','assistant') AS is_dialogue, role = 'system' OR turn % 4 = 3 AS is_noise, role IN ('user','assistant') AND turn % 4 < 2 AS is_substantive, turn > 0 AS is_branch FROM conversations")
def message_flags(spark, d):
    t = F.col("position")
    kind = F.when(t % 4 == 3, "tool_use").when(t % 4 == 2, "thinking").otherwise("message")
    flags = content.message_flags(F.col("role"), kind, F.when(t > 0, t - 1))
    return messages(spark, d).select("session_id", "position", *[flags[k].alias(k) for k in ("is_dialogue", "is_noise", "is_substantive", "is_branch")])


@query(r"SELECT doc_id, CASE WHEN length(p) > 60 THEN rtrim(substr(p, 1, 59)) || '…' ELSE p END AS title, CAST(floor(len(regexp_extract_all(text, '[^ \t\n\r]+')) * 13 / 10) AS BIGINT) AS tokens FROM (SELECT *, trim(regexp_replace(text, '[ \t\n\r\f\x0B]+', ' ', 'g')) AS p FROM documents)")
def bounded_titles(spark, d):
    docs = read(spark, d, "documents")
    return docs.select("doc_id", content.bounded(F.col("text"), 60).alias("title"), content.token_estimate(F.regexp_count("text", F.lit(r"[^ \t\n\r]+"))).alias("tokens"))


@query("""SELECT o_orderkey AS session_id, array_to_string(list_sort(list_filter(['origin:' || o_orderpriority, CASE WHEN o_orderkey % 3 > 0 THEN 'repo:r' || o_custkey % 5 END, CASE WHEN o_orderkey % 3 = 2 THEN 'repo:z' END, CASE WHEN o_orderstatus = 'P' THEN 'continuation' END,
CASE WHEN o_orderkey % 6 >= 3 THEN 'deep-thread' END, CASE WHEN o_orderkey % 3 = 2 THEN 'multi-repo' END, CASE WHEN o_totalprice >= 1 THEN 'costly' END], lambda x: x IS NOT NULL)), ',') AS tags FROM orders""")
def auto_tags(spark, d):
    n, one = F.col("session_id"), F.concat(F.lit("r"), (F.col("project") % 5).cast("string"))
    repos = F.when(n % 3 == 0, F.array().cast("array<string>")).when(n % 3 == 1, F.array(one)).otherwise(F.array(one, F.lit("z")))
    return sessions(spark, d).select("session_id", F.array_join(content.auto_tags(F.col("origin"), repos, F.col("state") == "P", n % 6, F.col("cost")), ",").alias("tags"))


@query("SELECT o_orderkey AS session_id FROM orders WHERE o_orderkey % 3 = 2 AND o_custkey IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89) AND o_orderstatus <> 'O' AND o_orderstatus = 'P'")
def repo_project_filters(spark, d):
    n = F.col("session_id")
    s = sessions(spark, d).withColumn("repos", F.when(n % 3 == 2, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))).withColumn("branch", F.when(F.col("state") == "P", "continuation").when(F.col("state") == "O", "sidechain"))
    return s.where(filters.session_filter(repos=["b", "x"], projects=[1, 2, 3, 5, 8, 13, 21, 34, 55, 89], continuation=True, sidechain=False)).select("session_id")


@query("SELECT user_id AS session_id, max(n) > 1 AS has_branches FROM (SELECT user_id, CAST(floor(value) AS BIGINT) % 40 AS p, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1, 2) GROUP BY 1")
def branched_sessions(spark, d):
    m = actions(spark, d).where("kind = 'click'").select("session_id", (F.floor("value") % 40).alias("parent_id"))
    return filters.with_branches(m.select("session_id").distinct(), m)


@query(f"""WITH e AS (SELECT doc_id, source, {TERMS} w FROM documents WHERE lang = 'en'), c AS (SELECT doc_id, len(w) dl, len(list_filter(w, lambda x: x='license')) a FROM e), s AS (SELECT count(*) n, avg(dl) av, count(*) FILTER (a>0) da FROM c)
SELECT doc_id, round(ln(1+(n-da+0.5)/(da+0.5))*a*2.2/(a+1.2*(0.25+0.75*dl/av)), 6) AS score FROM c, s WHERE a > 0 ORDER BY score DESC, doc_id LIMIT 15""")
def work_event_search(spark, d):
    events = read(spark, d, "documents").where("lang = 'en'")
    return search.bm25(events, "doc_id", "text", ["license"]).orderBy(F.desc("score"), "doc_id").limit(15)


@query("SELECT '$.k' AS path, count(DISTINCT props) AS keys FROM events")
def json_key_families(spark, d):
    flat = structure.flattened(read(spark, d, "events"), "event_id", "props")
    return structure.collapsed(flat).groupBy("path").agg(F.count_distinct("value").alias("keys"))


@query("""WITH v AS (SELECT DISTINCT 'o_custkey' AS path, CAST(o_custkey AS VARCHAR) AS v FROM orders UNION ALL SELECT DISTINCT 'c_custkey', CAST(c_custkey AS VARCHAR) FROM customer UNION ALL SELECT DISTINCT 'o_orderpriority', o_orderpriority FROM orders), n AS (SELECT path, count(*) AS n FROM v GROUP BY 1 HAVING count(*) >= 50)
SELECT a.path AS child, b.path AS parent, count(*) AS shared FROM v a JOIN v b ON a.v = b.v AND a.path <> b.path JOIN n x ON x.path = a.path JOIN n y ON y.path = b.path GROUP BY 1, 2, x.n, y.n HAVING count(*) >= 0.95 * x.n AND x.n <= y.n""")
def value_relations(spark, d):
    col = lambda t, c: read(spark, d, t).select(F.lit(c).alias("path"), F.col(c).cast("string").alias("value"))
    flat = col("orders", "o_custkey").union(col("customer", "c_custkey")).union(col("orders", "o_orderpriority"))
    return structure.relations(flat, 0.95, 50)


@query("""WITH RECURSIVE e AS (SELECT c_custkey AS node, CASE WHEN c_custkey % 7 = 0 OR c_custkey < 2 THEN NULL WHEN c_custkey % 31 = 0 THEN -1 ELSE c_custkey // 2 END AS parent, c_nationkey AS repo FROM customer),
w AS (SELECT node, node AS root, 0 AS depth FROM e WHERE parent IS NULL OR parent = -1 UNION ALL SELECT e.node, w.root, w.depth + 1 FROM e JOIN w ON e.parent = w.node),
r AS (SELECT root, arg_min(repo, k) AS repo FROM (SELECT root, repo, row_number() OVER (PARTITION BY root ORDER BY count(*) DESC, repo) AS k FROM w JOIN e USING (node) GROUP BY 1, 2) GROUP BY 1)
SELECT root, count(*) AS members, max(depth) AS depth, count(*) FILTER (node NOT IN (SELECT parent FROM e WHERE parent IS NOT NULL)) AS branch_count, max(r.repo) AS dominant_repo, CASE WHEN count(*) > 1 THEN 'strong' ELSE 'moderate' END AS support, CASE WHEN count(*) > 1 THEN 1.0::DOUBLE ELSE 0.85::DOUBLE END AS confidence
FROM w JOIN r USING (root) GROUP BY 1""")
def thread_reports(spark, d):
    n = F.col("c_custkey")
    parent = F.when((n % 7 == 0) | (n < 2), None).when(n % 31 == 0, -1).otherwise(F.floor(n / 2))
    none = F.lit(None).cast("timestamp")
    rows = read(spark, d, "customer").select(n.alias("node"), parent.alias("parent"), none.alias("started"), none.alias("ended"), F.lit(0.0).alias("cost"), F.col("c_nationkey").alias("repo"))
    return graph.thread_report(rows).select("root", "members", "depth", "branch_count", "dominant_repo", "support", "confidence")


@query("""WITH RECURSIVE l AS (SELECT source, sha256(CAST(doc_id AS VARCHAR)) AS h, row_number() OVER (PARTITION BY source ORDER BY sha256(CAST(doc_id AS VARCHAR))) - 1 AS n, count(*) OVER (PARTITION BY source) AS c, count(*) OVER (PARTITION BY source) AS members FROM documents),
t AS (SELECT source, list(h ORDER BY n) AS hs, any_value(members) AS members FROM l GROUP BY 1 UNION ALL SELECT source, list_transform(range(0, len(hs), 2), lambda i: sha256(hs[i + 1] || coalesce(hs[i + 2], hs[i + 1]))), members FROM t WHERE len(hs) > 1)
SELECT source, hs[1] AS root, members FROM t WHERE len(hs) = 1""")
def merkle_roots(spark, d):
    return results.merkle_roots(read(spark, d, "documents"), "source", "doc_id")


@query("""WITH r AS (SELECT user_id AS session_id, CASE event_type WHEN 'view' THEN 'nearby_time' WHEN 'click' THEN 'content_search' WHEN 'purchase' THEN 'query_match' WHEN 'signup' THEN 'similarity' ELSE CASE WHEN value > 50 THEN 'attachment' ELSE 'same_title' END END AS reason, value / 100 AS s, event_id FROM events WHERE value > 80 OR event_id % 5 = 0),
b AS (SELECT session_id, reason, max(CASE reason WHEN 'same_title' THEN 3.0::DOUBLE WHEN 'nearby_time' THEN 1.5::DOUBLE * greatest(s, 0.1) WHEN 'attachment' THEN 4.0::DOUBLE WHEN 'content_search' THEN 1.75::DOUBLE WHEN 'query_match' THEN greatest(0.5, least(3.0, coalesce(CASE WHEN event_id % 2 = 0 THEN s * 4 END, 2.0::DOUBLE))) ELSE 3.0::DOUBLE * s END) AS x FROM r GROUP BY 1, 2)
SELECT session_id, round(sum(x), 6) AS score, string_agg(reason, ',' ORDER BY reason) AS reasons FROM b GROUP BY 1 HAVING round(sum(x), 6) > 0 ORDER BY score DESC, session_id LIMIT 40""")
def neighbour_reasons(spark, d):
    k, v = F.col("kind"), F.col("value")
    reason = F.when(k == "view", "nearby_time").when(k == "click", "content_search").when(k == "purchase", "query_match").when(k == "signup", "similarity").when(v > 50, "attachment").otherwise("same_title")
    strength = F.when(k == "purchase", F.when(F.col("event_id") % 2 == 0, v / 100 * 4)).otherwise(v / 100)
    rows = actions(spark, d).where("value > 80 or event_id % 5 = 0").select("session_id", reason.alias("reason"), strength.alias("strength"))
    return search.neighbours_by_reasons(rows, 40)


@query("""WITH t AS (SELECT event_type kind, CAST(ts AS DATE) AS day, sum(value) v FROM events GROUP BY 1, 2), r AS (SELECT *, sum(v) OVER (PARTITION BY kind ORDER BY day) AS x, row_number() OVER (PARTITION BY kind ORDER BY day) AS k FROM t)
SELECT kind, count(*) AS days, round(sum(v) / 20000, 4) AS pressure, round(greatest(sum(v) / count(*) * 45 - 20000, 0), 3) AS overage, coalesce(min(k) FILTER (x >= 20000), CASE WHEN sum(v) > 0 AND sum(v) / count(*) * 45 >= 20000 THEN CAST(ceil(20000 / (sum(v) / count(*))) AS BIGINT) END) AS breach_day FROM r GROUP BY 1""")
def quota_outlook(spark, d):
    daily = actions(spark, d).groupBy("kind", F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"))
    return windows.quota_outlook(daily, "kind", "day", "v", 45, 20_000)


_TURNS = """m AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, epoch_us(ts) AS t, CASE WHEN event_type IN ('view', 'signup') THEN 'user' ELSE 'assistant' END AS role,
CASE event_type WHEN 'error' THEN 'tool_result' WHEN 'purchase' THEN 'thinking' WHEN 'signup' THEN 'tool_use' ELSE 'message' END AS kind FROM events),
g AS (SELECT *, lag(role) OVER w AS b, greatest((t - lag(t) OVER w) // 1000, 0) AS gap FROM m WINDOW w AS (PARTITION BY user_id ORDER BY k))"""


def turns(spark, d):
    k = F.col("kind")
    kind = F.when(k == "error", "tool_result").when(k == "purchase", "thinking").when(k == "signup", "tool_use").otherwise("message")
    rows = actions(spark, d).withColumn("role", F.when(k.isin("view", "signup"), "user").otherwise("assistant"))
    return rows.select("session_id", F.struct("ts", "event_id").alias("position"), F.col("ts").alias("at"), "role", kind.alias("kind"))


@query(f"""WITH {_TURNS} SELECT user_id AS session_id, CAST(coalesce(sum(gap) FILTER (kind = 'thinking'), 0) AS BIGINT) AS thinking_ms, CAST(coalesce(sum(gap) FILTER (kind = 'message' AND role = 'assistant'), 0) AS BIGINT) AS output_ms,
CAST(coalesce(sum(gap) FILTER (kind IN ('tool_use', 'tool_result') AND b = 'assistant'), 0) AS BIGINT) AS tool_ms, CASE WHEN count(*) FILTER (kind = 'tool_use') > 0 AND max(t) > min(t) THEN round(count(*) FILTER (kind = 'tool_use') / (((max(t) - min(t)) // 1000) / 60000), 2) ELSE 0 END AS calls_per_minute FROM g GROUP BY 1""")
def session_timing(spark, d):
    return outcomes.session_timing(turns(spark, d))


@query("""WITH m AS (SELECT user_id, ts, event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE epoch_us(ts) END AS t, CASE WHEN event_type IN ('view', 'signup') THEN 'user' WHEN event_type = 'error' THEN 'tool' ELSE 'assistant' END AS role FROM events),
p AS (SELECT x.user_id, x.role, x.t, (SELECT struct_pack(role := y.role, t := y.t) FROM m y WHERE y.user_id = x.user_id AND y.t IS NOT NULL AND y.role IN ('user', 'assistant') AND (y.ts, y.event_id) > (x.ts, x.event_id) ORDER BY y.ts, y.event_id LIMIT 1) AS n FROM m x WHERE x.t IS NOT NULL),
g AS (SELECT user_id, greatest((n.t - t) // 1000, 0) AS gap, role = 'user' AND n.role = 'assistant' AS agent, role = 'assistant' AND n.role = 'user' AS human FROM p WHERE n IS NOT NULL)
SELECT s.user_id AS session_id, coalesce(CAST(floor(quantile_cont(gap, 0.5) FILTER (agent)) AS BIGINT), 0) AS agent_response_ms, coalesce(CAST(floor(quantile_cont(gap, 0.5) FILTER (human AND gap <= 1800000)) AS BIGINT), 0) AS user_response_ms FROM (SELECT DISTINCT user_id FROM events) s LEFT JOIN g ON g.user_id = s.user_id GROUP BY 1""")
def response_times(spark, d):
    k = F.col("kind")
    rows = actions(spark, d).withColumn("role", F.when(k.isin("view", "signup"), "user").when(k == "error", "tool").otherwise("assistant"))
    return outcomes.response_times(rows.select("session_id", F.struct("ts", "event_id").alias("position"), F.when(F.col("event_id") % 11 != 0, F.col("ts")).alias("at"), "role"))


@query("""SELECT conv_id AS session_id, n AS order_key FROM (SELECT conv_id, max(len(regexp_extract_all(text, '[^ \t\n\r]+'))) AS n FROM conversations GROUP BY 1) ORDER BY n DESC, conv_id LIMIT 25""")
def sessions_by_longest(spark, d):
    m = messages(spark, d)
    return filters.session_order(m.select("session_id").distinct(), m, "longest").limit(25)


@query("""SELECT conv_id AS session_id, CAST(n // 4 AS BIGINT) AS order_key FROM (SELECT conv_id, sum(length(text)) AS n FROM conversations GROUP BY 1) ORDER BY n // 4, conv_id LIMIT 25""")
def sessions_by_tokens_reversed(spark, d):
    m = messages(spark, d)
    return filters.session_order(m.select("session_id").distinct(), m, "tokens", reverse=True).limit(25)


@query("""SELECT DISTINCT conv_id AS session_id FROM conversations WHERE (conv_id IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 90) OR conv_id NOT IN (SELECT user_id FROM events WHERE value > 90)) AND conv_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 90)""")
def tool_filter_with_none(spark, d):
    calls = actions(spark, d).where("value > 90").select("session_id", F.upper("kind").alias("tool"))
    return filters.child_filter(messages(spark, d).select("session_id").distinct(), calls, "tool", ["purchase", "none"], ["error"])


@query("""SELECT user_id AS session_id, bool_or(event_type = 'purchase' AND value > 95) AS has_thinking, bool_or(event_type = 'signup' AND value > 95) AS has_tools, bool_or(length(props) > 9 AND value > 97) AS has_attachments FROM events GROUP BY 1""")
def sessions_with_kinds(spark, d):
    k, v = F.col("kind"), F.col("value")
    return filters.has_kinds(actions(spark, d), {"thinking": (k == "purchase") & (v > 95), "tools": (k == "signup") & (v > 95), "attachments": (F.length("tool_id") > 9) & (v > 97)})


@query(rf"""SELECT doc_id, CASE WHEN regexp_matches(t, '{content.PASTE_MARK}') THEN 'marked' WHEN regexp_matches(t, '\S{{400,}}') OR (len(l) >= 6 AND 2 * len(list_filter(l, lambda x: regexp_matches(x, '{content.MACHINE_LINE}'))) >= len(l)) THEN 'likely' END AS paste FROM (
SELECT doc_id, t, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '\S')) AS l FROM (SELECT doc_id, CASE doc_id % 11 WHEN 1 THEN text || ' [Pasted text #2 +6 lines] ' WHEN 2 THEN repeat('2024-01-02 10:00:00 up' || chr(10), 6) || 'see above' WHEN 3 THEN repeat('aB', 300)
WHEN 4 THEN repeat('$ ls' || chr(10), 5) || 'no' WHEN 5 THEN repeat('word ', 600) WHEN 6 THEN repeat('  at a.b.C(D.java:1)' || chr(10), 3) || repeat('and so' || chr(10), 4) ELSE text END AS t FROM documents))""")
def paste_evidence(spark, d):
    n, t = F.col("doc_id") % 11, F.col("text")
    said = F.when(n == 1, F.concat(t, F.lit(" [Pasted text #2 +6 lines] "))).when(n == 2, F.lit("2024-01-02 10:00:00 up\n" * 6 + "see above")).when(n == 3, F.lit("aB" * 300)).when(n == 4, F.lit("$ ls\n" * 5 + "no")).when(n == 5, F.lit("word " * 600)).when(n == 6, F.lit("  at a.b.C(D.java:1)\n" * 3 + "and so\n" * 4)).otherwise(t)
    return read(spark, d, "documents").select("doc_id", content.paste_evidence(said).alias("paste"))


@query("""WITH r AS (SELECT * FROM (VALUES ('click', 6, 30, 0, 6, 15), ('view', 10, 50, 0, 10, 15), ('error', 2, 10, 0, 2, 15)) t(model, i, o, r, w, d)), u AS (SELECT user_id, event_type AS model, event_id % 1000 AS i, event_id % 70 AS o, event_id % 9 AS r, event_id % 5 AS w FROM events),
c AS (SELECT user_id, CAST(sum(coalesce(ceil(u.i * r.i / 15) + ceil(u.o * r.o / 15) + ceil(u.w * r.w / 15), 0)) AS BIGINT) AS credits FROM u LEFT JOIN r USING (model) GROUP BY 1) SELECT user_id AS session_id, credits, round(credits / 21700000 * 20, 6) AS usd FROM c""")
def subscription_credits(spark, d):
    e = F.col("event_id")
    usage = actions(spark, d).select("session_id", F.col("kind").alias("model"), (e % 1000).alias("input"), (e % 70).alias("output"), (e % 9).alias("cache_read"), (e % 5).alias("cache_write"))
    rates = spark.createDataFrame([("click", 6, 30, 0, 6, 15), ("view", 10, 50, 0, 10, 15), ("error", 2, 10, 0, 2, 15)], "model string, input int, output int, cache_read int, cache_write int, divisor int")
    return outcomes.subscription_credits(usage, rates, 20.0, 21_700_000)


@query(f"""WITH {_PROFILES}, a AS (SELECT l_orderkey AS session_id, min(CASE l_linenumber WHEN 1 THEN NULL WHEN 2 THEN 2 WHEN 3 THEN 1 WHEN 4 THEN 0 END) AS k, count(*) FILTER (l_linenumber IN (2, 3, 4)) AS n FROM lineitem GROUP BY 1),
j AS (SELECT p.session_id, k, n, terminal_state, CASE terminal_state WHEN 'tool_left' THEN 'awaiting_effect' WHEN 'error_left' THEN 'blocked' WHEN 'question_left' THEN 'ambiguous' WHEN 'unknown' THEN 'ambiguous' END AS own, (p.session_id % 10) / 10 AS c FROM p LEFT JOIN a USING (session_id))
SELECT session_id, CASE WHEN k = 0 THEN 'blocked' WHEN k > 0 THEN 'awaiting_operator' ELSE coalesce(own, 'unknown') END AS posture, CASE WHEN k IS NOT NULL THEN 'assertion' WHEN own IS NOT NULL THEN 'structural_inference' ELSE 'none' END AS authority,
CASE WHEN k = 0 THEN 0.9::DOUBLE WHEN k > 0 THEN 0.85::DOUBLE WHEN own IS NOT NULL THEN round(least(c, 0.8::DOUBLE), 4) END AS confidence, CASE WHEN k IS NOT NULL THEN n - (SELECT count(*) FROM lineitem WHERE l_orderkey = session_id AND l_linenumber = [4, 3, 2][k + 1]) + CAST(own IS NOT NULL AS INT) ELSE 0 END AS contradictions FROM j""")
def objective_postures(spark, d):
    p = profiles(spark, d).select("session_id", "terminal_state", (F.col("session_id") % 10 / 10).alias("confidence"))
    n = F.col("l_linenumber")
    kind = F.when(n == 2, "handoff").when(n == 3, "decision").when(n == 4, "blocker").otherwise("note")
    return outcomes.objective_posture(p, read(spark, d, "lineitem").select(F.col("l_orderkey").alias("session_id"), kind.alias("kind"), F.when(n == 4, 0.9).alias("confidence")))


@query("""SELECT state, count(*) AS n FROM (SELECT CASE WHEN o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey <> 3) OR o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) THEN 'rejected' ELSE CASE o_orderstatus WHEN 'F' THEN 'resolved' WHEN 'O' THEN 'ambiguous' ELSE 'contradicted' END END AS state FROM orders) GROUP BY 1""")
def reconciled_claims(spark, d):
    claims = read(spark, d, "customer").where("c_nationkey <> 3").select(F.col("c_custkey").alias("claim"))
    effects = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("effect"))
    told = F.when(F.col("state") == "F", "supported").when(F.col("state") == "O", "partial").otherwise("contradicted")
    judged = sessions(spark, d).select(F.col("project").alias("claim"), F.col("session_id").alias("effect"), told.alias("evaluation"))
    return outcomes.reconciled(claims, effects, judged).groupBy("state").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS session_id FROM orders WHERE (o_orderstatus = 'F' OR o_orderpriority = '1-URGENT') AND o_orderpriority <> '5-LOW' AND starts_with(CAST(o_orderkey AS VARCHAR), '7')")
def tag_filters(spark, d):
    s = sessions(spark, d).withColumn("tags", F.array(F.concat(F.lit("state:"), "state"), F.concat(F.lit("origin:"), "origin")))
    return s.where(filters.session_filter(tags=["state:F", "origin:1-URGENT"], exclude_tags=["origin:5-LOW"], id_prefix="7")).select("session_id")


@query("SELECT band, count(*) AS n FROM (SELECT CASE WHEN value / 100 >= 0.75 THEN 'strong' WHEN value / 100 >= 0.55 THEN 'moderate' ELSE 'weak' END AS band FROM events) GROUP BY 1")
def similarity_bands(spark, d):
    return actions(spark, d).groupBy(scalars.similarity_band(F.col("value") / 100).alias("band")).agg(F.count("*").alias("n"))


@query("SELECT CAST(doc_id AS VARCHAR) AS member, CASE WHEN doc_id % 13 = 0 THEN 'added' ELSE 'removed' END AS change FROM documents WHERE (doc_id % 13 = 0) <> (doc_id % 17 = 0)")
def stored_set_changes(spark, d):
    """A watched result stored twice, and compared from the top of its digests down."""
    docs = read(spark, d, "documents").select("doc_id")
    watch = members.Standing(spark, f"{folder(spark, 'standing')}/documents")
    watch.advance(docs.where("doc_id % 13 <> 0"), "doc_id")
    return watch.advance(docs.where("doc_id % 17 <> 0"), "doc_id")
