"""Queries of derived relations, ends of sessions, call times, costs, coverage and topology."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions import tools
from threadloom.operators import aggregates, graph, outcomes, search, units
from threadloom.plans.queries import BM25, SEED
from threadloom.plans.registry import query
from threadloom.tables import actions, messages, read, sessions

ORDER = ["ts", "event_id"]
HARNESS = {"1-URGENT": "terminal", "2-HIGH": "terminal", "3-MEDIUM": "web"}


@query("SELECT user_id AS session_id, props AS path, count(*) AS action_count, min(ts) AS first_seen, max(ts) AS last_seen FROM events WHERE props IS NOT NULL GROUP BY 1, 2")
def touched_files(spark, d):
    return units.files(actions(spark, d).withColumnRenamed("tool_id", "path"), "session_id", "path", "ts")


def _sessions(spark, d):
    branch = F.when(F.col("state") == "F", "subagent").when(F.col("state") == "O", "continuation")
    parent = F.when(F.col("session_id") % 3 == 0, F.floor(F.col("session_id") / 3))
    return sessions(spark, d).select("session_id", parent.alias("parent"), "origin", branch.alias("branch"), F.when(F.col("session_id") % 5 > 0, F.concat(F.lit("t"), F.col("session_id").cast("string"))).otherwise("").alias("title"), (F.col("session_id") % 4).alias("messages"))


@query("""SELECT 'run:' || o_orderkey AS run_ref, o_orderkey AS session_id, CASE WHEN o_orderkey % 3 = 0 THEN 'run:' || (o_orderkey // 3) END AS parent_run_ref,
CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'terminal' WHEN o_orderpriority = '3-MEDIUM' THEN 'web' ELSE 'unknown' END AS harness, CASE WHEN o_orderstatus = 'F' THEN 'subagent' ELSE 'main' END AS role,
CASE WHEN o_orderkey % 5 > 0 THEN 't' || o_orderkey ELSE CAST(o_orderkey AS VARCHAR) END AS title, CASE WHEN o_orderkey % 4 > 0 THEN 'completed' ELSE 'unknown' END AS status FROM orders""")
def session_runs(spark, d):
    return units.runs(_sessions(spark, d), HARNESS)


@query("""SELECT 'context-snapshot:' || session_id || ':' || boundary AS snapshot_ref, session_id, 'run:' || session_id AS run_ref, boundary
FROM (SELECT o_orderkey AS session_id, CASE o_orderstatus WHEN 'F' THEN 'subagent_start' WHEN 'O' THEN 'resume' ELSE 'session_start' END AS boundary FROM orders)""")
def context_snapshots(spark, d):
    return units.context_snapshots(_sessions(spark, d))


@query("""SELECT e.event_id AS action_id, e.user_id AS session_id, CASE WHEN e.event_id % 3 > 0 THEN e.event_id END AS child_id, CASE WHEN e.event_id % 3 = 0 THEN 'unlinked' WHEN o_orderkey IS NULL THEN 'unresolved' ELSE 'resolved' END AS mapping_state, o_totalprice AS cost
FROM events e LEFT JOIN orders ON e.event_id % 3 > 0 AND e.event_id = o_orderkey AND o_orderstatus = 'F' WHERE e.event_type = 'signup'""")
def delegation_facts(spark, d):
    a = actions(spark, d).where("kind = 'signup'").select(F.col("event_id").alias("action_id"), "session_id")
    links = a.where("action_id % 3 > 0").select("action_id", F.col("action_id").alias("child_id"))
    children = sessions(spark, d).where("state = 'F'").select(F.col("session_id").alias("child_id"), "cost")
    return units.delegations(a, links, children).select("action_id", "session_id", "child_id", "mapping_state", "cost")


@query("SELECT event_id FROM events WHERE json_type(props, '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND CAST(json_extract(props, '$.k') AS DOUBLE) >= 50")
def typed_overlay_values(spark, d):
    return read(spark, d, "events").where(units.json_number(F.col("props"), "$.k") >= 50).select("event_id")


@query("""SELECT CASE event_type WHEN 'view' THEN 'file_read' WHEN 'purchase' THEN 'file_edit' WHEN 'signup' THEN 'subagent' WHEN 'error' THEN 'agent' WHEN 'click' THEN CASE WHEN value > 50 THEN 'git' ELSE 'shell' END ELSE 'other' END AS category, count(*) AS n FROM events GROUP BY 1""")
def tool_categories(spark, d):
    names = F.create_map(*[F.lit(x) for pair in {"view": "View", "purchase": "fs__edit_file", "signup": "Task", "error": "TodoWrite", "click": "Bash"}.items() for x in pair])
    command = F.when(F.col("value") > 50, " git status").otherwise("ls")
    return actions(spark, d).select(tools.tool_category(F.try_element_at(names, F.col("kind")), command).alias("category")).groupBy("category").agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT conv_id, arg_max(role, turn) r, arg_max(length(text), turn) n, count(*) FILTER (role = 'system') s, bool_or(length(text) % 5 = 0) e FROM conversations GROUP BY 1)
SELECT conv_id AS session_id, CASE WHEN s > 0 THEN 'tool_left' WHEN r = 'user' THEN 'question_left' WHEN r = 'assistant' AND n % 3 = 0 THEN 'error_left' WHEN r = 'assistant' AND n % 3 = 1 THEN 'truncated' ELSE 'unknown' END AS state FROM l""")
def terminal_states(spark, d):
    size = F.length("text")
    last = messages(spark, d).groupBy("session_id").agg(F.max_by("role", "position").alias("role"), F.max_by(size, "position").alias("n"), F.count_if(F.col("role") == "system").alias("pending"), F.bool_or(size % 5 == 0).alias("error"))
    state = outcomes.terminal_state(F.col("pending"), F.col("role"), F.col("n") % 3 == 0, F.col("error"), F.when(F.col("n") % 3 == 1, "max_tokens"))
    return last.select("session_id", state.alias("state"))


@query("""WITH c AS (SELECT user_id, event_type k, epoch_us(ts) t, lag(event_type) OVER w pk, lag(epoch_us(ts)) OVER w pt, lead(event_type) OVER w nk FROM events WHERE event_type IN ('click', 'error') WINDOW w AS (PARTITION BY user_id, props ORDER BY ts, event_id)),
m AS (SELECT *, CASE WHEN k = 'error' AND pk = 'click' THEN greatest((t - pt) // 1000, 0) END ms, k = 'click' AND nk IS NULL lo, e.last FROM c JOIN (SELECT user_id, max(epoch_us(ts)) AS last FROM events GROUP BY 1) e USING (user_id))
SELECT user_id AS session_id, CAST(coalesce(floor(quantile_cont(ms, 0.5)), 0) AS BIGINT) AS median_ms, CAST(coalesce(quantile_disc(ms, 0.9), 0) AS BIGINT) AS p90_ms, CAST(coalesce(max(ms), 0) AS BIGINT) AS max_ms, count(*) FILTER (lo AND (last - t) // 1000 > 300000) AS stuck FROM m GROUP BY 1""")
def latency_profiles(spark, d):
    a = actions(spark, d)
    ends = a.groupBy("session_id").agg(F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("end_us"))
    calls = outcomes.call_times(a, "session_id", "tool_id", ORDER, "ts", F.col("kind") == "click", F.col("kind") == "error")
    return outcomes.latency_profile(calls, ends, "session_id")


@query("""SELECT o_orderkey AS session_id, round(coalesce(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END, c), 4) AS cost, CASE WHEN o_orderstatus = 'P' THEN 'reported' WHEN c IS NULL THEN 'unpriced' WHEN miss > 0 THEN 'partial' ELSE 'priced' END AS basis
FROM (SELECT l_orderkey, sum(l_quantity * p_size) c, count(*) FILTER (p_size IS NULL) miss FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_partkey % 10 > 3 GROUP BY 1) JOIN orders ON l_orderkey = o_orderkey""")
def session_costs(spark, d):
    usage = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.col("l_partkey").alias("model"), F.col("l_quantity").alias("tokens"))
    prices = read(spark, d, "part").where("p_partkey % 10 > 3").select(F.col("p_partkey").alias("model"), F.col("p_size").alias("price"))
    return outcomes.session_costs(usage, prices, sessions(spark, d).where("state = 'P'").select("session_id", F.col("cost").alias("reported")))


@query("SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS sessions, round(sum(o_totalprice), 2) AS cost FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1")
def daily_costs(spark, d):
    return sessions(spark, d).where("sort_key is not null").groupBy(F.to_date("sort_key").alias("day")).agg(F.count("*").alias("sessions"), F.round(F.sum("cost"), 2).alias("cost"))


@query("SELECT source, count(*) AS items, count(*) FILTER (embedding IS NULL) AS pending, count(DISTINCT len(embedding)) AS dimensions FROM documents LEFT JOIN embeddings ON vec_id = doc_id GROUP BY 1")
def embedding_coverage(spark, d):
    return outcomes.coverage(read(spark, d, "documents").select("doc_id", "source"), read(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id"), "doc_id", "source", "embedding")


@query("""SELECT 'lang' AS field, lang AS value, count(*) FILTER (n_chars > 1000) AS scoped, count(*) AS overall FROM documents GROUP BY 2
UNION ALL SELECT 'source', source, count(*) FILTER (n_chars > 1000), count(*) FROM documents GROUP BY 2""")
def scoped_facets(spark, d):
    return outcomes.scoped_facets(read(spark, d, "documents"), ["lang", "source"], F.col("n_chars") > 1000)


@query("SELECT user_id AS session_id, props AS repo, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS observations FROM events WHERE event_type = 'view' GROUP BY 1, 2")
def repo_observations(spark, d):
    return actions(spark, d).where("kind = 'view'").groupBy("session_id", F.col("tool_id").alias("repo")).agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("observations"))


@query("SELECT event_type AS route, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events WHERE value IS NOT NULL GROUP BY 1")
def route_latency(spark, d):
    timed = actions(spark, d).where("value is not null").select(F.col("kind").alias("route"), "value")
    both = aggregates.with_ranks(timed.groupBy("route").agg(F.count("*").alias("n")), aggregates.linear_ranks(timed, "route", "value", {"p50": 0.5, "p95": 0.95}), "route")
    return both.withColumns({c: F.round(c, 6) for c in ("p50", "p95")})


@query("SELECT source, quality, toxic, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2, 3")
def annotation_join(spark, d):
    return read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left").groupBy("source", "quality", "toxic").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("n_chars"))


@query(f"SELECT vec_id, round(list_sum(list_transform(list_zip(embedding, {SEED}), lambda x: CAST(x[1] AS DOUBLE) * x[2])), 6) AS score FROM embeddings WHERE label IN (1, 2) ORDER BY score DESC, vec_id LIMIT 10")
def knn_filtered(spark, d):
    return search.nearest(read(spark, d, "embeddings").where(F.col("label").isin(1, 2)), SEED, 10)


@query(f"SELECT doc_id, score FROM {BM25} SEMI JOIN (SELECT doc_id FROM documents WHERE lang = 'en' AND source IN ('src0', 'src1')) USING (doc_id) ORDER BY score DESC, doc_id LIMIT 20")
def bm25_of_kind(spark, d):
    docs = read(spark, d, "documents")
    of_kind = docs.where((F.col("lang") == "en") & F.col("source").isin("src0", "src1")).select("doc_id")
    return search.bm25(docs, "doc_id", "text", ["license", "version"]).join(of_kind, "doc_id", "left_semi").orderBy(F.desc("score"), "doc_id").limit(20)


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'icens')")
def substring_search(spark, d):
    return read(spark, d, "documents").where(F.contains(F.lower("text"), F.lit("icens"))).select("doc_id")


@query("""SELECT o.o_orderkey AS src, o.o_orderkey * 3 AS dst, CASE o.o_orderstatus WHEN 'F' THEN 'subagent' WHEN 'O' THEN 'fork' ELSE 'unknown' END AS kind, CASE WHEN p.o_orderkey IS NULL THEN 'unresolved' ELSE 'resolved' END AS state
FROM orders o LEFT JOIN orders p ON p.o_orderkey = o.o_orderkey * 3""")
def session_topology(spark, d):
    s = sessions(spark, d)
    links = s.select(F.col("session_id").alias("src"), (F.col("session_id") * 3).alias("dst"), F.when(F.col("state") == "F", "subagent").when(F.col("state") == "O", "fork").alias("branch"))
    return graph.topology(links, s.select(F.col("session_id").alias("node")))


@query("""WITH RECURSIVE e AS (SELECT p_partkey a, p_partkey // 2 b FROM part WHERE p_partkey >= 2 UNION SELECT p_partkey, p_partkey * 2 FROM part WHERE p_partkey % 10 = 4 AND p_partkey * 2 IN (SELECT p_partkey FROM part)),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), c AS (SELECT DISTINCT a n FROM r WHERE a = b)
SELECT a, b FROM e WHERE (a IN (SELECT n FROM c) OR a IN (SELECT r.b FROM r JOIN c ON r.a = c.n)) AND (b IN (SELECT n FROM c) OR b IN (SELECT r.a FROM r JOIN c ON r.b = c.n))""")
def definition_cycles(spark, d):
    """Each part stands on the one of half its number; every tenth on that of twice its number as well, which closes cycles."""
    k = read(spark, d, "part").select(F.col("p_partkey").alias("a"))
    up = k.where("a >= 2").select("a", F.floor(F.col("a") / 2).alias("b"))
    down = k.where("a % 10 = 4").select("a", (F.col("a") * 2).alias("b")).join(k.withColumnRenamed("a", "b"), "b", "left_semi").select("a", "b")
    edges = up.union(down)
    return graph.cyclic_core(edges)


_TOOL_BLOCKS = """b AS (SELECT user_id, CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_id % 10 = 1 THEN '' ELSE props END AS tool, event_type = 'click' AS call FROM events WHERE event_type IN ('click', 'error') AND user_id % 5 > 0),
k AS (SELECT user_id, nullif(tool, '') AS tool, count(*) FILTER (call) AS u, count(*) FILTER (NOT call) AS r FROM b GROUP BY 1, 2)"""


def _tool_blocks(spark, d):
    """Clicks as calls and errors as results; every fifth user has no tools, and a fifth of the rows no identity."""
    n = F.col("event_id") % 10
    rows = actions(spark, d).where("kind in ('click', 'error') and session_id % 5 > 0")
    return rows.select("session_id", F.when(n == 0, F.lit(None)).when(n == 1, "").otherwise(F.col("tool_id")).alias("tool_id"), F.when(F.col("kind") == "click", "tool_use").otherwise("tool_result").alias("kind"))


@query(f"""WITH {_TOOL_BLOCKS} SELECT CAST(sum(least(u, r)) FILTER (tool IS NOT NULL) AS BIGINT) AS paired, CAST(sum(greatest(u - r, 0)) FILTER (tool IS NOT NULL) AS BIGINT) AS missing_results, CAST(sum(greatest(r - u, 0)) FILTER (tool IS NOT NULL) AS BIGINT) AS orphan_results,
CAST(sum(greatest(u - 1, 0)) FILTER (tool IS NOT NULL) AS BIGINT) AS duplicate_calls, CAST(sum(greatest(r - 1, 0)) FILTER (tool IS NOT NULL) AS BIGINT) AS duplicate_results, CAST(sum(u) FILTER (tool IS NULL) AS BIGINT) AS unknown_uses, CAST(sum(r) FILTER (tool IS NULL) AS BIGINT) AS unknown_results FROM k""")
def tool_pairing_totals(spark, d):
    return outcomes.pairing_totals(_tool_blocks(spark, d))


@query(f"""WITH {_TOOL_BLOCKS}, s AS (SELECT DISTINCT user_id FROM events), p AS (SELECT s.user_id, coalesce(sum(u), 0) AS u, coalesce(sum(r), 0) AS r FROM s LEFT JOIN k USING (user_id) GROUP BY 1),
v AS (SELECT 'uses' AS measure, u AS value FROM p UNION ALL SELECT 'results', r FROM p UNION ALL SELECT 'records_per_identity', u + r FROM k WHERE tool IS NOT NULL) SELECT measure, CAST(value AS BIGINT) AS value, count(*) AS n FROM v GROUP BY 1, 2""")
def tool_use_distributions(spark, d):
    return outcomes.tool_distributions(_tool_blocks(spark, d), actions(spark, d))


@query("SELECT o_orderpriority AS origin, count(*) AS sessions, count(o_orderdate) AS dated, CAST(min(o_orderdate) AS DATE) AS first_date, CAST(max(o_orderdate) AS DATE) AS last_date, count(*) FILTER (o_orderkey % 9 <= 2) AS truncated, CAST(sum(o_orderkey % 9) AS BIGINT) AS messages FROM orders GROUP BY 1")
def archive_coverage(spark, d):
    return outcomes.archive_coverage(sessions(spark, d).select("origin", F.col("sort_key").alias("at"), (F.col("session_id") % 9).alias("messages")))[0]


@query("""WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events WHERE day(ts) % 7 NOT IN (3, 4)), n AS (SELECT day, lead(day) OVER (ORDER BY day) AS next FROM d)
SELECT CAST(day + 1 AS DATE) AS start_date, CAST(next - 1 AS DATE) AS end_date, CAST(next - day - 1 AS INTEGER) AS days FROM n WHERE next - day > 1""")
def archive_gaps(spark, d):
    rows = actions(spark, d).where(~(F.day("ts") % 7).isin(3, 4))
    return outcomes.archive_coverage(rows.select(F.col("kind").alias("origin"), F.col("ts").alias("at"), F.lit(1).alias("messages")))[1]


_SEED = "please tell the people how this nation-wide license and the version of that public work could be used"


@query(f"""WITH t AS (SELECT doc_id, list_filter(list_distinct(regexp_extract_all(lower(text), '{search.TOKEN}')), lambda x: NOT list_contains({search.STOP_WORDS}, x)) AS a, list_filter(list_distinct(regexp_extract_all('{_SEED}', '{search.TOKEN}')), lambda x: NOT list_contains({search.STOP_WORDS}, x)) AS b FROM documents)
SELECT doc_id, round(len(list_intersect(a, b)) / sqrt(len(a) * len(b)), 6) AS score FROM t WHERE len(a) > 0 AND round(len(list_intersect(a, b)) / sqrt(len(a) * len(b)), 6) >= 0.05""")
def token_similarity(spark, d):
    return search.token_similarity(read(spark, d, "documents"), "doc_id", "text", _SEED, 0.05)
