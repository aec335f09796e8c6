"""Queries of lineage, links between items, and JSON structure."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.operators import graph, structure, windows
from threadloom.plans.registry import query
from threadloom.streaming import incremental
from threadloom.tables import actions, messages, read, sessions


def _forest(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("node"))
    return c.withColumn("parent", F.when((F.col("node") % 7 == 0) | (F.col("node") < 2), None).otherwise(F.floor(F.col("node") / 2)))


TREE = """WITH RECURSIVE w AS (SELECT c_custkey node, c_custkey root, 0 depth FROM customer WHERE c_custkey % 7 = 0 OR c_custkey < 2
UNION ALL SELECT c.c_custkey, w.root, w.depth + 1 FROM customer c JOIN w ON c.c_custkey // 2 = w.node WHERE NOT (c.c_custkey % 7 = 0 OR c.c_custkey < 2)) """


@query(TREE + "SELECT node, depth FROM w WHERE root = 7 AND node <> 7")
def lineage_descendants(spark, d):
    return graph.descendants(_forest(spark, d), 7)


@query(TREE + "SELECT root, count(*) AS members, max(depth) AS depth, round(sum(c), 2) AS cost FROM w LEFT JOIN (SELECT o_custkey, sum(o_totalprice) c FROM orders GROUP BY 1) ON o_custkey = node GROUP BY 1")
def thread_summary(spark, d):
    cost = sessions(spark, d).groupBy(F.col("project").alias("node")).agg(F.sum("cost").alias("c"))
    return graph.roots(_forest(spark, d)).join(cost, "node", "left").groupBy("root").agg(F.count("*").alias("members"), F.max("depth").alias("depth"), F.round(F.sum("c"), 2).alias("cost"))


@query(TREE + "SELECT node, root AS component FROM w WHERE EXISTS (SELECT 1 FROM w x WHERE x.root = w.root AND x.node <> w.node)")
def components(spark, d):
    return graph.components(_forest(spark, d).where("parent is not null").select(F.col("node").alias("a"), F.col("parent").alias("b")))


@query("""WITH RECURSIVE s AS (SELECT DISTINCT conv_id FROM conversations), w AS (SELECT conv_id AS node, conv_id AS anc, CAST(NULL AS BIGINT) lim FROM s
UNION ALL SELECT node, anc // 2, least(coalesce(lim, 1), 1) FROM w WHERE anc >= 2)
SELECT w.node AS session_id, w.anc AS from_session, c.turn AS position, c.role FROM w JOIN conversations c ON c.conv_id = w.anc WHERE w.lim IS NULL OR c.turn <= w.lim""")
def composed_transcripts(spark, d):
    m = messages(spark, d)
    seen = m.select("session_id").distinct()
    ids = seen.select(F.explode(F.expr("array_union(array(session_id), filter(transform(sequence(0, 62), k -> shiftright(session_id, k)), x -> x > 0))")).alias("node")).distinct()
    edges = ids.select("node", F.when(F.col("node") >= 2, F.floor(F.col("node") / 2)).alias("parent"), F.lit(1).cast("long").alias("branch"))
    return graph.composed(m.select("session_id", "position", "role"), edges).join(seen, "session_id", "left_semi").select("session_id", "from_session", "position", "role")


def _links(spark, d):
    return windows.transitions(actions(spark, d), "session_id", ["ts", "event_id"], "kind").where("source <> target").select(F.col("source").alias("a"), F.col("target").alias("b"))


_LINKS = "l AS (SELECT DISTINCT a, b FROM (SELECT event_type a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) b FROM events) WHERE b IS NOT NULL AND a <> b)"


@query(f"WITH {_LINKS} SELECT node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM (SELECT a node, 0 i, 1 o FROM l UNION ALL SELECT b, 1, 0 FROM l) GROUP BY 1")
def link_degrees(spark, d):
    return graph.degrees(_links(spark, d))


@query(f"WITH {_LINKS} SELECT a, b FROM l WHERE a = 'error' OR b = 'error'")
def one_hop(spark, d):
    return graph.one_hop(_links(spark, d), spark.createDataFrame([("error",)], "node string"))


@query(f"""WITH RECURSIVE {_LINKS}, p AS (SELECT [a, b] AS path FROM l WHERE b > a UNION ALL SELECT list_append(path, b) FROM p JOIN l ON l.a = path[-1] WHERE len(path) < 5 AND b > path[1] AND NOT list_contains(path, b))
SELECT DISTINCT array_to_string(list_sort(path), ',') AS members FROM p JOIN l ON l.a = path[-1] AND l.b = path[1]""")
def simple_cycles(spark, d):
    return graph.simple_cycles(_links(spark, d)).select(F.array_join("members", ",").alias("members"))


@query("""WITH f AS (SELECT user_id, event_type, min(event_id) k FROM events GROUP BY 1, 2) SELECT a.event_type AS winner, b.event_type AS loser, count(*) AS n FROM f a JOIN f b ON a.user_id=b.user_id AND a.k < b.k GROUP BY 1, 2""")
def pairwise_orders(spark, d):
    firsts = actions(spark, d).groupBy("session_id", "kind").agg(F.min("event_id").alias("k"))
    return graph.pairwise(firsts, "session_id", "kind", "k").groupBy("winner", "loser").agg(F.count("*").alias("n"))


@query("SELECT '$.k' AS path, count(*) AS n, count(DISTINCT event_id) AS records, count(*) FILTER (v IS NULL) AS nulls, count(DISTINCT v) AS distinct_values, min(length(v)) AS shortest, max(length(v)) AS longest FROM (SELECT event_id, json_extract_string(props, '$.k') v FROM events)")
def json_path_stats(spark, d):
    return structure.path_stats(structure.flattened(read(spark, d, "events"), "event_id", "props", depth=1), "event_id")


@query("SELECT event_type AS kind, CASE WHEN value > 0 THEN CAST(floor(ln(value)/ln(1.1) + 1e-9) AS BIGINT) END AS bucket, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1, 2")
def log_buckets(spark, d):
    return structure.log_buckets(actions(spark, d), "kind", "value")


_BASE = """b AS (SELECT e.event_type AS kind, w.day + 7 AS ended, count(*) n, round(avg(value), 6) m, round(stddev_pop(value), 6) s FROM events e JOIN (SELECT DISTINCT unnest(generate_series(CAST(ts AS DATE) - INTERVAL 6 DAY, CAST(ts AS DATE), INTERVAL 1 DAY))::DATE AS day FROM events) w
ON CAST(e.ts AS DATE) BETWEEN w.day AND w.day + 6 GROUP BY 1, 2)"""


@query(f"WITH {_BASE} SELECT event_id FROM events JOIN b ON kind = event_type AND ended = CAST(ts AS DATE) WHERE n >= 10 AND value > m + 2.0 * s")
def lag_anomalies(spark, d):
    a = actions(spark, d)
    return incremental.anomalies(a, incremental.lag_baseline(a, "kind", "value"), "kind", "value", 2.0).select("event_id")
