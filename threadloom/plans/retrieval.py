"""Queries of search: phrases, snippets, seeded neighbours, lanes and similarity of sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions import scalars
from threadloom.operators import index as grams
from threadloom.operators import search
from threadloom.plans.queries import BM25, TERMS
from threadloom.plans.registry import query
from threadloom.scratch import folder
from threadloom.tables import messages, read, sessions


@query(r"SELECT doc_id FROM documents WHERE regexp_matches(strip_accents(lower(text)), '(^|[^\p{L}\p{N}])all[^\p{L}\p{N}]+rights[^\p{L}\p{N}]+reserv')")
def phrase_prefix_match(spark, d):
    return read(spark, d, "documents").where(search.phrase(F.col("text"), ["all", "rights", "reserv"], prefix=True)).select("doc_id")


@query(r"""SELECT doc_id, regexp_replace(regexp_extract(strip_accents(lower(text)), '(?:[\p{L}\p{N}]+[^\p{L}\p{N}]+){0,6}\blicense\b(?:[^\p{L}\p{N}]+[\p{L}\p{N}]+){0,17}', 0), '\blicense\b', '[license]', 'g') AS snippet
FROM documents WHERE contains(lower(text), 'license')""")
def snippets(spark, d):
    hits = read(spark, d, "documents").where(F.contains(F.lower("text"), F.lit("license")))
    return hits.select("doc_id", search.snippet(F.col("text"), "license").alias("snippet"))


def _index(spark, d):
    return search.kept_index(read(spark, d, "documents"), "doc_id", "text")


@query(f"SELECT doc_id, score FROM {BM25} ORDER BY score DESC, doc_id LIMIT 20")
def bm25_from_index(spark, d):
    found = search.search_index(_index(spark, d), ["License", "version"])
    return found.select(F.col("doc").alias("doc_id"), "score").orderBy(F.desc("score"), "doc_id").limit(20)


@query(f"WITH t AS (SELECT doc_id, {TERMS} w FROM documents) SELECT doc_id FROM t WHERE list_contains(w, 'license') AND (list_contains(w, 'version') OR list_contains(w, 'public')) AND NOT list_contains(w, 'mit')")
def boolean_terms(spark, d):
    return search.boolean(_index(spark, d), ["LICENSE"], ["version", "Public"], ["MIT"]).select(F.col("doc").alias("doc_id"))


@query(f"WITH t AS (SELECT doc_id, {TERMS} w FROM documents) SELECT doc_id FROM t WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' general public license ')")
def phrase_from_index(spark, d):
    return search.phrase_in_index(_index(spark, d), ["General", "Public License"]).select(F.col("doc").alias("doc_id"))


@query(f"""WITH now AS (SELECT doc_id, text FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, text || ' license' FROM documents WHERE doc_id % 3 = 0 AND doc_id % 2 = 0), t AS (SELECT doc_id, {TERMS} w FROM now),
c AS (SELECT doc_id, len(w) dl, len(list_filter(w, lambda x: x='license')) a FROM t), s AS (SELECT count(*) n, avg(dl) av, count(*) FILTER (a>0) da FROM c)
SELECT doc_id, round(ln(1+(n-da+0.5)/(da+0.5))*a*2.2/(a+1.2*(0.25+0.75*dl/av)), 6) AS score FROM c, s WHERE a > 0""")
def bm25_after_changes(spark, d):
    """All documents indexed, then in three batches a third of them changed or deleted, and the segments merged."""
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text", F.lit(False).alias("deleted"))
    index = search.write_index(docs, "doc", "text", f"{folder(spark, 'index')}/changed")
    third = docs.where("doc % 3 = 0")
    index.apply(third.withColumn("text", F.lit("license license")))
    index.apply(third.where("doc % 2 = 1").withColumn("deleted", F.lit(True)))
    index.apply(third.where("doc % 2 = 0").withColumn("text", F.concat("text", F.lit(" license"))))
    index.merge(like=2)
    return search.search_index(index, ["license"]).withColumnRenamed("doc", "doc_id")


@query("SELECT CAST(doc_id AS BIGINT) AS doc, CASE WHEN doc_id % 7 = 0 THEN 'missing' WHEN doc_id % 5 = 0 THEN 'stale' END AS state FROM documents WHERE doc_id % 7 = 0 OR doc_id % 5 = 0")
def index_drift(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")
    old = docs.where("doc % 7 <> 0").withColumn("text", F.when(F.col("doc") % 5 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")))
    return search.write_index(old, "doc", "text", f"{folder(spark, 'index')}/drifted").drift(docs)


@query("SELECT doc_id AS doc, length(text) AS chars FROM documents WHERE contains(text, 'rights reserved')")
def substring_by_grams(spark, d):
    path = f"{folder(spark, 'grams')}/documents"
    grams.write_grams(read(spark, d, "documents"), "doc_id", "text", path)
    return grams.containing(spark, path, "rights reserved").select("doc", F.length("text").cast("long").alias("chars"))


@query(f"""WITH t AS (SELECT conv_id, turn, {TERMS} w FROM conversations), c AS (SELECT conv_id, turn, len(w) dl, len(list_filter(w, lambda x: x='the')) a, len(list_filter(w, lambda x: x='que')) b FROM t),
s AS (SELECT count(*) n, avg(dl) av, count(*) FILTER (a>0) da, count(*) FILTER (b>0) db FROM c),
h AS (SELECT conv_id, turn, round(ln(1+(n-da+0.5)/(da+0.5))*a*2.2/(a+1.2*(0.25+0.75*dl/av)) + ln(1+(n-db+0.5)/(db+0.5))*b*2.2/(b+1.2*(0.25+0.75*dl/av)), 6) AS score FROM c, s WHERE a>0 OR b>0)
SELECT conv_id AS session_id, turn AS position, score FROM h QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn DESC) = 1""")
def bm25_best_per_session(spark, d):
    return search.best_blocks(messages(spark, d).withColumn("block", F.concat_ws("-", "session_id", "position")), "session_id", "block", "text", "position", ["the", "que"]).select("session_id", "position", "score")


@query("""WITH s AS (SELECT conv_id, CASE WHEN contains(lower(text), 'and the') THEN 22 ELSE 0 END + CASE WHEN contains(lower(text), 'and') THEN 4 ELSE 0 END + CASE WHEN contains(lower(text), 'the') THEN 4 ELSE 0 END s FROM conversations)
SELECT conv_id AS session_id, CAST(max(s) + least(count(*)-1, 5) AS BIGINT) AS score FROM s WHERE s > 0 GROUP BY 1""")
def plain_scores(spark, d):
    return search.plain_score(messages(spark, d), "session_id", "text", "and the")


@query("""SELECT a.vec_id, round(min(sqrt(list_sum(list_transform(list_zip(a.embedding, s.embedding), lambda x: (CAST(x[1] AS DOUBLE) - x[2]) * (CAST(x[1] AS DOUBLE) - x[2]))))), 6) AS distance
FROM embeddings a, (SELECT embedding FROM embeddings WHERE label=3) s WHERE a.label IS DISTINCT FROM 3 GROUP BY 1 ORDER BY distance, a.vec_id LIMIT 20""")
def knn_session_seed(spark, d):
    v = read(spark, d, "embeddings").select("vec_id", "embedding", F.when(F.col("label") == 3, "seed").otherwise("other").alias("session"))
    return search.nearest_to_seeds(v, "session", "seed", 20)


@query("SELECT content, count(*) AS refs, min(conv_id) AS first_session FROM (SELECT sha256(text) AS content, conv_id FROM conversations WHERE length(text) >= 20 AND role <> 'system') GROUP BY 1")
def embeddable_content(spark, d):
    return search.embeddable(messages(spark, d))


@query(f"""WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) r FROM {BM25} QUALIFY r <= 30), b AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) r FROM documents QUALIFY r <= 30)
SELECT doc_id, round(coalesce(1/(60+a.r), 0) + coalesce(1/(60+b.r), 0), 8) AS score, a.r AS text_rank, b.r AS length_rank FROM a FULL JOIN b USING (doc_id)""")
def hybrid_lanes(spark, d):
    docs = read(spark, d, "documents")
    by_text = search.ranked(search.bm25(docs, "doc_id", "text", ["license", "version"]), "score", "doc_id", 30)
    return search.lanes({"text": by_text, "length": search.ranked(docs.select("doc_id", "n_chars"), "n_chars", "doc_id", 30)}, "doc_id")


_ONE = "(SELECT * FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders)) r"


@query(f"""SELECT session_id, score FROM (SELECT o.o_orderkey AS session_id, o.o_orderdate t, round(CASE WHEN o.o_custkey=r.o_custkey THEN 3.0::DOUBLE ELSE 0 END + CASE WHEN abs(epoch_us(o.o_orderdate)-epoch_us(r.o_orderdate))/3600000000 <= 720
THEN 1.5::DOUBLE * greatest(1 - abs(epoch_us(o.o_orderdate)-epoch_us(r.o_orderdate))/3600000000/720, 0.1::DOUBLE) ELSE 0 END, 6) AS score FROM orders o, {_ONE} WHERE o.o_orderkey <> r.o_orderkey) WHERE score > 0 ORDER BY score DESC, t DESC, session_id LIMIT 15""")
def session_neighbours(spark, d):
    s = sessions(spark, d).withColumn("title", F.col("project").cast("string"))
    return search.neighbours(s, s.agg(F.min("session_id")).first()[0], 15, 720)


@query(f"""SELECT session_id, score FROM (SELECT o.o_orderkey AS session_id, CAST(CASE WHEN o.o_orderstatus=r.o_orderstatus THEN 3 ELSE 0 END + CASE WHEN o.o_orderpriority=r.o_orderpriority THEN 1 ELSE 0 END
+ CASE WHEN abs(CAST(o.o_orderdate AS DATE) - CAST(r.o_orderdate AS DATE)) <= 3 THEN 2 WHEN abs(CAST(o.o_orderdate AS DATE) - CAST(r.o_orderdate AS DATE)) <= 14 THEN 1 ELSE 0 END AS BIGINT) AS score FROM orders o, {_ONE} WHERE o.o_orderkey <> r.o_orderkey) WHERE score > 0 ORDER BY score DESC, session_id LIMIT 15""")
def metadata_similarity(spark, d):
    s = sessions(spark, d)
    return search.metadata_similarity(s, s.agg(F.min("session_id")).first()[0], 15)


@query("SELECT role, CASE WHEN regexp_matches(text, '^https?://') THEN 'url' WHEN regexp_matches(text, '^-?[0-9]+$') THEN 'integer' ELSE 'text' END AS format, count(*) AS n FROM (SELECT role, text FROM conversations UNION ALL SELECT 'page', url FROM pages UNION ALL SELECT 'key', CAST(page_id AS VARCHAR) FROM pages) GROUP BY 1, 2")
def value_formats(spark, d):
    p = read(spark, d, "pages")
    rows = messages(spark, d).select("role", "text").union(p.select(F.lit("page"), "url")).union(p.select(F.lit("key"), F.col("page_id").cast("string")))
    return rows.groupBy("role", scalars.value_format(F.col("text")).alias("format")).agg(F.count("*").alias("n"))
