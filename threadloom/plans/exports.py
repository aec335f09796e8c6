"""Queries of exports, ingest by content, blocks and attached rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.operators import units
from threadloom.plans.registry import query
from threadloom.scratch import folder
from threadloom.sources import exports, packed
from threadloom.tables import messages, read

#: In which provider's shape a conversation is written, by its id's remainder.
SHAPES = ["gemini", "grok", "gemini_cli", "hermes", "browser_capture", "claude_web", "chatgpt", "claude_code", "codex", "beads"]


def documents(spark, d):
    """The conversations as exports: a document each, or a record each for the last three shapes."""
    m = read(spark, d, "conversations").withColumn("_id", F.col("conv_id").cast("string")).withColumn("_n", F.col("conv_id") % len(SHAPES))
    turns = m.groupBy("conv_id", "_id", "_n").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    each = lambda **f: F.transform("t", lambda t: F.struct(*[v(t).cast("string").alias(k) for k, v in f.items()]))
    who, said, at = (lambda t: t["role"]), (lambda t: t["text"]), (lambda t: t["turn"])
    node = F.map_from_entries(F.transform("t", lambda t: F.struct(F.concat(F.lit("n"), t["turn"].cast("string")).alias("key"), F.struct(F.lit(None).cast("string").alias("parent"), F.struct(F.struct(t["role"].alias("role")).alias("author"), F.struct(F.array(t["text"]).alias("parts")).alias("content"), t["turn"].cast("double").alias("create_time")).alias("message")).alias("value"))))
    whole = {
        "gemini": F.struct(F.struct(each(role=who, text=said, id=at).alias("chunks")).alias("chunkedPrompt"), F.lit("2024-01-01").alias("createTime")),
        "grok": F.struct(F.array(F.struct(F.struct(F.lit("t").alias("title")).alias("conversation"), each(sender=who, message=said, create_time=at).alias("responses"))).alias("conversations")),
        "gemini_cli": F.struct(F.col("_id").alias("sessionId"), F.lit("2024").alias("startTime"), each(id=at, type=who, content=said).alias("messages")),
        "hermes": F.struct(F.col("_id").alias("session_id"), F.lit("2024").alias("session_start"), each(id=at, role=who, content=said).alias("messages")),
        "browser_capture": F.struct(F.struct(F.col("_id").alias("provider_session_id"), each(provider_turn_id=at, role=who, text=said).alias("turns")).alias("session")),
        "claude_web": F.struct(F.col("_id").alias("uuid"), each(uuid=at, sender=who, text=said).alias("chat_messages")),
        "chatgpt": F.struct(F.col("_id").alias("conversation_id"), node.alias("mapping")),
    }
    payload = F.when(F.lit(False), "")
    for n, shape in enumerate(SHAPES):
        if shape in whole:
            payload = payload.when(F.col("_n") == n, F.to_json(whole[shape]))
    docs = turns.where(F.col("_n") < len(whole)).select("_id", payload.alias("payload"))
    stamp = F.concat(F.lit("2024-01-"), F.lpad((F.col("turn") + 1).cast("string"), 2, "0"))
    record = F.when(F.col("_n") == 7, F.to_json(F.struct(F.col("_id").alias("sessionId"), F.col("turn").cast("string").alias("uuid"), stamp.alias("timestamp"), F.struct("role", F.array(F.struct(F.lit("text").alias("type"), "text")).alias("content")).alias("message"))))
    record = record.when(F.col("_n") == 8, F.to_json(F.struct(F.lit("response_item").alias("type"), stamp.alias("timestamp"), F.struct(F.lit("message").alias("type"), "role", F.array(F.struct("text")).alias("content")).alias("payload"))))
    record = record.otherwise(F.to_json(F.struct(F.col("_id").alias("issue_id"), F.col("turn").cast("string").alias("id"), F.lit("state_change").alias("kind"), stamp.alias("created_at"), F.col("role").alias("actor"), F.struct(F.lit("status").alias("field"), F.lit("open").alias("old_value"), F.lit(3).alias("new_value")).alias("extra"))))
    lines = m.where(F.col("_n") >= len(whole)).select("_id", record.alias("payload"))
    return docs.unionByName(lines).select(F.col("_id").alias("path"), "payload")


_SHAPE = f"{SHAPES}[conv_id % {len(SHAPES)} + 1]"


@query(f"""SELECT {_SHAPE} AS provider, CAST(conv_id AS VARCHAR) || CASE WHEN {_SHAPE} = 'grok' THEN '#0' ELSE '' END AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position,
CASE {_SHAPE} WHEN 'beads' THEN 'user' ELSE role END AS role, CASE {_SHAPE} WHEN 'beads' THEN 'Beads ' || conv_id || ' ' || turn || ': ' || role || ' changed status from "open" to 3.' ELSE text END AS text FROM conversations""")
def export_messages(spark, d):
    return exports.messages(documents(spark, d)).select("provider", "session_id", "position", "role", "text")


@query(f"SELECT {_SHAPE} AS provider, count(DISTINCT conv_id) AS sessions, count(*) AS messages FROM conversations GROUP BY 1")
def export_sessions(spark, d):
    return exports.sessions(exports.messages(documents(spark, d))).groupBy("provider").agg(F.count("*").alias("sessions"), F.sum("messages").alias("messages"))


@query("SELECT CAST(conv_id AS VARCHAR) AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position, role, text FROM conversations WHERE text <> ''")
def packed_messages(spark, d):
    """Files of conversations, read back in slices of 64 kB, a document of more than 4 kB in parts."""
    turn = F.struct("turn", F.col("role").alias("sender"), "text")
    docs = read(spark, d, "conversations").groupBy(F.col("conv_id").cast("string").alias("uuid")).agg(F.array_sort(F.collect_list(turn)).alias("chat_messages"))
    path = f"{folder(spark, 'exports')}/files"
    docs.write.json(path)
    return exports.messages(packed.read(spark, path, 1 << 16, 1 << 12).where("state = 'ok'")).select("session_id", "position", "role", "text")


#: In which provider's shape a user's calls are written, by the id's remainder.
CALLERS = ["claude_code", "codex", "hermes"]


def calls(spark, d):
    """Clicks as calls and errors as results, as exports: records of a line each, or a document for each user."""
    e = read(spark, d, "events").where("event_type in ('click', 'error')")
    click, at, user = F.col("event_type") == "click", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.col("user_id").cast("string")
    part = F.when(click, F.struct(F.lit("tool_use").alias("type"), F.col("props").alias("id"), F.col("event_type").alias("name"), F.struct("value").alias("input"), *[F.lit(None).cast(t).alias(c) for c, t in (("tool_use_id", "string"), ("content", "string"), ("is_error", "boolean"))]))
    part = part.otherwise(F.struct(F.lit("tool_result").alias("type"), *[F.lit(None).cast("string").alias(c) for c in ("id", "name")], F.lit(None).cast("struct<value:double>").alias("input"), F.col("props").alias("tool_use_id"), F.lit("out").alias("content"), F.lit(True).alias("is_error")))
    code = F.struct(user.alias("sessionId"), F.col("event_id").cast("string").alias("uuid"), at.alias("timestamp"), F.struct(F.when(click, "assistant").otherwise("user").alias("role"), F.array(part).alias("content")).alias("message"))
    output = F.to_json(F.struct(F.lit("out").alias("output"), F.struct((F.col("event_id") % 2).alias("exit_code")).alias("metadata")))
    payload = F.struct(F.when(click, "function_call").otherwise("function_call_output").alias("type"), F.col("props").alias("call_id"), F.when(click, F.col("event_type")).alias("name"), F.when(click, "{}").alias("arguments"), F.when(~click, output).alias("output"))
    codex = F.struct(F.lit("response_item").alias("type"), at.alias("timestamp"), payload.alias("payload"))
    lines = e.where("user_id % 3 < 2").select(user.alias("path"), F.when(F.col("user_id") % 3 == 0, F.to_json(code)).otherwise(F.to_json(codex)).alias("payload"))
    call = F.array(F.struct(F.col("props").alias("id"), F.struct(F.col("event_type").alias("name"), F.lit("{}").alias("arguments")).alias("function")))
    turn = F.struct("ts", F.when(click, "assistant").otherwise("tool").alias("role"), F.when(click, call).alias("tool_calls"), F.when(~click, F.col("props")).alias("tool_call_id"), F.when(~click, "out").alias("content"))
    whole = e.where("user_id % 3 = 2").groupBy("user_id").agg(F.array_sort(F.collect_list(turn)).alias("messages"))
    docs = whole.select(user.alias("path"), F.to_json(F.struct(user.alias("session_id"), F.lit("cli").alias("platform"), "messages")).alias("payload"))
    return lines.union(docs)


_CALLS = f"""e AS (SELECT *, {CALLERS}[user_id % 3 + 1] AS provider, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS position FROM events WHERE event_type IN ('click', 'error'))"""


@query(f"""WITH {_CALLS}, u AS (SELECT *, row_number() OVER (PARTITION BY user_id, props ORDER BY ts) AS r FROM e WHERE event_type = 'click'), x AS (SELECT *, row_number() OVER (PARTITION BY user_id, props ORDER BY ts) AS r FROM e WHERE event_type = 'error')
SELECT u.provider, CAST(u.user_id AS VARCHAR) AS session_id, u.position, u.props AS tool_id, x.position AS result_position,
CASE WHEN x.r IS NULL THEN 'no_result' WHEN u.provider = 'hermes' THEN 'outcome_unknown' WHEN u.provider = 'claude_code' OR x.event_id % 2 = 1 THEN 'outcome_error' ELSE 'outcome_success' END AS state FROM u LEFT JOIN x ON x.user_id = u.user_id AND x.props = u.props AND x.r = u.r""")
def export_actions(spark, d):
    return exports.actions(exports.blocks(calls(spark, d))).select("provider", "session_id", "position", "tool_id", "result_position", "state")


@query(f"WITH {_CALLS} SELECT provider, CASE event_type WHEN 'click' THEN 'tool_use' ELSE 'tool_result' END AS kind, count(*) AS n, count(DISTINCT user_id) AS sessions FROM e GROUP BY 1, 2")
def export_blocks(spark, d):
    return exports.blocks(calls(spark, d)).groupBy("provider", "kind").agg(F.count("*").alias("n"), F.countDistinct("session_id").alias("sessions"))


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN 'inserted' WHEN doc_id % 3 = 0 THEN 'kept' WHEN doc_id % 5 = 0 THEN 'replaced' ELSE 'same' END AS change, CASE WHEN doc_id % 2 = 0 AND doc_id % 3 = 0 AND doc_id % 5 = 0 THEN 'old' ELSE text END AS text, CASE WHEN doc_id % 2 = 0 THEN 'mine' END AS note
FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 <> 0""")
def content_upsert(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "text", "lang")
    before = docs.where("doc_id % 2 = 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.col("text")))
    known = before.withColumn("note", F.lit("mine")).withColumn("content_hash", exports.content_hash(["text", "lang"]))
    return exports.upsert(known, docs.where("doc_id % 3 <> 0"), ["doc_id"], ["text", "lang"]).select("doc_id", "change", "text", "note")


def _fenced(spark, d):
    return messages(spark, d).withColumn("text", F.concat("text", F.lit("\n```sql\nselect "), F.col("position").cast("string"), F.lit("\n```\nend")))


_FENCED = """b AS (SELECT conv_id, turn, 0 AS block, role, 'text' AS kind, NULL AS language, text || chr(10) AS text FROM conversations WHERE role <> 'tool' UNION ALL SELECT conv_id, turn, 1, role, 'code', 'sql', 'select ' || turn || chr(10) FROM conversations WHERE role <> 'tool'
UNION ALL SELECT conv_id, turn, 2, role, 'text', NULL, chr(10) || 'end' FROM conversations WHERE role <> 'tool' UNION ALL SELECT conv_id, turn, 0, role, 'tool_result', NULL, text || chr(10) || '```sql' || chr(10) || 'select ' || turn || chr(10) || '```' || chr(10) || 'end' FROM conversations WHERE role = 'tool')"""


@query(f"WITH {_FENCED} SELECT conv_id AS session_id, turn AS position, block, role, kind, language, text FROM b WHERE regexp_matches(text, '[^ \\t\\n\\r]')")
def message_blocks(spark, d):
    return units.blocks(_fenced(spark, d))


@query(f"WITH {_FENCED} SELECT conv_id AS session_id, turn AS position, coalesce(string_agg(text, chr(10) ORDER BY block) FILTER (kind = 'text'), '') AS text, count(*) FILTER (kind <> 'text') AS omitted FROM b WHERE regexp_matches(text, '[^ \\t\\n\\r]') GROUP BY 1, 2")
def prose_projection(spark, d):
    return units.projected(units.blocks(_fenced(spark, d)), ["text"])


@query("""WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) r, count(*) OVER (PARTITION BY conv_id) total FROM conversations WHERE role = 'assistant'),
s AS (SELECT DISTINCT conv_id FROM conversations) SELECT s.conv_id AS session_id, coalesce(max(total), 0) AS total, coalesce(max(total), 0) > 2 AS truncated, coalesce(string_agg(substr(text, 1, 40) || '/' || greatest(length(text) - 40, 0), '|' ORDER BY turn) FILTER (r <= 2), '') AS shown FROM s LEFT JOIN m ON m.conv_id = s.conv_id GROUP BY 1""")
def attached_messages(spark, d):
    m = messages(spark, d)
    got = units.attached(m.select("session_id").distinct(), m.where("role = 'assistant'"), "session_id", ["text"], "position", last=2, text="text", cut=40)
    shown = F.array_join(F.transform("attached", lambda x: F.concat_ws("/", x["text"], x["text_truncated_chars"].cast("string"))), "|")
    return got.select("session_id", "total", "truncated", F.coalesce(shown, F.lit("")).alias("shown"))
