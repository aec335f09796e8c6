"""Provider detection from tight to loose, odd documents, sidecars, and ingest by content."""

import json

import pytest

from threadloom.sources import exports

M = [{"id": "1", "type": "user", "content": "hi"}, {"id": "2", "type": "gemini", "content": [{"text": "a"}, {"text": "b"}], "model": "g"}, {"id": "3", "type": "user", "content": ""}, "text"]


@pytest.mark.parametrize(("doc", "want"), [
    ({"session": {"turns": [], "provider": "grok"}, "mapping": {}}, "browser_capture"),
    ({"sessionId": "s", "messages": [], "startTime": "t", "mapping": {}}, "gemini_cli"),
    ({"sessionId": "s", "messages": []}, None),
    ({"session_id": "s", "messages": [], "system_prompt": "p"}, "hermes"),
    ({"issue_id": "i", "kind": "k", "created_at": "t", "id": "x", "extra": {}}, "beads"),
    ({"issue_id": "i", "kind": "k", "created_at": "t", "id": "x"}, None),
    ({"type": "response_item", "payload": {}, "timestamp": "t"}, "codex"),
    ({"sessionId": "s", "uuid": "u", "message": {}}, "claude_code"),
    ({"mapping": {}, "chat_messages": []}, "chatgpt"),
    ({"chat_messages": []}, "claude_web"),
    ({"conversation": {}, "responses": []}, "grok"),
    ({"conversations": [{"conversation": {}, "responses": []}]}, "grok"),
    ({"chunkedPrompt": {"chunks": []}}, "gemini"),
    ({"chunks": []}, "gemini"),
    ({"mapping": []}, None),
    ([1, 2], None),
    ("text", None),
])
def test_shapes(spark, doc, want):
    got = exports.parsed(spark.createDataFrame([("p", json.dumps(doc))], "path string, payload string")).collect()
    assert [r.provider for r in got] == ([want] if want else [])


def test_messages_of_odd_documents(spark):
    docs = [
        ("a", json.dumps({"sessionId": "s1", "startTime": "t", "summary": "Title", "messages": M})),
        ("b", json.dumps({"session_id": "s2", "session_start": "t", "system_prompt": "be kind", "model": "h", "messages": [{"role": "HUMAN ", "content": "x"}, {"role": "odd", "content": "y"}]})),
        ("c", json.dumps({"conversations": [{"conversation": {"title": ""}, "responses": [{"response": {"sender": "human", "message": "q"}}, {"response": {"sender": "ASSISTANT", "message": None}}, {"sender": "assistant", "message": "r"}]}, {"conversation": {"title": "T2"}, "responses": []}]})),
        ("d", json.dumps({"session": {"provider_session_id": "s4", "turns": [{"provider_turn_id": "1", "role": "user", "text": "u"}, {"provider_turn_id": "1", "role": "user", "text": "again"}, {"provider_turn_id": "2", "role": "assistant", "text": "v", "parent_turn_id": "1"}]}})),
        ("e", json.dumps({"chunkedPrompt": {"chunks": ["no role", {"text": "no role"}, {"author": "model", "parts": [{"text": "p"}, {"text": "q"}]}, {"role": "user", "text": ""}]}, "runSettings": {"model": "m"}})),
        ("f", json.dumps({"conversation_id": "s6", "mapping": {"r": {"message": None}, "n2": {"parent": "n1", "message": {"author": {"role": "assistant"}, "content": {"parts": ["late"]}, "create_time": 2.5}}, "n1": {"message": {"author": {"role": "user"}, "content": {"parts": ["early", {"k": 1}]}, "create_time": 1}}}})),
        ("g", "{broken"),
        ("h", None),
    ]
    rows = exports.messages(spark.createDataFrame(docs, "path string, payload string")).orderBy("session_id", "position").collect()
    got = {}
    for r in rows:
        got.setdefault(r.session_id, []).append((r.role, r.text))
    assert got == {
        "s1": [("user", "hi"), ("assistant", "a\nb")],
        "s2": [("system", "be kind"), ("user", "x"), ("unknown", "y")],
        "c#0": [("user", "q"), ("assistant", "r")],
        "s4": [("user", "u"), ("assistant", "v")],
        "e": [("assistant", "p\nq")],
        "s6": [("user", "early"), ("assistant", "late")],
    }
    assert {r.session_id: r.model for r in rows if r.model} == {"s1": "g", "s2": "h", "e": "m"}
    assert {r.title for r in rows if r.session_id == "s1"} == {"Title"} and {r.title for r in rows if r.session_id == "c#0"} == {"c#0"}
    assert exports.messages(spark.createDataFrame([], "path string, payload string")).count() == 0


def test_sidecars(spark):
    docs = [("x/s1-agent-a1.json", json.dumps([{"content": "do", "status": "pending", "id": "1"}, {"content": 5, "status": "done"}, "no"])), ("x/s2.json", json.dumps({"content": "no list"})), ("x/s3.json", "broken[")]
    got = exports.todos(spark.createDataFrame(docs, "path string, payload string")).collect()
    assert [(r.session_id, r.agent_id, r.position, r.content, r.id, r.priority) for r in got] == [("s1", "a1", 0, "do", "1", None)]
    lines = [("h", json.dumps({"display": "d", "timestamp": 5, "sessionId": "s", "pastedContents": {"1": {"content": "x"}, "2": {"content": ""}, "3": "no"}})), ("h", json.dumps({"display": "e"})), ("h", "broken")]
    got = sorted(tuple(r) for r in exports.history(spark.createDataFrame(lines, "path string, payload string")).select("display", "ts_ms", "pastes", "kept_pastes").collect())
    assert got == [("d", 5, 2, 1), ("e", None, 0, 0)]
    named = exports.named_assets(spark.createDataFrame([("a",), ("b",)], "asset_id string"), spark.createDataFrame([("a", "z.png"), ("a", "y.png")], "asset_id string, name string"))
    assert sorted(map(tuple, named.collect())) == [("a", "y.png"), ("b", "b")]


def test_content_is_compared_in_nfc(spark):
    known = spark.createDataFrame([(1, "café", "star"), (2, "x", "note")], "k int, text string, tag string").withColumn("content_hash", exports.content_hash(["text"]))
    incoming = spark.createDataFrame([(1, "café"), (2, "y"), (2, "y"), (3, None)], "k int, text string")
    got = {r.k: (r.change, r.tag) for r in exports.upsert(known, incoming, ["k"], ["text"]).collect()}
    assert got == {1: ("same", "star"), 2: ("replaced", "note"), 3: ("inserted", None)}
