"""Provider blocks: calls, results and thoughts of real shapes, lists of conversations, and what can't be read."""

import json

from threadloom.sources import exports

CODE = [
    {"sessionId": "s", "uuid": "1", "timestamp": "t1", "message": {"role": "assistant", "content": [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "let me see"}, {"type": "tool_use", "id": "a", "name": "Bash", "input": {"command": "ls"}}, {"type": "tool_use", "id": "b", "name": "Read", "input": {"file_path": "/x"}}]}},
    {"sessionId": "s", "uuid": "2", "timestamp": "t2", "toolUseResult": {"exitCode": 2}, "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "a", "content": [{"type": "text", "text": "one"}, {"type": "text", "text": "two"}], "is_error": False}]}},
    {"sessionId": "s", "uuid": "3", "timestamp": "t3", "message": {"role": "user", "content": [{"type": "image", "source": {"media_type": "image/png"}}, "plain", {"type": "odd"}]}},
]
CODEX = [
    {"type": "session_meta", "timestamp": "t0", "payload": {"id": "x"}},
    {"type": "response_item", "timestamp": "t1", "payload": {"type": "reasoning", "summary": [{"type": "summary_text", "text": "think"}]}},
    {"type": "response_item", "timestamp": "t2", "payload": {"type": "function_call", "name": "shell", "arguments": "{\"cmd\": 1}", "call_id": "c1"}},
    {"type": "response_item", "timestamp": "t3", "payload": {"type": "function_call_output", "call_id": "c1", "output": "{\"output\": \"done\", \"metadata\": {\"exit_code\": 0}}"}},
    {"type": "response_item", "timestamp": "t4", "payload": {"type": "custom_tool_call", "name": "apply_patch", "input": "*** Begin", "call_id": "c2"}},
    {"type": "response_item", "timestamp": "t5", "payload": {"type": "custom_tool_call_output", "call_id": "c2", "output": "Exit code: 1\nbad"}},
    {"type": "response_item", "timestamp": "t6", "payload": {"type": "message", "role": "assistant", "content": [{"type": "output_text", "text": "all done"}]}},
]
HERMES = {"session_id": "h", "last_updated": "t", "messages": [
    {"role": "assistant", "content": None, "reasoning_content": "why", "tool_calls": [{"id": "q", "function": {"name": "grep", "arguments": "{\"p\": 1}"}}, {"function": {"name": "anon"}}, "odd"]},
    {"role": "tool", "tool_call_id": "q", "content": "found"},
]}
GEMINI = {"sessionId": "g", "kind": "main", "messages": [
    {"id": "1", "type": "gemini", "content": "ok", "thoughts": [{"subject": "S", "description": "D"}], "toolCalls": [
        {"id": "t1", "name": "run", "args": {"a": 1}, "status": "success", "result": [{"functionResponse": {"id": "t1", "name": "run", "response": {"output": "yes"}}}]},
        {"id": "t2", "name": "run", "args": {}, "status": "error", "result": [{"functionResponse": {"response": {"error": "boom"}}}]},
        {"name": "quiet", "status": "cancelled"},
    ]},
]}
GPT = {"conversation_id": "p", "mapping": {
    "r": {"message": {"author": {"role": "user"}, "content": {"content_type": "multimodal_text", "parts": [{"content_type": "image_asset_pointer", "asset_pointer": "file-1"}, "look"]}, "create_time": 1}},
    "k": {"parent": "r", "message": {"author": {"role": "assistant"}, "recipient": "python", "content": {"content_type": "code", "text": "1+1"}, "create_time": 2}},
    "o": {"parent": "k", "message": {"author": {"role": "tool", "name": "python"}, "content": {"content_type": "execution_output", "text": "2"}, "create_time": 3}},
}}
STUDIO = {"chunkedPrompt": {"chunks": [{"role": "model", "text": "secretly", "isThought": True}, {"role": "model", "executableCode": {"language": "PYTHON", "code": "print()"}}, {"role": "model", "codeExecutionResult": {"outcome": "OUTCOME_FAILED", "output": "no"}}]}}


def frame(spark, docs):
    return spark.createDataFrame(docs, "path string, payload string")


def shown(rows):
    return [(r.kind, r.text, r.tool_name, r.tool_id) for r in rows]


def test_blocks_and_actions(spark):
    docs = [("c.jsonl", json.dumps(x)) for x in CODE] + [("x.jsonl", json.dumps(x)) for x in CODEX] + [(k, json.dumps(v)) for k, v in (("h", HERMES), ("g", GEMINI), ("p", GPT), ("studio", STUDIO))]
    rows = exports.blocks(frame(spark, docs)).orderBy("provider", "session_id", "position", "block").collect()
    by = {}
    for r in rows:
        by.setdefault(r.provider, []).append(r)
    assert shown(by["claude_code"]) == [("thinking", "hm", None, None), ("text", "let me see", None, None), ("tool_use", None, "Bash", "a"), ("tool_use", None, "Read", "b"), ("tool_result", "one\ntwo", None, "a"), ("image", "image/png", None, None), ("text", "plain", None, None)]
    assert shown(by["codex"]) == [("thinking", "think", None, None), ("tool_use", None, "shell", "c1"), ("tool_result", "done", None, "c1"), ("tool_use", None, "apply_patch", "c2"), ("tool_result", "Exit code: 1\nbad", None, "c2"), ("text", "all done", None, None)]
    assert shown(by["hermes"]) == [("thinking", "why", None, None), ("tool_use", None, "grep", "q"), ("tool_use", None, "anon", "tool-1-2"), ("tool_result", "found", None, "q")]
    assert shown(by["gemini_cli"]) == [("text", "ok", None, None), ("thinking", "D", None, None), ("tool_use", None, "run", "t1"), ("tool_result", "yes", "run", "t1"), ("tool_use", None, "run", "t2"), ("tool_result", "boom", None, "t2"), ("tool_use", None, "quiet", "tool-1-3"), ("tool_result", "[cancelled]", None, "tool-1-3")]
    assert shown(by["chatgpt"]) == [("image", "file-1", None, None), ("text", "look", None, None), ("tool_use", None, "python", "k"), ("tool_result", "2", "python", "k")]
    assert shown(by["gemini"]) == [("thinking", "secretly", None, None), ("tool_use", None, "executable_code", "code"), ("tool_result", "no", "executable_code", "code")]
    acts = {(r.provider, r.tool_id): (r.tool_name, r.tool_input, r.state) for r in exports.actions(exports.blocks(frame(spark, docs))).collect()}
    assert acts == {
        ("claude_code", "a"): ("Bash", '{"command":"ls"}', "outcome_error"),
        ("claude_code", "b"): ("Read", '{"file_path":"/x"}', "no_result"),
        ("codex", "c1"): ("shell", '{"cmd": 1}', "outcome_success"),
        ("codex", "c2"): ("apply_patch", "*** Begin", "outcome_error"),
        ("hermes", "q"): ("grep", '{"p": 1}', "outcome_unknown"),
        ("hermes", "tool-1-2"): ("anon", None, "no_result"),
        ("gemini_cli", "t1"): ("run", '{"a":1}', "outcome_success"),
        ("gemini_cli", "t2"): ("run", "{}", "outcome_error"),
        ("gemini_cli", "tool-1-3"): ("quiet", None, "outcome_error"),
        ("chatgpt", "k"): ("python", "1+1", "outcome_unknown"),
        ("gemini", "code"): ("executable_code", "print()", "outcome_error"),
    }


def test_lists_and_shapes_seen_before_messages(spark):
    listed = [{"uuid": f"u{k}", "chat_messages": [{"uuid": "m", "sender": "human", "text": f"hi {k}"}]} for k in range(3)]
    docs = [("list.json", json.dumps([*listed, {"odd": 1}])), ("stub", json.dumps({"sessionId": "z", "projectHash": "p", "kind": "main"})), ("platform", json.dumps({"session_id": "w", "platform": "cli", "messages": [{"role": "user", "content": "yo"}]})), ("updated", json.dumps({"sessionId": "v", "lastUpdated": "t", "messages": [{"type": "user", "content": "hey"}]}))]
    got = sorted((r.provider, r.session_id, r.text) for r in exports.messages(frame(spark, docs)).collect())
    assert got == [("claude_web", f"u{k}", f"hi {k}") for k in range(3)] + [("gemini_cli", "v", "hey"), ("hermes", "w", "yo")]
    assert {r.path: r.provider for r in exports.parsed(frame(spark, docs)).collect()}["stub"] == "gemini_cli"
    assert [tuple(r) for r in exports.unread(frame(spark, docs)).collect()] == [("list.json#3", "unknown")]


def test_what_is_not_read_has_a_state(spark):
    docs = [("a", "{broken"), ("b", None), ("c", "[1]"), ("d", json.dumps({"chunks": [{"role": "user", "text": "x" * 20_100_000}]})), ("e", json.dumps({"chunks": []}))]
    assert sorted(tuple(r) for r in exports.unread(frame(spark, docs)).collect()) == [("a", "invalid"), ("b", "invalid"), ("c#0", "unknown"), ("d", "too_long")]


def test_commands_tell_categories(spark):
    inputs = [('{"command":" \\n git status"}', "git"), ('{"cmd":["git","log"]}', "git"), ('{"cmd":"ls"}', "shell"), ("not json", "shell"), (None, "shell")]
    docs = [(f"c{k}", json.dumps({"sessionId": "s", "uuid": str(k), "timestamp": "t", "message": {"role": "assistant", "content": [{"type": "tool_use", "id": str(k), "name": "bash", "input": x if x is None or x[0] != "{" else json.loads(x)}]}})) for k, (x, _) in enumerate(inputs)]
    got = {r.tool_id: r.category for r in exports.actions(exports.blocks(frame(spark, docs))).collect()}
    assert got == {str(k): want for k, (_, want) in enumerate(inputs)}


def test_documents_are_read_once_for_calls_and_results(spark, tmp_path):
    """Each pass parses every document again, so calls, results and issues' records come from one."""
    docs = [("p", json.dumps({"session_id": "s", "platform": "cli", "messages": [{"role": "user", "content": "x"}]}))]
    frame(spark, docs).write.parquet(path := f"{tmp_path}/docs")
    plan = exports.actions(exports.blocks(spark.read.parquet(path)))._jdf.queryExecution().optimizedPlan()
    assert plan.collectLeaves().size() == 1


def test_calls_and_results_of_odd_ids(spark):
    """Ranks go by kind: results before their calls, more of either, ids that are null or empty, sessions without a name."""
    row = lambda s, at, kind, tool, text=None: ("p", s, at, 0, kind, tool, None, text)
    rows = [
        *[row("a", k, "tool_result", "t", f"r{k}") for k in (0, 3)], *[row("a", k, "tool_use", "t") for k in (1, 2, 4)],
        *[row("a", k, "tool_result", "more", f"r{k}") for k in (6, 7)], row("a", 5, "tool_use", "more"),
        row("a", 8, "tool_use", None), row("a", 9, "tool_use", ""), row("a", 10, "tool_use", None), *[row("a", 11 + k, "tool_result", x, "none") for k, x in enumerate((None, ""))],
        row("b", 0, "tool_result", "t", "other"), row("a", 13, "text", "t", "text"), row(None, 0, "tool_use", "t"), row(None, 1, "tool_result", "t", "nobody's"),
    ]
    df = spark.createDataFrame(rows, "provider string, session_id string, position int, block int, kind string, tool_id string, tool_name string, text string")
    df = df.selectExpr("*", "cast(null as string) ts", "cast(null as string) tool_input", "cast(null as int) is_error", "cast(null as int) exit_code")
    got = sorted((r.session_id or "", r.position, r.rank, r.found, r.result_position, r.result_text, r.state) for r in exports.actions(df).collect())
    no, un = "no_result", "outcome_unknown"
    assert got == [("", 0, 1, False, None, None, no), ("a", 1, 1, True, 0, "r0", un), ("a", 2, 2, True, 3, "r3", un), ("a", 4, 3, False, None, None, no), ("a", 5, 1, True, 6, "r6", un), *[("a", k, None, False, None, None, no) for k in (8, 9, 10)]]
