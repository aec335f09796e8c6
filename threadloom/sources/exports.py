"""Chat exports of several providers as one table of messages, from JSON documents.

Input: one row for each document or record line: ``path`` and ``payload`` (JSON text), as ``packed.read``
gives them from files of any size. A document is parsed once, told apart by its shape, and its messages
and their blocks come from an expression for its provider, so that any number of documents is one pass
without Python. What gives no rows is told by ``unread``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.functions.scalars import result_state
from threadloom.functions.tools import command_of, tool_category

BLOCK = "struct<kind:string,text:string,tool_name:string,tool_id:string,tool_input:string,is_error:int,exit_code:int>"
MESSAGE = f"struct<message_id:string,role:string,text:string,ts:string,model:string,parent_id:string,blocks:array<{BLOCK}>>"


def _get(of: str, path: str, kind: str = "string") -> str:
    return f"try_variant_get({of}, '$.{path}', '{kind}')"


def _has(path: str, kind: str) -> str:
    """The kind of a value; a list or an object is told by a cast, as its schema would be that of all that is in it."""
    if kind in ("ARRAY", "OBJECT"):
        return f"{_get('v', path, 'array<variant>' if kind == 'ARRAY' else 'map<string,variant>')} is not null"
    return f"coalesce(schema_of_variant({_get('v', path, 'variant')}) = '{kind}', false)"


def _there(path: str) -> str:
    return f"{_get('v', path, 'variant')} is not null"


# Kinds of sessions of one provider.
_kind = f"coalesce({_get('v', 'kind')} in ('main', 'subagent'), false)"

#: Provider and the shape that tells it, from tight to loose: the first that fits claims the document.
SHAPES = [
    ("browser_capture", f"{_has('session', 'OBJECT')} and {_has('session.turns', 'ARRAY')}"),
    ("gemini_cli", f"{_has('sessionId', 'STRING')} and ({_has('messages', 'ARRAY')} and ({_there('startTime')} or {_there('lastUpdated')} or {_kind}) or {_has('projectHash', 'STRING')} and ({_has('messages', 'ARRAY')} or {_kind}))"),
    ("hermes", f"{_has('session_id', 'STRING')} and {_has('messages', 'ARRAY')} and ({_there('session_start')} or {_there('last_updated')} or {_there('platform')} or {_has('system_prompt', 'STRING')})"),
    ("beads", f"{_has('issue_id', 'STRING')} and {_has('kind', 'STRING')} and {_has('created_at', 'STRING')} and {_has('id', 'STRING')} and {_has('extra', 'OBJECT')}"),
    ("codex", f"{_has('type', 'STRING')} and {_has('payload', 'OBJECT')} and {_has('timestamp', 'STRING')}"),
    ("claude_code", f"{_has('sessionId', 'STRING')} and {_has('uuid', 'STRING')} and {_has('message', 'OBJECT')}"),
    ("chatgpt", _has("mapping", "OBJECT")),
    ("claude_web", _has("chat_messages", "ARRAY")),
    ("grok", f"{_has('conversation', 'OBJECT')} and {_has('responses', 'ARRAY')}"),
    ("gemini", f"{_has('chunkedPrompt.chunks', 'ARRAY')} or {_has('chunks', 'ARRAY')}"),
]

# Names that exports use for a role.
ROLES = {"human": "user", "user": "user", "assistant": "assistant", "model": "assistant", "gemini": "assistant", "ai": "assistant", "bot": "assistant", "system": "system", "developer": "system", "tool": "tool", "function": "tool"}


def provider(v: str = "v") -> Column:
    """The provider of a parsed document; null where no shape fits."""
    return F.expr("case " + " ".join(f"when {shape} then '{name}'" for name, shape in SHAPES) + " end")


def role(c: str) -> str:
    names = ", ".join(f"'{a}', '{b}'" for a, b in ROLES.items())
    return f"coalesce(try_element_at(map({names}), lower(trim({c}))), 'unknown')"


def _texts(of: str, path: str) -> str:
    """A text, or the texts of a list's parts, joined by line ends."""
    parts = f"filter(transform({_get(of, path, 'array<variant>')}, p -> coalesce({_get('p', 'text')}, IF(schema_of_variant(p) = 'STRING', cast(p as string), NULL))), p -> p is not null)"
    return f"IF({_get(of, path, 'array<variant>')} is null, IF(schema_of_variant({_get(of, path, 'variant')}) = 'STRING', {_get(of, path)}, NULL), array_join({parts}, '\\n'))"


def _block(kind: str, text: str = "NULL", name: str = "NULL", tool_id: str = "NULL", given: str = "NULL", error: str = "NULL", code: str = "NULL") -> str:
    return f"named_struct('kind', '{kind}', 'text', cast({text} as string), 'tool_name', cast({name} as string), 'tool_id', cast({tool_id} as string), 'tool_input', cast({given} as string), 'is_error', cast({error} as int), 'exit_code', cast({code} as int))"


def _json(of: str, path: str) -> str:
    """A value as JSON text; a text that holds JSON is that text."""
    return f"IF(schema_of_variant({_get(of, path, 'variant')}) = 'STRING', {_get(of, path)}, to_json({_get(of, path, 'variant')}))"


def _each(of: str, path: str, x: str, block: str) -> str:
    """Blocks of a list's items; items that give null are none."""
    return f"coalesce(filter(transform({_get(of, path, 'array<variant>')}, {x} -> {block}), q -> q is not null), array())"


def _flag(of: str, path: str) -> str:
    return f"IF(schema_of_variant({_get(of, path, 'variant')}) = 'BOOLEAN', {_get(of, path, 'boolean')}, NULL)"


#: A part of a message's content: its type says what it is; a bare text, or an unknown type with a text, is text.
_PART = f"""CASE WHEN schema_of_variant(p) = 'STRING' THEN IF(cast(p as string) = '', NULL, {_block("text", "cast(p as string)")})
WHEN {_get("p", "type")} = 'thinking' THEN {_block("thinking", f"coalesce(nullif({_get('p', 'thinking')}, ''), {_get('p', 'text')})")}
WHEN {_get("p", "type")} in ('tool_use', 'server_tool_use') THEN {_block("tool_use", "NULL", _get("p", "name"), _get("p", "id"), _json("p", "input"))}
WHEN {_get("p", "type")} in ('tool_result', 'web_search_tool_result') THEN {_block("tool_result", "{RESULT}", "NULL", _get("p", "tool_use_id"), "NULL", _flag("p", "is_error"))}
WHEN {_get("p", "type")} in ('image', 'input_image', 'image_asset_pointer', 'document') THEN {_block("image", f"coalesce({_get('p', 'media_type')}, {_get('p', 'source.media_type')}, {_get('p', 'content_type')})")}
WHEN {_get("p", "content_type")} = 'image_asset_pointer' THEN {_block("image", _get("p", "asset_pointer"))}
WHEN coalesce({_get("p", "text")}, {_get("p", "content")}, {_get("p", "message")}, {_get("p", "value")}, '') <> '' THEN {_block("text", f"coalesce({_get('p', 'text')}, {_get('p', 'content')}, {_get('p', 'message')}, {_get('p', 'value')})")} END"""


def _parts(of: str, path: str) -> str:
    """Blocks of a content that is a text or a list of parts."""
    whole = f"array({_block('text', _get(of, path))})"
    part = _PART.replace("{RESULT}", _texts("p", "content"))
    text = f"IF(coalesce(schema_of_variant({_get(of, path, 'variant')}) = 'STRING' and {_get(of, path)} <> '', false), {whole}, array())"
    return f"IF({_get(of, path, 'array<variant>')} is null, {text}, {_each(of, path, 'p', part)})"


def _message(message_id: str, who: str, text: str, ts: str = "NULL", model: str = "NULL", parent: str = "NULL", blocks: str | None = None) -> str:
    blocks = blocks or f"IF(coalesce({text}, '') = '', array(), array({_block('text', text)}))"
    return f"named_struct('message_id', {message_id}, 'role', {who}, 'text', {text}, 'ts', cast({ts} as string), 'model', cast({model} as string), 'parent_id', cast({parent} as string), 'blocks', cast({blocks} as array<{BLOCK}>))"


_NO_BLOCKS = f"cast(array() as array<{BLOCK}>)"


def _list(path: str, message: str) -> str:
    """Messages of a list's items (m, at place i) that have a text or a block."""
    return f"filter(transform({_get('v', path, 'array<variant>')}, (m, i) -> {message}), x -> coalesce(x.text, '') <> '' or size(x.blocks) > 0)"


def _joined(*blocks: str) -> str:
    return f"concat({', '.join(f'cast({b} as array<{BLOCK}>)' for b in blocks)})"


def _some(condition: str, block: str) -> str:
    return f"IF({condition}, array({block}), {_NO_BLOCKS})"


def _tool_name(t: str) -> str:
    return f"coalesce({_get(t, 'name')}, {_get(t, 'function.name')}, {_get(t, 'type')}, 'tool')"


def _tool_id(t: str) -> str:
    return f"coalesce({_get(t, 'id')}, {_get(t, 'call_id')}, concat('tool-', i + 1, '-', j + 1))"


def _calls(path: str, *more: str) -> str:
    """A call for each item (t, at place j) of a message's list, each followed by what belongs to it."""
    given = f"coalesce({_json('t', 'args')}, {_json('t', 'arguments')}, {_json('t', 'function.arguments')})"
    call = _block("tool_use", "NULL", _tool_name("t"), _tool_id("t"), given)
    return f"coalesce(flatten(transform(filter({_get('m', path, 'array<variant>')}, t -> schema_of_variant(t) rlike '^OBJECT'), (t, j) -> {_joined(f'array({call})', *more)})), {_NO_BLOCKS})"


# What a tool's status says of its outcome.
_STATUS = _get("t", "status")
_STATUS_ERROR = f"CASE WHEN lower(trim({_STATUS})) in ('success', 'succeeded', 'ok', 'completed') THEN 0 WHEN lower({_STATUS}) rlike 'error|fail|timeout|cancel|blocked' THEN 1 END"
_SHOWN = _texts("t", "resultDisplay")
_ANSWERS = f"filter({_get('t', 'result', 'array<variant>')}, r -> {_get('r', 'functionResponse', 'variant')} is not null)"
_ONE_ANSWER = _block("tool_result", f"coalesce(nullif({_get('r', 'functionResponse.response.output')}, ''), nullif({_get('r', 'functionResponse.response.error')}, ''), nullif({_SHOWN}, ''), concat('[', {_STATUS}, ']'))", _get("r", "functionResponse.name"), f"coalesce({_get('r', 'functionResponse.id')}, {_tool_id('t')})", "NULL", f"IF(coalesce({_get('r', 'functionResponse.response.error')}, '') <> '', 1, {_STATUS_ERROR})")
_PLAIN_ANSWER = _some(f"coalesce({_SHOWN}, '') <> '' or {_STATUS} is not null", _block("tool_result", f"coalesce(nullif({_SHOWN}, ''), concat('[', {_STATUS}, ']'))", "NULL", _tool_id("t"), "NULL", _STATUS_ERROR))
#: The answers of a call, or what was shown of it.
_GEMINI_ANSWER = f"IF(size({_ANSWERS}) > 0, transform({_ANSWERS}, r -> {_ONE_ANSWER}), {_PLAIN_ANSWER})"
_THOUGHT = f"coalesce(nullif({_get('h', 'description')}, ''), nullif({_get('h', 'text')}, ''), nullif({_get('h', 'content')}, ''), {_get('h', 'subject')}, {_get('h', 'summary')})"


def _thoughts(of: str, path: str) -> str:
    return _each(of, path, "h", f"IF({_THOUGHT} is null, NULL, {_block('thinking', _THOUGHT)})")


_SENDER = f"coalesce({_get('m', 'response.sender')}, {_get('m', 'sender')})"
_SAID = f"coalesce({_get('m', 'response.message')}, {_get('m', 'message')})"
_SENT = f"coalesce({_get('m', 'response.create_time')}, {_get('m', 'create_time')})"
_CHUNK_ROLE = f"coalesce(nullif({_get('m', 'role')}, ''), {_get('m', 'author')})"
_CHUNK_TEXT = f"coalesce({_get('m', 'text')}, {_texts('m', 'parts')})"
_NODE = "e.value"
_NODE_TYPE = _get(_NODE, "message.content.content_type")
_NODE_TEXT = f"coalesce(nullif({_texts(_NODE, 'message.content.parts')}, ''), {_get(_NODE, 'message.content.text')}, {_get(_NODE, 'message.content.result')}, '')"
_CALLED = f"coalesce({_NODE_TYPE} = 'code' and {_get(_NODE, 'message.recipient')} <> 'all', false)"
#: A node's blocks; calls have no ids, so the node's own is taken, to which the tool's message is a child.
_NODE_BLOCKS = f"""CASE WHEN {_CALLED} THEN array({_block("tool_use", "NULL", _get(_NODE, "message.recipient"), "e.key", _NODE_TEXT)})
WHEN {_get(_NODE, "message.author.role")} = 'tool' THEN array({_block("tool_result", _NODE_TEXT, _get(_NODE, "message.author.name"), _get(_NODE, "parent"))})
WHEN {_NODE_TYPE} in ('thoughts', 'reasoning_recap') THEN {_thoughts(_NODE, "message.content.thoughts")}
WHEN {_get(_NODE, "message.content.parts", "variant")} is not null THEN {_parts(_NODE, "message.content.parts")}
WHEN {_NODE_TEXT} <> '' THEN array({_block("text", _NODE_TEXT)}) ELSE {_NO_BLOCKS} END"""
_OUTPUT = _get("v", "payload.output")
_TOLD = f"try_parse_json({_OUTPUT})"
#: What a call gave, of which some is JSON in a text.
_CODEX_OUTPUT = f"coalesce({_get(_TOLD, 'output')}, {_get('v', 'payload.output.output')}, {_get('v', 'payload.output.content')}, {_texts('v', 'payload.output')})"
_CODEX_EXIT = f"coalesce({_get(_TOLD, 'metadata.exit_code', 'int')}, {_get('v', 'payload.output.metadata.exit_code', 'int')}, try_cast(nullif(regexp_extract({_OUTPUT}, '(?:Exit code:|exited with code) (-?[0-9]+)', 1), '') as int))"
_CODEX_ERROR = f"CASE {_get('v', 'payload.output.success', 'boolean')} WHEN true THEN 0 WHEN false THEN 1 END"
_KIND = _get("v", "payload.type")
_REASONED = f"coalesce(nullif({_texts('v', 'payload.summary')}, ''), nullif({_texts('v', 'payload.content')}, ''), {_get('v', 'payload.text')})"
_CODEX_BLOCKS = f"""CASE WHEN {_KIND} = 'message' THEN {_parts("v", "payload.content")}
WHEN {_KIND} in ('function_call', 'custom_tool_call', 'local_shell_call', 'web_search_call') THEN array({_block("tool_use", "NULL", f"coalesce({_get('v', 'payload.name')}, regexp_replace({_KIND}, '_call$', ''))", f"coalesce({_get('v', 'payload.call_id')}, {_get('v', 'payload.id')})", f"coalesce({_json('v', 'payload.arguments')}, {_json('v', 'payload.input')}, {_json('v', 'payload.action')})")})
WHEN {_KIND} in ('function_call_output', 'custom_tool_call_output', 'local_shell_call_output') THEN array({_block("tool_result", _CODEX_OUTPUT, "NULL", _get("v", "payload.call_id"), "NULL", _CODEX_ERROR, _CODEX_EXIT)})
WHEN {_KIND} = 'reasoning' THEN array({_block("thinking", _REASONED)}) ELSE {_NO_BLOCKS} END"""
_CODEX_ROLE = f"CASE WHEN {_KIND} = 'message' THEN {role(_get('v', 'payload.role'))} WHEN {_KIND} rlike '_output$' THEN 'tool' ELSE 'assistant' END"
_CODEX_TEXT = f"CASE WHEN {_KIND} = 'message' THEN {_texts('v', 'payload.content')} END"
_CODEX = _message(_get("v", "payload.id"), _CODEX_ROLE, _CODEX_TEXT, _get("v", "timestamp"), "NULL", "NULL", _CODEX_BLOCKS)
_RUN_EXIT = f"coalesce({_get('v', 'toolUseResult.exitCode', 'int')}, {_get('v', 'toolUseResult.exit_code', 'int')})"
_CODE_BLOCKS = f"transform(cast({_parts('v', 'message.content')} as array<{BLOCK}>), b -> IF(b.kind = 'tool_result', named_struct('kind', b.kind, 'text', b.text, 'tool_name', b.tool_name, 'tool_id', b.tool_id, 'tool_input', b.tool_input, 'is_error', b.is_error, 'exit_code', {_RUN_EXIT}), b))"
_CODE_ROLE = role(f"coalesce({_get('v', 'message.role')}, {_get('v', 'type')})")
_REASON = f"coalesce(nullif({_get('m', 'reasoning_content')}, ''), nullif({_get('m', 'reasoning')}, ''))"
_HERMES_TEXT, _HERMES_ROLE = _texts("m", "content"), role(_get("m", "role"))
_HERMES_BLOCKS = _joined(
    f"IF({_HERMES_ROLE} = 'tool', {_NO_BLOCKS}, {_parts('m', 'content')})",
    _some(f"{_REASON} is not null", _block("thinking", _REASON)),
    _calls("tool_calls"),
    _some(f"{_HERMES_ROLE} = 'tool' and coalesce({_HERMES_TEXT}, '') <> ''", _block("tool_result", _HERMES_TEXT, _get("m", "name"), _get("m", "tool_call_id"))),
)
_HERMES = _message(_get("m", "id"), _HERMES_ROLE, _HERMES_TEXT, f"coalesce({_get('m', 'timestamp')}, {_get('m', 'created_at')})", f"coalesce({_get('m', 'model')}, {_get('v', 'model')})", "NULL", _HERMES_BLOCKS)
_CHUNK_BLOCKS = _joined(
    _some(f"coalesce({_CHUNK_TEXT}, '') <> ''", f"IF(coalesce({_get('m', 'isThought', 'boolean')}, false), {_block('thinking', _CHUNK_TEXT)}, {_block('text', _CHUNK_TEXT)})"),
    _some(f"{_get('m', 'executableCode.code')} is not null", _block("tool_use", "NULL", "'executable_code'", "'code'", _get("m", "executableCode.code"))),
    _some(f"{_get('m', 'codeExecutionResult', 'variant')} is not null", _block("tool_result", _get("m", "codeExecutionResult.output"), "'executable_code'", "'code'", "NULL", f"IF({_get('m', 'codeExecutionResult.outcome')} = 'OUTCOME_OK', 0, 1)")),
    *[_some(f"{_get('m', x, 'variant')} is not null", _block("image", f"coalesce({_get('m', f'{x}.mimeType')}, {_get('m', f'{x}.id')})")) for x in ("inlineImage", "inlineData", "driveImage")],
)
_CHUNK = _message(_get("m", "id"), role(_CHUNK_ROLE), _CHUNK_TEXT, f"coalesce({_get('m', 'createTime')}, {_get('v', 'createTime')})", f"coalesce({_get('m', 'model')}, {_get('v', 'runSettings.model')})", "NULL", _CHUNK_BLOCKS)
_SYSTEM = _message(f"concat({_get('v', 'session_id')}, ':system')", "'system'", _get("v", "system_prompt"), "NULL", _get("v", "model"))
_NODE_MESSAGE = _message(f"coalesce({_get(_NODE, 'message.id')}, e.key)", role(_get(_NODE, "message.author.role")), f"IF({_CALLED}, NULL, {_NODE_TEXT})", _get(_NODE, "message.create_time"), _get(_NODE, "message.metadata.model_slug"), _get(_NODE, "parent"), _NODE_BLOCKS)
_WEB_TEXT = f"coalesce(nullif({_get('m', 'text')}, ''), {_texts('m', 'content')})"
_WEB_BLOCKS = f"IF(size({_parts('m', 'content')}) > 0, {_parts('m', 'content')}, {_some(f'''coalesce({_WEB_TEXT}, '') <> '' ''', _block('text', _WEB_TEXT))})"
_TURN = _message(_get("m", "provider_turn_id"), role(_get("m", "role")), _get("m", "text"), _get("m", "timestamp"), "NULL", _get("m", "parent_turn_id"))
# An issue's records as the messages of a session.
_FIELD, _WHY, _ACTOR = f"nullif({_get('v', 'extra.field')}, '')", f"nullif({_get('v', 'extra.reason')}, '')", f"coalesce(nullif({_get('v', 'actor')}, ''), 'unknown actor')"
_OLD, _NEW = (f"coalesce(to_json({_get('v', f'extra.{x}_value', 'variant')}), 'null')" for x in ("old", "new"))
_DONE = f"IF({_FIELD} is null, concat({_ACTOR}, ' recorded ', replace({_get('v', 'kind')}, '_', ' ')), concat({_ACTOR}, ' changed ', {_FIELD}, ' from ', {_OLD}, ' to ', {_NEW}))"
_BEADS_TEXT = f"concat('Beads ', {_get('v', 'issue_id')}, ' ', {_get('v', 'id')}, ': ', {_DONE}, '.', coalesce(concat(' Reason: ', {_WHY}), ''))"
_BEADS = _message(_get("v", "id"), "'user'", _BEADS_TEXT, _get("v", "created_at"), "NULL", "NULL", f"array({_block('text', _BEADS_TEXT)})")
_SEEN = "filter(%s, x -> coalesce(x.text, '') <> '' or size(x.blocks) > 0)"

#: Provider → session id, title, creation time, and the document's messages in order.
READERS = {
    "browser_capture": (_get("v", "session.provider_session_id"), _get("v", "session.title"), _get("v", "session.created_at"), f"transform({_get('v', 'session.turns', 'array<variant>')}, m -> {_TURN})"),
    # S10
    "gemini_cli": (_get("v", "sessionId"), f"coalesce({_get('v', 'summary')}, {_get('v', 'sessionId')})", f"coalesce({_get('v', 'startTime')}, {_get('v', 'lastUpdated')})", _list("messages", _message(_get("m", "id"), role(_get("m", "type")), _texts("m", "content"), _get("m", "timestamp"), _get("m", "model"), "NULL", _joined(_parts("m", "content"), _thoughts("m", "thoughts"), _calls("toolCalls", _GEMINI_ANSWER))))),
    # A system prompt is the first message
    "hermes": (_get("v", "session_id"), _get("v", "session_id"), f"coalesce({_get('v', 'session_start')}, {_get('v', 'last_updated')})", f"concat(IF(coalesce({_get('v', 'system_prompt')}, '') = '', cast(array() as array<{MESSAGE}>), array({_SYSTEM})), {_list('messages', _HERMES)})"),
    "codex": ("path", "path", _get("v", "timestamp"), _SEEN % f"array({_CODEX})"),
    "claude_code": (_get("v", "sessionId"), _get("v", "sessionId"), _get("v", "timestamp"), f"array({_message(_get('v', 'uuid'), _CODE_ROLE, _texts('v', 'message.content'), _get('v', 'timestamp'), _get('v', 'message.model'), _get('v', 'parentUuid'), _CODE_BLOCKS)})"),
    # Nodes of the graph that hold a message, in order of time
    "chatgpt": (f"coalesce({_get('v', 'conversation_id')}, {_get('v', 'id')}, path)", _get("v", "title"), _get("v", "create_time"), f"transform(array_sort(transform(filter(map_entries({_get('v', 'mapping', 'map<string,variant>')}), e -> {_get(_NODE, 'message.author.role')} is not null), e -> named_struct('at', coalesce({_get(_NODE, 'message.create_time', 'double')}, 0D), 'id', e.key, 'm', {_NODE_MESSAGE}))), x -> x.m)"),
    "claude_web": (f"coalesce({_get('v', 'uuid')}, path)", _get("v", "name"), _get("v", "created_at"), _list("chat_messages", _message(_get("m", "uuid"), role(_get("m", "sender")), _WEB_TEXT, _get("m", "created_at"), "NULL", "NULL", _WEB_BLOCKS))),
    # Responses without text are none; ids come from the content
    "grok": ("path", f"coalesce(nullif({_get('v', 'conversation.title')}, ''), path)", _get("v", "conversation.create_time"), _list("responses", _message(f"sha2(concat_ws('|', path, {role(_SENDER)}, {_SAID}, {_SENT}), 256)", role(_SENDER), _SAID, _SENT))),
    # A chunk without a role is skipped
    "gemini": ("path", "path", _get("v", "createTime"), _SEEN % f"transform(filter(coalesce({_get('v', 'chunkedPrompt.chunks', 'array<variant>')}, {_get('v', 'chunks', 'array<variant>')}), m -> coalesce({_CHUNK_ROLE}, '') <> ''), m -> {_CHUNK})"),
    "beads": (_get("v", "issue_id"), f"concat('Beads issue ', {_get('v', 'issue_id')})", _get("v", "created_at"), f"array({_BEADS})"),
}

#: Parts of one document (``packed.read``) follow one another in the order of their messages.
PART = 1 << 32


def _values(docs: DataFrame) -> DataFrame:
    """(path, part, v, provider): every document's value; a list of conversations, bare or under its key, becomes a row for each."""
    part = F.col("part").cast("long") if "part" in docs.columns else F.lit(0).cast("long")
    v = docs.select("path", part.alias("part"), F.expr("try_parse_json(payload)").alias("v"))
    listed = f"coalesce(try_cast(v as array<variant>), {_get('v', 'conversations', 'array<variant>')})"
    each = v.where("v is not null").withColumn("many", F.expr(listed)).select("path", "part", F.posexplode(F.coalesce("many", F.array("v"))).alias("n", "v"), F.col("many").isNotNull().alias("_many"))
    return each.select(F.when(F.col("_many"), F.concat_ws("#", "path", "n")).otherwise(F.col("path")).alias("path"), "part", "v").withColumn("provider", provider())


def parsed(docs: DataFrame) -> DataFrame:
    """Documents (path, payload) with the parsed value and its provider."""
    return _values(docs).where("provider is not null")


def unread(docs: DataFrame, longest: int = 20_000_000) -> DataFrame:
    """(path, state) of what ``parsed`` leaves out: 'too_long' (the JSON parser takes texts of up to 20,000,000 characters), 'invalid' JSON or of 'unknown' shape; states that ``packed.read`` gave stay."""
    given = F.col("state") if "state" in docs.columns else F.lit("ok")
    none = F.expr("try_parse_json(payload) is null")
    why = F.when(given != "ok", given).when(none & (F.length("payload") > longest), "too_long").when(none, "invalid")
    odd = _values(docs).where("provider is null").select("path", F.lit("unknown").alias("state"))
    return docs.select("path", why.alias("state")).where("state is not null").union(odd)


def _read(docs: DataFrame) -> DataFrame:
    """Messages with their blocks, numbered in their session."""
    pick = lambda k: "case provider " + " ".join(f"when '{p}' then {r[k]}" for p, r in READERS.items()) + " end"
    # A document of no provider has no messages. The session's columns come before its messages, so that these don't carry the document.
    told = _values(docs).select("provider", F.coalesce(F.expr(pick(0)), "path").alias("session_id"), F.expr(pick(1)).alias("title"), F.expr(pick(2)).alias("created_at"), "path", "part", "v")
    read = told.select("provider", "session_id", "title", "created_at", "part", F.posexplode(F.expr(pick(3))).alias("place", "m"))
    place = F.when(F.col("provider") == "beads", 0).otherwise(F.col("part") * PART + F.col("place"))
    rows = read.select("provider", "session_id", "title", "created_at", place.alias("place"), "m.*")
    # Both windows use one shuffle. S13: of a turn's appearances the first counts.
    dealt, captured = rows.repartition("provider", "session_id"), F.col("provider") == "browser_capture"
    again = F.row_number().over(Window.partitionBy("provider", "session_id", F.when(captured, F.col("message_id"))).orderBy("place"))
    once = dealt.withColumn("_again", again).where(~captured | (F.col("_again") == 1) | F.col("message_id").isNull())
    # Nodes of a graph that came in parts are in order within each part only.
    at = F.when(F.col("provider") == "chatgpt", F.coalesce(F.col("ts").try_cast("double"), F.lit(0.0))).otherwise(F.when(F.col("provider").isin("codex", "claude_code", "beads"), 0).otherwise(F.col("place")))
    order = Window.partitionBy("provider", "session_id").orderBy(at, F.when(F.col("provider").isin("codex", "claude_code", "beads"), F.col("ts")), "place", "message_id")
    return once.withColumn("position", F.row_number().over(order) - 1).drop("place", "_again")


def messages(docs: DataFrame) -> DataFrame:
    """Provider, session_id, title, created_at, position and the message's columns, of all documents.

    Records that are a line each (codex, claude_code, beads) are numbered within their session by
    time and id; messages of one document keep its order. A message of calls, results or thoughts alone has no text.
    """
    return _read(docs).drop("blocks")


def blocks(docs: DataFrame) -> DataFrame:
    """A row for each block of each message: kind (text, thinking, tool_use, tool_result, image), its tool's name, id and input, and a result's outcome."""
    return _read(docs).select("provider", "session_id", "position", "role", "ts", F.posexplode("blocks").alias("block", "b")).select("provider", "session_id", "position", "role", "ts", "block", "b.*")


def actions(rows: DataFrame) -> DataFrame:
    """Each call of ``blocks`` with its result, by rank of its id in the session, and the outcome.

    Calls and results are ranked side by side and each call looks at the row after it, so that the documents are read once.
    """
    key, result = ["provider", "session_id", "tool_id"], ["position", "block", "text", "is_error", "exit_code"]
    keyed, use = F.coalesce(F.col("tool_id") != "", F.lit(False)), F.col("kind") == "tool_use"
    both = rows.where(use | (F.col("kind") == "tool_result") & keyed)
    rank = F.when(keyed, F.row_number().over(Window.partitionBy(*key, "kind").orderBy("position", "block")))
    after = F.lead(F.struct("kind", *result)).over(Window.partitionBy(*key, "rank").orderBy(F.desc("kind")))
    told = both.withColumn("rank", rank).withColumn("_r", after).where(use)
    found = F.coalesce(F.col("rank").isNotNull() & F.col("session_id").isNotNull() & (F.col("_r.kind") == "tool_result"), F.lit(False))
    paired = told.withColumn("found", found).select(*key, "rank", "position", "block", "ts", "tool_name", "tool_input", "found", *[F.when(F.col("found"), F.col(f"_r.{c}")).alias(f"result_{c}") for c in result])
    named = paired.withColumn("state", result_state(F.col("found"), F.col("result_is_error"), F.col("result_exit_code")))
    return named.withColumn("category", tool_category(F.col("tool_name"), command_of(F.col("tool_input"))))


def sessions(rows: DataFrame) -> DataFrame:
    """One row for each session of ``messages``: bounds, count, models and the last message's id."""
    return rows.groupBy("provider", "session_id").agg(F.min_by("title", "position").alias("title"), F.min("created_at").alias("created_at"), F.max_by("ts", "position").alias("updated_at"), F.count("*").alias("messages"), F.array_sort(F.collect_set("model")).alias("models"), F.max_by("message_id", "position").alias("active_leaf"))


def todos(docs: DataFrame) -> DataFrame:
    """Items of to-do snapshots (path ``<session>-agent-<agent>.json``, payload a list); entries without content or status are none."""
    item = docs.select("path", F.posexplode(F.expr("try_cast(try_parse_json(payload) as array<variant>)")).alias("position", "m"))
    session = F.regexp_extract("path", r"([^/]+?)(?:-agent-([^/]+?))?\.json$", 1)
    agent = F.nullif(F.regexp_extract("path", r"([^/]+?)(?:-agent-([^/]+?))?\.json$", 2), F.lit(""))
    text = lambda name: F.expr(f"IF(schema_of_variant({_get('m', name, 'variant')}) = 'STRING', {_get('m', name)}, NULL)").alias(name)
    return item.select(session.alias("session_id"), agent.alias("agent_id"), "position", text("content"), text("status"), text("id"), text("priority")).where("content is not null and status is not null")


def history(docs: DataFrame) -> DataFrame:
    """Prompt history lines with the number of pastes and those whose content is kept."""
    v = docs.select("path", F.expr("try_parse_json(payload)").alias("v")).where("schema_of_variant(v) rlike '^OBJECT'")
    pastes = f"filter(map_values({_get('v', 'pastedContents', 'map<string,variant>')}), p -> schema_of_variant(p) rlike '^OBJECT')"
    kept = f"size(filter({pastes}, p -> coalesce({_get('p', 'content')}, '') <> ''))"
    return v.select(F.expr(_get("v", "sessionId")).alias("session_id"), F.expr(_get("v", "display")).alias("display"), F.expr(_get("v", "project")).alias("project"), F.expr(_get("v", "timestamp", "long")).alias("ts_ms"), F.expr(f"coalesce(nullif(size({pastes}), -1), 0)").alias("pastes"), F.expr(f"IF({_get('v', 'pastedContents', 'variant')} is null, 0, {kept})").alias("kept_pastes"))


def named_assets(attachments: DataFrame, assets: DataFrame) -> DataFrame:
    """Attachments (asset_id, …) with the file name that a sidecar (asset_id, name) gives; without one they keep their id as name."""
    one = assets.groupBy("asset_id").agg(F.min("name").alias("_name"))
    return attachments.join(one, "asset_id", "left").withColumn("name", F.coalesce("_name", "asset_id")).drop("_name")


def content_hash(columns: list[str]) -> Column:
    """SHA-256 over the columns as JSON in NFC; the JVM has no function for NFC, so texts go through Arrow."""

    @F.pandas_udf(T.StringType())
    def nfc(text: pd.Series) -> pd.Series:
        return text.str.normalize("NFC")

    return F.sha2(nfc(F.to_json(F.struct(*columns))), 256)


def upsert(known: DataFrame, incoming: DataFrame, key: list[str], content: list[str]) -> DataFrame:
    """(key, content, …, content_hash, change): incoming rows 'inserted', 'replaced' or 'same', and known ones not in them 'kept'.

    known: rows with their content_hash. Of several incoming rows with one key the least hash is taken, so that
    reruns agree; columns beside the content (overlays) of known rows stay as they are.
    """
    overlay = [c for c in known.columns if c not in [*key, *content, "content_hash"]]
    new = incoming.select(*key, *content).withColumn("content_hash", content_hash(content))
    new = new.groupBy(*key).agg(F.min_by(F.struct(*content), "content_hash").alias("_n"), F.min("content_hash").alias("_new"))
    old = known.select(*key, F.struct(*content).alias("_o"), F.col("content_hash").alias("_old"), *overlay)
    both = old.join(new, key, "full")
    change = F.when(F.col("_new").isNull(), "kept").when(F.col("_old").isNull(), "inserted").when(F.col("_old") == F.col("_new"), "same").otherwise("replaced")
    taken = F.when(F.col("_new").isNull(), F.col("_o")).otherwise(F.col("_n"))
    return both.select(*key, *[taken[c].alias(c) for c in content], *overlay, F.coalesce("_new", "_old").alias("content_hash"), change.alias("change"))
