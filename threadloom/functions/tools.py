"""Classes of tools by name and command."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whole names (lower case) and parts of names for each class, in order; the first that holds decides.
RULES: list[tuple[str, tuple[str, ...], tuple[str, ...]]] = [
    ("file_read", ("read", "view", "cat"), ("__get_file_contents",)),
    ("file_write", ("write", "create"), ()),
    ("file_edit", ("edit", "patch", "apply_patch", "sed", "notebookedit", "multiedit"), ("__edit_file", "__create_or_update_file")),
    (
        "search",
        ("glob", "grep", "search", "find", "file_search", "ls", "toolsearch", "find_symbol", "find_referencing_symbols", "search_for_pattern", "get_symbols_overview", "query_docs", "resolve_library_id"),
        ("__query-docs", "__get-library-docs", "__resolve-library-id", "__search_code", "__search_tool", "__search_repositories", "__search_users", "__search_issues", "__search_pull_requests", "__find_definition", "__find_references", "__find_referencing_symbols", "__get_symbols_in_file", "__get_diagnostics"),
    ),
    ("shell", ("bash", "shell", "terminal", "run", "exec", "exec_command", "functions.exec", "functions.exec_command", "shell_command"), ()),
    ("shell_other", ("killshell",), ()),
    ("subagent", ("task", "subagent", "spawn_agent", "agent"), ()),
    (
        "agent",
        ("askuserquestion", "enterplanmode", "exitplanmode", "skill", "batch", "update_plan", "write_stdin", "send_input", "wait", "wait_agent", "close_agent", "initial_instructions", "activate_project", "get_current_config", "get_goal", "update_goal", "mcp__sequential-thinking__sequentialthinking", "mcp__cclsp__restart_server"),
        (),
    ),
    ("web", ("web", "fetch", "browse", "webfetch", "websearch"), ("tabs_context", "__web_search", "__webfetch")),
]
AGENT_PREFIXES = ("todo", "task")


def tool_category(name: Column, command: Column) -> Column:
    """Ten classes; a shell whose command starts with ``git `` is git. A null name is other."""
    low = F.lower(name)

    def holds(label: str, names: tuple[str, ...], parts: tuple[str, ...]) -> Column:
        tests = [low.isin(*names), *[F.contains(low, F.lit(p)) for p in parts]]
        tests += [low.startswith(p) for p in AGENT_PREFIXES] if label == "agent" else []
        return reduce(Column.__or__, tests)

    git = F.when(F.rlike(command, F.lit(r"^\s*git ")), "git").otherwise("shell")
    out = {"shell": git, "shell_other": F.lit("shell")}
    return F.coalesce(*[F.when(holds(*rule), out.get(rule[0], F.lit(rule[0]))) for rule in RULES], F.lit("other"))


def command_of(tool_input: Column) -> Column:
    """A call's shell command from its input as JSON, a text or a list of words under ``command`` or ``cmd``."""
    v = F.try_parse_json(tool_input)
    text = lambda path: F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))
    words = lambda path: F.array_join(F.try_variant_get(v, path, "array<string>"), " ")
    return F.coalesce(text("$.command"), text("$.cmd"), words("$.command"), words("$.cmd"))
