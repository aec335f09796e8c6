"""What texts, paths and messages are: flags, languages, repositories, families of tools, bounded titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File name endings and their language.
LANGUAGES = {
    "py": "python", "rs": "rust", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "go": "go", "nix": "nix", "java": "java", "rb": "ruby", "sh": "bash", "zsh": "zsh", "c": "c",
    "cpp": "cpp", "h": "c", "hpp": "cpp", "sql": "sql", "r": "r", "toml": "toml", "yaml": "yaml", "json": "json", "md": "markdown", "html": "html", "css": "css",
}

# Families of tools and the words that tell them (more can be given); tools whose command tells the family instead.
FAMILIES = [("serena", ["serena"]), ("codebase-memory", ["codebase-memory", "codebase_memory", "codebasememory", "search_code"]), ("cclsp", ["cclsp"]), ("context7", ["context7"])]
GENERIC_TOOLS = ["exec_command", "functions", "functions.exec_command", "bash", "shell", "client"]


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def language_of(path: Column) -> Column:
    """By the file name's ending; null for others."""
    return _lookup(LANGUAGES, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)))


def repo_name(remote: Column) -> Column:
    """The repository's name in a remote's address or an owner/name; null for anything else."""
    raw = F.trim(remote)
    path = F.when(F.startswith(raw, F.lit("git@")) & F.contains(raw, F.lit(":")), F.regexp_replace(raw, "^[^:]*:", ""))
    path = path.when(F.rlike(raw, F.lit("^(https?|ssh|git)://")), F.regexp_replace(raw, "^[a-z]+://[^/]*", ""))
    path = path.when(F.rlike(raw, F.lit(r"^[A-Za-z0-9_][\w.-]*/[A-Za-z0-9_][\w.-]*$")), raw)
    name = F.regexp_extract(F.regexp_replace(path, "[?#].*$", ""), r"([^/]+?)(?:\.git)?/*$", 1)
    return F.nullif(name, F.lit(""))


def clean_path(text: Column) -> Column:
    """A path as it was written, without quotes, trailing punctuation and a line number; null where none is left."""
    bare = F.regexp_replace(F.trim(text), r"^[`'\"(<\[]+|[`'\")>\],;]+$", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(:\d+){1,2}$", ""), r"[.:]+$", "")
    return F.nullif(bare, F.lit(""))


def path_like(text: Column) -> Column:
    """Whether a clean text may be a path: no white space or address, and a separator or a known ending."""
    known = language_of(text).isNotNull()
    return F.coalesce(~F.rlike(text, F.lit(r"\s|://|[*?<>|]")) & (F.length(text) <= 512) & (F.contains(text, F.lit("/")) | known), F.lit(False))


def moment(text: Column) -> Column:
    """Seconds since 1970 (86,400 or more, decimals allowed) or an ISO time, UTC where it names no zone; null for anything else."""
    seconds = F.when(F.rlike(text, F.lit(r"^[0-9]+(\.[0-9]*)?$")), text.try_cast("double"))
    iso = F.when(F.rlike(text, F.lit(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?\s?(Z|[+-]\d{2}:?\d{2})?$")), text.try_cast("timestamp"))
    return F.when(seconds >= 86_400, F.timestamp_micros((seconds * 1_000_000).cast("long"))).otherwise(iso)


def week_of(text: Column) -> Column:
    """C4: ISO week of a date's text as YYYY-Www; its first seven characters where it is no date, 'undated' where there is none."""
    day = F.when(F.rlike(text, F.lit(r"^\d{4}-\d{2}-\d{2}")), F.substring(text, 1, 10).try_cast("date"))
    week = F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.extract(F.lit("WEEK"), day).cast("string"), 2, "0"))
    return F.when(F.coalesce(text, F.lit("")) == "", "undated").otherwise(F.coalesce(week, F.substring(text, 1, 7)))


# Fixed value: the runtime's mark of a paste.
PASTE_MARK = r"(?i)\[Pasted\s+(text|content|image)\s*#\d+[^\[\]]*\]"
#: How lines begin that a machine wrote: a time or a level, a frame of a stack, a diff, a prompt, or a bracket alone.
MACHINE_LINE = r"^\s*([0-9]{4}-[0-9]{2}-[0-9]{2}[T ]|[0-9]{2}:[0-9]{2}:[0-9]{2}|\[[0-9A-Z]|(DEBUG|INFO|WARN|ERROR|FATAL)\b|at [A-Za-z0-9_.$]+\(|File \"|@@ |[+-]{3} |[$>] |>>> |[{}\[\]();,]+\s*$)"
MACHINE_LINES, MACHINE_SHARE, SOLID_RUN = 6, 0.5, 400


def paste_evidence(text: Column) -> Column:
    """C10: 'marked' where the runtime says that something was pasted, 'likely' where nobody types so, else null.

    Looks: half of at least six lines begin as a machine's, or a run of 400 characters or more has no white space.
    """
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"\S")))
    machine = F.size(F.filter(lines, lambda x: F.rlike(x, F.lit(MACHINE_LINE))))
    listed = (F.size(lines) >= MACHINE_LINES) & (machine >= MACHINE_SHARE * F.size(lines))
    return F.when(F.rlike(text, F.lit(PASTE_MARK)), "marked").when(listed | F.rlike(text, F.lit(rf"\S{{{SOLID_RUN},}}")), "likely")


def message_flags(role: Column, kind: Column, parent: Column) -> dict[str, Column]:
    """C11: flags of a message from its role, its kind (message, tool_use, tool_result, thinking, context, protocol) and its parent."""
    dialogue = F.coalesce(role.isin("user", "assistant"), F.lit(False))
    is_kind = lambda *names: F.coalesce(kind.isin(*names), F.lit(False))
    noise = is_kind("tool_use", "tool_result", "context", "protocol") | F.coalesce(role == "system", F.lit(False))
    return {
        "is_dialogue": dialogue,
        "is_tool_use": is_kind("tool_use", "tool_result"),
        "is_thinking": is_kind("thinking"),
        "is_context_dump": is_kind("context"),
        "is_protocol_artifact": is_kind("protocol"),
        "is_noise": noise,
        "is_substantive": dialogue & ~noise & ~is_kind("thinking"),
        "is_branch": parent.isNotNull(),
    }


def token_estimate(words: Column) -> Column:
    """1.3 tokens a word, whole ones; 0 where there is no text."""
    return F.floor(F.coalesce(words, F.lit(0)) * 13 / 10).cast("long")


#: A few marks of each language; the language with most different marks in a text is its own.
MARKS = {
    "python": [r"\bdef \w+\(", r"\bimport \w+", r":\s*\n\s+", r"\bself\b"],
    "javascript": [r"\bfunction\b", r"\b(const|let|var) \w+ =", r"=>", r"console\."],
    "rust": [r"\bfn \w+", r"\blet mut\b", r"\bimpl\b", r"::<"],
    "go": [r"\bfunc \w*\(", r":=", r"\bpackage \w+"],
    "sql": [r"(?i)\bselect\b", r"(?i)\bfrom\b", r"(?i)\bwhere\b|\bgroup by\b"],
    "bash": [r"^#!.*sh\b", r"\becho\b", r"\$\{?\w+", r"\bfi\b|\bdone\b"],
}


def code_language(text: Column, marks: dict[str, list[str]] | None = None) -> Column:
    """The language with most marks, two at least, ties to the first by name; null else."""
    counts = F.array(*[F.struct((-sum(F.rlike(text, F.lit(p)).cast("int") for p in ps)).alias("n"), F.lit(name).alias("name")) for name, ps in sorted((marks or MARKS).items())])
    best = F.array_min(counts)
    return F.when(best["n"] <= -2, best["name"])


def bounded(text: Column, most: int) -> Column:
    """C14: white space as single spaces, cut to so many characters with an ellipsis as the last."""
    plain = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(plain) > most, F.concat(F.rtrim(F.substring(plain, 1, most - 1)), F.lit("…"))).otherwise(plain)


def auto_tags(origin: Column, repos: Column, continuation: Column, depth: Column, cost: Column) -> Column:
    """Sorted tags of a session's profile; of its repositories the first three."""
    optional = F.array(F.when(continuation, "continuation"), F.when(depth >= 3, "deep-thread"), F.when(F.size(repos) > 1, "multi-repo"), F.when(cost >= 1.0, "costly"))
    named = F.concat(F.array(F.concat(F.lit("origin:"), origin)), F.transform(F.slice(repos, 1, 3), lambda r: F.concat(F.lit("repo:"), r)), optional)
    return F.array_sort(F.array_distinct(F.array_compact(named)))


def tool_family(tool: Column, detail: Column, families: list[tuple[str, list[str]]] | None = None) -> Column:
    """The family that a tool's name tells, an MCP server's name, or for a generic tool what its command tells; else the tool."""
    families = FAMILIES if families is None else families

    def told(c: Column) -> Column:
        out = F.when(F.lit(False), "")
        for name, words in families:
            out = out.when(F.rlike(F.lower(c), F.lit("|".join(words))), name)
        return out

    name = F.lower(F.coalesce(tool, F.lit("")))
    server = F.replace(F.nullif(F.regexp_extract(name, "^mcp__(.+?)(?:__.*)?$", 1), F.lit("")), F.lit("plugin_"), F.lit(""))
    own = F.coalesce(told(name), server, F.nullif(name, F.lit("")), F.lit("unknown"))
    return F.when(own.isin(GENERIC_TOOLS), F.coalesce(told(detail), own)).otherwise(own)


def evidence_kind(tool: Column, detail: Column) -> Column:
    """What kind of act a call is."""
    family = tool_family(tool, F.lit(None).cast("string"))
    return (
        F.when(F.startswith(F.lower(tool), F.lit("mcp__")), "mcp_tool_call")
        .when(family.isin(GENERIC_TOOLS), "command_detail")
        .when(family.isin("apply_patch", "edit"), "edit_content")
        .when(family == "agent", "subagent")
        .when(family == "update_plan", "agent_planning")
        .when(family == "web_search_call", "web_search")
        .otherwise("tool_call")
    )
