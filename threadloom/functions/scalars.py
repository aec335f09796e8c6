"""Scalar expressions: labels, keys, dates and text folding."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def group_key(c: Column) -> Column:
    """A3: a missing value is told apart from the empty and the 'unknown' one."""
    return F.coalesce(c.cast("string"), F.lit("[missing]"))


def week_key(ts: Column) -> Column:
    """C4: ISO week as YYYY-Www; 'undated' where there is no time."""
    week = F.concat(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("-W"), F.lpad(F.extract(F.lit("WEEK"), ts).cast("string"), 2, "0"))
    return F.coalesce(week, F.lit("undated"))


def result_state(found: Column, is_error: Column, exit_code: Column) -> Column:
    """The exit code wins over the error flag; no outcome is never a success."""
    return (
        F.when(~found, "no_result")
        .when(is_error.isNull() & exit_code.isNull(), "outcome_unknown")
        .when(exit_code.isNotNull() & (exit_code != 0), "outcome_error")
        .when(exit_code.isNull() & (is_error == 1), "outcome_error")
        .otherwise("outcome_success")
    )


def under_path(path: Column, prefix: str) -> Column:
    """the path is the prefix or below it, by whole components."""
    prefix = prefix.replace("\\", "/").rstrip("/")
    path = F.replace(path, F.lit("\\"), F.lit("/"))
    return (path == prefix) | path.startswith(f"{prefix}/")


def fold_stroke(c: Column) -> Column:
    """R2."""
    return F.translate(c, "łŁ", "lL")


def _bases() -> tuple[str, str]:
    """Small Latin letters with marks and, in the same places, those letters alone; then the marks."""
    pairs = [(chr(k), unicodedata.normalize("NFD", chr(k))[0]) for block in ((0xDF, 0x250), (0x1E00, 0x1F00)) for k in range(*block)]
    pairs = [(a, b) for a, b in pairs if a == a.lower() and "a" <= b <= "z"] + [("ł", "l")]  # R2: its stroke is no mark
    return "".join(a for a, _ in pairs) + "".join(map(chr, range(0x300, 0x370))), "".join(b for _, b in pairs)


_MARKED, _PLAIN = _bases()
WORD = r"[\p{L}\p{N}]+"
#: The same words in a text that is not folded, where a letter's mark may stand by itself.
RAW_WORD = r"[\p{L}\p{N}][\p{L}\p{N}\u0300-\u036F]*"


def folded(text: Column) -> Column:
    """Lower case, Latin letters without their diacritics; a text of ASCII alone has none."""
    low = F.lower(text)
    return F.when(F.octet_length(text) == F.length(text), low).otherwise(F.translate(low, _MARKED, _PLAIN))


def terms(text: Column) -> Column:
    """The folded words, of letters and digits of all scripts."""
    return F.regexp_extract_all(folded(text), F.lit(WORD), F.lit(0))


def query_terms(words: list[str]) -> list[str]:
    """What a user asks for, folded and cut into terms as texts are; each once."""
    table = str.maketrans(_MARKED[: len(_PLAIN)], _PLAIN, _MARKED[len(_PLAIN) :])
    return list(dict.fromkeys(t for w in words for t in re.findall(r"[^\W_]+", w.lower().translate(table))))


def correlation_label(r: Column) -> Column:
    """I21."""
    a = F.abs(r)
    return F.when(r.isNull(), "undefined").when(a >= 0.7, "strong").when(a >= 0.4, "moderate").when(a >= 0.2, "weak").otherwise("negligible")


def workflow_shape(c: dict[str, Column]) -> Column:
    """I2, the first that holds; c: calls, messages, user_messages, dispatches, reads, edits, runs, has_text."""
    ratio = F.round(c["calls"] / F.greatest(c["messages"], F.lit(1)), 4)
    return (
        F.when(c["dispatches"] > 0, "subagent_dispatch")
        .when((ratio < 0.1) & c["has_text"], "chat")
        .when((c["reads"] >= 3) & (c["edits"] == 0) & (c["user_messages"] <= 2), "batch_review")
        .when(((c["edits"] > 0) | (c["runs"] >= 3)) & (ratio >= 0.2) & (c["messages"] >= 10), "agentic_loop")
        .when((c["reads"] > 0) | (ratio >= 0.1), "exploratory")
        .otherwise("unknown")
    )


def work_label(edits: Column, agents: Column, searches: Column, reads: Column, git: Column, shell: Column, calls: Column) -> Column:
    """What a range of actions was for, the first that holds."""
    return (
        F.when(edits >= 2, "implementation")
        .when((agents >= 2) & (edits == 0), "planning")
        .when((searches >= 2) | ((reads >= 3) & (edits == 0)), "research")
        .when(git >= 1, "review")
        .when(shell >= 2, "implementation")
        .when(calls == 0, "session")
        .otherwise("implementation")
    )


def streak_severity(n: Column) -> Column:
    """I25."""
    return F.when(n >= 7, "high").when(n >= 4, "medium").when(n >= 2, "low")


def similarity_band(score: Column) -> Column:
    """I65."""
    return F.when(score >= 0.75, "strong").when(score >= 0.55, "moderate").otherwise("weak")


def followup_class(text: Column, markers: list[str]) -> Column:
    """What the turn after a failure does; none or under 20 characters is ambiguous."""
    return F.when(text.isNull() | (F.length(F.trim(text)) < 20), "ambiguous").when(F.rlike(F.lower(text), F.lit("|".join(markers))), "acknowledged").otherwise("silent_proceed")


def value_format(c: Column) -> Column:
    """H4: the format of one value."""
    return (
        F.when(c.isNull(), "null")
        .when(F.rlike(c, F.lit("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")), "uuid")
        .when(F.rlike(c, F.lit("^[0-9]{4}-[0-9]{2}-[0-9]{2}")), "date")
        .when(F.rlike(c, F.lit("^-?[0-9]+$")), "integer")
        .when(F.rlike(c, F.lit(r"^-?[0-9]+\.[0-9]+$")), "decimal")
        .when(F.rlike(c, F.lit("^https?://")), "url")
        .when(F.rlike(c, F.lit(r"^[{\[]")), "json")
        .otherwise("text")
    )
