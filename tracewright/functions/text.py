"""Column functions over thoughts, observations, paths and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What an observation says on failure and on success, in lower case.
FAILURE_SIGNS = ["traceback (most recent call last)", "error:", "exception:", "failed", "failure", "assertion", "syntaxerror", "nameerror", "typeerror"]
SUCCESS_SIGNS = ["success", "passed", "has been edited", "created successfully"]
EDITOR = "str_replace_editor"


#: What the editor says of an edit, and of a range that it rejects (in lower case).
EDITED, NOT_FOUND, SEVERAL, OLD, SAME = "has been edited.", "did not appear verbatim", "Multiple occurrences of old_str", "old_str", "is the same as new_str"
BAD_RANGE = ["view_range must be in the format", "invalid view_range", "invalid view range", "invalid line range"]
BAD_RANGE_PATTERN, NO_PATH_PATTERN = r"view_range.*(?:must|expected|requires).*?(?:two|2)", r"^the path .+ does not exist\. please provide a valid path\.?$"


def any_of(text: Column, signs: list[str]) -> Column:
    out = F.lit(False)
    for s in signs:
        out = out | F.contains(text, F.lit(s))
    return out


def thought_length_raw(thought: Column) -> Column:
    return F.length(F.coalesce(thought, F.lit(""))).cast("long")


def thought_length_clean(thought: Column) -> Column:
    """Characters left once fenced, back-ticked and quoted spans are gone."""
    text = F.coalesce(thought, F.lit(""))
    for span in ("(?s)```.*?```", "`[^`]*`", '"[^"]*"', "'[^']*'"):
        text = F.regexp_replace(text, span, "")
    return F.length(text).cast("long")


def edit_status(tool: Column, subcommand: Column, observation: Column, view_range: Column | None = None, args: Column | None = None) -> Column:
    """What the editor says of a replacement or a view; null for anything else. view_range: an array of whole numbers, or
    null; args: a VARIANT whose view_range may be anything (it should be two whole numbers)."""
    low = F.lower(F.trim(F.coalesce(observation, F.lit(""))))
    says = lambda text: F.contains(observation, F.lit(text))
    replaced = (
        F.when(F.coalesce(observation, F.lit("")) == "", None)
        .when(says(EDITED), "success")
        .when(says(NOT_FOUND), "failure: not found")
        .when(says(SEVERAL), "failure: multiple occurrences")
        .when(says(OLD) & says(SAME), "failure: no change")
        .otherwise("failure: unknown")
    )
    malformed = F.lit(False) if view_range is None else F.coalesce(view_range.isNotNull() & (F.size(view_range) != 2), F.lit(False))
    if args is not None:
        malformed = malformed | ~F.coalesce(F.try_variant_get(args, "$.view_range", "string").rlike(r"^\[-?\d+,-?\d+\]$"), F.lit(True))
    told = any_of(low, BAD_RANGE) | low.rlike(BAD_RANGE_PATTERN)
    viewed = F.when(low.rlike(NO_PATH_PATTERN), "failure: path does not exist").when(malformed | told, "failure: invalid view range")
    return F.when((tool == EDITOR) & (subcommand == "str_replace"), replaced).when((tool == EDITOR) & (subcommand == "view"), viewed)


def observation_outcome(tool: Column, subcommand: Column, observation: Column) -> Column:
    """failure, success or neutral; a view shows any text, so only the editor's own complaints count for it."""
    low = F.lower(observation)
    view = (tool == EDITOR) & (subcommand == "view")
    failed = F.coalesce(edit_status(tool, subcommand, observation).startswith("failure"), F.lit(False))
    return (
        F.when(F.coalesce(observation, F.lit("")) == "", "neutral")
        .when(F.coalesce(view, F.lit(False)), F.when(failed, "failure").otherwise("neutral"))
        .when(any_of(low, FAILURE_SIGNS), "failure")
        .when(any_of(low, SUCCESS_SIGNS), "success")
        .otherwise("neutral")
    )


def command_outcome(tool: Column, subcommand: Column, observation: Column) -> Column:
    """failure, success or null of a command, from the editor's status or what a test run prints."""
    obs = F.coalesce(observation, F.lit(""))
    status = edit_status(tool, subcommand, observation)
    return (
        F.when(F.coalesce(status.startswith("failure"), F.lit(False)), "failure")
        .when(F.coalesce(status == "success", F.lit(False)), "success")
        .when(F.coalesce((tool == EDITOR) & (subcommand == "view"), F.lit(False)), None)
        .when(F.contains(obs, F.lit("Traceback (most recent call last):")) | obs.rlike(r"(?i)\b[1-9]\d*\s+(?:failed|errors?)\b"), "failure")
        .when(obs.rlike(r"(?i)\b\d+\s+passed\b"), "success")
        .when(any_of(obs, ["FAILURES", "ERRORS", "INTERNALERROR"]), "failure")
    )


def explicit_outcome(is_error: Column, exit_code: Column, observation: Column, otherwise: Column) -> Column:
    """What the harness says comes first: an error flag, an exit code, or one that the text tells."""
    told = F.regexp_extract(F.coalesce(observation, F.lit("")), r"(?i)exit code:?\s*(-?\d+)", 1)
    code = F.coalesce(exit_code.cast("long"), F.nullif(told, F.lit("")).cast("long"))
    return F.when(F.coalesce(is_error, F.lit(False)), "failure").when(code != 0, "failure").when(code == 0, F.coalesce(otherwise, F.lit("success"))).otherwise(otherwise)


def clean_text(text: Column) -> Column:
    """Control characters but tab, line end and carriage return become U+FFFD."""
    return F.regexp_replace(text, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]", "\ufffd")


def normal_path(path: Column) -> Column:
    """Without quotes and a :line[:column] at the end, no doubled or closing slashes."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(path), "^[\"'`]+|[\"'`,;]+$", ""), r":\d+(?::\d+)?$", "")
    return F.regexp_replace(F.regexp_replace(bare, "/{2,}", "/"), "(?<=.)/$", "")


def looks_like_file(path: Column) -> Column:
    return path.rlike(r"(?:^|/)[^/\s]+\.[A-Za-z0-9_]{1,8}$") & ~path.rlike(r"^[a-z]+://")


def paths_in(text: Column) -> Column:
    """All paths in any argument, each once, in order."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?:[\w.~-]*/)+[\w.-]+(?::\d+(?::\d+)?)?|\b[\w-]+\.[A-Za-z]\w{0,7}\b"), F.lit(0))
    return F.array_distinct(F.transform(found, normal_path))


def file_activity(phase: Column, mentioned: Column) -> Column:
    return F.when(phase == "patch", "edit").when(mentioned, "view").otherwise("seen")


def plan_activity(name: Column) -> Column:
    return F.when(F.regexp_replace(F.lower(name), "[_-]", "").isin("updateplan", "todowrite"), "edit").otherwise("view")


def compact_label(label: Column, steps: Column, path: Column) -> Column:
    """The action, the last two parts of its path, and its steps."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    tail = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), "/")
    shown = F.when(F.size(steps) > 4, F.concat(F.array_join(F.slice(F.transform(steps, lambda s: s.cast("string")), 1, 3), ","), F.lit(",..,"), F.element_at(steps, -1).cast("string"))).otherwise(F.array_join(F.transform(steps, lambda s: s.cast("string")), ","))
    return F.concat_ws(" ", label, F.nullif(tail, F.lit("")), F.concat(F.lit("["), shown, F.lit("]")))
