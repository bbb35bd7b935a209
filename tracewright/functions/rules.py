"""The phase class of an action as one ordered expression: patch, plan, general, loc, or ctx where history decides.

What follows a patch differs in just two ways, so history stays out of the rules: ctx is validation after a patch and
localization before, and viewing tests (ctx) likewise; all else is fixed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words and commands that the classes go by.
TEST_HINTS = ["test_", "repro", "reproduc", "debug", "_test", "/tests/", "/test/"]
EXTENDED_TEST_HINTS = [*TEST_HINTS, "tests/", "test/"]
READ = ["grep", "find", "cat", "ls", "head", "tail", "awk", "nl"]
EDIT = ["touch"]
EXTENDED_EDIT = ["touch", "cp", "rm", "mkdir"]
OBSERVE = [
    "date", "echo", "sleep", "curl", "ps", "taskoutput", "wc", "nvidia-smi", "which", "df", "free", "env", "pgrep", "write_stdin", "timeout", "wait", "tmux", "exec",
    "exec_command", "powershell", "run_shell_command", "bash", "mcp__environment__bash",
]
SETUP, NAVIGATE, PATCHERS = ["set_env"], ["cd"], ["apply_patch", "patch"]
GENERAL = ["taskstop", "taskupdate", "taskcreate", "export", "mcp__environment__finish", "agent", "#"]
LOOKUP = ["toolsearch", "websearch", "webfetch"]
EDITOR_EDITS = ["create", "str_replace", "insert", "undo_edit"]
RUNNERS = ["python", "python3", "python2", "pytest", "pylint"]
ANALYSERS, FORMATTERS = ["mypy", "pyright", "ruff", "flake8"], ["black", "isort"]
PLANS = ["updateplan", "enterplanmode", "exitplanmode", "todowrite"]
#: What makes a token a path, and what makes it a redirection: whole, at its start, anywhere in it.
PATHISH = r"(^[/~.]|/|\.py$)"
REDIRECTIONS = [">", ">>", "1>", "2>", ">|", "<<<", "<<", "<>", ">&", "2>&1"]
REDIRECTION_STARTS = [">", ">>", "1>", "2>"]
REDIRECTION_PARTS = [" <<", "<<", " >>", ">>", " 1>", " 2>", " >", " >|", "<>", ">&", "2>&1", " tee "]

#: What scripts of node, and commands of uv and git, write, check or read.
NODE_WRITES = r"\b(?:writefile|appendfile|rename|unlink|rm|mkdir|copyfile)(?:sync)?\s*\("
UV_WRITES, UV_CHECKS = r"\b(?:add|remove)\b", r"\b(?:pytest|unittest|mypy|pyright|ruff|flake8|pylint|test)\b"
GIT_CHECKS, GIT_WRITES = r"\bdiff\s+--check\b", r"\b(?:apply|cherry-pick|merge|revert)\b"
GIT_READS = r"\b(?:status|diff|show|log|grep|ls-files|branch|rev-parse)\b"

#: A here-document and its body; a redirection and its target.
BODY = r"""(?s)<<['"]?(\w+)['"]?\s*\n(.*?)\n\1"""
TARGET = r">\s*([^\s;&|]+)"
#: How Python code names the files it writes: the last group is the file, or the variable that holds it.
OPENED = r"""(?<![\w.])open\(\s*(['"])([^'"]+)\1\s*,\s*['"][^'"]*[wax]"""
OPENED_NAME = r"""(?<![\w.])open\(\s*(\w+)\s*,\s*['"][^'"]*[wax]"""
PATH_WRITTEN = r"""(?<![\w.])Path\(\s*(['"])([^'"]+)\1[^()]*\)\s*\.write_(?:text|bytes)\("""
NAME_WRITTEN = r"""(?<![\w.])(\w+)\.write_(?:text|bytes)\("""
IS_PATH = r"""(?<![\w.])(\w+)\s*=\s*Path\(\s*['"]([^'"]+)['"][^()]*\)(?!\s*[/.\[])"""
IS_TEXT = r"""(?<![\w.])(\w+)\s*=\s*['"]([^'"\n]*)['"](?!\s*[.%+*\[])"""


def contains_any(text: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for part in parts:
        out = out | F.contains(text, F.lit(part))
    return out


def hinted(texts: Column, hints: list[str]) -> Column:
    """Whether one of the texts holds a test hint."""
    return F.exists(texts, lambda t: contains_any(t, hints))


def paths_of(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: t.rlike(PATHISH))


def redirects(tokens: Column) -> Column:
    """Whether a token is, begins with or holds a redirection, or is a tee."""

    def one(t: Column) -> Column:
        out = t.isin(*REDIRECTIONS, "tee") | contains_any(t, REDIRECTION_PARTS)
        for start in REDIRECTION_STARTS:
            out = out | t.startswith(start)
        return out

    return F.exists(tokens, one)


def base_name(command: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(command, r"[/\\]+$", ""), r"([^/\\]*)$", 1)


def edited_by_code(code: Column) -> Column:
    """Files that Python code writes: by name, through Path, or through a variable that last was given either."""
    every = lambda p, g: F.regexp_extract_all(code, F.lit(p), F.lit(g))

    def held(used: str, given: str) -> Column:
        pairs = F.arrays_zip(every(given, 1).alias("n"), every(given, 2).alias("v"))
        return F.transform(every(used, 1), lambda u: F.try_element_at(F.filter(pairs, lambda z: z["n"] == u), F.lit(-1))["v"])

    found = F.concat(every(OPENED, 2), every(PATH_WRITTEN, 2), held(OPENED_NAME, IS_TEXT), held(NAME_WRITTEN, IS_PATH))
    return F.filter(F.array_distinct(found), lambda f: f.isNotNull())


def plan_name(name: Column) -> Column:
    """A tool's name as plans are told by: its last part, in lower case, without _ and -."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_extract(F.coalesce(name, F.lit("")), r"([^/]*)$", 1))), "[_-]", "")


def phase_class(tool: Column, subcommand: Column, command: Column, tokens: Column, flags: Column, framework: Column) -> Column:
    """tokens: array of strings; flags: map of strings; framework: codex and claude get the extended rules."""
    extended = F.coalesce(framework.isin("codex", "claude"), F.lit(False))
    given = F.filter(F.coalesce(tokens, F.array().cast("array<string>")), lambda t: t.isNotNull())
    tokens = F.transform(given, F.lower)
    has = lambda name: F.coalesce(F.map_contains_key(flags, F.lit(name)), F.lit(False))
    raw = F.lower(F.trim(F.coalesce(command, F.lit(""))))
    cmd = F.when(extended, base_name(raw)).otherwise(raw)
    name = base_name(F.lower(F.trim(F.coalesce(tool, F.lit("")))))
    either = lambda names: extended & (cmd.isin(names) | name.isin(names))
    text = F.array_join(tokens, " ")
    tests = lambda files: F.when(extended, hinted(files, EXTENDED_TEST_HINTS)).otherwise(hinted(files, TEST_HINTS))
    paths = paths_of(tokens)
    test, writes = tests(paths), redirects(tokens)
    edits = F.when(test, "ctx").otherwise("patch")
    reads = F.when(test, "ctx").otherwise("loc")
    plans = extended & (plan_name(tool).isin(PLANS) | plan_name(subcommand).isin(PLANS) | plan_name(command).isin(PLANS))
    sub = F.lower(F.coalesce(subcommand, F.lit("")))
    lowered = lambda files: F.transform(files, F.lower)

    # Python: a redirection edits; else code that edits files goes by them; else it runs.
    heredoc = has("__heredoc__")
    is_code = lambda t: ((F.length(t) > 20) | t.rlike(r"\n|Path\(|open\(|write")) & ~t.isin("-", ">")
    inline = F.element_at(flags, "c")
    code = F.coalesce(F.when(heredoc, F.get(F.filter(given, is_code), F.lit(0))), F.when(F.length(inline) > 5, inline), F.lit(""))
    files = edited_by_code(code)
    runner = F.when(writes & ~heredoc, edits).when(F.size(files) > 0, F.when(tests(lowered(files)), "ctx").otherwise("patch")).otherwise("ctx")

    # A whole script: by the files it writes, then by what it runs.
    whole = F.coalesce(F.get(given, F.lit(0)), F.lit(""))
    low = F.lower(whole)
    runs_code = F.contains(low, F.lit("python")) & F.contains(whole, F.lit("<<"))
    bodies = F.when(runs_code, F.regexp_extract_all(whole, F.lit(BODY), F.lit(2))).otherwise(F.array().cast("array<string>"))
    by_code = F.flatten(F.transform(bodies, edited_by_code))
    targets = F.concat(by_code, F.regexp_extract_all(whole, F.lit(TARGET), F.lit(1)))
    plain = F.exists(targets, lambda t: F.when(extended, ~contains_any(F.lower(t), EXTENDED_TEST_HINTS)).otherwise(~contains_any(F.lower(t), TEST_HINTS)))
    compound = F.when(plain, "patch").when((runs_code & (F.size(by_code) == 0)) | (F.size(targets) > 0) | tests(F.array(low)), "ctx").otherwise("general")

    reader = cmd.isin(READ) | ((cmd == "sed") & ~has("i") & has("n")) | ((cmd == "perl") & ~has("i") & (has("n") | has("p")) & (F.size(paths) > 0))
    return (
        F.when(plans, "plan")
        .when(either(NAVIGATE), "loc")
        .when(either(SETUP) | either(GENERAL), "general")
        .when(either(LOOKUP), "loc")
        .when(either(PATCHERS), "patch")
        .when(either(OBSERVE) & ~writes, "ctx")
        .when(cmd == "complex_command", compound)
        .when(extended & (cmd == "node"), F.when(text.rlike(NODE_WRITES), "patch").otherwise("ctx"))
        .when(extended & (cmd == "uv"), F.when(text.rlike(UV_WRITES), "patch").when(text.rlike(UV_CHECKS), "ctx").otherwise("general"))
        .when(extended & (cmd == "git"), F.when(text.rlike(GIT_CHECKS), "ctx").when(text.rlike(GIT_READS), "loc").when(text.rlike(GIT_WRITES), "patch").otherwise("general"))
        .when(F.lower(F.coalesce(tool, F.lit(""))) == "str_replace_editor", F.when(sub.isin(EDITOR_EDITS), edits).when(sub == "view", reads).otherwise("general"))
        .when(cmd.isin(RUNNERS), runner)
        .when(extended & (cmd.isin(ANALYSERS) | (cmd.isin(FORMATTERS) & (has("check") | has("check-only") | has("diff")))), "ctx")
        .when(reader, F.when(writes, edits).otherwise(reads))
        .when((cmd == "perl") & ~has("i") & test, "ctx")
        .when(F.when(extended, cmd.isin(EXTENDED_EDIT)).otherwise(cmd.isin(EDIT)) | (cmd.isin("sed", "perl") & has("i")), edits)
        .when(writes, edits)
        .otherwise("general")
    )


#: The tools and commands of native sessions, by what they do.
SHELL_TOOLS = ["shell_command", "exec_command", "local_shell", "local_shell_call", "powershell", "run_shell_command", "bash", "mcp__environment__bash"]
READ_TOOL_HINTS, EDIT_TOOL_HINTS = ["read", "view", "find", "search", "list", "open", "grep", "fetch"], ["write", "edit", "create", "replace", "patch"]
PROBES = [
    "date", "curl", "sleep", "pgrep", "pidof", "ps", "lsof", "ss", "netstat", "nc", "ncat", "telnet", "uvicorn", "gunicorn", "node", "deno", "bun", "java", "pkill", "kill", "killall",
    "wait", "timeout", "npm", "printf", "chmod", "pwd", "which", "wc", "file", "du", "free", "df", "env", "nvidia-smi", "tmux", "write_stdin", "command", "bash", "diff", "playwright",
]
SHELL_EDITS = ["mkdir", "rmdir", "cp", "mv", "rm", "ln", "install", "truncate"]
SHELL_READS = ["rg", "grep", "find", "fd", "cat", "ls", "dir", "tree", "head", "tail", "type", "get-content", "get-childitem", "select-string", "resolve-path"]
SHELL_GIT_READS = r"\b(status|diff|show|log|grep|ls-files)\b"
POWERSHELL_WRITES = ["set-content", "add-content", "out-file", "new-item", "remove-item"]
TEST_RUNS = [
    "pytest", "unittest", "npm test", "npm run test", "pnpm test", "yarn test", "cargo test", "go test", "dotnet test", "mvn test", "gradle test", "ruff check", "mypy", "pyright",
    "eslint", "black --check", "isort --check", "node --check", "tsc --noemit",
]
#: Tools that read, write and edit files, and the argument that names the file.
READERS, WRITERS, EDITORS = ["read", "readfile", "readmediafile"], ["write", "writefile"], ["edit", "strreplace", "str_replace"]
PATH_ARGUMENTS = ["path", "file", "file_path", "filename"]


def codex_tool_class(name: Column, arguments: Column) -> Column:
    """The class of a tool that is no shell; arguments: array of its values. Such a tool is classed without history, so
    what would depend on it is loc."""
    low = F.lower(F.coalesce(name, F.lit("")))
    none = F.lit(None).cast("string")
    own = phase_class(none, none, low, arguments, F.create_map().cast("map<string,string>"), F.lit("codex"))
    return (
        F.when(plan_name(name).isin(PLANS), "plan")
        .when(low.isin(PATCHERS) | contains_any(low, EDIT_TOOL_HINTS), "patch")
        .when((low == "web_search") | contains_any(low, READ_TOOL_HINTS), "loc")
        .otherwise(F.when(own == "ctx", "loc").otherwise(own))
    )


def codex_shell_class(tool: Column, subcommand: Column, command: Column, tokens: Column, flags: Column) -> Column:
    """The class of a shell command of a native session: probes, then the base rules, then tables of common verbs."""
    cmd = F.regexp_extract(F.replace(F.lower(F.trim(F.coalesce(command, F.lit("")))), F.lit("\\"), F.lit("/")), r"([^/]*)$", 1)
    words = F.lower(F.array_join(F.coalesce(tokens, F.array().cast("array<string>")), " "))
    options = F.array_join(F.transform(F.map_entries(F.coalesce(flags, F.create_map().cast("map<string,string>"))), lambda e: F.concat_ws(" ", e["key"], e["value"])), " ")
    full = F.lower(F.concat_ws(" ", cmd, options, words))
    base = phase_class(tool, subcommand, command, tokens, flags, F.lit(None).cast("string"))
    return (
        F.when(plan_name(tool).isin(PLANS) | plan_name(subcommand).isin(PLANS) | plan_name(command).isin(PLANS), "plan")
        .when(cmd == "apply_patch", "patch")
        .when((cmd == "node") & full.rlike(NODE_WRITES), "patch")
        .when(cmd.isin(PROBES), "ctx")
        .when(base != "general", base)
        .when(cmd.isin(SHELL_READS) | ((cmd == "git") & words.rlike(SHELL_GIT_READS)), "loc")
        .when(cmd.isin(POWERSHELL_WRITES + SHELL_EDITS), "patch")
        .when(contains_any(full, TEST_RUNS), "ctx")
        .otherwise("general")
    )


def claude_tool_class(name: Column, arguments: Column) -> Column:
    """The class of a tool by its name and its map of arguments; relative paths count as below the working folder."""
    low = F.lower(F.coalesce(name, F.lit("")))
    given = F.coalesce(arguments, F.create_map().cast("map<string,string>"))
    placed = F.transform_values(given, lambda k, v: F.when(k.isin(PATH_ARGUMENTS) & (v != "") & ~v.rlike(r"^(?:/|\./|\.\./|~)"), F.concat(F.lit("./"), v)).otherwise(v))
    tokens, none, no_flags = F.map_values(placed), F.lit(None).cast("string"), F.create_map().cast("map<string,string>")
    editor = F.when(low.isin(READERS), "view").when(low.isin(WRITERS), "create").when(low.isin(EDITORS), "str_replace")
    command = F.when(low == "glob", "find").otherwise(low)
    as_file = phase_class(F.lit("str_replace_editor"), editor, F.lit(""), tokens, no_flags, F.lit("claude"))
    as_command = phase_class(none, none, command, tokens, no_flags, F.lit("claude"))
    return F.when(plan_name(name).isin(PLANS), "plan").when(editor.isNotNull(), as_file).otherwise(as_command)
