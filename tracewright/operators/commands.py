"""From shell text to atomic actions, in native expressions: one row for each command of a call."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A separator of commands, or a run of one word's pieces: quoted, escaped or plain; a pipe stands alone. Possessive, so
#: that a piece is read in a loop and once, however long it is.
TOKEN = r"""&&|\|\||;|\n|(?:"(?:[^"\\]++|\\.)*+"|'[^']*+'|\\.|[^\s;&|"'\\]++)++|\||&"""
CONTROL = r"^\s*(?:for|while|until|if|case|function|select)\b|^\s*[({]"
HEREDOC = r"""(?s)^([^\n;&|]*?)<<-?\s*(['"]?)(\w+)\2([^\n]*)\n(.*?)\n?\3\s*$"""
ASSIGN = r"^[A-Za-z_]\w*="


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value reckoned once: lambdas would reckon an expression anew for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def split_commands(toks: Column) -> Column:
    """Arrays of tokens, a new one at each separator; empty ones are left out."""

    def split(toks: Column) -> Column:
        cuts = F.filter(F.transform(toks, lambda t, i: F.when(t.isin("&&", "||", ";", "\n"), i + 1).otherwise(0)), lambda i: i > 0)
        before = lambda ends: F.transform(ends, lambda end, k: F.struct(F.when(k == 0, 0).otherwise(F.get(ends, k - 1)).alias("start"), end.alias("end")))
        parts = let(F.concat(cuts, F.array(F.size(toks) + 1)), before)
        return F.filter(F.transform(parts, lambda p: F.slice(toks, p["start"] + 1, F.greatest(p["end"] - p["start"] - 1, F.lit(0)))), lambda c: F.size(c) > 0)

    return let(toks, split)


def unquoted(token: Column) -> Column:
    bare = F.regexp_replace(token, r"""^"((?s:.*))"$|^'((?s:.*))'$""", "$1$2")
    # Most words hold neither quote nor backslash, and need no pattern.
    held = reduce(or_, [F.contains(token, F.lit(c)) for c in "\"'\\"])
    return F.when(held, F.regexp_replace(bare, r"\\(.)", "$1")).otherwise(token)


def unbalanced(text: Column) -> Column:
    """Whether quotes stay open once whole quoted spans are gone."""
    return F.regexp_replace(text, r"""(?s)\\.|"(?:[^"\\]++|\\.)*+"|'[^']*+'""", "").rlike("""["']""")


#: Commands that take code after -c or -e, options of find and diff that take a value, and those that don't
#: though they have several letters.
INTERPRETERS = ["python", "python3", "bash", "sh", "zsh", "node", "ruby", "perl", "psql", "mysql", "sqlite3"]
FIND_VALUES = [
    "exec", "ok", "name", "iname", "path", "ipath", "type", "xtype", "regex", "iregex", "size", "atime", "mtime", "ctime", "maxdepth", "mindepth", "user", "group", "perm", "printf",
]
DIFF_VALUES = ["label", "ignore-matching-lines"]
FIND_WORDS = ["print", "print0", "delete", "depth", "d", "xdev", "mount", "follow", "ignore_readdir_race", "noignore_readdir_race"]
NO_FLAGS = "map<string,string>"
#: What tells calls apart.
CALL = ["traj", "step_idx", "call_pos"]


def parsed_arguments(command: Column, args: Column) -> Column:
    """A struct of argv (what is no option) and flags: --k=v, --k, bundled short ones; after -c or -e an interpreter takes
    code, and all that follows is argv; find and diff have options with values. Of a repeated option the last counts."""
    option = lambda t: F.substring(t, 2, 1 << 30)
    valued = lambda t: F.coalesce(t.rlike("^-[^-].") & ((command == "find") & option(t).isin(FIND_VALUES) | (command == "diff") & option(t).isin(DIFF_VALUES)), F.lit(False))
    inline = lambda t: t.rlike("^-[ce]$") | t.rlike("^-[^-]*c[^-]*$") & (F.length(t) > 2)
    entry = lambda k, v: F.struct(k.alias("key"), v.alias("value"))
    letters = lambda t: F.filter(F.split(option(t), ""), lambda c: c != "")

    def entries(p: Column) -> Column:
        t, nothing = p["t"], F.lit("true")
        key = F.regexp_extract(t, r"^--([^=]+)", 1)
        long = F.array(entry(key, F.when(F.contains(t, F.lit("=")), unquoted(F.regexp_extract(t, r"(?s)^--[^=]+=(.*)$", 1))).otherwise(nothing)))
        code = F.when(t == "-e", "e").otherwise("c")
        others = F.transform(F.filter(letters(t), lambda c: ~c.isin("c", "e") | (c == "e") & (code == "c") & (F.length(t) > 2)), lambda c: entry(c, nothing))
        with_code = F.concat(others, F.array(entry(code, F.coalesce(unquoted(p["next"]), nothing))))
        words = (command == "find") & option(t).isin(FIND_WORDS)
        one = F.array(entry(option(t), F.when(valued(t), F.coalesce(unquoted(p["next"]), nothing)).otherwise(nothing)))
        return F.when(t.startswith("--"), F.when(key != "", long)).when(p["code"], with_code).when(valued(t) | words, one).otherwise(F.transform(letters(t), lambda c: entry(c, nothing)))

    def flags(found: Column) -> Column:
        last = lambda keys: F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(found, lambda e: e["key"] == k), -1)["value"]))
        return let(F.array_distinct(F.transform(found, lambda e: e["key"])), last)

    def parsed(args: Column, at: Column) -> Column:
        head = F.when(at > 0, F.slice(args, F.lit(1), at)).otherwise(args)

        def told(placed: Column) -> Column:
            options = F.filter(placed, lambda p: ~p["is_value"] & p["t"].rlike("^-."))
            found = F.flatten(F.filter(F.transform(options, entries), lambda e: e.isNotNull()))
            plain = F.transform(F.filter(placed, lambda p: ~p["is_value"] & ~p["t"].rlike("^-.")), lambda p: unquoted(p["t"]))
            after = F.when(at > 0, F.transform(F.slice(args, at + 2, F.greatest(F.size(args) - at - 1, F.lit(0))), unquoted)).otherwise(F.array().cast("array<string>"))
            return F.struct(F.concat(plain, after).alias("argv"), let(found, flags).alias("flags"))

        placed = lambda head: F.transform(head, lambda t, i: F.struct(t.alias("t"), F.when(i > 0, valued(F.get(head, i - 1))).otherwise(False).alias("is_value"), F.get(args, i + 1).alias("next"), ((at > 0) & (i == at - 1)).alias("code")))
        return let(let(head, placed), told)

    code_at = lambda args: F.when(command.isin(INTERPRETERS), F.array_position(F.transform(args, inline), True)).otherwise(0).cast("int")  # from 1
    nothing = F.array().cast("array<string>")
    plain = F.struct(F.transform(args, unquoted).alias("argv"), F.map_from_arrays(nothing, nothing).alias("flags"))
    # Without a dash at the start of a word there is no option, so all words are argv.
    return F.when(~F.exists(args, lambda t: t.startswith("-")), plain).otherwise(let(args, lambda a: let(code_at(a), lambda at: parsed(a, at))))


def shell_actions(calls: DataFrame, *, keep_cd: bool = False, keys: list[str] = CALL) -> DataFrame:
    """The keys, cmd_pos, command, argv, flags, has_cd, tokens for calls (the keys, text).

    A control structure, a group, open quotes: one complex_command with the whole text. One heredoc: its arguments,
    its body and a file it goes to. NAME=value, once or more before a command, is a set_env action of its own. Bare true and false
    are left out; a cd that others follow is left out and marks them (keep_cd: it stays). Text that yields nothing is a command of its
    first word with the raw text. tokens: the words of a plain command, unquoted, in order; else null."""
    text = F.trim(F.coalesce("text", F.lit("")))
    lead = F.regexp_extract(text, HEREDOC, 1)
    is_heredoc = (lead != "") & ~lead.rlike(CONTROL) & ~unbalanced(lead)
    into = F.regexp_extract(F.regexp_extract(text, HEREDOC, 4), r">\s*(\S+)", 1)
    target = F.when(into != "", F.array(F.lit(">"), into)).otherwise(F.array().cast("array<string>"))
    doc = F.concat(tokens(lead), F.array(F.lit("\u0001heredoc"), F.regexp_extract(text, HEREDOC, 5)), target)
    complex_ = F.array(F.array(F.lit("complex_command"), text))
    parts = F.when(is_heredoc, F.array(doc)).when(text.rlike(CONTROL) | unbalanced(text), complex_).otherwise(split_commands(tokens(text)))
    rows = calls.select(*keys, text.alias("_text"), F.posexplode_outer(parts).alias("_p", "_t"))
    first = F.array_position(F.transform("_t", lambda x: x.rlike(ASSIGN)), False).cast("int")
    leading = F.when(first > 0, first - 1).otherwise(F.size("_t"))
    rows = rows.withColumn("_env", F.when(F.col("_t")[0] == "complex_command", F.array().cast("array<string>")).otherwise(F.slice("_t", 1, leading)))
    env = F.when(F.size("_env") > 0, F.array(F.array(F.lit("set_env"), F.array_join("_env", " ")))).otherwise(F.array().cast("array<array<string>>"))
    rest = F.slice("_t", F.size("_env") + 1, F.greatest(F.size("_t") - F.size("_env"), F.lit(0)))
    each = F.filter(F.concat(env, F.array(rest)), lambda c: F.size(c) > 0)
    rows = rows.select(*keys, "_text", "_p", F.posexplode_outer(F.when(F.col("_t").isNotNull(), each)).alias("_q", "_c"))
    fallback = F.coalesce(F.nullif(F.regexp_extract("_text", r"^(\S+)", 1), F.lit("")), F.lit("bash"))
    here = F.array_position("_c", "\u0001heredoc")
    args = F.slice("_c", F.lit(2), F.greatest(F.size("_c") - 1, F.lit(0)))
    rows = rows.withColumn("_cmd", unquoted(F.col("_c")[0]))
    parts_ = parsed_arguments(F.col("_cmd"), args)
    whole = F.col("_c")[0].isin("complex_command", "set_env") | (here > 0)
    argv = F.when(F.col("_c").isNull(), F.array("_text")).when(here > 0, F.filter(args, lambda x: ~x.rlike("^-[A-Za-z]|\u0001"))).when(whole, args).otherwise(F.col("_parsed.argv"))
    flags = F.when(here > 0, F.map_from_arrays(F.array(F.lit("__heredoc__")), F.array(F.lit("true")))).when(F.col("_c").isNull() | whole, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).otherwise(F.col("_parsed.flags"))
    words = F.when(~whole, F.transform("_c", unquoted))
    out = rows.withColumn("_parsed", parts_).select(*keys, "_p", "_q", F.coalesce("_cmd", fallback).alias("command"), argv.alias("argv"), flags.alias("flags"), words.alias("tokens"))
    out = out.where(~(F.col("command").isin("true", "false") & (F.size("argv") == 0) & (F.size("flags") == 0)))
    w = Window.partitionBy(*keys).orderBy("_p", "_q")
    out = out.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).withColumn("_r", F.row_number().over(w)).withColumn("has_cd", (F.first("command").over(w) == "cd") & (F.col("_n") > 1))
    if keep_cd:  # every cd stays, and marks what follows it
        saw = F.max((F.col("command") == "cd").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
        out = out.withColumn("has_cd", (F.coalesce(saw, F.lit(0)) > 0) & (F.col("command") != "cd"))
    else:
        out = out.where(~(F.col("has_cd") & (F.col("_r") == 1)))
    return out.withColumn("cmd_pos", F.row_number().over(w).cast("long") - 1).select(*keys, "cmd_pos", "command", "argv", "flags", "has_cd", "tokens")


def patch_files(patch: Column) -> Column:
    """Paths that a patch names, each once, in order."""
    own = F.regexp_extract_all(patch, F.lit(r"(?m)^\*\*\* (?:Update|Add|Delete) File: (.+)$"), F.lit(1))
    diff = F.regexp_extract_all(patch, F.lit(r"(?m)^\+\+\+ b/(\S+)"), F.lit(1))
    return F.array_distinct(F.transform(F.concat(own, diff), lambda p: F.trim(p)))


#: How a script calls a shell, the key of its command, and how far from the call a command may end.
SHELL_CALL, COMMAND_KEY, NEAR = r"tools\.(?:shell_command|exec_command)\s*\(", r"\b(?:command|cmd)\s*:\s*", 20_000
STRING = r"""(?s)("(?:[^"\\]++|\\.)*+"|'(?:[^'\\]++|\\.)*+'|`(?:[^`\\]++|\\.)*+`)"""


def nested_commands(source: Column) -> Column:
    """The first string given as command: or cmd: within 20,000 characters after each call of a shell in a script,
    unescaped: as JSON in double quotes, else quotes, line ends and backslashes alone."""
    near = F.regexp_extract_all(source, F.lit(rf"{SHELL_CALL}(?=((?s:.{{0,{NEAR}}})))"), F.lit(1))
    found = F.filter(F.transform(near, lambda t: F.regexp_extract(t, COMMAND_KEY + STRING, 1)), lambda t: t != "")
    inner = lambda t: F.substring(t, F.lit(2), F.length(t) - 2)
    plain = lambda t, q: F.replace(F.replace(F.replace(inner(t), F.lit("\\" + q), F.lit(q)), F.lit("\\n"), F.lit("\n")), F.lit("\\\\"), F.lit("\\"))
    json = lambda t: F.coalesce(F.from_json(F.concat(F.lit("["), t, F.lit("]")), "array<string>")[0], inner(t))
    return F.transform(found, lambda t: F.when(t.startswith('"'), json(t)).when(t.startswith("'"), plain(t, "'")).otherwise(plain(t, "`")))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s++|\s+$", "")


def recovered_edits(actions: DataFrame) -> DataFrame:
    """actions where a complex_command whose first word is sed or perl and whose last one is a path becomes that edit:
    argv (what stands between, the path), and as flags the letters of an option right after the command."""
    text = trimmed(F.coalesce(F.get("argv", F.lit(0)), F.lit("")))
    first, last = F.regexp_extract(text, r"^(\S++)", 1), F.regexp_extract(text, r"(\S+)$", 1)
    between = trimmed(F.substring(text, F.length(first) + 1, F.length(text) - F.length(first) - F.length(last)))
    is_path = last.rlike(r"^[/~.]\S|^[A-Za-z]:[\\/]\S")
    is_edit = (F.col("command") == "complex_command") & F.lower(first).isin("sed", "perl") & is_path & (between != "")
    option = F.regexp_extract(between, r"^-([A-Za-z]++)(?:\s|$)", 1)
    letters = F.array_distinct(F.filter(F.split(option, ""), lambda c: c != ""))
    flags = F.map_from_arrays(letters, F.transform(letters, lambda c: F.lit("true")))
    rest = F.when(option != "", trimmed(F.substring(between, F.length(option) + 2, F.length(between)))).otherwise(between)
    new = {"command": F.lower(first), "argv": F.filter(F.array(rest, last), lambda a: a != ""), "flags": flags}
    return actions.select(*[F.when(is_edit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in actions.columns])


def session_actions(calls: DataFrame, *, keep_cd: bool = False, keys: list[str] = CALL) -> DataFrame:
    """shell_actions for scripts of native sessions: the whole text if it holds no complex_command, else each of its
    lines, with a here-document as one, and edits recovered."""
    whole = shell_actions(calls, keep_cd=keep_cd, keys=keys)
    broken = whole.where("command = 'complex_command'").select(*keys).distinct()
    apart = calls.join(broken, keys, "left_semi")
    pieces = F.filter(F.regexp_extract_all("text", F.lit(r"""(?s)[^\n]*<<-?\s*['"]?(\w+)['"]?[^\n]*\n.*?\n\1(?=\n|$)|[^\n]+"""), F.lit(0)), lambda t: F.trim(t) != "")
    lines = apart.select(*keys, F.posexplode(pieces).alias("_line", "text"))
    again = recovered_edits(shell_actions(lines, keep_cd=keep_cd, keys=[*keys, "_line"]))
    again = again.withColumn("cmd_pos", F.row_number().over(Window.partitionBy(*keys).orderBy("_line", "cmd_pos")).cast("long") - 1).drop("_line")
    return whole.join(broken, keys, "left_anti").unionByName(again)


def native_actions(calls: DataFrame, *, shells: list[str], patchers: list[str]) -> DataFrame:
    """Actions of native calls (traj, step_idx, call_pos, name, arguments, observation): the commands of a shell's text or
    of a script's; one apply_patch for each file of a patch; else the tool itself.

    traj, step_idx, call_pos, cmd_pos, tool, subcommand, command, argv, flags, args, has_cd, label, observation."""
    low, raw = F.lower("name"), F.coalesce("arguments", F.lit(""))
    value = F.coalesce(F.get_json_object(raw, "$.command"), F.get_json_object(raw, "$.cmd"), raw)
    value = F.when(value.startswith("["), F.array_join(F.from_json(value, "array<string>"), " ")).otherwise(value)
    texts = F.when(low.isin(shells), F.array(value)).when(low == "exec", nested_commands(raw)).otherwise(F.array().cast("array<string>"))
    scripts = calls.select(*CALL, F.posexplode(texts).alias("_k", "text")).where("text <> ''")
    empty = F.create_map().cast(NO_FLAGS)
    # Within a call the commands of its scripts come first, script by script, then the files of its patch.
    place = lambda part, k, n: F.struct(F.lit(part).alias("part"), F.col(k).cast("long").alias("k"), n.cast("long").alias("n")).alias("_place")
    shell = session_actions(scripts, keys=[*CALL, "_k"]).where(~F.col("command").isin("true", "false") | (F.size("argv") > 0))
    shell = shell.select(*CALL, place(0, "_k", F.col("cmd_pos")), F.lit("").alias("tool"), F.lit("").alias("subcommand"), "command", "argv", "flags", empty.alias("args"), "has_cd", F.col("command").alias("label"))
    patch = calls.where(low.isin(patchers) | ((low == "exec") & F.contains(raw, F.lit("tools.apply_patch"))))
    files = F.when(F.size(patch_files(raw)) > 0, patch_files(raw)).otherwise(F.array(F.lit("")))
    patched = patch.select(*CALL, raw.alias("_raw"), F.posexplode(files).alias("_k", "_p")).select(*CALL, place(1, "_k", F.lit(0)), F.lit("str_replace_editor").alias("tool"), F.lit("str_replace").alias("subcommand"), F.lit("").alias("command"), F.array(F.when(F.col("_p") != "", F.col("_p")).otherwise(F.col("_raw"))).alias("argv"), empty.alias("flags"), F.when(F.col("_p") != "", F.create_map(F.lit("path"), "_p")).otherwise(F.create_map(F.lit("_raw"), "_raw")).alias("args"), F.lit(False).alias("has_cd"), F.lit("apply_patch").alias("label"))
    found = shell.unionByName(patched)
    own = calls.join(found.select(*CALL).distinct(), CALL, "left_anti").withColumn("_k", F.lit(0))
    given = F.coalesce(F.from_json(raw, NO_FLAGS), F.create_map(F.lit("_raw"), raw))
    alone = own.select(*CALL, place(2, "_k", F.lit(0)), F.col("name").alias("tool"), F.lit("").alias("subcommand"), F.lit("").alias("command"), F.map_values(given).alias("argv"), empty.alias("flags"), given.alias("args"), F.lit(False).alias("has_cd"), F.when(low == "final_answer", "final answer").otherwise(F.col("name")).alias("label"))
    out = found.unionByName(alone)
    out = out.withColumn("cmd_pos", F.row_number().over(Window.partitionBy(*CALL).orderBy("_place")).cast("long") - 1).drop("_place")
    return out.select(*CALL, "cmd_pos", *[c for c in out.columns if c not in (*CALL, "cmd_pos")]).join(calls.select(*CALL, "observation"), CALL, "left")


def think_actions(steps: DataFrame, *, unique: bool = False) -> DataFrame:
    """traj, step_idx, label "think", args, thought, observation for steps without an action: alike if their thoughts are
    as long as each other, or only if they are equal (unique)."""
    length = F.length(F.coalesce("thought", F.lit(""))).cast("string")
    args = F.create_map(F.lit("thought"), F.coalesce("thought", F.lit(""))) if unique else F.create_map(F.lit("thought_len"), length)
    return steps.where(F.trim(F.coalesce("action_text", F.lit(""))) == "").select("traj", "step_idx", F.lit("think").alias("label"), args.alias("args"), "thought", "observation")


def bound_arguments(actions: DataFrame, spec: DataFrame) -> DataFrame:
    """actions (tokens) with bound (whether a known tool was called rightly), tool, subcommand and args (VARIANT).

    spec: tool, arg_name, position, type (string, integer, array), is_flag, subcommands (null or empty: none). A tool with
    subcommands needs one of them as its next word. --name takes the next word unless that is an option too (then true);
    an array takes whole numbers as long as they come; an option that isn't in the spec is skipped. All other words go
    to the arguments that are no flags, in their order; more words than arguments are left out. An integer that is
    none stays text. Of an argument that is given twice the last counts."""
    row = F.struct("position", F.col("arg_name").alias("name"), F.lower("type").alias("type"), "is_flag")
    tools = spec.groupBy("tool").agg(F.array_sort(F.collect_list(row)).alias("_spec"), F.flatten(F.collect_list(F.coalesce("subcommands", F.array().cast("array<string>")))).alias("_subs"))
    own = actions.drop(*[c for c in ("tool", "subcommand", "args", "bound") if c in actions.columns]).withColumn("_name", F.get("tokens", F.lit(0)))
    own = own.join(tools.withColumnRenamed("tool", "_name"), "_name", "left")
    has_sub = F.size("_subs") > 0
    sub = F.when(has_sub, F.get("tokens", F.lit(1)))
    bound = F.col("_spec").isNotNull() & (~has_sub | F.coalesce(F.array_contains("_subs", sub), F.lit(False)))
    skip = F.when(has_sub, 2).otherwise(1)
    own = own.withColumn("bound", F.coalesce(bound, F.lit(False))).withColumn("_args", F.when(F.col("bound"), F.slice("tokens", skip + 1, F.greatest(F.size("tokens") - skip, F.lit(0)))))
    # The words before the first option, and each option with the words up to the next one.
    n, is_option = F.size("_args"), lambda t: t.startswith("--")
    at = F.filter(F.transform("_args", lambda t, i: F.when(is_option(t), i)), lambda i: i.isNotNull())
    own = own.withColumn("_at", at)
    head = F.slice("_args", F.lit(1), F.coalesce(F.get("_at", F.lit(0)), n))
    typed = lambda name: F.get(F.filter("_spec", lambda s: s["name"] == name), F.lit(0))["type"]
    whole = lambda t: t.rlike(r"^\s*[+-]?\d+\s*$")

    def group(i: Column, k: Column) -> Column:
        name = F.substring(F.get("_args", i), F.lit(3), F.lit(1 << 30))
        tail = F.slice("_args", i + 2, F.coalesce(F.get("_at", k + 1), n) - i - 1)
        first_other = F.array_position(F.transform(tail, lambda t: ~whole(t)), True).cast("int")
        kind = typed(name)
        taken = F.when(kind.isNull(), 0).when(kind == "array", F.when(first_other > 0, first_other - 1).otherwise(F.size(tail))).otherwise(F.least(F.size(tail), F.lit(1)))
        return F.struct(name.alias("name"), kind.alias("type"), F.slice(tail, F.lit(1), taken).alias("taken"), F.transform(F.slice(tail, taken + 1, F.greatest(F.size(tail) - taken, F.lit(0))), lambda t, j: F.struct((i + 1 + taken + j).alias("at"), t.alias("t"))).alias("rest"), i.alias("at"))

    own = own.withColumn("_groups", F.transform("_at", group))
    loose = F.concat(F.transform(head, lambda t, i: F.struct(i.alias("at"), t.alias("t"))), F.flatten(F.transform("_groups", lambda g: g["rest"])))
    places = F.filter("_spec", lambda s: ~s["is_flag"] & (s["name"] != "command"))
    number = lambda t: F.trim(t).try_cast("decimal(38,0)").cast("string")
    quoted = lambda t: F.regexp_extract(F.to_json(F.array(t)), r"(?s)^\[(.*)\]$", 1)
    scalar = lambda t, kind: F.when((kind == "integer") & whole(t) & number(t).isNotNull(), number(t)).otherwise(quoted(t))
    entry = lambda at, name, json: F.struct(at.alias("at"), name.alias("name"), json.alias("json"))
    by_place = F.transform(F.filter(F.arrays_zip(places.alias("s"), loose.alias("w")), lambda z: z["w"].isNotNull() & z["s"].isNotNull()), lambda z: entry(z["w"]["at"], z["s"]["name"], scalar(z["w"]["t"], z["s"]["type"])))
    listed = lambda g: F.concat(F.lit("["), F.array_join(F.transform(g["taken"], number), ","), F.lit("]"))
    by_name = F.transform(F.filter("_groups", lambda g: g["type"].isNotNull()), lambda g: entry(g["at"], g["name"], F.when(g["type"] == "array", listed(g)).when(F.size(g["taken"]) > 0, scalar(g["taken"][0], g["type"])).otherwise(F.lit("true"))))
    own = own.withColumn("_e", F.array_sort(F.concat(by_place, by_name)))
    names = F.array_distinct(F.transform("_e", lambda e: e["name"]))
    pairs = F.transform(names, lambda k: F.concat(quoted(k), F.lit(":"), F.element_at(F.filter("_e", lambda e: e["name"] == k), -1)["json"]))
    args = F.when(F.col("bound"), F.parse_json(F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))))
    out = own.withColumn("tool", F.when(F.col("bound"), F.col("_name"))).withColumn("subcommand", F.when(F.col("bound"), sub))
    return out.withColumn("args", args).drop("_name", "_spec", "_subs", "_args", "_at", "_groups", "_e")


def label(tool: Column, subcommand: Column, command: Column, raw: Column) -> Column:
    empty = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    return F.coalesce(F.when(empty(tool).isNotNull() & empty(subcommand).isNotNull(), F.concat_ws(": ", tool, subcommand)), empty(tool), empty(command), raw)
