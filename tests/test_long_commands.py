"""Commands of any length and number: the tokenizer, places of calls, scripts in scripts, and arguments bound by a spec."""

import json
import random

from pyspark.sql import functions as F

from tracewright.functions import rules
from tracewright.operators import commands

CALLS = "traj string, step_idx long, call_pos int, text string"
SEPARATORS = ("&&", "||", ";", "\n")


def scanned(text):
    """Tokens by a scanner of one character at a time."""
    out, i, n = [], 0, len(text)
    while i < n:
        if text[i : i + 2] in ("&&", "||"):
            out.append(text[i : i + 2])
            i += 2
        elif text[i] in ";\n":
            out.append(text[i])
            i += 1
        else:
            start = i
            while i < n:
                if text[i] in "\"'":
                    j, quote = i + 1, text[i]
                    while j < n and text[j] != quote:
                        if quote == '"' and text[j] == "\\":
                            if j + 1 >= n or text[j + 1] == "\n":
                                j = n
                                break
                            j += 1
                        j += 1
                    if j >= n:
                        break
                    i = j + 1
                elif text[i] == "\\" and i + 1 < n and text[i + 1] != "\n":
                    i += 2
                elif text[i] in " \t\n;&|\\":
                    break
                else:
                    i += 1
            if i > start:
                out.append(text[start:i])
            else:
                if text[i] in "|&":
                    out.append(text[i])
                i += 1
    return out


def test_tokens_equal_a_scanner(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a", "b ", " ", '"', "'", "\\", ";", "&", "&&", "|", "||", "\n", "-", "é", "="]) for _ in range(rng.randrange(30))) for _ in range(3000)]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", commands.tokens(F.col("t")).alias("x")).collect()
    for r in rows:
        assert r.x == scanned(texts[r.k]), repr(texts[r.k])


def test_tokens_of_five_megabytes(spark):
    words = ["x" * 5_000_000, '"' + "y " * 2_500_000 + '"', "'" + "z;" * 2_500_000 + "'", "\\ " * 2_500_000, '"' + '\\"' * 2_500_000 + '"', "a'b'" * 1_250_000]
    calls = spark.createDataFrame([("t", k, 0, "run -v " + w + " end && pwd") for k, w in enumerate(words)], CALLS)
    rows = commands.shell_actions(calls).orderBy("step_idx", "cmd_pos").select("command", F.size("argv").alias("n"), F.length(F.get("argv", F.lit(0))).alias("long"), "flags").collect()
    for first, second in zip(rows[::2], rows[1::2], strict=True):
        assert (first.command, first.n, first.flags, second.command) == ("run", 2, {"v": "true"}, "pwd")
        assert first.long >= 2_500_000


def test_open_quotes_of_five_megabytes(spark):
    texts = ['echo "' + "x " * 2_500_000, "echo '" + '"' * 5_000_000, 'echo "' + "\\" * 5_000_000]
    calls = spark.createDataFrame([("t", k, 0, t) for k, t in enumerate(texts)], CALLS)
    assert [r.command for r in commands.shell_actions(calls).select("command").collect()] == ["complex_command"] * 3


def test_many_calls_in_a_turn_and_many_commands_in_a_call(spark):
    """The place of a call is an int here, as positions in arrays are."""
    broken = "for i in 1; do x; done\nls {0}\nsed -i 's/it's/b/' /tmp/{0}"
    calls = spark.createDataFrame([("t", 0, k, broken.format(k)) for k in range(50)] + [("t", 1, 0, "if x\n" + "\n".join(f"cmd{k}" for k in range(1500)) + "\npwd")], CALLS)
    rows = commands.session_actions(calls).orderBy("step_idx", "call_pos", "cmd_pos").collect()
    for k in range(50):
        own = [r for r in rows if (r.step_idx, r.call_pos) == (0, k)]
        assert [(r.cmd_pos, r.command, r.argv) for r in own] == [(0, "complex_command", ["for i in 1; do x; done"]), (1, "ls", [str(k)]), (2, "sed", ["'s/it's/b/'", f"/tmp/{k}"])]
    assert [r.command for r in rows if r.step_idx == 1] == ["complex_command", *(f"cmd{k}" for k in range(1500)), "pwd"]
    native = spark.createDataFrame([("t", 0, k, "bash", json.dumps({"command": "ls; pwd; " + "; ".join(f"c{j}" for j in range(1100))}), "o") for k in range(12)], "traj string, step_idx long, call_pos int, name string, arguments string, observation string")
    got = commands.native_actions(native, shells=["bash"], patchers=[]).orderBy("call_pos", "cmd_pos").collect()
    assert len(got) == 12 * 1102 and [(r.call_pos, r.cmd_pos) for r in got] == [(k, j) for k in range(12) for j in range(1102)]
    assert got[1102 + 3].label == "c1"


def test_scripts_in_scripts(spark):
    call = "tools.exec_command({command: %s})"
    cases = [
        (call % '"ls \\"a\\" \\u0041\\nx"', ['ls "a" A\nx']),
        (call % '"bad \\q escape"', ["bad \\q escape"]),
        (call % r"'it\'s\nq \\ d'", ["it's\nq \\ d"]),
        (call % r"`a \` b`", ["a ` b"]),
        ("tools.shell_command( " + " " * 19_900 + 'command: "near"', ["near"]),
        ("tools.shell_command(" + " " * 19_980 + 'command: "beyond the end"', []),
        ("tools.shell_command(x); " + call % '"one"', ["one", "one"]),
        (call % ('"' + "y" * 15_000 + '"'), ["y" * 15_000]),
        (call % ('"' + "y" * 2_000_000 + '"'), []),
        ("no call", []),
    ]
    rows = spark.createDataFrame([(k, s) for k, (s, _) in enumerate(cases)], "k int, s string").select("k", commands.nested_commands(F.col("s")).alias("x")).collect()
    for r in rows:
        assert r.x == cases[r.k][1], r.k


def test_recovered_edits(spark):
    cases = {
        "sed -i 's/it's/x/' /a/b.py": ("sed", ["'s/it's/x/'", "/a/b.py"], {"i": "true"}),
        "  PERL -pie 's/'a/b/g' \n ~/x ": ("perl", ["'s/'a/b/g'"], {"p": "true", "i": "true", "e": "true"}),
        "sed 's/'/b/ C:\\x.txt": ("sed", ["'s/'/b/", "C:\\x.txt"], {}),
        "sed -n ' ./f": ("sed", ["'", "./f"], {"n": "true"}),
        "sed -i /f'": ("sed", ["/f'"], {"i": "true"}),
        "sed 's/a'b/c/' plain": ("complex_command", ["sed 's/a'b/c/' plain"], {}),
        "grep 'x /f": ("complex_command", ["grep 'x /f"], {}),
    }
    cases["  PERL -pie 's/'a/b/g' \n ~/x "] = ("perl", ["'s/'a/b/g'", "~/x"], {"p": "true", "i": "true", "e": "true"})
    raw = spark.createDataFrame([(k, "complex_command", [t], {}) for k, t in enumerate(cases)], "k int, command string, argv array<string>, flags map<string,string>")
    for r in commands.recovered_edits(raw).orderBy("k").collect():
        assert (r.command, r.argv, r.flags) == list(cases.values())[r.k], list(cases)[r.k]


SUBS = ["view", "create", "str_replace", "insert"]
SPEC = [
    ("edit", "command", 0, "string", False, SUBS), ("edit", "path", 1, "string", False, None), ("edit", "file_text", 2, "string", True, None), ("edit", "insert_line", 3, "integer", True, None),
    ("edit", "view_range", 4, "array", True, None), ("goto", "line", 0, "integer", False, None), ("goto", "file", 1, "string", False, None), ("submit", "x", 0, "string", True, []),
]


def bound_by_hand(tokens):
    """The same rules, word by word."""
    tools = {t: [s for s in SPEC if s[0] == t] for t in {s[0] for s in SPEC}}
    if not tokens or tokens[0] not in tools:
        return None
    spec, subs = {s[1]: s for s in tools[tokens[0]]}, [x for s in tools[tokens[0]] for x in s[5] or []]
    sub = None
    if subs:
        sub = tokens[1] if len(tokens) > 1 else None
        if sub not in subs:
            return None
    places, rest, args = [s for s in tools[tokens[0]] if not s[4] and s[1] != "command"], tokens[2 if subs else 1 :], {}

    def number(t):
        try:
            return int(t)
        except ValueError:
            return t

    i, k = 0, 0
    while i < len(rest):
        t = rest[i]
        i += 1
        if not t.startswith("--"):
            if k < len(places):
                args[places[k][1]] = number(t) if places[k][3] == "integer" else t
                k += 1
        elif t[2:] in spec:
            kind = spec[t[2:]][3]
            if kind == "array":
                found = []
                while i < len(rest) and not rest[i].startswith("--") and isinstance(number(rest[i]), int):
                    found.append(number(rest[i]))
                    i += 1
                args[t[2:]] = found
            elif i < len(rest) and not rest[i].startswith("--"):
                args[t[2:]] = number(rest[i]) if kind == "integer" else rest[i]
                i += 1
            else:
                args[t[2:]] = True
    return tokens[0], sub, args


def test_arguments_by_a_spec(spark):
    rng = random.Random(8)
    words = ["--view_range", "--file_text", "--insert_line", "--none", "--path", "1", "-2", "+3", "40", "x", 'q"uo\\te', "--", "/a/b.py", "é\n", "view"]
    cases = [["edit", "view", "/a", "--view_range", "1", "20"], ["edit", "fly"], ["edit"], ["goto", "12", "f"], ["goto", "12x", "f", "g"], ["submit"], ["ls", "-l"], ["edit", "view", "--view_range", "3", "x", "4"], ["edit", "insert", "--insert_line"], []]
    cases += [[rng.choice(["edit", "goto"]), *([rng.choice([*SUBS, "no"])] if rng.random() < 0.8 else []), *(rng.choice(words) for _ in range(rng.randrange(8)))] for _ in range(400)]
    spec = spark.createDataFrame(SPEC, "tool string, arg_name string, position int, type string, is_flag boolean, subcommands array<string>")
    actions = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k int, tokens array<string>").withColumn("tool", F.lit("old"))
    got = commands.bound_arguments(actions, spec).select("k", "bound", "tool", "subcommand", F.to_json("args").alias("args"), F.schema_of_variant("args").alias("types")).orderBy("k").collect()
    for r in got:
        want = bound_by_hand(cases[r.k])
        assert r.bound == (want is not None), cases[r.k]
        if want:
            # In an option's first value a leading "-" is a value, and so it is here.
            assert (r.tool, r.subcommand, json.loads(r.args)) == want, cases[r.k]
    assert "ARRAY<BIGINT>" in got[0].types and "BIGINT" in got[3].types


def test_shell_text_to_bound_arguments(spark):
    text = "edit view '/a b.py' --view_range 5 9 && goto 7 x"
    spec = spark.createDataFrame(SPEC, "tool string, arg_name string, position int, type string, is_flag boolean, subcommands array<string>")
    out = commands.bound_arguments(commands.shell_actions(spark.createDataFrame([("t", 0, 0, text)], CALLS)), spec)
    got = out.orderBy("cmd_pos").select(F.variant_get("args", "$.path", "string").alias("path"), F.variant_get("args", "$.view_range", "array<int>").alias("range"), F.variant_get("args", "$.line", "int").alias("line")).collect()
    assert [(r.path, r.range, r.line) for r in got] == [("/a b.py", [5, 9], None), (None, None, 7)]


def test_label(spark):
    rows = spark.createDataFrame([("edit", "view", "c", "r"), ("edit", " ", "c", "r"), (None, "view", "ls", "r"), ("", None, " ", "raw")], "a string, b string, c string, d string")
    assert [r[0] for r in rows.select(commands.label(*map(F.col, "abcd"))).collect()] == ["edit: view", "edit", "ls", "raw"]
    assert rules.SHELL_TOOLS
