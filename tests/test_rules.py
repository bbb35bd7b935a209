"""Phase rules, outcomes, commands and log readers on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from tracewright.functions import rules, text
from tracewright.operators import commands, phases
from tracewright.sources import logs

EDITOR = "str_replace_editor"
CASES = [
    # tool, subcommand, command, tokens, flags, framework, patched before, phase
    (None, None, "grep", ["def foo():", "file.py"], {}, None, False, "localization"),
    (None, None, "grep", ["def foo():", "test_file.py"], {}, None, True, "validation"),
    (None, None, "grep", ["def foo():", "file.py", ">", "out.txt"], {}, None, False, "patch"),
    (None, None, "grep", ["x", "file.py", ">", "tests/test_file.py"], {}, None, False, "localization"),
    (None, None, "grep", ["x", "file.py", ">", "tests/test_file.py"], {}, None, True, "validation"),
    (None, None, "sed", ["s/foo/bar/g", "file.py"], {"i": "true"}, None, False, "patch"),
    (None, None, "sed", ["/testbed/scales.py"], {"n": "1,440p"}, None, False, "localization"),
    (None, None, "python", ["script.py"], {}, None, False, "localization"),
    (None, None, "python", ["script.py"], {}, None, True, "validation"),
    (None, None, "python", ["-c", "'print(42)'", ">", "out.txt"], {}, None, False, "patch"),
    (None, None, "python", ["-c", "'print(42)'", ">", "tests/test_out.py"], {}, None, True, "validation"),
    (None, None, "python", ["-", "from pathlib import Path\np=Path('/a/scales.py')\np.write_text('x')"], {"__heredoc__": "true"}, None, False, "patch"),
    (EDITOR, "create", None, ["file.py"], {}, None, False, "patch"),
    (EDITOR, "create", None, ["tests/test_file.py"], {}, None, True, "validation"),
    (EDITOR, "view", None, ["test_file.py"], {}, None, True, "validation"),
    (EDITOR, "view", None, ["file.py"], {}, None, True, "localization"),
    (None, None, "complex_command", ["cat << 'EOF' > /workspace/test_fix.py\nprint('hi')\nEOF"], {}, None, False, "localization"),
    (None, None, "nl", ["filename.py", "|", "sed", "10,20p"], {"n": "true"}, None, True, "localization"),
    (None, None, "nl", ["test_file.py", "|", "sed", "10,20p"], {"n": "true"}, None, True, "validation"),
    (None, None, "nl", ["file.py", ">", "output.txt"], {}, None, False, "patch"),
    (None, None, "perl", ["s/old/new/g", "test_file.py"], {"i": "true", "p": "true"}, None, False, "localization"),
    *[(None, None, c, [], {}, None, True, "general") for c in ("cp", "rm", "mkdir", "cd", "echo", "curl", "node", "mypy", "apply_patch")],
    ("update_plan", None, None, [], {}, "codex", False, "plan"),
    ("EnterPlanMode", None, None, [], {}, "claude", False, "plan"),
    ("TodoWrite", None, None, [], {}, "sa", False, "general"),
    (None, None, "/opt/venv/bin/pytest", ["tests/"], {"v": "true"}, "claude", True, "validation"),
    (None, None, "/opt/venv/bin/black", ["src/"], {"check": "true"}, "claude", True, "validation"),
    *[(None, None, c, [], {}, "codex", p, "validation" if p else "localization") for c in ("echo", "sleep", "wc", "bash", "timeout") for p in (True, False)],
    *[(None, None, c, [], {}, "codex", True, "general") for c in ("set_env", "taskstop", "export", "#")],
    (None, None, "cd", [], {}, "codex", True, "localization"),
    (None, None, "websearch", [], {}, "codex", True, "localization"),
    (None, None, "cp", ["source.py", "dest.py"], {}, "codex", False, "patch"),
    (None, None, "rm", ["./tests/test_output.py"], {}, "codex", True, "validation"),
    (None, None, "node", ["-e", "fs.writeFileSync('app.js', 'x')"], {}, "codex", False, "patch"),
    (None, None, "node", ["-e", "console.log('ok')"], {}, "codex", True, "validation"),
    (None, None, "uv", ["run", "pytest", "tests"], {}, "codex", False, "localization"),
    (None, None, "git", ["status"], {}, "codex", True, "localization"),
    (None, None, "git", ["commit", "-m", "fix"], {}, "codex", False, "general"),
    (None, None, "apply_patch", [], {}, "codex", False, "patch"),
    (None, None, "grep", ["x", "file.py", ">", "tests/test_file.py"], {}, None, True, "validation"),
    (None, None, "grep", ["test_x", "file.py"], {}, None, True, "localization"),
    (None, None, "foo", ["2>err"], {}, None, False, "patch"),
    (None, None, "foo", ["a 2>err"], {}, None, False, "patch"),
    (None, None, "foo", ["a", "b"], {}, None, False, "general"),
    (None, None, "python", ["-c", "'print(42)'", ">", "tests/test_out.py"], {}, None, False, "localization"),
    (EDITOR, "create", None, ["tests/test_file.py"], {}, None, False, "localization"),
    (EDITOR, "str_replace", None, ["/testbed/django/client.py", "  temp = None\n  print(f\"DEBUG: passwd = '{passwd}'\")  # DEBUG\n  temp = Temp(mode='w+')}"], {}, None, False, "patch"),
    (None, None, "nl", ["filename.py", "|", "sed", "10,20p"], {"n": "true"}, None, False, "localization"),
    (None, None, "nl", ["test_file.py", "|", "sed", "10,20p"], {"n": "true"}, None, False, "localization"),
    (None, None, "nl", ["file.py", ">", "test_output.py"], {}, None, False, "localization"),
    (None, None, "nl", ["file.py", ">", "test_output.py"], {}, None, True, "validation"),
    (None, None, "nl", ["file.py", ">", "./test_output.py"], {}, None, True, "validation"),
    (None, None, "sleep", [], {}, None, True, "general"),
    (None, None, "git", ["status"], {}, None, True, "general"),
    ("mcp/update_plan", None, None, [], {}, "codex", False, "plan"),
    (None, None, "/opt/venv/bin/mypy", ["src/"], {}, "claude", True, "validation"),
    (None, None, "/opt/venv/bin/isort", ["src/", "tests/"], {"check": "true"}, "claude", True, "validation"),
    (None, None, "mcp__environment__bash", [], {}, "claude", False, "localization"),
    *[(None, None, c, [], {}, "codex", p, "validation" if p else "localization") for c in ("curl", "taskoutput", "ps", "date", "nvidia-smi", "which", "df", "free", "env", "pgrep", "write_stdin", "wait", "tmux", "exec", "exec_command", "powershell", "run_shell_command") for p in (True, False)],
    *[(None, None, c, [], {}, "codex", False, "general") for c in ("taskupdate", "taskcreate", "agent", "mcp__environment__finish")],
    *[(None, None, c, [], {}, "codex", False, "localization") for c in ("toolsearch", "webfetch")],
    (None, None, "rm", ["source.py"], {}, "codex", False, "patch"),
    (None, None, "mkdir", ["src"], {}, "codex", False, "patch"),
    (None, None, "node", ["-e", "console.log('ok')"], {}, "codex", False, "localization"),
    (None, None, "complex_command", ["for f in *; do python $f; done"], {}, None, True, "general"),
    (None, None, "complex_command", ["if x; then make 2> err.log; fi"], {}, None, False, "patch"),
    (None, None, "complex_command", ["for i in 1; do python - <<'E'\nprint(1)\nE\ndone"], {}, None, True, "validation"),
    (None, None, "complex_command", ["for i in 1; do python - <<'E'\nopen('a.py', 'w').write('')\nE\ndone"], {}, None, True, "patch"),
    (None, None, "complex_command", ["for t in tests/; do ls $t; done"], {}, None, True, "general"),
    (None, None, "complex_command", ["for t in tests/; do ls $t; done"], {}, "codex", True, "validation"),
    (None, None, "python", [], {"c": "f = 'a.py'\nopen(f, 'a')"}, None, False, "patch"),
    (None, None, "python", [], {"c": "p = Path('a.py') / 'b'\np.write_text('')"}, None, False, "localization"),
    (None, None, "perl", ["print", "word"], {"n": "true"}, None, False, "general"),
    (None, None, "perl", ["print", "a/b"], {"n": "true"}, None, False, "localization"),
]


def test_phase_rules(spark):
    schema = "traj long, tool string, subcommand string, command string, tokens array<string>, flags map<string,string>, framework string"
    rows = [(k, *c[:6]) for k, c in enumerate(CASES)]
    own = spark.createDataFrame(rows, schema).withColumn("phase_class", rules.phase_class(*[F.col(c) for c in ("tool", "subcommand", "command", "tokens", "flags", "framework")])).withColumn("seq", F.lit(1).cast("long"))
    before = spark.createDataFrame([(k, "patch", 0) for k, c in enumerate(CASES) if c[6]], "traj long, phase_class string, seq long")
    got = {r.traj: r.phase for r in phases.resolved(own.select("traj", "phase_class", "seq").unionByName(before)).where("seq = 1").collect()}
    wrong = [(c, got[k]) for k, c in enumerate(CASES) if got[k] != c[7]]
    assert not wrong


OUTCOMES = [
    (EDITOR, "str_replace", "The file has been edited.", "success", "success", "success"),
    (EDITOR, "str_replace", "No replacement: old_str did not appear verbatim", "failure: not found", "neutral", "failure"),
    (EDITOR, "str_replace", "Multiple occurrences of old_str", "failure: multiple occurrences", "neutral", "failure"),
    (EDITOR, "str_replace", "old_str `x` is the same as new_str", "failure: no change", "neutral", "failure"),
    (EDITOR, "str_replace", "what", "failure: unknown", "neutral", "failure"),
    (EDITOR, "view", "KeyError: Error: failed", None, "neutral", None),
    (EDITOR, "view", "The path /x does not exist. Please provide a valid path.", "failure: path does not exist", "failure", "failure"),
    (None, None, "Traceback (most recent call last):", None, "failure", "failure"),
    (None, None, "3 failed, 2 passed", None, "failure", "failure"),
    (None, None, "0 failed, 2 passed", None, "failure", "success"),
    (None, None, "5 passed", None, "success", "success"),
    (None, None, "", None, "neutral", None),
    (None, None, None, None, "neutral", None),
]


def test_outcomes(spark):
    f = spark.createDataFrame([(k, *o[:3]) for k, o in enumerate(OUTCOMES)], "n int, tool string, sub string, obs string")
    cols = [F.col(c) for c in ("tool", "sub", "obs")]
    for r in f.select("n", text.edit_status(*cols).alias("e"), text.observation_outcome(*cols).alias("o"), text.command_outcome(*cols).alias("c")).collect():
        assert (r.e, r.o, r.c) == OUTCOMES[r.n][3:], OUTCOMES[r.n]


def test_text_functions(spark):
    f = spark.createDataFrame([("a ```x\ny``` `b` \"c\" 'd' e", "'/a//b/c.py:10:2'"), (None, None)], "t string, p string")
    r = f.select(text.thought_length_raw(F.col("t")), text.thought_length_clean(F.col("t")), text.normal_path(F.col("p"))).collect()
    assert tuple(r[0]) == (25, 7, "/a/b/c.py") and tuple(r[1])[:2] == (0, 0)
    assert spark.range(1).select(text.paths_in(F.lit("cat /a/b.py:3 and x.txt /a/b.py"))).first()[0] == ["/a/b.py", "x.txt"]


COMMANDS = [
    ("ls -la /tmp", [("ls", ["/tmp"], {"l": "true", "a": "true"}, False)]),
    ("cd /a && grep -rn 'x y' . ; echo \"a;b\"", [("grep", ["x y", "."], {"r": "true", "n": "true"}, True), ("echo", ["a;b"], {}, True)]),
    ("A=1 pytest --maxfail=2 tests/", [("set_env", ["A=1"], {}, False), ("pytest", ["tests/"], {"maxfail": "2"}, False)]),
    ("python -c 'print(1)'", [("python", [], {"c": "print(1)"}, False)]),
    ("for f in *; do cat $f; done", [("complex_command", ["for f in *; do cat $f; done"], {}, False)]),
    ("cat <<'EOF' > a.py\nx = 1\nEOF", [("cat", ["x = 1", ">", "a.py"], {"__heredoc__": "true"}, False)]),
    ("true", []),
    ("echo 'open", [("complex_command", ["echo 'open"], {}, False)]),
    ("nl a.py | sed -n '1,2p'", [("nl", ["a.py", "|", "sed", "1,2p"], {"n": "true"}, False)]),
]


def test_commands(spark):
    calls = spark.createDataFrame([("t", k, 0, c[0]) for k, c in enumerate(COMMANDS)], "traj string, step_idx long, call_pos long, text string")
    got = {}
    for r in commands.shell_actions(calls).orderBy("step_idx", "cmd_pos").collect():
        got.setdefault(r.step_idx, []).append((r.command, r.argv, r.flags, r.has_cd))
    for k, (source, want) in enumerate(COMMANDS):
        assert got.get(k, []) == want, source


def test_patch_files(spark):
    patch = "*** Begin\n*** Update File: a.py\n*** Add File: b.py\n+++ b/c.py\n*** Update File: a.py"
    assert spark.range(1).select(commands.patch_files(F.lit(patch))).first()[0] == ["a.py", "b.py", "c.py"]


def test_result_matching(spark):
    def run(name, *messages):
        return (name, json.dumps({"messages": messages, "info": {"mini_version": "2.0"}}))

    act = lambda *a: {"role": "assistant", "content": "c", "extra": {"actions": [{"command": c, "tool_call_id": i} for c, i in a]}}
    res = lambda out, i=None: {"role": "tool", "tool_call_id": i, "extra": {"raw_output": out, "returncode": 0}}
    rows = [
        run("keyed", act(("a", "1"), ("b", "2")), res("B", "2"), res("A", "1")),
        run("twice", act(("a", "1"), ("b", "1")), res("A", "1"), res("B", "1")),
        run("places", act(("a", None), ("b", None)), res("A"), res("B")),
        run("uneven", act(("a", None), ("b", None)), res("A")),
    ]
    got = {(r.traj, r.text): (r.observation, r.result_missing) for r in logs.msa_v2_calls(spark.createDataFrame(rows, "traj string, text string")).collect()}
    assert got["keyed", "a"] == ("A", False) and got["keyed", "b"] == ("B", False)
    assert got["twice", "a"] == (None, True) and got["places", "b"] == ("B", False) and got["uneven", "a"] == (None, True)


def test_codex_steps(spark):
    def rec(**p):
        return json.dumps({"type": "response_item", "payload": p})

    events = [
        rec(type="function_call", name="shell", call_id="1", arguments="x"),
        rec(type="function_call", name="shell", call_id="2", arguments="y"),
        rec(type="function_call_output", call_id="1", output="ok"),
        rec(type="function_call", name="shell", call_id="3", arguments="z"),
        rec(type="function_call_output", call_id="2", output="late"),
        rec(type="function_call", name="shell", call_id="4", arguments="w"),
    ]
    rows = spark.createDataFrame([("s", k, e) for k, e in enumerate(events)], "session string, rec_no long, text string")
    got = {r.call_id: (r.step_idx, r.observation) for r in logs.codex_calls(rows).collect()}
    assert got == {"1": (0, "ok"), "2": (0, "late"), "3": (1, None), "4": (1, None)}


def test_files_and_merge(spark, tmp_path):
    (tmp_path / "r1").mkdir()
    (tmp_path / "r1" / "r1.traj").write_text(json.dumps({"trajectory": [{"action": "ls", "thought": "t", "observation": "o"}, {"action": " ", "thought": "u", "observation": ""}]}))
    (tmp_path / "bad.traj").write_text("{nope")
    files = logs.whole_files(spark, str(tmp_path), "*.traj")
    steps = logs.sa_steps(files).orderBy("step_idx").collect()
    assert [(r.traj, r.step_idx, r.is_think) for r in steps] == [("r1", 0, False), ("r1", 1, True)]
    assert logs.parsed(files, logs.SA)[1].count() == 1
    old, new = spark.createDataFrame([("a", 1), ("b", 1)], "traj string, x int"), spark.createDataFrame([("b", 2), ("c", 2)], "traj string, x int")
    assert [tuple(r) for r in logs.merged(old, new).collect()] == [("a", 1), ("b", 2), ("c", 2)]


@pytest.mark.parametrize("name", sorted(logs.ADAPTERS))
def test_adapters_on_nothing(spark, name):
    rows = spark.createDataFrame([], "session string, rec_no long, text string" if name in ("codex", "claude") else "traj string, text string")
    assert logs.ADAPTERS[name](rows).count() == 0
