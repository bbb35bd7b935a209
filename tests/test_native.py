"""Readers of native sessions, commands of scripts, and classes of native tools, on small fixtures."""

import json

from pyspark.sql import functions as F

from tracewright.functions import rules
from tracewright.operators import commands
from tracewright.sources import logs


def rows(spark, name, *records):
    return spark.createDataFrame([(name, k, json.dumps(r)) for k, r in enumerate(records)], "session string, rec_no long, text string")


def test_message_lists(spark):
    block = lambda text, *commands_: [{"type": "message", "content": [{"text": text}]}, *[{"type": "function_call", "arguments": json.dumps({"command": c})} for c in commands_]]
    messages = [{"role": "system"}, {"role": "user", "output": block("no")}, {"role": "a", "output": block("t1", "ls", "")}, {"role": "u", "output": "seen"}, {"role": "a", "output": block("t2", "cat x")}, {"role": "a", "output": block("lost"), "extra": {"raw_output": "raw"}}, {"role": "a", "output": block("t3")}]
    f = spark.createDataFrame([("r", json.dumps({"messages": messages}))], "traj string, text string")
    got = logs.msa_default_steps(f).orderBy("step_idx").collect()
    assert [(r.thought, r.commands, r.observation) for r in got] == [("t1", ["ls"], "seen"), ("t2", ["cat x"], "raw"), ("t3", [], "")]
    assert f.select(logs.msa_format(F.col("text"))).first()[0] == "default"


def test_text_turns(spark):
    messages = [{"role": "system", "content": "s"}, {"role": "assistant", "content": "THOUGHT: look\n```bash\nls\n```"}, {"role": "user", "content": "<output>a b</output>"}, {"role": "assistant", "content": "THOUGHT: done\n```bash\necho\n```"}]
    f = spark.createDataFrame([("r", json.dumps({"trajectory_format": "mini-swe-agent-1", "messages": messages}))], "traj string, text string")
    assert [(r.step_idx, r.thought, r.action_text, r.observation) for r in logs.msa_v1_steps(f).orderBy("step_idx").collect()] == [(0, "look", "ls", "a b"), (1, "done", "echo", None)]
    assert f.select(logs.msa_format(F.col("text"))).first()[0] == "v1"


def test_turn_results_and_status(spark):
    act = lambda *a: {"role": "assistant", "content": "c", "reasoning_content": "r", "extra": {"actions": [{"command": c, "tool_call_id": i} for c, i in a]}}
    run = [act(("a", None)), {"role": "user", "content": "<returncode>3</returncode><output> o </output>", "extra": {"exit_status": "x1"}}, {"role": "user", "content": "stop", "extra": {"interrupt_type": "k"}}, {"role": "tool", "content": "t", "extra": {"exit_status": "x2", "exception_info": "e"}}, act(("b", "1")), {"role": "tool", "tool_call_id": "1", "content": "plain", "extra": {"exception_info": "boom"}}]
    f = spark.createDataFrame([("r", json.dumps({"messages": run, "info": {"mini_version": "2.1"}}))], "traj string, text string")
    a, b = logs.msa_v2_calls(f).orderBy("step_idx").collect()
    assert (a.thought, a.observation, a.exit_code, a.exit_status, a.feedback, a.result_missing) == ("r\n\nc", "o", 3, "x2", "stop", False)
    assert (b.observation, b.exception_info, b.exit_status, b.feedback) == ("plain", "boom", None, "")


def test_history_calls(spark):
    call = lambda name, **a: {"function": {"name": name, "arguments": json.dumps(a)}}
    message = {"content": "why", "tool_calls": [call("execute_bash", command="ls")]}
    history = [{"observation": "system"}, {"observation": None}, {"observation": "run", "content": "out", "tool_call_metadata": {"model_response": {"choices": [{"message": message}]}}}, {"observation": "edit", "content": "ok", "tool_call_metadata": call("str_replace_editor", command="view", path="/a")}]
    f = spark.createDataFrame([("x", json.dumps({"instance_id": "i", "history": history})), ("y", "{"), ("z", json.dumps({"history": history}))], "traj string, text string")
    a, b = logs.oh_steps(f).orderBy("step_idx").collect()
    assert (a.traj, a.thought, a.tool, a.action_text, a.observation) == ("i", "why", "execute_bash", "ls", "out")
    assert (b.step_idx, b.tool, b.subcommand, b.args) == (1, "str_replace_editor", "view", {"path": "/a"})


def test_session_steps_with_texts_and_answers(spark):
    item = lambda **p: {"type": "response_item", "payload": p}
    event = lambda **p: {"type": "event_msg", "payload": p}
    f = rows(
        spark, "s", {"type": "session_meta", "payload": {"id": "s"}}, item(type="reasoning", summary=json.dumps([{"text": "think"}])), item(type="message", role="assistant", content=json.dumps([{"text": "now"}])),
        item(type="function_call", name="shell_command", call_id="1", arguments='{"command": "ls"}'), event(type="exec_command_end", call_id="1", exit_code=2, stdout="out"), item(type="function_call_output", call_id="1", output="out"),
        item(type="web_search_call", id="w", action="q"), event(type="web_search_end", call_id="w", success=True, result="hit"), item(type="message", role="assistant", phase="final_answer", content="bye"), event(phase="final_answer", message="bye"),
    )
    got = [(r.step_idx, r.thought, r.name, r.observation, r.exit_code, r.is_error) for r in logs.codex_calls(f).orderBy("step_idx").collect()]
    assert got == [(0, "think\n\nnow", "shell_command", "out", 2, True), (1, "", "web_search", "hit", None, False), (2, "", "final_answer", None, None, None)]
    assert logs.is_codex(f).first().codex


def test_native_transcript(spark):
    use = lambda i, n: {"type": "tool_use", "id": i, "name": n, "input": {"x": 1}}
    answer = lambda i, c, e: {"type": "user", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": i, "content": c, "is_error": e}]}}
    f = rows(spark, "s", {"type": "user", "message": {"role": "user", "content": [{"type": "text", "text": "do   it\n" + "x" * 100}]}}, {"type": "assistant", "message": {"role": "assistant", "model": "m", "content": [{"type": "text", "text": "t"}, use("a", "Read"), use("b", "Edit")]}}, answer("a", "one", True), answer("a", "two", None))
    got = {r.call_id: (r.step_idx, r.call_pos, r.thought, r.name, r.observation, r.is_error) for r in logs.ADAPTERS["claude"](f).collect()}
    assert got == {"a": (0, 0, "t", "Read", "two", True), "b": (0, 1, "t", "Edit", None, None)}
    r = logs.session_listing(f).first()
    assert (len(r.title), r.title[:7], r.title[-3:], r.model, r.step_count) == (96, "do it x", "...", "m", 1)


def test_wire_events(spark):
    e = lambda **k: {"type": "context.append_loop_event", "event": k}
    f = rows(
        spark, "s", e(type="content.part", part={"type": "text", "text": "lost"}), e(type="step.begin", uuid="u1"), e(type="content.part", part={"type": "think", "think": "one"}), e(type="tool.call", toolCallId="1", name="Read", args={"path": "a"}),
        e(type="step.begin", uuid="u2"), e(type="content.part", stepUuid="u1", part={"type": "text", "text": "two"}), e(type="tool.call", toolCallId="2"), e(type="tool.result", toolCallId="1", result={"output": "out", "message": "more", "isError": True}),
        e(type="tool.result", toolCallId="2", result={"output": [{"text": "x"}, {"text": "y"}], "message": "y"}), e(type="step.begin", uuid="u3"),
    )
    got = [(r.step_idx, r.thought, r.name, r.observation, r.is_error) for r in logs.ADAPTERS["claude"](f).orderBy("step_idx").collect()]
    assert got == [(0, "one\ntwo", "Read", "out\nmore", True), (1, "", "tool", "x\ny", None), (2, "", None, None, None)]


SHELL = [
    ("A=1 B=2 make x", [("set_env", ["A=1 B=2"], {}), ("make", ["x"], {})]),
    ("find . -name '*.py' -type f -print", [("find", ["."], {"name": "*.py", "type": "f", "print": "true"})]),
    ("bash -lc 'ls -la' x -y", [("bash", ["x", "-y"], {"l": "true", "c": "ls -la"})]),
    ("grep -c foo a.py", [("grep", ["foo", "a.py"], {"c": "true"})]),
    ("ls -a -a --k=1 --k=2", [("ls", [], {"a": "true", "k": "2"})]),
    ("a; b && c || d", [("a", [], {}), ("b", [], {}), ("c", [], {}), ("d", [], {})]),
]


def actions_of(frame):
    got = {}
    for r in frame.orderBy("step_idx", "cmd_pos").collect():
        got.setdefault(r.step_idx, []).append((r.command, r.argv, r.flags))
    return got


def test_options_and_assignments(spark):
    calls = spark.createDataFrame([("t", k, 0, c[0]) for k, c in enumerate(SHELL)], "traj string, step_idx long, call_pos long, text string")
    got = actions_of(commands.shell_actions(calls))
    for k, (source, want) in enumerate(SHELL):
        assert got[k] == want, source
    kept = commands.shell_actions(spark.createDataFrame([("t", 0, 0, "ls; cd /a; pwd")], "traj string, step_idx long, call_pos long, text string"), keep_cd=True)
    assert [(r.command, r.has_cd) for r in kept.orderBy("cmd_pos").collect()] == [("ls", False), ("cd", False), ("pwd", True)]


def test_scripts_line_by_line(spark):
    text = "ls -l\nsed -i 's/a'b/c/' /x/y.py\nfor f in *; do echo $f; done\ncat <<'E' > z\nq\nE"
    calls = spark.createDataFrame([("t", 0, 0, text), ("t", 1, 0, "pwd\nls")], "traj string, step_idx long, call_pos long, text string")
    got = actions_of(commands.session_actions(calls))
    assert [c for c, _, _ in got[0]] == ["ls", "sed", "complex_command", "cat"] and [c for c, _, _ in got[1]] == ["pwd", "ls"]
    assert got[0][1] == ("sed", ["'s/a'b/c/'", "/x/y.py"], {"i": "true"})


def test_native_calls_to_actions(spark):
    patch = "*** Begin Patch\n*** Update File: a.py\n*** Add File: b.py"
    script = 'await tools.exec_command({cmd: "ls -l; cd x"}); await tools.shell_command({"command": "pwd"})'
    calls = [("shell_command", '{"command": ["ls", "-a"]}'), ("apply_patch", patch), ("exec", script), ("final_answer", "bye"), ("view_image", '{"path": "p.png"}')]
    f = spark.createDataFrame([("t", 0, k, n, a, "o") for k, (n, a) in enumerate(calls)], "traj string, step_idx long, call_pos long, name string, arguments string, observation string")
    got = {}
    for r in commands.native_actions(f, shells=rules.SHELL_TOOLS, patchers=rules.PATCHERS).orderBy("call_pos", "cmd_pos").collect():
        got.setdefault(r.call_pos, []).append((r.label, r.argv, r.observation))
    assert got[0] == [("ls", [], "o")] and got[1] == [("apply_patch", ["a.py"], "o"), ("apply_patch", ["b.py"], "o")]
    assert [x[0] for x in got[2]][:2] == ["ls", "cd"] and got[3][0][0] == "final answer" and got[4] == [("view_image", ["p.png"], "o")]


def test_think(spark):
    s = spark.createDataFrame([("t", 0, " ", "abc", "o"), ("t", 1, "ls", "abc", "o"), ("t", 2, None, "xyz", "o")], "traj string, step_idx long, action_text string, thought string, observation string")
    assert [r.args for r in commands.think_actions(s).orderBy("step_idx").collect()] == [{"thought_len": "3"}] * 2
    assert [r.args for r in commands.think_actions(s, unique=True).orderBy("step_idx").collect()] == [{"thought": "abc"}, {"thought": "xyz"}]


def test_native_classes(spark):
    none = F.lit(None).cast("string")
    shell = [("curl", "x", "ctx"), ("get-content", "a", "loc"), ("set-content", "a", "patch"), ("mv", "a b", "patch"), ("cargo", "test", "general"), ("cargo", "x pytest", "ctx"), ("cargo", "build", "general"), ("git", "status", "loc"), ("apply_patch", "", "patch"), ("node", "fs.writeFileSync('a')", "patch"), ("grep", "x a.py", "loc")]
    f = spark.createDataFrame([(k, c, a.split()) for k, (c, a, _) in enumerate(shell)], "k long, c string, a array<string>")
    own = f.select("k", rules.codex_shell_class(none, none, F.col("c"), F.col("a"), F.create_map().cast("map<string,string>")).alias("p"))
    assert {r.k: r.p for r in own.collect()} == {k: p for k, (_, _, p) in enumerate(shell)}
    tools = [("update_plan", "plan"), ("apply_patch", "patch"), ("write_file", "patch"), ("web_search", "loc"), ("read_file", "loc"), ("echo", "loc"), ("image_generation", "general")]
    g = spark.createDataFrame(list(enumerate(t for t, _ in tools)), "k long, t string")
    assert {r.k: r.p for r in g.select("k", rules.codex_tool_class(F.col("t"), F.array().cast("array<string>")).alias("p")).collect()} == {k: p for k, (_, p) in enumerate(tools)}
    claude = [("Read", {"file_path": "a.py"}, "loc"), ("Read", {"file_path": "tests/a.py"}, "ctx"), ("Write", {"path": "a.py"}, "patch"), ("Edit", {"path": "tests/b.py"}, "ctx"), ("Grep", {"pattern": "x"}, "loc"), ("Glob", {"path": "src"}, "loc"), ("TodoWrite", {}, "plan"), ("Bash", {}, "ctx")]
    h = spark.createDataFrame([(k, t, a) for k, (t, a, _) in enumerate(claude)], "k long, t string, a map<string,string>")
    assert {r.k: r.p for r in h.select("k", rules.claude_tool_class(F.col("t"), F.col("a")).alias("p")).collect()} == {k: p for k, (_, _, p) in enumerate(claude)}


def test_discovery_listing_and_sinks(spark, tmp_path):
    for name in ("m1/run/output.jsonl", "m1/run/report.json", "m2/i1/i1.traj.json", "m2/i2/i2.traj.json", "m3/i1/i1.traj", "m4/i9.traj"):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_text("{}")
    got = {(r.agent, r.source_id, bool(r.report)) for r in logs.discovered(spark, str(tmp_path / "in")).collect()}
    assert got == {("oh", "m1/run", True), ("msa", "m2", False), ("sa", "m3", False), ("sa", "m4", False)}
    runs = spark.createDataFrame([("a",), ("b",), ("c",)], "traj string")
    steps = spark.createDataFrame([("a", 0), ("a", 0), ("a", 1), ("b", 0)], "traj string, step_idx long")
    report = spark.createDataFrame([(["a"], ["b"])], "resolved_ids array<string>, unresolved_ids array<string>")
    hard = spark.createDataFrame([("a", "under1h")], "traj string, difficulty string")
    out = {tuple(r) for r in logs.listing(runs, steps, report, hard).collect()}
    assert out == {("a", "resolved", "under1h", 2), ("b", "unresolved", "unknown", 1), ("c", "unsubmitted", "unknown", 0)}
    stats = spark.createDataFrame([("s1", "a", 1, 2.0), ("s1", "b", 3, None), ("s2", "c", 5, 4.0)], "source_id string, traj string, n long, x double")
    logs.write_stats(stats, spark.createDataFrame([("s1", "p"), ("s2", "q")], "source_id string, source string"), f"{tmp_path}/out", {"limit": "3"})
    assert spark.read.option("header", "true").csv(f"{tmp_path}/out/rows").count() == 3
    assert {(r.source_id, r.runs, r.n, r.x) for r in spark.read.json(f"{tmp_path}/out/summary").collect()} == {(None, 3, 3.0, 3.0), ("s1", 2, 2.0, 2.0), ("s2", 1, 5.0, 4.0)}
