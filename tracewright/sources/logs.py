"""Run logs of several agents as steps, calls and listings. Each reader takes a frame of text and gives frames."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.operators.aggregates import statuses

SA = "trajectory array<struct<action:string,thought:string,observation:string>>"
FUNCTION = "struct<name:string,arguments:string>"
OH = f"instance_id string, history array<struct<observation:string,content:string,tool_call_metadata:struct<function:{FUNCTION},model_response:struct<choices:array<struct<message:struct<content:string,tool_calls:array<struct<function:{FUNCTION}>>>>>>>>>"
MESSAGE = "struct<role:string,content:string,reasoning_content:string,tool_call_id:string,extra:struct<actions:array<struct<command:string,tool_call_id:string>>,raw_output:string,returncode:int,exception_info:string,exit_status:string,interrupt_type:string>>"
MSA = f"trajectory_format string, info struct<mini_version:string>, messages array<{MESSAGE}>"
CLAUDE = "type string, uuid string, session_id string, cwd string, message struct<role:string,model:string,content:array<struct<type:string,id:string,name:string,input:string,text:string,tool_use_id:string,content:string,is_error:boolean>>>"
CODEX = "type string, payload struct<type:string,id:string,cwd:string,originator:string,model:string,role:string,phase:string,content:string,summary:string,message:string,name:string,arguments:string,input:string,action:string,call_id:string,output:string,exit_code:int,success:boolean,formatted_output:string,aggregated_output:string,stdout:string,stderr:string,result:string,error:string>"
REPORT = "resolved_ids array<string>, unresolved_ids array<string>"

ADAPTERS: dict = {}


def register_adapter(name: str, steps) -> None:
    """A reader of steps (DataFrame of id, text -> DataFrame of steps) under a name."""
    ADAPTERS[name] = steps


def whole_files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """traj, path, text: a row for each file below path whose name fits; the id is the name without its ending."""
    files = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path, wholetext=True)
    name = F.col("_metadata.file_name")
    return files.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("traj"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """text, path: a row for each line that isn't blank."""
    return spark.read.text(path).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path")).where(F.trim("text") != "")


def parsed(rows: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose text is JSON of the schema (column j), and the rejects."""
    read = rows.withColumn("j", F.from_json("text", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("j").isNull() | F.col("j._bad").isNotNull() | F.expr("try_parse_json(text) is null")
    return read.where(~bad), read.where(bad).drop("j")


def sa_steps(rows: DataFrame) -> DataFrame:
    good, _ = parsed(rows, SA)
    return good.select("traj", F.posexplode("j.trajectory").alias("step_idx", "s")).select("traj", F.col("step_idx").cast("long").alias("step_idx"), "s.thought", F.col("s.action").alias("action_text"), "s.observation", (F.trim(F.coalesce("s.action", F.lit(""))) == "").alias("is_think"))


def oh_steps(rows: DataFrame) -> DataFrame:
    """Steps of history entries that hold an observation of a call: the first tool call of the first choice, else the
    metadata's own function; bash gives its command as text, another tool its command as subcommand."""
    good, _ = parsed(rows, OH)
    h = good.where(F.col("j.instance_id").isNotNull()).select(F.col("j.instance_id").alias("traj"), F.posexplode("j.history").alias("_pos", "h"))
    h = h.where(F.col("h.observation").isNotNull() & ~F.col("h.observation").isin("system", "message"))
    message = F.col("h.tool_call_metadata.model_response.choices")[0]["message"]
    fn = F.coalesce(F.filter(message["tool_calls"], lambda c: c["function"].isNotNull())[0]["function"], F.col("h.tool_call_metadata.function"))
    args = F.coalesce(F.from_json(fn["arguments"], "map<string,string>"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    w = Window.partitionBy("traj").orderBy("_pos")
    h = h.select("traj", "_pos", message["content"].alias("thought"), F.col("h.content").alias("observation"), fn["name"].alias("tool"), args.alias("_args"))
    bash = F.col("tool") == "execute_bash"
    command = F.element_at("_args", "command")
    return h.select(
        "traj", (F.row_number().over(w) - 1).cast("long").alias("step_idx"), "thought", "observation", "tool", F.when(bash, command).alias("action_text"), F.when(~bash, command).alias("subcommand"), F.map_filter("_args", lambda k, v: k != "command").alias("args")
    )


def msa_format(messages_json: Column) -> Column:
    """v2, v1 or default by what a run holds."""
    j = F.from_json(messages_json, MSA)
    v2 = F.coalesce(j["info"]["mini_version"].startswith("2"), F.lit(False)) | F.coalesce(F.exists(j["messages"], lambda m: m["extra"]["actions"].isNotNull()), F.lit(False))
    return F.when(v2, "v2").when(j["trajectory_format"] == "mini-swe-agent-1", "v1").otherwise("default")


def msa_v1_steps(rows: DataFrame) -> DataFrame:
    """A step for each assistant message: the thought after THOUGHT:, the first fenced bash block, the next output."""
    good, _ = parsed(rows, MSA)
    m = good.select("traj", F.posexplode("j.messages").alias("_pos", "m")).select("traj", "_pos", "m.role", "m.content")
    w = Window.partitionBy("traj").orderBy("_pos")
    m = m.withColumn("_next", F.when(F.lead("role").over(w) == "user", F.lead("content").over(w))).where("role = 'assistant'")
    return m.select(
        "traj",
        (F.row_number().over(w) - 1).cast("long").alias("step_idx"),
        F.trim(F.regexp_extract("content", r"(?s)THOUGHT:\s*(.*?)\s*(?:```|$)", 1)).alias("thought"),
        F.regexp_extract("content", r"(?s)```bash\s*\n(.*?)\n?```", 1).alias("action_text"),
        F.trim(F.regexp_extract("_next", r"(?s)<output>(.*?)</output>", 1)).alias("observation"),
    )


def msa_default_steps(rows: DataFrame) -> DataFrame:
    """A step for each message from the third on with a list of output blocks; the message after it, which is no step of
    its own, gives the observation. commands: those of the step's function calls, in order."""
    blocks = "array<struct<type:string,arguments:string,content:array<struct<text:string>>>>"
    good, _ = parsed(rows, "messages array<struct<role:string,output:string,extra:struct<raw_output:string>>>")
    w = Window.partitionBy("traj").orderBy("_pos")
    m = good.select("traj", F.posexplode("j.messages").alias("_pos", "m")).where("_pos >= 2").withColumn("_list", F.coalesce(F.col("m.output").startswith("["), F.lit(False)))
    # Of messages with lists in a row, every second one is the observation of the one before.
    m = m.withColumn("_next", F.lead("m").over(w)).withColumn("_i", F.row_number().over(w) - F.row_number().over(Window.partitionBy("traj", "_list").orderBy("_pos")))
    m = m.withColumn("_k", F.row_number().over(Window.partitionBy("traj", "_list", "_i").orderBy("_pos"))).where("_list and _k % 2 = 1")
    m = m.withColumn("_b", F.from_json("m.output", blocks))
    said = F.filter("_b", lambda b: (b["type"] == "message") & (F.size(b["content"]) > 0))
    asked = F.transform(F.filter("_b", lambda b: b["type"] == "function_call"), lambda b: F.get_json_object(b["arguments"], "$.command"))
    told = F.when(F.col("_next.output").isNotNull() & ~F.col("_next.output").startswith("["), F.col("_next.output")).otherwise(F.col("_next.extra.raw_output"))
    return m.select(
        "traj",
        (F.row_number().over(w) - 1).cast("long").alias("step_idx"),
        F.coalesce(F.get(said, F.lit(0))["content"][0]["text"], F.lit("")).alias("thought"),
        F.filter(asked, lambda c: F.coalesce(c, F.lit("")) != "").alias("commands"),
        F.coalesce(told, F.lit("")).alias("observation"),
    )


def msa_v2_calls(rows: DataFrame) -> DataFrame:
    """Calls of each assistant turn with the results found for them in the turn's span, and what the span tells of it:
    exit_status (the last one), feedback (texts of interrupts).

    A result goes by its call id if just one result of a tool has it; results of a user without an id go by place, if
    there are as many of them as calls without an id; else the result is missing."""
    good, _ = parsed(rows, MSA)
    m = good.select("traj", F.posexplode("j.messages").alias("_pos", "m"))
    w = Window.partitionBy("traj").orderBy("_pos")
    m = m.withColumn("turn", F.sum((F.col("m.role") == "assistant").cast("long")).over(w) - 1).where("turn >= 0")
    turns = m.where("m.role = 'assistant'")
    thought = F.array_join(F.array_distinct(F.filter(F.array(F.trim("m.reasoning_content"), F.trim("m.content")), lambda t: F.coalesce(t, F.lit("")) != "")), "\n\n")
    wanted = F.filter("m.extra.actions", lambda a: F.trim(F.coalesce(a["command"], F.lit(""))) != "")
    calls = turns.select("traj", F.col("turn").alias("step_idx"), thought.alias("thought"), F.posexplode_outer(wanted).alias("call_pos", "a")).select("traj", "step_idx", "thought", "call_pos", F.col("a.command").alias("text"), F.nullif("a.tool_call_id", F.lit("")).alias("call_id"))
    output = F.regexp_extract("m.content", r"(?s)<output>(.*?)</output>", 1)
    shown = F.coalesce("m.extra.raw_output", F.when(F.col("m.content").rlike(r"(?s)<output>.*?</output>"), F.trim(output)).otherwise(F.col("m.content")))
    code = F.coalesce("m.extra.returncode", F.nullif(F.regexp_extract("m.content", r"<returncode>\s*(-?\d+)\s*</returncode>", 1), F.lit("")).cast("int"))
    own_id = F.nullif("m.tool_call_id", F.lit(""))
    is_result = F.col("m.extra.returncode").isNotNull() | F.col("m.extra.raw_output").isNotNull() | F.coalesce(F.contains("m.content", F.lit("<output>")), F.lit(False))
    told = m.where("m.role <> 'assistant'").select("traj", F.col("turn").alias("step_idx"), "_pos", F.col("m.role").alias("role"), own_id.alias("call_id"), shown.alias("observation"), code.alias("returncode"), F.col("m.extra.exception_info").alias("exception_info"), is_result.alias("_is"), "m.extra.exit_status", "m.extra.interrupt_type", F.col("m.content").alias("content"))
    values = F.struct("observation", "returncode", "exception_info")
    by_id = Window.partitionBy("traj", "step_idx", "call_id")
    keyed = told.where("role = 'tool' and call_id is not null").withColumn("_n", F.count("*").over(by_id)).where("_n = 1").select("traj", "step_idx", "call_id", values.alias("_kv"))
    loose = told.where("role in ('user', 'tool') and call_id is null")
    place = Window.partitionBy("traj", "step_idx")
    free = loose.where("_is").withColumn("_k", F.row_number().over(place.orderBy("_pos"))).withColumn("_m", F.count("*").over(place)).select("traj", "step_idx", values.alias("_fv"), "_k", "_m")
    stopped = loose.where("not _is and interrupt_type is not null").groupBy("traj", "step_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "content"))), lambda x: x["content"]), "\n\n").alias("feedback"))
    status = told.where("exit_status <> ''").groupBy("traj", "step_idx").agg(F.max_by("exit_status", "_pos").alias("exit_status"))
    all_ = Window.partitionBy("traj", "step_idx", "_free")
    c = calls.withColumn("_free", F.col("call_id").isNull() & F.col("text").isNotNull()).withColumn("_k", F.row_number().over(all_.orderBy("call_pos"))).withColumn("_m", F.count("*").over(all_))
    out = c.join(keyed, ["traj", "step_idx", "call_id"], "left").join(free, ["traj", "step_idx", "_k", "_m"], "left").join(stopped, ["traj", "step_idx"], "left").join(status, ["traj", "step_idx"], "left")
    found = F.when(F.col("call_id").isNotNull(), F.col("_kv")).when(F.col("_free"), F.col("_fv"))
    out = out.withColumn("_v", found)
    return out.select("traj", "step_idx", "call_pos", "thought", "text", "call_id", "_v.observation", F.col("_v.returncode").alias("exit_code"), "_v.exception_info", (F.col("_v").isNull() & F.col("text").isNotNull()).alias("result_missing"), "exit_status", F.coalesce("feedback", F.lit("")).alias("feedback"))


def records(rows: DataFrame, schema: str) -> DataFrame:
    """rec_no, j of each line of a session: rows (session, rec_no, text)."""
    return rows.withColumn("j", F.from_json("text", schema)).where(F.col("j").isNotNull())


def is_codex(rows: DataFrame, first: int = 41) -> DataFrame:
    """session, codex: a session_meta and an event among its first records."""
    n = F.row_number().over(Window.partitionBy("session").orderBy("rec_no"))
    r = records(rows, CODEX).withColumn("_n", n).where(F.col("_n") <= first)
    return r.groupBy("session").agg((F.bool_or(F.col("j.type") == "session_meta") & F.bool_or(F.col("j.type").isin("response_item", "event_msg", "turn_context"))).alias("codex"))


CODEX_CALLS = ["function_call", "custom_tool_call", "local_shell_call", "web_search_call", "image_generation_call", "mcp_tool_call"]
CODEX_OUTPUTS = ["function_call_output", "custom_tool_call_output"]
CODEX_ENDS = ["exec_command_end", "patch_apply_end", "mcp_tool_call_end", "dynamic_tool_call_response", "web_search_end"]


def codex_steps_of(events):
    """Of one session: the step of each call and text. A call opens a step if none is open or the open one has got
    output, which belongs to the step of its call however late it comes. Texts go to the step that opens next; a final
    answer is a step of its own, once."""
    import pandas as pd

    v = events.sort_values("rec_no", kind="stable")
    step, current, got, waiting, of_call, answers, rows = -1, None, set(), [], {}, set(), []

    def opened(rec_no: int) -> int:
        nonlocal step, waiting
        step += 1
        rows.extend((r, step) for r in waiting)
        waiting = []
        return step

    for rec_no, kind, call_id, answer in zip(v.rec_no, v.kind, v.call_id, v.answer, strict=True):
        if kind == "text":
            waiting.append(rec_no)
        elif kind == "answer" and answer not in answers:
            answers.add(answer)
            rows.append((rec_no, opened(rec_no)))
            current = None
        elif kind == "call":
            if current is None or current in got:
                current = opened(rec_no)
            of_call[call_id] = current
            rows.append((rec_no, current))
        elif kind == "output" and call_id in of_call:
            got.add(of_call[call_id])
    out = pd.DataFrame(rows, columns=["rec_no", "step_idx"])
    out.insert(0, "session", v.session.iloc[0])
    return out


def codex_calls(rows: DataFrame) -> DataFrame:
    """session, step_idx, call_pos, thought, call_id, name, arguments, observation, exit_code, is_error; final answers are
    calls named final_answer. Only ids and hashes of a session meet in one task to find its steps (codex_steps_of)."""
    r = records(rows, CODEX).select("session", "rec_no", F.col("j.type").alias("record"), "j.payload.*")
    text = F.coalesce(F.array_join(F.transform(F.from_json("content", "array<struct<text:string>>"), lambda b: b["text"]), "\n"), F.col("content"), F.col("message"), F.array_join(F.transform(F.from_json("summary", "array<struct<text:string>>"), lambda b: b["text"]), "\n"))
    response, event = F.col("record") == "response_item", F.col("record") == "event_msg"
    final = F.coalesce(F.col("phase") == "final_answer", F.lit(False))
    message = response & (F.col("type") == "message") & (F.col("role") == "assistant")
    kind = (
        F.when(response & F.col("type").isin(CODEX_CALLS), "call").when(response & F.col("type").isin(CODEX_OUTPUTS), "output").when((message | event) & final & (F.trim(text) != ""), "answer")
        .when((message | (response & (F.col("type") == "reasoning"))) & (F.trim(text) != ""), "text").when(event & F.col("type").isin(CODEX_ENDS), "output")
    )
    own_id = F.coalesce(F.nullif("call_id", F.lit("")), F.when(kind == "call", F.coalesce("id", F.concat(F.lit("call-"), F.col("rec_no").cast("string")))))
    r = r.withColumn("kind", kind).withColumn("call_id", own_id).withColumn("said", F.trim(text)).where("kind is not null")
    light = r.select("session", "rec_no", "kind", "call_id", F.when(F.col("kind") == "answer", F.md5("said")).alias("answer"))
    placed = light.groupBy("session").applyInPandas(codex_steps_of, "session string, rec_no long, step_idx long")
    put = r.join(placed, ["session", "rec_no"])
    thoughts = put.where("kind = 'text'").groupBy("session", "step_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rec_no", "said"))), lambda x: x["said"]), "\n\n").alias("thought"))
    named = F.when(F.col("kind") == "answer", "final_answer").otherwise(F.coalesce(F.nullif("name", F.lit("")), F.when(F.col("type") == "web_search_call", "web_search").when(F.col("type") == "image_generation_call", "image_generation"), F.col("type")))
    calls = put.where("kind in ('call', 'answer')").select("session", "rec_no", "step_idx", F.coalesce("call_id", F.concat(F.lit("final-"), F.col("step_idx").cast("string"))).alias("call_id"), named.alias("name"), F.when(F.col("kind") == "answer", F.col("said")).otherwise(F.coalesce("arguments", "input", "action")).alias("arguments"))
    # Outputs are put one below the other; one that is held already is skipped.
    shown = F.coalesce("output", "formatted_output", "aggregated_output", "stdout", "stderr", "result", "error")
    lines_ = F.transform(F.array_sort(F.collect_list(F.struct("rec_no", shown.alias("o")))), lambda x: x["o"])
    joined = F.aggregate(F.col("_o"), F.lit(""), lambda acc, x: F.when(F.coalesce(x, F.lit("")) == "", acc).when(F.contains(acc, x), acc).when(acc == "", x).otherwise(F.concat(acc, F.lit("\n"), x)))
    out = r.where("kind = 'output'").groupBy("session", "call_id").agg(lines_.alias("_o")).select("session", "call_id", joined.alias("observation"))
    failed = F.when(F.col("type") == "exec_command_end", F.col("exit_code") != 0).otherwise(F.when(F.coalesce("error", F.lit("")) != "", True).otherwise(~F.col("success")))
    ends = r.where(F.col("type").isin(CODEX_ENDS)).groupBy("session", "call_id").agg(F.max_by("exit_code", F.when(F.col("exit_code").isNotNull(), F.col("rec_no"))).alias("exit_code"), F.max_by(failed, F.when(failed.isNotNull(), F.col("rec_no"))).alias("is_error"))
    w = Window.partitionBy("session", "step_idx").orderBy("rec_no")
    whole = calls.join(out, ["session", "call_id"], "left").join(ends, ["session", "call_id"], "left").join(thoughts, ["session", "step_idx"], "left")
    return whole.withColumn("call_pos", (F.row_number().over(w) - 1).cast("long")).withColumn("thought", F.coalesce("thought", F.lit(""))).drop("rec_no")


WIRE = "type string, event struct<type:string,uuid:string,stepUuid:string,part:struct<type:string,think:string,text:string>,toolCallId:string,name:string,args:string,description:string,result:struct<output:string,message:string,isError:boolean,is_error:boolean>>"


def claude_wire_calls(rows: DataFrame) -> DataFrame:
    """session, step_idx, call_pos, thought, call_id, name, input, observation, is_error of wire events: step.begin opens
    a step, parts and calls go to the step they name, else to the open one; the last result of a call counts, with its
    message below the output unless that holds it. Steps without calls have one row without a call."""
    r = records(rows, WIRE).where("j.type = 'context.append_loop_event'").select("session", "rec_no", "j.event.*")
    w = Window.partitionBy("session").orderBy("rec_no")
    r = r.withColumn("_open", F.sum((F.col("type") == "step.begin").cast("long")).over(w) - 1)
    begun = r.where("type = 'step.begin'").select("session", F.coalesce("uuid", F.col("_open").cast("string")).alias("stepUuid"), F.col("rec_no").alias("_from"), F.col("_open").alias("_named"))
    parts = r.where("type in ('content.part', 'tool.call')").join(begun, ["session", "stepUuid"], "left").where("_from is null or _from < rec_no")
    parts = parts.groupBy("session", "rec_no").agg(F.max("_named").alias("_named"), *[F.first(c).alias(c) for c in ("type", "_open", "part", "toolCallId", "uuid", "name", "args", "description")]).withColumn("step_idx", F.coalesce("_named", "_open")).where("step_idx >= 0")
    said = F.when(F.col("part.type") == "think", F.coalesce(F.nullif("part.think", F.lit("")), "part.text")).when(F.col("part.type") == "text", F.col("part.text"))
    thoughts = parts.where("type = 'content.part'").withColumn("_s", said).where("_s <> ''").groupBy("session", "step_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rec_no", "_s"))), lambda x: x["_s"]), "\n").alias("thought"))
    calls = parts.where("type = 'tool.call'").select("session", "rec_no", "step_idx", F.coalesce(F.nullif("toolCallId", F.lit("")), "uuid").alias("call_id"), F.coalesce(F.nullif("name", F.lit("")), F.lit("tool")).alias("name"), F.col("args").alias("input"), "description")
    blocks = F.array_join(F.transform(F.from_json("result.output", "array<struct<text:string>>"), lambda b: b["text"]), "\n")
    output = F.coalesce(F.when(F.col("result.output").startswith("["), blocks), F.col("result.output"), F.lit(""))
    message = F.coalesce("result.message", F.lit(""))
    whole = F.when((message == "") | F.contains(output, message), output).otherwise(F.trim(F.concat(output, F.lit("\n"), message)))
    error = F.coalesce("result.isError", "result.is_error")
    results = r.where("type = 'tool.result'").groupBy("session", F.col("toolCallId").alias("call_id")).agg(F.max_by(whole, "rec_no").alias("observation"), F.max_by(error, F.when(error.isNotNull(), F.col("rec_no"))).alias("is_error"))
    placed = calls.join(results, ["session", "call_id"], "left").withColumn("call_pos", (F.row_number().over(Window.partitionBy("session", "step_idx").orderBy("rec_no")) - 1).cast("long")).drop("rec_no")
    steps = begun.select("session", F.col("_named").alias("step_idx"))
    return steps.join(placed, ["session", "step_idx"], "left").join(thoughts, ["session", "step_idx"], "left").withColumn("thought", F.coalesce("thought", F.lit("")))


def claude_calls(rows: DataFrame) -> DataFrame:
    """session, step_idx, call_pos, thought, name, input, observation, is_error: a step for each assistant record with
    tool uses; of several results for one use the last counts."""
    r = records(rows, CLAUDE)
    blocks = r.select("session", "rec_no", F.col("j.message.role").alias("role"), F.col("j.message.content").alias("blocks"))
    text = F.array_join(F.transform(F.filter("blocks", lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")
    uses = blocks.where("role = 'assistant'").withColumn("_u", F.filter("blocks", lambda b: b["type"] == "tool_use")).where(F.size("_u") > 0)
    w = Window.partitionBy("session").orderBy("rec_no")
    uses = uses.withColumn("step_idx", (F.row_number().over(w) - 1).cast("long")).select("session", "step_idx", text.alias("thought"), F.posexplode("_u").alias("call_pos", "u")).select("session", "step_idx", "call_pos", "thought", F.col("u.id").alias("call_id"), F.col("u.name").alias("name"), F.col("u.input").alias("input"))
    results = blocks.select("session", "rec_no", F.posexplode("blocks").alias("_b", "b")).where("b.type = 'tool_result'").groupBy("session", F.col("b.tool_use_id").alias("call_id")).agg(F.max_by("b.content", F.struct("rec_no", "_b")).alias("observation"), F.max_by("b.is_error", F.when(F.col("b.is_error").isNotNull(), F.struct("rec_no", "_b"))).alias("is_error"))
    return uses.join(results, ["session", "call_id"], "left")


def claude_sessions(rows: DataFrame) -> DataFrame:
    """Calls of sessions of both layouts: those with assistant or user records are transcripts, the others wire events."""
    native = rows.groupBy("session").agg(F.bool_or(F.coalesce(F.get_json_object("text", "$.type").isin("assistant", "user"), F.lit(False))).alias("_n"))
    told = rows.join(native, "session")
    wire = claude_wire_calls(told.where("not _n").drop("_n"))
    return claude_calls(told.where("_n").drop("_n")).unionByName(wire, allowMissingColumns=True)


def session_listing(rows: DataFrame) -> DataFrame:
    """session, title (first user text, one line, cut at 96), model, cwd, step_count of native transcripts."""
    r = records(rows, CLAUDE)
    first = F.get(F.filter("j.message.content", lambda b: b["type"] == "text"), F.lit(0))["text"]
    user = F.when(F.col("j.message.role") == "user", F.trim(F.regexp_replace(first, r"\s+", " ")))
    g = r.groupBy("session").agg(F.min_by(user, F.when(user.isNotNull(), F.col("rec_no"))).alias("_t"), F.min_by("j.message.model", F.when(F.col("j.message.model").isNotNull(), F.col("rec_no"))).alias("model"), F.min_by("j.cwd", F.when(F.col("j.cwd").isNotNull(), F.col("rec_no"))).alias("cwd"), F.count_if((F.col("j.message.role") == "assistant") & F.exists("j.message.content", lambda b: b["type"] == "tool_use")).alias("step_count"))
    return g.select("session", F.when(F.length("_t") > 96, F.concat(F.left("_t", F.lit(93)), F.lit("..."))).otherwise(F.col("_t")).alias("title"), "model", "cwd", "step_count")


#: What ends a line in a text.
LINE_END = r"(?:\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029])"


def raw_sizes(rows: DataFrame, *, entries: bool = False) -> DataFrame:
    """traj, n_lines, n_chars of each run's text; of entries, which are one line each however long the run, as JSON written
    with an indent of two. An entry that is no JSON counts as it is."""
    if entries:

        @F.pandas_udf("string")
        def spread(texts: pd.Series) -> pd.Series:
            def one(text):
                try:
                    return json.dumps(json.loads(text), indent=2, ensure_ascii=False)
                except (TypeError, ValueError):
                    return text

            return texts.map(one)

        rows = rows.withColumn("text", spread("text"))
    last = F.when((F.col("text") != "") & ~F.col("text").rlike(LINE_END + r"\z"), 1).otherwise(0)
    return rows.select("traj", (F.regexp_count("text", F.lit(LINE_END)) + last).cast("long").alias("n_lines"), F.length("text").cast("long").alias("n_chars"))


def agent_of(path: Column) -> Column:
    """The kind of log by its path."""
    return F.when(path.endswith(".traj"), "sa").when(path.endswith("output.jsonl"), "oh").when(path.endswith(".traj.json"), "msa").when(path.contains("rollout-"), "codex").when(path.endswith(".jsonl"), "claude")


def discovered(spark: SparkSession, root: str) -> DataFrame:
    """agent, source_id, source, report: the sources below root, by their files' names. A source is the folder of the
    logs; where each run has a folder of its own name, the one above. A report.json beside output.jsonl belongs to it.
    Files are listed, not read."""
    base = root.rstrip("/")
    paths = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base).select("path")
    name, folder = F.regexp_extract("path", "([^/]*)$", 1), F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    p = paths.select("path", name.alias("name"), folder.alias("folder")).withColumn("up", F.regexp_extract("folder", "^(.*)/[^/]*$", 1)).withColumn("last", F.regexp_extract("folder", "([^/]*)$", 1))
    top = F.regexp_replace(F.lit(base), "^file:/*", "/")
    at = lambda c: F.regexp_replace(c, "^file:/*", "/")
    kind = F.when(F.col("name") == "output.jsonl", "oh").when(F.col("name").endswith(".traj.json"), "msa").when(F.col("name").endswith(".traj"), "sa")
    nested = (kind == "sa") & (F.concat("last", F.lit(".traj")) == F.col("name")) & (at(F.col("up")) != top)
    source = F.when(kind == "oh", F.col("path")).when((kind == "msa") | nested, F.col("up")).otherwise(F.col("folder"))
    label = at(F.when(kind == "oh", F.col("folder")).otherwise(source))
    own = p.withColumn("agent", kind).where("agent is not null").select("agent", source.alias("source"), F.when(label == top, F.regexp_extract(top, "([^/]*)$", 1)).otherwise(F.replace(label, F.concat(top, F.lit("/")), F.lit(""))).alias("source_id"), F.when(kind == "oh", F.col("folder")).alias("_f")).distinct()
    reports = p.where("name = 'report.json'").select(F.col("folder").alias("_f"), F.col("path").alias("report"))
    return own.join(reports, "_f", "left").drop("_f")


def listing(runs: DataFrame, steps: DataFrame, reports: DataFrame | None = None, difficulties: DataFrame | None = None) -> DataFrame:
    """traj, status, difficulty, step_count for each run, also one without steps. steps: traj, step_idx (a row for each
    step or call); reports: as for statuses(); difficulties: traj, difficulty ("unknown" where there is none)."""
    counted = steps.groupBy("traj").agg(F.countDistinct("step_idx").alias("step_count"))
    out = statuses(runs.select("traj").distinct(), reports).join(counted, "traj", "left").na.fill(0, ["step_count"])
    return with_difficulty(out, difficulties).select("traj", "status", "difficulty", "step_count")


def with_difficulty(runs: DataFrame, difficulties: DataFrame | None) -> DataFrame:
    """runs with difficulty from a dimension (traj, difficulty), "unknown" where it has none."""
    if difficulties is None:
        return runs.withColumn("difficulty", F.lit("unknown"))
    one = difficulties.groupBy("traj").agg(F.max("difficulty").alias("difficulty"))
    return runs.join(one, "traj", "left").na.fill("unknown", ["difficulty"])


def write_metrics(metrics: DataFrame, path: str) -> None:
    """A CSV with a header; arrays and structs as JSON."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in metrics.dtypes]
    metrics.select(*flat).write.option("header", "true").csv(path)


def write_stats(stats: DataFrame, sources: DataFrame, path: str, config: dict[str, str]) -> None:
    """path/rows as CSV; path/summary as JSON rows: the mean of each number over all runs (no source_id) and by source;
    path/config and path/sources as JSON. stats: source_id, traj and numbers."""
    numbers = [c for c, t in stats.dtypes if t in ("int", "bigint", "double") and c not in ("traj", "source_id")]
    write_metrics(stats, f"{path}/rows")
    each = stats.rollup("source_id").agg(F.count("*").alias("runs"), F.grouping("source_id").alias("_all"), *[F.avg(c).alias(c) for c in numbers])
    each.orderBy(F.desc("_all"), "source_id").drop("_all").coalesce(1).write.json(f"{path}/summary")
    sources.orderBy(*sources.columns[:2]).coalesce(1).write.json(f"{path}/sources")
    sources.sparkSession.createDataFrame(sorted(config.items()), "name string, value string").coalesce(1).write.json(f"{path}/config")


NODE = "struct<node_ord:bigint,id:string,label:string,args:map<string,string>,flags:map<string,string>,phases:array<string>,step_indices:array<bigint>,has_cd:boolean,thought_len_raw:bigint,thought_len_clean:bigint,observation_length:bigint,observation_outcome:string>"
EDGE = "struct<edge_ord:bigint,src:bigint,dst:bigint,type:string,label:string,is_first_in_step:boolean,thought_length_raw:bigint,thought_length_clean:bigint>"


def graph_rows(nodes: DataFrame, edges: DataFrame, hier: DataFrame, meta: DataFrame) -> DataFrame:
    """A node-link row for each run, from graph.build_graph()'s frames; meta: traj, agent, model, status, difficulty."""
    n = nodes.withColumnsRenamed({"key": "id", "observation_len": "observation_length"}).groupBy("traj").agg(F.collect_list(F.struct("node_ord", "id", "label", "args", "flags", "phases", "step_indices", "has_cd", "thought_len_raw", "thought_len_clean", "observation_length", "observation_outcome")).alias("nodes"))
    n = n.withColumn("nodes", F.array_sort("nodes", lambda x, y: (x["node_ord"] - y["node_ord"]).cast("int")))
    e = edges.select("traj", "edge_ord", "src", "dst", F.lit("exec").alias("type"), F.col("step_idx").cast("string").alias("label"), "is_first_in_step", F.col("thought_len_raw").alias("thought_length_raw"), F.col("thought_len_clean").alias("thought_length_clean"))
    # Hier edges come after the exec ones, in their order below each node.
    after = F.row_number().over(Window.partitionBy("traj").orderBy("src", "rank")) + (1 << 40)
    h = hier.select("traj", after.cast("long").alias("edge_ord"), "src", "dst", F.lit("hier").alias("type"), F.lit("").alias("label"), F.lit(None).cast("boolean").alias("is_first_in_step"), F.lit(None).cast("long").alias("thought_length_raw"), F.lit(None).cast("long").alias("thought_length_clean"))
    links = e.unionByName(h).groupBy("traj").agg(F.array_sort(F.collect_list(F.struct("edge_ord", "src", "dst", "type", "label", "is_first_in_step", "thought_length_raw", "thought_length_clean"))).alias("edges"))
    graph = F.struct(F.col("status").alias("resolution_status"), F.col("traj").cast("string").alias("instance_name"), F.col("difficulty").alias("debug_difficulty"))
    return n.join(links, "traj", "left").join(meta, "traj").select("agent", "model", F.lit(True).alias("directed"), F.lit(True).alias("multigraph"), graph.alias("graph"), "nodes", F.coalesce("edges", F.array().cast(f"array<{EDGE}>")).alias("edges"))


def write_graphs(nodes: DataFrame, edges: DataFrame, hier: DataFrame, meta: DataFrame, path: str) -> None:
    """graph_rows() as JSON, below path by agent and model."""
    graph_rows(nodes, edges, hier, meta).write.partitionBy("agent", "model").json(path)


def read_graphs(spark: SparkSession, path: str) -> DataFrame:
    """Rows of node-link JSON, nodes at the top or below graph; rows that can't be read are left out."""
    schema = f"graph struct<resolution_status:string,instance_name:string,debug_difficulty:string,nodes:array<{NODE}>>, nodes array<{NODE}>, edges array<{EDGE}>, agent string, model string, _bad string"
    read = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_bad").json(path)
    return read.where("_bad is null and graph is not null").withColumn("nodes", F.coalesce("nodes", "graph.nodes")).drop("_bad")


def merged(old: DataFrame, new: DataFrame, key: str = "traj") -> DataFrame:
    """old and new rows by key, the new one where both have it, in order of the key."""
    both = old.select(key, F.struct(*old.columns).alias("_o")).join(new.select(key, F.struct(*old.columns).alias("_n")), key, "full")
    return both.select(F.coalesce("_n", "_o").alias("_r")).select("_r.*").orderBy(key)


for _name, _steps in (("sa", sa_steps), ("oh", oh_steps), ("msa-v1", msa_v1_steps), ("msa-v2", msa_v2_calls), ("msa-default", msa_default_steps), ("codex", codex_calls), ("claude", claude_sessions)):
    register_adapter(_name, _steps)
