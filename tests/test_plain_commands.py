"""Commands of plain words take no pattern; their arguments are those of the full way."""

from pyspark.sql import functions as F

from tracewright.operators import commands


def test_plain_words_skip_the_options(spark):
    rows = [(0, "ls", []), (1, "ls", ["a", "b c"]), (2, "ls", ['"a b"', "'c'", "d\\ e"]), (3, "ls", ["", "a-b", "x"]), (4, "python", ["-c", "code", "y"]), (5, "ls", ["-la", "--k=v", "p"]), (6, "ls", None), (7, None, ["a"])]
    frame = spark.createDataFrame(rows, "id int, command string, args array<string>")
    own = frame.select("id", commands.parsed_arguments(F.col("command"), F.col("args")).alias("p"))
    got = {r.id: (r.p.argv, r.p.flags) if r.p else None for r in own.collect()}
    assert got[0] == ([], {}) and got[1] == (["a", "b c"], {}) and got[2] == (["a b", "c", "d e"], {}) and got[3] == (["", "a-b", "x"], {})
    assert got[4] == (["y"], {"c": "code"}) and got[5] == (["p"], {"l": "true", "a": "true", "k": "v"}) and got[7] == (["a"], {})
    assert got[6] in (None, (None, None))
    assert "exists(" in own._jdf.queryExecution().optimizedPlan().toString()
