"""Trajectory views over the driver's tables: ordered actions of runs, in the canonical columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.operators import scans
from tracewright.operators.phases import resolved

#: Which phase class an event type stands for.
EVENT_CLASSES = {"view": "loc", "error": "ctx", "click": "ctx", "purchase": "patch", "signup": "general"}
ORDER_CLASSES = {"F": "loc", "O": "ctx", "P": "patch"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def classed(column: str, classes: dict[str, str]):
    out = F.lit("general")
    for value, phase in classes.items():
        out = F.when(F.col(column) == value, phase).otherwise(out)
    return out


#: Actions of a task: its sorts keep about 1 KB of each at once.
TASK_ROWS = 100_000


def by_runs(actions: DataFrame, rows: int) -> DataFrame:
    """actions dealt by run over as many tasks as so many rows ask for. Adaptive execution goes by compressed bytes, of
    which the sorts of a task take forty times as much."""
    least = actions.sparkSession.sparkContext.defaultParallelism
    return actions.repartition(max(least, -(-rows // TASK_ROWS)), "traj")


def event_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of users: an action for each event in time order, two actions to a step, with its phase."""
    order = Window.partitionBy("traj").orderBy("ts", "event_id")
    events = table(spark, sf_dir, "events")
    e = events.select(F.col("user_id").alias("traj"), "event_id", "ts", "event_type", "value", (F.regexp_extract("props", "([0-9]+)", 1).cast("long") % 4).alias("k"))
    e = by_runs(e, events.count())
    e = e.withColumn("seq", F.row_number().over(order).cast("long") - 1).withColumn("step_idx", F.floor(F.col("seq") / 2).cast("long"))
    e = e.withColumn("label", F.concat_ws(":", "event_type", F.col("k").cast("string"))).withColumn("phase_class", classed("event_type", EVENT_CLASSES))
    return resolved(e)


def whole_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one run, in time order, two actions to a step, not resolved; numbered by ranges."""
    e = table(spark, sf_dir, "events").select(F.lit(0).cast("long").alias("traj"), "event_id", "ts", F.concat_ws(":", "event_type", (F.col("user_id") % 50).cast("string")).alias("label"), classed("event_type", EVENT_CLASSES).alias("phase_class"))
    return scans.numbered(e, ["ts", "event_id"]).withColumn("step_idx", F.floor(F.col("seq") / 2).cast("long"))


def order_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of customers: an action for each order in time order."""
    order = Window.partitionBy("traj").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("traj"), "o_orderkey", "o_orderdate", "o_totalprice", F.concat_ws(":", "o_orderstatus", "o_orderpriority").alias("label"), classed("o_orderstatus", ORDER_CLASSES).alias("phase_class"))
    o = o.withColumn("seq", F.row_number().over(order).cast("long") - 1).withColumn("step_idx", F.col("seq"))
    return resolved(o)


def event_status(actions: DataFrame) -> DataFrame:
    """traj, status: resolved, unresolved or unsubmitted, by a fixed rule on the user."""
    r = F.col("traj") % 3
    return actions.select("traj").distinct().withColumn("status", F.when(r == 0, "resolved").when(r == 1, "unresolved").otherwise("unsubmitted"))


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of hosts: a view of a path for each page, page_id being the order."""
    p = table(spark, sf_dir, "pages")
    rest = F.regexp_extract("url", "^[a-z]+://([^/]*)(/[^?#]*)?", 2)
    return p.select(F.regexp_extract("url", "^[a-z]+://([^/]*)", 1).alias("traj"), F.col("page_id").alias("seq"), F.regexp_replace(rest, "/+$", "").alias("path"))


def line_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges viewed in files: the order is the file, the line number and quantity the range."""
    li = table(spark, sf_dir, "lineitem")
    lo = F.col("l_linenumber").cast("long")
    return li.select((F.col("l_orderkey") % 64).alias("traj"), F.col("l_orderkey").cast("string").alias("path"), lo.alias("seq"), lo.alias("lo"), (lo + F.floor(F.col("l_quantity") / 10).cast("long")).alias("hi"))


def rich_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_actions() with all that a graph is built of: views of folders, files and line ranges, edits with their
    texts and outcomes, flags, thoughts and observations, each told by the event."""
    a = event_actions(spark, sf_dir)
    n, patch, view = F.col("event_id"), F.col("phase_class") == "patch", F.col("event_type") == "view"
    text = lambda c: c.cast("string")
    folder = F.concat(F.lit("/d"), text(n % 2))
    file = F.concat(folder, F.lit("/f"), text(n % 3))
    low = n % 7 * 10
    args = {
        "path": F.when(patch, file).when(view, F.when(n % 4 == 0, folder).otherwise(file)),
        "view_range": F.when(view & (n % 4 >= 2), F.concat(text(low), F.lit("-"), text(low + (n % 3 + 1) * 10))),
        "old_str": F.when(patch, text(n % 2)),
        "new_str": F.when(patch, text(F.floor(n / 2) % 2)),
        "edit_status": F.when(patch, F.when(F.col("k") == 1, "failure: not found").when(F.col("k") == 2, "failure: disk full").when(F.col("k") == 0, "success")),
    }
    entries = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in args.items()]), lambda e: e["value"].isNotNull())
    label = F.when(patch, "str_replace_editor: str_replace").when(view, "str_replace_editor: view").otherwise(F.col("label"))
    flags = F.when(F.col("event_type") == "click", F.create_map(F.lit("n"), text(n % 2))).otherwise(F.create_map().cast("map<string,string>"))
    observation = F.when(F.col("k") == 0, F.concat(F.lit("ok "), text(n % 10))).when(F.col("k") == 1, "Error: no")
    return a.select(
        "traj", "event_id", "seq", "step_idx", label.alias("label"), F.map_from_entries(entries).alias("args"), flags.alias("flags"), (n % 5 == 0).alias("has_cd"),
        "phase", F.concat(F.lit("'so' "), "event_type", F.lit("`x`")).alias("thought"), observation.alias("observation"), F.when(F.col("k") == 1, "failure").otherwise("neutral").alias("outcome"),
    )
