"""Registered queries over the driver's tables and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewright.functions import rules, text
from tracewright.operators import aggregates, commands, containment, graph, metrics, patches, patterns, phases, scans, traversal
from tracewright.sources import logs, views
from tracewright.streaming import sessions

QUERIES = {}
ORACLES = {}

#: The event runs, step by step, as the operators make them.
BASE = """WITH e AS (SELECT user_id AS traj, event_id, ts, event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 4 AS k,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events),
c AS (SELECT *, seq // 2 AS step_idx, event_type || ':' || CAST(k AS VARCHAR) AS label,
  CASE event_type WHEN 'view' THEN 'loc' WHEN 'error' THEN 'ctx' WHEN 'click' THEN 'ctx' WHEN 'purchase' THEN 'patch' ELSE 'general' END AS phase_class FROM e),
a AS (SELECT *, CASE WHEN phase_class = 'ctx' THEN CASE WHEN max(CASE WHEN phase_class = 'patch' THEN 1 ELSE 0 END) OVER
  (PARTITION BY traj ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 1 THEN 'validation' ELSE 'localization' END
  WHEN phase_class = 'loc' THEN 'localization' ELSE phase_class END AS phase FROM c),
st AS (SELECT DISTINCT traj, CASE traj % 3 WHEN 0 THEN 'resolved' WHEN 1 THEN 'unresolved' ELSE 'unsubmitted' END AS status FROM a),
kk AS (SELECT traj, seq, phase, CASE phase WHEN 'localization' THEN 'L' WHEN 'patch' THEN 'P' WHEN 'validation' THEN 'V' ELSE 'N' END AS abbr FROM a WHERE phase <> 'general'),
kn AS (SELECT *, CASE WHEN abbr = lag(abbr) OVER (PARTITION BY traj ORDER BY seq) THEN 0 ELSE 1 END AS new FROM kk),
kr AS (SELECT *, sum(new) OVER (PARTITION BY traj ORDER BY seq) - 1 AS run_no FROM kn),
r AS (SELECT traj, CAST(run_no AS BIGINT) AS run_no, min(phase) AS phase, min(abbr) AS abbr, count(*) AS len FROM kr GROUP BY traj, run_no),
fl AS (SELECT status, run_no AS t, abbr AS src, dst, count(*) AS n FROM (SELECT *, coalesce(lead(abbr) OVER (PARTITION BY traj ORDER BY run_no), 'T') AS dst FROM r) JOIN st USING (traj) WHERE run_no < 10 GROUP BY ALL),
f AS (SELECT *, min(seq) OVER (PARTITION BY traj, label) AS first_seq FROM a),
o AS (SELECT *, dense_rank() OVER (PARTITION BY traj ORDER BY first_seq) - 1 AS node_ord FROM f),
n AS (SELECT traj, node_ord, min(label) AS label, count(*) AS n_occ, min(step_idx) AS first_step, max(step_idx) AS last_step, arg_max(value, seq) AS last_value FROM o GROUP BY traj, node_ord),
x0 AS (SELECT *, lag(node_ord) OVER (PARTITION BY traj ORDER BY seq) AS src, lag(step_idx) OVER (PARTITION BY traj ORDER BY seq) AS prev_step FROM o),
x AS (SELECT traj, seq - 1 AS edge_ord, src, node_ord AS dst, step_idx, step_idx <> prev_step AS is_first_in_step FROM x0 WHERE src IS NOT NULL),
ao AS (SELECT * EXCLUDE (seq), row_number() OVER (PARTITION BY traj ORDER BY step_idx, node_ord, seq) - 1 AS seq FROM o),
ap AS (SELECT *, row_number() OVER (PARTITION BY traj ORDER BY seq) AS pn FROM ao WHERE phase = 'patch'),
p AS (SELECT *, k IN (1, 2) AS failed, CASE k WHEN 1 THEN CASE WHEN event_id % 2 = 0 THEN 'failure: not found' ELSE 'failure: unknown' END WHEN 2 THEN CASE event_id % 3 WHEN 0 THEN 'failure: no change' WHEN 1 THEN 'failure: invalid code' ELSE 'failure: disk full' END WHEN 3 THEN NULL ELSE 'success' END AS edit_status,
  'f' || CAST(event_id % 3 AS VARCHAR) AS path, event_id % 2 AS old, (event_id // 2) % 2 AS new FROM ap)
"""


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def flagship(spark, sf_dir):
    return QUERIES["q_phase_flow"](spark, sf_dir)


def runs_of(spark, sf_dir):
    return phases.phase_runs(views.event_actions(spark, sf_dir))


def flow_of(spark, sf_dir):
    a = views.event_actions(spark, sf_dir)
    return phases.phase_flow(phases.phase_runs(a), views.event_status(a))


def graph_of(spark, sf_dir):
    o = graph.node_occurrences(views.event_actions(spark, sf_dir))
    return o, graph.nodes(o), graph.edges(o)


def ordered_of(spark, sf_dir):
    """The actions as the metrics read them: by step, within it by node."""
    return graph.in_node_order(graph.node_occurrences(views.event_actions(spark, sf_dir)))


def patches_of(spark, sf_dir):
    a = ordered_of(spark, sf_dir).where("phase = 'patch'")
    rest = F.col("event_id") % 3
    missed = F.when(F.col("event_id") % 2 == 0, "failure: not found").otherwise("failure: unknown")
    other = F.when(rest == 0, "failure: no change").when(rest == 1, "failure: invalid code").otherwise("failure: disk full")
    status = F.when(F.col("k") == 1, missed).when(F.col("k") == 2, other).when(F.col("k") == 0, "success")
    return a.select("traj", "seq", "step_idx", "label", F.col("k").isin(1, 2).alias("failed"), status.alias("edit_status"), F.concat(F.lit("f"), (F.col("event_id") % 3).cast("string")).alias("path"), (F.col("event_id") % 2).alias("old"), (F.floor(F.col("event_id") / 2).cast("long") % 2).alias("new"))


def bare_pairs(spark, sf_dir):
    """The exec graph over event types alone: five nodes a run, so that all its cycles can be listed."""
    a = views.event_actions(spark, sf_dir).withColumn("label", F.col("event_type"))
    return graph.exec_pairs(graph.edges(graph.node_occurrences(a)))


@query("q_phase_flow", BASE + "SELECT * FROM fl")
def q_phase_flow(spark, sf_dir):
    return flow_of(spark, sf_dir)


@query("q_phases", BASE + "SELECT traj, seq, step_idx, label, phase FROM a")
def q_phases(spark, sf_dir):
    return views.event_actions(spark, sf_dir).select("traj", "seq", "step_idx", "label", "phase")


@query("q_phase_runs", BASE + "SELECT traj, run_no, phase, abbr, len FROM r")
def q_phase_runs(spark, sf_dir):
    return runs_of(spark, sf_dir)


@query("q_phase_strings", BASE + "SELECT traj, string_agg(abbr || '_' || CAST(len AS VARCHAR), ' ' ORDER BY run_no) AS runs, string_agg(repeat(abbr, CAST(len AS BIGINT)), '' ORDER BY run_no) AS letters FROM r GROUP BY traj")
def q_phase_strings(spark, sf_dir):
    return phases.phase_strings(runs_of(spark, sf_dir))


@query("q_flow_shares", BASE + ", s AS (SELECT *, n / sum(n) OVER (PARTITION BY status, t) AS share FROM fl) SELECT status, t, src, dst, n, round(share, 6) AS share FROM s WHERE share >= 0.01")
def q_flow_shares(spark, sf_dir):
    return phases.flow_shares(flow_of(spark, sf_dir)).withColumn("share", F.round("share", 6))


@query("q_flow_volumes", BASE + "SELECT status, t, node, CAST(sum(n) AS BIGINT) AS n FROM (SELECT status, t, src AS node, n FROM fl UNION ALL SELECT status, t + 1, dst, n FROM fl) GROUP BY ALL")
def q_flow_volumes(spark, sf_dir):
    return phases.flow_volumes(flow_of(spark, sf_dir))


@query("q_state_flow", BASE + """, s0 AS (SELECT traj, seq, phase FROM a WHERE phase IN ('localization', 'patch', 'validation')),
s1 AS (SELECT *, CASE WHEN phase = lag(phase) OVER (PARTITION BY traj ORDER BY seq) THEN 0 ELSE 1 END AS new FROM s0),
s2 AS (SELECT traj, phase, row_number() OVER (PARTITION BY traj ORDER BY seq) - 1 AS step, lead(phase) OVER (PARTITION BY traj ORDER BY seq) AS next FROM s1 WHERE new = 1),
s3 AS (SELECT step, phase AS state, next, count(*) AS n_next FROM s2 WHERE step < 8 GROUP BY ALL)
SELECT step, state, next, n_next, n FROM (SELECT *, CAST(sum(n_next) OVER (PARTITION BY step, state) AS BIGINT) AS n FROM s3) WHERE n_next >= 2""")
def q_state_flow(spark, sf_dir):
    return phases.state_flow(views.event_actions(spark, sf_dir), ["localization", "patch", "validation"], 8, 2)


@query("q_end_phases", BASE + """, g AS (SELECT traj, arg_min(phase, seq) AS first, arg_max(phase, seq) AS last FROM a WHERE phase <> 'general' GROUP BY traj)
SELECT which, phase, count(*) FILTER (status = 'resolved') AS resolved, count(*) FILTER (status = 'unresolved') AS unresolved
FROM (SELECT traj, 'first' AS which, first AS phase FROM g UNION ALL SELECT traj, 'last', last FROM g) JOIN st USING (traj) GROUP BY which, phase""")
def q_end_phases(spark, sf_dir):
    a = views.event_actions(spark, sf_dir)
    return phases.end_phases(a, views.event_status(a))


@query("q_transition_flags", BASE + """, t AS (SELECT traj, abbr || lead(abbr) OVER (PARTITION BY traj ORDER BY run_no) AS pair FROM r)
SELECT traj, CAST(max(CASE WHEN pair = 'LV' THEN 1 ELSE 0 END) AS BIGINT) AS LV, CAST(max(CASE WHEN pair = 'PL' THEN 1 ELSE 0 END) AS BIGINT) AS PL,
CAST(max(CASE WHEN pair = 'VL' THEN 1 ELSE 0 END) AS BIGINT) AS VL, CAST(max(CASE WHEN pair = 'VP' THEN 1 ELSE 0 END) AS BIGINT) AS VP FROM t GROUP BY traj""")
def q_transition_flags(spark, sf_dir):
    return phases.transition_flags(runs_of(spark, sf_dir))


@query("q_step_phases", BASE + """, s AS (SELECT traj, step_idx, coalesce(arg_min(phase_class, seq) FILTER (phase_class <> 'general'), 'general') AS pc FROM a GROUP BY traj, step_idx)
SELECT traj, step_idx, CASE WHEN pc = 'ctx' THEN CASE WHEN max(CASE WHEN pc = 'patch' THEN 1 ELSE 0 END) OVER (PARTITION BY traj ORDER BY step_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 1 THEN 'validation' ELSE 'localization' END WHEN pc = 'loc' THEN 'localization' ELSE pc END AS phase FROM s""")
def q_step_phases(spark, sf_dir):
    return phases.step_phases(views.event_actions(spark, sf_dir))


@query("q_nodes", BASE + "SELECT * FROM n")
def q_nodes(spark, sf_dir):
    return graph_of(spark, sf_dir)[1].drop("step_indices")


@query("q_edges", BASE + "SELECT * FROM x")
def q_edges(spark, sf_dir):
    return graph_of(spark, sf_dir)[2]


@query("q_exec_pairs", BASE + "SELECT DISTINCT traj, src, dst FROM x")
def q_exec_pairs(spark, sf_dir):
    return graph.exec_pairs(graph_of(spark, sf_dir)[2])


@query("q_graph_metrics", BASE + """, m AS (SELECT traj, count(*) AS node_count, max(last_step) + 1 AS step_count, CAST(sum(n_occ) AS BIGINT) AS occurrences, count(*) FILTER (n_occ > 1) AS revisited_nodes,
  arg_max(label, n_occ * 1000000 - node_ord) AS most_freq_node, max(n_occ) AS most_freq FROM n GROUP BY traj),
b AS (SELECT x.traj, count(*) AS edge_count, count(DISTINCT src * 100000 + dst) AS pair_count, avg(CASE WHEN src = dst OR d.first_step < s.first_step THEN 1.0 ELSE 0.0 END) AS backedge_fraction
  FROM x JOIN n s ON s.traj = x.traj AND s.node_ord = src JOIN n d ON d.traj = x.traj AND d.node_ord = dst GROUP BY x.traj)
SELECT m.*, coalesce(edge_count, 0) AS edge_count, coalesce(pair_count, 0) AS pair_count, round(coalesce(backedge_fraction, 0), 6) AS backedge_fraction,
  round(coalesce(pair_count, 0) / node_count, 6) AS avg_out_degree, occurrences - node_count AS deduplicated, round((occurrences - node_count) * 100.0 / occurrences, 6) AS dedup_pct FROM m LEFT JOIN b USING (traj)""")
def q_graph_metrics(spark, sf_dir):
    _, n, e = graph_of(spark, sf_dir)
    return graph.graph_metrics(n, e).withColumns({c: F.round(F.col(c).cast("double"), 6) for c in ("backedge_fraction", "avg_out_degree", "dedup_pct")})


@query("q_degrees", BASE + """SELECT traj, node_ord, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, count(DISTINCT t) AS exec_out, CAST(sum(d) AS BIGINT) AS degree
FROM (SELECT traj, src AS node_ord, 0 AS i, 1 AS o, dst AS t, 1 AS d FROM x UNION ALL SELECT traj, dst, 1, 0, NULL, CASE WHEN src = dst THEN 0 ELSE 1 END FROM x) GROUP BY traj, node_ord""")
def q_degrees(spark, sf_dir):
    return graph.degrees(graph_of(spark, sf_dir)[2])


@query("q_last_in_step", BASE + "SELECT traj, step_idx, max(seq) AS seq, arg_max(node_ord, seq) AS node_ord, arg_max(value, seq) AS value FROM o GROUP BY traj, step_idx")
def q_last_in_step(spark, sf_dir):
    return graph.last_in_step(graph_of(spark, sf_dir)[0]).select("traj", "step_idx", "seq", "node_ord", "value")


@query("q_collapsed_edges", BASE + """, d AS (SELECT DISTINCT traj, src, dst, step_idx FROM x), i AS (SELECT *, step_idx - row_number() OVER (PARTITION BY traj, src, dst ORDER BY step_idx) AS isl FROM d)
SELECT traj, src, dst, min(step_idx) AS from_step, max(step_idx) AS to_step, count(*) AS n FROM i GROUP BY traj, src, dst, isl""")
def q_collapsed_edges(spark, sf_dir):
    return graph.collapsed_edges(graph_of(spark, sf_dir)[2])


@query("q_busy_edges", BASE + """, b AS (SELECT *, count(*) OVER (PARTITION BY traj, src) AS c FROM x WHERE NOT is_first_in_step)
SELECT traj, src, dst, count(*) AS n, min(step_idx) AS first_step, max(step_idx) AS last_step FROM b WHERE c >= 3 GROUP BY traj, src, dst""")
def q_busy_edges(spark, sf_dir):
    return graph.busy_edges(graph_of(spark, sf_dir)[2], 3)


@query("q_inner_edges", BASE + """, w AS (SELECT DISTINCT l.traj, l.node_ord AS src, m.node_ord AS dst FROM o l JOIN o m ON l.traj = m.traj AND l.step_idx = m.step_idx)
SELECT x.*, w.src IS NOT NULL AND NOT is_first_in_step AS intra_step FROM x LEFT JOIN w ON x.traj = w.traj AND x.src = w.src AND x.dst = w.dst""")
def q_inner_edges(spark, sf_dir):
    o, _, e = graph_of(spark, sf_dir)
    return graph.inner_edges(e, o)


@query("q_localization", BASE + """, z AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY traj) AS c, lag(phase) OVER w AS b FROM ao WINDOW w AS (PARTITION BY traj ORDER BY seq)),
y AS (SELECT traj, count(*) FILTER (phase = 'localization') AS l, count(*) AS c, count(*) FILTER (phase = 'localization' AND (b IS NULL OR b <> 'localization')) AS loc_num_clusters,
 count(*) FILTER (phase = 'localization' AND i < c // 3) AS e1, count(*) FILTER (phase = 'localization' AND i >= c // 3 AND i < 2 * c // 3) AS e2, count(*) FILTER (phase = 'localization' AND i >= 2 * c // 3) AS e3 FROM z GROUP BY traj)
SELECT traj, round_even(l / c, 2) AS loc_focus_ratio, loc_num_clusters, CASE WHEN l = 0 THEN 'none' WHEN greatest(e1, e2, e3) / l < 0.5 THEN 'mixed' WHEN e1 = greatest(e1, e2, e3) THEN 'early' WHEN e2 = greatest(e1, e2, e3) THEN 'middle' ELSE 'late' END AS loc_dominant_zone FROM y""")
def q_localization(spark, sf_dir):
    return aggregates.localization_metrics(ordered_of(spark, sf_dir))


@query("q_patch_metrics", BASE + """, kinds AS (SELECT traj, substr(edit_status, 10) AS kind, count(*) AS n FROM p WHERE failed GROUP BY ALL),
others AS (SELECT traj, string_agg(kind || ':' || CAST(n AS VARCHAR), ',' ORDER BY kind) AS fail_others FROM kinds WHERE kind NOT IN ('not found', 'no change', 'multiple occurrences', 'unknown', 'invalid code') GROUP BY traj)
SELECT p.traj, count(*) AS patch_total, count(*) FILTER (NOT failed) AS patch_success, count(*) FILTER (edit_status = 'failure: not found') AS fail_not_found, count(*) FILTER (edit_status = 'failure: no change') AS fail_no_change,
 count(*) FILTER (edit_status = 'failure: multiple occurrences') AS fail_multiple_occurrences, count(*) FILTER (edit_status = 'failure: unknown') AS fail_unknown, count(*) FILTER (edit_status = 'failure: invalid code') AS fail_invalid_code,
 coalesce(any_value(fail_others), '') AS fail_others FROM p LEFT JOIN others ON others.traj = p.traj GROUP BY p.traj""")
def q_patch_metrics(spark, sf_dir):
    return patches.patch_metrics(patches_of(spark, sf_dir))


@query("q_fail_streaks", BASE + """, i AS (SELECT *, row_number() OVER (PARTITION BY traj ORDER BY seq) - row_number() OVER (PARTITION BY traj, failed ORDER BY seq) AS isl FROM p),
s AS (SELECT traj, isl, count(*) AS c FROM i WHERE failed GROUP BY traj, isl), t AS (SELECT traj, count(*) AS c, max(c) AS m, round_even(avg(c), 2) AS v FROM s GROUP BY traj)
SELECT traj, coalesce(c, 0) AS fail_streak_count, coalesce(m, 0) AS fail_streak_max, coalesce(v, 0.0) AS fail_streak_avg FROM (SELECT DISTINCT traj FROM p) LEFT JOIN t USING (traj)""")
def q_fail_streaks(spark, sf_dir):
    return patches.streaks(patches_of(spark, sf_dir))


@query("q_reversals", BASE + """, v AS (SELECT *, lag(path) OVER w AS lp, lag(old) OVER w AS lo, lag(new) OVER w AS ln, row_number() OVER (PARTITION BY traj, path, old, new ORDER BY seq) AS c FROM p WINDOW w AS (PARTITION BY traj ORDER BY seq)),
ab AS (SELECT traj, bool_or(none) AS abandonment FROM (SELECT traj, path, bool_and(failed) AS none FROM p GROUP BY traj, path) GROUP BY traj)
SELECT traj, bool_or(coalesce(lp = path AND lo = new AND ln = old, false)) AS flip_flop, bool_or(c > 1 AND failed) AS repeat_failed_edit, any_value(abandonment) AS abandonment FROM v JOIN ab USING (traj) GROUP BY traj""")
def q_reversals(spark, sf_dir):
    return patches.reversals(patches_of(spark, sf_dir))


SPANS = BASE + """, en AS (SELECT traj, seq, step_idx, lag(failed) OVER w AS pf, lag(step_idx) OVER w AS ps, failed FROM p WINDOW w AS (PARTITION BY traj ORDER BY seq)),
sp AS (SELECT traj, step_idx, arg_max(phase, seq) AS phase FROM ao GROUP BY traj, step_idx),
ii AS (SELECT en.traj, en.seq, pf AND NOT failed AS recovers, g.i AS step_idx, coalesce(sp.phase, 'unknown') AS phase FROM en, LATERAL (SELECT unnest(range(ps + 1, en.step_idx)) AS i) g LEFT JOIN sp ON sp.traj = en.traj AND sp.step_idx = g.i),
jj AS (SELECT *, lag(phase) OVER (PARTITION BY traj, seq ORDER BY step_idx) AS b FROM ii WHERE phase <> 'patch'),
hh AS (SELECT traj, seq, recovers, string_agg(phase, '>' ORDER BY step_idx) AS pattern FROM jj WHERE b IS NULL OR b <> phase GROUP BY traj, seq, recovers)
"""


@query("q_recovery_patterns", SPANS + """, cc AS (SELECT traj, pattern, count(*) AS n, min(seq) AS f FROM hh WHERE recovers GROUP BY traj, pattern), rr AS (SELECT *, row_number() OVER (PARTITION BY traj ORDER BY n DESC, f) AS q FROM cc)
SELECT traj, pattern, n FROM rr WHERE q = 1""")
def q_recovery_patterns(spark, sf_dir):
    return patches.recovery_patterns(ordered_of(spark, sf_dir), patches_of(spark, sf_dir))


@query("q_reasoning_spans", SPANS + "SELECT traj, pattern, count(*) AS n FROM hh GROUP BY traj, pattern")
def q_reasoning_spans(spark, sf_dir):
    return patches.reasoning_spans(ordered_of(spark, sf_dir), patches_of(spark, sf_dir))


@query("q_overlap_regions", BASE + """, fg AS (SELECT traj, bool_or(phase = 'validation') AS validates, bool_or(event_type = 'error' AND k = 3) AS errs, bool_or(phase = 'patch' AND k = 1) AS retries FROM a GROUP BY traj),
g AS (SELECT validates, errs, retries, count(*) AS n FROM fg GROUP BY ALL)
SELECT concat_ws('+', CASE WHEN validates THEN 'validates' END, CASE WHEN errs THEN 'errs' END, CASE WHEN retries THEN 'retries' END) AS region, n, round_even(n * 100.0 / (SELECT sum(n) FROM g), 2) AS pct FROM g WHERE validates OR errs OR retries""")
def q_overlap_regions(spark, sf_dir):
    a = views.event_actions(spark, sf_dir)
    flags = a.groupBy("traj").agg(F.bool_or(F.col("phase") == "validation").alias("validates"), F.bool_or((F.col("event_type") == "error") & (F.col("k") == 3)).alias("errs"), F.bool_or((F.col("phase") == "patch") & (F.col("k") == 1)).alias("retries"))
    return patches.overlap_regions(flags, ["validates", "errs", "retries"]).withColumn("pct", F.col("pct").cast("double"))


@query("q_spread", BASE + """, m AS (SELECT traj, count(*) AS nodes, CAST(sum(n_occ) AS BIGINT) AS occurrences FROM n GROUP BY traj), l AS (SELECT status, 'nodes' AS metric, CAST(nodes AS DOUBLE) AS v FROM m JOIN st USING (traj) UNION ALL SELECT status, 'occurrences', occurrences FROM m JOIN st USING (traj))
SELECT status, metric, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr, round(avg(v), 6) AS mean, round(CASE WHEN count(*) = 1 THEN 0 ELSE stddev_samp(v) END, 6) AS std, count(*) AS n FROM l GROUP BY status, metric""")
def q_spread(spark, sf_dir):
    o, n, _ = graph_of(spark, sf_dir)
    m = n.groupBy("traj").agg(F.count("*").alias("nodes"), F.sum("n_occ").alias("occurrences")).join(views.event_status(o), "traj")
    return aggregates.spread(m, ["nodes", "occurrences"], ["status"]).withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


@query("q_listing", BASE + """, l AS (SELECT traj, max(step_idx) + 1 AS step_count, arg_min(label, seq) AS title FROM a GROUP BY traj) SELECT status, count(*) AS runs, min(step_count) AS least, max(step_count) AS most, round(avg(step_count), 6) AS mean, min(title) AS title FROM l JOIN st USING (traj) GROUP BY status""")
def q_listing(spark, sf_dir):
    a = views.event_actions(spark, sf_dir)
    rows = a.groupBy("traj").agg((F.max("step_idx") + 1).alias("step_count"), F.min_by("label", "seq").alias("title")).join(views.event_status(a), "traj")
    return rows.groupBy("status").agg(F.count("*").alias("runs"), F.min("step_count").alias("least"), F.max("step_count").alias("most"), F.round(F.avg("step_count"), 6).alias("mean"), F.min("title").alias("title"))


@query("q_order_runs", """WITH c AS (SELECT o_custkey AS traj, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS seq, CASE o_orderstatus WHEN 'F' THEN 'loc' WHEN 'O' THEN 'ctx' WHEN 'P' THEN 'patch' ELSE 'general' END AS pc FROM orders),
a AS (SELECT *, CASE WHEN pc = 'ctx' THEN CASE WHEN max(CASE WHEN pc = 'patch' THEN 1 ELSE 0 END) OVER (PARTITION BY traj ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 1 THEN 'validation' ELSE 'localization' END WHEN pc = 'loc' THEN 'localization' ELSE pc END AS phase FROM c)
SELECT phase, count(*) AS n, count(DISTINCT traj) AS runs FROM a GROUP BY phase""")
def q_order_runs(spark, sf_dir):
    return views.order_actions(spark, sf_dir).groupBy("phase").agg(F.count("*").alias("n"), F.countDistinct("traj").alias("runs"))


@query("q_conversation_pairs", """WITH w AS (SELECT conv_id AS traj, turn, role, length(text) AS chars, lead(role) OVER v AS next_role, length(lead(text) OVER v) AS next_chars FROM conversations WINDOW v AS (PARTITION BY conv_id ORDER BY turn)) SELECT * FROM w""")
def q_conversation_pairs(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = views.table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("traj"), "turn", "role", F.length("text").cast("long").alias("chars"), F.lead("role").over(w).alias("next_role"), F.length(F.lead("text").over(w)).cast("long").alias("next_chars"))


@query("q_nested_ranges", """WITH r AS (SELECT l_orderkey AS path, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) AS node, CAST(l_linenumber AS BIGINT) AS lo, CAST(l_linenumber AS BIGINT) + CAST(floor(l_quantity / 10) AS BIGINT) AS hi FROM lineitem),
i AS (SELECT o.path, o.node AS o_node, o.lo AS o_lo, o.hi AS o_hi, i.node AS i_node, i.lo AS i_lo, i.hi AS i_hi FROM r o JOIN r i ON o.path = i.path AND o.node <> i.node AND o.lo <= i.lo AND i.hi <= o.hi)
SELECT CAST(path AS VARCHAR) AS path, o_lo, o_hi, i_lo, i_hi FROM i WHERE NOT EXISTS (SELECT 1 FROM r m WHERE m.path = i.path AND m.node <> o_node AND m.node <> i_node AND o_lo <= m.lo AND m.hi <= o_hi AND m.lo <= i_lo AND i_hi <= m.hi)""")
def q_nested_ranges(spark, sf_dir):
    # Each line is a view of its own, so that equal ranges stand twice or more often.
    r = views.line_ranges(spark, sf_dir).withColumn("node", F.row_number().over(Window.partitionBy("path").orderBy("lo", "hi")))
    return containment.nested_ranges(r).select("path", "o_lo", "o_hi", "i_lo", "i_hi")


@query("q_scrolls", """WITH r AS (SELECT l_orderkey % 64 AS traj, l_orderkey AS path, CAST(l_linenumber AS BIGINT) AS lo, CAST(l_linenumber AS BIGINT) + CAST(floor(l_quantity / 10) AS BIGINT) AS hi FROM lineitem),
s AS (SELECT traj, coalesce(lo <= lag(hi) OVER (PARTITION BY traj, path ORDER BY lo, hi), false) AS s FROM r) SELECT traj, bool_or(s) AS scroll FROM s GROUP BY traj""")
def q_scrolls(spark, sf_dir):
    return containment.scrolls(views.line_ranges(spark, sf_dir))


PATHS = """WITH u AS (SELECT page_id AS seq, regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS traj, regexp_replace(regexp_extract(url, '^[a-z]+://([^/]*)(/[^?#]*)?', 2), '/+$', '') AS path FROM pages),
d AS (SELECT DISTINCT traj, path, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM u WHERE path <> ''),
px AS (SELECT traj, path, g.i AS depth, '/' || array_to_string(parts[1:g.i], '/') AS prefix FROM d, LATERAL (SELECT unnest(range(1, len(parts))) AS i) g)
"""


@query("q_closest_parents", PATHS + """, t AS (SELECT traj, path, parts FROM d UNION SELECT traj, prefix, list_filter(string_split(prefix, '/'), lambda x: x <> '') FROM px WHERE length(prefix) % 2 = 0),
ax AS (SELECT traj, path, g.i AS depth, '/' || array_to_string(parts[1:g.i], '/') AS prefix FROM t, LATERAL (SELECT unnest(range(1, len(parts))) AS i) g)
SELECT ax.traj, ax.path AS child, arg_max(ax.prefix, ax.depth) AS parent FROM ax JOIN t ON t.traj = ax.traj AND t.path = ax.prefix GROUP BY ax.traj, ax.path""")
def q_closest_parents(spark, sf_dir):
    """Pages, and those of their directories whose path has an even length: some closest ones are further up."""
    p = views.page_paths(spark, sf_dir)
    some = p.select("traj", F.explode(containment.prefixes("path")).alias("p")).select("traj", F.col("p.prefix").alias("path")).where(F.length("path") % 2 == 0)
    return containment.closest_parents(p.select("traj", "path").unionByName(some))


@query("q_footprint", PATHS + """, s AS (SELECT traj, path, seq AS step_idx, max(seq % 3) AS r FROM u WHERE path <> '' GROUP BY ALL), g AS (SELECT traj, path, min(step_idx) AS first_step, max(step_idx) AS last_step, count(*) FILTER (r = 0) AS seen, count(*) FILTER (r = 1) AS views, count(*) FILTER (r = 2) AS edits FROM s GROUP BY traj, path)
SELECT *, row_number() OVER (PARTITION BY traj ORDER BY edits DESC, views DESC, first_step, path) AS rank FROM g""")
def q_footprint(spark, sf_dir):
    kind = F.when(F.col("seq") % 3 == 2, "edit").when(F.col("seq") % 3 == 1, "view").otherwise("seen")
    return containment.footprint(views.page_paths(spark, sf_dir).where("path <> ''").withColumn("step_idx", F.col("seq")).withColumn("activity", kind))


@query("q_directory_rollup", PATHS + """, s AS (SELECT traj, path, count(*) FILTER (seq % 3 = 1) AS views, count(*) FILTER (seq % 3 = 2) AS edits FROM u WHERE path <> '' GROUP BY ALL)
SELECT px.traj, prefix, count(*) AS files, CAST(sum(views) AS BIGINT) AS views, CAST(sum(edits) AS BIGINT) AS edits FROM px JOIN s ON s.traj = px.traj AND s.path = px.path GROUP BY px.traj, prefix""")
def q_directory_rollup(spark, sf_dir):
    kind = F.when(F.col("seq") % 3 == 2, "edit").when(F.col("seq") % 3 == 1, "view").otherwise("seen")
    return containment.directory_rollup(containment.footprint(views.page_paths(spark, sf_dir).where("path <> ''").withColumn("step_idx", F.col("seq")).withColumn("activity", kind)))


BARE = """WITH RECURSIVE e AS (SELECT user_id AS traj, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events),
f AS (SELECT *, min(seq) OVER (PARTITION BY traj, event_type) AS fs FROM e), o AS (SELECT *, dense_rank() OVER (PARTITION BY traj ORDER BY fs) - 1 AS node FROM f),
x AS (SELECT DISTINCT traj, src, dst FROM (SELECT traj, lag(node) OVER (PARTITION BY traj ORDER BY seq) AS src, node AS dst FROM o) WHERE src IS NOT NULL)"""


@query("q_cycles", BARE + """, w AS (SELECT traj, src AS start, src AS cur, [src] AS seen FROM (SELECT DISTINCT traj, src FROM x)
 UNION ALL SELECT w.traj, start, x.dst, list_append(seen, x.dst) FROM w JOIN x ON x.traj = w.traj AND x.src = w.cur WHERE x.dst > start AND NOT list_contains(seen, x.dst)),
c AS (SELECT w.traj, len(seen) AS n FROM w JOIN x ON x.traj = w.traj AND x.src = w.cur AND x.dst = w.start)
SELECT t.traj, count(n) AS loop_count, coalesce(min(n), 0) AS min_loop, coalesce(max(n), 0) AS max_loop, round(coalesce(avg(n), 0), 6) AS avg_loop, false AS truncated FROM (SELECT DISTINCT traj FROM x) t LEFT JOIN c ON c.traj = t.traj GROUP BY t.traj""")
def q_cycles(spark, sf_dir):
    return traversal.cycle_metrics(bare_pairs(spark, sf_dir)).withColumn("avg_loop", F.round("avg_loop", 6))


@query("q_longest_path", BARE + """, w AS (SELECT traj, n AS cur, [n] AS seen FROM (SELECT DISTINCT traj, src AS n FROM x UNION SELECT traj, dst FROM x)
 UNION ALL SELECT w.traj, x.dst, list_append(seen, x.dst) FROM w JOIN x ON x.traj = w.traj AND x.src = w.cur WHERE NOT list_contains(seen, x.dst))
SELECT traj, max(len(seen)) - 1 AS longest_path, false AS truncated FROM w GROUP BY traj""")
def q_longest_path(spark, sf_dir):
    return traversal.longest_path(bare_pairs(spark, sf_dir))


@query("q_loop_components", BARE + """, w AS (SELECT traj, src, dst FROM x UNION SELECT w.traj, w.src, x.dst FROM w JOIN x ON x.traj = w.traj AND x.src = w.dst),
m AS (SELECT a.traj, a.src, min(a.dst) AS comp FROM w a JOIN w b ON a.traj = b.traj AND a.src = b.dst AND a.dst = b.src GROUP BY a.traj, a.src)
SELECT t.traj, count(DISTINCT comp) AS loop_components, count(comp) AS loop_nodes FROM (SELECT DISTINCT traj FROM x) t LEFT JOIN m ON m.traj = t.traj GROUP BY t.traj""")
def q_loop_components(spark, sf_dir):
    return traversal.loop_components(bare_pairs(spark, sf_dir))


@query("q_shortest_path", BARE + """, z AS (SELECT traj, max(node) AS last FROM o GROUP BY traj), w AS (SELECT traj, 0 AS far, CAST(0 AS BIGINT) AS node FROM z UNION SELECT w.traj, far + 1, x.dst FROM w JOIN x ON x.traj = w.traj AND x.src = w.node WHERE far < 6)
SELECT z.traj, CAST(min(far) AS BIGINT) AS shortest FROM z LEFT JOIN w ON w.traj = z.traj AND w.node = z.last GROUP BY z.traj""")
def q_shortest_path(spark, sf_dir):
    a = views.event_actions(spark, sf_dir).withColumn("label", F.col("event_type"))
    ends = graph.node_occurrences(a).groupBy("traj").agg(F.lit(0).cast("long").alias("start_node"), F.max("node_ord").alias("end_node"))
    return traversal.shortest_paths(bare_pairs(spark, sf_dir), ends)


def grouped_sequences(spark, sf_dir):
    a = views.event_actions(spark, sf_dir)
    return patterns.sequences(phases.phase_runs(a), views.event_status(a).withColumnRenamed("status", "grp"))


SEQS = BASE + """, q AS (SELECT status AS grp, traj, string_agg(abbr, '' ORDER BY run_no) AS letters, list(len ORDER BY run_no) AS lens FROM r JOIN st USING (traj) GROUP BY status, traj), total AS (SELECT grp, count(*) AS total FROM q GROUP BY grp),
sl AS (SELECT DISTINCT grp, traj, substr(letters, i, n) AS pattern FROM (SELECT *, unnest(range(1, length(letters) - i + 2)) AS n FROM (SELECT *, unnest(range(1, length(letters) + 1)) AS i FROM q))),
cp AS (SELECT grp, pattern, count(*) AS n, count(*) / any_value(total) AS support FROM sl JOIN total USING (grp) GROUP BY grp, pattern HAVING count(*) / any_value(total) >= 0.3)
"""


@query("q_contiguous_patterns", SEQS + "SELECT grp, pattern, n, round(support, 6) AS support FROM cp")
def q_contiguous_patterns(spark, sf_dir):
    return patterns.contiguous(grouped_sequences(spark, sf_dir)).withColumn("pattern", F.array_join("pattern", "")).withColumn("support", F.round("support", 6))


@query("q_longest_patterns")
def q_longest_patterns(spark, sf_dir):
    seqs = grouped_sequences(spark, sf_dir)
    return patterns.with_text(patterns.longest_patterns(seqs, patterns.contiguous(seqs)))


@query("q_longest_supports", SEQS + """, lp AS (SELECT grp, pattern FROM (SELECT *, max(length(pattern)) OVER (PARTITION BY grp) AS m FROM cp) WHERE length(pattern) = m),
pos AS (SELECT grp, pattern, k, string_agg('[^' || substr(pattern, j, 1) || ']*' || substr(pattern, j, 1), '' ORDER BY j) AS re FROM (SELECT *, unnest(range(1, k + 1)) AS j FROM (SELECT *, unnest(range(1, length(pattern) + 1)) AS k FROM lp)) GROUP BY grp, pattern, k),
ma AS (SELECT q.grp, q.traj, pattern, k, lens, length(regexp_extract(letters, '^' || re)) AS hit FROM pos JOIN q USING (grp)),
pc AS (SELECT grp, pattern, round_even(count(*) FILTER (k = length(pattern) AND hit > 0) * 100.0 / any_value(total), 0) AS pct FROM ma JOIN total USING (grp) GROUP BY grp, pattern),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY pct DESC, pattern DESC) AS q FROM pc) WHERE q = 1),
full_ AS (SELECT grp, pattern, traj FROM ma WHERE k = length(pattern) AND hit > 0)
SELECT best.grp, best.pattern, CAST(pct AS DOUBLE) AS pct, (SELECT string_agg(CAST(low AS VARCHAR), ' ' ORDER BY k) FROM (SELECT k, min(lens[hit]) AS low FROM ma JOIN full_ USING (grp, pattern, traj) WHERE ma.grp = best.grp AND ma.pattern = best.pattern GROUP BY k)) AS lower FROM best""")
def q_longest_supports(spark, sf_dir):
    seqs = grouped_sequences(spark, sf_dir)
    found = patterns.longest_patterns(seqs, patterns.contiguous(seqs))
    return found.select("grp", F.array_join("pattern", "").alias("pattern"), F.col("pct").cast("double").alias("pct"), F.array_join(F.transform("lower", lambda x: x.cast("string")), " ").alias("lower"))


@query("q_start_end", BASE + """, ins AS (SELECT DISTINCT traj, dst AS node_ord FROM x), outs AS (SELECT DISTINCT traj, src AS node_ord FROM x),
kn2 AS (SELECT n.traj, n.node_ord, first_step, last_step, ins.node_ord IS NOT NULL AS has_in, outs.node_ord IS NOT NULL AS has_out, CAST(n.node_ord AS VARCHAR) || ':' || label AS key
 FROM n LEFT JOIN ins ON ins.traj = n.traj AND ins.node_ord = n.node_ord LEFT JOIN outs ON outs.traj = n.traj AND outs.node_ord = n.node_ord),
ranked AS (SELECT traj, node_ord, row_number() OVER (PARTITION BY traj ORDER BY first_step, has_in, key) AS s, row_number() OVER (PARTITION BY traj ORDER BY last_step DESC, has_out, key DESC) AS e FROM kn2)
SELECT traj, max(CASE WHEN s = 1 THEN node_ord END) AS start_node, max(CASE WHEN e = 1 THEN node_ord END) AS end_node FROM ranked GROUP BY traj""")
def q_start_end(spark, sf_dir):
    _, n, e = graph_of(spark, sf_dir)
    return graph.start_end(n, graph.exec_pairs(e))


@query("q_thought_lengths", r"""WITH t AS (SELECT doc_id, translate(text, 'xqz', '`"''') AS text FROM documents)
SELECT doc_id, coalesce(length(text), 0) AS raw, coalesce(length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)```.*?```', '', 'g'), '`[^`]*`', '', 'g'), '"[^"]*"', '', 'g'), '''[^'']*''', '', 'g')), 0) AS clean FROM t""")
def q_thought_lengths(spark, sf_dir):
    """The letters x, q and z stand in for marks, so that spans are many and cross lines."""
    d = views.table(spark, sf_dir, "documents").withColumn("text", F.translate("text", "xqz", "`\"'"))
    return d.select("doc_id", text.thought_length_raw(F.col("text")).alias("raw"), text.thought_length_clean(F.col("text")).alias("clean"))


@query("q_outcomes", r"""WITH t AS (SELECT event_id, event_type = 'view' AS seen, lower(CASE CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 5 WHEN 0 THEN 'The file has been edited. ' || props WHEN 1 THEN 'TypeError: ' || props WHEN 2 THEN props
 WHEN 3 THEN 'The path ' || event_type || ' does not exist. Please provide a valid path.' ELSE '' END) AS low FROM events)
SELECT event_id, CASE WHEN low = '' THEN 'neutral' WHEN seen THEN CASE WHEN regexp_matches(low, '^the path .+ does not exist\. please provide a valid path\.?$') THEN 'failure' ELSE 'neutral' END
 WHEN regexp_matches(low, 'traceback \(most recent call last\)|error:|exception:|failed|failure|assertion|syntaxerror|nameerror|typeerror') THEN 'failure'
 WHEN regexp_matches(low, 'success|passed|has been edited|created successfully') THEN 'success' ELSE 'neutral' END AS outcome FROM t""")
def q_outcomes(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("long") % 5)
    said = F.when(F.col("k") == 0, F.concat(F.lit("The file has been edited. "), "props")).when(F.col("k") == 1, F.concat(F.lit("TypeError: "), "props")).when(F.col("k") == 2, F.col("props"))
    said = said.when(F.col("k") == 3, F.concat(F.lit("The path "), "event_type", F.lit(" does not exist. Please provide a valid path."))).otherwise("")
    seen = F.col("event_type") == "view"
    return e.select("event_id", text.observation_outcome(F.when(seen, text.EDITOR), F.when(seen, "view"), said).alias("outcome"))


def with_directories(paths):
    """The paths and all their ancestors, so that there is a tree to walk."""
    up = paths.select("traj", F.explode(containment.prefixes("path")).alias("p")).select("traj", F.col("p.prefix").alias("path"))
    return paths.select("traj", "path").unionByName(up).distinct()


def page_codes(spark, sf_dir):
    hier = containment.closest_parents(with_directories(views.page_paths(spark, sf_dir))).select("traj", "parent", "child")
    return hier, containment.hierarchy_codes(hier)


TREE = PATHS + """, t AS (SELECT traj, path FROM d UNION SELECT traj, prefix FROM px),
hp AS (SELECT traj, path AS child, regexp_replace(path, '/[^/]*$', '') AS parent FROM t WHERE regexp_replace(path, '/[^/]*$', '') <> '')
"""


@query("q_tree_parents", TREE + "SELECT traj, child, parent FROM hp")
def q_tree_parents(spark, sf_dir):
    return containment.closest_parents(with_directories(views.page_paths(spark, sf_dir)))


@query("q_view_depths", TREE + """, vis AS (SELECT traj, path AS node FROM u WHERE path <> ''), lv AS (SELECT traj, node, length(node) - length(replace(node, '/', '')) AS l FROM vis),
lf AS (SELECT traj, max(l) AS max_view_depth, round_even(avg(l), 2) AS avg_view_depth FROM lv WHERE NOT EXISTS (SELECT 1 FROM hp WHERE hp.traj = lv.traj AND hp.parent = lv.node) GROUP BY traj),
sp AS (SELECT traj, max(c) AS max_view_span, round_even(avg(c), 2) AS avg_view_span FROM (SELECT traj, l, count(*) AS c FROM lv GROUP BY traj, l) GROUP BY traj)
SELECT sp.traj, coalesce(max_view_depth, 0) AS max_view_depth, coalesce(avg_view_depth, 0) AS avg_view_depth, max_view_span, avg_view_span FROM sp LEFT JOIN lf ON sp.traj = lf.traj""")
def q_view_depths(spark, sf_dir):
    hier, codes = page_codes(spark, sf_dir)
    visits = views.page_paths(spark, sf_dir).where("path <> ''").select("traj", F.col("path").alias("node"))
    return containment.view_depths(codes, hier, visits)


@query("q_stream_listing", "SELECT CAST(user_id AS VARCHAR) AS session, count(*) AS records, CAST(epoch_us(max(ts)) AS BIGINT) AS last_us FROM events GROUP BY user_id")
def q_stream_listing(spark, sf_dir):
    """The listing as the stream leaves it, once all events are read."""
    now = spark.read.parquet(f"{sf_dir}/events.parquet")
    reader = spark.readStream.schema(now.schema)
    one_file = now.inputFiles()[0].endswith("/events.parquet")
    stream = reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir) if one_file else reader.parquet(f"{sf_dir}/events.parquet")
    rows = stream.select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("seq"), "ts", F.col("event_type").alias("label"))
    out = sessions.drained(sessions.running_listing(rows))
    return out.select("session", "records", F.unix_micros(F.col("last_ts").cast("timestamp")).alias("last_us"))


@query("q_localization_repeats", BASE + ", v AS (SELECT traj, node_ord, nullif(count(*) FILTER (phase = 'localization'), 0) AS c FROM o GROUP BY traj, node_ord) SELECT traj, coalesce(round_even(avg(c), 2), 0) AS loc_avg_node_freq, coalesce(bool_or(c > 1), false) AS repeated_view FROM v GROUP BY traj")
def q_localization_repeats(spark, sf_dir):
    return graph.localization_repeats(graph_of(spark, sf_dir)[0])


@query("q_continuations", BASE + """, th AS (SELECT traj, step_idx, arg_min(event_type, seq) AS thought, arg_min(node_ord, seq) AS dst FROM o GROUP BY traj, step_idx),
pv AS (SELECT *, lag(dst) OVER w AS src, lag(thought) OVER w AS b FROM th WINDOW w AS (PARTITION BY traj ORDER BY step_idx))
SELECT traj, step_idx, src, dst FROM pv WHERE contains(thought, b) AND EXISTS (SELECT 1 FROM x WHERE x.traj = pv.traj AND x.src = pv.src AND x.dst = pv.dst)""")
def q_continuations(spark, sf_dir):
    o, _, e = graph_of(spark, sf_dir)
    return graph.continuations(o, e, o.groupBy("traj", "step_idx").agg(F.min_by("event_type", "seq").alias("thought")))


#: Canonical actions of the event runs, and the graph over nodes of equal label, args and flags.
RICH = BASE + """, ri AS (SELECT *, phase_class = 'patch' AS ed, event_type = 'view' AS vw, '/d' || CAST(event_id % 2 AS VARCHAR) AS folder, '/d' || CAST(event_id % 2 AS VARCHAR) || '/f' || CAST(event_id % 3 AS VARCHAR) AS file, event_id % 7 * 10 AS low FROM a),
rj AS (SELECT traj, event_id, seq, step_idx, phase, event_id % 5 = 0 AS has_cd, CASE WHEN ed THEN 'str_replace_editor: str_replace' WHEN vw THEN 'str_replace_editor: view' ELSE label END AS label,
 CASE WHEN ed THEN file WHEN vw THEN CASE WHEN event_id % 4 = 0 THEN folder ELSE file END END AS path, CASE WHEN vw AND event_id % 4 >= 2 THEN low END AS lo, CASE WHEN vw AND event_id % 4 >= 2 THEN low + (event_id % 3 + 1) * 10 END AS hi,
 CASE WHEN ed THEN event_id % 2 END AS old, CASE WHEN ed THEN event_id // 2 % 2 END AS new, CASE WHEN ed THEN CASE k WHEN 1 THEN 'failure: not found' WHEN 2 THEN 'failure: disk full' WHEN 0 THEN 'success' END END AS status,
 CASE WHEN event_type = 'click' THEN event_id % 2 END AS flag, '''so'' ' || event_type || '`x`' AS thought, CASE k WHEN 0 THEN 'ok ' || CAST(event_id % 10 AS VARCHAR) WHEN 1 THEN 'Error: no' ELSE '' END AS obs FROM ri),
rk AS (SELECT *, concat_ws('|', label, coalesce(path, '-'), coalesce(CAST(lo AS VARCHAR), '-'), coalesce(CAST(hi AS VARCHAR), '-'), coalesce(CAST(old AS VARCHAR), '-'), coalesce(CAST(new AS VARCHAR), '-'), coalesce(status, '-'), coalesce(CAST(flag AS VARCHAR), '-')) AS sig FROM rj),
rl AS (SELECT *, min(seq) OVER (PARTITION BY traj, sig) AS fs, max(seq) OVER (PARTITION BY traj, step_idx) = seq AS ends FROM rk), ro AS (SELECT *, dense_rank() OVER (PARTITION BY traj ORDER BY fs) - 1 AS node_ord FROM rl),
rn AS (SELECT traj, node_ord, any_value(label) AS label, any_value(path) AS path, any_value(lo) AS lo, any_value(hi) AS hi, any_value(status) AS status, bool_or(has_cd) AS has_cd, count(*) AS n_occ, min(step_idx) AS first_step, max(step_idx) AS last_step,
 length(arg_max(thought, seq)) AS thought_len_raw, length(arg_max(event_type_, seq)) AS thought_len_clean, length(arg_max(obs, seq) FILTER (ends)) AS observation_len FROM (SELECT *, ' ' || substr(thought, 6, length(thought) - 8) AS event_type_ FROM ro) GROUP BY traj, node_ord),
re0 AS (SELECT *, lag(node_ord) OVER (PARTITION BY traj ORDER BY seq) AS src, lag(step_idx) OVER (PARTITION BY traj ORDER BY seq) AS prev FROM ro),
rx AS (SELECT traj, seq - 1 AS edge_ord, src, node_ord AS dst, step_idx, step_idx <> prev AS is_first_in_step, CASE WHEN step_idx <> prev THEN length(thought) ELSE 0 END AS thought_len_raw FROM re0 WHERE src IS NOT NULL),
vw AS (SELECT traj, node_ord AS node, path, lo, hi FROM rn WHERE label = 'str_replace_editor: view'), wh AS (SELECT * FROM vw WHERE lo IS NULL), rg AS (SELECT * FROM vw WHERE lo IS NOT NULL),
cl AS (SELECT c.traj, c.path, max(length(p.path)) AS m FROM (SELECT DISTINCT traj, path FROM vw) c JOIN wh p ON p.traj = c.traj AND starts_with(c.path, p.path || '/') GROUP BY c.traj, c.path),
cp2 AS (SELECT cl.traj, cl.path, min(p.node) AS parent FROM cl JOIN wh p ON p.traj = cl.traj AND starts_with(cl.path, p.path || '/') AND length(p.path) = m GROUP BY cl.traj, cl.path),
ns AS (SELECT o.traj, o.node AS src, i.node AS dst FROM rg o JOIN rg i ON o.traj = i.traj AND o.path = i.path AND o.node <> i.node AND o.lo <= i.lo AND i.hi <= o.hi
 WHERE NOT EXISTS (SELECT 1 FROM rg m WHERE m.traj = o.traj AND m.path = o.path AND m.node <> o.node AND m.node <> i.node AND o.lo <= m.lo AND m.hi <= o.hi AND m.lo <= i.lo AND i.hi <= m.hi)),
lw AS (SELECT traj, path, max(node) AS parent FROM wh GROUP BY traj, path),
he AS (SELECT wh.traj, cp2.parent AS src, wh.node AS dst FROM wh JOIN cp2 ON cp2.traj = wh.traj AND cp2.path = wh.path UNION ALL SELECT * FROM ns
 UNION ALL SELECT rg.traj, coalesce(lw.parent, cp2.parent), rg.node FROM rg LEFT JOIN lw ON lw.traj = rg.traj AND lw.path = rg.path LEFT JOIN cp2 ON cp2.traj = rg.traj AND cp2.path = rg.path
  WHERE coalesce(lw.parent, cp2.parent) IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ns WHERE ns.traj = rg.traj AND ns.dst = rg.node))
"""


def built_of(spark, sf_dir):
    return graph.build_graph(views.rich_actions(spark, sf_dir))


@query("q_signature_nodes", RICH + "SELECT traj, node_ord, CAST(node_ord AS VARCHAR) || ':' || label AS key, path, status, has_cd, n_occ, first_step, last_step, thought_len_raw, thought_len_clean, observation_len FROM rn")
def q_signature_nodes(spark, sf_dir):
    n = built_of(spark, sf_dir)[1]
    return n.select("traj", "node_ord", "key", F.element_at("args", "path").alias("path"), F.element_at("args", "edit_status").alias("status"), "has_cd", "n_occ", "first_step", "last_step", "thought_len_raw", "thought_len_clean", "observation_len")


@query("q_signature_edges", RICH + "SELECT * FROM rx")
def q_signature_edges(spark, sf_dir):
    return built_of(spark, sf_dir)[2].drop("thought_len_clean")


@query("q_hier_edges", RICH + "SELECT * FROM he")
def q_hier_edges(spark, sf_dir):
    return built_of(spark, sf_dir)[3].drop("rank")


@query("q_label_sequences", RICH + """, po AS (SELECT *, row_number() OVER (PARTITION BY traj ORDER BY step_idx, node_ord, seq) AS p FROM ro),
ph AS (SELECT *, lag(phase) OVER (PARTITION BY traj ORDER BY p) AS b FROM po WHERE phase <> 'general')
SELECT traj, labels, coalesce(phases, '') AS phases FROM (SELECT traj, string_agg(label, ',' ORDER BY p) AS labels FROM po GROUP BY traj) LEFT JOIN (SELECT traj, string_agg(phase, ',' ORDER BY p) AS phases FROM ph WHERE b IS NULL OR b <> phase GROUP BY traj) USING (traj)""")
def q_label_sequences(spark, sf_dir):
    s = metrics.sequences(built_of(spark, sf_dir)[0])
    return s.select("traj", F.array_join("label_sequence", ",").alias("labels"), F.array_join("phase_sequence", ",").alias("phases"))


@query("q_ranged_edges", RICH + """, d AS (SELECT traj, src, dst, is_first_in_step, step_idx, count(*) AS c, max(thought_len_raw) AS t FROM rx GROUP BY ALL), i AS (SELECT *, step_idx - row_number() OVER (PARTITION BY traj, src, dst, is_first_in_step ORDER BY step_idx) AS isl FROM d)
SELECT traj, src, dst, is_first_in_step, min(step_idx) AS from_step, max(step_idx) AS to_step, CAST(sum(c) AS BIGINT) AS n, max(t) AS thought_len_raw FROM i GROUP BY traj, src, dst, is_first_in_step, isl""")
def q_ranged_edges(spark, sf_dir):
    return graph.ranged_edges(built_of(spark, sf_dir)[2].drop("thought_len_clean"), ["src", "dst", "is_first_in_step"])


@query("q_mean_degrees", RICH + """, al AS (SELECT traj, src, dst, 'exec' AS t FROM rx UNION ALL SELECT traj, src, dst, 'hier' FROM he), od AS (SELECT traj, src, count(*) AS o, count(DISTINCT CASE WHEN t = 'exec' THEN dst END) AS x FROM al GROUP BY traj, src),
sm AS (SELECT traj, sum(o) AS e, max(o) AS mo, max(x) AS mx FROM od GROUP BY traj), nn AS (SELECT traj, count(*) AS n FROM rn GROUP BY traj)
SELECT nn.traj, round(coalesce(e, 0) * 2 / n, 6) AS avg_degree, coalesce(mo, 0) AS max_out_degree, coalesce(mx, 0) AS max_exec_out_degree FROM nn LEFT JOIN sm ON sm.traj = nn.traj""")
def q_mean_degrees(spark, sf_dir):
    _, n, e, h = built_of(spark, sf_dir)
    typed = e.select("traj", "src", "dst", F.lit("exec").alias("type")).unionByName(h.select("traj", "src", "dst", F.lit("hier").alias("type")))
    return graph.mean_degrees(n, typed).withColumn("avg_degree", F.round("avg_degree", 6))


@query("q_trajectory_metrics")
def q_trajectory_metrics(spark, sf_dir):
    """All metrics of each run; tests compare them with brute force. q_cycles and q_longest_path compare those of simple walks with SQL."""
    o, n, e, h = built_of(spark, sf_dir)
    return metrics.trajectory_metrics(o, n, e, h, views.event_status(o))


@query("q_trajectory_stats")
def q_trajectory_stats(spark, sf_dir):
    _, n, e, h = built_of(spark, sf_dir)
    return metrics.trajectory_stats(n, e, h)


@query("q_inefficiencies", RICH + """, pq AS (SELECT *, row_number() OVER (PARTITION BY traj ORDER BY step_idx, node_ord, seq) AS p FROM ro WHERE phase = 'patch'),
ab AS (SELECT traj, bool_or(none) AS abandoned FROM (SELECT traj, path, bool_and(coalesce(status LIKE 'failure:%', false)) AS none FROM pq GROUP BY traj, path) GROUP BY traj),
ff AS (SELECT traj, bool_or(f) AS flip FROM (SELECT traj, coalesce(path = lag(path) OVER w AND old = lag(new) OVER w AND new = lag(old) OVER w, false) AS f FROM pq WINDOW w AS (PARTITION BY traj ORDER BY p)) GROUP BY traj),
lo AS (SELECT traj, max(c) > 1 AS again FROM (SELECT traj, node_ord, count(*) AS c FROM ro WHERE phase = 'localization' GROUP BY traj, node_ord) GROUP BY traj), nf AS (SELECT traj, bool_or(status = 'failure: not found') AS lost FROM pq GROUP BY traj),
fl2 AS (SELECT t.traj, coalesce(again, false) AS r, coalesce(abandoned, false) AS u, coalesce(flip, false) AS e, coalesce(lost, false) AS s FROM (SELECT DISTINCT traj FROM ro) t LEFT JOIN lo ON lo.traj = t.traj LEFT JOIN ab ON ab.traj = t.traj LEFT JOIN ff ON ff.traj = t.traj LEFT JOIN nf ON nf.traj = t.traj),
un AS (SELECT 'RepeatedView' AS name, r AS own FROM fl2 UNION ALL SELECT 'UnresolvedRetry', u FROM fl2 UNION ALL SELECT 'EditReversion', e FROM fl2 UNION ALL SELECT 'StrNotFound', s FROM fl2 UNION ALL SELECT 'any', r OR u OR e OR s FROM fl2)
SELECT name, count(*) FILTER (own) AS n, round_even(count(*) FILTER (own) * 100.0 / count(*), 2) AS pct FROM un GROUP BY name HAVING count(*) FILTER (own) > 0""")
def q_inefficiencies(spark, sf_dir):
    o = built_of(spark, sf_dir)[0]
    ed, own = metrics.edits(o), graph.localization_repeats(o)
    m = own.join(patches.reversals(ed), "traj", "left").join(patches.patch_metrics(ed), "traj", "left")
    flags = metrics.inefficiencies(m, {k: v for k, v in (metrics.LOCALIZATION_FLAGS | metrics.PATCHING_FLAGS).items() if k in ("RepeatedView", "UnresolvedRetry", "EditReversion", "StrNotFound")})
    return metrics.flag_totals(flags, ["RepeatedView", "UnresolvedRetry", "EditReversion", "StrNotFound"]).withColumn("pct", F.col("pct").cast("double"))


@query("q_resolution_rates", BASE + "SELECT traj % 4 AS unit, count(*) AS runs, count(*) FILTER (status = 'resolved') AS resolved, round(avg(CASE WHEN status = 'resolved' THEN 1.0 ELSE 0.0 END) * 100, 1) AS rate FROM st GROUP BY unit")
def q_resolution_rates(spark, sf_dir):
    s = views.event_status(views.event_actions(spark, sf_dir)).withColumn("unit", F.col("traj") % 4)
    return metrics.resolution_rates(s, ["unit"])


@query("q_condensed_path", BARE + """, w AS (SELECT traj, src, dst FROM x UNION SELECT w.traj, w.src, x.dst FROM w JOIN x ON x.traj = w.traj AND x.src = w.dst),
nd AS (SELECT traj, src AS node FROM x UNION SELECT traj, dst FROM x), m AS (SELECT a.traj, a.src AS node, min(a.dst) AS comp FROM w a JOIN w b ON a.traj = b.traj AND a.src = b.dst AND a.dst = b.src GROUP BY a.traj, a.src),
cm AS (SELECT nd.traj, nd.node, coalesce(comp, nd.node) AS comp FROM nd LEFT JOIN m ON m.traj = nd.traj AND m.node = nd.node), ce AS (SELECT DISTINCT x.traj, s.comp AS src, d.comp AS dst FROM x JOIN cm s ON s.traj = x.traj AND s.node = x.src JOIN cm d ON d.traj = x.traj AND d.node = x.dst WHERE s.comp <> d.comp),
lp AS (SELECT traj, comp AS node, 0 AS far FROM cm UNION SELECT lp.traj, ce.dst, far + 1 FROM lp JOIN ce ON ce.traj = lp.traj AND ce.src = lp.node)
SELECT traj, CAST(max(far) AS BIGINT) AS condensed_path FROM lp GROUP BY traj""")
def q_condensed_path(spark, sf_dir):
    return traversal.condensed_path(bare_pairs(spark, sf_dir))


#: Scripts that the events stand for, with what each of them holds.
SCRIPTS = """WITH t AS (SELECT event_id, event_id % 5 AS kind, CAST(event_id % 17 AS VARCHAR) AS n, CAST(user_id % 9 AS VARCHAR) AS m FROM events)
"""


@query("q_shell_actions", SCRIPTS + r"""SELECT event_id, 0 AS cmd_pos, 'grep' AS command, 'w ' || n || '|f' || m || '.py' AS argv, 'n=true,r=true' AS flags, true AS has_cd FROM t WHERE kind = 0
UNION ALL SELECT event_id, 0, 'set_env', 'A=' || n || ' B=2', '', false FROM t WHERE kind = 1 UNION ALL SELECT event_id, 1, 'pytest', 'tests/', 'maxfail=' || m, false FROM t WHERE kind = 1
UNION ALL SELECT event_id, 0, 'find', '.', 'name=*.' || m || ',type=f', false FROM t WHERE kind = 2 UNION ALL SELECT event_id, 1, 'wc', '', 'l=true', false FROM t WHERE kind = 2
UNION ALL SELECT event_id, 0, 'complex_command', 'for i in ' || n || '; do ls; done', '', false FROM t WHERE kind = 3
UNION ALL SELECT event_id, 0, 'cat', 'x = ' || n || '|>|f' || m || '.py', '__heredoc__=true', false FROM t WHERE kind = 4""")
def q_shell_actions(spark, sf_dir):
    n, m = (F.col("event_id") % 17).cast("string"), (F.col("user_id") % 9).cast("string")
    line = (
        F.when(F.col("event_id") % 5 == 0, F.concat(F.lit('cd /d && grep -rn "w '), n, F.lit('" f'), m, F.lit(".py")))
        .when(F.col("event_id") % 5 == 1, F.concat(F.lit("A="), n, F.lit(" B=2 pytest --maxfail="), m, F.lit(" tests/")))
        .when(F.col("event_id") % 5 == 2, F.concat(F.lit("find . -name '*."), m, F.lit("' -type f; wc -l")))
        .when(F.col("event_id") % 5 == 3, F.concat(F.lit("for i in "), n, F.lit("; do ls; done")))
        .otherwise(F.concat(F.lit("cat <<'EOF' > f"), m, F.lit(".py\nx = "), n, F.lit("\nEOF")))
    )
    calls = views.table(spark, sf_dir, "events").select(F.col("event_id").alias("traj"), F.lit(0).alias("step_idx"), F.lit(0).alias("call_pos"), line.alias("text"))
    flags = F.array_join(F.array_sort(F.transform(F.map_entries("flags"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")
    return commands.shell_actions(calls).select(F.col("traj").alias("event_id"), "cmd_pos", "command", F.array_join("argv", "|").alias("argv"), flags.alias("flags"), "has_cd")


#: Whole texts as scripts, commas as separators, and how the tokenizer sees them.
PROSE = r"""WITH t AS (SELECT 'document' AS kind, doc_id AS traj, CAST(0 AS BIGINT) AS step_idx, trim(translate(coalesce(text, ''), ',', ';'), ' ') AS text FROM documents
 UNION ALL SELECT 'turn', conv_id, CAST(turn AS BIGINT), trim(translate(coalesce(text, ''), ',', ';'), ' ') FROM conversations),
u AS (SELECT *, regexp_matches(text, '^\s*(?:for|while|until|if|case|function|select)\b|^\s*[({]') OR regexp_matches(regexp_replace(text, '(?s)\\.|"(?:\\.|[^"\\])*"|''[^'']*''', '', 'g'), '["'']') AS whole,
 regexp_extract_all(text, '&&|\|\||;|\n|(?:"(?:\\.|[^"\\])*"|''[^'']*''|\\.|[^\s;&|"''\\])+|\||&') AS toks FROM t),
k AS (SELECT kind, traj, step_idx, unnest(toks) AS tok, generate_subscripts(toks, 1) AS i FROM u WHERE NOT whole),
n AS (SELECT *, count(*) FILTER (tok IN ('&&', '||', ';', chr(10))) OVER (PARTITION BY kind, traj, step_idx ORDER BY i) AS run FROM k),
c AS (SELECT kind, traj, step_idx, run, regexp_replace(regexp_replace(arg_min(tok, i), '^"((?s:.*))"$|^''((?s:.*))''$', '\1\2'), '\\(.)', '\1', 'g') AS command, count(*) FILTER (NOT regexp_matches(tok, '^-.')) AS own, count(*) AS every
 FROM n WHERE tok NOT IN ('&&', '||', ';', chr(10)) GROUP BY kind, traj, step_idx, run),
d AS (SELECT * FROM c WHERE NOT (command IN ('true', 'false') AND every = 1))
"""


@query("q_text_commands", PROSE + r""", g AS (SELECT kind, traj, step_idx, count(*) AS actions, CAST(sum(own - CASE WHEN command LIKE '-_%' THEN 0 ELSE 1 END) AS BIGINT) AS words, string_agg(command, ' ' ORDER BY run) AS commands FROM d GROUP BY kind, traj, step_idx)
SELECT kind, traj, step_idx, actions, words, md5(commands) AS commands FROM g
UNION ALL SELECT kind, traj, step_idx, 1, 1, md5('complex_command') FROM u WHERE whole
UNION ALL SELECT kind, traj, step_idx, 1, 1, md5('bash') FROM u WHERE NOT whole AND len(toks) = 0""")
def q_text_commands(spark, sf_dir):
    """All texts of documents and conversations as scripts: how many actions each holds, of which commands, with how many words."""
    d, c = views.table(spark, sf_dir, "documents"), views.table(spark, sf_dir, "conversations")
    script = F.translate("text", ",", ";").alias("text")
    calls = d.select(F.lit("document").alias("kind"), F.col("doc_id").alias("traj"), F.lit(0).cast("long").alias("step_idx"), script)
    calls = calls.unionByName(c.select(F.lit("turn").alias("kind"), F.col("conv_id").alias("traj"), F.col("turn").cast("long").alias("step_idx"), script))
    keys = ["kind", "traj", "step_idx"]
    out = commands.shell_actions(calls, keep_cd=True, keys=keys).groupBy(*keys)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("cmd_pos", "command"))), lambda x: x["command"])
    return out.agg(F.count("*").alias("actions"), F.sum(F.size("argv")).cast("long").alias("words"), F.md5(F.array_join(listed, " ")).alias("commands"))


@query("q_phase_classes", """WITH t AS (SELECT event_id, event_id % 7 AS kind, CASE user_id % 4 WHEN 0 THEN 'src/a.py' WHEN 1 THEN 'tests/a.py' WHEN 2 THEN './tests/a.py' ELSE 'test_word' END AS path, CASE WHEN event_id % 3 = 0 THEN 'codex' END AS framework FROM events),
u AS (SELECT *, framework IS NOT NULL AS x, CASE WHEN framework IS NOT NULL THEN path IN ('tests/a.py', './tests/a.py') ELSE path = './tests/a.py' END AS test FROM t)
SELECT event_id, CASE kind WHEN 0 THEN CASE WHEN test THEN 'ctx' ELSE 'loc' END WHEN 1 THEN CASE WHEN test THEN 'ctx' ELSE 'patch' END WHEN 2 THEN 'ctx' WHEN 3 THEN CASE WHEN test THEN 'ctx' ELSE 'patch' END
 WHEN 4 THEN CASE WHEN x THEN 'loc' ELSE 'general' END WHEN 5 THEN CASE WHEN NOT x THEN 'general' WHEN test THEN 'ctx' ELSE 'patch' END ELSE CASE WHEN x THEN 'ctx' ELSE 'general' END END AS phase_class FROM u""")
def q_phase_classes(spark, sf_dir):
    e, kind = views.table(spark, sf_dir, "events"), F.col("event_id") % 7
    path = F.when(F.col("user_id") % 4 == 0, "src/a.py").when(F.col("user_id") % 4 == 1, "tests/a.py").when(F.col("user_id") % 4 == 2, "./tests/a.py").otherwise("test_word")
    name = F.when(kind == 0, "grep").when(kind == 1, "sed").when(kind == 2, "python").when(kind == 3, "cat").when(kind == 4, "git").when(kind == 5, "mkdir").otherwise("echo")
    tokens = F.when(kind == 3, F.array(F.lit("a"), F.lit(">"), path)).when(kind == 4, F.array(F.lit("status"), path)).otherwise(F.array(path))
    flags = F.when(kind == 1, F.create_map(F.lit("i"), F.lit("true"))).otherwise(F.create_map().cast("map<string,string>"))
    none = F.lit(None).cast("string")
    return e.select("event_id", rules.phase_class(none, none, name, tokens, flags, F.when(F.col("event_id") % 3 == 0, "codex")).alias("phase_class"))


def spoken(spark, sf_dir):
    """The conversations as session records: one for each turn, told by its role."""
    return views.table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("session"), F.col("turn").alias("rec_no"), "role", "text")


@query("q_native_calls", """WITH w AS (SELECT conv_id, turn, role, text, lead(role) OVER v AS nr, lead(text) OVER v AS nt FROM conversations WINDOW v AS (PARTITION BY conv_id ORDER BY turn))
SELECT CAST(conv_id AS VARCHAR) AS session, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS step_idx, coalesce(text, '') AS thought, CASE WHEN nr = 'user' THEN nt END AS observation FROM w WHERE role = 'assistant'""")
def q_native_calls(spark, sf_dir):
    """Written as transcripts, an assistant's turn uses a tool and the user's next turn is its result, then read."""
    before = F.lag("rec_no").over(Window.partitionBy("session").orderBy("rec_no"))
    s = spoken(spark, sf_dir).withColumn("_p", before)
    said = F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))
    asked = F.struct(F.lit("tool_use").alias("type"), F.col("rec_no").cast("string").alias("id"), F.lit("Say").alias("name"))
    answered = F.struct(F.lit("tool_result").alias("type"), F.col("_p").cast("string").alias("tool_use_id"), F.col("text").alias("content"))
    blocks = lambda *b: F.concat(F.lit("["), F.concat_ws(",", *[F.to_json(x) for x in b]), F.lit("]"))
    content = F.when(F.col("role") == "assistant", blocks(said, asked)).when(F.col("role") == "user", blocks(answered)).otherwise(blocks(said))
    line = F.concat(F.lit('{"type":"'), F.col("role"), F.lit('","message":{"role":"'), F.col("role"), F.lit('","content":'), content, F.lit("}}"))
    calls = logs.ADAPTERS["claude"](s.select("session", "rec_no", line.alias("text")))
    return calls.select("session", "step_idx", "thought", "observation")


@query("q_session_steps", """WITH w AS (SELECT conv_id, turn, role, text, lag(role) OVER v AS pr FROM conversations WHERE role IN ('assistant', 'user') WINDOW v AS (PARTITION BY conv_id ORDER BY turn)),
s AS (SELECT *, sum(CASE WHEN role = 'assistant' AND (pr IS NULL OR pr = 'user') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS step FROM w)
SELECT CAST(conv_id AS VARCHAR) AS session, CAST(step AS BIGINT) AS step_idx, row_number() OVER (PARTITION BY conv_id, step ORDER BY turn) - 1 AS call_pos, CAST(turn AS VARCHAR) AS call_id FROM s WHERE role = 'assistant'""")
def q_session_steps(spark, sf_dir):
    """Written as a rollout, an assistant's turn is a call and the user's next turn the output of the last call, then read."""
    last = F.last(F.when(F.col("role") == "assistant", F.col("rec_no")), ignorenulls=True).over(Window.partitionBy("session").orderBy("rec_no"))
    s = spoken(spark, sf_dir).withColumn("_c", last.cast("string"))
    call = F.to_json(F.struct(F.lit("function_call").alias("type"), F.col("_c").alias("call_id"), F.lit("say").alias("name"), F.col("text").alias("arguments")))
    output = F.to_json(F.struct(F.lit("function_call_output").alias("type"), F.col("_c").alias("call_id"), F.col("text").alias("output")))
    payload = F.when(F.col("role") == "assistant", call).when(F.col("role") == "user", output).otherwise(F.lit('{"type":"other"}'))
    line = F.concat(F.lit('{"type":"response_item","payload":'), payload, F.lit("}"))
    return logs.ADAPTERS["codex"](s.select("session", "rec_no", line.alias("text"))).select("session", "step_idx", "call_pos", "call_id")


@query("q_run_listing", BASE + """, g AS (SELECT traj, count(DISTINCT step_idx) AS c FROM a GROUP BY traj)
SELECT CAST(traj AS VARCHAR) AS traj, CASE WHEN traj % 5 < 2 THEN 'resolved' WHEN traj % 5 = 2 THEN 'unresolved' ELSE 'unsubmitted' END AS status, CASE WHEN traj % 4 = 1 THEN 'under1h' ELSE 'unknown' END AS difficulty, c AS step_count FROM g""")
def q_run_listing(spark, sf_dir):
    a = views.event_actions(spark, sf_dir).withColumn("_t", F.col("traj")).withColumn("traj", F.col("traj").cast("string"))
    ids = lambda *rest: F.array_agg(F.when((F.col("_t") % 5).isin(*rest), F.col("traj")))
    reports = a.select("traj", "_t").distinct().agg(ids(0, 1).alias("resolved_ids"), ids(1, 2).alias("unresolved_ids"))
    hard = a.where("_t % 4 = 1").select("traj", F.lit("under1h").alias("difficulty")).distinct()
    return logs.listing(a, a, reports, hard)


#: All events as one run.
LONG = """WITH e AS (SELECT event_id, user_id, event_type, row_number() OVER (ORDER BY ts, event_id) - 1 AS seq FROM events),
c AS (SELECT *, seq // 2 AS step_idx, event_type || ':' || CAST(user_id % 50 AS VARCHAR) AS label, CASE event_type WHEN 'view' THEN 'loc' WHEN 'error' THEN 'ctx' WHEN 'click' THEN 'ctx' WHEN 'purchase' THEN 'patch' ELSE 'general' END AS phase_class FROM e),
a AS (SELECT *, CASE WHEN phase_class = 'ctx' THEN CASE WHEN max(CASE WHEN phase_class = 'patch' THEN 1 ELSE 0 END) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 1 THEN 'validation' ELSE 'localization' END
  WHEN phase_class = 'loc' THEN 'localization' ELSE phase_class END AS phase FROM c)
"""


@query("q_long_phases", LONG + "SELECT event_id, seq, step_idx, phase FROM a")
def q_long_phases(spark, sf_dir):
    """A run that no task holds whole: blocks of 4,096 places."""
    return scans.resolved(views.whole_actions(spark, sf_dir), block=4096).select("event_id", "seq", "step_idx", "phase")


@query("q_long_runs", LONG + """, k AS (SELECT seq, phase, CASE phase WHEN 'localization' THEN 'L' WHEN 'patch' THEN 'P' ELSE 'V' END AS abbr FROM a WHERE phase <> 'general'),
n AS (SELECT *, CASE WHEN abbr = lag(abbr) OVER (ORDER BY seq) THEN 0 ELSE 1 END AS new FROM k), r AS (SELECT *, sum(new) OVER (ORDER BY seq) - 1 AS run_no FROM n)
SELECT CAST(run_no AS BIGINT) AS run_no, min(phase) AS phase, min(abbr) AS abbr, count(*) AS len FROM r GROUP BY run_no""")
def q_long_runs(spark, sf_dir):
    return scans.phase_runs(scans.resolved(views.whole_actions(spark, sf_dir), block=4096), block=4096).drop("traj")


@query("q_long_edges", LONG + """, f AS (SELECT *, min(seq) OVER (PARTITION BY label) AS fs FROM a), o AS (SELECT *, dense_rank() OVER (ORDER BY fs) - 1 AS node FROM f),
x AS (SELECT seq - 1 AS edge_ord, lag(node) OVER (ORDER BY seq) AS src, node AS dst, step_idx, step_idx <> lag(step_idx) OVER (ORDER BY seq) AS is_first_in_step FROM o)
SELECT * FROM x WHERE src IS NOT NULL""")
def q_long_edges(spark, sf_dir):
    o = scans.node_occurrences(views.whole_actions(spark, sf_dir))
    return scans.edges(o, block=4096).drop("traj")


def order_sequences(spark, sf_dir):
    """Customers' orders in time as letters of their priorities, by a group of the customer."""
    o = views.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("traj"), F.struct("o_orderdate", "o_orderkey", F.left("o_orderpriority", F.lit(1)).alias("x")).alias("_o"))
    seqs = o.groupBy("traj").agg(F.transform(F.array_sort(F.collect_list("_o")), lambda z: z["x"]).alias("seq"))
    return seqs.withColumn("grp", F.col("traj") % 3)


def gapped_sql(levels: int = 9) -> str:
    """Pattern growth level by level; the last one finds nothing on the given tables."""
    sql = """WITH o AS (SELECT o_custkey AS traj, o_custkey % 3 AS grp, string_agg(left(o_orderpriority, 1), '' ORDER BY o_orderdate, o_orderkey) AS seq FROM orders GROUP BY o_custkey),
t AS (SELECT grp, count(*) AS total FROM o GROUP BY grp), l AS (SELECT unnest(['1', '2', '3', '4', '5']) AS x), g0 AS (SELECT grp, traj, '' AS pattern, seq AS rest FROM o)"""
    for k in range(1, levels + 1):
        sql += f""",
h{k} AS (SELECT grp, traj, pattern || x AS pattern, substr(rest, strpos(rest, x) + 1) AS rest FROM g{k - 1}, l WHERE strpos(rest, x) > 0),
f{k} AS (SELECT grp, pattern, count(*) AS n, round(count(*) / any_value(total), 6) AS support FROM h{k} JOIN t USING (grp) GROUP BY grp, pattern HAVING count(*) / any_value(total) >= 0.3),
g{k} AS (SELECT h{k}.* FROM h{k} SEMI JOIN f{k} USING (grp, pattern))"""
    return sql + "\n" + " UNION ALL ".join(f"SELECT * FROM f{k}" for k in range(1, levels + 1))


@query("q_gapped_patterns", gapped_sql())
def q_gapped_patterns(spark, sf_dir):
    found = patterns.gapped(order_sequences(spark, sf_dir))
    return found.withColumn("pattern", F.array_join("pattern", "")).withColumn("support", F.round("support", 6))


@query("q_unedited_leaves", PATHS + """, lf AS (SELECT DISTINCT traj, regexp_extract(path, '[^/]*/[^/]*$') AS path FROM u WHERE path <> ''), ed AS (SELECT DISTINCT traj, path AS patched FROM u WHERE path <> '' AND seq % 3 = 2)
SELECT traj, count(*) FILTER (NOT EXISTS (SELECT 1 FROM ed WHERE ed.traj = lf.traj AND contains(patched, path))) AS n FROM lf GROUP BY traj""")
def q_unedited_leaves(spark, sf_dir):
    """The last two parts of each page's path, where no page that counts as edited has them in its path."""
    p = views.page_paths(spark, sf_dir).where("path <> ''")
    leaves = p.select("traj", F.regexp_extract("path", "[^/]*/[^/]*$", 0).alias("path"))
    return containment.deep_zooms_without_edit(leaves, p.where("seq % 3 = 2"))
