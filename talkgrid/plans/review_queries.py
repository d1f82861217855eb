"""Queries of review, editing and session operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkgrid.operators import review as R
from talkgrid.functions import rules as RU
from talkgrid.plans import views as V
from talkgrid.plans.registry import query


@query("SELECT conv_id AS note_id, turn AS \"index\", conv_id % 3 <> 0 AND turn % 2 = 0 AS changed, CASE WHEN conv_id % 3 <> 0 AND turn % 2 = 0 THEN 'new' ELSE text END AS text FROM conversations")
def text_write_back(spark, d):
    """Every third note's edits hold a blank text and are rejected."""
    rows = V.table(spark, d, "conversations").select(F.col("conv_id").alias("note_id"), F.col("turn").alias("index"), "text")
    edits = rows.where("index % 2 = 0").select("note_id", "index", F.when((F.col("note_id") % 3 == 0) & (F.col("index") == 0), " ").otherwise("new").alias("text"))
    return R.write_back(rows, edits, "note_id").select("note_id", "index", "changed", "text")


@query("SELECT o_orderkey AS key, o_orderkey % 5 AS target, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 5 = o_orderkey % 3 THEN 'none' WHEN o_orderkey % 2 = 0 AND o_orderkey % 4 = 0 THEN 'merge' ELSE 'reinforce' END AS action FROM orders")
def feedback_plan(spark, d):
    """E19"""
    i = F.col("key")
    k = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("key"))
    return R.feedback_plan(k.withColumn("target", i % 5), k.where(i % 2 == 0).select("key", (i % 3).alias("prior"), F.when(i % 4 == 0, "").otherwise("Ann").alias("prior_name")))


@query("SELECT user_id AS merge_id, CASE arg_max(event_id % 3, event_id) WHEN 1 THEN 'undone' WHEN 2 THEN 'revived' ELSE 'live' END AS state FROM events GROUP BY 1")
def journal_states(spark, d):
    """E11, E12, E07"""
    kind = F.element_at(F.array(F.lit("merge"), F.lit("undo"), F.lit("redo")), (F.col("event_id") % 3 + 1).cast("int"))
    return R.journal_state(V.table(spark, d, "events").select(F.col("user_id").alias("merge_id"), kind.alias("kind"), F.col("event_id").alias("at")))


@query("SELECT event_id, value / 500 >= 0.68 OR (event_id % 5 >= 3 AND value / 500 >= 0.5) AS passes FROM events WHERE value IS NOT NULL")
def z_gates(spark, d):
    """V08, V15"""
    return V.table(spark, d, "events").where("value is not null").select("event_id", R.z_gate(F.col("value") / 500, (F.col("event_id") % 5).cast("double")).alias("passes"))


@query("SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN CAST(json_extract(props, '$.k') AS INT) END AS k FROM events")
def raw_outputs(spark, d):
    """V19"""
    raw = F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("text <<<"), F.col("props"), F.lit(">>> more"))).otherwise("no marks")
    return V.table(spark, d, "events").select("event_id", R.raw_output(raw, "k int")["k"].alias("k"))


@query("SELECT l_suppkey AS id, string_agg(CAST(l_orderkey * 10 + l_linenumber AS VARCHAR), ',' ORDER BY l_orderkey, l_linenumber) AS evidence FROM lineitem GROUP BY 1")
def relation_evidence(spark, d):
    """G03, O13"""
    t = V.table(spark, d, "lineitem")
    e = t.select(F.col("l_suppkey").alias("relation_id"), F.col("l_orderkey").alias("note_id"), F.col("l_linenumber").alias("paragraph"), F.lit(0).alias("start"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    b = R.relation_bundle(t.select(F.col("l_suppkey").alias("id")).distinct(), e)
    return b.select("id", F.array_join(F.col("evidence").cast("array<string>"), ",").alias("evidence"))


@query("""WITH t AS (SELECT conv_id AS key, turn AS t, 'w' || CAST(turn AS VARCHAR) AS token FROM conversations), b AS (SELECT conv_id AS key, turn // 3 AS segment, max(turn) + 1 AS e FROM conversations GROUP BY 1, 2) SELECT key, turn_seg AS segment, string_agg(token, ' ' ORDER BY t) AS text FROM (SELECT t.*, t.t // 3 AS turn_seg FROM t) GROUP BY 1, 2""")
def token_groups(spark, d):
    """X21"""
    c = V.table(spark, d, "conversations")
    tokens = c.select(F.col("conv_id").alias("key"), F.col("turn").alias("t"), F.concat(F.lit("▁w"), F.col("turn").cast("string")).alias("token"))
    bounds = c.groupBy(F.col("conv_id").alias("key"), F.expr("turn div 3").alias("segment")).agg((F.max("turn") + 1).alias("end"))
    return R.tokens_to_segments(tokens, bounds)


@query("SELECT p_partkey AS note_id, CASE WHEN p_partkey % 2 = 0 THEN 'org' ELSE 'term' END AS kind, p_name AS name, p_type AS aliases FROM part WHERE p_partkey % 5 <> 0")
def parsed_entities(spark, d):
    """N31, G22"""
    i = F.col("id")
    e = F.struct(F.when(i % 2 == 0, "org").otherwise("").alias("kind"), F.when(i % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("name"), F.lit(" "))).alias("name"), F.array(F.col("alias"), F.lit(" ")).alias("aliases"))
    raw = V.entities(spark, d).select(i.alias("note_id"), F.to_json(F.array(e)).alias("raw"))
    return R.parsed_entities(raw).withColumn("aliases", F.array_join("aliases", "|"))


@query("SELECT doc_id, doc_id % 3 = 0 OR doc_id % 4 = 0 AS dirty FROM documents WHERE trim(text) <> ''")
def save_diff(spark, d):
    """N41, N37"""
    t = V.table(spark, d, "documents").select("doc_id", "text")
    after = t.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return R.save_diff(t.where("doc_id % 4 <> 0"), after, "doc_id").select("doc_id", "dirty")


@query("SELECT o_orderkey AS note_id, CASE WHEN o_custkey % 6 <> 0 THEN o_custkey END AS person_id FROM orders")
def detached_people(spark, d):
    """N23, N25"""
    s = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("note_id"), F.col("o_custkey").alias("person_id"))
    gone = V.table(spark, d, "customer").where("c_custkey % 6 = 0").select(F.col("c_custkey").alias("id"))
    return R.detach_person(s, gone.unionByName(s.where("person_id % 6 = 0").select(F.col("person_id").alias("id"))).distinct()).select("note_id", "person_id")


@query(f"WITH {V.SEG}, f AS (SELECT * FROM seg WHERE seq % 4 <> 2), g AS (SELECT note_id AS key, start_ms, max(end_ms) OVER (PARTITION BY note_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS from_ms FROM f) SELECT key, from_ms, start_ms AS to_ms FROM g WHERE start_ms - from_ms > 4000")
def session_gaps(spark, d):
    """T25, T28"""
    s = V.segments(spark, d).where("seq % 4 <> 2").select(F.col("note_id").alias("key"), "start_ms", "end_ms")
    return R.gap_ranges(s, 4000)


@query("SELECT position, round(CASE WHEN away = 0 THEN 0.063 WHEN away < 1280 THEN 0.063 + 0.937 * away / 1280 ELSE 1.0 END, 6) AS gain FROM (SELECT event_id * 100 AS position, least(abs((event_id * 100) % 20000 - 5000), abs((event_id * 100) % 20000 - 5000)) AS away FROM events)")
def gain_curve(spark, d):
    """One ducked point in every 20,000 samples."""
    p = V.table(spark, d, "events").select((F.col("event_id") * 100).alias("position"))
    spans = p.select((F.floor(F.col("position") / 20_000) * 20_000 + 5000).alias("first")).distinct().withColumn("last", F.col("first"))
    return R.gain_at(p, spans).select("position", F.round("gain", 6).alias("gain"))


@query(f"""WITH {V.REL}, {V.ENT}, e AS (SELECT * FROM rel WHERE confidence >= 0.95 AND subject_id IN (SELECT id FROM ent) AND object_id IN (SELECT id FROM ent)) SELECT 'node' AS part, id AS x, 0 AS y FROM ent WHERE id IN (SELECT subject_id FROM e) OR id IN (SELECT object_id FROM e) UNION ALL SELECT 'edge', subject_id, object_id FROM e""")
def semantic_subgraph(spark, d):
    """G01, N38"""
    nodes, edges = R.subgraph(V.entities(spark, d), V.relations(spark, d).where("confidence >= 0.95"), pruned=True)
    return nodes.select(F.lit("node").alias("part"), F.col("id").alias("x"), F.lit(0).cast("long").alias("y")).unionByName(edges.select(F.lit("edge").alias("part"), F.col("subject_id").alias("x"), F.col("object_id").alias("y")))


@query("SELECT o_orderkey AS id, '# ' || o_orderpriority || chr(10) || strftime(o_orderdate, '%Y-%m-%d %H:%M') || CASE WHEN o_orderstatus = 'F' THEN ' (' || printf('%dm%ds', (60 + o_orderkey % 600) // 60, (60 + o_orderkey % 600) % 60) || ')' ELSE ' (interrupted)' END AS head FROM orders")
def export_heads(spark, d):
    """X27, X25"""
    s = F.when(F.col("o_orderstatus") == "F", (60 + F.col("o_orderkey") % 600).cast("long"))
    return V.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), R.export_line(F.col("o_orderpriority"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm"), s).alias("head"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 'paused' ELSE 'active' END WHEN event_id % 3 = 1 THEN 'interrupted' ELSE 'none' END AS badge FROM events")
def layout_budget(spark, d):
    """Badges of notes' states."""
    i = F.col("event_id")
    state = F.element_at(F.array(*map(F.lit, ("active", "recording", "complete"))), (i % 3 + 1).cast("int"))
    return V.table(spark, d, "events").select("event_id", F.coalesce(RU.note_badge(state, i % 2 == 0), F.lit("none")).alias("badge"))
