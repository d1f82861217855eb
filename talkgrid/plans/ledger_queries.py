"""Queries of governance: ledgers, edits, guards and contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkgrid.operators import ledger as L
from talkgrid.operators import windows as W
from talkgrid.plans import views as V
from talkgrid.plans.registry import query


def _ops(spark, d):
    """Orders as operations: renames and merges of parts, without undos."""
    i = F.col("o_orderkey")
    entity, target = (i % 200 + 1).cast("string"), (i % 13 + 1).cast("string")
    rename = F.to_json(F.struct(entity.alias("entity"), F.concat(F.lit("name "), i.cast("string")).alias("name")))
    merge = F.to_json(F.struct((i % 200 + 300).cast("string").alias("source"), target.alias("target")))
    return V.table(spark, d, "orders").select(i.alias("op_index"), i.cast("string").alias("id"), F.when(i % 4 == 0, "merge").otherwise("rename").alias("kind"), F.when(i % 4 == 0, merge).otherwise(rename).alias("payload"), F.lit(None).cast("string").alias("target"))


@query("""WITH r AS (SELECT o_orderkey % 200 + 1 AS id, arg_max('name ' || CAST(o_orderkey AS VARCHAR), o_orderkey) AS name FROM orders WHERE o_orderkey % 4 <> 0 GROUP BY 1), m AS (SELECT DISTINCT o_orderkey % 200 + 300 AS id FROM orders WHERE o_orderkey % 4 = 0)
SELECT CAST(p_partkey AS VARCHAR) AS id, coalesce(r.name, p_name) AS name FROM part LEFT JOIN r ON p_partkey = r.id WHERE p_partkey NOT IN (SELECT id FROM m)""")
def ledger_registry(spark, d):
    """E02"""
    base = V.entities(spark, d).select(F.col("id").cast("string").alias("id"), "name")
    return L.registry(base, _ops(spark, d))


@query("""WITH m AS (SELECT o_orderkey % 200 + 300 AS id, arg_max(o_orderkey % 13 + 1, o_orderkey) AS target FROM orders WHERE o_orderkey % 4 = 0 GROUP BY 1) SELECT CAST(p_partkey AS VARCHAR) AS id, CAST(coalesce(m.target, p_partkey) AS VARCHAR) AS target FROM part LEFT JOIN m ON p_partkey = m.id""")
def ledger_targets(spark, d):
    """E06, J13"""
    return L.resolved(V.entities(spark, d).select(F.col("id").cast("string").alias("id")), _ops(spark, d))


@query("""SELECT op_index, id, coalesce(m % 7 + 100, id) AS target FROM (SELECT o_orderkey AS op_index, o_custkey % 50 AS id, max(CASE WHEN o_orderkey % 50 = 0 THEN o_orderkey END) OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM orders)""")
def prefix_resolution(spark, d):
    """Every fiftieth order is a merge, all are events."""
    o = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("op_index"), (F.col("o_custkey") % 50).alias("id"))
    merges = o.where("op_index % 50 = 0").select(F.col("id").alias("source"), "op_index", (F.col("op_index") % 7 + 100).alias("target"))
    return L.resolved_before(o, merges)


@query("""SELECT conv_id AS note_id, turn AS seq, turn % 3 = 0 AS applied, CASE WHEN turn % 3 = 0 THEN 'edited' ELSE text END AS text FROM conversations""")
def text_edits(spark, d):
    """Every second turn is edited, of which only those whose expectation holds change."""
    s = V.segments(spark, d).select("note_id", "seq", "text")
    edits = s.where("seq % 3 < 2").select("note_id", "seq", F.when(F.col("seq") % 3 == 0, F.col("text")).otherwise("stale").alias("expected"), F.lit("edited").alias("new_text"))
    return L.edit_if_unchanged(s, edits, ["note_id", "seq"]).select("note_id", "seq", "applied", "text")


@query("SELECT conv_id AS note_id, turn AS seq, CASE WHEN turn % 2 = 0 THEN 'S9' ELSE role END AS speaker FROM conversations")
def speaker_reassignment(spark, d):
    """E14, N22"""
    s = V.segments(spark, d).select("note_id", "seq", "speaker")
    changes = s.where("seq % 2 = 0").select("note_id", "seq", F.col("speaker").alias("expected"), F.lit("S9").alias("target"))
    return L.reassign_all_or_none(s, changes, spark.createDataFrame([("S9",)], "speaker_id string"), ["note_id", "seq"])


@query("SELECT conv_id AS note_id, turn AS seq, 'S' || CAST(4 + row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS VARCHAR) AS speaker_id FROM conversations")
def speaker_ids(spark, d):
    """E15"""
    s = V.segments(spark, d).select("note_id", "seq")
    have = s.select("note_id").distinct().withColumn("speaker_id", F.explode(F.array(F.lit("S2"), F.lit("S4"), F.lit("guest"))))
    return L.new_speaker_ids(s, have, "seq")


@query(None)
def moved_paragraphs(spark, d):
    """E16"""
    p = W.paragraphs(V.segments(spark, d))
    moves = V.segments(spark, d).where("seq % 4 < 2").select("note_id", "seq", F.lit("S7").alias("target"))
    return L.moved_paragraphs(p.select("note_id", "paragraph", "seqs"), moves)


@query("""SELECT o_orderkey AS id, f AS "from", t AS "to" FROM (SELECT o_orderkey, ['idle', 'running', 'suggested', 'failed'][CAST(o_orderkey % 4 AS INT) + 1] AS f, ['running', 'suggested', 'applied'][CAST(o_orderkey % 3 AS INT) + 1] AS t FROM orders) WHERE (f, t) IN (('idle', 'running'), ('running', 'suggested'), ('suggested', 'applied'), ('failed', 'running'))""")
def legal_steps(spark, d):
    """E20, E21"""
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    i = F.col("o_orderkey")
    steps = V.table(spark, d, "orders").select(i.alias("id"), pick(("idle", "running", "suggested", "failed"), i % 4).alias("from"), pick(("running", "suggested", "applied"), i % 3).alias("to"))
    return L.legal_steps(steps).select("id", "from", "to")


@query("SELECT conv_id, sha256(string_agg(CAST(turn AS VARCHAR), ',' ORDER BY CAST(turn AS VARCHAR)) || chr(0) || 'p' || chr(0) || 'm' || chr(0) || '1') AS token FROM conversations GROUP BY 1")
def consent_tokens(spark, d):
    """E22"""
    g = V.table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.col("turn").cast("string")).alias("x"))
    return g.select("conv_id", L.consent_token(F.col("x"), F.lit("p"), F.lit("m"), F.lit("1")).alias("token"))


@query("""WITH j AS (SELECT event_id AS id, ts, value > 400 AS undo_open FROM events), n AS (SELECT * FROM j ORDER BY ts DESC, id DESC LIMIT 50) SELECT id FROM n UNION SELECT id FROM j WHERE undo_open""")
def kept_journal(spark, d):
    """O11"""
    return L.keep_last(V.table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("at"), (F.col("value") > 400).alias("undo_open"))).select("id")


@query("""WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS i, l_discount * 20 AS c, l_shipdate AS f, CASE WHEN l_linenumber = 2 THEN l_shipdate ELSE l_shipdate + INTERVAL 1 DAY END AS t, l_linenumber AS n FROM lineitem)
SELECT i AS relation_index, 'confidence' AS field, 'outside 0 to 1' AS message FROM r WHERE c > 1 UNION ALL SELECT i, 'valid_to', 'not after valid_from' FROM r WHERE f >= t UNION ALL SELECT i, 'label', 'custom predicate without label' FROM r WHERE n = 3
UNION ALL SELECT i, 'object', 'unknown entity' FROM r WHERE n = 4 UNION ALL SELECT i, 'evidence', 'no evidence' FROM r WHERE n = 5""")
def contract_issues(spark, d):
    """Lines as written-back relations with known faults."""
    n = F.col("l_linenumber")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    r = V.table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + n).alias("relation_index"), F.lit("ALMOND").alias("subject"), F.when(n == 4, "nobody").otherwise("Birch").alias("object"), F.when(n == 3, "custom").otherwise("uses").alias("predicate"), F.lit(None).cast("string").alias("label"), (F.col("l_discount") * 20).alias("confidence"), stamp("l_shipdate").alias("valid_from"), stamp(F.when(n == 2, F.col("l_shipdate")).otherwise(F.col("l_shipdate") + F.expr("interval 1 day"))).alias("valid_to"), F.when(n != 5, F.array(F.lit("q"))).alias("quotes"))
    return L.contract_issues(r, spark.createDataFrame([("Almond",), ("birch",)], "name string"))
