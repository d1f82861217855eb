"""Queries of the knowledge graph."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from talkgrid.functions import timefn as D
from talkgrid.operators import graph as G
from talkgrid.plans import views as V
from talkgrid.plans.registry import query

_CO = "co AS (SELECT x.entity_id AS a, y.entity_id AS b, count(*) AS weight FROM ne x JOIN ne y ON x.note_id = y.note_id AND x.entity_id < y.entity_id GROUP BY 1, 2)"
_PRED = "['participates_in', 'responsible_for', 'belongs_to', 'uses', 'depends_on', 'produces', 'assigned_to', 'occurs_at', 'custom']"
_ORIG = "['model', 'confirmed', 'manual', 'user_assertion']"
#: Relations with a predicate, an origin and a status that follow from their ids.
_REL = f"""{V.REL}, full_rel AS (SELECT *, {_PRED}[CAST((subject_id + object_id) % 9 AS INT) + 1] AS predicate, {_ORIG}[CAST(object_id % 4 AS INT) + 1] AS origin,
CASE WHEN valid_to <= TIMESTAMP '1997-01-01' THEN 'historical' ELSE 'current' END AS status FROM rel)"""


def _relations(spark, d):
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    r = V.relations(spark, d)
    return r.withColumns({"predicate": pick((*G.CORE_PREDICATES, "custom"), (F.col("subject_id") + F.col("object_id")) % 9), "origin": pick(G.ORIGINS, F.col("object_id") % 4), "status": D.status_as_of(F.col("valid_to"), "1997-01-01T00:00:00Z")})


@query(f"WITH {V.NE}, {_CO} SELECT a, b, weight FROM co WHERE a IN (SELECT p_partkey FROM part) AND b IN (SELECT p_partkey FROM part) ORDER BY weight DESC, a, b")
def entity_overview(spark, d):
    """Co-occurrence edges between live entities, heaviest first."""
    edges = G.cooccurrence(G.mention_counts(V.mentions(spark, d)))
    return G.live_edges(edges, V.entities(spark, d)).select("a", "b", "weight").orderBy(F.desc("weight"), "a", "b")


@query(f"WITH {V.NE}, {V.ENT} SELECT id, name, count(DISTINCT note_id) AS note_count, CAST(coalesce(sum(mention_count), 0) AS BIGINT) AS mention_total FROM ent LEFT JOIN ne ON id = entity_id GROUP BY 1, 2")
def entity_counts(spark, d):
    """A01, J01"""
    return G.entity_counts(V.entities(spark, d), V.note_entities(spark, d)).select("id", "name", "note_count", "mention_total")


@query(f"WITH {V.NE}, {V.ENT} SELECT id, count(DISTINCT note_id) AS note_count FROM ent JOIN ne ON id = entity_id GROUP BY 1")
def entity_counts_used(spark, d):
    """J02"""
    return G.entity_counts(V.entities(spark, d), V.note_entities(spark, d), orphans=False).select("id", "note_count")


@query(f"WITH {V.NE} SELECT note_id, count(DISTINCT entity_id) AS entities, CAST(sum(mention_count) AS BIGINT) AS mentions FROM ne GROUP BY 1")
def note_sizes(spark, d):
    """A02"""
    return G.note_sizes(V.note_entities(spark, d))


@query(f"WITH {V.NE} SELECT * FROM ne")
def mention_counts(spark, d):
    """A03, K08"""
    return G.mention_counts(V.mentions(spark, d))


@query(f"WITH {V.NE}, {_CO} SELECT a, b, weight AS shared FROM co ORDER BY shared DESC, a, b")
def cooccurrence(spark, d):
    """J05, J06"""
    return G.cooccurrence(V.note_entities(spark, d)).withColumnRenamed("weight", "shared").orderBy(F.desc("shared"), "a", "b")


@query(f"WITH {V.NE} SELECT x.note_id AS a, y.note_id AS b, count(DISTINCT x.entity_id) AS shared FROM ne x JOIN ne y ON x.entity_id = y.entity_id AND x.note_id < y.note_id GROUP BY 1, 2")
def note_overlaps(spark, d):
    """J07"""
    return G.note_overlaps(V.note_entities(spark, d))


@query(f"WITH {V.NE} SELECT y.note_id, count(*) AS shared FROM ne x JOIN ne y USING (entity_id) WHERE x.note_id = 1 AND y.note_id <> 1 GROUP BY 1 ORDER BY shared DESC, y.note_id")
def related_notes(spark, d):
    """J08"""
    return G.related_notes(V.note_entities(spark, d), 1)


@query(f"WITH {V.NE} SELECT note_id FROM ne WHERE entity_id = 1 INTERSECT SELECT note_id FROM ne WHERE entity_id = 2")
def shared_notes(spark, d):
    """J09, U06"""
    return G.shared_notes(V.note_entities(spark, d), 1, 2)


@query(f"WITH {V.NE}, {V.ENT} SELECT id, name FROM ent WHERE id IN (SELECT entity_id FROM ne WHERE note_id = 1) AND id IN (SELECT entity_id FROM ne WHERE note_id = 2) ORDER BY name, id")
def shared_entities(spark, d):
    """J10"""
    return G.shared_entities(V.entities(spark, d), V.note_entities(spark, d), 1, 2).select("id", "name")


@query(f"WITH {_REL}, {V.ENT}, k AS (SELECT s_suppkey AS id, 'supplier' AS kind FROM supplier) SELECT subject_id, object_id, k.kind AS subject_kind, ent.kind AS object_kind, evidence_count FROM full_rel JOIN k ON subject_id = k.id JOIN ent ON object_id = ent.id")
def relation_kinds(spark, d):
    """J03, J04"""
    nodes = V.entities(spark, d).select("id", "kind")
    sup = V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("subject_id"), F.lit("supplier").alias("subject_kind"))
    return _relations(spark, d).join(sup, "subject_id").join(nodes.select(F.col("id").alias("object_id"), F.col("kind").alias("object_kind")), "object_id").select("subject_id", "object_id", "subject_kind", "object_kind", "evidence_count")


@query(f"""WITH {_REL} SELECT subject_id, object_id, predicate, status FROM full_rel WHERE status = 'current' AND predicate IN ('uses', 'assigned_to', 'custom') AND (valid_to IS NULL OR valid_to >= TIMESTAMP '1995-06-01') AND (valid_from IS NULL OR valid_from <= TIMESTAMP '1998-01-01')""")
def semantic_edges(spark, d):
    """F03, F06, F11, D02, D07"""
    e = G.filter_edges(_relations(spark, d), ["current"], ["uses", "assigned_to", "custom"], None, "1995-06-01", "1998-01-01")
    return e.select("subject_id", "object_id", "predicate", "status")


@query(f"WITH {_REL}, {V.ENT} SELECT id, name FROM ent WHERE id IN (SELECT object_id FROM full_rel WHERE predicate = 'uses' AND confidence >= 0.96) OR id IN (SELECT subject_id FROM full_rel WHERE predicate = 'uses' AND confidence >= 0.96)")
def admitted_nodes(spark, d):
    """F07"""
    return G.admitted_nodes(V.entities(spark, d), _relations(spark, d).where("predicate = 'uses' and confidence >= 0.96")).select("id", "name")


@query(f"WITH {_REL}, {V.NE}, {_CO}, sem AS (SELECT subject_id AS a, object_id AS b, 'semantic' AS layer, evidence_count AS weight FROM full_rel WHERE confidence >= 0.99) SELECT * FROM sem UNION ALL SELECT a, b, 'cooccurrence', weight FROM co WHERE weight > 1 OR NOT EXISTS (SELECT 1 FROM sem)")
def edge_layers(spark, d):
    """Both layers; all co-occurrence edges where there is no semantic one."""
    sem = _relations(spark, d).where("confidence >= 0.99").select(F.col("subject_id").alias("a"), F.col("object_id").alias("b"), F.lit("semantic").alias("layer"), F.col("evidence_count").alias("weight"))
    some = sem.agg(F.count(F.lit(1)).alias("n"))
    co = G.cooccurrence(V.note_entities(spark, d)).crossJoin(F.broadcast(some)).where("weight > 1 or n = 0")  # one row
    return sem.unionByName(co.select("a", "b", F.lit("cooccurrence").alias("layer"), "weight"))


@query(f"""WITH {_REL} SELECT x.subject_id, x.predicate, x.object_id AS l_object_id, y.object_id AS r_object_id FROM full_rel x JOIN full_rel y ON x.subject_id = y.subject_id AND x.predicate = y.predicate AND x.object_id < y.object_id
WHERE x.predicate IN ('responsible_for', 'assigned_to') AND x.status = 'current' AND y.status = 'current' AND (x.valid_from IS NULL OR y.valid_to IS NULL OR x.valid_from < y.valid_to) AND (y.valid_from IS NULL OR x.valid_to IS NULL OR y.valid_from < x.valid_to)""")
def temporal_conflicts(spark, d):
    """J28, M05"""
    return G.conflicts(_relations(spark, d)).select("subject_id", "predicate", "l_object_id", "r_object_id")


@query(f"""WITH {_REL} SELECT subject_id, object_id, CASE WHEN confidence < 0.5 THEN 'raw' WHEN (confidence < 0.8 OR predicate = 'custom' OR evidence_count = 0 OR subject_id % 11 = 0) AND NOT (origin <> 'model' AND NOT subject_id % 11 = 0) THEN 'pending' ELSE 'published' END AS tier FROM full_rel""")
def publish_tiers(spark, d):
    """F14, F15, F16"""
    r = _relations(spark, d)
    return r.select("subject_id", "object_id", G.publish_tier(F.col("confidence"), F.col("predicate"), F.col("evidence_count"), F.col("origin"), F.col("subject_id") % 11 == 0).alias("tier"))


@query("""SELECT l_suppkey AS subject_id, l_returnflag AS predicate, l_partkey AS object_id, max(l_discount) AS confidence, count(DISTINCT l_orderkey) AS notes, count(DISTINCT CAST(l_orderkey AS VARCHAR) || ':' || CAST(l_linenumber AS VARCHAR)) AS evidence, CASE max(l_linenumber % 4) WHEN 0 THEN 'model' WHEN 1 THEN 'confirmed' WHEN 2 THEN 'manual' ELSE 'user_assertion' END AS origin FROM lineitem GROUP BY 1, 2, 3""")
def relation_merge(spark, d):
    """A06, A07, A08, U03, U04"""
    t = V.table(spark, d, "lineitem")
    origin = F.element_at(F.array(*map(F.lit, G.ORIGINS)), (F.col("l_linenumber") % 4 + 1).cast("int"))
    r = t.select(F.col("l_suppkey").alias("subject_id"), F.col("l_returnflag").alias("predicate"), F.col("l_partkey").alias("object_id"), F.col("l_discount").alias("confidence"), origin.alias("origin"), F.col("l_orderkey").alias("note_id"), F.concat_ws(":", "l_orderkey", "l_linenumber").alias("evidence_id"))
    m = G.merge_relations(r)
    return m.select("subject_id", "predicate", "object_id", "confidence", F.size("note_ids").cast("long").alias("notes"), F.size("evidence_ids").cast("long").alias("evidence"), "origin")


@query(f"""WITH {_REL}, e AS (SELECT CAST(subject_id AS VARCHAR) || '-' || CAST(object_id AS VARCHAR) AS id, subject_id + 1000000 AS s, object_id AS o, confidence, evidence_count AS n FROM full_rel),
b AS (SELECT id, s AS node, o AS other, confidence, n FROM e UNION ALL SELECT id, o, s, confidence, n FROM e), one AS (SELECT *, row_number() OVER (PARTITION BY node, other ORDER BY confidence DESC, n DESC, id) AS k FROM b),
t AS (SELECT node, other, row_number() OVER (PARTITION BY node ORDER BY confidence DESC, n DESC, id) AS n FROM one WHERE k = 1) SELECT node, other, n FROM t WHERE n <= 5""")
def top_neighbours(spark, d):
    """O05, O12"""
    e = _relations(spark, d).select(F.concat_ws("-", "subject_id", "object_id").alias("id"), (F.col("subject_id") + 1_000_000).alias("subject_id"), "object_id", "confidence", F.col("evidence_count").alias("note_count"))
    return G.top_neighbours(e).select("node", "other", F.col("n").cast("long").alias("n"))


@query("""SELECT x.l_orderkey AS note_id, x.l_linenumber AS evidence, y.l_linenumber AS mention FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_linenumber <= y.l_linenumber AND y.l_linenumber + 1 <= x.l_linenumber + 3""")
def mention_containment(spark, d):
    """Spans of three lines hold the mentions of one."""
    t = V.table(spark, d, "lineitem").withColumn("paragraph_index", F.lit(0))
    ev = t.select(F.col("l_orderkey").alias("note_id"), "paragraph_index", F.col("l_linenumber").alias("evidence"), F.col("l_linenumber").alias("e_start"), (F.col("l_linenumber") + 3).alias("e_end"))
    me = t.select(F.col("l_orderkey").alias("note_id"), "paragraph_index", F.col("l_linenumber").alias("mention"), F.col("l_linenumber").alias("m_start"), (F.col("l_linenumber") + 1).alias("m_end"))
    return G.contained_mentions(me, ev).select("note_id", "evidence", "mention")


@query("""WITH k AS (SELECT DISTINCT p_partkey AS id, p_brand AS kind, lower(trim(x)) AS k FROM (SELECT p_partkey, p_brand, unnest([p_name, p_type]) AS x FROM part) WHERE trim(x) <> '') SELECT DISTINCT x.id, y.id AS match_id FROM k x JOIN k y USING (kind, k)""")
def alias_matches(spark, d):
    """All entities are confirmed ones."""
    e = V.entities(spark, d)
    return G.alias_matches(e, e)



@query("""WITH RECURSIVE r AS (SELECT p_partkey AS old_id, p_partkey // 2 AS new_id FROM part WHERE p_partkey % 3 = 0 AND p_partkey // 2 > 0), w AS (SELECT p_partkey AS id, p_partkey AS cur, 0 AS hop FROM part UNION ALL SELECT w.id, r.new_id, hop + 1 FROM w JOIN r ON w.cur = r.old_id WHERE hop < 9)
SELECT id, CASE WHEN max(hop) <= 8 THEN arg_max(cur, hop) END AS target FROM w GROUP BY 1""")
def redirect_targets(spark, d):
    """J13, J14, J15"""
    e = V.entities(spark, d).select("id")
    half = F.expr("id div 2")
    return G.follow_redirects(e, e.where((F.col("id") % 3 == 0) & (half > 0)).select(F.col("id").alias("old_id"), half.alias("new_id")))


@query(f"WITH {_REL} SELECT subject_id, object_id, CAST(round(1e6 * CASE WHEN origin = 'model' THEN 1.2 + (1 - least(1.0, greatest(0.0, confidence))) ELSE 1.0 END) AS BIGINT) AS cost FROM full_rel")
def edge_costs(spark, d):
    """M06, M07"""
    return _relations(spark, d).select("subject_id", "object_id", G.edge_cost(F.col("origin"), F.col("confidence")).alias("cost"))


@query(f"WITH {V.NE}, e AS (SELECT note_id, list(entity_id ORDER BY entity_id) AS ids FROM ne GROUP BY 1) SELECT note_id, array_to_string(ids, ',') AS ids, len(ids) AS n FROM e")
def note_entity_lists(spark, d):
    """A note's entities, sorted."""
    return G.entity_lists(V.note_entities(spark, d)).select("note_id", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), F.size("ids").cast("long").alias("n"))


@query("SELECT kind, n FROM (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'identity' WHEN '2-HIGH' THEN 'merge' ELSE 'relation' END AS kind, count(*) AS n FROM orders WHERE o_orderkey % 10 <> 0 GROUP BY 1)")
def pending_groups(spark, d):
    """Orders stand for pending items, every tenth is postponed."""
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "identity").when(F.col("o_orderpriority") == "2-HIGH", "merge").otherwise("relation")
    o = V.table(spark, d, "orders").select(kind.alias("kind"), F.col("o_orderkey").alias("id"))
    return G.pending_groups(o, o.where("id % 10 = 0"))


@query("""SELECT (SELECT count(*) FROM part) AS entities, (SELECT count(*) FROM lineitem) AS mentions, (SELECT count(*) FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)) AS relations""")
def index_statistics(spark, d):
    """A28"""
    m = V.table(spark, d, "lineitem")
    return G.index_statistics(entities=V.entities(spark, d), mentions=m, relations=m.select("l_suppkey", "l_partkey").distinct())


@query(f"""WITH {_REL} SELECT subject_id, object_id FROM full_rel r WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = r.subject_id AND l.l_partkey = r.object_id AND l.l_quantity > 10) AND origin <> 'user_assertion'""")
def unproven_relations(spark, d):
    """Relations without evidence, left to the user's own ones."""
    proof = V.table(spark, d, "lineitem").where("l_quantity > 10").select(F.col("l_suppkey").alias("subject_id"), F.col("l_partkey").alias("object_id"))
    return _relations(spark, d).where("origin <> 'user_assertion'").join(proof, ["subject_id", "object_id"], "left_anti").select("subject_id", "object_id")


@query("""WITH f AS (SELECT l_partkey AS id, l_orderkey AS note_id, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem) SELECT id, note_id FROM f WHERE n = 1""")
def first_evidence(spark, d):
    """The first document's evidence of each id."""
    t = V.table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("note_id"), "l_linenumber")
    return G.first_evidence(t, ["note_id", "l_linenumber"]).select("id", "note_id")


@query("SELECT l_orderkey AS note_id, l_linenumber AS paragraph, l_partkey AS entity_id FROM lineitem WHERE l_partkey = 7 ORDER BY note_id, paragraph")
def entity_mentions(spark, d):
    """Mentions of entity 7."""
    m = V.mentions(spark, d).select("note_id", F.col("paragraph_index").alias("paragraph"), "entity_id")
    return G.entity_mentions(m, 7, ["note_id", "paragraph"])


@query(f"""WITH RECURSIVE {V.NE}, {_CO}, b AS (SELECT a, b, weight FROM co UNION ALL SELECT b, a, weight FROM co),
h1 AS (SELECT b AS id FROM b WHERE a = 1 QUALIFY row_number() OVER (ORDER BY weight DESC, b) <= 8),
h2 AS (SELECT DISTINCT id FROM (SELECT b.b AS id, row_number() OVER (PARTITION BY b.a ORDER BY weight DESC, b.b) AS n FROM b JOIN h1 ON b.a = h1.id WHERE b.b <> 1 AND b.b NOT IN (SELECT id FROM h1)) WHERE n <= 8)
SELECT 1::BIGINT AS id, 0 AS hop UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2""")
def two_hops(spark, d):
    """G08"""
    seed = spark.range(1, 2)
    return G.k_hop(G.cooccurrence(V.note_entities(spark, d)), seed, 2)



@query(None)
def components(spark, d):
    """Components of the graph of all lines, the ones with the most edges first."""
    r = V.relations(spark, d).select((F.col("subject_id") + 1_000_000).alias("a"), F.col("object_id").alias("b"), "confidence")
    t = V.table(spark, d, "lineitem")
    ends = t.select((F.col("l_suppkey") + 1_000_000).alias("id"), "l_orderkey").union(t.select("l_partkey", "l_orderkey"))
    nodes = ends.groupBy("id").agg(F.countDistinct("l_orderkey").alias("note_count"), F.count(F.lit(1)).alias("mention_total"))
    return G.ranked_components(r, nodes).orderBy(F.desc("edges"), F.desc("confidence"), "root", "id")


@query(None)
def shortest_path(spark, d):
    """From entity 1 to entity 42 over the co-occurrence graph."""
    co = G.cooccurrence(V.note_entities(spark, d))
    e = co.select(F.concat_ws("~", "a", "b").alias("id"), "a", "b", G.edge_cost(F.lit("cooccurrence"), F.lit(1.0)).alias("cost"), F.least(F.lit(1.0), F.col("weight") / 10).alias("confidence"))
    return G.shortest_path(e, 1, 42, 4)


@query(f"WITH {V.NE}, {V.ENT}, hit AS (SELECT id FROM ent WHERE contains(lower(name), '7') OR contains(lower(alias), '7')) SELECT id FROM hit UNION SELECT y.entity_id FROM ne x JOIN hit ON x.entity_id = hit.id JOIN ne y ON x.note_id = y.note_id")
def entity_search(spark, d):
    """entities whose name or alias has the text, with their neighbours."""
    e = V.entities(spark, d).select("id", "name", F.array("alias").alias("aliases"))
    return G.entity_search(e, V.note_entities(spark, d), "7")


@query("""WITH o AS (SELECT o_orderkey AS i, CASE WHEN o_orderkey % 5 = 0 AND o_orderkey > 10 THEN 'undo' ELSE 'edit' END AS kind, CASE WHEN o_orderkey % 5 = 0 AND o_orderkey > 10 THEN o_orderkey - 5 - o_orderkey % 2 END AS target FROM orders),
off1 AS (SELECT i FROM o) SELECT i AS op_index, kind FROM o WHERE kind = 'edit' AND i NOT IN (SELECT target FROM o WHERE target IS NOT NULL AND target % 5 <> 0 AND i NOT IN (SELECT target FROM o WHERE target IS NOT NULL))""".replace("off1 AS (SELECT i FROM o) ", "off1 AS (SELECT i FROM o) "))
def ledger_plain_edits(spark, d):
    """Edits that no active undo has turned off, where undos are not themselves undone."""
    i = F.col("o_orderkey")
    undo = (i % 5 == 0) & (i > 10)
    ops = V.table(spark, d, "orders").select(i.alias("op_index"), i.cast("string").alias("id"), F.when(undo, "undo").otherwise("edit").alias("kind"), F.when(undo, (i - 5 - i % 2).cast("string")).alias("target"))
    return G.active_operations(ops).where("active and kind = 'edit'").select("op_index", "kind")


@query(f"WITH {V.NE} SELECT note_id, entity_id, mention_count FROM ne WHERE note_id % 2 <> 0 UNION ALL SELECT note_id, entity_id, CASE WHEN entity_id % 5 = 0 THEN 2 ELSE 1 END FROM ne WHERE note_id % 2 = 0 AND entity_id % 3 <> 0")
def note_upsert(spark, d):
    """Notes with an even number are put in anew, without their entities of every third id."""
    ne = V.note_entities(spark, d)
    again = ne.where("note_id % 2 = 0").select("note_id", F.when(F.col("entity_id") % 3 != 0, F.col("entity_id")).alias("entity_id"), F.lit(1).cast("long").alias("mention_count"))
    return G.upsert_notes(ne, again.unionByName(again.where("entity_id % 5 = 0")))


@query(f"WITH {V.NE}, {V.ENT} SELECT CASE WHEN id = 7 THEN 8 ELSE id END AS id, list_sort(list_distinct(list_filter(CASE WHEN id = 8 THEN [alias, (SELECT alias FROM ent WHERE id = 7), (SELECT name FROM ent WHERE id = 7)] ELSE [alias] END, lambda a: id <> 8 OR a <> name))) AS aliases, (SELECT CAST(coalesce(sum(mention_count), 0) AS BIGINT) FROM ne WHERE entity_id = ent.id OR (ent.id = 8 AND entity_id = 7)) AS mentions FROM ent WHERE id <> 7")
def entity_rename(spark, d):
    """Entity 7 gets a name that leads to entity 8's id, so the two become one."""
    e = V.entities(spark, d).select("id", "kind", "name", F.array("alias").alias("aliases"))
    none = spark.createDataFrame([], "old_id long, new_id long")
    entities, counts, _ = G.rename_with_merge(e, V.note_entities(spark, d), none, 7, 8, "Eight")
    per = counts.groupBy(F.col("entity_id").alias("id")).agg(F.sum("mention_count").alias("mentions"))
    return entities.join(per, "id", "left").select("id", F.array_sort("aliases").alias("aliases"), F.coalesce("mentions", F.lit(0)).cast("long").alias("mentions"))


@query("""WITH e AS (SELECT p_partkey AS id, p_brand AS kind, lower(trim(p_name)) AS k FROM part), n AS (SELECT kind, k, count(*) AS n, min(id) AS id FROM e WHERE id % 3 <> 0 GROUP BY 1, 2)
SELECT e.id AS entity, CASE WHEN e.id % 7 = 0 THEN 'binding' WHEN n.n IS NULL THEN 'new' WHEN n.n > 1 THEN 'pending' ELSE 'registry' END AS how, CASE WHEN e.id % 7 = 0 THEN CAST(e.id AS VARCHAR) WHEN n.n = 1 THEN CAST(n.id AS VARCHAR) END AS target FROM e LEFT JOIN n USING (kind, k)""")
def name_resolution(spark, d):
    """A note's entities against those of which the id is no multiple of three; every seventh is bound."""
    e = V.entities(spark, d)
    local = e.select(F.lit(1).alias("note_id"), F.col("id").alias("entity"), "kind", "name", F.lit(None).cast("string").alias("person_id"))
    text = F.col("id").cast("string")
    registry = e.where("id % 3 <> 0").select(text.alias("id"), "kind", "name", F.expr("cast(array() as array<string>)").alias("aliases"))
    bindings = e.where("id % 7 = 0").select(F.lit(1).alias("note_id"), F.col("id").alias("entity"), text.alias("target"))
    none = lambda schema: spark.createDataFrame([], schema)
    got = G.resolve_entities(local, bindings, none("old_id string, new_id string"), none("id string"), registry, none("legacy_id string, id string"))
    return got.select("entity", "how", F.when(F.col("how") != "new", F.col("target")).alias("target"))


@query("""WITH p AS (SELECT lower(trim(c_name)) AS k, min(c_custkey) AS id FROM customer GROUP BY 1) SELECT c_custkey AS entity, CASE WHEN c_custkey % 2 = 0 THEN CAST(p.id AS VARCHAR) ELSE 'e:' || lower(trim(c_name)) END AS global_id FROM customer JOIN p ON lower(trim(c_name)) = p.k""")
def older_name_resolution(spark, d):
    """Names of persons against the library, other kinds by name."""
    c = V.table(spark, d, "customer")
    local = c.select(F.lit(1).alias("note_id"), F.col("c_custkey").alias("entity"), F.when(F.col("c_custkey") % 2 == 0, "person").otherwise("org").alias("kind"), F.col("c_name").alias("name"))
    people = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.expr("cast(array() as array<string>)").alias("aliases"))
    return G.resolve_names(local, people).select("entity", "global_id")


@query(f"WITH {V.NE}, {V.ENT} SELECT 'notes' AS part, CAST(note_id AS VARCHAR) AS item, mention_count AS n FROM ne WHERE entity_id = 5 UNION ALL SELECT 'with', CAST(y.entity_id AS VARCHAR), count(*) FROM ne x JOIN ne y ON x.note_id = y.note_id WHERE x.entity_id = 5 AND y.entity_id <> 5 GROUP BY 2 UNION ALL SELECT 'name', name, (SELECT count(*) FROM ne WHERE entity_id = 5) FROM ent WHERE id = 5")
def entity_bundle(spark, d):
    """J11, G02"""
    head, notes, others = G.entity_detail(V.entities(spark, d), V.note_entities(spark, d), 5)
    row = lambda df, part, item, n: df.select(F.lit(part).alias("part"), F.col(item).cast("string").alias("item"), F.col(n).cast("long").alias("n"))
    return row(notes, "notes", "note_id", "mention_count").unionByName(row(others, "with", "entity_id", "weight")).unionByName(row(head, "name", "name", "note_count"))


@query(f"WITH {_REL}, r AS (SELECT CASE WHEN subject_id = 0 THEN 0 ELSE subject_id // (subject_id & (-subject_id)) END + 1000000 AS s, object_id AS o FROM full_rel) SELECT s AS subject_id, o AS object_id, count(*) AS n FROM r WHERE s = 1000003 GROUP BY 1, 2")
def entity_edges(spark, d):
    """Edges at a supplier after redirects, of which every even one has gone to its half. Suppliers have negative ids here, so that
    none is also a part's."""
    own = lambda k: -1 - k
    e = _relations(spark, d).select(own(F.col("subject_id")).alias("subject_id"), "object_id")
    halves = F.expr("transform(sequence(0, 62), i -> shiftright(-1 - subject_id, i))")
    k = e.select("subject_id").distinct().select(F.explode(halves).alias("k")).where("k <> 0 and k % 2 = 0").distinct()
    to = k.select(own(F.col("k")).alias("old_id"), own(F.expr("k div 2")).alias("new_id"))
    at = G.incident_edges(e, to, -4).where("subject_id = -4")
    return at.groupBy((own(F.col("subject_id")) + 1_000_000).alias("subject_id"), "object_id").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id AS id FROM events WHERE (json_extract_string(props, '$.k') IS NULL OR json_extract_string(props, '$.k') IN ('1', '2', '3'))""")
def pending_filter(spark, d):
    """A predicate rejects only payloads that have the field."""
    p = V.table(spark, d, "events").select(F.col("event_type").alias("kind"), F.col("event_id").alias("id"), F.regexp_replace("props", '"k"', '"predicate"').alias("payload"))
    return G.pending_review(p, predicates=["1", "2", "3"]).select("id")
