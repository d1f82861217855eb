"""Knowledge graph: counts, co-occurrence, filters, conflicts, tiers, merging, resolution and paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkgrid.functions import text as T
from talkgrid.functions import timefn as D

#: The predicates of the core vocabulary.
CORE_PREDICATES = ("participates_in", "responsible_for", "belongs_to", "uses", "depends_on", "produces", "assigned_to", "occurs_at")
#: Predicates that hold for one object at a time.
EXCLUSIVE = ("responsible_for", "assigned_to")
#: Origins by rank, the strongest last.
ORIGINS = ("model", "confirmed", "manual", "user_assertion")


def mention_counts(mentions: DataFrame) -> DataFrame:
    return mentions.groupBy("note_id", "entity_id").agg(F.count(F.lit(1)).alias("mention_count"))


def entity_counts(entities: DataFrame, note_entities: DataFrame, orphans: bool = True) -> DataFrame:
    """Distinct notes and mentions of each entity; entities without notes only with ``orphans``."""
    per = note_entities.groupBy("entity_id").agg(F.countDistinct("note_id").alias("note_count"), F.sum("mention_count").alias("mention_total"))
    got = entities.join(per, F.col("id") == F.col("entity_id"), "left" if orphans else "inner").drop("entity_id")
    return got.fillna(0, ["note_count", "mention_total"])


def cooccurrence(note_entities: DataFrame) -> DataFrame:
    """Pairs of entities by shared notes. The self-join is by note, so its size follows entities per note."""
    ne = note_entities.select("note_id", "entity_id").distinct()
    right = ne.withColumnRenamed("entity_id", "b")
    return ne.withColumnRenamed("entity_id", "a").join(right, "note_id").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight"))


def note_overlaps(note_entities: DataFrame) -> DataFrame:
    """Pairs of notes by shared entities."""
    ne = note_entities.select("note_id", "entity_id").distinct()
    return ne.withColumnRenamed("note_id", "a").join(ne.withColumnRenamed("note_id", "b"), "entity_id").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


def related_notes(note_entities: DataFrame, note_id) -> DataFrame:
    """Notes that share entities with one note; its own entities, being one note's, are broadcast by size."""
    own = note_entities.where(F.col("note_id") == note_id).select("entity_id")
    return note_entities.where(F.col("note_id") != note_id).join(own, "entity_id").groupBy("note_id").agg(F.count(F.lit(1)).alias("shared")).orderBy(F.desc("shared"), "note_id")


def note_sizes(note_entities: DataFrame) -> DataFrame:
    """Distinct entities and mentions of each note."""
    return note_entities.groupBy("note_id").agg(F.countDistinct("entity_id").alias("entities"), F.sum("mention_count").alias("mentions"))


def shared_entities(entities: DataFrame, note_entities: DataFrame, a, b) -> DataFrame:
    """Entities of which both notes have mentions, by name and id."""
    of = lambda n: note_entities.where(F.col("note_id") == n).select(F.col("entity_id").alias("id"))
    return entities.join(of(a), "id", "left_semi").join(of(b), "id", "left_semi").orderBy("name", "id")


def entity_detail(entities: DataFrame, note_entities: DataFrame, entity) -> tuple[DataFrame, DataFrame, DataFrame]:
    """An entity's row with its counts, its notes, and the entities that it shares notes with, heaviest first."""
    mine = note_entities.where(F.col("entity_id") == entity)
    head = entity_counts(entities.where(F.col("id") == entity), mine)
    others = note_entities.where(F.col("entity_id") != entity).join(mine.select("note_id").distinct(), "note_id").groupBy("entity_id").agg(F.countDistinct("note_id").alias("weight"))
    return head, mine.select("note_id", "mention_count").orderBy("note_id"), others.orderBy(F.desc("weight"), "entity_id")


def incident_edges(edges: DataFrame, redirects: DataFrame, entity) -> DataFrame:
    """Edges at an entity, both their ends after redirects through chains of any length; edges that become loops are left out.
    An end that redirects lead round in a ring stays as it is."""
    to = chain_ends(redirects)
    j = edges
    for c in ("subject_id", "object_id"):
        j = j.join(to.select(F.col("old_id").alias(c), F.col("target").alias(f"_{c}")), c, "left").withColumn(f"_{c}", F.coalesce(f"_{c}", c))
    j = j.where(((F.col("_subject_id") == entity) | (F.col("_object_id") == entity)) & ~F.col("_subject_id").eqNullSafe(F.col("_object_id")))
    return j.withColumns({"subject_id": F.col("_subject_id"), "object_id": F.col("_object_id")}).drop("_subject_id", "_object_id")


def entity_mentions(mentions: DataFrame, entity, order: list[str]) -> DataFrame:
    """An entity's mentions in order of note and place."""
    return mentions.where(F.col("entity_id") == entity).orderBy(*order)


def entity_lists(note_entities: DataFrame) -> DataFrame:
    """(note_id, ids): a note's entities, each once, sorted."""
    return note_entities.groupBy("note_id").agg(F.array_sort(F.collect_set("entity_id")).alias("ids"))


def entity_search(entities: DataFrame, note_entities: DataFrame, query: str) -> DataFrame:
    """Ids of entities whose name or one of whose aliases holds the text, whatever its case, and of those that share a
    note with them. entities: id, name, aliases (array)."""
    q = F.lit(query.strip().lower())
    has = F.contains(F.lower("name"), q) | F.exists(F.coalesce("aliases", F.expr("cast(array() as array<string>)")), lambda a: F.contains(F.lower(a), q))
    hit = entities.where(has).select("id")
    notes = note_entities.join(hit.withColumnRenamed("id", "entity_id"), "entity_id", "left_semi").select("note_id").distinct()
    return hit.union(note_entities.join(notes, "note_id", "left_semi").select("entity_id")).distinct()


#: Kinds of pending items in the order in which groups are shown.
PENDING_GROUPS = ("identity", "merge", "relation", "conflict", "other")


def pending_groups(pending: DataFrame, postponed: DataFrame | None = None, order: tuple[str, ...] = PENDING_GROUPS) -> DataFrame:
    """(kind, n) of pending items without the postponed ones, in a fixed order; empty groups are left out, kinds that are
    not in the order come last."""
    left = pending if postponed is None else pending.join(postponed.select("kind", "id"), ["kind", "id"], "left_anti")
    place = F.array_position(F.array(*map(F.lit, order)), F.col("kind"))
    return left.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).orderBy(F.when(place > 0, place).otherwise(len(order) + 1), "kind")


def pending_review(pending: DataFrame, kinds: list | None = None, predicates: list | None = None, low: str | None = None, high: str | None = None) -> DataFrame:
    """Pending items (kind, id, payload as JSON) that a graph filter admits, by kind and id. Each predicate rejects only
    items whose payload has the field."""
    from talkgrid.functions.rules import first_string, tolerant

    p, keep = F.col("payload"), F.lit(True)
    if kinds:
        for paths in (("$.entity.kind", "$.kind"), ("$.subject.kind", "$.subject_kind"), ("$.object.kind", "$.object_kind")):
            value = first_string(p, *paths)
            keep = keep & tolerant(value, value.isin(*kinds))
    if predicates:
        value = first_string(p, "$.predicate.kind", "$.predicate")
        keep = keep & tolerant(value, value.isin(*predicates))
    for bound, path, fits in ((low, "$.valid_to", lambda v: v >= F.to_timestamp(F.lit(low))), (high, "$.valid_from", lambda v: v <= F.to_timestamp(F.lit(high)))):
        if bound is not None:
            value = F.try_to_timestamp(first_string(p, path, f"$.relation{path[1:]}"))
            keep = keep & tolerant(value, fits(value))
    return pending.where(keep).orderBy("kind", "id")


def index_statistics(**tables: DataFrame) -> DataFrame:
    """One row with the number of rows of each table."""
    counts = [t.agg(F.count(F.lit(1)).alias(n)) for n, t in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.crossJoin(c)  # one row each
    return out


def first_evidence(evidence: DataFrame, order: list[str]) -> DataFrame:
    """The first row of each evidence id in order of documents."""
    return evidence.groupBy("id").agg(F.min_by(F.struct(*[c for c in evidence.columns if c != "id"]), F.struct(*order)).alias("_x")).select("id", "_x.*")


def upsert_notes(note_entities: DataFrame, changed: DataFrame) -> DataFrame:
    """note_entities after the notes in ``changed`` (the same columns; a null entity_id marks a note without any) have
    been taken out and put in again; counts of one note and entity add up."""
    kept = note_entities.join(changed.select("note_id").distinct(), "note_id", "left_anti")
    new = changed.where("entity_id is not null").groupBy("note_id", "entity_id").agg(F.sum("mention_count").alias("mention_count"))
    return kept.unionByName(new.select(*note_entities.columns))


def rename_with_merge(entities: DataFrame, note_entities: DataFrame, redirects: DataFrame, old_id, new_id, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """An entity under a new id and name. Where there is one with the new id already the two become one: it keeps its name,
    aliases are united (the old name among them), counts of shared notes add up. Redirects to the old id go to the new
    one. (entities, note_entities, redirects); entities: id, name, aliases and others."""
    was = entities.where(F.col("id") == old_id)
    here = entities.where(F.col("id") == new_id)
    taken = here.agg((F.count(F.lit(1)) > 0).alias("_taken"))
    moved = was.crossJoin(F.broadcast(taken)).where("not _taken").drop("_taken").withColumns({"id": F.lit(new_id).cast(entities.schema["id"].dataType), "aliases": F.array_distinct(F.array_append("aliases", F.col("name"))), "name": F.lit(name)})
    more = was.select(F.array_append("aliases", F.col("name")).alias("_more"))
    merged = here.join(F.broadcast(more), how="left").withColumn("aliases", F.array_distinct(F.filter(F.concat("aliases", F.coalesce("_more", F.expr("cast(array() as array<string>)"))), lambda a: a != F.col("name")))).drop("_more")  # one row each
    rest = entities.where(~F.col("id").isin(old_id, new_id))
    to = lambda c: F.when(F.col(c) == old_id, F.lit(new_id)).otherwise(F.col(c))
    counts = note_entities.withColumn("entity_id", to("entity_id")).groupBy("note_id", "entity_id").agg(F.sum("mention_count").alias("mention_count"))
    step = redirects.sparkSession.createDataFrame([(old_id, new_id)], redirects.select("old_id", "new_id").schema)
    return rest.unionByName(moved).unionByName(merged.select(*entities.columns)), counts, redirects.select("old_id", to("new_id").alias("new_id")).unionByName(step).where("old_id <> new_id")


def resolve_names(local: DataFrame, people: DataFrame) -> DataFrame:
    """The older resolution: (note_id, entity, global_id, person) of each local entity (note_id, entity, kind, name). A
    person's name or alias gives the smallest person's id; anything else an id made of its name; blank names have none.
    people: id, name, aliases (array), canonical ones only."""
    key = T.name_key(F.col("name"))
    known = people.select("id", F.explode(F.array_append("aliases", F.col("name"))).alias("n")).select("id", T.name_key(F.col("n")).alias("k")).where("k <> ''").groupBy("k").agg(F.min("id").alias("person_id"))
    j = local.withColumn("k", key).where("k <> ''").join(known, "k", "left")
    hit = (F.col("kind") == "person") & F.col("person_id").isNotNull()
    return j.select("note_id", "entity", F.when(hit, F.col("person_id").cast("string")).otherwise(F.concat(F.lit("e:"), F.col("k"))).alias("global_id"), hit.alias("person"))


def resolve_entities(local: DataFrame, bindings: DataFrame, redirects: DataFrame, people: DataFrame, registry: DataFrame, legacy: DataFrame) -> DataFrame:
    """(note_id, entity, target, how, candidates): the cascade. A binding counts first, then a person's id, then the only
    registry entity of that kind with the name or alias, then the only one with a legacy id, else a new id of kind and
    name. Targets follow redirects. Where a step finds several, the entity is pending with all of them.

    local: note_id, entity, kind, name, person_id; bindings: note_id, entity, target; people: id; registry: id, kind,
    name, aliases (array); legacy: legacy_id (kind and name key joined by ':'), id.
    """
    key = F.concat_ws(":", "kind", T.name_key(F.col("name")))
    keys = registry.select("id", "kind", F.explode(F.array_append("aliases", F.col("name"))).alias("n")).select("id", F.concat_ws(":", "kind", T.name_key(F.col("n"))).alias("k")).distinct()
    several = lambda df, c: df.groupBy("k").agg(F.array_sort(F.collect_set("id")).alias(c))
    known = people.select(F.col("id").alias("person_id"), F.lit(True).alias("_person")).distinct()
    bound = bindings.groupBy("note_id", "entity").agg(F.array_sort(F.collect_set("target")).alias("_bound"))
    j = local.withColumn("k", key).join(bound, ["note_id", "entity"], "left").join(known, "person_id", "left")
    j = j.join(several(keys, "_exact"), "k", "left").join(several(legacy.select(F.col("legacy_id").alias("k"), "id"), "_legacy"), "k", "left")
    person = F.when((F.col("kind") == "person") & F.col("_person"), F.array(F.col("person_id").cast("string")))
    steps = (("binding", F.col("_bound")), ("person", person), ("registry", F.col("_exact")), ("legacy", F.col("_legacy")))
    found, how = F.coalesce(*[c for _, c in steps]), F.coalesce(*[F.when(c.isNotNull(), n) for n, c in steps])
    new = T.stable_id("kg_", F.col("kind"), T.name_key(F.col("name")))
    one = j.select("note_id", "entity", F.when(found.isNull(), new).when(F.size(found) == 1, found[0]).alias("id"), F.when(found.isNull(), "new").when(F.size(found) == 1, how).otherwise("pending").alias("how"), F.when(F.size(found) > 1, found).alias("candidates"))
    ends = follow_redirects(one.where("id is not null").select("id").distinct(), redirects)
    return one.join(ends, "id", "left").select("note_id", "entity", F.when(F.col("id").isNotNull(), F.coalesce("target", "id")).alias("target"), "how", "candidates")


def shared_notes(note_entities: DataFrame, a, b) -> DataFrame:
    of = lambda e: note_entities.where(F.col("entity_id") == e).select("note_id")
    return of(a).intersect(of(b))


def live_edges(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges of which both ends are there."""
    ids = entities.select("id")
    return edges.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")


def with_kinds(relations: DataFrame, entities: DataFrame) -> DataFrame:
    kind = lambda side: entities.select(F.col("id").alias(f"{side}_id"), F.col("kind").alias(f"{side}_kind"))
    return relations.join(kind("subject"), "subject_id").join(kind("object"), "object_id")


def filter_edges(edges: DataFrame, status: list | None = None, predicates: list | None = None, kinds: list | None = None, low: str | None = None, high: str | None = None) -> DataFrame:
    """Semantic edges by status, predicate, kinds of both ends and validity bounds; an empty list filters nothing."""
    for column, values in (("status", status), ("predicate", predicates), ("subject_kind", kinds), ("object_kind", kinds)):
        if values:
            edges = edges.where(F.col(column).isin(*values))
    return edges.where(D.in_bounds(F.col("valid_from"), F.col("valid_to"), low, high))


def admitted_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("subject_id").alias("id")).union(edges.select(F.col("object_id").alias("id")))
    return nodes.join(ends, "id", "left_semi")


def publish_tier(confidence: Column, predicate: Column, evidence: Column, origin: Column, conflict: Column) -> Column:
    """raw under 0.5; pending under 0.8, for custom predicates, without evidence or in conflict; else published.
    A human's decision publishes what is pending, except in a time conflict."""
    pending = (confidence < 0.8) | ~predicate.isin(*CORE_PREDICATES) | (evidence == 0) | conflict
    human = origin.isin(*ORIGINS[1:])
    return F.when(confidence < 0.5, "raw").when(pending & ~(human & ~conflict), "pending").otherwise("published")


def conflicts(relations: DataFrame) -> DataFrame:
    """Pairs of current exclusive relations of one subject and predicate to different objects at overlapping times."""
    cols = ("object_id", "valid_from", "valid_to")
    cur = relations.where(F.col("predicate").isin(*EXCLUSIVE) & (F.col("status") == "current"))
    left = cur.select("subject_id", "predicate", *[F.col(c).alias(f"l_{c}") for c in cols])
    right = cur.select("subject_id", "predicate", *[F.col(c).alias(f"r_{c}") for c in cols])
    both = left.join(right, ["subject_id", "predicate"]).where("l_object_id < r_object_id")
    return both.where(D.intervals_overlap(*[F.col(c) for c in ("l_valid_from", "l_valid_to", "r_valid_from", "r_valid_to")]))


def merge_relations(relations: DataFrame) -> DataFrame:
    """Relations of one key as one: largest confidence, strongest origin, all notes and evidence ids, sorted."""
    rank = F.array_position(F.array(*map(F.lit, ORIGINS)), F.col("origin"))
    keys = ["subject_id", "predicate", "object_id"]
    distinct = lambda c: F.array_sort(F.collect_set(c))
    return relations.groupBy(*keys).agg(F.max("confidence").alias("confidence"), F.max_by("origin", rank).alias("origin"), distinct("note_id").alias("note_ids"), distinct("evidence_id").alias("evidence_ids"))


def top_neighbours(edges: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` best edges of each node, after keeping the best edge to each neighbour."""
    both = edges.select("id", F.col("subject_id").alias("node"), F.col("object_id").alias("other"), "confidence", "note_count").union(edges.select("id", "object_id", "subject_id", "confidence", "note_count"))
    best = [F.desc("confidence"), F.desc("note_count"), F.col("id")]
    one = both.withColumn("n", F.row_number().over(Window.partitionBy("node", "other").orderBy(*best))).where("n = 1")
    return one.withColumn("n", F.row_number().over(Window.partitionBy("node").orderBy(*best))).where(F.col("n") <= k)


def contained_mentions(mentions: DataFrame, evidence: DataFrame) -> DataFrame:
    """Mentions that lie within an evidence's span of the same note and paragraph."""
    return evidence.join(mentions, ["note_id", "paragraph_index"]).where("e_start <= m_start and m_end <= e_end")


#: Most entities of equal keys that stand in a row, and entities of a key that a side of a cell has, about.
ALIAS_BLOCK, ALIAS_CELL = 256, 2048


def alias_matches(entities: DataFrame, registry: DataFrame) -> DataFrame:
    """Confirmed entities of the same kind of which a name or alias equals one of an entity's: every pair once.

    Entities with equal keys stand in blocks, blocks meet, and their pairs are spelled out last. Pairs are as many as the result
    has and are not shuffled: two blocks with several common keys meet at the first of them. Both sides of a key are dealt
    to cells of bounded size, so a frequent key is the work of many tasks. An entity's matches follow each other and those
    of its block repeat them, which column files store in a fraction of a byte a pair.
    """

    def keyed(df: DataFrame) -> DataFrame:
        """(kind, k, before, ids): each key of a block of entities, with those that come before it."""
        own = F.filter(F.array(*[F.struct("kind", T.name_key(F.col(c)).alias("k")) for c in ("name", "alias")]), lambda y: y["k"] != "")
        g = df.where("kind is not null").groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(own)))).alias("x"))
        i = F.floor((F.row_number().over(Window.partitionBy("x").orderBy("id")) - 1) / ALIAS_BLOCK)
        blocks = g.where(F.size("x") > 0).withColumn("i", i).groupBy("x", "i").agg(F.collect_list(F.struct("id"))["id"].alias("ids"))
        return blocks.select("x", "ids", F.posexplode("x").alias("i", "y")).select("y.kind", "y.k", F.slice("x", F.lit(1), F.col("i")).alias("before"), "ids")

    left, right = keyed(entities), keyed(registry)
    count = lambda df, name: df.groupBy("kind", "k").agg(F.ceil(F.sum(F.size("ids")) / ALIAS_CELL).alias(name))
    cells = count(left, "n").join(count(right, "m"), ["kind", "k"])
    tasks = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda n: F.pmod(F.xxhash64(F.col("ids")[0]), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    at = ["kind", "k", "p", "q"]
    a = left.join(cells, ["kind", "k"]).select("kind", "k", dealt("n").alias("p"), every("m").alias("q"), F.col("before").alias("a"), "ids").repartition(tasks, *at)
    b = right.join(cells, ["kind", "k"]).select("kind", "k", every("n").alias("p"), dealt("m").alias("q"), F.col("before").alias("b"), F.col("ids").alias("matches")).repartition(tasks, *at)
    j = a.join(b, at).where((F.size("a") == 0) | (F.size("b") == 0) | ~F.arrays_overlap("a", "b"))
    return j.select(F.explode("ids").alias("id"), "matches").select("id", F.explode("matches").alias("match_id"))


def follow_redirects(ids: DataFrame, redirects: DataFrame, hops: int = 8) -> DataFrame:
    """Each id with where its chain of redirects ends after at most ``hops``; null if it goes on."""
    r = redirects.where("old_id <> new_id").select("old_id", "new_id")
    out = ids.select("id", F.col("id").alias("at"))
    for _ in range(hops):
        out = out.join(r, F.col("at") == F.col("old_id"), "left").select("id", F.coalesce("new_id", "at").alias("at"))
    more = out.join(r.select(F.col("old_id").alias("o")), F.col("at") == F.col("o"), "left")
    return more.select("id", F.when(F.col("o").isNull(), F.col("at")).alias("target"))


def chain_ends(redirects: DataFrame) -> DataFrame:
    """(old_id, target): where each redirect's chain ends, whatever its length; those in or before a ring are left out. Chains are
    doubled each round, so as many rounds as a chain's length has binary digits do. An id has one redirect at most."""
    up = checkpoint(redirects.where("old_id <> new_id").select("old_id", F.col("new_id").alias("target")).distinct())
    on = lambda: up.join(up.select(F.col("old_id").alias("target")), "target", "left_semi").select("old_id")
    open_ = on().count()
    for _ in range(open_.bit_length() + 1):
        if not open_:
            return up
        far = up.select(F.col("old_id").alias("target"), F.col("target").alias("far"))
        up = checkpoint(up.join(far, "target", "left").select("old_id", F.coalesce("far", "target").alias("target")))
        open_ = on().count()
    return up.join(on(), "old_id", "left_anti") if open_ else up


def edge_cost(origin: Column, confidence: Column) -> Column:
    """Cost in millionths: 1 for a human's edge, 1.2 + (1 - confidence) for a model's, 3 for co-occurrence."""
    clamped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), confidence))
    return F.round(1e6 * F.when(origin == "cooccurrence", 3.0).when(origin.isin(*ORIGINS[1:]), 1.0).otherwise(1.2 + (1 - clamped))).cast("long")


def k_hop(edges: DataFrame, seeds: DataFrame, hops: int, per_node: int = 8) -> DataFrame:
    """Breadth-first expansion (id, hop); each frontier node adds its ``per_node`` best unseen neighbours.

    Every hop's result is cut by a reliable checkpoint, and the loop ends on an empty frontier.
    """
    both = edges.select(F.col("a"), F.col("b"), "weight").union(edges.select("b", "a", "weight"))
    seen = seeds.select("id").distinct().withColumn("hop", F.lit(0))
    frontier = seen
    for hop in range(1, hops + 1):
        near = both.join(frontier.select(F.col("id").alias("a")), "a").join(seen.select(F.col("id").alias("b")), "b", "left_anti")
        n = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("weight"), "b"))
        frontier = checkpoint(near.withColumn("n", n).where(F.col("n") <= per_node).select(F.col("b").alias("id")).distinct().withColumn("hop", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in spark.checkpoint.dir; a local master may do without the setting and gets a temporary folder."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="talkgrid-")
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def connected(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(id, root): smallest node of each component, by passing minima along edges and jumping to roots of roots."""
    both = checkpoint(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    label = checkpoint(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("root")))
    for _ in range(max_rounds):
        near = both.join(label.select(F.col("id").alias("b"), "root"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("low"))
        step = label.join(near, "id").select("id", F.least("root", "low").alias("root"), F.col("root").alias("old"))
        jump = step.select(F.col("id").alias("j"), F.col("root").alias("jr"))
        new = checkpoint(step.join(jump, F.col("root") == F.col("j")).select("id", F.least("root", "jr").alias("root"), "old"))
        label = new.select("id", "root")
        if new.where("root <> old").isEmpty():
            return label
    raise RuntimeError("components did not settle")


def ranked_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, root, edges, confidence) of each node with an edge: its component's root, which is the node with the most edges,
    then confidence, notes and mentions, then the smallest, and the component's edges and their summed confidence, by which
    components rank. edges: a, b, confidence; nodes: id, note_count, mention_total. Self-loops and dead ends don't count."""
    live = checkpoint(live_edges(edges.where("a <> b"), nodes).select("a", "b", "confidence"))
    label = connected(live).withColumnRenamed("root", "component")
    sides = live.select(F.col("a").alias("id"), "confidence").union(live.select("b", "confidence"))
    own = sides.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("c"))
    best = F.struct(-F.col("n"), -F.col("c"), -F.col("note_count"), -F.col("mention_total"), "id")
    roots = label.join(own, "id").join(nodes.select("id", "note_count", "mention_total"), "id").groupBy("component").agg(F.min_by("id", best).alias("root"))
    total = live.join(label.withColumnRenamed("id", "a"), "a").groupBy("component").agg(F.count(F.lit(1)).alias("edges"), F.sum("confidence").alias("confidence"))
    return label.join(roots.join(total, "component"), "component").select("id", "root", "edges", "confidence")


#: Hops that one plan takes before it is cut by a checkpoint.
HOPS_A_CUT = 4


def shortest_path(edges: DataFrame, start, end, max_hops: int = 6) -> DataFrame:
    """(cost, hops, weakest, ids): the simple path of least (cost, hops, -weakest confidence, edge ids) as one row; none if
    there is none.

    edges: id, a, b, cost, confidence (undirected, positive costs). Least costs by hops are grown from both ends as narrow
    labels (node, hops, cost) to half the hops each, and meet; edges that lie on no walk of the least cost drop out. What is
    left is a graph of levels, in which the tie-breakers are settled by growing paths from the start: of the paths to
    a node and hop those stay that no other beats in both tie-breakers.
    """
    kind = edges.schema["a"].dataType.simpleString()
    edges = checkpoint(edges.select(F.col("id").cast("string").alias("id"), "a", "b", "cost", "confidence").where("a <> b"))
    both = edges.select("id", F.col("a").alias("x"), F.col("b").alias("y"), "cost", "confidence").union(edges.select("id", "b", "a", "cost", "confidence"))
    one = edges.sparkSession.range(1)
    none = one.select(F.lit(0).cast("long").alias("cost"), F.lit(0).cast("long").alias("hops"), F.lit(1.0).alias("weakest"), F.expr("cast(array() as array<string>)").alias("ids"))
    if start == end:
        return none
    labels = {}
    for side, at, hops in (("s", start, -(-max_hops // 2)), ("e", end, max_hops // 2)):
        # A walk that comes back to a node it has been at costs more, so walks are as good as simple paths here.
        now = every = one.select(F.lit(at).cast(kind).alias("node"), F.lit(0).alias("hop"), F.lit(0).cast("long").alias("cost"))
        for hop in range(1, hops + 1):
            near = both.select("x", "y", F.col("cost").alias("c")).join(now.select(F.col("node").alias("x"), "cost"), "x")
            now = near.groupBy(F.col("y").alias("node")).agg(F.min(F.col("cost") + F.col("c")).alias("cost")).select("node", F.lit(hop).alias("hop"), "cost")
            now = checkpoint(now) if hop % HOPS_A_CUT == 0 else now
            every = every.unionByName(now)
        labels[side] = checkpoint(every)
    s, e = (labels[k].select("node", F.col("hop").alias(f"{k}h"), F.col("cost").alias(f"{k}c")) for k in "se")
    best = s.join(e, "node").agg(F.min(F.struct(F.col("sc") + F.col("ec"), F.col("sh") + F.col("eh"))).alias("b")).select("b.*").first()
    if best[0] is None:
        return none.where("false")
    cost, hops = best
    # A node stands at hop h of a least walk if its costs from both ends add up to the least. Up to the middle the labels from
    # the start say what it costs to be there, and what does not lead on is dropped from the middle back; beyond it the
    # labels from the end say what may be left, and what is not reached is never grown.
    middle = -(-hops // 2)
    level = s.where(F.col("sh") == middle).join(e.where(F.col("eh") == hops - middle), "node").where(F.col("sc") + F.col("ec") == cost).select("node", F.col("sc").alias("spent"))
    steps = []
    for h in range(middle, 0, -1):
        before = s.where(F.col("sh") == h - 1).select(F.col("node").alias("x"), F.col("sc").alias("sx"))
        on = both.join(level.select(F.col("node").alias("y"), F.col("spent").alias("sy")), "y").join(before, "x").where("sx + cost = sy")
        steps.append(on.select(F.lit(h).alias("h"), "id", "x", "y", "confidence"))
        level = on.select(F.col("x").alias("node"), F.col("sx").alias("spent")).distinct()
    for h in range(middle + 1, hops + 1):
        left = lambda n, at: e.where(F.col("eh") == hops - at).select(F.col("node").alias(n), F.col("ec").alias(f"e{n}"))
        on = both.join(left("x", h - 1), "x").join(left("y", h), "y").where("ex = cost + ey")
        steps.append(on.select(F.lit(h).alias("h"), "id", "x", "y", "confidence"))
    every = steps[0]
    for step in steps[1:]:
        every = every.unionByName(step)
    every = checkpoint(every)
    paths, at = none.withColumn("node", F.lit(start).cast(kind)), Window.partitionBy("node")
    for h in range(1, hops + 1):
        grown = every.where(F.col("h") == h).select("id", "x", "y", "confidence").join(paths, F.col("x") == F.col("node"))
        grown = grown.select(F.col("y").alias("node"), F.least("weakest", "confidence").alias("weakest"), F.concat("ids", F.array("id")).alias("ids"))
        earlier = F.max("weakest").over(at.orderBy("ids").rowsBetween(Window.unboundedPreceding, -1))
        paths = grown.withColumn("earlier", earlier).where("earlier is null or weakest > earlier").drop("earlier")
        paths = checkpoint(paths) if h % HOPS_A_CUT == 0 and h < hops else paths
    return paths.orderBy(F.desc("weakest"), "ids").limit(1).select(F.lit(cost).cast("long").alias("cost"), F.lit(hops).cast("long").alias("hops"), "weakest", "ids")


def path_emphasis(edges: DataFrame, path: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges and nodes with ``on_path``: what a path (column ids) shows up among them."""
    ids = path.select(F.explode("ids").alias("id")).withColumn("on_path", F.lit(True))
    e = edges.join(ids, "id", "left").withColumn("on_path", F.coalesce("on_path", F.lit(False)))
    nodes = e.select(F.col("a").alias("id"), "on_path").union(e.select("b", "on_path")).groupBy("id").agg(F.bool_or("on_path").alias("on_path"))
    return e, nodes


def active_operations(ops: DataFrame) -> DataFrame:
    """The ledger's operations with ``active``: an active undo turns its target off; later ones count first.

    ops: op_index, id, kind, target. Several undos may have one target. An undo is settled once all that undo it are; each
    round settles those whose undoers were settled before and cuts the lineage, for as long as there are such, so chains of
    any length are followed. Undos that undo each other in a ring can't be settled and are an error.
    """
    undo = checkpoint(ops.where("kind = 'undo'").select(F.col("id").alias("u"), F.col("target").alias("t")).distinct())
    links = checkpoint(undo.join(undo.select(F.col("u").alias("by"), F.col("t").alias("u")), "u").select("u", "by"))
    # Chains without branches, by doubling: an undo is on if the number of undos after it is even.
    single = links.groupBy("u").agg(F.min("by").alias("by"), F.count(F.lit(1)).alias("n"))
    if single.where("n > 1").isEmpty():
        state = checkpoint(undo.select("u").distinct().join(single.select("u", "by"), "u", "left").withColumn("steps", F.when(F.col("by").isNull(), 0).otherwise(1).cast("long")))
        left = state.where("by is not null").count()
        for _ in range(left.bit_length() + 1):
            if not left:
                break
            far = state.select(F.col("u").alias("by"), F.col("by").alias("far"), F.col("steps").alias("more"))
            state = checkpoint(state.join(far, "by", "left").select("u", F.col("far").alias("by"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")))
            left = state.where("by is not null").count()
        if left:
            raise ValueError("undos undo each other in a ring")
        on = state.where("steps % 2 = 0").select("u")
    else:
        todo, done = undo.select("u").distinct(), None
        while not todo.isEmpty():
            open_ = links.join(todo.select(F.col("u").alias("by")), "by", "left_semi").select("u").distinct()
            ready = todo.join(open_, "u", "left_anti")
            hit = None if done is None else links.join(done.where("is_on").select(F.col("u").alias("by")), "by", "left_semi").select("u").distinct().withColumn("_off", F.lit(True))
            new = checkpoint(ready.withColumn("is_on", F.lit(True)) if hit is None else ready.join(hit, "u", "left").select("u", F.col("_off").isNull().alias("is_on")))
            if new.isEmpty():
                raise ValueError("undos undo each other in a ring")
            done = new if done is None else checkpoint(done.unionByName(new))
            todo = checkpoint(todo.join(new.select("u"), "u", "left_anti"))
        on = undo.select("u").limit(0) if done is None else done.where("is_on").select("u")
    off = undo.join(on, "u", "left_semi").select(F.col("t").alias("off_id")).distinct()
    return ops.join(off, F.col("id") == F.col("off_id"), "left").withColumn("active", F.col("off_id").isNull()).drop("off_id")
