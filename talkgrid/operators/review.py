"""Review and editing: write-backs, feedback plans, journals, gates, parsing of raw output, and document blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkgrid.functions import text as T


def write_back(rows: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """New texts by (key, index), all or none for each key: an index out of range or a blank text rejects all of a key's edits."""
    e = edits.select(key, "index", F.col("text").alias("_new"))
    bad = e.join(rows.select(key, "index").withColumn("_there", F.lit(True)), [key, "index"], "left").where(F.col("_there").isNull() | (F.trim("_new") == "") | F.col("_new").isNull()).select(key).distinct()
    ok = e.join(bad, key, "left_anti")
    return rows.join(ok, [key, "index"], "left").withColumns({"changed": F.col("_new").isNotNull(), "text": F.coalesce("_new", "text")}).drop("_new")


def feedback_plan(requests: DataFrame, applied: DataFrame) -> DataFrame:
    """(key, target, action): nothing where the same target was applied before, a merge where the prior one has no name,
    else a reinforcement. applied: key, prior, prior_name."""
    j = requests.join(applied, "key", "left")
    action = F.when(F.col("prior") == F.col("target"), "none").when(F.col("prior").isNotNull() & (F.coalesce(F.trim("prior_name"), F.lit("")) == ""), "merge").otherwise("reinforce")
    return j.select("key", "target", action.alias("action"))


def journal_state(entries: DataFrame) -> DataFrame:
    """(merge_id, state): merges are live, undone, or revived by the last of their undo and redo entries."""
    last = entries.groupBy("merge_id").agg(F.max_by("kind", "at").alias("k"), F.count(F.lit(1)).alias("n"))
    return last.select("merge_id", F.when(F.col("k") == "undo", "undone").when((F.col("k") == "redo"), "revived").otherwise("live").alias("state"))


def z_gate(raw: Column, z: Column, z_min: float = 3.0, raw_floor: float = 0.50, raw_min: float = 0.68) -> Column:
    """Whether a cross-source match counts: by its score, or by a salient z over a floor."""
    return (raw >= raw_min) | ((F.coalesce(z, F.lit(-1e9)) >= z_min) & (raw >= raw_floor))


def raw_output(t: Column, schema: str, begin: str = "<<<", end: str = ">>>") -> Column:
    """The JSON between the marks of a model's raw output; null if there is none or it can't be read."""
    body = F.regexp_extract(t, f"(?s){begin}(.*?){end}", 1)
    return F.when(body != "", F.from_json(body, schema))


def relation_bundle(relations: DataFrame, evidence: DataFrame) -> DataFrame:
    """Each relation with its evidence ids in order of note, paragraph, start and id."""
    e = evidence.groupBy("relation_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("note_id", "paragraph", "start", "id"))), lambda x: x["id"]).alias("evidence"))
    return relations.join(e, relations["id"] == e["relation_id"], "left").drop("relation_id")


def tokens_to_segments(tokens: DataFrame, boundaries: DataFrame) -> DataFrame:
    """(key, segment, text): a token belongs to the first boundary after its time; the blank mark becomes a blank.

    tokens: key, t, token; boundaries: key, segment, end. The boundary is found by one sorted pass over both.
    """
    both = tokens.select("key", "t", F.lit(0).alias("kind"), "token", F.lit(None).cast("long").alias("segment")).unionByName(boundaries.select("key", F.col("end").alias("t"), F.lit(-1).alias("kind"), F.lit(None).cast("string").alias("token"), F.col("segment").cast("long").alias("segment")))
    w = Window.partitionBy("key").orderBy(F.desc("t"), F.desc("kind"), "token").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = both.withColumn("at", F.last("segment", ignorenulls=True).over(w)).where("token is not null and at is not null")
    g = placed.groupBy("key", F.col("at").alias("segment")).agg(F.array_sort(F.collect_list(F.struct("t", "token"))).alias("x"))
    return g.select("key", "segment", F.trim(F.regexp_replace(F.array_join(F.transform("x", lambda r: r["token"]), ""), "▁", " ")).alias("text"))


def parsed_entities(raw: DataFrame) -> DataFrame:
    """(note_id, kind, name, aliases) of a model's entities: blank names go, kind is term where missing, aliases are trimmed."""
    kind = "array<struct<kind:string,name:string,aliases:array<string>>>"
    e = raw.select("note_id", F.explode(F.from_json("raw", kind)).alias("e")).where(F.trim("e.name") != "")
    alias = F.filter(F.transform(F.coalesce("e.aliases", F.expr("cast(array() as array<string>)")), lambda a: F.trim(a)), lambda a: a != "")
    return e.select("note_id", F.coalesce(F.nullif(F.trim("e.kind"), F.lit("")), F.lit("term")).alias("kind"), F.trim("e.name").alias("name"), alias.alias("aliases"))


def save_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Rows of ``after`` with ``dirty``: whether the text changed or is new; blank ones are left out."""
    j = after.where(F.trim("text") != "").join(before.select(key, F.col("text").alias("_old")), key, "left")
    return j.select(*after.columns, (~F.col("_old").eqNullSafe(F.col("text"))).alias("dirty"))


def detach_person(speakers: DataFrame, gone: DataFrame) -> DataFrame:
    """Links to people who are gone are cleared; the speakers stay."""
    g = gone.select(F.col("id").alias("person_id"), F.lit(True).alias("_gone"))
    return speakers.join(g, "person_id", "left").withColumn("person_id", F.when(F.col("_gone").isNull(), F.col("person_id"))).drop("_gone")


def gap_ranges(finals: DataFrame, most_ms: int) -> DataFrame:
    """(key, from_ms, to_ms): stretches without finals longer than so much, from the last final's end."""
    w = Window.partitionBy("key").orderBy("start_ms", "end_ms")
    last = F.max("end_ms").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return finals.withColumn("from_ms", last).where(F.col("start_ms") - F.col("from_ms") > most_ms).select("key", "from_ms", F.col("start_ms").alias("to_ms"))


def gain_at(positions: DataFrame, spans: DataFrame, duck: float = 0.063, ramp: int = 1280, bucket: int = 1 << 16) -> DataFrame:
    """(position, gain): ducked within disjoint spans, sliding over a ramp at either end, else 1. Range join by buckets."""
    s = spans.withColumn("b", F.explode(F.sequence(F.floor((F.col("first") - ramp) / bucket), F.floor((F.col("last") + ramp) / bucket))))
    j = positions.withColumn("b", F.floor(F.col("position") / bucket)).join(s, "b").where((F.col("position") > F.col("first") - ramp) & (F.col("position") < F.col("last") + ramp))
    away = F.greatest(F.lit(0), F.col("first") - F.col("position"), F.col("position") - F.col("last"))
    low = j.groupBy("position").agg(F.min(duck + (1 - duck) * away / ramp).alias("gain"))
    return positions.select("position").join(low, "position", "left").select("position", F.coalesce("gain", F.lit(1.0)).alias("gain"))


def subgraph(nodes: DataFrame, edges: DataFrame, pruned: bool) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a view: edges need both ends; nodes are pruned to edges' ends only if a filter asks for it."""
    from talkgrid.operators.graph import admitted_nodes

    ids = nodes.select("id")
    e = edges.join(ids.withColumnRenamed("id", "subject_id"), "subject_id", "left_semi").join(ids.withColumnRenamed("id", "object_id"), "object_id", "left_semi")
    return (admitted_nodes(nodes, e) if pruned else nodes), e


def export_line(title: Column, started: Column, seconds: Column) -> Column:
    """Header line of an export: title, start, and duration or that it was interrupted."""
    return F.concat(F.lit("# "), title, F.lit("\n"), started, F.when(seconds.isNotNull(), F.concat(F.lit(" ("), T.human_duration(seconds), F.lit(")"))).otherwise(" (interrupted)"))
