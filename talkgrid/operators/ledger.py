"""Governance: an append-only ledger of operations, replayed into registries, decisions and bindings; edits and guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkgrid.operators.graph import active_operations, follow_redirects


def last_writes(ops: DataFrame, kind: str, key: str, value: str) -> DataFrame:
    """Of the active operations of a kind the last one for each key: (key, value). Both are read from the payload."""
    mine = active_operations(ops).where(F.col("active") & (F.col("kind") == kind))
    rows = mine.select(F.get_json_object("payload", f"$.{key}").alias(key), F.get_json_object("payload", f"$.{value}").alias(value), "op_index")
    return rows.groupBy(key).agg(F.max_by(value, "op_index").alias(value))


def registry(base: DataFrame, ops: DataFrame) -> DataFrame:
    """base (id, name) after all active renames, and without those that an active merge sent elsewhere."""
    names = last_writes(ops, "rename", "entity", "name")
    gone = last_writes(ops, "merge", "source", "target").select(F.col("source").alias("id"))
    out = base.join(names, F.col("id") == F.col("entity"), "left").select("id", F.coalesce(names["name"], base["name"]).alias("name"))
    return out.join(gone, "id", "left_anti")


def resolved(ids: DataFrame, ops: DataFrame) -> DataFrame:
    """Where each id leads through the active merges, in at most eight hops."""
    r = last_writes(ops, "merge", "source", "target").select(F.col("source").alias("old_id"), F.col("target").alias("new_id"))
    return follow_redirects(ids, r)


def resolved_before(events: DataFrame, merges: DataFrame) -> DataFrame:
    """As-of: for each event (op_index, id) the target of the latest earlier merge of its id, else the id itself.

    Both tables are ordered together by id, so the work is one sort, however many merges an id has.
    """
    both = events.select("id", "op_index", F.lit(0).alias("m"), F.lit(None).cast(merges.schema["target"].dataType).alias("target")).unionByName(merges.select(F.col("source").alias("id"), "op_index", F.lit(1).alias("m"), "target"))
    w = Window.partitionBy("id").orderBy("op_index", "m").rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("last", F.last("target", ignorenulls=True).over(w)).where("m = 0").select("op_index", "id", F.coalesce("last", "id").alias("target"))


def edit_if_unchanged(rows: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """Optimistic edits: the new text where the expected one still holds. Adds ``applied``."""
    e = edits.select(*keys, F.col("expected").alias("_expected"), F.col("new_text").alias("_new"))
    j = rows.join(e, keys, "left")
    hit = F.col("_expected").eqNullSafe(F.col("text")) & F.col("_new").isNotNull()
    return j.withColumns({"applied": F.coalesce(hit, F.lit(False)), "text": F.when(hit, F.col("_new")).otherwise(F.col("text"))}).drop("_expected", "_new")


def reassign_all_or_none(rows: DataFrame, changes: DataFrame, speakers: DataFrame, keys: list[str]) -> DataFrame:
    """Speakers after a batch of changes, which counts only if each row still has the expected (or already the new)
    speaker and each target exists; otherwise nothing changes. The verdict is one row."""
    c = changes.select(*keys, F.col("expected").alias("_old"), F.col("target").alias("_new"))
    checked = c.join(rows.select(*keys, "speaker"), keys, "left").join(speakers.select(F.col("speaker_id").alias("_new"), F.lit(True).alias("_known")), "_new", "left")
    ok = (F.col("speaker").eqNullSafe(F.col("_old")) | F.col("speaker").eqNullSafe(F.col("_new"))) & F.col("_known").isNotNull()
    verdict = checked.agg(F.coalesce(F.bool_and(ok), F.lit(True)).alias("_ok"))
    j = rows.join(c, keys, "left").crossJoin(F.broadcast(verdict))  # one row
    return j.withColumn("speaker", F.when(F.col("_ok") & F.col("_new").isNotNull(), F.col("_new")).otherwise(F.col("speaker"))).drop("_old", "_new", "_ok")


def new_speaker_ids(wanted: DataFrame, existing: DataFrame, order: str) -> DataFrame:
    """Ids S<n> after the largest number in use, in order. Wanted rows are a note's new speakers."""
    top = existing.groupBy("note_id").agg(F.max(F.regexp_extract("speaker_id", r"^S(\d+)$", 1).try_cast("int")).alias("_top"))
    n = F.row_number().over(Window.partitionBy("note_id").orderBy(order))
    return wanted.join(top, "note_id", "left").withColumn("speaker_id", F.concat(F.lit("S"), (F.coalesce("_top", F.lit(0)) + n).cast("string"))).drop("_top")


def moved_paragraphs(paragraphs: DataFrame, moves: DataFrame) -> DataFrame:
    """(note_id, paragraph, target, stale): a paragraph moves if all its segments moved to one target, and is stale if
    some or to several. paragraphs: note_id, paragraph, seqs; moves: note_id, seq, target."""
    each = paragraphs.select("note_id", "paragraph", F.explode("seqs").alias("seq")).join(moves, ["note_id", "seq"], "left")
    g = each.groupBy("note_id", "paragraph").agg(F.bool_and(F.col("target").isNotNull()).alias("all_"), F.bool_or(F.col("target").isNotNull()).alias("some"), F.countDistinct("target").alias("n"), F.max("target").alias("t"))
    whole = F.col("all_") & (F.col("n") == 1)
    return g.select("note_id", "paragraph", F.when(whole, F.col("t")).alias("target"), (F.col("some") & ~whole).alias("stale"))


#: Legal steps of an identification.
STEPS = (("idle", "running"), ("running", "suggested"), ("running", "failed"), ("suggested", "applied"), ("suggested", "dismissed"), ("failed", "running"), ("applied", "undone"))


def legal_steps(steps: DataFrame) -> DataFrame:
    """Steps (id, from, to) of the legal kind only; the table of kinds has a fixed size."""
    ok = F.broadcast(steps.sparkSession.createDataFrame(list(STEPS), "from string, to string"))
    return steps.join(ok, ["from", "to"], "left_semi")


def consent_token(selection: Column, provider: Column, model: Column, contract: Column) -> Column:
    """SHA-256 over the sorted selection and what it was given for."""
    return F.sha2(F.concat_ws("\u0000", F.array_join(F.array_sort(selection), ","), provider, model, contract), 256)


def keep_last(journal: DataFrame, n: int = 50) -> DataFrame:
    """The newest entries; those with an unfinished undo stay besides."""
    newest = journal.orderBy(F.desc("at"), F.desc("id")).limit(n)
    open_ = journal.where("undo_open").join(newest.select("id"), "id", "left_anti")
    return newest.unionByName(open_.select(*journal.columns))


def contract_issues(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """(relation_index, field, message) of every rule that a relation breaks; any row rejects the whole batch.

    relations: relation_index, subject, object, predicate, label, confidence, valid_from, valid_to, quotes (array).
    """
    from talkgrid.operators.graph import CORE_PREDICATES

    names = entities.select(F.lower(F.trim("name")).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    side = lambda s: names.select(F.col("k").alias(f"{s}_k"), F.col("n").alias(f"{s}_n"))
    r = relations
    for s in ("subject", "object"):
        r = r.join(side(s), F.lower(F.trim(s)) == F.col(f"{s}_k"), "left")
    ts = lambda c: F.try_to_timestamp(F.col(c))
    rule = lambda bad, field, message: F.when(bad, F.struct(F.lit(field).alias("field"), F.lit(message).alias("message")))
    rules = [
        *[rule(F.col(f"{s}_n").isNull(), s, "unknown entity") for s in ("subject", "object")],
        *[rule(F.col(f"{s}_n") > 1, s, "ambiguous entity") for s in ("subject", "object")],
        rule(F.col("subject_k") == F.col("object_k"), "object", "relation to itself"),
        rule(~F.col("predicate").isin(*CORE_PREDICATES, "custom") | F.col("predicate").isNull(), "predicate", "unknown predicate"),
        rule((F.col("predicate") == "custom") & (F.coalesce(F.trim("label"), F.lit("")) == ""), "label", "custom predicate without label"),
        rule((F.col("predicate") != "custom") & F.col("label").isNotNull(), "label", "label on a core predicate"),
        rule(F.col("confidence").isNull() | F.isnan("confidence") | (F.col("confidence") < 0) | (F.col("confidence") > 1), "confidence", "outside 0 to 1"),
        *[rule(F.col(c).isNotNull() & ts(c).isNull(), c, "not a time") for c in ("valid_from", "valid_to")],
        rule(ts("valid_from") >= ts("valid_to"), "valid_to", "not after valid_from"),
        rule(F.coalesce(F.size("quotes"), F.lit(0)) <= 0, "evidence", "no evidence"),
        rule(F.exists(F.coalesce("quotes", F.expr("cast(array() as array<string>)")), lambda q: F.trim(q) == ""), "evidence", "blank quote"),
    ]
    return r.select("relation_index", F.explode(F.array_compact(F.array(*rules))).alias("x")).select("relation_index", "x.*")
