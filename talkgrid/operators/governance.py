"""Operations on the graph: what each kind must say, how it is appended to the ledger, and what a registry is after them."""

from __future__ import annotations

import datetime
import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkgrid.functions import text as T
from talkgrid.operators.graph import CORE_PREDICATES, active_operations

#: Kinds of operations and the fields of their payload that must not be blank.
KINDS = {
    "rename": ("entity", "name"), "add_alias": ("entity", "alias"), "remove_alias": ("entity", "alias"), "bind": ("note_id", "local", "entity"),
    "confirm": ("relation",), "edit": ("relation", "predicate"), "suppress": ("relation",), "end": ("relation", "at"), "restore": ("relation",),
    "create_entity": ("kind", "name"), "create_relation": ("subject", "predicate", "object"),
    "merge": ("source", "target"), "undo": (),
}
_PAYLOAD = "entity string, name string, alias string, note_id string, local string, relation string, predicate string, label string, valid_from string, valid_to string, at string, kind string, subject string, object string, source string, target string, confidence double"
_NANOS = 1_000_000_000


def next_operation_time(last: str | None, now: datetime.datetime) -> str:
    """The time of the next operation: now, but a nanosecond after the last one at least. Times are UTC texts with nine
    digits of the second, so they compare as text."""
    ns = int(now.astimezone(datetime.UTC).timestamp()) * _NANOS + now.microsecond * 1000
    if last:
        whole, _, frac = last.rstrip("Z").partition(".")
        at = datetime.datetime.strptime(whole, "%Y-%m-%dT%H:%M:%S").replace(tzinfo=datetime.UTC)
        ns = max(ns, int(at.timestamp()) * _NANOS + int(frac.ljust(9, "0")[:9] or 0) + 1)
    return f"{datetime.datetime.fromtimestamp(ns // _NANOS, datetime.UTC):%Y-%m-%dT%H:%M:%S}.{ns % _NANOS:09d}Z"


def append(ledger: list[dict], kind: str, payload: dict, now: datetime.datetime, target: str | None = None) -> list[dict]:
    """The ledger (operations with id, at, kind, target, payload as JSON text) with one more. The kind and what it must say
    are checked here, what it refers to by :func:`faults`."""
    if kind not in KINDS:
        raise ValueError(f"unknown operation {kind!r}")
    blank = [f for f in KINDS[kind] if not str(payload.get(f) or "").strip()]
    if blank or (kind == "undo" and not target):
        raise ValueError(f"{kind}: {', '.join(blank) or 'target'} is missing")
    if kind == "undo" and target not in {o["id"] for o in ledger}:
        raise ValueError(f"undo: there is no operation {target}")
    at = next_operation_time(ledger[-1]["at"] if ledger else None, now)
    text = json.dumps(payload, ensure_ascii=False, sort_keys=True)
    ident = "op_" + hashlib.sha256(f"{at}\0{kind}\0{text}\0{target}".encode()).hexdigest()[:16]
    return [*ledger, {"id": ident, "at": at, "kind": kind, "target": target, "payload": text}]


def parsed(ops: DataFrame) -> DataFrame:
    """Operations (op_index, id, kind, target, payload) with the payload's fields as ``p``."""
    return ops.withColumn("p", F.from_json("payload", _PAYLOAD))


def entity_id(kind: Column, name: Column) -> Column:
    return T.stable_id("kg_", kind, T.name_key(name))


def relation_id(subject: Column, predicate: Column, object_: Column) -> Column:
    return T.stable_id("rel_", subject, predicate, object_)


def faults(ops: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(op_index, fault) of operations that refer to what is neither in the tables nor made by an earlier operation, name
    themselves, or carry times or predicates that are none. entities: id; relations: id."""
    o = parsed(ops)
    first = lambda df: df.groupBy("id").agg(F.min("_from").alias("_from"))
    made_e = o.where("kind = 'create_entity'").select(entity_id(F.col("p.kind"), F.col("p.name")).alias("id"), F.col("op_index").alias("_from"))
    made_r = o.where("kind = 'create_relation'").select(relation_id(F.col("p.subject"), F.col("p.predicate"), F.col("p.object")).alias("id"), F.col("op_index").alias("_from"))
    known = {"entity": first(entities.select("id", F.lit(-1).cast("long").alias("_from")).unionByName(made_e)), "relation": first(relations.select("id", F.lit(-1).cast("long").alias("_from")).unionByName(made_r))}
    refs = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(t).alias("table"), F.col(f"p.{f}").alias("id")) for f, t in (("entity", "entity"), ("source", "entity"), ("target", "entity"), ("subject", "entity"), ("object", "entity"), ("relation", "relation"))])
    each = o.select("op_index", F.explode(F.filter(refs, lambda r: r["id"].isNotNull())).alias("r")).select("op_index", "r.*")
    missing = None
    for table, ids in known.items():
        j = each.where(F.col("table") == table).join(ids, "id", "left").where(F.col("_from").isNull() | (F.col("_from") >= F.col("op_index")))
        got = j.select("op_index", F.concat_ws(" ", F.lit("unknown"), F.lit(table), "id").alias("fault"))
        missing = got if missing is None else missing.unionByName(got)
    when = lambda c: F.col(c).isNotNull() & F.try_to_timestamp(F.col(c)).isNull()
    rules = F.array_compact(F.array(
        F.when(~F.col("kind").isin(*KINDS), "unknown kind"),
        F.when((F.col("kind") == "merge") & (F.col("p.source") == F.col("p.target")), "merge into itself"),
        F.when(F.col("p.subject") == F.col("p.object"), "relation to itself"),
        F.when(F.col("p.predicate").isNotNull() & ~F.col("p.predicate").isin(*CORE_PREDICATES, "custom"), "unknown predicate"),
        F.when((F.col("p.predicate") == "custom") & (F.trim(F.coalesce("p.label", F.lit(""))) == ""), "custom predicate without label"),
        F.when(when("p.at") | when("p.valid_from") | when("p.valid_to"), "not a time"),
        F.when(F.try_to_timestamp("p.valid_from") >= F.try_to_timestamp("p.valid_to"), "interval out of order"),
    ))
    return missing.unionByName(o.select("op_index", F.explode(rules).alias("fault"))).distinct()


def entities_after(base: DataFrame, ops: DataFrame) -> DataFrame:
    """base (id, kind, name, aliases) after the active operations: entities made, last renames, aliases added and taken away
    (the later one of a key counts), and without entities that were merged into others."""
    o = parsed(active_operations(ops).where("active"))
    made = o.where("kind = 'create_entity'").groupBy(entity_id(F.col("p.kind"), F.col("p.name")).alias("id")).agg(F.min_by("p.kind", "op_index").alias("kind"), F.min_by("p.name", "op_index").alias("name"))
    every = base.select("id", "kind", "name", "aliases").unionByName(made.join(base.select("id"), "id", "left_anti").withColumn("aliases", F.expr("cast(array() as array<string>)")))
    names = o.where("kind = 'rename'").groupBy(F.col("p.entity").alias("id")).agg(F.max_by("p.name", "op_index").alias("_name"))
    told = o.where("kind in ('add_alias', 'remove_alias')").select(F.col("p.entity").alias("id"), F.col("op_index").alias("at"), (F.col("kind") == "add_alias").alias("on"), F.col("p.alias").alias("alias"))
    had = every.select("id", F.posexplode("aliases").alias("at", "alias")).select("id", (F.col("at") - 1_000_000_000).cast("long").alias("at"), F.lit(True).alias("on"), "alias")
    last = had.unionByName(told).groupBy("id", T.name_key(F.col("alias")).alias("k")).agg(F.max_by(F.struct("on", "alias"), "at").alias("x"), F.min("at").alias("at")).where("x.on and k <> ''")
    aliases = last.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x.alias"))), lambda r: r["alias"]).alias("_aliases"))
    gone = o.where("kind = 'merge'").select(F.col("p.source").alias("id")).distinct()
    j = every.join(names, "id", "left").join(aliases, "id", "left").join(gone, "id", "left_anti")
    return j.select("id", "kind", F.coalesce("_name", "name").alias("name"), F.coalesce("_aliases", F.expr("cast(array() as array<string>)")).alias("aliases"))


def relations_after(base: DataFrame, ops: DataFrame) -> DataFrame:
    """base (id, subject_id, predicate, label, object_id, confidence, origin, valid_from, valid_to as texts) after the active
    operations: relations made, edits, ends and decisions, of each the last; suppressed ones are left out, a restored one is
    as it was before it was suppressed or ended."""
    o = parsed(active_operations(ops).where("active"))
    p = lambda c: F.col(f"p.{c}")
    made = o.where("kind = 'create_relation'").select(relation_id(p("subject"), p("predicate"), p("object")).alias("id"), p("subject").alias("subject_id"), p("predicate").alias("predicate"), p("label").alias("label"), p("object").alias("object_id"), F.coalesce(p("confidence"), F.lit(1.0)).alias("confidence"), F.lit("user_assertion").alias("origin"), p("valid_from").alias("valid_from"), p("valid_to").alias("valid_to"), "op_index")
    newest = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("op_index")))
    made = made.withColumn("_n", newest).where("_n = 1").drop("_n", "op_index")
    every = base.select(*made.columns).join(made.select("id"), "id", "left_anti").unionByName(made)
    mine = o.where("kind in ('confirm', 'suppress', 'restore', 'end', 'edit')").groupBy(p("relation").alias("id"))
    last = lambda kinds, value: F.max_by(value, F.when(F.col("kind").isin(*kinds), F.col("op_index")))
    e = mine.agg(last(("suppress", "restore"), F.col("kind")).alias("_shown"), F.max(F.when(F.col("kind") == "confirm", True)).alias("_confirmed"), last(("end", "restore"), F.when(F.col("kind") == "end", p("at")).otherwise("")).alias("_ended"), last(("edit",), F.struct(p("predicate").alias("predicate"), p("label").alias("label"), p("valid_from").alias("valid_from"), p("valid_to").alias("valid_to"))).alias("_edit"))
    j = every.join(e, "id", "left").where("_shown is null or _shown <> 'suppress'")
    edited = F.col("_edit").isNotNull()
    pick = lambda c: F.when(edited, F.col(f"_edit.{c}")).otherwise(F.col(c))
    origin = F.when(F.col("origin") == "user_assertion", F.col("origin")).when(edited, "manual").when(F.col("_confirmed"), "confirmed").otherwise(F.col("origin"))
    out = {"predicate": pick("predicate"), "label": pick("label"), "valid_from": pick("valid_from"), "valid_to": F.coalesce(F.when(F.col("_ended") != "", F.col("_ended")), pick("valid_to")), "origin": origin}
    return j.withColumns(out).drop("_shown", "_confirmed", "_ended", "_edit")


def baseline_faults(before: DataFrame, ops: DataFrame, stored: DataFrame) -> DataFrame:
    """(id, fault): where a stored registry is not what the operations make of the registry before: missing, extra or
    different. No rows prove the baseline. Tables: id, kind, name, aliases (in any order)."""
    form = lambda df, c: df.select("id", F.struct("kind", "name", F.array_sort("aliases").alias("aliases")).alias(c))
    j = form(entities_after(before, ops), "want").join(form(stored, "got"), "id", "full")
    fault = F.when(F.col("got").isNull(), "missing").when(F.col("want").isNull(), "extra").when(F.col("want") != F.col("got"), "different")
    return j.select("id", fault.alias("fault")).where("fault is not null")


def bootstrap(entities: DataFrame, overrides: DataFrame, redirects: DataFrame) -> DataFrame:
    """The ledger (op_index, id, kind, target, payload) that stands for an older index: its entities (id, kind, name), names
    given by hand (id, name) and redirects (old_id, new_id), each in order of id. Every range of rows is numbered apart."""
    text = lambda **c: F.to_json(F.struct(*[F.col(v).cast("string").alias(k) for k, v in c.items()]))
    parts = (
        (entities.select("id", F.lit("create_entity").alias("kind"), text(kind="kind", name="name").alias("payload"), F.lit(0).alias("step"))),
        (overrides.select("id", F.lit("rename").alias("kind"), text(entity="id", name="name").alias("payload"), F.lit(1).alias("step"))),
        (redirects.select(F.col("old_id").alias("id"), F.lit("merge").alias("kind"), text(source="old_id", target="new_id").alias("payload"), F.lit(2).alias("step"))),
    )
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    dealt = every.repartitionByRange("step", "id").sortWithinPartitions("step", "id").withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()})
    from talkgrid.operators.graph import checkpoint

    dealt = checkpoint(dealt)
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min("_row").alias("first"))
    offsets = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a partition
    j = dealt.join(F.broadcast(offsets.select("_part", "first", "before")), "_part")
    index = (F.col("before") + F.col("_row") - F.col("first")).cast("long")
    return j.select(index.alias("op_index"), F.concat(F.lit("op_"), F.lpad(index.cast("string"), 12, "0")).alias("id"), "kind", F.lit(None).cast("string").alias("target"), "payload")
