"""Canonical graph build: evidence resolution, mention and evidence splits, registry reconciliation, checks and review rules."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkgrid.functions import text as T


def resolve_evidence(evidence: DataFrame, paragraphs: DataFrame, overlapping: bool = True) -> DataFrame:
    """Adds ``status`` and the offsets found: exact (the quote stands at its offsets), moved (it occurs once elsewhere in the
    paragraph; unless ``overlapping``, one that begins within the first is none) or stale. evidence: note_id, paragraph, start, end, quote; paragraphs: note_id, paragraph, text."""
    j = evidence.join(paragraphs.select("note_id", "paragraph", "text"), ["note_id", "paragraph"], "left")
    exact = T.char_slice(F.col("text"), F.col("start"), F.col("end")).eqNullSafe(F.col("quote")) & F.col("quote").isNotNull()
    at = F.expr("locate(quote, text)")
    again = F.expr(f"locate(quote, text, locate(quote, text) + {'1' if overlapping else 'char_length(quote)'})")
    once = (F.col("quote") != "") & (at > 0) & (again == 0)
    status = F.when(exact, "exact").when(once, "moved").otherwise("stale")
    return j.withColumns({"status": status, "found": F.when(exact, F.col("start")).when(once, at - 1)}).drop("text")


def split_evidence(evidence: DataFrame, mentions: DataFrame) -> DataFrame:
    """(evidence_id, subject_id, object_id): each subject and object entity that an evidence's span holds; pairs stay within one
    evidence, whose span is a sentence or two. mentions: note_id, paragraph, start, end, entity_id, role."""
    of = lambda role, name: mentions.where(F.col("role") == role).select("note_id", "paragraph", F.col("start").alias(f"{name}_s"), F.col("end").alias(f"{name}_e"), F.col("entity_id").alias(f"{name}_id"))
    s = evidence.join(of("subject", "subject"), ["note_id", "paragraph"]).where("start <= subject_s and subject_e <= end").select("evidence_id", "subject_id").distinct()
    o = evidence.join(of("object", "object"), ["note_id", "paragraph"]).where("start <= object_s and object_e <= end").select("evidence_id", "object_id").distinct()
    return s.join(o, "evidence_id").where("subject_id <> object_id")


def reconcile(local: DataFrame, registry: DataFrame) -> DataFrame:
    """Registry rows to append: local entities (kind, name) whose kind and name key are new, once each, with stable ids."""
    key = T.name_key(F.col("name"))
    new = local.select("kind", "name", key.alias("k")).where("k <> ''").join(registry.select("kind", key.alias("k")), ["kind", "k"], "left_anti")
    one = new.groupBy("kind", "k").agg(F.min("name").alias("name"))
    return one.select(T.stable_id("kg_", F.col("kind"), F.col("k")).alias("id"), "kind", "name")


def final_checks(relations: DataFrame, live: DataFrame) -> DataFrame:
    """(id, reason) of relations that may not be published: missing endpoint, self-loop, interval out of order, no evidence."""
    ids = live.select("id").distinct()
    r = relations.join(ids.withColumnRenamed("id", "s").withColumn("s_ok", F.lit(True)), F.col("subject_id") == F.col("s"), "left").join(ids.withColumnRenamed("id", "o").withColumn("o_ok", F.lit(True)), F.col("object_id") == F.col("o"), "left")
    reason = F.when(F.col("s_ok").isNull() | F.col("o_ok").isNull(), "missing_endpoint").when(F.col("subject_id") == F.col("object_id"), "self_loop").when(F.col("valid_from") >= F.col("valid_to"), "bad_interval").when(F.col("evidence_count") == 0, "no_evidence")
    return r.select(relations["id"], reason.alias("reason")).where("reason is not null")


def replay_events(relations: DataFrame, events: DataFrame) -> DataFrame:
    """Relations after confirm, suppress and end events; of several the later one counts, per kind of effect.

    events: op_index, relation_id, kind, value.
    """
    last = lambda kinds, value: F.max_by(value, F.when(F.col("kind").isin(*kinds), F.col("op_index")))
    e = events.groupBy(F.col("relation_id").alias("id")).agg(last(("confirm", "suppress"), "kind").alias("decision"), last(("end",), "value").alias("ended_at"))
    j = relations.join(e, "id", "left")
    return j.where(~F.coalesce(F.col("decision") == "suppress", F.lit(False))).withColumns({"origin": F.when(F.col("decision") == "confirm", "confirmed").otherwise(F.col("origin")), "valid_to": F.coalesce("ended_at", "valid_to")}).drop("decision", "ended_at")


def backbone(edges: DataFrame, nodes: DataFrame, max_nodes: int = 80, per_node: int = 3) -> DataFrame:
    """(at, id): the nodes of a readable overview in the order they come in. First the root of each component, then by turns
    each component's next node brings in its ``per_node`` best unseen neighbours. Of these a node needs the best
    ``max_nodes + per_node`` only, as no more can be seen, and only the nodes on show are collected. If no two nodes share an
    edge, the best edge takes the last places. edges: id, a, b, confidence, note_count; nodes: id, note_count, mention_total."""
    from talkgrid.operators import graph as G

    live = G.checkpoint(G.live_edges(edges.where("a <> b"), nodes).select("id", "a", "b", "confidence", "note_count"))
    ranks = G.ranked_components(live, nodes).select("root", "edges", "confidence").distinct()
    roots = [r.root for r in ranks.orderBy(F.desc("edges"), F.desc("confidence"), "root").limit(max_nodes).collect()]
    near = G.checkpoint(G.top_neighbours(live.select("id", F.col("a").alias("subject_id"), F.col("b").alias("object_id"), "confidence", "note_count"), max_nodes + per_node).select("node", "other", "n"))
    shown, queues, known = dict.fromkeys(roots), [[r] for r in roots], {}
    while len(shown) < max_nodes and per_node > 0 and any(queues):
        for q in queues:
            if not q or len(shown) >= max_nodes:
                continue
            if q[0] not in known:
                known |= {x: [] for y in queues for x in y if x not in known}
                for r in near.where(F.col("node").isin([x for y in queues for x in y])).orderBy("node", "n").collect():
                    known[r.node] = [*known[r.node], r.other] if r.n > len(known[r.node]) else known[r.node]
            for x in [x for x in known[q.pop(0)] if x not in shown][: min(per_node, max_nodes - len(shown))]:
                shown[x] = None
                q.append(x)
    ids = list(shown)
    if max_nodes >= 2 and live.where(F.col("a").isin(ids) & F.col("b").isin(ids)).isEmpty():
        best = live.orderBy(F.desc("confidence"), F.desc("note_count"), "id").limit(1).collect()
        ends = [x for r in best for x in (r.a, r.b)]
        missing = [x for x in ends if x not in shown]
        others = [x for x in ids if x not in ends]
        gone = set(others[len(others) - max(0, len(ids) + len(missing) - max_nodes) :])
        ids = [x for x in ids if x not in gone] + missing
    return edges.sparkSession.createDataFrame(list(enumerate(ids)), f"at int, id {nodes.schema['id'].dataType.simpleString()}")


def greedy_pairs(ranked: DataFrame, rounds: int = 40) -> DataFrame:
    """Of ranked pairs (a, b, rank) those that use each person once, in order of rank: every round takes the pairs that are
    first for both of their people, and drops whatever touches them. Pairs that are left after ``rounds`` (where all prefer
    the same few, a round settles one) are taken in one ordered pass, which holds the people taken and no pairs."""
    from talkgrid.operators.graph import checkpoint

    left, out = checkpoint(ranked.select("a", "b", "rank")), None
    order = F.struct("rank", "a", "b")
    for _ in range(rounds):
        if left.isEmpty():
            break
        tied = left.withColumn("order", order)
        sides = tied.select(F.col("a").alias("p"), "order").union(tied.select("b", "order")).groupBy("p").agg(F.min("order").alias("first"))
        pick = lambda s: sides.select(F.col("p").alias(s), F.col("first").alias(f"{s}_first"))
        hit = checkpoint(tied.join(pick("a"), "a").join(pick("b"), "b").where("order <=> a_first and order <=> b_first").select("a", "b", "rank"))
        out = hit if out is None else out.unionByName(hit)
        used = hit.select(F.col("a").alias("p")).union(hit.select("b"))
        left = checkpoint(left.join(used.withColumnRenamed("p", "a"), "a", "left_anti").join(used.withColumnRenamed("p", "b"), "b", "left_anti").select("a", "b", "rank"))
    if left.isEmpty():
        return left if out is None else out
    rest = left.repartition(1).sortWithinPartitions(order).mapInArrow(_first_come, left.schema)
    return rest if out is None else out.unionByName(rest)


def _first_come(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    used = set()
    for batch in batches:
        keep = []
        for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
            keep.append(a not in used and b not in used)
            used.update((a, b) if keep[-1] else ())
        yield batch.filter(pa.array(keep, pa.bool_()))


def evidence_tier(codes: Column, acoustic: Column, z: Column) -> Column:
    """High with two kinds of evidence and a voice that fits, Medium with one or a salient voice, else Low; a stated
    exclusion rejects."""
    n = F.size(F.array_distinct(codes))
    return F.when(F.array_contains(codes, "third_person_exclusion"), "Rejected").when((n >= 2) & acoustic, "High").when((n >= 1) | (F.coalesce(z, F.lit(0.0)) >= 3.0), "Medium").otherwise("Low")


def renumbered(clusters: DataFrame, existing: DataFrame) -> DataFrame:
    """New speaker numbers above the old maximum of each note, by cluster number."""
    top = existing.groupBy("note_id").agg(F.max("number").alias("_top"))
    n = F.dense_rank().over(Window.partitionBy("note_id").orderBy("cluster"))
    return clusters.join(top, "note_id", "left").withColumn("number", F.coalesce("_top", F.lit(0)) + n).drop("_top")


def lineage_roots(splits: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, root): where an entity came from, through chains of splits (child, parent) of any length. Chains are doubled each
    round, so as many rounds as a chain's length has binary digits do; a ring of splits is an error."""
    from talkgrid.operators.graph import checkpoint

    up = checkpoint(splits.select("child", "parent").where("child <> parent").distinct())
    goes_on = lambda: up.join(up.select(F.col("child").alias("parent")), "parent", "left_semi").count()
    open_ = goes_on()
    for _ in range(open_.bit_length() + 1):
        if not open_:
            break
        far = up.select(F.col("child").alias("parent"), F.col("parent").alias("far"))
        up = checkpoint(up.join(far, "parent", "left").select("child", F.coalesce("far", "parent").alias("parent")))
        open_ = goes_on()
    if open_:
        raise ValueError("splits lead in a ring")
    return ids.join(up, F.col("id") == F.col("child"), "left").select("id", F.coalesce("parent", "id").alias("root"))


def alias_union(base: DataFrame, more: DataFrame) -> DataFrame:
    """(id, name, aliases): new aliases whose key is neither the name's nor known; the first spelling stays, in order.

    base: id, name, aliases (array); more: id, pos, alias.
    """
    old = base.select("id", "name", F.posexplode_outer("aliases").alias("pos", "alias")).select("id", "name", F.lit(0).alias("g"), "pos", "alias")
    new = more.join(base.select("id", "name"), "id").select("id", "name", F.lit(1).alias("g"), "pos", "alias")
    k = T.name_key(F.col("alias"))
    kept = old.unionByName(new).where(F.col("alias").isNotNull() & (k != "") & (k != T.name_key(F.col("name")))).groupBy("id", k.alias("k")).agg(F.min(F.struct("g", "pos", "alias")).alias("x"))
    lists = kept.groupBy("id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["alias"]).alias("aliases"))
    return base.select("id", "name").join(lists, "id", "left").select("id", "name", F.coalesce("aliases", F.expr("cast(array() as array<string>)")).alias("aliases"))


def natural_key(t: Column) -> Column:
    """Sort key in which runs of digits compare as numbers: digits are padded to a fixed width."""
    parts = F.regexp_extract_all(F.lower(t), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 20, "0")).otherwise(p)), "")


def seq_fingerprint(seqs: Column) -> Column:
    """First 16 hexadecimal digits of SHA-256 over the sorted numbers as little-endian 64-bit values."""
    one = lambda n: F.unhex(F.array_join(F.reverse(F.regexp_extract_all(F.lpad(F.hex(n), 16, "0"), F.lit("(..)"), F.lit(1))), ""))
    raw = F.aggregate(F.array_sort(seqs), F.lit(b""), lambda acc, n: F.concat(acc, one(n)))
    return F.substring(F.sha2(raw, 256), 1, 16)


def hard_splits(levels: DataFrame, most: int, tail: float = 0.3, window: int = 1) -> DataFrame:
    """(key, at): all cuts of a session of more than ``most`` frames, each counted from the one before until the rest fits.
    A cut is the middle of the quietest ``window`` frames in the last part of the next ``most`` frames, the earliest of a
    tie; where no frames are there, the end of those ``most``. levels: key, i (from 0), level, n."""
    low = most - int(np.floor(most * tail))

    @F.pandas_udf("array<long>")
    def cuts(frames: pd.Series) -> pd.Series:
        return pd.Series([_cuts(np.array([x["i"] for x in f], np.int64), np.array([x["level"] for x in f], np.float64), most, low, window) for f in frames], dtype=object)

    long = levels.where(F.col("n") > most).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("i", "level"))).alias("frames"))
    return long.select("key", F.explode(cuts("frames")).alias("at"))


def _cuts(i: np.ndarray, level: np.ndarray, most: int, low: int, window: int) -> list[int]:
    level, off, out = np.where(np.isnan(level), np.inf, level), 0, []
    while not out or i[-1] + 1 - off > most:
        a, b = np.searchsorted(i, (off + low, off + most))
        at = off + most if a == b else off + low
        if b - a >= window and b > a:
            sums = np.lib.stride_tricks.sliding_window_view(level[a:b], window).sum(1)
            at = int(i[a + int(np.argmin(sums)) + window // 2])
        off = at if at > off else off + most
        out.append(off)
    return out


def valleys(frames: DataFrame, least: float = 0.55) -> DataFrame:
    """(key, at): the lowest pair of each run of adjacent similarities under the threshold. frames: key, i, sim."""
    low = frames.where(F.col("sim") < least)
    w = Window.partitionBy("key").orderBy("i")
    g = low.withColumn("_new", F.when(F.col("i") - F.lag("i").over(w) == 1, 0).otherwise(1)).withColumn("run", F.sum("_new").over(w))
    return g.groupBy("key", "run").agg(F.min_by("i", F.struct("sim", "i")).alias("at")).select("key", "at")


def ransac_line(points: DataFrame, tol: float, share: float = 0.4, slopes: tuple[float, float] = (0.80, 1.25)) -> DataFrame:
    """(key, slope, inliers): the line through two of a key's knots with the most knots near it (the first of a tie by its
    knots), refitted to those; none under the share. Every pair is tried, within one key's task; the knots of one alignment
    are some hundreds. points: key, x, y."""

    def best(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.dropna(subset=["x", "y"]).sort_values(["x", "y"])
        x, y = g["x"].to_numpy(float), g["y"].to_numpy(float)
        top = (0, None)
        for i in range(len(x)):
            with np.errstate(divide="ignore", invalid="ignore"):
                m = (y - y[i]) / (x - x[i])
            ends = np.flatnonzero((x > x[i]) & (m >= slopes[0]) & (m <= slopes[1]))
            for e in ends.tolist():
                near = np.abs(y - y[i] - m[e] * (x - x[i])) <= tol
                if near.sum() > top[0]:
                    top = (int(near.sum()), near)
        n, near = top
        if near is None or n < share * len(g):
            return pd.DataFrame({"key": [], "slope": [], "inliers": []})
        dx = x[near] - x[near].mean()
        return pd.DataFrame({"key": [key[0]], "slope": [float(dx @ (y[near] - y[near].mean()) / (dx @ dx))], "inliers": [n]})

    return points.groupBy("key").applyInPandas(best, f"key {points.schema['key'].dataType.simpleString()}, slope double, inliers long")


def release_envelope(values: Column, factor: float = 0.7) -> Column:
    """max(sample, previous x factor) along an ordered array, in one pass over each; null for a null array."""

    @F.pandas_udf("array<double>")
    def run(arrays: pd.Series) -> pd.Series:
        out = []
        for a in arrays:
            last, env = 0.0, []
            for x in a if a is not None else ():
                last = max(float(x), last * factor)
                env.append(last)
            out.append(None if a is None else env)
        return pd.Series(out)

    return run(values.cast("array<double>"))
