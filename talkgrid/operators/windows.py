"""Window operators: paragraphs, runs, boundaries, budgets, packing, smoothing and islands."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER = ("start_ms", "seq")


def paragraphs(segments: DataFrame, cap_ms: int = 60_000) -> DataFrame:
    """Merges a speaker's consecutive segments until a paragraph would last longer than the cap.

    The cap restarts with each paragraph, so this is a fold over a note's ordered segments; it runs inside the JVM as
    an aggregate over one sorted array a note, and a note is one conversation's segments.
    """
    row = F.struct("start_ms", "seq", "end_ms", "speaker", "text")
    per = segments.groupBy("note_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    kind = "array<struct<speaker:string,start_ms:bigint,end_ms:bigint,text:string,seqs:array<bigint>>>"

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joins = (F.size(acc) > 0) & last["speaker"].eqNullSafe(x["speaker"]) & (x["end_ms"] - last["start_ms"] <= cap_ms)
        more = F.struct(last["speaker"].alias("speaker"), last["start_ms"].alias("start_ms"), F.greatest(last["end_ms"], x["end_ms"]).alias("end_ms"), F.concat(last["text"], F.lit(" "), x["text"]).alias("text"), F.concat(last["seqs"], F.array(x["seq"])).alias("seqs"))
        new = F.struct(x["speaker"].alias("speaker"), x["start_ms"].alias("start_ms"), x["end_ms"].alias("end_ms"), x["text"].alias("text"), F.array(x["seq"]).alias("seqs"))
        return F.when(joins, F.concat(F.slice(acc, 1, F.greatest(F.lit(0), F.size(acc) - 1)), F.array(more))).otherwise(F.concat(acc, F.array(new)))

    folded = per.select("note_id", F.aggregate("rows", F.expr(f"cast(array() as {kind})"), step).alias("ps"))
    return folded.select("note_id", F.posexplode("ps").alias("paragraph", "p")).select("note_id", "paragraph", "p.*")


def runs(segments: DataFrame, key: str = "speaker") -> DataFrame:
    """Adds ``run``: the number of the stretch of equal keys within a note."""
    w = Window.partitionBy("note_id").orderBy(*ORDER)
    new = F.when(~F.col(key).eqNullSafe(F.lag(key).over(w)) | (F.row_number().over(w) == 1), 1).otherwise(0)
    return segments.withColumn("_new", new).withColumn("run", F.sum("_new").over(w)).drop("_new")


def boundaries(segments: DataFrame) -> DataFrame:
    """Rows on either side of a change of speaker."""
    w = Window.partitionBy("note_id").orderBy(*ORDER)
    near = lambda f: ~F.col("speaker").eqNullSafe(f("speaker").over(w)) & f("seq").over(w).isNotNull()
    return segments.withColumn("_b", near(F.lag) | near(F.lead)).where("_b").drop("_b")


def openings(df: DataFrame, n: int = 2) -> DataFrame:
    """The first ``n`` rows of each speaker in a note."""
    w = Window.partitionBy("note_id", "speaker").orderBy(*ORDER)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def within_budget(df: DataFrame, budget: int = 6000, most: int = 200) -> DataFrame:
    """Rows of each note, in order, while the running length of their texts (each counted up to ``most``) fits."""
    w = Window.partitionBy("note_id").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("used", F.sum(F.least(F.char_length("text"), F.lit(most))).over(w)).where(F.col("used") <= budget)


def pack_chunks(df: DataFrame, budget: int = 3000) -> DataFrame:
    """Greedy chunks of a note's rows, in order; a row over the budget stands alone. Adds ``chunk``."""
    def fold(state: Column, n: Column) -> Column:
        fits = (state["used"] + n <= budget) | (state["used"] == 0)
        chunk = F.when(fits, state["chunk"]).otherwise(state["chunk"] + 1)
        return F.struct(chunk.alias("chunk"), F.when(fits, state["used"] + n).otherwise(n).alias("used"), F.concat(state["all"], F.array(chunk)).alias("all"))

    per = df.groupBy("note_id").agg(F.array_sort(F.collect_list(F.struct(*ORDER, F.char_length("text").cast("long").alias("n")))).alias("rows"))
    start = F.expr("named_struct('chunk', 0L, 'used', 0L, 'all', cast(array() as array<bigint>))")
    folded = per.select("note_id", "rows", F.aggregate(F.transform("rows", lambda x: x["n"]), start, fold)["all"].alias("chunks"))
    return folded.select("note_id", F.explode(F.arrays_zip("rows", "chunks")).alias("x")).select("note_id", F.col("x.rows.seq").alias("seq"), F.col("x.rows.n").alias("n"), F.col("x.chunks").alias("chunk"))


def moving_average(df: DataFrame, key: str, order: str, value: str, side: int = 2) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumns({"smooth": F.avg(value).over(w.rowsBetween(-side, side)), "peak": F.max(value).over(w.rowsBetween(-20, 0))})


def islands(df: DataFrame, key: str, order: str, flag: Column, gap: int, least: int) -> DataFrame:
    """Runs of true flags: (key, first, last); runs with ``gap`` or less between them join, those shorter than ``least`` go."""
    on = df.where(flag)
    w = Window.partitionBy(key).orderBy(order)
    new = F.when(F.col(order) - F.lag(order).over(w) <= gap, 0).otherwise(1)
    grouped = on.withColumn("_new", new).withColumn("island", F.sum("_new").over(w))
    out = grouped.groupBy(key, "island").agg(F.min(order).alias("first"), F.max(order).alias("last"))
    return out.where(F.col("last") - F.col("first") + 1 >= least).select(key, "first", "last")


def repeat_collapse(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Runs of a unit of 1 to 8 characters that repeat (8 times a single one, 6 a longer) shrink to two; short units first."""

    def one(t: str | None) -> str | None:
        if not t:
            return t
        for unit in range(1, 9):
            need, i, out = (8 if unit == 1 else 6), 0, []
            while i < len(t):
                u, n = t[i : i + unit], 1
                if len(u) == unit:
                    while t[i + n * unit : i + (n + 1) * unit] == u:
                        n += 1
                if n >= need:
                    out.append(u * 2)
                    i += n * unit
                else:
                    out.append(t[i])
                    i += 1
            t = "".join(out)
        return t

    for s in texts:
        yield s.map(one)


def select_range(rows: DataFrame, key: str, order: list[str], low: int, high: int) -> DataFrame:
    """Rows ``low`` to ``high`` (from 1) of each key in order, with their number ``n``."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long")
    return rows.withColumn("n", n).where(F.col("n").between(min(low, high), max(low, high)))


def latest(rows: DataFrame, key: str, order: list[Column], most: int = 5) -> DataFrame:
    """A ring: the ``most`` newest rows of each key, ``n`` counting from the newest."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long")
    return rows.withColumn("n", n).where(F.col("n") <= most)


def edge_lanes(edges: DataFrame, a: str, b: str, order: list[str]) -> DataFrame:
    """Lanes of parallel edges: a pair's edges lie evenly on both sides of 0."""
    pair = Window.partitionBy(F.least(a, b), F.greatest(a, b))
    return edges.withColumn("lane", F.row_number().over(pair.orderBy(*order)) - 1 - (F.count(F.lit(1)).over(pair) - 1) / 2.0)


def peak_bars(rows: DataFrame, value: str, floor: float = 0.05, key: str | None = None) -> DataFrame:
    """``bar``: values by the largest of their key (or of all), which counts as ``floor`` at least."""
    keys = [key] if key else []
    top = rows.groupBy(*keys).agg(F.max(value).alias("_top"))
    j = rows.join(top, key, "left") if key else rows.crossJoin(F.broadcast(top))  # one row
    return j.withColumn("bar", F.col(value) / F.greatest("_top", F.lit(floor))).drop("_top")


def elements_at(rows: DataFrame, value: str, places: dict[str, tuple[int, int]]) -> DataFrame:
    """One row: the element n * a div b (from 0) of all sorted values for each name and (a, b). A value's rank comes from
    counts of the values before it, by ranges, so no task sorts the whole column; nulls don't count."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).count()
    bound = F.floor("v")
    per = counts.groupBy(bound.alias("b")).agg(F.sum("count").alias("n"))
    before = per.withColumn("before", F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)))
    w = Window.partitionBy("b").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = counts.withColumn("b", bound).join(before.select("b", "before"), "b").withColumn("upto", F.coalesce("before", F.lit(0)) + F.sum("count").over(w))
    at = upto.crossJoin(F.broadcast(counts.agg(F.sum("count").alias("total"))))  # one row
    pick = lambda a, b: F.min(F.when(F.col("upto") > F.expr(f"total * {a} div {b}"), F.col("v")))
    return at.agg(*[pick(a, b).alias(n) for n, (a, b) in places.items()])


def tumbling(rows: DataFrame, keys: list[str], ts: str, width: str, *aggregates: Column) -> DataFrame:
    """Aggregates by keys and windows of ``width`` that follow each other; ``start`` begins a window. Works on streams too."""
    return rows.groupBy(*keys, F.window(ts, width).alias("_w")).agg(*aggregates).withColumn("start", F.col("_w.start")).drop("_w")


def first_of_bucket(rows: DataFrame, key: str, ts: str, order: str, width: str) -> DataFrame:
    """The first row of each key in each window of ``width``: key, ts and the ordering column."""
    g = rows.groupBy(key, F.window(ts, width)).agg(F.min(F.struct(ts, order)).alias("x"))
    return g.select(key, f"x.{ts}", f"x.{order}")


def rate_limited(rows: DataFrame, kind: str, ts: str, order: str, per_kind: int = 5, in_all: int = 50, unit: str = "hour") -> DataFrame:
    """What passes a limit of ``per_kind`` rows of a kind and ``in_all`` rows in every calendar unit, in order; the unit's
    start is ``bucket``. A unit's rows past the first limit are few, so the second one sorts kinds times ``per_kind`` rows."""
    e = rows.withColumn("bucket", F.date_trunc(unit, ts))
    k = F.row_number().over(Window.partitionBy("bucket", kind).orderBy(ts, order))
    total = F.row_number().over(Window.partitionBy("bucket").orderBy(ts, order))
    return e.withColumn("_k", k).where(F.col("_k") <= per_kind).withColumn("_n", total).where(F.col("_n") <= in_all).drop("_k", "_n")


def silence_sessions(rows: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """(key, start, end, n): sessions that a silence of ``gap`` closes. Works on streams too."""
    s = rows.groupBy(key, F.session_window(ts, gap).alias("_s")).agg(F.max(ts).alias("end"), F.count(F.lit(1)).alias("n"))
    return s.select(key, F.col("_s.start").alias("start"), "end", "n")


def burst_peak(rows: DataFrame, key: str, ts: str, trailing_us: int) -> DataFrame:
    """(key, peak): most rows of a key within a trailing span, both ends included."""
    w = Window.partitionBy(key).orderBy(F.unix_micros(F.to_timestamp(ts))).rangeBetween(-trailing_us, 0)
    return rows.select(key, F.count(F.lit(1)).over(w).alias("n")).groupBy(key).agg(F.max("n").alias("peak"))
