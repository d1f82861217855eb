"""Queries with windows, islands, budgets, time and streaming equivalents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from talkgrid.functions import timefn as D
from talkgrid.operators import windows as W
from talkgrid.plans import views as V
from talkgrid.plans.registry import query


@query(f"""WITH RECURSIVE {V.SEG}, o AS (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY start_ms, seq) AS rn FROM seg),
walk AS (SELECT note_id, rn, speaker, start_ms AS p0, 0 AS paragraph FROM o WHERE rn = 1
UNION ALL SELECT o.note_id, o.rn, o.speaker, CASE WHEN o.speaker IS NOT DISTINCT FROM w.speaker AND o.end_ms - w.p0 <= 60000 THEN w.p0 ELSE o.start_ms END,
CASE WHEN o.speaker IS NOT DISTINCT FROM w.speaker AND o.end_ms - w.p0 <= 60000 THEN w.paragraph ELSE w.paragraph + 1 END FROM walk w JOIN o ON o.note_id = w.note_id AND o.rn = w.rn + 1)
SELECT note_id, paragraph, min(o.speaker) AS speaker, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n, string_agg(text, ' ' ORDER BY rn) AS text
FROM o JOIN walk USING (note_id, rn) GROUP BY 1, 2""")
def paragraphs(spark, d):
    """W02"""
    p = W.paragraphs(V.segments(spark, d))
    return p.select("note_id", F.col("paragraph").cast("long").alias("paragraph"), "speaker", "start_ms", "end_ms", F.size("seqs").cast("long").alias("n"), "text")


@query(f"""WITH {V.SEG}, m AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR speaker IS DISTINCT FROM lag(speaker) OVER w THEN 1 ELSE 0 END AS new FROM seg WINDOW w AS (PARTITION BY note_id ORDER BY start_ms, seq))
SELECT note_id, seq, CAST(sum(new) OVER (PARTITION BY note_id ORDER BY start_ms, seq) AS BIGINT) AS run FROM m""")
def speaker_runs(spark, d):
    """W03"""
    return W.runs(V.segments(spark, d)).select("note_id", "seq", "run")


@query(f"WITH {V.SEG}, r AS (SELECT note_id, seq, row_number() OVER (PARTITION BY note_id ORDER BY start_ms, seq) AS n FROM seg) SELECT note_id, seq, n FROM r WHERE n BETWEEN 2 AND 4")
def range_selection(spark, d):
    """W04"""
    return W.select_range(V.segments(spark, d), "note_id", ["start_ms", "seq"], 2, 4).select("note_id", "seq", "n")


@query(f"WITH {V.SEG}, r AS (SELECT note_id, speaker, seq, row_number() OVER (PARTITION BY note_id, speaker ORDER BY start_ms, seq) AS rank FROM seg) SELECT * FROM r WHERE rank <= 2")
def first_two_per_speaker(spark, d):
    """W05"""
    return W.openings(V.segments(spark, d)).select("note_id", "speaker", "seq", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {V.SEG}, m AS (SELECT note_id, seq, speaker, lag(speaker) OVER w AS a, lag(seq) OVER w AS pa, lead(speaker) OVER w AS b, lead(seq) OVER w AS pb FROM seg WINDOW w AS (PARTITION BY note_id ORDER BY start_ms, seq))
SELECT note_id, seq, speaker FROM m WHERE (pa IS NOT NULL AND a IS DISTINCT FROM speaker) OR (pb IS NOT NULL AND b IS DISTINCT FROM speaker)""")
def speaker_boundaries(spark, d):
    """W06"""
    return W.boundaries(V.segments(spark, d)).select("note_id", "seq", "speaker")


@query(f"WITH {V.SEG}, m AS (SELECT note_id, seq, CAST(sum(least(length(text), 200)) OVER (PARTITION BY note_id ORDER BY start_ms, seq) AS BIGINT) AS used FROM seg) SELECT * FROM m WHERE used <= 600")
def character_budget(spark, d):
    """W07"""
    return W.within_budget(V.segments(spark, d), 600).select("note_id", "seq", F.col("used").cast("long").alias("used"))


@query(f"""WITH RECURSIVE {V.SEG}, o AS (SELECT note_id, seq, length(text) AS n, row_number() OVER (PARTITION BY note_id ORDER BY start_ms, seq) AS rn FROM seg),
walk AS (SELECT note_id, rn, n AS used, 0 AS chunk FROM o WHERE rn = 1 UNION ALL
SELECT o.note_id, o.rn, CASE WHEN w.used + o.n <= 500 OR w.used = 0 THEN w.used + o.n ELSE o.n END, CASE WHEN w.used + o.n <= 500 OR w.used = 0 THEN w.chunk ELSE w.chunk + 1 END FROM walk w JOIN o ON o.note_id = w.note_id AND o.rn = w.rn + 1)
SELECT note_id, seq, n, chunk FROM o JOIN walk USING (note_id, rn)""".replace("SELECT note_id, seq, n, chunk FROM o JOIN walk", "SELECT note_id, seq, o.n, chunk FROM o JOIN walk"))
def chunk_packing(spark, d):
    """W08"""
    return W.pack_chunks(V.segments(spark, d), 500)


@query("""SELECT user_id, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth,
max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) AS peak FROM events""")
def smoothing(spark, d):
    """W09, W10"""
    e = W.moving_average(V.table(spark, d, "events"), "user_id", "event_id", "value")
    return e.select("user_id", "event_id", F.round("smooth", 6).alias("smooth"), "peak")


@query("""WITH f AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, value FROM events), t AS (SELECT *, CASE WHEN n - lag(n) OVER (PARTITION BY user_id ORDER BY n) <= 2 THEN 0 ELSE 1 END AS new FROM f WHERE value > 20),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY n) AS island FROM t) SELECT user_id, min(n) AS first, max(n) AS last FROM g GROUP BY user_id, island HAVING max(n) - min(n) + 1 >= 3""")
def gap_islands(spark, d):
    """W11"""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long")
    e = V.table(spark, d, "events").select("user_id", "value", n.alias("n"))
    return W.islands(e, "user_id", "n", F.col("value") > 20, 2, 3)


@query("""WITH c AS (SELECT count(*) AS n FROM events), r AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i FROM events)
SELECT max(CASE WHEN i = n // 2 THEN value END) AS median, max(CASE WHEN i = n * 9 // 10 THEN value END) AS p90 FROM r, c WHERE value IS NOT NULL""")
def global_percentiles(spark, d):
    """Elements n/2 and 9n/10 of the sorted values."""
    return W.elements_at(V.table(spark, d, "events"), "value", {"median": (1, 2), "p90": (9, 10)})


@query(f"""WITH {V.REL}, l AS (SELECT subject_id, object_id, row_number() OVER w AS i, count(*) OVER (PARTITION BY least(subject_id, object_id), greatest(subject_id, object_id)) AS n FROM rel
WINDOW w AS (PARTITION BY least(subject_id, object_id), greatest(subject_id, object_id) ORDER BY subject_id, object_id)) SELECT subject_id, object_id, i - 1 - (n - 1) / 2.0 AS lane FROM l""")
def edge_lanes(spark, d):
    """W16"""
    return W.edge_lanes(V.relations(spark, d), "subject_id", "object_id", ["subject_id", "object_id"]).select("subject_id", "object_id", "lane")


@query("SELECT * FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE value >= 10) WHERE n <= 5")
def bounded_ring(spark, d):
    """The latest five of each source."""
    e = V.table(spark, d, "events").where("value >= 10")
    return W.latest(e, "user_id", [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "n")


@query("SELECT event_id, round(value / greatest((SELECT max(value) FROM events), 0.05), 6) AS bar FROM events")
def peak_bars(spark, d):
    """W18"""
    return W.peak_bars(V.table(spark, d, "events"), "value").select("event_id", F.round("bar", 6).alias("bar"))


@query(f"WITH {V.SEG} SELECT a.note_id, a.seq AS seq, b.seq AS other, greatest(0, least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms)) AS shared_ms FROM seg a JOIN seg b ON a.note_id = b.note_id AND a.seq < b.seq AND ((a.start_ms <= b.end_ms AND b.start_ms <= a.end_ms) OR abs(a.start_ms - b.start_ms) < 5500)")
def time_near_pairs(spark, d):
    """M03, M04, A27"""
    a, b = V.segments(spark, d).alias("a"), V.segments(spark, d).alias("b")
    c = {f"{t}{n}": F.col(f"{t}.{x}_ms") for t in "ab" for n, x in enumerate(("start", "end"))}
    on = (F.col("a.note_id") == F.col("b.note_id")) & (F.col("a.seq") < F.col("b.seq")) & D.time_near(c["a0"], c["a1"], c["b0"], c["b1"], 5500)
    return a.join(b, on).select("a.note_id", "a.seq", F.col("b.seq").alias("other"), D.overlap(c["a0"], c["a1"], c["b0"], c["b1"]).cast("long").alias("shared_ms"))


@query("""SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2, 3""")
def tumbling_hours(spark, d):
    """Tumbling windows by source and kind."""
    t = W.tumbling(V.table(spark, d, "events"), ["user_id", "event_type"], "ts", "1 hour", F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return t.select("user_id", F.col("start").alias("hour"), "event_type", "n", "total")


@query("""WITH r AS (SELECT event_id, event_type, time_bucket(INTERVAL 1 HOUR, ts) AS hour, row_number() OVER (PARTITION BY time_bucket(INTERVAL 1 HOUR, ts), event_type ORDER BY ts, event_id) AS k, ts FROM events),
t AS (SELECT *, row_number() OVER (PARTITION BY hour ORDER BY ts, event_id) AS total FROM r WHERE k <= 5) SELECT event_id, event_type, hour FROM t WHERE total <= 50""")
def rate_limit(spark, d):
    """Five of a kind and fifty in all an hour."""
    return W.rate_limited(V.table(spark, d, "events"), "event_type", "ts", "event_id").select("event_id", "event_type", F.col("bucket").alias("hour"))


@query("""WITH m AS (SELECT user_id, event_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) < 6 * 3600 * 1000000::BIGINT THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM m) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, session""")
def silence_sessions(spark, d):
    """Sessions close after six hours of silence."""
    return W.silence_sessions(V.table(spark, d, "events"), "user_id", "ts", "6 hours").select("user_id", "start", "n")


@query("""SELECT user_id, max(n) AS peak FROM (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS n FROM events) GROUP BY 1""")
def burst_peak(spark, d):
    """Most events of a source within a trailing day."""
    return W.burst_peak(V.table(spark, d, "events"), "user_id", "ts", 86_400_000_000)


@query("SELECT event_id, user_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, time_bucket(INTERVAL 10 MINUTE, ts) ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def down_sampled(spark, d):
    """The first value of each ten minutes."""
    return W.first_of_bucket(V.table(spark, d, "events"), "user_id", "ts", "event_id", "10 minutes").select("event_id", "user_id", "ts")


@query(f"WITH {V.SEG} SELECT note_id, seq, start_ms * 16 AS first_sample, (end_ms - start_ms) * 16 AS samples FROM seg")
def samples_of_segments(spark, d):
    """D08"""
    return V.segments(spark, d).select("note_id", "seq", D.ms_to_samples(F.col("start_ms")).alias("first_sample"), D.ms_to_samples(F.col("end_ms") - F.col("start_ms")).alias("samples"))


@query("SELECT event_type, quarter_of AS q, count(*) AS n FROM (SELECT event_type, CASE WHEN value < 300 THEN 0 ELSE 1 END AS quarter_of FROM events) GROUP BY 1, 2")
def alarm_counts(spark, d):
    """Rows above and below an alarm's threshold."""
    return V.table(spark, d, "events").groupBy("event_type", F.when(F.col("value") < 300, 0).otherwise(1).alias("q")).agg(F.count(F.lit(1)).alias("n"))
