"""Queries of joins, unions and small rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkgrid.functions import rules as R
from talkgrid.functions import vector as M
from talkgrid.operators import joins as J
from talkgrid.operators import people as P
from talkgrid.operators import windows as W
from talkgrid.plans import views as V
from talkgrid.plans.registry import query

#: Segments shifted and stretched, as a second transcript of the same notes.
_TWO = f"{V.SEG}, a AS (SELECT *, seq % 2 AS source FROM seg), b AS (SELECT note_id, seq, speaker, text, start_ms + 1500 AS start_ms, end_ms + 2500 AS end_ms, seq % 3 % 2 AS source FROM seg)"
_SHARE = "greatest(0, least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms))"


def _two(spark, d):
    s = V.segments(spark, d)
    a = s.withColumn("source", F.col("seq") % 2)
    b = s.select("note_id", "seq", "speaker", "text", (F.col("start_ms") + 1500).alias("start_ms"), (F.col("end_ms") + 2500).alias("end_ms"), (F.col("seq") % 3 % 2).alias("source"))
    return a, b


@query("SELECT l_orderkey AS note_id, l_linenumber AS speaker_id, l_partkey AS person_id, CASE WHEN l_linenumber = 1 THEN 'me' ELSE p_name END AS name FROM lineitem LEFT JOIN part ON l_partkey = p_partkey")
def display_names(spark, d):
    """J16"""
    s = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("note_id"), F.col("l_linenumber").alias("speaker_id"), F.col("l_partkey").alias("person_id"), F.when(F.col("l_linenumber") == 1, "me").otherwise("").alias("name"))
    return J.display_names(s, V.entities(spark, d))


@query(f"WITH {V.SEG}, v AS (SELECT note_id, seq // 4 AS paragraph, speaker, count(*) AS n FROM seg WHERE speaker IS NOT NULL GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY note_id, paragraph ORDER BY n DESC, speaker DESC) AS k FROM v) SELECT note_id, paragraph, speaker FROM r WHERE k = 1")
def paragraph_speakers(spark, d):
    """Paragraphs of four turns; ties go to the greatest name."""
    s = V.segments(spark, d)
    p = s.groupBy("note_id", F.expr("seq div 4").alias("paragraph")).agg(F.collect_list("seq").alias("seqs"))
    return J.paragraph_speakers(p, s)


@query('SELECT CAST(-1 - c.c_nationkey AS BIGINT) AS person_id, count(DISTINCT o.o_orderkey) AS notes FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1')
def notes_of_people(spark, d):
    """Nations stand for the people that customers are redirected to."""
    c = V.table(spark, d, "customer")
    to = c.select(F.col("c_custkey").alias("old_id"), (-1 - F.col("c_nationkey")).cast("long").alias("new_id"))
    o = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("note_id"), F.col("o_custkey").cast("long").alias("person_id"))
    return P.notes_of_people(o, to)


@query(f"""WITH {_TWO}, p AS (SELECT a.note_id, a.seq, b.speaker, b.seq AS o, a.source = b.source AS same, {_SHARE} / (a.end_ms - a.start_ms) AS share FROM a JOIN b ON a.note_id = b.note_id AND a.start_ms < b.end_ms AND b.start_ms < a.end_ms),
r AS (SELECT *, row_number() OVER (PARTITION BY note_id, seq ORDER BY same DESC, share DESC, o) AS k FROM p WHERE share >= 0.3) SELECT note_id, seq, speaker FROM r WHERE k = 1""")
def inherited_speakers(spark, d):
    """J29"""
    return J.inherit_speakers(*_two(spark, d))


@query(None)
def offline_echoes(spark, d):
    """J30"""
    return J.echoes(*_two(spark, d))


@query(f"WITH {_TWO}, p AS (SELECT a.note_id, a.seq, sum({_SHARE}) AS ms FROM a JOIN b ON a.note_id = b.note_id AND a.start_ms < b.end_ms AND b.start_ms < a.end_ms WHERE b.seq % 2 = 0 GROUP BY 1, 2) SELECT a.note_id, a.seq, round(CASE WHEN end_ms > start_ms THEN coalesce(ms, 0) / (end_ms - start_ms) ELSE 0.0 END, 6) AS covered FROM a LEFT JOIN p ON a.note_id = p.note_id AND a.seq = p.seq")
def gate_coverage(spark, d):
    """J31"""
    a, b = _two(spark, d)
    return J.coverage(a, b.where("seq % 2 = 0")).select("note_id", "seq", F.round("covered", 6).alias("covered"))


@query(f"WITH {_TWO}, p AS (SELECT a.speaker AS cluster, b.speaker AS label, sum({_SHARE}) AS ms FROM a JOIN b ON a.note_id = b.note_id AND a.start_ms < b.end_ms AND b.start_ms < a.end_ms GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY ms DESC, label) AS k, ms / sum(ms) OVER (PARTITION BY cluster) AS share FROM p) SELECT cluster, label, round(share, 6) AS share FROM r WHERE k = 1")
def cluster_purity(spark, d):
    """A20"""
    a, b = _two(spark, d)
    p = J.purity(a.withColumnRenamed("speaker", "label"), b.withColumnRenamed("speaker", "label"))
    return p.select("cluster", "label", F.round("share", 6).alias("share"))


@query(f"""WITH {_TWO}, n AS (SELECT note_id, min(start_ms) AS s, max(end_ms) AS e FROM a GROUP BY 1), p AS (SELECT n.note_id, b.seq AS event_id, least(e, end_ms) - greatest(s, start_ms) AS ms FROM n JOIN b ON n.note_id = b.note_id AND s < end_ms AND start_ms < e WHERE b.seq % 5 <> 4),
r AS (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY ms DESC, event_id) AS k, lead(ms) OVER (PARTITION BY note_id ORDER BY ms DESC, event_id) AS nx FROM p) SELECT note_id, event_id FROM r WHERE k = 1 AND (nx IS NULL OR ms - nx > 1000)""")
def calendar_matches(spark, d):
    """J32"""
    a, b = _two(spark, d)
    n = a.groupBy("note_id").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    e = b.select("note_id", F.col("seq").alias("event_id"), "start_ms", "end_ms", (F.col("seq") % 5 == 4).alias("all_day"))
    return J.best_event(n, e)



@query("""WITH c AS (SELECT c_custkey AS id, lower(trim(c_name)) AS n, lower(trim(c_mktsegment || CAST(c_nationkey AS VARCHAR))) AS e FROM customer), m AS (SELECT x.id AS attendee_id, y.id AS person_id, 1 AS rank FROM c x JOIN (SELECT e, min(id) AS id FROM c GROUP BY 1) y ON x.e = y.e UNION ALL SELECT x.id, y.id, 2 FROM c x JOIN (SELECT n, min(id) AS id FROM c GROUP BY 1) y ON x.n = y.n)
SELECT attendee_id, arg_min(person_id, rank * 1000000000 + person_id) AS person_id FROM m GROUP BY 1""")
def attendee_people(spark, d):
    """All customers are people."""
    c = V.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).alias("email"))
    return J.attendee_people(c.withColumnRenamed("id", "attendee_id"), c)



@query("""WITH e AS (SELECT event_id, user_id % 3 AS source, event_id * 1000 AS t FROM events), p AS (SELECT event_id AS position_id, user_id % 3 AS source, event_id * 1000 + 300 AS pos FROM events WHERE event_id % 9 = 0), x AS (SELECT e.event_id, e.source, t, p.position_id AS before_id, t - pos AS before_ms FROM e ASOF LEFT JOIN p ON e.source = p.source AND t >= pos), y AS (SELECT e.event_id, p.position_id AS after_id, pos - t AS after_ms FROM e ASOF LEFT JOIN p ON e.source = p.source AND t <= pos)
SELECT event_id, CASE WHEN after_ms IS NULL OR before_ms <= after_ms THEN before_id ELSE after_id END AS position_id FROM x JOIN y USING (event_id)""")
def nearest_positions(spark, d):
    """At any distance; every event has a row."""
    return J.nearest_position(*_timeline(spark, d), 20_000).select("event_id", "position_id")


def _timeline(spark, d):
    """Events, and every ninth of them, 300 ms later, as the positions of its source."""
    e = V.table(spark, d, "events").select("event_id", (F.col("user_id") % 3).alias("source"), (F.col("event_id") * 1000).alias("t"))
    p = e.where("event_id % 9 = 0").select(F.col("event_id").alias("position_id"), "source", (F.col("t") + 300).alias("at"))
    return e, p


@query("SELECT doc_id, CASE WHEN t.toxic IS NULL THEN 'missing' WHEN t.toxic = q.quality THEN 'correct' ELSE 'wrong' END AS outcome FROM (SELECT doc_id, quality FROM labels) q LEFT JOIN (SELECT doc_id, toxic FROM labels WHERE doc_id % 4 <> 0) t USING (doc_id)")
def prediction_outcomes(spark, d):
    """J36"""
    t = V.table(spark, d, "labels")
    return J.outcomes(t.select("doc_id", F.col("quality").alias("want")), t.where("doc_id % 4 <> 0").select("doc_id", F.col("toxic").alias("got")), "doc_id")


@query("""SELECT group_rank, kind, id FROM (SELECT 0 AS group_rank, 'receipt' AS kind, CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT 1, 'name', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_nationkey = 3) WHERE NOT (kind = 'receipt' AND CAST(id AS BIGINT) % 2 = 0)""")
def tidy_queue(spark, d):
    """A24, U11"""
    o = V.table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("id"))
    c = V.table(spark, d, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("id"))
    gone = V.table(spark, d, "orders").where("o_orderkey % 2 = 0").select(F.lit("receipt").alias("kind"), F.col("o_orderkey").cast("string").alias("id"))
    return J.tidy_queue([("receipt", o), ("name", c)], gone)


@query("SELECT count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def people_without_samples(spark, d):
    """A25, J38"""
    people = V.table(spark, d, "customer").select(F.col("c_custkey").alias("person_id"))
    samples = V.table(spark, d, "orders").select(F.col("o_custkey").alias("person_id"))
    return P.without_samples(people, samples).agg(F.count(F.lit(1)).alias("n"))



@query("""WITH a AS (SELECT l_partkey AS person_id, l_suppkey AS cluster, max(l_extendedprice) AS sim FROM lineitem GROUP BY 1, 2), t AS (SELECT person_id, [0, cluster, n] AS o FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY sim DESC, person_id) AS n FROM a) WHERE n <= 5),
b AS (SELECT p_partkey AS person_id, [1, -p_size, 0] AS o FROM (SELECT * FROM part ORDER BY p_size DESC, p_partkey LIMIT 10)), c AS (SELECT p_partkey AS person_id, [2, p_partkey, 0] AS o FROM part)
SELECT person_id FROM (SELECT person_id, min(o) AS o FROM (SELECT * FROM t UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) GROUP BY 1) ORDER BY o, person_id LIMIT 30""")
def identity_candidates(spark, d):
    """All suppliers are clusters, all parts adopted; the 30 first are the operator's result."""
    a = V.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("person_id"), F.col("l_suppkey").alias("cluster")).agg(F.max("l_extendedprice").alias("sim"))
    p = V.table(spark, d, "part")
    return J.candidates(a, p.select(F.col("p_partkey").alias("person_id"), F.col("p_size").alias("seen")), p.select(F.col("p_partkey").alias("person_id"))).select("person_id")


@query("""WITH g AS (SELECT l_orderkey AS note_id, lower(trim(p_brand)) AS k, min(l_linenumber) AS pos, arg_min(p_brand, l_linenumber) AS name, array_to_string(list_sort(list(DISTINCT p_type)), ',') AS aliases FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT note_id, 'ent_' || CAST(row_number() OVER (PARTITION BY note_id ORDER BY pos, k) AS VARCHAR) AS entity, name, aliases FROM g""")
def first_seen_entities(spark, d):
    """U02, N30"""
    p = V.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("name"), F.col("p_type").alias("alias"))
    rows = V.table(spark, d, "lineitem").join(p, "l_partkey").select(F.col("l_orderkey").alias("note_id"), F.col("l_linenumber").alias("pos"), "name", "alias")
    return J.first_seen_entities(rows).withColumn("aliases", F.array_join("aliases", ","))



@query("SELECT l_orderkey AS note_id, l_partkey AS entity_id FROM lineitem EXCEPT SELECT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def mentions_without_support(spark, d):
    """U07"""
    t = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("note_id"), F.col("l_partkey").alias("entity_id"), "l_returnflag")
    return P.without_support(t, t.where("l_returnflag = 'R'"), ["note_id", "entity_id"])


@query("WITH e AS (SELECT user_id, max(value) AS m, count(*) AS n FROM events GROUP BY 1), s AS (SELECT user_id // 2 AS session, CASE WHEN user_id % 2 = 0 THEN 'mic' ELSE 'system' END AS source, m, n, list_filter([CASE WHEN abs(m) > 200 THEN 'rate_ppm_high' END, CASE WHEN n >= 12 THEN 'quality_degraded' END, CASE WHEN n % 7 > 3 THEN 'reanchors_high' END, CASE WHEN n % 9 >= 6 THEN 'declared_rate_untrusted' END], lambda x: x IS NOT NULL) AS a FROM e)\nSELECT session, coalesce(string_agg(array_to_string(list_transform(a, lambda x: source || ':' || x), ','), ',' ORDER BY source) FILTER (len(a) > 0), '') AS anomalies, round(max(CASE WHEN source = 'mic' AND n % 2 = 0 THEN m END) - max(CASE WHEN source = 'system' AND n % 2 = 0 THEN m END), 6) AS rel_ppm FROM s GROUP BY 1")
def drift_anomalies(spark, d):
    """Two users in turn are the sources of a session."""
    e = V.table(spark, d, "events").groupBy("user_id").agg(F.max("value").alias("m"), F.count(F.lit(1)).alias("n"))
    half, u = F.expr("user_id div 2"), F.col("user_id")
    s = e.select(half.alias("session"), F.when(u % 2 == 0, "mic").otherwise("system").alias("source"), F.col("m").alias("rate_ppm"), F.when(F.col("n") >= 12, "degraded").otherwise("fine").alias("quality"), (F.col("n") % 7).alias("reanchors"), (F.col("n") % 9).cast("double").alias("burst_per_min"), (F.col("n") % 2 == 0).alias("converged"))
    return P.drift_report(s).select("session", F.array_join("anomalies", ",").alias("anomalies"), F.round("rel_ppm", 6).alias("rel_ppm"))


@query("SELECT p_partkey AS id, ['zh-Hans-CN', 'en', 'unknown', 'unknown', 'unknown'][p_partkey % 5 + 1] AS locale, ['14.5.1', '7', 'unknown', '1.2.3.4.5.6.7.8.'][p_partkey % 4 + 1] AS version, p_partkey % 6 IN (0, 4) AS valid, p_partkey % 3 = 0 AS since, p_partkey % 3 <> 1 AS passes, p_partkey % 4 IN (0, 2) AS default_title FROM part")
def shape_checks(spark, d):
    """Made-up texts of every kind."""
    i = F.col("id")
    pick = lambda *x: F.element_at(F.array(*[F.lit(v) for v in x]), (i % len(x) + 1).cast("int"))
    p = V.entities(spark, d)
    name = F.concat(pick("2024", "2023", "note"), pick("0229", "0230", "1301"), pick("", "-235959", "-240000"))
    return p.select("id", R.locale(pick("zh_Hans-CN", "en", "e", "ALICE_PRIVATE_THING", "en-419-x")).alias("locale"), R.os_version(pick("14.5.1 (x)", "..7", "Unknown", "1.2.3.4.5.6.7.8.9.10")).alias("version"), R.valid_note_id(pick("a", "", "a/b", "..", "a.b", "a\\b")).alias("valid"), R.valid_since(name).alias("since"), R.since_passes(name, "20240101").alias("passes"), R.is_default_title(pick("周二晚上的会议 2", "周二晚上的会议 b", "2024-01-02 03:04 会议", "x")).alias("default_title"))


@query("SELECT x.vec_id, round(list_sum(list_transform(list_zip(x.embedding, y.embedding), lambda p: abs((CAST(p[1] AS DOUBLE) * 2 + CAST(p[2] AS DOUBLE)) / 3))), 4) AS level FROM embeddings x JOIN embeddings y ON x.vec_id = y.vec_id + 1")
def weighted_merge(spark, d):
    """Before normalising, as a sum of absolute values."""
    v = V.vectors(spark, d)
    j = v.select("vec_id", F.col("embedding").alias("x")).join(v.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("y")), "vec_id")
    m = F.zip_with(M.as_double(F.col("x")), M.as_double(F.col("y")), lambda a, b: (a * 2 + b) / 3)
    return j.select("vec_id", F.round(F.aggregate(m, F.lit(0.0), lambda s, z: s + F.abs(z)), 4).alias("level"))


@query('SELECT event_id, CASE WHEN event_id % 11 * 10000 >= 60000 THEN 1000 ELSE least(event_id % 40 * 1000, 30000) END AS back_off, round(2595 * log10(1 + value / 700), 5) AS mel, 0 AS there_and_back, round(pow(greatest(0, value / 500 - 0.12) / 0.88, 0.7), 6) AS bar, CAST(ceil(ln(0.001) / ln(1 - (0.02 + event_id % 7 / 100.0))) AS BIGINT) AS ticks FROM events WHERE value >= 0')
def scalar_curves(spark, d):
    """M08, M17, M22, N47"""
    v, i = F.col("value"), F.col("event_id")
    return V.table(spark, d, "events").where("value >= 0").select("event_id", R.next_back_off((i % 40) * 500, (i % 11) * 10_000).alias("back_off"), F.round(R.hz_to_mel(v), 5).alias("mel"), F.round(R.mel_to_hz(R.hz_to_mel(v)) - v, 3).alias("there_and_back"), F.round(R.bar_height(v / 500), 6).alias("bar"), R.tick_budget(0.02 + i % 7 / 100.0).alias("ticks"))


@query("SELECT conv_id, conv_id % 3 <> 0 AS canonical, '[' || array_to_string(t, ',') || ']' AS turns FROM (SELECT conv_id, list(DISTINCT turn ORDER BY turn) AS t FROM conversations GROUP BY 1)")
def canonical_sets(spark, d):
    """Strictly rising arrays; every third conversation has its first turn again at the end."""
    g = V.table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_set("turn")).alias("t"))
    t = F.when(F.col("conv_id") % 3 == 0, F.concat("t", F.slice("t", 1, 1))).otherwise(F.col("t"))
    return g.select("conv_id", R.canonical_set(t).alias("canonical"), R.json_array(t).alias("turns"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'a|' || event_type ELSE '' END AS list, CASE WHEN event_id % 2 = 0 THEN 4 ELSE 0 END AS colour FROM events")
def json_values(spark, d):
    """Arrays from JSON text, and colours of kinds in and out of the list."""
    i = F.col("event_id")
    text = F.when(i % 3 == 0, F.concat(F.lit('["a","'), "event_type", F.lit('"]'))).when(i % 3 == 1, F.lit("[")).otherwise("event_type")
    kind = F.when(i % 2 == 0, "product").otherwise("zebra")
    return V.table(spark, d, "events").select("event_id", F.array_join(R.json_strings(text), "|").alias("list"), R.colour_index(kind).alias("colour"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS new_index FROM conversations WHERE turn % 4 <> 1")
def index_remap(spark, d):
    """Old to new positions after deletions."""
    c = V.table(spark, d, "conversations").where("turn % 4 <> 1").select("conv_id", "turn")
    return P.index_remap(c, "conv_id", "turn")


@query(f"WITH {V.SEG} SELECT note_id, CASE WHEN note_id % 4 = 0 THEN 'failed' WHEN note_id % 4 = 1 AND count(*) FILTER (seq % 3 = 2) > 0 THEN 'partial' WHEN note_id % 4 = 2 THEN 'done with relation errors' ELSE 'done' END AS outcome, coalesce(string_agg(CAST(seq AS VARCHAR), ',' ORDER BY seq) FILTER (note_id % 4 = 0 OR (note_id % 4 = 1 AND seq % 3 = 2)), '') AS failed FROM seg GROUP BY 1")
def chunk_outcomes(spark, d):
    """N32"""
    i, s = F.col("note_id"), V.segments(spark, d)
    error = F.when(i % 4 == 0, "network").when((i % 4 == 1) & (F.col("seq") % 3 == 2), "content")
    return P.chunk_outcomes(s.select("note_id", F.col("seq").alias("chunk"), error.alias("error"), (i % 4 == 2).alias("relation_error"))).select("note_id", "outcome", F.array_join(F.col("failed").cast("array<string>"), ",").alias("failed"))


@query(f"WITH {V.SEG}, x AS (SELECT note_id, speaker, count(*) AS n FROM seg WHERE seq % 2 = 0 GROUP BY 1, 2), y AS (SELECT note_id, speaker, count(*) AS n FROM seg WHERE seq % 2 = 1 GROUP BY 1, 2) SELECT note_id, speaker AS speaker_id, CASE WHEN x.n IS NULL THEN '' ELSE 'name of ' || speaker END AS name, concat_ws(',', CASE WHEN y.n IS NOT NULL THEN 'mic' END, CASE WHEN x.n IS NOT NULL THEN 'system' END) AS sources, greatest(coalesce(x.n, 0), coalesce(y.n, 0)) AS \"count\" FROM x FULL JOIN y USING (note_id, speaker)")
def speaker_sync(spark, d):
    """Add-only upsert of the speakers of odd turns into those of even ones."""
    s = V.segments(spark, d).where("speaker is not null")
    half = lambda k: s.where(F.col("seq") % 2 == k).groupBy("note_id", F.col("speaker").alias("speaker_id")).agg(F.count(F.lit(1)).alias("count"), F.array(F.lit("mic" if k else "system")).alias("sources"))
    known = half(0).withColumn("name", F.concat(F.lit("name of "), "speaker_id"))
    return P.sync_speakers(known, half(1)).select("note_id", "speaker_id", "name", F.array_join("sources", ",").alias("sources"), "count")
