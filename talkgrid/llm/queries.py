"""The registered queries of this subpackage: thin wrappers that apply each operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprint import edited_fingerprints

    return edited_fingerprints(table(spark, sf_dir, "documents"))


@query
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .warc import archive_pages, read_archives, records, resolved

    archives = archive_pages(table(spark, sf_dir, "pages"), url="url")
    read = resolved(records(read_archives(archives, with_data=False)))
    return read.select(F.col("record_id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .langid import fit, held_out, identify

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = held_out(F.col("doc_id"), 4, 2)
    model = fit(docs.where(~out))
    return identify(docs.select("doc_id", out.alias("held_out"), "text"), model).drop("text")


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .langid import held_out
    from .toxicity import fit, labelled, score

    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    out = held_out(F.col("doc_id"), 5, 0)
    model = fit(labelled(docs.where(~out), labels.where(~out)))
    return score(docs.select("doc_id", out.alias("held_out"), "text"), model).drop("text")


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"))


@query
def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simjoin import similar_groups

    return similar_groups(table(spark, sf_dir, "documents"), k=3, percent=90)


@query
def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .langid import held_out
    from .lm import fit, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = held_out(F.col("doc_id"), 7, 2)
    model = fit(docs.where(~out))
    return score(docs.select("doc_id", out.alias("held_out"), "text"), model).drop("text")


@query
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import fit, scan

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs, fit(docs)).drop("text")


@query
def op8_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .webp import round_trip

    return round_trip(table(spark, sf_dir, "documents"))


@query
def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import round_trip

    return round_trip(table(spark, sf_dir, "documents"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLES["op2_jaccard_join"] = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s), e AS (SELECT doc_id, unnest(s) AS x FROM s),
l AS (SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM e x JOIN e y ON x.x = y.x AND x.doc_id <> y.doc_id GROUP BY 1, 2) p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.k >= 90 * (x.n + y.n - p.k)),
r AS (SELECT doc_id AS id, doc_id AS root FROM n UNION SELECT l.b, r.root FROM r JOIN l ON r.id = l.a),
c AS (SELECT id, min(root) AS component_id FROM r GROUP BY 1), d AS (SELECT a, count(*) AS links FROM l GROUP BY 1)
SELECT n.doc_id, n.n AS n_shingles, c.component_id, coalesce(d.links, 0) AS n_links FROM n JOIN c ON c.id = n.doc_id LEFT JOIN d ON d.a = n.doc_id"""

#: SHA-1 as bare base32: five bits of the digest at a time.
ORACLES["op4_warc"] = """WITH p AS (SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id FROM pages),
b AS (SELECT *, unhex(sha1(html))::BIT::VARCHAR AS bits FROM p)
SELECT page_id, strlen(html) AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(0, 5), lambda j: CAST(substr(bits, CAST(i * 5 + j + 1 AS BIGINT), 1) AS INT) * CAST(pow(2, 4 - j) AS INT)))::BIGINT, 1)), '') AS payload_digest,
CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM b"""
