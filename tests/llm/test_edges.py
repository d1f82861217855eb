"""Every operator: nulls in any column, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from talkgrid.llm import fingerprint, langid, lm, packing, pieces, secrets, simjoin, toxicity, warc, webp
from talkgrid.llm.queries import QUERIES

ROWS = [
    (1, "The house of the people is here and there.", "en"),
    (1, "The house of the people is here and there.", "en"),
    (2, None, None),
    (None, "Das Haus der Leute ist hier und dort.", "de"),
    (3, "", "en"),
    (4, "   \n\t ", None),
    (5, "word " * 60_000, "en"),
    (6, "x" * 70_000, None),
    (7, "Das Haus der Leute ist hier und dort.", "de"),
    (8, 'token = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda" \U0001f600 é é', "fr"),
]


def table(spark, rows=ROWS):
    """Columns that clash with those that operators add or use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return df.withColumns({c: F.lit("own") for c in ("source", "score", "node", "key", "held_out", "media", "fingerprint", "shard", "h", "part")})


OPERATORS = {
    "packing": lambda d: packing.pack(d),
    "simjoin": lambda d: simjoin.similar_groups(d),
    "keep_one": lambda d: simjoin.keep_one(d),
    "langid": lambda d: langid.identify(d, langid.fit(d)),
    "pieces": lambda d: pieces.round_trip(d),
    "piece_ids": lambda d: pieces.encode_table(d),
    "lm": lambda d: lm.score(d, lm.fit(d)),
    "secrets": lambda d: secrets.scan(d, secrets.fit(d)),
    "redact": lambda d: secrets.redact(d, secrets.fit(d)),
    "webp": lambda d: webp.round_trip(d),
    "media": lambda d: webp.store_texts(d),
    "toxicity": lambda d: toxicity.score(d, toxicity.fit(d.withColumn("toxic", F.col("doc_id") % 2))),
    "fingerprint": lambda d: fingerprint.fingerprint(d),
    "edited": lambda d: fingerprint.edited_fingerprints(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows(spark, name):
    out = OPERATORS[name](table(spark)).toPandas()
    if name in ("packing", "keep_one"):
        assert len(out) >= 8
    else:
        assert len(out) == len(ROWS)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, name):
    assert OPERATORS[name](table(spark, []))
    assert OPERATORS[name](table(spark, [])).count() == 0


def test_archives_of_odd_rows(spark):
    pages = spark.createDataFrame([(1, "a"), (2, None), (None, "a"), (3, "a"), (3, "a"), (4, ""), (5, "é" * 400_000)], "page_id long, html string").withColumn("record_type", F.lit("own"))
    read = warc.read_archives(warc.archive_pages(pages))
    got = sorted(warc.resolved(warc.records(read)).select("record_id", "record_type", "refers_to", "payload_bytes").collect(), key=str)
    assert len(got) == 7
    assert {(r.record_id, r.record_type, r.refers_to) for r in got} == {(1, "response", None), (None, "revisit", 1), (3, "revisit", 1), (2, "response", None), (4, "revisit", 2), (5, "response", None)}
    chunks = read.where("record_id = 5").orderBy("chunk_no").collect()
    assert len(chunks) == -(-800_000 // warc.CHUNK) and b"".join(bytes(c.data) for c in chunks) == "é".encode() * 400_000
    none = spark.createDataFrame([], "page_id long, html string")
    assert warc.read_archives(warc.archive_pages(none)).count() == 0


def test_defined_results(spark):
    d = table(spark)
    by = lambda df: {(r.doc_id, r.text): r for r in df.collect()}
    lang = by(langid.identify(d, langid.fit(d)))
    assert lang[(2, None)].lang_pred == "und" and lang[(4, "   \n\t ")].lang_pred == "und" and lang[(3, "")].score == 0
    groups = {r.doc_id: r for r in simjoin.similar_groups(d).collect()}
    assert groups[None].component_id == 7 and groups[7].n_links == 1 and groups[2].n_shingles == 0 and groups[2].component_id == 2
    kept = [r.doc_id for r in simjoin.keep_one(d).collect()]
    assert kept.count(1) == 2 and None in kept
    scanned = by(secrets.scan(d, None))
    assert scanned[(8, ROWS[-1][1])].spans == "assign:0:49,hex:9:49" and scanned[(2, None)].spans == ""
    assert by(secrets.redact(d, None))[(2, None)].text is None
    prints = by(fingerprint.fingerprint(d))
    assert prints[(2, None)].fingerprint == prints[(4, "   \n\t ")].fingerprint
    scores = by(lm.score(d, lm.fit(d)))
    assert scores[(3, "")].n_tokens == 1 == scores[(2, None)].n_tokens


def test_queries_are_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "toxicity", "near duplicates", "secret scans", "packing"]
