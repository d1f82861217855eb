"""Every stage of the pipeline and run(): plain versions, and odd tables."""

import json
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from talkgrid.llm import langid, secrets, toxicity
from tests.llm.test_edges import ROWS
from tests.llm.test_sets_and_media import WORD, brute

STAGES = dict(P.STAGES)
LABELS = [(1, 0, 0), (3, 0, 1), (5, 1, 0), (None, 0, 1), (99, 1, 0)]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int, lang_pred string, known string, k1 string, node long, component string"


def rows_of(rows):
    return [(i, t, lang, "web", len(t or ""), 777.0, 5, "own", "own", "own", -1, "own") for i, t, lang in rows]


def store(spark, path, rows, labels=LABELS):
    spark.createDataFrame(rows_of(rows), DOCS).coalesce(1).write.parquet(f"file://{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"file://{path}/labels.parquet")
    return f"file://{path}"


@pytest.mark.parametrize("name", list(STAGES))
@pytest.mark.parametrize("kind", ["odd", "empty", "unlabelled"])
def test_stages_on_odd_tables(spark, tmp_path, name, kind):
    rows = {"odd": ROWS, "empty": [], "unlabelled": [(i, t, None) for i, t, _ in ROWS]}[kind]
    sf = store(spark, tmp_path, rows, [] if kind != "odd" else LABELS)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = STAGES[name](spark, docs, sf)
    got = out.collect()
    if name == "packing":
        assert len({r.doc_id for r in got}) == len({i for i, *_ in rows})
        return
    assert out.columns == docs.columns and out.schema == docs.schema
    own = [(r.score, r.predicted, r.lang_pred, r.known, r.k1, r.node, r.component, r.source) for r in got]
    assert own == [(777.0, 5, "own", "own", "own", -1, "own", "web")] * len(got)
    left = sorted(((r.doc_id, r.text) for r in got), key=str)
    if name == "language ID":
        assert all(t and any(c.isalpha() for c in t) for _, t in left)
        if kind == "unlabelled":
            assert len(left) == 7  # what has letters
    elif name == "near duplicates":
        assert len(left) == len(rows)  # 7 repeats the text of the row without an id, and both stay
    elif name == "secret scans":
        assert len(left) == len(rows) and all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)
    elif name == "toxicity" and kind == "unlabelled":
        assert len(left) == len(rows)


@pytest.mark.parametrize("kind", ["odd", "empty"])
def test_run_on_odd_tables(spark, tmp_path, kind):
    sf = store(spark, tmp_path, ROWS if kind == "odd" else [])
    assert (P.run(spark, sf).count() > 0) == (kind == "odd")


def test_language_stage_rejects_other_languages(spark, tmp_path):
    """Texts of another Latin language and of random letters go, known ones stay, however the posterior looks."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = random.Random(3)
    nonsense = [(10**6 + i, " ".join("".join(r.choice("qxzwkvjyptd") for _ in range(r.randrange(4, 11))) for _ in range(40)), None) for i in range(20)]
    finnish = [(2 * 10**6, "talossa asuvat ihmiset kertoivat eilen iltapäivällä naapureilleen tulevasta kokouksesta jossa käsitellään kaupungin uusia rakennushankkeita", None)]
    more = spark.createDataFrame(nonsense + finnish, "doc_id long, text string, lang string").withColumns({"source": F.lit("x"), "n_chars": F.char_length("text").cast(docs.schema["n_chars"].dataType)})
    got = {x.doc_id for x in P.language_stage(spark, docs.unionByName(more), "").select("doc_id").collect()}
    known = {x.doc_id for x in docs.where("lang is not null").select("doc_id").collect()}
    assert not got & {i for i, *_ in nonsense + finnish} and len(known - got) <= 0.001 * len(known)


def test_run_is_its_stages_one_by_one(spark):
    """run() against plain code on the driver that takes each stage's decisions from models of the same rows."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    back = F.pmod(F.xxhash64("doc_id", "text"), F.lit(P.HELD_BACK)) == 0
    model = langid.fit(docs.where(~back))
    least = langid.least_known(docs.where(back), model)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    langs, score, known = langid.predict(model, [t for _, t in rows])
    rows = [x for x, a, s, k in zip(rows, langs, score, known, strict=True) if a != "und" and s >= 0.5 and k >= least]
    left = spark.createDataFrame(rows, "doc_id long, text string")
    tox = toxicity.fit(toxicity.labelled(left, spark.read.parquet(f"{sf}/labels.parquet")))
    rows = [x for x, s in zip(rows, tox.scores([t for _, t in rows]), strict=True) if s < 0.5]
    groups = brute(rows, 5, 80)
    rows = [(i, t) for i, t in rows if not WORD.search(t or "") or groups[i][1] == i]
    field = secrets.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    found = secrets.scan_texts(field, [t or "" for _, t in rows], secrets.Shapes(field))
    clean = {}
    for (i, t), spans in zip(rows, found, strict=True):
        cover = np.zeros(len(t) + 1, bool)
        starts, end = [], 0
        for s, e, _ in spans:  # overlapping spans are one mark
            cover[s:e] = True
            if s >= end:
                starts.append(s)
            end = max(end, e)
        clean[i] = "".join("[SECRET]" if k in starts else "" if cover[k] else c for k, c in enumerate(t))
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    out = P.run(spark, sf).toPandas().sort_values(["doc_id", "start"])
    assert sorted(set(out.doc_id)) == sorted(clean)
    for i, pieces in out.groupby("doc_id"):
        ids = np.asarray([*tok.encode(clean[i], add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in pieces.itertuples():
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[at : at + p.length]) and p.doc_tokens == len(ids), json.dumps(clean[i][:300])
            at += p.length
        assert at == len(ids)


def test_least_known_counts_all_labelled_rows(spark):
    """The lowest 120 of 60,000 rows have shares of their own; a sample of 12,000 would find another of them."""
    text = F.expr("case when id < 120 then concat(repeat('known ', int(id)), repeat('zzq ', 200 - int(id))) else 'known' end")
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"))
    model = langid.Model(["en"], {"en": {"known": 5}})
    assert langid.least_known(docs, model) == 0.5 * 120 / 201
    assert langid.least_known(docs.where("doc_id < 3"), model) == 0.5 / 201
    assert langid.least_known(docs.where("false"), model) == 0
