"""The corpus pipeline: stages over the documents table, each one operator of talkgrid.llm.

A stage takes (spark, docs, sf_dir) and works on all rows of docs, the rows that its predecessor kept; docs holds the
columns of documents, and all stages but the last return just these, as they came (the secret stage changes text and
n_chars). Stages fit their models on the rows they get. Columns of any other name may be there; what a stage computes
for itself has names that docs doesn't use. An empty table passes every stage as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkgrid.llm import langid, packing, secrets, simjoin, toxicity

#: A text whose likeliest language has less posterior probability than this is rejected, as is one without letters.
LEAST_LANGUAGE_SCORE = 0.5
#: One labelled row in so many is not learned from, but shows how many of a text's words are known at least.
HELD_BACK = 10


def own_names(docs: DataFrame, *names: str) -> tuple[str, ...]:
    """The names, with as many underscores in front as keep them apart from the columns of docs (whatever their case)."""
    taken = {c.lower() for c in docs.columns}
    while any(n.lower() in taken for n in names):
        names = tuple(f"_{n}" for n in names)
    return names


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no known language: null and empty texts, texts without letters, undecided ones, and those of which
    far fewer words are known than of any labelled text (another language, or no language).

    With no labelled row there is no language to tell; then only null texts and texts without letters go. Repeated
    rows stay or go together.
    """
    back = F.pmod(F.xxhash64("doc_id", "text"), F.lit(HELD_BACK)) == 0
    model = langid.fit(docs.where(~back))
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    names = own_names(docs, "lang_pred", "score", "known")
    lang, score, known = map(F.col, names)
    found = langid.identify(docs, model, names=names)
    return found.where((lang != "und") & (score >= LEAST_LANGUAGE_SCORE) & (known >= langid.least_known(docs.where(back), model))).drop(*names)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier, fitted on the labelled ones among them, calls toxic.

    Null and empty texts get the score of the intercept. Without labels, or with labels of one class, nothing tells documents
    apart and all stay. Repeated rows stay or go together.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(toxicity.labelled(docs, labels))
    if model.keep is None:
        return docs
    names = own_names(docs, "score", "predicted")
    return toxicity.score(docs, model, names=names).where(F.col(names[1]) == 0).drop(*names)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group linked by five-word shingles with a Jaccard of 0.8 or more.

    Texts without words link with nothing and stay, as do rows with a null id and rows that repeat the kept id and text. A
    row goes by its id and text together, so another text under the same id is not touched.
    """
    return simjoin.keep_one(docs, k=5, percent=80)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; n_chars, where there is such a column, follows the text. No row goes; null texts stay null."""
    clean = secrets.redact(docs, secrets.fit(docs))
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the texts into training sequences: the pieces (columns as of packing.PIECES). Null and empty texts are a document
    of the end mark alone; repeated rows are packed each; null ids stay null."""
    return packing.pack(docs)


STAGES = [
    ("language ID", language_stage),
    ("toxicity", toxicity_stage),
    ("near duplicates", near_duplicate_stage),
    ("secret scans", secret_stage),
    ("packing", packing_stage),
]

#: Classifiers, set joins and token packing are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents table; each one's result is written to the shared folder and read again."""
    from talkgrid.llm.common import new_shared_folder

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_shared_folder(spark, "pipeline")  # removed when the driver ends
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{i}")
            docs = spark.read.parquet(f"{folder}/{i}")
    return docs
