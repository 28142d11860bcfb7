"""Corpus pipeline: quality, near duplicates, benchmark passages, personal data, packing.

Every stage takes (spark, docs, sf_dir), where docs is read from Parquet, and works on all of it.  All but
the last return the columns of documents: the first three drop rows, the fourth masks personal data in text
(and corrects n_chars).  The last returns the packed pieces.  ``run`` writes each stage's result to the
shared folder and reads it again for the next.

The result depends on a trained network and a tokenizer, which SQL can't state: tests hold the network's stage
against the labels and the rows of every other stage against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, jaccard, packing, pii, quality
from plumbline.llm.common import every_column, fresh, keep_rows, scanned, stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on this input's labelled documents, rejects go.

    A null or empty text is scored like any other; without labels every document has the share of label 1 in
    none, 0.5, and stays.  Rows with a null id stay or go by their text.  Repeated rows share a fate.  Very long
    texts are scored whole.  Other columns, ``score`` and ``predicted`` too, go through as they are.
    """
    docs = docs.select(*every_column(docs))
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    score, predicted = fresh(docs, "score"), fresh(docs, "predicted")
    scored = quality.classify(docs, model, score=score, predicted=predicted)
    return scored.where(F.col(predicted) == 1).select(*every_column(docs))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8, the one with the smallest id stays.

    Of rows that share that id (or of null ids, where there is no other) the first stays.  Null texts and texts
    without words link with nothing and stay, repeated ones too.  Texts of under five words link if all are alike.
    """
    docs = scanned(docs)
    return keep_rows(docs, jaccard.similar(docs, n=5, num=80).where("kept"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of ten words of a benchmark item (an item of fewer words: all of it) go.

    Null texts, texts without words and rows with a null id follow the same rule.  Without items all stay.
    """
    docs = scanned(docs)
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return keep_rows(docs, found.where("not contaminated"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes its kind in brackets; a null text stays null, and its n_chars too."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of at most 4096; a null or empty text is its end token alone."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", quality_stage),
    ("jaccard", jaccard_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
