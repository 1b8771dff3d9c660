"""A corpus pipeline over ``documents``: five stages, each written as Parquet and read again before the next.

toxicity (rejected documents go) -> SimHash near-dedup (one document of each class stays) -> PII (spans are masked) ->
mixing sources to target weights (documents repeat or go) -> byte-level BPE (documents with their token ids).
Every stage takes ``(spark, docs, sf_dir)``, works on all rows of ``docs`` and, but for the last, returns its columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lodestrata.llm import bpe, mixing, pii, simhash, toxicity
from lodestrata.llm.shared import forget, row_hash, scratch, table, unused, written
from lodestrata.runtime import on_path


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose grade by the ordinal model is the lowest; the model is fitted on the labelled rows of ``docs``.

    Defined cases: a null or wordless text has no features and is graded as an empty one; rows with a null id are graded
    like any other; repeated rows stay together or go together; without labels, or with one grade, all stay.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    severity, grade = unused(docs, "_severity", "_grade")
    graded = toxicity.grade_documents(docs, model, severity_col=severity, grade_col=grade)
    return graded.filter(F.col(grade) <= min(model.grades)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-copy class (5-word shingles, similarity 0.8): that of smallest id, a null id last.

    Defined cases: null and wordless texts are one class; of texts under one id, or under none, the one of smallest hash
    stays; of rows equal in id and text the one whose other columns have the smallest hash.
    """
    classes = simhash.near_duplicates(docs, shingle=5, similarity=0.8)
    id_, th, at, of, row, no = unused(docs, "_id", "_th", "_at", "_of", "_row", "_no")
    stay = classes.filter("kept").select("doc_id", "th").distinct().toDF(id_, th)
    marked = docs.withColumns({at: F.col("doc_id").cast("long"), of: F.coalesce(F.xxhash64(F.col("text").cast("string")), F.lit(0)), row: row_hash(docs)})
    kept = marked.join(stay, F.col(at).eqNullSafe(F.col(id_)) & (F.col(of) == F.col(th)), "left_semi")
    first = F.row_number().over(Window.partitionBy(at, of).orderBy(row))
    return kept.withColumn(no, first).filter(F.col(no) == 1).select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, personal data replaced by its kind; ``n_chars`` follows the text.

    Defined cases: a null text stays null, with null ``n_chars``; repeated rows stay repeated; other columns are as they were.
    """
    out = pii.redact(docs, pii.train_on(docs))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, each as often as it is taken, every partition in the order of the schedule.

    Defined cases: null and wordless texts have no words and go; null sources are one source, the last; rows that differ in
    any column are separate, equal rows count together; ``n_chars`` follows the text.
    """
    out = mixing.mixed_documents(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids) of every document.

    Defined cases: null and empty texts have no tokens; repeated rows give repeated rows; other columns go.
    """
    ids = bpe.encode_table(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=["doc_id", "source"])
    return ids.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", on_path(reject_toxic)),
    ("simhash_near_dedup", on_path(drop_near_copies)),
    ("pii", on_path(mask_personal_data)),
    ("mixing", on_path(mix_sources)),
    ("byte_bpe", on_path(encode)),
]

#: The stages' models and searches are not expressible in SQL; tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage leaves in the shared folder goes once its result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            before, docs = docs, written(stage(spark, docs, sf_dir), f"stage-{name}")
            keep.append(docs)
        forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
