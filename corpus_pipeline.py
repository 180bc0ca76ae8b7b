"""From raw documents to training batches: language, exact copies, near copies, mix of sources, packing.

Each stage takes the documents that its predecessor kept, as rows with the columns of ``documents``, and its decisions
take effect: rejected languages and copies go, and a document that the mix takes twice is there twice. The last stage
returns the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.llm import exact_dedup, langid, mixing, near_dedup, packing
from vectide.llm.common import spare, stored, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones show; the models learn from four fifths of them.

    Null and empty texts and those without a letter go. Repeated rows stay or go together, and ties of languages change
    nothing. An empty table gives no rows, and columns may have any names.
    """
    models = langid.train(docs.where(langid.held_out_part("doc_id", 5) != 0))
    names = tuple(spare(n, docs.columns) for n in langid.OUT)
    return langid.identify(docs, models, keep=tuple(docs.columns), names=names).where(names[3]).select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of the documents that are equal but for blanks, the one with the most code points and then the smallest id.

    Null counts as empty, and one of all empty texts stays; of repeated rows one stays. An empty table gives no rows,
    and columns may have any names.
    """
    return exact_dedup.exact_dedup(docs, carry=True).where("kept").select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of the documents that near copies link, by five-word shingles and a similarity of 0.8: the smallest id.

    Null and empty texts and null ids are linked with nothing and stay. Rows that repeat an id stay or go together. An
    empty table gives no rows, and columns may have any names.
    """
    kept = near_dedup.near_duplicates(docs, width=5)
    gone = kept.groupBy("doc_id").agg(F.max("kept").alias("kept")).where("not kept").select("doc_id")
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them, not at all or up to twice.

    Null and empty texts have no words and go if their source's threshold leaves them out; a null source is one of its
    own. Rows that repeat an id are taken together. An empty table gives no rows, and columns may have any names.
    """
    times = mixing.mix(docs, carry=True).where("times > 0")
    return times.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences in buckets and batches.

    A null or empty text is a row without a batch; repeated rows are sequences of their own, in the order of their
    hashes. An empty table gives no rows, and columns may have any names.
    """
    return packing.pack(docs)


STAGES = [
    ("language ID", known_language),
    ("exact dedup", exact_copies),
    ("near dedup", near_copies),
    ("source mix", source_mix),
    ("packing", packed),
]

#: Language models and near-duplicate links can't be written in SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{k}")
    return docs
