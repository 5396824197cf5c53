"""From documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on every row that the one before
it kept, and returns a DataFrame; all but the last return the columns of
documents. The driver, like ``run``, writes each result as Parquet and reads it
again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from addrloom.llm import linededup, mixing, nearcopies, packing, quality, store
from addrloom.llm.queries import table, tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the highest grade reaches the classifier's least; toxic and junk ones go.

    The ratings come from ``labels``; a document without one is graded like any other.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id", quality.grade_of_labels().alias("grade"))
    graded = quality.grade(docs, quality.train(docs, labels))
    return graded.where("keep").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that repeat over documents; n_chars follows. A text may become empty and stays."""
    store.text_batches(spark)
    kept = linededup.dedup_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that a similarity of 0.8 or more (five-word shingles) links: the one with the least doc_id.

    Rows are told apart by doc_id and text, so rows that lack or repeat a doc_id
    are documents of their own. Any doc_id comes before none, and among equal ones
    a digest of the text decides. Texts without words are one group.
    """
    store.text_batches(spark)
    return nearcopies.first_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole copies of the documents in training order, as the mix takes them.

    Of its last document a source takes some words only; that copy is whole if they
    are at least half of its words and is left out otherwise, whichever is nearer to
    the source's target.
    """
    order = mixing.training_order(mixing.mix(docs, carry=("text", "lang", "n_chars")))
    whole = order.where(2 * F.col("words") >= F.col("size"))
    return whole.select("doc_id", F.col("carried.text").alias("text"), F.col("carried.lang").alias("lang"), "source", F.col("carried.n_chars").alias("n_chars"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every copy's pieces with their sequence and offset."""
    store.text_batches(spark)
    return packing.pack_documents(docs, tokenizer_path(), 2048)


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Fingerprints, model weights and token ids are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = store.table(docs, f"stage-{k + 1}")
    return docs
