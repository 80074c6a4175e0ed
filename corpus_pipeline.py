"""The corpus pipeline: quality filter, near-dedup, substring dedup, source mix, piece ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm import mixing, pieces, quality, simhash, substring
from loomstone.llm.common import fresh, read

#: Words of a passage that may not repeat, weights and size of the mix.
PASSAGE = 50
WEIGHTS, SHARE, EPOCHS = [3.0, 1.0, 2.0], 1.5, 2.0


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labelled ones among them, doesn't reject.

    Every row is judged by its whole text, null as empty; repeated rows share their fate, ties at the threshold stay, and
    all columns are kept. No documents give none. The same holds for nulls in any other column in all stages.
    """
    return quality.classified(docs, read(spark, sf_dir, "labels")).filter("predicted = 1").select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, of similarity 0.8 or more on five-word shingles, told exactly.

    Null and wordless texts are copies of each other. A row is its id and text: repeated rows are one, one id with two
    texts is two documents, and rows without an id are judged like others (see near_deduplicated).
    """
    return simhash.near_deduplicated(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that also stand in a document of a smaller id; documents that lose all their words go.

    Null, empty and wordless texts stay as they are, as do rows without an id; rows of one id don't cut each other.
    """
    worded = lambda: F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    cut = substring.deduplicated(docs.withColumn("__worded", worded()), PASSAGE).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.filter(~F.col("__worded") | worded()).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: never oftener than the epochs say, not at all where its share is full.

    A null source is a source of its own. Ties in the hash order go by id and size. A source without any words gives none.
    """
    return mixing.repeated(docs, WEIGHTS, SHARE, EPOCHS, "mix-1")


def sentencepiece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_pieces of each document: whole texts, however long; a null text has no ids."""
    import public_tokenizers

    coded = pieces.encoded(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path(pieces.MODEL))
    return coded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_pieces"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing sources to target weights", source_mix),
    ("SentencePiece encoding and decoding", sentencepiece_ids),
]

#: Training and fingerprints can't be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = fresh(spark, f"pipeline-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
