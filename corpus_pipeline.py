"""A corpus pipeline: language ID, SimHash near-dedup, substring dedup, benchmark decontamination, best-fit packing.

Each stage takes (spark, docs, sf_dir), where docs is all that its predecessor kept, and returns a DataFrame with the
columns of docs, whatever others there are; the last returns the placement of each document's pieces in training sequences.
No stage fails on nulls, empty or very long texts, repeated rows or empty docs; each says what becomes of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import decontaminate, langid, packing, shingles, substrings
from weftline.llm.common import remainder, table, written

#: A document whose nearest profile is at over 1 - LEAST of the greatest distance is in none of the languages.
LEAST = 0.1


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages of docs.lang. Those without a letter (null and empty texts too) or far from every
    profile go; repeated rows are judged alike. Profiles are learned from the documents whose crc32(doc_id as text) mod 4 is
    not 2, null ids counting as ''. Without any known language all go."""
    profiles = langid.learn(docs.filter(remainder(F.col("doc_id"), 4) != 2))
    return langid.kept(docs, profiles, LEAST)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of least doc_id. SimHash fingerprints of five-word shingle sets find
    candidates, a similarity of 0.8 or more of the whole sets links them. Null and blank texts are copies of one another; rows
    that share the least doc_id stay, and so do rows without one."""
    return shingles.deduplicated(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words or more that a document of lesser doc_id has; n_chars follows the text. A document of
    which nothing is left goes. Rows without a text or doc_id stay as they are; rows that share a doc_id don't cut each other."""
    return substrings.cut_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark, edits allowed. Null and empty texts stay; repeated rows are judged alike."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Placement of each document's token pieces in sequences of at most 2048 tokens. A null or empty text is one piece, the end
    id; rows that share a doc_id have pieces of their own."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]
#: Fingerprints, profiles and tokens have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is a written table that the next one reads."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
