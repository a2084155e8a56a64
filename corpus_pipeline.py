"""A training corpus from `documents`: toxicity, near duplicates, personal data, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import mixing, packing, pii, shingles, toxicity
from panelforge.llm.common import cut, fresh, table
from panelforge.llm.entries import surrogate_key, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the labels of `docs`."""
    model = toxicity.fit(toxicity.sample_of(docs, table(spark, sf_dir, "labels")))
    return toxicity.without_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts that share four fifths or more of their five-word shingles.

    SimHash fingerprints of these shingles, multi-index hashing and connected
    components, as in op1, give the first links, which the sets confirm; pairs
    that 2 of 64 bits do not reach are then found by the sets themselves.
    """
    return shingles.without_near_duplicates(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data; n_chars follows the new text."""
    new = pii.checked_surrogates(docs, surrogate_key(spark), fresh(docs, "pii"))
    return new.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequences and offsets."""
    return packing.packed_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("pii_surrogates", replace_personal_data),
    ("source_mixing", mix_sources),
    ("bestfit_packing", pack_sequences),
]

#: Classifier, fingerprints, keyed surrogates, hashed draws and tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to `documents`, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
