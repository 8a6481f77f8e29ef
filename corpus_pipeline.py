"""A training corpus from the documents table: identify languages, drop exact and near copies, mix the sources, encode.

Each stage works on all rows of its predecessor, which are written as Parquet and read again in between.
"""
from __future__ import annotations

import public_tokenizers

from slipweave.llm import bloom_dedup, bpe, common, language, mixing, overlap


def language_stage(spark, docs, sf_dir):
    """Documents without an identified language go."""
    return language.keep_identified(docs)


def exact_dedup_stage(spark, docs, sf_dir):
    """One document of each group of equal texts stays."""
    return bloom_dedup.exact_dedup(docs)


def near_dedup_stage(spark, docs, sf_dir):
    """Documents go whose five-word shingles overlap by 0.8 or more with those of one that stays; SimHash links find the closest copies, MinHash keys the others."""
    return overlap.near_dedup(docs)


def mixing_stage(spark, docs, sf_dir):
    """Documents repeat as the target weights of their sources ask, in random order."""
    return mixing.mix_sources(docs, extra=False)


def encoding_stage(spark, docs, sf_dir):
    """doc_id, ids, decoded of every document of the mixture."""
    return bpe.token_ids(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_dedup_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("source_mixing", mixing_stage),
    ("bpe_encoding", encoding_stage),
]

#: The stages of language, near copies and tokens have no SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = common.documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
