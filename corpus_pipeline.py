"""The corpus pipeline, from documents to batches of training sequences.

Toxic documents go; of exact copies one stays; of near-duplicates one stays; secrets are
masked in the texts that hold any; what is left is packed. Each stage takes all that the one
before kept, and all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers

from faultline.llm import exact_dedup, near_dedup, packing, secret_scan, toxicity
from faultline.llm.common import small_batches, table
from faultline.session import materialize


def toxic_out(spark, docs, sf_dir):
    """Documents that score 0.7 or more go. Labels are those of the table beside them."""
    small_batches(spark)
    return toxicity.drop_toxic(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def copies_out(spark, docs, sf_dir):
    """Of texts equal but for blanks the longest stays, then the one with the smallest id."""
    return exact_dedup.drop_duplicates(docs)


def near_copies_out(spark, docs, sf_dir):
    """Of each component of near-duplicates, from a similarity of 0.8 on, the smallest id stays."""
    small_batches(spark)
    return near_dedup.drop_near_duplicates(docs, near_dedup.CORPUS_PERCENT)


def secrets_masked(spark, docs, sf_dir):
    """Every secret is replaced; a document stays, as all but its secrets is clean."""
    small_batches(spark)
    return secret_scan.masked(docs)


def packed(spark, docs, sf_dir):
    """One row per sequence with its bucket, batch and place."""
    small_batches(spark)
    return packing.pack(packing.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("toxicity", toxic_out),
    ("exact dedup", copies_out),
    ("near dedup", near_copies_out),
    ("secret scan", secrets_masked),
    ("packing", packed),
]

# A trained kernel machine, MinHash and BPE can't be expressed in SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows of the last stage; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
