"""Registered queries of the operators here: name -> (query, comparison SQL or None)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from faultline.llm import bpe, embedding_dedup, exact_dedup, near_dedup, packing, personal, phrases, quality, records, repair, secret_scan, shards, toxicity
from faultline.llm.common import table
from faultline.session import materialize, scratch_path


def op1_bpe_round_trip(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    coded = bpe.encode_and_decode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_exact_dedup(spark, sf_dir):
    return exact_dedup.duplicate_groups(table(spark, sf_dir, "documents"))


def op3_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op4_binary_records(spark, sf_dir):
    folder = scratch_path(spark, "token-records")
    docs = table(spark, sf_dir, "documents")
    manifest = records.write_records(docs, public_tokenizers.path("byte_bpe_50k.json"), folder)
    found = records.read_records(materialize(manifest, "token-manifest"), folder)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def op6_secrets(spark, sf_dir):
    return secret_scan.digests(secret_scan.scan(table(spark, sf_dir, "documents")))


def op7_sharding(spark, sf_dir):
    return shards.assign_shards(table(spark, sf_dir, "documents"))


def op8_packing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return packing.pack(packing.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")))


def op9_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_embedding_dedup(spark, sf_dir):
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op11_repair(spark, sf_dir):
    rows = repair.clean(table(spark, sf_dir, "conversations"))
    return repair.digests(repair.damaged(rows), rows)


def op12_personal(spark, sf_dir):
    return personal.digests(personal.scan(table(spark, sf_dir, "documents")))


def op13_phrases(spark, sf_dir):
    return phrases.phrases(table(spark, sf_dir, "documents"))


def registry():
    return {
        "op1_bpe_round_trip": (op1_bpe_round_trip, None),
        "op2_exact_dedup": (op2_exact_dedup, exact_dedup.SQL),
        "op3_toxicity": (op3_toxicity, None),
        "op4_binary_records": (op4_binary_records, None),
        "op5_quality": (op5_quality, None),
        "op6_secrets": (op6_secrets, None),
        "op7_sharding": (op7_sharding, None),
        "op8_packing": (op8_packing, None),
        "op9_near_dedup": (op9_near_dedup, None),
        "op10_embedding_dedup": (op10_embedding_dedup, embedding_dedup.SQL),
        "op11_repair": (op11_repair, None),
        "op12_personal": (op12_personal, None),
        "op13_phrases": (op13_phrases, phrases.SQL),
    }
