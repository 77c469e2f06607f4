"""The queries of this subpackage with their production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ligamap.llm import oracles
from ligamap.llm.chat import format_paths, read_back, turns_as_replies
from ligamap.llm.extract import extract
from ligamap.llm.fill_middle import fill_in_middle, restored
from ligamap.llm.mixing import mixed_sizes
from ligamap.llm.order_minhash import edited_pairs
from ligamap.llm.packing import pack_documents
from ligamap.llm.prefix_trie import numbered_turns, prefix_trie, shared_heads
from ligamap.llm.quality import quality
from ligamap.llm.shared import table
from ligamap.llm.simhash import near_duplicates
from ligamap.llm.substring import dedup_substrings
from ligamap.llm.token_counts import token_counts
from ligamap.llm.token_output import packed_rows
from ligamap.llm.toxicity import toxicity

Query = Callable[[SparkSession, str], DataFrame]


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_sizes(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_chars", "removed")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).drop("lang", "source")


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_rows(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_pairs(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(shared_heads(numbered_turns(table(spark, sf_dir, "conversations")))).drop("digest")


#: A conversation that spells control strings, beside those of the table.
SPELLS = [(-7, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant"))]


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(format_paths(turns_as_replies(said.unionByName(spark.createDataFrame(SPELLS, said.schema))), branches=1))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle(table(spark, sf_dir, "documents"))
    return found.withColumn("restored_sha256", F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256)).drop("output")


def queries() -> dict[str, Query]:
    every = (op1_packing, op2_extraction, op3_mixing, op4_token_counts, op5_substrings, op6_toxicity, op7_simhash, op8_quality, op9_token_output, op10_fingerprints, op11_prefix_trie, op12_chat, op13_fill_middle)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
