"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, divergence, html_text, licenses, mixing, packing, quality, repair, simhash, token_files, toxicity, vptree
from .scratch import discard_all, table


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of token ids with a minimal perfect hash index, written and read back."""
    return token_files.token_table(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 ids, by column generation."""
    return packing.packed_table(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of four-word shingles, linked at four or fewer differing bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), words=4, radius=4)
    return found.select("doc_id", simhash.hex16("fp").alias("fingerprint"), "component_id")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten-word windows of the benchmark found in the documents' positional inverted index."""
    return decontaminate.contamination_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noisy-or over sentences, learned from document labels."""
    return toxicity.toxicity_table(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak labels, their posteriors and the linear scorer trained on these."""
    return quality.assess(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts of the conversations, roles recovered by Viterbi, turns rendered."""
    return chat.chat_table(table(spark, sf_dir, "conversations"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, site templates removed."""
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector by vantage-point trees."""
    return vptree.nearest_table(table(spark, sf_dir, "embeddings"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licence sentences of every document and the licences whose rules they match."""
    return licenses.license_table(table(spark, sf_dir, "documents"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources mixed to target weights by Pareto order sampling."""
    return mixing.mix_table(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of each source's term shares from the other sources' and its language's."""
    return divergence.divergence(table(spark, sf_dir, "documents").select("text", "lang", "source"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations damaged, and repaired by the cheapest edits."""
    return repair.repair_table(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_chat": op2_chat,
        "op3_token_files": op3_token_files,
        "op4_packing": op4_packing,
        "op5_simhash": op5_simhash,
        "op6_html": op6_html,
        "op7_decontamination": op7_decontamination,
        "op8_neighbours": op8_neighbours,
        "op9_toxicity": op9_toxicity,
        "op10_licenses": op10_licenses,
        "op11_mixing": op11_mixing,
        "op12_divergence": op12_divergence,
        "op13_repair": op13_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op7_decontamination": decontaminate.ORACLE,
        "op10_licenses": licenses.oracle(),
        "op11_mixing": mixing.ORACLE,
        "op12_divergence": divergence.ORACLE,
        "op13_repair": repair.ORACLE,
    }
