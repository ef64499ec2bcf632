"""The queries opN_<name>: each applies its operator to whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, exact_dedup, html, line_dedup, media, minhash, mixing, secrets, substrings, toxicity
from .common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), mixing.labelled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(line_dedup.line_dedup(table(spark, sf_dir, "documents")))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(substrings.suffix_dedup(table(spark, sf_dir, "documents")))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scans of the whole table: the base rules first, then all rules, of which only the others are unseen by then."""
    docs = table(spark, sf_dir, "documents")
    _, ledger = secrets.scan_blobs(docs, rules=[rule for rule in secrets.RULES if rule.kind in secrets.BASE])
    return secrets.digest(secrets.scan_blobs(docs, ledger)[0])


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe(table(spark, sf_dir, "documents"), with_ids=False)


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"), files=False)


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_mixing, op3_exact_dedup, op4_line_dedup, op5_suffix_dedup, op6_secrets, op7_bpe, op8_minhash, op9_html, op10_media)}
ORACLES = {"op3_exact_dedup": exact_dedup.OP3_SQL, "op4_line_dedup": line_dedup.OP4_SQL}
