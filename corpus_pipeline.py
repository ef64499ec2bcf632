"""A cleaning pipeline over the documents table: STAGES in order, each on what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, line_dedup, minhash, mixing, toxicity
from plumbline.llm.common import checkpoint, table

#: Pre-tokens that a worker remembers while the stages before still hold memory.
MEMO_SIZE = 1 << 18


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity model does not reject. It learns from labelled rows that are still there.

    Null and empty texts have no hits and stay. Repeated rows, and rows of one score, are judged alike. Without labels
    all rows stay. An empty table gives an empty result.
    """
    model = toxicity.train(toxicity.id_text(docs), table(spark, sf_dir, "labels"))
    return docs.where(toxicity.scorer(model)(F.coalesce("text", F.lit(""))) < 0.5)


def drop_template_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines of templates that another document has first; rows left without any text go, if they had some.

    Null and empty texts stay, as empty ones. Ties go to the least id and line; rows that repeat id and text are one
    document. n_chars, where there is such a column, is counted again. An empty table gives an empty result.
    """
    keyed = docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    kept = line_dedup.line_dedup(keyed).where("n_dropped = 0 or trim(text) <> ''")
    now = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return kept.select(*(now.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one of least id, a null one last, then of the least text hash.

    Rows are told apart by id and text, so another text of a dropped row's id stays; of rows that repeat both, one
    stays. Empty and null texts are one class. An empty table gives an empty result.
    """
    th = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.select(F.col("doc_id").cast("long").alias("d"), th.alias("t"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    kept = minhash.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("kd"), F.col("text_hash").alias("kt")).distinct()
    one = rows.groupBy("d", "t").agg(F.first("row").alias("row"))
    one = one.join(kept, one.d.eqNullSafe(kept.kd) & (one.t == kept.kt), "left_semi")
    return one.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated so that the languages' tokens meet tempered targets; no row is lost.

    Null and empty texts have no tokens and keep the prior's rate; repeated rows get equal rates. Without labelled rows
    all are one domain and stay as they are. An empty table gives an empty result.
    """
    return mixing.mixed(docs, mixing.labelled(docs, table(spark, sf_dir, "labels")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with digests of the ids and of what they decode to.

    Null and empty texts have no tokens; repeated rows and null ids get a row each. An empty table gives an empty result.
    """
    return bpe.bpe(docs, memo_size=MEMO_SIZE)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_template_lines),
    ("minhash near-dedup", drop_near_copies),
    ("mixing", mix_to_targets),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents. Each result but the last is checkpointed to the shared folder before it is read on."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: A learned classifier and iterative fits are no SQL; tests/llm hold the stages against plain Python instead.
ORACLE_SQL = None
