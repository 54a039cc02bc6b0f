"""The corpus pipeline: language ID, near-dedup, substring dedup, packing.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame.  Each stage works on all rows that its predecessor kept.  All but the last return
the columns of documents; ``run`` writes every stage as Parquet into the shared folder and
reads it again.

In every stage an empty table gives an empty result, columns beyond those of documents are
left out, and texts of any length are worked on whole.  A stage sets short Arrow batches on
the session for its plan; ``run`` puts the caller's setting back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.llm.common import stage, table
from postlens.llm.op10_substring_dedup import remove_repeats
from postlens.llm.op3_near_dedup import near_duplicates
from postlens.llm.op6_language import fit, held_out, predict
from postlens.llm.op9_packing import pack, token_pieces
from postlens.llm.registry import register
from postlens.session import clear_stages, stage_mark

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: a document goes, too, if its best language closes less than that share of the gap between
#: mere chance (1 / languages) and certainty
LEAST_LIFT = 1 / 15

BATCHES = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: rows of an Arrow batch: whole texts pass through Python, so batches are kept short
BATCH_ROWS = 2000


def _short_batches(spark: SparkSession) -> None:
    spark.conf.set(BATCHES, str(BATCH_ROWS))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language: those without a text or a letter, or whose best language
    is hardly likelier than chance, go.  Where no row names a language there is nothing to
    learn, and all documents with a letter stay.  Repeated rows are judged alike."""
    _short_batches(spark)
    model = fit(docs.where(~held_out("doc_id")))
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(COLUMNS)
    out = predict(docs, model, keep=("text", "lang", "source", "n_chars"))
    chance = 1 / len(model["names"])
    least = chance + (1 - chance) * LEAST_LIFT
    return out.where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of every group of near-duplicates; of several rows of that id
    the one of least text (null first).  Rows without an id or without words are in no group
    and stay."""
    _short_batches(spark)
    ids = near_duplicates(docs).groupBy("doc_id").agg(F.min("kept").alias("kept"), F.count("*").alias("n"))
    # written, so that its size is known when the join is planned
    marked = stage(ids.where("doc_id IS NOT NULL AND (NOT kept OR n > 1)"), "marked")
    once = docs.join(marked.select("doc_id"), "doc_id", "left_anti").select(COLUMNS)
    again = marked.where("kept").select("doc_id")
    if again.isEmpty():
        return once
    rest = [c for c in COLUMNS if c != "doc_id"]
    least = (docs.join(again, "doc_id", "left_semi").groupBy("doc_id")
             .agg(F.min(F.struct(*rest)).alias("row")).select("doc_id", "row.*"))
    return once.unionByName(least.select(COLUMNS))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 13 words that an earlier document has; a text that loses
    nothing stays as it is (null and empty ones, too), one that loses all of its words goes."""
    _short_batches(spark)
    out = remove_repeats(docs, keep=("text", "lang", "source"), with_text=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return (out.where("n_removed = 0 or n_words > n_removed").withColumn("text", text)
            .withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 4096 tokens; a null text counts as empty."""
    _short_batches(spark)
    return pack(token_pieces(docs))


STAGES = [("language", language), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("packing", packing)]
#: the language model and the tokenizer can't be written in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = spark.conf.get(BATCHES)
    docs = table(spark, sf_dir, "documents")
    try:
        for name, step in STAGES:
            mark = stage_mark()
            docs = stage(step(spark, docs, sf_dir), name)
            clear_stages(spark, mark, but_last=1)
    finally:
        spark.conf.set(BATCHES, before)
    return docs


@register("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed corpus."""
    return run(spark, sf_dir)
