"""The corpus pipeline: language ID, quality rules, near-duplicates, repeated
passages, packing. Each stage works on all that the one before kept; all but the
last return the columns of ``documents``. Part of the training-data operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearspan.llm import language_id, quality_rules
from nearspan.llm.common import materialize, spread, table
from nearspan.llm.near_duplicates import near_duplicates, text_hash
from nearspan.llm.packing import pack
from nearspan.llm.repeats import remove_repeats

#: Least score of a language prediction that is trusted.
LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, or whose language is a guess, go."""
    labelled = docs.where(~language_id.held_out() & F.col("doc_id").isNotNull())
    model = language_id.learn(labelled, "text", "lang")
    found = language_id.predict(docs, model)
    return found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*(F.col(f"`{c}`") for c in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the base or the learned list rejects go."""
    rules = quality_rules.learn(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, rules).where("kept").select("_row.*")


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts that are alike in five-word shingles, the one of
    the smallest id stays; so do rows without an id. Of rows with one id
    and different texts those go whose own text does. Rows that repeat a document,
    id and text, stay or go together."""
    judged = near_duplicates(docs, width=5, percent=80)
    gone = judged.where(~F.col("kept")).select(F.col("doc_id").alias("_gone"), F.col("text_hash").alias("_hash")).distinct()
    own = (F.col("doc_id") == F.col("_gone")) & (text_hash(F.col("text")) == F.col("_hash"))
    return docs.join(gone.hint("merge"), own, "left_anti")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What repeats an earlier passage of 100 bytes or more is cut out; a
    document stays even if nothing of it is left."""
    judged = remove_repeats(docs, characters=True)
    new = {c: F.col(f"_row.`{c}`") for c in docs.columns}
    new["text"] = F.col("kept_text")
    if "n_chars" in new:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length("kept_text")).otherwise(new["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return judged.select(*(new[c].alias(c) for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens."""
    return pack(docs)


STAGES = [("language_id", language), ("quality_rules", quality), ("near_duplicates", near_duplicate), ("repeated_passages", repeated_passages), ("packing", packing)]

#: The learned stages have no SQL; tests compare the others with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each written and read again."""
    docs = spread(table(spark, sf_dir, "documents"), "doc_id")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
