"""A training-corpus pipeline: five stages over ``documents``, each by one operator.

Every stage takes (spark, docs, sf_dir), works on all rows of its predecessor
and returns a DataFrame; ``run`` writes each result as Parquet in the shared
folder and reads it back as the next stage's input. All but the last return
the columns of ``documents``. Columns besides are carried through every stage,
whatever their names. Null text counts as empty and stays null, null ids stay
null; an empty table gives an empty table.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adspark.llm import op3_sentencepiece, op5_jaccard, op6_suffix_dedup, op7_decontaminate, op9_quality
from adspark.llm.common import NULL_ID, load, materialize, shield

#: Shorter repeats than this many bytes stay; fifty words of prose are longer.
REPEAT_BYTES = 240


def carried(stage):
    """``stage`` with columns beside those of ``documents`` under names that no operator uses, and back."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        docs, back = shield(docs, "doc_id", "text", "lang", "source", "n_chars")
        return back(stage(spark, docs, sf_dir))

    return run_stage


@carried
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under 0.3 go; empty ones are scored like any other, equal rows alike."""
    model = op9_quality.train(docs, load(spark, sf_dir, "labels"))
    return op9_quality.score_documents(docs, model).where("score >= 0.3").select(*docs.columns)


@carried
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at Jaccard 0.8 of five-word shingles, the one with the least id (then text hash) stays.

    Documents without words are linked with nothing and stay; of rows that repeat
    an id and text, one stays; rows without an id stay.
    """
    found = op5_jaccard.similar_documents(docs, width=5, num=80, den=100, keyed=True)
    kept = found.where((F.col("doc_id") == F.col("component_id")) & (F.col("k2") == F.col("component_k2"))).select("doc_id", "k2").distinct()
    keyed = docs.where("doc_id IS NOT NULL").withColumns({"k2": F.xxhash64(F.coalesce("text", F.lit(""))), "_null": F.col("text").isNull()})
    named = keyed.join(kept, ["doc_id", "k2"], "left_semi").dropDuplicates(["doc_id", "k2", "_null"])
    return named.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))


@carried
def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every byte string of REPEAT_BYTES that starts more than once goes; cut characters go whole.

    Rows that repeat lose all of a long text. Where there is ``n_chars``, it is that of what is left.
    """
    cut = op6_suffix_dedup.remove_repeats(docs, length=REPEAT_BYTES)
    cut = cut.withColumn("text", F.when(F.size("removed") == 0, F.col("text")).otherwise(op6_suffix_dedup.kept_text()))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


@carried
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item's template windows with consistent slots go; those without tokens stay."""
    keyed = docs.withColumns({"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), "_hash": F.xxhash64("text")})
    found = op7_decontaminate.contaminated(keyed, load(spark, sf_dir, "benchmark"), keys=("_id", "_hash"))
    bad = materialize(found.select("_id", "_hash").distinct(), "contaminated")
    return keyed.join(bad, ["_id", "_hash"], "left_anti").select(*docs.columns)


@carried
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document in place of its text, with the round trip and the library's parity verified."""
    coded = op3_sentencepiece.encode_documents(docs, op3_sentencepiece.model_file())
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    return coded.select(*others, F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip", "parity")


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeats),
    ("benchmark decontamination", decontaminate),
    ("SentencePiece encoding and decoding", tokens),
]

#: A trained network, exact repeats over bytes and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"stage{i}")
    return docs
