"""The pipeline's stages on planted cases, and its place in the entry module."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline


@pytest.fixture(scope="module")
def final(spark, sf):
    return corpus_pipeline.run(spark, sf[0])


def test_runs(spark, sf, final):
    assert final.count() > 30 and final.where("NOT round_trip OR NOT parity").count() == 0
    assert corpus_pipeline.run(spark, sf[1]).count() == 0


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf[0]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf[0]).columns == docs.columns


def test_stages_carry_columns_of_any_name(spark, sf):
    """Names that operators use inside or add themselves come back with their values."""
    odd = ["score", "k1", "k2", "spans", "_p1", "_p2", "n_bytes", "removed", "kept", "_id", "_hash", "_null", "shard", "_b", "ids", "a b`c"]
    docs = spark.read.parquet(f"{sf[0]}/documents.parquet")
    wide = docs.select("*", *(F.lit(i).alias(c) for i, c in enumerate(odd)))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, sf[0])
        assert out.columns == wide.columns
        assert {tuple(r)[5:] for r in out.collect()} == {tuple(range(len(odd)))}
        assert stage(spark, docs.drop("n_chars"), sf[0]).columns == [c for c in docs.columns if c != "n_chars"]
    last = corpus_pipeline.tokens(spark, wide, sf[0])
    assert last.columns.count("ids") == 1 and last.first()["score"] == 0 and last.first()["a b`c"] == len(odd) - 1


def test_near_duplicates(spark, sf):
    base = " ".join(f"word{i} other{i % 7}" for i in range(100))
    rows = [(5, base), (3, base), (9, base.replace("word50", "else")), (4, "quite another text of some words"), (8, None), (None, "x"), (7, ""), (4, "quite another text of some words")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = corpus_pipeline.near_duplicates(spark, docs, sf[0])
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in out.collect()) == [-1, 3, 4, 7, 8]


def test_near_duplicates_with_repeated_ids(spark, sf):
    base = " ".join(f"word{i} other{i % 7}" for i in range(100))
    rows = [(4, "quite another text of some words"), (4, base), (4, base), (3, base.replace("word50", "else")), (5, "a third text that is like none of these"), (5, "and a fourth one, of the same id as it")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = corpus_pipeline.near_duplicates(spark, docs, sf[0])
    assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == sorted({rows[0], rows[3], rows[4], rows[5]})


def test_repeats_go_at_whole_characters(spark, sf):
    passage = "".join(chr(0xE0 + i % 31) for i in range(300))
    docs = spark.createDataFrame([(1, "é" + passage + "ü", "fr", "s", 302), (2, "è" + passage + "ö", "fr", "s", 302), (3, "clean text", "fr", "s", 10), (4, None, "fr", "s", None)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = {r["doc_id"]: r for r in corpus_pipeline.repeats(spark, docs, sf[0]).collect()}
    assert out[3]["text"] == "clean text" and out[4]["text"] is None
    assert passage not in out[1]["text"] and out[1]["text"].encode().decode() == out[1]["text"] and out[1]["n_chars"] == len(out[1]["text"])


def test_decontaminate(spark, sf):
    item = "What is 12 km plus 30 km on the way to the old mill by the river?"
    docs = spark.createDataFrame([(1, "Now then. " + item, "en", "s", 1), (2, "Now then. " + item.replace("12", "99"), "en", "s", 1), (3, "a clean text about a mill", "en", "s", 1), (None, None, "en", "s", 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted(str(r["doc_id"]) for r in corpus_pipeline.decontaminate(spark, docs, sf[0]).collect()) == ["3", "None"]


def test_entry_has_it():
    import __spark_entry__

    assert "pipeline" in __spark_entry__.queries() and F is not None
