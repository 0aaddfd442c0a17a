import random

import pytest


@pytest.fixture(scope="session")
def prose():
    """Texts with copies, near copies, shared passages, odd characters and gaps."""
    rng = random.Random(5)
    words = ["".join(rng.choice(["an", "the", "ou", "ré", "ß", "in", "sh"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = make(120)
    texts = [make(rng.randint(1, 200)) for _ in range(60)]
    for i in range(12):
        base = texts[i].split()
        for _ in range(3):
            near = list(base)
            for _ in range(max(1, len(near) // 60)):
                near[rng.randrange(len(near))] = rng.choice(words)
            texts.append("  ".join(near) if rng.random() < 0.3 else " ".join(near))
    texts += [texts[3]] * 5 + [make(30) + "\n" + passage + " " + make(20) for _ in range(6)]
    texts += [None, "", " \n\t", "one", "two words", "A a A a", "x" * 3000, "é" * 700, "🎉 ok 🎉", "a b c", "  x　y  z", "tab\tand\x0bvt\x0cff", make(6000)]
    return texts


@pytest.fixture(scope="session")
def docs(spark, prose):
    """The texts under scattered ids, with a null id, a repeated row, and columns whose names operators use inside."""
    rows = [(7 * i % 1009, t) for i, t in enumerate(prose)] + [(None, "no id here at all"), (7, prose[1]), (7, prose[1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    from pyspark.sql import functions as F

    return df.select("doc_id", "text", F.lit("en").alias("lang"), F.concat(F.lit("s"), F.coalesce(F.col("doc_id"), F.lit(0)) % 3).alias("source"), F.char_length("text").cast("bigint").alias("n_chars"))


@pytest.fixture(scope="session")
def sf(docs, spark, tmp_path_factory):
    """A folder of tables with the documents, and one whose documents are none."""
    top = tmp_path_factory.mktemp("sf")
    for name, df in (("full", docs), ("none", docs.limit(0))):
        df.write.parquet(str(top / name / "documents.parquet"))
        lab = df.where("doc_id IS NOT NULL").selectExpr("doc_id", "cast(length(coalesce(text, '')) > 40 AS int) AS quality", "0 AS toxic").distinct()
        lab.write.parquet(str(top / name / "labels.parquet"))
        bench = spark.createDataFrame([(1, "What is 12 km plus 30 km on the way to the old mill by the river?"), (2, None), (3, "short one")], "item_id bigint, text string")
        (bench if name == "full" else bench.limit(0)).write.parquet(str(top / name / "benchmark.parquet"))
    return str(top / "full"), str(top / "none")
