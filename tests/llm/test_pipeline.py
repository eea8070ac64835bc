import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(["an", "er", "in", "on", "th"]) for _ in range(rng.randrange(1, 5))) for _ in range(n))


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """A small corpus with one case of each kind; ids over 100 are the planted ones."""
    where = str(tmp_path_factory.mktemp("planted"))
    clean = {i: prose(i, 120) for i in range(60)}
    item, passage = prose(900, 30), prose(901, 60)
    docs = dict(clean)
    docs[101] = clean[7]
    docs[102] = clean[8].replace(clean[8].split()[60], "zzz", 1)
    docs[103] = f"{prose(902, 80)} {item} {prose(903, 80)}"
    docs[104] = f"{prose(904, 80)} {passage} {prose(905, 80)}"
    docs[105] = f"{prose(906, 80)}\n{passage}\n{prose(907, 80)}"
    for i in range(40):
        docs[200 + i] = " ".join(f"{w.upper()}!!" for w in prose(300 + i, 100).split())
    docs |= {300: None, 301: ""}
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    labels = [(i, 0 if 200 <= i < 300 else 1, 0) for i in docs if i < 300]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where, docs, passage


def test_stages_catch_what_is_planted_and_keep_the_rest(spark, planted):
    where, docs, passage = planted
    frame = spark.read.parquet(f"{where}/documents.parquet")
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["quality classifier", "MinHash near-dedup", "substring dedup", "benchmark decontamination", "packing"]
    seen = []
    for name, stage in pipeline.STAGES[:-1]:
        frame = pipeline.cut(stage(spark, frame, where), "test")
        assert frame.columns == COLUMNS
        seen.append({r["doc_id"]: r["text"] for r in frame.collect()})
    clean = set(range(60))
    assert clean | {101, 102, 103, 104, 105} <= set(seen[0]) and not {i for i in seen[0] if 200 <= i < 300}
    assert clean <= set(seen[1]) and not {101, 102} & set(seen[1])
    assert seen[2][104] == docs[104] and passage not in seen[2][105] and seen[2][105] == docs[105].replace(f"{passage}\n", "")
    assert clean <= set(seen[3]) and 103 not in seen[3] and {104, 105} <= set(seen[3])
    last = pipeline.STAGES[-1][1](spark, frame, where)
    assert {r["doc_id"] for r in last.select("doc_id").distinct().collect()} == set(seen[3])
    sizes = last.groupBy("sequence_id").agg(F.sum("length").alias("n")).orderBy("sequence_id").collect()
    assert all(r["n"] == 1024 for r in sizes[:-1])


def test_run(spark, planted):
    assert pipeline.run(spark, planted[0]).where("length > 0").count() > 0 and pipeline.ORACLE_SQL is None


ODD = [(1, "a b c", "en", "s", 5), (1, "a b c", "en", "s", 5), (None, None, None, None, None), (2, None, None, "s", 0), (3, "", "en", None, None), (4, "word " * 30000, "en", "s", 1)]


@pytest.mark.parametrize("rows", [[], ODD])
def test_stages_on_odd_tables(spark, tmp_path, rows):
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, shape).withColumn("n_words", F.lit("clash")).withColumn("kept", F.lit(1))
    spark.createDataFrame([(None, None, None), (1, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(None, None), (1, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == COLUMNS and out.count() == len(rows)  # nothing here is bad, repeated by another document or leaked
    assert pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).groupBy("doc_id").count().count() == len({r[0] for r in rows})
