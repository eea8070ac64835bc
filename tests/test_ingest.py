import pytest
from pyspark.sql import functions as F

from tessella import settings
from tessella.operators import geometry, retrieve
from tessella.plans import ingest, report
from tessella.sources import store

from test_grid import SIMPLE


@pytest.fixture(scope="module")
def ingested(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("ingest"))
    files = spark.createDataFrame([("f1", "a.pdf", None), ("f2", "b.png", None), ("f1", "c.pdf", "a.pdf"), ("f3", "d.pdf", None)], "file_id string, file_name string, dedup_of string")
    pages = spark.createDataFrame([("f1", "/a", 1, "B"), ("f2", "/b", 1, "C"), ("f3", "/d", 1, "B")], "file_id string, path string, page int, category string")

    def read(prompt, path, page):
        return f"TABLE_NAME: read {path}\n{SIMPLE}" if path == "/a" else "no tables"

    def see(prompt, path, page):
        if prompt == "table_recognition":
            raise OSError("timeout")
        return f"TABLE_NAME: seen {path}\n{SIMPLE}"

    n = ingest.ingest(files, pages, None, "fp", read, see, f"{where}/tables", f"{where}/chunks")
    return n, files, store.load_tables(spark, f"{where}/tables"), spark.read.parquet(f"{where}/chunks"), where


def test_ingest_routes_and_falls_back(ingested):
    n, files, tables, chunks, _ = ingested
    assert n == 3
    assert {(r["file_id"], r["table_name"], r["source_engine"]) for r in tables.collect()} == {("f1", "read /a", "text"), ("f2", "seen /b", "vision"), ("f3", "seen /d", "vision")}
    text = chunks.where("file_id = 'f1'").first()["chunk_text"]
    assert text.startswith("文件: a.pdf\n表名: read /a\n页码: 1\n行列: 3x2\n单位: -\n业务: 含列: 城市 / 人口\n表头: 城市 | 人口\n表头: ")
    assert {r["fresh"] for r in retrieve.fresh_template(chunks).collect()} == {True}
    assert store.missing(files.where("dedup_of IS NULL"), tables, "fp").count() == 0


def test_reindex_only_what_is_old(spark, ingested):
    _, files, tables, chunks, where = ingested
    old = chunks.withColumn("chunk_text", F.when(F.col("file_id") == "f2", "x").otherwise(F.col("chunk_text")))
    old.write.partitionBy("file_id").parquet(f"{where}/old")
    ingest.reindex(tables, files.where("dedup_of IS NULL"), spark.read.parquet(f"{where}/old"), f"{where}/old")
    assert all(r["chunk_text"].startswith("文件") for r in spark.read.parquet(f"{where}/old").collect())


def test_retrieval_diagnosis(spark, ingested):
    query = spark.createDataFrame([("q", "甲 人口", "f1")], "query_id string, question string, file_id string").withColumn("vector", ingest.seams.hashed_vector(F.col("question")))
    rows = report.diagnose_retrieval(query, ingested[3], "人口").collect()
    assert len(rows) == 1 and rows[0]["has_keyword"] and rows[0]["rank"] == 1


def test_search_scores_few_of_all_pairs(spark, monkeypatch):
    import math

    vectors = {f"c{i:03d}": [float((i * k) % 5 - 2) for k in (1, 3, 7)] + [float(i % 2)] for i in range(400)}  # many are alike, some have no length
    asked = {f"q{i}": [float(i % 3), float(i % 4 - 1), 1.0, float(i % 2)] for i in range(20)}
    scored = spark.sparkContext.accumulator(0)
    dot = lambda a, b: sum((x * y for x, y in zip(a, b)), 0.0)

    @F.udf("double")
    def counted(a, b):
        scored.add(1)
        norm = math.sqrt(sum((x * x for x in a), 0.0)) * math.sqrt(sum((x * x for x in b), 0.0))
        return sum((x * y for x, y in zip(a, b)), 0.0) / norm if norm else None

    monkeypatch.setattr(retrieve.S, "cosine", counted)
    monkeypatch.setattr(retrieve, "BLOCK", 512, raising=False)
    q = spark.createDataFrame([(k, v, "f") for k, v in asked.items()], "query_id string, vector array<double>, file_id string")
    chunks = spark.createDataFrame([(k, v, "f") for k, v in vectors.items()], "chunk_id string, vector array<float>, file_id string")
    got = retrieve.search(q, chunks, least=-1.0).collect()
    cosine = lambda a, b: dot(a, b) / (math.sqrt(dot(a, a)) * math.sqrt(dot(b, b)))
    want = {k: sorted((-cosine(a, b), c) for c, b in vectors.items() if any(b))[:6] for k, a in asked.items()}
    assert {(r["query_id"], r["rank"]): (-r["similarity"], r["chunk_id"]) for r in got} == {(k, i + 1): x for k, v in want.items() for i, x in enumerate(v)}
    assert 0 < scored.value <= 2 * 20 * 6 * 4  # of 8,000 pairs; a filter and a column each score six of each of four blocks


def test_quality_page(spark):
    rows = [("1", "a.pdf", "extract", "x", 0.9, "high", ""), ("2", "a.pdf", "extract", "", 0.2, "low", "no_table;rag_miss"), ("3", "<b>", "thinking", "数据未提供", 0.5, "medium", "rag_miss")]
    page = report.quality_page(spark.createDataFrame(rows, "question_id string, file_name string, question_type string, answer string, score double, confidence string, events string"))
    assert "&lt;b&gt;" in page and "<td>rag_miss</td><td>2</td>" in page and "<td>a.pdf</td><td>2</td><td>1</td>" in page


def test_settings(tmp_path):
    (tmp_path / "s").write_text("# c\ntop_k: 5\nmin_similarity: 0.4\n")
    got = settings.load(str(tmp_path / "s"), {"TESSELLA_TOP_K": "7"})
    assert (got.top_k, got.min_similarity, got.retries) == (7, 0.4, 5)
    (tmp_path / "t").write_text("nope: 1\n")
    with pytest.raises(ValueError):
        settings.load(str(tmp_path / "t"), {})


def test_titles_and_side_columns(spark):
    lines = spark.createDataFrame([("t", 70.0, "1．收入", 100.0), ("t", 90.0, "单位：元", 100.0), ("u", 90.0, "期末余额", 100.0), ("v", 95.0, "附表", 100.0)], "table_id string, top double, text string, table_top double")
    assert {r["table_id"]: r["title"] for r in geometry.title(lines).collect()} == {"t": "1．收入", "u": None, "v": "附表"}
    words = spark.createDataFrame([(1, i, 0.0, 8.0, 20.0 * i + 1, 20.0 * i + 9, f"w{i}") for i in range(3)] + [(1, 9, 30.0, 40.0, 0.0, 8.0, "inside")], "page_id int, word_id int, x0 double, x1 double, top double, bottom double, text string")
    rows = spark.createDataFrame([(1, i, 20.0 * i, 20.0 * i + 10) for i in range(3)], "page_id int, row_no int, top double, bottom double")
    assert {(r["side"], r["row_no"], r["text"]) for r in geometry.side_columns(words, rows, 10.0, 100.0).collect()} == {("left", i, f"w{i}") for i in range(3)}
    columns = spark.createDataFrame([(1, 0, 0.0), (1, 1, 32.0), (1, 2, 60.0)], "page_id int, col_no int, x0 double")
    assert [r["text"] for r in geometry.words_row(words, columns, 0, 10).orderBy("col_no").collect()] == ["w0", "inside", None]
    assert [len(r["rows"]) for r in geometry.rebuild(words).collect()] == [3]
