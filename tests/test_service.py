import json
import logging
import threading
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

import compare
from tessella import cli, document_queries, logs, prompts, scratch, web
from tessella.operators import geometry
from tessella.plans import expressions, pages, seams
from tessella.sources import store

from test_grid import html


@pytest.mark.parametrize("name", ["question_notes", "range_numerals", "text_rules", "verb_programs", "recognised_pages", "vectors_at_rest", "table_select", "answer_fallbacks"])
def test_query_agrees_with_sql(spark, small, name):
    compare.agree(spark, document_queries.QUERIES[name], document_queries.SQL[name], small)


def test_templates(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.yaml").write_text('name: "first"\nnote: x\ntemplate: |\n  Hi {{ who }}\n    in\n\n  end\nmore: y\n')
    (tmp_path / "deep" / "b.yaml").write_text("template: '{% if big %}B{% else %}s{% endif %}{% for x in xs %}{{ x }};{% endfor %}'\n")
    held = prompts.read_templates(str(tmp_path))
    assert held == {"first": "Hi {{ who }}\n  in\n\nend\n", "b": "{% if big %}B{% else %}s{% endif %}{% for x in xs %}{{ x }};{% endfor %}"}
    assert prompts.render(held["first"], who="me") == "Hi me\n  in\n\nend\n"
    assert prompts.render(held["b"], big=False, xs=[1, 2]) == "s1;2;" and prompts.render(held["b"], big=True, xs=[]) == "B"
    with pytest.raises(KeyError):
        prompts.render(held["first"])
    for bad in ("{% if x %}", "{% while x %}", "{% for x %}{% endfor %}"):
        with pytest.raises(ValueError):
            prompts.parse(bad)
    frame = spark.createDataFrame([(True, ["1", "2"]), (False, [])], "big boolean, xs array<string>")
    got = frame.select(prompts.rendered(held["b"], {"big": F.col("big"), "xs": F.col("xs")}).alias("t")).collect()
    assert [r["t"] for r in got] == ["B1;2;", "s"] and len(prompts.fingerprint(held)) == 8


def test_programs_that_fail_are_rows(spark):
    cells = spark.createDataFrame([("t", r, c, k, n, t) for r, row in enumerate([("a", 3.0), ("b", 1.0), ("c", None)]) for c, (k, n, t) in enumerate([("text", None, row[0]), ("num" if row[1] else "null", row[1], None)])], "table_id string, r int, c int, kind string, num double, text string")
    names = spark.createDataFrame([("t", 0, "name"), ("t", 1, "n")], "table_id string, c int, col_name string")
    said = {
        "sorted": [{"sort": ["-n"]}, {"select": ["name"]}], "sum": [{"agg": {"values": {"s": ["sum", "n"], "k": ["count", "name"], "m": ["max", "n"], "a": ["avg", "n"]}}}], "by": [{"agg": {"by": ["name"], "values": {"k": ["count", "n"]}}}, {"filter": {"col": "k", "op": "=", "value": 0}}],
        "verb": [{"drop": 1}], "column": [{"select": ["x"]}], "compare": [{"filter": {"col": "n", "op": "~", "value": 1}}], "two": [{"head": 1, "sort": []}], "kind": {"head": 1}, "call": [{"agg": {"values": {"s": ["eval", "n"]}}}],
    }
    asked = spark.createDataFrame([(k, "t", "so: " + json.dumps(v)) for k, v in said.items()] + [("none", "t", "no list"), ("lost", "u", "[]")], "question_id string, table_id string, program string")
    got = {}
    for r in expressions.run_programs(cells, names, asked).orderBy("place").collect():
        got.setdefault(r["question_id"], []).append(r["row"] if r["error"] is None else "error")
    assert got["sorted"] == [{"name": "a"}, {"name": "b"}, {"name": "c"}] and got["sum"] == [{"s": "4", "k": "3", "m": "3", "a": "2"}] and got["by"] == [{"name": "c", "k": "0"}]
    assert all(got[k] == ["error"] for k in ("verb", "column", "compare", "two", "kind", "call", "none")) and "lost" not in got


def test_upsert_keeps_other_chunks(spark, tmp_path):
    frame = lambda *rows: spark.createDataFrame(rows, "chunk_id string, file_id string, v int")
    path = str(tmp_path / "c")
    store.upsert(spark, frame(("1", "a", 1), ("2", "a", 1), ("3", "b", 1)), path)
    store.upsert(spark, frame(("2", "a", 2), ("4", "a", 2), ("4", "a", 2)), path)
    assert {(r["chunk_id"], r["v"]) for r in spark.read.parquet(path).collect()} == {("1", 1), ("2", 2), ("3", 1), ("4", 2)}
    assert store.remove_file(spark, path, "a") == 3 and store.remove_file(spark, path, "zz") == 0
    assert [r["chunk_id"] for r in spark.read.parquet(path).collect()] == ["3"]


def test_last_record_counts(spark, tmp_path):
    path = str(tmp_path / "a")
    for said in ("one", "two"):
        store.save_answers(spark.createDataFrame([("1", said)], "question_id string, answer string"), path)
    assert [r["answer"] for r in store.load_answers(spark, path).collect()] == ["two"]


def test_model_tokens_and_vectors(spark):
    asked = spark.createDataFrame([("1", "op", "abc"), ("2", "op", "no")], "question_id string, phase string, prompt string")

    def chat(prompt):
        if prompt == "no":
            raise ValueError("refused")
        return seams.Reply(prompt, 3, 5)

    used = seams.usage(seams.call_model(asked, chat, at_once=1)).collect()
    assert [tuple(r) for r in used] == [("1", "op", 3, 5)]
    sizes = []
    rows = spark.createDataFrame([(i, "x" * i) for i in range(45)], "i int, chunk_text string")

    def encode(texts):
        if len(texts) > 20:
            raise ValueError("too many")
        return [[float(len(t)), 1.0] for t in texts]

    got = seams.embed(rows, encode, at_once=1).collect()
    assert len(got) == 45 and all(r["vector"] == [float(r["i"]), 1.0] for r in got) and not sizes
    assert all(r["vector"] is None for r in seams.embed(rows, lambda t: 1 / 0).collect())


def test_word_tables(spark):
    tables = spark.createDataFrame([(1, [["", None]], 0.0, 9.0, 0.0, 9.0), (2, [["a"], ["b"], ["c"], ["d"]], 0.0, 9.0, 0.0, 9.0)], "page_id int, rows array<array<string>>, left double, right double, top double, bottom double")
    words = spark.createDataFrame([(2, 0, 0.0, 5.0, 0.0, 5.0, "a")], "page_id int, word_id int, x0 double, x1 double, top double, bottom double, text string")
    assert [tuple(r) for r in pages.recognise_words(tables, words).collect()] == [(2, "lines", [["a"], ["b"], ["c"], ["d"]])]
    cells = spark.createDataFrame([(1, r, c, 10.0 * c + r, 10.0 * c + 9) for r in (3, 4) for c in range(2)], "page_id int, row_no int, col_no int, x0 double, x1 double")
    assert {tuple(r) for r in geometry.column_bounds(cells).collect()} == {(1, 0, 3.0, 9.0), (1, 1, 13.0, 19.0)}


def test_logs_roll(tmp_path, monkeypatch):
    monkeypatch.setattr(logs, "SIZE", 200)
    logger = logs.start(str(tmp_path), task="t1")
    logger = logs.start(str(tmp_path), task="t2")
    for i in range(10):
        logger.info("line %d", i)
    held = sorted(p.name for p in tmp_path.iterdir())
    assert len(held) > 1 and "[t2] line 9" in "".join(p.read_text() for p in tmp_path.iterdir()) and sum(isinstance(h, logging.FileHandler) for h in logger.handlers) == 1


def test_shared_folder(spark, monkeypatch):
    class Unset:
        def __getattr__(self, name):
            return lambda: self if name != "isDefined" else False

    class Context:
        master = "yarn"
        _jsc = Unset()

    class Conf:
        @staticmethod
        def get(key, default=None):
            return None

    class Session:
        sparkContext, conf = Context, Conf

    with pytest.raises(ValueError):
        scratch.shared_dir(Session)


def test_service(spark, tmp_path):
    asked = spark.createDataFrame([("1", "a.pdf", "extract", "名称", []), ("2", "b.pdf", "thinking", "多少", ["x"])], "question_id string, file_name string, question_type string, question string, repaired array<string>")
    profiles = spark.createDataFrame([("a.pdf", "B")], "file_name string, category string")
    records = spark.createDataFrame([("1", "x", float("nan"))], "question_id string, answer string, score double")
    usage = spark.createDataFrame([("op", 1, 2)], "phase string, input_tokens int, output_tokens int")
    chunks = spark.createDataFrame([(f"c{i}", "f", "a.pdf", "text", f"t{i}", [1.0]) for i in range(5)], "chunk_id string, file_id string, file_name string, source_engine string, chunk_text string, vector array<double>")
    (tmp_path / "p.yaml").write_text("template: x\n")
    service = web.Service(asked, profiles, lambda: records, usage, chunks, str(tmp_path), answer=lambda key: {"id": key, "v": [float("inf"), (1, {"k": b"b"})]})
    running = web.server(service, port=0)
    threading.Thread(target=running.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{running.server_address[1]}"

    def call(path, post=False):
        try:
            with urllib.request.urlopen(urllib.request.Request(base + path, method="POST" if post else "GET"), timeout=60) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    try:
        assert [r["question_id"] for r in call("/api/questions?status=unanswered")[1]] == ["2"]
        assert call("/api/record/1")[1]["score"] is None and call("/api/record/9")[0] == 404 and call("/nothing")[0] == 404
        assert [r["calls"] for r in call("/api/cost")[1]] == [1, 1] and call("/api/vector/stats")[1][0]["n"] == 5
        page = call("/api/vector/chunks?limit=2&offset=1")[1]
        assert page["total"] == 5 and [r["chunk_id"] for r in page["rows"]] == ["c1", "c2"] and call("/api/vector/chunks?limit=x")[0] == 400
        assert [r["chunk_id"] for r in call("/api/vector/search?q=t3&k=50")[1]] == ["c3"] and call("/api/vector/search?q=")[0] == 400
        assert call("/api/prompts/reload", True)[1] == {"templates": 1} and call("/api/answer/1", True)[1]["answer"] == "x"
        assert call("/api/answer/1?force=1", True)[1]["v"] == [None, [1, {"k": "b'b'"}]] and call("/api/answer/7", True)[0] == 404 and call("/api/ingest/a", True)[0] == 404
    finally:
        running.shutdown()
        running.server_close()


def test_command_line(spark, tmp_path):
    raw = "TABLE_NAME: 名单\n" + html("名称|城市\n甲|京")
    spark.createDataFrame([("f1", "a.pdf", 1, raw), ("f2", "b.pdf", 1, "none")], "file_id string, file_name string, page int, raw string").write.parquet(f"{tmp_path}/pages")
    at = lambda name: f"{tmp_path}/{name}"
    for _ in range(2):
        assert cli.main(["--logs", at("logs"), "ingest", "--pages", at("pages"), "--out", at("tables"), "--chunks", at("chunks")]) == 0
    assert spark.read.parquet(at("tables")).count() == spark.read.parquet(at("chunks")).count() == 1
    cli.main(["reindex", "--tables", at("tables"), "--chunks", at("chunks")])
    (tmp_path / "sheet.csv").write_text("id,file_name,question_type,question,table_hint,answer_format\n1,a.pdf,extract,甲在哪个城市,名单,string\n2,zz.pdf,extract,x,,string\n", encoding="utf-8")
    spark.createDataFrame([("1", "extract", '{"value": "京"}')], "question_id string, phase string, reply string").write.parquet(at("replies"))
    run = ["run", "--sheet", at("sheet.csv"), "--tables", at("tables"), "--out", at("out"), "--chunks", at("chunks")]
    cli.main([*run, "--replies", at("replies")])
    cli.main([*run, "--resume"])
    got = {r["id"]: r["answer"] for r in spark.read.csv(at("out/submission"), header=True).collect()}
    assert got == {"1": "京", "2": None} and spark.read.csv(at("out/skipped"), header=True).count() == 1
