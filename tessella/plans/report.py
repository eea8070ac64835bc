"""The quality report: aggregates in Spark, a page of HTML from their few rows."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import reports, retrieve
from ..scratch import cut

#: Files and suspicious answers that the page lists: the length of a report.
LISTED = 60


def _table(title: str, rows: DataFrame) -> str:
    head = "".join(f"<th>{escape(c)}</th>" for c in rows.columns)
    body = "".join("<tr>" + "".join(f"<td>{escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in rows.collect())
    return f"<h2>{escape(title)}</h2><table><tr>{head}</tr>{body}</table>"


STYLE = "body{font:14px sans-serif;margin:2em}table{border-collapse:collapse;margin:.5em 0}td,th{border:1px solid #ccc;padding:3px 8px;text-align:left}.card{display:inline-block;margin-right:2em}.card b{display:block;font-size:24px}.bar{background:#4a7;height:10px;display:inline-block}"


def _cards(row) -> str:
    shown = {"answers": row["n"], "valid": row["valid"], "suspect": row["suspect"], "invalid": row["invalid"], "rate": f"{100 * (row['rate'] or 0):.1f}%", "mean score": row["avg_score"], "files": row["files"]}
    return "".join(f"<span class=card><b>{escape('-' if v is None else str(v))}</b>{escape(k)}</span>" for k, v in shown.items())


def _bars(title: str, rows: list[tuple[str, int]]) -> str:
    most = max((n for _, n in rows), default=1)
    lines = "".join(f"<tr><td>{escape(str(name))}</td><td>{n}</td><td><span class=bar style='width:{round(200 * n / most)}px'></span></td></tr>" for name, n in rows)
    return f"<h2>{escape(title)}</h2><table>{lines}</table>"


def quality_page(answers: DataFrame) -> str:
    """answers: question_id, file_name, question_type, answer, score, confidence, events (``;``-joined)."""
    rows = answers.withColumn("class", reports.validity(F.col("answer")))
    odd = rows.where("class <> 'valid'").select("question_id", "file_name", "class", F.substr("answer", F.lit(1), F.lit(80)).alias("answer"), "events").orderBy("class", "question_id").limit(LISTED)
    spread = reports.distributions(rows).orderBy("scope", F.desc("n"), "name")
    by = lambda scope: [(r["name"], r["n"]) for r in spread.where(F.col("scope") == scope).limit(LISTED).collect()]
    parts = [
        _cards(reports.summary(rows).first()),
        _table("By type", reports.class_counts(rows, "question_type").orderBy("question_type")),
        _bars("By confidence", by("confidence")),
        _bars("Causes", [(r["cause"], r["n"]) for r in reports.causes(rows).orderBy(F.desc("n"), "cause").limit(LISTED).collect()]),
        _bars("Invalid answers by file", by("file")),
        _table("Files", reports.worst_first(reports.file_rollup(rows), LISTED)),
        _table("Not valid", odd),
        _table("Answers worth a look", reports.drilldown(rows, "no_table|sandbox_fail_direct").select("question_id", "file_name", F.array_join("why", ", ").alias("why")).orderBy("question_id").limit(LISTED)),
    ]
    return f"<!DOCTYPE html><meta charset=utf-8><title>Answer quality</title><style>{STYLE}</style><h1>Answer quality</h1>" + "".join(parts)


def diagnose_retrieval(query: DataFrame, chunks: DataFrame, keyword: str) -> DataFrame:
    """How a query (query_id, question, vector, file_id) finds its file's chunks: keyword, cosine rank and final place."""
    ranked = cut(retrieve.search(query, chunks.withColumn("has_keyword", F.contains("chunk_text", F.lit(keyword))), least=-1.0), "ranked")  # read twice below
    final = retrieve.rerank(ranked.join(query.select("query_id", "question"), "query_id"))
    places = final.select("query_id", "chunk_id", "place", "adjusted_score")
    return ranked.select("query_id", "chunk_id", "has_keyword", "rank", "similarity").join(places, ["query_id", "chunk_id"], "left")
