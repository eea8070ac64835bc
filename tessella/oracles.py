"""DuckDB SQL over the same tables for every registered query of the library."""

from __future__ import annotations

from .functions.text import STOP_WORDS

_S = """
s AS (SELECT CAST(c_nationkey AS VARCHAR) AS question_id, o_orderpriority AS p, year(o_orderdate) AS y, sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS v
      FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3),
q AS (SELECT DISTINCT question_id FROM s)"""
_OK = "CAST(NULL AS VARCHAR) AS error"


def _num(expression: str, error: str = "CAST(NULL AS VARCHAR)") -> str:
    return f"WITH {_S} SELECT question_id, round(CAST(({expression}) AS DOUBLE), 2) AS num, {error} AS error FROM q"


def _of(agg: str, where: str) -> str:
    return f"SELECT {agg} FROM s WHERE s.question_id = q.question_id AND {where}"


def _cell(p: str, y: int) -> str:
    """A statement's cell; an empty one is stood for by the first number of its row."""
    return f"SELECT coalesce(max(v) FILTER (y = {y}), arg_min(v, y)) FROM s WHERE s.question_id = q.question_id AND p = '{p}'"


def _text(expression: str) -> str:
    return f"WITH {_S} SELECT question_id, ({expression}) AS text, {_OK} FROM q"


def _listed(expression: str) -> str:
    return f"WITH {_S} SELECT question_id, {expression} AS listed, {_OK} FROM q"


#: A decimal with two places as plain text.
_PLAIN = "regexp_replace(CAST({} AS VARCHAR), '\\.?0+$', '')"

_NAMED = """named AS (SELECT row_number() OVER (ORDER BY r_name, n_name) - 1 AS row, r_name, n_name,
  row_number() OVER (PARTITION BY r_name ORDER BY n_name) = 1 AS lead, CAST(count(*) OVER (PARTITION BY r_name) AS INTEGER) AS n
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""

_PARTS = """
a AS (SELECT CAST(o_orderkey AS VARCHAR) AS question_id, o_orderpriority, CAST(o_orderkey % 50 AS VARCHAR) || '.pdf' AS file_name, o_orderkey % 10 / 10.0 AS score,
  CASE o_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN '数据未提供' WHEN 2 THEN 'nan' WHEN 3 THEN '[null, ""]' ELSE CAST(o_orderkey AS VARCHAR) END AS answer,
  CASE o_orderkey % 7 WHEN 0 THEN 'invalid' WHEN 2 THEN 'invalid' WHEN 1 THEN 'suspect' WHEN 3 THEN 'suspect' ELSE 'valid' END AS class,
  CASE o_orderkey % 3 WHEN 0 THEN 'rag_miss;no_table' WHEN 1 THEN 'rag_miss' ELSE '' END AS events FROM orders)"""

_STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"

SQL = {
    "grid_cells": f"""WITH {_NAMED}
SELECT CAST(row AS INTEGER) AS row, 0 AS col, r_name AS text, n AS rowspan, lead AS is_anchor FROM named
UNION ALL SELECT CAST(row AS INTEGER), 1, n_name, 1, true FROM named""",
    "grid_structure_partial": f"""WITH {_NAMED}, c AS (
  SELECT row, 0 AS col, n AS rowspan, r_name AS text FROM named WHERE lead UNION ALL SELECT row, 1, 1, n_name FROM named WHERE row = 0)
SELECT 'regions' AS table_id, '{{"row_count": ' || (SELECT count(*) FROM named) || ', "col_count": 2, "cells": [' ||
  string_agg('{{"row": ' || row || ', "col": ' || col || ', "rowspan": ' || rowspan || ', "colspan": 1, "text": "' || text || '"}}', ', ' ORDER BY row, col) || ']}}' AS json FROM c""",
    "grid_roundtrip": f"WITH {_NAMED} SELECT CAST(row AS INTEGER) AS row, r_name AS region, n_name AS nation FROM named",
    "frame_types": f"WITH {_S} SELECT question_id AS table_id, CAST(y AS VARCHAR) AS col_name, count(*) AS numbers, CAST(sum(v) AS DOUBLE) AS total FROM s GROUP BY 1, 2",
    "header_flatten": f"""WITH {_S} SELECT question_id AS table_id, name AS col_name, CAST(sum(v) AS DOUBLE) AS total
FROM s JOIN (VALUES ('金额:上期', 1995), ('金额:本期', 1996), ('金额:上期.1', 1995)) h(name, y) USING (y) GROUP BY 1, 2""",
    "clean_numbers": "SELECT c_custkey, round(c_acctbal, 2) AS balance FROM customer",
    "unit_notes": """SELECT CAST(s_suppkey AS VARCHAR) AS table_id, CASE s_suppkey % 3 WHEN 0 THEN '元' WHEN 1 THEN '万元' ELSE '千元' END AS unit_note,
2 AS n_rows, 2 AS n_cols, false AS has_data, false AS masked FROM supplier""",
    "op_const": _num("7"),
    "op_cell": _num(_cell("2-HIGH", 1996)),
    "op_cells": _listed(f"CAST(({_cell('5-LOW', 1998)}) AS VARCHAR) || '|' || CAST(({_cell('1-URGENT', 1995)}) AS VARCHAR)"),
    "op_diff": _num(f"({_cell('1-URGENT', 1999)}) - ({_cell('5-LOW', 1999)})"),
    "op_sum": _num(_of("sum(v)", "y = 1997")),
    "op_sum_rows": _num(_of("sum(v * CASE p WHEN '2-HIGH' THEN 2 ELSE 1 END)", "y = 1997 AND p IN ('2-HIGH', '5-LOW')")),
    "op_avg": _num(_of("CAST(sum(v) AS DOUBLE) / count(*)", "y = 1997")),
    "op_ratio_sum": _num("SELECT 100 * CAST(sum(v) FILTER (y = 1996) AS DOUBLE) / CAST(sum(v) FILTER (y = 1997) AS DOUBLE) FROM s WHERE s.question_id = q.question_id AND p IN ('1-URGENT', '2-HIGH')"),
    "op_count": _num(_of("count(DISTINCT p)", "true")),
    "op_contains": _text("CASE WHEN EXISTS (SELECT 1 FROM s WHERE s.question_id = q.question_id AND contains(p, 'URGENT')) THEN '是' ELSE '否' END"),
    "op_argmax": _text("SELECT p FROM s WHERE s.question_id = q.question_id AND y = 1997 ORDER BY v DESC, p LIMIT 1"),
    "op_argmin": _text("SELECT p FROM s WHERE s.question_id = q.question_id AND y = 1997 ORDER BY v, p LIMIT 1"),
    "op_rowmax": _text("SELECT CAST(y AS VARCHAR) FROM s WHERE s.question_id = q.question_id AND p = '2-HIGH' ORDER BY v DESC, y LIMIT 1"),
    "op_rowmin": _text("SELECT CAST(y AS VARCHAR) FROM s WHERE s.question_id = q.question_id AND p = '2-HIGH' ORDER BY v, y LIMIT 1"),
    "op_nonzero": _listed("(SELECT string_agg(p, '|' ORDER BY p) FROM s WHERE s.question_id = q.question_id AND y = 1998 AND p > '2-HIGH' AND v <> 0)"),
    "op_seq": _listed(f"CAST(({_of('sum(v)', 'y = 1995')}) AS VARCHAR) || '|' || CAST(({_cell('5-LOW', 1996)}) AS VARCHAR)"),
    "op_subitems": f"SELECT r_name AS question_id, string_agg(n_name, '|' ORDER BY n_nationkey) AS listed, {_OK} FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1",
    "op_colcount": f"""WITH k AS (SELECT p_brand, p_type, count(DISTINCT p_size) AS n FROM part GROUP BY 1, 2)
SELECT p_brand AS question_id, (SELECT p_type FROM k WHERE k.p_brand = b.p_brand ORDER BY n DESC, p_type LIMIT 1) AS text, {_OK} FROM (SELECT DISTINCT p_brand FROM part) b""",
    "answer_batch": f"""WITH {_S}, a AS (
  SELECT question_id || '-max' AS question_id, (SELECT p FROM s WHERE s.question_id = q.question_id AND y = 1997 ORDER BY v DESC, p LIMIT 1) AS answer FROM q
  UNION ALL SELECT question_id || '-sum', (SELECT CAST(sum(v) AS VARCHAR) FROM s WHERE s.question_id = q.question_id AND y = 1997) FROM q
  UNION ALL SELECT question_id || '-top', '{{"row_count": ' || (SELECT count(DISTINCT p) + 1 FROM s WHERE s.question_id = q.question_id) || ', "col_count": 8, "cells": [' ||
    (SELECT string_agg('{{"row": 0, "col": ' || i || ', "rowspan": 1, "colspan": 1, "text": "' || CASE i WHEN 0 THEN '优先级' ELSE CAST(1994 + i AS VARCHAR) END || '"}}', ', ' ORDER BY i) FROM range(8) r(i)) || ']}}' FROM q)
SELECT question_id, answer, CAST(0.9 AS DOUBLE) AS score, 'high' AS confidence FROM a""",
    "format_numbers": f"SELECT c_custkey, {_PLAIN.format('CAST(round(c_acctbal, 2) AS DECIMAL(18, 2))')} AS answer FROM customer",
    "format_arrays": """SELECT o_orderkey, '["' || o_orderpriority || '", ' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE ', ""' END || ', ' ||
  CASE WHEN o_custkey = 0 THEN '"00"' ELSE '"0' || o_custkey || '"' END || ']' AS answer FROM orders""",
    "format_strings": "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_brand || ' ' || p_name ELSE CAST(p_partkey * 1000 AS VARCHAR) END AS answer FROM part",
    "compound_split": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority || '|' || o_orderstatus || '|' || o_custkey END AS parts FROM orders",
    "question_repair": """WITH o AS (
  SELECT o_orderkey AS k, 'q' || (o_orderkey - o_orderkey % 11 % 2) AS id, (o_orderkey % 120) AS f,
    ['extract', 'thinking', '??'][o_orderkey % 97 % 3 + 1] AS t, ['计算总和', '恢复表格结构', '名称是什么', ''][o_orderkey % 89 % 4 + 1] AS q,
    ['string', 'json', 'JSON数组', '百分比，保留一位小数', '填写名称'][o_orderkey % 83 % 5 + 1] AS a FROM orders),
r AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY id ORDER BY k) > 1 THEN 'repeated id' WHEN f > 99 THEN 'missing file' WHEN q = '' THEN 'empty question' ELSE '' END AS reason FROM o)
SELECT k AS row_no, id, CASE WHEN reason = '' THEN lpad(CAST(f AS VARCHAR), 3, '0') || '.pdf' ELSE '' END AS file_name,
  CASE WHEN reason <> '' THEN '' WHEN t <> '??' THEN t WHEN a = 'json' AND q LIKE '恢复%' THEN 'structure' WHEN q LIKE '计算%' THEN 'thinking' ELSE 'extract' END AS question_type,
  CASE WHEN reason <> '' THEN '' WHEN a IN ('string', 'json') THEN a WHEN a LIKE 'JSON%' THEN 'json_array' WHEN a LIKE '百分比%' THEN 'number' ELSE 'string' END AS answer_format, reason FROM r""",
    "range_parse": """WITH o AS (SELECT o_orderkey, CAST(o_orderkey % 30 AS INTEGER) AS n, o_orderkey % 4 AS k FROM orders)
SELECT o_orderkey, CASE k WHEN 1 THEN n + 1 END AS page_lo, CASE k WHEN 1 THEN n + 1 END AS page_hi, CASE k WHEN 0 THEN 0 WHEN 2 THEN n WHEN 3 THEN 0 END AS row_lo,
  CASE k WHEN 0 THEN n WHEN 2 THEN n WHEN 3 THEN 1 END AS row_hi, CASE k WHEN 0 THEN 1 END AS col_lo, CASE k WHEN 0 THEN 1 END AS col_hi, 'regex' AS how FROM o""",
    "tokens_select": """SELECT doc_id, CAST(len(t) AS BIGINT) AS n, sha256(array_to_string(list_sort(t), ' ')) AS digest
FROM (SELECT doc_id, list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9]{2,}'), lambda x: lower(x))) AS t FROM documents)""",
    "query_expand": f"""WITH p AS (SELECT p_partkey, p_brand || '的' || p_name || '，多少？' AS q, list_filter(string_split_regex(p_brand || '的' || p_name || '，多少？', '[，。？；：、,\\.?:;！!（）()【】\\[\\]\\s]+'), lambda x: x <> '') AS parts FROM part),
t AS (SELECT p_partkey, q, flatten(list_transform(parts, lambda p: CASE WHEN length(p) <= 4 THEN [p] ELSE
  list_concat([p], list_transform(range(1, length(p)), lambda i: p[i : i + 1]), list_transform(range(1, length(p) - 1), lambda i: p[i : i + 2])) END)) AS t FROM p),
u AS (SELECT p_partkey, q, list_filter(t, lambda x: NOT list_contains({_STOP}, x) AND trim(x) <> '') AS t FROM t),
e AS (SELECT p_partkey, q, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM u),
f AS (SELECT p_partkey, q, w, min(i) AS i FROM e GROUP BY 1, 2, 3)
SELECT p_partkey, q || ' ' || string_agg(w, ' ' ORDER BY i) AS q FROM f GROUP BY p_partkey, f.q""",
    "cosine_topk": """WITH x AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s
  FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS INTEGER) AS rank FROM x)
SELECT query_id, chunk_id, rank, round(s, 4) AS similarity FROM r WHERE rank <= 6""",
    "directed_fallback": """WITH x AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s
  FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS rank FROM x)
SELECT query_id, chunk_id, true AS directed FROM r WHERE rank = 1""",
    "rerank_overlap": """WITH h AS (SELECT p_brand, p_brand || '-' || p_size AS chunk_id, p_size / 100.0 AS s, list(DISTINCT p_type) AS h FROM part GROUP BY p_brand, p_size),
t AS (SELECT DISTINCT p_brand, p_type AS q FROM part),
w AS (SELECT p_brand, q, list_distinct(CASE WHEN length(q) <= 4 THEN [q] ELSE list_concat([q], list_transform(range(1, length(q)), lambda i: q[i : i + 1]), list_transform(range(1, length(q) - 1), lambda i: q[i : i + 2])) END) AS t FROM t),
x AS (SELECT p_brand || ' ' || q AS query_id, chunk_id, s, CASE WHEN count(*) OVER (PARTITION BY p_brand, q) = 1 THEN 0 ELSE
  round(CAST(0.05 AS DOUBLE) * len(list_filter(t, lambda a: len(list_filter(h, lambda b: contains(b, a) OR contains(a, b))) > 0)), 4) END AS rerank_bonus FROM w JOIN h USING (p_brand)),
r AS (SELECT query_id, chunk_id, rerank_bonus, round(s + rerank_bonus, 4) AS adjusted_score FROM x),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY adjusted_score DESC, chunk_id) AS INTEGER) AS place FROM r)
SELECT query_id, chunk_id, place, rerank_bonus, adjusted_score FROM o WHERE place <= 3""",
    "extract_verify": "SELECT CAST(c_custkey AS VARCHAR) AS question_id, c_custkey % 2 = 0 AS verified FROM customer",
    "dedup_files": """WITH d AS (SELECT doc_id, substr(sha1(text), 1, 12) AS file_id, min(doc_id) OVER (PARTITION BY sha1(text)) AS f FROM documents)
SELECT doc_id, file_id, CASE WHEN f < doc_id THEN lpad(CAST(f AS VARCHAR), 9, '0') || '.pdf' END AS dedup_of FROM d""",
    "garbled_text": """WITH d AS (SELECT doc_id, text, regexp_replace(text, '\\s', '', 'g') AS t FROM documents),
n AS (SELECT doc_id, length(t) AS n, length(regexp_replace(t, '[\\p{L}\\p{N}]', '', 'g')) AS odd, length(array_to_string(regexp_extract_all(text, '[A-Za-z]{2,}'), '')) AS latin FROM d)
SELECT doc_id, n >= 4 AND odd > 0.5 * n AS garbled, n >= 100 AND odd > 0.5 * n AND latin < 0.25 * n AS garbled_layer FROM n""",
    "confidence_scores": """WITH e AS (SELECT user_id, event_id // 500 AS block, CASE event_id % 5 WHEN 0 THEN 40 WHEN 1 THEN 20 ELSE 10 END AS lost FROM events),
s AS (SELECT user_id, block, greatest(0.2, (100 - sum(lost)) / 100.0) AS score FROM e GROUP BY 1, 2)
SELECT user_id, block, score, CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS confidence FROM s""",
    "validity_class": f"""WITH {_PARTS} SELECT o_orderpriority, count(*) AS n, count(*) FILTER (class = 'valid') AS valid, count(*) FILTER (class = 'suspect') AS suspect,
count(*) FILTER (class = 'invalid') AS invalid, round(count(*) FILTER (class = 'valid') / count(*), 4) AS rate FROM a GROUP BY 1""",
    "cause_rollup": f"WITH {_PARTS}, e AS (SELECT unnest(string_split(events, ';')) AS cause FROM a) SELECT cause, count(*) AS n FROM e WHERE cause <> '' GROUP BY 1",
    "file_rollup": f"""WITH {_PARTS} SELECT file_name, count(*) AS n, count(*) FILTER (class = 'valid') AS ok, count(*) FILTER (class = 'suspect') AS suspect,
count(*) FILTER (class = 'invalid') AS invalid, round(count(*) FILTER (class = 'valid') / count(*), 4) AS rate, round(avg(score) FILTER (class = 'valid'), 4) AS avg_score FROM a GROUP BY 1""",
    "event_files": f"WITH {_PARTS} SELECT file_name, count(*) AS n, string_agg(question_id, ',' ORDER BY question_id) AS ids FROM a WHERE contains(events, 'no_table') GROUP BY 1",
    "usage_rollup": """SELECT CASE WHEN grouping(event_type) = 1 THEN 'TOTAL' ELSE event_type END AS phase, CAST(sum(CAST(floor(abs(value)) AS BIGINT)) AS BIGINT) AS input_tokens,
CAST(sum(event_id % 7) AS BIGINT) AS output_tokens, CAST(sum(CAST(floor(abs(value)) AS BIGINT) + event_id % 7) AS BIGINT) AS total_tokens, count(*) AS calls FROM events GROUP BY ROLLUP (event_type)""",
    "usage_windows": "SELECT CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS start_s, event_type, count(*) AS n, CAST(sum(event_id) AS DOUBLE) AS total FROM events GROUP BY 1, 2",
    "user_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start_s, count(*) AS n FROM s GROUP BY user_id, k""",
    "audit_flags": """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 5 AS q, o_orderkey % 3 AS a FROM orders),
f AS (SELECT CAST(k AS VARCHAR) AS question_id, list_sort(list_filter([
  CASE WHEN a = 1 THEN 'unreadable' END, CASE WHEN q IN (0, 3, 4) AND a = 2 THEN 'number_asked' END, CASE WHEN q = 2 AND a = 0 THEN 'list_asked' END,
  CASE WHEN q = 1 AND a <> 1 THEN 'yes_or_no_asked' END, CASE WHEN q = 3 AND a = 0 AND k > 100 THEN 'percent_range' END,
  CASE WHEN q = 4 AND a = 0 AND k > 60 THEN 'count_over_rows' END, CASE WHEN a = 2 THEN 'all_equal' END,
  CASE WHEN q = 2 AND a = 0 THEN 'list_expected' END, CASE WHEN q <> 2 AND a = 2 THEN 'one_expected' END], lambda x: x IS NOT NULL)) AS f FROM o)
SELECT question_id, array_to_string(f, ',') AS flags, CAST(len(f) AS INTEGER) AS n_flags FROM f""",
    "replay_diff": f"WITH {_PARTS} SELECT answer NOT IN (CAST(question_id AS VARCHAR)) AS changed, count(*) AS n FROM a GROUP BY 1",
    "submission_pad": f"""WITH {_PARTS} SELECT question_id AS id, answer, 0 AS part FROM a
UNION ALL SELECT id, '', 1 FROM (SELECT DISTINCT CAST(CAST(question_id AS BIGINT) * 2 AS VARCHAR) AS id FROM a) WHERE id NOT IN (SELECT question_id FROM a)""",
    "nearest_lines": """WITH w AS (SELECT l_suppkey AS page_id, l_quantity * 7.25 AS y FROM lineitem),
n AS (SELECT page_id, y, CAST(ceil(y / 20 - 0.5) AS INTEGER) AS row_no FROM w)
SELECT page_id, row_no, count(*) AS n FROM n JOIN supplier ON s_suppkey = page_id WHERE row_no BETWEEN 0 AND 20 AND abs(y - row_no * 20) <= 8 GROUP BY 1, 2""",
}
