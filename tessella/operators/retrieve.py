"""Retrieval: chunk texts, vector search, keyword rerank and the choice of a table.

Chunks are searched inside their file, or all of them by a query without a
file. Both sides are dealt in blocks of a bounded size, and each pair of blocks is a task's work.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import similarity as S
from ..functions import text as X
from ..shipping import ship

HEADER_LINES, HTML_CHARS = 3, 6000
TOP_K, LEAST, BONUS, ANNOTATION_SHARE = 3, 0.3, 0.05, 0.5
LOW_SCORE = 0.3
#: Numbers in the vectors of a block (4 MB), and pairs of vectors that are scored at once.
BLOCK, TILE = 1 << 19, 1 << 16


def chunk_text(file_name: Column, table_name: Column, page: Column, n_rows: Column, n_cols: Column, unit: Column, annotation: Column, headers: Column, html: Column) -> Column:
    """Text of one table for the index: facts, business line, header line three times, start of the html."""
    heads = F.slice(F.coalesce(headers, F.array().cast("array<string>")), 1, 12)
    business = F.when(F.coalesce(annotation, F.lit("")) != "", annotation).when(F.size(heads) > 0, F.concat(F.lit("含列: "), F.array_join(F.slice(heads, 1, 5), " / ")))
    header = F.when(F.size(heads) > 0, F.concat(F.lit("表头: "), F.array_join(F.transform(heads, lambda h: F.regexp_replace(h, "\n", " ")), " | ")))
    dash = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("-"))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("文件: "), file_name),
        F.concat(F.lit("表名: "), dash(table_name)),
        F.concat(F.lit("页码: "), page.cast("string")),
        F.format_string("行列: %dx%d", n_rows, n_cols),
        F.concat(F.lit("单位: "), dash(unit)),
        F.concat(F.lit("业务: "), business),
        *[header] * HEADER_LINES,
        F.substr(html, F.lit(1), F.lit(HTML_CHARS)),
    )


def fresh_template(chunks: DataFrame) -> DataFrame:
    """Files all of whose chunks repeat the header line as the current template does: file_id, chunks, fresh."""
    return chunks.groupBy("file_id").agg(F.count("*").alias("chunks"), F.bool_and(F.regexp_count("chunk_text", F.lit("(?m)^表头: ")) >= HEADER_LINES).alias("fresh"))


def search(queries: DataFrame, chunks: DataFrame, *, by: str | None = "file_id", top_k: int = TOP_K, least: float = LEAST) -> DataFrame:
    """Twice ``top_k`` nearest chunks of each query by cosine, those under ``least`` dropped.

    ``queries``: query_id, vector (and ``by``); ``chunks``: chunk_id, vector, ``by``
    and more columns. Where a query names a file and all its chunks fall under ``least``, the nearest stays
    (``directed``). Ties are broken by chunk_id. Vectors of no length match nothing.
    Every pair is scored, block by block; only the nearest of each block are rows. ``chunks`` is read
    three times (counts, blocks, columns of what is found), so one that is dear to make should be a table.
    """
    key = F.col(by) if by else F.lit(0)
    q = queries.select(key.alias("_by"), "query_id", F.col("vector").alias("_q"))
    pairs = _nearest(q.select("_by", "query_id", F.col("_q").alias("_v")), chunks.select(key.alias("_by"), "chunk_id", F.col("vector").alias("_v")), max(1, 2 * top_k))
    # Pairs are few and name what to score; ids that repeat only add rows, which the rank below leaves out.
    pairs = pairs.select(F.col("_by").alias("_at"), F.col("query_id").alias("_query"), F.col("chunk_id").alias("_chunk")).distinct()
    named = pairs.join(q, (F.col("_at") == F.col("_by")) & F.col("_query").eqNullSafe(F.col("query_id"))).drop("_query", "_by")
    met = named.join(chunks.withColumn("_by", key), (F.col("_at") == F.col("_by")) & F.col("_chunk").eqNullSafe(F.col("chunk_id")))
    met = met.select(*([by] if by else []), "query_id", *(c for c in chunks.columns if c != by), "_q")
    scored = met.withColumn("similarity", S.cosine("_q", "vector")).drop("_q", "vector").where("similarity IS NOT NULL")
    order = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "chunk_id")
    near = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= 2 * top_k)
    directed = F.lit(by is not None) & (F.col("rank") == 1) & (F.col("similarity") < least)
    return near.withColumn("directed", directed).where((F.col("similarity") >= least) | F.col("directed"))


def _nearest(q: DataFrame, chunks: DataFrame, most: int) -> DataFrame:
    """_by, query_id, chunk_id of each query's ``most`` nearest chunks in every block of its file's, and maybe more.

    Both sides: _by, an id, _v. Only vectors of one length, without nulls, have a cosine; they are dealt by it.
    """
    ship(q.sparkSession)

    def solid(rows: DataFrame) -> DataFrame:
        held = rows.schema["_v"].dataType
        kept = isinstance(held, T.ArrayType) and isinstance(held.elementType, T.FloatType)  # other numbers go as doubles
        rows = rows if kept else rows.withColumn("_v", F.col("_v").cast("array<double>"))
        return rows.withColumn("_size", F.size("_v")).where((F.col("_size") > 0) & ~F.exists("_v", lambda x: x.isNull()))

    q, chunks = solid(q), solid(chunks)
    blocks = lambda n: F.ceil(F.count("*") * F.col("_size") / BLOCK).cast("int").alias(n)
    at = ["_by", "_size"]
    sizes = chunks.groupBy(at).agg(blocks("_cn")).join(q.groupBy(at).agg(blocks("_qn")), at)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda key, n: F.pmod(F.xxhash64(key, "_v"), F.col(n)).cast("int")
    asked = q.join(sizes, at).select(*at, "query_id", "_v", own("query_id", "_qn").alias("_qb"), each("_cn").alias("_cb"))
    met = chunks.join(sizes, at).select(*at, "chunk_id", "_v", own("chunk_id", "_cn").alias("_cb"), each("_qn").alias("_qb"))
    block = [*at, "_cb", "_qb"]
    names = T.StructType([q.schema["_by"], q.schema["query_id"], chunks.schema["chunk_id"]])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            some = left if left.num_rows else right
            return pa.table({"_by": some["_by"].slice(0, 0), "query_id": left["query_id"].slice(0, 0), "chunk_id": right["chunk_id"].slice(0, 0)})
        try:
            right, sortable = right.take(pc.sort_indices(right, sort_keys=[("chunk_id", "ascending")], null_placement="at_start")), True
        except pa.ArrowNotImplementedError:  # ids of a kind that only Spark can order: all equals stay
            sortable = False
        rows, cols = _top(_matrix(left), _matrix(right), most, sortable)
        return pa.table({"_by": left["_by"].take(rows), "query_id": left["query_id"].take(rows), "chunk_id": right["chunk_id"].take(cols)})

    return asked.groupBy(block).cogroup(met.groupBy(block)).applyInArrow(run, names)


def _matrix(rows: pa.Table) -> np.ndarray:
    """Vectors of one length, a row each."""
    flat = pa.concat_arrays([c.flatten() for c in rows["_v"].chunks])
    return flat.to_numpy(zero_copy_only=False).astype("float64").reshape(rows.num_rows, -1)


def _top(a: np.ndarray, b: np.ndarray, most: int, sortable: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs: the ``most`` nearest rows of ``b`` to each of ``a``, earlier ones of equals, or all equals of the last.

    Products are added in the order of :func:`S.cosine`, so scores are the same to the last bit. NaN is nearest, as in Spark; without a length is none.
    """
    turned = np.ascontiguousarray(b.T)
    rows, cols = [], []
    with np.errstate(all="ignore"):
        lengths = lambda columns: np.sqrt(sum((x * x for x in columns), np.zeros(columns.shape[1])))
        across, down = lengths(turned), lengths(a.T)
        step = max(1, TILE // len(b))
        for i in range(0, len(a), step):
            part = a[i : i + step]
            dot, product = np.zeros((len(part), len(b))), np.empty((len(part), len(b)))
            for d in range(a.shape[1]):
                np.multiply(part[:, d, None], turned[d], out=product)
                dot += product
            norm = down[i : i + step, None] * across
            near = np.nan_to_num(dot / norm, nan=np.inf, posinf=np.finfo("d").max, neginf=np.finfo("d").min)
            near[norm == 0] = -np.inf
            last = np.partition(near, -most, axis=1)[:, -most, None] if len(b) > most else np.full((len(part), 1), -np.inf)
            over, equal = near > last, near == last
            if sortable:
                equal &= np.cumsum(equal, axis=1) <= most - over.sum(axis=1, keepdims=True)
            x, y = np.nonzero((over | equal) & (near > -np.inf))
            rows.append(x + i)
            cols.append(y)
    return np.concatenate(rows), np.concatenate(cols)


def overlap(tokens: Column, targets: Column) -> Column:
    """How many distinct tokens contain, or are contained in, any target."""
    return F.size(F.filter(F.array_distinct(tokens), lambda t: F.exists(targets, lambda h: F.contains(h, t) | F.contains(t, h))))


def rerank(hits: DataFrame, *, top_k: int = TOP_K, bonus: float = BONUS) -> DataFrame:
    """Order of each query's hits by similarity and keyword bonus, cut to ``top_k``; a single hit stays as it is.

    ``hits``: query_id, chunk_id, question, chunk_text, similarity, rank. Adds rerank_bonus and adjusted_score.
    """
    tokens = X.query_tokens(F.col("question"))
    header, note = X.chunk_header(F.col("chunk_text")), X.query_tokens(X.chunk_annotation(F.col("chunk_text")))
    extra = F.round(bonus * (overlap(tokens, header) + ANNOTATION_SHARE * overlap(tokens, note)), 4)
    many = F.col("_many")
    rows = hits.withColumn("_many", (F.count("*").over(Window.partitionBy("query_id")) > 1) & (F.size(tokens) > 0)).withColumn("rerank_bonus", F.when(many, extra).otherwise(0.0)).withColumn("adjusted_score", F.when(many, F.round(F.col("similarity") + F.col("rerank_bonus"), 4)).otherwise(F.col("similarity")))
    order = Window.partitionBy("query_id").orderBy(F.col("adjusted_score").desc(), "rank")
    return rows.withColumn("place", F.row_number().over(order)).where((F.col("place") <= top_k) | ~many).drop("_many")


def select_table(candidates: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """Best table of each question with its score and the events it raises.

    ``candidates``: question_id, question, table_hint, page_lo, page_hi, table_id, table_name, page,
    n_rows, has_data, masked, headers, second_row (array). Tables with data rows come first, then those with two rows,
    then any. Score: named in the question .5; hint against the name .5, or against the header .3;
    shared tokens .3; page in range .2; retrieval rank .4. Ties keep the retrieval order, then table_id.
    ``hits``: query_id, page, table_name, similarity, rerank_bonus.
    """
    tier = F.when((F.col("n_rows") >= 2) & F.col("has_data"), 2).when(F.col("n_rows") >= 2, 1).otherwise(0)
    c = candidates.withColumn("_tier", tier).withColumn("_top", F.max(tier).over(Window.partitionBy("question_id"))).where("_tier = _top")
    if hits is not None:
        h = hits.select(F.col("query_id").alias("question_id"), "page", F.col("table_name").alias("_name"), (F.col("similarity") + F.coalesce("rerank_bonus", F.lit(0.0))).alias("_s"))
        met = c.select("question_id", "table_id", "page", "table_name").join(h, ["question_id", "page"])
        alike = (F.coalesce("_name", F.lit("")) != "") & F.col("table_name").isNotNull() & (S.ratio(F.coalesce("_name", F.lit("")), F.coalesce("table_name", F.lit(""))) > 70)
        ranks = met.withColumn("_s", F.col("_s") + F.when(alike, 0.2).otherwise(0.0)).groupBy("question_id", "table_id").agg(F.max("_s").alias("_rank"))
        c = c.join(ranks, ["question_id", "table_id"], "left")
    else:
        c = c.withColumn("_rank", F.lit(None).cast("double"))
    rank = F.coalesce("_rank", F.lit(0.0))
    best = F.max(rank).over(Window.partitionBy("question_id"))
    name, hint = F.coalesce("table_name", F.lit("")), F.coalesce("table_hint", F.lit(""))
    head = F.array_join(F.coalesce("headers", F.array().cast("array<string>")), " ")
    asked = X.tokens(F.col("question"))
    shown = F.array_union(X.tokens(head), X.tokens(F.array_join(F.coalesce("second_row", F.array().cast("array<string>")), " ")))
    named = (F.length(X.compact(name)) >= 3) & F.contains(X.compact(F.col("question")), X.compact(name))
    hinted = F.when(hint == "", 0.0).when(name != "", 0.5 * S.partial_ratio(hint, name) / 100).otherwise(0.3 * S.partial_ratio(hint, head) / 100)
    score = (
        F.when(named, 0.5).otherwise(0.0)
        + hinted
        + F.when((F.size(asked) > 0) & (F.size(shown) > 0), 0.3 * F.size(F.array_intersect(asked, shown)) / F.size(asked)).otherwise(0.0)
        + F.when(F.col("page").between(F.col("page_lo"), F.col("page_hi")), 0.2).otherwise(0.0)
        + F.when(best > 0, 0.4 * rank / best).otherwise(0.0)
    )
    order = Window.partitionBy("question_id").orderBy(F.col("score").desc(), F.coalesce("_rank", F.lit(0.0)).desc(), "table_id")
    chosen = c.withColumn("score", score).withColumn("_n", F.row_number().over(order)).where("_n = 1")
    events = F.filter(F.array(F.when(F.col("score") < LOW_SCORE, F.lit("table_select_low")), F.when(F.col("masked"), F.lit("mask_in_table"))), lambda e: e.isNotNull())
    return chosen.select("question_id", "table_id", "score", events.alias("events"))


def verify_extract(values: DataFrame, cells: DataFrame) -> DataFrame:
    """Whether every extracted text stands in its table: question_id, verified.

    ``values``: question_id, table_id, items (array of texts, null for what is no text). Texts are
    compared without white space, commas and percent signs; an empty list, a blank or a non-text is not verified.
    """
    held = cells.select("table_id", X.normalised(F.col("text")).alias("t")).distinct()
    each = values.select("question_id", "table_id", F.explode_outer("items").alias("v")).withColumn("t", F.nullif(X.normalised(F.col("v")), F.lit("")))
    met = each.join(held.withColumn("ok", F.lit(True)), ["table_id", "t"], "left")
    return met.groupBy("question_id").agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("verified"))


def needs_vision(value: Column, question: Column, html: Column) -> Column:
    """Whether an extracted value calls for a look at the page itself."""
    missing = X.value_missing(value)
    return missing | F.coalesce(X.markup_leak(value) | X.garbled(value), F.lit(False)) | X.nouns_missing(question, html) | X.vertical(question)
