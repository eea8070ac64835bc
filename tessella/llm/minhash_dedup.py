"""Near-duplicate groups: one-permutation MinHash, banded buckets, star-shaped candidates.

1. Documents with the same shingle set are one class; only classes go on.
2. Each class has a one-permutation signature with optimal densification, cut
   into bands; classes that agree on a band share a bucket.
3. In each bucket every class is a candidate of the bucket's smallest one only:
   a star, as many edges as members. Candidates are confirmed on full shingle sets.
4. A star can miss links of members that are unlike its centre. A bucket whose
   members are by now in one component needs no more. In the others, members
   outside the largest component are compared (by signature sketch, block by block)
   with all members of other components, and what is likely is confirmed likewise. So a pair
   of a common bucket is either confirmed, ruled out or already connected.

With 128 bins and bands of 4, a pair of similarity 0.8 shares no bucket with a
chance of 5e-8. Sketches only rule out pairs that are over five standard
deviations below the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from ._minhash import BINS, bands, shingle_sets, signatures, sketches
from ..scratch import cut, drop
from . import _carry
from ._words import slices
from .components import connected_components

GRAM = 5
PERCENT = 80
ROWS = 4
#: Shingles of one side of a comparison block.
BLOCK_SHINGLES = 1 << 20
#: Text confirmed together, and text of one star's share.
GROUP_BYTES = 8 << 20
SHARE_BYTES = 4 << 20
#: About how many bytes of text a shingle stands for.
_PER_SHINGLE = 8


def _describe(gram: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch.column("_text")):
                hashes, first = shingle_sets(texts, gram)
                signature = signatures(hashes, first)
                band = bands(signature, rows)
                n = np.diff(first)
                raw = hashes.tobytes()
                keys = [xxhash.xxh3_128_digest(raw[8 * a : 8 * b]) for a, b in zip(first, first[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("_id").slice(at, len(texts)),
                        pa.array(n, pa.int64()),
                        pa.array(keys, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * band.shape[1], pa.int32()), pa.array(band.view(np.int64).ravel())),
                        pa.array([s.tobytes() for s in sketches(signature)], pa.binary()),
                    ],
                    ["_id", "n", "key", "bands", "sketch"],
                )

    return run


def _least_likely(n: np.ndarray, percent: int) -> np.ndarray:
    """Share of equal bins below which a pair of the threshold's similarity is not to be expected.

    Densified bins agree independently, so the share spreads like a binomial one;
    simulated sets of 9 to 3000 shingles stay within 1.25 times that spread, those of
    32 and more within 1.1 times.
    """
    p = percent / 100
    return p - 5 * np.sqrt(p * (1 - p) / BINS) * np.where(n < 32, 1.25, 1.1)


def _likely(percent: int):
    """Keep pairs whose sketches allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, BINS) for c in ("sa", "sb"))
                least = np.minimum(b.column("na").to_numpy(), b.column("nb").to_numpy())
                keep = (x == y).mean(1) >= _least_likely(least, percent)
                yield b.select(["a", "b", "na", "nb"]).filter(pa.array(keep))

    return run


def _cells(*columns: np.ndarray) -> list[int]:
    """Edges of the runs in which all columns stay the same."""
    if not len(columns[0]):
        return []
    new = np.ones(len(columns[0]) + 1, bool)
    new[1:-1] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.flatnonzero(new).tolist()


def _crossings(percent: int):
    """In each block of an unsettled bucket: who has likely partners in other components, and the partners.

    One row for each such outsider with the list of its partners, and one for each partner, so the
    rows stay in proportion to the members however many pairs there are.
    """

    def run(key, table):
        table = table.sort_by([("h", "ascending"), ("part", "ascending"), ("side", "ascending")])
        h, part, side, rep, n, comp = (table.column(c).to_numpy() for c in ("h", "part", "side", "rep", "n", "comp"))
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, BINS)
        band = np.array(table.column("bands").combine_chunks().flatten()).reshape(len(h), -1)
        rows, partners = [], []
        edge = _cells(h, part)
        for a, b in zip(edge, edge[1:]):
            mid = a + int(np.searchsorted(side[a:b], 1))  # side 0: outside the largest component; 1 and 2: all members
            if mid in (a, b):
                continue
            met = np.zeros(b - mid, bool)
            for i in range(a, mid):
                j = np.arange(mid, b)
                # Two outsiders meet twice; take them once. Sizes must allow the similarity.
                j = j[(comp[j] != comp[i]) & ((side[j] == 2) | (rep[j] > rep[i])) & (100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i]))]
                if not len(j):
                    continue
                j = j[(sketch[j] == sketch[i]).mean(1) >= _least_likely(np.minimum(n[j], n[i]), percent)]
                # Of the buckets that both share, only the first reports them.
                j = j[band[j, np.argmax(band[j] == band[i], axis=1)] == h[i]]
                if len(j):
                    met[j - mid] = True
                    rows.append(i)
                    partners.append(rep[j].tolist())
            members = (np.flatnonzero(met) + mid).tolist()
            rows += members
            partners += [None] * len(members)
        out = table.select(["h", "part", "rep", "n", "comp"]).take(pa.array(rows, pa.int64()))
        return out.append_column("partners", pa.array(partners, pa.list_(pa.int64())))

    return run


def _confirm_crossings(gram: int, percent: int):
    """One link at most between an outsider and each other component of its block, on full shingle sets."""

    def run(key, table):
        table = table.sort_by([("h", "ascending"), ("part", "ascending")])
        h, part, rep, comp = (table.column(c).to_numpy() for c in ("h", "part", "rep", "comp"))
        partners = table.column("partners").to_pylist()
        left, right = [], []
        edge = _cells(h, part)
        for a, b in zip(edge, edge[1:]):
            sets = _sets(table.column("_text").slice(a, b - a).combine_chunks(), gram)
            place: dict[int, list[int]] = {}
            for i in range(a, b):
                if partners[i] is None:
                    place.setdefault(int(rep[i]), []).append(i)
            for i in range(a, b):
                mine = [j for x in partners[i] or () for j in place.get(x, ())]
                for j in _linked(sets[i - a], [sets[j - a] for j in mine], percent):
                    left.append(int(rep[i]))
                    right.append((int(comp[mine[j]]), int(rep[mine[j]])))
        once = {(a, c): b for a, (c, b) in zip(left, right)}
        return pa.table({"a": pa.array([a for a, _ in once], pa.int64()), "b": pa.array(list(once.values()), pa.int64())})

    return run


def _sets(texts: pa.Array, gram: int) -> list[np.ndarray]:
    sets: list[np.ndarray] = []
    for _, part in slices(texts):
        hashes, first = shingle_sets(part, gram)
        sets += [hashes[i:j] for i, j in zip(first, first[1:])]
    return sets


def _linked(own: np.ndarray, others: list[np.ndarray], percent: int) -> list[int]:
    """Which of the other sets reach the similarity."""
    some = [k for k, x in enumerate(others) if len(x)]
    if not len(own) or not some:
        return []
    size = np.array([len(others[k]) for k in some])
    joined = np.concatenate([others[k] for k in some])
    place = np.minimum(np.searchsorted(own, joined), len(own) - 1)
    both = np.add.reduceat((own[place] == joined).astype(np.int64), np.cumsum(size) - size)
    return [some[k] for k in np.flatnonzero(100 * both >= percent * (size + len(own) - both))]


def _confirm(gram: int, percent: int):
    """Links among candidates, on full shingle sets."""

    def run(key, table):
        table = table.sort_by([("a", "ascending"), ("salt", "ascending")])
        a, salt, node = (table.column(c).to_numpy() for c in ("a", "salt", "_id"))
        left, right = [], []
        edge = _cells(a, salt)
        for i, j in zip(edge, edge[1:]):
            sets = _sets(table.column("_text").slice(i, j - i).combine_chunks(), gram)
            members = [k for k in range(i, j) if node[k] != a[k]]
            for c in (k for k in range(i, j) if node[k] == a[k]):
                for k in _linked(sets[c - i], [sets[k - i] for k in members], percent):
                    left.append(a[i])
                    right.append(node[members[k]])
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return run


def _links(pairs: DataFrame, texts: DataFrame, gram: int, percent: int, cores: int) -> DataFrame:
    """Confirmed pairs (a, b) of candidates (a, b, na, nb); a star's members are dealt in shares of bounded size."""
    share = pairs.groupBy("a").agg(F.ceil((F.sum("nb") * _PER_SHINGLE) / SHARE_BYTES).alias("shares"))
    dealt = pairs.join(share, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("shares")))
    need = dealt.select("a", "salt", F.col("b").alias("_id")).union(dealt.select("a", "salt", F.col("a").alias("_id"))).distinct()
    volume = int(pairs.agg(F.sum("na") + F.sum("nb")).first()[0] or 0) * _PER_SHINGLE
    groups = max(2 * cores, -(-volume // GROUP_BYTES))
    got = texts.join(need, "_id").select(F.pmod(F.xxhash64("a", "salt"), F.lit(groups)).alias("_group"), "a", "salt", "_id", "_text")
    return got.groupBy("_group").applyInArrow(_confirm(gram, percent), "a long, b long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, percent: int = PERCENT, rows: int = ROWS) -> DataFrame:
    """Groups of documents that are linked by a Jaccard similarity of ``percent`` or more.

    One row for each row of ``docs``: ``id_col``, ``n_shingles`` (size of the set
    of distinct ``gram``-word shingles), ``component_id`` (smallest id reachable
    by links, the row's own included) and ``kept`` (whether that is its own).
    Other columns of ``docs`` are not read.

    Words are lower-cased (A-Z) and split at ASCII white space. A text of fewer
    than ``gram`` words is one shingle; a null or empty text, or one without words,
    has none and is linked with nothing. Texts are read whole. Rows that repeat
    an id are one document with the links of all its texts. A row with a null id is linked
    with nothing, has a null ``component_id`` and is kept. Ids must be integers. No rows give no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    if BINS % rows:
        raise ValueError(f"rows must divide {BINS}")
    cores = spark.sparkContext.defaultParallelism
    named = docs.select(_carry.column(id_col).cast("long").alias("_id"), _carry.column(text_col).alias("_text"))
    shape = "_id long, n long, key binary, bands array<long>, sketch binary"
    seen = cut(named.mapInArrow(_describe(gram, rows), shape), "minhash")
    full = seen.where("_id IS NOT NULL AND n > 0")
    classes = cut(full.groupBy("key").agg(F.min("_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "minhash-classes")

    banded = classes.select("rep", "n", F.posexplode("bands").alias("band", "h")).withColumn("h", F.xxhash64("band", "h"))
    centres = banded.groupBy("h").agg(F.min(F.struct("rep", "n")).alias("c"), F.max("rep").alias("last")).where("c.rep < last")
    buckets = cut(banded.select("h", "rep", "n").join(centres, "h").select("h", "rep", "n", F.col("c.rep").alias("a"), F.col("c.n").alias("na")), "minhash-buckets")
    texts = cut(named.join(buckets.select(F.col("rep").alias("_id")).distinct(), "_id").select("_id", "_text"), "minhash-texts")

    fits = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    star = buckets.where("rep <> a").select("a", F.col("rep").alias("b"), "na", F.col("n").alias("nb")).where(fits).distinct()
    sketch = lambda node, name: classes.select(F.col("rep").alias(node), F.col("sketch").alias(name))
    star = cut(star.join(sketch("a", "sa"), "a").join(sketch("b", "sb"), "b").mapInArrow(_likely(percent), "a long, b long, na long, nb long"), "minhash-star")
    # A document whose rows differ ties the classes of its texts together.
    classed = seen.select("_id", "n", "key").join(classes.select("key", "rep"), "key", "left").withColumn("rep", F.when(F.col("n") > 0, F.col("rep")))
    own = classed.where("rep IS NOT NULL").select("_id", "rep").distinct()
    own = own.join(own.groupBy("_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b"), "_id").where("rep > a").select("a", F.col("rep").alias("b"))
    links = cut(_links(star, texts, gram, percent, cores).union(own), "minhash-links")
    known = cut(connected_components(links), "minhash-known")

    settled = buckets.join(known.withColumnRenamed("node", "rep"), "rep", "left").select("h", "rep", "n", F.coalesce("component", "rep").alias("comp"))
    size = settled.groupBy("h", "comp").agg(F.count("*").alias("members"), F.sum("n").alias("volume"))
    main = size.groupBy("h").agg(F.max_by("comp", F.struct("members", "comp")).alias("main"), F.count("*").alias("comps"), F.sum("volume").alias("volume"), F.max_by("volume", F.struct("members", "comp")).alias("inner")).where("comps > 1")
    main = main.select("h", "main", F.ceil(F.col("volume") / BLOCK_SHINGLES).alias("columns"), F.ceil((F.col("volume") - F.col("inner")) / BLOCK_SHINGLES).alias("lines"))
    code = F.transform("bands", lambda x, i: F.xxhash64(i, x))
    open_ = settled.join(main, "h").join(classes.select("rep", "sketch", code.alias("bands")), "rep")
    mine = lambda n, salt: F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(n))
    outside = F.col("comp") != F.col("main")
    # Cell (line, column): a block of outsiders against a block of members; side 1 are outsiders as members, side 2 the largest component.
    to_lines = open_.where(outside).withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("columns") - 1))).withColumn("part", mine("lines", 1) * F.col("columns") + F.col("cell")).withColumn("side", F.lit(0))
    to_columns = open_.withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lines") - 1))).withColumn("part", F.col("cell") * F.col("columns") + mine("columns", 2)).withColumn("side", F.when(outside, 1).otherwise(2))
    shape = ["h", "part", "side", "rep", "n", "comp", "sketch", "bands"]
    cells = to_lines.select(shape).union(to_columns.select(shape))
    volume = settled.join(main, "h").agg(F.count("*")).first()[0]
    groups = max(2 * cores, -(-volume // 20_000))
    shape = "h long, part long, rep long, n long, comp long, partners array<long>"
    crossing = cut(cells.withColumn("_group", F.pmod(F.xxhash64("h", "part"), F.lit(groups))).groupBy("_group").applyInArrow(_crossings(percent), shape), "minhash-crossings")
    volume = int(crossing.agg(F.sum("n")).first()[0] or 0) * _PER_SHINGLE
    groups = max(2 * cores, -(-volume // GROUP_BYTES))
    got = crossing.join(texts.withColumnRenamed("_id", "rep"), "rep").withColumn("_group", F.pmod(F.xxhash64("h", "part"), F.lit(groups)))
    more = got.groupBy("_group").applyInArrow(_confirm_crossings(gram, percent), "a long, b long")
    group = cut(connected_components(known.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)), "minhash-groups")
    for table in (buckets, texts, star, links, known, crossing):
        drop(table)

    found = classed.join(group.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.when(F.col("_id").isNotNull(), F.coalesce("component", "rep", "_id"))
    return found.select(F.col("_id").cast(docs.schema[id_col].dataType).alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True))
    )


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` but for all documents of a group after its first; rows with null ids stay.

    Rows that repeat the id of a group's first document all stay. Columns may have any names.
    """
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, gram=gram, percent=percent)
    gone = found.where(~F.col("kept")).select(F.col(id_col).alias("_id")).distinct()
    rows = docs.select(_carry.own(docs.columns), _carry.column(id_col).alias("_id"))
    return _carry.unpacked(rows.join(gone, "_id", "left_anti"), docs.columns, [])


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents on four-word shingles."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), gram=4)


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[p : p + 3], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 0) + 2)) AS p FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM x JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id, coalesce(c.component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
