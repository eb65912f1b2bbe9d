"""Exact top-k by inner product, as a Voronoi kNN join.

Vectors are dealt to the nearest of some pivots. A cell of vectors is summed up by its count, its radius
(the largest distance from the pivot) and the distances of its k + 1 vectors next to the pivot; a cell of
queries by its radius and its longest query. With a query q = p + u of the cell of pivot p and a vector x
at distance d from pivot c, Cauchy and Schwarz give

    p.c - |u||c| - |q|d  <=  q.x  <=  p.c + |u||c| + |q|d

so the summaries alone tell a score that k vectors reach with every query of a cell, and which cells of
vectors can't reach it. Only what is left is replicated: query cells that are near each other make up
groups, a group is dealt into bundles of bounded size, a cell into blocks of bounded size, and a block
goes to those bundles alone whose group needs its cell. There each query, whose own bound is tighter
still, is compared with all vectors of the block. A cell of any size, copies of one vector included, is
thus many tasks. The driver sees summaries: a row per pivot, MOST_PIVOTS at most.

Components are turned into floor(256 * x), x as double, and scores are exact integers: in doubles while
they fit, else in 64-bit integers, else in Python's. Where 64 bits can't hold a score, the column score is
null; score_exact holds it in decimal digits always, and the order is that of the exact scores. Ties go to
the smaller id.

Vectors that are null or empty or hold null or non-finite components take no part, nor do null ids;
all others do, of any size. Shorter vectors count as ended with zeros. Each row is a candidate, so
repeated rows stand as often as they occur; rows equal in id and vector ask once; rows with the query's
own id are no candidates for it. An empty table, or one without queries, gives no rows. Columns besides
the id and the vector are left out, so their names never clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frostline.llm import shared

SCALE = 256.0
#: A pivot for every so many vectors' square root; pivots come from a sample of vectors, those with the least hashes.
ROOT_SHARE, LEAST_PIVOTS, MOST_PIVOTS, SAMPLED, ROUNDS = 4, 8, 512, 32, 5
BLOCK, BUNDLE = 4096, 1024
#: Beyond this no bounds are kept: such vectors are in a cell that every query visits, such queries visit every cell.
WIDE, WIDE_CELL = 2.0**200, -1
#: Components up to this are compared apart from larger ones, which need wider integers.
NARROW = 2.0**23


def taking_part(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, vector (array of double) of the rows that take part."""
    x = F.col(vector_col)
    sound = (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & x.isNotNull()).where(sound).select(F.col(id_col).cast("long").alias("vec_id"), x.cast("array<double>").alias("vector"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of an array column, shorter ones ended with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat, ends = np.asarray(column.flatten(), float), np.asarray(column.offsets, np.int64)
    size = np.diff(ends)
    if len(size) and (size == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(size), width))
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], size)] = flat
    return out


def scaled(rows: np.ndarray) -> np.ndarray:
    """floor(256 * x), infinite only where a double doesn't hold it."""
    with np.errstate(over="ignore"):
        return np.floor(SCALE * rows)


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Some rounds of k-means over the sample, from evenly spread distinct rows."""
    rows = np.unique(sample, axis=0)
    pivots = rows[np.linspace(0, len(rows) - 1, min(n, len(rows))).round().astype(int)]
    for _ in range(ROUNDS):
        near = distances(rows, pivots).argmin(axis=1)
        pivots = np.array([rows[near == k].mean(axis=0) if (near == k).any() else p for k, p in enumerate(pivots)])
    return pivots


def distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (rows * rows).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2.0 * rows @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def integers(rows: np.ndarray) -> np.ndarray:
    """floor(256 * x) as Python's integers."""
    s = scaled(rows)
    return np.array([[int(v) if np.isfinite(v) else int(x) * 256 for v, x in zip(a, b, strict=True)] for a, b in zip(s, rows, strict=True)], object).reshape(rows.shape)


def scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products of unscaled vectors, exact: int64 where these hold them, else Python's integers."""
    q, r = scaled(queries), scaled(rows)
    with np.errstate(over="ignore", invalid="ignore"):
        most = np.abs(q).max(initial=0) * np.abs(r).max(initial=0) * max(1, queries.shape[1])
    if most < 2.0**53:
        return (q @ r.T).astype(np.int64)
    if most < 2.0**62 and max(np.abs(q).max(), np.abs(r).max()) < 2.0**62:
        return q.astype(np.int64) @ r.astype(np.int64).T
    return integers(queries) @ integers(rows).T


class Summary:
    """What the driver knows of cells: pivots, counts, radii, distances next to the pivot; and the bounds drawn from it."""

    def __init__(self, pivots: np.ndarray, held: list, asked: list, k: int) -> None:
        """held: rows (pivot, n, radius, nearest) of vectors; asked: rows (pivot, n, radius, length) of queries."""
        self.k, self.pivots = k, pivots
        self.held, self.asked = ({r["pivot"]: r for r in rows} for rows in (held, asked))
        self.cells = sorted(p for p in self.held if p != WIDE_CELL)
        self.centres = pivots[self.cells]
        self.size = np.sqrt((self.centres * self.centres).sum(axis=1))
        self.radius = np.array([self.held[p]["radius"] for p in self.cells])
        self.owner = np.concatenate([np.full(len(self.held[p]["nearest"]), j) for j, p in enumerate(self.cells)] or [np.empty(0, int)]).astype(int)
        self.close = np.concatenate([self.held[p]["nearest"] for p in self.cells] or [np.empty(0)])

    def slack(self, length: np.ndarray) -> np.ndarray:
        return 1e-9 * (1 + length[:, None] * (self.radius + self.size)[None, :]) + 1e-6

    def reached(self, middle: np.ndarray, off: np.ndarray, length: np.ndarray) -> np.ndarray:
        """A score that k vectors other than itself reach with each query; -inf if there may be fewer.
        middle: inner products with the centres, off: how far these may be from the query's, length: its greatest."""
        if len(self.close) <= self.k:
            return np.full(len(middle), -np.inf)
        sure = middle[:, self.owner] - off[:, self.owner] - length[:, None] * self.close[None, :]
        at = sure.shape[1] - self.k - 1  # the query itself may be one of k + 1
        return np.partition(sure, at, axis=1)[:, at]

    def needed(self) -> dict[int, list[int]]:
        """Cells of vectors that each cell of queries needs."""
        everything, out = [*self.cells, *([WIDE_CELL] if WIDE_CELL in self.held else [])], {}
        for p, r in self.asked.items():
            if p == WIDE_CELL or not self.cells:
                out[p] = everything
                continue
            middle, off, length = (self.pivots[p] @ self.centres.T)[None, :], r["radius"] * self.size[None, :], np.array([r["length"]])
            best = middle + off + length[:, None] * self.radius[None, :]
            slack = self.slack(length)
            keep = np.flatnonzero((best + slack >= self.reached(middle, off, length)[:, None] - slack)[0])
            out[p] = [self.cells[j] for j in keep] + everything[len(self.cells) :]
        return out

    def may_reach(self, queries: np.ndarray, cell: int) -> np.ndarray:
        """Which queries may have one of their best in a cell, by their own bounds."""
        length = np.sqrt((queries * queries).sum(axis=1))
        if cell == WIDE_CELL:
            return np.ones(len(queries), bool)
        middle, j = queries @ self.centres.T, self.cells.index(cell)
        slack = self.slack(length)
        far = (np.abs(queries) >= WIDE).any(axis=1)
        return far | (middle[:, j] + length * self.radius[j] + slack[:, j] >= self.reached(middle, np.zeros_like(middle), length) - slack.max(axis=1))

    def groups(self, bundle: int) -> dict[int, tuple[int, int]]:
        """(group, bundles of the group) of each cell of queries. Cells of few queries share a group with near ones."""
        plain = [p for p in sorted(self.asked) if p != WIDE_CELL]
        total = sum(self.asked[p]["n"] for p in plain)
        middles = choose_pivots(self.pivots[plain], min(len(plain), -(-total // bundle))) if plain else np.empty((0, 0))
        group = {p: int(g) for p, g in zip(plain, distances(self.pivots[plain], middles).argmin(axis=1) if plain else [], strict=True)}
        group |= {WIDE_CELL: len(middles)} if WIDE_CELL in self.asked else {}
        n: dict[int, int] = {}
        for p, g in group.items():
            n[g] = n.get(g, 0) + self.asked[p]["n"]
        return {p: (g, -(-n[g] // bundle)) for p, g in group.items()}


def dealt(rows: DataFrame, pivots: np.ndarray, width: int) -> DataFrame:
    """`rows` with the nearest pivot, the distance from it, and the vector's length, after scaling."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = scaled(matrix(batch.column("vector"), width))
            wide = (np.abs(s) >= WIDE).any(axis=1)
            s[wide] = 0
            d = distances(s, pivots) if len(pivots) else np.zeros((len(s), 1))
            near = d.argmin(axis=1)
            far, length = np.where(wide, 0.0, d[np.arange(len(d)), near]), np.sqrt((s * s).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vector"), pa.array(np.where(wide, WIDE_CELL, near).astype(np.int32)), pa.array(far), pa.array(length)], names=["vec_id", "vector", "pivot", "distance", "length"])

    return rows.mapInArrow(run, "vec_id long, vector array<double>, pivot int, distance double, length double")


def summed_up(held: DataFrame, is_query: str, pivots: np.ndarray, k: int) -> Summary:
    """The summary of a written dealt() table."""
    next_to = Window.partitionBy("pivot").orderBy("distance")
    nearest = held.select("pivot", "distance").withColumn("n", F.row_number().over(next_to)).where(F.col("n") <= k + 1)
    nearest = nearest.groupBy("pivot").agg(F.sort_array(F.collect_list("distance")).alias("nearest"))  # k + 1 of a pivot
    of_vectors = held.groupBy("pivot").agg(F.count("*").alias("n"), F.max("distance").alias("radius")).join(nearest, "pivot")
    of_queries = held.where(is_query).groupBy("pivot").agg(F.count("*").alias("n"), F.max("distance").alias("radius"), F.max("length").alias("length"))
    return Summary(pivots, of_vectors.collect(), of_queries.collect(), k)  # a row per pivot


def pivots_of(rows: DataFrame, n: int, width: int) -> np.ndarray:
    """Pivots for n vectors."""
    wanted = min(MOST_PIVOTS, max(LEAST_PIVOTS, isqrt(n) // ROOT_SHARE))
    sample = rows.select("vector", F.xxhash64("vec_id").alias("hash")).orderBy("hash", "vector").limit(SAMPLED * wanted).toArrow()
    s = scaled(matrix(sample.column("vector"), width))
    s = s[(np.abs(s) < WIDE).all(axis=1)]
    return choose_pivots(s, wanted) if len(s) else s


def visits(summary: Summary) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """(cell of vectors, group of queries, bundles of the group) that meet, and (cell of queries, group)."""
    group, needed = summary.groups(BUNDLE), summary.needed()
    pairs = sorted({(cell, *group[p]) for p, cells in needed.items() for cell in cells})
    return pairs, [(p, g) for p, (g, _) in sorted(group.items())]


def top_k(vectors: DataFrame, k: int, is_query: str, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score, score_exact: the k best of all other rows for each row that meets
    `is_query`, an SQL condition on vec_id."""
    spark = vectors.sparkSession
    shared.batched(spark)
    rows = shared.written(taking_part(vectors, id_col, vector_col), "vectors")
    told = rows.agg(F.max(F.size("vector")).alias("width"), F.count("*").alias("n")).first()
    if not told["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long, score_exact string")
    width = told["width"]
    pivots = pivots_of(rows, told["n"], width)
    held = shared.written(dealt(rows, pivots, width), "dealt")
    summary = summed_up(held, is_query, pivots, k)
    pairs, group = visits(summary)
    if not pairs:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long, score_exact string")

    blocks = {p: -(-r["n"] // BLOCK) for p, r in summary.held.items()}
    # both are bounded by the number of pivots: MOST_PIVOTS ** 2 and MOST_PIVOTS rows of a few numbers
    met = [(*x, blocks[x[0]]) for x in pairs]
    grouped = F.broadcast(spark.createDataFrame(group, "pivot int, grp int"))
    of_group = F.broadcast(spark.createDataFrame(met, "cell int, grp int, bundles int, blocks int"))
    of_cell = F.broadcast(spark.createDataFrame(met, "pivot int, grp int, bundles int, blocks int"))
    asked = held.where(is_query).dropDuplicates(["vec_id", "vector"]).join(grouped, "pivot").join(of_group, "grp")
    asked = asked.withColumn("bundle", F.pmod(F.xxhash64("vec_id"), F.col("bundles")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asked = asked.select(*(F.col(c).alias(f"q_{c}") for c in ("grp", "bundle", "cell", "block", "vec_id", "vector")))
    # repeated rows are dealt to blocks by where they stand, not by what they hold
    own = held.withColumn("at", F.monotonically_increasing_id()).join(of_cell, "pivot")
    own = own.withColumn("block", F.pmod(F.xxhash64("at"), F.col("blocks")).cast("int")).withColumn("bundle", F.explode(F.sequence(F.lit(0), F.col("bundles") - 1)))
    own = own.select("grp", "bundle", "pivot", "block", "vec_id", "vector")

    out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("big", pa.int32()), ("score", pa.int64()), ("digits", pa.string())])

    def meet(queries: pa.Table, block: pa.Table) -> pa.Table:
        if not queries.num_rows or not block.num_rows:
            return out.empty_table()
        q_id, q = queries.column("q_vec_id").to_numpy(), matrix(queries.column("q_vector"), width)
        v_id, v = block.column("vec_id").to_numpy(), matrix(block.column("vector"), width)
        mine = np.flatnonzero(summary.may_reach(scaled(q), queries.column("q_cell")[0].as_py()))
        found: list[tuple] = []
        for some in _apart(q, mine):
            for part in _apart(v, np.argsort(v_id, kind="stable")):
                for at in range(0, len(some), 256):
                    few = some[at : at + 256]
                    for i, line in zip(few, scores(q[few], v[part]), strict=True):
                        found += _best(q_id[i], v_id[part], line, k)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else [[]] * 5, out.types, strict=True)], schema=out)

    best = asked.groupBy("q_grp", "q_bundle", "q_cell", "q_block").cogroup(own.groupBy("grp", "bundle", "pivot", "block")).applyInArrow(meet, "query_id long, vec_id long, big int, score long, digits string")
    order = Window.partitionBy("query_id").orderBy(F.desc("big"), F.desc("score"), F.desc("digits"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    minus = F.concat(F.lit("-"), F.translate("digits", "0123456789", "9876543210"))
    exact = F.when(F.col("big") == 0, F.col("score").cast("string")).when(F.col("big") > 0, F.col("digits")).otherwise(minus)
    return ranked.select("query_id", "rank", "vec_id", "score", exact.alias("score_exact"))


def _apart(rows: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Places of narrow vectors and of the others, as far as there are any."""
    narrow = (np.abs(scaled(rows[at])) <= NARROW).all(axis=1)
    return [x for x in (at[narrow], at[~narrow]) if len(x)]


def _best(query: int, ids: np.ndarray, line: np.ndarray, k: int) -> list[tuple]:
    """The k best of a query's scores with vectors in order of their ids: query, id, and the score in three
    columns that sort as it does: big (0, or the signed number of digits beyond 64 bits), score, digits."""
    other = np.flatnonzero(ids != query)
    line = line[other]
    if line.dtype == object:
        order = sorted(range(len(line)), key=lambda i: (-line[i], ids[other[i]]))[:k]
    else:
        if len(line) > k:  # all that reach the k-th best, then ties by id
            reach = np.flatnonzero(line >= np.partition(line, len(line) - k)[len(line) - k])
            other, line = other[reach], line[reach]
        order = np.lexsort((ids[other], -line))[:k]
    return [(int(query), int(ids[other[i]]), *_columns(int(line[i]))) for i in order]


def _columns(score: int) -> tuple[int, int | None, str]:
    if -(2**63) <= score < 2**63:
        return 0, score, ""
    digits = str(abs(score))
    return (len(digits), None, digits) if score > 0 else (-len(digits), None, digits.translate(str.maketrans("0123456789", "9876543210")))


#: The same by DuckDB, over the table embeddings, for scores of up to 38 digits.
SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::HUGEINT) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x, true), lambda p: p[1] * p[2])) AS score
  FROM (SELECT DISTINCT vec_id, x FROM v WHERE vec_id % 50 = 0) q JOIN v c ON q.vec_id <> c.vec_id
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, TRY_CAST(score AS BIGINT) AS score, score::VARCHAR AS score_exact FROM ranked WHERE rank <= 5
"""
