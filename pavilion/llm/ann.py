"""Nearest neighbours by inner product: inverted lists with an adaptive dimension scan."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept

#: Vectors on which lists and probes are fitted at most, chosen by a hash of the id, and queries for choosing the probes.
MAX_SAMPLE, TUNE_QUERIES = 20_000, 200
#: Rows that a task takes, queries that it takes, and rows that are compared at once.
TASK_ROWS, TASK_QUERIES, PIECE_ROWS = 4096, 2048, 1024
#: Recall that the number of probed lists reaches on the sample, and the standard deviations at which the test abandons a candidate.
AIM, EPSILON = 0.97, 2.33
#: Columns of a block of the rotated vectors, and the share of pairs from which a block is taken for all of them by one product.
COLUMNS, MANY = 16, 0.1


@dataclass
class Index:
    """Cells of unit of the space in which the largest inner product is the smallest distance: vectors get one more coordinate
    that brings all to one length."""

    centroids: np.ndarray
    rotation: np.ndarray
    square: float  # the largest squared length
    probes: int


def augmented(x: np.ndarray, square: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(square - (x * x).sum(axis=1), 0))])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T


def fit(sample: np.ndarray, rows: int, square: float, k: int = 20, seed: int = 7) -> Index:
    """k-means cells on the sample, and the fewest probes that find ``AIM`` of the neighbours that queries have in it.

    There are as many cells as the root of the rows, at most one for four vectors of the sample.  The queries take no part in the means
    unless the sample is hardly larger than their number.
    """
    rng = np.random.default_rng(seed)
    x = augmented(sample, square)
    mixed = rng.permutation(len(x))
    ask, means = mixed[:TUNE_QUERIES], x[mixed[TUNE_QUERIES:] if len(x) > 4 * TUNE_QUERIES else mixed]
    lists = int(min(max(1, round(rows ** 0.5)), max(1, len(means) // 4)))
    cells = means[:lists]
    for _ in range(8):
        own = nearest(means, cells)
        sums = np.zeros_like(cells)
        np.add.at(sums, own, means)
        n = np.bincount(own, minlength=lists)
        cells = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], cells)
    own = nearest(x, cells)
    score = sample[ask] @ sample.T
    score[np.arange(len(ask)), ask] = -np.inf
    near = np.argsort(-score, axis=1)[:, :max(1, min(k, len(x) - 1))]
    place = probed(sample[ask], cells).argsort(axis=1).argsort(axis=1)  # when each list is visited
    when = np.take_along_axis(place, own[near], 1)
    share = np.array([(when < p).mean() for p in range(1, lists + 1)])
    probes = int(np.argmax(share >= AIM)) + 1 if (share >= AIM).any() else lists
    rotation = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))[0]
    return Index(cells, rotation, square, probes)


def nearest(x: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """The nearest cell of each row, some rows at a time."""
    return np.concatenate([distances(x[at:at + PIECE_ROWS], cells).argmin(axis=1) for at in range(0, len(x), PIECE_ROWS)] or [np.zeros(0, np.int64)])


def probed(queries: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Distances of queries, whose further coordinate is 0, to the cells."""
    return distances(np.column_stack([queries, np.zeros(len(queries))]), cells)


def tolerance(done: int, width: int) -> float:
    """The part of a squared distance that ``done`` of ``width`` rotated columns hold at most, but for chance.

    After a random rotation the part is a Beta variable of mean done / width; all columns hold the whole.
    """
    return done / width + EPSILON * (2 * done * (width - done) / (width * width * (width + 2))) ** 0.5


def survivors(xr: np.ndarray, qr: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) pairs that no block of columns abandons.

    After each block a pair stays only while its distance so far is not significantly above what a distance of ``bound``
    would show.  While many pairs stay a block is one product for all; from then on it is taken for the remaining pairs alone.
    """
    width = xr.shape[1]
    edges = np.linspace(0, width, max(1, round(width / COLUMNS)) + 1).astype(int).tolist()
    part, a, b = np.zeros((len(qr), len(xr))), None, None
    for start, done in zip(edges[:-1], edges[1:], strict=True):
        most = bound * tolerance(done, width) * (1 + 1e-9) + 1e-9
        if a is None:
            part += distances(qr[:, start:done], xr[:, start:done])
            stay = part <= most[:, None]
            if done == width or np.count_nonzero(stay) <= MANY * stay.size:
                a, b = np.nonzero(stay)
                part = part[a, b]
        else:
            for at in range(0, len(a), 100_000):
                s = slice(at, at + 100_000)
                part[s] += ((qr[a[s], start:done] - xr[b[s], start:done]) ** 2).sum(axis=1)
            stay = part <= most[a]
            a, b, part = a[stay], b[stay], part[stay]
    return a, b


def products(q: np.ndarray, x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of pairs, each the same whatever stands beside it."""
    return np.concatenate([(q[a[at:at + 100_000]] * x[b[at:at + 100_000]]).sum(axis=1) for at in range(0, len(a), 100_000)] or [np.zeros(0)])


def scan(x: np.ndarray, x_id: np.ndarray, x_list: np.ndarray, q: np.ndarray, q_lists: list[np.ndarray], index: Index, k: int,
         floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, exact score) of the ``k`` best rows of each query in its lists, ties to the smaller id, by the adaptive scan.

    ``floor`` is a score that k rows are known to reach, from lists that were visited before; the k-th best found so far raises it
    from one piece of a list to the next.  Fewer than k rows come back where others are known to be better.
    """
    xr = augmented(x, index.square) @ index.rotation
    qr = np.column_stack([q, np.zeros(len(q))]) @ index.rotation
    floor = np.full(len(q), -np.inf) if floor is None else floor.copy()
    norm = (q * q).sum(axis=1) + index.square
    asks = np.repeat(np.arange(len(q)), [len(v) for v in q_lists])
    wanted = np.concatenate(q_lists) if len(q) else np.zeros(0, np.int64)
    held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for each in np.unique(x_list):
        rows, own = np.flatnonzero(x_list == each), asks[wanted == each]
        for at in range(0, len(rows) if len(own) else 0, PIECE_ROWS):
            piece = rows[at:at + PIECE_ROWS]
            a, b = survivors(xr[piece], qr[own], norm[own] - 2 * floor[own])
            if not len(a):
                continue
            a, b = own[a], piece[b]
            a, b, score = (np.concatenate(pair) for pair in zip(held, (a, b, products(q, x, a, b)), strict=True))
            order = np.lexsort((x_id[b], -score, a))
            a, b, score = a[order], b[order], score[order]
            first = np.searchsorted(a, a)
            stay = np.arange(len(a)) - first < k
            held = a, b, score = a[stay], b[stay], score[stay]
            last = np.flatnonzero(np.arange(len(a)) - np.searchsorted(a, a) == k - 1)
            floor[a[last]] = np.maximum(floor[a[last]], score[last])
    return held[0], x_id[held[1]], held[2]


def usable(vectors: DataFrame, vec: str = "embedding") -> DataFrame:
    """vec_id, v (array of double): rows with an id and a finite vector that is not zero, of the most frequent length; repeated rows once."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vec).cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    rows = rows.where(F.size("v") > 0).where(F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))).where(F.exists("v", lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (size.n if size else 0)).withColumn("v", F.transform("v", lambda x: x + 0.0)).dropDuplicates()  # one zero


def matrix(column) -> np.ndarray:
    """A list column as rows of a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def search(vectors: DataFrame, is_query, k: int = 20, vec: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every row that satisfies ``is_query``.

    Equal vectors are searched as one, that of the smallest id, with its k + 1 smallest ids, so copies neither fill a list
    nor repeat work.  A query visits its nearest lists first, and carries the k-th best of them to its other lists as a bound.  Small lists
    share a task, in which a query stands once; rows and queries of large ones are cut into blocks, and a task takes one block of each.
    An id with several vectors asks with each of them, and the best of all answers stand.  Rows that take no part
    (see ``usable``) are neither queries nor candidates; of an empty table nothing is found.
    """
    rows = kept(usable(vectors, vec))
    same = Window.partitionBy("v").orderBy("vec_id")
    first = rows.withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1)
    reps = kept(first.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("first"), "v", "ids", F.xxhash64("v").alias("rep")))
    asked = rows.where(is_query)
    queries = kept(asked.select(F.col("vec_id").alias("query_id"), F.xxhash64("v").alias("rep")).distinct())
    schema = "query_id long, rank int, vec_id long, score double"
    size = reps.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()
    if not size[0]:
        return rows.sparkSession.createDataFrame([], schema)
    sample = matrix(reps.orderBy(F.xxhash64("first"), "rep").limit(MAX_SAMPLE).select("v").toArrow().column("v"))
    index = fit(sample, size[0], size[1], k)
    together = max(1, round(TASK_ROWS * len(index.centroids) / size[0]))  # lists of a task
    early = max(1, round(index.probes ** 0.5))  # lists that are visited first

    def assign(batches):
        for batch in batches:
            own = nearest(augmented(matrix(batch.column("v")), index.square), index.centroids) if batch.num_rows else np.zeros(0, np.int64)
            yield batch.append_column("list", pa.array(own, pa.int32()))

    def probe(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE_ROWS):
                part = batch.slice(at, PIECE_ROWS)
                near = np.argsort(probed(matrix(part.column("v")), index.centroids), axis=1, kind="stable")[:, :index.probes].astype(np.int32)
                yield part.append_column("lists", pa.array(list(near), pa.list_(pa.int32())))

    x = kept(reps.select("rep", "first", "v").mapInArrow(assign, "rep long, first long, v array<double>, list int"))
    x = x.withColumn("task", (F.col("list") / together).cast("int"))
    x_blocks = kept(x.groupBy("task").agg(F.ceil(F.count("*") / TASK_ROWS).cast("long").alias("x_blocks")))
    wanted = reps.select("rep", "v").join(queries.select("rep").distinct(), "rep")
    asks = kept(wanted.mapInArrow(probe, "rep long, v array<double>, lists array<int>"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"rep": pa.array([], pa.int64()), "found": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        own = [np.asarray(v, np.int64) for v in right.column("lists").to_pylist()]
        a, ids, score = scan(matrix(left.column("v")), left.column("first").to_numpy(), left.column("list").to_numpy(),
                             matrix(right.column("v")), own, index, k + 1, right.column("floor").to_numpy())
        return pa.table({"rep": right.column("rep").to_numpy()[a], "found": ids, "score": score})

    def visit(asks: DataFrame) -> DataFrame:
        """rep, found, score of the best rows in the ``lists`` of ``asks`` above their ``floor``."""
        q = asks.withColumn("task", F.explode(F.array_distinct(F.transform("lists", lambda c: (c / together).cast("int")))))
        q = q.withColumn("lists", F.filter("lists", lambda c: (c / together).cast("int") == F.col("task")))
        q_blocks = q.groupBy("task").agg(F.ceil(F.count("*") / TASK_QUERIES).cast("long").alias("q_blocks"))
        sizes = F.broadcast(kept(x_blocks.join(q_blocks, "task")))  # a row per task
        left = x.join(sizes, "task").withColumn("xb", F.pmod("rep", "x_blocks")).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("q_blocks") - 1)))
        right = q.join(sizes, "task").withColumn("qb", F.pmod("rep", "q_blocks")).withColumn("xb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("x_blocks") - 1)))
        cell = ["task", "xb", "qb"]
        found = left.select(*cell, "list", "first", "v").groupBy(*cell).cogroup(right.select(*cell, "rep", "v", "floor", "lists").groupBy(*cell))
        return found.applyInArrow(run, "rep long, found long, score double")

    best = Window.partitionBy("rep").orderBy(F.desc("score"), "found")
    near = visit(asks.withColumn("lists", F.slice("lists", 1, early)).withColumn("floor", F.lit(float("-inf"))))
    near = kept(near.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1))
    floors = near.where(F.col("n") == k + 1).select("rep", F.col("score").alias("floor"))
    rest = asks.withColumn("lists", F.slice("lists", early + 1, index.probes)).where(F.size("lists") > 0)
    rest = kept(rest.join(floors, "rep", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf")))))
    found = near.drop("n").unionByName(visit(rest)).withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    every = found.join(reps.select(F.col("first").alias("found"), "ids"), "found").select("rep", "score", F.explode("ids").alias("vec_id"))
    answers = queries.join(every, "rep").where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    row = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return answers.withColumn("rank", F.row_number().over(row)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
