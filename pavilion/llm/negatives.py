"""Hard negatives by exact integer scores, which float32 products of residues give."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pavilion.session import written

from .ann import matrix

#: Columns that one float32 product sums over: COLUMNS * ((p - 1) / 2) ** 2 stays below 2 ** 24 for every prime below 1024.
COLUMNS, BELOW = 64, 1024
#: Rows and anchors of a task, and the anchors it scores at once.
BLOCK_ROWS, BLOCK_ANCHORS, AT_ONCE = 8192, 2048, 256


def primes_for(bound: int) -> list[int]:
    """The largest primes below ``BELOW`` whose product tells all whole numbers from -bound to bound apart."""
    if bound >= 1 << 61:
        raise ArithmeticError("scores of these vectors may not fit into a long")
    chosen, product = [], 1
    for p in range(BELOW - 1, 1, -1):
        if product > 2 * bound:
            break
        if all(p % d for d in range(2, int(p ** 0.5) + 1)):
            chosen.append(p)
            product *= p
    return chosen


def residues(x: np.ndarray, p: int) -> np.ndarray:
    """Whole numbers held as doubles, modulo ``p``, as the float32 nearest to 0; exact, since fmod is."""
    r = np.mod(x, p)
    return np.where(r > p // 2, r - p, r).astype(np.float32)


def product(q: np.ndarray, x: np.ndarray, p: int) -> np.ndarray:
    """q @ x.T modulo ``p`` from residue matrices; every partial sum is a whole number that float32 holds."""
    total = np.zeros((len(q), len(x)), np.float32)
    for at in range(0, q.shape[1], COLUMNS):
        total = np.mod(total + np.mod(q[:, at:at + COLUMNS] @ x[:, at:at + COLUMNS].T, np.float32(p)), np.float32(p))
    return total.astype(np.int64)


def reconstruct(parts: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """The signed numbers whose residues are ``parts``: Chinese remaindering, one mixed-radix digit after the other."""
    value, weight = parts[0].copy(), primes[0]
    for part, p in zip(parts[1:], primes[1:], strict=True):
        digit = (part - value) % p * pow(weight, -1, p) % p
        if weight * p < 1 << 62:
            value += digit * weight
        else:  # the last digit may reach past a long: the upper half stands for negative numbers
            value += np.where(digit > p // 2, digit - p, digit) * weight
            return value
        weight *= p
    return np.where(value > weight // 2, value - weight, value)


def scores(q: np.ndarray, x: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Exact inner products of whole-number rows ``q`` with rows whose residue matrices are ``x``."""
    return reconstruct([product(residues(q, p), r, p) for p, r in zip(primes, x, strict=True)], primes)


def first_below(score: np.ndarray, ids: np.ndarray, high: np.ndarray, low: np.ndarray, k: int):
    """(row, id, score) of the first ``k`` of each row with low <= score <= high; columns come in order of ids."""
    inside = (score <= high[:, None]) & (score >= low[:, None])
    if score.shape[1] > k:  # a full sort only of what reaches the k-th place
        floor = np.iinfo(np.int64).min
        kept = np.where(inside, score, floor)
        least = np.partition(kept, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
        inside &= score >= least[:, None]
    row, col = np.nonzero(inside)
    value = score[row, col]
    order = np.lexsort((ids[col], -value, row))
    row, col, value = row[order], col[order], value[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    stay = place < k
    return row[stay], ids[col[stay]], value[stay]


def usable(vectors: DataFrame, vec: str, scale: int) -> DataFrame:
    """vec_id, label, v (whole numbers as doubles), norm of the rows that take part, one per vec_id."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col(vec).cast("array<double>").alias("raw"))
    rows = rows.where("vec_id is not null and label is not null and raw is not null")
    rows = rows.where(F.forall("raw", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "raw")).alias("s")).select("vec_id", "s.label", "s.raw")
    whole = rows.select("vec_id", "label", F.transform("raw", lambda x: x * scale).alias("v"))
    down = F.transform("v", lambda x: F.when(F.abs(x) < 2.0 ** 53, F.floor(F.when(F.abs(x) < 2.0 ** 53, x))).otherwise(x))  # beyond, doubles are whole
    whole = whole.select("vec_id", "label", down.cast("array<double>").alias("v"))
    return whole.withColumn("norm", F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256,
         vec: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(scale * x); a score is the whole-number inner product with the anchor, exact.  An anchor's
    positives are its ``positives`` best other rows of its label; a positive's negatives are the ``negatives`` best rows of other
    labels with low % to high % of its score.  Ties go to the smaller vec_id.  Anchors are compared with all rows, in
    blocks of both, and only the best of a block leave it.

    No part take rows with a NULL vec_id, label or vector, with a NULL or non-finite component, or whose vector has not the
    most frequent length (of equally frequent ones the smallest); of rows that repeat a vec_id the one with the smallest
    (label, vector) stands.  Zero vectors score 0.  Other columns are ignored; an empty table gives no rows.  Vectors whose
    scores may pass a long (2 ** 61) raise ArithmeticError.
    """
    spark = vectors.sparkSession
    rows = written(usable(vectors, vec, scale), "negatives-rows")
    size = rows.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n"), F.max("norm").alias("norm")).orderBy(F.desc("n"), "width").first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if size is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("v") == size.width).drop("norm")
    primes = primes_for(int(size.norm * (1 + 1e-9)) + 1 if size.norm < 1e30 else 1 << 62)
    anchors = rows.where(is_anchor)
    x_blocks, a_blocks = -(-size.n // BLOCK_ROWS), -(-max(1, anchors.count()) // BLOCK_ANCHORS)
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    x = rows.withColumn("xb", block(x_blocks)).withColumn("ab", every(a_blocks))

    def against(asked: DataFrame, fn, schema: str) -> DataFrame:
        """``fn(rows, their residues, anchors)`` for every block of rows and of anchors."""
        def run(left, right):
            if not left.num_rows or not right.num_rows:
                return pa.table([pa.array([], f.type) for f in target], target)
            left = left.sort_by("vec_id")
            v = matrix(left.column("v"))
            held = [residues(v, p) for p in primes]
            got = [fn(left, held, right.slice(at, AT_ONCE)) for at in range(0, right.num_rows, AT_ONCE)]
            return pa.table([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*got, strict=True), target, strict=True)], target)

        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import _parse_datatype_string

        target = to_arrow_schema(_parse_datatype_string(schema))
        asked = asked.withColumn("ab", block(a_blocks)).withColumn("xb", every(x_blocks))
        return x.groupBy("xb", "ab").cogroup(asked.groupBy("xb", "ab")).applyInArrow(run, schema)

    def friends(left, held, part):
        ids, own = left.column("vec_id").to_numpy(), part.column("vec_id").to_numpy()
        score = scores(matrix(part.column("v")), held, primes)
        least = np.iinfo(np.int64).min
        other = (left.column("label").to_numpy()[None, :] != part.column("label").to_numpy()[:, None]) | (ids[None, :] == own[:, None])
        row, found, value = first_below(np.where(other, least, score), ids, np.full(len(own), -least - 1), np.full(len(own), least + 1), positives)
        return own[row], found, value

    def foes(left, held, part):
        ids, own = left.column("vec_id").to_numpy(), part.column("vec_id").to_numpy()
        score = scores(matrix(part.column("v")), held, primes)
        least = np.iinfo(np.int64).min
        score = np.where(left.column("label").to_numpy()[None, :] == part.column("label").to_numpy()[:, None], least, score)
        lists = part.column("windows").to_pylist()
        out = []
        for k in range(positives):  # the k-th windows of all anchors together
            have = np.array([a for a, w in enumerate(lists) if len(w) > k], np.int64)
            if not len(have):
                break
            to = np.array([lists[a][k]["s"] * high // 100 for a in have.tolist()])
            since = np.array([-(-lists[a][k]["s"] * low // 100) for a in have.tolist()])
            pick = np.array([lists[a][k]["positive_id"] for a in have.tolist()])
            value = np.array([lists[a][k]["s"] for a in have.tolist()])
            row, found, got = first_below(score[have], ids, to, np.maximum(since, least + 1), negatives)
            out.append((own[have[row]], pick[row], value[row], found, got))
        return tuple(map(np.concatenate, zip(*out, strict=True))) if out else tuple(np.zeros(0, np.int64) for _ in range(5))

    near = against(anchors, friends, "anchor_id long, positive_id long, s long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("s"), "positive_id")
    near = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= positives)
    near = near.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("n", "positive_id", "s"))).alias("windows"))  # a few per anchor
    asked = written(anchors.join(near, F.col("vec_id") == F.col("anchor_id")).select("vec_id", "label", "v", "windows"), "negatives-anchors")
    far = against(asked, foes, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    far = far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return far.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


#: The same by plain SQL; sums of whole numbers below 2 ** 53 are exact in doubles.
ORACLE = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding])
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), n AS (
  SELECT p.anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
  WHERE 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
