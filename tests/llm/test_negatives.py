import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pavilion.llm import negatives, queries


def brute(rows, anchor, positives=5, negatives=10, low=30, high=90, scale=256):
    """Python whole numbers, one pair after the other."""
    best = {}
    for i, label, v in sorted((r for r in rows if None not in r and all(x is not None and math.isfinite(x) for x in r[2])), key=lambda r: (r[0], r[1], r[2])):
        best.setdefault(i, (label, [math.floor(scale * x) for x in v]))
    out = []
    for a, (label, v) in best.items():
        if not anchor(a):
            continue
        ranked = sorted((-sum(p * q for p, q in zip(v, w, strict=True)), i, own) for i, (own, w) in best.items() if i != a)
        for ps, p, _ in [r for r in ranked if r[2] == label][:positives]:
            fit = [(s, n) for s, n, own in ranked if own != label and low * -ps <= 100 * -s <= high * -ps][:negatives]
            out += [(a, p, k, n, -ps, -s) for k, (s, n) in enumerate(fit, 1)]
    return sorted(out)


def mined(df, **how):
    return sorted(map(tuple, negatives.mine(df, F.col("vec_id") % 3 == 0, **how).collect()))


@pytest.mark.parametrize("spread", [1.0, 300.0, 40_000.0])
def test_against_whole_numbers(spark, monkeypatch, spread):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 40)
    monkeypatch.setattr(negatives, "BLOCK_ANCHORS", 16)
    monkeypatch.setattr(negatives, "AT_ONCE", 5)
    rng = np.random.default_rng(int(spread))
    v = rng.normal(size=(150, 70)) * spread + spread / 2
    v[20:60] = v[5]  # copies: ties to the smaller id
    v[60] = 0
    rows = [(k, int(rng.integers(0, 3)), list(map(float, x))) for k, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    want = brute(rows, lambda a: a % 3 == 0)
    assert want and mined(df) == want
    assert mined(df, positives=2, negatives=3, low=-50, high=100, scale=16) == brute(rows, lambda a: a % 3 == 0, 2, 3, -50, 100, 16)


def test_residues_give_exact_products():
    rng = np.random.default_rng(3)
    for most in (3, 70_000, 2 ** 25):
        q, x = (rng.integers(-most, most + 1, (9, 130)) for _ in range(2))
        q[0], x[0] = most, -most
        want = np.array([[sum(int(a) * int(b) for a, b in zip(r, s, strict=True)) for s in x] for r in q])
        primes = negatives.primes_for(130 * most * most)
        assert math.prod(primes) > 2 * 130 * most * most
        held = [negatives.residues(x.astype(float), p) for p in primes]
        assert (negatives.scores(q.astype(float), held, primes) == want).all()
    assert all(negatives.COLUMNS * (p // 2) ** 2 < 2 ** 24 for p in negatives.primes_for(2 ** 60))
    with pytest.raises(ArithmeticError):
        negatives.primes_for(2 ** 62)


def test_odd_rows(spark):
    rows = [(0, 1, [1.0, 2.0]), (0, 0, [9.0, 9.0]), (0, 1, [1.0, 2.0]), (1, 0, [1.0, 1.5]), (2, 1, [1.0, 0.5]), (3, None, [1.0, 1.0]), (None, 0, [1.0, 1.0]), (4, 1, None),
            (5, 1, [1.0, None]), (6, 0, [float("nan"), 1.0]), (7, 0, [float("inf"), 1.0]), (8, 0, [1.0, 1.0, 1.0]), (9, 0, [0.0, 0.0]), (10, 1, []), (12, 0, [0.9, 1.2])]
    df = spark.createDataFrame([(*r, "x", 5, 0.5) for r in rows], "vec_id long, label int, embedding array<double>, s string, n int, norm double")
    assert mined(df) == brute([r for r in rows if r[2] and len(r[2]) == 2], lambda a: a % 3 == 0)
    assert mined(df.where("vec_id = -1")) == [] and mined(df.where("label is null")) == []
    assert negatives.mine(df, F.lit(False)).count() == 0
    assert mined(df.where("vec_id in (1, 12)")) == []  # no other label


def test_query_agrees_with_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{small}/embeddings.parquet'")
    want = con.execute(queries.ORACLES["op13_negatives"]).fetchall()
    assert sorted(map(tuple, queries.op13_negatives(spark, small).collect())) == sorted(want) and want
