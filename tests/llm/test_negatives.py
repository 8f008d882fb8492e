"""Hard negatives against plain products."""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm import negatives

ROWS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                     T.StructField("label", T.IntegerType())])


def plain(rows, is_anchor):
    """By sorting all rows for each anchor."""
    sound = [(k, [math.floor(256 * float(np.float32(x))) for x in v], y) for k, v, y in rows
             if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, (k, v, y) in enumerate(sound):
        if k is None or not is_anchor(k):
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), math.inf if m is None else m, m, z)
                         for j, (m, w, z) in enumerate(sound) if j != i), key=lambda r: r[:2])
        for p, _, positive, z in [r for r in scored if r[3] == y][:5]:
            found = [r for r in scored if r[3] != y and 80 * -p <= 100 * -r[0] <= 100 * -p][:5]
            out += [(k, positive, rank + 1, m, -p, -s) for rank, (s, _, m, _) in enumerate(found)]
    return sorted(out, key=repr)


def answer(found):
    return sorted((tuple(r) for r in found.collect()), key=repr)


def vectors(seed, count, width, scale=1.0):
    draw = random.Random(seed)
    centre = [[draw.gauss(0, 1) for _ in range(width)] for _ in range(4)]
    rows = []
    for i in range(count):
        v = [c + draw.gauss(0, 0.7) for c in centre[draw.randrange(4)]]
        norm = math.sqrt(sum(x * x for x in v))
        rows.append((i, [float(np.float32(scale * x / norm)) for x in v], draw.randrange(3)))
    draw.shuffle(rows)
    return rows


def mined(spark, rows, every=10, **options):
    return negatives.hard_negatives(spark.createDataFrame(rows, ROWS), F.col("id") % every == 0, **options)


def test_against_plain_products(spark):
    rows = vectors(1, 400, 20)
    assert answer(mined(spark, rows)) == plain(rows, lambda k: k % 10 == 0)


def test_large_components_take_more_planes(spark):
    rows = vectors(2, 200, 9, scale=30_000.0)
    assert answer(mined(spark, rows)) == plain(rows, lambda k: k % 10 == 0)


def test_anchors_in_many_passes(spark):
    rows = vectors(3, 300, 16)
    assert answer(mined(spark, rows, pass_bytes=16 * 8 * 7)) == plain(rows, lambda k: k % 10 == 0)


def test_odd_rows(spark):
    rows = vectors(4, 60, 8)
    rows += [(100, None, 1), (110, [1.0, None], 1), (120, [math.nan] * 8, 1), (130, [math.inf] * 8, 1), (140, [0.5] * 8, None),
             (150, [], 1), (160, [0.0] * 8, 2), (170, [0.9] * 3, 0), (180, [0.3] * 11, 1), (None, [0.4] * 8, 1), (None, [0.2] * 8, 2),
             (190, [-0.5] * 8, 7)]
    rows += [(k, [0.25] * 8, k % 2) for k in range(200, 230)]  # equal scores
    rows += [(205, [0.25] * 8, 1)]
    frame = spark.createDataFrame(rows, ROWS).selectExpr("*", "1 as id", "'v' as vector", "9 as score", "8 as row", "7 as list")
    found = negatives.hard_negatives(frame, F.col("id") % 10 == 0)
    assert answer(found) == plain([(k, v and [x for x in v], y) for k, v, y in rows], lambda k: k % 10 == 0)


def test_repeated_anchor(spark):
    rows = vectors(5, 40, 8) + [(10, [0.5] * 8, 1), (10, [0.5] * 8, 1)]
    assert answer(mined(spark, rows)) == plain(rows, lambda k: k % 10 == 0)


def test_empty_table_and_no_anchor(spark):
    for rows in ([], [(1, [0.5], 1), (2, [0.5], 2)]):
        found = mined(spark, rows)
        assert found.collect() == [] and found.columns[:3] == ["anchor_id", "positive_id", "rank"]


def test_scores_are_products_and_best_rows_are_the_first():
    draw = np.random.default_rng(1)
    for span in (1, 130, 1 << 20):
        a, c = draw.integers(-span, span + 1, (9, 24)), draw.integers(-span, span + 1, (70, 24))
        assert (negatives.scores(negatives.subset_tables(a), negatives.bit_planes(c)) == c @ a.T).all()
    score, ids = draw.integers(0, 6, (5, 200)), np.arange(200)
    best = negatives.Best(5, 4)
    for i in range(0, 200, 30):
        best.add(slice(0, 5), score[:, i:i + 30], ids[i:i + 30], ids[i:i + 30])
    for i in range(5):
        assert best.id[i].tolist() == sorted(range(200), key=lambda j: (-score[i, j], j))[:4]
