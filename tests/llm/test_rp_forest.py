from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from labreports.llm import rp_forest
from labreports.llm.queries import QUERIES
from labreports.llm.rp_forest import nearest


def tenth():
    return F.col("vec_id") % 10 == 0


def brute(rows, queries, count=5):
    out = {}
    for query, x in queries:
        scored = [(-float(np.dot(x, y) / np.sqrt(np.dot(x, x) * np.dot(y, y))), i) for i, y in rows if i != query]
        out[query] = [i for _, i in sorted((round(s, 12), i) for s, i in scored)[:count]]
    return out


def check(spark, data, least, **fit):
    frame = spark.createDataFrame(data, "vec_id bigint, embedding array<float>")
    rows = [(i, np.asarray(v, float)) for i, v in dict(data).items()]
    expected = brute(rows, [(i, v) for i, v in rows if i % 10 == 0])
    got = {}
    for row in nearest(frame, tenth(), **fit).orderBy("query_id", "rank").collect():
        got.setdefault(row.query_id, []).append(row.vec_id)
    hits = [len(set(got[q]) & set(found)) / len(found) for q, found in expected.items()]
    assert set(got) == set(expected) and np.mean(hits) >= least
    return got, expected


@pytest.mark.parametrize("kind", ["spread", "clusters"])
def test_recall_against_brute_force(spark, kind):
    random = np.random.default_rng(2)
    x = random.normal(size=(1500, 16))
    if kind == "clusters":
        x = x * 0.2 + random.normal(size=(30, 16))[random.integers(0, 30, 1500)]
    check(spark, [(k, v.tolist()) for k, v in enumerate(x.astype(np.float32))], 0.9, sample=600)


def test_copies_and_ties_go_to_the_smaller_id(spark):
    data = [(k, [1.0, 2.0, 3.0]) for k in range(400)] + [(400 + k, [float(k), 1.0, 0.0]) for k in range(20)]
    got, expected = check(spark, data, 1.0)
    assert got == expected and got[0] == [1, 2, 3, 4, 5] and got[390] == [0, 1, 2, 3, 4]


def test_ties_of_different_vectors_go_to_the_smaller_id(spark):
    """59 vectors at a right angle to the query, then lengths of one direction, then one-hot vectors."""
    data = [(0, [1.0, 0.0, 0.0])] + [(40 + k, [0.0, float(k), 0.0]) for k in range(1, 60)]
    got, expected = check(spark, data, 1.0)
    assert got == expected and got[0] == [41, 42, 43, 44, 45]
    data = [(0, [1.0, 1.0])] + [(90 - k, [float(2**k), float(2**k)]) for k in range(30)]
    got, expected = check(spark, data, 1.0)
    assert got == expected and got[0] == [61, 62, 63, 64, 65]
    data = [(k, [float(k % 40 == j) for j in range(40)]) for k in range(200)]
    got, expected = check(spark, data, 1.0)
    assert got == expected


def test_a_vector_that_many_rows_share_is_sampled_once(spark):
    frame = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(500)] + [(500, [2.0, 1.0])], "vec_id long, embedding array<float>")
    rows = nearest(frame, F.col("vec_id") == 500, sample=100).orderBy("rank").collect()
    assert [r.vec_id for r in rows] == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("slice_rows, query_rows, at_once", [(50, 7, 3), (4096, 8192, 256)])
def test_slices_and_blocks_change_nothing(spark, monkeypatch, slice_rows, query_rows, at_once):
    monkeypatch.setattr(rp_forest, "_SLICE_ROWS", slice_rows)
    monkeypatch.setattr(rp_forest, "_QUERY_ROWS", query_rows)
    monkeypatch.setattr(rp_forest, "_ASKED_AT_ONCE", at_once)
    x = np.random.default_rng(4).integers(-3, 4, size=(400, 4)).astype(float) + [0.5, 0, 0, 0]
    got, expected = check(spark, [(k, v.tolist()) for k, v in enumerate(x)], 0.99, recall=1.0)
    assert got == expected


def test_recall_of_the_registered_query(spark):
    path = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id", "embedding").collect()
    plain = [(r.vec_id, np.asarray(r.embedding, float)) for r in rows if r.embedding]
    expected = brute(plain, [(i, v) for i, v in plain if i % 50 == 0])
    got = {}
    for row in QUERIES["op4_neighbours"](spark, path).orderBy("query_id", "rank").collect():
        got.setdefault(row.query_id, []).append(row.vec_id)
    hits = [len(set(got[q]) & set(found)) / len(found) for q, found in expected.items()]
    assert set(got) == set(expected) and np.mean(hits) >= 0.9


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    data = [
        (0, [1.0, 0.0], "x"), (10, [0.0, 0.0], "x"), (20, None, "x"), (30, [nan, 1.0], "x"), (40, [inf, 1.0], "x"),
        (50, [None, 1.0], "x"), (None, [1.0, 1.0], "x"), (60, [1.0], "x"), (1, [1.0, 1.0], "x"), (1, [1.0, 1.0], "x"),
        (2, [0.0, -1.0], "x"), (70, [], "x"),
    ]
    frame = spark.createDataFrame(data, "vec_id bigint, embedding array<float>, leaf string")
    rows = nearest(frame, tenth()).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in rows] == [(0, 1, 1), (0, 2, 2)]
    assert rows[0].score == pytest.approx(2**-0.5) and rows[1].score == 0
    assert nearest(frame.limit(0), tenth()).count() == 0
