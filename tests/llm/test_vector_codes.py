import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import queries
from millrace.llm import vector_codes as op

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain_nearest(x, entries):
    """By all distances, in whole numbers without bounds."""
    far = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, e)) for e in entries] for v in x]
    return [min(range(len(f)), key=lambda i: (f[i], i)) for f in far], [min(f) for f in far]


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 40), st.integers(1, 9), st.sampled_from([1, 3, 1000, op.MOST]), st.integers(1, 5))
def test_nearest_is_exact(seed, k, d, reach, bits):
    rng = np.random.default_rng(seed)
    entries, x = rng.integers(-reach, reach + 1, (k, d)), rng.integers(-reach, reach + 1, (30, d))
    x[:5] = entries[rng.integers(0, k, 5)]
    index, error = op.Cells(entries, bits).nearest(x)
    assert (index.tolist(), error.tolist()) == plain_nearest(x, entries)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.sampled_from([5, 1000, op.MOST]))
def test_bounds_hold(seed, reach):
    rng = np.random.default_rng(seed)
    entries, x = rng.integers(-reach, reach + 1, (64, 16)), rng.integers(-reach, reach + 1, (50, 16))
    lower, upper = op.Cells(entries).bounds(x.astype(np.float32))
    exact = ((x[:, None, :] - entries[None]) ** 2).sum(2)
    assert (lower <= exact).all() and (exact <= upper).all()


def plain_codes(rows, parts=4, entries=256, rounds=4):
    """The contract, row by row, with Python's whole numbers."""
    fit = [(i, [int(np.floor(1024 * np.float64(np.float32(c)))) for c in v], label) for i, v, label in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit.sort(key=lambda r: (r[0] is None, r[0]))
    if not fit:
        return {}, ""
    d = len(fit[0][1]) // parts
    cut = [[v[p * d : (p + 1) * d] for p in range(parts)] for _, v, _ in fit]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            index, _ = plain_nearest([c[p] for c in cut], books[p])
            for e in set(index):
                got = [c[p] for c, i in zip(cut, index) if i == e]
                books[p][e] = [sum(x) // len(got) for x in zip(*got)]
    found = [plain_nearest([c[p] for c in cut], books[p]) for p in range(parts)]
    out = {}
    for k, (i, _, label) in enumerate(fit):
        out[i] = ("".join(f"{found[p][0][k]:02x}" for p in range(parts)), sum(found[p][1][k] for p in range(parts)), label)
    totals = {}
    for _, error, label in out.values():
        totals[label] = totals.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return {i: (code, error, totals[label]) for i, (code, error, label) in out.items()}, digest


def test_query_against_plain_rounds(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.normal(size=8)], int(rng.integers(0, 3)) if i % 7 else None) for i in range(600)]
    rows[5] = (5, None, 1)
    rows[6] = (6, [*rows[6][1][:-1], None], 1)
    rows[7] = (7, [*rows[7][1][:-1], float("nan")], 1)
    rows[8] = (8, [float("inf"), *rows[8][1][1:]], 1)
    rows[9] = (9, [0.0] * 8, None)
    rows[10] = (None, rows[10][1], 2)
    rows[20] = (20, rows[21][1], 2)
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    expected, digest = plain_codes(rows)
    got = queries.op12_vector_codes(spark, str(tmp_path)).collect()
    assert {r["vec_id"]: (r["code"], r["error"], r["label_error"]) for r in got} == expected
    assert len(got) == len(expected) == 596
    assert {r["codebooks_sha256"] for r in got} == {digest}


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(1, [], 1)], [(1, [1.0, 2.0, 3.0], 1)]])
def test_nothing_to_encode(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert queries.op12_vector_codes(spark, str(tmp_path)).collect() == []


def test_edges(spark):
    one = [0.5, -0.5, 1e30, -1e30]
    rows = [(3, one, 1), (3, one, 1), (4, one + one, 1), (2, [0.1, 0.2, 0.3], 2), (9, [0.5, -0.5, 0.0, -0.0], 2)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS codes_", "1 AS part", "2 AS entry", "3 AS n", "4 AS vector", "5 AS id")
    books = op.train(df, rounds=0)
    assert books.entries[:, 0, 0].tolist() == [512, -512, op.MOST, -op.MOST]
    got = op.encode(df, op.train(df), keep=("label", "part")).collect()
    assert [(r["vec_id"], r["codes"], r["error"], r["part"]) for r in sorted(got)] == [(3, [0, 0, 0, 0], 0, 1), (3, [0, 0, 0, 0], 0, 1), (9, [0, 0, 2, 2], 0, 1)]


def test_codes_decode_near_the_vectors(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 16))
    x = centres[rng.integers(0, 20, 500)] + 0.01 * rng.normal(size=(500, 16))
    df = spark.createDataFrame([(i, [float(c) for c in v], 0) for i, v in enumerate(x)], SCHEMA)
    books = op.train(df)
    rows = sorted(op.encode(df, books).collect())
    back = op.decode(np.array([r["codes"] for r in rows]), books)
    assert np.abs(back - x).mean() < 0.02
