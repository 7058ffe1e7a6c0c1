"""Operators that keep to bounded memory, against plain ones: frequent values, percentiles, running values, vectors, recursion."""

import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from support import SF

from millrace import registry, storage
from millrace.operators import aggregates, funnels, heavy_hitters, prefix_sums, recursion, selection, vector_index


@pytest.mark.parametrize(("counters", "parts"), [(5, 1), (5, 7), (20, 40), (3, 300)])
def test_merged_summaries_keep_their_bound(spark, counters, parts):
    rng = random.Random(counters)
    values = [min(int(rng.paretovariate(1.1)), 400) for _ in range(3000)] + [None] * 50
    df = spark.createDataFrame([(v,) for v in values], "v long").repartition(parts)
    true = Counter(v for v in values if v is not None)
    rows = heavy_hitters.summary(df, "v", counters).collect()
    error, n = rows[0]["error"], rows[0]["rows"]
    assert n == 3000 and len(rows) <= counters and error <= n / (counters + 1)
    held = {r["value"]: r["low"] for r in rows if r["value"] is not None}
    for v, c in true.items():
        assert c - error <= held.get(v, 0) <= c


def test_summary_of_equally_frequent_values(spark):
    df = spark.range(1000).select((F.col("id") % 500).cast("string").alias("v")).repartition(9)
    rows = heavy_hitters.summary(df, "v", 10).collect()
    assert rows[0]["rows"] == 1000 and rows[0]["error"] <= 1000 / 11


@pytest.mark.parametrize("k", [1, 3, 10, 600])
def test_frequent_is_exact(spark, k, monkeypatch):
    rng = random.Random(k)
    values = [f"w{min(int(rng.paretovariate(0.7)), 500)}" for _ in range(4000)] + [None] * 900
    monkeypatch.setattr(heavy_hitters, "MOST", 200)
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(5)
    got = [(r["value"], r["n"], r["rank"]) for r in heavy_hitters.frequent(df, "v", k, 4).orderBy("rank").collect()]
    expected = sorted(Counter(v for v in values if v).items(), key=lambda x: (-x[1], x[0]))[:k]
    assert got == [(v, n, i + 1) for i, (v, n) in enumerate(expected)]


def test_frequent_of_nothing(spark):
    assert heavy_hitters.frequent(spark.createDataFrame([(None,)], "v long"), "v", 3).count() == 0


@pytest.mark.parametrize("kind", ["many", "ties", "wild"])
def test_percentiles_are_exact(spark, kind):
    rng = np.random.default_rng(1)
    groups = {"a": 3000, "b": 1, "c": 2, None: 700, "d": 0}
    rows = []
    for g, n in groups.items():
        v = {"many": rng.normal(size=n), "ties": rng.choice([1.0, 2.0, 2.0, 2.0, 9.0], n), "wild": rng.choice([-1.0, 1.0], n) * 10.0 ** rng.uniform(-300, 300, n)}[kind]
        rows += [(g, float(x)) for x in v] + [(g, None)] * 3
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    shares = [0.0, 0.25, 0.5, 0.99, 1.0]
    got = {r["g"]: r for r in selection.exact_percentiles(df, ["g"], "v", shares, accuracy=100, last=20).collect()}
    assert set(got) == set(groups)
    for g, n in groups.items():
        v = sorted(x for h, x in rows if h == g and x is not None)
        for i, s in enumerate(shares):
            if not n:
                assert got[g][f"p{i}"] is None and got[g]["n"] == 0
                continue
            at = s * (n - 1)
            lo, rest = int(at), at - int(at)
            want = v[lo] if rest == 0 else (1 - rest) * v[lo] + rest * v[lo + 1]
            assert got[g][f"p{i}"] == pytest.approx(want, rel=1e-12)
            assert got[g][f"d{i}"] == v[max(int(np.ceil(s * n)) - 1, 0)]


def test_percentile_of_one_value_of_all_rows(spark):
    df = spark.range(5000).select(F.lit(7.0).alias("v"))
    r = selection.exact_percentiles(df, [], "v", [0.5], last=10).first()
    assert (r["n"], r["p0"], r["d0"]) == (5000, 7.0, 7.0)


@pytest.mark.parametrize("by", [[], ["k"], ["k", "m"]])
@pytest.mark.parametrize("pieces", [1, 3, 40])
def test_running_values(spark, by, pieces):
    rng = random.Random(pieces)
    rows = [(rng.choice([None, "hot", "hot", "hot", "x"]), rng.randint(0, 1), i, rng.choice([None, *range(-5, 6)])) for i in range(300)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, m long, t long, v long")
    values = {"s": ("sum", "v"), "c": ("count", "v"), "lo": ("min", "v"), "hi": ("max", "v"), "n": ("row_number", "v"), "b": ("lag", "v")}
    got = {r["t"]: tuple(r[c] for c in values) for r in prefix_sums.running(df, ["t"], values, by, pieces).collect()}
    state, expected = {}, {}
    for k, m, t, v in sorted(rows, key=lambda r: r[2]):
        seen = state.setdefault(tuple({"k": k, "m": m}[c] for c in by), [])
        before = seen[-1] if seen else None
        seen.append(v)
        known = [x for x in seen if x is not None]
        expected[t] = (sum(known) if known else None, len(known), min(known, default=None), max(known, default=None), len(seen), before)
    assert got == expected


def test_running_uses_no_single_task(spark):
    plan = prefix_sums.running(spark.range(50).withColumnRenamed("id", "t"), ["t"], {"s": ("sum", "t")}, pieces=4)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


SCHEMA = "vec_id long, embedding array<float>"


def plain_nearest(rows, asked, k):
    out = {}
    for q, v in asked:
        near = sorted(((-float(np.dot(np.float64(np.float32(v)), np.float64(np.float32(w)))), i) for i, w in rows if i != q))[:k]
        out[q] = [(i, -s) for s, i in near]
    return out


@pytest.mark.parametrize("kind", ["clusters", "sphere", "long", "same"])
def test_index_is_exact(spark, kind, monkeypatch):
    monkeypatch.setattr(vector_index, "ROWS", 30)
    monkeypatch.setattr(vector_index, "QUERIES", 7)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 8))
    x = {"clusters": centres[rng.integers(0, 12, 400)] + 0.05 * rng.normal(size=(400, 8)), "sphere": rng.normal(size=(400, 8)), "long": rng.normal(size=(400, 8)) * 10.0 ** rng.uniform(-2, 2, (400, 1)), "same": np.ones((400, 8))}[kind]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    index = vector_index.build(df, lists=15, sample=150)
    found, reads = index.search(df.where("vec_id % 10 = 0"), 4)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["similarity"]))
    expected = plain_nearest(rows, rows[::10], 4)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in expected.items()}
    assert all(abs(a[1] - b[1]) < 1e-9 * max(1, abs(b[1])) for q in got for a, b in zip(got[q], expected[q]))
    shares = [r["rows_read"] / 400 for r in reads.collect()]
    assert len(shares) == 40 and max(shares) <= 1
    if kind == "clusters":
        assert sum(shares) / 40 < 0.7


def test_index_drops_what_is_no_vector(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.5, 0.5]), (4, None), (5, [1.0]), (6, [1.0, 2.0, 3.0]), (7, [1.0, None]), (8, [float("nan"), 1.0]), (None, [1.0, 1.0]), (9, [])]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r["query_id"], r["rank"], r["id"]) for r in vector_index.nearest(df, df, 9).collect())
    assert got == [(1, 1, 3), (1, 2, 2), (2, 1, 3), (2, 2, 1), (3, 1, 1), (3, 2, 2)]
    assert vector_index.nearest(df.limit(0), df, 3).count() == 0 and vector_index.nearest(df, df.limit(0), 3).count() == 0


def test_reach(spark):
    edges = [(i, i + 1) for i in range(12)] + [(3, 0), (5, 5), (20, 21), (None, 1), (1, None), (0, 7), (0, 7)]
    e = spark.createDataFrame(edges, "source long, target long")
    starts = spark.createDataFrame([(0,), (20,), (99,), (None,), (0,)], "start long")
    got = sorted(map(tuple, recursion.reach(e, starts).collect()))
    expected = []
    for s in (0, 20, 99):
        hops, todo = {s: 0}, [s]
        for n in todo:
            for a, b in edges:
                if a == n and b is not None and b not in hops:
                    hops[b] = hops[n] + 1
                    todo.append(b)
        expected += [(s, n, h) for n, h in hops.items()]
    assert got == sorted(expected)
    assert max(r["hops"] for r in recursion.reach(e, starts, max_rounds=2).collect()) == 2
    assert recursion.reach(e.limit(0), starts).count() == 3


@pytest.mark.parametrize("digest", ["own", "same"])
@pytest.mark.parametrize("kind", ["directed", "both ways", "pages"])
def test_reach_of_twins(spark, kind, digest, monkeypatch):
    monkeypatch.setattr(recursion, "BLOCK", 3)
    monkeypatch.setattr(recursion, "ROWS", 50)
    if digest == "same":
        monkeypatch.setattr(recursion, "_digest", lambda: F.struct(F.sign(F.count("goes"))))
    rng = random.Random(kind)
    edges = {(rng.randint(0, 30), rng.randint(0, 30)) for _ in range(35)}
    if kind == "pages":
        edges = {(100 + i, i % 4 * 10 + k) for i in range(40) for k in range(3)} | {(150, 2), (150, 11), (7, 7), (8, 8), (7, 8), (8, 7), (9, 7), (9, 8)}
    if kind != "directed":
        edges |= {(b, a) for a, b in edges}
    starts = [0, 7, 8, *range(100, 112), 999]
    expected = set()
    for s in starts:
        hops, todo = {s: 0}, [s]
        for n in todo:
            for a, b in edges:
                if a == n and b not in hops:
                    hops[b] = hops[n] + 1
                    todo.append(b)
        expected |= {(s, n, h) for n, h in hops.items()}
    e, s = spark.createDataFrame(sorted(edges), "source long, target long").repartition(5), spark.createDataFrame([(x,) for x in starts], "start long")
    assert sorted(map(tuple, recursion.reach(e, s).collect())) == sorted(expected)
    for rounds in (0, 1, 3):
        assert sorted(map(tuple, recursion.reach(e, s, rounds).collect())) == sorted(x for x in expected if x[2] <= rounds)


def test_rounds_do_not_hold_pairs_of_twins(spark, monkeypatch):
    stored = Counter()

    def counted(df, label, staged=recursion.staged):
        out = staged(df, label)
        stored[label] += out.count()
        return out

    monkeypatch.setattr(recursion, "staged", counted)
    e = spark.createDataFrame([x for p in range(40) for a in "abc" for x in ((f"p{p}", a), (a, f"p{p}"))], "source string, target string")
    got = recursion.reach(e, spark.createDataFrame([(f"p{p}",) for p in range(40)], "start string"))
    assert got.count() == 40 * 43 and got.groupBy("hops").count().orderBy("hops").collect() == [(0, 40), (1, 120), (2, 1560)]
    assert stored["reach-delta"] <= 4  # 1,720 one by one


def test_rank_sums_to_the_nodes(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a"), ("d", "a"), ("a", "e")], "source string, target string")
    rows = {r["node"]: r for r in recursion.rank(e, 30).collect()}
    assert sum(r["rank"] for r in rows.values()) == pytest.approx(5)
    assert max(rows, key=lambda n: rows[n]["rank"]) == "a" and rows["e"]["links"] == 0


@pytest.mark.parametrize("width", [1, 100, 10_000])
def test_funnel_against_brute_force(spark, width):
    from datetime import datetime, timedelta

    rng = random.Random(width)
    zero = datetime(2024, 1, 1)
    rows = [(rng.choice([1, 1, 1, 2, None]), i, zero + timedelta(seconds=rng.randint(0, 300), milliseconds=rng.choice([0, 500])), rng.choice("abc")) for i in range(150)] + [(1, 900, None, "a")]
    df = spark.createDataFrame(rows, "k long, i long, t timestamp_ntz, s string")
    got = {r["a"]: (r["b"], r["c"], r["reached"]) for r in funnels.funnel(df, "k", "t", "i", {x: F.col("s") == x for x in "abc"}, 5, width).collect()}
    expected = {}
    for k, i, t, s in rows:
        if s != "a" or k is None or t is None:
            continue
        made = []
        for want in "bc":
            later = min(((u, j) for m, j, u, x in rows if m == k and x == want and u is not None and u > t), default=None)
            if later is None or later[0] > t + timedelta(seconds=5):
                break
            t = later[0]
            made.append(later[1])
        expected[i] = (*made, *[None] * (2 - len(made)), 1 + len(made))
    assert got == expected


@pytest.mark.parametrize("values", [[], [None], [1, 1, 3], [1, None]])
def test_not_in_as_sql_has_it(spark, values):
    from millrace.operators.joins import not_listed

    keys, listed = spark.createDataFrame([(k,) for k in (0, 1, 1, 3, None)], "k long"), spark.createDataFrame([(v,) for v in values], "v long")
    told = duckdb.execute("SELECT k, k NOT IN (SELECT unnest($v::BIGINT[])) FROM (SELECT unnest([0, 1, 1, 3, NULL]) AS k)", {"v": values}).fetchall()
    assert sorted(map(repr, told)) == sorted(repr((r["k"], r["not_listed"])) for r in not_listed(keys, "k", listed).collect())


@pytest.mark.parametrize("name", ["not_in", "not_in_null"])
def test_not_in_has_no_nested_loop(spark, name):
    """A nested loop over two tables (the one row that tells of nulls apart), or a list that is broadcast."""
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "ExistenceJoin" not in plan and "LeftAnti" not in plan


def test_bitmaps_hold_keys_of_any_size(spark, tmp_path):
    """A single bitmap has 32,768 places, onto which greater keys fell a second time."""
    rows = spark.range(0, 100_000, 7).select(F.when(F.col("id") % 3 == 0, "A").otherwise("N").alias("l_returnflag"), F.col("id").alias("l_suppkey"))
    told = {r["l_returnflag"]: r["n"] for r in aggregates.bitmap_distinct(rows.union(rows), "l_returnflag", "l_suppkey", "n").collect()}
    assert told == {"A": 4762, "N": 9524}
    l = rows.withColumns({"l_partkey": F.col("l_suppkey"), "l_quantity": (F.col("l_suppkey") % 50).cast("double")})
    l.write.parquet(f"{tmp_path}/lineitem.parquet")
    told = registry.QUERIES["agg_sketches"](spark, str(tmp_path)).collect()
    assert {r["l_returnflag"]: r["suppliers"] for r in told} == {"A": 4762, "N": 9524}


def test_wide_summaries_merge_few_at_a_time(spark, monkeypatch):
    """Sixteen summaries of many counters don't meet in one task; when no summary can prove the result, all are counted at once."""
    monkeypatch.setattr(heavy_hitters, "HELD", 100)
    monkeypatch.setattr(heavy_hitters, "WAITING", 1)
    asked, real = [], heavy_hitters.summary
    monkeypatch.setattr(heavy_hitters, "summary", lambda df, c, m: asked.append(m) or real(df, c, m))
    df = spark.range(3000).select(F.when(F.col("id") < 40, 7).otherwise(F.col("id") % 1000).alias("v")).repartition(9)
    true = sorted(Counter(r["v"] for r in df.collect()).items(), key=lambda r: (-r[1], r[0]))[:5]
    assert [(r["value"], r["n"]) for r in heavy_hitters.frequent(df, "v", 5, counters=50).orderBy("rank").collect()] == true
    assert asked == [50, 1001]


def test_a_query_of_all_lists_is_told_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "CELLS", 100)
    monkeypatch.setattr(vector_index, "PAIRS", 10)
    v = np.random.default_rng(5).normal(size=(300, 4)).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    index = vector_index.build(df, lists=20)
    asked = df.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), F.lit(None).cast("double").alias("floor"))
    sizes = []

    class Seen:
        def mapInArrow(self, run, schema):
            sizes.extend(b.num_rows for b in run(iter(asked.toArrow().to_batches())))

    monkeypatch.setattr(type(asked), "select", lambda self, *a: Seen())
    index._probes(asked, "second")
    monkeypatch.undo()
    assert sum(sizes) == 300 * (20 - vector_index.PROBES) and max(sizes) <= 10
    got = sorted((r["query_id"], r["rank"], r["id"]) for r in vector_index.nearest(df, df, 3, lists=20).collect())
    s = v.astype(np.float64) @ v.astype(np.float64).T
    np.fill_diagonal(s, -np.inf)
    assert got == sorted((q, r + 1, int(i)) for q in range(300) for r, i in enumerate(np.argsort(-s[q], kind="stable")[:3]))


def test_best_takes_ties_in_order():
    s = np.array([[1.0, 2, 2, 2, -np.inf], [-np.inf] * 5, [0, 0, 0, 0, 5]])
    row, column = vector_index._best(s, 2)
    assert list(zip(row.tolist(), column.tolist())) == [(0, 1), (0, 2), (2, 4), (2, 0)]


def test_a_search_stores_no_pairs_of_query_and_list(spark):
    v = np.random.default_rng(6).normal(size=(600, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], SCHEMA)
    before = len(storage._written)
    found = vector_index.nearest(df, df, 2, lists=60)
    stored = [spark.read.parquet(path).count() for _, path in storage._written[before:]]
    assert found.count() == 1_200 and stored and max(stored) <= 1_200


@pytest.mark.parametrize("kind", ["plain", "great", "tiny", "mixed", "repeated"])
def test_similarities_are_those_of_a_loop(spark, kind, monkeypatch):
    """Sums go coordinate by coordinate, so ranks are SQL's also where products differ in the last bit; turns of few queries."""
    monkeypatch.setattr(vector_index, "QUERIES", 40)
    rng = np.random.default_rng(8)
    v = rng.normal(size=(160, 48))
    v = {"plain": v, "great": v * 1e30, "tiny": v * 1e-38, "mixed": v * 10.0 ** rng.integers(-30, 30, (160, 1)), "repeated": v[rng.integers(0, 4, 160)] * [[1.0]]}[kind].astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], SCHEMA).repartition(2)
    s = np.zeros((160, 160))
    for c in v.T.astype(np.float64):
        s += c[:, None] * c
    np.fill_diagonal(s, -np.inf)
    expected = [(q, r + 1, int(i), s[q, i]) for q in range(160) for r, i in enumerate(np.argsort(-s[q], kind="stable")[:3])]
    assert sorted((r["query_id"], r["rank"], r["id"], r["similarity"]) for r in vector_index.nearest(df, df, 3, lists=9).collect()) == expected
