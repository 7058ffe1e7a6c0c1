import re

import numpy as np
import xxhash

from millrace.llm import common, components
from millrace.llm import simhash as op


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def brute_components(prints):
    """Place of the least member of each one's component."""
    f, root = np.array(prints, dtype=np.uint64), list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i + 1 :] ^ f[i]) <= 4) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(f))]


def test_fingerprints(edge_rows):
    for _, text in edge_rows:
        assert op.fingerprint(text or "") == brute_print(text)


def test_blocks_of_shingles(prose, monkeypatch):
    text = prose(500, 3)
    want = op.fingerprint(text)
    monkeypatch.setattr(op, "BLOCK", 7)
    assert op.fingerprint(text) == want == brute_print(text)


def clustered(seed, n=400):
    rng = np.random.default_rng(seed)
    out = [int(x) for x in rng.integers(0, 2**63, 40)]
    while len(out) < n:
        f = out[rng.integers(0, len(out))]
        for b in rng.choice(64, rng.integers(1, 6), replace=False):
            f ^= 1 << int(b)
        out.append(f)
    return list(dict.fromkeys(out))


def found_components(spark, prints):
    signed = np.array(prints, dtype=np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    root = {r["node"]: r["root"] for r in components.components(op.links(df)).collect()}
    return [root.get(f, f) for f in signed]


def partition(labels):
    groups = {}
    for i, x in enumerate(labels):
        groups.setdefault(x, []).append(i)
    return sorted(groups.values())


def test_links_against_brute_force(spark, monkeypatch):
    for small in (32, 1, 3):
        monkeypatch.setattr(op, "SMALL_RUN", small)
        prints = clustered(small)
        assert partition(found_components(spark, prints)) == partition(brute_components(prints))


def test_long_runs_are_cut(monkeypatch):
    for seed, long in ((1, 8), (2, 40)):
        monkeypatch.setattr(op, "LONG_RUN", long)
        prints = np.array(clustered(seed, 500), dtype=np.uint64)
        a, b = op._tree_of_run(prints)
        assert (np.bitwise_count(a ^ b) <= 4).all() and len(a) < len(prints)
        place = {int(f): i for i, f in enumerate(prints)}
        root = list(range(len(prints)))
        for x, y in zip(a.tolist(), b.tolist()):
            old, new = root[place[x]], root[place[y]]
            root = [new if r == old else r for r in root]
        assert partition(root) == partition(brute_components(prints.tolist()))


def test_hot_centres(spark, monkeypatch):
    """A component with most of the nodes, and every key hot."""
    monkeypatch.setattr(common, "FEW_ROWS", 0)
    rng = np.random.default_rng(3)
    edges = [(0, int(i)) for i in range(1, 400)] + [(int(a), int(b)) for a, b in rng.integers(1000, 1400, (300, 2))] + [(399, 2000), (2000, 1999), (1999, -5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(df).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


def test_runs_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    prints = clustered(7, 150)
    got = found_components(spark, prints)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert partition(got) == partition(brute_components(prints))


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_documents(make, edge_rows, prose):
    near = [(20 + i, prose(300, 5) + f" tail{i}") for i in range(5)]
    rows = edge_rows + near
    got = op.near_dedup(make(rows, extra=True)).collect()
    prints = [brute_print(t) for _, t in rows]
    roots = brute_components(prints)
    want = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if roots[j] == roots[i] and rows[j][0] is not None]
        want.append((d, int(np.array([prints[i]], dtype=np.uint64).view(np.int64)[0]), min(ids, default=None)))
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))
    assert op.near_dedup(make([])).count() == 0


def test_one_of_each_group_stays(make, edge_rows):
    docs = make(edge_rows, extra=True)
    out = op.keep_one(docs)
    roots = brute_components([brute_print(t) for _, t in edge_rows])
    assert out.columns == docs.columns and out.count() == len(set(roots))
    assert op.keep_one(make([])).count() == 0
    assert op.keep_one(make([(None, "a b c d e"), (None, "a b c d e"), (None, "other words stand here now")])).count() == 2
