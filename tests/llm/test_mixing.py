from collections import defaultdict

import pytest

from millrace.llm import mixing as op


def brute_targets(sizes, weights=(1, 2, 3), passes=3):
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(passes * sizes[s] for s in capped)
        mass = sum(weight[s] for s in sizes if s not in capped)
        share = {s: left * weight[s] / mass for s in sizes if s not in capped}
        over = {s for s in share if share[s] > passes * sizes[s] * (1 + 1e-12)}
        if not over:
            return share | {s: float(passes * sizes[s]) for s in capped}
        capped |= over


@pytest.fixture
def rows(prose):
    return [(i, prose(5 + i % 40, i), ["a", "b", "é", None, "tiny"][0 if i % 3 == 0 else i % 5 if i % 5 < 4 else 1] if i != 7 else "tiny") for i in range(300)]


def test_targets_and_taken(make, rows):
    got = op.mix(make(rows, extra=True)).collect()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    source = {r[0]: r[2] for r in rows}
    for r in got:
        s = source[r["doc_id"]]
        sizes[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"])
    want = brute_targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= 2 * 45
    assert sum(taken.values()) <= sum(sizes.values())


def test_reruns_agree(make, rows, spark):
    first = sorted(map(tuple, op.mix(make(rows)).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    again = sorted(map(tuple, op.mix(make(rows)).repartition(3).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert first == again


def test_runs_of_a_source(make, rows, monkeypatch):
    want = sorted(map(tuple, op.mix(make(rows)).collect()))
    monkeypatch.setattr(op, "RUN_ROWS", 7)
    assert sorted(map(tuple, op.mix(make(rows)).collect())) == want


def test_the_end_is_found_by_cutting_again(make, rows, monkeypatch):
    want = sorted(map(tuple, op.mix(make(rows)).collect()))
    monkeypatch.setattr(op, "END_ROWS", 5)
    assert sorted(map(tuple, op.mix(make(rows)).collect())) == want


def test_rows_of_one_id(make, prose, spark):
    """Other texts of one id, or of none, are spread over the queue and taken alike in reruns."""
    rows = [(None if i % 2 else 5, prose(6, i), "ab"[i % 3 == 0]) for i in range(90)]
    docs = make(rows)
    first = sorted(r["text"] for r in op.repeat_documents(docs).collect())
    assert first == sorted(r["text"] for r in op.repeat_documents(docs.repartition(7)).collect())
    keys = docs.select(op.shuffle_key(docs["doc_id"], docs["text"], "mix").alias("key"))
    assert keys.distinct().count() == 90


def test_edges(make, edge_rows):
    got = op.mix(make(edge_rows)).collect()
    assert len(got) == len(edge_rows)
    assert all(r["taken"] == 0 for r in got if r["size"] == 0)
    assert op.mix(make([])).count() == 0
    assert [r["taken"] for r in op.mix(make([(1, None), (2, "")])).collect()] == [0, 0]


def test_documents_are_repeated(make, rows):
    rows = rows + [rows[0], rows[0]]
    docs = make(rows, extra=True)
    out = op.repeat_documents(docs)
    assert out.columns == docs.columns
    words = sum(len(r["text"].split()) for r in out.select("text").collect())
    assert words == sum(r["taken"] for r in op.mix(docs).collect())
    assert op.repeat_documents(make([])).count() == 0
