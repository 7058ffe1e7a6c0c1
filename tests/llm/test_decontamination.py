import re

import pytest

from millrace.llm import common
from millrace.llm import decontamination as op


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(rows, items):
    windows = []
    for i, t in items:
        w = words(t)
        if w:
            windows += [(i, w[k : k + 13]) for k in range(max(1, len(w) - 12))]
    out = []
    for d, t in rows:
        w, hit, ids = words(t), set(), set()
        for i, v in windows:
            for k in range(len(w) - len(v) + 1):
                if w[k : k + len(v)] == v:
                    hit.update(range(k, k + len(v)))
                    ids.add(i)
        out.append((d, len(w), len(hit), sorted(map(str, ids)), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(map(repr, out))


def found(spark, make, rows, items, extra=False):
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = op.contamination(make(rows, extra=extra), bench).collect()
    return sorted(repr((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"]), r["contaminated"])) for r in got)


@pytest.fixture
def cases(prose, edge_rows):
    a, b = prose(40, 50), prose(16, 51)
    items = [(1, a), (2, b), (10, "Only three words"), (3, None), (4, ""), (5, "!!"), (6, b), (7, "zebra")]
    rows = list(edge_rows)
    rows += [(20, prose(300, 52) + " " + " ".join(a.split()[3:20]) + " " + prose(50, 53)), (21, a.upper() + "; " + b), (22, " ".join(a.split()[:12])), (23, "the only THREE, words here"), (24, " ".join(a.split()[::-1])), (25, prose(2000, 54) + " " + b), (26, "zebra zebra, x"), (26, "zebra zebra, x"), (None, b), (27, "on" + "ly three words")]
    return rows, items


def test_against_brute_force(spark, make, cases):
    rows, items = cases
    assert found(spark, make, rows, items, extra=True) == brute(rows, items)


def test_without_broadcast(spark, make, cases, monkeypatch):
    monkeypatch.setattr(op, "BROADCAST_ROWS", 0)
    rows, items = cases
    assert found(spark, make, rows, items) == brute(rows, items)


def test_empty(spark, make):
    assert found(spark, make, [], [(1, "a b")]) == []
    assert found(spark, make, [(1, "a b")], []) == brute([(1, "a b")], [])


def test_contaminated_rows_go(spark, make, cases):
    rows, items = cases
    docs, bench = make(rows, extra=True), spark.createDataFrame(items, "item_id long, text string")
    bad = sum(r["contaminated"] for r in op.contamination(docs, bench).collect())
    out = op.drop_contaminated(docs, bench)
    assert bad > 3 and out.columns == docs.columns and out.count() == len(rows) - bad


def test_proximity(spark, make, prose):
    item = prose(13, 60).split()
    rare = "quokka"
    item[4], item[9] = rare, "numbat"
    moved = item[:5] + ["more"] + item[5:9] + ["numbat"] + item[10:]
    rows = [(1, " ".join(moved)), (2, " ".join(item)), (3, f"{rare} " + prose(60, 61) + " numbat"), (4, prose(30, 62))]
    index = op.Index(make(rows), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"))
    assert sorted(r["d_id"] for r in index.proximity(2).collect()) == [1, 2]
    assert sorted(r["d_id"] for r in index.phrases().collect()) == [2]


def brute_near(rows, items, slack):
    said = [words(t) for _, t in rows]
    count = {}
    for w in said:
        for x in w:
            count[x] = count.get(x, 0) + 1
    out = [set() for _ in rows]
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            v = w[k : k + 13]
            ranked = sorted((count[x], x, p) for p, x in enumerate(v) if x in count)[:2]
            if len(ranked) == 2:
                for d, u in enumerate(said):
                    a, b = ([at - p for at, x in enumerate(u) if x == y] for _, y, p in ranked)
                    if any(abs(x - y) <= slack for x in a for y in b):
                        out[d].add("" if i is None else str(i))
    return sorted((repr(d), sorted(near)) for (d, _), near in zip(rows, out))


@pytest.mark.parametrize("all_hot", [False, True])
def test_proximity_against_brute_force(spark, make, cases, prose, monkeypatch, all_hot):
    """Passages with a word of no document in the item, words left out or put in, and the other way around."""
    rows, items = cases
    w = prose(30, 70).split()
    items = items + [(50, " ".join([*w[:6], "nowhereword", *w[6:]])), (51, " ".join(w[::-1]))]
    rows = rows + [(60, " ".join(w)), (61, prose(40, 71) + " " + " ".join(w[:9] + ["put", "in"] + w[9:])), (62, " ".join(w[::2]))]
    if all_hot:
        monkeypatch.setattr(common, "FEW_ROWS", 0)
        monkeypatch.setattr(op, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(op, "ROWS_A_TASK", 3)
    got = op.contamination(make(rows), spark.createDataFrame(items, "item_id long, text string"), slack=3).collect()
    assert sorted((repr(r["doc_id"]), list(r["near"])) for r in got) == brute_near(rows, items, 3)
    exact = sorted(repr((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"]), r["contaminated"])) for r in got)
    assert exact == brute(rows, items)


def test_copies_of_a_passage_take_linear_time(spark, make, prose):
    """One document in thousands of rows: each gets its row, and the work follows their number."""
    import time

    item, text = prose(30, 60), prose(30, 60) + " and more"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")

    def seconds(n):
        docs = make([(1, text)]).crossJoin(spark.range(n)).drop("id")
        began = time.perf_counter()
        got = op.contamination(docs, bench, slack=op.SLACK).groupBy("n_words", "n_hit", "contaminated", "near").count().collect()
        assert [(r["n_hit"], r["contaminated"], r["near"], r["count"]) for r in got] == [(30, True, ["1"], n)]
        return time.perf_counter() - began

    seconds(10)
    assert seconds(10_000) < 3 * max(seconds(1_000), 5)
