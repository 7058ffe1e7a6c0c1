import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import common
from millrace.llm import suffix_array as sa
from millrace.llm import suffix_dedup as op


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60))
def test_suffix_array_and_prefixes(symbols):
    t = np.array([*symbols, 0], dtype=np.uint16)
    order = sa.suffix_array(t)
    assert order.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
    plcp = sa.permuted_lcp(t, order, np.arange(len(t), 0, -1))
    for before, here in zip(order[:-1], order[1:]):
        n = 0
        while max(before, here) + n < len(t) and t[before + n] == t[here + n]:
            n += 1
        assert plcp[here] == n


def brute(rows):
    """Documents in order of id, null last."""
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (t or "").encode()
        cover = np.zeros(len(data) + 1, dtype=int)
        for i in range(len(data) - 99):
            w = data[i : i + 100]
            if w in seen:
                cover[i] += 1
                cover[min(i + 100, len(data))] -= 1
            seen.add(w)
        lost = np.cumsum(cover)[: len(data)] > 0
        spans = int((np.diff(np.concatenate([[0], lost.astype(int)])) == 1).sum())
        out.append((d, len(data), int(lost.sum()), spans, np.frombuffer(data, np.uint8)[~lost].tobytes()))
    return sorted(map(repr, out))


def found(df):
    return sorted(repr((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]))) for r in op.remove_repeats(df).collect())


def mixed(prose, seed, n=60):
    rng = random.Random(seed)
    passages = [prose(rng.randint(10, 40), 100 + k) for k in range(6)]
    rows = []
    for i in range(n):
        parts = [prose(rng.randint(0, 60), 1000 * seed + 7 * i + k) if rng.random() < 0.5 else rng.choice(passages) for k in range(rng.randint(0, 5))]
        text = rng.choice([" ", "", "\n"]).join(parts)
        if rng.random() < 0.3 and rows:
            text = list(rng.choice(rows)[1])
            for _ in range(rng.randint(0, 6)):
                if text:
                    text[rng.randrange(len(text))] = rng.choice("xyzé")
            text = "".join(text)
        rows.append((i, text))
    rows += [(n, "ab" * 400), (n + 1, "abc" * 300 + "ab" * 200), (n + 2, "a" * 99), (n + 3, "a" * 100), (n + 4, "a" * 250), (n + 5, None), (n + 6, "é" * 120), (None, passages[0] * 2)]
    return rows


def test_against_brute_force(make, prose):
    for seed in (1, 2):
        rows = mixed(prose, seed)
        assert found(make(rows, extra=True)) == brute(rows)


def test_small_batches_and_shards(make, prose, spark, monkeypatch):
    monkeypatch.setattr(op, "SHARD", 2000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    rows = mixed(prose, 3, 40)
    got = found(make(rows))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute(rows)


@pytest.mark.parametrize("hot", [5, 1_000])
@pytest.mark.parametrize("bound", [0, 1_000])
def test_one_passage_among_many_neighbours(make, prose, hot, bound, monkeypatch):
    """Its edges are one minimizer with many strings."""
    passage = prose(40, 9)
    rows = [(i, prose(12, 200 + i) + " " + passage + " " + prose(12, 500 + i)) for i in range(40)]
    monkeypatch.setattr(op, "HOT_STRINGS", hot)
    monkeypatch.setattr(op, "BROADCAST_ROWS", bound)
    assert found(make(rows)) == brute(rows)


def test_repeated_rows_are_one_document(make, prose):
    text = prose(50, 4)
    got = op.remove_repeats(make([(1, text), (1, text), (2, text)])).collect()
    assert sorted((r["doc_id"], r["n_removed"] > 0) for r in got) == [(1, False), (1, False), (2, True)]


def test_edges(make, edge_rows):
    rows = [r for r in dict.fromkeys(edge_rows) if r[0] is not None] + [(None, edge_rows[3][1])]
    assert found(make(rows)) == brute(rows)
    assert found(make([])) == []


def test_null_and_greatest_id(make, prose, spark):
    text = prose(40, 31)
    got = op.remove_repeats(make([(None, text), (2**63 - 1, text), (3, "short")])).collect()
    assert sorted((str(r["doc_id"]), r["n_removed"] > 0) for r in got if r["doc_id"] != 3) in ([("9223372036854775807", False), ("None", True)], [("9223372036854775807", True), ("None", False)])
    with pytest.raises(TypeError):
        op.remove_repeats(spark.createDataFrame([("a", text)], "doc_id string, text string"))


def test_frequent_windows_stay_spread(make, prose, monkeypatch):
    monkeypatch.setattr(common, "FEW_ROWS", 0)
    monkeypatch.setattr(op, "HOT_STRINGS", 3)
    passage = prose(40, 9)
    rows = [(i, prose(12, 200 + i) + " " + passage + " " + prose(12, 500 + i)) for i in range(30)]
    assert found(make(rows)) == brute(rows)


def test_runs_of_a_hot_minimizer_stay_spread(make, prose, spark, monkeypatch):
    """One passage in all documents, with other neighbours each time: its edges go by minimizer and string."""
    monkeypatch.setattr(op, "SAMPLE", 1)
    monkeypatch.setattr(op, "HOT_STRINGS", 20)
    passage = prose(40, 70)[:150]
    rows = [(i, f"{prose(30, 7000 + i)} {passage} {prose(30, 8000 + i)}") for i in range(150)]
    docs = make(rows)
    assert found(docs) == brute(rows)
    keyed = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("t"), "text")
    assert op._hot_minimizers(keyed).count() > 0
